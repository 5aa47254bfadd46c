"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Detected are e-mail addresses, phone, social security and payment card numbers (with a valid check digit), IPv4
addresses, credentials behind a naming keyword, and person names behind one or more titles.  Each distinct entity of the
whole table gets one surrogate, drawn from a keyed digest, so that all its mentions agree however they are written; name
parts are entities of their own, so "Mr Jon Doe" and "Mr Doe" keep the same surname.  Gender (from the title), script,
letter case, separators, length and check digits stay.  A surrogate that equals an entity of the table or another surrogate
is drawn again, until all are distinct.

A name has any number of words; the last is the surname, the others are given names.  Particles ("van", "de la") stay, an
initial becomes a keyed letter, the same throughout.  In a text with a titled name, its surname is replaced without a title
too, and its given names and initials where the surname follows them.

Not detected: names in texts that never give them a title, given names that stand alone, titles in capitals, names over
more than one line (a title may end a line); capital words right behind a name count as parts of it.  Nor are credentials of fewer than 16 letters, digits and +/_-
(ordinary passwords), what follows another character in a longer one, and numbers in other groups than the patterns have.

Native expressions only.  Defined results: null and empty texts stay as they are with no entities; repeated rows get the
same text; extra columns pass through, a clashing ``n_pii`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockwise.llm.common import small, text_key
from blockwise.session import stage

_MALE, _FEMALE = "Mr|Herr|Monsieur|Señor|Signor|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Signora|Госпожа"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|Dr|Prof)\.?"
_TITLES = rf"{_TITLE}(?:\s{{1,3}}{_TITLE}(?=\s))*+\s{{1,3}}"
#: A name word ends with a letter, and before "'s"; it is no title.
_NAME = rf"(?!{_TITLE}(?![\p{{L}}\p{{M}}'’\-]))(?:\p{{Ll}}{{1,2}}['’\-])?\p{{Lu}}(?:[\p{{L}}\p{{M}}]|['’\-](?=\p{{L}})(?!s(?!\p{{L}})))++"
_INITIAL = r"\p{Lu}(?:\.(?:-?\p{Lu}\.)*+)?(?=\h)"
_PARTICLE = (r"(?:(?:von|van|vom|zum?|zur)(?:\h{1,3}(?:der|den|dem|de|het))?|de(?:\h{1,3}(?:la|las|los))?|della|del|des|di|da|das|dos|do|du|la|le|"
             r"ten|ter|te|af|av|al|el|bin|ibn|bint|ben|Ste?\.)(?=\h)")
#: Possessive throughout, so that no run of name words is too long for the matcher's stack.
_FULL = rf"(?:(?:{_PARTICLE}|{_INITIAL})\h{{1,3}})*+{_NAME}"
#: Each part can only start where a token starts, so a text without any space is still scanned in linear time.
PATTERN = "|".join((
    r"(?i:(?<![\p{L}\p{N}])(?:api[_-]?key|access[_-]?key|password|passwd|secret|token)[\"']?\s{0,3}[:=]\s{0,3}[\"']?[A-Za-z0-9+/_\-]{16,}+)",
    r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+",
    rf"(?<![\p{{L}}\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    r"(?<![\p{L}\d+])\+1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
    r"(?<![\p{L}\d+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)",
    r"(?<![\p{L}\d+])\+\d{1,3}[ .\-]\d(?:[ .\-]\d{2,4}){3,4}(?!\d)",
    r"(?<![\p{L}\d(])\(\d{3}\) ?\d{3}[.\-]\d{4}(?!\d)",
    r"(?<![\p{L}\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    r"(?<![\p{L}\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![\p{L}\p{N}])",
    rf"(?<!\p{{L}}){_TITLES}{_FULL}(?:\h{{1,3}}{_FULL})*+",
))
#: How a name without its title starts.
_CAPITAL = r"(?:\p{Ll}{1,2}['’\-])?\p{Lu}"
#: What every match contains; other texts are passed on unread.
HINT = rf"[@\d]|{_TITLE}\s{{1,3}}\p{{L}}|(?i:key|passw|secret|token)"

_LATIN = "ba,de,fi,go,hu,ka,le,mi,no,pu,ra,se,ti,vo,wa,ze"
_CYRILLIC = "ба,де,фи,го,ху,ка,ле,ми,но,пу,ра,се,ти,во,ва,зе"
_GREEK = "βα,δε,φι,γο,χυ,κα,λε,μι,νο,πυ,ρα,σε,τι,ξο,ψα,ζε"
#: Syllables of a surrogate name at the first draw; each draw after it has one more, so no kind of name can run out.
SYLLABLES = 5
MAX_ROUNDS = 40


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def _luhn(digits: Column) -> Column:
    """Sum of the check digit rule, from the right."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def kind_of(m: Column) -> Column:
    return (F.when(m.rlike(r"[:=]"), "secret").when(m.contains("@"), "email").when(m.rlike(r"^\p{L}"), "person")
            .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(m.rlike(r"^[+(]|^\d{3}[.\-]\d{3}[.\-]\d{4}$"), "phone").otherwise("card"))


def _credential(m: Column) -> Column:
    return F.regexp_extract(m, r"[A-Za-z0-9+/_\-]+$", 0)


def _words(m: Column) -> Column:
    """Words after the titles: name words, initials and particles."""
    return F.split(F.trim(F.regexp_replace(m, f"^{_TITLES}", "")), r"\h+")


def _is_name(word: Column) -> Column:
    return word.rlike(f"^{_NAME}$")


def _is_initial(word: Column) -> Column:
    return word.rlike(r"^\p{Lu}(\.(-?\p{Lu}\.)*)?$")


def _script(part: Column) -> Column:
    return F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _gender(m: Column) -> Column:
    start = F.substring(m, 1, 20)
    return F.when(start.rlike(rf"^(?:{_MALE})\b"), "m").when(start.rlike(rf"^(?:{_FEMALE})\b"), "f").otherwise("x")


def _name_kind(gender: Column, part: Column, given: Column) -> Column:
    script = _script(part)
    # Cyrillic surnames show the gender as well
    role = F.when(given, F.concat(F.lit("given_"), gender)).when(script == "cyrillic", F.concat(F.lit("surname_"), gender)).otherwise("surname_x")
    return F.concat_ws("_", role, script)


def _once(use: Callable[[Column], Column], **values: Column) -> Column:
    """``use`` of a struct of values, each of which is worked out once and not for every element of a lambda inside."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), use), F.lit(0))


def _normal(kind: Column, m: Column) -> Column:
    digits = _digits(m)
    number = F.when((kind == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (F.when(kind == "secret", F.lower(_credential(m))).when(kind == "email", F.lower(m)).when(kind == "ip", m).otherwise(number))


def _entity(kind: Column, normal: Column) -> Column:
    return F.struct(kind.alias("kind"), normal.alias("normal"))


def entities_of(m: Column) -> Column:
    """(kind, normal form) of what a match mentions; a card number whose check digit is wrong mentions nothing."""
    kind = kind_of(m)
    # the last word is a name
    named = _once(lambda x: F.transform(x.words, lambda p, i: F.when(_is_name(p), _entity(_name_kind(x.gender, p, i < x.last), F.lower(p)))),
                  words=_words(m), last=F.size(_words(m)) - 1, gender=_gender(m))
    names = F.filter(named, lambda x: x.isNotNull())
    one = F.array(_entity(kind, _normal(kind, m)))
    none = F.slice(one, 1, 0)
    return F.when(kind == "person", names).when((kind == "card") & (_luhn(_digits(m)) % 10 != 0), none).otherwise(one)


def _stream(key: str, attempt: Column, kind: Column, normal: Column) -> Column:
    """Hex digits that depend on the key and the entity, at least as many as it has characters and 64."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(normal) / 32).cast("int")), lambda i: F.sha2(
        F.concat_ws("|", F.lit(key), kind, normal, attempt, i), 256)), "")


def _like(x: Column, stream: Column) -> Column:
    """``x`` with letters for letters and digits for digits, taken from the stream."""
    letters, digits = F.translate(stream, "0123456789abcdef", "abcdefghijklmnop"), F.translate(stream, "abcdef", "012345")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(
        F.substring(x, i, F.lit(1)).rlike(r"\p{N}"), F.substring(digits, i, F.lit(1))).when(
        F.substring(x, i, F.lit(1)).rlike(r"\p{L}"), F.substring(letters, i, F.lit(1))).otherwise(F.substring(x, i, F.lit(1)))), "")


def _byte(stream: Column, i: int) -> Column:
    return F.conv(F.substring(stream, 2 * i + 1, 2), 16, 10).cast("int")


def surrogate(key: str, attempt: Column, kind: Column, normal: Column) -> Column:
    """The normal form of the surrogate at a given attempt."""
    s = _stream(key, attempt, kind, normal)
    digits = F.translate(s, "abcdef", "012345")
    body = F.concat(F.substring(normal, 1, 1), F.substring(digits, F.lit(1), F.length(normal) - 2))
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    at = F.instr(normal, "@")
    user = F.substring(normal, F.lit(1), at - 1)
    mail = F.concat(_like(user, s), F.lit("@"), F.translate(F.substring(F.reverse(s), 1, 6), "0123456789abcdef", "abcdefghijklmnop"),
                    F.lit(".example.org"))
    octets = F.concat_ws(".", _byte(s, 0) % 223 + 1, _byte(s, 1), _byte(s, 2), _byte(s, 3))
    secret = F.when(normal.rlike("^[0-9a-f]+$"), F.substring(s, F.lit(1), F.length(normal))).otherwise(_like(normal, s))

    def name(syllables: str, endings: dict[str, str]) -> Column:
        parts = F.split(F.lit(syllables), ",")
        drawn = F.array_join(F.transform(F.sequence(F.lit(1), attempt + SYLLABLES), lambda i: F.element_at(
            parts, F.conv(F.substring(s, i, F.lit(1)), 16, 10).cast("int") + 1)), "")
        ending = F.lit("")
        for role, text in endings.items():
            ending = F.when(kind.startswith(role), text).otherwise(ending)
        return F.concat(drawn, ending)

    latin = name(_LATIN, {"given_m": "n", "given_f": "lla", "surname": "rt"})
    cyrillic = name(_CYRILLIC, {"given_m": "н", "given_f": "лла", "surname_m": "ров", "surname_f": "рова", "surname_x": "ко"})
    greek = name(_GREEK, {"given_m": "ς", "given_f": "νη", "surname": "κης"})
    return (F.when(kind == "card", card).when(kind == "email", mail).when(kind == "ip", octets).when(kind == "secret", secret)
            .when(kind.isin("phone", "ssn"), F.substring(digits, F.lit(1), F.length(normal)))
            .when(kind.endswith("cyrillic"), cyrillic).when(kind.endswith("greek"), greek).otherwise(latin))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) for distinct entities; surrogates are distinct within a kind and equal no entity of it."""
    real = stage(entities.distinct())
    taken, pending = None, real
    for attempt in range(MAX_ROUNDS):
        drawn = pending.withColumn("surrogate", surrogate(key, F.lit(attempt), F.col("kind"), F.col("normal")))
        # of those that drew the same, the first stays
        first = drawn.groupBy("kind", "surrogate").agg(F.min("normal").alias("normal"))
        first = first.join(real.select("kind", F.col("normal").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if taken is not None:
            first = first.join(taken.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        first = stage(first.select("kind", "normal", "surrogate"))
        taken = first if taken is None else taken.unionByName(first)
        pending = stage(pending.join(first.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        if pending.isEmpty():
            return taken
    raise ValueError("a kind of entity has more members than its format has distinct surrogates")


def _formatted(m: Column, kind: Column, new: Column) -> Column:
    """The surrogate written as the match is written."""
    shift = F.length(_digits(m)) - F.length(new)

    def put(i: Column) -> Column:
        c, before = F.substring(m, i, F.lit(1)), F.length(_digits(F.substring(m, F.lit(1), i)))
        return F.when(c.rlike(r"\d") & (before > shift), F.substring(new, before - shift, F.lit(1))).otherwise(c)

    number = F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), put), "")
    value = _credential(m)
    cased = F.when(F.upper(value) == value, F.upper(new)).otherwise(new)
    secret = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), cased)
    mail = F.when(F.upper(m) == m, F.upper(new)).otherwise(new)
    return F.when(kind == "secret", secret).when(kind == "email", mail).when(kind == "ip", new).otherwise(number)


def _initial(key: str, word: Column) -> Column:
    """An initial, or several, with another letter for each."""
    def put(c: Column) -> Column:
        letters = F.when(_script(c) == "cyrillic", _CYRILLIC).when(_script(c) == "greek", _GREEK).otherwise(_LATIN)
        others = F.filter(F.transform(F.split(letters, ","), lambda x: F.upper(F.substring(x, 1, 1))), lambda x: x != c)
        at = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("initial"), c), 256), 1, 7), 16, 10).cast("int")
        return F.when(c.rlike(r"\p{L}"), F.element_at(others, at % F.size(others) + 1)).otherwise(c)
    return F.array_join(F.transform(F.split(word, ""), put), "")


def _untitled(new: Column) -> Column:
    """What matches the names of a text without their titles (its surnames, and given names with the blank before more of the name),
    as an alternative to go behind ``PATTERN``; empty if there are none."""
    def names(role: str) -> Column:
        keys = F.filter(F.map_keys(new), lambda k: k.startswith(role))
        return F.array_join(F.array_sort(F.array_distinct(F.transform(keys, lambda k: F.element_at(F.split(k, r"\|"), 2)))), "|")

    def word(found: Column) -> Column:
        # [^\s\S] for no names matches nothing
        return F.concat(F.lit(rf"(?={_CAPITAL})(?iu:"), F.when(found == "", r"[^\s\S]").otherwise(found), F.lit(r")(?![\p{L}\p{N}\p{M}])"))

    last, given = word(names("surname")), word(names("given"))
    more = F.concat(F.lit(rf"\h{{1,3}}(?=(?:(?:{_PARTICLE}|{_INITIAL})\h{{1,3}})*+(?:"), given, F.lit("|"), last, F.lit("))"))
    return F.when(names("surname") == "", "").otherwise(F.concat(
        F.lit(r"|(?<![\p{L}\p{N}\p{M}])(?:(?:"), F.lit(_INITIAL), F.lit("|"), given, F.lit(")"), more, F.lit("|"), last, F.lit(")")))


def _rewritten(m: Column, new: Column, key: str) -> Column:
    """A match with its surrogates; ``new`` maps kind and normal form to them."""
    kind = kind_of(m)
    head = F.regexp_extract(m, f"^{_TITLES}", 0)
    tail = F.substring(m, F.length(head) + 1, F.length(m))

    def part(x: Column, p: Column, i: Column) -> Column:
        titled = F.element_at(new, F.concat_ws("|", _name_kind(x.gender, p, i < x.last), F.lower(p)))
        of = lambda role: F.coalesce(*[F.element_at(new, F.concat_ws("|", F.concat(F.lit(f"{role}_{g}_"), _script(p)), F.lower(p))) for g in "xmf"])
        drawn = F.when(~x.alone, titled).when(x.leading, of("given")).otherwise(of("surname"))
        name = F.when(F.upper(p) == p, F.upper(drawn)).otherwise(F.initcap(drawn))
        return F.when(_is_initial(p), _initial(key, p)).when(drawn.isNotNull(), name).otherwise(p)

    gaps = F.concat(F.regexp_extract_all(tail, F.lit(r"\h+"), F.lit(0)), F.array(F.lit("")))
    # an untitled given name stands with the blank behind it
    words = _once(lambda x: F.transform(x.words, lambda p, i: part(x, p, i)), words=_words(m), last=F.size(_words(m)) - 1, gender=_gender(m),
                  alone=head == "", leading=m.rlike(r"\h$"))
    person = F.concat(head, F.array_join(F.zip_with(words, gaps, lambda w, gap: F.concat(w, F.coalesce(gap, F.lit("")))), ""))
    drawn = F.element_at(new, F.concat_ws("|", kind, _normal(kind, m)))
    return F.when(kind == "person", person).otherwise(F.coalesce(_formatted(m, kind, drawn), m))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text`` and ``n_pii``, the number of mentions replaced (long)."""
    docs = docs.drop("n_pii")
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    texts = docs.where(hinted).select("doc_id", text_key(F.col("text")).alias("key"), F.explode(found).alias("m"))
    mentions = stage(texts.select("doc_id", "key", F.explode(entities_of(F.col("m"))).alias("e")).select("doc_id", "key", "e.*").distinct())
    drawn = mentions.join(assign(mentions.select("kind", "normal"), key), ["kind", "normal"])
    entry = F.struct(F.concat_ws("|", "kind", "normal").alias("k"), F.col("surrogate").alias("v"))
    maps = small(drawn.groupBy("doc_id", "key").agg(F.map_from_entries(F.collect_list(entry)).alias("_new"))
                 .withColumnsRenamed({"doc_id": "_doc", "key": "_key"}), 50_000)
    dirty = docs.where(hinted).join(maps, (text_key(F.col("text")) == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    dirty = dirty.withColumn("_pattern", F.when(F.col("_new").isNotNull(), F.concat(F.lit(PATTERN), _untitled(F.col("_new")))))
    dirty = dirty.withColumn("_found", F.regexp_extract_all("text", F.col("_pattern"), F.lit(0)))
    replaced = F.transform("_found", lambda m: _rewritten(m, F.col("_new"), key))
    text = F.array_join(F.zip_with(F.split("text", F.col("_pattern")), F.concat(replaced, F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    n = F.coalesce(F.size(F.filter("_found", lambda m: (F.size(entities_of(m)) > 0) & ~m.rlike(r"\h$"))), F.lit(0)).cast("long")
    dirty = dirty.withColumn("n_pii", F.when(F.col("_new").isNotNull(), n).otherwise(F.lit(0).cast("long")))
    dirty = dirty.withColumn("text", F.when(F.col("_new").isNotNull(), text).otherwise(F.col("text")))
    clean = docs.where(~hinted).withColumn("n_pii", F.lit(0).cast("long"))
    return clean.unionByName(dirty.select(clean.columns))
