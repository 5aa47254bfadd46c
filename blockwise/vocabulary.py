"""Fixed keyword lists and item tables.

Every list is ordered: "first match" rules depend on that order.  Callers may pass
their own :class:`Vocabulary` to any operator that takes one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The words screens are labelled with, in list order.
KEYWORDS: dict[str, list[str]] = {
    "governor_labels": [
        "Governador", "Governor", "Gouverneur", "Gobernador", "ID", "ID:", "(ID", "lD", "1D",
        "Statthalter", "Правитель", "Vali", "执政官", "집정관", "領主", "الحاكم",
    ],
    "alliance_labels": [
        "Alianca", "Alliance", "Alianza", "Aliança", "Allianz", "Альянс", "Ittifak", "联盟", "연맹",
        "同盟", "التحالف",
    ],
    "power_labels": [
        "Poder", "Power", "Puissance", "P0der", "Powcr", "Poder de Combate", "Macht", "Мощь", "Guc",
        "Güç", "战力", "战斗力", "전투력", "戦力", "القوة", "Sức mạnh",
    ],
    "kill_points_labels": [
        "Pontos de Abate", "Kill Points", "Kills", "Abate", "Muertes", "Points de kill",
        "Troupes tuées", "Tötungspunkte", "Очки убийств", "Oldurme Puani", "击杀", "击杀积分", "처치",
        "처치 포인트", "撃破", "نقاط القتل",
    ],
    "status_labels": [
        "Pontos de Acao", "Action Points", "AP", "Barra", "Nivel", "Stamina", "Energie",
        "Endurance",
    ],
    "ui_keywords": [
        "VIP", "Mais Informacoes", "More Info", "Perfil", "Profile", "Construir", "Build",
        "Recrutar", "Recruit", "Pesquisar", "Research", "Reparar", "Repair", "Chat", "Mensagem",
        "Message", "Comandante", "Commander", "Tropas", "Troops", "Conquistas", "Achievements",
        "Configuracoes", "Settings", "Ranking", "Classificacao", "Classificac", "Guia", "Guide",
        "Retrospecto", "Temporada", "Season", "UTC", "Câmara", "City Hall", "Prefeitura",
        "Hotel de Ville", "Rathaus", "Настройки", "Einstellungen", "设置", "설정", "Campeoes",
        "Olimpia", "Olympia", "Arca", "Osiris", "Reino", "Perdido", "Lost Kingdom", "Vitorias",
        "Wins", "Victories", "Siege", "Victoires", "Siege", "Autarca", "Oculto", "Hidden", "N/A",
        "NIA", "Bronze", "Ferro", "Idade", "Age", "Feudal", "Dark", "Trevas",
    ],
    "civilization_labels": [
        "Civilizacao", "Civilização", "Civilization", "Civilizacion",
    ],
    "civilizations": [
        "Roma", "Rome", "Rom", "Рим", "Alemanha", "Germany", "Allemagne", "Deutschland", "Германия",
        "Britania", "Britain", "Grande-Bretagne", "Britannien", "Британия", "Franca", "France",
        "França", "Frankreich", "Франция", "Espanha", "Spain", "Espagne", "Spanien", "Испания",
        "Viking", "Vikings", "Wikinger", "Викинги", "Grecia", "Greece", "Grece", "Griechenland",
        "Греция", "China", "Chine", "Китай", "中国", "중국", "Japao", "Japan", "Japon", "Япония", "日本",
        "Coreia", "Korea", "Coree", "Корея", "한국", "Arabia", "Arabie", "Аравия", "العربية",
        "Otomano", "Ottoman", "Ottomane", "Osmanisches", "Османы", "Bizancio", "Byzantium",
        "Byzance", "Byzanz", "Виzantия", "Egito", "Egypt", "Egypte", "Ägypten", "Египет",
    ],
    "units": [
        "Unidades de Tropas", "Troops", "Unidades", "兵数", "Units", "Truppen", "Troupes",
        "Unidades de tropa", "Войска", "部队", "部隊", "Truppe", "Unità", "Birlikler", "부대", "병력",
        "Quân đội", "Đơn vị", "Pasukan", "Unit", "กองทหาร", "القوات",
    ],
    "dead": [
        "Morto", "Dead", "Todesfälle", "死者", "战死", "Tués", "Muertos", "Мертвые", "陣亡", "Morti",
        "Ölü", "전사", "사망", "Tử trận", "Chết", "Mati", "Tewas", "เสียชีวิต", "ตาย", "القتلى",
    ],
    "severely_wounded": [
        "Gravemente ferido", "Gravemente ferida", "Severely Wounded", "重傷", "重伤",
        "Schwer verwundet", "Gravement blessés", "Heridos graves", "Тяжело ранены",
        "Feriti gravemente", "Ağır Yaralı", "중상", "Trọng thương", "Luka Parah", "บาดเจ็บสาหัส",
        "إصابة بليغة",
    ],
    "slightly_wounded": [
        "Levemente ferida", "Levemente ferido", "Slightly Wounded", "軽傷", "轻伤", "Leicht verwundet",
        "Légèrement blessés", "Heridos leves", "Легко ранены", "Feriti lievemente", "Hafif Yaralı",
        "경상", "Khinh thương", "Luka Ringan", "บาดเจ็บเล็กน้อย", "إصابة طفيفة",
    ],
    "remaining": [
        "Restante", "Remaining", "残存数", "剩余", "Verbleibend", "Restantes", "Осталось", "剩餘",
        "Rimanenti", "Kalan", "잔여", "남은 병력", "Còn lại", "Tersisa", "คงเหลือ", "المتبقية",
    ],
    "healed": [
        "Cura", "Healed", "Heal", "治疗", "Heilung", "Soin", "Curados", "Исцелено", "治療", "Guariti",
        "İyileştirilen", "치료", "Đã chữa trị", "Disembuhkan", "รักษาแล้ว", "تم الشفاء",
    ],
    "watchtower": [
        "Dano de Torre de Vigia", "Watchtower Damage", "警戒塔伤害", "警戒塔傷害", "Wachturm-Schaden",
        "Dégâts de tour de guet", "Урон сторожевой башни", "Danni torre di guardia",
        "Gözcü Kulesi Hasarı", "경계탑 피해", "Sát thương tháp canh", "Kerusakan Menara Pengawas",
        "ดาเมจหอสังเกตการณ์", "ضرر برج المراقبة",
    ],
    "kill_points": [
        "Pontos de Abate", "Kill Points", "撃破ポイント", "击杀积分", "Tötungspunkte", "Points de kill",
        "Puntos de muerte", "擊殺積分", "Punti uccisione", "Öldürme Puanı", "처치 포인트", "킬 포인트",
        "Điểm tiêu diệt", "Poin Kill", "คะแนนสังหาร", "نقاط القتل",
    ],
    "victory": [
        "Vitoria", "Vitória", "Victory", "Vitoire", "勝利", "Sieg", "Victoria", "Победа", "胜利",
        "Vittoria", "Zafer", "승리", "Chiến thắng", "Kemenangan", "ชนะ", "نصر",
    ],
    "defeat": [
        "Derrota", "Defeat", "Défaite", "敗北", "Niederlage", "Derrota", "Поражение", "失败", "失敗",
        "Sconfitta", "Yenilgi", "패배", "Thất bại", "Kekalahan", "พ่ายแพ้", "هزيمة",
    ],
    "global_blacklist": [
        "PESSOAL", "RELATORIO", "ALIANCA", "SISTEMA", "ENVIADO", "FAVORITOS", "Nova mensagem",
        "Ordenar por categoria", "Relatorio de Explora", "Aldeia Tribal", "2minutosatras",
        "Horas atras", "Ataque cancelado", "Reembolso do pont", "Lere resgatar tudo",
        "Expandir o editor", "Compartilhar", "PERSONAL", "REPORT", "ALLIANCE", "SYSTEM", "SENT",
        "FAVORITES", "New Message", "Sort by Category", "Exploration Report", "Battle Report",
        "Tribal Village", "Attack Cancelled", "Point Refund", "Read and Claim All", "Expand",
        "Share", "ago", "Just now", "个人", "战报", "联盟", "系统", "已发送", "收藏", "個人", "戰報", "聯盟", "系統",
        "發送", "一键已读", "全部已读", "全部領取", "一鍵領取", "部落村庄", "部落村莊", "個人", "報告", "同盟", "システム", "送信済",
        "お気に入り", "既読にして一括受取", "一括受取", "部族の村", "개인", "리포트", "연맹", "시스템", "보낸 편지", "즐겨찾기",
        "모두 읽기 및 수령", "일괄 수령", "부족 마을", "PERSÖNLICH", "BERICHT", "ALLIANZ", "GESENDET", "FAVORITEN",
        "Alles einsammeln", "Alles lesen", "Stammesdorf", "PERSONNEL", "RAPPORT", "SYSTÈME",
        "ENVOYÉS", "FAVORIS", "Tout récupérer", "Tout lire", "Village tribal", "PERSONAL",
        "INFORME", "ALIANZA", "SISTEMA", "ENVIADO", "FAVORITOS", "Recoger todo", "Leer todo",
        "Aldea tribal", "ЛИЧНЫЕ", "ОТЧЕТ", "АЛЬЯНС", "СИСТЕМA", "ОТПРАВЛЕННЫЕ", "ИЗБРАННОЕ",
        "Прочесть и забрать все", "Племенная деревня", "KİŞİSEL", "RAPOR", "İTTİFAK", "SİSTEM",
        "GÖNDERİLEN", "FAVORİLER", "Hepsini Topla", "Kabile Köyü", "CÁ NHÂN", "BÁO CÁO",
        "LIÊN MINH", "HỆ THỐNG", "ĐÃ GỬI", "MỤC YÊU THÍCH", "Thu thập tất cả", "Đọc tất cả",
        "Ngôi làng bộ lạc", "PRIBADI", "LAPORAN", "ALIANSI", "SISTEM", "TERKIRIM", "FAVORIT",
        "Klaim Semua", "Baca Semua", "Desa Suku", "ส่วนตัว", "รายงาน", "พันธมิตร", "ระบบ",
        "ส่งแล้ว", "รายการโปรด", "อ่านและรับทั้งหมด", "หมู่บ้านชนเผ่า", "شخصي", "تقرير", "تحالف",
        "نظام", "مرسلة", "مفضلة", "قراءة والمطالبة بالكل", "المطالبة بالكل", "قرية قبلية",
    ],
    "ui_blacklist": [
        "Pessoal", "Relatório", "Aliança", "Sistema", "Enviado", "Favoritos", "Ordenar",
        "Categoria", "Explora", "Batalha", "Vitoria", "Derrota", "Tropas", "Dano", "Recebido",
        "Abates", "Personal", "Report", "Alliance", "System", "Sent", "Favorites", "Sort",
        "Category", "Exploration", "Battle", "Victory", "Defeat", "Troops", "Damage", "Taken",
        "Kills", "Healed", "个人", "战报", "联盟", "系统", "已发送", "收藏", "分类", "排序", "探索", "战斗", "胜利", "失败",
        "部隊", "擊殺", "重傷", "個人", "報告", "同盟", "システム", "送信済", "お気に入り", "並べ替え", "カテゴリ", "探索", "戦闘",
        "勝利", "敗北", "개인", "리포트", "연맹", "시스템", "보낸 편지", "즐겨찾기", "정렬", "카테고리", "탐색", "전투", "승리", "패배",
        "Личные", "Отчет", "Альянс", "Система", "Отправленные", "Избранное", "Сорт.", "Категория",
        "Разведка", "Битва", "Победа", "Поражение", "Sortieren", "Kategorie", "Erkundung", "Sieg",
        "Niederlage", "Trier", "Catégorie", "Exploration", "Victoire", "Défaite", "Ordenar",
        "Categoría", "Exploración", "Victoria", "Derrota", "Sırala", "Kategori", "Keşif", "Zafer",
        "Yenilgi", "Sắp xếp", "Danh mục", "Thăm dò", "Chiến thắng", "Thất bại", "Urutkan",
        "Kategori", "Jelajah", "Kemenangan", "Kekalahan", "จัดเรียง", "หมวดหมู่", "สำรวจ", "ชนะ",
        "พ่ายแพ้", "فرز", "فئة", "استكشاف", "نصر", "هزيمة",
    ],
    "npc": [
        "Barbaro", "Bárbaro", "Barbarian", "野蛮人", "Barbare", "Bárbaros", "野蠻人", "Barbar", "Barbaro",
        "Barbarlar", "Varvara", "Варвар", "야만인", "Người man rợ", "คนเถื่อน", "البربر",
    ],
    "pve_terms": [
        "Restante", "Poder", "Invasores", "Chefes", "Vago", "Mensagem",
    ],
}
# Report label lists in rule priority, with the block type each one gives.
METRIC_LISTS: list[tuple[str, str]] = [
    ("units", "UnitsLabel"), ("dead", "DeadLabel"), ("severely_wounded", "SevereWoundedLabel"),
    ("slightly_wounded", "SlightlyWoundedLabel"), ("remaining", "RemainingLabel"),
    ("healed", "HealedLabel"), ("watchtower", "WatchtowerLabel"), ("kill_points", "KillPointsLabel"),
]

# The order in which label words are deleted from a metric text.
METRIC_STRIP_ORDER: list[str] = [name for name, _ in METRIC_LISTS]

# Titled items (title, unit value, item id).
TITLED_ITEMS: list[tuple[str, int, str]] = [
    ("Emergency Action Point Recovery", 50, "AP_50"),
    ("Basic Action Point Recovery", 100, "AP_100"),
    ("Intermediate Action Point Recovery", 500, "AP_500"),
    ("Advanced Action Point Recovery", 1000, "AP_1000"),
]

# Grid items (unit value, item id, colours it may have).
GRID_ITEMS: list[tuple[int, str, list[str]]] = [
    (100, "XP_100", ["Blue", "Purple"]),
    (500, "XP_500", ["Blue", "Purple"]),
    (1000, "XP_1000", ["Purple", "Blue"]),
    (5000, "XP_5000", ["Purple", "Blue"]),
    (10000, "XP_10000", ["Gold", "Purple", "Blue"]),
    (20000, "XP_20000", ["Gold", "Blue"]),
    (50000, "XP_50000", ["Gold", "Blue"]),
]

# Colour names in tie order, each with inclusive (h, s, v) ranges, hue 0-179.
COLOR_RANGES: list[tuple[str, tuple[int, int, int], tuple[int, int, int]]] = [
    ("Red", (0, 70, 50), (10, 255, 255)),
    ("Red", (170, 70, 50), (180, 255, 255)),
    ("Gold", (15, 70, 70), (35, 255, 255)),
    ("Green", (36, 50, 50), (85, 255, 255)),
    ("Blue", (86, 60, 60), (125, 255, 255)),
    ("Purple", (126, 60, 60), (165, 255, 255)),
]
COLOR_ORDER: list[str] = ["Red", "Gold", "Green", "Blue", "Purple"]


@dataclass(frozen=True)
class Vocabulary:
    """The word lists and item tables one deployment uses."""

    keywords: dict[str, list[str]] = field(default_factory=lambda: KEYWORDS)
    titled_items: list[tuple[str, int, str]] = field(default_factory=lambda: TITLED_ITEMS)
    grid_items: list[tuple[int, str, list[str]]] = field(default_factory=lambda: GRID_ITEMS)

    def words(self, *names: str) -> list[str]:
        """Lists joined in order; duplicates are kept, so positions stay those of the lists."""
        return [word for name in names for word in self.keywords[name]]


DEFAULT = Vocabulary()

# The lists whose words mark a profile block as user interface.
PROFILE_UI_LISTS = ("ui_keywords", "status_labels", "governor_labels", "alliance_labels", "power_labels")
