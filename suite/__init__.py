"""Registered queries, the views they run over and the SQL they are checked against."""

from suite import inventories, profiles, reports, texts

MODULES = [profiles, reports, inventories, texts]
