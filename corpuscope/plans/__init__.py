"""Queries over the given tables, each with the SQL that checks it."""

from importlib import import_module

from .catalog import ENTRIES, Entry

_MODULES = (
    "ingest",
    "verbs",
    "functions",
    "text",
    "components",
    "labels",
    "comparison",
    "streams",
)


def all_entries() -> dict[str, Entry]:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return dict(ENTRIES)
