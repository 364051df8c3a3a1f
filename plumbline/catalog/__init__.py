"""Named queries over the benchmark tables, each beside the SQL that must give the same answer."""

from . import (cleaning, descriptive, growth, inference, ingest, keywords, people, presets,
               profiling, quality, relations, scopes, templates, temporal, validation)

MODULES = (scopes, descriptive, temporal, relations, inference, people, growth, profiling, quality,
           validation, cleaning, ingest, keywords, presets, templates)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.book.items()}


def all_oracles() -> dict:
    return {name: sql for m in MODULES for name, (_, sql) in m.book.items() if sql}
