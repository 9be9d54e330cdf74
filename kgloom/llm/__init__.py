"""Operators for training-data pipelines, with their registered queries.

Nothing else in the package imports this subpackage. ``queries()`` and ``sql()`` gather what the modules register.
"""

from __future__ import annotations

import importlib

MODULES = ("suffix_dedup", "simhash", "token_counts", "mixing", "imatch", "token_output", "url_filter", "quality", "media", "bpe")


def _modules() -> list:
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for m in _modules() for name, text in m.SQL.items()}
