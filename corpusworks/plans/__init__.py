"""Registered queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ["text_queries", "check_queries", "construct_queries", "corpus_queries", "index_queries", "stream_queries"]


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"corpusworks.plans.{module}")


def all_queries() -> dict:
    from corpusworks.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    from corpusworks.plans.registry import SQL

    _load()
    return dict(SQL)
