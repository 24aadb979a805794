"""Conditions of the block language as Columns.

The language ranks OR below AND below NOT below comparisons, as SQL does, so Spark's own parser reads a condition
once the spellings that differ are put into SQL's: string quotes, ``==``, ``IS`` with a value, ``NOW()``, durations
and ``.length``.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

_QUOTED = re.compile(r'("(?:[^"\\]|\\.)*")')
_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY"}
_DURATION = re.compile(r"(?<![\w.])(\d+)([smhd])(?!\w)")
_LENGTH = re.compile(r"((?:[A-Za-z_]\w*\.)+)length(?!\w|\s*\()")
_IS = re.compile(r"\bIS\s+(NOT\s+)?(?!NOT\b|NULL\b|TRUE\b|FALSE\b)")


def sql_of(condition: str, lists: frozenset[str] = frozenset()) -> str:
    """The condition in Spark SQL; ``lists`` names the columns whose ``.length`` counts items, not characters."""

    def plain(part: str) -> str:
        part = re.sub(r"\bNOW\s*\(\s*\)", "current_timestamp()", part).replace("==", "=")
        part = _IS.sub(lambda m: "!= " if m[1] else "= ", part)
        part = _DURATION.sub(lambda m: f"INTERVAL '{m[1]}' {_UNITS[m[2]]}", part)
        return _LENGTH.sub(lambda m: f"{'size' if m[1][:-1] in lists else 'length'}({m[1][:-1]})", part)

    def text(part: str) -> str:
        inner = re.sub(r'\\(.)', r"\1", part[1:-1])
        return "'" + inner.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return "".join(text(p) if k % 2 else plain(p) for k, p in enumerate(_QUOTED.split(condition)))


def list_columns(df: DataFrame) -> frozenset[str]:
    return frozenset(f.name for f in df.schema.fields if isinstance(f.dataType, ArrayType | MapType))


def condition(text: str, df: DataFrame) -> Column | None:
    """The condition over the columns of ``df``; None if it is no condition over them, prose for instance."""
    try:
        column = F.expr(f"({sql_of(text, list_columns(df))})")  # in brackets, so that no word behind it names it
        kind = df.select(column.alias("c")).schema[0].dataType.simpleString()
    except (AnalysisException, ParseException):
        return None
    return column if kind == "boolean" else None
