"""Scalar values of the block language, and the registries behind USING and COMPUTE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def duration(col: Column) -> Column:
    """'24h', '30s', '5m', '7d' as an interval; anything else is null."""
    number = F.regexp_extract(col, r"^([0-9]+)([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(col, r"^([0-9]+)([smhd])$", 2)
    zero = F.lit(0)
    return (
        F.when(unit == "s", F.make_dt_interval(zero, zero, zero, number))
        .when(unit == "m", F.make_dt_interval(zero, zero, number))
        .when(unit == "h", F.make_dt_interval(zero, number))
        .when(unit == "d", F.make_dt_interval(number))
    )


def duration_seconds(col: Column) -> Column:
    number = F.regexp_extract(col, r"^([0-9]+)([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(col, r"^([0-9]+)([smhd])$", 2)
    return number * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def length_of(col: Column, is_array: bool = False) -> Column:
    return F.size(col) if is_array else F.length(col)


def clamp(col: Column, low, high) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def safe_ratio(part: Column, whole: Column) -> Column:
    """Null instead of an error when the whole is zero."""
    return F.try_divide(part, whole)


def extract_domain(col: Column) -> Column:
    """Host of an address or e-mail."""
    host = F.regexp_extract(col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.when(host != "", host).otherwise(F.substring_index(col, "@", -1)))


def cache_key(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "trim": F.trim,
    "lower": F.lower,
    "upper": F.upper,
    "title_case": F.initcap,
    "length": F.length,
    "extract_domain": extract_domain,
    "hash": lambda c: F.sha2(c, 256),
    "md5": F.md5,
    "round": lambda c: F.round(c, 2),
    "abs": F.abs,
}

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "COUNT": F.count,
    "COUNT_DISTINCT": F.countDistinct,
    "SUM": F.sum,
    "AVG": F.avg,
    "MEAN": F.avg,
    "MIN": F.min,
    "MAX": F.max,
}


def register_transform(name: str, fn: Callable[[Column], Column]) -> None:
    """Make a column function, or a pandas_udf, available to transform(… using=name)."""
    TRANSFORMS[name] = fn


def register_vectorised(name: str, fn: Callable[[pa.Array], pa.Array], returns: str) -> None:
    """Make a function over whole Arrow arrays available to transform(… using=name).

    ``fn`` gets each batch of a column once and gives as many values of the type ``returns``. It runs in a node of
    its own above the filters that stand before it, so rows that are filtered out never reach Python.
    """
    TRANSFORMS[name] = F.arrow_udf(fn, returns)


@dataclass(frozen=True)
class Mergeable:
    """An aggregate with a state of its own: a list of numbers of bounded length.

    ``partial`` makes it from some values (nulls left out), ``merge`` from two states, in any order; ``finish`` gives
    the result.
    """

    partial: Callable[[np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]


MERGEABLES: dict[str, Mergeable] = {}


def register_mergeable(name: str, aggregate: Mergeable) -> None:
    """Make an aggregate with its own state available to aggregate_merging(…)."""
    MERGEABLES[name.upper()] = aggregate


def register_aggregate(name: str, fn: Callable[[Column], Column]) -> None:
    """Make an aggregate available to aggregate(…); names are not case-sensitive."""
    AGGREGATES[name.upper()] = fn
