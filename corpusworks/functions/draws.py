"""Repeatable draws: a number in [0, 1) from a seed and a row key, the same on every run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusworks import fixed


def draw(key: Column, seed: int | str) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def weighted_choice(key: Column, shares: list[tuple[str, float]], seed: int | str) -> Column:
    """Cumulative-weight draw; the first value also takes what rounding leaves over."""
    drawn = draw(key, seed)
    total, choice = 0.0, None
    for value, share in shares:
        total += share
        choice = F.when(drawn < total, value) if choice is None else choice.when(drawn < total, value)
    return choice.otherwise(shares[0][0])


def uniform_choice(key: Column, values: list[str], seed: int | str) -> Column:
    place = F.floor(draw(key, seed) * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def assign_category(key: Column, seed: int | str) -> Column:
    return weighted_choice(key, fixed.CATEGORY_SHARES, seed)
