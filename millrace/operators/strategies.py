"""Orders, samples and scorers by name, and a place for further ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rewards, text
from ..functions.keys import seeded_order
from . import records

#: (df, group, key, seed) -> df with a rising ``position``.
Order = Callable[[DataFrame, str, str, int], DataFrame]
#: (df) -> the score of each row, from the columns that the scorer names.
Scorer = Callable[[], Column]


def _as_is(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    return records.ranked(df, [key], "position")


def _random(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
    return records.ranked(df.withColumn("__o", seeded_order(seed, F.col(key))), ["__o", key], "position").drop("__o")


def _spread(kind: str) -> Order:
    def order(df: DataFrame, group: str, key: str, seed: int) -> DataFrame:
        spread = records.interleave(df.withColumn("__o", seeded_order(seed, F.col(key))), group, ["__o", key], kind)
        out = records.ranked(spread, ["slot", "group_order", key], "position")
        return out.drop("__o", "slot", "group_order", "group_rank", "group_size")

    return order


ORDERS: dict[str, Order] = {"none": _as_is, "random": _random, "even": _spread("even"), "round_robin": _spread("round_robin")}
SCORERS: dict[str, Scorer] = {
    "answered": lambda: rewards.field(F.col("completion"), "INPUT_VECTOR").isNotNull().cast("double"),
    "repetition": lambda: text.repetition(text.tokens(F.col("completion"))),
    "length": lambda: text.token_count(F.col("completion")).cast("double"),
}


def _named(table: dict, name: str):
    if name not in table:
        raise ValueError(f"no {name}; there are {', '.join(sorted(table))}")
    return table[name]


def ordered(df: DataFrame, name: str, group: str, key: str, seed: int = 0) -> DataFrame:
    """``df`` with the position of each row in the named order."""
    return _named(ORDERS, name)(df, group, key, seed)


def scored(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with the named scores; scorers read the columns they need, here ``completion``."""
    return df.withColumns({n: _named(SCORERS, n)() for n in names})


def register(table: dict, name: str, entry) -> None:
    """Adds an order or a scorer; an error if the name is taken."""
    if name in table:
        raise ValueError(f"{name} is there already")
    table[name] = entry
