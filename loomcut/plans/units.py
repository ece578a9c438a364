"""Units of a pipeline: steps over columns that say which they read and which they write, run in their order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unit:
    """run: from the columns that the unit reads to those it writes. sides: prefixes for which it runs one after another, as for a positive and a negative
    prompt; its reads and writes then stand for <prefix><name>, or for the plain name where there is none with the prefix."""

    name: str
    reads: tuple[str, ...]
    writes: tuple[str, ...]
    run: Callable[[dict[str, Column]], dict[str, Column]]
    sides: tuple[str, ...] = ("",)


def run_units(df: DataFrame, units: list[Unit]) -> DataFrame:
    """df with what the units write, a later one replacing what an earlier one wrote. A column that is not there, and one that a unit didn't say it writes, raise."""
    for unit in units:
        for side in unit.sides:
            there = {c: side + c if side + c in df.columns else c for c in unit.reads}
            if missing := [c for c, own in there.items() if own not in df.columns]:
                raise ValueError(f"{unit.name} reads {', '.join(missing)}, which nothing writes")
            got = unit.run({c: F.col(f"`{own}`") for c, own in there.items()})
            if odd := sorted(set(got) ^ set(unit.writes)):
                raise ValueError(f"{unit.name} and what it says it writes differ: {', '.join(odd)}")
            df = df.withColumns({side + c: x for c, x in got.items()})
    return df
