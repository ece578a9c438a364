"""Editing open records: maps of parameters, routed, renamed and merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_prefixes(params: Column, prefixes: list[tuple[str, str]]) -> dict[str, Column]:
    """Maps by name: entries whose key has a prefix, without it, the first prefix winning; the rest as `shared`."""
    names, out = [p for p, _ in prefixes], {}
    for i, (prefix, name) in enumerate(prefixes):
        own = _filtered(params, _first_of(names, i))
        out[name] = F.transform_keys(own, _dropper(prefix))
    out["shared"] = _filtered(params, _first_of(names, len(names)))
    return out


def _first_of(names: list[str], i: int):
    """A test whether a key's first prefix is names[i]; for i past the end, whether it has none."""
    def test(k: Column, v: Column) -> Column:
        hit = k.startswith(names[i]) if i < len(names) else F.lit(True)
        for p in names[:i]:
            hit = hit & ~k.startswith(p)
        return hit

    return test


def _filtered(params: Column, test) -> Column:
    return F.map_filter(params, lambda k, v: test(k, v))


def _dropper(prefix: str):
    return lambda k, v: F.replace(k, F.lit(prefix), F.lit(""))


def strip_prefix(params: Column, prefix: str) -> Column:
    """Entries whose key has the prefix, without it; others as they are."""
    return F.transform_keys(params, lambda k, v: F.when(k.startswith(prefix), F.substr(k, F.lit(len(prefix) + 1))).otherwise(k))


def concat_by_key(df: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """(key, values): the arrays of a key one after another in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(values).alias("v"))))
    return df.groupBy(key).agg(F.flatten(F.transform(parts, lambda p: p["v"])).alias(values))


def file_pattern(x: Column) -> Column:
    """A glob for a model's files: all of it, or of a folder."""
    return F.when(x.isNull() | x.isin("", "./"), "*").when(x.endswith("/"), F.concat(x, F.lit("*"))).otherwise(x)


def adapter_target(key: Column) -> Column:
    """The layer that an adapter's key (... lora_B[.name].weight) belongs to; null for other keys."""
    parts = F.split(key, r"\.")
    side = F.when(key.contains(".lora_up."), F.lit("lora_up")).otherwise(F.lit("lora_B"))
    at = F.array_position(parts, side)
    head = F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))
    after = F.slice(parts, (at + 1).cast("int"), F.greatest(F.size(parts) - at, F.lit(0)).cast("int"))
    rest = F.when(F.size(after) >= 2, F.slice(after, F.lit(2), F.size(after) - 1)).otherwise(after)
    whole = F.concat(head, rest)
    whole = F.when(F.element_at(whole, 1) == "diffusion_model", F.slice(whole, F.lit(2), F.size(whole) - 1)).otherwise(whole)
    return F.when(at > 0, F.array_join(F.slice(whole, F.lit(1), F.size(whole) - 1), "."))
