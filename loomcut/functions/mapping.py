"""Operators over columns of records: maps by column and by type, nested casts, repeats, gates, templates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text

Step = Callable[[Column], Column]


def identity(x: Column) -> Column:
    return x


def each(step: Step) -> Step:
    """A step for every element of a list."""
    return lambda x: F.transform(x, step)


def by_type(x: Column, routes: list[tuple[tuple[str, ...] | None, Step]]) -> Column:
    """A VARIANT through the step of the first route that names its type (string, number, boolean, list, map, null); None stands for any; no match raises."""
    name = F.schema_of_variant(x)
    kind = F.when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "map").when(name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "number").when(name == "VOID", "null").otherwise(F.lower(name))
    out = F.raise_error(F.concat(F.lit("no route for type "), kind))
    for types, step in reversed(routes):
        out = step(x) if types is None else F.when(kind.isin(*types), step(x)).otherwise(out)
    return out


def map_columns(df: DataFrame, keys: list[str], main: Step, special: dict[str, Step] | None = None) -> DataFrame:
    """df with main, or a column's special step, on each of its columns that keys name; other columns stay, also those with a special step."""
    return df.withColumns({k: (special or {}).get(k, main)(F.col(k)) for k in keys if k in df.columns})


def media_bundle(base: str, suffixes: tuple[str, ...], decode: Step) -> Step:
    """The default step for a column of media: a list is taken element by element, a name is made absolute and decoded if its suffix is known, else raised on."""
    one = text.compose(lambda x: text.to_absolute(x, base), lambda x: text.route(text.extension(x), [(suffixes, decode)], x))
    return each(one)


def repeated(df: DataFrame, times: int, order: str, most: int | None = None) -> DataFrame:
    """df as a loader with `times` passes sees it: item, counted from 0, is the row at item % n in the order of `order`; most replaces the length of n * times."""
    from ..operators.rank import share_before

    rows = share_before(df.withColumn("_one", F.lit(1).cast("long")), [order], "_one")
    n = df.count()
    length = n * times if most is None else most
    if not n:
        return df.withColumn("item", F.lit(0).cast("long"))
    passes = F.sequence(F.lit(0).cast("long"), F.lit(-(-length // n) - 1).cast("long")) if length else F.array().cast("array<long>")
    out = rows.select(*df.columns, "row", F.explode(passes).alias("_pass")).withColumn("item", (F.col("_pass") * n + F.col("row")).cast("long"))
    return out.where(F.col("item") < length).drop("row", "_pass")


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of df that a step asks for, in its order; what df lacks is null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in names])


def ends(values: Column) -> tuple[Column, Column]:
    """First and last element; null where there are none."""
    return F.try_element_at(values, F.lit(1)), F.try_element_at(values, F.lit(-1))


def cast_all(x: Column, kind: T.DataType, to: T.DataType, only: tuple[type, ...] = (T.FloatType, T.DoubleType)) -> Column:
    """x of type kind with every value of a type of `only`, however deep in lists, maps and structs, cast."""
    if isinstance(kind, only):
        return x.cast(to)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: cast_all(e, kind.elementType, to, only))
    if isinstance(kind, T.MapType):
        return F.transform_values(x, lambda _, v: cast_all(v, kind.valueType, to, only))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[cast_all(x[f.name], f.dataType, to, only).alias(f.name) for f in kind.fields]))
    return x


def schedule(prompts: Column, chunks: Column) -> Column:
    """A prompt for each chunk: a single one for all, else exactly one each; other lengths raise."""
    return F.when(F.size(prompts) == chunks, prompts).when(F.size(prompts) == 1, F.array_repeat(prompts[0], chunks)).otherwise(F.raise_error(F.lit("as many prompts as chunks, or one")))


def within(step: Column, total: int, least: float, most: float) -> Column:
    """Whether a step's share of all steps is from least on, below most."""
    return (step >= F.floor(F.lit(least * total))) & (step < F.floor(F.lit(most * total)))


def fill(template: str, **values: Column) -> Column:
    """A template's {names} replaced by columns; null counts as empty. What is put in is not looked at again."""
    import re

    parts: list[Column] = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", template)):
        parts.append(F.coalesce(values[part].cast("string"), F.lit("")) if i % 2 else F.lit(part))
    return F.concat(*parts)


def assignments(code: Column) -> Column:
    """map of `name = value` lines of code: the text on the right, trimmed, quotes taken off; the last of a name wins. Lines of other forms are passed over."""
    lines = F.filter(F.split(code, "\n"), lambda x: x.rlike(r"^\s*[A-Za-z_]\w*\s*=(?!=)"))
    one = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\s*(\w+)\s*=", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*\w+\s*=(.*?),?\s*$", 1)), r"""^(["'])(.*)\1$""", "$2").alias("value")))
    last = F.filter(one, lambda x, i: ~F.exists(F.slice(one, i + 2, F.greatest(F.size(one), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def chance(key: Column, seed: int, share: float) -> Column:
    """Whether a draw that a hash makes falls within a share; the same for the same key and seed."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long"), F.lit(1_000_000)) < round(share * 1_000_000)


def rounded(digits: int) -> Callable[[Column], Column]:
    """A double rounded as Python does, by its exact binary value; no built-in function does so, hence a pandas UDF."""

    @F.pandas_udf("double")
    def to(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v if pd.isna(v) else round(float(v), digits))

    return to
