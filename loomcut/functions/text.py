"""String, path and record-conversion expressions."""

from __future__ import annotations

import html
import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_int(x: Column) -> Column:
    """Whole number of x, cut towards zero; bad input raises under ANSI mode."""
    return x.cast("double").cast("long")


def to_float(x: Column) -> Column:
    return x.cast("double")


def to_str(x: Column, none_value: str = "") -> Column:
    return F.coalesce(x.cast("string"), F.lit(none_value))


def to_list(x: Column) -> Column:
    return F.array(x)


def to_absolute(path: Column, base: str) -> Column:
    """path under base; an absolute path wins."""
    if not base:
        return path
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def relative(path: Column, root: str) -> Column:
    """path within root; the base name where root is the file itself."""
    below = F.when(path.startswith(root.rstrip("/") + "/"), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)
    return F.when(path == root, basename(path)).otherwise(below)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased part after the last dot; the whole where there is none."""
    return F.lower(F.substring_index(path, ".", -1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def strip_suffixes(name: Column, suffixes: list[str]) -> Column:
    """name without the longest of the suffixes that it has."""
    return F.regexp_replace(name, f"(?i)({'|'.join(re.escape(s) for s in sorted(suffixes, key=len, reverse=True))})$", "")


def route(key: Column, routes: list[tuple[tuple[str, ...] | None, Callable[[Column], Column]]], value: Column) -> Column:
    """The first route whose keys hold key, None for all; no match raises."""
    out = F.raise_error(F.concat(F.lit("no route for "), F.coalesce(key, F.lit("null"))))
    for keys, apply in reversed(routes):
        out = apply(value) if keys is None else F.when(key.isin(*keys), apply(value)).otherwise(out)
    return out


def compose(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """One expression after another."""
    def run(x: Column) -> Column:
        for s in steps:
            x = s(x)
        return x

    return run


def natural_key(name: Column) -> Column:
    """An array that sorts names as people do: runs of digits by value, all else by character."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, r"^0+(?=\d)", ""), 20, "0")).otherwise(p))


def whitespace_clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def html_unescape_twice(x):
    return x.map(lambda t: None if t is None else html.unescape(html.unescape(t)).strip())


def canonicalize(x: Column, keep: str | None = None) -> Column:
    """Underscores as spaces, without ASCII punctuation (but for the exact string keep), lower case, white space collapsed."""
    x = F.replace(x, F.lit("_"), F.lit(" "))
    marks = "[" + re.escape(string.punctuation) + "]"
    if keep:
        x = F.array_join(F.transform(F.split(x, re.escape(keep)), lambda p: F.regexp_replace(p, marks, "")), keep)
    else:
        x = F.regexp_replace(x, marks, "")
    return whitespace_clean(F.lower(x))


def clean(x: Column, mode: str | None) -> Column:
    modes = {None: lambda c: c, "whitespace": whitespace_clean, "lower": lambda c: F.lower(whitespace_clean(c)), "canonicalize": canonicalize}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; known: {sorted(map(str, modes))}")
    return modes[mode](x)


def split_last(x: Column, mark: str = ":") -> tuple[Column, Column]:
    """What stands before and after the last mark."""
    pattern = f"^(.*){re.escape(mark)}([^{re.escape(mark)}]*)$"
    return F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)


def audio_codes(x: Column, most: int = 63999) -> Column:
    """Numbers of <|audio_code_N|> marks, held within 0 and most."""
    found = F.regexp_extract_all(x, F.lit(r"<\|audio_code_(\d+)\|>"), F.lit(1))
    return F.transform(found, lambda c: F.greatest(F.lit(0), F.least(c.cast("long"), F.lit(most))))


def parse_override(text: str) -> tuple[str, str, int | float | str] | None:
    """name.param=value; None where it is malformed."""
    m = re.fullmatch(r"([^.=]+)\.([^=]+)=(.*)", text, re.S)
    if not m:
        return None
    value: int | float | str = m[3]
    if re.fullmatch(r"-?\d+", m[3]):
        value = int(m[3])
    else:
        try:
            value = float(m[3])
        except ValueError:
            pass
    return m[1], m[2], value
