"""Filter cascades: filters in a fixed order, cheap ones first, each on the survivors of those before."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Filter:
    """passes: an expression over scored columns and parameters; scores: further columns; scorer: a function of pandas batches for what needs Python."""

    name: str
    passes: Callable[[dict], Column]
    defaults: dict = field(default_factory=dict)
    scores: Callable[[dict], dict[str, Column]] | None = None
    scorer: Callable[[pd.DataFrame, dict], pd.DataFrame] | None = None
    schema: str = ""


def duration_resolution(duration: Column, width: Column, height: Column, least: float = 10.0, aspect: float = 2.5) -> Column:
    """Long enough, not too wide, not portrait; no height fails as endlessly wide."""
    ratio = F.when(height <= 0, float("inf")).otherwise(F.try_divide(width.cast("double"), height.cast("double")))
    return (duration >= least) & (ratio <= aspect) & (width >= height)


def no_border(top: Column, bottom: Column, left: Column, right: Column, width: Column, height: Column, least: float = 0.02) -> Column:
    """No edge has a border of a share of the frame's shorter side, or of a pixel; an unknown border or size passes nothing."""
    limit = F.greatest(F.lit(1), F.floor(F.least(width, height) * least))
    known = [c.isNotNull() for c in (top, bottom, left, right, width, height)]
    return reduce(Column.__and__, known) & (F.greatest(top, bottom, left, right) < limit)


def jitter(magnitudes: Column) -> Column:
    """Population deviation over mean of an array of flow magnitudes."""
    n = F.size(magnitudes)
    mean = F.aggregate(magnitudes, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(magnitudes, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return F.when(n > 0, F.sqrt(var) / (mean + 1e-8))


def text_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Area of boxes (x1, y1, x2, y2) over the frame's, at most 1."""
    area = F.aggregate(boxes, F.lit(0.0), lambda s, b: s + F.greatest(F.lit(0.0), b["x2"] - b["x1"]) * F.greatest(F.lit(0.0), b["y2"] - b["y1"]))
    return F.least(F.lit(1.0), F.try_divide(area, (width * height).cast("double")))


REGISTRY: dict[str, Filter] = {
    "duration_resolution": Filter("duration_resolution", lambda p: duration_resolution(F.col("duration"), F.col("width"), F.col("height"), p["min_duration"], p["max_aspect"]), {"min_duration": 10.0, "max_aspect": 2.5}, lambda p: {"duration_sec": F.col("duration"), "aspect_ratio": F.try_divide(F.col("width").cast("double"), F.col("height").cast("double"))}),
    "black_border": Filter("black_border", lambda p: no_border(*[F.col(f"border_{s}") for s in ("top", "bottom", "left", "right")], F.col("width"), F.col("height"), p["min_border_fraction"]), {"min_border_fraction": 0.02}),
    "overexposure": Filter("overexposure", lambda p: (F.col("overexposed_fraction") <= p["max_over"]) & (F.col("underexposed_fraction") <= p["max_under"]), {"max_over": 0.05, "max_under": 0.05}),
    "blur": Filter("blur", lambda p: F.col("blur_score") >= p["min_score"], {"min_score": 50.0}),
    "motion_stability": Filter("motion_stability", lambda p: (F.col("jitter_score") <= p["max_jitter"]) & (F.col("flow_coherence") >= p["min_coherence"]), {"max_jitter": 1.2, "min_coherence": 0.2}),
    "text": Filter("text", lambda p: F.col("text_coverage") <= p["max_coverage"], {"max_coverage": 0.1}),
    "aesthetic": Filter("aesthetic", lambda p: F.col("aesthetic_score") >= p["min_score"], {"min_score": 4.5}),
    "nsfw": Filter("nsfw", lambda p: F.col("nsfw_max_score") <= p["max_score"], {"max_score": 0.2}),
    "motion": Filter("motion", lambda p: (F.col("motion_score") >= p["min_motion"]) & (F.col("motion_jitter_score") <= p["max_jitter"]), {"min_motion": 2.0, "max_jitter": 1.0}),
}
#: Registered, not part of the default order.
OPTIONAL: dict[str, Filter] = {"watermark": Filter("watermark", lambda p: F.col("watermark_score") <= p["max_score"], {"max_score": 0.5})}


def run(df: DataFrame, filters: list[Filter | str], overrides: dict[str, dict] | None = None) -> DataFrame:
    """df with filter_<name>_pass for each filter (null where an earlier one failed), filter_<name>_error, and filter_pass.

    A filter with a scorer runs in a stage of its own behind mapInPandas, over the rows that passed all before it; the optimiser would otherwise
    run every Python filter on every row. An exception in a scorer fails the row, with its text as the error.
    """
    alive, done = df, []
    known = REGISTRY | OPTIONAL
    for f in filters:
        if isinstance(f, str):
            if f not in known:
                raise ValueError(f"unknown filter {f!r}; known: {', '.join(sorted(known))}")
            f = known[f]
        p = f.defaults | (overrides or {}).get(f.name, {})
        error = F.lit(None).cast("string")
        if f.scorer:
            alive = _score(alive, f, p)
            error = F.col(f"filter_{f.name}_error")
        for c, expr in (f.scores(p) if f.scores else {}).items():
            alive = alive.withColumn(f"filter_{f.name}_{c}", expr)
        passed = F.coalesce(f.passes(p), F.lit(False)) & error.isNull()
        alive = alive.withColumns({f"filter_{f.name}_pass": passed, f"filter_{f.name}_error": error})
        done.append(alive.where(~F.col(f"filter_{f.name}_pass")).withColumn("filter_pass", F.lit(False)))
        alive = alive.where(F.col(f"filter_{f.name}_pass"))
    out = alive.withColumn("filter_pass", F.lit(True))
    for part in done:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _score(df: DataFrame, f: Filter, p: dict) -> DataFrame:
    names = df.columns
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names) + f", {f.schema}, filter_{f.name}_error string"
    added = [c.strip().split()[0] for c in f.schema.split(",")]

    def score(batches):
        for batch in batches:
            try:
                out = f.scorer(batch, p)[added].assign(**{f"filter_{f.name}_error": None})
            except Exception:  # find the rows that fail
                rows = []
                for i in range(len(batch)):
                    try:
                        rows.append(f.scorer(batch.iloc[i : i + 1], p)[added].assign(**{f"filter_{f.name}_error": None}))
                    except Exception as e:
                        rows.append(pd.DataFrame({**{c: [None] for c in added}, f"filter_{f.name}_error": [f"{type(e).__name__}: {e}"]}))
                out = pd.concat(rows, ignore_index=True)
                _log.warning("%s: a batch of %d rows failed and was scored row by row; %d rows failed", f.name, len(batch), int(out[f"filter_{f.name}_error"].notna().sum()))
            yield pd.concat([batch.reset_index(drop=True), out.reset_index(drop=True)], axis=1)

    return df.mapInPandas(score, schema)


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """Rows (stage, n_in, n_out, kept_pct) of filters in this order, each counted among those that passed all before, in one pass over df."""
    alive, counts = F.lit(True), []
    for i, (_, passed) in enumerate(stages):
        after = alive & F.coalesce(passed, F.lit(False))
        counts += [F.count_if(alive).alias(f"in_{i}"), F.count_if(after).alias(f"out_{i}")]
        alive = after
    rows = F.array(*[F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(f"in_{i}").alias("n_in"), F.col(f"out_{i}").alias("n_out")) for i, (n, _) in enumerate(stages)])
    out = df.agg(*counts).select(F.inline(rows))
    return out.withColumn("kept_pct", F.floor(100 * F.col("n_out") / F.greatest("n_in", F.lit(1))))
