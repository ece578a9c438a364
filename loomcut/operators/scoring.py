"""Metrics with a pluggable scorer: a model made once for each Python worker, scores as a column, and a reducer over it."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_models: dict[str, object] = {}
_log = logging.getLogger(__name__)

#: The metrics that are known by name, and what of a row each is given.
KNOWN = {
    "pickscore": "prompt and image", "image_reward": "prompt and image", "hpsv2": "prompt and image", "hpsv3": "prompt and image", "clip": "prompt and image", "bioclip": "prompt and image",
    "aesthetic": "image", "fid": "two sets of images", "lpips": "two images", "qwen_image_bench": "prompt and image", "unified_reward_2": "prompt and image", "unified_reward_edit": "instruction and two images",
}


@dataclass(frozen=True)
class Metric:
    """make: builds the model; score(model, batch): a value for each row of a pandas batch; reduce: one value of all scores."""

    name: str
    make: Callable[[], object]
    score: Callable[[object, pd.DataFrame], list]
    reduce: Callable[[Column], Column] = F.avg

    def scored(self, df: DataFrame, out: str = "score") -> DataFrame:
        """df with the score of each row; null for rows of a batch that fails row by row."""
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
        name, make, score = self.name, self.make, self.score

        def run(batches):
            if name not in _models:
                _models[name] = make()
            for pdf in batches:
                try:
                    values = list(score(_models[name], pdf))
                except Exception:
                    values = [_one(score, _models[name], pdf.iloc[i : i + 1]) for i in range(len(pdf))]
                    _log.warning("%s: a batch of %d rows failed and was scored row by row; %d rows have no score", name, len(pdf), sum(v is None for v in values))
                yield pdf.assign(**{out: values})

        return df.mapInPandas(run, schema)

    def compute(self, df: DataFrame) -> DataFrame:
        """One row (metric, value); null scores are skipped."""
        return self.scored(df, "_s").agg(self.reduce(F.col("_s")).alias("value")).select(F.lit(self.name).alias("metric"), "value")


def named(name: str, make: Callable[[], object], score: Callable[[object, pd.DataFrame], list]) -> Metric:
    """A metric that is known by name, with the model it needs; its value is the mean of its scores. Distances of sets are metrics.frechet_distances()."""
    if name not in KNOWN:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(KNOWN)}")
    if name == "fid":
        raise ValueError("fid has no score for a row; use metrics.activation_stats() and frechet_distances()")
    return Metric(name, make, score)


def _one(score, model, row: pd.DataFrame):
    try:
        return list(score(model, row))[0]
    except Exception:
        return None


def caption(videos: DataFrame, captioner: Callable[[str], str], path: str = "video_path") -> DataFrame:
    """(video_path, caption) by a pluggable captioner; null where it raises."""

    def run(batches):
        for pdf in batches:
            texts = []
            for p in pdf[path]:
                try:
                    texts.append(captioner(p))
                except Exception:
                    texts.append(None)
            yield pd.DataFrame({path: pdf[path], "caption": texts})

    return videos.select(path).mapInPandas(run, f"`{path}` string, caption string")
