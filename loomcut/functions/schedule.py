"""Noise and learning-rate schedules in closed form, as rows or expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Least sigma (None: 1 / steps), whether the end point is left out, and the default shift of each schedule.
TEMPLATES = {
    "FLUX.1": (0.003 / 1.002, False, 3.0),
    "Wan": (0.0, True, 5.0),
    "Z-Image": (0.0, True, 3.0),
    "JoyAI-Image": (0.0, True, 4.0),
    "ERNIE-Image": (0.0, True, 3.0),
    "ACE-Step": (0.0, True, 3.0),
    "HiDream-O1-Image": (0.0, True, 3.0),
    "Qwen-Image": (0.0, True, None),
    "Qwen-Image-Lightning": (0.0, True, None),
    "FLUX.2": (None, False, None),
    "LTX-2": (0.0, True, None),
}
# Given sigmas of distilled models.
GIVEN = {
    ("LTX-2", "stage2"): [0.909375, 0.725, 0.421875],
    ("LTX-2", "ditilled_stage1"): [1.0, 0.99375, 0.9875, 0.98125, 0.975, 0.909375, 0.725, 0.421875],
    ("HiDream-O1-Image", "dev"): [t / 1000 for t in (999, 987, 974, 960, 945, 929, 913, 895, 877, 857, 836, 814, 790, 764, 737, 707, 675, 640, 602, 560, 515, 464, 409, 347, 278, 199, 110, 8)],
}


def shift(sigma: Column, by: float) -> Column:
    return by * sigma / (1 + (by - 1) * sigma)


def exp_shift(sigma: Column, mu: float) -> Column:
    return F.lit(math.exp(mu)) / (math.exp(mu) + (1 / sigma - 1))


def linear_mu(length: float, low: tuple[float, float], high: tuple[float, float]) -> float:
    """mu on the line through two (length, mu)."""
    return low[1] + (length - low[0]) * (high[1] - low[1]) / (high[0] - low[0])


def empirical_mu(length: float, steps: int) -> float:
    # Slopes and offsets of mu over the length, at 10 and 200 steps.
    at10, at200 = 8.73809524e-05 * length + 1.89833333, 0.00016927 * length + 0.45666666
    return at200 if length > 4300 else at200 + (steps - 200) * (at200 - at10) / 190


def sigmas(spark: SparkSession, template: str, steps: int, strength: float = 1.0, by: float | None = None, mu: float | None = None, length: float | None = None, case: str | None = None) -> DataFrame:
    """Rows (step, sigma, timestep) of a schedule."""
    if (template, case) in GIVEN:
        out = spark.createDataFrame([*enumerate(GIVEN[template, case])], "step long, sigma double")
        return out.withColumn("timestep", F.col("sigma") * 1000)
    least, open_end, usual = TEMPLATES[template]
    least = 1 / steps if least is None else least
    top = least + (1 - least) * strength
    sigma = top + (least - top) * F.col("id") / float(steps if open_end else max(steps - 1, 1))
    end = None
    if usual is not None:
        sigma = shift(sigma, usual if by is None else by)
    else:
        if mu is None:
            if template == "FLUX.2":
                mu = 0.8 if length is None else empirical_mu(length, steps)
            elif template == "LTX-2":
                mu = linear_mu(length or 4096, (1024, 0.95), (4096, 2.05))
            elif template == "Qwen-Image-Lightning":
                mu = 0.8 if length is None else math.log(3)
            else:
                mu = 0.8 if length is None else linear_mu(length, (256, 0.5), (8192, 0.9))
        sigma = exp_shift(sigma, mu)
        end = {"Qwen-Image": 0.02, "LTX-2": 0.1}.get(template)
    rows = spark.range(steps).select(F.col("id").alias("step"), sigma.alias("sigma"))
    if end is not None:  # stretched so that the last sigma is `end`
        last = F.max_by("sigma", "step").over(Window.partitionBy(F.lit(0)))
        rows = rows.withColumn("sigma", 1 - (1 - F.col("sigma")) * (1 - end) / (1 - last))
    return rows.withColumn("timestep", F.col("sigma") * 1000)


def training_weights(schedule: DataFrame) -> DataFrame:
    """schedule with weight: a Gaussian around the middle time step, moved to start at zero, its mean one; corrected unless there are 1000 steps."""
    whole = Window.partitionBy(F.lit(0))
    n = F.count("*").over(whole)
    y = F.exp(-2 * F.pow((F.col("timestep") - 500) / 1000, F.lit(2.0)))
    out = schedule.withColumn("weight", y).withColumn("weight", F.col("weight") - F.min("weight").over(whole))
    out = out.withColumn("weight", F.col("weight") * (1000 / F.sum("weight").over(whole)))
    return out.withColumn("weight", F.when(n == 1000, F.col("weight")).otherwise(F.col("weight") * (n / F.lit(1000.0)))).withColumn("weight", F.when(n == 1000, F.col("weight")).otherwise(F.col("weight") + F.max(F.when(F.col("step") == 1, F.col("weight"))).over(whole)))


def euler_step(sample: Column, output: Column, sigma: Column, after: Column) -> Column:
    return sample + output * (after - sigma)


def add_noise(sample: Column, noise: Column, sigma: Column) -> Column:
    return (1 - sigma) * sample + sigma * noise


def guided(positive: Column, negative: Column, scale: float) -> Column:
    return negative + scale * (positive - negative)


def ddim_alphas(spark: SparkSession, steps: int = 1000, start: float = 0.00085, end: float = 0.012, zero_terminal: bool = False) -> DataFrame:
    """Rows (t, beta, alpha_bar) of the scaled linear schedule; zero_terminal rescales so that the last is zero."""
    root = math.sqrt(start) + (math.sqrt(end) - math.sqrt(start)) * F.col("id") / float(steps - 1)
    rows = spark.range(steps).select(F.col("id").alias("t"), (root * root).alias("beta"))
    upto = Window.partitionBy(F.lit(0)).orderBy("t")
    rows = rows.withColumn("alpha_bar", F.exp(F.sum(F.log(1 - F.col("beta"))).over(upto)))
    if zero_terminal:
        whole = Window.partitionBy(F.lit(0))
        s = F.sqrt("alpha_bar")
        first, last = F.max(s).over(whole), F.min(s).over(whole)
        rows = rows.withColumn("alpha_bar", F.pow((s - last) * first / (first - last), F.lit(2.0)))
    return rows


def ddim_step(sample: Column, output: Column, alpha: Column, alpha_before: Column, kind: str = "epsilon") -> Column:
    if kind == "epsilon":
        noise = output
        clean = (sample - F.sqrt(1 - alpha) * noise) / F.sqrt(alpha)
    else:
        clean = F.sqrt(alpha) * sample - F.sqrt(1 - alpha) * output
        noise = F.sqrt(alpha) * output + F.sqrt(1 - alpha) * sample
    return F.sqrt(alpha_before) * clean + F.sqrt(1 - alpha_before) * noise


def learning_rate(step: Column, base: float, warmup: int, total: int | None = None, floor: float = 0.0) -> Column:
    """Linear warm-up, then constant, or half a cosine down to floor at total."""
    rise = F.when(step < warmup, (step + 1) / float(max(warmup, 1)))
    if total is None:
        return base * rise.otherwise(F.lit(1.0))
    done = F.least(F.lit(1.0), (step - warmup) / float(max(total - warmup, 1)))
    return base * rise.otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * done)))
