"""Rasters held as rows (py, px, level): thresholds, grid bins, spots, connected components."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators.lineage import cut
from lumenloom.operators.order import numbered


def bright(raster: DataFrame, threshold: int) -> DataFrame:
    return raster.where(F.col("level") >= threshold)


def bins(pixels: DataFrame, spacing: int, least: int) -> DataFrame:
    """Weighted centroid, area, peak and sum of every grid cell with at least `least` pixels."""
    cell = [F.floor(F.col(c) / spacing).cast("int").alias(a) for c, a in (("py", "cy"), ("px", "cx"))]
    found = pixels.groupBy(*cell).agg(F.count("*").alias("area"), F.sum("level").alias("total"), F.max("level").alias("peak"), (F.sum(F.col("px") * F.col("level")) / F.sum("level")).alias("x"), (F.sum(F.col("py") * F.col("level")) / F.sum("level")).alias("y"))
    return found.where(F.col("area") >= least)


def strongest(spots: DataFrame, k: int) -> DataFrame:
    """The k spots of largest sum, then peak, then lowest cell."""
    return spots.orderBy(F.desc("total"), F.desc("peak"), "cy", "cx").limit(k)


def components(pixels: DataFrame, width: int) -> DataFrame:
    """(py, px, level, label) with 8-connected pixels sharing the smallest pixel number as label.

    Minimum labels spread along links and jump to the label of their label, so the rounds follow the
    logarithm of the longest path; every round is written to the checkpoint folder.
    """
    rows = pixels.withColumn("pixel", F.col("py") * width + F.col("px"))
    around = F.array(*[F.struct((F.col("py") + i).alias("py"), (F.col("px") + j).alias("px")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    seen = rows.select("py", "px", F.col("pixel").alias("to"))
    links = rows.select("pixel", F.explode(around).alias("n")).select("pixel", "n.py", "n.px").join(seen, ["py", "px"]).select("pixel", "to")
    links = cut(links)
    labels = rows.select("pixel", F.col("pixel").alias("label"))
    while True:
        low = links.join(labels.withColumnRenamed("pixel", "to"), "to").groupBy("pixel").agg(F.min("label").alias("low"))
        up = low.select(F.col("pixel").alias("low"), F.col("low").alias("root"))
        jumped = low.join(up, "low").select("pixel", F.col("root").alias("label"))
        moved = cut(jumped.join(labels.withColumnRenamed("label", "was"), "pixel"))
        labels = moved.select("pixel", "label")
        if moved.where("label <> was").limit(1).count() == 0:
            return rows.join(labels, "pixel").select("py", "px", "level", "label")


def spots(labelled: DataFrame, threshold: int, least: int) -> DataFrame:
    """Per component of at least `least` pixels: centroid weighted by the excess over the threshold."""
    w = F.col("level") - threshold + 1
    found = labelled.groupBy("label").agg(F.count("*").alias("area"), F.max("level").alias("peak"), F.sum(w).alias("total"), (F.sum(F.col("px") * w) / F.sum(w)).alias("x"), (F.sum(F.col("py") * w) / F.sum(w)).alias("y"))
    return found.where(F.col("area") >= least)


def even_subsample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows spread evenly over the order: numbers floor((i + 0.5) n / k)."""
    n = df.count()
    placed = numbered(df, order)
    if n <= k:
        return placed
    wanted = df.sparkSession.range(k).select(F.floor((F.col("id") + lit(0.5)) * lit(n) / lit(k)).cast("long").alias("number"))
    return placed.join(F.broadcast(wanted), "number", "left_semi")


def image_moments(raster: DataFrame) -> DataFrame:
    """Bounds, total and correlation of level with place for a whole image."""
    return raster.agg(F.min("px").alias("x_low"), F.max("px").alias("x_high"), F.min("py").alias("y_low"), F.max("py").alias("y_high"), F.sum("level").alias("total"), F.coalesce(F.nanvl(F.corr("px", "level"), lit(0)), lit(0)).alias("tilt"))


def adaptive_bins(pixels: DataFrame, spacing: int, most: int, least: int = 1) -> DataFrame:
    """bins of the smallest tried spacing that gives at most `most` of them, with `spacing`: it grows by
    the root of the excess, at least by one."""
    while True:
        found = cut(bins(pixels, spacing, least))
        n = found.count()
        if n <= most:
            return found.withColumn("spacing", F.lit(spacing))
        spacing = max(spacing + 1, math.ceil(spacing * math.sqrt(n / most)))
