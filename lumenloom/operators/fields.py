"""Fourier sums over fields of complex values held as rows (field_id, y, x, re)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import clamp, lit
from lumenloom.functions.optics import dequantize, gaussian_amplitude, quantize


def _angle(u: Column, v: Column, size: int) -> Column:
    return lit(2 * math.pi) * (u * F.col("x") / lit(size) + v * F.col("y") / lit(size))


def sample(fields: DataFrame, at: list[tuple[float, float]], size: int = 8) -> DataFrame:
    """The Fourier sum of each field at fractional frequencies: field_id, k, re, im.

    The frequencies are parameters; a field's values aggregate before the shuffle, one row for each
    field and frequency.
    """
    points = F.array(*[F.struct(F.lit(k).alias("k"), lit(u).alias("u"), lit(v).alias("v")) for k, (u, v) in enumerate(at)])
    rows = fields.select("*", F.explode(points).alias("p"))
    angle = _angle(F.col("p.u"), F.col("p.v"), size)
    return rows.groupBy("field_id", F.col("p.k").alias("k")).agg(F.sum(F.col("re") * F.cos(angle)).alias("re"), (-F.sum(F.col("re") * F.sin(angle))).alias("im"))


def transform(fields: DataFrame, size: int = 8, inverse: bool = False) -> DataFrame:
    """The full transform in two passes, rows then columns: field_id, v, u, re, im.

    Each pass turns a value into `size` contributions and sums them: 2 size^3 terms for a field
    instead of size^4. Without a column im the field is real; the inverse divides by size^2.
    """
    n, sign = F.sequence(F.lit(0), F.lit(size - 1)), -1 if inverse else 1

    def one_pass(df: DataFrame, keep: list[str], at: str, to: str) -> DataFrame:
        a = lit(sign * 2 * math.pi) * ((F.col(to) * F.col(at)) % size) / lit(size)
        re = F.sum(F.col("re") * F.cos(a) + F.col("im") * F.sin(a))
        im = F.sum(F.col("im") * F.cos(a) - F.col("re") * F.sin(a))
        return df.select("*", F.explode(n).alias(to)).groupBy(*keep, to).agg(re.alias("re"), im.alias("im"))

    given = fields if "im" in fields.columns else fields.withColumn("im", lit(0))
    found = one_pass(one_pass(given.select("field_id", "y", "x", "re", "im"), ["field_id", "y"], "x", "u"), ["field_id", "u"], "y", "v")
    scale = lit(size * size if inverse else 1)
    return found.select("field_id", "v", "u", (F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im"))


def shifted(spectrum: DataFrame, size: int = 8) -> DataFrame:
    """Power with the zero order in the middle."""
    at = lambda c: F.pmod(F.col(c) + size // 2, F.lit(size))
    return spectrum.select("field_id", at("v").alias("py"), at("u").alias("px"), (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def summary(power: DataFrame, size: int = 8) -> DataFrame:
    """Per field: peak, mean, place of the first peak, zero order, peak over mean."""
    index = F.col("py") * size + F.col("px")
    middle = size // 2 * size + size // 2
    peak = F.max(F.struct(F.floor(F.col("power") * lit(1e6) + lit(0.5)).alias("power"), (-index).alias("minus")))
    found = power.groupBy("field_id").agg(F.max("power").alias("peak"), F.avg("power").alias("mean"), (-peak["minus"]).cast("int").alias("peak_at"), F.max(F.when(index == middle, F.col("power"))).alias("zero_order"))
    return found.withColumn("peak_over_mean", F.when(F.col("mean") > 0, F.try_divide("peak", "mean")).otherwise(lit(0)))


def ghost(power: DataFrame, targets: list[tuple[int, int]], size: int = 8, radius: float = 1.5) -> DataFrame:
    """Per field the largest power farther than radius (periodic) from every target."""

    def gap(c: str, t: int) -> Column:
        d = F.abs(F.col(c) - F.lit(t))
        return F.least(d, F.lit(size) - d)

    clear = F.lit(True)
    for ty, tx in targets:
        clear = clear & (gap("py", ty) * gap("py", ty) + gap("px", tx) * gap("px", tx) > lit(radius * radius))
    return power.where(clear).groupBy("field_id").agg(F.max("power").alias("ghost"))


def adjoint_phase(samples: DataFrame, at: list[tuple[float, float]], size: int = 8) -> DataFrame:
    """Phase of the back-projected samples at every pixel: field_id, y, x, re, im."""
    n = F.sequence(F.lit(0), F.lit(size - 1))
    where = F.array(*[F.struct(lit(u).alias("u"), lit(v).alias("v")) for u, v in at])
    rows = samples.withColumn("p", F.get(where, F.col("k"))).withColumn("y", F.explode(n)).withColumn("x", F.explode(n))
    a = _angle(F.col("p.u"), F.col("p.v"), size)
    re = F.sum(F.col("re") * F.cos(a) - F.col("im") * F.sin(a))
    im = F.sum(F.col("re") * F.sin(a) + F.col("im") * F.cos(a))
    return rows.groupBy("field_id", "y", "x").agg(re.alias("re"), im.alias("im"))


def spatial(fields: DataFrame, size: int = 8, inner: int = 6, beam: float = 6.0) -> DataFrame:
    """A lit modulator: codes of the field's values as phases, a Gaussian amplitude, and darkness outside
    the `inner` pixels in the middle: field_id, y, x, re, im."""
    low = (size - inner) // 2
    phase = dequantize(quantize(clamp(F.col("re") * lit(10), lit(-3), lit(3))))
    middle = lit((size - 1) / 2)
    amplitude = gaussian_amplitude((F.col("x") - middle) * (F.col("x") - middle) + (F.col("y") - middle) * (F.col("y") - middle), lit(beam))
    inside = F.col("y").between(low, low + inner - 1) & F.col("x").between(low, low + inner - 1)
    lit_up = fields.select("field_id", "y", "x", F.when(inside, amplitude).otherwise(lit(0)).alias("a"), phase.alias("p"))
    return lit_up.select("field_id", "y", "x", (F.col("a") * F.cos("p")).alias("re"), (F.col("a") * F.sin("p")).alias("im"))


def crop(fields: DataFrame, height: int, width: int, rows: int, columns: int) -> DataFrame:
    """The window of rows x columns in the middle, counted from its own corner."""
    y0, x0 = (height - rows) // 2, (width - columns) // 2
    inside = F.col("y").between(y0, y0 + rows - 1) & F.col("x").between(x0, x0 + columns - 1)
    return fields.where(inside).withColumn("y", (F.col("y") - y0).cast("int")).withColumn("x", (F.col("x") - x0).cast("int"))


def over_peak(power: DataFrame) -> DataFrame:
    """Adds the intensity over the peak of its field; 0 where all is dark."""
    peak = power.groupBy("field_id").agg(F.max("power").alias("peak"))
    return power.join(peak, "field_id").withColumn("intensity", F.when(F.col("peak") > 0, F.try_divide("power", "peak")).otherwise(lit(0)))


def continuous_metrics(both: DataFrame, bright: float = 0.1, accept: float = 0.25) -> DataFrame:
    """both: field_id, measured, desired, inside. Metrics over the signal window with the least-squares
    scale of the whole field; efficiency is the power inside over all power."""
    totals = both.groupBy("field_id").agg(F.sum(F.col("desired") * F.col("desired")).alias("dd"), F.sum(F.col("desired") * F.col("measured")).alias("dm"), F.sum("measured").alias("total"), F.sum(F.when(F.col("inside"), F.col("measured")).otherwise(lit(0))).alias("signal"))
    scale = F.when(F.col("dd") > lit(1e-20), F.try_divide("dm", "dd")).otherwise(lit(1))
    rows = both.where("inside").join(totals.select("field_id", "total", "signal", scale.alias("scale")), "field_id").withColumn("expected", F.col("scale") * F.col("desired"))
    off = F.col("measured") - F.col("expected")
    share = F.when(F.col("desired") >= lit(bright), F.col("measured") / F.greatest("expected", lit(1e-12)))
    found = rows.groupBy("field_id").agg(
        F.sqrt(F.sum(off * off) / F.greatest(F.sum(F.col("expected") * F.col("expected")), lit(1e-20))).alias("rmse"),
        F.coalesce(F.nanvl(F.corr("desired", "measured"), lit(0)), lit(0)).alias("correlation"),
        F.max("signal").alias("signal"), F.max("total").alias("total"), F.avg(share).alias("mean"), F.stddev_pop(share).alias("std"),
    )
    efficiency = F.when(F.col("total") > 0, F.try_divide("signal", "total")).otherwise(lit(0))
    outside = F.when(F.col("total") > 0, F.greatest(lit(0), F.col("total") - F.col("signal")) / F.col("total")).otherwise(lit(1))
    speckle = F.when(F.col("mean") > 0, F.try_divide("std", "mean")).otherwise(lit(0))
    return found.select("field_id", "rmse", "correlation", efficiency.alias("efficiency"), outside.alias("outside"), speckle.alias("speckle"), (F.col("rmse") <= lit(accept)).alias("accepted"))


def bilinear(points: DataFrame, key: list[str], raster: DataFrame, width: int, height: int, image: list[str] | None = None) -> DataFrame:
    """(*key, value): rasters (*image, py, px, level) at fractional places fx, fy, clamped to their edges;
    missing pixels are 0. The four neighbours meet their pixels by an equi-join, so an image may be as
    large as a table."""
    image = image or []
    fx, fy = (F.least(lit(size - 1), F.greatest(lit(0), F.col(c))) for c, size in (("fx", width), ("fy", height)))
    x0, y0 = F.floor(fx).cast("int"), F.floor(fy).cast("int")
    corners = F.array(*[F.struct(F.least(F.lit(width - 1), x0 + i).alias("px"), F.least(F.lit(height - 1), y0 + j).alias("py"), ((fx - x0 if i else lit(1) - (fx - x0)) * (fy - y0 if j else lit(1) - (fy - y0))).alias("w")) for i in (0, 1) for j in (0, 1)])
    kept = list(dict.fromkeys(key + image))
    near = points.select(*kept, F.explode(corners).alias("c")).where("c.w > 0").select(*kept, "c.*").join(raster, [*image, "py", "px"], "left")
    return near.groupBy(*key).agg(F.sum(F.col("w") * F.coalesce("level", F.lit(0))).alias("value"))


def target_grid(images: DataFrame, size: tuple[int, int], grid: tuple[int, int], view: float, extent: tuple[float, float], middle: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """The wanted light of every image on a transform's grid: one row for each place of its region, the
    mask of the signal. Sizes are (width, height).

    images: (image_id, py, px, level), missing pixels are dark. An image of `extent` about `middle` (y up)
    in a view of `view` covers the nearest whole number of places, at least one; their centres are read
    bilinearly. `sy`, `sx` have the zero order in the middle, `y`, `x` in the corner; `value` is the level
    over the peak of its image, `amplitude` its root. An image that is dark everywhere has no target and
    is left out; a region that leaves the grid is an error.
    """
    places = [max(1, min(n, math.floor(e / view * n + 0.5))) for n, e in zip(grid, extent)]
    centre = (grid[0] / 2 + middle[0] / view * grid[0], grid[1] / 2 - middle[1] / view * grid[1])
    corner = [math.floor(c - n / 2 + 0.5) for c, n in zip(centre, places)]
    if any(c < 0 or c + p > n for c, p, n in zip(corner, places, grid)):
        raise ValueError("the image extends beyond the grid")
    found = images.groupBy("image_id").agg(F.max("level").alias("top")).where("top > 0")
    at = lambda c, k: (F.col(c) + lit(0.5)) / lit(places[k]) * lit(size[k]) - lit(0.5)
    region = found.withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(places[1] - 1)))).withColumn("lx", F.explode(F.sequence(F.lit(0), F.lit(places[0] - 1))))
    read = bilinear(region.withColumn("fx", at("lx", 0)).withColumn("fy", at("ly", 1)), ["image_id", "top", "ly", "lx"], images, *size, image=["image_id"])
    value = F.col("value") / F.col("top").cast("double")
    sy, sx = F.col("ly") + corner[1], F.col("lx") + corner[0]
    return read.select("image_id", sy.alias("sy"), sx.alias("sx"), ((sy + grid[1] // 2) % grid[1]).alias("y"), ((sx + grid[0] // 2) % grid[0]).alias("x"), value.alias("value"), F.sqrt(value).alias("amplitude"))


def adjoint_scatter(points: DataFrame, value: str) -> DataFrame:
    """As joins.scatter with each weight over the sum of the point's squared weights: (cy, cx, total)."""
    x0, y0 = F.floor("x").cast("long"), F.floor("y").cast("long")
    fx, fy = F.col("x") - x0, F.col("y") - y0
    weights = [((i, j), (fx if i else lit(1) - fx) * (fy if j else lit(1) - fy)) for j in (0, 1) for i in (0, 1)]
    square = sum((w * w for _, w in weights), lit(0))
    cells = F.array(*[F.struct((y0 + j).alias("cy"), (x0 + i).alias("cx"), (F.col(value) * w / square).alias("part")) for (i, j), w in weights])
    return points.select(F.explode(cells).alias("c")).groupBy("c.cy", "c.cx").agg(F.sum("c.part").alias("total"))
