"""Optics, code tables, fields and their metrics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenloom.functions import numeric, optics
from lumenloom.functions.numeric import lit
from lumenloom.operators import fields, frames
from lumenloom.plans import views
from lumenloom.plans.catalog import R, WRAP, query, r6
from lumenloom.plans.views import table, with_views

TURN = "2e0 * pi()"


@query(with_views("points") + f""", m AS (SELECT point_id, 128e0 + cos(3e-1) * x * 2e-1 - sin(3e-1) * y * 2e-1 AS fx, 128e0 - sin(3e-1) * x * 2e-1 - cos(3e-1) * y * 2e-1 AS fy, 5e-1 * x - 25e-2 * y + 3e0 AS ax FROM points)
    SELECT point_id, {R('fx')} AS fx, {R('fy')} AS fy, {R('ax')} AS ax, fx BETWEEN -5e-1 AND 2555e-1 AND fy BETWEEN -5e-1 AND 2555e-1 AS on_grid, {R('((ax % 256e0) + 256e0) % 256e0')} AS index_x, {R('(128e0 + floor(ax)) - 256e0 * floor((128e0 + floor(ax)) / 256e0)')} AS shifted FROM m""")
def sca_29_frequencies(spark, sf_dir):
    """Places in the plane as frequencies of a turned and of an affine grid, as wrapped and shifted index."""
    at = (F.col("x"), F.col("y"))
    fx, fy = optics.turned_frequency(at, (lit(128), lit(128)), lit(0.2), 0.3)
    ax = lit(0.5) * at[0] - lit(0.25) * at[1] + lit(3)
    on = fx.between(lit(-0.5), lit(255.5)) & fy.between(lit(-0.5), lit(255.5))
    return views.points(spark, sf_dir).select("point_id", r6(fx).alias("fx"), r6(fy).alias("fy"), r6(ax).alias("ax"), on.alias("on_grid"), r6(optics.wrapped_index(ax, lit(256))).alias("index_x"), r6(optics.wrapped_index(lit(128) + F.floor(ax), lit(256))).alias("shifted"))


LEVELS = (-3.0, -1.5, -1.5, 0.25, 1.0, 3.0)
LEVELS_SQL = "[-3e0, -15e-1, -15e-1, 25e-2, 1e0, 3e0]"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity * 5e0 AS code, l_discount * 6e1 - 3e0 AS phase, {LEVELS_SQL} AS t FROM lineitem), p AS (SELECT *, greatest(0e0, least(255e0, code)) / 255e0 * 5 AS pos FROM c), q AS (SELECT *, CAST(floor(pos) AS INTEGER) AS lo FROM p),
    n AS (SELECT *, t[lo + 1] + (t[least(lo + 1, 5) + 1] - t[lo + 1]) * (pos - lo) AS decoded, list_sort(list_transform(range(0, 6), lambda i: [abs(t[i + 1] - phase), i]))[1][2] AS near FROM q)
    SELECT l_orderkey, l_linenumber, {R('decoded')} AS decoded, CAST(near AS INTEGER) AS nearest, {R('near / 5e0 * 255e0')} AS code_of, {R(WRAP('decoded + phase - 5e-1'))} AS displayed, {R('code / 2e2 * 2e0 * pi()')} AS by_level FROM n""")
def sca_37_code_tables(spark, sf_dir):
    """A measured table: phase of a code, nearest entry of a phase and its code (ties to the lower), the
    displayed phase after corrections, and phases by the level of a whole turn."""
    levels = F.array(*map(lit, LEVELS))
    code, phase = F.col("l_quantity") * lit(5), F.col("l_discount") * lit(60) - lit(3)
    decoded, near = optics.table_decode(code, levels), optics.nearest_entry(phase, levels)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(decoded).alias("decoded"), near.alias("nearest"), r6(near / lit(5) * lit(255)).alias("code_of"),
        r6(numeric.wrap_phase(decoded + phase - lit(0.5))).alias("displayed"), r6(code / lit(200) * lit(2 * math.pi)).alias("by_level"),
    )


@query("""WITH s AS (SELECT p_partkey, [p_size * -1e-1, 0e0, p_size * 5e-2 + 1e0] AS t FROM part), e AS (SELECT p_partkey, t, i, i / 4095e0 * 2e0 * pi() - pi() AS phase FROM s, (SELECT unnest(range(0, 4096)) AS i)),
    d AS (SELECT p_partkey, i, abs(t[1] - phase) AS a, abs(t[2] - phase) AS b, abs(t[3] - phase) AS c FROM e), n AS (SELECT p_partkey, i, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS code FROM d)
    SELECT p_partkey, code, count(*) AS n_entries, CAST(min(i) AS INTEGER) AS first_entry, CAST(max(i) AS INTEGER) AS last_entry, CAST(sum(i) AS BIGINT) AS entry_sum FROM n GROUP BY p_partkey, code""")
def sca_40_inverse_tables(spark, sf_dir):
    """Inverse tables of 4096 entries over a turn: for every phase the first code of least distance, and
    which entries each code has."""
    table_of = F.array(F.col("p_size") * lit(-0.1), lit(0), F.col("p_size") * lit(0.05) + lit(1))
    spans = optics.nearest_spans(table_of, lambda entry: entry / lit(4095) * lit(2 * math.pi) - F.pi(), 4096)
    coded = table(spark, sf_dir, "part").select("p_partkey", F.inline(spans))
    n, first, last = F.col("last") - F.col("first") + 1, F.col("first"), F.col("last")
    return coded.select("p_partkey", F.col("index").cast("int").alias("code"), n.alias("n_entries"), first.cast("int").alias("first_entry"), last.cast("int").alias("last_entry"), F.expr("(first + last) * (last - first + 1) div 2").alias("entry_sum"))


@query(f"""SELECT p_partkey, {R('p_retailprice * (p_size + 1) / (p_size + 2e0)')} AS field_size, {R('greatest(2e0, 3e0 / (p_size % 5 + 1) * 125e-2)')} AS um_per_pixel, {R('p_size / 5e1 * 2e1 - 1e1')} AS view_x, {R('6e0 - least(1e0, p_size / 25e0) * 12e0')} AS view_y,
    CAST(floor(greatest(0e0, least(255e0, (2126e-4 * p_size + 7152e-4 * (p_size * 3 % 256) + 722e-4 * (p_size * 7 % 256)) * (p_size % 2))) + 5e-1) AS INTEGER) AS luma, {R('(p_size / 5e1) / (8e0 / 16e0)')} AS aspect,
    {R('CASE WHEN p_size / 1e1 < 15e-1 THEN 15e-1 WHEN p_size / 1e1 > 3e0 THEN 3e0 ELSE p_size / 1e1 END')} AS kept_aspect, {R('greatest(p_size / 1e3, 1e-3, 3e0 * pi() / 256e0)')} AS phase_tolerance, {R('greatest(p_size / 1e1, (p_size % 7) / 3e0)')} AS score, {R('sqrt(64e0 * p_size / (p_size % 7 + 1))')} AS target_scale FROM part""")
def sca_46_plane_sizes(spark, sf_dir):
    """Sizes of image fields, view mappings, luma, aspects, tolerances, scores and target scales."""
    n = F.col("p_size")
    luma = (lit(0.2126) * n + lit(0.7152) * (n * 3 % 256) + lit(0.0722) * (n * 7 % 256)) * (n % 2)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        r6(F.col("p_retailprice") * (n + 1) / (n + lit(2))).alias("field_size"),
        r6(F.greatest(lit(2), lit(3) / (n % 5 + 1) * lit(1.25))).alias("um_per_pixel"),
        r6(n / lit(50) * lit(20) - lit(10)).alias("view_x"),
        r6(lit(6) - F.least(lit(1), n / lit(25)) * lit(12)).alias("view_y"),
        F.floor(numeric.clamp(luma, lit(0), lit(255)) + lit(0.5)).cast("int").alias("luma"),
        r6((n / lit(50)) / (lit(8) / lit(16))).alias("aspect"),
        r6(numeric.clamp(n / lit(10), lit(1.5), lit(3))).alias("kept_aspect"),
        r6(optics.phase_tolerance(n / lit(1000), 256)).alias("phase_tolerance"),
        r6(F.greatest(n / lit(10), (n % 7) / lit(3))).alias("score"),
        r6(F.sqrt(lit(64) * n / (n % 7 + 1))).alias("target_scale"),
    )


# --- fields -----------------------------------------------------------------------------------


@query(with_views("fields") + f" SELECT field_id, y, x, {R('re')} AS re, {R('0e0')} AS im FROM fields")
def num_01_round_trip(spark, sf_dir):
    """Forward and inverse transform of every field: the field again."""
    back = fields.transform(fields.transform(views.fields(spark, sf_dir)).withColumnsRenamed({"v": "y", "u": "x"}), inverse=True)
    return back.select("field_id", F.col("v").cast("int").alias("y"), F.col("u").cast("int").alias("x"), r6("re").alias("re"), r6("im").alias("im"))


APERTURE = ", c AS (SELECT *, greatest(0e0, least(255e0, floor((greatest(-3e0, least(3e0, re * 1e1)) + pi()) / (2e0 * pi()) * 255e0 + 5e-1))) / 255e0 * 2e0 * pi() - pi() AS phase, exp(-4e0 * ((x - 35e-1) ** 2 + (y - 35e-1) ** 2) / 36e0) AS amplitude FROM fields), s AS (SELECT field_id, y, x, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN amplitude * cos(phase) ELSE 0e0 END AS re, CASE WHEN y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 THEN amplitude * sin(phase) ELSE 0e0 END AS im FROM c)"


def _aperture(spark, sf_dir):
    return fields.spatial(views.fields(spark, sf_dir), inner=6)


@query(with_views("fields") + APERTURE + f" SELECT field_id, y, x, {R('re')} AS re, {R('im')} AS im FROM s")
def num_15_spatial_field(spark, sf_dir):
    """Codes as a lit complex field inside a centred aperture, dark outside."""
    return _aperture(spark, sf_dir).select("field_id", "y", "x", r6("re").alias("re"), r6("im").alias("im"))


@query(with_views("fields") + APERTURE + f" SELECT field_id, CAST(y - 2 AS INTEGER) AS y, CAST(x - 1 AS INTEGER) AS x, {R('re')} AS re FROM s WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def num_16_active_crop(spark, sf_dir):
    return fields.crop(_aperture(spark, sf_dir), 8, 8, 4, 6).select("field_id", "y", "x", r6("re").alias("re"))


COMPLEX = ", k AS (SELECT unnest(range(0, 8)) AS k), r1 AS (SELECT field_id, y, k AS u, sum(re * cos(2e0 * pi() * (k * x % 8) / 8e0) + im * sin(2e0 * pi() * (k * x % 8) / 8e0)) AS re, sum(im * cos(2e0 * pi() * (k * x % 8) / 8e0) - re * sin(2e0 * pi() * (k * x % 8) / 8e0)) AS im FROM s, k GROUP BY field_id, y, k), sp AS (SELECT field_id, k AS v, u, sum(re * cos(2e0 * pi() * (k * y % 8) / 8e0) + im * sin(2e0 * pi() * (k * y % 8) / 8e0)) AS re, sum(im * cos(2e0 * pi() * (k * y % 8) / 8e0) - re * sin(2e0 * pi() * (k * y % 8) / 8e0)) AS im FROM r1, k GROUP BY field_id, k, u), pw AS (SELECT field_id, CAST((v + 4) % 8 AS INTEGER) AS py, CAST((u + 4) % 8 AS INTEGER) AS px, re * re + im * im AS power FROM sp)"


@query(with_views("fields") + APERTURE + COMPLEX + f" SELECT field_id, py, px, {R('power / max(power) OVER (PARTITION BY field_id)')} AS intensity FROM pw")
def num_27_forward(spark, sf_dir):
    """Intensity in the focal plane over its peak, zero order in the middle."""
    power = fields.shifted(fields.transform(_aperture(spark, sf_dir)))
    return fields.over_peak(power).select("field_id", F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px"), r6("intensity").alias("intensity"))


@query(with_views("fields") + f""", t AS (SELECT a.field_id, a.y, a.x, abs(a.re) AS measured, abs(b.re) AS desired, a.y BETWEEN 2 AND 5 AND a.x BETWEEN 1 AND 6 AS inside FROM fields a JOIN fields b ON b.field_id = a.field_id + 1 AND a.y = b.y AND a.x = b.x),
    g AS (SELECT field_id, sum(desired * measured) / sum(desired * desired) AS scale, sum(measured) AS total, sum(CASE WHEN inside THEN measured ELSE 0 END) AS signal FROM t GROUP BY field_id),
    j AS (SELECT t.*, scale, total, signal, scale * desired AS expected FROM t JOIN g USING (field_id) WHERE inside)
    SELECT field_id, {R('sqrt(sum((measured - expected) ** 2) / greatest(sum(expected ** 2), 1e-20))')} AS rmse, {R('coalesce(corr(desired, measured), 0)')} AS correlation, {R('any_value(signal) / any_value(total)')} AS efficiency, {R('(any_value(total) - any_value(signal)) / any_value(total)')} AS outside,
    {R('coalesce(stddev_pop(CASE WHEN desired >= 1e-1 THEN measured / greatest(expected, 1e-12) END) / avg(CASE WHEN desired >= 1e-1 THEN measured / greatest(expected, 1e-12) END), 0)')} AS speckle, sqrt(sum((measured - expected) ** 2) / greatest(sum(expected ** 2), 1e-20)) <= 25e-2 AS accepted FROM j GROUP BY field_id""")
def agg_24_field_metrics(spark, sf_dir):
    """A measured intensity against the wanted one, here the next field's: error, correlation, efficiency,
    power outside the signal window, speckle of its bright part."""
    f = views.fields(spark, sf_dir)
    wanted = f.select((F.col("field_id") - 1).alias("field_id"), "y", "x", F.abs("re").alias("desired"))
    both = f.select("field_id", "y", "x", F.abs("re").alias("measured")).join(wanted, ["field_id", "y", "x"])
    inside = F.col("y").between(2, 5) & F.col("x").between(1, 6)
    found = fields.continuous_metrics(both.withColumn("inside", inside))
    return found.select("field_id", *[r6(c).alias(c) for c in ("rmse", "correlation", "efficiency", "outside", "speckle")], "accepted")


@query(with_views("points", "raster") + """, p AS (SELECT point_id, (point_id * 37 % 700) / 1e1 - 2e0 AS fx, (point_id * 53 % 700) / 1e1 - 2e0 AS fy FROM points), c AS (SELECT point_id, least(63e0, greatest(0e0, fx)) AS fx, least(63e0, greatest(0e0, fy)) AS fy FROM p), q AS (SELECT *, CAST(floor(fx) AS INTEGER) AS x0, CAST(floor(fy) AS INTEGER) AS y0 FROM c),
    n AS (SELECT point_id, (CASE WHEN i = 1 THEN fx - x0 ELSE 1 - (fx - x0) END) * (CASE WHEN j = 1 THEN fy - y0 ELSE 1 - (fy - y0) END) AS w, least(63, x0 + i) AS px, least(63, y0 + j) AS py FROM q, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j))
    SELECT point_id, """ + R("sum(w * coalesce(level, 0))") + " AS value FROM n LEFT JOIN raster USING (px, py) GROUP BY point_id")
def num_12_bilinear(spark, sf_dir):
    """A raster at fractional places, edges clamped; missing pixels are 0."""
    key = F.col("point_id")
    p = views.points(spark, sf_dir).select("point_id", ((key * 37 % 700) / lit(10) - lit(2)).alias("fx"), ((key * 53 % 700) / lit(10) - lit(2)).alias("fy"))
    return fields.bilinear(p, ["point_id"], views.raster(spark, sf_dir), 64, 64).select("point_id", r6("value").alias("value"))


@query(with_views("points") + """, c AS (SELECT CAST(floor(y) AS BIGINT) + j AS cy, CAST(floor(x) AS BIGINT) + i AS cx, point_id % 10 + 1 AS v, (CASE WHEN i = 1 THEN x - floor(x) ELSE 1e0 - (x - floor(x)) END) * (CASE WHEN j = 1 THEN y - floor(y) ELSE 1e0 - (y - floor(y)) END) AS w, point_id FROM points, (VALUES (0), (1)) AS a(i), (VALUES (0), (1)) AS b(j)), s AS (SELECT point_id, sum(w * w) AS square FROM c GROUP BY point_id)
    SELECT cy, cx, floor(sum(v * w / square) * 1e5 + 5e-1 + 1e-4) / 1e5 AS total FROM c JOIN s USING (point_id) GROUP BY cy, cx""")
def num_14_adjoint_scatter(spark, sf_dir):
    """Values spread with weights over their squares' sum, so that sampling gives them back."""
    p = views.points(spark, sf_dir).withColumn("v", (F.col("point_id") % 10 + 1).cast("double"))
    return fields.adjoint_scatter(p, "v").select("cy", "cx", (F.floor(F.col("total") * lit(1e5) + lit(0.5001)) / lit(1e5)).alias("total"))


@query(f"""WITH images AS (SELECT l_suppkey // 64 AS image_id, CAST(l_suppkey % 64 AS INTEGER) AS py, CAST(l_partkey % 64 AS INTEGER) AS px, count(*) AS level FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT image_id, max(level) AS top FROM images GROUP BY image_id),
    g AS (SELECT image_id, top, CAST(i // 150 AS INTEGER) AS ly, CAST(i % 150 AS INTEGER) AS lx FROM m, (SELECT unnest(range(0, 15000)) AS i)), p AS (SELECT *, greatest(0e0, least(63e0, (lx + 5e-1) / 15e1 * 64e0 - 5e-1)) AS fx, greatest(0e0, least(63e0, (ly + 5e-1) / 1e2 * 64e0 - 5e-1)) AS fy FROM g),
    q AS (SELECT *, CAST(floor(fx) AS INTEGER) AS x0, CAST(floor(fy) AS INTEGER) AS y0 FROM p),
    v AS (SELECT q.*, (coalesce(a.level, 0) * (1 - fx + x0) + coalesce(b.level, 0) * (fx - x0)) * (1 - fy + y0) + (coalesce(c.level, 0) * (1 - fx + x0) + coalesce(d.level, 0) * (fx - x0)) * (fy - y0) AS sampled FROM q
        LEFT JOIN images a ON a.image_id = q.image_id AND a.px = x0 AND a.py = y0 LEFT JOIN images b ON b.image_id = q.image_id AND b.px = x0 + 1 AND b.py = y0
        LEFT JOIN images c ON c.image_id = q.image_id AND c.px = x0 AND c.py = y0 + 1 LEFT JOIN images d ON d.image_id = q.image_id AND d.px = x0 + 1 AND d.py = y0 + 1)
    SELECT image_id, ly + 68 AS sy, lx + 69 AS sx, (ly + 196) % 256 AS y, (lx + 197) % 256 AS x, {R('sampled / top')} AS value, {R('sqrt(sampled / top)')} AS amplitude FROM v""")
def num_29_target_grid(spark, sf_dir):
    """The wanted light of images of 64 suppliers by 64 parts on a grid of 256 x 256, every place of it."""
    found = fields.target_grid(views.images(spark, sf_dir), (64, 64), (256, 256), 256.0, (150.0, 100.0), (16.0, 10.0))
    return found.select("image_id", "sy", "sx", "y", "x", r6("value").alias("value"), r6("amplitude").alias("amplitude"))


@query(with_views("frames") + f""", g AS (SELECT frame, count(*) AS n, avg(intensity) AS mean, min(intensity) AS lo, max(abs({WRAP('phase - 25e-1 * intensity')})) AS phase_error, sum(intensity) / (sum(intensity) + count(*)) AS efficiency, max(CASE WHEN trap_id % 3 = 0 THEN intensity END) AS ghost FROM frames GROUP BY frame), l AS (SELECT *, lag(CASE WHEN mean > 0 THEN lo / mean ELSE 0 END) OVER (ORDER BY frame) AS before, CASE WHEN mean > 0 THEN lo / mean ELSE 0 END AS now FROM g)
    SELECT frame, {R('phase_error')} AS phase_error, {R('efficiency')} AS efficiency, {R('ghost')} AS ghost, {R('greatest(0e0, least(1e0, CASE WHEN before IS NULL THEN now ELSE least(now, before, now * 75e-2) END))')} AS transition_minimum, coalesce(phase_error <= 3e0 AND efficiency >= 4e-1 AND ghost <= 5e1 AND now >= 1e-4, FALSE) AS accepted FROM l""")
def agg_14_frame_gates(spark, sf_dir):
    """Phase error, efficiency, ghost and the least intensity expected in the transition of a frame; gates."""
    f = views.trap_frames(spark, sf_dir)
    found = frames.qualities(f.withColumn("wanted_phase", lit(2.5) * F.col("intensity")), code_factor=0.75)
    gated = frames.gates(found, max_phase_error=3.0, min_efficiency=0.4, max_ghost=50.0, least_share=1e-4)
    return gated.select("frame", *[r6(c).alias(c) for c in ("phase_error", "efficiency", "ghost", "transition_minimum")], F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query(with_views("fields") + """, t AS (SELECT field_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM fields WHERE re > 15e-2), c AS (SELECT DISTINCT field_id, CAST((y + i + 8) % 8 AS INTEGER) AS y, CAST((x + j + 8) % 8 AS INTEGER) AS x FROM t, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 225e-2) SELECT field_id, y, x FROM c""")
def join_31_support(spark, sf_dir):
    """The cells around a field's bright targets, periodic, each once."""
    bright = views.fields(spark, sf_dir).where(F.col("re") > lit(0.15)).select("field_id", "y", "x")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 2.25])
    near = bright.select("field_id", "y", "x", F.explode(around).alias("d"))
    return near.select("field_id", F.pmod(F.col("y") + F.col("d.i"), F.lit(8)).cast("int").alias("y"), F.pmod(F.col("x") + F.col("d.j"), F.lit(8)).cast("int").alias("x")).distinct()
