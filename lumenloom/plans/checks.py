"""Domain checks of requests and configurations, and the gates of samples.

A check is one condition; a row tells the names of all that it fails. Conditions are texts that both
engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.functions import geometry
from lumenloom.functions.numeric import lit
from lumenloom.operators import validate
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.views import table, with_views

PLANNER = {
    "minimumSeparationUm": "separation > 0", "kSigma": "sigma >= 0", "geometricMarginUm": "margin >= 0", "duplicatePointPolicy": "policy IN ('reject', 'merge')",
    "gridResolutionUm": "grid > 0", "planningTickUs": "tick > 0 AND tick = floor(tick)", "maxSearchTicks": "ticks > 0 AND ticks = floor(ticks)",
}
PLANNER_SQL = "SELECT p_partkey AS id, p_size % 7 - 1e0 AS separation, p_size % 5 - 1e0 AS sigma, p_size % 3 * 1e0 AS margin, CASE p_partkey % 4 WHEN 0 THEN 'reject' WHEN 1 THEN 'merge' WHEN 2 THEN 'drop' END AS policy, p_retailprice - 95e1 AS grid, p_size / 2e0 AS tick, p_partkey % 6 * 1e0 AS ticks FROM part"
ASSIGNMENT = {
    "distanceWeight": "weight > 0", "obstacleWeight": "obstacle >= 0", "stayToleranceUm": "stay >= 0", "maxAssignmentRetries": "retries + 1 > 0 AND retries = floor(retries)",
    "extraAtomPolicy": "extra IN ('KEEP', 'PARK', 'PARK_AND_RELEASE', 'RELEASE_IN_PLACE')", "groupMismatchPolicy": "mismatch IN ('forbid', 'penalize')",
}
ASSIGNMENT_SQL = "SELECT c_custkey AS id, c_custkey % 5 * 1e0 AS weight, c_acctbal AS obstacle, c_custkey % 9 - 2e0 AS stay, c_custkey % 4 / 2e0 - 1e0 AS retries, CASE c_custkey % 6 WHEN 0 THEN 'KEEP' WHEN 1 THEN 'PARK' WHEN 2 THEN 'PARK_AND_RELEASE' WHEN 3 THEN 'RELEASE_IN_PLACE' WHEN 4 THEN 'DROP' END AS extra, CASE WHEN c_custkey % 3 = 0 THEN 'forbid' WHEN c_custkey % 3 = 1 THEN 'penalize' ELSE c_mktsegment END AS mismatch FROM customer"
MOTION = {
    "framePeriodUs": "period > 0 AND period = floor(period)", "preMoveDwellUs": "dwell >= 0 AND dwell = floor(dwell)", "maxVelocityUmPerUs": "velocity > 0",
    "maxPositionChangePerFrameUm": "step > 0", "defaultTrapIntensity": "intensity >= 0", "maxValidationDepth": "depth > 0 AND depth = floor(depth)",
}
MOTION_SQL = "SELECT o_orderkey AS id, o_orderkey % 8 / 2e0 AS period, o_orderkey % 5 - 1e0 AS dwell, o_totalprice - 1e3 AS velocity, CASE WHEN o_orderkey % 3 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE o_orderkey % 7 - 1e0 END AS step, o_orderkey % 11 - 1e0 AS intensity, o_orderkey % 4 * 1e0 AS depth FROM orders"
HOLOGRAM = {
    "width": "width > 0 AND width = floor(width)", "format": "format IN ('UINT8', 'UINT16')", "gamma": "gamma > 0", "minWeight": "low > 0", "maxWeight": "high >= low AND high > 0",
    "targetPhaseMode": "mode IN ('REFERENCE_WGS', 'PHASE_LOCKED_WGS', 'SOFT_PHASE_LOCKED_WGS', 'PHASE_INTERPOLATED_WGS')", "gates": "gate IS NULL OR gate >= 0",
}
HOLOGRAM_SQL = "SELECT s_suppkey AS id, s_suppkey % 4 * 1e0 AS width, CASE s_suppkey % 3 WHEN 0 THEN 'UINT8' WHEN 1 THEN 'UINT16' ELSE 'FLOAT' END AS format, s_acctbal AS gamma, s_nationkey - 1e0 AS low, 12e0 - s_nationkey AS high, CASE s_suppkey % 5 WHEN 0 THEN 'REFERENCE_WGS' WHEN 1 THEN 'PHASE_LOCKED_WGS' WHEN 2 THEN 'SOFT_PHASE_LOCKED_WGS' WHEN 3 THEN 'PHASE_INTERPOLATED_WGS' ELSE 'FREE' END AS mode, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 - 1e0 END AS gate FROM supplier"
CALIBRATION = {
    "activeWidth": "aw > 0 AND aw = floor(aw)", "fftWidth": "fw IS NULL OR fw >= aw", "fftHeight": "(fw IS NULL) = (fh IS NULL)", "arrays": "n = aw * 4",
    "negative": "least_value >= 0", "phaseSign": "sgn IN (1, -1)", "checksum": "checksum IS NULL OR checksum = wanted",
}
CALIBRATION_SQL = "SELECT vec_id AS id, vec_id % 17 * 1e0 AS aw, CASE WHEN vec_id % 3 > 0 THEN vec_id % 23 * 1e0 END AS fw, CASE WHEN vec_id % 4 > 0 THEN 9e0 END AS fh, {size} AS n, vec_id % 6 - 1e0 AS least_value, vec_id % 3 - 1 AS sgn, CASE WHEN vec_id % 2 = 0 THEN vec_id % 10 END AS checksum, vec_id % 4 AS wanted FROM embeddings"


def _failing(checks: dict[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN coalesce({ok}, FALSE) THEN NULL ELSE '{name}' END" for name, ok in checks.items())
    return f"SELECT id, array_to_string(list_filter([{cases}], lambda c: c IS NOT NULL), ',') AS failed"


def _failed(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    names = F.array(*[F.when(~F.coalesce(F.expr(ok), F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.select("id", F.array_join(F.array_compact(names), ",").alias("failed"))


def _given(spark, sf_dir: str, sql: str) -> DataFrame:
    """The configurations that a table's rows stand for."""
    columns, source = sql.removeprefix("SELECT ").rsplit(" FROM ", 1)
    return table(spark, sf_dir, source).selectExpr(*_columns(columns))


def _columns(text: str) -> list[str]:
    found, depth, begin, quoted = [], 0, 0, False
    for at, c in enumerate(text):
        quoted ^= c == "'"
        depth += (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            found.append(text[begin:at])
            begin = at + 1
    return [*found, text[begin:]]


@query(_failing(PLANNER) + f" FROM ({PLANNER_SQL})")
def prj_10_planner_checks(spark, sf_dir):
    return _failed(_given(spark, sf_dir, PLANNER_SQL), PLANNER)


@query(_failing(ASSIGNMENT) + f" FROM ({ASSIGNMENT_SQL})")
def prj_11_assignment_checks(spark, sf_dir):
    return _failed(_given(spark, sf_dir, ASSIGNMENT_SQL), ASSIGNMENT)


@query(_failing(MOTION) + f" FROM ({MOTION_SQL})")
def prj_12_motion_checks(spark, sf_dir):
    """Of the limits for each frame, infinity is allowed."""
    return _failed(_given(spark, sf_dir, MOTION_SQL), MOTION)


@query(_failing(HOLOGRAM) + f" FROM ({HOLOGRAM_SQL})")
def prj_13_hologram_checks(spark, sf_dir):
    return _failed(_given(spark, sf_dir, HOLOGRAM_SQL), HOLOGRAM)


@query(_failing(CALIBRATION) + f" FROM ({CALIBRATION_SQL.format(size='len(embedding)')})")
def prj_15_calibration_checks(spark, sf_dir):
    """Dimensions, array lengths, signs and checksums of calibrations."""
    return _failed(_given(spark, sf_dir, CALIBRATION_SQL.format(size="size(embedding)")), CALIBRATION)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'request' WHEN c_nationkey % 3 = 0 THEN 'named' WHEN o_orderkey % 5 = 0 THEN 'config' WHEN o_orderkey % 7 < 3 THEN 'synthetic' END AS source,
    CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN c_nationkey % 3 = 0 THEN c_acctbal WHEN o_orderkey % 5 = 0 THEN 1e0 WHEN o_orderkey % 7 < 3 THEN 0e0 END AS value,
    CASE WHEN NOT (o_orderkey % 2 = 0 OR coalesce(c_nationkey % 3 = 0, FALSE) OR o_orderkey % 5 = 0 OR o_orderkey % 7 < 3) THEN 'CALIBRATION_MISMATCH' END AS error FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def prj_14_calibrations(spark, sf_dir):
    """The calibration of a request: its own, else the one that it names, else the compiler's, else a
    synthetic one where simulation is allowed, else an error."""
    o = table(spark, sf_dir, "orders")
    named = table(spark, sf_dir, "customer").where(F.col("c_nationkey") % 3 == 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("named"))
    key = F.col("o_orderkey")
    options = [("request", F.when(key % 2 == 0, F.col("o_totalprice"))), ("named", F.col("named")), ("config", F.when(key % 5 == 0, lit(1))), ("synthetic", F.when(key % 7 < 3, lit(0)))]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in options])
    found = o.join(named, "o_custkey", "left").select(key.alias("id"), source.alias("source"), F.coalesce(*[v for _, v in options]).alias("value"))
    return found.withColumn("error", F.when(F.col("source").isNull(), "CALIBRATION_MISMATCH"))


@query(with_views("points") + """ SELECT point_id, sqrt((x - 3e2) ** 2 + (y - 4e1) ** 2) <= 5e1 + 1e0 OR (x BETWEEN 1e1 AND 2e2 AND y BETWEEN 1e1 AND 3e1) OR sqrt(greatest(1e1 - x, x - 2e2, 0e0) ** 2 + greatest(1e1 - y, y - 3e1, 0e0) ** 2) <= 2e0 AS forbidden,
    ((x - 3e2) / 4e1) ** 2 + ((y - 4e1) / 2e1) ** 2 <= 1 AS in_zero_order, (x - 1e2) ** 2 + (y - 5e1) ** 2 > 9e2 AS kept, NOT (x BETWEEN 0e0 AND 6e2 AND y BETWEEN 0e0 AND 2e1) AS parking_outside FROM points""")
def prj_09_places(spark, sf_dir):
    """Targets in a region, points in the zero-order ellipse, points that an eraser leaves, parking sites
    outside the field."""
    x, y = F.col("x"), F.col("y")
    at = (x, y)
    box = geometry.in_box(at, (lit(10), lit(10)), (lit(200), lit(30)), lit(2))
    square = lambda v, c, r: F.pow((v - lit(c)) / lit(r), 2)
    return views.points(spark, sf_dir).select(
        "point_id",
        (geometry.in_circle(at, (lit(300), lit(40)), lit(50), lit(1)) | box).alias("forbidden"),
        (square(x, 300, 40) + square(y, 40, 20) <= 1).alias("in_zero_order"),
        (square(x, 100, 1) + square(y, 50, 1) > 900).alias("kept"),
        (~(x.between(0, 600) & y.between(0, 20))).alias("parking_outside"),
    )


SAMPLES = """WITH s AS (SELECT doc_id AS id, list_transform(range(0, CAST(doc_id % 6 AS BIGINT)), lambda i: (doc_id + i * (doc_id % 3)) % 9) AS traps, doc_id % 5 AS told, (doc_id % 100) / 1e1 - 5e0 AS phase, doc_id % 7 <> 0 AS converged, CASE doc_id % 4 WHEN 0 THEN ['ZERO_TARGET_OUTPUT'] WHEN 1 THEN ['SLOW'] ELSE [] END AS flags FROM documents)"""


@query(SAMPLES + """ SELECT id, len(list_distinct(traps)) = len(traps) AS unique_traps, len(traps) = told AS count_ok, phase BETWEEN -pi() - 2e-5 AND pi() + 2e-5 AS phase_ok, len(list_intersect(flags, ['ZERO_TARGET_OUTPUT', 'NUMERIC_ERROR'])) = 0 AS flags_ok,
    CASE WHEN len(traps) <> told THEN 'TRAP_COUNT' WHEN len(list_distinct(traps)) <> len(traps) THEN 'DUPLICATE_TRAP' WHEN NOT phase BETWEEN -pi() - 2e-5 AND pi() + 2e-5 THEN 'PHASE' WHEN NOT converged THEN 'NOT_CONVERGED' WHEN len(list_intersect(flags, ['ZERO_TARGET_OUTPUT', 'NUMERIC_ERROR'])) > 0 THEN 'FLAGGED' END AS rejection FROM s""")
def prj_19_sample_gates(spark, sf_dir):
    """What makes a sample acceptable, and the first reason to reject it."""
    k = F.col("doc_id")
    traps = F.transform(F.when(k % 6 > 0, F.sequence(F.lit(0).cast("long"), k % 6 - 1)).otherwise(F.array().cast("array<long>")), lambda i: (k + i * (k % 3)) % 9)
    flags = F.when(k % 4 == 0, F.array(F.lit("ZERO_TARGET_OUTPUT"))).when(k % 4 == 1, F.array(F.lit("SLOW"))).otherwise(F.array().cast("array<string>"))
    s = table(spark, sf_dir, "documents").select(k.alias("id"), traps.alias("traps"), (k % 5).alias("told"), ((k % 100) / lit(10) - lit(5)).alias("phase"), (k % 7 != 0).alias("converged"), flags.alias("flags"))
    gates = validate.sample_gates()
    return s.select("id", *[ok.alias(name) for name, (_, ok) in gates.items() if name != "converged_ok"], validate.first_rejection(gates).alias("rejection"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 1000 END AS atom_id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 1000 END, c_custkey) AS atom, coalesce(CASE WHEN c_custkey % 4 > 0 THEN c_nationkey END, 0) AS grp, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 2 = 0 END, TRUE) AS movable,
    coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END, 1e0) AS intensity, coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END, 1e0) >= 0 AS ok FROM customer""")
def prj_02_atom_defaults(spark, sf_dir):
    """Missing fields of atoms get their defaults: the place as id, group 0, movable, intensity 1."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(key % 3 != 0, key % 1000).alias("atom_id"), F.when(key % 4 > 0, F.col("c_nationkey")).alias("grp"), F.when(key % 5 > 0, key % 2 == 0).alias("movable"), F.when(key % 7 > 0, F.col("c_acctbal")).alias("intensity"))
    filled = validate.with_defaults(rows.withColumn("atom", F.coalesce("atom_id", "id")), {"grp": 0, "movable": True, "intensity": 1.0})
    return filled.select("id", "atom_id", "atom", "grp", "movable", "intensity", (F.col("intensity") >= 0).alias("ok"))


@query("SELECT n_nationkey AS site_id, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey % 2 = 0 END, TRUE) AS required, coalesce(CASE WHEN n_nationkey % 4 = 1 THEN n_regionkey END, -1) AS required_group, coalesce(CASE WHEN n_nationkey % 5 > 1 THEN n_nationkey / 1e1 END, 1e0) AS final_intensity FROM nation")
def prj_03_target_defaults(spark, sf_dir):
    key = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(key.alias("site_id"), F.when(key % 3 > 0, key % 2 == 0).alias("required"), F.when(key % 4 == 1, F.col("n_regionkey")).alias("required_group"), F.when(key % 5 > 1, key / lit(10)).alias("final_intensity"))
    return validate.with_defaults(rows, {"required": True, "required_group": -1, "final_intensity": 1.0})


@query("SELECT s_suppkey AS trap_id, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 70 END, -1) AS atom_id, s_suppkey % 3 > 0 AND s_suppkey % 70 IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AS claimed FROM supplier")
def join_08_claimed_ids(spark, sf_dir):
    """Static traps whose atom id (-1 if none) is already an atom's."""
    key = F.col("s_suppkey")
    traps = validate.with_defaults(table(spark, sf_dir, "supplier").select(key.alias("trap_id"), F.when(key % 3 > 0, key % 70).alias("atom_id")), {"atom_id": -1})
    atoms = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("atom_id")).distinct()
    taken = traps.where("atom_id <> -1").join(atoms, "atom_id", "left_semi").select("trap_id", F.lit(True).alias("claimed"))
    return traps.join(taken, "trap_id", "left").select("trap_id", "atom_id", F.coalesce("claimed", F.lit(False)).alias("claimed"))


@query("""WITH want AS (SELECT p_partkey AS site FROM part WHERE p_size % 2 = 0), got AS (SELECT l_partkey AS site, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
    SELECT site, 'MISSING' AS problem FROM want WHERE site NOT IN (SELECT site FROM got) UNION ALL SELECT site, 'TWICE' FROM got WHERE n > 1""")
def set_06_assigned_sites(spark, sf_dir):
    """Required sites without an atom, and sites with several."""
    want = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("site"))
    got = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("site")).agg(F.count("*").alias("n"))
    return want.join(got, "site", "left_anti").select("site", F.lit("MISSING").alias("problem")).unionByName(got.where("n > 1").select("site", F.lit("TWICE").alias("problem")))


@query("""WITH disk AS (SELECT DISTINCT 'shard-' || o_orderkey % 500 AS file FROM orders), listed AS (SELECT 'shard-' || c_custkey AS file, c_custkey % 5 = 0 AS partial FROM customer WHERE c_custkey % 3 > 0)
    SELECT file, 'UNEXPECTED' AS problem FROM disk WHERE file NOT IN (SELECT file FROM listed) UNION ALL SELECT file, 'ABSENT' FROM listed WHERE file NOT IN (SELECT file FROM disk) UNION ALL SELECT file, 'PARTIAL' FROM listed WHERE partial AND file IN (SELECT file FROM disk)""")
def set_07_shard_files(spark, sf_dir):
    """Files of shards that no manifest lists, listed ones that are absent, and unfinished ones to resume."""
    disk = table(spark, sf_dir, "orders").select(F.concat(F.lit("shard-"), (F.col("o_orderkey") % 500).cast("string")).alias("file")).distinct()
    listed = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.concat(F.lit("shard-"), F.col("c_custkey").cast("string")).alias("file"), (F.col("c_custkey") % 5 == 0).alias("partial"))
    both = disk.withColumn("there", F.lit(True)).join(listed.withColumn("known", F.lit(True)), "file", "full_outer")
    problem = F.when(F.col("known").isNull(), "UNEXPECTED").when(F.col("there").isNull(), "ABSENT").when(F.col("partial"), "PARTIAL")
    return both.select("file", problem.alias("problem")).where("problem is not null")


@query("SELECT c_nationkey AS run, count(*) AS requested, count(*) FILTER (WHERE c_acctbal > 0) AS accepted, count(*) = count(*) FILTER (WHERE c_acctbal > 0) AS complete, " + R("count(*) FILTER (WHERE c_acctbal > 0) / (1e0 + c_nationkey)") + " AS rate, " + R("CASE WHEN count(*) FILTER (WHERE c_acctbal > 0) > 0 THEN (count(*) - count(*) FILTER (WHERE c_acctbal > 0)) * (1e0 + c_nationkey) / count(*) FILTER (WHERE c_acctbal > 0) END") + " AS remaining_s FROM customer GROUP BY c_nationkey")
def agg_31_progress(spark, sf_dir):
    """Accepted and requested samples of a run, whether it is complete, its rate and what is left."""
    good, all_, seconds = F.count_if(F.col("c_acctbal") > 0), F.count("*"), lit(1) + F.col("c_nationkey")
    found = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(all_.alias("requested"), good.alias("accepted"))
    left = F.when(F.col("accepted") > 0, (F.col("requested") - F.col("accepted")) * seconds / F.col("accepted"))
    return found.select(F.col("c_nationkey").alias("run"), "requested", "accepted", (F.col("requested") == F.col("accepted")).alias("complete"), r6(F.col("accepted") / seconds).alias("rate"), r6(left).alias("remaining_s"))


@query("SELECT p_partkey, CASE WHEN p_size >= 16 AND p_size <= 2048 THEN p_size END AS extent, p_size > 0 AND (p_size & (p_size - 1)) = 0 AS power_of_two, p_size <= 32 AND p_partkey % 64 <= 32 AS frame_fits, p_size BETWEEN 1 AND 200 AND (p_size % 11) / 1e1 > 0 AND (p_size % 11) / 1e1 <= 1 AS field_ok FROM part")
def prj_24_solver_inputs(spark, sf_dir):
    """Dimensions that a transform, a frame and a field may have."""
    n = F.col("p_size")
    mixing = (n % 11) / lit(10)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(n.between(16, 2048), n).alias("extent"), ((n > 0) & (n.bitwiseAND(n - 1) == 0)).alias("power_of_two"), ((n <= 32) & (F.col("p_partkey") % 64 <= 32)).alias("frame_fits"), (n.between(1, 200) & (mixing > 0) & (mixing <= 1)).alias("field_ok"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 4 <> 0 AS finite FROM events")
def prj_21_finite_numbers(spark, sf_dir):
    """Whether all numbers of a nested metrics text are finite."""
    k = F.get_json_object("props", "$.k").cast("long")
    odd = F.when(k % 4 == 0, F.lit("NaN")).otherwise(k.cast("string"))
    text = F.concat(F.lit('{"a": 1, "b": [2, {"c": '), odd, F.lit('}], "d": {"e": [-0.5, 1e3]}}'))
    return table(spark, sf_dir, "events").select("event_id", validate.all_finite(text).alias("finite"))
