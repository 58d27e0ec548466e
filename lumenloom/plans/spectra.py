"""Transforms at full size, and what frames carry on."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit
from lumenloom.operators import order, transforms
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6, r9
from lumenloom.plans.views import table, with_views
from lumenloom.streaming import carry

#: The grid that a frame of 1272 x 1024 is transformed on.
WIDTH, HEIGHT = 2048, 1024


@query("""WITH s AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_acctbal / 1e4 AS re FROM customer), n AS (SELECT count(*) AS n FROM s), k AS (SELECT i AS k FROM s)
    SELECT k, floor(sum(re * cos(2e0 * pi() * ((k * i) % n) / n)) / any_value(n) * 1e9 + 5e-1) / 1e9 AS re, floor(-sum(re * sin(2e0 * pi() * ((k * i) % n) / n)) / any_value(n) * 1e9 + 5e-1) / 1e9 AS im FROM s, k, n GROUP BY k""")
def num_01_signal_transform(spark, sf_dir):
    """The balances of all customers as one signal, of whatever length: every coefficient over the length."""
    numbered = order.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"], "i")
    n = numbered.count()
    signal = numbered.select(F.lit(0).cast("long").alias("field_id"), "i", (F.col("c_acctbal").cast("double") / lit(10000)).alias("re"))
    found = transforms.signal_transform(signal, max(1, n))
    return found.select("k", r9(F.col("re") / n).alias("re"), r9(F.col("im") / n).alias("im"))


@query("""WITH p AS (SELECT user_id // 64 AS field_id, event_id * 17 % 1024 AS y, event_id * 31 % 1272 AS x, sum(event_id % 7 + 1) AS v FROM events GROUP BY 1, 2, 3),
    c AS (SELECT a.field_id, (b.y - a.y + 1024) % 1024 AS dy, (b.x - a.x + 2048) % 2048 AS dx, sum(a.v * b.v) AS s FROM p a JOIN p b ON a.field_id = b.field_id GROUP BY 1, 2, 3)
    SELECT field_id, dy, count(*) AS n_lags, CAST(sum(s) AS BIGINT) AS total, CAST(max(s) AS BIGINT) AS top FROM c GROUP BY field_id, dy""")
def num_02_frame_correlation(spark, sf_dir):
    """Periodic correlation of pictures on the grid of 2048 x 1024, by a transform there and back; what each
    line of lags holds. The SQL multiplies pairs of places instead."""
    found = transforms.correlation(transforms.lines(views.pictures(spark, sf_dir)), WIDTH, HEIGHT, least=0.5)
    lags = F.transform("re", lambda v: F.floor(v + lit(0.5)))
    some = found.select("field_id", F.col("line").alias("dy"), lags.alias("lags")).where(F.size("lags") > 0)
    return some.select("field_id", "dy", F.size("lags").cast("long").alias("n_lags"), F.aggregate("lags", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.array_max("lags").alias("top"))


WRAPPED = lambda v: f"(CASE WHEN ({v}) + pi() - 2e0 * pi() * floor((({v}) + pi()) / (2e0 * pi())) <= 0 THEN pi() ELSE ({v}) - 2e0 * pi() * floor((({v}) + pi()) / (2e0 * pi())) END)"


@query(
    with_views("frames").replace("WITH ", "WITH RECURSIVE ", 1)
    + f""", f AS (SELECT trap_id // 16 AS sequence_id, trap_id, frame, phase, 1e0 + (event_id % 5 - 2) / 1e1 AS gain, max(event_id) OVER (PARTITION BY trap_id // 16, frame) % 6 <> 0 AS accepted FROM frames),
    p AS (SELECT sequence_id, frame, CAST(coalesce(sum(CAST(a AS INTEGER)) OVER (PARTITION BY sequence_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place FROM (SELECT sequence_id, frame, bool_or(accepted) AS a FROM f GROUP BY 1, 2)),
    r AS (SELECT f.*, place, l.locked FROM f JOIN p USING (sequence_id, frame), (VALUES (TRUE), (FALSE)) AS l(locked)), g AS (SELECT * FROM r WHERE accepted),
    s AS (SELECT g.locked, g.sequence_id, g.trap_id, g.place, g.phase AS target, g.phase AS synthesis, g.gain AS weight FROM g LEFT JOIN g AS h ON h.locked = g.locked AND h.sequence_id = g.sequence_id AND h.trap_id = g.trap_id AND h.place = g.place - 1 WHERE h.trap_id IS NULL
    UNION ALL SELECT locked, sequence_id, trap_id, place, t, {WRAPPED('synthesis + ' + WRAPPED('t - target'))}, weight * gain FROM (SELECT g.*, s.target, s.synthesis, s.weight, CASE WHEN g.locked THEN s.target ELSE g.phase END AS t FROM s JOIN g ON g.locked = s.locked AND g.sequence_id = s.sequence_id AND g.trap_id = s.trap_id AND g.place = s.place + 1)),
    b AS (SELECT r.locked, r.sequence_id, r.trap_id, r.frame, s.synthesis, s.target AS was, s.weight, CASE WHEN r.locked THEN coalesce(s.target, r.phase) ELSE r.phase END AS t FROM r LEFT JOIN s ON s.locked = r.locked AND s.sequence_id = r.sequence_id AND s.trap_id = r.trap_id AND s.place = r.place - 1)
    SELECT locked, sequence_id, trap_id, frame, {R('t')} AS target, {R('CASE WHEN synthesis IS NULL THEN t ELSE ' + WRAPPED('synthesis + ' + WRAPPED('t - was')) + ' END')} AS synthesis, {R('coalesce(weight, 1e0)')} AS weight FROM b"""
)
def stm_01_carried_state(spark, sf_dir):
    """What each trap takes over from the last accepted frame of its sequence, here of 16 users, with locked
    and with free target phases. The SQL goes from place to place."""
    f = sequences_of(views.trap_frames(spark, sf_dir))
    both = [carry.carried(f, locked).withColumn("locked", F.lit(locked)) for locked in (True, False)]
    return both[0].unionByName(both[1]).select("locked", "sequence_id", "trap_id", "frame", r6("target").alias("target"), r6("synthesis").alias("synthesis"), r6("weight").alias("weight"))


def sequences_of(frames):
    """Trap frames as sequences of 16 traps, with gains, verdicts and places."""
    group = F.floor(F.col("trap_id") / 16).cast("long")
    rows = frames.select(group.alias("sequence_id"), F.col("trap_id").cast("long").alias("trap_id"), "frame", "phase", (lit(1) + (F.col("event_id") % 5 - 2) / lit(10)).alias("gain"), "event_id")
    judged = rows.groupBy("sequence_id", "frame").agg((F.max("event_id") % 6 != 0).alias("accepted"))
    before = F.sum(F.col("accepted").cast("long")).over(W.partitionBy("sequence_id").orderBy("frame").rowsBetween(W.unboundedPreceding, -1))
    return rows.drop("event_id").join(judged.withColumn("place", F.coalesce(before, F.lit(0).cast("long"))), ["sequence_id", "frame"])
