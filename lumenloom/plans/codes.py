"""Hashes, canonical texts, seeds, descriptors, payloads and strict code tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.functions import hashing
from lumenloom.functions.numeric import lit
from lumenloom.operators import order
from lumenloom.plans import views
from lumenloom.plans.catalog import R, query, r6
from lumenloom.plans.views import table, with_views
from lumenloom.sources import packed, tables

M32 = "4294967296"


def FNV(text: str) -> str:
    """fnv1a32 in SQL, for texts of the basic plane."""
    return f"list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length({text}) + 1), lambda i: unicode(substr({text}, i, 1))::HUGEINT)), lambda h, u: (xor(h, u) * 16777619) % {M32})"


def MIX(v: str) -> str:
    """mix32 in SQL."""
    a = f"((xor(({v}), ({v}) >> 16) * 2146121005::HUGEINT) % {M32})"
    b = f"((xor({a}, {a} >> 15) * 2221713035::HUGEINT) % {M32})"
    return f"xor({b}, {b} >> 16)"


@query("SELECT c_custkey, " + f"CAST({FNV('c_name')} AS BIGINT) AS hash, printf('%08x', CAST({FNV('c_name')} AS BIGINT)) AS hex FROM customer")
def sca_59_text_hashes(spark, sf_dir):
    h = hashing.fnv1a32(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", h.alias("hash"), hashing.hex32(h).alias("hex"))


JSON_TEXT = """'{"acctbal":' || CAST(floor(s_acctbal) AS BIGINT) || ',"id":' || s_suppkey || ',"name":"' || s_name || '","nation":' || coalesce(CAST(nullif(s_nationkey % 5, 0) AS VARCHAR), 'null') || '}'"""


@query(f"WITH j AS (SELECT s_suppkey, {JSON_TEXT} AS canonical FROM supplier) SELECT s_suppkey, canonical, printf('%08x', CAST({FNV('canonical')} AS BIGINT)) AS hash, sha256(canonical) AS digest FROM j")
def sca_58_canonical_json(spark, sf_dir):
    """Rows as JSON with sorted keys and no spaces, with their hashes; null fields are kept."""
    s = table(spark, sf_dir, "supplier")
    nation = F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey") % 5)
    fields = {"id": F.col("s_suppkey"), "name": F.col("s_name"), "acctbal": F.floor("s_acctbal").cast("long"), "nation": nation}
    text = tables.canonical(fields)
    rows = s.select("s_suppkey", text.alias("canonical"))
    return rows.select("s_suppkey", "canonical", hashing.hex32(hashing.fnv1a32(F.col("canonical"))).alias("hash"), F.sha2(F.col("canonical").cast("binary"), 256).alias("digest"))


@query(f"WITH p AS (SELECT CAST(c_custkey // 10 AS BIGINT) AS request, string_agg(c_custkey || ':' || CAST(floor(c_acctbal) AS BIGINT), ',' ORDER BY c_custkey) AS body FROM customer GROUP BY 1), j AS (SELECT request, '[' || body || ']' AS body FROM p) SELECT request, printf('%08x', CAST({FNV('body')} AS BIGINT)) AS input_hash FROM j")
def sca_64_input_hashes(spark, sf_dir):
    """One hash for the rows of each request, in the order of their ids."""
    c = table(spark, sf_dir, "customer")
    part = F.struct("c_custkey", F.concat_ws(":", "c_custkey", F.floor("c_acctbal").cast("long")).alias("text"))
    bodies = c.groupBy((F.col("c_custkey") / 10).cast("long").alias("request")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    body = F.concat(F.lit("["), F.array_join(F.transform("parts", lambda p: p["text"]), ","), F.lit("]"))
    return bodies.select("request", hashing.hex32(hashing.fnv1a32(body)).alias("input_hash"))


@query(f"SELECT c_custkey, {R(f'CAST({FNV(chr(39) + chr(55) + chr(58) + chr(39) + " || c_custkey")} AS DOUBLE) / 4294967295e0 * 2e0 * pi() - pi()')} AS phase, {R(f'CAST(({MIX(f"(xor(c_custkey::HUGEINT, 7) + 1) % {M32}")}) >> 8 AS DOUBLE) / 16777216e0 * 2e0 * pi() - pi()')} AS reference_phase FROM customer")
def sca_10_trap_phases(spark, sf_dir):
    """Phase of a trap by the hash of seed and id, and its reference phase by mixing both."""
    turn = lambda share: share * lit(2) * F.pi() - F.pi()
    hashed = hashing.fnv1a32(F.concat(F.lit("7:"), F.col("c_custkey").cast("string")))
    mixed = F.shiftright(hashing.mix32((F.col("c_custkey").bitwiseXOR(F.lit(7)) + 1).bitwiseAND(F.lit(hashing.WORD))), 8)
    return table(spark, sf_dir, "customer").select("c_custkey", r6(turn(hashed / lit(4294967295))).alias("phase"), r6(turn(mixed / lit(1 << 24))).alias("reference_phase"))


SEED = MIX(f"xor(xor(xor(12345::HUGEINT, {MIX(f'xor(o_orderkey::HUGEINT % {M32}, 2654435769::HUGEINT)')}), {MIX(f'xor((o_orderkey::HUGEINT >> 32) % {M32}, 2246822507::HUGEINT)')}), {MIX('xor((o_orderkey % 3)::HUGEINT, 3266489909::HUGEINT)')})")


@query(f"SELECT o_orderkey, CAST({SEED} AS BIGINT) AS seed FROM orders")
def gen_17_sample_seeds(spark, sf_dir):
    """The seed of a sample from the master seed, its number and the attempt."""
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.sample_seed(F.lit(12345).cast("long"), F.col("o_orderkey"), F.col("o_orderkey") % 3).alias("seed"))


@query(f"""WITH s AS (SELECT c_custkey, (c_custkey % 16)::HUGEINT AS i, ((c_custkey // 16)::HUGEINT + (c_custkey % 16 + 1)::HUGEINT * 1831565813) % {M32} AS a FROM customer),
    v AS (SELECT *, ((xor(a, a >> 15)) * (a | 1::HUGEINT)) % {M32} AS b FROM s), w AS (SELECT *, xor(b, (b + (xor(b, b >> 7) * (b | 61::HUGEINT)) % {M32}) % {M32}) AS c FROM v)
    SELECT c_custkey, CAST(xor(c, c >> 14) AS BIGINT) AS number, {R(f'CAST(xor(c, c >> 14) AS DOUBLE) / 4294967296e0')} AS unit FROM w""")
def gen_21_random_stream(spark, sf_dir):
    """16 numbers of each seed, each from its place in the stream alone."""
    number = hashing.stream32((F.col("c_custkey") / 16).cast("long"), F.col("c_custkey") % 16)
    return table(spark, sf_dir, "customer").select("c_custkey", number.alias("number"), r6(hashing.unit32(number)).alias("unit"))


@query("""WITH f AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), d AS (SELECT doc_id, strlen(t) AS n, sum(strlen(t)) OVER (ORDER BY doc_id) - strlen(t) AS o FROM f)
    SELECT doc_id, doc_id % 7 = 3 AS length_wrong, doc_id % 11 = 5 AS offset_wrong FROM d WHERE doc_id % 7 = 3 OR doc_id % 11 = 5""")
def join_33_descriptor_check(spark, sf_dir):
    """Stored texts against descriptors, some of which were changed: offset, length and crc32 compared
    with the running offset of what is stored."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    stored = order.running(d.select("doc_id", F.length("bytes").cast("long").alias("n"), F.crc32("bytes").alias("crc")), ["doc_id"], "n", "at")
    wrong = [F.col("doc_id") % 7 == 3, F.col("doc_id") % 11 == 5]
    told = stored.select("doc_id", (F.col("n") + wrong[0].cast("long")).alias("byte_length"), (F.col("at") + wrong[1].cast("long")).alias("byte_offset"), F.col("crc").alias("crc32"))
    found = tables.descriptor_errors(stored, told)
    return found.where("length_wrong or offset_wrong or crc_wrong").select("doc_id", "length_wrong", "offset_wrong")


@query("SELECT vec_id AS sample_id, CAST(8 AS INTEGER) AS width, CAST(8 AS INTEGER) AS height, CAST(vec_id % 5 + 1 AS INTEGER) AS trap_count, CAST(vec_id * 3 AS BIGINT) AS seed, CAST(list_sum(list_transform(embedding, lambda v: CAST(floor(least(greatest(v, -1e0), 1e0) * 127e0 + 128e0) AS BIGINT))) AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS error FROM embeddings")
def src_11_sample_payloads(spark, sf_dir):
    """Samples through the wire format and back: traps, a frame of 64 codes and metrics."""
    code = lambda v: F.floor(F.least(F.greatest(v.cast("double"), lit(-1)), lit(1)) * lit(127) + lit(128)).cast("int")
    traps = F.sequence(F.lit(0), (F.col("vec_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), (F.col("vec_id") * 3).alias("seed"), F.lit(8).alias("width"), F.lit(8).alias("height"),
        F.transform(traps, lambda i: F.struct(i.cast("float").alias("x"), (i * 2).cast("float").alias("y"), lit(0.5).cast("float").alias("phase"), (i + 1).cast("long").alias("trap_id"))).alias("traps"),
        F.transform("embedding", code).alias("codes"), F.to_json(F.struct((F.col("vec_id") % 9).alias("iterations"), F.lit(True).alias("valid"))).alias("metrics"),
    )
    back = packed.unpack_samples(packed.pack_samples(rows))
    return back.select("sample_id", "width", "height", F.size("traps").alias("trap_count"), "seed", F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"), "error")


TABLES = """WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 6 = 4 THEN 2 WHEN event_id % 6 = 5 THEN 3 WHEN event_id % 6 = 3 THEN 256 WHEN event_id % 6 = 2 THEN 0 ELSE 3 END AS n,
    CASE WHEN event_id % 6 = 2 THEN 'INVALID' WHEN event_id % 6 = 4 THEN 'ZERO_SPAN' WHEN event_id % 6 = 5 THEN 'REVERSES' END AS error,
    CASE event_id % 6 WHEN 0 THEN 'INCREASING' WHEN 1 THEN 'DECREASING' WHEN 3 THEN 'INCREASING' END AS direction,
    CASE WHEN event_id % 6 = 0 THEN CASE WHEN k > 3 THEN 'ZERO_TO_TWO_PI' ELSE 'NEGATIVE_PI_TO_PI' END WHEN event_id % 6 = 1 THEN CASE WHEN k > 3 THEN 'ZERO_TO_TWO_PI' ELSE 'NEGATIVE_PI_TO_PI' END WHEN event_id % 6 = 3 THEN 'ZERO_TO_TWO_PI' END AS convention,
    CASE event_id % 6 WHEN 0 THEN k * 1e0 WHEN 1 THEN k * 1e0 WHEN 3 THEN 6e0 END AS span FROM e WHERE k > 0"""


@query(TABLES)
def src_06_strict_tables(spark, sf_dir):
    """Measured tables in all accepted forms, and broken ones: every row tells its values or its error."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.concat(F.lit('{"values": [0, 0, '), k, F.lit("]}")))
        .when(kind == 1, F.concat(F.lit("# measured\nPhase Rad,note\n"), k, F.lit(",a\n0,b\n0,c\n")))
        .when(kind == 2, F.concat(F.lit('{"values": [0, 1], "phases": ['), k, F.lit("]}")))
        .when(kind == 3, F.concat(F.lit("code;phase\n0;0\n"), F.lit("128;1.5\n255;6\n")))
        .when(kind == 4, F.concat(k, F.lit(" "), k))
        .otherwise(F.concat(F.lit("0, "), k, F.lit(", 0.5\n")))
    )
    rows = table(spark, sf_dir, "events").where(k.cast("long") > 0).select("event_id", text.alias("text"))
    found = tables.strict_tables(rows, "event_id", "text")
    return found.select("event_id", F.coalesce(F.size("values"), F.lit(0)).alias("n"), "error", "direction", "convention", "span")


@query("WITH c AS (SELECT unnest(range(0, 256)) AS code) SELECT p_partkey, CAST(code AS INTEGER) AS code, " + R("CASE WHEN code <= m THEN code / CAST(m AS DOUBLE) * 15e-1 ELSE 15e-1 + (code - m) / CAST(255 - m AS DOUBLE) * 45e-1 END") + " AS phase FROM (SELECT p_partkey, 100 + p_size AS m FROM part), c")
def src_08_code_axis(spark, sf_dir):
    """Tables of three coded rows, spread to one row for each of the 256 codes."""
    m = (F.col("p_size") + 100).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit(0), m, F.lit(255)).alias("codes"), F.array(lit(0), lit(1.5), lit(6)).alias("phases"))
    spread = tables.code_axis(F.col("codes"), F.col("phases"))
    return rows.select("p_partkey", F.posexplode(spread).alias("code", "phase")).select("p_partkey", "code", r6("phase").alias("phase"))


CODES = "array_to_string(list_transform(embedding, lambda v: printf('%02x', CAST(floor(least(greatest(CAST(v AS DOUBLE), -1e0), 1e0) * 127e0 + 128e0) AS BIGINT))), '')"


@query(f"""WITH f AS (SELECT vec_id // 10 AS file, vec_id % 10 AS k, {CODES} AS hex FROM embeddings), h AS (SELECT file, '534c4d46' || '0100' || '0800' || '0800' || '08' || '00' || printf('%02x', count(*)) || '000000' || '40000000' || 'e8030000' AS head FROM f GROUP BY file)
    SELECT file, CAST(k // 4 AS BIGINT) AS part, CAST(CASE WHEN k // 4 = 0 THEN 0 ELSE 24 + k // 4 * 256 END AS BIGINT) AS begin, CAST(CASE WHEN k // 4 = 0 THEN 24 ELSE 0 END + 64 * count(*) AS BIGINT) AS bytes, sha256(unhex(CASE WHEN k // 4 = 0 THEN any_value(head) ELSE '' END || string_agg(hex, '' ORDER BY k))) AS digest FROM f JOIN h USING (file) GROUP BY file, k // 4""")
def snk_08_bundles(spark, sf_dir):
    """The coded frames of each sequence of ten as one bundle with its header, in parts of four frames."""
    code = lambda v: F.lpad(F.hex(F.floor(F.least(F.greatest(v.cast("double"), lit(-1)), lit(1)) * lit(127) + lit(128)).cast("long")), 2, "0")
    frames = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("file"), (F.col("vec_id") % 10).alias("index"), F.unhex(F.array_join(F.transform("embedding", code), "")).alias("bytes"))
    parts = packed.bundles(frames, "file", 8, 8, 8, 1000, frames_a_part=4)
    return parts.select("file", "part", "begin", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query(with_views("points") + " SELECT CAST(max(point_id) + 1 AS BIGINT) AS next_id FROM points")
def sca_65_next_id(spark, sf_dir):
    return views.points(spark, sf_dir).agg(F.coalesce(F.max("point_id") + 1, F.lit(1).cast("long")).alias("next_id"))


@query("WITH c AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(floor(least(greatest(CAST(embedding[i + 1] AS DOUBLE), -1e0), 1e0) * 127e0 + 128e0) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS i)) SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor(2126e-4 * v + 7152e-4 * (v * 3 % 256) + 722e-4 * (v * 7 % 256) + 5e-1) AS INTEGER) AS level FROM c")
def src_09_bitmaps(spark, sf_dir):
    """Images of 24 bits, every other one with its rows top-down, decoded to luma."""
    little = lambda n, size: F.lit(int(n).to_bytes(size, "little", signed=n < 0).hex().upper())
    byte = lambda v: F.lpad(F.hex(v), 2, "0")
    down = F.col("vec_id") % 2 == 1
    code = lambda v: F.floor(F.least(F.greatest(v.cast("double"), lit(-1)), lit(1)) * lit(127) + lit(128)).cast("long")
    line = lambda y: F.transform(F.slice("codes", y * 8 + 1, F.lit(8)), lambda v: F.concat(byte(v * 7 % 256), byte(v * 3 % 256), byte(v)))
    body = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: line(F.when(down, k).otherwise(7 - k))))
    head = F.concat(F.lit("424D"), little(54 + 192, 4), little(0, 4), little(54, 4), little(40, 4), little(8, 4), F.when(down, little(-8, 4)).otherwise(little(8, 4)), little(1, 2), little(24, 2), little(0, 24))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", code).alias("codes"))
    return packed.pixels(rows.select("vec_id", F.unhex(F.concat(head, F.array_join(body, ""))).alias("bytes")), "vec_id")
