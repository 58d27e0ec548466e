"""Benchmark decontamination with DataFrame functions only.

The windows of the benchmark (10 consecutive normalised words, or a whole shorter item) become a
hash set that travels with the plan. Every position of a document is probed with the hash of the
first words of a window; the few survivors are verified word for word. No row is shuffled. The set
is used in this form only below `max_windows`; beyond it the probe is an equi-join on the window.

Defined cases: null text or text without words has no words and no hits; items without words
give no window; null item ids give windows that hit but name no item; repeated documents are
rows of their own, repeated items count once per item_id; extra columns of either table stay out
of the result (`flag`) or pass through unchanged (`drop`, `redact`).
"""

from __future__ import annotations

import json
import string
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
PREFIX_WORDS = 3
BUCKETS = 128
#: Rows of 64 slots of the filter of windows, and keys that a frequent window is spread over.
FILTER_ROWS, SALTS = 1 << 18, 16


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """One row for each different window: window, n (words), items (sorted ids as text)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - n + 1)
    windows = items.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, n), " "))).alias("window"))
    return windows.groupBy("window", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _probe(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(*[F.get(words, start - 1 + k) for k in range(min(n, PREFIX_WORDS))])


def _starts(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))


def _bucket(window: Column) -> Column:
    return F.pmod(F.crc32(window.cast("binary")), F.lit(BUCKETS)).cast("string")


def _hits_by_set(found: DataFrame, windows: list) -> DataFrame:
    """Adds `hits`: array of (start, n, items) of the verified windows."""
    lookup: dict[str, dict[str, list]] = {}
    lengths: dict[int, list[str]] = {}
    for r in windows:
        lookup.setdefault(str(zlib.crc32(r["window"].encode()) % BUCKETS), {})[r["window"]] = r["items"]
        lengths.setdefault(r["n"], []).append(r["window"])
    if not windows:
        return found.withColumn("hits", F.array().cast("array<struct<start:int,n:int,items:array<string>>>"))
    spark = found.sparkSession
    table = F.from_json(F.lit(json.dumps(lookup)), "map<string,map<string,array<string>>>")
    words = F.col("words")

    def hits_of(n: int, texts: list[str]) -> Column:
        heads = spark.createDataFrame([(t.split(" "),) for t in texts], "w array<string>").select(_probe(F.col("w"), F.lit(1), n)).distinct()
        probes = [r[0] for r in heads.collect()]
        near = F.filter(_starts(words, n), lambda i: _probe(words, i, n).isin(probes))
        text = F.transform(near, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i, n), " ").alias("w")))
        return F.transform(text, lambda t: F.struct(t["start"].alias("start"), F.lit(n).alias("n"), F.try_element_at(F.try_element_at(table, _bucket(t["w"])), t["w"]).alias("items")))

    parts = [hits_of(n, texts) for n, texts in sorted(lengths.items())]
    return found.withColumn("hits", F.filter(F.concat(*parts), lambda h: h["items"].isNotNull()))


def _filter_of(windows: DataFrame) -> Column:
    """64 slots a row of hashed windows as one constant of FILTER_ROWS numbers (2 MB), whatever their number."""
    slot = F.pmod(F.xxhash64("window"), F.lit(64 * FILTER_ROWS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    bits = [0] * FILTER_ROWS
    for r in windows.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return F.from_json(F.lit(json.dumps(bits)), "array<bigint>")


def _hits_by_join(found: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """As _hits_by_set, for benchmarks of any size: windows meet by an equi-join.

    Only positions that pass a filter of fixed size become rows. A frequent window (an item of one
    common word) is spread by a salt over SALTS keys.
    """
    rows = materialize(found.withColumn("row_key", F.monotonically_increasing_id()), "rows")
    words, bits = F.col("words"), _filter_of(windows)

    def passes(window: Column) -> Column:
        slot = F.pmod(F.xxhash64(window), F.lit(64 * FILTER_ROWS))
        held = F.get(bits, F.shiftright(slot, 6).cast("int"))
        return F.call_function("shiftright", held, slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    def windows_of(n: int) -> Column:
        every = F.transform(_starts(words, n), lambda i: F.struct(i.alias("start"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("window")))
        return F.filter(every, lambda w: passes(w["window"]))

    every = F.concat(F.array().cast("array<struct<start:int,n:int,window:string>>"), *[windows_of(n) for n in lengths])
    at = rows.select("row_key", F.explode(every).alias("at")).select("row_key", "at.*").withColumn("salt", F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int"))
    given = windows.select("window", "items", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = at.join(given, ["window", "salt"]).groupBy("row_key").agg(F.collect_list(F.struct("start", "n", "items")).alias("hits"))
    empty = F.array().cast("array<struct<start:int,n:int,items:array<string>>>")
    return rows.join(hits, "row_key", "left").withColumn("hits", F.coalesce("hits", empty)).drop("row_key")


def scan(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, max_windows: int = 100_000, max_bytes: int = 16 << 20) -> DataFrame:
    """docs packed as `row` (a struct of all its columns) with `words`, `positions` (1-based hit
    words) and `items` (ids as text)."""
    windows = benchmark_windows(benchmark, item_id, item_text, width)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("window") + 16 * F.size("items")), F.lit(0)).alias("b"), F.collect_set("n").alias("lengths")).first()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # A generator of one row: filters on later columns then can't move the split into a lambda.
    found = docs.select(F.inline(F.array(F.struct(row.alias("row"), words_of(F.col(f"`{text}`")).alias("words")))))
    if size["n"] <= max_windows and size["b"] <= max_bytes:
        found = _hits_by_set(found, windows.collect())
    else:
        found = _hits_by_join(found, windows, sorted(size["lengths"]))
    positions = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return found.select("row", "words", positions.alias("positions"), items.alias("items"))


def flag(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs, benchmark, doc_id=doc_id, **options).select(
        F.col(f"row.{doc_id}").alias(doc_id),
        F.size("words").cast("long").alias("n_words"),
        F.size("positions").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("positions") > 0).alias("contaminated"),
    )


def drop(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, columns unchanged."""
    return scan(docs, benchmark, **options).select(F.inline(F.when(F.size("positions") == 0, F.array("row"))))


def redact(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """All documents, hit words cut out of their text; text without hits stays byte for byte."""
    found = scan(docs, benchmark, text=text, **options)
    pieces = F.regexp_extract_all(F.col(f"row.{text}"), F.lit(PIECE), 0)
    kept = F.filter(pieces, lambda piece, i: ~F.array_contains(F.col("positions"), i + 1))
    tail = F.regexp_extract(F.col(f"row.{text}"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    clean = F.when(F.size("positions") == 0, F.col(f"row.{text}")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return found.withColumn("row", F.col("row").withField(text, clean)).select("row.*")
