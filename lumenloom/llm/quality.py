"""Quality rules with host-level verdicts, by DataFrame functions only.

Each document is measured once and the few numbers are written to the shared folder. Rules fail or pass
by these numbers. Failures are counted by host; a host's failure rate of a rule is shrunk towards the
rate of all hosts by a beta prior whose strength is fitted to the hosts themselves by moments: hosts
that differ no more than chance would make them are shrunk wholly, hosts that differ are left nearly
as they are once they have many documents. A host some rule of which fails at more than `limit` after
shrinking is rejected with all of its documents; the verdicts meet the documents again by a join.

Counting by host combines within tasks first, so a host with a third of all rows is a row a task. The
rejected hosts are broadcast while they are at most `few` of bounded length; beyond it they meet the
documents by an equi-join over which each host is spread by a salt.

Repeated windows of words are told by 64-bit hashes of the words in them, compared within one document.

Defined cases: null, empty and word-free texts have no words, fail the rule of shortness and no other;
documents without a host (null) are one host of their own; repeated ids keep a row each; one single
host gives no prior, its own rate speaks; empty tables give empty tables; columns of docs beyond those
named are ignored by `flag` and pass through `keep` whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SALTS = 32
#: Rejected hosts that are broadcast: their number, and the characters of the longest name.
FEW, LONGEST_NAME = 10_000, 1_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _paired(hashes: str, by: int) -> Column:
    """Of every place a hash of what stands there and `by` places on; nothing is there behind the end."""
    behind = F.slice(F.col(hashes), F.lit(1 + by), F.greatest(F.size(hashes) - by, F.lit(0)))
    return F.zip_with(hashes, behind, lambda a, b: F.xxhash64(a, b))


def _repeated(windows: Column) -> Column:
    """Sorted places of the windows found twice or more, of sorted (hash, place)."""
    same = lambda w, k: F.coalesce(w["h"] == F.get(windows, k)["h"], F.lit(False))
    twice = F.filter(windows, lambda w, k: same(w, k - 1) | same(w, k + 1))
    return F.sort_array(F.transform(twice, lambda w: w["i"]))


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later lambdas may refer to: a generator of one row keeps the optimizer from
    writing their expressions into the lambdas, where each reference would compute them anew."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def signals(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", row: Column | None = None) -> DataFrame:
    """One row per document: row (its id unless given), host, n_words, word_chars, n_symbols, n_dup_lines,
    n_lines, n_repeat_words."""
    given = docs.select((F.col(f"`{doc_id}`") if row is None else row).alias("row"), F.col(f"`{host}`").cast("string").alias("host"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    bare = F.length(F.translate("text", SPACES, ""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    measured = _step(given, words=_words(F.col("text")), lines=lines)
    measured = measured.select("row", "host", "words", F.size("words").cast("long").alias("n_words"), bare.cast("long").alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # Hashes of 1, 2, 4, 8 words from each place; texts without repetition go no further.
    measured = _step(measured, h1=F.transform("words", lambda w: F.xxhash64(w))).drop("words")
    for width in (1, 2, 4):
        measured = _step(measured, **{f"h{2 * width}": _paired(f"h{width}", width)}).drop(f"h{width}")
    measured = _step(measured, windows=F.slice("h8", F.lit(1), F.greatest(F.size("h8") - (WINDOW - 1), F.lit(0)))).drop("h8")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    measured = _step(measured, sorted=F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).otherwise(none)).drop("windows")
    measured = _step(measured, places=_repeated(F.col("sorted"))).drop("sorted")
    covered = F.transform("places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("places", k + 1) - p, F.lit(WINDOW))))
    return measured.withColumn("n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda a, c: a + c)).drop("places")


def rules(*, min_words: int = 20, max_repeated: float = 0.3, max_symbols: float = 0.1, max_dup_lines: float = 0.3, word_length: tuple[float, float] = (2.0, 14.0)) -> dict[str, Column]:
    """Whether a measured document fails each rule. Shares of nothing don't fail."""
    share = lambda part, whole, top: F.col(part) * F.lit(100) > F.col(whole) * F.lit(round(100 * top))
    return {
        "short": F.col("n_words") < min_words,
        "repeated": share("n_repeat_words", "n_words", max_repeated),
        "symbols": share("n_symbols", "n_words", max_symbols),
        "dup_lines": share("n_dup_lines", "n_lines", max_dup_lines),
        "word_length": (F.col("word_chars") < F.col("n_words") * F.lit(word_length[0])) | (F.col("word_chars") > F.col("n_words") * F.lit(word_length[1])),
    }


BASE = ("short", "repeated")


def hosts(measured: DataFrame, failing: dict[str, Column] | None = None, *, limit: float = 0.5) -> DataFrame:
    """One row per host: host, n, and of each rule f_<rule> (failures), s_<rule> (shrunk rate); rejected.

    The prior of a rule: its mean m is the rate of all documents. Of the spread of the hosts' rates
    around it, weighted by documents, chance alone explains m (1 - m) (H - 1) / N with H hosts and N
    documents; the rest is the prior's own variance v, and m (1 - m) / v - 1 its strength in documents.
    """
    failing = rules() if failing is None else failing
    counted = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"f_{r}") for r, c in failing.items()])
    counted = materialize(counted, "hosts")
    total = counted.agg(F.count("*").alias("n_hosts"), F.sum("n").alias("n_all"), *[F.sum(f"f_{r}").alias(f"all_{r}") for r in failing])
    both = counted.crossJoin(F.broadcast(total))
    mean = lambda r: F.col(f"all_{r}") / F.col("n_all")
    spread = both.agg(*[(F.sum(F.col("n") * F.pow(F.col(f"f_{r}") / F.col("n") - mean(r), F.lit(2.0))) / F.max("n_all")).alias(f"d_{r}") for r in failing])
    both = both.crossJoin(F.broadcast(spread))

    def shrunk(r: str) -> Column:
        m, n, f = mean(r), F.col("n"), F.col(f"f_{r}")
        more = F.col(f"d_{r}") - m * (F.lit(1.0) - m) * (F.col("n_hosts") - 1) / F.col("n_all")
        strength = F.greatest(F.lit(0.0), F.try_divide(m * (F.lit(1.0) - m), more) - F.lit(1.0))
        # Without a prior (one host) the own rate speaks; without spread beyond chance only the mean.
        return F.when(F.col("n_hosts") < 2, f / n).when(more <= F.lit(1e-12), m).otherwise((f + strength * m) / (n + strength))

    rates = both.select("host", "n", *[f"f_{r}" for r in failing], *[shrunk(r).alias(f"s_{r}") for r in failing])
    return rates.withColumn("rejected", reduce(lambda a, b: a | b, [F.col(f"s_{r}") > F.lit(limit) for r in failing]))


def _judged(measured: DataFrame, failing: dict[str, Column], limit: float, few: int) -> DataFrame:
    """measured with base_failed and kept."""
    bad = materialize(hosts(measured, failing, limit=limit).where("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad")), "rejected")
    size = bad.agg(F.count("*").alias("n"), F.coalesce(F.max(F.length("bad_host")), F.lit(0)).alias("longest")).first()
    if size["n"] <= few and size["longest"] <= LONGEST_NAME:
        joined = measured.join(F.broadcast(bad), F.col("host").eqNullSafe(F.col("bad_host")), "left")
    else:
        spread = bad.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = measured.withColumn("of", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        joined = salted.join(spread, F.col("host").eqNullSafe(F.col("bad_host")) & (F.col("of") == F.col("salt")), "left").drop("of", "salt")
    base = reduce(lambda a, b: a | b, [failing[r] for r in BASE])
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & F.col("bad").isNull())


def flag(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = 0.5, few: int = FEW, **limits) -> DataFrame:
    """One row per document: doc_id, its measures, base_failed and kept. kept: it fails neither the rule of
    shortness nor that of repetition, and its host isn't rejected."""
    measured = materialize(signals(docs, doc_id=doc_id, text=text, host=host), "signals")
    found = _judged(measured, rules(**limits), limit, few)
    return found.select(F.col("row").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", limit: float = 0.5, few: int = FEW, **limits) -> DataFrame:
    """The documents that are kept, columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    measured = materialize(signals(docs, doc_id=doc_id, text=text, host=host, row=row), "signals")
    return _judged(measured, rules(**limits), limit, few).where("kept").select("row.*")
