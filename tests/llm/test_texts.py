"""Fill-in-the-middle, periodic runs and quality rules, against plain loops and SQL."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.llm import common, infill, periodic, quality, queries, simhash
from lumenloom.llm.common import materialize, table
from tests.llm import cases
from tests.oracle import same


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_infill", "op13_quality_rules"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLES[name], sf_dir)


# --- fill in the middle ---------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("abZ é汉\n<😀"), max_size=40), min_size=1, max_size=5), st.sampled_from([1, 2, 3, 7, 512]), st.data())
def test_cuts_by_trees(texts, block, data):
    raw = [t.encode() for t in texts]
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    trees = infill.BlockTrees(np.frombuffer(b"".join(raw), np.uint8), bounds, block)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert trees.totals().tolist() == [len(u) for u in units]
    asked = [(k, data.draw(st.integers(0, len(u)))) for k, u in enumerate(units) for _ in range(3)]
    at, points = trees.cut(np.array([a[0] for a in asked]), np.array([a[1] for a in asked]))
    heads = ["".join(units[k][:n]) for k, n in asked]
    assert at.tolist() == [len(h.encode()) for h in heads] and points.tolist() == [len(h) for h in heads]


def infilled(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form, output = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, len(units), form, len(p), len(m), sha(output), sha(text)


def by_text(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_infill_cases(spark):
    extra = [(100 + k, t, "en", 1) for k, t in enumerate(["<", "<<P", "<S<S<S", "a<P>b", "M><", "<M", *["x<S<P<M" * 9] * 20])]
    docs = cases.documents(spark, cases.ROWS + extra)
    assert by_text(map(tuple, infill.report(docs).collect())) == by_text(infilled(r.doc_id, r.text) for r in docs.collect())
    assert infill.report(cases.empty(spark)).count() == 0
    whole = infill.transform(docs).select("row.*", "output")
    assert set(whole.columns) == set(docs.columns) - {"text"} | {"output"}


def test_infill_slices(spark, monkeypatch):
    monkeypatch.setattr(infill, "SLICE_BYTES", 10)
    texts = ["", "abc def", "x" * 50, "é" * 9, ""]
    column = __import__("pyarrow").array(texts, "large_string")
    parts = [(i, j, bytes(buf), bounds.tolist()) for i, j, buf, bounds in infill._slices(column)]
    assert b"".join(p[2] for p in parts) == "".join(texts).encode() and parts[-1][1] == len(texts)
    assert all(len(bounds) == j - i + 1 for i, j, _, bounds in parts)


# --- periodic runs --------------------------------------------------------------------------


def brute_runs(words, shortest=12):
    found = {}
    for period in range(1, len(words)):
        equal = [words[i] == words[i + period] for i in range(len(words) - period)] + [False]
        start = 0
        for i, e in enumerate(equal):
            if not e:
                length = i - start + period
                if length >= max(shortest, 2 * period):
                    found.setdefault((start, length), period)
                start = i + 1
    return sorted((s, n, p) for (s, n), p in found.items())


@st.composite
def repetitive(draw):
    words = draw(st.lists(st.integers(0, draw(st.sampled_from([1, 2, 4]))), max_size=40))
    if words and draw(st.booleans()):
        a, p = draw(st.integers(0, len(words))), draw(st.integers(1, len(words)))
        words = words[:a] + words[:p] * draw(st.integers(1, 6)) + words[a:]
    return [b"w%d" % w for w in words]


@settings(max_examples=400, deadline=None)
@given(st.lists(repetitive(), min_size=1, max_size=4), st.sampled_from([1, 2, 5, 12, 13]))
def test_runs_of_words(texts, shortest):
    assert periodic.runs_of(texts, shortest) == [brute_runs(t, shortest) for t in texts]


def test_many_places_of_one_left_word_are_leapt_over():
    """A long run of one word has one maximal pair for each multiple of its period, and asks for no others."""
    met = []
    words = np.array([*[0] * 3000, 1])
    before = [-1, *words[:-1].tolist()]
    for order, common in periodic.repeats(np.array([*[0] * 3000, 1]), 6):
        met += list(periodic.maximal_pairs(order.tolist(), common.tolist(), [before[i] for i in order.tolist()], 6))
    assert sorted(met) == [(0, d, 3000 - d) for d in range(1, 1501)]


def report_of(doc_id, words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    longest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *longest, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_runs_cases(spark):
    rows = [(20, "a b " * 9 + "c " + "d e f " * 5, "en", 1), (21, "x " * 12, "en", 1), (22, "x " * 11, "en", 1)]
    docs = cases.documents(spark, [r for r in cases.ROWS if r[1] is not cases.LONG] + rows)
    got = by_text(map(tuple, periodic.report(docs).collect()))
    assert got == by_text(report_of(r.doc_id, re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in docs.collect())
    assert periodic.report(cases.empty(spark)).count() == 0
    long = periodic.report(cases.documents(spark, [r for r in cases.ROWS if r[1] is cases.LONG])).first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 28000, 7)


def test_runs_query_equals_brute_force(spark, sf_dir):
    def planted(doc_id, text):
        w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        return w

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = by_text(map(tuple, queries.op12_periodic_runs(spark, sf_dir).collect()))
    assert got == by_text(report_of(r.doc_id, planted(r.doc_id, r.text)) for r in docs.collect())


# --- quality rules --------------------------------------------------------------------------


def measures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    return len(words), len("".join(words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_quality_cases(spark):
    rows = [(30, "a b c d e f g h i\n" * 2 + "#1 \n\n \n#1 \n#1", "en", 1), (31, ("w " * 30).strip(), "en", 1), (32, "<b>" * 40 + " 汉字", "en", 1)]
    docs = cases.documents(spark, [r for r in cases.ROWS if r[1] is not cases.LONG] + rows).withColumn("source", F.col("lang"))
    got = by_text(tuple(r)[:6] for r in quality.flag(docs).collect())
    assert got == by_text((r.doc_id, *measures(r.text)) for r in docs.collect())
    assert quality.flag(cases.empty(spark).withColumn("source", F.lit("x"))).count() == 0
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == quality.flag(docs).where("kept").count()


def hosts_of(spark):
    """Host a: 40 documents of which 30 fail for symbols; b: 200 sound ones; c: one bad; none: two sound."""
    sound, bad = "good words stand here in a row of more than twenty words so that no rule about length says no to it at all", "# # # # good words stand here in a row of more than twenty words so that no rule about length says no"
    rows = [(k, bad if k < 30 else sound, "a") for k in range(40)] + [(100 + k, sound, "b") for k in range(200)] + [(500, bad, "c"), (600, sound, None), (601, sound, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("few", [10, 0])
def test_host_verdicts(spark, few):
    docs = hosts_of(spark)
    rates = {r.host: r for r in quality.hosts(quality.signals(docs)).collect()}
    n, f = np.array([40, 200, 1, 2]), np.array([30, 0, 1, 0])
    mean = f.sum() / n.sum()
    more = (n * (f / n - mean) ** 2).sum() / n.sum() - mean * (1 - mean) * 3 / n.sum()
    strength = max(0.0, mean * (1 - mean) / more - 1)
    want = (f + strength * mean) / (n + strength)
    assert [rates[h].s_symbols for h in ("a", "b", "c", None)] == pytest.approx(want)
    assert {h for h, r in rates.items() if r.rejected} == {h for h, w in zip(("a", "b", "c", None), want) if w > 0.5} and rates["a"].rejected
    found = {r.doc_id: r for r in quality.flag(docs, few=few).collect()}
    assert len(found) == 243 and not any(r.base_failed for r in found.values())
    assert {k for k, r in found.items() if not r.kept} == {r.doc_id for r in docs.collect() if rates[r.source].rejected}


def test_one_host_and_equal_hosts(spark):
    docs = hosts_of(spark).where("source = 'a'")
    assert quality.hosts(quality.signals(docs)).first().s_symbols == 0.75
    alike = docs.withColumn("source", (F.col("doc_id") % 2).cast("string"))
    assert [r.s_symbols for r in quality.hosts(quality.signals(alike)).collect()] == [0.75, 0.75]


def test_quality_rules_run_without_python(spark, sf_dir):
    plan = quality.flag(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- near-duplicates by row -----------------------------------------------------------------


def test_unlike_rows_of_one_id_are_not_lost(spark):
    a, b, c = ("one two three four five six seven " * 4, "alpha beta gamma delta epsilon zeta eta theta " * 4, "lorem ipsum dolor sit amet consectetur " * 4)
    rows = [(3, a, "a3"), (7, a, "a7"), (7, b, "b7"), (9, c, "c9"), (9, c, "c9"), (11, b, "b11"), (12, c, "c12"), (None, a, "a0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = sorted(r.tag for r in simhash.keep_first(docs).collect())
    assert kept == ["a0", "a3", "b7", "c9"]
    named = simhash.keep_first(docs.withColumn("doc_id", F.concat(F.lit("d"), F.lpad("doc_id", 3, "0"))))
    assert sorted(r.tag for r in named.collect()) == kept


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    rows = materialize(spark.range(4000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id"), "rows")
    named = rows.select("k").distinct().withColumn("name", F.col("k") * 2)
    want = {(r.id, r.k * 2) for r in rows.collect()}
    monkeypatch.setattr(common, "HOT_LEAST", 100)
    for share in (1e-4, 0.9):
        monkeypatch.setattr(common, "HOT_SHARE", share)
        got = common.meet(rows, named, "k").collect()
        assert len(got) == 4000 and {(r.id, r["name"]) for r in got} == want
