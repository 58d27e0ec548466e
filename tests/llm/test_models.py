"""Operators that learn: accuracy on rows held out, optimality, and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenloom.llm import decontaminate, langid, linear, mixing, pii, queries, resample, simhash, toxicity
from lumenloom.llm.common import fold, materialize, table
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def test_fold_is_crc32(spark):
    import zlib

    got = {r.id: r.f for r in spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) % 4 for k in range(50)}


def test_language_of_held_out_rows(spark):
    found = queries.op6_language(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    right = found.where("held_out").agg(F.avg(F.when(F.col("lang") == F.col("lang_pred"), 1.0).otherwise(0.0)), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] <= right[2] <= 1


def test_codewords_are_apart():
    for classes in (2, 3, 4, 5, 6, 12):
        code = langid.codewords(classes)
        far = [(code[i] != code[j]).sum() for i in range(classes) for j in range(i)]
        assert min(far) >= (1 if classes == 2 else 2)
    assert langid.codewords(1).shape == (1, 0) and langid.codewords(0).shape == (0, 0)


def test_language_edge_cases(spark):
    docs = cases.documents(spark)
    for model in (langid.train(docs), langid.train(cases.empty(spark)), langid.train(docs.where("lang = 'en'"))):
        got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
        assert all(got[k] == ("und", 0.0) for k in (2, 3, 4, 5)) and len(got) == len(cases.ROWS) - 1
        assert set(v[0] for v in got.values()) <= {*model["names"], "und"}
    assert langid.identify(cases.empty(spark), langid.train(docs)).count() == 0


def test_toxicity_of_rows_with_known_words(spark):
    found = queries.op10_toxicity(spark, SF).join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").toPandas()
    seen = found[~found["held_out"]]
    assert ((seen["predicted"] == 1) == (seen["toxic"] == 1)).mean() > 0.97
    aside = found[found["held_out"]]
    pairs = aside[aside["toxic"] == 1]["score"].to_numpy()[:, None] > aside[aside["toxic"] == 0]["score"].to_numpy()[None, :]
    assert pairs.mean() > 0.9 and found["score"].between(0, 1).all()


def test_toxicity_learns_subwords():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeioulmnrst"), 5)) for _ in range(300)]
    texts, marks = [], []
    for k in range(300):
        text = list(rng.choice(words, 30))
        if k % 3 == 0:
            text[int(rng.integers(0, 30))] = "grumpf" + rng.choice(["", "s", "er", "ig", "ing"])
        texts.append(" ".join(text))
        marks.append(k % 3 == 0)
    model = toxicity.fit(texts, np.array(marks), 1 / 3)
    import pyarrow as pa

    clean = " ".join(rng.choice(words, 60))
    unseen = toxicity.scores(model, pa.array([clean, clean + " Grumpflich", clean + " grumpf1g", "", None], pa.large_string()))
    assert unseen[0] < 0.3 < min(unseen[1], unseen[2]) and unseen[3] == unseen[4]


def test_toxicity_edge_cases(spark):
    docs = cases.documents(spark)
    model = toxicity.train(docs, cases.labels(spark))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(cases.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(cases.empty(spark), toxicity.train(cases.empty(spark), cases.labels(spark))).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_resampling(spark):
    found = queries.op3_resample(spark, SF)
    labels = table(spark, SF, "labels")
    rows = found.join(labels, "doc_id").toPandas()
    good, rough = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert good["selected"].mean() > 0.95 and rough["selected"].mean() < 0.25
    share = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    assert found.where("selected").count() == int(np.ceil(share * found.count()))


def test_resampling_is_gumbel(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    key = np.array([r.key for r in resample.scored(docs, np.zeros(resample.BUCKETS)).collect()])
    assert abs(key.mean() - 0.5772) < 0.07 and abs(key.std() - 1.2825) < 0.07


def test_resampling_edge_cases(spark):
    docs = cases.documents(spark)
    got = resample.select(docs, cases.labels(spark), k=5).collect()
    assert len(got) == len(cases.ROWS) and sum(r.selected for r in got) in (5, 6)
    assert {r.log_ratio for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert resample.select(docs, cases.labels(spark).where("false")).where("not selected").count() == 0
    assert resample.select(cases.empty(spark), cases.labels(spark)).count() == 0


def test_mixing_meets_targets(spark):
    found = queries.op4_mixing(spark, SF).toPandas()
    p, t, r = np.stack(found["posterior"]), found["n_tokens"].to_numpy(float), found["rate"].to_numpy()
    names = sorted(mixing.TARGETS)
    got = (p * (t * r)[:, None]).sum(axis=0) / t.sum()
    assert (r >= 0).all() and np.abs(got - [mixing.TARGETS[n] for n in names]).max() < 0.02


def test_projected_steps_solve_least_squares(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.4, 0.4, 0.4], 200)
    rows = spark.createDataFrame([(k, 10, [float(v) for v in q]) for k, q in enumerate(p)], "doc_id long, n_tokens long, posterior array<double>")
    wanted = {"a": 0.7, "b": 0.25, "c": 0.05}
    errors = mixing.fit_rates(rows, ["a", "b", "c"], wanted, steps=60)
    rate, _ = mixing._replay(p, errors, 1.0)
    assert np.abs((p * rate[:, None]).mean(axis=0) - list(wanted.values())).max() < 5e-3 and (rate >= 0).all()


def test_mixing_meets_each_target(spark):
    found = queries.op4_mixing(spark, SF).toPandas()
    p, t, r = np.stack(found["posterior"]), found["n_tokens"].to_numpy(float), found["rate"].to_numpy()
    got = (p * (t * r)[:, None]).sum(axis=0) / t.sum()
    assert np.allclose(got, [mixing.TARGETS[n] for n in sorted(mixing.TARGETS)], rtol=2e-3, atol=0)


@pytest.mark.parametrize("toxic, sharp", [(0.003, 8), (0.001, 8), (0.001, 1)])
def test_rare_domains_meet_their_targets(spark, toxic, sharp):
    rng = np.random.default_rng(5)
    shares = [0.7, 0.3 - toxic, toxic]
    logits = rng.normal(0, 1, (4000, 3)) + np.log(shares)
    logits[np.arange(4000), np.repeat([0, 1, 2], [2800, 1200 - int(4000 * toxic), int(4000 * toxic)])] += sharp
    p = linear.softmax(logits)
    rows = spark.createDataFrame([(10, [float(v) for v in q]) for q in p], "n_tokens long, posterior array<double>")
    rate, _ = mixing._replay(p, mixing.fit_rates(rows, ["good", "rough", "toxic"], mixing.TARGETS), 1.0)
    assert (rate >= 0).all() and np.allclose((p * rate[:, None]).mean(axis=0), [0.92, 0.07, 0.01], rtol=2e-3, atol=0)


def test_infeasible_targets_leave_the_least_residual(spark):
    p = np.array([[0.8, 0.2], [0.9, 0.1]] * 20)
    rows = spark.createDataFrame([(10, [float(v) for v in q]) for q in p], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="residual"):
        errors = mixing.fit_rates(rows, ["a", "b"], {"a": 0.5, "b": 0.5})
    rate, _ = mixing._replay(p, errors, 1.0)
    got = (p * rate[:, None]).mean(axis=0)
    scale = 0.5 / 0.68
    assert np.linalg.norm(got - 0.5) <= 1.02 * np.linalg.norm([0.8 * scale - 0.5, 0.2 * scale - 0.5])


def test_mixing_edge_cases(spark):
    docs = cases.documents(spark)
    got = mixing.rates(docs, cases.labels(spark)).collect()
    assert len(got) == len(cases.ROWS) and all(r.rate >= 0 and abs(sum(r.posterior) - 1) < 1e-9 for r in got)
    assert {r.rate for r in got if r.n_tokens == 0} == {1.0}
    assert {r.domain for r in mixing.rates(docs, cases.labels(spark).where("false")).collect()} == {"all"}
    assert mixing.rates(cases.empty(spark), cases.labels(spark)).count() == 0


def test_long_texts_come_in_pieces():
    import pyarrow as pa

    from lumenloom.llm import textkit

    text = "wort und Satz " * 500
    whole = [s.buf.tobytes() for s in textkit.segments(pa.array([text], pa.large_string()), textkit.IDENTITY)]
    parts = list(textkit.segments(pa.array([None, text, "", "x" * 3000], pa.large_string()), textkit.IDENTITY, limit=1000))
    assert len(whole) == 1 and len(parts) > 7
    assert sum(len(s.buf[: s.size].tobytes().split()) for s in parts) == 1500 + 3
    x = linear.matrix([text], linear.token_features, 256)
    assert abs((x**2).sum() - 1) < 1e-5


def test_pipeline_stages_by_hand(spark):
    """Each stage against a plain computation on its own input."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(materialize(stage(spark, states[-1], SF), name))
    raw, clean, single, apart, masked, mixed = states
    assert all(s.columns == columns for s in states[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    gone = ids[0] - ids[1]
    known = [labels[k] for k in gone if k in labels]
    assert np.mean(known) > 0.9 and len(ids[1]) > 0.8 * len(ids[0])
    parts = {r.doc_id: r.component_id for r in simhash.groups(clean).collect()}
    assert ids[2] == {k for k, v in parts.items() if k == v}
    hit = {r.doc_id for r in decontaminate.flag(single, table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert ids[3] == ids[2] - hit
    before = {r.doc_id: r.text for r in apart.collect()}
    for r in masked.collect():
        spans = pii.seed_spans(before[r.doc_id])
        assert r.n_chars == len(r.text) and (bool(spans) == (r.text != before[r.doc_id]) or spans == [])
        assert not pii.seed_spans(r.text)
    assert ids[5] == ids[4] == ids[3] and mixed.where("rate < 0").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == mixed.count()


# --- the same results by plain loops ----------------------------------------------------------

TEXTS = ["The quick brown fox; the quick-brown fox!", None, "", "Übermäßig schön, über 12 Maße.", "a", "### ### token token\ntoken"]


def plain_tokens(text):
    """Runs of word bytes or of punctuation, as byte strings."""
    import re

    return re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+", (text or "").lower().encode())


def plain_buckets(text, bits=None, modulo=None):
    """Buckets of tokens and pairs by an own statement of the hashes in whole numbers."""
    m, mix, powers = (1 << 64) - 1, 0x9E3779B97F4A7C15, [1]
    hashes = []
    for token in plain_tokens(text):
        while len(powers) < len(token):
            powers.append(powers[-1] * mix & m)
        total = sum((c + 1) * p for c, p in zip(token, powers)) & m
        hashes.append((total ^ total >> 29) * mix & m)
    pairs = [(a * mix + b) & m for a, b in zip(hashes, hashes[1:])]
    every = hashes + [(p ^ p >> 31) * mix & m for p in pairs]
    return [h >> 64 - bits if bits else (h >> 20) % modulo for h in every], len(hashes)


def test_resampling_counts_and_ratios_by_hand(spark):
    from collections import Counter

    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    target = spark.createDataFrame([(0,), (3,), (99,), (None,)], "doc_id long")
    raw, good = Counter(), Counter()
    for k, t in enumerate(TEXTS):
        found = plain_buckets(t, modulo=resample.BUCKETS)[0]
        raw.update(found)
        good.update(found if k in (0, 3) else [])
    n = resample.BUCKETS
    wanted = np.array([np.log((good[b] + 1) / (good.total() + n)) - np.log((raw[b] + 1) / (raw.total() + n)) for b in range(n)])
    for limit in (1 << 18, 0):
        resample.SET_ROWS, before = max(limit, 1), resample.SET_ROWS
        try:
            named = docs.withColumn("doc_id", F.col("doc_id").cast("long" if limit else "string"))
            got = resample.log_ratios(named, target.withColumn("doc_id", F.col("doc_id").cast("long" if limit else "string")))
        finally:
            resample.SET_ROWS = before
        assert np.allclose(got, wanted)
    rows = {r.doc_id: (r.n_grams, r.log_ratio) for r in resample.scored(docs, wanted).collect()}
    for k, t in enumerate(TEXTS):
        found = plain_buckets(t, modulo=n)[0]
        assert rows[k][0] == len(found) and abs(rows[k][1] - wanted[found].sum()) < 1e-9


def test_posteriors_by_hand(spark):
    rng = np.random.default_rng(0)
    bits = mixing.BUCKETS.bit_length() - 1
    model = {"names": ["a", "b"], "weights": rng.normal(0, 3, (mixing.BUCKETS, 2)).astype(np.float32), "bias": np.array([0.1, -0.2], np.float32)}
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in mixing.posteriors(docs, model).collect():
        found, tokens = plain_buckets(TEXTS[r.doc_id], bits=bits)
        share = np.sqrt(np.bincount(found, minlength=mixing.BUCKETS) / max(1, len(found)))
        z = np.exp(share @ model["weights"] + model["bias"])
        assert r.n_tokens == tokens and np.allclose(r.posterior, z / z.sum(), atol=1e-5)


def test_rates_against_a_direct_solve(spark):
    """The residual of an infeasible problem is that of least squares over all rates of 0 or more."""
    rng = np.random.default_rng(11)
    p = rng.dirichlet([6, 2, 1], 30)
    rows = spark.createDataFrame([(10, [float(v) for v in q]) for q in p], "n_tokens long, posterior array<double>")
    wanted = np.array([0.2, 0.3, 0.5])
    with pytest.warns(UserWarning):
        step = mixing.fit_rates(rows, ["a", "b", "c"], dict(zip("abc", wanted)))
    rate, _ = mixing._replay(p, step, 1.0)
    a, r = p.T / 30, np.ones(30)
    for _ in range(200_000):
        r = np.maximum(0, r - 25 * a.T @ (a @ r - wanted))
    assert np.linalg.norm(a @ rate - wanted) <= 1.02 * np.linalg.norm(a @ r - wanted) + 1e-9


def test_language_scores_by_hand(spark):
    rng = np.random.default_rng(5)
    code = langid.codewords(3)
    model = {"names": ["de", "en", "fr"], "code": code, "weights": rng.normal(0, 5, (langid.BUCKETS, code.shape[1])).astype(np.float32), "bias": rng.normal(0, 1, code.shape[1]).astype(np.float32), "trust": rng.uniform(0.5, 1.5, code.shape[1])}
    texts = [*TEXTS, "²½①Ⅷ", "12 ½ x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t or ""):
            assert got[k] == ("und", 0.0)
            continue
        found = []
        for word in "".join(chr(c) if 0x61 <= c <= 0x7A or c >= 0x80 else " " for c in t.lower().encode()).split():
            padded = b" " + word.encode("latin-1") + b" "
            for n in (2, 3, 4):
                for i in range(len(padded) - n + 1):
                    gram = int.from_bytes(padded[i : i + n], "little")
                    found.append((gram + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 52)
        share = np.sqrt(np.bincount(found, minlength=langid.BUCKETS) / max(1, len(found)))
        z = share @ model["weights"] + model["bias"]
        loss = np.array([(np.log1p(np.exp(-z * word)) * model["trust"]).sum() for word in code])
        p = np.exp(loss.min() - loss)
        assert got[k][0] == model["names"][loss.argmin()] and abs(got[k][1] - (p / p.sum()).max()) < 1e-4


def test_toxicity_scores_by_hand():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -0.3)
    texts = [*TEXTS, "eins zwei drei vier fünf sechs sieben"]
    got = toxicity.scores(model, pa.array(texts, pa.large_string()))
    for t, score in zip(texts, got):
        words = "".join(chr(c) if 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 or c >= 0x80 else " " for c in (t or "").lower().encode()).split()
        best = []
        for at in range(0, len(words), toxicity.PASSAGE):
            bag = []
            for word in words[at : at + toxicity.PASSAGE]:
                padded = b" " + word.encode("latin-1") + b" "
                for n in toxicity.GRAMS:
                    bag += [(int.from_bytes(padded[i : i + n], "little") + n) * 0x9E3779B97F4A7C15 % (1 << 64) >> 64 - toxicity.BITS for i in range(len(padded) - n + 1)]
            best.append(model.weights[bag].mean() if bag else 0.0)
        assert abs(score - 1 / (1 + np.exp(-(max(best, default=0) + model.bias)))) < 1e-5


# --- no caps, no cuts -------------------------------------------------------------------------


def test_no_class_of_a_sample_is_left_out(spark):
    from lumenloom.llm.common import bounded_sample

    rows = [(k, "x" * 50, f"l{k}") for k in range(300)] + [(1000 + k, "y" * 90_000, "long") for k in range(20)] + [(5000, "z" * 70_000, "long")] + [(1, "w" * 9, "l1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = bounded_sample(df, None, doc_id="doc_id", text="text", label="label", per_class=4, max_bytes=60_000, seed=1)
    assert set(got["label"]) == {f"l{k}" for k in range(300)} | {"long"} and got["key"].is_unique
    assert got[got["label"] == "long"]["text"].str.len().tolist() == [70_000]


def test_long_texts_lose_no_pair_and_no_passage(monkeypatch):
    import pyarrow as pa

    from lumenloom.llm import textkit

    text = "wort und Satz, ### " * 300 + "x" * 900
    column = pa.array(["a b", text, None, "c d e"], pa.large_string())
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, 1 << toxicity.BITS).astype(np.float32), 0.0)

    def seen(limit):
        monkeypatch.setattr(textkit.segments, "__defaults__", (True, limit))
        grams = [[] for _ in range(4)]
        for seg, hashes, piece, _ in textkit.token_grams(column, limit):
            for row, h in zip(seg.rows[piece].tolist(), hashes.tolist()):
                grams[row].append(h)
        return [sorted(g) for g in grams], toxicity.scores(model, column).tolist()

    whole, parts = seen(1 << 20), seen(1000)
    assert whole[0] == parts[0] and np.allclose(whole[1], parts[1])


def test_pipeline_edge_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns in every stage; empty tables."""
    cases.labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "never seen words of a test that is nowhere else at all"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = ("source", "n_chars")
    for docs in (cases.documents(spark), cases.empty(spark)):
        docs = docs.withColumn("source", F.lit("web")).withColumn("n_chars", F.length("text").cast("long"))
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, str(tmp_path)), name)
            if name != "mixing":
                assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
                docs = out
            assert set(columns) - {"n_chars"} <= set(out.columns) and out.count() <= n
            n = out.count()
        if n:
            ids = [r.doc_id for r in docs.select("doc_id").collect()]
            assert None in ids and len(ids) == len(set(ids))
