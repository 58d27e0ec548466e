"""The registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm import decontaminate, infill, langid, licenses, mixing, mtree, periodic, pii, quality, resample, simhash, suffix_dedup, toxicity
from lumenloom.llm.common import table


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.flag(table(spark, sf_dir, "documents"))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), windows=True)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.report(table(spark, sf_dir, "documents"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and the words of the text joined by spaces; every tenth document (by crc32 of its id) repeats
    some of its words to its end."""
    hash_ = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(hash_ / 10).cast("long")
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    given = docs.select("doc_id", hash_.alias("h"), g.alias("g"), F.inline(F.array(F.struct(words.alias("words")))))
    given = given.withColumn("n", F.size("words")).withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    given = given.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("long"))
    repeated = F.transform("words", lambda w, i: F.get("words", F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")))
    return given.select("doc_id", F.array_join(F.when(F.col("a").isNull(), F.col("words")).otherwise(repeated), " ").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(with_planted_runs(table(spark, sf_dir, "documents")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_topk": op2_topk,
    "op3_resample": op3_resample,
    "op4_mixing": op4_mixing,
    "op5_licenses": op5_licenses,
    "op6_language": op6_language,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_toxicity": op10_toxicity,
    "op11_infill": op11_infill,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}

ORACLES: dict[str, str] = {
    "op2_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS f FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.f, c.f) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS t
                FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
        lens AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
                FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
        hit AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
        words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(0, n)) AS k) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op11_infill": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
        k AS (SELECT *, CAST(len(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
        p AS (SELECT *, array_to_string(t[1:a], '') AS p, array_to_string(t[a + 1:b], '') AS m, array_to_string(t[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_quality_rules": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM documents),
        win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS t FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
        rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win), (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY r),
        m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
              CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (r)),
        f AS (SELECT *, [n_words < 20, n_repeat_words * 100 > n_words * 30, n_symbols * 100 > n_words * 10, n_dup_lines * 100 > n_lines * 30, word_chars < n_words * 2 OR word_chars > n_words * 14] AS fails FROM m),
        c AS (SELECT source, k, count(*) AS n, count(*) FILTER (WHERE fails[k]) AS f FROM f, (SELECT unnest(range(1, 6)) AS k) GROUP BY source, k),
        t AS (SELECT k, count(*) AS h, sum(n) AS n_all, sum(f) / sum(n) AS mean FROM c GROUP BY k),
        s AS (SELECT k, any_value(h) AS h, any_value(mean) AS mean, sum(n * (f / n - mean) ** 2) / any_value(n_all) - any_value(mean * (1 - mean) * (h - 1) / n_all) AS more FROM c JOIN t USING (k) GROUP BY k),
        z AS (SELECT source, bool_or(CASE WHEN h < 2 THEN f / n WHEN more <= 1e-12 THEN mean ELSE (f + greatest(0, mean * (1 - mean) / more - 1) * mean) / (n + greatest(0, mean * (1 - mean) / more - 1)) END > 5e-1) AS rejected FROM c JOIN s USING (k) GROUP BY source)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fails[1] OR fails[2] AS base_failed, NOT (fails[1] OR fails[2]) AND NOT rejected AS kept
        FROM f JOIN z ON f.source IS NOT DISTINCT FROM z.source
    """,
}
