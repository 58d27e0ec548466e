"""Personal data by bootstrapped contextual extraction.

Seed entities (e-mail, ip, card and phone matches of fixed patterns) induce lexical patterns: the
tokens around them (words and marks), alone and in pairs, together with the shape of what stands
between, and wider pairs of words for any shape. Candidates are tokens of a fitting shape that no
seed pattern matched, each with its own contexts. Spark scores the graph of patterns and instances
in rounds: a pattern is trusted in so far as its instances are known to be of one kind, an instance
in so far as trusted patterns surround it; instances found in one round are known in the next, until
a round finds none. A number that has the form of a kind and fails its check (a card that fails
Luhn, an ip with a part above 255) is evidence against the patterns around it and never becomes that
kind. Occurrences of trusted instances in trusted patterns join the seed spans.

Defined cases: null text is empty and has no spans; repeated documents are rows of their own, but a
pattern's support counts different instances only; texts are read whole; spans are code points, end
exclusive; extra columns are ignored by `flag` and kept by `redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import give_back, materialize

KINDS = ("email", "ip", "card", "phone")
SALTS = 8
FEW = 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9])(?:\+?[0-9(][0-9().\x20/-]{4,28}[0-9]|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}|[A-Za-z0-9._%+-]{1,64}(?:@|\(at\)|\[at\])[A-Za-z0-9._-]{2,64})(?![A-Za-z0-9])")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]")
_DIGITS = re.compile(r"[0-9]+")
CONTEXT_CHARS = 48


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, valid) of the leftmost matches of _IP that don't overlap, in linear time: a match
    lies in a run of digits and dots, and starts where a group of digits does."""
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        groups = list(_DIGITS.finditer(text, *run.span()))
        k = 0
        while k + 3 < len(groups):
            four = groups[k : k + 4]
            if all(b.start() - a.end() == 1 for a, b in zip(four, four[1:])):
                yield four[0].start(), four[3].end(), all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in four)
                k += 4
            else:
                k += 1


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of the fixed patterns, by kind as in KINDS and start; and of those that have
    a kind's form but fail its check."""
    good, failed = [(0, i, j) for i, j in _emails(text)], []
    for i, j, valid in _ips(text):
        (good if valid else failed).append((1, i, j))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            (good if _luhn(digits) else failed).append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            good.append((3, *m.span()))
    return good, failed


def seed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as in KINDS and start."""
    return matches(text)[0]


def fitting_kinds(token: str) -> list[int]:
    """The kinds whose shape a candidate has."""
    digits = sum("0" <= c <= "9" for c in token)
    if "@" in token or "(at)" in token or "[at]" in token:
        return [0]
    if token.count(":") >= 3 or (token.count(".") == 3 and digits + 3 == len(token)):
        return [1]
    return [2] * (12 <= digits <= 19) + [3] * (7 <= digits <= 15)


def _shape(token: str) -> str:
    """What stays of a token without its digits and letters: long runs of digits keep their length."""
    if "@" in token:
        return "@"
    return re.sub(r"[a-z]+", "a", _DIGITS.sub(lambda m: f"9{len(m[0])}" if len(m[0]) > 4 else "9", token.lower()))


def _patterns(text: str, start: int, end: int) -> list[str]:
    left = [w.lower() for w in _TOKEN.findall(text[max(0, start - CONTEXT_CHARS) : start])][-2:]
    right = [w.lower() for w in _TOKEN.findall(text[end : end + CONTEXT_CHARS])][:2]
    shape = _shape(text[start:end])
    found = [f"{w} {shape}" for w in left[-1:]] + [f"{shape} {w}" for w in right[:1]]
    if len(left) == 2:
        found.append(f"{left[0]} . {shape}")
    if len(right) == 2:
        found.append(f"{shape} . {right[1]}")
    words = [w for w in left if w[0].isalnum()]
    if len(words) == 2:
        found.append(f"{words[0]} {words[1]} _")
    if words and left[-1] == words[-1] and right and right[0][0].isalnum():
        found.append(f"{words[-1]} _ {right[0]}")
    return found


def _instance(token: str) -> str:
    return re.sub(r"[\s()./-]", "", token).lower()


#: What is known of an occurrence: a seed of its kind, a failed check of it, or open.
SEED, FAILED, OPEN = 1, -1, 0


def occurrences(text: str | None) -> list[tuple[int, int, int, int, str, list[str]]]:
    """(kind, start, end, mark, instance, patterns) of the seeds, the failed ones and the candidates."""
    text = text or ""
    seeds, failed = matches(text)
    found = [(k, i, j, SEED, _instance(text[i:j]), _patterns(text, i, j)) for k, i, j in seeds]
    found += [(k, i, j, FAILED, _instance(text[i:j]), _patterns(text, i, j)) for k, i, j in failed]
    taken = sorted((i, j) for _, i, j in seeds + failed)
    at, reach = 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        for kind in fitting_kinds(m[0]):
            found.append((kind, *m.span(), OPEN, _instance(m[0]), _patterns(text, *m.span())))
    return found


OCCURRENCE = "array<struct<kind:int,start:int,end:int,mark:int,instance:string,patterns:array<string>>>"


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    @F.pandas_udf(OCCURRENCE)
    def each(texts: pd.Series) -> pd.Series:
        give_back()
        names = ("kind", "start", "end", "mark", "instance", "patterns")
        return pd.Series([[dict(zip(names, o, strict=True)) for o in occurrences(t)] for t in texts])

    rows = docs.select(F.col(f"`{doc_id}`").alias(doc_id), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), each(F.col(f"`{text}`")).alias("found"))
    return materialize(rows.withColumn("row_key", F.monotonically_increasing_id()), "occurrences")


def trusted(found: DataFrame, *, support: int = 3, confidence: float = 0.8, doubt: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """Trusted (kind, pattern) and newly known (kind, instance) after scoring the graph.

    confidence of a pattern for a kind: known / (known + known of other kinds + failed ones of the
    kind + doubt * open ones) over different instances; a pattern needs `support` known ones. An
    instance is as likely as one minus the product of what its patterns leave open. Rounds end when
    one finds nothing new. Each instance is met once for each of its few patterns, and patterns are
    counted before they are shuffled, so a frequent pattern is no hot key; trusted patterns return to
    the instances through a join whose frequent keys are spread by a salt.
    """
    each = found.select(F.explode("found").alias("o")).select("o.*")
    edges = materialize(each.select("kind", "instance", "mark", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = materialize(each.where(F.col("mark") == SEED).select("kind", "instance").distinct(), "seeds")
    known = seeds
    salt = F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int")
    while True:
        marked = edges.join(known.withColumn("known", F.lit(1)), ["kind", "instance"], "left")
        yes = F.col("known").isNotNull()
        per_kind = marked.groupBy("pattern", "kind").agg(F.count_if(yes).alias("yes"), F.count_if(~yes & (F.col("mark") == FAILED)).alias("no"), F.count_if(~yes & (F.col("mark") == OPEN)).alias("open"))
        everything = per_kind.groupBy("pattern").agg(F.sum("yes").alias("all_yes"))
        scored = per_kind.where(F.col("yes") >= support).join(everything, "pattern").withColumn("confidence", F.col("yes") / (F.col("all_yes") + F.col("no") + doubt * F.col("open")))
        patterns = materialize(scored.where(F.col("confidence") >= confidence).select("kind", "pattern", "confidence"), "patterns")
        salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        fresh = edges.where(F.col("mark") == OPEN).withColumn("salt", salt)
        likely = fresh.join(salted, ["kind", "pattern", "salt"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("likely"))
        grown = likely.where(F.col("likely") >= confidence).select("kind", "instance").join(known, ["kind", "instance"], "left_anti")
        grown = materialize(grown, "grown")
        if grown.limit(1).count() == 0:
            break
        known = materialize(known.union(grown), "known")
    return patterns, known.join(seeds, ["kind", "instance"], "left_anti")


def discovered(found: DataFrame, **options) -> DataFrame:
    """(row_key, kind, start, end) of unseen identifiers in trusted patterns."""
    patterns, instances = trusted(found, **options)
    new = found.select("row_key", F.explode("found").alias("o")).select("row_key", "o.*").where(F.col("mark") == OPEN)
    at = new.join(instances, ["kind", "instance"]).select("row_key", "kind", "start", "end", F.explode("patterns").alias("pattern"))
    return at.join(patterns, ["kind", "pattern"]).select("row_key", "kind", "start", "end").distinct()


def spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Every row's doc_id and text_hash with `base` and `spans`: arrays of (kind, start, end)."""
    found = _found(docs, doc_id, text)
    extra = discovered(found, **options).groupBy("row_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    base = F.transform(F.filter("found", lambda o: o["mark"] == SEED), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    rows = found.select("row_key", doc_id, "text_hash", base.alias("base")).join(extra, "row_key", "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.select(doc_id, "text_hash", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("spans"))


def _listed(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def flag(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: the counts and digest of the base spans, and all spans as text."""
    rows = spans(docs, doc_id=doc_id, text=text, **options)
    for n, kind in enumerate(KINDS):
        rows = rows.withColumn(f"n_{kind}", _count_of("base", n))
    return rows.select(doc_id, *[f"n_{k}" for k in KINDS], F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _count_of(column: str, kind: int):
    return F.size(F.filter(column, lambda s: s["kind"] == kind)).cast("long")


def _cut(text: str, marks: list[tuple[int, int, int]]) -> str:
    parts, at = [], 0
    for i, j, kind in sorted(marks):
        if j <= at:
            continue
        if i >= at:
            parts += [text[at:i], f"[{KINDS[kind].upper()}]"]
        at = j
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents, every span of the text replaced by its kind, as in [EMAIL]; other columns stay.

    Seed spans are found again in the row itself; only discovered ones are joined, if there are any, and
    are broadcast if there are at most FEW of them (some 10 MB).
    """
    found = _found(docs, doc_id, text)
    extra = materialize(discovered(found, **options), "discovered")

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        give_back()
        return texts.map(lambda t: t if t is None else _cut(t, [(i, j, k) for k, i, j in seed_spans(t)]))

    column = F.col(f"`{text}`")
    if extra.limit(1).count() == 0:
        return docs.withColumn(text, plain(column))

    @F.pandas_udf("string")
    def with_extra(texts: pd.Series, more: pd.Series) -> pd.Series:
        cut = [t if t is None else _cut(t, [(i, j, k) for k, i, j in seed_spans(t)] + [(o["start"], o["end"], o["kind"]) for o in (m if m is not None else ())]) for t, m in zip(texts, more, strict=True)]
        return pd.Series(cut, dtype=object)

    places = found.join(extra, "row_key").select(F.col(doc_id).alias("place_of"), F.col("text_hash").alias("place_text"), "kind", "start", "end").distinct()
    places = places.groupBy("place_of", "place_text").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    if extra.limit(FEW + 1).count() <= FEW:
        places = F.broadcast(places)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("of"), column.alias("body"))
    joined = rows.join(places, F.col("of").eqNullSafe(F.col("place_of")) & (F.xxhash64("body") == F.col("place_text")), "left")
    return joined.select(F.col("row").withField(f"`{text}`", with_extra(F.col("body"), F.col("more"))).alias("row")).select("row.*")
