"""Canonical texts, frame descriptors and measured code tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import let, lit


def canonical(fields: dict[str, Column]) -> Column:
    """One row as JSON with sorted keys and no spaces; null fields stay, -0 is 0."""
    parts = []
    for name in sorted(fields):
        body = F.to_json(F.struct(fields[name].alias(name)), {"ignoreNullFields": "false"})
        parts.append(F.substring(body, F.lit(2), F.length(body) - 2))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def descriptor_errors(stored: DataFrame, told: DataFrame, key: str = "doc_id") -> DataFrame:
    """stored: key, n, at, crc; told: key, byte_length, byte_offset, crc32. One row for each key of
    either side: missing, length_wrong, offset_wrong, crc_wrong."""
    both = stored.join(told, key, "full_outer")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    missing = F.col("n").isNull() | F.col("byte_length").isNull()
    return both.select(key, missing.alias("missing"), differs("n", "byte_length").alias("length_wrong"), differs("at", "byte_offset").alias("offset_wrong"), differs("crc", "crc32").alias("crc_wrong"))


def code_axis(codes: Column, phases: Column) -> Column:
    """256 phases from rising whole codes that hold 0 and 255; null where they don't."""

    def spread(given: Column) -> Column:
        c, p = given["codes"], given["phases"]
        n = F.size(c)
        steps = F.sequence(F.lit(1), n - 1)
        fits = (n >= 2) & (n == F.size(p)) & (F.get(c, F.lit(0)) == 0) & (F.get(c, n - 1) == 255)
        rising = F.forall(steps, lambda i: F.get(c, i) > F.get(c, i - 1)) & F.forall(c, lambda v: v == F.floor(v))
        ends = lambda i: F.struct(F.get(c, i - 1).alias("low"), F.get(c, i).alias("high"), F.get(p, i - 1).alias("start"), F.get(p, i).alias("end"))
        return F.when(fits & rising, F.flatten(F.transform(steps, lambda i: let(ends(i), between))))

    def between(e: Column) -> Column:
        """The phases of the codes behind one row up to the next, with code 0 before the first."""
        begin = F.when(e["low"] == 0, F.lit(0)).otherwise(e["low"].cast("int") + 1)
        return F.transform(F.sequence(begin, e["high"].cast("int")), lambda v: e["start"] + (e["end"] - e["start"]) * ((v - e["low"]) / (e["high"] - e["low"])))

    # Each stretch between two rows is spread by itself: the work is that of 256 codes, whatever the rows.
    return let(F.struct(codes.alias("codes"), phases.alias("phases")), spread)


#: Names of phase and code columns, without spaces and underscores, and of held lists.
_PHASE = ("phase", "phaserad", "measuredphase", "phaseresponse")
_CODE = ("code", "displaycode", "gray", "grey", "grayscale", "index")
_HELD = ("phaseResponseLut", "phase_response_lut", "values", "phases")


def strict_tables(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, values, error, direction, convention, span, sha256) of measured tables as text.

    A JSON list, an object that holds one under exactly one known name, rows with a delimiter, with or
    without a header, or numbers and spaces. Lines that begin with # don't count. A code column, or two
    columns on several lines, is spread to 256 codes. Plateaus are allowed. Errors: EMPTY, INVALID,
    LENGTH (2 to 65536 values), NOT_FINITE, ZERO_SPAN, REVERSES.
    """
    body = F.trim(F.regexp_replace(F.col(text), "^\ufeff", ""))
    numbers = lambda cells: F.transform(cells, lambda v: F.trim(v).try_cast("double"))
    held = [F.get_json_object(body, f"$.{n}") for n in _HELD]
    n_held = sum((h.isNotNull().cast("int") for h in held), F.lit(0))
    is_object, is_list = body.startswith("{"), body.startswith("[")
    json_text = F.when(is_list, body).when(n_held == 1, F.coalesce(*held))
    from_json = F.from_json(json_text, "array<string>")
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda v: F.trim(v)), lambda v: (v != "") & ~v.startswith("#"))
    rows = df.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"), body.alias("body"), (is_object | is_list).alias("json"), numbers(from_json).alias("listed"), lines.alias("lines"))
    comma, semi = F.exists("lines", lambda v: v.contains(",")), F.exists("lines", lambda v: v.contains(";"))
    cells = lambda pattern: F.transform("lines", lambda v: F.transform(F.split(v, pattern), lambda c: F.trim(c)))
    rows = rows.withColumn("cells", F.when(comma, cells(",")).when(semi, cells(";")).otherwise(cells(r"\s+"))).withColumn("cut", comma | semi)
    first = F.get("cells", F.lit(0))
    rows = rows.withColumn("header", F.when(F.col("cut") & F.exists(first, lambda c: c.try_cast("double").isNull()), F.transform(first, lambda c: F.regexp_replace(F.lower(c), "[ _]", ""))))
    place = lambda names: F.filter(F.sequence(F.lit(0), F.greatest(F.size("header") - 1, F.lit(0))), lambda i: F.get("header", i).isin(*names))
    rows = rows.withColumn("phase_at", F.when(F.col("header").isNotNull(), place(_PHASE))).withColumn("code_at", F.when(F.col("header").isNotNull(), place(_CODE)))
    data = F.when(F.col("header").isNotNull(), F.slice("cells", F.lit(2), F.greatest(F.size("cells") - 1, F.lit(0)))).otherwise(F.col("cells"))
    rows = rows.withColumn("data", data)
    column = lambda at: numbers(F.transform("data", lambda r: F.get(r, at)))
    named = F.when((F.size("phase_at") == 1) & F.forall("data", lambda r: F.size(r) == F.size("header")), F.when(F.size("code_at") == 0, column(F.get("phase_at", F.lit(0)))).when(F.size("code_at") == 1, code_axis(column(F.get("code_at", F.lit(0))), column(F.get("phase_at", F.lit(0))))))
    pairs = F.col("cut") & (F.size("data") >= 2) & F.forall("data", lambda r: F.size(r) == 2)
    plain = F.when(pairs, code_axis(column(F.lit(0)), column(F.lit(1)))).otherwise(numbers(F.flatten("data")))
    values = F.when(F.col("json"), F.col("listed")).when(F.col("header").isNotNull(), named).otherwise(plain)
    rows = rows.select(key, "sha256", "body", values.alias("values"))
    span = F.element_at("values", -1) - F.get("values", F.lit(0))
    turn = lambda sign: F.exists(F.sequence(F.lit(1), F.size("values") - 1), lambda i: sign * (F.get("values", i) - F.get("values", i - 1)) < 0)
    error = (
        F.when(F.coalesce(F.col("body"), F.lit("")) == "", "EMPTY")
        .when(F.col("values").isNull() | F.exists("values", lambda v: v.isNull()), "INVALID")
        .when((F.size("values") < 2) | (F.size("values") > 65536), "LENGTH")
        .when(F.exists("values", lambda v: F.isnan(v) | (F.abs(v) == lit(math.inf))), "NOT_FINITE")
        .when(span == 0, "ZERO_SPAN")
        .when(F.when(span > 0, turn(lit(1))).otherwise(turn(lit(-1))), "REVERSES")
    )
    rows = rows.withColumn("error", error)
    good = F.col("error").isNull()
    convention = F.when((F.array_min("values") >= lit(-1e-9)) & (F.array_max("values") > lit(math.pi)), "ZERO_TO_TWO_PI").otherwise("NEGATIVE_PI_TO_PI")
    return rows.select(
        key, F.when(~good & F.col("error").isin("INVALID", "EMPTY"), None).otherwise(F.col("values")).alias("values"), "error",
        F.when(good, F.when(span > 0, "INCREASING").otherwise("DECREASING")).alias("direction"), F.when(good, convention).alias("convention"),
        F.when(good, F.abs(span)).alias("span"), "sha256",
    )
