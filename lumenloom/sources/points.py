"""Point sources: occupied lattices, JSON lists, code tables as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.functions.numeric import lit


def occupied_lattice(df: DataFrame, key: str, sites: str, occupied: str) -> DataFrame:
    """(key, site, x, y) of the sites whose flag is not 0; lists of different lengths give `error`."""
    same = F.size(sites) == F.size(occupied)
    rows = df.select(key, same.alias("same"), F.when(same, F.arrays_zip(F.col(sites).alias("p"), F.col(occupied).alias("f"))).alias("zipped"))
    good = rows.where("same").select(key, F.posexplode("zipped").alias("site", "z")).where(F.col("z.f") != 0)
    bad = rows.where(~F.coalesce("same", F.lit(False))).select(key, F.lit("INVALID_ARGUMENT").alias("error"))
    points = good.select(key, "site", F.col("z.p.x").alias("x"), F.col("z.p.y").alias("y"), F.lit(None).cast("string").alias("error"))
    return points.unionByName(bad, allowMissingColumns=True)


def _items(text: Column) -> Column:
    """The entries of an array, or of the array held under a known name, as JSON texts."""
    names = ("initialAtoms", "targetSites", "points", "tweezers", "traps")
    held = [F.from_json(F.get_json_object(text, f"$.{n}"), "array<string>") for n in names]
    return F.coalesce(F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")), *held)


def json_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, x, y, ok): entries are [x, y] or objects with xUm or x, yUm or y; ids default to the
    place from 1; ok is false where a coordinate is missing or not finite."""
    rows = df.select(key, F.posexplode(_items(F.col(text))).alias("pos", "item"))
    pair = F.from_json("item", "array<double>")
    named = F.from_json("item", "id bigint, xUm double, yUm double, x double, y double")
    listed = F.ltrim("item").startswith("[")
    x = F.when(listed, F.get(pair, F.lit(0))).otherwise(F.coalesce(named["xUm"], named["x"]))
    y = F.when(listed, F.get(pair, F.lit(1))).otherwise(F.coalesce(named["yUm"], named["y"]))
    ok = F.coalesce(~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < lit(float("inf"))) & (F.abs(y) < lit(float("inf"))), F.lit(False))
    return rows.select(key, F.coalesce(F.when(~listed, named["id"]), F.col("pos") + 1).cast("long").alias("id"), x.alias("x"), y.alias("y"), ok.alias("ok"))


def code_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, values, monotone) of numbers separated by space, comma or semicolon, or a JSON list."""
    body = F.trim(F.translate(text, "[]", "  "))
    values = F.transform(F.split(body, r"[\s,;]+"), lambda v: v.try_cast("double"))
    rows = df.select(key, values.alias("values"))
    steps = F.zip_with(F.slice("values", F.lit(2), F.size("values")), F.slice("values", F.lit(1), F.size("values") - 1), lambda b, a: b - a)
    rises = F.element_at("values", -1) >= F.element_at("values", 1)
    monotone = F.when(F.size("values") < 2, F.lit(False)).otherwise(F.when(rises, F.forall(steps, lambda s: s >= 0)).otherwise(F.forall(steps, lambda s: s <= 0)))
    return rows.select(key, "values", F.coalesce(monotone, F.lit(False)).alias("monotone"))


def tweezers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, x, y, phase, intensity, ok): entries are [x, y, phase, intensity] or objects, the phase
    under one of three names; intensity is 1 by default and must be above 0; ids default to the place."""
    rows = df.select(key, F.posexplode(_items(F.col(text))).alias("pos", "item"))
    listed, pair = F.ltrim("item").startswith("["), F.from_json("item", "array<double>")
    named = F.from_json("item", "id bigint, xUm double, yUm double, x double, y double, phaseRad double, targetPhaseRad double, phase double, intensity double")
    pick = lambda k, *names: F.when(listed, F.get(pair, F.lit(k))).otherwise(F.coalesce(*[named[n] for n in names]))
    x, y, phase = pick(0, "xUm", "x"), pick(1, "yUm", "y"), pick(2, "phaseRad", "targetPhaseRad", "phase")
    light = F.coalesce(pick(3, "intensity"), lit(1))
    sound = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < lit(float("inf")))
    ok = F.coalesce(sound(x) & sound(y) & sound(phase) & sound(light) & (light > 0), F.lit(False))
    return rows.select(key, F.coalesce(F.when(~listed, named["id"]), F.col("pos") + 1).cast("long").alias("id"), x.alias("x"), y.alias("y"), phase.alias("phase"), light.alias("intensity"), ok.alias("ok"))


def single_frame(found: DataFrame, key: str) -> DataFrame:
    """The good tweezers of each list as traps of frame 0 at time 0: no atoms, no flags."""
    zero = F.lit(0).cast("long")
    return found.where("ok").select(key, zero.alias("frame"), zero.alias("time"), F.col("id").alias("trap_id"), F.lit(None).cast("long").alias("atom_id"), "x", "y", "intensity", "phase", F.lit(0).alias("flags"))
