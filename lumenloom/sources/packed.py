"""Packed trap frames and grey bitmaps as BINARY columns."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The little-endian layouts of a frame header and of a trap record.
HEADER = np.dtype([("frame", "<u4"), ("time", "<i8"), ("count", "<u4")])
RECORD = np.dtype([("trap_id", "<u4"), ("atom_id", "<u4"), ("has_atom", "u1"), ("x", "<f8"), ("y", "<f8"), ("intensity", "<f8"), ("phase", "<f8"), ("flags", "<u4")])
TRAP = "frame long, time long, trap_id long, atom_id long, x double, y double, intensity double, phase double, flags long, error string"


def pack_frames(traps: DataFrame) -> DataFrame:
    """(frame, time, bytes): one packed frame for each frame and time, traps by id."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("trap_id")
        records = np.zeros(len(group), RECORD)
        for name in ("trap_id", "x", "y", "intensity", "phase", "flags"):
            records[name] = group[name]
        records["has_atom"] = group["atom_id"].notna()
        records["atom_id"] = group["atom_id"].fillna(0).astype("int64")
        head = np.array([(group["frame"].iloc[0], group["time"].iloc[0], len(group))], HEADER)
        return pd.DataFrame({"frame": group["frame"].iloc[:1], "time": group["time"].iloc[:1], "bytes": [head.tobytes() + records.tobytes()]})

    return traps.groupBy("frame", "time").applyInPandas(one, "frame long, time long, bytes binary")


def unpack_frames(df: DataFrame, content: str = "bytes") -> DataFrame:
    """One row for each trap of packed frames that stand one behind the other; a truncated tail gives
    one row with error STORAGE_ERROR."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            for blob in batch[content]:
                at = 0
                while blob is not None and at < len(blob):
                    if at + HEADER.itemsize > len(blob):
                        break
                    head = np.frombuffer(blob, HEADER, 1, at)[0]
                    at += HEADER.itemsize
                    if at + int(head["count"]) * RECORD.itemsize > len(blob):
                        at -= HEADER.itemsize
                        break
                    records = np.frombuffer(blob, RECORD, int(head["count"]), at)
                    at += records.nbytes
                    rows = pd.DataFrame({n: records[n].astype("int64" if records[n].dtype.kind == "u" else "float64") for n in ("trap_id", "x", "y", "intensity", "phase", "flags")})
                    rows["atom_id"] = pd.array(np.where(records["has_atom"], records["atom_id"], 0), "Int64")
                    rows.loc[records["has_atom"] == 0, "atom_id"] = pd.NA
                    rows["frame"], rows["time"], rows["error"] = int(head["frame"]), int(head["time"]), None
                    yield rows[[c.split()[0] for c in TRAP.split(", ")]]
                if blob is not None and at < len(blob):
                    yield pd.DataFrame([[None] * 9 + ["STORAGE_ERROR"]], columns=[c.split()[0] for c in TRAP.split(", ")])

    return df.select(content).mapInPandas(read, TRAP)


def to_bitmap(codes: np.ndarray) -> bytes:
    """An 8-bit grey bitmap, rows bottom-up and padded to four bytes."""
    height, width = codes.shape
    stride = -(-width // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :width] = codes[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    begin = 14 + 40 + palette.nbytes
    head = np.zeros(54, np.uint8)
    head[:2] = (0x42, 0x4D)
    for at, kind, value in ((2, "<u4", begin + body.nbytes), (10, "<u4", begin), (14, "<u4", 40), (18, "<i4", width), (22, "<i4", height), (26, "<u2", 1), (28, "<u2", 8), (34, "<u4", body.nbytes), (38, "<i4", 2835), (42, "<i4", 2835), (46, "<u4", 256), (50, "<u4", 256)):
        head[at : at + np.dtype(kind).itemsize] = np.frombuffer(np.array(value, kind).tobytes(), np.uint8)
    return head.tobytes() + palette.tobytes() + body.tobytes()


def bitmaps(codes: DataFrame, key: str) -> DataFrame:
    """(key, bytes): rows (key, y, x, code) of each frame as a grey bitmap."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((int(group["y"].max()) + 1, int(group["x"].max()) + 1), np.uint8)
        image[group["y"], group["x"]] = group["code"]
        return pd.DataFrame({key: group[key].iloc[:1], "bytes": [to_bitmap(image)]})

    return codes.groupBy(key).applyInPandas(one, f"{key} long, bytes binary")


def pixels(df: DataFrame, key: str, content: str = "bytes") -> DataFrame:
    """(key, y, x, level) of uncompressed bitmaps of 8 (with palette), 24 or 32 bits, rows bottom-up or, with
    a negative height, top-down; level is the luma by the weights 0.2126, 0.7152, 0.0722 (fixed values).
    Column functions on the bytes alone; other bitmaps give no rows."""
    byte = lambda at: F.conv(F.hex(F.substring(F.col(content), at + F.lit(1), F.lit(1))), 16, 10).cast("int")
    little = lambda at, n=4: sum((byte(F.lit(at + k)).cast("long") * (1 << (8 * k)) for k in range(n)), F.lit(0).cast("long"))
    signed = F.when(little(22) >= 1 << 31, little(22) - (1 << 32)).otherwise(little(22))
    head = df.select(key, content, little(10).alias("begin"), little(14).alias("head"), little(18).alias("w"), F.abs(signed).alias("h"), (signed < 0).alias("down"), little(28, 2).alias("bits"), little(30).alias("packing"))
    sized = head.where(F.col("bits").isin(8, 24, 32) & (F.col("packing") == 0) & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("w") * F.col("h") <= 1 << 24))
    rows = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("y")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("x"))
    line = F.when(F.col("down"), F.col("y")).otherwise(F.col("h") - 1 - F.col("y"))
    at = (F.col("begin") + line * F.ceil(F.col("w") * F.col("bits") / 32) * 4 + F.col("x") * (F.col("bits") / 8)).cast("int")
    colour = F.when(F.col("bits") == 8, (14 + F.col("head") + 4 * byte(at)).cast("int")).otherwise(at)
    luma = F.floor(byte(colour + 2) * 0.2126 + byte(colour + 1) * 0.7152 + byte(colour) * 0.0722 + 0.5)
    return rows.select(key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), luma.cast("int").alias("level"))


#: Magic, version and little-endian layout of the header of a sample, and its size.
SAMPLE_MAGIC, SAMPLE_VERSION = b"SLMD", 1
SAMPLE_HEADER = np.dtype([("magic", "S4"), ("version", "<u2"), ("header", "<u2"), ("sample_id", "<u8"), ("traps", "<u4"), ("seed", "<u4"), ("crc32", "<u4"), ("width", "<u4"), ("height", "<u4"), ("positions", "<u4"), ("phases", "<u4"), ("ids", "<u4"), ("frame", "<u4"), ("metrics", "<u4"), ("flags", "<u4"), ("reserved", "<u4")])
SAMPLE = "sample_id long, seed long, width int, height int, traps array<struct<x:float,y:float,phase:float,trap_id:long>>, codes array<int>, metrics string, error string"


def pack_samples(samples: DataFrame) -> DataFrame:
    """(sample_id, bytes): header, positions, phases, ids, frame and metrics of each sample."""

    def one(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            blobs = []
            for r in batch.itertuples(index=False):
                traps = list(r.traps)
                xy = np.array([(t["x"], t["y"]) for t in traps], "<f4").reshape(len(traps), 2)
                sections = [xy.tobytes(), np.array([t["phase"] for t in traps], "<f4").tobytes(), np.array([t["trap_id"] for t in traps], "<u4").tobytes(), np.asarray(r.codes, np.uint8).tobytes(), r.metrics.encode()]
                head = np.array([(SAMPLE_MAGIC, SAMPLE_VERSION, SAMPLE_HEADER.itemsize, r.sample_id, len(traps), r.seed, zlib.crc32(sections[3]), r.width, r.height, *map(len, sections), 0, 0)], SAMPLE_HEADER)
                blobs.append(head.tobytes() + b"".join(sections))
            yield pd.DataFrame({"sample_id": batch["sample_id"], "bytes": blobs})

    return samples.select("sample_id", "seed", "width", "height", "traps", "codes", "metrics").mapInPandas(one, "sample_id long, bytes binary")


def _sample(blob: bytes) -> tuple:
    """The columns of SAMPLE; an error names the first check that fails."""
    bad = lambda why: (None,) * 7 + (why,)
    if blob is None or len(blob) < SAMPLE_HEADER.itemsize:
        return bad("SHORT")
    h = np.frombuffer(blob, SAMPLE_HEADER, 1)[0]
    n, sizes = int(h["traps"]), [int(h[k]) for k in ("positions", "phases", "ids", "frame", "metrics")]
    if h["magic"] != SAMPLE_MAGIC or h["version"] != SAMPLE_VERSION or h["header"] != SAMPLE_HEADER.itemsize:
        return bad("HEADER")
    if h["flags"] or h["reserved"] or not n or sizes[:4] != [8 * n, 4 * n, 4 * n, int(h["width"]) * int(h["height"])] or not sizes[3]:
        return bad("SECTIONS")
    if len(blob) != SAMPLE_HEADER.itemsize + sum(sizes):
        return bad("LENGTH")
    cuts = np.cumsum([SAMPLE_HEADER.itemsize, *sizes]).tolist()
    xy, phases, ids, frame, metrics = (blob[i:j] for i, j in zip(cuts, cuts[1:]))
    if zlib.crc32(frame) != h["crc32"]:
        return bad("CRC32")
    try:
        pairs = json.loads(metrics.decode(), object_pairs_hook=lambda p: p, parse_constant=lambda _: [][0])
        if not isinstance(pairs, list) or len({k for k, _ in pairs}) != len(pairs):
            return bad("METRICS")
    except (ValueError, TypeError, IndexError):
        return bad("METRICS")
    traps = [{"x": x, "y": y, "phase": p, "trap_id": i} for (x, y), p, i in zip(np.frombuffer(xy, "<f4").reshape(n, 2).tolist(), np.frombuffer(phases, "<f4").tolist(), np.frombuffer(ids, "<u4").tolist())]
    return int(h["sample_id"]), int(h["seed"]), int(h["width"]), int(h["height"]), traps, np.frombuffer(frame, np.uint8).tolist(), metrics.decode(), None


def unpack_samples(df: DataFrame, content: str = "bytes") -> DataFrame:
    """One row for each packed sample, its columns or the error: SHORT, HEADER, SECTIONS, LENGTH, CRC32
    or METRICS (not one JSON object with different keys and finite numbers)."""
    names = [c.split()[0] for c in ("sample_id long", "seed", "width", "height", "traps", "codes", "metrics", "error")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in frames:
            rows = pd.DataFrame([_sample(b) for b in batch[content]], columns=names)
            for name in names[:4]:
                rows[name] = rows[name].astype("Int64")
            yield rows

    return df.select(content).mapInPandas(read, SAMPLE)


def _little(value: Column, n: int) -> Column:
    """A whole number as the hex of n little-endian bytes."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(value.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)])


def bundles(frames: DataFrame, key: str, width: int, height: int, bits: int, period: int, frames_a_part: int = 64) -> DataFrame:
    """(key, part, begin, content): the frames of each sequence as one file, cut into parts that follow each
    other from byte `begin` on; the first has the header of 24 bytes.

    frames: (key, index, bytes), index from 0. A sequence whose frames have gaps, repetitions, nulls or another
    size than its header says is an error. No group holds more than the frames of a part, so a sequence may
    be of any length.
    """
    size = width * height * bits // 8
    found = frames.groupBy(key).agg(F.count("*").alias("n"), F.min("index").alias("low"), F.max("index").alias("high"), F.count_if(F.coalesce(F.length("bytes"), F.lit(-1)) != size).alias("odd"))
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("odd") == 0)
    # fixed values: magic, version, and the order and widths of the fields
    head = F.concat(F.lit("SLMF".encode().hex()), *[_little(F.lit(v), n) for v, n in ((1, 2), (width, 2), (height, 2), (bits, 1), (0, 1))], _little(F.col("n"), 4), *[_little(F.lit(v), 4) for v in (size, period)])
    heads = found.select(key, F.when(F.coalesce(whole, F.lit(False)), head).otherwise(F.raise_error(F.lit(f"a sequence isn't whole: frames from 0 on, of {size} bytes"))).alias("head"))
    part = F.floor(F.col("index") / frames_a_part).cast("long")
    parts = frames.groupBy(key, part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("index", F.hex("bytes").alias("hex")))).alias("f"))
    joined = parts.join(heads, F.equal_null(parts[key], heads[key])).drop(heads[key])
    repeated = F.size(F.array_distinct(F.transform("f", lambda f: f["index"]))) != F.size("f")
    body = F.array_join(F.transform("f", lambda f: f["hex"]), "")
    checked = F.when(repeated, F.raise_error(F.lit("a sequence isn't whole: a frame is there twice"))).otherwise(F.concat(F.when(F.col("part") == 0, F.col("head")).otherwise(F.when(F.col("head").isNull(), F.lit(None)).otherwise(F.lit(""))), body))
    begin = F.when(F.col("part") == 0, F.lit(0).cast("long")).otherwise(F.lit(24) + F.col("part") * frames_a_part * size)
    return joined.select(key, "part", begin.alias("begin"), F.unhex(checked).alias("content"))
