"""Stores of samples through crashes, packages through changes."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from lumenloom.sources import commits, frame_files, packages, packed

SCHEMA = "sample_id long, body string"


class Stop(Exception):
    pass


def at(step):
    def reached(now):
        if now == step:
            raise Stop(step)

    return reached


def put(spark, folder, ids):
    spark.createDataFrame([(k, f"b{k}") for k in ids], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("step", ["staged", "moved"])
def test_a_killed_stream_goes_on_with_every_sample_once(spark, tmp_path, step):
    src, store, checkpoint = (str(tmp_path / n) for n in ("src", "store", "checkpoint"))

    def run(reached=lambda now: None):
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        commits.write_stream(stream, store, "sample_id", checkpoint, "s", reached).trigger(availableNow=True).start().awaitTermination()

    put(spark, src, range(10))
    run()
    put(spark, src, [8, 9, 10, 11, 12, 12])
    with pytest.raises(Exception, match=step):
        run(at(step))
    assert sorted(r.sample_id for r in commits.read(spark, store).collect()) == list(range(10))
    assert len(os.listdir(f"{store}/staging")) == (step == "staged")
    assert {r["status"] for r in commits.verified(spark, store, "sample_id").collect()} == {"ok"} | ({"unexpected"} if step == "moved" else set())
    run()
    put(spark, src, [13, 14])
    run()
    assert sorted((r.sample_id, r.body) for r in commits.read(spark, store).collect()) == [(k, f"b{k}") for k in range(15)]
    found = commits.verified(spark, store, "sample_id").orderBy("commit").collect()
    assert [(r["commit"], r.n, r.first_id, r.last_id, r.status) for r in found] == [(0, 10, 0, 9, "ok"), (1, 3, 10, 12, "ok"), (2, 2, 13, 14, "ok")]


def test_replays_nulls_and_empty_batches(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="nothing"):
        commits.read(spark, store)
    batch = spark.createDataFrame([(1, "a"), (None, "x"), (None, "x"), (1, "a")], SCHEMA)
    for commit, df in ((0, batch), (0, batch), (1, batch.limit(0)), (2, batch)):
        commits.append(df, commit, store, "sample_id")
    assert sorted(str(r.sample_id) for r in commits.read(spark, store).collect()) == ["1", "None", "None", "None", "None"]
    assert [(r["commit"], r.n, r.status) for r in commits.verified(spark, store, "sample_id").orderBy("commit").collect()] == [(0, 3, "ok"), (1, 0, "ok"), (2, 2, "ok")]
    with pytest.raises(ValueError, match="another"):
        commits.append(batch, 0, store, "sample_id", stream="another")


def test_damage_to_a_store_is_named(spark, tmp_path):
    store = str(tmp_path / "store")
    for commit in range(3):
        commits.append(spark.createDataFrame([(commit, "a")], SCHEMA), commit, store, "sample_id")
    spark.createDataFrame([(1, "b")], SCHEMA).write.mode("overwrite").parquet(f"{store}/samples/commit=1")
    os.rename(f"{store}/samples/commit=2", tmp_path / "gone")
    assert [r.status for r in commits.verified(spark, store, "sample_id").orderBy("commit").collect()] == ["ok", "changed", "missing"]
    with pytest.raises(ValueError, match=r"without their samples: \[2\]"):
        commits.recover(spark, store, "sample_id")
    os.rename(tmp_path / "gone", f"{store}/samples/other")
    with pytest.raises(ValueError, match="other"):
        commits.recover(spark, store, "sample_id")


def test_a_changed_byte_of_a_package_is_named(spark, tmp_path):
    path = str(tmp_path / "package")
    tables = {"frames": spark.range(100).withColumn("v", F.col("id") * 2), "sites": spark.range(7), "none": spark.range(0)}
    listed = packages.write(tables, path, rows_a_file=10)
    totals = {r.member: r for r in packages.summary(listed).collect()}
    assert (totals["frames"].rows, totals["sites"].rows, totals["none"].rows) == (100, 7, 0) and totals["frames"].files >= 10
    assert {r.status for r in packages.verified(spark, path).collect()} == {"ok"}
    assert packages.read(spark, path, "frames").count() == 100
    file = sorted(n for n in os.listdir(f"{path}/frames") if n.endswith(".parquet"))[3]
    with open(f"{path}/frames/{file}", "r+b") as f:
        f.seek(20)
        old = f.read(1)
        f.seek(20)
        f.write(bytes([old[0] ^ 1]))
    os.remove(f"{path}/frames/.{file}.crc")  # the local file system would find the change by itself
    lost = sorted(n for n in os.listdir(f"{path}/sites") if n.endswith(".parquet"))[0]
    os.rename(f"{path}/sites/{lost}", f"{path}/sites/more-{lost}")
    bad = {(r.member, r.file): r.status for r in packages.verified(spark, path).where("status != 'ok'").collect()}
    assert bad == {("frames", file): "changed", ("sites", lost): "missing", ("sites", f"more-{lost}"): "unexpected"}
    with pytest.raises(ValueError, match="changed"):
        packages.read(spark, path, "frames")
    with pytest.raises(ValueError):
        packages.write({"manifest": spark.range(1)}, f"{path}2")


def traps(spark, frames, count, shift=0):
    rows = spark.range(frames * count).select(F.floor(F.col("id") / count).alias("frame"), (F.col("id") % count).alias("trap_id"))
    return rows.select("frame", (F.col("frame") * 10).alias("time"), "trap_id", F.when(F.col("trap_id") % 3 != 0, F.col("trap_id") + shift).alias("atom_id"), (F.col("trap_id") / 7).alias("x"), F.col("frame").cast("double").alias("y"), F.lit(0.5).alias("intensity"), F.lit(-1.25).alias("phase"), F.lit(3).cast("long").alias("flags"))


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_frame_files_are_split_at_frame_borders(spark, tmp_path):
    path, want = str(tmp_path / "frames"), traps(spark, 40, 25)
    frame_files.save(want, path)
    for split in (300, 5_000, 1 << 20):
        got = frame_files.load(spark, path, split)
        assert rows_of(got) == rows_of(want)
    assert frame_files.load(spark, path, 5_000).rdd.getNumPartitions() >= 40 * 25 * 50 // 5_000
    for name in os.listdir(path):
        if name.endswith(".index"):
            os.remove(f"{path}/{name}")
    assert rows_of(frame_files.load(spark, path, 5_000)) == rows_of(want)
    # The layout is that of the packed column.
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.frames").load(path)
    assert rows_of(packed.unpack_frames(blobs, "content").drop("error")) == rows_of(want)


def test_failed_writes_of_frames_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "frames")
    frame_files.save(traps(spark, 3, 4), path)
    bad = traps(spark, 30, 4).withColumn("flags", F.when(F.col("frame") != 29, F.col("flags")))
    with pytest.raises(Exception):
        frame_files.save(bad, path)
    (tmp_path / "frames" / "left-behind.frames").write_bytes(b"half")
    assert rows_of(frame_files.load(spark, path)) == rows_of(traps(spark, 3, 4))
    frame_files.save(traps(spark, 2, 5, shift=9).withColumn("frame", F.col("frame") + 50), path)
    assert frame_files.load(spark, path).count() == 22
    frame_files.save(traps(spark, 0, 4), path, mode="overwrite")
    assert frame_files.load(spark, path).count() == 0
    plain = tmp_path / "plain"
    plain.mkdir()
    (plain / "a.bin").write_bytes(b"\1" * 20)
    with pytest.raises(Exception, match="STORAGE_ERROR"):
        frame_files.load(spark, str(plain)).collect()


def test_bundles_have_their_header_and_all_frames(spark):
    frames = [(k, i, bytes([10 * k + i] * 8)) for k in (1, 2) for i in range(5)]
    schema = "file long, index long, bytes binary"
    found = packed.bundles(spark.createDataFrame(frames, schema), "file", 2, 2, 16, 70000, frames_a_part=2).orderBy("file", "part").collect()
    assert [(r["file"], r["part"], r["begin"]) for r in found] == [(k, p, 0 if p == 0 else 24 + 32 * p // 2) for k in (1, 2) for p in (0, 1, 2)]
    for k in (1, 2):
        whole = b"".join(r["content"] for r in found if r["file"] == k)
        assert whole[:24] == struct.pack("<4sHHHBxIII", b"SLMF", 1, 2, 2, 16, 5, 8, 70000)
        assert whole[24:] == b"".join(b for f, _, b in frames if f == k)
    for wrong in (frames[1:], [*frames, frames[0]], [*frames, (1, 5, b"1")], [*frames, (1, 5, None)], [*frames, (1, None, b"12345678")]):
        with pytest.raises(Exception, match="whole"):
            packed.bundles(spark.createDataFrame(wrong, schema), "file", 2, 2, 16, 70000, frames_a_part=2).collect()
    assert packed.bundles(spark.createDataFrame([], schema), "file", 2, 2, 16, 70000).collect() == []
