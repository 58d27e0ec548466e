"""Folders of packed trap frames as a data source: spark.read.format("packed_frames").

A file holds frames one behind the other, as packed.pack_frames lays them out, and beside it an index of
where each begins. A write adds files under names of its own and is seen once its list of files stands in
the folder _writes, so that what failed tasks or a failed write leave behind is never read. Paths are
those that pyarrow's file systems open: local ones, file:, hdfs:, s3: and the like.
"""

from __future__ import annotations

import json
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from lumenloom.sources.packed import HEADER, RECORD

FORMAT = "packed_frames"
SCHEMA = "frame long, time long, trap_id long, atom_id long, x double, y double, intensity double, phase double, flags long"
#: Little-endian: where a frame begins in its file, and its bytes.
INDEX = np.dtype([("frame", "<u4"), ("begin", "<u8"), ("bytes", "<u8")])
#: RECORD for struct.
LAYOUT = "<IIBddddI"
#: A part of a file that one task reads, unless the option split_bytes says otherwise.
SPLIT_BYTES = 32 << 20
#: Records sent on at a time, and bytes of one frame held in memory before they go to the task's disk.
BATCH_RECORDS, HELD_BYTES = 65_536, 16 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(path)
    return files, root.rstrip("/")


def _names(files: fs.FileSystem, folder: str) -> list[str]:
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.File)


def _writes(files: fs.FileSystem, root: str) -> list[dict]:
    """The writes that count: those that no later one replaces."""
    found = []
    for name in _names(files, f"{root}/_writes"):
        if name.endswith(".json") and not name.startswith("."):
            with files.open_input_stream(f"{root}/_writes/{name}") as f:
                found.append(json.loads(f.read()))
    replaced = {w for entry in found for w in entry["replaces"]}
    return [entry for entry in found if entry["write"] not in replaced]


@dataclass
class Part(InputPartition):
    """The frames of a file that begin in [low, high)."""

    name: str
    low: int
    high: int
    size: int


class FrameReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split = path, split_bytes

    def partitions(self) -> list[Part]:
        """Ranges of bytes; which frames begin in one is found by the task that reads it."""
        files, root = _open(self.path)
        if "_writes" in {i.base_name for i in files.get_file_info(fs.FileSelector(root))}:
            sizes = {f["name"]: f["bytes"] for entry in _writes(files, root) for f in entry["files"]}
        else:
            sizes = {i.base_name: i.size for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and i.base_name[0] not in "._" and not i.base_name.endswith(".index")}
        found = [Part(name, low, min(low + self.split, size), size) for name, size in sorted(sizes.items()) for low in range(0, size, self.split)]
        return found or [Part("", 0, 0, 0)]

    def _begins(self, files: fs.FileSystem, where: str, part: Part, f) -> Iterator[int]:
        """Where the frames of a part begin: by the index, or from frame to frame by their headers."""
        if files.get_file_info(f"{where}.index").type == fs.FileType.File:
            with files.open_input_stream(f"{where}.index") as stream:
                begins = np.frombuffer(stream.read(), INDEX)["begin"]
            low, high = np.searchsorted(begins, [part.low, part.high])
            yield from begins[low:high].tolist()
            return
        at = 0
        while at < part.high:
            if at >= part.low:
                yield at
            at += HEADER.itemsize + RECORD.itemsize * int(self._head(f, at, part)["count"])

    def _head(self, f, at: int, part: Part) -> np.void:
        f.seek(at)
        head = f.read(HEADER.itemsize)
        found = np.frombuffer(head, HEADER)[0] if len(head) == HEADER.itemsize else None
        if found is None or at + HEADER.itemsize + RECORD.itemsize * int(found["count"]) > part.size:
            raise ValueError(f"STORAGE_ERROR: {part.name} is cut short in the frame at byte {at}")
        return found

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        files, root = _open(self.path)
        where = f"{root}/{part.name}"
        with files.open_input_file(where) as f:
            for at in self._begins(files, where, part, f):
                head = self._head(f, at, part)
                f.seek(at + HEADER.itemsize)
                left = int(head["count"])
                while left:
                    n = min(left, BATCH_RECORDS)
                    yield self._batch(head, np.frombuffer(f.read(n * RECORD.itemsize), RECORD))
                    left -= n

    @staticmethod
    def _batch(head: np.void, r: np.ndarray) -> pa.RecordBatch:
        whole = lambda v: pa.array(np.ascontiguousarray(v, np.int64))
        real = lambda c: pa.array(np.ascontiguousarray(r[c], np.float64))
        atom = pa.array(np.ascontiguousarray(r["atom_id"], np.int64), mask=r["has_atom"] == 0)
        columns = [whole(np.full(len(r), head["frame"])), whole(np.full(len(r), head["time"])), whole(r["trap_id"]), atom, *[real(c) for c in ("x", "y", "intensity", "phase")], whole(r["flags"])]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    name: str | None
    size: int
    frames: int


class FrameWriter(DataSourceWriter):
    """Rows of a task come frame by frame, see `save`; a frame's records beyond HELD_BYTES wait on disk."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.write_id = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = _open(self.path)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{self.write_id}-{task.partitionId():06d}-{task.taskAttemptId()}.frames"
        index, size, key, body = [], 0, None, None
        with tempfile.SpooledTemporaryFile(HELD_BYTES) as body, files.open_output_stream(f"{root}/{name}") as out:
            seen = set()

            def end() -> int:
                """Sends the frame that is held on behind its header."""
                n = body.tell()
                out.write(np.array([(*key, n // RECORD.itemsize)], HEADER).tobytes())
                body.seek(0)
                while chunk := body.read(1 << 20):
                    out.write(chunk)
                body.seek(0)
                body.truncate()
                index.append((key[0], size, HEADER.itemsize + n))
                return HEADER.itemsize + n

            for r in rows:
                if key != (r["frame"], r["time"]):
                    if key is not None:
                        size += end()
                    key = (r["frame"], r["time"])
                    if key in seen:
                        raise ValueError(f"the rows of frame {key} don't stand together")
                    seen.add(key)
                atom = r["atom_id"]
                body.write(struct.pack(LAYOUT, r["trap_id"], atom or 0, atom is not None, r["x"], r["y"], r["intensity"], r["phase"], r["flags"]))
            if key is not None:
                size += end()
        if not index:
            files.delete_file(f"{root}/{name}")
            return Written(None, 0, 0)
        with files.open_output_stream(f"{root}/{name}.index") as out:
            out.write(np.array(index, INDEX).tobytes())
        return Written(name, size, len(index))

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        files.create_dir(f"{root}/_writes", recursive=True)
        kept = [{"name": m.name, "bytes": m.size, "frames": m.frames} for m in messages if m is not None and m.name]
        entry = {"write": self.write_id, "replaces": [w["write"] for w in _writes(files, root)] if self.overwrite else [], "files": kept}
        hidden = f"{root}/_writes/.{self.write_id}.tmp"
        with files.open_output_stream(hidden) as out:
            out.write(json.dumps(entry).encode())
        files.move(hidden, f"{root}/_writes/{self.write_id}.json")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.path)
        for name in _names(files, root):
            if name.startswith(self.write_id):
                files.delete_file(f"{root}/{name}")


class PackedFrames(DataSource):
    """Options: path; split_bytes, the bytes of a file that one task reads."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedFrames)


def save(traps: DataFrame, path: str, mode: str = "append") -> None:
    """Writes traps as frames, each whole in one file, its traps by id. A frame without traps has no rows
    and so no header."""
    register(traps.sparkSession)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    traps.select(*columns).repartition("frame", "time").sortWithinPartitions("frame", "time", "trap_id").write.format(FORMAT).mode(mode).save(path)


def load(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row for each trap of all frames in a folder."""
    register(spark)
    return spark.read.format(FORMAT).option("split_bytes", split_bytes).load(path)
