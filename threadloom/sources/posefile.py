"""A source of pose files, `spark.read.format("poses")`: frames of poses as lines of JSON, an episode a file.

A file is named <anything>_<episode>.jsonl and begins with a line of what it holds: {"first": .., "last": .., "nodes": [..]}. Each further
line is a frame: {"frame": .., "instances": [{"track": .., "score": .., "pose": [[x, y], ..]}, ..]}; a missing node is [null, null].

* Planning makes a partition for each file and range of `split_bytes`, episodes in the order of their numbers (2 before 10).
* Filters on `episode` drop files when the scan is planned; filters on `frame` drop a range when its file's first line says so, and else
  its lines, of which only the number of the frame is read.
* Only the columns of the schema that a reader names are made: `read(spark, path, "frame long, score double")`.
* Files are reached through pyarrow's file systems, so a path may be that of any store they know.

Writing puts each task's episodes into files under temporary names, which the commit renames. A task should hold whole episodes.
"""

from __future__ import annotations

import io
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "poses"
SCHEMA = "episode long, frame long, instance_idx long, track string, score double, pose array<struct<x:double,y:double>>"
NODE = pa.struct([("x", pa.float64()), ("y", pa.float64())])
KINDS = {"episode": pa.int64(), "frame": pa.int64(), "instance_idx": pa.int64(), "track": pa.string(), "score": pa.float64(), "pose": pa.list_(NODE)}
SUFFIX = re.compile(r"_(\d+)\.jsonl$")
FRAME = re.compile(rb'\s*\{\s*"frame"\s*:\s*(-?\d+)')
#: Instances in a batch.
ROWS = 4096


def store(path: str) -> tuple:
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else path.replace("file:", "file://", 1))


@dataclass
class Split(InputPartition):
    path: str
    episode: int
    start: int
    end: int


@dataclass
class Bounds:
    """Values of a column that filters leave."""

    least: float = float("-inf")
    most: float = float("inf")
    some: frozenset | None = None

    def holds(self, value: int) -> bool:
        return self.least <= value <= self.most and (self.some is None or value in self.some)

    def within(self, first: int, last: int) -> bool:
        """Whether any value from first to last may be left."""
        return first <= self.most and last >= self.least and (self.some is None or any(first <= x <= last for x in self.some))

    def takes(self, f: Filter) -> bool:
        if isinstance(f, EqualTo):
            self.some = frozenset([f.value]) & (self.some if self.some is not None else {f.value})
        elif isinstance(f, In):
            self.some = frozenset(f.value) & (self.some if self.some is not None else frozenset(f.value))
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.least = max(self.least, f.value + (1 if isinstance(f, GreaterThan) else 0))
        elif isinstance(f, LessThan | LessThanOrEqual):
            self.most = min(self.most, f.value - (1 if isinstance(f, LessThan) else 0))
        else:
            return False
        return True


class PoseReader(DataSourceReader):
    def __init__(self, columns: list[str], path: str, split_bytes: int):
        self.columns, self.path, self.split_bytes = columns, path, split_bytes
        self.bounds = {"episode": Bounds(), "frame": Bounds()}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ("",))
            if not (len(column) == 1 and column[0] in self.bounds and self.bounds[column[0]].takes(f)):
                yield f

    def partitions(self) -> Sequence[Split]:
        from pyarrow import fs

        files, where = store(self.path)
        found = [(int(m[1]), x) for x in files.get_file_info(fs.FileSelector(where)) if x.is_file and (m := SUFFIX.search(x.base_name))]
        out = [Split(x.path, episode, a, min(x.size, a + self.split_bytes)) for episode, x in sorted(found, key=lambda f: (f[0], f[1].path)) if self.bounds["episode"].holds(episode) for a in range(0, x.size, self.split_bytes)]
        return out or [Split("", -1, 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in self.columns}
        n = 0
        for frame, instances in self.frames(split):
            for k, one in enumerate(instances):
                row = {"episode": split.episode, "frame": frame, "instance_idx": k, "track": one.get("track"), "score": one.get("score")}
                if "pose" in held:
                    row["pose"] = [{"x": x, "y": y} for x, y in one.get("pose") or ()]
                for c, values in held.items():
                    values.append(row[c])
                n += 1
                if n >= ROWS:
                    yield self.batch(held, n)
                    held, n = {c: [] for c in self.columns}, 0
        if n:
            yield self.batch(held, n)

    def batch(self, held: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, KINDS[c]) for c, v in held.items()], list(held))

    def frames(self, split: Split) -> Iterator[tuple[int, list[dict]]]:
        """The frames whose lines begin in the range."""
        if not split.path:
            return
        files, _ = store(self.path)
        frames = self.bounds["frame"]
        with files.open_input_file(split.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)
            told = json.loads(f.readline() or b"{}")
            if "first" in told and not frames.within(told["first"], told["last"]):
                return
            if split.start > f.tell():
                f.seek(split.start - 1)
                # what began before belongs to the range before; if it goes on to the end of this one, no line begins here
                if not f.readline(split.end - split.start).endswith(b"\n"):
                    return
            while f.tell() < split.end and (line := f.readline()):
                m = FRAME.match(line)
                if m is None or frames.holds(int(m[1])):
                    if line.strip():
                        said = json.loads(line)
                        if m or frames.holds(said["frame"]):
                            yield said["frame"], said["instances"]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class PoseWriter(DataSourceWriter):
    """Rows of whole episodes, sorted by episode, frame and instance_idx. An episode's lines wait in a local file, as the first line says its last frame."""

    def __init__(self, columns: list[str], path: str):
        self.columns, self.path = columns, path

    def write(self, rows: Iterator) -> Written:
        files, where = store(self.path)
        out: list[tuple[str, str]] = []
        with tempfile.TemporaryFile() as held:
            now, frame, first, last = None, None, None, None

            def flushed() -> None:
                name = f"{where}/.{uuid.uuid4().hex}"
                files.create_dir(where, recursive=True)
                held.write(b"]}\n")
                held.seek(0)
                with files.open_output_stream(name) as f:
                    f.write((json.dumps({"first": first, "last": last}) + "\n").encode())
                    shutil.copyfileobj(held, f, 1 << 20)
                out.append((name, f"{where}/poses_{now}.jsonl"))
                held.seek(0)
                held.truncate()

            for r in rows:
                row = dict(zip(self.columns, r, strict=True))
                if row["episode"] != now:
                    if first is not None:
                        flushed()
                    now, frame, first, last = row["episode"], None, row["frame"], row["frame"]
                if row["frame"] == frame:
                    held.write(b", ")
                else:
                    held.write((b"" if frame is None else b"]}\n") + f'{{"frame": {row["frame"]}, "instances": ['.encode())
                    frame, first, last = row["frame"], min(first, row["frame"]), max(last, row["frame"])
                held.write(json.dumps({"track": row.get("track"), "score": row.get("score"), "pose": [[p["x"], p["y"]] for p in row["pose"] or ()]}).encode())
            if first is not None:
                flushed()
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        for a, b in (pair for m in messages if m for pair in m.files):
            files.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        for a, _ in (pair for m in messages if m for pair in m.files):
            files.delete_file(a)


class PoseSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> PoseReader:
        unknown = set(schema.names) - set(KINDS)
        if unknown:
            raise ValueError(f"pose files have no columns {sorted(unknown)}")
        return PoseReader(schema.names, self.options["path"], int(self.options.get("split_bytes", 16 << 20)))

    def writer(self, schema: T.StructType, overwrite: bool) -> PoseWriter:
        return PoseWriter(schema.names, self.options["path"])


def registered(spark: SparkSession) -> None:
    spark.dataSource.register(PoseSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, schema: str = SCHEMA, split_bytes: int = 16 << 20) -> DataFrame:
    registered(spark)
    return spark.read.format(NAME).schema(schema).option("path", path).option("split_bytes", split_bytes).load()


def write(poses: DataFrame, path: str) -> None:
    """poses: episode, frame, instance_idx, track, score, pose. An episode goes to one file."""
    registered(poses.sparkSession)
    order = ["episode", "frame", "instance_idx"]
    poses.select(*order, "track", "score", "pose").repartition("episode").sortWithinPartitions(*order).write.format(NAME).option("path", path).mode("append").save()
