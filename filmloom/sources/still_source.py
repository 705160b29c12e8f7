"""Folders of stills as a Spark data source: ``spark.read.format("stills")`` and ``df.write.format("stills")``.

Reading: a folder is a clip. Conditions on clip_id and frame_idx and the option
``frames`` (such as 0-120:20) choose files by name before any is opened; the
others stay unread. A partition is a stretch of one clip. Writing: every task
writes into a folder of its own below ``_staging``; files come to their places
when all tasks are done, and nothing is left of a write that failed.
"""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from ..config import parse_frames
from ..operators.pairing import STILL_SUFFIXES
from . import files, stills
from .frames import FRAME, array_of, frame_row

SCHEMA = f"{FRAME}, path string, error string, seconds double"
_ARROW = pa.schema(
    [("clip_id", pa.string()), ("frame_idx", pa.int64()), ("name", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("data", pa.binary()), ("path", pa.string()), ("error", pa.string()), ("seconds", pa.float64())]
)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with its conditions pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Stills)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stills below ``path``, which without an address lies in Spark's default store."""
    register(spark)
    return spark.read.format("stills").options(**{k: str(v) for k, v in options.items()}).load(files.qualified(spark, path))


def save(frames: DataFrame, path: str) -> None:
    register(frames.sparkSession)
    frames.write.format("stills").mode("append").save(files.qualified(frames.sparkSession, path))


@dataclass
class Stretch(ds.InputPartition):
    clip_id: str
    frames: list[tuple[int, str]]


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str


class Stills(ds.DataSource):
    """Options: path; rgb (true: three channels of 8 bits); stretch, frames a partition; frames; on_error, raise or row."""

    @classmethod
    def name(cls) -> str:
        return "stills"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ds.DataSourceWriter:
        if overwrite:
            raise ValueError("stills are added to a folder; mode overwrite is not known")
        return Writer(dict(self.options), [f.name for f in schema.fields])


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.rgb = options.get("rgb", "true").lower() == "true"
        self.stretch = max(1, int(options.get("stretch", "32")))
        self.chosen = set(parse_frames(options["frames"])) if "frames" in options else None
        self.rows = options.get("on_error", "raise") == "row"
        self.tests: list[tuple[str, str, object]] = []
        if not self.path:
            raise ValueError("stills need a path")

    def pushFilters(self, filters):
        known = {ds.EqualTo: "eq", ds.In: "in", ds.GreaterThan: "gt", ds.GreaterThanOrEqual: "ge", ds.LessThan: "lt", ds.LessThanOrEqual: "le"}
        for f in filters:
            kind = known.get(type(f))
            if kind and f.attribute in (("clip_id",), ("frame_idx",)):
                self.tests.append((kind, f.attribute[0], f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute in (("clip_id",), ("frame_idx",))):
                yield f

    def _wanted(self, clip: str, index: int) -> bool:
        if self.chosen is not None and index not in self.chosen:
            return False
        for kind, column, value in self.tests:
            own = clip if column == "clip_id" else index
            if not {
                "eq": lambda: own == value, "in": lambda: own in value, "gt": lambda: own > value, "ge": lambda: own >= value,
                "lt": lambda: own < value, "le": lambda: own <= value,
            }[kind]():
                return False
        return True

    def partitions(self) -> list[Stretch]:
        """Names are listed here, contents are read in the tasks."""
        store, root = files.located(self.path)
        base = re.sub(r"^(?:file:)?/+", "file:/", self.path.rstrip("/"))
        clips: dict[str, list[tuple]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            stem, dot, suffix = info.base_name.rpartition(".")
            if info.type == fs.FileType.File and f".{suffix.lower()}" in STILL_SUFFIXES and dot and "/_staging/" not in info.path:
                digits = re.search(r"(\d+)\D*$", stem)
                clips.setdefault(info.path.rsplit("/", 1)[0], []).append((int(digits[1]) if digits else -1, info.base_name.lower(), info.path))
        out = []
        for folder in sorted(clips):
            clip = base + folder[len(root) :]
            kept = [(i, path) for i, (_, _, path) in enumerate(sorted(clips[folder])) if self._wanted(clip, i)]
            out += [Stretch(clip, kept[s : s + self.stretch]) for s in range(0, len(kept), self.stretch)]
        return out or [Stretch("", [])]

    def read(self, partition: Stretch):
        store, _ = files.located(self.path)
        for index, path in partition.frames:
            start, made, failed = time.perf_counter(), (None,) * 5, None
            try:
                with store.open_input_stream(path) as f:
                    made = frame_row(f.read(), self.rgb)
            except (OSError, ValueError) as e:
                if not self.rows:
                    raise
                failed = f"{type(e).__name__}: {e}"
            row = (partition.clip_id, index, path.rsplit("/", 1)[-1], *made, path, failed, time.perf_counter() - start)
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _ARROW)], schema=_ARROW)


class Writer(ds.DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options.get("path", "").rstrip("/"), columns
        self.staging = f"{self.path}/_staging/{uuid.uuid4().hex}"
        missing = {"clip_id", "name", "height", "width", "channels", "bits", "data"} - set(columns)
        if missing or not self.path:
            raise ValueError(f"stills need a path and the columns {', '.join(sorted(missing))}" if missing else "stills need a path")

    def write(self, iterator) -> Written:
        own = f"{self.staging}/{uuid.uuid4().hex}"
        store, base = files.located(own)
        for row in iterator:
            r = row.asDict()
            stem, dot, ext = r["name"].rpartition(".")
            ext = f".{ext.lower()}" if dot and f".{ext.lower()}" in (".png", ".pgm", ".ppm") else ".png"
            folder = f"{base}/{re.sub(r'/+$', '', r['clip_id']).rsplit('/', 1)[-1]}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{stem or r['name']}{ext}") as f:
                f.write(stills.encode(array_of(bytes(r["data"]), r["height"], r["width"], r["channels"], r["bits"]), ext))
        return Written(own)

    def commit(self, messages) -> None:
        """Two clips of one name, or a file that is there already, end the write before any file is moved."""
        store, root = files.located(self.path)
        moves: dict[str, str] = {}
        try:
            for m in filter(None, messages):
                _, base = files.located(m.folder)
                for info in store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                    if info.type == fs.FileType.File:
                        to = f"{root}/{info.path[len(base) + 1 :]}"
                        if to in moves or store.get_file_info(to).type != fs.FileType.NotFound:
                            raise FileExistsError(f"{to} would be written twice")
                        moves[to] = info.path
            for to, part in moves.items():
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                store.move(part, to)
        finally:
            self.abort(messages)

    def abort(self, messages) -> None:
        store, staging = files.located(self.staging)
        if store.get_file_info(staging).type != fs.FileType.NotFound:
            store.delete_dir(staging)
        parent = staging.rsplit("/", 1)[0]
        if store.get_file_info(parent).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(parent)):
            store.delete_dir(parent)
