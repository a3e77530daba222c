"""Snapshot files as a stream (SRC4): a Python data source whose offset is the name of the last file read.

Names are times (`YYYY.MM.DD.HH.MM.SS`), so the order of names is that of time, whatever the files' modification times. A micro-batch
holds the next `files` names behind the offset (0: all there are), read by tasks of up to TASK_FILES files each through
pyarrow's file systems (local paths, hdfs://, s3://, gs://). The offset lives in the query's checkpoint, so a restart goes on
behind the last file and reads none twice. A file that appears later with an earlier name is not read.

    spark.dataSource.register(SnapshotSource)
    spark.readStream.format("snapshots").option("files", 1).option("checkpoint", ck).load(path)

Options: `files`; `checkpoint`, the query's checkpoint location, which tells a restarted reader where to go on (needed
with `files`); `equipment` (default: the folder's name); `channels`, comma-separated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .snapshots import CHANNELS

SCHEMA = "E string, T timestamp, file string, channel string, samples array<double>"
NAME = re.compile(r"\d{4}(\.\d{2}){5}")
#: files that one task reads at most, and the tasks over which fewer files are spread
TASK_FILES, SPREAD = 256, 32


def snapshot_time(name: str) -> datetime | None:
    """Time of a snapshot file, None for other names."""
    if not NAME.fullmatch(name):
        return None
    try:
        return datetime.strptime(name, "%Y.%m.%d.%H.%M.%S")
    except ValueError:
        return None


def _names(path: str) -> list[str]:
    files, root = fs.FileSystem.from_uri(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file and snapshot_time(f.base_name) is not None)


def _planned(checkpoint: str) -> str:
    """The offset that the query's checkpoint has planned last ('' without one)."""
    files, root = fs.FileSystem.from_uri(checkpoint)
    log = files.get_file_info(fs.FileSelector(f"{root}/offsets", allow_not_found=True))
    batches = [f for f in log if f.base_name.isdigit()]
    if not batches:
        return ""
    with files.open_input_file(max(batches, key=lambda f: int(f.base_name)).path) as f:
        # a version line, the query's settings, then a line per source
        lines = f.read().decode().splitlines()
    return json.loads(lines[2])["file"] if len(lines) > 2 and lines[2].startswith("{") else ""


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SnapshotStreamReader(dict(self.options))


class SnapshotStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.files = int(options.get("files", 0))
        self.checkpoint = options.get("checkpoint")
        self.equipment = options.get("equipment", self.path.rpartition("/")[2])
        self.channels = options["channels"].split(",") if "channels" in options else list(CHANNELS)
        self.at: str | None = None
        if self.files and not self.checkpoint:
            raise ValueError("`files` needs `checkpoint`")

    def initialOffset(self) -> dict:
        return {"file": ""}

    def latestOffset(self) -> dict:
        if self.at is None:
            self.at = _planned(self.checkpoint) if self.checkpoint else ""
        ahead = [n for n in _names(self.path) if n > self.at]
        if ahead:
            self.at = ahead[self.files - 1 if 0 < self.files < len(ahead) else -1]
        return {"file": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = [n for n in _names(self.path) if start["file"] < n <= end["file"]]
        size = min(TASK_FILES, max(1, -(-len(names) // SPREAD)))
        return [InputPartition(names[i:i + size]) for i in range(0, len(names), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, root = fs.FileSystem.from_uri(self.path)
        for name in partition.value:
            with files.open_input_file(f"{root}/{name}") as f:
                rows = [line.split("\t") for line in map(str.strip, f.read().decode().splitlines()) if line]
            for i, channel in enumerate(self.channels):
                samples = [float(r[i]) if i < len(r) else None for r in rows]
                if any(s is not None for s in samples):
                    yield self.equipment, snapshot_time(name), name, channel, samples


def stream_snapshots(spark: SparkSession, path: str, checkpoint: str | None = None, files: int = 0,
                     equipment: str | None = None) -> DataFrame:
    """SRC4: E, T, file, channel, samples of the snapshots in `path`, in the order of their times, `files` per
    micro-batch (0: all there are; else `checkpoint` is the query's checkpoint location)."""
    spark.dataSource.register(SnapshotSource)
    r = spark.readStream.format("snapshots").option("files", files)
    for name, value in (("checkpoint", checkpoint), ("equipment", equipment)):
        if value is not None:
            r = r.option(name, value)
    return r.load(path)


def write_snapshots(rows: DataFrame, path: str) -> None:
    """SNK: a file for each row (file string, lines array<array<double>>), tab-separated, written by the tasks. A
    repeated task writes the same file again."""
    def write(batches):
        files, root = fs.FileSystem.from_uri(path)
        files.create_dir(root, recursive=True)
        for rb in batches:
            for name, lines in zip(rb.column("file").to_pylist(), rb.column("lines").to_pylist()):
                with files.open_output_stream(f"{root}/{name}") as f:
                    f.write("".join("\t".join(map(repr, line)) + "\n" for line in lines).encode())
        yield from ()

    rows.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
