"""A data source `packed_scripts`: many cut scripts a file, with an index, committed as a whole."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "video_id bigint, script string"
MANIFEST = "_manifest.json"
INDEX = pa.schema([("video_id", pa.int64()), ("start", pa.int64()), ("bytes", pa.int64())])


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: the name of its part, none where it had no rows."""

    name: str | None


@dataclass
class PartToRead(InputPartition):
    name: str


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _committed(path: str) -> list[str]:
    """The parts that the last commit named; none where nothing was committed."""
    store, folder = _folder(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


def _delete(path: str, names: list[str]) -> None:
    store, folder = _folder(path)
    for file in (f"{folder}/{name}.{kind}" for name in names for kind in ("txt", "index")):
        if store.get_file_info(file).type != fs.FileType.NotFound:
            store.delete_file(file)


class PackedWriter(DataSourceArrowWriter):
    """A task writes one part: its scripts end to end, and where each is.  Names are new for each attempt, so a
    retried or doubled task leaves at most a part that no manifest names and no reader reads."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, folder = _folder(self.path)
        name, out, index, at, rows = f"part-{uuid.uuid4().hex}", None, None, 0, 0
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    store.create_dir(folder, recursive=True)
                    out = store.open_output_stream(f"{folder}/{name}.txt")
                    index = pq.ParquetWriter(f"{folder}/{name}.index", INDEX, filesystem=store)
                starts, sizes = [], []
                for script in batch.column("script").to_pylist():
                    data = None if script is None else script.encode()
                    starts.append(at)
                    sizes.append(None if data is None else len(data))
                    if data:
                        out.write(data)
                        at += len(data)
                index.write_table(pa.table([batch.column("video_id").cast(pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=INDEX))
                rows += batch.num_rows
        finally:
            for file in (out, index):
                if file is not None:
                    file.close()
        return Part(name if rows else None)

    def commit(self, messages: list[Part | None]) -> None:
        """The new parts count from the moment that the manifest is replaced by one that names them."""
        store, folder = _folder(self.path)
        store.create_dir(folder, recursive=True)
        before = _committed(self.path)
        named = [m.name for m in messages if m is not None and m.name]
        draft = f"{folder}/{MANIFEST}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"parts": named if self.overwrite else before + named}).encode())
        store.move(draft, f"{folder}/{MANIFEST}")
        if self.overwrite:
            _delete(self.path, before)

    def abort(self, messages: list[Part | None]) -> None:
        _delete(self.path, [m.name for m in messages if m is not None and m.name])


class PackedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[PartToRead]:
        return [PartToRead(name) for name in _committed(self.path)]

    def read(self, partition: PartToRead | None) -> Iterator[tuple[int | None, str | None]]:
        if not isinstance(partition, PartToRead):
            return
        store, folder = _folder(self.path)
        with store.open_input_stream(f"{folder}/{partition.name}.txt") as f:
            for batch in pq.ParquetFile(f"{folder}/{partition.name}.index", filesystem=store).iter_batches():
                for video, size in zip(batch.column("video_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                    yield video, None if size is None else f.read(size).decode()


class PackedScripts(DataSource):
    """`path` is a folder that the driver and all executors share, local or a URI that pyarrow opens.

    Appending keeps the parts that are there, overwriting lets them go once the new ones are committed.  One
    writer at a time: of two that commit together the later one wins.
    """

    @classmethod
    def name(cls) -> str:
        return "packed_scripts"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: object, overwrite: bool) -> PackedWriter:
        return PackedWriter(self.options["path"], overwrite)

    def reader(self, schema: object) -> PackedReader:
        return PackedReader(self.options["path"])


def write_scripts(scripts: DataFrame, path: str, mode: str = "append") -> None:
    """Scripts (video_id, script) to `path`, at most one part a task; `mode` is append or overwrite."""
    scripts.sparkSession.dataSource.register(PackedScripts)
    rows = scripts.selectExpr("CAST(video_id AS bigint) AS video_id", "CAST(script AS string) AS script")
    rows.write.format("packed_scripts").mode(mode).option("path", path).save()


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, script) of all committed parts."""
    spark.dataSource.register(PackedScripts)
    return spark.read.format("packed_scripts").option("path", path).load()
