"""The flat corpus format: per partition a file of little-endian 16-bit ids and a file of 64-bit game starts with the total at the end.

A Python data source, ``token_bin``, for any file system that Arrow knows (local or mounted folders, HDFS, object stores): writing takes ``split string, row_id bigint, start bigint, ids array<int>``; every task writes its
own pair of files, and a file name appears only when the job commits. Reading gives the games back, one task per file.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "split string, part string, game int, ids array<int>"
CHUNK = 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    temporary: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        name, files, starts, paths = uuid.uuid4().hex, {}, {}, {}
        try:
            for row in rows:
                s = row["split"]
                if s not in files:
                    paths[s] = f"{root}/.{s}-{row['start']:020d}-{name}"  # names sort as the stream does
                    files[s] = system.open_output_stream(f"{paths[s]}.bin")
                    starts[s] = [0]
                ids = np.asarray(row["ids"], "<u2")
                files[s].write(ids.tobytes())
                starts[s].append(starts[s][-1] + len(ids))
        finally:
            for f in files.values():
                f.close()
        for s, at in starts.items():
            with system.open_output_stream(f"{paths[s]}.idx") as f:
                f.write(np.asarray(at, "<u8").tobytes())
        return _Written([f"{p}.{kind}" for p in paths.values() for kind in ("bin", "idx")])

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        for m in messages:
            for t in m.temporary if m else []:
                system.move(t, f"{root}/{t.rpartition('/')[2][1:]}")

    def abort(self, messages) -> None:
        system, _ = _open(self.path)
        for m in messages:
            for t in m.temporary if m else []:
                if system.get_file_info(t).type == fs.FileType.File:
                    system.delete_file(t)


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        system, root = _open(self.path)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(root))]
        return [InputPartition(n) for n in sorted(names) if n.endswith(".bin") and not n.startswith(".")]

    def read(self, partition):
        if partition is None or partition.value is None:
            return
        system, root = _open(self.path)
        name = partition.value
        total = system.get_file_info(f"{root}/{name}").size // 2
        index = f"{root}/{name[:-4]}.idx"
        at = None
        if system.get_file_info(index).type == fs.FileType.File:
            with system.open_input_stream(index) as f:
                at = np.frombuffer(f.read(), "<u8").astype(np.int64)
        with system.open_input_file(f"{root}/{name}") as f:
            part = lambda a, b: np.frombuffer(f.read_at(2 * (b - a), 2 * a), "<u2")
            if at is None or not valid(at, total):
                at = scan(part, total)
            for a in range(0, len(at) - 1, CHUNK):
                b = min(a + CHUNK, len(at) - 1)
                ids = pa.array(part(int(at[a]), int(at[b])).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array((at[a : b + 1] - at[a]).astype(np.int32)), ids)
                n = b - a
                yield pa.RecordBatch.from_arrays([pa.array([name.split("-")[0]] * n), pa.array([name] * n), pa.array(np.arange(a, b, dtype=np.int32)), lists], ["split", "part", "game", "ids"])


def valid(starts: np.ndarray, total: int) -> bool:
    """An index starts at 0, ends at the total, and grows."""
    return len(starts) >= 2 and starts[0] == 0 and starts[-1] == total and bool((np.diff(starts) > 0).all())


def scan(part, total: int, chunk: int = 1 << 24) -> np.ndarray:
    """Game starts found by the start token, in chunks, with the total at the end; ``part(a, b)`` gives the tokens from ``a`` to ``b``. An error if the data do not begin with a start token."""
    from plyforge.operators.vocab import BOS, ids

    bos = ids()[BOS]
    found = [np.flatnonzero(part(i, min(i + chunk, total)) == bos) + i for i in range(0, total, chunk)]
    at = np.concatenate([*found, [total]]).astype(np.int64)
    if not valid(at, total):
        raise ValueError("no game starts: empty data, or data that do not begin with a start token")
    return at


class TokenBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_bin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_corpus(corpus: DataFrame, path: str) -> None:
    """Write a packed corpus in its order: ranges of ``start`` per file, so that the files of a split in order of their names are its stream."""
    corpus.sparkSession.dataSource.register(TokenBin)
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = corpus.select("split", "row_id", "start", "ids").repartitionByRange(parts, "split", "start").sortWithinPartitions("split", "start")
    ordered.write.format("token_bin").mode("append").save(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TokenBin)
    return spark.read.format("token_bin").load(path)


def single_streams(path: str, out: str, chunk: int = 1 << 24) -> dict[str, int]:
    """The corpus as one ``<split>.bin`` per split and its ``<split>.idx.npy`` (game starts and the total), for trainers that map one file; the tokens of each.

    Files are copied one after the other in pieces of ``chunk`` bytes; only the starts (8 bytes a game) are held. For corpora that fit one disk.
    """
    system, root = _open(path)
    target, to = _open(out)
    target.create_dir(to, recursive=True)
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".bin") and not i.base_name.startswith("."))
    totals: dict[str, int] = {}
    for split in dict.fromkeys(n.split("-")[0] for n in names):
        starts, total = [], 0
        with target.open_output_stream(f"{to}/{split}.bin") as sink:
            for n in (n for n in names if n.split("-")[0] == split):
                with system.open_input_stream(f"{root}/{n[:-4]}.idx") as f:
                    at = np.frombuffer(f.read(), "<u8").astype(np.int64)
                starts.append(at[:-1] + total)
                total += int(at[-1])
                with system.open_input_stream(f"{root}/{n}") as f:
                    while data := f.read(chunk):
                        sink.write(data)
        held = io.BytesIO()
        np.save(held, np.concatenate([*starts, [total]]).astype(np.uint64))
        with target.open_output_stream(f"{to}/{split}.idx.npy") as f:
            f.write(held.getvalue())
        totals[split] = total
    return totals
