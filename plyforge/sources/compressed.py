"""Text files compressed with zstd, read as streams: a file is never held as a whole. One task per file, as such a file cannot be split."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.sources.binary import _open
from plyforge.sources.pgn import parse_pgn

ROWS = 2000


def _pieces(lines: Iterator[str], mark: str) -> Iterator[str]:
    """Lines, or with a ``mark`` records that begin with a line that begins with it."""
    if not mark:
        yield from (x.rstrip("\r\n") for x in lines)
        return
    held: list[str] = []
    for line in lines:
        if line.startswith(mark) and held:
            yield "".join(held)
            held = []
        held.append(line)
    if held:
        yield "".join(held)


def _read(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                with system.open_input_stream(at, compression=None) as raw, zstandard.ZstdDecompressor(max_window_size=1 << 31).stream_reader(raw, read_across_frames=True) as data:
                    rows: list[str] = []
                    for piece in _pieces(io.TextIOWrapper(data, "utf-8", errors="replace", newline="\n"), mark):
                        rows.append(piece)
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(rows)], ["value"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(rows)], ["value"])

    return run


def read_zst_text(spark: SparkSession, path: str, mark: str = "") -> DataFrame:
    """``value``: the lines of every ``.zst`` file in a folder (or of one file), or the records that begin with ``mark``."""
    system, at = _open(path)
    info = system.get_file_info(at)
    found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.path.endswith(".zst")] if info.type == fs.FileType.Directory else [at]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    files = spark.createDataFrame([(prefix + f,) for f in sorted(found)], "path string")  # one row a file
    return files.repartition(max(1, len(found))).mapInArrow(_read(mark), "value string")


def read_zst_pgn(spark: SparkSession, path: str, strict: bool = False, first: str = "Event") -> DataFrame:
    return parse_pgn(read_zst_text(spark, path, f"[{first} "), strict=strict)


def read_zst_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the columns of ``schema``."""
    return read_zst_text(spark, path).where("value <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")
