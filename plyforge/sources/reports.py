"""Reports and the metadata of a corpus as JSON files, through the file system of the path (Hadoop's, so any cluster's)."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.operators import encode, stage1
from plyforge.operators import vocab as V
from plyforge.sources.binary import _open


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One file, written part by part."""
    system, p = _at(spark, path)
    out = system.create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode()))
    finally:
        out.close()


def _compressing(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        system, root = _open(path)
        system.create_dir(root, recursive=True)
        name, n = f"{root}/{uuid.uuid4().hex}.zst", 0
        with system.open_output_stream(f"{name}.part", compression=None) as raw, zstandard.ZstdCompressor().stream_writer(raw) as out:
            for batch in batches:
                for line in batch.column(0).to_pylist():
                    out.write((line or "").encode() + b"\n")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    return run


def write_zst(lines: DataFrame, path: str) -> int:
    """Lines of text as files compressed with zstd, one per task; a file gets its name once its task is known to have ended, so repeated tasks leave nothing."""
    done = lines.mapInArrow(_compressing(path), "file string, n long").collect()  # one row a task
    system, root = _open(path)
    for r in done:
        system.move(f"{r['file']}.part", r["file"])
    for f in system.get_file_info(fs.FileSelector(root)):
        if f.path.endswith(".part"):
            system.delete_file(f.path)
    return sum(r["n"] for r in done)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _object(pairs: Iterable[tuple[str, object]]) -> Iterable[str]:
    yield "{"
    for i, (k, v) in enumerate(pairs):
        yield ("," if i else "") + f"\n {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}"
    yield "\n}\n"


def write_token_frequency(counts: DataFrame, path: str) -> None:
    """``{token: count}``, the most frequent first, ties by name; the rows are sorted on the cluster and pass the driver one partition at a time."""
    rows = counts.orderBy(F.desc("n"), "token").select("token", "n")
    write_text(counts.sparkSession, path, _object((r["token"], r["n"]) for r in rows.toLocalIterator()))


def write_stage1_stats(raw: DataFrame, path: str, min_elo: int = 1600, min_plies: int = 20) -> dict:
    """The Stage-1 report as one JSON object."""
    began = time.time()
    r = stage1.stats(raw, min_elo, min_plies).first()
    report = {
        "games": r["games"], "plies": r["plies"], "tokens": r["tokens"], "vocab_size": r["distinct_tokens"], "san_parse_errors": r["parse_errors"],
        "glyph_vs_computed_disagreement_plies": r["disagreement_plies"], "elapsed_sec": round(time.time() - began, 1),
    }
    write_text(raw.sparkSession, path, _object(report.items()))
    return report


def write_stage2_stats(games: DataFrame, path: str, top: int = 20, **options) -> dict:
    """The Stage-2 report as one JSON object: the counters, the split rule, the dropout, and the most frequent tokens outside the dictionary."""
    began = time.time()
    filters = {k: options[k] for k in ("min_elo", "max_elo", "min_plies") if k in options}
    report = encode.stats(games, **options).first().asDict()
    months = options.get("months", ())
    unknown = encode.unknown_tokens(encode.filtered(games, **filters), top).collect()  # ``top`` rows
    report |= {
        "shards": len(games.inputFiles()), "split": "months:" + ",".join(sorted(months)) if months else f"frac:{options.get('fraction', 0.05)}", "elo_dropout": options.get("dropout", 0.0),
        "unknown_token_top": {r["token"]: r["n_games"] for r in unknown}, "vocab_size": len(V.tokens()), "elapsed_sec": round(time.time() - began, 1),
    }
    write_text(games.sparkSession, path, _object(report.items()))
    return report


def metadata() -> dict:
    """What a reader of the packed corpus must know of its dictionary."""
    number = V.ids()
    ends = dict(zip(("white_resign_id", "black_resign_id", "white_flag_id", "black_flag_id", "draw_id"), (number[t] for t in V.ENDINGS)))
    return {
        "vocab_size": len(number), "stoi": number, "itos": {str(i): t for t, i in number.items()}, "bos_id": number[V.BOS], "eos_id": number[V.EOS], "core_count": V.CORE_COUNT,
        "elo_tokens": list(V.ELO_BUCKETS), "elo_any_id": number[V.ELO_ANY], **ends,
    }


def write_metadata(spark: SparkSession, path: str) -> None:
    write_text(spark, path, _object(metadata().items()))


def read_metadata(spark: SparkSession, path: str) -> dict:
    """The metadata of a corpus, or an error if it is not of a dictionary that the operators can read.

    Tested are: the core count is there; ids and tokens name each other; the start and end tokens exist; the labels follow the modifiers, which follow the core.
    The end tokens may be missing (older corpora).
    """
    meta = read_json(spark, path)
    if "core_count" not in meta:
        raise KeyError("the metadata have no core_count: an old format, pack the corpus again")
    number = meta["stoi"]
    for t in (V.BOS, V.EOS, *V.LABEL_WORDS.values()):
        if t not in number:
            raise KeyError(f"the dictionary lacks {t}")
    first = meta["core_count"] + len(V.MODIFIERS)
    if [number[t] for t in V.LABEL_WORDS.values()] != list(range(first, first + len(V.LABEL_WORDS))):
        raise ValueError("the labels do not follow the modifiers: another layout of the dictionary")
    if len(number) != meta["vocab_size"] or any(meta["itos"].get(str(i)) != t for t, i in number.items()):
        raise ValueError("ids and tokens do not name each other")
    return meta
