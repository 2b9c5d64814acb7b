"""Occurrences and record frequency of every distinct term (problem 4).

Method: an external sort of (term, record) pairs, range-partitioned, with run-length scans.

1. *Pairs.* Every record gets an identifier of its own, also where its row is repeated; each of its terms becomes a pair (term,
   record) with the times it occurs in the record.
2. *Range partition and sort.* The pairs are range-partitioned by (term, record) and sorted in Spark's spilling sort. A term in a
   third of all records thus spans as many ranges as it needs; no task holds a term as a whole.
3. *Run-length scan.* Each sorted partition is scanned once: a run of a term gives its occurrences and, by the changes of the
   record within it, its records.
4. *Stitching.* A term whose run crosses the border of a range has a run on each side; the runs are added up. A record's pairs
   with one term are one pair, so it is never counted on both sides.

Defined results: null and empty streams count as records without terms; repeated rows each count as a record; an empty table
gives no rows; the empty term is a term like any other; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.streams import split_tokens
from plyforge.sources.tables import materialize


def _pairs(split: Callable[[str | None], list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code: dict[str, int] = {}
            found = [split(t) for t in batch.column(1).to_pylist()]
            size = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((code.setdefault(t, len(code)) for f in found for t in f), np.int64, int(size.sum()))
            pair, times = np.unique(ids * max(1, len(found)) + np.repeat(np.arange(len(found)), size), return_counts=True)
            term, record = np.divmod(pair, max(1, len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(list(code), pa.string()).take(pa.array(term)), batch.column(0).take(pa.array(record)), pa.array(times.astype(np.int32))], ["term", "record", "times"])

    return run


def pairs(df: DataFrame, column: str = "tokens", split: Callable[[str | None], list[str]] = split_tokens) -> DataFrame:
    """``term, record, times``: each term of each record, with an identifier of the record."""
    rows = df.select(F.monotonically_increasing_id().alias("record"), F.col(f"`{column}`").alias("text")).where(F.col("text") != "")
    return rows.mapInArrow(_pairs(split), "term string, record long, times int")


def ranged(found: DataFrame) -> DataFrame:
    """The pairs in ranges of (term, record), sorted; written first, as finding the ranges reads them too."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(found, "p4-pairs").repartitionByRange(parts, "term", "record").sortWithinPartitions("term", "record")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan over pairs sorted by (term, record); a run may go on in the next batch."""
    held: list | None = None  # term, occurrences, records, last record
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column(0).dictionary_encode()
        code, record, times = terms.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        new_term = np.r_[True, code[1:] != code[:-1]]
        new_record = new_term | np.r_[True, record[1:] != record[:-1]]
        start = np.flatnonzero(new_term)
        names = terms.dictionary.take(pa.array(code[start])).to_pylist()
        occurrences, records = np.add.reduceat(times.astype(np.int64), start), np.add.reduceat(new_record.astype(np.int64), start)
        if held and held[0] == names[0]:
            occurrences[0] += held[1]
            records[0] += held[2] - (held[3] == record[0])
        elif held:
            yield _runs([held[0]], [held[1]], [held[2]])
        held = [names[-1], int(occurrences[-1]), int(records[-1]), int(record[-1])]
        if len(start) > 1:
            yield _runs(names[:-1], occurrences[:-1], records[:-1])
    if held:
        yield _runs([held[0]], [held[1]], [held[2]])


def _runs(terms: list[str], occurrences, records) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(occurrences, pa.int64()), pa.array(records, pa.int64())], ["term", "n_occurrences", "n_records"])


def term_frequency(df: DataFrame, column: str = "tokens", split: Callable[[str | None], list[str]] = split_tokens) -> DataFrame:
    """``term, n_occurrences, n_records`` of every distinct term of ``column``."""
    runs = ranged(pairs(df, column, split)).mapInArrow(_scan, "term string, n_occurrences long, n_records long")
    return runs.groupBy("term").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def marked(df: DataFrame, column: str = "tokens", rare: int = 3, common: float = 0.3) -> DataFrame:
    """``term_frequency`` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than the share ``common`` of all, else null.

    The total is the row count, taken from the Parquet footers. In a table so small that both hold, ``rare`` wins.
    """
    total = df.count()
    return term_frequency(df, column).withColumn("mark", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > common * total, "common"))
