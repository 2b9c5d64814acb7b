"""Cutting oversized token streams into overlapping pieces (problem 2).

Method: content-defined chunking. A rolling hash over the last ``window`` tokens marks landmarks, which depend on the content
near them alone. Past the least length of a piece the first landmark is taken and snapped to the nearest end of a complete move
in the piece's reach; without a landmark in reach, the last such end is taken. An edit thus moves the cuts near it, and the
cuts after the next common landmark stay where they were.

A piece repeats the end of the piece before it: the fewest whole moves that hold ``overlap`` tokens or more, or exactly
``overlap`` tokens where no start of a move is found within ``reach`` tokens. Where no move ends in the whole reach, the cut is
a hard one at the limit.

Defined results: null, empty and short streams (at most ``limit`` tokens) are one piece, or none without tokens; streams
made of modifiers alone are cut hard; repeated rows are cut alike; other columns of the input are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.streams import LABELS, MODIFIERS, split_tokens, tokens_of
from plyforge.sources.tables import materialize

LIMIT, OVERLAP = 256, 8
_OPEN = frozenset(LABELS + MODIFIERS)
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def landmarks(tokens: list[str], window: int = 6, every: int = 16) -> np.ndarray:
    """``out[i]``: whether a cut after token ``i`` is a landmark: the rolling hash of the ``window`` tokens up to it is 0 modulo ``every``."""
    h = np.array([xxhash.xxh64_intdigest(t) for t in tokens], np.uint64)
    roll = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(window):
            roll[k:] += h[: len(h) - k] * np.uint64(pow(_BASE, k, 1 << 64))
        roll *= np.uint64(_BASE)
    mark = (roll >> np.uint64(40)) % np.uint64(every) == 0
    mark[: window - 1] = False
    return mark


def cut(tokens: list[str], limit: int = LIMIT, overlap: int = OVERLAP, least: int = 128, reach: int = 32) -> list[tuple[int, int, int, str]]:
    """Pieces as ``(start, end, repeated, kind)``: half-open ranges, the count of repeated tokens, and how the piece ends (``end``, ``landmark``, ``move`` or ``hard``)."""
    n = len(tokens)
    if n <= limit:
        return [(0, n, 0, "end")] if n else []
    ends = np.flatnonzero([t not in _OPEN for t in tokens]) + 1  # cuts after a complete move
    is_end = np.zeros(n + 1, bool)
    is_end[ends] = True
    starts = is_end.copy()  # a move starts where one has ended, and at 0
    starts[0] = True
    marks = np.flatnonzero(landmarks(tokens)) + 1
    out: list[tuple[int, int, int, str]] = []
    start = done = 0
    while True:
        if n - start <= limit:
            out.append((start, n, done - start, "end"))
            return out
        top = start + limit
        low = min(done + least, top)
        i, j = np.searchsorted(ends, low), np.searchsorted(ends, top, "right")
        if i == j:  # none between the least length and the limit: the last one with which the next piece starts later
            i, low = np.searchsorted(ends, max(done, start + reach), "right"), top + 1
        if i == j:
            at, kind = top, "hard"
        else:
            near = ends[i:j]
            m = np.searchsorted(marks, low)
            if m < len(marks) and marks[m] <= top:
                at, kind = int(near[np.argmin(np.abs(near - marks[m]))]), "landmark"
            else:
                at, kind = int(near[-1]), "move"
        out.append((start, at, done - start, kind))
        done, start = at, at - overlap
        if is_end[at]:
            back = np.flatnonzero(starts[max(at - reach, 0) : at - overlap + 1])
            if len(back):
                start = max(at - reach, 0) + int(back[-1])


def _at_least(text: Column, limit: int) -> Column:
    """Holds for every stream of more than ``limit`` tokens: a token takes two characters or more, but for the last."""
    return F.length(text) >= 2 * limit + 1


def _pieces(limit: int, overlap: int, long_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = split_tokens(text)
                if long_only and len(tokens) <= limit:
                    continue
                found = cut(tokens, limit, overlap)
                rows += [(key, k, len(found), a, b, rep, kind, tokens[a:b]) for k, (a, b, rep, kind) in enumerate(found)]
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            names = ("key", "piece_no", "n_pieces", "start_pos", "end_pos", "n_repeated", "cut", "tokens")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    return run


def pieces(df: DataFrame, key: str = "row_id", column: str = "tokens", limit: int = LIMIT, overlap: int = OVERLAP, long_only: bool = False) -> DataFrame:
    """One row per piece: ``key, piece_no, n_pieces, start_pos, end_pos, n_repeated, cut, tokens``; positions count from 0, the end is exclusive.

    ``long_only`` leaves out streams that need no cut; streams too short in characters then never reach Python.
    """
    text = F.col(f"`{column}`")
    rows = df.select(F.col(f"`{key}`").alias("key"), text.alias("text")).where(text.isNotNull())
    if long_only:
        rows = rows.where(_at_least(F.col("text"), limit))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.mapInArrow(_pieces(limit, overlap, long_only), f"key {kind}, piece_no int, n_pieces int, start_pos int, end_pos int, n_repeated int, cut string, tokens array<string>")
    return out.withColumnRenamed("key", key)


def checks(df: DataFrame, key: str = "row_id", column: str = "tokens", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """What must hold of the pieces of streams with unique keys, in one row.

    Streams, pieces' own tokens (repeated ones left out), pieces past the limit, pieces that do not start where the one before says, that repeat too few,
    that end inside a move although they were not cut hard, and that differ from their place in the stream.
    """
    cut_ = materialize(pieces(df, key, column, limit, overlap), "p2-pieces")
    before = cut_.select(F.col(key), (F.col("piece_no") + 1).alias("piece_no"), F.col("end_pos").alias("end_before"))
    stream = df.select(F.col(key), tokens_of(F.col(column)).alias("stream"))
    each = cut_.join(before, [key, "piece_no"], "left").join(stream, key)
    later, size = F.col("piece_no") > 0, F.col("end_pos") - F.col("start_pos")
    return each.agg(
        F.count_if(~later).alias("n_streams"),
        F.coalesce(F.sum(size - F.col("n_repeated")), F.lit(0)).alias("n_tokens"),
        F.count_if(size > limit).alias("n_over"),
        F.count_if(later & ~F.col("start_pos").eqNullSafe(F.col("end_before") - F.col("n_repeated"))).alias("n_torn"),
        F.count_if(later & (F.col("n_repeated") < overlap)).alias("n_short"),
        F.count_if(F.col("cut").isin("landmark", "move") & F.element_at("tokens", -1).isin(*_OPEN)).alias("n_open"),
        F.count_if(F.col("tokens") != F.slice("stream", F.col("start_pos") + 1, size)).alias("n_changed"),
    )
