"""Same or near-same records across splits (problem 1).

A training row and an evaluation row overlap if (a) without accuracy labels both streams have at least 40 tokens and their
token edit distance is at most a tenth of the longer one, or (b) their sites name the same game and their dates the same day.

Method for (a): an exact prefix-filter bipartite join on rare shingles.

* Streams equal without labels form one class (128-bit digest); classes are joined, members only looked up at the end.
* A pair within ``k`` edits keeps all but ``3k`` of its 3-token shingles. Order all shingles by any fixed order: the first
  ``3k + 1`` shingles of the one stream and of the other then share a shingle, at positions at most ``k`` apart. The order used
  is: shingles of no evaluation row, then the others by rarity among the evaluation rows, then by hash.
* Which shingles occur in evaluation rows is read from a bit set sized from the evaluation rows (two bits a shingle or more, up to
  ``2**MAX_BITS`` bits, 128 MB); how rare they are, in powers of two, from 2^20 bytes. Errors of either change the order, never the result. A training row
  whose prefix lies in no evaluation row sends nothing; that takes a third of its shingles, so the set prunes until it is nearly full (about 10^9
  distinct shingles). Past that size training rows send their prefixes: more is shuffled, in proportion to the input, and the result is the same.
* The prefixes of the evaluation classes are the index; those of the training classes probe it.
* Probes pass a length and a position filter; the candidates are verified with a bit-parallel edit distance.

Skew: hot streams and hot games are one class each. All joins that may meet hot keys (shingles, texts, members) are salted on both
sides by measured counts. Nothing is capped. The result of ``overlap_pairs`` lists every pair and so may be quadratic in a hot
class; ``overlap_rows`` and ``overlap_report`` are not.

Defined results: null, empty and short streams match under (b) only; a site without a code or a date that is no calendar day
never matches under (b); rows whose split is null or unknown belong to no side, and rows without an id are left out; repeated rows count each on their own, also under one id; empty
tables give no rows; other columns of the input are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions.streams import LABELS, split_tokens
from plyforge.operators.skew import BLOCK, salted_join
from plyforge.sources.tables import gathered, materialize

SHINGLE = 3
LEAST_TOKENS = 40
#: Size of the set of evaluation shingles, at most, and of the table of their rarity, as powers of two.
MAX_BITS, RARITY_BITS = 30, 20
_LABELS = frozenset(LABELS)


def site_game(site: Column) -> Column:
    """``host/code`` of the game a site names, else null: the code is a first path segment of exactly eight letters or digits."""
    pattern = r"^(?U)\s*(?i:https?://)?(?i:www\.)?([^/?#\s]+)/(?-U)([A-Za-z0-9]{8})(?:[/?#\s].*)?$"
    host, code = F.regexp_extract(site, "(?s)" + pattern, 1), F.regexp_extract(site, "(?s)" + pattern, 2)
    return F.when(code != "", F.concat(F.lower(host), F.lit("/"), code))


def calendar_day(text: Column) -> Column:
    """The day as ``date``, from year, month and day with ``.``, ``-`` or ``/`` between and perhaps a time after; else null."""
    pattern = r"^\s*(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?:[T\s].*)?$"
    part = [F.regexp_extract(text, "(?s)" + pattern, k) for k in (1, 2, 3)]
    return F.when(part[0] != "", F.try_to_timestamp(F.concat(part[0], F.lit("-"), F.lpad(part[1], 2, "0"), F.lit("-"), F.lpad(part[2], 2, "0")), F.lit("yyyy-MM-dd")).cast("date"))


class _Hashes(dict):
    """Token -> 64-bit hash; emptied when it grows past a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token)
        return h


def clean(text: str | None) -> list[str]:
    return [t for t in split_tokens(text) if t not in _LABELS]


def _digest(stream: list[str]) -> bytes:
    return hashlib.md5("\0".join(stream).encode("utf-8", "surrogatepass")).digest()


def _shingles(streams: list[list[str]], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, stream number and position of every shingle of all streams."""
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    h = np.fromiter((hashes[t] for s in streams for t in s), np.uint64, int(size.sum()))
    row = np.repeat(np.arange(len(streams)), size)
    pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    whole = pos <= size[row] - SHINGLE
    at = np.flatnonzero(whole)
    out = np.zeros(len(at), np.uint64)
    for k, factor in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        part = h[at + k] * np.uint64(factor)
        out ^= (part << np.uint64(7 * k)) | (part >> np.uint64(64 - 7 * k)) if k else part
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out, row[at], pos[at]


class Rarity:
    """Which shingles occur in evaluation rows, and how rare they are there, in arrays of a size set before."""

    def __init__(self, bits: int):
        self.bits = bits
        self.present = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
        self.counts = np.zeros(1 << RARITY_BITS, np.int64)
        self.rank = np.zeros(1 << RARITY_BITS, np.uint8)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        np.bitwise_or.at(self.present, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.counts += np.bincount(self.slot(h), minlength=len(self.counts))

    def of(self, h: np.ndarray) -> np.ndarray:
        """0 for a shingle of no evaluation row, else 1 for the rarest, and more."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.where(self.present[at >> 3] >> (at & 7) & 1, np.maximum(self.rank[self.slot(h)], 1), 0)

    def chunks(self) -> Iterator[pa.RecordBatch]:
        """The parts that are not empty: of the set with numbers from 0, of the counts with numbers from -1 down."""
        for part, data in self._parts():
            if data.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data.tobytes()], pa.binary())], ["part", "data"])

    def _parts(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in range(0, len(self.present), CHUNK):
            yield k // CHUNK, self.present[k : k + CHUNK]
        for k in range(0, len(self.counts), CHUNK // 8):
            yield -1 - k // (CHUNK // 8), self.counts[k : k + CHUNK // 8]

    def take(self, part: int, data: bytes) -> None:
        if part >= 0:
            self.present[part * CHUNK :][: len(data)] |= np.frombuffer(data, np.uint8)
        else:
            self.counts[(-1 - part) * (CHUNK // 8) :][: len(data) // 8] += np.frombuffer(data, np.int64)


CHUNK = 1 << 16


def _fill(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = _Hashes(), Rarity(bits)
        for batch in batches:
            streams = [s for t in batch.column(0).to_pylist() if len(s := clean(t)) >= LEAST_TOKENS]
            if streams:
                table.add(_shingles(streams, hashes)[0])
        yield from table.chunks()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of one number, one after the other, as one."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(data, np.uint8 if part >= 0 else np.int64)
            total[part] = x if part not in total else total[part] | x if part >= 0 else total[part] + x
    for part, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "data"])


def rarity(games: DataFrame) -> Rarity:
    """The table of the evaluation rows (``side`` 1): each task fills one, and their parts are merged part by part."""
    own = games.where(F.col("side") == 1).select("tokens")
    chars = own.agg(F.sum(F.length("tokens"))).first()[0] or 0
    bits = min(MAX_BITS, max(12, int(chars // 2).bit_length()))  # a token and what stands around it take four characters or so
    parts = gathered(own).mapInArrow(_fill(bits), "part int, data binary").repartition("part").mapInArrow(_merge, "part int, data binary").toArrow()
    table = Rarity(bits)
    for part, data in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        table.take(part, data)
    table.rank = np.ceil(np.log2(table.counts + 1)).astype(np.uint8)
    table.counts = table.counts[:0]
    return table


_POSTINGS = pa.list_(pa.struct([("h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())]))


def _encode(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = _Hashes(), table.value
        for batch in batches:
            streams = [clean(t) for t in batch.column(2).to_pylist()]
            long = [len(s) >= LEAST_TOKENS for s in streams]
            digest = [_digest(s) if ok else None for s, ok in zip(streams, long)]
            size = np.fromiter(map(len, streams), np.int64, len(streams))
            kept = [s if ok else [] for s, ok in zip(streams, long)]
            h, row, pos = _shingles(kept, hashes)
            seen = ranks.of(h)
            need = SHINGLE * (size // 9) + 1  # a partner of n tokens has n / 0.9 at most, so n / 9 edits at most
            zeros = np.bincount(row[seen == 0], minlength=len(streams))
            take = (seen > 0) & (zeros < need)[row]
            h, row, pos, seen = h[take], row[take], pos[take], seen[take]
            order = np.lexsort((pos, h, seen, row))
            h, row, pos = h[order], row[order], pos[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, np.int64)
            last = np.r_[first[1:], len(h)] - 1
            begin = np.searchsorted(row, np.arange(len(streams)))
            keep = first - begin[row[first]] + zeros[row[first]] < need[row[first]]  # equal shingles are kept or left together
            first, last = first[keep], last[keep]
            offsets = np.searchsorted(row[first], np.arange(len(streams) + 1))
            items = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(pos[first].astype(np.int32)), pa.array(pos[last].astype(np.int32))], names=["h", "lo", "hi"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items).cast(_POSTINGS), batch.column(3)],
                ["row_id", "side", "stream", "n", "postings", "game_day"],
            )

    return run


def within(a: list[str], b: list[str], k: int) -> bool:
    """Whether at most ``k`` insertions, deletions and replacements turn ``a`` into ``b``: bit-parallel, a column of the table per step."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > k:
        return False
    i, n = 0, len(a)
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : len(b) - j]
    if not a:
        return len(b) <= k
    match: dict[str, int] = {}
    for i, t in enumerate(a):
        match[t] = match.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    top, score, left = 1 << len(a) - 1, len(a), len(b)
    up, down = full, 0
    for t in b:
        eq = match.get(t, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        left -= 1
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score - left > k:
            return False
        plus = plus << 1 | 1
        up = (minus << 1 | ~((eq | down) | plus)) & full
        down = plus & (eq | down) & full
    return score <= k


def similar(a: list[str], b: list[str]) -> bool:
    return len(a) >= LEAST_TOKENS and len(b) >= LEAST_TOKENS and within(a, b, max(len(a), len(b)) // 10)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (list(map(clean, batch.column(k).to_pylist())) for k in (2, 3))
        # where an id is used twice, the text must be the one that was matched
        own = [x == _digest(s) and y == _digest(t) for x, y, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), a, b)]
        ok = pa.array([o and similar(x, y) for o, x, y in zip(own, a, b)], pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(ok) for c in batch.columns[:2]], ["key_a", "key_b"])


def _sides(games: DataFrame) -> DataFrame:
    side = F.when(F.col("split_name") == "train", 0).when(F.col("split_name").isin("val", "test"), 1)
    return games.select("row_id", side.alias("side"), "tokens", "site", "utc_date").where(F.col("side").isNotNull() & F.col("row_id").isNotNull())


def _classes(games: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, side, row_id) and ``pairs`` (key_a, key_b, by_game) of training and evaluation classes that overlap."""
    spark = games.sparkSession
    rows = _sides(games)
    table = spark.sparkContext.broadcast(rarity(rows))
    game_day = F.unhex(F.md5(F.concat(site_game(F.col("site")), F.lit(" "), calendar_day(F.col("utc_date")).cast("string"))))
    base = rows.select("row_id", "side", "tokens", game_day.alias("game_day"))
    kind = base.schema["row_id"].dataType.simpleString()
    base = materialize(base.mapInArrow(_encode(table), f"row_id {kind}, side int, stream binary, n int, postings array<struct<h: bigint, lo: int, hi: int>>, game_day binary"), "p1-rows")

    streams = base.where(F.col("stream").isNotNull() & (F.size("postings") > 0)).groupBy("side", "stream").agg(F.min("row_id").alias("rep"), F.first("n").alias("n"), F.first("postings").alias("postings"))
    posted = streams.select("side", "stream", "rep", "n", F.explode("postings").alias("p")).select("side", "stream", "rep", "n", "p.*")
    posted = materialize(posted, "p1-postings")
    a, b = (posted.where(F.col("side") == s).select(F.col("h"), *(F.col(c).alias(f"{c}_{x}") for c in ("stream", "rep", "n", "lo", "hi"))) for s, x in ((0, "a"), (1, "b")))
    edits = F.floor(F.greatest("n_a", "n_b") / 10)
    near = (F.abs(F.col("n_a") - F.col("n_b")) <= edits) & (F.col("lo_a") <= F.col("hi_b") + edits) & (F.col("lo_b") <= F.col("hi_a") + edits)
    candidates = materialize(salted_join(a, b, "h", block).where(near).select("stream_a", "stream_b", "rep_a", "rep_b").distinct(), "p1-candidates")

    wanted = candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("row_id")).distinct()
    texts = materialize(games.select("row_id", "tokens").join(wanted, "row_id", "left_semi"), "p1-texts")
    text = lambda x: texts.select(F.col("row_id").alias(f"rep_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    compared = salted_join(salted_join(candidates, text("a"), "rep_a", block), text("b"), "rep_b", block).select("stream_a", "stream_b", "tokens_a", "tokens_b")
    near_pairs = compared.mapInArrow(_verify, "key_a binary, key_b binary").distinct().withColumn("by_game", F.lit(False))

    members = base.select(F.explode(F.array("stream", "game_day")).alias("key"), "side", "row_id").where(F.col("key").isNotNull())
    days = base.where(F.col("game_day").isNotNull()).groupBy("game_day").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    same_game = days.where((F.col("a") > 0) & (F.col("b") > 0)).select(F.col("game_day").alias("key_a"), F.col("game_day").alias("key_b"), F.lit(True).alias("by_game"))
    return members, materialize(near_pairs.unionByName(same_game), "p1-pairs")


def overlap_pairs(games: DataFrame, block: int = BLOCK) -> DataFrame:
    """``row_id_a, row_id_b``: every overlapping pair of a training and an evaluation row, the smaller id first."""
    members, pairs = _classes(games, block)
    of = lambda side, x: members.where(F.col("side") == side).select(F.col("key").alias(f"key_{x}"), F.col("row_id").alias(x)).join(pairs.select(f"key_{x}").distinct(), f"key_{x}", "left_semi")
    found = salted_join(salted_join(pairs.select("key_a", "key_b"), of(0, "a"), "key_a", block), of(1, "b"), "key_b", block)
    return found.select(F.least("a", "b").alias("row_id_a"), F.greatest("a", "b").alias("row_id_b")).distinct()


def overlap_rows(games: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per evaluation row that overlaps with training: ``row_id, by_stream, by_game`` (which rules hold) and ``n_classes``, the training classes it is linked to."""
    members, pairs = _classes(games, block)
    links = pairs.groupBy(F.col("key_b").alias("key")).agg(F.count("*").alias("n_classes"), F.bool_or("by_game").alias("by_game"))
    own = members.where(F.col("side") == 1).join(links, "key")
    return own.groupBy("row_id").agg(F.bool_or(~F.col("by_game")).alias("by_stream"), F.bool_or("by_game").alias("by_game"), F.sum("n_classes").alias("n_classes"))


def overlap_report(games: DataFrame) -> DataFrame:
    """Per split and host (as in ``site``, lower case; ``unknown`` without one): evaluation rows, those also in training, and by which rule."""
    found = overlap_rows(games)
    host = F.lower(F.regexp_extract("site", r"^\s*(?i:https?://)?(?i:www\.)?([^/?#\s]+)/", 1))
    rows = games.where(F.col("split_name").isin("val", "test")).select("row_id", "split_name", F.when(host != "", host).otherwise("unknown").alias("host"))
    return (
        rows.join(found, "row_id", "left")
        .groupBy("split_name", F.coalesce("host", F.lit("unknown")).alias("host"))
        .agg(F.count("*").alias("n_rows"), F.count("n_classes").alias("n_overlapping"), F.count_if("by_stream").alias("n_by_stream"), F.count_if("by_game").alias("n_by_game"), F.coalesce(F.sum("n_classes"), F.lit(0)).alias("n_links"))
        .withColumn("share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))
    )
