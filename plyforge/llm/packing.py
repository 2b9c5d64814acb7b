"""Filling windows of fixed capacity with whole posts (problem 5).

Method: packing by non-negative least squares over the histogram of lengths.

1. Posts longer than the capacity are cut into pieces of the capacity and a rest; a piece of the capacity is a window of its own.
2. The histogram of lengths (at most ``capacity`` rows, so it may go to the driver) is all that the plan needs.
3. *Enumerate and solve.* Columns are all combinations of two or three items that fill a window exactly. Repeat counts >= 0 are
   sought that come nearest to the histogram, each length weighted by the tokens it stands for. The columns are generated: those
   with the steepest gradient join the problem, until none is left whose gradient is above ``TOLERANCE`` of the steepest at the start. None is
   left out for want of room.
4. *Round* by largest remainders: whole parts first, then a window more for the largest remainders until the sum of the
   solution is reached, never past the counts. What is left is solved again, as long as a round places ``PROGRESS`` of it.
5. Short posts, of which three cannot fill a window, are packed by 3 and 4 into blocks of a quarter of the window (and so on down); four full blocks
   make a window.
6. *Greedily pack the residuals* on the counts: the longest length left, then the longest that still fits, and so on; such a
   pattern is repeated as often as the counts allow. Every round uses up a length, so the plan stays small.
7. *Assign*: the k-th post of its length goes to the pattern that has reserved the k-th place (see ``operators.ranking``: no
   group is collected in a task). The plan is broadcast; its size is bounded by the capacity, not by the posts.

Defined results: posts that are null, empty or of no tokens take no room and appear in no window; repeated rows are packed each
on its own and need different keys; ties of equal lengths are broken by a hash of the key; an empty table gives no rows; a
capacity that is null or below 1 is left out, one named twice is packed once per name; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.llm.tokens import VOCABULARY, token_counts
from plyforge.operators.ranking import running_offset
from plyforge.sources.tables import materialize

#: Gradient at which the columns are complete, as a share of the steepest at the start; change of the solution at which it is done.
TOLERANCE, SETTLED = 0.002, 1e-5
#: Share of the tokens left that a further round must place.
PROGRESS = 0.02
#: A block is this part of the next larger one; the smallest window that has blocks.
PARTS, SMALLEST = 4, 16

Pattern = tuple[tuple[int, int], ...]  # (length, times)


def _priced(y: np.ndarray, have: np.ndarray, size: int, each: int) -> np.ndarray:
    """For each length as the largest of two or three that sum to ``size``, the ``each`` columns of the highest value; rows of (a, b, c), c being 0 for two."""
    found = []
    lengths = np.flatnonzero(have)
    for a in lengths[(lengths * 3 >= size) & (lengths < size)]:
        rest = size - a
        b = lengths[np.searchsorted(lengths, (rest + 1) // 2) : np.searchsorted(lengths, min(a, rest), "right")]
        c = rest - b
        b = b[have[c] | (c == 0)]
        if len(b):
            c = rest - b
            # a length alone in the column is less of it: the value is per root of its squared norm
            value = (y[a] + y[b] + y[c]) / np.sqrt(_norms(np.full(len(b), a), b, c))
            best = np.argpartition(-value, each - 1)[:each] if len(b) > each else np.arange(len(b))
            best = best[value[best] > 0]
            found.append(np.stack([np.full(len(best), a), b[best], c[best]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def _norms(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Sum over the column's lengths n of n times the square of its uses."""
    return np.where(a == b, np.where(b == c, 9.0 * a, 4.0 * a + c), np.where(b == c, a + 4.0 * b, 1.0 * a + b + c))


def _descend(columns: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Accelerated projected gradient on x >= 0 for the sum over lengths n of n * (counts[n] - uses of n)^2."""
    w = np.arange(len(counts), dtype=np.float64)
    scale = 1 / np.sqrt(_norms(*columns.T))

    def uses(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts))
        for k in range(3):
            out += np.bincount(columns[:, k], v, len(counts))
        out[0] = 0
        return out

    def gradient(r: np.ndarray) -> np.ndarray:
        y = w * r
        return (y[columns[:, 0]] + y[columns[:, 1]] + y[columns[:, 2]]) * scale

    v, norm = np.ones(len(columns)), 1.0
    for _ in range(20):  # the largest eigenvalue
        v = gradient(uses(v * scale))
        norm = float(np.linalg.norm(v))
        v /= norm
    step = 1 / (1.05 * norm)
    z = x / scale
    ahead, t, before = z.copy(), 1.0, np.inf
    for k in range(400):
        new = np.maximum(0.0, ahead + step * gradient(counts - uses(ahead * scale)))
        if ((ahead - new) * (new - z)).sum() > 0:  # the momentum points away: start it again
            t = 1.0
        ahead_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / ahead_t * (new - z)
        z, t = new, ahead_t
        if k % 20 == 19:
            r = counts - uses(z * scale)
            now = float((w * r * r).sum())
            if before - now <= SETTLED * before:
                break
            before = now
    return z * scale


def least_squares(counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (two or three lengths that sum to ``size``) and their repeat counts nearest to the histogram ``counts``, by column generation."""
    w = np.arange(len(counts), dtype=np.float64)
    have = counts > 0
    have[0] = False
    columns, x = np.zeros((0, 3), np.int64), np.zeros(0)
    r, first = counts.astype(np.float64), None
    while True:
        y = w * np.where(have, r, 0)
        y[0] = 0
        new = _priced(y, have, size, 4)
        value = (y[new[:, 0]] + y[new[:, 1]] + y[new[:, 2]]) / np.sqrt(_norms(*new.T)) if len(new) else np.zeros(0)
        first = first or float(value.max(initial=0.0))
        new = new[value > TOLERANCE * first]
        base = np.int64(len(counts))
        code = lambda m: (m[:, 0] * base + m[:, 1]) * base + m[:, 2]
        new = new[~np.isin(code(new), code(columns))]
        if not len(new):
            return columns, x
        columns, x = np.concatenate([columns, new]), np.r_[x, np.zeros(len(new))]
        x = _descend(columns, counts, x)
        keep = x > 0
        columns, x = columns[keep], x[keep]
        used = sum(np.bincount(columns[:, k], x, len(counts)) for k in range(3))
        r = counts - used


def rounded(columns: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats by largest remainders, never past the counts, and the counts left."""
    left = counts.astype(np.int64).tolist()
    out = np.zeros(len(x), np.int64)
    triples = columns.tolist()

    def take(j: int, most: int) -> int:
        need = Counter(n for n in triples[j] if n)
        n = min(most, *(left[a] // t for a, t in need.items()))
        for a, t in need.items():
            left[a] -= t * n
        out[j] += n
        return n

    whole = np.floor(x).astype(np.int64)
    for j in np.lexsort((np.arange(len(x)), -x)):
        if whole[j]:
            take(j, int(whole[j]))
    short = round(float(x.sum())) - int(out.sum())
    for j in np.lexsort((np.arange(len(x)), -(x - out))):
        if short <= 0:
            break
        short -= take(j, 1)
    return out, np.array(left, np.int64)


def fit(counts: np.ndarray, size: int, whole: bool = True) -> tuple[list[tuple[Pattern, float]], np.ndarray]:
    """Patterns that fill ``size`` exactly with their repeats, and the counts left; ``whole`` rounds, else the solutions are taken as they are."""
    counts = counts.copy()
    out: list[tuple[Pattern, float]] = []
    n = np.arange(len(counts))
    while (left := float((n * counts)[: size + 1].sum())) > 0:
        own = np.where(n < size, counts, 0)[: size + 1]
        columns, x = least_squares(own, size)
        if whole:
            x, rest = rounded(columns, x, own)
        else:
            used = sum(np.bincount(columns[:, k], x, size + 1) for k in range(3))
            rest = np.maximum(own - used, 0)
            rest[0] = 0
        out += [(tuple(sorted(Counter(v for v in c if v).items(), reverse=True)), r) for c, r in zip(columns.tolist(), x.tolist()) if r > 0]
        counts[:size] = rest[:size]
        if not whole or left - float((n * counts)[: size + 1].sum()) < PROGRESS * left:
            break
    block = size // PARTS
    if size >= SMALLEST and (size - PARTS * block) * 100 <= size:
        blocks, below = fit(np.where(n <= block, counts, 0), block, whole)
        if counts[block]:
            blocks.append((((block, 1),), counts[block].item()))
            below[block] = 0
        if whole:
            made, unused = _fours(blocks)
            out += made
            for p, r in unused:
                for v, t in p:
                    below[v] += t * r
        else:
            out += [(tuple((v, t * PARTS) for v, t in p), r / PARTS) for p, r in blocks]
        counts[: block + 1] = below[: block + 1]
    return out, counts


def _fours(blocks: list[tuple[Pattern, int]]) -> tuple[list[tuple[Pattern, int]], list[tuple[Pattern, int]]]:
    """Four blocks a window: of one pattern as far as they go, then of different ones; and the blocks left over."""
    out: list[tuple[Pattern, int]] = []
    single: list[Pattern] = []
    for p, r in blocks:
        if r >= PARTS:
            out.append((tuple((v, t * PARTS) for v, t in p), r // PARTS))
        single += [p] * (r % PARTS)
    for k in range(0, len(single) - PARTS + 1, PARTS):
        total: Counter[int] = Counter()
        for p in single[k : k + PARTS]:
            total.update(dict(p))
        out.append((tuple(sorted(total.items(), reverse=True)), 1))
    return out, [(p, 1) for p in single[len(single) // PARTS * PARTS :]]


def greedy(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Longest first on the counts: patterns and how often each is used, until nothing is left."""
    lengths = np.array(sorted(n for n, c in counts.items() if c), np.int64)
    left = np.array([counts[n] for n in lengths], np.int64)
    out: list[tuple[Pattern, int]] = []
    while len(lengths):
        room, i, pattern = capacity, len(lengths) - 1, []
        while i >= 0 and room >= lengths[0]:
            i = min(i, int(np.searchsorted(lengths, room, "right")) - 1)
            if i < 0:
                break
            times = int(min(left[i], room // lengths[i]))
            pattern.append((int(lengths[i]), times, i))
            room -= times * int(lengths[i])
            i -= 1
        repeats = min(int(left[i]) // t for _, t, i in pattern)
        out.append((tuple((n, t) for n, t, _ in pattern), repeats))
        for _, t, i in pattern:
            left[i] -= t * repeats
        keep = left > 0
        lengths, left = lengths[keep], left[keep]
    return out


#: How a window came about.
WHOLE, FITTED, GREEDY = 0, 1, 2
BY = ("whole", "fitted", "greedy")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int, int]]:
    """Patterns, repeats and origin that use every item of the histogram exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if 0 < n < capacity:
            left[n] = c
    out = [(((capacity, 1),), counts[capacity], WHOLE)] if counts.get(capacity) else []
    fitted, left = fit(left, capacity)
    out += [(p, r, FITTED) for p, r in fitted]
    return out + [(p, r, GREEDY) for p, r in greedy({int(n): int(left[n]) for n in np.flatnonzero(left)}, capacity)]


def solved_share(counts: dict[int, int], capacity: int) -> float:
    """Share of the tokens below the capacity that least squares places before rounding."""
    own = np.zeros(capacity + 1)
    for n, c in counts.items():
        if 0 < n < capacity:
            own[n] = c
    _, left = fit(own, capacity, whole=False)
    n = np.arange(capacity + 1)
    total = float((n * own).sum())
    return 1 - float((n * left).sum()) / total if total else 1.0


def _places(container: int, patterns: list[tuple[Pattern, int, int]]) -> list[tuple[int, ...]]:
    """The plan by length: ``(container, length, first place, times, first window, first position, tokens before, origin)``."""
    used: dict[int, int] = {}
    rows, window = [], 0
    for pattern, repeats, by in patterns:
        position = tokens = 0
        for n, t in pattern:
            rows.append((container, n, used.get(n, 0), t, window, position, tokens, by))
            used[n] = used.get(n, 0) + t * repeats
            position += t
            tokens += n * t
        window += repeats
    return rows


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value  # sorted by container, length, first place
        group = place[:, 0] << 32 | place[:, 1]
        classes = np.unique(group)
        low = np.searchsorted(group, classes)
        # one sorted key: class number and first place
        base = np.int64(1) << np.int64(44)
        keys = np.searchsorted(classes, group) * base + place[:, 2]
        del low
        for batch in batches:
            container, size, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 4, 5))
            row = place[np.searchsorted(keys, np.searchsorted(classes, container << 32 | size) * base + rank, "right") - 1]
            nth = rank - row[:, 2]
            slot = nth % row[:, 3]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row[:, 4] + nth // row[:, 3]), pa.array((row[:, 5] + slot).astype(np.int32)), batch.column(1), batch.column(2), batch.column(3), batch.column(4), pa.array((row[:, 6] + slot * size).astype(np.int32)), pa.array(row[:, 7].astype(np.int32))],
                ["container_no", "window_no", "position", "key", "piece_no", "first_token", "n_tokens", "window_token", "by"],
            )

    return run


def pack(df: DataFrame, sizes: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY) -> tuple[DataFrame, dict[str, tuple[int, dict[int, int]]]]:
    """``windows`` of the posts, and by container its capacity and the histogram of the pieces."""
    spark = df.sparkSession
    # a small table of settings: (container, capacity_tokens)
    containers = sorted({(r[0], r[1]) for r in sizes.select("container", "capacity_tokens").collect() if r[1] and r[1] > 0}, key=lambda r: (r[1], str(r[0])))
    counted = materialize(token_counts(df, {"key": key}, column, vocabulary).where("n_tokens > 0"), "p5-sizes")
    numbered = F.array(*(F.struct(F.lit(i).alias("container_no"), F.lit(c).cast("long").alias("capacity")) for i, (_, c) in enumerate(containers)))
    if not containers:
        numbered = F.array().cast("array<struct<container_no: int, capacity: bigint>>")
    each = counted.select("key", "n_tokens", F.explode(numbered).alias("c")).select("key", "n_tokens", "c.*")
    last = F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int") - 1
    pieces = each.select("container_no", "capacity", "key", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    first = F.col("piece_no") * F.col("capacity")
    pieces = pieces.select("container_no", "key", "piece_no", first.cast("int").alias("first_token"), F.least("capacity", F.col("n_tokens") - first).cast("int").alias("size"))
    histogram = pieces.groupBy("container_no", "size").count().collect()  # at most the sum of the capacities
    rows: list[tuple[int, ...]] = []
    histograms: dict[str, tuple[int, dict[int, int]]] = {}
    for i, (name, capacity) in enumerate(containers):
        counts = {r["size"]: r["count"] for r in histogram if r["container_no"] == i}
        rows += _places(i, plan(counts, capacity))
        histograms[name] = capacity, counts
    shared = spark.sparkContext.broadcast(np.array(sorted(rows), np.int64).reshape(-1, 8))
    ranked = running_offset(pieces, ["container_no", "size"], ["key", "piece_no"], name="place", slices=max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = df.schema[key].dataType.simpleString()
    placed = ranked.select("container_no", "key", "piece_no", "first_token", "size", "place").mapInArrow(
        _assign(shared), f"container_no int, window_no long, position int, key {kind}, piece_no int, first_token int, n_tokens int, window_token int, by int"
    )
    name = F.element_at(F.array(*(F.lit(c) for c, _ in containers)), F.col("container_no") + 1) if containers else F.lit(None).cast("string")
    by = F.element_at(F.array(*map(F.lit, BY)), F.col("by") + 1)
    return placed.select(name.alias("container"), "window_no", "position", F.col("key").alias(key), "piece_no", "first_token", "n_tokens", "window_token", by.alias("by")), histograms


def windows(df: DataFrame, sizes: DataFrame, key: str = "doc_id", column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``container, window_no, position, <key>, piece_no, first_token, n_tokens, window_token, by``: one row per post or piece and container.

    ``first_token`` is where the piece starts in its post, ``window_token`` where it starts in its window; ``by`` tells whether the
    window is ``whole`` (one piece of the capacity), ``fitted`` by least squares or ``greedy``.
    """
    return pack(df, sizes, key, column, vocabulary)[0]


def fills(packed: DataFrame, sizes: DataFrame, histograms: dict[str, tuple[int, dict[int, int]]] | None = None) -> DataFrame:
    """Per window: items, tokens, the share of the capacity that is filled, and how it came about.

    With ``histograms`` also, per container, the shares of the tokens below the capacity that least squares places before rounding
    (``solved_share``) and after it (``fitted_share``).
    """
    total = packed.groupBy("container", "window_no", "by").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    total = total.join(F.broadcast(sizes.select("container", "capacity_tokens").distinct()), "container").withColumn("fill", F.round(F.col("n_tokens") / F.col("capacity_tokens"), 6))
    if histograms is None:
        return total
    # a row per container
    share = packed.where("by <> 'whole'").groupBy("container").agg((F.sum(F.when(F.col("by") == "fitted", F.col("n_tokens")).otherwise(0)) / F.sum("n_tokens")).alias("fitted_share"))
    solved = {name: solved_share(counts, capacity) for name, (capacity, counts) in histograms.items()}
    before = F.create_map(*(F.lit(x) for kv in solved.items() for x in kv)) if solved else F.create_map().cast("map<string, double>")
    return total.join(F.broadcast(share), "container", "left").withColumn("fitted_share", F.round("fitted_share", 6)).withColumn("solved_share", F.round(before[F.col("container")], 6))


def checks(packed: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """What must hold, per container: posts packed, posts whose pieces do not follow each other exactly once, windows over the capacity, windows whose items overlap or leave gaps."""
    posts = packed.groupBy("container", key).agg((F.sum("n_tokens") != F.max(F.col("first_token") + F.col("n_tokens"))).alias("torn"), (F.count("*") != F.max("piece_no") + 1).alias("twice"))
    posts = posts.groupBy("container").agg(F.count("*").alias("n_posts"), F.count_if(F.col("torn") | F.col("twice")).alias("n_torn"))
    per = packed.groupBy("container", "window_no").agg(F.sum("n_tokens").alias("n"), F.max(F.col("window_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("items"), F.max("position").alias("last"))
    per = per.join(F.broadcast(sizes.select("container", "capacity_tokens").distinct()), "container")
    per = per.groupBy("container").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("n_overfull"), F.count_if((F.col("end") != F.col("n")) | (F.col("last") != F.col("items") - 1)).alias("n_uneven"))
    return posts.join(per, "container")
