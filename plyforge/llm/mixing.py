"""Mixing sources to target shares of the tokens (problem 6).

Method: Sainte-Laguë apportionment of equal-token blocks, then a seeded selection of blocks.

1. Posts are sized in tokens; each source is cut into ``SHARDS`` shards by a seeded hash, and the shard totals (sources x shards)
   go to the driver.
2. The mix is as large as the targets allow: the source that is first exhausted at its share, all posts repeated as often as
   it may be, sets the total. The total is cut into ``BLOCKS`` blocks of equal size; each goes to the source of the highest
   quotient share / (2 q + 1), q being the blocks it has. The same rule cuts a source's quota over its shards by their
   tokens. Quotas are found from the divisor, not block by block.
3. In a shard the posts form one line of tokens in seeded order, cut into blocks of whole posts: a post lies in the block in which it
   starts. All blocks of a shard are used as often as its quota holds the whole shard; what is left of the quota takes blocks from the front
   of the line, once more each. As blocks of whole posts differ a little from the block size, their true sizes go to the driver
   (those up to the quota and ``SPARE`` more in each shard, each of a post at least, past the longest post; so about ``BLOCKS`` in all), a block is taken if that brings the shard nearer to its quota, and what it is
   over or under is taken off the next shard's. After the last shard single blocks are taken, dropped or exchanged while that brings the source nearer.
4. A post is used as often as its block, so never more than ``max_repeats`` times.

Sources are compared in lower case, without surrounding blanks, ``_`` and blanks as ``-``. Targets of sources without posts are
spread over the others in proportion and reported with share 0.

Defined results: null, empty and foreign-source posts get 0 repeats; ``max_repeats`` null or below 1 leaves the source out; a
target named twice counts with the sum of its shares and the larger cap; repeated rows need different keys; an empty table
gives no repeats and all shares 0; other columns are never read.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.llm.tokens import VOCABULARY, token_counts
from plyforge.operators.ranking import running_offset
from plyforge.sources.tables import materialize

SEED = 20240101
#: Blocks of the whole mix, shards of each source, and blocks (or posts, where those are larger) past a shard's quota whose size is looked at.
BLOCKS, SHARDS, SPARE = 4096, 16, 8


def canonical(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[_\s]+", "-")


def sainte_lague(weights: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients weight / (2 q + 1), none past its cap; ties go to the earlier one."""
    caps = caps or [seats] * len(weights)
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    if seats <= 0:
        return [0] * len(weights)

    def at(quotient: float) -> list[int]:  # seats whose quotient is above it
        return [min(c, max(0, math.ceil((w / quotient - 1) / 2))) if w > 0 else 0 for w, c in zip(weights, caps)]

    low, high = 0.0, max(weights) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or low >= mid or mid >= high:
            break
        if sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    q = at(high)
    for _ in range(seats - sum(q)):  # a few at most: equal quotients at the limit
        i = max((i for i in range(len(q)) if weights[i] > 0 and q[i] < caps[i]), key=lambda i: (weights[i] / (2 * q[i] + 1), -i))
        q[i] += 1
    return q


def quotas(totals: dict[tuple[str, int], int], targets: dict[str, tuple[float, int]], blocks: int = BLOCKS) -> tuple[int, dict[tuple[str, int], int]]:
    """Tokens per block, and the blocks of each (source, shard)."""
    have = {s: sum(n for (t, _), n in totals.items() if t == s) for s in targets}
    names = [s for s, (share, _) in targets.items() if share > 0 and have[s] > 0]
    if not names:
        return 1, {}
    whole = sum(targets[s][0] for s in names)
    total = min(targets[s][1] * have[s] * whole / targets[s][0] for s in names)
    size = max(1, int(total / blocks))
    shards = {s: sorted(k for k in totals if k[0] == s) for s in names}
    got = sainte_lague([targets[s][0] for s in names], int(total // size), [targets[s][1] * have[s] // size for s in names])
    out: dict[tuple[str, int], int] = {}
    for s, q in zip(names, got):
        out |= zip(shards[s], sainte_lague([float(totals[k]) for k in shards[s]], q, [-(-targets[s][1] * totals[k] // size) for k in shards[s]]))
    return size, out


def select(totals: list[int], quota: list[int], sizes: list[list[int]], cap: int) -> tuple[list[int], list[set[int]]]:
    """Per shard of one source, how often all its blocks are used, and the blocks used once more.

    ``quota`` is in tokens; ``sizes`` are those of the first blocks of each shard's line.
    """
    base, extra, gap = [], [], 0
    for have, wanted, line in zip(totals, quota, sizes):
        gap += wanted
        times = max(0, min(cap, gap // have))
        gap -= times * have
        chosen: set[int] = set()
        if times < cap:
            for k, n in enumerate(line):
                if n and abs(gap - n) < abs(gap):
                    chosen.add(k)
                    gap -= n
        base.append(times)
        extra.append(chosen)
    spare = sorted((n, i, k) for i, line in enumerate(sizes) if base[i] < cap for k, n in enumerate(line) if n)
    while gap and spare:
        taken = sorted((n, i, k) for n, i, k in spare if k in extra[i])
        free = [(n, i, k) for n, i, k in spare if k not in extra[i]]
        best = (abs(gap), None, None)
        for out in [None, *taken]:
            want = gap + (out[0] if out else 0)
            j = bisect_left(free, (want, -1, -1))
            for put in [None, *free[max(0, j - 1) : j + 1]]:
                best = min(best, (abs(want - (put[0] if put else 0)), out, put), key=lambda b: b[0])
        if best[0] >= abs(gap):
            break
        _, out, put = best
        if out:
            extra[out[1]].remove(out[2])
            gap += out[0]
        if put:
            extra[put[1]].add(put[2])
            gap -= put[0]
    return base, extra


def _targets(mix: DataFrame) -> dict[str, tuple[float, int]]:
    """A small table of settings."""
    out: dict[str, tuple[float, int]] = {}
    for s, share, cap in mix.select(canonical(F.col("source")), "target_share", "max_repeats").collect():
        if s is not None and share is not None and cap is not None and cap >= 1:
            old = out.get(s, (0.0, 0))
            out[s] = (old[0] + share, max(old[1], cap))
    return out


def repeats(df: DataFrame, mix: DataFrame, key: str = "doc_id", column: str = "text", seed: int = SEED, vocabulary: str = VOCABULARY, shards: int = SHARDS, blocks: int = BLOCKS) -> DataFrame:
    """``<key>, source, shard, n_tokens, repeats``: every post, its canonical source, and how often the mix uses it."""
    spark = df.sparkSession
    targets = _targets(mix)
    sized = token_counts(df, {"key": key, "source": "source"}, column, vocabulary)
    sized = materialize(sized.select("key", canonical(F.col("source")).alias("source"), "n_tokens", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(shards)).cast("int").alias("shard")), "p6-sizes")
    wanted = sized.where(F.col("source").isin(*targets) & (F.col("n_tokens") > 0)) if targets else sized.where("false")
    cells = wanted.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("posts"), F.max("n_tokens").alias("longest")).collect()  # targets x shards
    totals = {(r["source"], r["shard"]): r["n"] for r in cells}
    size, quota = quotas(totals, targets, blocks)
    spare = {(r["source"], r["shard"]): SPARE * max(1, -(-r["n"] // (r["posts"] * size))) + r["longest"] // size for r in cells}
    slices = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    line = running_offset(wanted, ["source", "shard"], ["key"], "n_tokens", "start", slices=slices, seed=seed)
    line = materialize(line.select("key", "source", "shard", "n_tokens", F.floor(F.col("start") / size).alias("block")), "p6-line")

    # blocks that the quota can reach beyond full uses of a shard
    reach = {k: min(-(-totals[k] // size), (q * size) % totals[k] // size + spare[k]) for k, q in quota.items()}
    limits = spark.createDataFrame([(s, h, n) for (s, h), n in reach.items()], "source string, shard int, reach long")
    found: dict[tuple[str, int], list[int]] = {k: [0] * n for k, n in reach.items()}
    near = line.join(F.broadcast(limits), ["source", "shard"]).where(F.col("block") < F.col("reach"))
    for r in near.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("n")).toLocalIterator():  # BLOCKS, and SPARE a shard
        found[r["source"], r["shard"]][r["block"]] = r["n"]
    bases, extras = [], []
    for s in dict.fromkeys(s for s, _ in quota):
        keys = [k for k in quota if k[0] == s]
        base, extra = select([totals[k] for k in keys], [quota[k] * size for k in keys], [found[k] for k in keys], targets[s][1])
        bases += [(*k, b) for k, b in zip(keys, base)]
        extras += [(*k, b, 1) for k, blocks_ in zip(keys, extra) for b in sorted(blocks_)]
    all_ = F.broadcast(spark.createDataFrame(bases, "source string, shard int, base int"))
    more = F.broadcast(spark.createDataFrame(extras, "source string, shard int, block long, more int"))
    used = line.join(all_, ["source", "shard"], "left").join(more, ["source", "shard", "block"], "left")
    used = used.select("key", "source", "shard", "n_tokens", (F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("repeats"))
    rest = sized.where(~(F.coalesce(F.col("source").isin(*targets), F.lit(False)) & (F.col("n_tokens") > 0))) if targets else sized
    return used.unionByName(rest.select("key", "source", "shard", "n_tokens", F.lit(0).alias("repeats"))).withColumnRenamed("key", key)


def shares(mixed: DataFrame, mix: DataFrame) -> DataFrame:
    """Per target source: posts, tokens, tokens used, target and actual share, cap and the most a post is repeated."""
    used = mixed.groupBy("source").agg(
        F.count("*").alias("n_posts"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats")
    )
    targets = mix.groupBy(canonical(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = targets.join(used, "source", "left").fillna(0, ["n_posts", "n_tokens", "used_tokens", "most_repeats"])
    whole = F.sum("used_tokens").over(W.partitionBy())  # over the targets alone
    return joined.withColumn("actual_share", F.round(F.coalesce(F.col("used_tokens") / F.nullif(whole, F.lit(0)), F.lit(0.0)), 6))


def checks(mixed: DataFrame, mix: DataFrame, tolerance: float = 0.002) -> DataFrame:
    """What must hold, per target source: its number of posts; whether it comes within ``tolerance`` of the mix (or, in small mixes, within a post of mean length) of its share among the targets that have posts; and whether no post is used more often than allowed."""
    report = shares(mixed, mix).join(mixed.where("n_tokens > 0").groupBy("source").agg(F.avg("n_tokens").alias("mean")), "source", "left")
    every = W.partitionBy()  # over the targets alone
    whole, reachable = F.sum("used_tokens").over(every), F.sum(F.when(F.col("n_tokens") > 0, F.col("target_share"))).over(every)
    goal = F.when(F.col("n_tokens") > 0, F.col("target_share") / reachable * whole).otherwise(0.0)
    near = F.abs(F.col("used_tokens") - goal) <= F.greatest(tolerance * whole, F.coalesce("mean", F.lit(0)))
    return report.select("source", "n_posts", near.alias("on_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("capped"))
