"""Length buckets: fixed row lengths, rows per batch, and padded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.operators import vocab as V
from plyforge.operators.ranking import running_offset

# Row lengths and the bound on rows per batch.
CAPS = (64, 128, 256, 384, 512, 768, 1024)
MAX_ROWS = 8


def caps(block: int) -> tuple[int, ...]:
    """Row lengths up to the block, which is the last one."""
    return (*(c for c in CAPS if c < block), block)


def rows_for_cap(cap: Column, block: int, batch: int) -> Column:
    """Rows per batch, so that a batch has about ``batch * block`` tokens; half to even."""
    return F.when(cap.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MAX_ROWS * batch), F.rint(F.lit(float(batch * block)) / cap).cast("int"))))


def bucket_of(length: Column, block: int) -> Column:
    """Smallest row length that holds a game of ``length`` tokens (one less as input); null if none does."""
    fitting = F.filter(F.array(*map(F.lit, caps(block))), lambda c: c >= length - 1)
    return F.try_element_at(fitting, F.lit(1))


def bucket_table(corpus: DataFrame, block: int = 1024, batch: int = 64) -> DataFrame:
    """``split, cap, rows, n_games, n_tokens, probability``: a bucket is drawn in proportion to its tokens; ``cap`` null: games too long."""
    by_cap = corpus.groupBy("split", bucket_of(F.col("length"), block).alias("cap")).agg(F.count("*").alias("n_games"), F.sum("length").alias("n_tokens"))
    mass = F.when(F.col("cap").isNotNull(), F.col("n_tokens"))
    share = mass / F.sum(mass).over(W.partitionBy("split"))
    return by_cap.select("split", "cap", rows_for_cap(F.col("cap"), block, batch).alias("rows"), "n_games", "n_tokens", F.round(share, 9).alias("probability"))


def padded(rows: DataFrame, block: int = 1024, too_long: str = "skip") -> DataFrame:
    """Rows filled up to their bucket: inputs with the end token, targets with -1.

    Rows that fit no bucket are left out (``skip``; ``oversized`` counts them), kept with a null ``cap`` and as they are (``keep``), or an error at run time (``error``).
    """
    cap = bucket_of(F.size("x") + 1, block)
    if too_long == "error":
        cap = F.coalesce(cap, F.raise_error(F.format_string("a row of %s tokens exceeds the largest bucket", F.size("x"))).cast("int"))
    capped = rows.withColumn("cap", cap)
    if too_long == "skip":
        capped = capped.where("cap IS NOT NULL")
    fill = lambda c, v: F.when(F.col("cap").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.array_repeat(F.lit(v), F.col("cap") - F.size(c))))
    return capped.withColumns({"x": fill("x", V.ids()[V.EOS]), "y": fill("y", -1)})


def oversized(rows: DataFrame, block: int = 1024) -> DataFrame:
    """How many rows fit no bucket, and their tokens."""
    over = bucket_of(F.size("x") + 1, block).isNull()
    return rows.agg(F.count_if(over).alias("n_rows"), F.coalesce(F.sum(F.when(over, F.size("x"))), F.lit(0)).alias("n_tokens"))


def batches(rows: DataFrame, steps: int, block: int = 1024, batch: int = 64, seed: int = 0, key: str = "row_id") -> DataFrame:
    """``step, slot, <key>, cap, x, y``: per step a bucket drawn by token mass, and its rows drawn with replacement from the padded rows.

    The draws are a hash of (seed, step, slot), so any executor repeats them.
    """
    spark = rows.sparkSession
    ready = padded(rows, block)
    ranked = running_offset(ready, ["cap"], [key, "seg"], name="rank")
    table = ready.groupBy("cap").agg(F.count("*").alias("n"), F.sum(F.size("x") + 1).alias("mass")).orderBy("cap").collect()  # a row per cap
    if not table:
        return ranked.select(F.lit(0).alias("step"), F.lit(0).alias("slot"), key, "cap", "x", "y").where("false")
    total = float(sum(r["mass"] for r in table))
    low, cases = 0.0, None
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("step")), F.lit(1 << 30)) / float(1 << 30)
    for r in table:
        low += r["mass"] / total
        value = F.struct(F.lit(r["cap"]).alias("cap"), F.lit(r["n"]).cast("long").alias("n"))
        cases = F.when(u < low, value) if cases is None else cases.when(u < low, value)
    last = F.struct(F.lit(table[-1]["cap"]).alias("cap"), F.lit(table[-1]["n"]).cast("long").alias("n"))
    draws = spark.range(steps).select(F.col("id").cast("int").alias("step")).select("step", cases.otherwise(last).alias("b")).select("step", "b.cap", "b.n")
    slots = draws.select("step", "cap", "n", F.explode(F.sequence(F.lit(0), rows_for_cap(F.col("cap"), block, batch) - 1)).alias("slot"))
    drawn = slots.withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), "step", "slot", F.lit("row")), F.col("n")))
    return drawn.join(ranked, ["cap", "rank"]).select("step", "slot", key, "cap", "x", "y")


def tensors(drawn: DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batches of ``batches`` as a trainer takes them: ``(step, x, y)`` with arrays of (rows, cap), in order of the steps; one partition at a time passes the driver."""
    held: list = []
    for r in drawn.orderBy("step", "slot").toLocalIterator():
        if held and held[0]["step"] != r["step"]:
            yield _stacked(held)
            held = []
        held.append(r)
    if held:
        yield _stacked(held)


def _stacked(rows: list) -> tuple[int, np.ndarray, np.ndarray]:
    return rows[0]["step"], np.array([r["x"] for r in rows], np.int64), np.array([r["y"] for r in rows], np.int64)
