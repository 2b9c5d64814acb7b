"""Equi-joins in which some keys have very many rows on either side or on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.sources.tables import materialize

#: Rows of one key that meet in one task, on each side.
BLOCK = 4096


def salted_join(a: DataFrame, b: DataFrame, on: str, block: int = BLOCK) -> DataFrame:
    """The inner equi-join of ``a`` and ``b``; no task meets more than about ``block`` rows of a key from either side.

    Rows are counted per key (partial sums first). A key with more than ``block`` rows on a side is cut into blocks there by a hash of the
    row, and the other side's rows of that key are repeated for each of its blocks, so every pair still meets exactly once.
    Which keys are cut follows from the counts alone; the result never depends on them. Both inputs are read twice.
    """
    counts = [x.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(on, F.ceil(F.col("_n") / block).cast("int").alias(f"_{s}s")) for x, s in ((a, "a"), (b, "b"))]
    hot = materialize(counts[0].join(counts[1], on, "full").select(on, F.coalesce("_as", F.lit(1)).alias("_as"), F.coalesce("_bs", F.lit(1)).alias("_bs")), "hot")
    if hot.isEmpty():
        return a.join(b, on)

    def cut(x: DataFrame, own: str, other: str) -> DataFrame:
        row = F.xxhash64(*(F.col(f"`{c}`") for c in x.columns))
        y = x.join(hot, on, "left").withColumn(own, F.pmod(row, F.coalesce(f"{own}s", F.lit(1))).cast("int"))
        return y.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1))).drop("_as", "_bs").repartition(on, "_a", "_b")

    return cut(a, "_a", "_b").join(cut(b, "_b", "_a"), [on, "_a", "_b"]).drop("_a", "_b")
