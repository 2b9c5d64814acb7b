"""Running sums and row numbers over groups of any size.

A window over a whole group would put a hot group into one task. Here each group is cut into slices by a hash of the row's key;
rows are summed within (group, slice), the slice totals are summed within the group (as many rows as slices), and both
add up to the running sum over the group in the order (slice, hash, key).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.sources.tables import materialize


def running_offset(df: DataFrame, group: list[str], keys: list[str], weight: str | None = None, name: str = "offset", slices: int = 64, seed: int = 0) -> DataFrame:
    """Add ``name``: the sum of ``weight`` (default: the count) of the rows before this one in its group.

    The order is by a hash of ``keys`` and ``seed``, so it is the same in every run; ``keys`` must identify a row within its
    group. ``df`` is read twice.
    """
    amount = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    h = F.xxhash64(F.lit(seed), *keys)
    rows = df.withColumn("_h", h).withColumn("_slice", F.pmod("_h", F.lit(slices)).cast("int"))
    totals = rows.groupBy(*group, "_slice").agg(F.sum(amount).alias("_n"))
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = W.partitionBy(*group, "_slice").orderBy("_h", *keys).rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_before", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    on = None
    for c in [*group, "_slice"]:
        same = ranked[c].eqNullSafe(starts[c])
        on = same if on is None else on & same
    joined = ranked.join(starts, on).select(*(ranked[c] for c in df.columns), (ranked["_before"] + starts["_start"]).alias(name))
    return joined


def _running(group: list[int], weight: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of the weights before each row in its run of equal groups; a run may go on in the next batch."""
        last, held = None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in group:
                code = pc.dictionary_encode(batch.column(k), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            first = tuple(batch.column(k)[0].as_py() for k in group)
            new[0] = True
            w = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(w) - w
            start = np.flatnonzero(new)
            base = total[start].copy()
            if first == last:
                base[0] -= held
            before = total - np.repeat(base, np.diff(np.r_[start, n]))
            last, held = tuple(batch.column(k)[n - 1].as_py() for k in group), int(before[-1] + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "_before"])

    return run


def ordered_offset(df: DataFrame, group: list[str], order: list[str], weight: str, name: str = "offset") -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group that come before in the order of ``order``.

    Rows are range-partitioned by ``order`` and sorted; each partition sums its own rows in one pass, and the partition totals (as many rows as
    partitions and groups) are summed in order. One shuffle of the rows. ``order`` must identify a row within its group. ``df`` is written to the
    shared folder before, as finding the ranges reads it too, and after, so that the partitions stay as they are.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(df, "rows")
    ranged = rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*group, *order)
    at = [ranged.columns.index(c) for c in group]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    summed = materialize(ranged.mapInArrow(_running(at, ranged.columns.index(weight)), f"{schema}, _before long"), "ranged")
    totals = summed.groupBy(*group, "_part").agg(F.sum(weight).alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_of_{c}") for c in [*group, "_part"]), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    on = None
    for c in [*group, "_part"]:
        same = F.col(c).eqNullSafe(F.col(f"_of_{c}"))
        on = same if on is None else on & same
    return summed.join(starts, on).select(*df.columns, (F.col("_before") + F.col("_start")).cast("long").alias(name))
