"""Shaping next-token distributions held as rows ``decode_id, idx, token, p``: mask, temperature, nucleus, floor, sampling.

All windows are per decode step, whose size is bounded by the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.operators import vocab as V

def _step():
    return W.partitionBy("decode_id")


SPECIAL = (*V.LABEL_WORDS.values(), *V.ENDINGS)

# Fixed values of the default configuration.
DEFAULTS = {"opening": 1.0, "middle": 0.05, "middle_from": 10, "end": 0.4, "end_from": 30, "min_p": 0.05, "min_p_from": 10, "top_p": 0.7, "top_k": 0}


def temperature_at(move: Column, opening: float, middle: float, middle_from: int, end: float, end_from: int) -> Column:
    """Temperature at a full move; the last stage is tested first, and a stage from move 0 is off."""
    t = F.lit(float(opening))
    if middle_from > 0:
        t = F.when(move >= middle_from, float(middle)).otherwise(t)
    return F.when(move >= end_from, float(end)).otherwise(t) if end_from > 0 else t


def masked(dist: DataFrame, allowed: DataFrame) -> DataFrame:
    """The allowed tokens with their probability; tokens the model says nothing about have 0."""
    p = F.when((F.col("p") > 0) & ~F.isnan("p"), F.col("p")).otherwise(0.0)
    return allowed.join(dist.select("decode_id", "token", "p"), ["decode_id", "token"], "left").withColumn("p", F.coalesce(p, F.lit(0.0)))


def from_dense(dense: DataFrame, allowed: DataFrame) -> DataFrame:
    """``masked`` for a model that answers with one array per step, a probability for every id (``decode_id, dense``); arrays that are too short read as 0. ``allowed`` has the token's ``token_id``."""
    p = F.get("dense", F.col("token_id"))
    return allowed.join(dense, "decode_id", "left").withColumn("p", F.when((p > 0) & ~F.isnan(p), p).otherwise(0.0)).drop("dense")


def tempered(dist: DataFrame, temperature: Column) -> DataFrame:
    """p^(1/T), renormalised; without any mass, uniform over the tokens that are neither labels nor endings (null if there are none)."""
    q = F.when(F.col("p") > 0, F.when(temperature == 1, F.col("p")).otherwise(F.pow(F.col("p"), 1 / temperature))).otherwise(0.0)
    d = dist.withColumn("q", q).withColumn("plain", (~F.col("token").isin(*SPECIAL)).cast("double"))
    total, plain = F.sum("q").over(_step()), F.sum("plain").over(_step())
    return d.withColumn("p", F.when(total > 0, F.col("q") / total).otherwise(F.try_divide("plain", plain))).drop("q", "plain")


def softmax(dist: DataFrame, temperature: float = 1.0, logit: str = "logit") -> DataFrame:
    e = F.exp((F.col(logit) - F.max(logit).over(_step())) / temperature)
    return dist.withColumn("e", e).withColumn("p", F.col("e") / F.sum("e").over(_step())).drop("e")


def softmax_dense(logits: Column, size: int, temperature: float = 1.0) -> Column:
    """Probabilities of the first ``size`` of an array of logits: a model may answer with more than the dictionary has."""
    own = F.slice(logits, F.lit(1), F.lit(size))
    e = F.transform(own, lambda x: F.exp((x - F.array_max(own)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _renormalised(dist: DataFrame, keep: str) -> DataFrame:
    q = F.when(F.col(keep), F.col("p")).otherwise(0.0)
    total = F.sum("q").over(_step())
    return dist.withColumn("q", q).withColumn("p", F.when(total > 0, F.col("q") / total).otherwise(F.col("p"))).drop("q", keep)


def top_p(dist: DataFrame, share: float, exempt: Iterable[str] = ()) -> DataFrame:
    """The most probable tokens up to and with the one that reaches ``share``; exempt tokens stay and do not count."""
    if not 0 < share < 1:
        return dist
    free = F.col("token").isin(*exempt) if exempt else F.lit(False)
    order = _step().orderBy(F.desc("p"), "idx").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(free, 0.0).otherwise(F.col("p"))).over(order), F.lit(0.0))
    return _renormalised(dist.withColumn("keep", (F.col("p") > 0) & (free | (before < share))), "keep")


def min_p(dist: DataFrame, floor: float | Column, exempt: Iterable[str] = ()) -> DataFrame:
    """Tokens of probability ``floor`` or more; exempt tokens stay; if no other is left, the best one."""
    if not isinstance(floor, Column) and floor <= 0:
        return dist
    free = F.col("token").isin(*exempt) if exempt else F.lit(False)
    best = F.row_number().over(_step().orderBy(free.cast("int"), F.desc("p"), "idx")) == 1
    return _renormalised(dist.withColumn("keep", (F.col("p") >= floor) | free | (best & ~free)), "keep")


def sampled(dist: DataFrame, u: Column) -> DataFrame:
    """One row per step: the first token, in order of ``idx``, at which the running sum reaches ``u``; else the last with any mass."""
    run = F.sum("p").over(_step().orderBy("idx").rowsBetween(W.unboundedPreceding, 0))
    d = dist.withColumn("u", u).withColumn("run", run)
    hit = F.min(F.when(F.col("run") >= F.col("u"), F.struct("idx", "token", "p")))
    last = F.max(F.when(F.col("p") > 0, F.struct("idx", "token", "p")))
    return d.groupBy("decode_id").agg(F.coalesce(hit, last).alias("s")).select("decode_id", "s.idx", "s.token", "s.p")


def gauges(dist: DataFrame) -> DataFrame:
    """Per step: mass of the labels, of mate, of each side's resignation and of a draw."""
    of = lambda *names: F.coalesce(F.sum(F.when(F.col("token").isin(*names), F.col("p"))), F.lit(0.0))
    return dist.groupBy("decode_id").agg(of(*V.LABEL_WORDS.values()).alias("label_mass"), of("#").alias("mate"), of(V.ENDINGS[0]).alias("white_resigns"), of(V.ENDINGS[1]).alias("black_resigns"), of(V.ENDINGS[4]).alias("draw"))


def ranked(dist: DataFrame, top: int) -> DataFrame:
    return dist.withColumn("rank", F.row_number().over(_step().orderBy(F.desc("p"), "idx"))).where(F.col("rank") <= top)


def prefix_marginals(sequences: DataFrame, prefix: list[str]) -> DataFrame:
    """Next-token probabilities given a prefix, from whole sequences ``decode_id, tokens, p``."""
    n = len(prefix)
    fits = (F.size("tokens") > n) & (F.slice("tokens", 1, n) == F.array(*map(F.lit, prefix)) if n else F.size("tokens") > 0)
    nxt = sequences.where(fits).groupBy("decode_id", F.get("tokens", F.lit(n)).alias("token")).agg(F.sum("p").alias("p"))
    return nxt.withColumn("p", F.col("p") / F.sum("p").over(_step()))


def sequence_scores(sequences: DataFrame) -> DataFrame:
    """Probability of each whole sequence as the product of its next-token probabilities along its prefixes (``decode_id, seq_id, tokens, p``)."""
    steps = sequences.select("decode_id", "seq_id", "p", F.size("tokens").alias("n"), F.posexplode("tokens").alias("i", "token"), "tokens")
    steps = steps.withColumn("prefix", F.array_join(F.slice("tokens", F.lit(1), F.col("i")), " "))
    mass = F.sum("p").over(W.partitionBy("decode_id", "prefix", "token")) / F.sum("p").over(W.partitionBy("decode_id", "prefix"))
    return steps.withColumn("step", mass).groupBy("decode_id", "seq_id").agg(F.exp(F.sum(F.ln("step"))).alias("p"))


def top_moves(scored: DataFrame, k: int, san: str = "san") -> DataFrame:
    """The ``k`` best moves of each step, and every mate."""
    r = F.row_number().over(_step().orderBy(F.desc("p"), san))
    return scored.withColumn("rank", r).where((F.col("rank") <= k) | F.contains(san, F.lit("#")))
