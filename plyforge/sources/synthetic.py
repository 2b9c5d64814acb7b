"""Synthetic annotated games by hashes of (seed, game, ply): any executor makes the same rows. The moves are no legal games."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.functions import movetext as M


# Fixed values of the distribution: mean and deviation of the plies, and the fewest; chance and size of a large error, deviation of the walk, its bounds;
# cumulative shares of pawn moves, pawn captures, castlings and promotions; chances of a file, a file or rank, a capture, a check and a mate score.
PLIES, FEWEST = (70, 25), 20
ERROR, ERROR_SIZE, WALK, BOUND = 0.045, (150, 450), 35, 1500
PAWN, PAWN_TAKES, CASTLING, PROMOTION = 0.35, 0.45, 0.50, 0.52
BY_FILE, BY_RANK, TAKES, CHECK, MATE_SCORE = 0.2, 0.4, 0.3, 0.06, 0.001


def _u(seed: int, *parts) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *(F.lit(p) if isinstance(p, str) else p for p in parts)), F.lit(1 << 40)) / float(1 << 40)


def _pick(u: Column, options: str) -> Column:
    return F.substring(F.lit(options), (F.floor(u * len(options)) + 1).cast("int"), F.lit(1))


def games(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """``n`` raw games: about 70 plies each; the evaluation wanders, with a large error in some 4.5 % of plies."""
    g, p = F.col("raw_id"), F.col("ply")
    u = lambda *names: _u(seed, g, p, *names)
    normal = lambda *names: F.sqrt(-2 * F.ln(F.greatest(u(*names, "r"), F.lit(1e-12)))) * F.cos(6.283185307179586 * u(*names, "t"))
    length = F.greatest(F.lit(FEWEST), F.rint(PLIES[0] + PLIES[1] * F.sqrt(-2 * F.ln(F.greatest(_u(seed, g, "len"), F.lit(1e-12)))) * F.cos(6.283185307179586 * _u(seed, g, "len2")))).cast("int")
    base = spark.range(n).select(F.col("id").alias("raw_id")).withColumn("n", length)
    rows = base.select("raw_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ply"))
    jump = F.when(u("j") < ERROR, F.when(u("s") < 0.5, -1).otherwise(1) * (ERROR_SIZE[0] + ERROR_SIZE[1] * u("size"))).otherwise(WALK * normal("walk"))
    order = W.partitionBy("raw_id").orderBy("ply")
    walk = F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.lit(M.START_CP) + F.sum(jump).over(order))).cast("int")
    rows = rows.withColumn("cp", walk).withColumn("before", F.lag("cp", 1, M.START_CP).over(order))
    to = F.concat(_pick(u("f"), "abcdefgh"), _pick(u("k"), "12345678"))
    kind = u("kind")
    piece = F.concat(_pick(u("piece"), "NBRQK"), F.when(u("d") < BY_FILE, _pick(u("df"), "abcdefgh")).when(u("d") < BY_RANK, _pick(u("dr"), "12345678")).otherwise(""), F.when(u("x") < TAKES, "x").otherwise(""), to, F.when(u("c") < CHECK, "+").otherwise(""))
    file = F.floor(u("f") * 8).cast("int")
    beside = F.substring(F.lit("abcdefgh"), F.when(file == 0, 2).when(file == 7, 7).otherwise(file + F.when(u("side") < 0.5, 0).otherwise(2)), F.lit(1))
    san = (
        F.when(kind < PAWN, to)
        .when(kind < PAWN_TAKES, F.concat(beside, F.lit("x"), to))
        .when(kind < CASTLING, F.when(u("castle") < 0.5, "O-O").otherwise("O-O-O"))
        .when(kind < PROMOTION, F.concat(_pick(u("f"), "abcdefgh"), F.lit("8="), _pick(u("promotion"), "QRBN")))
        .otherwise(piece)
    )
    white = p % 2 == 0
    glyph = F.coalesce(M.classify(F.col("before"), F.col("cp"), white), F.lit(""))
    number = F.concat((F.floor(p / 2) + 1).cast("string"), F.when(white, ".").otherwise("..."))
    value = F.when(u("mate") < MATE_SCORE, F.concat(F.lit("#"), (F.floor(u("in") * 9) + 1).cast("string"))).otherwise(F.format_string("%.2f", F.col("cp") / 100))
    cell = F.concat(number, F.lit(" "), san, glyph, F.lit(" { [%eval "), value, F.lit("] }"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ply", "cell"))), lambda c: c["cell"]), " ")
    made = rows.withColumn("cell", cell).groupBy("raw_id").agg(text.alias("text"))
    elo = lambda side: (1400 + F.floor(1201 * _u(seed, g, side))).cast("int")
    return made.select(
        "raw_id",
        F.format_string("https://games.example/s%07d", g).alias("site"),
        F.lit("2025.05.15").alias("utcdate"),
        elo("w").alias("whiteelo"),
        elo("b").alias("blackelo"),
        F.element_at(F.array(F.lit("180+0"), F.lit("300+0"), F.lit("600+8")), (F.floor(3 * _u(seed, g, "tc")) + 1).cast("int")).alias("timecontrol"),
        F.lit("1-0").alias("result"),
        F.lit("Normal").alias("termination"),
        F.lit("B01").alias("eco"),
        F.concat("text", F.lit(" 1-0")).alias("movetext"),
    )
