"""Queries of the problems tagged llm and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyforge.llm import chunking, mixing, overlap, packing, stuffing, term_frequency
from plyforge.sources.tables import table

#: Tokens of games.tokens in DuckDB.
TOKENS_SQL = r"CASE WHEN contains(tokens, '[') THEN regexp_extract_all(tokens, '\[([^\]]*)\]', 1) ELSE list_filter(regexp_split_to_array(tokens, '\s+'), lambda t: t <> '') END"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "games"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "games"))


def p1_same_game(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_rows(table(spark, d, "games")).where("by_game").select("row_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.pieces(table(spark, d, "games"), long_only=True)
    return cut.where("piece_no = 0 AND n_pieces > 1").select("row_id")


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pieces(table(spark, d, "games"))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.checks(table(spark, d, "games"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    found = term_frequency.marked(table(spark, d, "games"))
    return found.where(F.col("mark").isNotNull()).select(F.col("term").alias("token"), "mark")


def p4_frequency(spark: SparkSession, d: str) -> DataFrame:
    return term_frequency.marked(table(spark, d, "games")).withColumnRenamed("term", "token")


def p5_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.windows(table(spark, d, "documents"), table(spark, d, "pack_sizes"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes")
    packed, histograms = packing.pack(table(spark, d, "documents"), sizes)
    return packing.fills(packed, sizes, histograms)


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pack_sizes")
    return packing.checks(packing.windows(table(spark, d, "documents"), sizes), sizes)


def p6_repeats(spark: SparkSession, d: str) -> DataFrame:
    return mixing.repeats(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.repeats(table(spark, d, "documents"), targets), targets)


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.checks(mixing.repeats(table(spark, d, "documents"), targets), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.stuffed(table(spark, d, "documents")).select("doc_id")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    return stuffing.scores(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p1_same_game, p2_found, p2_pieces, p2_checks, p4_found, p4_frequency, p5_windows, p5_fill, p5_checks, p6_repeats, p6_shares, p6_checks, p7_found, p7_scores)}


def oracle_sql() -> dict[str, str]:
    frequency = f"""
        SELECT token, count(*) AS n_occurrences, count(DISTINCT row_id) AS n_records,
               CASE WHEN count(DISTINCT row_id) <= 3 THEN 'rare' WHEN count(DISTINCT row_id) > 0.3 * (SELECT count(*) FROM games) THEN 'common' END AS mark
        FROM (SELECT row_id, unnest({TOKENS_SQL}) AS token FROM games WHERE tokens IS NOT NULL) GROUP BY token"""
    game = r"""
        SELECT row_id, split_name, lower(regexp_extract(site, '^\s*(?:[hH][tT][tT][pP][sS]?://)?(?:[wW][wW][wW]\.)?([^/?#\s]+)/([A-Za-z0-9]{8})(?:[/?#\s]|$)', 1)) AS host,
               regexp_extract(site, '^\s*(?:[hH][tT][tT][pP][sS]?://)?(?:[wW][wW][wW]\.)?([^/?#\s]+)/([A-Za-z0-9]{8})(?:[/?#\s]|$)', 2) AS code,
               try_strptime(regexp_replace(regexp_extract(utc_date, '^\s*(\d{4}[-./]\d{1,2}[-./]\d{1,2})(?:[T\s]|$)', 1), '[./]', '-', 'g'), '%Y-%m-%d') AS day
        FROM games"""
    return {
        "p1_same_game": f"""WITH g AS ({game}) SELECT row_id FROM g WHERE split_name IN ('val', 'test') AND code <> '' AND day IS NOT NULL
            AND EXISTS (SELECT 1 FROM g t WHERE t.split_name = 'train' AND t.code = g.code AND t.host = g.host AND t.day = g.day)""",
        "p2_found": f"SELECT row_id FROM games WHERE len({TOKENS_SQL}) > 256",
        "p2_checks": f"SELECT count(*) FILTER (n > 0) AS n_streams, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_tokens, 0 AS n_over, 0 AS n_torn, 0 AS n_short, 0 AS n_open, 0 AS n_changed FROM (SELECT len({TOKENS_SQL}) AS n FROM games WHERE tokens IS NOT NULL)",
        "p5_checks": "SELECT container, (SELECT count(*) FROM documents WHERE text <> '') AS n_posts, 0 AS n_torn, 0 AS n_overfull, 0 AS n_uneven FROM pack_sizes",
        "p6_checks": r"""
            SELECT t.source, count(d.doc_id) AS n_posts, true AS on_target, true AS capped
            FROM (SELECT DISTINCT source FROM mix_targets) t LEFT JOIN documents d ON regexp_replace(lower(trim(d.source)), '[_\s]+', '-', 'g') = t.source GROUP BY t.source""",
        "p4_frequency": frequency,
        "p4_found": f"SELECT token, mark FROM ({frequency}) WHERE mark IS NOT NULL",
    }
