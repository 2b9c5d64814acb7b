"""Queries of the core: the project's own operators over its tables, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.functions import fen as P
from plyforge.functions import movetext as M
from plyforge.functions.streams import tokens_of
from plyforge.operators import buckets, decode, drift, encode, rules, segments, shaping, stage1
from plyforge.operators import vocab as V
from plyforge.operators.ranking import ordered_offset
from plyforge.sources import binary, compressed, pgn, reports, synthetic
from plyforge.sources.tables import materialize, months, shards, shared_dir, spread, table, write_shards
from plyforge.streaming import stage1 as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Settings of the Stage-2 and bucket queries, shared with their SQL.
FILTERS = {"min_elo": 1000, "max_elo": 2400, "min_plies": 20}
MONTHS = ("2024-03", "2024-09")
VAL_SHARE, DROPOUT, SEED = 0.05, 0.15, 1234
BLOCK, BATCH = 512, 32
PREFIXES = ("", "x", "+", "+ x", "<blunder>", "<blunder> x")
TOP_P, MIN_P, TEMPERATURE, U = 0.7013, 0.0503, 0.6, 0.618


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _text(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ").alias(ids)


# Problem 3


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "shard_rows")).select("feed", "shard_no", "field_name", "change_kind")


@query
def p3_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified(table(spark, d, "shard_rows"))


@query
def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    return drift.profile(table(spark, d, "shard_rows")).select("feed", "shard_no", "key", "kind", "n")


@query
def p3_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.alternatives(table(spark, d, "shard_rows"))


@query
def p3_readable(spark: SparkSession, d: str) -> DataFrame:
    return drift.readability(table(spark, d, "shard_rows"))


@query
def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the unified table: every record once, canonical values only, and results that agree with the field ``movetext_result`` where a record has both."""
    u = drift.unified(table(spark, d, "shard_rows"))
    return u.agg(
        F.count("*").alias("n_rows"),
        F.count_if("readable").alias("n_readable"),
        F.count_if(~F.col("result").isin("1-0", "0-1", "1/2-1/2")).alias("n_other_results"),
        F.count_if(~F.col("termination").isin(*drift.TERMINATIONS)).alias("n_other_terminations"),
        F.count_if(F.col("result") != F.col("movetext_result")).alias("n_different"),
    )


# Stage 1


@query
def nerf_rate_by_elo(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: share of annotated errors by rating bucket of the mover, from raw text."""
    raw = stage1.annotated(spread(table(spark, d, "raw_games")), 0)
    rows = stage1.ply_rows(raw, ("whiteelo", "blackelo"))
    mover = V.elo_bucket(F.when(F.col("white"), F.col("whiteelo")).otherwise(F.col("blackelo")))
    label = F.col("computed")
    return rows.groupBy(mover.alias("bucket")).agg(
        F.count("*").alias("n_plies"), F.count(label).alias("n_errors"), F.count_if(label == "??").alias("n_blunders"), F.round(F.count(label) / F.count("*"), 6).alias("rate")
    )


@query
def scan_filter_pushdown(spark: SparkSession, d: str) -> DataFrame:
    return stage1.annotated(table(spark, d, "raw_games"), 1600).select("raw_id", "site", "whiteelo", "blackelo")


@query
def strict_games(spark: SparkSession, d: str) -> DataFrame:
    return stage1.strict_selection(spread(table(spark, d, "raw_games"))).select("raw_id", F.size("plies").alias("n_plies"), stage1.speed(F.col("timecontrol")).alias("speed"))


@query
def lex_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_games").select("raw_id", F.posexplode(M.lexemes(F.col("movetext"))).alias("i", "lexeme"))


@query
def movetext_result(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_games").select("raw_id", M.movetext_result(F.col("movetext")).alias("text_result"))


@query
def parse_plies(spark: SparkSession, d: str) -> DataFrame:
    games = stage1.with_plies(spread(table(spark, d, "raw_games")))
    return games.select("raw_id", F.posexplode("plies").alias("ply", "p")).select("raw_id", "ply", "p.san", "p.glyph", "p.cp")


@query
def eval_to_cp(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "raw_games").select(F.explode(F.regexp_extract_all("movetext", F.lit(M.EVAL), F.lit(1))).alias("eval")).distinct()
    return found.select("eval", M.eval_to_cp(F.col("eval")).alias("cp"))


@query
def win_pct(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "games").select(F.explode("cp").alias("cp")).distinct()
    return found.select("cp", F.round(M.win_pct(F.col("cp")), 6).alias("pct"))


@query
def carry_forward_eval(spark: SparkSession, d: str) -> DataFrame:
    return stage1.ply_rows(spread(table(spark, d, "raw_games"))).select("raw_id", "ply", "cp", "cp_before")


@query
def label_plies(spark: SparkSession, d: str) -> DataFrame:
    return stage1.ply_rows(spread(table(spark, d, "raw_games"))).select("raw_id", "ply", "inline", "computed", "disagrees")


@query
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    rows = stage1.ply_rows(spread(table(spark, d, "raw_games")))
    return rows.groupBy(F.coalesce("computed", F.lit("none")).alias("label")).agg(F.count("*").alias("n"))


@query
def glyph_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = stage1.ply_rows(spread(table(spark, d, "raw_games"))).where("disagrees")
    return rows.groupBy(F.coalesce("inline", F.lit("none")).alias("inline"), F.coalesce("computed", F.lit("none")).alias("computed")).agg(F.count("*").alias("n"))


@query
def split_glyph(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "raw_games").select(F.explode(M.lexemes(F.col("movetext"))).alias("word")).where(~F.col("word").startswith("{")).distinct()
    san, glyph = M.split_glyph(F.col("word"))
    return words.select("word", san.alias("san"), glyph.alias("glyph"))


@query
def san_tokens(spark: SparkSession, d: str) -> DataFrame:
    sans = stage1.ply_rows(spread(table(spark, d, "raw_games"))).select("san").distinct()
    return sans.select("san", F.array_join(M.san_tokens(F.col("san"), F.lit(None).cast("string")), " ").alias("tokens"), F.col("san").rlike(M.LOOSE_SAN).alias("loose"))


@query
def tokens_to_san(spark: SparkSession, d: str) -> DataFrame:
    sans = stage1.ply_rows(spread(table(spark, d, "raw_games"))).select("san").distinct().where(F.col("san").rlike(M.SAN))
    tokens = M.san_tokens(F.col("san"), F.lit(None).cast("string"), bracketed=False)
    return sans.select("san", M.tokens_to_san(tokens).alias("back"))


@query
def tokenise_games(spark: SparkSession, d: str) -> DataFrame:
    return stage1.tokenised(spread(table(spark, d, "raw_games"))).withColumn("cp", _text("cp"))


@query
def tokenise_games_computed(spark: SparkSession, d: str) -> DataFrame:
    return stage1.tokenised(spread(table(spark, d, "raw_games")), 0, 0, "computed").select("raw_id", "tokens")


@query
def quarantine_games(spark: SparkSession, d: str) -> DataFrame:
    return stage1.parsed(stage1.annotated(table(spark, d, "raw_games"), 0)).where("has_evals AND malformed").select("raw_id")


@query
def tokenise_games_native(spark: SparkSession, d: str) -> DataFrame:
    """The same as ``tokenise_games`` in native expressions alone."""
    return stage1.tokenised(spread(table(spark, d, "raw_games")), engine="native").withColumn("cp", _text("cp"))


@query
def label_plies_native(spark: SparkSession, d: str) -> DataFrame:
    return stage1.ply_rows(spread(table(spark, d, "raw_games")), engine="native").select("raw_id", "ply", "inline", "computed", "disagrees")


@query
def stage1_stats(spark: SparkSession, d: str) -> DataFrame:
    return stage1.stats(spread(table(spark, d, "raw_games")))


@query
def token_frequency(spark: SparkSession, d: str) -> DataFrame:
    return stage1.token_frequency(table(spark, d, "games"))


@query
def token_frequency_top(spark: SparkSession, d: str) -> DataFrame:
    return stage1.token_frequency(table(spark, d, "games")).orderBy(F.desc("n"), "token").limit(20)


@query
def games_per_month_limit(spark: SparkSession, d: str) -> DataFrame:
    """The per-source limit in a form with a defined result: the first five games of each month."""
    raw = table(spark, d, "raw_games").select("raw_id", M.year_month(F.col("utcdate")).alias("month"))
    return raw.withColumn("rank", F.row_number().over(W.partitionBy("month").orderBy("raw_id"))).where("rank <= 5")


# Dictionary and Stage 2


@query
def vocab_table(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(spark)


@query
def vocab_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return V.vocabulary(spark).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("token").alias("n_distinct"), F.min("token_id").alias("first_id"), F.max("token_id").alias("last_id"))


@query
def translate_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "games").select(F.explode(tokens_of(F.col("tokens"))).alias("token")).distinct()
    return tokens.select("token", V.surface(F.col("token")).alias("word"))


@query
def encode_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Token to id as a join: every distinct token of the games, its id if it has one."""
    tokens = table(spark, d, "games").select(F.explode(tokens_of(F.col("tokens"))).alias("token")).distinct().withColumn("word", V.surface(F.col("token")))
    vocabulary = F.broadcast(V.vocabulary(spark))  # 5,273 rows, fixed
    return tokens.join(vocabulary, tokens["word"] == vocabulary["token"], "left").select(tokens["token"], "token_id")


@query
def elo_bucket(spark: SparkSession, d: str) -> DataFrame:
    elos = table(spark, d, "games").select(F.explode(F.array("white_elo", "black_elo")).alias("elo")).distinct()
    return elos.select("elo", V.elo_bucket(F.col("elo")).alias("training"), V.elo_bucket(F.col("elo"), V.ELO_ANY).alias("serving"))


@query
def end_token_class(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.encoded(spread(table(spark, d, "games")))
    return rows.groupBy(F.coalesce("end_token", F.lit("bare")).alias("end_token")).agg(F.count("*").alias("n"))


@query
def encode_games(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL").select("row_id", "split", F.size("ids").alias("length"), _text("ids"))


@query
def decode_games(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL")
    return encode.decoded(rows).select("row_id", F.array_join("words", " ").alias("words"))


@query
def elo_dropout_hash(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(spread(table(spark, d, "games")), dropout=DROPOUT, seed=SEED).select("row_id", "white_token", "black_token")


@query
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "games").select("row_id", encode.split_of(F.col("site"), F.col("utc_date"), VAL_SHARE).alias("split"))


@query
def month_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "games").select("row_id", encode.split_of(F.col("site"), F.col("utc_date"), months=MONTHS).alias("split"))


@query
def stage2_filters(spark: SparkSession, d: str) -> DataFrame:
    return encode.filtered(encode.shard_columns(table(spark, d, "games")), **FILTERS).select("row_id", "white_elo", "black_elo", "n_plies")


@query
def unknown_token_docfreq(spark: SparkSession, d: str) -> DataFrame:
    return encode.unknown_tokens(table(spark, d, "games"))


@query
def unknown_token_top(spark: SparkSession, d: str) -> DataFrame:
    return encode.unknown_tokens(table(spark, d, "games"), 20)


@query
def pack_stats(spark: SparkSession, d: str) -> DataFrame:
    return encode.stats(table(spark, d, "games"), **FILTERS, fraction=VAL_SHARE)


@query
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL")
    return rows.groupBy("split").agg(F.count("*").alias("n_games"), F.sum(F.size("ids")).alias("n_tokens"))


@query
def game_offsets(spark: SparkSession, d: str) -> DataFrame:
    return encode.packed(spread(table(spark, d, "games"))).select("split", "row_id", "length", "start")


@query
def offset_index(spark: SparkSession, d: str) -> DataFrame:
    return encode.offsets(encode.packed(spread(table(spark, d, "games"))))


@query
def offset_scan(spark: SparkSession, d: str) -> DataFrame:
    return encode.starts_by_scan(encode.packed(spread(table(spark, d, "games"))))


@query
def offsets_valid(spark: SparkSession, d: str) -> DataFrame:
    corpus = encode.packed(spread(table(spark, d, "games")))
    return encode.valid_offsets(encode.offsets(corpus), corpus)


@query
def inspect_corpus(spark: SparkSession, d: str) -> DataFrame:
    return encode.inspected(encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL"))


@query
def vocab_check(spark: SparkSession, d: str) -> DataFrame:
    return encode.vocabulary_check(stage1.ply_rows(spread(table(spark, d, "raw_games"))))


@query
def corpus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The flat 16-bit corpus, written and read back."""
    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    binary.write_corpus(encode.packed(spread(table(spark, d, "games"))), path)
    return binary.read_corpus(spark, path).select("split", _text("ids"))


# Length buckets, segments, rows


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL").select("row_id", "split", F.size("ids").alias("length"))


@query
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).groupBy("length").agg(F.count("*").alias("n"))


@query
def bucket_assign(spark: SparkSession, d: str) -> DataFrame:
    return _lengths(spark, d).select("row_id", "length", buckets.bucket_of(F.col("length"), BLOCK).alias("cap"))


@query
def bucket_mass(spark: SparkSession, d: str) -> DataFrame:
    return buckets.bucket_table(_lengths(spark, d), BLOCK, BATCH).withColumn("probability", F.round("probability", 6))


@query
def rows_for_cap(spark: SparkSession, d: str) -> DataFrame:
    caps = spark.createDataFrame([(c, b, n) for b, n in ((1024, 64), (512, 32)) for c in buckets.caps(b)], "cap int, block int, batch int")
    of = lambda b, n: buckets.rows_for_cap(F.col("cap"), b, n)
    return caps.select("cap", "block", F.when(F.col("block") == 1024, of(1024, 64)).otherwise(of(512, 32)).alias("rows"))


@query
def segment_plan(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_rows(encode.encoded(spread(table(spark, d, "games")))).drop("ids")


@query
def all_segment_rows(spark: SparkSession, d: str) -> DataFrame:
    return segments.training_rows(encode.encoded(spread(table(spark, d, "games")))).select("row_id", "seg", _text("x"), _text("y"))


@query
def graded_density(spark: SparkSession, d: str) -> DataFrame:
    rows = segments.training_rows(encode.encoded(spread(table(spark, d, "games"))))
    graded = F.size(F.filter("y", lambda t: t >= 0))
    return rows.agg(F.count("*").alias("n_rows"), F.sum(F.size("y")).alias("n_targets"), F.sum(graded).alias("n_graded"))


@query
def pad_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = buckets.padded(segments.training_rows(encode.encoded(spread(table(spark, d, "games")))), BLOCK)
    return rows.groupBy("cap").agg(F.count("*").alias("n_rows"), F.sum(F.size("x")).alias("n_inputs"), F.sum(F.size(F.filter("y", lambda t: t == -1))).alias("n_ungraded"))


@query
def sample_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = materialize(segments.training_rows(encode.encoded(spread(table(spark, d, "games"))), epoch=0), "rows")
    return buckets.batches(rows, steps=4, block=BLOCK, batch=BATCH).select("step", "slot", "row_id", "cap", F.size("x").alias("width"))


@query
def oversized_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fit no bucket, counted rather than lost."""
    return buckets.oversized(segments.training_rows(encode.encoded(spread(table(spark, d, "games")))), BLOCK)


@query
def chosen_segments(spark: SparkSession, d: str) -> DataFrame:
    """One segment per game and epoch: the same as among all segments of the game, whose number is given."""
    games = encode.encoded(spread(table(spark, d, "games")))
    n = segments.segment_rows(games).groupBy("row_id").agg(F.count("*").alias("n_segments"))
    return segments.segment_rows(games, epoch=3).join(n, "row_id").select("row_id", "n_segments", (F.col("seg") < F.col("n_segments")).alias("within"))


@query
def sample_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of drawn batches: as many rows as their bucket asks for, all as wide as it, targets nowhere past the inputs' end."""
    rows = materialize(segments.training_rows(encode.encoded(spread(table(spark, d, "games"))), epoch=0), "rows")
    drawn = materialize(buckets.batches(rows, steps=4, block=BLOCK, batch=BATCH), "drawn")
    per = drawn.groupBy("step").agg(F.count("*").alias("n"), F.min("cap").alias("cap"), F.count_distinct("cap").alias("caps"), F.max((F.size("x") != F.col("cap")) | (F.size("y") != F.col("cap"))).alias("ragged"))
    return per.agg(F.count("*").alias("n_steps"), F.count_if(F.col("n") != buckets.rows_for_cap(F.col("cap"), BLOCK, BATCH)).alias("n_short"), F.count_if((F.col("caps") > 1) | F.col("ragged")).alias("n_ragged"))


@query
def end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Raw games to packed ids in one plan: parse, label, tokenise, encode; counts per split and end."""
    games = stage1.tokenised(spread(table(spark, d, "raw_games")), 0, 0).withColumnRenamed("raw_id", "row_id")
    rows = encode.encoded(games)
    return rows.groupBy("split", F.coalesce("end_token", F.lit("bare")).alias("end_token")).agg(F.count("*").alias("n_games"), F.count("ids").alias("n_packed"), F.coalesce(F.sum(F.when(F.col("ids").isNotNull(), F.size("ids"))), F.lit(0)).alias("n_tokens"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "games")).select("row_id", F.transform(tokens_of(F.col("tokens")), V.surface).alias("words"))


@query
def regroup_moves(spark: SparkSession, d: str) -> DataFrame:
    moves = segments.move_groups(_words(spark, d))
    return moves.select("row_id", F.posexplode("groups").alias("move_no", "g")).select("row_id", "move_no", F.array_join("g", " ").alias("words"))


# Distributions: the next word given the word before, from all games


def _bigrams(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("words")
    pairs = _words(spark, d).select(F.explode(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))).alias("b"))).alias("p"))
    counts = pairs.select(F.col("p.a").alias("decode_id"), F.col("p.b").alias("token")).groupBy("decode_id", "token").agg(F.count("*").alias("n"))
    vocabulary = F.broadcast(V.vocabulary(spark).select("token", F.col("token_id").alias("idx")))  # fixed size
    return counts.join(vocabulary, "token", "left").select("decode_id", "idx", "token", F.col("n").cast("double").alias("p"), "n")


def _masked(spark: SparkSession, d: str) -> DataFrame:
    rows = _bigrams(spark, d)
    return shaping.masked(rows, rows.where("idx IS NOT NULL").select("decode_id", "idx", "token"))


def _shown(df: DataFrame, *more: str) -> DataFrame:
    return df.select("decode_id", "token", *more, F.round("p", 6).alias("p"))


@query
def mask_renormalise(spark: SparkSession, d: str) -> DataFrame:
    return _shown(shaping.tempered(_masked(spark, d), F.lit(1.0)))


@query
def temperature(spark: SparkSession, d: str) -> DataFrame:
    return _shown(shaping.tempered(_masked(spark, d), F.lit(TEMPERATURE)))


@query
def temperature_schedule(spark: SparkSession, d: str) -> DataFrame:
    lengths = table(spark, d, "games").select((F.floor(F.coalesce("n_plies", F.lit(0)) / 2) + 1).cast("int").alias("move")).distinct()
    c = shaping.DEFAULTS
    return lengths.select("move", shaping.temperature_at(F.col("move"), c["opening"], c["middle"], c["middle_from"], c["end"], c["end_from"]).alias("t"))


@query
def top_p(spark: SparkSession, d: str) -> DataFrame:
    return _shown(shaping.top_p(shaping.tempered(_masked(spark, d), F.lit(1.0)), TOP_P, ("#",)).where("p > 0"))


@query
def min_p(spark: SparkSession, d: str) -> DataFrame:
    return _shown(shaping.min_p(shaping.tempered(_masked(spark, d), F.lit(1.0)), MIN_P).where("p > 0"))


@query
def softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = _bigrams(spark, d).withColumn("logit", F.ln("p"))
    return _shown(shaping.softmax(rows, 2.0))


@query
def top_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _shown(shaping.ranked(shaping.tempered(_masked(spark, d), F.lit(1.0)), 5), "rank")


@query
def gauges(spark: SparkSession, d: str) -> DataFrame:
    g = shaping.gauges(shaping.tempered(_masked(spark, d), F.lit(1.0)))
    return g.select("decode_id", *(F.round(c, 6).alias(c) for c in ("label_mass", "mate", "white_resigns", "black_resigns", "draw")))


@query
def inverse_sample(spark: SparkSession, d: str) -> DataFrame:
    return shaping.sampled(shaping.tempered(_masked(spark, d), F.lit(1.0)), F.lit(U)).select("decode_id", "token")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    """Distinct whole moves of all games as sequences, with their frequency: one decode step per first letter of the move."""
    groups = segments.move_groups(_words(spark, d)).select(F.explode("groups").alias("tokens"))
    counts = groups.withColumn("decode_id", F.substring(F.element_at("tokens", -1), 1, 1)).groupBy("decode_id", "tokens").agg(F.count("*").cast("double").alias("p"))
    return counts.withColumn("seq_id", F.array_join("tokens", " "))


@query
def prefix_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Next-token probabilities after several prefixes, also none."""
    moves = _moves(spark, d)
    out = None
    for prefix in PREFIXES:
        part = _shown(shaping.prefix_marginals(moves, prefix.split())).withColumn("prefix", F.lit(prefix))
        out = part if out is None else out.unionByName(part)
    return out


@query
def uniform_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Distributions without any mass on what is allowed: uniform over the tokens that are neither labels nor endings."""
    rows = _bigrams(spark, d)
    some = rows.where("idx IS NOT NULL").select("decode_id", "idx", "token")
    silent = rows.where(~F.col("decode_id").startswith("N"))  # the model says nothing after a knight's move
    return _shown(shaping.tempered(shaping.masked(silent, some), F.lit(1.0)))


@query
def sequence_scores(spark: SparkSession, d: str) -> DataFrame:
    return shaping.sequence_scores(_moves(spark, d)).select("decode_id", "seq_id", F.round("p", 6).alias("p"))


@query
def topk_moves(spark: SparkSession, d: str) -> DataFrame:
    moves = _moves(spark, d).select("decode_id", M.tokens_to_san(F.filter("tokens", lambda t: ~t.startswith("<"))).alias("san"), "p").groupBy("decode_id", "san").agg(F.sum("p").alias("p"))
    return shaping.top_moves(moves, 5).select("decode_id", "san", F.col("p").cast("bigint").alias("n"), "rank")


# Positions

#: Position strings made of the keys of orders, some of them not valid; the text is plain SQL for both engines.
FEN_SQL = """concat(
 CASE o_orderkey % 7 WHEN 0 THEN 'rnbqkbnr' WHEN 1 THEN 'r3k2r' WHEN 2 THEN '4k3' WHEN 3 THEN '1bk5' WHEN 4 THEN 'k6b' WHEN 5 THEN '3qk2P' ELSE '4k2r' END, '/',
 CASE o_custkey % 5 WHEN 0 THEN 'pppppppp' WHEN 1 THEN '8' WHEN 2 THEN 'p1p2p1p' WHEN 3 THEN '44' ELSE '2n5' END, '/8/8/',
 CASE o_orderkey % 3 WHEN 0 THEN '8' WHEN 1 THEN '3B4' ELSE 'b7' END, '/8/',
 CASE o_custkey % 4 WHEN 0 THEN 'PPPPPPPP' WHEN 1 THEN '8' WHEN 2 THEN '2B2x2' ELSE '7B' END, '/',
 CASE o_orderkey % 6 WHEN 0 THEN 'RNBQKBNR' WHEN 1 THEN 'R3K2R' WHEN 2 THEN '4K3' WHEN 3 THEN 'K6K' WHEN 4 THEN '4K2R' ELSE '7' END, ' ',
 CASE o_custkey % 9 WHEN 0 THEN 'b' WHEN 1 THEN 'x' WHEN 2 THEN 'b' ELSE 'w' END, ' ',
 CASE o_orderkey % 8 WHEN 0 THEN 'KQkq' WHEN 1 THEN 'KX' ELSE '-' END, ' ',
 CASE o_custkey % 11 WHEN 0 THEN 'e3' WHEN 1 THEN 'e6' WHEN 2 THEN 'e9' ELSE '-' END, ' ',
 CASE o_orderkey % 13 WHEN 0 THEN '-1' WHEN 1 THEN '101' WHEN 2 THEN 'a' ELSE '0' END, ' ',
 CASE o_custkey % 17 WHEN 0 THEN '0' WHEN 1 THEN '' ELSE '12' END)"""


def _spelled(spark: SparkSession, d: str) -> DataFrame:
    """Position strings of which many are not valid."""
    return table(spark, d, "orders").select(F.expr(FEN_SQL).alias("fen")).distinct()


def _sans(spark: SparkSession, d: str) -> DataFrame:
    games = stage1.with_plies(spread(table(spark, d, "raw_games")))
    return games.select("raw_id", F.transform("plies", lambda p: p["san"]).alias("sans"))


def _positions(spark: SparkSession, d: str) -> DataFrame:
    """The positions in which the raw games end (or break off), and the valid ones of ``_spelled``."""
    ends = rules.replay(_sans(spark, d), "raw_id", "sans").select(F.col("last_fen").alias("fen"))
    return materialize(ends.unionByName(rules.valid(_spelled(spark, d))).distinct(), "positions")


@query
def fen_validate(spark: SparkSession, d: str) -> DataFrame:
    return _spelled(spark, d).select("fen", P.fen_error(F.col("fen")).alias("error"))


@query
def fen_material(spark: SparkSession, d: str) -> DataFrame:
    rows = stage1.once(rules.valid(_spelled(spark, d)), squares=P.board(F.col("fen")))
    total, balance = P.material(F.col("fen"), F.col("squares"))
    rows = stage1.once(rows, material=total, balance=balance)
    resign, draw = P.end_masses(F.col("material"), F.col("balance"))
    return rows.select("fen", "material", "balance", resign.alias("resign"), draw.alias("draw"))


@query
def fen_dead(spark: SparkSession, d: str) -> DataFrame:
    return rules.valid(_spelled(spark, d)).select("fen", P.insufficient_material(F.col("fen")).alias("dead"))


@query
def fen_ascii(spark: SparkSession, d: str) -> DataFrame:
    return rules.valid(_spelled(spark, d)).select("fen", P.ascii_board(F.col("fen")).alias("board"))


@query
def square_maths(spark: SparkSession, d: str) -> DataFrame:
    squares = V.vocabulary(spark).where(F.length("token") == 2).where(F.col("token").rlike("^[a-h][1-8]$"))
    return squares.select("token", P.square_index(F.col("token")).alias("index"), P.square_colour(F.col("token")).alias("colour"))


@query
def legal_moves(spark: SparkSession, d: str) -> DataFrame:
    return rules.legal_moves(_positions(spark, d).withColumn("id", F.xxhash64("fen"))).drop("id")


@query
def position_status(spark: SparkSession, d: str) -> DataFrame:
    return rules.status(_positions(spark, d).withColumn("id", F.xxhash64("fen")))


@query
def perft(spark: SparkSession, d: str) -> DataFrame:
    start = spark.createDataFrame([(rules.START,), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1",)], "fen string")
    return rules.perft(start, 3)


@query
def replay_games(spark: SparkSession, d: str) -> DataFrame:
    return rules.replay(_sans(spark, d), "raw_id", "sans")


@query
def replay_plies(spark: SparkSession, d: str) -> DataFrame:
    return rules.replay_plies(_sans(spark, d), "raw_id", "sans")


@query
def replay_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold in every replayed game: plies without a gap, a clock that grows by one or starts again, a side that alternates, pieces that never grow, and hashes that agree with the positions."""
    plies = materialize(rules.replay_plies(_sans(spark, d), "raw_id", "sans"), "plies")
    before = plies.select("raw_id", (F.col("ply") + 1).alias("ply"), F.col("half_moves").alias("half_before"), F.col("fen").alias("fen_before"))
    pieces = lambda c: F.length(F.regexp_replace(F.split(c, " ")[0], "[^a-zA-Z]", ""))
    own = plies.join(before, ["raw_id", "ply"], "left")
    place = F.substring_index("fen", " ", 4)
    odd = own.agg(
        F.count_if((F.col("ply") > 1) & F.col("fen_before").isNull()).alias("n_gaps"),
        F.count_if((F.col("half_moves") != 0) & (F.col("half_moves") != F.coalesce("half_before", F.lit(0)) + 1)).alias("n_clock"),
        F.count_if(F.split("fen", " ")[1] != F.when(F.col("ply") % 2 == 1, "b").otherwise("w")).alias("n_turn"),
        F.count_if(pieces(F.col("fen")) > pieces(F.col("fen_before"))).alias("n_grown"),
    )
    hashes = plies.select(place.alias("place"), "position_hash").distinct().agg((F.count("*") - F.count_distinct("place")).alias("n_hash"))
    return odd.crossJoin(hashes)  # two single rows


@query
def review_positions(spark: SparkSession, d: str) -> DataFrame:
    """The position after half of each game's moves."""
    return rules.replay(_sans(spark, d).select("raw_id", F.slice("sans", F.lit(1), F.floor(F.size("sans") / 2).cast("int")).alias("sans")), "raw_id", "sans").select("raw_id", F.col("n_legal").alias("ply"), F.col("last_fen").alias("fen"))


@query
def permissive_san(spark: SparkSession, d: str) -> DataFrame:
    """Every legal move of the positions written as squares, with piece and dash, and with all its squares, read back: how many name the move they were made from."""
    moves = rules.legal_moves(_positions(spark, d).withColumn("id", F.xxhash64("fen")))
    return rules.read_back(moves).agg(F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in ("san", "squares", "dashed", "full")))


@query
def move_kinds(spark: SparkSession, d: str) -> DataFrame:
    moves = rules.move_kinds(rules.legal_moves(_positions(spark, d).withColumn("id", F.xxhash64("fen"))))
    return moves.groupBy("piece").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in ("is_capture", "is_promotion", "is_en_passant", "is_short_castle", "is_long_castle", "is_double_step")))


def _to_move(spark: SparkSession, d: str) -> DataFrame:
    """Distinct positions with a rating of the opponent, made of the position's hash; some are null."""
    h = F.xxhash64("fen")
    return _positions(spark, d).select(h.alias("id"), "fen", F.when(F.pmod(h, F.lit(5)) > 0, (F.pmod(h, F.lit(30)) * 100).cast("int")).alias("rating"))


@query
def decode_moves(spark: SparkSession, d: str) -> DataFrame:
    return decode.decode_moves(_to_move(spark, d), decode.heuristic_model, rating="rating")


@query
def decode_blunders(spark: SparkSession, d: str) -> DataFrame:
    """Every label allowed, the ten best moves, and a quality asked for."""
    config = decode.Config(labels=tuple(decode.QUALITY), force_quality="blunder", seed=7)
    return decode.decode_moves(_to_move(spark, d), decode.heuristic_model, config, rating="rating")


@query
def decode_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of decoded moves: one action per position, legal moves only, none exactly without legal moves, and mates in one always played."""
    positions = materialize(_to_move(spark, d), "positions")
    out = materialize(decode.decode_moves(positions, decode.heuristic_model, decode.Config(labels=tuple(decode.QUALITY), top_k=10), rating="rating"), "decoded")
    legal = rules.legal_moves(positions).groupBy("id").agg(F.collect_set("san").alias("sans"), F.max(F.endswith("san", F.lit("#"))).alias("mates"))  # at most 218 a position
    own = positions.select("id").join(out, "id", "left").join(legal, "id", "left")
    none = F.col("sans").isNull()
    return own.agg(
        (F.count("*") - F.count_distinct("id")).alias("n_twice"),
        F.count_if(F.col("outcome").isNull()).alias("n_open"),
        F.count_if((F.col("outcome") == "none") != none).alias("n_none"),
        F.count_if((F.col("outcome") == "move") & ~F.coalesce(F.array_contains("sans", F.col("san")), F.lit(False))).alias("n_illegal"),
        F.count_if(F.col("mates") & (F.col("outcome") == "move") & F.col("label").isNull() & ~F.endswith("san", F.lit("#"))).alias("n_missed"),
    )


@query
def label_chances(spark: SparkSession, d: str) -> DataFrame:
    """How likely the heuristic model announces each label, by the opponent's rating."""
    elos = table(spark, d, "games").select(F.explode(F.array("white_elo", "black_elo")).alias("rating")).distinct()
    return elos.select("rating", *(F.round(decode.label_chance(t, F.col("rating")), 9).alias(q) for t, q in decode.QUALITY.items()))


@query
def shaping_chain(spark: SparkSession, d: str) -> DataFrame:
    """The shaping in its order, mask, temperature, nucleus, floor, over the next-word distributions."""
    rows = _bigrams(spark, d)
    allowed = rows.where("idx IS NOT NULL").select("decode_id", F.col("decode_id").alias("ctx"), F.lit(12).alias("move_no"), "idx", "token")
    config = decode.Config(mid=TEMPERATURE, top_p=TOP_P, min_p=MIN_P, exempt=("#",))
    return _shown(decode.shaped(rows.select(F.col("decode_id").alias("ctx"), "token", "p"), allowed, config).where("p > 0"))


@query
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Model input of every game that the dictionary covers: both ratings by colour, the moves, a label for every third, a partial move, cut to 64."""
    rows = encode.encoded(spread(table(spark, d, "games"))).where("ids IS NOT NULL").select("row_id").join(_words(spark, d), "row_id").join(table(spark, d, "games").select("row_id", "white_elo", "black_elo"), "row_id")
    turn = F.when(F.col("row_id") % 2 == 0, "w").otherwise("b")
    label = F.when(F.col("row_id") % 3 == 0, V.LABEL_WORDS["?"])
    words = decode.context_words(F.col("words"), turn, V.elo_bucket(F.coalesce("white_elo", F.lit(0))), F.col("black_elo"), label, F.array(F.lit("x")))
    numbered = stage1.once(rows, context=words).withColumn("numbers", V.lookup("context"))
    return numbered.select("row_id", decode.context_ids(F.col("numbers"), 64).alias("ids")).select("row_id", _text("ids"))


# Sources, sinks, streams


@query
def loose_san(spark: SparkSession, d: str) -> DataFrame:
    sans = stage1.ply_rows(spread(table(spark, d, "raw_games"))).select("san").distinct()
    return sans.select("san", F.array_join(M.loose_tokens(F.col("san")), " ").alias("tokens"))


@query
def pgn_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Raw games as PGN files of wrapped lines, with evaluations as comments and glyphs as signs, read back."""
    games = stage1.with_plies(spread(table(spark, d, "raw_games")))
    headers = F.create_map(F.lit("Event"), F.lit("rated"), F.lit("Site"), F.col("site"), F.lit("Id"), F.col("raw_id").cast("string"), F.lit("Result"), F.col("result"))
    part = lambda f: F.transform("plies", f)
    comments = part(lambda p: F.concat(F.lit("[%eval "), p["eval"], F.lit("] {noted}")))
    text = pgn.to_pgn(headers, part(lambda p: p["san"]), F.col("result"), 80, comments=comments, nags=part(lambda p: p["glyph"]))
    path = f"{shared_dir(spark)}/pgn-{uuid.uuid4().hex}"
    games.select(F.concat(text, F.lit("\n")).alias("value")).write.text(path)
    back = pgn.read_pgn(spark, path)
    some = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    return back.select(F.col("headers")["Id"].cast("long").alias("raw_id"), F.col("headers")["Site"].alias("site"), F.size("moves").alias("n_moves"), some("comments").alias("n_comments"), some("nags").alias("n_nags"), "result")


@query
def zst_json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Raw games as JSON lines compressed with zstd, read back as streams."""
    path = _folder(spark, "zst")
    raw = table(spark, d, "raw_games").select("raw_id", "site", "movetext")
    reports.write_zst(spread(raw).select(F.to_json(F.struct("raw_id", "site", "movetext")).alias("value")), path)
    back = compressed.read_zst_json(spark, path, "raw_id long, site string, movetext string")
    return back.select("raw_id", "site", F.md5("movetext").alias("text_md5"))


@query
def stream_stage1(spark: SparkSession, d: str) -> DataFrame:
    """Stage 1 as a stream over the same files; must give the rows of the batch."""
    raw = table(spark, d, "raw_games")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    raw.write.parquet(f"{base}/in")
    streaming.run_available(spark, f"{base}/in", raw, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").withColumn("cp", _text("cp"))


@query
def synthetic_games(spark: SparkSession, d: str) -> DataFrame:
    made = synthetic.games(spark, 500)
    return stage1.tokenised(made, 0, 0).select("raw_id", "n_plies", "n_disagreements")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def shard_order(spark: SparkSession, d: str) -> DataFrame:
    """Games in shards of at most 500 rows, compressed with zstd, read back by a pattern and numbered in the order of file and place in the file."""
    path = _folder(spark, "shards")
    games = table(spark, d, "games").select("row_id", "site")
    write_shards(games.repartitionByRange(4, "row_id").sortWithinPartitions("row_id"), path, 500)
    read = shards(spark, f"{path}/part-*.zstd.parquet").withColumn("one", F.lit(1))
    return ordered_offset(read, [], ["file_path", "row_index"], "one", "position").select("row_id", "position")


@query
def shard_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Shards never hold more rows than asked for, and together hold all."""
    path = _folder(spark, "shards")
    write_shards(table(spark, d, "games").select("row_id"), path, 500)
    per = shards(spark, path).groupBy("file_path").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 500).alias("bounded"))


@query
def evolving_shards(spark: SparkSession, d: str) -> DataFrame:
    """Old shards without result and termination beside new ones."""
    path = _folder(spark, "shards")
    games = table(spark, d, "games").select("row_id", "result", "termination", "n_plies")
    old = F.col("row_id") % 2 == 0
    write_shards(games.where(old).drop("result", "termination"), f"{path}/old")
    write_shards(games.where(~old), f"{path}/new")
    return shards(spark, f"{path}/old", f"{path}/new").select("row_id", "result", "termination", "n_plies")


@query
def month_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw games laid out by year and month; only the folders of the months asked for are read."""
    path = _folder(spark, "months")
    raw = table(spark, d, "raw_games").withColumn("ym", M.year_month(F.col("utcdate"))).where(F.col("ym").rlike("^[0-9]{4}-[0-9]{2}$"))
    raw.select("raw_id", "site", F.substring("ym", 1, 4).alias("year"), F.substring("ym", 6, 2).alias("month")).write.partitionBy("year", "month").parquet(path)
    there = {f"{r['year']}-{r['month']}" for r in months(spark, path).select("year", "month").distinct().collect()}  # one row a month
    wanted = tuple(m for m in MONTHS if m in there)
    return months(spark, path, wanted).select("raw_id", "site", "year", "month") if wanted else months(spark, path).where("false").select("raw_id", "site", "year", "month")


@query
def token_frequency_json(spark: SparkSession, d: str) -> DataFrame:
    """The token counts as a JSON object, written and read back in its order."""
    path = _folder(spark, "report") + "/vocab.json"
    reports.write_token_frequency(stage1.token_frequency(table(spark, d, "games")), path)
    found = spark.read.text(path).select(F.regexp_extract("value", r'^ "(.*)": (\d+),?$', 1).alias("token"), F.regexp_extract("value", r'^ "(.*)": (\d+),?$', 2).alias("n"))
    return found.where("n <> ''").select(F.regexp_replace("token", r'\\(["\\\\])', "$1").alias("token"), F.col("n").cast("long").alias("n"))


@query
def stage1_stats_json(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "report") + "/stats.json"
    reports.write_stage1_stats(spread(table(spark, d, "raw_games")), path)
    return spark.read.json(path, multiLine=True).drop("elapsed_sec")


@query
def pack_stats_json(spark: SparkSession, d: str) -> DataFrame:
    """The Stage-2 report with its settings, written and read back; the most frequent unknown tokens as text."""
    path = _folder(spark, "report") + "/pack_stats.json"
    reports.write_stage2_stats(table(spark, d, "games"), path, **FILTERS, fraction=VAL_SHARE)
    found = reports.read_json(spark, path)
    row = {k: v for k, v in found.items() if k not in ("elapsed_sec", "unknown_token_top", "shards")}
    row["unknown_token_top"] = " ".join(f"{t}:{n}" for t, n in found["unknown_token_top"].items())
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string' if isinstance(v, str) else 'long'}" for k, v in row.items()))


@query
def corpus_metadata(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of a corpus, written, read back and validated: its scalars and sizes."""
    path = _folder(spark, "corpus") + "/meta.json"
    reports.write_metadata(spark, path)
    meta = reports.read_metadata(spark, path)
    rows = [(k, v) for k, v in meta.items() if isinstance(v, int)] + [(f"n_{k}", len(meta[k])) for k in ("stoi", "itos", "elo_tokens")]
    return spark.createDataFrame(rows, "name string, value long")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
