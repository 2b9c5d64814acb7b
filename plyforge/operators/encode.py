"""Stage 2: tokenised games to framed id sequences, splits, offsets and reports."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plyforge.functions import movetext as M
from plyforge.functions.movetext import year_month
from plyforge.functions.streams import split_tokens
from plyforge.operators import vocab as V
from plyforge.operators.ranking import ordered_offset
from plyforge.operators.stage1 import once

COLUMNS = ("row_id", "site", "utc_date", "white_elo", "black_elo", "result", "termination", "n_plies", "tokens")


def shard_columns(games: DataFrame) -> DataFrame:
    """The columns Stage 2 reads; those an older shard lacks become null."""
    kinds = {"result": "string", "termination": "string"}
    return games.select(*(F.col(c) if c in games.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def filtered(games: DataFrame, min_elo: int = 0, max_elo: int = 0, min_plies: int = 0) -> DataFrame:
    """Rating bounds on the lower and the higher player, and a least length; 0 turns a filter off. Null ratings and lengths are 0."""
    w, b = (F.coalesce(F.col(c), F.lit(0)) for c in ("white_elo", "black_elo"))
    if min_elo:
        games = games.where(F.least(w, b) >= min_elo)
    if max_elo:
        games = games.where(F.greatest(w, b) <= max_elo)
    if min_plies:
        games = games.where(F.coalesce("n_plies", F.lit(0)) >= min_plies)
    return games


def _slot(elo: str, side: str, dropout: float, seed: int) -> Column:
    """Bucket token of a player, or the neutral one with probability ``dropout``, decided by a hash of the row, the side and the seed."""
    bucket = V.elo_bucket(F.coalesce(F.col(elo), F.lit(0)))
    if not dropout:
        return bucket
    return F.when(hash_fraction(F.concat_ws("|", F.lit(seed), F.lit(side), F.col("row_id"))) < dropout, V.ELO_ANY).otherwise(bucket)


def hash_fraction(text: Column) -> Column:
    """A number in [0, 1) with four digits from the md5 of a text."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(10_000)) / 10_000


def split_of(site: Column, date: Column, fraction: float = 0.05, months: tuple[str, ...] = ()) -> Column:
    """``val`` or ``train``: by month if months are given, else by a hash of the site."""
    if months:
        chosen = year_month(date).isin(*months)
    else:
        chosen = hash_fraction(F.coalesce(site, F.lit(""))) < fraction
    return F.when(chosen, "val").otherwise("train")


class _Numbers(dict):
    """Stream token -> its id, -1 outside the dictionary; emptied when it grows past a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        bare = token[1:-1] if len(token) >= 2 and token[0] == "[" and token[-1] == "]" else token
        found = self[token] = V.ids().get(V.LABEL_WORDS.get(bare, bare), -1)
        return found


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add to ``…, tokens`` the ids of the moves (null for a token outside the dictionary), those tokens, and whether there is a mate; ``tokens`` goes."""
    known, mate = _Numbers(), V.ids()["#"]
    for batch in batches:
        streams = [split_tokens(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        size = np.fromiter(map(len, streams), np.int64, len(streams))
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(streams)), np.int32, int(size.sum()))
        row = np.repeat(np.arange(len(streams)), size)
        outside = np.bincount(row[ids < 0], minlength=len(streams))
        unknown = [sorted({t for t in s if known[t] < 0}) if n else [] for s, n in zip(streams, outside)]
        offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
        made = [pa.ListArray.from_arrays(offsets, pa.array(ids, mask=ids < 0)), pa.array(unknown, pa.list_(pa.string())), pa.array(np.bincount(row[ids == mate], minlength=len(streams)) > 0)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "move_ids", "unknown", "mate"])


def encoded(games: DataFrame, dropout: float = 0.0, seed: int = 1234, fraction: float = 0.05, months: tuple[str, ...] = ()) -> DataFrame:
    """Every game with its dictionary words, the tokens outside the dictionary (``unknown``), its ids (null if any is outside), end token and split."""
    rows = shard_columns(games).select("row_id", "site", "utc_date", "white_elo", "black_elo", "result", "termination", "tokens")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "tokens")
    g = rows.mapInArrow(_numbered, f"{kinds}, move_ids array<int>, unknown array<string>, mate boolean")
    end = V.end_token(F.col("result"), F.col("termination"), F.col("mate"))
    g = once(g, end_token=end, white_token=_slot("white_elo", "w", dropout, seed), black_token=_slot("black_elo", "b", dropout, seed))
    number = V.ids()
    of = lambda c, words: F.element_at(F.create_map(*(F.lit(x) for w in words for x in (w, number[w]))), F.col(c))
    ratings = (*V.ELO_BUCKETS, V.ELO_ANY)
    tail = F.when(F.col("end_token").isNotNull(), F.array(of("end_token", V.ENDINGS), F.lit(number[V.EOS]))).otherwise(F.array(F.lit(number[V.EOS])))
    ids = F.concat(F.array(F.lit(number[V.BOS]), of("white_token", ratings), of("black_token", ratings)), F.col("move_ids"), tail)
    return g.select(
        "row_id", "site", "utc_date", "white_token", "black_token", "end_token", "unknown", split_of(F.col("site"), F.col("utc_date"), fraction, months).alias("split"), F.when(F.size("unknown") == 0, ids).alias("ids")
    )


def packed(games: DataFrame, **options) -> DataFrame:
    """``split, row_id, length, start, ids``: games in order of ``row_id`` and where each starts in its split's stream."""
    rows = encoded(games, **options).where("ids IS NOT NULL").select("split", "row_id", F.size("ids").alias("length"), "ids")
    return ordered_offset(rows, ["split"], ["row_id"], "length", "start")


def offsets(corpus: DataFrame) -> DataFrame:
    """``split, start``: the start of every game, and the total length of the split as the last one."""
    total = corpus.groupBy("split").agg(F.sum("length").alias("start"))
    return corpus.select("split", "start").unionByName(total)


def valid_offsets(index: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per split: whether the index starts at 0, ends at the total and has no start twice."""
    total = corpus.groupBy("split").agg(F.sum("length").alias("total"))
    found = index.groupBy("split").agg(F.min("start").alias("low"), F.max("start").alias("high"), F.count("*").alias("n"), F.count_distinct("start").alias("n_distinct"))
    return found.join(total, "split").select("split", ((F.col("low") == 0) & (F.col("high") == F.col("total")) & (F.col("n") == F.col("n_distinct")) & (F.col("n") >= 2)).alias("valid"))


def starts_by_scan(corpus: DataFrame) -> DataFrame:
    """The fallback index: positions of the start token in the stream, and the total."""
    at = corpus.select("split", "start", F.posexplode("ids").alias("i", "id")).where(F.col("id") == V.ids()[V.BOS])
    return at.select("split", (F.col("start") + F.col("i")).alias("start")).unionByName(corpus.groupBy("split").agg(F.sum("length").alias("start")))


def stats(games: DataFrame, min_elo: int = 0, max_elo: int = 0, min_plies: int = 0, **options) -> DataFrame:
    """The Stage-2 report in one row."""
    seen = games.count()  # from the footers
    e = once(encoded(filtered(games, min_elo, max_elo, min_plies), **options), n=F.size("ids")).select("split", "end_token", "n")
    n = F.col("n")
    ok = n.isNotNull()
    ended = lambda *names: F.count_if(ok & F.col("end_token").isin(*names))
    of = lambda s, x: F.coalesce(F.sum(F.when(ok & (F.col("split") == s), x)), F.lit(0)).cast("long")
    r = e.agg(
        F.count("*").alias("games_kept"),
        F.count_if(ok).alias("games_packed"),
        F.count_if(~ok).alias("games_unknown_token"),
        of("train", F.lit(1)).alias("train_games"),
        of("val", F.lit(1)).alias("val_games"),
        of("train", n).alias("train_tokens"),
        of("val", n).alias("val_tokens"),
        ended(*V.ENDINGS[:2]).alias("games_end_resign"),
        ended(*V.ENDINGS[2:4]).alias("games_end_flag"),
        ended(V.ENDINGS[4]).alias("games_end_draw"),
        F.count_if(ok & F.col("end_token").isNull()).alias("games_end_bare"),
        F.coalesce(F.max(F.when(ok, n)), F.lit(0)).alias("max_game_tokens"),
        F.count_if(ok & (n > 513)).alias("games_over_513"),
        F.count_if(ok & (n > 1025)).alias("games_over_1025"),
    )
    per_game = (F.col("train_tokens") + F.col("val_tokens")) / F.greatest(F.lit(1), F.col("games_packed"))
    return r.withColumns({"games_seen": F.lit(seen), "games_filtered": F.lit(seen) - F.col("games_kept"), "tokens_per_game": F.bround(per_game, 1)}).drop("games_kept")


def unknown_tokens(games: DataFrame, top: int | None = None) -> DataFrame:
    """How many games each token outside the dictionary spoils; the ``top`` most frequent, ties by name."""
    rows = encoded(games).select(F.explode("unknown").alias("token")).groupBy("token").agg(F.count("*").alias("n_games"))
    return rows.orderBy(F.desc("n_games"), "token").limit(top) if top else rows


def decoded(corpus: DataFrame) -> DataFrame:
    return corpus.select("row_id", V.reverse_lookup("ids").alias("words"))


def inspected(corpus: DataFrame, games: int = 3, words: int = 40) -> DataFrame:
    """A look at a corpus: the first games of each split, their first words. (A top-k per split: ranks are cut off within the sort.)"""
    rank = F.row_number().over(W.partitionBy("split").orderBy("row_id"))
    first = corpus.select("split", "row_id", "ids").withColumn("rank", rank).where(F.col("rank") <= games)
    return first.select("split", "row_id", F.size("ids").alias("length"), F.array_join(F.slice(V.reverse_lookup("ids"), 1, words), " ").alias("words"))


def vocabulary_check(sans: DataFrame, column: str = "san") -> DataFrame:
    """Counts over moves: all, those that are no SAN (``broken``), those with a token outside the dictionary (``missing``), and those that do not come back from their tokens."""
    s = once(sans.select(F.col(column).alias("san")), words=M.san_tokens(F.col("san"), F.lit(None).cast("string"), bracketed=False))
    s = s.withColumn("numbers", V.lookup("words"))
    known = F.forall("numbers", lambda i: i.isNotNull())
    return s.agg(
        F.count("*").alias("checked"), F.count_if(F.col("words").isNull()).alias("broken"), F.count_if(~known).alias("missing"), F.count_if(M.tokens_to_san(F.col("words")) != F.col("san")).alias("lossy")
    )
