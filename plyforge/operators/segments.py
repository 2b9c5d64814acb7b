"""Segments and loss-masked training rows of encoded games, as array expressions: no shuffle, every segment of a game at once.

A label token annotates the move it precedes. Each annotated move closes a segment that starts after the one before; the rest
is the tail. A training row keeps its own segment's label and no other, and is graded on its segment and on the game's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.operators import vocab as V
from plyforge.operators.stage1 import once

#: Tokens after a label within which its move must end.
SPAN = 4
_ID = V.ids()
LABELS = tuple(_ID[t] for t in V.LABEL_WORDS.values())
MODIFIER_IDS = (V.CORE_COUNT, V.CORE_COUNT + len(V.MODIFIERS))
UNGRADED = (_ID[V.BOS], _ID[V.ELO_ANY], *(_ID[t] for t in V.ELO_BUCKETS))
END_IDS = (_ID[V.EOS], *(_ID[t] for t in V.ENDINGS))


def whole_game(ids: Column) -> Column:
    """Whether the ids are one whole game: its start token once, in front, and the end token last."""
    return (F.size(ids) >= 2) & (ids[0] == _ID[V.BOS]) & (F.element_at(ids, -1) == _ID[V.EOS]) & (F.size(F.filter(ids, lambda t: t == _ID[V.BOS])) == 1)


def guarded(ids: Column) -> Column:
    """The ids, or an error at run time if they are not one whole game."""
    return F.when(whole_game(ids), ids).otherwise(F.raise_error(F.lit("not exactly one whole game: stale or corrupt index?")))


def _move_end(ids: Column, at: Column) -> Column:
    """Position of the move that the label at ``at`` annotates: the first token after it that is no modifier, if it is a move within ``SPAN`` tokens."""
    end = F.lit(None).cast("int")
    for k in range(SPAN, 0, -1):
        t = F.get(ids, at + k)
        modifier = (t >= MODIFIER_IDS[0]) & (t < MODIFIER_IDS[1])
        end = F.when(t < V.CORE_COUNT, at + k).when(modifier, end)
    return end


def with_segments(games: DataFrame) -> DataFrame:
    """Add ``segs`` to rows with ``ids``: ``array<struct<lo, hi, label_at>>``, target ranges with both ends; ``label_at`` is null for the tail.

    A label without its move ends the grading before it.
    """
    ids, n = F.col("ids"), F.size("ids")
    g = once(games, _marks=F.filter(F.transform("ids", lambda t, i: F.when(t.isin(*LABELS), i)), lambda i: i.isNotNull()))
    g = once(g, _groups=F.transform("_marks", lambda p: F.struct(p.alias("p"), _move_end(ids, p).alias("g"))))
    g = once(g, _stop=F.coalesce(F.get(F.filter("_groups", lambda s: s["g"].isNull()), F.lit(0))["p"], n))
    g = once(g, _good=F.filter("_groups", lambda s: s["p"] < F.col("_stop")))
    start = lambda i: F.when(i > 0, F.get("_good", i - 1)["g"] + 1).otherwise(0)
    body = F.transform("_good", lambda s, i: F.struct(start(i).alias("lo"), s["g"].alias("hi"), s["p"].alias("label_at")))
    low = F.coalesce(F.try_element_at("_good", F.lit(-1))["g"] + 1, F.lit(0))
    tail = F.struct(low.alias("lo"), (F.col("_stop") - 1).alias("hi"), F.lit(None).cast("int").alias("label_at"))
    segs = F.concat(body, F.when(low < F.col("_stop"), F.array(tail)).otherwise(F.array().cast("array<struct<lo:int,hi:int,label_at:int>>")))
    return once(g, segs=segs).drop("_marks", "_groups", "_stop", "_good")


def segment_rows(games: DataFrame, key: str = "row_id", epoch: int | None = None) -> DataFrame:
    """``key, seg, lo, hi, label_at, ids`` for every segment of every game; with ``epoch`` for one per game, drawn by a hash of both."""
    g = with_segments(once(games.where("ids IS NOT NULL").select(key, F.col("ids").alias("_ids")), ids=guarded(F.col("_ids"))).drop("_ids"))
    if epoch is None:
        return g.select(key, "ids", F.posexplode("segs").alias("seg", "s")).select(key, "seg", "s.lo", "s.hi", "s.label_at", "ids")
    seg = F.pmod(F.xxhash64(F.lit(epoch), F.col(key)), F.size("segs")).cast("int")
    g = once(g.where(F.size("segs") > 0), seg=seg)
    return g.withColumn("s", F.get("segs", F.col("seg"))).select(key, "seg", "s.lo", "s.hi", "s.label_at", "ids")


def training_rows(games: DataFrame, key: str = "row_id", epoch: int | None = None) -> DataFrame:
    """``key, seg, x, y``: inputs and targets of every segment, or with ``epoch`` of one segment per game; -1 is no target.

    Graded is a target of the segment or of the game's end that followed its left neighbour in the game and is no framing token.
    """
    rows = segment_rows(games, key, epoch)
    own = F.coalesce("label_at", F.lit(-1))
    # a kept token carries its place in the game
    kept = F.filter(F.transform("ids", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda k: ~k["t"].isin(*LABELS) | (k["i"] == own))
    rows = once(rows, _kept=kept)

    def target(k: Column, j: Column) -> Column:
        t, i = k["t"], k["i"]
        graded = (i.between(F.col("lo"), F.col("hi")) | t.isin(*END_IDS)) & (F.get("_kept", j - 1)["i"] == i - 1) & ~t.isin(*UNGRADED)
        return F.when(graded, t).otherwise(-1)

    rows = once(rows, _y=F.transform("_kept", target), _x=F.transform("_kept", lambda k: k["t"]))
    return rows.select(key, "seg", F.slice("_x", F.lit(1), F.size("_x") - 1).alias("x"), F.slice("_y", F.lit(2), F.size("_y") - 1).alias("y"))


def move_groups(rows: DataFrame, column: str = "words") -> DataFrame:
    """Add ``groups``: a stream of bare tokens cut after every move, ``array<array<string>>``; tokens after the last move are left out."""
    open_ = (*V.MODIFIERS, *V.LABEL_WORDS.values())
    g = once(rows, _ends=F.filter(F.transform(column, lambda t, i: F.when(~t.isin(*open_), i + 1)), lambda i: i.isNotNull()))
    before = lambda i: F.when(i > 0, F.get("_ends", i - 1)).otherwise(0)
    return once(g, groups=F.transform("_ends", lambda c, i: F.slice(column, before(i) + 1, c - before(i)))).drop("_ends")
