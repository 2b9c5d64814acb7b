"""Stage 1: raw annotated games to tokenised games. One narrow stage; the only shuffle is the token count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plyforge.functions import movetext as M
from plyforge.functions.streams import tokens_of
from plyforge.operators import fast


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row: a later filter on them is not pushed below and evaluated twice."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def with_plies(raw: DataFrame) -> DataFrame:
    """Add ``plies``: ``array<struct<san, glyph, eval, cp>>``. Every array is computed once, as a lambda that names an expression computes it per element."""
    word, rest = M.words_and_rests(F.col("movetext"))
    rows = once(raw, _words=word, _rests=rest)
    rows = once(rows, _evals=F.transform("_rests", M.last_eval))

    def ply(word: Column, text: Column) -> Column:
        san, glyph = M.split_glyph(word)
        return F.struct(san.alias("san"), glyph.alias("glyph"), F.nullif(text, F.lit("")).alias("eval"), M.eval_to_cp(text).alias("cp"))

    return once(rows, plies=F.zip_with("_words", "_evals", ply)).drop("_words", "_rests", "_evals")


def with_labels(games: DataFrame) -> DataFrame:
    """Add ``labelled`` to games with ``plies``: number, SAN, evaluations, and the label as written (``inline``) and as ``computed``."""
    rows = once(games, _cps=F.transform("plies", lambda p: p["cp"]))
    rows = once(rows, _before=F.transform("_cps", lambda c, i: M.known_before(F.col("_cps"), i)))
    sign = lambda i: F.when(i % 2 == 0, 1).otherwise(-1)
    rows = once(rows, _loss=F.zip_with("_cps", "_before", lambda c, b: F.when(c.isNotNull(), M.win_pct(b) - M.win_pct(c))))
    rows = once(rows, _label=F.transform("_loss", lambda x, i: M.label_of_loss(x * sign(i))))

    def one(p: Column, i: Column) -> Column:
        inline, computed = F.when(p["glyph"].isin(*M.BAD_GLYPHS), p["glyph"]), F.get("_label", i)
        differs = p["cp"].isNotNull() & ~inline.eqNullSafe(computed)
        return F.struct(
            i.alias("ply"), p["san"].alias("san"), p["cp"].alias("cp"), F.get("_before", i).alias("cp_before"), (i % 2 == 0).alias("white"), inline.alias("inline"), computed.alias("computed"), differs.alias("disagrees")
        )

    return once(rows, labelled=F.transform("plies", one)).drop("_cps", "_before", "_loss", "_label")


def annotated(raw: DataFrame, min_elo: int = 1600) -> DataFrame:
    """Games with evaluations in their text and both ratings at least ``min_elo``; both tests reach the scan. Null ratings fail."""
    return raw.where(F.contains("movetext", F.lit("[%eval")) & (F.col("whiteelo") >= min_elo) & (F.col("blackelo") >= min_elo))


#: Speeds and terminations of the stricter selection.
SPEEDS, BROKEN_OFF = ("blitz", "rapid", "classical"), ("Abandoned", "Rules infraction")


def speed(time_control: Column) -> Column:
    """The speed class of a time control ``base+increment`` by the estimated seconds of a game of 40 moves; null if it is none."""
    base, step = (F.regexp_extract(time_control, r"^(\d+)\+(\d+)$", k).try_cast("int") for k in (1, 2))
    seconds = base + 40 * step
    return F.when(seconds < 30, "ultrabullet").when(seconds < 180, "bullet").when(seconds < 480, "blitz").when(seconds < 1500, "rapid").when(seconds.isNotNull(), "classical")


def strict_selection(raw: DataFrame, min_plies: int = 10, speeds: tuple[str, ...] = SPEEDS) -> DataFrame:
    """Games for a stricter corpus: evaluations in the text, both ratings known, a speed of ``speeds``, not broken off, ``min_plies`` or more, and an evaluation after every ply but perhaps the last."""
    early = raw.where(F.contains("movetext", F.lit("[%eval")) & F.col("whiteelo").isNotNull() & F.col("blackelo").isNotNull() & ~F.coalesce(F.col("termination").isin(*BROKEN_OFF), F.lit(False)) & speed(F.col("timecontrol")).isin(*speeds))
    games = with_plies(early)
    p = F.col("plies")
    whole = F.forall(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), lambda x: x["eval"].isNotNull())
    return games.where((F.size(p) >= min_plies) & whole)


def parsed(raw: DataFrame) -> DataFrame:
    """``plies``, ``has_evals`` and ``malformed`` (a word that is no SAN, or an evaluation that is no number)."""
    p = F.col("plies")
    games = with_plies(raw)
    bad = F.exists(p, lambda x: ~x["san"].rlike(M.SAN) | (x["eval"].isNotNull() & x["cp"].isNull()))
    return once(games, has_evals=F.exists(p, lambda x: x["eval"].isNotNull()), malformed=bad)


def _typed(df: DataFrame, made: str) -> str:
    """The columns of ``df`` and those made of them."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), made])


def tokenised(raw: DataFrame, min_elo: int = 1600, min_plies: int = 20, labels: str = "glyph", keep: tuple[str, ...] = ("raw_id",), quarantined: bool = False, engine: str = "arrow") -> DataFrame:
    """The tokenised games; with ``quarantined`` also the malformed ones, marked, without tokens.

    ``labels``: ``glyph`` (as written), ``computed`` (from the evaluations) or ``none``. ``engine``: ``arrow`` or ``native``, with equal
    results; filters and columns reach the scan in both.
    """
    headers = [
        F.coalesce("site", F.lit("")).alias("site"),
        F.coalesce(F.col("utcdate").cast("string"), F.lit("")).alias("utc_date"),
        F.col("whiteelo").cast("smallint").alias("white_elo"),
        F.col("blackelo").cast("smallint").alias("black_elo"),
        F.col("timecontrol").alias("time_control"),
        "result",
        "termination",
        "eco",
    ]
    if engine == "arrow":
        rows = annotated(raw, min_elo).select(*keep, *headers, "movetext")
        made = "n_plies smallint, tokens string, cp array<int>, n_disagreements smallint, malformed boolean"
        out = rows.mapInArrow(fast.tokeniser(labels), _typed(rows.drop("movetext"), made))
    else:
        games = parsed(annotated(raw, min_elo)).where("has_evals")
        label = {"glyph": lambda p: p["inline"], "computed": lambda p: p["computed"], "none": lambda p: F.lit(None).cast("string")}[labels]
        q = F.col("labelled")
        words = F.flatten(F.transform(q, lambda p: M.san_tokens(p["san"], label(p))))
        out = with_labels(games).select(
            *keep,
            *headers,
            F.size(q).cast("smallint").alias("n_plies"),
            F.when(~F.col("malformed"), F.array_join(words, " ")).alias("tokens"),
            F.transform(q, lambda p: F.coalesce(p["cp"], F.lit(M.NO_EVAL))).alias("cp"),
            F.size(F.filter(q, lambda p: p["disagrees"])).cast("smallint").alias("n_disagreements"),
            "malformed",
        )
    if quarantined:
        return out.where((F.col("n_plies") >= min_plies) | F.col("malformed"))
    return out.where((F.col("n_plies") >= min_plies) & ~F.col("malformed")).drop("malformed")


def ply_rows(raw: DataFrame, keep: tuple[str, ...] = ("raw_id",), engine: str = "arrow") -> DataFrame:
    """One row per ply of every game that has moves: its SAN, evaluations before and after, and both labels."""
    if engine == "arrow":
        rows = raw.select(*keep, "movetext")
        made = "ply int, san string, cp int, cp_before int, white boolean, inline string, computed string, disagrees boolean"
        return rows.mapInArrow(fast.plies, _typed(rows.drop("movetext"), made))
    return with_labels(with_plies(raw)).select(*keep, F.explode("labelled").alias("p")).select(*keep, "p.*")


def stats(raw: DataFrame, min_elo: int = 1600, min_plies: int = 20) -> DataFrame:
    """Counters over the retained games and the malformed ones, in one pass: counts per token first, then their sum and number."""
    games = tokenised(raw, min_elo, min_plies, quarantined=True)
    kept = ~F.col("malformed")
    # per game: one row per distinct token, the game's own counters on an extra row without a token
    words = F.concat(F.array(F.lit(None).cast("string")), F.when(kept, F.split("tokens", " ")).otherwise(F.array().cast("array<string>")))
    rows = games.select(F.posexplode(words).alias("i", "token"), kept.alias("kept"), "n_plies", "n_disagreements")
    head = F.col("i") == 0
    by_token = rows.groupBy("token").agg(
        F.count_if(~head).alias("n"),
        F.count_if(head & F.col("kept")).alias("games"),
        F.sum(F.when(head & F.col("kept"), F.col("n_plies"))).alias("plies"),
        F.count_if(head & ~F.col("kept")).alias("parse_errors"),
        F.sum(F.when(head & F.col("kept"), F.col("n_disagreements"))).alias("disagreement_plies"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return by_token.agg(total("games"), total("plies"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("token").alias("distinct_tokens"), total("parse_errors"), total("disagreement_plies"))


def token_frequency(games: DataFrame) -> DataFrame:
    """Occurrences of each stream token; partial counts are made before the shuffle."""
    return games.select(F.explode(tokens_of(F.col("tokens"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
