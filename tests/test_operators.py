"""Golden values and properties of the reference operators."""

import random

import pytest
from pyspark.sql import functions as F

from plyforge.functions import fen as P
from plyforge.functions import movetext as M
from plyforge.operators import buckets, decode, drift, encode, fast, rules, segments, shaping, stage1
from plyforge.operators import vocab as V
from plyforge.operators.ranking import ordered_offset, running_offset
from plyforge.sources import binary, pgn


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_split_glyph(spark):
    words = ["e4", "e4?", "e4??", "e4?!", "e4!?", "e4!!", "e4!", "e4???", "e4??!", "e4?!?", "e4+??"]
    got = column(spark, words, lambda v: F.struct(*M.split_glyph(v)))
    assert [tuple(x) for x in got] == [("e4", None), ("e4", "?"), ("e4", "??"), ("e4", "?!"), ("e4!", "?"), ("e4", "!!"), ("e4", "!"), ("e4?", "??"), ("e4?", "?!"), ("e4?!", "?"), ("e4+", "??")]
    w = fast._Words()
    assert [(w[x][0], w[x][2]) for x in words] == [tuple(x) for x in got]


def test_eval_and_label(spark):
    assert column(spark, ["0.17", "#4", "#-3", "0.125", "-0.125", "x"], M.eval_to_cp)[:5] == [17, 29996, -29997, 12, -12]
    df = spark.createDataFrame([(13, 594, False), (50, -29997, True), (0, 0, True)], "a int, b int, w boolean")
    assert [r[0] for r in df.select(M.classify(F.col("a"), F.col("b"), F.col("w"))).collect()] == ["??", "??", None]


def test_san_tokens(spark):
    rows = [("exf8=Q+", "??"), ("Nc6", None), ("Qa1xb2", None), ("e8=N", None), ("O-O-O+", "?"), ("e4!", None), ("e2e4", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, l string").orderBy("i")
    got = [r[0] for r in df.select(F.array_join(M.san_tokens(F.col("s"), F.col("l")), " ")).collect()]
    assert got == ["[??] [+] [x] [=Q] [ef8]", "[Nc6]", "[x] [Qa1b2]", "[=N] [e8]", "[?] [+] [O-O-O]", None, None]


TEXTS = [
    "1. e4 { [%eval 0.17] [%clk 0:03:00] } e5 { [%eval 5.94] } 2. Nf3 $2 {x} {[%eval -0.3]} Nc6?? { [%eval #-3] [%eval 1.0] } 1-0",
    "1. e4 {[%eval 0.2]} (1. d4 d5) e5 1-0",
    "{ [%eval 9.0] } 1. e4! e5!? { [%eval 0.1] } *",
    "1.e4{[%eval 0.1]}e5 2.Nf3} { Nc6 0-1 {[%eval 0.4]}",
    "1. d4 d5 1/2-1/2",
    "1. e4 { [%eval #3.5] } e5",
    "",
    None,
    "Qh5# {[%eval #1]} 1-0 1-0 {[%eval 0.7]}",
]


def raw(spark, texts=TEXTS):
    rows = [(i, f"s{i}", "2024.01.02", 2000, 2000, "180+0", "1-0", "Normal", "A00", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "raw_id long, site string, utcdate string, whiteelo int, blackelo int, timecontrol string, result string, termination string, eco string, movetext string")


@pytest.mark.parametrize("labels", ["glyph", "computed", "none"])
def test_engines_agree(spark, labels):
    games = raw(spark)
    a, b = (stage1.tokenised(games, 0, 0, labels, quarantined=True, engine=e).orderBy("raw_id").collect() for e in ("arrow", "native"))
    assert a == b and len(a) >= 5
    a, b = (stage1.ply_rows(games, engine=e).orderBy("raw_id", "ply").collect() for e in ("arrow", "native"))
    assert a == b


def test_stage1_drops(spark):
    assert stage1.tokenised(raw(spark, [None, "", "1. d4"]), 0, 0).count() == 0
    assert stage1.tokenised(raw(spark, [])).count() == 0
    kept = stage1.tokenised(raw(spark), 0, 0).select("raw_id").collect()
    assert {r[0] for r in kept} == {0, 3, 8}  # a variation, a `!?` and a fractional mate each quarantine their game


def test_vocabulary(spark):
    t = V.tokens()
    assert len(t) == 5273 == len(set(t)) and t[5252] == "<bos>" and t[-6] == "<elo-any>" and t[5268:] == V.ENDINGS and t[:5242][-1] == "O-O-O"
    assert column(spark, [0, 799, None, 800, 999, 1000, 1899, 2999, 3000, 4000], V.elo_bucket, "int") == [
        "<elo-u800>", "<elo-u800>", "<elo-u800>", "<elo-800>", "<elo-800>", "<elo-1000>", "<elo-1800>", "<elo-2800>", "<elo-3000p>", "<elo-3000p>"]
    assert column(spark, ["[Nf3]", "[x]", "[=Q]", "[ef8]", "[??]", "[?]", "[?!]", "e4", "[", ""], V.surface) == ["Nf3", "x", "=Q", "ef8", "<blunder>", "<mistake>", "<inaccuracy>", "e4", "[", ""]


def games(spark, rows):
    return spark.createDataFrame([(i, "s", "2024.01.02", 1500, None, r[1], r[2], 40, r[0]) for i, r in enumerate(rows)], "row_id long, site string, utc_date string, white_elo int, black_elo int, result string, termination string, n_plies int, tokens string")


@pytest.mark.parametrize(
    "stream, result, termination, end",
    [
        ("e4 e5", "1/2-1/2", "Normal", "<draw>"), ("e4", "1-0", "Normal", "<black-resign>"), ("e4 e5", "0-1", "Normal", "<white-resign>"), ("e4 e5 # Qh5", "1-0", "Normal", None), ("e4", "1-0", "Time forfeit", "<black-flag>"),
        ("e4 e5", "0-1", "Time forfeit", "<white-flag>"), ("e4 e5", "1/2-1/2", "Time forfeit", None), ("e4", "1-0", "Abandoned", None), ("e4 e5", None, None, None), (None, "1-0", None, None), ("[Nf3] [Zz9] [e4]", "*", "Normal", None),
    ],
)
def test_end_tokens(spark, stream, result, termination, end):
    r = encode.encoded(games(spark, [(stream, result, termination)])).first()
    assert r["end_token"] == end
    if stream and "Zz9" in stream:
        assert r["ids"] is None and r["unknown"] == ["Zz9"]
    else:
        words = [V.tokens()[i] for i in r["ids"]]
        assert words[:3] == ["<bos>", "<elo-1400>", "<elo-u800>"] and words[-1] == "<eos>" and (end is None or words[-2] == end)


def test_stage2_without_result_columns(spark):
    g = games(spark, [("e4", "1-0", "Normal")]).drop("result", "termination")
    assert encode.encoded(g).first()["end_token"] is None


SEGMENTS = [
    ("B W K e4 ? c5 Nf3 ?? Ng3 E", [(0, 5, 4), (6, 8, 7), (9, 9, None)], ["B W K e4 ? c5 Nf3 Ng3", "B W K e4 c5 Nf3 ?? Ng3", "B W K e4 c5 Nf3 Ng3"], ["- - e4 ? c5 - - E", "- - - - Nf3 ?? Ng3 E", "- - - - - - E"]),
    ("B W K e4 ?? x Nf3 E", [(0, 6, 4), (7, 7, None)], ["B W K e4 ?? x Nf3", "B W K e4 x Nf3"], ["- - e4 ?? x Nf3 E", "- - - - - E"]),
    ("B W K e4 ? c5 R E", [(0, 5, 4), (6, 7, None)], ["B W K e4 ? c5 R", "B W K e4 c5 R"], ["- - e4 ? c5 R E", "- - - - R E"]),
    ("B W K e4 D E", [(0, 5, None)], ["B W K e4 D"], ["- - e4 D E"]),
]
NAMES = {"B": "<bos>", "E": "<eos>", "W": "<elo-1400>", "K": "<elo-1600>", "?": "<mistake>", "??": "<blunder>", "R": "<white-resign>", "D": "<draw>"}


def ids(text):
    return [-1 if t == "-" else V.ids()[NAMES.get(t, t)] for t in text.split()]


@pytest.mark.parametrize("game, plan, x, y", SEGMENTS)
def test_segments(spark, game, plan, x, y):
    df = spark.createDataFrame([(1, ids(game))], "row_id long, ids array<int>")
    assert [(r.lo, r.hi, r.label_at) for r in segments.segment_rows(df).orderBy("seg").collect()] == plan
    rows = segments.training_rows(df).orderBy("seg").collect()
    assert [r.x for r in rows] == [ids(t) for t in x] and [r.y for r in rows] == [ids(t) for t in y]


def test_label_without_move_ends_grading(spark):
    df = spark.createDataFrame([(1, [*ids("B W K e4 ??"), V.ids()["<eos>"]])], "row_id long, ids array<int>")
    assert [(r.lo, r.hi, r.label_at) for r in segments.segment_rows(df).collect()] == [(0, 3, None)]


@pytest.mark.parametrize("bad", ["W K e4 E", "B W e4", "B e4 E B e4 E", "B"])
def test_guard(spark, bad):
    with pytest.raises(Exception, match="whole game"):
        segments.segment_rows(spark.createDataFrame([(1, ids(bad))], "row_id long, ids array<int>")).collect()


def test_buckets(spark):
    assert buckets.caps(512) == (64, 128, 256, 384, 512)
    assert column(spark, [64, 128, 256, 384, 512, 768, 1024], lambda v: buckets.rows_for_cap(v, 1024, 64), "int") == [512, 512, 256, 171, 128, 85, 64]
    assert column(spark, [64, 512], lambda v: buckets.rows_for_cap(v, 512, 32), "int") == [256, 32]
    lengths = spark.createDataFrame([("t", 65), ("t", 66), ("t", 254), ("t", 604)], "split string, length int")
    got = {r.cap: r.probability for r in buckets.bucket_table(lengths, 512, 32).collect()}
    assert got == {64: round(65 / 385, 9), 128: round(66 / 385, 9), 256: round(254 / 385, 9), None: None}


def test_padding(spark):
    df = spark.createDataFrame([(1, 0, ids("B e4"), ids("- e4"))], "row_id long, seg int, x array<int>, y array<int>")
    r = buckets.padded(df, 64).first()
    assert len(r.x) == len(r.y) == 64 and r.x[2:] == [V.ids()["<eos>"]] * 62 and r.y[:2] == ids("- e4") and set(r.y[2:]) == {-1}


def test_batches_repeat_and_fit(spark):
    rows = spark.createDataFrame([(i, 0, [1] * (5 + i % 90), [1] * (5 + i % 90)) for i in range(50)], "row_id long, seg int, x array<int>, y array<int>")
    a, b = (sorted(map(tuple, buckets.batches(rows, 3, 128, 2, seed=4).select("step", "slot", "row_id", "cap").collect())) for _ in range(2))
    assert a == b and {s for s, *_ in a} == {0, 1, 2}
    for step in range(3):
        part = [r for r in a if r[0] == step]
        assert len({r[3] for r in part}) == 1 and len(part) == min(16, round(256 / part[0][3]))


def test_segment_choice_is_uniform(spark):
    number = V.ids()
    game = [number[t] for t in (V.BOS, "<elo-1400>", "<elo-1400>", "e4", "<blunder>", "e5", "<mistake>", "Nf3", "Nc6", V.EOS)]  # three segments
    rows = spark.range(3000).select(F.col("id").alias("row_id"), F.array(*map(F.lit, game)).alias("ids"))
    n = {r.seg: r["count"] for r in segments.segment_rows(rows, epoch=0).groupBy("seg").count().collect()}
    assert sum(n.values()) == 3000 and len(n) == 3 and all(0.28 < c / 3000 < 0.39 for c in n.values())
    all_rows = {(r.row_id, r.seg): (r.x, r.y) for r in segments.training_rows(rows.where("row_id < 20")).collect()}
    one = segments.training_rows(rows.where("row_id < 20"), epoch=5).collect()
    assert len(one) == 20 and all(all_rows[r.row_id, r.seg] == (r.x, r.y) for r in one)


def dist(spark, p):
    return spark.createDataFrame([(1, i, t, float(x)) for i, (t, x) in enumerate(p)], "decode_id int, idx int, token string, p double")


def shaped(df):
    return {r.token: round(r.p, 6) for r in df.collect()}


def test_shaping(spark):
    d = dist(spark, [("a", 0.5), ("b", 0.3), ("c", 0.15), ("<mistake>", 0.05)])
    assert shaped(shaping.top_p(d, 0.7)) == {"a": 0.625, "b": 0.375, "c": 0.0, "<mistake>": 0.0}
    assert shaped(shaping.top_p(d, 0.5, ("<mistake>",))) == {"a": 0.909091, "b": 0.0, "c": 0.0, "<mistake>": 0.090909}
    assert shaped(shaping.min_p(d, 0.9)) == {"a": 1.0, "b": 0.0, "c": 0.0, "<mistake>": 0.0}
    assert shaped(shaping.min_p(d, 0.2)) == {"a": 0.625, "b": 0.375, "c": 0.0, "<mistake>": 0.0}
    assert shaped(shaping.tempered(dist(spark, [("a", 0), ("b", 0), ("<draw>", 0)]), F.lit(1.0))) == {"a": 0.5, "b": 0.5, "<draw>": 0.0}
    assert shaped(shaping.tempered(dist(spark, [("a", 0.8), ("b", 0.2)]), F.lit(0.5))) == {"a": 0.941176, "b": 0.058824}
    assert [shaping.sampled(d, F.lit(u)).first().token for u in (0.1, 0.5, 0.6, 0.99999, 1.5)] == ["a", "a", "b", "<mistake>", "<mistake>"]
    three = spark.createDataFrame([(1, 0, "a", 0.5), (1, 1, "b", 0.3), (1, 2, "c", 0.2)], "decode_id int, idx int, token string, p double")
    assert {r.token: round(r.p, 6) for r in shaping.top_p(three, 0.7).collect()} == {"a": 0.625, "b": 0.375, "c": 0.0}
    dense = spark.createDataFrame([(1, [0.1, 0.6])], "decode_id int, dense array<double>")
    allowed = spark.createDataFrame([(1, 0, "x", 1), (1, 1, "y", 5)], "decode_id int, idx int, token string, token_id int")
    assert {r.token: r.p for r in shaping.from_dense(dense, allowed).collect()} == {"x": 0.6, "y": 0.0}


def nodes(b, depth):
    return 1 if depth == 0 else sum(nodes(b.after(m), depth - 1) for m in b.legal())


@pytest.mark.parametrize(
    "fen, counts",
    [
        (rules.START, (20, 400, 8902)), ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", (48, 2039)), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", (14, 191, 2812)),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", (6, 264)), ("rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", (44, 1486)),
    ],
)
def test_node_counts(fen, counts):
    assert tuple(nodes(rules.Board(fen), d + 1) for d in range(len(counts))) == counts


def test_perft_merges_positions(spark):
    got = {r.depth: r.nodes for r in rules.perft(spark.createDataFrame([(rules.START,)], "fen string"), 3).collect()}
    assert got == {1: 20, 2: 400, 3: 8902}


def test_random_games_are_in_the_dictionary():
    pick = random.Random(5)
    for _ in range(15):
        b = rules.Board()
        for _ in range(60):
            legal = b.legal()
            if not legal:
                break
            m = pick.choice(legal)
            san = b.san(m, legal)
            assert all(t in V.ids() for t in bare_tokens(san)) and b.read(san, strict=True) == m and rules.Board(b.fen()).fen() == b.fen()
            b = b.after(m)


def test_board_reads_loose_moves():
    b = rules.Board()
    e4 = b.read("e4")
    assert all(b.read(t) == e4 for t in ("e2e4", "Pe2-e4", "e4!?")) and b.read("e2e4", strict=True) is None and b.read("Ke2") is None
    ep = rules.Board("rnbqkbnr/ppp1p1pp/8/3pPp2/8/8/PPPP1PPP/RNBQKBNR w KQkq f6 0 3")
    assert "exf6" in {ep.san(m) for m in ep.legal()} and ep.fen().split()[3] == "f6"
    assert rules.Board("7k/8/8/8/8/8/8/K6b w - - 0 1").status()["insufficient_material"]
    assert rules.Board("R5k1/5ppp/8/8/8/8/8/6K1 b - - 0 1").status()["checkmate"]


def bare_tokens(san):
    base, _, promotion = san.rstrip("+#").partition("=")
    return [*san[len(san.rstrip("+#")):], *(["x"] if "x" in base else []), *(["=" + promotion] if promotion else []), base.replace("x", "")]


def test_fen(spark):
    bad = {"fields": "8/8 w - - 0", "move number": "4k3/8/8/8/8/8/8/4K3 w - - 0 0", "half moves": "4k3/8/8/8/8/8/8/4K3 w - - -1 1", "en passant": "4k3/8/8/8/8/8/8/4K3 w - e4 0 1", "castling": "4k3/8/8/8/8/8/8/4K3 w KX - 0 1",
           "side": "4k3/8/8/8/8/8/8/4K3 x - - 0 1", "rows": "4k3/8/8/8/8/8/4K3 w - - 0 1", "digits": "4k3/44/8/8/8/8/8/4K3 w - - 0 1", "piece": "4k3/7x/8/8/8/8/8/4K3 w - - 0 1", "row length": "4k3/7/8/8/8/8/8/4K3 w - - 0 1",
           "en passant side": "4k3/8/8/8/8/8/8/4K3 w - e3 0 1", "white king": "4k3/8/8/8/8/8/8/8 w - - 0 1", "black king": "8/8/8/8/8/8/8/4K3 w - - 0 1", "pawns": "4k2P/8/8/8/8/8/8/4K3 w - - 0 1"}
    assert column(spark, list(bad.values()), P.fen_error) == list(bad)
    assert column(spark, [rules.START, None], P.fen_error) == [None, "fields"]
    assert column(spark, ["4k3/8/8/8/8/8/8/B3K2b w - - 0 1", "4kb2/8/8/8/8/8/8/2B1K3 w - - 0 1"], P.insufficient_material) == [rules.Board(f).dead() for f in ("4k3/8/8/8/8/8/8/B3K2b w - - 0 1", "4kb2/8/8/8/8/8/8/2B1K3 w - - 0 1")]


def decoded(spark, fens, model=decode.heuristic_model, **config):
    rows = spark.createDataFrame(list(enumerate(fens)), "id int, fen string")
    return {r.id: r for r in decode.decode_moves(rows, model, decode.Config(**config)).collect()}


def test_decode_mates_and_resigns(spark):
    mate, none, queen = "6k1/5ppp/8/8/8/8/8/R5K1 w - - 0 1", "R5k1/5ppp/8/8/8/8/8/6K1 b - - 0 1", "3q3k/8/8/8/8/8/7P/3Q3K w - - 0 1"
    out = decoded(spark, [mate, none, rules.START, "no position", mate])
    assert out[0].san == out[4].san == "Ra8#" and out[1].outcome == "none" and out[1].san is None and out[2].outcome == "move" and 3 not in out
    calls = spark.sparkContext.accumulator(0)

    def resigning(contexts):
        calls.add(len(contexts))
        return [{"<white-resign>": 1.0} for _ in contexts]

    gone = decoded(spark, [rules.START, rules.START, queen], decode.python_model(resigning))
    assert {r.outcome for r in gone.values()} == {"resign"} and calls.value == 2  # equal contexts are asked once
    forced = decoded(spark, [rules.START], force_quality="blunder")[0]
    assert forced.outcome == "move" and forced.label == "<blunder>"
    draw = decoded(spark, [rules.START], decode.python_model(lambda cs: [{"<draw>": 1.0} for _ in cs]))[0]
    assert draw.outcome == "draw"
    # a label is drawn, then the move under it; a model that knows nothing else is uniform over the legal moves
    labelled = decoded(spark, [rules.START], decode.python_model(lambda cs: [{"<inaccuracy>": 1.0} if c["quality"] is None else {"e4": 0.9, "d4": 0.1} for c in cs]))[0]
    assert (labelled.san, labelled.label) == ("e4", "<inaccuracy>")
    assert decoded(spark, [rules.START], decode.python_model(lambda cs: [{} for _ in cs]))[0].outcome == "move"
    best = decoded(spark, [queen], top_k=1, labels=(), resign=False, draw_offer=False)[0]
    assert best.san == "Qxd8+"
    assert decoded(spark, []) == {}


def test_heuristic_model_is_a_distribution(spark):
    rows = spark.createDataFrame([("a", rules.START, 1200, None, []), ("b", rules.START, None, "blunder", []), ("c", "4k3/8/8/3p4/4P3/8/8/4K3 w - - 0 1", 3000, None, ["x"])], "ctx string, fen string, rating int, quality string, prefix array<string>")
    out = decode.heuristic_model(rows).collect()
    for ctx in "abc":
        assert abs(sum(r.p for r in out if r.ctx == ctx) - 1) < 1e-9 and min(r.p for r in out if r.ctx == ctx) >= 0
    assert {r.token for r in out if r.ctx == "c"} == {"ed5"}


def test_context_ids(spark):
    row = spark.createDataFrame([(["e4"],)], "h array<string>")
    words = decode.context_words(F.col("h"), F.lit("w"), F.lit("<elo-any>"), F.lit(1500), F.lit("<mistake>"), F.array(F.lit("x")))
    found = row.select(words.alias("words")).withColumn("n", V.lookup("words")).select(decode.context_ids(F.col("n"), 4).alias("ids")).first().ids
    assert found == [V.ids()[t] for t in ("<elo-1400>", "e4", "<mistake>", "x")]
    with pytest.raises(Exception):
        row.select(F.array(F.lit("no word")).alias("words")).withColumn("n", V.lookup("words")).select(decode.context_ids(F.col("n"), 4)).collect()


def test_pgn():
    moves, comments, nags, variations, result, error = pgn.main_line("1. e4! {good\nmove} (1. d4 (1. c4) d5) e5 ; line\n2. Nf3 $1 Nc6 1/2-1/2")
    assert moves == ["e4", "e5", "Nf3", "Nc6"] and comments == ["good move", "line", None, None] and result == "1/2-1/2"
    assert nags == ["!", None, "$1", None] and variations == 2 and error is None
    assert pgn.main_line("1. e4 (1. d4 1-0")[5] and pgn.main_line("1. e4) 1-0")[5] and pgn.main_line("1. e4 {open")[5] and pgn.main_line("1. e4 1-0 e5")[5]


def test_pgn_written(spark):
    row = spark.createDataFrame([(["e4", "e5", "Nf3"], ["good {x}", None, "end"], ["!", "$2", None])], "m array<string>, c array<string>, g array<string>")
    text = row.select(pgn.movetext(F.col("m"), F.lit("1-0"), F.col("c"), F.col("g"))).first()[0]
    assert text == "1. e4! {good [x]} 1... e5 $2 2. Nf3 {end} 1-0" and pgn.main_line(text)[:3] == (["e4", "e5", "Nf3"], ["good [x]", None, "end"], ["!", "$2", None])
    headers = F.create_map(F.lit("Event"), F.lit('a "b"'))
    assert row.select(pgn.to_pgn(headers, F.col("m"), F.lit("*"), newline="\r\n")).first()[0] == '[Event "a \\"b\\""]\r\n\r\n1. e4 e5 2. Nf3 *'
    bad = spark.createDataFrame([('[Event "x"]\n\n1. e4 (1. d4 1-0',)], "value string")
    assert pgn.parse_pgn(bad).first().error and pgn.parse_pgn(bad).first().moves == ["e4"]
    with pytest.raises(Exception):
        pgn.parse_pgn(bad, strict=True).collect()


def test_another_dictionary(spark):
    forth, back = V.lookups(("a", "b", "c"))
    row = spark.createDataFrame([(["c", "x", "a"],), (None,), ([],)], "w array<string>").withColumn("n", forth("w"))
    assert [r.n for r in row.collect()] == [[2, None, 0], None, []] and row.select(back("n").alias("b")).first().b == ["c", None, "a"]


def test_batches_as_tensors(spark):
    import numpy as np

    from plyforge.operators import buckets

    rows = spark.createDataFrame([(i, 0, [1] * n, [2] * n) for i, n in enumerate((10, 60, 100, 2000))], "row_id long, seg int, x array<int>, y array<int>")
    assert tuple(buckets.oversized(rows, 512).first()) == (1, 2000)
    assert buckets.padded(rows, 512).count() == 3 and buckets.padded(rows, 512, "keep").count() == 4
    with pytest.raises(Exception):
        buckets.padded(rows, 512, "error").collect()
    found = list(buckets.tensors(buckets.batches(rows, 3, 512, 4)))
    assert [s for s, _, _ in found] == [0, 1, 2] and all(x.shape == y.shape and x.dtype == np.int64 and x.shape[1] in buckets.caps(512) for _, x, y in found)


def test_command_line(spark, tmp_path):
    from plyforge import __main__ as cli

    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/out"
    for args in (["synthetic", "--out", raw, "--games", "60"], ["tokenise", "--input", "/root/testdata/sf0.01/raw_games.parquet", "--out", out, "--min-elo", "0", "--shard-rows", "25"], ["pack", "--input", f"{out}/shards", "--out", out, "--val-frac", "0.2", "--single"], ["inspect", "--input", f"{out}/corpus"], ["check", "--input", raw, "--limit", "5"]):
        a = cli.parser().parse_args(args)
        a.run(spark, a)
    from plyforge.sources import binary, reports

    stats = reports.read_json(spark, f"{out}/pack_stats.json")
    assert stats["games_seen"] == reports.read_json(spark, f"{out}/stats.json")["games"] > 100 and stats["games_packed"] == binary.read_corpus(spark, f"{out}/corpus").count()
    assert reports.read_metadata(spark, f"{out}/meta.json")["vocab_size"] == 5273
    import numpy as np

    for split in ("train", "val"):
        stream, starts = np.fromfile(f"{tmp_path}/out/{split}.bin", "<u2"), np.load(f"{tmp_path}/out/{split}.idx.npy").astype(int)
        assert len(stream) == starts[-1] == stats[f"{split}_tokens"] and len(starts) - 1 == stats[f"{split}_games"]
        assert (stream[starts[:-1]] == V.ids()[V.BOS]).all() and (np.diff(starts) > 0).all()
    parts = sorted(binary.read_corpus(spark, f"{out}/corpus").where("split = 'train'").collect(), key=lambda r: (r.part, r.game))
    assert [t for r in parts for t in r.ids] == np.fromfile(f"{tmp_path}/out/train.bin", "<u2").tolist()


def test_pgn_text(spark, tmp_path):
    text = '[Event "a \\"b\\""]\n[Site "x"]\n\n1. e4 e5 1-0\n\n[Event "c"]\n\n1. d4 *\n'
    (tmp_path / "a.pgn").write_text(text)
    got = sorted((r.headers["Event"], r.moves, r.result) for r in pgn.read_pgn(spark, str(tmp_path / "a.pgn")).collect())
    assert got == [('a "b"', ["e4", "e5"], "1-0"), ("c", ["d4"], "*")]


def test_corpus_files(spark, tmp_path):
    import numpy as np

    rows = [("val", 1, 0, ids("B e4 E")), ("train", 2, 0, ids("B d4 E")), ("train", 3, 3, ids("B E"))]
    binary.write_corpus(spark.createDataFrame(rows, "split string, row_id long, start long, ids array<int>"), str(tmp_path / "c"))
    back = sorted((r.split, r.ids) for r in binary.read_corpus(spark, str(tmp_path / "c")).collect())
    assert back == sorted((r[0], r[3]) for r in rows)
    for f in (tmp_path / "c").glob("*.idx"):
        f.write_bytes(b"")  # a broken index is found again by a scan
    assert sorted((r.split, r.ids) for r in binary.read_corpus(spark, str(tmp_path / "c")).collect()) == back
    with pytest.raises(ValueError):
        binary.scan(lambda a, b: np.array([1, 2], np.uint16)[a:b], 2)


@pytest.mark.parametrize("make", ["running", "ordered"])
def test_offsets(spark, make):
    df = spark.createDataFrame([("a" if i % 3 else None, i, i % 5) for i in range(100)], "g string, k int, w int")
    out = (running_offset(df, ["g"], ["k"], "w", slices=7) if make == "running" else ordered_offset(df.where("g IS NOT NULL"), ["g"], ["k"], "w")).collect()
    for g in {r.g for r in out}:
        part = sorted((r for r in out if r.g == g), key=(lambda r: (r.offset, r.w)) if make == "running" else (lambda r: r.k))
        run = 0
        for r in part:
            assert r.offset == run
            run += r.w


def shards(spark, rows):
    return spark.createDataFrame([(i, f, s, p) for i, (f, s, p) in enumerate(rows)], "rec_id long, feed string, shard_no int, payload string").withColumn("written_at", F.lit(None).cast("timestamp_ntz"))


def test_drift_changes(spark):
    rows = [
        ("f", 1, '{"result": "1-0", "termination": "Normal"}'), ("f", 1, '{"result": null}'), ("f", 1, "{broken"), ("f", 1, None), ("f", 1, ""), ("f", 1, "[1]"), ("f", 1, '{"result": "1-0"} x'),
        ("f", 2, '{"Result": 1, "movetext_result": "1-0"}'), ("f", 2, '{"Result": -1}'),
        ("f", 3, '{"Result": 1.0, "termination": null}'),
        ("f", 4, "{broken"),
        ("f", 5, '{"upshot": [1, 0], "termination": ["Normal", "x"]}'), ("f", 5, '{"upshot": [0.5, 0.5]}'),
        ("g", 2, '{"score": {"white": 0, "black": 1}, "term": 3}'), ("g", 2, '{"score": {"white": 0.5, "black": 0.5}, "term": 4}'),
    ]
    df = shards(spark, rows)
    got = {tuple(r) for r in drift.changes(df).select("feed", "shard_no", "field_name", "change_kind").collect()}
    assert got == {
        ("f", 2, "result", "renamed"), ("f", 2, "result", "retyped"), ("f", 2, "termination", "removed"), ("f", 3, "result", "retyped"), ("f", 3, "termination", "added"), ("f", 4, "result", "removed"), ("f", 4, "termination", "removed"),
        ("f", 5, "result", "added"), ("f", 5, "termination", "added"),
    }
    table = {r.rec_id: r for r in drift.unified(df).collect()}
    assert len(table) == len(rows)
    assert [table[i].result for i in (0, 1, 2, 7, 8, 9, 11, 12, 13, 14)] == ["1-0", None, None, "1-0", "0-1", "1-0", "1-0", "1/2-1/2", "0-1", "1/2-1/2"]
    assert [table[i].termination for i in (0, 7, 11, 13, 14)] == ["Normal", None, "Normal", "Normal", "Time forfeit"]
    assert table[7].result_whole == 1 and table[9].result_decimal == 1.0 and table[11].result_list == "[1,0]" and [table[i].readable for i in (2, 3, 4, 5, 6)] == [False] * 5


def test_drift_empty_and_clashing(spark):
    df = shards(spark, [])
    assert drift.changes(df).count() == 0 and drift.unified(df).count() == 0
    extra = shards(spark, [("f", 1, '{"result": "1-0"}'), ("f", 2, "{}")]).withColumns({c: F.lit(1) for c in ("key", "kind", "value", "v", "field_name", "n")})
    assert [tuple(r) for r in drift.changes(extra).select("shard_no", "change_kind").collect()] == [(2, "removed")]
    assert drift.unified(extra).count() == 2


def test_board_editing():
    b = rules.Board.empty()
    assert b.put("K", "e1") and not b.put("K", "e2") and not b.put("P", "a8") and b.put("R", "h1") and b.put("k", "e8")
    assert b.set_rights("K") and not b.set_rights("KQ") and b.rights == "K"
    assert b.remove("h1") == "R" and b.rights == "" and b.get("h1") is None and b.find("k") == ["e8"]
    assert b.set_turn("b") and b.turn == "b" and b.put("R", "e4") and not b.set_turn("w")  # black is in check
    assert rules.Board().ascii().splitlines()[0] == "r n b q k b n r"


def test_stream_deduplicates(spark, tmp_path):
    from plyforge.streaming import stage1 as streaming

    rows = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00'), ('a', timestamp_ntz'2024-01-02 00:00:00'), ('b', timestamp_ntz'2024-01-01 00:00:00') AS t(site, ingested_at)").withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = streaming.deduplicated(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.site for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stream_resumes(spark, tmp_path):
    from plyforge.streaming import stage1 as streaming

    games = raw(spark)
    at = [str(tmp_path / x) for x in ("in", "out", "c")]
    for k in range(2):
        games.where(F.col("raw_id") % 2 == k).write.mode("append").parquet(at[0])
        streaming.run_available(spark, at[0], games, at[1], at[2], min_elo=0, min_plies=0)
    want = sorted(map(tuple, stage1.tokenised(games, 0, 0).select("raw_id", "tokens").collect()))
    assert sorted(map(tuple, spark.read.parquet(at[1]).select("raw_id", "tokens").collect())) == want


def test_salted_join(spark):
    from plyforge.operators.skew import salted_join

    a = [(k, i) for k, n in (("hot", 50), ("a", 40), ("x", 2), (None, 3)) for i in range(n)]
    b = [(k, -i) for k, n in (("hot", 30), ("b", 60), ("x", 3), (None, 2)) for i in range(n)] + [("x", 0)]
    da, db = spark.createDataFrame(a, "k string, i long"), spark.createDataFrame(b, "k string, j long")
    plain = sorted(map(tuple, da.join(db, "k").collect()))
    for block in (1, 7, 1000):
        joined = salted_join(da, db, "k", block)
        assert joined.columns == ["k", "i", "j"] and sorted(map(tuple, joined.collect())) == plain
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else these few rows end up in one task
    spread = [r["count"] for r in salted_join(da, db, "k", 7).where("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(spread) > 1 and sum(spread) == 1500
    assert salted_join(da.limit(0), db, "k", 1).count() == 0


def test_ordered_offset_crosses_partitions_and_null_groups(spark):
    rows = [(("a", None, "b")[i % 3], i, i % 7) for i in range(500)]
    out = ordered_offset(spark.createDataFrame(rows, "g string, k int, w int"), ["g"], ["k"], "w").collect()
    run = {}
    for g, k, w in rows:
        assert {r.offset for r in out if r.k == k} == {run.get(g, 0)}
        run[g] = run.get(g, 0) + w


def test_metadata_is_validated(spark, tmp_path):
    import json

    from plyforge.sources import reports

    path = f"file://{tmp_path}/meta.json"
    reports.write_metadata(spark, path)
    assert reports.read_metadata(spark, path)["vocab_size"] == 5273
    for change, error in (({"core_count": None}, KeyError), ({"core_count": 5241}, ValueError), ({"vocab_size": 3}, ValueError)):
        meta = reports.metadata() | change
        if meta["core_count"] is None:
            del meta["core_count"]
        reports.write_text(spark, path, [json.dumps(meta)])
        with pytest.raises(error):
            reports.read_metadata(spark, path)


def test_alternatives_beside_each_other(spark):
    from plyforge.operators import drift

    payloads = [
        (1, '{"result": "1-0"}'), (1, '{"result": "0-1"}'), (2, '{"result": "1-0"}'), (2, '{"result": 1}'), (2, '{"result": [0.5, 0.5]}'),
        (3, '{"outcome": "0-1"}'), (3, '{"result": "1-0"}'), (3, "broken"), (3, '{"result": null}'),
    ]
    rows = spark.createDataFrame([(i, "f", n, None, p) for i, (n, p) in enumerate(payloads)], "rec_id long, feed string, shard_no int, written_at timestamp_ntz, payload string")
    found = {tuple(r) for r in drift.alternatives(rows).collect()}
    assert found == {("f", 2, "result", "result", "whole", 1, True), ("f", 2, "result", "result", "list", 1, True), ("f", 3, "result", "outcome", "text", 1, True)}
    table = {r.rec_id: r for r in drift.unified(rows).collect()}
    assert len(table) == len(payloads) and table[7].readable is False and table[4].result == "1/2-1/2" and table[4].result_kind == "list"


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from plyforge.sources.tables import shared_dir

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"), conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError):
        shared_dir(cluster)


def test_months_read_only_their_folders(spark, tmp_path):
    from plyforge.sources.tables import months

    root = f"file://{tmp_path}/m"
    spark.createDataFrame([(i, f"{2020 + i % 3}", f"{1 + i % 12:02d}") for i in range(72)], "k int, year string, month string").write.partitionBy("year", "month").parquet(root)
    read = months(spark, root, ("2020-01", "2021-02"))
    assert {(r.year, r.month) for r in read.collect()} == {("2020", "01"), ("2021", "02")} and len(read.inputFiles()) == len([f for f in months(spark, root).inputFiles() if "2020/month=01" in f or "2021/month=02" in f])


def test_threefold_and_clock_per_ply(spark):
    shuffle = ["Nf3", "Nf6", "Ng1", "Ng8"] * 3
    rows = sorted(rules.replay_plies(spark.createDataFrame([(1, shuffle + ["e4", "xx"]), (2, None)], "id int, sans array<string>"), "id", "sans").collect(), key=lambda r: r.ply)
    assert [r.times for r in rows] == [1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 1] and [r.half_moves for r in rows] == [*range(1, 13), 0]
    assert [r.threefold for r in rows] == [r.times >= 3 for r in rows] and rows[3].position_hash == rows[7].position_hash != rows[0].position_hash


def test_every_legal_move_is_read_back(spark):
    fens = ["r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", "rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8", "4k3/8/8/3pP3/8/8/8/4K3 w - d6 0 1"]
    for fen in fens:
        b = rules.Board(fen)
        legal = b.legal()
        for m in legal:
            assert b.read(b.san(m, legal), strict=True) == m and b.read(b.san(m, legal)) == m


def test_game_line():
    g = rules.Game()
    for san in ("f3", "e5", "g4"):
        g.apply(san)
    assert g.comment("a {b} {c}") == "a [b] {c}" and g.undo() is not None and g.comment() is None
    g.apply("g2-g4")
    g.apply("Qh4")
    assert g.sans == ["f3", "e5", "g4", "Qh4#"] and g.status()["checkmate"] and g.status()["over"]
    with pytest.raises(ValueError):
        g.apply("e4")
    while g.undo():
        pass
    assert g.board.fen() == rules.START and g.undo() is None
    for san in ["Nf3", "Nf6", "Ng1", "Ng8"] * 2:
        g.apply(san)
    assert g.repeated() == 3 and g.status()["threefold"] and rules.Game("4k3/8/8/8/8/8/8/4K2R w K - 0 1").headers["SetUp"] == "1"


def test_zst_pgn(spark, tmp_path):
    import zstandard

    from plyforge.sources import compressed

    games = "".join(f'[Event "g"]\n[Id "{i}"]\n\n1. e4 e5 {{c {i}}} 2. Nf3 1-0\n\n' for i in range(5000))
    for k in range(2):
        (tmp_path / f"{k}.pgn.zst").write_bytes(zstandard.compress(games.encode()))
    back = compressed.read_zst_pgn(spark, str(tmp_path))
    assert back.count() == 10000 and back.where("size(moves) = 3 AND result = '1-0'").select(F.col("headers")["Id"]).distinct().count() == 5000


def test_dense_logits(spark):
    row = spark.createDataFrame([([0.0, 1.0, 99.0],)], "z array<double>").select(shaping.softmax_dense(F.col("z"), 2).alias("p")).first().p
    assert [round(x, 6) for x in row] == [0.268941, 0.731059]


def test_comment_forms(spark):
    row = spark.createDataFrame([("a {b} {c}",), ("plain",), (None,)], "t string")
    assert [tuple(r) for r in row.select(pgn.bracketed_comment(F.col("t")), pgn.safe_comment(F.col("t"))).collect()] == [("a [b] {c}", "a [b] [c]"), ("plain", "plain"), (None, None)]
