"""The training-data operators against brute force, properties and planted cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plyforge.llm import chunking, mixing, overlap, packing, queries, stuffing, term_frequency, tokens
from plyforge.functions.streams import LABELS, MODIFIERS, split_tokens
from tests.compare import ROOT, database, same

EXTRA = ("key", "text_", "side", "n", "h", "stream", "place", "size", "_h", "_slice", "shard", "repeats", "term", "mark", "window_no", "items", "record", "times", "kinds", "words", "seen", "part", "data", "block", "by", "_a", "_b", "piece_no", "stream_a", "_before")


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    same(queries.queries()[name](spark, ROOT), queries.oracle_sql()[name], db)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    queries.queries()[name](spark, ROOT).count()


# 1. Overlap


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(pick, a, edits, alphabet):
    b = list(a)
    for _ in range(edits):
        k, kind = pick.randrange(len(b) + 1), pick.random()
        if kind < 0.34 or not b:
            b.insert(k, pick.choice(alphabet))
        elif kind < 0.67:
            b.pop(k % len(b))
        else:
            b[k % len(b)] = pick.choice(alphabet)
    return b


def test_within_is_exact():
    pick = random.Random(1)
    for _ in range(1500):
        a = [pick.choice("abcd") for _ in range(pick.randrange(30))]
        b = edited(pick, a, pick.randrange(9), "abcd")
        d = distance(a, b)
        assert all(overlap.within(a, b, k) == (d <= k) for k in range(9))


def games(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "row_id long, split_name string, tokens string, site string, utc_date string")
    return df.withColumns({c: F.lit(7) for c in extra})


def brute(rows):
    import datetime
    import re

    def key(site, day):
        m = re.match(r"\s*(?:https?://)?(?:www\.)?([^/?#\s]+)/([A-Za-z0-9]{8})(?![^/?#\s])", site or "", re.I)
        d = re.match(r"\s*(\d{4})[-./](\d{1,2})[-./](\d{1,2})(?!\d)", day or "")
        try:
            return (m[1].lower(), m[2], datetime.date(*map(int, d.groups()))) if m and d else None
        except ValueError:
            return None

    rows = [(i, s, [t for t in split_tokens(x) if t not in LABELS], key(site, day)) for i, s, x, site, day in rows]
    out = set()
    for i, s, a, k in rows:
        for j, t, b, m in rows:
            if s == "train" and t in ("val", "test"):
                near = min(len(a), len(b)) >= 40 and distance(a, b) * 10 <= max(len(a), len(b))
                if near or (k and k == m):
                    out.add((min(i, j), max(i, j)))
    return out


def overlap_rows(seed=3):
    pick, rows, n = random.Random(seed), [], 0
    small, large = list("abcde"), [f"t{i}" for i in range(200)]

    def add(split, stream, site=None, day=None, brackets=True):
        nonlocal n
        n += 1
        text = None if stream is None else " ".join(f"[{t}]" for t in stream) if brackets else " ".join(stream)
        rows.append((n, split, text, site, day))

    for alphabet in (small, large, ["x"]):
        for _ in range(12):
            base = [pick.choice(alphabet) for _ in range(pick.choice((38, 40, 41, 60, 90, 150)))]
            add(pick.choice(("train", "val", "test")), base)
            for _ in range(4):
                add(pick.choice(("train", "val", "test", "train")), edited(pick, base, pick.choice((0, 1, 4, len(base) // 10, len(base) // 10 + 1)), alphabet), brackets=pick.random() < 0.5)
    labelled = [t for i in range(45) for t in (("??",) if i % 5 == 0 else ()) + (f"m{i}",)]
    add("train", labelled), add("val", [t for t in labelled if t != "??"]), add("test", [f"m{i}" for i in range(39)])
    for site, day in (("https://A.example/abcdEFGH", "2024.1.2"), ("www.a.example/abcdEFGH/white", "2024-01-02 10:00:00"), (" HTTP://a.example/abcdEFGH?x ", "2024/01/02"), ("a.example/abcdEFGh", "2024-01-02"), ("a.example/abcdEFGHi", "2024-01-02"), ("a.example/abcdEFGH", "2024-02-30"), ("a.example/abcdEFGH", "????.??.??"), (None, None), ("", "")):
        for split in ("train", "val", None, "dev"):
            add(split, None if pick.random() < 0.5 else [], site, day)
    return rows


def test_overlap_equals_brute_force(spark):
    rows = overlap_rows()
    want = brute(rows)
    assert len(want) > 60
    got = {tuple(r) for r in overlap.overlap_pairs(games(spark, rows, EXTRA)).collect()}
    assert got == want


def test_overlap_rows_and_hot_class(spark):
    stream = " ".join(f"m{i}" for i in range(50))
    rows = [(i, "train" if i % 2 else "val", stream, None, None) for i in range(20)] + [(50, "val", None, None, None), (51, "val", None, "a.example/abcdEFGH", "2024.1.2"), (53, "train", None, "a.example/abcdEFGH", "2024-01-02")]
    assert overlap.overlap_pairs(games(spark, rows), 3).count() == 101  # ten rows of a class on each side meet in blocks of three
    assert {tuple(r) for r in overlap.overlap_rows(games(spark, rows)).collect()} == {(i, True, False, 1) for i in range(0, 20, 2)} | {(51, False, True, 1)}
    report = {r.host: r for r in overlap.overlap_report(games(spark, rows)).collect()}
    assert {h: (r.split_name, r.n_rows, r.n_overlapping, r.n_by_stream, r.n_by_game) for h, r in report.items()} == {"unknown": ("val", 11, 10, 10, 0), "a.example": ("val", 1, 1, 0, 1)}


def test_hot_keys_on_both_sides(spark):
    pick, rows = random.Random(17), []
    base = [f"m{i}" for i in range(60)]
    for i in range(120):  # one family: shingles, texts and members are all hot
        s = edited(pick, base, pick.choice((0, 0, 1, 2)), base)
        rows.append((i, pick.choice(("train", "val")), " ".join(s), None, None))
    rows += [(1000 + i, pick.choice(("train", "test")), " ".join(base), "a.example/abcdEFGH", "2024.1.2") for i in range(40)]
    want = brute(rows)
    assert len(want) > 2000
    assert {tuple(r) for r in overlap.overlap_pairs(games(spark, rows), 5).collect()} == want


def test_training_rows_stay_pruned_as_the_data_grow(spark):
    """Ten times the evaluation rows: the share of training rows that send anything stays small, as the set grows with them."""
    shares = []
    for n in (300, 3000):
        pick = random.Random(n)
        rows = [(i, "train" if i % 2 else "val", " ".join(f"{pick.randrange(400)}" for _ in range(60)), None, None) for i in range(n)]
        df = overlap._sides(games(spark, rows))
        table = spark.sparkContext.broadcast(overlap.rarity(df))
        coded = df.select("row_id", "side", "tokens", F.lit(None).cast("binary")).mapInArrow(overlap._encode(table), "row_id long, side int, stream binary, n int, postings array<struct<h: bigint, lo: int, hi: int>>, game_day binary")
        by = {r.side: r.sent for r in coded.groupBy("side").agg(F.avg((F.size("postings") > 0).cast("int")).alias("sent")).collect()}
        assert by[1] == 1
        shares.append(by[0])
    assert max(shares) < 0.05


def test_a_full_set_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MAX_BITS", 3)
    rows = overlap_rows(5)
    assert {tuple(r) for r in overlap.overlap_pairs(games(spark, rows)).collect()} == brute(rows)


def test_overlap_with_an_id_used_twice(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, "train", a, None, None), (1, "train", b, None, None), (2, "val", b + " more", None, None), (3, "val", a, None, None), (3, "val", a, None, None)]
    assert {tuple(r) for r in overlap.overlap_pairs(games(spark, rows)).collect()} == {(1, 2), (1, 3)}


def test_overlap_empty(spark):
    for rows in ([], [(1, "train", "a b", None, None)], [(1, "val", None, None, None)], [(None, None, None, None, None)]):
        df = games(spark, rows)
        assert overlap.overlap_pairs(df).count() == 0 and overlap.overlap_rows(df).count() == 0


# 2. Chunking


def check_pieces(stream, found, limit=256, overlap_=8):
    ends = {i + 1 for i, t in enumerate(stream) if t not in LABELS + MODIFIERS}
    starts = ends | {0}
    assert found[0][0] == 0 and found[-1][1] == len(stream)
    for (a, b, _, kind), (c, d, rep, _) in zip(found, found[1:]):
        assert b - c == rep and c > a and d > b
        if kind == "hard":
            assert b - a == limit and not any(e in ends for e in range(a + 41, b + 1))
        if b in ends:
            whole = [s for s in starts if b - 32 <= s <= b - overlap_]
            assert c == (max(whole) if whole else b - overlap_)
        else:
            assert kind == "hard" and rep == overlap_
    assert all(0 < b - a <= limit for a, b, _, _ in found)


def stream_of(pick, n):
    out = []
    while len(out) < n:
        if pick.random() < 0.3:
            out.append(pick.choice(LABELS + MODIFIERS))
        else:
            out.append(f"m{pick.randrange(500)}")
    return out[:n]


def test_pieces():
    pick = random.Random(2)
    for n in (1, 8, 256, 257, 300, 511, 1000, 5000):
        s = stream_of(pick, n)
        check_pieces(s, chunking.cut(s))
    assert chunking.cut([]) == [] and len(chunking.cut(["x"] * 256)) == 1
    for s in (["x"] * 1000, ["m1"] * 1000, ["x"] * 300 + ["m"] + ["+"] * 300, stream_of(pick, 200) + ["x"] * 400 + stream_of(pick, 400)):
        check_pieces(s, chunking.cut(s))


def test_an_edit_moves_near_cuts_only():
    pick = random.Random(4)
    kept = []
    for _ in range(10):
        s = stream_of(pick, 6000)
        t = s[:1000] + ["m999", "m998", "m997"] + s[1000:]
        a, b = ({e for _, e, _, k in chunking.cut(x)} for x in (s, t))
        kept.append(len({e for e in a if e > 3000} & {e - 3 for e in b}) / len({e for e in a if e > 3000}))
    assert sum(kept) / 10 > 0.9


def test_pieces_table(spark):
    pick = random.Random(6)
    rows = [(1, None), (2, ""), (3, "[e4] [d4]"), (4, " ".join(stream_of(pick, 256))), (5, "".join(f"[{t}]" for t in stream_of(pick, 257))), (5, " ".join(stream_of(pick, 900))), (None, " ".join(["m"] * 300))]
    df = spark.createDataFrame(rows, "row_id long, tokens string").withColumns({c: F.lit(1) for c in EXTRA})
    out = chunking.pieces(df).collect()
    assert Counter(r.row_id for r in out if r.piece_no == 0) == {3: 1, 4: 1, 5: 2, None: 1}
    assert {r.row_id for r in chunking.pieces(df, long_only=True).collect()} == {5, None}
    assert all(len(r.tokens) == r.end_pos - r.start_pos <= 256 for r in out)
    assert chunking.pieces(df.limit(0)).count() == 0


# 4. Frequencies


def test_frequencies(spark):
    pick = random.Random(8)
    rows = [(i, None if i % 50 == 0 else " ".join(pick.choice(["hot", "x", f"r{pick.randrange(300)}", "Hot"]) for _ in range(pick.randrange(12)))) for i in range(600)]
    rows += [(700, "[a] [a][b]\t[b c] [unclosed"), (700, "[a]"), (None, "a q"), (701, "w " * 20000)]
    want, docs = Counter(), Counter()
    for _, t in rows:
        want.update(split_tokens(t)), docs.update(set(split_tokens(t)))
    df = spark.createDataFrame(rows, "row_id long, tokens string").withColumns({c: F.lit(1) for c in EXTRA})
    out = term_frequency.marked(df).collect()
    assert {r.term: (r.n_occurrences, r.n_records) for r in out} == {t: (n, docs[t]) for t, n in want.items()}
    assert {r.term: r.mark for r in out} == {t: "rare" if n <= 3 else "common" if n > 0.3 * len(rows) else None for t, n in docs.items()}
    assert term_frequency.marked(df.limit(0)).count() == 0


def test_a_hot_term_spans_ranges(spark):
    rows = [(i, "hot " + f"r{i % 40} hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, tokens string")
    found = term_frequency.pairs(df)
    assert found.where("term = 'hot'").select("record").distinct().count() == 3000 and found.count() == 6000
    per = term_frequency.ranged(found).where("term = 'hot'").groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(per) > 1 and max(r["count"] for r in per) < 2500
    out = {r.term: (r.n_occurrences, r.n_records) for r in term_frequency.term_frequency(df).collect()}
    assert out["hot"] == (6000, 3000) and out["r7"] == (75, 75) and len(out) == 41


def test_run_length_scan_over_batches():
    pick = random.Random(3)
    rows = sorted((pick.choice("abcd"), pick.randrange(6), pick.randrange(1, 4)) for _ in range(60))
    for step in (1, 3, 60):
        parts = [rows[k : k + step] for k in range(0, 60, step)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[1] for r in p], pa.int64()), pa.array([r[2] for r in p], pa.int32())], ["term", "record", "times"]) for p in parts]
        out = {r["term"]: (r["n_occurrences"], r["n_records"]) for b in term_frequency._scan(iter(batches)) for r in b.to_pylist()}
        assert out == {t: (sum(n for x, _, n in rows if x == t), len({k for x, k, _ in rows if x == t})) for t in "abcd"}


# 5. Packing


@pytest.mark.parametrize("capacity", [1, 2, 16, 512])
def test_plan_uses_every_item_once(capacity):
    pick = random.Random(capacity)
    for shape in ("even", "short", "one", "none"):
        counts = Counter() if shape == "none" else Counter(min(capacity, 1 + int(pick.expovariate(1 / (capacity / {"even": 3, "short": 30, "one": 2}[shape])))) for _ in range(3000 if shape != "one" else 1))
        patterns = packing.plan(dict(counts), capacity)
        used = Counter()
        for p, n, _ in patterns:
            assert n > 0 and sum(a * t for a, t in p) <= capacity
            for a, t in p:
                used[a] += t * n
        assert used == counts
        windows = sum(n for _, n, _ in patterns)
        if shape in ("even", "short") and capacity == 512:
            assert sum(a * c for a, c in counts.items()) / (windows * capacity) > 0.985


def test_least_squares_finds_an_exact_fit():
    counts = np.bincount([3] * 10 + [5] * 10 + [4] * 8, minlength=9).astype(float)
    columns, x = packing.least_squares(counts, 8)
    assert {tuple(c): round(v, 1) for c, v in zip(columns.tolist(), x)} == {(5, 3, 0): 10, (4, 4, 0): 4}
    assert packing.rounded(columns, x, counts)[1].tolist() == [0] * 9


def test_rounding_keeps_the_mass():
    columns, x = np.array([[4, 3, 1], [4, 2, 2], [3, 3, 2]]), np.array([0.5, 0.6, 0.9])
    repeats, left = packing.rounded(columns, x, np.array([0, 1, 5, 3, 2, 0, 0, 0, 0]))
    assert repeats.tolist() == [0, 1, 1] and left.tolist() == [0, 1, 2, 1, 1, 0, 0, 0, 0]


@pytest.mark.parametrize("capacity", [512, 2048, 8192])
def test_least_squares_packs_most(capacity):
    pick = random.Random(capacity)
    shares = []
    for n in (2000, 20000):
        counts = Counter(min(capacity, 1 + int(pick.lognormvariate(4.3, 1.1))) for _ in range(n))
        by = Counter()
        for p, repeats, how in packing.plan(dict(counts), capacity):
            by[how] += sum(a * t for a, t in p) * repeats
        shares.append(by[packing.FITTED] / (by[packing.FITTED] + by[packing.GREEDY]))
        assert packing.solved_share(dict(counts), capacity) > 0.93
    assert min(shares) > 0.88


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in EXTRA})


def test_windows(spark):
    pick = random.Random(9)
    rows = [(i, " word" * pick.choice((1, 5, 5, 5, 20, 70, 300)), "a") for i in range(300)] + [(900, None, None), (901, "", "a"), (902, " word" * 5000, "b"), (903, " word" * 64, "b")]
    df = documents(spark, rows)
    sizes = spark.createDataFrame([("s", 64), ("m", 256), ("bad", 0), ("none", None)], "container string, capacity_tokens int")
    packed = packing.windows(df, sizes).collect()
    for name, capacity in (("s", 64), ("m", 256)):
        own = [r for r in packed if r.container == name]
        by_window, by_doc = defaultdict(list), defaultdict(list)
        for r in own:
            by_window[r.window_no].append(r)
            by_doc[r.doc_id].append(r)
        assert set(by_doc) == {i for i, t, _ in rows if t}
        for i, t, _ in rows:
            if t:
                n = t.count(" word")
                pieces = sorted(by_doc[i], key=lambda r: r.piece_no)
                assert [p.n_tokens for p in pieces] == [min(capacity, n - k) for k in range(0, n, capacity)] and [p.first_token for p in pieces] == list(range(0, n, capacity))
        for w in by_window.values():
            w.sort(key=lambda r: r.position)
            assert [r.position for r in w] == list(range(len(w))) and [r.window_token for r in w] == [sum(x.n_tokens for x in w[:k]) for k in range(len(w))]
            assert sum(r.n_tokens for r in w) <= capacity
        assert sorted(by_window) == list(range(len(by_window)))
        assert sum(r.n_tokens for r in own) / (len(by_window) * capacity) > 0.97
    assert packing.windows(df.limit(0), sizes).count() == 0 and packing.windows(df, sizes.limit(0)).count() == 0


def test_token_counts(spark):
    texts = ["Hello world", "", None, "naïve <|endoftext|> 日本語 \n\n  x", "a" * 3000, "é" * 999]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.k: r.n_tokens for r in tokens.token_counts(df, {"k": "doc_id"}).collect()}
    encode = tokens.encoder()
    assert got == {i: len(encode.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)} and got[0] == 2
    assert all(encode.decode(encode.encode_ordinary(t)) == t for t in texts if t)


# 6. Mixing


def test_apportionment_follows_the_quotients():
    pick = random.Random(11)
    for _ in range(200):
        weights = [pick.choice((0.0, 1.0, pick.random(), pick.random() * 10)) for _ in range(pick.randrange(1, 8))]
        caps = [pick.randrange(0, 30) for _ in weights]
        seats = pick.randrange(0, 60)
        q = [0] * len(weights)
        for _ in range(seats):
            open_ = [i for i, w in enumerate(weights) if w > 0 and q[i] < caps[i]]
            if open_:
                q[max(open_, key=lambda i: (weights[i] / (2 * q[i] + 1), -i))] += 1
        assert mixing.sainte_lague(weights, seats, caps) == q


def mix_documents(spark, sizes):
    rows, n = [], 0
    for source, counts in sizes.items():
        for c in counts:
            n += 1
            rows.append((n, " word" * c, source))
    return rows


def test_mix(spark):
    pick = random.Random(12)
    sizes = {s: [pick.choice((1, 4, 10, 30)) for _ in range(k)] for s, k in (("big", 1200), ("mid", 500), ("tiny", 40))}
    sizes["mid"] += [900]
    rows = mix_documents(spark, sizes) + [(9001, " word word", "BIG "), (9002, None, "mid"), (9003, "", "mid"), (9004, " word", None), (9005, " word", "other")]
    mix = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("Tiny", 0.1, 6), ("absent", 0.1, 3), ("null", None, None)], "source string, target_share double, max_repeats int")
    mixed = mixing.repeats(documents(spark, rows), mix)
    out = {r.doc_id: r for r in mixed.collect()}
    assert len(out) == len(rows) and all(out[i].repeats == 0 for i in (9002, 9003, 9004, 9005)) and out[9001].source == "big"
    caps = {"big": 1, "mid": 2, "tiny": 6}
    assert all(r.repeats <= caps.get(r.source, 0) for r in out.values())
    report = {r.source: r for r in mixing.shares(mixed, mix).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(report[s].actual_share - share / 0.9) < 0.01
    assert report["absent"].actual_share == 0 and report["tiny"].most_repeats == 6  # the smallest source is used up
    again = {r.doc_id: r.repeats for r in mixing.repeats(documents(spark, rows), mix).collect()}
    assert again == {i: r.repeats for i, r in out.items()}


def test_selection_follows_the_quotas():
    pick = random.Random(14)
    for _ in range(50):
        lines = [[pick.choice((0, 40, 90, 120, 300)) for _ in range(60)] for _ in range(16)]
        totals, cap = [sum(x) + 1 for x in lines], pick.choice((1, 2, 5))
        quota = [int(pick.random() * t * cap * 0.9) for t in totals]
        base, extra = mixing.select(totals, quota, lines, cap)
        used = [b * t + sum(x[k] for k in e) for b, t, x, e in zip(base, totals, lines, extra)]
        assert abs(sum(used) - sum(quota)) <= 15 and all(b + bool(e) <= cap for b, e in zip(base, extra))
        assert all(abs(u - q) < 600 for u, q in zip(used, quota))


@pytest.mark.parametrize("shards", [1, 16])
def test_shares_are_near_with_any_number_of_shards(spark, shards):
    docs, mix = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "mix_targets"))
    mixed = mixing.repeats(docs, mix, shards=shards)
    assert all(r.on_target and r.capped for r in mixing.checks(mixed, mix).collect())


def test_mix_empty(spark):
    mix = spark.createDataFrame([("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    empty = documents(spark, [])
    assert mixing.repeats(empty, mix).count() == 0
    assert [(r.source, r.actual_share) for r in mixing.shares(mixing.repeats(empty, mix), mix).collect()] == [("big", 0.0)]
    assert [r.repeats for r in mixing.repeats(documents(spark, [(1, " a", "x")]), mix.limit(0)).collect()] == [0]


# 7. Stuffing

PROSE = [
    "The {a} on the table belongs to the club, and nobody knows who left it there.", "I think that we should look at the {a} before the next round, because it was late.", "Does anyone know why the {a} is so slow since the last update?",
    "My {a} was fine until the treasurer moved it to the other room.", "If you keep the {a} away from the window, it will be fine for years.",
]
PILE = " ".join(["cheap lamp", "best clock online", "lamp sale", "Zorvex", "Tallenta"] * 6)
THINGS = "clock board score ladder report engine chair window ticket library lesson opening study lamp"


def test_stuffed_posts_are_found(spark):
    pick = random.Random(13)
    things = THINGS.split()
    prose = lambda n: " ".join(pick.choice(PROSE).format(a=pick.choice(things)) for _ in range(n))
    keywords = " ".join(pick.choice(["cheap lamp", "best clock online", "lamp sale", "Zorvex", "Tallenta"]) for _ in range(40))
    links = "\n".join(f"https://shop{i}.example/p/{i}" for i in range(12))
    spam = [keywords, links, "Thanks!\n<div style=\"display:none\">" + keywords + "</div>", prose(1) + "\n\n" + keywords, "[quote=x]" + prose(2) + "[/quote]\n" + keywords, "\n".join(["#lamp", "#cheaplamp", "#clock_sale"] * 6), ", ".join(["cheap lamp", "best clock"] * 12), "\n".join(f"Zorvex X{i} refurbished" for i in range(15))]
    fine = [None, "", "ok", "bump", "[deleted]", "[quote]" + keywords + "[/quote]\n" + prose(2), "> " + keywords + "\n" + prose(2), "x wrote:\n>" + keywords + "\n" + prose(1), prose(2) + "\n-- \n" + links[:300],
            "1. e4 e5 2. Nf3 Nc6 3. Bb5 a6 4. Ba4 Nf6 5. O-O Be7 6. Re1 b5 7. Bb3 d6 1-0", "\n".join(f"* {t}. " + pick.choice(PROSE).format(a=t) for t in things), "\n".join(f"https://a.example/{i}\n" + prose(2) for i in range(4)), prose(200)]
    rows = [(i, t, "s") for i, t in enumerate([*spam, *fine, *(prose(pick.randrange(1, 6)) for _ in range(400))])] + [(0, spam[0], "s")]
    found = Counter(r.doc_id for r in stuffing.stuffed(documents(spark, rows)).collect())
    assert found == {0: 2} | {i: 1 for i in range(1, len(spam))}


FOREIGN_PROSE = [
    "Ieri sera ho portato il mio vecchio orologio al circolo, ma non c'era nessuno che sapesse come si apre. Poi è arrivato il custode e mi ha detto di tornare domani.",
    "Вчера вечером я принёс в клуб свои старые часы, но там не было никого, кто знал бы, как они открываются. Потом пришёл сторож и сказал мне, что лучше зайти завтра.",
    "Wczoraj wieczorem zaniosłem do klubu swój stary zegar, ale nie było tam nikogo, kto by wiedział, jak się go otwiera. Potem przyszedł dozorca i powiedział mi, że mam wrócić jutro.",
    "昨天晚上我把那只旧钟带到俱乐部去了，可是没有人知道怎样打开它。后来管理员来了，他让我明天再过去看看。",
]
FOREIGN_PILES = [
    "orologio economico lampada offerta orologio economico sedia usata lampada offerta orologio economico sedia usata prestito veloce lampada offerta prestito veloce orologio economico",
    "дешёвые часы лампа скидка дешёвые часы быстрый кредит лампа скидка дешёвые часы быстрый кредит лампа скидка дешёвые часы быстрый кредит",
    "tani zegar lampa promocja tani zegar szybki kredyt lampa promocja tani zegar szybki kredyt lampa promocja tani zegar szybki kredyt",
    "廉价手表 台灯优惠 廉价手表 快速贷款 台灯优惠 廉价手表 快速贷款 台灯优惠 廉价手表 快速贷款 台灯优惠",
]


def stuffing_rows(seed=13, n=400):
    pick, things = random.Random(seed), THINGS.split()
    return [" ".join(pick.choice(PROSE).format(a=pick.choice(things)) for _ in range(pick.randrange(1, 6))) for _ in range(n)]


def test_languages_without_training(spark):
    rows = [(i, t, "s") for i, t in enumerate([*FOREIGN_PROSE, *FOREIGN_PILES, *stuffing_rows()])]
    found = {r.doc_id for r in stuffing.stuffed(documents(spark, rows)).collect()}
    assert found == set(range(4, 8))


def test_a_long_cycle_and_a_long_signature(spark):
    cycle = "lamp clock board chair window ticket library lesson opening study score ladder report engine mirror carpet bottle pencil garden bridge".split()
    long_signature = "\n-- \nMy pages: " + " ".join(f"https://own{i}.example/page/{i}" for i in range(60))
    rows = [(0, " ".join(cycle * 4), "s"), (1, stuffing_rows(1, 1)[0] + long_signature, "s"), *((10 + i, t, "s") for i, t in enumerate(stuffing_rows()))]
    assert {r.doc_id for r in stuffing.stuffed(documents(spark, rows)).collect()} == {0}


def test_perplexity_decides_both_ways(spark):
    rows = [(i, t, "s") for i, t in enumerate([PILE, *stuffing_rows()])]
    assert [r.doc_id for r in stuffing.stuffed(documents(spark, rows)).collect()] == [0]
    assert stuffing.stuffed(documents(spark, rows), high=1e9).count() == 0
    # one turn of phrase over and over is too regular for a collection of varied prose
    pick, words = random.Random(5), [f"{a}{b}" for a in ("lam", "clo", "boa", "win", "tic", "les") for b in ("pa", "ck", "rd", "dow", "ket", "son")]
    small = "the a of to in on at by for with and or but if as so it was end".split()
    varied = lambda: " ".join(pick.choice(small if pick.random() < 0.5 else words) for _ in range(9)) + "."
    turn = "so it was the end of it."
    rows = [(0, " ".join([turn] * 20), "s"), *((i, " ".join([varied(), turn, varied(), varied()]), "s") for i in range(1, 400))]
    assert [(r.doc_id, r.low > 0.5, r.high) for r in stuffing.stuffed(documents(spark, rows)).collect()] == [(0, True, 0)]
    assert stuffing.stuffed(documents(spark, rows), low=-1e9).count() == 0


def test_stuffing_empty(spark):
    assert stuffing.stuffed(documents(spark, [])).count() == 0
    assert stuffing.stuffed(documents(spark, [(1, None, None), (None, "", "a")])).count() == 0


def test_own_text():
    own = stuffing.own_text
    assert own("[quote=a][quote]b[/quote]c[/quote]d") == "d"
    assert own("[quote=a]never closed\n\nown words") == "own words"
    assert own("<blockquote>[quote]cut</blockquote>own") == "own"
    assert own("a wrote:\n> x\n> y\nown &amp; words\n-- \nname") == "own & words"
    assert own("<blockquote>> x\n> y</blockquote>own") == "own" and own("[quote][quote]cut[/quote]own") == "own"
    assert own("<p>own\n-- \nname</p><br/>\nLast edited by x; reason: y") == "own" and own("one\n--\ntwo\n\nthree") == "one\n--\ntwo\n\nthree"
    assert own("own\n[i]name[/i]\n~~~\nmotto") == "own"
