"""The frozen move dictionary: 5,273 tokens whose position is their id, made from the geometry of the board."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plyforge.functions.streams import MODIFIERS

FILES, RANKS = "abcdefgh", "12345678"

# The tail of the dictionary.
LABEL_WORDS = {"?!": "<inaccuracy>", "?": "<mistake>", "??": "<blunder>"}
BOS, EOS, ELO_ANY = "<bos>", "<eos>", "<elo-any>"
ELO_BUCKETS = ("<elo-u800>", *(f"<elo-{e}>" for e in range(800, 3000, 200)), "<elo-3000p>")
ENDINGS = ("<white-resign>", "<black-resign>", "<white-flag>", "<black-flag>", "<draw>")
SHA256 = "dba85917973dcea49dd930ea003c3f9197bd92adc03403828ba21847ad3ae293"


def _line(f: int, r: int, steps) -> list[tuple[int, int]]:
    return [(f + a, r + b) for a, b in steps if 0 <= f + a < 8 and 0 <= r + b < 8]


def _origins(piece: str, f: int, r: int) -> list[tuple[int, int]]:
    """Squares from which a piece reaches (f, r) on an empty board, in the dictionary's order."""
    if piece == "N":
        return _line(f, r, ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)))
    straight = [(x, r) for x in range(8) if x != f] + [(f, y) for y in range(8) if y != r]
    diagonal = _line(f, r, ((d, s * d) for d in range(-7, 8) if d for s in (1, -1)))
    return {"R": straight, "B": diagonal, "Q": straight + diagonal}[piece]


def _prefixes(origins: list[tuple[int, int]]) -> list[str]:
    """What SAN may need before the target square: nothing, a file, a rank, or both."""
    files = sorted({f for f, _ in origins})
    out = dict.fromkeys(["", *(FILES[f] for f in files if len(files) > 1)])
    on_file = lambda f: sum(x == f for x, _ in origins)
    on_rank = lambda r: sum(y == r for _, y in origins)
    out |= dict.fromkeys(RANKS[r] for f, r in origins if on_file(f) > 1)
    out |= dict.fromkeys(FILES[f] + RANKS[r] for f, r in origins if on_file(f) > 1 and on_rank(r) > 1)
    return list(out)


@lru_cache(maxsize=1)
def tokens() -> tuple[str, ...]:
    """All tokens in order of their ids."""
    out = [f + r for f in FILES for r in RANKS]
    out += [FILES[a] + f + r for i, f in enumerate(FILES) for a in (i - 1, i + 1) if 0 <= a < 8 for r in RANKS]
    for piece in "NBRQK":
        for r in range(7, -1, -1):
            for f in range(8):
                forms = [""] if piece == "K" else _prefixes(_origins(piece, f, r))
                out += [piece + form + FILES[f] + RANKS[r] for form in forms]
    out += ["O-O", "O-O-O", *MODIFIERS, *LABEL_WORDS.values(), BOS, EOS, *ELO_BUCKETS, ELO_ANY, *ENDINGS]
    if hashlib.sha256("\n".join(out).encode()).hexdigest() != SHA256:
        raise AssertionError("the dictionary differs from the frozen one")
    return tuple(out)


@lru_cache(maxsize=1)
def ids() -> dict[str, int]:
    return {t: i for i, t in enumerate(tokens())}


CORE_COUNT = 5242


def kind(i: int) -> str:
    t = tokens()[i]
    if i < CORE_COUNT:
        return "core"
    if t in MODIFIERS:
        return "modifier"
    if t in LABEL_WORDS.values():
        return "label"
    if t.startswith("<elo-"):
        return "elo"
    return "end" if t in ENDINGS else "frame"


def vocabulary(spark: SparkSession) -> DataFrame:
    """``token_id, token, kind``: 5,273 rows, a fixed table."""
    schema = T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("kind", T.StringType())])
    return spark.createDataFrame([(i, t, kind(i)) for i, t in enumerate(tokens())], schema)


def surface(token: Column) -> Column:
    """The dictionary's form of a stream token: brackets off, labels as words."""
    bare = F.when(F.length(token) >= 2, F.regexp_replace(token, r"(?s)^\[(.*)\]$", "$1")).otherwise(token)
    word = bare
    for glyph, name in LABEL_WORDS.items():
        word = F.when(bare == glyph, name).otherwise(word)
    return word


@lru_cache(maxsize=4)
def _words(words: tuple[str, ...] | None) -> pa.Array:
    return pa.array(words or tokens())


def _over(flat: pa.Array, lists: pa.Array) -> pa.Array:
    offsets = pc.subtract(lists.offsets, lists.offsets[0])
    return pa.ListArray.from_arrays(offsets, flat, mask=lists.is_null()) if lists.null_count else pa.ListArray.from_arrays(offsets, flat)


def lookups(words: tuple[str, ...] | None = None):
    """``(lookup, reverse_lookup)`` of a dictionary given as its words in order of their ids; the frozen one without.

    One vectorised hash lookup per batch (a map literal would be searched entry by entry); words outside give null.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def forth(found: pa.Array) -> pa.Array:
        return _over(pc.index_in(found.flatten(), value_set=_words(words)), found)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def back(numbers: pa.Array) -> pa.Array:
        return _over(_words(words).take(numbers.flatten()), numbers)

    return forth, back


lookup, reverse_lookup = lookups()


def elo_bucket(elo: Column, missing: str = ELO_BUCKETS[0]) -> Column:
    """Bucket token of a rating: steps of 200 from 800 to 3000; ``missing`` for null (training: below 800; serving: any)."""
    step = (F.floor(elo / 200) * 200).cast("int").cast("string")
    return F.when(elo.isNull(), missing).when(elo < 800, ELO_BUCKETS[0]).when(elo >= 3000, ELO_BUCKETS[-1]).otherwise(F.concat(F.lit("<elo-"), step, F.lit(">")))


def end_token(result: Column, termination: Column, mate: Column) -> Column:
    """How a game ended, from its headers: who resigned or lost on time, or a draw; null if they do not tell."""
    loser = F.when(result == "1-0", "black").when(result == "0-1", "white")
    normal, time = termination == "Normal", termination == "Time forfeit"
    return (
        F.when((result == "1/2-1/2") & normal, ENDINGS[4])
        .when(loser.isNotNull() & normal & ~mate, F.concat(F.lit("<"), loser, F.lit("-resign>")))
        .when(loser.isNotNull() & time, F.concat(F.lit("<"), loser, F.lit("-flag>")))
    )
