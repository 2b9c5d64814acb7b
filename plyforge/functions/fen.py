"""Position strings (FEN) by string expressions alone: validation, material and dead positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Value of a piece in the heuristic balance.
VALUES = {"p": 1.0, "n": 3.0, "b": 3.1, "r": 5.0, "q": 9.0}
#: Names of the tests of ``fen_error``, in the order in which they are made.
ERRORS = ("fields", "move number", "half moves", "en passant", "castling", "side", "rows", "digits", "piece", "row length", "en passant side", "white king", "black king", "pawns")


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _expanded(row: Column) -> Column:
    """A row with every digit replaced by that many dots."""
    for n in range(1, 10):
        row = F.replace(row, F.lit(str(n)), F.lit("." * n))
    return row


def fen_error(fen: Column) -> Column:
    """The first test the string fails, or null if it is a valid position."""
    f = F.split(fen, r"\s+")
    at = lambda i: F.coalesce(F.get(f, F.lit(i)), F.lit(""))
    number = lambda i: F.nullif(F.regexp_extract(at(i), r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")
    rows = F.split(at(0), "/")
    ep, side = at(3), at(1)
    tests = (
        F.size(f) != 6,
        F.coalesce(number(5) <= 0, F.lit(True)),
        F.coalesce(number(4) < 0, F.lit(True)),
        ~ep.rlike(r"^(?:-|[a-h][36])$"),
        at(2).rlike(r"[^kKqQ-]"),
        ~side.rlike(r"^[wb]$"),
        F.size(rows) != 8,
        F.exists(rows, lambda r: r.rlike(r"\d\d")),
        F.exists(rows, lambda r: r.rlike(r"[^prnbqkPRNBQK0-9]")),
        F.exists(rows, lambda r: F.length(F.replace(_expanded(r), F.lit("0"), F.lit(""))) != 8),
        (ep.endswith("3") & (side == "w")) | (ep.endswith("6") & (side == "b")),
        _count(at(0), "K") != 1,
        _count(at(0), "k") != 1,
        F.concat(F.get(rows, F.lit(0)), F.coalesce(F.get(rows, F.lit(7)), F.lit(""))).rlike("[pP]"),
    )
    out = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, ERRORS))):
        out = F.when(test, name).otherwise(out)
    return F.when(fen.isNull(), ERRORS[0]).otherwise(out)


def board(fen: Column) -> Column:
    """The 64 squares from a8 to h1 as one string, empty ones as dots."""
    return F.replace(_expanded(F.substring_index(fen, " ", 1)), F.lit("/"), F.lit(""))


def ascii_board(fen: Column) -> Column:
    """Eight lines from Black's side to White's, squares apart by blanks."""
    rows = F.split(_expanded(F.substring_index(fen, " ", 1)), "/")
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.split(r, ""), " ")), "\n")


def material(fen: Column, squares: Column | None = None) -> tuple[Column, Column]:
    """``(material, balance)``: the value of all pieces, and that of the side to move less the other's; ``squares`` is ``board(fen)`` where it is at hand."""
    squares, white = board(fen) if squares is None else squares, F.get(F.split(fen, r"\s+"), F.lit(1)) == "w"
    mine = sum((_count(squares, p.upper()) * v for p, v in VALUES.items()), F.lit(0.0))
    theirs = sum((_count(squares, p) * v for p, v in VALUES.items()), F.lit(0.0))
    return F.round(mine + theirs, 6), F.round(F.when(white, mine - theirs).otherwise(theirs - mine), 6)


def end_masses(total: Column, balance: Column) -> tuple[Column, Column]:
    """Heuristic chances that the side to move resigns, and that a draw is offered, from the material."""
    resign = F.when(balance <= -9, 0.35).when(balance <= -5, 0.10).otherwise(0.0)
    return resign, F.when((total <= 8) & (F.abs(balance) <= 1), 0.15).otherwise(0.0)


def insufficient_material(fen: Column) -> Column:
    """Bare kings, one minor piece, or any number of bishops that all stand on one colour."""
    squares = board(fen)
    n = F.length(F.replace(squares, F.lit("."), F.lit("")))
    bishops, knights = _count(squares, "[bB]"), _count(squares, "[nN]")
    cells = F.transform(F.split(squares, ""), lambda c, i: F.when(c.isin("b", "B"), (i + F.floor(i / 8)) % 2))
    colours = F.array_distinct(F.filter(cells, lambda c: c.isNotNull()))
    return (n == 2) | ((n == 3) & ((bishops == 1) | (knights == 1))) | ((n == bishops + 2) & (F.size(colours) <= 1))


def square_index(square: Column) -> Column:
    """0 for a8 to 63 for h1."""
    return (F.lit(56) - F.ascii(F.substring(square, 2, 1))) * 8 + F.ascii(square) - 97


def square_colour(square: Column) -> Column:
    return F.when((F.ascii(square) + F.ascii(F.substring(square, 2, 1))) % 2 == 0, "dark").otherwise("light")
