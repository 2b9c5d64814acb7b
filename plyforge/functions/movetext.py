"""Annotated movetext: lexing, evaluations, glyphs, SAN and its tokens, all as native column expressions.

A game's text is read with two passes of one regular expression: each match is a move and all that follows it up to the next
move. That gives the moves and their comments as two parallel arrays, in one narrow stage: no explode, no shuffle, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the notation.
RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
BAD_GLYPHS = ("??", "?!", "?")
GOOD_GLYPHS = ("!!", "!?", "!")
LEXEME = r"\{[^}]*\}|\d+\.(?:\.\.)?|\$\d+|[^\s{}]+"
EVAL = r"\[%eval\s+(#?-?\d+(?:\.\d+)?)\]"
SAN = r"^(?:O-O-O|O-O|[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|[a-h]x[a-h][1-8]|[a-h][1-8])(?:=[QRBN])?[+#]?$"
LOOSE_SAN = r"^(?:[KQRBN]?[a-h]?[1-8]?x?[a-h][1-8](?:=[QRBN])?|O-O(?:-O)?)[+#]?$"
MATE, CLAMP, START_CP, NO_EVAL = 30_000, 10_000, 15, 30_001
SLOPE = 0.00368208

_SKIP = r"(?:\{[^}]*\}|\d+\.(?:\.\.)?|\$\d+|(?:1-0|0-1|1/2-1/2|\*)(?![^\s{}])|[\s{}])*+"
_MOVE = rf"{_SKIP}([^\s{{}}]+)({_SKIP})"


def lexemes(movetext: Column) -> Column:
    """Comments, move numbers, numeric glyphs and words of a movetext, in order."""
    return F.coalesce(F.regexp_extract_all(movetext, F.lit(LEXEME), F.lit(0)), F.array().cast("array<string>"))


def movetext_result(movetext: Column) -> Column:
    """The last result word of the text, or null."""
    found = F.filter(lexemes(movetext), lambda t: t.isin(*RESULTS))
    return F.try_element_at(found, F.lit(-1))


def split_glyph(word: Column) -> tuple[Column, Column]:
    """``(san, glyph)``: one glyph is cut off the end, tried in the order ``?? ?! ? !! !? !``; so ``e4!?`` becomes ``e4!`` and ``?``."""
    glyph, san = F.lit(None).cast("string"), word
    for g in reversed(BAD_GLYPHS + GOOD_GLYPHS):
        hit = word.endswith(F.lit(g))
        glyph = F.when(hit, F.lit(g)).otherwise(glyph)
        san = F.when(hit, F.left(word, F.length(word) - len(g))).otherwise(san)
    return san, glyph


def eval_to_cp(text: Column) -> Column:
    """Centipawns of an evaluation as White sees it: ``0.17`` is 17 (half to even), ``#4`` 29996, ``#-3`` -29997. Null if it is none."""
    n = F.substring(text, 2, 20).try_cast("int")
    mate = F.when(n >= 0, MATE - n).otherwise(-MATE - n)
    return F.when(text.startswith("#"), mate).otherwise(F.rint(text.try_cast("double") * 100).cast("int")).cast("int")


def win_pct(cp: Column) -> Column:
    """Winning chances of White in per cent."""
    c = F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), cp))
    return 50 + 50 * (2 / (1 + F.exp(-SLOPE * c)) - 1)


def classify(before: Column, after: Column, white: Column) -> Column:
    """Label of a move by the mover's loss of winning chances: 10 ``?!``, 20 ``?``, 30 ``??``."""
    loss = win_pct(before) - win_pct(after)
    return label_of_loss(F.when(white, loss).otherwise(-loss))


def label_of_loss(loss: Column) -> Column:
    return F.when(loss >= 30, "??").when(loss >= 20, "?").when(loss >= 10, "?!")


def words_and_rests(movetext: Column) -> tuple[Column, Column]:
    """Two parallel arrays: the move words, and the text after each of them up to the next."""
    word, rest = (F.regexp_extract_all(movetext, F.lit(_MOVE), F.lit(k)) for k in (1, 2))
    none = F.array().cast("array<string>")
    return F.coalesce(word, none), F.coalesce(rest, none)


def last_eval(rest: Column) -> Column:
    """The evaluation in the text after a move: of the last comment that has one its first; empty if none has."""
    return F.regexp_extract(rest, rf"(?s)^.*\{{[^}}]*?{EVAL}[^}}]*\}}", 1)


def known_before(cps: Column, i: Column) -> Column:
    """The last known evaluation strictly before ply ``i``; only where the one just before is missing is the array searched."""
    earlier = F.filter(F.slice(cps, F.lit(1), i), lambda c: c.isNotNull())
    return F.coalesce(F.when(i > 0, F.get(cps, i - 1)), F.when(i > 0, F.try_element_at(earlier, F.lit(-1))), F.lit(START_CP))


def san_tokens(san: Column, label: Column, bracketed: bool = True) -> Column:
    """Tokens of a SAN move: label, check or mate, capture, promotion, then the move itself. Null if it is no SAN."""
    check = F.nullif(F.regexp_extract(san, r"([+#])$", 1), F.lit(""))
    promotion = F.nullif(F.regexp_extract(san, r"(=[QRBN])[+#]?$", 1), F.lit(""))
    base = F.regexp_replace(san, r"(?:=[QRBN])?[+#]?$", "")
    capture = F.when(F.contains(base, F.lit("x")), "x")
    parts = [label, check, capture, promotion, F.replace(base, F.lit("x"), F.lit(""))]
    if bracketed:
        parts = [F.concat(F.lit("["), p, F.lit("]")) for p in parts]
    return F.when(san.rlike(SAN), F.array_compact(F.array(*parts)))


def loose_tokens(san: Column) -> Column:
    """Bare tokens of a move in the loose notation, which lets any piece or pawn name its origin and a capture stand without one; null if it is none."""
    pattern = r"^([KQRBN]?[a-h]?[1-8]?)(x?)([a-h][1-8])(=[QRBN])?([+#])?$"
    part = lambda k: F.nullif(F.regexp_extract(san, pattern, k), F.lit(""))
    plain = F.array_compact(F.array(part(5), part(2), part(4), F.concat(F.regexp_extract(san, pattern, 1), part(3))))
    castle = F.array_compact(F.array(F.nullif(F.regexp_extract(san, r"([+#])$", 1), F.lit("")), F.regexp_replace(san, r"[+#]$", "")))
    return F.when(~san.rlike(LOOSE_SAN), None).when(san.startswith("O-O"), castle).otherwise(plain)


def tokens_to_san(tokens: Column) -> Column:
    """The SAN move of bare tokens, without a label; null without a move among them."""
    pick = lambda test: F.try_element_at(F.filter(tokens, test), F.lit(-1))
    suffix = F.coalesce(pick(lambda t: t.isin("+", "#")), F.lit(""))
    capture = F.coalesce(pick(lambda t: t == "x"), F.lit(""))
    promotion = F.coalesce(pick(lambda t: t.startswith("=")), F.lit(""))
    core = pick(lambda t: ~t.isin("+", "#", "x") & ~t.startswith("="))
    square = F.right(core, F.lit(2))
    return F.when(core.startswith("O-O"), F.concat(core, suffix)).otherwise(F.concat(F.left(core, F.length(core) - 2), capture, square, promotion, suffix))


def year_month(date: Column) -> Column:
    """``YYYY-MM`` of a date text; empty for null."""
    return F.replace(F.substring(F.coalesce(date, F.lit("")), 1, 7), F.lit("."), F.lit("-"))
