"""PGN text: reading games from files of any size, and writing them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = r'\[\s*([A-Za-z]+)\s+"((?:[^"\\]|\\.)*)"\s*\]'
_PART = re.compile(r"(?P<open>\()|(?P<close>\))|\{(?P<comment>[^}]*)\}|;(?P<line>[^\n]*)|(?P<nag>\$\d+)|(?P<number>\d+\s?\.+)|(?P<result>1-0|0-1|1/2-1/2|\*)(?=\s|$)|(?P<move>[^\s(){};]+)")


def main_line(text: str) -> tuple[list[str], list[str | None], list[str | None], int, str | None, str | None]:
    """``(moves, comments, nags, n_variations, result, error)`` of the main line.

    Variations are counted and left out; numeric glyphs and ``!?`` signs of a move are its ``nags``; a comment before the first move is dropped.
    ``error`` names what a strict reader would not accept: unbalanced brackets, or text after the result.
    """
    moves: list[str] = []
    comments: list[str | None] = []
    nags: list[str | None] = []
    result, error, depth, variations = None, None, 0, 0
    for m in _PART.finditer(text):
        kind = m.lastgroup
        if kind == "open":
            depth += 1
            variations += 1
        elif kind == "close":
            if not depth:
                error = error or "a closing bracket without an opening one"
            depth = max(0, depth - 1)
        elif depth:
            continue
        elif result is not None and kind in ("move", "number"):
            error = error or "moves after the result"
        elif kind == "result":
            result = m[0]
        elif kind == "move":
            bare = re.sub(r"[!?]{1,2}$", "", m[0])
            moves.append(bare)
            comments.append(None)
            nags.append(m[0][len(bare) :] or None)
        elif kind == "nag" and moves:
            nags[-1] = f"{nags[-1]} {m[0]}" if nags[-1] else m[0]
        elif kind in ("comment", "line") and moves and comments[-1] is None:
            comments[-1] = re.sub(r"[\r\n]+", " ", m[kind]).strip() if kind == "line" else re.sub(r"[\r\n]+", " ", m[kind])
    if depth:
        error = error or "an opening bracket without a closing one"
    if text.count("{") != text.count("}"):
        error = error or "a comment that does not end"
    return moves, comments, nags, variations, result, error


_LISTS = pa.list_(pa.string())


def _parse(strict: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_line(t or "") for t in batch.column(1).to_pylist()]
            if strict and (bad := next((r[5] for r in rows if r[5]), None)):
                raise ValueError(f"PGN: {bad}")
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((_LISTS, _LISTS, _LISTS, pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["headers", "moves", "comments", "nags", "n_variations", "result", "error"])

    return run


def parse_pgn(df: DataFrame, column: str = "value", strict: bool = False) -> DataFrame:
    """``headers`` (map), ``moves``, ``comments``, ``nags``, ``n_variations``, ``result``, ``error`` of one game per row; ``strict`` raises the first error."""
    text = F.col(column)
    names, values = (F.regexp_extract_all(text, F.lit(TAG), F.lit(k)) for k in (1, 2))
    values = F.transform(values, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
    headers = F.map_from_entries(F.array_distinct(F.arrays_zip(names, values)))
    body = F.regexp_replace(text, rf"(?m)^\s*{TAG}\s*$", "")
    rows = df.select(headers.alias("headers"), body.alias("body")).where(F.length(F.trim("body")) > 0)
    made = "moves array<string>, comments array<string>, nags array<string>, n_variations int, result string, error string"
    return rows.mapInArrow(_parse(strict), f"headers map<string,string>, {made}")


def read_pgn(spark: SparkSession, path: str, strict: bool = False, first: str = "Event") -> DataFrame:
    """Games of PGN files. The tag ``first``, with which every game begins, is the record separator, so that a file is read in splits."""
    records = spark.read.option("lineSep", f"[{first} ").text(path).where(F.length(F.trim("value")) > 0)
    return parse_pgn(records.select(F.concat(F.lit(f"[{first} "), "value").alias("value")), strict=strict)


def _first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.left(text, at - 1), F.lit(new), F.substring(text, at + 1, F.length(text)))).otherwise(text)


def bracketed_comment(text: Column) -> Column:
    """A comment as it is kept on a position: the first brace of each kind becomes a bracket."""
    return _first(_first(text, "{", "["), "}", "]")


def safe_comment(text: Column) -> Column:
    """A comment as it is written: all braces become brackets, as any of them would end it."""
    return F.translate(text, "{}", "[]")


def movetext(sans: Column, result: Column, comments: Column | None = None, nags: Column | None = None) -> Column:
    """``1. e4 e5 2. Nf3 … 1-0`` of an array of moves. With ``comments`` and ``nags`` (arrays of the moves' length, null for none) each move is followed by its own; after a comment Black's move is numbered again (``1... e5``)."""

    def at(i: Column, values: Column | None, form) -> Column:
        return F.lit("") if values is None else F.coalesce(form(F.get(values, i)), F.lit(""))

    def move(s: Column, i: Column) -> Column:
        number = (F.floor(i / 2).cast("int") + 1).cast("string")
        noted = F.lit(False) if comments is None else F.coalesce(F.get(comments, i - 1).isNotNull() & (i > 0), F.lit(False))
        before = F.when(i % 2 == 0, F.concat(number, F.lit(". "))).when(noted, F.concat(number, F.lit("... "))).otherwise("")
        after = at(i, nags, lambda v: F.when(v.rlike(r"^[!?]"), v).otherwise(F.concat(F.lit(" "), v)))
        return F.concat(before, s, after, at(i, comments, lambda v: F.concat(F.lit(" {"), safe_comment(v), F.lit("}"))))

    return F.concat_ws(" ", F.array_join(F.transform(sans, move), " "), F.coalesce(result, F.lit("*")))


def wrapped(text: Column, width: int) -> Column:
    """Words joined into lines of at most ``width`` characters."""
    return F.trim(F.regexp_replace(text, rf"(\S(?:.{{0,{width - 2}}}\S)?)(?:\s+|$)", "$1\n"))


def to_pgn(headers: Column, sans: Column, result: Column, width: int = 0, newline: str = "\n", comments: Column | None = None, nags: Column | None = None) -> Column:
    """PGN text of a game; null headers are left out, quotes in values are escaped, lines end with ``newline``."""
    kept = F.map_entries(F.map_filter(headers, lambda k, v: v.isNotNull()))
    tags = F.array_join(F.transform(kept, lambda e: F.concat(F.lit("["), e["key"], F.lit(' "'), F.regexp_replace(e["value"], r'(["\\])', r"\\$1"), F.lit('"]'))), "\n")
    body = movetext(sans, result, comments, nags)
    text = F.concat_ws("\n\n", F.nullif(tags, F.lit("")), wrapped(body, width) if width else body)
    return text if newline == "\n" else F.replace(text, F.lit("\n"), F.lit(newline))
