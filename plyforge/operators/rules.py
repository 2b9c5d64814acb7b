"""The rules of chess, for operators that must follow a board: legal moves, status, SAN, replay and node counts.

A position is exchanged as FEN; the state machine runs in Arrow batches. Squares are numbered 0 (a1) to 63 (h8).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.functions.fen import fen_error
from plyforge.operators.stage1 import once
from plyforge.sources.tables import even

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"


def _name(s: int) -> str:
    return "abcdefgh"[s & 7] + str((s >> 3) + 1)


def _square(name: str) -> int:
    return ord(name[0]) - 97 + 8 * (int(name[1]) - 1)


def _rays(steps, far: bool) -> list[list[list[int]]]:
    out = []
    for s in range(64):
        lines = []
        for df, dr in steps:
            f, r, line = s & 7, s >> 3, []
            while True:
                f, r = f + df, r + dr
                if not (0 <= f < 8 and 0 <= r < 8):
                    break
                line.append(r * 8 + f)
                if not far:
                    break
            if line:
                lines.append(line)
        out.append(lines)
    return out


_STRAIGHT, _DIAGONAL = ((1, 0), (-1, 0), (0, 1), (0, -1)), ((1, 1), (1, -1), (-1, 1), (-1, -1))
_KNIGHT = tuple((a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b))
_REACH = {
    "n": _rays(_KNIGHT, False), "k": _rays(_STRAIGHT + _DIAGONAL, False), "r": _rays(_STRAIGHT, True), "b": _rays(_DIAGONAL, True), "q": _rays(_STRAIGHT + _DIAGONAL, True),
}
_PAWN_HITS = {side: _rays(((-1, d), (1, d)), False) for side, d in (("w", 1), ("b", -1))}
#: Castling rights that a move from or to a square ends.
_RIGHTS = {0: "Q", 7: "K", 4: "KQ", 56: "q", 63: "k", 60: "kq"}


_SAN = re.compile(r"([PNBRQK]?)([a-h]?)([1-8]?)([x-]?)([a-h][1-8])([qrbnQRBN]?)")


class Move(NamedTuple):
    start: int
    end: int
    promotion: str = ""
    flag: str = "n"  # n quiet, c capture, b two squares, e en passant, k and q castling; with p for promotion


class Board:
    """One position."""

    __slots__ = ("squares", "turn", "rights", "ep", "half", "full")

    def __init__(self, fen: str = START):
        place, self.turn, rights, ep, half, full = (fen.split() + ["w", "-", "-", "0", "1"][len(fen.split()) - 1 :])[:6]
        self.squares = [""] * 64
        for r, row in zip(range(7, -1, -1), place.split("/")):
            f = 0
            for c in row:
                if c.isdigit():
                    f += int(c)
                else:
                    self.squares[r * 8 + f] = c
                    f += 1
        self.rights = "" if rights == "-" else rights
        self.ep = None if ep == "-" else _square(ep)
        self.half, self.full = int(half), int(full)

    # editing; rights and the en passant square are kept only where the pieces still allow them

    @classmethod
    def empty(cls) -> Board:
        return cls("8/8/8/8/8/8/8/8 w - - 0 1")

    def get(self, square: str) -> str | None:
        return self.squares[_square(square)] or None

    def find(self, piece: str) -> list[str]:
        return [_name(s) for s, p in enumerate(self.squares) if p == piece]

    def put(self, piece: str, square: str) -> bool:
        """Whether the piece could be put there: no second king of a side, no pawn on the first or last rank."""
        if piece not in "pnbrqkPNBRQK" or (piece in "kK" and self.find(piece) not in ([], [square])) or (piece in "pP" and square[1] in "18"):
            return False
        self.squares[_square(square)] = piece
        self._settle()
        return True

    def remove(self, square: str) -> str | None:
        gone, self.squares[_square(square)] = self.get(square), ""
        self._settle()
        return gone

    def set_turn(self, turn: str) -> bool:
        """Pass the move; not while in check."""
        if turn != self.turn:
            if self.in_check():
                return False
            self.turn, self.ep = turn, None
        return True

    def set_rights(self, rights: str) -> bool:
        """Whether all the rights asked for are possible."""
        self.rights = "".join(r for r in "KQkq" if r in rights)
        self._settle()
        return set(self.rights) == set(rights)

    def _settle(self) -> None:
        home = {"K": ("K", 4, "R", 7), "Q": ("K", 4, "R", 0), "k": ("k", 60, "r", 63), "q": ("k", 60, "r", 56)}
        self.rights = "".join(r for r in self.rights if self.squares[home[r][1]] == home[r][0] and self.squares[home[r][3]] == home[r][2])
        if self.ep is not None and self.squares[self.ep + (8 if self.turn == "b" else -8)] != ("P" if self.turn == "b" else "p"):
            self.ep = None

    def _mine(self, piece: str) -> bool:
        return bool(piece) and piece.isupper() == (self.turn == "w")

    def attacked(self, s: int, by: str) -> list[int]:
        """Squares from which the side ``by`` attacks ``s``."""
        sq, out = self.squares, []
        case = str.upper if by == "w" else str.lower
        for kind, kinds in (("n", "n"), ("k", "k"), ("r", "rq"), ("b", "bq")):
            want = {case(k) for k in kinds}
            for line in _REACH[kind][s]:
                for t in line:
                    if sq[t]:
                        if sq[t] in want:
                            out.append(t)
                        break
        pawn = case("p")
        out += [t for (t,) in _PAWN_HITS["b" if by == "w" else "w"][s] if sq[t] == pawn]
        return out

    def in_check(self, side: str | None = None) -> bool:
        side = side or self.turn
        king = "K" if side == "w" else "k"
        return king in self.squares and bool(self.attacked(self.squares.index(king), "b" if side == "w" else "w"))

    def _candidates(self) -> Iterator[Move]:
        sq, white = self.squares, self.turn == "w"
        ahead, home, last = (8, 1, 7) if white else (-8, 6, 0)
        for s, piece in enumerate(sq):
            if not self._mine(piece):
                continue
            kind = piece.lower()
            if kind == "p":
                targets = []
                t = s + ahead
                if 0 <= t < 64 and not sq[t]:
                    targets.append((t, "n"))
                    if s >> 3 == home and not sq[t + ahead]:
                        yield Move(s, t + ahead, "", "b")
                for (t,) in _PAWN_HITS[self.turn][s]:
                    if sq[t] and not self._mine(sq[t]):
                        targets.append((t, "c"))
                    elif t == self.ep and not sq[t]:
                        yield Move(s, t, "", "e")
                for t, flag in targets:
                    if t >> 3 == last:
                        yield from (Move(s, t, p, flag + "p") for p in "qrbn")
                    else:
                        yield Move(s, t, "", flag)
                continue
            for line in _REACH[kind][s]:
                for t in line:
                    if sq[t]:
                        if not self._mine(sq[t]):
                            yield Move(s, t, "", "c")
                        break
                    yield Move(s, t)
        base, enemy = (0, "b") if white else (56, "w")
        for right, path, safe, to in (("K", (5, 6), (4, 5, 6), 6), ("Q", (1, 2, 3), (4, 3, 2), 2)):
            if (right if white else right.lower()) in self.rights and not any(sq[base + x] for x in path) and not any(self.attacked(base + x, enemy) for x in safe):
                yield Move(base + 4, base + to, "", right.lower())

    def after(self, m: Move) -> Board:
        """The position after a move, which is not tested."""
        b = object.__new__(Board)
        b.squares = sq = self.squares[:]
        piece = sq[m.start]
        sq[m.start], sq[m.end] = "", (m.promotion.upper() if self.turn == "w" else m.promotion) or piece
        if m.flag == "e":
            sq[m.end + (-8 if self.turn == "w" else 8)] = ""
        elif m.flag in ("k", "q"):
            rook, to = (m.end + 1, m.end - 1) if m.flag == "k" else (m.end - 2, m.end + 1)
            sq[to], sq[rook] = sq[rook], ""
        lost = _RIGHTS.get(m.start, "") + _RIGHTS.get(m.end, "")
        b.rights = "".join(c for c in self.rights if c not in lost)
        b.ep = (m.start + m.end) // 2 if m.flag == "b" else None
        b.half = 0 if piece in "pP" or "c" in m.flag else self.half + 1
        b.full = self.full + (self.turn == "b")
        b.turn = "b" if self.turn == "w" else "w"
        return b

    def movable(self) -> bool:
        """Whether there is a legal move."""
        return any(not self.after(m).in_check(self.turn) for m in self._candidates())

    def legal(self) -> list[Move]:
        return [m for m in self._candidates() if not self.after(m).in_check(self.turn)]

    def san(self, m: Move, legal: list[Move] | None = None) -> str:
        after = self.after(m)
        if m.flag in ("k", "q"):
            text = "O-O" if m.flag == "k" else "O-O-O"
        else:
            kind = self.squares[m.start].upper()
            takes = "x" if "c" in m.flag or m.flag == "e" else ""
            own = "".join(self._named(m, legal or self.legal()))
            text = ("" if kind == "P" else kind) + own + takes + _name(m.end) + (f"={m.promotion.upper()}" if m.promotion else "")
        if after.in_check():
            text += "+" if after.movable() else "#"
        return text

    def read(self, text: str, strict: bool = False) -> Move | None:
        """The legal move a SAN names; unless strict also ``0-0``, ``Pe2-e4``, ``f7f8q``, a missing ``x`` and more squares than needed.

        Only moves of the piece to the square that the text names are tested for legality; none is rendered.
        """
        bare = re.sub(r"[+#]?[?!]*$", "", text.replace("=", ""))
        if not strict:
            bare = bare.replace("0-0-0", "O-O-O").replace("0-0", "O-O")
        castle = {"O-O": "k", "O-O-O": "q"}.get(bare)
        if castle:
            return next((m for m in self._candidates() if m.flag == castle and not self.after(m).in_check(self.turn)), None)
        p = _SAN.fullmatch(bare)
        if not p:
            return None
        kind, f, r, sign, to, promotion = p.groups()
        end = _square(to)
        of = lambda kinds: [m for m in self._candidates() if m.end == end and not (strict and m.flag in "kq") and self.squares[m.start].upper() in kinds]
        legal = [m for m in of(kind or "P") if not self.after(m).in_check(self.turn)]
        named = lambda m: (not f or m.start & 7 == ord(f) - 97) and (not r or m.start >> 3 == int(r) - 1)
        found = [m for m in legal if named(m) and m.promotion == promotion.lower()]
        if found:
            takes = "c" in found[0].flag or found[0].flag == "e"
            exact = len(found) == 1 and kind != "P" and sign != "-" and takes == (sign == "x") and (promotion.isupper() or not promotion) and (f, r) == self._named(found[0], legal)
            if exact or not strict:
                return found[0] if len(found) == 1 else None
        if strict or kind or not (f and r):
            return None
        found = [m for m in of("NBRQK") if named(m) and m.promotion == promotion.lower() and not self.after(m).in_check(self.turn)]  # both squares, without a piece
        return found[0] if len(found) == 1 else None

    def _named(self, m: Move, legal: list[Move]) -> tuple[str, str]:
        """File and rank that the SAN of a move names: none, what tells it from its rivals, or for a pawn the file if it takes."""
        f, r = _name(m.start)
        if self.squares[m.start] in "pP":
            return (f if "c" in m.flag or m.flag == "e" else ""), ""
        rivals = [_name(o.start) for o in legal if o.end == m.end and o.start != m.start and self.squares[o.start] == self.squares[m.start]]
        if not rivals:
            return "", ""
        if all(o[0] != f for o in rivals):
            return f, ""
        return ("", r) if all(o[1] != r for o in rivals) else (f, r)

    def fen(self) -> str:
        rows = []
        for r in range(7, -1, -1):
            text = "".join(c or "." for c in self.squares[r * 8 : r * 8 + 8])
            rows.append(re.sub(r"\.+", lambda m: str(len(m[0])), text))
        ep = self.ep is not None and any(m.flag == "e" and not self.after(m).in_check(self.turn) for m in self._candidates())  # named only if the capture is legal
        return " ".join(["/".join(rows), self.turn, self.rights or "-", _name(self.ep) if ep else "-", str(self.half), str(self.full)])

    def key(self) -> str:
        """What makes a repeated position: all but the counters."""
        return self.fen().rsplit(" ", 2)[0]

    def hash(self) -> int:
        """64 bits of the key, signed."""
        return int.from_bytes(hashlib.blake2b(self.key().encode(), digest_size=8).digest(), "big", signed=True)

    def dead(self) -> bool:
        pieces = [(c.lower(), (i + i // 8) % 2) for i, c in enumerate(self.squares) if c]
        minor = [p for p in pieces if p[0] != "k"]
        return not minor or (len(minor) == 1 and minor[0][0] in "bn") or (all(k == "b" for k, _ in minor) and len({x for _, x in minor}) == 1)

    def status(self) -> dict[str, bool]:
        check, moves = self.in_check(), self.movable()
        out = {"check": check, "checkmate": check and not moves, "stalemate": not check and not moves, "insufficient_material": self.dead(), "fifty_moves": self.half >= 100}
        return out | {"draw": out["stalemate"] or out["insufficient_material"] or out["fifty_moves"]}

    def ascii(self) -> str:
        return "\n".join(" ".join(c or "." for c in self.squares[r * 8 : r * 8 + 8]) for r in range(7, -1, -1))


class Game:
    """A line of play: moves made and taken back, with headers and a comment per position."""

    def __init__(self, fen: str = START):
        self.boards, self.moves, self.sans = [Board(fen)], [], []
        self.headers: dict[str, str] = {} if fen == START else {"SetUp": "1", "FEN": fen}
        self.comments: dict[str, str] = {}

    @property
    def board(self) -> Board:
        return self.boards[-1]

    def apply(self, text: str, strict: bool = False) -> Move:
        m = self.board.read(text, strict)
        if m is None:
            raise ValueError(f"no legal move: {text!r}")
        self.sans.append(self.board.san(m))
        self.moves.append(m)
        self.boards.append(self.board.after(m))
        return m

    def undo(self) -> Move | None:
        """Take the last move back; comments on positions that are gone go with it."""
        if not self.moves:
            return None
        self.comments.pop(self.boards.pop().fen(), None)
        self.sans.pop()
        return self.moves.pop()

    def comment(self, text: str | None = None) -> str | None:
        """The comment on the position, after setting it if one is given: the first brace of each kind becomes a bracket."""
        if text is not None:
            self.comments[self.board.fen()] = text.replace("{", "[", 1).replace("}", "]", 1)
        return self.comments.get(self.board.fen())

    def repeated(self) -> int:
        """How often the game has had this position."""
        return sum(b.key() == self.board.key() for b in self.boards)

    def status(self) -> dict[str, bool]:
        out = self.board.status() | {"threefold": self.repeated() >= 3}
        return out | {"draw": out["draw"] or out["threefold"], "over": out["checkmate"] or out["draw"] or out["threefold"]}


_MOVE_SCHEMA = "key {kind}, fen string, san string, lan string, from_square string, to_square string, piece string, captured string, promotion string, flags string, after string"
_PIECE = {"e": "p"}


def _move_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, fen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b = Board(fen)
            legal = b.legal()
            for m in legal:
                a, z = _name(m.start), _name(m.end)
                taken = b.squares[m.end].lower() or ("p" if m.flag == "e" else None)
                rows.append((key, fen, b.san(m, legal), a + z + m.promotion, a, z, b.squares[m.start].lower(), taken, m.promotion or None, m.flag, b.after(m).fen()))
        names = ["key", "fen", "san", "lan", "from_square", "to_square", "piece", "captured", "promotion", "flags", "after"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 11, [batch.schema.field(0).type] + [pa.string()] * 10)], names)


_RANK = " pnbrq"


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["fen", "san", "to", "captured", "promotion", "check", "mate", "hanging"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
    for batch in batches:
        rows = []
        for fen in batch.column(0).to_pylist():
            b = Board(fen)
            legal = b.legal()
            for m in legal:
                after = b.after(m)
                check, movable = after.in_check(), after.movable()
                taken = [after.squares[r.end].lower() or "p" for r in after.legal() if "c" in r.flag or r.flag == "e"] if movable else []
                rows.append((fen, b.san(m, legal), m.end, b.squares[m.end].lower() or ("p" if m.flag == "e" else None), m.promotion or None, check, check and not movable, max(taken, key=_RANK.find, default=None)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names)


def move_features(positions: DataFrame) -> DataFrame:
    """``fen, san, to, captured, promotion, check, mate, hanging``: every legal move of every position, and the best piece that a reply to it takes."""
    return even(positions.select("fen")).mapInArrow(_feature_rows, "fen string, san string, to int, captured string, promotion string, check boolean, mate boolean, hanging string")


def valid(df: DataFrame, fen: str = "fen") -> DataFrame:
    """The rows with a valid position. The test stays where it is: pushed below a ``distinct`` it would be made for every repetition."""
    return once(df, _error=fen_error(F.col(fen))).where("_error IS NULL").drop("_error")


def legal_moves(df: DataFrame, key: str = "id", fen: str = "fen") -> DataFrame:
    """One row per legal move of every valid position."""
    rows = valid(df, fen).select(F.col(key).alias("key"), F.col(fen).alias("fen"))
    return even(rows).mapInArrow(_move_rows, _MOVE_SCHEMA.format(kind=rows.schema["key"].dataType.simpleString())).withColumnRenamed("key", key)


def _statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["check", "checkmate", "stalemate", "insufficient_material", "fifty_moves", "draw"]
    for batch in batches:
        found = [Board(f).status() for f in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([s[n] for s in found], pa.bool_()) for n in names)], ["key", *names])


def status(df: DataFrame, key: str = "id", fen: str = "fen") -> DataFrame:
    """Check, mate, stalemate and draws of every valid position."""
    rows = valid(df, fen).select(F.col(key).alias("key"), F.col(fen).alias("fen"))
    kind = rows.schema["key"].dataType.simpleString()
    return even(rows).mapInArrow(_statuses, f"key {kind}, check boolean, checkmate boolean, stalemate boolean, insufficient_material boolean, fifty_moves boolean, draw boolean").withColumnRenamed("key", key)


def _followed(sans: list[str] | None) -> Iterator[tuple[int, str, Board, int]]:
    """Ply, SAN, position after it and how often that has been there, up to the first move that is not legal; ply 0 is the start."""
    b = Board()
    seen = {b.key(): 1}
    yield 0, "", b, 1
    for i, san in enumerate(sans or [], 1):
        m = b.read(san)
        if m is None:
            return
        b = b.after(m)
        k = b.key()
        seen[k] = seen.get(k, 0) + 1
        yield i, san, b, seen[k]


def _replays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, sans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            legal = most = 0
            for legal, _, b, times in _followed(sans):  # noqa: B007
                most = max(most, times)
            rows.append((key, len(sans or []), legal, b.fen(), most))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.int32()])], ["key", "n_moves", "n_legal", "last_fen", "most_repeated"])


def _ply_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "ply", "san", "fen", "half_moves", "times", "position_hash"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
    for batch in batches:
        rows = [(key, i, san, b.fen(), b.half, times, b.hash()) for key, sans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, san, b, times in _followed(sans) if i]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, [batch.schema.field(0).type, *kinds])], names)


def replay_plies(df: DataFrame, key: str, sans: str) -> DataFrame:
    """One row per legal ply: the position after it, its half-move clock, how often the game has had it, and what these decide: ``threefold`` and ``fifty_moves``; ``position_hash`` is 64 bits of the position without its counters."""
    rows = df.select(F.col(key).alias("key"), F.col(sans).alias("sans"))
    out = even(rows).mapInArrow(_ply_rows, f"key {rows.schema['key'].dataType.simpleString()}, ply int, san string, fen string, half_moves int, times int, position_hash long")
    return out.withColumns({"threefold": F.col("times") >= 3, "fifty_moves": F.col("half_moves") >= 100}).withColumnRenamed("key", key)


def replay(df: DataFrame, key: str, sans: str) -> DataFrame:
    """Follow each game on a board: how many of its moves are legal before the first that is not, the last position, and how often one came back."""
    rows = df.select(F.col(key).alias("key"), F.col(sans).alias("sans"))
    return even(rows).mapInArrow(_replays, f"key {rows.schema['key'].dataType.simpleString()}, n_moves int, n_legal int, last_fen string, most_repeated int").withColumnRenamed("key", key)


def position_after(df: DataFrame, key: str, sans: str, ply: int) -> DataFrame:
    """The position of each game after its first ``ply`` moves, or after the last legal one before."""
    return replay(df.withColumn(sans, F.slice(sans, 1, ply)), key, sans).select(key, F.col("n_legal").alias("ply"), F.col("last_fen").alias("fen"))


def move_kinds(moves: DataFrame) -> DataFrame:
    """Moves with one boolean per kind."""
    has = lambda f: F.contains("flags", F.lit(f))
    return moves.withColumns({"is_capture": has("c") | has("e"), "is_promotion": has("p"), "is_en_passant": has("e"), "is_short_castle": has("k"), "is_long_castle": has("q"), "is_double_step": has("b")})


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[bool]] = [[], [], [], []]
        at, b = None, None
        for fen, san, lan, piece in zip(*(c.to_pylist() for c in batch.columns)):
            if fen != at:
                at, b = fen, Board(fen)
            start, end, promotion = lan[:2], lan[2:4], lan[4:]
            kind = "" if piece == "p" else piece.upper()
            for k, text in enumerate((san, lan, f"{kind}{start}-{end}{promotion}", san if san.startswith("O-O") else f"{kind or 'P'}{start}{'x' if 'x' in san else ''}{end}{'=' + promotion.upper() if promotion else ''}")):
                m = b.read(text)
                out[k].append(m is not None and _name(m.start) + _name(m.end) + m.promotion == lan)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.bool_()) for o in out], ["san", "squares", "dashed", "full"])


def read_back(moves: DataFrame) -> DataFrame:
    """Per legal move, whether its SAN, its squares, its squares with a dash, and its squares with the piece are read as that move."""
    return moves.select("fen", "san", "lan", "piece").mapInArrow(_read_rows, "san boolean, squares boolean, dashed boolean, full boolean")


def _successors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        root, fens, n = [], [], []
        for r, f, k in zip(*(c.to_pylist() for c in batch.columns)):
            b = Board(f)
            after = [b.after(m).fen() for m in b.legal()]
            root += [r] * len(after)
            fens += after
            n += [k] * len(after)
        yield pa.RecordBatch.from_arrays([pa.array(root, pa.string()), pa.array(fens, pa.string()), pa.array(n, pa.int64())], ["root", "fen", "n"])


def perft(positions: DataFrame, depth: int, fen: str = "fen") -> DataFrame:
    """``root, depth, nodes``: move sequences of every length up to ``depth``. Equal positions are merged with their counts between the steps."""
    at = positions.select(F.col(fen).alias("root"), F.col(fen).alias("fen"), F.lit(1).cast("long").alias("n"))
    out = None
    for d in range(1, depth + 1):
        at = even(at).mapInArrow(_successors, "root string, fen string, n long").groupBy("root", "fen").agg(F.sum("n").alias("n"))
        row = at.groupBy("root").agg(F.sum("n").alias("nodes")).select("root", F.lit(d).alias("depth"), "nodes")
        out = row if out is None else out.unionByName(row)
    return out
