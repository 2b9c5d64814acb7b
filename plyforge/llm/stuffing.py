"""Keyword-stuffed and link-list posts (problem 7).

Method: an n-gram model over function words and word classes, trained on the collection's own prose, scores the class sequence
of each post; posts that are for the most part of abnormally high perplexity (word piles, lists of links, tags or products) or of
abnormally low perplexity (one pattern over and over) are flagged. The perplexity alone decides.

1. *Own text*: quotes (line prefixes, nested and unclosed blocks) and the signature (from a delimiter to the end, if no empty
   line comes between) are set aside, markup and entities resolved, mis-decoded letters mended.
2. *Items*: words, links, hash tags, percentages, numbers, codes (letters with digits), punctuation and ends of lines. A word's
   class is its length (four steps), whether it is capitalised, and how many words back the post last had it (five steps). Moves, results, rows of
   tables and a word said again at once ("no no no") are left out. No list of words is used, so no language is preferred.
3. *Prose* is every segment that ends like a sentence, has five words or more, next to no links, tags and codes, and at most a quarter of words
   of four letters or more that came shortly before.
4. *Function words* are learnt: the ``N_FUNCTION`` words of at most five letters that the most posts have in their prose.
5. *Training*: unigram, bigram and trigram counts over all prose, twice: with function words as themselves, and with every word
   as its class. The second serves posts most of whose short words are none of the function words: languages of few posts.
   Trigrams are counted exactly; there are at most ``SIZE**3`` of them, whatever the input.
6. *Scoring*: the mean surprisal of an item and its ``REACH`` neighbours on each side, in standard deviations from the mean of
   the collection's prose; both follow from the counts. An item is abnormal above ``HIGH`` or below ``LOW``; a post is, if most of its items are, a link counting as
   three. The scale comes from the data at every size; the thresholds are in its units.

Defined results: null, empty and deleted posts, and those with fewer than ``least`` items of own text, are never flagged;
repeated rows are flagged alike; an empty table gives no rows; very long posts are scored whole; other columns are never read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plyforge.sources.tables import materialize

LEAST = 8
#: Function words learnt, at most; the share of the posts with prose, and the number of posts, that must have one.
N_FUNCTION, FUNCTION_SHARE, FUNCTION_POSTS = 176, 0.002, 5
REACH = 12
#: Share of the even distribution in the model: no single item is more surprising than its bits.
FLOOR = 0.1
#: Bits an item of prose, and their deviation, at least: a collection of a few set phrases is measured on the scale of ordinary prose.
LEAST_BITS, LEAST_DEVIATION = 2.0, 2.0
#: Standard deviations from the prose of the collection.
HIGH, LOW = 4.0, -3.0
LINK_WEIGHT = 3
#: Chunks of text that a task remembers before it starts anew; results do not depend on it.
MOST_CHUNKS = 300_000

_LINKED = re.compile(r"\[url=?[^\]]*\][^\[]*(?:\[/url\]?)?|<a\s[^>]*>[^<]*(?:</a>)?", re.IGNORECASE)
_MARKUP = re.compile(r"\[img[^\]\n]*\][^\[\n]*\[/img\]|<[^>\n]{0,200}>|\[/?[a-zA-Z*][^\]\n]{0,60}\]|(?<![\w:]):[a-z]+\d*:(?!\w)", re.IGNORECASE)
_MOVE = r"(?<![\w-])(?:\d+\.(?:\.\.)?)?(?:[KQRBN][a-h]?[1-8]?x?[a-h][1-8]|(?:[a-h]x)?[a-h][1-8](?:=[QRBN])?|O-O(?:-O)?)[+#]?[!?]*(?![\w-])"
_ITEM = re.compile(
    r"(?P<link>\ue000|(?:https?://|www\.)[^\s<\]\[]+)|(?P<tag>#\w+)|(?P<result>(?<![\w-])(?:1-0|0-1|1/2-1/2|½-½)(?![\w-]))"
    rf"|(?P<move>{_MOVE})|(?P<count>(?<![\w.,])\d+\.+$)|(?P<spelled>(?<!\w)\w(?:\.\w){{3,}}(?!\w))|(?P<pct>[-+]?\d+(?:[.,]\d+)?%)|(?P<number>\d+(?:[.,:]\d+)*(?!\w))|(?P<code>\w*\d\w*)"
    r"|(?P<word>[^\W\d_]+(?:-[^\W\d_]+)*)|(?P<end>[.!?…。！？]+)|(?P<line>\n)|(?P<point>[^\w\s])",
    re.IGNORECASE,
)
_BREAK = re.compile(r"<br\s*/?>|</?p>|</?div[^>]*>|</?li>", re.IGNORECASE)
_FENCE = re.compile(r"\[(?P<close1>/?)quote(?P<arg>[^\]\n]*)\]|<(?P<close2>/?)blockquote[^>\n]*>", re.IGNORECASE)
_SIGNATURE = re.compile(r"(?:^|\n)[^\S\n]*(?:(?:\[i\][^\n\[]*\[/i\]\n)?(?:--+|__+|~~+|==+)[^\S\n]*(?=\n|$)|<hr[^>\n]*>|Sent from my\b)", re.IGNORECASE)
_ADDED = re.compile(r"<br\s*/?>|</?p>|<!--[^>]*-->", re.IGNORECASE)
_UNSEEN = re.compile("[\r\u00ad\u200b-\u200f\u2060\ufeff]")
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")
_QUOTED = re.compile(r"\s*(?:<(?:p|div|span)[^>]*>\s*)*>")
_WROTE = re.compile(r"\bwrote\s*:\s*$")
#: First letters of scripts written without spaces between words.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u3400-\u9fff\uf900-\ufaff]")


def _without_blocks(text: str) -> str:
    """Drop quote blocks. A closing mark ends the innermost open block of its kind and all inside it; a block never closed ends at the next empty line, else with the last closing mark in it."""
    out, at, stack, opened = [], 0, [], 0
    for m in _FENCE.finditer(text):
        kind = "b" if m[0][0] == "<" else "q"
        closing = bool(m["close1"] or m["close2"])
        if not closing:
            if not stack:
                out.append(text[at : m.start()])
                opened = m.end()
            stack.append(kind)
        elif kind in stack:
            while stack.pop() != kind:
                pass
            at = m.end()
        else:
            if not stack:
                out.append(text[at : m.start()])
            at = m.end()
    if not stack:
        out.append(text[at:])
    else:
        gap = text.find("\n\n", max(opened, at))
        if gap >= 0:
            out.append(text[gap:])
        elif at > opened:
            out.append(text[at:])
    return "\n".join(out)


def _mended(m: re.Match) -> str:
    try:
        return m[0].encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return m[0]


def _without_notes(text: str) -> str:
    """Drop what a board adds to the end of a post."""
    while True:
        text = text.strip()
        tag = text.rfind("<") if text.endswith(">") else -1
        line = text.rfind("\n") + 1
        if tag >= 0 and _ADDED.fullmatch(text, tag):
            text = text[:tag]
        elif text[line : line + 14].lower() == "last edited by":
            text = text[:line]
        else:
            return text


def own_text(text: str) -> str:
    """The post without quotes of other posts and without its signature."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = _MISREAD.sub(_mended, _UNSEEN.sub("", text))
    elif "\r" in text:
        text = text.replace("\r", "")
    if ">" in text:
        kept, quoted = [], False
        for line in text.split("\n"):
            if ">" in line and _QUOTED.match(line):
                if not quoted and kept and _WROTE.search(kept[-1]):
                    kept.pop()
                quoted = True
                ends = [m for m in _FENCE.finditer(line) if m["close1"] or m["close2"]]
                if ends:  # the block around the quoted lines ends here, and own text may follow
                    kept.append(line[ends[0].start() :])
            else:
                quoted = False
                kept.append(line)
        text = "\n".join(kept)
    if "[" in text or "<" in text:
        text = _BREAK.sub("\n", _without_blocks(text))
        text = "\n".join(line for line in text.split("\n") if ">" not in line or not _QUOTED.match(line))
    text = _without_notes(text)
    for m in _SIGNATURE.finditer(text):
        if "\n\n" not in text[m.end() :].strip():
            return text[: m.start()].strip()
    return text


# Item classes. Words have one of 40: length, capital, and how far back the post had the word before.
_LENGTHS, _BACK = np.array([4, 7, 10]), np.array([5, 17, 65])
_OTHERS = ("Link", "Tag", "Pct", "Number", "Code", "Point", ",", ";", ":", "End", "Line", "Result", "Move", "Row")
_WORDS = 1 + len(_OTHERS)
_ID = {x: i + 1 for i, x in enumerate(_OTHERS)}
_FUNCTION = _WORDS + 40
SIZE = _FUNCTION + N_FUNCTION  # 0 is the start of a segment
assert SIZE <= 256 and _FUNCTION <= 64
_NAMED = {"link": "Link", "tag": "Tag", "result": "Result", "move": "Move", "count": "Move", "spelled": "Code", "pct": "Pct", "number": "Number", "code": "Code", "end": "End", "line": "Line"}


class _Chunks(dict):
    """Text between blanks -> its number; the items of all chunks lie one after the other: classes (for words: length and capital, as at first sight) and hashes of the words."""

    def __init__(self):
        self.start, self.kinds, self.words = [0], [], []

    def __missing__(self, chunk: str) -> int:
        for m in _ITEM.finditer(chunk):
            kind = m.lastgroup
            if kind != "word":
                self.kinds.append(_ID[_NAMED.get(kind) or (m[0] if m[0] in _ID else "Point")])
                self.words.append(0)
                continue
            word = m[0]
            low = word.lower()
            if _UNSPACED.match(word):  # no evidence from lengths: pieces of two letters, short and long in turn
                for k in range(0, len(word), 2):
                    self.kinds.append(_WORDS + (k // 2 % 2) * 10)
                    self.words.append(_hash(low[k : k + 2]))
            else:
                self.kinds.append(_WORDS + int(np.searchsorted(_LENGTHS, len(word), "right")) * 10 + word[0].isupper() * 5)
                self.words.append(_hash(low))
        self.start.append(len(self.kinds))
        number = self[chunk] = len(self.start) - 2
        return number

    def items(self, numbers: list[int], post: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes and word hashes of a row of chunks, and how many items each of the ``n`` posts has."""
        number, start = np.array(numbers, np.int64), np.array(self.start, np.int64)
        size = start[number + 1] - start[number]
        at = np.repeat(start[number] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return np.array(self.kinds, np.int64)[at], np.array(self.words, np.int64)[at], np.bincount(post, size, n).astype(np.int64)


def _hash(word: str) -> int:
    """Signed 64 bits, the lowest three for the length (at most 7); never 0."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) & 0x7FFFFFFFFFFFFFF8
    return h | min(len(word), 7)


def chunks(text: str | None) -> list[str]:
    """A post's own text between blanks; ends of lines stand alone, links are one sign."""
    if not text:
        return []
    text = own_text(text)
    if "[" in text or "<" in text or ":" in text:
        text = _MARKUP.sub(" ", _LINKED.sub(" \ue000 ", text))
    return text.replace("\n", " \n ").split(" ")


def _flags(*names: str) -> np.ndarray:
    out = np.zeros(SIZE, bool)
    out[[_ID[n] for n in names]] = True
    return out


_IS_WORD = np.arange(SIZE) >= _WORDS
_OTHER = _flags("Link", "Tag", "Pct", "Code")
_PLAIN = _flags("Number", "Result", "Move", "Point")
_BREAKS = _flags("End", "Line")
_SKIPPED = _flags("Move", "Result")


def _segments(kind: np.ndarray, post: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment ends after an end of a sentence or line: the start of each, the segment of each item, the size of each."""
    first = np.r_[True, _BREAKS[kind[:-1]] | (post[1:] != post[:-1])][: len(kind)]
    start = np.flatnonzero(first)
    return start, np.cumsum(first) - 1, np.diff(np.r_[start, len(kind)])


def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x.astype(np.float64), start) if len(start) else np.zeros(0)


def _prepared(kinds: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with the distance of repeats, word hashes and new sizes; moves, results, rows of tables, echoes and empty segments are gone."""
    post = np.repeat(np.arange(len(sizes)), sizes)

    def keep(mask: np.ndarray) -> None:
        nonlocal kinds, words, post
        kinds, words, post = kinds[mask], words[mask], post[mask]

    start, segment, size = _segments(kinds, post)
    plain = _sums(_PLAIN[kinds], start)
    row = ((plain >= 4) & (plain * 3 >= size * 2))[segment] if len(kinds) else np.zeros(0, bool)
    keep(~row & ~_SKIPPED[kinds])
    if len(kinds):  # a word said again at once
        keep(~np.r_[False, (words[1:] == words[:-1]) & (words[1:] != 0) & (post[1:] == post[:-1])])
    start, segment, _ = _segments(kinds, post)
    keep((_sums(~_BREAKS[kinds], start) > 0)[segment] if len(kinds) else np.zeros(0, bool))
    at = np.flatnonzero(words)
    place = np.arange(len(at))
    order = np.lexsort((place, words[at], post[at]))
    again = np.r_[False, (words[at][order][1:] == words[at][order][:-1]) & (post[at][order][1:] == post[at][order][:-1])][: len(at)]
    gap = np.diff(place[order], prepend=0)
    back = np.zeros(len(at), np.int64)
    back[order] = np.where(again, 4 - np.searchsorted(_BACK, gap, "right"), 0)  # 0 new, 1 far back ... 4 near
    kinds = kinds.copy()
    kinds[at] += back
    return kinds, words, np.bincount(post, minlength=len(sizes))


_SEEN = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))
_ITEMS = ["key", "kinds", "words", "seen"]


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per post; and after each batch a row without key that has, in ``seen``, the short words of its prose and in how many of its posts they are."""
    known = _Chunks()
    for batch in batches:
        if len(known) > MOST_CHUNKS:
            known = _Chunks()
        numbers: list[int] = []
        sizes: list[int] = []
        for text in batch.column(1).to_pylist():
            found = chunks(text)
            numbers += map(known.__getitem__, found)
            sizes.append(len(found))
        k, w, n = _prepared(*known.items(numbers, np.repeat(np.arange(len(sizes)), sizes), len(sizes)))
        offsets = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(k.astype(np.int16))), pa.ListArray.from_arrays(offsets, pa.array(w))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.nulls(batch.num_rows, _SEEN)], _ITEMS)
        word, posts = _function_counts(_Posts(pa.RecordBatch.from_arrays(lists, _ITEMS[1:3]), 0))
        seen = pa.ListArray.from_arrays(pa.array([0, len(word)], pa.int32()), pa.StructArray.from_arrays([pa.array(word), pa.array(posts)], names=["word", "n"])).cast(_SEEN)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(0).type), *(pa.nulls(1, x.type) for x in lists), seen], _ITEMS)


class _Posts:
    """The items of a batch of posts."""

    def __init__(self, batch: pa.RecordBatch, column: int):
        k, w = batch.column(column), batch.column(column + 1)
        self.n = batch.num_rows
        self.kinds, self.words = k.flatten().to_numpy().astype(np.int64), w.flatten().to_numpy()
        self.post = np.repeat(np.arange(self.n), np.diff(k.offsets.to_numpy()))
        self.start, self.segment, self.size = _segments(self.kinds, self.post)

    def prose(self) -> np.ndarray:
        """Per item, whether its segment reads as a sentence."""
        if not len(self.kinds):
            return np.zeros(0, bool)
        word = self.kinds >= _WORDS
        words, other = _sums(word, self.start), _sums(_OTHER[self.kinds], self.start)
        near = _sums(word & ((self.kinds - _WORDS) % 5 >= 3) & (self.kinds - _WORDS >= 10), self.start)
        ended = self.kinds[self.start + self.size - 1] == _ID["End"]
        return (ended & (words >= 5) & (other * 8 <= words) & (near * 4 <= words))[self.segment]

    def sequences(self, function: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with function words as themselves; and whether an item is a short word that is none of them."""
        at = np.minimum(np.searchsorted(function, self.words), len(function) - 1) if len(function) else np.zeros(len(self.words), np.int64)
        own = (function[at] == self.words) & (self.words != 0) if len(function) else np.zeros(len(self.words), bool)
        return np.where(own, _FUNCTION + at, self.kinds), ~own & (self.words != 0) & (self.kinds < _WORDS + 10)

    def grams(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Trigram of each item; its two context items come first."""
        depth = np.arange(len(c)) - self.start[self.segment] if len(c) else c
        b = np.where(depth >= 1, np.r_[0, c[:-1]][: len(c)], 0)
        a = np.where(depth >= 2, np.r_[0, 0, c[:-2]][: len(c)], 0)
        return a, b, c

    def local_mean(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean of ``x`` over each item and its neighbours of the same post, and how many they are."""
        n = np.bincount(self.post, minlength=self.n)
        begin = (np.cumsum(n) - n)[self.post]
        end, at = begin + n[self.post], np.arange(len(x))
        low, high = np.maximum(begin, at - REACH), np.minimum(end, at + REACH + 1)
        total = np.r_[0, np.cumsum(x)]
        return (total[high] - total[low]) / (high - low), high - low


def _function_counts(p: _Posts) -> tuple[np.ndarray, np.ndarray]:
    """Posts that have a short word in their prose; the hash 0 stands for the posts with prose."""
    prose = p.prose()
    at = prose & ((p.words & 7) <= 5) & (p.words != 0)
    word, code = np.unique(np.r_[p.words[at], np.zeros(int(prose.sum()), np.int64)], return_inverse=True)
    pairs = np.unique(code * np.int64(p.n) + np.r_[p.post[at], p.post[prose]])
    return word, np.bincount(pairs // max(p.n, 1), minlength=len(word))


_GRAMS = {0: SIZE, 1: _FUNCTION}  # model -> size of its alphabet


def _gram_counts(function: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = _Posts(batch, 0)
        prose = p.prose()
        codes = []
        for model, sequence in ((0, p.sequences(function)[0]), (1, p.kinds)):
            a, b, c = (x[prose] for x in p.grams(sequence))
            codes.append(((model * 256 + a) * 256 + b) * 256 + c)
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["gram", "n"])


class Model:
    """Interpolated trigram probabilities of the two models; ``moments`` are the mean and deviation of the bits of an item of the prose it was trained on."""

    def __init__(self, function: np.ndarray, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        self.function, self.gram, self.n = function, gram[order], n[order].astype(np.float64)
        at = self.gram & 0xFFFF
        which = self.gram >> 24
        self.pair = [np.bincount((self.gram >> 8 & 0xFFFF)[which == m], self.n[which == m], 1 << 16) for m in (0, 1)]
        self.bigram = [np.bincount(at[which == m], self.n[which == m], 1 << 16) for m in (0, 1)]
        self.context = [x.reshape(256, 256).sum(1) for x in self.bigram]
        self.one = [x.reshape(256, 256).sum(0) for x in self.bigram]
        self.moments = [self._moments(m, self.gram[which == m], self.n[which == m]) for m in (0, 1)]

    def _moments(self, model: int, gram: np.ndarray, n: np.ndarray) -> tuple[float, float]:
        if not len(n):
            return LEAST_BITS, LEAST_DEVIATION
        bits = self._bits(model, n, gram >> 16 & 255, gram >> 8 & 255, gram & 255)
        mean = float(np.average(bits, weights=n))
        return mean, max(float(np.average((bits - mean) ** 2, weights=n)) ** 0.5, LEAST_DEVIATION)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_dense", "_small")}

    def dense(self) -> np.ndarray:
        """Trigram counts by their code, built once per worker; its size is that of the alphabets."""
        if not hasattr(self, "_dense"):
            self._dense = np.zeros((_GRAMS[0] + 1) << 16, np.float32)
            which = self.gram >> 24 == 1
            self._dense[self.gram[~which]] = self.n[~which]
            self._small = np.zeros(64**3, np.float32)
            g = self.gram[which]
            self._small[((g >> 16 & 63) * 64 + (g >> 8 & 63)) * 64 + (g & 63)] = self.n[which]
        return self._dense

    def bits(self, posts: _Posts, model: int, sequence: np.ndarray) -> np.ndarray:
        a, b, c = posts.grams(sequence)
        table = self.dense()
        tri = self._small[(a * 64 + b) * 64 + c] if model else table[(a * 256 + b) * 256 + c]
        return self._bits(model, tri, a, b, c)

    def _bits(self, model: int, tri: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        pair, bi, context = self.pair[model][a * 256 + b], self.bigram[model][b * 256 + c], self.context[model][b]
        low = (self.one[model] + 0.5) / (self.one[model].sum() + 0.5 * _GRAMS[model])
        mid = (bi + 4 * low[c]) / (context + 4)
        return -np.log2((1 - FLOOR) * (tri + 4 * mid) / (pair + 4) + FLOOR / _GRAMS[model])


def _score(shared, most: float, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        p = _Posts(batch, 1)
        sequence, foreign = p.sequences(model.function)
        short = np.bincount(p.post, (p.words != 0) & (p.kinds < _WORDS + 10) | (sequence >= _FUNCTION), p.n)
        unknown = (np.bincount(p.post, foreign, p.n) * 2 > short)[p.post]
        above, below, raw = np.zeros((3, len(sequence)))
        for m, s in ((0, sequence), (1, p.kinds)):
            bits = model.bits(p, m, s)
            mean, n = p.local_mean(bits)
            mu, deviation = model.moments[m]
            use = unknown == bool(m)
            scale = np.sqrt(n) / deviation
            above[use] = ((mean - max(mu, LEAST_BITS)) * scale)[use]
            below[use] = ((mean - mu) * scale)[use]
            raw[use] = bits[use]
        weight = np.where(p.kinds == _ID["Link"], LINK_WEIGHT, 1.0) * ~_BREAKS[p.kinds]
        total = np.bincount(p.post, weight, p.n)
        share = lambda mask: np.bincount(p.post, weight * mask, p.n) / np.maximum(total, 1)
        items_ = np.maximum(np.bincount(p.post, minlength=p.n), 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(total.astype(np.int64)), pa.array(np.bincount(p.post, raw, p.n) / items_), pa.array(np.bincount(p.post, below, p.n) / items_), pa.array(share(above > most)), pa.array(share(below < least))],
            ["key", "n_items", "bits", "z", "high", "low"],
        )


def scores(df: DataFrame, key: str = "doc_id", column: str = "text", high: float = HIGH, low: float = LOW) -> DataFrame:
    """``key, n_items, bits, z, high, low``: items of own text (a link as three), bits an item, its mean distance from prose in standard deviations, and the shares of the post that are abnormally high and low."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("text"))
    found = materialize(rows.mapInArrow(_classify, f"key {kind}, kinds array<smallint>, words array<bigint>, seen array<struct<word: bigint, n: bigint>>"), "p7-items")
    posts = found.where("kinds IS NOT NULL")

    counted = found.where("seen IS NOT NULL").select(F.inline("seen")).groupBy("word").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.desc("n"), "word").limit(N_FUNCTION + 1).collect()  # the posts with prose come first
    with_prose = max((r["n"] for r in most if r["word"] == 0), default=0)
    function = np.array(sorted(r["word"] for r in most if r["word"] != 0 and r["n"] >= max(FUNCTION_POSTS, FUNCTION_SHARE * with_prose))[:N_FUNCTION], np.int64)

    grams = posts.select("kinds", "words").mapInArrow(partial(_gram_counts, function), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    shared = spark.sparkContext.broadcast(Model(function, grams.column("gram").to_numpy(), grams.column("n").to_numpy()))
    return posts.select("key", "kinds", "words").mapInArrow(partial(_score, shared, high, low), f"key {kind}, n_items long, bits double, z double, high double, low double").withColumnRenamed("key", key)


def stuffed(df: DataFrame, key: str = "doc_id", column: str = "text", least: int = LEAST, high: float = HIGH, low: float = LOW) -> DataFrame:
    """The scores of the posts most of which is of abnormal perplexity."""
    return scores(df, key, column, high, low).where((F.col("n_items") >= least) & ((F.col("high") > 0.5) | (F.col("low") > 0.5)))
