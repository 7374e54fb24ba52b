"""Evaluation items that appear, whole or in part, inside corpus documents.

A document leaks an item if they share ``WORDS`` words in a row; for items in languages written without spaces,
``CHARS`` letters and digits in a row. It is a set join of windows by a prefix filter:

1. Texts become streams of their letters and digits (compatibility forms, case folded; nothing else counts). Items are
   cut into overlapping shingles, one row each, with the letters and word edges up to a window's reach on both sides.
2. How many documents hold each item shingle is counted over the whole corpus (first pass). Ordering a window's shingles
   by rarity, a document that contains the window must contain its rarest shingle: that prefix of one token is necessary.
3. The documents' own shingles are joined with those prefix tokens on a 64-bit hash (second pass). Only shingles that
   pass two bit tables of the tokens leave a task; these have a bound whatever the number of items, they only save
   traffic, the join decides. Keys that are hot among documents, known from the first pass, are salted.
4. Length and positional bound: a joined pair stays only if the letters on both sides of the token, in the item and in
   the document, leave room for the smallest window of the item around it; texts shorter than a window give no shingles.
5. Each pair is verified exactly over the item-sized window around the token: the match is extended in both directions,
   counting whole words between word boundaries of the document, or characters.

A word broken by a hyphen at a line's end is still that word: shingles exist over both readings of such a break.

Items are rows throughout, nothing of them is collected, and any number of them takes two passes of the corpus. Defined
results: null and blank texts never match; every copy of a document is reported; equal items are all reported; items
shorter than a window never match; a document and an item give one row however often they share passages; texts are
read whole; equal hashes of different shingles are told apart by the verification.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweft.runtime import broadcast_if_small, cut, hot_keys, map_batches, salted_join

WORDS = 12
CHARS = 40
WORD_SHINGLE = 4
CHAR_SHINGLE = 10
UNSPACED = ("zh", "ja")
#: Bits of a hash that address each of the two bit tables, at least and at most: so 2 ** 23 slots at most are fetched, 1 MB sent.
SLOT_BITS = (12, 22)
#: Characters of text handled at once; a longer text is handled alone.
PORTION = 250_000
_HYPHENS = "-\u2010\u2011"
_SOFT_HYPHEN = 0xAD
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def folded(text: str) -> str:
    """Compatibility form, case folded, composed again."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text).casefold()
    return unicodedata.normalize("NFKC", text)


@cache
def _classes() -> np.ndarray:
    """For every code point: 1 letter or digit, 2 invisible (divides no words), 4 hyphen, 8 line break, 0 anything else."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in itertools.chain(range(0x34000), range(0xE0000, 0xE1000)):  # beyond lie no letters
        ch = chr(c)
        if ch.isalnum():
            out[c] = 1
        elif unicodedata.category(ch) == "Cf":
            out[c] = 2
    for ch in _HYPHENS:
        out[ord(ch)] = 4
    for ch in "\n\r\x0b\x0c\x85\u2028\u2029":
        out[ord(ch)] = 8
    return out


_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for k, base in enumerate((_BASE, inverse)):
            table = np.full(2 * n, base, dtype=np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


class Streams:
    """The letter streams of several texts, end to end, with word edges, soft breaks and hashes of any part."""

    def __init__(self, texts: list[str]) -> None:
        parts = [folded(t) + "\n " for t in texts]
        flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))])
        kind = _classes()[flat]
        hidden = np.flatnonzero(kind == 2)
        if len(hidden):
            broken = hidden[(flat[hidden] == _SOFT_HYPHEN) & (kind[hidden + 1] == 8)]
            kind[broken] = 4
            shown = kind != 2
            offsets -= np.searchsorted(hidden[kind[hidden] == 2], offsets)
            flat, kind = flat[shown], kind[shown]
        letter = kind == 1
        self.letters = flat[letter]
        turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if len(letter) and letter[0]:
            turns = np.concatenate([[0], turns])
        begin, end = turns[::2], turns[1::2]
        #: stream places at which words begin, and end (exclusive), and the text of every word
        self.ends = np.cumsum(end - begin)
        self.starts = self.ends - (end - begin)
        self.doc = np.repeat(np.arange(len(parts)), np.diff(np.searchsorted(begin, offsets)))
        self.bounds = np.concatenate([[0], self.ends])[np.searchsorted(begin, offsets)]
        #: whether the gap after a word is a hyphen and a line's end
        self.soft = np.zeros(len(begin), dtype=bool)
        hyphen = np.flatnonzero(kind[end] == 4)
        hyphen = hyphen[hyphen + 1 < len(begin)]
        breaks = np.flatnonzero(kind == 8)
        self.soft[hyphen] = (np.searchsorted(breaks, begin[hyphen + 1]) > np.searchsorted(breaks, end[hyphen])) & (self.doc[hyphen] == self.doc[hyphen + 1])
        up, _ = _power_tables(len(self.letters) + 1)
        self.sums = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        np.cumsum((self.letters + np.uint64(1)) * up[: len(self.letters)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        """Hash of the letters of each part, whatever stands between them; mixed so that its high bits address slots."""
        _, down = _power_tables(len(self.letters) + 1)
        h = (self.sums[end] - self.sums[start]) * down[start] + np.uint64(salt)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def word_shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, start, end) of all shingles of words, also with broken words read as one."""
        n, k = len(self.starts), WORD_SHINGLE
        softs = np.concatenate([[0], np.cumsum(self.soft)])
        first, last, extra = [], [], 0
        begin = np.arange(n)
        while True:
            begin = begin[begin + k - 1 + extra < n]
            stop = begin + k - 1 + extra
            begin, stop = begin[ok := (self.doc[begin] == self.doc[stop]) & (softs[stop] - softs[begin] >= extra)], stop[ok]
            if not len(begin):
                break
            first.append(begin)
            last.append(stop)
            extra += 1
            if extra == 1:
                begin = np.arange(n)[: max(n - k, 0)]
                begin = begin[softs[begin + k] > softs[begin]]
        a, b = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (first, last))
        return a, self.starts[a], self.ends[b]

    def char_shingles(self) -> tuple[np.ndarray, np.ndarray]:
        fits = np.ones(len(self.letters), dtype=bool)
        for back in range(1, CHAR_SHINGLE):
            at = self.bounds[1:] - back
            fits[at[at >= 0]] = False
        start = np.flatnonzero(fits)
        return start, start + CHAR_SHINGLE

    def text(self, start: int, end: int) -> str:
        return self.letters[start:end].tobytes().decode("utf-32-le", "surrogatepass")


_SALTS = {True: 1, False: 2}
_ITEM = "item_id bigint, spaced boolean, at int, h bigint, before int, after int, need int, shingle string, left string, right string, left_edges array<int>, right_edges array<int>"
_HIT = "doc_id bigint, h bigint, before int, after int, shingle string, left string, right string, left_edges array<int>, right_edges array<int>"
_INTS = pa.list_(pa.int32())


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every shingle of every item long enough to hold a window."""
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _INTS, _INTS]
    for batch in batches:
        rows = []
        for item, text, spaced in zip(*(c.to_pylist() for c in batch.columns)):
            s = Streams([text])
            if spaced:
                n, reach, k = len(s.starts), WORDS - WORD_SHINGLE, WORD_SHINGLE
                if n < WORDS:
                    continue
                sizes = s.ends - s.starts
                total = np.concatenate([[0], np.cumsum(sizes)])
                window = total[WORDS:] - total[:-WORDS]
                places = [(i, int(s.starts[i]), int(s.ends[i + k - 1])) for i in range(n - k + 1)]
            else:
                n, reach = len(s.letters), CHARS - CHAR_SHINGLE
                if n < CHARS:
                    continue
                places = [(i, i, i + CHAR_SHINGLE) for i in range(n - CHAR_SHINGLE + 1)]
            hashes = s.hashes(np.array([p[1] for p in places]), np.array([p[2] for p in places]), _SALTS[spaced]).astype(np.int64)
            for (i, a, b), h in zip(places, hashes.tolist()):
                if spaced:
                    lo, hi = max(0, i - reach), min(n - 1, i + k - 1 + reach)
                    start, end = int(s.starts[lo]), int(s.ends[hi])
                    need = int(window[max(0, i - reach) : min(i, n - WORDS) + 1].min())
                    left_edges = [a - int(s.starts[j]) for j in range(i - 1, lo - 1, -1)]
                    right_edges = [int(s.ends[j]) - b for j in range(i + k, hi + 1)]
                else:
                    start, end, need = max(0, a - reach), min(n, b + reach), CHARS
                    left_edges = right_edges = []
                rows.append((item, spaced, i, h, a - start, end - b, need, s.text(a, b), s.text(start, a), s.text(b, end), left_edges, right_edges))
        cols = list(zip(*rows)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split(" ")[0] for x in _ITEM.split(", ")])


def item_shingles(eval_items: DataFrame, unspaced: tuple[str, ...] = UNSPACED) -> DataFrame:
    """The items as a table of shingles: hash, place, window's needed letters and what surrounds each within a window."""
    lang = F.lower(F.substring(F.trim(F.coalesce("lang", F.lit(""))), 1, 2))
    rows = eval_items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), (~lang.isin(*unspaced)).alias("spaced"))
    return map_batches(rows.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()), _item_rows, _ITEM)


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(
        F.col("text").isNotNull()
    )


def slot_table(hashes: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bit tables) of the slots that a column of hashes takes by its highest and, behind these, by its lowest bits;
    at most ``2 ** (SLOT_BITS[1] + 1)`` slots are fetched."""
    n = hashes.count()
    bits = min(max(n.bit_length() + 7, SLOT_BITS[0]), SLOT_BITS[1])
    low = F.col("h").bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(1 << bits)
    slots = hashes.select(F.explode(F.array(F.shiftrightunsigned("h", 64 - bits).cast("int"), low.cast("int"))).alias("slot")).distinct()
    table = np.zeros(2 << bits, dtype=bool)
    table[slots.toArrow().column(0).to_numpy()] = True
    return bits, np.packbits(table)


class _Finder:
    """Shingles of documents that pass the bit table, portion by portion."""

    def __init__(self, shared: tuple[int, np.ndarray, bool, bool]) -> None:
        self.bits, packed, self.words, self.chars = shared
        self.table = np.unpackbits(packed).astype(bool)

    def portions(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], Streams]]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if size and size + len(text) > PORTION:
                    yield ids, Streams(texts)
                    ids, texts, size = [], [], 0
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
            if ids:
                yield ids, Streams(texts)

    def found(self, s: Streams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of the shingles that pass."""
        parts = []
        for wanted, spaced in ((self.words, True), (self.chars, False)):
            if wanted:
                a, b = s.word_shingles()[1:] if spaced else s.char_shingles()
                h = s.hashes(a, b, _SALTS[spaced])
                hit = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
                hit = hit[self.table[(h[hit] & np.uint64((1 << self.bits) - 1)).astype(np.int64) + (1 << self.bits)]]
                parts.append((a[hit], b[hit], h[hit]))
        a, b, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, dtype=np.int64),) * 3
        return a, b, h


def shingle_counts(documents: DataFrame, shared: tuple[int, np.ndarray, bool, bool]) -> DataFrame:
    """Number of documents that hold each shingle of the bit table: ``h, n``; summed within tasks first."""
    box = documents.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(box.value)
        for _, s in finder.portions(batches):
            a, _, h = finder.found(s)
            own = np.unique(np.stack([np.searchsorted(s.bounds, a, side="right").astype(np.uint64), h.astype(np.uint64)]), axis=1)[1]
            keys, n = np.unique(own, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    return map_batches(_texts(documents), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def prefix_tokens(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """Of every window of every item its rarest shingle (ties: the smaller hash, then the first place), with ``n``.

    A window whose rarest shingle no document holds leaks nowhere and has no token.
    """
    rows = shingles.join(counts, "h", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    kept = []
    for spaced, size in ((True, WORDS - WORD_SHINGLE + 1), (False, CHARS - CHAR_SHINGLE + 1)):
        window = Window.partitionBy("item_id").orderBy("at").rowsBetween(0, size - 1)
        least = F.min(F.struct("n", "h", "at")).over(window)
        kept.append(rows.filter(F.col("spaced") == spaced).select("item_id", "spaced", least.alias("w"), F.count(F.lit(1)).over(window).alias("size")).filter(F.col("size") == size))
    chosen = kept[0].unionByName(kept[1]).filter(F.col("w.n") > 0).select("item_id", "spaced", F.col("w.at").alias("at")).distinct()
    return rows.join(chosen, ["item_id", "spaced", "at"])


def hits(documents: DataFrame, shared: tuple[int, np.ndarray, bool, bool], reach: tuple[int, int]) -> DataFrame:
    """Documents' shingles that pass the bit table, each with the letters and word edges ``reach`` to its left and right."""
    box = documents.sparkSession.sparkContext.broadcast(shared)
    to_left, to_right = reach
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), _INTS, _INTS]
    names = [x.split(" ")[0] for x in _HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(box.value)
        for ids, s in finder.portions(batches):
            start, end, h = finder.found(s)
            owner = np.searchsorted(s.bounds, start, side="right") - 1
            left = np.maximum(s.bounds[owner], start - to_left)
            right = np.minimum(s.bounds[owner + 1], end + to_right)
            w = [np.searchsorted(s.starts, x) for x in (left, start)] + [np.searchsorted(s.ends, x, side="right") for x in (end, right)]
            rows = []
            for i, (o, l, a, b, r) in enumerate(zip(owner.tolist(), left.tolist(), start.tolist(), end.tolist(), right.tolist())):
                rows.append((ids[o], a - l, r - b, s.text(a, b), s.text(l, a), s.text(b, r), a - s.starts[w[0][i] : w[1][i]], s.ends[w[2][i] : w[3][i]] - b))
                if len(rows) == 20_000 or i + 1 == len(owner):
                    cols = list(zip(*rows))
                    cols.insert(1, h[i + 1 - len(rows) : i + 1].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
                    rows = []

    return map_batches(_texts(documents), run, _HIT)


def shared_window(spaced: bool, size: int, item: tuple[str, str, list[int], list[int]], doc: tuple[str, str, list[int], list[int]]) -> bool:
    """Whether the shingle lies in a shared window, from (left, right, edges to the left, to the right) of both sides."""
    left = right = 0
    for a, b in zip(reversed(item[0]), reversed(doc[0])):
        if a != b:
            break
        left += 1
    for a, b in zip(item[1], doc[1]):
        if a != b:
            break
        right += 1
    if not spaced:
        return left + size + right >= CHARS
    more = [max((n for n, e in enumerate(own, 1) if e <= reach and e in other), default=0) for own, other, reach in ((item[2], set(doc[2]), left), (item[3], set(doc[3]), right))]
    return WORD_SHINGLE + sum(more) >= WORDS


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept: set[tuple[int, int]] = set()
        rest = batch.columns[4:]
        for at, (doc_id, item_id, spaced, size) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:4]))):
            if (doc_id, item_id) not in kept:  # else another token of the same passage
                sides = [c[at].as_py() for c in rest]
                if shared_window(spaced, size, tuple(sides[:4]), tuple(sides[4:])):
                    kept.add((doc_id, item_id))
        cols = list(zip(*kept)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], names=["doc_id", "item_id"])


def leaked_items(documents: DataFrame, eval_items: DataFrame, unspaced: tuple[str, ...] = UNSPACED) -> DataFrame:
    """All leaks as ``doc_id, item_id``."""
    shingles = cut(item_shingles(eval_items, unspaced))
    kinds = {r["spaced"]: r for r in shingles.groupBy("spaced").agg(F.max("before").alias("l"), F.max("after").alias("r")).collect()}
    wanted = (True in kinds, False in kinds)
    counts = cut(shingle_counts(documents, (*slot_table(shingles.select("h").distinct()), *wanted)).join(shingles.select("h").distinct(), "h", "left_semi"))
    tokens = cut(prefix_tokens(shingles, counts))
    reach = tuple(max((r[c] for r in kinds.values()), default=0) for c in ("l", "r"))
    used = tokens.select("h", "n").distinct()
    found = hits(documents, (*slot_table(used), *wanted), reach)
    item = tokens.select("h", "item_id", "spaced", "need", *[F.col(c).alias(f"i_{c}") for c in ("before", "after", "shingle", "left", "right", "left_edges", "right_edges")])
    other = broadcast_if_small(item)
    pairs = salted_join(found, other, ["h"], [] if other is not item else hot_keys(used, ["h"], "n"), ["doc_id", "before", "after", "left"])
    room = F.least("before", "i_before") + F.length("shingle") + F.least("after", "i_after")
    pairs = pairs.filter((F.col("shingle") == F.col("i_shingle")) & (room >= F.col("need")))
    sides: list[Column] = [F.col(p + c) for p in ("i_", "") for c in ("left", "right", "left_edges", "right_edges")]
    return map_batches(pairs.select("doc_id", "item_id", "spaced", F.length("shingle").alias("size"), *sides), _verified, "doc_id bigint, item_id bigint").distinct()


def leak_report(leaks: DataFrame, eval_items: DataFrame) -> DataFrame:
    """Per item the number of documents that leak it, also 0."""
    counts = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return eval_items.select("item_id", "suite", "lang").join(counts, "item_id", "left").na.fill(0, ["n_docs"])
