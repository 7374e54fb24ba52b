"""Free-entered values mapped to the closest entry of a reference list, unmatched values reported.

Every value is answered by BK-trees over the entries' written variants under the unrestricted Damerau-Levenshtein
distance (insertion, deletion, substitution and transposition of neighbours cost 1 each), which is a true metric: the
triangle inequality prunes subtrees without losing a variant within the threshold. Nothing is answered beside the trees.

1. A value is reduced to a key: compatibility forms, letter case, accents, invisible characters and look-alike letters
   are folded; notes in brackets and words such as "env" around the name are dropped; the rest is its letters and digits
   without gaps.
2. Variants of an entry, made where the entry lies and settled by one aggregation over the whole reference: its name and
   aliases; up to two phrases replaced by others that aliases of the reference imply; one word cut to a prefix or
   inflected; the words of each in every rotation and with two of them exchanged. Their number per entry grows with the
   square of its words. A variant belongs to the entry that has it by the best origin (rank 0: name and aliases, 1:
   phrases, 2: cut words); one that several entries have at the same rank stands for the first and the last of them.
3. Only names, aliases and phrases may be mistyped: rank 0 by two edits from six letters on and one at five, rank 1 by
   one edit from six letters on and two from nine; rank 2 must agree. Variants of equal threshold share a tree.
4. Variants are cut into shards by a hash of the variant, each with its own trees, built by a task; names are looked up
   in every shard, in chunks. Each shard names its winners, and these merge by (distance, distance of the words in order
   to the entry's name, entry). As both steps take the least of the same order, any number of shards gives one answer.

Defined results: null and blank values give no result; values whose key is empty, far from all entries or equally near
to different entries, also by their words in order, are unmatched (0); each distinct value is looked up once; repeated rows count once; an empty
reference leaves every value unmatched; very long values are compared only if their length can match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depweft.functions.text import strip_space
from depweft.runtime import cut, hot_keys, map_batches, salted_join, ship, small

#: Variants in one shard; bounds the memory of a task, not the size of the reference.
SHARD_VARIANTS = 100_000
#: Names looked up by one task in one shard, at least; as many as the shard has variants, if these are more.
CHUNK_NAMES = 4_000
RADIUS = 2
#: Cells of the distance grids computed at once.
GRID_CELLS = 6_000_000

#: Look-alike letters and the Latin letters they are taken for. Fixed values.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "ε": "e",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Words around a name that say only that it is an environment.
FILLERS = {"env", "environment", "environments", "the", "umgebung", "entorno", "environnement"}


def words_of(value: str) -> list[str]:
    """The words that make up a typed name, folded, without notes in brackets and filler words."""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").casefold()
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    bare = re.sub(r"\([^()]*\)|\{[^{}]*\}|<[^<>]*>", " ", text)
    words = re.findall(r"[^\W_]+", bare) or re.findall(r"[^\W_]+", text)
    folded = []
    for w in words:
        latin = any("a" <= c <= "z" for c in w)
        if latin or all(c in LOOK_ALIKES or c.isdigit() for c in w):
            w = "".join(LOOK_ALIKES.get(c, c) for c in w)
        folded.append(w)
    if len(folded) > 1 and re.match(r"\W*\d+\s*[-.):]\s", bare):
        folded = folded[1:]
    kept = list(folded)
    while len(kept) > 1 and kept[0] in FILLERS:
        kept = kept[1:]
    while len(kept) > 1 and kept[-1] in FILLERS:
        kept = kept[:-1]
    return kept


def key_of(value: str) -> str:
    return "".join(words_of(value))


# The metric and the tree


def _codes(words: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows, padded by ``gap``, and lengths."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    grid = np.full((len(words), int(sizes.max(initial=0))), gap, dtype=np.int32)
    for i, w in enumerate(words):
        grid[i, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return grid, sizes


def _grid_distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    la, lb, n = a.shape[1], b.shape[1], len(a)
    at, far = np.arange(n), la + lb
    d = np.empty((la + 2, lb + 2, n), dtype=np.int32)
    d[0], d[:, 0] = far, far
    d[1, 1:] = np.arange(lb + 1)[:, None]
    d[1:, 1] = np.arange(la + 1)[:, None]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    above = np.zeros((lb, n), dtype=np.int32)
    for i in range(1, la + 1):
        same = b == a[i - 1]
        before = np.zeros(n, dtype=np.int32)
        for j in range(1, lb + 1):
            k, eq = above[j - 1], same[j - 1]
            best = np.minimum(d[i, j + 1], d[i + 1, j]) + 1
            np.minimum(best, d[i, j] + ~eq, out=best)
            if before.any():
                np.minimum(best, d[k, before, at] + (i + j - 1) - k - before, out=best)
            d[i + 1, j + 1] = best
            before = np.where(eq, j, before)
        above = np.where(same, i, above).astype(np.int32)
    return d[na + 1, nb + 1, at]


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of many pairs, given as padded rows of code points and lengths."""
    out = np.empty(len(na), dtype=np.int64)
    order = np.argsort(na + nb, kind="stable")
    i = 0
    while i < len(order):
        step = max(1, GRID_CELLS // int((na[order[i]] + 2) * (nb[order[i]] + 2)))
        part = order[i : i + step]
        la, lb = int(na[part].max()), int(nb[part].max())
        if len(part) > 1 and (la + 2) * (lb + 2) * len(part) > 2 * GRID_CELLS:
            part = part[: max(1, GRID_CELLS // ((la + 2) * (lb + 2)))]
            la, lb = int(na[part].max()), int(nb[part].max())
        out[part] = _grid_distances(a[part, :la], na[part], b[part, :lb], nb[part])
        i += len(part)
    return out


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance of two texts."""
    return int(distances(*_codes([a], -1), *_codes([b], -2))[0])


class BKTree:
    """Burkhard-Keller tree over strings, as arrays; it is built and asked level by level for all at once."""

    def __init__(self, keys: Iterable[str] = ()) -> None:
        self.keys = sorted(set(keys))
        self.codes, self.sizes = _codes(self.keys, -1)
        n = len(self.keys)
        child_of, edge_of = np.full(n, -1), np.zeros(n, dtype=np.int64)
        todo, under = np.arange(1, n), np.zeros(max(n - 1, 0), dtype=np.int64)
        while len(todo):
            d = distances(self.codes[under], self.sizes[under], np.where(self.codes[todo] < 0, -2, self.codes[todo]), self.sizes[todo])
            slot = under * (int(d.max()) + 1) + d
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            child_of[todo[first]], edge_of[todo[first]] = under[first], d[first]
            stays = np.ones(len(todo), dtype=bool)
            stays[first] = False
            todo, under = todo[stays], todo[first][group][stays]
        order = np.lexsort((edge_of, child_of))
        order = order[child_of[order] >= 0]
        self.child, self.edge = order, edge_of[order]
        self.start = np.searchsorted(child_of[order], np.arange(n + 1))

    def search(self, keys: list[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, place in the tree, distance) of every tree key at most ``radius`` away from a key."""
        codes, sizes = _codes(keys, -2)
        ask = np.arange(len(keys) if self.keys else 0)
        node, found = np.zeros(len(ask), dtype=np.int64), []
        while len(ask):
            leaf = self.start[node] == self.start[node + 1]
            open_ = ~leaf | (np.abs(self.sizes[node] - sizes[ask]) <= radius)
            ask, node = ask[open_], node[open_]
            d = distances(self.codes[node], self.sizes[node], codes[ask], sizes[ask])
            hit = d <= radius
            found.append((ask[hit], node[hit], d[hit]))
            many = self.start[node + 1] - self.start[node]
            which = np.repeat(np.arange(len(node)), many)
            at = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.start[node][which]
            near = np.abs(self.edge[at] - d[which]) <= radius
            ask, node = ask[which[near]], self.child[at[near]]
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
        return parts[0], parts[1], parts[2]

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        _, nodes, d = self.search([key], radius)
        return [(int(x), self.keys[n]) for n, x in zip(nodes, d)]


# Variants


def orders(words: tuple[str, ...]) -> set[tuple[str, ...]]:
    """The words in every rotation and with any two exchanged: all orders of up to three words."""
    n = len(words)
    out = {words[i:] + words[:i] for i in range(n)} or {()}
    for i in range(n):
        for j in range(i + 1, n):
            swapped = list(words)
            swapped[i], swapped[j] = swapped[j], swapped[i]
            out.add(tuple(swapped))
    return out


def cut_forms(word: str) -> set[str]:
    """Prefixes (of four letters on, three of long words), plural and -ing forms, and what an -ing form is made from."""
    if len(word) < 4 or not word.isalpha():
        return set()
    forms = {word + "s", word + "es", word + "ing", word + word[-1] + "ing"}
    if word.endswith("y"):
        forms.add(word[:-1] + "ies")
    if word.endswith("ing") and len(word) > 6:
        forms.add(word[:-3] + "e")
    return forms | {word[:n] for n in range(3 if len(word) > 7 else 4, len(word))}


def renderings(name: tuple[str, ...], phrases: list[tuple[int, int, tuple[str, ...]]]) -> set[tuple[str, ...]]:
    """The name with one or two of its phrases (first word, words, replacement) replaced."""
    out = set()
    for i, n, other in phrases:
        out.add(name[:i] + other + name[i + n :])
        for k, m, second in phrases:
            if k >= i + n:
                out.add(name[:i] + other + name[i + n : k] + second + name[k + m :])
    return out


def allowed(size: int, rank: int) -> int:
    """Edits by which a variant of this length and origin may be mistyped."""
    return int((2 if size >= 6 else size == 5, 2 if size >= 9 else size >= 6, 0)[rank])


def variants_of(name: tuple[str, ...], aliases: list[tuple[str, ...]], phrases: list[tuple[int, int, tuple[str, ...]]]) -> dict[str, int]:
    """Variants of one entry with the rank of their best origin."""
    out: dict[str, int] = {}

    def put(words: tuple[str, ...], rank: int) -> None:
        for order in orders(words):
            if key := "".join(order):
                out[key] = min(out.get(key, rank), rank)

    rendered = renderings(name, phrases)
    for words in [name, *aliases]:
        put(words, 0)
    for words in rendered:
        put(words, 1)
    for words in {name, *rendered}:
        for i, word in enumerate(words):
            for form in cut_forms(word):
                put(words[:i] + (form,) + words[i + 1 :], 2)
    return out


_PARTS = "id bigint, words array<string>, aliases array<array<string>>"
_WORDS = pa.list_(pa.string())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names, aliases = (batch.column(i).to_pylist() for i in range(3))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([words_of(n) for n in names], _WORDS), pa.array([[words_of(x) for x in a or [] if x] for a in aliases], pa.list_(_WORDS))],
            names=["id", "words", "aliases"],
        )


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, words, aliases, phrases in zip(*(c.to_pylist() for c in batch.columns)):
            found = variants_of(tuple(words), [tuple(a) for a in aliases], [(p["at"], p["n"], tuple(p["other"])) for p in phrases or []])
            rows.extend((key, i, rank, allowed(len(key), rank), " ".join(words)) for key, rank in found.items())
        cols = list(zip(*rows)) or [[]] * 5
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "id", "rank", "allowed", "name"])


def synonyms(parts: DataFrame) -> DataFrame:
    """``phrase, other``: phrases that aliases of the reference imply to stand for one another.

    A one-word alias of a one-word name stands for it. Where a name and its alias begin alike, by the same word or such a
    pair, what follows in the alias stands for what follows in the name.
    """
    pairs = parts.select("words", F.explode("aliases").alias("alias"))
    single = pairs.filter((F.size("words") == 1) & (F.size("alias") == 1)).select(F.col("words")[0].alias("w"), F.col("alias")[0].alias("a")).distinct()
    rest = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1)))
    longer = pairs.filter((F.size("words") > 1) & (F.size("alias") > 1)).select(
        F.col("words")[0].alias("w"), F.col("alias")[0].alias("a"), rest(F.col("words")).alias("phrase"), rest(F.col("alias")).alias("other")
    )
    tails = longer.filter(F.col("w") == F.col("a")).unionByName(longer.join(single, ["w", "a"], "left_semi"))
    return single.select(F.array("w").alias("phrase"), F.array("a").alias("other")).unionByName(tails.select("phrase", "other")).filter(F.col("phrase") != F.col("other")).distinct()


def variants(reference: DataFrame) -> DataFrame:
    """``key, id, allowed, name`` of every variant of the whole reference; two rows if several entries share it."""
    rows = reference.select(F.col("canon_id").cast("bigint").alias("id"), F.col("canon_name").alias("name"), F.col("aliases").alias("aliases"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("name").isNotNull())
    parts = cut(map_batches(rows, _parts, _PARTS))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.transform(F.sequence(F.lit(1), F.size("words") - i + 1), lambda n: F.struct(i.alias("i"), n.alias("n")))))
    spans = parts.filter(F.size("words") > 0).select("id", "words", F.explode(places).alias("s")).select(
        "id", "words", (F.col("s.i") - 1).alias("at"), F.col("s.n").alias("n"), F.slice("words", F.col("s.i"), F.col("s.n")).alias("phrase")
    )
    phrases = spans.join(synonyms(parts), "phrase").groupBy("id", "words").agg(F.sort_array(F.collect_set(F.struct("at", "n", "other"))).alias("phrases"))
    made = map_batches(parts.join(phrases, ["id", "words"], "left").select("id", "words", "aliases", "phrases"), _variant_rows, "key string, id bigint, rank int, allowed int, name string")
    entry = F.struct("id", "name")
    best = made.groupBy("key", "rank").agg(F.min(entry).alias("lo"), F.max(entry).alias("hi"), F.max("allowed").alias("allowed"))
    best = best.groupBy("key").agg(F.min(F.struct("rank", "lo", "hi", "allowed")).alias("b"))
    return best.select("key", "b.allowed", F.explode(F.array_distinct(F.array("b.lo", "b.hi"))).alias("e")).select("key", "e.id", "allowed", "e.name")


# Look-up


class Index:
    """The variants of one shard in one BK-tree per threshold."""

    def __init__(self, keys: list[str], ids: list[int], allowed: list[int], names: list[str]) -> None:
        self.trees = []
        for radius in range(RADIUS + 1):
            own: dict[str, list[tuple[int, str]]] = {}
            for k, i, a, n in zip(keys, ids, allowed, names):
                if a == radius:
                    own.setdefault(k, []).append((i, n))
            self.trees.append((radius, BKTree(own), own))
        self.longest = max(map(len, keys), default=0)

    def winners(self, values: list[str]) -> list[tuple[int, int, int, int] | None]:
        """For each value the least (distance, distance of the words in order), with the lowest and highest entry there."""
        split = [words_of(v) for v in values]
        keys = ["".join(w) for w in split]
        ask = [k for k in dict.fromkeys(keys) if k and len(k) <= self.longest + RADIUS]
        near: dict[str, dict[int, dict[int, str]]] = {}
        for radius, tree, own in self.trees:
            for i, n, d in zip(*tree.search(ask, radius)):
                near.setdefault(ask[i], {}).setdefault(int(d), {}).update(own[tree.keys[n]])
        least = {k: (min(found), found[min(found)]) for k, found in near.items()}
        pairs = sorted({(" ".join(w), n) for w, k in zip(split, keys) if k in least and least[k][0] for n in least[k][1].values()})
        order = {}
        if pairs:
            order = dict(zip(pairs, distances(*_codes([p[0] for p in pairs], -1), *_codes([p[1] for p in pairs], -2))))
        out: list[tuple[int, int, int, int] | None] = []
        for w, k in zip(split, keys):
            if k not in least:
                out.append(None)
                continue
            d, entries = least[k]
            away = {i: int(order[" ".join(w), n]) if d else 0 for i, n in entries.items()}
            best = min(away.values())
            ids = [i for i, x in away.items() if x == best]
            out.append((d, best, min(ids), max(ids)))
        return out


_WON = "name string, dist int, away int, lo bigint, hi bigint"


def _look_up(left: pa.Table, right: pa.Table) -> pa.Table:
    """The winners of one shard for one chunk of names."""
    names = left.column("name").to_pylist()
    index = Index(*(right.column(c).to_pylist() for c in ("key", "id", "allowed", "vname")))
    rows = [(n, *found) for n, found in zip(names, index.winners(names)) if found]
    cols = list(zip(*rows)) or [[]] * 5
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()])], names=["name", "dist", "away", "lo", "hi"])


def map_names(names: DataFrame, reference: DataFrame) -> DataFrame:
    """``name, canon_id, dist`` for each distinct value of the one column of ``names``; canon_id 0 is unmatched."""
    column = names.columns[0]
    typed = names.select(F.col(column).alias("name")).filter(strip_space(F.col("name")) != "")
    return _mapped(cut(typed.distinct()), reference)


def _mapped(names: DataFrame, reference: DataFrame) -> DataFrame:
    spark = names.sparkSession
    ship(spark)
    known = cut(variants(reference))
    n = known.count()
    shards = max(1, -(-n // SHARD_VARIANTS))
    chunks = max(1, -(-names.count() // max(CHUNK_NAMES, n // shards)))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    asked = names.select("name", part("name", chunks).alias("chunk"), every(shards).alias("shard"))
    trees = known.select("key", "id", "allowed", F.col("name").alias("vname"), part("key", shards).alias("shard"), every(chunks).alias("chunk"))
    # By number, so that adaptive execution does not put small but slow groups into one task.
    tasks = min(shards * chunks, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked, trees = (df.repartition(tasks, "shard", "chunk") for df in (asked, trees))
    won = asked.groupBy("shard", "chunk").cogroup(trees.groupBy("shard", "chunk")).applyInArrow(_look_up, _WON)
    least = won.groupBy("name").agg(F.min(F.struct("dist", "away", "lo")).alias("a"), F.min(F.struct("dist", "away", (-F.col("hi")).alias("below"))).alias("b"))
    one = F.col("a.lo") == -F.col("b.below")
    found = least.select("name", F.when(one, F.col("a.lo")).alias("id"), F.when(one, F.col("a.dist")).alias("dist"))
    return names.select("name").join(found, "name", "left").select("name", F.coalesce("id", F.lit(0).cast("bigint")).alias("canon_id"), "dist")


def map_rows(rows: DataFrame, column: str, reference: DataFrame) -> DataFrame:
    """``rows`` with ``canon_id``; blank values leave no row. The join back is broadcast, or salted for hot values only."""
    typed = rows.filter(strip_space(F.col(column)) != "")
    counts = cut(typed.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("__n")))
    mapped = cut(_mapped(counts, reference).select(F.col("name").alias("__name"), "canon_id"))
    own = typed.withColumn("__name", F.col(column))
    if small(mapped):
        return own.join(F.broadcast(mapped), "__name").drop("__name")
    hot = hot_keys(counts.withColumnRenamed("name", "__name"), ["__name"])
    return salted_join(own, mapped, ["__name"], hot, rows.columns).drop("__name")
