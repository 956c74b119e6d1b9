"""Near copies by shingle similarity: SimHashes met through deletion variants, then extra signatures, checked on shingles.

Two texts are near copies at a Jaccard similarity of ``least`` or more between their sets of word shingles. Texts
whose 64-bit SimHashes differ in 3 bits or fewer meet in the index of deletion variants (``simhash.links``). At 0.8
SimHashes differ in about 10 bits, far beyond what these variants reach. Texts therefore also meet in an equality join
on extra signatures: each of BANDS keys is made of ROWS minimum hashes, which two texts at 0.8 share
in one key at least with chance 1 - (1 - 0.8^5)^20 = 0.9996. Of those that meet, pairs whose SimHashes differ in
SCREEN bits or fewer are compared shingle by shingle; only pairs at ``least`` or more are linked.

No group of a key is cut. One of up to SMALL texts is compared whole in the first round and is done. In a larger one
that round compares the edges of a forest of close SimHashes and keeps the key; later rounds deal texts by the kept
keys only. The second compares every text with the middle ones of the group's PIVOTS largest components. What is left are pairs of one group and different components. They are compared where the group
meets, with shingles sent only for texts that have such a partner, after a screen by their minimum hashes; only links
leave the task, so no table has a row for each pair of a group. Components are the same as with all pairs.

Shingles are kept by 32 bits of their hashes. Defined results: a null text equals the empty one; texts without
words are copies of each other; a text of fewer words than ``width`` is one shingle. A null id never names a
component that has an id. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import simhash
from assayer.llm.components import components
from assayer.llm.simhash import keep_least, leaving, majority, shingle_hashes, spread
from assayer.llm.staging import join_hot, scratch, small, staged

BANDS, ROWS = 20, 5
#: SimHashes of two texts at 0.8 differ in more bits than this with a chance below 1 in 1,000, short texts included.
SCREEN = 24
#: Of 100 minimum hashes two texts at 0.8 agree in fewer than this with a chance of 1 in 2,000.
AGREE = 66
#: SimHashes so close are likely near copies.
CLOSE = 8
SMALL = 8
PIVOTS = 4
_DRAW = np.random.default_rng(20)
_FACTOR = _DRAW.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def band_keys(hashes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The signatures of a set of shingle hashes, none of an empty one, and a byte of each minimum hash."""
    if not hashes.size:
        return np.empty(0, np.int64), bytes(BANDS * ROWS)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, hashes.size, 1 << 11):
        part = hashes[i : i + (1 << 11), None] * _FACTOR + _SHIFT
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    rows = np.c_[np.arange(BANDS, dtype=np.uint64), least.reshape(BANDS, ROWS)]
    keys = np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)
    return keys, (least >> np.uint64(40)).astype(np.uint8).tobytes()


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(_id, _fp, _mark, _keys, _bytes, _set) of each document: the set's hash, SimHash, signatures, bytes and shingles."""

    def each(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                names, marks, keys, parts, sets = [], [], [], [], []
                for text in batch.column(1).cast(pa.binary()).to_pylist():
                    hashes = np.unique(shingle_hashes(text or b"", width))
                    names.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                    marks.append(majority(hashes))
                    key, part = band_keys(hashes)
                    keys.append(key)
                    parts.append(part)
                    sets.append(np.unique((hashes >> np.uint64(32)).astype(np.uint32)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, marks)),
                        pa.array(keys, pa.list_(pa.int64())),
                        pa.array(parts, pa.binary()),
                        pa.array(sets, pa.binary()),
                    ],
                    ["_id", "_fp", "_mark", "_keys", "_bytes", "_set"],
                )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"_id {kind}, _fp long, _mark long, _keys array<long>, _bytes binary, _set binary")


class Group:
    """The texts of one key: SimHashes, components, numbers of shingles; bytes of minimum hashes and shingles if sent."""

    def __init__(self, least: float, marks: np.ndarray, roots: np.ndarray, sizes: np.ndarray, parts=None, sets=None):
        self.least, self.marks, self.roots, self.sizes, self.parts, self.sets = least, marks, roots, sizes, parts, sets
        self.size = marks.size

    def near(self, a, b) -> np.ndarray:
        """Which of the pairs pass the screens, and have sizes that allow the similarity; either side may be one place."""
        x, y = self.sizes[a], self.sizes[b]
        return (np.bitwise_count(self.marks[a] ^ self.marks[b]) <= SCREEN) & (np.minimum(x, y) >= self.least * np.maximum(x, y) - 1e-9)

    def small(self):
        a, b = np.triu_indices(self.size, 1)
        near = self.near(a, b)
        yield a[near], b[near]

    def first(self):
        """Of a small group all pairs, of another a forest of close ones; arrays of both places."""
        if self.size <= SMALL:
            yield from self.small()
            return
        rest = np.arange(self.size)
        while rest.size > 1:
            todo, rest = [rest[0]], rest[1:]
            while todo and rest.size:
                a = todo.pop()
                hit = np.bitwise_count(self.marks[rest] ^ self.marks[a]) <= CLOSE
                if hit.any():
                    near, rest = rest[hit], rest[~hit]
                    yield np.full(near.size, a), near
                    todo.extend(near)

    def second(self):
        """Of a large group the pairs of texts with the middle one of each of its largest other components."""
        if (self.roots == self.roots[0]).all():
            return
        bits = np.unpackbits(self.marks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, n = np.unique(self.roots, return_counts=True)
        for root in which[np.argsort(-n, kind="stable")[:PIVOTS]]:
            mine = np.flatnonzero(self.roots == root)
            middle = np.packbits(2 * bits[mine].sum(axis=0, dtype=np.int64) > mine.size, bitorder="little").view(np.uint64)[0]
            pivot = mine[np.argmin(np.bitwise_count(self.marks[mine] ^ middle))]
            others = np.flatnonzero(self.roots != root)
            near = others[self.near(others, pivot)]
            yield np.full(near.size, pivot), near

    def left(self):
        """Of a large group the texts, as pairs with themselves, that are near one of another component."""
        if (self.roots == self.roots[0]).all():
            return
        some = np.zeros(self.size, bool)
        for a in range(self.size - 1):
            others = a + 1 + np.flatnonzero(self.roots[a + 1 :] != self.roots[a])
            near = others[self.near(others, a)]
            some[near] = True
            some[a] |= near.size > 0
        yield np.flatnonzero(some), np.flatnonzero(some)

    def linked(self):
        """Links between components, enough to join them."""
        roots = self.roots.copy()
        parts = np.frombuffer(b"".join(self.parts), np.uint8).reshape(-1, BANDS * ROWS)
        sets = {}
        for a in range(self.size - 1):
            others = a + 1 + np.flatnonzero(roots[a + 1 :] != roots[a])
            others = others[self.near(others, a)]
            others = others[(parts[others] == parts[a]).sum(axis=1) >= AGREE]
            for b in others:
                if roots[a] == roots[b]:
                    continue
                x, y = (sets.setdefault(i, np.frombuffer(self.sets[i], np.uint32)) for i in (a, b))
                if _alike(x, y, self.least):
                    roots[roots == roots[b]] = roots[a]
                    yield np.array([a]), np.array([b])


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    both = np.intersect1d(x, y, assume_unique=True).size
    return both >= least * (x.size + y.size - both) - 1e-9


def _met(nodes: DataFrame, pairs_of, least: float, more: Sequence[str] = (), crowded: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs that ``pairs_of`` takes of the groups of equal keys.

    nodes has _fp, _mark, _root, _size and _keys, and the columns named in ``more``, which groups get as lists.
    With ``crowded`` only groups of its keys meet; without, the key of each group over SMALL comes as a row (key, null).
    """
    keyed = nodes.select(F.explode("_keys").alias("_key"), "_fp", "_mark", "_root", "_size", *more)
    if crowded is not None:
        keyed = keyed.join(crowded, "_key", "left_semi")
    keyed = keyed.repartition("_key").sortWithinPartitions("_key", "_fp")
    mark_crowded = crowded is None

    def out(keys, names, *columns):
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        size = np.diff(np.r_[first, keys.size])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for i, k in zip(first[size > 1], size[size > 1], strict=True):
            for a, b in pairs_of(Group(least, *(x[i : i + k] for x in columns))):
                held.append((names[i + a], names[i + b]))
                n += a.size
                if n > 100_000:
                    yield batch_of(held)
                    held, n = [], 0
        if held:
            yield batch_of(held)
        many = keys[first[size > SMALL]] if mark_crowded else keys[:0]
        if many.size:
            yield pa.RecordBatch.from_arrays([pa.array(many), pa.nulls(many.size, pa.int64())], ["a", "b"])

    def batch_of(held):
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def each(batches):
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key, name, mark, root, size = (batch.column(i).to_numpy() for i in range(5))
            held.append((key, name, mark.view(np.uint64), root, size, *(c.to_numpy(zero_copy_only=False) for c in batch.columns[5:])))
            if held[0][0][0] == key[-1]:
                continue  # one key so far
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [tuple(x[cut:] for x in columns)]
            yield from out(*(x[:cut] for x in columns))
        if held:
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keyed.mapInArrow(each, "a long, b long").distinct()


def _checked(pairs: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets are at ``least`` or more, written."""

    def each(batches):
        for batch in batches:
            ends = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            stay = [_alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in ends]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(stay, pa.bool_()))

    with scratch():
        pairs = staged(pairs, "pairs")
        ends = staged(pairs.select(F.col("a").alias("_fp")).union(pairs.select("b")).distinct(), "ends")
        sets = staged(rows.select("_fp", "_set").join(small(ends), "_fp", "left_semi").dropDuplicates(["_fp"]), "sets")
        both = pairs.join(sets.select(F.col("_fp").alias("a"), F.col("_set").alias("_x")), "a").join(
            sets.select(F.col("_fp").alias("b"), F.col("_set").alias("_y")), "b"
        )
        return staged(both.select("a", "b", "_x", "_y").mapInArrow(each, "a long, b long"), "links", outlive=True)


def _variants(nodes: DataFrame, most: int) -> DataFrame:
    """(a, b): pairs of sets that join those whose SimHashes are equal or within reach of deletion variants.

    One set stands for all of its SimHash.
    """
    marks = staged(nodes.groupBy("_mark").agg(F.min("_fp").alias("_own"), F.count("*").alias("_n")), "marks")
    same = join_hot(nodes.select("_mark", "_fp"), marks, "_mark", "_n", nodes.count()).filter("_fp <> _own").select("_own", "_fp")
    near = staged(simhash.links(marks.select(F.col("_mark").alias("_fp")), most), "near")
    own = marks.select("_mark", "_own")
    near = near.join(own.toDF("a", "_x"), "a").join(own.toDF("b", "_y"), "b").select("_x", "_y")
    return same.union(near).toDF("a", "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def links(rows: DataFrame, least: float = 0.8, most: int = 3) -> DataFrame:
    """(a, b): links between sets of column _fp, enough to join all pairs found at ``least`` or more.

    ``most`` is how many bits deletion variants reach.
    """
    size = (F.octet_length("_set") / 4).cast("int").alias("_size")
    nodes = staged(rows.select("_fp", "_mark", "_keys", size).dropDuplicates(["_fp"]), "nodes")

    def rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
        roots = small(components(links).select(F.col("node").alias("_fp"), "root"))
        return nodes.join(roots, "_fp", "left").withColumn("_root", F.coalesce("root", "_fp")).drop("root")

    met = staged(_met(nodes.withColumn("_root", F.col("_fp")), Group.first, least), "met")
    crowded = small(staged(met.filter("b IS NULL").select(F.col("a").alias("_key")), "crowded"))
    found = _checked(met.filter("b IS NOT NULL").union(_variants(nodes, most)).distinct(), rows, least)
    found = found.union(_checked(_met(rooted(nodes, found), Group.second, least, crowded=crowded), rows, least))
    known = staged(rooted(nodes, found), "rooted")
    left = staged(_met(known, Group.left, least, crowded=crowded).select(F.col("a").alias("_fp")), "left")
    whole = rows.select("_fp", "_bytes", "_set").join(small(left), "_fp", "left_semi").dropDuplicates(["_fp"])
    whole = small(staged(whole, "whole"), 1 << 12)
    return found.union(staged(_met(known.join(whole, "_fp"), Group.linked, least, ["_bytes", "_set"], crowded), "links"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, least: float = 0.8) -> DataFrame:
    """The input's rows and columns, one row for each component of near copies: that with the smallest id."""
    with scratch():
        rows = staged(signed(docs, id_col, text_col, width), "similar")
        named = spread(rows.select("_id", "_fp"), components(links(rows, least)))
        lost, again = leaving(named)
    return keep_least(docs, lost, again, id_col, text_col)
