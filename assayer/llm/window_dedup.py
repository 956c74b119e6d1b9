"""Repeated windows by a depth-limited radix sort of suffixes.

Suffixes are sorted by their first ``window`` bytes only, most significant digit first, and a pass keeps just
the groups of equal suffixes that a further digit can still split; groups equal through the last digit are
exactly the repeated windows.

Digit 0 is an anchor: of the ``window - GRAM + 1`` grams of ``GRAM`` bytes in a window, the one with the least
hash (the first on a tie). Equal windows have the same anchor at the same place, so no repeat is lost, and
neighbouring windows share theirs: the first sort has a row for each run of windows with one anchor, about one
for every 27 bytes, instead of one for each byte. Digit 1 is the run's whole context (all bytes of its
windows). A run whose context starts earlier elsewhere is repeated in all its windows and leaves the sort; what
is left are first runs whose anchor has other contexts too, at the edges of repeats. Digit 2 is the window
itself, for these runs alone.

Sorts are Spark's external sorts; a task streams through its groups and holds a batch and one row. Digests are
64-bit polynomial hashes of the bytes, of two kinds with different bases and byte tables. Windows of digit 2 are
equal where both kinds agree; contexts are where the anchor's hash of one kind and the context's of the other do,
so that only contexts of one anchor can be mistaken for each other, by 64 bits.

A passage that many documents share makes hot groups. Anchors with more than about one in 1,024 of all runs are
found first, by a pass that adds up what is frequent in each block (``hot_anchors``; at most 2,048 are kept, with no
bound on what each may hold). They are dealt by anchor and context instead of by anchor alone, and the first run of
each of their contexts is left to digit 2 without asking for others. Before any shuffle, a task keeps the first of the equal contexts or windows
that it has met; later ones are repeats whatever other tasks hold, and travel on as such, dealt by document.

Documents are cut into blocks of ``BLOCK`` window starts for memory's sake; a run ends at a block's end, which
changes what is left to digit 2 but not the result.

Defined results: a null text equals the empty one; a text shorter than the window is never touched. Windows are
ordered by (id, start); a null id is least. Ids may be of any type that has an order. Rows of equal id and text are
one document, which repeats nothing of itself but what starts earlier in it; unequal texts at one id are documents of
their own, in the order of their texts' hashes. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.staging import numbered, staged

GRAM = 50
BLOCK = 1 << 19
_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_LOW = np.uint64((1 << 24) - 1)


def _powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    out = []
    for base in _BASES:
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        out.append(tuple(pair))
    return tuple(out)


class Hasher:
    """Digests of any stretch of a buffer of up to ``size`` bytes."""

    def __init__(self, size: int):
        self.size, self.powers = size, _powers(size)

    def load(self, data: np.ndarray, which: tuple[int, ...] = (0, 1)) -> None:
        self.sums = {}
        for i in which:
            terms = _TABLES[i][data] * self.powers[i][0][: data.size]
            self.sums[i] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])

    def of(self, i: int, start, stop) -> np.ndarray:
        x = (self.sums[i][stop] - self.sums[i][start]) * self.powers[i][1][start]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))

    def grams(self, i: int, width: int) -> np.ndarray:
        sums, back = self.sums[i], self.powers[i][1]
        n = sums.size - width
        x = (sums[width:] - sums[:n]) * back[:n]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    reach, n = 1, x.size - width + 1
    while 2 * reach <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach : width - reach + n])


def runs(hasher: Hasher, docs: list[tuple[int, int]], window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: buffer position of the first, windows, anchor hash, anchor place.

    ``docs``: (start, stop) of each document in the loaded buffer.
    """
    gram = min(GRAM, window)
    hashes = hasher.grams(0, gram)
    tagged = (hashes & ~_LOW) | np.arange(hashes.size, dtype=np.uint64)
    anchor = (least_of(tagged, window - gram + 1) & _LOW).astype(np.int64)
    valid = np.zeros(anchor.size + 1, np.int8)
    for start, stop in docs:
        if stop - start >= window:
            valid[start] += 1
            valid[stop - window + 1] -= 1
    inside = np.cumsum(valid[:-1]) > 0
    begins = inside.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    for start, stop in docs:
        if stop - start >= window:
            begins[start] = True
    first = np.flatnonzero(begins)
    edge = begins | ~inside
    edges = np.r_[np.flatnonzero(edge), anchor.size]
    length = edges[np.searchsorted(edges, first, "right")] - first
    return first, length, hashes[anchor[first]], anchor[first] - first


def _blocks(texts: list[bytes], window: int):
    """Buffers of blocks: (bytes, [(document, offset in it, start, stop in the buffer)])."""
    held, size, where = [], 0, []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - window + 1), BLOCK):
            part = text[at : at + BLOCK + window - 1]
            if len(part) < window:
                continue
            if size and size + len(part) > BLOCK + window:
                yield b"".join(held), where
                held, size, where = [], 0, []
            where.append((i, at, size, size + len(part)))
            held.append(part)
            size += len(part)
    if where:
        yield b"".join(held), where


def _loaded(texts: list[bytes], window: int, hasher: Hasher):
    for data, where in _blocks(texts, window):
        hasher.load(np.frombuffer(data, np.uint8))
        first, length, gram, place = runs(hasher, [(a, b) for _, _, a, b in where], window)
        starts = np.array([w[2] for w in where])
        slot = np.searchsorted(starts, first, "right") - 1
        doc = np.array([w[0] for w in where])[slot]
        at = first - starts[slot] + np.array([w[1] for w in where])[slot]
        yield first, length, gram, place, doc, at


def _bytes(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class _Firsts:
    """The first place that a task has met of each key that it met twice in a buffer; forgets all when full."""

    def __init__(self, most: int = 200_000):
        self.most, self.held = most, {}
        self.maybe = np.zeros(1 << 22, bool)  # by the low bits of a key held

    def later(self, a: np.ndarray, b: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> np.ndarray:
        """Rows before which this task has met the same key (a, b) at a smaller (doc, loc)."""
        out = np.zeros(a.size, bool)
        order = np.argsort(a, kind="stable")
        twin = a[order][1:] == a[order][:-1]
        some = order[np.r_[twin, False] | np.r_[False, twin] | self.maybe[a[order] & (self.maybe.size - 1)]] if a.size else order
        if not some.size:
            return out
        some = some[np.lexsort((loc[some], doc[some], b[some], a[some]))]
        a, b, doc, loc = a[some], b[some], doc[some], loc[some]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[first, a.size])
        owner = np.repeat(first, size)
        later = (doc != doc[owner]) | (loc != loc[owner])
        if len(self.held) + first.size > self.most:
            self.held.clear()
            self.maybe[:] = False
        for i, n, key in zip(first.tolist(), size.tolist(), zip(a[first].tolist(), b[first].tolist(), strict=True), strict=True):
            at = (int(doc[i]), int(loc[i]))
            before = self.held.get(key)
            if before is not None and before < at:
                later[i : i + n] = True
            elif before is not None or n > 1:
                self.held[key] = at
                self.maybe[key[0] & (self.maybe.size - 1)] = True
        out[some] = later
        return out


def hot_anchors(docs: DataFrame, window: int, share: int = 1024) -> np.ndarray:
    """Anchor hashes with more than one in ``share`` of all runs; at most twice ``share`` of them.

    What makes less than one in 4 x ``share`` of a block's runs is left out of that block's sums, so the sums are
    short by no more than that part of all runs.
    """

    def each(batches):
        hasher = Hasher(BLOCK + 2 * window)
        for batch in batches:
            for data, where in _blocks(_bytes(batch.column(0)), window):
                hasher.load(np.frombuffer(data, np.uint8), (0,))
                _, _, gram, _ = runs(hasher, [(a, b) for _, _, a, b in where], window)
                which, n = np.unique(gram, return_counts=True)
                often = n * 4 * share >= gram.size
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[which[often].view(np.int64), np.int64(0)]),
                        pa.array(np.r_[n[often], 0].astype(np.int64)),
                        pa.array(np.r_[np.zeros(often.sum(), np.int64), gram.size]),
                    ],
                    ["h", "n", "rows"],
                )

    sums = staged(
        docs.select("_text").mapInArrow(each, "h long, n long, rows long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")),
        "anchors",
    )
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = sums.filter(F.col("n") * (2 * share) > total).select("h").collect()
    return np.array(sorted(r["h"] for r in hot), np.int64)


def anchored(docs: DataFrame, window: int, hot: np.ndarray) -> DataFrame:
    """(h, c, doc, loc, known) of every run.

    Anchor hash, context hash, document, start * 128 + windows - 1, and whether the run is known to be a repeat.
    """

    def each(batches):
        hasher, firsts = Hasher(BLOCK + 2 * window), _Firsts()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, length, gram, place, doc, at in _loaded(_bytes(batch.column(1)), window, hasher):
                context = hasher.of(1, first, first + length - 1 + window)
                context = context + (length * 128 + place).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
                h, c, doc, loc = gram.view(np.int64), context.view(np.int64), ids[doc], at * 128 + length - 1
                known = np.zeros(h.size, bool)
                some = np.flatnonzero(np.isin(h, hot))
                known[some] = firsts.later(h[some], c[some], doc[some], loc[some])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, doc, loc, known)], ["h", "c", "doc", "loc", "known"])

    return docs.select("_doc", "_text").mapInArrow(each, "h long, c long, doc long, loc long, known boolean")


def _streamed(batches, columns: int):
    """Batches as tuples of arrays, without empty ones."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns))


def sort_runs(rows: DataFrame, hot: np.ndarray) -> DataFrame:
    """Digits 0 and 1. (doc, loc, whole): runs repeated as a whole, and first runs left to digit 2."""

    def each(batches):
        held = None  # the row before, whether its anchor's first run is still to be told, and that run
        for h, c, doc, loc, known in _streamed(batches, 5):
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[known]), pa.array(loc[known]), pa.array(known[known])], ["doc", "loc", "whole"]
            )
            h, c, doc, loc = (x[~known] for x in (h, c, doc, loc))
            if not h.size:
                continue
            same_h = np.r_[held is not None and held["h"] == h[0], h[1:] == h[:-1]]
            same_c = same_h & np.r_[held is not None and held["c"] == c[0], c[1:] == c[:-1]]
            # Contexts of a hot anchor are not together; the first run of each is left to digit 2.
            hot_row = np.isin(h, hot)
            same_h &= same_c | ~hot_row
            again = same_c & np.r_[
                held is not None and (held["doc"], held["loc"]) == (doc[0], loc[0]),
                (doc[1:] == doc[:-1]) & (loc[1:] == loc[:-1]),
            ]
            later = (same_h | hot_row) & ~same_c  # first runs after their anchor's first, or of a hot anchor
            out_doc, out_loc, out_whole = [doc[later]], [loc[later]], [np.zeros(later.sum(), bool)]
            # A row that repeats a (document, place) just seen is that row again. The first run of a context
            # owns it; a row is repeated if it is not at its owner's place.
            start_c = np.flatnonzero(~same_c)
            owner = np.searchsorted(start_c, np.arange(h.size), "right") - 1
            own_doc = np.r_[held["own"][0] if held else 0, doc[start_c]][owner + 1]
            own_loc = np.r_[held["own"][1] if held else 0, loc[start_c]][owner + 1]
            repeated = same_c & ~again & ((doc != own_doc) | (loc != own_loc))
            out_doc.append(doc[repeated])
            out_loc.append(loc[repeated])
            out_whole.append(np.ones(repeated.sum(), bool))
            # The first run of an anchor is left to digit 2 if another context follows.
            start_h = np.flatnonzero(~same_h)
            group = np.searchsorted(start_h, np.flatnonzero(same_h & ~same_c), "right") - 1
            if held and held["first"] is not None and (group < 0).any():
                out_doc.append(np.array([held["first"][0]]))
                out_loc.append(np.array([held["first"][1]]))
                out_whole.append(np.zeros(1, bool))
                held["first"] = None
            more = np.unique(group[group >= 0])
            out_doc.append(doc[start_h[more]])
            out_loc.append(loc[start_h[more]])
            out_whole.append(np.zeros(more.size, bool))
            if start_h.size:
                told = more.size and more[-1] == start_h.size - 1
                first = None if told else (doc[start_h[-1]], loc[start_h[-1]])
            else:
                first = held["first"]
            held = {"h": h[-1], "c": c[-1], "doc": doc[-1], "loc": loc[-1], "own": (own_doc[-1], own_loc[-1]), "first": first}
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (out_doc, out_loc, out_whole)], ["doc", "loc", "whole"]
            )

    deal = F.when(F.col("known"), F.xxhash64("doc", "loc"))
    if hot.size:
        deal = deal.when(F.col("h").isin(hot.tolist()), F.xxhash64("h", "c"))
    return (
        rows.repartition(deal.otherwise(F.col("h")))
        .sortWithinPartitions("known", "h", "c", "doc", "loc")
        .mapInArrow(each, "doc long, loc long, whole boolean")
    )


def open_windows(docs: DataFrame, left: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc, start, known): every window of the runs that are left."""
    picked = left.groupBy("doc").agg(F.collect_set("loc").alias("locs"))
    joined = docs.join(picked, docs["_doc"] == picked["doc"]).select("_doc", "_text", "locs")

    def each(batches):
        hasher, firsts = Hasher(BLOCK + 2 * window), _Firsts()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            wanted = {}
            for i, loc in zip(owner, lists.flatten().to_numpy(), strict=True):
                wanted.setdefault(i, []).append(loc)
            for first, length, _, _, doc, at in _loaded(_bytes(batch.column(1)), window, hasher):
                keys = [np.asarray(wanted.get(i, ()), np.int64) for i in np.unique(doc)]
                pick = np.zeros(first.size, bool)
                for i, key in zip(np.unique(doc), keys, strict=True):
                    mine = doc == i
                    pick[mine] = np.isin(at[mine] * 128 + length[mine] - 1, key)
                n = length[pick]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(first[pick], n) + step
                w1, w2 = (hasher.of(i, begin, begin + window).view(np.int64) for i in (0, 1))
                doc, start = ids[np.repeat(doc[pick], n)], np.repeat(at[pick], n) + step
                known = firsts.later(w1, w2, doc, start)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w1, w2, doc, start, known)], ["w1", "w2", "doc", "start", "known"])

    return joined.mapInArrow(each, "w1 long, w2 long, doc long, start long, known boolean")


def sort_windows(rows: DataFrame) -> DataFrame:
    """Digit 2. (doc, loc): windows that start earlier elsewhere, as runs of one."""

    def each(batches):
        held = None
        for w1, w2, doc, start, known in _streamed(batches, 5):
            yield pa.RecordBatch.from_arrays([pa.array(doc[known]), pa.array(start[known] * 128)], ["doc", "loc"])
            w1, w2, doc, start = (x[~known] for x in (w1, w2, doc, start))
            if not w1.size:
                continue
            same = np.r_[held is not None and held[:2] == (w1[0], w2[0]), (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])]
            firsts = np.flatnonzero(~same)
            owner = np.searchsorted(firsts, np.arange(w1.size), "right")
            own_doc = np.r_[held[2] if held else 0, doc[firsts]][owner]
            own_start = np.r_[held[3] if held else 0, start[firsts]][owner]
            repeated = same & ((doc != own_doc) | (start != own_start))
            held = (w1[-1], w2[-1], own_doc[-1], own_start[-1])
            yield pa.RecordBatch.from_arrays([pa.array(doc[repeated]), pa.array(start[repeated] * 128)], ["doc", "loc"])

    return (
        rows.repartition(F.when(F.col("known"), F.xxhash64("doc", "start")).otherwise(F.xxhash64("w1", "w2")))
        .sortWithinPartitions("known", "w1", "w2", "doc", "start")
        .mapInArrow(each, "doc long, loc long")
    )


def spans(locs: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal covered stretches of the windows that the runs hold."""
    found: list[list[int]] = []
    for loc in np.unique(locs):
        start, stop = int(loc >> 7), int((loc >> 7) + (loc & 127) + window)
        if found and start <= found[-1][1]:
            found[-1][1] = max(found[-1][1], stop)
        else:
            found.append([start, stop])
    return [(a, b) for a, b in found]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 100, hot_share: int = 1024
) -> DataFrame:
    """A row for each input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left).

    An anchor with more than one in ``hot_share`` of all runs is dealt by its contexts.
    """
    if not GRAM < window <= GRAM + 127:
        raise ValueError(f"the window must have {GRAM + 1} to {GRAM + 127} bytes")
    rows = numbered(docs, id_col, text_col)
    hot = hot_anchors(rows, window, hot_share)
    sorted_runs = staged(sort_runs(anchored(rows, window, hot), hot), "runs")
    left = sorted_runs.filter("NOT whole").select("doc", "loc")
    found = staged(sort_windows(open_windows(rows, left, window)), "windows")
    flags = (
        sorted_runs.filter("whole").select("doc", "loc").union(found).groupBy("doc").agg(F.collect_set("loc").alias("locs"))
    )
    joined = rows.join(flags, rows["_doc"] == flags["doc"], "left").select("_id", "_text", "locs")

    def each(batches):
        for batch in batches:
            texts = _bytes(batch.column(1))
            n_removed, n_spans, digest, kept = [], [], [], []
            for i, text in enumerate(texts):
                locs = batch.column(2)[i]
                cut = spans(locs.values.to_numpy(), window) if locs.is_valid else []
                cut = [(a, min(b, len(text))) for a, b in cut if a < len(text)]
                rest, at = [], 0
                for a, b in cut:
                    rest.append(text[at:a])
                    at = b
                rest = b"".join([*rest, text[at:]])
                n_removed.append(len(text) - len(rest))
                n_spans.append(len(cut))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(n_spans, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(kept, pa.binary()),
                ],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    return joined.mapInArrow(
        each, f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).withColumnRenamed("_id", id_col)
