"""Language-model scores from a log-frequency Bloom filter.

Counts are quantised on a scale that is exact for small numbers and grows by ``STEP`` beyond. An n-gram whose
count is at level q is put into the filter under (n-gram, 1) to (n-gram, q); its count is read back by probing
level after level until one is missing. Errors are one-sided: a level too many where a probe hits by chance.

The filter is independent blocks of ``BLOCK_BITS`` bits. A pair's block is that of its context, or, for a context that
is frequent, one of as many as it needs; a task builds a block and says what it kept of each context. Blocks are built
in parallel and put together on the driver. Their number grows with the training tokens, and so does that of the words
whose pairs the filter holds (the most frequent ones); ``most_blocks`` (128 MB) and ``most_pair_words`` bound what is
broadcast, not what the model knows. What the filter has no room for is left to joins: pairs with another word, pairs
below the least count of a block too small for its entries, and the counts and back-off masses of words beyond
``hot_words``. Their counts are exact and read on the same scale. Every word counts, and every pair that occurs twice.

The model is Katz back-off over pairs: P(w | v) is the discounted count read for the pair over v's count where the
filter has the pair, else the mass left over times P(w), over the unigram mass of what v's pairs do not cover. After a
word without counted pairs, P(w) is used. P(w) has add-0.1 smoothing over the counts read; its sum over all words and
one unseen is 1, and so is that of P(w | v), but for chance hits of probes. Back-off masses are kept exactly, two
numbers for each context. Workers score every place as if pairs left to joins were unseen and words beyond
``hot_words`` unseen and never contexts with pairs; joins on words and on pairs add what that is short of.

The base score needs the exact count of every token of every document. Words among the ``hot_words`` most
frequent (a fixed number, so their broadcast is bounded) are looked up in the worker; the others, each in few
documents, meet their counts in an equi-join on the word, which no hot key skews.

Defined results: a null text equals the empty one, which is an end token. Rows with equal id get a row each. A
null id is held out if the CRC of no bytes (0) says so, which it does. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.staging import scratch, small, staged

ADD = 0.1
END = "\n"  # no word has a line break
START = "\r"  # the context of a first word
STEP = 1.2
PROBES = 3
BLOCK_BITS = 1 << 18
#: Entries a block may hold for each bit.
LOAD = 1 / 8
DISCOUNT = 0.5
#: Training tokens, or distinct ones, for one block; training tokens for one word whose pairs the filter holds.
BLOCK_TOKENS = 1 << 16
BLOCK_WORDS = 1 << 12
#: Training tokens for one bucket of the pairs that have no block.
BUCKET_TOKENS = 1 << 20
WORD_TOKENS = 1 << 10
FOLDS = 10
_FOLLOW, _REST = 1, 2


def _levels() -> np.ndarray:
    """The least count of each level, from level 1."""
    steps = [1]
    while steps[-1] < 1 << 45:
        steps.append(max(steps[-1] + 1, int(steps[-1] * STEP)))
    return np.array(steps, np.int64)


LEAST = _levels()
#: The count that a level stands for: the middle of its range; 0 for level 0.
WORTH = np.r_[0.0, (LEAST[:-1] + LEAST[1:] - 1) / 2, LEAST[-1]]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEAST, counts, "right")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def held_out(ids: list, folds: int = FOLDS) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0 for i in ids], bool)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_key(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def unit_keys(words: np.ndarray) -> np.ndarray:
    return _mix(words + np.uint64(1))


def pair_keys(context: np.ndarray, words: np.ndarray) -> np.ndarray:
    return _mix(_mix(context + np.uint64(2)) ^ (words * np.uint64(0x9E3779B97F4A7C15)))


def word_homes(words: np.ndarray, blocks: int) -> np.ndarray:
    return (_mix(words) % np.uint64(blocks)).astype(np.int64)


def pair_homes(context: np.ndarray, words: np.ndarray, spread: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each pair; ``spread`` is how many blocks the pair's context is dealt to."""
    part = (_mix(words) % spread.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (_mix(context + part) % np.uint64(blocks)).astype(np.int64)


def spread_of(counts: np.ndarray) -> np.ndarray:
    """A context's blocks, by its count: one for each 16th of a block's tokens."""
    return 1 + np.asarray(counts, np.int64) // (BLOCK_TOKENS // 16)


def _hashes(keys: np.ndarray, level: np.ndarray) -> np.ndarray:
    """One hash of each n-gram and level; a probe takes its own stretch of bits of it."""
    return _mix(keys ^ ((level.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)))


def _bits(hashes: np.ndarray, probe: int) -> np.ndarray:
    return ((hashes >> np.uint64(21 * probe)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64)


class Filter:
    """The blocks side by side."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.data = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)

    def block_of(self, words: np.ndarray) -> np.ndarray:
        return word_homes(words, self.blocks)

    def has(self, keys: np.ndarray, block: np.ndarray, level: np.ndarray) -> np.ndarray:
        alive = np.arange(keys.size)
        hashes, base = _hashes(keys, level), block * BLOCK_BITS
        for probe in range(PROBES):
            bit = base + _bits(hashes, probe)
            hit = (self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            alive, hashes, base = alive[hit], hashes[hit], base[hit]
        out = np.zeros(keys.size, bool)
        out[alive] = True
        return out

    def levels(self, keys: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Probe each key's levels from 1 until one is missing."""
        found = np.zeros(keys.size, np.int64)
        alive = np.arange(keys.size)
        while alive.size:
            alive = alive[self.has(keys[alive], block[alive], found[alive] + 1)]
            found[alive] += 1
        return found


def _fill(block: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> None:
    keys = np.repeat(keys, levels)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    hashes = _hashes(keys, level)
    for probe in range(PROBES):
        bit = _bits(hashes, probe)
        np.bitwise_or.at(block, bit >> 3, np.uint8(1) << (bit & 7).astype(np.uint8))


def build_block(units: np.ndarray, unit_n: np.ndarray, context: np.ndarray, word: np.ndarray, pair_n: np.ndarray, hot: dict[int, int]) -> dict:
    """One block's filter from words and counts, and pairs and counts.

    bits; worth, the counts to be read for the words kept; lost_words and lost_pairs, the numbers of those that did not fit; left_contexts, left_words and left_n, the
    pairs that did not; and for each context its key, its pairs' number and sum of counts to be read, and the sum of the counts to be read for the
    words of its pairs, each with ``ADD``.
    """
    entries = np.r_[level_of(unit_n), level_of(pair_n)]
    counts = np.r_[unit_n, np.maximum(0, pair_n - 1)]  # a pair seen once tells nothing
    least = 1
    while entries[counts >= least].sum() > LOAD * BLOCK_BITS:
        least += max(1, least // 8)
    block = np.zeros(BLOCK_BITS // 8, np.uint8)
    kept = unit_n >= least
    _fill(block, unit_keys(units[kept]), level_of(unit_n[kept]))
    worth = float(WORTH[level_of(unit_n[kept])].sum())
    lost_words = int((~kept).sum())
    left = (pair_n - 1 < least) & (pair_n > 1)
    kept = pair_n - 1 >= least
    left_context, left_word, left_n = context[left], word[left], pair_n[left]
    context, word, pair_n = context[kept], word[kept], pair_n[kept]
    _fill(block, pair_keys(context, word), level_of(pair_n))
    which, at = np.unique(context, return_inverse=True)
    read = WORTH[level_of(pair_n)]
    of_words = WORTH[level_of(np.array([hot[int(w)] for w in word], np.int64))] + ADD
    return {
        "bits": block.tobytes(),
        "worth": worth,
        "lost_words": lost_words,
        "lost_pairs": int(left.sum()),
        "left_contexts": left_context.view(np.int64),
        "left_words": left_word.view(np.int64),
        "left_n": left_n,
        "contexts": which.view(np.int64),
        "pairs": np.bincount(at, minlength=which.size).astype(float),
        "read": np.bincount(at, read, which.size),
        "words": np.bincount(at, of_words, which.size),
    }


def train_counts(docs: DataFrame) -> DataFrame:
    """(token, c): how often each token is in the rows not held out; the end token too."""

    def each(batches):
        held: Counter[bytes] = Counter()
        ends = 0

        def out():
            tokens = list(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens, pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["token", "c"]
            )

        for batch in batches:
            out_of = held_out(batch.column(0).to_pylist())
            for test, text in zip(out_of, batch.column(1).to_pylist(), strict=True):
                if test:
                    continue
                held.update(words_of(text))
                ends += 1
                if len(held) > 400_000:
                    yield out()
                    held.clear()
        held[END.encode()] = ends
        yield out()

    return docs.mapInArrow(each, "token string, c long").groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0")


def _pair_blobs(docs: DataFrame, shared, blocks: int, buckets: int) -> DataFrame:
    """(block, kind, keys, counts) of pairs, partial; pairs that the filter is not for are in buckets after the blocks."""

    def each(batches):
        top = shared.value
        number = {w: i for i, w in enumerate(top["pair_words"])}
        keys = top["pair_keys"]
        n = len(keys)
        spread = spread_of(top["pair_counts"])
        start, end = number[START.encode()], number[END.encode()]
        held: list[np.ndarray] = []
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        size = rest_size = 0

        def out(kind, home, pairs, count):
            order = np.argsort(home, kind="stable")
            pairs, count, home = pairs[order], count[order], home[order]
            cut = np.flatnonzero(np.r_[True, np.diff(home) != 0, True]) if home.size else np.zeros(1, int)
            rows = list(zip(cut[:-1], cut[1:], strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(home[i]) for i, _ in rows], pa.int32()),
                    pa.array([kind] * len(rows), pa.int32()),
                    pa.array([pairs[i:j].tobytes() for i, j in rows], pa.binary()),
                    pa.array([count[i:j].astype(np.uint32).tobytes() for i, j in rows], pa.binary()),
                ],
                ["block", "kind", "keys", "counts"],
            )

        def hot_out():
            code, count = np.unique(np.concatenate(held), return_counts=True)
            a, b = code // n, code % n
            return out(_FOLLOW, pair_homes(keys[a], keys[b], spread[a], blocks), np.c_[a, b].astype(np.uint32), count)

        def rest_out():
            a, b = (np.concatenate(x) for x in zip(*rest, strict=True))
            code, at, count = np.unique(pair_keys(a, b), return_index=True, return_counts=True)
            home = blocks + (code % np.uint64(buckets)).astype(np.int64)
            return out(_REST, home, np.c_[a[at], b[at]], count)

        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                ids_of = _Ids(number)
                lines = [
                    [start, *(ids_of[w] for w in words_of(text)), end]
                    for test, text in zip(held_out(batch.column(0).to_pylist()), batch.column(1).to_pylist(), strict=True)
                    if not test
                ]
                if not lines:
                    continue
                ids = np.fromiter(chain.from_iterable(lines), np.int64)
                a, b = ids[:-1], ids[1:]
                inside = a != end
                both = inside & (a < n) & (b < n)
                held.append(a[both] * n + b[both])
                size += held[-1].size
                other = inside & ~both
                of = np.r_[keys, np.array([word_key(w) for w in list(ids_of)[n:]], np.uint64)]
                rest.append((of[a[other]], of[b[other]]))
                rest_size += int(other.sum())
                if size > 4_000_000:
                    yield hot_out()
                    held, size = [], 0
                if rest_size > 2_000_000:
                    yield rest_out()
                    rest, rest_size = [], 0
        if held:
            yield hot_out()
            yield rest_out() if rest else out(_REST, *(np.empty(0, np.int64),) * 3)

    return docs.mapInArrow(each, "block int, kind int, keys binary, counts binary")


@dataclass
class Model:
    """What the scoring needs beside the filter: the smoothed total, and a context's share and back-off weight."""

    bloom: Filter
    mass: float
    contexts: np.ndarray  # sorted keys
    whole: np.ndarray
    weight: np.ndarray
    spread: np.ndarray
    short: np.ndarray  # which blocks leave pairs to the join
    left: Filter  # has all pairs left to the join, and some others


def _worth(column: Column) -> Column:
    """The count that a count is read as."""

    @F.pandas_udf("double")
    def read(counts: pd.Series) -> pd.Series:
        return pd.Series(WORTH[level_of(counts.to_numpy())])

    return read(column)


def build_blocks(docs: DataFrame, shared, blocks: int, buckets: int) -> DataFrame:
    """A row for each block, and for each bucket of pairs that have none: what ``build_block`` makes."""
    cached: dict[str, object] = {}

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        top = shared.value
        words, units = top["pair_keys"], top["hot_keys"]
        if not cached:
            cached["counts"] = dict(zip(words.tolist(), top["pair_counts"], strict=True))
            cached["homes"] = word_homes(units, blocks)
        none = np.empty(0, np.int64)

        def joined(column: str, of) -> np.ndarray:
            return np.frombuffer(b"".join(rows[column]), of)

        n = joined("counts", np.uint32)
        if key[0] < blocks:
            pairs = joined("keys", np.uint32).reshape(-1, 2).astype(np.int64)
            code, at = np.unique(pairs[:, 0] * len(words) + pairs[:, 1], return_inverse=True)
            n = np.bincount(at.reshape(-1), n, code.size).astype(np.int64)
            mine = cached["homes"] == key[0]
            made = build_block(units[mine], top["hot_counts"][mine], words[code // len(words)], words[code % len(words)], n, cached["counts"])
        else:
            pairs = joined("keys", np.uint64).reshape(-1, 2)
            code, first, at = np.unique(pair_keys(pairs[:, 0], pairs[:, 1]), return_index=True, return_inverse=True)
            n = np.bincount(at.reshape(-1), n, code.size).astype(np.int64)
            pairs, n = pairs[first[n > 1]], n[n > 1]
            made = {
                "bits": b"",
                "lost_pairs": 0,
                "left_contexts": pairs[:, 0].copy().view(np.int64),
                "left_words": pairs[:, 1].copy().view(np.int64),
                "left_n": n,
            } | dict.fromkeys(("contexts", "pairs", "read", "words"), none)
        return pd.DataFrame([{"block": key[0]} | {k: v for k, v in made.items() if k not in ("worth", "lost_words")}])

    # A block may have words and no pairs.
    empty = docs.sparkSession.range(blocks).select(F.col("id").cast("int"), F.lit(_FOLLOW), F.lit(b""), F.lit(b""))
    return _pair_blobs(docs, shared, blocks, buckets).union(empty).groupBy("block").applyInPandas(
        each,
        "block int, bits binary, lost_pairs long, left_contexts array<long>, left_words array<long>, left_n array<long>,"
        " contexts array<long>, pairs array<double>, read array<double>, words array<double>",
    )


def left_filter(pairs: DataFrame, most: int) -> Filter:
    """At most ``most`` blocks with all pairs of column _pair; the fuller, the more others seem to be there too."""
    whole = Filter(min(most, pairs.count() * 8 // BLOCK_BITS + 1))

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        block = np.zeros(BLOCK_BITS // 8, np.uint8)
        _fill(block, rows["_pair"].to_numpy(np.int64).view(np.uint64), np.ones(len(rows), np.int64))
        return pd.DataFrame([{"block": key[0], "bits": block.tobytes()}])

    homes = pairs.select("_pair", F.pmod("_pair", F.lit(whole.blocks)).cast("int").alias("block"))
    for r in staged(homes.groupBy("block").applyInPandas(each, "block int, bits binary"), "left").toLocalIterator():
        at = r["block"] * BLOCK_BITS // 8
        whole.data[at : at + BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    return whole


def build_model(docs: DataFrame, counts: DataFrame, shared, blocks: int, total: int, vocabulary: int) -> tuple[Model, DataFrame, DataFrame]:
    """The filter and its model, on the driver, and what is left to joins.

    At most ``blocks`` blocks, and two numbers for each frequent context. The joins' tables: (token, c, _weight) of
    each word, log10 of its back-off weight as a context; (_pair, _more) of each pair that the filter doesn't hold,
    what its log10 probability has beyond that of an unseen pair. Of what is staged, only what these read outlives
    the caller's ``scratch``.
    """
    spark, top = docs.sparkSession, shared.value
    made = staged(build_blocks(docs, shared, blocks, max(16, total // BUCKET_TOKENS)), "blocks")
    whole = Filter(blocks)
    short = np.zeros(blocks, bool)
    parts = []
    for r in made.filter(F.col("block") < blocks).select("block", "bits", "lost_pairs", "contexts", "pairs", "read", "words").toLocalIterator():
        at = r["block"] * BLOCK_BITS // 8
        whole.data[at : at + BLOCK_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
        short[r["block"]] = r["lost_pairs"] > 0
        parts.append((np.array(r["contexts"], np.int64).view(np.uint64), *(np.array(r[c], float) for c in ("pairs", "read", "words"))))
    mass = counts.select(F.sum(_worth(F.col("c")))).first()[0] or 0.0
    mass += ADD * (vocabulary + 1)

    # Counts of frequent words and of the start, by key; those of other words are joined.
    own = dict(zip(top["hot_keys"].tolist(), top["hot_counts"].tolist(), strict=True))
    own |= dict(zip(top["pair_keys"].tolist(), top["pair_counts"], strict=True))
    keys = np.fromiter(own, np.uint64, len(own))
    often = pd.DataFrame({"_key": keys.view(np.int64), "_own": np.fromiter(own.values(), np.int64, len(own))})
    often = F.broadcast(spark.createDataFrame(often, "_key long, _own long"))
    keyed = counts.select(F.xxhash64("token").alias("_key"), F.col("c").alias("_own")).join(often, "_key", "left_anti")
    left = made.select(F.explode(F.arrays_zip("left_contexts", "left_words", "left_n")).alias("p")).select(
        F.col("p.left_contexts").alias("_context"), F.col("p.left_words").alias("_key"), F.col("p.left_n").alias("_n")
    )
    known = left.join(often, "_key").unionByName(left.join(often, "_key", "left_anti").join(keyed, "_key"))
    known = staged(known.select("_context", "_key", _worth(F.col("_n")).alias("_read"), _worth(F.col("_own")).alias("_alone")), "pairs")
    sums = known.groupBy("_context").agg(
        F.count("*").cast("double").alias("_pairs"), F.sum("_read").alias("_read"), F.sum(F.col("_alone") + ADD).alias("_words")
    )
    sums = staged(sums.withColumnRenamed("_context", "_key"), "contexts")
    more = sums.join(often, "_key", "left_semi").toPandas()
    parts.append((more["_key"].to_numpy(np.int64).view(np.uint64), *(more[c].to_numpy(float) for c in ("_pairs", "_read", "_words"))))

    found, pairs, read, words = (np.concatenate([p[i] for p in parts]) for i in range(4))
    keys, at = np.unique(found, return_inverse=True)
    pairs, read, words = (np.bincount(at.reshape(-1), x, keys.size) for x in (pairs, read, words))
    mine = np.array([own[int(k)] for k in keys], float)
    # Counts read may add up to more than the context's own.
    of = np.maximum(mine, read)
    weight = (1 - (read - DISCOUNT * pairs) / np.maximum(1.0, of)) / np.maximum(1 - words / mass, 1e-9)
    most = F.greatest(F.col("_own").cast("double"), "_read")
    rare = sums.join(keyed, "_key").select(
        "_key",
        most.alias("_whole"),
        F.log10((1 - (F.col("_read") - DISCOUNT * F.col("_pairs")) / most) / F.greatest(1 - F.col("_words") / mass, F.lit(1e-9))).alias("_weight"),
    )
    rare = staged(rare, "rare", outlive=True)
    frequent = pd.DataFrame({"_key": keys.view(np.int64), "_whole": of, "_weight": np.log10(weight)})
    frequent = F.broadcast(spark.createDataFrame(frequent, "_key long, _whole double, _weight double").withColumnRenamed("_key", "_context"))
    context = rare.withColumnRenamed("_key", "_context")
    known = known.join(frequent, "_context").unionByName(known.join(often, known["_context"] == often["_key"], "left_anti").join(context, "_context"))
    seen = F.log10(F.least(F.lit(1.0), (F.col("_read") - DISCOUNT) / F.col("_whole")))
    pairs = known.select(
        _pair_key(F.col("_context"), F.col("_key")).alias("_pair"),
        (seen - F.col("_weight") - F.log10((F.col("_alone") + ADD) / mass)).alias("_more"),
    )
    weights = counts.withColumn("_key", F.xxhash64("token")).join(rare.select("_key", "_weight"), "_key", "left")
    pairs = staged(pairs, "more", outlive=True)
    model = Model(whole, mass, keys, of, weight, spread_of(mine), short, left_filter(pairs, max(1, blocks // 4)))
    return model, weights.select("token", "c", F.coalesce("_weight", F.lit(0.0)).alias("_weight")), pairs


def _pair_key(context: Column, word: Column) -> Column:
    @F.pandas_udf("long")
    def key(context: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series(pair_keys(context.to_numpy().view(np.uint64), word.to_numpy().view(np.uint64)).view(np.int64))

    return key(context, word)


class Scorer:
    """Scores of documents but for what is left to joins. A task probes its frequent words once, a batch's pairs once each."""

    def __init__(self, top: dict, model: Model):
        self.model = model
        words = dict.fromkeys([*top["hot_words"], START.encode(), END.encode()])
        self.index = {w: i for i, w in enumerate(words)}
        self.keys = np.fromiter(map(word_key, words), np.uint64, len(words))
        hot = self.keys[: len(top["hot_words"])]
        level = model.bloom.levels(unit_keys(hot), model.bloom.block_of(hot))
        level = np.where(level > 0, level, level_of(top["hot_counts"]))  # of a block that had no room for it
        self.alone = np.full(len(words), ADD / model.mass)
        self.alone[self.index[END.encode()]] = (WORTH[level_of(top["ends"])] + ADD) / model.mass
        self.alone[: hot.size] = (WORTH[level] + ADD) / model.mass
        self.counted = np.isin(self.keys, top["pair_keys"])
        contexts = model.contexts
        self.place = np.minimum(np.searchsorted(contexts, self.keys), max(0, contexts.size - 1))
        self.leads = contexts[self.place] == self.keys if contexts.size else np.zeros(len(words), bool)

    def known(self, spelled: list[bytes]) -> np.ndarray:
        """Each word's place among the frequent ones, or -1."""
        get = self.index.get
        return np.fromiter((get(w, -1) for w in spelled), np.int64, len(spelled))

    def log10(self, spelled: list[bytes], words: np.ndarray, contexts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        """log10 P(word | context) of each place, the places whose pairs the join may have, and the keys of these pairs.

        words and contexts index ``spelled``, the batch's words.
        """
        m = self.model
        often = known >= 0
        keys, alone = np.empty(known.size, np.uint64), np.full(known.size, ADD / m.mass)
        weight, leads, counted = np.ones(known.size), np.ones(known.size, bool), np.zeros(known.size, bool)
        keys[often], alone[often] = self.keys[known[often]], self.alone[known[often]]
        keys[~often] = np.array([word_key(spelled[i]) for i in np.flatnonzero(~often)], np.uint64)
        leads[often], counted[often] = self.leads[known[often]], self.counted[known[often]]
        heads = leads & often
        weight[heads] = m.weight[self.place[known[heads]]]
        p = weight[contexts] * alone[words]
        held = counted[contexts] & counted[words]
        left = leads[contexts] & ~held
        both = np.flatnonzero(leads[contexts] & held)
        code, at = np.unique(contexts[both] * known.size + words[both], return_inverse=True)
        at = at.reshape(-1)
        before, after = code // known.size, code % known.size
        a, b, place = keys[before], keys[after], self.place[known[before]]
        home = pair_homes(a, b, m.spread[place], m.bloom.blocks) if code.size else place
        level = m.bloom.levels(pair_keys(a, b), home)
        share = np.zeros(code.size)
        hit = level > 0
        share[hit] = (WORTH[level[hit]] - DISCOUNT) / m.whole[place[hit]]
        left[both] = (~hit & m.short[home])[at]
        share = share[at]
        p[both] = np.where(share > 0, np.minimum(share, 1.0), p[both])
        left = np.flatnonzero(left)
        pairs = pair_keys(keys[contexts[left]], keys[words[left]])
        some = m.left.has(pairs, pairs.view(np.int64) % m.left.blocks, np.ones(pairs.size, np.int64))
        return np.log10(p), left[some], pairs[some]


def _frequent(counts: DataFrame, most: int, vocabulary: int) -> dict[str, int]:
    """The words at least as frequent as some count that up to ``most`` words reach, with their counts."""
    if vocabulary > most:
        scale = 20.0
        level = F.floor(F.log(F.col("c").cast("double")) * scale)
        sizes = sorted(((r["l"], r["n"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect()), reverse=True)
        held, least = 0, None
        for at, n in sizes:
            held += n
            if held > most:
                break
            least = at
        counts = counts.filter(level >= least) if least is not None else counts.filter("false")
    found = counts.toPandas()
    return dict(zip(found["token"], found["c"].tolist(), strict=True))


class _Ids(dict):
    """Numbers words in the order they first come."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def fit(
    rows: DataFrame,
    counts: DataFrame,
    hot: dict[str, int],
    total: int,
    vocabulary: int,
    most_pair_words: int,
    most_blocks: int,
) -> tuple[Model, dict, DataFrame, DataFrame]:
    """The model of the rows not held out, the words that workers look up, and the tables of ``build_model`` for the rest."""
    pair_words = min(most_pair_words, max(1024, total // WORD_TOKENS))
    blocks = min(most_blocks, max(16, total // BLOCK_TOKENS, len(hot) // BLOCK_WORDS))
    ends = hot.get(END) or counts.filter(F.col("token") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    first = sorted(hot.items(), key=lambda x: (-x[1], x[0]))[:pair_words]
    pairs = {w.encode(): c for w, c in first} | {START.encode(): max(1, ends), END.encode(): max(1, ends)}
    top = {
        "hot_words": [w.encode() for w in hot],
        "hot_keys": np.array([word_key(w.encode()) for w in hot], np.uint64),
        "hot_counts": np.array(list(hot.values()), np.int64),
        "pair_words": list(pairs),
        "pair_keys": np.array([word_key(w) for w in pairs], np.uint64),
        "pair_counts": list(pairs.values()),
        "ends": ends,
    }
    shared = rows.sparkSession.sparkContext.broadcast(top)
    with scratch():
        model, words, rest = build_model(rows, counts, shared, blocks, total, vocabulary)
    return model, top, words, rest


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    hot_words: int = 131_072,
    most_pair_words: int = 32_768,
    most_blocks: int = 4096,
) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts = staged(train_counts(rows), "counts")
    total, vocabulary = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = _frequent(counts, hot_words, vocabulary)
    model, top, weights, pairs = fit(rows, counts, hot, total, vocabulary, most_pair_words, most_blocks)
    # hot_words and most_pair_words bound this broadcast, most_blocks the next.
    shared = spark.sparkContext.broadcast(top)
    bloom = spark.sparkContext.broadcast(model)
    unknown = ADD / (total + ADD * (vocabulary + 1))

    def each(batches):
        top = shared.value
        scorer = Scorer(top, bloom.value)
        mass = total + ADD * (vocabulary + 1)
        # Of the start and the end, unless the end is among the frequent words, the base score takes no account here.
        base_of = np.full(len(scorer.index), np.nan)
        base_of[: len(top["hot_words"])] = np.log10((top["hot_counts"] + ADD) / mass)
        row = (TaskContext.get().partitionId() + 1) << 36
        end, start = END.encode(), START.encode()

        def out(ids, texts):
            nonlocal row
            n = len(texts)
            ids_of = _Ids({end: 0, start: 1})
            lines = [[ids_of[w] for w in words_of(t)] for t in texts]
            size = np.array([len(line) + 1 for line in lines])
            stop = np.cumsum(size)
            words = np.zeros(stop[-1], np.int64)
            inside = np.ones(stop[-1], bool)
            inside[stop - 1] = False
            words[inside] = np.fromiter(chain.from_iterable(lines), np.int64, int(inside.sum()))
            contexts = np.r_[1, words[:-1]]
            contexts[np.r_[0, stop[:-1]]] = 1
            spelled = list(ids_of)
            known = scorer.known(spelled)
            base = np.where(known >= 0, base_of[known], np.nan)
            hot = ~np.isnan(base)
            begin = stop - size
            logs, places, left_pairs = scorer.log10(spelled, words, contexts, known)
            sums = np.add.reduceat(logs, begin)
            left_at = pa.array(np.searchsorted(places, np.r_[begin, stop[-1]]), pa.int32())
            hot_base = np.add.reduceat(np.where(hot, base, 0.0)[words], begin)
            hot_n = np.add.reduceat(hot[words].astype(np.int64), begin)
            # The other words of each document, with how often it has them.
            doc = np.repeat(np.arange(n), size)
            left = ~hot[words]
            code, often = np.unique(doc[left] * len(spelled) + words[left], return_counts=True)
            cut = np.searchsorted(code // len(spelled), np.arange(n + 1))
            names = pa.array(spelled, pa.binary()).cast(pa.string()).take(pa.array(code % len(spelled)))
            offsets = pa.array(cut, pa.int32())
            uid = row + np.arange(n)
            row += n
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(uid, pa.int64()),
                    ids,
                    pa.array(held_out(ids.to_pylist())),
                    pa.array(size, pa.int64()),
                    pa.array(hot_n, pa.int64()),
                    pa.array(hot_base),
                    pa.array(sums),
                    pa.ListArray.from_arrays(offsets, names),
                    pa.ListArray.from_arrays(offsets, pa.array(often, pa.int32())),
                    pa.ListArray.from_arrays(left_at, pa.array(left_pairs.view(np.int64))),
                ],
                ["_row", "_id", "held_out", "n_tokens", "_hot_known", "_hot_base", "_hot_score", "_rare", "_rare_n", "_left"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                yield out(part.column(0), part.column(1).to_pylist())

    kind = rows.schema["_id"].dataType.simpleString()
    scored = staged(
        rows.mapInArrow(
            each,
            f"_row long, _id {kind}, held_out boolean, n_tokens long, _hot_known long, _hot_base double, _hot_score double,"
            " _rare array<string>, _rare_n array<int>, _left array<long>",
        ),
        "scored",
    )
    rare = scored.select("_row", F.explode(F.arrays_zip("_rare", "_rare_n")).alias("r")).select(
        "_row", F.col("r._rare").alias("token"), F.col("r._rare_n").alias("k")
    )
    rest = weights if vocabulary > len(hot) else weights.filter("false")
    mass = float(total + ADD * (vocabulary + 1))
    # Over what an unseen token gets, which all rare tokens are given above; but the model always knows the end.
    rest = rest.select(
        "token",
        (F.log10((F.col("c") + ADD) / mass) - float(np.log10(unknown))).alias("_base"),
        F.when(F.col("token") != END, F.log10((_worth(F.col("c")) + ADD) / ADD) + F.col("_weight")).otherwise(0.0).alias("_model"),
    )
    seen = rare.join(rest, "token").select("_row", "k", (F.col("k") * F.col("_base")).alias("b"), (F.col("k") * F.col("_model")).alias("m"))
    met = scored.select("_row", F.explode("_left").alias("_pair")).join(small(pairs), "_pair")
    met = met.select("_row", F.lit(0).alias("k"), F.lit(0.0).alias("b"), F.col("_more").alias("m"))
    seen = (
        seen.union(met)
        .groupBy("_row")
        .agg(F.sum("k").alias("_rare_known"), F.sum("b").alias("_rare_base"), F.sum("m").alias("_rare_score"))
    )
    zero = F.lit(0)
    return (
        scored.drop("_rare", "_rare_n", "_left")
        .join(seen, "_row", "left")
        .select(
            F.col("_id").alias(id_col),
            "held_out",
            "n_tokens",
            (F.col("_hot_known") + F.coalesce("_rare_known", zero)).cast("long").alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (
                F.col("_hot_base")
                + F.coalesce("_rare_base", F.lit(0.0))
                + (F.col("n_tokens") - F.col("_hot_known")) * float(np.log10(unknown))
            ).alias("base_score"),
            (F.col("_hot_score") + F.coalesce("_rare_score", F.lit(0.0))).alias("score"),
        )
    )
