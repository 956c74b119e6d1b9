"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint has 64 bits. Two fingerprints at 3 or fewer differing bits, cut into 2 segments of 32, have a
segment that differs in one bit at most. Each distinct fingerprint is therefore indexed under its 2 whole
segments and, for each bit of each segment, under the segment with that bit wild: 66 keys. Fingerprints of one
key meet in an equality join by sort; in a wild bit's key only both values of that bit make a link not found
elsewhere. Links are verified on all 64 bits.

Copies need no links: the index holds distinct fingerprints only. Within a key, links come from a search that
drops each fingerprint from the rest once reached, so a key yields fewer links than it has members, however
dense the group; components are the same as with all pairs. What one task holds of a key is 8 bytes for each
distinct fingerprint with that half.

Defined results: a null text equals the empty one; a text without words has fingerprint zero and is linked as
any other. Rows with equal id each get a row. A null id never names a component that has an id. An empty table
gives an empty table.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.components import components
from assayer.llm.staging import boxed, join_hot, scratch, small, staged

BITS = 64
SEGMENT = 32


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The hash of each word shingle of a UTF-8 text; of one shorter than a shingle, that of its words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as an unsigned integer."""
    votes = np.zeros(BITS, np.int64)
    for i in range(0, hashes.size, 1 << 15):
        part = hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text's word shingles, as an unsigned integer."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int = 3) -> DataFrame:
    """(_id, _fp): a row for each document."""

    def each(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            marks = np.fromiter((fingerprint(t or b"", width) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], ["_id", "_fp"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(each, f"_id {rows.schema['_id'].dataType.simpleString()}, _fp long")


def _near(members: np.ndarray, most: int) -> list[tuple[int, np.ndarray]]:
    """A spanning forest of the members at most ``most`` bits apart."""
    found, rest = [], members
    while rest.size > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            a = todo.pop()
            hit = np.bitwise_count(rest ^ a) <= most
            if hit.any():
                near = rest[hit]
                found.append((a, near))
                todo.extend(near)
                rest = rest[~hit]
    return found


def _links_of(keys: np.ndarray, marks: np.ndarray, most: int):
    """Links within each run of equal keys; arrays of both ends."""
    ends_a, ends_b = [], []
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, keys.size])
    bit = keys >> 33
    wild = bit < SEGMENT
    shift = np.where(wild, bit + SEGMENT * ((keys >> 32) & 1), 0).astype(np.uint64)
    side = ((marks >> shift) & np.uint64(1)).astype(np.int8)
    mixed = np.minimum.reduceat(side, first) != np.maximum.reduceat(side, first)
    live = (size > 1) & (mixed | ~wild[first])
    two = first[live & (size == 2)]
    near = two[np.bitwise_count(marks[two] ^ marks[two + 1]) <= most]
    ends_a.append(marks[near])
    ends_b.append(marks[near + 1])
    for i, n in zip(first[live & (size > 2)], size[live & (size > 2)], strict=True):
        for a, b in _near(marks[i : i + n], most):
            ends_a.append(np.full(b.size, a, np.uint64))
            ends_b.append(b)
    return np.concatenate(ends_a), np.concatenate(ends_b)


def links(marks: DataFrame, most: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints of column _fp, enough to join all that are within reach."""
    if not 0 <= most <= 3:
        raise ValueError("two segments with one wildcard find up to 3 differing bits")
    keyed = (
        marks.select("_fp")
        .distinct()
        .select("_fp", F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENT + 1))).alias("_i"))
        .select(
            F.expr(
                "shiftleft(cast(_i as bigint), 32) | (shiftrightunsigned(_fp, 32 * (_i % 2)) & 4294967295L"
                " & CASE WHEN _i < 64 THEN ~shiftleft(1L, cast(_i div 2 as int)) ELSE -1L END)"
            ).alias("_key"),
            "_fp",
        )
        .repartition("_key")
        .sortWithinPartitions("_key", "_fp")
    )

    def each(batches):
        keys, marks = np.empty(0, np.int64), np.empty(0, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys, marks):
            a, b = _links_of(keys, marks, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            if held[0][0][0] == held[-1][0][-1]:
                continue  # one key so far
            keys, marks = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys, keys[-1]))
            held = [(keys[cut:], marks[cut:])]
            yield out(keys[:cut], marks[:cut])
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return keyed.mapInArrow(each, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, most: int = 3
) -> DataFrame:
    """A row for each input row: ``id_col``, fingerprint (16 hex digits), component_id."""
    rows = staged(fingerprints(docs, id_col, text_col, width), "simhash")
    return _with_components(rows, most).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_least").alias("component_id"),
    )


def _with_components(rows: DataFrame, most: int) -> DataFrame:
    return spread(rows, components(links(rows, most)))


def spread(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with _least, the smallest _id of their component; found has the components of _fp.

    Fingerprints and components with many rows are joined by broadcast, the rest by shuffle.
    """
    roots = found.select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
    own = rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n"))
    linked = staged(own.join(roots, "_fp"), "linked")
    least = staged(linked.groupBy("_root").agg(F.min("_least").alias("_least"), F.count("*").alias("_members")), "least")
    total, members = rows.count(), linked.count()
    spread = join_hot(linked.drop("_least"), least, "_root", "_members", members).select("_fp", "_least", "_n")
    alone = own.join(roots.select("_fp"), "_fp", "left_anti").select("_fp", "_least", "_n")
    return join_hot(rows, staged(alone.union(spread), "named"), "_fp", "_n", total).drop("_n")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 3, most: int = 3
) -> DataFrame:
    """The input's rows and columns, one row for each component: that with the smallest id."""
    with scratch():
        rows = staged(fingerprints(docs, id_col, text_col, width), "simhash")
        lost, again = leaving(_with_components(rows, most))
    return keep_least(docs, lost, again, id_col, text_col)


def leaving(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_name, a struct of the id, of rows that aren't the _least of their component, and of ids that several rows have."""
    name = F.struct("_id").alias("_name")
    lost = named.filter(~F.col("_id").eqNullSafe(F.col("_least"))).select(name).distinct()
    again = named.groupBy("_id").count().filter("count > 1").select(name)
    return staged(lost, "lost", outlive=True), staged(again, "again", outlive=True)


def keep_least(docs: DataFrame, lost: DataFrame, again: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The input's rows without those in ``lost``; of rows that share an id in ``again``, one of the least text hash.

    While these are small, no whole row is shuffled but those whose ids repeat.
    """
    lost, again = small(lost), small(again)
    rows = boxed(docs, _name=F.struct(F.col(id_col).alias("_id")), _hash=F.xxhash64(text_col)).join(lost, "_name", "left_anti")
    once = Window.partitionBy("_name").orderBy("_hash")
    repeated = rows.join(again, "_name", "left_semi").withColumn("_nth", F.row_number().over(once)).filter("_nth = 1")
    return rows.join(again, "_name", "left_anti").select("_row").union(repeated.select("_row")).select("_row.*")
