"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A document's paragraphs are its lines; a line of more than ``LONG`` words is cut into sentences, and a sentence of more
every ``LONG`` words, so that a document of one line has parts too and a cut depends on the line alone. Each paragraph's
digest (the nth copy of one has a digest of its own) goes into one cell of each of ``HASHES`` subtables; a cell keeps a
count, a sum of digests and a sum of checks. The fingerprint is that sketch as base64, with the number of paragraphs: a
function of the text alone.

Two versions are compared by subtracting their fingerprints, which cancels what both have. Peeling then takes a digest
from each cell that is left with one, and gives the differing digests, by side, when no cell is left. Where it gets
stuck, both documents are sketched ``GROWTH`` times as large and subtracted again; once a sketch has cells for all their
paragraphs, only its hashes change. There is no other way beside it: retries go on until peeling is done.

The likeness of two documents is shared paragraphs over all paragraphs (both counted with copies); two documents
without any have likeness 1.

Neighbours ("the next document") meet without a global sort in one task: numbers that stand for ids are dealt into
ranges, each range's first row is also given to the range before it, and each task walks its range in order.

Defined results: a null text equals the empty one. The one row of a table is its own next row. Ids may be of any type
that has an order; a null id comes first. Rows of equal id are in the order of their text's hash. An empty table gives
an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from assayer.llm.staging import numbered

LONG = 16
HASHES = 3
CELLS = 15
GROWTH = 4
#: Odd multipliers, from the splitmix64 constants.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_CELL = np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u8")])
#: The cells of the sketches that a task builds at a time.
_AT_ONCE = 1 << 20


def paragraphs(text: str) -> list[str]:
    found = []
    for line in text.split("\n"):
        words = line.split()
        if len(words) <= LONG:
            found += [" ".join(words)] if words else []
            continue
        for sentence in _SENTENCE.split(line):
            words = sentence.split()
            found += (" ".join(words[i : i + LONG]) for i in range(0, len(words), LONG))
    return found


def digests(text: str) -> np.ndarray:
    """A digest for each paragraph; copies of one get different ones, the same in every document."""
    seen: dict[str, int] = {}
    made = []
    for part in paragraphs(text):
        nth = seen[part] = seen.get(part, 0) + 1
        made.append(xxhash.xxh64_intdigest(part, nth))
    return np.array(made, np.uint64)


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys + np.uint64(MIX[0] * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


class Sketches:
    """Sketches of several documents, or differences of such, side by side: ``cells`` cells each."""

    def __init__(self, n: int, cells: int, salt: int):
        self.n, self.cells, self.salt = n, cells, salt
        self.width = cells // HASHES
        self.count = np.zeros(n * cells, np.int64)
        self.sum, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int = CELLS, salt: int = 0) -> Sketches:
        made = cls(len(sets), cells, salt)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        made.put(np.concatenate([np.empty(0, np.uint64), *sets]), owner, np.ones(owner.size, np.int64))
        return made

    def put(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Add where sign is 1, subtract where it is -1."""
        check = _mixed(keys, 1 << 20)
        minus = sign < 0
        keys_, check_ = np.where(minus, -keys, keys), np.where(minus, -check, check)
        for i in range(HASHES):
            high = _mixed(keys, HASHES * self.salt + i) >> np.uint64(32)
            at = owner * self.cells + i * self.width + ((high * np.uint64(self.width)) >> np.uint64(32)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.sum, at, keys_)
            np.add.at(self.check, at, check_)

    def minus(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """The differences of the sketches at a and those at b."""
        made = Sketches(len(a), self.cells, self.salt)
        for name in ("count", "sum", "check"):
            rows = getattr(self, name).reshape(self.n, self.cells)
            setattr(made, name, (rows[a] - rows[b]).reshape(-1))
        return made

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Owner, digest and side (1 or -1) of each digest recovered, and whether nothing is left of each owner.

        Empties the cells.
        """
        got = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        table = np.arange(self.cells) // self.width
        cells = [(np.arange(self.n)[:, None] * self.cells + np.flatnonzero(table == i)).reshape(-1) for i in range(HASHES)]
        idle = turn = 0
        budget = 4 * HASHES * (2 + int(np.abs(self.count).sum()))
        while idle < HASHES and turn < budget:
            mine = cells[turn % HASHES]
            one = mine[np.abs(self.count[mine]) == 1]
            sign = self.count[one]
            keys = np.where(sign < 0, -self.sum[one], self.sum[one])
            true = _mixed(keys, 1 << 20) == np.where(sign < 0, -self.check[one], self.check[one])
            one, sign, keys = one[true], sign[true], keys[true]
            turn += 1
            if not one.size:
                idle += 1
                continue
            idle = 0
            got.append((one // self.cells, keys, sign))
            self.put(keys, one // self.cells, -sign)
        dirty = ((self.count != 0) | (self.sum != 0)).reshape(self.n, self.cells).any(axis=1)
        return *(np.concatenate(x) for x in zip(*got, strict=True)), ~dirty

    def texts(self, sizes: list[int]) -> list[str]:
        """Each sketch with its document's number of paragraphs, as base64."""
        packed = np.zeros(len(self.count), _CELL)
        packed["count"], packed["sum"], packed["check"] = self.count, self.sum, self.check
        rows = packed.reshape(self.n, self.cells)
        return [base64.b64encode(n.to_bytes(4, "little") + row.tobytes()).decode() for n, row in zip(sizes, rows, strict=True)]

    @classmethod
    def read(cls, marks: list[str]) -> tuple[Sketches, list[int]]:
        """The sketches that ``texts`` wrote, and their documents' numbers of paragraphs."""
        data = [base64.b64decode(m) for m in marks]
        made = cls(len(data), CELLS, 0)
        packed = np.frombuffer(b"".join(d[4:] for d in data), _CELL)
        made.count[:], made.sum[:], made.check[:] = packed["count"], packed["sum"], packed["check"]
        return made, [int.from_bytes(d[:4], "little") for d in data]


def differences(
    marks: list[str], sets: list[np.ndarray], pairs: list[tuple[int, int]]
) -> list[tuple[np.ndarray, np.ndarray]]:
    """The digests that only the first and only the second of each pair of documents has, sorted.

    ``marks`` are the documents' fingerprints; their digests in ``sets`` serve for larger sketches where these fail.
    """
    out = [(np.empty(0, np.uint64),) * 2 for _ in pairs]
    todo = np.arange(len(pairs))
    ends = np.array(pairs, np.int64).reshape(-1, 2)
    held, sizes = Sketches.read(marks)
    sizes = np.array(sizes, np.int64)
    attempt = 0
    while todo.size:
        left = []
        both = sizes[ends[todo]].sum(axis=1)
        full = HASHES * (2 + both)
        cells = np.minimum(CELLS * GROWTH ** min(attempt, 30), np.maximum(CELLS, full))
        for size in np.unique(cells):
            group = todo[cells == size]
            step = max(1, _AT_ONCE // int(size))
            for now in (group[i : i + step] for i in range(0, group.size, step)):
                docs, at = np.unique(ends[now], return_inverse=True)
                at = at.reshape(-1, 2)
                made = held if attempt == 0 else Sketches.of([sets[i] for i in docs], int(size) // HASHES * HASHES, attempt)
                a, b = (ends[now].T) if attempt == 0 else at.T
                owner, keys, side, clean = made.minus(a, b).peel()
                order = np.lexsort((keys, owner))
                owner, keys, side = owner[order], keys[order], side[order]
                cut = np.searchsorted(owner, np.arange(now.size + 1))
                for k in np.flatnonzero(clean):
                    mine, way = keys[cut[k] : cut[k + 1]], side[cut[k] : cut[k + 1]]
                    out[now[k]] = mine[way > 0], mine[way < 0]
                left.append(now[~clean])
        todo = np.concatenate(left)
        attempt += 1
    return out


def edited(text: str, after: str, share: int = 4) -> str:
    """The text with the last 1/share of its code points replaced by the first as many of ``after``."""
    n = len(text) // share
    return text[: len(text) - n] + after[:n]


def with_next(docs: DataFrame, id_col: str, text_col: str, per_range: int = 2000, most_ranges: int = 1 << 16) -> DataFrame:
    """Rows (_name, _text, _range, _ahead, _id), sorted in each partition by range and order; _name is the id.

    _ahead marks the copy of the next range's first row that closes a range. The edges of ``most_ranges`` ranges (a
    number each) are what is broadcast; a range is streamed, so the size it grows to beyond them does not matter.
    """
    rows = numbered(docs, id_col, text_col).select(F.col("_id").alias("_name"), F.col("_doc").alias("_id"), "_text")
    ids = rows.select("_id")
    n = ids.count()
    ranges = min(most_ranges, max(1, n // per_range))
    firsts = sorted(
        set(ids.approxQuantile("_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))) if ranges > 1 else ()
    )
    edges = np.array(firsts, np.float64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.float64), "right").astype(np.int32))

    lowest = {
        r._range: r.least
        for r in ids.withColumn("_range", range_of("_id")).groupBy("_range").agg(F.min("_id").alias("least")).collect()
    }
    present = sorted(lowest)
    before = {r: present[i - 1] for i, r in enumerate(present)}  # of the first: the last
    heads = [(lowest[r], before[r]) for r in present]
    spark = docs.sparkSession
    table = spark.createDataFrame(heads or [(None, 0)], "_head long, _to int").filter(F.lit(bool(heads)))
    own = rows.withColumn("_range", range_of("_id")).withColumn("_ahead", F.lit(0))
    # Rows that are equal in id and text have one number: any one of them may close the range before.
    copies = rows.join(F.broadcast(table), F.col("_id") == F.col("_head")).select(
        "_name", "_id", "_text", F.col("_to").alias("_range"), F.lit(1).alias("_ahead")
    )
    return (
        own.select("_name", "_text", "_range", "_ahead", "_id")
        .unionByName(copies)
        .repartition(max(1, len(present)), "_range")
        .sortWithinPartitions("_range", "_ahead", "_id")
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = 200) -> DataFrame:
    """Each document's fingerprint against its edited text's and the next document's.

    Columns: ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    digests of the paragraphs that the edit took out and brought in, as signed longs: edited_lost, edited_new.
    """
    ordered = with_next(docs, id_col, text_col)

    def neighbours(batches):
        held = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and held[2] == row[2] and not held[3]:
                    yield held[0], held[1], row[1]
                held = row

    def each(batches):
        walk = neighbours(batches)
        last_text, last_set = None, None
        while rows := list(islice(walk, batch)):
            n = len(rows)
            own, after, edits = [], [], []
            changed = [edited(text, nxt) for _, text, nxt in rows]
            for (_, text, nxt), new in zip(rows, changed, strict=True):
                own.append(last_set if last_text is text else digests(text))
                last_text, last_set = nxt, digests(nxt)
                after.append(last_set)
                edits.append(digests(new))
            sets = [*own, *edits, *after]
            sizes = [len(s) for s in sets]
            marks = Sketches.of(sets).texts(sizes)
            apart = differences(marks, sets, [*((i, n + i) for i in range(n)), *((i, 2 * n + i) for i in range(n))])
            near = []
            for k, (lost, new) in enumerate(apart):
                both = sizes[k % n] + sizes[k + n]
                d = len(lost) + len(new)
                near.append((both - d) / (both + d) if both else 1.0)
            lists = [pa.array([x[i].view(np.int64) for x in apart[:n]], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], kind),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                    pa.array(marks[:n]),
                    pa.array(marks[n : 2 * n]),
                    pa.array(near[:n], pa.float64()),
                    pa.array(near[n:], pa.float64()),
                    *lists,
                ],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_lost", "edited_new"],
            )

    kind = to_arrow_type(ordered.schema["_name"].dataType)
    return ordered.mapInArrow(
        each,
        f"`{id_col}` {ordered.schema['_name'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, near_edited double, near_next double, edited_lost array<long>, edited_new array<long>",
    )
