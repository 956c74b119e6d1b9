"""Token counts by field or section, from one encoding of the whole document.

A document is encoded once; its tokens' spans are joined with its sections' spans by position (both sorted, so
the join is a binary search). A token whose span crosses a boundary goes to one section by ``rule``: that of its
first byte ("first"), of its last byte ("last"), or of most of its bytes, the earlier on a tie ("most"). Counts
over a document's sections therefore always add up to the count of the whole.

Sections are lines, each with its line break, or, with several text columns, fields joined by a line break that
belongs to the field before it.

Defined results: a null text equals the empty one; a text without bytes has one section, without tokens. Rows
with equal id give their sections each. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import bpe

RULES = ("first", "last", "most")


def allocate(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that reach beyond it.

    ``sizes``: bytes of each token; ``bounds``: the sections' first bytes, starting with 0.
    """
    k = len(bounds)
    stop = np.cumsum(sizes, dtype=np.int64)
    first = np.searchsorted(bounds, stop - sizes, "right") - 1
    last = np.searchsorted(bounds, stop - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    owner = last.copy() if rule == "last" else first
    if rule == "most":
        edges = np.r_[bounds, np.iinfo(np.int64).max]
        for t in crossing:
            at, end = stop[t] - sizes[t], stop[t]
            spans = range(first[t], last[t] + 1)
            owner[t] = max(spans, key=lambda s: (min(end, edges[s + 1]) - max(at, edges[s]), -s))
    return np.bincount(owner, minlength=k), np.bincount(owner[crossing], minlength=k)


def line_starts(data: bytes) -> np.ndarray:
    cut = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.r_[0, cut[cut < len(data)]].astype(np.int64)


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    fields: Sequence[str] = ("text",),
    *,
    rule: str = "first",
    ranks: str | None = None,
) -> DataFrame:
    """A row for each section: ``id_col``, section, byte_start, n_bytes, n_tokens, n_crossing, doc_tokens.

    With one field, sections are its lines; with several, the fields in the order given.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, not {rule!r}")
    path = ranks or bpe.default_ranks()

    def each(batches):
        lengths = bpe.encoder(path).lengths
        for batch in batches:
            row, parts = [], [[], [], [], [], [], []]
            columns = [c.to_pylist() for c in batch.columns[1:]]
            for i, texts in enumerate(zip(*columns, strict=True)):
                texts = [t or "" for t in texts]
                whole = "\n".join(texts)
                data = whole.encode()
                if len(texts) == 1:
                    bounds = line_starts(data)
                else:
                    bounds = np.cumsum([0, *(len(t.encode()) + 1 for t in texts[:-1])])
                sizes = lengths(whole).astype(np.int64)
                counts, crossing = allocate(sizes, bounds, rule)
                k = len(bounds)
                row.append(np.full(k, i))
                for to, x in zip(parts, (np.arange(k), bounds, np.diff(np.r_[bounds, len(data)]), counts, crossing, np.full(k, len(sizes))), strict=True):
                    to.append(x)
            if row:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.concatenate(row))),
                        *(pa.array(np.concatenate(x).astype(np.int64)) for x in parts),
                    ],
                    [id_col, "section", "byte_start", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"],
                )

    rows = docs.select(F.col(id_col), *(F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields)))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(
        each,
        f"`{id_col}` {kind}, section long, byte_start long, n_bytes long, n_tokens long, n_crossing long,"
        " doc_tokens long",
    )
