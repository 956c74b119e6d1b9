"""Vector bin packing of token sequences.

Documents are encoded whole, closed by an end id and cut every ``limit`` tokens. Full pieces are sequences of
their own; the rest are placed under simultaneous limits on tokens, segments and loss-bearing tokens. A bin
takes, again and again, the example with the largest dot product of its demand and the bin's free room (each
as a share of the limits) that fits; equal demands are one class, so a choice looks at classes, not examples.

Encoding keeps nothing but the pieces' lengths and checksums, written to the shared folder once. Packing deals
those narrow rows by hash into groups of about ``group_size``, whose number grows with the input; a group
leaves about one badly filled bin.

Defined results: a null text equals the empty one, which is a piece of the end id alone. Rows with equal id are
packed each. A null id is packed like any other. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import bpe
from assayer.llm.staging import staged


def fill_bins(demand: np.ndarray, limits: Sequence[int]) -> np.ndarray:
    """The bin of each row of ``demand`` (n by limits) and its turn there, as an n by 2 array.

    A row that alone exceeds a limit gets a bin to itself.
    """
    n = len(demand)
    placed = np.zeros((n, 2), np.int64)
    if not n:
        return placed
    caps = np.asarray(limits, float)
    classes, member = np.unique(demand, axis=0, return_inverse=True)
    order = np.argsort(member.reshape(-1), kind="stable")
    left = np.bincount(member.reshape(-1), minlength=len(classes))
    at = np.r_[0, np.cumsum(left)[:-1]]
    share = classes / caps
    at_bin = 0
    over = (classes > caps).any(axis=1)
    for c in np.flatnonzero(over):
        for i in order[at[c] : at[c] + left[c]]:
            placed[i] = at_bin, 0
            at_bin += 1
        left[c] = 0
    live = np.flatnonzero(left)
    while live.size:
        room, turn = caps.copy(), 0
        while True:
            can = live[(classes[live] <= room).all(axis=1)]
            if not can.size:
                break
            c = can[np.argmax(share[can] @ (room / caps))]
            placed[order[at[c]]] = at_bin, turn
            at[c] += 1
            left[c] -= 1
            turn += 1
            room -= classes[c]
            if not left[c]:
                live = live[live != c]
        at_bin += 1
    return placed


def pack(
    examples: DataFrame,
    by: Sequence[str],
    *,
    tokens: str = "length",
    segments: str = "segments",
    loss: str = "loss_tokens",
    limits: Sequence[int] = (2048, 256, 2048),
    group_size: int = 8192,
) -> DataFrame:
    """The examples with sequence_id, offset (tokens before it there) and turn.

    ``by``: columns whose hash deals examples into groups. The examples are read twice: pass a written table.
    """
    groups = max(1, math.ceil(examples.count() / group_size))
    columns = list(examples.columns)

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*by, tokens], kind="stable").reset_index(drop=True)
        placed = fill_bins(group[[tokens, segments, loss]].to_numpy(np.int64), limits)
        group["turn"] = placed[:, 1]
        group["sequence_id"] = placed[:, 0] * groups + group["_group"]
        group = group.sort_values(["sequence_id", "turn"], kind="stable")
        group["offset"] = group.groupby("sequence_id")[tokens].cumsum() - group[tokens]
        return group[[*columns, "sequence_id", "offset", "turn"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema)
    return (
        examples.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(groups)))
        .groupBy("_group")
        .applyInPandas(each, f"{fields}, sequence_id long, offset long, turn long")
    )


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 2048,
    end_id: int = 1,
    ranks: str | None = None,
) -> DataFrame:
    """``id_col``, start, length, ids_crc32 and doc_tokens of every document's pieces."""
    path = ranks or bpe.default_ranks()
    end = np.array([end_id], "<u4").tobytes()

    def each(batches):
        encode = bpe.encoder(path).ids
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for s in range(0, n, limit):
                    cut = ids[4 * s : 4 * (s + limit)]
                    row.append(i)
                    start.append(s)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    total.append(n)
            longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), *longs],
                [id_col, "start", "length", "ids_crc32", "doc_tokens"],
            )

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(each, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 2048,
    most_segments: int = 256,
    ranks: str | None = None,
) -> DataFrame:
    """``pieces`` with sequence_id and offset; every id of a document bears loss."""
    cut = staged(pieces(docs, id_col, text_col, limit=limit, ranks=ranks), "pieces")
    cut = cut.withColumns({"segments": F.lit(1).cast("long"), "loss_tokens": F.col("length")})
    return pack(cut, [id_col, "start", "ids_crc32"], limits=(limit, most_segments, limit)).drop(
        "segments", "loss_tokens", "turn"
    )


def pack_conversations(
    turns: DataFrame,
    id_col: str = "conv_id",
    role_col: str = "role",
    text_col: str = "text",
    *,
    limit: int = 2048,
    most_segments: int = 16,
    most_loss: int = 1024,
    loss_role: str = "assistant",
    ranks: str | None = None,
) -> DataFrame:
    """Instruction data: a row for each conversation, with its tokens, turns and loss-bearing tokens.

    Columns: ``id_col``, length, segments (its turns), loss_tokens (in turns of ``loss_role``), sequence_id, offset.
    A conversation beyond a limit has a sequence to itself.
    """
    path = ranks or bpe.default_ranks()

    def each(batches):
        encode = bpe.encoder(path).ids
        for batch in batches:
            sizes = [len(encode(t or "")) // 4 + 1 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["_id", "_role", "length"])

    rows = turns.select(F.col(id_col).alias("_id"), F.col(role_col).cast("string").alias("_role"), F.col(text_col).cast("string"))
    sized = rows.mapInArrow(each, f"_id {rows.schema['_id'].dataType.simpleString()}, _role string, length long")
    whole = sized.groupBy(F.col("_id").alias(id_col)).agg(
        F.sum("length").alias("length"),
        F.count("*").alias("segments"),
        F.coalesce(F.sum(F.when(F.col("_role") == loss_role, F.col("length"))), F.lit(0)).alias("loss_tokens"),
    )
    return pack(staged(whole, "conversations"), [id_col], limits=(limit, most_segments, most_loss)).drop("turn")
