"""Mixing to target weights by soft membership.

A classifier trained on the labelled table gives each document a posterior over domains (here: low quality,
toxic, good). Expected tokens of domain k under rates r are sum(tokens * posterior_k * r); projected-gradient
least squares looks for rates r >= 0, from r = 1, whose expected totals match the targets. An iteration is one
distributed sum of as many numbers as there are domains; a document's rate follows from the steps so far, so
rates are never shipped. Steps are scaled by the posteriors' second moments, gather momentum, and go on until the
totals match.

The classifier is fitted on about ``sample_rows`` labelled rows (a share by hash of the id, whole texts), its
one sample; all documents are scored, and all totals cover all documents.

Defined results: a null text equals the empty one: no tokens, a posterior from its form alone, and the rate that
follows from it. Labels that repeat an id are used as they stand, those with a null label are dropped. Rows with
equal id get the same rate if their texts are equal. An empty table gives an empty table; without labels, every rate
is 1.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.staging import boxed, scratch, staged

DOMAINS = ("low", "toxic", "good")
TARGETS = {"low": 0.04, "toxic": 0.005, "good": 0.955}
#: The chi-squared statistic (2 degrees) above which a word is taken to tell domains apart.
TELLING = 20.0
_MARK = re.compile(r"[^\w\s.,;:!?'\"()-]")


def _shape(text: str, words: list[str]) -> list[float]:
    """Features of form: length, repetition, capitals, odd marks, digits, word length, line length."""
    n, k = max(1, len(text)), max(1, len(words))
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(k) / 10,
        again / k,
        1 - len(set(words)) / k,
        sum(map(str.isupper, text)) / n,
        10 * len(_MARK.findall(text)) / n,
        sum(map(str.isdigit, text)) / n,
        len(text) / k / 10,
        text.count("\n") * 10 / n,
    ]


SHAPES = 8


@dataclass(frozen=True)
class Classifier:
    words: dict[str, int]
    weights: np.ndarray  # 1 + SHAPES + words by domains
    scale: np.ndarray  # mean and deviation of the shapes

    def features(self, text: str) -> tuple[np.ndarray, list[int], int]:
        words = text.lower().split()
        shape = (np.array(_shape(text, words)) - self.scale[0]) / self.scale[1]
        bare = {w.strip(".,;:!?") for w in words}
        return np.clip(shape, -6, 6), [self.words[w] for w in bare if w in self.words], len(words)

    def posterior(self, shape: np.ndarray, hits: list[int]) -> np.ndarray:
        z = self.weights[0] + shape @ self.weights[1 : 1 + SHAPES] + self.weights[[1 + SHAPES + i for i in hits]].sum(axis=0)
        e = np.exp(z - z.max())
        return e / e.sum()


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample_rows: int) -> DataFrame:
    known = labels.filter("quality IS NOT NULL AND toxic IS NOT NULL").select(F.col(id_col).alias("_k"), "quality", "toxic")
    share = min(1.0, sample_rows / max(1, known.count()))
    parts = 1_000_000
    known = known.filter(F.pmod(F.xxhash64("_k"), F.lit(parts)) < math.ceil(share * parts))
    domain = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 0).otherwise(2)
    # The sample is bounded by its parameter, so a broadcast of its ids and labels is too.
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return texts.join(F.broadcast(known), F.col("_id") == F.col("_k")).select("t", domain.alias("y"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    sample_rows: int = 8000,
    vocabulary: int = 512,
    steps: int = 300,
) -> Classifier | None:
    """Multinomial logistic regression on telling words and form; None without labelled rows."""
    k = len(DOMAINS)
    rows = staged(_labelled(docs, labels, id_col, text_col, sample_rows), "labelled")

    def words_of(batches):
        held = [Counter() for _ in range(k)]
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[y].update({w.strip(".,;:!?") for w in text.lower().split()})
        words = sorted(set().union(*held))
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), *(pa.array([h[w] for w in words], pa.int64()) for h in held)],
            ["w", "n0", "n1", "n2"],
        )

    sizes = np.zeros(k)
    for r in rows.groupBy("y").count().collect():
        sizes[r["y"]] = r["count"]
    if not sizes.sum():
        return None
    counted = rows.mapInArrow(words_of, "w string, n0 long, n1 long, n2 long").groupBy("w").agg(
        *(F.sum(f"n{i}").alias(f"n{i}") for i in range(k))
    )
    # How far a word's share of each domain is from its share of all rows, in deviations.
    score = F.lit(0.0)
    for i in range(k):
        q = float(sizes[i] / sizes.sum())
        hope = (F.col("n0") + F.col("n1") + F.col("n2")) * q
        score = score + F.pow(F.col(f"n{i}") - hope, 2) / (hope + 1.0)
    telling = counted.withColumn("score", score).filter(f"w <> '' AND n0 + n1 + n2 >= 5 AND score > {TELLING}")
    top = telling.orderBy(F.desc("score"), "w").limit(vocabulary).collect()
    words = {r["w"]: i for i, r in enumerate(top)}
    plain = Classifier(words, np.zeros((1 + SHAPES + len(words), k)), np.array([[0.0] * SHAPES, [1.0] * SHAPES]))

    def features(batches):
        for batch in batches:
            made = [plain.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    pa.array([m[0].tolist() for m in made], pa.list_(pa.float64())),
                    pa.array([m[1] for m in made], pa.list_(pa.int64())),
                ],
                ["y", "shape", "hits"],
            )

    sample = rows.mapInArrow(features, "y int, shape array<double>, hits array<long>").toPandas()
    shape = np.stack(sample["shape"].to_numpy())
    scale = np.stack([shape.mean(axis=0), shape.std(axis=0) + 1e-6])
    x = np.zeros((len(sample), 1 + SHAPES + len(words)), np.float32)
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPES] = np.clip((shape - scale[0]) / scale[1], -6, 6)
    for i, hits in enumerate(sample["hits"]):
        x[i, 1 + SHAPES + np.asarray(hits, np.int64)] = 1
    y = np.eye(k, dtype=np.float32)[sample["y"].to_numpy(np.int64)]
    w = np.zeros((x.shape[1], k), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - y) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(words, w.astype(np.float64), scale)


def memberships(docs: DataFrame, model: Classifier | None, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _tokens, _p): a row for each document."""
    k = len(DOMAINS)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        for batch in batches:
            tokens, post = [], []
            known = shared.value
            for text in batch.column(2).to_pylist():
                if known is None:
                    tokens.append(len(text.split()))
                    post.append([1 / k] * k)
                    continue
                shape, hits, n = known.features(text)
                tokens.append(n)
                post.append(known.posterior(shape, hits).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(post, pa.list_(pa.float64()))],
                ["_id", "_hash", "_tokens", "_p"],
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(each, f"_id {kind}, _hash long, _tokens long, _p array<double>")


def _rates(p: np.ndarray, steps: list[tuple[float, np.ndarray]]) -> np.ndarray:
    """Rates after the steps: each goes on by its share of the last move, then against the gradient, not below 0."""
    rate = before = np.ones(len(p))
    for momentum, step in steps:
        ahead = rate + momentum * (rate - before)
        before, rate = rate, np.maximum(0.0, ahead - p @ step)
    return rate


def _posteriors(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(-1, len(DOMAINS))


class TargetsNotMet(UserWarning):
    """The fit ended at rates whose shares are not the targets."""


def fit_rates(
    members: DataFrame, targets: Mapping[str, float], *, rounds: int = 400, tolerance: float = 1e-3
) -> list[tuple[float, np.ndarray]]:
    """The steps that lead every document from rate 1 to its rate.

    The targets are shares; the total is such that the largest target's domain keeps its tokens. The fit ends where
    the totals are within ``tolerance`` of what is wanted, as a share of all of it. Where targets are out of reach (no
    document may belong to a domain), it ends when residuals have stopped falling, or after ``rounds``, and says so
    by the warning ``TargetsNotMet`` with the shares reached.
    """
    k = len(DOMAINS)
    goal = np.array([targets[d] for d in DOMAINS], float)
    goal /= goal.sum()

    def summed(each, size: int) -> np.ndarray:
        """The sum over all batches of what ``each`` makes of tokens and posteriors."""

        def of(batches):
            sums = np.zeros(size)
            for batch in batches:
                sums += each(batch.column(0).to_numpy().astype(float), _posteriors(batch.column(1))).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(sums)], ["at", "x"])

        sums = np.zeros(size)
        found = members.select("_tokens", "_p").mapInArrow(of, "at long, x double")
        for r in found.groupBy("at").agg(F.sum("x").alias("x")).collect():
            sums[r["at"]] = r["x"]
        return sums

    square = summed(lambda t, p: (p * t[:, None]).T @ p, k * k).reshape(k, k)
    full = square.sum(axis=1)
    if not full.sum():
        return []
    main = int(goal.argmax())
    want = goal / goal[main] * full[main]
    # In this scale a step can't overshoot, whatever the posteriors; the ridge is for domains without tokens.
    scale = np.linalg.inv(square + 1e-9 * np.trace(square) / k * np.eye(k))

    def error(off: np.ndarray) -> float:
        return float(np.abs(off).sum() / want.sum())

    steps: list[tuple[float, np.ndarray]] = []
    off = before = full - want
    age, still = 1.0, 0
    for _ in range(rounds):
        if error(off) < tolerance or still >= 20:
            break
        # Accelerated projected gradient; momentum starts anew when residuals rise.
        older, age = age, (1 + math.sqrt(1 + 4 * age * age)) / 2
        momentum = (older - 1) / age
        steps.append((momentum, scale @ (off + momentum * (off - before))))
        then = summed(lambda t, p: (t * _rates(p, steps)) @ p, k) - want
        still = still + 1 if error(then) > error(off) * (1 - 1e-4) else 0
        if then @ scale @ then > off @ scale @ off:
            age = 1.0
        before, off = off, then
    if error(off) >= tolerance:
        shares = (off + want) / (off + want).sum()
        warnings.warn(f"shares {shares.round(4)} for targets {goal.round(4)}", TargetsNotMet, stacklevel=2)
    return steps


def mix(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    targets: Mapping[str, float] = TARGETS,
    sample_rows: int = 8000,
) -> DataFrame:
    """``id_col``, _hash, tokens, a posterior for each domain, rate and copies of every document.

    copies is the rate rounded up or down by a hash of the id with the fraction as its chance, so expected tokens
    are those of the rates.
    """
    model = train(docs, labels, id_col, text_col, sample_rows=sample_rows)
    members = staged(memberships(docs, model, id_col, text_col), "members")
    steps = fit_rates(members, targets) if model else []

    def rated(batches):
        for batch in batches:
            rate = _rates(_posteriors(batch.column(3)), steps) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], [*batch.schema.names, "rate"])

    kind = members.schema["_id"].dataType.simpleString()
    chance = F.pmod(F.xxhash64("_id", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("int")
    return (
        members.mapInArrow(rated, f"_id {kind}, _hash long, _tokens long, _p array<double>, rate double")
        .withColumn("copies", copies.cast("int"))
        .select(
            F.col("_id").alias(id_col),
            "_hash",
            F.col("_tokens").alias("tokens"),
            *(F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)),
            "rate",
            "copies",
        )
    )


def mixed(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, each row as often as its copies say."""
    with scratch():
        chosen = (
            mix(docs, labels, id_col, text_col, **options)
            .filter("copies > 0")
            .select(F.col(id_col).alias("_k"), F.col("_hash").alias("_h"), F.col("copies").alias("_copies"))
            .dropDuplicates(["_k", "_h"])
        )
        chosen = staged(chosen, "chosen", outlive=True)
    rows = boxed(docs, _id=F.col(id_col), _hash=F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    joined = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")))
    return joined.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_row.*")
