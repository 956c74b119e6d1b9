"""Language identification by Bayesian evidence fusion.

For each row four kinds of evidence are added as log-probabilities of each language:

- text: hashed byte trigrams under a multinomial trained on labelled documents, divided by 3 since each byte is
  in three trigrams;
- declared markup language: P(declared | language), from grouped sums of text-only posteriors;
- address suffix: P(language | suffix) over P(language), the same way, smoothed to the whole;
- host prior: P(language | host), smoothed to its registered domain (the last two labels, or three under a country's
  second level such as co.uk), and that to the whole, each by grouped sums.

A row's own share is taken out of all sums that judge it. Sums by host, domain and suffix come from one grouped
aggregation with partial sums, and rows of frequent hosts meet them by broadcast, so a host with a third of all rows
is no burden; nothing that grows with the input is collected or broadcast. The text model has
``most_languages`` x 65,536 cells at most, and is trained on about ``sample_rows`` labelled rows (for each language a
share of its rows by hash of the id, whole texts), its one sample. Languages beyond the ``most_languages`` most
frequent labels have no model; their texts are judged by the others', or rejected.

A row is rejected (accepted false, lang "und") where its text has fewer than ``min_grams`` trigrams, where even
the best language finds the text no likelier than noise, or where the posterior is under ``min_posterior``.

Defined results: a null text, address or declared language is no evidence. Rows with equal id are judged each.
An empty table gives an empty table; without labelled rows, every row is rejected.
"""

from __future__ import annotations

import html as entities
import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.staging import boxed, join_hot, scratch, staged

CELLS = 1 << 16
#: A text whose best mean log-probability of a trigram is below this is noise; even odds over all cells are -11.1.
FLOOR = -10.0
_TAG = re.compile(r"<!--|<(/?[a-zA-Z][a-zA-Z0-9]*)[^<>]*>")
_NO_LETTER = re.compile(r"[\W\d_]+")
#: The end of what frames an article, or is no text, by its name.
_ASIDE = {
    name: re.compile(f"</{name}", re.ASCII | re.IGNORECASE)
    for name in ("script", "style", "nav", "footer", "header", "aside", "noscript", "template")
}


def trigrams(text: str) -> np.ndarray:
    """The text's hashed byte trigrams, lower-cased; digits and marks, which no language owns, are as white space."""
    data = np.frombuffer(_NO_LETTER.sub(" ", f" {text.lower()} ").encode(), np.uint8).astype(np.uint32)
    if data.size < 3:
        return np.empty(0, np.uint32)
    return ((data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)) >> np.uint32(16)


def visible(page: str) -> str:
    """A page's running text, without markup, scripts and what frames the article. One forward pass."""
    out, at = [], 0
    while m := _TAG.search(page, at):
        out.append(page[at : m.start()])
        out.append(" ")
        at = m.end()
        name = (m[1] or "").lower()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = len(page) if end < 0 else end + 3
        elif name in _ASIDE:
            end = _ASIDE[name].search(page, at)
            at = end.start() if end else len(page)
    out.append(page[at:])
    return entities.unescape("".join(out))


@dataclass(frozen=True)
class TextModel:
    langs: tuple[str, ...]
    log_p: np.ndarray  # cells by languages

    def scores(self, text: str) -> tuple[int, np.ndarray]:
        """Trigrams, and the sum of their log-probabilities for each language."""
        grams = trigrams(text)
        total = np.zeros(len(self.langs))
        for i in range(0, len(grams), 1 << 16):
            total += self.log_p[grams[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return len(grams), total


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    *,
    sample_rows: int = 4000,
    most_languages: int = 64,
) -> TextModel:
    """Fit the text model on about ``sample_rows`` rows that have a language."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_languages).collect()
    langs = tuple(sorted(r[0] for r in sizes))
    parts = 1_000_000
    each_lang = sample_rows / max(1, len(langs))
    # Of each language the same number of rows, or all: a rare one is learnt as well as a common one.
    least = {r[0]: math.ceil(min(1.0, each_lang / r["count"]) * parts) for r in sizes}
    mine = F.lit(False)
    for lang, share in least.items():
        mine = mine | ((F.col(lang_col) == lang) & (F.pmod(F.xxhash64(id_col), F.lit(parts)) < share))
    chosen = known.filter(mine).select(F.col(lang_col).alias("l"), F.col(text_col).cast("string").alias("t"))
    index = {lang: i for i, lang in enumerate(langs)}

    def each(batches):
        held = np.zeros((len(langs), CELLS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[index[lang]] += np.bincount(trigrams(text), minlength=CELLS)
        at = np.nonzero(held)
        cell = at[0] * CELLS + at[1]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held[at])], ["cell", "n"])

    counts = np.zeros(len(langs) * CELLS)
    if langs:
        sums = chosen.mapInArrow(each, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts[sums["cell"].to_numpy(np.int64)] = sums["n"]
    counts = counts.reshape(len(langs), CELLS) + 0.5
    return TextModel(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_id, _text, _declared, _host, _domain, _suffix) of raw web pages; _text is the page's markup."""
    page, url = F.coalesce(F.col(html_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    second = host.rlike(r"\.(ac|co|com|edu|go|gob|gov|gouv|ne|net|nom|or|org)\.[a-z]{2}$")
    declared = F.regexp_extract(page, r"(?i)<html[^<>]*\slang\s*=\s*[\"']?([a-z]+)", 1)
    return pages.select(
        F.col(id_col).alias("_id"),
        page.alias("_text"),
        declared.alias("_declared"),
        host.alias("_host"),
        F.when(second, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2)).alias("_domain"),
        F.substring_index(host, ".", -1).alias("_suffix"),
    )


def row_evidence(docs: DataFrame, id_col: str, text_col: str, declared_col: str, host_col: str) -> DataFrame:
    """The same of plain texts whose source stands in for the host."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(text_col).cast("string").alias("_text"),
        F.col(declared_col).cast("string").alias("_declared"),
        host.alias("_host"),
        F.regexp_extract(host, r"^\D*", 0).alias("_domain"),
        F.lit("").alias("_suffix"),
    )


def identify(
    evidence: DataFrame,
    model: TextModel,
    *,
    markup: bool = False,
    host_weight: float = 20.0,
    domain_weight: float = 50.0,
    suffix_weight: float = 200.0,
    min_grams: int = 3,
    min_posterior: float = 0.5,
) -> DataFrame:
    """_id, _text_hash, lang, posterior, text_lang, declared, host, host_rows, n_grams and accepted of each row.

    The weights are the rows that the next wider level counts for in smoothing.
    """
    spark = evidence.sparkSession
    langs = model.langs or ("und",)
    k = len(langs)
    shared = spark.sparkContext.broadcast(model)
    primary = F.lower(F.regexp_extract(F.coalesce(F.col("_declared"), F.lit("")), r"^[A-Za-z]+", 0))
    kept = F.when(primary.isin(*langs), primary).when(primary == "", "none").otherwise("other")
    rows = evidence.select(
        "_id", kept.alias("_declared"), "_host", "_domain", "_suffix", F.xxhash64("_text").alias("_text_hash"), "_text"
    )

    def score(batches):
        known = shared.value
        for batch in batches:
            texts = batch.column(6).to_pylist()
            n, fit = np.zeros(len(texts), np.int64), np.zeros((len(texts), k))
            if known.langs:
                for i, text in enumerate(texts):
                    text = text or ""
                    n[i], fit[i] = known.scores(visible(text) if markup else text)
            best = fit.max(axis=1) / np.maximum(1, n) if len(texts) else np.empty(0)
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), k).cast(pa.list_(pa.float64()))
                for x in (fit / 3, _softmax(fit / 3) if len(texts) else fit)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(n), pa.array(best), *lists],
                [*batch.schema.names[:6], "_n", "_best", "_fit", "_p"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    scored = staged(
        rows.mapInArrow(
            score,
            f"_id {kind}, _declared string, _host string, _domain string, _suffix string, _text_hash long,"
            " _n long, _best double, _fit array<double>, _p array<double>",
        ),
        "language",
    )
    useful = F.when(F.col("_n") >= min_grams, 1.0).otherwise(0.0)
    shares = [F.sum(F.col("_p")[i] * useful) for i in range(k)]

    declared = np.ones((k + 2, k))
    names = [*langs, "none", "other"]
    for r in scored.groupBy("_declared").agg(F.array(*shares).alias("s")).collect():
        declared[names.index(r["_declared"])] += r["s"]
    whole = declared.sum(axis=0) - (k + 2) + 1
    whole = whole / whole.sum()
    said_in = declared.sum(axis=0)

    def with_sums(of: DataFrame, key: str, name: str) -> DataFrame:
        """The hosts with the sums of their domain or suffix, of which one may have most hosts."""
        sums = of.groupBy(key).agg(F.array(*(F.sum(F.col("_hosts")[i]) for i in range(k))).alias(name), F.count("*").alias("_n"))
        return staged(join_hot(of, staged(sums, "sums"), key, "_n", of.count()).drop(key, "_n"), "hosts")

    hosts = scored.groupBy("_host", "_domain", "_suffix").agg(F.array(*shares).alias("_hosts"), F.count("*").alias("host_rows"))
    hosts = with_sums(with_sums(staged(hosts, "hosts"), "_domain", "_domains"), "_suffix", "_suffixes")
    joined = join_hot(scored.drop("_domain", "_suffix"), hosts, "_host", "host_rows", scored.count())

    def fuse(batches):
        def table(column):
            return column.values.to_numpy(zero_copy_only=False).reshape(-1, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            c = dict(zip(batch.schema.names, batch.columns, strict=True))
            n = c["_n"].to_numpy()
            own = table(c["_p"]) * (n >= min_grams)[:, None]

            def smoothed(counts, wider, weight, own=own):
                counts = np.maximum(0, counts - own)
                return (counts + weight * wider) / (counts.sum(axis=1, keepdims=True) + weight)

            domain = smoothed(table(c["_domains"]), whole, domain_weight)
            host = smoothed(table(c["_hosts"]), domain, host_weight)
            suffix = smoothed(table(c["_suffixes"]), whole, suffix_weight)
            said = np.array([names.index(d) for d in c["_declared"].to_pylist()])
            markup = np.log((declared[said] - own) / (said_in - own))
            post = _softmax(table(c["_fit"]) + markup + np.log(suffix / whole) + np.log(host))
            at = post.argmax(axis=1)
            sure = post.max(axis=1)
            good = (n >= min_grams) & (c["_best"].to_numpy() >= FLOOR) & (sure >= min_posterior) & bool(model_langs)
            label = np.array(langs, object)
            yield pa.RecordBatch.from_arrays(
                [
                    c["_id"],
                    c["_text_hash"],
                    pa.array(np.where(good, label[at], "und"), pa.string()),
                    pa.array(sure),
                    pa.array(label[table(c["_p"]).argmax(axis=1)], pa.string()),
                    c["_declared"],
                    c["_host"],
                    c["host_rows"],
                    c["_n"],
                    pa.array(good),
                ],
                ["_id", "_text_hash", "lang", "posterior", "text_lang", "declared", "host", "host_rows", "n_grams", "accepted"],
            )

    model_langs = model.langs
    return joined.mapInArrow(
        fuse,
        f"_id {kind}, _text_hash long, lang string, posterior double, text_lang string, declared string, host string,"
        " host_rows long, n_grams long, accepted boolean",
    )


def drop_rejected(
    docs: DataFrame,
    model: TextModel,
    id_col: str = "doc_id",
    text_col: str = "text",
    declared_col: str = "lang",
    host_col: str = "source",
) -> DataFrame:
    """The input's rows and columns without rows that ``identify`` rejects."""
    with scratch():
        lost = (
            identify(row_evidence(docs, id_col, text_col, declared_col, host_col), model)
            .filter("NOT accepted")
            .select(F.col("_id").alias("_lost"), F.col("_text_hash").alias("_lost_text"))
            .distinct()
        )
        lost = staged(lost, "lost", outlive=True)
    rows = boxed(docs, _id=F.col(id_col), _hash=F.xxhash64(F.col(text_col).cast("string")))
    same = F.col("_id").eqNullSafe(F.col("_lost")) & (F.col("_hash") == F.col("_lost_text"))
    return rows.join(lost, same, "left_anti").select("_row.*")
