"""The training-data operators against brute force on small tables with nulls, copies, ties and odd texts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import (
    bpe,
    components,
    doc_sketch,
    exact_dedup,
    language_id,
    lm_score,
    mixing,
    packing,
    sharding,
    similar,
    simhash,
    staging,
    token_counts,
    window_dedup,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, size int"


def _rows():
    """Odd cases: nulls, empty and long texts, copies, near copies, repeats in and across texts, clashing columns."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma,", "delta.", "été", "naïve", "über", "漢字", "x", "the", "of"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    shared = prose(60)
    long = "\n".join(prose(40) for _ in range(60))
    texts = [None, "", "", " ", "a", "a a a", "De " * 400, shared, shared + " tail", "head " + shared, long, long, long[:-3] + "zzz"]
    texts += [prose(rng.randrange(1, 120)) for _ in range(25)]
    texts += ["same text of a copy"] * 9 + ["x" * 350, "\n\n\n", "tab\tand\x0bodd\x1cspace", "<|endoftext|> in text", "a  b"]
    return [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["src1", "src2", None]), None, i, 1) for i, t in enumerate(texts)]


ROWS = _rows()
TEXT = {r[0]: r[1] or "" for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# exact dedup


@pytest.mark.parametrize(("keep", "best"), [("largest", max), ("smallest", min)])
def test_exact_dedup(docs, keep, best):
    groups = defaultdict(list)
    for i, t in TEXT.items():
        groups[t].append(i)
    got = _by_id(exact_dedup.assign(docs, keep=keep, runs=7, fan_in=2))
    assert len(got) == len(TEXT)
    for i, t in TEXT.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (best(groups[t]), len(groups[t]), i == best(groups[t]))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs, keep=keep)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best(g) for g in groups.values())


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.assign(df).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 3, 2, False), (3, 3, 2, True)], key=str
    )
    left = sorted(((r.doc_id, r.text) for r in exact_dedup.drop_copies(df).collect()), key=str)
    assert left == sorted([(1, "a"), (None, "b"), (3, "")], key=str)


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.assign(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# sharding


def test_sharding_places_and_sizes(docs):
    rows = sharding.shard(docs, n_shards=5, slots=240).collect()
    assert len(rows) == len(TEXT)
    places = defaultdict(list)
    for r in rows:
        data = TEXT[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_slot_map_balances_and_grows(spark, tmp_path):
    rng = random.Random(3)
    sizes = {v: rng.randrange(900, 1100) for v in range(2400)}
    first = sharding.balanced(sizes, 24, 2400)
    load = Counter()
    for v, s in enumerate(first.shard_of):
        load[s] += sizes[v]
    assert max(load.values()) - min(load.values()) <= 1100
    grown = sharding.rebalanced(first, sizes, 25)
    moved = [v for v in range(2400) if grown.shard_of[v] != first.shard_of[v]]
    assert moved and all(grown.shard_of[v] == 24 for v in moved)
    assert grown.version == 2
    assert abs(sum(sizes[v] for v in moved) - sum(sizes.values()) / 25) < 1100
    first.save(spark, str(tmp_path / "map"))
    with pytest.raises(Exception, match="(?i)exists"):
        first.save(spark, str(tmp_path / "map"))
    grown.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == grown
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == first


def test_sharding_by_a_stored_map(docs, spark, tmp_path):
    """Bytes near equal under the law; growth moves rows into the new shard only; a second run keeps to the stored map."""
    path = str(tmp_path / "map")
    rows = sharding.shard_by_stored_map(docs, path, n_shards=4, grow_to=5).collect()
    assert sorted(r.doc_id for r in rows) == sorted(TEXT)
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    # Largest first to the lightest: no shard is further above another than the largest slot.
    slots = Counter()
    for r in rows:
        slots[r.virtual_slot] += r.size
    assert max(load.values()) - min(load[s] for s in range(4)) <= max(slots.values())
    assert all(r.next_shard in (r.shard, 4) for r in rows) and {(r.map_version, r.next_version) for r in rows} == {(1, 2)}
    assert sharding.SlotMap.load(spark, path).n_shards == 5
    again = sharding.shard_by_stored_map(docs, path, n_shards=5).collect()
    assert {r.doc_id: r.shard for r in again} == {r.doc_id: r.next_shard for r in rows}


# components and SimHash


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(30)] + [(1, 1)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _plain_simhash(text: str) -> int:
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum((2 * b > len(shingles)) << i for i, b in enumerate(bits))


def _plain_components(ids, marks, most=3):
    out = {}
    for i in sorted(ids):
        if i in out:
            continue
        todo = [i]
        out[i] = i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in out and (marks[a] ^ marks[b]).bit_count() <= most:
                    out[b] = i
                    todo.append(b)
    return out


def test_simhash_documents(docs):
    marks = {i: _plain_simhash(t) for i, t in TEXT.items()}
    want = _plain_components(list(marks), marks)
    got = _by_id(simhash.near_duplicates(docs))
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == marks
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_links_find_all_close_fingerprints(spark):
    rng = random.Random(11)
    marks = []
    for _ in range(12):
        seed = rng.getrandbits(64)
        marks.append(seed)
        for _ in range(rng.randrange(1, 25)):
            x = rng.choice(marks[-3:])
            for bit in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << bit
            marks.append(x)
    marks = sorted(set(marks))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in marks]
    found = simhash.links(spark.createDataFrame(signed, "_fp long")).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 3 for r in found)
    root = {x: x for x in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        a, b = find(r.a & mask), find(r.b & mask)
        root[max(a, b)] = min(a, b)
    want = _plain_components(marks, dict(zip(marks, marks, strict=True)))
    assert {x: find(x) for x in marks} == want


def test_pipeline_drops_copies_at_similarity(spark):
    """Edited copies at 0.8 to 0.97, beyond 3 bits of SimHash, go in the pipeline; texts below 0.8 stay. Some are of one large group."""
    import corpus_pipeline

    rng = random.Random(21)

    def shingles(words):
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}

    def edited(words, k):
        words = list(words)
        for i in rng.sample(range(len(words)), k):
            words[i] = f"new{rng.randrange(10**9)}"
        return words

    texts = []
    for i in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(150, 300))]
        texts += [base, edited(base, 1 + i % 9)]
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts += [edited(base, rng.randrange(1, 10)) for _ in range(30)] + [[], [], ["two", "words"]]
    sets = [shingles(t) or ({tuple(t)} if t else set()) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, df, "")
    assert kept.columns == df.columns
    want = {find(i) for i in range(len(texts))}
    assert 60 < len(want) < 110
    assert {r.doc_id for r in kept.collect()} == want
    assert similar.drop_similar(df.limit(0)).count() == 0


# encoding, counts, packing


def _library_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    global _TOKENIZER
    if "_TOKENIZER" not in globals():
        _TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return _TOKENIZER.encode(text, add_special_tokens=False)


def test_encoder_equals_the_library():
    rng = random.Random(2)
    parts = [*" \n\t ab1é½ 　'st.!?中", "<|endoftext|>", "  ", "'ll", "\r\n"]
    texts = [t for t in TEXT.values()] + ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(1500)]
    encoder = bpe.Encoder(bpe.default_ranks(), cache=50)
    for t in texts:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == _library_ids(t).ids
        assert int(encoder.lengths(t).sum()) == len(t.encode())


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts_against_every_token(docs, rule):
    got = defaultdict(dict)
    for r in token_counts.count_tokens(docs, rule=rule).collect():
        got[r.doc_id][r.section] = (r.n_bytes, r.n_tokens, r.n_crossing)
        assert r.doc_tokens == len(_library_ids(TEXT[r.doc_id]).ids)
    assert set(got) == set(TEXT)
    encoder = bpe.Encoder(bpe.default_ranks())
    for i, text in TEXT.items():
        lines = text.encode().split(b"\n")
        lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] else [])
        lines = lines or [b""]
        owner = [k for k, x in enumerate(lines) for _ in x]
        want = [[len(x), 0, 0] for x in lines]
        at = 0
        for size in encoder.lengths(text).tolist():
            held = Counter(owner[at : at + size])
            at += size
            k = {"first": min(held), "last": max(held), "most": max(held, key=lambda s: (held[s], -s))}[rule]
            want[k][1] += 1
            want[k][2] += len(held) > 1
        assert [got[i][k] for k in range(len(lines))] == [tuple(w) for w in want]


def test_token_counts_by_field(docs):
    rows = token_counts.count_tokens(docs, fields=["source", "lang", "text"]).collect()
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.n_tokens
    for r in ROWS:
        whole = "\n".join(x or "" for x in (r[3], r[2], r[1]))
        assert total[r[0]] == len(_library_ids(whole).ids)


def _assert_packed(rows, limit):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= limit
    return bins


def test_packing_documents(docs):
    rows = packing.pack_documents(docs, limit=64).collect()
    _assert_packed(rows, 64)
    ids = defaultdict(dict)
    for r in rows:
        ids[r.doc_id][r.start] = r
    for i, text in TEXT.items():
        want = [*_library_ids(text).ids, 1]
        at = 0
        for start, r in sorted(ids[i].items()):
            part = want[start : start + r.length]
            assert (start, r.doc_tokens) == (at, len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r.length
        assert at == len(want)


def test_fill_bins_keeps_every_limit():
    rng = np.random.default_rng(4)
    demand = np.c_[rng.integers(1, 900, 3000), rng.integers(1, 9, 3000), rng.integers(0, 700, 3000)]
    limits = (2048, 16, 1500)
    placed = packing.fill_bins(demand, limits)
    bins = placed[:, 0].max() + 1
    for k, limit in enumerate(limits):
        assert np.bincount(placed[:, 0], demand[:, k]).max() <= limit
    least = max(-(-demand[:, k].sum() // limit) for k, limit in enumerate(limits))
    assert bins <= 1.1 * least
    alone = packing.fill_bins(np.array([[5000, 1, 1], [10, 1, 1]]), limits)
    assert sorted(alone[:, 0]) == [0, 1]


def test_packing_conversations(spark):
    rng = random.Random(9)
    rows = [(c, t, "assistant" if t % 2 else "user", "word " * rng.randrange(1, 60)) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(60, 0, None, None)]
    got = packing.pack_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), limit=512, most_segments=12, most_loss=300
    ).collect()
    assert len(got) == 61
    held = defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        for k, x in enumerate((r.length, r.segments, r.loss_tokens, 1)):
            held[r.sequence_id][k] += x
    assert all(n == 1 or (a <= 512 and b <= 12 and c <= 300) for a, b, c, n in held.values())


# document sketches


def test_sketch_likeness_is_that_of_the_parts(docs):
    order = sorted(TEXT)
    got = _by_id(doc_sketch.fingerprint_edits(docs))
    assert len(got) == len(order)

    def near(a, b):
        a, b = set(doc_sketch.digests(a).tolist()), set(doc_sketch.digests(b).tolist())
        return len(a & b) / len(a | b) if a | b else 1.0

    marks = defaultdict(set)
    for i, nxt in zip(order, order[1:] + order[:1], strict=True):
        r, text, after = got[i], TEXT[i], TEXT[nxt]
        new = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(text, new)) and r.near_next == pytest.approx(near(text, after))
        lost, come = (set(np.array(x, np.int64).view(np.uint64).tolist()) for x in (r.edited_lost, r.edited_new))
        before, now = set(doc_sketch.digests(text).tolist()), set(doc_sketch.digests(new).tolist())
        assert (lost, come) == (before - now, now - before)
        marks[text].add(r.fingerprint)
        marks[new].add(r.edited_fingerprint)
    assert all(len(m) == 1 for m in marks.values())


def test_sketch_over_several_ranges(spark):
    rows = [(i * 7 % 1009, f"text number {i}, of a thousand. " * (i % 5)) for i in range(1009)]
    ordered = doc_sketch.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", per_range=50)
    seen = defaultdict(list)
    for part in ordered.rdd.glom().collect():
        for r in part:
            seen[r._range].append((r._name, r._ahead))
    pairs = {a[0]: b[0] for held in seen.values() for a, b in zip(held, held[1:], strict=False) if not a[1]}
    order = sorted(r[0] for r in rows)
    assert len(seen) > 5 and pairs == dict(zip(order, order[1:] + order[:1], strict=True))


def test_sketch_peels_large_differences():
    """Fingerprints of 15 cells are subtracted, and larger sketches where those can't be peeled."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = np.r_[a[:2000], rng.integers(0, 1 << 63, 2500, dtype=np.uint64)]
    sets = [a, b, np.empty(0, np.uint64), a[:3], np.r_[a[1:], a[:1]]]
    marks = doc_sketch.Sketches.of(sets).texts([len(s) for s in sets])
    assert marks[0] == marks[4] and all(len(m) == len(marks[0]) for m in marks)
    pairs = [(0, 1), (0, 0), (2, 2), (2, 3), (0, 4), (3, 0)]
    for (i, j), (lost, new) in zip(pairs, doc_sketch.differences(marks, sets, pairs), strict=True):
        assert lost.tolist() == np.setdiff1d(sets[i], sets[j]).tolist() and new.tolist() == np.setdiff1d(sets[j], sets[i]).tolist()


def test_sketch_with_string_ids(spark):
    rows = [("b", "one line\nand more"), ("a", "x"), (None, "first"), ("c", None)]
    got = _by_id(doc_sketch.fingerprint_edits(spark.createDataFrame(rows, "doc_id string, text string")))
    assert got[None].edited_sha256 == hashlib.sha256(b"firsx").hexdigest() and got["c"].near_edited == 1.0
    assert got["b"].edited_sha256 == hashlib.sha256(b"one line\nand ").hexdigest()


# repeated windows


def _plain_windows(texts, window):
    seen, out = {}, []
    for k, t in enumerate(texts):
        covered = bytearray(len(t))
        for s in range(len(t) - window + 1):
            if seen.setdefault(t[s : s + window], (k, s)) != (k, s):
                covered[s : s + window] = b"\1" * window
        kept = bytes(c for c, x in zip(t, covered, strict=True) if not x)
        out.append((len(t), sum(covered), len([x for x in bytes(covered).split(b"\0") if x]), kept))
    return out


@pytest.mark.parametrize("hot_share", [1024, 1])
def test_window_dedup(docs, hot_share):
    """With few runs nearly all anchors are hot at the default; at 1 none is."""
    order = sorted(TEXT)
    want = dict(zip(order, _plain_windows([TEXT[i].encode() for i in order], 100), strict=True))
    got = _by_id(window_dedup.remove_repeats(docs, hot_share=hot_share))
    assert len(got) == len(order)
    for i in order:
        r, (n, removed, spans, kept) = got[i], want[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept) == (n, removed, spans, kept)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("kind", ["long", "string"])
def test_window_dedup_by_id_and_text(spark, kind):
    """Unequal texts at one id are documents of their own; equal rows are one; ids may be strings or null."""
    rng = random.Random(10)
    b, c, d = ("".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(3))
    ids = ["1", "2", "2", "2", "10", None, "3"]
    texts = [b, b, c, c, b[:150] + d, d[:120], c[50:]]
    rows = [(i if i is None or kind == "string" else int(i), t) for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(3)
    out = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in window_dedup.remove_repeats(df).collect())
    # A null id is least, then ids in their order; as strings "10" comes before "2".
    want = [("None", 120, 0), ("1", 200, 0), ("2", 200, 200), ("2", 200, 0), ("2", 200, 0), ("3", 150, 150), ("10", 350, 150 + 120)]
    assert out == sorted(want)


def test_window_dedup_of_a_passage_in_many_documents(spark):
    """A passage with its own surroundings in each document, and many copies of one text, by either way of dealing."""
    rng = random.Random(11)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, copy = prose(45), prose(70)
    texts = [prose(rng.randrange(5, 30)) + " " + passage + " " + prose(rng.randrange(5, 30)) for _ in range(60)] + [copy] * 40
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = _plain_windows([t.encode() for t in texts], 100)
    for share in (1024, 20, 1):
        got = _by_id(window_dedup.remove_repeats(df, hot_share=share))
        assert [(got[i].n_removed, got[i].n_spans, got[i].kept) for i in range(100)] == [w[1:] for w in want]


def test_window_dedup_across_blocks(spark, monkeypatch):
    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(3000))
    texts = [text, text[700:1500] + "q" * 300 + text[100:500], "z" + text[:900], "q" * 130]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = _by_id(window_dedup.remove_repeats(df))
    for i, (n, removed, spans, kept) in enumerate(_plain_windows([t.encode() for t in texts], 100)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (n, removed, spans, kept)
    monkeypatch.setattr(window_dedup, "BLOCK", 256)
    parts = list(window_dedup._blocks([t.encode() for t in texts], 100))
    assert sum(len(where) for _, where in parts) > len(texts)
    starts = {(i, at + k) for _, where in parts for i, at, a, b in where for k in range(b - a - 99)}
    assert starts == {(i, k) for i, t in enumerate(texts) for k in range(len(t) - 99)}


def test_near_copies_meet_by_deletion_variants_alone(spark):
    """Without extra signatures: a word changed near the end of a long text, and a text with the words in another order."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(rng.sample(words, 4000))]
    rows = similar.signed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", 5)
    rows = staging.staged(rows.withColumn("_keys", F.array().cast("array<long>")), "unsigned")
    name = {r["_id"]: r["_fp"] for r in rows.collect()}
    assert {frozenset(r) for r in similar.links(rows).collect()} == {frozenset((name[0], name[1]))}
    assert similar.links(rows, least=0.9999).count() == 0


def test_staged_tables_leave_no_shuffle_files(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in Path(folder).rglob("shuffle_*")}

    before, table = files(), spark.range(1000).repartition(3, F.col("id"))
    assert staging.staged(table, "shuffled").count() == 1000
    assert not [f for f in files() - before if f.stat().st_size > 2000]


# language-model scores


def test_lm_score_base_and_model(docs):
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in TEXT.items()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in TEXT}
    c = Counter(w for i, ts in tokens.items() if not out[i] for w in ts)
    total = sum(c.values())
    for hot in (131_072, 8):
        got = _by_id(lm_score.score(docs, hot_words=hot, most_pair_words=8, most_blocks=4))
        assert len(got) == len(TEXT)
        for i, ts in tokens.items():
            r = got[i]
            base = sum(np.log10((c[w] + 0.1) / (total + 0.1 * (len(c) + 1))) for w in ts)
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(ts), sum(c[w] > 0 for w in ts), total)
            assert r.base_score == pytest.approx(base)
            assert np.isfinite(r.score) and r.score < 0


def test_bloom_reads_counts_back():
    rng = np.random.default_rng(6)
    words = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    counts = np.maximum(1, (rng.pareto(1.0, 4000) * 2).astype(np.int64))
    bloom = lm_score.Filter(1)
    none = np.empty(0, np.uint64)
    made = lm_score.build_block(words, counts, none, none, np.empty(0, np.int64), {})
    assert made["lost_words"] == 0 and made["worth"] == lm_score.WORTH[lm_score.level_of(counts)].sum()
    bloom.data[:] = np.frombuffer(made["bits"], np.uint8)
    level = bloom.levels(lm_score.unit_keys(words), np.zeros(4000, np.int64))
    want = lm_score.level_of(counts)
    assert (level >= want).all() and (level == want).mean() > 0.9
    other = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    assert (bloom.levels(lm_score.unit_keys(other), np.zeros(4000, np.int64)) == 0).mean() > 0.9


def _katz(lines, out):
    """The model by dictionaries: P(word | context) with the counts that levels stand for."""
    worth = lambda n: float(lm_score.WORTH[lm_score.level_of(np.array([n]))[0]])
    unit, pair, before = Counter(), Counter(), Counter()
    for i, words in lines.items():
        if not out[i]:
            unit.update([*words, b"\n"])
            pair.update(zip([b"\r", *words], [*words, b"\n"], strict=True))
    before.update(unit)
    before[b"\r"] = unit[b"\n"]
    mass = sum(worth(n) + 0.1 for n in unit.values()) + 0.1
    alone = lambda w: (worth(unit[w]) + 0.1 if w in unit else 0.1) / mass
    after = defaultdict(dict)
    for (v, w), n in pair.items():
        if n > 1:
            after[v][w] = worth(n)

    def p(w, v):
        if v not in after:
            return alone(w)
        whole = max(before[v], sum(after[v].values()))
        if w in after[v]:
            return (after[v][w] - 0.5) / whole
        left = 1 - sum(n - 0.5 for n in after[v].values()) / whole
        return left / (1 - sum(alone(x) for x in after[v])) * alone(w)

    return p, unit, after


def test_lm_score_is_that_of_the_exact_model(spark):
    """Against Katz back-off by dictionaries; chance hits of probes (one in 500 at full load) are few here."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(150)]
    texts = {i: " ".join(rng.choices(words, weights=range(1, 151), k=rng.randrange(0, 60))) for i in range(500)}
    got = _by_id(lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    lines = {i: t.encode().split() for i, t in texts.items()}
    p, unit, after = _katz(lines, {i: got[i].held_out for i in texts})
    for v in (b"\r", b"w149", b"w3", b"nowhere"):
        # Over all words and one unseen.
        assert sum(p(w, v) for w in [*unit, b"unseen"]) == pytest.approx(1, abs=1e-6)
    assert len(after) > 100
    off = [abs(got[i].score - sum(np.log10(p(w, v)) for v, w in zip([b"\r", *ws], [*ws, b"\n"], strict=True))) for i, ws in lines.items()]
    assert np.mean(np.array(off) < 1e-6) > 0.95


@pytest.mark.parametrize("most", [{"most_pair_words": 8}, {"hot_words": 8, "most_pair_words": 4}])
def test_lm_bounds_of_the_broadcast_lose_no_word_or_pair(spark, most):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choices(words, weights=range(1, 301), k=rng.randrange(0, 90))) for i in range(700)}
    got = _by_id(lm_score.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), **most))
    lines = {i: t.encode().split() for i, t in texts.items()}
    p, unit, after = _katz(lines, {i: got[i].held_out for i in texts})
    off = [abs(got[i].score - sum(np.log10(p(w, v)) for v, w in zip([b"\r", *ws], [*ws, b"\n"], strict=True))) for i, ws in lines.items()]
    assert np.mean(np.array(off) < 1e-6) > 0.95


def test_lm_score_keeps_only_the_tables_and_shuffles_it_still_reads(spark):
    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for folder in folders for f in Path(folder).rglob("shuffle_*")}

    def tables():
        return set(Path(staging.shared_root(spark).removeprefix("file:")).glob("assayer/*"))

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, " ".join(rng.choices(words, weights=range(1, 301), k=rng.randrange(0, 90)))) for i in range(700)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    before, had = files(), tables()
    scored = lm_score.score(table, most_pair_words=8)
    # The lazy result reads words' counts and weights, pairs left to the join and documents.
    assert sorted(t.name.split("-")[0] for t in tables() - had) == ["counts", "more", "rare", "scored"]
    assert not [f for f in files() - before if f.stat().st_size > 2000]
    assert scored.count() == len(texts)


def test_lm_block_leaves_pairs_without_room_to_the_join():
    rng = np.random.default_rng(8)
    context, word = (rng.integers(1, 1 << 63, 12_000, dtype=np.uint64) for _ in range(2))
    n = np.arange(12_000) % 6 + 1
    none = np.empty(0, np.uint64)
    made = lm_score.build_block(none, np.empty(0, np.int64), context, word, n, dict.fromkeys(word.tolist(), 9))
    bloom = lm_score.Filter(1)
    bloom.data[:] = np.frombuffer(made["bits"], np.uint8)
    pairs = zip(made["left_contexts"].view(np.uint64).tolist(), made["left_words"].view(np.uint64).tolist(), strict=True)
    left = dict(zip(pairs, made["left_n"].tolist(), strict=True))
    level = bloom.levels(lm_score.pair_keys(context, word), np.zeros(12_000, np.int64))
    assert 0 < made["lost_pairs"] == len(left) < (n > 1).sum()
    for v, w, k, found in zip(context.tolist(), word.tolist(), n.tolist(), level, strict=True):
        assert left[v, w] == k if (v, w) in left else k == 1 or found > 0


def test_lm_blocks_own_up_to_what_they_lose():
    rng = np.random.default_rng(7)
    words = rng.integers(1, 1 << 63, 20_000, dtype=np.uint64)
    none = np.empty(0, np.uint64)
    made = lm_score.build_block(words, np.arange(20_000) % 5 + 1, none, none, np.empty(0, np.int64), {})
    assert 0 < made["lost_words"] < 20_000


def test_lm_model_beats_base_on_held_out_text(spark):
    rng = random.Random(1)
    tongues = [[f"{p}{i}" for i in range(60)] for p in "ab"]
    rows = [(i, " ".join(rng.choices(tongues[i % 2], k=80))) for i in range(600)]
    r = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").collect()
    assert sum(x.score for x in r) > sum(x.base_score for x in r)


# language identification


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    words = {"en": ["the", "of", "and", "thing", "with"], "de": ["der", "und", "nicht", "schön"], "fr": ["le", "où", "été", "dans"]}
    rows = [(i, " ".join(rng.choices(words[k], k=40)), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    return words, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_pages(spark, tongues):
    words, labelled = tongues
    model = language_id.train(labelled)
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(90):
        k = rng.choice(["en", "de", "fr"])
        said = rng.choice([k, k, k, "en", None])
        tag = f' lang="{said}-XX"' if said else ""
        body = " ".join(rng.choices(words[k], k=30))
        html = f"<html{tag}><script>the the the</script><!-- und --><nav>le le</nav><p>{body} &amp; 7 < 8</p></html>"
        rows.append((i, f"https://user@www.{k}.example.{k}:80/x", html))
        want[i] = k
    # Without text of its own, a page goes by its host and markup.
    rows += [(90, "https://www.de.example.de/", "<p>und und</p>"), (91, None, None), (92, "no address", "<html lang='de'>")]
    rows.append((93, "https://www.fr.example.fr/", "漢字仮名交じり文" * 20))
    got = _by_id(language_id.identify(language_id.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string")), model, markup=True), "_id")
    assert len(got) == 94
    assert {i: got[i].lang for i in want} == want and all(got[i].accepted for i in want)
    assert got[90].lang == "de"
    assert not got[91].accepted and not got[92].accepted and not got[93].accepted
    assert got[0].host == f"www.{want[0]}.example.{want[0]}"


def test_page_text_survives_letters_that_grow_in_lower_case():
    page = "İ" * 40 + "<SCRIPT>x</Script><p>the text after</p><nav>aside</nav> and more <style>never closed"
    assert " ".join(language_id.visible(page).split()) == "İ" * 40 + " the text after and more"


def test_language_posterior_is_that_of_the_formula(spark, tongues):
    """Every row's posterior recomputed from counts by dictionaries, its own share taken out."""
    words, labelled = tongues
    model = language_id.train(labelled)
    rng = random.Random(15)
    hosts = ["a.co.uk", "www.a.co.uk", "b.co.uk", "x.example.de", "y.example.de", "z.fr", ""]
    rows = []
    for i in range(60):
        k = rng.choice(["en", "de", "fr"])
        rows.append((i, rng.choice(["", " ".join(rng.choices(words[k], k=rng.randrange(1, 4)))]), rng.choice(["en", "de", "xx", ""]), rng.choice(hosts)))
    html = [(i, f"https://{h}/" if h else None, f"<html lang='{d}'>{t}" if d else t) for i, t, d, h in rows]
    got = _by_id(language_id.identify(language_id.page_evidence(spark.createDataFrame(html, "page_id long, url string, html string")), model, markup=True), "_id")
    k = len(model.langs)
    domain = lambda h: ".".join(h.split(".")[-3:] if h.endswith("co.uk") else h.split(".")[-2:])
    of = [("host", lambda r: r[3]), ("domain", lambda r: domain(r[3])), ("suffix", lambda r: r[3].rpartition(".")[2])]
    names = {"en": "en", "de": "de", "xx": "other", "": "none"}
    fit, own = {}, {}
    for r in rows:
        n, total = model.scores(language_id.visible(r[1]))
        fit[r[0]] = total / 3
        e = np.exp(fit[r[0]] - fit[r[0]].max())
        own[r[0]] = e / e.sum() * (n >= 3)
    sums = {kind: defaultdict(lambda: np.zeros(k)) for kind in ("host", "domain", "suffix", "said")}
    for r in rows:
        for kind, key in of:
            sums[kind][key(r)] = sums[kind][key(r)] + own[r[0]]
        sums["said"][names[r[2]]] = sums["said"][names[r[2]]] + own[r[0]]
    whole = sum(own.values()) + 1
    whole = whole / whole.sum()
    smooth = lambda c, wider, w: (c + w * wider) / (c.sum() + w)
    for r in rows:
        i = r[0]
        host, dom, suffix = (np.maximum(0, sums[kind][key(r)] - own[i]) for kind, key in of)
        prior = smooth(host, smooth(dom, whole, 50.0), 20.0)
        said = (sums["said"][names[r[2]]] + 1 - own[i]) / (sum(own.values()) + k + 2 - own[i])
        z = fit[i] + np.log(said) + np.log(smooth(suffix, whole, 200.0) / whole) + np.log(prior)
        e = np.exp(z - z.max())
        assert got[i].posterior == pytest.approx(e.max() / e.sum(), rel=1e-9)


def test_language_evidence_decides_ambiguous_text(spark, tongues):
    _, labelled = tongues
    model = language_id.train(labelled)
    rows = [(i, "der und nicht schön der und nicht", "de", "a1") for i in range(40)] + [(100, "an in", "de", "a1"), (101, "an in", "fr", "b1")]
    rows += [(200 + i, "le où été dans le où", "fr", "b1") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = _by_id(language_id.identify(language_id.row_evidence(df, "doc_id", "text", "lang", "source"), model), "_id")
    assert (got[100].lang, got[101].lang) == ("de", "fr")


def test_language_filter_keeps_rows_and_columns(docs, none):
    labelled = docs.filter("lang IS NOT NULL")
    kept = language_id.drop_rejected(docs, language_id.train(labelled))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert all(i in ids for i, t in TEXT.items() if len(t.split()) > 20) and all(i not in ids for i, t in TEXT.items() if not t.strip())
    assert language_id.drop_rejected(docs, language_id.train(none)).count() == 0


# mixing


def test_mixing_meets_targets_and_drops_toxic_text(spark):
    rng = random.Random(3)

    def text(kind):
        words = [f"w{rng.randrange(400)}" for _ in range(80)]
        if kind == "toxic":
            words[::9] = ["vile"] * len(words[::9])
        return " ".join(w + " junk" * 3 if kind == "low" else w for w in words)

    kinds = [rng.choice(["good", "good", "good", "low", "toxic"]) for _ in range(1500)]
    docs = spark.createDataFrame([(i, text(k), k) for i, k in enumerate(kinds)] + [(5000, None, None)], "doc_id long, text string, kind string")
    labels = spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kinds[:700])] + [(3, None, 1)], "doc_id long, quality int, toxic int")
    got = mixing.mix(docs, labels, targets={"low": 0.05, "toxic": 0.005, "good": 0.945})
    rows = got.collect()
    assert len(rows) == 1501
    totals = np.zeros(3)
    for r in rows:
        totals += r.tokens * r.rate * np.array([r.p_low, r.p_toxic, r.p_good])
    assert np.abs(totals / totals.sum() - [0.05, 0.005, 0.945]).max() < 0.01
    copies = {r.doc_id: r.copies for r in rows}
    assert np.mean([copies[i] > 0 for i, k in enumerate(kinds) if k == "good"]) > 0.99
    assert np.mean([copies[i] == 0 for i, k in enumerate(kinds) if k == "toxic"]) > 0.95
    kept = mixing.mixed(docs, labels, targets={"low": 0.05, "toxic": 0.005, "good": 0.945})
    assert kept.columns == docs.columns and kept.count() == sum(copies.values())


def test_mixing_copies_meet_targets(spark):
    """Domains with fitted rates under 0.25 keep their share of tokens in the copies too."""
    rng = random.Random(8)

    def text(kind):
        words = [f"w{rng.randrange(400)}" for _ in range(40)]
        if kind == "toxic":
            words[::5] = ["vile"] * len(words[::5])
        return " ".join("junk" if kind == "low" and i % 2 else w for i, w in enumerate(words))

    kinds = [rng.choice(["good", "low", "toxic"]) for _ in range(6000)]
    docs = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kinds)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kinds[:900])], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, labels, targets={"low": 0.13, "toxic": 0.07, "good": 0.8}).collect()
    post = np.array([[r.p_low, r.p_toxic, r.p_good] for r in rows])
    tokens, rate, copies = (np.array([r[c] for r in rows], float) for c in ("tokens", "rate", "copies"))
    assert (rate < 0.25).sum() > 3000 and (np.abs(copies - rate) < 1).all()
    made = (tokens * copies) @ post
    assert np.abs(made / made.sum() - [0.13, 0.07, 0.8]).max() < 0.02


def test_rates_by_projected_gradient(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(rng.integers(1, 90, 400), p, strict=True)]
    members = spark.createDataFrame(rows, "_tokens long, _p array<double>")
    steps = mixing.fit_rates(members, {"low": 0.3, "toxic": 0.1, "good": 0.6}, rounds=60)
    rate = mixing._rates(p, steps)
    totals = np.array([t for t, _ in rows]) * rate @ p
    assert (rate >= 0).all() and np.abs(totals / totals.sum() - [0.3, 0.1, 0.6]).max() < 0.002


def test_rates_reach_hard_targets_and_own_up_to_impossible_ones(spark):
    """Soft posteriors whose least toxic share is just in reach: plain projected gradient needs thousands of rounds."""
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.dirichlet([0.4, 0.3, 9], 500), rng.dirichlet([5, 0.5, 0.5], 100), rng.dirichlet([0.5, 5, 0.5], 100)])
    tokens = rng.integers(1, 300, 700)
    members = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "_tokens long, _p array<double>")
    want = np.array([0.04, 0.008, 0.952])
    steps = mixing.fit_rates(members, dict(zip(mixing.DOMAINS, want, strict=True)))
    rate = mixing._rates(p, steps)
    totals = (tokens * rate) @ p
    assert (rate >= 0).all() and np.abs(totals / totals.sum() - want).max() < 0.002
    # Brute force: the same least squares by plain projected gradient, to its end.
    full = tokens @ p
    goal = want / want[2] * full[2]
    slow, scale = np.ones(700), np.linalg.inv((p * tokens[:, None]).T @ p)
    for _ in range(20_000):
        slow = np.maximum(0, slow - p @ (scale @ ((tokens * slow) @ p - goal)))
    assert np.abs((tokens * slow) @ p - goal).sum() / goal.sum() < 0.002
    assert np.abs(totals - (tokens * slow) @ p).sum() / goal.sum() < 0.004
    with pytest.warns(mixing.TargetsNotMet):
        mixing.fit_rates(members, {"low": 0.04, "toxic": 0.0, "good": 0.96}, rounds=30)


def test_mixing_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.copies for r in mixing.mix(docs, labels).collect()} == {1}
    assert mixing.mixed(docs, labels).count() == len(TEXT)


# empty tables, and the pipeline


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    made = [
        exact_dedup.assign(none),
        exact_dedup.drop_copies(none),
        sharding.shard(none),
        simhash.near_duplicates(none),
        simhash.drop_near_duplicates(none),
        packing.pack_documents(none),
        token_counts.count_tokens(none),
        doc_sketch.fingerprint_edits(none),
        window_dedup.remove_repeats(none),
        lm_score.score(none),
        mixing.mixed(none, labels),
        language_id.drop_rejected(none, language_id.train(none)),
    ]
    assert [df.count() for df in made] == [0] * len(made)


def test_null_ids_and_repeated_rows_do_not_break(spark):
    rows = [(None, "some words of a text"), (None, None), (1, "some words of a text"), (1, "some words of a text"), (2, "x " * 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = [
        exact_dedup.assign(df),
        sharding.shard(df),
        simhash.near_duplicates(df),
        doc_sketch.fingerprint_edits(df),
        window_dedup.remove_repeats(df),
        lm_score.score(df),
    ]
    assert [m.count() for m in made] == [5] * len(made)
    assert packing.pack_documents(df).count() == 5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)

    def prose(words):
        return " ".join(rng.choice(words) + rng.choice(words) for _ in range(80))

    words = ["the", "of", "thing", "and", "with", "er", "ing"]
    rows = [(i, prose(words), "en", f"src{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src0", 0) for i in range(10)] + [(200, "", "en", "src0", 0), (201, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        path = f"{tmp_path}/out{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert counts[0] == set(range(60)) | set(range(100, 110))
    assert counts[1] == set(range(10, 60)) | set(range(100, 110))
    assert counts[2] >= counts[3] == counts[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == counts[4]


def test_filters_keep_columns_with_any_name(docs, spark):
    names = ["_row", "_hash", "_digest", "_nth", "_copy", "copies", "_k", "_lost", "_stays", "_lost_id", "_fp", "quality", "toxic"]
    odd = docs.withColumns({n: docs.n_chars for n in names}).filter("doc_id < 60")
    labels = spark.createDataFrame([(i * 3, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    made = [
        exact_dedup.drop_copies(odd),
        simhash.drop_near_duplicates(odd),
        language_id.drop_rejected(odd, language_id.train(odd)),
        mixing.mixed(odd, labels),
    ]
    assert [m.columns for m in made] == [odd.columns] * 4
    assert all(m.count() <= odd.count() for m in made[:3]) and made[3].count() > 0
    for m in (exact_dedup.assign, sharding.shard, simhash.near_duplicates, packing.pack_documents, window_dedup.remove_repeats):
        assert m(odd).count() >= odd.count()
