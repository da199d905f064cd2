"""The dealt operators against plain versions, on the smallest tables and on odd ones."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sieveline.llm import (
    decontaminate, language_id, line_dedup, mixing, near_duplicates, nearest, quality, sharding, token_counts, token_files,
)
from sieveline.llm.common import held_out
from sieveline.llm.oracles import ORACLES
from sieveline.llm.queries import QUERIES
from sieveline.sources.shared import shared_folder
from tools.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    found, expected = QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


# Token counts and token files

@tables
def test_token_counts(docs, odd, none):
    encoder = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (docs, odd):
        expected = Counter((r.doc_id, len((r.text or "").encode()), n := len(encoder.encode(r.text or "")), n > 4096) for r in df.collect())
        assert Counter(tuple(r) for r in token_counts.count_tokens(df, MODEL).collect()) == expected
        assert Counter(tuple(r) for r in token_counts.count_tokens(df, MODEL, cached=3, frequent=2).collect()) == expected
    assert token_counts.count_tokens(none, MODEL).collect() == []


@tables
def test_token_files(spark, docs, odd, none):
    encoder = Tokenizer.from_file(WORDS)
    for df in (docs, odd):
        folder = shared_folder(spark)
        token_files.write_tokens(df, folder, WORDS)
        ids = {}
        for r in df.collect():
            ids.setdefault(r.doc_id, []).append(encoder.encode(r.text or "", add_special_tokens=False).ids + [2])
        stored = token_files.read_tokens(spark, folder).collect()
        assert Counter((r.doc_id, tuple(r.tokens)) for r in stored) == Counter((i, tuple(x)) for i, xs in ids.items() for x in xs)
        found = sorted(token_files.token_digest(spark, folder).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in found] == sorted((r.doc_id for r in stored), key=lambda i: -1 if i is None else i)
        at = 0
        for r in found:
            assert r.start == at
            assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[r.doc_id]]
            at += r.n_tokens
    folder = shared_folder(spark)
    token_files.write_tokens(none, folder, WORDS)
    assert token_files.token_digest(spark, folder).collect() == []


# Language and quality

@tables

def test_word_ids_are_those_of_the_library():
    draw = random.Random(5)
    kinds = ["aAbé É'stre.,!? \t\n\r\xa0\x85\x1c12<|>endoftext-_ßµªñ\u0301Σİ日", "aAbéÉ 'stremvld.,!? \t\n\x0b\x0c1ß-"]
    texts = ["".join(draw.choice(kinds[i % 2]) for _ in range(draw.randint(0, 40))) for i in range(4000)]
    texts += ["<|ENDOFTEXT|>. foo", "foo<|endoftext|>.bar", "don't. 'sure' it's,", "A.B,c d..e", "x" * 3000 + ".", "ÀÉÎ, ßÿ÷×."]
    encoder = Tokenizer.from_file(WORDS)
    for most in (50, 100_000):  # with and without words forgotten on the way
        ids = token_files.WordIds(WORDS, most)
        for at in range(0, len(texts), 200):
            part = texts[at:at + 200]
            assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(part)] == [encoder.encode(t, add_special_tokens=False).ids for t in part]


def test_languages(docs, odd, none):
    profiles = language_id.learn_profiles(docs.where(~held_out("doc_id")))
    grams = Counter(g for r in docs.where(~held_out("doc_id")).where("lang = 'fr'").collect() for g in language_id.gram_codes(r.text).tolist())
    assert profiles["fr"].tolist() == [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:300]]
    found = {r.doc_id: r for r in language_id.predict_languages(docs, profiles).collect()}
    for r in docs.limit(40).collect():
        mine = language_id.top_grams(language_id.gram_codes(r.text), 300).tolist()
        far = {n: sum(abs(i - p.tolist().index(g)) if g in p else 300 for i, g in enumerate(mine)) for n, p in profiles.items()}
        assert found[r.doc_id].lang_pred == min(sorted(far), key=far.get)
        assert found[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    tested = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].lang_pred == truth[i] for i in tested]) >= 0.95
    odd_rows = language_id.predict_languages(odd, profiles).collect()
    assert len(odd_rows) == odd.count()
    assert {r.lang_pred for r in odd_rows if r.doc_id in (3, 4, 5, 11)} == {"und"}
    assert all(0 <= r.score <= 1 for r in odd_rows)
    assert language_id.learn_profiles(none) == {}
    assert {r.lang_pred for r in language_id.predict_languages(odd, {}).collect()} == {"und"}


@tables
def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    net = quality.learn_quality(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.score_quality(docs, net).collect()
    tested = [r for r in found if r.held_out and r.doc_id in truth]
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert np.mean([r.predicted == truth[r.doc_id] for r in tested]) >= 0.9
    scored = quality.score_quality(odd, net).collect()
    assert len(scored) == odd.count() and not any(np.isnan(r.score) for r in scored)
    good = Counter(r.doc_id for r in scored if r.predicted)
    assert Counter(r.doc_id for r in quality.keep_quality(odd, net).collect()) == good
    assert quality.keep_quality(odd, net).columns == odd.columns
    assert quality.score_quality(none, net).collect() == []
    assert len(quality.score_quality(odd, quality.learn_quality(none, labels)).collect()) == odd.count()


def test_peaks_are_the_same_in_parts():
    """Chunks of a long text taken in parts equal those of a plain slide over the whole text."""
    net = quality.Network.new(3)
    text = np.random.default_rng(1).integers(0, 256, 40_001).astype(np.uint8).tobytes()
    peaks, spots, codes = quality.chunk_peaks(net, text, True)
    plain = np.array([net.embed[codes[i:i + quality.WIDTH]].ravel() @ net.filters for i in quality.windows(text)])
    starts = range(0, len(plain) - quality.HOP, quality.HOP)
    expected = np.array([plain[s:s + quality.CHUNK].max(axis=0) for s in starts])
    assert np.allclose(peaks, expected, atol=1e-4)
    assert (len(plain) - 1) * quality.STEP + quality.WIDTH >= len(text)
    assert np.allclose(plain[spots, np.arange(quality.FILTERS)], peaks, atol=1e-4)


# Mixing

def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), ("d", 5), (None, 300), ("e", 0)], "source string, size long")
    found = {r.source: r for r in mixing.source_targets(sizes).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    own = {"a": 10, "b": 1000, "c": 500, "d": 5, None: 300, "e": 0}
    full: set = set()
    while True:  # share what is left among the others until none is above its bound
        left, open_weight = 1815 - sum(3 * own[s] for s in full), sum(w for s, w in weights.items() if s not in full)
        target = {s: 3 * own[s] if s in full else left * w / open_weight for s, w in weights.items()}
        above = {s for s in weights if target[s] > 3 * own[s]}
        if not above:
            break
        full |= above
    assert {s: round(r.target, 6) for s, r in found.items()} == {s: round(t, 6) for s, t in target.items()}


def test_mix(odd, none):
    found = mixing.repeats(odd).collect()
    assert len(found) == odd.count()
    assert sorted(r.size for r in found) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in odd.collect())
    assert all(0 <= r.copies <= 3 for r in found)
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns
    assert Counter(r.doc_id for r in taken.collect()) == +Counter({i: sum(r.copies for r in found if r.doc_id == i) for i in {r.doc_id for r in found}})
    assert mixing.repeats(none).collect() == [] and mixing.mix(none).collect() == []


# Decontamination

def test_odd_passages(spark, odd, none):
    items = spark.createDataFrame([(1, "Lazy DOG, while seven; wise owls watch from an old oak"), (2, "short one"), (3, None), (4, "!!"), (None, "日本語"),
                                   (5, "short one"), (6, "nothing of the sort occurs anywhere in these few documents at all")], "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    cut = lambda t: word.findall((t or "").translate(lower))
    grams: dict = {}
    for i in items.collect():
        w = cut(i.text)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            grams.setdefault(tuple(w[k:k + 10]), set()).add("" if i.item_id is None else str(i.item_id))
    expected = Counter()
    for r in odd.collect():
        w, hit, ids = cut(r.text), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in grams:
                    hit |= set(range(k, k + n))
                    ids |= grams[tuple(w[k:k + n])]
        expected[r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    assert Counter(tuple(r) for r in decontaminate.contamination(odd, items).collect()) == expected
    limit, decontaminate.HASHES = decontaminate.HASHES, 1  # the way for sets too large for a plan
    try:
        assert Counter(tuple(r) for r in decontaminate.contamination(odd, items).collect()) == expected
    finally:
        decontaminate.HASHES = limit
    clean = decontaminate.decontaminate(odd, items)
    assert clean.columns == odd.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(k[0] for k in expected.elements() if not k[5])
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(odd, items, "spans").collect()}
    assert spans[9] == "" and spans[1].endswith("over the tree near the quiet river bank") and spans[6] == odd.where("doc_id = 6").first().text
    assert decontaminate.contamination(none, items).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(odd, items.limit(0)).collect())


# Near duplicates

def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(0)
    bags = []
    for _ in range(40):
        values = rng.integers(0, 2 ** 60, 40).astype(np.uint64)
        bags += [np.repeat(values, rng.integers(0, 7, 40)), np.repeat(values, rng.integers(0, 7, 40))]
    found = near_duplicates.signatures(bags, 1024)
    errors = [(found[i] == found[i + 1]).mean() - near_duplicates.similarity(bags[i], bags[i + 1]) for i in range(0, 80, 2)]
    assert abs(np.mean(errors)) < 0.01 and np.abs(errors).max() < 0.07


def classes_of(rows):
    """Classes by comparing all pairs of texts."""
    hashes = near_duplicates._WordHashes()
    texts = sorted({r.text for r in rows if r.text and r.doc_id is not None})
    bags = [near_duplicates.shingles(t, hashes) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if near_duplicates.similarity(bags[i], bags[j]) >= 0.8:
                parent[root(i)] = root(j)
    ids: dict = {}
    for r in rows:
        if r.text and r.doc_id is not None:
            ids.setdefault(root(texts.index(r.text)), []).append(r.doc_id)
    return Counter((r.doc_id, min(ids[root(texts.index(r.text))]) if r.text and r.doc_id is not None else r.doc_id) for r in rows)


@tables
def test_duplicate_classes(spark, docs, odd, none):
    base = [f"w{i}" for i in range(200)]
    rng = np.random.default_rng(4)
    copies = []  # a group in which many pairs are near 0.8, on either side
    for i in range(60):
        words = list(base)
        for k in rng.choice(200, rng.integers(0, 9), replace=False):
            words[k] = f"x{rng.integers(1000)}"
        copies.append((i, " ".join(words)))
    for df in (docs, odd, spark.createDataFrame(copies, "doc_id long, text string")):
        assert Counter(tuple(r) for r in near_duplicates.duplicate_classes(df).collect()) == classes_of(df.collect())
    small, near_duplicates.SMALL_BUCKET = near_duplicates.SMALL_BUCKET, 1  # every open bucket by longer signatures
    try:
        assert Counter(tuple(r) for r in near_duplicates.duplicate_classes(df).collect()) == classes_of(df.collect())
    finally:
        near_duplicates.SMALL_BUCKET = small
    stay = near_duplicates.drop_near_duplicates(odd)
    assert stay.columns == odd.columns
    kept = Counter(r.doc_id for r in stay.collect())
    assert kept == Counter({i: 1 for i in (1, 3, 4, 5, 6, 8, 9, 11)} | {None: 2})
    assert near_duplicates.duplicate_classes(none).collect() == [] and near_duplicates.drop_near_duplicates(none).collect() == []


def test_texts_that_share_an_id_stay(spark):
    rows = [(1, " ".join(f"a{i}" for i in range(40))), (1, " ".join(f"b{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40))),
            (2, " ".join(f"c{i}" for i in range(40))), (2, None), (2, ""), (3, " ".join(f"a{i}" for i in range(40)))]
    stay = near_duplicates.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, (r.text or "")[:1]) for r in stay) == Counter([(1, "a"), (1, "b"), (2, "c"), (2, "")])


# Line deduplication

def test_blocks():
    assert line_dedup.common_blocks([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1, 2), (3, 4, 1)]
    assert line_dedup.common_blocks([1, 2, 1, 3], [1, 2, 1, 3]) == [(0, 0, 4)]
    assert line_dedup.common_blocks([], [1]) == [] and line_dedup.common_blocks([5, 5], [5]) == [(0, 0, 1)]
    assert line_dedup.common_blocks([1, 2, 3], [3, 1, 2]) == [(0, 1, 2)]


def plain_dedup(rows, words=10):
    """Every document against every earlier one that shares a line by the pairing rule."""
    cut = [((r.doc_id, 0), [x.strip(" ") for x in r.text.split("\n")]) for r in rows if r.text is not None and r.doc_id is not None]
    cut = sorted({k: v for k, v in cut}.items())
    holders: dict = {}
    for k, lines in cut:
        for x in {x for x in lines if x}:
            holders.setdefault(x, []).append(k)
    pairs = set()
    for x, keys in holders.items():
        for j, late in enumerate(keys):
            for early in (keys[:j] if len(keys) <= line_dedup.RARE else keys[:1]):
                if early != late:
                    pairs.add((early, late))
    table, gone = dict(cut), {}
    for early, late in pairs:
        for _, j, n in line_dedup.common_blocks(table[early], table[late]):
            if sum(len(x.split()) for x in table[late][j:j + n]) >= words:
                gone.setdefault(late[0], set()).update(range(j, j + n))
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in {r.doc_id: r.text for r in rows if r.text is not None and r.doc_id is not None}.items()}


@tables
def test_line_dedup(docs, odd, none):
    found = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert {i: r.text for i, r in found.items()} == plain_dedup(docs.collect())
    assert sum(r.n_deleted for r in found.values()) > 0
    assert all(r.n_lines - r.n_deleted == (len(r.text.split("\n")) if r.text or r.n_deleted < r.n_lines else 0) for r in found.values())
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: (r.text, r.n_lines, r.n_deleted) for r in rows if r.doc_id is not None}
    assert by_id[2] == ("", 1, 1) and by_id[3] == (None, 0, 0) and by_id[4] == ("", 1, 0) and by_id[12] == ("a\nb\na\nb\nc", 6, 1)
    assert line_dedup.dedup_lines(none).collect() == []


def gone_by_all(texts, words=10):
    """Every document against every earlier one, whatever they share."""
    cut = sorted((i, [x.strip(" ") for x in t.split("\n")]) for i, t in texts)
    gone = {}
    for n, (late, lines) in enumerate(cut):
        for _, other in cut[:n]:
            for _, j, size in line_dedup.common_blocks(other, lines):
                if sum(len(x.split()) for x in lines[j:j + size]) >= words:
                    gone.setdefault(late, set()).update(range(j, j + size))
    return {i: sorted(g) for i, g in gone.items()}


def test_frequent_lines_are_aligned_with_every_earlier_document(spark):
    draw = random.Random(8)
    long_lines = [" ".join(f"{c}{k}" for k in range(11)) for c in "pqr"]
    swapped = [(1, f"{long_lines[1]}\n{long_lines[0]}")] + [(i, f"own {i}\n{long_lines[0]}\n{long_lines[1]}") for i in range(2, 30)]
    common = long_lines[:2] + [" ".join(f"{c}{k}" for k in range(4)) for c in "stuv"] + ["", "one"]
    mixed = []
    for i in range(300):
        lines = []
        for _ in range(draw.randint(1, 8)):
            kind = draw.random()
            lines.append(draw.choice(common) if kind < 0.65 else f"few {draw.randint(0, 80)} of these" if kind < 0.8 else f"only here {draw.random()}")
        mixed.append((i, "\n".join(lines)))
    for texts in (swapped, mixed):
        df = spark.createDataFrame(texts, "doc_id long, text string")
        for rare in (8, 2):
            found = {r.doc: r.gone for r in line_dedup.deleted_lines(df, rare=rare).collect()}
            assert found == gone_by_all(texts)


# Nearest neighbours

@tables
def test_nearest(spark):
    vectors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding")
    odd_rows = [(10_001, None), (10_002, []), (10_100, [0.0] * 64), (None, [1.0] * 64), (10_200, [float("nan")] * 64), (10_201, [None] * 64),
                (10_300, [1.0, 2.0]), (10_301, [1.0, 2.0]), (10_302, [2.0, 2.0])]
    both = vectors.unionByName(spark.createDataFrame(odd_rows, vectors.schema))
    both = both.unionByName(vectors.where("vec_id < 40").selectExpr("vec_id + 20000 AS vec_id", "embedding")).selectExpr("*", "1 AS id", "2 AS block")
    found = nearest.nearest(both, both.where("vec_id % 100 = 0")).collect()
    usable = {r.vec_id: np.array(r.embedding, float) for r in both.collect()
              if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)}
    right = total = 0
    for q in [i for i in usable if i % 100 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        exact = sorted((float(np.sqrt(((v - usable[q]) ** 2).sum())), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))[:10]
        assert [r for r, _, _ in mine] == list(range(1, len(exact) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(s == float(np.sqrt(((usable[i] - usable[q]) ** 2).sum())) for _, i, s in mine)
        right, total = right + len({i for _, i, _ in mine} & {i for _, i in exact}), total + len(exact)
    assert right / total >= 0.95
    assert {r.query_id for r in found} == {i for i in usable if i % 100 == 0}
    assert nearest.nearest(both.limit(0), both).collect() == []


# Sharding

@tables
def test_shards(docs, odd, none):
    for df in (docs, odd):
        rows = sharding.assign(df).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
            (r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        for shard in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
        assert {r.law for r in rows} == {"bytes"} and all(0 <= r.shard < 8 and r.grown_shard is None for r in rows)
    assert sharding.assign(none).collect() == []


def test_shards_are_even_with_a_hot_group(spark, tmp_path):
    rows = [(i, "the same text again " * 5 if i % 3 == 0 else f"text number {i} " * (i % 11)) for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sharding.assign(df).toPandas()
    sums = found.groupby("shard")["size"].sum()
    assert sums.max() / sums.mean() < 1.01 and sums.min() / sums.mean() > 0.99
    sharding.write_shards(df, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
