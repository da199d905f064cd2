"""Every stage of the pipeline against a plain version on the stage's own input, and the whole run against the stages in turn."""

import hashlib
import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sieveline.llm import near_duplicates, quality
from sieveline.sources.shared import written

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


def plain_score(net, text):
    """The network's answer by a slide over the whole text, window by window."""
    starts = range(0, max(len(text) - quality.WIDTH, 0) + quality.STEP, quality.STEP)
    padded = np.frombuffer(text.ljust(starts[-1] + quality.WIDTH, b"\0"), np.uint8)
    answers = np.array([net.embed[padded[s:s + quality.WIDTH]].ravel() @ net.filters for s in starts])
    firsts = range(0, len(answers) - quality.HOP, quality.HOP) if len(answers) > quality.HOP else [0]
    peaks = np.maximum(np.array([answers[i:i + quality.CHUNK].max(axis=0) for i in firsts]) + net.bias, 0)
    hidden = np.tanh(np.concatenate([peaks.mean(axis=0), peaks.max(axis=0)]) @ net.hidden + net.hidden_bias)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.out + net.out_bias[0], -30, 30)))


def plain_quality(spark, docs):
    net = quality.learn_quality(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r: plain_score(net, (r.text or "").encode()) for r in set(docs.collect())}
    assert all(abs(s - 0.3) > 1e-4 for s in scores.values())  # none hangs on the order of sums
    return Counter(r for r in docs.collect() if scores[r] >= 0.3)


def plain_near_duplicates(spark, docs):
    rows = docs.collect()
    texts = sorted({r.text for r in rows if r.doc_id is not None and r.text})
    hashes = {}
    cut = [Counter(zip(*[w[i:] for i in range(5)])) if len(w := re.findall(r"\w+", t.lower())) >= 5 else Counter([tuple(w)] if w else []) for t in texts]
    root = list(range(len(texts)))

    def end(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if cut[a] and cut[b] and min(cut[a].total(), cut[b].total()) >= 0.8 * max(cut[a].total(), cut[b].total()):
            both = (cut[a] & cut[b]).total()
            if both >= 0.8 * (cut[a].total() + cut[b].total() - both):
                root[max(end(a), end(b))] = min(end(a), end(b))
    members = defaultdict(list)
    for r in rows:
        if r.doc_id is not None and r.text:
            hashes[r.text] = hashlib.md5(r.text.encode()).digest()
            members[end(texts.index(r.text))].append((r.doc_id, hashes[r.text], r))
    kept = Counter(min(m, key=lambda x: x[:2])[2] for m in members.values())
    kept.update({r for r in rows if r.doc_id is not None and not r.text})
    return kept + Counter(r for r in rows if r.doc_id is None)


def plain_decontamination(spark, docs):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))

    grams = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = words(r.text)
        grams.update(tuple(w[k:k + 10]) for k in range(max(len(w) - 9, 1)) if w)
    sizes = {len(g) for g in grams}

    def leaks(text):
        w = words(text)
        return any(tuple(w[k:k + n]) in grams for n in sizes for k in range(len(w) - n + 1))

    return Counter(r for r in docs.collect() if not leaks(r.text))


def plain_mix(spark, docs):
    rows = docs.collect()
    size = {r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in set(rows)}
    own = Counter()
    for r in rows:
        own[r.source] += size[r]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(own, key=lambda s: (s is None, (s or "").encode())))}
    full = set()
    while True:
        left, open_weight = sum(own.values()) - sum(3 * own[s] for s in full), sum(w for s, w in weights.items() if s not in full)
        target = {s: 3 * own[s] if s in full else left * w / open_weight for s, w in weights.items()}
        above = {s for s in weights if target[s] > 3 * own[s]}
        if not above:
            break
        full |= above
    taken = Counter()
    for r in rows:
        rate = target[r.source] / own[r.source] if own[r.source] else 0
        draw = int(hashlib.md5(f"11:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 16 ** 12
        taken[r] += int(rate) + (draw < rate - int(rate))
    return +taken


def plain_tokens(docs):
    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return Counter((r.doc_id, len(ids := encoder.encode(r.text or "", add_special_tokens=False).ids + [2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for r in docs.collect())


PLAIN = {"quality": plain_quality, "near_duplicates": plain_near_duplicates, "decontamination": plain_decontamination, "mixing": plain_mix}


def through_all(spark, docs):
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == columns
        expected = PLAIN[name](spark, docs)
        docs = written(made)
        assert Counter(docs.collect()) == expected, name
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens) == plain_tokens(docs)
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    return tokens


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]


def test_run(spark):
    tokens = through_all(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"))
    assert Counter(corpus_pipeline.run(spark, FOLDER).collect()) == Counter(tokens) and len(tokens) > 20


def test_odd_table(spark, odd):
    through_all(spark, odd)


def test_empty_table(spark, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).collect() == []
