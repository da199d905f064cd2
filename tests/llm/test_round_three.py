"""Hard negatives, repair of conversations and best-fit packing against plain versions."""

import itertools
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sieveline.llm import best_fit, conversations, hard_negatives
from sieveline.llm.byte_ids import ByteIds
from sieveline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


# Hard negatives

def plain_negatives(rows, every=100, k=5):
    usable = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
              if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(256 * x) for x in v)]
    found = Counter()
    for a in {(i, lab, tuple(v)) for i, lab, v in usable if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a[2], v)), i, lab) for i, lab, v in usable if i != a[0] and len(v) == len(a[2]))
        for minus, positive, _ in [s for s in scored if s[2] == a[1]][:k]:
            p = -minus
            good = [s for s in scored if s[2] != a[1] and 80 * p <= -100 * s[0] <= 100 * p][:k]
            found.update((a[0], positive, n, s[1], p, -s[0]) for n, s in enumerate(good, 1))
    return found


def negatives(df, **more):
    return Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in hard_negatives.mine(df, **more).collect())


VECTORS = "vec_id long, embedding array<double>, label int, ask long, id long, v string, size int, region int, floor double, found long, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "v", 3, 4, 5.0, 6, 7.0) for r in rows], VECTORS)


def test_hard_negatives(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0.3 * (j == i % 3), 1) for j in range(6)], i % 3) for i in range(400)]
    same = [draw.gauss(0, 1) for _ in range(6)]
    rows += [(1000 + i, same, i % 2) for i in range(150)]  # many equal vectors, so many ties
    expected = plain_negatives(rows, 20)
    assert len(expected) > 100 and negatives(vectors(spark, rows), every=20) == expected
    # Several regions and blocks, small leaves, and several groups of queries.
    for name, value in (("BLOCK", 40), ("LEAF", 4), ("FANOUT", 3), ("CHUNK", 7)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert negatives(vectors(spark, rows), every=20) == expected
    monkeypatch.setattr(hard_negatives, "REGION_NUMBERS", 30)  # so few that regions are not told apart
    assert negatives(vectors(spark, rows), every=20) == expected


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [2.0, 1.0], 2), (1, [1.0, 1.5], 1), (2, [1.0, 1.9], 2), (2, [1.0, 1.9], 2), (3, None, 1), (4, [1.0, None], 1),
            (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (7, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 3), (200, [], 1), (201, [], 1),
            (202, [], 2), (8, [1e308, 1.0], 1), (9, [-0.001, 0.0], 1), (10, [-3.0, -1.0], 2)]
    found = negatives(vectors(spark, rows))
    assert found == plain_negatives(rows) and sum(found.values()) >= 4
    assert negatives(vectors(spark, [])) == Counter()
    assert negatives(vectors(spark, [(0, [1.0], 1)])) == Counter()


def test_bounds_of_boxes_hold():
    draw = np.random.default_rng(1)
    for n in (1, 5, 300, 2000):
        tree = hard_negatives.Tree(np.arange(n), draw.integers(0, 4, n), draw.normal(size=(n, 5)))
        assert sorted(tree.ids.tolist()) == list(range(n))
        low, high, first, last = tree.leaves
        for leaf in range(len(low)):
            inside = tree.vectors[leaf * hard_negatives.LEAF:(leaf + 1) * hard_negatives.LEAF]
            assert (inside >= low[leaf]).all() and (inside <= high[leaf]).all()
            labels = tree.labels[leaf * hard_negatives.LEAF:(leaf + 1) * hard_negatives.LEAF]
            assert first[leaf] == labels.min() and last[leaf] == labels.max()


# Conversations

def plain_report(rows, convs):
    """Every cheapest repair by search over all strings of edits of a state, without checkpoints or segments."""
    import hashlib
    from functools import lru_cache

    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    found = {}
    white = " \t\n\x0b\x0c\r"
    for conv in convs:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(white)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        want = {"": "user", "s": "user", "u": "assistant", "a": "user"}

        @lru_cache(None)
        def best(i, state, inserts, own=own, faults=faults, step=step, want=want):
            options = []
            if i == len(own):
                if state in ("", "a"):
                    options.append((0, "", ()))
            else:
                _, role, text = own[i]
                more = 3 if faults[i] == "truncated" else 0
                c, e, t = best(i + 1, state, 0)
                options.append((c + 4, "D" + e, t))
                if faults[i] not in ("blank", "duplicate"):
                    if role[:1] in step[state]:
                        c, e, t = best(i + 1, step[state][role[:1]], 0)
                        options.append((c + more, "K" + e, (f"{role}:{text}", *t)))
                    c, e, t = best(i + 1, want[state][0], 0)
                    options.append((c + more + 3, "R" + e, (f"{want[state]}:{text}", *t)))
            if inserts < 3:
                c, e, t = best(i, want[state][0], inserts + 1)
                options.append((c + 3, "I" + e, (want[state] + ":", *t)))
            return min(options) if options else (10 ** 6, "~", ())

        cost, audit, lines = best(0, "", 0)
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
                       hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


TURNS = "conv_id long, turn long, role string, text string, pos long, segment int, fault string, edit string, cost long, run long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "f", "e", 3, 4) for r in rows], TURNS)


def reported(df, rows=None):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in conversations.report(df, df if rows is None else rows).collect()}


def random_turns(draw, convs, most):
    rows = []
    for conv in convs:
        for turn in range(draw.randint(0, most)):
            turn = draw.choice([turn, turn, turn, turn + 2, None])
            rows.append((conv, turn, draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "u"]), draw.choice(["Yes.", "No!", "cut", "", " \n", None, "q?", "end. \t"])))
    return rows


def test_conversations(spark, monkeypatch):
    draw = random.Random(5)
    rows = random_turns(draw, [None, *range(60)], 9) + random_turns(draw, [99], 60)
    convs = {r[0] for r in rows}
    expected = plain_report(rows, convs)
    assert reported(turns(spark, rows)) == expected
    monkeypatch.setattr(conversations, "SEGMENT_BITS", 2)  # conversations over many segments
    monkeypatch.setattr(conversations, "isqrt", lambda n: min(2, n))
    assert reported(turns(spark, rows)) == expected


def test_odd_conversations(spark):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    some = turns(spark, [(1, 0, "user", "a" * 200_000 + "."), (2, None, None, None)])
    assert reported(some, some.where("false")) == {1: (0, 0, 0, 0, 0, 0, "", empty), 2: (0, 0, 0, 0, 0, 0, "", empty)}
    assert reported(some) == plain_report([(1, 0, "user", "a" * 200_000 + "."), (2, None, None, None)], [1, 2])
    assert reported(turns(spark, [])) == {}
    equal = [(1, 1, "user", "same.")] * 30  # repeated rows
    assert reported(turns(spark, equal)) == plain_report(equal, [1])


def test_walks_do_not_depend_on_cuts():
    draw = random.Random(2)
    for _ in range(200):
        codes = [(draw.randrange(4), draw.randrange(3)) for _ in range(draw.randint(1, 40))]
        whole, _ = conversations.walk(codes, conversations.END, 0, True)
        at = draw.randint(0, len(codes))
        behind = conversations.END
        for code in reversed(codes[at:]):
            behind = conversations.before(*code, behind)
        one, state = conversations.walk(codes[:at], behind, 0, False) if at else ([], 0)
        two, _ = conversations.walk(codes[at:], conversations.END, state, True) if at < len(codes) else ([], 0)
        if at < len(codes):
            assert [e[1:] for e in whole] == [e[1:] for e in one + two]
        columns = conversations.matrix(codes)
        ahead = conversations.END
        for code in reversed(codes):
            ahead = conversations.before(*code, ahead)
        assert ahead == tuple(min(columns[4 * to + s] + conversations.END[to] for to in range(4)) for s in range(4))


def test_damage(spark):
    rows = [(c, t, "assistant", "So. It is! Is it?") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    found = Counter(tuple(r) for r in conversations.damage(turns(spark, rows)).collect())
    expected = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        expected[c, t, role, text] += 0 if kind == 0 else 2 if kind == 3 else 1
    assert found == +expected


# Packing

def fewest(lengths, capacity):
    """The fewest sequences, by trying."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in range(len(rooms)):
            if rooms[r] >= lengths[i] and rooms[r] not in rooms[:r]:
                put(i + 1, [*rooms[:r], rooms[r] - lengths[i], *rooms[r + 1:]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best


def test_bounds_of_packings():
    draw = random.Random(4)
    for capacity in (1, 2, 7, 20, 100):
        for _ in range(60):
            lengths = [draw.randint(1, capacity) for _ in range(draw.randint(0, 9))]
            least = best_fit.bound(np.array(lengths, int), capacity)
            chosen, offsets, left = best_fit.best_fit(sorted(lengths, reverse=True), capacity)
            assert least <= fewest(lengths, capacity) <= len(left)
            assert all(0 <= r < capacity for r in left) and len(chosen) == len(offsets) == len(lengths)


def test_exchange(spark):
    draw = random.Random(6)
    lengths = [draw.choice([700, 900, 1000, 1100, 1300, draw.randint(1, 2048), 2048]) for _ in range(3000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long")
    places = {r["key"]: r for r in best_fit.pack(pieces, part=200).collect()}
    assert sorted(places) == list(range(3000))
    rows = defaultdict(list)
    for k, r in places.items():
        rows[r.sequence_id].append((r.offset, lengths[k]))
    for held in rows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    # 15 partitions by themselves take about 1750, all pieces together the bound.
    least = best_fit.bound(np.array(lengths), 2048)
    alone = len({r.sequence_id for r in best_fit.pack(pieces, part=200, rounds=0).collect()})
    assert least <= len(rows) <= least + 12 < alone


@tables
def test_packed_documents(spark, odd, none):
    encoder = Tokenizer.from_file(BYTES)
    for df in (spark.read.parquet(f"{FOLDER}/documents.parquet"), odd):
        expected = Counter()
        for r in df.collect():
            ids = encoder.encode(r.text or "", add_special_tokens=False).ids + [0]
            first = len(ids) % 2048 or min(len(ids), 2048)
            edges = [0, *range(first, len(ids) + 1, 2048)]
            expected.update((r.doc_id, p, a, np.array(ids[a:b], "<u4").tobytes()) for p, (a, b) in enumerate(itertools.pairwise(edges)))
        packed = best_fit.pack_documents(df, BYTES)
        found = packed.collect()
        assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in found) == expected
        assert all(r.length == len(r.ids) // 4 <= 2048 for r in found)
        held = defaultdict(list)
        for r in found:
            held[r.sequence_id].append((r.offset, bytes(r.ids)))
        made = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in best_fit.sequences(packed).collect()}
        assert made == {s: (sum(len(i) for _, i in p) // 4, b"".join(i for _, i in sorted(p))) for s, p in held.items()}
        lengths = [r.length for r in found]
        assert best_fit.bound(np.array(lengths), 2048) <= len(held) <= len(best_fit.best_fit(sorted(lengths, reverse=True), 2048)[2])
    assert best_fit.pack_documents(none, BYTES).collect() == []


def test_byte_ids_are_those_of_the_library():
    draw = random.Random(3)
    kinds = ["aAbé É's   t re.,!?\t\n\r\xa0\x85\x1c\x0b12²½<|>_-ßµªñº́日🙂　 ", "ab  '\nsltvedm1 ."]
    words = ["<|endoftext|>", " <|endoftext|>", "'s", "'ll", " 're", "  ", "   ", " \n", "\n "]
    texts = ["".join(draw.choice(kinds[i % 2]) if draw.random() < 0.9 else draw.choice(words) for _ in range(draw.randint(0, 30))) for i in range(6000)]
    texts += [" ".join("".join(draw.choice("abcdéF") for _ in range(draw.randint(1, 9))) + draw.choice(["", "", ".", ",", "!x", "'s"]) for _ in range(40)) for _ in range(200)]
    encoder = Tokenizer.from_file(BYTES)
    for most in (60, 10 ** 6):  # with and without words forgotten on the way
        ids = ByteIds(BYTES, most)
        for at in range(0, len(texts), 300):
            part = texts[at:at + 300]
            assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(pa.array(part))] == [encoder.encode(t, add_special_tokens=False).ids for t in part]
    assert ids.encode(pa.array([None, ""], pa.string())) == [b"", b""] and ids.encode(pa.array([], pa.string())) == []


@tables
def test_new_queries_run(spark):
    for name in ("op11_hard_negatives", "op12_conversations", "op13_best_fit"):
        assert QUERIES[name](spark, FOLDER).count() > 0


# What was mended in earlier operators

def near_copies(n, seed):
    """Copies of one text with some words changed, at all similarities around 0.8."""
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    return texts


def test_classes_of_a_crowded_group(spark, monkeypatch):
    from sieveline.llm import near_duplicates as nd

    texts = near_copies(220, 8) + near_copies(60, 9) + ["something else entirely " + str(i) * 9 for i in range(10)]
    hashes = nd._WordHashes()
    bags = [nd.shingles(t, hashes) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if nd.similarity(bags[a], bags[b]) >= 0.8]
    compared = []
    first = nd._across
    monkeypatch.setattr(nd, "_across", lambda rows, least: compared.append("sketch" in rows.columns) or first(rows, least))
    found = {r.doc_id: r.class_id for r in nd.duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert True in compared  # some buckets are crowded
    together = sum(found[a] == found[b] for a, b in links)
    assert len(links) > 1000 and together / len(links) >= 0.99
    # Classes hold nothing that no chain of links joins.
    root = list(range(len(texts)))

    def end(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[max(end(a), end(b))] = min(end(a), end(b))
    for i, c in found.items():
        assert end(i) == end(c)


def test_sketches_rule_out_only_what_is_below_the_bound():
    from sieveline.llm import near_duplicates as nd

    hashes = nd._WordHashes()
    bags = [nd.shingles(t, hashes) for t in near_copies(120, 4)]
    found = nd.signatures(bags, nd.SKETCH_BITS)
    bits = np.unpackbits(nd.sketches(found, nd.SKETCH_BITS).view(np.uint8), axis=1)
    assert bits.shape == (120, nd.SKETCH_BITS)
    ruled_out = kept_below = 0
    for a, b in itertools.combinations(range(120), 2):
        alike, agree = nd.similarity(bags[a], bags[b]), int((bits[a] == bits[b]).sum())
        assert abs(2 * agree / nd.SKETCH_BITS - 1 - alike) < 0.12
        assert alike < 0.8 or agree >= nd.least_agreement(0.8, nd.SKETCH_BITS)
        ruled_out += agree < nd.least_agreement(0.8, nd.SKETCH_BITS)
        kept_below += alike < 0.72 and agree >= nd.least_agreement(0.8, nd.SKETCH_BITS)
    assert ruled_out > 1000 and kept_below < 20


def test_equal_texts_share_a_shard(spark):
    from sieveline.llm import sharding

    for n in (200, 3000):
        rows = [(i, f"copy {i % 7}" if i % 4 == 0 else f"text number {i} " * (i % 9 + 1)) for i in range(n)]
        df = spark.createDataFrame([*rows, *[(n + i, None) for i in range(n // 20)]], "doc_id long, text string")
        where = defaultdict(set)
        texts = dict(rows)
        for r in sharding.assign(df).collect():
            where[texts.get(r.doc_id)].add(r.shard)
        assert all(len(shards) == 1 for shards in where.values())


CLASHES = ("mix_rate", "mix_copy", "mix_source", "mix_docs", "stay_id", "stay_key", "row", "shard_id", "shard_crc", "text_crc32", "copies")


def test_columns_of_any_names(spark, tmp_path):
    from sieveline.llm import mixing, near_duplicates, sharding

    rows = [(i, f"a text of its own number {i} " * 3 if i % 3 else "one text that is in many rows of this table", "s" + str(i % 2), *[f"{c}{i}" for c in CLASHES]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in df.collect()}
    kept = near_duplicates.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {0, *(i for i in range(40) if i % 3)}
    sharding.write_shards(df, str(tmp_path / "shards"))
    written = spark.read.parquet(str(tmp_path / "shards"))
    assert set(written.columns) == {*df.columns, "shard", "slot"} and {tuple(r) for r in written.select(*df.columns).collect()} == {tuple(r) for r in df.collect()}


def test_marks_alone_are_no_language(spark):
    from sieveline.llm import language_id

    profiles = language_id.learn_profiles(spark.createDataFrame([("en", "the cat sat é"), ("de", "der hund lag")], "lang string, text string"))
    df = spark.createDataFrame([(1, "́̂ 12"), (2, "é"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict_languages(df, profiles).collect()} == {1: "und", 2: "en", 3: "und"}


@tables
def test_taken_words_come_near_their_target(spark):
    """Copies are drawn by themselves, so a source's words differ from its target by a few standard deviations of the draw at most."""
    from sieveline.llm import mixing

    for folder in ("sf0.001", "sf0.01", "sf0.1"):
        sums = defaultdict(lambda: [0.0, 0.0, 0.0])
        for r in mixing.repeats(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")).collect():
            rate = min(r.target / r.source_size, 3.0) if r.source_size else 0.0
            share = rate - int(rate)
            taken, variance, _ = sums[r.source_size, r.target]
            sums[r.source_size, r.target] = [taken + r.size * r.copies, variance + r.size ** 2 * share * (1 - share), r.target]
        for taken, variance, target in sums.values():
            assert abs(taken - target) <= 4 * variance ** 0.5 + 1e-6 * target


def test_queries_of_one_id_are_answered_each(spark):
    from sieveline.llm import nearest

    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(1, 30)] + [(100, [1.0, 0.0, 0.0, 0.0]), (100, [0.0, 5.0, 0.0, 0.0]), (100, [0.0, 5.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(df, df.where("vec_id = 100"), k=40).collect()
    expected = Counter()
    for query in {(i, tuple(v)) for i, v in rows if i == 100}:
        others = sorted((float(np.sqrt(((np.array(v) - query[1]) ** 2).sum())), i) for i, v in rows if (i, tuple(v)) != query)
        expected.update((100, n, i, round(s, 9)) for n, (s, i) in enumerate(others, 1))
    assert Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found) == expected


@tables
def test_token_files_skip_what_cannot_hold_an_id(spark):
    """Stripes, row groups and Bloom filters: a reader of one id gets few of the rows."""
    import glob

    from pyarrow import orc

    from sieveline.llm import token_files
    from sieveline.sources.shared import shared_folder

    df = spark.range(0, 180_000, 3).selectExpr("id AS doc_id", "concat('some words for number ', id, repeat(' and more', CAST(id % 4 AS INT))) AS text")
    folder = shared_folder(spark)
    token_files.write_tokens(df, folder, public_tokenizers.path("word_bpe_49k.json"), stripe_bytes=64 << 10, index_rows=1000)
    files = [orc.ORCFile(f) for f in glob.glob(folder.removeprefix("file:") + "/*.orc")]
    assert sum(f.nrows for f in files) == 60_000 and max(f.nstripes for f in files) > 1 and {f.row_index_stride for f in files} == {1000}
    assert {str(f.compression) for f in files} == {"ZSTD"} and all(f.file_length > 0 for f in files)

    def rows_read(condition):
        found = token_files.read_tokens(spark, folder).where(condition)
        count = found._jdf.queryExecution()
        n = len(count.executedPlan().executeCollectPublic())
        leaf = count.executedPlan().collectLeaves().head()
        return n, leaf.metrics().apply("numOutputRows").value()

    n, read = rows_read("doc_id = 90000")
    assert n == 1 and read <= 2000
    n, read = rows_read("doc_id = 90001")  # within the range of a row group, in none of the filters but by chance
    assert n == 0 and read <= 1000
    n, read = rows_read("doc_id < 0")
    assert n == 0 and read == 0
