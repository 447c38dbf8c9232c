"""The operators against brute force, on the small table and on a table of odd rows."""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from runstore.llm import bytebpe, common, dac, langid, media, mixing, pii, quality, queries, sharding, simhash, tokencount

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, Shard int, n_words string, base string, fp string, kept int"
TEXTS = [
    None, "", " \t\n", "a", "word " * 30, "The quick brown fox jumps over the lazy dog " * 60, "x" * 30000, "<|endoftext|>two<|endoftext|>",
    "mail a@b.co, a@b@c.d.e and x.y@z-1.example.com.!", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255", "card 4111 1111 1111 1111 and 4111111111111112 0000-0000-0000",
    "tel +1 (377) 555-0271 +12 +123456789012345678 +49 30 901820", "line\nline\n\nline\nother\n \n", "é ü ß 日本語 🎉    x", "a b c d e f g h a b c d e f g h i", "9" * 5000,
    "a@" * 3000, "1." * 4000, "+1" * 2000, "mixed\x0bws\x0cand\rcr \x1c \x85", "Ä" * 10, "!!! ### $$$",
]


def odd_rows():
    rows = [(i, t, ["en", "de", None][i % 3], ["b", "a", None, ""][i % 4]) for i, t in enumerate(TEXTS)]
    rows += rows[:6] + [(None, "null id " * 8, "en", "a"), (None, "null id " * 8, None, None), (None, None, None, None)]
    rows += [(100 + i, f"hot text {' '.join('w' + str(j) for j in range(40))}", "en", "hot") for i in range(60)]
    return [(*r, None, "clash", 7, "clash", "clash", "clash", 5) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def same(found, expected):
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def moved(spark, run):
    """What run() gives, and the rows and bytes that it shuffles if no join is a broadcast by its size."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        of = lambda: [(s.stageId(), s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None))]
        last = max([s[0] for s in of()], default=-1)
        out = run()
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        new = [s for s in of() if s[0] > last]
        return out, sum(s[1] for s in new), sum(s[2] for s in new)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parted(spark):
    rows = spark.createDataFrame([(i % 50 or None, f"t{i}", i) for i in range(1000)], "_row long, t string, _words long")
    keys = rows.where("_words % 97 = 0").select("t", "_row")
    for most, few in ((common.MOST_BITS, 100), (64, 1000)):
        may, rest = common.parted(rows, keys, ["_row", "t"], most)
        may, rest = may.collect(), rest.collect()
        same(may + rest, rows.collect())
        assert {r for r in range(0, 1000, 97)} <= {r._words for r in may} and len(may) < few


# -- 1 ---------------------------------------------------------------------------------------------------


def test_targets(spark):
    cases = [{"=a": 100, "=b": 100, "": 100}, {"=a": 1000, "=b": 10, "=c": 10}, {"=z": 0}, {}, {"=\U0001f389": 50, "=\uffff": 7, "=": 9, "=A": 1, "": 4000, "=zz": 0}]
    rng = np.random.default_rng(0)
    cases += [{f"=s{i:03d}": int(10 ** rng.uniform(0, 6)) for i in range(40)} for _ in range(3)]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "_s string, source_size long")
        got = {r._s: r.target for r in mixing.goals(df).collect()}
        expect = brute.targets({k[1:] if k else None: v for k, v in sizes.items()})
        assert set(got) == set(sizes) and all(abs(got[k] - expect[k[1:] if k else None]) < 1e-6 for k in sizes)


def test_plan_is_the_nearest_sum():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 7)))
        counts = rng.integers(1, 5, len(lengths))
        sums, size = {0}, int((lengths * counts).sum())
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        for budget in (int(rng.integers(0, size + 1)), size - 1, max(0, size - int(rng.integers(0, 40)))):
            best = max(s for s in sums if s <= budget)
            take = mixing.plan(lengths, counts, budget)
            assert (take <= counts).all() and (take >= 0).all() and int((lengths * take).sum()) == best
            few = mixing.few_sums(lengths.tolist(), counts.tolist(), budget)
            assert int((lengths * few).sum()) == best


def test_plan_near_the_full_size():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(1, 20000, 900))
    counts = np.ones(len(lengths), np.int64)
    reach = 1
    for length in lengths.tolist():
        reach |= reach << length & (1 << 6001) - 1
    for spare in (0, 1, 20, 200, 2000, 4321):
        least = next(s for s in range(spare, 6001) if reach >> s & 1)  # the least that can be left out
        assert int(lengths.sum()) - int((lengths * mixing.plan(lengths, counts, int(lengths.sum()) - spare)).sum()) == least


def test_plan_meets_budget():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 20000, 3000))
    counts = rng.integers(1, 50, len(lengths))
    size = int((lengths * counts).sum())
    for share in (0.01, 0.3, 0.77, 0.999):
        take = mixing.plan(lengths, counts, int(size * share))
        assert (take <= counts).all() and (take >= 0).all()
        assert int((lengths * take).sum()) == int(size * share)


def test_plan_of_a_few_long_documents():
    assert mixing.plan(np.arange(300_001, 300_005), np.ones(4, np.int64), 620_000).tolist() == [0, 0, 1, 1]
    rng = np.random.default_rng(5)
    for _ in range(100):
        lengths = np.unique(rng.integers(150_000, 2_000_000, 6))
        counts = rng.integers(1, 4, len(lengths))
        budget = int((lengths * counts).sum() * rng.random())
        take = mixing.plan(lengths, counts, budget)
        sums = {0}
        for length, n in zip(lengths.tolist(), counts.tolist()):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        assert int((lengths * take).sum()) == max(s for s in sums if s <= budget)


def test_plan_uses_every_length():
    # only the odd length can meet an odd rest
    lengths = np.sort(np.append(np.arange(1000, 5000, 2), 1407))
    counts = np.ones(len(lengths), np.int64)
    for budget in (20_001, 40_001, 120_001, 200_001, 3_000_001):
        assert int((lengths * mixing.plan(lengths, counts, budget)).sum()) == budget


def test_plan_takes_the_same_share_of_unique_lengths():
    rng = np.random.default_rng(9)
    lengths = np.unique(rng.lognormal(7, 1, 20_000).astype(np.int64) + 1)
    counts = np.ones(len(lengths), np.int64)
    for share in (0.3, 0.6, 0.95):
        take = mixing.plan(lengths, counts, int(share * lengths.sum()))
        tenths = [t.mean() for t in np.array_split(take, 10)]
        assert max(abs(t - share) for t in tenths) < 0.06, tenths
        assert abs(take[-50:].mean() - share) < 0.25


def check_mix(rows, sizes):
    assert len(rows) == len(sizes)
    by = {}
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and (r.size or not r.copies)
        by.setdefault(r.source, []).append(r)
    goal = brute.targets({s: sum(r.size for r in rs) for s, rs in by.items()})
    for s, rs in by.items():
        total = sum(r.size for r in rs)
        assert {r.source_size for r in rs} == {total}
        assert all(abs(r.target - goal[s]) < 1e-6 for r in rs)
        copies = [r.copies for r in rs if r.size]
        assert not copies or max(copies) - min(copies) <= 1
        whole = min(3, int(goal[s]) // total) if total else 0
        reach = 1  # the nearest sum by listing all
        for r in rs:
            reach |= reach << r.size
        budget = int(goal[s]) - whole * total if whole < 3 else 0
        best = max(i for i in range(budget + 1) if reach >> i & 1) if budget < total else total
        assert sum(r.taken for r in rs) == whole * total + best
    same([r.size for r in rows], sizes)


def test_mix(spark, docs, odd, empty, texts):
    rows = mixing.mix(docs).collect()
    check_mix(rows, [len(brute.words(t)) for t in texts.values()])
    again = mixing.mix(docs.repartition(5), keep_text=False).collect()
    same([(r.doc_id, r.taken) for r in rows], [(r.doc_id, r.taken) for r in again])
    same([(r.doc_id, r.taken) for r in rows], [(r.doc_id, r.taken) for r in queries.op1_mixing(spark, SF).collect()])
    check_mix(mixing.mix(odd).collect(), [len(brute.words(r[1])) for r in odd_rows()])
    out = mixing.mix(empty)
    assert out.collect() == [] and {"n_chars", "text", "taken"} <= set(out.columns)


def test_mix_splits_repeated_rows(spark):
    rows = [(1, "one row again and again", "a")] * 500 + [(i, f"words that say {i} not much", "a") for i in range(2, 300)] + [(5, "b " * 40, "b")] * 7
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df.repartition(6)).collect()
    check_mix(got, [len(brute.words(r[1])) for r in rows])
    again = mixing.mix(df.coalesce(2)).collect()
    same([(r.doc_id, r.taken) for r in got], [(r.doc_id, r.taken) for r in again])


# -- 2 ---------------------------------------------------------------------------------------------------


def test_language(spark, odd, empty):
    rows = queries.op2_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97
    model = langid.train(odd)
    out = langid.predict(odd, model).collect()
    assert len(out) == len(odd_rows())
    und = {r.doc_id for r in out if r.lang_pred == "und"}
    assert {0, 1, 2, 15, 17} <= und and 3 not in und
    assert langid.predict(empty, langid.train(empty)).collect() == []
    assert {(r.lang_pred, r.score) for r in langid.predict(odd, langid.train(empty)).collect()} == {("und", 0.0)}


def test_language_features(monkeypatch):
    rng = np.random.default_rng(15)
    cases = ["a", "Ein Text, noch einer", "x1y 日本 ÀÉ ", "12 a!", "".join(rng.choice(list("ab ç.日Ω"), 999))]
    whole = [langid.features(t) for t in cases]
    for t, v in zip(cases, whole):
        assert np.allclose(v, brute.letter_grams(t), atol=1e-6)
    for chunk in (1, 2, 3, 7, 64):  # pieces change nothing
        monkeypatch.setattr(langid, "CHUNK", chunk)
        assert all((langid.features(t) == v).all() for t, v in zip(cases, whole))
    assert langid.features("12 !") is None and langid.features(None) is None


def test_language_of_a_long_text(spark):
    model = langid.train(spark.createDataFrame([(1, "the words are here " * 9, "en"), (2, "die Wörter sind hier " * 9, "de")], "doc_id long, text string, lang string"))
    long = spark.createDataFrame([(1, "the words " * 100_000), (2, "sind Wörter " * 100_000)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(long, model).orderBy("doc_id").collect()] == ["en", "de"]


def test_language_decides_by_family_and_votes():
    rng = np.random.default_rng(16)
    centres = rng.random((5, langid.DIMS)).astype(np.float32)
    centres[1:3] += 2 * centres[0]  # three of one family
    x = np.concatenate([c + rng.random((30, langid.DIMS)).astype(np.float32) / 2 for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = langid.Model(x, [n for n in "abcde" for _ in range(30)])
    assert sorted(map(len, model.families))[-1] >= 2
    for v, name in zip(x, np.repeat(list("abcde"), 30)):
        group = model.families[int(np.argmax([w @ v for w in model.top]))]
        votes = {k: sum((model.pairs[min(k, o), max(k, o)] @ v >= 0) == (k < o) for o in group if o != k) for k in group}
        got, score = model.predict(v)
        assert votes[model.names.index(got)] == max(votes.values()) and 0 <= score <= 1 and got == name


# -- 3 ---------------------------------------------------------------------------------------------------


def check_components(rows, texts):
    fps = [(d, brute.fingerprint(t)) for d, t in texts]
    same([(r.doc_id, r.fingerprint, r.component_id) for r in rows], [(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute.linked(fps))])


def test_simhash(docs, odd, empty, texts):
    check_components(simhash.near_duplicates(docs).collect(), list(texts.items()))
    check_components(simhash.near_duplicates(odd).collect(), [r[:2] for r in odd_rows()])
    assert simhash.near_duplicates(empty).collect() == []


def near_fingerprints(seed, groups, most=6, of=12):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, groups, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(i) for i in rng.choice(64, rng.integers(0, most + 1), replace=False))) for b in base for _ in range(of)]
    return np.unique(np.array(near, np.uint64))


def test_bk_tree_loses_no_link():
    fps = near_fingerprints(3, 60)
    assert simhash.BkTree(fps).nodes > 20
    assert simhash.connected(fps).tolist() == brute.linked([(i, int(f)) for i, f in enumerate(fps)])


def test_bk_tree_is_built_and_prunes(texts):
    fps = np.unique(np.array([simhash.fingerprint(t) for t in texts.values()], np.uint64))
    tree = simhash.BkTree(fps)
    assert tree.nodes > 5
    met = [(q[0], m) for i in range(len(fps)) for q, m in tree.meet(np.array([i]), 4)]
    assert {(i, i) for i in range(len(fps))} <= {(q, int(x)) for q, m in met for x in m}
    assert sum(len(m) for _, m in met) < 0.9 * len(fps) ** 2  # edges beyond the radius aren't followed


def test_trees_have_thousands_of_members(spark):
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(int(x),) for x in np.unique(rng.integers(-(1 << 62), 1 << 62, 20_000))], "fp long")
    sizes = [r["count"] for r in simhash.dealt(df).groupBy("m", "key").count().collect()]
    assert np.mean(sizes) > 1000 and max(sizes) <= simhash.MOST


@pytest.mark.parametrize("members, most", [(2048, 16_384), (16, 128)])
def test_shards_lose_no_link(spark, members, most):
    fps = near_fingerprints(4, 120)
    # half of them agree on their lower bits, so that their shards are dealt again
    fps = np.unique(np.concatenate([fps, (fps & ~np.uint64(0xFFFFF)) | np.uint64(0x6789A)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    if most < 1000:
        assert max(r["count"] for r in simhash.dealt(df, 4, members, most).groupBy("m", "key").count().collect()) <= most
    roots = {r.a: r.root for r in simhash.components(simhash.links(df, 4, members, most)).collect()}
    signed = fps.view(np.int64)
    expect = brute.linked([(int(s), int(f)) for s, f in zip(signed, fps)])
    assert [roots.get(int(s), int(s)) for s in signed] == expect


def test_shard_masks_cover_all_pairs():
    rng = np.random.default_rng(4)
    for bits, count in ((0, 1), (1, 5), (12, 5), (13, 15), (20, 15), (21, 35), (27, 35)):
        ms = simhash.masks(4, bits)
        assert len(ms) == count and all(m.bit_count() == bits for m in ms)
        for _ in range(300):
            diff = sum(1 << int(i) for i in rng.choice(64, 4, replace=False))
            assert any(diff & m == 0 for m in ms)
    free = 0xFFFF0000FFFF0000
    assert all(m & ~free == 0 for m in simhash.masks(4, 6, free))


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (200, 100), (7, 300)]
    got = {r.a: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 300: 0, 101: 100, 102: 100, 200: 100}


def test_components_of_a_star(spark):
    edges = [(0, i) for i in range(1, 400)] + [(399, 5000), (5000, 6000)]
    got = {r.a: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1, 400), 5000, 6000]}


def test_lots_and_shards_beyond_their_size(spark):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    for _ in range(60):  # near copies of near copies, so that not all are like the first
        w = texts[rng.integers(0, len(texts))].split()
        w[rng.integers(0, len(w))] = f"x{rng.integers(0, 1000)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice([f"v{i}" for i in range(3000)], 50)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [simhash.shingle_set(t) for t in texts]
    first = simhash.similar_groups(sets)
    for lot, most in ((1024, 16_384), (7, 16_384), (7, 5)):
        got = {}
        for r in simhash.near_groups(df, lot=lot, most=most).collect():
            got.setdefault(r.root, set()).add(r.doc_id)
        expect = {}
        for i, f in enumerate(first):
            expect.setdefault(int(f), set()).add(i)
        same(got.values(), expect.values())
    assert len(expect) < 100


def test_keep_one(spark, odd):
    out = simhash.keep_one(odd)
    assert out.columns == odd.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert len(kept) == len(set(kept)) and sum((t or "").startswith("hot text") for _, t in kept) == 1
    rows = [r[:2] for r in odd_rows()]
    named = {c for c in brute.linked([(d, brute.fingerprint(t)) for d, t in rows]) if c is not None}
    assert {d for d, _ in kept if d is not None} == named
    # an id used for two texts: only the copy goes
    other = " ".join(f"other{i}" for i in range(50))
    df = spark.createDataFrame([(1, "same text here " * 9), (2, "same text here " * 9), (2, other)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text == other) for r in simhash.keep_one(df).collect()) == [(1, False), (2, True)]


def test_keep_one_drops_edited_copies(spark):
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(5000)]
    texts, similar = [], 0
    for n in (60, 100, 200, 400):
        for _ in range(25):
            a = rng.choice(vocab, n).tolist()
            b = list(a)
            for at in rng.choice(n, max(1, n // 60), replace=False):
                b[at] = "edited"
            x, y = (set(zip(*[w[i:] for i in range(5)])) for w in (a, b))
            similar += len(x & y) >= 0.8 * len(x | y)
            texts += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert similar >= 90 and len(texts) - len(kept) == similar and all(i in kept for i in range(0, len(texts), 2))


def test_keep_one_moves_only_texts_that_may_go(spark):
    rng = np.random.default_rng(3)
    texts = [rng.bytes(15_000).hex(" ", 4) for _ in range(200)]  # some 6 MB
    df = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    ids, _, size = moved(spark, lambda: sorted(r.doc_id for r in simhash.keep_one(df).collect()))
    assert (ids, size) == (list(range(200)), min(size, 1_500_000))


def test_keep_one_leaves_one_of_a_group(spark):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join(words[:i] + ["edited"] + words[i + 1 :]) for i in (50, 100, 150)]
    schema = "doc_id long, text string"
    assert simhash.keep_one(spark.createDataFrame([(None, t) for t in near], schema)).count() == 1
    rows = simhash.keep_one(spark.createDataFrame([(3, near[0]), (3, near[1]), (4, near[2]), (None, near[2])], schema)).collect()
    assert [r.doc_id for r in rows] == [3]


def test_similar_groups_against_all_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 12, 9).astype(np.uint64)) for _ in range(120)]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert simhash.similar_groups(sets).tolist() == label and len(set(label)) < 110


# -- 4 ---------------------------------------------------------------------------------------------------


def check_files(rows, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, expect = 0, []
    for d, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, brute.spark_hash(r[1] or ""))):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        expect.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same([tuple(r) for r in rows], expect)


def test_token_files(spark, docs, odd, empty, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_files(queries.op4_token_files(spark, SF).collect(), list(texts.items()))
    check_files(dac.token_files(odd, path).collect(), [r[:2] for r in odd_rows()])
    assert dac.token_files(empty, path).collect() == []
    names = dac.token_files(odd.select(F.concat(F.lit("n"), "doc_id").alias("name"), "text"), path, "name", keep_ids=True).collect()
    assert {r.doc_id for r in names} == {None if r[0] is None else f"n{r[0]}" for r in odd_rows()} and all(len(r.ids) == r.n_tokens for r in names)
    # many rows of one id, or of none, aren't one task's work
    hot = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)], "doc_id long, text string")
    check_files(dac.token_files(hot, path).collect(), [(None if i % 2 else 7, f"text {i}") for i in range(400)])


def test_symbols_spelled_by_bytes(texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), dac.library(path)
    assert own.token_to_id(" the") == library.token_to_id("Ġthe") and own.pre_tokenizer.__class__.__name__ == "Split"
    rng = np.random.default_rng(10)
    plain = list("abst'lremvd1.,_<0xC3>|E \n\t\r\x0b\x1c\x1f\0") + [" "] * 4 + ["'"] * 3
    wide = [*plain, "\x7f", "\x80", "\x85", "\xa0", "\xad", "　", "é", "ÿ", "Ġ", "Ċ", "²", "日", "本", "的", "П", "р", "ﷺ", "🙂", "\u0301", "\ufeff", "\U0010ffff", "<|endoftext|>", "<0xC3>", "<0xE2>"]
    cases = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for alphabet in (plain, wide) for _ in range(4000)]
    cases += [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [t or "" for t in texts.values()] + ["日" * 5000, " " * 5000, "é" * 300, "a" * 300]
    for ids, plainly in zip(dac.encode_texts(path, cases), library.encode_batch(cases, add_special_tokens=False), strict=True):
        assert ids.tolist() == plainly.ids
    # files of other kinds are used as they are
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for n, change in enumerate(({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "NFC"}}, {"model": spec["model"] | {"ignore_merges": True}})):
        other = tmp_path / f"{n}.json"
        other.write_text(json.dumps(spec | change), encoding="utf-8")
        library = Tokenizer.from_file(str(other))
        assert dac.spelled(spec | change) is None
        assert [x.tolist() for x in dac.encode_texts(str(other), cases[:500])] == [e.ids for e in library.encode_batch(cases[:500], add_special_tokens=False)]


@pytest.mark.parametrize("top", [1, 200, 256, 70_000, 1 << 32])
def test_direct_access(top):
    rng = np.random.default_rng(5)
    ids = (rng.random(5000) ** 4 * top).astype("<u4")
    ends = np.array([0, 10, 10, 700, 5000])
    f = dac.DacFile(dac.encode_ids(ids, ends))
    assert [f[i] for i in range(0, 5000, 7)] == ids[::7].tolist()
    for lo, hi in ((0, 5000), (511, 513), (4999, 5000), (17, 17), (100, 3001)):
        assert (f.run(lo, hi) == ids[lo:hi]).all()
    assert [d.tolist() for d in f.documents()] == [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]


# -- 5 ---------------------------------------------------------------------------------------------------


def check_pii(rows, docs):
    expect = []
    for d, t in docs:
        kinds = [s[3] for s in brute.base_spans(t)]
        expect.append((d, *[kinds.count(k) for k in brute.PII], brute.base_digest(t)))
    same([(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows], expect)


def check_spans(rows, docs):
    same([(r.doc_id, r.spans) for r in rows], brute.all_spans(docs))


def test_added_spans(spark):
    rng = np.random.default_rng(17)
    common = [f"plain{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(400):
        words = rng.choice(common, 12).tolist()
        who = int(rng.integers(0, 25))
        if i % 4 == 0:  # an entity, and mostly a name of its own, in any place
            words.insert(int(rng.integers(0, 12)), f"user{who}@mail.example.org" if who % 2 else f"+49 30 55{who:02d}12345")
            if rng.random() < 0.8:
                words.insert(int(rng.integers(0, 12)), f"Name{'abcdefghijklmnopqrstuvwxyz'[who]}son")
        elif rng.random() < 0.02:
            words.append(f"Name{'abcdefghijklmnopqrstuvwxyz'[who]}son")
        rows.append((i, " ".join(words)))
    rows += rows[:40]  # repeated rows count each
    found = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_spans(found, rows)
    kinds = {s.split(":")[0] for r in found for s in r.spans.split(",") if s}
    assert {"removed", "generalised", "email", "phone"} <= kinds


def test_personal_data(spark, docs, odd, empty, texts):
    rows = pii.personal_data(docs).collect()
    check_pii(rows, list(texts.items()))
    for r in rows:
        base = [f"{k}:{s}:{e}" for s, _, e, k in brute.base_spans(texts[r.doc_id])]
        assert [s for s in r.spans.split(",") if s and s.split(":")[0] in brute.PII] == base
        assert base or not r.spans  # clean documents stay clean
    check_spans(rows, list(texts.items()))
    same([(r.doc_id, r.spans) for r in queries.op5_pii(spark, SF).collect()], [(r.doc_id, r.spans) for r in rows])
    found = pii.personal_data(odd).collect()
    check_pii(found, [r[:2] for r in odd_rows()])
    check_spans(found, [r[:2] for r in odd_rows()])
    assert pii.personal_data(empty).collect() == []


def test_revealing_terms(spark):
    noise = [(i, f"common words everywhere number {i} and nothing else") for i in range(200)]
    rows = noise + [(1000 + i, f"common Zyxwv wrote from who.{i % 2}@host.example.com words everywhere {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert all(out[i] == "" for i in range(200))
    assert out[1000].startswith("generalised:7:12,")
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Zyxwv" not in clean[1000] and "@" not in clean[1000] and clean[1000].startswith("common ") and "[EMAIL]" in clean[1000]
    assert all(clean[i] == t for i, t in noise)


def test_revealing_terms_at_every_place(spark):
    gap = "plain words that say nothing about anyone at all " * 3
    noise = [(i, f"{gap} number {i}") for i in range(200)]
    rows = noise + [(1000 + i, f"Zyxwv wrote from who@host.example.com {gap} yours ZYXWV {gap}Zyxwv") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = rows[-1][1]
    at = [m.start() for m in re.finditer("zyxwv", text.lower())]
    spans = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert len(at) == 3 and all(f"removed:{a}:{a + 5}" in spans[1000].split(",") for a in at)
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "zyxwv" not in clean[1000].lower() and all(clean[i] == t for i, t in noise)


def test_revealing_terms_far_from_the_span(spark):
    gap = "plain words that say nothing about anyone at all " * 3
    noise = [(i, f"{gap} number {i}") for i in range(200)]
    rows = noise + [(1000 + i, f"Zyxwv {gap} who@host.example.com {i}" if i % 2 else f"who@host.example.com {gap} {i} Zyxwv") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.scan(df)
    (row,) = [r for r in pii.disclosures(df, found).collect() if r.term == "zyxwv"]
    assert row.entity == "email:who@host.example.com" and abs(row.share - 1) < 1e-9 and row.action == "removed"
    assert all("Zyxwv" not in r.text for r in pii.sanitised(df).collect())


def test_terms_are_counted_where_they_stand(spark):
    words = " ".join("w" + "".join(chr(97 + i // 10 ** k % 10) for k in range(2)) + "x" for i in range(100))
    rows = [(i, words) for i in range(400)] + [(1000 + i, f"Zyxwv wrote from who@host.example.com {words}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = pii.scan(df)
    terms, n, _ = moved(spark, lambda: {r.term: r.action for r in pii.disclosures(df, found).collect()})
    assert terms == {"zyxwv": "removed", "wrote": "removed", "from": "removed"}
    assert n < 400 * 100 / 5


def test_sanitised_keeps_rows(odd):
    out = pii.sanitised(odd)
    assert out.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect() if not brute.base_spans(r.text))
    assert len(got) == len(odd_rows())  # nothing that is left is personal data


# -- 6 and 8 ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tiktok():
    import tiktoken

    ranks = bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(rows, docs, tiktok):
    expect = []
    for d, t in docs:
        ids = np.array(tiktok.encode_ordinary(t or ""), "<u4")
        expect.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows], expect)


def test_byte_bpe(docs, odd, empty, texts, tiktok):
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = bytebpe.encode_decode(docs, *args).collect()
    check_bpe(rows, list(texts.items()), tiktok)
    assert all(r.decoded == texts[r.doc_id] and len(r.ids) == r.n_tokens for r in rows)
    check_bpe(bytebpe.encode_decode(odd, *args).collect(), [r[:2] for r in odd_rows()], tiktok)
    assert bytebpe.encode_decode(empty, *args).collect() == []


def test_transducer_on_random_bytes(tiktok):
    ranks = bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = np.random.default_rng(6)
    for most in (50, 2000, 200_000):  # few states: the table starts afresh in the middle of a match
        machine = bytebpe.Transducer(ranks, max_states=most)
        for n in (1, 2, 3, 10, 100, 9000):
            for alphabet in (2, 4, 26):
                data = bytes(rng.integers(97, 97 + alphabet, n).astype(np.uint8))
                assert machine.encode(data) == tiktok._encode_single_piece(data)
                assert len(machine.states) <= most


def test_ids_leave_after_a_bounded_look_ahead(tiktok):
    ranks = bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    machine, longest = bytebpe.Transducer(ranks), max(map(len, ranks))
    rng = np.random.default_rng(10)
    for data in (b"internationalisation", b"antidisestablishmentarianism", bytes(rng.integers(97, 123, 3000).astype(np.uint8))):
        fed = 0

        def probe():
            nonlocal fed
            for byte in data:
                fed += 1
                yield byte

        ids, ends, early = [], 0, 0
        for token in machine.stream(probe()):
            ids.append(token)
            ends += len(machine.bytes_of[token])
            early += fed < len(data)
            assert fed <= ends + longest  # no later than the longest token after its end
        assert ids == tiktok._encode_single_piece(data) and early > 0


def test_utf8_machine():
    text = "a é 日 🎉 ß" * 5
    data = text.encode()
    for step in (1, 2, 3, 5):
        m, out = bytebpe.Utf8Machine(), []
        for i in range(0, len(data), step):
            out.append(m.feed(data[i : i + step]).decode())  # pieces are whole characters
        m.finish()
        assert "".join(out) == text
    for bad in (b"\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\xe2\x28"):
        with pytest.raises(UnicodeDecodeError):
            m = bytebpe.Utf8Machine()
            m.feed(bad)
            m.finish()


def test_token_counts(docs, odd, empty, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for df, rows in ((docs, list(texts.items())), (odd, [r[:2] for r in odd_rows()])):
        got = tokencount.token_counts(df, path).collect()
        n = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
        same([(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got], [(*x, x[2] > 1024) for x in n])
    assert tokencount.token_counts(empty, path).collect() == []


# -- 7 ---------------------------------------------------------------------------------------------------


def check_quality(rows, docs):
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows], [(d, *brute.quality(t)) for d, t in docs])
    assert not any(r.kept and r.base_failed for r in rows)


def test_quality(spark, docs, odd, empty, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    check_quality(quality.judged(docs, labels).collect(), list(texts.items()))
    check_quality(quality.judged(odd, labels).collect(), [r[:2] for r in odd_rows()])
    check_quality(quality.judged(odd, labels.limit(0)).collect(), [r[:2] for r in odd_rows()])
    assert quality.judged(empty, labels).collect() == []


def test_verdicts(spark):
    rng = np.random.default_rng(18)
    vocab = [f"w{i}" for i in range(4000)]
    rows, labels = [], []
    for i in range(5000):
        bad, lang = rng.random() < 0.25, ["en", "de", None][int(rng.choice(3, p=[0.6, 0.35, 0.05]))]
        words = rng.choice(vocab, int(rng.integers(15, 160))).tolist()
        if bad and lang == "en":
            words = [w + "##!" * (rng.random() < 0.9) for w in words]
        elif bad:
            words = [w.upper() for w in words]
        if rng.random() < 0.02:
            words = [w.upper() + "?!" for w in words]
        if rng.random() < (0.4 if bad else 0.02):
            words += ["\n" + "again and again the same line" + "\n"] * int(rng.integers(1, 4))
        rows.append((i, " ".join(words), lang))
        labels.append((i, None if rng.random() < 0.02 else int(not bad)))
    labels += [(None, 0), (7, 1), (7, 0), (10**9, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.kept for r in quality.judged(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    expect = brute.kept(rows, labels, quality.GRIDS, quality.ALPHA, quality.DELTA, quality.COST)
    assert out == expect
    base = sum(not brute.quality(t)[-1] for _, t, _ in rows)
    assert sum(out.values()) < base - 500  # the method itself rejects


def test_windows_are_compared_by_words(spark):
    words = [f"q{i}" for i in range(30)]
    rows = [(1, " ".join(words + words[3:14] + ["z"] * 3)), (2, " ".join(words)), (3, " ".join(["a"] * 40)), (4, " ".join(words * 40))]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    check_quality(quality.judged(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")), labels).collect(), rows)


def test_accepted_keeps_columns(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.accepted(odd, labels)
    assert out.columns == odd.columns and quality.accepted(empty, labels).collect() == []
    judged = [r.doc_id for r in quality.judged(odd, labels).collect() if r.kept]
    same([r.doc_id for r in out.collect()], judged)
    assert {(r.n_words, r.base, r.kept) for r in out.collect()} == {("clash", "clash", 5)}


def test_binomial_tail(spark):
    from math import comb

    cases = [(n, k, p) for n in (1, 10, 200) for k in (0, 1, 7) for p in (0.01, 0.3) if k <= n]
    df = spark.createDataFrame([(float(n), k) for n, k, _ in cases], "n double, k long")
    for rate in (0.01, 0.3):
        for r in df.withColumn("t", quality.tail(F.col("n"), F.col("k"), rate)).collect():
            n = int(r.n)
            assert abs(r.t - sum(comb(n, j) * rate**j * (1 - rate) ** (n - j) for j in range(r.k + 1))) < 1e-9


def test_risk_control(spark):
    good = [(i, " ".join(f"w{(i * 31 + j * j) % 997}" for j in range(60)), 1) for i in range(3000)]
    bad = [(10000 + i, " ".join(f"w{(i * 17 + j * j) % 997}###" for j in range(60)), 0) for i in range(300)]
    rows = [(i, t, "en", q) for i, t, q in good + bad]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = {r.doc_id: r.kept for r in quality.judged(df.drop("quality"), df.select("doc_id", "quality")).collect()}
    assert not any(out[i] for i, _, _ in bad) and all(out[i] for i, _, _ in good)
    few = df.where("doc_id < 20 or doc_id > 10280")  # too little evidence for any cutoff
    assert all(r.kept for r in quality.judged(few.drop("quality"), few.select("doc_id", "quality")).collect())
    kept = quality.accepted(df.drop("quality"), df.select("doc_id", "quality"))
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == len(good)


# -- 9 ---------------------------------------------------------------------------------------------------


def check_shards(rows, docs, slack):
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs])
    total = [0] * 8
    for s in range(8):
        own = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        total[s] = sum(r.size for r in own)
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert max(total) - min(total) <= slack


def test_sharding(docs, odd, empty, texts):
    heaviest = max(len((t or "").encode()) for t in texts.values())
    check_shards(sharding.shard_documents(docs).collect(), list(texts.items()), 2 * heaviest)
    check_shards(sharding.shard_documents(odd).collect(), [r[:2] for r in odd_rows()], 70000)
    assert sharding.shard_documents(empty).collect() == []


def test_sharding_splits_hot_groups(spark):
    rows = [(i, "the same text in a third of all rows") for i in range(3000)] + [(5000 + i, f"text {i}" + "x" * (i % 40)) for i in range(6000)] + [(1, "repeated row")] * 2000
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, tolerance=0.002).collect()
    check_shards(got, rows, 0.01 * sum(r.size for r in got) / 8 + 100)


# -- 10 --------------------------------------------------------------------------------------------------


def check_media(rows, docs):
    expect = []
    for d, t in docs:
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        expect.append((d, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    same([(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows], expect)


def test_media(spark, docs, odd, empty, texts):
    rows = media.media_columns(docs).collect()
    check_media(rows, list(texts.items()))
    for r in rows[:60]:
        payload = media.padded(texts[r.doc_id].encode())
        assert media.from_wav(bytes(r.media)) == payload and len(r.media) == r.media_bytes
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256
        assert brute.peak_pairs(payload) == (r.fp_time, r.fp_code)
    by = {}
    for r in media.media_columns(odd).collect():
        by.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256, tuple(r.fp_time), tuple(r.fp_code)))
    assert all(len(v) == 1 for v in by.values())
    check_media(media.media_columns(odd).collect(), [r[:2] for r in odd_rows()])
    out = media.media_columns(empty)
    assert out.collect() == [] and {"lang", "n_chars", "media", "fp_code"} <= set(out.columns)
    query = queries.op10_media(spark, SF).collect()
    same([(r.doc_id, r.feature, r.fp_time, r.fp_code) for r in query], [(r.doc_id, r.feature, r.fp_time, r.fp_code) for r in rows])
    for r in query:
        data = np.array(r.fp_time, "<i4").tobytes() + np.array(r.fp_code, "<i4").tobytes()
        assert r.feature == f"{len(r.fp_code)}:{hashlib.sha256(data).hexdigest()[:32]}"


def test_spectrum_is_the_transform():
    rng = np.random.default_rng(13)
    frames = rng.integers(0, 256, (4, 256)).astype(np.uint8)
    k, n = np.meshgrid(np.arange(129), np.arange(256), indexing="ij")
    x = frames.astype(float) - frames.mean(axis=1, keepdims=True)
    direct = np.abs((x * np.hanning(257)[:256]) @ np.exp(-2j * np.pi * k * n / 256).T)
    assert np.allclose(media.spectrum(frames), direct, rtol=1e-3, atol=1e-2)


def test_fingerprints_of_a_tone():
    t = np.arange(8000 * 4)
    tone = (128 + 60 * np.sin(2 * np.pi * 1000 * t / 8000) + 30 * np.sin(2 * np.pi * 500 * t / 8000)).astype(np.uint8)
    _, when, bins = media.peaks([tone])
    assert len(when) and (bins == 32).sum() + (bins == 16).sum() > 0.3 * len(bins)
    assert len(media.fingerprints([np.full(640, 128, np.uint8)])[0][0]) == 0


def test_peaks_do_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(8)
    signals = [rng.integers(0, 256, 64 * n).astype(np.uint8) for n in (1, 3, 1400, 2, 70, 1)]
    whole = media.fingerprints(signals)
    monkeypatch.setattr(media, "BLOCK", 37)
    for (a, b), (c, d), own in zip(whole, media.fingerprints(signals), signals):
        assert a.tolist() == c.tolist() and b.tolist() == d.tolist()
        assert (a.tolist(), b.tolist()) == brute.peak_pairs(own.tobytes())


def test_splitter_is_the_pattern():
    import regex

    from runstore.llm.common import BYTE_LEVEL, Splitter

    assert BYTE_LEVEL == public_tokenizers.PATTERN
    pattern, split = regex.compile(BYTE_LEVEL), Splitter()
    rng = np.random.default_rng(9)
    plain = list("abst'lremvd1.,_ \n\t\r\x0b\x1c\x1f\0") + [" "] * 4 + ["'"] * 3
    for alphabet in (plain, [*plain, "\x85", "\xa0", "　", "é", "²", "日", "́"]):
        for _ in range(4000):
            text = "".join(rng.choice(alphabet, rng.integers(0, 25)))
            assert split(text) == pattern.findall(text), repr(text)
