"""The pipeline's stages on the small table and on odd rows."""

from __future__ import annotations

import hashlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from runstore.llm import bytebpe, mixing, simhash

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TEXT = " ".join(f"word{i} more" for i in range(30))
ODD = [
    (None, None, None, None, None), (1, "", "en", "a", 0), (2, TEXT, "en", "a", len(TEXT)), (3, TEXT, None, "b", len(TEXT)), (3, TEXT, None, "b", len(TEXT)),
    (4, f"{TEXT} someone@mail.example.com", "de", None, None), (None, f"null id {TEXT[:200]}", "en", "a", 3), (5, " ".join(f"long{i}" for i in range(200_000)), "en", "a", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    clash = ["kept", "_h", "base", "spans", "size", "Taken", "root", "fp", "_doc", "_key"]
    df = spark.createDataFrame(ODD, COLUMNS)
    return df.withColumns({c: F.lit("clash") for c in clash})


def test_stages_keep_columns_and_rows(spark, odd):
    """Each filtering or rewriting stage on odd rows: nulls, empty and very long texts, repeated rows, clashing names."""
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns, name
        rows[name] = [r.asDict() for r in out.collect()]
        assert all(r["_h"] == r["base"] == r["Taken"] == "clash" for r in rows[name])
        assert stage(spark, odd.limit(0), SF).collect() == []
    words = lambda r: len(brute.words(r["text"]))
    assert sorted(map(words, rows["quality rules"])) == sorted(len(brute.words(t)) for _, t, *_ in ODD if not brute.quality(t)[-1])
    near = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows["simhash near-dedup"])
    assert near == [(False, 1), (False, 2), (False, 5), (True, 0)]  # the two without words are one group, and so are those of TEXT
    assert len(rows["personal data"]) == len(ODD) and not any("@" in (r["text"] or "") for r in rows["personal data"])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows["personal data"])
    taken = Counter((r["source"], r["doc_id"]) for r in rows["mixing sources"])
    assert all(n <= 6 for n in taken.values()) and not any(words(r) == 0 for r in rows["mixing sources"])
    last = corpus_pipeline.STAGES[-1][1](spark, odd, SF).collect()
    assert len(last) == len(ODD) and all(r.decoded_sha256 for r in last)


def test_pipeline_against_its_stages(spark):
    """The whole run against a plain-Python run of what each stage decides."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    from runstore.llm import quality

    good = brute.kept([d[:3] for d in docs], labels, quality.GRIDS, quality.ALPHA, quality.DELTA, quality.COST)
    docs = sorted((d for d in docs if good[d[0]]), key=lambda d: d[0])
    sets = [simhash.shingle_set(t) for _, t, *_ in docs]
    first = simhash.similar_groups(sets)
    docs = [d for i, d in enumerate(docs) if first[i] == i]
    spans = dict(brute.all_spans([d[:2] for d in docs]))
    label = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "generalised": "[TERM]"}
    clean = []
    for d, text, lang, source in docs:
        out, at = [], 0
        for kind, lo, hi in (s.split(":") for s in spans[d].split(",") if s):
            if int(lo) >= at:
                out += [text[at : int(lo)], label[kind]]
            at = max(at, int(hi))
        clean.append((d, "".join(out) + text[at:], lang, source))
    rows = corpus_pipeline.run(spark, SF).collect()
    by = {d: (text, source) for d, text, _, source in clean}
    assert {r.doc_id for r in rows} <= set(by)
    machine = bytebpe.Codec(bytebpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    sizes, taken = Counter(), Counter()
    for text, source in by.values():
        sizes[source] += len(brute.words(text))
    for r in rows:
        text, source = by[r.doc_id]
        taken[source] += len(brute.words(text))
        assert r.source == source and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert np.array_equal(r.ids, machine.encode(text).astype(np.int64))
    for s, goal in brute.targets(sizes).items():
        whole = min(mixing.MAX_REPEATS, int(goal) // sizes[s])
        budget, reach = int(goal) - whole * sizes[s], 1
        for text, source in by.values():
            reach |= reach << len(brute.words(text)) * (source == s)
        best = max(i for i in range(budget + 1) if reach >> i & 1) if whole < mixing.MAX_REPEATS else 0
        assert taken[s] == whole * sizes[s] + best  # the nearest sum there is
    assert max(Counter(r.doc_id for r in rows).values()) <= mixing.MAX_REPEATS
