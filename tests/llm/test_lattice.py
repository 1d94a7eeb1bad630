import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import ODD, SCHEMA, WORD, rows, table
from wirespark.llm import lattice
from wirespark.llm.queries import op4_lattice_score


def lower(s):
    return (s or "").translate({c: c + 32 for c in range(65, 91)})


def base(docs):
    tokens = [[*WORD.findall(lower(d["text"])), None] for d in docs]
    out = [zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 5 == 1 for d in docs]
    counts = Counter(t for ts, o in zip(tokens, out, strict=True) if not o for t in ts)
    n, v = sum(counts.values()), len(counts)
    score = lambda ts: sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
    return [(o, len(ts), sum(counts[t] > 0 for t in ts), n, score(ts)) for ts, o in zip(tokens, out, strict=True)]


def by_segmentations(model, word):
    """The word's probability summed over every segmentation, one by one."""
    text, total = lattice.SPACE + word, 0.0
    which = {p: i for i, p in enumerate(model.pieces)}

    def go(i, logp):
        nonlocal total
        if i == len(text):
            total += math.exp(logp)
            return
        for j in range(i + 1, len(text) + 1):
            if text[i:j] in which:
                go(j, logp + model.scores[which[text[i:j]]])
        if text[i] not in which:
            go(i + 1, logp + len(text[i].encode()) * model.byte)

    go(0, 0.0)
    return math.log(total)


@pytest.fixture(scope="module")
def model():
    pieces = lattice.vocabulary(lattice.default_path())
    w = 1.0 / (np.arange(len(pieces)) + 2)
    return lattice._model(pieces, w, 0.01, 0.1)


def test_forward_equals_all_segmentations(model):
    words = ["the", "a", "tionreading", "é", "naïve", "𝔘ni", "\u0001x", "zz", "thththth", "日本"]
    got = model.words(pa.array(words, pa.large_string()))
    assert got == pytest.approx([by_segmentations(model, w) for w in words], rel=1e-9)


def test_expected_counts_are_the_gradient(model):
    words, counts = pa.array(["reading", "é𝔘", "on"], pa.large_string()), np.array([2.0, 1.0, 3.0])
    total, n_bytes = model.expected(words, counts)
    i = model.pieces.index("on")
    step = lattice.Model(model.pieces, model.scores + 1e-6 * (np.arange(len(model.pieces)) == i), model.byte, model.end)
    slope = (counts * (step.words(words) - model.words(words))).sum() / 1e-6
    assert total[i] == pytest.approx(slope, rel=1e-4)
    assert n_bytes == pytest.approx(4.0)


def test_long_words_stay_finite(model):
    long = "abcdefghij" * 3000
    a, b = model.words(pa.array([long, "ab"], pa.large_string()))
    assert -1e6 < a < -1e4 and b < 0


@pytest.mark.parametrize("most", [lattice.FREQUENT, 300])
def test_query_matches_brute_force(spark, data, most):
    docs = table(data)
    want = dict(zip((d["doc_id"] for d in docs), base(docs), strict=True))
    made = op4_lattice_score(spark, data) if most == lattice.FREQUENT else lattice.scored(spark.read.parquet(f"{data}/documents.parquet"), most=most)
    got = rows(made)
    assert len(got) == len(docs)
    for r in got:
        out, n, known, train, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, train)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)


def test_fitting_helps_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(300)
    held = lambda rounds: sum(r["score"] for r in rows(lattice.scored(docs, rounds=rounds)) if r["held_out"])
    assert held(3) > held(1) > held(0)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 0.0) for r in ODD], SCHEMA + ", score double")
    want = base(rows(docs))
    got = rows(lattice.scored(docs))
    assert sorted((r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == sorted((*w[:4], round(w[4], 4)) for w in want)
    assert rows(lattice.scored(docs.limit(0))) == []
