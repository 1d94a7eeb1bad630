import hashlib
import random

import numpy as np
import pytest

from tests.llm.helpers import ODD, SCHEMA, rows, table
from wirespark.llm import repeats
from wirespark.llm.queries import op5_run_length_repeats


def brute(docs, length=50):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each document."""
    first, raw = {}, [(d["text"] or "").encode() for d in docs]
    ids = [repeats.NULL_ID if d["doc_id"] is None else d["doc_id"] for d in docs]
    for i, b in zip(ids, raw, strict=True):
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in zip(ids, raw, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k + 1 : k + 1 + length] = True
        spans = int((np.diff(gone.astype(np.int8)) == 1).sum())
        rest = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out.append((len(b), len(b) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


def digest(r):
    n = sum(s["stop"] - s["start"] for s in r["spans"])
    return r["n_bytes"], n, len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()


def test_query_matches_brute_force(spark, data):
    docs = table(data)
    want = dict(zip((d["doc_id"] for d in docs), brute(docs), strict=True))
    got = rows(op5_run_length_repeats(spark, data))
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert sum(w[1] > 0 for w in want.values()) > 20


@pytest.mark.parametrize("chunk,limits", [(900, {}), (1 << 20, {}), (900, {"bucket_bytes": 500, "fan": 2, "hot": 1, "batch_bytes": 200}), (4000, {"bucket_bytes": 900, "fan": 3, "hot": 20})])
def test_edits_repeats_and_small_chunks(spark, chunk, limits):
    """Also with several hops for each row, and with strips of nearly all keys split."""
    rng = random.Random(chunk)
    base, docs = ["".join(rng.choice("ab cde\0é") for _ in range(400)) for _ in range(4)], []
    for i in range(60):
        t = rng.choice(base)
        a = rng.randrange(len(t))
        t = rng.choice([t, t[:a] + "X" + t[a:], t[a:] + t[:a], "q" * rng.randrange(120), t[:a], t[a : a + 49], t[a : a + 50]])
        docs.append({"doc_id": i // 2 if i % 7 == 0 else i, "text": t})
    rng.shuffle(docs)
    df = spark.createDataFrame([(d["doc_id"], d["text"], 1) for d in docs], "doc_id long, text string, part int").repartition(3)
    assert sorted((r["doc_id"], *digest(r)) for r in rows(repeats.remove_repeats(df, chunk, **limits))) == sorted((d["doc_id"], *w) for d, w in zip(docs, brute(docs), strict=True))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 2) for r in ODD] + [(20, ODD[6][1][:5000], "en", "s", 1, 2)], SCHEMA + ", spans int")
    want = brute(rows(docs))
    assert sorted(digest(r) for r in rows(repeats.remove_repeats(docs))) == sorted(want)
    assert rows(repeats.remove_repeats(docs.limit(0))) == []


def test_index_against_plain_suffixes():
    rng = random.Random(3)
    strings = list({bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 40))) for _ in range(60)} | {b"ab" * 70, b"ab" * 69 + b"b", b"a"})
    index = repeats.RunLengthIndex(strings)
    key = lambda p: ([1 + c for c in index.text[p : p + index.left[p]].tolist()], index.string_of[p])
    assert index.order.tolist() == sorted(range(len(index.text)), key=lambda p: (key(p)[0], key(p)[1]))
    assert len(index.run_heads) < len(index.text)

    def common(p, q):
        a, b = (index.text[x : x + index.left[x]].tolist() for x in (p, q))
        return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    order = index.order.tolist()
    want = np.zeros(len(order), int)
    for p, q in zip(order, order[1:], strict=False):
        want[q] = common(p, q)
    assert index.matches().tolist() == want.tolist()
