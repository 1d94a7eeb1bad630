import io
import uuid

import numpy as np
import pytest

from tests.llm.helpers import ODD, SCHEMA, crc, encode, rows, table
from wirespark.llm import wavelet
from wirespark.llm.queries import op3_wavelet_tokens


def test_query_matches_tokenizer(spark, data):
    docs = sorted(table(data), key=lambda d: d["doc_id"])
    ids, start = encode([d["text"] for d in docs], 2), 0
    got = {r["doc_id"]: r for r in rows(op3_wavelet_tokens(spark, data))}
    assert len(got) == len(docs)
    for d, own in zip(docs, ids, strict=True):
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), crc(own))
        start += len(own)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (7, 2), (5000, 49408), (3000, 5)])
def test_access_rank_select(n, top, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 256)
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n).astype(np.uint16)
    w = wavelet.WaveletFile(io.BytesIO(wavelet.build(ids, np.array([5]), np.array([0, n]))))
    assert (w.decode() == ids).all()
    for i in rng.integers(0, n, 60) if n else ():
        t = int(ids[i])
        assert w.access(int(i)) == t
        assert w.rank(t, int(i)) == int((ids[:i] == t).sum())
        assert w.count(t) == int((ids == t).sum())
        assert w.select(t, w.rank(t, int(i))) == i
    assert w.count(70_000) == 0


def test_odd_rows_and_occurrences(spark):
    docs = spark.createDataFrame([(*r, 9) for r in ODD], SCHEMA + ", ids int")
    path = f"file:///tmp/checkpoints/wavelet-{uuid.uuid4().hex}"
    shards = wavelet.write(docs, path)
    got = sorted(rows(wavelet.read(spark, path, shards)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 3, 3, 4, 5, 6, 7, 8, 9]
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    want = encode([r[1] for r in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))], 2)
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == want
    assert sum(r["n"] for r in rows(wavelet.occurrences(spark, path, shards, 2))) == len(ODD) + sum(w[:-1].count(2) for w in want)
    assert rows(wavelet.stored(docs.limit(0))) == []
