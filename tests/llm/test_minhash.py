import math
import random
from collections import Counter

from tests.llm.helpers import ODD, SCHEMA, WORD, components, groups, rows, table
from wirespark.llm import minhash
from wirespark.llm.queries import op10_bottom_k


def shingles(text, n):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(docs, n, percent):
    """{index: component's first index}, from all pairs that share a shingle."""
    sets = [shingles(d["text"], n) for d in docs]
    by_set = groups((s, i) for i, s in enumerate(sets) if s)
    links = [(v[0], i) for v in by_set.values() for i in v[1:]]
    lists, shared = groups((x, v[0]) for s, v in by_set.items() for x in s), Counter()
    for v in lists.values():
        shared.update((a, b) for k, a in enumerate(v) for b in v[k + 1 :])
    links += [(a, b) for (a, b), c in shared.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return components(range(len(docs)), links), sets


def test_query_matches_brute_force(spark, data):
    docs = sorted(table(data), key=lambda d: d["doc_id"])
    first, sets = brute(docs, 3, 85)
    got = {r["doc_id"]: r for r in rows(op10_bottom_k(spark, data))}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        r = got[d["doc_id"]]
        assert r["n_shingles"] == len(sets[i])
        assert r["component_id"] == docs[first[i]]["doc_id"]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def chains(seed=1):
    """Texts each a few words from the last, a shared passage, copies: links that only some partners have."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    passage, out = [rng.choice(words) for _ in range(60)], []
    for _ in range(6):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(25):
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
            out.append(" ".join(text))
    out += [" ".join(passage + [rng.choice(words) for _ in range(rng.randrange(5, 40))]) for _ in range(80)]
    out += out[:10]
    return [{"doc_id": i, "text": t} for i, t in enumerate(out)]


def test_chains_and_passages(spark):
    docs = chains()
    for n, percent in ((5, 80), (3, 85)):
        first, _ = brute(docs, n, percent)
        df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(df, n, percent))} == first
    # lists longer than a block: narrowed, then dealt into blocks that meet two by two
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.near_duplicates(df, 3, 85, block=6))} == first


def test_bitmaps_never_differ_more_than_sets():
    import numpy as np
    import pyarrow as pa
    from wirespark.llm.links import Bitmaps, bitmap

    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 40, 65, 100, 130, 600, 1000, 1500)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, 30).astype(np.uint64)]) for s in sets]
    bits = Bitmaps(pa.array([bitmap(s).view(np.int64).tolist() for s in sets], pa.list_(pa.int64())))
    a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(sets)) for j in range(i)], strict=True))
    apart = np.array([len(set(sets[i].tolist()) ^ set(sets[j].tolist())) for i, j in zip(a, b, strict=True)])
    assert bits.within(a, b, apart).all()
    near = np.maximum(np.array([len(sets[i]) for i in a]), [len(sets[i]) for i in b]) <= 2 * np.minimum([len(sets[i]) for i in a], [len(sets[i]) for i in b])
    assert not bits.within(a, b, apart // 2)[near & (apart > 300)].any()


def test_odd_rows_and_one_of_each(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ODD], SCHEMA + ", node string").withColumnRenamed("lang", "row")
    got = rows(minhash.near_duplicates(docs))
    assert len(got) == len(ODD)
    assert all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in rows(left)) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert rows(minhash.near_duplicates(docs.limit(0))) == [] and rows(minhash.deduplicated(docs.limit(0))) == []


def test_filter_keeps_a_link_with_an_unlucky_sketch(spark):
    low = list(range(32))
    both = [x for x in low if x % 8 in (0, 1, 2)] + list(range(100, 600))  # 12 of the union's 32 least values
    own = [x for x in low if x % 8 > 2]
    sets = [sorted(both + own[::2]), sorted(both + own[1::2])]
    nodes = spark.createDataFrame([(bytes([i]), len(s), s[:32]) for i, s in enumerate(sets)], "node binary, n_shingles long, sketch array<long>")
    full = spark.createDataFrame([(bytes([i]), s) for i, s in enumerate(sets)], "node binary, set array<long>")
    pairs = spark.createDataFrame([(b"\0", b"\1")], "a binary, b binary")
    for percent in (80, 85):
        assert len(rows(minhash._confirmed(pairs, nodes, full, percent, 32))) == 1


def test_filter_tail_is_below_that_of_the_lists():
    tail = lambda p, t: sum(math.comb(32, i) * p**i * (1 - p) ** (32 - i) for i in range(t))
    for p in (0.8, 0.85):
        assert tail(p, minhash.least_overlap(p, 32)) <= minhash.FILTER_TAIL < tail(p, int(32 * minhash.LEAST)) / 100


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark, monkeypatch):
    """However many rows stay or go: with nothing small enough for a broadcast, only rows that go, or are repeated, meet the table that says so."""
    from wirespark.llm import common

    rng = random.Random(2)
    texts = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(300)) for _ in range(300)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t + " tail") for i, t in enumerate(texts[:10])]
    docs += [(0, texts[0])] * 3 + [(None, texts[1]), (None, "of no id"), (None, "of no id")] + [(2000, None), (2000, None), (2001, " "), (2001, " ")]
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 0)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = minhash.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"))
        before = shuffled_bytes(spark)
        got = left.collect()
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    expected = [(i, t) for i, t in enumerate(texts)] + [(None, "of no id"), (2000, None), (2000, None), (2001, " "), (2001, " ")]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))
    assert moved < sum(map(len, texts)) / 5


def test_filter_keeps_every_hash(spark, monkeypatch):
    from wirespark.llm import common

    rng = random.Random(3)
    edges = [x for k in range(64) for x in ((1 << k) - (1 << 63), (1 << k) - 1)] + [-1, 0, -(1 << 63), (1 << 63) - 1]
    own, others = {*edges, *(rng.getrandbits(64) - (1 << 63) for _ in range(2000))}, {rng.getrandbits(64) - (1 << 63) for _ in range(20_000)}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "h long")
    for size in (common.FILTER_ROWS, 2):  # sparse, and so full that most others pass
        monkeypatch.setattr(common, "FILTER_ROWS", size)
        some, sure = ([r["h"] for r in rows(x)] for x in common.filtered(frame(own | others), frame(own), "h"))
        assert own <= set(some) and sorted(some + sure) == sorted(own | others)
        assert size == 2 or len(set(some) - own) < 50
