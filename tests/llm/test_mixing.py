import math

import pytest

from tests.llm.helpers import ODD, SCHEMA, WORD, rows, table
from wirespark.llm import mixing
from wirespark.llm.queries import op1_pareto_mix


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        unit = left / sum(w[s] for s in open_)
        above = [s for s in open_ if unit * w[s] > most * sizes[s]]
        if not above:
            return out | {s: unit * w[s] for s in open_}
        for s in above:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(got, docs, slack=None):
    sizes, largest = {}, {}
    for d in docs:
        n = len(WORD.findall(d["text"] or ""))
        sizes[d["source"]] = sizes.get(d["source"], 0) + n
        largest[d["source"]] = max(largest.get(d["source"], 0), n)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    assert len(got) == len(docs)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_query_meets_targets_and_reruns_agree(spark, data):
    out = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))
    check(rows(out), table(data))
    key = lambda x: sorted((r["doc_id"], r["taken"]) for r in rows(x))
    assert key(op1_pareto_mix(spark, data)) == key(op1_pareto_mix(spark, data))


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    check(rows(mixing.mix(docs)), rows(docs))
    assert rows(mixing.mix(docs.limit(0))) == []


def test_weights_change_inclusion(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'one two three' as text", "'s' as source", "if(id % 2 = 0, 3.0, 1.0) as w")
    got = rows(mixing.mix(docs, share=0.4, weight_col="w"))
    heavy, light = (sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1))
    assert heavy + light == pytest.approx(0.4 * 12000, abs=3)
    assert 2.4 < heavy / light < 3.7


def test_rows_are_the_front_of_the_pareto_order(spark):
    """Which rows are taken, against the method done one by one: expected copies by size, certain copies, then random odds over inclusion odds."""
    from pyspark.sql import functions as F

    from wirespark.llm.common import row_hash

    docs = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(1 + id * id % 997 as int)) as text", "concat('s', id % 2) as source")
    got = {r["doc_id"]: r for r in rows(mixing.mix(docs, share=0.7))}
    u = {r["doc_id"]: ((r["h"] % (1 << 64) >> 11) + 0.5) / 2**53 for r in rows(docs.select("doc_id", row_hash("doc_id", "text", F.lit(20)).alias("h")))}
    for s in (0, 1):
        own = [d for d in got if d % 2 == s]
        size, target = {d: got[d]["size"] for d in own}, got[s]["target"]
        weight = {d: 2 ** (round(math.log2(size[d] ** 0.25) * 8) / 8) for d in own}
        low, high = 0.0, 1e6
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(size[d] * min(2, c * weight[d]) for d in own) < target else (low, c)
        rate = {d: min(2, low * weight[d]) for d in own}
        assert len({round(rate[d], 6) for d in own}) > 10  # inclusion odds differ within a source
        lack = target - sum(size[d] * int(rate[d] + 1e-9) for d in own)
        p = {d: rate[d] - int(rate[d] + 1e-9) for d in own}
        order = sorted((u[d] / (1 - u[d])) * (1 - p[d]) / p[d] for d in own if p[d] > 1e-9)
        q = {d: (u[d] / (1 - u[d])) * (1 - p[d]) / p[d] for d in own if p[d] > 1e-9}
        front, taken = set(), 0
        for d in sorted(q, key=q.get):
            if abs(taken + size[d] - lack) >= abs(taken - lack):
                break
            front.add(d)
            taken += size[d]
        assert len(order) > 100
        assert [got[d]["taken"] for d in own] == [size[d] * (int(rate[d] + 1e-9) + (d in front)) for d in own]
