from collections import Counter

import corpus_pipeline
from tests.llm.helpers import ODD, SCHEMA, base_measures, encode, groups, rows, table
from tests.llm.test_minhash import brute
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_packing import check as check_packing
from wirespark.llm import mixing, quality


def plain_lines(docs, ratio=0.1, least=5):
    pages, on = groups((d["source"], d["doc_id"]) for d in docs), {}
    for d in docs:
        for x in {x for x in (d["text"] or "").split("\n") if x.strip(quality.BLANK)}:
            on[d["source"], x] = on.get((d["source"], x), 0) + 1
    bad = {k for k, n in on.items() if n >= least and n > ratio * len(pages[k[0]])}
    return {d["doc_id"]: None if d["text"] is None else "\n".join(x for x in d["text"].split("\n") if (d["source"], x) not in bad) for d in docs}


def test_stages_match_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, now = docs.columns, {d["doc_id"]: d for d in table(data)}
    one, two, three, four, five = (f for _, f in corpus_pipeline.STAGES)

    docs = one(spark, docs, data)
    assert docs.columns == columns
    kept = {r["doc_id"] for r in rows(docs)}
    labels = {x["doc_id"]: x["quality"] for x in table(data, "labels")}
    for d in now.values():
        m = base_measures(d["text"])
        if m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"] or labels.get(d["doc_id"]) == 0:
            assert d["doc_id"] not in kept
        elif labels.get(d["doc_id"]) == 1:
            assert d["doc_id"] in kept
    now = [now[i] for i in sorted(kept)]

    docs = two(spark, docs, data)
    assert docs.columns == columns
    texts = plain_lines(now)
    got = {r["doc_id"]: r for r in rows(docs)}
    assert {i: r["text"] for i, r in got.items()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    now = [got[i] for i in sorted(got)]

    docs = three(spark, docs, data)
    assert docs.columns == columns
    first, _ = brute(now, 5, 80)
    assert sorted(r["doc_id"] for r in rows(docs)) == [now[i]["doc_id"] for i in sorted(set(first.values()))]
    now = rows(docs)

    mix = {r["doc_id"]: r for r in rows(mixing.mix(docs))}
    check_mix(list(mix.values()), now)
    docs = four(spark, docs, data)
    assert docs.columns == columns
    times = {k: len(v) for k, v in groups((r["doc_id"], 1) for r in rows(docs)).items()}
    assert times == {i: r["copies"] for i, r in mix.items() if r["copies"]}

    last = rows(docs)
    pieces = rows(five(spark, docs, data))
    check_packing(pieces, last, map(len, encode([d["text"] for d in last], 1)))
    again = rows(corpus_pipeline.run(spark, data))
    # cuts depend on how rows are dealt; what lies at each place of each document does not
    places = lambda ps: Counter((p["doc_id"], p["doc_tokens"], p["start"] + k, p["ids"][4 * k : 4 * k + 4]) for p in ps for k in range(p["length"]))
    assert places(again) == places(pieces)


def test_odd_rows(spark):
    """Short, empty, null and repetitive texts go; of equal texts the row of the least id stays, a null id counting as the greatest; sources may be null."""
    clean = lambda k: " ".join(f"word{k}x{j}" for j in range(60))
    more = [(30 + i, f"some words {i} " * 30, "en", None, 9) for i in range(4)]
    good = [(40, clean(0), "en", "s", 1), (41, clean(0), "en", "t", 1), (41, clean(0), "en", "u", 1), (None, clean(1), None, None, None), (43, clean(2), "en", "v", 1), (None, clean(2), "en", "w", 1)]
    docs = spark.createDataFrame([*ODD, *more, *good], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, docs.limit(0), "")) == []
        docs = stage(spark, docs, "")
    pieces, (ids,) = rows(docs), [encode([clean(k) for k in range(3)], 1)]
    want = {40: ids[0], None: ids[1], 43: ids[2]}
    assert {p["doc_id"] for p in pieces} == set(want)
    for p in pieces:
        n = p["start"] + p["length"]
        assert p["doc_tokens"] == len(want[p["doc_id"]]) and bytes(p["ids"]) == b"".join(i.to_bytes(4, "little") for i in want[p["doc_id"]][p["start"] : n])
    whole = Counter((p["doc_id"], p["start"] + k) for p in pieces for k in range(p["length"]))
    assert all(set(whole[d, k] for k in range(len(w))) in ({1}, {2}) for d, w in want.items())
