import pytest

from tests.llm.helpers import ODD, SCHEMA, base_measures, rows, table
from wirespark.llm import quality
from wirespark.llm.queries import op6_rule_cascade


def test_query_matches_brute_force(spark, data):
    got = {r["doc_id"]: r for r in rows(op6_rule_cascade(spark, data))}
    docs = table(data)
    assert len(got) == len(docs)
    for d in docs:
        want, r = base_measures(d["text"]), got[d["doc_id"]]
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_verdicts_follow_labels(spark, data):
    kept = {r["doc_id"]: r["kept"] for r in rows(op6_rule_cascade(spark, data))}
    labels = table(data, "labels")
    good = [kept[x["doc_id"]] for x in labels if x["quality"] == 1]
    bad = [kept[x["doc_id"]] for x in labels if x["quality"] == 0]
    assert sum(bad) <= 0.02 * len(bad)
    assert sum(good) >= 0.9 * len(good)  # the rest has under 50 words


def test_odd_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, 1) for r in ODD], SCHEMA + ", n_words int").withColumnRenamed("lang", "kept")
    got = rows(quality.judge(docs, measures=quality.BASE))
    assert len(got) == len(ODD)
    for r in got:
        assert {k: r[k] for k in base_measures(r["text"])} == base_measures(r["text"])
    assert rows(quality.judge(docs.limit(0), measures=quality.BASE)) == []
    clean = (30, " ".join(f"word{i}" for i in range(60)), "en", "s", 1, 1)  # the other rows are short or repeat themselves
    docs = docs.union(spark.createDataFrame([clean], docs.schema)).withColumn("_kept", quality.F.lit(1))
    assert quality.kept(docs).columns == docs.columns and [r["doc_id"] for r in rows(quality.kept(docs))] == [30]


@pytest.mark.parametrize("order", [1, -1])
def test_order_changes_cost_only(order):
    import pyarrow as pa

    texts = pa.array([r[1] or "" for r in ODD], pa.large_string())
    one = quality.passes(quality.Texts(texts), quality.RULES)
    assert (quality.passes(quality.Texts(texts), quality.RULES[::order]) == one).all()


def test_order_by_rejections_per_cost_of_what_is_left():
    import time

    import pyarrow as pa

    def rule(name, rejects, seconds):
        def run(t):
            time.sleep(seconds)
            return rejects(t.n_words)

        return quality.Rule(name, run)

    texts = quality.Texts(pa.array(["w " * n for n in range(1, 101)], pa.large_string()))
    texts.rows().n_words  # so that all three cost what they sleep
    # b rejects most, but after a little more than a; c rejects what neither does
    rules = rule("b", lambda n: n <= 60, 0.05), rule("c", lambda n: n > 80, 0.02), rule("a", lambda n: n <= 50, 0.005)
    found = quality.steps(texts, rules)
    assert [(name, rejected, left) for _, name, _, rejected, left in found] == [("a", 50, 100), ("c", 20, 50), ("b", 10, 30)]
    assert [r.name for r in quality.ordered(rules, found)] == ["a", "c", "b"]


def test_cascade_asks_only_what_is_left(monkeypatch):
    import numpy as np
    import pyarrow as pa

    asked = []
    compute = quality.MEASURES["n_symbols"]
    monkeypatch.setitem(quality.MEASURES, "n_symbols", (lambda t, rows: asked.append(rows.tolist()) or compute[0](t, rows), compute[1]))
    texts = quality.Texts(pa.array(["a", "b " * 60, "c # " * 60, ""], pa.large_string()))
    assert quality.passes(texts, (quality.RULES[0], quality.RULES[2])).tolist() == [False, True, False, False]
    assert asked == [[1, 2]]
    assert texts.measure("n_symbols", np.arange(4)).tolist() == [0, 0, 60, 0] and asked == [[1, 2], [0, 3]]
