import hashlib
import random

import pytest

from tests.llm.helpers import ODD, SCHEMA, components, rows, table
from wirespark.llm import fingerprints as fp
from wirespark.llm.queries import op7_edit_walks


def walk(text):
    """The fingerprint of one text, step by step."""
    fp.Steps.upto(3 * len(text))
    picked = fp.Steps.of(len(text))
    kinds = [max(1, ((ord(c) * 0x9E3779B1) & 0xFFFFFFFF) >> 24) for c in text] + [0]
    place, seen, at = 0, {}, set(fp.Steps.steps[picked].tolist())
    for j in range(3 * len(text)):
        if j in at:
            h = 0
            for k in range(fp.GRAM):
                h = (h * 0x01000193 + (ord(text[place + k]) if place + k < len(text) else 0)) & 0xFFFFFFFF
            h ^= h >> 15
            h = h * 0x2C1B3C6D & 0xFFFFFFFF
            seen[j] = max(h >> 24, 1) if place < len(text) else 0
        place += int(fp.MOVES[j % fp.PERIOD][kinds[place]])
    return f"{len(text):x}:" + bytes(seen[j] for j in sorted(seen)).hex()


def test_steps_of_a_length_are_its_least_priorities():
    prio = fp.mix64(fp.np.arange(200_000, dtype=fp.np.uint64) + fp.np.uint64((fp.SEED + 1) << 40))
    for n in (0, 1, 20, 40, 1000, 66_000):
        want = fp.np.sort(fp.np.argsort(prio[: 3 * n])[: fp.SAMPLES])
        at = fp.Steps.of(n)
        assert (fp.Steps.steps[at] == want).all()


def test_together_equals_one_by_one():
    rng = random.Random(4)
    texts = ["", "a", "\0\0x", "é𝔘" * 40] + ["".join(rng.choice("abcde fgh\n") for _ in range(rng.randrange(400))) for _ in range(90)]
    assert fp.fingerprints(texts) == [walk(t) for t in texts]
    assert fp.fingerprints(texts[:5]) == [walk(t) for t in texts[:5]]


def test_likeness_falls_with_edits():
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghij klmnop") for _ in range(3000))

    def changed(edits):
        t = list(text)
        for _ in range(edits):
            i = rng.randrange(len(t))
            rng.choice((lambda: t.pop(i), lambda: t.insert(i, "z"), lambda: t.__setitem__(i, "q")))()
        return "".join(t)

    one, few, many, other = fp.fingerprints([text, changed(6), changed(300), text[::-1]])
    assert fp.likeness(one, one) == 1 and fp.likeness(one, few) > 0.7 > fp.likeness(one, many) and fp.likeness(one, other) < 0.15
    assert fp.likeness(few, one) == fp.likeness(one, few)


def test_query(spark, data):
    docs = sorted(table(data), key=lambda d: -d["doc_id"])
    got = {r["doc_id"]: r for r in rows(op7_edit_walks(spark, data))}
    assert len(got) == len(docs)
    near = []
    marks = dict(zip((d["text"] for d in docs), fp.fingerprints([d["text"] for d in docs]), strict=True))
    for d, e in zip(docs, docs[1:] + docs[:1], strict=True):
        r, k = got[d["doc_id"]], len(d["text"]) // 3
        text = d["text"][: len(d["text"]) - k] + e["text"][:k]
        assert r["n_chars"] == len(d["text"]) and r["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["fingerprint"] == marks[d["text"]] and r["near_next"] == fp.likeness(marks[d["text"]], marks[e["text"]])
        assert r["near_edited"] == fp.likeness(r["fingerprint"], r["edited_fingerprint"])
        near.append((r["near_edited"], r["near_next"], d["text"] == e["text"]))
    assert sum(x[0] for x in near) / len(near) > 0.6
    assert sum(x[1] for x in near if not x[2]) / len(near) < 0.15


def test_odd_rows(spark):
    docs = spark.createDataFrame([(*r, "y") for r in ODD], SCHEMA + ", fingerprint string")
    got = rows(fp.compared(docs))
    assert len(got) == len(ODD)
    assert sorted(r["n_chars"] for r in got) == sorted(len(r[1] or "") for r in ODD)
    assert rows(fp.compared(docs.limit(0))) == []
    assert len(rows(fp.compared(docs.limit(1)))) == 1


def test_near_duplicates(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(12):
        t = "".join(rng.choice("abcdefgh ijk") for _ in range(800))
        texts += [t, t, t[:400] + "x" + t[401:]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(90, None), (91, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in rows(fp.near_duplicates(docs, 0.5))}
    assert len(got) == 38
    assert all(got[i] == i - i % 3 for i in range(36))
    assert rows(fp.near_duplicates(docs.limit(0))) == []


def test_bands_find_pairs_of_unequal_length():
    """Every pair that brute force calls near shares a band, with a passage appended, put in or cut, and letters changed."""
    rng = random.Random(8)
    asked = 0
    for n in (24, 60, 150, 400, 3000):
        for share in (0, 1, 3, 5, 10, 15, 20):
            texts = []
            for _ in range(20):
                t = "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
                more = "".join(rng.choice("abcdefghij klmnop") for _ in range(n * share // 100))
                at = rng.choice((0, n, rng.randrange(n)))
                changed = list(t[:at] + more + t[at:])
                for _ in range(rng.randrange(1 + n // 40)):
                    changed[rng.randrange(len(changed))] = "z"
                texts += [t, "".join(changed)]
            marks = fp.fingerprints(texts)
            keys = [set(fp.bands(m)) for m in marks]
            for i in range(0, len(marks), 2):
                if fp.likeness(marks[i], marks[i + 1]) >= 0.8:
                    asked += 1
                    assert keys[i] & keys[i + 1], (n, share)
    assert asked > 250


def test_near_duplicates_of_unequal_length(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(12):
        t = "".join(rng.choice("abcdefgh ijk") for _ in range(900))
        texts += [t, *(t + "".join(rng.choice("abcdefgh ijk") for _ in range(9 * k)) for k in (3, 5, 10, 15, 20))]
    marks = fp.fingerprints(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if fp.likeness(marks[i], marks[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in rows(fp.near_duplicates(docs))}
    assert got == components(range(len(texts)), links)
