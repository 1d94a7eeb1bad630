import pyarrow as pa
import pytest

from tests.llm.helpers import ODD, SCHEMA, crc, encode, groups, rows, table
from wirespark.llm import packing
from wirespark.llm.queries import op8_min_slack_packing
from wirespark.llm.tokens import WordEncoder, default_path


def check(pieces, docs, lengths_of):
    by_seq = groups((p["sequence_id"], (p["offset"], p["length"])) for p in pieces)
    for at in by_seq.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end and length > 0
            end += length
        assert end == 2048 or end & (end - 1) == 0  # nothing to pad
    assert sum(p["length"] for p in pieces) == sum(lengths_of)


def test_query_matches_tokenizer(spark, data):
    docs = table(data)
    ids = dict(zip((d["doc_id"] for d in docs), encode([d["text"] for d in docs], 1), strict=True))
    pieces = rows(op8_min_slack_packing(spark, data))
    check(pieces, docs, map(len, ids.values()))
    at = groups((p["doc_id"], (p["start"], p["length"])) for p in pieces)
    assert at.keys() == ids.keys()
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == crc(own[p["start"] : p["start"] + p["length"]])
    for doc, spans in at.items():
        end = 0
        for start, length in sorted(spans):
            assert start == end
            end += length
        assert end == len(ids[doc])


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    pieces = rows(packing.pack(docs))
    check(pieces, ODD, map(len, encode([r[1] for r in ODD], 1)))
    assert rows(packing.pack(docs.limit(0))) == []


def test_special_strings_and_unicode_space(spark):
    texts = ["a<|endoftext|>b <|startoftext|>", "x y z \u0085 q", "don't we'll'S 12ab3 ΑΣ İI", "é ́", "\x00\x1c\x1fq", "日本語 テスト ½ ²", "A.B,c--d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for p in sorted(rows(packing.pack(docs)), key=lambda p: p["start"]):
        got[p["doc_id"]] = got.get(p["doc_id"], b"") + p["ids"]
    want = encode(texts, 1)
    assert {i: [int.from_bytes(b[k : k + 4], "little") for k in range(0, len(b), 4)] for i, b in got.items()} == dict(enumerate(want))


def test_every_latin_letter_inside_a_word():
    words = [w for c in map(chr, range(0x21, 0x300)) for w in (c, f"{c}li", f"a{c}b", f"q{c}", f"{c}{c}")]
    words = [w for w in words if not w.isspace() and len(w.split()) == 1]
    bank, firsts, sizes = WordEncoder(default_path()).of_words(pa.array(words))
    got = [bank[a : a + n].tolist() for a, n in zip(firsts.tolist(), sizes.tolist(), strict=True)]
    wrong = [(w, g, e[:-1]) for w, g, e in zip(words, got, encode(words, 1), strict=True) if g != e[:-1]]
    assert wrong == []


@pytest.mark.parametrize("counts, room, best", [({5: 2, 3: 1}, 10, 10), ({7: 3, 4: 1}, 10, 7), ({9: 1}, 5, 0), ({6: 1, 4: 2, 3: 3}, 13, 13)])
def test_fill_is_optimal(counts, room, best):
    got = packing.fill(counts, room)
    assert sum(k * n for k, n in got.items()) == best
    assert all(n <= counts[k] for k, n in got.items())
