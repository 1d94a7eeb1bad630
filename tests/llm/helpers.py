"""Brute-force versions, in plain Python, of what the operators compute."""

import re
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
A_LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
#: Null ids, texts and sources, empty and very long texts, repeated rows.
ODD = [
    (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "lost words here", "en", "s", 1), (4, None, None, None, None), (5, "", "", "", 0), (6, " \n\t ", "en", "s", 4), (7, A_LONG, "en", "t", 1),
    (8, "x " * 60, "en", "t", 1), (9, "naïve café — 𝔘nicode\n\nline\nline", "fr", None, 3),
]


def table(data, name="documents"):
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def rows(df):
    return [r.asDict() for r in df.collect()]


def repeat_words(words):
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def base_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat_words(words)}


def encode(texts, end_id):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*e.ids, end_id] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
