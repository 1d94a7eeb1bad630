"""Token ids of whole texts with a public word-level BPE tokenizer, with a cache of word parts.

The tokenizer drops white space and never joins characters across it, so a text's ids are those of its words one after
the other. Each distinct word of a batch is taken once. Words of printable ASCII and Latin letters, which the tokenizer's
normaliser only lowers, are split by its own pattern, and each distinct part is given to its model once (a bounded cache
holds the results); all other words, and those that may hold special tokens, are encoded whole by the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wirespark.llm.common import coded, slices, split_words, texts_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_COMPOSED = re.compile("[À-ÖØ-öø-įı-ɏ]")
#: Latin letters that are composed, and of which lower case is one of them.
LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if _COMPOSED.match(c) and _COMPOSED.fullmatch(c.lower()))
SIMPLE = f"^[!-~{LATIN}]+$"
#: Fixed value: the tokenizer's split pattern, on lower-case characters of SIMPLE; a line feed ends a word.
PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+|\n")
CACHE_PARTS = 250_000
ENCODE_BYTES = 2 << 20
#: Stands for the end of a word among 16-bit ids.
MARK = 0xFFFF


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids as unsigned 16-bit integers (the vocabulary has under 2^16 - 1)."""

    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() >= MARK:
            raise ValueError("a vocabulary of fewer than 65,535 ids is needed")
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = "|".join(re.escape(t.content[:2]) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = np.array([MARK], "<u2").tobytes()
        self.parts = {"\n": self.mark}

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        """One encoder for each worker process."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _part(self, part: str) -> bytes:
        if not part.isascii():
            part = self.bytes.pre_tokenize_str(part)[0][0]
        return np.array([t.id for t in self.tokenizer.model.tokenize(part)], "<u2").tobytes()

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct words, where each word's ids start among them, their number)."""
        simple = np.asarray(pc.match_substring_regex(words, SIMPLE))
        if self.special:
            simple = simple & ~np.asarray(pc.match_substring_regex(words, self.special))
        if len(self.parts) > CACHE_PARTS:
            self.parts = {"\n": self.mark}
        found = PARTS.findall("\n".join([*pc.utf8_lower(words.filter(pa.array(simple))).to_pylist(), ""]))
        cache, out = self.parts, list(map(self.parts.get, found))
        for i, got in enumerate(out):
            if got is None:
                part = found[i]
                got = cache.get(part)
                if got is None:
                    got = cache[part] = self._part(part)
                out[i] = got
        rest = self.tokenizer.encode_batch_fast(words.filter(pa.array(~simple)).to_pylist(), add_special_tokens=False)
        out.extend(x for e in rest for x in (np.array(e.ids, "<u2").tobytes(), self.mark))
        bank = np.frombuffer(b"".join(out), "<u2")
        ends = np.flatnonzero(bank == MARK)
        sizes = np.empty(len(words), np.int64)
        order = np.concatenate([np.flatnonzero(simple), np.flatnonzero(~simple)])
        sizes[order] = np.diff(ends, prepend=-1) - 1
        firsts = np.empty(len(words), np.int64)
        firsts[order] = np.concatenate([[0], np.cumsum(sizes[order])[:-1]]) if len(words) else 0
        return bank[bank != MARK], firsts, sizes

    def encode(self, texts: pa.Array, end_id: int, most: int = ENCODE_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """All ids with end_id after each text, and where each text starts (one longer); about `most` bytes are split into parts at a time."""
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        done = [self._encode(texts_of(part.column(0)), end_id) for part in slices(iter([batch]), "text", most)]
        if not done:
            return np.zeros(0, "<u2"), np.zeros(1, np.int64)
        ends = np.cumsum([0, *(at[-1] for _, at in done)])
        return np.concatenate([ids for ids, _ in done]), np.concatenate([*(at[:-1] + n for (_, at), n in zip(done, ends[:-1], strict=True)), ends[-1:]])

    def _encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        words, at = split_words(texts)
        codes, distinct = coded(words)
        bank, firsts, sizes = self.of_words(distinct)
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        # the id at place p of the output lies as far behind its word's first id in the bank
        flat = bank[np.repeat(firsts[codes] - ends[:-1], n) + np.arange(ends[-1])] if len(codes) else np.zeros(0, "<u2")
        ends = ends[at]
        ids = np.insert(flat, ends[1:], end_id)
        return ids.astype("<u2", copy=False), ends + np.arange(len(ends))
