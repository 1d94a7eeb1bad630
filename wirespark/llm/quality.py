"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. Rules are independent, so their order changes only the cost. It is found on a
bounded sample, step by step: of the rules left, each is run on the sample's texts that the rules chosen so far let
through, with what those have computed already at hand, and the one with the most rejections per second comes next. In
the cascade each rule sees only the documents that the rules before it let through, and computes only what is not yet
known of them. Measures that are asked for of all rows are filled in afterwards. The verdict doesn't depend on the order,
so reruns agree.

Null texts count as empty. Empty texts have no words and fail the rule on few words. Repeated rows and ties get one
verdict each; other columns pass through.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wirespark.llm.common import coded, per_text, row_hash, slices, split_words, texts_of

SYMBOLS = b"#*$%&|<>"
CHUNK_BYTES = 4 << 20
SAMPLE_ROWS, SAMPLE_BYTES = 1000, 32 << 20
BLANK = " \t\n\v\f\r"


class Texts:
    """A batch of texts. What several measures need is made once for the batch, a measure for each row when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts, self._made, self._known = texts, {}, {}

    def __len__(self) -> int:
        return len(self.texts)

    def copy(self) -> Texts:
        other = Texts(self.texts)
        other._made, other._known = dict(self._made), {k: (v.copy(), have.copy()) for k, (v, have) in self._known.items()}
        return other

    def made(self, make: Callable[[pa.Array], object]):
        if make not in self._made:
            self._made[make] = make(self)
        return self._made[make]

    def measure(self, name: str, rows: np.ndarray) -> np.ndarray:
        compute, kind = MEASURES[name]
        values, have = self._known.setdefault(name, (np.zeros(len(self), kind), np.zeros(len(self), bool)))
        if len(lacking := rows[~have[rows]]):
            values[lacking], have[lacking] = compute(self, lacking), True
        return values[rows]

    def rows(self, rows: np.ndarray | None = None) -> Rows:
        return Rows(self, np.arange(len(self)) if rows is None else rows)


class Rows:
    """Some rows of a batch, as rules see them: each measure is an attribute, an array with a value a row."""

    def __init__(self, texts: Texts, which: np.ndarray):
        self._texts, self._which = texts, which

    def __len__(self) -> int:
        return len(self._which)

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in MEASURES:
            raise AttributeError(name)
        return self._texts.measure(name, self._which)


def _words(t: Texts) -> tuple[pa.Array, np.ndarray]:
    return split_words(t.texts)


def _codes(t: Texts) -> np.ndarray:
    return coded(t.made(_words)[0])[0]


def _strings(t: Texts, rows: np.ndarray) -> list[str]:
    return t.texts.take(pa.array(rows)).to_pylist()


def _lines(text: str) -> list[str]:
    """Lines with a word."""
    return [x for x in text.split("\n") if x.strip(BLANK)]


def _n_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    return np.diff(t.made(_words)[1])[rows]


def _word_lengths(t: Texts) -> np.ndarray:
    words, at = t.made(_words)
    return per_text(np.asarray(pc.utf8_length(words)).astype(np.int64), at)


def _word_chars(t: Texts, rows: np.ndarray) -> np.ndarray:
    return t.made(_word_lengths)[rows]


def _n_symbols(t: Texts, rows: np.ndarray) -> np.ndarray:
    return np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in map(str.encode, _strings(t, rows))], np.int64)


def _dup_line_share(t: Texts, rows: np.ndarray) -> np.ndarray:
    def share(lines: list[str]) -> float:
        return 1 - sum(map(len, set(lines))) / sum(map(len, lines)) if lines else 0.0

    return np.array([share(_lines(x)) for x in _strings(t, rows)], float)


def _n_dup_lines(t: Texts, rows: np.ndarray) -> np.ndarray:
    return np.array([len(x) - len(set(x)) for x in map(_lines, _strings(t, rows))], np.int64)


def _n_repeat_words(t: Texts, rows: np.ndarray) -> np.ndarray:
    at, codes = t.made(_words)[1], t.made(_codes)
    return np.array([repeated(codes[at[i] : at[i + 1]]) for i in rows.tolist()], np.int64)


def _upper_share(t: Texts, rows: np.ndarray) -> np.ndarray:
    texts = t.texts.take(pa.array(rows))
    upper = np.asarray(pc.count_substring_regex(texts, r"\p{Lu}")).astype(np.int64)
    lower = np.asarray(pc.count_substring_regex(texts, r"\p{Ll}")).astype(np.int64)
    return upper / np.maximum(upper + lower, 1)


#: dup_line_share: characters of lines with a word that are in lines equal to an earlier one; upper_share: upper-case letters among those that have a case.
MEASURES: dict[str, tuple[Callable[[Texts, np.ndarray], np.ndarray], type]] = {
    "n_words": (_n_words, np.int64), "word_chars": (_word_chars, np.int64), "n_symbols": (_n_symbols, np.int64), "dup_line_share": (_dup_line_share, float),
    "n_dup_lines": (_n_dup_lines, np.int64), "n_repeat_words": (_n_repeat_words, np.int64), "upper_share": (_upper_share, float),
}


def repeated(codes: np.ndarray) -> int:
    """Words in windows of three whose sequence occurs twice or more, the first occurrence included."""
    if len(codes) < 4:
        return 0
    _, codes = np.unique(codes, return_inverse=True)
    n = int(codes.max()) + 1
    pairs = codes[:-1] * n + codes[1:]
    _, pairs = np.unique(pairs, return_inverse=True)
    _, which, times = np.unique(pairs[:-1] * n + codes[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(codes), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """rejects: from a batch to one boolean a text."""

    name: str
    rejects: Callable[[Rows], np.ndarray]


def few_words(t: Rows) -> np.ndarray:
    return t.n_words < 50


def repeats_itself(t: Rows) -> np.ndarray:
    return 100 * t.n_repeat_words > 50 * t.n_words


def symbols(t: Rows) -> np.ndarray:
    return 10 * t.n_symbols > t.n_words


def repeated_lines(t: Rows) -> np.ndarray:
    return t.dup_line_share > 0.4


def shouting(t: Rows) -> np.ndarray:
    return t.upper_share > 0.5


def odd_words(t: Rows) -> np.ndarray:
    mean = t.word_chars / np.maximum(t.n_words, 1)
    return (mean < 2) | (mean > 20)


BASE_RULES = (Rule("few_words", few_words), Rule("repeats_itself", repeats_itself))
RULES = (*BASE_RULES, Rule("symbols", symbols), Rule("repeated_lines", repeated_lines), Rule("shouting", shouting), Rule("odd_words", odd_words))
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", key_col: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[tuple[int, str, float, int, int]]:
    """(step, rule, seconds, rejected, texts) in the order of the cascade, from a sample of at most sample_rows rows (of SAMPLE_BYTES, if they are long), spread by a hash of the key: what each rule costs and rejects after those before it."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, SAMPLE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*steps(Texts(texts_of(batch.column(text_col))), rules), strict=True)], ["step", "rule", "seconds", "rejected", "texts"])
            return

    sample = docs.select(text_col, key_col).where(F.pmod(row_hash(key_col), F.lit(16)) == 0).limit(sample_rows).select(text_col)
    got = sample.coalesce(1).mapInArrow(measure, "step long, rule string, seconds double, rejected long, texts long")
    return [tuple(r) for r in got.orderBy("step").collect()]


def steps(texts: Texts, rules: tuple[Rule, ...]) -> list[tuple[int, str, float, int, int]]:
    """(step, rule, seconds, rejected, texts): of the rules left, that of the most rejections per second on the texts left."""
    left, rest, out = np.arange(len(texts)), list(rules), []
    while rest:
        tried = []
        for rule in rest:
            own = texts.copy()  # what this rule computes doesn't make the next one look cheap
            began = time.perf_counter()
            bad = rule.rejects(own.rows(left))
            seconds = time.perf_counter() - began
            tried.append((int(bad.sum()) / max(seconds, 1e-9), rule, seconds, bad, own))
        _, rule, seconds, bad, texts = max(tried, key=lambda t: t[0])
        out.append((len(out), rule.name, seconds, int(bad.sum()), len(left)))
        left = left[~bad]
        rest.remove(rule)
    return out


def ordered(rules: tuple[Rule, ...], found: list[tuple[int, str, float, int, int]]) -> tuple[Rule, ...]:
    """Rules in the order of the estimates; without a sample they keep their own."""
    at = {name: step for step, name, *_ in found}
    return tuple(sorted(rules, key=lambda r: at.get(r.name, len(at))))


def passes(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """The cascade: each rule sees what the rules before it let through."""
    ok, left = np.zeros(len(texts), bool), np.arange(len(texts))
    for rule in rules:
        if not len(left):
            return ok
        left = left[~rule.rejects(texts.rows(left))]
    ok[left] = True
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", key_col: str = "doc_id", measures: tuple[str, ...] = (), verdict: str = "kept") -> DataFrame:
    """docs with the verdict, and with the measures named (of MEASURES, for all rows)."""
    rules = ordered(rules, estimates(docs, rules, text_col, key_col))
    clash = {verdict, *measures} & set(docs.columns)
    if clash:
        docs = docs.drop(*clash)
    names = [*docs.columns, *measures, verdict]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, CHUNK_BYTES):
            texts = Texts(texts_of(batch.column(text_col)))
            verdicts, every = pa.array(passes(texts, rules)), np.arange(len(texts))
            found = [pa.array(texts.measure(m, every).astype(np.int64)) for m in measures]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found, verdicts], names)

    schema = T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in measures), T.StructField(verdict, T.BooleanType())])
    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """The documents that no rule rejects, with their columns."""
    columns, verdict = docs.columns, "_kept"
    while verdict in columns:
        verdict += "_"
    return judge(docs, rules, verdict=verdict, **options).where(verdict).select(*columns)
