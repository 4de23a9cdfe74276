"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection rate are measured on a bounded sample, and the rules run by rejections per second until one
rejects. The order changes the work only: a text is kept if no rule rejects it, whatever the order.

Nulls and empty texts have no words (all metrics 0); texts are read whole; repeated rows get equal results; an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: The share of a text's words, lines or characters from which a rule rejects.
MAX_SYMBOLS_PER_WORD, MAX_UPPER, MAX_DUP_LINES, MAX_ADJACENT, MEAN_WORD = 0.25, 0.5, 0.5, 0.3, (1.5, 25.0)
#: Rows that the order of the rules is estimated from, and characters in one of them at most.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 100_000
_SPACES = " \t\n\v\f\r"
_MIX = np.random.default_rng(8).integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more in the list, first occurrences included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, len(words))
    if len(seen) == len(words):
        return 0
    mixed = ids * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key += mixed[i : i + n] * _MIX[i % WINDOW]
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():  # equal windows have equal keys
        return 0
    exact = ids[:n].astype(np.int64)
    for i in range(1, size):
        exact = np.unique(exact * len(seen) + ids[i : i + n].astype(np.int64), return_inverse=True)[1].astype(np.int64)
    often = np.bincount(exact)[exact] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(often)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


class Text:
    """A text whose metrics are computed when a rule first asks for them."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode("utf-8", "surrogatepass").split()
        self.n_words = len(self.words)

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        setattr(self, name, value)
        return value

    def _word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, _SPACES))

    def _n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def _lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(_SPACES)]

    def _n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self) -> int:
        return repeated_words(self.words)

    def _n_upper(self) -> int:
        return sum(map(bytes.isupper, self.words))

    def _n_adjacent(self) -> int:
        return sum(a == b for a, b in zip(self.words, self.words[1:], strict=False))


#: A rule rejects a text if it holds for it.
RULES = {
    "few_words": lambda t: t.n_words < MIN_WORDS,
    "word_length": lambda t: not MEAN_WORD[0] * t.n_words <= t.word_chars <= MEAN_WORD[1] * t.n_words,
    "symbols": lambda t: t.n_symbols > MAX_SYMBOLS_PER_WORD * t.n_words,
    "upper_case": lambda t: t.n_upper > MAX_UPPER * t.n_words,
    "adjacent_repeats": lambda t: t.n_adjacent > MAX_ADJACENT * t.n_words,
    "duplicate_lines": lambda t: t.n_dup_lines > MAX_DUP_LINES * len(t.lines),
    "repeated_windows": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
}
BASE = ("few_words", "repeated_windows")


def cascade_order(docs: DataFrame, text: str = "text", rules: tuple[str, ...] = tuple(RULES), sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules by rejections per second on ``sample_rows`` rows. They come to the driver, which reads only the partitions they
    are in and measures there; texts beyond ``SAMPLE_CHARS`` are left out of the sample, so that its size is bounded."""
    short = docs.select(F.col(text).cast("string").alias("t")).where(F.coalesce(F.char_length("t"), F.lit(0)) <= SAMPLE_CHARS)
    spent, hits = dict.fromkeys(rules, 1e-9), dict.fromkeys(rules, 0)
    for row in short.limit(sample_rows).collect():
        for r in rules:
            doc = Text(row["t"])
            began = time.perf_counter()
            hits[r] += bool(RULES[r](doc))
            spent[r] += time.perf_counter() - began
    return sorted(rules, key=lambda r: (-hits[r] / spent[r], r))


def score_rules(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the base metrics, ``base_failed`` and ``kept`` for every row. The base metrics are wanted of every text here, so
    the cascade orders what is left to decide."""
    order = [r for r in cascade_order(docs, text) if r not in BASE]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                t = Text(value)
                failed = any(RULES[r](t) for r in BASE)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and not any(RULES[r](t) for r in order)))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.bool_()) for c in columns[5:])], [id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, F.col(text).cast("string").alias("text_")).mapInArrow(score, f"`{id}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text no rule rejects, with their columns; rules stop at the first that rejects."""
    order = cascade_order(docs, text)
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for value in batch.column(at).to_pylist():
                t = Text(value)
                mask.append(not any(RULES[r](t) for r in order))
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
