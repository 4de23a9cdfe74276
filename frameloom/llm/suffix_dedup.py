"""Repeated passages by sparse suffix arrays.

Of a text's suffixes only those at minimiser positions are retained: in every run of ``SPREAD`` neighbouring ``GRAM``-word
grams the one with the least hash. Equal passages of ``MIN_WORDS`` words choose the same position within their first ``SPREAD``
words, so their suffixes agree in ``MIN_WORDS - SPREAD + 1`` words from there on. Suffixes are sorted by a fingerprint of that
stretch and compared with their neighbours (first within a partition, so that a very common passage shrinks to one row each,
then over all); those without an equal neighbour are done.

Each of the others is one row, with its context: the words that all windows of ``MIN_WORDS`` words that chose the position
cover, to its left and right. Suffixes with equal contexts are extended as one: only different contexts of a suffix are taken
apart into windows, and a window that stands in two contexts, or in a context that occurs twice, is a repeat. A context's
repeated windows are intervals, which go back to its occurrences and join to maximal spans. No pairs of occurrences are made.

Fingerprints have 64 bits. Windows are compared among those of one suffix only, so a false match needs two stretches of words
that agree in the suffix and collide in the rest, or collide in both. Null texts and texts of fewer words have no spans; texts are
read whole; rows of one id and text are one row, as are ties; an empty table gives an empty result; other columns are not looked
at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, row_key, small

MIN_WORDS, SPREAD, GRAM = 50, 24, 8
#: Repeated suffix fingerprints (8 bytes each), and contexts with their intervals (some 100 bytes each), up to which they are sent
#: to all executors; beyond it they are joined.
BROADCAST_SUFFIXES, BROADCAST_CONTEXTS = 2_000_000, 20_000
#: Characters whose words are worked on at once, and words whose hashes a worker keeps.
BLOCK, KNOWN_WORDS = 1 << 20, 200_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


class Rolling:
    """Fingerprints of any stretch of a sequence of word hashes, from prefix sums modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[:n], dtype=np.uint64)))

    def at(self, starts: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        x = (self.sums[starts + size] - self.sums[starts]) * self.down[starts]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _minimisers(values: np.ndarray, spread: int) -> np.ndarray:
    """The place of the least value (the first of equal ones) in each run of ``spread`` values."""
    low, place, have = values, np.arange(len(values)), 1
    while have < spread:
        step = min(have, spread - have)
        right = low[step:] < low[: len(low) - step]
        place = np.where(right, place[step:], place[: len(place) - step])
        low = np.minimum(low[step:], low[: len(low) - step])
        have += step
    return place


class Block:
    """Some texts' words in a row: the windows that lie within one text, and the position that each chose."""

    def __init__(self, words: list[list[bytes]], known: _Hashes, min_words: int):
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter((known[x] for w in words for x in w), np.uint64, int(sizes.sum()))
        self.ends = np.cumsum(sizes)
        self.roll, self.min_words = Rolling(flat), min_words
        begins = self.ends - sizes
        count = np.maximum(0, sizes - min_words + 1)
        self.doc = np.repeat(np.arange(len(words)), count)
        self.window = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
        self.local = self.window - begins[self.doc] if len(self.doc) else self.window
        if len(self.window):
            grams = self.roll.at(np.arange(len(flat) - GRAM + 1), GRAM)
            self.chosen = _minimisers(grams, SPREAD)[self.window]
        else:
            self.chosen = self.window

        #: The first window of each run of windows that chose one position, and the windows in it.
        self.runs = np.flatnonzero(np.diff(self.chosen, prepend=-1))
        self.sizes = np.diff(np.append(self.runs, len(self.chosen)))

    def suffixes(self) -> np.ndarray:
        """The fingerprint of each run's suffix."""
        return self.roll.at(self.chosen[self.runs], self.min_words - SPREAD + 1).view(np.int64)

    def contexts(self) -> np.ndarray:
        """The fingerprint of the words that each run's windows cover."""
        return self.roll.at(self.window[self.runs], self.sizes - 1 + self.min_words).view(np.int64)


def _blocks(texts: list[str | None], known: _Hashes, min_words: int) -> Iterator[tuple[int, Block]]:
    words, size, begin = [], 0, 0
    for k, text in enumerate(texts):
        words.append((text or "").encode("utf-8", "surrogatepass").split())
        size += len(text or "")
        if size >= BLOCK or k + 1 == len(texts):
            yield begin, Block(words, known, min_words)
            words, size, begin = [], 0, k + 1


def _check(min_words: int) -> None:
    if min_words < SPREAD + GRAM:
        raise ValueError(f"min_words must be {SPREAD + GRAM} or more")


def repeated_suffixes(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """``suffix``: fingerprints that two retained suffixes share."""

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, size = _Hashes(), [], 0

        def sorted_run() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(found), return_counts=True)  # sorts and compares neighbours
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.minimum(counts, 2).astype(np.int32))], ["suffix", "n"])

        for batch in batches:
            for _, block in _blocks(batch.column(0).to_pylist(), known, min_words):
                if len(block.runs):
                    found.append(block.suffixes())
                    size += len(block.runs)
                if size > 1 << 20:
                    yield sorted_run()
                    found, size = [], 0
        if found:
            yield sorted_run()

    runs = docs.select(F.col(text).cast("string")).mapInArrow(retained, "suffix long, n int")
    return runs.groupBy("suffix").agg(F.sum("n").alias("n")).where("n > 1").select("suffix")


def _interval(x: Column) -> Column:
    return F.struct(x["j"].alias("from"), x["j"].alias("to"), x["first_id"].alias("first_id"), x["copies"].alias("copies"), x["across"].alias("across"))


def _intervals(windows: Column) -> Column:
    """Neighbouring windows (ordered structs of j, first_id, copies, across) as intervals."""

    def add(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        longer = F.struct(last["from"].alias("from"), x["j"].alias("to"), F.least(last["first_id"], x["first_id"]).alias("first_id"), F.greatest(last["copies"], x["copies"]).alias("copies"), (last["across"] | x["across"]).alias("across"))
        joins = F.coalesce(last["to"] + 1 == x["j"], F.lit(False))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(_interval(x))))

    return F.aggregate(windows, F.slice(F.transform(windows, _interval), 1, 0), add)


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, broadcast_suffixes: int = BROADCAST_SUFFIXES) -> DataFrame:
    """``id, start, n_words`` of every maximal stretch of words (counted from 0, between white space) whose windows of
    ``min_words`` words all occur elsewhere too, in another row or in this one; with ``first_id``, the least id that holds one of
    the windows, ``copies``, the most occurrences of one of them, and ``across``, whether another row has one."""
    _check(min_words)
    kind = docs.schema[id].dataType.simpleString()
    plain = docs.select(F.col(id).alias("id_"), row_key(F.col(text).cast("string")).alias("key_"), F.col(text).cast("string").alias("text_"))
    repeated = materialise(repeated_suffixes(plain, "text_", min_words), "suffixes")
    few = repeated.count() <= broadcast_suffixes
    values = np.sort(repeated.toArrow()["suffix"].to_numpy().astype(np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(values) if few else None
    columns = ["id_", "key_", "start", "n", "suffix", "context", "prints"]

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = _Hashes(), shared.value if shared is not None else None
        for batch in batches:
            for begin, block in _blocks(batch.column(2).to_pylist(), known, min_words):
                suffix = block.suffixes() if len(block.runs) else np.zeros(0, np.int64)
                keep = np.arange(len(suffix))
                if wanted is not None:
                    keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, suffix), len(wanted) - 1)] == suffix) if len(wanted) else keep[:0]
                if not len(keep):
                    continue
                first, n = block.runs[keep], block.sizes[keep]
                inside = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
                prints = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(block.roll.at(block.window[inside], min_words).view(np.int64)))
                rows = pa.array(block.doc[first] + begin)
                own = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(block.local[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(suffix[keep]), pa.array(block.contexts()[keep]), prints]
                yield pa.RecordBatch.from_arrays(own, columns)

    found = plain.mapInArrow(retained, f"id_ {kind}, key_ long, start int, n int, suffix long, context long, prints array<long>")
    if not few:
        found = found.join(repeated, "suffix", "left_semi")
    found = materialise(found, "matches")
    row = F.xxhash64("id_", "key_")
    key = ["suffix", "context", "n"]
    # An occurrence has one context, so a window in two contexts occurs twice, as one does whose context occurs twice.
    contexts = found.groupBy(*key).agg(F.count("*").cast("int").alias("copies"), F.min(row).alias("a"), F.max(row).alias("b"), F.min("start").alias("s0"), F.max("start").alias("s1"), F.min("id_").alias("first_id"), F.first("prints").alias("prints"))
    contexts = contexts.withColumn("across", F.col("a") != F.col("b")).withColumn("again", F.col("across") | (F.col("s0") != F.col("s1"))).drop("b", "s0", "s1")
    contexts = materialise(contexts, "contexts")
    windows = contexts.select(*key, "copies", "a", "across", "again", "first_id", F.posexplode("prints").alias("j", "print"))
    twice = windows.groupBy("suffix", "print").agg(F.sum("copies").alias("copies"), F.count("*").cast("int").alias("n"), F.min("a").alias("a"), F.max("a").alias("b"), F.bool_or("across").alias("across"), F.bool_or("again").alias("again"), F.min("first_id").alias("first_id"))
    twice = twice.where("n > 1 OR again").select("suffix", "print", "copies", "first_id", (F.col("across") | (F.col("a") != F.col("b"))).alias("across"))
    held = windows.select(*key, "j", "print").join(twice, ["suffix", "print"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("j", "first_id", "copies", "across"))).alias("w"))
    # Written, so that the join is a broadcast of a checked size or a plain one, which Spark splits at very common contexts.
    held = materialise(held.select(*key, _intervals(F.col("w")).alias("x")), "intervals")
    hits = found.drop("prints").join(small(held, BROADCAST_CONTEXTS)[0], key).select("id_", "key_", "start", F.explode("x").alias("x"))
    hits = hits.select("id_", "key_", F.struct((F.col("start") + F.col("x.from")).alias("from"), (F.col("start") + F.col("x.to")).alias("to"), "x.first_id", "x.copies", "x.across").alias("x"))
    hits = hits.groupBy("id_", "key_").agg(F.sort_array(F.collect_set("x")).alias("x"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k in range(batch.num_rows):
                x = batch.column(1)[k].values
                begin, end, many = (x.field(f).to_numpy() for f in ("from", "to", "copies"))
                names, across = x.field("first_id").to_pylist(), x.field("across").to_numpy(zero_copy_only=False)
                reach = np.maximum.accumulate(end)
                cuts = [0, *(np.flatnonzero(begin[1:] > reach[:-1] + 1) + 1).tolist(), len(begin)]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    rows.append(k)
                    out.append((int(begin[i]), int(reach[j - 1] - begin[i]) + min_words, min((n for n in names[i:j] if n is not None), default=None), int(many[i:j].max()), bool(across[i:j].any())))
            start, size, first, copies, other = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(first, batch.schema.field(0).type), pa.array(copies, pa.int64()), pa.array(other, pa.bool_())], [id, "start", "n_words", "first_id", "copies", "across"])

    return hits.select("id_", "x").mapInArrow(spans, f"`{id}` {kind}, start long, n_words long, first_id {kind}, copies long, across boolean")
