"""Best-fit packing of token sequences.

The piece lengths form a histogram of at most ``capacity`` entries. A configuration linear program over it (cover every
length's count by as few bins as possible) is solved by multiplicative weights: a length's price falls as it gets covered, and
a knapsack dynamic program over the prices gives the best bins. The fractional solution is rounded, and what is left is solved
and rounded again until it fits one bin; that last bit is packed by best-fit decreasing. The same is done at every size.
All of it works on the histogram, on the driver; a group of equal bins is one entry, so the plan's size follows the number of
lengths and not the number of pieces.

Pieces get their place without a global sort: rank within (length, salt), plus the salts' offsets, looked up in the plan.

Null and empty texts are one piece that holds the end token; long texts are cut into full pieces and the rest; ties in length
are interchangeable and dealt by id, piece and checksum; repeated rows are packed each; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import json
import math
import re
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise

CAPACITY, END, SALTS = 4096, 1, 128
#: Rounds of the linear program, lengths that are priced at once, and how fast a covered length's price falls.
ROUNDS, BLOCK, RATE = 8, 128, 1.0
#: The share of a bin that the first rounding allows to stay free.
FREE_ROOM = 0.0003
#: Words whose ids a worker keeps; beyond it the worker starts afresh.
KNOWN_WORDS = 800_000

Bin = tuple[tuple[int, int], ...]  # (length, copies)


#: How the tokenizer's pre-tokenizer cuts lower-case text.
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ASCII_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: The printable character that byte-level models use for each byte.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: Up to this character one lower-case letter stands for one upper-case letter in every library.
_SIMPLE = re.compile("[^\x00-\u012f]")


class _Known(dict):
    """A bounded cache of two generations: what is asked for again moves to the new one, and the old one goes as a whole."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        if (value := self.old.get(key)) is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


#: The settings of a tokenizer file under which a text's chunks between spaces can be looked up one by one.
_CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class _Whole:
    """Ids by the whole tokenizer, for files with other settings."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def text_ids(known: _Known | _Whole, text: str) -> bytes:
    """Little-endian 32-bit ids of a text."""
    if isinstance(known, _Whole):
        return known.ids(text)
    return b"".join(map(known.__getitem__, text.replace("\n", " ").split(" ")))


def chunk_ids(path: str) -> _Known | _Whole:
    """Little-endian 32-bit ids of each chunk between spaces. A tokenizer with the settings above drops white space and never
    joins across it, so a text's ids are its chunks' ids in a row. A chunk's pieces go to the tokenizer's model one by one; chunks
    with unusual characters, and all texts where the file has other settings, go through the whole tokenizer."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    if any(config.get(k) != v for k, v in _CHUNKED.items()) or config["model"]["type"] != "BPE" or any(not t["content"].startswith("<|") for t in config["added_tokens"]):
        return _Whole(tokenizer)
    model = tokenizer.model

    def piece_ids(piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_BYTES)
        return struct.pack(f"<{len(got := model.tokenize(piece))}I", *[t.id for t in got])

    pieces = _Known(piece_ids, KNOWN_WORDS // 2)

    def ids(chunk: str) -> bytes:
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return b"".join(map(pieces.__getitem__, _ASCII_CUT.findall(chunk.lower())))
        if not chunk.isprintable() or "<|" in chunk or _SIMPLE.search(chunk) or not unicodedata.is_normalized("NFC", chunk):
            return np.array(tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(pieces.__getitem__, _CUT.findall(chunk.lower())))

    return _Known(ids, KNOWN_WORDS // 2)


def token_pieces(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``id, piece, start, length, ids_crc32`` of every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, stop, names = chunk_ids(tokenizer_path), np.array([end], "<u4").tobytes(), [id, "piece", "start", "length", "ids_crc32"]
        for batch in batches:
            rows, at = [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                data = text_ids(known, value or "") + stop
                for piece, start in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[start : start + 4 * capacity]
                    at.append(k)
                    rows.append((piece, start // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], names)

    return docs.select(id, F.col(text).cast("string").alias("text_")).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def _as_bin(lengths: list[int]) -> Bin:
    kinds: dict[int, int] = {}
    for x in lengths:
        kinds[x] = kinds.get(x, 0) + 1
    return tuple(sorted(kinds.items(), reverse=True))


def _knapsack(price: dict[int, float], copies: dict[int, int], capacity: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Best total price of lengths, each taken ``copies`` times at most, within each capacity; the items (length, copies in
    halving parts) and where each was taken, to trace bins from."""
    items = []
    for x, left in copies.items():
        part = 1
        while left > 0:
            items.append((x, min(part, left)))
            left -= part
            part *= 2
    best, taken = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for row, (x, k) in zip(taken, items, strict=True):
        size = x * k
        if size <= capacity:
            other = best[: capacity + 1 - size] + price[x] * k
            np.greater(other, best[size:], out=row[size:])
            np.maximum(other, best[size:], out=best[size:])
    return best, items, taken


def _trace(items: list[tuple[int, int]], taken: np.ndarray, rooms: list[int]) -> list[dict[int, int]]:
    """The best contents of each room."""
    left, found = np.array(rooms, np.int64), [{} for _ in rooms]
    for k in range(len(items) - 1, -1, -1):
        x, n = items[k]
        who = np.flatnonzero(taken[k][left])
        left[who] -= x * n
        for w in who.tolist():
            found[w][x] = found[w].get(x, 0) + n
    return found


@dataclass
class Solution:
    """Fractional numbers of configurations that cover every count, in the order found, and a lower bound of their least sum."""

    amounts: dict[Bin, float]
    bound: float

    @property
    def value(self) -> float:
        return sum(self.amounts.values())


def solve_lp(counts: dict[int, int], capacity: int, rounds: int = ROUNDS, block: int = BLOCK, rate: float = RATE, seed: int = 11) -> Solution:
    """The configuration linear program by multiplicative weights with knapsack pricing.

    A length's price is its size times a weight that falls exponentially with how far the length is covered. Each of ``rounds``
    rounds covers a further equal share of every count: lengths that lack are priced in blocks of ``block`` (partial pricing),
    the block's best bins are added, each as far as none of its lengths is covered beyond the next round's share, and prices are
    made anew. The prices of each round's beginning, divided by their best bin over all lengths, are a dual solution: the best
    of them bounds the program from below."""
    rng = np.random.default_rng(seed)
    cover, amounts, bound = dict.fromkeys(counts, 0.0), {}, sum(x * n for x, n in counts.items()) / capacity
    most = {x: min(n, capacity // x) for x, n in sorted(counts.items(), reverse=True)}
    for r in range(1, rounds + 1):
        goal = {x: n * r / rounds for x, n in counts.items()}
        limit = {x: n * (r + 1) / rounds for x, n in counts.items()}
        price = {x: x * math.exp(-rate * (rounds * cover[x] / n - r + 1)) for x, n in counts.items()}
        if r > 1:
            bound = max(bound, sum(price[x] * n for x, n in counts.items()) / float(_knapsack(price, most, capacity)[0][-1]))
        lacking = [x for x in counts if cover[x] < goal[x] - 1e-9]
        while lacking:
            order = rng.permutation(len(lacking))
            for at in range(0, len(lacking), block):
                some = sorted((lacking[k] for k in order[at : at + block].tolist()), reverse=True)
                price = {x: x * math.exp(-rate * (rounds * cover[x] / counts[x] - r + 1)) for x in some}
                _, items, taken = _knapsack(price, {x: most[x] for x in some}, capacity)
                for x, found in zip(some, _trace(items, taken, [capacity - x for x in some]), strict=True):
                    lack = goal[x] - cover[x]
                    if lack <= 1e-9:
                        continue
                    found[x] = min(found.get(x, 0) + 1, most[x])
                    amount = min(lack / found[x], *((limit[y] - cover[y]) / k for y, k in found.items()))
                    if amount > 1e-9:
                        config = tuple(sorted(found.items(), reverse=True))
                        amounts[config] = amounts.get(config, 0.0) + amount
                        for y, k in found.items():
                            cover[y] += k * amount
            lacking = [x for x in lacking if cover[x] < goal[x] - 1e-9]
    # What is covered twice is taken back, the latest first.
    for config, amount in reversed(list(amounts.items())):
        back = min(amount, *((cover[x] - counts[x]) / k for x, k in config))
        if back > 0:
            amounts[config] = amount - back
            for x, k in config:
                cover[x] -= k * back
    return Solution({config: amount for config, amount in amounts.items() if amount > 1e-9}, bound)


def round_lp(solution: Solution, counts: dict[int, int], capacity: int, room: float = 1.0) -> dict[Bin, int]:
    """Whole numbers of configurations that use no length more often than ``counts`` has it: first the whole parts, then one more
    of those with remainders that still fit, fuller configurations first. Bins of which more than the share ``room`` stays free
    are left out."""
    left, plan = dict(counts), {}
    good = [(config, amount, free) for config, amount in solution.amounts.items() if (free := capacity - sum(x * k for x, k in config)) <= room * capacity]

    def place(config: Bin, times: float) -> None:
        whole = min(int(times), *(left[x] // k for x, k in config))
        if whole:
            plan[config] = plan.get(config, 0) + whole
            for x, k in config:
                left[x] -= whole * k

    for config, amount, _ in sorted(good, key=lambda c: (c[2], -c[1])):
        place(config, amount)
    for config, amount, _ in sorted(good, key=lambda c: c[2]):  # a stable order: equally full ones as they were found
        place(config, amount - int(amount) + 1 - 1e-9)
    return plan


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Bin]]:
    """Best-fit decreasing on a histogram: groups of (bins, contents)."""
    by_gap: dict[int, list[tuple[int, list[int]]]] = {}
    gaps: list[int] = []

    def put(gap: int, bins: int, inside: list[int]) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            insort(gaps, gap)
        by_gap[gap].append((bins, inside))

    for x in sorted(counts, reverse=True):
        left = counts[x]
        while left:
            k = bisect_left(gaps, x)
            if k == len(gaps):
                each = capacity // x
                if full := left // each:
                    put(capacity - each * x, full, [x] * each)
                if left % each:
                    put(capacity - left % each * x, 1, [x] * (left % each))
                break
            gap = gaps[k]
            bins, inside = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                del gaps[k]
            each = min(gap // x, left)
            used = min(bins, left // each)
            if bins > used:
                put(gap, bins - used, inside)
            put(gap - each * x, used, inside + [x] * each)
            left -= used * each
    return [(bins, _as_bin(inside)) for groups in by_gap.values() for bins, inside in groups]


@dataclass
class Plan:
    """Groups of (number of equal bins, contents) that hold every count exactly once; how many pieces the program's
    configurations hold and how many the best-fit rest; the first solution's value and lower bound."""

    groups: list[tuple[int, Bin]]
    by_program: int
    by_best_fit: int
    value: float
    bound: float

    @property
    def bins(self) -> int:
        return sum(n for n, _ in self.groups)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Solves the program, rounds it, and solves what is left again until it fits one bin or nothing is placed any more.
    Bins with free room are left for later solutions, which may do better; each allows four times the room."""
    left = {x: n for x, n in counts.items() if n > 0}
    plan: dict[Bin, int] = {}
    first: Solution | None = None
    total, room = sum(left.values()), FREE_ROOM
    while sum(x * n for x, n in left.items()) > capacity or left and first is None:
        solution = solve_lp(left, capacity)
        first = first or solution
        whole = round_lp(solution, left, capacity, room)
        for config, n in whole.items():
            plan[config] = plan.get(config, 0) + n
            for x, k in config:
                left[x] -= n * k
        left = {x: n for x, n in left.items() if n}
        if not whole and room >= 1:
            break
        room *= 4
    rest = sum(left.values())
    return Plan([(n, config) for config, n in plan.items()] + best_fit(left, capacity), total - rest, rest, first.value if first else 0.0, first.bound if first else 0.0)


def _places(plan: list[tuple[int, Bin]], capacity: int) -> dict[str, np.ndarray]:
    """For each run of ranks of one length: where it starts, its first sequence, copies in a sequence and first offset."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, inside in sorted(plan, key=lambda p: (p[1], p[0])):
        base = 0
        for x, copies in inside:
            at = used.get(x, 0)
            rows.append((x, at, sequence, copies, base))
            used[x] = at + bins * copies
            base += x * copies
        sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return {"key": columns[0] << 48 | columns[1], "rank": columns[1], "sequence": columns[2], "copies": columns[3], "base": columns[4]}


def pack(pieces: DataFrame, id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (``id, piece, start, length, ids_crc32``, materialised) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(id, "piece", "ids_crc32"), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # at most capacity x SALTS rows
    counts: dict[int, int] = {}
    ahead: dict[int, int] = {}
    for r in sorted(sums):
        ahead[r["length"] * SALTS + r["salt"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    places = _places(plan_bins(counts, capacity).groups, capacity)
    keys = np.array(sorted(ahead), np.int64)
    shared = spark.sparkContext.broadcast((places, keys, np.array([ahead[k] for k in keys.tolist()], np.int64)))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(id, "piece", "ids_crc32")).cast("long") - 1)
    names = [id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, salts, first = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5, 6))
            rank = rank + first[np.searchsorted(salts, length * SALTS + salt)]
            at = np.searchsorted(where["key"], length << 48 | rank, "right") - 1
            k = rank - where["rank"][at]
            copies = where["copies"][at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(where["sequence"][at] + k // copies), pa.array(where["base"][at] + k % copies * length)], names)

    kind = pieces.schema[id].dataType.simpleString()
    return ranked.select(id, "piece", "start", "length", "ids_crc32", "salt", "rank").mapInArrow(place, f"`{id}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(token_pieces(docs, tokenizer_path, id, text, capacity), "pieces"), id, capacity)
