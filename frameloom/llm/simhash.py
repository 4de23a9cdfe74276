"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared with numpy exclusive-or and bit counts, tile by tile. A tile holds fingerprints whose four 16-bit
quarters have the same population counts; two fingerprints at distance d differ by at most d in the sum of those counts, so
tile pairs that differ by more than the radius are skipped and no link is lost. Within a tile pair only a spanning forest of
the links leaves the task, which keeps the components and stays linear in the rows of the tiles.

``keep_one`` is for texts that were edited, not only copied: it links texts by ``SKETCH_WORDS`` x 64 bits of five-word shingles
within the distance that a similarity of 0.8 has (Jaccard's, which is a cosine of 0.89; the bits differ with the angle's share of
pi: 19.4 of 128), plus a standard deviation. It compares the same way, in larger tiles by population count; at that radius few
tile pairs are skipped, so the work is quadratic in the different fingerprints.

Null and empty texts have fingerprint 0 and link like any other; texts are read whole; equal fingerprints are one node, so
copies cost nothing; repeated rows each keep their row; a null id is never a component's name unless no member has one; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise, row_key
from .components import connected_components

RADIUS, SHINGLE, SEED, TILE = 3, 3, 42, 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 20
#: ``keep_one``: words of a shingle, 64-bit words of a fingerprint, differing bits, population counts and rows of a tile.
KEEP_SHINGLE, SKETCH_WORDS, KEEP_RADIUS, COUNTS, KEEP_TILE = 5, 2, 24, 8, 32768


def _shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, some at a time; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    for i in range(0, n, 65536):
        j = min(n, i + 65536)
        spans = zip(starts[i:j].tolist(), ends[size - 1 + i : size - 1 + j].tolist() if len(words) >= size else [len(joined)], strict=True)
        yield np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def _majority(blocks: Iterator[np.ndarray], bits: int) -> np.ndarray:
    """The bits (as unsigned 64-bit words) that more than half of the rows have; ``blocks`` hold rows of ``bits`` bits."""
    ones, n = np.zeros(bits, np.int64), 0
    for block in blocks:
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, bits // 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, as an unsigned integer."""
    return int(_majority(_shingle_hashes(text, size), 64)[0])


def sketch(text: str | None, size: int = KEEP_SHINGLE, words: int = SKETCH_WORDS) -> bytes:
    """``words`` x 64 bits; each further 64 come from the shingles' hashes by a mixing of their own."""

    def rows(h: np.ndarray) -> np.ndarray:
        found = [h]
        for k in range(1, words):
            x = (h + np.uint64((0x9E3779B97F4A7C15 * k) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            found.append(x ^ (x >> np.uint64(29)))
        return np.stack(found, axis=1)

    return _majority(map(rows, _shingle_hashes(text, size)), 64 * words).tobytes()


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``fp`` (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id, "fp"])

    return docs.select(id, F.col(text).cast("string").alias("text_")).mapInArrow(run, f"`{id}` {docs.schema[id].dataType.simpleString()}, fp long")


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links i-j; a label is the smallest node of its group."""
    while True:
        a, b = labels[i], labels[j]
        open_ = a != b
        if not open_.any():
            return labels
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (or within one, if ``a is b``), as places in both tiles' rows. A tile is
    an array of 64-bit words, one or a row of them for each fingerprint."""
    shift, step = 0 if a is b else len(a), max(1, _CHUNK // max(1, len(b)))
    one, other = (x.reshape(len(x), -1).T for x in (a, b))
    labels = np.arange(len(a) if a is b else len(a) + len(b))
    for k in range(0, len(a), step):
        distance = np.bitwise_count(one[0][k : k + step, None] ^ other[0][None, :])
        for x, y in zip(one[1:], other[1:], strict=True):
            distance += np.bitwise_count(x[k : k + step, None] ^ y[None, :])
        i, j = np.nonzero(distance <= radius)
        labels = _merge(labels, i + k, j + shift)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    return labels[linked], linked


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``u, v`` between the values of ``distinct.fp`` that have the components of all links within ``radius`` bits."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    cells = distinct.select("fp", *(c.cast("int").alias(f"q{i}") for i, c in enumerate(quarter)))
    keys = ["q0", "q1", "q2", "q3"]
    # At most 17**4 cells, whatever the input.
    many = F.broadcast(cells.groupBy(keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = cells.join(many, keys).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).groupBy(*keys, "part").agg(F.collect_list("fp").alias("fps"))
    tiles = materialise(tiles, "tiles")
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    steps = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(d))) for d in near))
    left = tiles.withColumn("d", F.explode(steps)).select(*((F.col(f"q{i}") + F.col(f"d.d{i}")).alias(f"q{i}") for i in range(4)), F.col("part").alias("part_a"), F.col("fps").alias("a"), (sum(F.abs(f"d.d{i}") for i in range(4)) == 0).alias("same"))
    index = tiles.select(*keys).distinct()
    pairs = left.join(index, keys, "left_semi").join(tiles.withColumnRenamed("fps", "b").withColumnRenamed("part", "part_b"), keys).where(~F.col("same") | (F.col("part_a") <= F.col("part_b")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            flags = batch.column(2).to_pylist()
            for k, one in enumerate(flags):
                a = batch.column(0)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                b = a if one else batch.column(1)[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
                u, v = tile_links(a, b, radius)
                nodes = (a if one else np.concatenate((a, b))).view(np.int64)
                us.append(nodes[u])
                vs.append(nodes[v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    return pairs.select("a", "b", (F.col("same") & (F.col("part_a") == F.col("part_b"))).alias("one")).mapInArrow(compare, "u long, v long")


def simhash_components(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` (the smallest id reachable over links) of every row."""
    prints = materialise(fingerprints(docs, id, text), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(id).alias("least"))
    parts = connected_components(links(distinct.select("fp"), radius))
    joined = distinct.join(parts, distinct.fp == parts.node, "inner").select("fp", "least", "component")
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    better = joined.join(named, "component").select("fp", "component_id")
    # Written, so that the join below is a plain one, which Spark splits where a fingerprint has very many rows.
    names = materialise(distinct.join(better, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "names")
    return prints.join(names, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sketches(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_, key_`` (which tells texts of one id apart), ``fp`` (the sketch's bytes) and ``ones`` (its population count) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [sketch(t) for t in batch.column(2).to_pylist()]
            ones = [int(np.bitwise_count(np.frombuffer(x, np.uint64)).sum()) for x in fp]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.binary()), pa.array(ones, pa.int32())], ["id_", "key_", "fp", "ones"])

    plain = docs.select(F.col(id).alias("id_"), row_key(F.col(text).cast("string")).alias("key_"), F.col(text).cast("string").alias("text_"))
    return plain.mapInArrow(run, f"id_ {docs.schema[id].dataType.simpleString()}, key_ long, fp binary, ones int")


def sketch_links(distinct: DataFrame, radius: int = KEEP_RADIUS, tile: int = KEEP_TILE) -> DataFrame:
    """Links ``u, v`` between the values of ``distinct.fp`` (with their ``ones``) that have the components of all links within
    ``radius`` bits. A cell holds ``COUNTS`` population counts, and cells further apart than the radius aren't compared."""
    cells = distinct.select("fp", (F.col("ones") / COUNTS).cast("int").alias("cell"))
    many = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = cells.join(many, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).groupBy("cell", "part").agg(F.collect_list("fp").alias("fps"))
    tiles = materialise(tiles, "sketch-tiles")
    reach = (radius + COUNTS - 1) // COUNTS
    steps = F.explode(F.array(*map(F.lit, range(reach + 1)))).alias("step")
    left = tiles.select((F.col("cell")).alias("cell_a"), F.col("part").alias("part_a"), F.col("fps").alias("a"), steps).withColumn("cell", F.col("cell_a") + F.col("step"))
    right = tiles.select("cell", F.col("part").alias("part_b"), F.col("fps").alias("b"))
    pairs = left.join(right, "cell").where((F.col("step") > 0) | (F.col("part_a") <= F.col("part_b")))
    one = (F.col("step") == 0) & (F.col("part_a") == F.col("part_b"))
    # Each pair of tiles is some work, so they are dealt out evenly.
    pairs = pairs.select("a", "b", one.alias("one"), "cell_a", "part_a", "cell", "part_b").repartition("cell_a", "part_a", "cell", "part_b").select("a", "b", "one")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, same in enumerate(batch.column(2).to_pylist()):
                names = batch.column(0)[k].as_py()
                a = b = np.frombuffer(b"".join(names), np.uint64).reshape(len(names), -1)
                if not same:
                    more = batch.column(1)[k].as_py()
                    b = np.frombuffer(b"".join(more), np.uint64).reshape(len(more), -1)
                    names = names + more
                u, v = tile_links(a, b, radius)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in u.tolist()], pa.binary()), pa.array([names[x] for x in v.tolist()], pa.binary())], ["u", "v"])

    return pairs.mapInArrow(compare, "u binary, v binary")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", radius: int = KEEP_RADIUS) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component: one document of each group of near copies stays. Repeated
    rows stay together; rows without an id stay only where their whole group has none."""
    prints = materialise(sketches(docs, id, text), "sketches")
    distinct = prints.groupBy("fp", "ones").agg(F.min("id_").alias("least"))
    parts = connected_components(sketch_links(distinct.select("fp", "ones"), radius))
    joined = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = joined.groupBy("component").agg(F.min("least").alias("kept_id_"))
    names = materialise(joined.join(named, "component").select("fp", "kept_id_"), "names")
    kept = prints.join(names, "fp").where(F.col("id_").eqNullSafe(F.col("kept_id_"))).select("id_", "key_").distinct()
    same = docs[id].eqNullSafe(F.col("kept.id_")) & (row_key(docs[text].cast("string")) == F.col("kept.key_"))
    return docs.join(materialise(kept, "kept").alias("kept"), same, "left_semi")
