"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words' shapes (letter case, digits, punctuation, with runs collapsed), the words themselves, and whether
a word repeats the one before; terms are hashed, weighted by inverse document frequency and mapped to the leading singular
vectors of the labelled sample. The labelled vectors are broadcast (their number is bounded), every document's vector is
compared with all of them by exact blocked cosine products, and the nearest ones' labels are weighted by similarity.

The labelled sample takes up to ``PER_CLASS`` rows of each label, by the order of a hash of the id, and only ids whose
crc32 modulo ``FOLDS`` isn't 0; votes are weighted back to the labels' frequencies. Ids, languages, sources and labels are no
inputs of a score. Null and empty texts have no terms; they and texts unlike all neighbours get the labelled share of 1.
Whole texts are read. Labels that are null and ids with both labels are left out, of a labelled id's texts the least is taken, and without labelled rows of both kinds every score is the share of 1
(0.5 if there is none). Repeated rows get equal results; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Rows of each label that the model is fitted on at most, hashed terms, dimensions kept, neighbours, threshold, folds.
PER_CLASS, TERMS, RANK, NEIGHBOURS, THRESHOLD, FOLDS = 1000, 2048, 48, 25, 0.3, 5
#: Words whose terms a worker keeps, and documents that are compared at once.
KNOWN_WORDS, BLOCK = 200_000, 512
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class _Terms(dict):
    """The two term numbers of a word: shape and identity; the first numbers are kept for repeats and the length."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_SHAPE))
        half = TERMS // 2
        found = 8 + xxhash.xxh32_intdigest(shape, 1) % (half - 8), half + xxhash.xxh32_intdigest(word, 2) % half
        if len(word) <= 64:
            self[word] = found
        return found


def term_vector(text: str | None, known: _Terms) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    counts = np.zeros(TERMS, np.float32)
    if words:
        found = np.fromiter((t for w in words for t in known[w]), np.int64, 2 * len(words))
        counts += np.bincount(found, minlength=TERMS)
        counts[0] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        # Shares, so that a text's length matters little; the shapes count more than the many words.
        counts *= np.float32(100 / len(words))
        counts[TERMS // 2 :] *= np.float32(0.25)
        np.log1p(counts, out=counts)
    return counts


def _normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Voter:
    """The fitted space, the labelled vectors in it, and the vote."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, shares: dict[int, float], rank: int = RANK, neighbours: int = NEIGHBOURS):
        self.share = shares.get(1, 0.0) / sum(shares.values()) if shares else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = _normal(counts * self.idf)
        # Randomised range finder with two power steps, from a fixed seed.
        rank = max(1, min(rank, len(counts), counts.shape[1])) if len(counts) else 1
        probe = np.random.default_rng(7).standard_normal((counts.shape[1], rank + 16)).astype(np.float32)
        q = np.linalg.qr(x @ probe)[0] if len(counts) else np.zeros((0, 1), np.float32)
        for _ in range(2):
            q = np.linalg.qr(x @ (x.T @ q))[0] if len(counts) else q
        self.basis = np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.copy() if len(counts) else np.zeros((TERMS, 1), np.float32)
        self.vectors, self.labels, self.neighbours = _normal(x @ self.basis), labels.astype(np.float32), min(neighbours, len(counts))
        weight = {c: shares.get(c, 0.0) / max(1, int((labels == c).sum())) for c in (0, 1)}
        self.weights = np.where(labels == 1, weight[1], weight[0]).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        n = len(counts)
        if not self.neighbours or not n:
            return np.full(n, self.share)
        near = _normal((counts * self.idf) @ self.basis) @ self.vectors.T
        top = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        similar = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 8 * self.weights[top]
        total = similar.sum(axis=1)
        voted = (similar * self.labels[top]).sum(axis=1)
        # A pinch of the labelled share decides where no neighbour is similar.
        pinch = 1e-3 * float(self.weights.mean())
        return np.clip((voted + pinch * self.share) / (total + pinch), 0, 1).astype(np.float64)


def held_out(id):
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Voter:
    """The model of the labelled rows in ``docs``; at most ``2 * per_class`` term vectors come to the driver."""
    known = labels.select(F.col(id).alias("i"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    shares = {r["y"]: float(r["n"]) for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Terms()
        for batch in batches:
            rows = [term_vector(t, terms).astype(np.float16).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["i", "y", "x"])

    sample = docs.select(F.col(id).alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(picked), "i").groupBy("i", "y").agg(F.min("t").alias("t"))
    kind = docs.schema[id].dataType.simpleString()
    rows = sample.mapInArrow(vectors, f"i {kind}, y int, x binary").orderBy("i").collect()
    x = np.array([np.frombuffer(r["x"], np.float16) for r in rows], np.float32).reshape(-1, TERMS)
    return Voter(x, np.array([r["y"] for r in rows], np.int64), shares)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``id, held_out, score, predicted`` of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id, text, label))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, voter = _Terms(), model.value
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = [voter.score(np.array([term_vector(t, terms) for t in texts[k : k + BLOCK]])) for k in range(0, len(texts), BLOCK)]
            scores = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], [id, "held_out", "score", "predicted"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(id, held_out(F.col(id)).alias("held_out"), F.col(text).cast("string").alias("text_")).mapInArrow(score, f"`{id}` {kind}, held_out boolean, score double, predicted int")
