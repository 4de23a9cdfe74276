"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

Words are lower-cased ([A-Z] only) runs of digits, a-z and characters beyond ASCII. A test item's windows are its runs of
``size`` words, or all its words if it has fewer. The corpus frequency of every test term is counted; each window keeps the
position of its rarest term; the postings ``(term, document, position)`` of those terms are joined with the windows by term, which
gives offset-adjusted places; the window's other words are then compared at their offsets in the document, all at once by 128
bits of hashes of the run of words. Windows with a term that the corpus lacks end at the counts.

Null and empty texts have no words and no matches; texts are read whole; rows of one id and text get equal results, rows of one
id and different texts their own; test rows of one item id (null too) and different texts are looked up each by itself and named as
one item, a null id isn't named; an empty table gives no matches; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, row_key, small

WINDOW = 10
#: Rows up to which a table made from the benchmark is broadcast; beyond it, it is joined by shuffles.
BROADCAST_ROWS = 400_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of ``text``; an empty array for null."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BREAKS), "")


def _prints(words: Column) -> tuple[Column, Column]:
    """128 bits that stand for a run of words."""
    return F.xxhash64(words), F.xxhash64(F.lit(1), words)


def _anchors(items: DataFrame, size: int, docs_words: DataFrame) -> DataFrame:
    """``term, offset, item_id, n, a, b, g``: each item's windows, looked up by their rarest word (then the first) at ``offset``."""
    terms = materialise(items.select(F.explode("w").alias("term")).distinct(), "test-terms")
    hinted, _ = small(terms, BROADCAST_ROWS)
    counts = docs_words.select(F.explode("w").alias("term")).join(hinted, "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = materialise(counts, "test-term-counts")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - size))
    windows = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, size))).alias("g")).distinct()
    placed = windows.select("item_id", "g", F.posexplode("g").alias("offset", "term")).join(small(counts, BROADCAST_ROWS)[0], "term", "left")
    rarest = placed.groupBy("item_id", "g").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term")).alias("r")).where("r.n > 0")
    a, b = _prints(F.col("g"))
    return rarest.select("r.term", "r.offset", "item_id", F.size("g").alias("n"), a.alias("a"), b.alias("b"), "g")


def _matches(docs: DataFrame, items: DataFrame, size: int, slack: int, how: str = "left") -> DataFrame:
    """``docs`` (``id_, key_, text_``; with ``how`` "inner" only those that a rarest term is in) with ``n_words`` and ``hits``: structs of item_id, at (first word) and n (words)."""
    with_words = docs.select("id_", "key_", words(F.col("text_")).alias("w"))
    items = items.where(F.size("w") > 0)
    anchors = _anchors(items, size, with_words)
    anchors = materialise(anchors if slack else anchors.drop("g"), "anchors")
    hinted, _ = small(anchors, BROADCAST_ROWS)
    postings = with_words.select("id_", "key_", F.posexplode("w").alias("pos", "term"))
    # A place is some 40 bytes: the window is known by its prints, and its words stay where they are.
    place = F.struct("item_id", (F.col("pos") - F.col("offset")).alias("at"), "n", *(["g"] if slack else ["a", "b"]))
    found = postings.join(hinted, "term").where("pos >= offset" if not slack else "true").groupBy("id_", "key_").agg(F.collect_set(place).alias("places"))

    def hit(w: Column, place: Column) -> Column:
        begin, n = place["at"], place["n"]
        if not slack:
            a, b = _prints(F.slice(w, begin + 1, n))
            return F.when((a == place["a"]) & (b == place["b"]), F.struct(place["item_id"].alias("item_id"), begin.alias("at"), n.alias("n")))
        low = F.greatest(begin - slack, F.lit(0))
        high = F.least(begin + n + slack, F.size(w))
        near = F.slice(w, low + 1, F.greatest(high - low, F.lit(0)))
        return F.when(F.size(F.array_except(place["g"], near)) == 0, F.struct(place["item_id"].alias("item_id"), low.alias("at"), (high - low).alias("n")))

    texts = docs.withColumnRenamed("id_", "d_").withColumnRenamed("key_", "k_")
    joined = texts.join(found, F.col("d_").eqNullSafe(F.col("id_")) & (F.col("k_") == F.col("key_")), how)
    joined = joined.select("d_", "places", words(F.col("text_")).alias("w"))
    # The words are bound to a lambda's variable, else Spark may split the text again for every place.
    hits = F.transform(F.array(F.struct("w", "places")), lambda z: F.array_compact(F.transform(z["places"], lambda p: hit(z["w"], p))))[0]
    return joined.select(F.col("d_").alias("id_"), F.size("w").alias("n_words"), F.when(F.col("places").isNotNull(), F.array_distinct(hits)).alias("hits"))


def _items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """``item_id, w``; an id's texts each have their row."""
    return benchmark.select(F.col(item).alias("item_id"), words(F.col(text).cast("string")).alias("w"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: ``id, n_words, n_hit`` (words inside an occurrence of a window), ``n_items, items_sha256,
    contaminated`` and ``hits`` (the occurrences)."""
    plain = docs.select(F.col(id).alias("id_"), row_key(F.col(text)).alias("key_"), F.col(text).cast("string").alias("text_"))
    items = _items(benchmark, item, item_text)
    found = _matches(plain, items, size, 0)
    hits = F.coalesce("hits", F.array().cast(found.schema["hits"].dataType))
    found = found.select("id_", "n_words", hits.alias("hits"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["n"] - 1)))))
    names = F.array_sort(F.array_distinct(F.array_compact(F.transform("hits", lambda h: h["item_id"].cast("string")))))
    found = found.withColumn("n_hit", hit.cast("long")).withColumn("names", names)
    return found.select(F.col("id_").alias(id), F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "hits")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = WINDOW, slack: int = 5) -> DataFrame:
    """``id, item_id, at, n``: stretches of a document, ``slack`` words wider on either side than a window aligned by its rarest
    word, that hold all the window's words in any order. Rows without an id or matches give none."""
    plain = docs.select(F.col(id).alias("id_"), row_key(F.col(text)).alias("key_"), F.col(text).cast("string").alias("text_"))
    found = _matches(plain, _items(benchmark, item, item_text), size, slack, "inner")
    return found.where("hits is not null").select(F.col("id_").alias(id), F.explode("hits").alias("h")).select(id, "h.item_id", "h.at", "h.n").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, with their columns."""
    key = row_key(F.col(text))
    plain = docs.select(F.col(id).alias("id_"), key.alias("key_"), F.col(text).cast("string").alias("text_"))
    hit = _hit_keys(plain, _items(benchmark, "item_id", "text"), size)
    return docs.join(hit, docs[id].eqNullSafe(hit["id_"]) & (row_key(docs[text]) == hit["key_"]), "left_anti")


def _hit_keys(plain: DataFrame, items: DataFrame, size: int) -> DataFrame:
    with_key = plain.withColumn("id_", F.struct("id_", "key_"))
    found = _matches(with_key, items, size, 0, "inner").where(F.size("hits") > 0)
    return materialise(found.select("id_.id_", "id_.key_").distinct(), "contaminated")
