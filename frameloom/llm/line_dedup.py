"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Two lines are near when their trimmed texts differ by at most t insertions, deletions or substitutions, t being ``edits`` or one
for each ``chars_per_edit`` characters of the shorter line, whichever is less. A line is dropped if an equal or near line comes
earlier in the order of (id, line number); "earlier" counts dropped lines too, so the result doesn't depend on the order of
work. A line of n characters is cut into t + 1 segments, one of which t edits leave whole, and lines of n to n + t characters
are probed at the places where that segment can be in them, if as many edits as segments lie before it (multi-match aware, as
in Pass-Join by Li, Deng, Wang and Feng, 2011). Pairs are verified by a banded bit-parallel edit distance of what the shared
segment leaves of them.

Segment keys are counted first; only keys that two different lines share are looked at again. The lines of a key that more
than ``bucket`` lines share aren't paired up. Each is compared with the key's ``PIVOTS`` earliest lines (by slots of a hash);
lines that are near one are decided. For the others the key is extended by a segment of what is left of the lines, by the same
join again, until groups are small, all pairs left are no more than ``SIGNED_PAIRS`` for each row of the first level, or a level
hasn't made them fewer. A line keeps its part through the levels: the shorter one of a pair, or the longer one by so many characters. At the end lines of a
group differ in so few characters that they are all near its earliest line. Pairs left are told apart by signatures, two longs
of parities that few edits change little, before their texts are read. Lines that few undecided ones share a key with are
compared with those only. With one edit work stays linear in a group's lines. With more it doesn't where many lines differ from
one text, each at a place of its own: every key without both places holds such a pair, so longer keys don't tell them apart.

With lines shorter than ``chars_per_edit`` no edit is allowed (one edit tells "Page 1" from "Page 2"); ``chars_per_edit`` 0
allows all edits everywhere. Blank lines always stay. Null texts stay null, and a text that loses all lines becomes empty. Rows
of one id and text count as one occurrence and get equal results; a null id comes before all others; lines may be of any
length, the work is linear in it; lines are told apart by 128 bits of hashes; an empty table gives an empty result; other columns
are kept by ``drop_lines`` and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialise, row_key, small

#: Edits allowed at most, and characters of the shorter line for each of them.
EDITS, CHARS_PER_EDIT = 2, 20
#: Lines of a key that are paired up, and earliest lines that those of larger groups are compared with.
MAX_BUCKET, PIVOTS = 32, 4
#: Comparisons of signatures, for each row of the first level, up to which the lines of larger groups are compared with each other.
SIGNED_PAIRS = 256
#: What a level must leave of the pairs at most for another one to follow.
LESS = 0.75
#: Extensions of a key after which undecided lines are compared with all that are left of their group.
MAX_LEVELS = 16
#: Rows (of two longs) up to which the shared segment keys are broadcast.
BROADCAST_ROWS = 1_000_000
#: Steps by which common ends are found in generated code, for rests below twice the first.
_STEPS = tuple(1 << k for k in range(10, -1, -1))


def edit_distance(short: Column, long: Column, edits: int) -> Column:
    """The edit distance of two strings, the second as long as the first or up to ``edits`` characters longer, where it is at
    most ``edits``; otherwise some number above.

    Columns of the banded matrix are kept as bit vectors over the band's ``2 * edits + 1`` diagonals (Hyyr\u00f6, 2003): the match mask
    of a character holds a bit for each diagonal, and additions and shifts carry the vertical differences on."""
    return F.transform(F.array(F.struct(F.split(short, "").alias("r"), F.split(long, "").alias("s"))), lambda pair: _banded(pair, edits))[0]


def _banded(pair: Column, edits: int) -> Column:
    r, s = pair["r"], pair["s"]
    m, n, bits = F.size(r), F.size(s), 2 * edits + 1
    full = F.lit((1 << bits) - 1)

    def step(state: Column, j: Column) -> Column:
        c = F.get(s, j)
        # Bit b stands for the pattern row j - edits + b.
        match = sum((F.when(F.get(r, j + (b - edits)) == c, 1 << b).otherwise(0) for b in range(bits)), F.lit(0))
        vp, vn = state["vp"], state["vn"]
        d0 = ((((match.bitwiseAND(vp)) + vp).bitwiseXOR(vp)).bitwiseOR(match).bitwiseOR(vn)).bitwiseAND(full)
        hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(full))
        hn = d0.bitwiseAND(vp)
        down = F.shiftright(d0, 1)
        # The cost follows the middle diagonal to the last row, and then the row to the last column.
        diagonal = 1 - F.shiftright(d0, edits).bitwiseAND(F.lit(1))
        row = F.lit(0)
        for past in range(edits):
            bit = F.lit(1 << (edits - 1 - past))
            row = F.when(j - m == past, F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)).otherwise(row)
        cost = state["cost"] + F.when(j < m, diagonal).otherwise(row)
        return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"), down.bitwiseAND(hp).alias("vn"), cost.alias("cost"))

    # Before the first column the differences grow downwards from the middle diagonal on.
    start = F.struct(F.lit(((1 << bits) - 1) & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(0).alias("cost"))
    # Splitting an empty string gives one empty string, whatever the pattern.
    return F.when((n == 0) | (s[0] == ""), F.lit(0)).when(r[0] == "", n).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step, lambda x: x["cost"]))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _common(a: Column, b: Column, side: Callable[[Column, Column], Column]) -> Column:
    """The length of the longest common beginning or end, by bisection; ``side`` takes so many characters of a text."""
    most = F.least(F.char_length(a), F.char_length(b))

    def half(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"] + 1, 1)
        same = side(a, middle) == side(b, middle)
        return F.struct(F.when(same, middle).otherwise(state["low"]).alias("low"), F.when(same, state["high"]).otherwise(F.greatest(middle - 1, state["low"])).alias("high"))

    steps = F.ceil(F.log2(most + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), F.struct(F.lit(0).alias("low"), most.alias("high")), half, lambda x: x["low"])


def _unequal(pair: Column) -> Column:
    """``a, b`` without their common beginning and, after that, their common end, which the edit distance doesn't need."""

    def begin(p: Column) -> Column:
        n = _common(p["a"], p["b"], lambda x, k: F.substring(x, F.lit(1), k))
        return _bound(n, lambda k: F.struct(F.substring(p["a"], k + 1, F.char_length(p["a"])).alias("a"), F.substring(p["b"], k + 1, F.char_length(p["b"])).alias("b")))

    def end(p: Column) -> Column:
        n = _common(p["a"], p["b"], F.right)
        return _bound(n, lambda k: F.struct(F.substring(p["a"], F.lit(1), F.char_length(p["a"]) - k).alias("a"), F.substring(p["b"], F.lit(1), F.char_length(p["b"]) - k).alias("b")))

    return _bound(_bound(pair, begin), end)


def _lines(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``id_, key_, no_, line, h, g``: the trimmed lines that aren't blank, with their place and 128 bits that stand for them."""
    base = docs.select(F.col(id).alias("id_"), row_key(F.col(text).cast("string")).alias("key_"), F.posexplode(F.split(F.col(text).cast("string"), "\n")).alias("no_", "raw"))
    lines = base.select("id_", "key_", "no_", _trim(F.col("raw")).alias("line")).where("line <> ''")
    return lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\v\f"))


def _segments(rows: DataFrame, text: str, edits: int, allowed: Callable[[Column], Column], role: str | None = None) -> DataFrame:
    """``rows`` with ``k``: struct of ``key, at, size, t, longer``, a row for each of a text's segments as the shorter one of a
    pair, and for each place where a segment of a shorter one, by ``longer`` characters, can be in it; ``allowed`` gives the edits
    for a shorter text's length. Only the places of ``role`` characters more, where that column is given.

    Each row is first dealt out over a fixed table of (t, how much longer, segment, shift), so that one short expression makes
    the keys: a long one would be too much code for the JVM to compile. Where all characters are of one byte, a segment's place
    is known without reading what stands before it; its bytes are the same either way."""
    table = [
        (t, longer, i, shift)
        for t in range(1, edits + 1)
        for longer in range(t + 1)
        for i in range(t + 1)
        for shift in range(max(-i, longer - (t - i)), min(i, longer + (t - i)) + 1)
    ]
    q = F.explode(F.array(*(F.struct(*(F.lit(x).alias(name) for x, name in zip(row, "tlis", strict=True))) for row in table)))
    rows = rows.withColumn("n_", F.char_length(text)).withColumn("plain_", F.octet_length(text) == F.col("n_")).withColumn("q_", q)
    m, t = F.col("n_") - F.col("q_.l"), F.col("q_.t")  # the shorter text's length
    begin, end = (F.expr(f"CAST(CAST(n_ - q_.l AS BIGINT) * {k} div (q_.t + 1) AS INT)") for k in ("q_.i", "(q_.i + 1)"))
    fits = (m >= 0) & (allowed(m) == t)
    rows = rows.where(fits if role is None else fits & (F.col("q_.l") == F.col(role))).withColumn("size_", end - begin).withColumn("at_", begin + F.col("q_.s"))
    rows = rows.where("at_ >= 0 AND at_ + size_ <= n_")
    part = F.when(F.col("plain_"), F.substring(F.col(text).cast("binary"), F.col("at_") + 1, F.col("size_"))).otherwise(F.substring(text, F.col("at_") + 1, F.col("size_")).cast("binary"))
    key = F.xxhash64("q_.i", "q_.t", m, part)
    return rows.withColumn("k", F.struct(key.alias("key"), F.col("at_").alias("at"), F.col("size_").alias("size"), F.col("q_.t").alias("t"), F.col("q_.l").alias("longer"))).drop("n_", "plain_", "q_", "size_", "at_")


def _without(text: Column, at: Column, size: Column, edits: int) -> Column:
    """The text with a gap in place of a segment. A gap is ``edits`` + 1 line breaks, which lines don't hold: an alignment within
    ``edits`` matches gap with gap, so the distance of two rests bounds that of their lines."""
    return F.concat(F.substring(text, F.lit(1), at), F.lit("\n" * (edits + 1)), F.substring(text, at + size + 1, F.char_length(text)))


def _near(pairs: DataFrame, edits: int) -> DataFrame:
    """``h, g`` of ``pairs(h, g, r, s, t)``, r not longer than s, that are within ``t`` edits."""
    n = F.char_length("r")
    # A part of the rest is whole again: most false pairs end here.
    again = F.lit(False)
    for t in range(1, edits + 1):
        for i in range(t + 1):
            begin, end = ((n * k / (t + 1)).cast("int") for k in (i, i + 1))
            again |= (F.col("t") == t) & F.contains("s", F.substring("r", begin + 1, end - begin))
    p = pairs.where(F.char_length("s") - n <= F.col("t")).where(again)
    # Common ends don't matter. They are found in UTF-32, where places are known, by halving steps.
    p = p.withColumn("r_", F.encode("r", "UTF-32")).withColumn("s_", F.encode("s", "UTF-32"))
    p = p.withColumn("n_", F.shiftright(F.octet_length("r_"), 2)).withColumn("d_", F.shiftright(F.octet_length("s_"), 2) - F.col("n_")).withColumn("low", F.lit(0)).withColumn("high", F.lit(0))
    for step in _STEPS:
        begin = F.col("low")
        same = (begin + step <= F.col("n_")) & (F.substring("r_", 4 * begin + 1, F.lit(4 * step)) == F.substring("s_", 4 * begin + 1, F.lit(4 * step)))
        p = p.withColumn("low", begin + F.when(same, step).otherwise(0))
    for step in _STEPS:
        end = F.col("n_") - F.col("high") - step
        same = (end >= F.col("low")) & (F.substring("r_", 4 * end + 1, F.lit(4 * step)) == F.substring("s_", 4 * (end + F.col("d_")) + 1, F.lit(4 * step)))
        p = p.withColumn("high", F.col("high") + F.when(same, step).otherwise(0))
    left = F.col("n_") - F.col("low") - F.col("high")
    # Exploding one struct keeps the filters below from being pushed into the steps, whose columns would be inlined many times.
    middle = F.struct(F.substring("r", F.col("low") + 1, left).alias("a"), F.substring("s", F.col("low") + 1, left + F.col("d_")).alias("b"))
    p = p.select("h", "g", "t", F.explode(F.array(middle)).alias("z")).select("h", "g", "t", "z.a", "z.b")
    # Longer rests may have more in common.
    longer = F.char_length("a") >= _STEPS[0]
    p = p.select("h", "g", "t", F.explode(F.array(F.when(longer, _unequal(F.struct("a", "b"))).otherwise(F.struct("a", "b")))).alias("z")).select("h", "g", "t", "z.a", "z.b")
    # An edit stands at either end then, and of edits - 1 parts between them one is whole.
    n = F.char_length("a")
    whole = n <= 2
    for k in range(edits - 1):
        begin, end = (((n - 2) * i / (edits - 1)).cast("int") for i in (k, k + 1))
        whole |= F.contains("b", F.substring("a", begin + 2, end - begin))
    p = p.where(whole if edits > 1 else F.char_length("b") <= 1)
    return p.where(edit_distance(F.col("a"), F.col("b"), edits) <= F.col("t")).select("h", "g")


def _signed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ones`` and ``twos``: for 64 classes each of the rest's characters and of its pairs of neighbours, whether
    their numbers are odd."""

    def odd(u: Column, size: int) -> Column:
        def flip(bits: Column, at: Column) -> Column:
            return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.substring(u, 4 * at + 1, F.lit(4 * size))), F.lit(64)).cast("int")))

        places = F.shiftright(F.octet_length(u), 2) - size
        return F.when(places >= 0, F.aggregate(F.sequence(F.lit(0), F.greatest(places, F.lit(0))), F.lit(0).cast("long"), flip)).otherwise(F.lit(0).cast("long"))

    both = _bound(F.encode("rest", "UTF-32"), lambda u: F.struct(odd(u, 1).alias("ones"), odd(u, 2).alias("twos")))
    return rows.withColumn("signs_", both).select(*rows.columns, "signs_.ones", "signs_.twos")


def _pairs(searchers: DataFrame, others: DataFrame) -> DataFrame:
    """Each searcher with the earlier lines of its key, the shorter rest as ``r``. One of a pair has the key as the shorter text:
    two lines that both have it as longer ones share another key, of their own lengths, if they are near.

    Signed rows are told apart by their signatures first: of the numbers of characters an edit changes two, and one if it changes
    the length; of the numbers of neighbours four, and three."""
    signs = [c for c in ("ones", "twos") if c in searchers.columns]
    other = others.select("key", F.col("first").alias("earlier"), F.col("rest").alias("other"), F.col("longer").alias("longer2"), *(F.col(c).alias(f"{c}2") for c in signs))
    both = searchers.join(other, "key").where("earlier < first AND (longer = 0 OR longer2 = 0)")
    for c, most in zip(signs, (2, 4), strict=False):
        both = both.where(f"bit_count({c} ^ {c}2) <= {most} * t - longer - longer2")
    short = F.char_length("rest") <= F.char_length("other")
    return both.select("h", "g", "t", F.when(short, F.col("rest")).otherwise(F.col("other")).alias("r"), F.when(short, F.col("other")).otherwise(F.col("rest")).alias("s"))


def _narrow(df: DataFrame) -> DataFrame:
    """``df``, which is an eighth of its input or less, in as many fewer partitions."""
    return df.coalesce(max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))


def _near_earlier(lines: DataFrame, firsts: DataFrame, edits: int, chars_per_edit: int, bucket: int, levels: int = MAX_LEVELS) -> DataFrame:
    """``h, g`` of the lines that have a near line with an earlier first occurrence."""

    def allowed(n: Column) -> Column:
        return F.least(F.lit(edits), (n / chars_per_edit).cast("int")) if chars_per_edit else F.lit(edits)

    long_enough = lines.where(F.char_length("line") >= chars_per_edit)
    cut = _segments(long_enough.select("h", "g", "line"), "line", edits, allowed)
    shared = cut.select("h", "k.key", "k.longer").groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("longer").alias("l")).where("a <> b AND l = 0").select("key")
    hinted, _ = small(materialise(shared, "shared-segments"), BROADCAST_ROWS)
    held = cut.select("h", "g", "line", "k.*").join(hinted, "key")
    held = held.groupBy("key", "h", "g", "at", "longer").agg(F.first(_without(F.col("line"), F.col("at"), F.col("size"), edits)).alias("rest"), F.first("t").alias("t"))
    members = materialise(held.join(firsts, ["h", "g"]).withColumn("open", F.lit(True)), "segment-members")
    most, before = SIGNED_PAIRS * members.count(), None
    decided = None
    for level in range(levels):
        sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("least"))
        hot_keys, _ = small(materialise(_narrow(sizes.where(F.col("n") > bucket).withColumnRenamed("n", "all")), "hot-segments"), BROADCAST_ROWS // PIVOTS)
        few = members.join(hot_keys, "key", "left_anti")
        found = _near(_pairs(few.where("open"), few), edits)
        decided = found if decided is None else decided.unionByName(found)
        if not hot_keys.take(1):
            break
        hot = members.join(hot_keys, "key")
        pivots = hot.groupBy("key", F.pmod(F.xxhash64("h", "key"), F.lit(PIVOTS)).alias("slot")).agg(F.min(F.struct("first", "rest", "longer")).alias("p")).select("key", "p.*")
        found = _near(_pairs(hot.where("open AND first > least"), pivots), edits)
        decided = materialise(_narrow(decided.unionByName(found).distinct()), "near-lines")
        seen, _ = small(decided.withColumn("seen", F.lit(True)), BROADCAST_ROWS)
        hot = hot.join(seen, ["h", "g"], "left").withColumn("open", F.col("open") & F.col("seen").isNull() & (F.col("first") > F.col("least"))).drop("seen", "least")
        open_keys = materialise(_narrow(hot.where("open").groupBy("key").agg(F.count("*").alias("n"), F.first("all").alias("all"))), "open-segments")
        cost = open_keys.agg(F.sum(F.col("n") * F.col("all"))).first()[0] or 0
        last = level + 1 == levels or cost <= most or (before is not None and cost > LESS * before)
        before = cost
        one_by_one = open_keys if last else open_keys.where(F.col("n") <= bucket)
        here = materialise(_signed(hot.join(small(one_by_one.select("key"), BROADCAST_ROWS)[0], "key")), "signed-lines")
        decided = decided.unionByName(_near(_pairs(here.where("open"), here), edits))
        more, _ = small(open_keys.where(F.col("n") > bucket).select("key"), BROADCAST_ROWS)
        if last or not more.take(1):
            break
        # Longer keys: a segment of the rest on top.
        rest = hot.join(more, "key").select(F.col("key").alias("key0"), "h", "g", "first", "open", "rest", F.col("t").alias("t0"), F.col("longer").alias("l0"))
        parts = _segments(rest, "rest", edits, lambda n: F.col("t0"), "l0")
        parts = parts.select(F.xxhash64("key0", "k.key").alias("key"), "h", "g", _without(F.col("rest"), F.col("k.at"), F.col("k.size"), edits).alias("rest"), F.col("k.t").alias("t"), "first", "open", "k.longer")
        shared = parts.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("longer").alias("l"), F.bool_or("open").alias("any")).where("a <> b AND l = 0 AND any").select("key")
        members = materialise(_narrow(parts.join(small(materialise(_narrow(shared), "shared-segments"), BROADCAST_ROWS)[0], "key").distinct()), "segment-members")
    return decided.distinct()


def kept_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", edits: int = EDITS, chars_per_edit: int = CHARS_PER_EDIT, bucket: int = MAX_BUCKET) -> DataFrame:
    """``id_, key_, kept_``: the numbers (from 0) of a row's lines that aren't dropped; blank lines aren't listed."""
    lines = _lines(docs, id, text)
    firsts = materialise(lines.groupBy("h", "g").agg(F.min(F.struct("id_", "no_", "key_")).alias("first")), "line-firsts")
    kept = firsts.join(_near_earlier(lines, firsts, edits, chars_per_edit, bucket), ["h", "g"], "left_anti")
    return kept.groupBy(F.col("first.id_").alias("id_"), F.col("first.key_").alias("key_")).agg(F.collect_list("first.no_").alias("kept_"))


def _with_kept(docs: DataFrame, id: str, text: str, **how: int) -> DataFrame:
    """``docs`` with ``lines_`` (all lines) and ``left_`` (the numbers of those that stay), both null for a null text."""
    kept = kept_lines(docs, id, text, **how)
    joined = docs.join(kept, docs[id].eqNullSafe(kept["id_"]) & (row_key(docs[text].cast("string")) == kept["key_"]), "left")
    joined = joined.withColumn("lines_", F.split(docs[text].cast("string"), "\n"))
    blank = F.filter(F.transform("lines_", lambda x, i: F.when(_trim(x) == "", i)), lambda i: i.isNotNull())
    return joined.withColumn("left_", F.array_sort(F.array_union(blank, F.coalesce("kept_", F.array().cast("array<int>")))))


def _text() -> Column:
    return F.array_join(F.transform("left_", lambda i: F.get("lines_", i)), "\n")


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``id, n_lines`` (blank ones too), ``n_dropped`` and ``text`` without the dropped lines, of every row; ``how`` goes to
    ``kept_lines``."""
    found = _with_kept(docs.select(F.col(id).alias(id), F.col(text).alias(text)), id, text, **how)
    n = F.coalesce(F.greatest(F.size("lines_"), F.lit(0)), F.lit(0))
    left = F.coalesce(F.greatest(F.size("left_"), F.lit(0)), F.lit(0))
    return found.select(id, n.cast("long").alias("n_lines"), (n - left).cast("long").alias("n_dropped"), _text().alias("text"))


def drop_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``; rows that lose every line with a word go, other rows stay."""
    # The other columns travel in a struct, where their names can't clash.
    packed = docs.select(F.col(id).alias("i_"), F.col(text).cast("string").alias("t_"), F.struct(*(docs[c] for c in docs.columns if c != text)).alias("rest_"))
    found = _with_kept(packed, "i_", "t_", **how)
    stays = F.col("kept_").isNotNull() | F.col("t_").isNull() | (_trim(F.regexp_replace("t_", "\\n", "")) == "")
    return found.where(stays).select(*((_text() if c == text else F.col("rest_")[c]).alias(c) for c in docs.columns))
