"""Rules on small tables: the alignment's report, a window's labels, colour transforms, and the corpora's frame maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.stats import correlation

#: Limits of the frame rates' ratio, and gains and offsets that count as none.
RATIO, GAIN_SLACK, OFFSET_SLACK = (1.9, 2.1), 0.02, 0.5
#: Error from which a category labels a window, and how many of them may.
LABEL_FROM = {"motion": 0.45, "temporal": 0.40, "structure": 0.45, "character": 0.40, "thin_weapon": 0.45, "ui": 0.40, "transition": 0.35}
LOUDEST, MOST_LABELS, SEVERITY = 3, 4, 1.2


def alignment_report(source: DataFrame, candidate: DataFrame, offsets: DataFrame) -> DataFrame:
    """``stream, ratio, off, err, warnings``: the frame rates' ratio, the offset found and its error, and what is odd about them."""
    rate = lambda df, name: df.groupBy("stream").agg(((F.count("*") - 1) / F.greatest(F.max("t") - F.min("t"), F.lit(1e-6))).alias(name))
    both = rate(source, "source_rate").join(rate(candidate, "candidate_rate"), "stream").join(offsets, "stream", "left")
    ratio = F.col("candidate_rate") / F.greatest("source_rate", F.lit(1e-6))
    warnings = F.array_compact(
        F.array(
            F.when((ratio < RATIO[0]) | (ratio > RATIO[1]), "fps_ratio"),
            F.when(F.col("err") > 0.5 / F.greatest("source_rate", F.lit(1e-6)), "pts_error"),
            F.when(F.col("off") < 0, "negative_offset"),
        )
    )
    return both.select("stream", ratio.alias("ratio"), F.coalesce("off", F.lit(0).cast("long")).alias("off"), "err", F.array_join(warnings, "+").alias("warnings"))


def window_labels(w: DataFrame, errors: Callable[[str], Column], feature: Callable[[str], Column], parity_error: Column, text_error: Column) -> DataFrame:
    """``w`` with ``labels`` and ``severity``. ``errors`` gives a category's error, ``feature`` a feature's value (null if it has none).

    Two precise signals label by themselves; beyond them the loudest categories that reach their limit do, each by its own
    evidence. A ghosted transition is named if its ghost is strong, or nothing else is."""
    value = lambda name, default: F.coalesce(feature(name), F.lit(default))
    special = F.array_compact(F.array(F.when(value("card_flip_err", 0.0) > 0.5, "card_flip_error"), F.when(value("freeze_copy_score", 0.0) > 0.5, "freeze_copy")))
    firing = F.array_compact(F.array(*(F.when(errors(c) >= limit, F.struct((-errors(c)).alias("minus"), F.lit(i).alias("rank"), F.lit(c).alias("c"))) for i, (c, limit) in enumerate(LABEL_FROM.items()))))
    loud = F.slice(F.sort_array(firing), 1, LOUDEST)
    names = {
        "motion": F.when(value("flow_fold_frac", 0.0) > 0.03, "background_tear").otherwise("motion_inconsistent"),
        "temporal": F.when(F.coalesce(parity_error, F.lit(0.0)) > 0.35, "parity_flicker").otherwise("temporal_instability"),
        "structure": F.lit("structure_loss"),
        "character": F.when((value("char_leak_mean", 99.0) < 6) & (value("char_ring_edge_frac", 0.0) > 0.18), "character_ghost").otherwise("character_missing"),
        "thin_weapon": F.when(value("weapon_dev_p90", 0.0) > 0.35, "weapon_jitter").otherwise("thin_object_stick"),
        "ui": F.when(F.coalesce(text_error, F.lit(0.0)) > 0.5, "text_degraded").otherwise("ui_unstable"),
    }

    def add(labels: Column, x: Column) -> Column:
        out = F.when((value("event_ghost_frac", 0.0) > 0.08) | (F.size(labels) == 0), F.array_append(labels, F.lit("transition_ghost"))).otherwise(labels)
        for c, name in names.items():
            out = F.when(x["c"] == c, F.array_append(labels, name)).otherwise(out)
        return out

    labels = F.slice(F.array_distinct(F.aggregate(loud, special, add)), 1, MOST_LABELS)
    worst = F.greatest(*(F.coalesce(errors(c), F.lit(0.0)) for c in LABEL_FROM), value("card_flip_err", 0.0), value("freeze_copy_score", 0.0))
    return w.withColumn("labels", labels).withColumn("severity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), worst / SEVERITY))).where(F.size("labels") > 0)


def to_source(value: Column, gain: Column, offset: Column) -> Column:
    """A candidate's value in the source's colours; small gains don't blow it up."""
    return (value - offset) / F.greatest(F.lit(0.25), F.least(F.lit(4.0), gain))


def to_candidate(value: Column, gain: Column, offset: Column) -> Column:
    return value * gain + offset


def is_trivial(gain: Column, offset: Column) -> Column:
    return (F.abs(gain - 1) < GAIN_SLACK) & (F.abs(offset) < OFFSET_SLACK)


def time_to_index(frames: DataFrame, times: DataFrame) -> DataFrame:
    """``stream, at, k``: the first frame at or after each time (``stream, at``), the last frame for times beyond.

    Times and frames are sorted together in one window pass, so no time is compared with all frames."""
    events = frames.select("stream", "t", F.col("k"), F.lit(None).cast("double").alias("at")).unionByName(times.select("stream", F.col("at").alias("t"), F.lit(None).cast("long").alias("k"), "at"))
    # A frame of equal time comes after the asking row, whose next frame it is.
    after = Window.partitionBy("stream").orderBy(F.col("t"), F.col("k").asc_nulls_first()).rowsBetween(0, Window.unboundedFollowing)
    last = Window.partitionBy("stream")
    found = events.withColumn("next", F.first("k", ignorenulls=True).over(after)).withColumn("last", F.max("k").over(last))
    return found.where("at IS NOT NULL").select("stream", "at", F.coalesce("next", "last").alias("k"))


def interleave(anchors: DataFrame, mids: DataFrame) -> DataFrame:
    """Anchors (``i, v``) at 2i and mids at 2i + 1, of one sequence."""
    return anchors.select((2 * F.col("i")).alias("frame"), "v").unionByName(mids.select((2 * F.col("i") + 1).alias("frame"), "v"))


def zip_truth(candidate: DataFrame, truth: DataFrame) -> DataFrame:
    """``i, v, truth``: the candidate's odd frames (``k, v``) beside the true mids (``i, v``) of their place, as far as both go."""
    odd = candidate.where(F.col("k") % 2 == 1).select(F.floor(F.col("k") / 2).alias("i"), "v")
    return odd.join(truth.select("i", F.col("v").alias("truth")), "i")


def delayed(frames: DataFrame, by: int = 1) -> DataFrame:
    """``stream, k, shows``: each frame shows the one ``by`` before it; the first ones repeat the first."""
    return frames.select("stream", "k", F.greatest(F.col("k") - by, F.lit(0)).alias("shows"))


def spliced(frames: DataFrame, other: Column) -> DataFrame:
    """``stream, k, shows_stream, cut``: the first half of a stream, then ``other`` stream's frames; the cut is the first of those."""
    n = F.count("*").over(Window.partitionBy("stream"))
    f = frames.select("stream", "k").withColumn("half", F.floor(n / 2))
    return f.select("stream", "k", F.when(F.col("k") < F.col("half"), F.col("stream")).otherwise(other).alias("shows_stream"), (F.col("k") == F.col("half")).alias("cut"))


def defect_segments(mids: DataFrame, defects: list[str]) -> DataFrame:
    """``stream, defect, a, b``: defect j of c takes max(4, step / 3) mids from (j + 1) step on, step = mids / (c + 1)."""
    n = mids.groupBy("stream").agg(F.count("*").alias("n"))
    step = F.floor(F.col("n") / (len(defects) + 1))
    rows = n.select("stream", "n", step.alias("step"), F.posexplode(F.array(*map(F.lit, defects))).alias("j", "defect"))
    begin = (F.col("j") + 1) * F.col("step")
    return rows.select("stream", "defect", begin.alias("a"), F.least(F.col("n") - 1, begin + F.greatest(F.lit(4), F.floor(F.col("step") / 3)) - 1).alias("b"))


def feature_correlations(df: DataFrame, truth: str, features: list[str], least: int = 6, top: int = 15) -> DataFrame:
    """``feature, srcc, n``: absolute rank correlation of each feature with ``truth`` over the rows that have it, for features with
    ``least`` rows (or all there are) and more than one value; the ``top`` strongest."""
    from .evaluate import with_rank

    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features)))
    n_all = df.count()
    long = df.select(F.col(truth).cast("double").alias("y"), cells.alias("c")).select("y", "c.*").where("x IS NOT NULL AND y IS NOT NULL")
    ranked = with_rank(with_rank(long, "x", "rx", "feature"), "y", "ry", "feature")
    s = ranked.groupBy("feature").agg(F.abs(correlation(F.col("rx"), F.col("ry"))).alias("srcc"), F.count("*").alias("n"), F.countDistinct("x").alias("kinds"))
    s = s.where((F.col("n") >= min(n_all, least)) & (F.col("kinds") > 1)).drop("kinds")
    return s.orderBy(F.desc("srcc"), "feature").limit(top)
