"""The operators over the driver tables, one query each. Results are rounded, as summation order may differ in the last digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.stats import charbonnier, tail
from ..operators import align, evaluate, fusion, pixels, series, windows
from ..sources.frames import event_series, pixel_frames, table
from . import evaluate as evaluation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Widths of the windows and gaps of the fixture streams, whose frames are hours apart.
GAP_S, PICKS, UNIFORM = 36000.0, 8, 8


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes))


def simple(name: str, build: Callable[[DataFrame], DataFrame], source: Query, digits: int = 6) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(source(spark, sf_dir)), digits)


simple("scan_lag_stats", series.lag_stats, event_series)
simple("parity_gap", series.parity_gap, event_series)
simple("risk_components", series.components, event_series)
simple("robust_z", lambda s: series.with_robust_z(s.select("stream", "k", "x"), ["x"], ["stream"]), event_series, 4)
simple("risk_timeline", series.risk_timeline, event_series, 3)
simple("scene_cuts", series.scene_cuts, event_series, 4)
simple("parity_summary", series.parity_summary, event_series)
simple("alternation_block_max", series.alternation_blocks, event_series)
simple("technical_summary", series.technical_summary, event_series)
simple("percentiles", lambda s: s.groupBy("stream").agg(*(F.percentile("x", F.lit(p)).alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))), event_series)
simple("tail_aggregate", lambda s: s.groupBy("stream").agg(tail(F.col("x")).alias("tail")), event_series)
simple("charbonnier", lambda s: s.select("stream", "k", charbonnier(F.col("x"), 4.0).alias("c")), event_series)
simple("uniform_windows", lambda s: windows.uniform_centres(s, UNIFORM), event_series)


def _picks(s: DataFrame) -> DataFrame:
    step = series.components(s)
    return windows.temporal_nms(step.select("stream", "k", "t", F.col("flicker").alias("risk")), PICKS, GAP_S)


simple("temporal_nms", _picks, event_series)
simple("window_union", lambda s: windows.union_windows(windows.uniform_centres(s, UNIFORM), _picks(s)), event_series)
simple("window_explode", lambda s: windows.explode_windows(windows.uniform_centres(s, UNIFORM), s), event_series)
simple("window_times", lambda s: windows.window_times(windows.explode_windows(windows.uniform_centres(s, UNIFORM), s)), event_series)
simple("window_parity_gap", lambda s: windows.window_parity_gap(windows.explode_windows(windows.uniform_centres(s, UNIFORM), s)), event_series)


@query
def gap_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("stream"), F.col("l_orderkey").alias("idx"))
    return windows.gap_runs(rows, "stream", "idx", 32)


@query
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("time", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return s.select(F.col("user_id").alias("stream"), F.unix_micros("w.start").alias("first_us"), "n", F.round("total", 6).alias("total"))


@query
def tumbling_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean")


@query
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("time", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("time", "5 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("most")).select(F.unix_micros("w.start").alias("start_us"), "n", "most")


def _offsets(s: DataFrame) -> DataFrame:
    return align.offset_errors(*align.split_parity(s))


simple("pts_offset_search", lambda s: align.best_offset(_offsets(s)), event_series)
simple("offset_errors", _offsets, event_series, 4)


def _pairs(s: DataFrame) -> DataFrame:
    source, candidate = align.split_parity(s)
    return align.anchor_pairs(candidate, align.best_offset(_offsets(s)), source)


simple("anchor_pair_map", lambda s: _pairs(s).select("stream", "k", F.col("anchor").cast("double").alias("anchor"), F.col("pair").cast("double").alias("pair")), event_series)
simple("asof_nearest", lambda s: align.nearest_within(s.where("k % 2 = 1"), align.split_parity(s)[0], 7200.0), event_series)
simple("cut_pairs", lambda s: align.cut_pairs(series.scene_cuts(s), _pairs(s)), event_series)


@query
def cut_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    pairs = _pairs(s).where("pair IS NOT NULL").select("stream", "k", "pair")
    return pairs.join(align.cut_pairs(series.scene_cuts(s), _pairs(s)), ["stream", "pair"], "left_anti").select("stream", "k", "pair")


@query
def pair_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    usable = _pairs(s).where("pair IS NOT NULL").select("stream", "k")
    return windows.uniform_centres(s, UNIFORM).join(usable, ["stream", "k"], "left_semi").select("stream", "k")


@query
def cached_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted frames of the events without those that a cache (every third) has."""
    s = event_series(spark, sf_dir)
    wanted = windows.explode_windows(windows.uniform_centres(s, UNIFORM), s).select("stream", "k").distinct()
    return wanted.join(s.where("k % 3 = 0").select("stream", "k"), ["stream", "k"], "left_anti")


@query
def interval_overlap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut frames widened by two hours against segments of the stream's quarters."""
    s = event_series(spark, sf_dir)
    found = series.scene_cuts(s).join(s.select("stream", "k", "t"), ["stream", "k"])
    found = found.select("stream", "k", (F.col("t") - 7200).alias("start"), (F.col("t") + 7200).alias("end"), F.when(F.col("flicker") > 60, F.array(F.lit("cut"), F.lit("flash"))).otherwise(F.array(F.lit("cut"))).alias("labels"))
    span = s.groupBy("stream").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    q = (F.col("b") - F.col("a")) / 4
    truth = span.select("stream", "a", q.alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seg"))
    truth = truth.select("stream", F.col("seg").cast("long").alias("seg"), (F.col("a") + F.col("seg") * F.col("q")).alias("t0"), (F.col("a") + (F.col("seg") + 0.5) * F.col("q")).alias("t1"), F.when(F.col("seg") % 2 == 0, F.array(F.lit("flash"))).otherwise(F.array(F.lit("cut"), F.lit("tear"))).alias("expected"))
    return align.overlaps(found, truth, 600.0).select("stream", "k", "seg")


@query
def report_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    worst = items.groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("worst"))
    return orders.join(worst, orders.o_orderkey == worst.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.round("worst", 6).alias("worst"))


#: Fixture features: line item columns as features of the registry.
FEATURES = {"comp_mean": "l_discount", "mct_lag1_mean": "l_quantity", "edge_recall": "1 - 10 * l_tax", "gtq_sharp_odd_even_ratio": "1 + l_tax - l_discount", "ui_static_l1": "l_quantity / 10", "gtq_blockiness": "1 + l_discount", "thin_layer_err": "l_tax * 5", "char_extra_frac": "l_discount * 2", "parity_sharp_e_pi": "l_tax"}


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, window, feature, value``: suppliers as models, order lines as windows."""
    items = table(spark, sf_dir, "lineitem")
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.expr(e).cast("double").alias("value")) for f, e in FEATURES.items()))
    return items.select(F.col("l_suppkey").alias("model"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("window"), F.explode(cells).alias("f")).select("model", "window", "f.feature", "f.value")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.normalise(_features(spark, sf_dir), fusion.feature_dim(spark))


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.aggregate_categories(fusion.category_errors(_errors(spark, sf_dir), ["model"]), ["model"])


@query
def normalize_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _errors(spark, sf_dir).groupBy("feature", "category").agg(F.count("error").alias("n"), F.avg("error").alias("mean"), F.min("error").alias("least"), F.max("error").alias("most"))
    return rounded(e)


@query
def feature_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.feature_dim(spark)


@query
def category_tail_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_categories(spark, sf_dir))


@query
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fusion.overall_scores(_categories(spark, sf_dir), ["model"]), 4)


@query
def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with odd keys lack the structure features, and so a score."""
    c = _categories(spark, sf_dir).where("NOT (category = 'structure' AND model % 2 = 1)")
    return rounded(fusion.overall_scores(c, ["model"]), 4)


@query
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fusion.overall_scores(_categories(spark, sf_dir).where("NOT (category = 'structure' AND model % 7 = 1)"), ["model"])
    return rounded(fusion.rank_models(scores.withColumn("overall", F.round("overall", 6)), "model"), 4)


@query
def trigger_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fusion.trigger_errors(_errors(spark, sf_dir), ["model", "window"])
    return rounded(t.groupBy("model", "category").agg(F.max("error").alias("most"), F.avg("error").alias("mean")))


@query
def worst_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Errors are rounded before they are compared, so that both engines order equal ones alike.
    c = _categories(spark, sf_dir).withColumn("error", F.round("error", 6))
    return fusion.loudest(c, ["model"]).select("model", F.array_join("labels", "+").alias("labels"), F.round("severity", 6).alias("severity"))


@query
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("l_returnflag") != "R", 1)).alias("valid"), F.avg("l_discount").alias("visible"), (F.countDistinct("l_linenumber") + 2.0).alias("keys"),
        F.avg("l_tax").alias("ambiguity"), F.avg("l_quantity").alias("anchor_error"), F.count(F.when(F.col("l_quantity") > 49, 1)).alias("warnings"), (F.avg("l_linenumber") / 3000).alias("windows_per_frame"),
    )
    return items.select("model", F.round(fusion.confidence(items), 6).alias("confidence"))


@query
def feature_median_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir).where(~F.startswith("feature", F.lit("parity")))
    return f.groupBy("feature").agg(F.round(F.percentile("value", F.lit(0.5)), 5).alias("median"))


@query
def severity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.components(event_series(spark, sf_dir))
    return rounded(windows.dedupe_worst(s.select("stream", "k", "t", F.col("x").alias("severity")), GAP_S, 5))


@query
def worst_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stream has the worst segment, and what it scores: risk, windows, features, categories, score, rank."""
    s = event_series(spark, sf_dir)
    risk = series.risk_timeline(s).withColumn("risk", F.round("risk", 3))
    centres = windows.union_windows(windows.uniform_centres(s, UNIFORM), windows.temporal_nms(risk, PICKS, GAP_S))
    gaps = windows.window_parity_gap(windows.explode_windows(centres, s))
    scored = fusion.normalise(gaps.select("stream", "centre", F.lit("parity_window_sharp_gap").alias("feature"), F.col("gap").alias("value")), fusion.feature_dim(s.sparkSession))
    out = scored.groupBy("stream").agg(tail(F.col("error")).alias("error"), F.count("*").alias("windows"))
    out = out.select("stream", "windows", F.round("error", 6).alias("error"), F.round(100 * F.exp(-1.8 * F.col("error")), 4).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy("score", "stream")).cast("long"))


@query
def color_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_quantity") * 5).alias("source"), (F.col("l_extendedprice") / 500).alias("candidate"))
    return rounded(evaluate.colour_fit(d, "source", "candidate", "l_returnflag", "l_linestatus"), 4)


@query
def median_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_suppkey") % 10)
    fits = d.groupBy("grp", "l_suppkey").agg(F.regr_slope("l_extendedprice", "l_quantity").alias("gain"))
    return fits.groupBy("grp").agg(F.round(F.percentile("gain", F.lit(0.5)), 4).alias("gain"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity"), 1).alias("a"), F.round(F.avg("l_extendedprice"), 0).alias("b"), F.count("*").alias("n")).withColumn("grp", F.col("l_suppkey") % 4)
    return rounded(evaluate.correlations(d, "a", "b", "grp"))


@query
def pairwise_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 5).alias("quality"), F.lit(1).cast("long").alias("all"))
    return rounded(evaluate.pairwise_accuracy(s, "s_suppkey", "score", "quality", "all"))


@query
def within_group_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal"), -3).alias("score"), (F.col("s_suppkey") % 5).alias("quality"), F.col("s_nationkey").cast("long").alias("seed"))
    return rounded(evaluate.pairwise_accuracy(s, "s_suppkey", "score", "quality", "seed"))


@query
def detection_prf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _labelled(spark, sf_dir).withColumn("p", F.col("n_chars") > 1500).withColumn("a", F.col("quality") == 1)
    return rounded(evaluate.detection(d.withColumn("toxic", F.col("toxic").cast("long")), "p", "a", "toxic"))


@query
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), table(spark, sf_dir, "orders").select((F.col("o_custkey") % 200).alias("id"))
    parts = {"union": e.union(o).distinct(), "intersect": e.intersect(o), "except": e.subtract(o)}
    out = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("op"), "id")
        out = part if out is None else out.union(part)
    return out


@query
def parity_in_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("n", F.char_length("text"))
    return rounded(c.groupBy("conv_id").agg(F.avg(F.when(F.col("turn") % 2 == 0, F.col("n"))).alias("even"), F.avg(F.when(F.col("turn") % 2 == 1, F.col("n"))).alias("odd"), F.count("*").alias("turns")))


for _name, _build in {
    "pixel_luma_l1": pixels.luma_l1, "psnr": pixels.psnr, "laplacian_var": pixels.sharpness, "noise_sigma": pixels.noise_sigma, "gradient_energy": pixels.gradient_energy, "blockiness": pixels.blockiness,
    "histogram_shares": lambda p: pixels.histogram(p, 8, -0.4, 0.4), "histogram_bhattacharyya": pixels.bhattacharyya, "median_hash": pixels.median_hash, "median_hash_hamming": pixels.hash_distance,
    "alpha_blend_fit": pixels.alpha_blend, "charbonnier_residual": pixels.masked_residual, "forward_splat_shift": lambda p: pixels.forward_splat(p, 0.5, 0.25), "backward_warp_shift": lambda p: pixels.backward_warp(p, 0.5, -0.25),
    "flow_geometry": pixels.flow_geometry, "bbox": lambda p: pixels.bounding_box(p, 0.2), "ui_static_mask": lambda p: pixels.static_mask(p, 0.08), "linear_blend": pixels.linear_blend, "text_roi_blocks": pixels.block_density,
    "defect_ghost": lambda p: pixels.defect_mid(p, "ghost"), "defect_freeze": lambda p: pixels.defect_mid(p, "freeze"), "defect_tear": lambda p: pixels.defect_mid(p, "tear"), "defect_fill": lambda p: pixels.defect_mid(p, "fill"),
}.items():
    simple(_name, _build, pixel_frames, 5)


@query
def histogram2d_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pairs of neighbouring pixel values fall on a grid of tenths."""
    p = pixels.with_next(pixel_frames(spark, sf_dir))
    return p.groupBy(F.floor(F.col("v") * 10).alias("a"), F.floor(F.col("w") * 10).alias("b")).agg(F.count("*").alias("n"))


@query
def dropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without those at 25, 55 and 79 % of a stream, renumbered."""
    s = event_series(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("stream")))
    keep = s.where("NOT (k = floor(n * 0.25) OR k = floor(n * 0.55) OR k = floor(n * 0.79))")
    return keep.select("stream", "k", (F.row_number().over(Window.partitionBy("stream").orderBy("k")) - 1).cast("long").alias("new_k"))


@query
def vfr_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps of a sequence whose frames alternate between 1/112 and 1/130 s."""
    s = event_series(spark, sf_dir)
    before = F.sum(F.when(F.col("k") % 2 == 0, 1.0 / 112).otherwise(1.0 / 130)).over(Window.partitionBy("stream").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    return rounded(s.select("stream", "k", F.coalesce(before, F.lit(0.0)).alias("pts")))


@query
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON report for each model; only rows are checked, as engines print numbers differently."""
    c = _categories(spark, sf_dir)
    parts = c.groupBy("model").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", F.round("subscore", 2).alias("s"))))).alias("scores"))
    overall = fusion.overall_scores(c, ["model"])
    return parts.join(overall, "model").select("model", F.to_json(F.struct(F.round("overall", 2).alias("overall"), "scores"), {"ignoreNullFields": "false"}).alias("report"))


@query
def scan_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame scan (sharpness, mean, perceptual hash and their steps) of the generated test sequences."""
    return rounded(evaluation.scan(evaluation.candidates(spark)), 4)


@query
def evaluate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated test sequences with true, blended, frozen and blurred mid frames, evaluated and ranked."""
    return rounded(evaluation.evaluate(evaluation.candidates(spark)), 4)
