"""From feature values to scores: normalising, category aggregates, subscores, confidence, labels, ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.stats import clip, nan_to_null, subscore, tail

#: The feature registry, as (feature, category, kind, scale, reference, width); a ratio's scale is its deviation.
REGISTRY: tuple[tuple[str, str | None, str, float | None, float | None, float | None], ...] = (
    ("comp_mean", "motion", "fwd", 0.18, None, None),
    ("comp_p90_max", "motion", "fwd", 0.45, None, None),
    ("comp_leg_ratio", "motion", "fwd", 0.25, None, None),
    ("comp_fwd_p90", "motion", "fwd", 0.45, None, None),
    ("comp_bwd_p90", "motion", "fwd", 0.45, None, None),
    ("flow_fold_frac", "motion", "fwd", 0.1, None, None),
    ("flow_jdet_low_frac", "motion", "fwd", 0.2, None, None),
    ("comp_occ_region_mean", "motion", "fwd", 0.5, None, None),
    ("mct_lag1_mean", "temporal", "fwd", 30.0, None, None),
    ("mct_lag1_p90", "temporal", "fwd", 45.0, None, None),
    ("mct_anchor_vs_gen_ratio", "temporal", "fwd", 1.5, None, None),
    ("cycle_resid_mean", "temporal", "fwd", 35.0, None, None),
    ("cycle_resid_p90", "temporal", "fwd", 100.0, None, None),
    ("cycle_sharp_loss", "temporal", "fwd", 0.3, None, None),
    ("freeze_copy_score", "temporal", "fwd", 0.5, None, None),
    ("parity_window_sharp_gap", "temporal", "fwd", 0.25, None, None),
    ("parity_lag2_gen_vs_anchor", "temporal", "fwd", 1.5, None, None),
    ("parity_sharp_e_pi_block_max", "temporal", "fwd", 0.5, None, None),
    ("parity_sharp_mean_gap", "temporal", "fwd", 0.45, None, None),
    ("edge_count_odd_even_ratio", "temporal", "ratio", 0.35, None, None),
    ("gtq_sharp_odd_even_ratio", "temporal", "ratio", 0.25, None, None),
    ("edge_recall", "structure", "inv", None, 0.75, 0.45),
    ("edge_precision", "structure", "inv", None, 0.9, 0.3),
    ("edge_inst_recall_med", "structure", "inv", None, 0.3, 0.35),
    ("edge_inst_recall_p10", "structure", "inv", None, 0.15, 0.35),
    ("edge_chamfer_sup_to_em", "structure", "fwd", 6.0, None, None),
    ("edge_ghost_frac", "structure", "fwd", 0.2, None, None),
    ("char_missing_frac", "character", "fwd", 0.45, None, None),
    ("char_extra_frac", "character", "fwd", 0.3, None, None),
    ("char_chamfer", "character", "fwd", 150.0, None, None),
    ("char_components_delta", "character", "fwd", 3.0, None, None),
    ("char_leak_mean", "character", "inv", None, 10.0, 10.0),
    ("char_ring_edge_frac", "character", "fwd", 0.35, None, None),
    ("thin_layer_err", "thin_weapon", "fwd", 0.5, None, None),
    ("thin_inst_err_p90", "thin_weapon", "fwd", 0.7, None, None),
    ("thin_attrib_fail_frac", "thin_weapon", "fwd", 0.3, None, None),
    ("thin_count_odd_even_ratio", "thin_weapon", "ratio", 0.45, None, None),
    ("weapon_dev_p90", "thin_weapon", "fwd", 0.6, None, None),
    ("weapon_dir_change_p90", "thin_weapon", "fwd", 1.0, None, None),
    ("ui_static_l1", "ui", "fwd", 6.0, None, None),
    ("ui_static_grad", "ui", "fwd", 20.0, None, None),
    ("ui_static_edge_f", "ui", "inv", None, 0.85, 0.35),
    ("ui_comp_drift_p90", "ui", "fwd", 8.0, None, None),
    ("ui_gen_drift", "ui", "fwd", 6.0, None, None),
    ("ui_dyn_blend_frac", "ui", "fwd", 0.15, None, None),
    ("ui_dyn_out_of_range_frac", "ui", "fwd", 0.15, None, None),
    ("ui_dyn_regression", "ui", "fwd", 0.2, None, None),
    ("text_edge_f", "ui", "inv", None, 0.8, 0.4),
    ("text_grad_loss", "ui", "fwd", 0.3, None, None),
    ("text_comp_ratio", "ui", "ratio", 0.6, None, None),
    ("event_ghost_frac", "transition", "fwd", 0.15, None, None),
    ("event_regression", "transition", "fwd", 0.2, None, None),
    ("card_flip_err", "transition", "fwd", 0.5, None, None),
    ("gtq_blockiness", "global", "fwd", 0.6, None, None),
    ("gtq_noise", "global", "fwd", 16.0, None, None),
    ("anchor_y_l1_p90", "global", "fwd", 12.0, None, None),
    ("anchor_shift_better_frac", "global", "fwd", 0.5, None, None),
    ("comp_fwd_mean", None, "fwd", 0.18, None, None),
    ("comp_bwd_mean", None, "fwd", 0.18, None, None),
    ("flow_div_std", None, "fwd", 1.5, None, None),
    ("flow_curl_std", None, "fwd", 1.5, None, None),
    ("mct_lag2_mean", None, "fwd", 30.0, None, None),
    ("parity_sharp_e_pi", None, "fwd", 0.3, None, None),
    ("parity_grad_mean_gap", None, "fwd", 0.3, None, None),
    ("parity_edge_mean_gap", None, "fwd", 0.5, None, None),
    ("gtq_global_odd_even_sharp", None, "ratio", 0.25, None, None),
)
#: The weights of the score's parts; characters and thin objects share one.
WEIGHTS = {"motion": 0.25, "temporal": 0.20, "structure": 0.20, "character_thin": 0.15, "ui": 0.10, "transition": 0.05, "global": 0.05}
CORE = ("motion", "temporal", "structure")
#: Category errors from which a window gets the category's label.
LABEL_THRESHOLDS = {"motion": 0.45, "temporal": 0.40, "structure": 0.45, "character": 0.40, "thin_weapon": 0.45, "ui": 0.40, "transition": 0.35}


def feature_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REGISTRY), "feature string, category string, kind string, scale double, reference double, width double").coalesce(1)


def error_of(value: Column, kind: Column, scale: Column, reference: Column, width: Column, feature: Column | None = None) -> Column:
    """The normalised error of a value; null for null, NaN and unknown kinds. Blockiness counts from 1."""
    v = nan_to_null(value)
    if feature is not None:
        v = F.when(feature == "gtq_blockiness", v - 1.0).otherwise(v)
    forward = 1.0 - F.exp(-F.greatest(v, F.lit(0.0)) / scale)
    return F.when(v.isNull(), F.lit(None)).when(kind == "ratio", clip(F.abs(v - 1.0) / scale, 0.0, 1.5)).when(kind == "inv", clip((reference - v) / width, 0.0, 1.5)).when(kind == "fwd", forward)


def normalise(features: DataFrame, dim: DataFrame) -> DataFrame:
    """A long feature table with ``category`` and ``error``; features that the registry lacks get null ones. ``dim`` has a row
    for each of the registry's features, whatever the data, and is broadcast."""
    joined = features.join(F.broadcast(dim), "feature", "left")
    error = error_of(F.col("value"), F.col("kind"), F.col("scale"), F.col("reference"), F.col("width"), F.col("feature"))
    return joined.withColumn("error", error).drop("kind", "scale", "reference", "width")


def category_errors(errors: DataFrame, keys: list[str], globals_: DataFrame | None = None) -> DataFrame:
    """A row of mean error for each window and category, with global features as extra rows."""
    rows = errors.where("category IS NOT NULL AND error IS NOT NULL")
    each = rows.groupBy(*keys, "window", "category").agg(F.avg("error").alias("error")).select(*keys, "category", "error")
    if globals_ is not None:
        each = each.unionByName(globals_.where("category IS NOT NULL AND error IS NOT NULL").select(*keys, "category", "error"))
    return each


def aggregate_categories(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, category, error, subscore``: the tail aggregate of each category."""
    return rows.groupBy(*keys, "category").agg(tail(F.col("error")).alias("error")).withColumn("subscore", subscore(F.col("error")))


def overall_scores(categories: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, overall, parts``: 100 e^(-weighted mean error) over the parts there are; null unless motion, temporal and
    structure are there. Characters and thin objects share a part, as their mean if both are there."""
    part = F.when(F.col("category").isin("character", "thin_weapon"), "character_thin").otherwise(F.col("category"))
    each = categories.withColumn("part", part).groupBy(*keys, "part").agg(F.avg("error").alias("error"))
    weight = F.create_map(*(F.lit(x) for p in WEIGHTS.items() for x in p))[F.col("part")]
    each = each.withColumn("w", weight).where("w IS NOT NULL")
    core = F.count(F.when(F.col("part").isin(*CORE), 1))
    mean = F.sum(F.col("w") * F.col("error")) / F.sum("w")
    return each.groupBy(*keys).agg(F.when(core == len(CORE), 100.0 * F.exp(-mean)).alias("overall"), F.count("*").alias("parts"))


def confidence(rows: DataFrame) -> Column:
    """1 - 0.9 x the mean of the penalties that can be measured, within 0.05 to 1; 0.02 if windows exist and none is valid.

    ``rows`` has total, valid, visible, keys, ambiguity, anchor_error, warnings, windows_per_frame, with nulls where unmeasured."""
    ambiguity = clip(1.5 * F.coalesce(F.col("ambiguity"), F.lit(0.0)), 0.0, 1.0)
    penalties = F.array_compact(
        F.array(
            F.when(F.col("total") > 0, 1.0 - F.col("valid") / F.col("total")),
            F.when(F.col("visible").isNotNull(), clip((0.75 - F.col("visible")) / 0.5, 0.0, 1.0)),
            F.when(F.col("keys").isNotNull(), clip((12.0 - F.col("keys")) / 12.0, 0.0, 1.0)),
            0.5 * ambiguity,
            F.when(F.col("anchor_error").isNotNull(), clip((F.col("anchor_error") - 8.0) / 30.0, 0.0, 1.0)),
            F.when(F.col("warnings") > 0, F.least(F.lit(0.4), 0.15 * F.col("warnings"))),
            clip((0.01 - 5.0 * F.col("windows_per_frame")) / 0.01, 0.0, 0.5),
        )
    )
    mean = F.aggregate(penalties, F.lit(0.0), lambda a, x: a + x) / F.size(penalties)
    return F.when((F.col("total") > 0) & (F.col("valid") == 0), 0.02).otherwise(clip(1.0 - 0.9 * mean, 0.05, 1.0))


def trigger_errors(errors: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, category, error``: max(mean, 0.75 max) of a window's errors in a category."""
    rows = errors.where("category IS NOT NULL AND error IS NOT NULL")
    return rows.groupBy(*keys, "category").agg(F.greatest(F.avg("error"), 0.75 * F.max("error")).alias("error"))


def loudest(triggers: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """``keys, labels, severity``: the loudest firing categories (by error, then name), and max error / 1.2 within 0 to 1."""
    limit = F.create_map(*(F.lit(x) for p in LABEL_THRESHOLDS.items() for x in p))[F.col("category")]
    fired = F.when(F.col("error") > limit, F.struct((-F.col("error")).alias("e"), F.col("category").alias("c")))
    out = triggers.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(fired)), 1, top).alias("f"), F.max("error").alias("most"))
    return out.select(*keys, F.transform("f", lambda x: x["c"]).alias("labels"), clip(F.col("most") / 1.2, 0.0, 1.0).alias("severity"))


def rank_models(scores: DataFrame, model: str, overall: str = "overall") -> DataFrame:
    """``model, overall, relative, rank``: descending, models without a score last, and the distance from the mean score."""
    w = Window.orderBy(F.col(overall).desc_nulls_last(), F.col(model))  # a row for each compared model
    return scores.select(F.col(model).alias("model"), F.col(overall).alias("overall"), (F.col(overall) - F.avg(overall).over(Window.partitionBy())).alias("relative"), F.row_number().over(w).cast("long").alias("rank"))


def audit_windows(triggers: DataFrame, keys: list[str], fraction: float = 0.10, cap: int = 64) -> DataFrame:
    """``keys, window, error``: the windows whose loudest category is loudest: min(cap, max(1, round half to even of n x fraction))
    of the n that a candidate has."""
    w = Window.partitionBy(*keys)
    ranked = triggers.withColumn("n_", F.count("*").over(w)).withColumn("r_", F.row_number().over(w.orderBy(F.col("error").desc(), "window")))
    wanted = F.least(F.lit(cap), F.greatest(F.lit(1), F.bround(F.col("n_") * F.lit(fraction), 0)))
    return ranked.where(F.col("r_") <= wanted).drop("n_", "r_")


def score_formula(errors: dict[str, float]) -> float:
    """The overall score of category errors, on the driver, for reports and tests."""
    parts: dict[str, list[float]] = {}
    for c, e in errors.items():
        parts.setdefault("character_thin" if c in ("character", "thin_weapon") else c, []).append(e)
    if not all(c in parts for c in CORE):
        return math.nan
    mean = {c: sum(v) / len(v) for c, v in parts.items() if c in WEIGHTS}
    return 100 * math.exp(-sum(WEIGHTS[c] * e for c, e in mean.items()) / sum(WEIGHTS[c] for c in mean))
