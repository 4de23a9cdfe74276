"""The scan's operators, window labels and corpora over the driver tables, with their DuckDB SQL.

The frames are rendered from ``embeddings``: each vector is a scene of ``SCENE`` frames of 8 x 8 pixels in which values drift a little and odd
frames have a tenth less contrast; the vectors of a label, by id, are one stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import align, report_rules as rules, scan
from ..sources.frames import event_series, pixel_frames, table
from .queries import QUERIES, _errors, query, rounded

SCENE, UNIFORM, PICKS = 12, 8, 8


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = e.select(F.col("label").cast("long").alias("stream"), (first * SCENE).cast("long").alias("k0"), "embedding")
    e = e.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(SCENE - 1))))  # after the numbering
    light = lambda v, p: 128.0 + 240.0 * (v.cast("double") + 0.02 * F.sin(F.col("j") + p)) * (1.0 - 0.1 * (F.col("j") % 2))
    k = F.col("k0") + F.col("j")
    return e.select("stream", k.alias("k"), (k / 120.0).alias("t"), F.transform("embedding", light).alias("a"))


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.frame_scan(scenes(spark, sf_dir))


def _add(name: str, build, digits: int = 4) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(build(_scan(spark, sf_dir)), digits)


_add("frame_scan", lambda s: s)
_add("scan_cut_score", scan.cut_scores, 3)
_add("scan_scene_cuts", scan.scan_cuts)
_add("cuts_alone", scan.cuts_alone)
_add("scan_risk_parts", scan.risk_parts)
_add("scan_risk", lambda s: scan.risk(s).drop("t"), 2)
_add("global_parity", scan.global_parity)
_add("global_technical", scan.global_technical)


def _windows(s: DataFrame) -> DataFrame:
    # The scenes are their own source: frame 2i is anchor i, the frame after it belongs to pair i.
    n = F.max("k").over(Window.partitionBy("stream")) + 1
    half = s.select("stream", "k", n.alias("n")).withColumn("i", F.floor(F.col("k") / 2))
    pairs = half.select("stream", "k", F.when(F.col("k") % 2 == 0, F.col("i")).alias("anchor"), F.when((F.col("k") % 2 == 1) & (2 * F.col("i") + 2 < F.col("n")), F.col("i")).alias("pair"))
    risks = scan.risk(s).withColumn("risk", F.round("risk", 2))
    return scan.select_windows(pairs, align.cut_pairs(scan.scan_cuts(s), pairs), risks, UNIFORM, PICKS)


_add("select_windows", _windows, 2)
_add("clamped_window_times", lambda s: scan.clamped_times(s.where("k % 5 = 0").select("stream", F.col("k").alias("centre")), s))


@query
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, candidate = align.split_parity(event_series(spark, sf_dir))
    return rounded(rules.alignment_report(source, candidate, align.best_offset(align.offset_errors(source, candidate))))


@query
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as windows, their columns as category errors and features."""
    w = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_quantity") / 50).alias("motion"), (F.col("l_discount") * 10).alias("temporal"),
        (F.col("l_tax") * 10).alias("structure"), (F.col("l_orderkey") % 7 / 7.0).alias("character"), (F.col("l_partkey") % 11 / 11.0).alias("thin_weapon"), (F.col("l_suppkey") % 5 / 5.0).alias("ui"),
        (F.col("l_linenumber") / 7.0).alias("transition"), (F.col("l_partkey") % 13 / 12.0).alias("card_flip_err"), F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 12).alias("freeze_copy_score"),
        F.col("l_discount").alias("flow_fold_frac"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity") / 4).alias("char_leak_mean"), (F.col("l_tax") * 4).alias("char_ring_edge_frac"),
        (F.col("l_discount") * 6).alias("weapon_dev_p90"), F.col("l_tax").alias("event_ghost_frac"), (F.col("l_partkey") % 3 / 4.0).alias("parity"), (F.col("l_suppkey") % 3 / 3.0).alias("text"),
    )
    out = rules.window_labels(w, F.col, F.col, F.col("parity"), F.col("text"))
    return out.select("order", "line", F.array_join("labels", "+").alias("labels"), F.round("severity", 6).alias("severity"))


@query
def colour_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("v"), (1 + (F.col("l_discount") - 0.05) * 0.6).alias("gain"), ((F.col("l_tax") - 0.04) * 60).alias("offset"))
    gain, offset = F.col("gain"), F.col("offset")
    there = rules.to_candidate(F.col("v"), gain, offset)
    return rounded(d.select("l_orderkey", "l_linenumber", there.alias("there"), rules.to_source(F.col("v"), gain, offset).alias("here"), rules.to_source(there, gain, offset).alias("back"), rules.is_trivial(gain, offset).alias("trivial")))


@query
def time_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_series(spark, sf_dir)
    asked = s.where("k % 3 = 0").select("stream", (F.col("t") + F.when(F.col("k") % 2 == 0, 0.0).otherwise(5000.0)).alias("at"))
    return rounded(rules.time_to_index(s, asked.distinct()))


@query
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache identity of a file of this path, size and time."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring(F.sha1(F.concat_ws("|", F.col("source"), F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))), 1, 16).alias("hash"))


@query
def num_or_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").withColumn("x", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("o_totalprice") / 7))
    return d.select("o_orderkey", F.when(~F.isnan("x") & (F.abs("x") != float("inf")), F.round("x", 4)).alias("x"))


@query
def downscale_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area means of 2 x 2 pixels."""
    p = pixel_frames(spark, sf_dir)
    return rounded(p.groupBy("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("v").alias("v")), 5)


@query
def resize_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow field (a frame, and the frame before it) at half the size: area means of both parts, halved as they count pixels."""
    p = pixel_frames(spark, sf_dir)
    q = p.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("u"))
    small = p.join(q, ["frame", "y", "x"]).groupBy("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"))
    return rounded(small.agg((F.avg("u") * 0.5).alias("dx"), (F.avg("v") * 0.5).alias("dy")), 5)


@query
def resize_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pixel's mask at half the size."""
    p = pixel_frames(spark, sf_dir).where("y % 2 = 0 AND x % 2 = 0")
    return p.select("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), (F.col("v") > 0.1).alias("mask"))


@query
def residual_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flow without a camera's: here the frame before it is the flow's other part, and the camera turns and moves."""
    p = pixel_frames(spark, sf_dir)
    q = p.select((F.col("frame") + 1).alias("frame"), "y", "x", F.col("v").alias("u"))
    camera_x, camera_y = 0.01 * F.col("x") - 0.02 * F.col("y") + 0.1, 0.02 * F.col("x") + 0.01 * F.col("y") - 0.1
    return rounded(p.join(q, ["frame", "y", "x"]).select("frame", "y", "x", (F.col("u") - camera_x).alias("dx"), (F.col("v") - camera_y).alias("dy")), 5)


@query
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as anchors and parts as mids, each numbered by key, in one sequence."""
    anchors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    mids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_retailprice").alias("v"))
    return rounded(rules.interleave(anchors, mids))


@query
def truth_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR-like error of a candidate's odd frames against the true mids of their place, as far as both go."""
    candidate = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    truth = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("v"))
    return rounded(rules.zip_truth(candidate, truth).select("i", F.abs(F.col("v") - F.col("truth")).alias("error")))


@query
def offset_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.delayed(event_series(spark, sf_dir)).select("stream", "k", F.col("shows").cast("long").alias("shows"))


@query
def scene_cut_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.spliced(event_series(spark, sf_dir), (F.col("stream") + 1) % 100)


@query
def defect_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mids = event_series(spark, sf_dir).where("k % 2 = 1")
    return rounded(rules.defect_segments(mids, ["blur", "ghost", "freeze", "rotation_tear", "disocc_fill"]))


@query
def severity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PSNR of the mids of each level: level n has the first n of ghost, freeze, tear and fill, dealt over the frames."""
    p = pixel_frames(spark, sf_dir)
    nxt = p.select((F.col("frame") - 1).alias("frame"), "y", "x", F.col("v").alias("w"))
    three = p.join(nxt, ["frame", "y", "x"]).join(p.select((F.col("frame") - 2).alias("frame"), "y", "x", F.col("v").alias("z")), ["frame", "y", "x"])
    truth = F.col("w")
    made = {0: (F.col("v") + F.col("z")) / 2, 1: F.col("v"), 2: F.when(F.col("x") < 4, F.col("v")).otherwise(F.col("z")), 3: F.when(F.col("x") >= 6, F.lit(0.0)).otherwise(truth)}
    levels = three.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("d", F.col("frame") % 4)
    value = truth
    for d, x in made.items():
        value = F.when((F.col("d") == d) & (F.col("level") > d), x).otherwise(value)
    mse = F.avg((value - truth) * (value - truth))
    return rounded(levels.groupBy("level").agg((10.0 * F.log10(1.0 / F.greatest(mse, F.lit(1e-9)))).alias("psnr"), F.count("*").alias("n")), 5)


@query
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlations of suppliers' mean features with their balance; one feature never changes."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), F.count("*").cast("double").alias("lines"), F.lit(1.0).alias("same"))
    d = means.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rounded(rules.feature_correlations(d, "s_acctbal", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "lines", "same"], top=4))


def _audited(errors: DataFrame) -> DataFrame:
    """Of each model's windows, min(64, max(1, round half to even of a tenth)) with the loudest category."""
    from ..operators import fusion

    t = fusion.trigger_errors(errors, ["model", "window"]).groupBy("model", "window").agg(F.round(F.max("error"), 6).alias("error"))
    return fusion.audit_windows(t, ["model"])


@query
def audit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audited(_errors(spark, sf_dir))


_SCENES = f"""px AS (SELECT label::BIGINT AS stream, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * {SCENE} AS k0, embedding FROM embeddings),
fr AS (SELECT stream, (k0 + j)::BIGINT AS k, (i - 1) // 8 AS y, (i - 1) % 8 AS x, 128 + 240 * (embedding[i]::DOUBLE + 0.02 * sin(j + i - 1)) * (1 - 0.1 * (j % 2)) AS v FROM px, range({SCENE}) rj(j), range(1, 65) ri(i)),
r1 AS (SELECT *, lag(v) OVER yx AS l, lead(v) OVER yx AS r, lag(v) OVER xy AS u, lead(v) OVER xy AS d FROM fr WINDOW yx AS (PARTITION BY stream, k, y ORDER BY x), xy AS (PARTITION BY stream, k, x ORDER BY y)),
r2 AS (SELECT *, lag(d) OVER yx AS dl, lead(d) OVER yx AS dr, lag(u) OVER yx AS ul, lead(u) OVER yx AS ur FROM r1 WINDOW yx AS (PARTITION BY stream, k, y ORDER BY x)),
inn AS (SELECT stream, k, u + d + l + r - 4 * v AS lap, sqrt((ur + 2 * r + dr - ul - 2 * l - dl) ** 2 + (dl + 2 * d + dr - ul - 2 * u - ur) ** 2) AS g FROM r2 WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
own AS (SELECT stream, k, avg(v) AS luma_mean, stddev_pop(v) AS luma_std FROM fr GROUP BY ALL),
tex AS (SELECT stream, k, var_pop(lap) AS sharpness, avg(g) AS grad_energy, avg(CASE WHEN g > 60 THEN 1.0 ELSE 0 END) AS edge_frac FROM inn GROUP BY ALL),
hsh AS (SELECT stream, k, bit_or(CASE WHEN v > m THEN CASE WHEN y * 8 + x = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (y * 8 + x)::INT END ELSE 0::BIGINT END) AS hash FROM (SELECT *, median(v) OVER (PARTITION BY stream, k) AS m FROM fr) GROUP BY ALL),
hdi AS (SELECT stream, k, hash, coalesce(bit_count(xor(hash, lag(hash) OVER (PARTITION BY stream ORDER BY k)))::DOUBLE, 0) AS hash_dist FROM hsh),
dif AS (SELECT b.stream, b.k, avg(abs(b.v - a.v)) AS frame_diff FROM fr b JOIN fr a ON a.stream = b.stream AND a.k = b.k - 1 AND a.y = b.y AND a.x = b.x GROUP BY ALL),
h32 AS (SELECT stream, k, greatest(0, least(31, floor(v * 32 / 256))) AS b, count(*) / 64.0 AS p FROM fr GROUP BY ALL),
h16 AS (SELECT stream, k, greatest(0, least(15, floor(v * 16 / 256))) AS b, count(*) / 64.0 AS p FROM fr GROUP BY ALL),
c32 AS (SELECT b.stream, b.k, sum(sqrt(b.p * a.p)) AS c FROM h32 b JOIN h32 a ON a.stream = b.stream AND a.k = b.k - 1 AND a.b = b.b GROUP BY ALL),
c16 AS (SELECT b.stream, b.k, sum(sqrt(b.p * a.p)) AS c FROM h16 b JOIN h16 a ON a.stream = b.stream AND a.k = b.k - 1 AND a.b = b.b GROUP BY ALL),
sc AS (SELECT stream, k, k / 120.0::DOUBLE AS t, luma_mean, luma_std, sharpness, grad_energy, edge_frac, hash, hash_dist, coalesce(frame_diff, 0) AS frame_diff,
  CASE WHEN k = 0 THEN 0 ELSE sqrt(greatest(0, 1 - coalesce(c32.c, 0))) END AS hist_dist, CASE WHEN k = 0 THEN 0 ELSE sqrt(greatest(0, 1 - coalesce(c16.c, 0))) END AS hist16_dist
  FROM own JOIN tex USING (stream, k) JOIN hdi USING (stream, k) LEFT JOIN dif USING (stream, k) LEFT JOIN c32 USING (stream, k) LEFT JOIN c16 USING (stream, k))"""


def _z(source: str, names: tuple[str, ...], out: str) -> str:
    """Robust z of some columns within streams, as ``out``."""
    m = ", ".join(f"median({n}) AS m_{n}" for n in names)
    a = ", ".join(f"median(abs({n} - m_{n})) AS a_{n}" for n in names)
    z = ", ".join(f"({n} - m_{n}) / (1.4826 * a_{n} + 1e-6) AS z_{n}" for n in names)
    return f"""{out}_m AS (SELECT stream, {m} FROM {source} GROUP BY stream), {out}_a AS (SELECT s.stream, {a} FROM {source} s JOIN {out}_m USING (stream) GROUP BY s.stream),
{out} AS (SELECT s.*, {z} FROM {source} s JOIN {out}_m USING (stream) JOIN {out}_a USING (stream))"""


_CUT = f"{_z('sc', ('hash_dist', 'hist_dist'), 'zc')}, cuts AS (SELECT stream, k FROM zc WHERE (z_hash_dist > 6 AND hash_dist > 8) OR (z_hist_dist > 8 AND hist_dist > 0.20))"
_SCORE = f"{_z('sc', ('hash_dist', 'frame_diff'), 'zs')}, score AS (SELECT stream, k, greatest(z_hash_dist, z_frame_diff) AS score FROM zs)"
_SW = "(PARTITION BY stream ORDER BY k)"
_PARTS = f"""sg AS (SELECT *, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * coalesce(sharpness - 0.5 * (lag(sharpness) OVER {_SW} + lead(sharpness) OVER {_SW}), 0) AS sg FROM sc),
parts AS (SELECT stream, k, t, abs(sum(sg) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9) AS parity_gap, coalesce(abs(edge_frac - lag(edge_frac) OVER {_SW}), 0) AS edge_flicker,
  greatest(sum(sharpness) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 - sharpness, 0) AS sharpness_dip,
  greatest(sum(grad_energy) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 - grad_energy, 0) AS grad_drop,
  coalesce(abs(lead(luma_mean) OVER {_SW} - 2 * luma_mean + lag(luma_mean) OVER {_SW}), 0) AS luma_flash, coalesce(abs(frame_diff - lag(frame_diff) OVER {_SW}), 0) AS motion_jump FROM sg)"""
_SIX = ("parity_gap", "edge_flicker", "sharpness_dip", "grad_drop", "luma_flash", "motion_jump")
_RISK = f"""{_PARTS}, {_z('parts', _SIX, 'zp')}, {_SCORE}, risk AS (SELECT zp.stream, zp.k, t, (2 * greatest(z_parity_gap, 0) + 1.5 * greatest(z_edge_flicker, 0) + 1.5 * greatest(z_sharpness_dip, 0) + greatest(z_grad_drop, 0) * 1.5
  + 0.5 * greatest(z_luma_flash, 0) + greatest(z_motion_jump, 0)) * CASE WHEN score > 8 THEN 0.1 ELSE 1 END AS risk FROM zp JOIN score USING (stream, k))"""
_PARITY = ", ".join(
    f"round(abs(sum(CASE WHEN k % 2 = 0 THEN {c} ELSE -{c} END)) / (sum(abs({c})) + 1e-6), 4) AS parity_{p}_e_pi, round(CASE WHEN count(*) FILTER (k % 2 = 0) < 4 OR count(*) FILTER (k % 2 = 1) < 4 THEN 0 ELSE abs(avg({c}) FILTER (k % 2 = 0) - avg({c}) FILTER (k % 2 = 1)) / (avg(abs({c})) + 1e-6) END, 4) AS parity_{p}_mean_gap"
    for p, c in (("sharp", "sharpness"), ("grad", "grad_energy"), ("edge", "edge_frac"))
)
_BLOCKS = ", ".join(f"abs(sum(CASE WHEN k % 2 = 0 THEN {c} ELSE -{c} END)) / (sum(abs({c})) + 1e-6) AS {p}" for p, c in (("sharp", "sharpness"), ("grad", "grad_energy"), ("edge", "edge_frac")))


def _sql() -> dict[str, str]:
    from .oracle import _E, _OFF, _P, _S, _greedy

    fired = " UNION ALL ".join(
        f"SELECT id, {i} AS rank, '{c}' AS c, {c} AS e, {name} AS name FROM w WHERE {c} >= {limit}"
        for i, (c, limit, name) in enumerate(
            (
                ("motion", 0.45, "CASE WHEN flow_fold_frac > 0.03 THEN 'background_tear' ELSE 'motion_inconsistent' END"),
                ("temporal", 0.40, "CASE WHEN parity > 0.35 THEN 'parity_flicker' ELSE 'temporal_instability' END"),
                ("structure", 0.45, "'structure_loss'"),
                ("character", 0.40, "CASE WHEN coalesce(char_leak_mean, 99) < 6 AND char_ring_edge_frac > 0.18 THEN 'character_ghost' ELSE 'character_missing' END"),
                ("thin_weapon", 0.45, "CASE WHEN weapon_dev_p90 > 0.35 THEN 'weapon_jitter' ELSE 'thin_object_stick' END"),
                ("ui", 0.40, "CASE WHEN text > 0.5 THEN 'text_degraded' ELSE 'ui_unstable' END"),
                ("transition", 0.35, "'transition_ghost'"),
            )
        )
    )
    picks = _greedy("(SELECT stream, k, t, risk FROM cen WHERE risk > 0)", "risk", PICKS, 0.5, ">=", "picks")
    return {
        "frame_scan": f"WITH {_SCENES} SELECT stream, k, round(t, 4) AS t, round(luma_mean, 4) AS luma_mean, round(luma_std, 4) AS luma_std, round(sharpness, 4) AS sharpness, round(grad_energy, 4) AS grad_energy, round(edge_frac, 4) AS edge_frac, hash, hash_dist, round(frame_diff, 4) AS frame_diff, round(hist_dist, 4) AS hist_dist, round(hist16_dist, 4) AS hist16_dist FROM sc",
        "scan_cut_score": f"WITH {_SCENES}, {_SCORE} SELECT stream, k, round(score, 3) + 0.0 AS score FROM score",
        "scan_scene_cuts": f"WITH {_SCENES}, {_CUT} SELECT stream, k FROM cuts",
        "cuts_alone": f"WITH {_SCENES}, st AS (SELECT stream, k, hash_dist, hist16_dist FROM sc WHERE k > 0 QUALIFY count(*) OVER (PARTITION BY stream) >= 8), {_z('st', ('hash_dist', 'hist16_dist'), 'zc')} SELECT stream, k FROM zc WHERE (z_hash_dist > 6 AND hash_dist > 8) OR (z_hist16_dist > 8 AND hist16_dist > 0.35)",
        "scan_risk_parts": f"WITH {_SCENES}, {_PARTS} SELECT stream, k, round(t, 4) AS t, {', '.join(f'round({n}, 4) AS {n}' for n in _SIX)} FROM parts",
        "scan_risk": f"WITH {_SCENES}, {_RISK} SELECT stream, k, round(risk, 2) AS risk FROM risk",
        "global_parity": f"WITH {_SCENES}, b AS (SELECT *, k // 64 AS b, greatest(1, count(*) OVER (PARTITION BY stream) // 64) AS n FROM sc), e AS (SELECT stream, b, {_BLOCKS} FROM b WHERE b < n GROUP BY ALL), m AS (SELECT stream, round(max(sharp), 4) AS parity_sharp_e_pi_block_max, round(max(grad), 4) AS parity_grad_e_pi_block_max, round(max(edge), 4) AS parity_edge_e_pi_block_max FROM e GROUP BY stream), w AS (SELECT stream, {_PARITY} FROM sc GROUP BY stream) SELECT * FROM w JOIN m USING (stream)",
        "global_technical": f"WITH {_SCENES}, d AS (SELECT *, luma_mean - lag(luma_mean) OVER {_SW} AS d FROM sc) SELECT stream, round(quantile_cont(sharpness, 0.5), 4) AS gtq_global_sharp_p50, round(quantile_cont(sharpness, 0.1), 4) AS gtq_global_sharp_p10, round(avg(sharpness) FILTER (k % 2 = 1) / greatest(avg(sharpness) FILTER (k % 2 = 0), 1e-6), 4) AS gtq_global_odd_even_sharp, round(stddev_pop(d), 4) AS gtq_global_luma_flicker FROM d GROUP BY stream",
        "select_windows": f"""WITH RECURSIVE {_SCENES}, {_CUT}, {_RISK}, nf AS (SELECT stream, max(k) + 1 AS n FROM sc GROUP BY stream),
cp AS (SELECT DISTINCT stream, CASE WHEN k % 2 = 0 THEN k // 2 - 1 ELSE k // 2 END AS pair FROM cuts JOIN nf USING (stream) WHERE (k % 2 = 0 AND k > 0) OR (k % 2 = 1 AND k + 1 < n)),
c0 AS (SELECT r.stream, r.k, r.t, round(r.risk, 2) AS risk, r.k // 2 AS pair, r.k >= 2 AND r.k < n - 2 AS whole FROM risk r JOIN nf USING (stream) WHERE r.k % 2 = 1 AND r.k + 1 < n AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.stream = r.stream AND cp.pair = r.k // 2)),
c1 AS (SELECT *, bool_or(whole) OVER (PARTITION BY stream) AS any_whole FROM c0),
cen AS (SELECT stream, k, t, risk, pair, row_number() OVER (PARTITION BY stream ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY stream) AS n FROM c1 WHERE whole OR NOT any_whole),
pl AS (SELECT stream, n, least({UNIFORM}, n) AS m, unnest(range(least({UNIFORM}, n))) AS j FROM (SELECT DISTINCT stream, n FROM cen)),
uni AS (SELECT DISTINCT cen.stream, cen.k FROM pl JOIN cen ON cen.stream = pl.stream AND cen.pos = CASE WHEN m = 1 THEN 0 WHEN j = m - 1 THEN pl.n - 1 ELSE floor(j * ((pl.n - 1)::DOUBLE / (m - 1)))::BIGINT END), {picks},
a AS (SELECT cen.*, EXISTS (SELECT 1 FROM uni WHERE uni.stream = cen.stream AND uni.k = cen.k) AS u, EXISTS (SELECT 1 FROM picks WHERE picks.stream = cen.stream AND picks.k = cen.k) AS r FROM cen)
SELECT stream, k AS centre, pair, risk, CASE WHEN u AND r THEN 'uniform+risk' WHEN u THEN 'uniform' ELSE 'risk' END AS source FROM a WHERE u OR r QUALIFY row_number() OVER (PARTITION BY stream ORDER BY k) <= 256""",
        "clamped_window_times": f"WITH f AS (SELECT label::BIGINT AS stream, count(*) * {SCENE} AS n FROM embeddings GROUP BY label), c AS (SELECT stream, n, unnest(range(0, n, 5)) AS centre FROM f) SELECT stream, centre, round(greatest(centre - 2, 0) / 120.0::DOUBLE, 4) AS start, round(least(centre + 2, n - 1) / 120.0::DOUBLE, 4) AS \"end\" FROM c",
        "alignment_report": f"""WITH {_S}, {_OFF}, r AS (SELECT stream, (count(*) FILTER (k % 2 = 0) - 1) / greatest(max(t) FILTER (k % 2 = 0) - min(t) FILTER (k % 2 = 0), 1e-6) AS sr, (count(*) - 1) / greatest(max(t) - min(t), 1e-6) AS cr FROM s GROUP BY stream)
SELECT stream, round(cr / greatest(sr, 1e-6), 6) AS ratio, coalesce(off, 0) AS off, round(err, 6) AS err, concat_ws('+', CASE WHEN cr / greatest(sr, 1e-6) < 1.9 OR cr / greatest(sr, 1e-6) > 2.1 THEN 'fps_ratio' END, CASE WHEN err > 0.5 / greatest(sr, 1e-6) THEN 'pts_error' END, CASE WHEN off < 0 THEN 'negative_offset' END) AS warnings FROM r LEFT JOIN best USING (stream)""",
        "window_labels": f"""WITH w AS (SELECT row_number() OVER () AS id, l_orderkey AS "order", l_linenumber::BIGINT AS line, l_quantity / 50 AS motion, l_discount * 10 AS temporal, l_tax * 10 AS structure, l_orderkey % 7 / 7.0::DOUBLE AS character, l_partkey % 11 / 11.0::DOUBLE AS thin_weapon, l_suppkey % 5 / 5.0::DOUBLE AS ui,
  l_linenumber / 7.0::DOUBLE AS transition, l_partkey % 13 / 12.0::DOUBLE AS card_flip_err, CASE WHEN l_returnflag <> 'N' THEN l_tax * 12 END AS freeze_copy_score, l_discount AS flow_fold_frac, CASE WHEN l_returnflag = 'A' THEN l_quantity / 4 END AS char_leak_mean, l_tax * 4 AS char_ring_edge_frac, l_discount * 6 AS weapon_dev_p90,
  l_tax AS event_ghost_frac, l_partkey % 3 / 4.0::DOUBLE AS parity, l_suppkey % 3 / 3.0::DOUBLE AS text FROM lineitem),
fired AS (SELECT * FROM ({fired}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY e DESC, rank) <= 3),
named AS (SELECT id, -2 AS r, 'card_flip_error' AS name FROM w WHERE card_flip_err > 0.5 UNION ALL SELECT id, -1, 'freeze_copy' FROM w WHERE freeze_copy_score > 0.5 UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY e DESC, rank), name FROM fired),
kept AS (SELECT n.id, n.r, n.name FROM named n JOIN w USING (id) WHERE n.name <> 'transition_ghost' OR event_ghost_frac > 0.08 OR NOT EXISTS (SELECT 1 FROM named o WHERE o.id = n.id AND o.r < n.r)),
l AS (SELECT id, string_agg(name, '+' ORDER BY r) AS labels FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r) AS q FROM kept) WHERE q <= 4 GROUP BY id)
SELECT "order", line, labels, round(greatest(0, least(1, greatest(motion, temporal, structure, character, thin_weapon, ui, transition, card_flip_err, coalesce(freeze_copy_score, 0)) / 1.2)), 6) AS severity FROM w JOIN l USING (id)""",
        "colour_transforms": "WITH d AS (SELECT *, l_quantity AS v, 1 + (l_discount - 0.05) * 0.6 AS gain, (l_tax - 0.04) * 60 AS off FROM lineitem) SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(v * gain + off, 6) + 0.0 AS there, round((v - off) / greatest(0.25, least(4, gain)), 6) + 0.0 AS here, round((v * gain + off - off) / greatest(0.25, least(4, gain)), 6) + 0.0 AS back, abs(gain - 1) < 0.02 AND abs(off) < 0.5 AS trivial FROM d",
        "time_to_index": f"WITH {_S}, q AS (SELECT DISTINCT stream, t + CASE WHEN k % 2 = 0 THEN 0 ELSE 5000 END AS asked FROM s WHERE k % 3 = 0) SELECT q.stream, round(asked, 6) AS \"at\", coalesce(min(k) FILTER (s.t >= asked), max(k)) AS k FROM q JOIN s USING (stream) GROUP BY q.stream, asked",
        "content_hash": "SELECT doc_id, sha1(concat_ws('|', source, n_chars::VARCHAR, doc_id::VARCHAR))[1:16] AS hash FROM documents",
        "num_or_none": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 THEN round(o_totalprice / 7, 4) END AS x FROM orders",
        "downscale_frames": f"WITH {_P} SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v), 5) + 0.0 AS v FROM p GROUP BY ALL",
        "resize_flow": f"WITH {_P} SELECT a.frame, a.y // 2 AS y, a.x // 2 AS x, round(avg(b.v) * 0.5, 5) + 0.0 AS dx, round(avg(a.v) * 0.5, 5) + 0.0 AS dy FROM p a JOIN p b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x GROUP BY ALL",
        "resize_mask": f"WITH {_P} SELECT frame, y // 2 AS y, x // 2 AS x, v > 0.1 AS mask FROM p WHERE y % 2 = 0 AND x % 2 = 0",
        "residual_flow": f"WITH {_P} SELECT a.frame, a.y, a.x, round(b.v - (0.01 * a.x - 0.02 * a.y + 0.1), 5) + 0.0 AS dx, round(a.v - (0.02 * a.x + 0.01 * a.y - 0.1), 5) + 0.0 AS dy FROM p a JOIN p b ON b.frame = a.frame - 1 AND b.y = a.y AND b.x = a.x",
        "interleave": "SELECT 2 * s_suppkey AS frame, s_acctbal AS v FROM supplier UNION ALL SELECT 2 * p_partkey + 1, p_retailprice FROM part",
        "truth_zip": "SELECT s_suppkey AS i, round(abs(p_retailprice - s_acctbal), 6) AS error FROM part JOIN supplier ON p_partkey = 2 * s_suppkey + 1",
        "offset_candidate": f"WITH {_S} SELECT stream, k, greatest(k - 1, 0) AS shows FROM s",
        "scene_cut_set": f"WITH {_S}, h AS (SELECT stream, k, count(*) OVER (PARTITION BY stream) // 2 AS half FROM s) SELECT stream, k, CASE WHEN k < half THEN stream ELSE (stream + 1) % 100 END AS shows_stream, k = half AS cut FROM h",
        "defect_segments": f"WITH {_S}, m AS (SELECT stream, count(*) AS n, count(*) // 6 AS step FROM s WHERE k % 2 = 1 GROUP BY stream), d AS (SELECT stream, n, step, j, ['blur', 'ghost', 'freeze', 'rotation_tear', 'disocc_fill'][j + 1] AS defect FROM m, range(5) r(j)) SELECT stream, defect, (j + 1) * step AS a, least(n - 1, (j + 1) * step + greatest(4, step // 3) - 1) AS b FROM d",
        "severity_ladder": f"WITH {_P}, q AS (SELECT p.frame % 4 AS d, p.x, p.v, w.v AS w, z.v AS z FROM p JOIN p w ON w.frame = p.frame + 1 AND w.y = p.y AND w.x = p.x JOIN p z ON z.frame = p.frame + 2 AND z.y = p.y AND z.x = p.x), m AS (SELECT level, w, CASE WHEN level <= d THEN w WHEN d = 0 THEN (v + z) / 2 WHEN d = 1 THEN v WHEN d = 2 THEN CASE WHEN x < 4 THEN v ELSE z END ELSE CASE WHEN x >= 6 THEN 0 ELSE w END END AS m FROM q, range(5) r(level)) SELECT level, round(10 * log10(1 / greatest(avg((m - w) ** 2), 1e-9)), 5) AS psnr, count(*) AS n FROM m GROUP BY level",
        "feature_correlations": """WITH m AS (SELECT l_suppkey, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax, count(*)::DOUBLE AS lines, 1.0::DOUBLE AS same FROM lineitem GROUP BY l_suppkey),
d AS (SELECT m.*, s_acctbal AS y FROM m JOIN supplier ON l_suppkey = s_suppkey), l AS (UNPIVOT d ON l_quantity, l_extendedprice, l_discount, l_tax, lines, same INTO NAME feature VALUE x),
r AS (SELECT feature, x, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM l)
SELECT feature, round(abs(corr(rx, ry)), 6) AS srcc, count(*) AS n FROM r GROUP BY feature HAVING count(DISTINCT x) > 1 AND count(*) >= 6 ORDER BY srcc DESC, feature LIMIT 4""",
        "audit_windows": f"WITH {_E}, t AS (SELECT model, window_, category, greatest(avg(error), 0.75 * max(error)) AS error FROM e WHERE category IS NOT NULL AND error IS NOT NULL GROUP BY ALL), w AS (SELECT model, window_, round(max(error), 6) AS error FROM t GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY model ORDER BY error DESC, window_) AS r FROM w) SELECT model, window_ AS \"window\", error FROM n WHERE r <= least(64, greatest(1, round_even(n * 0.1, 0)))",
    }


ORACLE_SQL = _sql()
