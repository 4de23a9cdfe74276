"""DuckDB SQL for the queries of ``queries.py``, written independently of them."""

from __future__ import annotations

_S = "s AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, epoch_us(ts) / 1e6 AS t, value AS x FROM events)"
_W = "(PARTITION BY stream ORDER BY k)"
_G = f"g AS (SELECT *, coalesce(CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * (x - 0.5 * (lag(x) OVER {_W} + lead(x) OVER {_W})), 0.0) AS g, coalesce(abs(x - lag(x) OVER {_W}), 0.0) AS step FROM s)"
_C = f"""c AS (SELECT stream, k, t, x, abs(sum(g) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9) AS gap,
  greatest(sum(x) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 - x, 0.0) AS dip, step AS flicker,
  coalesce(abs(lead(x) OVER {_W} - 2 * x + lag(x) OVER {_W}), 0.0) AS flash, coalesce(abs(step - lag(step) OVER {_W}), 0.0) AS jump FROM g)"""
_BASE = f"{_S}, {_G}, {_C}"
_NAMES = ("gap", "dip", "flicker", "flash", "jump")
_Z = (
    "m1 AS (SELECT stream, " + ", ".join(f"median({n}) AS m_{n}" for n in _NAMES) + " FROM c GROUP BY stream), "
    "m2 AS (SELECT c.stream, " + ", ".join(f"median(abs({n} - m_{n})) AS a_{n}" for n in _NAMES) + " FROM c JOIN m1 USING (stream) GROUP BY c.stream), "
    "z AS (SELECT c.*, " + ", ".join(f"({n} - m_{n}) / (1.4826 * a_{n} + 1e-6) AS z_{n}" for n in _NAMES) + " FROM c JOIN m1 USING (stream) JOIN m2 USING (stream))"
)
_RISK = "risk AS (SELECT stream, k, t, z_flicker AS cut, (2.0 * greatest(z_gap, 0) + 1.5 * greatest(z_dip, 0) + greatest(z_flicker, 0) + 0.5 * greatest(z_flash, 0) + greatest(z_jump, 0)) * CASE WHEN z_flicker > 8 THEN 0.1 ELSE 1 END AS risk FROM z)"
_CUTS = "cuts AS (SELECT stream, k, flicker, z_flicker AS z FROM z WHERE z_flicker > 3 AND flicker > 20)"


def _greedy(source: str, value: str, top: int, gap: float, far: str, name: str) -> str:
    """Recursive greedy picks by falling ``value``; ``far`` compares a distance with the gap."""
    return f"""o AS (SELECT stream, k, t, {value} AS v, row_number() OVER (PARTITION BY stream ORDER BY {value} DESC, k, t) AS r FROM {source}),
rec AS (SELECT stream, 0::BIGINT AS r, []::DOUBLE[] AS ts, []::BIGINT[] AS ks, []::DOUBLE[] AS vs FROM (SELECT DISTINCT stream FROM o)
  UNION ALL
  SELECT rec.stream, o.r, CASE WHEN ok THEN list_append(ts, o.t) ELSE ts END, CASE WHEN ok THEN list_append(ks, o.k) ELSE ks END, CASE WHEN ok THEN list_append(vs, o.v) ELSE vs END
  FROM rec JOIN o ON o.stream = rec.stream AND o.r = rec.r + 1, LATERAL (SELECT len(ts) < {top} AND len(list_filter(ts, lambda p: NOT (abs(p - o.t) {far} {gap}))) = 0 AS ok)),
{name} AS (SELECT stream, unnest(ks) AS k, unnest(ts) AS t, unnest(vs) AS value FROM rec QUALIFY r = max(r) OVER (PARTITION BY stream))"""


_NMS = _greedy("(SELECT * FROM c WHERE flicker > 0)", "flicker", 8, 36000.0, ">=", "picks")
_UNIFORM = """odd AS (SELECT stream, k, row_number() OVER (PARTITION BY stream ORDER BY k) - 1 AS pos, count(*) OVER (PARTITION BY stream) AS c FROM (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM s) WHERE k % 2 = 1 AND k >= 2 AND k < n - 2),
places AS (SELECT stream, c, least(8, c) AS m, unnest(range(least(8, c))) AS j FROM (SELECT DISTINCT stream, c FROM odd)),
uni AS (SELECT DISTINCT odd.stream, odd.k FROM places JOIN odd ON odd.stream = places.stream AND odd.pos = CASE WHEN j = m - 1 THEN CASE WHEN m = 1 THEN 0 ELSE places.c - 1 END ELSE floor(j * ((places.c - 1)::DOUBLE / greatest(m - 1, 1)))::BIGINT END)"""
_WIN = """wf AS (SELECT uni.stream, uni.k AS centre, p AS pos, s.k, s.t, s.x FROM uni, range(5) r(p), s WHERE s.stream = uni.stream AND s.k = uni.k - 2 + p QUALIFY count(*) OVER (PARTITION BY uni.stream, uni.k) = 5)"""
_OFF = """src AS (SELECT stream, k // 2 AS i, t, x, count(*) OVER (PARTITION BY stream) AS n FROM s WHERE k % 2 = 0),
picked AS (SELECT DISTINCT stream, CASE WHEN j = m - 1 THEN n - 1 ELSE floor(j * ((n - 1)::DOUBLE / greatest(m - 1, 1)))::BIGINT END AS i FROM (SELECT stream, n, least(64, n) AS m, unnest(range(least(64, n))) AS j FROM (SELECT DISTINCT stream, n FROM src))),
errs AS (SELECT src.stream, off, avg(abs(s.t - src.t)) AS err, count(*) AS n FROM src JOIN picked USING (stream, i), range(-3, 4) o(off), s WHERE s.stream = src.stream AND s.k = 2 * src.i + off GROUP BY ALL HAVING count(*) >= 4),
best AS (SELECT stream, off, err FROM errs QUALIFY row_number() OVER (PARTITION BY stream ORDER BY err, off) = 1)"""
_PAIR = """pm AS (SELECT s.stream, s.k, CASE WHEN (k - off) % 2 = 0 AND fd >= 0 AND fd < n THEN fd END AS anchor, CASE WHEN (k - off) % 2 <> 0 AND fd >= 0 AND fd < n - 1 THEN fd END AS pair
  FROM s JOIN best USING (stream) JOIN (SELECT stream, count(*) AS n FROM src GROUP BY stream) USING (stream), LATERAL (SELECT floor((k - off) / 2.0)::BIGINT AS fd))"""
_CUTPAIR = "cp AS (SELECT DISTINCT stream, pair FROM (SELECT stream, anchor - 1 AS pair FROM cuts JOIN pm USING (stream, k) WHERE anchor > 0 UNION ALL SELECT stream, pair FROM cuts JOIN pm USING (stream, k) WHERE pair IS NOT NULL))"
_ALIGN = f"{_BASE}, {_Z}, {_CUTS}, {_OFF}, {_PAIR}, {_CUTPAIR}"

#: The feature registry, written out here again so that a wrong constant in the engine shows.
_DIM = """dim(feature, category, kind, scale, reference, width) AS (VALUES
  ('comp_mean', 'motion', 'fwd', 0.18::DOUBLE, NULL, NULL),
  ('comp_p90_max', 'motion', 'fwd', 0.45::DOUBLE, NULL, NULL),
  ('comp_leg_ratio', 'motion', 'fwd', 0.25::DOUBLE, NULL, NULL),
  ('comp_fwd_p90', 'motion', 'fwd', 0.45::DOUBLE, NULL, NULL),
  ('comp_bwd_p90', 'motion', 'fwd', 0.45::DOUBLE, NULL, NULL),
  ('flow_fold_frac', 'motion', 'fwd', 0.1::DOUBLE, NULL, NULL),
  ('flow_jdet_low_frac', 'motion', 'fwd', 0.2::DOUBLE, NULL, NULL),
  ('comp_occ_region_mean', 'motion', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('mct_lag1_mean', 'temporal', 'fwd', 30.0::DOUBLE, NULL, NULL),
  ('mct_lag1_p90', 'temporal', 'fwd', 45.0::DOUBLE, NULL, NULL),
  ('mct_anchor_vs_gen_ratio', 'temporal', 'fwd', 1.5::DOUBLE, NULL, NULL),
  ('cycle_resid_mean', 'temporal', 'fwd', 35.0::DOUBLE, NULL, NULL),
  ('cycle_resid_p90', 'temporal', 'fwd', 100.0::DOUBLE, NULL, NULL),
  ('cycle_sharp_loss', 'temporal', 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('freeze_copy_score', 'temporal', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('parity_window_sharp_gap', 'temporal', 'fwd', 0.25::DOUBLE, NULL, NULL),
  ('parity_lag2_gen_vs_anchor', 'temporal', 'fwd', 1.5::DOUBLE, NULL, NULL),
  ('parity_sharp_e_pi_block_max', 'temporal', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('parity_sharp_mean_gap', 'temporal', 'fwd', 0.45::DOUBLE, NULL, NULL),
  ('edge_count_odd_even_ratio', 'temporal', 'ratio', 0.35::DOUBLE, NULL, NULL),
  ('gtq_sharp_odd_even_ratio', 'temporal', 'ratio', 0.25::DOUBLE, NULL, NULL),
  ('edge_recall', 'structure', 'inv', NULL, 0.75::DOUBLE, 0.45::DOUBLE),
  ('edge_precision', 'structure', 'inv', NULL, 0.9::DOUBLE, 0.3::DOUBLE),
  ('edge_inst_recall_med', 'structure', 'inv', NULL, 0.3::DOUBLE, 0.35::DOUBLE),
  ('edge_inst_recall_p10', 'structure', 'inv', NULL, 0.15::DOUBLE, 0.35::DOUBLE),
  ('edge_chamfer_sup_to_em', 'structure', 'fwd', 6.0::DOUBLE, NULL, NULL),
  ('edge_ghost_frac', 'structure', 'fwd', 0.2::DOUBLE, NULL, NULL),
  ('char_missing_frac', 'character', 'fwd', 0.45::DOUBLE, NULL, NULL),
  ('char_extra_frac', 'character', 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('char_chamfer', 'character', 'fwd', 150.0::DOUBLE, NULL, NULL),
  ('char_components_delta', 'character', 'fwd', 3.0::DOUBLE, NULL, NULL),
  ('char_leak_mean', 'character', 'inv', NULL, 10.0::DOUBLE, 10.0::DOUBLE),
  ('char_ring_edge_frac', 'character', 'fwd', 0.35::DOUBLE, NULL, NULL),
  ('thin_layer_err', 'thin_weapon', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('thin_inst_err_p90', 'thin_weapon', 'fwd', 0.7::DOUBLE, NULL, NULL),
  ('thin_attrib_fail_frac', 'thin_weapon', 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('thin_count_odd_even_ratio', 'thin_weapon', 'ratio', 0.45::DOUBLE, NULL, NULL),
  ('weapon_dev_p90', 'thin_weapon', 'fwd', 0.6::DOUBLE, NULL, NULL),
  ('weapon_dir_change_p90', 'thin_weapon', 'fwd', 1.0::DOUBLE, NULL, NULL),
  ('ui_static_l1', 'ui', 'fwd', 6.0::DOUBLE, NULL, NULL),
  ('ui_static_grad', 'ui', 'fwd', 20.0::DOUBLE, NULL, NULL),
  ('ui_static_edge_f', 'ui', 'inv', NULL, 0.85::DOUBLE, 0.35::DOUBLE),
  ('ui_comp_drift_p90', 'ui', 'fwd', 8.0::DOUBLE, NULL, NULL),
  ('ui_gen_drift', 'ui', 'fwd', 6.0::DOUBLE, NULL, NULL),
  ('ui_dyn_blend_frac', 'ui', 'fwd', 0.15::DOUBLE, NULL, NULL),
  ('ui_dyn_out_of_range_frac', 'ui', 'fwd', 0.15::DOUBLE, NULL, NULL),
  ('ui_dyn_regression', 'ui', 'fwd', 0.2::DOUBLE, NULL, NULL),
  ('text_edge_f', 'ui', 'inv', NULL, 0.8::DOUBLE, 0.4::DOUBLE),
  ('text_grad_loss', 'ui', 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('text_comp_ratio', 'ui', 'ratio', 0.6::DOUBLE, NULL, NULL),
  ('event_ghost_frac', 'transition', 'fwd', 0.15::DOUBLE, NULL, NULL),
  ('event_regression', 'transition', 'fwd', 0.2::DOUBLE, NULL, NULL),
  ('card_flip_err', 'transition', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('gtq_blockiness', 'global', 'fwd', 0.6::DOUBLE, NULL, NULL),
  ('gtq_noise', 'global', 'fwd', 16.0::DOUBLE, NULL, NULL),
  ('anchor_y_l1_p90', 'global', 'fwd', 12.0::DOUBLE, NULL, NULL),
  ('anchor_shift_better_frac', 'global', 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('comp_fwd_mean', NULL, 'fwd', 0.18::DOUBLE, NULL, NULL),
  ('comp_bwd_mean', NULL, 'fwd', 0.18::DOUBLE, NULL, NULL),
  ('flow_div_std', NULL, 'fwd', 1.5::DOUBLE, NULL, NULL),
  ('flow_curl_std', NULL, 'fwd', 1.5::DOUBLE, NULL, NULL),
  ('mct_lag2_mean', NULL, 'fwd', 30.0::DOUBLE, NULL, NULL),
  ('parity_sharp_e_pi', NULL, 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('parity_grad_mean_gap', NULL, 'fwd', 0.3::DOUBLE, NULL, NULL),
  ('parity_edge_mean_gap', NULL, 'fwd', 0.5::DOUBLE, NULL, NULL),
  ('gtq_global_odd_even_sharp', NULL, 'ratio', 0.25::DOUBLE, NULL, NULL)
)"""
_F = """f AS (SELECT l_suppkey AS model, l_orderkey * 8 + l_linenumber AS window_, feature, value FROM lineitem, LATERAL (VALUES ('comp_mean', l_discount), ('mct_lag1_mean', l_quantity), ('edge_recall', 1 - 10 * l_tax), ('gtq_sharp_odd_even_ratio', 1 + l_tax - l_discount), ('ui_static_l1', l_quantity / 10),
  ('gtq_blockiness', 1 + l_discount), ('thin_layer_err', l_tax * 5), ('char_extra_frac', l_discount * 2), ('parity_sharp_e_pi', l_tax)) v(feature, value))"""
_ERR = "CASE kind WHEN 'ratio' THEN greatest(0, least(1.5, abs(v - 1) / scale)) WHEN 'inv' THEN greatest(0, least(1.5, (reference - v) / width)) WHEN 'fwd' THEN 1 - exp(-greatest(v, 0) / scale) END"
_E = f"{_DIM}, {_F}, e AS (SELECT model, window_, feature, category, {_ERR} AS error FROM (SELECT *, CASE WHEN feature = 'gtq_blockiness' THEN value - 1 ELSE value END AS v FROM f LEFT JOIN dim USING (feature)))"
_TAIL = "0.4 * quantile_cont({0}, 0.5) + 0.4 * quantile_cont({0}, 0.9) + 0.2 * quantile_cont({0}, 0.99)"
_CAT = f"{_E}, we AS (SELECT model, window_, category, avg(error) AS error FROM e WHERE category IS NOT NULL AND error IS NOT NULL GROUP BY ALL), cat AS (SELECT model, category, {_TAIL.format('error')} AS error FROM we GROUP BY ALL)"
#: The weights of the score's parts.
_WEIGHT = "CASE part WHEN 'motion' THEN 0.25 WHEN 'temporal' THEN 0.20 WHEN 'structure' THEN 0.20 WHEN 'character_thin' THEN 0.15 WHEN 'ui' THEN 0.10 WHEN 'transition' THEN 0.05 WHEN 'global' THEN 0.05 END"
#: Errors from which a category labels a window.
_LIMIT = "CASE category WHEN 'motion' THEN 0.45 WHEN 'temporal' THEN 0.40 WHEN 'structure' THEN 0.45 WHEN 'character' THEN 0.40 WHEN 'thin_weapon' THEN 0.45 WHEN 'ui' THEN 0.40 WHEN 'transition' THEN 0.35 END"


def _overall(where: str = "TRUE") -> str:
    return f"""parts AS (SELECT model, CASE WHEN category IN ('character', 'thin_weapon') THEN 'character_thin' ELSE category END AS part, avg(error) AS error FROM cat WHERE {where} GROUP BY ALL),
overall AS (SELECT model, CASE WHEN count(*) FILTER (part IN ('motion', 'temporal', 'structure')) = 3 THEN 100 * exp(-sum({_WEIGHT} * error) / sum({_WEIGHT})) END AS overall, count(*) AS parts FROM parts GROUP BY model)"""


_P = "p AS (SELECT vec_id AS frame, label::BIGINT AS scene, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i))"
_N = "n AS (SELECT frame, scene, y, x, v, w FROM (SELECT *, lead(v) OVER nx AS w, lead(frame) OVER nx AS f FROM p WINDOW nx AS (PARTITION BY y, x ORDER BY frame)) WHERE f = frame + 1)"
_ROW, _COL = "(PARTITION BY frame, y ORDER BY x)", "(PARTITION BY frame, x ORDER BY y)"
_LAP = f"l AS (SELECT * FROM (SELECT frame, lag(v) OVER {_COL} + lead(v) OVER {_COL} + lag(v) OVER {_ROW} + lead(v) OVER {_ROW} - 4 * v AS l FROM p) WHERE l IS NOT NULL)"
_HIST = "h AS (SELECT frame, bin, n / sum(n) OVER (PARTITION BY frame) AS share FROM (SELECT frame, greatest(0, least(7, floor((v + 0.4) / (0.8 / 8))))::BIGINT AS bin, count(*) AS n FROM p GROUP BY ALL))"
_BIT = "hash AS (SELECT frame, bit_or(CASE WHEN v > m THEN CASE WHEN y * 8 + x = 63 THEN (-9223372036854775808)::BIGINT ELSE 1::BIGINT << (y * 8 + x)::INT END ELSE 0::BIGINT END) AS hash FROM (SELECT *, median(v) OVER (PARTITION BY frame) AS m FROM p) GROUP BY frame)"


def _slope(c: str, w: str) -> str:
    return f"CASE WHEN lag({c}) OVER {w} IS NULL THEN lead({c}) OVER {w} - {c} WHEN lead({c}) OVER {w} IS NULL THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"


def _mid(value: str) -> str:
    return f"WITH {_P}, {_N} SELECT frame, y, x, round({value}, 5) + 0.0 AS v FROM n"


def _detect(keys: str) -> str:
    return f"SELECT {keys}, tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c"


def _pairwise(source: str, key: str) -> str:
    return f"WITH m AS ({source}) SELECT a.{key} AS \"{key}\", count(*) AS pairs, round(avg(CASE WHEN sign(a.score - b.score) = sign(a.quality - b.quality) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM m a JOIN m b ON a.id < b.id AND a.{key} = b.{key} AND a.quality <> b.quality GROUP BY ALL"


_RANKED = "(rank() OVER (PARTITION BY grp ORDER BY {0}) + (count(*) OVER (PARTITION BY grp, {0}) - 1) / 2.0)"

ORACLE_SQL = {
    "scan_lag_stats": f"WITH {_S} SELECT stream, k, round(x, 6) AS x, round(coalesce(x - lag(x) OVER {_W}, 0), 6) AS dx, round(coalesce(abs(x - lag(x) OVER {_W}), 0), 6) AS abs_dx, round(coalesce(t - lag(t) OVER {_W}, 0), 6) AS dt FROM s",
    "parity_gap": f"WITH {_BASE} SELECT stream, k, round(gap, 6) AS gap FROM c",
    "risk_components": f"WITH {_BASE} SELECT stream, k, round(t, 6) AS t, round(x, 6) AS x, round(gap, 6) AS gap, round(dip, 6) AS dip, round(flicker, 6) AS flicker, round(flash, 6) AS flash, round(jump, 6) AS jump FROM c",
    "robust_z": f"WITH {_S}, m AS (SELECT stream, median(x) AS m FROM s GROUP BY stream), a AS (SELECT stream, median(abs(x - m)) AS a FROM s JOIN m USING (stream) GROUP BY stream) SELECT stream, k, round(x, 4) AS x, round((x - m) / (1.4826 * a + 1e-6), 4) AS z_x FROM s JOIN m USING (stream) JOIN a USING (stream)",
    "risk_timeline": f"WITH {_BASE}, {_Z}, {_RISK} SELECT stream, k, round(t, 3) AS t, round(cut, 3) + 0.0 AS cut, round(risk, 3) AS risk FROM risk",
    "scene_cuts": f"WITH {_BASE}, {_Z}, {_CUTS} SELECT stream, k, round(flicker, 4) AS flicker, round(z, 4) AS z FROM cuts",
    "parity_summary": f"WITH {_S} SELECT stream, round(abs(sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END)) / (sum(abs(x)) + 1e-6), 6) AS e_pi, round(CASE WHEN count(*) FILTER (k % 2 = 0) < 4 OR count(*) FILTER (k % 2 = 1) < 4 THEN 0 ELSE abs(avg(x) FILTER (k % 2 = 0) - avg(x) FILTER (k % 2 = 1)) / (avg(abs(x)) + 1e-6) END, 6) AS mean_gap FROM s GROUP BY stream",
    "alternation_block_max": f"WITH {_S}, b AS (SELECT *, k // 16 AS b, greatest(1, count(*) OVER (PARTITION BY stream) // 16) AS n FROM s), e AS (SELECT stream, b, abs(sum(CASE WHEN k % 2 = 0 THEN x ELSE -x END)) / (sum(abs(x)) + 1e-6) AS e FROM b WHERE b < n GROUP BY ALL) SELECT stream, round(max(e), 6) AS e_pi_block_max, count(*) AS blocks FROM e GROUP BY stream",
    "technical_summary": f"WITH {_S}, d AS (SELECT *, x - lag(x) OVER {_W} AS d FROM s) SELECT stream, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.1), 6) AS p10, round(avg(x) FILTER (k % 2 = 1) / avg(x) FILTER (k % 2 = 0), 6) AS odd_even, round(stddev_pop(d), 6) AS flicker FROM d GROUP BY stream",
    "percentiles": f"WITH {_S} SELECT stream, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.99), 6) AS p99 FROM s GROUP BY stream",
    "tail_aggregate": f"WITH {_S} SELECT stream, round({_TAIL.format('x')}, 6) AS tail FROM s GROUP BY stream",
    "charbonnier": f"WITH {_S} SELECT stream, k, round(sqrt(x * x + 16) - 4, 6) AS c FROM s",
    "uniform_windows": f"WITH {_S}, {_UNIFORM} SELECT stream, k FROM uni",
    "temporal_nms": f"WITH RECURSIVE {_BASE}, {_NMS} SELECT stream, k, round(t, 6) AS t, round(value, 6) AS value FROM picks",
    "window_union": f"WITH RECURSIVE {_BASE}, {_NMS}, {_UNIFORM} SELECT stream, k, string_agg(src, '+' ORDER BY src DESC) AS source FROM (SELECT stream, k, 'uniform' AS src FROM uni UNION SELECT stream, k, 'risk' FROM picks) GROUP BY ALL",
    "window_explode": f"WITH {_S}, {_UNIFORM}, {_WIN} SELECT stream, centre, pos, k, round(t, 6) AS t, round(x, 6) AS x FROM wf",
    "window_times": f"WITH {_S}, {_UNIFORM}, {_WIN} SELECT stream, centre, round(min(t), 6) AS start, round(max(t), 6) AS \"end\" FROM wf GROUP BY ALL",
    "window_parity_gap": f"WITH {_S}, {_UNIFORM}, {_WIN} SELECT stream, centre, round(abs(avg(x) FILTER (k % 2 = 0) - avg(x) FILTER (k % 2 = 1)) / (median(x) + 1e-6), 6) AS gap FROM wf GROUP BY ALL",
    "gap_runs": "WITH r AS (SELECT DISTINCT l_suppkey AS stream, l_orderkey AS idx FROM lineitem), n AS (SELECT *, coalesce((idx - lag(idx) OVER (PARTITION BY stream ORDER BY idx) > 32)::INT, 0) AS new FROM r), g AS (SELECT *, sum(new) OVER (PARTITION BY stream ORDER BY idx ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM n) SELECT stream, run, min(idx) AS first, max(idx) AS last, count(*) AS n FROM g GROUP BY ALL",
    "session_windows": "WITH n AS (SELECT *, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR)::INT, 0) AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT user_id AS stream, min(epoch_us(ts)) AS first_us, count(*) AS n, round(sum(value), 6) AS total FROM g GROUP BY user_id, run",
    "tumbling_blocks": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "sliding_windows": "WITH w AS (SELECT epoch_us(date_trunc('hour', ts)) - h * 3600000000 AS start_us, value FROM events, range(5) r(h)) SELECT start_us, count(*) AS n, round(max(value), 6) AS most FROM w GROUP BY ALL",
    "pts_offset_search": f"WITH {_S}, {_OFF} SELECT stream, off, round(err, 6) AS err FROM best",
    "offset_errors": f"WITH {_S}, {_OFF} SELECT stream, off, round(err, 4) AS err, n FROM errs",
    "anchor_pair_map": f"WITH {_S}, {_OFF}, {_PAIR} SELECT stream, k, anchor::DOUBLE AS anchor, pair::DOUBLE AS pair FROM pm",
    "asof_nearest": f"WITH {_S}, r AS (SELECT stream, k // 2 AS i, t FROM s WHERE k % 2 = 0), j AS (SELECT s.stream, s.k, s.t, r.i AS m, abs(s.t - r.t) AS dt FROM s JOIN r ON s.stream = r.stream AND abs(s.t - r.t) <= 7200 WHERE s.k % 2 = 1 QUALIFY row_number() OVER (PARTITION BY s.stream, s.k ORDER BY dt, m) = 1) SELECT stream, k, round(t, 6) AS t, m AS match, round(dt, 6) AS dt FROM j",
    "cut_pairs": f"WITH {_ALIGN} SELECT stream, pair FROM cp",
    "cut_anti_join": f"WITH {_ALIGN} SELECT stream, k, pair FROM pm WHERE pair IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.stream = pm.stream AND cp.pair = pm.pair)",
    "pair_semi_join": f"WITH {_S}, {_OFF}, {_PAIR}, {_UNIFORM} SELECT stream, k FROM uni WHERE EXISTS (SELECT 1 FROM pm WHERE pm.stream = uni.stream AND pm.k = uni.k AND pair IS NOT NULL)",
    "cached_anti_join": f"WITH {_S}, {_UNIFORM}, {_WIN} SELECT DISTINCT stream, k FROM wf WHERE k % 3 <> 0",
    "interval_overlap_detection": f"""WITH {_BASE}, {_Z}, {_CUTS}, found AS (SELECT cuts.stream, cuts.k, s.t - 7200 AS a, s.t + 7200 AS b, CASE WHEN flicker > 60 THEN ['cut', 'flash'] ELSE ['cut'] END AS labels FROM cuts JOIN s USING (stream, k)),
span AS (SELECT stream, min(t) AS a, (max(t) - min(t)) / 4 AS q FROM s GROUP BY stream), truth AS (SELECT stream, seg, a + seg * q AS t0, a + (seg + 0.5) * q AS t1, CASE WHEN seg % 2 = 0 THEN ['flash'] ELSE ['cut', 'tear'] END AS expected FROM span, range(4) r(seg))
SELECT found.stream, k, seg FROM found JOIN truth ON found.stream = truth.stream AND found.a <= t1 + 600 AND found.b >= t0 - 600 AND list_has_any(labels, expected)""",
    "report_left_join": "SELECT o_orderkey, o_orderstatus, round(worst, 6) AS worst FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS worst FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "normalize_errors": f"WITH {_E} SELECT feature, category, count(error) AS n, round(avg(error), 6) AS mean, round(min(error), 6) AS least, round(max(error), 6) AS most FROM e GROUP BY ALL",
    "feature_registry": f"WITH {_DIM} SELECT * FROM dim",
    "category_tail_aggregate": f"WITH {_CAT} SELECT model, category, round(error, 6) AS error, round(100 * exp(-1.8 * error), 6) AS subscore FROM cat",
    "overall_score": f"WITH {_CAT}, {_overall()} SELECT model, round(overall, 4) AS overall, parts FROM overall",
    "fail_closed": f"WITH {_CAT}, {_overall("NOT (category = 'structure' AND model % 2 = 1)")} SELECT model, round(overall, 4) AS overall, parts FROM overall",
    "model_ranking": f"WITH {_CAT}, {_overall("NOT (category = 'structure' AND model % 7 = 1)")}, r AS (SELECT model, round(overall, 6) AS overall FROM overall) SELECT model, round(overall, 4) AS overall, round(overall - avg(overall) OVER (), 4) AS relative, row_number() OVER (ORDER BY r.overall DESC NULLS LAST, model) AS rank FROM r",
    "trigger_errors": f"WITH {_E}, t AS (SELECT model, window_, category, greatest(avg(error), 0.75 * max(error)) AS error FROM e WHERE category IS NOT NULL AND error IS NOT NULL GROUP BY ALL) SELECT model, category, round(max(error), 6) AS most, round(avg(error), 6) AS mean FROM t GROUP BY ALL",
    "worst_categories": f"WITH {_CAT}, x AS (SELECT model, category, round(error, 6) AS error, {_LIMIT} AS lim FROM cat), fired AS (SELECT model, category, row_number() OVER (PARTITION BY model ORDER BY error DESC, category) AS r FROM x WHERE error > lim) SELECT model, coalesce((SELECT string_agg(category, '+' ORDER BY r) FROM fired WHERE fired.model = x.model AND r <= 3), '') AS labels, round(greatest(0, least(1, max(error) / 1.2)), 6) AS severity FROM x GROUP BY model",
    "confidence": """WITH m AS (SELECT l_suppkey AS model, count(*) AS total, count(*) FILTER (l_returnflag <> 'R') AS valid, avg(l_discount) AS visible, count(DISTINCT l_linenumber) + 2.0 AS keys, avg(l_tax) AS ambiguity, avg(l_quantity) AS anchor_error, count(*) FILTER (l_quantity > 49) AS warnings, avg(l_linenumber) / 3000 AS wpf FROM lineitem GROUP BY ALL),
p AS (SELECT model, total, valid, list_filter([1.0 - valid / total, greatest(0, least(1, (0.75 - visible) / 0.5)), greatest(0, least(1, (12 - keys) / 12)), 0.5 * greatest(0, least(1, 1.5 * ambiguity)), greatest(0, least(1, (anchor_error - 8) / 30)), CASE WHEN warnings > 0 THEN least(0.4, 0.15 * warnings) END, greatest(0, least(0.5, (0.01 - 5 * wpf) / 0.01))], lambda x: x IS NOT NULL) AS p FROM m)
SELECT model, round(CASE WHEN total > 0 AND valid = 0 THEN 0.02 ELSE greatest(0.05, least(1, 1 - 0.9 * list_sum(p) / len(p))) END, 6) AS confidence FROM p""",
    "feature_median_export": f"WITH {_F} SELECT feature, round(quantile_cont(value, 0.5), 5) AS median FROM f WHERE feature NOT LIKE 'parity%' GROUP BY ALL",
    "severity_dedupe": f"WITH RECURSIVE {_BASE}, {_greedy('c', 'x', 5, 36000.0, '>', 'picks')} SELECT stream, k, round(t, 6) AS t, round(value, 6) AS severity FROM picks",
    "worst_streams": f"""WITH RECURSIVE {_BASE}, {_Z}, {_RISK}, {_greedy('(SELECT stream, k, t, round(risk, 3) AS risk FROM risk WHERE round(risk, 3) > 0)', 'risk', 8, 36000.0, '>=', 'picks')}, {_UNIFORM},
u AS (SELECT stream, k FROM uni UNION SELECT stream, k FROM picks), wf AS (SELECT u.stream, u.k AS centre, s.k, s.x FROM u JOIN s ON s.stream = u.stream AND s.k BETWEEN u.k - 2 AND u.k + 2 QUALIFY count(*) OVER (PARTITION BY u.stream, u.k) = 5),
w AS (SELECT stream, centre, 1 - exp(-greatest(abs(avg(x) FILTER (k % 2 = 0) - avg(x) FILTER (k % 2 = 1)) / (median(x) + 1e-6), 0) / 0.25) AS e FROM wf GROUP BY ALL),
a AS (SELECT stream, {_TAIL.format('e')} AS error, count(*) AS windows FROM w GROUP BY stream), r AS (SELECT stream, windows, round(error, 6) AS error, round(100 * exp(-1.8 * a.error), 4) AS score FROM a)
SELECT *, row_number() OVER (ORDER BY score, stream) AS rank FROM r""",
    "color_fit": "WITH d AS (SELECT l_returnflag, l_linestatus, l_quantity * 5 AS s, l_extendedprice / 500 AS c FROM lineitem), f AS (SELECT l_returnflag, l_linestatus, greatest(0.5, least(2.0, regr_slope(c, s))) AS gain, greatest(-64, least(64, regr_intercept(c, s))) AS off FROM d GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(gain, 4) AS gain, round(off, 4) AS offset, round(avg(abs(c - (gain * s + off))), 4) AS residual FROM d JOIN f USING (l_returnflag, l_linestatus) GROUP BY l_returnflag, l_linestatus, gain, off",
    "median_combine": "SELECT grp, round(median(gain), 4) AS gain FROM (SELECT l_suppkey % 10 AS grp, regr_slope(l_extendedprice, l_quantity) AS gain FROM lineitem GROUP BY l_suppkey) GROUP BY grp",
    "rank_correlations": f"WITH d AS (SELECT l_suppkey, l_suppkey % 4 AS grp, round(avg(l_quantity), 1) AS a, round(avg(l_extendedprice), 0) AS b FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, {_RANKED.format('a')} AS ra, {_RANKED.format('b')} AS rb FROM d) SELECT grp, round(corr(ra, rb), 6) AS srcc, round(corr(a, b), 6) AS plcc, count(*) AS n FROM r GROUP BY grp",
    "pairwise_accuracy": _pairwise('SELECT s_suppkey AS id, s_acctbal AS score, s_suppkey % 5 AS quality, 1::BIGINT AS "all" FROM supplier', "all").replace("a.all AS", 'a."all" AS').replace("a.all = b.all", 'a."all" = b."all"'),
    "within_group_pairwise": _pairwise("SELECT s_suppkey AS id, round(s_acctbal, -3) AS score, s_suppkey % 5 AS quality, s_nationkey::BIGINT AS seed FROM supplier", "seed"),
    "detection_prf1": f"WITH c AS (SELECT toxic::BIGINT AS toxic, count(*) FILTER (n_chars > 1500 AND quality = 1) AS tp, count(*) FILTER (n_chars > 1500 AND quality <> 1) AS fp, count(*) FILTER (n_chars <= 1500 AND quality = 1) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY ALL) {_detect('toxic')}",
    "set_operations": "SELECT 'union' AS op, id FROM (SELECT user_id AS id FROM events UNION SELECT o_custkey % 200 FROM orders) UNION ALL SELECT 'intersect', id FROM (SELECT user_id AS id FROM events INTERSECT SELECT o_custkey % 200 FROM orders) UNION ALL SELECT 'except', id FROM (SELECT user_id AS id FROM events EXCEPT SELECT o_custkey % 200 FROM orders)",
    "parity_in_dialogue": "SELECT conv_id, round(avg(length(text)) FILTER (turn % 2 = 0), 6) AS even, round(avg(length(text)) FILTER (turn % 2 = 1), 6) AS odd, count(*) AS turns FROM conversations GROUP BY conv_id",
    "pixel_luma_l1": f"WITH {_P}, {_N} SELECT frame, round(avg(abs(v - w)), 5) AS l1 FROM n GROUP BY frame",
    "psnr": f"WITH {_P}, {_N} SELECT frame, round(10 * log10(1.0 / greatest(avg((v - w) * (v - w)), 1e-9)), 5) AS psnr FROM n GROUP BY frame",
    "laplacian_var": f"WITH {_P}, {_LAP} SELECT frame, round(var_pop(l), 5) AS sharpness FROM l GROUP BY frame",
    "noise_sigma": f"WITH {_P}, {_LAP}, m AS (SELECT frame, median(l) AS m FROM l GROUP BY frame) SELECT frame, round(median(abs(l - m)) / 0.6745 / sqrt(20), 5) AS sigma FROM l JOIN m USING (frame) GROUP BY frame",
    "gradient_energy": f"WITH {_P}, g AS (SELECT frame, lead(v) OVER {_ROW} - v AS gx, lead(v) OVER {_COL} - v AS gy FROM p) SELECT frame, round(avg(sqrt(gx * gx + gy * gy)), 5) AS energy FROM g WHERE gx IS NOT NULL AND gy IS NOT NULL GROUP BY frame",
    "blockiness": f"WITH {_P}, d AS (SELECT frame, x, abs(v - lag(v) OVER {_ROW}) AS d FROM p) SELECT frame, round(avg(d) FILTER (x % 4 = 0) / (avg(d) FILTER (x % 4 <> 0) + 1e-6), 5) AS blockiness FROM d WHERE d IS NOT NULL GROUP BY frame",
    "histogram_shares": f"WITH {_P}, {_HIST} SELECT frame, bin, round(share, 5) AS share FROM h",
    "histogram_bhattacharyya": f"WITH {_P}, {_HIST}, b AS (SELECT h.frame, sum(sqrt(h.share * coalesce(o.share, 0))) AS c FROM h LEFT JOIN h o ON o.frame = h.frame + 1 AND o.bin = h.bin WHERE h.frame + 1 IN (SELECT frame FROM h) GROUP BY h.frame) SELECT frame, round(sqrt(greatest(0, 1 - c)), 5) AS distance FROM b",
    "median_hash": f"WITH {_P}, {_BIT} SELECT frame, hash FROM hash",
    "median_hash_hamming": f"WITH {_P}, {_BIT} SELECT a.frame, bit_count(xor(a.hash, b.hash))::BIGINT AS bits FROM hash a JOIN hash b ON b.frame = a.frame + 1",
    "alpha_blend_fit": f"WITH {_P}, t AS (SELECT b.frame, a.v AS u, b.v AS v, c.v AS w FROM p b JOIN p a ON a.frame = b.frame - 1 AND a.y = b.y AND a.x = b.x JOIN p c ON c.frame = b.frame + 1 AND c.y = b.y AND c.x = b.x), f AS (SELECT frame, greatest(0, least(1, sum((v - u) * (w - u)) / (sum((w - u) * (w - u)) + 1e-6))) AS alpha FROM t GROUP BY frame) SELECT frame, round(alpha, 5) AS alpha, round(avg(abs(v - ((1 - alpha) * u + alpha * w))), 5) AS residual FROM t JOIN f USING (frame) GROUP BY frame, alpha",
    "charbonnier_residual": f"WITH {_P}, {_N}, r AS (SELECT frame, sqrt((v - w) * (v - w) + 0.05 * 0.05) - 0.05 AS r FROM n WHERE abs(v) < 0.25), a AS (SELECT frame, count(*) AS n, avg(r) AS mean, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.9) AS p90 FROM r GROUP BY frame) SELECT frame, coalesce(a.n, 0) AS n, CASE WHEN a.n >= 16 THEN round(mean, 5) END AS mean, CASE WHEN a.n >= 16 THEN round(p50, 5) END AS p50, CASE WHEN a.n >= 16 THEN round(p90, 5) END AS p90 FROM (SELECT DISTINCT frame FROM n) LEFT JOIN a USING (frame)",
    "forward_splat_shift": f"WITH {_P}, o(j, i, w) AS (VALUES (0, 0, 0.375), (0, 1, 0.375), (1, 0, 0.125), (1, 1, 0.125)), l AS (SELECT frame, y + j AS y, x + i AS x, v, w::DOUBLE AS w FROM p, o) SELECT frame, y, x, round(sum(w * v) / sum(w), 5) + 0.0 AS v, round(sum(w), 5) AS coverage FROM l WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY ALL",
    "backward_warp_shift": f"WITH {_P}, o(j, i, w) AS (VALUES (-1, 0, 0.125), (-1, 1, 0.125), (0, 0, 0.375), (0, 1, 0.375)), l AS (SELECT frame, y, x, CASE WHEN abs(y + j) > 7 THEN 14 - abs(y + j) ELSE abs(y + j) END AS sy, CASE WHEN abs(x + i) > 7 THEN 14 - abs(x + i) ELSE abs(x + i) END AS sx, w::DOUBLE AS w FROM p, o) SELECT l.frame, l.y, l.x, round(sum(w * v), 5) + 0.0 AS v FROM l JOIN p ON p.frame = l.frame AND p.y = sy AND p.x = sx GROUP BY ALL",
    "flow_geometry": f"WITH {_P}, {_N}, d AS (SELECT frame, {_slope('v', _ROW)} AS ux, {_slope('v', _COL)} AS uy, {_slope('w', _ROW)} AS vx, {_slope('w', _COL)} AS vy FROM n WHERE frame % 2 = 0) SELECT frame, round(avg(CASE WHEN (1 + ux) * (1 + vy) - uy * vx < 0 THEN 1.0 ELSE 0 END), 5) AS fold, round(avg(CASE WHEN (1 + ux) * (1 + vy) - uy * vx < 0.5 THEN 1.0 ELSE 0 END), 5) AS low, round(stddev_pop(ux + vy), 5) AS div_std, round(stddev_pop(vx - uy), 5) AS curl_std FROM d GROUP BY frame",
    "bbox": f"WITH {_P} SELECT frame, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM p WHERE v > 0.2 GROUP BY frame",
    "ui_static_mask": f"WITH {_P}, m AS (SELECT scene, y, x, median(v) AS m FROM p GROUP BY ALL), a AS (SELECT scene, y, x, median(abs(v - m)) AS mad FROM p JOIN m USING (scene, y, x) GROUP BY ALL) SELECT scene, y, x, round(mad, 5) AS mad FROM a WHERE mad < 0.08",
    "linear_blend": f"WITH {_P}, {_N} SELECT 2 * frame AS frame, y, x, round(v, 5) + 0.0 AS v FROM p UNION ALL SELECT 2 * frame + 1, y, x, round((v + w) / 2, 5) + 0.0 FROM n",
    "text_roi_blocks": f"WITH {_P}, d AS (SELECT frame, y // 4 AS \"by\", x // 4 AS bx, coalesce(abs(v - lag(v) OVER {_ROW}), 0) AS d FROM p) SELECT frame, \"by\", bx, round(avg(CASE WHEN d > 0.15 THEN 1.0 ELSE 0 END), 5) AS share FROM d GROUP BY ALL HAVING avg(CASE WHEN d > 0.15 THEN 1.0 ELSE 0 END) > 0.12",
    "defect_ghost": _mid("(v + w) / 2"),
    "defect_freeze": _mid("v"),
    "defect_tear": _mid("CASE WHEN x < 4 THEN v ELSE w END"),
    "defect_fill": _mid("CASE WHEN x >= 6 THEN median(v) OVER (PARTITION BY frame) ELSE (v + w) / 2 END"),
    "histogram2d_exposure": f"WITH {_P}, {_N} SELECT floor(v * 10)::BIGINT AS a, floor(w * 10)::BIGINT AS b, count(*) AS n FROM n GROUP BY ALL",
    "dropped_frames": f"WITH {_S}, n AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM s) SELECT stream, k, row_number() OVER (PARTITION BY stream ORDER BY k) - 1 AS new_k FROM n WHERE k NOT IN (floor(n * 0.25), floor(n * 0.55), floor(n * 0.79))",
    "vfr_timestamps": f"WITH {_S} SELECT stream, k, round(coalesce(sum(CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE / 112 ELSE 1.0::DOUBLE / 130 END) OVER (PARTITION BY stream ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS pts FROM s",
}
