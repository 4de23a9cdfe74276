"""Image and motion kernels on numpy arrays, for the Arrow-batched window operator.

Images are float (h, w), flows (h, w, 2) with (dx, dy) in pixels. They need nothing but numpy; the dense flow is an iterated
Lucas-Kanade over an image pyramid, a stand-in for the learned and polynomial backends that this environment lacks."""

from __future__ import annotations

import numpy as np

TAU, CYCLE_PX, NORM_PX = 4.0, 3.0, 2.0


def grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(w, dtype=np.float64), np.arange(h, dtype=np.float64))


def _mirror(i: np.ndarray, n: int) -> np.ndarray:
    """Indices reflected at the borders without repeating the edge."""
    if n == 1:
        return np.zeros_like(i)
    i = np.abs(i) % (2 * (n - 1))
    return np.where(i >= n, 2 * (n - 1) - i, i)


def backward_warp(image: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """Bilinear samples of ``image`` at each pixel plus its flow."""
    h, w = image.shape[:2]
    gx, gy = grid(h, w)
    x, y = gx + flow[..., 0], gy + flow[..., 1]
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    out = 0.0
    for j, wy in ((0, 1 - fy), (1, fy)):
        for i, wx in ((0, 1 - fx), (1, fx)):
            v = image[_mirror(y0 + j, h), _mirror(x0 + i, w)]
            out = out + v * ((wx * wy)[..., None] if v.ndim == 3 else wx * wy)
    return out


def forward_splat(image: np.ndarray, flow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear scatter to each pixel plus its flow, divided by what landed there; and what landed."""
    h, w = image.shape
    gx, gy = grid(h, w)
    x, y = gx + flow[..., 0], gy + flow[..., 1]
    inside = (x >= 0) & (y >= 0) & (x <= w - 1.001) & (y <= h - 1.001)
    x, y, v = x[inside], y[inside], image[inside]
    x0, y0 = x.astype(np.int64), y.astype(np.int64)
    fx, fy = x - x0, y - y0
    total, weight = np.zeros(h * w), np.zeros(h * w)
    for j, wy in ((0, 1 - fy), (1, fy)):
        for i, wx in ((0, 1 - fx), (1, fx)):
            at = (y0 + j) * w + x0 + i
            weight += np.bincount(at, wx * wy, h * w)
            total += np.bincount(at, wx * wy * v, h * w)
    landed = weight > 1e-6
    return np.where(landed, total / np.maximum(weight, 1e-6), 0).reshape(h, w), weight.reshape(h, w)


def compose(ab: np.ndarray, bc: np.ndarray) -> np.ndarray:
    return ab + backward_warp(bc, ab)


def magnitude(flow: np.ndarray) -> np.ndarray:
    return np.hypot(flow[..., 0], flow[..., 1])


def charbonnier(x: np.ndarray, tau: float = TAU) -> np.ndarray:
    return np.sqrt(x * x + tau * tau) - tau


def box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2r+1)^2 pixels, mirrored at the borders."""
    p = np.pad(image, r, mode="reflect" if min(image.shape) > r else "edge")
    s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    k = 2 * r + 1
    return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / (k * k)


def sobel(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(image, 1, mode="reflect")
    row = p[:-2] + 2 * p[1:-1] + p[2:]
    col = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return row[:, 2:] - row[:, :-2], col[2:] - col[:-2]


def laplacian(image: np.ndarray) -> np.ndarray:
    p = np.pad(image, 1, mode="reflect")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * image


def _half(image: np.ndarray) -> np.ndarray:
    b = box(image, 1)
    return b[::2, ::2]


def _grow(flow: np.ndarray, h: int, w: int) -> np.ndarray:
    rows = np.minimum(np.arange(h) // 2, flow.shape[0] - 1)
    cols = np.minimum(np.arange(w) // 2, flow.shape[1] - 1)
    return 2 * flow[rows][:, cols]


def dense_flow(a: np.ndarray, b: np.ndarray, levels: int = 3, radius: int = 4, rounds: int = 5) -> np.ndarray:
    """Motion from ``a`` to ``b``: at each level, from coarse to fine, least squares of the gradients in a window, iterated."""
    pyramid = [(a, b)]
    while len(pyramid) < levels and min(pyramid[-1][0].shape) >= 4 * radius:
        pyramid.append((_half(pyramid[-1][0]), _half(pyramid[-1][1])))
    flow = np.zeros((*pyramid[-1][0].shape, 2))
    for one, two in reversed(pyramid):
        if flow.shape[:2] != one.shape:
            flow = _grow(flow, *one.shape)
        ix, iy = (g / 8 for g in sobel(one))
        xx, yy, xy = box(ix * ix, radius), box(iy * iy, radius), box(ix * iy, radius)
        ridge = 1e-2 + 1e-3 * (xx + yy)
        det = (xx + ridge) * (yy + ridge) - xy * xy
        for _ in range(rounds):
            it = backward_warp(two, flow) - one
            tx, ty = box(ix * it, radius), box(iy * it, radius)
            step = np.stack((-((yy + ridge) * tx - xy * ty) / det, -((xx + ridge) * ty - xy * tx) / det), axis=-1)
            flow = flow + np.clip(step, -2, 2)
        flow = np.stack((box(flow[..., 0], 1), box(flow[..., 1], 1)), axis=-1)
    return flow


def cycle_occlusion(ab: np.ndarray, ba: np.ndarray, threshold: float = CYCLE_PX, sigma: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Pixels whose way there and back misses by more than ``threshold``, and a confidence that falls with the miss."""
    miss = magnitude(ab + backward_warp(ba, ab))
    return miss > threshold, np.exp(-((miss / sigma) ** 2))


def percentile(x: np.ndarray, q: float) -> float:
    return float(np.percentile(x, q)) if x.size else float("nan")


def composition(f01: np.ndarray, f0m: np.ndarray, fm1: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """How far the motion through the mid frame is from the motion between its neighbours."""
    error = charbonnier(magnitude(compose(f0m, fm1) - f01)) / (magnitude(f01) + NORM_PX)
    seen = weight > 1e-3
    mean = float((error * weight).sum() / (weight.sum() + 1e-6))
    return {"mean": mean, "p90": percentile(error[seen], 90), "p99": percentile(error[seen], 99), "coverage": float(seen.mean()), "hidden": float(error[~seen].mean()) if (~seen).any() else 0.0}


def geometry(flow: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """Shares of folds and of low Jacobian determinants, and the spread of divergence and curl, over at least 16 pixels."""
    if mask.sum() < 16:
        return dict.fromkeys(("fold", "low", "div_std", "curl_std"), float("nan"))
    uy, ux = np.gradient(flow[..., 0])
    vy, vx = np.gradient(flow[..., 1])
    det = ((1 + ux) * (1 + vy) - uy * vx)[mask]
    return {"fold": float((det < 0).mean()), "low": float((det < 0.5).mean()), "div_std": float((ux + vy)[mask].std()), "curl_std": float((vx - uy)[mask].std())}


def residual_stats(residual: np.ndarray, seen: np.ndarray) -> dict[str, float]:
    """Charbonnier residuals over at least 64 visible pixels, and the share of all pixels far above the median."""
    if seen.sum() < 64:
        return dict.fromkeys(("mean", "p50", "p90", "p99", "large"), float("nan"))
    r = charbonnier(residual)
    v = r[seen]
    p50 = percentile(v, 50)
    return {"mean": float(v.mean()), "p50": p50, "p90": percentile(v, 90), "p99": percentile(v, 99), "large": float(((r > max(3 * p50, 12)) & seen).mean())}


def edges(image: np.ndarray, low: float = 60.0, high: float = 160.0) -> np.ndarray:
    """Ridges of the gradient above ``low`` that are connected, within a few steps, to one above ``high``."""
    gx, gy = sobel(image)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    along = np.abs(gx) >= np.abs(gy)
    across = np.where(along, np.maximum(p[1:-1, :-2], p[1:-1, 2:]), np.maximum(p[:-2, 1:-1], p[2:, 1:-1]))
    ridge = (m >= across) & (m > low)
    strong = ridge & (m > high)
    for _ in range(8):
        strong = ridge & dilate(strong, 1)
    return strong


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    h, w = mask.shape
    p = np.pad(mask, r)
    out = np.zeros_like(mask)
    for j in range(2 * r + 1):
        for i in range(2 * r + 1):
            out |= p[j : j + h, i : i + w]
    return out


def distance(mask: np.ndarray) -> np.ndarray:
    """Euclidean distance of each pixel to the mask, one axis after the other."""
    h, w = mask.shape
    far = float((h + w) ** 2)
    column = np.where(mask, 0.0, far)
    y, x = np.arange(h), np.arange(w)
    first = np.stack([(column + ((y[:, None] - k) ** 2)).min(axis=0) for k in y]) if h else column
    return np.sqrt(np.stack([(first + ((x[None, :] - k) ** 2)).min(axis=1) for k in x], axis=1))


def edge_structure(ends: tuple[np.ndarray, np.ndarray], mid: np.ndarray, f01: np.ndarray, f10: np.ndarray) -> dict[str, float]:
    """Edges that both end frames carry to the mid time against the mid frame's: recall, precision, ghosts, distances."""
    carried = [forward_splat(edges(e).astype(float), 0.5 * f)[0] > 0.25 for e, f in zip(ends, (f01, f10), strict=True)]
    support = carried[0] | carried[1]
    found = edges(mid)
    if not support.any():
        return dict.fromkeys(("recall", "precision", "ghost", "chamfer"), float("nan"))
    if not found.any():
        return {"recall": 0.0, "precision": float("nan"), "ghost": float("nan"), "chamfer": float(sum(mid.shape))}
    to_found, to_support = distance(found), distance(support)
    both = dilate(carried[0], 2) & carried[1] | dilate(carried[1], 2) & carried[0]
    wanted = both if both.any() else support
    gap = to_support[found]
    return {"recall": float((to_found[wanted] <= 2).mean()), "precision": float((gap <= 2).mean()), "ghost": float(((gap > 2) & (gap <= 4)).mean()), "chamfer": float(to_found[wanted].mean())}


def shrink(image: np.ndarray, size: int) -> np.ndarray:
    """Means of ``size`` x ``size`` blocks, as equal as whole pixels allow; smaller images repeat pixels."""

    def sums(x: np.ndarray, axis: int) -> np.ndarray:
        n = x.shape[axis]
        at = np.linspace(0, n, size + 1).astype(int)
        first, last = np.minimum(at[:-1], n - 1), np.maximum(at[1:], np.minimum(at[:-1], n - 1) + 1)
        total = np.concatenate((np.zeros_like(x.take([0], axis)), np.cumsum(x, axis=axis)), axis=axis)
        shape = [1, 1]
        shape[axis] = size
        return (total.take(last, axis) - total.take(first, axis)) / (last - first).reshape(shape)

    return sums(sums(image, 0), 1)


def phash(image: np.ndarray) -> int:
    """63 bits of the low cosine frequencies against their median (the lowest of 64 is dropped)."""
    small = shrink(image, 32)
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None] + 1) * np.arange(8)[:, None] / 64)
    low = basis @ small @ basis.T
    bits = (low > np.median(low[1:, 1:])).ravel()
    value = 0
    for b in bits:
        value = value << 1 | int(b)
    return value >> 1


def window_features(frames: list[np.ndarray]) -> dict[str, float]:
    """Features of five luma frames ``M X M X M`` (positions 0..4, anchors at 1 and 3), keyed as in the feature registry; what
    can't be measured is NaN."""
    f = [np.asarray(x, np.float64) for x in frames]
    flow = {}

    def motion(a: int, b: int) -> np.ndarray:
        if (a, b) not in flow:
            flow[a, b] = dense_flow(f[a], f[b])
        return flow[a, b]

    out: dict[str, float] = {}
    f01, f10 = motion(1, 3), motion(3, 1)
    (occ0, conf0), (occ1, conf1) = cycle_occlusion(f01, f10), cycle_occlusion(f10, f01)
    fwd = composition(f01, motion(1, 2), motion(2, 3), conf0 * ~occ0)
    bwd = composition(f10, motion(3, 2), motion(2, 1), conf1 * ~occ1)
    for k in ("mean", "p90"):
        out[f"comp_fwd_{k}"], out[f"comp_bwd_{k}"] = fwd[k], bwd[k]
    out["comp_mean"] = (fwd["mean"] + bwd["mean"]) / 2
    out["comp_p90_max"] = max(fwd["p90"], bwd["p90"])
    out["comp_occ_region_mean"] = (fwd["hidden"] + bwd["hidden"]) / 2
    out["comp_visible_fraction"] = fwd["coverage"]
    geo = geometry(motion(1, 2), ~occ0)
    out |= {"flow_fold_frac": geo["fold"], "flow_jdet_low_frac": geo["low"], "flow_div_std": geo["div_std"], "flow_curl_std": geo["curl_std"]}
    whole, leg = np.median(magnitude(f01)[~occ0]) if (~occ0).any() else 0.0, np.median(magnitude(motion(1, 2))[~occ0]) if (~occ0).any() else 0.0
    out["comp_leg_ratio"] = float(abs(leg / whole - 0.5)) if whole > 2 and (~occ0).sum() > 100 else 0.0

    # Anchors rebuilt from the generated frames around them.
    a, wa = forward_splat(f[0], 0.5 * motion(0, 2))
    b, wb = forward_splat(f[2], 0.5 * motion(2, 0))
    weight = wa + wb
    rebuilt = (a * wa + b * wb) / np.maximum(weight, 1e-6)
    seen = weight > 0.25
    cycle = np.maximum(charbonnier(rebuilt - f[1]) - 2.0, 0)[seen]
    enough = cycle.size >= 64
    out["cycle_resid_mean"], out["cycle_resid_p90"] = (float(cycle.mean()), percentile(cycle, 90)) if enough else (float("nan"),) * 2
    anchor = np.abs(laplacian(f[1])).mean()
    out["cycle_sharp_loss"] = float(np.clip(1 - np.abs(laplacian(rebuilt)).mean() / anchor, 0, 1)) if anchor > 0 else 0.0

    # Motion-compensated residuals to the frames one and two away from the centre.
    lags = {}
    for lag in (1, 2):
        stats = []
        for j in (2 - lag, 2 + lag):
            there = motion(2, j)
            occ, _ = cycle_occlusion(there, motion(j, 2))
            stats.append(residual_stats(backward_warp(f[j], there) - f[2], ~occ))
        lags[lag] = {k: float(np.nanmean([s[k] for s in stats])) if any(s[k] == s[k] for s in stats) else float("nan") for k in stats[0]}
    out |= {"mct_lag1_mean": lags[1]["mean"], "mct_lag1_p90": lags[1]["p90"], "mct_lag2_mean": lags[2]["mean"]}
    out["mct_anchor_vs_gen_ratio"] = lags[1]["mean"] / lags[2]["mean"] if lags[2]["mean"] > 1e-3 else float("nan")

    sharp = np.array([laplacian(x).var() for x in f])
    out["parity_window_sharp_gap"] = float(abs(sharp[::2].mean() - sharp[1::2].mean()) / (np.median(sharp) + 1e-6))
    out["gtq_sharp_odd_even_ratio"] = float(sharp[::2].mean() / sharp[1::2].mean()) if sharp[1::2].mean() > 0 else 1.0
    moving = magnitude(f01) > 2
    if moving.sum() > 200:
        spread = np.abs(f[3] - f[1])[moving].mean()
        out["freeze_copy_score"] = float(np.clip(1 - np.median(np.abs(f[2] - f[1])[moving]) / (0.5 * spread + 1e-6), 0, 1)) if spread > 8 else float("nan")
    e = edge_structure((f[1], f[3]), f[2], f01, f10)
    out |= {"edge_recall": e["recall"], "edge_precision": e["precision"], "edge_ghost_frac": e["ghost"], "edge_chamfer_sup_to_em": e["chamfer"]}
    return out
