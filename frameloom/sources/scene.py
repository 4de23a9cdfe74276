"""A generated scene with known layers, damaged mid frames with known places, and candidate sets made of them.

The scene is luma: a panning background of random plates, a pole that stands in the world, a figure with a head and a blade that walks
across, a card that flips, and a still display. Everything is a closed form of the time, so any frame can be drawn by itself: frames
are drawn where their partition is, and no frame needs another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import kernels, regions

#: The names of the defects.
DEFECTS = ("blur", "ghost", "freeze", "rotation_tear", "head_erase", "pole_wrong_motion", "sword_flicker", "ui_drift", "text_merge", "shop_jump", "disocc_fill", "card_freeze")
#: Pixels that the background pans each frame.
PAN = 1.5
#: The defects of the severity ladder, in order, and where frames are dropped.
LADDER = ("blur", "ghost", "freeze", "rotation_tear", "head_erase")
DROPPED = (0.25, 0.55, 0.79)
#: Labels that tell of a defect.
TELLS = {
    "blur": {"parity_flicker", "temporal_instability", "structure_loss"}, "ghost": {"motion_inconsistent", "temporal_instability", "structure_loss", "transition_ghost", "parity_flicker"},
    "freeze": {"freeze_copy", "motion_inconsistent", "temporal_instability"}, "rotation_tear": {"background_tear", "motion_inconsistent", "structure_loss", "temporal_instability", "freeze_copy"},
    "disocc_fill": {"structure_loss", "temporal_instability", "motion_inconsistent"}, "head_erase": {"character_missing", "character_ghost", "structure_loss"},
}


@dataclass
class Layout:
    """Where things are in a frame, in pixels."""

    figure: tuple[float, float]
    head: float
    pole: float
    blade: tuple[float, float, float, float]
    card: tuple[float, float, float, float]
    panel: tuple[int, int, int, int]


class Scene:
    """``n`` frames of ``h`` x ``w``; ``seed`` decides the background."""

    def __init__(self, n: int, h: int = 96, w: int = 160, seed: int = 7):
        self.n, self.h, self.w = n, h, w
        rng = np.random.default_rng(seed)
        wide = w + int(PAN * n) + 3
        self.canvas = np.repeat(np.linspace(50, 120, h)[:, None], wide, axis=1)
        for _ in range(wide // 2):
            y, x = int(rng.integers(0, h - 4)), int(rng.integers(0, wide - 4))
            self.canvas[y : y + int(rng.integers(4, h // 5)), x : x + int(rng.integers(4, w // 6))] = rng.integers(30, 225)
        grain = kernels.box(rng.standard_normal((h, wide)), 1)
        self.canvas = kernels.box(self.canvas, 1) + 60 * grain

    def layout(self, k: int) -> Layout:
        phase, h, w = k / max(1, self.n), self.h, self.w
        x, y = w * (0.25 + 0.45 * phase + 0.04 * np.sin(9 * phase)), h * (0.5 + 0.06 * np.sin(14 * phase))
        size = h / 12
        half = max(2.0, w / 14 * abs(np.cos(8 * phase)))
        return Layout((x, y), size, 0.7 * w + 0.4 * PAN * self.n - self.shift(k), (x + size, y, x + 3 * size, y - 2.5 * size), (0.55 * w, 0.85 * h, half, h / 11), (2, 2, w // 3, h // 6))

    def shift(self, k: int) -> float:
        """How far the background has panned."""
        return PAN * k

    def frame(self, k: int) -> np.ndarray:
        s = self.shift(k)
        whole, part = int(s), s - int(s)
        out = (1 - part) * self.canvas[:, whole : whole + self.w] + part * self.canvas[:, whole + 1 : whole + 1 + self.w]
        at = self.layout(k)
        self._line(out, at.pole, 0, at.pole, self.h, 2.5, 30)
        x, y = at.figure
        self._blob(out, x, y + at.head, 1.2 * at.head, 1.6 * at.head, 200)
        self._blob(out, x, y - at.head, 0.8 * at.head, 0.8 * at.head, 235)
        self._line(out, *at.blade, 1.5, 245)
        cx, cy, half, high = at.card
        self._box(out, cx - half, cy - high, cx + half, cy + high, 215 if np.cos(8 * k / max(1, self.n)) > 0 else 90)
        x0, y0, x1, y1 = at.panel
        self._box(out, x0, y0, x1, y1, 25)
        for i in range(x0 + 3, x1 - 3, 6):
            self._box(out, i, y0 + 3, i + 3, y1 - 3, 230)
        return out

    def _grid(self) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(self.w)[None, :] + 0.5, np.arange(self.h)[:, None] + 0.5

    def _paint(self, out: np.ndarray, cover: np.ndarray, value: float) -> None:
        cover = np.clip(cover, 0, 1)
        out[:] = out * (1 - cover) + value * cover

    def _box(self, out: np.ndarray, x0: float, y0: float, x1: float, y1: float, value: float) -> None:
        x, y = self._grid()
        self._paint(out, np.clip(np.minimum(x - x0, x1 - x) + 0.5, 0, 1) * np.clip(np.minimum(y - y0, y1 - y) + 0.5, 0, 1), value)

    def _blob(self, out: np.ndarray, cx: float, cy: float, rx: float, ry: float, value: float) -> None:
        x, y = self._grid()
        self._paint(out, (1 - np.hypot((x - cx) / rx, (y - cy) / ry)) * min(rx, ry) + 0.5, value)

    def _line(self, out: np.ndarray, x0: float, y0: float, x1: float, y1: float, width: float, value: float) -> None:
        x, y = self._grid()
        length = max(np.hypot(x1 - x0, y1 - y0), 1e-6)
        along = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / length**2, 0, 1)
        self._paint(out, width / 2 - np.hypot(x - x0 - along * (x1 - x0), y - y0 - along * (y1 - y0)) + 0.5, value)

    def erased(self, image: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The masked pixels filled from around them, row by row."""
        out = image.copy()
        for y in np.flatnonzero(mask.any(axis=1)):
            there = np.flatnonzero(~mask[y])
            gone = np.flatnonzero(mask[y])
            out[y, gone] = np.interp(gone, there, image[y, there]) if len(there) else image.mean()
        return out


def _disc(scene: Scene, cx: float, cy: float, r: float) -> np.ndarray:
    x, y = scene._grid()
    return np.hypot(x - cx, y - cy) <= r


def _strip(scene: Scene, x0: float, y0: float, x1: float, y1: float, width: float) -> np.ndarray:
    out = np.zeros((scene.h, scene.w))
    scene._line(out, x0, y0, x1, y1, width, 1.0)
    return out > 0.05


def damaged(scene: Scene, k: int, defect: str) -> np.ndarray:
    """Mid frame ``k`` (odd) with a defect; its neighbours are the true frames."""
    if defect not in DEFECTS:
        raise ValueError(f"unknown defect {defect!r}")
    one, mid, two = scene.frame(k - 1), scene.frame(k), scene.frame(min(k + 1, scene.n))
    now, before = scene.layout(k), scene.layout(k - 1)
    x0, y0, x1, y1 = now.panel
    out = mid.copy()
    if defect == "blur":
        return kernels.box(kernels.box(kernels.box(mid, 2), 2), 2)
    if defect == "ghost":
        return (one + two) / 2
    if defect == "freeze":
        return one
    if defect == "rotation_tear":
        return np.where(np.arange(scene.w) < scene.w // 2, one, two)
    if defect == "head_erase":
        return scene.erased(mid, _disc(scene, now.figure[0], now.figure[1] - now.head, 1.1 * now.head))
    if defect == "pole_wrong_motion":
        out = scene.erased(mid, _strip(scene, now.pole, 0, now.pole, scene.h, 5))
        scene._line(out, before.pole, 0, before.pole, scene.h, 2.5, 30)
    elif defect == "sword_flicker":
        if (k // 2) % 2 == 0:
            out = scene.erased(mid, _strip(scene, *now.blade, 4))
    elif defect == "ui_drift":
        out[y0:y1, x0 + 2 : x1 + 2] = mid[y0:y1, x0:x1]
    elif defect == "text_merge":
        text = kernels.dilate(mid[y0:y1, x0:x1] < 80, 1)
        out[y0:y1, x0:x1] = np.where(text, 0.35 * mid[y0:y1, x0:x1] + 15, mid[y0:y1, x0:x1])
    elif defect == "shop_jump":
        area = (slice(scene.h // 2, scene.h), slice(scene.w // 2, scene.w))
        out[area] = (one[area] + np.roll(two, 6, axis=1)[area]) / 2
    elif defect == "disocc_fill":
        out[:, -max(2, scene.w // 12) :] = np.median(mid)
    elif defect == "card_freeze":
        cx, cy, half, high = now.card
        full = scene.w / 14
        x, y = scene._grid()
        out = scene.erased(mid, (np.abs(x - cx) <= full) & (np.abs(y - cy) <= high))
        scene._box(out, cx - full, cy - high, cx + full, cy + high, 215)
    return out


def segments(mids: int, defects: tuple[str, ...]) -> dict[str, tuple[int, int]]:
    """Mids ``a`` to ``b`` (exclusive) of each defect."""
    step = mids // (len(defects) + 1)
    return {d: ((i + 1) * step, min(mids, (i + 1) * step + max(4, step // 3))) for i, d in enumerate(defects)}


def _table(spark: SparkSession, model: str, n: int, draw: Callable[[int], np.ndarray], rate: float = 120.0, parts: int = 8) -> DataFrame:
    """Frames drawn in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks = b.column(0).to_pylist()
            images = [np.clip(draw(k), 0, 255).round().astype(np.uint8) for k in ks]
            yield pa.RecordBatch.from_arrays(
                [pa.array([model] * len(ks), pa.string()), b.column(0), pa.array([k / rate for k in ks], pa.float64()), pa.array([i.shape[0] for i in images], pa.int32()), pa.array([i.shape[1] for i in images], pa.int32()), pa.array([i.tobytes() for i in images], pa.binary())],
                ["model", "k", "t", "h", "w", "luma"],
            )

    return spark.range(0, n, 1, parts).mapInArrow(run, "model string, k long, t double, h int, w int, luma binary")


def source_frames(spark: SparkSession, scene: Scene) -> DataFrame:
    """Every second frame, numbered anew, at half the rate."""
    return _table(spark, "source", (scene.n + 1) // 2, lambda k: scene.frame(2 * k), 60.0).drop("model")


def good(spark: SparkSession, scene: Scene, model: str = "good") -> DataFrame:
    return _table(spark, model, scene.n, scene.frame)


def with_defects(spark: SparkSession, scene: Scene, defects: tuple[str, ...], model: str) -> DataFrame:
    """The scene with one segment of damaged mids for each defect; anchors are never touched."""
    where = segments(scene.n // 2, defects)

    def draw(k: int) -> np.ndarray:
        for d, (a, b) in where.items():
            if k % 2 and a <= k // 2 < b:
                return damaged(scene, k, d)
        return scene.frame(k)

    for d in defects:
        if d not in DEFECTS:
            raise ValueError(f"unknown defect {d!r}")
    return _table(spark, model, scene.n, draw)


def scene_cut(spark: SparkSession, first: Scene, second: Scene, model: str = "cut") -> DataFrame:
    """Half of one scene, then the other's; the frame at the cut blends both."""
    half = first.n // 2

    def draw(k: int) -> np.ndarray:
        return (first.frame(k) + second.frame(k)) / 2 if k == half else (first if k < half else second).frame(k)

    return _table(spark, model, first.n, draw)


def late(spark: SparkSession, scene: Scene, by: int = 1, model: str = "late") -> DataFrame:
    return _table(spark, model, scene.n, lambda k: scene.frame(max(0, k - by)))


def dropped(spark: SparkSession, scene: Scene, model: str = "dropped") -> DataFrame:
    gone = sorted({int(scene.n * f) for f in DROPPED})
    left = [k for k in range(scene.n) if k not in gone]
    return _table(spark, model, len(left), lambda k: scene.frame(left[k]))


def alternating(spark: SparkSession, scene: Scene, rates: tuple[float, float] = (112.0, 130.0), model: str = "vfr") -> DataFrame:
    """Frames that last 1/112 and 1/130 s in turn."""
    t = F.ceil(F.col("k") / 2) / rates[0] + F.floor(F.col("k") / 2) / rates[1]
    return good(spark, scene, model).withColumn("t", t)


def severity_ladder(spark: SparkSession, scene: Scene, levels: int = 6) -> DataFrame:
    """One candidate a level; level n has the ladder's first n defects."""
    out = good(spark, scene, "level 0")
    for n in range(1, min(levels, len(LADDER) + 1)):
        out = out.unionByName(with_defects(spark, scene, LADDER[:n], f"level {n}"))
    return out


def interpolated(spark: SparkSession, scene: Scene, how: str) -> DataFrame:
    """Mids made from the anchors: "linear" blends, "flow" splats both halfway; "perfect" is the truth."""

    def draw(k: int) -> np.ndarray:
        if k % 2 == 0 or how == "perfect":
            return scene.frame(k)
        one, two = scene.frame(k - 1), scene.frame(min(k + 1, scene.n))
        return (one + two) / 2 if how == "linear" else regions.interpolate(one, two)

    return _table(spark, how, scene.n, draw)


def interpolator_ladder(spark: SparkSession, scene: Scene) -> DataFrame:
    out = interpolated(spark, scene, "perfect")
    for how in ("flow", "linear"):
        out = out.unionByName(interpolated(spark, scene, how))
    return out
