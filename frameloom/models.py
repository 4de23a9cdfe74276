"""Backends by name. The learned ones of such systems need weights that can't be had here: their names are known and say so."""

from __future__ import annotations

from abc import ABC, abstractmethod
from functools import cache

import numpy as np

from .operators import kernels, regions


class FlowBackend(ABC):
    """Dense motion between two luma images, in pixels."""

    name = ""

    @abstractmethod
    def flow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray: ...

    def flow_pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """There and back."""
        return self.flow(a, b), self.flow(b, a)

    def flow_many(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        return [self.flow(a, b) for a, b in pairs]


class PyramidBackend(FlowBackend):
    """Least squares of gradients, from coarse to fine."""

    name = "pyramid"

    def flow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return kernels.dense_flow(a, b)


#: Names of backends that need trained weights.
LEARNED = {"flow": ("raft", "raft_small"), "tracker": ("cotracker", "audit"), "segmentation": ("sam", "learned"), "depth": ("auto", "learned"), "vqa": ("learned",)}


def _missing(kind: str, name: str) -> Exception:
    if name in LEARNED[kind]:
        return NotImplementedError(f"{kind} backend {name!r} needs trained weights, which this engine doesn't have")
    return ValueError(f"unknown {kind} backend {name!r}")


@cache
def get_flow_backend(name: str = "auto") -> FlowBackend:
    """The backend of a process, made once; "auto" is the best there is."""
    if name in ("auto", "pyramid"):
        return PyramidBackend()
    raise _missing("flow", name)


def get_tracker_backend(name: str = "auto"):
    """A function from frames and points in the first one to their places in all."""
    if name in ("auto", "flow"):
        return regions.track
    raise _missing("tracker", name)


def get_segmentation_backend(name: str = "auto"):
    """A function from a frame and the motion in it to a mask of what moves by itself."""
    if name in ("auto", "classic"):
        return regions.moving_parts
    raise _missing("segmentation", name)


def get_depth_backend(name: str = "auto"):
    raise _missing("depth", name)


def get_vqa_backend(name: str = "auto"):
    """There is none; "auto" goes without."""
    if name == "auto":
        return None
    raise _missing("vqa", name)
