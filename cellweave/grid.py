"""Grids, footprints and options: small values that are checked before a plan is built."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields
from math import isqrt

CELL_KEYS = ("sequence_id", "t", "y", "x")


@dataclass(frozen=True)
class Grid:
    ny: int
    nx: int

    def __post_init__(self):
        if self.ny < 1 or self.nx < 1:
            raise ValueError("a grid needs at least one row and one column")


@dataclass(frozen=True)
class Footprint:
    """Cells that a wet cell reaches, as (dy, lowest dx, highest dx)."""

    spans: tuple[tuple[int, int, int], ...]

    @property
    def holds_origin(self) -> bool:
        return any(dy == 0 and low <= 0 <= high for dy, low, high in self.spans)


def disk(radius: int) -> Footprint:
    """All offsets with dy^2 + dx^2 <= radius^2."""
    if radius < 0:
        raise ValueError("radius must be non-negative")
    half = [isqrt(radius * radius - dy * dy) for dy in range(-radius, radius + 1)]
    return Footprint(tuple((dy, -h, h) for dy, h in zip(range(-radius, radius + 1), half)))


def footprint(mask: Sequence[Sequence[object]]) -> Footprint:
    """A footprint from a 2-D array with odd sides, whose centre is the origin."""
    rows = [list(map(bool, r)) for r in mask]
    if not rows or not rows[0] or len({len(r) for r in rows}) != 1 or not any(map(any, rows)):
        raise ValueError("a footprint needs two axes and a cell")
    if len(rows) % 2 == 0 or len(rows[0]) % 2 == 0:
        raise ValueError("a footprint must have odd sides")
    cy, cx = len(rows) // 2, len(rows[0]) // 2
    spans = []
    for i, row in enumerate(rows):
        j = 0
        while j < len(row):
            k = j
            while k < len(row) and row[k]:
                k += 1
            if k > j:
                spans.append((i - cy, j - cx, k - 1 - cx))
            j = k + 1 if k == j else k
    return Footprint(tuple(spans))


SQUARE = footprint([[1] * 3] * 3)


@dataclass(frozen=True)
class TrackOptions:
    """How objects are linked. Displacement is in cells per frame; a gap is in missing frames."""

    tau: float = 0.35
    max_displacement: float = 20.0
    max_gap: int = 1
    gap_tau: float | None = None
    gap_ambiguity: float = 0.05
    event_overlap: float = 0.10
    gap_min_pixels: int = 0

    def __post_init__(self):
        if not 0 <= self.tau <= 1 or not 0 <= self.event_overlap <= 1:
            raise ValueError("tau and event_overlap go from 0 to 1")
        if self.max_displacement <= 0:
            raise ValueError("max_displacement must be positive")
        if self.max_gap < 0 or self.gap_ambiguity < 0 or self.gap_min_pixels < 0:
            raise ValueError("max_gap, gap_ambiguity and gap_min_pixels must be non-negative")
        if self.gap_tau is None:
            object.__setattr__(self, "gap_tau", max(self.tau, 0.45))

    def config(self) -> dict[str, float]:
        """What a saved state must agree with."""
        return {"algorithm_revision": 3.0} | {f.name: float(getattr(self, f.name)) for f in fields(self) if f.name != "gap_min_pixels" or self.gap_min_pixels}


#: Named in documents of the method without a definition; asking for them is an error.
UNDEFINED_POLICIES = ("adjacent_policy", "score_policy", "gap_conflict_policy", "velocity_reset", "family_map_scope")


def refuse_policies(given: dict) -> None:
    for name in given:
        if name in UNDEFINED_POLICIES:
            raise NotImplementedError(f"{name} has no published definition")
        raise TypeError(f"unknown option {name}")
