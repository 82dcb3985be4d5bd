"""Immutable configuration of a transform; every rule that needs no data is checked here."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import Enum

from scatterwave.errors import TransformError

DEFAULT_EPS = 1e-6
DEFAULT_SIGMA = 2.0
MAX_RANK = 8


class ModeOrder(str, Enum):
    """Storage order of signed modes: most negative first, or zero first with negatives last."""

    CENTERED = "centered"
    FFT = "fft"


class Precision(str, Enum):
    """F32 rounds inputs to float and sums in double; DF64 is a pair of floats, computed in double."""

    F32 = "f32"
    F64 = "f64"
    DF64 = "df64"


def _check_common(batch: int, eps: float, sigma: float) -> None:
    if not isinstance(batch, int) or batch < 1:
        raise TransformError(TransformError.BATCH, batch=batch)
    if not (math.isfinite(eps) and 0 < eps < 1):
        raise TransformError(TransformError.TOLERANCE, eps=eps)
    if not (math.isfinite(sigma) and sigma > 1):
        raise TransformError(TransformError.SIGMA, sigma=sigma)


def _check_rank(rank: int) -> None:
    if not 1 <= rank <= MAX_RANK:
        raise TransformError(TransformError.DIMENSIONS, rank=rank)


@dataclass(frozen=True)
class TransformConfig:
    """Types 1 and 2 over ``len(n_modes)`` axes. ``isign >= 0`` means exp(+i k x), else exp(-i k x)."""

    n_modes: tuple[int, ...]
    batch: int = 1
    eps: float = DEFAULT_EPS
    isign: int = 1
    mode_order: ModeOrder = ModeOrder.CENTERED
    sigma: float = DEFAULT_SIGMA
    precision: Precision = Precision.F64

    def __post_init__(self):
        object.__setattr__(self, "n_modes", tuple(int(n) for n in self.n_modes))
        object.__setattr__(self, "mode_order", ModeOrder(self.mode_order))
        object.__setattr__(self, "precision", Precision(self.precision))
        _check_rank(len(self.n_modes))
        for axis, n in enumerate(self.n_modes):
            if n < 1:
                raise TransformError(TransformError.ZERO_MODE, axis=axis)
        _check_common(self.batch, self.eps, self.sigma)
        if math.prod(self.n_modes) * self.batch >= 2**63:
            raise TransformError(TransformError.LENGTH_OVERFLOW, n_modes=self.n_modes, batch=self.batch)

    @property
    def rank(self) -> int:
        return len(self.n_modes)

    @property
    def sign(self) -> int:
        return 1 if self.isign >= 0 else -1

    @property
    def mode_count(self) -> int:
        return math.prod(self.n_modes)

    def with_(self, **changes) -> TransformConfig:
        return replace(self, **changes)

    def adjoint(self) -> TransformConfig:
        return replace(self, isign=-self.sign)

    def check_active_batch(self, active: int | None) -> int:
        active = self.batch if active is None else active
        if not 1 <= active <= self.batch:
            raise TransformError(TransformError.BATCH, batch=active, capacity=self.batch)
        return active


@dataclass(frozen=True)
class Interval:
    """A closed interval that holds all coordinates of one axis."""

    lower: float
    upper: float

    def __post_init__(self):
        if not (math.isfinite(self.lower) and math.isfinite(self.upper) and self.lower <= self.upper):
            raise TransformError(TransformError.INTERVAL, lower=self.lower, upper=self.upper)

    def contains(self, other: Interval) -> bool:
        return self.lower <= other.lower and other.upper <= self.upper

    def half_width_and_center(self) -> tuple[float, float]:
        """A centre close to the origin (under a tenth of the half-width) is moved onto it."""
        half, center = 0.5 * (self.upper - self.lower), 0.5 * (self.upper + self.lower)
        if abs(center) < 0.1 * half:
            return half + abs(center), 0.0
        return half, center


@dataclass(frozen=True)
class Type3Config:
    """Type 3: sources inside ``source_bounds``, target frequencies inside ``target_bounds``."""

    source_bounds: tuple[Interval, ...]
    target_bounds: tuple[Interval, ...]
    batch: int = 1
    eps: float = DEFAULT_EPS
    isign: int = 1
    sigma: float = DEFAULT_SIGMA
    precision: Precision = Precision.F64

    def __post_init__(self):
        for name in ("source_bounds", "target_bounds"):
            own = tuple(b if isinstance(b, Interval) else Interval(*map(float, b)) for b in getattr(self, name))
            object.__setattr__(self, name, own)
        object.__setattr__(self, "precision", Precision(self.precision))
        _check_rank(len(self.source_bounds))
        if len(self.source_bounds) != len(self.target_bounds):
            raise TransformError(TransformError.DIMENSIONS, source=len(self.source_bounds), target=len(self.target_bounds))
        _check_common(self.batch, self.eps, self.sigma)

    @property
    def rank(self) -> int:
        return len(self.source_bounds)

    @property
    def sign(self) -> int:
        return 1 if self.isign >= 0 else -1

    def adjoint(self) -> Type3Config:
        return replace(self, source_bounds=self.target_bounds, target_bounds=self.source_bounds, isign=-self.sign)

    def check_active_batch(self, active: int | None) -> int:
        active = self.batch if active is None else active
        if not 1 <= active <= self.batch:
            raise TransformError(TransformError.BATCH, batch=active, capacity=self.batch)
        return active

    def contains(self, sources, targets) -> bool:
        return all(a.contains(b) for a, b in zip(self.source_bounds + self.target_bounds, tuple(sources) + tuple(targets)))
