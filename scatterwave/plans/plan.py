"""Plans: choose a way to compute, hold prepared point sets, and describe what was planned."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scatterwave.config import Precision, TransformConfig, Type3Config
from scatterwave.errors import TransformError
from scatterwave.functions.kernel import layout_for
from scatterwave.operators import direct, gridded, type3
from scatterwave.operators.direct import attach, rounded
from scatterwave.operators.modes import axis_names
from scatterwave.operators.spread import bin_sorted
from scatterwave.operators.validate import check_attached, check_complex, check_lengths, check_modes, check_points, check_type3

#: A direct term costs about this many gridded ones (sine and cosine against a multiply-add).
DIRECT_COST = 8.0


def choose_method(config: TransformConfig, points: int) -> str:
    """Direct while points x modes is cheaper than spreading plus the uniform transform."""
    layout = layout_for(config)
    fast = points * layout.kernel.width**config.rank + layout.cells * math.log2(layout.cells)
    return "direct" if DIRECT_COST * points * config.mode_count <= fast else "gridded"


@dataclass(frozen=True)
class PreparedPoints:
    """A checked, bin-sorted and persisted point set; both transform types of the same geometry may use it."""

    points: DataFrame
    key: tuple
    count: int

    def unpersist(self) -> None:
        self.points.unpersist()


@dataclass(frozen=True)
class PreparedType3:
    sources: DataFrame
    targets: DataFrame
    goals: DataFrame
    key: Type3Config

    def unpersist(self) -> None:
        self.sources.unpersist()
        self.targets.unpersist()


@dataclass
class Plan:
    """A transform of ``kind`` 1, 2 or 3.

    ``set_points`` then ``execute``, or ``transform`` in one call. ``strict`` checks rows against the data
    contract (a job for each input); without it, rows are taken as they are.
    """

    kind: int
    config: TransformConfig | Type3Config
    strict: bool = True
    _points: PreparedPoints | PreparedType3 | None = field(default=None, repr=False)
    _timings: dict[str, float] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.kind not in (1, 2, 3) or (self.kind == 3) != isinstance(self.config, Type3Config):
            raise TransformError(TransformError.DIMENSIONS, kind=self.kind, config=type(self.config).__name__)
        if self.kind == 3:
            type3.plan_axes(self.config)
        else:
            layout_for(self.config)

    @property
    def key(self) -> tuple:
        layout = layout_for(self.config)
        return self.config.precision, layout.shape, layout.kernel

    def _timed(self, stage: str, began: float) -> None:
        self._timings[stage] = self._timings.get(stage, 0.0) + time.time() - began

    def prepare_points(self, points: DataFrame) -> PreparedPoints:
        began = time.time()
        if self.strict:
            check_points(points, self.config.rank)
        own = points.select("point_id", *[rounded(F.col(x), self.config.precision).alias(x) for x in axis_names("x", self.config.rank)])
        held = bin_sorted(own, layout_for(self.config)).persist(StorageLevel.MEMORY_AND_DISK)
        prepared = PreparedPoints(held, self.key, held.count())
        self._timed("prepare", began)
        return prepared

    def prepare_type3(self, sources: DataFrame, targets: DataFrame) -> PreparedType3:
        """Source coordinates and target factors; strengths are turned when the plan executes."""
        began = time.time()
        if self.strict:
            check_type3(sources, "point_id", "x", self.config.source_bounds)
            check_type3(targets, "target_id", "s", self.config.target_bounds)
        rank = self.config.rank
        src = sources.select("point_id", *[F.col(x).cast("double").alias(x) for x in axis_names("x", rank)]).persist(StorageLevel.MEMORY_AND_DISK)
        goals = type3.prepare_targets(targets, self.config).persist(StorageLevel.MEMORY_AND_DISK)
        src.count(), goals.count()
        self._timed("prepare", began)
        return PreparedType3(src, goals, targets, self.config)

    def set_points(self, points: DataFrame, targets: DataFrame | None = None) -> Plan:
        self.unpersist()
        self._points = self.prepare_type3(points, targets) if self.kind == 3 else self.prepare_points(points)
        return self

    def execute(self, values: DataFrame, active: int | None = None, prepared=None, method: str = "auto", deterministic: bool = False) -> DataFrame:
        """``values``: strengths (types 1 and 3) or modes (type 2). ``method``: auto, direct or gridded."""
        prepared = prepared or self._points
        if prepared is None:
            raise TransformError(TransformError.POINT_SET, reason="no points set")
        active = self.config.check_active_batch(active)
        if prepared.key != (self.config if self.kind == 3 else self.key):
            raise TransformError(TransformError.POINT_SET, reason="prepared for another plan")
        began = time.time()
        if self.strict and self.kind == 2:
            check_modes(values, self.config, active)
        elif self.strict:
            points = prepared.sources if self.kind == 3 else prepared.points
            check_lengths(points, values, "point_id", active)
            check_complex(values, "point_id")
        self._timed("validate", began)
        began = time.time()
        if self.kind == 3:
            data = attach(prepared.sources, values, axis_names("x", self.config.rank), "point_id", self.config.precision)
            if method == "direct":
                out = direct.type3(prepared.sources, values, prepared.goals, self.config, active, deterministic)
            else:
                out = type3.type3(None, None, None, self.config, active, (type3.prepare_sources(data, self.config), prepared.targets), deterministic)
        else:
            way = choose_method(self.config, prepared.count) if method == "auto" else method
            if self.kind == 1:
                run = direct.type1 if way == "direct" else gridded.type1
                out = run(prepared.points, values, self.config, active, deterministic=deterministic)
            else:
                run = direct.type2 if way == "direct" else gridded.type2
                out = run(prepared.points, values, self.config, active)
        self._timed("plan", began)
        return out

    def transform(self, points: DataFrame, values: DataFrame, targets: DataFrame | None = None, active: int | None = None, method: str = "auto", deterministic: bool = False) -> DataFrame:
        """One call without persisting the point set. The checks and the results are those of ``set_points`` and ``execute``."""
        active = self.config.check_active_batch(active)
        began = time.time()
        if self.strict:
            if self.kind == 3:
                check_type3(points, "point_id", "x", self.config.source_bounds)
                check_type3(targets, "target_id", "s", self.config.target_bounds)
            else:
                check_points(points, self.config.rank)
            if self.kind == 2:
                check_modes(values, self.config, active)
            else:
                check_attached(points, values, "point_id", active)
                check_complex(values, "point_id")
        self._timed("validate", began)
        if self.kind == 3:
            if method == "direct":
                return direct.type3(points, values, targets, self.config, active, deterministic)
            return type3.type3(points, values, targets, self.config, active, None, deterministic)
        if method == "auto":
            method = choose_method(self.config, points.count())
        run = {(1, "direct"): direct.type1, (1, "gridded"): gridded.type1, (2, "direct"): direct.type2, (2, "gridded"): gridded.type2}[self.kind, method]
        return run(points, values, self.config, active, deterministic=deterministic) if self.kind == 1 else run(points, values, self.config, active)

    def run(self, out: DataFrame, path: str | None = None) -> DataFrame:
        """Computes a planned result, under the timing ``execute``: to parquet at ``path``, which is read back, or to nowhere."""
        began = time.time()
        if path is None:
            out.write.format("noop").mode("overwrite").save()
        else:
            out.write.mode("overwrite").parquet(path)
            out = out.sparkSession.read.parquet(path)
        self._timed("execute", began)
        return out

    def adjoint(self) -> Plan:
        """Types 1 and 2 are each other's adjoint under the opposite sign; type 3 also swaps its sets."""
        return Plan({1: 2, 2: 1, 3: 3}[self.kind], self.config.adjoint(), self.strict)

    def fine_grid_shape(self) -> tuple[int, ...]:
        return tuple(a.length for a in type3.plan_axes(self.config)[1]) if self.kind == 3 else layout_for(self.config).shape

    def expected_rows(self, points: int, active: int | None = None, targets: int | None = None) -> dict[str, int]:
        """Rows of input and output for a number of points (type 3: of sources, and of ``targets``, alike unless given)."""
        active = self.config.check_active_batch(active)
        modes = 0 if self.kind == 3 else self.config.mode_count
        into, out = {1: (points, modes), 2: (modes, points), 3: (points, points if targets is None else targets)}[self.kind]
        return {"points": points, "input": into * active, "output": out * active}

    def describe(self) -> dict:
        kernel = type3.plan_axes(self.config)[0] if self.kind == 3 else layout_for(self.config).kernel
        return {
            "kind": self.kind, "rank": self.config.rank, "batch": self.config.batch, "sign": self.config.sign, "eps": self.config.eps, "sigma": self.config.sigma,
            "precision": Precision(self.config.precision).value, "kernel_width": kernel.width, "kernel_beta": kernel.beta, "fine_grid_shape": self.fine_grid_shape(), "prepared": self._points is not None,
        }

    def timings(self) -> dict[str, float]:
        """Seconds so far by stage: prepare, validate, plan (building a lazy result) and execute (``run``)."""
        return dict(self._timings)

    def unpersist(self) -> None:
        if self._points is not None:
            self._points.unpersist()
            self._points = None


@lru_cache(maxsize=4)
def cached_plan(kind: int, config: TransformConfig | Type3Config) -> Plan:
    """Plans of one-call helpers; four are kept."""
    return Plan(kind, config)


class AutoBoundsType3:
    """Type 3 whose bounds follow the data; a plan is kept while new bounds lie inside its own."""

    def __init__(self, rank: int, **options):
        self.rank, self.options, self.plan = rank, options, None

    def set_points(self, sources: DataFrame, targets: DataFrame) -> Plan:
        own = type3.bounds_of(sources, "x", self.rank), type3.bounds_of(targets, "s", self.rank)
        if self.plan is None or not self.plan.config.contains(*own):
            self.plan = Plan(3, Type3Config(*own, **self.options))
        return self.plan.set_points(sources, targets)
