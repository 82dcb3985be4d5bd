"""Column expressions that Catalyst compiles: kernel, phases, supports, mode numbers, float pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from scatterwave.config import ModeOrder
from scatterwave.functions.kernel import Kernel


def es_kernel(d: Column, width: int, beta: float) -> Column:
    inside = F.lit(1.0) - F.pow(d * (2.0 / width), F.lit(2.0))
    return F.when(inside > 0, F.exp(F.lit(float(beta)) * (F.sqrt(inside) - 1.0))).otherwise(F.lit(0.0))


def grid_position(x: Column, length: int) -> Column:
    """Coordinate in cells, folded into [0, length)."""
    p = F.pmod(x * (length / (2.0 * math.pi)) + 0.5 * length, F.lit(float(length)))
    return F.when(p >= float(length), F.lit(0.0)).otherwise(p)


def support_start(p: Column, width: int) -> Column:
    return F.ceil(p - 0.5 * width)


def kernel_at(p: Column, cell: Column, kernel: Kernel) -> Column:
    return es_kernel(cell - p, kernel.width, kernel.beta)


def phase(xs: list[Column], ks: list[Column], sign: int) -> Column:
    total = xs[0] * ks[0]
    for x, k in zip(xs[1:], ks[1:]):
        total = total + x * k
    return total if sign > 0 else -total


def rotate(re: Column, im: Column, angle: Column) -> tuple[Column, Column]:
    return re * F.cos(angle) - im * F.sin(angle), re * F.sin(angle) + im * F.cos(angle)


def mode_of_index(i: Column, n: int, order: ModeOrder) -> Column:
    """Signed mode at a storage index."""
    if order is ModeOrder.CENTERED:
        return i - F.lit(n // 2)
    return F.when(i < (n + 1) // 2, i).otherwise(i - n)


def index_of_mode(k: Column, n: int, order: ModeOrder) -> Column:
    return k + F.lit(n // 2) if order is ModeOrder.CENTERED else F.pmod(k, F.lit(n))


def linear_index(ks: list[Column], n_modes, order: ModeOrder) -> Column:
    """Position in dimension-zero-fastest storage."""
    lin, stride = F.lit(0).cast("long"), 1
    for k, n in zip(ks, n_modes):
        lin, stride = lin + index_of_mode(k, n, order).cast("long") * F.lit(stride), stride * n
    return lin


def split_df64(x: Column) -> tuple[Column, Column]:
    hi = x.cast("float")
    return hi, (x - hi.cast("double")).cast("float")


def join_df64(hi: Column, lo: Column) -> Column:
    return hi.cast("double") + lo.cast("double")
