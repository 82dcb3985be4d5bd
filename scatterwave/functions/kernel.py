"""Numeric planning on the driver: kernel choice, grid lengths and the kernel's Fourier transform."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from scatterwave.config import Precision, TransformConfig
from scatterwave.errors import TransformError

MIN_WIDTH, MAX_WIDTH = 2, 16
MAX_AXIS = 2**32 - 1


@dataclass(frozen=True)
class Kernel:
    """exp(beta (sqrt(1 - (2d/w)^2) - 1)) for |d| < w/2, else zero."""

    width: int
    beta: float
    sigma: float
    eps: float

    def __call__(self, d):
        inside = 1.0 - np.square(2.0 * np.asarray(d, dtype=float) / self.width)
        return np.where(inside > 0, np.exp(self.beta * (np.sqrt(np.maximum(inside, 0.0)) - 1.0)), 0.0)


def kernel_for(eps: float, sigma: float) -> Kernel:
    """The narrowest kernel that meets a tolerance at an oversampling factor."""
    if not (math.isfinite(eps) and 0 < eps < 1):
        raise TransformError(TransformError.TOLERANCE, eps=eps)
    if not (math.isfinite(sigma) and sigma > 1):
        raise TransformError(TransformError.SIGMA, sigma=sigma)
    if sigma == 2.0:
        width = max(MIN_WIDTH, math.ceil(math.log10(10.0 / eps) - 1e-12))
        # Beta / width for widths 2, 3, 4 and all wider kernels.
        beta = width * {2: 2.20, 3: 2.26, 4: 2.38}.get(width, 2.30)
    else:
        width = max(MIN_WIDTH, math.ceil(math.log(1.0 / eps) / (math.pi * math.sqrt(1.0 - 1.0 / sigma))))
        beta = 0.97 * math.pi * width * (1.0 - 1.0 / (2.0 * sigma))
    if width > MAX_WIDTH:
        raise TransformError(TransformError.WIDTH_UNSUPPORTED, width=width, eps=eps, sigma=sigma)
    return Kernel(width, beta, sigma, eps)


def _smooth(n: int, primes: tuple[int, ...]) -> bool:
    for p in primes:
        while n % p == 0:
            n //= p
    return n == 1


def _next_even_smooth(least: int, primes: tuple[int, ...]) -> int:
    n = max(2, least + least % 2)
    while not _smooth(n, primes):
        n += 2
    return n


def fine_length(n_modes: int, sigma: float, width: int) -> int:
    """Smallest even 2-3-5-7-11-smooth length that holds the oversampled modes and two kernels."""
    if not MIN_WIDTH <= width <= MAX_WIDTH:
        raise TransformError(TransformError.WIDTH, width=width)
    least = max(math.ceil(sigma * n_modes), 2 * width)
    if least > MAX_AXIS:
        raise TransformError(TransformError.GRID_TOO_LARGE, length=least)
    return _next_even_smooth(least, (2, 3, 5, 7, 11))


def next_even_235(least: int) -> int:
    return _next_even_smooth(int(least), (2, 3, 5))


def _positive_nodes(order: int) -> tuple[np.ndarray, np.ndarray]:
    z, weight = np.polynomial.legendre.leggauss(order)
    return z[z > 0], weight[z > 0]


def centered_kernel_fourier(length: int, kernel: Kernel) -> np.ndarray:
    """Transform at 0..length/2; the alternating sign stands for x = 0 lying on the middle cell."""
    if length % 2:
        raise TransformError(TransformError.GRID_EVEN, length=length)
    half = 0.5 * kernel.width
    z, weight = _positive_nodes(2 * int(2 + 1.5 * kernel.width))
    m = np.arange(length // 2 + 1)
    # One quadrature node at a time keeps the memory linear in the grid.
    out = np.zeros(len(m))
    for zi, wi in zip(z, weight):
        out += 2.0 * half * wi * float(kernel(half * zi)) * np.cos(2.0 * np.pi * m * half * zi / length)
    return np.where(m % 2 == 0, out, -out)


def continuous_kernel_fourier(s, kernel: Kernel) -> np.ndarray:
    """Integral of the kernel times cos(s d), by Gauss-Legendre on the positive half."""
    s = np.asarray(s, dtype=float)
    half = 0.5 * kernel.width
    z, weight = _positive_nodes(2 * (kernel.width + 2))
    out = np.zeros(s.shape)
    for zi, wi in zip(z, weight):
        out += 2.0 * half * wi * float(kernel(half * zi)) * np.cos(s * half * zi)
    return out


def signed_modes(n: int) -> np.ndarray:
    return np.arange(-(n // 2), (n + 1) // 2)


@dataclass(frozen=True)
class Layout:
    """All that planning derives from a configuration."""

    kernel: Kernel
    shape: tuple[int, ...]

    @property
    def cells(self) -> int:
        return math.prod(self.shape)


@lru_cache(maxsize=64)
def layout_for(config: TransformConfig) -> Layout:
    kernel = kernel_for(config.eps, config.sigma)
    shape = tuple(fine_length(n, config.sigma, kernel.width) for n in config.n_modes)
    if config.precision is Precision.F32:
        check_f32_rounding(config, kernel, shape)
    return Layout(kernel, shape)


@lru_cache(maxsize=64)
def axis_factors(n: int, length: int, kernel: Kernel) -> np.ndarray:
    """1 / transform at each signed mode of an axis, in ascending mode order."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        factors = 1.0 / centered_kernel_fourier(length, kernel)[np.abs(signed_modes(n))]
    if not np.isfinite(factors).all():
        raise TransformError(TransformError.KERNEL_COEFFICIENT, length=length)
    return factors


def f32_rounding_estimate(n_modes, kernel: Kernel, shape) -> float:
    """Unit roundoff times the product over axes of the RMS amplification by deconvolution."""
    out = 2.0**-24
    for n, length in zip(n_modes, shape):
        phi = centered_kernel_fourier(length, kernel)
        out *= math.sqrt(float(np.mean(np.square(phi[0] / phi[np.abs(signed_modes(n))]))))
    return out


def check_f32_rounding(config: TransformConfig, kernel: Kernel, shape) -> None:
    estimate = f32_rounding_estimate(config.n_modes, kernel, shape)
    if estimate > 10 * config.eps and estimate > 1e-5:
        raise TransformError(TransformError.F32_TOLERANCE, eps=config.eps, estimate=estimate)


def support(x: np.ndarray, length: int, kernel: Kernel) -> tuple[np.ndarray, np.ndarray]:
    """First cell of each point's support (not yet wrapped) and its weights, one row a point."""
    p = np.mod(x * (length / (2.0 * np.pi)) + 0.5 * length, length)
    p = np.where(p >= length, 0.0, p)
    start = np.ceil(p - 0.5 * kernel.width)
    offset = (start - p)[:, None] + np.arange(kernel.width)
    return start.astype(np.int64), kernel(offset)
