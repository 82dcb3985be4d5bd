"""Structured errors: one exception class, a stable code, and the fields that explain it."""

from __future__ import annotations


class TransformError(ValueError):
    """Raised for an invalid configuration or for rows that break the data contract.

    ``code`` is one of the class constants below; ``fields`` holds the offending values by name.
    """

    BATCH = "InvalidBatch"
    DIMENSIONS = "InvalidDimensions"
    ZERO_MODE = "ZeroMode"
    TOLERANCE = "InvalidTolerance"
    SIGMA = "InvalidSigma"
    WIDTH_UNSUPPORTED = "KernelWidthUnsupported"
    WIDTH = "InvalidKernelWidth"
    F32_TOLERANCE = "F32ToleranceUnreachable"
    PRECISION = "PrecisionUnsupported"
    INTERVAL = "InvalidType3Interval"
    NON_FINITE_COORDINATE = "NonFiniteCoordinate"
    POINT_RANGE = "PointOutOfRange"
    T3_NON_FINITE = "Type3NonFiniteCoordinate"
    T3_OUT_OF_BOUNDS = "Type3CoordinateOutOfBounds"
    T3_GRID_SIZE = "Type3GridSizeUnsupported"
    T3_GRID_VOLUME = "Type3GridVolumeUnsupported"
    T3_RESCALING = "Type3RescalingUnsupported"
    T3_FREQUENCY = "InvalidType3KernelFrequency"
    COORDINATE_LENGTH = "CoordinateLength"
    INPUT_LENGTH = "InputLength"
    NON_FINITE_COMPLEX = "NonFiniteComplex"
    GRID_EVEN = "FineGridMustBeEven"
    GRID_TOO_LARGE = "FineGridTooLarge"
    LENGTH_OVERFLOW = "LengthOverflow"
    FFT_SHAPE = "FftShapeUnsupported"
    KERNEL_COEFFICIENT = "InvalidKernelFourierCoefficient"
    POINT_SET = "PointSetMismatch"

    def __init__(self, code: str, **fields):
        self.code = code
        self.fields = fields
        super().__init__(code + (": " + ", ".join(f"{k}={v}" for k, v in fields.items()) if fields else ""))
