"""scatterwave: nonuniform Fourier analytics expressed as Spark DataFrames."""

from scatterwave.config import ModeOrder, Precision, TransformConfig, Type3Config
from scatterwave.errors import TransformError

__all__ = ["ModeOrder", "Precision", "TransformConfig", "TransformError", "Type3Config"]
