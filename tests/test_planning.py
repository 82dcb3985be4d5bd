import numpy as np
import pytest

from scatterwave import ModeOrder, TransformConfig, TransformError, Type3Config
from scatterwave.config import Interval
from scatterwave.functions import kernel as K
from scatterwave.operators.type3 import plan_axes


@pytest.mark.parametrize("eps,width,beta", [(1e-1, 2, 4.40), (1e-2, 3, 6.78), (1e-3, 4, 9.52), (1e-4, 5, 11.50), (1e-5, 6, 13.80), (1e-6, 7, 16.10)])
def test_kernel_parameters(eps, width, beta):
    k = K.kernel_for(eps, 2.0)
    assert k.width == width and k.beta == pytest.approx(beta)
    assert k(width / 2) == 0 and k(0.0) == 1


@pytest.mark.parametrize("n,sigma,width,length", [(17, 2.0, 7, 36), (1, 2.0, 7, 14)])
def test_fine_length(n, sigma, width, length):
    assert K.fine_length(n, sigma, width) == length


def test_fine_length_small_sigma():
    assert K.fine_length(17, 1.25, K.kernel_for(1e-6, 1.25).width) == 22


def test_kernel_transform_matches_the_discrete_sum():
    k, n = K.kernel_for(1e-9, 2.0), 64
    d = np.arange(n) - n // 2
    got = np.array([np.sum(k(d) * np.exp(-2j * np.pi * m * np.arange(n) / n)) for m in range(9)]).real
    assert np.allclose(got, K.centered_kernel_fourier(n, k)[:9], rtol=1e-6)


@pytest.mark.parametrize(
    "code,make",
    [
        ("InvalidDimensions", lambda: TransformConfig(())),
        ("InvalidDimensions", lambda: TransformConfig((2,) * 9)),
        ("ZeroMode", lambda: TransformConfig((4, 0))),
        ("InvalidTolerance", lambda: TransformConfig((4,), eps=0.0)),
        ("InvalidTolerance", lambda: TransformConfig((4,), eps=float("nan"))),
        ("InvalidSigma", lambda: TransformConfig((4,), sigma=1.0)),
        ("InvalidBatch", lambda: TransformConfig((4,), batch=0)),
        ("InvalidBatch", lambda: TransformConfig((4,), batch=2).check_active_batch(3)),
        ("KernelWidthUnsupported", lambda: K.layout_for(TransformConfig((4,), eps=1e-16))),
        ("InvalidKernelWidth", lambda: K.fine_length(4, 2.0, 0)),
        ("InvalidType3Interval", lambda: Type3Config(((1, 0),), ((0, 1),))),
        ("InvalidDimensions", lambda: Type3Config(((0, 1),), ((0, 1), (0, 1)))),
        ("Type3GridSizeUnsupported", lambda: plan_axes(Type3Config(((-1e9, 1e9),), ((-1e9, 1e9),)))),
        ("FineGridMustBeEven", lambda: K.centered_kernel_fourier(15, K.kernel_for(1e-6, 2.0))),
    ],
)
def test_errors(code, make):
    with pytest.raises(TransformError) as e:
        make()
    assert e.value.code == code


@pytest.mark.parametrize("shape", [(256, 256), (64, 64, 64), (16, 16, 16, 16)])
def test_f32_reachability(shape):
    with pytest.raises(TransformError) as e:
        K.layout_for(TransformConfig(shape, eps=1e-6, sigma=1.25, precision="f32"))
    assert e.value.code == "F32ToleranceUnreachable"
    for other in ({"precision": "f64"}, {"precision": "df64"}, {"precision": "f32", "sigma": 2.0}):
        K.layout_for(TransformConfig(shape, **({"eps": 1e-6, "sigma": 1.25} | other)))


def test_type3_center_snaps():
    assert Interval(-9.001, 10.999).half_width_and_center()[1] == 0
    assert Interval(-9, 11).half_width_and_center()[1] == 1
    kernel, (axis,) = plan_axes(Type3Config(((0.5, 0.5),), ((3, 3),)))
    assert axis.length % 2 == 0 and axis.scale > 0


def test_config_is_hashable_and_normalised():
    assert TransformConfig([3, 4], mode_order="fft").mode_order is ModeOrder.FFT
    assert hash(TransformConfig((3,))) == hash(TransformConfig([3]))
    assert TransformConfig((3,), isign=0).sign == 1 and TransformConfig((3,), isign=-7).sign == -1
