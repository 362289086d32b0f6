"""Colour science on the driver: 3x3 matrices, adaptation, temperature.

These are a handful of numbers for each image; their results enter plans as
literals."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np

# Published constants of colour science.
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
D50_XY, D65_XY = (0.3457, 0.3585), (0.3127, 0.3290)
PROPHOTO_TO_XYZ_D50 = ((0.7976749, 0.1351917, 0.0313534), (0.2880402, 0.7118741, 0.0000857), (0.0, 0.0, 0.8252100))
XYZ_D65_TO_SRGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))

# White-balance presets, name to kelvin and tint.
WB_PRESETS = {
    "daylight": (5500, 10),
    "cloudy": (6500, 10),
    "shade": (7500, 10),
    "tungsten": (2850, 0),
    "fluorescent": (3800, 21),
    "flash": (5500, 0),
}

# Robertson's isotemperature lines as published: reciprocal
# megakelvin, u, v and slope.
ROBERTSON = (
    (0, 0.18006, 0.26352, -0.24341),
    (10, 0.18066, 0.26589, -0.25479),
    (20, 0.18133, 0.26846, -0.26876),
    (30, 0.18208, 0.27119, -0.28539),
    (40, 0.18293, 0.27407, -0.30470),
    (50, 0.18388, 0.27709, -0.32675),
    (60, 0.18494, 0.28021, -0.35156),
    (70, 0.18611, 0.28342, -0.37915),
    (80, 0.18740, 0.28668, -0.40955),
    (90, 0.18880, 0.28997, -0.44278),
    (100, 0.19032, 0.29326, -0.47888),
    (125, 0.19462, 0.30141, -0.58204),
    (150, 0.19962, 0.30921, -0.70471),
    (175, 0.20525, 0.31647, -0.84901),
    (200, 0.21142, 0.32312, -1.0182),
    (225, 0.21807, 0.32909, -1.2168),
    (250, 0.22511, 0.33439, -1.4512),
    (275, 0.23247, 0.33904, -1.7298),
    (300, 0.24010, 0.34308, -2.0637),
    (325, 0.24792, 0.34655, -2.4681),
    (350, 0.25591, 0.34951, -2.9641),
    (375, 0.26400, 0.35200, -3.5814),
    (400, 0.27218, 0.35407, -4.3633),
    (425, 0.28039, 0.35577, -5.3762),
    (450, 0.28863, 0.35714, -6.7262),
    (475, 0.29685, 0.35823, -8.5955),
    (500, 0.30505, 0.35907, -11.324),
    (525, 0.31320, 0.35968, -15.628),
    (550, 0.32129, 0.36011, -23.325),
    (575, 0.32931, 0.36038, -40.770),
    (600, 0.33724, 0.36051, -116.45),
)
TINT_SCALE = -3000.0


def xyz_of_xy(xy: Sequence[float]) -> np.ndarray:
    x, y = xy
    return np.array([x / y, 1.0, (1 - x - y) / y])


def bradford(source_xy: Sequence[float], target_xy: Sequence[float]) -> np.ndarray:
    """Adaptation of XYZ from one white to another; exactly 1 for equal whites."""
    if tuple(source_xy) == tuple(target_xy):
        return np.eye(3)
    m = np.array(BRADFORD)
    gain = (m @ xyz_of_xy(target_xy)) / (m @ xyz_of_xy(source_xy))
    return np.linalg.inv(m) @ np.diag(gain) @ m


def prophoto_to_srgb() -> np.ndarray:
    return np.array(XYZ_D65_TO_SRGB) @ bradford(D50_XY, D65_XY) @ np.array(PROPHOTO_TO_XYZ_D50)


def interpolate_illuminants(kelvin: float, low: tuple[float, np.ndarray], high: tuple[float, np.ndarray]) -> np.ndarray:
    """Matrix at a temperature: linear in 1/T between two calibrations."""
    (t1, m1), (t2, m2) = sorted((low, high), key=lambda p: p[0])
    w = mired_weight(kelvin, t1, t2)
    return w * np.array(m1, float) + (1 - w) * np.array(m2, float)


def camera_to_xyz(analog_balance: Sequence[float], calibration: np.ndarray, colour_matrix: np.ndarray) -> np.ndarray:
    """Inverse of AnalogBalance x CameraCalibration x ColorMatrix."""
    return np.linalg.inv(np.diag(analog_balance) @ np.array(calibration, float) @ np.array(colour_matrix, float))


def camera_to_pcs(camera_neutral: Sequence[float], xyz_to_camera: np.ndarray, forward: np.ndarray | None = None, analog_balance: Sequence[float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Camera to XYZ at D50: forward matrix x inverse neutral x inverse analog
    balance, where the neutral is taken before that balance; or the inverse colour
    matrix and adaptation of the neutral's white."""
    if forward is not None:
        balance = np.asarray(analog_balance, float)
        return np.array(forward, float) @ np.diag(1 / (np.asarray(camera_neutral, float) / balance)) @ np.diag(1 / balance)
    inverse = np.linalg.inv(np.array(xyz_to_camera, float))
    white = inverse @ np.asarray(camera_neutral, float)
    xy = white[:2] / white.sum()
    return bradford(tuple(xy), D50_XY) @ inverse / white[1]


def white_of_neutral(neutral: Sequence[float], matrix_at, tries: int = 30) -> tuple[float, float]:
    """The white point whose camera neutral is ``neutral``: ``matrix_at`` gives the
    XYZ-to-camera matrix at a temperature, and temperature follows from the white,
    so both are found by turns, from D50 on, as the public DNG specification describes
    (chapter 6, translating camera neutral coordinates to white balance xy).

    Each turn shrinks the difference by the part that the matrices differ between two
    temperatures, as a rule to a tenth; ``tries`` turns are for matrices far apart. If
    turns go back and forth for good, the middle of the last two is the result."""
    xy = last = D50_XY
    for _ in range(tries):
        kelvin, _ = temperature_of_uv(*uv_of_xy(*xy))
        white = np.linalg.solve(np.array(matrix_at(kelvin), float), np.asarray(neutral, float))
        last, xy = xy, tuple(float(v) for v in white[:2] / white.sum())
        if max(abs(a - b) for a, b in zip(last, xy)) < 1e-9:
            return xy
    return tuple((a + b) / 2 for a, b in zip(last, xy))


def camera_to_prophoto(camera_to_pcs_: np.ndarray) -> np.ndarray:
    """ProPhoto from PCS x camera to PCS."""
    return np.linalg.inv(np.array(PROPHOTO_TO_XYZ_D50)) @ np.array(camera_to_pcs_, float)


# Temperatures of the calibration illuminants by their EXIF codes.
ILLUMINANT_KELVIN = {17: 2856.0, 20: 5503.0, 21: 6504.0, 22: 7504.0, 23: 5003.0, 24: 3200.0}


def working_matrix(colour1: Sequence[float] | None, colour2: Sequence[float] | None = None, illuminants: tuple[int, int] = (17, 21), neutral: Sequence[float] | None = None, forward: Sequence[float] | None = None, balance: Sequence[float] | None = None, white: tuple[float, float] | None = None, calibrations: tuple = (None, None), forward2: Sequence[float] | None = None) -> np.ndarray:
    """Camera values to linear ProPhoto RGB by a file's tags: colour matrices of nine
    numbers at two illuminants with their cameras' calibrations, the neutral (or none:
    D50), forward matrices, the analog balance, and a ``white`` point that goes before
    the neutral. Without a colour matrix camera values are taken for linear sRGB."""
    if colour1 is None:
        return np.linalg.inv(prophoto_to_srgb())
    square = lambda m: np.reshape(np.asarray(m, float), (3, 3))
    given = lambda m, other: m if m is not None else other
    gain = np.diag(balance if balance is not None else (1.0, 1.0, 1.0))
    own = [square(c) if c is not None else np.eye(3) for c in calibrations]
    one, two = (gain @ c @ square(m) for c, m in zip(own, (colour1, given(colour2, colour1))))
    k1, k2 = (ILLUMINANT_KELVIN.get(int(c), 5003.0) for c in illuminants)
    between = lambda kelvin, a, b: interpolate_illuminants(kelvin, (k1, a), (k2, b))
    if white is None and neutral is None:
        white = D50_XY
    if white is None:
        white = white_of_neutral(neutral, lambda kelvin: between(kelvin, one, two))
        kelvin, _ = temperature_of_uv(*uv_of_xy(*white))
    else:
        kelvin, _ = temperature_of_uv(*uv_of_xy(*white))
        neutral = neutral_of_white(white, between(kelvin, one, two))
    ahead = None
    if forward is not None or forward2 is not None:
        ahead = between(kelvin, square(given(forward, forward2)), square(given(forward2, forward)))
    return camera_to_prophoto(camera_to_pcs(neutral, between(kelvin, one, two), ahead, np.diag(gain)))


def camera_to_srgb(colour1: Sequence[float] | None, *tags, **more) -> np.ndarray:
    """Camera values to linear sRGB by a file's tags (``working_matrix``)."""
    return np.eye(3) if colour1 is None else prophoto_to_srgb() @ working_matrix(colour1, *tags, **more)


def mired_weight(kelvin: float, low: float, high: float) -> float:
    """Share of the calibration at the lower of two temperatures, linear in 1/T."""
    t1, t2 = sorted((low, high))
    if kelvin <= t1 or t1 == t2:
        return 1.0
    return 0.0 if kelvin >= t2 else (1 / kelvin - 1 / t2) / (1 / t1 - 1 / t2)


def uv_of_xy(x: float, y: float) -> tuple[float, float]:
    d = -2 * x + 12 * y + 3
    return 4 * x / d, 6 * y / d


def xy_of_uv(u: float, v: float) -> tuple[float, float]:
    d = 2 * u - 8 * v + 4
    return 3 * u / d, 2 * v / d


def _line(i: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Reciprocal megakelvin, foot and unit direction of an isotemperature line."""
    mired, u, v, slope = ROBERTSON[i]
    along = np.array([1.0, slope])
    return mired, np.array([u, v]), along / np.linalg.norm(along)


def _between(i: int, f: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The line at part ``f`` of the way back from line ``i`` to the one before."""
    (r0, p0, d0), (r1, p1, d1) = _line(i - 1), _line(i)
    along = f * d0 + (1 - f) * d1
    return f * r0 + (1 - f) * r1, f * p0 + (1 - f) * p1, along / np.linalg.norm(along)


def uv_of_temperature(kelvin: float, tint: float = 0.0) -> tuple[float, float]:
    """Point on the lines between Robertson's, moved along them by the tint."""
    mired = 1e6 / kelvin
    i = min(1 + sum(line[0] < mired for line in ROBERTSON[1:]), len(ROBERTSON) - 1)
    r0, r1 = ROBERTSON[i - 1][0], ROBERTSON[i][0]
    _, foot, along = _between(i, (r1 - mired) / (r1 - r0))
    u, v = foot + along * (tint / TINT_SCALE)
    return float(u), float(v)


def temperature_of_uv(u: float, v: float) -> tuple[float, float]:
    """Kelvin and tint of a point.

    Robertson's definition: the point's signed distances to neighbouring lines have
    different signs where it lies between them, and the reciprocal temperature is
    their root in proportion. Points beyond all lines take the first or last one."""
    at = np.array([u, v])
    distance = []
    for i in range(len(ROBERTSON)):
        _, foot, along = _line(i)
        du, dv = at - foot
        distance.append(dv * along[0] - du * along[1])
    last = len(ROBERTSON) - 1
    i = next((i for i in range(1, last + 1) if distance[i] <= 0), last)
    near, far = distance[i - 1], distance[i]
    f = 1.0 if near <= 0 else 0.0 if far > 0 else far / (far - near)
    mired, foot, along = _between(i, f)
    return (1e6 / mired if mired else math.inf), float((at - foot) @ along) * TINT_SCALE


def neutral_of_white(xy: Sequence[float], xyz_to_camera: np.ndarray) -> np.ndarray:
    """Camera neutral of a white point, its largest channel 1."""
    n = np.array(xyz_to_camera, float) @ xyz_of_xy(xy)
    return n / n.max()


def default_tone(n: int = 256, contrast: float = 0.18) -> list[float]:
    """A rising curve from 0 to 1 for images that bring none: a line bent into an
    S by a sine. It is this library's own; published profiles bring their samples."""
    return [i / (n - 1) - contrast * math.sin(2 * math.pi * i / (n - 1)) / (2 * math.pi) for i in range(n)]
