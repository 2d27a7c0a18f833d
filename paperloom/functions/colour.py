"""Colour conversions, as native columns and, by the same formulas, in plain Python for the decode stages.

Every function takes components from 0 to 1 (Lab in its own ranges) and gives three or four from 0 to 1; what is outside
is clamped, and what isn't finite counts as 0.
"""

from __future__ import annotations

import math
import types

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

#: The published quadratic approximation of a SWOP press. Per channel the coefficients of
#: c*c, c*m, c*y, c*k, c, m*m, m*y, m*k, m, y*y, y*k, y, k*k, k, on a scale of 255.
PRESS = (
    (-4.387332384609988, 54.48615194189176, 18.82290502165302, 212.25662451639585, -285.2331026137004, 1.7149763477362134, -5.6096736904047315, -17.873870861415444, -5.497006427196366, -2.5217340131683033, -21.248923337353073, 17.5119270841813, -21.86122147463605, -189.48180835922747),
    (8.841041422036149, 60.118027045597366, 6.871425592049007, 31.159100130055922, -79.2970844816548, -15.310361306967817, 17.575251261109482, 131.35250912493976, -190.9453302588951, 4.444339102852739, 9.8632861493405, -24.86741582555878, -20.737325471181034, -187.80453709719578),
    (0.8842522430003296, 8.078677503112928, 30.89978309703729, -0.23883238689178934, -14.183576799673286, 10.49593273432072, 63.02378494754052, 50.606957656360734, -112.23884253719248, 0.03296041114873217, 115.60384449646641, -193.58209356861505, -22.33816807309886, -180.12613974708367),
)
#: XYZ of a D65 white to linear sRGB; XYZ to cone responses and back; the D65 white.
TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))
TO_CONES = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
FROM_CONES = ((0.9869929, -0.1470543, 0.1599627), (0.4323053, 0.5183603, 0.0492912), (-0.0085287, 0.0400428, 0.9684867))
D65 = (0.95047, 1.0, 1.08883)

def _clamped(x: Column) -> Column:
    inside = lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))
    return let(x, inside)


#: The operations that the formulas need, on numbers and on columns. bind() works a row out once for all its uses.
_NUMBERS = types.SimpleNamespace(
    row=list, bind=lambda row, f: f(row), dot=lambda row, weights: sum(w * x for w, x in zip(weights, row)), clamp=lambda x: min(1.0, max(0.0, x)) if math.isfinite(x) else 0.0,
    pick=lambda test, yes, no: yes if test else no, power=lambda x, p: max(0.0, x) ** p,
)
_COLUMNS = types.SimpleNamespace(
    row=lambda xs: F.array(*xs), bind=let, dot=lambda row, weights: F.aggregate(F.zip_with(row, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), clamp=_clamped,
    pick=lambda test, yes, no: F.when(test, yes).otherwise(no), power=lambda x, p: F.pow(F.greatest(F.lit(0.0), x), F.lit(p)),
)


def _press(o, c, m, y, k):
    def terms(v):
        c, m, y, k = (v[i] for i in range(4))
        return o.row([c * c, c * m, c * y, c * k, c, m * m, m * y, m * k, m, y * y, y * k, y, k * k, k])

    channels = lambda t: o.row([o.clamp((255.0 + o.dot(t, row)) / 255.0) for row in PRESS])
    return o.bind(o.bind(o.row(list(map(o.clamp, (c, m, y, k)))), terms), channels)


def _times(o, matrix, v):
    return o.bind(v, lambda x: o.row([o.dot(x, row) for row in matrix]))


def _srgb(o, xyz):
    light = o.bind(_times(o, TO_SRGB, xyz), lambda v: o.row([o.clamp(v[k]) for k in range(3)]))
    return o.bind(light, lambda v: o.row([o.pick(v[k] <= 0.0031308, 12.92 * v[k], 1.055 * o.power(v[k], 1 / 2.4) - 0.055) for k in range(3)]))


def _lab(o, l, a, b, white: tuple[float, float, float]):  # noqa: E741
    edge = 6.0 / 29.0
    fy = (l + 16.0) / 116.0
    from_f = lambda f: o.row([w * o.pick(f[k] >= edge, f[k] * f[k] * f[k], 3.0 * edge * edge * (f[k] - 4.0 / 29.0)) for k, w in enumerate(white)])
    xyz = o.bind(o.row([fy + a / 500.0, fy, fy - b / 200.0]), from_f)
    source, target = _times(_NUMBERS, TO_CONES, white), _times(_NUMBERS, TO_CONES, D65)
    if all(math.isfinite(s) and abs(s) >= 2.3e-16 for s in source):
        cones = o.bind(_times(o, TO_CONES, xyz), lambda c: o.row([c[k] * (target[k] / source[k]) for k in range(3)]))
        xyz = _times(o, FROM_CONES, cones)
    return _srgb(o, xyz)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> Column:
    """Array of red, green and blue, by the approximation of a press."""
    return _press(_COLUMNS, c, m, y, k)


def cmyk_to_rgb_plain(c: Column, m: Column, y: Column, k: Column) -> Column:
    clamp = _COLUMNS.clamp
    return F.array(*[(1.0 - clamp(v)) * (1.0 - clamp(k)) for v in (c, m, y)])


def rgb_to_cmyk_plain(r: Column, g: Column, b: Column) -> Column:
    """The inverse of cmyk_to_rgb_plain() with as much black as can be."""
    r, g, b = map(_COLUMNS.clamp, (r, g, b))
    top = F.greatest(r, g, b)
    return F.array(*[F.when(top > 0, (top - v) / top).otherwise(F.lit(0.0)) for v in (r, g, b)], 1.0 - top)


def lab_to_rgb(l: Column, a: Column, b: Column, white: tuple[float, float, float] = (0.9643, 1.0, 0.8251)) -> Column:  # noqa: E741
    return _lab(_COLUMNS, l, a, b, white)


def xyz_to_srgb(x: Column, y: Column, z: Column) -> Column:
    return _srgb(_COLUMNS, F.array(x, y, z))


def rgb(space: str, values: tuple) -> tuple[float, ...]:
    """RGB from 0 to 1 of a colour of page content; black for patterns and spaces that need a profile or a function."""
    v = [float(x) for x in values if isinstance(x, (int, float))]
    if space in ("DeviceGray", "CalGray") and v:
        return (_NUMBERS.clamp(v[0]),) * 3
    if space in ("DeviceRGB", "CalRGB") and len(v) >= 3:
        return tuple(map(_NUMBERS.clamp, v[:3]))
    if space == "DeviceCMYK" and len(v) >= 4:
        return tuple(_press(_NUMBERS, *v[:4]))
    if space == "Lab" and len(v) >= 3:
        return tuple(_lab(_NUMBERS, *v[:3], (0.9643, 1.0, 0.8251)))
    if space == "Separation" and v:
        return (1 - _NUMBERS.clamp(v[0]),) * 3
    return 0.0, 0.0, 0.0


def rgb_bytes(space: str, values: tuple) -> tuple[int, ...]:
    return tuple(math.floor(255 * x + 0.5) for x in rgb(space, values))
