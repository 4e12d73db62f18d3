"""Scalar functions as Spark column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def rounded(v: Column, digits: int) -> Column:
    """v to `digits` places as SQL engines of binary numbers round it: half away
    from 0 of v * 10^digits.  F.round takes the shortest decimal form of v, and so
    differs where that ends in 5 and the product falls beside the half."""
    scale = 10.0**digits
    return F.when(F.abs(v) < 1e308 / scale, F.round(v * scale) / scale).otherwise(v)


def smoothstep(v: Column, low: float, high: float) -> Column:
    t = clamp((v - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def deadband(v: Column, width: float) -> Column:
    """The part of |v| beyond the width, with v's sign."""
    return F.signum(v) * F.greatest(F.abs(v) - width, F.lit(0.0))


def polyval(coefficients: Sequence[float], x: Column) -> Column:
    """Ascending powers, by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(list(coefficients)):
        out = out * x + float(c)
    return out


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26, error below 1.5e-7."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-a * a))


def lanczos3(x: Column) -> Column:
    a = math.pi * x
    return F.when(F.abs(x) < 1e-9, F.lit(1.0)).when(F.abs(x) >= 3, F.lit(0.0)).otherwise(3 * F.sin(a) * F.sin(a / 3) / (a * a))


def anscombe(v: Column, gain: float, noise: float) -> Column:
    """Generalized Anscombe transform: makes Poisson plus read noise of unit variance."""
    return 2 / gain * F.sqrt(F.greatest(gain * v + 0.375 * gain * gain + noise * noise, F.lit(0.0)))


def anscombe_inverse(t: Column, gain: float, noise: float) -> Column:
    return (t * gain / 2) * (t * gain / 2) / gain - 0.375 * gain - noise * noise / gain


def halpha_rgb(t: Column) -> tuple[Column, Column, Column]:
    """Red ramps first, green and blue follow by powers."""
    return F.least(2.6 * t, F.lit(1.0)), F.pow(t, F.lit(1.6)), 0.55 * F.pow(t, F.lit(4.0))


def parabola_vertex(left: Column, mid: Column, right: Column, limit: float) -> Column:
    """Offset of the vertex through three samples a step apart, clamped; 0 where they are straight."""
    curve = left - 2 * mid + right
    return F.when(F.abs(curve) < 1e-12, F.lit(0.0)).otherwise(clamp(0.5 * (left - right) / curve, -limit, limit))


def dispersion(pixel_um: Column, binning: Column, grating_lpmm: Column, focal_mm: Column, angle_deg: float, order: int, wavelength: Column) -> Column:
    """Angstrom a pixel of a spectrograph with a fixed angle between the beams;
    null where no grating angle satisfies it."""
    period = 1e7 / grating_lpmm  # in Angstrom
    half = math.radians(angle_deg / 2)
    s = order * wavelength / (2 * period * math.cos(half))
    beta = F.asin(s) - half
    ok = (F.abs(s) <= 1) & (focal_mm > 0) & (grating_lpmm > 0)
    return F.when(ok, F.abs(F.cos(beta)) * period * (pixel_um * binning / 1000.0) / (focal_mm * order))


def wrap_degrees(a: Column) -> Column:
    """Into -180..180, 180 excluded."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def angular_distance(a: Column, b: Column) -> Column:
    return F.abs(wrap_degrees(a - b))


def soft_threshold(v: Column, t: float) -> Column:
    return deadband(v, t)


def quantise16(v: Column, low: Column, high: Column) -> Column:
    """0..65535, truncated."""
    return F.floor(clamp((v - low) * 65535.0 / (high - low), 0, 65535)).cast("int")


def velocity_to_code(v: Column, scale: float = 1.5) -> Column:
    return quantise16(v, F.lit(-scale), F.lit(scale))


def code_to_velocity(code: Column, scale: float = 1.5) -> Column:
    return (code / 65535.0 * 2 - 1) * scale


def diverging(v: Column, limit: Column) -> tuple[Column, Column]:
    """(red, blue) strength of a signed value against a limit."""
    t = clamp(v / limit, -1, 1)
    return F.greatest(t, F.lit(0.0)), F.greatest(-t, F.lit(0.0))


def radius_from(x: Column, y: Column, xc: float, yc: float, r: float) -> Column:
    return F.sqrt((x - xc) * (x - xc) + (y - yc) * (y - yc)) / r


def sampson(x: Column, y: Column, conic: Sequence[float]) -> Column:
    """First-order distance of a point from a conic a x2 + b xy + c y2 + d x + e y + f = 0."""
    a, b, c, d, e, f = (float(k) for k in conic)
    value = a * x * x + b * x * y + c * y * y + d * x + e * y + f
    gx, gy = 2 * a * x + b * y + d, b * x + 2 * c * y + e
    return F.abs(value) / F.sqrt(gx * gx + gy * gy)


def ticks_to_timestamp(ticks: Column) -> Column:
    """100 ns since year 1 to a timestamp."""
    return F.timestamp_micros((F.floor(ticks / F.lit(10)) - F.lit(62135596800000000)).cast("bigint"))


def parse_settings(text: Column) -> Column:
    """`k=v,k=v` as a map of doubles; entries that are no numbers are null."""
    return F.transform_values(F.str_to_map(text, F.lit(","), F.lit("=")), lambda _, v: F.trim(v).try_cast("double"))
