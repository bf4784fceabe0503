"""Column expressions on samples, colours, angles and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(v: Column, low: float = 0, high: float = 255) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def narrow(v: Column) -> Column:
    """16-bit sample to 8 bits as detection does it: the high byte."""
    return F.shiftright(v, 8)


def scaled_down(v: Column) -> Column:
    """16-bit sample to 8 bits as repair does it: divided by 257, truncated."""
    return F.floor(v / 257).cast("int")


def widen(v: Column) -> Column:
    """8-bit sample to 16 bits: 255 becomes 65535."""
    return v * 257


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luminance of BGR samples, rounded."""
    return F.floor(0.114 * b + 0.587 * g + 0.299 * r + 0.5).cast("int")


def mean_level(b: Column, g: Column, r: Column) -> Column:
    return (b + g + r) / 3


def advantage(own: Column, a: Column, b: Column) -> Column:
    """How far a channel exceeds the (floored) mean of the two others; not below 0."""
    return F.greatest(own - F.floor((a + b) / 2).cast("int"), F.lit(0))


def order_stats(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column, Column]:
    """Largest, middle and smallest channel, and the mean of the two smaller ones."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    mid = b + g + r - top - low
    return top, mid, low, (low + mid) / 2


def bias(own: Column, a: Column, b: Column) -> Column:
    return own - 0.5 * (a + b)


def line_angle(dx: Column, dy: Column) -> Column:
    """Direction of a line in degrees, 0 to below 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def angle_gap(a: Column, b: Column) -> Column:
    """Difference of two line directions, 0 to 90 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def line_distance(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> Column:
    """Distance of (x, y) from the line through (cx, cy) at ``angle`` degrees."""
    t = F.radians(angle)
    return F.abs((y - cy) * F.cos(t) - (x - cx) * F.sin(t))


def rho(x: Column, y: Column, dx: Column, dy: Column) -> Column:
    """Signed distance from the origin of a line, the same from either end."""
    x, y, dx, dy = (c.cast("double") for c in (x, y, dx, dy))  # products of integers may overflow
    flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1.0).otherwise(1.0)
    return flip * (y * dx - x * dy) / F.sqrt(dx * dx + dy * dy) + F.lit(0.0)  # no negative zero


def unit_vector(angle: Column) -> tuple[Column, Column]:
    return F.cos(F.radians(angle)), F.sin(F.radians(angle))


def brightened(v: Column, brightness: float) -> Column:
    """Gamma lookup of the mask view: 255 * (v / 255) ** (1 / brightness), truncated."""
    return clip(255 * F.pow(v / 255, F.lit(1.0 / brightness))).cast("int")


def overlay(v: Column, colour: int = 0x80FF0000) -> Column:
    """ARGB colour where a mask sample is above 127, else transparent."""
    return F.when(v > 127, F.lit(colour)).otherwise(F.lit(0))


def blended(v: Column, colour: Column, share: float = 0.5) -> Column:
    """A sample under a half transparent debug colour, truncated."""
    return F.floor(share * colour + (1 - share) * v).cast("int")


def resolution_scale(width, height):
    """Area and length scale against the 20-megapixel frame that defaults are set for, of numbers or columns."""
    area = width * height / (5472 * 3648)
    return area, area**0.5


def scaled_floor(least: int, at_reference: float, scale):
    """A limit that grows with the scale but never falls below ``least``, of a number or a column."""
    if isinstance(scale, Column):
        return F.greatest(F.lit(least), (at_reference * scale).cast("int"))
    return max(least, int(at_reference * scale))
