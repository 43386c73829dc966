"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intround(c: Column) -> Column:
    """Round half to even."""
    return F.rint(c).cast("long")


def intfloor(c: Column) -> Column:
    return F.floor(c).cast("long")


def intceil(c: Column) -> Column:
    return F.ceil(c).cast("long")


def dist(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.pow(x1 - x2, 2) + F.pow(y1 - y2, 2))


def strip_prefix(s: Column, prefix: str) -> Column:
    """Remove one exact prefix, not a set of characters."""
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 1 << 30)).otherwise(s)


def strip_suffix(s: Column, suffix: str) -> Column:
    """Remove one exact suffix."""
    if not suffix:
        return s
    return F.when(s.endswith(suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s)


def ascii_head(s: Column) -> Column:
    """The text up to the first character outside 32..127, TAB, LF, CR."""
    return F.regexp_extract(s, r"^[\x20-\x7F\t\n\r]*", 0)


def matlab_name(s: Column) -> Column:
    """Spaces, dots and dashes become underscores; at most 63 characters or null."""
    out = F.translate(s, " .-", "___")
    return F.when(F.length(out) <= 63, out)


def short_list(a: Column) -> Column:
    """Comma-separated rendering of an array in brackets."""
    return F.concat(F.lit("["), F.concat_ws(", ", a.cast("array<string>")), F.lit("]"))


def duration_us(a: Column, b: Column) -> Column:
    """a - b in whole microseconds."""
    return F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))


def duration_days(a: Column, b: Column) -> Column:
    return duration_us(a, b) / F.lit(86_400_000_000.0)


def source_root(s: Column) -> Column:
    """File name without leading ../ and extension, spaces to underscores (X11)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^(\.\./)+", ""), r"\.[^./]*$", ""), " ", "_")


def ole_datetime(days: Column) -> Column:
    """Days since 1899-12-30 as a timestamp."""
    return F.timestamp_micros((F.rint(days * 86_400_000_000.0) - F.lit(25569 * 86_400_000_000)).cast("long"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#RRGGBB of three 0..255 values."""
    return F.concat(F.lit("#"), *[F.lpad(F.hex(c.cast("long")), 2, "0") for c in (r, g, b)])


def hex_rgb(s: Column) -> Column:
    """Array of the three values of #RRGGBB."""
    return F.array(*[F.conv(F.substring(s, k, 2), 16, 10).cast("int") for k in (2, 4, 6)])


def ad_to_uv(ad: Column, uv_per_ad: Column | float) -> Column:
    """Linear converter (section 1.4, X9)."""
    return ad * uv_per_ad


def uv_to_ad(uv: Column, uv_per_ad: Column | float) -> Column:
    """Inverse, rounded half to even and kept inside 16 bits."""
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), F.rint(uv / uv_per_ad))).cast("int")


def gain_converter(ad: Column, int_gain: float, ext_gain: float) -> Column:
    """uV of a +-10 V converter behind two gains: 1e7 uV over 2^15 steps."""
    return ad * F.lit(1e7 / (2**15 * int_gain * ext_gain))


def gaussian(x: Column, mu: float, sigma: float) -> Column:
    """Unit-height Gaussian."""
    return F.exp(-F.pow(x - mu, 2) / (2 * sigma * sigma))


def cauchy(x: Column, mu: float, gamma: float) -> Column:
    return F.lit(1.0) / (1 + F.pow((x - mu) / gamma, 2))
