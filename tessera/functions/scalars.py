"""Scalar functions as column expressions: text, numbers, boxes, affine maps, colours, identifiers, encodings.

All stay in generated code; none is a user function. Nulls give null unless a function says otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]
Box = tuple[Column, Column, Column, Column]


# Text.


def clean_text(c: Column, most: int = 80) -> Column:
    """Trimmed, white space collapsed, cut to `most` characters."""
    return F.substring(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), 1, most)


def slug(c: Column) -> Column:
    """Lower case, punctuation gone, runs of spaces and hyphens as one hyphen."""
    kept = F.regexp_replace(F.lower(c.cast("string")), r"[^\p{L}\p{N}\s_-]+", "")
    return F.regexp_replace(F.trim(F.regexp_replace(kept, r"[\s-]+", " ")), " ", "-")


def after_first(c: Column, mark: str) -> Column:
    """What follows the first mark; null without one."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substr(c, at + len(mark)))


def before_last(c: Column, mark: str) -> Column:
    """What stands before the last mark; the whole text without one."""
    at = F.length(c) - F.length(F.substring_index(c, mark, -1)) - len(mark)
    return F.when(F.contains(c, F.lit(mark)), F.substring(c, F.lit(1), at)).otherwise(c)


def without_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def unset(c: Column) -> Column:
    """Null for null, blank text and texts of empty lists: what counts as an unset parameter."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin("", "[]", "{}"), c)


# Numbers.


def finite(c: Column) -> Column:
    """Null for null, NaN and infinities."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)


def clip(c: Column, low: float, high: float) -> Column:
    """NaN and null stay null."""
    v = F.when(~F.isnan(c.cast("double")), c.cast("double"))
    return F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(float(high))), F.lit(float(low))))


def ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("bigint")


def next_power_of_two(c: Column) -> Column:
    """The least power of two that is at least c; 1 for c up to 1."""
    return F.when(c <= 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(c.cast("double")) - 1e-12))).cast("bigint")


def nice_step(span: Column, parts: int = 5) -> Column:
    """The least of 1, 2, 2.5, 5, 10 times a power of ten that is at least span / parts; null for a span of 0 or less."""
    raw = span / parts
    ten = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    lead = F.round(raw / ten, 9)
    return F.when(span > 0, F.when(lead <= 1, 1.0).when(lead <= 2, 2.0).when(lead <= 2.5, 2.5).when(lead <= 5, 5.0).otherwise(10.0) * ten)


def significant(c: Column, digits: int = 10) -> Column:
    """c rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))))
    return F.when(c == 0, 0.0).when(finite(c).isNotNull(), F.round(c * scale) / scale)


def rotate(x: Column, y: Column, degrees: float, cx: float = 0.0, cy: float = 0.0) -> tuple[Column, Column]:
    a = math.radians(degrees)
    dx, dy = x - cx, y - cy
    return dx * math.cos(a) - dy * math.sin(a) + cx, dx * math.sin(a) + dy * math.cos(a) + cy


# Affine maps (a, b, c, d, e, f): x' = a x + b y + c, y' = d x + e y + f.


def apply(m: Affine | Column, x: Column, y: Column) -> tuple[Column, Column]:
    """m as numbers, or as a struct column with fields a to f."""
    a, b, c, d, e, f = m if isinstance(m, tuple) else (m[k] for k in "abcdef")
    return a * x + b * y + c, d * x + e * y + f


def compose(outer: Affine, inner: Affine) -> Affine:
    """First inner, then outer."""
    a, b, c, d, e, f = outer
    p, q, r, s, t, u = inner
    return a * p + b * s, a * q + b * t, a * r + b * u + c, d * p + e * s, d * q + e * t, d * r + e * u + f


def is_identity(m: Affine, tolerance: float = 1e-9) -> bool:
    return all(abs(v - w) <= tolerance for v, w in zip(m, (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)))


def inverse(m: Affine) -> Affine:
    """A map without an inverse is an error."""
    a, b, c, d, e, f = m
    det = a * e - b * d
    if det == 0:
        raise ValueError("the affine map has no inverse")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def inverse_columns(m: Column) -> Column:
    """The inverse of a struct column with fields a to f; a determinant of 0 fails the query."""
    a, b, c, d, e, f = (m[k] for k in "abcdef")
    raw = a * e - b * d
    det = F.when(raw == 0, F.raise_error(F.lit("the affine map has no inverse")).cast("double")).otherwise(raw)
    parts = (e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det)
    return F.struct(*(v.alias(k) for k, v in zip("abcdef", parts)))


# Boxes (xmin, ymin, xmax, ymax).


def transformed_box(m: Affine | Column, box: Box) -> Box:
    """The box of all four corners after the map."""
    xs, ys = zip(*(apply(m, box[i], box[j]) for i in (0, 2) for j in (1, 3)))
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def box_area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def boxes_meet(a: Box, b: Box) -> Column:
    """Closed edges; boxes with null or NaN ends never meet (false)."""
    ends = [F.coalesce(~F.isnan(v.cast("double")), F.lit(False)) for v in (*a, *b)]
    fine = ends[0]
    for e in ends[1:]:
        fine = fine & e
    return fine & F.coalesce((a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3]), F.lit(False))


def box_iou(a: Box, b: Box) -> Column:
    """Shared area over joint area; 0 where both areas are 0."""
    shared = box_area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))
    joint = box_area(a) + box_area(b) - shared
    return F.when(joint > 0, shared / joint).otherwise(0.0)


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column, segments: int = 64) -> Column:
    """The ring of an ellipse as an array of (x, y)."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda k: k * (2 * math.pi / segments))
    return F.transform(turn, lambda t: F.struct((cx + rx * F.cos(t)).alias("x"), (cy + ry * F.sin(t)).alias("y")))


def ring_area(ring: Column) -> Column:
    """The area of a ring (array of structs x, y) by the shoelace rule, not negative; under three vertices 0."""
    n = F.size(ring)
    cross = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2)


def ring_centroid(ring: Column) -> Column:
    """The mean of a ring's vertices (struct x, y)."""
    mean = lambda k: F.aggregate(F.transform(ring, lambda p: p[k].cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


# Colours, identifiers, encodings, dates.


def rgb(c: Column) -> Column:
    """array(r, g, b) of #rrggbb (the mark is optional); null for anything else."""
    six = F.upper(F.regexp_extract(c, r"^#?([0-9A-Fa-f]{6})$", 1))
    part = lambda k: F.conv(F.substring(six, k, 2), 16, 10).cast("int")
    return F.when(six != "", F.array(part(1), part(3), part(5)))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    two = lambda v: F.lpad(F.lower(F.hex(v.cast("int"))), 2, "0")
    return F.concat(F.lit("#"), two(r), two(g), two(b))


def short_hash(c: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of the SHA-256 of a text or of bytes."""
    return F.substring(F.sha2(c, 256), 1, digits)


def percent_decoded(c: Column) -> Column:
    """The text itself where its escapes are broken."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)


def base64url(c: Column) -> Column:
    """base64 of a text's UTF-8 with - and _ and without padding."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", ""), "+/", "-_"), "=+$", "")


def from_base64url(c: Column) -> Column:
    padded = F.rpad(F.translate(c, "-_", "+/"), F.ceil(F.length(c) / 4).cast("int") * 4, "=")
    return F.decode(F.unbase64(padded), "UTF-8")


def iso_utc(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


# Arrays.


def unique_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def pairs(a: Column, b: Column) -> Column:
    """Elements of both at the same place; the longer one's rest goes."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.struct(x.alias("a"), y.alias("b")))


# Distributions.


def normal_tail(z: Column) -> Column:
    """The two-sided normal p-value, by the rational approximation of Abramowitz and Stegun 7.1.26 (error under 2e-7)."""
    v = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * v)
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return poly * F.exp(-v * v)


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X >= x) of a chi-square variable of a whole number of degrees of freedom, by its finite sum."""
    half, odd = x / 2, dof.cast("int") % 2 == 1
    terms = F.sequence(F.lit(1), F.greatest(F.floor((dof.cast("int") - F.when(odd, 1).otherwise(2)) / 2).cast("int"), F.lit(0)) + 1)
    last = F.floor((dof.cast("int") - F.when(odd, 1).otherwise(2)) / 2).cast("int")
    # even: sum of half^i / i!, i = 0..dof/2-1; odd: the normal tail and half^(i-1/2) / gamma(i+1/2), i = 1..(dof-1)/2
    first = F.when(odd, F.sqrt(half) * (2 / math.sqrt(math.pi))).otherwise(half)
    start = F.struct(first.cast("double").alias("t"), F.when(odd, 0.0).otherwise(1.0).cast("double").alias("s"))
    add = lambda a, i: F.struct((a["t"] * half / (i + F.when(odd, 0.5).otherwise(1.0))).alias("t"), (a["s"] + F.when(i <= last, a["t"]).otherwise(0.0)).alias("s"))
    total = F.aggregate(terms, start, add)["s"]
    return F.when(x <= 0, 1.0).otherwise(F.least(F.when(odd, normal_tail(F.sqrt(x))).otherwise(0.0) + F.exp(-half) * total, F.lit(1.0)))
