"""Scalar column functions: time conversion, lenient parsing, vectors, colours, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: added to a norm before it divides a vector.
NORM_EPSILON = 1e-8
#: Fixed value: a standard deviation below this counts as zero in a correlation.
FLAT_STD = 1e-9
#: Colours of teams 0 and 1, and of no team.
TEAM_COLORS = {0: "#3cdc3c", 1: "#f03c3c"}
NO_TEAM_COLOR = "#9c9c9c"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(frames: Column | str, fps: Column | float, digits: int | None = 2) -> Column:
    """Frames as seconds, half-even at ``digits``; 0.0 when fps is 0 or less."""
    fps = fps if isinstance(fps, Column) else F.lit(float(fps))
    value = F.try_divide(col(frames).cast("double"), fps)
    value = value if digits is None else F.bround(value, digits)
    return F.when(fps > 0, value).otherwise(F.lit(0.0))


def frames(seconds_: float, fps: float, least: int = 0) -> int:
    """Seconds as a whole number of frames (half-even), for use as a literal."""
    return max(least, round(seconds_ * fps)) if fps > 0 else least


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, 0.0 on a zero or null denominator."""
    return F.coalesce(F.try_divide(col(a).cast("double"), col(b).cast("double")), F.lit(0.0))


def clip(x: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def clean_text(x: Column | str) -> Column:
    """Null as the empty string, then trimmed."""
    return F.trim(F.coalesce(col(x).cast("string"), F.lit("")))


def lenient_int(x: Column | str) -> Column:
    """Text of a number, fractions truncated; null if it is none."""
    return F.trim(col(x).cast("string")).try_cast("double").try_cast("long")


def lenient_team(x: Column | str) -> Column:
    """Text of a whole number; null for anything else, also for a decimal notation."""
    text = F.trim(col(x).cast("string"))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def lenient_double(x: Column | str) -> Column:
    """Text of a number; 0.0 if it is none."""
    return F.coalesce(F.trim(col(x).cast("string")).try_cast("double"), F.lit(0.0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products in index order."""
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column | str) -> Column:
    n = norm(a) + F.lit(NORM_EPSILON)
    return F.transform(col(a), lambda x: x.cast("double") / n)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - dot of unit vectors, within 0 and 2."""
    return clip(F.lit(1.0) - dot(a, b), 0.0, 2.0)


def log_size(x: Column | str) -> Column:
    return F.log(col(x).cast("double") + F.lit(1e-6))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Aggregate: Pearson correlation, 0.0 if either side is flat."""
    x, y = col(x).cast("double"), col(y).cast("double")
    flat = (F.coalesce(F.stddev_pop(x), F.lit(0.0)) < FLAT_STD) | (F.coalesce(F.stddev_pop(y), F.lit(0.0)) < FLAT_STD)
    return F.when(flat, F.lit(0.0)).otherwise(F.corr(x, y))


def hue_distance(a: Column | str, b: Column | str) -> Column:
    """Distance on a circle of 180."""
    d = F.abs(col(a) - col(b))
    return F.least(d, F.lit(180.0) - d)


def hsv(blue: Column | str, green: Column | str, red: Column | str) -> Column:
    """struct<h, s, v> of 0..255 channels, hue within 0..180, the others within 0..255."""
    b, g, r = (col(c).cast("double") / 255.0 for c in (blue, green, red))
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = high - low
    sector = (
        F.when(span < 1e-9, F.lit(0.0))
        .when(high == r, F.pmod((g - b) / span, F.lit(6.0)))
        .when(high == g, (b - r) / span + 2.0)
        .otherwise((r - g) / span + 4.0)
    )
    saturation = F.when(high < 1e-9, F.lit(0.0)).otherwise(span / high)
    return F.struct((sector * 30.0).alias("h"), (saturation * 255.0).alias("s"), (high * 255.0).alias("v"))


def escape_html(x: Column | str) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(x).cast("string"))


def data_uri(binary: Column | str, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col(binary)))


def team_label(team: Column | str) -> Column:
    return F.coalesce(F.concat(F.lit("T"), col(team).cast("string")), F.lit("-"))


def player_label(player: Column | str, name: Column | None = None, team: Column | None = None) -> Column:
    """The name, or else P and the id; with a team also `` (T<k>)``."""
    label = F.concat(F.lit("P"), col(player).cast("string"))
    if name is not None:
        label = F.coalesce(F.nullif(clean_text(name), F.lit("")), label)
    if team is not None:
        label = F.concat(label, F.coalesce(F.concat(F.lit(" (T"), team.cast("string"), F.lit(")")), F.lit("")))
    return label


def team_color(team: Column | str) -> Column:
    """Hex colour of a team, the neutral one for any other value."""
    out = F.lit(NO_TEAM_COLOR)
    for k, value in TEAM_COLORS.items():
        out = F.when(lenient_team(team) == k, F.lit(value)).otherwise(out)
    return out


def joined_ids(id_: Column | str, *order: str) -> Column:
    """Aggregate: ids as text, separated by spaces, in the given order."""
    keys = F.struct(*[F.col(c) for c in order], col(id_).cast("string").alias("_id"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(keys)), lambda s: s["_id"]), " ")


def clip_filename(segment: Column | str, start_s: Column | str, end_s: Column | str) -> Column:
    """Name of a segment's video file: its number and whole seconds."""
    return F.format_string("segment_%03d_%ds-%ds.mp4", col(segment).cast("int"), col(start_s).cast("int"), col(end_s).cast("int"))


def rounded_position(x: Column | str) -> Column:
    """The nearest whole position, half-even."""
    return F.rint(col(x)).cast("long")


def truncated_position(x: Column | str, size: int) -> Column:
    """Truncated to a whole position and kept inside 0 .. size - 1."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), col(x).cast("int")))


def bar_duration(start: Column | str, end: Column | str) -> Column:
    return F.greatest(F.lit(0.0), col(end) - col(start))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: int, height: int, pad: float = 0.0) -> Column:
    """The padded box inside the frame as a struct, or null if nothing is left of it."""
    px, py = (x2 - x1) * pad, (y2 - y1) * pad
    left, top = F.greatest(F.lit(0), (x1 - px).cast("int")), F.greatest(F.lit(0), (y1 - py).cast("int"))
    right, bottom = F.least(F.lit(width), (x2 + px).cast("int")), F.least(F.lit(height), (y2 + py).cast("int"))
    box = F.struct(left.alias("x1"), top.alias("y1"), right.alias("x2"), bottom.alias("y2"))
    return F.when((right > left) & (bottom > top), box)
