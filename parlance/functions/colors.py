"""Colours as #rrggbb."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(n: Column) -> Column:
    """A channel of 0 to 255 as two digits."""
    return F.lpad(F.lower(F.hex(n.cast("long"))), 2, "0")


def _hsl(s: Column) -> Column:
    """hsl(h, s%, l%) to #rrggbb; null if a number is missing.

    The closed form of CSS Color 4: a channel n of 0, 8 and 4 is
    l - s min(l, 1 - l) max(-1, min(k - 3, 9 - k, 1)) with k = (n + h / 30) mod 12.
    """
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"[\d.]+"), F.lit(0)), lambda x: x.try_cast("double"))
    hue, saturation, light = F.get(numbers, 0), F.get(numbers, 1) / 100, F.get(numbers, 2) / 100
    reach = saturation * F.least(light, 1 - light)
    places = [F.pmod(F.lit(float(n)) + hue / 30, F.lit(12.0)) for n in (0, 8, 4)]
    levels = [light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0))) for k in places]
    # half steps go up
    return F.when(hue.isNotNull(), F.concat(F.lit("#"), *[_two(F.floor(F.round(x * 255, 9) + 0.5)) for x in levels]))


def to_hex(c: Column) -> Column:
    """#abc, #aabbcc, rgb(r, g, b) and hsl(h, s%, l%) to #rrggbb; channels end at 255; others null."""
    s = F.lower(F.trim(c))
    short = F.regexp_replace(s, r"^#(.)(.)(.)$", r"#$1$1$2$2$3$3")
    rgb = r"^rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    channels = [_two(F.least(F.regexp_extract(s, rgb, k).try_cast("long"), F.lit(255))) for k in (1, 2, 3)]
    return (
        F.when(s.rlike("^#[0-9a-f]{6}$"), s).when(s.rlike("^#[0-9a-f]{3}$"), short).when(s.rlike(rgb), F.concat(F.lit("#"), *channels)).when(s.startswith("hsl"), _hsl(s))
    )


#: Declarations of colours in style sheets; the property and the value.
DECLARED = r"(?is)(background(?:-color)?|(?<![\w-])color|border(?:-color)?|fill|stroke|outline(?:-color)?)\s*:\s*(#(?:[0-9a-f]{6}|[0-9a-f]{3})\b|rgba?\s*\([^)]+\)|hsla?\s*\([^)]+\))"
#: Weights of a theme colour, of backgrounds and fills, and of other declarations: fixed values.
THEME, BACK, OTHER = 30, 3, 1


def brand_colors(page: Column, most: int = 6) -> Column:
    """The useful colours of a page with the largest weights, as an array of ``color, weight``.

    The theme colour and the style sheets inside the page count; equal weights keep
    the order in which the colours come first.
    """
    metas = F.regexp_extract_all(page, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    named = lambda name: F.get(F.filter(metas, lambda m: m.rlike(rf"""(?i)\bname\s*=\s*["']?{name}\b""")), 0)
    tag = F.coalesce(named("theme-color"), named("msapplication-TileColor"), F.lit(""))
    theme = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*["']([^"']*)["']""", 1)
    css = F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    names, values = (F.regexp_extract_all(css, F.lit(DECLARED), F.lit(k)) for k in (1, 2))
    weight = lambda n: F.when(F.lower(n).startswith("background") | (F.lower(n) == "fill"), BACK).otherwise(OTHER)
    rows = F.concat(
        F.array(F.struct(to_hex(theme).alias("color"), F.lit(THEME).alias("weight"))),
        F.zip_with(names, values, lambda n, v: F.struct(to_hex(v).alias("color"), weight(n).alias("weight"))),
    )
    rows = F.filter(rows, lambda r: F.coalesce(useful(r["color"]), F.lit(False)))
    colors = F.array_distinct(F.transform(rows, lambda r: r["color"]))
    total = lambda c: F.aggregate(F.filter(rows, lambda r: r["color"] == c), F.lit(0), lambda s, r: s + r["weight"])
    ranked = F.array_sort(F.transform(colors, lambda c, i: F.struct((-total(c)).alias("less"), i.alias("place"), c.alias("color"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: F.struct(r["color"].alias("color"), (-r["less"]).alias("weight")))


def channel(c: Column, k: int) -> Column:
    return F.conv(F.substring(c, 2 + 2 * k, 2), 16, 10).cast("int")


def useful(c: Column) -> Column:
    """Neither nearly white, nearly black nor nearly gray."""
    r, g, b = (channel(c, k) for k in range(3))
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return ~(low > 210) & ~(high < 40) & (high - low >= 30)


def contrast_text(c: Column) -> Column:
    """Dark text on light colours, white on dark ones (fixed values)."""
    r, g, b = (channel(c, k) for k in range(3))
    return F.when((0.299 * r + 0.587 * g + 0.114 * b) / 255 > 0.55, "#1F2937").otherwise("#FFFFFF")
