"""Colours, fonts and text styles of annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of font names, and the standard name and alias for (family, bold, italic).
TIMES = "(?i)(times|tiro|tiit|tibo|tibi)"
COURIER = "(?i)(courier|cour|coit|cobo|cobi)"
BOLD = "(?i)(bold|hebo|hebi|cobo|cobi|tibo|tibi)"
ITALIC = "(?i)(italic|oblique|heit|hebi|coit|cobi|tiit|tibi)"
STANDARD_FONTS = {
    "helvetica": ("helv", "Helvetica"),
    "helvetica italic": ("heit", "Helvetica-Oblique"),
    "helvetica bold": ("hebo", "Helvetica-Bold"),
    "helvetica bold italic": ("hebi", "Helvetica-BoldOblique"),
    "times": ("tiro", "Times-Roman"),
    "times italic": ("tiit", "Times-Italic"),
    "times bold": ("tibo", "Times-Bold"),
    "times bold italic": ("tibi", "Times-BoldItalic"),
    "courier": ("cour", "Courier"),
    "courier italic": ("coit", "Courier-Oblique"),
    "courier bold": ("cobo", "Courier-Bold"),
    "courier bold italic": ("cobi", "Courier-BoldOblique"),
}
BLACK, CYAN, FALLBACK_FILL = (0.0, 0.0, 0.0), (0.0, 1.0, 1.0), (0.75, 1.0, 1.0)

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)"


def colour(values: tuple[float, ...]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def is_bold(font: Column) -> Column:
    return font.rlike(BOLD)


def is_italic(font: Column) -> Column:
    return font.rlike(ITALIC)


def device_rgb(da: Column) -> Column:
    """The first ``r g b rg`` of a default appearance, or null."""
    p = rf"({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s+rg\b"
    return F.when(da.rlike(p), F.array(*[F.regexp_extract(da, p, k).cast("double") for k in (1, 2, 3)]))


def stroke_rgb(stream: Column) -> Column:
    """The last ``R G B RG`` of an appearance stream if all are from 0 to 1, else null."""
    p = rf"({_NUMBER})\s+({_NUMBER})\s+({_NUMBER})\s+RG\b"
    last = F.try_element_at(F.regexp_extract_all(stream, F.lit(f"({p})"), F.lit(1)), F.lit(-1))
    rgb = F.array(*[F.regexp_extract(last, p, k).cast("double") for k in (1, 2, 3)])
    return F.when(last.isNotNull() & F.forall(rgb, lambda v: v.between(0.0, 1.0)), rgb)


def css_rgb(value: Column) -> Column:
    """``#rgb``, ``#rrggbb`` or ``rgb(r, g, b)`` as parts of 255, or null."""
    v = F.lower(F.trim(value))
    three, six, called = r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", r"^#([0-9a-f]{2})([0-9a-f]{2})([0-9a-f]{2})$", r"^rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)$"

    def parts(p: str, twice: bool, base: int) -> Column:
        out = []
        for k in (1, 2, 3):
            x = F.regexp_extract(v, p, k)
            n = F.conv(F.concat(x, x) if twice else x, base, 10).cast("double")
            out.append(F.least(n, F.lit(255.0)) / 255.0)
        return F.array(*out)

    return F.when(v.rlike(three), parts(three, True, 16)).when(v.rlike(six), parts(six, False, 16)).when(v.rlike(called), parts(called, False, 10))


def rich_text_rgb(rc: Column) -> Column:
    """The last CSS colour declaration, not one of another property that ends in -color."""
    p = r"(?<![-\w])color\s*:\s*(#[0-9a-fA-F]{6}|#[0-9a-fA-F]{3}|rgb\([^)]*\))"
    return css_rgb(F.try_element_at(F.regexp_extract_all(rc, F.lit("(?i)" + p), F.lit(1)), F.lit(-1)))


def parsed_style(da: Column, rc: Column, stroke: Column, width: Column, dashes: Column, stream: Column, font: str, size: float, fill: tuple[float, ...] | None) -> Column:
    """The style of a raw annotation; ``font``, ``size`` and ``fill`` are the profile's defaults."""
    p = rf"/(\S+)\s+({_NUMBER})\s+Tf"
    has = F.coalesce(da, F.lit("")).rlike(p)
    none = F.lit(None).cast("array<double>")
    return F.struct(
        F.when(has, F.regexp_extract(da, p, 1)).otherwise(F.lit(font)).alias("font"),
        F.when(has, F.regexp_extract(da, p, 2).cast("double")).otherwise(F.lit(float(size))).alias("font_size"),
        F.coalesce(rich_text_rgb(rc), device_rgb(da), colour(BLACK)).alias("text_color"),
        F.coalesce(stroke_rgb(stream), colour(BLACK)).alias("border_color"),
        F.coalesce(F.when(F.size(stroke) > 0, stroke), colour(fill) if fill else none).alias("fill_color"),
        F.when(F.coalesce(width, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(width).alias("border_width"),
        dashes.alias("border_dashes"),
    )


def rotation(c: Column) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(0))


def standard_font(font: Column) -> Column:
    """struct(alias, name, bold, italic) of the nearest standard font."""
    family = F.when(font.rlike(TIMES), "times").when(font.rlike(COURIER), "courier").otherwise("helvetica")
    key = F.concat(family, F.when(is_bold(font), " bold").otherwise(""), F.when(is_italic(font), " italic").otherwise(""))
    known = F.create_map(*[x for k, v in STANDARD_FONTS.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    hit = F.try_element_at(known, key)
    return F.struct(hit[0].alias("alias"), hit[1].alias("name"), is_bold(font).alias("bold"), is_italic(font).alias("italic"))


def first_three(c: Column, otherwise: tuple[float, ...]) -> Column:
    return F.when(F.coalesce(F.size(c), F.lit(0)) >= 3, F.slice(c, 1, 3)).otherwise(colour(otherwise))


def text_style(category: Column, style: Column, use_source: bool, size: float, domain_size: float) -> Column:
    """struct(alias, name, size, color, bold, italic) with which an annotation is written."""

    def made(alias: str, name: str, points: float, rgb: tuple[float, ...], bold: bool) -> Column:
        return F.struct(
            F.lit(alias).alias("alias"), F.lit(name).alias("name"), F.lit(float(points)).alias("size"), colour(rgb).alias("color"), F.lit(bold).alias("bold"), F.lit(False).alias("italic")
        )

    if use_source:
        f = standard_font(style["font"])
        return F.struct(
            f["alias"].alias("alias"), f["name"].alias("name"), style["font_size"].alias("size"), first_three(style["text_color"], BLACK).alias("color"), f["bold"].alias("bold"), f["italic"].alias("italic")
        )
    return (
        F.when(category == "domain_label", made("hebo", "Helvetica-Bold", domain_size, BLACK, True))
        .when(category == "cross_reference", made("helv", "Helvetica", size, CYAN, False))
        .otherwise(made("helv", "Helvetica", size, BLACK, False))
    )


def hex_rgb(*rgb: Column) -> Column:
    """#rrggbb of three parts from 0 to 1, rounded half to even."""
    one = lambda c: F.lpad(F.lower(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.bround(c * 255, 0).cast("long"))))), 2, "0")
    return F.concat(F.lit("#"), *[one(c) for c in rgb])
