"""List labels, word-processing values, colours, names and locales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits by place.
ROMAN = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
# Serif families that their names do not give away.
SERIF_NAMES = ("cambria", "georgia", "garamond", "book antiqua", "palatino", "palatino linotype", "constantia", "baskerville")
# Alignment and border words of the file format.
ALIGN = {"center": "center", "right": "right", "end": "right", "both": "justify", "distribute": "justify", "justify": "justify"}
BORDER = {
    "single": "single", "thick": "single", "thinThickSmallGap": "single", "thickThinSmallGap": "single", "double": "double", "triple": "double",
    "dashed": "dashed", "dashSmallGap": "dashed", "dashDot": "dashed", "dashDotDot": "dashed", "dotted": "dotted", "dotDash": "dotted", "dotDotDash": "dotted",
}
# Locales that have texts.
LOCALES = ("en", "zh-CN", "zh-TW", "ja", "ko", "es", "fr", "de", "pt-BR", "ar", "ru")
MIME_TYPES = {
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "image": "application/octet-stream",
}
DEFAULT_NAMES = {"docx": "document.docx", "pptx": "document.pptx", "xlsx": "document.xlsx", "image": "image.png"}
EDITABLE = {
    "ink": "strokeColor,strokeWidth,opacity,lineStyle", "line": "strokeColor,strokeWidth,opacity,lineStyle,arrowHead", "square": "strokeColor,fillColor,strokeWidth,opacity,lineStyle",
    "circle": "strokeColor,fillColor,strokeWidth,opacity,lineStyle", "polygon": "strokeColor,fillColor,strokeWidth,opacity,lineStyle", "polyLine": "strokeColor,strokeWidth,opacity,lineStyle",
    "highlight": "strokeColor,opacity", "underline": "strokeColor", "strikeOut": "strokeColor", "squiggly": "strokeColor",
}


def lookup(values: dict, key: Column, default=None) -> Column:
    found = F.try_element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def roman(n: Column, upper: bool = False) -> Column:
    """Roman digits; 0 gives "0"; thousands repeat m."""
    place = lambda digits, unit: F.element_at(F.array(*map(F.lit, digits)), (F.floor(n / unit) % 10 + 1).cast("int"))
    text = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), *(place(d, u) for d, u in zip(ROMAN[1:], (100, 10, 1))))
    return F.when(n == 0, "0").otherwise(F.upper(text) if upper else text)


def letter(n: Column, upper: bool = False) -> Column:
    """a, b, .. z and again a; the count is taken as one byte first."""
    code = F.pmod(F.pmod(n, F.lit(256)) - 1, F.lit(256)) % 26
    return F.chr(code + (65 if upper else 97))


def list_label(count: Column, ilvl: Column, fmt: Column, level_text: Column) -> Column:
    """The label of a list item and a space: a bullet, or the level's text with its own number put in."""
    number = (
        F.when(fmt == "lowerLetter", letter(count)).when(fmt == "upperLetter", letter(count, True)).when(fmt == "lowerRoman", roman(count)).when(fmt == "upperRoman", roman(count, True)).otherwise(count.cast("string"))
    )
    bullet = F.when(F.trim(level_text) == "", "•").otherwise(F.trim(level_text))
    return F.concat(F.when(fmt.isin("bullet", "none"), bullet).otherwise(F.replace(level_text, F.concat(F.lit("%"), (ilvl + 1).cast("string")), number)), F.lit(" "))


def toggle_on(value: Column) -> Column:
    """Whether a switch is on: it is without a value, and unless that is 0, false or off."""
    return F.when(value.isNull(), True).otherwise(~value.isin("0", "false", "off"))


def parse_color(value: Column) -> Column:
    """array<int> of red, green, blue from six hexadecimal digits; null for auto and anything else."""
    part = lambda at: F.conv(F.substring(value, at, 2), 16, 10).cast("int")
    return F.when(F.regexp_like(value, F.lit("^[0-9A-Fa-f]{6}$")), F.array(part(1), part(3), part(5)))


def parse_align(value: Column) -> Column:
    return lookup(ALIGN, value, "left")


def parse_border(value: Column) -> Column:
    return lookup(BORDER, value, "none")


def heading_level(name: Column) -> Column:
    """0 for "heading 1" and so on, in any case; null for other style names."""
    number = F.regexp_extract(F.lower(F.trim(name)), r"^heading \s*\+?([0-9]+)$", 1)
    level = F.nullif(number, F.lit("")).try_cast("int")
    return F.when(level <= 255, F.greatest(level - 1, F.lit(0)))


def line_factor(line: Column, rule: Column) -> Column:
    """Line spacing as a factor: of 240 for auto, of 12 points for fixed heights."""
    return F.when(F.coalesce(rule, F.lit("")).isin("", "auto"), line / 240).when(rule.isin("exact", "atLeast"), line / 20 / 12)


def is_serif(name: Column) -> Column:
    low = F.lower(name)
    return (F.contains(low, F.lit("serif")) & ~F.contains(low, F.lit("sans"))) | F.contains(low, F.lit("times")) | F.contains(low, F.lit("roman")) | low.isin(*SERIF_NAMES)


def substitute_family(name: Column, loaded: Column) -> Column:
    """The family that a name is drawn with: itself where loaded, else one of the same metrics."""
    return F.when(loaded, name).when(is_serif(name), "Liberation Serif").when(F.lower(name) == "calibri", "Carlito").otherwise("Liberation Sans")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(c * 255 + 0.5).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def rgba(r: Column, g: Column, b: Column, opacity: Column | None = None) -> Column:
    whole = [F.floor(c * 255 + 0.5).cast("string") for c in (r, g, b)]
    listed = F.concat_ws(", ", *whole, *([opacity.cast("string")] if opacity is not None else []))
    return F.concat(F.lit("rgba(" if opacity is not None else "rgb("), listed, F.lit(")"))


def resolve_locale(locale: Column) -> Column:
    base = F.split_part(locale, F.lit("-"), F.lit(1))
    return F.when(locale.isin(*LOCALES), locale).when(base == "zh", "zh-CN").when(base == "pt", "pt-BR").when(base.isin(*LOCALES), base).otherwise("en")


def interpolate(template: Column, params: dict[str, Column]) -> Column:
    """{name} replaced by its parameter; names that are not known stay."""
    out = template
    for name, value in params.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def render_key(doc: Column, page: Column, kind: Column, scale: Column) -> Column:
    return F.concat_ws(":", doc, page, kind, F.format_string("%.4f", scale))


def default_filename(source: Column, fmt: Column) -> Column:
    """The last part of a source's path, decoded for URLs; else a name by format."""
    url = F.regexp_like(source, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://"))
    path = F.coalesce(F.parse_url(F.when(url, source), F.lit("PATH")), F.lit(""))
    last = F.substring_index(path, "/", -1)
    named = F.when(url, F.nullif(F.try_url_decode(last), F.lit(""))).otherwise(F.when(F.coalesce(source, F.lit("")) != "", F.substring_index(source, "/", -1)))
    return F.coalesce(named, lookup(DEFAULT_NAMES, fmt, "document.pdf"))


def mime_type(fmt: Column) -> Column:
    return lookup(MIME_TYPES, fmt, "application/pdf")


def is_zip(content: Column) -> Column:
    return (F.octet_length(content) >= 4) & (F.hex(F.substring(content, 1, 2)) == "504B")


def image_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    return F.when(F.startswith(head, F.lit("89504E47")), "png").when(F.startswith(head, F.lit("FFD8")), "jpeg").when(F.startswith(head, F.lit("474946")), "gif").when(F.startswith(head, F.lit("424D")) | F.startswith(head, F.lit("4241")), "bmp").otherwise("unknown")


def dpi_scale(quality: Column) -> Column:
    """Scale of print qualities over 72 dots an inch."""
    return lookup({"draft": 150, "standard": 300, "high": 600}, quality, 300) / 72
