"""Scalar values as native expressions: dates, escapes, text strings, numerals, matrices, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roman numerals from the largest.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def let(value: Column, f) -> Column:
    """f(value) with the value worked out once, however often f uses it: expressions built on each other stay small."""
    return F.element_at(F.transform(F.array(value), f), 1)


# Dates, as strings of the file format: D:YYYYMMDDHHmmSS and an offset, of which all behind the year may be missing.


def pdf_date(time: Column) -> Column:
    """A timestamp as a date string in UTC; null for null."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "'D:'yyyyMMddHHmmss'Z'")


def parse_pdf_date(text: Column) -> Column:
    """A date string as a timestamp; null where it is none."""
    part = lambda n: F.regexp_extract(text, r"^\s*(?:D:)?(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(?:([Zz+-])(\d\d)?'?(\d\d)?'?)?\s*$", n)
    number = lambda n, default: F.when(part(n) == "", F.lit(default)).otherwise(part(n).cast("int"))
    local = F.try_to_timestamp(F.format_string("%04d-%02d-%02d %02d:%02d:%02d UTC", number(1, 0), number(2, 1), number(3, 1), number(4, 0), number(5, 0), number(6, 0)), F.lit("yyyy-MM-dd HH:mm:ss z"))
    minutes = (number(8, 0) * 60 + number(9, 0)) * F.when(part(7) == "-", -1).when(part(7) == "+", 1).otherwise(0)
    return F.when(part(1) != "", F.timestamp_seconds(F.unix_timestamp(local) - minutes * 60))


# Escapes.


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_xml(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_html(text: Column) -> Column:
    return _replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")])


def escape_markdown(text: Column) -> Column:
    """Signs that mean something anywhere, and those that do at the start of a line or behind its number."""
    text = F.regexp_replace(text, r"([\\`*_\[\]<>|])", r"\\$1")
    text = F.regexp_replace(text, r"(?m)^([^\S\n]*)([#+-])", r"$1\\$2")
    return F.regexp_replace(text, r"(?m)^([^\S\n]*[0-9]+)([.)])", r"$1\\$2")


def escape_literal(text: Column) -> Column:
    """Within the parentheses of a literal string."""
    return _replaced(text, [("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\r", "\\r")])


def text_string(text: Column) -> Column:
    """The bytes of a text string: Latin-1 where that holds it, else UTF-16 with a mark."""
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    return F.when(text.rlike(r"^[\x{0}-\x{ff}]*$") & ~text.rlike(r"^(\x{fe}\x{ff}|\x{ef}\x{bb}\x{bf})"), F.encode(text, "ISO-8859-1")).otherwise(wide)


# Numerals of page labels.


def roman(n: Column) -> Column:
    """Capital roman numerals of positive numbers; M repeats beyond 3999."""
    out, rest = F.lit(""), n.cast("int")
    for value, sign in ROMAN:
        out, rest = F.concat(out, F.repeat(F.lit(sign), F.floor(rest / value).cast("int"))), rest % value
    return out


def letters(n: Column) -> Column:
    """A to Z, then AA to ZZ, and so on."""
    return F.repeat(F.char(F.lit(65) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))


def numeral(style: Column, n: Column) -> Column:
    """A page number in a label's style (D, R, r, A, a); empty without a style, decimal beyond 100,000."""
    small = F.least(n, F.lit(100_000))
    return (
        F.when(style.isNull(), F.lit("")).when((style == "D") | (n > 100_000), n.cast("string"))
        .when(style == "R", roman(small)).when(style == "r", F.lower(roman(small))).when(style == "A", letters(small)).when(style == "a", F.lower(letters(small))).otherwise(F.lit(""))
    )


# Matrices: arrays of six numbers. Boxes: arrays of four, x0, y0, x1, y1.


def transform(m: Column, x: Column, y: Column) -> Column:
    return F.array(m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5])


def concat_matrix(m: Column, n: Column) -> Column:
    """The matrix that applies m first and then n."""
    return F.array(m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def determinant(m: Column) -> Column:
    return m[0] * m[3] - m[1] * m[2]


def inverse(m: Column) -> Column:
    """Null where the determinant is below 1e-12."""
    parts = F.array(m[3], -m[1], -m[2], m[0], m[2] * m[5] - m[3] * m[4], m[1] * m[4] - m[0] * m[5])
    return let(determinant(m), lambda d: F.when(F.abs(d) >= 1e-12, F.transform(parts, lambda x: x / d)))


def normalised(box: Column) -> Column:
    return F.array(F.least(box[0], box[2]), F.least(box[1], box[3]), F.greatest(box[0], box[2]), F.greatest(box[1], box[3]))


def width(box: Column) -> Column:
    return F.abs(box[2] - box[0])


def height(box: Column) -> Column:
    return F.abs(box[3] - box[1])


def intersection(a: Column, b: Column) -> Column:
    """The common part of two normalised boxes; null if it has no area."""
    found = F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    return let(found, lambda x: F.when((x[2] > x[0]) & (x[3] > x[1]), x))


def intersects(a: Column, b: Column) -> Column:
    """Whether the insides of two normalised boxes meet."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def effective_box(media: Column, crop: Column) -> Column:
    """The crop box cut with the media box; the media box where they don't meet or there is no crop box."""
    return let(normalised(media), lambda m: F.coalesce(let(normalised(crop), lambda c: intersection(m, c)), m))


def page_size(box: Column, rotate: Column, scale: float = 1.0) -> Column:
    """(columns, rows) of the page's raster, sides swapped for a quarter turn; null for boxes without a finite positive size."""

    def size(w: Column, h: Column) -> Column:
        sound = (w > 0) & (h > 0) & (w < 1e9) & (h < 1e9)
        turned = F.pmod(rotate, F.lit(180)) == 90
        return F.when(sound, F.struct(F.ceil(F.when(turned, h).otherwise(w)).cast("int").alias("columns"), F.ceil(F.when(turned, w).otherwise(h)).cast("int").alias("rows")))

    return let(F.array(width(box) * scale, height(box) * scale), lambda s: size(s[0], s[1]))


def page_matrix(box: Column, rotate: Column) -> Column:
    """The matrix from page space to a page whose lower left corner is the origin once it is turned clockwise."""
    x0, y0, x1, y1 = (box[k] for k in range(4))
    turned = F.pmod(rotate, F.lit(360))
    one, none = F.lit(1.0), F.lit(0.0)
    return (
        F.when(turned == 90, F.array(none, -one, one, none, -y0, x1)).when(turned == 180, F.array(-one, none, none, -one, x1, y1))
        .when(turned == 270, F.array(none, one, -one, none, y1, -x0)).otherwise(F.array(one, none, none, one, -x0, -y0))
    )
