"""Units, number formats and list counters as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWIPS_AN_INCH, EMU_AN_INCH, BORDER_UNITS_AN_INCH = 1440.0, 914400.0, 576.0

#: Page sizes in points.
PAGES = (
    ("A3", 842, 1191), ("A4", 595, 842), ("A5", 420, 595), ("A6", 298, 420), ("B5", 516, 729), ("Letter", 612, 792),
    ("Legal", 612, 1008), ("Tabloid", 792, 1224), ("Executive", 540, 720), ("Statement", 396, 612), ("Folio", 612, 936),
)

#: Codes of border styles; any other style is "s".
BORDER_CODES = {"single": "s", "double": "d", "dashed": "ds", "dashSmallGap": "ds", "dotted": "dt", "none": "n", "nil": "n"}


def inches(twips: Column) -> Column:
    return twips.cast("double") / F.lit(TWIPS_AN_INCH)


def fixed6(x: Column) -> Column:
    return F.format_string("%.6f", x.cast("double"))


def points(x: Column) -> Column:
    """%.6f without trailing zeros."""
    return F.regexp_replace(fixed6(x), r"\.?0+$", "")


def page_preset(width: Column, height: Column) -> Column:
    """Name of the page size in twips, either way round, null if it has none."""
    w, h = (F.floor(inches(x) * 72).cast("int") for x in (width, height))
    pages = [((w == a) & (h == b)) | ((w == b) & (h == a)) for _, a, b in PAGES]
    out = F.lit(None).cast("string")
    for (name, _, _), fits in reversed(list(zip(PAGES, pages, strict=True))):
        out = F.when(fits, name).otherwise(out)
    return out


def border_code(style: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BORDER_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, style), F.lit("s"))


def border_side(prefix: str, style: Column, size: Column, space: Column, color: Column) -> Column:
    """One side of a border attribute, null if the side has none."""
    text = F.concat(F.lit(f"{prefix} "), fixed6(size / F.lit(BORDER_UNITS_AN_INCH)), F.lit(" "), border_code(style), space.cast("string"), F.lit(" #"), color)
    return F.when((style != "") & (style != "none"), text)


def border_attribute(*sides: Column) -> Column:
    return F.concat_ws("; ", *sides)


def letters(n: Column) -> Column:
    """a … z, aa … : bijective base 26; n is at least 1."""
    step = lambda acc, _: F.when(
        acc["n"] > 0, F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(F.chr(((acc["n"] - 1) % 26) + 97), acc["s"]).alias("s"))
    ).otherwise(acc)
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["s"])


def roman(n: Column) -> Column:
    """Lower-case Roman numeral; n is at least 1."""
    digits = lambda one, five, ten: F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)])
    place = lambda unit, names: F.element_at(names, (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, digits("c", "d", "m")), place(10, digits("x", "l", "c")), place(1, digits("i", "v", "x")))


def counter_text(counter: Column, fmt: Column) -> Column:
    """A list counter, at least 1, in a number format."""
    n = F.greatest(counter.cast("long"), F.lit(1))
    return (
        F.when(fmt == "lowerLetter", letters(n)).when(fmt == "upperLetter", F.upper(letters(n)))
        .when(fmt == "lowerRoman", roman(n)).when(fmt == "upperRoman", F.upper(roman(n)))
        .when(fmt == "decimalZero", F.format_string("%02d", n)).when(fmt == "bullet", "").otherwise(n.cast("string"))
    )


def template_segments(template: Column) -> Column:
    """A level template as array of struct<text, level>: literal pieces have level 0, a
    reference %n has level n and no text. A template without references is one literal."""
    levels = F.regexp_extract_all(template, F.lit(r"%(\d+)"), F.lit(1))
    literals = F.split(template, r"%\d+")
    kind = "array<struct<text:string,level:int>>"
    pairs = F.transform(
        literals,
        lambda text, k: F.array(F.struct(text.alias("text"), F.lit(0).alias("level")), F.struct(F.lit("").alias("text"), F.coalesce(F.get(levels, k).cast("int"), F.lit(0)).alias("level"))),
    )
    kept = F.filter(F.flatten(pairs), lambda s: (s["text"] != "") | (s["level"] > 0))
    return F.when(F.size(levels) == 0, F.array(F.struct(template.alias("text"), F.lit(0).alias("level"))).cast(kind)).otherwise(kept.cast(kind))
