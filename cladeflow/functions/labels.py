"""Column functions on names, annotations and colors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_gene(label: Column) -> Column:
    """Genes of a label joined by a pipe: parts that do not start with a letter, digit, underscore or space are emptied, a last "<" goes."""
    part = lambda x: F.when(x.rlike(r"^[a-zA-Z_0-9\s]"), F.regexp_replace(x, "<$", "")).otherwise("")
    joined = F.array_join(F.transform(F.split(label, "/>"), part), "|")
    return F.coalesce(F.regexp_replace(joined, "<$", ""), F.lit(""))


def clean_annotation(label: Column) -> Column:
    """"intergenic" or "del" where the label holds it, else what stands before the first bracket (or all, if that is nothing)."""
    before = F.substring_index(label, "(", 1)
    kind = F.when(F.contains(label, F.lit("intergenic")), "intergenic").when(F.contains(label, F.lit("del")), "del")
    return F.coalesce(kind.when(before == "", label).otherwise(before), F.lit(""))


def number_in(text: Column) -> Column:
    """The number that a text is, with sign and exponent; else the first digits in it ("26.1%" is 26.1); null without any, as for "inf"."""
    whole = F.when(F.trim(text).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(text)).try_cast("double")
    return F.when(F.abs(whole) < float("inf"), whole).otherwise(F.nullif(F.regexp_extract(text, r"\d+(?:\.\d+)?", 0), F.lit("")).cast("double"))


def channel(color: Column, place: int) -> Column:
    return F.conv(F.substring(color, place, 2), 16, 10).cast("double")


def luminance(color: Column) -> Column:
    """Of a color #RRGGBB, from 0 to 1."""
    return (0.299 * channel(color, 2) + 0.587 * channel(color, 4) + 0.114 * channel(color, 6)) / 255


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r.cast("int"), g.cast("int"), b.cast("int"))


def genotype_number(label: Column) -> Column:
    """The number after the last hyphen, null where there is none."""
    return F.element_at(F.split(label, "-"), -1).try_cast("double")
