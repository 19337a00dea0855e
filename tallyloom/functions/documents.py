"""Values that stand in documents' titles, names and notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import float_text, iso_date, norm_text

# Month names (genitive, without accents) in order.
MONTHS = ("stycznia", "lutego", "marca", "kwietnia", "maja", "czerwca", "lipca", "sierpnia", "wrzesnia", "pazdziernika", "listopada", "grudnia")


def as_at(c: Column) -> Column:
    """The date in "stan na [dzień] d.m.Y", the first in the text."""
    return iso_date(F.nullif(F.regexp_extract(c, r"(?iu)stan na(?:\s+dzie[nń])?\s*:?\s*(\d{1,2}\.\d{1,2}\.\d{4})", 1), F.lit("")))


def written_date(c: Column) -> Column:
    """The date in "5 marca 2026"."""
    text = norm_text(c)
    day, month, year = (F.nullif(F.regexp_extract(text, rf"(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})", g), F.lit("")) for g in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), month)
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, number.cast("string"), day), F.lit("yyyy-M-d")))


def date_in_name(c: Column) -> Column:
    """The date in a file name: 2026-05-31, 2026_05_31 or 20260531."""
    rx = r"((?:19|20)\d{2})[-_]?(0[1-9]|1[0-2])[-_]?(0[1-9]|[12]\d|3[01])(?!\d)"
    parts = [F.regexp_extract(c, rx, g) for g in (1, 2, 3)]
    return F.when(c.rlike(rx), F.to_date(F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd"))))


def stated_kva(c: Column) -> Column:
    """X of a note that says "= X kVA"."""
    return float_text(F.replace(F.nullif(F.regexp_extract(c, r"(?i)=\s*([\d,]+(?:\.\d+)?)\s*kva", 1), F.lit("")), F.lit(","), F.lit("")))


def voltage_tag(c: Column) -> Column:
    """The first voltage that a text names, as "110 kV"."""
    number = F.regexp_extract(c, r"(?i)(\d{2,3})\s*kv", 1)
    return F.when(number != "", F.concat(number, F.lit(" kV")))


def layout_kind(header: Column) -> Column:
    """Which listing a table's header belongs to: refusals, applications or applicants."""
    text = norm_text(header)
    return F.when(F.contains(text, F.lit("odmow")), "refusals").when(F.contains(text, F.lit("moc przylaczeniowa")) | F.contains(text, F.lit("wniosk")), "applications").when(F.contains(text, F.lit("podmiot")), "applicants")
