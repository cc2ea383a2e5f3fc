"""Scalar rules of the telemetry pipeline as Column expressions; text that does not parse is null, never an error."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DECIMAL = "decimal(38,10)"
# What raw files call the sides, and what counts as true.
CT_NAMES = ("CT", "COUNTERTERRORIST", "COUNTER_TERRORIST", "COUNTER-TERRORIST")
T_NAMES = ("T", "TERRORIST")
TRUE_NAMES = ("1", "true", "yes", "on")
# Unicode's white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
GRID = 500


def clean_cell(c: Column) -> Column:
    """Without white space at its ends; null if nothing is left."""
    return F.nullif(F.btrim(c.cast("string"), F.lit(WHITE_SPACE)), F.lit(""))


def side_name(c: Column) -> Column:
    return F.upper(clean_cell(c))


def side_of(name: Column) -> Column:
    return F.when(name.isin(*CT_NAMES), "CT").when(name.isin(*T_NAMES), "T")


def winner_side(c: Column) -> Column:
    return side_of(side_name(c))


def decimal_of(c: Column) -> Column:
    return clean_cell(c).try_cast(DECIMAL)


def positive_of(d: Column) -> Column:
    """The whole part of a decimal above zero."""
    n = d.try_cast("int")
    return F.when(n > 0, n)


def positive_int(c: Column) -> Column:
    return positive_of(decimal_of(c))


def canonical(d: Column) -> Column:
    """A decimal without exponent, trailing zeros or a bare point."""
    return F.regexp_replace(F.replace(F.format_number(d, 10), F.lit(","), F.lit("")), r"\.?0+$", "")


def amount_of(d: Column) -> Column:
    """A decimal of at least zero."""
    return F.when(d >= 0, d)


def amount(c: Column) -> Column:
    return amount_of(decimal_of(c))


def finite(c: Column) -> Column:
    d = clean_cell(c).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def number(c: Column) -> Column:
    return clean_cell(c).try_cast("double")


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(clean_cell(c)).isin(*TRUE_NAMES), F.lit(False))


def half_of(n: Column) -> Column:
    return F.when((n - 1) % 30 < 15, "H1").otherwise("H2")


def overtime(n: Column) -> Column:
    return (n > 30).cast("int")


def grid(c: Column) -> Column:
    return (F.floor(c / GRID) * GRID).cast("int")


def file_kind(name: Column) -> Column:
    """The kind of a raw file, by its name."""
    low = F.lower(name)
    return F.when(~low.endswith(".csv"), "assets").when(low.contains("meta"), "round_meta").when(low.contains("kill"), "kills").when(low.contains("dmg") | low.contains("damage"), "damage").when(low.contains("grenade") | low.contains("nade"), "grenades").otherwise("other")


def is_round_meta_path(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("/round_meta/") | F.substring_index(low, "/", -1).contains("meta")


@F.pandas_udf(StringType())
def one_decimal(x: pd.Series) -> pd.Series:
    """As Python prints round(x, 1): the exact binary value decides, which no built-in rounding does."""
    return x.map(lambda v: None if pd.isna(v) else str(round(v, 1)))


def percent(part: Column, whole: Column) -> Column:
    return one_decimal(F.when(whole != 0, part / whole * 100).otherwise(F.lit(0.0)).cast("double"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def doc_id(run: str, n: Column) -> Column:
    return F.concat(F.lit(f"{run}:"), n.cast("string"))


def doc_line(c: Column) -> Column:
    """The number after the last colon of a document id."""
    tail = F.substring_index(c, ":", -1)
    return F.when(c.contains(":") & tail.rlike("^[0-9]+$"), tail.try_cast("long"))


def run_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def join_path(*parts: str) -> str:
    return "/".join(p.strip("/") for p in parts if p.strip("/"))


#: Probabilities are kept so far from 0 and 1.
PROBABILITY_MARGIN = 1e-6


def clip_probability(p: Column, margin: float = PROBABILITY_MARGIN) -> Column:
    return F.greatest(F.least(p, F.lit(1 - margin)), F.lit(margin))


def round_value(c: Column) -> Column:
    """Digits as a whole number, else null."""
    return F.when(c.rlike("^-*[0-9]+$"), c.try_cast("long"))


def session_title(c: Column, default: str = "Nova conversa", most: int = 40) -> Column:
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t == "", default).when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def without_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))


# Latin letters with accents, and what they lose: made from Unicode's own decompositions.
_ACCENTED = [(chr(c), without_accents(chr(c))) for c in range(0xC0, 0x250) if len(without_accents(chr(c))) == 1 and without_accents(chr(c)) != chr(c)]


def normal_text(c: Column) -> Column:
    """Lower case, Latin letters without accents, anything but letters and digits a single space."""
    plain = F.translate(F.lower(c), "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_text(c), " "), lambda x: x != ""))
