"""Column functions: identifiers, units, rounding, errors.  All stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Molar masses (g/mol) by which molarities become percent mass per volume.  Fixed values.
MOLAR_MASS = {
    "acetic": 60,
    "phosphor": 98,
    "nh4ac": 77,
    "nh4form": 63,
    "nh4carb": 96,
    "nh4bicarb": 79,
    "nh4f": 37,
    "nh4oh": 35,
    "trieth": 101,
    "triprop": 143,
    "tribut": 185,
    "nndimethylhex": 129,
    "medronic": 176,
}


def round_even(x: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the rounding of numerical arrays (0.125 at 2 digits is 0.12)."""
    return F.rint(x * F.lit(float(10**digits))) / F.lit(float(10**digits))


def pad_key(x: Column, width: int = 4) -> Column:
    """Zero-pad a whole number; longer ones stay whole."""
    s = x.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def id_prefix(x: Column, separator: str = "_") -> Column:
    """The part of an identifier before its first separator."""
    return F.split_part(x, F.lit(separator), F.lit(1))


def minutes_to_seconds(x: Column, digits: int = 2) -> Column:
    return round_even(x * 60, digits)


def to_percent(value: Column, unit: Column, molar_mass: float) -> Column:
    """Percent mass per volume of a value in mM or µM; other units stay as they are."""
    return F.when(unit == "mM", value * F.lit(molar_mass / 1e4)).when(unit == "µM", value * F.lit(molar_mass / 1e7)).otherwise(value)


def dead_time(t0: Column, diameter: Column, length: Column, flow: Column) -> Column:
    """``t0``, or where that is zero an estimate from the column's geometry; null stays null."""
    volume = F.lit(0.66 * math.pi) * F.pow(diameter / 2, F.lit(2)) * length / 10
    return F.when(t0 == 0, F.round(F.try_divide(F.try_divide(volume, flow), F.lit(100.0)), 5)).otherwise(t0)


def numeric(x: Column) -> Column:
    """A number, or null where the text is none."""
    return x.try_cast("double")


def numeric_or_fail(x: Column, name: str) -> Column:
    """A number; null stays, and a text that is none fails the query with the column's name and the text."""
    number = x.try_cast("double")
    message = F.concat(F.lit(f"{name} has a value that is no number: "), x.cast("string"))
    return F.when(x.isNotNull() & number.isNull(), F.raise_error(message).cast("double")).otherwise(number)


def in_minutes(x: Column, units: str) -> Column:
    """Times given in ``units``, minutes or seconds, in minutes."""
    if units not in ("minutes", "seconds"):
        raise ValueError("units must be minutes or seconds")
    return x / 60.0 if units == "seconds" else x


def errors(y: Column, predicted: Column, greatest: Column, mean: Column) -> dict[str, Column]:
    """Absolute error, and in percent of a group's greatest, of its mean and of the value; null over zero."""
    diff = F.abs(predicted - y)
    pct = lambda of: F.try_divide(diff * 100, of)
    return {"diff": diff, "rel_error_max": pct(greatest), "rel_error_mean": pct(mean), "mre": pct(y)}


def duration_seconds(x: Column) -> Column:
    """Seconds of a text such as ``0 days 02:35:07.5``; null where it is none."""
    p = r"^\s*(\d+) days? (\d{1,2}):(\d{2}):(\d{2}(?:\.\d+)?)\s*$"
    part = lambda k: F.regexp_extract(x, p, k).try_cast("double")
    return part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
