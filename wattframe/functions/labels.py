"""Names and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def flat_name(*levels: Column | str) -> Column:
    """Join the levels of a column name with a blank (P-01)."""
    return F.concat_ws(" ", *levels)


def display_label(name: Column | str) -> Column:
    """``hard_coal`` -> ``Hard coal``: first letter upper, the rest lower (P-12)."""
    text = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


def clean_double(value: Column | str) -> Column:
    """Cast to ``DOUBLE`` with NaN turned into null (P-02)."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(number), number)
