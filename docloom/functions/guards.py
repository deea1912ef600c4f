"""Checks that are part of a column's value, so no optimiser rule drops them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is not white space; non-breaking spaces count as text.
_SOLID = r"[^\s\x1c-\x1f\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"


def checked_id(id_: Column, what: str) -> Column:
    """``id_`` as text; a null or blank id fails the job."""
    text = id_.cast("string")
    return F.when(text.rlike(_SOLID), text).otherwise(F.raise_error(F.lit(f"{what}: id is null or blank")).cast("string"))


def checked_key(key: Column, id_: Column, what: str) -> Column:
    """``key`` as text; a null key fails the job and names the change's id."""
    text = key.cast("string")
    return F.when(text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit(f"{what}: no key for "), id_)).cast("string"))


def checked_value(value: Column, what: str) -> Column:
    """``value``; null fails the job."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{what}: value is null")))
