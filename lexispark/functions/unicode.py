"""Composition and repair of texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@F.pandas_udf("string")
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def compose_nfc(text: Column) -> Column:
    """Marks composed with their letters; Spark has no function for it. Of texts of ASCII only a null goes to Python."""
    return F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def repair_utf8(raw: Column) -> Column:
    """Bytes as text, with the replacement character for what is no valid UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))
