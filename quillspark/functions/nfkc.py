"""Unicode compatibility folding, for which Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(c: Column) -> Column:
    """Curly quotes, dashes and no-break spaces to ASCII, then NFKC."""
    x = F.translate(c, "“”‘’–— ", "\"\"''-- ")
    plain = F.length(x) == F.octet_length(x)  # ASCII has nothing to fold and needs no Python
    return F.when(plain, x).otherwise(F.pandas_udf(_fold, "string")(F.when(~plain, x)))
