"""Unicode compatibility forms, which Spark has no function for: Arrow UDFs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass unchanged, null stays null."""
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def folded(text: Column) -> Column:
    """Compatibility form, lower case, white space made single: the form in which texts are held against each other."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), r"\s+", " "))


def grounded(part: Column, whole: Column) -> Column:
    """Whether ``whole`` contains ``part`` in folded form."""
    return F.contains(folded(whole), folded(part))
