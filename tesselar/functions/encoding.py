"""Text decoded with the wrong encoding, where a round trip undoes it."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "[ÃâÂÐÑÅ]"


def repaired(text: str) -> str:
    """Words read as Windows-1252 or Latin-1 put back to UTF-8, and composed characters."""
    out = []
    for word in text.split(" "):
        for codec in ("cp1252", "latin-1"):
            try:
                fixed = word.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
            if fixed != word:
                word = fixed
                break
        out.append(word)
    return unicodedata.normalize("NFC", " ".join(out))


def fix_encoding(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the text repaired and ``encoding_fixes``, the number of characters that changed.

    Only rows with a sign of damage leave the JVM.
    """

    @F.pandas_udf("string")
    def fixed(column):
        return column.map(lambda t: repaired(t) if t else t)

    damaged = F.coalesce(F.col(text).rlike(SIGN), F.lit(False))
    hit = rows.where(damaged).withColumn("_fixed", fixed(text))
    rest = rows.where(~damaged).withColumn("_fixed", F.col(text))
    pairs: Column = F.zip_with(F.split(text, ""), F.split("_fixed", ""), lambda a, b: ~a.eqNullSafe(b))
    both = hit.unionByName(rest).withColumn("encoding_fixes", F.when(F.col(text) == F.col("_fixed"), 0).otherwise(F.size(F.filter(pairs, lambda x: x))))
    return both.withColumn(text, F.col("_fixed")).drop("_fixed")
