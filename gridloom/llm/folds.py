"""The fixed split of documents into a part to learn from and a held-out part, and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm.rows import named

_STEPS = 1_000_000


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text leaves 1 modulo 3; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(named(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def per_label(df: DataFrame, label: str, doc_id: str, most: int) -> DataFrame:
    """About ``most`` rows of each label, chosen by a hash of the id; all rows of a rarer label."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(_STEPS, _STEPS * most // n))).otherwise(share)
    return df.filter(F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(_STEPS)) < share)
