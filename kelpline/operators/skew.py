"""Joins whose keys may be hot: one key on a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: parts into which the rows of one key are spread
SALTS = 16


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, by: str, salts: int = SALTS) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, where a key may be on very many rows of ``left``.

    The rows of ``left`` are spread over ``salts`` parts by the hash of column ``by``; every row of
    ``right``, which holds each key about once, meets every part.  ``how`` is ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.  Null keys match nothing, as in any join.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the left side only: {how!r}")
    a = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")
