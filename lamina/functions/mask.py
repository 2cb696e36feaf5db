"""Partial masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.model import SemanticType


def mask(value: Column, kind: SemanticType | None = None) -> Column:
    """Phone numbers keep 3 leading and 2 trailing characters, addresses of the net their first two parts, all else its first character.

    Null stays null, an empty text outside phones and addresses stays empty; a missing type takes the general mask.
    """
    v = value.cast("string")
    n = F.char_length(v)
    if kind == SemanticType.PHONE:
        return F.when(n <= 5, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(v, 1, 3), F.repeat(F.lit("*"), n - 5), F.right(v, F.lit(2))))
    if kind == SemanticType.IP_ADDRESS:
        parts = F.split(v, "[.]", -1)
        return F.when(v.isNull(), None).when(F.size(parts) >= 2, F.concat(parts[0], F.lit("."), parts[1], F.lit(".*.*"))).otherwise("*.*.*.*")
    return F.when(n == 0, v).otherwise(F.concat(F.substring(v, 1, 1), F.lit("***")))
