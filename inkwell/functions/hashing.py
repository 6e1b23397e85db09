"""HMAC as a Column expression, and Unicode normalisation, which has no built-in."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.ship import ship


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA-256 (hex) under a fixed key: the padded keys are literals, the rest is built-in."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.unhex(F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in key)), message.cast("binary")), 256))
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in key)), inner), 256)


def nfkc(spark: SparkSession):
    """An Arrow-batched function that normalises text to NFKC."""
    ship(spark)

    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))

    return normal
