"""Keyed and fixed hashes that Spark lacks, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 (hex) of the text in normal form (NFC, white space runs as one space); null where that is empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        def one(t):
            plain = " ".join(unicodedata.normalize("NFC", t).split())
            return hmac.new(key, plain.encode(), hashlib.sha256).hexdigest() if plain else None

        return texts.map(one, na_action="ignore")

    return of(text)


def starting_side(query: Column) -> Column:
    """``a`` or ``b``, balanced and the same for a query every time: the low bit of its finished FNV-1a hash."""

    @F.pandas_udf("string")
    def of(queries: pd.Series) -> pd.Series:
        mask = (1 << 64) - 1

        def one(q):
            # The 64-bit FNV-1a offset and prime, and the two multipliers of the 64-bit murmur3 finisher.
            h = 0xCBF29CE484222325
            for byte in q.encode():
                h = (h ^ byte) * 0x100000001B3 & mask
            for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                h = (h ^ h >> 33) * m & mask
            return "ab"[(h ^ h >> 33) & 1]

        return queries.map(one, na_action="ignore")

    return of(query)


def generation_id(*stamps: Column) -> Column:
    """``g-`` and 16 hex digits over the stamps, joined by NUL."""
    return F.concat(F.lit("g-"), F.substring(F.sha2(F.concat_ws("\0", *stamps), 256), 1, 16))
