"""Bit-pattern hashes as signed longs: distances, blocking keys and signatures."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distance of a missing hash from anything; it never matches.
NO_HASH = 9999
_BLANKS = re.compile(r"[ \t\n]+")
BLOCK = 32


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; NO_HASH if either side is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(NO_HASH))


def from_hex(text: Column) -> Column:
    """64-bit pattern of up to 16 hex digits as a signed long; null for anything else."""
    return F.when(text.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(text, 16, -10).cast("long"))


def dimension_block(size: Column, exact: bool = False) -> Column:
    """Blocking key of a width or height; unknown (null or 0) is -1 before flooring."""
    known = F.coalesce(F.nullif(size, F.lit(0)), F.lit(-1))
    return known.cast("long") if exact else F.floor(known / float(BLOCK)).cast("long")


def sign_bits(vector: Column, bits: int = 60) -> Column:
    """Bit i is set if element i is positive."""
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(vector[i] > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i in range(bits)))


class _TokenBytes(dict):
    """Token -> the first eight bytes of its SHA-256; emptied when it has grown too large."""

    LIMIT = 500_000

    def __missing__(self, token: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        self[token] = found = hashlib.sha256(token.encode("utf-8", "replace")).digest()[:8]
        return found


_TOKENS = _TokenBytes()  # one for each Python worker


def simhash_of(text: Column, bits: int = 60) -> Column:
    """SimHash of the distinct lower-cased whitespace tokens of a text, by the first ``bits`` bits of their SHA-256; 0 without tokens.

    Votes are counted within the row: no shuffle.
    """

    @F.pandas_udf("long")
    def fold(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            tokens = {t for t in _BLANKS.split(text) if t}
            rows = np.frombuffer(b"".join(map(_TOKENS.__getitem__, tokens)), np.uint8).reshape(len(tokens), 8)
            votes = 2 * np.unpackbits(rows, axis=1)[:, :bits].sum(axis=0, dtype=np.int64) > len(tokens)
            out.append(int.from_bytes(np.packbits(votes[::-1], bitorder="little").tobytes(), "little"))
        return pd.Series(out, dtype="int64")

    return fold(F.lower(F.coalesce(text, F.lit(""))))


def simhash(docs: DataFrame, id_col: str, text_col: str, bits: int = 60) -> DataFrame:
    """(id, simhash) of each row's text."""
    return docs.select(F.col(id_col), simhash_of(F.col(text_col), bits).alias("simhash"))
