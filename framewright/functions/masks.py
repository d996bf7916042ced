"""Bit-packed masks: 'BMK1', height and width (big-endian 32 bits), then bits, most significant first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

MAGIC = b"BMK1"


def encode(mask: np.ndarray) -> bytes:
    h, w = mask.shape
    return MAGIC + h.to_bytes(4, "big") + w.to_bytes(4, "big") + np.packbits(mask.astype(bool).ravel()).tobytes()


def decode(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a packed mask")
    h, w = (int.from_bytes(data[i : i + 4], "big") for i in (4, 8))
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=12), count=h * w).reshape(h, w).astype(bool)


def number(data: Column, start: int, size: int) -> Column:
    """Big-endian number in a binary column, from byte `start` (1 is the first)."""
    return F.conv(F.hex(F.substring(data, start, size)), 16, 10).cast("long")


def header(data: Column) -> tuple[Column, Column, Column]:
    """Whether the magic fits, height, width; all in the JVM."""
    return F.substring(data, 1, 4) == F.lit(MAGIC), number(data, 5, 4), number(data, 9, 4)


@F.pandas_udf(LongType())
def area(data: pd.Series) -> pd.Series:
    """Number of set bits."""
    return data.map(lambda b: None if b is None else int(np.bitwise_count(np.frombuffer(b, np.uint8, offset=12)).sum()))


@F.pandas_udf(BinaryType())
def united(data: pd.Series) -> bytes:
    """Bitwise OR of a group's masks of equal size (null and empty groups: null)."""
    out = None
    for b in data.dropna():
        bits = np.frombuffer(b, np.uint8)
        out = bits.copy() if out is None else out | bits
    return None if out is None else out.tobytes()
