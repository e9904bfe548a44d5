"""Byte codes of samples and probabilities, as Arrow functions."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIAS = 132
#: Where the shares of the normal distribution meet, and their middles.
EDGES = np.array([NormalDist().inv_cdf(k / 256) for k in range(1, 256)])
MIDDLES = np.array([NormalDist().inv_cdf((k + 0.5) / 256) for k in range(256)])


def mulaw_bytes(x: np.ndarray) -> np.ndarray:
    """16-bit samples to mu-law codes."""
    size = np.minimum(np.abs(x.astype(np.int64)), 32635) + BIAS
    exponent = np.floor(np.log2(size)).astype(np.int64) - 7
    return (~((x < 0) * 128 | exponent << 4 | size >> exponent + 3 & 15)).astype(np.uint8)


def mulaw_samples(code: np.ndarray) -> np.ndarray:
    code = ~code.astype(np.int64) & 255
    size = ((code & 15) * 8 + BIAS << (code >> 4 & 7)) - BIAS
    return np.where(code & 128, -size, size)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_mulaw(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: mulaw_bytes(np.asarray(x)).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def from_mulaw(codes: pd.Series) -> pd.Series:
    return codes.map(lambda x: mulaw_samples(np.asarray(x)).astype(np.int32))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def to_pre8(values: pd.Series) -> pd.Series:
    """8-bit codes through the normal distribution function: which of its 256 equal shares a value lies in."""
    return values.map(lambda x: np.searchsorted(EDGES, np.asarray(x, float), side="right").astype(np.int32))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def from_pre8(codes: pd.Series) -> pd.Series:
    return codes.map(lambda x: MIDDLES[np.asarray(x, np.int64)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def error_function(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else [math.erf(v) for v in x])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def inverse_error_function(values: pd.Series) -> pd.Series:
    """Values of -1 and 1 give infinities, others outside give null."""
    def one(y: float) -> float | None:
        return math.copysign(math.inf, y) if abs(y) == 1 else NormalDist().inv_cdf((y + 1) / 2) / math.sqrt(2) if abs(y) < 1 else None

    return values.map(lambda x: None if x is None else [one(v) for v in x])
