"""Uniform draws that depend on (sample, stream) alone: the same on any partitioning, and in any SQL engine.

All products stay below 2**62. x -> x**5 permutes the residues of the prime M, and breaks the linearity of the first step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

M = 2147483647


def _fifth(x: Column) -> Column:
    square = x * x % M
    return square * square % M * x % M


def uniform(sample: Column, stream: Column | int) -> Column:
    """A double in [0, 1) for each sample and stream."""
    k = F.lit(stream).cast("long") if isinstance(stream, int) else stream.cast("long")
    h = _fifth((sample.cast("long") * 48271 + k * 1299709 + 12345) % M)
    return (_fifth((h + k * 7919 + 1) % M) / F.lit(float(M))).cast("double")


def uniform_array(sample: np.ndarray, stream: np.ndarray) -> np.ndarray:
    """The same of arrays."""
    k = stream.astype(np.int64)
    fifth = lambda x: x * x % M * (x * x % M) % M * x % M
    h = fifth((sample.astype(np.int64) * 48271 + k * 1299709 + 12345) % M)
    return fifth((h + k * 7919 + 1) % M) / float(M)


def uniform_sql(sample: str, stream: str) -> str:
    """The same in SQL."""
    fifth = lambda x: f"(((({x})*({x})%{M})*(({x})*({x})%{M})%{M})*({x})%{M})"
    h = fifth(f"(({sample})::bigint*48271+({stream})::bigint*1299709+12345)%{M}")
    return f"({fifth(f'(({h})+({stream})::bigint*7919+1)%{M}')}::double/{M}::double)"
