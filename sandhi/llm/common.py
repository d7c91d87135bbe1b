"""Expressions shared by the operators: terms, cleaned keys, 64-bit mixing in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

#: categories P and S stand for a blank, and terms are parted by Unicode white space
APART = r"(?U)[\p{P}\p{S}\s]+"


def term_array(text: Column) -> Column:
    """Terms, lower-cased, in order; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), "")


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the terms in order."""
    return F.transform(term_array(text), lambda x: F.xxhash64(x))


def clean_key(c: Column) -> Column:
    """Speakers and sources: case and outer blanks do not count, blank is null."""
    k = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(k != "", k)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of an arrow list column (nulls as empty)."""
    n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    return col.flatten().to_numpy(zero_copy_only=False), n


def starts(n: np.ndarray) -> np.ndarray:
    s = np.zeros(len(n), dtype=np.int64)
    np.cumsum(n[:-1], out=s[1:])
    return s


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, ... restarted for every run of the given lengths."""
    return np.arange(int(n.sum()), dtype=np.int64) - np.repeat(starts(n), n)


def list_array(values: np.ndarray, n: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(n, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
