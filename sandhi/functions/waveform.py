"""Waveforms as arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim_silence(x: Column, thresh: float = 1e-3, pad: int = 480) -> Column:
    """Leading and trailing samples not above thresh, but for a pad; all silent gives an empty array."""
    loud = F.filter(F.transform(x, lambda v, i: F.when(F.abs(v) > thresh, i)), lambda i: i.isNotNull())
    lo, hi = F.greatest(F.lit(0), F.array_min(loud) - pad), F.least(F.size(x), F.array_max(loud) + pad + 1)
    return F.when(F.size(loud) == 0, F.slice(x, 1, 0)).otherwise(F.slice(x, lo + 1, hi - lo))


def quantize_pcm16(x: Column) -> Column:
    """To 16 bits, truncated towards zero; divided by the peak first where that is above 1."""
    peak = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    scale = F.when(peak > 1, peak).otherwise(F.lit(1.0))
    return F.transform(x, lambda v: F.least(F.lit(32767.0), F.greatest(F.lit(-32768.0), v.cast("double") / scale * 32767.0)).cast("smallint"))


def cut(x: Column, start_s: Column, end_s: Column, sr: int) -> Column:
    """Samples [start, end), clamped."""
    n = F.size(x)
    lo, hi = F.least(n, F.greatest(F.lit(0), F.round(start_s * sr).cast("int"))), F.least(n, F.greatest(F.lit(0), F.round(end_s * sr).cast("int")))
    return F.slice(x, lo + 1, F.greatest(hi - lo, F.lit(0)))


def mono(channels: Column) -> Column:
    """Mean over the channels of array<array<float>> (frames of samples)."""
    return F.transform(channels, lambda f: F.aggregate(f, F.lit(0.0).cast("double"), lambda a, v: a + v) / F.size(f))


def duration(x: Column, sr: int) -> Column:
    return F.size(x) / F.lit(float(sr))


def resample(sr: int, to: int = 16_000):
    """Linear interpolation from one rate to another, as a function of a column of array<float>."""

    def run(x: Column) -> Column:
        if sr == to:
            return x
        n, last = F.round(F.size(x) * (to / sr)).cast("int"), F.size(x) - 1

        def one(i: Column) -> Column:
            at = i * F.lit(sr / to)
            lo = F.least(F.floor(at).cast("int"), last)
            a, b = F.get(x, lo).cast("double"), F.get(x, F.least(lo + 1, last)).cast("double")
            return (a + (b - a) * F.least(F.lit(1.0), at - lo)).cast("float")

        return F.when(F.size(x) == 0, x).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), one))

    return run


def pad_labels(labels: Column, width: Column, fill: int = -100, most: int = 448) -> Column:
    return F.slice(F.concat(labels, F.array_repeat(F.lit(fill).cast("int"), F.greatest(width - F.size(labels), F.lit(0)))), 1, most)


def collate(df: DataFrame, batch: str, labels: str, start: int, fill: int = -100, most: int = 448) -> DataFrame:
    """df with its labels padded to the longest of their batch; the first of each is dropped where all of a
    batch begin with the start token (the model puts it back), then at most ``most`` are kept."""
    w = df.groupBy(batch).agg(F.max(F.size(labels)).alias("_width"), F.every(F.coalesce(F.get(labels, 0) == start, F.lit(False))).alias("_drop"))
    padded = pad_labels(F.col(labels), F.col("_width"), fill, 2**31 - 1)
    kept = F.when(F.col("_drop"), F.slice(padded, 2, F.greatest(F.col("_width") - 1, F.lit(0)))).otherwise(padded)
    return df.join(w, batch).withColumn(labels, F.slice(kept, 1, most)).drop("_width", "_drop")
