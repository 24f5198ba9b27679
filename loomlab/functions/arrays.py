"""Arithmetic on array columns (frames, waveforms) without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the energy-based audio classes.
SILENT_RMS = 0.005
SPEECH_ZCR = 0.15
MUSIC_RMS = 0.05
MUSIC_ZCR = 0.08


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def every(values: Column, stride: int) -> Column:
    """Every ``stride``-th value, from the first on."""
    return values if stride == 1 else F.filter(values, lambda _, i: i % stride == 0)


def mean_abs_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.try_divide(total(gaps), F.size(gaps))


def rms(samples: Column) -> Column:
    return F.sqrt(F.try_divide(total(F.transform(samples, lambda x: x * x)), F.size(samples)))


def zero_crossing_rate(samples: Column) -> Column:
    """Half the mean jump of the sign between neighbors."""
    signs = F.transform(samples, lambda x: F.signum(x))
    n = F.size(samples) - 1
    jumps = F.zip_with(F.slice(signs, F.lit(2), F.greatest(n, F.lit(0))), F.slice(signs, F.lit(1), F.greatest(n, F.lit(0))), lambda x, y: F.abs(x - y))
    return F.try_divide(total(jumps), n) / 2


def audio_class(samples: Column) -> Column:
    """silence, speech, music or ambient; missing and empty audio is silence."""
    loud, crossings = rms(samples), zero_crossing_rate(samples)
    return (
        F.when(samples.isNull() | (F.size(samples) == 0) | (loud < SILENT_RMS), "silence")
        .when(crossings > SPEECH_ZCR, "speech")
        .when((loud > MUSIC_RMS) & (crossings < MUSIC_ZCR), "music")
        .otherwise("ambient")
    )


def chunks(samples: Column, size: int) -> Column:
    """Consecutive slices of ``size`` samples; the last may be shorter, an empty array has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(samples) / size).cast("int") - 1, F.lit(0)))
    cut = F.transform(starts, lambda i: F.slice(samples, i * size + 1, F.lit(size)))
    return F.filter(cut, lambda c: F.size(c) > 0)
