"""Preview tones and loudness as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.binding import let
from lectern.functions.text import words

#: Sample rate, clip limits in seconds, attack and release, peak.
RATE, SHORTEST, LONGEST, ATTACK, RELEASE, PEAK = 22_050, 2.5, 7.0, 0.35, 0.45, 9000
TARGET_DBFS, MAX_GAIN, FADE_IN_MS, FADE_OUT_MS = -16.0, 8.0, 220, 420


def clip_seconds(script: Column) -> Column:
    return F.least(F.greatest(F.size(words(script)) / 90.0, F.lit(SHORTEST)), F.lit(LONGEST))


def base_pitch(title: Column) -> Column:
    return F.lit(440) + F.length(F.coalesce(title, F.lit(""))) % 5 * 35


def sample_at(frame: Column, seconds: Column, pitch: Column) -> Column:
    """16-bit sample of the two-partial tone at a frame number."""
    t = frame / F.lit(float(RATE))
    envelope = F.least(t / ATTACK, F.lit(1.0)) * F.least((seconds - t) / RELEASE, F.lit(1.0))
    wave = F.sin(2 * math.pi * pitch * t) + 0.45 * F.sin(2 * math.pi * 1.25 * pitch * t)
    return (PEAK * F.greatest(envelope, F.lit(0.0)) * wave / 1.45).cast("int")


def tone(script: Column, title: Column) -> Column:
    """All samples of a preview clip."""
    secs, pitch = clip_seconds(script), base_pitch(title)
    frames = F.floor(secs * RATE).cast("int")
    return F.transform(F.sequence(F.lit(0), frames - 1), lambda i: sample_at(i, secs, pitch).cast("smallint"))


def gain(dbfs: Column, target: float = TARGET_DBFS) -> Column:
    """Decibels to add, clamped; silence (minus infinity or null) is passed through."""
    return F.when(dbfs.isNull() | (dbfs == float("-inf")), 0.0).otherwise(F.greatest(F.least(F.lit(target) - dbfs, F.lit(MAX_GAIN)), F.lit(-MAX_GAIN)))


def dbfs(samples: Column) -> Column:
    """Loudness of 16-bit samples: root mean square against full scale, in decibels; minus infinity for silence, null for none."""
    squares = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    power = F.try_divide(squares, F.size(samples))
    return F.when(power == 0, float("-inf")).otherwise(20 * F.log10(F.sqrt(power) / 32768.0))


def amplified(samples: Column, decibels: Column) -> Column:
    """Samples times a gain, clipped to 16 bits."""
    scale = lambda factor: F.transform(samples, lambda x: F.greatest(F.least(F.round(x * factor), F.lit(32767.0)), F.lit(-32768.0)).cast("smallint"))
    return let(F.pow(F.lit(10.0), decibels / 20), scale)


def faded(samples: Column, fade_in: int = FADE_IN_MS, fade_out: int = FADE_OUT_MS) -> Column:
    """Linear ramps at both ends."""
    a, b = RATE * fade_in // 1000, RATE * fade_out // 1000

    def ramped(xs: Column, n: Column) -> Column:
        ramp = lambda i: F.least(F.least(i / F.lit(float(a)), (n - 1 - i) / F.lit(float(b))), F.lit(1.0))
        return F.transform(xs, lambda x, i: (x * ramp(i)).cast("smallint"))

    return let(samples, lambda xs: let(F.size(xs), lambda n: ramped(xs, n)))


def mastered(samples: Column) -> Column:
    """Samples at the target loudness, within the greatest gain, and faded; silence stays."""

    def level(s: Column, loud: Column) -> Column:
        return F.when(F.coalesce(loud, F.lit(float("-inf"))) == float("-inf"), s).otherwise(faded(amplified(s, gain(loud))))

    return let(samples, lambda s: let(dbfs(s), lambda loud: level(s, loud)))
