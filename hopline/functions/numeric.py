"""Numbers as the signal operators need them: saturation, wrap-around, back-off, tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -32768, 32767
WRAP = 1 << 32


def pcm16(value: Column) -> Column:
    """Rounded half away from zero, saturated, as smallint (SF10). The clamp comes before the cast, which raises on overflow."""
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.round(value))).cast("smallint")


def pcm16_of_float(value: Column, gain: float = 1.0) -> Column:
    """A float sample times ``gain``, clamped to one, times 32767, rounded half to even (SF12)."""
    return F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value * gain)) * HIGH).cast("smallint")


def wrapped_difference(a: Column, b: Column) -> Column:
    """a - b for unsigned 32-bit counters (SF13)."""
    return F.pmod(a - b, F.lit(WRAP))


def position_at(start_rtp: Column, current_rtp: Column, end_rtp: Column, anchor_frame: Column, stream_frame: Column) -> Column:
    """Frames into the track at a stream frame: the anchor's position and what has passed since, at most the duration (SF13)."""
    live = wrapped_difference(current_rtp, start_rtp) + F.greatest(F.lit(0), stream_frame - anchor_frame)
    return F.least(live, wrapped_difference(end_rtp, start_rtp))


def whole_seconds(duration: Column) -> Column:
    """The nearest second, half up, 1 at least (SF11)."""
    return F.greatest(F.lit(1), F.floor(duration + 0.5)).cast("int")


def retry_delay_ms(failures: Column) -> Column:
    """100 ms doubled with each failure, 1000 ms at most (SF14)."""
    return F.least(F.pow(F.lit(2.0), F.least(failures, F.lit(4))).cast("int") * 100, F.lit(1000))


def next_id(now: Column, previous: Column) -> Column:
    """Strictly increasing: now, or one more than the previous (SF25, SK9)."""
    return F.greatest(now, previous + 1)


def visual_energy(peak_left: Column, peak_right: Column, rms_left: Column, rms_right: Column) -> tuple[Column, Column]:
    """(energy, balance) of a level summary: mean RMS and mean peak as 0.65 to 0.35, in [0, 1]; right RMS less left, in [-1, 1] (SF15)."""
    energy = 0.65 * (rms_left + rms_right) / 2 + 0.35 * (peak_left + peak_right) / 2
    clamp = lambda c, low: F.least(F.lit(1.0), F.greatest(F.lit(low), c))
    return clamp(energy, 0.0), clamp(rms_right - rms_left, -1.0)


def every_second(values: Column, most: int = 64) -> Column:
    """Every second element, ``most`` at most (SF22)."""
    return F.slice(F.filter(values, lambda v, i: i % 2 == 0), 1, most)


def channel(pcm: Column, number: int, channels: int = 2) -> Column:
    """One channel of interleaved samples (SF24)."""
    return F.filter(pcm, lambda v, i: i % channels == number)


def frame_range(pcm: Column, first: Column, frames: Column, channels: int = 2) -> Column:
    """Frames [first, first + frames) of interleaved samples (SC2, SK8)."""
    return F.slice(pcm, (channels * first + 1).cast("int"), (channels * frames).cast("int"))
