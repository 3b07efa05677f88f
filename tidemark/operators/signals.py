"""Audio-like sample rows: frame statistics and spectral flatness."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunked import index_chunk, join_same, ordered_scan


def frame_stats(samples: DataFrame, keys: Sequence[str], idx: str, value: str, frame: int = 400) -> DataFrame:
    """RMS statistics over frames, peak, zero crossings and energy continuity per clip.

    Only full frames count, unless a clip has none. Frames are map-side-combined sums, so only one row per frame reaches the clip level.
    """
    x = F.col(value)
    frames = samples.groupBy(*keys, F.floor(F.col(idx) / frame).alias("f")).agg(F.sqrt(F.avg(x * x) + 1e-12).alias("rms"), (F.count(x) == frame).alias("full"))
    whole = F.when(F.col("full"), F.col("rms"))
    over = lambda f: F.coalesce(f(whole), f(F.col("rms")))
    level = join_same(
        frames.groupBy(*keys).agg(over(F.avg).alias("rms_mean"), over(F.var_pop).alias("rms_variance"), F.max("full").alias("any_full")),
        spread(join_same(frames, frames.groupBy(*keys).agg(F.max("full").alias("any_full")), keys).where("full OR NOT any_full"), keys, "rms"), keys).drop("any_full")
    near = ordered_scan(samples, keys, [idx], index_chunk(idx), lag={"before": x})
    crossed = F.when(F.col("before").isNotNull(), F.when((x < 0) != (F.col("before") < 0), 1.0).otherwise(0.0))
    shape = near.groupBy(*keys).agg(F.max(F.abs(x)).alias("peak_level"), F.coalesce(F.avg(crossed), F.lit(0.0)).alias("zero_crossing_rate"))
    steady = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("rms_variance") / F.greatest(F.col("rms_mean") * F.col("rms_mean"), F.lit(1e-8))))
    return join_same(level, shape, keys).withColumn("energy_continuity", steady)


def spread(frames: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, dynamic_range): distance of the 95th from the 10th percentile, exact and interpolated.

    Rows are ranked in bands of the value, so no buffer holds a clip; of each clip only the four rows at the wanted ranks go on.
    """
    ranked = ordered_scan(frames.select(*keys, value), keys, [value], F.floor(F.log2(F.col(value)) * 256).cast("long"), row_number="rn")
    sized = join_same(ranked, frames.groupBy(*keys).agg(F.count(value).alias("n")), keys)

    def at(share: float):
        place = (F.col("n") - 1) * share
        low, high = F.floor(place), F.ceil(place)
        pick = lambda rank: F.max(F.when(F.col("rn") == rank + 1, F.col(value)))
        return pick(low) + (pick(high) - pick(low)) * F.max(place - low)

    return sized.groupBy(*keys).agg((at(0.95) - at(0.10)).alias("dynamic_range"))


def spectral_flatness(samples: DataFrame, keys: Sequence[str], idx: str, value: str, head: int = 64_000) -> DataFrame:
    """Geometric over arithmetic mean of the magnitude spectrum of the first `head` samples (four seconds at 16 kHz).

    The transform is defined on that fixed stretch, so its array has a fixed size; the Arrow batch holds many clips.
    """
    start = samples.where(F.col(idx) < head).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(idx, value))), lambda s: s[value]).alias("signal"))

    @F.pandas_udf("double")
    def flatness(signals: pd.Series) -> pd.Series:
        def one(signal) -> float:
            spectrum = np.abs(np.fft.rfft(np.asarray(signal, dtype=np.float64))) + 1e-12
            return float(min(1.0, max(0.0, np.exp(np.mean(np.log(spectrum))) / np.mean(spectrum))))

        return signals.map(one)

    return start.select(*keys, flatness("signal").alias("spectral_flatness"))
