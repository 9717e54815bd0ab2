"""Windows over long signals (series, pos, value) and the features of one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import placed, slotted

#: Percentiles of a window's amplitudes, linearly interpolated.
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def positions(df: DataFrame, series: str, *order: str) -> DataFrame:
    """pos: 0, 1, ... within each series by the order, whose first column is a number. One long series is numbered by many tasks."""
    return placed(df, [series], list(order), "pos")


def tumbling(df: DataFrame, size: int) -> DataFrame:
    """win: the window of each row; windows follow each other."""
    return df.withColumn("win", F.floor(F.col("pos") / size).cast("long")).withColumn("off", F.pmod("pos", F.lit(size)))


def sliding(df: DataFrame, size: int, stride: int) -> DataFrame:
    """A row for each window that covers it: win = start / stride, off = place in it. Windows start at multiples of the stride, from 0."""
    first = F.greatest(F.ceil((F.col("pos") - size + 1) / stride), F.lit(0)).cast("long")
    return df.withColumn("win", F.explode(F.sequence(first, F.floor(F.col("pos") / stride).cast("long")))).withColumn("off", F.col("pos") - F.col("win") * stride)


def whole_windows(df: DataFrame, by: list[str], size: int, group: str) -> DataFrame:
    """Windows that are complete and don't straddle a change of `group`: by, lo, hi of the group equal."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.min(group).alias("lo"), F.max(group).alias("hi")).where((F.col("rows") == size) & (F.col("lo") == F.col("hi")))


def summary(df: DataFrame, by: list[str], value: str, thresholds: tuple[float, ...] = (20.0, 50.0, 100.0)) -> DataFrame:
    """Moments, quantiles and shares above thresholds of each window, in one aggregation."""
    v, a = F.col(value), F.abs(F.col(value))
    shares = [F.avg((a > t).cast("double")).alias(f"above_{t:g}") for t in thresholds]
    quantiles = [F.percentile(v, F.lit(q)).alias(f"q{q * 1000:g}") for q in QUANTILES]
    return df.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(a).alias("abs_mean"), F.sqrt(F.avg(v * v)).alias("rms"), *quantiles, *shares)


def chunk_spread(df: DataFrame, by: list[str], value: str, chunk: int) -> DataFrame:
    """Mean, sd, 95 % quantile and maximum of the sds of a window's chunks (population sds)."""
    parts = df.groupBy(*by, F.floor(F.col("off") / chunk).alias("chunk")).agg(F.stddev_pop(value).alias("s"))
    return parts.groupBy(*by).agg(F.avg("s").alias("chunk_mean"), F.stddev_pop("s").alias("chunk_sd"), F.percentile("s", F.lit(0.95)).alias("chunk_q95"), F.max("s").alias("chunk_max"))


def trend(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Slope of the least-squares line through a window."""
    return df.groupBy(*by).agg(F.regr_slope(F.col(value), F.col("off").cast("double")).alias("slope"))


def rate_ratio(low: Column, high: Column, eps: float = 1e-6) -> Column:
    """log10 of the ratio of two rates."""
    return F.log10((low + eps) / (high + eps))


def time_to_next(df: DataFrame, series: str, seconds: str, event: Column, tiebreak: str) -> DataFrame:
    """ttf: seconds from each row to the next row (itself included) where the event holds; null after the last.

    Rows look ahead inside their slot of the order, and else take the first event of the slots after it.
    """
    cut = slotted(df.withColumn("__at", F.when(event, F.col(seconds))), seconds)
    ends = cut.groupBy(series, "__slot").agg(F.min("__at").alias("__first"))
    later = F.min("__first").over(Window.partitionBy(series).orderBy("__slot").rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(series, "__slot", later.alias("__later"))
    w = Window.partitionBy(series, "__slot").orderBy(F.col(seconds), F.col(tiebreak)).rowsBetween(0, Window.unboundedFollowing)
    seen = cut.withColumn("__next", F.min("__at").over(w)).join(ends, [series, "__slot"])
    return seen.withColumn("ttf", F.coalesce("__next", "__later") - F.col(seconds)).drop("__at", "__slot", "__next", "__later")


def loudest(df: DataFrame, series: str, value: str, size: int, stretch: int = 65536) -> DataFrame:
    """The start of each series' stretch of `size` rows with the largest root mean square, the earliest of equal ones; whole stretches only.

    A series is cut into pieces of `stretch` positions, each with the size - 1 rows that follow it.
    """
    own = F.floor(F.col("pos") / stretch)
    again = (F.col("pos") % stretch < size - 1) & (own > 0)
    pieces = df.select(series, "pos", value, F.explode(F.when(again, F.array(own - 1, own)).otherwise(F.array(own))).alias("__piece"))
    w = Window.partitionBy(series, "__piece").orderBy("pos").rowsBetween(0, size - 1)
    runs = pieces.withColumn("rms", F.sqrt(F.avg(F.col(value) * F.col(value)).over(w))).withColumn("__n", F.count("*").over(w)).where((F.col("__n") == size) & (own == F.col("__piece")))
    best = runs.groupBy(series).agg(F.max(F.struct(F.round("rms", 9).alias("rms"), (-F.col("pos")).alias("neg"))).alias("b"))
    return best.select(series, (-F.col("b.neg")).alias("start"), F.col("b.rms").alias("rms"))


def spectrum(df: DataFrame, by: list[str], value: str, bands: int = 8) -> DataFrame:
    """Spectral features of each window: log10 shares of `bands` log-spaced bands of the power spectrum without its
    constant part, the centroid, and the frequency below which 95 % of the power lies (as parts of the highest one).

    Bands run from a thousandth of the highest frequency up to it. SQL has no Fourier transform: windows
    are gathered as arrays, and a batch's windows of one length are transformed together. Windows of
    one row have no power.
    """
    import numpy as np
    import pyarrow as pa

    names = [*(f"band_{k}" for k in range(bands)), "centroid", "rolloff"]

    def features(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.rfft(x, axis=1))[:, 1:] ** 2
        n, m = power.shape
        if not m:
            return np.hstack([np.full((n, bands), -12.0), np.zeros((n, 2))])
        share = np.hstack([np.zeros((n, 1)), np.cumsum(power, axis=1)]) / (power.sum(axis=1, keepdims=True) + 1e-30)
        at = np.linspace(0, 1, m)
        edge = np.searchsorted(at, np.geomspace(1e-3, 1.0, bands + 1))
        low = np.log10(np.maximum(share[:, edge[1:]] - share[:, edge[:-1]], 0) + 1e-12)
        centroid = np.diff(share, axis=1) @ at
        rolloff = at[np.minimum((share[:, 1:] < 0.95).sum(axis=1), m - 1)]
        return np.hstack([low, centroid[:, None], rolloff[:, None]])

    def run(batches):
        for batch in batches:
            held = batch.column(len(by))
            ends = np.concatenate([[0], np.cumsum(held.value_lengths().to_numpy())])
            flat, sizes = held.flatten().to_numpy(zero_copy_only=False), np.diff(ends)
            out = np.zeros((batch.num_rows, bands + 2))
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                out[own] = features(flat[ends[own][:, None] + np.arange(size)[None, :]])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(by))), *(pa.array(c) for c in out.T)], [*by, *names])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), *(f"{c} double" for c in names)])
    windows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("off", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")))).alias("x"))
    return windows.select(*by, F.transform("x", lambda r: r["v"]).alias("x")).mapInArrow(run, schema)


def rms(samples: Column) -> Column:
    """Root mean square of an array of doubles; 0 if empty."""
    total = F.aggregate(samples, F.lit(0.0), lambda acc, v: acc + v * v)
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def mix_at_snr(front: Column, back: Column, snr_db: Column) -> Column:
    """front plus back scaled to the signal-to-noise ratio, scaled down where a sample exceeds 1. Arrays of equal length."""
    gain = F.when(rms(back) > 0, rms(front) / (rms(back) * F.pow(F.lit(10.0), snr_db / 20))).otherwise(0.0)
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  # a lambda's outer expressions are worked out anew for each sample
    mixed = once(gain, lambda g: F.zip_with(front, back, lambda f, b: f + g * b))
    peak = lambda m: F.greatest(F.array_max(F.transform(m, lambda v: F.abs(v))), F.lit(1.0))
    return once(mixed, lambda m: once(peak(m), lambda p: F.transform(m, lambda v: v / p)))


def quantised(samples: Column) -> Column:
    """Samples clipped to -1..1 as 16-bit integers, halves to even."""
    return F.transform(samples, lambda v: F.rint(F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)) * 32767).cast("int"))


def framed(samples: Column, size: int) -> Column:
    """The samples cut into frames of `size`, the last one padded with zeros."""
    n = F.greatest(F.ceil(F.size(samples) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.concat(samples, F.array_repeat(F.lit(0.0), size)), i * size + 1, F.lit(size)))


def mel_filters(rate: int, size: int, bands: int, low: float, high: float):
    """(bands, size / 2 + 1) triangles between frequencies evenly spaced in mel, each of unit area."""
    import numpy as np

    mel = 2595 * np.log10(1 + np.array([low, high]) / 700)
    edges = 700 * (10 ** (np.linspace(*mel, bands + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, size // 2 + 1)
    rising = (f - edges[:-2, None]) / np.diff(edges)[:-1, None]
    falling = (edges[2:, None] - f) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rising, falling)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(frames: DataFrame, key: str, samples: str, rate: int = 32000, size: int = 2048, window: int = 626, hop: int = 313, bands: int = 256, low: float = 20.0, high: float = 16000.0) -> DataFrame:
    """(key, mel array<array<double>>), a row of bands for each hop: mel power in dB, at most 80 dB under the loudest, standardised over
    the sample (standard deviation with n - 1). A numpy kernel.

    Frames of `size` are centred on each hop, the ends mirrored; the Hann window (periodic) of `window` samples stands in their middle.
    """
    import numpy as np
    import pandas as pd

    def image(x, filters, shape):
        x = np.asarray(x, dtype=float)
        x = np.pad(x if len(x) else np.zeros(1), size // 2, mode="reflect")
        parts = np.lib.stride_tricks.sliding_window_view(x, size)[::hop] * shape
        db = 10 * np.log10(np.maximum(1e-10, np.abs(np.fft.rfft(parts)) ** 2 @ filters.T))
        db = np.maximum(db, db.max() - 80)
        return (db - db.mean()) / (db.std(ddof=1) + 1e-6) if db.size > 1 else db * 0

    def run(batches):
        filters, shape = mel_filters(rate, size, bands, low, high), np.zeros(size)
        shape[(size - window) // 2 : (size - window) // 2 + window] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "mel": [None if x is None else image(x, filters, shape).tolist() for x in pdf[samples]]})

    return frames.select(key, samples).mapInPandas(run, f"{key} {dict(frames.dtypes)[key]}, mel array<array<double>>")


def resampling_filter(up: int, down: int, beta: float = 5.0):
    """A low-pass filter for a change of rate by up / down: a sinc under a Kaiser window, 10 periods of the slower rate to each side, of gain `up` at 0."""
    import numpy as np

    widest = max(up, down)
    reach = np.arange(-10 * widest, 10 * widest + 1)
    taps = np.sinc(reach / widest) * np.kaiser(len(reach), beta)
    return taps / taps.sum() * up


def resample(x, up: int = 3, down: int = 2):
    """x at up / down times its rate, along the last axis; ceil(n * up / down) samples, zeros beyond both ends.

    Output m is the filter over the stretched signal around m * down. Of its taps only each up-th meets a
    sample, so each phase is a short filter of its own.
    """
    import numpy as np

    x = np.asarray(x, dtype=float)
    taps, n = resampling_filter(up, down), x.shape[-1]
    half = len(taps) // 2
    out = np.zeros((*x.shape[:-1], -(-n * up // down)))
    centre = np.arange(out.shape[-1]) * down + half
    for phase in range(up):
        own = taps[phase::up]
        at = np.flatnonzero(centre % up == phase)
        padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(len(own) - 1, len(own) - 1 + half)])
        for j, w in enumerate(own):
            out[..., at] += w * padded[..., centre[at] // up - j + len(own) - 1]
    return out


def overlapping_chunks(frames: DataFrame, key: str, samples: str, length: int, chunk: int, up: int = 3, down: int = 2) -> DataFrame:
    """(key, chunk, samples): each row's signal, padded with zeros or cut to `length`, resampled, and its first and its last `chunk` samples (chunk 0 and 1)."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            pdf = pdf[pdf[samples].notna()]
            if not len(pdf):
                continue
            x = np.zeros((len(pdf), length))
            for k, own in enumerate(pdf[samples]):
                x[k, : min(len(own), length)] = own[:length]
            y = resample(x, up, down)
            for n, part in enumerate((y[:, :chunk], y[:, -chunk:])):
                yield pd.DataFrame({key: pdf[key].to_numpy(), "chunk": np.int32(n), "samples": list(part)})

    return frames.select(key, samples).mapInPandas(run, f"{key} {dict(frames.dtypes)[key]}, chunk int, samples array<double>")
