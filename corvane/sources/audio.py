"""Audio files: WAV and FLAC, read from the bytes that binaryFile gives.

A probe reads headers alone. Reading takes an offset and a length in frames; of a FLAC file only the
frames that overlap them are decoded. Channels are mixed down to their mean.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession


class Info(NamedTuple):
    kind: str
    rate: int
    channels: int
    bits: int
    #: Samples of each channel; -1 where a FLAC file doesn't say.
    frames: int


class Broken(ValueError):
    pass


def probe(data: bytes) -> Info:
    """What the headers say; nothing is decoded. Broken if it is neither format, or cut off within the headers."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return _wav_layout(data)[0]
    if data[:4] == b"fLaC":
        return _flac_layout(data)[0]
    raise Broken("neither WAV nor FLAC")


def read(data: bytes, offset: int = 0, length: int | None = None) -> tuple[Info, np.ndarray]:
    """Samples of shape (frames, channels) in -1..1 from a frame on, at most length of them; fewer where the file ends before."""
    info = probe(data)
    end = None if length is None else offset + length
    return info, (_wav_samples if info.kind == "wav" else _flac_samples)(data, offset, end)


# WAV


def _wav_layout(data: bytes) -> tuple[Info, int, int, bool]:
    """Info, where the samples begin, bytes of a frame, and whether they are floating point."""
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 8 + size > len(data):
                raise Broken("a format chunk cut off")
            code, channels, rate, _, block, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if code == 0xFFFE and size >= 26:
                code = struct.unpack_from("<H", data, at + 32)[0]
            if code not in (1, 3) or not channels or bits not in ((8, 16, 24, 32) if code == 1 else (32, 64)) or block != channels * bits // 8:
                raise Broken(f"samples of format {code} with {bits} bits")
            form = (rate, channels, bits, block, code == 3)
        elif name == b"data":
            if form is None:
                raise Broken("samples before their format")
            rate, channels, bits, block, real = form
            return Info("wav", rate, channels, bits, min(size, len(data) - at - 8) // block), at + 8, block, real
        at += 8 + size + size % 2
    raise Broken("no samples")


def _wav_samples(data: bytes, offset: int, end: int | None) -> np.ndarray:
    info, first, block, real = _wav_layout(data)
    stop = info.frames if end is None else min(end, info.frames)
    raw = np.frombuffer(data, np.uint8, max(0, stop - offset) * block, first + min(offset, info.frames) * block)
    if real:
        return raw.view(f"<f{info.bits // 8}").astype(np.float64).reshape(-1, info.channels)
    if info.bits == 8:
        return ((raw.astype(np.float64) - 128) / 128).reshape(-1, info.channels)
    if info.bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = raw.reshape(-1, 3)
        return (wide.view("<i4")[:, 0].astype(np.float64) / 2**31).reshape(-1, info.channels)
    return (raw.view(f"<i{info.bits // 8}").astype(np.float64) / 2.0 ** (info.bits - 1)).reshape(-1, info.channels)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A 16-bit WAV file of whole numbers, of shape (frames,) or (frames, channels)."""
    x = np.asarray(samples, "<i2")
    channels = 1 if x.ndim == 1 else x.shape[1]
    body = x.tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16, b"data", len(body))
    return head + body


# FLAC


class _Bits:
    """Bits of some bytes from a place on; ones are looked up where unary codes end."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        ones = np.flatnonzero(self.bits)
        after = np.searchsorted(ones, np.arange(len(self.bits)))
        self.next_one = np.append(ones, len(self.bits))[after].tolist()
        self.number, self.size, self.at = int.from_bytes(data, "big"), len(self.bits), 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise Broken("a frame cut off")
        self.at += n
        return (self.number >> (self.size - self.at)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        if self.at >= self.size or (one := self.next_one[self.at]) >= self.size:
            raise Broken("a frame cut off")
        zeros = one - self.at
        self.at = one + 1
        return zeros

    def rice(self, n: int, k: int) -> list[int]:
        """n numbers: a unary quotient and k low bits each, the lowest telling the sign."""
        weights = (1 << np.arange(k - 1, -1, -1)).tolist()
        at, bits, next_one, size = self.at, self.bits, self.next_one, self.size
        starts, quotients = [], []
        for _ in range(n):
            if at >= size or (one := next_one[at]) + 1 + k > size:
                raise Broken("a frame cut off")
            quotients.append(one - at)
            starts.append(one + 1)
            at = one + 1 + k
        self.at = at
        low = (bits[np.array(starts)[:, None] + np.arange(k)].astype(np.int64) @ np.array(weights, np.int64)) if k else np.zeros(n, np.int64)
        folded = (np.array(quotients, np.int64) << k) + low
        return ((folded >> 1) ^ -(folded & 1)).tolist()


def _flac_layout(data: bytes) -> tuple[Info, int, int]:
    """Info, where the frames begin, and the block size (0 if it varies)."""
    at, info, block = 4, None, 0
    while at + 4 <= len(data):
        kind, size = data[at], int.from_bytes(data[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            if at + 22 > len(data):
                raise Broken("headers cut off")
            least, most = struct.unpack_from(">HH", data, at + 4)
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            frames = packed & ((1 << 36) - 1)
            info = Info("flac", packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, frames or -1)
            block = most if least == most else 0
        at += 4 + size
        if kind & 128:
            break
    if info is None or not info.rate:
        raise Broken("no stream information")
    return info, at, block


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc ^= b
        for _ in range(8):
            crc = (crc << 1 ^ 0x07 if crc & 128 else crc << 1) & 255
    return crc


class _Frame(NamedTuple):
    body: int
    first: int
    size: int
    channels: int
    bits: int


def _frame(data: bytes, at: int, info: Info, block: int) -> _Frame | None:
    """What the frame header at a place says; None if there is none."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size_code, rate_code, channel_code, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if not size_code or rate_code == 15 or channel_code > 10 or bits_code == 3 or data[at + 3] & 1:
        return None
    place = at + 4
    lead = data[place]
    more = 0 if lead < 128 else 8 - (lead ^ 255).bit_length() - 1
    if lead >= 128 and not 1 <= more <= 6 or place + 1 + more + 5 > len(data):
        return None
    number = lead if lead < 128 else lead & ((1 << (6 - more)) - 1)
    for b in data[place + 1 : place + 1 + more]:
        number = number << 6 | b & 63
    place += 1 + more
    if size_code in (6, 7):
        n = size_code - 5
        size = int.from_bytes(data[place : place + n], "big") + 1
        place += n
    else:
        size = 192 if size_code == 1 else 144 << size_code if size_code < 6 else 1 << size_code
    place += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if _crc8(data[at:place]) != data[place]:
        return None
    bits = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}.get(bits_code, info.bits)
    first = number if data[at + 1] & 1 else number * (block or size)
    return _Frame(place + 1, first, size, channel_code, bits)


def _flac_samples(data: bytes, offset: int, end: int | None) -> np.ndarray:
    info, at, block = _flac_layout(data)
    out, expected = [np.zeros((0, info.channels))], 0
    while end is None or expected < end:
        frame = _frame(data, at, info, block)
        if frame is None or frame.first != expected:  # not a frame's start: look for the next one
            at = data.find(b"\xff", at + 1)
            if at < 0:
                break
            continue
        expected += frame.size
        if expected > offset:
            x, at = _decoded(data, frame)
            a = max(0, offset - frame.first)
            b = frame.size if end is None else min(frame.size, end - frame.first)
            out.append(x[a:b] / 2.0 ** (frame.bits - 1))
        else:
            at = frame.body
    got = np.concatenate(out)
    if info.frames >= 0 and len(got) < max(0, min(info.frames, info.frames if end is None else end) - offset):
        raise Broken("frames are missing")
    return got


def _decoded(data: bytes, frame: _Frame) -> tuple[np.ndarray, int]:
    """Whole numbers of a frame's channels, and where the next frame begins."""
    channels = frame.channels + 1 if frame.channels < 8 else 2
    # A channel can't take more than its samples verbatim, or so nearly.
    bits = _Bits(data[frame.body : frame.body + channels * (frame.size * (frame.bits + 2) // 8 + 1024)])
    wide = [frame.bits + (frame.channels == 8 and c == 1 or frame.channels == 9 and c == 0 or frame.channels == 10 and c == 1) for c in range(channels)]
    x = [np.array(_subframe(bits, frame.size, w), np.int64) for w in wide]
    if frame.channels == 8:
        x[1] = x[0] - x[1]
    elif frame.channels == 9:
        x[0] = x[0] + x[1]
    elif frame.channels == 10:
        middle = (x[0] << 1) | (x[1] & 1)
        x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
    return np.stack(x, axis=1), frame.body + -(-bits.at // 8) + 2


def _subframe(bits: _Bits, n: int, width: int) -> list[int]:
    if bits.take(1):
        raise Broken("not a channel's start")
    kind, wasted = bits.take(6), bits.unary() + 1 if bits.take(1) else 0
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * n
    elif kind == 1:
        out = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        # The predictors of orders 0 to 4 that need no coefficients.
        weights, shift = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])[order] if kind < 32 else [], 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = [bits.signed(precision) for _ in range(order)]
        rest = _residual(bits, n, order)
        for r in rest:
            guess = sum(w * x for w, x in zip(weights, reversed(out[-order:]), strict=True)) if order else 0
            out.append(r + (guess >> shift))
    else:
        raise Broken("a channel of no known kind")
    return [x << wasted for x in out] if wasted else out


def _residual(bits: _Bits, n: int, order: int) -> list[int]:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or n % parts or n // parts < order:
        raise Broken("a residual of no known kind")
    out, size = [], 4 + method
    for p in range(parts):
        count, k = n // parts - (order if p == 0 else 0), bits.take(size)
        if k == (1 << size) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(count)]
        else:
            out += bits.rice(count, k)
    return out


# Columns


def probed(df: DataFrame, content: str) -> DataFrame:
    """df, without the bytes, with kind, rate, channels, bits, frames and duration (seconds) of each file; all null where it can't be read."""

    def work(data):
        try:
            info = probe(bytes(data))
        except (Broken, TypeError):
            return (None,) * 6
        return (*info, info.frames / info.rate)

    return _mapped(df, content, "kind string, rate int, channels int, bits int, frames long, duration double", work)


def decoded(df: DataFrame, content: str, offset: float = 0.0, length: float | None = None) -> DataFrame:
    """df, without the bytes, with rate and samples (array<float>, the channels' mean) from so many seconds on; null where a file can't be read."""

    def work(data):
        try:
            rate = probe(bytes(data)).rate
            _, x = read(bytes(data), round(offset * rate), None if length is None else round(length * rate))
        except (Broken, TypeError):
            return None, None
        return rate, x.mean(axis=1).astype(np.float32)

    return _mapped(df, content, "rate int, samples array<float>", work)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")


def encoded(df: DataFrame, samples: str, to: str, rate: int) -> DataFrame:
    """df with a 16-bit WAV file of an array of whole numbers; null for null."""
    return _mapped(df, samples, f"{to} binary", lambda x: (None if x is None else wav_bytes(np.array(x), rate),), keep=True)


def _mapped(df: DataFrame, column: str, schema: str, work, keep: bool = False) -> DataFrame:
    from pyspark.sql.types import StructType

    new = df.sparkSession.createDataFrame([], schema).schema
    kept = [f for f in df.schema.fields if keep or f.name != column]
    out, at = StructType([*kept, *new.fields]), df.columns.index(column)
    places = [df.columns.index(f.name) for f in kept]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        for batch in batches:
            for k in range(batch.num_rows):  # a file's samples are large: one row at a time
                rows = [work(batch.column(at)[k].as_py())]
                yield pa.RecordBatch.from_arrays([*(batch.column(p).slice(k, 1) for p in places), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], out.names)

    return df.mapInArrow(run, out)
