"""Audio: files made here come back sample for sample; resampling and log-mel against plain definitions."""

import struct
import wave

import numpy as np
import pytest

from corvane.operators import signal
from corvane.sources import audio


class Writer:
    def __init__(self):
        self.text = []

    def put(self, x, n):
        self.text.append(format(x & ((1 << n) - 1), f"0{n}b") if n else "")

    def unary(self, n):
        self.text.append("0" * n + "1")

    def done(self):
        bits = "".join(self.text)
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


PREDICT = [lambda h: 0, lambda h: h[-1], lambda h: 2 * h[-1] - h[-2], lambda h: 3 * h[-1] - 3 * h[-2] + h[-3], lambda h: 4 * h[-1] - 6 * h[-2] + 4 * h[-3] - h[-4]]


def residual(w, rest, order, n, k, parts):
    w.put(0, 2)
    w.put(parts, 4)
    at = 0
    for p in range(1 << parts):
        count = n // (1 << parts) - (order if p == 0 else 0)
        w.put(k, 4)
        if k == 15:
            w.put(20, 5)
        for r in rest[at : at + count]:
            if k == 15:
                w.put(r, 20)
            else:
                u = 2 * r if r >= 0 else -2 * r - 1
                w.unary(u >> k)
                w.put(u, k)
        at += count


def subframe(w, x, bits, kind, k=4, parts=0):
    x = [int(v) for v in x]
    w.put(0, 1)
    if kind == "constant":
        w.put(0, 6), w.put(0, 1), w.put(x[0], bits)
    elif kind == "verbatim":
        w.put(1, 6), w.put(0, 1)
        for v in x:
            w.put(v, bits)
    elif kind == "wasted":
        w.put(1, 6), w.put(1, 1), w.unary(1)
        for v in x:
            w.put(v >> 2, bits - 2)
    elif kind == "lpc":
        weights, shift, order = [7, -3, 1], 2, 3
        w.put(32 + order - 1, 6), w.put(0, 1)
        for v in x[:order]:
            w.put(v, bits)
        w.put(5 - 1, 4), w.put(shift, 5)
        for c in weights:
            w.put(c, 5)
        residual(w, [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(weights)) >> shift) for i in range(order, len(x))], order, len(x), k, parts)
    else:
        order = int(kind)
        w.put(8 + order, 6), w.put(0, 1)
        for v in x[:order]:
            w.put(v, bits)
        residual(w, [x[i] - PREDICT[order](x[:i]) for i in range(order, len(x))], order, len(x), k, parts)


def flac(x, rate=32000, bits=16, block=192, kinds=("2",), mode=None, k=9, parts=1):
    """x: whole numbers of shape (n, channels)."""
    n, channels = x.shape
    info = struct.pack(">HH", block, block) + bytes(6) + ((rate << 44) | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x84]) + (5).to_bytes(3, "big") + b"extra"
    for f, at in enumerate(range(0, n, block)):
        part = x[at : at + block]
        head = bytes([0xFF, 0xF8, 0x70, ({"left": 8, "right": 9, "middle": 10}.get(mode, channels - 1) << 4) | 0]) + chr(f).encode() + (len(part) - 1).to_bytes(2, "big")
        head += bytes([audio._crc8(head)])
        columns, wide = [part[:, c] for c in range(channels)], [bits] * channels
        if mode == "left":
            columns, wide = [part[:, 0], part[:, 0] - part[:, 1]], [bits, bits + 1]
        elif mode == "right":
            columns, wide = [part[:, 0] - part[:, 1], part[:, 1]], [bits + 1, bits]
        elif mode == "middle":
            columns, wide = [(part[:, 0] + part[:, 1]) >> 1, part[:, 0] - part[:, 1]], [bits, bits + 1]
        w = Writer()
        for c, own in enumerate(columns):
            kind = kinds[(f + c) % len(kinds)]
            subframe(w, own, wide[c], kind, k, parts if len(part) % (1 << parts) == 0 else 0)
        out += head + w.done() + b"\0\0"
    return out


def noise(n, channels, seed=0, size=900):
    rng = np.random.default_rng(seed)
    return (np.cumsum(rng.normal(0, 40, (n, channels)), axis=0) + rng.normal(0, size, (n, channels))).round().astype(np.int64).clip(-30000, 30000)


@pytest.mark.parametrize("kinds, k, parts", [(("verbatim",), 0, 0), (("0", "1", "2", "3", "4"), 10, 1), (("lpc",), 10, 2), (("2",), 15, 0), (("lpc", "verbatim", "1"), 9, 1)])
@pytest.mark.parametrize("mode", [None, "left", "right", "middle"])
def test_flac_sample_for_sample(kinds, k, parts, mode):
    x = noise(1000, 2, seed=len(kinds))
    info, got = audio.read(flac(x, kinds=kinds, mode=mode, k=k, parts=parts))
    assert info == ("flac", 32000, 2, 16, 1000) and (got * 2**15 == x).all()


def test_flac_of_other_shapes():
    x = np.full((400, 1), -7)
    assert (audio.read(flac(x, kinds=("constant",)))[1] * 2**15 == x).all()
    x = noise(500, 3) * 4 // 4 * 4
    assert (audio.read(flac(x, kinds=("wasted",)))[1] * 2**15 == x).all()
    assert audio.read(flac(np.zeros((0, 1), np.int64)))[1].shape == (0, 1)


def test_flac_passages():
    x = noise(2000, 2)
    data = flac(x, kinds=("3", "lpc"), mode="middle")
    for a, n in ((0, 10), (190, 5), (700, 600), (1990, 50), (5000, 3), (192, 192)):
        assert (audio.read(data, a, n)[1] * 2**15 == x[a : a + n]).all()


@pytest.mark.parametrize("width, channels", [(1, 1), (2, 1), (2, 2), (3, 2), (4, 3)])
def test_wav_sample_for_sample(tmp_path, width, channels):
    rng = np.random.default_rng(width)
    raw = rng.integers(0, 256, (300, channels, width), np.uint8)
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(8000)
        w.writeframes(raw.tobytes())
    info, got = audio.read((tmp_path / "a.wav").read_bytes(), 100, 50)
    want = [[int.from_bytes(bytes(v), "little", signed=width > 1) - (128 if width == 1 else 0) for v in row] for row in raw[100:150]]
    assert info == ("wav", 8000, channels, width * 8, 300) and (got * 2.0 ** (8 * width - 1) == np.array(want)).all()


def test_floating_point_wav_with_other_chunks():
    x = np.array([0.5, -1.25, 3.0], "<f4")
    form = struct.pack("<HHIIHH", 3, 1, 16000, 64000, 4, 32)
    data = b"RIFF" + bytes(4) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", 12) + x.tobytes()
    assert audio.read(data)[1][:, 0].tolist() == x.tolist()


@pytest.mark.parametrize("data", [b"", b"RIFF", b"fLaC", b"RIFF0000WAVE", b"RIFF0000WAVEdata\0\0\0\0", b"OggS" * 9, b"fLaC\x84\0\0\1x", flac(noise(400, 1))[:300]])
def test_broken_files(data):
    with pytest.raises(audio.Broken):
        audio.read(data)


def test_files_in_columns(spark, tmp_path):
    x = noise(6400, 2)
    (tmp_path / "a.flac").write_bytes(flac(x, block=640))
    (tmp_path / "b.wav").write_bytes(audio.wav_bytes(x[:, 0], 32000))
    (tmp_path / "c.wav").write_bytes(b"none")
    rows = audio.files(spark, str(tmp_path))
    info = {r.path[-6:]: (r.kind, r.rate, r.channels, r.bits, r.frames, r.duration) for r in audio.probed(rows, "content").collect()}
    assert info == {"a.flac": ("flac", 32000, 2, 16, 6400, 0.2), "/b.wav": ("wav", 32000, 1, 16, 6400, 0.2), "/c.wav": (None,) * 6}
    got = {r.path[-6:]: r.samples for r in audio.decoded(rows, "content", 0.05, 0.1).collect()}
    assert np.allclose(got["a.flac"], x[1600:4800].mean(axis=1) / 2**15, atol=1e-7) and np.allclose(got["/b.wav"], x[1600:4800, 0] / 2**15, atol=1e-7) and got["/c.wav"] is None


def test_resampling_against_the_definition():
    rng = np.random.default_rng(4)
    for n in (1, 2, 31, 64, 301):
        x, taps = rng.normal(size=n), signal.resampling_filter(3, 2)
        stretched = np.zeros(3 * n)
        stretched[::3] = x
        whole = np.convolve(stretched, taps)[30:]
        assert np.allclose(signal.resample(x), np.append(whole, np.zeros(9))[: 2 * -(-3 * n // 2) : 2], atol=1e-12)
    t = np.arange(3200) / 32000
    y = signal.resample(np.stack([np.sin(2 * np.pi * 440 * t), np.ones(3200)]))
    assert y.shape == (2, 4800) and np.abs(y[0, 300:-300] - np.sin(2 * np.pi * 440 * np.arange(4800) / 48000)[300:-300]).max() < 2e-3 and abs(y[1, 2400] - 1) < 2e-3


def test_chunks_cover_both_ends(spark):
    df = spark.createDataFrame([(1, [float(k) for k in range(50)]), (2, [1.0] * 20), (3, None)], "id long, x array<double>")
    got = {(r.id, r.chunk): r.samples for r in signal.overlapping_chunks(df, "id", "x", 50, 45).collect()}
    y = signal.resample(np.arange(50.0))
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1)} and np.allclose(got[1, 0], y[:45]) and np.allclose(got[1, 1], y[-45:]) and abs(got[2, 1][-1]) < 1e-12


def test_log_mel_against_the_definition(spark):
    rate, size, window, hop, bands, low, high = 800, 64, 40, 20, 7, 20.0, 400.0
    x = np.random.default_rng(5).normal(size=230)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(low), mel(high), bands + 2)]
    mirrored = [*x[32:0:-1], *x, *x[-2:-34:-1]]
    image = []
    for at in range(0, len(x) + 1, hop):
        frame = [mirrored[at + k] * (0.5 - 0.5 * np.cos(2 * np.pi * (k - 12) / window) if 12 <= k < 52 else 0) for k in range(size)]
        power = [abs(sum(v * np.exp(-2j * np.pi * f * k / size) for k, v in enumerate(frame))) ** 2 for f in range(size // 2 + 1)]
        row = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            weights = [max(0, min((f * rate / size - a) / (b - a), (c - f * rate / size) / (c - b))) * 2 / (c - a) for f in range(size // 2 + 1)]
            row.append(10 * np.log10(max(1e-10, sum(w * p for w, p in zip(weights, power)))))
        image.append(row)
    db = np.maximum(image, np.max(image) - 80)
    want = (db - db.mean()) / (db.std(ddof=1) + 1e-6)
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [])], "id long, x array<double>")
    got = {r.id: r.mel for r in signal.log_mel(df, "id", "x", rate, size, window, hop, bands, low, high).collect()}
    assert np.allclose(got[1], want, atol=1e-9) and got[2] is None and len(got[3]) == 1
