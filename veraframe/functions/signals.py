"""Quality signals and degradations of grey pictures, as Arrow batches over rows of flat pixel arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGNALS_V1 = ("sharpness", "hf_ratio", "blockiness")
SIGNALS_V2 = (*SIGNALS_V1, "noise_sigma")


def _shifts(x: np.ndarray, size: int, mode: str = "reflect") -> list[list[np.ndarray]]:
    """The picture shifted to each place of a square around a pixel; beyond its border it is mirrored or repeated."""
    wide = np.pad(x, size // 2, mode=mode)
    return [[wide[i : i + x.shape[0], j : j + x.shape[1]] for j in range(size)] for i in range(size)]


def _filtered(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The picture under a square kernel, mirrored at its border."""
    return sum(k * v for ks, vs in zip(kernel, _shifts(x.astype(np.float64), len(kernel)), strict=True) for k, v in zip(ks, vs, strict=True) if k)


def _separable(x: np.ndarray, line: np.ndarray) -> np.ndarray:
    half = len(line) // 2
    wide = np.pad(x, ((half, half), (0, 0)), mode="reflect")
    x = sum(k * wide[i : i + x.shape[0]] for i, k in enumerate(line))
    wide = np.pad(x, ((0, 0), (half, half)), mode="reflect")
    return sum(k * wide[:, i : i + x.shape[1]] for i, k in enumerate(line))


def _gaussian(sigma: float, radius: int) -> np.ndarray:
    line = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    return line / line.sum()


LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]])
NOISE = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]])


def signals_v1(grey: np.ndarray) -> np.ndarray:
    """Sharpness, share of high frequencies and blockiness of a picture of 224 x 224 pixels; the first two denoised."""
    calm = np.partition(np.stack([v for row in _shifts(grey, 3, "edge") for v in row]), 4, axis=0)[4][32:192, 32:192]
    sharp = np.log10(_filtered(calm, LAPLACE).var() + 1e-6)
    n = len(calm)
    power = np.abs(np.fft.rfft2((calm - calm.mean()) * np.outer(np.hanning(n), np.hanning(n)))) ** 2
    radius = np.hypot(*np.meshgrid(np.fft.rfftfreq(n), np.fft.fftfreq(n)))
    band = lambda low: power[(radius >= low) & (radius <= 0.5)].sum() + 1e-6
    steps = [np.abs(np.diff(grey.astype(np.float64), axis=a)).mean(axis=1 - a) for a in (0, 1)]
    # Steps over block borders against steps in the middle of blocks.
    blocks = [sum(s[p - 1 :: p].mean() for s in steps) / (sum(s[p // 2 - 1 :: p].mean() for s in steps) + 2e-6) for p in (8, 4)]
    return np.array([sharp, np.log10(band(0.25) / band(0.03)), max(1.0, *blocks)], np.float32)


def _bands() -> tuple[Callable, Callable, float, float]:
    high = lambda x: x - _separable(x, _gaussian(1.0, 2))
    broad = lambda x: x - _separable(x, np.full(13, 1 / 13))
    point = np.zeros((41, 41))
    point[20, 20] = 1
    return high, broad, float((high(point) ** 2).sum()), float((broad(point) ** 2).sum())


def _contrast(steps: np.ndarray, period: int) -> float:
    """How much one phase of a period stands out, less what stands out half a period away (a ripple does both)."""
    phase = steps[: len(steps) // period * period].reshape(-1, period).mean(axis=0)
    out = phase - (np.roll(phase, 1) + np.roll(phase, -1)) / 2
    return float((out - np.roll(out, period // 2)).max() / (phase.mean() + 1e-6))


def signals_v2(grey: np.ndarray) -> np.ndarray:
    """The signals less what noise adds to them, and the noise, of a picture of 224 x 224 pixels."""
    roi = grey[48:176, 48:176].astype(np.float64)
    h, w = roi.shape
    sigma = np.sqrt(np.pi / 2) * np.abs(_filtered(roi, NOISE)[1:-1, 1:-1]).sum() / (6 * (w - 2) * (h - 2))
    sharp = np.log10(max(_filtered(roi, LAPLACE)[1:-1, 1:-1].var() - 20 * sigma**2, 0) + 1)
    high, broad, high_gain, broad_gain = _bands()
    energy = lambda f, gain: max(f(roi)[8:-8, 8:-8].var() - gain * sigma**2, 0) + 1
    steps = [np.abs(np.diff(grey.astype(np.float64), axis=a)).mean(axis=1 - a)[:208] for a in (1, 0)]
    return np.array([sharp, np.log10(energy(high, high_gain) / energy(broad, broad_gain)), max(_contrast(s, p) for s in steps for p in (8, 16)), sigma], np.float32)


def signals_hybrid(grey: np.ndarray) -> np.ndarray:
    """The first set's signals with the second's noise."""
    return np.append(signals_v1(grey), signals_v2(grey)[3])


def frame_signals(frames: DataFrame, pixels: str, width: int, keys: list[str], names: tuple[str, ...], signals: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``keys`` and a column for each signal of the flat arrays of grey values in ``pixels``, row by row ``width`` long."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([signals(np.asarray(v, np.uint8).reshape(-1, width)) for v in b.column(n).to_pylist()], float).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *map(pa.array, out.T)], names=[*keys, *names])

    picked = frames.select(*keys, pixels)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, kinds + "".join(f", {s} double" for s in names))


def _resized(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Bilinear, with pixels at the middles of their squares."""
    for axis, size in ((0, rows), (1, columns)):
        at = np.clip((np.arange(size) + 0.5) * x.shape[axis] / size - 0.5, 0, x.shape[axis] - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, x.shape[axis] - 1), axis) * part
    return x


def _down_up(x: np.ndarray, factor: float) -> np.ndarray:
    return _resized(_resized(x, max(1, round(len(x) * factor)), max(1, round(x.shape[1] * factor))), *x.shape)


def _noisy(x: np.ndarray, sigma: float, seed: str) -> np.ndarray:
    rng = np.random.default_rng(int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "little"))
    return x + rng.normal(0, sigma, x.shape)


#: What a chain can do to one picture, by name; codecs are the user's to add.
OPS: dict[str, Callable[[np.ndarray, float, str], np.ndarray]] = {
    "resize": lambda x, v, _: _down_up(x, v),
    "blur": lambda x, v, _: _separable(x, _gaussian(v, max(1, int(3 * v + 0.5)))),
    "gamma": lambda x, v, _: 255 * (x / 255) ** v,
    "noise": _noisy,
}
#: Conditions as (name, chain, severity).
CONDITIONS = (
    ("resize_0.75", (("resize", 0.75),), "mild"), ("resize_0.5", (("resize", 0.5),), "moderate"), ("resize_0.33", (("resize", 0.33),), "severe"),
    ("blur_s1.0", (("blur", 1.0),), "moderate"), ("blur_s2.0", (("blur", 2.0),), "severe"), ("noise_s4", (("noise", 4.0),), "moderate"), ("noise_s10", (("noise", 10.0),), "severe"),
    ("gamma_0.7", (("gamma", 0.7),), "severe"), ("gamma_1.4", (("gamma", 1.4),), "severe"),
)


def degraded(grey: np.ndarray, chain, key: str, ops: dict | None = None) -> np.ndarray:
    """The picture after a chain of (operation, value); noise is seeded by the picture's key and its place in the chain."""
    out = grey
    for op, value in chain:
        out = np.clip((ops or OPS)[op](out.astype(np.float64), value, f"{key}:{op}:{value}"), 0, 255).astype(np.uint8)
    return out


def stress_matrix(frames: DataFrame, pixels: str, width: int, keys: list[str], conditions=CONDITIONS, ops: dict | None = None) -> DataFrame:
    """A row for each frame and condition: ``keys``, condition, severity, and the degraded ``pixels``.

    The conditions are a fixed list. A task holds one picture and one of its degraded forms at a time; a picture's key,
    which seeds its noise, is the digest of its bytes.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, v in enumerate(b.column(n).to_pylist()):
                grey = np.asarray(v, np.uint8).reshape(-1, width)
                key = hashlib.sha256(grey.tobytes()).hexdigest()
                outs = [degraded(grey, chain, key, ops).ravel() for _, chain, _ in conditions]
                repeated = [pa.concat_arrays([c.slice(i, 1)] * len(conditions)) for c in b.columns[:n]]
                yield pa.RecordBatch.from_arrays([*repeated, pa.array([c[0] for c in conditions]), pa.array([c[2] for c in conditions]), pa.array(outs, pa.list_(pa.int16()))], names=[*keys, "condition", "severity", pixels])

    picked = frames.select(*keys, pixels)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kinds}, condition string, severity string, {pixels} array<short>")


def incomplete_conditions(frames: DataFrame, built: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(condition, missing): conditions of a stored matrix that lack frames, with how many; those without any included."""
    wanted = frames.select(*keys, F.explode(F.array(*map(F.lit, names))).alias("condition"))
    return wanted.join(built.select(*keys, "condition"), [*keys, "condition"], "left_anti").groupBy("condition").agg(F.count(F.lit(1)).alias("missing"))


def as_grey(values: Column) -> Column:
    """Numbers of an array as grey values from 0 to 255, stretched over its range."""
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda v: F.when(high > low, F.floor(255 * (v - low) / (high - low))).otherwise(F.lit(0)).cast("short"))
