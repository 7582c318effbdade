"""From bytes to vectors: pluggable decoders, samplers and encoders in Arrow batches.

No model and no image codec is part of the library: a decoder or an encoder is a function that the
caller passes. The hash encoder is a deterministic stand-in for tests and dry runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One image: rows, columns, channels and its bytes in that order.
IMAGE = T.StructType([T.StructField("h", T.IntegerType()), T.StructField("w", T.IntegerType()), T.StructField("c", T.IntegerType()), T.StructField("data", T.BinaryType())])


def hash_encoder(dim: int) -> Callable[[list], np.ndarray]:
    """Deterministic unit vectors from the bytes of each input."""
    import hashlib

    def encode(inputs: list) -> np.ndarray:
        out = np.zeros((len(inputs), dim))
        for row, x in enumerate(inputs):
            raw = x.encode() if isinstance(x, str) else bytes(x or b"")
            seed = int.from_bytes(hashlib.sha256(raw).digest()[:8], "big")
            out[row] = np.random.default_rng(seed).standard_normal(dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    return encode


def encode(df: DataFrame, column: str, make_encoder: Callable[[], Callable[[list], np.ndarray]], out: str = "vector") -> DataFrame:
    """``df`` with a vector for every value of ``column``; the encoder is made once per worker and sees whole Arrow batches. Null inputs have a null vector."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            known = batch.notna().to_numpy()
            result = np.full(len(batch), None, dtype=object)
            if known.any():
                for at, v in zip(np.flatnonzero(known), encoder(list(batch[known])), strict=True):
                    result[at] = v.astype(np.float32)
            yield pd.Series(result)

    return df.withColumn(out, udf(F.col(column)))


def decode_images(df: DataFrame, column: str, decoder: Callable[[bytes], np.ndarray], out: str = "image") -> DataFrame:
    """``df`` with decoded images; unreadable bytes give null, not a failed job."""

    @F.pandas_udf(IMAGE)
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for raw in batch:
                try:
                    image = np.ascontiguousarray(decoder(raw), dtype=np.uint8)
                    image = image if image.ndim == 3 else image[:, :, None]
                    rows.append((*image.shape, image.tobytes()))
                except Exception:
                    rows.append((None, None, None, None))
            yield pd.DataFrame(rows, columns=["h", "w", "c", "data"])

    return df.withColumn(out, udf(F.col(column))).withColumn(out, F.when(F.col(f"{out}.h").isNotNull(), F.col(out)))


def _array(image: dict) -> np.ndarray:
    return np.frombuffer(image["data"], dtype=np.uint8).reshape(image["h"], image["w"], image["c"])


def _resize(gray: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area-mean resize of a grey image."""
    r = np.linspace(0, gray.shape[0], rows + 1).astype(int)
    c = np.linspace(0, gray.shape[1], columns + 1).astype(int)
    return np.array([[gray[r[i] : max(r[i + 1], r[i] + 1), c[j] : max(c[j + 1], c[j] + 1)].mean() for j in range(columns)] for i in range(rows)])


def grey_grid(df: DataFrame, image: str, rows: int, columns: int, out: str = "grid") -> DataFrame:
    """``df`` with the image as a row-major grey grid, ready for the hash expressions; null images have none."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def udf(frame: pd.DataFrame) -> pd.Series:
        weights = np.array([0.114, 0.587, 0.299])
        out = []
        for record in frame.to_dict("records"):
            if record["data"] is None or pd.isna(record["h"]):
                out.append(None)
                continue
            a = _array({**record, "h": int(record["h"]), "w": int(record["w"]), "c": int(record["c"])}).astype(float)
            grey = a @ weights if a.shape[2] == 3 else a[:, :, 0]
            out.append(_resize(grey, rows, columns).ravel())
        return pd.Series(out)

    return df.withColumn(out, F.when(F.col(image).isNotNull(), udf(F.col(image))))


def margin_crop(pixels: np.ndarray, tol: float = 10.0) -> tuple[int, int, int, int] | None:
    """``(x, y, w, h)`` of an image without its uniform margins; None if nothing is left.

    A line is uniform if all of its pixels differ from its median colour (cut to whole numbers) by at most ``tol`` summed over channels.
    """

    def uniform(line: np.ndarray) -> bool:
        return bool((np.abs(line.astype(int) - np.median(line, axis=0).astype(int)).sum(axis=1) <= tol).all())

    rows = [i for i in range(pixels.shape[0]) if not uniform(pixels[i])]
    columns = [j for j in range(pixels.shape[1]) if not uniform(pixels[:, j])]
    if not rows or not columns:
        return None
    return columns[0], rows[0], columns[-1] - columns[0] + 1, rows[-1] - rows[0] + 1


def explode_frames(videos: DataFrame, video: str, total: str, every: str) -> DataFrame:
    """``video, frame_no`` of the frames that a sampler keeps: every n-th of each video, from 0."""
    return videos.where(F.col(total) > 0).select(video, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1, F.greatest(F.lit(1), F.col(every)).cast("long"))).alias("frame_no"))


def colour_moments(pixels: np.ndarray) -> np.ndarray:
    """Mean, standard deviation and skewness of each channel."""
    flat = pixels.reshape(-1, pixels.shape[-1]).astype(float)
    mean = flat.mean(axis=0)
    centred = flat - mean
    return np.concatenate([mean, np.sqrt((centred**2).mean(axis=0)), np.cbrt((centred**3).mean(axis=0))])


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity of two grey images: the mean over sliding windows of 11 x 11 pixels with Gaussian weights (sigma 1.5), edges mirrored."""
    from ..operators.quality import C1, C2

    weights = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    weights /= weights.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            padded = np.pad(x, [(5, 5) if i == axis else (0, 0) for i in (0, 1)], mode="reflect")
            x = np.apply_along_axis(lambda line: np.convolve(line, weights, mode="valid"), axis, padded)
        return x

    a, b = a.astype(float), b.astype(float)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float((((2 * ma * mb + C1) * (2 * cov + C2)) / ((ma * ma + mb * mb + C1) * (va + vb + C2))).mean())


def phash(grid: np.ndarray) -> int:
    """Perceptual hash of a 32 x 32 grey grid: signs of the 8 x 8 low frequencies against their mean without the first."""
    k, n = np.arange(32)[:, None], np.arange(32)[None, :]
    basis = np.sqrt(2 / 32) * np.cos(np.pi * (2 * n + 1) * k / 64)
    basis[0] = np.sqrt(1 / 32)
    low = (basis @ grid @ basis.T)[:8, :8].ravel()
    low[0] = 0.0
    return int(sum(1 << int(i) for i in np.flatnonzero(low > low.mean())))
