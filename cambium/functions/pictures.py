"""Pictures as raw arrays: control images and perceptual hashes. A picture is a struct of height, width, channels and data (a byte each). Decoding files needs an optional library."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PICTURE = T.StructType([T.StructField(n, T.IntegerType()) for n in ("height", "width", "channels")] + [T.StructField("data", T.BinaryType())])


def _array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def pixel_shuffle(seed_is: int):
    """A column function: the same pixels in another order, by seed_is and the row's own seed."""

    @F.pandas_udf(PICTURE)
    def run(pictures: pd.DataFrame, seeds: pd.Series) -> pd.DataFrame:
        out = pictures.copy()
        data = []
        for (h, w, c, d), seed in zip(pictures[["height", "width", "channels", "data"]].itertuples(index=False), seeds, strict=True):
            pixels = _array(h, w, c, d).reshape(h * w, c)
            data.append(pixels[np.random.default_rng([seed_is, int(seed)]).permutation(h * w)].tobytes())
        out["data"] = data
        return out

    return run


@F.pandas_udf(PICTURE)
def uniform_gray(pictures: pd.DataFrame) -> pd.DataFrame:
    """A gray picture of the same size."""
    out = pictures.copy()
    out["data"] = [bytes([128]) * (h * w * c) for h, w, c in pictures[["height", "width", "channels"]].itertuples(index=False)]
    return out


def _resized(gray: np.ndarray, n: int = 32) -> np.ndarray:
    """Means of equal areas, each edge pixel by its share."""
    for axis in (0, 1):
        size = gray.shape[axis]
        weight = np.maximum(0, np.minimum(np.arange(1, size + 1)[None], (np.arange(1, n + 1) * size / n)[:, None]) - np.maximum(np.arange(size)[None], (np.arange(n) * size / n)[:, None]))
        gray = np.tensordot(weight / weight.sum(1, keepdims=True), gray, (1, axis))
        gray = np.moveaxis(gray, 0, axis)
    return gray


@F.pandas_udf(T.LongType())
def perceptual_code(pictures: pd.DataFrame) -> pd.Series:
    """The 64-bit hash of a picture as a signed long."""
    from cambium.operators.duplicates import perceptual_hash

    def one(h: int, w: int, c: int, d: bytes) -> int:
        code = perceptual_hash(_resized(_array(h, w, c, d).mean(axis=2)))
        return code - 2**64 if code >= 2**63 else code

    return pd.Series([one(*p) for p in pictures[["height", "width", "channels", "data"]].itertuples(index=False)])


def decoder():
    """A column function from an image file's bytes to a picture; an error where the library isn't there."""
    try:
        from PIL import Image, ImageOps
    except ImportError as error:
        raise RuntimeError("decoding images needs Pillow") from error
    import io

    @F.pandas_udf(PICTURE)
    def run(files: pd.Series) -> pd.DataFrame:
        out = []
        for f in files:
            own = np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(f))).convert("RGB"))
            out.append((*own.shape, own.tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "channels", "data"])

    return run
