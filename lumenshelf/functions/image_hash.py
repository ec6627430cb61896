"""Perceptual hashes of decoded images (I1): 16 x 16 blocks, 64 hexadecimal digits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BITS = 16


def _spread(size: int, bits: int) -> np.ndarray:
    """bits x size matrix: how much of each line of pixels falls to each block; a line on an edge is shared."""
    out = np.zeros((bits, size))
    at = np.arange(size)
    if size % bits == 0:
        out[at // (size // bits), at] = 1
        return out
    block = size / bits
    rest = (at + 1) % block
    part = rest - np.floor(rest)
    inside = (np.floor(rest) > 0) | (at + 1 == size)
    first, last = np.floor(at / block).astype(int), np.ceil(at / block).astype(int)
    np.add.at(out, (first, at), np.where(inside, 1.0, 1 - part))
    edge = ~inside & (last < bits)
    np.add.at(out, (last[edge], at[edge]), part[edge])
    return out


def block_hash(rgba: bytes, width: int, height: int, bits: int = BITS, quick: bool = False) -> str | None:
    """``quick`` cuts the image to a multiple of the block size instead of sharing lines. Null if the size doesn't fit the pixels."""
    if not rgba or width < 1 or height < 1 or len(rgba) != width * height * 4:
        return None
    pixels = np.frombuffer(rgba, np.uint8).reshape(height, width, 4)
    light = np.where(pixels[..., 3] == 0, 765, pixels[..., :3].sum(-1, dtype=np.int64)).astype(float)
    if quick:
        light = light[: height // bits * bits, : width // bits * bits]
        if not light.size:
            return None
    blocks = (_spread(light.shape[0], bits) @ light @ _spread(light.shape[1], bits).T).reshape(4, -1)
    ordered, half = np.sort(blocks, axis=1), blocks.shape[1] // 2
    # the middle of an even band: the two values after the true middle's first
    middle = ((ordered[:, half] + ordered[:, half + 1]) / 2)[:, None]
    bright = light.shape[0] / bits * light.shape[1] / bits * 256 * 3 / 2
    on = (blocks > middle) | ((np.abs(blocks - middle) < 1) & (middle > bright))
    return np.packbits(on.ravel()).tobytes().hex()


def _hash(quick: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(1, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([block_hash(p, w or 0, h or 0, quick=quick) for w, h, p in zip(*cols, strict=True)], pa.string())], names=["hash", "phash"])

    return run


def image_hashes(images: DataFrame, quick: bool = False) -> DataFrame:
    """(hash, phash) of images (hash, width, height, rgba)."""
    return images.select("hash", "width", "height", "rgba").mapInArrow(_hash(quick), "hash string, phash string")
