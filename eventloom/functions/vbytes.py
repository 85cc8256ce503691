"""Variable-byte streams of integers, whole arrays at a time: the signal compression of binary read files."""

from __future__ import annotations

import numpy as np


def zigzag(x: np.ndarray) -> np.ndarray:
    """Signed integers as unsigned ones of the same width, small ones first: 0, -1, 1, -2, ..."""
    bits = x.dtype.itemsize * 8
    return ((x << 1) ^ (x >> (bits - 1))).view(f"u{x.dtype.itemsize}")


def unzigzag(z: np.ndarray) -> np.ndarray:
    one = z.dtype.type(1)
    return ((z >> one) ^ (~(z & one) + one)).view(f"i{z.dtype.itemsize}")


def deltas(x: np.ndarray) -> np.ndarray:
    """Each value less the one before (0 before the first), in the array's own width."""
    return np.diff(x, prepend=x.dtype.type(0))


def summed(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)


def _scattered(values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The low bytes of each value, as many as its size."""
    raw = values.astype(f"<u{values.dtype.itemsize}").view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return raw[np.arange(raw.shape[1]) < sizes[:, None]].tobytes()


def _gathered(data: np.ndarray, sizes: np.ndarray, kind: str) -> np.ndarray:
    """The values whose low bytes lie in data one after the other."""
    width = np.dtype(kind).itemsize
    if int(sizes.sum()) > len(data):
        raise ValueError("a variable-byte stream ends too early")
    raw = np.zeros((len(sizes), width), np.uint8)
    raw[np.arange(width) < sizes[:, None]] = data[: int(sizes.sum())]
    return raw.view(kind).ravel()


def _keys(data: bytes, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n keys of so many bits, lowest bits first, and the bytes behind them."""
    each = 8 // bits
    size = -(-n // each)
    if len(data) < size:
        raise ValueError("a variable-byte stream ends too early")
    raw = np.frombuffer(data, np.uint8)
    keys = (raw[:size, None] >> (np.arange(each, dtype=np.uint8) * bits)) & ((1 << bits) - 1)
    return keys.ravel()[:n].astype(np.int64), raw[size:]


def _key_bytes(keys: np.ndarray, bits: int) -> bytes:
    each = 8 // bits
    padded = np.zeros(-(-len(keys) // each) * each, np.uint8)
    padded[: len(keys)] = keys
    return np.bitwise_or.reduce(padded.reshape(-1, each) << (np.arange(each, dtype=np.uint8) * bits), axis=1).astype(np.uint8).tobytes()


def encode32(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers: two bits for each one's number of bytes (1 to 4), then the bytes."""
    keys = (values > 0xFF).astype(np.int64) + (values > 0xFFFF) + (values > 0xFFFFFF)
    return _key_bytes(keys, 2) + _scattered(values.astype(np.uint32), keys + 1)


def decode32(data: bytes, n: int) -> np.ndarray:
    keys, rest = _keys(data, n, 2)
    return _gathered(rest, keys + 1, "<u4")


def encode16(values: np.ndarray) -> bytes:
    """Unsigned 16-bit integers: a bit for each one's number of bytes (1 or 2), then the bytes."""
    keys = (values > 0xFF).astype(np.int64)
    return _key_bytes(keys, 1) + _scattered(values.astype(np.uint16), keys + 1)


def decode16(data: bytes, n: int) -> np.ndarray:
    keys, rest = _keys(data, n, 1)
    return _gathered(rest, keys + 1, "<u2")
