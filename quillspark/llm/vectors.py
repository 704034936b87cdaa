"""Vectorised hashing of words and byte spans, and packed columns for exchanges of many small numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256)), np.uint64)
_pow = np.ones(1, U)
_inv = np.ones(1, U)


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(1 << 12, 1 << int(n).bit_length())
        steps = np.full(size, _BASE, U)
        back = np.full(size, pow(_BASE, -1, 1 << 64), U)
        steps[0] = back[0] = 1
        _pow, _inv = np.cumprod(steps), np.cumprod(back)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolling(a: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each `width` neighbouring bytes along the last axis, which bring equal bytes together; unequal ones may
    meet too, so what they decide is compared otherwise."""
    n = a.shape[-1]
    _powers(n)
    p = np.zeros((*a.shape[:-1], n + 1), U)
    np.cumsum(_TABLE[a] * _pow[:n], axis=-1, out=p[..., 1:])
    return mix((p[..., width:] - p[..., : n + 1 - width]) * _inv[: n + 1 - width])


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words: 8 bytes of the BLAKE2b digest, made once a distinct word. No word can be solved for that hashes
    like another; by chance a billion different words hold such a pair in three of a hundred cases."""
    if not words:
        return np.zeros(0, U)
    at: dict[bytes, int] = {}
    place = np.fromiter([at.setdefault(w, len(at)) for w in words], np.int64, len(words))
    return np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8).digest() for w in at]), U)[place]


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tokens(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Hashes of the words of some texts, computed together."""
    flat = hash_words([w for words in texts for w in words])
    return np.split(flat, np.cumsum([len(words) for words in texts])[:-1]) if texts else []


def shingles(texts: list[list[bytes]], width: int = 5) -> list[np.ndarray]:
    """Of each text, sorted distinct hashes of its word shingles; fewer words are one shingle, none are an empty set."""
    h = hash_words([w for words in texts for w in words])
    n = max(len(h) - width + 1, 0)
    _powers(width + 1)
    acc = np.zeros(n, U)
    for j in range(width):
        acc += h[j : n + j] * _pow[j + 1]
    acc = mix(acc + U(width))  # those across two texts are left out
    out, at = [], 0
    for words in texts:
        to = at + len(words)
        if len(words) >= width:
            x = np.sort(acc[at : to - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif words:
            out.append(mix(np.array([np.sum(h[at:to] * _pow[1 : len(words) + 1], dtype=U) + U(len(words))], U)))
        else:
            out.append(np.zeros(0, U))
        at = to
    return out


def slices_of(batch: pa.RecordBatch, step: int = 128):
    """A batch's columns as lists, some rows at a time."""
    for i in range(0, batch.num_rows, step):
        yield [c.to_pylist() for c in batch.slice(i, step).columns]


def rows_of(batch: pa.RecordBatch, step: int = 256):
    """A batch's rows as tuples, a few hundred at a time as Python objects."""
    for i in range(0, batch.num_rows, step):
        yield from zip(*(c.to_pylist() for c in batch.slice(i, step).columns))


def pack(x: np.ndarray) -> bytes:
    """Numbers as bytes: byte planes side by side, compressed; little when high bytes are alike."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros(0, np.uint8)
    raw = np.ascontiguousarray(planes).tobytes()
    return len(x).to_bytes(4, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:4], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[4:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(unpack(b, dtype), dtype=dtype)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets that rise with the key."""
    return (((keys >> U(32)) * U(buckets)) >> U(32)).astype(np.int64)
