"""Content-defined chunks, int8 residuals, polar quantisation, zstd, text embeddings."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MASK64 = (1 << 64) - 1


@cache
def gear_table() -> np.ndarray:
    """256 values of a xorshift generator (13, 7, 17) started at 42."""
    out, state = [], 42
    for _ in range(256):
        for shift in (13, -7, 17):
            state ^= (state << shift if shift > 0 else state >> -shift) & MASK64
        out.append(state)
    return np.array(out, np.uint64)


def content_chunks(data: bytes, least: int, average: int, most: int) -> list[tuple[int, int]]:
    """(offset, length) of content-defined chunks.

    The low ``bits`` of the rolling hash depend on the last ``bits`` bytes only, so the hash of every
    full window is one convolution over the whole payload; cuts are then found by search. Just the first
    ``bits`` positions of a chunk, whose hash has seen fewer bytes, are computed one by one.
    """
    if not least < average < most:
        raise ValueError("sizes must rise")
    if not data:
        return [(0, 0)]
    bits = average.bit_length() - 1
    mask = (1 << bits) - 1
    gear = (gear_table() & np.uint64(mask)).astype(np.int64)[np.frombuffer(data, np.uint8)]
    rolled = np.zeros(len(data), np.int64)
    for k in range(min(bits, len(data))):
        rolled[k:] += gear[: len(data) - k] << k
    candidates = np.flatnonzero(rolled & mask == 0)
    out, start = [], 0
    while start < len(data):
        begin, end, seen, cut = start + least, min(start + most, len(data)), 0, None
        for i in range(begin, min(begin + bits, end)):
            seen = (seen << 1) + int(gear[i]) & mask
            if seen == 0:
                cut = i + 1
                break
        if cut is None:
            at = int(np.searchsorted(candidates, begin + bits))
            cut = int(candidates[at]) + 1 if at < len(candidates) and candidates[at] < end else end
        out.append((start, cut - start))
        start = cut
    return out


def fastcdc(df: DataFrame, key: str, payload: str, least: int = 16 << 10, average: int = 64 << 10, most: int = 256 << 10) -> DataFrame:
    """(key, ordinal, chunk_offset, chunk_length, fingerprint) of content-defined chunks; payload is text or binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch["key"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                for i, (at, size) in enumerate(content_chunks(data, least, average, most)):
                    rows.append((k, i, at, size, "sha256:" + hashlib.sha256(data[at : at + size]).hexdigest()))
            if rows:
                types = [batch.schema.field("key").type, pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["key", "ordinal", "chunk_offset", "chunk_length", "fingerprint"])

    kind = dict(df.dtypes)[key]
    source = df.where(F.col(payload).isNotNull()).select(F.col(key).alias("key"), F.col(payload).cast("binary").alias("payload"))
    return source.mapInArrow(run, f"key {kind}, ordinal int, chunk_offset long, chunk_length long, fingerprint string").withColumnRenamed("key", key)


def int8_residual(v: Column) -> Column:
    """struct(centroid, scale, q): mean, step and half-even rounded residuals within +-127."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e) / F.size(x)
    let = lambda value, body: F.transform(F.array(value), body)[0]

    def coded(s: Column) -> Column:
        rest = F.transform(s["v"], lambda x: x - s["m"])
        top = F.array_max(F.transform(rest, lambda r: F.abs(r)))
        scale = let(top, lambda t: F.when(t > 1e-10, t / 127.0).otherwise(1.0))
        return let(
            F.struct(rest.alias("rest"), scale.alias("scale")),
            lambda c: F.struct(s["m"].alias("centroid"), c["scale"].alias("scale"), F.transform(c["rest"], lambda r: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(r / c["scale"]))).cast("int")).alias("q")),
        )

    return let(F.struct(v.alias("v"), mean(v).alias("m")), coded)


def int8_restore(coded: Column) -> Column:
    return F.transform(coded["q"], lambda q: q * coded["scale"] + coded["centroid"])


def polar_encode(x: np.ndarray, norm_scale: float = 16.0) -> tuple[np.ndarray, np.ndarray]:
    """(norm byte, angle bytes) per row: log-scale norm, hyperspherical angles in 256 steps. All rows at once."""
    n, d = x.shape
    norm = np.sqrt((x * x).sum(axis=1))
    with np.errstate(divide="ignore"):
        byte = np.where((norm > 0) & np.isfinite(norm), np.clip(np.rint(np.log2(np.where(norm > 0, norm, 1)) * norm_scale + 128), 0, 255), 0)
    if d == 1:
        return byte.astype(np.uint8), np.where(x >= 0, 0, 128).astype(np.uint8)
    unit = x / np.where(norm > 1e-30, norm, 1)[:, None]
    left = np.maximum(1.0 - np.concatenate([np.zeros((n, 1)), np.cumsum(unit * unit, axis=1)[:, : d - 2]], axis=1), 0)
    radius = np.sqrt(left)
    cosine = np.where(radius > 1e-15, unit[:, : d - 1] / np.where(radius > 1e-15, radius, 1), 0)
    angle = np.arccos(np.clip(cosine, -1, 1))
    angle[:, -1] = np.where(unit[:, -1] < 0, 2 * math.pi - angle[:, -1], angle[:, -1])
    return byte.astype(np.uint8), (np.rint(angle / (2 * math.pi) * 256).astype(np.int64) % 256).astype(np.uint8)


def polar_decode(norm: np.ndarray, angles: np.ndarray, norm_scale: float = 16.0) -> np.ndarray:
    size = 2.0 ** ((norm.astype(float) - 128) / norm_scale)
    theta = angles * (2 * math.pi / 256)
    sines = np.cumprod(np.sin(theta), axis=1)
    before = np.concatenate([np.ones((len(size), 1)), sines[:, :-1]], axis=1)
    return size[:, None] * np.concatenate([before * np.cos(theta), sines[:, -1:]], axis=1)


def polar_quantise(df: DataFrame, key: str, v: str) -> DataFrame:
    """(key, norm_q8, angles, relative_error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch["v"].to_pylist(), float)
                norm, angles = polar_encode(x)
                error = np.sqrt(((polar_decode(norm, angles) - x) ** 2).sum(axis=1)) / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)
                yield pa.RecordBatch.from_arrays([batch["key"], pa.array(norm.astype(np.int32)), pa.array([a.tobytes() for a in angles], pa.binary()), pa.array(error)], names=["key", "norm_q8", "angles", "relative_error"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(v).alias("v")).mapInArrow(run, f"key {kind}, norm_q8 int, angles binary, relative_error double").withColumnRenamed("key", key)


def zstd_sizes(df: DataFrame, key: str, text: str, level: int = 3) -> DataFrame:
    """(key, raw_bytes, stored_bytes, intact): each payload through zstd and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack, unpack = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
        for batch in batches:
            data = batch["data"].to_pylist()
            stored = [pack.compress(d) for d in data]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], pa.array(list(map(len, data)), pa.int64()), pa.array(list(map(len, stored)), pa.int64()), pa.array([unpack.decompress(s) == d for s, d in zip(stored, data, strict=True)], pa.bool_())],
                names=["key", "raw_bytes", "stored_bytes", "intact"],
            )

    kind = dict(df.dtypes)[key]
    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("binary").alias("data")).mapInArrow(run, f"key {kind}, raw_bytes long, stored_bytes long, intact boolean").withColumnRenamed("key", key)


# A token's vector is normal noise, drawn by the legacy generator from a seed of 31 bits of its digest.
DIGEST_BYTES, SEED_MASK = 8, 0x7FFFFFFF
#: Token vectors that a worker remembers.
TOKENS_KEPT = 50_000


def token_vector(token: str, dims: int) -> np.ndarray:
    digest = hashlib.blake2b(token.encode(), digest_size=DIGEST_BYTES).digest()
    return np.random.RandomState(int.from_bytes(digest, "little") & SEED_MASK).normal(size=dims).astype(np.float32)


def text_embedding(text: str, dims: int, known: dict | None = None) -> np.ndarray:
    """Unit vector along the sum of the token vectors, each as often as its token occurs: one product of counts and vectors."""
    known = {} if known is None else known
    counts = Counter(text.lower().split())
    if not counts:
        return np.zeros(dims, np.float32)
    vectors = np.stack([known.get(token) if token in known else token_vector(token, dims) for token in counts])
    for token, vector in zip(counts, vectors, strict=True):
        if len(known) < TOKENS_KEPT:
            known.setdefault(token, vector)
    along = np.array(list(counts.values()), np.float32) @ vectors
    size = np.linalg.norm(along)
    return along / size if size > 0 else along


def embed_texts(df: DataFrame, key: str, text: str, dims: int = 32) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            vectors = [text_embedding(x or "", dims, known).tolist() for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(vectors, pa.list_(pa.float32()))], names=["key", "embedding"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, embedding array<float>").withColumnRenamed("key", key)
