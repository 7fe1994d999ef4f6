"""Media columns: payloads stored as baseline JPEG, read back as DC-only luminance thumbnails.

A payload becomes a greyscale picture whose every 8 x 8 block is flat: one sample a block, WIDTH blocks
a row. Its DC coefficient, with a quantiser step of 8, is the sample less 128, so nothing is lost,
and the thumbnail that a decoder makes of the DC coefficients alone, an eighth of the size, is the
payload. A row is one restart interval: the DC prediction starts anew and the scan is byte aligned,
so numpy decodes all rows of many pictures in step. More than ROWS rows go to further pictures,
stored one after the other. The Huffman table gives every block a whole number of bytes, so what recurs
in a text recurs in its picture, and the table's own compression finds it.

``thumbnail`` decodes any baseline picture, block by block: any Huffman and quantiser tables, colour with
subsampling (the first component is the luminance), AC codes, any restart interval. What isn't baseline,
is damaged or doesn't give the checksum that the writer noted raises an error.

Defined cases: a null text is an empty one; an empty payload is one padding unit; equal texts give
equal bytes; a very long text becomes several pictures; other columns of the input, whatever their names, don't
take part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlore.llm.common import small_batches

UNIT, WIDTH, ROWS = 576, 576, 8184  # bytes of padding unit, samples of a row, most rows of a picture
#: Payload bytes that are coded in one numpy call.
BLOCK = 1 << 20

# Fixed values of this writer's Huffman tables: code lengths of the DC categories 0 to 8 (category k has k
# further bits and end-of-block has one, so each block is 8, 16 or 24 bits), and the AC symbol end-of-block.
DC_LENGTHS = [7, 6, 5, 4, 3, 2, 1, 8, 15]
AC_COUNTS = [1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0]
AC_SYMBOLS = [0]
DC_COUNTS = [DC_LENGTHS.count(n) for n in range(1, 17)]
DC_SYMBOLS = sorted(range(len(DC_LENGTHS)), key=DC_LENGTHS.__getitem__)

MEDIA = "doc_id long, media binary"
FEATURES = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string, width int, height int"
)


def huffman(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, bits)."""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


@cache
def _coder() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference, at difference + 255: the bits of its block, and how many bytes."""
    dc, (end, end_bits) = huffman(DC_COUNTS, DC_SYMBOLS), huffman(AC_COUNTS, AC_SYMBOLS)[0]
    value, length = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, bits = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size | extra) << end_bits) | end
        length[d + 255] = (bits + size + end_bits) // 8
    return value, length


@cache
def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits ahead: the symbol that they begin with, and the bits of its code (0: none)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, bits) in huffman(list(table[:16]), list(table[16:])).items():
        span = slice(code << (16 - bits), (code + 1) << (16 - bits))
        symbol[span], length[span] = s, bits
    return symbol, length


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def header(rows: int, comment: bytes) -> bytes:
    """Everything before the scan of a picture of ``rows`` x WIDTH flat blocks."""
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xFE, comment),
            _segment(0xDB, bytes([0]) + bytes([8] * 64)),
            _segment(0xC0, bytes([8]) + (8 * rows).to_bytes(2, "big") + (8 * WIDTH).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
            _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_SYMBOLS])),
            _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_SYMBOLS])),
            _segment(0xDD, WIDTH.to_bytes(2, "big")),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode(texts: list[bytes]) -> list[bytes]:
    """The stored form of each text."""
    padded = [t + b"\xff" * (max(1, -(-len(t) // UNIT)) * UNIT - len(t)) for t in texts]
    sample = np.frombuffer(b"".join(padded), np.uint8).reshape(-1, WIDTH).astype(np.int64)
    value, length = _coder()
    diff = np.diff(sample - 128, axis=1, prepend=0) + 255
    n, word = length[diff].ravel(), value[diff].ravel()
    at = np.cumsum(n) - n
    coded = np.empty(int(n.sum()), np.uint8)
    for k in range(3):
        has = n > k
        coded[at[has] + k] = word[has] >> (8 * (n[has] - 1 - k)) & 255
    # byte stuffing, and two bytes for a marker after each row
    size = n.reshape(-1, WIDTH).sum(axis=1)
    row_of = np.repeat(np.arange(len(size)), size)
    full = coded == 255
    place = np.arange(len(coded)) + np.cumsum(full) - full + 2 * row_of
    stream = np.zeros(len(coded) + int(full.sum()) + 2 * len(size), np.uint8)
    stream[place] = coded
    after = np.cumsum(size + np.bincount(row_of, full, len(size)).astype(np.int64) + 2)
    stream[after - 2] = 255
    counts = [len(p) // WIDTH for p in padded]
    number = np.arange(len(size)) - np.repeat(np.cumsum(counts) - counts, counts)
    last = np.zeros(len(size), bool)
    last[np.cumsum(counts) - 1] = True
    stream[after - 1] = np.where(last | (number % ROWS == ROWS - 1), 0xD9, 0xD0 + number % ROWS % 8)
    out, begin, row = [], 0, 0
    raw = stream.tobytes()
    for text, payload, rows in zip(texts, padded, counts, strict=True):
        pictures, note = [], b"n_bytes=%d crc32=%d" % (len(text), zlib.crc32(payload))
        for r in range(0, rows, ROWS):
            here = min(ROWS, rows - r)
            end = int(after[row + here - 1])
            pictures += [header(here, note), raw[begin:end]]
            begin, row = end, row + here
        out.append(b"".join(pictures))
    return out


@dataclass
class Picture:
    """What the markers of one baseline picture say; ``scan`` is its entropy-coded part."""

    note: bytes = b""
    height: int = 0
    width: int = 0
    interval: int = 0
    quantiser: dict[int, int] = field(default_factory=dict)  # step of the DC coefficient
    tables: dict[int, bytes] = field(default_factory=dict)
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    chosen: list[tuple[int, int, int]] = field(default_factory=list)  # id, DC table, AC table
    scan: bytes = b""

    @property
    def kind(self) -> tuple | None:
        """Pictures of one kind are decoded in step: one component, a restart interval a row, the same tables."""
        blocks = -(-self.width // 8)
        if len(self.components) != 1 or self.interval != blocks or self.quantiser[self.components[0][3]] % 8 or self.components[0][1:3] != (1, 1):
            return None
        return blocks, self.tables[self.chosen[0][1]], self.tables[0x10 | self.chosen[0][2]], self.quantiser[self.components[0][3]] // 8

    @property
    def shape(self) -> tuple[int, int]:
        return -(-self.height // 8), -(-self.width // 8)


def parse(media: bytes) -> list[Picture]:
    """The pictures of a stored form."""
    at, out = 0, []
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, p = at + 2, Picture()
        while True:
            if at + 4 > len(media) or media[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xFE:
                p.note = body
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    p.quantiser[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                if body[0] != 8:
                    raise ValueError("samples aren't 8 bits")
                p.height, p.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                p.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    p.tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                p.interval = int.from_bytes(body, "big")
            elif marker == 0xDA:
                p.chosen = [(body[i], body[i + 1] >> 4, body[i + 1] & 15) for i in range(1, 1 + 2 * body[0], 2)]
                break
            elif marker >= 0xC1 and marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("not a baseline picture")
        if not p.components or [c[0] for c in p.components] != [c[0] for c in p.chosen]:
            raise ValueError("not one scan of all components")
        end = media.find(b"\xff\xd9", at)  # a scan has no other marker than restarts
        if end < 0:
            raise ValueError("no end of image")
        p.scan, at = media[at:end], end + 2
        out.append(p)
    return out


def _intervals(scan: bytes) -> list[bytes]:
    """The parts between restart markers, without stuffed zeros."""
    out, begin = [], 0
    at = scan.find(b"\xff")
    while at >= 0:
        if at + 1 < len(scan) and scan[at + 1]:
            if scan[at + 1] != 0xD0 + len(out) % 8:
                raise ValueError("restart markers out of order")
            out.append(scan[begin:at])
            begin = at + 2
        at = scan.find(b"\xff", at + 2)
    return [part.replace(b"\xff\x00", b"\xff") for part in [*out, scan[begin:]]]


def thumbnail(p: Picture) -> np.ndarray:
    """One luminance sample a block, from the DC coefficients alone; AC codes are read and skipped."""
    most_h, most_v = max(c[1] for c in p.components), max(c[2] for c in p.components)
    alone = len(p.components) == 1  # a scan of one component has a block a unit, whatever its factors say
    across, down = (p.shape[1], p.shape[0]) if alone else (-(-p.width // (8 * most_h)), -(-p.height // (8 * most_v)))
    _, h, v, q = p.components[0]
    h, v = (1, 1) if alone else (h, v)
    step, out = p.quantiser[q], np.zeros((down * v, across * h), np.int64)
    order = [(k, x, y) for k, c in enumerate(p.components) for y in range(1 if alone else c[2]) for x in range(1 if alone else c[1])]
    tables = [(_lookup(p.tables[dc]), _lookup(p.tables[0x10 | ac])) for _, dc, ac in p.chosen]
    units, every = across * down, p.interval or across * down
    parts = _intervals(p.scan)
    if len(parts) != -(-units // every):
        raise ValueError("rows are missing")
    for i, part in enumerate(parts):
        bits, pos, value = int.from_bytes(part + b"\xff" * 8, "big"), 0, [0] * len(p.components)
        room = 8 * len(part) + 64

        def ahead(n: int) -> int:
            return bits >> (room - pos - n) & ((1 << n) - 1)  # noqa: B023

        for unit in range(i * every, min(units, (i + 1) * every)):
            for k, x, y in order:
                (dc, dc_bits), (ac, ac_bits) = tables[k]
                seen, coefficient = ahead(16), 1
                size, used = int(dc[seen]), int(dc_bits[seen])
                pos += used
                extra = ahead(size) if size else 0
                value[k] += extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                pos += size
                while coefficient < 64 and used:
                    seen = ahead(16)
                    symbol, used = int(ac[seen]), int(ac_bits[seen])
                    pos += used + (symbol & 15)
                    coefficient = 64 if symbol == 0 else coefficient + (symbol >> 4) + 1
                if not used or pos > 8 * len(part) or coefficient > 64 and symbol:
                    raise ValueError("a damaged scan")
                if k == 0:
                    out[unit // across * v + y, unit % across * h + x] = value[0]
    rows, columns = p.shape if h == most_h and v == most_v or alone else out.shape
    return np.clip((out * step + 4) // 8 + 128, 0, 255).astype(np.uint8)[:rows, :columns]


def _in_step(pictures: list[Picture]) -> np.ndarray | None:
    """The thumbnails of pictures of one kind, one below the other; None if a block isn't flat."""
    width, dc, ac, step = pictures[0].kind
    (symbol, bits), (end, end_bits) = _lookup(dc), _lookup(ac)
    raw = np.frombuffer(b"".join(p.scan + b"\xff\xd9" for p in pictures) + bytes(4), np.uint8)
    lead = np.flatnonzero(raw[:-1] == 255)
    follow = raw[lead + 1]
    keep = np.ones(len(raw), bool)
    keep[lead + 1] = False  # a stuffed zero, or a marker's second byte
    marks = lead[follow != 0]
    keep[marks] = False
    kept = np.cumsum(keep)
    scan = np.concatenate([raw[keep].astype(np.int64), np.zeros(5, np.int64)])
    ahead = scan[:-4] << 32 | scan[1:-3] << 24 | scan[2:-2] << 16 | scan[3:-1] << 8 | scan[4:]
    pos = np.concatenate([[0], kept[marks[:-1] + 1]]) << 3
    stop = kept[marks] << 3
    wanted = np.concatenate([np.append(0xD0 + np.arange(p.shape[0] - 1) % 8, 0xD9) for p in pictures])
    if not np.array_equal(follow[follow != 0], wanted):
        raise ValueError("rows are missing")
    out, value = np.empty((len(pos), width), np.uint8), np.zeros(len(pos), np.int64)
    for column in range(width):
        if (pos >= stop).any():
            raise ValueError("a damaged scan")
        window = ahead[pos >> 3] >> (8 - (pos & 7)) & 0xFFFFFFFF
        size, used = symbol[window >> 16], bits[window >> 16]
        extra = window >> (32 - used - size) & ((1 << size) - 1)
        value += np.where(extra >> np.maximum(size - 1, 0) > 0, extra, extra - (1 << size) + 1)
        # the 16 bits after the difference begin with end-of-block
        tail = (window << (used + size) & 0xFFFFFFFF) >> 16
        if not used.all() or (used + size > 31).any() or not ((end[tail] == 0) & (end_bits[tail] == 1)).all():
            return None
        pos += used + size + 1
        out[:, column] = np.clip(value * step + 128, 0, 255)
    if (-pos % 8 + pos != stop).any():
        raise ValueError("a damaged scan")
    return out


def decode(media: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(n_bytes, thumbnail) of each stored form; flat pictures that share their tables are decoded in step."""
    parsed = [parse(m) for m in media]
    kinds: dict[tuple, list[Picture]] = {}
    for p in (p for pictures in parsed for p in pictures):
        if p.kind:
            kinds.setdefault(p.kind, []).append(p)
    done: dict[int, np.ndarray] = {}
    for pictures in kinds.values():
        rows = _in_step(pictures)
        if rows is not None:
            ends = np.cumsum([p.shape[0] for p in pictures])
            done |= {id(p): t for p, t in zip(pictures, np.split(rows, ends[:-1]), strict=True)}
    out = []
    for pictures in parsed:
        whole = np.concatenate([done[id(p)] if id(p) in done else thumbnail(p) for p in pictures])
        note = dict(x.split(b"=", 1) for x in pictures[0].note.split() if b"=" in x)
        if b"crc32" in note and int(note[b"crc32"]) != zlib.crc32(whole.tobytes()):
            raise ValueError("the thumbnail isn't what was stored")
        out.append((int(note.get(b"n_bytes", whole.size)), whole))
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: is one of 64 equal runs of the thumbnail's samples brighter than the picture?"""
    cells = thumbnail.reshape(64, -1).sum(axis=1, dtype=np.int64)
    return np.packbits(cells * 64 > cells.sum()).tobytes().hex()


def _groups(items: list[bytes]) -> Iterator[list[int]]:
    group, size = [], 0
    for i, x in enumerate(items):
        if group and size + len(x) > BLOCK:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(x)
    if group:
        yield group


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id and the media column. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()]
            for group in _groups(texts):
                media = encode([texts[i] for i in group])
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(group)), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests, dimensions and thumbnail hash, all from the stored bytes. No shuffle."""
    small_batches(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        for batch in batches:
            media, ids = batch["media"].to_pylist(), batch["doc_id"].to_pylist()
            for group in _groups(media):
                rows = []
                for i, (n_bytes, thumbnail) in zip(group, decode([media[i] for i in group]), strict=True):
                    payload, (height, width) = thumbnail.tobytes(), thumbnail.shape
                    rows.append(
                        (ids[i], n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(),
                         f"{8 * width}x{8 * height}:{average_hash(thumbnail)}", 8 * width, 8 * height)
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in FEATURES.split(", ")])

    return stored.mapInArrow(run, FEATURES)
