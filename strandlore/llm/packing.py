"""Cost-balanced packing of tokenised documents into sequences.

A document's ids (its tokens, then EOS) are cut at multiples of the sequence length; full pieces are
sequences of their own, and the rest, its tail, is packed. Tails are dealt by hash into buckets of a
bounded number of documents, and each bucket is packed by itself: in descending order of length a
tail goes to the sequence of lowest estimated cost (linear plus quadratic in the lengths of its
pieces, as attention has it) among those with room for it. A tail that fits nowhere whole is cut.
The capacities of a bucket's sequences add up to its ids exactly: full sequences, then the powers of
two of the remainder, so nothing is padded.

Defined cases: a null or empty text has the one id EOS; equal rows are packed by themselves, in any buckets;
a very long text gives full pieces as soon as it is tokenised; only doc_id and the text are read, whatever other columns
are called; an empty table gives an empty table. The tokenizer file is a parameter, read by the executors.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlore.llm.common import small_batches

SEQUENCE, EOS = 2048, 1
#: Documents of a bucket; the ids in flight in one packing call are at most this times SEQUENCE.
BUCKET_DOCS = 1024
#: Words that a worker remembers, and the longest word it remembers; a worker outlives its stage, and each of an executor's cores has one.
WORDS_KEPT, WORD_CHARS = 340_000, 48
NO_LETTERS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalpha())
#: Cost of a piece of n ids: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

PIECES = "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, ids binary, nth long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, by text between blanks.

    The tokenizer never joins what white space separates, so a text's ids are those of its parts;
    most parts recur, so most texts cost one dictionary look-up a word. A part of letters and closing
    ASCII marks or digits takes the ids of the two, which the tokenizer separates as well.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.path, self.tokenizer = path, Tokenizer.from_file(path)

    def __missing__(self, part: str) -> bytes:
        stem = part.rstrip(NO_LETTERS)
        if stem != part and stem.isalpha():
            ids = self[stem] + self[part[len(stem) :]]
        else:
            ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        if len(self) < WORDS_KEPT and len(part) <= WORD_CHARS:
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self._parts(text)))

    @staticmethod
    def _parts(text: str) -> list[str]:
        # case folding before the look-up merges entries; where it could differ from the tokenizer's own, it is left to that
        if "<|" not in text and "Σ" not in text and "İ" not in text:
            text = text.lower()
        return text.replace("\n", " ").split(" ")


_words: WordIds | None = None


def _encoder(path: str) -> WordIds:
    import os

    global _words
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if _words is None or _words.path != path:
        _words = WordIds(path)
    return _words


def tokenise(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, eos: int = EOS) -> DataFrame:
    """Pieces of every document: full ones as their CRC, the tail with its ids, and the row's number in its partition,
    which spreads rows that repeat one doc_id. No shuffle."""
    small_batches(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end, step = _encoder(tokenizer), np.array([eos], "<u4").tobytes(), 4 * sequence
        nth = 0
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), (words.encode(t or "") for t in batch["text"].to_pylist()), strict=True):
                ids += end
                nth += 1
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    full = len(part) == step
                    row = (doc_id, len(ids) // 4, at // 4, len(part) // 4, zlib.crc32(part), None if full else part, nth)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES)


def capacities(total: int, sequence: int) -> list[int]:
    """Sequence lengths that add up to ``total``: full ones, then falling powers of two."""
    rest = total % sequence
    return [sequence] * (total // sequence) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def balance(lengths: list[int], sequence: int = SEQUENCE) -> list[list[tuple[int, int, int, int]]]:
    """For each tail, longest first, its pieces as (start in it, length, sequence, offset)."""
    whole = np.array(capacities(sum(lengths), sequence), dtype=np.int64)
    room, cost = whole.copy(), np.zeros(len(whole))
    out = []
    for n in lengths:
        placed, at = [], 0
        while at < n:
            open_to = room >= n - at
            if not open_to.any():
                open_to = room > 0
            k = int(np.where(open_to, cost, np.inf).argmin())
            size = min(int(room[k]), n - at)
            placed.append((at, size, k, int(whole[k] - room[k])))
            room[k] -= size
            cost[k] += LINEAR * size + QUADRATIC * size * size
            at += size
        out.append(placed)
    return out


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, eos: int = EOS, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Every id of every document in one piece of one sequence."""
    buckets = max(1, math.ceil(docs.count() / bucket_docs))
    pieces = tokenise(docs, tokenizer, sequence, eos).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "nth"), F.lit(buckets))).drop("nth")

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        base = int(key[0]) << 32
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        full, tails = rows[rows["ids"].isna()], rows[rows["ids"].notna()]
        out = full[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].assign(sequence_id=base + np.arange(len(full)), offset=0)
        base += len(full)
        cut = []
        for (doc_id, tokens, start, ids), parts in zip(
            zip(tails["doc_id"], tails["doc_tokens"], tails["start"], tails["ids"], strict=True), balance(tails["length"].tolist(), sequence), strict=True
        ):
            for at, size, k, offset in parts:
                cut.append((doc_id, start + at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), tokens, base + k, offset))
        return pd.concat([out, pd.DataFrame(cut, columns=out.columns)]) if cut else out

    return pieces.groupBy("bucket").applyInPandas(packed, PACKED)
