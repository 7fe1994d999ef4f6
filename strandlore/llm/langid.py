"""Language identification by compression.

Each language's model is text of that language, used as a zstandard raw-content dictionary. A text is
cut into blocks, each block is compressed with every dictionary, and the language whose compressed
sizes add up to the least is predicted. Where the best and the second best differ by too little,
the text is rejected (and the prediction still given).

The dictionaries are fitted on a bounded sample of labelled rows: the distinct texts of each language with
the smallest hashes, whole, that fill the DICTIONARY bytes of its dictionary; beyond LANGUAGES distinct labels those of
most text are learned. Prediction reads the whole text, in blocks, and nothing else.

Defined cases: a null text or one without a letter is ``und`` with score 0 and rejected; so is every
text if nothing was learned; equal sizes go to the language that sorts first; rows without a
language or doc_id are predicted and not learned from; copies of a text count once; columns of the input whose names
clash with working columns are kept apart; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandlore.llm.common import boxed, small_batches, unboxed
from strandlore.session import cut

#: Bytes of a language's dictionary, most languages, and low bits of the hash that one span of its order leaves open.
DICTIONARY, LANGUAGES, SPAN_BITS = 160_000, 1000, 48
BLOCK, LEVEL = 2048, 6
#: The score is even odds at no margin and nears one by this many bytes. A text is rejected, however
#: long, if the second best is larger than the best by less than this part of the best.
MARGIN_BYTES, MARGIN_PART = 4, 0.01
FOLDS = 5

PREDICTION = "lang_pred string, score double, margin double, rejected boolean"


def fold(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionary per language from (text, lang). The driver gets DICTIONARY bytes of each of LANGUAGES languages at most.

    Every distinct text has a place in its language's hash order; the dictionary is the texts in this order, whole,
    until DICTIONARY bytes are full, of which the last one may lose its end. Lengths are summed over spans of the
    order first, so that only texts that can be needed are looked at by themselves.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("text").alias("_h"))
    size = F.least(F.octet_length("text"), F.lit(DICTIONARY)).cast("long")
    distinct = rows.select("lang", "_h", size.alias("_n")).distinct()
    spans = distinct.groupBy("lang", F.shiftright(F.col("_h"), SPAN_BITS).alias("_span")).agg(F.sum("_n").alias("_n"))
    spans = cut(spans)
    # the languages of most text, so that a label of every document can't fill the driver
    most = [r["lang"] for r in spans.groupBy("lang").agg(F.sum("_n").alias("_n")).orderBy(F.desc("_n"), "lang").limit(LANGUAGES).collect()]
    if not most:
        return {}
    labels = rows.sparkSession.createDataFrame([(lang,) for lang in most], "lang string")
    so_far = F.sum("_n").over(Window.partitionBy("lang").orderBy("_span"))
    needed = spans.join(F.broadcast(labels), "lang").withColumn("_before", so_far - F.col("_n")).where(F.col("_before") < DICTIONARY)
    limits = needed.groupBy("lang").agg(F.max("_span").alias("_last"))  # LANGUAGES rows at most
    some = rows.join(F.broadcast(limits), "lang").where(F.shiftright(F.col("_h"), SPAN_BITS) <= F.col("_last"))
    some = some.groupBy("lang", "_h").agg(F.min(F.substring("text", 1, DICTIONARY)).alias("part"))
    before = F.sum(F.octet_length("part").cast("long")).over(Window.partitionBy("lang").orderBy("_h")) - F.octet_length("part")
    out: dict[str, list] = {}
    for r in some.withColumn("_before", before).where(F.col("_before") < DICTIONARY).select("lang", "_h", "part").orderBy("lang", "_h").collect():
        out.setdefault(r["lang"], []).append(r["part"].lower())
    return {lang: "\n".join(found).encode()[:DICTIONARY].decode(errors="ignore").encode() for lang, found in out.items()}


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        import zstandard as z

        self.langs = sorted(model)
        self.coders = []
        for lang in self.langs:
            d = z.ZstdCompressionDict(model[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.coders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.coders]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        if len(order) == 1:
            return self.langs[0], 1.0, 1.0, False
        best, second = sizes[order[0]], sizes[order[1]]
        score = 1 / (1 + math.exp(-min(second - best, 600) / MARGIN_BYTES))
        narrow = second - best < MARGIN_PART * best
        return self.langs[order[0]], score, (second - best) / second, narrow


def with_prediction(docs: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """Adds a struct column ``_lang``. No shuffle; the model is DICTIONARY bytes a language."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classifier = Classifier(shared.value)
        for batch in texts:
            rows = [classifier.predict(t) for t in batch.to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang_pred", "score", "margin", "rejected"])

    return docs.withColumn("_lang", predict(text))


def identify(docs: DataFrame) -> DataFrame:
    """Prediction for every document; learned from the rows that aren't held out."""
    learn = docs.where(fold() != 0).select("text", "lang")
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return with_prediction(docs.select("doc_id", held, "text"), fit(learn)).select("doc_id", "held_out", "_lang.*")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Documents whose language is told clearly, with their own columns."""
    model = fit(docs.where(fold() != 0).select("text", "lang"))
    return with_prediction(docs.select(boxed(docs), "text"), model).where(~F.col("_lang.rejected")).select(*unboxed(docs))
