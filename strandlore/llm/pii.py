"""Personal data: base spans by pattern, and information-theoretic sanitisation of what reveals them.

Base spans are e-mail addresses, IP addresses, payment cards and phone numbers. Every distinct value
is a protected entity. Corpus co-occurrence then tells how strongly the terms written in an entity's
documents reveal it: with p estimated by counts of documents, a term t gives away
PMI(t; e) = log2 p(t, e) / (p(t) p(e)) of the IC(e) = -log2 p(e) bits that entity e holds. A term
that discloses GENERALISE of its bits is generalised, from REMOVE on it is removed, wherever it
stands in a document of that entity.

There is no floor under the counts: an entity of one document is the most identifying one, and words that
hardly any other document has lead to it. Terms are words outside base spans, in p(t) and in p(t, e) alike,
and every word of a whole document counts.

DataFrame operations only. Patterns are the given ones with possessive quantifiers and, where the
first character is of an unbounded class, a start at the class's edge or at the last match's end:
the matches are the same, but a run of n characters costs n steps, not n * n, and no deep stack.
Places of matches are prefix sums in blocks, so a text with n of them costs about n ** 1.5 small steps.

Defined cases: null text is empty; spans of one kind never overlap, spans of two kinds may; equal texts
get equal spans, and every row counts as a document of its own; a text that is one entity only has no
terms; an entity of all documents holds no information, so nothing discloses it; columns of the input whose
names clash with working columns are kept apart in one struct; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from strandlore.llm.common import BROADCAST_ROWS, boxed, lookup_join, unboxed
from strandlore.session import cut

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Terms are words of at least TERM_LETTERS letters.
LETTERS, TERM_LETTERS = r"\p{L}+", 3
GENERALISE, REMOVE = 0.9, 0.98
#: Matches whose places are summed in one block, and characters of a text's pieces.
BLOCK, PIECE = 256, 512

KINDS = ("email", "ip", "card", "phone")
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def before(values: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """What ``plus`` makes of 0 and all values before each: within blocks, then over the blocks.

    An array that grows by one is copied each time; in blocks that is a small cost.
    """

    def run(items: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(plus(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, zero, step, lambda acc: acc["out"])

    def blocked(v: Column) -> Column:
        blocks = F.transform(upto(F.ceil(F.size(v) / F.lit(BLOCK)).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        totals = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), plus))
        return let(blocks, lambda bs: let(run(totals(bs), F.lit(0)), lambda firsts: F.flatten(F.transform(bs, lambda b, i: run(b, firsts[i])))))

    return let(values, blocked)


def found(text: Column, pattern: str, kind: int = 0) -> Column:
    """All leftmost non-overlapping matches as spans: the gaps between them give the places."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def placed(m: Column) -> Column:
        steps = F.transform(m["hits"], lambda v, i: m["gaps"][i] + F.length(v))

        def spans(at: Column) -> Column:
            begin = lambda i: at[i] + m["gaps"][i]
            return F.transform(m["hits"], lambda v, i: F.struct(begin(i).alias("start"), F.lit(kind).alias("kind"), (begin(i) + F.length(v)).alias("end"), v.alias("value")))

        return let(before(steps, lambda a, b: a + b), spans)

    return let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)


def _if_any(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.array().cast(_SPANS))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _small_part(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+", "")
    return F.when(bare == "", True).when(F.length(bare) <= 3, bare.cast("int") <= 255).otherwise(False)


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def may_hold(text: Column) -> Column:
    """False only where no base span can be."""
    return text.contains("@") | text.rlike("[0-9]")


def base_spans(text: Column) -> Column:
    """All base spans, sorted by start and then by kind."""
    digit = text.rlike("[0-9]")
    email = _if_any(text.contains("@"), found(text, EMAIL, 0))
    ip = _if_any(text.rlike(r"[0-9]\.[0-9]"), F.filter(found(text, IP, 1), lambda s: F.forall(F.split(s["value"], r"\."), _small_part)))
    is_card = lambda s: let(_digits(s["value"]), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    card = _if_any(digit, F.filter(found(text, CARD, 2), is_card))
    phone = _if_any(text.contains("+") & digit, F.filter(found(text, PHONE, 3), lambda s: F.length(_digits(s["value"])).between(9, 15)))
    return F.array_sort(F.concat(email, ip, card, phone))


def entities(spans: Column) -> Column:
    """Names of the distinct entities of some base spans."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_distinct(F.transform(spans, lambda s: F.concat(kind(s), F.lit(":"), F.lower(s["value"]))))


def replaced(text: Column, spans: Column, by: Callable[[Column, Column, Column], Column]) -> Column:
    """``text`` with sorted ``spans`` replaced by ``by(span, end of all before, whether it begins beyond that)``."""

    def written(x: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first = F.floor(a / PIECE).cast("int")
            some = F.array_join(F.slice(x["pieces"], first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(some, a % PIECE + 1, b - a)).otherwise("")

        def part(s: Column, i: Column) -> Column:
            fresh = s["start"] >= x["ends"][i]
            return F.concat(F.when(fresh, between(x["ends"][i], s["start"])).otherwise(""), by(s, x["ends"][i], fresh))

        return F.concat(F.array_join(F.transform(x["spans"], part), ""), between(F.element_at(x["ends"], -1), x["size"]))

    def ready(s: Column) -> Column:
        ends = before(F.concat(F.transform(s, lambda x: x["end"]), F.array(F.lit(0))), lambda a, b: F.greatest(a, b))
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        made = F.struct(s.alias("spans"), ends.alias("ends"), pieces.alias("pieces"), F.length(text).alias("size"))
        return F.when(F.size(s) > 0, let(made, written)).otherwise(text)

    return let(spans, ready)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with blanks in place of spans, as long as it was."""
    return replaced(text, spans, lambda s, end, fresh: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], end), F.lit(0))))


def keyed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keep``, and each row's id, text and the digest of its text; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*keep, F.col("doc_id").alias("_doc"), text.alias("_text"), F.md5(text).alias("_copy"))


def scan(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """``keyed``, and the base spans."""
    return keyed(docs, *keep).withColumn("_base", base_spans(F.col("_text")))


def terms_of(text: Column) -> Column:
    """Distinct words of enough letters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{{TERM_LETTERS},}}"), F.lit(0)))


def outside(text: Column) -> Column:
    return F.when(may_hold(text), masked(text, base_spans(text))).otherwise(text)


def classes_of(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, n) of the entities, and (_copy, class) of texts. Entities of the very same documents have the same
    co-occurrences and are one class, such as those of one text full of them."""
    met = scanned.where(F.size("_base") > 0).select("_copy", entities(F.col("_base")).alias("_e"))
    met = met.groupBy("_copy").agg(F.count("*").alias("m"), F.min("_e").alias("_e"))
    held = cut(met.select("_copy", "m", F.explode("_e").alias("entity")))
    part = lambda seed: F.sum(F.pmod(F.xxhash64(F.lit(seed), "_copy"), F.lit(1 << 31)))
    same = held.groupBy("entity").agg(F.sum("m").alias("n"), part(1).alias("a"), part(2).alias("b"))
    same = cut(same.select("entity", "n", F.concat_ws(":", "n", "a", "b").alias("class")))
    of_copy = cut(lookup_join(held, same, ["entity"], F.col("_copy"), same.count()).select("_copy", "class").distinct())
    return same.groupBy("class").agg(F.min("n").alias("n")), of_copy


def disclosing(docs: DataFrame, classes: DataFrame, of_copy: DataFrame, plain: Column) -> DataFrame:
    """(_copy, term, action): the terms of each text that disclose one of its entities. Counts are over all documents.

    ``plain`` is the text without its base spans.
    """
    total, widest = docs.count(), classes.agg(F.max("n")).first()[0]
    # n_t documents of a term and n_e of an entity share min(n_t, n_e) at most, so a term of more than this discloses none
    most = float(total) ** (1 - GENERALISE) * float(widest or 0) ** GENERALISE + 1
    words = keyed(docs).select(F.explode(terms_of(plain)).alias("term"))
    # words are counted once a document and summed before they are shuffled
    counts = cut(words.groupBy("term").agg(F.count("*").alias("_with_term")).where(F.col("_with_term") <= most))
    by_copy = cut(of_copy.groupBy("_copy").agg(F.collect_list("class").alias("_classes")))  # at most its own entities
    rows = keyed(docs.where(may_hold(F.col("text")))).select("_doc", "_copy", "_text")
    rows = lookup_join(rows, by_copy, ["_copy"], F.col("_doc"), of_copy.count()).where("_classes is not null")
    each = rows.select("_copy", "_classes", F.explode(terms_of(plain)).alias("term"))
    each = each.groupBy("_copy", "term").agg(F.count("*").alias("m"), F.min("_classes").alias("_classes"))
    rare = cut(each.join(counts, "term").select("_copy", "term", "m", "_with_term", F.explode("_classes").alias("class")))
    both = rare.groupBy("class", "term").agg(F.sum("m").alias("_both"), F.min("_with_term").alias("_with_term"))
    both = lookup_join(both, classes, ["class"], F.col("term"), classes.count())
    n = F.lit(float(total))
    pmi = F.log2(F.col("_both") * n / (F.col("_with_term") * F.col("n")))
    bits = F.log2(n / F.col("n"))
    share = F.when(bits > 0, F.round(pmi / bits, 9))
    action = F.when(share >= REMOVE, "term-removed").when(share >= GENERALISE, "term-generalised")
    bad = cut(both.select("class", "term", action.alias("action")).where("action is not null"))
    hit = lookup_join(rare.select("_copy", "term", "class"), bad, ["class", "term"], F.col("_copy"), bad.count()).where("action is not null")
    # a term of two entities may have two actions; removal is the stronger one, and the later by name
    return cut(hit.groupBy("_copy", "term").agg(F.max("action").alias("action")))


def term_spans(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(_copy, _terms): the spans of disclosing terms, for the texts that have any."""
    classes, of_copy = classes_of(scanned)
    plain = outside(F.col("_text"))
    hit = disclosing(docs, classes, of_copy, plain)
    copies = hit.select("_copy").distinct().withColumn("_hit", F.lit(True))
    rows = lookup_join(keyed(docs.where(may_hold(F.col("text")))), copies, ["_copy"], F.col("_doc"), copies.count()).where("_hit")
    texts = rows.select("_copy", "_text").dropDuplicates(["_copy"])
    places = texts.select("_copy", F.explode(found(plain, LETTERS)).alias("w"))
    places = places.select("_copy", F.lower("w.value").alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))
    spans = places.join(hit, ["_copy", "term"]).groupBy("_copy").agg(F.collect_list(F.struct("start", "action", "end")).alias("_terms"))
    return cut(spans)


def with_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``_terms``. They are broadcast if there are few spans, whatever the texts; adaptive execution splits a hot text otherwise."""
    n = terms.agg(F.sum(F.size("_terms"))).first()[0] or 0
    return rows.join(F.broadcast(terms) if n <= BROADCAST_ROWS else terms, "_copy", "left")


def _text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _named(base: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("order"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("name")))


def _terms(terms: Column) -> Column:
    order = lambda s: F.when(s["action"] == "term-generalised", len(KINDS)).otherwise(len(KINDS) + 1)
    made = F.transform(terms, lambda s: F.struct(s["start"].alias("start"), order(s).alias("order"), s["end"].alias("end"), s["action"].alias("name")))
    return F.coalesce(made, F.array().cast("array<struct<start:int,order:int,end:int,name:string>>"))


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans, per document."""
    scanned = cut(scan(docs, "doc_id").drop("_text"))
    terms = term_spans(scanned, docs)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    joined = with_terms(scanned, terms)
    return joined.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(_text_of(_named(F.col("_base"))), 256).alias("base_sha256"),
        _text_of(F.array_sort(F.concat(_named(F.col("_base")), _terms(F.col("_terms"))))).alias("spans"),
    )


#: What stands in a sanitised text for a span of each name.
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term-generalised": "[TERM]", "term-removed": ""}


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with all spans replaced, and ``n_chars`` set anew; overlapping spans count as one."""
    scanned = cut(scan(docs).drop("_text"))
    terms = term_spans(scanned, docs)
    joined = with_terms(scan(docs, boxed(docs)), terms)
    rows = joined.withColumn("_spans", F.array_sort(F.concat(_named(F.col("_base")), _terms(F.col("_terms")))))
    placeholder = lambda s: F.coalesce(*[F.when(s["name"] == k, v) for k, v in PLACEHOLDERS.items()])
    clean = replaced(F.col("_text"), F.col("_spans"), lambda s, end, fresh: F.when(fresh, placeholder(s)).otherwise(""))
    dirty = F.size(F.col("_base")) > 0
    out = rows.withColumn("_clean", F.when(dirty, clean).otherwise(F.col("_row.text")))
    instead = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        instead["n_chars"] = F.when(dirty, F.length("_clean").cast(kind)).otherwise(F.col("_row.n_chars"))
    return out.select(*unboxed(docs, **instead))
