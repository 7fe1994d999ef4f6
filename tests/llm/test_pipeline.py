"""The pipeline against a plain version of each stage, on the same documents."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from strandlore.llm import langid
from strandlore.llm.queries import tokenizer_path

from test_free_ops import plain_similar
from test_native_ops import base, docs, plain_report, waterfill

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PLACEHOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term-generalised": "[TERM]", "term-removed": ""}


def plain_redact(text, spans):
    out, at = "", 0
    for span in spans.split(",") if spans else []:
        name, start, end = span.split(":")
        if int(start) >= at:
            out += text[at : int(start)] + PLACEHOLDERS[name]
        at = max(at, int(end))
    return out + text[at:]


def plain_copies(docs, seed=7):
    """{doc_id: copies} with documents of each source in the order of size class, hash and id."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for i, d in docs.items()}
    words = defaultdict(int)
    for i, d in docs.items():
        words[d["source"]] += size[i]
    target = waterfill(dict(words))
    sized = lambda n: len(f"{n:b}") * 16 + (n >> max(len(f"{n:b}") - 4, 0))
    out = {}
    for source in words:
        offset = (int(hashlib.md5(f"{seed}:offset:0{source}".encode()).hexdigest()[:5], 16) + 0.5) / 1048576
        rate = target[source] / words[source]
        mine = sorted((i for i in docs if docs[i]["source"] == source), key=lambda i: (sized(size[i]), hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
        for n, i in enumerate(mine, 1):
            out[i] = min(2, math.floor(offset + rate * n) - math.floor(offset + rate * (n - 1)))
    return out


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The documents after each stage, each stage run on what the one before returned."""
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        found.append((docs.columns, [r.asDict() for r in docs.collect()]))
    return found


def test_stages_equal_plain_versions(spark, sf, stages):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    docs = {r.doc_id: r.asDict() for r in source.collect()}
    classifier = langid.Classifier(langid.fit(source.where(langid.fold() != 0).select("text", "lang")))
    docs = {i: d for i, d in docs.items() if not classifier.predict(d["text"])[3]}
    assert {r["doc_id"]: r for r in stages[0][1]} == docs and len(docs) > 190

    label = plain_similar({i: d["text"] for i, d in docs.items()})
    docs = {i: d for i, d in docs.items() if label[i] == i}
    assert {r["doc_id"]: r for r in stages[1][1]} == docs

    spans = dict(zip(docs, plain_report([d["text"] for d in docs.values()]), strict=True))
    assert any("term" in s for s in spans.values())
    docs = {i: d | ({"text": t, "n_chars": len(t)} if (t := plain_redact(d["text"], spans[i])) != d["text"] else {}) for i, d in docs.items()}
    assert {r["doc_id"]: r for r in stages[2][1]} == docs
    assert not any(base(r["text"]) for r in stages[2][1])

    copies = plain_copies(docs)
    mixed = Counter(r["doc_id"] for r in stages[3][1])
    assert mixed == Counter({i: n for i, n in copies.items() if n})
    assert all({k: r[k] for k in COLUMNS} == docs[r["doc_id"]] for r in stages[3][1])

    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    tokens = {i: len(plain.encode(d["text"], add_special_tokens=False).ids) + 1 for i, d in docs.items()}
    packed = defaultdict(int)
    for r in stages[4][1]:
        packed[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == tokens[r["doc_id"]]
    assert packed == {i: tokens[i] * n for i, n in mixed.items()}


def test_columns_are_kept(stages):
    assert all(columns == COLUMNS for columns, _ in stages[:-1])


def test_run_equals_the_stages(spark, sf, stages):
    got = Counter((r.doc_id, r.start, r.length) for r in corpus_pipeline.run(spark, sf).select("doc_id", "start", "length").collect())
    a, b = Counter(), Counter()
    for (i, _, n), k in got.items():
        a[i] += n * k
    for r in stages[-1][1]:
        b[r["doc_id"]] += r["length"]
    assert a == b


def test_empty_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_take_odd_rows(spark, sf):
    """Null texts, ids and sources, repeated ids and rows, and columns whose names the operators use themselves."""
    english = "the dog and the cat are going home and the sun is over the hill of the town "
    other = "over the town the sun and the hill are home to the cat of the dog and going is the end of the day"
    rows = [(i, f"{english} number {i} and {i * 7} of {i * 31} more", "en", "s1") for i in range(40)]
    rows += [(5, english * 3, "en", None), (5, "another " + english * 2, "en", "s2"), (None, other, "en", "s2"), (None, other, "en", "s2"), (7, None, None, None), (8, "", "en", "s1"), (None, None, None, None)]
    docs_ = docs(spark, rows)
    seen = docs_
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf).cache()
        assert seen.columns == docs_.columns, name
        if name == "simhash_dedup":
            kept = sorted((r.doc_id or 0, r.text) for r in seen.collect())
            assert len(kept) == len(set(kept)) and len([k for k in kept if k[0] == 5]) >= 2 and (0, other) in kept
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()
    assert sum(r.doc_tokens for r in packed if r.start == 0) == sum(r.length for r in packed) > 0
