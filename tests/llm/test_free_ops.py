"""Language id, WARC, SimHash, top-k, media, packing: brute force, round trips, odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandlore.llm import langid, media, packing, simhash, similar, topk, warc
from strandlore.llm import queries
from strandlore.llm.queries import tokenizer_path

from test_native_ops import ODD, docs


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, data string, record_key int")


@pytest.mark.parametrize(
    "fn",
    [langid.identify, simhash.near_duplicates, lambda d: media.media_features(media.encode_media(d)), lambda d: packing.pack(d, tokenizer_path())],
)
def test_odd_and_empty_tables(spark, fn):
    assert fn(docs(spark, [])).count() == 0
    assert fn(docs(spark, ODD)).count() == len(ODD) or fn(docs(spark, ODD)).where("doc_tokens is not null").count() >= len(ODD)


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out and not rejected")
    assert out.where("lang = lang_pred").count() >= 0.95 * out.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_undetermined(spark):
    rows = [(i, "the quick brown fox and the dog " * 9, "en", "s") for i in range(20)] + [(50, "12 34 !?", "en", "s"), (51, None, "en", "s"), (52, "the dog", None, "s")]
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows)).collect()}
    assert (got[50].lang_pred, got[51].lang_pred, got[52].lang_pred) == ("und", "und", "en") and got[50].score == 0
    kept = langid.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns and {r.doc_id for r in kept.collect()} == {*range(20), 52}
    assert all(r.lang_pred == "und" for r in langid.identify(docs(spark, [(1, "abc def", None, "s")])).collect())


def test_language_of_many_copies_is_learned(spark):
    few = [f"das ist ein kurzer text nummer {i} und der hund" for i in range(5)]
    rows = [(few[i % 5], "de") for i in range(20_000)] + [("le chat et le chien vont à la maison", "fr")] * 20_000 + [(f"the quick brown fox {i} " * 50, "en") for i in range(1000)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model["de"].decode().split("\n")) == set(few) and model["fr"].decode() == rows[20_000][0]
    # the first texts in the order of their hashes, whole
    en = spark.createDataFrame(rows[-1000:], "text string, lang string").orderBy(F.xxhash64("text")).limit(langid.DICTIONARY // 1000).collect()
    assert model["en"].decode() == "\n".join(r.text for r in en)[: len(model["en"])] and langid.DICTIONARY - 3 <= len(model["en"]) <= langid.DICTIONARY


def test_language_equals_plain_compression(spark, sf):
    """Predictions of whole texts against a loop over plain compressor calls, a very long text among them."""
    import zstandard

    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    text = {r.doc_id: r.text for r in d.collect()}
    text[10**6] = " ".join(list(text.values())[:40]) * 4
    model = langid.fit(d.where(langid.fold() != 0))
    all_of = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r.doc_id: r._lang.lang_pred for r in langid.with_prediction(all_of, model).collect()}
    coders = {k: zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False) for k, v in model.items()}
    for i, t in text.items():
        raw = t.lower().encode()
        sizes = {k: sum(len(c.compress(raw[a : a + langid.BLOCK])) for a in range(0, len(raw), langid.BLOCK)) for k, c in coders.items()}
        assert got[i] == (min(sizes, key=lambda k: (sizes[k], k)) if any(map(str.isalpha, t)) else "und")


def test_long_noise_is_rejected():
    rng = np.random.default_rng(4)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(2, 10)))) for _ in range(n))
    german, english = "der hund und die katze gehen nach hause ", "the dog and the cat are going home "
    classifier = langid.Classifier({"de": (german + words(400)).encode(), "en": (english + words(400)).encode()})
    assert all(classifier.predict(words(n))[3] for n in (100, 1000, 5000) for _ in range(5))
    got = [classifier.predict(german * 3), classifier.predict(english * 300)]
    assert [(g[0], g[3]) for g in got] == [("de", False), ("en", False)]


def test_warc_round_trip(spark):
    long, other = "é<p>" * 60_000, "y" * 1000
    rows = [(1, "u", long), (2, "u", long), (9, None, long), (3, "u", "short"), (4, "u", "short"), (5, "a\r\nb", None), (6, "u", ""), (7, "u", other), (8, "u", other), (8, "u", other), (None, "u", other)]
    got = sorted(warc.round_trip(pages(spark, [(*r, "x", 1) for r in rows])).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(rows)
    body = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        assert r.payload_bytes == len(body[r.page_id]) and r.payload_digest == hashlib.sha1(body[r.page_id]).hexdigest()
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == {
        (1, "revisit", 9), (2, "revisit", 9), (9, "response", None), (3, "response", None), (4, "response", None), (5, "response", None),
        (6, "response", None), (7, "revisit", 8), (8, "response", None), (None, "revisit", 8),
    }
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_warc_record_ids_are_unique(spark):
    body, other = "b" * 2000, "c" * 2000
    rows = [(1, "u", body), (2, "u", body), (3, "u", other), (3, "u", other), (1, "u", other), (None, "u", "x"), (None, "u", "x"), (7, "u", "x"), (7, "u", "x")]
    heads = [bytes(r.data).split(b"\r\n\r\n")[0].decode() for r in warc.encode_archive(pages(spark, [(*r, "x", 1) for r in rows])).where("chunk_no = 0").collect()]
    fields = [dict(line.split(": ", 1) for line in h.split("\r\n")[1:]) for h in heads]
    ids = {f["WARC-Record-ID"]: f for f in fields}
    assert len(ids) == len(rows)
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert sorted(f["X-Page-Id"] for f in revisits) == ["1", "1"]
    for f in revisits:
        if f["X-Refers-To-Page-Id"] == "2":
            assert ids[f["WARC-Refers-To"]]["X-Page-Id"] == "2" and ids[f["WARC-Refers-To"]]["WARC-Type"] == "response"
        else:
            assert "WARC-Refers-To" not in f  # two records tie


def test_packing_spreads_rows_of_one_id(spark):
    rows = packing.pack(docs(spark, [(7, "a b c", "en", "s")] * 300 + [(None, "a b c", "en", "s")] * 300), tokenizer_path(), bucket_docs=32).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 10 and sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_warc_chunks_and_damage(spark):
    archive = warc.encode_archive(pages(spark, [(1, "u", "z" * 300_000, "x", 1)])).collect()
    assert [r.chunk_no for r in archive] == list(range(5)) and max(len(r.data) for r in archive) < warc.CHUNK + 2000
    assert b"".join(r.data for r in archive).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")
    record = warc._Record()
    record.feed(archive[0].data, archive[0].sha1_so_far)
    with pytest.raises(ValueError, match="damaged"):
        record.feed(b"q" + archive[1].data[1:], archive[1].sha1_so_far)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    ids, label = sorted(fps), {}
    for i in ids:
        if i in label:
            continue
        todo = [i]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = i
                todo += [y for y in ids if y not in label and (fps[x] ^ fps[y]).bit_count() <= 3]
    return label


def test_simhash_equals_brute_force(spark, sf):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows |= {900_000 + i: t for i, t in enumerate(["", None, "a", "A", "a b", "a  b\n", "Ä x y z", "ä x y z"])}
    got = simhash.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows.items()])).collect()
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    want = plain_components(fps)
    for r in got:
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


@pytest.mark.parametrize("block", [40, 1024])
def test_links_of_dense_clusters_are_whole(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 4)
    near = {int(c) ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 5), replace=False)) for c in centres for _ in range(150)}
    chain = [0b111 * (1 << 3 * k) - 0 for k in range(0, 18)]
    walk, x = [], int(rng.integers(0, 2**62))
    for step in chain:
        x ^= step
        walk.append(x)
    fps = {i: v for i, v in enumerate(sorted(near | set(walk)))}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps.values()]
    found = simhash.components(simhash.links(spark.createDataFrame(signed, "fp long"), block)).collect()
    label = {r.node: r.label for r in found}
    want = plain_components(fps)
    groups = lambda pairs: {frozenset(k for k, v in pairs.items() if v == x) for x in set(pairs.values())}
    mine = {i: label.get(s[0], s[0]) for i, s in enumerate(signed)}
    assert groups(mine) == groups(want)


def plain_shingles(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_similar(texts):
    """{id: least id of its component}, by all pairs of distinct shingle sets that have a shingle in common."""
    sets, holders = {i: plain_shingles(t) for i, t in texts.items()}, {}
    label = {i: i for i in sets}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sorted(sets):
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
        for j in {j for x in sets[i] for j in holders[x] if j < i}:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                label[b] = a
    return {i: top(i) for i in sets}


def near_copies(rng, n, words, changes):
    base = [f"w{rng.integers(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.integers(0, words, changes):
            copy[at] = f"x{rng.integers(0, 10**6)}"
        out.append(" ".join(copy))
    return [" ".join(base), *out]


@pytest.mark.parametrize("block", [5, 512])
def test_similar_equals_brute_force(spark, sf, block, monkeypatch):
    rng = np.random.default_rng(12)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", None, "a b", "A  b", "a b c d e", "a b c d e f"]
    # copies that are near their original and not one another, and some whose passages are common but not enough
    texts += near_copies(rng, 25, 200, 4) + near_copies(rng, 10, 60, 1) + near_copies(rng, 12, 100, 5) + near_copies(rng, 4, 12, 1)
    rows = dict(enumerate(texts))
    d = docs(spark, [(i, t, "en", "s") for i, t in rows.items()])
    links = similar.similar_links
    monkeypatch.setattr(similar, "similar_links", lambda *a: links(*a, block=block))
    named, each = similar.similar_classes(d)
    got = {r.doc_id: r.label for r in each.join(named.select("node", "label"), "node").collect()}
    groups = lambda label: {frozenset(i for i, x in label.items() if x == k) for k in set(label.values())}
    assert groups(got) == groups(plain_similar(rows))


def test_shingles_in_parts_equal_the_whole(monkeypatch):
    text = " ".join(f"Wort{i % 700} é{i}" for i in range(3000)).encode()
    whole = similar.shingle_set(text), similar.fingerprint(text)
    monkeypatch.setattr(similar, "PART", 500)
    assert len(list(similar.shingle_hashes(text))) > 50
    assert (similar.shingle_set(text) == whole[0]).all() and similar.fingerprint(text) == whole[1] and len(whole[0]) == len(plain_shingles(text.decode()))


def test_similar_keeps_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(i, text + (" end" if i % 2 else ""), "en", "s") for i in range(10, 30)] + [(5, "another text altogether", "en", "s"), (None, "no id", "en", "s")]
    kept = similar.keep_representatives(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 5, 10]
    assert similar.keep_representatives(docs(spark, [])).count() == 0


def test_similar_keeps_texts_that_share_an_id(spark):
    a, b, c = ("one two three four five six", "a b c d e f g", "vier fünf sechs sieben acht neun")
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (7, c, "en", "s"), (None, c, "en", "s"), (None, c, "en", "s"), (None, "x y", "en", "s"), (None, "x y", "en", "s"), (None, None, "en", "s"), (8, None, "en", "s")]
    kept = similar.keep_representatives(docs(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "x y"), (5, b), (5, a), (7, c), (8, "")]


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 8)) * rng.choice([0.1, 1, 30], size=(700, 1))
    x[50:300] = x[50]
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    rows += [(700, None, "x"), (750, [1.0, None] + [0.0] * 6, "x"), (800, [float("nan")] * 8, "x"), (850, [float("inf")] * 8, "x"), (900, [1.0, 2.0], "x"), (901, [1.0, 2.0], "x")]
    # repeated candidates, rows without an id, and a query that stands twice
    rows += [(901, [1.0, 2.0], "y"), (901, [90.0] * 8, "y"), *[(3, rows[3][1], "y")] * 3, (None, [80.0] * 8, "y"), (None, [80.0] * 8, "y"), rows[100]]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    v = [(i, np.pad(np.floor(256 * np.array(r)), (0, 8 - len(r))).astype(int)) for i, r, _ in rows if r and all(e is not None and np.isfinite(e) for e in r)]
    asked = {i: q for i, q in v if i is not None and i % 50 == 0}
    assert set(got) == set(asked) and 100 in got
    for i, q in asked.items():
        best = sorted(((-int(q @ c), j is None, j or 0) for j, c in v if j != i))[:5]
        assert got[i] == {k: (None if none else j, -s) for k, (s, none, j) in enumerate(best, 1)}
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in few] == [(0, 1, 1, 256 * 512)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_stops_early(spark, monkeypatch):
    """Where vectors lie in clusters, a query sees few annuli, and results are still exact."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 6)) * 4
    x = centres[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 6)) * 0.05
    d = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(d, F.col("vec_id") % 500 == 0).collect()}
    v = np.floor(256 * x).astype(int)
    g = topk.Geometry([{"vec_id": i, "v": list(map(int, r))} for i, r in enumerate(v[:2048])], 6, int((v * v).sum(axis=1).max()), 6000, 5)
    cell, dist = g.place(v)
    ring = (dist[:, None] > g.edges[cell]).sum(axis=1)
    annuli = sorted(set(zip(cell.tolist(), ring.tolist(), strict=True)))
    low, high = (np.array([f(dist[(cell == c) & (ring == n)]) for c, n in annuli]) for f in (np.min, np.max))
    visited = []
    for q in range(0, 6000, 500):
        order = sorted((-int(s), j) for j, s in enumerate(v @ v[q]) if j != q)[:5]
        assert [got[q, k] for k in range(1, 6)] == [(j, -s) for s, j in order]
        visited.append((g.bounds(v[q : q + 1], low, high, np.array([c for c, _ in annuli]))[0] >= -order[-1][0]).mean())
    assert np.mean(visited) < 0.5


def test_annuli_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 6))
    sample = [{"vec_id": i, "v": list(map(int, r))} for i, r in enumerate(x)]
    g = topk.Geometry(sample, 6, int((x * x).sum(axis=1).max()), 40_000, 5)
    cell, dist = g.place(x)
    assert len(g.pivots) > 1
    for c in range(len(g.pivots)):
        at = cell == c
        bound = g.bounds(x[:50], np.array([dist[at].min()]), np.array([dist[at].max()]), np.array([c]))[:, 0]
        assert (bound >= (x[:50] @ x[at].T).max(axis=1)).all()


def test_media_round_trip():
    rng = np.random.default_rng(1)
    raw = [b"", b"abc", rng.bytes(5000), b"\xff" * 600, "größe ".encode() * 40_000, rng.bytes(500_000), bytes([0, 255] * 1000), b"x" * 576]
    stored = media.encode(raw)
    for text, m, (n, thumbnail) in zip(raw, stored, media.decode(stored), strict=True):
        payload = thumbnail.tobytes()
        assert n == len(text) and payload[:n] == text and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
        assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9"
    with pytest.raises(ValueError):
        media.decode([stored[2][:200] + b"\xff\xd9"])


def test_media_query_reads_what_it_stored(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda s, name: str(tmp_path / name))
    got = queries.op8_media(spark, sf)
    stored = {r.doc_id: hashlib.sha256(r.media).hexdigest() for r in spark.read.parquet(str(tmp_path / "media")).collect()}
    assert len(stored) == 200 and {r["doc_id"]: r["media_sha256"] for r in got.collect()} == stored


def written_elsewhere(image, quantiser, factors, interval):
    """A baseline JPEG by the book: colour planes, cosine transform, AC codes, and tables that ``media`` doesn't use."""
    at = np.arange(8)
    basis = np.cos((2 * at[None, :] + 1) * at[:, None] * np.pi / 16) * np.where(at[:, None] == 0, np.sqrt(1 / 8), 0.5)
    zigzag = sorted(((x, y) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 == 0 else p[1]))
    dc = {s: (s, 4) for s in range(12)}
    ac = {s: (i, 8) for i, s in enumerate([0, 0xF0, *(r << 4 | n for r in range(16) for n in range(1, 11))])}
    h, v = max(f[0] for f in factors), max(f[1] for f in factors)
    rows, columns = image.shape[:2]
    across, down = -(-columns // (8 * h)), -(-rows // (8 * v))
    blocks, dcs = [], np.zeros((down * factors[0][1], across * factors[0][0]), np.int64)
    for k, (fh, fv) in enumerate(factors):
        full = np.pad(image[:, :, k], ((0, down * 8 * v - rows), (0, across * 8 * h - columns)), mode="edge").astype(float)
        plane = full.reshape(down * 8 * fv, v // fv, across * 8 * fh, h // fh).mean(axis=(1, 3)) - 128
        blocks.append(np.array([[np.rint(basis @ plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] @ basis.T / quantiser).astype(int) for x in range(across * fh)] for y in range(down * fv)]))
    dcs = blocks[0][:, :, 0, 0]
    scan, bits, last = [], "", [0] * len(factors)

    def put(table, symbol, value, size):
        code, n = table[symbol]
        return f"{code:0{n}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def closed(bits):
        bits += "1" * (-len(bits) % 8)
        return int("1" + bits, 2).to_bytes(len(bits) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")

    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            scan += [closed(bits), bytes([0xFF, 0xD0 + (unit // interval - 1) % 8])]
            bits, last = "", [0] * len(factors)
        for k, (fh, fv) in enumerate(factors):
            for y in range(fv):
                for x in range(fh):
                    b = blocks[k][unit // across * fv + y, unit % across * fh + x]
                    d = int(b[0, 0]) - last[k]
                    last[k] = int(b[0, 0])
                    size = abs(d).bit_length()
                    bits += put(dc, size, d, size)
                    run = 0
                    flat = [int(b[j, i]) for i, j in zigzag[1:]]
                    while flat and flat[-1] == 0:
                        flat.pop()
                    for c in flat:
                        if c == 0:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + put(ac, 0xF0, 0, 0), run - 16
                        n = abs(c).bit_length()
                        bits, run = bits + put(ac, run << 4 | n, c, n), 0
                    bits += put(ac, 0, 0, 0) if len(flat) < 63 else ""
    scan.append(closed(bits))
    tables = lambda kind, t: bytes([kind, *[sum(n == i for _, n in t.values()) for i in range(1, 17)], *sorted(t, key=lambda s: t[s][0])])
    head = [b"\xff\xd8", media._segment(0xE0, b"JFIF\0"), media._segment(0xDB, bytes([0]) + bytes([quantiser] * 64))]
    head.append(media._segment(0xC0, bytes([8]) + rows.to_bytes(2, "big") + columns.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([k + 1, fh << 4 | fv, 0]) for k, (fh, fv) in enumerate(factors))))
    head.append(media._segment(0xC4, tables(0x01, dc) + tables(0x11, ac)))
    head += [media._segment(0xDD, interval.to_bytes(2, "big"))] if interval else []
    head.append(media._segment(0xDA, bytes([len(factors)]) + b"".join(bytes([k + 1, 0x11]) for k in range(len(factors))) + bytes([0, 63, 0])))
    return b"".join([*head, *scan, b"\xff\xd9"]), np.clip((dcs * quantiser + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize(("factors", "interval", "quantiser"), [([(1, 1)], 0, 11), ([(1, 1)], 5, 8), ([(2, 2), (1, 1), (1, 1)], 0, 16), ([(1, 1)] * 3, 3, 3)])
def test_media_decodes_pictures_of_other_writers(factors, interval, quantiser):
    rng = np.random.default_rng(8)
    image = np.clip(rng.normal(128, 70, (37, 50, 3)).cumsum(axis=1) % 256, 0, 255)
    stored, want = written_elsewhere(image[:, :, : len(factors)], quantiser, factors, interval)
    (n, got), ours = media.decode([stored, media.encode([b"abc"])[0]])
    assert got.shape == (5, 7) and (got == want[:5, :7]).all() and n == 35
    assert ours[0] == 3 and ours[1].tobytes()[:4] == b"abc\xff"


def test_media_refuses_damage():
    text = b"some text of a few words " * 40
    stored = media.encode([text])[0]
    at = stored.index(b"\xff\xda") + 10
    rng = np.random.default_rng(6)
    for place in rng.integers(at, at + len(text), 60):  # in the padding, samples beyond 255 are 255
        other = bytes([stored[place] ^ 1 << int(rng.integers(0, 8))])
        with pytest.raises(ValueError):  # noqa: PT011
            media.decode([stored[:place] + other + stored[place + 1 :]])
    for broken in (stored[:-2], stored[: at + 5], stored.replace(b"\xff\xc0", b"\xff\xc2"), b"GIF89a"):
        with pytest.raises(ValueError):  # noqa: PT011
            media.decode([broken])


def test_media_contract(spark):
    rows = [(1, "Hällo", "en", "s"), (2, "Hällo", "en", "s"), (3, None, "en", "s"), (4, "z" * 576, "en", "s")]
    got = {r.doc_id: r for r in media.media_features(media.encode_media(docs(spark, rows))).collect()}
    for i, t, _, _ in rows:
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    assert got[1][1:] == got[2][1:] and got[1].feature != got[4].feature


def test_word_cache_equals_tokenizer(spark, sf):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += ["", "a\x1cb　c ΣΑΣ İx <|endoftext|> <|ENDOFTEXT|> don't it's, X.. 12,5 é. é, ̈a \n\n\t x", "…a. 'S 're. ２. ª. ", "q" * 30_000]
    words, plain = packing.WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in [*texts, *texts[-4:]]:
        assert words.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_packing_contract(spark, sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    d = spark.read.parquet(f"{sf}/documents.parquet")
    ids = {r.doc_id: [*plain.encode(r.text, add_special_tokens=False).ids, 1] for r in d.collect()}
    rows = packing.pack(d, tokenizer_path(), bucket_docs=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, total in [*((by_doc[i], len(x)) for i, x in ids.items()), *((p, None) for p in by_sequence.values())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
        assert at == total if total else at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_balance_is_even():
    rng = np.random.default_rng(9)
    lengths = sorted(map(int, rng.integers(1, 2048, 1000)), reverse=True)
    cost = {}
    for parts in packing.balance(lengths):
        for _, size, k, _ in parts:
            cost[k] = cost.get(k, 0) + packing.LINEAR * size + packing.QUADRATIC * size * size
    full = [c for k, c in cost.items() if k < sum(lengths) // 2048]
    assert np.std(full) < 0.25 * np.mean(full)


def test_words_of_a_packing_worker_are_bounded():
    """Beyond 340,000 words new ones get their ids and aren't remembered, since two workers stay in an executor."""
    words = packing.WordIds(tokenizer_path())
    want = words.encode("unheard")
    words.clear()
    words.update((f"{i} ", b"") for i in range(340_000))
    assert words.encode("unheard") == want and len(words) == 340_000
