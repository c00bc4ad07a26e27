"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeats."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from redactlake.llm import ann, bpe, components, fingerprint, line_dedup, lm, packing, quality, simhash, suffix_dedup, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(3)
WORDS = ["the", "of", "Élan", "straße", "naïve", "data", "Spark", "line", "x1", "don't", "東京", "🙂", "and", "shuffle", "partition"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


SHARED = prose(60)
TEXTS = [None, "", " ", "\n\n", "Hello  world\t\n x", "<|endoftext|> a<|endoftext|>", "a" * 5000, prose(3000), "Line A \nline a\nother " + prose(5), SHARED + " end " + prose(20), prose(10) + " " + SHARED, prose(40), "one", "two words", "İıſK ﬁ Ａ"]
TEXTS += [TEXTS[11], TEXTS[11] + " tail", "word  pair " * 80] + [f"Common line\n{prose(6)}\n COMMON LINE\t" for _ in range(12)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "doc", i) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "doc", 3), (None, "no id", "doc", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, doc string, h1 long").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def data(row):
    return (row.text or "").encode()


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH, decoded="back").collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids and r.back == t.decode(ids, skip_special_tokens=False)
    again = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in again)
    assert bpe.encode(empty, PATH).count() == 0
    e = bpe.TextEncoder(bpe.vocabulary(PATH), cache_entries=5)
    odd = ["\x1c a b", "a \n b", "  lead", "trail  ", "Ⅷ²½ x", "'s 'tis we'll", "\r\n\r\n", *("".join(chr(RNG.choice([32, 10, 9, 97, 0xE9, 0x3000, 0x661, 0x1F600, 39])) for _ in range(30)) for _ in range(60))]
    for s, ids in zip(odd, e.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, repr(s)
    assert not any(len(p) > bpe.LONG_PART for p in [*e.first, *e.after])


LONG = [" " * 300_000, "\n" * 300_000, "x" + " " * 200_000 + "y", "".join(RNG.choice("abcdeöst") for _ in range(200_000)), ("ab" * 3000 + " ") * 40, "\t \n" * 90_000 + "end"]


def test_very_long_texts():
    """Runs that a compiled pattern or a trie of nodes could not take, by both encoders."""
    from tokenizers import Tokenizer

    t, e, encode = Tokenizer.from_file(PATH), bpe.encoder(PATH), packing.token_encoder(PATH)
    for s in LONG:
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(e.encode([s])[0], "<u4").tolist() == ids
        assert np.frombuffer(encode(s), "<u4").tolist() == ids


CLASHING = ["spans", "_keep", "_th", "_tag", "_copies", "_data", "data", "_kept2", "th", "c0", "c9", "text_hash", "copies", "mark_keep", "sample", "fp", "seed", "n", "doc"]


def test_columns_of_any_name(docs, spark):
    """Columns named as an operator's own come through; tables without rows do as well."""
    import corpus_pipeline

    df = docs.select("doc_id", "text", *[F.lit(f"v-{c}").alias(c) for c in CLASHING])
    model = quality.fit([], [])
    made = [
        (bpe.encode(df, PATH, decoded="back"), ["ids", "back"]),
        (bpe.decode(df.withColumn("ids", F.lit(b"\5\0\0\0")), PATH), ["ids", "decoded"]),
        (line_dedup.keep_lines(df, line_dedup.keep_bitmaps(df, min_docs=10)), ["_n_lines", "_n_dropped", "_kept"]),
        (fingerprint.fingerprints(df), ["fingerprint"]),
        (suffix_dedup.without_repeats(df), ["_n_bytes", "_n_removed", "_n_spans", "_kept"]),
        (quality.score(df, model), ["score"]),
        (corpus_pipeline.drop_lines(spark, df, ""), []),
        (corpus_pipeline.one_of_near(spark, df, ""), []),
        (corpus_pipeline.drop_repeats(spark, df, ""), []),
    ]
    for out, added in made:
        assert out.columns == [*df.columns, *added]
        for row in out.collect():
            assert all(row[c] == f"v-{c}" for c in CLASHING)
    assert simhash.near_duplicates(df).count() == lm.score(df, F.lit(False), states=2, rounds=1).count() == packing.pack(df, PATH).select("doc").distinct().count() + 1
    again = line_dedup.keep_lines(df.withColumn("_kept", F.lit(1)), line_dedup.keep_bitmaps(df, min_docs=10))
    assert again.columns.count("_kept") == 1 and dict(again.dtypes)["_kept"] == "string"
    none = df.limit(0)
    assert bpe.encode(none, PATH).count() == quality.score(none, model).count() == fingerprint.fingerprints(none).count() == 0
    assert corpus_pipeline.drop_lines(spark, none, "").count() == corpus_pipeline.drop_repeats(spark, none, "").count() == 0


def keys_of(text):
    return [x.strip(b" \t\n\x0b\x0c\r") for x in text.lower().split(b"\n")]


def test_line_dedup(docs, empty):
    rows = docs.collect()
    df = Counter(k for k, _ in {(k, (r.doc_id, r.text)) for r in rows for k in keys_of(data(r)) if k})
    got = line_dedup.keep_lines(docs, line_dedup.keep_bitmaps(docs, min_docs=10)).collect()
    assert len(got) == len(rows) and sum(r._n_dropped for r in got) == 24
    for r in got:
        lines = data(r).split(b"\n")
        keep = [x for x, k in zip(lines, keys_of(data(r)), strict=True) if df[k] < 10]
        assert (r._n_lines, r._n_dropped, r._kept.encode()) == (len(lines), len(lines) - len(keep), b"\n".join(keep))
    first, seen = {}, set()
    for r in sorted({(r.doc_id is not None, r.doc_id or 0, r.text) for r in rows}, key=lambda r: r[:2]):
        keep = []
        for x, k in zip((r[2] or "").encode().split(b"\n"), keys_of((r[2] or "").encode()), strict=True):
            if not k or k not in seen:
                keep.append(x)
            seen.add(k)
        first[r] = b"\n".join(keep)
    for r in line_dedup.keep_lines(docs, line_dedup.keep_bitmaps(docs)).collect():
        assert r._kept.encode() == first[r.doc_id is not None, r.doc_id or 0, r.text]
    assert line_dedup.keep_lines(empty, line_dedup.keep_bitmaps(empty, min_docs=2)).count() == 0


def test_line_dedup_over_partitions(spark):
    """A frequent line whose rows end up in several partitions, in some of them fewer than the bound."""
    df = spark.createDataFrame([(i, f"often\nown {i}" + ("\nrare" if i < 9 else "")) for i in range(40)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "3", "7", "30"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = line_dedup.keep_lines(df, line_dedup.keep_bitmaps(df, min_docs=10)).collect()
        assert all(r._n_dropped == 1 and "often" not in r._kept for r in got)
        first = line_dedup.keep_lines(df, line_dedup.keep_bitmaps(df)).collect()
        assert sum("often" in r._kept for r in first) == sum("rare" in r._kept for r in first) == 1
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lm(docs, empty):
    got = lm.score(docs, F.col("doc_id") % 3 == 2, states=3, rounds=2).collect()
    rows = docs.collect()
    tokens = lambda r: [*data(r).lower().split(), None]
    c = Counter(w for r in rows if (r.doc_id or 0) % 3 != 2 for w in tokens(r))
    n, d = sum(c.values()), math.log10(sum(c.values()) + len(c) + 1)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(tokens(r)), sum(w in c for w in tokens(r)), round(sum(math.log10(c[w] + 1) - d for w in tokens(r)), 6)) for r in rows)
    assert sorted((r.doc if r.doc is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 for r in got)
    _, v, m = lm.trained(docs, F.col("doc_id") % 3 == 2, states=3, rounds=2)
    symbols = {w: i for i, w in enumerate(v.head)}
    classes = Counter()
    for w, k in c.items():
        if w is not None and lm.word_key(w) not in symbols:
            classes.update({(lm.word_class(w), "tokens"): k, (lm.word_class(w), "words"): 1})

    def forward(words):
        """log10 of the sum over all state sequences, word by word."""
        total, a = 0.0, None
        for w in words:
            key = lm.END if w is None else lm.word_key(w)
            if key in symbols:
                emit = m.emit[symbols[key]]
            else:
                k = lm.word_class(w)
                emit = m.emit[len(symbols) + k] * (c[w] + 1) / (classes[k, "tokens"] + classes[k, "words"] + 1)
            a = (m.start if a is None else a @ m.move) * emit
            total, a = total + math.log10(a.sum()), a / a.sum()
        return total

    by_text = Counter((r.doc_id, round(forward(tokens(r)), 5)) for r in rows)
    assert by_text == Counter((r.doc, round(r.score, 5)) for r in got)
    assert lm.score(empty, F.lit(False)).count() == 0


def test_lm_recursions():
    """Against sums over all state sequences; long texts in parts."""
    rng = np.random.default_rng(1)
    m = lm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2).T)
    rows = [np.array(x, "u2") for x in ([1], [0, 3, 2], [4, 4, 1, 0])]

    def likelihood(x):
        a = m.start * m.emit[x[0]]
        for s in x[1:]:
            a = (a @ m.move) * m.emit[s]
        return math.log(a.sum())

    assert np.allclose(lm.log_likelihood(m, rows), [likelihood(x) for x in rows])
    start, move, emit, total = lm.expected(m, rows, np.ones(3, bool))
    assert np.isclose(total, sum(map(likelihood, rows))) and np.isclose(emit.sum(), 8) and np.isclose(move.sum(), 5) and np.isclose(start.sum(), 3)
    # A long text in overlapping segments gives the counts that it gives in one piece.
    x = rng.integers(0, 5, 5000).astype("u2")
    whole = lm.expected(m, [x], np.ones(1, bool))
    rows, core = [], []
    for at in range(0, len(x), 300):
        low, end = max(at - lm.OVERLAP, 0), min(at + 300, len(x))
        rows.append(x[low : end + lm.OVERLAP])
        core.append((at - low, end - low))
    cut = lm.expected(m, rows, np.arange(len(rows)) == 0, core)
    assert all(np.allclose(a, b, rtol=1e-3) for a, b in zip(whole[:3], cut[:3])) and np.isclose(cut[1].sum(), 4999)
    long = [rng.integers(0, 5, 3 * lm.PART + 7).astype("u2")]
    part, lm.PART = lm.PART, 1 << 30
    whole = lm.log_likelihood(m, long)
    lm.PART = part
    assert np.allclose(lm.log_likelihood(m, long), whole)


def test_lm_head(spark, monkeypatch):
    """A level of counts with more words than there is room for is taken in part."""
    monkeypatch.setattr(lm, "HEAD", 8)
    counts = spark.createDataFrame([(lm.END, 9, 0), (b"often", 50, 1), *((f"w{i:02d}".encode(), 3, i % 3) for i in range(40))], "word binary, c long, cls int")
    v = lm._vocabulary(counts)
    assert v.head == [lm.END, b"often", *(f"w{i:02d}".encode() for i in range(6))] and v.tokens == 179 and v.words == 42
    assert v.class_words.sum() == 34 and v.class_tokens.sum() == 102 and v.counts[:3].tolist() == [9, 50, 3]


def test_fingerprint(docs, empty, spark):
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, data(r)))
    got = {}
    for r in fingerprint.edited(docs).collect():
        got.setdefault(r.doc, []).append(r)
    for r, after in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = r.text or "", after.text or ""
        e = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
        want = (len(a), hashlib.sha256(e.encode()).hexdigest(), float(fingerprint.canonical(a) == fingerprint.canonical(e)), float(fingerprint.canonical(a) == fingerprint.canonical(b)))
        assert want in [(g.n_chars, g.edited_sha256, g.near_edited, g.near_next) for g in got[r.doc_id]]
    assert fingerprint.edited(empty).count() == 0
    clash = fingerprint.fingerprints(docs, hashed=lambda f: xxhash.xxh3_128_digest(f[:1])).collect()
    pairs = {(fingerprint.canonical(r.text or ""), r.fingerprint) for r in clash}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)


@pytest.mark.parametrize("hot", [1_000_000, 1])
def test_suffix_dedup(docs, empty, hot):
    rows = docs.collect()
    got = suffix_dedup.without_repeats(docs, hot=hot).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0)
    want = suffix_dedup.reference([data(r) for r in sorted(rows, key=key)])
    assert [(r._n_bytes, r._n_removed, r._n_spans, hashlib.sha256(bytes(r._kept)).hexdigest()) for r in sorted(got, key=key)] == want
    assert any(w[1] for w in want) and suffix_dedup.without_repeats(empty).count() == 0


def test_loser_tree():
    runs = [sorted(bytes(RNG.choice(b"ab") for _ in range(RNG.randrange(6))) for _ in range(RNG.randrange(9))) for _ in range(5)]
    coded = [(suffix_dedup.front_coded(r, 8)[0].tolist() if r else [], r) for r in runs]
    out = [(k, runs[r][i]) for k, r, i in suffix_dedup.LoserTree(coded)]
    assert [s for _, s in out] == sorted(sum(runs, []))
    for (_, a), (k, b) in zip(out, out[1:], strict=False):
        assert k == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_simhash(docs, empty, spark):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = np.array([simhash.fingerprint(data(r)) for r in rows], "u8")
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
                label[i] = min(label[i], label[j])
    least = {k: min((r.doc_id for r, x in zip(rows, label, strict=True) if x == k and r.doc_id is not None), default=None) for k in label}
    show = lambda rows: sorted(map(repr, rows))
    assert show((r.doc, r.fp, r.component) for r in got) == show((r.doc_id, int(f.astype("i8")), least[k]) for r, f, k in zip(rows, fps, label, strict=True))
    assert simhash.near_duplicates(empty).count() == 0
    base = RNG.getrandbits(63)
    near = {base ^ (1 << RNG.randrange(40)) ^ (1 << RNG.randrange(40)) for _ in range(90)} | {RNG.getrandbits(63) for _ in range(60)}
    frame = spark.createDataFrame([(x,) for x in near], "fp long")
    groups = []
    for bucket in (2048, 2):
        roots = {r.node: r.root for r in components.components(simhash.links(frame, bucket)).collect()}
        groups.append(roots)
    assert groups[0] == groups[1] and len(groups[0]) > 10


def test_quality():
    junk = lambda: " ".join([RNG.choice(WORDS)] * 60)
    texts = [(prose(60) if i % 2 else junk()).encode() for i in range(240)]
    model = quality.fit(texts[:160], [i % 2 for i in range(160)], filters=8, epochs=20)
    s = quality.scores(model, texts[160:])
    assert ((s > 0.5) == np.arange(80) % 2).mean() > 0.9
    assert len(quality.scores(model, [b"", b"x" * 300_000])) == 2 and quality.scores(quality.fit([], []), [b""])[0] == 0.5


def test_quality_forward():
    """Scores against a forward pass written out, on texts shorter and longer than a chunk."""
    texts = [b"", b"a", prose(9).encode(), prose(200).encode(), b"q" * 256, b"q" * 257]
    model = quality.fit([prose(30).encode() for _ in range(40)], [i % 2 for i in range(40)], size=3, filters=4, epochs=2)
    for t, got in zip(texts, quality.scores(model, texts), strict=True):
        parts = [[*t, *[256] * (256 - len(t))]] if len(t) <= 256 else [list(t[i : i + 256]) for i in [*range(0, len(t) - 256, 192), len(t) - 256]]
        pooled = []
        for p in parts:
            best = [max(sum(float(model.embed[p[at + w]][d]) * float(model.kernel[w * 3 + d][f]) for w in range(8) for d in range(3)) for at in range(0, 249, 2)) for f in range(4)]
            pooled.append([max(b + float(model.bias[f]), 0) for f, b in enumerate(best)])
        features = [max(c) for c in zip(*pooled)] + [sum(c) / len(c) for c in zip(*pooled)] + [min(c) for c in zip(*pooled)]
        z = float(model.base[0]) + sum((x - float(a)) / float(b) * float(o) for x, a, b, o in zip(features, model.mean, model.scale, model.out))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def test_quality_query(spark, tmp_path):
    """The query on a small table: held-out accuracy, long labelled texts in the sample, nulls and repeated rows."""
    from redactlake.llm import queries

    junk = lambda n: " ".join([RNG.choice(WORDS)] * n)
    texts = [(prose if i % 2 else junk)(2500 if i % 7 == 0 else 60) for i in range(300)] + [None, ""]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(5, texts[5], "x"), (None, texts[7], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(302)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op7_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.9
    learn, labels = quality.sample(queries.read(spark, str(tmp_path), "documents"), queries.read(spark, str(tmp_path), "labels"))
    assert sorted(learn) == sorted(t.encode() for t in texts if t is not None) and max(map(len, learn)) > 8192
    assert quality.sample(queries.read(spark, str(tmp_path), "documents").limit(0), queries.read(spark, str(tmp_path), "labels")) == ([], [])


def test_warc(spark):
    rows = [(1, "http://www.B.example.com/a?x=1#f", "<p>é</p>"), (2, "https://a.example.com:8080", "<p>é</p>"), (3, None, None), (4, "", ""), (5, "no url at all\r\n", "same"), (5, "no url at all\r\n", "same"), (None, "http://x/", "same"), (7, "http://x/", "x" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    archive = warc.write(df, block=2)
    got = sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.lookup(archive, df).collect())
    latest = {}
    for p, _, h in rows:
        latest[h or ""] = max(latest.get(h or "", -1), p or -1)
    want = sorted((p or -1, len((h or "").encode()), warc.sha1_base32((h or "").encode()), *(("response", None) if p == latest[h or ""] else ("revisit", latest[h or ""]))) for p, _, h in rows)
    assert got == want
    assert {c[0] for c in warc.Reader(archive).captures("http://x/")} == {None, 7} and warc.Reader(archive).captures("http://y/") == []
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.lookup(warc.write(none), none).count() == 0
    assert warc.url_key("http://u@www.B.Example.com:81/p?q#f") == "com,example,b,www:81)/p?q"


def test_packing(docs, empty):
    got = sorted(packing.pack(docs, PATH).collect(), key=lambda r: (r.sequence_id, r.offset))
    total, fill, last = 0, 0, None
    for r in got:
        fill = 0 if r.sequence_id != last else fill
        assert r.offset == fill
        fill, last, total = fill + r.length, r.sequence_id, total + r.length
        assert fill <= 1024
    encode = packing.token_encoder(PATH)
    ids = [encode(r.text or "") + (2).to_bytes(4, "little") for r in docs.collect()]
    assert total == sum(map(len, ids)) // 4
    short = sorted(zlib.crc32(x) for x in ids if len(x) <= 4096)
    assert sorted(r.ids_crc32 for r in got if r.doc not in (6, 7)) == short
    assert len({r.sequence_id for r in got}) <= -(-total // 1024) + 2
    assert packing.pack(empty, PATH).count() == 0


def test_packing_plan():
    counts = np.zeros(1025, "i8")
    for _ in range(5000):
        counts[min(1023, int(RNG.expovariate(1 / 300)) + 1)] += 1
    runs, n = packing.plan(counts)
    used = Counter()
    for r in runs:
        assert r.fill <= 1024 and r.fill == sum(x[0] for x in r.items)
        for length, rank, _ in r.items:
            used.update((length, k) for k in range(rank, rank + r.count))
    assert max(used.values()) == 1 and len(used) == counts.sum() and sum(r.count for r in runs) == n
    assert n <= 1.02 * (counts * np.arange(1025)).sum() / 1024 + 1


def test_ann(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 12)) * rng.uniform(0.5, 2, (700, 1))
    x[100:140] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] * 12), (1060, [1.0] * 3), (None, [1.0] * 12), (1080, [None] + [1.0] * 11)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = ann.nearest(df, block=50).collect()
    assert {r.query_id for r in got} == set(range(0, 700, 20))
    f = x.astype("f4").astype("f8")
    hit = 0
    for q in range(0, 700, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        s = (f * f[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(700), -s)) if i != q][:20]
        assert [r.rank for r in own] == list(range(1, 21)) and all(abs(s[r.vec_id] - r.score) < 1e-9 for r in own)
        assert own == sorted(own, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in own} & set(best))
    assert hit >= 0.9 * 20 * 35
    assert ann.nearest(df.where("vec_id > 900")).count() == 0


def test_ann_lists(spark):
    """Recall and the share of the table that is read, with calibrated bounds: where vectors have no structure, and
    where they have."""
    rng = np.random.default_rng(4)
    plain = rng.standard_normal((6000, 32))
    centres = rng.standard_normal((150, 32))
    for x, least, most in ((plain, 0.9, 0.9), (centres[rng.integers(0, 150, 6000)] + 0.3 * rng.standard_normal((6000, 32)), 0.9, 0.3)):
        x /= np.linalg.norm(x, axis=1)[:, None]
        index = ann.fit(x[ann.PROBES :], 1.0, 600)
        index = ann.calibrated(index, x[: ann.PROBES], x[ann.PROBES :], len(x), 20)
        held = ann.lists_of(index, x)
        counts = np.bincount([h[0] for h in held], minlength=len(index.centroids))
        size = np.bincount(np.concatenate(held), minlength=len(index.centroids))
        asked = np.arange(0, 6000, 20)
        read = ann.lists_for(index, x[asked], counts, 41)
        s = x[asked] @ x.T
        s[np.arange(len(asked)), asked] = -np.inf
        best = np.argsort(-s, axis=1)[:, :20]
        seen = np.mean([[bool(set(held[v]) & set(lists)) for v in row] for row, lists in zip(best, read)])
        assert seen >= least and np.mean([size[lists].sum() for lists in read]) / 6000 / np.mean([len(h) for h in held]) < most
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(plain[:3000])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df).collect()}
    s = plain[:3000:20] @ plain[:3000].T
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    assert len(got) == 3000 and np.mean([(20 * i, int(v)) in got for i, row in enumerate(np.argsort(-s, axis=1)[:, :20]) for v in row]) >= 0.9
