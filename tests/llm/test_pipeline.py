"""The pipeline against its steps in plain Python."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redactlake.llm import near, quality

public_tokenizers = pytest.importorskip("public_tokenizers")
Tokenizer = pytest.importorskip("tokenizers").Tokenizer
RNG = random.Random(9)
WORDS = [f"{a}{b}" for a in ("ta", "lo", "mi", "ne", "ru", "sa") for b in ("n", "ra", "stu", "ve", "x")]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def test_pipeline(spark, tmp_path, monkeypatch):
    shared = prose(70)
    texts = [f"Footer of all\n{prose(60)}" for _ in range(20)] + [" ".join([RNG.choice(WORDS)] * 80) for _ in range(30)]
    texts += [prose(30) + " " + shared + " " + prose(20) for _ in range(4)] + [prose(50) for _ in range(26)]
    texts += [texts[-1], texts[-2], None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(not 20 <= i < 50)) for i in range(80)]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    learn = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    got_texts, got_labels = [(texts[i] or "").encode() for i in sorted(learn, key=lambda i: (str(i), i)) if texts[i] is not None], [learn[i] for i in sorted(learn, key=lambda i: (str(i), i)) if texts[i] is not None]
    model = quality.fit(got_texts, got_labels)
    score = quality.scores(model, [(t or "").encode() for t in texts])
    docs = {i: t for (i, t, *_), s in zip(rows, score, strict=True) if s >= 0.3}
    often = Counter(k for t in docs.values() for k in {x.strip().lower() for x in (t or "").split("\n")} - {""})
    docs = {i: "\n".join(x for x in (t or "").split("\n") if often[x.strip().lower()] < 10) for i, t in docs.items()}
    ids = sorted(docs)
    sets = {i: shingles(docs[i]) for i in ids}
    label = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if a > b and same(sets[a], sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    docs = {i: docs[i].encode() for i in ids if label[i] == i}
    count = Counter(d[k : k + 200] for d in docs.values() for k in range(len(d) - 199))
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, removed = {}, 0
    for i, d in docs.items():
        gone = {j for k in range(len(d) - 199) if count[d[k : k + 200]] > 1 for j in range(k, k + 200)}
        removed += len(gone)
        kept = bytes(x for j, x in enumerate(d) if j not in gone).decode("utf-8", "ignore")
        tokens = np.array(t.encode(kept, add_special_tokens=False).ids + [2], "<u4")
        first = (len(tokens) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(tokens), 1024)]):
            part = tokens[start : first if not start else start + 1024]
            want[i, piece] = (start, len(part), zlib.crc32(part.tobytes()))

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in out} == want and len(out) == len(want)
    assert len(docs) < 62 and removed > 0
    at: dict[int, int] = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024 and len(at) <= -(-sum(at.values()) // 1024) + 1


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def same(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_near_duplicates(spark):
    """Edited copies on both sides of 0.8, chains and a large group, against all pairs."""
    base = prose(120).split()
    edit = lambda words, *at: " ".join("new" + str(i) if i in at else w for i, w in enumerate(words))
    texts = [" ".join(base), " ".join(base).upper().replace(" ", "\n "), edit(base, 50), edit(base, 10, 60), edit(base, 10, 40, 70, 100), edit(base, 20, 50, 80, 110), " ".join(base[:100]), " ".join(base[:60])]
    group = prose(90).split()
    texts += [edit(group, i) for i in range(90)] + [prose(n) for n in (3, 4, 5, 8, 40, 200)] + ["a b c", "A  b c", "one two three four five six seven eight nine", "one two three four five six seven eight", None, "", " "]
    rows = list(enumerate(texts)) + [(None, texts[3]), (0, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if same(sets[a], sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    least = {k: min((d for (d, _), x in zip(rows, label, strict=True) if x == k and d is not None), default=None) for k in label}
    got = near.near_duplicates(df).collect()
    assert sorted(map(repr, ((r.doc, r.component) for r in got))) == sorted(map(repr, ((d, least[k]) for (d, _), k in zip(rows, label, strict=True))))
    docs = df.withColumns({"n_chars": F.length("text").cast("long")})
    assert {r.doc_id for r in corpus_pipeline.one_of_near(spark, docs, "").collect()} == {v for v in least.values() if v is not None}
    assert near.near_duplicates(df.limit(0)).count() == 0
