"""Canonical exact document fingerprints.

A text's canonical form is NFKC, case-folded, NFKC again, with white space folded to single spaces. Its fingerprint is
the 128-bit XXH3 of that form. Texts of one hash are then compared byte by byte: where they differ, each distinct form
gets a number behind the hash, so fingerprints are equal just if canonical forms are.

Only texts whose hash prefix occurs twice take part in the comparison. A bitmap tells which: it has some 64 slots a row,
2^24 to 2^28 of them (2 to 32 MB; beyond four million rows ever more texts take part, and in the end all do). Each batch
sends a form once, and what comes back is the forms that collide, which with 128 bits is an empty table. Of a form that many rows have, each task sends one.

Edited texts are compared by hash only: one that collides with a known form that it differs from gets the number behind
the known ones.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch, carried, parallelism, pieces, small_batches, utf8

SLOT_BITS, BUCKET_BITS = (24, 28), 32_768
#: Bytes of forms that a task knows it has sent already.
SENT = 32 << 20
#: Colliding hashes that are handled; more than a few would mean a broken hash.
COLLISIONS = 10_000


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(form: bytes) -> bytes:
    return xxhash.xxh3_128_digest(form)


def fingerprint(form: bytes, collisions: dict[bytes, list[bytes]], hashed=digest) -> str:
    h = hashed(form)
    forms = collisions.get(h)
    if forms is None:
        return h.hex()
    return f"{h.hex()}-{forms.index(form) if form in forms else len(forms)}"


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 if equal, else 0."""
    return float(a == b)


def collisions(df: DataFrame, text: str = "text", hashed=digest) -> dict[bytes, list[bytes]]:
    """Hashes that stand for different canonical forms, with these in order."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "fingerprints")
    source = df.select(utf8(text).alias("data"))
    shift = 64 - min(max((source.count() * 64).bit_length(), SLOT_BITS[0]), SLOT_BITS[1])

    def slot(h: bytes) -> int:
        return int.from_bytes(h[:8], "big") >> shift

    def forms(b):
        return (canonical(t.decode("utf-8", "replace")) for t in b.column(0).to_pylist())

    def slots(batches):
        for b in pieces(batches, "data"):
            yield pa.RecordBatch.from_arrays([pa.array([slot(hashed(f)) for f in forms(b)], pa.int64())], names=["slot"])

    twice = source.mapInArrow(slots, "slot long").groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    maps = twice.groupBy(F.expr(f"slot DIV {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("bits"))
    shared = {r["bucket"]: bytes(r["bits"]) for r in maps.collect()}  # a bit a slot

    def candidates(batches):
        """A form once for each task, or once for each SENT bytes of others."""
        sent, size = set(), 0
        for b in pieces(batches, "data"):
            seen = []
            for f in forms(b):
                h = hashed(f)
                bucket, bit = divmod(slot(h), BUCKET_BITS)
                if bucket in shared and shared[bucket][bit >> 3] >> (bit & 7) & 1 and f not in sent:
                    if size > SENT:
                        sent, size = set(), 0
                    sent.add(f)
                    size += len(f)
                    seen.append((h, f))
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in seen], pa.binary()), pa.array([zlib.compress(f, 1) for _, f in seen], pa.binary())], names=["h", "form"])

    def differing(batches):
        """Batches sorted by hash. Keeps the distinct forms of one hash, one as a rule."""
        at, found = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([at] * len(found), pa.binary()), pa.array(found, pa.binary())], names=["h", "form"])

        for b in batches:
            for h, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if h != at:
                    if len(found) > 1:
                        yield out()
                    at, found = h, []
                f = zlib.decompress(packed)
                if f not in found:
                    found.append(f)
        if len(found) > 1:
            yield out()

    kept = source.mapInArrow(candidates, "h binary, form binary").repartition("h").sortWithinPartitions("h").mapInArrow(differing, "h binary, form binary")
    got = scratch.table(kept, "collisions").limit(COLLISIONS + 1).collect()
    if len(got) > COLLISIONS:
        raise ValueError("the hash collides too often")
    out: dict[bytes, list[bytes]] = {}
    for r in got:
        out.setdefault(bytes(r["h"]), []).append(bytes(r["form"]))
    return {h: sorted(f) for h, f in out.items()}


def fingerprints(df: DataFrame, text: str = "text", to: str = "fingerprint", hashed=digest) -> DataFrame:
    """df with each text's fingerprint. Null texts count as empty; a column named as `to` is replaced, others may have
    any name; empty tables give none."""
    known = collisions(df, text, hashed)
    source, schema = carried(df, text, to)
    schema = schema.add(to, "string")

    def work(batches):
        for b in pieces(batches, "data"):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([fingerprint(canonical(t.decode("utf-8", "replace")), known, hashed) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)


_ROW = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _row(text: str, after: str, known: dict, hashed) -> tuple:
    n = len(text)
    edited = text[: n - n // 4] + after[: n // 4]
    a, b, c = (fingerprint(canonical(t), known, hashed) for t in (text, edited, after))
    return n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b), likeness(a, c)


def edited(df: DataFrame, doc: str = "doc_id", text: str = "text", hashed=digest) -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has the last quarter of its code points replaced by the first as many (or all) of the next
    document's, in the order of doc (null first), then text; the last one is followed by the first. Rows are
    range-partitioned by doc and the beginning of the text; a partition's last row, which needs the next partition's
    first one, is joined with that afterwards. Null texts are empty; other columns are not looked at; empty tables give
    none.
    """
    spark = df.sparkSession
    known = collisions(df.select(F.col(text).alias("text")), "text", hashed)
    ordered = df.select(F.col(doc).alias("doc"), utf8(text).alias("data")).repartitionByRange(parallelism(spark), F.col("doc"), F.substring("data", 1, 256)).sortWithinPartitions("doc", "data")
    kind = df.schema[doc].dataType.simpleString()
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    made = ", ".join(f"{n} {t}" for n, t in zip(_ROW, ("long", "string", "string", "string", "double", "double"), strict=True))

    def batch(docs, rows, extra, names):
        return pa.RecordBatch.from_arrays([docs, *(pa.array([r[k] if r else None for r in rows], t) for k, t in enumerate(kinds)), *extra], names=["doc", *_ROW, *names])

    def work(batches):
        """Each row once its successor is known. head: a partition's first text, tail: its last."""
        part, held, first = TaskContext.get().partitionId(), None, True
        marks = ["part", "head", "tail"]

        def out(docs, rows, head, tail):
            n = len(rows)
            return batch(docs, rows, [pa.array([part] * n, pa.int32()), pa.array([head, *[None] * (n - 1)], pa.binary()), pa.array([*[None] * (n - 1), tail], pa.binary())], marks)

        for b in pieces(batches, "data"):
            docs, texts = b.column(0), b.column(1).to_pylist()
            if held is not None:
                docs = pa.chunked_array([held[0], docs]).combine_chunks()
                texts = [held[1], *texts]
            read = [t.decode("utf-8", "replace") for t in texts]
            if len(texts) > 1:
                yield out(docs.slice(0, len(texts) - 1), [_row(x, y, known, hashed) for x, y in zip(read, read[1:], strict=False)], texts[0] if first else None, None)
                first = False
            held = docs.slice(len(texts) - 1), texts[-1]
        if held is not None:
            yield out(held[0], [None], held[1] if first else None, held[1])

    table = Scratch(spark, "edited").table(ordered.mapInArrow(work, f"doc {kind}, {made}, part int, head binary, tail binary"), "rows")
    # What follows each partition that has rows: a number for a task.
    parts = sorted(r["part"] for r in table.where("tail IS NOT NULL").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = table.where("head IS NOT NULL").select(F.col("part").alias("next"), F.col("head").alias("after"))
    ends = table.where("tail IS NOT NULL").select("doc", "part", "tail").join(F.broadcast(follows), "part").join(heads, "next").select("doc", "tail", "after")

    def join(batches):
        for b in pieces(batches, "tail"):
            rows = [_row(t.decode("utf-8", "replace"), a.decode("utf-8", "replace"), known, hashed) for t, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield batch(b.column(0), rows, [], [])

    return table.where("tail IS NULL").select("doc", *_ROW).unionByName(ends.mapInArrow(join, f"doc {kind}, {made}"))
