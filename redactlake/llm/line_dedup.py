"""Line deduplication over range-partitioned line hashes.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. One row per document and distinct
key (a 128-bit hash, the document, the positions) is range-partitioned and sorted by hash, document: a hot key is
spread over as many partitions as its rows need. Each partition is streamed: runs of one hash are judged as they pass,
and only a run cut by a partition's edge waits for its neighbours, as a few rows. The result is one compressed keep
bitmap per document that loses lines; texts are not carried.

Rules: `min_docs=None` keeps a key's first occurrence by (doc_id, position) and drops the others; `min_docs=n` drops
every line whose key is found in n documents or more. A key shorter than `min_chars` code points is never dropped.
Documents are told apart by doc_id and text, so rows that repeat an id with another text are documents of their own:
null ids count like any other value, null texts are one empty line, repeated rows are one document. Ties are settled by doc_id, then text hash. Empty tables give empty results.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactlake.llm.common import Scratch, numbered, parallelism, pieces, place, small_batches, utf8

SPACE = b" \t\n\x0b\x0c\r"
_RUN = "h1 long, h2 long, dh long, doc {doc}, th long, n_lines int, first int, more binary"


def text_hash(text: str | Column) -> Column:
    return F.xxhash64(utf8(text))


def _hashes(df: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """A row per document and distinct key."""
    small_batches(df.sparkSession)
    source = df.select(F.xxhash64(F.col(doc)).alias("dh"), F.col(doc).alias("doc"), text_hash(text).alias("th"), utf8(text).alias("data"))
    kind = df.schema[doc].dataType.simpleString()

    def work(batches):
        for b in pieces(batches, "data"):
            rows, at = [], []
            for i, data in enumerate(b.column(3).to_pylist()):
                found: dict[bytes, list[int]] = {}
                lines = data.lower().split(b"\n")
                for k, line in enumerate(lines):
                    key = line.strip(SPACE)
                    if key and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        found.setdefault(key, []).append(k)
                for key, where in found.items():
                    rows.append((xxhash.xxh3_128_digest(key), len(lines), where[0], np.array(where[1:], "<i4").tobytes() if len(where) > 1 else None))
                    at.append(i)
            h = np.frombuffer(b"".join(r[0] for r in rows), "<i8").reshape(-1, 2)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), *(b.column(i).take(take) for i in range(3)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
                names=["h1", "h2", "dh", "doc", "th", "n_lines", "first", "more"],
            )

    return source.mapInArrow(work, _RUN.format(doc=kind))


def _judged(sorted_rows: DataFrame, min_docs: int | None, kind: str) -> DataFrame:
    """Streams each sorted partition. `drop`: the row's lines go (rest: but for the first). `open`: a run that a
    partition's edge may have cut; n: its rows here, on one of them (where it is judged already: the least number)."""
    extra = ["drop", "rest", "open", "n"]

    def out(b, drop, rest, waits, n):
        full = lambda x, t: pa.array(np.broadcast_to(np.asarray(x), b.num_rows), t)
        return pa.RecordBatch.from_arrays([*b.columns, full(drop, pa.bool_()), full(rest, pa.bool_()), full(waits, pa.bool_()), full(n, pa.int64())], names=[*b.schema.names, *extra])

    def runs(b):
        h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        return np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]), (h1[0], h2[0]), (h1[-1], h2[-1])

    def distinct(batches):
        """Repeated rows of a document once."""
        last = None
        for b in batches:
            if b.num_rows:
                k = np.stack([b.column(i).to_numpy() for i in (0, 1, 2, 4)], 1)
                new = np.r_[last is None or (k[0] != last).any(), (k[1:] != k[:-1]).any(1)]
                last = k[-1].copy()
                if new.any():
                    yield b.filter(pa.array(new))

    def firsts(batches):
        """Only a partition's first row can have an earlier one elsewhere; it and the lead of the last run wait."""
        held, last, opening = None, None, True
        for b in distinct(batches):
            starts, head, tail = runs(b)
            leads = starts[1:] if head == last else starts
            last = tail
            others = np.ones(b.num_rows, bool)
            others[leads] = False
            if others.any():
                yield out(b.filter(pa.array(others)), True, False, False, 0)
            for lead in leads[:1]:
                if held is not None:
                    yield out(held, False, True, opening, 0)
                    opening = False
                if len(leads) > 1:
                    yield out(b.slice(int(lead), 1), False, True, opening, 0)
                    opening = False
                    yield out(b.take(pa.array(leads[1:-1])), False, True, False, 0)
                held = b.slice(int(leads[-1]), 1)
        if held is not None:
            yield out(held, False, True, True, 0)

    def frequent(batches):
        """Holds a run back until it has min_docs rows; what is held is fewer rows than that."""
        least, carry, hot, begun = min_docs, None, None, False

        def ends(b):
            count = np.zeros(b.num_rows, "i8")
            count[0] = b.num_rows
            return out(b, False, False, True, count)

        for b in distinct(batches):
            if carry is not None:
                b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
                carry = None
            starts, head, tail = runs(b)
            sizes = np.diff(np.r_[starts, b.num_rows])
            gone = sizes >= least
            gone[0] |= head == hot
            if gone[-1]:
                hot = tail
            else:
                carry, hot = b.slice(int(starts[-1])), None
            if not begun and not gone[0] and len(starts) > 1:
                yield ends(b.slice(0, int(sizes[0])))
            begun = begun or gone[0] or len(starts) > 1
            rows = np.repeat(gone, sizes)
            if rows.any():
                # Its number also settles what a neighbouring partition has of the run.
                number = np.zeros(b.num_rows, "i8")
                number[starts[gone]] = least
                yield out(b.filter(pa.array(rows)), True, False, False, number[rows])
        if carry is not None:
            yield ends(carry)

    return sorted_rows.mapInArrow(firsts if min_docs is None else frequent, _RUN.format(doc=kind) + ", drop boolean, rest boolean, open boolean, n long")


def keep_bitmaps(df: DataFrame, doc: str = "doc_id", text: str = "text", min_docs: int | None = None, min_chars: int = 1) -> DataFrame:
    """A row (doc, th, n_lines, n_dropped, keep) for each document that loses lines. keep: zlib of the packed bits."""
    spark, kind = df.sparkSession, df.schema[doc].dataType.simpleString()
    scratch = Scratch(spark, "lines")
    rows = _hashes(df, doc, text, min_chars)
    order = ["h1", "h2", "doc", "th"]
    rows = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    judged = scratch.table(_judged(rows, min_docs, kind), "judged")
    waits = judged.where("open")
    if min_docs is None:
        # One waiting row per partition edge and hash: the first of all of them stays.
        rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.col("doc").asc_nulls_first(), "th"))
        settled = waits.withColumn("drop", rank > 1).withColumn("rest", rank == 1)
    else:
        lost = judged.where("n > 0").groupBy("h1", "h2").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs).select("h1", "h2")
        settled = waits.join(lost, ["h1", "h2"], "left_semi").withColumn("drop", F.lit(True))
    settled = judged.where("NOT open AND (drop OR (rest AND more IS NOT NULL))").unionByName(settled.where("drop OR (rest AND more IS NOT NULL)").select(judged.columns))
    schema = f"doc {kind}, th long, n_lines int, n_dropped int, keep binary"

    def bitmaps(batches):
        for b in batches:
            keep, dropped = [], []
            for n, rows in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                bits = np.ones(n, bool)
                for r in rows:
                    if r["drop"]:
                        bits[r["first"]] = False
                    if r["more"]:
                        bits[np.frombuffer(r["more"], "<i4")] = False
                keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
                dropped.append(int(n - bits.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dropped, pa.int32()), pa.array(keep, pa.binary())], names=["doc", "th", "n_lines", "n_dropped", "keep"])

    return settled.groupBy("doc", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_list(F.struct("first", "more", "drop")).alias("rows")).mapInArrow(bitmaps, schema)


def keep_lines(df: DataFrame, bitmaps: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df with `_n_lines`, `_n_dropped` and `_kept`, the text without the dropped lines. Columns of these
    names are replaced, others may have any name."""
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in ("_n_lines", "_n_dropped", "_kept")]
    k = len(keep)
    left = numbered(df).withColumn("th", text_hash(place(df, text)))
    marks = bitmaps.select(F.col("doc").alias("mark_doc"), F.col("th").alias("mark_th"), F.col("keep").alias("mark_keep"))
    joined = left.join(marks, F.col(place(df, doc)).eqNullSafe(F.col("mark_doc")) & (F.col("th") == F.col("mark_th")), "left")
    source = joined.select(*(f"c{i}" for i in keep), utf8(place(df, text)).alias("data"), "mark_keep")
    schema = StructType([df.schema.fields[i] for i in keep])
    for name, t in (("_n_lines", "long"), ("_n_dropped", "long"), ("_kept", "string")):
        schema = schema.add(name, t)

    def work(batches):
        for b in pieces(batches, "data"):
            lines_n, dropped_n, kept = [], [], []
            for data, mark in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist(), strict=True):
                lines = data.split(b"\n")
                lines_n.append(len(lines))
                if mark is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(mark), "u1"), count=len(lines)).tolist()
                    lines = [x for x, y in zip(lines, bits, strict=True) if y]
                dropped_n.append(lines_n[-1] - len(lines))
                kept.append(b"\n".join(lines).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(lines_n, pa.int64()), pa.array(dropped_n, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)
