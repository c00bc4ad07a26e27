"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most 2 of 64 bits agree in at least two of four 16-bit blocks, so each distinct
fingerprint is put into six buckets of 32 agreed bits. In a bucket, fingerprints are stored vertically in blocks of
64: one word per bit position, one lane per fingerprint. A fingerprint is compared with a whole block by adding the
64 difference words into carry-save counters, and a block is abandoned once all its lanes exceed the radius. A bucket
reports a spanning star of each group it finds, not its pairs.

A bucket of more than BUCKET fingerprints is handled exactly in another way that no group size can slow: each of its
fingerprints is listed under itself and its 64 one-bit changes, and two are within 2 bits just if they share a listing.
"""

from __future__ import annotations

from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch, carried, pieces, small_batches
from redactlake.llm.components import components

RADIUS = 2
BUCKET = 2048
BLOCKS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
#: Planes between two looks at which blocks can be abandoned.
STRIDE = 16


def fingerprint(data: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half the hashes of the shingles, repeats included. No words: 0."""
    words = data.lower().split()
    if not words:
        return 0
    shingles = iter([b" ".join(words)]) if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(seed))
    ones, n = np.zeros(64, "i8"), 0
    while len(block := np.fromiter(islice(hashes, 1 << 15), "<u8")):
        ones += np.add.reduce(np.unpackbits(block.view("u1").reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype="u4")
        n += len(block)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """df without its text, with `fp`, long: the fingerprint as a signed integer. Null texts count as empty. A column
    named fp is replaced, others may have any name."""
    small_batches(df.sparkSession)
    source, schema = carried(df, text, text, "fp")
    schema = schema.add("fp", "long")

    def work(batches):
        for b in pieces(batches, "data"):
            fp = np.fromiter((fingerprint(x, width, seed) for x in b.column(b.num_columns - 1).to_pylist()), "u8", b.num_rows).view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], names=schema.names)

    return source.mapInArrow(work, schema)


def near_pairs(key: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with equal keys (sorted) within the radius (1 to 3), by bit-sliced comparison."""
    fp = fp.view("u8")
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    row = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if not len(row):
        return np.empty(0, "i8"), np.empty(0, "i8")
    bucket = np.repeat(np.arange(len(starts)), sizes)[row]
    place = row - starts[bucket]
    # Blocks of 64 lanes, none across buckets.
    per = np.where(sizes > 1, -(-sizes // 64), 0)
    base = np.r_[0, np.cumsum(per)]
    block, lane = base[bucket] + place // 64, place % 64
    held = np.zeros((base[-1], 64), "u8")
    held[block, lane] = fp[row]
    owner = np.full((base[-1], 64), -1, "i8")
    owner[block, lane] = row
    full = np.zeros(base[-1], "u8")
    np.bitwise_or.at(full, block, np.uint64(1) << lane.astype("u8"))
    bits = np.unpackbits(held.view("u1").reshape(-1, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").reshape(-1, 64, 8).copy().view("<u8")[:, :, 0]
    # A row meets the blocks of its bucket from its own on.
    meets = base[bucket + 1] - block
    query = np.repeat(np.arange(len(row)), meets)
    at = np.arange(len(query)) - np.repeat(np.cumsum(meets) - meets, meets) + block[query]
    ones, twos, over = (np.zeros(len(query), "u8") for _ in range(3))
    mine = fp[row]
    for k in range(64):
        d = planes[at, k] ^ (np.uint64(0) - ((mine[query] >> np.uint64(k)) & np.uint64(1)))
        carry = ones & d
        ones ^= d
        over |= twos & carry
        twos ^= carry
        if k % STRIDE == STRIDE - 1:
            lost = over | _beyond(ones, twos, radius)
            go = (lost & full[at]) != full[at]
            query, at, ones, twos, over = query[go], at[go], ones[go], twos[go], over[go]
    near = full[at] & ~(over | _beyond(ones, twos, radius))
    hit = np.unpackbits(near.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    i, j = np.nonzero(hit)
    a, b = row[query[i]], owner[at[i], j]
    return a[a < b], b[a < b]


def _beyond(ones: np.ndarray, twos: np.ndarray, radius: int) -> np.ndarray:
    if radius == 1:
        return twos
    return ones & twos if radius == 2 else np.zeros_like(ones)


def _stars(fp: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the groups of the pairs, at most one per fingerprint."""
    label = np.arange(len(fp))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(fp))
    return fp[moved], fp[label[moved]]


def _bucket_links(batches):
    """Batches (key, fp) sorted by key, buckets bounded: a bucket cut by a batch's end is carried on."""
    carry = None

    def links(b):
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
        u, v = _stars(fp, *near_pairs(key, fp))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        if not b.num_rows:
            continue
        if carry is not None:
            b = pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
        key = b.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        carry = b.slice(cut)
        if cut:
            yield links(b.slice(0, cut))
    if carry is not None:
        yield links(carry)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) to edges (u, v) that connect all that are within 2 bits of each other."""
    block = lambda i: F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)
    keys = F.array(*(F.lit(k << 32).cast("long") + F.shiftleft(block(a), 16) + block(b) for k, (a, b) in enumerate(BLOCKS)))
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    # A table, so that both sides of the joins are plain exchanges, which the engine splits at a hot bucket.
    counts = Scratch(fps.sparkSession, "buckets").table(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = keyed.join(counts.where(F.col("n") <= bucket), "key").select("key", "fp")
    found = shared.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_links, "u long, v long")
    hot = keyed.join(counts.where(F.col("n") > bucket), "key", "left_semi").select("fp").distinct()
    changes = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(np.uint64(1 << i).astype("i8").item())) for i in range(64)))
    listed = hot.select("fp", F.explode(changes).alias("at"))
    # At most 65 fingerprints are listed at a place.
    least = listed.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("at", "v")
    return found.unionByName(listed.join(least, "at").select(F.col("fp").alias("u"), "v").where("u <> v").distinct())


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(doc, fp, component): each row's fingerprint and the least doc of all that fingerprints connect it with.

    Null and empty texts have fingerprint 0 and are linked like any other. A null doc gets its component too; it is
    null itself only where all docs of it are. Repeated rows are linked with each other. Empty tables give none.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    own = scratch.table(fingerprints(df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))), "fp")
    fps = scratch.table(own.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), bucket))
    # Tables, so that all rows of one component or one fingerprint need not meet in a task of the joins.
    member = scratch.table(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "member")
    least = scratch.table(member.groupBy("root").agg(F.min("least").alias("component")), "least")
    member = scratch.table(member.join(least, "root").select("fp", "component"), "component")
    return own.join(member, "fp").select("doc", "fp", "component")
