"""SimHash near-duplicates, held to the similarity: links between texts whose sets of five-word shingles have a Jaccard
similarity of at least 0.8.

Pairs within 2 bits of 64 come from `simhash` and its bit-sliced comparison; a fingerprint is taken over the set. At
0.8 fingerprints differ in some 10 bits, where no blocks of agreed bits are left to search by, so what they leave is
found by an exact set-similarity join, and no link between different texts is missed. All pairs, from either source,
are counted on their whole sets.

Two sets of n and m shingles that are
alike have a common one among the first n - ceil(0.8 n) + 1 of the one and as many of the other, in any order that
all sets share. The order here is rare shingles first, by their counts in a sample of the texts: the sample decides
how much is compared, not what is found. Pairs with a common leading shingle whose sizes and places still allow 0.8
are candidates. Each set has 512 bits, the parities of its hashes' counts by their last 9 bits: two sets differ in at
least as many shingles as their bits do, so candidates whose bits differ in more than 0.8 allows are dropped. The
similarity of the others is counted from their whole sets.

Texts of one set are one node. A first round compares each node with two others at most: of the least nodes of its
rarest shingles, and of the greatest, those that it shares most leading shingles with. The second round compares all
that share a leading shingle and are not yet in one component. A large group of near copies is linked in the first
round, in as many pairs as it has nodes.

Shingles are told apart by 64 bits of hash, and so are sets. Case (ASCII) and white space are folded; a text of fewer
words is one shingle, a null one is empty, and empty texts are alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from redactlake.llm import simhash
from redactlake.llm.common import Scratch, pieces, small_batches, utf8
from redactlake.llm.components import components

WIDTH = 5
#: Of the texts, one in SAMPLE is counted for the order; the shingles found there most often come last in it.
SAMPLE, FREQUENT = 16, 1 << 16
SLOTS, BUCKET_BITS = 1 << 24, 32_768
#: Words of 64 bits of parities; leading shingles that a node looks for others by in the first round.
PARITIES, FIRST = 8, 8


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    words = data.lower().split()
    if not words:
        return np.empty(0, "i8")
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], "u8").view("i8")
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), "u8", len(words))
    n = len(h) - width + 1
    out = np.zeros(n, "u8")
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view("i8"))


def node_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype("i8"))


def parities(found: np.ndarray) -> np.ndarray:
    odd = np.bincount(found & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("<i8")


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set: a bit is set if it is set in over half its hashes. An empty set: 0."""
    ones = np.unpackbits(np.ascontiguousarray(found).view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(ones * 2 > len(found), bitorder="little").view("<i8")[0])


def alike(common: int, n: int, m: int) -> bool:
    """At least 0.8, in whole numbers."""
    return 5 * common >= 4 * (n + m - common)


def leading(found: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of the common order. frequent is sorted, rank its order among the last."""
    n = len(found)
    if n < 4:  # 0.8 takes equal sets
        return found[:0]
    late = np.zeros(n, "i8")
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
        late = np.where(frequent[at] == found, rank[at], 0)
    return found[np.lexsort((found, late))[: n - (4 * n + 4) // 5 + 1]]


def _texts(df: DataFrame, *names: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.select(*names, utf8("text").alias("_data"))


def _frequent(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts of the sample, sorted, and their ranks from 1 on, the most frequent one last."""

    def work(batches):
        for b in pieces(batches, "_data", 1 << 20):
            found = [shingles(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["h"])

    some = _texts(df).where(F.pmod(F.xxhash64("_data"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(work, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 3")
    got = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    rank = np.empty(len(h), "i8")
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    return h[order], rank[order]


def _nodes(df: DataFrame) -> DataFrame:
    """df (doc, text) to (doc, node, n, fp, bits, keys): the set's hash, its size, SimHash, parities and leading shingles."""
    frequent, rank = _frequent(df)
    source = _texts(df, "doc")

    def work(batches):
        for b in pieces(batches, "_data"):
            found = [shingles(x) for x in b.column(1).to_pylist()]
            keys = [leading(s, frequent, rank) for s in found]
            ends = np.cumsum([0, *map(len, keys)]).astype("i4")
            bits = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([parities(s) for s in found])), PARITIES).cast(pa.list_(pa.int64()))
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([node_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([fingerprint(s) for s in found], pa.int64()), bits, lists], names=["doc", "node", "n", "fp", "bits", "keys"])

    return source.mapInArrow(work, df.select("doc").schema.add("node", "long").add("n", "integer").add("fp", "long").add("bits", ArrayType(LongType())).add("keys", ArrayType(LongType())))


def _possible(a: str, b: str):
    """Sizes and places (from 0) of a common leading shingle that leave 0.8 open. For sets that are alike, their first common one does."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * most >= 4 * (n + m))


def _by_simhash(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that connect all nodes whose fingerprints differ in 2 bits or fewer: at most two for a node."""
    fps = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("v")), "fps")
    equal = nodes.select(F.col("node").alias("u"), "fp").join(fps, "fp").select("u", "v")
    ends = simhash.links(fps.select("fp")).toDF("a", "b")
    near = ends.join(fps.toDF("a", "u"), "a").join(fps.toDF("b", "v"), "b").select("u", "v")
    return equal.unionByName(near).where("u <> v")


def _closest(shared: DataFrame, end: str) -> DataFrame:
    """Of each node the pair (u, v) with that end node of one of its FIRST leading shingles that most of them have in common."""
    pairs = shared.where((F.col("x.pos") < FIRST) & (F.col("x.node") != F.col(f"{end}.node"))).where(_possible("x", end))
    many = pairs.groupBy(F.col("x.node").alias("u"), F.col(f"{end}.node").alias("v")).agg(F.count("*").alias("c"))
    return many.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v"))


def _alike(df: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the pairs (u, v) whose sets are alike."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "uv")
    differ = sum((F.bit_count(F.col("bits_u")[k].bitwiseXOR(F.col("bits_v")[k])) for k in range(PARITIES)), F.lit(0))
    pairs = scratch.table(pairs.join(a, "u").join(b, "v").where(9 * differ <= F.col("n_u") + F.col("n_v")).select("u", "v"), f"pairs-{name}")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    slot = ends.select(F.pmod("node", F.lit(SLOTS)).alias("slot")).distinct()
    maps = slot.groupBy(F.expr(f"slot DIV {BUCKET_BITS}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(slot % {BUCKET_BITS})").alias("bits"))
    wanted = {r["bucket"]: bytes(r["bits"]) for r in maps.collect()}  # 2 MB at most

    def sets(batches):
        for b in pieces(batches, "_data"):
            held = {}
            for x in b.column(0).to_pylist():
                s = shingles(x)
                bucket, bit = divmod((node := node_of(s)) % SLOTS, BUCKET_BITS)
                if bucket in wanted and wanted[bucket][bit >> 3] >> (bit & 7) & 1:
                    held[node] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.binary())], names=["node", "held"])

    def judge(batches):
        for whole in batches:
            for b in pieces([whole], "a"):
                keep = []
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, "i8"), np.frombuffer(y, "i8")
                    keep.append(alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
                yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    found = _texts(df).mapInArrow(sets, "node long, held binary").groupBy("node").agg(F.first("held").alias("held"))
    found = scratch.table(found, f"sets-{name}")
    both = pairs.join(found.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(found.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    out = scratch.table(both.select("u", "v", "a", "b").mapInArrow(judge, "u long, v long"), f"alike-{name}")
    scratch.drop(f"sets-{name}")
    scratch.drop(f"pairs-{name}")
    return out


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, node, component): each row's set of shingles and the least doc of all that similarities connect it with.

    A null doc gets its component too; it is null itself only where all docs of it are. Empty tables give none.
    """
    scratch = Scratch(df.sparkSession, "near")
    df = df.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    own = scratch.table(_nodes(df), "own")
    nodes = scratch.table(own.groupBy("node").agg(F.min("doc").alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bits").alias("bits")), "nodes")
    listed = own.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).select("node", "n", F.posexplode("keys").alias("pos", "key"))
    same = Window.partitionBy("key")
    row = F.struct("node", "n", "pos")
    shared = listed.select("key", row.alias("x"), F.min(row).over(same).alias("first"), F.max(row).over(same).alias("last")).where("first.node <> last.node")
    shared = scratch.table(shared, "shared")
    members = scratch.table(own.select("doc", "node"), "members")
    scratch.drop("own")  # the keys take the most room

    first = _by_simhash(nodes, scratch).unionByName(_closest(shared, "first")).unionByName(_closest(shared, "last"))
    first = first.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = _alike(df, nodes, first, scratch, "first")
    label = scratch.table(components(edges), "label")

    own_root = shared.select("key", "x", F.col("x.node").alias("node")).join(label, "node", "left").select("key", "x", F.coalesce("root", "node").alias("root"))
    apart = own_root.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    rest = scratch.table(own_root.join(apart, "key", "left_semi"), "rest")
    scratch.drop("shared")
    a, b = rest.select("key", "x", "root"), rest.select("key", F.col("x").alias("y"), F.col("root").alias("other"))
    second = a.join(b, (a["key"] == b["key"]) & (F.col("x.node") < F.col("y.node")) & (F.col("root") != F.col("other")) & _possible("x", "y"))
    second = second.select(F.col("y.node").alias("u"), F.col("x.node").alias("v")).distinct()
    more = _alike(df, nodes, second, scratch, "second")

    roots = components(edges.unionByName(more))
    # Tables, so that all rows of one component or one set need not meet in a task of the joins.
    member = scratch.table(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "member")
    least = scratch.table(member.groupBy("root").agg(F.min("least").alias("component")), "least")
    member = scratch.table(member.join(least, "root").select("node", "component"), "component")
    return members.join(member, "node").select("doc", "node", "component")
