"""Repeated-substring removal by a distributed merge sort of sampled suffixes.

A byte goes if it lies in a string of LENGTH bytes that also starts anywhere else. Sampling: of each window of LENGTH
bytes the 24-byte string with the least hash (the leftmost of equals) is its anchor, so equal windows have their
anchors at equal offsets, and only suffixes that start at anchors are sorted, about one in 90. Only windows that an
anchor is the anchor of are looked at from there.

1. Anchors whose 24 bytes occur elsewhere are found by hash, the rest are done with.
2. Each task sorts its remaining suffixes (LENGTH bytes from the anchor, led by the hash of their first 24, then the
   bytes before the anchor, backwards) into runs by key range. Runs are front-coded: the length of the prefix shared
   with the suffix before, and the rest.
3. A range's runs meet in one task, where a loser tree merges them. It keeps for each run the prefix its next suffix
   is known to share with the last winner: the longer one wins unread, and of equals only what follows is read.
4. The merged order's common prefixes tell which suffixes share r bytes; a sort of the bytes before the anchors tells
   which share l bytes backwards. A window that starts o bytes before its anchor is repeated just if another anchor
   shares o bytes backwards and LENGTH - o forwards.

Anchors of more than HOT occurrences (counted before step 2) would crowd one task; each of their windows is listed by
its 128-bit hash instead and counted with partial aggregation, which is exact as well.

Texts are told apart by 96 bits of hash; texts that occur twice are wholly repeated. Null texts are empty, ids are not
looked at, so null or repeated ones are no matter. Texts shorter than LENGTH stay as they are. Empty tables give none.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from redactlake.llm.common import Scratch, numbered, parallelism, pieces, place, small_batches, utf8

LENGTH = 200
SEED = 24
#: Occurrences from which an anchor's windows are counted by hash.
HOT = 1_000_000
#: Suffixes in a key range, about.
RANGE = 50_000
#: Bytes scanned for anchors at a time, and suffixes judged at a time.
SCAN_BYTES, JUDGED = 1 << 20, 50_000
_MASK = np.uint64((1 << 24) - 1)


def _tables():
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, 256, dtype="u8"), np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[:1] = 1
    return np.multiply.accumulate(out)


_BYTE, _BASE = _tables()
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def seed_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each string of `size` bytes."""
    if len(data) < size:
        return np.empty(0, "u8")
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * _powers(len(data), _BASE))]
    h = (sums[size:] - sums[:-size]) * _powers(len(data) - size + 1, _INVERSE)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours: of a block's end and the next block's beginning."""
    n = len(v) - w + 1
    padded = np.concatenate([v, np.full(-len(v) % w + w, np.iinfo("u8").max, "u8")]).reshape(-1, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the text's anchors in order, their hashes, and how far before them, at least and at most, the
    windows start whose anchors they are."""
    n = len(data) - length + 1
    at_all, h_all, low, high = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "i8")]
    for base in range(0, max(n, 0), SCAN_BYTES):
        part = np.frombuffer(data, "u1", min(len(data) - base, SCAN_BYTES + length - 1), base)
        h = seed_hashes(part, seed)
        of = (_window_min((h & ~_MASK) | np.arange(len(h), dtype="u8"), length - seed + 1) & _MASK).astype("i8")
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])  # a later window never has an earlier anchor
        at, last = of[first], np.r_[first[1:], len(of)] - 1
        at_all.append(at + base)
        h_all.append(h[at].view("i8"))
        low.append(at - last)
        high.append(at - first)
    at, h, low, high = (np.concatenate(x) for x in (at_all, h_all, low, high))
    if len(at) and n > SCAN_BYTES:  # an anchor on both sides of a cut
        at, first = np.unique(at, return_index=True)
        h, low, high = h[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    return at, h, low, high


def _shared(a: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of sorted rows (padded bytes and sizes), the bytes each shares with the one before."""
    out = np.zeros(len(a), "i8")
    if len(a) > 1:
        differs = a[1:] != a[:-1]
        first = np.where(differs.any(1), differs.argmax(1), a.shape[1])
        out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def _padded(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), "i8", len(strings))
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), "u1").reshape(len(strings), width), sizes


def front_coded(strings: list[bytes], width: int) -> tuple[np.ndarray, list[bytes]]:
    shared = _shared(*_padded(strings, width))
    return shared, [s[k:] for s, k in zip(strings, shared.tolist(), strict=True)]


def pack_run(entries: list[tuple[bytes, bytes, int, int]], length: int) -> bytes:
    """Sorted (suffix, bytes before it backwards, text, tag and position) as one compressed run."""
    cols = []
    for k, width in ((0, length + 8), (1, length)):
        shared, rest = front_coded([e[k] for e in entries], width)
        cols += [shared.astype("<u2").tobytes(), np.fromiter(map(len, rest), "<u2", len(rest)).tobytes(), b"".join(rest)]
    ids = np.array([e[2:] for e in entries], "<i8").tobytes()
    head = np.array([len(entries), len(cols[2]), len(cols[5])], "<i8").tobytes()
    return zlib.compress(head + b"".join(cols) + ids, 1)


def unpack_run(run: bytes) -> tuple[list[int], list[bytes], list[bytes], np.ndarray]:
    """The shared prefixes, suffixes, bytes before, and (text, tag and position) of a run."""
    data = zlib.decompress(run)
    n, a, b = np.frombuffer(data, "<i8", 3).tolist()
    at = 24
    out = []
    for size in (a, b):
        shared = np.frombuffer(data, "<u2", n, at).tolist()
        sizes = np.frombuffer(data, "<u2", n, at + 2 * n).tolist()
        at += 4 * n
        strings, last, end = [], b"", at
        for k, s in zip(shared, sizes, strict=True):
            last = last[:k] + data[end : end + s]
            strings.append(last)
            end += s
        at += size
        out.append((shared, strings))
    return out[0][0], out[0][1], out[1][1], np.frombuffer(data, "<i8", 2 * n, at).reshape(n, 2)


class LoserTree:
    """Merges sorted runs of (shared prefixes, strings). Yields (shared with the one before, run, position)."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        k = 1
        while k < max(len(runs), 2):
            k *= 2
        self.k, self.at = k, [0] * k
        self.text: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (k - len(runs))
        self.known = [0] * k  # bytes that a run's next string shares with the last winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(loser, winner). The loser's known prefix becomes the one it shares with the winner."""
        x, y = self.text[a], self.text[b]
        if x is None or y is None:
            return (a, b) if x is None else (b, a)
        i, j = self.known[a], self.known[b]
        if i != j:
            return (b, a) if i > j else (a, b)
        n = min(len(x), len(y))
        while i < n and x[i] == y[i]:
            if x[i : i + 32] == y[i : i + 32]:
                i = min(i + 32, n)
                continue
            i += 1
        loser, winner = (b, a) if (i == len(x) if i == n else x[i] < y[i]) else (a, b)
        self.known[loser] = i
        return loser, winner

    def __iter__(self):
        k, tree = self.k, [0] * self.k
        level = list(range(k))
        first = k
        while len(level) > 1:
            first //= 2
            up = []
            for n in range(0, len(level), 2):
                loser, winner = self._play(level[n], level[n + 1])
                tree[first + n // 2] = loser
                up.append(winner)
            level = up
        winner = level[0]
        while self.text[winner] is not None:
            yield self.known[winner], winner, self.at[winner]
            shared, strings = self.runs[winner]
            i = self.at[winner] = self.at[winner] + 1
            if i < len(strings):
                self.text[winner], self.known[winner] = strings[i], shared[i]
            else:
                self.text[winner] = None
            node = (winner + k) // 2
            while node:
                tree[node], winner = self._play(tree[node], winner)
                node //= 2


def repeated_offsets(groups: np.ndarray, right: np.ndarray, ahead: np.ndarray, before: list[bytes], length: int, seed: int) -> np.ndarray:
    """For anchors in merged order (whole groups of equal seeds), [i, o]: the window that starts o bytes before
    anchor i is repeated. right: bytes shared with the anchor before; ahead: bytes from the anchor to the end of the
    last window of its own; before: the bytes from the start of its first window to it, backwards."""
    n, offsets = len(groups), length - seed + 1
    order = sorted(range(n), key=lambda i: (groups[i], before[i]))
    rows, sizes = _padded([before[i] for i in order], length)
    left = _shared(rows, sizes)
    order = np.array(order)
    gs = groups[order]
    left[1:][gs[1:] != gs[:-1]] = -1
    left[0] = -1
    behind = np.empty(n, "i8")
    behind[order] = sizes
    right = right.copy()
    right[np.r_[True, groups[1:] != groups[:-1]]] = -1
    out = np.zeros((n, offsets), bool)
    to_left = np.empty(n, "i8")
    for o in range(offsets):
        ok = np.flatnonzero((behind >= o) & (ahead >= length - o))
        if len(ok) < 2:
            continue
        to_left[order] = np.cumsum(left < o)
        key = np.cumsum(right < length - o)[ok] * (n + 1) + to_left[ok]
        s = np.argsort(key, kind="stable")
        same = key[s][1:] == key[s][:-1]
        twice = np.r_[same, False] | np.r_[False, same]
        out[ok[s[twice]], o] = True
    return out


def _spans(covered: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes under each run of covered offsets."""
    edge = np.diff(np.pad(covered.astype("i1"), ((0, 0), (1, 1))), axis=1)
    row, low = np.nonzero(edge == 1)
    _, high = np.nonzero(edge == -1)
    return row, position[row] - (high - 1), position[row] - low + length


def _merge(runs: list[bytes], length: int, seed: int):
    """The spans that the runs of one range show to be repeated: (text, tag, start, end) arrays."""
    open_runs = [unpack_run(r) for r in runs]
    groups, right, ahead, before, ids, group = [], [], [], [], [], -1

    def judge():
        g, r, a = (np.array(x, "i8") for x in (groups, right, ahead))
        own = np.array(ids, "i8").reshape(-1, 2)
        # Equal surroundings twice: every window is repeated, and one of them stands for all.
        same = np.zeros(len(g), bool)
        b = before
        for i in range(1, len(g)):
            same[i] = g[i] == g[i - 1] and r[i] == a[i] == a[i - 1] and b[i] == b[i - 1]
        one = np.flatnonzero(~same)
        shared = np.minimum.reduceat(np.where(same, length, r), one) if len(one) else r
        of = np.cumsum(~same) - 1
        covered = repeated_offsets(g[one], shared, a[one], [b[i] for i in one.tolist()], length, seed)
        many = np.bincount(of, minlength=len(one)) > 1
        behind = np.array([len(b[i]) for i in one.tolist()])
        o = np.arange(length - seed + 1)
        covered[many] = (o <= behind[many, None]) & (length - o <= a[one][many, None])
        hit = np.flatnonzero(covered.any(1)[of])
        row, start, end = _spans(covered[of[hit]], own[hit, 1] & 0xFFFFFFFF, length)
        return own[hit[row], 0], own[hit[row], 1] >> 32, start, end

    for shared, run, i in LoserTree([r[:2] for r in open_runs]):
        _, strings, lefts, own = open_runs[run]
        if shared < 8 + seed:
            group += 1
            if len(groups) >= JUDGED:
                yield judge()
                groups, right, ahead, before, ids = [], [], [], [], []
        groups.append(group)
        right.append(max(shared - 8, 0))
        ahead.append(len(strings[i]) - 8)
        before.append(lefts[i])
        ids.append(own[i])
    if groups:
        yield judge()


def text_keys(text: str | Column) -> list[Column]:
    data = utf8(text)
    return [F.xxhash64(data).alias("text_hash"), F.hash(data).alias("text_tag")]


def repeated_spans(df: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """(text_hash, text_tag, spans): for texts with repeated strings, [start, end) byte ranges that may overlap."""
    spark = df.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "suffixes")
    source = df.select(*text_keys(text), utf8(text).alias("data")).where(F.length("data") >= length)

    def find(batches):
        for b in pieces(batches, "data"):
            rows, hs, ats = [], [], []
            for i, data in enumerate(b.column(2).to_pylist()):
                at, h, _, _ = anchors(data, length, seed)
                rows.append(np.full(len(at), i))
                ats.append(at)
                hs.append(h)
            take = pa.array(np.concatenate(rows))
            tag = b.column(1).take(take).to_numpy().astype("i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), b.column(0).take(take), pa.array(tag << 32 | np.concatenate(ats))], names=["seed", "text_hash", "at"])

    found = source.mapInArrow(find, "seed long, text_hash long, at long")
    # Copies of a text list the same places; an anchor counts only if two of its places differ. Both sides of the join
    # are tables, so that the engine can split it at a seed with most of the places.
    places = scratch.table(found.distinct(), "places")
    counts = scratch.table(places.groupBy("seed").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = counts.agg(F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0))).first()[0]
    n_ranges = max(parallelism(spark), -(-total // RANGE))
    shared = places.join(counts, "seed")
    per_text = shared.select("text_hash", F.shiftright("at", 32).cast("int").alias("text_tag"), F.struct(F.col("at").bitwiseAND(0xFFFFFFFF).alias("at"), (F.col("n") > hot).alias("hot")).alias("a"))
    per_text = per_text.groupBy("text_hash", "text_tag").agg(F.collect_set("a").alias("anchors"))
    texts = source.groupBy("text_hash", "text_tag").agg(F.first("data").alias("data")).join(per_text, ["text_hash", "text_tag"])

    def runs(batches):
        """Sorted front-coded runs by range; hash listings of hot windows (range -1)."""
        held: list[list] = [[] for _ in range(n_ranges)]
        size, names = 0, ["range", "run", "text_hash", "at", "o"]

        def flush():
            out = [(k, pack_run(sorted(x), length)) for k, x in enumerate(held) if x]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary()), *(pa.nulls(len(out), t) for t in (pa.int64(), pa.int64(), pa.int32()))], names=names)

        for b in pieces(batches, "data"):
            listed = []
            for th, tag, data, where in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                at, _, low, high = anchors(data, length, seed)
                own = np.searchsorted(at, [a["at"] for a in where])
                for a, lo, hi in zip(where, low[own].tolist(), high[own].tolist(), strict=True):
                    p = a["at"]
                    tp = tag << 32 | p
                    if a["hot"]:
                        listed += [(xxhash.xxh3_128_digest(data[p - o : p - o + length]), th, tp, o) for o in range(lo, hi + 1)]
                        continue
                    h = xxhash.xxh64_digest(data[p : p + seed])
                    held[int.from_bytes(h[:4], "big") * n_ranges >> 32].append((h + data[p : p + length - lo], data[p - hi : p][::-1], th, tp))
                    size += 1
            if listed:
                yield pa.RecordBatch.from_arrays([pa.array([-1] * len(listed), pa.int32()), *(pa.array([x[k] for x in listed], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.int32())))], names=names)
            if size > 200_000:
                yield flush()
                size = 0
        if size:
            yield flush()

    exchanged = scratch.table(texts.mapInArrow(runs, "range int, run binary, text_hash long, at long, o int"), "runs")

    def merge(key, table):
        out = list(_merge(table.column("run").to_pylist(), length, seed))
        cols = [np.concatenate([x[k] for x in out]) if out else np.empty(0, "i8") for k in range(4)]
        return pa.table({"text_hash": cols[0], "text_tag": cols[1].astype("i4"), "start": cols[2], "end": cols[3]})

    spans = exchanged.where("range >= 0").groupBy("range").applyInArrow(merge, "text_hash long, text_tag int, start long, end long")
    listed = exchanged.where("range < 0")
    where = F.struct("text_hash", F.col("at") - F.col("o"))  # a window may hold several hot anchors
    often = listed.groupBy("run").agg(F.min(where).alias("a"), F.max(where).alias("b")).where("a <> b").select("run")
    start = (F.col("at").bitwiseAND(0xFFFFFFFF) - F.col("o")).alias("start")
    spans = spans.unionByName(listed.join(often, "run", "left_semi").select("text_hash", F.shiftright("at", 32).cast("int").alias("text_tag"), start, (start + length).alias("end")))
    return spans.groupBy("text_hash", "text_tag").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(df: DataFrame, text: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """The rows of df with `_n_bytes`, `_n_removed`, `_n_spans` and `_kept`, the remaining bytes (binary). Columns of
    these names are replaced, others may have any name.

    as_text: `_kept` is a string; bytes of characters that were cut in two go as well.
    """
    scratch = Scratch(df.sparkSession, "spans")
    spans = scratch.table(repeated_spans(df, text, length, seed, hot), "spans")
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in ("_n_bytes", "_n_removed", "_n_spans", "_kept")]
    source, keys = numbered(df), ["text_hash", "text_tag"]
    marked = source.select("*", *text_keys(place(df, text)))
    # A table, so that the engine can split the join with the texts where one has most of the copies.
    copies = marked.groupBy(*keys).agg(F.count("*").alias("copies"))
    right = scratch.table(copies.join(spans, keys, "left").where("copies > 1 OR spans IS NOT NULL"), "marks")
    joined = marked.join(right, keys, "left").select(*(f"c{i}" for i in keep), utf8(place(df, text)).alias("data"), (F.coalesce("copies", F.lit(1)) > 1).alias("copied"), "spans")
    schema = StructType([df.schema.fields[i] for i in keep])
    for name, t in (("_n_bytes", "long"), ("_n_removed", "long"), ("_n_spans", "long"), ("_kept", "string" if as_text else "binary")):
        schema = schema.add(name, t)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())

    def work(batches):
        for b in pieces(batches, "data"):
            k, rows = len(keep), []
            for data, copied, found in zip(*(b.column(k + i).to_pylist() for i in range(3)), strict=True):
                n = len(data)
                if copied and n >= length:
                    rows.append((n, n, 1, b""))
                elif not found:
                    rows.append((n, 0, 0, data))
                else:
                    kept, at, merged = [], 0, []
                    for s, e in sorted((x["start"], x["end"]) for x in found):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], e)
                        else:
                            merged.append([s, e])
                    for s, e in merged:
                        kept.append(data[at:s])
                        at = e
                    kept = b"".join([*kept, data[at:]])
                    rows.append((n, n - len(kept), len(merged), kept))
            if as_text:
                rows = [(*r[:3], r[3].decode("utf-8", "ignore")) for r in rows]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=schema.names)

    return joined.mapInArrow(work, schema)


def reference(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """What the operator must give, by listing every window; for tests."""
    count: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len([1 for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out
