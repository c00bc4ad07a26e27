"""Packing token pieces into sequences by linear grouping and best fit.

The plan depends on the counts of the piece lengths alone, at most `capacity` numbers, so it is made on the driver for
any size of corpus:

1. Linear grouping: pieces over a sixth of the capacity, longest first, are cut into groups of equal cardinality, and
   each group's lengths are rounded up to its longest.
2. The few rounded sizes are packed by configurations: again and again the fullest one, by dynamic programming over
   what is left, that holds the largest size left; each is used as often as the groups allow.
3. Actual pieces take the places of their group, longest first, which leaves the room that rounding had taken.
4. Small pieces, longest first, go where they fit best.

All of it works on runs of equal sequences. A piece's place follows from its length and its rank among pieces of that
length: ranks are a count within its task plus the counts of the tasks before, so nothing is gathered anywhere.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactlake.llm import bpe
from redactlake.llm.common import Scratch, pieces, small_batches, utf8

CAPACITY = 1024
END = 2
GROUPS = 96
#: Pieces of at most this share of the capacity are small.
SMALL = 6


@dataclass
class Run:
    """`count` sequences from `first` on, alike: items are (length, rank of the first one's piece, offset)."""

    first: int
    count: int
    items: tuple[tuple[int, int, int], ...]
    fill: int

    def split(self, n: int) -> tuple[Run, Run]:
        rest = tuple((length, rank + n, at) for length, rank, at in self.items)
        return Run(self.first, n, self.items, self.fill), Run(self.first + n, self.count - n, rest, self.fill)

    def with_piece(self, length: int, rank: int) -> Run:
        return Run(self.first, self.count, (*self.items, (length, rank, self.fill)), self.fill + length)


def grouped(counts: np.ndarray, least: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, its segments [length, first rank, count]) of equally large groups, longest first."""
    total = int(counts[least:].sum())
    out: list[tuple[int, list[list[int]]]] = []
    each, room = -(-total // groups) if total else 0, 0
    for length in range(len(counts) - 1, least - 1, -1):
        left, rank = int(counts[length]), 0
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append([length, rank, n])
            left, rank, room = left - n, rank + n, room - n
    return out


def fullest(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How often each size is in the fullest configuration with the first size that is left. Sizes fall."""
    lead = next(i for i, n in enumerate(left) if n)
    use = [0] * len(sizes)
    use[lead] = 1
    room = capacity - sizes[lead]
    reach, steps = 1, []
    whole = (1 << (room + 1)) - 1
    for i in range(lead, len(sizes)):
        for _ in range(min(left[i] - (i == lead), room // sizes[i])):
            more = (reach | reach << sizes[i]) & whole
            steps.append((i, reach))
            reach = more
    at = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> at & 1:
            use[i] += 1
            at -= sizes[i]
    return use


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[Run], int]:
    """Runs of sequences for counts[length] pieces of each length, and the number of sequences."""
    least = capacity // SMALL + 1
    parts = grouped(counts, least, groups)
    sizes, left = [s for s, _ in parts], [sum(x[2] for x in segments) for _, segments in parts]
    queue = [list(segments) for _, segments in parts]
    by_room: list[list[Run]] = [[] for _ in range(capacity + 1)]
    occupied, total = 0, 0

    def put(run: Run) -> None:
        nonlocal occupied
        by_room[capacity - run.fill].append(run)
        occupied |= 1 << (capacity - run.fill)

    while any(left):
        use = fullest(sizes, left, capacity)
        times = min(left[i] // n for i, n in enumerate(use) if n)
        slots = [i for i, n in enumerate(use) for _ in range(n)]
        for i, n in enumerate(use):
            left[i] -= n * times
        # Each slot takes `times` pieces of its group; runs end where a slot's length changes.
        taken = []
        for i in slots:
            need, own = times, []
            while need:
                segment = queue[i][0]
                n = min(need, segment[2])
                own.append((segment[0], segment[1], n))
                segment[1] += n
                segment[2] -= n
                if not segment[2]:
                    queue[i].pop(0)
                need -= n
            taken.append(own)
        at = [0] * len(slots)
        off = [0] * len(slots)
        done = 0
        while done < times:
            n = min(own[k][2] - o for own, k, o in zip(taken, at, off, strict=True))
            run = Run(total, n, (), 0)
            for own, k, o in zip(taken, at, off, strict=True):
                run = run.with_piece(own[k][0], own[k][1] + o)
            put(run)
            total, done = total + n, done + n
            for s, own in enumerate(taken):
                off[s] += n
                if off[s] == own[at[s]][2]:
                    at[s], off[s] = at[s] + 1, 0
    for size in range(min(least, capacity + 1) - 1, 0, -1):
        n, rank = int(counts[size]), 0
        while n:
            fits = occupied >> size
            if not fits:
                k = capacity // size
                many, rest = divmod(n, k)
                for count, each in ((many, k), (1, rest)):
                    if count and each:
                        run = Run(total, count, (), 0)
                        for _ in range(each):
                            run = run.with_piece(size, rank)
                            rank += count
                        put(run)
                        total += count
                break
            room = size + (fits & -fits).bit_length() - 1
            run = by_room[room].pop()
            if not by_room[room]:
                occupied &= ~(1 << room)
            if run.count > n:
                run, rest = run.split(n)
                put(rest)
            put(run.with_piece(size, rank))
            n, rank = n - run.count, rank + run.count
    return [r for runs in by_room for r in runs], total


def places(runs: list[Run], capacity: int = CAPACITY) -> list[np.ndarray]:
    """By length: rows (first rank, first sequence, offset) in order of rank."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    for r in runs:
        for length, rank, at in r.items:
            out[length].append((rank, r.first, at))
    return [np.array(sorted(x), "i8").reshape(-1, 3) for x in out]


#: White space that the compiled tokenizer's pattern may give up at, as it steps back through all of it, or a word that
#: takes it much memory.
LONG_RUN = 1 << 16
LONG_RUNS = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}|(?<!\S)\S{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def token_encoder(path: str):
    """text -> ids as bytes; the merges of the file by tiktoken, else, and for texts with very long runs, by the trie."""
    import tiktoken

    v = bpe.vocabulary(path)
    order = [made for _, made in sorted(v.merges.values())]
    if order != sorted(order):
        e = bpe.encoder(path)
        return lambda text: e.encode([text])[0]
    t = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=v.id_of, special_tokens=v.special)

    def encode(text: str) -> bytes:
        if len(text) >= LONG_RUN and LONG_RUNS.search(text):
            return bpe.encoder(path).encode([text])[0]
        special = any(s in text for s in v.special)
        return array("I", t.encode(text, allowed_special="all") if special else t.encode_ordinary(text)).tobytes()

    return encode


def token_pieces(df: DataFrame, path: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, task, nth): nth counts the task's pieces of that length.

    A document is its ids and `end`; only longer ones than the capacity are cut, the first piece being what is left.
    """
    small_batches(df.sparkSession)
    source = df.select(F.col(doc).alias("doc"), utf8(text).alias("_data"))
    schema = source.select("doc").schema
    for name, t in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("task", "integer"), ("nth", "long")):
        schema = schema.add(name, t)

    def work(batches):
        encode, task, seen = token_encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8")
        last = int(end).to_bytes(4, "little")
        for b in pieces(batches, "_data"):
            rows, of = [], []
            for i, data in enumerate(b.column(1).to_pylist()):
                ids = encode(data.decode("utf-8", "replace")) + last
                n = len(ids) // 4
                bounds = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    rows.append((k, s, e - s, zlib.crc32(ids[4 * s : 4 * e]), task, int(seen[e - s])))
                    seen[e - s] += 1
                    of.append(i)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=schema.names)

    return source.mapInArrow(work, schema)


def pack(df: DataFrame, path: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, groups: int = GROUPS) -> DataFrame:
    """(doc, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Null texts are empty: a piece of the end token. Null and repeated docs are packed like others. Empty tables give
    an empty result. Equal lengths take their places in the order of tasks.
    """
    found = Scratch(df.sparkSession, "pieces").table(token_pieces(df, path, doc, text, capacity, end), "pieces")
    per_task = found.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_task.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    counts = np.zeros(capacity + 1, "i8")
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    full, counts[capacity] = counts[capacity], 0
    runs, total = plan(counts, capacity, groups)
    where = places(runs, capacity)
    where[capacity] = np.array([[0, total, 0]] if full else [], "i8").reshape(-1, 3)
    ranked = found.join(offsets, ["task", "length"]).select("doc", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")

    def work(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), "i8"), np.empty(len(rank), "i8")
            for n in np.unique(length):
                own, table = length == n, where[n]
                at = np.searchsorted(table[:, 0], rank[own], "right") - 1
                sequence[own] = table[at, 1] + rank[own] - table[at, 0]
                offset[own] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(work, schema)
