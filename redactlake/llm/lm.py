"""Hidden Markov language model, trained by Baum-Welch over all training documents.

1. Each batch of documents gets a dictionary of its own; documents become ids in it. One join of all dictionary
   entries with the corpus counts tells what each id stands for, so no vocabulary is broadcast and a hot word has one
   entry per batch.
2. Symbols are the HEAD - 1 commonest words (of equal counts the lesser by their bytes), the end, and classes of the
   others by their ends. A rarer word's probability
   is that of its class times its share of the class (one more than its count; unseen words share one place).
3. Baum-Welch: tasks run forward and backward over their documents, and their expected counts are added up across
   partitions; the model, of bounded size, goes back to the tasks. Long texts are trained on in segments that overlap:
   a segment's recursions begin and end OVERLAP tokens outside of it, and only what lies in it is counted, transitions
   into it included. So all transitions of a text count once, whatever its length.
4. The score of a text is the exact scaled forward recursion over all of it. Long texts are cut: what a later part
   does to each state is computed for all parts at once and then chained.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; one end token follows. Null texts are empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch, pieces, small_batches, utf8

STATES, ROUNDS = 12, 5
#: Words with a symbol of their own, and classes of the others.
HEAD, CLASSES = 16_384, 512
#: Tokens of a training segment, and before and behind it; of a part of a long text; at once in memory.
SEGMENT, OVERLAP, PART, AT_ONCE = 1024, 64, 8192, 1 << 20
#: Bytes of text that share a dictionary.
BATCH = 24 << 20
#: Weight of the unigram distribution in each state's emissions, in tokens.
PRIOR = 200.0
#: Symbols in a block of counts, and blocks added up at a time.
SYMBOLS, FAN_IN = 2048, 64
END = b"\xfe"


def word_key(word: bytes) -> bytes:
    """Long words by their hash, so that entries are of bounded size."""
    return word if len(word) <= 48 else b"\xff" + xxhash.xxh3_128_digest(word)


def word_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % CLASSES


def packed(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([ids & 0xFFFF, ids >> 16]).astype("<u2").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u2").astype("i8")
    n = len(halves) // 2
    return halves[:n] | halves[n:] << 16


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


@dataclass
class Vocabulary:
    head: list[bytes]  # symbol 0 is the end
    tokens: int
    words: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    counts: np.ndarray  # of symbols


def _dictionaries(df: DataFrame, doc: str, text: str, held_out, kind: str) -> DataFrame:
    """Rows of documents (ids in the batch's dictionary) and of dictionary entries (word not null)."""
    small_batches(df.sparkSession)
    source = df.select(F.col(doc).alias("doc"), F.coalesce(held_out, F.lit(False)).alias("held"), utf8(text).alias("data"))
    names = ["batch", "doc", "held", "n_tokens", "ids", "local", "word", "train", "cls"]
    kinds = [pa.int64(), None, pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32()]

    def work(batches):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(_gathered(pieces(batches, "data"))):
            known: dict[bytes, int] = {}
            new = known.setdefault
            rows = []
            for data in b.column(2).to_pylist():
                words = data.lower().split()
                words.append(END)
                rows.append(np.fromiter((new(w, len(known)) for w in words), "u4", len(words)))
            held = b.column(1).to_pylist()
            learn = [r for r, h in zip(rows, held, strict=True) if not h]
            train = np.bincount(np.concatenate(learn), minlength=len(known)) if learn else np.zeros(len(known), "i8")
            n, m, own = b.num_rows, len(known), task << 32 | k
            null = lambda i, size: pa.nulls(size, kinds[i] or b.column(0).type)
            yield pa.RecordBatch.from_arrays([pa.array([own] * n, pa.int64()), b.column(0), b.column(1), pa.array([len(r) for r in rows], pa.int64()), pa.array([packed(r) for r in rows], pa.binary()), *(null(i, n) for i in range(5, 9))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([own] * m, pa.int64()), *(null(i, m) for i in range(1, 5)), pa.array(range(m), pa.int32()), pa.array([word_key(w) for w in known], pa.binary()), pa.array(train, pa.int64()), pa.array([word_class(w) for w in known], pa.int32())], names=names)

    return source.mapInArrow(work, f"batch long, doc {kind}, held boolean, n_tokens long, ids binary, local int, word binary, train long, cls int")


def _gathered(batches):
    """Neighbouring batches as one of about BATCH bytes of text: larger ones have fewer dictionary entries in all."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(2).nbytes
        if size >= BATCH:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: (word, c, cls) of training tokens."""
    level = F.floor(F.log2("c") * 8)
    own = counts.where(F.col("word") != F.lit(END)).withColumn("level", level)
    levels = sorted(((r["level"], r["n"]) for r in own.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)  # some hundred rows at most
    # Whole levels of counts, and of the one that does not fit as many words as there is room for.
    room, cut = HEAD - 1, -1
    for at, n in levels:
        if n > room:
            cut = at
            break
        room -= n
    take = own.where(F.col("level") > cut).select("word", "c", "cls")
    part = own.where(F.col("level") == cut).orderBy(F.desc("c"), "word").limit(room).select("word", "c", "cls")
    chosen = take.collect() + (part.collect() if room else [])  # HEAD rows at most
    common = {bytes(r["word"]): r["c"] for r in chosen}
    words = [END, *sorted(common)]
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    tokens, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    class_tokens, class_words = np.zeros(CLASSES, "i8"), np.zeros(CLASSES, "i8")
    for r in own.groupBy("cls").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # CLASSES rows at most
        class_tokens[r["cls"]], class_words[r["cls"]] = r["c"], r["n"]
    for r in chosen:
        class_tokens[r["cls"]] -= r["c"]
        class_words[r["cls"]] -= 1
    return Vocabulary(words, tokens, kinds, class_tokens, class_words, np.concatenate([[ends], [common[w] for w in words[1:]], class_tokens]).astype("f8"))


def _encoded(table: DataFrame, counts: DataFrame, v: Vocabulary, kind: str) -> DataFrame:
    """(doc, held, n_tokens, n_known, base, rest, symbols): rest is the log probability of rare words in their classes."""
    symbols = F.broadcast(table.sparkSession.createDataFrame([(bytearray(w), i) for i, w in enumerate(v.head)], "word binary, symbol int"))  # HEAD rows at most
    known = counts.select("word", "c").join(symbols, "word", "left")
    entries = table.where("word IS NOT NULL").select("batch", "local", "word", "cls").join(known, "word", "left")
    # An entry of the head may be unseen in training only if it is the end.
    entries = entries.select(F.col("batch").alias("of"), "local", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("symbol", F.when(F.col("word") == F.lit(END), 0), F.col("cls") + len(v.head)).alias("symbol"))
    docs = table.where("word IS NULL").select("batch", "doc", "held", "n_tokens", "ids")
    h, all_log = len(v.head), np.log10(v.tokens + v.words + 1)
    within = np.log10(v.class_tokens + v.class_words + 1)

    def join(a: pa.Table, b: pa.Table) -> pa.Table:
        local = b.column("local").to_numpy()
        c, s = np.zeros(len(local), "f8"), np.zeros(len(local), "i8")
        c[local], s[local] = b.column("c").to_numpy(), b.column("symbol").to_numpy()
        logs = np.log10(c + 1)
        base, rare = logs - all_log, np.where(s >= h, logs - within[np.maximum(s - h, 0)], 0)
        out: list[tuple] = []
        for data in a.column("ids").to_pylist():
            ids = unpacked(data)
            out.append((int((c[ids] > 0).sum()), float(base[ids].sum()), float(rare[ids].sum()), zstandard.ZstdCompressor(level=1).compress(s[ids].astype("<u2").tobytes())))
        made = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.binary()))]
        return pa.table([*(a.column(n) for n in ("doc", "held", "n_tokens")), *made], names=["doc", "held", "n_tokens", "n_known", "base", "rest", "symbols"])

    return docs.groupBy("batch").cogroup(entries.groupBy("of")).applyInArrow(join, f"doc {kind}, held boolean, n_tokens long, n_known long, base double, rest double, symbols binary")


def _symbols(column: pa.Array) -> list[np.ndarray]:
    d = zstandard.ZstdDecompressor()
    return [np.frombuffer(d.decompress(x), "<u2") for x in column.to_pylist()]


def _time_major(rows: list[np.ndarray], core: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, symbols by time, active rows at each time, what of the symbols is in the core): rows sorted by falling
    length. core: the range of each row that counts."""
    sizes = np.array([len(r) for r in rows])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    starts = np.r_[0, np.cumsum(active)]
    flat, inside = np.empty(starts[-1], "i8"), np.ones(starts[-1], bool)
    for i, k in enumerate(order.tolist()):
        flat[starts[: sizes[i]] + i] = rows[k]
        if core is not None:
            low, high = core[k]
            inside[starts[:low] + i] = False
            inside[starts[high : sizes[i]] + i] = False
    return order, flat, active, inside


def expected(model: Model, rows: list[np.ndarray], opens: np.ndarray, core: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (start, move, emit) of segments and the log likelihood of all their tokens. opens: which begin
    a text; the others begin in the state distribution that the model's moves tend to. core: the range of each segment
    that counts (all of it). In single precision, which scaled numbers can do with; sums are in double."""
    order, flat, active, inside = _time_major(rows, core)
    k = len(model.start)
    at, whole = np.r_[0, np.cumsum(active)], bool(inside.all())
    moves, emits = model.move.astype("f4"), model.emit.astype("f4")
    # Emissions are looked up again going backward: kept for all times they would be as large as alpha.
    alpha, scale = np.empty((len(flat), k), "f4"), np.empty(len(flat), "f4")
    settled = np.linalg.matrix_power(model.move, 64)[0]
    a = np.where(opens[order][:, None], model.start, settled).astype("f4") * emits[flat[: active[0]]]
    for t, n in enumerate(active.tolist()):
        if t:
            a = (a[:n] @ moves) * emits[flat[at[t] : at[t] + n]]
        s = a.sum(1)
        a /= s[:, None]
        alpha[at[t] : at[t] + n], scale[at[t] : at[t] + n] = a, s
    move, b = np.zeros((k, k)), np.ones((active[-1], k), "f4")
    for t in range(len(active) - 2, -1, -1):
        n, m = active[t], active[t + 1]
        later = slice(at[t + 1], at[t + 1] + m)
        w = emits[flat[later]] * b / scale[later, None]
        move += alpha[at[t] : at[t] + m].T @ (w if whole else w * inside[later, None])
        alpha[later] *= b
        b = np.ones((n, k), "f4")
        b[:m] = w @ moves.T
    alpha[: active[0]] *= b
    if not whole:
        alpha *= inside[:, None]
    emit = np.stack([np.bincount(flat, alpha[:, j], len(model.emit)) for j in range(k)], 1)
    return alpha[: active[0]][opens[order]].sum(0, dtype="f8"), move * model.move, emit, float(np.log(scale.astype("f8")).sum())


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact natural-log likelihoods by the scaled forward recursion; texts are not empty."""
    k = len(model.start)
    rows, states, of = [], [], []
    for i, x in enumerate(texts):
        for at in range(0, len(x), PART):
            for j in [-1] if not at else range(k):
                rows.append(x[at : at + PART])
                states.append(j)
                of.append((i, at))
    order, flat, active, _ = _time_major(rows)
    state = np.array(states)[order]
    first = np.where(state[:, None] < 0, model.start, model.move[np.maximum(state, 0)])
    total, last = np.zeros(len(rows)), np.empty((len(rows), k))
    a, start = first * model.emit[flat[: active[0]]], 0
    for t, n in enumerate(active.tolist()):
        if t:
            last[n : len(a)] = a[n:]
            a = (a[:n] @ model.move) * model.emit[flat[start : start + n]]
        s = a.sum(1)
        a /= s[:, None]
        total[:n] += np.log(s)
        start += n
    last[: len(a)] = a
    where = np.empty(len(rows), "i8")
    where[order] = np.arange(len(rows))
    out, now = np.zeros(len(texts)), np.empty((len(texts), k))
    r = 0
    while r < len(rows):
        i, at = of[r]
        if not at:
            out[i], now[i] = total[where[r]], last[where[r]]
            r += 1
            continue
        own = where[r : r + k]
        high = total[own].max()
        mixed = (now[i] * np.exp(total[own] - high)) @ last[own]
        out[i] += high + np.log(mixed.sum())
        now[i] = mixed / mixed.sum()
        r += k
    return out


def initial(v: Vocabulary, states: int, seed: int = 0) -> Model:
    rng = np.random.default_rng(seed)
    share = (v.counts + 1) / (v.counts + 1).sum()
    emit = share[:, None] * np.exp(rng.standard_normal((len(share), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def _fitted(v: Vocabulary, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    share = (v.counts + 1) / (v.counts + 1).sum()
    emit = emit + PRIOR * share[:, None]
    start, move = start + 0.1, move + 0.1
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _round(encoded: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts over all partitions, in blocks that are added up FAN_IN at a time."""
    k, s = len(model.start), len(model.emit)
    n_blocks = -(-s // SYMBOLS)

    def work(batches):
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
        rows, opens, core, held = [], [], [], 0

        def add():
            a, b, c, _ = expected(model, rows, np.array(opens), core)
            start[:] += a
            move[:] += b
            emit[:] += c

        for b in batches:
            for x in _symbols(b.column(0)):
                for at in range(0, len(x), SEGMENT):
                    low, end = max(at - OVERLAP, 0), min(at + SEGMENT, len(x))
                    rows.append(x[low : end + OVERLAP])
                    opens.append(at == 0)
                    core.append((at - low, end - low))
                    held += len(rows[-1])
                    if held >= AT_ONCE:
                        add()
                        rows, opens, core, held = [], [], [], 0
        if rows:
            add()
        task = TaskContext.get().partitionId()
        blocks = [emit[i * SYMBOLS : (i + 1) * SYMBOLS].astype("<f4") for i in range(n_blocks)] + [np.vstack([start, move]).astype("<f4")]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([task] * len(blocks), pa.int32()), pa.array([x.tobytes() for x in blocks], pa.binary())], names=["block", "part", "counts"])

    def add_up(key, table):
        total = sum(np.frombuffer(x, "<f4").astype("f8") for x in table.column("counts").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    schema = "block int, part int, counts binary"
    counts = encoded.where("NOT held").select("symbols").mapInArrow(work, schema)
    parts = encoded.rdd.getNumPartitions()
    while True:
        parts = -(-parts // FAN_IN)
        counts = counts.select("block", F.expr(f"part DIV {FAN_IN}").cast("int").alias("part"), "counts").groupBy("block", "part").applyInArrow(add_up, schema)
        if parts <= 1:
            break
    got = {r["block"]: np.frombuffer(r["counts"], "<f4").astype("f8").reshape(-1, k) for r in counts.collect()}  # the model's size
    if not got:
        return np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
    last = got.pop(n_blocks)
    return last[0], last[1:], np.concatenate([got[i] for i in range(n_blocks)])


def trained(df: DataFrame, held_out, doc: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> tuple[DataFrame, Vocabulary, Model]:
    """The encoded table of all rows, and the vocabulary and model of those that are not held out."""
    scratch, kind = Scratch(df.sparkSession, "lm"), df.schema[doc].dataType.simpleString()
    table = scratch.table(_dictionaries(df, doc, text, held_out, kind), "batches")
    counts = scratch.table(table.where("train > 0").groupBy("word").agg(F.sum("train").alias("c"), F.min("cls").alias("cls")), "counts")
    v = _vocabulary(counts)
    encoded = scratch.table(_encoded(table, counts, v, kind), "encoded")
    for name in ("batches", "counts"):
        scratch.drop(name)
    model = initial(v, states)
    for _ in range(rounds):
        model = _fitted(v, *_round(encoded, model))
    return encoded, v, model


def score(df: DataFrame, held_out, doc: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """(doc, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    held_out: condition of rows that nothing is learned from (null: false). base_score is the unigram model's log10
    probability, score the hidden Markov model's. With no training rows all words are unseen. Repeated rows and null
    docs are rows like others. Empty tables give an empty result. Other columns are not looked at.
    """
    kind = df.schema[doc].dataType.simpleString()
    encoded, v, model = trained(df, held_out, doc, text, states, rounds)

    def work(batches):
        names = ["doc", "held_out", "n_tokens", "n_known", "base_score", "score"]
        held, size = [], 0

        def out():
            b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            like = log_likelihood(model, _symbols(b.column(6))) / np.log(10)
            return pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(like + b.column(5).to_numpy())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += sum(b.column(2).to_pylist())
            if size >= AT_ONCE:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    scored = encoded.mapInArrow(work, f"doc {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(v.tokens).cast("long"))
