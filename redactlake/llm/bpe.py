"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a word is a chain: the last token of a prefix, preceded by the encoding of what is left of it. So one
state, the last token, describes a prefix completely, and a depth-first walk of the trie of all distinct words finds
each state from those of its ancestors: a shared prefix is encoded once. A token may follow another if plain merging
of the two tokens' bytes gives these two tokens again; such answers are remembered.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from redactlake.llm.common import carried, pieces, small_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Parts that a worker caches before it begins anew, and looks into what it had for as long again.
CACHE_ENTRIES = 250_000
#: Bytes of text that a worker encodes at a time.
ENCODE_BYTES = 4 << 20
#: Pairs of tokens whose answers a worker remembers.
FOLLOWS_ENTRIES = 500_000
#: Words in one trie; bytes from which a word goes through the automaton by itself; characters from which a part is not
#: cached.
TRIE_WORDS, LONG_WORD, LONG_PART = 50_000, 512, 512


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str) -> tuple[dict, dict[int, bytes], dict[str, int]]:
    """The model, the bytes of each token, and the special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return spec["model"], {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in special}, special


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """By id."""
    _, bytes_of, special = load(path)
    bytes_of |= {i: s.encode() for s, i in special.items()}
    return [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str):
        model, self.bytes_of, self.special = load(path)
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        of = lambda s: model["vocab"][s]
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[of(a), of(b)] = (rank, of(a + b))
        self.halves = {made: (rank, a, b) for (a, b), (rank, made) in self.merges.items()}
        self.size = max([*self.bytes_of, *self.special.values()]) + 1

    def apart(self, a: int, b: int, until: int = 1 << 30) -> bool:
        """Whether merging the bytes of a and b, up to the rank until, never joins them.

        Takes the merges that made a and b back, the latest first. At each point two smaller tokens meet between a
        and b; if these would have merged before the merge just taken back, that one never took place.
        """
        merges, halves = self.merges, self.halves
        while True:
            join = merges.get((a, b))
            if join is not None and join[0] < until:
                return False
            ha, hb = halves.get(a), halves.get(b)
            if ha is None and hb is None:
                return True
            # Of equal ranks the left one merged first, so the right one is taken back first.
            if hb is None or (ha is not None and ha[0] > hb[0]):
                until, a = min(until, ha[0]), ha[2]
            else:
                until, b = min(until, hb[0] + 1), hb[1]

    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        half = self.halves.get(token)
        return half is None or (self.apart(half[1], half[2], half[0]) and self.whole(half[1]) and self.whole(half[2]))


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.starts = {t[:k] for t in vocabulary.id_of for k in range(len(t) + 1)}
        self.packed = [i.to_bytes(4, "little") for i in range(vocabulary.size)]
        self.follows: dict[int, bool] = {}
        # States of the automaton of all tokens, made as they are met: the longest end of a prefix that begins a token.
        self.state_of: dict[bytes, int] = {b"": 0}
        self.strings = [b""]
        self.ends: list[tuple[tuple[int, int], ...]] = [()]
        self.moves: dict[int, int] = {}

    def may_follow(self, before: int, token: int) -> bool:
        """before -1: at the start of a word."""
        v = self.vocabulary
        found = v.whole(token) and (before < 0 or v.apart(before, token))
        if len(self.follows) > FOLLOWS_ENTRIES:
            self.follows.clear()
        self.follows[before << 20 | token] = found
        return found

    def move(self, state: int, b: int) -> int:
        end = self.strings[state] + bytes((b,))
        while end not in self.starts:
            end = end[1:]
        to = self.state_of.get(end)
        if to is None:
            to = self.state_of[end] = len(self.strings)
            self.strings.append(end)
            ids = self.vocabulary.id_of
            self.ends.append(tuple((len(end) - k, ids[end[k:]]) for k in range(len(end)) if end[k:] in ids))
        self.moves[state << 8 | b] = to
        return to

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct word with its ids as little-endian unsigned 32-bit integers."""
        held = []
        for word in words:
            if len(word) >= LONG_WORD:
                yield word, self._alone(word)
                continue
            held.append(word)
            if len(held) == TRIE_WORDS:
                yield from self._walk(held)
                held = []
        yield from self._walk(held)

    def _walk(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Depth-first over the words' trie. It is kept flat, as the sorted words and how many bytes each shares with
        the one before: a word's nodes below that depth are its own, those above are the path walked last."""
        words.sort()
        sizes = np.fromiter(map(len, words), "i8", len(words))
        shared = np.zeros(len(words), "i8")
        if len(words) > 1:
            rows = np.array(words).view("u1").reshape(len(words), -1)
            differs = rows[1:] != rows[:-1]
            shared[1:] = np.where(differs.any(1), differs.argmax(1), np.minimum(sizes[1:], sizes[:-1]))
        ends, moves, follows, packed = self.ends, self.moves, self.follows, self.packed
        # By depth on the current path: the last token of that prefix, its bytes, the automaton's state.
        last, length, states = [-1], [0], [0]
        for word, depth in zip(words, shared.tolist(), strict=True):
            del last[depth + 1 :], length[depth + 1 :], states[depth + 1 :]
            state = states[depth]
            for b in word[depth:]:
                depth += 1
                to = moves.get(state << 8 | b)
                state = self.move(state, b) if to is None else to
                for k, token in ends[state]:  # the longest first; just one is right
                    before = last[depth - k]
                    ok = follows.get(before << 20 | token)
                    if self.may_follow(before, token) if ok is None else ok:
                        break
                else:
                    raise ValueError("no token can end here")
                last.append(token)
                length.append(k)
                states.append(state)
            out = []
            while depth:
                out.append(packed[last[depth]])
                depth -= length[depth]
            out.reverse()
            yield word, b"".join(out)

    def _alone(self, word: bytes) -> bytes:
        """The ids of one word, in some ten bytes of memory for each of its own."""
        ends, moves, follows = self.ends, self.moves, self.follows
        last, length, state = array("i", [-1]), array("i", [0]), 0
        for depth, b in enumerate(word, 1):
            to = moves.get(state << 8 | b)
            state = self.move(state, b) if to is None else to
            for k, token in ends[state]:
                before = last[depth - k]
                ok = follows.get(before << 20 | token)
                if self.may_follow(before, token) if ok is None else ok:
                    break
            else:
                raise ValueError("no token can end here")
            last.append(token)
            length.append(k)
        out, at = array("I"), len(word)
        while at:
            out.append(last[at])
            at -= length[at]
        out.reverse()
        return out.tobytes()


class TextEncoder:
    """Whole texts to ids and back.

    Texts are cut at single spaces and line ends that stand between other characters, where no token crosses. The
    ids of such parts are cached; a text with any other white space is cut by the pattern alone.
    """

    def __init__(self, vocabulary: Vocabulary, cache_entries: int = CACHE_ENTRIES):
        self.vocabulary = vocabulary
        self.trie = TrieEncoder(vocabulary)
        self.find = regex.compile(PATTERN).findall
        self.limit = cache_entries
        self.first: dict[str, bytes | None] = {}  # of parts that begin a line; None: not to be cut there
        self.after: dict[str, bytes | None] = {}  # of parts that follow a space, which is theirs
        self.aged: tuple[dict, dict] = ({}, {})  # what was cached before the caches were last full
        self.newline = dict(self.trie.encode([b"\n"]))[b"\n"]
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(vocabulary.special, key=len, reverse=True))) if vocabulary.special else None

    def _learn(self, first: set[str], after: set[str]) -> None:
        cut: list[tuple[dict, str, list[str] | None]] = []
        for known, parts, space in ((self.first, first, ""), (self.after, after, " ")):
            for p in parts:
                if p.isalpha():  # one word of the pattern
                    cut.append((known, p, [space + p]))
                else:
                    cut.append((known, p, None if not p or p[0].isspace() or p[-1].isspace() else self.find(space + p)))
        ids = self._words({w for _, _, ws in cut if ws for w in ws})
        for known, p, ws in cut:
            known[p] = None if ws is None else ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws])

    def _words(self, words: set[str]) -> dict[str, bytes]:
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in words}
        return {by_bytes[b]: ids for b, ids in self.trie.encode(by_bytes)}

    def _segments(self, text: str) -> list[str]:
        if self.specials and any(s in text for s in self.vocabulary.special):
            return [s for s in self.specials.split(text) if s]
        return [text] if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special = self.vocabulary.special
        plans = [[s if s in special else [line.split(" ") for line in s.split("\n")] for s in self._segments(t)] for t in texts]
        first: set[str] = set()
        after: set[str] = set()
        for plan in plans:
            for lines in plan:
                if not isinstance(lines, str):
                    for line in lines:
                        first.add(line[0])
                        after.update(line[1:])
        if len(self.first) + len(self.after) > self.limit:
            self.aged, self.first, self.after = (self.first, self.after), {}, {}
        long = [[p for p in parts if len(p) > LONG_PART] for parts in (first, after)]
        for known, old, parts in zip((self.first, self.after), self.aged, (first, after), strict=True):
            known.update((p, old[p]) for p in parts.difference(known) if p in old)
        self._learn(first.difference(self.first), after.difference(self.after))
        out = []
        for plan in plans:
            got = []
            for lines in plan:
                if isinstance(lines, str):
                    got.append(self.trie.packed[special[lines]])
                    continue
                try:
                    got.append(self.newline.join([self.first[x[0]] + b"".join(map(self.after.__getitem__, x[1:])) for x in lines]))
                except TypeError:  # a part is None
                    words = self.find("\n".join(map(" ".join, lines)))
                    ids = self._words(set(words))
                    got.append(b"".join(map(ids.__getitem__, words)))
            out.append(b"".join(got))
        for known, parts in zip((self.first, self.after), long, strict=True):
            for p in parts:
                known.pop(p, None)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """One per worker process, whose caches later tasks find filled."""
    return TextEncoder(vocabulary(path))


def encode(df: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """Adds `ids`, binary: the ids of the whole text (null: empty) as little-endian unsigned 32-bit integers.

    decoded: name of a further column, the text that the ids give again. Extra columns stay; equal rows give equal
    ids; empty tables give empty results. A column named ids or as `decoded` is replaced, others may have any name.
    Texts go to workers in batches of bounded bytes, words of any length take memory in proportion; nothing is shuffled.
    """
    small_batches(df.sparkSession)
    source, schema = carried(df, text, "ids", decoded)
    n = len(schema)
    schema = schema.add("ids", "binary")
    if decoded:
        schema = schema.add(decoded, "string")

    def work(batches):
        e = encoder(path)
        of = token_bytes(path) if decoded else []
        for b in pieces(batches, "data", ENCODE_BYTES):
            ids = e.encode([t.decode("utf-8", "replace") for t in b.column(n).to_pylist()])
            made = [pa.array(ids, pa.binary())]
            if decoded:
                made.append(pa.array([_decoded(x, of) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema.names)

    return source.mapInArrow(work, schema)


def _decoded(ids: bytes, of: list[bytes]) -> str:
    return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that ids stand for; null ids give the empty text. A column named as `to` is replaced."""
    source, schema = carried(df, ids, to)
    n = len(schema)
    schema = schema.add(to, "string")

    def work(batches):
        of = token_bytes(path)
        for b in pieces(batches, "data"):
            out = [_decoded(x, of) for x in b.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(out, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)
