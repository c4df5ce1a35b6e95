"""Byte-level BPE by corpus-level merge replay.

The distinct words of a chunk of the corpus (rows of about CHUNK_BYTES together) are laid
out as one linked sequence of symbols. An inverted index holds, for each pair of
neighbouring symbols that a merge can join, the positions where it stands. Merges
are applied in rank order, each at all its positions at once; only the
neighbours that a merge touches are entered anew. Words are remembered across
batches (in two memories of about `memo` pieces each), so each is replayed about once for each task. The memories
go with the task; a worker keeps only the tables of the vocabulary.

A merge can create a pair of lower rank than its own, which then goes first. A
word in which that happens beside another place of the same merge is encoded
alone instead, so each word sees the same merges in the same order either way. A word that is itself in the
vocabulary is one token without merges, as in the tiktoken library.

Defined cases: null is the empty text, which has no tokens; ids without a token
and null id lists decode to an error and to null; repeated rows each give a row, null
ids are kept, an empty table gives an empty result, extra columns are left out. Rows are independent: no
shuffle, memory bounded by a batch, a lost task is simply run again.
"""

from __future__ import annotations

import base64
import gc
import heapq
import re
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, lean, text_of, trim

#: Pieces in a memory, about: where workers share an executor with much else, and where encoding has it to itself.
MEMO, LARGE_MEMO = 60_000, 120_000
#: UTF-8 bytes of the texts that are replayed together.
CHUNK_BYTES = 1_500_000

_loaded: dict = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines 'base64 rank'."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def encode_alone(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of one word, by merging its pair of lowest rank again and again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return tuple(ranks[p] for p in parts)


class MergeReplay:
    """Encodes sets of words by replaying merges over all of them together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = {t: np.int32(i).tobytes() for t, i in ranks.items()}
        self.size = np.zeros(max(ranks.values()) + 1, np.int32)  # bytes of each token
        for token, i in ranks.items():
            self.size[i] = len(token)
        pairs = [(ranks[t[:c]], ranks[t[c:]], i) for t, i in ranks.items() for c in range(1, len(t)) if t[:c] in ranks and t[c:] in ranks]
        self.single = np.array([ranks[bytes((i,))] for i in range(256)], np.int32)
        table = np.array(sorted(pairs), np.int64).reshape(-1, 3)
        self.rights = self._by(table)
        self.lefts = self._by(table[np.lexsort((table[:, 0], table[:, 1]))][:, [1, 0, 2]])

    @staticmethod
    def _by(table: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """First column to (second column in order, third column)."""
        keys, at = np.unique(table[:, 0], return_index=True)
        return {int(k): (part[:, 1], part[:, 2]) for k, part in zip(keys, np.split(table, at[1:]), strict=True)}

    @staticmethod
    def _look_up(table: tuple[np.ndarray, np.ndarray] | None, symbols: np.ndarray) -> np.ndarray:
        """The joined token for each neighbour symbol, -1 where none."""
        if table is None:
            return np.full(len(symbols), -1)
        at = np.searchsorted(table[0], symbols)
        at[at == len(table[0])] = 0
        return np.where(table[0][at] == symbols, table[1][at], -1)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as the bytes of an int32 array."""
        size = self.size
        whole = self.whole.get
        out: list = [whole(w, b"") for w in words]
        todo = [k for k, w in enumerate(words) if w and not out[k]]
        if not todo:
            return out
        lengths = np.array([len(words[k]) for k in todo])
        symbol = self.single[np.frombuffer(b"".join([words[k] for k in todo]), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        word_of = np.repeat(np.arange(len(todo), dtype=np.int32), lengths)
        after = np.arange(1, len(symbol) + 1, dtype=np.int32)
        after[starts + lengths - 1] = -1
        before = np.arange(-1, len(symbol) - 1, dtype=np.int32)
        before[starts] = -1

        index: dict[int, list[np.ndarray]] = {}  # the inverted index: joined token -> positions of the left part
        queue: list[int] = []

        def enter(joined: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(joined, kind="stable")
            joined, places = joined[order], places[order]
            cuts = np.flatnonzero(joined[1:] != joined[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), len(joined)]:
                to = int(joined[begin])
                if to in index:
                    index[to].append(places[begin:end])
                else:
                    index[to] = [places[begin:end]]
                    heapq.heappush(queue, to)
                begin = end

        first = np.flatnonzero(after >= 0)
        for left in np.unique(symbol[first]):
            at = first[symbol[first] == left] if left in self.rights else first[:0]
            to = self._look_up(self.rights.get(int(left)), symbol[after[at]])
            if (to >= 0).any():
                enter(to[to >= 0], at[to >= 0].astype(np.int32))

        mark = np.zeros(len(symbol), bool)
        alone: set[int] = set()  # words in which a merge made a pair of lower rank beside another place of the same merge
        while queue:
            rank = heapq.heappop(queue)
            lists = index.pop(rank)
            i = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            j = after[i]
            # A place still holds if both parts are there and are together as long as the joined token.
            holds = (symbol[i] >= 0) & (j >= 0)
            holds[holds] = size[symbol[i[holds]]] + size[symbol[j[holds]]] == size[rank]
            i, j = i[holds], j[holds]
            if not len(i):
                continue
            mark[i] = True
            over = mark[j]
            mark[i] = False
            if over.any():  # as in 'aaa': from the left, without overlaps
                keep, taken = np.ones(len(i), bool), set()
                for n in np.flatnonzero(over | np.isin(i, j)).tolist():
                    if int(i[n]) in taken:
                        keep[n] = False
                    else:
                        taken.add(int(j[n]))
                i, j = i[keep], j[keep]
            k = after[j]
            symbol[i], symbol[j], after[i] = rank, -1, k
            before[k[k >= 0]] = i[k >= 0]
            h = before[i]
            left, right = h >= 0, k >= 0
            to = np.concatenate((self._look_up(self.lefts.get(rank), symbol[h[left]]), self._look_up(self.rights.get(rank), symbol[k[right]])))
            at = np.concatenate((h[left], i[right]))
            if len(at) and (new := to >= 0).any():
                to, at = to[new], at[new]
                enter(to, at)
                if (to < rank).any():
                    several = word_of[i]
                    several = several[1:][several[1:] == several[:-1]]
                    alone.update(np.intersect1d(word_of[at[to < rank]], several).tolist())
        flat = symbol[symbol >= 0].astype(np.int32).tobytes()
        ends = (np.cumsum(np.bincount(word_of[symbol >= 0], minlength=len(todo))) * 4).tolist()
        begin = 0
        for k, end in zip(todo, ends, strict=True):
            out[k] = flat[begin:end]
            begin = end
        for n in alone:
            out[todo[n]] = np.array(encode_alone(words[todo[n]], self.ranks), np.int32).tobytes()
        return out


_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the space and the line feed, as str.isspace() has it.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def pieces_of(text: str) -> list[str]:
    """text cut at single spaces between other characters than white space: the pattern has a border before each, so every piece
    (but the first, with its space put back) can be matched alone."""
    plain = text[:1] != " " and text[-1:] != " " and not any(map(text.__contains__, ("  ", " \n", "\n ", *_OTHER_SPACE)))
    return text.split(" ") if plain else _INNER_SPACE.split(text)


class Encoder:
    def __init__(self, replay: MergeReplay, pattern: str, most: int = MEMO):
        import regex

        self.replay = replay
        self.most = most
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}  # a piece to the ids of ' ' + piece
        self.older: dict[str, bytes] = {}

    def _learn(self, keys: list[str]) -> list[bytes]:
        """The ids of each key, as bytes."""
        find = self.find
        words = [(k,) if k[1:].isalpha() and k[0] == " " else find(k) for k in keys]
        distinct = list(set(chain.from_iterable(words)))
        ids = dict(zip(distinct, self.replay.encode([w.encode() for w in distinct]), strict=True))
        return [ids[found[0]] if len(found) == 1 else b"".join([ids[w] for w in found]) for found in words]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; all texts of a call are one corpus for the replay."""
        memo = self.memo
        split = [pieces_of(text) for text in texts]
        firsts = [p[0] for p in split]
        rest = [p[1:] for p in split]
        del split
        fresh: set[str] = set()
        for pieces in rest:
            fresh.update(set(pieces).difference(memo))
        if known := fresh.intersection(self.older):
            memo.update([(k, self.older[k]) for k in known])
            fresh -= known
        keys = list(fresh)
        found = self._learn([*firsts, *(" " + k for k in keys)])
        memo.update(zip(keys, found[len(firsts) :], strict=True))
        if len(memo) > self.most:  # what isn't met again before the next change of memories is forgotten
            self.memo, self.older = {}, memo
        return [np.frombuffer(first + b"".join(map(memo.__getitem__, pieces)), np.int32) for first, pieces in zip(found, rest, strict=False)]


@contextmanager
def _task(rank_file: bytes, pattern: str, memo: int = MEMO) -> Iterator[Encoder]:
    """An encoder for one task. What it has learnt is given back to the system at the end: the worker goes on to other tasks."""
    lean()
    key = hash(rank_file)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = MergeReplay(read_ranks(rank_file))
    encoder = Encoder(_loaded[key], pattern, memo)
    gc.disable()  # millions of small tuples, none in a cycle
    try:
        yield encoder
    finally:
        encoder.memo.clear()
        encoder.older.clear()
        gc.enable()
        trim()


def _chunks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The batches' rows anew, in chunks of about CHUNK_BYTES, one row at least."""
    held: list[pa.Array] = []
    size = 0
    for texts in batches:
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        begin = 0
        for k, n in enumerate(lengths):
            if size and size + n > CHUNK_BYTES:
                held.append(texts[begin:k])
                yield pa.concat_arrays(held)
                held, size, begin = [], 0, k
            size += n
        held.append(texts[begin:])
    if held:
        yield pa.concat_arrays(held)


def _encode_chunk(encoder: Encoder, texts: pa.Array) -> pa.Array:
    parts, ends = [np.zeros(0, np.int32)], [0]
    for row in encoder.encode([t or "" for t in texts.to_pylist()]):
        parts.append(row)
        ends.append(ends[-1] + len(row))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))


def _decode_batch(vocab: dict[int, bytes], lists: pa.Array) -> pa.Array:
    out = []
    for ids in lists:
        out.append(b"".join(map(vocab.__getitem__, ids.values.to_numpy(zero_copy_only=False).tolist())) if ids.is_valid else None)
    return pa.array(out, pa.binary())


def _over_batches(run, types: str):
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, types)


def encode_column(text: Column, rank_file: bytes, pattern: str) -> Column:
    """Column of arrays of token ids of a text column."""

    def run(batches):
        with _task(rank_file, pattern) as encoder:
            for texts in _chunks(batches):
                yield _encode_chunk(encoder, texts)

    return _over_batches(run, "array<int>")(text)


def decode_column(ids: Column, rank_file: bytes) -> Column:
    """Column of the bytes that arrays of token ids stand for."""

    def run(batches):
        vocab = {i: b for b, i in read_ranks(rank_file).items()}
        for lists in batches:
            yield _decode_batch(vocab, lists)

    return _over_batches(run, "binary")(ids)


def round_trip_column(text: Column, rank_file: bytes, pattern: str, memo: int = MEMO) -> Column:
    """Column of structs: ids as encode_column gives them, and decoded, what decode_column makes of these ids; both in one worker."""

    def run(batches):
        with _task(rank_file, pattern, memo) as encoder:
            vocab = {i: b for b, i in encoder.replay.ranks.items()}
            for texts in _chunks(batches):
                ids = _encode_chunk(encoder, texts)
                yield pa.StructArray.from_arrays([ids, _decode_batch(vocab, ids)], ["ids", "decoded"])

    return _over_batches(run, "struct<ids:array<int>,decoded:binary>")(text)


def bpe_encode(docs: DataFrame, rank_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """Per row of docs: doc_id, ids (array of token ids), decoded (the bytes that the ids decode to)."""
    bounded_batches(docs.sparkSession)
    both = docs.select(docs[id_col].alias("doc_id"), round_trip_column(text_of(docs, text_col), rank_file, pattern, memo).alias("both"))
    return both.select("doc_id", "both.ids", "both.decoded")
