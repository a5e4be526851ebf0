"""Language-model scoring with Elias-Fano bigram tries.

Documents become blocks: a dictionary of word hashes and the token stream in dictionary ids, packed.  Each block sends
every shard the words and word pairs that belong there, once, with its training counts.  A shard builds a trie of two
levels and answers from it; the answers go back to the blocks, which sum them up for their documents.

A trie's levels are flat arrays in one file of the shared folder, memory-mapped to be asked: the sorted words, monotone
pointers to each word's successors, the successors as numbers relative to their context (all three in Elias-Fano code),
and quantised smoothed probabilities beside them.  A pair is looked up by its context's pointers, which bound the
successor search.  Nothing that grows with the corpus is held by the driver or broadcast, and one word's successors are
dealt over many shards when the word is common.

Model: p(w | u) = f(w | u) + b(u) * base(w), with the discounted f = max(c(uw) - D, 0) / c(u) and the back-off weight
b(u) = D * T(u) / c(u) quantised when the trie is built, T(u) the number of different successors of u, and
base(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)); p(w | u) = base(w) where c(u) is zero.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, keep, shared_dir, slices

#: Tokens of a block (a longer document is a block of its own) and, on average, tokens answered by one shard.
BLOCK_TOKENS = 1_000_000
SHARD_TOKENS = 2_000_000
LEAST_SHARDS = 24
#: Absolute discount.
DISCOUNT = 0.75
#: A word of at least this share of all tokens is common; its successors go to PARTS shards at least, and to so many more
#: that each gets about SHARD_TOKENS / 4 of the word's tokens, so a shard's work does not grow with the corpus.
COMMON = 1 / 4096
PARTS = 64
#: A successor is known in its context by so many bits of its hash.
BITS = 40
START, END = b"\n<s>", b"\n</s>"  # no word holds a blank

_MASK = np.uint64((1 << BITS) - 1)


# --- packing -----------------------------------------------------------------------------------------------------


#: Shorter binaries stay as they are: a frame would cost more than it saves.
LEAST_COMPRESSED = 256
_FRAME = b"\x28\xb5\x2f\xfd"  # how a compressed binary starts; others start with a small number of arrays


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary, compressed unless it is short."""
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<2sq", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    body = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return body if len(body) < LEAST_COMPRESSED else zstandard.ZstdCompressor(level=1).compress(body)


def unpack(data: bytes) -> list[np.ndarray]:
    if data.startswith(_FRAME):
        data = zstandard.ZstdDecompressor().decompress(data)
    n, out = data[0], []
    at = 1 + n * 10
    for k in range(n):
        kind, length = struct.unpack_from("<2sq", data, 1 + k * 10)
        a = np.frombuffer(data, dtype="<" + kind.decode(), count=length, offset=at)
        out.append(a)
        at += a.nbytes
    return out


# --- quantised probabilities -------------------------------------------------------------------------------------

#: Codes have 22 bits: zero, then equal ratios (one in 126,000) from 2**-48 to one.  With 16 bits the rounding of a pair
#: that a long text repeats adds up to a visible share of its score.
_TOP, _OCTAVES = (1 << 22) - 1, 48


def quantise(p: np.ndarray) -> np.ndarray:
    """The nearest level's code of probabilities; only zero itself becomes zero."""
    code = np.rint(np.log2(np.maximum(p, 1e-300)) * ((_TOP - 1) / _OCTAVES)) + _TOP
    return np.where(p > 0, np.clip(code, 1, _TOP), 0).astype(np.uint32)


def in_steps(x: np.ndarray) -> np.ndarray:
    """The nearest number of levels by which a code rises when its probability is multiplied by ``x``."""
    return np.rint(np.log2(x) * ((_TOP - 1) / _OCTAVES)).astype(np.int64)


def relative(code: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Codes as one plus their distance from the code of ``share`` / count, zero staying zero: the small whole numbers
    behind the probabilities, which travel well."""
    return np.where(code > 0, code.astype(np.int64) - quantise(share / np.maximum(counts, 1)) + 1, 0).astype(np.uint32)


def absolute(code: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """The inverse of ``relative``."""
    return np.where(code > 0, code.astype(np.int64) + quantise(share / np.maximum(counts, 1)) - 1, 0)


def level(code: np.ndarray) -> np.ndarray:
    """The probability of each code."""
    return np.where(code > 0, np.exp2((code.astype(np.float64) - _TOP) * (_OCTAVES / (_TOP - 1))), 0.0)


# --- Elias-Fano --------------------------------------------------------------------------------------------------


class EliasFano:
    """A non-decreasing sequence of unsigned integers in about 3 + log2(range / length) bits each.

    Low bits are packed; high bits are a bit vector in which the k-th zero ends the elements of high part k, with a
    directory of zeros for each 64 bits.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, n: int, width: int, top: int):
        self.low, self.high, self.zeros, self.n, self.width, self.top = low, high, zeros, n, width, top

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        width = max(0, (most // max(1, n)).bit_length() - 1)
        top = most >> width
        bits = np.zeros(-(-(n + top + 1) // 64) * 64, dtype=bool)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(bits, bitorder="little")
        zeros = np.concatenate(([0], np.cumsum(64 - bits.reshape(-1, 64).sum(axis=1)))).astype(np.int64)
        low = np.zeros(-(-n * width // 64) + 2, dtype=np.uint64)
        if width:
            part = values & np.uint64((1 << width) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(width)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift + np.uint64(width)) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return cls(low, high, zeros, n, width, top)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width, self.top], dtype=np.int64), self.low, self.high, self.zeros]

    @classmethod
    def over(cls, parts: list[np.ndarray]) -> EliasFano:
        head, *arrays = parts
        return cls(*arrays, *(int(x) for x in head))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> shift
        spill = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return (value | spill) & np.uint64((1 << self.width) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
        left = (k - self.zeros[word]).astype(np.int16)
        inside = (np.cumsum(1 - bits.astype(np.int8), axis=1, dtype=np.int8) <= left[:, None]).sum(axis=1)
        return word * 64 + inside

    def find(self, keys: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None, step: int = 1 << 16) -> np.ndarray:
        """Index of each key in its range from start to stop (all by default), -1 where it is missing: successor search in
        what the range and the key's high part have in common."""
        out = np.full(len(keys), -1, dtype=np.int64)
        for at in range(0, len(keys) if self.n else 0, step):
            part = keys[at : at + step].astype(np.uint64)
            high = (part >> np.uint64(self.width)).astype(np.int64)
            there = np.flatnonzero(high <= self.top)
            part, high = part[there], high[there]
            hi = self._zero(high) - high
            lo = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
            if start is not None:
                lo, hi = np.maximum(lo, start[at + there]), np.minimum(hi, stop[at + there])
            want, end = part & np.uint64((1 << self.width) - 1), hi.copy()
            open_ = np.flatnonzero(lo < hi)
            while len(open_):
                mid = (lo[open_] + hi[open_]) >> 1
                less = self._low(mid) < want[open_]
                lo[open_[less]] = mid[less] + 1
                hi[open_[~less]] = mid[~less]
                open_ = open_[lo[open_] < hi[open_]]
            got = np.flatnonzero(lo < end)
            got = got[self._low(lo[got]) == want[got]]
            out[at + there[got]] = lo[got]
        return out

    def get(self, i: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Values at the indices: the i-th one of the high bits, by the directory and one word of bits."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        out = np.zeros(len(i), dtype=np.uint64)
        for at in range(0, len(i), step):
            k = np.asarray(i[at : at + step], dtype=np.int64)
            word = np.searchsorted(ones, k, "right") - 1
            bits = np.unpackbits(self.high.reshape(-1, 8)[word], axis=1, bitorder="little")
            inside = (np.cumsum(bits, axis=1, dtype=np.uint8) <= (k - ones[word])[:, None]).sum(axis=1)
            out[at : at + step] = ((word * 64 + inside - k).astype(np.uint64) << np.uint64(self.width)) | self._low(k)
        return out


class Trie:
    """Contexts, pointers to their successors, successors relative to their context, and the quantised probabilities."""

    def __init__(self, words: EliasFano, vocabulary: EliasFano, pointers: EliasFano, following: EliasFano, counts: np.ndarray, back: np.ndarray, probabilities: np.ndarray):
        self.words, self.vocabulary, self.pointers, self.following = words, vocabulary, pointers, following
        self.counts, self.back, self.probabilities = counts, back, probabilities

    @classmethod
    def build(cls, words: np.ndarray, counts: np.ndarray, context: np.ndarray, successor: np.ndarray, pairs: np.ndarray) -> Trie:
        """``words`` (hashes) sorted and distinct with their counts; ``context`` (index of a word) and ``successor`` (hash)
        sorted together and distinct, with the counts of the pairs, at least one each."""
        vocabulary, number = np.unique(successor, return_inverse=True)
        many = np.bincount(context, minlength=len(words))
        safe = np.maximum(counts, 1)
        # numerators and counts are rounded apart, so that a code is its context's code and a distance that many pairs share
        one, least = quantise((1 - DISCOUNT) / safe).astype(np.int64), quantise(DISCOUNT / safe).astype(np.int64)
        found = np.minimum(one[context] + in_steps((pairs - DISCOUNT) / (1 - DISCOUNT)), _TOP)
        back = np.where(many > 0, np.minimum(least + in_steps(np.maximum(many, 1)), _TOP), 0)
        return cls(
            EliasFano.build(words), EliasFano.build(vocabulary), EliasFano.build(np.concatenate(([0], np.cumsum(many)))), EliasFano.build(context.astype(np.uint64) * np.uint64(max(1, len(vocabulary))) + number.astype(np.uint64)),
            counts.astype(np.uint64), back.astype(np.uint32), found.astype(np.uint32),
        )

    def image(self) -> bytes:
        """All levels, one after the other."""
        levels = [*self.words.parts(), *self.vocabulary.parts(), *self.pointers.parts(), *self.following.parts(), self.counts, self.back, self.probabilities]
        head = np.array([len(levels), *(x for a in levels for x in (ord(a.dtype.kind) << 8 | a.dtype.itemsize, len(a)))], dtype=np.int64)
        pieces = []
        for a in (head, *levels):
            data = np.ascontiguousarray(a).tobytes()
            pieces += [data, bytes(-len(data) % 8)]
        return b"".join(pieces)

    def write(self, path: str) -> None:
        """The image in one file; the name appears when it is whole."""
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as file:
            file.write(self.image())
        os.replace(part, path)

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie over the memory-mapped file."""
        return cls.over(np.memmap(path, dtype=np.uint8, mode="r"))

    @classmethod
    def over(cls, file: np.ndarray) -> Trie:
        """The trie over an image's bytes."""
        n = int(file[:8].view(np.int64)[0])
        head, at, levels = file[8 : 8 + 16 * n].view(np.int64), 8 + 16 * n, []
        for k in range(n):
            kind, size, length = chr(head[2 * k] >> 8), int(head[2 * k] & 255), int(head[2 * k + 1])
            levels.append(file[at : at + size * length].view(f"<{kind}{size}"))
            at += -(-size * length // 8) * 8
        return cls(*(EliasFano.over(levels[k : k + 4]) for k in (0, 4, 8, 12)), *levels[16:])

    def successors(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the successors of each context (index) start and stop."""
        return self.pointers.get(context).astype(np.int64), self.pointers.get(context + 1).astype(np.int64)

    def pair_codes(self, context: np.ndarray, successor: np.ndarray) -> np.ndarray:
        """Code of f for each (context index, successor hash), zero where the pair is unknown."""
        number = self.vocabulary.find(successor)
        start, stop = self.successors(context)
        key = context.astype(np.uint64) * np.uint64(max(1, self.vocabulary.n)) + np.maximum(number, 0).astype(np.uint64)
        at = self.following.find(key, start, np.where(number >= 0, stop, start))
        return np.where(at >= 0, self.probabilities[np.maximum(at, 0)] if len(self.probabilities) else 0, 0).astype(np.uint32)


# --- blocks ------------------------------------------------------------------------------------------------------

BLOCK = "block long, words binary, data binary, doc_id array<{id}>, tokens long, train long, train_docs long, common binary"


def _tokenise(docs: DataFrame) -> DataFrame:
    """One row a block: its dictionary (hashes, training counts), its token ids, document lengths and training flags, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = BLOCK.format(id=kind)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words: dict[bytes, int] = {}
        ids, lengths, doc_ids, held, total = [], [], [], [], 0

        def close() -> pa.RecordBatch:
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
            stream, sizes = np.concatenate(ids), np.array(lengths, dtype=np.uint32)
            seen = np.bincount(stream, minlength=len(words))
            rank = np.argsort(-seen, kind="stable")  # frequent words first: small ids pack well
            place = np.empty(len(rank), dtype=np.uint32)
            place[rank] = np.arange(len(rank), dtype=np.uint32)
            stream, hashes, seen = place[stream], hashes[rank], seen[rank]
            # one dictionary entry a hash, so what shards and blocks call a word is the same
            order = np.argsort(hashes, kind="stable")
            if (hashes[order][1:] == hashes[order][:-1]).any():
                hashes, back = np.unique(hashes, return_inverse=True)
                stream = back[stream].astype(np.uint32)
                seen = np.bincount(stream, minlength=len(hashes))
            flags = np.array(held, dtype=bool)
            often = np.flatnonzero(seen >= COMMON * max(1, len(stream)))
            low = (stream & np.uint32(0xFFFF)).astype(np.uint16)
            high = (stream >> np.uint32(16)).astype(np.uint16)
            trained = np.bincount(stream[np.repeat(~flags, sizes)], minlength=len(hashes)).astype(np.uint32)
            data = pack(low, high, sizes, flags.astype(np.uint8))
            row = (number, pack(hashes, trained), data, list(doc_ids), len(stream), int(trained.sum()), int((~flags).sum()), pack(hashes[often], seen[often].astype(np.uint64)))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for part in slices(batches):
            for doc, out, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "held", "t"))):
                own = text.lower().split() if text else []
                own.append(END)
                if total and total + len(own) > BLOCK_TOKENS:
                    yield close()
                    number += 1
                    words.clear()
                    ids, lengths, doc_ids, held, total = [], [], [], [], 0
                add = words.setdefault
                ids.append(np.fromiter((add(w, len(words)) for w in own), dtype=np.int64, count=len(own)))
                lengths.append(len(own))
                doc_ids.append(doc)
                held.append(bool(out))
                total += len(own)
        if total:
            yield close()

    narrow = docs.select("doc_id", F.coalesce(crc_mod(5) == 1, F.lit(False)).alias("held"), F.col("text").cast("binary").alias("t"))
    return narrow.mapInArrow(run, schema)


_START_HASH = np.uint64(xxhash.xxh64_intdigest(START))


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return a ^ (a >> np.uint64(29))


class Common:
    """The common contexts, which are the start and the words of at least the share COMMON of all tokens: sorted hashes,
    training counts and, once the tries are built, numbers of different successors."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        self.words, self.counts, self.spread = words, counts, np.zeros(len(words))
        self.parts = np.maximum(PARTS, -(-4 * counts // SHARD_TOKENS)).astype(np.uint64)

    def index(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is not common."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)


class Plan:
    """What a block asks the shards, in an order that is found again when the answers come."""

    def __init__(self, dictionary: bytes, data: bytes, shards: int, common: Common):
        hashes, trained = unpack(dictionary)
        low, high, sizes, held = unpack(data)
        self.stream = low.astype(np.int64) | (high.astype(np.int64) << 16)
        self.sizes, self.held = sizes.astype(np.int64), held.astype(bool)
        self.words, self.trained = np.append(hashes, _START_HASH), np.append(trained, np.count_nonzero(~self.held)).astype(np.uint32)
        n = len(self.words)
        train = np.repeat(~self.held, self.sizes)
        # context of each token: the word before it, or the start
        context = np.concatenate(([n - 1], self.stream[:-1]))
        context[np.cumsum(self.sizes)[:-1]] = n - 1
        key = (context << 32) | self.stream
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        pair_of = np.empty(len(key), dtype=np.int64)
        pair_of[order] = np.cumsum(first) - 1
        self.pair_of = pair_of
        pairs = ranked[first]
        self.u, self.w = pairs >> 32, pairs & 0xFFFFFFFF
        self.pair_train = np.add.reduceat(train[order].astype(np.int64), np.flatnonzero(first))
        # home shards of words; pairs go home with their context, or by both words where the context is common
        modulus = np.uint64(shards)
        home = (_mix(self.words) % modulus).astype(np.int64)
        self.common_of = common.index(self.words)
        self.often = self.common_of[self.u] >= 0
        pair_shard = home[self.u]
        part = _mix(self.words[self.w[self.often]] ^ np.uint64(0x5851F42D4C957F2D)) % common.parts[self.common_of[self.u[self.often]]]
        pair_shard[self.often] = (_mix(self.words[self.u[self.often]] + part * np.uint64(0xD6E8FEB86659FD93)) % modulus).astype(np.int64)
        self.word_order = np.argsort(home, kind="stable")
        # the shards that the block has anything for: as many as its words and pairs at most, however many there are
        self.shards = np.unique(np.concatenate((home, pair_shard)))
        cuts = lambda ranked: (np.searchsorted(ranked, self.shards), np.searchsorted(ranked, self.shards, "right"))
        self.word_cuts = cuts(home[self.word_order])
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.word_order] = np.arange(n)
        # a shard's pairs: those of its own words in their order, then those of common contexts
        self.pair_order = np.lexsort((self.words[self.w] & _MASK, self.place[self.u], self.often, pair_shard))
        self.pair_cuts = cuts(pair_shard[self.pair_order])

    def ask(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        """For one of ``shards``: the words at home there, and the pairs."""
        k = int(np.searchsorted(self.shards, s))
        return self.word_order[self.word_cuts[0][k] : self.word_cuts[1][k]], self.pair_order[self.pair_cuts[0][k] : self.pair_cuts[1][k]]

    def message(self, s: int) -> bytes:
        """Own words with training counts and numbers of pairs; common contexts (index) with numbers of pairs; the pairs'
        successors (hash) and training counts."""
        own, pairs = self.ask(s)
        usual = pairs[~self.often[pairs]]
        first = self.place[own[0]] if len(own) else 0
        spread = np.bincount(self.place[self.u[usual]] - first, minlength=len(own))
        extra, many = np.unique(self.place[self.u[pairs[len(usual) :]]], return_counts=True)
        follow = self.words[self.w[pairs]] & _MASK
        return pack(
            self.words[own], self.trained[own], spread.astype(np.uint32), self.common_of[self.word_order[extra]].astype(np.uint16), many.astype(np.uint32),
            (follow & np.uint64(0xFFFFFFFF)).astype(np.uint32), (follow >> np.uint64(32)).astype(np.uint8), self.pair_train[pairs].astype(np.uint32),
        )


def _answer(messages: list[tuple[int, bytes]], common: Common, path: str | None) -> tuple[list[tuple[int, bytes]], np.ndarray, int]:
    """A shard's work: its trie, in the file ``path`` (in memory without one), from all blocks' training counts, then every
    block's answers; the common contexts' numbers of successors there, and its number of known words.

    An answer holds its words' counts and back-off codes and its pairs' codes, relative to the counts, in the order asked."""
    every = [unpack(m) for _, m in messages]
    # contexts of the shard: the common ones by index, then its own words
    own = np.unique(np.concatenate([m[0] for m in every]))
    c = len(common.words)
    words, back = np.unique(np.concatenate((common.words, own)), return_inverse=True)
    common_at, own_at = back[:c], back[c:]
    counts = np.zeros(len(words), dtype=np.int64)
    contexts, follow, amounts = [], [], []
    for hashes, trained, spread, extra, many, low, high, pairs in every:
        at = own_at[np.searchsorted(own, hashes)]
        np.add.at(counts, at, trained.astype(np.int64))
        contexts.append(np.concatenate((np.repeat(at, spread), np.repeat(common_at[extra], many))))
        follow.append((high.astype(np.uint64) << np.uint64(32)) | low)
        amounts.append(pairs.astype(np.int64))
    mine = np.zeros(len(words), dtype=bool)
    mine[own_at] = True
    known = int(np.count_nonzero(counts[mine & (words != _START_HASH)]))
    exact = counts.copy()
    exact[common_at] = common.counts  # a common context's count is that of all shards
    key = (np.concatenate(contexts).astype(np.uint64) << np.uint64(BITS)) | np.concatenate(follow)
    amount = np.concatenate(amounts)
    lengths = [len(f) for f in follow]
    del contexts, follow, amounts
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, dtype=bool)
    asked, total = ranked[new], np.add.reduceat(amount[order], np.flatnonzero(new)) if len(ranked) else amount
    place = np.empty(len(key), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    del key, amount, order, ranked, new
    some = total > 0
    trie = Trie.build(words, exact, (asked[some] >> np.uint64(BITS)).astype(np.int64), asked[some] & _MASK, total[some])
    if path is None:
        trie = Trie.over(np.frombuffer(trie.image(), dtype=np.uint8))
    else:
        trie.write(path)
        trie = Trie.open(path)
    of = (asked >> np.uint64(BITS)).astype(np.int64)
    codes = relative(trie.pair_codes(of, asked & _MASK), trie.counts[of], 1 - DISCOUNT)[place]
    start, stop = trie.successors(common_at)
    out, at = [], 0
    for (block, _), (hashes, *_), n in zip(messages, every, lengths):
        found = trie.words.find(hashes)
        n_word = trie.counts[found]
        out.append((block, pack(n_word.astype(np.uint32 if not len(n_word) or int(n_word.max()) < 1 << 32 else np.uint64), relative(trie.back[found], n_word, DISCOUNT), codes[at : at + n])))
        at += n
    return out, stop - start, known


def _scores(plan: Plan, answers: dict[int, bytes], common: Common, n_all: int, v_all: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n_known, base_score, score of a block's documents."""
    n = len(plan.words)
    count, back, code = np.zeros(n), np.zeros(n, dtype=np.uint32), np.zeros(len(plan.u), dtype=np.uint32)
    for s, answer in answers.items():
        own, pairs = plan.ask(s)
        count[own], back[own], code[pairs] = unpack(answer)
    often = plan.common_of >= 0
    code, back = absolute(code, count[plan.u], 1 - DISCOUNT), absolute(back, count, DISCOUNT)
    shared = np.where(common.spread > 0, quantise(DISCOUNT / np.maximum(common.counts, 1)) + in_steps(np.maximum(common.spread, 1)), 0)
    back[often] = shared[plan.common_of[often]]
    base = (count + 0.5) / (n_all + 0.5 * (v_all + 1))
    p = level(code) + level(back)[plan.u] * base[plan.w]
    p = np.where(count[plan.u] > 0, p, base[plan.w])
    starts = np.concatenate(([0], np.cumsum(plan.sizes)[:-1]))
    return (
        np.add.reduceat((count[plan.stream] > 0).astype(np.int64), starts),
        np.add.reduceat(np.log10(base)[plan.stream], starts),
        np.add.reduceat(np.log10(p)[plan.pair_of], starts),
    )


def common_contexts(blocks: DataFrame, tokens: int, train_docs: int) -> Common:
    """The common contexts with their exact training counts: candidates from the blocks that have them often, then one
    pass over the dictionaries; 1 / COMMON rows at most come to the driver, twice."""
    schema = "word long, n long"

    def rows(word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    def often(batches):
        for part in slices(batches):
            pairs = [unpack(d) for d in part.column("common").to_pylist()]
            yield rows(*(np.concatenate([p[k] for p in pairs]) for k in (0, 1)))

    # a word of a share of all tokens has it in some block
    found = blocks.select("common").mapInArrow(often, schema).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON * tokens).select("word").collect()
    words = np.sort(np.array([r[0] for r in found], dtype=np.int64).view(np.uint64))

    def counted(batches):
        for part in slices(batches):
            for data in part.column("words").to_pylist():
                hashes, trained = unpack(data)
                these = np.isin(hashes, words)
                yield rows(hashes[these], trained[these])

    exact = {r[0]: r[1] for r in blocks.select("words").mapInArrow(counted, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()} if len(words) else {}
    words = np.sort(np.append(words, _START_HASH))
    counts = [train_docs if w == _START_HASH else exact.get(int(w.view(np.int64)), 0) for w in words]
    return Common(words, np.array(counts, dtype=np.int64))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Learns from the rows whose id's crc32 modulo 5 is not 1 and scores all.  Null and empty texts have one token, the
    end.  A document of any length is scored whole.  Repeated rows each count and are each scored; an empty table gives
    no rows; without training rows every probability is the base's.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = keep(_tokenise(docs))
    nothing = F.lit(0).cast("long")
    tokens, train, train_docs = blocks.agg(*(F.coalesce(F.sum(c), nothing) for c in ("tokens", "train", "train_docs"))).first()
    shards = max(LEAST_SHARDS, -(-tokens // SHARD_TOKENS))
    folder = _model_folder(shared_dir(spark))
    common = spark.sparkContext.broadcast(common_contexts(blocks, tokens, train_docs))

    def ask(batches):
        for part in batches:
            for block, words, data in zip(*(part.column(c).to_pylist() for c in ("block", "words", "data"))):
                plan = Plan(words, data, shards, common.value)
                sent = [(s, plan.message(s)) for s in plan.shards.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sent], type=pa.int32()), pa.array([block] * len(sent), type=pa.int64()), pa.array([m for _, m in sent], type=pa.binary())], names=["shard", "block", "data"])

    answer_schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("known", pa.int64())])

    def answer(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        out, spread, known = _answer(list(zip(table.column("block").to_pylist(), table.column("data").to_pylist())), common.value, folder and f"{folder}/{shard}.trie")
        rows = [(shard, -1, pack(spread.astype(np.int64)), known), *((shard, b, d, 0) for b, d in out)]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), answer_schema)], schema=answer_schema)

    asked = blocks.select("block", "words", "data").mapInArrow(ask, "shard int, block long, data binary")
    answers = keep(asked.repartition(4 * shards, "shard").groupBy("shard").applyInArrow(answer, "shard int, block long, data binary, known long"))

    def spreads(batches):
        total = np.zeros(len(common.value.words), dtype=np.int64)
        for part in batches:
            for data in part.column("data").to_pylist():
                total += unpack(data)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    own = answers.where("block = -1")
    vocabulary = own.agg(F.coalesce(F.sum("known"), nothing)).first()[0]
    final = Common(common.value.words, common.value.counts)
    for r in own.select("data").mapInArrow(spreads, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each common context
        final.spread[r["k"]] = r["n"]
    shared = spark.sparkContext.broadcast(final)

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def total(table: pa.Table) -> pa.Table:
        shard, data = table.column("shard").to_pylist(), table.column("data").to_pylist()
        at = shard.index(-1)
        plan = Plan(table.column("words")[at].as_py(), data[at], shards, shared.value)
        known, base, own = _scores(plan, {s: d for s, d in zip(shard, data) if s >= 0}, shared.value, train, vocabulary)
        ids = table.column("doc_id")[at].as_py()
        cols = [ids, plan.held, plan.sizes, known, [train] * len(ids), base, own]
        return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    whole = blocks.select("block", F.lit(-1).alias("shard"), "words", "data", "doc_id")
    back = answers.where("block >= 0").select("block", "shard", F.lit(None).cast("binary").alias("words"), "data", F.lit(None).cast(f"array<{kind}>").alias("doc_id"))
    return whole.unionByName(back).groupBy("block").applyInArrow(total, schema)


def _model_folder(root: str) -> str | None:
    """A new folder for the tries under the shared folder, from which tasks map them; None where it is not mounted as a file
    system: a trie is asked only by the task that builds it, which then keeps its image in memory."""
    root = re.sub("^file:/+", "/", root)
    if "://" in root:
        return None
    path = f"{root}/tries-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path
