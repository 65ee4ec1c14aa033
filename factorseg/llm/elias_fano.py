"""Elias-Fano sequences and n-gram tries over one flat buffer, so that a level can be used where it is mapped.

A sorted sequence keeps the low bytes of its values as they are and the high parts in unary in a bit vector with a running
count per word: about 2 bits and the low bytes for a value. Access, membership and the position found are vectorised.
"""

from __future__ import annotations

import tempfile

import numpy as np

STEP = 1 / 16  # log10 probabilities are kept as multiples of this, in one byte


def packed_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """One buffer: a line that lists name, type, shape and place of each array, then the arrays, aligned to 8 bytes."""
    head, at, parts = [], 0, []
    for name, a in arrays.items():
        head.append(f"{name}:{a.dtype.str}:{'x'.join(map(str, a.shape))}:{at}")
        raw = np.ascontiguousarray(a).tobytes()
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    line = (";".join(head) + "\n").encode()
    line = line[:-1] + b" " * (-len(line) % 8) + b"\n"
    return line + b"".join(parts)


def mapped_arrays(buffer) -> dict[str, np.ndarray]:
    """The arrays of a buffer (bytes, Arrow buffer, np.memmap of a file), without copying."""
    raw = np.frombuffer(buffer, np.uint8)
    end = int(np.flatnonzero(raw[:1 << 16] == 10)[0]) + 1
    out = {}
    for entry in raw[:end].tobytes().decode().strip().split(";"):
        name, kind, shape, at = entry.rsplit(":", 3)
        shape = tuple(int(x) for x in shape.split("x"))
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[end + int(at):end + int(at) + size].view(kind).reshape(shape)
    return out


class Sequence:
    """A sorted sequence of unsigned values."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.low, self.high, self.ones = low, high, ones
        self.n, self.bytes = low.shape
        self.shift = np.uint64(8 * self.bytes)

    @staticmethod
    def arrays(name: str, values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        size = 0
        while n and universe >> (8 * size) > 4 * n:
            size += 1
        low = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(n, 8)[:, :size]
        top = (values >> np.uint64(8 * size)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(n + (universe >> (8 * size)) + 2) // 64) * 64, np.uint8)
        bits[top] = 1
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
        return {f"{name}.low": low, f"{name}.high": high, f"{name}.ones": ones}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> "Sequence":
        return cls(arrays[f"{name}.low"], arrays[f"{name}.high"], arrays[f"{name}.ones"])

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero (k from 0) in the bit vector."""
        before = self.ones.astype(np.int64)
        if not one:
            before = 64 * np.arange(len(before)) - before
        out = np.empty(len(k), np.int64)
        for at in range(0, len(k), 65536):
            part = k[at:at + 65536]
            word = np.searchsorted(before, part, "right") - 1
            rest = part - before[word]
            bits = np.unpackbits(np.ascontiguousarray(self.high[word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if not one:
                bits ^= 1
            place = np.argmax(np.cumsum(bits, axis=1, dtype=np.uint8) > rest[:, None].astype(np.uint8), axis=1)
            out[at:at + 65536] = 64 * word + place
        return out

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.bytes):
            out |= self.low[i, b].astype(np.uint64) << np.uint64(8 * b)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, True) - i).astype(np.uint64)
        return ((high << self.shift) | self._lows(i)).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Position of each value, -1 where it is not in the sequence."""
        if not self.n or not len(x):
            return np.full(len(x), -1)
        x = x.astype(np.uint64)
        h = (x >> self.shift).astype(np.int64)
        begin = np.zeros(len(x), np.int64)
        later = h > 0
        begin[later] = self._select(h[later] - 1, False) - (h[later] - 1)
        end = self._select(h, False) - h
        want = x & ((np.uint64(1) << self.shift) - np.uint64(1)) if self.bytes else np.zeros(len(x), np.uint64)
        low, high = begin, end.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            less = self._lows(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        there = np.flatnonzero(low < end)
        found = np.full(len(x), -1)
        same = self._lows(low[there]) == want[there]
        found[there[same]] = low[there[same]]
        return found


def quantised(log10: np.ndarray) -> np.ndarray:
    """Rounded down to steps, so that the stored shares of a context never sum to more than the exact ones."""
    return np.clip(np.ceil(-log10 / STEP), 0, 255).astype(np.uint8)


class Trie:
    """Trigram trie rooted at the middle word.

    Level 1: words; level 2: their successors, and their predecessors as contexts (predecessor, word). Level 3: the successors
    of a context, each as its position among the successors of the word (its context-relative number), so level 3 is a
    sequence over a small universe. Absolute discounting; what is discounted goes to the next shorter context.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a = arrays
        self.words, self.vocabulary = int(arrays["size"][0]), int(arrays["size"][1])
        self.pairs, self.contexts, self.triples, self.starts, self.bases = (
            Sequence.of(arrays, n) for n in ("pairs", "contexts", "triples", "starts", "bases"))

    @classmethod
    def mapped(cls, buffer: bytes) -> Trie:
        """A trie whose levels are in a file mapped into memory; the file has no name and ends with the last array."""
        with tempfile.TemporaryFile() as file:
            file.write(buffer)
            file.flush()
            return cls(mapped_arrays(np.memmap(file, np.uint8, "r")))

    @staticmethod
    def build(vocabulary: int, pair_word, pair_next, pair_count, tri_before, tri_word, tri_next, tri_count,
              discount: float) -> bytes:
        """From the counted pairs (word, next), sorted, and triples, sorted by (word, before, next); numbers are below
        ``vocabulary``; the word of every triple has that pair, too."""
        total = np.bincount(pair_word, pair_count, minlength=vocabulary)
        kinds = np.bincount(pair_word, minlength=vocabulary)
        starts = np.concatenate([[0], np.cumsum(kinds)])
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        pairs = pair_word.astype(np.int64) * vocabulary + pair_next
        context = tri_word.astype(np.int64) * vocabulary + tri_before
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        contexts, number = context[new], np.cumsum(new) - 1
        c_total = np.bincount(number, tri_count, minlength=len(contexts))
        c_kinds = np.bincount(number, minlength=len(contexts))
        bases = np.concatenate([[0], np.cumsum(kinds[(contexts // vocabulary)])]).astype(np.int64)
        relative = np.searchsorted(pairs, tri_word.astype(np.int64) * vocabulary + tri_next) - starts[tri_word]
        triples = bases[number] + relative
        square = vocabulary * vocabulary
        arrays = {"size": np.array([len(kinds), vocabulary], np.int64), "word_back": quantised(np.log10(back)),
                  "pair_p": quantised(np.log10((pair_count - discount) / total[pair_word])),
                  "context_back": quantised(np.log10(discount * c_kinds / np.maximum(c_total, 1))),
                  "triple_p": quantised(np.log10((tri_count - discount) / c_total[number]))}
        for name, values, universe in (("pairs", pairs, square), ("contexts", contexts, square), ("starts", starts, len(pairs)),
                                       ("bases", bases, int(bases[-1])), ("triples", triples, int(bases[-1]))):
            arrays |= Sequence.arrays(name, values, universe)
        return packed_arrays(arrays)

    def query(self, before: np.ndarray, word: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability without the shortest level, whether the pair (word, following) is known, whether the context
        (before, word) is)."""
        pair = self.pairs.find(word.astype(np.int64) * self.vocabulary + following)
        context = self.contexts.find(word.astype(np.int64) * self.vocabulary + before)
        both = np.flatnonzero((pair >= 0) & (context >= 0))
        relative = pair[both] - self.starts.get(word[both].astype(np.int64))
        triple = np.full(len(pair), -1)
        triple[both] = self.triples.find(self.bases.get(context[both]) + relative)
        out = np.zeros(len(pair))
        seen = triple >= 0
        out[seen] = -STEP * self.a["triple_p"][triple[seen]]
        shorter = ~seen & (context >= 0)
        out[shorter] -= STEP * self.a["context_back"][context[shorter]]
        known = ~seen & (pair >= 0)
        out[known] -= STEP * self.a["pair_p"][pair[known]]
        rest = pair < 0
        out[rest] -= STEP * self.a["word_back"][word[rest]]
        return out, pair >= 0, context >= 0
