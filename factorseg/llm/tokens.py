"""Token ids of whole texts by a public byte-level BPE, one encoding per distinct stretch of a task.

A text is cut before every white space that follows a non-space; the tokenizer's own splitting pattern never joins
across such a place, so the ids of the stretches in order are the ids of the text. Distinct stretches are encoded once
per task and looked up by their 64-bit hash. The encoder is built from the vocabulary's rank file, which gives the
same ids as its ``tokenizers`` file (tests compare them) in a quarter of the time. The encoder maps the added tokens it is
given, as that file does by default (they hold no white space, so no cut goes through one); without any, their strings
are ordinary text.
"""

from __future__ import annotations

import base64
import json

import numpy as np

from factorseg.llm import words

BYTE = words.mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * words.BASE)  # no lower-casing
CACHE_LIMIT = 2_000_000  # distinct stretches kept by a task; beyond that it starts a new table


def cut_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the stretches: text starts and the cuts inside texts.

    Where the byte before may end a white space outside ASCII (or is one of FS..US), no cut is made.
    """
    if not len(data):
        return bounds[:0]
    space = words.SPACE[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = space[1:] & ~space[:-1]
    last = data[:-1]
    odd = (last >= 28) & (last <= 31)
    second = np.concatenate([[0], data[:-2]]).astype(np.uint8) if len(data) > 1 else data[:0]
    odd |= (last >= 128) & ((second == 0xC2) | (second == 0x9A) | (second == 0x80) | (second == 0x81))
    cut[1:] &= ~odd
    cut[bounds[:-1][bounds[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes batches of texts; holds the ids of the stretches met so far."""

    def __init__(self, path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        added = added or {}
        if any(c.isspace() for token in added for c in token):
            raise ValueError("added tokens must not hold white space")
        made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.encode_text = (lambda text: made.encode(text, allowed_special="all")) if added else made.encode_ordinary
        self._reset()

    def _reset(self):
        self.hashes = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [self.encode_text(t) for t in texts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        starts = len(self.flat) + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.flat = np.concatenate([self.flat, np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum()))])
        merged = np.concatenate([self.hashes, hashes])
        order = np.argsort(merged, kind="stable")
        self.hashes = merged[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of a string array and the offsets of its texts; null is the empty text."""
        data, bounds = words.text_bytes(texts)
        begin = cut_places(data, bounds)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        end = np.append(begin[1:], len(data))
        h = words.span_hashes(data, begin, end, BYTE)
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.hashes) + len(own) > CACHE_LIMIT:
            self._reset()
        at = np.searchsorted(self.hashes, own)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == own[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(own[new], [raw[begin[i]:end[i]].decode() for i in first[new]])
            at = np.searchsorted(self.hashes, own)
        at = at[back]
        size = self.sizes[at]
        offsets = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])]
        return ids, offsets[np.searchsorted(begin, bounds)]


def public_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the 50k byte-level BPE on this machine; both are parameters of the operators."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_added_tokens() -> dict[str, int]:
    """The added tokens of the same vocabulary's ``tokenizers`` file."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
