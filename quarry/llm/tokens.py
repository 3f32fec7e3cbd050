"""Whole texts to token ids with a given tokenizer, one library call a distinct word.

Text is cut where the tokenizer's own pre-tokenizer always cuts (before white space, and
between ASCII letters or digits and ASCII punctuation other than the apostrophe), so the ids
of a text are those of its pieces laid end to end.  Pieces are dictionary-encoded by Arrow and
only those a worker has not met are tokenised.  Texts that hold an added token's string go
to the library whole.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, ALNUM, PUNCT, OTHER = range(4)
#: Bytes of text worked on at once, and distinct pieces a worker remembers.
CHUNK, MEMO = 4 << 20, 900_000


def _cut_table() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, OTHER, np.uint8)
    kind[[9, 10, 13, 32]] = SPACE
    for c in range(33, 127):
        kind[c] = ALNUM if chr(c).isalnum() else PUNCT
    kind[ord("'")] = OTHER
    cut = np.zeros(16, bool)
    for a, b in ((ALNUM, SPACE), (PUNCT, SPACE), (OTHER, SPACE), (ALNUM, PUNCT), (PUNCT, ALNUM)):
        cut[a * 4 + b] = True
    return kind, cut


KIND, CUT = _cut_table()
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _plain(text: str) -> bool:
    """Latin letters only, as they are and in lower case: one pre-token."""
    return text.isalpha() and text.lower().isalpha() and max(text) < "\u0250"


class WordTokenizer:
    """Ids of texts as ``tokenizers`` gives them with add_special_tokens=False."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:
            vocab = self.library.get_vocab()
            self.ends = np.zeros(max(vocab.values()) + 1, bool)
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[bytes, int] = {b"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.known = 1

    def _add(self, keys: list[bytes], ids: np.ndarray, lens: np.ndarray) -> None:
        k, m, size = self.known, len(keys), len(ids)
        while self.used + size > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + m > len(self.at):
            self.at, self.n = np.concatenate([self.at, np.zeros_like(self.at)]), np.concatenate([self.n, np.zeros_like(self.n)])
        self.flat[self.used:self.used + size] = ids
        self.at[k:k + m], self.n[k:k + m] = self.used + np.cumsum(lens) - lens, lens
        self.used, self.known = self.used + size, k + m
        self.memo.update(zip(keys, range(k, k + m), strict=True))

    def _learn(self, keys: list[bytes]) -> None:
        """Tokenise words not met before.  Plain words are one pre-token each, so many go in one
        call and are told apart by the word-end tokens; other pieces go one by one."""
        words, rest = [], []
        for k in keys:
            plain = k.isalpha() or (self.ends is not None and not k.isascii() and _plain(k.decode()))
            (words if plain and self.ends is not None else rest).append(k)
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            ids = np.array(self.library.encode(b"\n".join(part).decode(), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(part) or stop[-1] != len(ids):
                rest += part
                continue
            self._add(part, ids, np.diff(stop, prepend=0))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            got = [e.ids for e in self.library.encode_batch_fast([k.decode() for k in part], add_special_tokens=False)]
            self._add(part, np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got]))

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first piece at or after each start, the ids' numbers by piece) of texts laid end to end."""
        kind = KIND[data]
        cut = np.empty(len(data), bool)
        cut[:1] = True
        np.take(CUT, kind[:-1] * np.uint8(4) + kind[1:], out=cut[1:])
        cut[starts[starts < len(data)]] = True
        pos = np.flatnonzero(cut)
        # Pieces without white space; A-Z in lower case unless a combining mark might follow.
        solid = kind != SPACE
        low = np.where(np.append(data[1:], np.uint8(0)) < 128, LOWER[data], data)[solid]
        offsets = np.append(np.cumsum(solid, dtype=np.int32)[pos] - solid[pos], np.int32(len(low))).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(pos), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        coded = pieces.dictionary_encode()
        words = coded.dictionary
        block, at = words.buffers()[2].to_pybytes(), np.frombuffer(words.buffers()[1], np.int32, len(words) + 1).tolist()
        keys = [block[i:j] for i, j in zip(at, at[1:])]
        if len(self.memo) + len(keys) > MEMO:
            self._forget()
        get, memo = self.memo.get, self.memo
        own = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        if len(new := np.flatnonzero(own < 0)):
            self._learn([keys[i] for i in new])
            own[new] = [memo[keys[i]] for i in new]
        return np.searchsorted(pos, starts), own[coded.indices.to_numpy()]

    def _laid(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, number = self._pieces(data, starts)
        n, at = self.n[number].astype(np.int64), self.at[number]
        end = np.cumsum(n)
        total = int(end[-1]) if len(end) else 0
        ids = self.flat[np.repeat(at - (end - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        before = np.concatenate([[0], end])
        return ids, np.diff(np.append(before[first], total))

    def _whole(self, data: bytes) -> np.ndarray:
        """One text of any length, in runs that end before white space."""
        out, at = [], 0
        while at < len(data):
            to = min(len(data), at + CHUNK)
            if to < len(data):
                cut = max(data.rfind(b" ", at + 1, to), data.rfind(b"\n", at + 1, to))
                to = cut if cut > at else len(data)
            out.append(self._laid(np.frombuffer(data, np.uint8, to - at, at), np.zeros(1, np.int64))[0])
            at = to
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (uint32) of each text, in order; null counts as empty."""
        texts = texts.fill_null("").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            j = min(j, len(texts))
            part = data[offsets[i]:offsets[j]]
            block = part.tobytes()
            low = block.lower()
            if j == i + 1 and len(block) > CHUNK or any(a in low for a in self.added):
                for k in range(i, j):
                    one = data[offsets[k]:offsets[k + 1]].tobytes()
                    if any(a in one.lower() for a in self.added):
                        yield np.array(self.library.encode(one.decode(), add_special_tokens=False).ids, np.uint32)
                    else:
                        yield self._whole(one)
            else:
                ids, n = self._laid(part, offsets[i:j] - offsets[i])
                yield from np.split(ids, np.cumsum(n)[:-1])
            i = j


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process and file."""
    return WordTokenizer(path)
