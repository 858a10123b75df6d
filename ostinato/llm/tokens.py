"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once per worker.

A tokenizer splits a text before white space in any case, so a text is the sequence of its chunks (white space and what follows
up to the next). Chunks that a worker hasn't met are joined with a separator that has a token of its own, encoded at once, and
kept. Texts with rare control characters go to the tokenizer as they are. Tests hold both ways against each other.
"""

from __future__ import annotations

import os
import re

import numpy as np

_CHUNKS = re.compile(r"\s*\S+|\s+").findall
#: White space to Python but not to the tokenizers, and the separator: texts that hold one are encoded as they are.
_RARE = re.compile("[\x01\x1c-\x1f]").search
#: Chunks of up to so many characters are kept, so many at a time; texts are encoded so many together.
MAX_LENGTH, MAX_CHUNKS, GROUP = 64, 600_000, 64


class Encoder:
    """``ids(text)``: the little-endian ids of a text, as the library gives them with ``add_special_tokens=False``."""

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.split = str.split if drops_space else _CHUNKS
        # Where white space is dropped, texts change as they are encoded, and a separator shows where chunks end. Else tokens are
        # bytes, one letter each, and their lengths show it.
        self.separator = " \x01 " if drops_space else ""
        self.mark = int(self._plain("\x01")[-1])
        self.lengths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encoded(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that stand for the same between others as alone, in one call."""
        ids = self._plain(self.separator.join(chunks))
        if self.separator:
            ends = np.flatnonzero(np.append(ids, self.kind.type(self.mark)) == self.mark)
            starts = np.r_[0, ends[:-1] + 1]
        else:
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(c.encode()) for c in chunks])) + 1
            starts = np.r_[0, ends[:-1]]
        if len(ends) != len(chunks):
            raise ValueError("this tokenizer doesn't split texts as expected")
        size, data = self.kind.itemsize, ids.tobytes()
        return [data[i:j] for i, j in zip((starts * size).tolist(), (ends * size).tolist())]

    def _learn(self, fresh: dict[str, None]) -> None:
        if len(self.known) > MAX_CHUNKS:
            self.known, self.older = {}, self.known
        old = {c: self.older[c] for c in fresh if c in self.older} if self.older else {}
        self.known.update(old)
        plain, odd = [], []
        for c in fresh:
            if c not in old and len(c) <= MAX_LENGTH:
                # A first chunk without white space, and a last one of nothing else, mean something else between others.
                (odd if self.split is _CHUNKS and (not c[0].isspace() or c[-1].isspace()) else plain).append(c)
        self.known.update((c, self._plain(c).tobytes()) for c in odd)
        if plain:
            self.known.update(zip(plain, self._encoded(plain)))

    def _group(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        left, fresh = [], {}
        for i, text in enumerate(texts):
            if _RARE(text):
                out[i] = self._plain(text).tobytes()
                continue
            chunks = self.split(text)
            values = list(map(self.known.get, chunks))
            try:
                out[i] = b"".join(values)
            except TypeError:
                missing = [k for k, v in enumerate(values) if v is None]
                fresh.update(dict.fromkeys([chunks[k] for k in missing]))
                left.append((i, chunks, values, missing))
        if left:
            self._learn(fresh)
        for i, chunks, values, missing in left:
            for k in missing:
                value = self.known.get(chunks[k])
                values[k] = self._plain(chunks[k]).tobytes() if value is None else value
            out[i] = b"".join(values)
        return out

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts go in groups, so that new chunks are encoded together."""
        return [ids for at in range(0, len(texts), GROUP) for ids in self._group(texts[at : at + GROUP])]

    def ids(self, text: str) -> bytes:
        return self._group([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each tokenizer file and Python worker; workers are reused."""
    if path not in _ENCODERS:
        import json

        with open(path, encoding="utf-8") as f:
            pre = json.load(f)["pre_tokenizer"]
        _ENCODERS[path] = Encoder(path, drops_space=pre["type"] == "Sequence")
    return _ENCODERS[path]
