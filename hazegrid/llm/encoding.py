"""Whole texts to token ids with the tokenizers library."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most parts whose ids a worker remembers (some 60 bytes each); beyond that, those met longest ago are forgotten.
REMEMBERED = 600_000
#: Bytes of text that are taken apart at once.
AT_ONCE = 1 << 22


class _Known:
    """Remembered parts, and where the ids of each stand in one array. A part of length -1 must be encoded with its whole text."""

    def __init__(self, kind: np.dtype):
        self.parts = pa.array([], pa.string())
        self.start, self.length, self.met = (np.zeros(0, np.int64) for _ in range(3))
        self.pool, self.tick = np.zeros(0, kind), 0

    def find(self, parts: pa.Array) -> np.ndarray:
        """The number of each part, -1 for unknown ones."""
        return np.asarray(pc.index_in(parts, value_set=self.parts).fill_null(-1)).astype(np.int64) if len(self.parts) else np.full(len(parts), -1)

    def add(self, parts: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Remember parts whose ids follow one another in ``ids``."""
        some = np.maximum(lengths, 0)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(some) - some])
        self.length = np.concatenate([self.length, lengths])
        self.met = np.concatenate([self.met, np.full(len(parts), self.tick)])
        self.pool = np.concatenate([self.pool, ids])
        self.parts = pa.concat_arrays([self.parts, parts])

    def forget(self) -> None:
        """Keep at most half as many parts as may be remembered, those met last."""
        keep = np.flatnonzero(self.met > np.partition(self.met, -(REMEMBERED // 2))[-(REMEMBERED // 2)]) if REMEMBERED > 1 else np.zeros(0, np.int64)
        parts, lengths, ids, met = self.parts.take(pa.array(keep)), self.length[keep], gathered(self.pool, self.start[keep], np.maximum(self.length[keep], 0)), self.met[keep]
        tick = self.tick
        self.__init__(self.pool.dtype)
        self.add(parts, lengths, ids)
        self.met, self.tick = met, tick


def gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces of ``pool`` one after the other."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]


class Encoder:
    """Encodes texts without special tokens being added; ids come as little-endian bytes of ``width`` bytes each.

    A byte-level pre-tokenizer never joins a blank to the characters before it, so a text falls apart at every blank between two
    characters that are not white space, and the parts are encoded on their own. Arrow splits the texts and finds their distinct parts,
    the library encodes each new one once, and the ids of all parts are gathered as arrays. Texts with other white space next to a
    blank, and all texts of other tokenizers, are encoded whole.
    """

    def __init__(self, path: str, width: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype(f"<u{width}")
        if self.tok.get_vocab_size() > 256 ** width:
            raise ValueError(f"ids do not fit in {width} bytes")
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.by_part = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec.get("normalizer") is None
                        and not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens") or ()))
        blank = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            blank[i] = token.startswith("Ġ")  # how a byte-level tokenizer writes a blank
        self.after_blank = blank
        self.known = {"": _Known(self.kind), " ": _Known(self.kind)}  # by what stands before a part

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _part_ids(self, parts: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and all ids. Parts after a blank are encoded in long lines, in which each begins with a token
        that begins with the blank."""
        if lead:
            lines = [lead + lead.join(parts[i:i + 4096]) for i in range(0, len(parts), 4096)]
            ids = np.fromiter(chain.from_iterable(self._ids(lines)), self.kind)
            heads = np.flatnonzero(self.after_blank[ids])
            if len(heads) == len(parts):
                return np.diff(np.append(heads, len(ids))), ids
        each = self._ids([lead + w for w in parts])
        return np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), self.kind)

    def _places(self, parts: pa.Array, lead: str) -> np.ndarray:
        """The number under which each part is remembered, after learning new ones."""
        coded = parts.dictionary_encode()
        known = self.known[lead]
        if len(known.parts) > REMEMBERED:
            known.forget()
        known.tick += 1
        at = known.find(coded.dictionary)
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            fresh = coded.dictionary.take(pa.array(unknown))
            words = fresh.to_pylist()
            # a part that begins or ends with white space may hang together with the blank beside it
            plain = np.fromiter((bool(w) and not w[0].isspace() and not w[-1].isspace() for w in words), bool, len(words))
            lengths = np.full(len(words), -1)
            lengths[plain], ids = self._part_ids([w for w, ok in zip(words, plain) if ok], lead)
            at[unknown] = len(known.parts) + np.arange(len(words))
            known.add(fresh, lengths, ids)
        known.met[at] = known.tick
        return at[np.asarray(coded.indices)] if len(at) else at

    def _gather(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, and the number of ids of each."""
        split = pc.split_pattern(texts, " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds -= bounds[0]
        parts = split.flatten()
        heads = bounds[:-1]
        at = self._places(parts, " ")
        first = self._places(parts.take(pa.array(heads)), "")
        inner, head = self.known[" "], self.known[""]
        start, length = inner.start[at], inner.length[at]
        start[heads], length[heads] = head.start[first], head.length[first]
        # heads' ids stand behind those of the other parts
        pool = np.concatenate([inner.pool, head.pool])
        start[heads] += len(inner.pool)
        whole = np.flatnonzero(np.add.reduceat(length < 0, heads)) if len(heads) else heads
        extra, end = [], len(pool)
        for d, ids in zip(whole.tolist(), self._ids([texts[d].as_py() for d in whole.tolist()])):
            length[bounds[d]:bounds[d + 1]] = 0
            start[bounds[d]], length[bounds[d]] = end, len(ids)
            extra.append(np.array(ids, self.kind))
            end += len(ids)
        if extra:
            pool = np.concatenate([pool, *extra])
        return gathered(pool, start, length), np.add.reduceat(length, heads) if len(heads) else length

    def encode_array(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of each text as bytes, and their numbers."""
        if not self.by_part:
            got = [np.array(i, self.kind) for i in self._ids(texts.to_pylist())]
            return pa.array([x.tobytes() for x in got], pa.binary()), np.array([len(x) for x in got], np.int64)
        sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
        out, counts, i = [], [], 0
        before = np.cumsum(sizes)
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(before, (before[i - 1] if i else 0) + AT_ONCE, "right")))
            ids, n = self._gather(texts.slice(i, j - i))
            at = np.concatenate([[0], np.cumsum(n)]) * self.kind.itemsize
            out.append(pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(ids.tobytes())]))
            counts.append(n)
            i = j
        if not out:
            return pa.array([], pa.binary()), np.zeros(0, np.int64)
        return pa.concat_arrays(out).cast(pa.binary()), np.concatenate(counts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string()))[0].to_pylist()


@lru_cache(maxsize=2)
def encoder(path: str, width: int) -> Encoder:
    """One encoder per worker process, so that what it remembers serves all its tasks."""
    return Encoder(path, width)
