"""Byte-level BPE by prefix-sharing trie traversal.

The encoding of a string ends in exactly one token that is compatible with the encoding of what stands before it, so the last token
of each prefix determines the whole encoding. Distinct words go into a trie; a depth-first walk gives each node its last token
from the nodes above it. A prefix that many words share is encoded once. Walking the words in sorted order with a stack of states
is that traversal: the stack holds the path from the root, and words branch off at their common prefix.

Texts are cut at single spaces, where no word can cross, and equal pieces are looked up; words of new pieces go through the trie.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the word pattern of byte-level BPE files that name ByteLevel with use_regex.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = 400_000  # remembered pieces of a worker; beyond it the memory starts afresh


def byte_alphabet() -> dict[str, int]:
    """Character for each byte in byte-level files: printable Latin-1 stands for itself, others follow from code point 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    rest = [b for b in range(256) if b not in set(own)]
    return table | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieCoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_alphabet()
        raw = lambda s: bytes(byte[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = model["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes_of[i] = raw(s)
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        plain = {s: i for s, i in vocab.items() if s not in self.special}
        self.rank = [-1] * len(self.bytes_of)  # of the merge that makes a token; -1: a single byte
        self.parts: list[tuple[int, int]] = [(i, i) for i in range(len(self.bytes_of))]
        self.merged: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            pair, whole = (plain[a], plain[b]), plain[a + b]
            if pair not in self.merged:
                self.merged[pair] = whole
                if self.rank[whole] < 0:
                    self.rank[whole], self.parts[whole] = r, pair
        self.ids = {self.bytes_of[i]: i for i in plain.values() if self.rank[i] >= 0 or len(self.bytes_of[i]) == 1}
        self.suffixes = ahocorasick.Automaton()
        for x, i in self.ids.items():
            self.suffixes.add_word(x.decode("latin-1"), (i, len(x)))
        self.suffixes.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.find = regex.compile(WORDS).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes | None] = {}  # after a space
        self.first: dict[str, bytes] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` apart: no merge across their border comes before one inside them."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        key, rank = (left, right), self.rank
        limit = 1 << 60
        out = None
        while out is None:
            whole = self.merged.get((left, right))
            if whole is not None and rank[whole] < limit:
                out = False
            # Undo the later of the two merges; equal pairs merge from the left, so the right one is undone first on ties.
            elif rank[left] > rank[right]:
                limit, left = rank[left], self.parts[left][1]
            elif rank[right] >= 0:
                limit, right = rank[right] + 1, self.parts[right][0]
            else:
                out = True
        self.fits[key] = out
        return out

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of distinct words, as little-endian unsigned 32-bit bytes, into the memory."""
        fits, compatible, suffixes = self.fits, self._compatible, self.suffixes.iter
        token: list[int] = [0] * 64  # by depth on the path: last token
        cut: list[int] = [0] * 64  # and the depth where it starts
        before = ""
        for raw, word in sorted((w.encode().decode("latin-1"), w) for w in words):
            n = len(raw)
            if n >= len(token):
                token += [0] * n
                cut += [0] * n
            d, most = 0, min(n, len(before))
            while d < most and raw[d] == before[d]:
                d += 1
            for last, (t, size) in suffixes(raw):  # tokens that end at each place, long ones first
                if last < d:
                    continue
                start = last + 1 - size
                if start == 0:
                    ok = True
                else:
                    ok = fits.get((token[start], t))
                    if ok is None:
                        ok = compatible(token[start], t)
                if ok:
                    d = last + 1
                    token[d], cut[d] = t, start
            out, d = [], n
            while d:
                out.append(token[d])
                d = cut[d]
            out.reverse()
            self.words[word] = array("I", out).tobytes()
            before = raw

    def _learn(self, new: set[str], memory: dict[str, bytes | None], lead: str) -> None:
        found = {p: self.find(lead + p) for p in new}
        self.encode_words(list({w for ws in found.values() for w in ws} - self.words.keys()))
        words = self.words
        for p, ws in found.items():
            memory[p] = b"".join([words[w] for w in ws])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens. A space next to other white space is part of a run that can't be cut: the piece
        after it has no encoding of its own, and the text is cut by the word pattern instead."""
        split = [t.split(" ") for t in texts]
        first = {s[0] for s in split}
        rest: set[str] = set()
        for s in split:
            rest.update(s[1:])
        if len(self.first) > PIECES:
            self.first.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        if len(self.words) > PIECES:
            self.words.clear()
        if len(self.fits) > 3 * PIECES:
            self.fits.clear()
        self._learn(first - self.first.keys(), self.first, "")
        rest -= self.pieces.keys()
        runs = {p for p in rest if not p or p[0].isspace()}
        self.pieces.update(dict.fromkeys(runs))
        self._learn(rest - runs, self.pieces, " ")
        get, out = self.pieces.__getitem__, []
        for t, s in zip(texts, split, strict=True):
            try:
                out.append(self.first[s[0]] + b"".join(map(get, s[1:])))
            except TypeError:  # a piece without an encoding
                ws = self.find(t)
                self.encode_words(list(set(ws) - self.words.keys()))
                out.append(b"".join(map(self.words.__getitem__, ws)))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        if not self.special or not any(s in t for s in self.special for t in texts):
            return self._plain(texts)
        out = []
        for t in texts:
            parts = self.split_special(t)
            known = self._plain([p for p in parts if p not in self.special])
            it = iter(known)
            out.append(b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else next(it) for p in parts))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[str, TrieCoder] = {}


def coder(path: str) -> TrieCoder:
    """One coder for each file and worker process, kept between tasks."""
    if path not in _CODERS:
        _CODERS[path] = TrieCoder(path)
    return _CODERS[path]


BATCH_CHARS = 1_000_000


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None, drop_text: bool = False) -> DataFrame:
    """``df`` with ``out``, the array of token ids of the text; a null or empty text has none. With ``decoded`` there is a column of
    that name too, the text that these ids stand for; one worker then does both. Other columns stay, those of the new names are
    replaced. Rows are coded one by one, so repeated rows and ids change nothing; memory is bounded by a batch and by PIECES
    remembered pieces."""
    kept = [f for f in df.schema.fields if f.name not in (out, decoded) and not (drop_text and f.name == text)]
    new = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.IntegerType())), *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            column, start = batch.column(text), 0
            while start < batch.num_rows:  # about a MB at a time
                texts, chars = [], 0
                while start + len(texts) < batch.num_rows and chars <= BATCH_CHARS:
                    texts.append(column[start + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                stop = start + len(texts)
                coded = c.encode(texts)
                offsets = np.zeros(len(coded) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in coded], out=offsets[1:])
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(coded))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                part = batch.slice(start, stop - start)
                back = [pa.array([c.decode(np.frombuffer(x, "<u4").tolist()) for x in coded], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), ids, *back], names=schema.fieldNames())
                start = stop

    return df.select(*[df[c] for c in dict.fromkeys([*(f.name for f in kept), text])]).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the text that the token ids stand for; null or no ids give an empty text."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            at = batch.column(ids)
            texts = [c.decode(x.values.to_pylist()) if x.is_valid else "" for x in at]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.select(*[df[f.name] for f in kept]).mapInArrow(run, schema)
