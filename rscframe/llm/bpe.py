"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts texts into chunks of 256 bytes on average wherever its low bits are zero, so
equal passages fall into equal chunks wherever they stand.  A worker encodes a chunk once and takes it from a bounded cache afterwards.

The joins of chunks are repaired by encoding again.  Pre-tokenizers of the kinds in CUTTING begin a new piece wherever white space follows
something else; there the encodings of both sides agree with that of the whole text.  So what lies between the first and the last such place of a chunk
keeps its ids, while the two ragged ends may not: the end of one chunk is joined with the start of the next, and widened chunk by chunk until it reaches such a
place on either side, and what is joined is encoded anew.  Pieces between such places are encoded by the
tokenizers library itself, once while they stay in the cache.  A vocabulary with another pre-tokenizer is encoded text by text.

Where the vocabulary gives white space no ids (found by trial), pieces are words, and their decoded texts are joined by a space as the library does without a decoder;
else pieces begin with their white space, and whole lists of ids are decoded.

Defined results: a null or empty text has no ids, an empty decoded text and the digests of "";
rows are never merged, so equal and repeated rows have equal results; a very long text is read in one piece, at about 40 bytes of memory a byte; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import _BASE, _BASE_INV, _BYTE, _power, arrow_map, segments, string_buffers, table

WINDOW, CUT_BITS = 16, 8
CHUNKS_KEPT, PIECES_KEPT = 15_000, 150_000  # in each of two generations
CUTTING = ("ByteLevel", "Split", "Whitespace", "WhitespaceSplit", "BertPreTokenizer")
_WITH_SPACE = re.compile(rb"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+\Z")
_MASK = np.uint64((1 << CUT_BITS) - 1)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Kept:
    """A bounded dict of two generations; ``now`` holds all that was asked for since the last turn."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now

    def missing(self, keys: set) -> list:
        """The keys that are not known; known ones are in ``now`` afterwards."""
        new = keys - self.now.keys()
        again = new & self.old.keys()
        for k in again:
            self.now[k] = self.old[k]
        return list(new - again)


def cut_points(data: np.ndarray) -> np.ndarray:
    """Offsets at which the rolling hash of the bytes before says to cut, never within a character."""
    if len(data) <= WINDOW:
        return np.zeros(0, np.int64)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * _power(_BASE_INV, len(data))[: len(data) - WINDOW + 1]
    at = np.flatnonzero(((rolled >> np.uint64(40)) & _MASK) == 0) + WINDOW
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


class Codec:
    """Encoder of one worker: pieces and chunks that it has met stay in bounded caches."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [made.get("pre_tokenizer") or {}]
        steps = steps[0].get("pretokenizers", steps)
        self.cuts = bool(steps) and steps[0].get("type") in CUTTING and (steps[0]["type"] != "ByteLevel" or steps[0].get("use_regex", False))
        ids = lambda text: self.tok.encode(text, add_special_tokens=False).ids
        self.words = self.tok.decoder is None and all(ids(f"{x}b{y}c{x}") == ids("b") + ids("c") for x in ("", " ", "\n") for y in (" ", "\t", "\n\n", " \r\n ", "\x0b\x0c"))
        self.chunks, self.pieces = Kept(CHUNKS_KEPT), Kept(PIECES_KEPT)
        self.reused = 0

    def parts(self, chunk: bytes) -> tuple[bytes, list[bytes], bytes] | None:
        """(ragged start, pieces, ragged end) of a chunk; None if it is ragged as a whole."""
        if not self.words:
            pieces = _WITH_SPACE.findall(chunk)
            return (pieces[0], pieces[1:-1], pieces[-1]) if len(pieces) > 1 else None
        pieces = chunk.split()
        open_, shut = chunk[:1].isspace(), chunk[-1:].isspace()
        if len(pieces) < 2 and not open_ and not shut:
            return None
        start = b"" if open_ or not pieces else pieces.pop(0)
        end = b"" if shut or not pieces else pieces.pop()
        return start, pieces, end

    def learn(self, wanted: set[bytes]) -> None:
        """Encodes the pieces that the cache lacks, all in one call."""
        new = self.pieces.missing(wanted)
        got = self.tok.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        decode, words, now = self.tok.decode, self.words, self.pieces.now
        for p, e in zip(new, got):
            ids = e.ids
            now[p] = (" ".join(map(str, ids)), decode(ids, skip_special_tokens=False) if words else "") if ids else ("", "")

    def joined(self, got: list[tuple[str, str]]) -> tuple[str, str]:
        return " ".join([g[0] for g in got if g[0]]), " ".join([g[1] for g in got if g[0]])

    def encode(self, texts: list[list[bytes]]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids, decoded text) for each text, given as its chunks."""
        if not self.cuts:
            return self.whole([b"".join(chunks).decode() for chunks in texts])
        self.pieces.turn()
        self.chunks.turn()
        fresh = {c: self.parts(c) for c in self.chunks.missing({c for chunks in texts for c in chunks})}
        self.reused += sum(map(len, texts)) - len(fresh)
        done = self.chunks.now
        plans, wanted = [], set()
        for e in fresh.values():
            if e is not None:
                wanted.update(e[1])
        for chunks in texts:
            plan, ragged = [], b""  # a chunk, or a joined piece in a tuple
            for c in chunks:
                e = fresh[c] if c in fresh else done[c]
                if e is None:
                    ragged += c
                    continue
                ragged += e[0]
                if ragged:
                    plan.append((ragged,))
                plan.append(c)
                ragged = e[-1]
            if ragged:
                plan.append((ragged,))
            plans.append(plan)
            wanted.update([p[0] for p in plan if type(p) is tuple])
        self.learn(wanted)
        known = self.pieces.now
        for c, e in fresh.items():
            done[c] = e and (e[0], *self.joined([known[p] for p in e[1]]), e[2])
        out = []
        for plan in plans:
            ids, decoded = self.joined([known[p[0]] if type(p) is tuple else done[p][1:3] for p in plan])
            if not self.words:
                decoded = self.tok.decode(list(map(int, ids.split())), skip_special_tokens=False)
            out.append((ids.count(" ") + 1 if ids else 0, ids, decoded))
        return out

    def whole(self, texts: list[str]) -> list[tuple[int, str, str]]:
        out = []
        for e in self.tok.encode_batch_fast(texts, add_special_tokens=False):
            out.append((len(e.ids), " ".join(map(str, e.ids)), self.tok.decode(e.ids, skip_special_tokens=False)))
        return out


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def chunked(column: pa.Array):
    """Runs of texts, each as a list of its chunks."""
    data, offs = string_buffers(column)
    for a, b in segments(data, offs, 1 << 19):
        part = data[offs[a] : offs[b]]
        raw = part.tobytes()
        bounds = offs[a : b + 1] - offs[a]
        cuts = cut_points(part)
        spans = np.searchsorted(cuts, bounds)
        texts = []
        for r in range(b - a):
            lo, hi = int(bounds[r]), int(bounds[r + 1])
            inner = cuts[spans[r] : spans[r + 1]]
            # a hash whose window reaches into the row before is no cut of this row
            points = [lo, *inner[inner >= lo + WINDOW].tolist(), hi]
            texts.append([raw[x:y] for x, y in zip(points, points[1:]) if y > x])
        yield texts


def encode(df: DataFrame, path: str | None = None, text: str = "text", id: str = "doc_id", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``ids`` also the ids and the decoded text."""
    path = path or vocabulary_path()

    def run(batches):
        c = codec(path)
        for batch in batches:
            rows = [x for texts in chunked(batch.column(1)) for x in c.encode(texts)]
            cols = [batch.column(0), pa.array([x[0] for x in rows], pa.int64())]
            cols += [pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in rows], pa.string()) for k in (1, 2)]
            if ids:
                cols += [pa.array([[int(i) for i in x[1].split()] for x in rows], pa.list_(pa.int32())), pa.array([x[2] for x in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if ids else [])])

    kind = df.schema[id].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""
    rows = df.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op10_bpe": op10_bpe}
SQL: dict[str, str] = {}
