"""SentencePiece unigram encoding: Viterbi over a double-array trie of pieces with log scores, byte fallback, decoding."""

from __future__ import annotations

import hashlib
import os
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import slices

#: Vocabulary of a public tokenizer; a parameter of every function here.
MODEL_PATH = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARKER = b"\xe2\x96\x81"
#: Spaces and the word after them.
RUN = re.compile(rb" +[^ ]*")
UNKNOWN_PENALTY = 10.0
#: Bytes of a word that is worth cutting.
LONG_WORD = 48
#: A merge-rank vocabulary lists its pieces by how often they were merged. Their log scores follow the Zipf-Mandelbrot law with this shift.
ZIPF_SHIFT = 2.7
#: Words that one task remembers between slices, at most; more are encoded again.
REMEMBERED = 400_000


class Pieces(NamedTuple):
    texts: list[bytes]
    scores: np.ndarray
    kinds: np.ndarray


def varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        i, shift = i + 1, shift + 7
        if b[i - 1] < 128:
            return out, i


def fields(b: bytes):
    """Number and value of each field of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        if key & 7 == 2:
            n, i = varint(b, i)
            yield key >> 3, b[i : i + n]
            i += n
        elif key & 7 == 0:
            value, i = varint(b, i)
            yield key >> 3, value
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, b[i : i + n]
            i += n


def log_scores(scores: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The file's scores, if they are logarithms of chances; scores that are merge ranks become the logarithms of 1 / (rank + shift), scaled to sum to 1.

    Ranks are whole numbers of which the chances' sum would not be near 1. Nothing is trained: the order of the pieces is the file's.
    """
    normal = kinds == 1
    if not normal.any() or 0.5 < np.exp(scores[normal]).sum() < 2 and (scores[normal] % 1).any():
        return scores
    rank = np.empty(int(normal.sum()))
    rank[np.argsort(-scores[normal], kind="stable")] = np.arange(1, normal.sum() + 1)
    out = scores.copy()
    out[normal] = -np.log(rank + ZIPF_SHIFT) - np.log((1 / (rank + ZIPF_SHIFT)).sum())
    return np.float64(np.float32(out))


def load(path: str = MODEL_PATH) -> Pieces:
    """Pieces (text, log score, kind: 1 normal, 2 unknown, 3 control, 4 own, 6 byte) of a .model file."""
    texts, scores, kinds = [], [], []
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                piece = dict(fields(value))
                texts.append(piece[1])
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                kinds.append(piece.get(3, 1))
    kinds = np.array(kinds)
    inner = [t for t, k in zip(texts, kinds.tolist(), strict=True) if k in (1, 4) and MARKER in t.lstrip(MARKER)]
    if inner:
        raise ValueError(f"texts are split at spaces, but these pieces hold the marker after other characters: {inner[:5]}")
    return Pieces(texts, log_scores(np.array(scores, np.float64), kinds), kinds)


class Trie:
    """Double-array trie: from state s byte c leads to base[s] + c if check there is s; leaf[s] is a piece or -1."""

    def __init__(self, pieces: Pieces):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, (text, kind) in enumerate(zip(pieces.texts, pieces.kinds, strict=True)):
            if kind in (1, 4) and text:
                at = 0
                for c in text:
                    if c not in children[at]:
                        children[at][c] = len(children)
                        children.append({})
                        ends.append(-1)
                    at = children[at][c]
                ends[at] = k
        size = 260 * (1 + sum(len(x) > 1 for x in children)) + len(children)
        self.base, self.check, self.leaf = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        used = bytearray(size)
        used[0] = 1
        # nodes with several children stand behind all others so far, those with one fill the gaps
        free, top = 1, 1
        queue = [(0, 0)]
        for node, state in queue:
            self.leaf[state] = ends[node]
            codes = sorted(children[node])
            if not codes:
                continue
            if len(codes) == 1:
                free = used.index(0, max(free, codes[0] + 1))
                base = free - codes[0]
            else:
                base = max(1, top - codes[0])
                while any(used[base + c] for c in codes):
                    base += 1
            self.base[state] = base
            for c in codes:
                used[base + c] = 1
                self.check[base + c] = state
                queue.append((children[node][c], base + c))
            top = max(top, base + codes[-1] + 1) if len(codes) > 1 else top
        end = 1 + max(i for _, i in queue) + 256
        self.base, self.check, self.leaf = self.base[:end], self.check[:end], self.leaf[:end]


class Encoder:
    def __init__(self, path: str = MODEL_PATH):
        self.pieces = load(path)
        self.trie = Trie(self.pieces)
        self.unknown = int(np.flatnonzero(self.pieces.kinds == 2)[0])
        self.byte = np.full(256, self.unknown)
        for k in np.flatnonzero(self.pieces.kinds == 6):
            self.byte[int(self.pieces.texts[k][3:5], 16)] = k
        self.unknown_score = self.pieces.scores[self.pieces.kinds == 1].min() - UNKNOWN_PENALTY
        self.memory: dict[bytes, np.ndarray] = {}
        #: What each id decodes to, and its number as text.
        self.bytes_of = [bytes([int(t[3:5], 16)]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else b"" if k == 3 else t.replace(MARKER, b" ") for t, k in zip(self.pieces.texts, self.pieces.kinds.tolist(), strict=True)]
        self.names = [str(k) for k in range(len(self.bytes_of))]
        #: Bytes that stand side by side in some piece.
        self.beside = np.zeros((256, 256), bool)
        for k in np.flatnonzero(np.isin(self.pieces.kinds, (1, 4))):
            own = np.frombuffer(self.pieces.texts[k], np.uint8)
            self.beside[own[:-1], own[1:]] = True

    def words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of many words at once: one Viterbi step per start byte runs over all words that are that long."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        flat = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
        for s, k in zip(starts, order, strict=True):
            flat[s : s + len(words[k])] = np.frombuffer(words[k], np.uint8)
        best = np.full(len(flat), -np.inf)
        best[starts] = 0
        back, piece = np.zeros(len(flat), np.int64), np.full(len(flat), -1)
        ends = starts + sizes
        t = self.trie
        for p in range(int(sizes[0]) if len(sizes) else 0):
            live = starts[: np.searchsorted(-sizes, -p, "left")] + p
            live = live[best[live] > -np.inf]
            origin, limit = live, ends[np.searchsorted(starts, live, "right") - 1]
            lead = flat[origin]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            to = np.minimum(origin + width, limit)
            state, at, known = np.zeros(len(live), np.int64), origin, origin
            single = np.zeros(len(live), bool)
            which = np.arange(len(live))
            while len(at):
                step = t.base[state] + flat[at]
                ok = (at < limit) & (t.base[state] > 0) & (t.check[step] == state)
                state, at, known, limit, which = step[ok], at[ok] + 1, known[ok], limit[ok], which[ok]
                found = t.leaf[state] >= 0
                e, k, o = at[found], t.leaf[state[found]], known[found]
                value = best[o] + self.pieces.scores[k]
                better = value > best[e]
                best[e[better]], back[e[better]], piece[e[better]] = value[better], o[better], k[better]
                single[which[found][e == to[which[found]]]] = True
            lone = ~single
            e, o = to[lone], origin[lone]
            value = best[o] + self.unknown_score
            better = value > best[e]
            best[e[better]], back[e[better]], piece[e[better]] = value[better], o[better], self.unknown
        out: list = [None] * len(words)
        for s, e, k in zip(starts.tolist(), ends.tolist(), order.tolist(), strict=True):
            ids = []
            while e > s:
                b = int(back[e])
                if piece[e] == self.unknown:
                    ids += self.byte[flat[b:e]][::-1].tolist()
                else:
                    ids.append(int(piece[e]))
                e = b
            out[k] = np.array(ids[::-1], np.int32)
        return out

    def cut(self, word: bytes) -> list[bytes]:
        """A long word's parts: cut between characters that stand side by side in no piece, so its best path is that of its parts."""
        if len(word) <= LONG_WORD:
            return [word]
        own = np.frombuffer(word, np.uint8)
        at = (np.flatnonzero(~self.beside[own[:-1], own[1:]] & ((own[1:] & 0xC0) != 0x80)) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)]

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts. Each space becomes the marker, one more stands first; no piece of the model has a
        marker after another character (:func:`load` checks it), so the best path of a text is that of each run of markers and its word."""
        split = []
        for x in texts:
            split.append([part for w in RUN.findall(b" " + x) for part in self.cut(w.replace(b" ", MARKER))] if x else [])
        new = list(dict.fromkeys(w for ws in split for w in ws if w not in self.memory))
        if len(self.memory) + len(new) > REMEMBERED:
            self.memory = {}
            new = list(dict.fromkeys(w for ws in split for w in ws))
        self.memory.update(zip(new, self.words(new), strict=True))
        return [np.concatenate([self.memory[w] for w in ws]) if ws else np.zeros(0, np.int32) for ws in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids: byte pieces are bytes, markers are spaces, and the first marker goes."""
        out = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return out.removeprefix(b" ")


def encode(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id and ids array<int> of each row's whole text, unchanged but for spaces as markers.

    Null gives null, the empty text no ids. Of paths with equal scores the one whose last pieces begin first stays. Repeated rows are encoded
    each. A text that itself holds the marker decodes with a space there. Other columns are not read; an empty table gives no rows.
    """

    def run(batches):
        encoder = Encoder(path)
        for batch, data, offsets in slices(batches):
            raw = data.tobytes()
            ids = encoder.texts([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            ends = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32), mask=None)
            lists = pa.ListArray.from_arrays(ends, flat, mask=batch.column(1).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give null."""

    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            texts = [None if x.as_py() is None else encoder.decode(np.array(x.as_py(), np.int64)).decode(errors="replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    """Per row: doc_id, n_pieces, ids_sha256 (of the ids joined by spaces), restored (decoding gives the text back).

    A null text is treated as an empty one: no pieces, restored. Ties, repeated rows and other columns as in :func:`encode`. Restored is false
    where a text holds the marker itself.
    """

    def run(batches):
        encoder = Encoder(path)
        for batch, data, offsets in slices(batches):
            raw = data.tobytes()
            texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = encoder.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(" ".join(map(encoder.names.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]), pa.array([encoder.decode(x) == t for x, t in zip(ids, texts, strict=True)])],
                names=["doc_id", "n_pieces", "ids_sha256", "restored"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, restored boolean")
