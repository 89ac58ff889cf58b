"""Chunks by tokens: a text is cut at the coarsest separator that makes pieces small enough, and pieces are packed into chunks that overlap.

The tokenizer is a rank file of byte pairs in the form of the public library, whose path is a parameter; each task reads it once.
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scan

SIZE, OVERLAP = 512, 50
#: From coarse to fine; the empty one cuts between characters.
SEPARATORS = ("\n\n", "\n", " ", "")
RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def counter(path: str, held: int = 1 << 18) -> Callable[[str], int]:
    """Number of tokens of a text; those of short texts, which repeat, are remembered up to ``held`` of them."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    known: dict[str, int] = {}

    def count(text: str) -> int:
        if len(text) > 40:
            return len(encoding.encode_ordinary(text))
        n = known.get(text)
        if n is None:
            n = len(encoding.encode_ordinary(text))
            if len(known) < held:
                known[text] = n
        return n

    return count


def pieces(text: str, count: Callable[[str], int], size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[tuple[str, int]]:
    """``text`` in pieces of at most ``size`` tokens (single characters may be more), each with its tokens; a separator begins the piece after it, so joined they are the text."""
    n = count(text)
    if n <= size or len(text) == 1 or not separators:
        yield text, n
        return
    at, rest = separators[0], separators[1:]
    parts = list(text) if not at else [p if k == 0 else at + p for k, p in enumerate(text.split(at))]
    for part in parts:
        if part:
            yield from pieces(part, count, size, rest)


def packed(text: str, count: Callable[[str], int], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[str, int, int]]:
    """(chunk, first, end): chunks of ``text`` in order, with the characters they span before they are stripped. A chunk holds as many pieces as have ``size`` tokens in sum (joined and stripped they may have a few more or less); the next one begins with
    the last of them that have at most ``overlap``, or fewer if the new piece needs the room. Blank chunks are left out."""
    out, held, total, place = [], deque(), 0, 0

    def close():
        chunk = "".join(p for p, *_ in held).strip()
        if chunk:
            out.append((chunk, held[0][2], place))

    fine = (p for coarse in pieces(text, count, size) for p in (pieces(coarse[0], count, max(1, overlap)) if coarse[1] > overlap else (coarse,)))
    for piece, n in fine:
        if held and total + n > size:
            close()
            while held and (total > overlap or total + n > size):
                total -= held.popleft()[1]
        held.append((piece, n, place))
        total, place = total + n, place + len(piece)
    if held and (not out or place > out[-1][2]):
        close()
    return out


def chunked(units: DataFrame, keys: list[str], path: str = RANKS, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``units`` (``keys``, text) in chunks: keys, piece (from 0), chunk, first, end, n_tokens. No chunk crosses a unit, and every character that is no white space is in one. Null and blank texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than a chunk")
    kinds = ", ".join(f"{k} {units.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        count = counter(path)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                for piece, (chunk, first, end) in enumerate(packed(text or "", count, size, overlap)):
                    at.append(k)
                    rows.append((piece, chunk, first, end, count(chunk)))
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*keys, "piece", "chunk", "first", "end", "n_tokens"])

    return units.select(*keys, "text").mapInArrow(run, f"{kinds}, piece int, chunk string, first int, end int, n_tokens int")


def token_chunks(spark, sf_dir: str) -> DataFrame:
    """Every document's chunks of 512 tokens that overlap by up to 50."""
    out = chunked(scan(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return out.select("doc_id", "piece", "n_tokens", "first", "end", F.md5("chunk").alias("digest"))


QUERIES = {"c2_token_chunks": token_chunks}
#: DuckDB has no tokenizer; tests hold the chunks against their definition.
ORACLE_SQL: dict[str, str] = {}
