"""Suffix-array dedup: bytes of strings of a minimum length that start more than once go.

Texts are dealt so that equal strings of ``LENGTH`` bytes meet: each chooses the same anchor, the smallest hash
among its 64-byte grams, and an anchor's different surroundings lie in one block. In a block, the Burrows-Wheeler
transform of all its strings is built, and intervals are extended backwards by single bytes, breadth first: that derives common
prefixes by increasing value and stops at ``LENGTH``. What no interval has bounded by then starts more than once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import table
from .words import _BYTE, mix, powers, slices

LENGTH, GRAM = 400, 64
#: Bits of a gram's place beside its hash when the smallest is chosen: a text may have 2 GB.
PLACE_BITS = 31
#: Bytes of one block. Surroundings of an anchor that are larger together are dealt anew by what lies next to the anchor.
BLOCK_BYTES = 1 << 20
#: Text that one pass over texts takes; its arrays are some hundred times as large.
SLICE_BYTES = 1 << 19


class Hashes:
    """Hashes of substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * up[:-1], out=self.total[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.total[start + length] - self.total[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def anchored(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, anchor, surroundings' hash, start, length and the anchor's place from the start: each window start of each text is in one of them."""
    wide = LENGTH - GRAM + 1
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    hashes = Hashes(data)
    gram = hashes.of(np.arange(len(data) - GRAM + 1), GRAM)
    bits = np.uint64(PLACE_BITS)
    packed = (gram >> bits << bits) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(packed) // wide)
    padded = np.full(blocks * wide, np.iinfo(np.uint64).max)
    padded[: len(packed)] = packed
    padded = padded.reshape(blocks, wide)
    ahead = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(padded, axis=1).ravel()
    starts = len(data) - LENGTH + 1
    least = np.minimum(ahead[:starts], behind[wide - 1 : wide - 1 + starts])
    step = np.zeros(len(data) + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    np.add.at(step, offsets[:-1][long], 1)
    np.add.at(step, offsets[1:][long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[:starts] > 0)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    place = (least[at] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.concatenate(([True], (np.diff(place) != 0) | (np.diff(at) != 1)))
    low, high = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    length = high - low + LENGTH
    row = np.searchsorted(offsets, low, "right") - 1
    return row, gram[place[new]].view(np.int64), hashes.of(low, length).view(np.int64), low - offsets[row], length, place[new] - low


def surroundings(docs: DataFrame) -> DataFrame:
    """(doc_id, key, anchor, nb, low, length, off) of every anchor's surroundings in ``docs`` (doc_id, key, text)."""

    def run(batches):
        for batch, data, offsets in slices(batches, 2, SLICE_BYTES):
            row, anchor, nb, low, length, off = anchored(data, offsets)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor), pa.array(nb), pa.array(low), pa.array(length.astype(np.int32)), pa.array(off.astype(np.int32))], names=["doc_id", "key", "anchor", "nb", "low", "length", "off"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, anchor long, nb long, low long, length int, off int")


def suffixes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in the order of their first ``LENGTH`` symbols or more, and each suffix's place in it.

    Prefix doubling: a round sorts the suffixes that are still equal by the places of what follows them. A round's keys
    hold both places and the suffix, so they fit one number each if there are no more than 2**21 symbols.
    """
    n = len(symbols)
    bits, low = np.uint64(21), np.uint64((1 << 21) - 1)
    order = np.sort((symbols.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64))
    value, order = order >> bits, (order & low).astype(np.int64)
    new = np.ones(n, bool)
    new[1:] = value[1:] != value[:-1]
    place = np.zeros(n, np.int64)
    place[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ahead = 1
    while ahead < LENGTH:
        last = np.append(new[1:], True)
        at = np.flatnonzero(~(new & last))
        if not len(at):
            break
        own = order[at]
        after = np.where(own + ahead < n, place[np.minimum(own + ahead, n - 1)] + 1, 0)
        keys = np.sort((place[own].astype(np.uint64) << np.uint64(42)) | (after.astype(np.uint64) << bits) | own.astype(np.uint64))
        own, keys = (keys & low).astype(np.int64), keys >> bits
        first = np.ones(len(at), bool)
        first[1:] = keys[1:] != keys[:-1]
        order[at] = own
        new[at] = first
        place[own] = np.maximum.accumulate(np.where(first, at, 0))
        ahead *= 2
    place[order] = np.arange(n)
    return order, place


def bounds(symbols: np.ndarray, n_ends: int, order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each place of the order and one after the last, whether the suffixes on its two sides share less than ``LENGTH`` symbols.

    The transform's last symbols are those before each suffix; going to them (``back``) extends an interval's string by one
    symbol in front. An interval is a string; intervals of one length lie apart. Each bounds what comes after it, at its own length if no shorter
    one did before, and only then goes on, so all values up to the minimum come in order and each boundary is met once.
    ``symbols`` below ``n_ends`` end a string, each is another, and nothing is extended over them.
    """
    n = len(order)
    before = symbols[order - 1]  # of the first suffix it is the last symbol, which ends a string
    back = place[order - 1]
    lead = symbols[order]
    known = np.zeros(n + 1, bool)
    known[n] = True
    known[0] = True
    known[1:n] = lead[1:] != lead[:-1]
    begin = np.flatnonzero(known[:n])
    stop = np.append(begin[1:], n)
    owner = np.full(n, -1)
    for _ in range(1, LENGTH):
        size = stop - begin
        inside = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        of = np.repeat(np.arange(len(size)), size)
        alive = before[inside] >= n_ends
        to, of = back[inside[alive]], of[alive]
        if not len(to):
            break
        owner[to] = of
        to = np.flatnonzero(owner >= 0) if len(to) > n >> 5 else np.sort(to)
        of = owner[to]
        owner[to] = -1
        new = np.ones(len(to), bool)
        new[1:] = (np.diff(to) != 1) | (of[1:] != of[:-1]) | (lead[to[1:]] != lead[to[:-1]])
        begin = to[new]
        stop = to[np.append(np.flatnonzero(new)[1:] - 1, len(to) - 1)] + 1
        fresh = ~known[stop]
        begin, stop = begin[fresh], stop[fresh]
        known[stop] = True
    return known


def repeated(strings: list[bytes], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String numbers and starts in them of the windows of ``LENGTH`` bytes that start more than once in all ``strings``, each of ``weight`` copies."""
    sizes = np.array([len(x) for x in strings])
    ends = np.cumsum(sizes + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + len(strings)
    symbols[ends] = np.arange(len(strings))
    order, place = suffixes(symbols)
    known = bounds(symbols, len(strings), order, place)
    more = np.zeros(len(symbols), bool)
    more[order[~known[:-1] | ~known[1:]]] = True
    begin = np.cumsum(sizes + 1) - sizes - 1
    many = weight > 1
    whole = np.where(many, sizes - LENGTH + 1, 0)
    at = np.repeat(begin - np.cumsum(whole) + whole, whole) + np.arange(whole.sum())
    more[at] = True
    at = np.flatnonzero(more)
    of = np.searchsorted(ends, at)
    return of, at - begin[of]


def expand(batches):
    """Ranges of repeated windows of (level, anchor, part, nb, n, bytes) rows that come sorted by all but the last two; whole parts of anchors by blocks."""
    held: list[tuple] = []

    def flush():
        of, at = repeated([x[5] for x in held], np.array([x[4] for x in held]))
        new = np.ones(len(at), bool)
        new[1:] = (of[1:] != of[:-1]) | (np.diff(at) != 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(at) - 1) if len(at) else first
        own = of[first].tolist()
        columns = [pa.array([held[k][c] for k in own], kind) for c, kind in ((0, pa.int32()), (1, pa.int64()), (3, pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(at[first]), pa.array(at[last] + LENGTH)], names=["level", "anchor", "nb", "a", "b"])

    total = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] == held[-1][:4]:
                continue  # a repeated row of the table
            if held and total + len(row[5]) > BLOCK_BYTES and row[:3] != held[-1][:3]:
                yield flush()
                held.clear()
                total = 0
            held.append(row)
            total += len(row[5]) + 1
    if held:
        yield flush()


def halves(batches):
    """Splits (anchor, part, nb, n, off, bytes, width) rows by how far before the anchor a window starts, into ranges of half the width.

    All windows of a range hold the same bytes next to the anchor, and these name its part; ``own`` names the bytes of a part, ``a`` is where they begin.
    """
    for batch in batches:
        out = []
        for anchor, part, nb, n, off, string, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            wide, last = -(-width // 2), len(string) - LENGTH
            for k in range((off - last) // wide, off // wide + 1):
                start, stop = max(0, off - (k + 1) * wide + 1), min(last, off - k * wide)
                core, own = string[off - k * wide : off - (k + 1) * wide + 1 + LENGTH], string[start : stop + LENGTH]
                name = [int.from_bytes(hashlib.blake2b(x + b"%d %d %d" % (k, wide, part), digest_size=8).digest(), "little", signed=True) for x in (core, own)]
                out.append((anchor, name[0], nb, n, off - start, own, wide, name[1], start))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["anchor", "part", "nb", "n", "off", "bytes", "width", "own", "a"])


def ranges(pieces: DataFrame) -> DataFrame:
    """(anchor, nb, a, b): repeated windows of ``pieces`` (anchor, nb, n, off, bytes), the different surroundings of each anchor.

    An anchor whose surroundings don't fit a block is dealt anew in parts by :func:`halves`, equal strings of a part become one, and
    parts that still don't fit are split again: at the latest, a part is one string of one window. Ranges found in parts are
    then read back as ranges of what they were split from.
    """
    columns = ["anchor", "part", "nb", "n", "off", "bytes", "width"]
    now = pieces.withColumns({"part": F.lit(0).cast("long"), "off": F.col("off").cast("long"), "width": F.lit(LENGTH - GRAM + 1)}).select(*columns)
    ready, members = [], []
    while True:
        size = now.groupBy("anchor", "part").agg(F.sum(F.length("bytes") + 1).alias("total"), F.max("width").alias("widest"))
        large = table(size.where((F.col("total") > BLOCK_BYTES) & (F.col("widest") > 1)).select("anchor", "part"))
        ready.append(now.join(large, ["anchor", "part"], "left_anti").withColumn("level", F.lit(len(members))))
        if large.isEmpty():
            break
        split = now.join(large, ["anchor", "part"], "left_semi").select(*columns)
        members.append(table(split.mapInArrow(halves, "anchor long, part long, nb long, n long, off long, bytes binary, width int, own long, a long")))
        first = [F.first(c).alias(c) for c in ("off", "bytes", "width")]
        now = table(members[-1].groupBy("anchor", "part", "own").agg(F.sum("n").alias("n"), *first).withColumnRenamed("own", "nb")).select(*columns)
    rows = ready[0]
    for part in ready[1:]:
        rows = rows.unionByName(part)
    by = ["level", "anchor", "part", "nb"]
    dealt = rows.select(*by, "n", "bytes").repartition("level", "anchor", "part").sortWithinPartitions(*by)
    found = table(dealt.mapInArrow(expand, "level int, anchor long, nb long, a long, b long"))
    out = found.where(F.col("level") == len(members)).drop("level")
    for level in reversed(range(len(members))):
        within = members[level].select("anchor", "own", F.col("nb").alias("whole"), F.col("a").alias("start"))
        back = out.withColumnRenamed("nb", "own").join(within, ["anchor", "own"]).select("anchor", F.col("whole").alias("nb"), (F.col("a") + F.col("start")).alias("a"), (F.col("b") + F.col("start")).alias("b"))
        out = back.unionByName(found.where(F.col("level") == level).drop("level"))
    return out


def marks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(anchor, nb, a, b): repeated bytes of each kind of surroundings, from its start."""
    kinds = table(found.groupBy("anchor", "nb").agg(F.count("*").alias("n"), F.max("length").alias("length"), F.max("off").cast("long").alias("off"), F.min(F.struct("doc_id", "key", "low")).alias("rep")))
    counts = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("places")).where("places > 1")
    live = table(kinds.join(counts, "anchor"))
    whole = live.where("kinds = 1").select("anchor", "nb", F.lit(0).cast("long").alias("a"), F.col("length").cast("long").alias("b"))
    many = live.where("kinds > 1").select(F.col("rep.doc_id").alias("r_id"), F.col("rep.key").alias("r_key"), F.struct("anchor", "nb", "n", "off", F.col("rep.low").alias("low"), "length").alias("s"))
    many = many.groupBy("r_id", "r_key").agg(F.collect_list("s").alias("s"))
    cut = docs.join(many, (F.col("key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    cut = cut.withColumn("bytes", F.encode("text", "UTF-8"))
    piece = lambda s: F.struct(s["anchor"].alias("anchor"), s["nb"].alias("nb"), s["n"].alias("n"), s["off"].alias("off"), F.substring(F.col("bytes"), s["low"].cast("int") + 1, s["length"]).alias("bytes"))
    pieces = table(cut.select(F.explode(F.transform("s", piece)).alias("p")).select("p.*"))
    return table(whole.unionByName(ranges(pieces)))


def spans(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (doc_id, key, text) with ``ranges``, an array of (start, end) bytes to remove, null where none; may overlap."""
    found = table(surroundings(docs))
    gone = found.join(marks(docs, found), ["anchor", "nb"]).select("doc_id", "key", F.struct((F.col("low") + F.col("a")).alias("start"), (F.col("low") + F.col("b")).alias("end")).alias("r"))
    gone = gone.groupBy("doc_id", "key").agg(F.collect_set("r").alias("ranges")).select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "ranges")
    joined = docs.join(gone, (F.col("key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left")
    return joined.select("doc_id", "text", "ranges")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes).

    Texts are UTF-8 bytes (null: empty); texts shorter than the minimum keep all. Repeated rows count as other
    places of each other's strings, so they lose all that is long enough. Rows with a null or repeated doc_id
    are told apart by their texts. Other columns don't matter.
    """
    docs = docs.select("doc_id", "text").withColumn("key", F.xxhash64("text"))

    def run(batches):
        for batch, data, offsets in slices(batches):
            out = []
            for row, r in enumerate(batch.column(2).to_pylist()):
                own = data[offsets[row] : offsets[row + 1]]
                gone = np.zeros(len(own) + 1, np.int32)
                if r:
                    np.add.at(gone, [x["start"] for x in r], 1)
                    np.add.at(gone, [x["end"] for x in r], -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)), hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).drop("kept")
