"""Secret scan: each rule's regex becomes a Boolean query over trigrams; postings give candidates, the regex decides."""

from __future__ import annotations

import hashlib
import re
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import LOWER, slices

#: Kinds in their listed order: name, regex, least length, group of that length. The first three are the contract's.
RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}", 0, 0),
    ("google_api", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}", 0, 0),
    ("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}=*", 0, 0),
    ("url_login", r"[a-z][a-z0-9+]{1,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+", 0, 0),
    ("sendgrid", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", 0, 0),
)
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"
MAX_SET = 64

#: A query is True (no mandatory trigram), a trigram, or ("and" | "or", queries).


def both(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts or not parts:
        return True
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(dict.fromkeys(parts)))


def of_strings(strings: set[str]) -> object:
    """The query that one of these strings occurs (lower-cased A-Z), in trigrams of its bytes."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(x.encode() for x in strings)])


def spelled(chars: set[str], loose: bool) -> set[str] | None:
    """``chars`` with A-Z in lower case; None where other characters may stand for one: cased ones beyond ASCII, and if the rule ignores case beyond ASCII, i, k and s."""
    low = {c.lower() if c.isascii() else c for c in chars}
    return None if any(not c.isascii() and c.lower() != c.upper() or loose and c in "iks" for c in low) else low


def trigram_query(pattern: str) -> object:
    """Mandatory trigrams of a regex, walking its parse tree with the exact strings of the run just read."""

    flags = re.compile(pattern).flags
    loose = not flags & re.ASCII and bool(flags & re.IGNORECASE)

    def walk(items, loose=loose) -> tuple[set[str] | None, object]:
        """Exact strings of a sequence (None: unbounded), and the query of what it has beyond them."""
        run, queries, exact = {""}, [], True
        for op, arg in items:
            strings, query = None, True
            if op is K.LITERAL:
                strings = spelled({chr(arg)}, loose)
            elif op is K.IN and all(o in (K.LITERAL, K.RANGE) for o, _ in arg):
                chars = {chr(c) for o, a in arg for c in (range(a[0], min(a[1], a[0] + 200) + 1) if o is K.RANGE else (a,))}
                strings = spelled(chars, loose) if len({c.lower() for c in chars}) <= 6 else None
            elif op is K.SUBPATTERN:
                strings, query = walk(arg[-1], (loose or bool(arg[1] & re.IGNORECASE)) and not (flags | arg[1]) & re.ASCII)
            elif op is K.BRANCH:
                got = [walk(x, loose) for x in arg[1]]
                strings = set().union(*(s for s, _ in got)) if all(s is not None for s, _ in got) else None
                query = True if strings is not None else both("or", [q for _, q in got])
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
                low, high, sub = arg
                s, q = walk(sub, loose)
                query = q if low else True
                if s is not None and high <= 3:
                    strings = set().union(*({""} if n == 0 else s if n == 1 else {a * n for a in s} for n in range(low, int(high) + 1))) if len(s) == 1 or high == 1 else None
                elif s is not None and low:
                    query = both("and", [query, of_strings(s)])
            queries.append(query)
            if strings is not None and len(run) * len(strings) <= MAX_SET:
                run = {a + b for a in run for b in strings}
            else:
                exact = False
                queries.append(of_strings(run))
                run = {""} if strings is None else strings
        queries.append(of_strings(run))
        return (run if exact else None), both("and", queries)

    return walk(_parser.parse(pattern))[1]


def trigrams_in(query: object) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_in, query[1]))


def answer(query: object, postings: dict[bytes, np.ndarray], every: np.ndarray) -> np.ndarray:
    """Rows whose postings satisfy the query."""
    if query is True:
        return every
    if isinstance(query, bytes):
        return postings[query]
    got = [answer(q, postings, every) for q in query[1]]
    out = got[0]
    for x in got[1:]:
        out = np.intersect1d(out, x, True) if query[0] == "and" else np.union1d(out, x)
    return out


class Index:
    """Postings of the trigrams that the rules ask for, over the texts of one slice."""

    def __init__(self, wanted: list[bytes]):
        if len(wanted) >= 1 << 16:
            raise ValueError(f"rules ask for {len(wanted)} trigrams; an index holds {(1 << 16) - 1}")
        self.wanted = wanted
        self.codes = np.array([int.from_bytes(t, "big") for t in wanted], np.uint32)
        self.slot = np.zeros(1 << 24, np.uint16)
        self.slot[self.codes] = np.arange(1, len(wanted) + 1)

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        low = LOWER[data].astype(np.uint32)
        slot = self.slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.zeros(0, np.uint16)
        at = np.flatnonzero(slot)
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        row, slot = row[inside], slot[at[inside]]
        order = np.argsort(slot, kind="stable")  # rows of a slot stay in order
        row, cuts = row[order], np.searchsorted(slot[order], np.arange(1, len(self.wanted) + 2))
        return {t: np.unique(row[cuts[k] : cuts[k + 1]]) for k, t in enumerate(self.wanted)}


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) with the secret spans of the whole text.

    Null and empty texts have no spans (the digest is of the empty string); an empty table gives no rows. Repeated rows are scanned
    each. Spans of different kinds may overlap; all are kept. Work is per row: no shuffle.
    """
    queries = [trigram_query(p) for _, p, _, _ in rules]

    def run(batches):
        index = Index(sorted(set().union(*map(trigrams_in, queries))))
        compiled = [re.compile(p) for _, p, _, _ in rules]
        for batch, data, offsets in slices(batches):
            n, raw = batch.num_rows, data.tobytes()
            postings, every = index.postings(data, offsets), np.arange(n)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            texts: dict[int, str] = {}
            for k, (_, _, least, group) in enumerate(rules):
                for r in answer(queries[k], postings, every).tolist():
                    if r not in texts:
                        texts[r] = raw[offsets[r] : offsets[r + 1]].decode()
                    for m in compiled[k].finditer(texts[r]):
                        if m.end(group) - m.start(group) >= least:
                            spans[r].append((m.start(), k, m.end()))
            write = lambda found: ",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in sorted(found))
            counts = [[sum(k == j for _, k, _ in x) for x in spans] for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(write([y for y in x if y[1] < 3]).encode()).hexdigest() for x in spans], pa.string()),
                    pa.array([write(x) for x in spans], pa.string()), pa.array([len(x) for x in spans], pa.int64()),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
