"""Secret scanning through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold.
Documents are indexed in blocks: a block's postings map each trigram of some query to the rows that hold it,
they are intersected and joined as the query says, and only the remaining candidates are verified with the
regular expression. A rule whose expression has no mandatory trigram scans every text in full.

The index is partitioned by document and lives beside the texts, so nothing is shuffled, and a lost
executor costs only the blocks that it held.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bytetext import LOWER, pieces, raw


@dataclass(frozen=True)
class Rule:
    """kind, pattern, and what a match must measure: `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base patterns and their least lengths.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of 24 and more are the runs `[0-9a-f]+` of at least that length: a run is taken whole either way.
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, which share the index.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)

#: Above so many alternatives a set of strings is turned into a query.
MOST_STRINGS = 64


def trigram_query(pattern: str):
    """The Boolean query of a pattern: True, a trigram, ("and", parts) or ("or", parts). Letters are folded."""
    exact, query = _walk(list(rp.parse(pattern)))
    return _both(query, _of_strings(exact)) if exact is not None else query


def _of_strings(strings) -> object:
    return _either([_both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


def _both(*parts):
    flat = dict.fromkeys(q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,)) if q is not True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", tuple(flat))


def _either(parts):
    flat = dict.fromkeys(parts)
    return True if True in flat or not flat else next(iter(flat)) if len(flat) == 1 else ("or", tuple(flat))


def _walk(nodes):
    """(the strings that the nodes match, or None if not a small set; a query that holds of any match)."""
    exact, query, whole = {""}, True, True
    for op, arg in nodes:
        strings, more = _node(op, arg)
        if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
            exact = {a + b for a in exact for b in strings}
            query = _both(query, more)
            continue
        query = _both(query, _of_strings(exact), more)
        if strings is not None and len(strings) <= MOST_STRINGS:
            exact = set(strings)
        else:
            exact = {""}
        whole = False
    return (exact, query) if whole else (None, _both(query, _of_strings(exact)))


def _node(op, arg):
    if op is rc.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}, True
    if op is rc.IN:
        chars: set[str] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                chars.add(chr(x).lower() if x < 128 else chr(x))
            elif kind is rc.RANGE and x[1] - x[0] < 16:
                chars |= {chr(c).lower() if c < 128 else chr(c) for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if op is rc.SUBPATTERN:
        return _walk(list(arg[3]))
    if op is rc.BRANCH:
        found = [_walk(list(x)) for x in arg[1]]
        if all(e is not None for e, _ in found):
            return set().union(*(e for e, _ in found)), _either([q for _, q in found])
        return None, _either([_both(q, _of_strings(e)) if e is not None else q for e, q in found])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, sub = arg
        exact, query = _walk(list(sub))
        if (low, high) == (0, 1) and exact is not None:
            return exact | {""}, True
        if low == high == 1:
            return exact, query
        if exact is not None and low >= 1 and len(exact) == 1 and low * len(next(iter(exact))) <= 256:
            text = next(iter(exact)) * low
            return ({text}, True) if low == high else (None, _of_strings({text}))
        return None, (_both(query, _of_strings(exact)) if exact is not None else query) if low >= 1 else True
    if op is rc.AT:
        return {""}, True
    if op is rc.ATOMIC_GROUP:
        return _walk(list(arg))
    return None, True


def trigrams_of(query) -> set[str]:
    return {query} if isinstance(query, str) else set() if query is True else set().union(*map(trigrams_of, query[1]))


class BlockIndex:
    """Postings of one block of texts, for the trigrams of the queries; keys are byte trigrams, A-Z folded."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, n_terms: int) -> None:
        self.rows = len(offsets) - 1
        low = LOWER[data].astype(np.uint32)
        if len(low) < 3:
            hits = doc = np.zeros(0, np.int64)
            term = np.zeros(0, np.int64)
        else:
            term_at = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            hits = np.flatnonzero(term_at)
            doc = np.searchsorted(offsets, hits, "right") - 1
            inside = hits + 3 <= offsets[doc + 1]
            hits, doc = hits[inside], doc[inside]
            term = term_at[hits].astype(np.int64)
        key = np.unique(term * max(self.rows, 1) + doc)
        cuts = np.searchsorted(key, np.arange(1, n_terms + 2) * max(self.rows, 1))
        self.postings = [key[cuts[i] : cuts[i + 1]] % max(self.rows, 1) for i in range(n_terms)]

    def rows_for(self, query, terms: dict) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, str):
            grams = [terms[g] for g in _byte_trigrams(query)]
            found = self.postings[grams[0]]
            for g in grams[1:]:
                found = np.intersect1d(found, self.postings[g], assume_unique=True)
            return found
        parts = [self.rows_for(q, terms) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _byte_trigrams(trigram: str) -> list[bytes]:
    b = trigram.encode()
    return [b[i : i + 3] for i in range(len(b) - 2)]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every match of every rule in whole texts: `id_col`, findings array<struct<kind,start,end>> (by start, then rule order).

    A null text counts as empty. Rows keep their multiplicity, so repeated rows give repeated results;
    a null id stays null; other columns are not read. Positions are code points, ends exclusive.
    Matches of one kind don't overlap and are found from the left; a match that is too short is dropped.
    """
    kind_of = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted({g for q in queries for t in trigrams_of(q) for g in _byte_trigrams(t)})
    terms = {g: i for i, g in enumerate(grams)}
    found_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, np.int16)
        for g, i in terms.items():
            table[(g[0] << 16) | (g[1] << 8) | g[2]] = i + 1
        patterns = [r.compiled() for r in rules]
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = raw(part.column("text"))
                index = BlockIndex(data, offsets, table, len(terms))
                whole = data.tobytes()
                found: list[list] = [[] for _ in range(part.num_rows)]
                texts: dict[int, str] = {}
                for rank, (rule, pattern, query) in enumerate(zip(rules, patterns, queries, strict=True)):
                    for i in index.rows_for(query, terms):
                        i = int(i)
                        if i not in texts:
                            texts[i] = whole[offsets[i] : offsets[i + 1]].decode()
                        for m in pattern.finditer(texts[i]):
                            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                                found[i].append((m.start(), rank, m.end()))
                rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(rows, found_type)], names=[id_col, "findings"])

    del spark
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind_of}, findings array<struct<kind:string,start:bigint,end:bigint>>")


def digest(findings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, a hash of the base spans, and all spans as text."""
    kinds = [r.kind for r in BASE_RULES]
    line = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    count = lambda k: F.size(F.filter("findings", lambda f: f["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("findings", lambda f: f["kind"].isin(*kinds))
    return findings.select(
        id_col,
        *[count(k) for k in kinds],
        F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", line), ",").alias("spans"),
    )
