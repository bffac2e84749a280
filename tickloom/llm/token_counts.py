"""Exact token counts of a byte-level BPE at every prefix, by dynamic programming.

A sequence of tokens is what the BPE makes of its bytes exactly if every two neighbours are what it makes of
theirs. So the last token of a prefix is the one token that ends there and may follow the last token of the
prefix before it, and its count is one more. One pass over a piece gives the count at each of its prefixes; these
are stored with the piece, so a text costs a few vector operations and the pieces not seen before. Its own prefix
counts are the sums of the pieces' last ones, and inside a piece the stored ones: a budget is looked up by search in
the sums and then in one piece. Nothing is encoded again; only where a cut falls among blanks, which then go with
other pieces than before it, are those few pieces put together anew.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bytetext import Powers, pieces, raw, span_hashes

#: How the tokenizer splits text before merging (the public pattern of this kind of vocabulary).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces and pairs remembered by a worker; beyond it starts afresh, which changes no result.
REMEMBERED = 800_000
#: Pieces after the first that goes beyond a budget in which a prefix can still end, and before it.
AROUND = 8


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in such vocabulary files: printable ones for themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at prefixes, for the tokenizer in a .json file of byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        letters = _byte_letters()
        undo = lambda s: bytes(letters[c] for c in s)
        self.ids = {undo(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[undo(a), undo(b)] = rank
        self.specials = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]
        self.longest = max(map(len, self.ids))
        self.words = {i: t for t, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes | tuple[int, ...]] = {}
        self.powers = Powers()
        self._classes = None
        self._split = None
        self._special = None

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuse what is not a plain byte-level BPE with the pattern that is built in."""
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normalizer and with the usual split are supported")
        if any(not t.get("special") or any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens must be special and plain")
        if len(model["vocab"]) >= 1 << 20:
            raise ValueError("vocabularies of 2**20 tokens and more are not supported")

    # -- dynamic programming over one piece

    def _merged(self, data: bytes) -> list[bytes]:
        """What the merges make of a few bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.ranks:
                break
            pair = parts[best], parts[best + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, a: int, b: int) -> bool:
        ok = self.pairs.get(key := a << 20 | b)
        if ok is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            x, y = self.words[a], self.words[b]
            ok = self.pairs[key] = (x, y) not in self.ranks and self._merged(x + y) == [x, y]
        return ok

    def table(self, piece: bytes) -> list[int]:
        """Token counts of every prefix of a piece, from the empty one on."""
        n, ids, pairs, longest = len(piece), self.ids, self.pairs, self.longest
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                token = ids.get(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start]
                    ok = pairs.get(before << 20 | token)
                    if not (self._follows(before, token) if ok is None else ok):
                        continue
                elif end > 1 and self._own(piece[:end], token) is False:
                    continue
                last[end], count[end] = token, count[start] + 1
                break
        return count

    def stored(self, piece: str):
        """Token counts at every prefix of a piece, by code points; made once for each piece."""
        found = self.tables.get(piece)
        if found is None:
            data = piece.encode()
            count = self.table(data)
            if len(data) > len(piece):
                count = [n for n, x in zip(count, data, strict=False) if (x & 0xC0) != 0x80] + count[-1:]
            if len(self.tables) >= REMEMBERED:
                self.tables.clear()
            found = self.tables[piece] = bytes(count) if count[-1] < 256 else tuple(count)
        return found

    def _own(self, piece: bytes, token: int) -> bool:
        """Whether merging leads to this one token (a vocabulary may hold words that no merge reaches)."""
        ok = self.pairs.get(key := -1 - token)
        if ok is None:
            ok = self.pairs[key] = self._merged(piece) == [piece]
        return ok

    # -- splitting

    def classes(self) -> np.ndarray:
        """0 other, 1 letter, 2 number, 3 white space, for each code point."""
        if self._classes is None:
            import regex

            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            out = np.zeros(0x110000, np.uint8)
            for k, p in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\s+")):
                for m in regex.finditer(p, every):
                    a, b = m.span()
                    out[a + 0x800 * (a >= 0xD800) : b + 0x800 * (b > 0xD800)] = k
            self._classes = out
        return self._classes

    def split(self, text: str) -> list[tuple[int, int, bool]]:
        """(start, end, special) of the pieces of a text."""
        import regex

        if self._split is None:
            self._split = regex.compile(SPLIT)
            self._special = regex.compile("|".join(map(regex.escape, self.specials)) or r"(?!)")
        out, at = [], 0
        for m in [*self._special.finditer(text), None]:
            stop = m.start() if m else len(text)
            out += [(at + s.start(), at + s.end(), False) for s in self._split.finditer(text[at:stop])]
            if m:
                out.append((m.start(), m.end(), True))
                at = m.end()
        return out

    def starts(self, points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts laid end to end (no special tokens in them); rows: where texts begin, and the end."""
        n = len(points)
        kind = self.classes()[points]
        head = np.zeros(n + 1, bool)
        head[rows] = True
        first = head.copy()
        head[1:n] |= kind[1:] != kind[:-1]
        # The last of several blanks, and a single space, go with what follows in the same text.
        b = np.flatnonzero(head[1:n] & ~first[1:n] & (kind[:-1] == 3)) + 1
        space = points[b - 1] == 32
        head[b - 1] = True
        head[b[space]] = False
        # 's and the like after nothing that a blank joins.
        q = np.flatnonzero((points == 39) & head[:n])
        q = q[q + 1 < n]
        q = q[~first[q + 1] & (kind[np.minimum(q + 1, n - 1)] == 1)]
        if len(q):
            one = points[q + 1]
            two = points[np.minimum(q + 2, n - 1)]
            short = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            inside = (q + 2 < n) & ~first[np.minimum(q + 2, n)]
            long = inside & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            head[q[short | long] + 1] = False
            head[q[short] + 2] = True
            head[q[long & ~short] + 3] = True
        return np.flatnonzero(head[:n])

    # -- counting

    def counts(self, data: np.ndarray, offsets: np.ndarray, budgets: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Tokens of each text of UTF-8 bytes laid end to end, and for each budget the code points of the longest prefix within it."""
        rows = len(offsets) - 1
        out = np.zeros(rows, np.int64)
        whole = data.tobytes()
        odd = set()
        for s in self.specials:
            at = whole.find(s.encode())
            while at >= 0:
                odd.add(int(np.searchsorted(offsets, at, "right") - 1))
                at = whole.find(s.encode(), at + 1)
        text = whole.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if not len(points):
            return out, [out.copy() for _ in budgets]
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        marks = lead[offsets]
        starts = self.starts(points, marks)
        ends = np.append(starts[1:], len(points))
        uniq, back = np.unique(span_hashes(points, starts, ends, self.powers), return_inverse=True)
        where = np.zeros(len(uniq), np.int64)
        where[back] = np.arange(len(back))
        parts = [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        value = np.array([(t or self.stored(p))[-1] for p, t in zip(parts, map(self.tables.get, parts), strict=True)], np.int64)
        total = np.concatenate([[0], np.cumsum(value[back])])
        cut = np.searchsorted(starts, marks)
        out = total[cut[1:]] - total[cut[:-1]]
        odd = {i for i in odd if any(s in text[marks[i] : marks[i + 1]] for s in self.specials)}
        for i in odd:
            own = text[marks[i] : marks[i + 1]]
            out[i] = sum(1 if sp else self.stored(own[a:b])[-1] for a, b, sp in self.split(own))
        fits = []
        for budget in budgets:
            best = np.diff(marks)
            for i in np.flatnonzero(out > budget).tolist():
                if i in odd:
                    best[i] = self.longest_prefix(text[marks[i] : marks[i + 1]], budget)
                    continue
                # The piece that goes beyond the budget, found in the sums, and a few around it.
                k = int(np.searchsorted(total, total[cut[i]] + budget, "right")) - 1
                low, high = max(int(cut[i]), k - AROUND), min(int(cut[i + 1]), k + AROUND)
                cuts = [(int(starts[j] - marks[i]), int(ends[j] - marks[i]), False) for j in range(low, high)]
                best[i] = self._longest(text[marks[i] : marks[i + 1]], cuts, (total[low : high + 1] - total[cut[i]]).tolist(), budget)
            fits.append(best)
        return out, fits

    def _inside(self, text: str, cuts: list, done: list, k: int) -> list[int]:
        """Tokens of the prefixes that end in piece k, after each of its code points; done[j]: tokens before piece j."""
        a, b, special = cuts[k]
        back = k
        if special or text[a] == "'" or text[a].isspace():
            # A cut here can change how the pieces before it split, back to where blanks or signs began.
            while back and not cuts[back - 1][2] and (text[cuts[back - 1][0] : cuts[back - 1][1]].isspace() or special):
                back -= 1
                if not text[cuts[back][0] : cuts[back][1]].isspace():
                    break
        if special or text[a] == "'" or back < k:
            start = cuts[back][0]
            return [done[back] + sum(1 if s else self.stored(text[start + x : start + y])[-1] for x, y, s in self.split(text[start:p])) for p in range(a + 1, b + 1)]
        return [done[k] + n for n in self.stored(text[a:b])[1:]]

    def _longest(self, text: str, cuts: list, done: list, budget: int) -> int:
        """The end of the longest prefix within the budget among those that end in the pieces `cuts`, or where these begin."""
        for k in range(len(cuts) - 1, -1, -1):
            if done[max(0, k - AROUND)] <= budget:
                for p, n in reversed(list(enumerate(self._inside(text, cuts, done, k), cuts[k][0] + 1))):
                    if n <= budget:
                        return p
        return cuts[0][0] if cuts else 0

    def _done(self, text: str, cuts: list) -> list[int]:
        done = [0]
        for a, b, special in cuts:
            done.append(done[-1] + (1 if special else self.stored(text[a:b])[-1]))
        return done

    def prefixes(self, text: str) -> np.ndarray:
        """counts[p]: tokens of the first p code points, for p from 0 to the length."""
        cuts = self.split(text)
        done = self._done(text, cuts)
        return np.array([0] + [n for k in range(len(cuts)) for n in self._inside(text, cuts, done, k)], np.int64)

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix that takes no more than `budget` tokens."""
        cuts = self.split(text)
        return self._longest(text, cuts, self._done(text, cuts), budget)


def _shared(path: str, make) -> PrefixCounter:
    """One counter for each file and worker process, kept between tasks."""
    home = sys.modules.setdefault("_tickloom_kept", types.ModuleType("_tickloom_kept")).__dict__
    if path not in home:
        home[path] = make(path)
    return home[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, budgets: tuple[int, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit, and for each budget the code points of the longest prefix within it.

    path: the tokenizer's .json file, at the same place on every executor. A null text counts as empty (0 tokens).
    Rows keep their multiplicity and a null id stays null; other columns are not read. Texts are counted whole, however
    long. An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_tokens", "over_limit", *(f"prefix_{b}" for b in budgets)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _shared(path, PrefixCounter)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = raw(part.column("text"))
                n, fits = counter.counts(data, offsets, budgets)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit), *(pa.array(x, pa.int64()) for x in fits)], names=names)

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean" + "".join(f", prefix_{b} bigint" for b in budgets))
