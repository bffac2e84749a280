"""Exact Jaccard joins of word n-gram sets by partitioning the universe of shingles.

Sets are banded by size. For the pairs whose larger set is in a band, the universe of shingle hashes is cut into
m segments; as a linked pair differs in at most H shingles, at least m - H segments are equal in both. A set
therefore indexes its H + 1 cheapest non-empty segments, by a fixed order in which segments that many sets share
come last: two linked sets that have an equal non-empty segment at all have one among these. Where so many segments
are empty that this can't be relied on, a set indexes all its segments and their one-deletion neighbourhoods, and,
in bands where even these can't settle it, single shingles.

Equal sets are one class from the start. Of the classes that share a key, the first is held against the others; after
the components of these links are known, the classes of a key that few share are held against each other where they
are still apart. What more share, a crowd, gets deeper keys. Its core is the set of its first class and all shingles that
more than a few members have. Two members either have so many shingles in the core that these alone could link them,
and then are held against each other, or, if they are linked, share a shingle outside it: so the members are indexed
again by the crowd and such a shingle, which only a few share. Candidates pass a parity sketch, which loses no link,
and are verified on whole sets. So rows grow as the members of groups do, not as their pairs, and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.bytetext import Powers, give_back, mix, pieces, raw, shingles, words
from tickloom.llm.components import components
from tickloom.llm.joins import bounded, only, without
from tickloom.llm.scratch import let_go, settle

#: Segments for each difference that a pair may have.
SEGMENTS = 2.5
#: Classes of a key that are held against each other; what more share gets deeper keys.
FEW = 32
#: What rows of candidates are.
STAR, CROWD, GROUP = 0, 1, 2
#: Members of a crowd's largest component that the others are held against before anything else.
BRIDGES = 4
#: Buckets of keys to a shuffle partition, which are looked at one after another.
FINER = 4
#: Counters that estimate how many sets share a segment; they only order segments.
SKETCH = 1 << 22
#: Bits of a class that index entries leave out. Classes with equal short names are told apart when candidates get their sketches.
LEFT_OUT = 24
#: Entries that a task gathers before it hands them on.
GATHER = 1 << 20
#: Bytes of text that are shingled at once.
PIECE = 1 << 20
#: Bits of the map of wanted ids (2 MB whatever the input); beyond what it can tell apart, more rows are read.
WANTED = 1 << 24


@dataclass(frozen=True)
class Bands:
    """Size bands for the threshold num / den: band k holds sizes from low[k] to low[k + 1] - 1."""

    num: int
    den: int

    def most_differences(self, a, b):
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def lows(self, largest: int) -> np.ndarray:
        out = [1]
        while out[-1] <= largest:
            out.append(out[-1] * self.den // self.num + 1)
        out.append(out[-1] * self.den // self.num + 1)
        return np.array(out, np.int64)

    def jobs(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(set, band, segments, differences) of every part that a set plays: in its own band, and as the smaller in the next."""
        low = self.lows(int(sizes.max(initial=1)))
        own = np.searchsorted(low, sizes, "right") - 1
        reach = sizes * self.den // self.num
        up = np.flatnonzero(reach >= low[own + 1])
        which = np.concatenate([np.arange(len(sizes)), up])
        band = np.concatenate([own, own[up] + 1])
        top = self.most_differences(low[band + 1] - 1, low[band + 1] - 1)
        m = np.where(top == 0, 1, np.ceil(SEGMENTS * (top + 1)).astype(np.int64))
        partner = np.minimum(low[band + 1] - 1, reach[which])
        order = np.argsort(which, kind="stable")
        return which[order], band[order], m[order], self.most_differences(sizes[which], partner)[order]

    def linked(self, inter, a, b):
        return inter * (self.num + self.den) >= self.num * (a + b)


def set_ids(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; the same for equal sets."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def segment_keys(tokens: np.ndarray, at: np.ndarray, bands: Bands):
    """For the sets of sorted tokens: jobs, and of each non-empty segment its job, key, and first token in `flat`."""
    size = np.diff(at)
    which, band, m, h = bands.jobs(size)
    length = size[which]
    ends = np.cumsum(length)
    job = np.repeat(np.arange(len(which)), length)
    flat = np.arange(ends[-1] if len(ends) else 0) - (ends - length)[job] + at[:-1][which][job]
    t = tokens[flat]
    seg = ((t >> np.uint64(32)) * m[job].astype(np.uint64)) >> np.uint64(32)
    fresh = np.ones(len(t), bool)
    fresh[1:] = (seg[1:] != seg[:-1]) | (job[1:] != job[:-1])
    start = np.flatnonzero(fresh)
    salt = seg[start] * np.uint64(0xA0761D6478BD642F) + band[job[start]].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(1)
    content = np.add.reduceat(mix(t), start) if len(t) else np.zeros(0, np.uint64)
    return which, band, m, h, job[start], mix(content + salt), start, t, salt


def chosen(tokens: np.ndarray, at: np.ndarray, bands: Bands, shared: np.ndarray, hard: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of everything that the sets index; hard: bands where single shingles are needed too."""
    which, band, m, h, job, key, start, t, salt = segment_keys(tokens, at, bands)
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    many = np.bincount(job, minlength=len(which))
    sure = m - h - (m - many) >= 1
    order = np.lexsort((key, shared[key & np.uint64(SKETCH - 1)], job))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
    keep = ~sure[job] | (rank <= h[job])
    sets, keys = [which[job[keep]]], [key[keep]]
    if not sure.all():
        stop = np.append(start[1:], len(t))
        mixed = mix(t)
        for i in np.flatnonzero(~sure[job] & (stop - start > 1)):
            part = mixed[start[i] : stop[i]]
            keys.append(mix(part.sum() - part + salt[i]))
            sets.append(np.full(len(part), which[job[i]]))
        for j in np.flatnonzero(~sure):
            if int(band[j]) in hard:
                n = int(at[which[j] + 1] - at[which[j]])
                first = tokens[at[which[j]] :][: n - -(-n * bands.num // bands.den) + 1]
                keys.append(mix(first + np.uint64(0x2545F4914F6CDD1D) + band[j].astype(np.uint64)))
                sets.append(np.full(len(first), which[j]))
    return np.concatenate(sets), np.concatenate(keys)


def _shingled(part: pa.RecordBatch, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw(part.column("text"))
    return shingles(*words(data, offsets, powers), width)


def _pass_one(rows: DataFrame, kind: str, width: int, bands: Bands) -> DataFrame:
    """Rows (id, text_hash, class, n, hard, sketch) of every document, and the task's counters in pieces (part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "text_hash", "class", "n", "hard", "sketch", "part", "counts"]
        powers, count, id_type = Powers(), np.zeros(SKETCH, np.uint8), None
        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in pieces(batch, "text", PIECE):
                tokens, at = _shingled(part, width, powers)
                size = np.diff(at)
                some = np.flatnonzero(size)
                hard: list[list[int]] = [[] for _ in size]
                if len(some):
                    which, band, m, h, job, key, *_ = segment_keys(tokens, np.append(at[:-1][some], at[-1]), bands)
                    where, times = np.unique(key & np.uint64(SKETCH - 1), return_counts=True)
                    where = where.astype(np.int64)
                    count[where] = np.minimum(count[where] + times, 255)
                    empty = m - np.bincount(job, minlength=len(which))
                    for j in np.flatnonzero((m - h - empty < 1) & (2 * empty > 2 * m - h - 1)):
                        hard[some[which[j]]].append(int(band[j]))
                ids = pa.array(set_ids(tokens, at), mask=size == 0)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text_hash"), ids, pa.array(size), pa.array(hard, pa.list_(pa.int32())), pa.array(sketches(tokens, at), pa.binary()), pa.nulls(len(size), pa.int32()), pa.nulls(len(size), pa.binary())], names=names)
        give_back()
        if id_type is not None:
            k = 16
            blobs = [x.tobytes() for x in np.split(count, k)]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.binary()), pa.array(range(k), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return rows.mapInArrow(run, f"id {kind}, text_hash bigint, class bigint, n bigint, hard array<int>, sketch binary, part int, counts binary")


def _summed(counters: DataFrame) -> np.ndarray:
    """The tasks' counters, added up piece by piece on the cluster; 8 MB come to the driver. Counts stop at what a task and a sum can hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(c.as_buffer(), np.uint8).astype(np.uint32)
                total[p] = total[p] + x if p in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(v, 65535).astype(np.uint16).tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])

    out = np.zeros(SKETCH, np.uint16)
    step = SKETCH // 16
    for r in counters.repartition(16, "part").mapInArrow(run, "part int, counts binary").collect():
        out[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["counts"], np.uint16)
    return out


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes that the largest number needs, none for zero; all numbers in so many)."""
    x = np.ascontiguousarray(x, "<i8").view("<u8")
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return width, x.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(blob: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8")[:, 0]


class _Index:
    """Index entries that a task gathers, and hands on by bucket: blobs of (classes, sizes, 48-bit keys, numbers into the classes).

    Keys are sorted, so that a blob has their lower 32 bits and how many have each value above. Where entries of a blob
    share few classes, as with many buckets, there are no numbers, and a class and size to each key. So an entry's bytes
    hardly depend on the number of buckets.
    """

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.keys, self.who, self.ids, self.sizes, self.held, self.base = [], [], [], [], 0, 0

    def add(self, who: np.ndarray, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """who: for every key the place in ids of the class that it is of."""
        self.keys.append(keys >> np.uint64(16))
        self.who.append(who + self.base)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.base += len(ids)
        self.held += len(keys)

    def handed(self) -> list[pa.Array]:
        key, w, c, n = (np.concatenate(x) for x in (self.keys, self.who, self.ids, self.sizes))
        self.clear()
        order = np.argsort(key)
        key, w = key[order], w[order]
        cut = np.searchsorted(key, np.array([(b << 48) // self.buckets for b in range(1, self.buckets)], np.uint64))
        blobs = []
        for k, v in zip(np.split(key, cut), np.split(w, cut), strict=True):
            if not len(k):
                blobs.append(None)
                continue
            own, back = np.unique(v, return_inverse=True)
            (ids, each), (wide, size), (number, back) = _narrow(c[own]), _narrow(n[own]), _narrow(back)
            if (len(k) - len(own)) * (ids + wide) <= len(back):
                own, number, back = v, 0, b""
                each, size = _narrow(c[own])[1], _narrow(n[own])[1]
            above = (k >> np.uint64(32)).astype(np.int64)
            many, times = _narrow(np.bincount(above - above[0]))
            head = np.array([len(k), len(own), above[0], above[-1] - above[0] + 1], "<u4").tobytes() + bytes([ids, wide, number, many])
            blobs.append(b"".join([head, each, size, back, times, k.astype("<u4").tobytes()]))
        some = [b for b, x in enumerate(blobs) if x is not None]
        return [pa.array(some, pa.int32()), pa.array([blobs[b] for b in some], pa.binary())]


def _pass_two(rows: DataFrame, width: int, bands: Bands, shared, hard: frozenset, buckets: int) -> DataFrame:
    """Index entries (bucket, entries) of all sets: short names of their classes, and no sizes, which candidates get with their sketches."""
    left_out = np.uint64(LEFT_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, index = Powers(), _Index(buckets)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                tokens, at = _shingled(part, width, powers)
                some = np.flatnonzero(np.diff(at))
                if not len(some):
                    continue
                name = set_ids(tokens, at)[some]
                at = np.append(at[:-1][some], at[-1])
                _, once = np.unique(name, return_index=True)
                if len(once) < len(name):  # equal sets index once
                    once.sort()
                    pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in once])
                    at, tokens, name = np.concatenate([[0], np.cumsum(np.diff(at)[once])]), tokens[pick], name[once]
                index.add(*chosen(tokens, at, bands, shared.value, hard), (name.view(np.uint64) >> left_out).view(np.int64), np.zeros(len(name), np.int64))
                if index.held >= GATHER:
                    yield pa.RecordBatch.from_arrays(index.handed(), names=["bucket", "entries"])
        if index.held:
            yield pa.RecordBatch.from_arrays(index.handed(), names=["bucket", "entries"])
        del index, powers
        give_back()

    return rows.mapInArrow(run, "bucket int, entries binary")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m, low, values = map(int, np.frombuffer(blob, "<u4", 4))
    widths, at, cols = np.frombuffer(blob, np.uint8, 4, 16).tolist(), 20, []
    for count, width in zip((m, m, n if m < n else 0, values), widths, strict=True):
        cols.append(_wide(blob, count, width, at))
        at += count * width
    c, s, back, times = cols[0].view(np.int64), cols[1].astype(np.int32), cols[2].view(np.int64), cols[3].view(np.int64)
    key = np.repeat(np.arange(low, low + values, dtype=np.uint64) << np.uint64(32), times) | np.frombuffer(blob, "<u4", n, at)
    return (key, c[back], s[back]) if m < n else (key, c, s)


def _grouped(got: list) -> tuple[np.ndarray, ...]:
    """(key, class, size, first entry of each group, entries of each group) of one bucket's keys that several classes have."""
    key, c, n = (np.concatenate([x[k] for x in got]) for k in range(3))
    order = np.argsort(key)
    again = key[order]
    alone = np.ones(len(key), bool)  # keys of one entry, which most are, go at once
    alone[1:] &= again[1:] != again[:-1]
    alone[:-1] &= again[1:] != again[:-1]
    order = order[~alone]
    del again, alone
    key, c, n = key[order], c[order], n[order]
    order = np.lexsort((c, key))
    key, c, n = key[order], c[order], n[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (c[1:] != c[:-1])
    key, c, n = key[fresh], c[fresh], n[fresh]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key, c, n, first, np.diff(np.append(first, len(key)))


def _by_bucket(entries: DataFrame, partitions: int, told, schema: str) -> DataFrame:
    """told(*_grouped(...)) of every bucket; a task holds one bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, now = [], None
        for batch in batches:
            for bucket, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    if got:
                        yield from told(*_grouped(got))
                    got, now = [], bucket
                got.append(_unpacked(x.as_buffer()))
        if got:
            yield from told(*_grouped(got))
        del got
        give_back()

    return entries.select("bucket", "entries").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _candidates(entries: DataFrame, bands: Bands, partitions: int) -> DataFrame:
    """Rows (kind, a, b) of the classes that share keys.

    STAR: the first class of a group and another; CROWD: the same, of a group of more than FEW; GROUP: the name of a
    group of 3 to FEW, and a class of it. So rows grow as the entries do, whatever the sizes of groups. Classes are
    named as in the entries; where these have sizes, those of a STAR fit.
    """

    def told(key, c, n, first, run_size) -> Iterator[pa.RecordBatch]:
        size, start = np.repeat(run_size, run_size), np.repeat(first, run_size)
        ok = bands.den * np.minimum(n, n[start]) >= bands.num * np.maximum(n, n[start])
        head = start == np.arange(len(start))
        for kind, who in ((STAR, ok & (size <= FEW)), (CROWD, size > FEW)):
            at = np.flatnonzero(who & ~head)
            if len(at):
                pair = np.unique(np.stack([c[start[at]], c[at]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), kind, np.int32)), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["kind", "a", "b"])
        # Groups with the same classes are one: they are named after their classes.
        some = np.flatnonzero((run_size > 2) & (run_size <= FEW))
        if len(some):
            name = np.add.reduceat(mix(c.view(np.uint64)), first)
            _, once = np.unique(name[some], return_index=True)
            keep = np.zeros(len(first), bool)
            keep[some[once]] = True
            keep = np.repeat(keep, run_size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), GROUP, np.int32)), pa.array(np.repeat(name, run_size)[keep].view(np.int64)), pa.array(c[keep])], names=["kind", "a", "b"])

    return _by_bucket(entries, partitions, told, "kind int, a bigint, b bigint")


def _common(entries: DataFrame, partitions: int) -> DataFrame:
    """Keys that more than FEW classes have."""

    def told(key, c, n, first, run_size) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(key[first[run_size > FEW]].astype(np.int64))], names=["key"])

    return _by_bucket(entries, partitions, told, "key bigint")


def _bitmap(v: DataFrame) -> np.ndarray:
    """A map of WANTED bits, set where a column v (1 to WANTED) has the number; as large whatever the input."""
    out = np.zeros(WANTED // 8, np.uint8)
    for r in v.groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect():
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _sets_of(rows: DataFrame, wanted: DataFrame, kind: str, width: int) -> DataFrame:
    """(class, tokens) of wanted (id, class): whole sets, shingled again from the texts of the wanted ids alone."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED)) + 1
    bits = _bitmap(wanted.select(bit(F.col("id")).alias("v")))
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), shared.value
        for batch in batches:
            v = np.asarray(batch.column("bit")) - 1
            batch = batch.filter(pa.array((bits[v >> 3] >> (v & 7).astype(np.uint8)) & 1 > 0))
            for part in pieces(batch, "text", PIECE):
                tokens, at = _shingled(part, width, powers)
                blobs = [tokens[at[i] : at[i + 1]].tobytes() for i in range(len(at) - 1)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(set_ids(tokens, at)), pa.array(blobs, pa.binary())], names=["id", "class", "tokens"])

    found = rows.select("id", "text", bit(F.col("id")).alias("bit")).mapInArrow(run, f"id {kind}, class bigint, tokens binary")
    # Repeated rows of an id give a class once.
    named = bounded(wanted.select(F.col("id").alias("_id"), F.col("class").alias("_class")))
    # A class whose rows all have no id is asked for by a null id.
    return found.join(named, F.col("id").eqNullSafe(F.col("_id")) & (F.col("class") == F.col("_class")), "left_semi").select("class", "tokens").dropDuplicates(["class"])


def sketches(tokens: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set the parities of its tokens in 2 to 4 bits a token: no more bits of two differ than tokens do."""
    out = []
    for i in range(len(at) - 1):
        bits = max(64, 1 << int(2 * (at[i + 1] - at[i]) - 1).bit_length()) if at[i + 1] > at[i] else 64
        odd = np.bincount((tokens[at[i] : at[i + 1]] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def _short(c: str):
    return F.shiftrightunsigned(c, LEFT_OUT)


def _in_full(df: DataFrame, kinds: DataFrame, *cols: str) -> DataFrame:
    """df with the classes that the short names in its columns `cols` stand for; one of several classes gives several rows."""
    for c in cols:
        df = df.join(kinds.select(_short("class").alias(c), F.col("class").alias("_class")), c).drop(c).withColumnRenamed("_class", c)
    return df


def _possible(pairs: DataFrame, kinds: DataFrame, bands: Bands, short: bool = False) -> DataFrame:
    """Pairs whose sketches differ in no more bits than linked sets do in tokens; no linked pair is lost. short: pairs are of short names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (np.asarray(batch.column(k)) for k in range(4))
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            shape = np.array([len(v) for v in x], np.int64) << 32 | np.array([len(v) for v in y], np.int64)
            ok = bands.den * np.minimum(na, nb) >= bands.num * np.maximum(na, nb)
            for s in np.unique(shape[ok]):
                at = np.flatnonzero(ok & (shape == s))
                u, v = (np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1) for side in (x, y))
                while u.shape[1] > v.shape[1]:
                    u = u[:, : u.shape[1] // 2] ^ u[:, u.shape[1] // 2 :]
                while v.shape[1] > u.shape[1]:
                    v = v[:, : v.shape[1] // 2] ^ v[:, v.shape[1] // 2 :]
                ok[at] = np.bitwise_count(u ^ v).sum(1, dtype=np.int64) <= bands.most_differences(na[at], nb[at])
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    name = _short("class") if short else F.col("class")
    side = lambda k: kinds.select(name.alias(k), F.col("class").alias(f"c{k}"), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    if short:  # a name twice stands for the pairs of its classes
        both = both.where("a <> b or ca < cb")
    return both.select("ca", "cb", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda k: sets.select(F.col("class").alias(k), F.col("tokens").alias(f"t{k}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")


def _linked(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                ok[i] = bands.linked(int((both[1:] == both[:-1]).sum()), len(x), len(y))
            yield batch.select([0, 1]).filter(pa.array(ok))

    return _with_sets(pairs, sets).mapInArrow(run, "a bigint, b bigint")


def _deeper(crowds: DataFrame, sets: DataFrame, buckets: int, common=None) -> DataFrame:
    """For members b of the crowd of a: entries of the key (a, shingle of b outside the crowd's core), as rows (bucket, entries); with `common` also rows (a, b, na, nb, both).

    The core is the set of a, and with `common`, a broadcast bitmap of keys, all whose keys are in it: what the bitmap
    can't tell apart makes a core larger, and any core is right. both: shingles of b in the core, once that is known.
    """
    names = ["bucket", "entries", "a", "b", "na", "nb", "both"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, bits = _Index(buckets), common.value if common else None

        def entries() -> pa.RecordBatch:
            cols = index.handed()
            return pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(cols[0]), pa.int64())] * 5], names=names)

        for batch in batches:
            a, b = (np.asarray(batch.column(k)) for k in range(2))
            facts = np.zeros((3, len(a)), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                key = mix(y[~np.isin(y, x, assume_unique=True)] + mix(a[i : i + 1].view(np.uint64)))
                if bits is not None:
                    v = ((key >> np.uint64(16)) & np.uint64(WANTED - 1)).astype(np.int64)
                    key = key[(bits[v >> 3] >> (v & 7).astype(np.uint8)) & 1 == 0]
                facts[:, i] = len(x), len(y), len(y) - len(key)
                index.add(np.zeros(len(key), np.int64), key, b[i : i + 1], np.array([len(y)]))
                if index.held >= GATHER:
                    yield entries()
            if bits is not None:
                none = [pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, batch.column(0), batch.column(1), *map(pa.array, facts)], names=names)
        if index.held:
            yield entries()
        del index
        give_back()

    return _with_sets(crowds, sets).mapInArrow(run, "bucket int, entries binary, a bigint, b bigint, na bigint, nb bigint, both bigint")


def _rooted(df: DataFrame, roots: DataFrame, *cols: str) -> DataFrame:
    """df with the root of each of its columns `cols`, as r and the column's name."""
    for c in cols:
        df = df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    return df


def _across(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of classes (a, b) of different components in groups (a: name, b: class) of FEW classes at most."""
    member = F.struct(F.col("rb").alias("r"), F.col("b").alias("c"))
    per = _rooted(groups, roots, "b").groupBy("a").agg(F.collect_set(member).alias("m"), F.min("rb").alias("low"), F.max("rb").alias("high")).where("low <> high")
    pairs = per.select(F.explode("m").alias("x"), "m").select("x", F.explode(F.expr("filter(m, y -> y.r > x.r)")).alias("y"))
    return pairs.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b"))


def _in_core(facts: DataFrame, roots: DataFrame, bands: Bands) -> DataFrame:
    """Pairs of a crowd whose shingles in its core may be enough to link them; one of each is apart from its first class."""
    num, den = bands.num, bands.den
    reach = F.floor(F.col("both") * (num + den) / num).cast("long") - F.col("nb")
    # Two members that are in several crowds are paired in the first of them.
    crowds = facts.groupBy("b").agg(F.collect_set("a").alias("crowds"))
    member = _rooted(facts, roots, "a", "b").join(crowds, "b").withColumn("reach", reach).withColumn("least", F.ceil(F.col("nb") * num / den).cast("long"))
    apart = member.where("ra <> rb").withColumn("most", F.least("reach", F.floor(F.col("nb") * den / num).cast("long"))).where("most >= least")
    # Sizes that may fit are told by steps of a tenth, so a set has a few of them.
    step = lambda n: F.floor(F.log(F.col(n)) / math.log(1.1)).cast("int")
    asks = apart.select("a", F.col("b").alias("x"), F.col("rb").alias("rx"), F.col("nb").alias("nx"), F.col("crowds").alias("cx"), "least", "most", F.explode(F.sequence(step("least"), step("most"))).alias("step"))
    met = asks.join(member.select("a", "b", "rb", "nb", "reach", "crowds", step("nb").alias("step")), ["a", "step"]).where("nb between least and most and nx <= reach and rx <> rb and array_min(array_intersect(cx, crowds)) = a")
    return met.select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b"))


def _bridges(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) that may join the components of a crowd: members of its largest one, and one member of each other."""
    member = _rooted(crowds.unionByName(crowds.select("a", F.col("a").alias("b")).distinct()), roots, "b")
    drawn = [F.max_by("b", F.xxhash64("b", F.lit(k))).alias(f"m{k}") for k in range(BRIDGES)]
    parts = member.groupBy("a", "rb").agg(F.count(F.lit(1)).alias("k"), *drawn)
    most = parts.groupBy("a").agg(F.max_by(F.struct("rb", *(f"m{k}" for k in range(BRIDGES))), F.struct("k", "rb")).alias("most"))
    pairs = parts.join(most, "a").where("rb <> most.rb").select(F.col("m0").alias("x"), F.explode(F.array(*(f"most.m{k}" for k in range(BRIDGES)))).alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_shingles, component_id (the smallest id reachable over links, itself included), text_hash.

    A-Z is lower-cased, words are what stands between blanks; a text with fewer than `width` words is one shingle,
    one without words, or null, has none and is linked with nothing. Texts link when their sets' Jaccard similarity is
    num / den or more; all links are found. Rows keep their multiplicity: repeated rows are in one component. A row
    with a null id belongs to the component of its text; other columns are not read. An empty table gives an empty
    result, and a text's length bounds nothing but the memory of the task that reads it.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bands = Bands(num // math.gcd(num, den), den // math.gcd(num, den))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    first = settle(_pass_one(rows.withColumn("text_hash", F.xxhash64("text")), kind, width, bands), "sets")
    slim = first.where("part is null").select("id", "text_hash", "class", "n")
    hard = frozenset(r["b"] for r in first.select(F.explode("hard").alias("b")).distinct().collect())
    shared = spark.sparkContext.broadcast(_summed(first.where("part is not null").select("part", "counts")))
    kinds = settle(first.where("class is not null").groupBy("class").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    let_go(spark)
    found = settle(_candidates(_pass_two(rows, width, bands, shared, hard, FINER * partitions), bands, partitions), "candidates")
    let_go(spark)
    # As many tasks as these rows fill, whatever the number of shuffle partitions.
    tasks = min(partitions, found.count() // 50_000 + 1)
    of = lambda df, *which: df.where(F.col("kind").isin(*which)).select("a", "b").distinct()
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("class"))

    def fetched(classes: DataFrame) -> DataFrame:
        asked = settle(kinds.join(classes.distinct(), "class", "left_semi").select("id", "class"), "wanted", tasks)
        return settle(_sets_of(rows, asked, kind, width), "tokens", min(partitions, asked.count() // 1_000 + 1))

    # The first class of each group against the others, and classes with one short name against each other.
    twice = kinds.groupBy(_short("class").alias("a")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a", F.col("a").alias("b"))
    near = settle(_possible(of(found, STAR, CROWD).unionByName(twice), kinds, bands, short=True), "near", tasks)
    crowds = settle(_in_full(of(found, CROWD), kinds, "a", "b").select("a", "b"), "crowds", tasks)
    sets = fetched(ends(near).unionByName(ends(crowds)))
    let_go(spark)
    links = settle(_linked(near, sets, bands), "linked", tasks)
    let_go(spark)
    roots = components(links)
    # What is still apart in small groups, and what crowds' deeper keys and short sets give.
    groups, some = _in_full(of(found, GROUP), kinds, "b").select("a", "b"), None
    apart = _rooted(crowds, roots, "a", "b").where("ra <> rb").select("a").distinct()
    crowds = settle(crowds.join(apart, "a", "left_semi"), "apart", tasks)
    if crowds.limit(1).count():
        links = settle(links.unionByName(_linked(_possible(_bridges(crowds, roots), kinds, bands), sets, bands)), "linked", tasks)
        let_go(spark)
        roots = components(links)
        # As many buckets as the members' shingles fill, by the mean size of the sets that are members; they only set how many.
        mean = kinds.join(crowds.select(F.col("b").alias("class")).distinct(), "class", "left_semi").agg(F.avg("n")).first()[0] or 0
        fill = min(partitions, int(crowds.count() * mean) // (GATHER // 4) + 1)
        told = _common(_deeper(crowds, sets, FINER * fill), fill)
        common = spark.sparkContext.broadcast(_bitmap(told.select((F.col("key").bitwiseAND(F.lit(WANTED - 1)) + 1).alias("v"))))
        let_go(spark)
        deeper = settle(_deeper(crowds, sets, FINER * fill, common), "deeper", tasks)
        let_go(spark)
        deep = settle(_candidates(deeper.where("bucket is not null"), bands, fill), "deeper-candidates", tasks)
        groups = groups.unionByName(of(deep, GROUP))
        some = _rooted(of(deep, STAR, CROWD), roots, "a", "b").where("ra <> rb").select("a", "b")
        some = some.unionByName(_in_core(deeper.where("a is not null").select("a", "b", "na", "nb", "both"), roots, bands))
    todo = _across(groups, roots) if some is None else _across(groups, roots).unionByName(some)
    near = settle(_possible(todo.distinct(), kinds, bands), "near", tasks)
    let_go(spark)
    if near.limit(1).count():
        more = fetched(ends(near).join(sets.select("class"), "class", "left_anti"))
        links = settle(links.unionByName(_linked(near, sets.unionByName(more), bands)), "linked", tasks)
        roots = components(links)

    named = _rooted(kinds.select("class", "id"), roots, "class")
    least = named.groupBy("rclass").agg(F.min("id").alias("component_id"))
    named = named.join(least, "rclass").select("class", "component_id")
    out = slim.join(named, "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), "text_hash")


def one_of_each(docs: DataFrame, width: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with the smallest id of their component; of repeated rows (id and text) one.

    Rows linked with nothing all stay, also those without words.
    """
    found = settle(near_duplicates(docs, width, num, den, id_col, text_col).select(F.col(id_col).alias("id"), "component_id", "text_hash"), "decided")
    kept = without(docs, found.where(~F.col("id").eqNullSafe(F.col("component_id"))), id_col, text_col)
    again = settle(found.groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", "text_hash"), "repeated")
    if not again.limit(1).count():
        return kept
    return without(kept, again, id_col, text_col).unionByName(only(kept, again, id_col, text_col).dropDuplicates([id_col, text_col]))
