"""Each operator against brute force, and with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import ann, decontam, jaccard, langid, mixing, quality, secret_scan, sharding, token_counts, warc
from tickloom.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = ["an", "the", "re", "ou", "ti", "on", "sh", "ble", "wh", "er"]


def prose(rnd, n):
    return " ".join("".join(rnd.choices(SYLLABLES, k=rnd.randint(1, 3))) for _ in range(n))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)
    # Columns whose names the operators use themselves.
    return df.withColumns({c: F.lit("x") for c in ("id", "size", "score", "class", "taken", "h", "key", "shard", "copies", "w", "n", "text_hash", "start")}) if extra else df


def corpus(rnd, n=60):
    rows = [(k, prose(rnd, rnd.choice([1, 3, 5, 12, 60, 200])), rnd.choice(["a", "b", None])) for k in range(n)]
    rows += [(n, None, "a"), (n + 1, "", None), (n + 2, " \n\t", "b"), (n + 3, prose(rnd, 20000), "b"), (n + 4, rows[5][1], "a"), rows[5], rows[5], (None, rows[7][1], "b")]
    for k in range(8):  # near copies
        words = rows[9][1].split() or ["x"]
        words[rnd.randrange(len(words))] = "changed"
        rows.append((n + 10 + k, " ".join(words).upper() if k == 3 else " ".join(words), "a"))
    return rows


# -- 1

def test_nearest_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8))
    x[50:90] = x[3]  # copies
    x[100:110] *= 3  # not of one length
    rows = [(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("node", F.lit(1))
    got = ann.search(df, df.where("vec_id % 20 = 0"), 20).collect()
    v, hits, total = np.float32(x).astype(float), 0, 0
    for q in range(0, 700, 20):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(700), -s))[:20]
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(abs(s[i] - sc) < 1e-9 for _, i, sc in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits, total = hits + len({i for _, i, _ in mine} & set(want.tolist())), total + 20
    assert hits / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 700, 20))
    assert ann.search(df.where("false"), df.where("false"), 20).count() == 0
    few = df.where("vec_id < 3")
    assert sorted((r["query_id"], r["rank"]) for r in ann.search(few, few, 20).collect()) == [(q, k) for q in range(3) for k in (1, 2)]


def recall(spark, x, queries, **options):
    """Of the 20 nearest rows of x by brute force for each of queries (rows of x, or vectors from outside), the share found."""
    kind = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], kind)
    asked = df.where(F.col("vec_id").isin(list(queries))) if isinstance(queries, range) else spark.createDataFrame([(10**6 + k, v) for k, v in enumerate(queries.tolist())], kind)
    found = {}
    for r in ann.search(df, asked, 20, **options).collect():
        found.setdefault(r["query_id"], set()).add(r["id"])
    v, hits, total = x.astype(float), 0, 0
    for key, q in zip(queries, v[list(queries)], strict=True) if isinstance(queries, range) else enumerate(queries.astype(float), 10**6):
        s = v @ q
        if key < len(v):
            s[key] = -np.inf
        hits, total = hits + len(found.get(key, set()) & set(np.argsort(-s)[:20].tolist())), total + 20
    return hits / total


def test_nearest_neighbours_in_islands(spark, monkeypatch):
    monkeypatch.setattr(ann, "ENTRIES", 8)  # fewer than there are groups, as in a large table
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 16))
    x = np.float32(np.repeat(centres, 30, 0) + 0.05 * rng.normal(size=(1800, 16)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, range(0, 1800, 30), beam=60, opened=8) >= 0.9
    assert recall(spark, x, np.float32(centres + 0.05 * rng.normal(size=(60, 16))), beam=60, opened=8) >= 0.9


def test_nearest_neighbours_of_uneven_lengths(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 16))
    x *= 10 ** rng.uniform(-0.3, 0.3, (600, 1)) * 1e-8 / np.linalg.norm(x, axis=1, keepdims=True)
    x[0] *= 1e8  # beside a long one, all others are short
    assert recall(spark, np.float32(x), range(0, 600, 6), beam=60, opened=8) >= 0.9


def test_nearest_neighbours_lists_settle(spark):
    rng = np.random.default_rng(6)
    x = np.float32(rng.normal(size=(3000, 24)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points = spark.createDataFrame([(k, v.tobytes()) for k, v in enumerate(x)], "node bigint, x binary")
    got = {}
    for r in ann.build_graph(points, 24).collect():
        got.setdefault(r["node"], set()).add(r["near"])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = np.argsort(-s, axis=1)[:, : ann.DEGREE]
    assert sum(len(got[k] & set(b.tolist())) for k, b in enumerate(best)) >= 0.97 * best.size


def test_nearest_neighbours_over_blocks_in_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(ann, "FEWEST", 500, raising=False)  # four blocks
    rng = np.random.default_rng(7)
    x = np.float32(rng.normal(size=(3000, 24)))
    spark.sparkContext.setJobGroup("nearest", "op1")
    try:
        assert recall(spark, x, range(0, 3000, 30)) >= 0.9
        # Rounds are within tasks: jobs don't grow with them.
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) <= 60
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


# -- 2

def brute_windows(docs, items, width=5, threshold=0.75):
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
    from collections import Counter

    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            iw = split(item)
            if not iw:
                continue
            k = min(width, len(iw))
            grams = lambda z: Counter(tuple(z[a : a + k]) for a in range(len(z) - k + 1))
            own, best = grams(iw), 0
            for a in range(len(w) - len(iw) + 1):
                c = grams(w[a : a + len(iw)])
                low = sum((c & own).values())
                best = max(best, low / (sum(c.values()) + sum(own.values()) - low))
            if best >= threshold:
                out[d, i] = best
    return out


def test_decontamination(spark):
    rnd = random.Random(2)
    items = [(k, prose(rnd, n)) for k, n in enumerate([3, 1, 14, 14, 30, 41, 59, 80])] + [(8, None), (9, ""), (10, "again again again again again again again again")]
    docs = []
    for k in range(60):
        item = rnd.choice(items[:8])[1].split()
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            if not item:
                break
            at = rnd.randrange(len(item))
            item[at : at + 1] = rnd.choice([[], ["new"], ["one", "two"]])
        docs.append((k, f"{prose(rnd, rnd.choice([0, 5, 40]))} {' '.join(item).upper()}\n{prose(rnd, rnd.choice([0, 3, 50]))}"))
    docs += [(100, None), (101, ""), (102, items[4][1]), (103, prose(rnd, 20000) + " " + items[5][1]), (104, "again " * 300), (None, items[6][1]), (102, items[4][1])]
    df = frame(spark, [(i, t, None) for i, t in docs], True)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(df, bench).collect()}
    want = brute_windows(docs, items)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {d for d, _ in want})
    assert decontam.matches(df.where("false"), bench).count() == 0 and decontam.matches(df, bench.where("false")).count() == 0
    assert decontam.clean(df, bench.where("false")).count() == len(docs)


def test_decontamination_of_texts_shorter_than_the_item(spark):
    rnd = random.Random(3)
    item = prose(rnd, 59).split()
    while len(set(zip(*[item[k:] for k in range(5)], strict=False))) < 55:
        item = prose(rnd, 59).split()
    docs = {0: item[:-1], 1: item[3:], 2: item[:46], 3: item[:45], 4: item[:4], 5: [*item[:57], "new"]}
    df = frame(spark, [(k, " ".join(w), None) for k, w in docs.items()], True)
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["similarity"], r["start"], r["n_words"]) for r in decontam.matches(df, bench).collect()}
    want = {0: 54 / 55, 1: 52 / 55, 2: 42 / 55, 5: 53 / 56}
    assert got == {k: (pytest.approx(v), 0, len(docs[k])) for k, v in want.items()}
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {3, 4}


def test_decontamination_of_repeated_tails(spark):
    rnd = random.Random(4)
    items = [(k, " ".join("".join(rnd.choices("abcdefghijklmnopqrst", k=5)) for _ in range(150))) for k in range(60)]
    # 146 shingles, of which the last 20 give way to 4 new ones and one that comes 16 times.
    docs = [(k, " ".join([*t.split()[:130], *["."] * 20])) for k, t in items]
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.matches(frame(spark, [(*d, None) for d in docs]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(k, k): pytest.approx(126 / 166) for k, _ in items}


def test_multi_index_reaches_the_radius():
    near = set(decontam.neighbourhood())
    rnd = random.Random(1)
    for _ in range(300):
        bits = sum(1 << b for b in rnd.sample(range(64), decontam.RADIUS))
        assert any((bits >> (8 * k)) & 255 in near for k in range(decontam.BLOCKS))


# -- 3

def test_secrets(spark):
    texts = ["api_key = 'abcdef123' token:x", "AKIA" + "A1" * 10, "AKIAB", "ab" * 12 + " " + "c" * 23, None, "", "secret=token:abcdefgh", "éé password=\"longenough\" PASSWD : q1w2e3r4", "-----BEGIN RSA PRIVATE KEY-----", "x" * 200000 + "token=abcdef", "ſecret=abcdefg"]
    df = frame(spark, [*((k, t, None) for k, t in enumerate(texts)), (0, texts[0], None), (None, texts[1], None)], True)
    got = secret_scan.scan(df)
    for r in got.collect():
        text = None if r["doc_id"] is None else texts[r["doc_id"]]
        if text is not None:
            want = sorted((m.start(), k, m.end()) for k, rule in enumerate(secret_scan.BASE_RULES + secret_scan.MORE_RULES) for m in rule.compiled().finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)
            assert [(f["start"], f["end"]) for f in r["findings"]] == [(s, e) for s, _, e in want]
    d = {r["doc_id"]: r for r in secret_scan.digest(got).where("doc_id is not null").collect()}
    assert (d[0]["n_assign"], d[1]["n_access"], d[2]["n_access"], d[3]["n_hex"], d[4]["n_assign"], d[6]["n_assign"], d[7]["n_assign"], d[9]["n_assign"], d[10]["n_assign"]) == (1, 1, 0, 1, 0, 0, 2, 1, 0)
    assert d[4]["base_sha256"] == hashlib.sha256(b"").hexdigest() and d[8]["spans"] == "private_key:0:31"
    assert got.count() == len(texts) + 2 and secret_scan.scan(df.where("false")).count() == 0


def test_trigram_queries_hold_of_every_match():
    def holds(q, text):
        return True if q is True else q in text if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, text) for x in q[1])

    rnd = random.Random(0)
    for pattern in ["(abc|abd)+x?yz", "foo[0-9]{2}bar", "(?:key|token)[=:]", "a.c", "(abcd){2,}", "x|yyy", "ab?cdef", "(?:a|b)(?:cd|ef)gh"]:
        q, compiled = secret_scan.trigram_query(pattern), re.compile(pattern)
        for _ in range(3000):
            t = "".join(rnd.choice("abcdefghxyzfoobar0123key=token:") for _ in range(12))
            if compiled.search(t):
                assert holds(q, t.lower()), (pattern, t, q)
    assert secret_scan.trigram_query("[0-9a-f]{24,}") is True


# -- 4

def test_mixing(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, rnd.randint(1, 40)), rnd.choice(["a", "b", "c", "d", None, "hot", "hot", "hot"])) for k in range(3000)] + [(5000, None, "a"), (5001, "", "empty"), (7, "one two three", "a"), (7, "one two three", "a"), (None, "four five", "b")]
    df = frame(spark, rows, True)
    first, second = mixing.mix(df), mixing.mix(df.repartition(7))
    assert sorted(map(str, first.collect())) == sorted(map(str, second.collect())) and first.count() == len(rows)
    got = first.collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, left, goal = {}, dict(weights), 1.5 * sum(sizes.values())
    while True:
        level = (goal - sum(target.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * w for s, w in left.items()}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            del left[s]
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(target[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 0.5 * max(r["size"] for r in mine) + 1e-6
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.where("false")).count() == 0 and mixing.mixed_rows(df.where("false")).count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["_id", "_of", "_hash", "_copies", "_size", "_h", "_row", "_nth", "size", "size_of_docs", "shard", "key", "p", "base", "bit", "item", "class", "id"]
    rnd = random.Random(12)
    rows = [(k, prose(rnd, 12), rnd.choice("ab"), *(f"{n}-{k}" for n in names)) for k in range(40)] + [(None, None, None, *[None] * len(names)), (3, "x y", "a", *(f"{n}-again" for n in names))]
    df = spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {', '.join(f'`{n}` string' for n in names)}")
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and set(map(tuple, mixed.collect())) <= set(rows)
    kept = sharding.shard(df, 4, keep=True)
    renamed = {"size": "size_of_docs_of_docs", "shard": "shard_of_docs"}
    assert sorted((tuple(r[renamed.get(c, c)] for c in df.columns) for r in kept.collect()), key=str) == sorted(rows, key=str)
    assert jaccard.one_of_each(df).columns == df.columns and jaccard.one_of_each(df).count() == len(rows)


# -- 5

def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    tk.no_truncation(), tk.no_padding()
    rnd = random.Random(5)
    texts = ["it's we're 'll ''s", "a \t b\n\n  c", "<|endoftext|>hi!<|endoftext|>", "日本 テ　x", "  ", "|\n\ndrs>''"] + ["".join(rnd.choice(" \n\t'srevlmdt1a9é日!<|>½　") for _ in range(rnd.randrange(1, 25))) for _ in range(300)] + [prose(rnd, 3000)]
    want = {k: len(e) for k, e in enumerate(tk.encode_batch(texts, add_special_tokens=False))}
    df = frame(spark, [*((k, t, None) for k, t in enumerate(texts)), (1000, None, None), (1001, "", None), (0, texts[0], None)], True)
    got = token_counts.count_tokens(df, path, 1024, budgets=(3, 9))
    rows = got.collect()
    assert len(rows) == len(texts) + 3 and {r["doc_id"]: r["n_tokens"] for r in rows} == want | {1000: 0, 1001: 0}
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) and r["n_bytes"] == len((texts[r["doc_id"]] if r["doc_id"] < 1000 else "").encode()) for r in rows)
    counter = token_counts.PrefixCounter(path)
    cut = {r["doc_id"]: (r["prefix_3"], r["prefix_9"]) for r in rows}
    for k, t in enumerate(texts[:200]):
        every = [len(tk.encode(t[:p], add_special_tokens=False)) for p in range(len(t) + 1)]
        assert counter.prefixes(t).tolist() == every, t
        assert cut[k] == tuple(max(p for p, n in enumerate(every) if n <= b) for b in (3, 9))
    assert token_counts.count_tokens(df.where("false"), path).count() == 0


# -- 6

def test_language(spark):
    rnd = random.Random(6)
    words = {"en": ["the", "and", "with", "thing"], "de": ["der", "und", "über", "schön"], "fr": ["été", "que", "avec", "nous"]}
    rows = [(k, " ".join(rnd.choices(words[lang], k=rnd.randint(4, 300))), lang) for k in range(300) for lang in [rnd.choice(list(words))]]
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows] + [(1000, None, "en", "s"), (1001, "", "en", "s"), (1002, "123 !!", "de", "s"), (1003, "日本語", None, "s"), (5, rows[5][1], "en", "s")], "doc_id bigint, text string, lang string, source string").withColumn("score", F.lit(1)).withColumn("label", F.lit(1))
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    net = langid.fit(df, usable, per_label=60)
    got = {r["doc_id"]: r for r in langid.identify(df, net).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003]["lang_pred"] in words and all(0 <= r["score"] <= 1 for r in got.values())
    again = {r["doc_id"]: r["score"] for r in langid.identify(df.repartition(5), langid.fit(df.repartition(3), usable, per_label=60)).collect()}
    assert again == {k: r["score"] for k, r in got.items()}
    assert langid.fit(df, F.lit(False)) is None and langid.identify(df, None).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.where("false"), net).count() == 0


# -- 7

def test_sharding(spark):
    rnd = random.Random(7)
    rows = corpus(rnd, 300)
    df = frame(spark, rows, True)
    got = sharding.shard(df, 6)
    assert sorted(map(str, got.collect())) == sorted(map(str, sharding.shard(df.repartition(5), 6).collect()))
    kept = sharding.shard(df, 6, keep=True).collect()
    assert len(kept) == len(rows)
    groups, slots, total = {}, {}, {}
    for r in kept:
        groups.setdefault(r["text"], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        import zlib

        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    assert all(len(s) == 1 for s in groups.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    # The order of groups is that of their hashes, those above a fair share first; the best capacity by trying cuts.
    sizes = {}
    for r in spark.createDataFrame([(t,) for _, t, _ in rows], "text string").select(F.xxhash64("text").alias("h"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("s")).collect():
        sizes[r["h"]] = sizes.get(r["h"], 0) + r["s"]
    left, shards, most = sum(sizes.values()), 6, 0
    for h in sorted(sizes, key=lambda h: -sizes[h]):
        if shards > 1 and sizes[h] * shards > left:
            most, left, shards = max(most, sizes.pop(h)), left - sizes[h] if h in sizes else left, shards - 1
        else:
            break
    # (left is recomputed from what remains)
    left, order = sum(sizes.values()), [sizes[h] for h in sorted(sizes)]

    def fits(c):
        used, room = 1, c
        for s in order:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    low, high = max(order), left
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    assert max(total.values()) == max(most, low)
    assert sharding.shard(df.where("false"), 6).count() == 0


def test_cut_search_splits_ranges(spark):
    rng = np.random.default_rng(1)
    hashes = rng.integers(-(2**63), 2**63 - 1, 40000)
    hashes[:30000] = (hashes[:30000] >> 40) + (1 << 60)  # most fall into one range
    df = spark.createDataFrame([(int(h), int(s)) for h, s in zip(np.unique(hashes), rng.integers(1, 100, 40000), strict=False)], "h bigint, size bigint").withColumn("n", F.lit(1))
    rows = sorted((r["h"], r["size"]) for r in df.collect())
    sums = np.concatenate([[0], np.cumsum([s for _, s in rows])])
    cuts, capacity = sharding.cut_points(df, 7, [], int(sums[-1]), max(s for _, s in rows))
    ok = lambda c: sharding._greedy(sums, np.ones(len(rows), bool), c, 7, False)[0]
    assert ok(capacity) and not ok(capacity - 1)
    at = [0, *[next(k for k, (h, _) in enumerate(rows) if h >= c) for c in cuts], len(rows)]
    assert max(np.diff(sums[at])) <= capacity


# -- 8

def brute_components(rows):
    low = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(find(k)))) for k, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("buckets, most, bytes_each", [(1, 60_000, 10), (400, 60_000, 17), (400, 70_000, 20)])
def test_index_entries_take_few_bytes(buckets, most, bytes_each):
    """Whether classes of a blob have many keys or one, and however large they are, entries come back as they went in."""
    rng = np.random.default_rng(3)
    keys, who = rng.integers(0, 1 << 64, 100_000, np.uint64), rng.integers(0, 5000, 100_000)
    ids, sizes = rng.integers(-(1 << 63), 1 << 63, 5000), rng.integers(1, most + 1, 5000)
    sizes[0] = most
    index = jaccard._Index(buckets)
    index.add(who, keys, ids, sizes)
    blobs = [b.as_py() for b in index.handed()[1]]
    got = np.stack([np.concatenate([np.asarray(jaccard._unpacked(b)[k]).astype(np.int64) for b in blobs]) for k in range(3)], 1)
    want = np.stack([(keys >> np.uint64(16)).astype(np.int64), ids[who], sizes[who]], 1)
    assert (got[np.lexsort(got.T)] == want[np.lexsort(want.T)]).all()
    assert sum(map(len, blobs)) <= bytes_each * len(keys)


@pytest.mark.parametrize("buckets", [1, 48, 400])
def test_index_entries_of_texts_take_no_more_bytes_in_more_buckets(spark, buckets):
    rnd = random.Random(9)
    df = frame(spark, [(k, prose(rnd, 200), "a") for k in range(1000)]).coalesce(1).withColumnRenamed("doc_id", "id")
    shared = spark.sparkContext.broadcast(np.zeros(jaccard.SKETCH, np.uint16))
    blobs = [r["entries"] for r in jaccard._pass_two(df, 5, jaccard.Bands(3, 4), shared, frozenset(), buckets).collect()]
    assert sum(map(len, blobs)) <= 10 * sum(len(jaccard._unpacked(b)[0]) for b in blobs)


@pytest.mark.parametrize("left_out", [56, 61])
def test_ngram_join_of_classes_with_one_short_name(spark, monkeypatch, left_out):
    monkeypatch.setattr(jaccard, "LEFT_OUT", left_out)
    monkeypatch.setattr(jaccard, "FEW", 3)
    rnd = random.Random(10)
    rows, passage = corpus(rnd, 40), prose(rnd, 60)
    base = prose(rnd, 100).split()
    for k in range(60):
        w = list(base)
        for _ in range(rnd.randrange(1, 7)):
            w[rnd.randrange(len(w))] = rnd.choice(SYLLABLES)
        rows.append((2000 + k, " ".join(w), "a"))
    rows += [(3000 + k, f"{passage} {prose(rnd, rnd.randint(8, 30))}", "a") for k in range(30)]
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(frame(spark, rows)).collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join(spark, seed):
    rnd = random.Random(seed)
    rows = corpus(rnd, 80)
    passage = prose(rnd, 70)
    for k in range(60):  # a passage in many texts, and a group of near copies with many grades of likeness
        rows.append((1000 + k, f"{prose(rnd, 20)} {passage} {prose(rnd, rnd.randint(0, 20))}", "b"))
    base = prose(rnd, 90).split()
    for k in range(70):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = rnd.choice(SYLLABLES)
        rows.append((2000 + k, " ".join(w), "a"))
    for n in range(1, 13):  # short sets, where segments are few
        for k in range(6):
            w = [f"w{x}" for x in range(n + 4)]
            if k:
                w = w[: len(w) - k % 3] + [f"v{k}"] * (k % 2)
            rows.append((3000 + 10 * n + k, " ".join(w), "a"))
    df = frame(spark, rows, True)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(df).collect())
    assert got == brute_components(rows)
    one = jaccard.one_of_each(df)
    assert one.columns == df.columns
    component = {}
    for r in jaccard.near_duplicates(df).collect():
        component.setdefault(r["doc_id"], set()).add(r["component_id"])
    want = {(i, t) for i, t, _ in rows if i in component[i]}
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == sorted(want, key=str)
    assert jaccard.near_duplicates(df.where("false")).count() == 0 and jaccard.one_of_each(df.where("false")).count() == 0


def test_ngram_join_of_near_copies_without_ids(spark):
    rnd = random.Random(7)
    words = prose(rnd, 104).split()
    while len(set(zip(*[words[k:] for k in range(5)], strict=False))) < 100:
        words = prose(rnd, 104).split()
    # The one without an id is near both others, which are not near each other.
    rows = [(1, " ".join(words[:84]), "a"), (None, " ".join(words[10:94]), "a"), (2, " ".join(words[20:104]), "a"), (3, prose(rnd, 50), "a")]
    df = frame(spark, rows)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(df).collect()) == brute_components(rows)


def test_ngram_join_of_crowds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    rnd = random.Random(8)
    rows = []
    for g in range(3):  # copies about the threshold, of originals that are there or not, and of other copies
        base = prose(rnd, 110).split()
        texts = [list(base)] if g else []
        for _ in range(40):
            w = list(rnd.choice(texts) if texts and rnd.random() < 0.2 else base)
            for _ in range(rnd.randrange(1, 7)):
                w[rnd.randrange(len(w))] = rnd.choice(SYLLABLES)
            texts.append(w[: len(w) - rnd.randrange(12)])
        rows += [(100 * g + k, " ".join(w), "a") for k, w in enumerate(texts)]
    passage = prose(rnd, 60)
    rows += [(1000 + k, f"{passage} {prose(rnd, rnd.randint(8, 30))}", "a") for k in range(30)]
    df = frame(spark, rows)
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.near_duplicates(df).collect())
    assert got == brute_components(rows)


def mirrored(n):
    """Two texts of n letters whose polynomials modulo 2**64 are equal, whatever the base."""
    a = "a"
    while len(a) < n:
        a += a.translate({97: 98, 98: 97})
    return a, a.translate({97: 98, 98: 97})


def test_texts_with_equal_polynomials(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [x for n in (1024, 4096) for x in mirrored(n)]
    df = frame(spark, [(k, x, "a") for k, x in enumerate(texts)])
    assert all(r["doc_id"] == r["component_id"] for r in jaccard.near_duplicates(df).collect())
    path = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(path)
    tk.no_truncation()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df.coalesce(1), path).collect()} == {k: len(tk.encode(x).ids) for k, x in enumerate(texts)}


def test_components_in_rounds(spark, monkeypatch):
    import tickloom.llm.components as module

    monkeypatch.setattr(module, "ONE_TASK", 0)
    test_components(spark)


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(k, k + 1) for k in range(1000, 1200)]
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    df = spark.createDataFrame(links, "a bigint, b bigint").repartition(9)
    assert {r["node"]: r["root"] for r in components(df).collect()} == {x: find(x) for x in parent if find(x) != x}
    assert components(df.where("false")).count() == 0


# -- 9

def test_quality(spark):
    rnd = random.Random(9)
    good = lambda: prose(rnd, rnd.randint(20, 200)).capitalize() + "."
    bad = lambda: rnd.choice([lambda: " ".join([w for w in rnd.sample(SYLLABLES, 5) for _ in range(12)]), lambda: prose(rnd, 40).upper().replace(" ", "!! "), lambda: prose(rnd, 40).replace(" ", "### ")])()
    rows, labels = [], []
    for k in range(900):
        fine = rnd.random() < 0.8
        rows.append((k, good() if fine else bad(), "s"))
        if k % 2:
            labels.append((k, int(fine), 0))
    df = frame(spark, rows + [(2000, None, "s"), (2001, "", "s"), (2002, "a", "s"), rows[4]], True)
    lab = spark.createDataFrame([*labels, (1, 0, 0), (5000, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("x"))
    usable = F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0
    model = quality.fit(df, lab, usable)
    got = {r["doc_id"]: r["score"] for r in quality.score(df, model).collect()}
    held = [(i, q) for i, q, _ in labels if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.3) == bool(q) for i, q in held) >= 0.93 * len(held)
    assert all(0 <= s <= 1 for s in got.values()) and got[2000] == got[2001]
    kept = quality.keep(df, model, 0.3)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in got.items() if s >= 0.3}
    assert quality.fit(df, lab.where("false"), usable) is None and quality.keep(df, None, 0.3).count() == df.count()
    assert quality.score(df.where("false"), model).count() == 0


# -- 10

def test_warc(spark, tmp_path):
    pages = [(k, f"http://x/{k}", f"<p>{k % 7}</p>" * (k % 5)) for k in range(200)] + [(300, None, None), (301, "a\r\nb", ""), (302, "u", "é" * 100000), (5, "http://x/5", ""), (None, "n", "<p>only</p>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("salt", F.lit(1))
    folder = f"file://{tmp_path}/w"
    index, records = warc.archive(df, folder, frame_bytes=2000, bundle_bytes=5000)
    got = sorted(map(tuple, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    top = {}
    for i, _, h in pages:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in pages:
        d, t = (h or "").encode(), top[h or ""]
        alone = t == i or t == -1
        want.append((i, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if alone else "revisit", None if alone else t))
    assert got == sorted(want, key=str)
    entries = index.collect()
    assert len(entries) == len(pages) and len({e["bundle"] for e in entries}) > 1
    for e in entries[::17]:
        head, block = warc.read_record(e["bundle"], e["frame"], e["offset"])
        assert head["WARC-Record-ID"] == f"<urn:page:{'' if e['page_id'] is None else e['page_id']}>"
    (tmp_path / "w" / "lost.warc.zst").write_bytes(b"x")
    assert warc.sweep(spark, folder, index) == 1
    import zstandard

    name = entries[0]["bundle"].removeprefix("file://")
    with open(name, "rb") as f:  # any Zstandard reader reads a bundle from end to end
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read().startswith(b"WARC/1.1")
    assert warc.archive(df.where("false"), f"file://{tmp_path}/e")[1].count() == 0
