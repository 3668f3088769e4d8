"""Ranked search, importance resampling, exact dedup and connected components against brute force and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import embed_dedup, exact_dedup, graph, minhash, ranked_search, resample
from quillspark.llm.common import Scratch, ranked, terms

SCHEMA = "doc_id long, text string, lang string, rank string, kept string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def found_words(text):
    return WORD.findall(lower(text))


def corpus(seed=3, n=90):
    """Invented texts over few words, with copies, ties, nulls, empties, odd signs, a long text, repeated ids and none."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba de fi go hu".split() for b in "ka Le mi NO é".split()] + ["the"] * 20 + ["x1"] * 4
    out = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(n)]
    for i in range(0, n, 3):
        out[i] = out[0]
    out += [None, "", " \t\n", "!?", "one", "ß Ä É 中文-x \U0001f389 don't 12½ a_b İ\x7f\x00z", " ".join(rng.choices(vocabulary, k=20_000)), "a" * 900]
    rows = [(i, t, "en", "r", "k") for i, t in enumerate(out)]
    return [*rows, rows[4], rows[4], (None, out[0], None, None, None), (None, out[7] + " alone", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_terms_are_the_contracts(rows):
    for r in rows:
        assert [w.decode() for w in terms(r[1])] == found_words(r[1])
    every = "".join(map(chr, range(256))) + "Zz"
    assert [w.decode() for w in terms(every)] == found_words(every)


# Exact dedup


def grouped(rows):
    ids, sizes = defaultdict(list), Counter()
    for r in rows:
        sizes[r[1] or ""] += 1
        ids[r[1] or ""] += [r[0]] if r[0] is not None else []
    out = []
    for r in rows:
        keep = max(ids[r[1] or ""], default=None)
        out.append((r[0], keep, sizes[r[1] or ""], r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return sorted(out, key=str)


def plain(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()], key=str)


@pytest.mark.parametrize("few", [exact_dedup.FEW, 1])
def test_exact_dedup(docs, rows, few):
    got = exact_dedup.dedup(docs, few=few)
    assert got.columns == ["doc_id", "text", "lang", "rank", "keep_id", "group_size", "kept", "text_sha256"]
    assert plain(got) == grouped(rows)


def test_texts_that_share_a_digest_are_told_apart(docs, rows):
    """Hits are verified on the texts: a digest of the first character alone sends most texts to few digests."""
    weak = lambda text: F.unhex(F.sha2(F.substring(text, 1, 1), 256))
    assert plain(exact_dedup.dedup(docs, weak)) == grouped(rows)


def test_exact_dedup_keeps_one_of_each_text(docs, rows, none):
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "lang", "rank"]
    got = [(r.text or "", r.doc_id) for r in kept.collect()]
    want = {(r[1] or "", g[1]) for r in rows for g in [next(x for x in grouped([y for y in rows if (y[1] or "") == (r[1] or "")]))]}
    assert len(got) == len(set(got)) and set(got) == want
    assert exact_dedup.dedup(none).isEmpty() and exact_dedup.keep_one(none).isEmpty()


def test_cuckoo_filter_against_a_set():
    """Insertion, deletion, overflow and rebuilding, with no false miss and few false hits."""
    rng = random.Random(5)
    shard, live = exact_dedup.Shard(1), Counter()
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    for _ in range(6000):
        d = digest(rng.randrange(2500))
        if rng.random() < 0.6:
            assert shard.insert(d, 2) == (live[d] > 0)
            live[d] += 2
        else:
            assert shard.delete(d, 1) == (live[d] > 0)
            live[d] -= live[d] > 0
    live = +live
    assert shard.live == dict(live) and all(d in shard.filter for d in live)
    assert shard.filter.mask + 1 >= len(live) / exact_dedup.SLOTS
    false = sum(digest(i) in shard.filter for i in range(10_000, 30_000))
    assert false < 20
    again = exact_dedup.Shard(*shard.row())
    assert again.live == shard.live and again.filter.slots == shard.filter.slots
    for d, n in live.items():
        assert shard.delete(d, n)
    assert not any(shard.filter.slots), "all fingerprints go with their texts"


def test_full_filter_is_built_anew():
    f = exact_dedup.CuckooFilter(2)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(9)]
    assert not all([f.add(d) for d in digests])
    shard = exact_dedup.Shard(2)
    for d in digests:
        shard.insert(d, 1)
    assert shard.filter.mask + 1 > 2 and all(d in shard for d in digests)


def test_index_takes_and_gives_up_documents(spark, docs, rows):
    index = exact_dedup.CuckooIndex(spark, shard_keys=8)
    first, second = docs.where("doc_id % 2 = 0 or doc_id is null"), docs.where("doc_id % 2 = 1")
    index.insert(first)
    bits = index.bits
    hits = {bytes(r.digest) for r in index.insert(second).where("hit").collect()}
    assert index.bits > bits, "shards are split from their stored keys"
    odd, even = [r for r in rows if r[0] is not None and r[0] % 2], [r for r in rows if r[0] is None or r[0] % 2 == 0]
    seen, count = {r[1] or "" for r in even}, Counter(r[1] or "" for r in odd)
    assert hits == {hashlib.sha256(t.encode()).digest() for t in count if t in seen or count[t] > 1}
    sha = lambda t: hashlib.sha256((t or "").encode()).digest()
    groups = lambda: {bytes(r.digest): (r.keep_id, r.group_size) for r in index.groups().collect()}
    want = lambda kept: {sha(t): (max((r[0] for r in kept if sha(r[1]) == sha(t) and r[0] is not None), default=None), sum(sha(r[1]) == sha(t) for r in kept)) for t in {r[1] for r in kept}}
    assert groups() == want(rows)
    gone = docs.where("doc_id between 20 and 60 or doc_id = 4")
    index.delete(gone)
    index.delete(gone)  # what isn't live is passed over
    index.delete(spark.createDataFrame([(5, "another text under a live id")], "doc_id long, text string"))
    left = [r for r in rows if r[0] is None or not (20 <= r[0] <= 60 or r[0] == 4)]
    assert groups() == want(left)
    live = {r[1] or "" for r in left}
    assert all(r.live == ((r.text or "") in live) for r in index.look_up(docs).collect())
    index.drop()


# Importance resampling


def test_ring_is_the_crc_of_each_run():
    words = [w.encode() for w in "a bc d a bc é9 x".split()]
    for order in (1, 2, 3, 5):
        want = [zlib.crc32(b" ".join(words[i - k : i + 1])) for i in range(len(words)) for k in range(min(order, i + 1))]
        assert resample.ring(words, order) == want


def sampled(rows, target, least, percent=5):
    """The contract, run by run."""
    def features(text):
        w = found_words(text)
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    docs = [(r[0], *features(r[1])) for r in rows]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    out = []
    for doc_id, w, f in docs:
        weight = sum(map(gain, f))
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted([tuple(r[:5]) for r in out], key=str)


@pytest.mark.parametrize("percent, least", [(5, 20), (60, 1)])
def test_resample(spark, docs, rows, percent, least):
    target = ["the the baka fiLe é", None, "", "GONO hué the x1 zzz 中文", "the the baka"]
    got = resample.resample(docs, spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), percent, least)
    assert got.columns == ["doc_id", "lang", "kept", "n_features", "weight", "score", "rank"]
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()], key=str) == sampled(rows, target, least, percent)


def test_resample_of_nothing(spark, docs, rows, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert resample.resample(none, docs).isEmpty()
    got = resample.resample(docs, nothing)
    assert sorted([(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()], key=str) == sampled(rows, [], 20)
    with pytest.raises(ValueError):
        resample.scanned(docs, n=1 << 17)


def test_ranks_of_a_range_sort(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 500).alias("v"), "id").repartition(7)
    got = ranked(df, [F.col("v").desc(), F.col("id")], Scratch(spark, "ranked"), "r").toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(1, 3001))
    assert got[["v", "id"]].values.tolist() == sorted(got[["v", "id"]].values.tolist(), key=lambda r: (-r[0], r[1]))


# Ranked search


def best(rows, items, k=10):
    docs = [(r[0], Counter(found_words(r[1]))) for r in rows]
    docs = [d for d in docs if d[1]]
    n, total = len(docs), sum(sum(d[1].values()) for d in docs)
    df = Counter(t for d in docs for t in d[1])
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts in docs:
            m = 100 - 75 + (75 * sum(counts.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t in found_words(text) if counts[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, i + 1, s[3], -s[0]) for i, s in enumerate(sorted(scores)[:k])]
    return sorted(out)


ITEMS = [(1, "the BAKA fiLe é the"), (2, None), (3, ""), (4, "nowhere at all"), (5, "x1"), (7, "zzz hué 中文 don't 12½ one"), (9, "the " * 50 + "gono"), (11, "deé " * 3), (1, "the BAKA fiLe é the")]


def test_search(spark, docs, rows):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = ranked_search.search(docs, items, block=3)
    assert [t for _, t in got.dtypes] == ["int", "int", "bigint", "bigint"]
    ours = sorted([tuple(r) for r in got.collect()], key=str)
    assert ours == sorted(best(rows, dict.fromkeys(ITEMS)), key=str)
    assert sorted([tuple(r) for r in ranked_search.search(docs, items, k=1).collect()], key=str) == sorted(best(rows, dict.fromkeys(ITEMS), 1), key=str)


def test_search_of_nothing(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert ranked_search.search(none, items).isEmpty()
    assert ranked_search.search(docs.where("text is null"), items).isEmpty()
    assert ranked_search.search(docs, items.limit(0)).isEmpty()


@pytest.mark.parametrize("n_docs, batch", [(1, 1), (2, 4), (700, 1), (700, 16), (700, 256)])
def test_wavelet_tree(n_docs, batch, monkeypatch):
    """Any tree, in steps of one node or many, against all sums; nodes that can't hold a result stay shut."""
    monkeypatch.setattr(ranked_search, "BATCH", batch)
    rng = random.Random(n_docs + batch)
    rows = [(i * 3, Counter(rng.choices("abcdefgh", [40, 20, 10, 5, 3, 2, 1, 1], k=rng.randint(1, 40)))) for i in range(n_docs)]
    rows = [(i, {t.encode(): c for t, c in counts.items()}) for i, counts in rows]
    total = sum(sum(c.values()) for _, c in rows)
    rng.shuffle(rows)
    docs, ids, words, starts, impacts, bits = ranked_search.shard_row(rows, n_docs, total)
    lists, tree = ranked_search.Vocabulary(words, starts), ranked_search.WaveletTree(docs, ids, impacts, bits)
    opened = []
    bounds = tree._bounds
    tree._bounds = lambda *a: opened.append(len(a[0])) or bounds(*a)
    for asked in (b"a", b"h", b"agh", b"bcde", b"ha"):
        asked = {bytes([t]): w for t, w in zip(asked, (5, 70, 400, 9)) if lists.range(bytes([t]))}
        want = sorted((-sum(w * (ranked_search.SCALE * c[t] // (1000 * c[t] + 8 * ranked_search.norm(sum(c.values()), n_docs, total))) for t, w in asked.items() if t in c), i) for i, c in rows)
        want = [x for x in want if x[0] < 0][:10]
        if asked:
            opened.clear()
            assert tree.top([lists.range(t) for t in asked], list(asked.values()), 10, []) == want
            if n_docs == 700 and batch == 1 and len(asked) == 1:
                assert sum(opened) < 300, "a single list is read from its front"
            assert tree.top([lists.range(t) for t in asked], list(asked.values()), 3, [(-(10**15), 5)]) == [(-(10**15), 5), *want[:2]]


# Components


def by_hand(pairs):
    up = {}
    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in up}


@pytest.mark.parametrize("kind", ["shuffled", "descending", "star of the least", "star of the greatest", "random", "bipartite"])
def test_components_of_any_shape(spark, kind):
    rng = random.Random(len(kind))
    ids = list(range(500))
    if kind == "shuffled":
        rng.shuffle(ids)
    if kind == "descending":
        ids = [0, *range(500, 0, -1)]
    pairs = {
        "shuffled": list(zip(ids, ids[1:])), "descending": list(zip(ids, ids[1:])),
        "star of the least": [(0, i) for i in range(1, 500)], "star of the greatest": [(i, 999) for i in range(500)],
        "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(420)],
        "bipartite": [(rng.randrange(200), 200 + rng.randrange(20)) for _ in range(300)],
    }[kind]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == by_hand(pairs)


def test_components_of_odd_links(spark):
    pairs = [(5, 5), (7, 3), (3, 7), (3, 3), (-4, 3), (None, 3), (8, None)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {5: 5, 7: -4, 3: -4, -4: -4}
    loops = spark.createDataFrame([(2, 2), (2, 2)], "a long, b long")
    assert [tuple(r) for r in graph.components(loops).collect()] == [(2, 2)]


def test_near_duplicates_along_a_chain(spark):
    """300 documents, each alike its neighbours alone: one component, whatever the order of ids."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300 * 6 + 60)]
    ids = list(range(300))
    rng.shuffle(ids)
    rows = [(ids[i], " ".join(words[6 * i : 6 * i + 60])) for i in range(300)]
    got = minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.component_id) == {0} and got.kept.sum() == 1


def test_near_vectors_along_a_chain(spark):
    """4,000 vectors, each near the next few only: one component."""
    rng = np.random.default_rng(12)
    at = np.cumsum(np.full(4000, 0.11))
    planes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    v = np.zeros((4000, 64))
    for k in range(32):  # a slow spiral through all planes: vectors further along the chain point elsewhere
        v[:, 2 * k], v[:, 2 * k + 1] = np.cos(at * (1 + k / 9)), np.sin(at * (1 + k / 9))
    v = (v @ planes).astype(np.float32)
    ids = rng.permutation(4000)
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    want = by_hand(list(zip(ids[a].tolist(), ids[b].tolist())))
    got = embed_dedup.dedup(spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": [x.tolist() for x in v]}), "vec_id long, embedding array<float>")).toPandas()
    found = dict(zip(got.vec_id, got.component_id))
    assert len(set(want.values())) < 40
    assert len(set(found.values())) == len(set(want.values())) + 4000 - len(want)
    assert all(found[i] == c for i, c in want.items())
