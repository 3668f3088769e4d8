"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillspark.llm import bpe, cover, embed_dedup, graph, minhash, mixing, orc_output, quality, rolling, sharding, suffix, url_filter, winnow

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=7, n=60):
    """Invented texts with exact and near copies, shared passages, nulls, empties, odd signs, a long text and repeated ids."""
    rng = random.Random(seed)
    syllables = "ba de fi go hu ka le mi no pu ra se".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    out = [text(rng.randint(3, 160)) for _ in range(n)]
    shared = text(70)
    for i in range(0, n, 5):
        out[i] = f"{text(12)}. {shared} {text(9)}"
    for i in range(1, n, 6):
        ws = out[i - 1].split()
        ws[len(ws) // 2] = word()
        out[i] = " ".join(ws)
    out[3], out[9], out[15] = out[2], out[2], out[2].upper()
    out += [None, "", " \t\n", "one", "two words", "é ß Ä <|endoftext|> don't 12½ 中文 \U0001f389 İ", text(30_000), "a" * 700, "ab" * 400]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, None if t is None else len(t)) for i, t in enumerate(out)]
    return [*rows, rows[0], (None, "no id here at all", None, "s1", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).cache()


@pytest.fixture(scope="module")
def unique(spark):
    """Without repeated and missing ids."""
    return spark.createDataFrame([r for r in corpus()[:-3]], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


# 1

def test_url_rules(spark):
    urls = [
        ("https://a.example.com/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://EXAMPLE.com/en/8", "example.com", "/en/8", "com/en/", "block"),
        ("x://b.net/de/8#t", "b.net", "/de/8", "net/de/", "allow"), ("https://example.net/de/81", "example.net", "/de/81", "example.net/de/8", "block"), ("https://o.org/es/", "o.org", "/es/", "org/es/", "block"),
        ("https://notcom/en/", "notcom", "/en/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://h/" + "p" * 20_000, "h", "/" + "p" * 20_000, None, None),
    ]
    df = spark.createDataFrame([(i, u[0], "kept", "kept too") for i, u in enumerate(urls)], "page_id long, url string, host string, row string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict or verdict in (None, "allow") and got[i]["verdict"] in ("allow", "block")
        assert rule is None or got[i]["verdict"] == next(v for h, p, v in url_filter.RULES if h + p == rule)
    assert got[0]["row"] == "kept too"
    assert url_filter.judge(df.limit(0)).isEmpty()


def test_url_rules_are_the_contracts(spark):
    """Verdicts are held against the contract's own words, not against the operator's table."""
    urls = {
        "http://a.com/en/1": ("com/en/", "block"), "http://www.example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/8": ("net/de/", "allow"),
        "http://x.example.net/de/7": ("net/de/", "allow"), "http://example.net/de/8": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"),
    }
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df).collect()}
    assert got == dict(enumerate(urls.values()))


def test_url_models(spark):
    """Scores against a plain version of the models and their cut."""
    rng = random.Random(1)
    rows = []
    for i in range(300):
        good = i % 2
        word = "".join(rng.choices("aeiou" if good else "xqzkw", k=6))
        host = "example.com" if good else "spam.org"
        path = ("/en/7" if good else "/es/") if i < 200 else "/fr/"
        rows.append((i, f"https://{word}.{host}{path}{i}"))
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(got[i]["rule"] is None and got[i]["verdict"] == ("allow" if i % 2 else "block") for i in range(200, 300))

    k = url_filter.ORDER
    counts = {c: Counter() for c in "ar"}
    for i, u in rows[:200]:
        p = "^" * (k - 1) + u
        for j in range(k - 1, len(p)):
            for n in range(1, k + 1):
                counts["a" if i % 2 else "r"][p[j - n + 1 : j + 1]] += 1
                counts["a" if i % 2 else "r"]["ctx" + str(n) + p[j - n + 1 : j]] += 1

    def chance(c, g):
        x = 1 / url_filter.ALPHABET
        for n in range(1, k + 1):
            s = g[k - n :]
            x = (counts[c][s] + url_filter.STRENGTH * x) / (counts[c]["ctx" + str(n) + s[:-1]] + url_filter.STRENGTH)
        return x

    for i, u in rows[200:220]:
        p = "^" * (k - 1) + u
        gs = [p[j : j + k] for j in range(len(u))]
        assert got[i]["score"] == pytest.approx(sum(np.log(chance("a", g) / chance("r", g)) for g in gs) / len(gs), abs=1e-5)


    # the cut: where most of both kinds are right, each scored without one occurrence of its own grams
    def own(kind, g):
        def less(c):
            x = 1 / url_filter.ALPHABET
            for n in range(1, k + 1):
                s, one = g[k - n :], int(c == kind)
                x = (max(0, counts[c][s] - one) + url_filter.STRENGTH * x) / (max(0, counts[c]["ctx" + str(n) + s[:-1]] - one) + url_filter.STRENGTH)
            return x

        return np.log(less("a") / less("r"))

    at = {"a": [], "r": []}
    for i, u in rows[:200]:
        p = "^" * (k - 1) + u
        kind = "a" if i % 2 else "r"
        at[kind].append(np.floor(np.mean([own(kind, p[j : j + k]) for j in range(len(u))]) * url_filter.BINS))
    cut = got[0]["cut"] * url_filter.BINS
    right = lambda x: np.mean(np.array(at["a"]) >= x) + np.mean(np.array(at["r"]) < x)
    assert right(cut) == max(right(x) for x in {y + d for v in at.values() for y in v for d in (0, 1)}) and right(cut) > 1.9
    df = spark.createDataFrame(rows, "page_id long, url string")
    assert {r["page_id"]: r for r in url_filter.judge(df, broadcast_rows=0).collect()} == got  # the model joined by shuffle


# 2 and 10

ODD = [
    "", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ é ﬁ 中文字符 🎉🎉 don't we'll ''s '''d 12½³ª\xa0x\x85y\x1c", "a\x1cb x\x1fy z\x1d.", "ǅ ß ẞ STRASSE ​ zero क्षि", "A'S O'Reilly's\t\n\r x_y__z ½¼ µº",
]


def test_bpe_like_the_library():
    t, own, other = library(), bpe.ForcedBoundaryBPE(json.loads(bpe.read_spec(bpe.default_path()))), orc_output.LibraryEncoder(bpe.read_spec(bpe.default_path()))
    for s in [*ODD, *(r[1] or "" for r in corpus())]:
        ids = t.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids == other.encode(s)
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)
    assert own.cuts("中x".encode()) and own.encode(None) == []


def test_bpe_refuses_other_settings():
    spec = json.loads(bpe.read_spec(bpe.default_path()))
    for change in ({"normalizer": None}, {"decoder": {"type": "ByteLevel"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError, match=next(iter(change))):
            bpe.ForcedBoundaryBPE(spec | change)
        with pytest.raises(ValueError, match=next(iter(change))):
            orc_output.LibraryEncoder(json.dumps(spec | change).encode())


def test_bpe_forgets(docs):
    small = bpe.ForcedBoundaryBPE(json.loads(bpe.read_spec(bpe.default_path())), remembered=600)
    t = library()
    assert small.encode("many words that are not remembered at all") == t.encode("many words that are not remembered at all", add_special_tokens=False).ids and 2 <= len(small.words) <= 4


def test_bpe_frames(docs, none):
    t, path = library(), bpe.default_path()
    clash = docs.withColumn("ids", F.lit("x")).withColumn("n_tokens", F.lit("y"))
    for r in bpe.decode(bpe.encode(clash, path), path).collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == t.decode(ids, skip_special_tokens=False) and r["n_tokens"] == "y"
    for r in bpe.round_trip(clash.withColumn("copy", F.col("text")), path).collect():
        ids = t.encode(r["copy"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert bpe.round_trip(none, path).isEmpty()


def test_orc(spark, unique, docs, none, tmp_path):
    import pyarrow.orc

    t, out = library(), str(tmp_path / "orc")
    orc_output.write(unique.repartition(5), out, bpe.default_path())
    start, got = 0, {r["doc_id"]: r for r in orc_output.index(spark, out).collect()}
    for i, text, *_ in corpus()[:-3]:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, orc_output.END_ID]
        assert tuple(got[i])[1:] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert orc_output.read(spark, out).where("doc_id = 5").count() == 1
    for k, df in (("all", docs), ("none", none)):
        orc_output.write(df, str(tmp_path / k), bpe.default_path())
        assert orc_output.index(spark, str(tmp_path / k)).count() == df.count()


def test_orc_stripes(spark, tmp_path, monkeypatch):
    """Several stripes in a file, each read by itself; Bloom filters, row indexes and disjoint ranges of ids to prune by."""
    import pyarrow.orc

    monkeypatch.setattr(orc_output, "STRIPE_BYTES", 64 << 10)
    monkeypatch.setattr(orc_output, "ROW_INDEX", 1000)
    n = 20_000
    df = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.concat_ws(" ", F.md5(F.col("id").cast("string")), F.lit("word"), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    orc_output.write(df, str(tmp_path / "orc"), bpe.default_path())
    ranges, rows = [], 0
    for p in (tmp_path / "orc").glob("*.orc"):
        f = pyarrow.orc.ORCFile(p)
        for i in range(f.nstripes):
            ids = f.read_stripe(i, columns=["doc_id"]).column(0).to_numpy()
            rows += len(ids)
            ranges.append((ids.min(), ids.max()))
        assert f.nstripes > 1 and f.row_index_stride == 1000 and f.schema.field("ids").type.value_type == "int32"
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(p)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        column = reader.getSchema().findSubtype("doc_id").getId()
        records = reader.rows()
        for stripe in reader.getStripes():
            streams = {(s.getKind().toString(), s.getColumn()) for s in records.readStripeFooter(stripe).getStreamsList()}
            assert ("ROW_INDEX", column) in streams and ("BLOOM_FILTER_UTF8", column) in streams
        records.close()
    ranges.sort()
    assert rows == n and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert orc_output.read(spark, str(tmp_path / "orc")).where("doc_id = 3000").count() == 1


# 3

def sets(rows):
    out = []
    for r in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        out.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def joined(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return label


def test_minhash(unique):
    rows = corpus()[:-3]
    s = sets(rows)
    linked = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])]
    label = joined(len(s), linked)
    got = {r["doc_id"]: r for r in minhash.dedup(unique).collect()}
    assert len(linked) > 10
    assert all((got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s[i]), label[i], label[i] == i) for i in range(len(s)))
    kept = minhash.keep_one(unique.withColumn("row", F.lit("r")).withColumn("node", F.lit("n")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(s)) if label[i] == i] and kept.columns == [*unique.columns, "row", "node"]


def test_minhash_odd(docs, none):
    got = minhash.dedup(docs)
    assert got.count() == docs.count() and got.where("doc_id is null and not kept").isEmpty() and minhash.dedup(none).isEmpty()
    assert minhash.keep_one(none).isEmpty() and minhash.keep_one(docs).where("doc_id = 0").count() == 1


def test_minhash_blocks(spark, monkeypatch):
    """A large bucket of many components, cut into blocks: links that no first node sees."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        w = list(base)
        for j in rng.sample(range(60), rng.choice((1, 2, 3))):
            w[j] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    s = sets(rows)
    label = joined(len(s), [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])])
    got = {r["doc_id"]: r["component_id"] for r in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label))


def test_minhash_boilerplate(spark, monkeypatch):
    """Documents just below the threshold share every band: nothing that is written grows with their pairs."""
    from quillspark.llm import common

    written, own = {}, common.Scratch.saved

    def count(self, df, name, *more):
        out = own(self, df, name, *more)
        written[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "saved", count)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    words = lambda tag, k: " ".join(f"{tag}{j}" for j in range(k))
    n = 300
    rows = [(i, f"{words('shared', 200)} {words(f'own{i}x', 40)}") for i in range(n)]  # 196 of 276 shingles: .71
    rows += [(n + i, rows[0][1] + f" tail{i}") for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < n else 0 for i in range(n + 20)}
    assert written["candidates"] > n  # there were pairs to confirm, but no table holds them
    assert written["confirmed"] + written["spanning"] < n and max(written.values()) <= minhash.BANDS * (n + 20) * 6
    assert written["candidates"] <= written["labelled"] * 6


def test_minhash_large_components(spark, monkeypatch):
    """A component that fills several blocks, beside small ones in the same buckets."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(60)]
    for i in range(60, 100):
        w = list(base)
        for j in rng.sample(range(80), 3):
            w[j] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    s = sets(rows)
    label = joined(len(s), [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j])])
    got = {r["doc_id"]: r["component_id"] for r in minhash.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 3


def test_minhash_same_id(spark):
    """Rows of one id: with the same words one document, with other words another; ``keep_one`` takes the same row each time."""
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "A  b c d e f", "z"), (1, "other words in this one here", "u"), (2, "a b c d e f", "v"), (3, " ", "w"), (3, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    got = sorted(map(tuple, minhash.dedup(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 4 + [(2, 2, 1, False)] + [(3, 0, 3, True)] * 2, key=str)
    for k in (1, 3, 7):
        kept = sorted(r["more"] for r in minhash.keep_one(df.repartition(k)).collect())
        first = kept if k == 1 else first
        assert kept == first and len(kept) == 4 and kept[:3] == ["u", "w", "w"] and kept[3] in "xyz"


def test_estimate(spark):
    a, b = minhash.permutations()
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 2**63, 800, dtype=np.uint64))
    y = np.concatenate([x[:640], np.unique(rng.integers(0, 2**63, 160, dtype=np.uint64))])
    p, q = (minhash.packed(minhash.minima(v, a, b)) for v in (x, y))
    j = 640 / (len(x) + 160)
    plain = float(minhash.similarity(p.view(np.uint64), q.view(np.uint64)))
    row = spark.createDataFrame([tuple(map(int, [*p, *q]))], ", ".join(f"{k}{i} long" for k in "xy" for i in range(minhash.LONGS)))
    assert row.select(minhash.estimate("x", "y")).first()[0] == pytest.approx(plain) and plain == pytest.approx(j, abs=0.1)


# 4

def test_quality(spark, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(["th", "er", "an", "in", "is", "a", "of"], k=rng.randint(1, 4)))
    rows = []
    for i in range(400):
        ws = [word() for _ in range(rng.randint(40, 120))]
        bad = i % 5 == 0
        if bad:
            kind = i // 5 % 4
            ws = [f"{w}$$$" for w in ws] if kind == 0 else [f"{w.upper()}XY!!" for w in ws] if kind == 1 else [x for w in ws for x in (w + "ernand", "|")] if kind == 2 else ["Same"] * len(ws)
        rows.append((i, ". ".join([" ".join(ws[:20]).capitalize(), " ".join(ws[20:])]), int(not bad)))
    rows += [(400, None, 0), (401, "", 0), (402, " \n", 0), (403, "Ok then.", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, truth int").withColumns({"score": F.lit("old"), "row": F.lit("r"), "t": F.lit("t")})
    got = quality.classify(df).collect()
    assert sum(r["keep"] == bool(r["truth"]) for r in got) >= 0.98 * len(rows) and all(r["keep"] for r in got if r["truth"] == 1) and all(r["t"] == "t" for r in got)
    assert quality.classify(none).isEmpty()


def test_quality_on_labels(spark):
    from conftest import DATA

    d = DATA.replace("sf0.001", "sf0.01")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    right = got.select(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int")), F.avg(F.when(F.col("quality") == 1, F.col("keep").cast("int")))).first()
    assert right[0] >= 0.97 and right[1] >= 0.99  # the labels were not used to fit it


def test_quality_shapes():
    """Signs and digits late in a long token reach the scorer."""
    marks = [quality.hashed(quality.Look("a" * 70 + end), {}, {}) for end in ("", "!", "7", "!7")]
    assert all((marks[i] != marks[j]).any() for i in range(4) for j in range(i))
    assert quality.collapsed(b"aaA\n\n00a") == b"aA\n0a"


def test_quality_estimate():
    """EM against a plain version that follows every document and labeller by itself."""
    rng = random.Random(31)
    n_labellers, docs_ = quality.LABELLERS, []
    for _ in range(300):
        good = rng.random() < 0.7
        docs_.append([2 if rng.random() < 0.3 else int(good == (rng.random() < 0.6 + 0.03 * i)) for i in range(n_labellers)])
    counted = Counter("".join(map(str, d)) for d in docs_)
    frame = pd.DataFrame({"pattern": sorted(counted), "n": [counted[p] for p in sorted(counted)]})
    posterior, tables, prior = quality.estimate(frame)
    p = [0.2 if 0 in d else 0.9 for d in docs_]
    for _ in range(quality.ROUNDS):
        share = [[[0.5, 0.5], [0.5, 0.5]] for _ in range(n_labellers)]  # [labeller][class][vote]
        for d, good in zip(docs_, p):
            for i, vote in enumerate(d):
                if vote != 2:
                    share[i][1][vote] += good
                    share[i][0][vote] += 1 - good
        share = [[[v / sum(c) for v in c] for c in t] for t in share]
        first = (sum(p) + 1) / (len(p) + 2)
        new = []
        for d in docs_:
            odds = first / (1 - first)
            for i, vote in enumerate(d):
                if vote != 2:
                    odds *= share[i][1][vote] / share[i][0][vote]
            new.append(odds / (1 + odds))
        if max(abs(a - b) for a, b in zip(p, new)) < 1e-9:
            break
        p = new
    assert all(posterior["".join(map(str, d))] == pytest.approx(x, abs=1e-6) for d, x in zip(docs_, p))
    assert prior == pytest.approx(first, abs=1e-6) and tables[:, 1, 1] == pytest.approx([t[1][1] for t in share], abs=1e-6)


def test_quality_fit():
    """The logistic regression against plain gradient descent on the same loss."""
    rng = np.random.default_rng(32)
    x = np.zeros((200, quality.DIMS), np.float32)
    x[:, :5] = rng.standard_normal((200, 5))
    y = 1 / (1 + np.exp(-(x[:, 0] - 2 * x[:, 1] + 0.5 + 0.5 * rng.standard_normal(200))))
    w, bias = quality.fit(x, y)
    v, c = np.zeros(5), 0.0
    for _ in range(20_000):
        e = 1 / (1 + np.exp(-(x[:, :5] @ v + c))) - y
        v, c = v - (x[:, :5].T @ e / 200 + 1e-5 * v), c - e.mean()
    assert w[:5] == pytest.approx(v, abs=0.02) and bias == pytest.approx(c, abs=0.02) and not w[5:].any()


def test_quality_sample(spark, monkeypatch):
    """Copies of a text are thinned like other texts, so that a hot text is neither left out nor nearly all of the sample."""
    copies = [(i, "The same few words stand in all of these rows, over and over.") for i in range(2000)]
    others = [(2000 + i, f"Row number {i} says something of its own about {i * 7} things.") for i in range(1000)]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x) or (np.zeros(quality.DIMS), 0.0))
    quality.train(spark.createDataFrame(copies + others, "doc_id long, text string"), sample=300)
    same = max(np.unique(seen[0], axis=0, return_counts=True)[1])
    assert 200 < len(seen[0]) < 400 and 130 < same < 270


# 5

def test_sharding(spark, none, tmp_path):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(500)] + [(7, "y" * 100)] * 60 + [(8, "z" * 5000), (None, None), (None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("old")).repartition(3)
    got = sharding.assign(df, limit=1000).collect()
    assert len(got) == len(rows)
    size, count, depth = Counter(), Counter(), {}
    for r in got:
        size[r["shard"]] += r["n_bytes"]
        count[r["shard"]] += 1
        depth[r["shard"].split(".")[0]] = r["depth"]
    assert all(v <= 1000 or count[k] == 1 for k, v in size.items())
    assert all(len(k) == d for k, d in depth.items())
    bits = sorted(depth)
    assert not any(b.startswith(a) for a, b in zip(bits, bits[1:]))  # no bucket lies within another
    whole = {int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16): 0 for i, _ in rows if i is not None}
    for i, t in rows:
        h = int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
        whole[h] = whole.get(h, 0) + len(t or "")
    for b, d in depth.items():
        if d:  # a bucket only exists because the one above it was too large
            parent = b[:-1]
            assert sum(v for h, v in whole.items() if format(h, "060b").startswith(parent)) > 1000
    key = lambda x: [(str(v)) for v in x]
    held = lambda rows: sorted(((r["shard"], r["doc_id"], r["text"], r["n_bytes"]) for r in rows), key=key)
    sharding.write(sharding.assign(df, limit=1000), str(tmp_path / "out"))
    back = sharding.read(spark, str(tmp_path / "out"))
    assert dict(back.dtypes)["shard"] == "string" and held(back.collect()) == held(got)
    for n in (1, 7):  # the same shards however the rows are dealt, those of a cut bucket too
        assert held(sharding.assign(df.repartition(n), limit=1000).collect()) == held(got)
    assert any("." in k for k in size) and sharding.assign(none).isEmpty()


# 6

def linked_vectors(vectors, least=0.9):
    """Which pairs of usable vectors are linked, in double precision; lists of other lengths never are."""
    near = np.zeros((len(vectors), len(vectors)), bool)
    for size in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == size]
        x = np.array([vectors[i] for i in at], np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near[np.ix_(at, at)] = x @ x.T >= least
    np.fill_diagonal(near, False)
    return near


def check_vectors(got, near, recall):
    found = sum(got[i]["n_links"] for i in range(len(near)))
    assert found >= recall * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in range(len(near)))
    label = joined(len(near), list(zip(*np.nonzero(near))))
    assert found < near.sum() or all(got[i]["component_id"] == label[i] and got[i]["kept"] == (label[i] == i) for i in range(len(near)))


@pytest.mark.parametrize("how", [{"leaf": 32, "block": 16}, {"leaf": 8, "block": 4, "sample": 100}])
def test_embeddings(spark, monkeypatch, how):
    """Spilled leaves in blocks; with a small sample, leaves that are split by their own trees."""
    split, own = [], embed_dedup.split_leaves
    monkeypatch.setattr(embed_dedup, "split_leaves", lambda *a: split.append(1) or own(*a))
    monkeypatch.setattr(embed_dedup, "PART", 50)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 16))
    v = [c + 0.12 * rng.standard_normal(16) for c in centres for _ in range(12)] + [centres[0] * s for s in (1, 2)] + [centres[0]] * 3
    v = [np.asarray(x, np.float32).tolist() for x in v] + [[1.0, 2.0], [2.0, 4.1], [1.0, -2.0], [3.0, 3.0, 3.0]]
    odd = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, x, 0) for i, x in enumerate([*v, *odd])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component_id int")
    got = {r["vec_id"]: r for r in embed_dedup.dedup(df, **how).collect()}
    check_vectors(got, linked_vectors([np.asarray(x, np.float32) for x in v]), 0.995)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(len(v), len(rows)))
    assert bool(split) == ("sample" in how) and embed_dedup.dedup(df.limit(0)).isEmpty()
    two = df.where("vec_id < 24").unionAll(df.where("vec_id = 20").withColumn("vec_id", F.lit(3).cast("long"))).unionAll(df.where("vec_id = 5"))
    ids = [r for r in embed_dedup.dedup(two).collect() if r["vec_id"] == 3]
    assert sorted(r["component_id"] for r in ids) == [0, 3]  # one id, two vectors


def test_embeddings_doubles(spark):
    """Components that floats can't hold, and cosines at the threshold."""
    v = [[1.0, 0.0], [0.9, 0.19**0.5], [0.9 - 1e-9, (1 - (0.9 - 1e-9) ** 2) ** 0.5], [1e300, 1e300, 0.0, 0.0], [2e300, 2e300, 0.0, 0.0], [1e-300, 1e-300, 0.0, 0.0], [-1e300, 1e300, 0.0, 0.0], [3.0, 4.0, 0.0], [3.0, 4.0, 1e-8]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.dedup(df).collect()}
    assert got == {0: (1, 0), 1: (2, 0), 2: (1, 0), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_embeddings_recall(spark):
    """Vectors of 64 components, a tight hot group of a third beside pairs: recall against brute force."""
    rng = np.random.default_rng(64)
    centre = rng.standard_normal(64)
    hot = centre / np.linalg.norm(centre) + 0.33 * (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(rng.standard_normal((1000, 64)))
    pairs = np.repeat(rng.standard_normal((1000, 64)), 2, axis=0) + 0.2 * rng.standard_normal((2000, 64))
    v = np.concatenate([hot, pairs])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    check_vectors({r["vec_id"]: r for r in embed_dedup.dedup(df).collect()}, linked_vectors(list(v)), 0.995)


def test_forest_depth():
    """A hot group of a third loses no links at depth 12, and few at any depth."""
    rng = np.random.default_rng(66)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)

    def unit(x):
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def hot(n):
        return unit(centre + np.sqrt(1 / 0.9 - 1) * unit(rng.standard_normal((n, 64))))

    sample = np.concatenate([hot(6666), unit(rng.standard_normal((13_334, 64)))])
    x = hot(600)
    near = np.triu(x @ x.T >= 0.9, 1)
    for n, depth in ((10_000, 6), (1_000_000, 12)):
        forest = embed_dedup.fit(sample, n, 0.9)
        together = np.zeros_like(near)
        for levels in forest:
            assert len(levels) == depth
            row, leaf = embed_dedup.leaves(x, levels)
            for k in np.unique(leaf):
                together[np.ix_(row[leaf == k], row[leaf == k])] = True
        assert (together & near).sum() >= 0.999 * near.sum()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40), (None, 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == got[30] == 30 and got[40] == 40
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


# 7

def winnowed(hashes, k=winnow.K, w=winnow.WINDOW):
    """Places of the chosen grams: in each window the smallest, the rightmost of equals."""
    if not hashes:
        return []
    out = []
    for s in range(max(1, len(hashes) - w + 1)):
        part = hashes[s : s + w]
        at = s + max(i for i, h in enumerate(part) if h == min(part))
        if at not in out:
            out.append(at)
    return out


def test_winnowing(spark, docs):
    df = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    for r in winnow.fingerprint(winnow.with_packed(df, "text", "p").withColumn("g", winnow.grams(F.col("text"))).withColumn("_packed", F.lit(1)).drop("_packed")).collect():
        h = [x >> winnow.PLACE_BITS for x in r["g"]]
        places = winnowed(h)
        assert [x["place"] for x in r["fingerprint"]] == places and [x["hash"] for x in r["fingerprint"]] == [h[i] for i in places]


def test_winnowing_edits(docs, unique, none):
    rows = sorted(corpus()[:-3], reverse=True, key=lambda r: r[0])
    got = {r["doc_id"]: r for r in winnow.edited(unique).collect()}
    prints = {}
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        g = got[r[0]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest()) and 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        prints.setdefault(text, set()).add(g["fingerprint"])
        assert (new != text) or g["edited_fingerprint"] == g["fingerprint"] and g["near_edited"] == 1
    assert all(len(p) == 1 for p in prints.values())
    assert winnow.edited(docs).count() == docs.count() and winnow.edited(none).isEmpty()


def test_winnowing_characters(spark):
    """Texts without white space and texts with small edits keep fingerprints; grams are those of code points."""
    rng = np.random.default_rng(7)
    run = "".join(chr(0x4E00 + c) for c in rng.integers(0, 5000, 400))
    words = [("".join(chr(97 + c) for c in rng.integers(0, 26, 6))) for _ in range(200)]
    changed = " ".join(w[:2] + "#" + w[3:] if i % 5 == 0 else w for i, w in enumerate(words))
    texts = [run, run[:200] + "".join(reversed(run[200:])), " ".join(words), changed, "\n ".join(words), "ab" + "\U0001f98a" * 9 + "cdefghijkl", "short", " \t\n", ""]
    df = winnow.with_packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "text", "p").withColumn("n", F.size(winnow.grams(F.col("text"))))
    got = {r["doc_id"]: r for r in df.withColumn("h", winnow.hashes(F.col("p"))).collect()}
    for i, j in ((0, 1), (2, 3)):
        assert set(got[i]["h"]) & set(got[j]["h"]) and got[i]["h"] != got[j]["h"]
    assert got[2]["h"] == got[4]["h"] and [got[i]["n"] for i in range(9)] == [389, 389, 1388, 1388, 1388, 10, 1, 0, 0]
    assert all(len(got[i]["p"]) == len(winnowed([0] * got[i]["n"])) for i in (6, 7, 8))


def test_winnowing_seams(spark):
    """Edited texts' grams, put together at the seam, are those of the edited text itself."""
    rng = random.Random(17)
    texts = ["", " ", "a", "ab cd", "abcdefghijk", "abcdefghijkl", "  lead and tail \n", "x" * 40, "words " * 9, "\t\t\n", "中文" * 20, "ab\U0001f98a" * 8, "end ", " begin"]
    texts += ["".join(rng.choices("ab \n", k=rng.randint(0, 70))) for _ in range(60)]
    rng.shuffle(texts)
    pairs = list(zip(texts, texts[1:] + texts[:1])) + [(t, t) for t in texts[:20]]
    df = winnow.with_edit(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, text string, following string"), "text", "following")
    df = df.withColumns({"g": winnow.grams(F.col("text")), "h": winnow.grams(F.col("following")), "whole": winnow.grams(F.col("_edited"))})
    for r in df.collect():
        part = r["g"][: r["_left"]] + [x - r["_left"] for x in r["_seam"]] + [x - r["_left"] - len(r["_seam"]) for x in r["h"][: r["_right"]]]
        assert part == r["whole"], (r["text"], r["following"])
        assert r["_edited"] == r["text"][: len(r["text"]) - len(r["text"]) // 2] + r["following"][: len(r["text"]) // 2]


def test_winnowing_edited_whole(spark, monkeypatch):
    """The edited text's fingerprint, put together at the seam, is what the whole edited text has by itself."""
    rng = random.Random(18)
    texts = ["".join(rng.choices("ab c" if i % 3 else "abcdefgh \n", k=rng.choice((0, 3, 11, 12, 25, 31, 32, 50, 62, 63, 64, 90, 300)))) for i in range(150)]
    df = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    edits = {len(texts) - i: t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)}
    alone = winnow.with_packed(spark.createDataFrame(list(edits.items()), "doc_id long, text string"), "text", "p")
    alone = {r["doc_id"]: r["d"] for r in alone.select("doc_id", F.concat_ws("-", F.lower(F.hex(F.xxhash64("p"))), F.size("p").cast("string")).alias("d")).collect()}
    got = {r["doc_id"]: r for r in winnow.edited(df).collect()}
    for d, t in edits.items():
        assert got[d]["edited_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert got[d]["edited_fingerprint"] == alone[d], (d, t)


@pytest.mark.parametrize("ids", ["squares", "outlier", "powers", "hot", "missing"])
def test_winnowing_ranges(spark, monkeypatch, ids):
    """Many ranges, so that next documents cross from one to another, whatever the ids; no range is large."""
    monkeypatch.setattr(winnow, "ROWS", 3)
    monkeypatch.setattr(winnow, "CELLS", 16)
    made, own = [], winnow.ranges
    monkeypatch.setattr(winnow, "ranges", lambda *a: made.append(own(*a)) or made[-1])
    n = 48
    of = {"squares": lambda i: i * i, "outlier": lambda i: i if i else 2**63 - 1, "powers": lambda i: 2 ** (i + 10) - 2**62, "hot": lambda i: i if i % 2 else 8, "missing": lambda i: i if i % 3 else None}[ids]
    rows = [(of(i), f"text {i} " * 4) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {r["text"]: r["tie"] for r in df.select("text", F.xxhash64("text").alias("tie")).collect()}
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % n][1]
        want.append((d, hashlib.sha256((t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode()).hexdigest()))
    got = [(r["doc_id"], r["edited_sha256"]) for r in winnow.edited(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    parts = [r["count"] for r in made[0].groupBy("_part").count().collect()]
    assert len(parts) > 4 and max(parts) <= 16 and sum(parts) == n


def test_winnowing_likeness(spark, unique):
    """The likeness of two texts' fingerprints against sets of chosen grams by hand."""
    rows = sorted((r for r in corpus()[:-3] if len(r[1] or "") < 5000), reverse=True, key=lambda r: r[0])
    df = unique.where("length(text) < 5000 or text is null")
    seen: dict[str, int] = {}

    def prints(text):
        t = re.sub(r"[\x20\x09-\x0D]+", " ", text).strip(" ")
        gs = [t[i : i + winnow.K] for i in range(len(t) - winnow.K + 1)] or ([t] if t else [])
        return {gs[i] for i in winnowed([seen[g] for g in gs])}, gs

    texts, pairs = [], {}
    for i, r in enumerate(rows):
        text, following = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        pairs[r[0]] = (text, text[: len(text) - half] + following[:half], following)
        texts += pairs[r[0]]
    every = sorted({t[i : i + winnow.K] for x in texts for t in [re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ")] for i in range(max(1, len(t) - winnow.K + 1))} - {""})
    seen = {r["g"]: r["h"] >> winnow.PLACE_BITS for r in spark.createDataFrame([(g,) for g in every], "g string").select("g", F.xxhash64("g").alias("h")).collect()}

    def alike(a, b):
        a, b = prints(a)[0], prints(b)[0]
        return len(a & b) / len(a | b) if a | b else 1.0

    got = {r["doc_id"]: r for r in winnow.edited(df).collect()}
    for d, (text, new, following) in pairs.items():
        assert got[d]["near_edited"] == pytest.approx(alike(text, new)) and got[d]["near_next"] == pytest.approx(alike(text, following))


# 8

def cut_by_hand(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((b, gone))
    return out


@pytest.mark.parametrize("bucket", [1 << 20, 3000, 1])
def test_suffix(docs, unique, none, monkeypatch, bucket):
    monkeypatch.setattr(suffix, "BUCKET_BYTES", bucket)
    rows = corpus()[:-3]
    got = {r["doc_id"]: r for r in suffix.digests(unique).collect()}
    removed = 0
    for r, (b, gone) in zip(rows, cut_by_hand([r[1] for r in rows], suffix.LENGTH)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        removed += int(gone.sum())
        assert tuple(got[r[0]])[1:] == (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    assert removed > 5000
    clash = docs.withColumns({"doc": F.lit(1), "tid": F.lit(2), "cuts": F.lit("c"), "row": F.lit("r")})
    left = suffix.remove(clash)
    assert left.columns == clash.columns and left.count() == docs.count() and left.where("doc_id = 0 and text <> ''").count() == 0
    assert suffix.remove(none).isEmpty() and suffix.digests(none).isEmpty()


def test_suffix_split_buckets(spark, monkeypatch):
    """Many different spans around one anchor: the bucket is split by its windows' own bytes, down to equal windows."""
    monkeypatch.setattr(suffix, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffix, "OUT_BYTES", 3000)
    rng = random.Random(12)
    word = lambda k: "".join(rng.choices("abcdefgh", k=k))
    line = word(230)
    texts = [word(rng.randint(0, 300)) + line[rng.choice((0, 0, 5, 20)) : rng.choice((230, 230, 225, 205))] + word(rng.randint(0, 300)) for _ in range(120)]
    texts += [texts[0]] * 3 + [line] * 2 + ["ab" * 300, "a" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rounds, own = [], suffix.halves
    monkeypatch.setattr(suffix, "halves", lambda p: rounds.append(1) or own(p))
    got = {r["doc_id"]: r for r in suffix.digests(df.unionAll(df.where("doc_id = 7"))).collect()}
    texts.append(texts[7])
    for i, (b, gone) in enumerate(cut_by_hand(texts, suffix.LENGTH)[:-1]):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())
    assert len(rounds) > 2


def test_suffix_order():
    rng = np.random.default_rng(8)
    for _ in range(20):
        t = bytes(rng.integers(97, 99, 400).astype(np.uint8)) + b"ab" * 30
        length, n = int(rng.integers(5, 60)), len(t)
        starts = np.sort(rng.choice(n - length, 150, replace=False))
        data = np.zeros(n + 4 * length + 4 * cover.V, np.uint8)
        data[:n] = np.frombuffer(t, np.uint8)
        order = starts[cover.suffix_order(data, n, starts, length)]
        padded = t + bytes(2 * length)
        assert all(padded[a : a + length] <= padded[b : b + length] for a, b in zip(order, order[1:]))
        count = Counter(padded[s : s + length] for s in starts)
        assert cover.repeated(t, starts, np.ones(len(starts)), length).tolist() == [count[padded[s : s + length]] > 1 for s in starts]
    assert all(any((a + d) % cover.V in cover.COVER and (b + d) % cover.V in cover.COVER for d in range(cover.V)) for a in range(cover.V) for b in range(cover.V))


def test_anchors(monkeypatch):
    """Every window has one anchor, and equal windows the same; also across blocks."""
    monkeypatch.setattr(rolling, "BLOCK", 300)
    rng = np.random.default_rng(9)
    data = rng.integers(97, 101, 1500).astype(np.uint8)
    data[900:1200] = data[100:400]
    a = rolling.anchors(data, 120, 20)
    own = {p: (g, at - p) for g, lo, hi, at in zip(a["gram"], a["low"], a["high"], a["at"]) for p in range(lo, hi + 1)}
    assert sorted(own) == list(range(1500 - 119)) and all(own[p] == own[p + 800] for p in range(100, 281))


# 9

def test_mixing(spark, docs, none):
    rows = corpus()
    size = [len(WORDS.findall(r[1] or "")) for r in rows]
    source = Counter()
    for r, n in zip(rows, size):
        source[r[3]] += n
    order = sorted((s for s in source if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    budget, target, full = 1.5 * sum(size), {}, set()
    while True:
        rest = budget - sum(2 * source[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        target = {s: 2 * source[s] if s in full else level * weight[s] for s in order}
        over = {s for s in order if target[s] > 2 * source[s]}
        if not over:
            break
        full |= over
    clash = docs.withColumns({"key": F.lit(1), "budget": F.lit(2), "size": F.lit("x"), "row": F.lit("r")})
    got = mixing.mix(clash).collect()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == source[r["source"]] and r["taken"] == r["size"] * r["copies"] and r["copies"] in (0, 1, 2)
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and sum(taken.values()) <= budget and all(abs(taken[s] - target[s]) <= 2 * max(size) for s in order)
    assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    assert mixing.expand(clash).columns == clash.columns and mixing.expand(clash).count() == sum(r["copies"] for r in got)
    assert mixing.plan(none).isEmpty() and mixing.expand(none).isEmpty()
    assert mixing.plan(docs.where("text is null")).where("taken <> 0").isEmpty()


# The pipeline

def test_pipeline(spark, docs, none):
    stages = dict(corpus_pipeline.STAGES)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "suffix_array_dedup", "source_mixing", "bpe_encoding"]
    extra = docs.withColumns({c: F.lit(c) for c in ("row", "keep", "score", "node", "doc", "cuts", "key", "copies", "ids")})
    for df in (docs, extra, none):
        now = df
        for name, stage in stages.items():
            after = stage(spark, now, "").cache()
            if name != "bpe_encoding":
                assert after.columns == df.columns
            if name == "suffix_array_dedup":
                before = {r["doc_id"]: r["text"] for r in now.where("doc_id is not null").collect()}
                data = cut_by_hand([r["text"] for r in now.collect()], suffix.LENGTH)
                kept = sorted(bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") for b, gone in data)
                assert sorted(r["text"] or "" for r in after.collect()) == kept and len(before) <= len(kept)
            if name == "minhash_near_dedup" and now.count():
                s = sets([(0, r["text"]) for r in after.where("doc_id is not null").collect()])
                assert not any(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(s) for b in s[:i] if a and b)
            now = after
        assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert now.isEmpty() == df.isEmpty()
