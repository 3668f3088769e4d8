"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain on a document. Expectation-maximisation over the counts of
vote patterns of all documents estimates how often each labeller gives each vote on good and on bad ones, and with that the
posterior of each pattern. The posteriors are the labels that train a hashed linear scorer (logistic regression over the
hashed shapes of words), fitted on a bounded sample; it scores every document, and those below one half are rejected.

There are at most 3 ** LABELLERS patterns, whatever the input's size. The scorer is fitted on about ``SAMPLE`` documents
(twice that at most), chosen by a hash; everything else covers all documents.

Documents without words (null, empty, white space) score 0 and are rejected. Texts of any length are read as a whole.
Repeated rows get the same score. If all documents look alike, all get the same class. An empty table gives no rows. Columns named
``score`` and ``keep`` are replaced.
"""

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import drop_path, in_arrow, new_path, saved

#: Hash buckets of the scorer, and documents that it is fitted on.
DIMS = 1024
SAMPLE = 10_000
#: Words that a text is thought to have besides its own, which tell nothing.
SHRINK = 8
#: Labellers of proportions abstain on texts of fewer words.
FEW = 12
ROUNDS = 100
STEPS = 600
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Score from which a document is kept.
LEAST = 0.5


def _shapes() -> bytes:
    """Bytes to a kind: a small or non-ASCII letter, A capital, 0 digit; all others stand for themselves."""
    kinds = bytearray(range(256))
    for b in range(256):
        c = chr(b)
        kinds[b] = ord("a") if b > 127 or "a" <= c <= "z" else ord("A") if "A" <= c <= "Z" else ord("0") if c.isdigit() else b
    return bytes(kinds)


SHAPES = _shapes()


class Look:
    """What the labellers and the scorer see of a text."""

    def __init__(self, text: str | None):
        data = (text or "").encode("utf-8", "surrogatepass")
        tokens = data.split()
        self.n = len(tokens)
        self.shapes = Counter(data.translate(SHAPES).split())
        again = bytes(map(operator.eq, tokens, tokens[1:]))
        self.same = again.count(1) / max(1, self.n - 1)
        self.run = 1 + max(map(len, again.split(b"\0")))
        self.distinct = len(set(tokens)) / max(1, self.n) ** 0.5
        lines = [x for x in data.split(b"\n") if x.strip()]
        self.repeated_lines = 1 - len(set(lines)) / max(1, len(lines))

    def share(self, test) -> float:
        return sum(v for k, v in self.shapes.items() if test(k)) / max(1, self.n)


def _has_letter(k: bytes) -> bool:
    return b"a" in k or b"A" in k


def _tail(k: bytes) -> bool:
    """A word with three signs or more behind it, full stops and commas aside."""
    rest = k.rstrip(b"#$%&*@^~+=<>")
    return len(k) - len(rest) >= 3 and len(rest) > 0


def proportions(look: Look) -> dict[str, float]:
    return {
        "signs": look.share(_tail),
        "capitals": look.share(lambda k: k.count(b"A") > 1 and b"a" not in k),
        "exclaimed": look.share(lambda k: k.endswith(b"!!")),
        "loose": look.share(lambda k: not _has_letter(k) and b"0" not in k),
        "same": look.same,
        "run": min(1.0, look.run / 10),
        "distinct": look.distinct,
        "bars": look.share(lambda k: len(k) == 1 and not k.isalnum()),
        "short": look.share(lambda k: _has_letter(k) and len(k.strip(b".,;:!?")) <= 3),
        "length": sum(len(k) * v for k, v in look.shapes.items()) / max(1, look.n),
        "lines": look.repeated_lines,
    }


#: (proportion, bad above, good up to); ``short`` and ``length`` are bad outside a range.
LIMITS = (("signs", 0.2, 0.02), ("capitals", 0.25, 0.05), ("exclaimed", 0.2, 0.02), ("loose", 0.15, 0.03), ("bars", 0.1, 0.02), ("same", 0.2, 0.05), ("run", 0.35, 0.25), ("lines", 0.5, 0.1))
RANGES = (("short", 0.12, 0.2, 0.45, 0.6), ("length", 3.8, 4.4, 6.2, 7.0), ("distinct", 2.4, 3.0, 1e9, 1e9))
LABELLERS = len(LIMITS) + len(RANGES)
#: Proportions that only labellers use: the scorer has the shapes for them.
PLAIN = ("length", "short", "distinct")
#: How much louder the other proportions are than a single shape's share.
LOUD = 4.0


def votes(look: Look, p: dict[str, float]) -> str:
    if look.n < FEW:
        return "".join(str(BAD if p[k] > bad and look.n > 3 else ABSTAIN) for k, bad, _ in LIMITS) + str(ABSTAIN) * len(RANGES)
    out = [BAD if p[k] > bad else GOOD if p[k] <= good else ABSTAIN for k, bad, good in LIMITS]
    out += [BAD if p[k] < a or p[k] > d else GOOD if b <= p[k] <= c else ABSTAIN for k, a, b, c, d in RANGES]
    return "".join(map(str, out))


def _bucket(name: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(name) % DIMS


def collapsed(shape: bytes) -> bytes:
    """Each run of one kind as one."""
    return re.sub(rb"(.)\1+", rb"\1", shape, flags=re.DOTALL)


def hashed(look: Look, p: dict[str, float], known: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Shares of words by shape and by collapsed shape, and the proportions, each in its bucket."""
    out = np.zeros(DIMS, np.float32)
    for k, v in look.shapes.items():
        if k not in known:
            if len(known) > 100_000:
                known.clear()
            known[k] = _bucket(b"s" + k), _bucket(b"c" + collapsed(k))
        for i in known[k]:
            out[i] += v
    out /= look.n + SHRINK  # few words say little
    for k in p:
        out[_bucket(b"p" + k.encode())] += LOUD * p[k] * look.n / (look.n + SHRINK) if k not in PLAIN else 0.0
    return out


SPARSE = np.dtype([("at", "<u2"), ("value", "<f4")])


def sparse(x: np.ndarray) -> bytes:
    """The places and values of a vector's numbers besides zeros."""
    at = np.flatnonzero(x)
    out = np.empty(len(at), SPARSE)
    out["at"], out["value"] = at, x[at]
    return out.tobytes()


def unpack(packed: bytes, into: np.ndarray) -> None:
    found = np.frombuffer(packed, SPARSE)
    into[found["at"]] = found["value"]


def patterns(docs: DataFrame, text: str) -> pd.DataFrame:
    """Vote patterns of documents with words, and how many have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for t in b.column("t"):
                look = Look(t.as_py())
                if look.n:
                    seen[votes(look, proportions(look))] += 1
            yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = in_arrow(docs.select(F.col(text).alias("t")), run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return counted.orderBy("pattern").toPandas()  # at most 3 ** LABELLERS rows


def estimate(counted: pd.DataFrame) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, chances [labeller, class, vote] (1 for abstain), and the share of good documents."""
    v = np.array([[int(x) for x in p] for p in counted["pattern"]]).reshape(-1, LABELLERS)
    n = counted["n"].to_numpy(float)
    good = np.where((v == BAD).sum(1) > 0, 0.2, 0.9)  # at first, one vote of bad is suspicious
    tables, prior = np.zeros((LABELLERS, 2, 3)), 0.8
    for _ in range(ROUNDS):
        weight = np.stack([n * (1 - good), n * good])
        for i in range(LABELLERS):
            for vote in (BAD, GOOD):
                tables[i, :, vote] = weight[:, v[:, i] == vote].sum(1) + 0.5
        tables /= tables[:, :, [BAD, GOOD]].sum(2, keepdims=True)
        tables[:, :, ABSTAIN] = 1.0  # says nothing
        prior = float((weight[1].sum() + 1) / (n.sum() + 2))
        log = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(tables[i][:, v[:, i]]) for i in range(LABELLERS)) if len(v) else np.zeros((2, 0))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if len(new) == 0 or np.abs(new - good).max() < 1e-9:
            good = new
            break
        good = new
    return dict(zip(counted["pattern"], good.tolist())), tables, prior


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels; Adam over all rows."""
    if not len(x):
        return np.zeros(DIMS), 0.0
    w, m, s = np.zeros(DIMS + 1), np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    for step in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(np.float32) + w[-1], -30, 30)))
        e = (p - y) / len(x)
        g = np.concatenate([x.T @ e.astype(np.float32), [e.sum()]]) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, doc_id: str = "doc_id") -> tuple[np.ndarray, float]:
    """Weights and bias. The sample goes by a hash of id and text, so copies of a text are thinned like all others."""
    counted = patterns(docs, text)
    posterior, _, _ = estimate(counted)
    total = max(1, int(counted["n"].sum()))
    share = int(min(1.0, sample / total) * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            h, x, of = [], [], []
            for at, t in zip(b.column("h"), b.column("t")):
                look = Look(t.as_py())
                if look.n:
                    p = proportions(look)
                    h.append(at.as_py())
                    x.append(sparse(hashed(look, p, known)))
                    of.append(votes(look, p))
            yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "x": pa.array(x, pa.binary()), "pattern": pa.array(of, pa.string())})

    ids = [F.col(doc_id)] if doc_id in docs.columns and doc_id != text else []
    chosen = docs.select(F.pmod(F.xxhash64(*ids, F.col(text)), F.lit(1 << 30)).alias("h"), F.col(text).alias("t")).where(F.col("h") < share)
    path = new_path(docs.sparkSession, "sample")
    rows = saved(in_arrow(chosen, run, "h long, x binary, pattern string"), "sample", path=path)
    if rows.count() > 2 * sample:
        rows = rows.orderBy("h", "x", "pattern").limit(2 * sample)
    got = sorted((r["x"], posterior[r["pattern"]]) for r in rows.select("x", "pattern").collect())  # so that their order doesn't change the fit
    drop_path(docs.sparkSession, path)
    y = np.array([label for _, label in got])
    x = np.zeros((len(got), DIMS), np.float32)
    for i, (packed, _) in enumerate(got):
        unpack(packed, x[i])
    del got
    return fit(x, y)


def scored(docs: DataFrame, text: str, w: np.ndarray, bias: float, least: float) -> DataFrame:
    """``row`` (the columns besides ``text``), ``text`` and ``score``, of rows that score ``least`` at least. A text travels once."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int]] = {}
        for b in batches:
            score = []
            for t in b.column("text"):
                look = Look(t.as_py())
                z = float(hashed(look, proportions(look), known).astype(np.float64) @ w) + bias if look.n else -np.inf
                score.append(round(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))), 6) if look.n else 0.0)
            out = pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(score, pa.float64())], names=["row", "text", "score"])
            yield out if least <= 0 else out.filter(pa.array(np.array(score) >= least))

    return in_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, text {rows.schema['text'].dataType.simpleString()}, score double")


def _columns(docs: DataFrame, text: str, names: list[str]) -> list:
    return [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c in names]


def classify(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Adds ``score`` (chance of a good document, to six places) and ``keep`` to every row."""
    out = scored(docs, text, *train(docs, text, sample), least=0.0)
    old = [c for c in docs.columns if c not in ("score", "keep") or c == text]
    return out.select(*_columns(docs, text, old), "score", (F.col("score") >= LEAST).alias("keep"))


def keep_good(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows that are not rejected, with their own columns."""
    return scored(docs, text, *train(docs, text, sample), least=LEAST).select(*_columns(docs, text, docs.columns))
