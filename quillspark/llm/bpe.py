"""BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build a token of the vocabulary. Two neighbouring bytes that stand side by side inside no
token can therefore never be merged into one: between them there is a certain cut. Each word is split at its certain
cuts, the fragments are encoded independently (and remembered), and their ids are concatenated. The result equals
that of the unsplit word.

Texts: null counts as empty and gives no ids. Very long texts are encoded as a whole, word by word. Repeated rows
and equal ids stay separate rows. All other columns pass through untouched, whatever their names; a column that has
the name of a new one is replaced.
"""

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quillspark.llm.common import in_arrow

#: Bytes of words, and of fragments, with their ids, that one Python worker remembers.
REMEMBERED = 64 << 20
FRAGMENTS = 24 << 20

# Letters and numbers among the first 256 code points, after lower-casing.
LATIN_LETTERS = "a-zªµºß-öø-ÿ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


#: The settings of a vocabulary file that the encoders here follow; another file is refused.
FOLLOWED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": CONTRACTIONS + "|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
ADDED = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def followed(spec: dict) -> dict:
    """The vocabulary file's content, if its settings are those that are followed here; else an error that names the first one that isn't."""
    wrong = [k for k, v in FOLLOWED.items() if spec.get(k) != v] + [f"model.{k}" for k, v in MODEL.items() if spec["model"].get(k, v) != v]
    wrong += [f"added token {a['content']}" for a in spec["added_tokens"] if any(a.get(k, v) != v for k, v in ADDED.items())]
    if wrong:
        raise ValueError(f"this vocabulary file's {wrong[0]} is not one that can be followed")
    return spec


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free one from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


def latin_pattern() -> re.Pattern:
    """The vocabulary file's word pattern for texts in Latin-1; there, NFC changes nothing."""
    return re.compile(f"{CONTRACTIONS}|[{LATIN_LETTERS}]+|[{LATIN_NUMBERS}]|[^\\t-\\r \\x85\\xa0{LATIN_LETTERS}{LATIN_NUMBERS}]+")


class _Remembered(dict):
    """Calls ``make`` for a key that is not there; keeps results while they take at most ``most`` bytes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        value = self.make(key)
        if self.most > 0:
            self[key] = value
            self.most -= cost(key, value)
        return value


def cost(key: object, ids: tuple[int, ...]) -> int:
    """Bytes of an entry: its key, its ids (numbers that are shared) and its place in the table."""
    return sys.getsizeof(key) + (sys.getsizeof(key[0]) if isinstance(key, tuple) else 0) + sys.getsizeof(ids) + 104


class ForcedBoundaryBPE:
    """Encodes as the vocabulary file says: its added tokens, NFC, white space to one space, lower case, word split (``FOLLOWED``)."""

    def __init__(self, spec: dict, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        model = followed(spec)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        n = max(self.vocab.values()) + 1
        self.ints = list(range(max(n, 1 + max((a["id"] for a in spec["added_tokens"]), default=0))))
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.ints[self.vocab[a + b]]))
        alphabet = byte_alphabet()
        self.first = [self.ints[self.vocab[c]] for c in alphabet]
        self.final = [self.ints[self.vocab[c + self.suffix]] for c in alphabet]
        self.token = [""] * len(self.ints)
        for t, i in self.vocab.items():
            self.token[i] = t
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for t, i in self.added.items():
            self.token[i] = t
        self.decimal = [str(i) for i in self.ints]
        self.inside = self._pairs_inside(alphabet)
        self.fragments = _Remembered(self._merge, min(remembered, FRAGMENTS))
        self.words = _Remembered(self._word, remembered)
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.latin = latin_pattern()
        self.wide = regex.compile(rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+")
        self.normalizer = Tokenizer.from_str(json.dumps(spec)).normalizer

    def _pairs_inside(self, alphabet: list[str]) -> np.ndarray:
        """inside[256 * a + b]: the bytes a, b stand side by side in some token."""
        code = {c: b for b, c in enumerate(alphabet)}
        inside = np.zeros(65536, bool)
        for t in self.vocab:
            got = [code[c] for c in t.removesuffix(self.suffix)]
            for a, b in zip(got, got[1:]):
                inside[256 * a + b] = True
        return inside

    def cuts(self, word: bytes) -> list[int]:
        """Places in ``word`` where no token can reach across."""
        inside = self.inside
        return [i for i in range(1, len(word)) if not inside[256 * word[i - 1] + word[i]]]

    def _word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        at = self.cuts(data)
        if not at:
            return self._merge((data, True))
        ends = [0, *at, len(data)]
        return tuple(chain.from_iterable(self.fragments[data[a:b], b == len(data)] for a, b in zip(ends, ends[1:])))

    def _merge(self, fragment: tuple[bytes, bool]) -> tuple[int, ...]:
        """Merges the pair of lowest rank, the leftmost first, until none is left."""
        data, last = fragment
        ids = [self.first[b] for b in data]
        if last:
            ids[-1] = self.final[data[-1]]
        merges = self.merges
        while len(ids) > 1:
            best = None
            for i, pair in enumerate(zip(ids, ids[1:])):
                if (m := merges.get(pair)) and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            left, right = ids[at], ids[at + 1]
            out, i, n = ids[:at], at, len(ids)
            while i < n:  # this pair everywhere: no other can come before it
                if i + 1 < n and ids[i] == left and ids[i + 1] == right:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return tuple(ids)

    def pieces(self, text: str) -> list[str]:
        """Words of a text that holds no added token."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide.findall(self.normalizer.normalize_str(text))
        return self.latin.findall(text.lower())

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.split_added and "<" in text and len(parts := self.split_added.split(text)) > 1:
            return [i for p in parts if p for i in ([self.added[p]] if p in self.added else self.encode_plain(p))]
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.words.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as the file names no decoder; added tokens are not skipped."""
        return " ".join(map(self.token.__getitem__, ids))


def read_spec(path: str) -> bytes:
    """The vocabulary file's content. It has a fixed size of under 2 MB and goes to the executors as a broadcast."""
    with open(path, "rb") as f:
        return f.read()


def worker_encoder(content: bytes) -> ForcedBoundaryBPE:
    """One encoder for each Python worker and vocabulary; what it remembers serves later tasks too."""
    key = hashlib.md5(content).hexdigest()
    kept = sys.__dict__.setdefault("_quillspark_bpe", {})
    if key not in kept:
        kept[key] = ForcedBoundaryBPE(json.loads(content))
    return kept[key]


def _with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    old = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n not in new}
    return pa.RecordBatch.from_pydict(old | new)


def _schema(df: DataFrame, **new: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in new] + [T.StructField(k, v) for k, v in new.items()])


def id_lists(rows: list[list[int]]) -> pa.Array:
    ends = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ``ids`` (array of int): the token ids of ``text``."""
    content = df.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(content.value)
        for b in batches:
            yield _with_columns(b, {ids: id_lists([bpe.encode(t) for t in b.column(text).to_pylist()])})

    return in_arrow(df, run, _schema(df, **{ids: T.ArrayType(T.IntegerType())}))


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds ``text``: what the token ids of ``ids`` stand for. Null ids give an empty text."""
    content = df.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(content.value)
        for b in batches:
            yield _with_columns(b, {text: pa.array([bpe.decode(x or []) for x in b.column(ids).to_pylist()], pa.string())})

    return in_arrow(df, run, _schema(df, **{text: T.StringType()}))


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encodes and decodes in one pass; adds ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` in place of ``text``."""
    content = df.sparkSession.sparkContext.broadcast(read_spec(path))
    narrow = df.select(*[c for c in df.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")])
    out = _schema(narrow, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType())
    out = T.StructType([f for f in out.fields if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_encoder(content.value)
        sha = hashlib.sha256
        for b in batches:
            n, of_ids, of_text = [], [], []
            for t in b.column(text):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                of_ids.append(sha(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
                of_text.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield _with_columns(b, {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_text)}).drop_columns([text])

    return in_arrow(narrow, run, out)


def default_path(spark: SparkSession | None = None) -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
