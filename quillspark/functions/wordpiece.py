"""Word pieces: words and signs split, then the longest piece known at each place."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+|[^\w\s]|_")


def word_pieces(word: str, vocabulary: set[str], unknown: str = "[UNK]", longest: int = 100) -> list[str]:
    """The pieces of one word, those after the first marked by ``##``; one ``unknown`` if any part isn't known."""
    out, at = [], 0
    while at < len(word) <= longest:
        mark = "##" if at else ""
        end = next((e for e in range(len(word), at, -1) if mark + word[at:e] in vocabulary), None)
        if end is None:
            return [unknown]
        out.append(mark + word[at:end])
        at = end
    return out or [unknown]


def pieces(text: Column, vocabulary: set[str], most: int = 512) -> Column:
    """The first ``most`` pieces of a folded text, as an array; a null has none.

    ``most`` is the model's input size. Rows pass as Arrow batches, each different word of a batch is split once.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        known: dict[str, list[str]] = {}

        def one(text: str | None) -> list[str]:
            out: list[str] = []
            for m in WORDS.finditer(text or ""):
                if len(out) >= most:
                    break
                w = m.group()
                if w not in known:
                    known[w] = word_pieces(w, vocabulary)
                out += known[w]
            return out[:most]

        return texts.map(one)

    return run(text)
