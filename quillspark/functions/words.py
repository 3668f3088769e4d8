"""Words of messages and names as Column expressions: project names, starts of lines, topics, close words, keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T


def project_name(path: Column) -> Column:
    """The first part of a path as a name: words with a capital, "home" is the wiki itself; null stays null."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    runs = F.regexp_extract_all(F.lower(F.translate(first, "_", " ")), F.lit("[a-z]+|[^a-z]+"), F.lit(0))
    named = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, F.lit(1), F.lit(1))), F.substring(x, F.lit(2), F.length(x)))), "")
    return F.when(first == "home", "Wiki").otherwise(named)


def line_start(line: Column) -> Column:
    """The first word in lower case, each run of a letter as one; "" without a word."""
    return F.regexp_replace(F.lower(F.regexp_extract(line, "[A-Za-z]+", 0)), r"(.)\1+", "$1")


def topic_words(text: Column) -> Column:
    """Words as topics: -men is -man in words above four letters, a plain plural s goes from words above three."""
    one = lambda w: F.when(w.endswith("men") & (F.length(w) > 4), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("man"))).otherwise(w)
    cut = lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    return F.transform(F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), one), cut)


def original_case(text: Column, subject: Column) -> Column:
    """The subject's words as the text has them, whatever stands between them; else the subject itself."""
    ws = F.regexp_extract_all(subject, F.lit("[a-z0-9]+"), F.lit(0))
    found = F.regexp_substr(text, F.concat(F.lit("(?i)"), F.array_join(ws, r"\W+")))
    return F.when(F.size(ws) > 0, F.coalesce(found, subject)).otherwise(subject)


def close(typed: Column, word: Column) -> Column:
    """The word itself, a start of it from four letters on, or a small typo: one edit below seven letters, else two."""
    edits = F.levenshtein(typed, word) <= F.when(F.length(word) < 7, 1).otherwise(2)
    near = (F.abs(F.length(typed) - F.length(word)) <= 2) & edits
    return (typed == word) | ((F.length(typed) >= 4) & (word.startswith(typed) | near))


def matches_key(key: Column, patterns: list[str]) -> Column:
    """Whether a key fits a pattern: ``*end``, ``start*`` or the key itself."""
    out = F.lit(False)
    for p in patterns:
        out = out | (key.endswith(p[1:]) if p[:1] == "*" else key.startswith(p[:-1]) if p[-1:] == "*" else key == p)
    return out


# Titles and chapters that are no article, and words that only name the game.
SKIP_TITLES = r"(?i)Edition|Snapshot|Pre-release|Release Candidate|\(disambiguation\)|^(Category|Template|File):"
SKIP_SECTIONS = [
    "history", "issues", "trivia", "gallery", "screenshots", "videos", "references", "navigation", "in other media", "publicity", "data values", "achievements",
    "external links", "see also", "notes", "sounds", "renders", "mojang screenshots", "development images", "concept artwork",
]
CUE_WORDS = ["vanilla", "minecraft", "mc", "game", "normal", "base", "default"]


def is_article(title: Column, heading: Column) -> Column:
    """Neither the title nor the heading is one of those without an article's text; null counts as empty."""
    return ~F.coalesce(title, F.lit("")).rlike(SKIP_TITLES) & ~F.lower(F.trim(F.coalesce(heading, F.lit("")))).isin(SKIP_SECTIONS)


def keywords(text: Column, synonyms: dict[str, str], stop: list[str], most: int = 10) -> Column:
    """A question as search words: without stopwords and cue words, slang spelled out, ``most`` at most."""
    drop = F.array(*map(F.lit, [*stop, *CUE_WORDS]))
    plain = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    kept = F.filter(T.raw_words(text), lambda w: ~F.array_contains(drop, w))
    return F.array_join(F.slice(F.transform(kept, lambda w: F.coalesce(F.try_element_at(plain, w), w)), 1, most), " ")
