"""Document fingerprints by winnowing.

A text is a sequence of characters, in which a run of white space is one space and the ends have none. Each of its k-grams,
``K`` characters in a row, is hashed. Of each window of ``WINDOW`` k-grams the smallest hash is chosen, the rightmost if
several are smallest, and kept with its place. So two texts that share ``WINDOW + K - 1`` characters in a row share a
fingerprint, with or without spaces, and nothing under ``K`` characters can make them do so. A text of fewer than ``K``
characters has one gram of all of them; one of fewer grams than a window has one window. A gram is cut out and hashed by
itself: the hashes are what rolling would give for equal grams, but columns have no expression that carries a state.

A hash of 36 bits and its place are one long: the place stands in the low 28 bits, counted downwards, so the smallest number
of a window is its smallest hash with the rightmost place. A column's array of longs takes 2 GB at most, under 2 ** 28 of
them, so no place that can occur needs more bits. Only DataFrame expressions.

Null and empty texts and those of white space have no fingerprints. Two texts without any are wholly alike (1.0), one
without any and another are not alike at all (0.0). Texts of any length are taken as a whole. Equal rows stay. Rows without
an id come after all others, rows of one id in the order of a hash of their texts. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch

K = 12
WINDOW = 20
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Ranges that the ids are counted in, and rows wanted in a range of neighbours (more, where that gave over CELLS ranges).
CELLS = 65_536
ROWS = 1500


def spaced(text: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))


def grams_of(plain: Column, k: int = K) -> Column:
    """The hash of each k-gram of a text from ``spaced``, above its place from the end.

    A match of no width at each character captures the ``k`` that start there.
    """
    each = F.regexp_extract_all(plain, F.lit(rf"(?s)(?![\x{{DC00}}-\x{{DFFF}}])(?=(.{{{k}}}))"), F.lit(1))
    short = F.when(plain == "", F.array().cast("array<string>")).otherwise(F.array(plain))
    each = F.when(F.char_length(plain) < k, short).otherwise(each)
    return F.transform(each, lambda g, i: F.xxhash64(g).bitwiseAND(F.lit(~PLACES)).bitwiseOR(F.lit(PLACES - 1) - i))


def grams(text: Column, k: int = K) -> Column:
    return grams_of(spaced(text), k)


def moved(packed: Column, by: Column) -> Column:
    """Grams at places so much higher."""
    return F.transform(packed, lambda x: x - by)


def least_of(of: str, steps: list[int]) -> Column:
    """For each place of an array the least of its number and those so many places on; the end cuts it short."""
    return F.transform(of, lambda x, i: F.least(x, *[F.get(of, i + s) for s in steps]))


def with_chosen(df: DataFrame, packed: str, name: str, window: int = WINDOW, whole: Column | None = None) -> DataFrame:
    """Adds ``name``: the smallest of each window of ``packed``, once: first the least of some in a row, then of such runs.

    Fewer grams than a window are one window, but where ``whole`` is false, as they are then a part of others.
    """
    run = max(1, round((window - 1) ** 0.5))  # the fewest looks at other places
    df = df.withColumn("_run", least_of(packed, list(range(1, run))) if run > 1 else F.col(packed))
    df = df.withColumn("_all", least_of("_run", [*range(run, window - run, run), window - run]) if run < window else F.col("_run"))
    few = F.least(F.size(packed), F.lit(1))
    windows = F.greatest(F.size(packed) - (window - 1), few if whole is None else F.when(whole, few).otherwise(0))
    return df.withColumn(name, F.array_distinct(F.slice("_all", F.lit(1), windows))).drop("_run", "_all")


def chosen_first(chosen: Column, windows: Column, window: int = WINDOW) -> Column:
    """Of the chosen grams of a text those of its first so many windows.

    A gram is first chosen when it comes into the window, if it is no larger than the one chosen before, or else when that
    one has left.
    """

    def first(x: Column, i: Column) -> Column:
        before = F.get(chosen, i - 1)
        enters = place(x) - (window - 1)
        return F.when(i == 0, 0).when(F.shiftright(x, PLACE_BITS) <= F.shiftright(before, PLACE_BITS), enters).otherwise(place(before) + 1)

    return F.filter(chosen, lambda x, i: first(x, i) < windows)


def place(packed: Column) -> Column:
    return F.lit(PLACES - 1) - packed.bitwiseAND(F.lit(PLACES))


def hashes(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, PLACE_BITS)))


def fingerprints(packed: Column) -> Column:
    """array<struct<hash, place>>, places counted in characters from 0."""
    return F.transform(packed, lambda x: F.struct(F.shiftright(x, PLACE_BITS).alias("hash"), place(x).alias("place")))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes by all hashes of two sets."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def with_packed(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: the packed fingerprints of ``text``. Each step is a column of its own, so that none runs twice."""
    return with_chosen(df.withColumn("_grams", grams(F.col(text))), "_grams", name).drop("_grams")


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    return with_packed(df, text, "_packed").withColumn(name, fingerprints(F.col("_packed"))).drop("_packed")


def ranges(docs: DataFrame, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``docs`` with ``_part``, which numbers runs of rows from the highest ids down, without ids last, and ``_parts``, their number.

    Ids are counted in equal stretches, those with too many rows in shorter ones, and so on down to single ids, however they
    are spread. Rows of one id, or without, are counted by the hash of their text. The counts are small tables of some CELLS
    rows at most, whatever the input's size; they are broadcast.
    """
    id_ = F.col(doc_id)
    n, low, high = docs.agg(F.count(F.lit(1)), F.min(id_), F.max(id_)).first()
    per = max(ROWS, -(-n // CELLS))
    low, high = (0, 0) if low is None else (low, high)
    exact = lambda c: c.cast("decimal(38,0)")
    nth = lambda value, first, width: F.floor((exact(value) - exact(first)) / exact(width)).cast("long")
    rows = docs.withColumn("_cell", F.coalesce(nth(id_, F.lit(low), F.lit((high - low) // CELLS + 1)), F.lit(-1).cast("long")))
    cells = lambda: rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min(id_).alias("low"), F.max(id_).alias("high"))
    level, by_text = 0, False
    while not by_text:  # a round of ids divides by five at least, so 28 rounds end any; mostly there is none
        counts = scratch.saved(cells(), f"cells{level}").where(F.col("n") > 4 * per)
        large = counts.where(F.col("low") < F.col("high"))
        by_text = large.isEmpty()
        if by_text and counts.isEmpty():
            break
        level += 1
        base = F.lit(level << 56) + F.row_number().over(Window.orderBy("_cell")) * F.lit(4 * CELLS)
        large = (counts if by_text else large).select("_cell", F.ceil(F.col("n") / per).alias("_n"), F.col("low").alias("_low"), F.col("high").alias("_high"), base.alias("_base"))
        large = scratch.saved(large, f"large{level}")
        if by_text:
            piece = F.floor((F.shiftright(F.xxhash64(text), 44) + (1 << 19)) * F.col("_n") / (1 << 20)).cast("long")
        else:
            piece = nth(id_, F.col("_low"), F.floor((exact(F.col("_high")) - exact(F.col("_low"))) / exact(F.col("_n"))) + 1)
        rows = rows.join(F.broadcast(large), "_cell", "left").withColumn("_cell", F.coalesce(F.col("_base") + piece, F.col("_cell"))).drop("_n", "_low", "_high", "_base")
    order = [F.col("low").isNull(), F.desc("high"), "_cell"]  # cells of one id follow each other by the hash
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = scratch.saved(cells(), "cells").withColumn("_p", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / per))
    runs = runs.select("_cell", F.dense_rank().over(Window.orderBy("_p")).alias("_part"))
    runs = scratch.saved(runs.withColumn("_parts", F.max("_part").over(Window.partitionBy())), "runs")
    return rows.join(F.broadcast(runs), "_cell").drop("_cell")


def neighbours(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Window]:
    """(rows, window): rows with ``_part``, dealt so that the window runs over the ids of a part downwards.

    Behind the rows of each part stands, marked by ``_head``, the text of the row that follows them: the first of the next
    part, after the last part that of the first. So only one row of each part travels to another.
    """
    dealt = ranges(docs, doc_id, text, scratch).withColumn("_tie", F.xxhash64(text))
    tops = scratch.saved(dealt.groupBy("_part").agg(F.max(doc_id).alias("_top")), "tops")
    first = dealt.join(F.broadcast(tops), "_part").where(F.col(doc_id).eqNullSafe(F.col("_top"))).groupBy("_part", "_parts").agg(F.min_by(text, "_tie").alias(text))
    before = F.when(F.col("_part") == 1, F.col("_parts")).otherwise(F.col("_part") - 1)
    heads = first.select(F.lit(None).cast("long").alias(doc_id), text, before.alias("_part"), F.lit(0).cast("long").alias("_tie"), F.lit(True).alias("_head"))
    rows = dealt.select(doc_id, text, "_part", "_tie", F.lit(False).alias("_head")).unionAll(heads)
    return rows, Window.partitionBy("_part").orderBy("_head", F.desc_nulls_last(doc_id), "_tie")


def with_edit(rows: DataFrame, text: str, following: str) -> DataFrame:
    """Adds ``_edited`` (``text``, its last half replaced by the start of ``following``), and of its grams ``_left`` and ``_right``,
    how many are the first ones of the text and of the following one, and ``_seam``, those between."""
    n = F.char_length(text).cast("int")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumns({"_a": F.substring(text, F.lit(1), n - half), "_b": F.substring(following, F.lit(1), half)})
    rows = rows.withColumns({"_edited": F.concat("_a", "_b"), "_x": spaced(F.col("_a")), "_y": spaced(F.col("_b"))})
    blank = F.substring("_a", -1, 1).rlike(r"[\x20\x09-\x0D]") | F.substring("_b", 1, 1).rlike(r"[\x20\x09-\x0D]")
    between = F.when(blank & (F.col("_x") != "") & (F.col("_y") != ""), " ").otherwise("")
    x, y = F.char_length("_x"), F.char_length("_y")
    rows = rows.withColumns({"_left": F.greatest(x - (K - 1), F.lit(0)), "_right": F.greatest(y - (K - 1), F.lit(0))})
    rows = rows.withColumn("_seam", F.concat(F.substring("_x", 1 - K, K - 1), between, F.substring("_y", 1, K - 1)))
    inside = (F.col("_left") > 0) | (F.col("_right") > 0)  # then a short seam is no text of its own
    seam = F.when(inside & (F.char_length("_seam") < K), F.array().cast("array<bigint>")).otherwise(grams_of(F.col("_seam")))
    return rows.withColumn("_seam", seam).drop("_a", "_b", "_x", "_y")


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each document.

    The edited text has the first floor(n_chars / 2) characters of the next document in place of its own last ones. A window
    knows nothing of what lies outside of it, so the edited text's windows that lie in one of the two texts have chosen the
    same grams there; those that reach over the seam are looked at here. The result is that of the edited text by itself.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scratch = Scratch(docs.sparkSession, "neighbours")  # small tables, which the result reads
    rows, w = neighbours(docs, scratch)
    rows = with_edit(rows.withColumn("_next", F.coalesce(F.lead("text").over(w), F.lit(""))), "text", "_next")
    key = ["doc_id", "_part", "_tie", "_head"]
    rows = rows.select(*key, F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "_left", "_seam", "_right", grams(F.col("text")).alias("_grams"))
    side, none = WINDOW - 1, F.array().cast("array<bigint>")  # grams of each text that share a window with the seam
    rows = rows.withColumn("_last", F.slice("_grams", F.greatest(F.col("_left") - side, F.lit(0)) + 1, F.least("_left", F.lit(side))))
    rows = with_chosen(rows.withColumn("_first", F.slice("_grams", 1, side)), "_grams", "_p").drop("_grams")
    rows = rows.withColumns({"_after": F.coalesce(F.lead("_first").over(w), none), "_pn": F.coalesce(F.lead("_p").over(w), none)})
    offset = F.col("_left") + F.size("_seam")
    middle = F.concat("_last", moved(F.col("_seam"), F.col("_left")), moved(F.slice("_after", F.lit(1), F.least("_right", F.lit(side))), offset))
    rows = with_chosen(rows.withColumn("_middle", middle), "_middle", "_m", whole=(F.col("_left") <= side) & (F.col("_right") <= side))
    left, right = chosen_first(F.col("_p"), F.col("_left") - side), moved(chosen_first(F.col("_pn"), F.col("_right") - side), offset)
    rows = rows.withColumn("_e", F.array_distinct(F.concat(left, "_m", right)))
    rows = rows.where("not _head").withColumns({"_hp": hashes(F.col("_p")), "_he": hashes(F.col("_e")), "_hn": hashes(F.col("_pn"))})
    digest = lambda c: F.concat_ws("-", F.lower(F.hex(F.xxhash64(c))), F.size(c).cast("string"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", digest("_p").alias("fingerprint"), digest("_e").alias("edited_fingerprint"),
        likeness(F.col("_hp"), F.col("_he")).alias("near_edited"), likeness(F.col("_hp"), F.col("_hn")).alias("near_next"),
    )
