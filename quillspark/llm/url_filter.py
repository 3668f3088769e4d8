"""URL filter: rules first, then the ratio of two character language models.

Rules name a host (with all its subdomains) and the start of a path; the longest that fits decides. URLs that rules
allow and block train two variable-order Markov models over normalised URLs: each order's estimate is smoothed by the
next shorter one, with a weight that follows how often the context was seen, down to equal chances. A URL without a
rule is judged by the mean over its characters of the log-likelihood difference (accepted less rejected). The cut is
calibrated on the ruled URLs, each scored by counts less one occurrence of each of its grams (further ones, of grams that
it or its copies repeat, stay): the score with the largest sum of the shares of allowed and blocked URLs that it puts right, in the middle of the gap between the two.

The alphabet is closed (``ALPHABET`` symbols), so a model has at most ALPHABET ** ORDER rows whatever the input's size;
counts cover all URLs. Scores are summed as integers, so reruns agree. Everything runs as DataFrame operations.

Null or empty URLs: host and path are empty, no rule fits, the score is 0. Very long URLs are scored over their whole
length. Equal URLs are counted once with their number, and each row gets its verdict. Without ruled URLs of both kinds
all scores and the cut are 0, and everything else is allowed. An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import saved

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

ORDER = 4
#: Letters, digits, ten signs, one for all other characters and one before the first character.
ALPHABET = 26 + 10 + 10 + 2
#: How many observations of a context weigh as much as the next shorter context.
STRENGTH = 4.0
UNIT = float(1 << 20)
BINS = 200.0
#: A model of at most so many rows (about 40 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 400_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def normalised(url: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), r"(?s)[^a-z0-9/.\-_?=&#:%]", "~")


def grams(text: Column) -> Column:
    """Each character with the ORDER - 1 before it."""
    return F.regexp_extract_all(F.concat(F.lit("^" * (ORDER - 1)), text), F.lit("(?=(.{%d}))" % ORDER), F.lit(1))


def model(counted: DataFrame) -> DataFrame:
    """From ``gram, a, r`` (occurrences in accepted and rejected URLs) to ``gram`` and three scores in 1 / UNIT.

    ``llr`` for any URL; ``llr_a`` and ``llr_r`` for an accepted and a rejected one, less one occurrence of each of its grams.
    """
    out = counted
    chance = {k: F.lit(1.0 / ALPHABET) for k in ("a", "r", "a1", "r1")}
    for k in range(1, ORDER + 1):
        gram, context = F.substring("gram", ORDER - k + 1, k), F.substring("gram", ORDER - k + 1, k - 1)
        out = out.withColumns({"_g": gram, "_c": context})
        of_gram = counted.groupBy(gram.alias("_g")).agg(F.sum("a").alias("_ga"), F.sum("r").alias("_gr"))
        of_context = counted.groupBy(context.alias("_c")).agg(F.sum("a").alias("_ca"), F.sum("r").alias("_cr"))
        out = out.join(of_gram, "_g").join(of_context, "_c")

        def smoothed(kind: str, less: int, lower: Column) -> Column:
            n, m = F.greatest(F.col(f"_g{kind}") - less, F.lit(0)), F.greatest(F.col(f"_c{kind}") - less, F.lit(0))
            return (n + STRENGTH * lower) / (m + STRENGTH)

        chance = {x: smoothed(x[0], len(x) - 1, chance[x]) for x in chance}
        out = out.withColumns({f"_p{x}": c for x, c in chance.items()}).drop("_g", "_c", "_ga", "_gr", "_ca", "_cr")
        chance = {x: F.col(f"_p{x}") for x in chance}

    def score(x: str, y: str) -> Column:
        return F.round(F.log(chance[x] / chance[y]) * UNIT).cast("long")

    return out.select("gram", score("a", "r").alias("llr"), score("a1", "r").alias("llr_a"), score("a", "r1").alias("llr_r"))


def calibrated(scored: DataFrame) -> float:
    """The cut on rows ``a, r`` (numbers of accepted and rejected URLs) with their scores ``score_a`` and ``score_r``."""
    at = lambda c: F.floor(F.col(c) * BINS).cast("int")
    bins = (
        scored.where("a > 0").select(at("score_a").alias("bin"), "a", F.lit(0).alias("r"))
        .unionAll(scored.where("r > 0").select(at("score_r").alias("bin"), F.lit(0).alias("a"), "r"))
        .groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    )
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most a few thousand bins
    right = F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(Window.partitionBy()) - F.coalesce(F.sum("a").over(below), F.lit(0)) / F.sum("a").over(Window.partitionBy())
    best = bins.withColumn("right", F.when((F.sum("a").over(Window.partitionBy()) > 0) & (F.sum("r").over(Window.partitionBy()) > 0), right))
    best = best.withColumn("last", F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin")))  # the end of the bin before
    first = best.where("right is not null").orderBy(F.desc("right"), F.abs("bin"), "bin").select("last", "bin").first()
    return (first["last"] + first["bin"]) / 2 / BINS if first else 0.0


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``host, path, rule, verdict, score, cut`` to every row; columns of these names are replaced."""
    new = ("host", "path", "rule", "verdict", "score", "cut")
    old = [F.col(c) for c in pages.columns if c not in new or c == url]
    pages = pages.select(F.struct(*old).alias("row"), F.col(url).alias("_url"))
    h, p = host(F.col("_url")), path(F.col("_url"))
    rule, verdict = ruled(h, p, rules)
    is_ = lambda v: F.sum(F.when(verdict == v, 1).otherwise(0))
    texts = saved(pages.groupBy(normalised(F.col("_url")).alias("text")).agg(is_("allow").alias("a"), is_("block").alias("r")), "urls")
    seen = texts.select("text", "a", "r", F.explode(grams(F.col("text"))).alias("gram"))
    counted = saved(seen.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")), "grams")
    weights = saved(model(counted), "model")
    weights = F.broadcast(weights) if weights.count() <= broadcast_rows else weights
    mean = lambda c: F.sum(c) / (F.count("*") * UNIT)
    scored = saved(
        seen.join(weights, "gram").groupBy("text").agg(F.first("a").alias("a"), F.first("r").alias("r"), mean("llr").alias("score"), mean("llr_a").alias("score_a"), mean("llr_r").alias("score_r")), "scored"
    )
    cut = calibrated(scored)
    out = pages.withColumns({"_text": normalised(F.col("_url")), "_host": h, "_path": p})
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    out = out.withColumns({"rule": rule, "_verdict": verdict})
    out = out.join(scored.select(F.col("text").alias("_text"), "score"), "_text", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by_model = F.when(F.col("score") >= cut, "allow").otherwise("block")
    out = out.withColumn("verdict", F.coalesce("_verdict", by_model)).withColumn("cut", F.lit(cut))
    return out.withColumnsRenamed({"_host": "host", "_path": "path"}).select("row.*", *[c for c in new if c != url])
