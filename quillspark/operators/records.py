"""Operators over players' records: steps, ideas, recipes, names, vocabulary and load."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import distance, text as T


def visible_steps(progress: DataFrame, steps: DataFrame) -> DataFrame:
    """``player, step``: steps not done whose parent is done; hidden ones only with some progress.

    ``progress`` has a row (player, step, done) for each step begun; ``steps`` has (step, parent, hidden) without roots.
    Only children of done steps are looked at, so players never meet all steps.
    """
    opened = progress.where("done").select("player", F.col("step").alias("parent")).join(steps, "parent")
    own = progress.select("player", "step", F.col("done").alias("own"))
    out = opened.join(own, ["player", "step"], "left")
    return out.where(~F.coalesce("own", F.lit(False)) & (~F.col("hidden") | F.col("own").isNotNull())).select("player", "step")


def progress_ideas(done: DataFrame, keys: list[str], what: str, ideas: list[tuple], n: int = 2) -> DataFrame:
    """``keys, nth, idea``: the first ``n`` ideas (idea, after, unless) whose ``after`` is done and whose ``unless`` isn't.

    Only what an idea names is gathered per player, so the gathered sets are no larger than the list of ideas.
    """
    named = sorted({x for _, *both in ideas for x in both if x})
    sets = done.groupBy(*keys).agg(F.collect_set(F.when(F.col(what).isin(named), F.col(what))).alias("done"))
    known = F.array(*(F.struct(F.lit(i).alias("idea"), F.lit(a).cast("string").alias("after"), F.lit(u).cast("string").alias("unless")) for i, a, u in ideas))
    has = lambda x: F.array_contains(F.col("done"), x)
    fit = F.filter(known, lambda x: (x["after"].isNull() | has(x["after"])) & (x["unless"].isNull() | ~has(x["unless"])))
    out = sets.select(*keys, F.posexplode(F.slice(fit, 1, n)).alias("nth", "idea"))
    return out.select(*keys, F.col("nth").cast("long").alias("nth"), F.col("idea.idea").alias("idea"))


def recipe_cards(lines: DataFrame, recipe: str, ingredient: str, at: str, big: Column) -> DataFrame:
    """``recipe, ingredients, needs_table``: "2× A, 1× B" by first place, and whether every line is ``big``.

    Lines are counted per ingredient before anything is gathered, so a list has one entry for each kind.
    """
    kinds = lines.groupBy(recipe, ingredient).agg(F.count("*").alias("n"), F.min(at).alias("at"), F.bool_and(big).alias("big"))
    entry = F.struct("at", F.col(ingredient).alias("what"), "n")
    got = kinds.groupBy(recipe).agg(F.sort_array(F.collect_list(entry)).alias("e"), F.bool_and("big").alias("needs_table"))
    return got.select(recipe, F.array_join(F.transform("e", lambda x: F.concat(x["n"].cast("string"), F.lit("× "), x["what"])), ", ").alias("ingredients"), "needs_table")


def new_first(items: DataFrame, owner: str, carried: Column, seq: list[str]) -> DataFrame:
    """``items`` with ``place``: what an owner doesn't carry comes first, otherwise the order stays."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(carried, *seq)).cast("long"))


def people_named(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``asked, name``: names that are the asked one in any case, else those that hold it (three letters or more).

    Candidates share the asked name's rarest run of three letters: an equi-join, then the test itself.
    """
    a = asked.select("asked", F.lower("asked").alias("part")).distinct()
    n = names.select("name", F.lower("name").alias("low")).distinct()
    exact = a.join(n, F.col("part") == F.col("low")).select("asked", "name")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    held = n.where(F.length("low") >= 3).select("name", "low", F.explode(grams(F.col("low"))).alias("gram"))
    rest = a.join(exact.select("asked").distinct(), "asked", "left_anti").where(F.length("part") >= 3)
    counts = held.groupBy("gram").agg(F.count("*").alias("df"))
    rare = rest.withColumn("gram", F.explode(grams(F.col("part")))).join(counts, "gram").groupBy("asked", "part").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    return exact.unionByName(rare.join(held, "gram").where(F.contains("low", "part")).select("asked", "name"))


def known_words(words: DataFrame, known: DataFrame) -> DataFrame:
    """``word, fixed``: a word of three letters or more that isn't known becomes the first known one, by alphabet, of four
    letters or more with the same first letter and one typo between them; others stay. An equi-join on deletions."""
    w, k = words.select("word").distinct(), known.select(F.col("word").alias("known")).distinct()
    odd = w.where(F.length("word") >= 3).join(k, F.col("word") == F.col("known"), "left_anti")
    first = lambda c: F.substring(c, 1, 1).alias("first")
    left = odd.select("word", first("word"), F.explode(distance.deletions(F.col("word"), 1)).alias("cut"))
    right = k.where(F.length("known") >= 4).select("known", first("known"), F.explode(distance.deletions(F.col("known"), 1)).alias("cut"))
    fixed = left.join(right, ["first", "cut"]).where(distance.within_one(F.col("word"), F.col("known"))).groupBy("word").agg(F.min("known").alias("fixed"))
    return w.join(fixed, "word", "left").select("word", F.coalesce("fixed", "word").alias("fixed"))


def with_defaults(own: DataFrame, owner: str, key: str, value: str, defaults: dict[str, float]) -> DataFrame:
    """``owner, key, value``: each owner's settings over the defaults; unknown keys are left out, a null is no setting."""
    known = F.array(*(F.struct(F.lit(k).alias(key), F.lit(v).alias("other")) for k, v in defaults.items()))
    every = own.select(owner).distinct().select(owner, F.inline(known))
    return every.join(own.where(F.col(value).isNotNull()), [owner, key], "left").select(owner, key, F.coalesce(value, "other").alias(value))


def tick_health(ticks: DataFrame, by: str, ms: str, target: float = 20.0) -> DataFrame:
    """``by, n, mspt, tps, verdict``: ticks a second from the mean time of a tick, at most the target."""
    budget, m = 1000.0 / target, F.col("mspt")
    a = ticks.groupBy(by).agg(F.count("*").alias("n"), F.avg(ms).alias("mspt"))
    tps = F.when(m > 0, F.least(F.lit(target), 1000.0 / m)).otherwise(target)
    verdict = F.when(m < budget * 0.8, "smooth").when(m < budget, "busy").otherwise("lagging")
    return a.select(by, "n", F.round(m, 4).alias("mspt"), F.round(tps, 1).alias("tps"), verdict.alias("verdict"))


MANIFEST = "array<struct<result: string, name: string, datapack: string, type: string, imageUrl: string>>"


def recipe_rows(manifests: DataFrame, key: str, text: str, base: str) -> DataFrame:
    """``key, name, datapack, picture, crafting`` of each listed recipe that has a picture.

    The name loses its count ("× 4"); a picture's address is completed from ``base``. Text that is no list gives no rows.
    """
    root, folder = "/".join(base.split("/", 3)[:3]), base.rsplit("/", 1)[0]
    e = manifests.select(key, F.explode(F.from_json(text, MANIFEST)).alias("e")).select(key, "e.*").where(F.coalesce("imageUrl", F.lit("")) != "")
    name = F.regexp_replace(F.coalesce(F.nullif("result", F.lit("")), "name", F.lit("")), r"\s*×\s*\d+$", "")
    url = F.col("imageUrl")
    full = F.when(url.rlike("^[a-z]+://"), url).when(url.startswith("/"), F.concat(F.lit(root), url)).otherwise(F.concat(F.lit(folder + "/"), url))
    crafting = F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit("crafting"))
    return e.select(key, name.alias("name"), F.coalesce("datapack", F.lit("")).alias("datapack"), full.alias("picture"), crafting.alias("crafting"))


def with_pictures(recipes: DataFrame, rows: DataFrame) -> DataFrame:
    """``recipes`` (name) with the first picture of their name by address, null without one."""
    return recipes.join(rows.groupBy("name").agg(F.min("picture").alias("picture")), "name", "left")


def first_labels(functions: DataFrame, callers: DataFrame, key: str, order: list[str], label: str) -> DataFrame:
    """``key, label`` of the functions that something calls; the first caller's label wins."""
    first = callers.where(F.col(label).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, label)).alias("first"))
    return functions.select(key).join(first, key).select(key, F.col("first")[label].alias("label"))


def quiz_answers(events: DataFrame, player: str, order: list[str], ts: str, kind: str, asks: str, answers: str, seconds: int) -> DataFrame:
    """Answers with ``open``: whether the player's round is open, that is, what came before is a question not too long ago.

    An answer closes its round. One player's events are taken in order, so a player is in one task.
    """
    w = Window.partitionBy(player).orderBy(*order)
    e = events.where(F.col(kind).isin(asks, answers)).withColumn("before", F.lag(F.struct(F.col(kind).alias("kind"), F.col(ts).alias("ts"))).over(w))
    late = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("before.ts").cast("timestamp"))) > seconds * 1_000_000
    return e.where(F.col(kind) == answers).withColumn("open", F.coalesce((F.col("before.kind") == asks) & ~late, F.lit(False))).drop("before")


def best_of_sources(results: DataFrame, query: str, source: str, order: list, per: int, k: int) -> DataFrame:
    """``results`` with ``place``: the best ``per`` of each source, and of those the best ``k`` of a query."""
    each = results.withColumn("place", F.row_number().over(Window.partitionBy(query, source).orderBy(*order))).where(F.col("place") <= per)
    return each.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def labelled(settings: DataFrame, keys: DataFrame, values: DataFrame, percents: DataFrame) -> DataFrame:
    """``settings`` (key, value) with ``label`` and ``shown``: the labels that dialogs give a key and a value of it.

    ``keys``: (key, label), ``values``: (key, value, label), ``percents``: (key). A key without a label is written as words;
    1 and 0 also match the labels of true and false; numbers of percent keys are shown as such. Of several labels the
    smallest counts, a null value is shown as "".
    """
    names = keys.groupBy("key").agg(F.min("label").alias("key_label"))
    offered = values.groupBy("key", F.col("value").alias("as_offered")).agg(F.min("label").alias("value_label"))
    words = F.initcap(F.translate("key", "_", " "))
    as_offered = F.when(F.col("value") == "1", "true").when(F.col("value") == "0", "false").otherwise(F.col("value"))
    out = settings.withColumn("as_offered", as_offered).join(names, "key", "left").join(offered, ["key", "as_offered"], "left")
    out = out.join(percents.select("key").distinct().withColumn("percent", F.lit(True)), "key", "left")
    number = F.col("value").try_cast("double")
    percent = F.when(F.col("percent") & number.isNotNull(), F.concat(F.round(number * 100).cast("long").cast("string"), F.lit("%")))
    out = out.withColumn("shown", F.coalesce("value_label", percent, "value", F.lit(""))).withColumn("label", F.coalesce("key_label", words))
    return out.drop("as_offered", "key_label", "value_label", "percent")


def accepted_texts(sections: DataFrame, key: str, text: str) -> DataFrame:
    """``key, effect, accepted``: texts in double quotes, each with the last line before it that has none and isn't blank."""
    ls = sections.select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    quoted = F.regexp_extract_all("line", F.lit('"([^"]+)"'), F.lit(1))
    plain = F.when((F.size(quoted) == 0) & (F.trim("line") != ""), F.trim("line"))
    ls = ls.withColumn("effect", F.last(plain, True).over(Window.partitionBy(key).orderBy("at")))
    return ls.select(key, F.coalesce("effect", F.lit("")).alias("effect"), F.explode(quoted).alias("accepted"))
