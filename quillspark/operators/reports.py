"""Reports and lookups over structured data."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.index import sent
from quillspark.operators.store import kept

from quillspark.functions import formats as X


def price_advice(rows: DataFrame, item: str, price: str = "price", sold: str = "sold") -> DataFrame:
    """Median, range and count of sales, the cheapest listing, and what to ask: the median, or the cheapest if that undercuts by under 30 %."""
    p, s = F.col(price), F.col(sold)
    a = rows.groupBy(item).agg(
        F.count_if(s).alias("sales"), F.median(F.when(s, p)).alias("median"), F.min(F.when(s, p)).alias("low"), F.max(F.when(s, p)).alias("high"),
        F.count_if(~s).alias("listings"), F.min(F.when(~s, p)).alias("cheapest"),
    )
    m, c = F.col("median"), F.col("cheapest")
    close = (F.col("listings") > 0) & (c < m) & (c >= m * 0.7)
    return a.withColumn("suggestion", F.when(F.col("sales") > 0, F.when(close, c).otherwise(m)).otherwise(c * 0.9))


def longest_name(questions: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, name``: the longest of ``names`` that a question holds as words, or a plural of it.

    Words in a row of a question, as many as any name has, are joined to the names' forms: no question meets all names.
    """
    n = F.col("name")
    forms = names.select("name", F.explode(F.array_distinct(F.array(n, X.plural(n), F.concat(n, F.lit("es"))))).alias("form"))
    sizes = forms.agg(F.sort_array(F.collect_set(F.size(F.split("form", " "))))).first()[0]  # how many words a name can have
    if not sizes:
        return questions.select(key, F.lit("").alias("name")).limit(0)
    ws = questions.select(key, F.split(F.col(text), " ").alias("ws")).withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.size("ws") >= F.col("size"))
    at = ws.select(key, "ws", "size", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("size") + 1)).alias("at"))
    held = at.select(key, F.array_join(F.slice("ws", F.col("at"), F.col("size")), " ").alias("form"))
    found = held.join(sent(forms), "form")  # where names are few, only the best name of each question is shuffled, none of its other words
    best = found.groupBy(key).agg(F.min(F.struct((-F.length("name")).alias("l"), F.col("name"))).alias("m"))
    return best.select(key, F.col("m.name").alias("name"))


def highest_step(value: Column, steps: list[int]) -> Column:
    """The highest step reached, null below the first: an as-of lookup without a join."""
    out = F.lit(None).cast("int")
    for s in sorted(steps):
        out = F.when(value >= s, F.lit(s)).otherwise(out)
    return out


def rank_line(others: Column) -> Column:
    return F.when(others == 0, "first").when(others < 10, X.ordinal(others + 1)).otherwise(F.concat(F.format_number(others, 0), F.lit(" before")))


def streaks(rows: DataFrame, key: str, order: list[str], ok: str, current: bool = False) -> DataFrame:
    """Right answers, the best streak and, if asked for, the current one: islands between misses."""
    w = Window.partitionBy(key).orderBy(*order)
    islands = rows.withColumn("island", F.sum(F.when(F.col(ok), 0).otherwise(1)).over(w)).groupBy(key, "island").agg(F.count_if(F.col(ok)).alias("n"))
    more = [F.max_by("n", "island").alias("current")] if current else []
    return islands.groupBy(key).agg(F.max("n").alias("best"), F.sum("n").alias("good"), *more)


def trend(rows: DataFrame, key: str, order: list[str], distance: str) -> DataFrame:
    d = F.col(distance)
    change = d - F.lag(d).over(Window.partitionBy(key).orderBy(*order))
    heat = F.when(d < 5, "burning").when(d < 10, "hot").when(d < 18, "warm").when(d < 30, "cool").otherwise("cold")
    return rows.withColumn("heat", heat).withColumn("trend", F.when(change < -0.5, "warmer").when(change > 0.5, "colder").otherwise(""))


def moving_speed(rows: DataFrame, key: str, order: list[str], place: str, samples: int = 6, jump: float = 10.0) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    steps = rows.withColumn("step", F.abs(F.col(place) - F.lag(place).over(w)))
    parts = steps.withColumn("part", F.sum(F.when(F.col("step") > jump, 1).otherwise(0)).over(w))
    last = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(1 - samples, 0)
    return parts.withColumn("speed", F.coalesce(F.avg(F.when(F.col("step") <= jump, F.col("step"))).over(last), F.lit(0.0)))


def in_boxes(people: DataFrame, boxes: DataFrame, group: tuple[str, str], reach: int, cell: int = 32) -> DataFrame:
    """People (px, pz) in or within ``reach`` of boxes (x0, x1, z0, z1) of their group, with the distance to the edge."""
    at = lambda c: F.floor(c / cell).cast("int")
    span = lambda a, b: F.sequence(at(F.col(a) - reach), at(F.col(b) + reach))
    wide = boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cz", F.explode(span("z0", "z1")))
    own = people.repartition(people.sparkSession.sparkContext.defaultParallelism * 4).withColumns({"cx": at(F.col("px")), "cz": at(F.col("pz"))})
    wide = sent(wide)  # with few groups and cells a shuffle by them would leave the pairs to few tasks
    pairs = own.join(wide, (own[group[0]] == wide[group[1]]) & (own["cx"] == wide["cx"]) & (own["cz"] == wide["cz"]))
    x, z = F.col("px"), F.col("pz")
    near = pairs.where(x.between(F.col("x0") - reach, F.col("x1") + reach) & z.between(F.col("z0") - reach, F.col("z1") + reach))
    gap = F.greatest(F.lit(0), F.col("x0") - x, x - F.col("x1")) + F.greatest(F.lit(0), F.col("z0") - z, z - F.col("z1"))
    return near.withColumn("inside", x.between(F.col("x0"), F.col("x1")) & z.between(F.col("z0"), F.col("z1"))).withColumn("distance", gap)


def interests(events: DataFrame, person: str, project: str, order: list[str], kept: int = 3, recent: float = 0.5) -> DataFrame:
    """``person, project, n, lean``: the usual projects' shares, and more for the last one, up to 1."""
    n = events.groupBy(person, F.col(project).alias("project")).agg(F.count("*").alias("n"))
    share = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(person)))
    nth = F.row_number().over(Window.partitionBy(person).orderBy(F.desc("n"), F.desc("project")))
    top = share.withColumn("nth", nth).where(F.col("nth") <= kept)
    last = events.groupBy(person).agg(F.max_by(project, F.struct(*order)).alias("project")).withColumn("recent", F.lit(recent))
    out = top.join(last, [person, "project"], "left")
    return out.select(person, "project", "n", F.round(F.least(F.lit(1.0), F.col("share") + F.coalesce("recent", F.lit(0.0))), 6).alias("lean"))


def craftable(need: DataFrame, stock: DataFrame, recipe: str, item: str, needed: str, have: str) -> DataFrame:
    rows = need.join(stock, item, "left")
    return rows.groupBy(recipe).agg(F.bool_and(F.coalesce(F.col(have), F.lit(0)) >= F.col(needed)).alias("craftable"), F.count("*").alias("parts"))


def flatten_settings(df: DataFrame, json: str, keep: list) -> DataFrame:
    """A row (key, value) for each leaf of a JSON object, at any depth: the keys on the way joined by dots; lists are skipped, a null value is the text "null".

    Each pass opens one level, so there are as many passes as the deepest object has levels, each over what is left.
    """
    opened = lambda c, start: F.expr(f"transform(map_entries(from_json({c}, 'map<string,string>')), e -> struct(concat({start}, e.key) AS key, coalesce(e.value, 'null') AS value))")
    names = [f.name for f in df.select(*keep).schema.fields]
    level = df.select(*keep, F.col(json).alias("_json")).select(*names, F.inline(opened("_json", "''")))
    out = None
    while True:
        level = kept(level, "level")
        leaves = level.where(~F.col("value").startswith("{") & ~F.col("value").startswith("["))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.where(F.col("value").startswith("{"))
        if inner.isEmpty():
            return out
        level = inner.withColumn("_open", opened("value", "key || '.'")).drop("key", "value").select(*names, F.inline("_open"))


def labelled_only(settings: DataFrame, source: list[str], labels: DataFrame) -> DataFrame:
    """``settings`` with ``label`` by key (``labels``: key, label); a source that names any of its settings shows only those it names."""
    out = settings.join(labels.select("key", "label"), "key", "left")
    named = out.where("label is not null").select(*source).distinct().withColumn("_named", F.lit(True))
    return out.join(named, source, "left").where("label is not null or _named is null").drop("_named")


def family(name: Column, words: list[str]) -> Column:
    """A name without the words that only vary it; the name itself if nothing is left."""
    rest = F.trim(F.regexp_replace(name, f"(^| )({'|'.join(words)})( |$)", " "))
    return F.when(rest == "", name).otherwise(rest)
