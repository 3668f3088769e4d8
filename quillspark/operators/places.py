"""Nearest places and headings: a search down a pyramid of cells, places that a question names, directions that don't flicker.

``nearest`` follows cells, not places: from the coarsest level down, a person keeps the cells that could still hold the
nearest place, those whose box begins no farther away than the end of the nearest box. Each level is one equi-join of kept
cells with their at most sixteen parts, so nobody meets all places of a group, however many lie in one town.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import formats as X
from quillspark.operators.index import sent
from quillspark.operators.store import kept

#: A side of a cell is this many sides of a cell of the next level.
PARTS = 4
#: Letters of a name that questions are joined on; longer names are compared in full after that.
KEY = 8
#: Names that are shorter name nothing.
SHORTEST = 3
#: The last direction stays up to so many degrees from its middle; the next one begins at 22.5.
SLACK = 30.0


def pyramid(places: DataFrame, group: list[str], place: str, side: float) -> tuple[DataFrame, int]:
    """``level, cx, cz`` cells of each group with the box of their spots, and the number of the coarsest level.

    On level 0 every spot is its own cell's part: cells of ``side``; one place, the smallest id, stands for each spot.
    """
    spots = places.where("x is not null and z is not null").groupBy(*group, "x", "z").agg(F.min(place).alias(place))
    wide = spots.agg(F.max(F.greatest(F.abs("x"), F.abs("z"))).alias("m")).first()["m"]
    top = 0
    while wide is not None and side * PARTS**top <= wide:
        top += 1
    at = lambda c: F.floor(F.col(c) / F.lit(float(side)))
    leaves = spots.select(F.lit(-1).alias("level"), *group, at("x").alias("cx"), at("z").alias("cz"), F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("z").alias("z0"), F.col("z").alias("z1"), place)
    level = F.explode(F.sequence(F.lit(0), F.lit(top))).alias("level")
    up = leaves.drop("level").select("*", level)
    scale = F.pow(F.lit(float(PARTS)), F.col("level"))
    up = up.withColumns({"cx": F.floor(F.col("cx") / scale), "cz": F.floor(F.col("cz") / scale)})
    boxes = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.max, "x1"), (F.min, "z0"), (F.max, "z1"))]
    cells = up.groupBy("level", *group, "cx", "cz").agg(*boxes, F.lit(None).cast(places.schema[place].dataType).alias(place))
    return cells.unionByName(leaves), top


def nearest(people: DataFrame, places: DataFrame, group: list[str], person: str, place: str, side: float = 1.0) -> DataFrame:
    """``person, place, d2, dx, dz``: the nearest place of a person's group, of equally near ones that of the smallest id.

    ``people`` have the group's columns, px and pz, one row a person and group; ``places`` the group's columns, x and z.
    Rows with a null among these have no nearest place and are none. ``side`` is the finest cell's; any side gives the same rows.
    """
    cells, top = pyramid(places, group, place, side)
    cells = kept(cells, "places")
    who = people.where(" and ".join(f"{c} is not null" for c in [person, *group, "px", "pz"])).select(person, *group, "px", "pz").distinct()
    beyond = lambda a, b, p: F.greatest(F.col(a) - F.col(p), F.col(p) - F.col(b), F.lit(0))
    farther = lambda a, b, p: F.greatest(F.col(p) - F.col(a), F.col(b) - F.col(p))
    square = lambda x, z: x * x + z * z

    def narrowed(rows: DataFrame) -> DataFrame:
        low = square(beyond("x0", "x1", "px"), beyond("z0", "z1", "pz"))
        high = square(farther("x0", "x1", "px"), farther("z0", "z1", "pz"))
        w = Window.partitionBy(person, *group)
        return rows.withColumn("low", low).withColumn("most", F.min(high).over(w)).where("low <= most").drop("most")

    rows = narrowed(who.join(cells.where(F.col("level") == top).drop("level", place), group))
    for level in range(top - 1, -2, -1):
        parts = PARTS if level >= 0 else 1  # below level 0 are its spots
        outer = {"ox": F.floor(F.col("cx") / parts), "oz": F.floor(F.col("cz") / parts)}
        own = rows.select(person, *group, "px", "pz", F.col("cx").alias("ox"), F.col("cz").alias("oz"))
        rows = own.join(cells.where(F.col("level") == level).drop("level").withColumns(outer), [*group, "ox", "oz"])
        rows = rows if level < 0 else narrowed(rows)
    dx, dz = F.col("x0") - F.col("px"), F.col("z0") - F.col("pz")
    best = rows.groupBy(person, *group).agg(F.min(F.struct(square(dx, dz).alias("d2"), F.col(place), dx.alias("dx"), dz.alias("dz"))).alias("b"))
    return best.select(person, *group, "b.*")


def held_names(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """``key, name``: the distinct names, of three letters or more, that a text holds anywhere, also within words.

    Cuts of three to eight letters of a text meet the names' beginnings by an equi-join. What begins so is then cut to each length
    that a name with this beginning has, and meets the names whole: names that begin alike are not tried one after another.
    """
    whole_names = names.where(F.length("name") >= SHORTEST).select("name").distinct()
    begins = whole_names.select(F.substring("name", 1, KEY).alias("cut"), F.length("name").alias("size")).distinct()
    size = F.length(text)
    starts = texts.where(size >= SHORTEST).select(key, text, F.explode(F.sequence(F.lit(1), size - SHORTEST + 1)).alias("at"))
    cuts = starts.withColumn("n", F.explode(F.sequence(F.lit(SHORTEST), F.least(F.lit(KEY), size - F.col("at") + 1))))
    cuts = cuts.withColumn("cut", F.substring(text, F.col("at"), F.col("n")))
    # a shorter cut is the beginning of a longer name, too: only the name's own length, or the longest cut, is its key
    own = F.col("n") == F.least(F.lit(KEY), F.col("size"))
    found = cuts.join(sent(begins), "cut").where(own).select(key, F.substring(text, F.col("at"), F.col("size")).alias("name")).distinct()
    return found.join(whole_names, "name", "left_semi").select(key, "name")


def locate(people: DataFrame, places: DataFrame, person: str = "person", place: str = "place") -> DataFrame:
    """``person, kind, place, pool, mine, d2, dx, dz``: the place that each question asks for, one row a person.

    ``people``: person (unique), user, question, dimension, px, pz; ``places``: place (unique), name, owner, dimension, x, z.
    The longest name in the question comes first, wherever the place is (``named``, ``named_elsewhere``); else the places of
    owners in the question, or all, are the pool (its size is ``pool``), of which the nearest in the person's dimension is
    taken (``nearest``) or, if none is there, the first (``other_dimension``). Without any place: ``none``. Nulls name nothing
    and are near nothing; of equal names the smallest id counts.
    """
    people = people.select(person, "user", "question", "dimension", "px", "pz")
    asked = people.select(person, "user", F.lower("question").alias("q"), F.lower(F.replace("question", F.lit("'"), F.lit(""))).alias("flat"))
    by_name = places.groupBy(F.lower("name").alias("name")).agg(F.min(place).alias(place))
    longest = F.struct((-F.length("name")).alias("l"), F.col(place))
    named = held_names(asked.select(person, "q"), person, "q", by_name).join(by_name, "name").groupBy(person).agg(F.min(longest).alias("b")).select(person, F.col(f"b.{place}").alias("named"))
    named = kept(named, "named-places")

    owned = places.withColumn("holder", F.lower("owner")).where(F.length("holder") >= SHORTEST)
    sizes = owned.groupBy("holder").agg(F.count("*").alias("pool"), F.min(place).alias("first"))
    rest = asked.join(named, person, "left_anti")
    owners = held_names(rest.select(person, "flat"), person, "flat", sizes.select(F.col("holder").alias("name"))).withColumnRenamed("name", "holder")
    owners = owners.join(asked.select(person, F.lower("user").alias("self")), person).where(~F.col("holder").eqNullSafe(F.col("self"))).select(person, "holder")
    owners = kept(owners, "asked-owners")

    where = people.select(person, "dimension", "px", "pz")
    ones = nearest(where.join(owners, person), owned, ["dimension", "holder"], person, place)
    ones = ones.groupBy(person).agg(F.min(F.struct("d2", place, "dx", "dz")).alias("b")).select(person, "b.*")
    pools = owners.join(sizes, "holder").groupBy(person).agg(F.sum("pool").alias("pool"), F.min("first").alias("first"))
    others = where.join(named, person, "left_anti").join(owners, person, "left_anti")
    near = nearest(others, places, ["dimension"], person, place).drop("dimension")
    all_of = places.agg(F.count("*").alias("pool"), F.min(place).alias("first"))  # one row
    pooled = pools.unionByName(others.select(person).crossJoin(F.broadcast(all_of)))

    found = pooled.join(ones.unionByName(near), person, "left")
    kind = F.when(F.col(place).isNotNull(), "nearest").when(F.col("first").isNotNull(), "other_dimension").otherwise("none")
    found = found.select(person, kind.alias("kind"), F.coalesce(place, "first").alias(place), "pool", "d2", "dx", "dz")
    spot = places.select(place, F.lower("owner").alias("holder"), F.col("dimension").alias("there"), "x", "z")
    told = named.withColumnRenamed("named", place).join(spot, place).join(where, person)
    here = F.col("dimension").eqNullSafe(F.col("there"))
    dx, dz = F.when(here, F.col("x") - F.col("px")), F.when(here, F.col("z") - F.col("pz"))
    told = told.select(person, F.when(here, "named").otherwise("named_elsewhere").alias("kind"), place, F.lit(1).cast("long").alias("pool"), (dx * dx + dz * dz).alias("d2"), dx.alias("dx"), dz.alias("dz"))
    out = told.unionByName(found).join(spot.select(place, "holder"), place, "left").join(asked.select(person, F.lower("user").alias("self")), person)
    return out.select(person, "kind", place, "pool", F.coalesce(F.col("holder") == F.col("self"), F.lit(False)).alias("mine"), "d2", "dx", "dz")


def steady_directions(rows: DataFrame, key: str, order: list[str], dx: str = "dx", dz: str = "dz") -> DataFrame:
    """``rows`` with ``direction``: the last direction of the key stays while it is at most ``SLACK`` degrees off.

    An angle up to 15 degrees from a direction's middle has that direction, whatever came before. Any other lies between
    two, and the last one decides: between the same two as before it stays; between the next two, the shared one stays if it
    was the last. So the choice is one bit that each step keeps or flips, and running sums since the last certain row give
    it: windows in place of a fold. A row without a step has no direction, and the next one starts anew.
    """
    w = Window.partitionBy(key).orderBy(*order)
    angle = F.pmod(F.degrees(F.atan2(F.col(dx).cast("double"), -F.col(dz).cast("double"))) + 360, F.lit(360.0))
    at = angle / 45
    low = F.floor(at)
    plain = F.floor(at + 0.5)  # the direction without a past: the upper one is taken in the middle
    off = F.abs(angle - plain * 45)
    rows = rows.withColumns({"_low": F.pmod(low, F.lit(8)), "_plain": F.pmod(plain, F.lit(8)), "_between": (45 - off) <= SLACK})
    prior = lambda c: F.lag(c).over(w)
    turn = F.pmod(F.col("_low") - prior("_low"), F.lit(8))
    upper = (F.col("_plain") != F.col("_low")).cast("int")  # 1: the direction is the upper one of its two
    # what the row before can be, if it is certain: its direction, as one of this row's two
    one = F.when(prior("_plain") == F.col("_low"), 0).when(prior("_plain") == F.pmod(F.col("_low") + 1, F.lit(8)), 1)
    other = F.pmod(F.col("_low") + 1 - F.col("_plain") + F.col("_low"), F.lit(8))  # the less near of the two
    # between the next two: the shared one is the upper one before a turn by 1, the lower one before a turn by 7
    shared = F.when(turn == 1, F.col("_low")).when(turn == 7, F.pmod(F.col("_low") + 1, F.lit(8)))
    flips = F.col("_between") & prior("_between") & (shared == other)
    stays = F.col("_between") & prior("_between") & (turn == 0)
    fixed = F.when(~F.col("_between"), upper).when(prior("_between").isNull() | ~prior("_between"), F.coalesce(one, upper)).when(~(flips | stays) | (flips | stays).isNull(), upper)
    rows = rows.withColumns({"_fixed": fixed, "_flip": F.coalesce(flips, F.lit(False)).cast("int")})
    rows = rows.withColumn("_run", F.count("_fixed").over(w))
    run = Window.partitionBy(key, "_run").orderBy(*order)
    bit = F.pmod(F.first("_fixed").over(run) + F.sum("_flip").over(run) - F.first("_flip").over(run), F.lit(2))
    name = F.element_at(F.array(*map(F.lit, X.DIRECTIONS)), (F.pmod(F.col("_low") + bit, F.lit(8)) + 1).cast("int"))
    return rows.withColumn("direction", F.when(F.col("_low").isNotNull(), name)).drop("_low", "_plain", "_between", "_fixed", "_flip", "_run")
