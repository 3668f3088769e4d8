"""Nearest places, named places and directions against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions.formats import DIRECTIONS
from quillspark.operators import places as P


def brute(people, places):
    out = {}
    for person, g, px, pz in people:
        ds = [((x - px) ** 2 + (z - pz) ** 2, place) for place, h, x, z in places if None not in (x, z, px, pz) and g is not None and h == g]
        if ds:
            out[person] = min(ds)
    return out


@pytest.mark.parametrize("side", [1.0, 7.0, 1000.0])
def test_nearest_is_that_of_all_pairs(spark, side):
    r = random.Random(3)
    town = [(1000 + i, 1, 500 + r.randrange(30), -700 + r.randrange(30)) for i in range(400)]  # one town far from most people
    places = town + [(i, r.randrange(3), r.randrange(-900, 900), r.randrange(-900, 900)) for i in range(60)]
    places += [(2000, 0, 5, 5), (1999, 0, 5, 5), (2001, 2, None, 3), (2002, None, 3, 3)]
    people = [(i, r.randrange(4), r.randrange(-1000, 1000), r.randrange(-1000, 1000)) for i in range(150)]
    people += [(500, 0, 5, 5), (501, 0, None, 5), (502, None, 5, 5), (503, 1, 514, -685)]
    a = spark.createDataFrame(people, "person long, g int, px int, pz int")
    b = spark.createDataFrame(places, "place long, g int, x int, z int")
    got = {x["person"]: (x["d2"], x["place"]) for x in P.nearest(a, b, ["g"], "person", "place", side).collect()}
    assert got == brute(people, places)
    assert got[500] == (0, 1999)


def test_nearest_of_equally_near_fractions_and_nothing(spark):
    a = spark.createDataFrame([(1, 1, 0.0, 0.0), (2, 2, 0.25, -0.5)], "person long, g int, px double, pz double")
    b = spark.createDataFrame([(9, 1, 3.0, 4.0), (8, 1, -4.0, 3.0), (7, 1, 5.0, 0.0), (6, 1, 0.0, -5.0), (5, 2, 0.25, 0.125)], "place long, g int, x double, z double")
    got = {x["person"]: (x["place"], x["d2"]) for x in P.nearest(a, b, ["g"], "person", "place").collect()}
    assert got == {1: (6, 25.0), 2: (5, 0.390625)}
    assert P.nearest(a, b.limit(0), ["g"], "person", "place").count() == 0 and P.nearest(a.limit(0), b, ["g"], "person", "place").count() == 0


def test_a_far_town(spark):
    """Everyone lives far from a dense town: what is near its edge is found."""
    towns = {n: spark.range(n * n).select(F.col("id").alias("place"), F.lit(1).alias("g"), (F.col("id") % n + 4096).alias("x"), (F.floor(F.col("id") / n)).alias("z")) for n in (16, 64)}
    people = spark.range(20).select(F.col("id").alias("person"), F.lit(1).alias("g"), (F.col("id") * 3).alias("px"), (F.col("id") * 5 + 3).alias("pz"))
    for n, town in towns.items():
        got = {r["person"]: r["place"] for r in P.nearest(people, town, ["g"], "person", "place").collect()}
        assert got == {i: min(range(n), key=lambda z, i=i: ((4096 - 3 * i) ** 2 + (z - 5 * i - 3) ** 2, z)) * n for i in range(20)}


def test_held_names(spark):
    t = spark.createDataFrame([(1, "to the castle gates"), (2, "castles"), (3, ""), (4, None), (5, "the very long name of a place is here"), (6, "the very long name of a plaza")], "k long, t string")
    n = spark.createDataFrame([("castle",), ("castle gate",), ("at",), ("the very long name of a place",), (None,), ("cas",), ("les",)], "name string")
    got = sorted((r["k"], r["name"]) for r in P.held_names(t, "k", "t", n).collect())
    assert got == [(1, "cas"), (1, "castle"), (1, "castle gate"), (2, "cas"), (2, "castle"), (2, "les"), (5, "the very long name of a place")]


def test_names_that_begin_alike(spark):
    """A text that holds a beginning isn't tried with every name that begins so."""
    n = spark.range(20_000).select(F.concat(F.lit("supplier#"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("name"))
    t = spark.range(2_000).select(F.col("id").alias("k"), F.concat(F.lit("where is supplier#"), F.lpad((F.col("id") * 3).cast("string"), 6, "0"), F.lit("?")).alias("t"))
    found = P.held_names(t, "k", "t", n)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and found.count() == 2_000
    assert found.where(F.col("name") != F.concat(F.lit("supplier#"), F.lpad((F.col("k") * 3).cast("string"), 6, "0"))).isEmpty()


PLACES = [
    (1, "Castle", "ann", "over", 10, 0), (2, "Castle Gate", "Ann", "under", 0, 10), (3, "Mill", "bob", "over", 100, 100), (4, "Farm", "bob", "over", -50, 0), (5, "ab", "cy", "end", 1, 1),
    (6, None, None, "over", 2, 2),
]


def test_locate(spark):
    people = [
        (1, "eve", "where is the castle gate?", "over", 0, 0), (2, "eve", "Where is the CASTLE", "over", 0, 0), (3, "eve", "bob's waypoint", "over", 0, 0), (4, "bob", "bobs waypoint", "over", -40, 0),
        (5, "eve", "ann's", "void", 0, 0), (6, "eve", "ab", "over", 9, 0), (7, "eve", None, None, None, None), (8, None, "nearest", "end", 5, 5),
    ]
    a = spark.createDataFrame(people, "person long, user string, question string, dimension string, px int, pz int")
    b = spark.createDataFrame(PLACES, "place long, name string, owner string, dimension string, x int, z int")
    got = {r["person"]: (r["kind"], r["place"], r["pool"], r["mine"], r["d2"]) for r in P.locate(a, b).collect()}
    assert got == {
        1: ("named_elsewhere", 2, 1, False, None), 2: ("named", 1, 1, False, 100), 3: ("nearest", 4, 2, False, 2500), 4: ("nearest", 4, 6, True, 100),
        5: ("other_dimension", 1, 2, False, None), 6: ("nearest", 1, 6, False, 1), 7: ("other_dimension", 1, 6, False, None), 8: ("nearest", 5, 6, False, 32),
    }
    assert {r["kind"] for r in P.locate(a, b.limit(0)).collect()} == {"none"}


def folded(steps):
    out, last = [], None
    for dx, dz in steps:
        if dx is None or dz is None:
            last = None
        else:
            angle = (math.degrees(math.atan2(dx, -dz)) + 360) % 360
            if last is None or abs((angle - 45 * DIRECTIONS.index(last) + 180) % 360 - 180) > 30:
                last = DIRECTIONS[math.floor(angle / 45 + 0.5) % 8]
        out.append(last)
    return out


def test_steady_directions(spark):
    r = random.Random(5)
    steps, rows = {}, []
    for k in range(12):
        angle, steps[k] = r.uniform(0, 360), []
        for i in range(300):
            angle += r.gauss(0, (2, 12, 25, 60)[k % 4])
            a = math.radians(angle)
            steps[k].append((None, 1.0) if r.random() < 0.01 else (1000 * math.sin(a), -1000 * math.cos(a)))
            rows.append((k, i, *steps[k][-1]))
    df = spark.createDataFrame(rows, "k long, i long, dx double, dz double")
    got = {}
    for x in sorted(P.steady_directions(df, "k", ["i"]).collect(), key=lambda x: x["i"]):
        got.setdefault(x["k"], []).append(x["direction"])
    assert got == {k: folded(s) for k, s in steps.items()}
    plain = [DIRECTIONS[math.floor((math.degrees(math.atan2(dx, -dz)) + 360) % 360 / 45 + 0.5) % 8] for s in steps.values() for dx, dz in s if dx is not None]
    assert plain != [d for s in got.values() for d in s if d is not None], "the past makes a difference"
