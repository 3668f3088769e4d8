"""Queries over places: what a question names, what is nearest, and which way it is."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import formats as X
from quillspark.operators import places as P
from quillspark.plans.common import query, table

_PLACES = "s_suppkey, s_nationkey, (s_suppkey * 37 % 101)::INT AS x, (s_suppkey * 53 % 97)::INT AS z"
_PEOPLE = "pe AS (SELECT c_custkey, c_nationkey, (c_custkey * 29 % 103)::INT AS px, (c_custkey * 41 % 89)::INT AS pz FROM customer)"
_D2 = "(x - px) * (x - px) + (z - pz) * (z - pz)"
_NAMES = "['" + "', '".join(X.DIRECTIONS) + "']"
_ASKED = """CASE WHEN c_custkey % 4 = 0 THEN 'where is Supplier#' || lpad((c_custkey // 4)::VARCHAR, 9, '0')
  WHEN c_custkey % 4 = 1 THEN 'the way to nation_' || c_custkey % 30 || '''s place' ELSE c_name || ', ' || c_mktsegment END"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dimension"), (k * 37 % 101).cast("int").alias("x"), (k * 53 % 97).cast("int").alias("z"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("dimension"), (k * 29 % 103).cast("int").alias("px"), (k * 41 % 89).cast("int").alias("pz"))


@query(
    f"""WITH pl AS (SELECT {_PLACES} FROM supplier), {_PEOPLE}, d AS (SELECT c_custkey, s_suppkey, {_D2} AS d2, x - px AS dx, z - pz AS dz FROM pe JOIN pl ON c_nationkey = s_nationkey),
n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d2, s_suppkey) = 1)
SELECT c_custkey, s_suppkey, d2, {_NAMES}[(floor(((degrees(atan2(dx, -dz)) + 360) % 360) / 45 + 0.5)::INT % 8) + 1] AS direction FROM n"""
)
def nearest_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest place in the same dimension, and which way it is."""
    near = P.nearest(people(spark, sf_dir), places(spark, sf_dir), ["dimension"], "c_custkey", "s_suppkey", 4.0)
    return near.select("c_custkey", "s_suppkey", F.col("d2").cast("int").alias("d2"), X.direction(F.col("dx").cast("double"), F.col("dz").cast("double")).alias("direction"))


@query(
    f"""WITH pl AS (SELECT s.*, lower(n_name) AS owner FROM (SELECT {_PLACES}, lower(s_name) AS name FROM supplier) s JOIN nation ON n_nationkey = s_suppkey * 7 % 25),
{_PEOPLE}, a AS (SELECT c_custkey, c_nationkey, px, pz, lower({_ASKED}) AS q FROM customer JOIN pe USING (c_custkey, c_nationkey)),
nm AS (SELECT c_custkey, arg_min(s_suppkey, (-len(name), s_suppkey)) AS s_suppkey FROM a JOIN pl ON contains(q, name) GROUP BY c_custkey),
ow AS (SELECT DISTINCT c_custkey, owner FROM (SELECT * FROM a ANTI JOIN nm USING (c_custkey)) JOIN (SELECT DISTINCT owner FROM pl) ON contains(replace(q, '''', ''), owner)),
po AS (SELECT c_custkey, s_suppkey FROM ow JOIN pl USING (owner) UNION ALL SELECT c_custkey, s_suppkey FROM (SELECT c_custkey FROM a WHERE c_custkey NOT IN (SELECT c_custkey FROM nm) AND c_custkey NOT IN (SELECT c_custkey FROM ow)), pl),
al AS (SELECT c_custkey, count(*) AS pool, arg_min(s_suppkey, (CASE WHEN s_nationkey = c_nationkey THEN {_D2} ELSE 1000000000 END, s_suppkey)) AS s_suppkey, bool_or(s_nationkey = c_nationkey) AS near
  FROM po JOIN a USING (c_custkey) JOIN pl USING (s_suppkey) GROUP BY c_custkey),
o AS (SELECT c_custkey, s_suppkey, 1::BIGINT AS pool, CASE WHEN s_nationkey = c_nationkey THEN 'named' ELSE 'named_elsewhere' END AS kind FROM nm JOIN a USING (c_custkey) JOIN pl USING (s_suppkey)
  UNION ALL SELECT c_custkey, s_suppkey, pool, CASE WHEN near THEN 'nearest' ELSE 'other_dimension' END FROM al)
SELECT c_custkey, kind, s_suppkey, pool, CASE WHEN s_nationkey = c_nationkey THEN {_D2} END AS d2 FROM o JOIN a USING (c_custkey) JOIN pl USING (s_suppkey)"""
)
def located_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask for a supplier by name, for one of a nation, or for the nearest."""
    k = F.col("c_custkey")
    owners = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_name").alias("owner"))
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), (F.col("s_suppkey") * 7 % 25).alias("n")).join(owners, "n").drop("n")
    text = F.when(k % 4 == 0, F.concat(F.lit("where is Supplier#"), F.lpad(F.floor(k / 4).cast("string"), 9, "0")))
    text = text.when(k % 4 == 1, F.concat(F.lit("the way to nation_"), (k % 30).cast("string"), F.lit("'s place"))).otherwise(F.concat("c_name", F.lit(", "), "c_mktsegment"))
    asks = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("user"), text.alias("question"))
    found = P.locate(people(spark, sf_dir).join(asks, "c_custkey"), places(spark, sf_dir).join(names, "s_suppkey"), "c_custkey", "s_suppkey")
    return found.select("c_custkey", "kind", "s_suppkey", "pool", F.col("d2").cast("int").alias("d2"))


@query(
    f"""WITH RECURSIVE st AS MATERIALIZED (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, (degrees(atan2(dx::DOUBLE, -dz::DOUBLE)) + 360) % 360 AS angle
  FROM (SELECT *, event_id * 7 % 61 - 30 AS dx, -20 - event_id * 3 % 11 AS dz FROM events)),
r AS (SELECT user_id, event_id, n, floor(angle / 45 + 0.5)::INT % 8 AS d FROM st WHERE n = 1
  UNION ALL SELECT s.user_id, s.event_id, s.n, CASE WHEN abs((s.angle - 45 * r.d + 540) % 360 - 180) <= 30 THEN r.d ELSE floor(s.angle / 45 + 0.5)::INT % 8 END FROM r JOIN st s ON s.user_id = r.user_id AND s.n = r.n + 1)
SELECT user_id, event_id, {_NAMES}[d + 1] AS direction FROM r"""
)
def steady_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way to a target as people move about: the last answer stays until the bearing is clearly past it."""
    e = F.col("event_id")
    moves = table(spark, sf_dir, "events").withColumns({"dx": e * 7 % 61 - 30, "dz": -20 - e * 3 % 11})
    return P.steady_directions(moves, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "direction")
