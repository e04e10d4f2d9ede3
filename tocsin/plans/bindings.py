"""How the engine's concepts map onto the warehouse tables, once as DataFrames and once as SQL.

theatre = nation, region = region, daily series = order and shipment measures per nation, labelled events = days on which
a nation's order value beats every day of the two years before. Raw facts are reduced to one row per nation and day first.
"""
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from tocsin.operators import calendar, robust

RECORD_DAYS = 730
# family, domain, direction, scale, late, daily measure (fixed small dimension)
FAMILIES = [
    ("ord_n", "demand", "up", "count", False, "n"),
    ("ord_value", "demand", "both", None, False, "value"),
    ("urgent_n", "alarm", "up", "count", False, "urgent"),
    ("ship_n", "supply", "down", "count", False, "n"),
    ("ship_qty", "supply", "both", None, True, "qty"),
    ("returned_n", "alarm", "up", "count", True, "returned"),
]


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def nations(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))


def bounds(spark, sf):
    return table(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))


def order_facts(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_totalprice",
                    "o_orderpriority", "o_orderstatus")


def daily(spark, sf):
    """Orders per nation and day, zero on quiet days: nation, day, n, value, urgent."""
    c = order_facts(spark, sf).groupBy("nation", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).alias("urgent"))
    return (calendar.zero_fill(c, nations(spark, sf), ["nation"], bounds(spark, sf), ["n", "cents", "urgent"])
            .select("nation", "day", "n", (F.col("cents") / 100).alias("value"), "urgent"))


def ship_daily(spark, sf):
    """Shipments per supplier nation and day on the order calendar: nation, day, n, qty, returned."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    c = l.groupBy(F.col("s_nationkey").alias("nation"), F.to_date("l_shipdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"))
    return calendar.zero_fill(c, nations(spark, sf), ["nation"], bounds(spark, sf), ["n", "qty", "returned"])


def catalog(spark):
    return spark.createDataFrame([(f, d, r, s, late) for f, d, r, s, late, _ in FAMILIES],
                                 "family string, domain string, direction string, scale string, late boolean")


def points(spark, sf, families=None):
    """Long form of every family: series_id, family, nation, day, value."""
    want = [f for f in FAMILIES if families is None or f[0] in families]
    parts = []
    for source, marks in ((daily, ("ord", "urg")), (ship_daily, ("shi", "ret"))):
        fams = [f for f in want if f[0][:3] in marks]
        if not fams:
            continue
        # every family of one source comes out of one pass over its daily table
        rows = F.array(*[F.struct(F.lit(f[0]).alias("family"), F.col(f[-1]).cast("double").alias("value")) for f in fams])
        parts.append(source(spark, sf).select("nation", "day", F.inline(rows)))
    u = reduce(DataFrame.unionByName, parts)
    return u.select(F.concat("family", F.lit("_nation_"), "nation").alias("series_id"), "family", "nation", "day", "value")


def raw_points(spark, sf):
    """Only the days on which a nation had orders: mean price per day, with calendar holes."""
    c = order_facts(spark, sf).groupBy("nation", "day").agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    return c.select("nation", "day", (F.col("cents") / (100 * F.col("n"))).alias("value"))


def monthly(spark, sf):
    c = order_facts(spark, sf).groupBy("nation", F.trunc("day", "month").alias("month")).agg(F.count(F.lit(1)).alias("value"))
    b = bounds(spark, sf).select(F.trunc("lo", "month").alias("lo"), F.trunc("hi", "month").alias("hi"))
    return calendar.zero_fill(c, nations(spark, sf), ["nation"], b, ["value"], day="month", step="1 month")


def hits(spark, sf):
    """Labelled events: event_id, nation, day, kind, market_moving, buildup, site (the sub-theatre it also counts for, or '')."""
    w = Window.partitionBy("nation").orderBy("day")
    d = daily(spark, sf).withColumn("prev", F.max("value").over(w.rowsBetween(-RECORD_DAYS, -1))).withColumn(
        "i", F.row_number().over(w))
    dn = F.datediff("day", F.lit("1995-01-01").cast("date"))
    return d.where((F.col("i") > RECORD_DAYS) & (F.col("value") > F.col("prev"))).select(
        (dn.cast("long") * 100 + F.col("nation")).alias("event_id"), "nation", "day",
        F.element_at(F.array(*[F.lit(x) for x in ("strike", "raid", "standoff")]), (dn % 3 + 1).cast("int")).alias("kind"),
        (dn % 2).cast("int").alias("market_moving"), (dn % 5 < 2).cast("int").alias("buildup"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("s"), F.col("nation"))).otherwise("").alias("site"))


def through(spark, sf):
    return bounds(spark, sf).select(F.date_sub("hi", 20).alias("d"))


def lead(spark, sf):
    return robust.lead_z(daily(spark, sf).select("nation", "day", F.col("n").cast("double").alias("value")), ["nation"])


def forecast(spark, sf):
    """A daily probability per nation with its label: nation, day, p, base, y, lab, eid. lab is false in the aftermath of an
    event and where the 30 days ahead are not yet known."""
    from tocsin.operators import labels
    from tocsin.functions import scoring as S
    z = lead(spark, sf)
    p = z.select("nation", "day", F.round(S.sigmoid(-2.2 + 0.6 * F.col("z")), 3).alias("p"),
                 F.round(0.06 + 0.002 * F.col("nation"), 4).alias("base"))
    lab = labels.build(p.select("nation", "day"), hits(spark, sf), through(spark, sf), key="nation")
    return p.join(lab, ["nation", "day"]).select(
        "nation", "day", "p", "base", "y", "excl", "unk", (~F.col("excl") & ~F.col("unk")).alias("lab"), "eid")


# ---------------------------------------------------------------- the same, as SQL common table expressions
CTE = {
    "bounds": (["orders"], "SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders"),
    "cal": (["bounds"], "SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM bounds"),
    "nat": ([], "SELECT n_nationkey AS nation, n_regionkey AS region FROM nation"),
    "facts": ([], "SELECT c_nationkey AS nation, o_orderdate::DATE AS day, o_orderkey, o_totalprice, o_orderpriority, o_orderstatus "
                  "FROM orders JOIN customer ON o_custkey = c_custkey"),
    "daily": (["cal", "nat", "facts"], """
        SELECT k.nation, c.day, coalesce(o.n, 0)::BIGINT AS n, coalesce(o.cents, 0)::BIGINT / 100.0::DOUBLE AS value,
               coalesce(o.urgent, 0)::BIGINT AS urgent
        FROM nat k CROSS JOIN cal c LEFT JOIN (
          SELECT nation, day, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT) AS cents,
                 count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM facts GROUP BY 1, 2) o
        ON o.nation = k.nation AND o.day = c.day"""),
    "ship_daily": (["cal", "nat"], """
        SELECT k.nation, c.day, coalesce(o.n, 0)::BIGINT AS n, coalesce(o.qty, 0)::BIGINT AS qty, coalesce(o.returned, 0)::BIGINT AS returned
        FROM nat k CROSS JOIN cal c LEFT JOIN (
          SELECT s_nationkey AS nation, l_shipdate::DATE AS day, count(*) AS n, sum(l_quantity::BIGINT) AS qty,
                 count(*) FILTER (WHERE l_returnflag = 'R') AS returned
          FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) o
        ON o.nation = k.nation AND o.day = c.day"""),
    "catalog": ([], "SELECT * FROM (VALUES " + ", ".join(
        f"('{f}', '{d}', '{r}', {'NULL' if s is None else repr(s)}, {str(late).upper()})" for f, d, r, s, late, _ in FAMILIES)
        + ") t(family, domain, direction, scale, late)"),
    "points": (["daily", "ship_daily"], " UNION ALL ".join(
        f"SELECT '{f}_nation_' || nation AS series_id, '{f}' AS family, nation, day, {c}::DOUBLE AS value FROM "
        + ("daily" if f[:3] in ("ord", "urg") else "ship_daily") for f, _, _, _, _, c in FAMILIES)),
    "raw_points": (["facts"], "SELECT nation, day, sum(round(o_totalprice * 100)::BIGINT)::BIGINT / (100 * count(*))::DOUBLE AS value "
                              "FROM facts GROUP BY 1, 2"),
    "monthly": (["facts", "bounds", "nat"], """
        SELECT k.nation, c.month, coalesce(o.value, 0)::BIGINT AS value FROM nat k CROSS JOIN (
          SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH))::DATE AS month FROM bounds) c
        LEFT JOIN (SELECT nation, date_trunc('month', day)::DATE AS month, count(*) AS value FROM facts GROUP BY 1, 2) o
        ON o.nation = k.nation AND o.month = c.month"""),
    "hits": (["daily"], f"""
        SELECT dn * 100 + nation AS event_id, nation, day, ['strike', 'raid', 'standoff'][(dn % 3 + 1)::INT] AS kind,
               (dn % 2)::INT AS market_moving, (dn % 5 < 2)::INT AS buildup,
               CASE WHEN n % 2 = 0 THEN 's' || nation ELSE '' END AS site
        FROM (SELECT *, max(value) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN {RECORD_DAYS} PRECEDING AND 1 PRECEDING) AS prev,
                     row_number() OVER (PARTITION BY nation ORDER BY day) AS i, (day - DATE '1995-01-01')::BIGINT AS dn FROM daily)
        WHERE i > {RECORD_DAYS} AND value > prev"""),
    "through": (["bounds"], "SELECT hi - 20 AS d FROM bounds"),
    "lead": (["daily"], """
        SELECT nation, day, (m7 - mu) / greatest(sd, 0.25 * abs(mu), 0.5) AS z FROM (
          SELECT nation, day, avg(n) OVER (PARTITION BY nation ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m7,
                 avg(n) OVER b AS mu, stddev_pop(n) OVER b AS sd, count(n) OVER b AS c,
                 row_number() OVER (PARTITION BY nation ORDER BY day) AS i FROM daily
          WINDOW b AS (PARTITION BY nation ORDER BY day ROWS BETWEEN 180 PRECEDING AND 31 PRECEDING)) WHERE i > 180 AND c >= 90"""),
    "labels": (["daily", "hits", "through"], """
        SELECT d.nation, d.day,
               coalesce(bool_or(h.day - d.day BETWEEN 1 AND 30), FALSE)::INT AS y,
               coalesce(bool_or(d.day - h.day BETWEEN 0 AND 30), FALSE) AS excl,
               d.day > (SELECT d FROM through) - 30 AS unk,
               min(h.event_id) FILTER (WHERE h.day - d.day BETWEEN 1 AND 30) AS eid
        FROM daily d LEFT JOIN hits h ON h.nation = d.nation AND abs(h.day - d.day) <= 30 GROUP BY d.nation, d.day"""),
    "forecast": (["lead", "labels"], """
        SELECT l.nation, l.day, round(1 / (1 + exp(-least(greatest(-2.2 + 0.6 * z, -30), 30))), 3) AS p,
               round(0.06 + 0.002 * l.nation, 4) AS base, y, excl, unk, NOT excl AND NOT unk AS lab, eid
        FROM lead l JOIN labels USING (nation, day)"""),
}


def with_ctes(names, body, extra=()):
    """SQL with the named expressions (and what they need) in front; `extra` are further (name, sql) pairs."""
    out, seen = [], set()

    def need(n):
        if n in seen or n not in CTE:
            return
        seen.add(n)
        deps, sql = CTE[n]
        for d in deps:
            need(d)
        out.append((n, sql))
    for n in names:
        need(n)
    parts = [f"{n} AS MATERIALIZED ({s})" for n, s in [*out, *extra]]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
