"""Queries on ingestion, merging, aggregation, set operations and text."""
import uuid

from pyspark.sql import Window, functions as F

from tocsin.functions import scoring as S, text as X
from tocsin.operators import windows
from tocsin.operators.lineage import shared_folder, stable
from tocsin.plans import bindings as B
from tocsin.plans.bindings import with_ctes
from tocsin.plans.registry import query
from tocsin.plans.series_queries import rnd
from tocsin.sources import feeds, series


def T(spark, sf, name):
    return B.table(spark, sf, name)


# ------------------------------------------------------------------ series sources
@query("series_line_scan", with_ctes(["raw_points"], "SELECT nation AS series_id, day, round(value, 6) AS value FROM raw_points WHERE nation % 7 <> 3 OR day(day) % 2 = 0"))
def series_line_scan(spark, sf):
    """Text lines of a series file: rows of the wrong arity are dropped."""
    p = B.raw_points(spark, sf)
    bad = (F.col("nation") % 7 == 3) & (F.dayofmonth("day") % 2 == 1)
    line = F.when(bad, F.concat_ws(",", F.col("day").cast("string"), F.lit("1"), F.lit("extra"))).otherwise(F.concat_ws(",", F.col("day").cast("string"), F.col("value").cast("string")))
    return series.parse_lines(p.select(F.col("nation").alias("series_id"), line.alias("line"))).select("series_id", "day", *rnd("value"))


@query("archive_then_live_seed", with_ctes(["daily"], """
  SELECT nation, day, value FROM (SELECT nation, day, n AS value FROM daily WHERE day < DATE '1999-01-01' UNION ALL SELECT nation, day, n + 100 FROM daily WHERE day >= DATE '1998-01-01') t
  WHERE value >= 100 OR day < DATE '1998-01-01'"""))
def archive_then_live_seed(spark, sf):
    d = B.daily(spark, sf)
    arch = d.where("day < '1999-01-01'").select("nation", "day", F.col("n").alias("value"))
    live = d.where("day >= '1998-01-01'").select("nation", "day", (F.col("n") + 100).alias("value"))
    return series.seed(arch, live, ["nation"])


@query("event_root_counts", with_ctes([], """
  SELECT c_nationkey AS country, o_orderdate::DATE AS day, o_orderpriority AS root, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
  UNION ALL SELECT c_nationkey, o_orderdate::DATE, 'all', count(*) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""))
def event_root_counts(spark, sf):
    e = B.order_facts(spark, sf).select(F.col("nation").alias("country"), "day", F.col("o_orderpriority").alias("root"))
    return feeds.root_counts(e)


CODES = ["138", "1383", "152", "154", "161", "172", "190"]
WIDE = ("we", """SELECT l_shipdate::DATE AS day, s_nationkey AS country, c_nationkey AS actor1, s_nationkey AS actor2, l_linenumber AS quad, l_quantity::DOUBLE AS gold, l_returnflag = 'R' AS armed,
  CASE l_linenumber WHEN 1 THEN '138' WHEN 2 THEN '1383' WHEN 3 THEN '152' WHEN 4 THEN '154' WHEN 5 THEN '161' WHEN 6 THEN '172' ELSE '190' END AS code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey""")
BY_PLACE = {"loc_all": "true", "loc_q3": "quad = 3", "loc_q4": "quad = 4", "loc_mil138": "code LIKE '138%'", "loc_mob": "code IN ('152', '153', '154')", "loc_coerce": "code[1:2] IN ('16', '17')"}
BY_PAIR = {"dy_all": "true", "dy_q34": "quad IN (3, 4)", "dy_force": "code LIKE '138%' OR code[1:2] IN ('15', '17')"}


def _side(counts, gold, theatre, source):
    return f"SELECT {theatre} AS theatre, day, sum(gold) AS {gold}, " + ", ".join(f"count(*) FILTER (WHERE {rule}) AS {name}" for name, rule in counts.items()) + f" FROM {source} GROUP BY 1, 2"


@query("location_and_dyad_sums", with_ctes(["nat"], "SELECT coalesce(l.theatre, d.theatre) AS theatre, coalesce(l.day, d.day) AS day, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in (*BY_PLACE, "loc_gold", *BY_PAIR, "dy_gold")) + f""" FROM
   ({_side(BY_PLACE, 'loc_gold', 'region', 'we JOIN nat ON nation = country')}) l FULL JOIN
   ({_side(BY_PAIR, 'dy_gold', 'least(actor1, actor2) % 5', 'we WHERE abs(actor1 - actor2) = 1 AND (armed OR least(actor1, actor2) % 2 = 0)')}) d ON l.theatre = d.theatre AND l.day = d.day""", [WIDE]))
def location_and_dyad_sums(spark, sf):
    l = T(spark, sf, "lineitem").join(T(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(T(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    l = l.join(T(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.to_date("l_shipdate").alias("day"), F.col("s_nationkey").alias("country"), F.col("c_nationkey").alias("actor1"), F.col("s_nationkey").alias("actor2"), F.col("l_linenumber").alias("quad"),
        F.col("l_quantity").cast("double").alias("gold"), (F.col("l_returnflag") == "R").alias("armed"), F.element_at(F.array(*[F.lit(c) for c in CODES]), F.col("l_linenumber").cast("int")).alias("code"))
    n = B.nations(spark, sf)
    places = n.select(F.col("nation").alias("country"), F.col("region").alias("theatre"))
    dyads = n.where("nation < 24").select(F.col("nation").alias("a"), (F.col("nation") + 1).alias("b"), (F.col("nation") % 5).alias("theatre"), (F.col("nation") % 2 == 1).alias("armed_only"))
    return feeds.theatre_sums(l, places, dyads)


@query("root_history_scan", with_ctes([], """
  WITH e AS (SELECT c_nationkey::VARCHAR AS country, o_orderdate::DATE AS day, o_orderpriority AS root FROM orders JOIN customer ON o_custkey = c_custkey),
  every AS (SELECT country, root, day, count(*)::DOUBLE AS n FROM (SELECT country, day, root FROM e UNION ALL SELECT country, day, 'all' FROM e) GROUP BY 1, 2, 3)
  SELECT country, root, day, CASE WHEN day < DATE '1997-01-01' THEN n ELSE n + 1000 END AS n FROM every"""))
def root_history_scan(spark, sf):
    """Counts up to 1996 are written as a compressed history and read back; live counts (told apart by 1000 more) follow its last day."""
    e = B.order_facts(spark, sf).select(F.col("nation").cast("string").alias("country"), "day", F.col("o_orderpriority").alias("root"))
    every = feeds.root_counts(e).withColumn("n", F.col("n").cast("double"))
    path = shared_folder(spark, f"root-history-{uuid.uuid4().hex}")
    feeds.write_root_history(every.where("day < '1997-01-01'"), path)
    return feeds.history_then_live(feeds.read_root_history(spark, path), every.withColumn("n", F.col("n") + 1000))


@query("jsonstat_cube_decode", with_ctes([], """
  SELECT nation, priority, status, count(*)::DOUBLE AS value FROM (SELECT c_nationkey AS nation, (substr(o_orderpriority, 1, 1)::INT - 1) AS priority, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1, 2, 3"""))
def jsonstat_cube_decode(spark, sf):
    """Order counts packed into one JSON cube per nation (priority x status), then decoded back."""
    f = B.order_facts(spark, sf).select("nation", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("p"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("s"))
    c = f.groupBy("nation", (F.col("p") * 3 + F.col("s")).alias("i")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    cube = c.groupBy("nation").agg(F.to_json(F.struct(F.array(F.lit(5), F.lit(3)).alias("size"), F.map_from_entries(F.collect_list(F.struct(F.col("i").cast("string"), "v"))).alias("value"))).alias("cube"))
    return feeds.jsonstat(cube).select("nation", F.get("pos", 0).alias("priority"), F.get("pos", 1).alias("status"), "value")


@query("json_report_days", with_ctes(["daily"], "SELECT day, sum(n)::DOUBLE AS value FROM daily GROUP BY 1"))
def json_report_days(spark, sf):
    """Monthly JSON reports (start, step, values) flattened to days and summed."""
    d = B.daily(spark, sf).groupBy("nation", F.trunc("day", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("a"))
    body = F.to_json(F.struct(F.get("a", 0)["day"].cast("string").alias("start"), F.lit(1).alias("step"), F.transform("a", lambda x: x["n"].cast("double")).alias("values")))
    return feeds.report_days(d.select(body.alias("body")))


@query("event_props_json", with_ctes([], "SELECT event_type, json_extract(props, '$.k')::INT AS k, count(*) AS n FROM events GROUP BY 1, 2"))
def event_props_json(spark, sf):
    e = T(spark, sf, "events").withColumn("p", F.from_json("props", "k INT"))
    return e.groupBy("event_type", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("fiscal_months", with_ctes([], """
  SELECT fy, fm, make_date((fy - CASE WHEN fm <= 3 THEN 1 ELSE 0 END)::INT, ((fm + 8) % 12 + 1)::INT, 1) AS month, n FROM (SELECT year(o_orderdate) AS fy, month(o_orderdate) AS fm, count(*) AS n FROM orders GROUP BY 1, 2)"""))
def fiscal_months(spark, sf):
    o = T(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("fy"), F.month("o_orderdate").alias("fm")).agg(F.count(F.lit(1)).alias("n"))
    return o.withColumn("month", feeds.fiscal_month(F.col("fy"), F.col("fm")))


@query("confident_detections", with_ctes([], """
  SELECT event_id, ts::DATE + to_minutes((hour(ts) * 60 + minute(ts))::BIGINT) AS acquired FROM events WHERE event_type NOT IN ('view') AND NOT (event_type = 'click' AND value < 30)"""))
def confident_detections(spark, sf):
    """Low-confidence rows dropped (letters or numbers), HHMM parsed to a time."""
    e = T(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "view", "l").when(F.col("event_type") == "click", F.floor("value").cast("string")).otherwise("n").alias("confidence"),
                                      F.to_date("ts").alias("acq_date"), (F.hour("ts") * 100 + F.minute("ts")).alias("acq_time"))
    return feeds.confident_detections(e).select("event_id", F.col("ts").cast("timestamp_ntz").alias("acquired"))


@query("alert_log_local_time", with_ctes([], "SELECT event_id, ts - INTERVAL 2 HOUR AS utc FROM events WHERE event_type IN ('error', 'signup')"))
def alert_log_local_time(spark, sf):
    e = T(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.col("ts").alias("local_ts"))
    return feeds.alert_log(e, categories=["error", "signup"]).select("event_id", F.col("utc").cast("timestamp_ntz").alias("utc"))


@query("rss_items", with_ctes([], "SELECT conv_id, turn, 'T' || turn AS title, role || '-' || turn AS slug FROM conversations"))
def rss_items(spark, sf):
    """Feeds of conversation turns parsed back to items."""
    c = T(spark, sf, "conversations")
    it = F.concat(F.lit("<item><title>T"), F.col("turn").cast("string"), F.lit("</title><link>https://x/y/"), "role", F.lit("-"), F.col("turn").cast("string"), F.lit("/</link></item>"))
    feed = c.groupBy("conv_id", "turn").agg(F.concat_ws("", F.collect_list(it)).alias("xml"))
    return feeds.rss_items(feed).select("conv_id", "turn", "title", "slug")


@query("html_table_parse", with_ctes([], r"""
  SELECT page_id, regexp_extract(html, '<html lang="(\w+)"', 1) AS lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="([^"]*)"', 1))::INT AS links FROM pages"""))
def html_table_parse(spark, sf):
    p = T(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", r'<html lang="(\w+)"', 1).alias("lang"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"),
                    F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("links"))


@query("xml_feed_items", with_ctes([], """
  SELECT conv_id, turn - 1 - min(turn - 1) OVER (PARTITION BY conv_id) AS pos, CASE WHEN turn % 5 <> 4 THEN role || ' & <' || turn || '>' END AS title, CASE WHEN turn % 5 <> 4 THEN trim(substr(text, 1, 20), ' ' || chr(9) || chr(10) || chr(13)) END AS description, turn % 5 = 4 AS broken
  FROM conversations"""))
def xml_feed_items(spark, sf):
    """Feeds of conversation turns through the XML parser: entities in titles, CDATA in descriptions, every fifth item not well formed."""
    c = T(spark, sf, "conversations")
    head = F.concat(F.lit("<item><title>"), "role", F.lit(" &amp; &lt;"), F.col("turn").cast("string"), F.lit("&gt;</title><description><![CDATA["), F.substring("text", 1, 20), F.lit("]]>"))
    item = F.concat(head, F.when(F.col("turn") % 5 == 4, "</item>").otherwise("</description></item>"))
    feed = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("x")))).alias("a"))
    feed = feed.select("conv_id", F.col("a")[0]["turn"].alias("first"), F.concat(F.lit("<rss><channel>"), F.concat_ws("", F.transform("a", lambda t: t["x"])), F.lit("</channel></rss>")).alias("xml"))
    x = feeds.xml_items(feed)
    return x.select("conv_id", F.col("pos").cast("long").alias("pos"), (F.col("first") + F.col("pos")).alias("turn"), "title", "description", F.col("broken").isNotNull().alias("broken")).drop("turn")


@query("page_list_cells", with_ctes([], r"""
  SELECT page_id, r - 1 AS "row", generate_subscripts(cells, 1) - 1 AS col, trim(regexp_replace(replace(regexp_replace(unnest(cells), '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM (
    SELECT page_id, r, regexp_extract_all(u, '(?s)<li>(.*?)</li>', 1) AS cells FROM (
      SELECT page_id, unnest(us) AS u, generate_subscripts(us, 1) AS r FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS us FROM pages)))"""))
def page_list_cells(spark, sf):
    """Cells of the lists of all pages, read row by row as tables are."""
    return feeds.html_cells(T(spark, sf, "pages").select("page_id", "html"), row="ul", cell="li").select("page_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "text")


@query("fixed_layout_text", with_ctes(["daily"], """
  SELECT month, dom, n, month % 5 <> 0 AS agrees FROM (SELECT (year(day) * 12 + month(day))::INT AS month, day(day)::INT AS dom, sum(n)::BIGINT AS n FROM daily GROUP BY 1, 2)"""))
def fixed_layout_text(spark, sf):
    """Monthly texts of day lines with a printed total; some totals are made to disagree."""
    d = B.daily(spark, sf).groupBy((F.year("day") * 12 + F.month("day")).alias("month"), F.dayofmonth("day").alias("dom")).agg(F.sum("n").alias("n"))
    t = d.groupBy("month").agg(F.sum("n").alias("t"), F.sort_array(F.collect_list(F.concat_ws(" ", "dom", "n"))).alias("l"))
    t = t.select("month", F.concat(F.concat_ws("\n", "l"), F.lit("\ntotal "), (F.col("t") + F.when(F.col("month") % 5 == 0, 1).otherwise(0)).cast("string")).alias("text"))
    return feeds.fixed_layout(t).select("month", "dom", "n", "agrees")


@query("trade_units", with_ctes([], """
  SELECT partner, month, sum(u)::BIGINT AS units FROM (SELECT partner, month, h, coalesce(sum(q) FILTER (WHERE k % 2 = 0), sum(q) FILTER (WHERE k % 2 = 1)) AS u FROM (
    SELECT s_nationkey AS partner, date_trunc('month', l_shipdate)::DATE AS month, l_quantity::BIGINT AS q, l_partkey % 10 AS h, l_linenumber AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY 1, 2, 3) GROUP BY 1, 2"""))
def trade_units(spark, sf):
    l = T(spark, sf, "lineitem").join(T(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    code = F.concat(F.lit("870"), (F.col("l_partkey") % 10).cast("string"), F.when(F.col("l_linenumber") % 2 == 1, "10").otherwise(""))
    return feeds.trade_units(l.select(F.col("s_nationkey").alias("partner"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), code.alias("code"), F.col("l_quantity").cast("long").alias("units")))


@query("forecast_vintages", with_ctes([], """
  SELECT user_id, value, known FROM (SELECT user_id, value, (date_trunc('month', ts) + INTERVAL 1 MONTH)::DATE AS known, row_number() OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY event_id % 3 DESC, event_id DESC) AS r FROM events) WHERE r = 1"""))
def forecast_vintages(spark, sf):
    e = T(spark, sf, "events").select("user_id", F.to_date(F.date_trunc("month", "ts")).alias("month"), (F.col("event_id") % 3).alias("generation"), F.col("event_id").alias("t"), "value")
    return series.vintages(e, ["user_id"]).select("user_id", "value", "known")


@query("shard_merge", with_ctes(["daily"], "SELECT nation, day, CASE WHEN day(day) = 1 THEN n + 1000 ELSE n END AS n FROM daily"))
def shard_merge(spark, sf):
    d = B.daily(spark, sf).select("nation", "day", "n")
    return series.merge_shards(d, d.where(F.dayofmonth("day") == 1).withColumn("n", F.col("n") + 1000))


@query("merge_missing_rows", with_ctes(["daily"], """
  SELECT nation, day, n FROM daily WHERE day <= DATE '2000-12-31'"""))
def merge_missing_rows(spark, sf):
    d = B.daily(spark, sf).select("nation", "day", "n").where("day <= '2000-12-31'")
    have = d.where((F.dayofmonth("day") % 3 != 0) | (F.col("day") == "2000-12-31"))
    return series.merge_missing(have, B.daily(spark, sf).select("nation", "day", "n"), ["nation", "day"])


@query("restated_window", with_ctes(["daily"], "SELECT nation, day, CASE WHEN day >= DATE '2001-07-01' THEN n + urgent ELSE n END AS n FROM daily"))
def restated_window(spark, sf):
    d = B.daily(spark, sf)
    return series.restate(d.select("nation", "day", "n"), d.select("nation", "day", (F.col("n") + F.col("urgent")).alias("n")), F.lit("2001-07-31").cast("date"), 30, ["nation"])


@query("keyed_archive_fold", with_ctes([], "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1"))
def keyed_archive_fold(spark, sf):
    """Keep what a feed later drops: the latest version per key over archive and feed."""
    e = T(spark, sf, "events").select("user_id", "event_type", "value", F.col("event_id").alias("priority"))
    return series.upsert([e.where("priority % 2 = 0"), e.where("priority % 2 = 1")], ["user_id"])


@query("missing_days_plan", with_ctes(["facts", "bounds", "cal"], "SELECT c.day, count(DISTINCT f.nation) AS have, 25 AS want FROM cal c LEFT JOIN facts f USING (day) GROUP BY 1 HAVING count(DISTINCT f.nation) < 25"))
def missing_days_plan(spark, sf):
    have = B.order_facts(spark, sf).select(F.col("nation").alias("series_id"), "day")
    return series.missing_days(have, B.nations(spark, sf).select(F.col("nation").alias("series_id")), B.bounds(spark, sf))


@query("newest_missing_days", with_ctes(["facts", "bounds", "cal"], """
  SELECT c.day, count(DISTINCT f.nation) AS have, 25 AS want FROM cal c LEFT JOIN facts f USING (day) GROUP BY 1 HAVING count(DISTINCT f.nation) < 25 ORDER BY c.day DESC LIMIT 30"""))
def newest_missing_days(spark, sf):
    """What one run fetches: the 30 latest days that any nation lacks."""
    have = B.order_facts(spark, sf).select(F.col("nation").alias("series_id"), "day")
    return series.missing_days(have, B.nations(spark, sf).select(F.col("nation").alias("series_id")), B.bounds(spark, sf), newest=30)


@query("change_log_daily_counts", with_ctes(["daily"], "SELECT day, sum(urgent)::BIGINT AS n FROM daily GROUP BY 1"))
def change_log_daily_counts(spark, sf):
    """Zero-filled daily counts of dated changes."""
    f = B.order_facts(spark, sf).where("o_orderpriority = '1-URGENT'").groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    cal = B.bounds(spark, sf).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return cal.join(f, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


@query("market_odds_change", with_ctes([], """
  SELECT user_id % 10 AS theatre, day, round(avg(lo1 - lo8), 6) AS change FROM (
    SELECT user_id, day, lag(lo, 1) OVER w AS lo1, lag(lo, 8) OVER w AS lo8 FROM (SELECT user_id, day, ln(q / (1 - q)) AS lo FROM (
      SELECT g.user_id, g.day, CASE WHEN g.day - last_value(e.day IGNORE NULLS) OVER x <= 3 THEN last_value(v IGNORE NULLS) OVER x END AS q FROM (
        SELECT user_id, unnest(generate_series(min(ts::DATE), max(ts::DATE), INTERVAL 1 DAY))::DATE AS day FROM events GROUP BY 1) g LEFT JOIN (
        SELECT user_id, ts::DATE AS day, 0.01 + arg_max(value, event_id) / 1000 AS v FROM events GROUP BY 1, 2) e ON e.user_id = g.user_id AND e.day = g.day
      WINDOW x AS (PARTITION BY g.user_id ORDER BY g.day ROWS UNBOUNDED PRECEDING))) WINDOW w AS (PARTITION BY user_id ORDER BY day)) WHERE lo1 IS NOT NULL AND lo8 IS NOT NULL GROUP BY 1, 2"""))
def market_odds_change(spark, sf):
    """Last value per entity-day carried three days, weekly log-odds change ending the day before, averaged per theatre."""
    from tocsin.operators import calendar
    e = T(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg((0.01 + F.max_by("value", "event_id") / 1000).alias("value"))
    f = calendar.fill(e, ["user_id"], max_carry=3).withColumn("lo", F.log(F.col("value") / (1 - F.col("value"))))
    w = Window.partitionBy("user_id").orderBy("day")
    f = f.withColumn("c", F.lag("lo", 1).over(w) - F.lag("lo", 8).over(w)).where("c is not null")
    return f.groupBy((F.col("user_id") % 10).alias("theatre"), "day").agg(F.round(F.avg("c"), 6).alias("change"))


@query("all_or_nothing_sum", with_ctes(["daily", "nat"], """
  SELECT region, day, sum(n)::BIGINT AS value FROM daily JOIN nat USING (nation) WHERE region <> 3 GROUP BY 1, 2"""))
def all_or_nothing_sum(spark, sf):
    m = B.daily(spark, sf).join(B.nations(spark, sf), "nation").select("region", "day", F.col("n").alias("value"), (F.col("nation") == 13).alias("refused"))
    return series.all_or_nothing(m, ["region"])


@query("hazard_notices", with_ctes([], """
  SELECT day, id, priority FROM (SELECT *, min(priority) OVER (PARTITION BY day) AS best FROM (SELECT o_orderdate::DATE AS day, o_orderkey AS id, 1 AS priority FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT o_orderdate::DATE, o_orderkey, 2 FROM orders WHERE o_orderpriority = '2-HIGH')) WHERE priority = best"""))
def hazard_notices(spark, sf):
    o = T(spark, sf, "orders")
    f = [(i, o.where(F.col("o_orderpriority") == p).select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))) for i, p in ((1, "1-URGENT"), (2, "2-HIGH"))]
    return feeds.notices(f).select("day", "id", "priority")


@query("bulletin_first_of_day", with_ctes([], """
  SELECT ts::DATE AS day, arg_min(event_id, ts) AS bulletin_id, arg_min(round(value), ts) AS value FROM events WHERE event_type IN ('error', 'view') GROUP BY 1"""))
def bulletin_first_of_day(spark, sf):
    e = T(spark, sf, "events")
    n = F.round("value").cast("long").cast("string")
    txt = F.when(F.col("event_type") == "error", F.concat(F.lit("total of "), n, F.lit(" craft"))).when(F.col("event_type") == "view", F.concat(F.lit("sorties: "), n)).otherwise("no figures")
    return feeds.bulletin_numbers(e.select(F.col("event_id").alias("bulletin_id"), "ts", txt.alias("text")), [r"total of (\d+)", r"sorties: (\d+)"])


@query("annual_and_candidate_release", with_ctes([], "SELECT o_orderkey AS id, o_orderdate::DATE AS day FROM orders"))
def annual_and_candidate_release(spark, sf):
    o = T(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return series.annual_then_candidates(o.where("day <= '2000-12-31'"), o.where("day >= '2000-06-01'"))


@query("intersection_days_sum", with_ctes(["facts", "nat"], """
  SELECT region, day, sum(v)::BIGINT AS value FROM (SELECT region, day, f.nation, count(*) AS v FROM facts f JOIN nat USING (nation) GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) = 5"""))
def intersection_days_sum(spark, sf):
    m = B.order_facts(spark, sf).join(B.nations(spark, sf), "nation").groupBy("region", "day", F.col("nation").alias("series_id")).agg(F.count(F.lit(1)).alias("value"))
    return series.intersect_sum(m, 5, ["region"])


@query("staleness", with_ctes([], """
  SELECT user_id, age_h, round(age_h / 72.0, 6) AS ratio, age_h / 72.0 > 1 AS stale FROM (SELECT user_id, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-02-01 00:00:00') // 3600 AS age_h FROM events GROUP BY 1)"""))
def staleness(spark, sf):
    e = T(spark, sf, "events").groupBy("user_id").agg(F.max(F.date_trunc("second", "ts")).cast("timestamp_ntz").alias("newest")).withColumn("kind", F.lit("daily"))
    s = series.stale(e, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), {"daily": 72, "monthly": 840})
    return s.select("user_id", "age_h", *rnd("ratio"), "stale")


# ------------------------------------------------------------------ aggregation
@query("daily_snapshot_mean", with_ctes([], "SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS value FROM events GROUP BY 1, 2"))
def daily_snapshot_mean(spark, sf):
    return T(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value"))


@query("summed_series", with_ctes(["daily", "nat"], "SELECT region, day, sum(n)::BIGINT AS n FROM daily JOIN nat USING (nation) GROUP BY 1, 2"))
def summed_series(spark, sf):
    return B.daily(spark, sf).join(B.nations(spark, sf), "nation").groupBy("region", "day").agg(F.sum("n").alias("n"))


@query("conditional_counts", with_ctes([], """
  SELECT l_shipdate::DATE AS day, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, sum(CASE WHEN l_tax = 0 THEN l_quantity ELSE 0 END) AS untaxed_qty FROM lineitem GROUP BY 1"""))
def conditional_counts(spark, sf):
    return T(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.sum(F.when(F.col("l_tax") == 0, F.col("l_quantity")).otherwise(0)).alias("untaxed_qty"))


@query("share_with_least_denominator", with_ctes([], "SELECT user_id, ts::DATE AS day, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(1000.0 * count(*) FILTER (WHERE event_type = 'error') / count(*), 6) END AS per_mille FROM events GROUP BY 1, 2"))
def share_with_least_denominator(spark, sf):
    g = T(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    return g.select("user_id", "day", "n", F.when(F.col("n") >= 3, F.round(1000.0 * F.col("k") / F.col("n"), 6)).alias("per_mille"))


@query("quality_share_by_box", with_ctes([], """
  SELECT user_id % 20 AS box, ts::DATE AS day, round(avg(value) FILTER (WHERE event_id % 10 < 8), 6) AS good_mean, round(avg((event_id % 10 < 8)::INT), 6) AS good_share FROM events GROUP BY 1, 2"""))
def quality_share_by_box(spark, sf):
    good = F.col("event_id") % 10 < 8
    return T(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("box"), F.to_date("ts").alias("day")).agg(
        F.round(F.avg(F.when(good, F.col("value"))), 6).alias("good_mean"), F.round(F.avg(good.cast("int")), 6).alias("good_share"))


@query("median_and_mad", with_ctes(["daily"], """
  SELECT nation, round(max(med), 6) AS med, round(median(abs(value - med)), 6) AS mad, round(avg(abs(value - med)), 4) AS mean_ad FROM (SELECT *, median(value) OVER (PARTITION BY nation) AS med FROM daily) GROUP BY 1"""))
def median_and_mad(spark, sf):
    d = B.daily(spark, sf).groupBy("nation").agg(F.collect_list("value").alias("a"))     # one value per calendar day
    d = d.select("nation", F.inline(F.array(S.spread(F.col("a")))))
    return d.select("nation", F.round("base_med", 6).alias("med"), *rnd("mad"), F.round("mean_ad", 4).alias("mean_ad"))


@query("bit_masks", with_ctes([], """
  SELECT o_custkey, bit_or((1 << (year(o_orderdate) - 1995)::INT)::INT) AS years, bit_count(bit_or((1 << (month(o_orderdate) - 1)::INT)::INT))::INT AS months FROM orders GROUP BY 1"""))
def bit_masks(spark, sf):
    return T(spark, sf, "orders").groupBy("o_custkey").agg(F.expr("bit_or(shiftleft(1, year(o_orderdate) - 1995))").alias("years"), F.expr("bit_count(bit_or(shiftleft(1, month(o_orderdate) - 1)))").alias("months"))


@query("any_event_probability", with_ctes([], "SELECT o_custkey, round(1 - product(1 - (o_orderkey % 50) / 100.0), 6) AS p_any FROM orders GROUP BY 1"))
def any_event_probability(spark, sf):
    return T(spark, sf, "orders").groupBy("o_custkey").agg(F.round(1 - F.product(1 - (F.col("o_orderkey") % 50) / 100), 6).alias("p_any"))


@query("most_frequent_value", with_ctes([], "SELECT user_id, min(event_type) AS event_type FROM (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY count(*) DESC) AS r FROM events GROUP BY 1, 2) WHERE r = 1 GROUP BY 1"))
def most_frequent_value(spark, sf):
    return T(spark, sf, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("event_type"))


@query("daily_correlation", with_ctes(["daily"], "SELECT nation, round(corr(n, value), 6) AS r FROM daily GROUP BY 1"))
def daily_correlation(spark, sf):
    return B.daily(spark, sf).groupBy("nation").agg(F.round(S.pearson("n", "value"), 6).alias("r"))


@query("notice_counts", with_ctes([], "SELECT c_nationkey AS nation, count(DISTINCT o_orderkey) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND (o_orderpriority LIKE '1%' OR o_totalprice > 400000) GROUP BY 1"))
def notice_counts(spark, sf):
    """Notices with repeats dropped by id, cancelled ones left out, kept by code or text rule."""
    o = B.order_facts(spark, sf).dropDuplicates(["o_orderkey"]).where("o_orderstatus <> 'F'").where(F.col("o_orderpriority").startswith("1") | (F.col("o_totalprice") > 400000))
    return o.groupBy("nation").agg(F.count(F.lit(1)).alias("n"))


@query("list_membership_score", with_ctes([], """
  SELECT c_nationkey AS nation, date_trunc('month', o_orderdate)::DATE AS month, 2 * max((o_orderpriority = '1-URGENT')::INT) + max((o_orderpriority = '2-HIGH')::INT) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""))
def list_membership_score(spark, sf):
    return B.order_facts(spark, sf).groupBy("nation", F.trunc("day", "month").alias("month")).agg(
        (2 * F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")) + F.max((F.col("o_orderpriority") == "2-HIGH").cast("int"))).alias("score"))


@query("title_dedupe", with_ctes([], "SELECT left(text, 60) AS prefix, min(doc_id) AS doc_id FROM documents GROUP BY 1"))
def title_dedupe(spark, sf):
    return T(spark, sf, "documents").groupBy(F.left("text", F.lit(60)).alias("prefix")).agg(F.min("doc_id").alias("doc_id"))


@query("monthly_zero_fill", with_ctes(["monthly"], "SELECT nation, month, value FROM monthly"))
def monthly_zero_fill(spark, sf):
    return B.monthly(spark, sf)


@query("last_forty_points", with_ctes(["daily"], "SELECT nation, array_to_string(list(n ORDER BY day), ',') AS points FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY day DESC) AS r FROM daily) WHERE r <= 40 GROUP BY 1"))
def last_forty_points(spark, sf):
    r = F.row_number().over(Window.partitionBy("nation").orderBy(F.desc("day")))
    d = B.daily(spark, sf).withColumn("r", r).where("r <= 40").groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("day", "n"))).alias("a"))
    return d.select("nation", F.concat_ws(",", F.transform("a", lambda x: x["n"].cast("string"))).alias("points"))


@query("recent_snapshots", with_ctes([], "SELECT event_type, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS last FROM events) WHERE ts >= last - INTERVAL 48 HOUR"))
def recent_snapshots(spark, sf):
    """Each series' last 48 hours, measured from its own newest stamp."""
    e = T(spark, sf, "events")
    last = e.groupBy("event_type").agg(F.max("ts").alias("last"))       # a small table; the facts are not shuffled by type
    return e.join(last, "event_type").where(F.col("ts") >= F.col("last") - F.expr("interval 48 hours")).select("event_type", "event_id")


@query("source_health", with_ctes([], "SELECT CASE WHEN event_type = 'error' THEN 'failing' WHEN value < 1 THEN 'stale' ELSE 'ok' END AS status, count(*) AS n, count(DISTINCT user_id) AS sources, max(ts)::DATE AS newest FROM events GROUP BY 1"))
def source_health(spark, sf):
    st = F.when(F.col("event_type") == "error", "failing").when(F.col("value") < 1, "stale").otherwise("ok")
    return T(spark, sf, "events").groupBy(st.alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("sources"), F.to_date(F.max("ts")).alias("newest"))


@query("failing_sources", with_ctes([], r"""
  SELECT source, string_agg(why, ' ' ORDER BY first, why) AS why, min(first) AS first, sum(n)::BIGINT AS n_reports FROM (
    SELECT source, why, min(t) AS first, count(*) AS n FROM (
      SELECT event_id AS t, CASE WHEN event_id % 11 = 0 THEN '' WHEN user_id % 50 IN (3, 48, 49) THEN 'feed 3' ELSE 'feed ' || (user_id % 50) END AS source,
             'Answered ' || (400 + event_id % 7) || CASE WHEN event_id % 7 = 6 THEN '!' ELSE '.' END AS why
      FROM events WHERE event_type = 'error' AND event_id % 13 <> 0) GROUP BY 1, 2) GROUP BY source, CASE WHEN source = '' THEN why END"""))
def failing_sources(spark, sf):
    """Problems of a run merged by source; two feeds are other names of a third, some texts name none, some are null."""
    e = T(spark, sf, "events").where(F.col("event_type") == "error")
    said = F.concat(F.lit("answered   "), (400 + F.col("event_id") % 7).cast("string"), F.when(F.col("event_id") % 7 == 6, "!").otherwise("\n"))
    text = F.when(F.col("event_id") % 11 == 0, said).otherwise(F.concat(F.lit("feed "), (F.col("user_id") % 50).cast("string"), F.lit(": "), said))
    errors = e.select(F.col("event_id").alias("at"), F.when(F.col("event_id") % 13 != 0, text).alias("text"))
    return feeds.failing_sources(errors, {"feed 48": "feed 3", "feed 49": "feed 3"})


# ------------------------------------------------------------------ filters, set operations, feeds
@query("address_block_lookup", with_ctes([], "SELECT user_id, event_id, CASE WHEN event_id * 131 % 65536 BETWEEN 4096 AND 16383 THEN 'AA' WHEN event_id * 131 % 65536 BETWEEN 16384 AND 40959 THEN 'BB' END AS country FROM events"))
def address_block_lookup(spark, sf):
    """Hex addresses looked up in numeric blocks."""
    blocks = spark.createDataFrame([("AA", 4096, 16383), ("BB", 16384, 40959)], "country string, lo long, hi long")
    e = T(spark, sf, "events").select("user_id", "event_id", F.conv(F.hex(F.col("event_id") * 131 % 65536), 16, 10).cast("long").alias("_a"))
    return e.join(F.broadcast(blocks), F.col("_a").between(F.col("lo"), F.col("hi")), "left").select("user_id", "event_id", "country")


@query("role_flags", with_ctes([], "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY') THEN 'lift' WHEN p_type IN ('SMALL', 'LARGE') THEN 'tanker' ELSE 'other' END AS role, p_type IN ('ECONOMY', 'SMALL') AS mil FROM part"))
def role_flags(spark, sf):
    t = F.col("p_type")
    return T(spark, sf, "part").select("p_partkey", F.when(t.isin("ECONOMY"), "lift").when(t.isin("SMALL", "LARGE"), "tanker").otherwise("other").alias("role"), t.isin("ECONOMY", "SMALL").alias("mil"))


@query("direction_and_clip", with_ctes([], "SELECT event_id, round(least(greatest(CASE event_type WHEN 'error' THEN z WHEN 'view' THEN -z ELSE abs(z) END, 0), 5), 6) AS evidence, round(1 / (1 + exp(-least(greatest(z, -30), 30))), 6) AS p, round(ln(1 + value), 6) AS l FROM (SELECT *, (value - 50) / 20 AS z FROM events)"))
def direction_and_clip(spark, sf):
    e = T(spark, sf, "events").withColumn("z", (F.col("value") - 50) / 20)
    d = F.when(F.col("event_type") == "error", "up").when(F.col("event_type") == "view", "down").otherwise("both")
    return e.select("event_id", F.round(S.one_sided(F.col("z"), d, 5.0), 6).alias("evidence"), F.round(S.sigmoid(F.col("z")), 6).alias("p"), F.round(F.log1p("value"), 6).alias("l"))


@query("headline_numbers", with_ctes([], "SELECT event_id, CASE WHEN floor(value + 0.5) = 50 AND value < 50 THEN 49 ELSE floor(value + 0.5) END::INT AS shown FROM events"))
def headline_numbers(spark, sf):
    return T(spark, sf, "events").select("event_id", X.headline_number(F.col("value")).alias("shown"))


@query("emergency_codes", with_ctes([], "SELECT event_id, m.meaning FROM events JOIN (VALUES (7500, 'unlawful interference'), (7600, 'radio failure'), (7700, 'emergency')) m(code, meaning) ON event_id % 50 * 100 + 5000 = m.code"))
def emergency_codes(spark, sf):
    m = spark.createDataFrame([(7500, "unlawful interference"), (7600, "radio failure"), (7700, "emergency")], "code long, meaning string")
    return T(spark, sf, "events").withColumn("code", F.col("event_id") % 50 * 100 + 5000).join(F.broadcast(m), "code").select("event_id", "meaning")


@query("news_feed", with_ctes(["hits"], """
  SELECT kind, id, day FROM (SELECT DISTINCT 'event' AS kind, event_id AS id, day FROM hits UNION SELECT 'order', o_orderkey, o_orderdate::DATE FROM orders WHERE o_totalprice > 480000) WHERE day > (SELECT max(o_orderdate)::DATE FROM orders) - 30"""))
def news_feed(spark, sf):
    """Several item kinds in one feed: repeats dropped, last thirty days."""
    a = B.hits(spark, sf).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "day")
    b = T(spark, sf, "orders").where("o_totalprice > 480000").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"))
    return a.unionByName(b).dropDuplicates(["kind", "id"]).where(
        F.col("day") > F.date_sub(B.bounds(spark, sf).select("hi").scalar(), 30)).orderBy(F.desc("day"))


@query("family_union_fired", with_ctes(["daily", "ship_daily"], "SELECT nation, day, bool_or(f) AS fired, max(s) AS score FROM (SELECT nation, day, n >= 3 AS f, n AS s FROM daily UNION ALL SELECT nation, day, n >= 6, n FROM ship_daily) GROUP BY 1, 2"))
def family_union_fired(spark, sf):
    a = B.daily(spark, sf).select("nation", "day", (F.col("n") >= 3).alias("f"), F.col("n").alias("s"))
    b = B.ship_daily(spark, sf).select("nation", "day", (F.col("n") >= 6).alias("f"), F.col("n").alias("s"))
    return a.unionByName(b).groupBy("nation", "day").agg(F.bool_or("f").alias("fired"), F.max("s").alias("score"))


@query("candidates_not_listed", with_ctes(["daily", "hits"], "SELECT nation, day FROM daily d WHERE n >= 3 AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.nation = d.nation AND abs(h.day - d.day) <= 3)"))
def candidates_not_listed(spark, sf):
    near = B.hits(spark, sf).select("nation", F.explode(F.sequence(F.date_sub("day", 3), F.date_add("day", 3))).alias("day"))
    return B.daily(spark, sf).where("n >= 3").select("nation", "day").join(near, ["nation", "day"], "left_anti")


@query("covered_days", with_ctes(["facts", "nat"], """
  SELECT c.region, c.day FROM (SELECT region, day, count(DISTINCT nation) AS k FROM facts JOIN nat USING (nation) GROUP BY 1, 2) c
  JOIN (SELECT region, count(*) AS k FROM nat GROUP BY 1) a ON a.region = c.region AND a.k = c.k"""))
def covered_days(spark, sf):
    """Days on which every nation of a region has an order."""
    n = B.nations(spark, sf)
    d = B.order_facts(spark, sf).select("nation", "day").distinct().join(n, "nation").groupBy("region", "day").agg(F.count(F.lit(1)).alias("_n"))
    return d.join(n.groupBy("region").agg(F.count(F.lit(1)).alias("_all")), "region").where(F.col("_n") == F.col("_all")).select("region", "day")


@query("event_ids_in_span", with_ctes(["hits"], "SELECT event_id, day FROM hits WHERE day BETWEEN (SELECT min(o_orderdate)::DATE FROM orders) + 1096 AND (SELECT max(o_orderdate)::DATE FROM orders) - 32 ORDER BY day DESC, event_id DESC LIMIT 24"))
def event_ids_in_span(spark, sf):
    """Newest two dozen events inside the covered span, which starts three years in and ends a month before the newest day (the length
    is the report's)."""
    b = B.bounds(spark, sf)
    inside = F.col("day").between(F.date_add(b.select("lo").scalar(), 1096), F.date_sub(b.select("hi").scalar(), 32))
    return B.hits(spark, sf).where(inside).select("event_id", "day").orderBy(F.desc("day"), F.desc("event_id")).limit(24)


@query("round_robin_headlines", with_ctes([], "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS turn FROM events) ORDER BY turn, event_type LIMIT 40"))
def round_robin_headlines(spark, sf):
    """At most forty rows taken in turn from each group (the cap is the feature): only each group's first forty can be taken."""
    e = T(spark, sf, "events").withColumn("o", F.struct("ts", "event_id"))
    return windows.round_robin(e.select("event_type", "event_id", "o"), "event_type", ["o"], 40).select("event_type", "event_id")


@query("weekly_digest_changes", with_ctes([], """
  SELECT user_id, week, digest FROM (SELECT *, lag(digest) OVER (PARTITION BY user_id ORDER BY week) AS prev FROM (SELECT user_id, date_trunc('week', ts)::DATE AS week, arg_min(event_type, ts) AS digest FROM events GROUP BY 1, 2)) WHERE prev IS NULL OR prev <> digest"""))
def weekly_digest_changes(spark, sf):
    e = T(spark, sf, "events").select("user_id", "ts", F.col("event_type").alias("digest"))
    return windows.weekly_first(e, ["user_id"]).select("user_id", "week", "digest")


# ------------------------------------------------------------------ text
TAGS = [("alpha", "(?i)thin"), ("beta", "(?i)ou"), ("gamma", "(?i)que")]


@query("first_pattern_tags", with_ctes([], "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)thin') THEN 'alpha' WHEN regexp_matches(text, '(?i)ou') THEN 'beta' WHEN regexp_matches(text, '(?i)que') THEN 'gamma' END AS tag FROM documents"))
def first_pattern_tags(spark, sf):
    return T(spark, sf, "documents").select("doc_id", X.first_tag(F.col("text"), TAGS).alias("tag"))


@query("keyword_filter", with_ctes([], "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-z])(the|and)([^a-z]|$)') AND NOT regexp_matches(text, '(?i)(^|[^a-z])(que|der)([^a-z]|$)')"))
def keyword_filter(spark, sf):
    return T(spark, sf, "documents").where(X.keep(F.col("text"), r"(?i)(^|[^a-z])(the|and)([^a-z]|$)", r"(?i)(^|[^a-z])(que|der)([^a-z]|$)")).select("doc_id")


@query("post_tally", with_ctes([], "SELECT source, count(*) AS english, count(*) FILTER (WHERE regexp_matches(text, '(?i)ing')) AS ing, count(*) FILTER (WHERE regexp_matches(text, '(?i)tion')) AS tion FROM documents WHERE lang = 'en' GROUP BY 1"))
def post_tally(spark, sf):
    """English posts per source and the multi-label vocabulary hits among them."""
    d = T(spark, sf, "documents").where("lang = 'en'")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("english"), *[F.count_if(F.col("text").rlike(f"(?i){w}")).alias(w) for w in ("ing", "tion")])


@query("headline_counts", with_ctes([], "SELECT role, length(text) // 100 AS bucket, count(*) AS n FROM conversations GROUP BY 1, 2"))
def headline_counts(spark, sf):
    return T(spark, sf, "conversations").groupBy("role", F.floor(F.length("text") / 100).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("positions_in_text", with_ctes([], "SELECT event_id, round((event_id % 60) + (user_id % 60 + 0.5) / 60, 6) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS lat, round((event_id % 120) + (user_id % 60) / 60.0, 6) AS lon FROM events"))
def positions_in_text(spark, sf):
    """Warning texts with degrees and minutes read back to a position."""
    e = T(spark, sf, "events")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")     # noqa: E731
    txt = F.concat(F.lit("MISSILE FIRING NEAR "), two(F.col("event_id") % 60), F.lit("-"), two(F.col("user_id") % 60), F.lit(".5"), F.when(F.col("event_id") % 2 == 0, "N").otherwise("S"), F.lit(" "),
                   F.lpad((F.col("event_id") % 120).cast("string"), 3, "0"), F.lit("-"), two(F.col("user_id") % 60), F.lit(".0E AND OTHERS"))
    return e.select("event_id", X.first_position(txt).alias("p")).select("event_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("message_dates", with_ctes([], "SELECT event_id, ts::DATE AS day FROM events"))
def message_dates(spark, sf):
    e = T(spark, sf, "events")
    return e.select("event_id", X.message_date(F.concat(F.lit("NAVAREA "), F.upper(F.date_format("ts", "ddHHmm'Z' MMM yyyy")), F.lit(" TEXT"))).alias("day"))


@query("advisory_levels", with_ctes(["nat"], "SELECT region, sum(lv)::BIGINT AS level, count(*) FILTER (WHERE lv = 4) AS departures FROM (SELECT c_nationkey AS nation, max(substr(o_orderpriority, 1, 1)::INT) AS lv FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority < '5' GROUP BY 1) JOIN nat USING (nation) GROUP BY 1"))
def advisory_levels(spark, sf):
    """Advisory titles to levels, the strongest per country, summed over the theatre."""
    o = B.order_facts(spark, sf).withColumn("title", F.concat(F.lit("Country - Level "), F.substring("o_orderpriority", 1, 1), F.lit(": advice")))
    lv = o.groupBy("nation").agg(F.max(X.advisory_level(F.col("title"))).alias("lv")).join(B.nations(spark, sf), "nation")
    return lv.groupBy("region").agg(F.sum("lv").alias("level"), F.count_if(F.col("lv") == 4).alias("departures"))


@query("market_filter", with_ctes([], "SELECT event_type AS theatre, event_id, value FROM events WHERE value >= 20 AND json_extract(props, '$.k')::INT BETWEEN 5 AND 95"))
def market_filter(spark, sf):
    """Markets inside the volume and price bounds."""
    e = T(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int")).where("value >= 20 and k between 5 and 95")
    return e.select(F.col("event_type").alias("theatre"), "event_id", "value")


@query("candidate_validation", with_ctes([], "SELECT conv_id, turn FROM conversations c WHERE turn + conv_id * 2 IN (SELECT doc_id FROM documents) AND role IN ('user', 'assistant') AND length(text) >= 20"))
def candidate_validation(spark, sf):
    """Candidates whose citations exist and whose kind and size are allowed."""
    c = T(spark, sf, "conversations").withColumn("doc_id", F.explode(F.array(F.col("turn") + F.col("conv_id") * 2)))
    return c.join(T(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi").where(F.col("role").isin("user", "assistant") & (F.length("text") >= 20)).select("conv_id", "turn")


@query("normalised_titles", with_ctes([], "SELECT t, count(*) AS n FROM (SELECT trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM benchmark) GROUP BY 1"))
def normalised_titles(spark, sf):
    return T(spark, sf, "benchmark").groupBy(X.normalised_title(F.col("text")).alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("error_reasons", with_ctes([], "SELECT event_type AS source, 'HTTP # at <url>' AS reason, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' GROUP BY 1"))
def error_reasons(spark, sf):
    e = T(spark, sf, "events").where("event_type = 'error'").withColumn("m", F.concat(F.lit("HTTP "), (500 + F.col("event_id") % 4).cast("string"), F.lit(" at https://host/"), F.col("user_id").cast("string")))
    return e.groupBy(F.col("event_type").alias("source"), X.clean_error(F.col("m")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@query("stated_probabilities", with_ctes([], "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN least(greatest(round(value) / 100, 0.001), 0.999) WHEN event_id % 3 = 1 THEN greatest((event_id % 90 + 10) / 100.0, 0.001) END AS p FROM events"))
def stated_probabilities(spark, sf):
    """The last probability stated in a free text."""
    e = T(spark, sf, "events")
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("first 12% then "), F.round("value").cast("long").cast("string"), F.lit("% in the end"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("I say 0."), (F.col("event_id") % 90 + 10).cast("string"))).otherwise("no number")
    return e.select("event_id", X.last_probability(t).alias("p"))


@query("page_text", with_ctes([], r"""SELECT page_id, length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS chars FROM pages"""))
def page_text(spark, sf):
    return T(spark, sf, "pages").select("page_id", F.length(X.tag_stripped(F.col("html"))).cast("long").alias("chars"))
