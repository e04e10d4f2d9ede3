"""Raw feeds to typed daily tables: event exports, cubes, reports, bulletins, trade lines."""
from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_event_export(spark: SparkSession, path: str, country=51, root=28, quad=29, width=58) -> DataFrame:
    """Tab-separated export, gzip read natively; only the needed positions are kept."""
    cols = [f"c{i}" for i in range(width)]
    df = spark.read.schema(", ".join(f"{c} STRING" for c in cols)).option("sep", "\t").csv(path)
    return df.select(F.col(f"c{country}").alias("country"), F.col(f"c{root}").alias("root"), F.col(f"c{quad}").try_cast("int").alias("quad"))


def root_counts(events: DataFrame, keys=("day", "country")) -> DataFrame:
    """Counts per key and root code, plus 'all' per key, in one expand."""
    e = events.select(*keys, F.explode(F.array(F.col("root"), F.lit("all"))).alias("root"))
    return e.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("n"))


def read_root_history(spark: SparkSession, path: str) -> DataFrame:
    """Compressed history without a header: day, country, root, n. Lines whose day or count can't be read are left out."""
    raw = spark.read.schema("day STRING, country STRING, root STRING, n STRING").csv(path)
    typed = raw.select("country", "root", F.col("day").try_cast("date").alias("day"), F.col("n").try_cast("double").alias("n"))
    return typed.filter("day IS NOT NULL AND n IS NOT NULL")


def write_root_history(counts: DataFrame, path: str) -> None:
    counts.select(F.date_format("day", "yyyy-MM-dd"), "country", "root", "n").write.mode("overwrite").option("compression", "gzip").csv(path)


def history_then_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """History, then the live rows of days after the last one it holds (all of them if it is empty)."""
    last = history.agg(F.max("day")).scalar()
    later = live.filter(last.isNull() | (F.col("day") > last))
    columns = ["country", "root", "day", "n"]
    return history.select(*columns).unionByName(later.select(*columns))


def theatre_sums(events: DataFrame, places: DataFrame, dyads: DataFrame) -> DataFrame:
    """Eleven sums per theatre and day, by where the event was (loc_) and by who the two actors were (dy_).

    events: day, country, actor1, actor2, code, quad, gold (null: 0), armed (one of the actors is); the root is the start of the code.
    places: (country, theatre). dyads: (a, b, theatre, armed_only), a <= b; armed_only pairs count armed events only. Both are small tables of the
    catalogue; an event goes to each of its theatres in one expand, and one aggregation sums both sides. Null actors match no pair.
    """
    at = places.groupBy("country").agg(F.collect_set("theatre").alias("_at"))
    by = dyads.groupBy("a", "b").agg(F.collect_set(F.struct("theatre", "armed_only")).alias("_by"))
    both = F.col("actor1").isNotNull() & F.col("actor2").isNotNull()
    e = events.withColumn("a", F.when(both, F.least("actor1", "actor2"))).withColumn("b", F.when(both, F.greatest("actor1", "actor2")))
    e = e.join(at, "country", "left").join(by, ["a", "b"], "left")
    here = F.transform("_at", lambda t: F.struct(t.alias("theatre"), F.lit(True).alias("here")))
    between = F.filter("_by", lambda d: ~d["armed_only"] | F.coalesce(F.col("armed"), F.lit(False)))
    between = F.transform(F.array_distinct(F.transform(between, lambda d: d["theatre"])), lambda t: F.struct(t.alias("theatre"), F.lit(False).alias("here")))
    e = e.select("day", "code", "quad", F.coalesce("gold", F.lit(0.0)).alias("gold"), F.inline(F.flatten(F.array_compact(F.array(here, between)))))
    root = F.substring("code", 1, 2)
    forces = F.startswith("code", F.lit("138"))
    n = lambda side, rule: F.count(F.when(side & rule, 1))
    loc, dy, any_ = F.col("here"), ~F.col("here"), F.lit(True)
    return e.groupBy("theatre", "day").agg(
        n(loc, any_).alias("loc_all"), n(loc, F.col("quad") == 3).alias("loc_q3"), n(loc, F.col("quad") == 4).alias("loc_q4"),
        F.sum(F.when(loc, F.col("gold")).otherwise(0.0)).alias("loc_gold"), n(loc, forces).alias("loc_mil138"),
        n(loc, F.col("code").isin("152", "153", "154")).alias("loc_mob"), n(loc, root.isin("16", "17")).alias("loc_coerce"),
        n(dy, any_).alias("dy_all"), n(dy, F.col("quad").isin(3, 4)).alias("dy_q34"), F.sum(F.when(dy, F.col("gold")).otherwise(0.0)).alias("dy_gold"),
        n(dy, forces | root.isin("15", "17")).alias("dy_force"))


def jsonstat(cubes: DataFrame, cube="cube") -> DataFrame:
    """Rows of a JSON cube: the flat index becomes mixed-radix coordinates (pos, last dimension fastest)."""
    schema = "size ARRAY<INT>, value MAP<STRING, DOUBLE>"
    c = cubes.withColumn("_c", F.from_json(cube, schema)).select("*", F.explode("_c.value").alias("_k", "value")).withColumn("_i", F.col("_k").cast("long"))
    stride = F.transform(F.col("_c.size"), lambda s, d: F.aggregate(F.slice(F.col("_c.size"), d + 2, F.size("_c.size")), F.lit(1).cast("long"), lambda a, x: a * x))
    return c.withColumn("pos", F.transform(F.col("_c.size"), lambda s, d: (F.floor(F.col("_i") / F.get(stride, d)) % s).cast("int"))).drop("_c", "_k", "_i", cube)


def report_days(reports: DataFrame, body="body") -> DataFrame:
    """JSON report {start, step, values}: one row per value at start + i * step days, then summed per day."""
    r = F.from_json(body, "start STRING, step INT, values ARRAY<DOUBLE>")
    d = reports.withColumn("_r", r).select("*", F.posexplode("_r.values").alias("_i", "_v"))
    return d.groupBy(F.date_add(F.to_date("_r.start"), (F.col("_i") * F.col("_r.step")).cast("int")).alias("day")).agg(F.sum("_v").alias("value"))


def fiscal_month(year, month):
    """Calendar month of a fiscal year that starts in October (fiscal month 1 = October of the year before)."""
    return F.make_date(year - F.when(month <= 3, 1).otherwise(0), (month + 8) % 12 + 1, F.lit(1))


def acquisition_ts(day, hhmm):
    return F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), F.lpad(hhmm.cast("string"), 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def confident_detections(rows: DataFrame) -> DataFrame:
    """Detections with text or numeric confidence: low ones dropped, HHMM made a timestamp."""
    num = F.col("confidence").try_cast("int")
    return rows.where(~F.lower("confidence").isin("l", "low") & (num.isNull() | (num >= 30))).withColumn("ts", acquisition_ts(F.col("acq_date"), F.col("acq_time")))


def alert_log(rows: DataFrame, zone="Asia/Jerusalem", categories=None) -> DataFrame:
    out = rows if categories is None else rows.where(F.col("category").isin(*categories))
    return out.withColumn("utc", F.to_utc_timestamp(F.col("local_ts").cast("timestamp"), zone))


def rss_items(feeds: DataFrame, xml="xml") -> DataFrame:
    """Items of an RSS text: title, link slug and date, one row per item."""
    return feeds.select("*", F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("_it")).select(
        *[c for c in feeds.columns if c != xml], F.regexp_extract("_it", r"(?s)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract("_it", r"/([^/<]+)/?</link>", 1).alias("slug"), F.regexp_extract("_it", r"<pubDate>(.*?)</pubDate>", 1).alias("published"))


ITEM = "title string, link string, pubDate string, description string, _corrupt string"


def xml_items(feeds: DataFrame, xml="xml", schema=ITEM, item="item") -> DataFrame:
    """Items of feed texts, each read by the XML parser: the other columns, pos (place in its feed), the fields, `broken`. Entities and CDATA are decoded, blanks around a value go;
    an item that is no well-formed XML keeps its text in `broken`, and its neighbours are read all the same. Null and empty feeds have no items."""
    parts = F.regexp_extract_all(xml, F.lit(rf"(?s)(<{item}[\s>].*?</{item}>)"), F.lit(1))
    d = feeds.select(*[c for c in feeds.columns if c != xml], F.posexplode(parts).alias("pos", "_text"))
    d = d.withColumn("_x", F.from_xml("_text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": item}))
    names = [f.split()[0] for f in schema.split(", ") if not f.startswith("_corrupt")]
    return d.select(*[c for c in d.columns if not c.startswith("_")], *[F.col(f"_x.{n}").alias(n) for n in names], F.col("_x._corrupt").alias("broken"))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))  # Fixed values; the last is decoded last


def plain(html):
    """Text of a piece of HTML: tags go, the common entities are decoded, runs of blanks become one."""
    out = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_cells(pages: DataFrame, html="html", row="tr", cell="t[dh]") -> DataFrame:
    """The other columns, row and col (from 0), text: every cell of every row in document order. Cells without a closing tag end at the next cell or row end; comments
    and scripts are left out first. row and cell are tag patterns, so lists are read the same way."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    d = pages.select(*[c for c in pages.columns if c != html], F.posexplode(F.regexp_extract_all(bare, F.lit(rf"(?is)<(?:{row})\b[^>]*>(.*?)(?:</(?:{row})>|(?=<(?:{row})\b)|\z)"), F.lit(1))).alias("row", "_r"))
    cells = F.regexp_extract_all("_r", F.lit(rf"(?is)<(?:{cell})\b[^>]*>(.*?)(?=</(?:{cell})>|<(?:{cell})\b|\z)"), F.lit(1))
    return d.select(*[c for c in d.columns if c != "_r"], F.posexplode(cells).alias("col", "_c")).withColumn("text", plain(F.col("_c"))).drop("_c")


def fixed_layout(texts: DataFrame, text="text", key="month") -> DataFrame:
    """Lines 'DD n' of a monthly text with its printed 'total N'; months whose sum disagrees are flagged."""
    lines = texts.select(key, F.regexp_extract(text, r"total\s+(\d+)", 1).try_cast("long").alias("total"), F.explode(F.split(text, "\n")).alias("_l"))
    d = lines.select(key, "total", F.regexp_extract("_l", r"^(\d{1,2})\s+(\d+)$", 1).try_cast("int").alias("dom"), F.regexp_extract("_l", r"^(\d{1,2})\s+(\d+)$", 2).try_cast("long").alias("n")).where("dom is not null")
    s = d.groupBy(key, "total").agg(F.sum("n").alias("_s"))
    return d.join(s, [key, "total"]).withColumn("agrees", F.col("_s") == F.col("total")).drop("_s")


def trade_units(rows: DataFrame, keys=("partner", "month")) -> DataFrame:
    """Monthly units: a 4-digit heading wins over the sum of its 6-digit lines."""
    head = F.sum(F.when(F.length("code") == 4, F.col("units")))
    lines = F.sum(F.when(F.length("code") == 6, F.col("units")))
    return rows.groupBy(*keys, F.substring("code", 1, 4).alias("heading")).agg(F.coalesce(head, lines).alias("units")).groupBy(*keys).agg(F.sum("units").alias("units"))


def bulletin_numbers(bulletins: DataFrame, patterns, text="text", ts="ts", key="bulletin_id") -> DataFrame:
    """First number found by alternative patterns; the first bulletin of the day wins."""
    val = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns]).try_cast("double")
    w = Window.partitionBy(F.to_date(ts)).orderBy(ts, key)
    return bulletins.withColumn("value", val).where("value is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select(F.to_date(ts).alias("day"), key, "value")


def notices(feeds: list) -> DataFrame:
    """Hazard notices of several feeds in one schema; a fallback feed counts only on days its principal is empty.

    feeds: [(priority, DataFrame of id, day, text)].
    """
    u = None
    for pr, f in feeds:
        part = f.withColumn("priority", F.lit(pr))
        u = part if u is None else u.unionByName(part)
    best = u.groupBy("day").agg(F.min("priority").alias("priority"))
    return u.join(best, ["day", "priority"])


def failing_sources(errors: DataFrame, same: dict[str, str] | None = None) -> DataFrame:
    """Reported problems (at, text = "source: reason") as one row a source: source, why, first, n_reports.

    Names in `same` count as the source they map to. Reasons become sentences with single spaces; equal ones are said once, in the order in
    which they first came. A text without a source has the source '' and a row of its own for each reason; null and empty reasons are left out."""
    cut = F.instr("text", ": ")
    name = F.when(cut > 0, F.trim(F.substring("text", F.lit(1), cut - 1))).otherwise("")
    said = F.trim(F.regexp_replace(F.when(cut > 0, F.substring("text", cut + 2, F.length("text"))).otherwise(F.col("text")), r"\s+", " "))
    for old, new in (same or {}).items():
        name = F.when(name == old, new).otherwise(name)
    whole = F.concat(F.upper(F.substring("_said", 1, 1)), F.substring("_said", F.lit(2), F.length("_said")), F.when(F.col("_said").rlike("[.!?)]$"), "").otherwise("."))
    rows = errors.select("at", name.alias("source"), said.alias("_said")).where(F.col("_said") != "").withColumn("why", whole)
    once = rows.groupBy("source", "why").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_reports"))
    alone = F.when(F.col("source") == "", F.col("why"))
    out = once.groupBy("source", alone.alias("_alone")).agg(F.sort_array(F.collect_list(F.struct("first", "why"))).alias("_why"), F.min("first").alias("first"),
                                                            F.sum("n_reports").alias("n_reports"))
    return out.select("source", F.array_join("_why.why", " ").alias("why"), "first", "n_reports")
