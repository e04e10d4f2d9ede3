"""XML items and HTML cells with entities, CDATA, broken items and unclosed cells."""
import datetime as dt
import gzip

from tocsin.sources import feeds


def test_broken_items_don_t_hide_their_neighbours(spark):
    xml = ("<rss><channel><item><title>A &amp; B &#233;</title><link>l1</link></item><item><title>no end</item><item kind='x'><title><![CDATA[<b>C</b> & D]]></title><pubDate>d3</pubDate></item>"
           "<item><other>1</other></item></channel></rss>")
    df = spark.createDataFrame([(1, xml), (2, None), (3, ""), (4, "<rss></rss>")], "id int, xml string")
    got = [(r["id"], r["pos"], r["title"], r["link"], r["pubDate"], r["broken"] is not None) for r in feeds.xml_items(df).orderBy("id", "pos").collect()]
    assert got == [(1, 0, "A & B é", "l1", None, False), (1, 1, None, None, None, True), (1, 2, "<b>C</b> & D", None, "d3", False), (1, 3, None, None, None, False)]


def test_table_cells(spark):
    html = ("<table class='x'><thead><TR><th>Date</th><th scope=col>N &amp; M</th></tr></thead><!-- <tr><td>hidden</td></tr> --><tr><td>1 May<td>  2&nbsp;3 </td></tr>"
            "<script>var a='<tr><td>no</td></tr>'</script><tr><td><a href='q'>link</a> <b>bold</b></td><td></td></tr></table>")
    df = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<p>no table</p>")], "id int, html string")
    got = [(r["id"], r["row"], r["col"], r["text"]) for r in feeds.html_cells(df).orderBy("id", "row", "col").collect()]
    assert got == [(1, 0, 0, "Date"), (1, 0, 1, "N & M"), (1, 1, 0, "1 May"), (1, 1, 1, "2 3"), (1, 2, 0, "link bold"), (1, 2, 1, "")]


def test_compressed_history(spark, tmp_path):
    with gzip.open(tmp_path / "h.csv.gz", "wt") as f:
        f.write("2024-01-01,UP,13,4\n2024-01-03,UP,all,9.0\nnot a day,UP,13,1\n2024-01-02,UP,15,\n\n2024-01-02,RS\n")
    history = feeds.read_root_history(spark, str(tmp_path / "h.csv.gz"))
    d = dt.date
    assert sorted(tuple(r) for r in history.collect()) == [("UP", "13", d(2024, 1, 1), 4.0), ("UP", "all", d(2024, 1, 3), 9.0)]
    live = spark.createDataFrame([("UP", "13", d(2024, 1, 3), 7.0), ("UP", "13", d(2024, 1, 4), 8.0)], "country string, root string, day date, n double")
    assert sorted((r["day"].day, r["n"]) for r in feeds.history_then_live(history, live).collect()) == [(1, 4.0), (3, 9.0), (4, 8.0)]
    assert feeds.history_then_live(history.limit(0), live).count() == 2
    feeds.write_root_history(history, str(tmp_path / "again"))
    assert sorted(map(tuple, feeds.read_root_history(spark, str(tmp_path / "again")).collect())) == sorted(map(tuple, history.collect()))


def test_event_export(spark, tmp_path):
    row = [""] * 58
    row[51], row[28], row[29] = "UP", "19", "4"
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("\t".join(row) + "\n" + "\t".join(["short", "line"]) + "\n")
    got = [tuple(r) for r in feeds.read_event_export(spark, str(tmp_path / "x.csv.gz")).collect()]
    assert ("UP", "19", 4) in got and all(g == ("UP", "19", 4) or g == (None, None, None) for g in got)


def test_theatre_sums(spark):
    rows = [("A", "X", "Y", "1383", 3, -2.0, False), ("A", "Y", "X", "172", 4, None, True), ("B", None, "Y", "152", 1, 1.0, True), ("C", "X", "X", "190", 4, 5.0, None)]
    e = spark.createDataFrame(rows, "country string, actor1 string, actor2 string, code string, quad int, gold double, armed boolean").selectExpr("*", "DATE '2024-01-01' AS day")
    places = spark.createDataFrame([("A", "t1"), ("B", "t1"), ("A", "t2")], "country string, theatre string")
    dyads = spark.createDataFrame([("X", "Y", "t2", True), ("X", "X", "t3", False)], "a string, b string, theatre string, armed_only boolean")
    got = {r["theatre"]: r.asDict() for r in feeds.theatre_sums(e, places, dyads).collect()}
    pick = lambda t, *c: tuple(got[t][x] for x in c)
    assert pick("t1", "loc_all", "loc_q3", "loc_q4", "loc_gold", "loc_mil138", "loc_mob", "loc_coerce", "dy_all", "dy_gold") == (3, 1, 1, -1.0, 1, 1, 1, 0, 0.0)
    assert pick("t2", "loc_all", "dy_all", "dy_q34", "dy_gold", "dy_force") == (2, 1, 1, 0.0, 1)
    assert pick("t3", "loc_all", "dy_all", "dy_q34", "dy_gold", "dy_force") == (0, 1, 1, 5.0, 0)


def test_failing_sources(spark):
    rows = [(1, "wire: timed  out"), (2, "wire b: timed out."), (3, "wire: Refused (404)"), (4, None), (5, "odd: "), (6, "no name"), (7, "no name"), (8, "lost")]
    df = spark.createDataFrame(rows, "at long, text string")
    out = {(r.source, r.why, r.first, r.n_reports) for r in feeds.failing_sources(df, {"wire b": "wire"}).collect()}
    assert out == {("wire", "Timed out. Refused (404)", 1, 3), ("", "No name.", 6, 2), ("", "Lost.", 8, 1)}
    assert feeds.failing_sources(df.limit(0)).count() == 0
