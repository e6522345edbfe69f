import pytest
from pyspark.sql import functions as F

from marlstone.sources import documents as sources
from marlstone.streaming.counts import windowed_counts


def test_csv_in_another_character_set(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("이름,값\n우성8차,3\n한신,\n".encode("cp949"))
    rows = sources.read_csv_in(spark, str(tmp_path / "a.csv"), "name string, v int").collect()
    assert [tuple(r) for r in rows] == [("우성8차", 3), ("한신", None)]


def test_csv_in_another_character_set_splits_and_keeps_odd_cells(spark, tmp_path):
    rows = [(f"개포우성{i}차, 동", i) for i in range(3000)] + [('따옴표 "안" 값', 7), ("끝\\", None)]
    text = "이름,값\n" + "".join('"{}",{}\n'.format(n.replace('"', '""'), "" if v is None else v) for n, v in rows)
    (tmp_path / "b.csv").write_bytes(text.encode("cp949"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = sources.read_csv_in(spark, str(tmp_path / "b.csv"), "name string, v int")
        assert df.rdd.getNumPartitions() > 1 and sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "c.csv").write_bytes(b"a,b\n\xff\xff,1\n")
    with pytest.raises(Exception, match="decode"):
        sources.read_csv_in(spark, str(tmp_path / "c.csv"), "a string, b int").collect()


def test_price_history_keeps_to_its_bounds(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Symbol,Date,Open,High,Low,Close,Volume\n" + "".join(f"{s},2021-04-{d:02},1,2,0.5,{d},{d * 10}\n" for s in ("052300", "000001") for d in range(1, 31)))
    rows = sources.price_history(spark, str(tmp_path / "p.csv"), "2021-04-03", "2021-04-05", "052300").orderBy("Date").collect()
    assert [(str(r.Date), r.Close, r.Volume) for r in rows] == [(f"2021-04-0{d}", float(d), d * 10) for d in (3, 4, 5)]
    (tmp_path / "q.csv").write_text("Date,Open,High,Low,Close,Volume\n2021-04-01,1,1,1,1,1\n")
    assert sources.price_history(spark, str(tmp_path / "q.csv")).count() == 1 and sources.price_history(spark, str(tmp_path / "q.csv"), start="2021-04-02").count() == 0


def test_yaml_table(spark, tmp_path):
    (tmp_path / "n.yml").write_text("# links\n\n- title: Projects\n  url: /projects/\n- url: '/it''s/' # there\n- title: \"A: b\"\n  other: x\n")
    rows = sources.yaml_table(spark, str(tmp_path / "n.yml"), ["title", "url"]).orderBy("place").collect()
    assert [tuple(r) for r in rows] == [("n.yml", 0, "Projects", "/projects/"), ("n.yml", 1, None, "/it's/"), ("n.yml", 2, "A: b", None)]
    (tmp_path / "e.yml").write_text("# nothing\n")
    assert sources.yaml_table(spark, str(tmp_path / "e.yml"), ["title"]).count() == 0


def test_declared_schema_raises_on_malformed_numbers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,v\nx,1\ny,zz\n")
    with pytest.raises(Exception, match="zz|MALFORMED"):
        sources.read_csv(spark, str(tmp_path / "a.csv"), "n string, v int").collect()


def test_two_row_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("g,total,total\nregion,all,science\nx y,3,1\nz,4,2\n")
    assert [tuple(r) for r in sources.read_two_row_header(spark, str(tmp_path / "a.csv"), ["region", "total", "science"]).collect()] == [("x y", "3", "1"), ("z", "4", "2")]


def test_school_results_compose_the_steps_from_path_to_frame(spark, tmp_path):
    (tmp_path / "g.csv").write_text("region,name,code,all,sci,lang\nsub,sub,sub,sub,sub,sub\n서울특별시 강남구,a,S1,10,1,2\n경상북도 예천군,b,S2,5,,1\n,c,S3,1,0,0\n부산광역시 x,d,S4,7,2,3\n")
    rows = {r["code"]: r for r in sources.school_results(spark, str(tmp_path / "g.csv"), {"S4": ("부산", "기장군")}).collect()}
    assert [(rows[c]["city"], rows[c]["district"], rows[c]["total"]) for c in ("S1", "S2", "S3", "S4")] == [("서울", "강남구", 3.0), ("경북", "예천군", None), (None, None, 0.0), ("부산", "기장군", 5.0)]
    assert sources.empty_frame(spark, "title string").columns == ["title"]


def test_html_tables(spark):
    page = "<table><tr><th>a<th>b</tr><tr><td>1 <td>2</table><p>x<table><tr><td><b>c</b> d</td></tr></table>"
    rows = sources.html_tables(spark.createDataFrame([(1, page), (2, None), (3, "no table")], "page_id long, html string"), "page_id").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["1", "2"]), (1, 1, 0, ["c d"])]


def test_front_matter(spark, tmp_path):
    (tmp_path / "2021-08-27-p.md").write_text("---\nlayout: post\ntitle: \"A: b\"\ndate: 2021-08-26\ntag: [x, y z]\ncomments: true\n---\n# body\n")
    (tmp_path / "q.md").write_text("---\ntitle: T\ntags:\n  - one\n  - two\n---\ntext")
    (tmp_path / "r.md").write_text("bare")
    rows = {r["file"]: r for r in sources.front_matter(spark, str(tmp_path)).collect()}
    first = rows["2021-08-27-p.md"]
    assert (first["title"], str(first["date"]), first["tags"], first["comments"], first["project"], first["body"]) == ("A: b", "2021-08-26", ["x", "y z"], True, None, "# body\n")
    assert rows["q.md"]["tags"] == ["one", "two"] and rows["r.md"]["body"] == "bare" and rows["r.md"]["title"] is None


def test_front_matter_with_blanks_commas_and_comments(spark, tmp_path):
    (tmp_path / "2021-09-14-Coffee shop.md").write_text('---\nlayout: post # fixed\ntitle:  "One # two"\ntag: ["a, b", c d, \'e, f\', don\'t]\nexcerpt: it\'s #1\n---\nx')
    (tmp_path / "s+1 ü%20.md").write_text("---\ntitle: 'it''s'\ntag:\n- Seoul Map\n- \"x, y\" # both\nproject: false\n---\n")
    rows = {r["file"]: r for r in sources.front_matter(spark, str(tmp_path)).collect()}
    r = rows["2021-09-14-Coffee shop.md"]
    assert (r["layout"], r["title"], r["tags"], r["excerpt"]) == ("post", "One # two", ["a, b", "c d", "e, f", "don't"], "it's")
    assert (rows["s+1 ü%20.md"]["title"], rows["s+1 ü%20.md"]["tags"], rows["s+1 ü%20.md"]["project"]) == ("it's", ["Seoul Map", "x, y"], False)


def test_series_of_one_group_or_all(spark):
    doc = spark.createDataFrame([('{"results":[{"data":[{"period":"2021-01-02","ratio":1.5}]},{"data":[{"period":"2021-01-03","ratio":2.5}]}]}',), ('{"results":[]}',), (None,)], "json string")
    told = lambda **k: sorted((str(r.period), r.ratio) for r in sources.json_series(doc, "json", **k).collect())
    assert told() == [("2021-01-02", 1.5)] and told(group=1) == [("2021-01-03", 2.5)] and told(group=2) == []
    assert sorted((r.group, r.ratio) for r in sources.json_series(doc, "json", group=None).collect()) == [(0, 1.5), (1, 2.5)]


def test_series_feed_and_status(spark, tmp_path):
    doc = spark.createDataFrame([('{"results":[{"data":[{"period":"2021-01-02","ratio":1.5}]}]}',), ("{",)], "json string")
    assert [(str(r.period), r.ratio) for r in sources.json_series(doc, "json").collect()] == [("2021-01-02", 1.5)]
    assert sources.zip_series(spark.createDataFrame([([1, 2], [3, 4], [5, 6])], "p array<int>, a array<int>, b array<int>"), "p", "a", "b").count() == 2
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>l</link></item><item><title>u</title></item></channel></rss>")
    assert [r.title for r in sources.feed_entries(spark, str(tmp_path / "f.xml")).collect()] == ["t", "u"]
    with pytest.raises(Exception, match="request failed: 500"):
        sources.checked_body(spark.createDataFrame([(500, b"x")], "code int, body binary")).collect()


def test_stream_counts_equal_batch(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    query = windowed_counts(stream, "ts", "event_type", "1 day", None).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day")["start"].alias("start"), "event_type").count()
    assert sorted(map(tuple, spark.table("counts").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
