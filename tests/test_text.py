"""Texts, names, numbers, JSON, readers, writers and streams: golden cases."""

import pytest
from pyspark.sql import functions as F

from loomfact.functions import jsonrepair
from loomfact.functions import names as nm
from loomfact.functions import numbers as nu
from loomfact.functions import text as tx
from loomfact.operators import search, sequence, split
from loomfact.sources import facts, readers, writers
from loomfact.streaming import incremental


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return row.select(expression.alias("x")).collect()[0].x


@pytest.mark.parametrize(("text", "value"), [("三", 3), ("十五", 15), ("二十", 20), ("一百零三", 103), ("两千五百", 2500), ("42", 42), ("abc", None), ("", None)])
def test_chinese_numbers(spark, text, value):
    assert one(spark, nu.chinese_number(F.col("t")), t=text) == value


@pytest.mark.parametrize(("text", "km"), [("三日路程", 120.0), ("十里", 5.0), ("100公里", 100.0), ("九千里", 400.0), ("不远", 200.0), ("?", None)])
def test_distances(spark, text, km):
    assert one(spark, nu.distance_km(F.col("t")), t=text) == km


def test_haversine(spark):
    assert abs(one(spark, nu.haversine_km(F.col("a"), F.col("b"), F.lit(51.5), F.lit(-0.12)), a=48.85, b=2.35) - 344) < 2


def test_names(spark):
    assert one(spark, nm.clamped(F.col("t")), t="　张三、李四 ") == "张三"
    assert one(spark, nm.relation_type(F.col("t")), t="Step-Father") == "parent"
    assert one(spark, nm.relation_class(F.col("t")), t="enemy") == "hostile"
    assert one(spark, nm.suffix_of(F.col("t"), 1), t="大雷音寺") == "building"
    assert one(spark, nm.is_generic_person(F.col("t")), t="众人") == "listed"
    assert one(spark, nm.is_generic_place(F.col("t")), t="东边") == "direction"
    assert [one(spark, nm.alias_safety(F.col("t")), t=t) for t in ("众人", "王老爷", "悟空")] == [0, 1, 2]
    assert one(spark, nm.only_cjk(F.col("t")), t="") and not one(spark, nm.has_cjk(F.col("t")), t="abc")


def test_strip_takes_wide_space(spark):
    assert one(spark, tx.strip(F.col("t")), t="　 a 　") == "a"


def test_noise_and_cleaning(spark):
    text = "Once.\nwww.example.com\n=====\na | b | c\nEnd"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = {r.line: r.kind for r in tx.lines(df, "k", "text").withColumn("kind", tx.noise_kind(F.col("line"))).collect()}
    assert got == {"Once.": None, "www.example.com": "url", "=====": "decoration", "a | b | c": "template", "End": None}
    r = tx.cleaned(df, "k", "text").collect()[0]
    assert (r.text, r.removed) == ("Once.\n=====\nEnd", 2)


def test_thinking_and_citations(spark):
    assert one(spark, tx.thinking_removed(F.col("t")), t="<think>a</think> b <think>c") == "b"
    assert one(spark, tx.cited_chapters(F.col("t")), t="见第12章和第3章，第12章") == [3, 12]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'),
        ('so: {"a": [1, 2], "b": "x"} ok', '{"a": [1, 2], "b": "x"}'),
        ('{"a": [1, 2, {"b": "unfin', '{"a": [1, 2, {"b": "unfin"}]}'),
        ('{"a": 1, "b":', '{"a": 1, "b": null}'),
        ('{"a": 1, "b"', '{"a": 1, "b": null}'),
        ("none", None),
        (None, None),
    ],
)
def test_json_is_found_and_closed(text, want):
    assert jsonrepair.extracted(text) == want


def test_extract_json_column(spark):
    df = spark.createDataFrame([('{"a": [1',), ("no",)], "t string")
    assert [r.x for r in df.select(jsonrepair.extract_json(F.col("t")).alias("x")).collect()] == ['{"a": [1]}', None]


def test_decoding():
    assert readers.decoded_text("章".encode("gb18030") * 60_000)[:1] == "章"
    assert readers.decoded_text(b"\xef\xbb\xbfabc") == "abc" and readers.decoded_text(None) == ""
    assert readers.decoded_text("é".encode() * 60_000) == "é" * 60_000


def test_books_and_new_ones(spark, tmp_path):
    (tmp_path / "红楼梦.txt").write_bytes("作者：曹雪芹\n正文".encode("gb18030"))
    (tmp_path / "copy.txt").write_bytes("作者：曹雪芹\n正文".encode("gb18030"))
    (tmp_path / "other.md").write_text("x")
    got = readers.books(spark, str(tmp_path))
    assert {(r.title, r.author) for r in got.collect()} == {("红楼梦", "曹雪芹"), ("copy", "曹雪芹")}
    assert readers.new_books(got, got.select("file_hash").limit(0)).count() == 1
    assert readers.new_books(got, got).count() == 0


def test_gazetteer(spark, tmp_path):
    line = "\t".join(["1", "Paris", "Paris", "巴黎,Lutetia", "48.85", "2.35", "P", "PPLC", "FR", "", "", "", "", "", "2000000", "", "35", "Europe/Paris", "2020-01-01"])
    small = "\t".join(["2", "Paris", "Paris", "", "33.6", "-95.5", "P", "PPL", "US", "", "", "", "", "", "25000", "", "180", "America/Chicago", "2020-01-01"])
    (tmp_path / "g.txt").write_text(line + "\n" + small + "\n")
    names = readers.gazetteer_names(readers.gazetteer(spark, str(tmp_path / "g.txt")), "[一-鿿]")
    ask = spark.createDataFrame([("Paris",), ("巴黎",), ("Lutetia",)], "name string")
    assert {(r.name, r.geonameid) for r in readers.resolved_names(ask, names, {"PPLC": 1, "PPL": 2}).collect()} == {("Paris", 1), ("巴黎", 1)}


FACT = '{"characters": [{"name": "A", "abilities_gained": ["fly", {"dimension": "magic", "name": "fire"}]}, {"name": ["wrong"]}], "relationships": [{"person_a": "A", "person_b": "B", "relation_type": "friend"}], "events": [{"summary": "s", "importance": null}]}'


def test_lenient_facts(spark):
    df = spark.createDataFrame([("n", 1, FACT), ("n", 2, "{}"), ("n", 3, None)], "novel string, chapter int, fact string")
    assert [(r.dimension, r.name) for r in facts.abilities(df, "fact").collect()] == [("技能", "fly"), ("magic", "fire")]
    assert facts.elements(df, "fact", "relationships").collect()[0].is_new is True
    assert facts.elements(df, "fact", "events").collect()[0].importance == "medium"
    assert "A" in {r.name for r in facts.mentions(df, "fact").collect()}
    assert facts.elements(df, "fact", "locations").count() == 0


def test_export_and_import(spark):
    novels = spark.createDataFrame([("n", "T")], "novel string, title string")
    chapters = spark.createDataFrame([("n", 2, "b"), ("n", 1, "a")], "novel string, num int, body string")
    docs = writers.exported(novels, "novel", chapters=chapters)
    assert {(r.num, r.body) for r in writers.imported(docs, "doc", "chapters", "num:int,body:string", "novel").collect()} == {(1, "a"), (2, "b")}
    assert writers.import_counts(docs, "doc", "novel", "chapters", "scenes").collect()[0][1:] == (2, 0)


def test_markdown_in_order(spark):
    df = spark.createDataFrame([("n", 2, "B", "y|z"), ("n", 1, "A", "x")], "k string, o int, h string, b string")
    assert writers.markdown(df, "k", "o", "h", "b").collect()[0].markdown == "## A\n\nx\n\n## B\n\ny\\|z"


def test_splitting_by_headings(spark):
    body = "话" * 30
    text = "\n".join(["　第一章 开始", body, "第二章 继续", body, "第三章 结束", body])
    got = split.split_books(spark.createDataFrame([(1, text), (2, "plain\n" * 10)], "k int, text string"), "k", "text").orderBy("k", "chapter").collect()
    assert [(r.k, r.mode, r.title) for r in got] == [(1, "chapter_cn", "第一章 开始"), (1, "chapter_cn", "第二章 继续"), (1, "chapter_cn", "第三章 结束"), (2, "fixed", "")]
    assert got[0].content == body
    custom = split.split_books(spark.createDataFrame([(1, "a\n@x\nb\n@y\nc")], "k int, text string"), "k", "text", "^@").collect()
    assert [(r.title, r.content) for r in custom] == [("@x", "b"), ("@y", "c")]


def test_fixed_split_loses_nothing(spark):
    text = "\n".join(f"line {i}" for i in range(3000))
    got = split.split_fixed(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text", 1000).orderBy("chapter").collect()
    assert "\n".join(r.content for r in got) == text and max(len(r.content) for r in got) < 1100


def test_grounding(spark):
    names = spark.createDataFrame([("Ana", "Ana"), ("Ana", "Queen"), ("Bo", "Bo"), ("C", "C")], "name string, alias string")
    docs = spark.createDataFrame([(1, "The Queen spoke.")], "k int, text string")
    assert [r.name for r in search.ungrounded(names, docs, "text").collect()] == ["Bo"]
    assert {(r.k, r.name) for r in search.contained(names.select("name"), docs, "k", "text").collect()} == set()
    assert {(r.k, r.name) for r in search.contained(spark.createDataFrame([("Queen",), ("po",)], "name string"), docs, "k", "text").collect()} == {(1, "Queen"), (1, "po")}


def test_break_points_depend_on_the_last_one(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([5.0, 5.0, 8.0, 5.0, 5.0, 5.0])], "k int, para int, score double")
    got = sequence.kept_by_spacing(df, ["k"], "para", "score", 5.0, 3, 7.0, 2)
    assert sorted(r.para for r in got.collect()) == [0, 2, 5]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, i % 3, f"t{i % 2}") for i in range(30)]
    for day in range(3):
        spark.createDataFrame(rows[day * 10 : day * 10 + 10], "id long, k long, kind string").coalesce(1).write.parquet(str(tmp_path / f"in/{day}"))
    where = str(tmp_path)
    stream = incremental.chapters_stream(spark, f"{where}/in/*", "id long, k long, kind string", files=1)
    incremental.run_available(stream, f"{where}/cp", incremental.append_log(f"{where}/log"))
    got = incremental.current(spark, f"{where}/log", ["id"])
    assert {(r.id, r.k, r.kind) for r in got.collect()} == set(rows)
    spark.createDataFrame([(5, 9, "late")], "id long, k long, kind string").coalesce(1).write.parquet(f"{where}/in/3")
    incremental.run_available(stream, f"{where}/cp", incremental.append_log(f"{where}/log"))
    got = {r.id: r.kind for r in incremental.current(spark, f"{where}/log", ["id"]).collect()}
    assert got[5] == "late" and len(got) == 30
