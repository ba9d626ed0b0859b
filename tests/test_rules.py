"""Golden cases of the rules over scenes, books and residences."""

from pyspark.sql import functions as F

from loomfact.functions import names as nm
from loomfact.operators import scenes, split


def test_residences(spark):
    rows = [("太师府", None, True), ("将军府", None, True), ("荣国府", None, True), ("贾府", None, True), ("王夫人府", None, False), ("大名府", None, False), ("开封府", "region", False), ("开封府", "city", True), ("府", "city", False), ("某府邸", "city", False), ("北静王府", None, True)]
    df = spark.createDataFrame(rows, "name string, tier string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", nm.is_residence(F.col("name"), F.col("tier"))).collect())


def test_tone_needs_three_matches(spark):
    tones = (("战斗", "杀|砍[了去来]"), ("悲伤", "[哭泣悲伤]"), ("欢乐", "[笑喜乐]"))
    rows = [("他哭了又哭", "平静"), ("他哭了又哭，悲从中来", "悲伤"), ("杀杀杀，笑笑笑", "战斗"), ("", "平静")]
    df = spark.createDataFrame(rows, "text string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", scenes.tone(F.col("text"), tones)).collect())


def test_key_dialogue(spark):
    long = "“" + "话" * 70 + "”"
    rows = [(1, 0, "“太短了”"), (1, 1, "不是对话但是很长很长很长很长"), (1, 2, "「一二三四五六七」"), (1, 3, long), (1, 4, "“一二三四五六七八”"), (2, 0, "无")]
    got = scenes.key_dialogue(spark.createDataFrame(rows, "scene long, k long, text string"), "scene", "k", "text").collect()
    assert sorted(map(tuple, got)) == [(1, 1, long[:57] + "..."), (1, 2, "“一二三四五六七八”")]


def test_character_roles(spark):
    paragraphs = [(1, 0, "甲和乙来了，甲笑。"), (1, 1, "“丙走了”"), (1, 2, "甲坐下。"), (1, 3, "乙和甲。"), (1, 4, "丁。a.b")]
    present = [(1, x) for x in ("丁", "乙", "丙", "甲", "戊", "a.b")] + [(2, "甲")]
    got = scenes.character_roles(spark.createDataFrame(paragraphs, "scene long, order long, text string"), spark.createDataFrame(present, "scene long, name string"))
    rows = {(r.scene, r.place): (r.name, r.role, r.mentions) for r in got.collect()}
    assert [rows[1, k] for k in range(1, 7)] == [("甲", "主", 4), ("丙", "主", 1), ("乙", "配", 2), ("a.b", "提及", 1), ("丁", "提及", 1), ("戊", "提及", 0)]
    assert rows[2, 1] == ("甲", "提及", 0)


def genre(spark, text):
    r = split.text_genre(split.genre_features(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text"), "id").first()
    return r.genre, r.confidence


def test_text_genres(spark):
    assert genre(spark, "“不是”\n" * 5 + '"是"\n「是」\n' + "叙述。\n" * 20) == ("novel", 0.9)
    assert genre(spark, "床前明月光\n" * 101) == ("poetry", 0.85)
    assert genre(spark, "散文。" * 100) == ("essay", 0.8)
    assert genre(spark, ("正文。" * 10 + "\n***\n") * 3) == ("short_collection", 0.7)
    assert genre(spark, "第一章 起\n" + "字" * 100 + "\n第二章 承\n") == ("unknown", 0.5)
    assert genre(spark, "") == ("essay", 0.8)


def test_pagination(spark):
    good = "\n".join(f"书名({i})" for i in range(8))
    rows = [(1, good + "\n别的(1)\n别的(2)"), (2, good + "\n别的(1)\n别的(2)\n又(3)"), (3, "书(1)\n书(2)\n书(3)\n书(4)"), (4, "书 (1)  \n" * 5)]
    got = split.paginated(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    assert {tuple(r) for r in got.collect()} == {(1, "书名", 8), (4, "书", 5)}


def test_heuristic_titles(spark):
    body = "正文。" * 200
    text = f"序\n{body}\n\n短的题目\n{body}\n\n太近\n\n太近二\n{body}\n\n12345\n\n有，标点\n\n***\n\nwww.x.com\n\n" + "长" * 31 + f"\n\n最后\n{body}"
    got = split.heuristic_titles(spark.createDataFrame([(1, text), (2, "一\n正文"), (3, "")], "id long, text string"), "id", "text").collect()
    assert [r.title for r in sorted(got, key=lambda r: r.line_no)] == ["序", "短的题目", "太近", "最后"]


def test_usable_splits(spark):
    rows = [(1, 10), (2, 60_000), (3, 50_000), (3, 50_000), (4, 30_000), (4, 30_000), (5, 50_001), (5, 9), (5, 9), (5, 39_990), (5, 9)] + [(6, 5000)] * 4 + [(6, 60_000)]
    got = {r.b: (r.usable, r.reason) for r in split.usable(spark.createDataFrame(rows, "b long, w long"), "b", "w").collect()}
    assert got == {1: (False, "single_chapter_small"), 2: (False, "single_huge_chapter"), 3: (False, "only_2_chapters"), 4: (True, ""), 5: (False, "oversized_chapter"), 6: (True, "")}
