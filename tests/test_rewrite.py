"""A golden chapter through all validation passes: homonyms, general persons, aliases, references."""

from pyspark.sql import functions as F

from loomfact.functions import names as nm
from loomfact.operators import rewrite

SCHEMA = "novel string, chapter long, " + ", ".join(f"{a} array<{k}>" for a, k in rewrite.ARRAYS.items())
CHECKS = rewrite.Checks(
    clamp=nm.clamped,
    corrections={"愣子": "二愣子"}, no_person=lambda c: c.isin("众人", "士兵"), general=("樵夫", "老者"), no_place=lambda c: c.isin("这里"),
    shared=lambda c: c.isin("夹道", "后门"), event_types=(("战斗", "成长", "社交"), "社交"), place_type=lambda c: F.when(F.endswith(c, F.lit("山")), "山").otherwise("地点"),
)


def validated(spark, **arrays):
    row = ("n", 1, *(arrays.get(a) for a in rewrite.ARRAYS))
    return rewrite.validated(spark.createDataFrame([row], SCHEMA), CHECKS).first()


def test_golden_chapter(spark):
    got = validated(
        spark,
        characters=[("愣子", ["韩立"], "", ["七玄门"]), ("韩立", ["小韩"], "少年", ["夹道"]), ("韩立", ["阿呆"], "别的", []), (" 樵夫 ", None, None, None), ("众人", [], "", []), ("", [], "", []), ("大观园", [], "", []), ("李俊", ["李逵", "水军头领张顺", "混江龙"], "", []), ("李逵", [], "", []), ("张顺", [], "", [])],
        relationships=[("二愣子", "李逵", "朋友"), ("二愣子", "二愣子", "自己"), ("混江龙", "樵夫", "同行"), ("李俊", "不认识", "敌")],
        locations=[("大观园", "园", None, "setting"), ("夹道", "道", "大观园", "mentioned"), ("夹道", "道", "别处", None), ("后门", "门", None, None), ("这里", "", None, None), ("小洞", "洞", "青山", None), ("青山、绿水", "山", "青山", None)],
        spatial=[("夹道", "大观园", "contains"), ("夹道", "大观园", "contains"), ("夹道", "没有", "contains"), ("小洞", "后门", "nonsense"), ("小洞", "后门", "adjacent")],
        events=[("李俊在韩国与张顺大战夹道", "战斗", "high", [], ""), ("李俊在韩国与张顺大战夹道", "成长", "low", [], "x"), (" 老王来了 ", "不知", "?", ["老王", "樵夫"], "夹道"), ("", "战斗", "high", [], "")],
    )
    people = {c.name: c for c in got.characters}
    assert set(people) == {"二愣子", "大观园·樵夫", "李俊", "张顺", "老王"}
    first = people["二愣子"]
    assert (first.aliases, first.appearance, first.places) == (["韩立", "小韩", "阿呆"], "少年", ["七玄门", "大观园·夹道"])
    assert people["李俊"].aliases == ["李逵", "混江龙"]  # 李逵 went into the one that lists it; the long alias holds 张顺
    assert [tuple(r) for r in got.relationships] == [("二愣子", "李逵", "朋友"), ("混江龙", "大观园·樵夫", "同行")]
    assert [(x.name, x.parent) for x in got.locations] == [("大观园", None), ("大观园·夹道", "大观园"), ("后门", None), ("小洞", "青山"), ("青山", None)]
    assert [tuple(s) for s in got.spatial] == [("大观园·夹道", "大观园", "contains"), ("小洞", "后门", "adjacent")]
    one, two = got.events
    assert (one.type, one.participants, one.location) == ("战斗", ["张顺", "李俊"], "大观园·夹道")
    assert (two.summary, two.type, two.importance, two.participants, two.location) == ("老王来了", "社交", "medium", ["老王", "大观园·樵夫"], "大观园·夹道")


def test_alias_links_are_followed_in_order(spark):
    got = validated(spark, characters=[("甲", ["乙"], "", []), ("乙", ["甲"], "高", []), ("丙", ["甲"], "", ["山"])])
    assert [(c.name, sorted(c.aliases), c.appearance, c.places) for c in got.characters] == [("丙", ["乙", "甲"], "高", ["山"])]


def test_general_persons_without_setting(spark):
    one = validated(spark, characters=[("老者", [], "", [])], locations=[("庙", "", None, None), ("洞", "", "山", None)])
    assert [c.name for c in one.characters] == ["洞·老者"]
    none = validated(spark, characters=[("老者", [], "", [])])
    assert [c.name for c in none.characters] == ["老者"]


def test_null_and_empty_facts_and_other_columns(spark):
    got = validated(spark)
    assert all(got[a] == [] for a in rewrite.ARRAYS)
    df = spark.createDataFrame([("n", 1, *([None] * 5), "kept")], SCHEMA + ", more string")
    assert rewrite.validated(df, CHECKS).first().more == "kept"
    assert rewrite.validated(df.limit(0), CHECKS).count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([("n", 1, *([None] * 5))], SCHEMA)
    plan = rewrite.validated(df, CHECKS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
