"""All names in all texts against plain substring scans; names ungrounded in their novel's texts."""

import random

import pytest

from loomfact.operators import search

CORPUS = "话说孙悟空大闹天宫，与猪八戒一同西行取经。那韩立从未在此书出现。"


def ungrounded(spark, corpus, entities):
    rows = [(name, a) for name, aliases in entities.items() for a in (name, *aliases)]
    docs = spark.createDataFrame([(corpus,), (None,)], "text string")
    return {r.name for r in search.ungrounded(spark.createDataFrame(rows, "name string, alias string"), docs, "text").collect()}


def test_ungrounded_names(spark):
    assert ungrounded(spark, CORPUS, {"孙悟空": ()}) == set()
    assert ungrounded(spark, CORPUS, {"齐天大圣": ("孙悟空",)}) == set()
    assert ungrounded(spark, CORPUS, {"厉飞雨": ("厉师兄",)}) == {"厉飞雨"}
    assert ungrounded(spark, "", {"甲": ()}) == set()
    assert ungrounded(spark, "", {"孙悟空": ()}) == {"孙悟空"}
    mixed = {"孙悟空": ("行者",), "猪八戒": (), "厉飞雨": (), "墨居仁": ("墨大夫",), "大闹天宫，与猪八戒": (), "Sun Wukong": ("大闹 天宫",)}
    assert ungrounded(spark, CORPUS, mixed) == {"厉飞雨", "墨居仁", "Sun Wukong"}


def test_each_novel_has_its_own_texts(spark):
    docs = spark.createDataFrame([("a", "甲乙 来了"), ("b", "丙丁 走了")], "novel string, text string")
    rows = spark.createDataFrame([(n, x, x) for n in "abc" for x in ("甲乙", "丙丁")], "novel string, name string, alias string")
    assert {tuple(r) for r in search.ungrounded(rows, docs, "text", "novel").collect()} == {("a", "丙丁"), ("b", "甲乙"), ("c", "甲乙"), ("c", "丙丁")}


def scan(texts, names):
    return sorted((k, n, i) for k, t in texts if t for n in names for i in range(len(t)) if n and t.startswith(n, i))


def leftmost_longest(texts, names):
    out = []
    for k, t in texts:
        i = 0
        while t and i < len(t):
            best = max((n for n in names if n and t.startswith(n, i)), key=len, default=None)
            if best:
                out.append((k, best, i))
            i += len(best or "x")
    return sorted(out)


@pytest.mark.parametrize("shard", [8 << 20, 300])
def test_occurrences_equal_a_substring_scan(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_BYTES", shard)
    rng = random.Random(3)
    letters = "ab 甲乙😀"
    names = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 5))) for _ in range(40)} | {"a b", "甲 乙"})
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 60)))) for i in range(50)] + [(50, None), (51, "")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "k long, text string, name string").repartition(3)
    known = spark.createDataFrame([(n,) for n in [*names, names[0], None, ""]], "name string")
    assert sorted(map(tuple, search.occurrences(known, docs, "k", "text").collect())) == scan(texts, names)
    assert sorted(map(tuple, search.contained(known, docs, "k", "text").collect())) == sorted({(k, n) for k, n, _ in scan(texts, names)})
    assert sorted(map(tuple, search.longest(known, docs, "k", "text").collect())) == leftmost_longest(texts, names)


def test_questions_name_entities_longest_first(spark):
    questions = spark.createDataFrame([(1, "齐天大圣和猪八戒打了孙悟空"), (2, "无人")], "k long, text string")
    names = spark.createDataFrame([("孙悟空",), ("齐天大圣",), ("大圣",), ("猪八戒",)], "name string")
    aliases = spark.createDataFrame([("齐天大圣", "孙悟空"), ("大圣", "孙悟空")], "alias string, canonical string")
    got = search.asked_entities(questions, "k", "text", names, aliases).collect()
    assert sorted(map(tuple, got)) == [(1, "孙悟空", 1), (1, "猪八戒", 2)]


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "a")], "k long, text string")
    none = spark.createDataFrame([], "name string")
    assert search.occurrences(none, docs, "k", "text").count() == search.longest(none, docs, "k", "text").count() == 0
    assert search.contained(spark.createDataFrame([("a",)], "name string"), docs.limit(0), "k", "text").count() == 0
