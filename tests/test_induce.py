"""Heading patterns from marked lines."""

import pytest

from loomfact.operators import induce

CASES = {
    "volumes": (["上卷 第01节", "上卷 第02节", "中卷 第01节"], ["下卷 第03节", "别的"], r"^[上下中]卷\s+第[零〇一二两三四五六七八九十百千万\d]+节", 4),
    "numbers": (["篇一 01标题.1", "篇二 02标题.2"], ["篇三 03标题.3", "篇 没有"], None, 3),
    "stems": (["【甲】起", "【乙】承"], ["【丙】承", "【丁】转", "甲承"], None, 3),
    "words": (["Act One: dawn", "Act Two: dusk"], ["Act Three: noon", "Actor"], r"^Act\s+[a-zA-Z]+:\s+[a-zA-Z]+", 3),
    "mixed": (["记1", "记。"], ["记忆"], "^记", 3),
    "one": (["只一行"], ["只一行"], None, None),
    "covered": (["第一章 起", "第二章 承"], ["第三章 转"], None, None),
    "nothing": (["甲a", "9。"], ["甲a"], None, None),
}


@pytest.fixture(scope="module")
def got(spark):
    marked = [(k, x) for k, (m, _, _, _) in CASES.items() for x in m]
    lines = [(k, x) for k, (m, more, _, _) in CASES.items() for x in [*m, *more]]
    out = induce.induced(spark.createDataFrame(marked, "book string, line string"), spark.createDataFrame(lines, "book string, line string"), "book")
    return {r.book: (r.pattern, r.hits) for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_pattern(got, name):
    _, _, pattern, hits = CASES[name]
    if hits is None:
        assert name not in got
    else:
        assert got[name][1] == hits and (pattern is None or got[name][0] == pattern)


def test_brackets_that_only_some_lines_have(spark):
    rows = [("b", "(篇一)起"), ("b", "篇二)承")]
    df = spark.createDataFrame([*rows, ("b", "篇三)承")], "book string, line string")
    got = induce.induced(spark.createDataFrame(rows, "book string, line string"), df, "book").collect()
    assert [(r.pattern[:2], r.hits) for r in got] == [("^篇", 2)]


def test_empty(spark):
    none = spark.createDataFrame([], "book string, line string")
    assert induce.induced(none, none, "book").count() == 0
