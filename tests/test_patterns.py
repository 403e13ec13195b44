import re

import pytest
from pyspark.sql import functions as F

from recordloom.errors import BadPattern
from recordloom.functions import patterns
from recordloom.operators import predicates

VALUES = ["abc", "ABC", "a.c", "a\nc", "ab", "xabcx", "", None, "é1", "a b", "12", "a-b", "a&b", "a]b", "{x}", "a\\b", "öä_9"]


@pytest.mark.parametrize(
    "pattern, expected",
    [
        ("a.c", ["abc", "a.c", "a\nc", "xabcx"]),
        ("^abc", ["abc"]),
        ("^abc$", ["abc"]),
        ("c$", ["abc", "a.c", "a\nc"]),
        ("^[[:alpha:]]+$", ["abc", "ABC", "ab", "xabcx"]),
        ("^[^[:alnum:]]", ["{x}"]),
        ("[[:space:]]", ["a\nc", "a b"]),
        (r"^\w+$", ["abc", "ABC", "ab", "xabcx", "é1", "12", "öä_9"]),
        (r"\mb\M", ["a b", "a-b", "a&b", "a]b", "a\\b"]),
        (r"[[:<:]]b[[:>:]]", ["a b", "a-b", "a&b", "a]b", "a\\b"]),
        ("[]]", ["a]b"]),
        ("[&&]", ["a&b"]),
        ("{x", ["{x}"]),
        (r"a\\b", ["a\\b"]),
        (r"^é", ["é1"]),
        ("(?i)^abc$", ["abc", "ABC"]),
        ("***=a.c", ["a.c"]),
        ("^(ab|12)$", ["ab", "12"]),
        ("^ab?$", ["ab"]),
        ("^a{1,2}b$", ["ab"]),
        ("", [v for v in VALUES if v is not None]),
        ("^", [v for v in VALUES if v is not None]),
        (".*", [v for v in VALUES if v is not None]),
        (r"^\d+\Z", ["12"]),
        ("(a)(b)\\2?c", ["abc", "xabcx"]),
    ],
)
def test_dialect(spark, pattern, expected):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    got = [r["v"] for r in df.where(patterns.match(spark, F.col("v"), pattern)).collect()]
    assert got == expected


@pytest.mark.parametrize("pattern", ["(", "[a", "*a", "a**", "a++", "\\", "[[:no:]]", "(?<name>x)", r"\q", "(|*)", "a{300}", "[[.x.]]", r"\k"])
def test_rejected(spark, pattern):
    with pytest.raises(BadPattern):
        patterns.checked_java(spark, pattern)


def test_what_counts_as_a_pattern():
    assert all(patterns.looks_like_pattern(v) for v in ["^a", "a$", "(a", "a|b", "[a", "a*", "a+", "a{", "a?", "a/b"])
    assert not any(patterns.looks_like_pattern(v) for v in ["a", "a.b", "a\\b", "a]", "a)", "~a", ""])


@pytest.mark.parametrize(
    "mode, value, expected",
    [
        ("full", "a.c", ["a.c"]),
        ("full", "~a.c", ["abc", "a.c", "a\nc", "xabcx"]),
        ("simple", "^a.c", ["abc", "a.c", "a\nc"]),
        ("simple", "a+", []),
        ("simple", "~abc", []),
        ("disabled", "^abc", []),
        ("disabled", "abc", ["abc"]),
        ("full", "", [""]),
    ],
)
def test_modes(spark, mode, value, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "__rownr long, v string")
    got = [r["v"] for r in predicates.matching(df, {"V": value}, mode).orderBy("__rownr").collect()]
    assert got == expected
    assert predicates.pattern_mode("TRUE") == "full" and predicates.pattern_mode("x") == "disabled"


def test_plain_comparisons_reach_the_reader(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(0, "abc")], "__rownr long, v string").write.parquet(path)
    for value, pushed in [("abc", "EqualTo(v,abc)"), ("^abc", "StringStartsWith(v,abc)"), ("^abc$", "EqualTo(v,abc)"), ("^abc.*x", "StringStartsWith(v,abc)")]:
        plan = predicates.matching(spark.read.parquet(path), {"v": value})._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*" + re.escape(pushed), plan), plan
