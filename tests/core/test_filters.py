import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.plans import filters as f


@pytest.mark.parametrize("doc,tree", [
    (None, None), ({}, None),
    ({"a": "x"}, f.Equals("a", "x")),
    ({"a": {"$in": ["x", "y", "x"]}}, f.In("a", frozenset("xy"))),
    ({"a": "x", "b": "y"}, f.And((f.Equals("a", "x"), f.Equals("b", "y")))),
    ({"$or": [{"a": "x"}, {"a": "y", "b": "z"}]}, f.Or((f.Equals("a", "x"), f.And((f.Equals("a", "y"), f.Equals("b", "z")))))),
    ({"$not": {"$or": [{"a": "x"}, {"b": "y"}]}, "c": "z"}, f.And((f.Not(f.Or((f.Equals("a", "x"), f.Equals("b", "y")))), f.Equals("c", "z")))),
])
def test_parse(doc, tree):
    assert f.parse(doc) == tree


@pytest.mark.parametrize("doc,key,operator", [
    ({"$gt": "x"}, "$gt", "$gt"), ({"$in": ["x"]}, "$in", "$in"), ({"a": 1}, "a", "Integer"), ({"a": True}, "a", "Boolean"), ({"a": None}, "a", "null"), ({"a": ["x"]}, "a", "ArrayList"),
    ({"a": {}}, "a", "LinkedHashMap"), ({"a": {"$gt": "1"}}, "a", "$gt"), ({"a": {"$in": ["x"], "$x": 1}}, "a", "$in"), ({"a": {"$in": "x"}}, "a", "$in:String"),
    ({"a": {"$in": []}}, "a", "$in:empty_array"), ({"a": {"$in": [1]}}, "a", "$in:Integer"), ({"$or": "x"}, "$or", "String"), ({"$or": []}, "$or", "empty_array"),
    ({"$or": ["x"]}, "$or", "String"), ({"$or": [{}]}, "$or", "empty_clause"), ({"$not": "x"}, "$not", "String"), ({"$not": {}}, "$not", "empty_clause"),
])
def test_refused(doc, key, operator):
    with pytest.raises(f.UnsupportedOperator) as e:
        f.parse(doc)
    assert (e.value.key, e.value.operator) == (key, operator)


def test_or_stands_alone():
    with pytest.raises(f.AmbiguousFilter):
        f.parse({"$or": [{"a": "x"}], "b": "y"})
    with pytest.raises(f.AmbiguousFilter):
        f.parse({"$not": {"$or": [{"a": "x"}], "b": "y"}})


def test_terms_and_choice():
    e = f.parse({"a": {"$in": ["x", "y"]}, "$not": {"b": "z"}})
    assert f.term_count(e) == 2 and f.keys(e) == {"a", "b"}
    assert f.choose(e, {"a", "b", "c"}) == "posting" and f.choose(e, {"a"}) == "scan" and f.choose(None, set()) == "all"


leaf = st.one_of(st.builds(lambda k, v: {k: v}, st.sampled_from("ab"), st.sampled_from("xyz")), st.builds(lambda k, v: {k: {"$in": v}}, st.sampled_from("ab"), st.lists(st.sampled_from("xyz"), min_size=1)))
docs = st.recursive(leaf, lambda s: st.one_of(st.builds(lambda x: {"$not": x}, s), st.builds(lambda xs: {"$or": xs}, st.lists(s, min_size=1, max_size=3)), st.builds(lambda x, y: {"$not": x, "c": y}, s, st.sampled_from("xyz"))), max_leaves=6)


def brute(e, row):
    match e:
        case f.Equals(k, v):
            return row.get(k) == v
        case f.In(k, vs):
            return row.get(k) in vs
        case f.And(ts):
            return all(brute(t, row) for t in ts)
        case f.Or(ts):
            return any(brute(t, row) for t in ts)
        case f.Not(t):
            return not brute(t, row)


def test_both_plans_agree_with_brute_force(spark):
    values = [None, "x", "y", "z"]
    rows = [({k: v for k, v in zip("abc", x) if v}, n) for n, x in enumerate(itertools.product(values, repeat=3))]
    df = spark.createDataFrame([(f"seg-{n % 2}", n, a) for a, n in rows], "segment_id string, ordinal long, attributes map<string,string>").cache()
    lists = df.select("segment_id", "ordinal", F.explode("attributes").alias("key", "value")).cache()

    @settings(max_examples=12, deadline=None)
    @given(docs)
    def check(doc):
        e = f.parse(doc)
        want = {n for a, n in rows if brute(e, a)}
        assert {r["ordinal"] for r in df.where(f.to_column(e)).collect()} == want
        assert {r["ordinal"] for r in f.from_postings(e, lists, df).collect()} == want

    check()


def test_ratio_buckets(spark):
    rows = spark.createDataFrame([(a, s) for a, s in [(0, 100), (24, 100), (25, 100), (49, 100), (50, 100), (74, 100), (75, 100), (100, 100), (0, 0)]], "a int, s int")
    got = [r[0] for r in rows.select(f.ratio_bucket(F.col("a"), F.col("s"))).collect()]
    assert got == ["0-25", "0-25", "25-50", "25-50", "50-75", "50-75", "75-100", "75-100", "0-25"]
