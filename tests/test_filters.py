from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiverlake.functions.filters import BadFilter, Clause, from_equalities, from_messages, from_text, from_tuples, matches, number, parse_number


@pytest.fixture(scope="module")
def things(spark):
    """30 rows; the first has no metadata, the others a price and one of three tiers."""
    data = [(i, None if i == 0 else {"price": str(i), "tier": "abc"[i % 3]}) for i in range(30)]
    return spark.createDataFrame(data, "id int, metadata map<string,string>").cache()


@pytest.mark.parametrize(
    "clauses, n",
    [
        ([Clause("tier", "eq", "a")], 9),
        ([Clause("tier", "ne", "a")], 21),
        ([Clause("tier", "in", "", ("a", "b"))], 19),
        ([Clause("tier", "not_in", "", ("a", "b"))], 11),
        ([Clause("price", "gt", "20")], 9),
        ([Clause("price", "gte", "20")], 10),
        ([Clause("price", "lt", "5")], 4),
        ([Clause("price", "lte", "5")], 5),
        ([Clause("price", "exists")], 29),
        ([Clause("tier", "eq", "b"), Clause("price", "gt", "10"), Clause("price", "lte", "22")], 4),
        ([], 30),
    ],
)
def test_truth_table(things, clauses, n):
    assert things.where(matches(clauses)).count() == n


def test_bad_clauses(things):
    for c in [Clause("", "eq", "x"), Clause("a", "like", "x"), Clause("a", "in"), Clause("a", "gt", "ten"), Clause("a", "gt", "NaN"), Clause("a", "in", "", tuple("x" * 1025))]:
        with pytest.raises(BadFilter):
            matches([c])
    with pytest.raises(BadFilter):
        matches([Clause("a", "exists")] * 33)


def test_numbers(spark):
    texts = ["1", " 1", "1d", "1e400", "-1e400", "NaN", "inf", "-Infinity", "+.5", "5.", "0x1p-2", "-0x1.8p1", "0x10", "30\n", "1_0", "", "1e-3", ".", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(number(F.col("v"))).collect()]
    want = [1.0, None, None, None, None, None, math.inf, -math.inf, 0.5, 5.0, 0.25, -3.0, None, None, None, None, 0.001, None, None]
    assert got == want
    assert [None if t is None else parse_number(t) for t in texts] == want


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_parse_number_reads_all_floats(x):
    assert parse_number(repr(x)) == x


def test_surfaces():
    assert from_equalities({"b": "2", "a": "1"}) == [Clause("a", "eq", "1"), Clause("b", "eq", "2")]
    assert from_messages([{"key": "a", "op": "in", "value": "x"}]) == [Clause("a", "in", "x", ("x",))]
    assert from_messages([{"key": "a", "op": "exists"}]) == [Clause("a", "exists", "", ())]
    assert from_tuples([("p", "gte", 15)])[0].value == "15"
    assert from_text(["a=b"], ["p:gte:15", "t:in:a,b", "q:exists"]) == [Clause("a", "eq", "b", ("b",)), Clause("p", "gte", "15"), Clause("t", "in", "a,b", ("a", "b")), Clause("q", "exists")]
    with pytest.raises(BadFilter):
        from_messages([{"key": "a", "op": "nope"}])
    with pytest.raises(BadFilter):
        from_text(["novalue"])
