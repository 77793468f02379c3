"""All rows compared for the sets of columns that may be keys."""

import pytest

from rowloom.operators import skip


@pytest.mark.parametrize("slices", [1, 64, 10**9])
def test_one_repeated_row_among_many(spark, slices):
    """a and b, c and null b: one pair of equal rows in 5,000 is found, whatever the slice; the pieces of a partition come from several batches."""
    rows = [(i % 2500, i // 2500 if i != 4999 else 0, f"c{i}" if i < 4000 else f"d{i}", None if i % 2 else "") for i in range(5000)]
    table = spark.createDataFrame(rows, "a long, b long, c string, e string").repartition(5)
    got = {tuple(r.key) for r in skip.minimal_keys(table, ["a", "b", "c", "e"], 3, slices=slices).collect()}
    assert got == {("c",)}
    whole = table.where("c <> 'd4999'")
    assert {tuple(r.key) for r in skip.minimal_keys(whole, ["a", "b", "c", "e"], 3, slices=slices).collect()} == {("c",), ("a", "b")}


def test_what_is_exchanged(spark):
    """Rows leave their task as four bytes each and set, not as digests of their own."""
    table = spark.range(0, 300_000, 1, 4).selectExpr("id as a", "id * 7 as b")
    assert skip._repeated(table, [("a",), ("b",), ("a", "b")], 300_000) == set()
    assert skip._repeated(table.union(table.where("a = 77")), [("a",), ("b",), ("a", "b")], 300_001) == {0, 1, 2}
    assert skip._repeated(table.union(table.where("a = 77").selectExpr("a", "-1 as b")), [("a",), ("b",), ("a", "b")], 300_001) == {0}
