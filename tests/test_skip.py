"""The documented examples of skip keys, and the greedy rule against a plain loop."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowloom.operators import skip

FRIENDS = [
    (1, "Alice", "37", "Feb 2, 1979", "555-555-5555", "1234 Lane Street", "A"), (2, "Alice", "38", "Feb 2, 1979", "555-555-5555", None, "A"),
    (3, "Bob", "37", "Jan 1, 1979", "777-777-7777", "", "B"), (4, "Bob", "38", "May 20, 1979", "999-999-9999", "9876 Drive Run", "C"),
]
KEYS = {"phone": (["phone"], [1, 3, 4]), "name+birthday": (["name", "birthday"], [1, 3, 4]), "name": (["name"], [1, 3]), "name+age": (["name", "age"], [1, 2, 3, 4]), "address": (["address"], [1, 2, 4])}


def friends(spark):
    return spark.createDataFrame(FRIENDS, "n int, name string, age string, birthday string, phone string, address string, truth string")


def test_documented_keys(spark):
    for keys, kept in KEYS.values():
        once = skip.skip_ever(friends(spark), None, keys, ["n"])
        assert sorted(r.n for r in once.collect()) == kept
        assert sorted(r.n for r in skip.skip_ever(once, None, keys, ["n"]).collect()) == kept
        assert skip.skip_ever(friends(spark), once, keys, ["n"]).count() == 0


def test_key_quality_and_report(spark):
    quality = {k: tuple(skip.key_quality(friends(spark), keys, "truth").first()) for k, (keys, _) in KEYS.items()}
    assert quality == {"phone": (0, 0), "name+birthday": (0, 0), "name": (1, 0), "name+age": (0, 1), "address": (1, 1)}
    report = {r.key_name: r for r in skip.key_report(friends(spark), {k: v[0] for k, v in KEYS.items()}).collect()}
    assert (report["address"].n_keys, report["address"].n_empty, report["address"].largest, report["address"].n_dropped) == (3, 2, 2, 1)


def test_empty_tables(spark):
    none = friends(spark).limit(0)
    assert skip.skip_ever(none, none, ["name"], ["n"]).count() == 0
    assert skip.skip_last_runs(none.withColumnRenamed("n", "run_no"), ["name"], 2, ["run_no"]).count() == 0
    assert skip.key_report(none, {"a": ["name"]}).first().n_rows == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.integers(0, 40)), max_size=40), st.integers(0, 12))
def test_greedy(spark, rows, limit):
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "i int, k string, t int")
    last, want = {}, []
    for i, (k, t) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        k = k or ""
        if k not in last or t - last[k] > limit:
            want.append(i)
            last[k] = t
    assert sorted(r.i for r in skip.skip_last_runs(df, ["k"], limit, ["t", "i"], run_no="t").collect()) == sorted(want)


def test_since_commit_and_sighting(spark):
    days = spark.createDataFrame([(0, "x"), (6, "x"), (12, "x")], "day int, k string")
    assert sorted(r.day for r in skip.skip_last_runs(days, ["k"], 10, ["day"], "day").collect()) == [0, 12]
    assert sorted(r.day for r in skip.skip_last_runs(days, ["k"], 10, ["day"], "day", since="sighting").collect()) == [0]
    before = spark.createDataFrame([("x", 0.0)], "k string, kept_at double")
    assert sorted(r.day for r in skip.greedy(days, ["k"], days.day, 10, ["day"], before).collect()) == [12]


def test_history_and_commit(spark, tmp_path):
    path = str(tmp_path / "keys")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, ts double")
    for run in (1, 2, 2):
        skip.commit(rows, ["k"], path, 7, run)
    kept = spark.read.parquet(path)
    assert kept.count() == 4
    runs = spark.createDataFrame([(7, 1, True, True), (7, 2, True, False), (8, 1, True, True)], "program_id long, run_id long, has_skip boolean, complete boolean")
    assert skip.history(kept, runs, 7).count() == 2
    assert skip.history(kept, runs, 8).count() == 0
    assert skip.compact(kept, ["k"]).count() == 2


def test_hierarchy(spark):
    parents = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "p int, name string")
    children = spark.createDataFrame([(1, 1, "c"), (2, 2, "d"), (3, 3, "c"), (4, 3, "e")], "c int, p int, item string")
    kept, inside = skip.skip_hierarchical(parents, children, "p", "p", lambda d: skip.skip_ever(d, None, ["name"], ["p"]), lambda d: skip.skip_ever(d, None, ["item"], ["c"]))
    assert sorted(r.p for r in kept.collect()) == [1, 3]
    assert sorted(r.c for r in inside.collect()) == [1, 4]
