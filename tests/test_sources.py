"""Files in and out, parameters, cells, workers."""

import hashlib

from pyspark.sql import functions as F

from rowloom import sources
from rowloom.functions import cells as c
from rowloom.operators import runs
from rowloom.operators.base import number_rows

GOLDEN = "Scandal,Awesome!,2012,2018\nBuffy the Vampire Slayer,Awesome!,1996,2003\nAngel,Not So Awesome,1999,2004\n"


def test_golden_csv(spark, tmp_path):
    rows = spark.createDataFrame([tuple(x.split(",")) for x in GOLDEN.splitlines()], "a string, b string, c string, d string").coalesce(1)
    sources.write_csv(rows, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert hashlib.md5(data).hexdigest() == hashlib.md5(GOLDEN.encode()).hexdigest()


def test_csv_round_trip(spark, tmp_path):
    cells = [("a\nb", 'say "x"', ""), (" c ", "d,e", "é")]
    df = spark.createDataFrame(cells, "a string, b string, c string").coalesce(1)
    sources.write_csv(df, str(tmp_path / "out"), "\r\n")
    back = sources.read_uploaded_table(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(cells)


def test_append_is_rerun_safe(spark, tmp_path):
    path = str(tmp_path / "ds")
    for n, run in ((3, 1), (2, 2), (4, 2)):
        sources.append_run(spark.range(n), path, 1, run)
    data = spark.read.parquet(path)
    assert sources.dataset_all_runs(data, 1).count() == 7 and sources.dataset_this_run(data, 2).count() == 4


def test_params(spark):
    def read(blob):
        return spark.range(1).select(sources.parse_params(F.lit(blob)).alias("p")).first().p

    assert read("param1='this is a string',param2='test.com/search?q=test'") == {"param1": "this is a string", "param2": "test.com/search?q=test"}
    assert read(r"x='a\, b\, and c'") == {"x": "a, b, and c"}
    assert read("foo=bar") == {"foo": "a"} and read("") == {} and read(None) == {} and read("a='1',a='2'") == {"a": "2"}


def test_numbering_and_slices(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 25), ("b", 3)) for i in range(n)], "g string, i int").repartition(7)
    out = {(r.g, r.i): r.row_idx for r in number_rows(df, ["i"], ["g"]).collect()}
    assert out == {(g, i): i + 1 for g, i in out} and len(out) == 28
    assert {r.row_idx for r in number_rows(df, ["g", "i"]).collect()} == set(range(1, 29))
    assert max(r.slice_no for r in sources.write_in_slices(df, ["i"], ["g"]).collect()) == 2


def test_shares_are_disjoint_and_whole(spark):
    df = spark.range(200).withColumn("k", F.col("id").cast("string"))
    parts = [{r.id for r in runs.hash_slice(df, ["k"], 3, i).collect()} for i in range(3)]
    assert sum(map(len, parts)) == 200 and set().union(*parts) == set(range(200))


def test_run_names(spark):
    names = ["128_4_noprofile_lockBased", "155_8_distributed_lockBased", "shop+escope+loc2+run1", "odd"]
    out = {r.name: (r.program, r.threads, r["mode"], r.variant, r.location, r.round) for r in runs.with_run_names(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert out == {names[0]: ("128", 4, "lockBased", None, None, None), names[1]: ("155", 8, "distributed_lockBased", None, None, None), names[2]: ("shop", None, None, "escope", 2, 1), names[3]: ("odd", None, None, None, None, None)}


def test_cells(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    items = F.array(F.lit("10"), F.lit("9"), F.lit("b"), F.lit("A"), F.lit("9"))
    assert one(c.list_sort(items, "NUMERIC")) == ["b", "A", "9", "9", "10"] and one(c.list_sort(items, "IGNORE_CASE", True)) == ["b", "A", "9", "9", "10"]
    assert one(c.list_modes(items)) == ["9"] and one(c.list_sum(items)) == 28 and one(c.list_median(items)) == 9
    assert one(c.list_average(F.array(F.lit("x")))) is None and one(c.list_median(F.array().cast("array<string>"))) is None
    assert one(c.text_index_of(F.lit("banana"), "an")) == 1 and one(c.text_index_of(F.lit("banana"), "an", last=True)) == 3 and one(c.text_index_of(F.lit("x"), "y", one_based=True)) == 0
    assert one(c.text_substring(F.lit("abcdef"), -3, -2)) == "de" and one(c.text_char_at(F.lit("abc"), "from_end", 1)) == "b"
    assert [one(c.is_prime(F.lit(n))) for n in (-3, 0, 1, 2, 3, 4, 9, 25, 97, 7919)] == [False, False, False, True, True, False, False, False, True, True]
    assert one(c.number_is(F.lit(4), "divisible_by", 0)) is False and one(c.arithmetic(F.lit(-7), "%", F.lit(3))) == 2 and one(c.arithmetic(F.lit(1), "/", F.lit(0))) is None
    assert one(c.list_split(F.lit("a.b.c"), ".")) == ["a", "b", "c"] and one(c.concat(F.lit(None), F.lit(1))) == "1"
    assert one(c.canonical_json(F.lit('{"b": 2, "a": 1, "c": null}'), "map<string,int>")) == '{"a":1,"b":2}'
    assert one(c.trim(F.lit("\t a b \n"))) == "a b" and one(c.list_set(F.array(F.lit(1), F.lit(2)), 1, F.lit(9))) == [1, 9]
