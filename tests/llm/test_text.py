"""Encoding, decontamination and the pipeline against brute force."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from rowloom.llm import bpe, decontam, jaccard, lines
from rowloom.llm.queries import vocabulary

TEXTS = [
    "Hello world, it's 2024!  two  spaces\n\nlines\t ends ", "", None, "don't DON'T ''s 's's", "é ñ ß ² ½ \xa0nbsp\x85x\x1cy", "日本語 テキスト 🙂🙂 عربى", "a<|endoftext|>b <|endoftext|> <|endoftext|", "\0\0 \0\0\0", "x" * 5000, "ab " * 30_000,
    "Straße  \r\n naïve", " leading", "  ​ zero", "é combining",
]


def test_bpe_round_trip(spark):
    v = vocabulary()
    t = Tokenizer.from_str(v)
    rows = [(i, x, 1, "c") for i, x in enumerate(TEXTS)] + [(0, TEXTS[0], 2, "d"), (None, "null id", 3, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, extra string")
    out = bpe.decode(bpe.encode(df, v), v, out_col="decoded").collect()
    assert len(out) == len(rows)
    want = {(i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows}
    assert {(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out} == want
    assert sorted(r.decoded for r in out) == sorted(x or "" for _, x, *_ in rows)
    assert bpe.encode(df.limit(0), v).count() == 0
    both = bpe.encode(df, v, decoded_col="text").collect()
    assert {(r.doc_id, r.ids, r.text) for r in both} == {(r.doc_id, r.ids, r.decoded) for r in out}


def test_bpe_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 3)
    v = vocabulary()
    df = spark.createDataFrame([(i, TEXTS[i % 4]) for i in range(40)], "doc_id long, text string").repartition(3)
    t = Tokenizer.from_str(v)
    from rowloom.llm.common import cut

    out = bpe.encode(cut(df), v).collect()
    assert len(out) == 40 and all(tuple(np.frombuffer(r.ids, "<u4").tolist()) == tuple(t.encode(TEXTS[r.doc_id % 4] or "", add_special_tokens=False).ids) for r in out)


def test_decode_edges(spark):
    v = vocabulary()
    raw = [None, b"", np.array([50256, 99_999_999, 220], "<u4").tobytes(), np.array([447], "<u4").tobytes()]
    out = bpe.decode(spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, ids binary"), v).orderBy("i").collect()
    t = Tokenizer.from_str(v)
    assert [r.text for r in out] == [None, "", "<|endoftext|> ", t.decode([447], skip_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x2FF), max_size=40))
def test_words_are_those_of_the_library(text):
    split = bpe.Splitter(vocabulary())
    assert split.words(text) == [bytes(map(split.bytes.__getitem__, p)).decode() for p, _ in split.tokenizer.pre_tokenizer.pre_tokenize_str(text)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_scan(text, items, window=10):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        x = plain_words(t)
        for k in range(max(1, len(x) - window + 1)) if x else ():
            part = x[k : k + window]
            for p in range(len(w) - len(part) + 1):
                if w[p : p + len(part)] == part:
                    hit.update(range(p, p + len(part)))
                    found.add("" if i is None else str(i))
    return len(w), len(hit), sorted(found)


def bench_rows(rng):
    items = [(k, " ".join(rng.choice(list("abcde"), rng.integers(1, 25)))) for k in range(20)] + [(30, None), (31, ""), (32, "..."), (33, "É ñ"), (None, "zz yy"), (5, "zz yy xx")]
    docs = [(k, " ".join(rng.choice(list("abcdef"), rng.integers(0, 200)))) for k in range(40)] + [(100 + k, f"intro Words. {t} End" if t else t) for k, (_, t) in enumerate(items)] + [(200, "É, Ñ é ñ"), (201, "ZZ-yy/xx"), (202, None), (202, None)]
    return items, docs


@pytest.mark.parametrize("block_words", [1_000_000, 60])
def test_scan(spark, block_words):
    items, docs = bench_rows(np.random.default_rng(11))
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, items int")
    out = decontam.scan(df, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    assert len(out) == len(docs)
    want = {(i, *map(str, plain_scan(t, items))) for i, t in docs}
    assert {(r.doc_id, str(r.n_words), str(decontam.hit_words(r.hit_runs)), str(list(r["items"]))) for r in out} == want


def test_decontaminate(spark):
    item = " ".join(f"q{k}" for k in range(12))
    docs = [(1, f"Clean start. {item}. Clean end, {'and more ' * 10}"), (2, item.upper()), (3, "clean"), (4, None), (5, ""), (6, " ".join(item.split()[:9]))]
    df = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, items string")
    out = {r.doc_id: r.text for r in decontam.decontaminate(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert out == {1: f"Clean start. . Clean end, {'and more ' * 10}", 3: "clean", 4: None, 5: "", 6: docs[5][1]}
    same = decontam.decontaminate(df, spark.createDataFrame([], "item_id long, text string"))
    assert same.columns == df.columns and same.count() == len(docs)


def test_pipeline(spark, tmp_path):
    rng = np.random.default_rng(12)
    words = {"en": "the and with that from thing hold reading there which".split(), "de": "der und mit dass von ding halten lesend dort welche".split()}
    text = lambda lang: "\n".join(" ".join(rng.choice(words[lang], 12).tolist() + [f"n{rng.integers(10**6)}"]) for _ in range(5))
    item = " ".join(f"item{k}" for k in range(30))
    docs = [(i, text(k), k, "s", 0) for i, k in enumerate(["en", "de"] * 30)]
    docs += [(100, docs[0][1], "en", "s", 0), (101, docs[1][1].upper(), "de", "s", 0), (102, "12 34 !!", None, "s", 0), (103, None, "en", "s", 0), (104, f"{docs[2][1]} once more\n{text('en')} {item}", "en", "s", 0), (105, item, "en", "s", 0)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    kept, at = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id: r for r in at.collect()}
    ids = {i for i, *_ in docs}
    assert set(kept["language"]) == ids - {102, 103}
    assert set(kept["line_dedup"]) == ids - {100, 101, 102, 103}
    assert all(kept["line_dedup"][i].text == docs[i][1] for i in range(60))
    assert kept["line_dedup"][104].text.count("\n") <= 9 and kept["line_dedup"][104].n_chars == len(kept["line_dedup"][104].text)
    assert set(kept["near_copies"]) == set(kept["line_dedup"])
    assert set(kept["decontaminate"]) == set(kept["near_copies"]) - {105}
    assert item not in kept["decontaminate"][104].text and all(kept["decontaminate"][i].text == docs[i][1] for i in range(60))
    t = Tokenizer.from_str(vocabulary())
    assert all(np.frombuffer(kept["encode"][i].ids, "<u4").tolist() == t.encode(r.text, add_special_tokens=False).ids for i, r in kept["decontaminate"].items())
    assert {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {i: r.ids_sha256 for i, r in kept["encode"].items()}
    assert jaccard.need(40, 80) == 32 and lines.schemes(10) == (4, 1)


@pytest.mark.parametrize("name", ["op2_html", "op9_decontaminate"])
def test_sql(spark, name):
    """The queries that SQL can express, on the driver's smallest tables."""
    from pathlib import Path

    import duckdb

    from rowloom.llm import queries

    data = Path("/root/testdata/sf0.001")
    if not data.exists():
        pytest.skip("needs the driver's tables")
    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, str(data))
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall())
