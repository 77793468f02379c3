"""Piece encoding and decoding against the library, on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowloom.llm import queries, sentpiece

PARTS = [" ", "  ", "\n", "a", "e", "t", "th", "ing", "▁", "日", "本", "é", "😀", "\u0000", "�", ".", "1", "the ", "<s>", "<unk>", "<0x41>", "ß", "ż", "\t", "ؠ", "Ω"]


@pytest.fixture(scope="module")
def vocabulary():
    return sentpiece.Vocabulary(queries.piece_model())


def texts(seed=3, n=800):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 300, "▁" * 77, "abc" * 4000, "", " ", "a ", " a"]


def test_texts_against_the_library(vocabulary):
    found = texts()
    ids = sentpiece.encode_texts(found, vocabulary)
    assert [x.tolist() for x in ids] == vocabulary.library.encode(found)
    assert sentpiece.decode_ids(ids, vocabulary) == [vocabulary.library.decode(x.tolist()) for x in ids]


def test_any_ids_decode_as_in_the_library(vocabulary):
    rng = random.Random(4)
    rows = [rng.choices(range(32000), k=rng.randint(0, 9)) + rng.choices(range(262), k=rng.randint(0, 9)) for _ in range(800)]
    for r in rows:
        rng.shuffle(r)
    assert sentpiece.decode_ids([np.array(r, np.int64) for r in rows], vocabulary) == [vocabulary.library.decode(r) for r in rows]


def test_both_agendas_agree(vocabulary):
    """Units taken in step and units with a heap of their own give the same merges."""
    rng = random.Random(6)
    units = [[vocabulary.symbols[ord(c)].item() for c in "".join(rng.choices("▁thesandior", k=rng.randint(1, 40)))] for _ in range(500)]
    flat, sizes = sentpiece.in_step(np.array([s for u in units for s in u], np.int64), np.array([len(u) for u in units]), vocabulary)
    assert flat.tolist() == [s for u in units for s in sentpiece.agenda(u, vocabulary.pair)] and sizes.sum() == len(flat)


def test_equal_hashes_are_told_apart(vocabulary, monkeypatch):
    monkeypatch.setattr(sentpiece, "run_hashes", lambda codes, a, b: (b - a).astype(np.uint64))
    found = texts(7, 50)
    assert [x.tolist() for x in sentpiece.encode_texts(found, vocabulary)] == vocabulary.library.encode(found)


def test_differences_stop_the_job(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary, "rank", vocabulary.rank[::-1].copy())
    with pytest.raises(RuntimeError, match="differ"):
        sentpiece.encode_texts(["the quick brown fox jumps over the lazy dog"], vocabulary)


def test_query_against_the_library(spark, tmp_path, vocabulary):
    docs = [*enumerate(texts(8, 300)), (None, "no id"), (None, None), (901, None), (901, None), (902, "twice"), (902, "twice"), (903, "long word " * 30_000)]
    spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, IDS string, decoded string").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in docs:
        ids = vocabulary.library.encode(t or "")
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(vocabulary.library.decode(ids)))] += 1
    assert Counter(tuple(r) for r in queries.op13_pieces(spark, str(tmp_path)).collect()) == want


def test_decode_of_a_table(spark):
    df = spark.createDataFrame([(1, "a  b é", "x"), (2, None, "y")], "id int, t string, text string")
    ids = sentpiece.encode(df, queries.piece_model(), "t")
    assert [(r.id, r.text) for r in sentpiece.decode(ids, queries.piece_model()).orderBy("id").collect()] == [(1, "a  b é"), (2, "")]
    assert sentpiece.decode(ids.selectExpr("id", "cast(null as array<int>) as ids"), queries.piece_model()).where("text is null").count() == 2
    assert sentpiece.encode(df.limit(0), queries.piece_model(), "t").count() == 0
