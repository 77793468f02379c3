"""Learned operators: held-out accuracy on small invented corpora, and the edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import lang, pii, quality, toxicity
from rowloom.llm.common import held_out

WORDS = {"en": "the and with that from thing hold reading".split(), "de": "der und mit dass von ding halten lesend".split(), "fr": "le et avec que dans chose tenir lisant".split()}
EDGES = [(900, None), (901, ""), (902, "12 !! 34"), (903, "the " * 40_000), (904, "\n\t "), (905, "a"), (906, "日本語 テキスト")]
EDGE_IDS = [i for i, _ in EDGES]


def corpus(spark, n=120):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS[k], 30)), k) for i, k in enumerate(np.resize(list(WORDS), n).tolist())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def edges(spark):
    return spark.createDataFrame([(i, t, "x", None) for i, t in EDGES + EDGES[:1]], "doc_id long, text string, score string, SEVERITY double")


def test_language(spark):
    docs = corpus(spark)
    filters = lang.train(docs.where(~held_out(F.col("doc_id"), 3, 1)))
    assert np.all(filters.false_positives < 0.01)
    wrong = lang.identify(docs, filters).where("lang_pred <> lang").count()
    assert wrong == 0
    out = {r.doc_id: (r.lang_pred, r.score) for r in lang.identify(edges(spark), filters).collect()}
    assert out[900] == out[901] == out[902] == out[904] == ("und", 0.0)
    assert out[903][0] == "en" and out[905][0] in WORDS and out[906][0] in WORDS
    assert lang.identify(edges(spark).limit(0), filters).count() == 0
    kept = lang.keep_known(edges(spark), filters)
    assert kept.columns == edges(spark).columns and {r.doc_id for r in kept.collect()} >= {903, 905}
    nothing = lang.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in lang.identify(edges(spark), nothing).collect()} == {("und", 0.0)}


def test_language_filters_hold_their_ngrams(spark):
    filters = lang.train(corpus(spark))
    letters = lang._letters()
    hashes, grams, some = lang.ngrams(["the thing", "", "x"], letters)
    assert grams.tolist()[1] == 0 and some.tolist() == [True, False, True]
    masks = filters.rows(hashes[: grams[0]])
    assert ((masks >> masks.dtype.type(filters.languages.index("en"))) & masks.dtype.type(1)).all()


def test_long_text_in_pieces(spark):
    filters = lang.train(corpus(spark))
    text = " ".join(WORDS["de"] * 200)
    whole, parts = (filters.predict([text, None, "the and"], lang._letters(), piece=p) for p in (1_000_000, 50))
    assert whole == parts and whole[0] == ["de", "und", "en"]


def labelled(spark):
    docs = corpus(spark, 400)
    noisy = (F.col("doc_id") % 4 == 0).cast("int")
    text = F.when(noisy == 1, F.regexp_replace("text", " ", "### ")).otherwise(F.col("text"))
    return docs.withColumn("text", text), docs.select("doc_id", (1 - noisy).alias("quality"))


def test_quality(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "quality")
    out = quality.score(docs, model).join(labels, "doc_id")
    assert out.where("(score >= 0.3) <> (quality = 1)").count() == 0
    scores = {r.doc_id: r.score for r in quality.score(edges(spark), model).collect()}
    assert set(scores) == set(EDGE_IDS) and all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901]
    one = quality.train(docs, labels.where("quality = 1"), "quality")
    assert quality.score(docs, one).where("score < 0.99").count() == 0
    none = quality.train(docs, labels.limit(0), "quality")
    assert quality.score(docs, none).where("score <> 0.5").count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(100, 400, 20), 1 if y else 2)).astype(np.int32) for y in (np.arange(300) % 2)]
    model = quality.fit(rows, np.arange(300) % 2)
    assert all((model.score(x) > 0.5) == bool(k % 2) for k, x in enumerate(rows))


def toxic_rows(spark):
    docs = corpus(spark, 400)
    bad = F.col("doc_id") % 5 == 0
    insults = F.when(F.col("doc_id") % 10 == 0, F.lit("moron clown scum loser")).otherwise(F.lit("moron"))
    return docs.withColumn("text", F.when(bad, F.concat("text", F.lit(" "), insults)).otherwise(F.col("text"))), docs.select("doc_id", bad.cast("int").alias("toxic"))


def test_toxicity(spark):
    docs, labels = toxic_rows(spark)
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0)), "toxic")
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.severity(docs, model).join(labels.withColumnRenamed("toxic", "label"), "doc_id")
    assert out.where("toxic <> (label = 1)").count() == 0
    means = {r.k: r.s for r in out.where("label = 1").groupBy((F.col("doc_id") % 10).alias("k")).agg(F.avg("severity").alias("s")).collect()}
    assert means[0] > means[5] > 0.5
    edge = toxicity.severity(edges(spark), model)
    assert edge.columns.count("severity") == 1 and edge.where("toxic").count() == 0
    assert toxicity.severity(docs, toxicity.train(docs, labels.where("toxic = 0"), "toxic")).where("toxic").count() == 0


def test_ordinal_fit_shares_weights():
    grades = np.repeat([0, 1, 2, 3], 40)
    weights, thresholds = toxicity.fit([{0: float(g), 1: 1.0} for g in grades], grades, 2)
    assert weights[0] > 1 and (np.diff(thresholds) > 0).all()


PII = [
    "mail a.b-c@mail.example.com now", "x@y.z@w.v", "no @ here a@b", "ip 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5.6.7.8", "card 4111 1111-1111 1111 or 4111111111111112", "+1 (407) 555-7710, +12", "0000000000000000",
    'password = "hunter2hunter2hunter2"', "jane (at) example (dot) com", "", "é 10.0.0.1", "a" * 50_000 + "@" + "b.c" * 10, "1" * 50_000, "+" * 1000 + "1-" * 5000,
]


def plain_base(t):
    import re

    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if len(t) < 1000 else None
    if out is None:
        return None
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [(k, a, b) for a, _, k, b in sorted(out)]


def test_pii_base():
    for t in PII:
        base, _ = pii.choose(t, pii.Trees())
        want = plain_base(t)
        assert want is None or base == want, t


def test_pii_trees(spark):
    rng = np.random.default_rng(5)
    key = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'some text token = "{key()}" and on, code = aaaaaaaaaaaaaaaaaaaa') for i in range(80)] + [(i, f"call +1 (407) 555-{i:04d} or {i}{i}12 345 678 901 2{i}") for i in range(80, 160)]
    docs = spark.createDataFrame(rows + [(200, None), (201, "")], "doc_id long, text string")
    model = pii.train(docs)
    out = {r.doc_id: r for r in pii.find(docs, model).collect()}
    secret = [r for i, r in out.items() if i < 80]
    assert sum("secret" in r.spans for r in secret) >= 78 and all(r.spans.count("secret") <= 1 for r in secret)
    assert all(r.n_phone == 1 and r.base in r.spans for i, r in out.items() if 80 <= i < 160)
    assert out[200].spans == out[201].spans == ""
    text = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert text[200] is None and "[PHONE]" in text[100] and "555" not in text[100]
    assert pii.train(docs.limit(0)).trees == []


def test_each_name_is_defined_once():
    """No function of the package is replaced by a later copy of it."""
    import ast
    from pathlib import Path

    for path in Path(quality.__file__).parents[1].rglob("*.py"):
        for scope in (n for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.Module | ast.ClassDef)):
            names = [n.name for n in scope.body if isinstance(n, ast.FunctionDef | ast.ClassDef)]
            assert len(names) == len(set(names)), path


def test_bound_of_the_quality_fit(spark, monkeypatch):
    """The driver holds no more indicators than allowed, whatever the sampled texts' length; long words differ to their ends."""
    docs = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" + ("!" if k % 2 else "?") * (1 + j % 3) + "ab"[k % 2] * (j % 9) for j in range(400))) for k in range(200)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as good")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append((len(rows), sum(map(len, rows)))) or "model")
    assert quality.train(docs, labels, "good") == "model" and quality.train(docs, labels, "good", indicators=seen[0][1] // 4) == "model"
    assert seen[0][0] == 200 and 0 < seen[1][1] < 0.4 * seen[0][1]
    assert quality.shape("ab1-" * 20 + "X") != quality.shape("ab1-" * 20 + "y")


def test_quality_fit_against_a_plain_solver():
    """The dual coordinate descent reaches the minimum of the hinge loss that small steps down its gradient find."""
    rng = np.random.default_rng(3)
    rows, y = [], []
    for k in range(40):
        y.append(k % 2)
        rows.append(np.unique(np.concatenate([rng.choice(np.arange(30), 6), rng.choice(np.arange(30, 36) if k % 2 else np.arange(36, 42), 2)])).astype(np.int32))
    y = np.array(y)
    model = quality.fit(rows, y, rounds=2000)
    counts = [np.full(1 << quality.BITS, 1.0) for _ in range(2)]
    for x, t in zip(rows, y, strict=True):
        counts[t][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    sign = np.where(y > 0, 1.0, -1.0)
    a = np.zeros((40, 43))
    for k, x in enumerate(rows):
        a[k, x] = ratio[x]
        a[k, 42] = 1
    loss = lambda w: 0.5 * (w**2).sum() + 0.1 * np.maximum(0, 1 - sign * (a @ w)).sum()
    w = np.zeros(43)
    best = loss(w)
    for n in range(60_000):
        w = w - (w - 0.1 * a.T @ (sign * (sign * (a @ w) < 1))) / (n + 10)
        best = min(best, loss(w))
    own = np.append(np.where(ratio[:42] != 0, model.weights[:42] / np.where(ratio[:42] != 0, ratio[:42], 1), 0), model.bias)
    assert loss(own) <= best * 1.01 + 1e-6


def test_quality_of_very_long_texts(spark):
    docs = spark.createDataFrame([(k, ("good words of prose here. " if k % 2 else "!!! ### $$$ %%% ") * (40_000 if k < 4 else 5)) for k in range(60)], "doc_id long, text string")
    model = quality.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as good"), "good")
    out = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((out[k] > 0.5) == bool(k % 2) for k in range(4))
