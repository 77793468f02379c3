"""The numbered corpus operators as registered queries: thin digests over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, jaccard, lang, lines, merkle, periods, pii, quality, sentpiece, toxicity, vectors
from .common import held_out, table


@cache
def vocabulary(path: str | None = None) -> str:
    """The content of a tokenizer file, read where the job is planned and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text()


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), decoded_col="decoded")
    return found.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    filters = lang.train(docs.where("not held_out and lang is not null"))
    return lang.identify(docs.drop("lang"), filters).select("doc_id", "held_out", "lang_pred", "score")


def _learning(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out(F.col("doc_id"), 5, 0))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality.train(table(spark, sf_dir, "documents"), _learning(table(spark, sf_dir, "labels")), "quality")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return quality.score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(table(spark, sf_dir, "documents"), _learning(table(spark, sf_dir, "labels")), "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id"), 5, 0).alias("held_out"))
    return toxicity.severity(docs, model).select("doc_id", "held_out", "severity", "p_toxic", "toxic")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_account", "n_secret", "n_spans")


def op6_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.links(table(spark, sf_dir, "embeddings"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True, candidates="grams", min_words=1)
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed", ",").alias("removed"), F.sha2("text", 256).alias("text_sha256"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html.main_text(pages, html.train(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_runs", F.lit(0).cast("long"), lambda a, x: x - a)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit_runs") > 0).alias("contaminated"),
    )


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periods.detect(docs, repeat=F.crc32(F.col("doc_id").cast("string")))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": lower})


@cache
def piece_model(path: str | None = None) -> bytes:
    """The content of a model file, read where the job is planned and sent to the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Path(path).read_bytes()


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = sentpiece.encode(docs, piece_model(), decoded_col="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language": op1_language, "op2_html": op2_html, "op3_pii": op3_pii, "op4_quality": op4_quality, "op5_toxicity": op5_toxicity, "op6_vectors": op6_vectors, "op7_lines": op7_lines, "op8_jaccard": op8_jaccard, "op9_decontaminate": op9_decontaminate, "op10_bpe": op10_bpe, "op11_periods": op11_periods, "op12_merkle": op12_merkle, "op13_pieces": op13_pieces}


#: A-Z as a-z, then runs of letters, digits and all characters beyond ASCII.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

#: Unsigned crc32 of the id as text, bit by bit.
_CRC = "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"
_IDS = "CAST(doc_id AS VARCHAR) AS s"

_ORACLES = {
    # the article that every page of these tables has, as SQL can cut it out of markup this regular
    "op2_html": r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '</?(?:b|br)>', ' ', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts FROM a)
SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text, length(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10))) AS n_chars FROM b
""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS i, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT i, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS s FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS k, w FROM d, sizes WHERE len(w) >= n),
h AS (SELECT doc_id, k, n, i FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM p) JOIN win USING (n, s)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, i FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
""",
}

_ORACLES |= {
    # stretches of equal 16-grams at one distance are the diagonals of all runs; of one stretch's periods the smallest counts
    "op11_periods": rf"""
WITH i AS (SELECT row_number() OVER () AS r, doc_id, {_IDS}, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, {_CRC} AS h FROM i),
a AS (SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, (h // 10) % greatest(n, 1) AS a, (h // 10) % 8 AS m FROM h),
d AS (SELECT r, doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda k: w[1 + CASE WHEN k < a THEN k ELSE a + (k - a) % (1 + (n - a) // (3 + m)) END]) ELSE w END AS w FROM a),
g AS (SELECT r, n, k, array_to_string(w[k + 1:k + 16], ' ') AS g FROM (SELECT r, n, w, unnest(range(n - 15)) AS k FROM d WHERE n >= 24)),
p AS (SELECT x.r, x.k, y.k - x.k AS q FROM g x JOIN g y ON x.r = y.r AND x.g = y.g AND y.k > x.k AND 3 * (y.k - x.k) <= x.n),
s AS (SELECT r, q, min(k) AS a, max(k) + 16 + q - min(k) AS n FROM (SELECT r, q, k, k - row_number() OVER (PARTITION BY r, q ORDER BY k) AS island FROM p) GROUP BY r, q, island),
u AS (SELECT r, a, n, min(q) AS q FROM s WHERE n >= greatest(24, 3 * q) GROUP BY r, a, n),
o AS (SELECT r, count(*) AS n_runs, list({{'a': a, 'n': n, 'q': q}} ORDER BY n / q DESC, a, q) AS runs, string_agg(a || ',' || n || ',' || q || chr(10), '' ORDER BY a, q) AS listed FROM u GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, runs[1].a AS start, runs[1].n AS length, runs[1].q AS period, 1000 * runs[1].n // runs[1].q AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN n_runs > 0 THEN list_filter(w, lambda x, k: len(list_filter(runs, lambda z: k - 1 >= z.a + z.q AND k - 1 < z.a + z.n)) = 0) ELSE w END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN o USING (r)
""",
    # both trees level by level, then each leaf's climb past its siblings
    "op12_merkle": f"""
WITH RECURSIVE f AS (SELECT *, {_IDS} FROM documents),
t AS (SELECT *, CASE WHEN {_CRC} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS low FROM f),
e AS (SELECT doc_id, source, text, low, {" || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM t),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS folded FROM e),
n AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
low AS (SELECT tree, pos, 0 AS lev, leaf AS h, n FROM n UNION ALL SELECT tree, pos // 16, lev + 1, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM low WHERE n > 1 GROUP BY tree, pos // 16, lev),
subroots AS (SELECT tree, h FROM low WHERE n = 1),
top AS (SELECT tree AS pos, 0 AS lev, h, (SELECT count(*) FROM subroots) AS n FROM subroots UNION ALL SELECT pos // 16, lev + 1, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY pos // 16, lev),
nodes AS (SELECT tree, lev, pos, h, n FROM low UNION ALL SELECT -1, lev, pos, h, n FROM top),
sib AS (SELECT x.tree, x.lev, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS a, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS b
  FROM nodes x JOIN nodes y ON x.tree = y.tree AND x.lev = y.lev AND x.pos // 16 = y.pos // 16 WHERE x.n > 1 GROUP BY x.tree, x.lev, x.pos),
r AS (SELECT row_number() OVER () AS r, * FROM n),
c AS (SELECT r, tree, 0 AS lev, pos, folded, '' AS proof FROM r UNION ALL SELECT r, c.tree, c.lev + 1, c.pos // 16, sha256(a || folded || b), proof || a || b FROM c JOIN sib ON sib.tree = c.tree AND sib.lev = c.lev AND sib.pos = c.pos),
m AS (SELECT r, max(lev) AS lev FROM c GROUP BY r),
c2 AS (SELECT r, 0 AS lev, tree AS pos, folded, proof FROM c JOIN m USING (r, lev) UNION ALL SELECT r, c2.lev + 1, c2.pos // 16, sha256(a || folded || b), proof || a || b FROM c2 JOIN sib ON sib.tree = -1 AND sib.lev = c2.lev AND sib.pos = c2.pos),
m2 AS (SELECT r, max(lev) AS lev FROM c2 GROUP BY r)
SELECT doc_id, leaf, subroots.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, c2.folded AS folded_root, c2.folded = top.h AS verified
FROM r JOIN m2 USING (r) JOIN c2 USING (r, lev) JOIN subroots ON subroots.tree = r.tree, top WHERE top.n = 1
""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the four queries that it can express; the others are tested against brute force."""
    return dict(_ORACLES)
