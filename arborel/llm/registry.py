"""The queries of the corpus operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborel.llm import gam, hmm, langid, mixing, pii, toxicity, urls
from arborel.llm.common import fold, table
from arborel.llm.minhash import near_duplicates
from arborel.llm.neighbours import nearest
from arborel.llm.packing import pack
from arborel.llm.ranked import search
from arborel.llm.vectordups import near_duplicate_vectors
from arborel.llm.whitening import whiten


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), bounded=True, keep_text=False)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "weight", "sampled")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs.where(~F.col("held_out")), labels)
    return toxicity.score(docs.select("doc_id", "held_out", "text"), model)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs.select("doc_id", "text"), pii.fit(docs))
    counts = [F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("found").alias("spans"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), model)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = gam.fit(docs.where(~F.col("held_out")), labels)
    return gam.score(docs.select("doc_id", "held_out", "text"), model)


QUERIES = {"op1_neighbours": op1_neighbours, "op2_hmm": op2_hmm, "op3_minhash": op3_minhash, "op4_mixing": op4_mixing, "op5_urls": op5_urls, "op6_toxicity": op6_toxicity, "op7_pii": op7_pii, "op8_vectors": op8_vectors, "op9_language": op9_language, "op10_packing": op10_packing, "op11_whitening": op11_whitening, "op12_ranked": op12_ranked, "op13_quality": op13_quality, "pipeline": corpus_pipeline.run}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
_REACHED = "r(x, y) AS (SELECT id, id FROM ids UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), c AS (SELECT x, min(y) AS low FROM r GROUP BY x)"
_WHOLE = "ok AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"

ORACLE_SQL: dict[str, str] = {
    "op1_neighbours": f"WITH {_WHOLE}, d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS n FROM d) SELECT query_id, n::INT AS rank, vec_id, score FROM o WHERE n <= 10",
    "op3_minhash": f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda t: t <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ids AS (SELECT doc_id AS id FROM documents), {_REACHED}
SELECT doc_id, len(s)::BIGINT AS n_shingles, low AS component_id, low = doc_id AS kept FROM s JOIN c ON c.x = doc_id""",
    "op8_vectors": f"""WITH RECURSIVE {_WHOLE}, p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
ids AS (SELECT vec_id AS id FROM embeddings), {_REACHED}
SELECT id AS vec_id, (SELECT count(*) FROM p WHERE p.x = id) AS n_links, low AS component_id, low = id AS kept FROM ids JOIN c ON c.x = id""",
    "op12_ranked": rf"""WITH tk AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS t FROM documents),
st AS (SELECT count_if(len(t) > 0)::BIGINT AS N, sum(len(t))::BIGINT AS L FROM tk), tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(N) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term),
m AS (SELECT doc_id, 50 + (50 * len(t) * N) // greatest(L, 1) AS m FROM tk, st),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s) SELECT item_id, n::INT AS rank, doc_id, score FROM o WHERE n <= 50""",
}
