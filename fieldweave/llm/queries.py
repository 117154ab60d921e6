"""Queries opN over the driver's tables; each derives its columns from its operator's output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import class_lm, embedding_dedup, fingerprints, jaccard_join, language_id, lexical_search, mixing, neighbours, packing, substring_dedup, token_counts, toxicity, whitening
from fieldweave.llm.split import held_out
from fieldweave.shared import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows and 8 MB at most (one text may be longer), where the session has
    Spark's defaults; settings of the caller's own stay."""
    for name, usual, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "8m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_repeated, beside the contract's columns: bytes of passages of 150 bytes or more that stand elsewhere too."""
    cut = substring_dedup.dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), shorter=substring_dedup.PASSAGE)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["high"] - r["low"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select("doc_id", n_bytes.alias("n_bytes"), gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("repeated").alias("n_repeated"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 1)
    fitted = class_lm.fit(docs.filter(~out).select("text"))
    return class_lm.score(docs.select("doc_id", out.alias("held_out"), "text"), fitted)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir).select("doc_id", "text"), held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs, ~out)
    return language_id.predict(docs.select("doc_id", "text", out.alias("held_out")), model)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbour_likeness(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.with_copies(docs, F.col("size"))
    return mixed.select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.col("__copies")).alias("taken"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(documents(spark, sf_dir))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector and component; entries beyond 2^52 / 1024 are held there, deviation is null where it is no long."""
    rows = whitening.usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    most = F.lit(float(1 << 52))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 1024, most), -most)).cast("long") + 100_000
    rows = settle(rows.select("vec_id", F.transform("embedding", whole).alias("x")))
    summary = whitening.fit(rows, "x")
    if summary is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = settle(whitening.whiten(rows, "x", summary, 8))
    error = whitening.identity_error(whitening.fit(white, "whitened"))
    e, _ = summary.components()
    sums = F.array(*[F.lit(int(s)) for s in summary.sums])
    apart = F.zip_with("x", sums, lambda x, s: F.try_subtract(F.try_multiply(x, F.lit(summary.n)), s))
    deviation = F.aggregate(apart, F.lit(0).cast("long"), lambda total, d: F.try_add(total, F.try_multiply(d, d)))
    explained = F.array(*[F.lit(float(x)) for x in e / e.sum()])
    each = white.select("vec_id", F.lit(summary.n).cast("long").alias("n"), deviation.alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_class_lm, op3_nearest_neighbours, op4_jaccard_join, op5_token_counts, op6_toxicity, op7_language_id, op8_packing, op9_fingerprints, op10_mixing, op11_lexical_search, op12_embedding_dedup, op13_whitening)}

ORACLE_SQL = {
    "op3_nearest_neighbours": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM v WHERE len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM u q JOIN u c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, l.y FROM reach JOIN l ON reach.other = l.x)
SELECT d.doc_id, (SELECT min(other) FROM reach WHERE reach.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links FROM documents d
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS BIGINT) AS size_left, CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS weights_left
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap * weights_left <= weight * size_left AS stops FROM l),
r AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(CASE WHEN stops THEN cap END) OVER (), 0) AS BIGINT) AS rest, CAST(sum(CASE WHEN NOT stops THEN weight END) OVER () AS BIGINT) AS rest_weight FROM c),
t AS (SELECT source, source_size, CASE WHEN stops THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) END AS target FROM r),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
             CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
""",
    "op11_lexical_search": r"""
WITH d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
p AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM o GROUP BY doc_id, term),
z AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY doc_id),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM z),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM z, g),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""",
    "op12_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e)) / sqrt(list_inner_product(b.e, b.e)) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, l.y FROM reach JOIN l ON reach.other = l.x),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c USING (vec_id)
""",
}
