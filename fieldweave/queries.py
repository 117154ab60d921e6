"""Queries over the driver's tables, with their DuckDB equivalents.

The tables hold no labelled name pairs, so most queries work on pairs derived from ``part``: with
duplicates, messy labels, contradictions, blanks and invalid labels (see ``pairs``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.config import MatcherConfig
from fieldweave.functions import text
from fieldweave.operators import grouping, metrics, negatives, quality, vocabulary
from fieldweave.operators.retrieval import cosine_top_k
from fieldweave.shared import settle

_PAIRS = """
WITH base AS (
  SELECT p_partkey k, p_name || ' ' || CAST(p_size AS {string}) a,
         p_brand || '.' || p_type || '-' || CAST(p_partkey % 40 AS {string}) b,
         CASE WHEN p_size % 10 < 4 THEN 'DIRECT' WHEN p_size % 10 < 7 THEN 'DERIVATION' ELSE 'NO_MATCH' END label
  FROM part)
SELECT k * 10 + 2 AS source_row, a AS A, b AS B, label FROM base
UNION ALL SELECT k * 10 + 3, a, b, ' ' || lower(label) || ' ' FROM base WHERE k % 10 = 0
UNION ALL SELECT k * 10 + 4, replace(a, ' ', '-'), replace(b, '.', ' '), 'NO_MATCH' FROM base WHERE k % 15 = 0
UNION ALL SELECT k * 10 + 5, CASE WHEN k % 50 = 0 THEN '' ELSE ' _.- ' END, b, label FROM base WHERE k % 25 = 0
UNION ALL SELECT k * 10 + 6, a, b, 'OTHER' FROM base WHERE k % 40 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived pairs, through the SQL that the oracles use too."""
    return spark.sql(_PAIRS.format(string="STRING").replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written once: the queries read it two or more times
    return settle(quality.valid_rows(quality.classify_rows(pairs(spark, sf_dir))))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(quality.clean_rows(_valid(spark, sf_dir)))


def _split_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean pairs with splits that leak on purpose."""
    name = F.element_at(F.array(*map(F.lit, grouping.SPLITS)), (F.col("source_row") % 3 + 1).cast("int"))
    return _clean(spark, sf_dir).withColumn("split", name)


def q01_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = pairs(spark, sf_dir)
    names = raw.select(F.col("A").alias("raw")).union(raw.select("B")).union(table(spark, sf_dir, "customer").select("c_name")).union(table(spark, sf_dir, "part").select("p_brand"))
    return text.with_normalized(names.distinct(), {"raw": "normalized"})


def q02_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rejected_rows(quality.classify_rows(pairs(spark, sf_dir)))


def q02b_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_counts(quality.classify_rows(pairs(spark, sf_dir)))


def q02c_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.row_counts(quality.classify_rows(pairs(spark, sf_dir)))


def q03_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.conflicting_rows(_valid(spark, sf_dir))


def q04_dedup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir)


def q04b_duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_counts(_valid(spark, sf_dir))


def q05_label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.label_distribution(_clean(spark, sf_dir))


def q06_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grouping.with_components(_clean(spark, sf_dir))
    return grouping.component_table(rows).select("component_id", "rows", "fields", *text.LABELS)


def q07_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.component_summary(grouping.component_table(grouping.with_components(_clean(spark, sf_dir))))


def q07b_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.component_sizes(grouping.component_table(grouping.with_components(_clean(spark, sf_dir))))


def q07c_largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = grouping.largest_components(grouping.component_table(grouping.with_components(_clean(spark, sf_dir))))
    return found.select("component_id", "rows", "fields", F.array_join("sample_fields", ",").alias("sample_fields"))


def q08_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_leakage(_split_by_row(spark, sf_dir)).select("kind", "left", "right", "count", F.array_join("sample", ",").alias("sample"))


def q09_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.split_rows(grouping.with_components(_clean(spark, sf_dir))).select("source_row", "component_id", "split")


def q09b_split_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: rows and distinct rows of the splits, components and names that more than one split has, splits in use."""
    found = settle(grouping.split_rows(grouping.with_components(_clean(spark, sf_dir))))
    cut = found.groupBy("component_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("cut_components"))
    shared = grouping.leakage(found).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("shared_names"))
    sizes = found.agg(F.count("*").alias("rows"), F.count_distinct("source_row").alias("distinct_rows"), F.count_distinct("split").alias("splits"))
    return sizes.join(cut).join(shared)


def q09c_split_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """split, label, its rows there, and how far their share of the label's rows is from the split's ratio."""
    found = settle(grouping.split_rows(grouping.with_components(_clean(spark, sf_dir))))
    cells = found.groupBy("split", "label").agg(F.count("*").alias("rows"))
    total = found.groupBy("label").agg(F.count("*").alias("of"))
    ratio = F.when(F.col("split") == "train", 0.7).otherwise(0.15)
    return cells.join(total, "label").select("split", "label", "rows", F.round(F.col("rows") / F.col("of") - ratio, 6).alias("off"))


def q10_hard_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.hard_cases(_clean(spark, sf_dir))


def q10b_format_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    return clean.select("source_row", ((F.col("norm_a") == F.col("norm_b")) & (F.col("A") != F.col("B"))).alias("format_variant"))


def q11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.synthetic_negatives(_clean(spark, sf_dir), negatives.NegativeConfig())


def q11b_negative_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: rows that are no valid negative (none) and positives that got another number than asked."""
    clean = _clean(spark, sf_dir)
    made = text.with_normalized(negatives.synthetic_negatives(clean, negatives.NegativeConfig()), {"A": "norm_a", "B": "norm_b"})
    positive = clean.filter(F.col("label").isin(*text.POSITIVE))
    wrong = made.join(positive.select("norm_a", "norm_b").distinct().withColumn("known", F.lit(1)), ["norm_a", "norm_b"], "left")
    bad = wrong.groupBy("negative_type").agg(F.count_if(F.col("known").isNotNull() | (F.col("norm_a") == F.col("norm_b")) | (F.col("label") != "NO_MATCH")).alias("violations"), F.count("*").alias("rows"))
    return bad


def q12_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    names = clean.select(F.col("norm_a").alias("name")).union(clean.select("norm_b"))
    counts = vocabulary.character_counts(names, "name")
    tokens = vocabulary.build_vocabulary(counts)
    return vocabulary.vocabulary_table(spark, tokens).withColumn("id", F.col("id").cast("long"))


def q13_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    names = clean.select(F.col("norm_a").alias("name")).union(clean.select("norm_b")).distinct()
    tokens = vocabulary.build_vocabulary(vocabulary.character_counts(names, "name"))
    ids = vocabulary.encode(F.col("name"), tokens, MatcherConfig().max_length)
    return names.select("name", F.array_join(ids.cast("array<string>"), ",").alias("ids"), vocabulary.decode(ids, tokens).alias("decoded"))


def _top(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cosine_top_k(vectors, vectors, k, query_id="vec_id", candidate_id="vec_id", vector="embedding", skip_same_id=True)
    return found.select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


def q14_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir)


def _relevant(spark: SparkSession, sf_dir: str, ranked: DataFrame) -> DataFrame:
    """source, target, parity: what makes vectors of one label each other's right answers.

    Ranked pairs (source, target) of one label, and for every source, without a target, the parities
    of the ids that other vectors of its label have; so no label's vectors meet each other.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    own, other = rows.select(F.col("vec_id").alias("source"), F.col("label").alias("own")), rows.select(F.col("vec_id").alias("target"), F.col("label").alias("other"))
    odd = F.col("vec_id") % 2 != 0
    hits = ranked.join(own, "source").join(other, "target").filter((F.col("own") == F.col("other")) & (F.col("source") != F.col("target")))
    sizes = rows.groupBy("label").agg(F.count_if(~odd).alias("even_ids"), F.count_if(odd).alias("odd_ids"))
    others = F.array_compact(F.array(F.when(F.col("even_ids") > (~odd).cast("int"), 0), F.when(F.col("odd_ids") > odd.cast("int"), 1)))
    known = rows.join(sizes, "label").select(F.col("vec_id").alias("source"), F.lit(None).cast(rows.schema["vec_id"].dataType).alias("target"), F.explode(others).alias("parity"))
    return hits.select("source", "target", (F.col("target") % 2).cast("int").alias("parity")).unionByName(known)


def q15_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = settle(_top(spark, sf_dir).select(F.col("query_id").alias("source"), F.col("candidate_id").alias("target"), "rank"))
    found = metrics.retrieval_metrics(ranked, _relevant(spark, sf_dir, ranked.select("source", "target")), ks=(1, 5, 10), cutoff=10)
    return found.select("evaluated_sources", "skipped_sources", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("evaluated_sources", "skipped_sources")])


def _labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).cast("int").alias("truth"), (F.col("n_chars") % 3).cast("int").alias("prediction"))


def q16_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(_labelled_documents(spark, sf_dir), (0, 1, 2))


def q16b_class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.per_class(metrics.confusion_matrix(_labelled_documents(spark, sf_dir), (0, 1, 2)))
    return found.select("class", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def q16c_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.classification_summary(metrics.confusion_matrix(_labelled_documents(spark, sf_dir), (0, 1, 2)))
    return found.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), "support")


def _first_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    best = _top(spark, sf_dir).filter("rank = 1")
    rows = best.join(labels.withColumnRenamed("vec_id", "query_id").withColumnRenamed("label", "own"), "query_id")
    return rows.join(labels.withColumnRenamed("vec_id", "candidate_id").withColumnRenamed("label", "other"), "candidate_id")


_CUTS = (0.30, 0.35, 0.40, 0.45)


def q17_threshold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _first_answers(spark, sf_dir).select((F.col("own") == F.col("other")).alias("correct"), F.col("similarity").alias("confidence"))
    found = metrics.threshold_table(rows, _CUTS)
    return found.select("threshold", "accepted_count", "correct_count", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First answers as matches: the right one is a vector of the same label; even ids are DIRECT."""
    rows = settle(_first_answers(spark, sf_dir))
    relation = lambda c: F.when(F.col(c) % 2 == 0, "DIRECT").otherwise("DERIVATION")
    predictions = rows.select(F.col("query_id").alias("source"), F.col("candidate_id").alias("target"), relation("query_id").alias("label"), F.col("similarity").alias("confidence"))
    truth = _relevant(spark, sf_dir, predictions.select("source", "target")).filter(F.col("source") % 7 != 0).withColumn("label", relation("parity"))
    complete = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source"), (F.col("vec_id") % 3 != 0).alias("complete"))
    return metrics.judged(predictions, truth, complete)


def q18_end_to_end_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.end_to_end_metrics(_judged(spark, sf_dir), review=0.35, auto=0.4)
    return found.select(*[F.round(n, 6).alias(n) if t == "double" else F.col(n) for n, t in found.dtypes])


def q18b_gated_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir).select((F.col("target_ok") & F.col("label_ok")).alias("correct"), "confidence", "complete")
    found = metrics.gated_threshold_table(rows, _CUTS)
    return found.select(*[F.round(n, 6).alias(n) if t == "double" and n != "threshold" else F.col(n) for n, t in found.dtypes])


def q19_rerank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranked by a probability made of the similarity, gated at 0.35 and 0.4."""
    from fieldweave.operators.matching import gate, rerank

    scored = _top(spark, sf_dir).select(F.col("query_id").alias("a"), F.col("candidate_id").alias("b"), F.col("rank").alias("retrieval_rank"), F.col("similarity").alias("retrieval_similarity"))
    p = F.round(F.col("retrieval_similarity") * (1 + F.col("b") % 3) / 3, 6)
    scored = scored.withColumn("p_direct", F.round(p / 4, 6)).withColumn("p_derivation", p - F.col("p_direct"))
    found = gate(rerank(scored, "a"), "b", review=0.35, auto=0.4)
    return found.select("a", "best_B", "predicted_label", F.round("match_probability", 6).alias("match_probability"), "retrieval_similarity", "rank", "status")


def q20_target_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _valid(spark, sf_dir)
    return valid.groupBy(F.col("norm_b").alias("target")).agg(F.min_by("B", "source_row").alias("spelling"))


def q21_contradictions_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contradictions_to_first(_valid(spark, sf_dir))


def q22_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valid(spark, sf_dir).withColumn("group_truth_complete", F.when(F.length("norm_a") % 2 == 0, " TRUE ").otherwise("false"))
    return metrics.completeness(rows)


def q23_split_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split_by_row(spark, sf_dir)
    per_label = quality.label_distribution(rows, ["split"])
    exact = rows.groupBy("split").agg((F.count("*") - F.count_distinct("A", "B", "label")).alias("duplicate_rows"))
    return per_label.join(exact, "split").select("split", "label", "count", F.round("ratio", 6).alias("ratio"), "duplicate_rows")


def q24_match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched by an encoder and classifier of fixed random weights."""
    from fieldweave.operators.matching import match_groups
    from fieldweave.operators.model import random_bundle

    clean = _clean(spark, sf_dir)
    tokens = vocabulary.build_vocabulary(vocabulary.character_counts(clean.select(F.col("norm_a").alias("n")).union(clean.select("norm_b")), "n"))
    return match_groups(random_bundle(tokens), clean.select("source_row", "A"), clean.select("source_row", "B"))[0]


def q25_pair_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix of the same model's pair predictions."""
    from fieldweave.operators.matching import predict_pairs
    from fieldweave.operators.model import random_bundle

    clean = _clean(spark, sf_dir)
    tokens = vocabulary.build_vocabulary(vocabulary.character_counts(clean.select(F.col("norm_a").alias("n")).union(clean.select("norm_b")), "n"))
    number = lambda c: F.create_map(*[F.lit(x) for kv in text.LABEL_NUMBERS.items() for x in kv])[F.col(c)]
    found = predict_pairs(random_bundle(tokens), clean)
    return metrics.confusion_matrix(found.select(number("label").alias("truth"), number("predicted_label").alias("prediction")), (0, 1, 2))


def q26_hard_negative_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = negatives.eligible_targets(_clean(spark, sf_dir), negatives.NegativeConfig())
    ranked = sample.withColumn("ratio", text.sequence_ratio_junk("norm_a", "candidate"))
    order = Window.partitionBy("source_row").orderBy(F.col("ratio").desc(), "candidate")
    return ranked.select("source_row", "candidate", F.round("ratio", 6).alias("ratio"), F.row_number().over(order).cast("long").alias("place"))


def q27_training_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and accuracies of a model of the default settings after its first epochs, by the tasks of a barrier stage.

    Where one component of names holds all rows, no split but train has any: validation figures are null.
    """
    from fieldweave.operators.model import train_on
    from fieldweave.plans.train import encoded_pairs

    rows = settle(grouping.split_rows(grouping.with_components(_clean(spark, sf_dir))))
    train, validation = (rows.filter(F.col("split") == s) for s in ("train", "validation"))
    names = train.select(F.col("norm_a").alias("name")).union(train.select("norm_b"))
    tokens = vocabulary.build_vocabulary(vocabulary.character_counts(names, "name"))
    config = MatcherConfig(embedding_epochs=1, classifier_epochs=1)
    history = train_on(encoded_pairs(train, tokens, config), encoded_pairs(validation, tokens, config), tokens, config)[1]
    figures = ("epoch", "train_loss", "train_accuracy", "validation_loss", "validation_accuracy")
    return spark.createDataFrame([(phase, *(h[x] for x in figures)) for phase, epochs in history.items() for h in epochs], "phase string, epoch int, train_loss double, train_accuracy double, validation_loss double, validation_accuracy double")


def q24b_group_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: sources, those that are distinct, and results that break a rule of the gate, of q24's groups."""
    found = settle(q24_match_groups(spark, sf_dir))
    p, none = F.col("match_probability"), F.col("status") == "NO_MATCH"
    status = F.when(p < MatcherConfig().review_threshold, "NO_MATCH").when(p < MatcherConfig().auto_accept_threshold, "REVIEW").otherwise("AUTO_ACCEPT")
    broken = (F.col("status") != status) | (none != (F.col("best_B") == "")) | (none != (F.col("predicted_label") == "NO_MATCH")) | (F.abs(p - F.col("p_direct") - F.col("p_derivation")) > 1e-6)
    unknown = found.filter(~none).join(_clean(spark, sf_dir).select(F.col("B").alias("best_B")).distinct(), "best_B", "left_anti").agg(F.count("*").alias("unknown_targets"))
    return found.agg(F.count("*").alias("sources"), F.count_distinct("source_row").alias("distinct_sources"), F.count_if(F.col("rank").between(1, MatcherConfig().top_k)).alias("ranked"), F.count_if(broken).alias("broken")).join(unknown)


def q25b_truth_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of each true class that q25's matrix counts."""
    return q25_pair_eval(spark, sf_dir).groupBy("truth").agg(F.sum("count").alias("pairs"))


def q26b_sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many targets the sample of each positive holds, how many of them differ, and the last place."""
    return q26_hard_negative_rank(spark, sf_dir).groupBy("source_row").agg(F.count("*").alias("targets"), F.count_distinct("candidate").alias("distinct_targets"), F.max("place").alias("last_place"))


QUERIES = {name: f for name, f in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()}

_P = f"""
WITH pairs AS ({_PAIRS.format(string="VARCHAR")}),
"""


def _norm(c: str) -> str:
    """The same identity in RE2, which has no look-around: matches cannot overlap at a boundary."""
    camel = f"regexp_replace(regexp_replace(trim({c}, ' '), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')"
    return f"trim(regexp_replace(lower({camel}), '[-.\\s_]+', '_', 'g'), '_')"


_ROWS = _P + f"""
n AS (SELECT source_row, A, B, label AS original_label, upper(trim(label)) AS label, {_norm("A")} AS norm_a, {_norm("B")} AS norm_b FROM pairs),
r AS (SELECT *, [z FOR z IN [CASE WHEN trim(A) = '' THEN 'missing_A' END, CASE WHEN trim(B) = '' THEN 'missing_B' END, CASE WHEN trim(original_label) = '' THEN 'missing_label' END,
        CASE WHEN label <> '' AND label NOT IN ('DIRECT', 'DERIVATION', 'NO_MATCH') THEN 'invalid_label' END,
        CASE WHEN trim(A) <> '' AND norm_a = '' THEN 'empty_normalized_A' END, CASE WHEN trim(B) <> '' AND norm_b = '' THEN 'empty_normalized_B' END] IF z IS NOT NULL] AS reasons FROM n),
v AS (SELECT source_row, A, B, label, norm_a, norm_b FROM r WHERE len(reasons) = 0),
nc AS (SELECT norm_a, norm_b FROM v GROUP BY ALL HAVING count(DISTINCT label) > 1),
rc AS (SELECT A, B FROM v GROUP BY ALL HAVING count(DISTINCT label) > 1),
c AS (SELECT A, B, label, min(source_row) AS source_row, min(norm_a) AS norm_a, min(norm_b) AS norm_b FROM v WHERE (norm_a, norm_b) NOT IN (SELECT norm_a, norm_b FROM nc) GROUP BY A, B, label)
"""

_GROUPS = _ROWS.replace("WITH pairs", "WITH RECURSIVE pairs") + """,
e AS (SELECT DISTINCT norm_a AS u, norm_b AS v FROM c UNION SELECT DISTINCT norm_b, norm_a FROM c),
reach(node, other) AS (SELECT u, u FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON reach.other = e.u),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
m AS (SELECT c.*, root FROM c JOIN root ON c.norm_a = root.node),
f AS (SELECT root, row_number() OVER (ORDER BY min(source_row)) - 1 AS component_id FROM m GROUP BY root),
k AS (SELECT component_id, m.* EXCLUDE (root) FROM m JOIN f USING (root)),
names AS (SELECT component_id, norm_a AS field FROM k UNION SELECT component_id, norm_b FROM k),
t AS (SELECT component_id, count(*) AS rows, (SELECT count(*) FROM names WHERE names.component_id = k.component_id) AS fields, count(*) FILTER (label = 'DIRECT') AS "DIRECT",
        count(*) FILTER (label = 'DERIVATION') AS "DERIVATION", count(*) FILTER (label = 'NO_MATCH') AS "NO_MATCH" FROM k GROUP BY component_id)
"""

def _alike(a: str, b: str) -> str:
    """The longest common stretch, the first of equals, as its length and minus its place in a."""
    return f"list_max(flatten([[{{'n': n, 'i': -i}} FOR n IN range(1, len({a}) - i + 2) IF contains({b}, substr({a}, i, n))] FOR i IN range(1, len({a}) + 1)]))"


# blocks: the longest common stretch of each pair, then of what stands left and right of it, and so on
_BLOCKS = _ROWS.replace("WITH pairs", "WITH RECURSIVE pairs") + f""",
blocks AS (SELECT source_row, norm_a AS a, norm_b AS b, {_alike("norm_a", "norm_b")} AS m FROM c
    UNION ALL SELECT source_row, x.a, x.b, {_alike("x.a", "x.b")} FROM (SELECT source_row, unnest([{{'a': substr(a, 1, -m.i - 1), 'b': substr(b, 1, strpos(b, substr(a, -m.i, m.n)) - 1)}}, {{'a': substr(a, -m.i + m.n), 'b': substr(b, strpos(b, substr(a, -m.i, m.n)) + m.n)}}]) AS x FROM blocks WHERE m IS NOT NULL)),
ratio AS (SELECT source_row, 2.0 * coalesce(sum(m.n), 0) / any_value(len(norm_a) + len(norm_b)) AS s FROM blocks JOIN c USING (source_row) GROUP BY source_row)
"""


def _inside(short: str, long: str) -> str:
    """Whether the letters of one stand in the other, in their order."""
    return f"regexp_matches({long}, array_to_string([regexp_escape(z) FOR z IN string_split({short}, '')], '.*'))"


def _abbreviates(short: str, long: str) -> str:
    s, g = f"string_split({short}, '_')", f"string_split({long}, '_')"
    each = lambda what: f"len([1 FOR i IN range(1, len({s}) + 1) IF {what}])"
    shorter = each(f"len({s}[i]) > 1 AND len({s}[i]) < len({g}[i]) AND {_inside(f'{s}[i]', f'{g}[i]')}") + " > 0"
    fits = each(f"{s}[i] = {g}[i] OR (len({s}[i]) >= 2 AND {_inside(f'{s}[i]', f'{g}[i]')})") + f" = len({s})"
    return f"(CASE WHEN len({s}) = len({g}) THEN {shorter} AND {fits} ELSE false END OR (len({s}) = 1 AND len({g}) > 1 AND {short} = array_to_string([z[1] FOR z IN {g}], '')))"


_SPLIT = _ROWS + """, s AS (SELECT *, ['train', 'validation', 'test'][source_row % 3 + 1] AS split FROM c)
"""

_TOP = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
sim AS (SELECT a.vec_id AS query_id, b.vec_id AS candidate_id, list_cosine_similarity(a.e, b.e) AS similarity FROM v a, v b WHERE a.vec_id <> b.vec_id),
top AS (SELECT query_id, candidate_id, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, candidate_id) AS rank FROM sim) WHERE rank <= 10)
"""

_FIRST = _TOP + """, best AS (SELECT t.query_id, t.candidate_id, t.similarity, a.label AS own, b.label AS other FROM top t JOIN v a ON a.vec_id = t.query_id JOIN v b ON b.vec_id = t.candidate_id WHERE rank = 1)
"""

_JUDGED = _FIRST + """,
truth AS (SELECT a.vec_id AS source, b.vec_id AS target, CASE WHEN b.vec_id % 2 = 0 THEN 'DIRECT' ELSE 'DERIVATION' END AS label FROM v a JOIN v b USING (label) WHERE a.vec_id <> b.vec_id AND a.vec_id % 7 <> 0),
j AS (SELECT query_id AS source, similarity AS confidence, query_id % 3 <> 0 AS complete,
        EXISTS (SELECT 1 FROM truth t WHERE t.source = query_id) AS positive, EXISTS (SELECT 1 FROM truth t WHERE t.source = query_id AND t.target = candidate_id) AS target_ok,
        CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.source = query_id AND t.target = candidate_id) THEN (query_id % 2 = candidate_id % 2)
             ELSE EXISTS (SELECT 1 FROM truth t WHERE t.source = query_id AND t.target % 2 = query_id % 2) END AS label_ok FROM best)
"""

_CELLS = """
WITH d AS (SELECT CASE WHEN toxic = 1 THEN 2 ELSE quality END AS truth, n_chars % 3 AS prediction FROM documents JOIN labels USING (doc_id)),
x AS (SELECT CAST(t.i AS INTEGER) AS truth, CAST(p.i AS INTEGER) AS prediction, (SELECT count(*) FROM d WHERE d.truth = t.i AND d.prediction = p.i) AS count FROM range(3) t(i), range(3) p(i)),
per AS (SELECT a.class, support, CASE WHEN guesses > 0 THEN hits / guesses ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall
        FROM (SELECT truth AS class, sum(count) AS support, sum(CASE WHEN truth = prediction THEN count ELSE 0 END) AS hits FROM x GROUP BY truth) a JOIN (SELECT prediction AS class, sum(count) AS guesses FROM x GROUP BY prediction) b USING (class)),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM per)
"""

_CUT_ROWS = "(VALUES (0.30::DOUBLE), (0.35::DOUBLE), (0.40::DOUBLE), (0.45::DOUBLE)) cut(threshold)"

_LEAKS = """, w AS ({values}), p(l, r) AS (VALUES ('train', 'test'), ('train', 'validation'), ('validation', 'test'))
"""

ORACLE_SQL = {
    "q01_normalize": _P + f"x AS (SELECT A AS raw FROM pairs UNION SELECT B FROM pairs UNION SELECT c_name FROM customer UNION SELECT p_brand FROM part) SELECT raw, {_norm('raw')} AS normalized FROM x",
    "q02_reject_reasons": _ROWS + "SELECT A, B, original_label AS label, source_row, array_to_string(reasons, ';') AS reason FROM r WHERE len(reasons) > 0",
    "q02b_reason_counts": _ROWS + "SELECT reason, count(*) AS count FROM (SELECT unnest(reasons) AS reason FROM r) GROUP BY reason",
    "q02c_row_counts": _ROWS + """SELECT count(*) AS total_rows, count(*) FILTER (list_contains(reasons, 'missing_A')) AS "missing_A", count(*) FILTER (list_contains(reasons, 'missing_B')) AS "missing_B",
        count(*) FILTER (list_contains(reasons, 'missing_label')) AS missing_label, count(*) FILTER (len([z FOR z IN reasons IF starts_with(z, 'missing_')]) > 0) AS rows_with_missing_values, count(*) FILTER (len(reasons) > 0) AS rejected_rows,
        count(*) FILTER (label = 'DIRECT') AS "original_DIRECT", count(*) FILTER (label = 'DERIVATION') AS "original_DERIVATION", count(*) FILTER (label = 'NO_MATCH') AS "original_NO_MATCH" FROM r""",
    "q03_conflicts": _ROWS + """SELECT v.A, v.B, v.label, v.source_row, v.norm_a AS "normalized_A", v.norm_b AS "normalized_B", CASE WHEN rc.A IS NULL THEN 'normalized_pair' ELSE 'raw_pair' END AS conflict_type
        FROM v JOIN nc ON v.norm_a = nc.norm_a AND v.norm_b = nc.norm_b LEFT JOIN rc ON v.A = rc.A AND v.B = rc.B""",
    "q04_dedup_clean": _ROWS + "SELECT A, B, label, source_row, norm_a, norm_b FROM c",
    "q04b_duplicate_counts": _ROWS + "SELECT (SELECT count(*) FROM (SELECT A, B FROM v GROUP BY ALL HAVING count(*) > 1)) AS duplicate_pair_groups, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM v GROUP BY A, B)) AS duplicate_pair_rows, (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM v GROUP BY A, B, label)) AS exact_duplicate_rows",
    "q05_label_distribution": _ROWS + "SELECT l AS label, count(c.label) AS count, count(c.label) / (SELECT count(*) FROM c) AS ratio FROM (VALUES ('DIRECT'), ('DERIVATION'), ('NO_MATCH')) x(l) LEFT JOIN c ON c.label = l GROUP BY l",
    "q06_components": _GROUPS + 'SELECT component_id, rows, fields, "DIRECT", "DERIVATION", "NO_MATCH" FROM t',
    "q07_component_stats": _GROUPS + "SELECT count(*) AS count, min(rows) AS min_rows, median(rows) AS median_rows, max(rows) AS max_rows, max(rows) / sum(rows) AS largest_ratio FROM t",
    "q07b_component_sizes": _GROUPS + "SELECT rows, count(*) AS components FROM t GROUP BY rows",
    "q07c_largest_components": _GROUPS + "SELECT component_id, rows, fields, (SELECT array_to_string(list(field ORDER BY field)[1:10], ',') FROM names WHERE names.component_id = t.component_id) AS sample_fields FROM t ORDER BY rows DESC, component_id LIMIT 20",
    "q08_leakage": _SPLIT + _LEAKS.format(values="SELECT 'A' AS kind, split, norm_a AS x FROM s UNION SELECT 'B', split, norm_b FROM s UNION SELECT 'any', split, norm_a FROM s UNION SELECT 'any', split, norm_b FROM s UNION SELECT 'pair', split, norm_a || ' -> ' || norm_b FROM s") + """
        SELECT k.kind, p.l AS "left", p.r AS "right", count(b.x) AS count, coalesce(array_to_string(list(a.x ORDER BY a.x) FILTER (b.x IS NOT NULL)[1:20], ','), '') AS sample
        FROM (SELECT DISTINCT kind FROM w) k CROSS JOIN p LEFT JOIN w a ON a.kind = k.kind AND a.split = p.l LEFT JOIN w b ON b.kind = k.kind AND b.split = p.r AND b.x = a.x GROUP BY k.kind, p.l, p.r""",
    "q09b_split_checks": _GROUPS + "SELECT (SELECT count(*) FROM c) AS rows, (SELECT count(*) FROM c) AS distinct_rows, least(count(*), 3) AS splits, CAST(0 AS BIGINT) AS cut_components, CAST(0 AS BIGINT) AS shared_names FROM t",
    "q10_hard_cases": _BLOCKS + f""", h AS (SELECT c.*, s, [z FOR z IN [CASE WHEN label <> 'NO_MATCH' AND s < 0.4 THEN 'hard_positive' END, CASE WHEN label = 'NO_MATCH' AND s > 0.7 THEN 'hard_negative' END,
        CASE WHEN norm_a = norm_b AND A <> B THEN 'format_variant' WHEN label <> 'NO_MATCH' AND s > 0.7 THEN 'near_spelling_variant' END, CASE WHEN {_abbreviates("norm_a", "norm_b")} OR {_abbreviates("norm_b", "norm_a")} THEN 'possible_abbreviation' END] IF z IS NOT NULL] AS why FROM c JOIN ratio USING (source_row))
        SELECT A, B, label, source_row, round(s, 6) AS similarity, array_to_string(why, ';') AS reasons FROM h WHERE len(why) > 0""",
    "q10b_format_variants": _ROWS + "SELECT source_row, norm_a = norm_b AND A <> B AS format_variant FROM c",
    "q11b_negative_violations": _ROWS + ", pos AS (SELECT count(*) AS n FROM c WHERE label <> 'NO_MATCH') SELECT kind AS negative_type, CAST(0 AS BIGINT) AS violations, n AS rows FROM pos, (VALUES ('hard'), ('random')) k(kind)",
    "q12_vocab": _ROWS + ", ch AS (SELECT DISTINCT unnest(string_split(norm_a || norm_b, '')) AS token FROM c) SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM ch UNION ALL VALUES ('<PAD>', 0), ('<UNK>', 1)",
    "q13_encode": _ROWS + """, nm AS (SELECT norm_a AS name FROM c UNION SELECT norm_b FROM c), ch AS (SELECT DISTINCT unnest(string_split(name, '')) AS token FROM nm), ids AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM ch),
        l AS (SELECT name, i, id FROM (SELECT name, unnest(range(1, 65)) AS i FROM nm) q LEFT JOIN ids ON ids.token = substr(name, i, 1))
        SELECT name, array_to_string(list(coalesce(id, 0) ORDER BY i), ',') AS ids, substr(name, 1, 64) AS decoded FROM l GROUP BY name""",
    "q14_cosine_topk": _TOP + "SELECT query_id, candidate_id, rank, similarity FROM top",
    "q15_retrieval_metrics": _TOP + """, hit AS (SELECT t.query_id, min(rank) AS first FROM top t JOIN v a ON a.vec_id = t.query_id JOIN v b ON b.vec_id = t.candidate_id AND a.label = b.label GROUP BY t.query_id),
        src AS (SELECT vec_id FROM v a WHERE EXISTS (SELECT 1 FROM v b WHERE b.label = a.label AND b.vec_id <> a.vec_id))
        SELECT count(*) AS evaluated_sources, (SELECT count(*) FROM v) - count(*) AS skipped_sources, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5,
        round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_at_10 FROM src LEFT JOIN hit ON hit.query_id = src.vec_id""",
    "q16_confusion_matrix": _CELLS + "SELECT truth, prediction, count FROM x",
    "q16b_class_metrics": _CELLS + "SELECT class, CAST(support AS BIGINT) AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1",
    "q16c_accuracy": _CELLS + "SELECT round((SELECT sum(count) FROM x WHERE truth = prediction) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS support FROM f1",
    "q17_threshold_coverage": _FIRST + f"SELECT threshold, count(*) FILTER (similarity >= threshold) AS accepted_count, count(*) FILTER (similarity >= threshold AND own = other) AS correct_count, round(coalesce(count(*) FILTER (similarity >= threshold AND own = other) / nullif(count(*) FILTER (similarity >= threshold), 0), 0), 6) AS precision, round(count(*) FILTER (similarity >= threshold) / count(*), 6) AS coverage FROM best, {_CUT_ROWS} GROUP BY threshold",
    "q18_end_to_end_metrics": _JUDGED + """, g AS (SELECT *, confidence >= 0.35 AS acc, confidence >= 0.4 AS auto, target_ok AND label_ok AS ok FROM j)
        SELECT round(count(*) FILTER (target_ok AND positive) / greatest(count(*) FILTER (positive), 1), 6) AS top_1_correct_match_rate,
        round(count(*) FILTER (complete AND CASE WHEN positive THEN acc AND label_ok ELSE NOT acc END) / nullif(count(*) FILTER (complete), 0), 6) AS relationship_classification_accuracy,
        round(count(*) FILTER (complete AND CASE WHEN positive THEN acc AND ok ELSE NOT acc END) / nullif(count(*) FILTER (complete), 0), 6) AS overall_end_to_end_accuracy,
        round(count(*) FILTER (label_ok AND positive) / greatest(count(*) FILTER (positive), 1), 6) AS raw_positive_relationship_classification_accuracy,
        round(count(*) FILTER (ok AND positive) / greatest(count(*) FILTER (positive), 1), 6) AS raw_positive_end_to_end_accuracy,
        round(coalesce(count(*) FILTER (auto AND complete AND ok) / nullif(count(*) FILTER (auto AND complete), 0), 0), 6) AS auto_accept_precision,
        round(count(*) FILTER (auto AND complete) / nullif(count(*) FILTER (complete), 0), 6) AS coverage, count(*) FILTER (auto AND complete) AS auto_accept_count,
        round(count(*) FILTER (auto) / count(*), 6) AS all_sources_auto_accept_coverage, count(*) FILTER (auto AND NOT complete) AS excluded_incomplete_auto_accept_count,
        count(*) AS total_sources, count(*) FILTER (complete) AS evaluated_sources, count(*) FILTER (NOT complete) AS excluded_incomplete_sources, count(*) FILTER (positive) AS known_positive_sources,
        count(*) FILTER (positive AND complete) AS positive_sources, count(*) FILTER (positive AND NOT complete) AS incomplete_positive_sources, count(*) FILTER (NOT positive AND complete) AS no_match_only_sources, count(*) FILTER (NOT positive AND NOT complete) AS unknown_no_match_sources FROM g""",
    "q18b_gated_thresholds": _JUDGED + f"""SELECT threshold, count(*) FILTER (complete AND confidence >= threshold) AS accepted_count, count(*) FILTER (complete AND confidence >= threshold AND target_ok AND label_ok) AS correct_count,
        round(coalesce(count(*) FILTER (complete AND confidence >= threshold AND target_ok AND label_ok) / nullif(count(*) FILTER (complete AND confidence >= threshold), 0), 0), 6) AS precision, round(count(*) FILTER (complete AND confidence >= threshold) / count(*) FILTER (complete), 6) AS coverage,
        count(*) FILTER (complete) AS evaluated_sources, count(*) FILTER (NOT complete AND confidence >= threshold) AS excluded_incomplete_accepted_count, count(*) FILTER (confidence >= threshold) AS all_sources_accepted_count, round(count(*) FILTER (confidence >= threshold) / count(*), 6) AS all_sources_coverage
        FROM j, {_CUT_ROWS} GROUP BY threshold""",
    "q19_rerank_gate": _TOP + """, p AS (SELECT query_id AS a, candidate_id AS b, rank, similarity, round(similarity * (1 + candidate_id % 3) / 3, 6) AS p FROM top),
        q AS (SELECT *, round(p / 4, 6) AS p_direct, p - round(p / 4, 6) AS p_derivation FROM p), m AS (SELECT *, p_direct + p_derivation AS mp FROM q),
        w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY mp DESC, rank) AS n FROM m) WHERE n = 1)
        SELECT a, CASE WHEN mp < 0.35 THEN '' ELSE CAST(b AS VARCHAR) END AS "best_B", CASE WHEN mp < 0.35 THEN 'NO_MATCH' WHEN p_direct > p_derivation THEN 'DIRECT' ELSE 'DERIVATION' END AS predicted_label, round(mp, 6) AS match_probability,
        similarity AS retrieval_similarity, rank, CASE WHEN mp < 0.35 THEN 'NO_MATCH' WHEN mp < 0.4 THEN 'REVIEW' ELSE 'AUTO_ACCEPT' END AS status FROM w""",
    "q24b_group_checks": _ROWS + "SELECT count(*) AS sources, count(*) AS distinct_sources, count(*) AS ranked, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS unknown_targets FROM c",
    "q25b_truth_totals": _ROWS + "SELECT CAST(i AS INTEGER) AS truth, (SELECT count(*) FROM c WHERE label = l) AS pairs FROM (VALUES ('NO_MATCH', 0), ('DIRECT', 1), ('DERIVATION', 2)) x(l, i)",
    "q26b_sample_sizes": _ROWS + """, t AS (SELECT DISTINCT norm_b AS target FROM c WHERE norm_b <> ''), k AS (SELECT DISTINCT norm_a, norm_b AS target FROM c WHERE label <> 'NO_MATCH'),
        x AS (SELECT norm_a, target FROM k UNION SELECT norm_a, norm_a FROM k WHERE norm_a IN (SELECT target FROM t)), kn AS (SELECT norm_a, count(*) AS n FROM x GROUP BY norm_a),
        y AS (SELECT source_row, least(101, (SELECT count(*) FROM t) - n) AS targets FROM c JOIN kn USING (norm_a) WHERE label <> 'NO_MATCH')
        SELECT source_row, targets, targets AS distinct_targets, targets AS last_place FROM y""",
    "q20_target_dedup": _ROWS + "SELECT norm_b AS target, arg_min(B, source_row) AS spelling FROM v GROUP BY norm_b",
    "q21_contradictions_to_first": _ROWS + ", o AS (SELECT *, first_value(source_row) OVER w AS first_row, first_value(label) OVER w AS first_label FROM v WINDOW w AS (PARTITION BY norm_a, norm_b ORDER BY source_row)) SELECT norm_a, norm_b, label, source_row, first_row, first_label FROM o WHERE label <> first_label ORDER BY source_row LIMIT 10",
    "q22_completeness": _ROWS + "SELECT DISTINCT norm_a AS source, length(norm_a) % 2 = 0 AS complete FROM v",
    "q23_split_validation": _SPLIT + """, per AS (SELECT split, count(*) AS total, count(*) - count(DISTINCT (A, B, label)) AS duplicate_rows FROM s GROUP BY split)
        SELECT per.split, l AS label, count(s.label) AS count, round(count(s.label) / any_value(total), 6) AS ratio, any_value(duplicate_rows) AS duplicate_rows FROM per CROSS JOIN (VALUES ('DIRECT'), ('DERIVATION'), ('NO_MATCH')) x(l) LEFT JOIN s ON s.split = per.split AND s.label = l GROUP BY per.split, l""",
}
