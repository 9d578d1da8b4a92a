"""Queries over evaluation scores and judged samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.operators import evaluation, judges, records
from lodestrata.plans import inputs
from lodestrata.plans.catalog import query
from lodestrata.plans.inputs import RAG_SAMPLES_SQL, SCORES_SQL, SPACE_SQL, rounded, strip_sql, tokens_sql

MEANS_SQL = f"""
WITH {SCORES_SQL},
means AS (SELECT run, framework, metric, avg(score) AS score, bool_and(success) AS passed, count(*) AS cases
          FROM scores GROUP BY ALL),
runs AS (SELECT DISTINCT 'run-' || s_suppkey AS run FROM supplier),
ragas AS (
  SELECT run, coalesce(avg(score), 0) AS average_score, coalesce(bool_and(score > 0.5), true) AS passed
  FROM runs LEFT JOIN (SELECT * FROM means WHERE framework = 'ragas') USING (run) GROUP BY run),
deepeval AS (
  SELECT run, coalesce(avg(score), 0) AS average_score, coalesce(bool_and(passed), false) AS all_passed,
         coalesce(avg(passed::INT), 0) AS pass_rate
  FROM runs LEFT JOIN (SELECT * FROM means WHERE framework = 'deepeval') USING (run) GROUP BY run),
merged AS (SELECT run, framework || '_' || metric AS metric, score FROM means),
overall AS (
  SELECT run, avg(m.score) AS overall_score,
         avg(CASE WHEN m.metric IN ('deepeval_toxicity', 'deepeval_hallucination') THEN 1 - m.score ELSE m.score END)
           AS overall_score_oriented,
         bool_and(coalesce(r.passed, true) AND coalesce(d.all_passed, true)) AS passed
  FROM merged m LEFT JOIN ragas r USING (run) LEFT JOIN deepeval d USING (run) GROUP BY run)
"""


def _means(t):
    """Means of both frameworks in one aggregation."""
    return evaluation.metric_means(inputs.scores(t), ["run", "framework"])


def _side(t, framework):
    return _means(t).filter(F.col("framework") == framework).drop("framework")


def _runs(t):
    return t.supplier.select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run"))


def _ragas(t):
    return evaluation.ragas_summary(_side(t, "ragas"), runs=_runs(t))


def _deepeval(t):
    return evaluation.deepeval_summary(_side(t, "deepeval"), runs=_runs(t))


def _merged(t):
    return evaluation.merge_scores(_side(t, "ragas"), _side(t, "deepeval"))


def _overall(t):
    return evaluation.overall_score(_means(t))


@query("metric_means", MEANS_SQL + "SELECT run, framework, metric, round(score + 1e-10, 6) AS score, passed, cases FROM means")
def metric_means(t):
    return _means(t).withColumn("score", rounded("score"))


@query("eval_by_dataset", f"""
WITH {SCORES_SQL} SELECT dataset, metric, round(avg(score) + 1e-10, 6) AS score, bool_and(success) AS passed, count(*) AS cases
FROM scores GROUP BY ALL""")
def eval_by_dataset(t):
    return evaluation.eval_by_dataset(inputs.scores(t)).withColumn("score", rounded("score"))


@query("ragas_summary", MEANS_SQL + "SELECT run, round(average_score + 1e-10, 6) AS average_score, passed FROM ragas")
def ragas_summary(t):
    return _ragas(t).withColumn("average_score", rounded("average_score"))


@query("deepeval_summary", MEANS_SQL + """
SELECT run, round(average_score + 1e-10, 6) AS average_score, all_passed, round(pass_rate + 1e-10, 6) AS pass_rate FROM deepeval""")
def deepeval_summary(t):
    return _deepeval(t).select("run", rounded("average_score").alias("average_score"), "all_passed",
                               rounded("pass_rate").alias("pass_rate"))


@query("merge_scores", MEANS_SQL + "SELECT run, metric, round(score + 1e-10, 6) AS score FROM merged")
def merge_scores(t):
    return _merged(t).withColumn("score", rounded("score"))


OVERALL_COLUMNS = "run, round(overall_score + 1e-10, 6) AS overall_score, round(overall_score_oriented + 1e-10, 6) AS overall_score_oriented, passed"


@query("overall_score", MEANS_SQL + f"SELECT {OVERALL_COLUMNS} FROM overall")
def overall_score(t):
    return _overall(t).select("run", rounded("overall_score").alias("overall_score"),
                              rounded("overall_score_oriented").alias("overall_score_oriented"), "passed")


@query("quality_gate", MEANS_SQL + """
SELECT run, overall_score >= 0.55 AND passed AS approved,
       CASE WHEN overall_score >= 0.55 AND passed THEN 'Approved: score=' || printf('%.4f', overall_score) || ' >= 0.55'
            ELSE 'Rejected: ' || concat_ws(', ',
              CASE WHEN overall_score < 0.55 THEN 'score ' || printf('%.4f', overall_score) || ' < 0.55' END,
              CASE WHEN NOT passed THEN 'not all metrics passed' END) END AS reason
FROM overall""")
def quality_gate(t):
    return evaluation.quality_gate(_overall(t), 0.55).select("run", "approved", "reason")


@query("threshold_gate", MEANS_SQL + """
SELECT run, bool_and(score >= 0.52) AS passed FROM means WHERE framework = 'ragas' GROUP BY run""")
def threshold_gate(t):
    return evaluation.threshold_gate(_side(t, "ragas"), 0.52)


@query("safety_report", f"""
WITH rates AS (
  SELECT lang, 'toxicity' AS metric, avg(toxic) AS score FROM documents JOIN labels USING (doc_id) GROUP BY lang
  UNION ALL SELECT lang, 'bias', avg(1 - quality) FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, metric, round(score + 1e-10, 6) AS score, CASE metric WHEN 'toxicity' THEN 0.1 ELSE 0.2 END::DOUBLE AS upper,
       score <= CASE metric WHEN 'toxicity' THEN 0.1 ELSE 0.2 END AS safe FROM rates""")
def safety_report(t):
    """Toxic share and, as a stand-in for bias, the low-quality share per language."""
    rows = t.documents.select("doc_id", "lang").join(t.labels, "doc_id")
    wide = rows.groupBy("lang").agg(F.avg("toxic").alias("toxicity"), F.avg(1 - F.col("quality")).alias("bias"))
    rates = wide.unpivot(["lang"], ["toxicity", "bias"], "metric", "score")
    return evaluation.safety_report(rates).withColumn("score", rounded("score"))


AB_SQL = """
WITH both_sides AS (
  SELECT l_partkey, l_linestatus, metric, avg(score) AS score
  FROM (SELECT l_partkey, l_linestatus, 'quantity' AS metric, l_quantity / 50 AS score FROM lineitem
        UNION ALL SELECT l_partkey, l_linestatus, 'discount', abs(l_discount) FROM lineitem) GROUP BY ALL),
a AS (SELECT l_partkey AS case_id, metric, score AS score_a FROM both_sides WHERE l_linestatus = 'F'),
b AS (SELECT l_partkey AS case_id, metric, score AS score_b FROM both_sides WHERE l_linestatus = 'O'),
compared AS (SELECT case_id, metric, score_a, score_b, round(score_b - score_a, 9) AS delta FROM a FULL JOIN b USING (case_id, metric))
"""


def _ab(t):
    """Parts as cases: lines with status F are run A, those with O run B."""
    rows = t.lineitem.groupBy("l_partkey", "l_linestatus").agg(
        F.avg(F.col("l_quantity") / 50).alias("quantity"), F.avg(F.abs("l_discount")).alias("discount"))
    long = rows.unpivot(["l_partkey", "l_linestatus"], ["quantity", "discount"], "metric", "score").withColumnRenamed(
        "l_partkey", "case_id")
    compared = evaluation.ab_compare(long.filter("l_linestatus = 'F'"), long.filter("l_linestatus = 'O'"))
    return compared.withColumn("delta", F.round("delta", 9))


@query("ab_compare", AB_SQL + """
SELECT case_id, metric, round(score_a + 1e-10, 6) AS score_a, round(score_b + 1e-10, 6) AS score_b, round(delta + 1e-10, 6) AS delta FROM compared""")
def ab_compare(t):
    return _ab(t).select("case_id", "metric", *[rounded(c).alias(c) for c in ("score_a", "score_b", "delta")])


@query("ab_summary", AB_SQL + """
SELECT metric, count(*) AS cases, count(delta) AS paired, round(avg(delta) + 1e-10, 6) AS mean_delta,
       count(*) FILTER (delta > 0) AS wins_b, count(*) FILTER (delta < 0) AS wins_a, count(*) FILTER (delta = 0) AS ties
FROM compared GROUP BY metric""")
def ab_summary(t):
    return evaluation.ab_summary(_ab(t)).withColumn("mean_delta", rounded("mean_delta"))


@query("known_metrics", """
SELECT DISTINCT p_type AS metric FROM part WHERE p_type IN (SELECT upper(split_part(p_type, ' ', 1)) FROM part WHERE p_size > 10)""")
def known_metrics(t):
    """Part types as metric names."""
    known = t.part.filter("p_size > 10").select(F.upper(F.split("p_type", " ")[0]).alias("metric"))
    asked = t.part.select(F.col("p_type").alias("metric")).distinct()
    return records.known_metrics(asked, known)


# -- judged samples ------------------------------------------------------------------


def sentences_sql(x: str) -> str:
    return rf"""list_filter(string_split(regexp_replace({strip_sql(x)}, '([.!?]){SPACE_SQL}+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"""


def words_sql(x: str) -> str:
    return f"list_distinct({tokens_sql(x)})"


def share_sql(claims: str, sets: str) -> str:
    """Share of sentences with words of which half are found in one of the word sets."""
    s = f"list_filter(list_transform({sentences_sql(claims)}, lambda s: {words_sql('s')}), lambda s: len(s) > 0)"
    ok = f"list_filter({s}, lambda s: len(list_filter({sets}, lambda c: len(list_intersect(s, c)) / len(s) >= 0.5)) > 0)"
    return f"CASE WHEN len({s}) > 0 THEN len({ok}) / len({s}) END"


JUDGED_SQL = f"""
WITH {RAG_SAMPLES_SQL},
base AS (SELECT *, coalesce(ground_truth, '') AS truth,
                list_transform(contexts, lambda c: {words_sql('c')}) AS csets FROM samples),
texts AS (SELECT case_id, 'q' AS part, question AS text FROM base UNION ALL SELECT case_id, 'a', answer FROM base
          UNION ALL SELECT case_id, 't', truth FROM base),
tokens AS (SELECT case_id, part, unnest({tokens_sql('text')}) AS w FROM texts),
counts AS (SELECT case_id, part, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS slot, count(*) AS c FROM tokens GROUP BY ALL),
vecs AS (SELECT case_id, part, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY case_id, part)))::FLOAT::DOUBLE AS v FROM counts),
norms AS (SELECT case_id, part, sqrt(sum(v * v)) AS n FROM vecs GROUP BY ALL),
dots AS (SELECT x.case_id, x.part || y.part AS pair, sum(x.v * y.v) AS s FROM vecs x
         JOIN vecs y ON x.case_id = y.case_id AND x.slot = y.slot GROUP BY ALL),
cos AS (SELECT d.case_id, d.pair, d.s / (m.n * n.n) AS c FROM dots d
        JOIN norms m ON m.case_id = d.case_id AND m.part = d.pair[1]
        JOIN norms n ON n.case_id = d.case_id AND n.part = d.pair[2]),
sims AS (SELECT b.*, coalesce(qa.c, 0) AS qa, coalesce(ta.c, 0) AS sim
         FROM base b LEFT JOIN cos qa ON qa.case_id = b.case_id AND qa.pair = 'qa'
         LEFT JOIN cos ta ON ta.case_id = b.case_id AND ta.pair = 'at'),
flags AS (SELECT case_id, generate_subscripts(csets, 1) AS i,
                 CASE WHEN len({words_sql('truth')}) > 0
                       AND len(list_intersect({words_sql('truth')}, unnest(csets))) / len({words_sql('truth')}) >= 0.5
                      THEN 1 ELSE 0 END AS rel FROM base),
ranked AS (SELECT case_id, rel, rel * sum(rel) OVER (PARTITION BY case_id ORDER BY i) / i AS p FROM flags),
precise AS (SELECT case_id, CASE WHEN sum(rel) > 0 THEN sum(p) / sum(rel) ELSE 0 END AS cp FROM ranked GROUP BY case_id),
wide AS (
  SELECT s.case_id, {share_sql('answer', 'csets')} AS faithfulness, qa AS answer_relevancy,
         coalesce(cp, 0) AS context_precision, {share_sql('truth', 'csets')} AS context_recall,
         CASE WHEN len(every) > 0 THEN
           len(list_filter(every, lambda e: len(list_intersect({words_sql('e')}, {words_sql('question')})) > 0)) / len(every)
         END AS context_relevancy,
         sim AS answer_similarity,
         0.75 * CASE WHEN len(aw) + len(tw) > 0 THEN 2.0 * len(list_intersect(aw, tw)) / (len(aw) + len(tw)) ELSE 0 END
           + 0.25 * sim AS answer_correctness
  FROM (SELECT *, {words_sql('answer')} AS aw, {words_sql('truth')} AS tw,
               flatten(list_transform(contexts, lambda c: {sentences_sql('c')})) AS every FROM sims) s
  LEFT JOIN precise USING (case_id))
"""


@query("rag_case_scores", JUDGED_SQL + """
SELECT case_id, metric, round(score + 1e-10, 6) AS score, score >= 0.5 AS success FROM wide UNPIVOT (score FOR metric IN
 (faithfulness, answer_relevancy, context_precision, context_recall, context_relevancy, answer_similarity, answer_correctness))""")
def rag_case_scores(t):
    return judges.rag_scores(inputs.rag_samples(t)).withColumn("score", rounded("score"))


@query("rag_metric_means", JUDGED_SQL + """
SELECT metric, round(avg(score) + 1e-10, 6) AS score, bool_and(score >= 0.5) AS passed, count(*) AS cases
FROM wide UNPIVOT (score FOR metric IN (faithfulness, answer_relevancy, context_precision, context_recall,
  context_relevancy, answer_similarity, answer_correctness)) GROUP BY metric""")
def rag_metric_means(t):
    return evaluation.metric_means(judges.rag_scores(inputs.rag_samples(t)), []).withColumn("score", rounded("score"))


def _cases(t):
    return inputs.rag_samples(t).select(
        "case_id", F.col("question").alias("input"), F.col("answer").alias("actual_output"),
        F.col("ground_truth").alias("expected_output"), F.col("contexts").alias("context"),
        F.array("question").alias("retrieval_context"))


@query("case_scores", JUDGED_SQL + f"""
, c AS (SELECT case_id, 1 - {share_sql('answer', 'csets')} AS hallucination, qa AS relevance,
              {share_sql('answer', '[' + words_sql('question') + ']')} AS groundedness FROM sims)
SELECT case_id, metric, round(score + 1e-10, 6) AS score,
       CASE WHEN metric = 'hallucination' THEN score <= 0.5 ELSE score >= 0.5 END AS success
FROM c UNPIVOT (score FOR metric IN (hallucination, relevance, groundedness))""")
def case_scores(t):
    return judges.case_scores(_cases(t)).withColumn("score", rounded("score"))


def _toxicity(t):
    return judges.toxicity_model(t.documents.select("doc_id", "text").join(t.labels, "doc_id"))


@query("toxicity_scores")
def toxicity_scores(t):
    """A classifier fitted on the labelled documents scores all documents."""
    return judges.toxicity_scores(inputs.documents(t), _toxicity(t), "doc_id")


@query("toxicity_separation", """
SELECT toxic, count(*) AS n, true AS apart FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY toxic""")
def toxicity_separation(t):
    """Whether toxic documents score above a half and clean ones below it on average, by label."""
    scored = judges.toxicity_scores(inputs.documents(t), _toxicity(t), "doc_id").join(t.labels.filter("toxic IS NOT NULL"), "doc_id")
    return scored.groupBy("toxic").agg(F.count("*").alias("n"), F.avg("score").alias("mean")).select(
        "toxic", "n", F.when(F.col("toxic") == 1, F.col("mean") > 0.5).otherwise(F.col("mean") < 0.5).alias("apart"))
