"""Queries on bagging, scores and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedlift.operators import bagging
from seedlift.operators import scores as S
from seedlift.operators.order import number_rows, percentile_ranks
from seedlift.operators.single import class_members, one_feature_models
from seedlift.plans import base as B
from seedlift.plans.registry import query, table
from seedlift.runtime import pin

KEYS = "iter, block, fold"


@query("pu_membership", f"""WITH {B.MEMBERS}
SELECT CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(fold AS INT) AS fold, entity_id, label FROM members""")
def pu_membership(spark, sf):
    plan = bagging.plan_blocks(B.entities(spark, sf), B.RATIO)
    members = bagging.pu_membership(B.entities(spark, sf), B.ITERATIONS, B.RATIO, B.FOLDS, plan=plan)
    return bagging.check_conserved(members, plan, B.ITERATIONS)


@query("pu_scores_nb", f"""WITH {B.SCORES}
SELECT CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(fold AS INT) AS fold, entity_id, label, proba
FROM scores""")
def pu_scores_nb(spark, sf):
    return B.scores(spark, sf).drop("clf")


@query("pu_votes", f"""WITH {B.SCORES}
SELECT entity_id, max(label) AS label, count(*) FILTER (proba >= 1 - proba) AS positive_votes,
       count(*) FILTER (proba < 1 - proba) AS negative_votes,
       round(count(*) FILTER (proba >= 1 - proba) / count(*), 6) AS positive_ratio
FROM scores GROUP BY entity_id""")
def pu_votes(spark, sf):
    voted = S.positive_ratio(S.votes(B.scores(spark, sf)))
    return voted.drop("clf").withColumn("positive_ratio", F.round("positive_ratio", 6))


@query("pu_ranking", f"""WITH {B.SCORES}, {B.RANKED}
SELECT entity_id, label, mean_score, round(percentile, 6) AS percentile, positive_votes, negative_votes FROM ranked""")
def pu_ranking(spark, sf):
    """Flagship: features, bagging, out-of-fold scores, votes and percentiles for every part."""
    ranked = S.ranked_predictions(B.scores(spark, sf), B.DECIMALS)
    return ranked.select("entity_id", "label", "mean_score", F.round("percentile", 6).alias("percentile"),
                         "positive_votes", "negative_votes")


@query("rankings_by_kind", f"""WITH {B.SCORES}, {B.RANKED}, k AS (
  SELECT 'all' AS kind, * FROM ranked UNION ALL SELECT CASE WHEN label = 1 THEN 'known' ELSE 'unlabelled' END, * FROM ranked)
SELECT kind, entity_id, label, mean_score, row_number() OVER (PARTITION BY kind ORDER BY mean_score DESC NULLS LAST, entity_id) AS position
FROM k""")
def rankings_by_kind(spark, sf):
    """All, known and unlabelled entities, each in an order of its own."""
    ranked = S.ranked_predictions(B.scores(spark, sf), B.DECIMALS)
    return S.rankings_by_kind(ranked).select("kind", "entity_id", "label", "mean_score", "position")


_LOOSE = """loose AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id, nullif(c_mktsegment, 'MACHINERY') AS seg,
  CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 50) END AS v FROM customer)"""


@query("rank_with_nulls", f"""WITH {_LOOSE}
SELECT entity_id, seg, v, CASE WHEN v IS NOT NULL THEN round(100.0::DOUBLE * (rank() OVER (PARTITION BY seg, v IS NULL ORDER BY v)
  + (count(*) OVER (PARTITION BY seg, v) - 1) / 2.0::DOUBLE) / count(v) OVER (PARTITION BY seg), 6) END AS percentile FROM loose""")
def rank_with_nulls(spark, sf):
    """Percentiles within groups of which one has no name; rows without a value keep a null rank."""
    loose = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("seg"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 50).cast("double")).alias("v"))
    return percentile_ranks(loose, "v", ["seg"]).withColumn("percentile", F.round("percentile", 6))


@query("fold_auc", f"""WITH {B.SCORES}, r AS (
  SELECT *, rank() OVER (PARTITION BY {KEYS} ORDER BY proba) + (count(*) OVER (PARTITION BY {KEYS}, proba) - 1) / 2.0::DOUBLE AS rk
  FROM scores)
SELECT CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(fold AS INT) AS fold,
       round((sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
             / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS auc,
       count(*) FILTER (proba >= 1 - proba AND label = 1) AS tp, count(*) FILTER (proba >= 1 - proba AND label = 0) AS fp,
       count(*) FILTER (proba < 1 - proba AND label = 0) AS tn, count(*) FILTER (proba < 1 - proba AND label = 1) AS fn,
       round(avg(CASE WHEN (proba >= 1 - proba) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 8) AS accuracy
FROM r GROUP BY ALL""")
def fold_auc(spark, sf):
    scored = pin(B.scores(spark, sf), "scores")
    out = S.auc(scored).drop("n_positive", "n_negative").join(S.confusion(scored), S.FOLD_KEYS).drop("clf")
    return out.withColumn("auc", F.round("auc", 8)).withColumn("accuracy", F.round("accuracy", 8))


_AUCS = f"""r AS (SELECT *, rank() OVER (PARTITION BY clf, {KEYS} ORDER BY proba)
  + (count(*) OVER (PARTITION BY clf, {KEYS}, proba) - 1) / 2.0::DOUBLE AS rk FROM scores),
aucs AS (SELECT clf, {KEYS}, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r GROUP BY ALL)"""


@query("auc_summary", f"""WITH {B.VARIANT_SCORES}, {_AUCS},
s AS (SELECT clf, avg(auc) AS mean_auc, median(auc) AS median_auc, count(*) AS n FROM aucs GROUP BY 1)
SELECT clf, round(mean_auc, 6) AS mean_auc, round(median_auc, 6) AS median_auc, n,
       CASE WHEN row_number() OVER (ORDER BY median_auc DESC, clf) = 1 THEN 1 ELSE 0 END AS top FROM s""")
def auc_summary(spark, sf):
    return S.auc_summary(S.auc(B.variant_scores(spark, sf))).select(
        "clf", F.round("mean_auc", 6).alias("mean_auc"), F.round("median_auc", 6).alias("median_auc"), "n", "top")


@query("mean_roc", f"""WITH {B.SCORES},
g AS (SELECT {KEYS}, proba, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM scores GROUP BY ALL),
c AS (SELECT {KEYS}, sum(tp) OVER w / sum(tp) OVER (PARTITION BY {KEYS}) AS tpr,
             sum(fp) OVER w / sum(fp) OVER (PARTITION BY {KEYS}) AS fpr
      FROM g WINDOW w AS (PARTITION BY {KEYS} ORDER BY proba DESC)),
s AS (SELECT {KEYS}, fpr, min(tpr) AS low, max(tpr) AS high FROM (
      SELECT * FROM c UNION ALL SELECT DISTINCT {KEYS}, 0, 0 FROM c) GROUP BY ALL),
grid AS (SELECT DISTINCT {KEYS}, point, point / 99.0::DOUBLE AS x FROM c, (SELECT unnest(range(0, 100)) AS point)),
e AS (SELECT {KEYS}, point, x, max(fpr) FILTER (fpr < x) AS f0, arg_max(high, fpr) FILTER (fpr < x) AS t0,
             min(fpr) FILTER (fpr >= x) AS f1, arg_min(low, fpr) FILTER (fpr >= x) AS t1,
             arg_min(high, fpr) FILTER (fpr >= x) AS h1 FROM grid JOIN s USING ({KEYS}) GROUP BY ALL),
y AS (SELECT point, x, CASE WHEN point = 0 THEN 0 WHEN f1 = x THEN h1 ELSE t0 + (t1 - t0) / (f1 - f0) * (x - f0) END AS tpr FROM e),
m AS (SELECT point, x, avg(tpr) AS mt, stddev_pop(tpr) AS sd FROM y GROUP BY ALL)
SELECT CAST(point AS INT) AS point, round(CASE WHEN point = 99 THEN 1 ELSE mt END, 6) AS mean_tpr, round(sd, 6) AS sd_tpr,
       round(least(mt + sd, 1), 6) AS upper, round(greatest(mt - sd, 0), 6) AS lower FROM m""")
def mean_roc(spark, sf):
    out = S.mean_roc(pin(B.scores(spark, sf), "scores"))
    return out.select("point", *[F.round(c, 6).alias(c) for c in ("mean_tpr", "sd_tpr", "upper", "lower")])


@query("random_draws", f"""WITH {B.MEMBERS}, d AS (SELECT *, row_number() OVER (PARTITION BY iter, block, draw, label ORDER BY
  md5(concat('draw:', iter, ':', block, ':', draw, ':', entity_id)), entity_id) AS rn,
  count(*) OVER (PARTITION BY iter, block, draw, label) AS n FROM members, (SELECT unnest([0, 1]) AS draw))
SELECT CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(draw AS INT) AS draw, label, entity_id,
       CASE WHEN rn <= floor(n * 0.25::DOUBLE) THEN 1 ELSE 0 END AS is_test FROM d""")
def random_draws(spark, sf):
    members = bagging.pu_membership(B.entities(spark, sf), B.ITERATIONS, B.RATIO, B.FOLDS)
    return bagging.random_draws(pin(members, "membership"), 2, 0.25)


@query("sampled_blocks", f"""WITH {B.MEMBERS}, b AS (SELECT DISTINCT iter, block FROM members ORDER BY
  md5(concat('eval:', iter, ':', block)), iter, block LIMIT 4)
SELECT CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(fold AS INT) AS fold, entity_id, label
FROM members JOIN b USING (iter, block)""")
def sampled_blocks(spark, sf):
    members = bagging.pu_membership(B.entities(spark, sf), B.ITERATIONS, B.RATIO, B.FOLDS)
    return bagging.sample_blocks(pin(members, "membership"), 4)


@query("seed_subsample", f"""WITH {B.ENT}, p AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS u FROM ent),
q AS (SELECT CAST(round_even(p * 0.7, 0) AS BIGINT) AS used, u, CAST(round_even(round_even(p * 0.7, 0) * 2.0, 0) AS BIGINT) AS n FROM p),
c AS (SELECT block, entity_id, row_number() OVER (PARTITION BY block ORDER BY md5(concat('pu:1:', block, ':', entity_id)), entity_id) AS rn
  FROM ent, (SELECT unnest(range(0, u // n)) AS block FROM q) WHERE label = 1)
SELECT CAST(block AS INT) AS block, CAST(ntile(3) OVER (PARTITION BY block ORDER BY rn) - 1 AS INT) AS fold, entity_id
FROM c WHERE rn <= (SELECT used FROM q)""")
def seed_subsample(spark, sf):
    members = bagging.pu_membership(B.entities(spark, sf), 1, 2.0, 3, seed_ratio=0.7)
    return members.filter("label = 1").select("block", "fold", "entity_id")


@query("median_scores", f"""WITH {B.SCORES} SELECT entity_id, round(median(proba), 6) AS median_score,
  round(quantile_cont(proba, 0.25), 9) AS q25, count(*) AS n FROM scores GROUP BY 1""")
def median_scores(spark, sf):
    scored = pin(B.scores(spark, sf), "scores")
    middle = S.median_scores(scored).drop("clf").withColumn("median_score", F.round("median_score", 6))
    five = S.five_numbers(scored, "proba", ["entity_id"], ["iter", "block", "fold"]).select(
        "entity_id", F.round("q25", 9).alias("q25"), "n")
    return middle.join(five, "entity_id")


@query("score_ecdf", f"""WITH {B.SCORES}, {B.RANKED},
d AS (SELECT label, mean_score AS value, cume_dist() OVER (PARTITION BY label ORDER BY mean_score) AS cdf FROM ranked)
SELECT DISTINCT label, value, round(cdf, 8) AS cdf FROM d
UNION ALL SELECT DISTINCT label, 0, 0 FROM d UNION ALL SELECT DISTINCT label, 1, 1 FROM d""")
def score_ecdf(spark, sf):
    means = S.mean_scores(B.scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.ecdf(means, "mean_score", ["label"]).withColumn("cdf", F.round("cdf", 8))


@query("score_quantiles", f"""WITH {B.VARIANT_SCORES}, {B.RANKED}
SELECT clf, label, round(min(mean_score), 6) AS q0, round(quantile_cont(mean_score, 0.25), 9) AS q25,
       round(quantile_cont(mean_score, 0.5), 9) AS q50, round(quantile_cont(mean_score, 0.75), 9) AS q75,
       round(max(mean_score), 6) AS q100, count(*) AS n FROM ranked GROUP BY ALL""")
def score_quantiles(spark, sf):
    means = S.mean_scores(B.variant_scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    out = S.five_numbers(means, "mean_score", ["clf", "label"], ["entity_id"])
    return out.select("clf", "label", F.round("q0", 6).alias("q0"), F.round("q100", 6).alias("q100"), "n",
                      *[F.round(c, 9).alias(c) for c in ("q25", "q50", "q75")])


@query("score_histogram", f"""WITH {B.SCORES}, {B.RANKED}
SELECT label, CAST(least(floor(mean_score / (1.0::DOUBLE / 36)) + 1, 36) AS INT) AS bin, count(*) AS n FROM ranked GROUP BY ALL""")
def score_histogram(spark, sf):
    means = S.mean_scores(B.scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.histogram(means, "mean_score", 0.0, 1.0, 36)


@query("score_density", f"""WITH {B.SCORES}, {B.RANKED},
facts AS (SELECT *, low0 - 3 * h AS low, (high0 - low0 + 6 * h) / 400 AS step FROM (SELECT label, count(*) AS n, min(mean_score) AS low0,
  max(mean_score) AS high0, stddev_samp(mean_score) * pow(count(*), -0.2) AS h FROM ranked GROUP BY 1) WHERE h > 0),
dealt AS (SELECT label, h, low, step, n, floor((mean_score - low) / step) AS k, (mean_score - low) / step - floor((mean_score - low) / step) AS share
  FROM ranked JOIN facts USING (label)),
bins AS (SELECT label, bin, sum(w) AS w FROM (SELECT label, k AS bin, 1 - share AS w FROM dealt UNION ALL SELECT label, k + 1, share FROM dealt) GROUP BY ALL),
grid AS (SELECT *, low + point * step * 4 AS x FROM facts, (SELECT CAST(unnest(range(0, 101)) AS INT) AS point))
SELECT label, point, round(x, 6) AS x, round(sum(w * exp(-0.5 * pow((x - low - bin * step) / h, 2)) / (h * sqrt(2 * pi()) * n)), 6) AS density
FROM bins JOIN grid USING (label) GROUP BY label, point, x""")
def score_density(spark, sf):
    """Smooth densities of the mean scores of seeds and others."""
    means = S.mean_scores(B.scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.density(means, "mean_score").select("label", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


_PREDICTED = """v AS (SELECT clf, entity_id, max(label) AS label, count(*) FILTER (proba >= 1 - proba) AS pos, count(*) AS n
  FROM scores GROUP BY ALL),
predicted AS (SELECT *, CASE WHEN label = 1 THEN 'known' ELSE 'novel' END AS kind FROM v WHERE pos / n >= 0.6)"""


@query("known_novel_counts", f"""WITH {B.VARIANT_SCORES}, {_PREDICTED}
SELECT clf, count(*) FILTER (kind = 'known') AS known, count(*) FILTER (kind = 'novel') AS novel FROM predicted GROUP BY 1""")
def known_novel_counts(spark, sf):
    return S.known_novel_counts(S.predicted_entities(S.votes(B.variant_scores(spark, sf)), 0.6))


@query("predicted_entities", f"""WITH {B.SCORES}, {_PREDICTED}
SELECT entity_id, kind, round(pos / n, 6) AS positive_ratio FROM predicted
UNION ALL SELECT entity_id, 'above half', NULL FROM (SELECT entity_id, avg(proba) AS m FROM scores GROUP BY 1) WHERE m > 0.5000001""")
def predicted_entities(spark, sf):
    scored = pin(B.scores(spark, sf), "scores")
    listed = S.predicted_entities(S.attach_labels(S.votes(scored), B.entities(spark, sf)), 0.6).select(
        "entity_id", "kind", F.round("positive_ratio", 6).alias("positive_ratio"))
    return listed.unionByName(S.above_mean(scored, 0.5000001).select(
        "entity_id", F.lit("above half").alias("kind"), F.lit(None).cast("double").alias("positive_ratio")))


@query("top_fraction", f"""WITH {B.SCORES}, {B.RANKED}, t AS (
  SELECT *, row_number() OVER (ORDER BY mean_score DESC, entity_id) AS rank, count(*) OVER () AS n FROM ranked)
SELECT entity_id, rank, mean_score, CASE WHEN rank <= 20 THEN 1 ELSE 0 END AS in_top_20 FROM t WHERE rank <= floor(n * 0.1::DOUBLE)""")
def top_fraction(spark, sf):
    means = pin(S.mean_scores(B.scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS)), "means")
    best = S.top_rows(means, "mean_score", 20).select("entity_id", F.lit(1).alias("in_top_20"))
    top = S.top_fraction(means, "mean_score", 0.1)
    return top.join(best, "entity_id", "left").fillna(0, subset=["in_top_20"]).select(
        "entity_id", "rank", "mean_score", "in_top_20")


@query("rank_positions", f"""WITH {B.SCORES}, {B.RANKED}, {B.EXTERNAL},
m AS (SELECT entity_id, row_number() OVER (ORDER BY mean_score DESC, entity_id) AS rank FROM ranked)
SELECT entity_id, rank, external_rank FROM m JOIN ext USING (entity_id)""")
def rank_positions(spark, sf):
    means = S.mean_scores(B.scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    ranked = number_rows(means, [F.desc("mean_score"), F.col("entity_id")], "rank")
    return ranked.select("entity_id", "rank").join(B.external(spark, sf).select("entity_id", "external_rank"), "entity_id")


_LISTED = """listed AS (SELECT * FROM (SELECT clf, entity_id, row_number() OVER (PARTITION BY clf ORDER BY mean_score DESC, entity_id)
  AS rank, count(*) OVER (PARTITION BY clf) AS n FROM ranked) WHERE rank <= floor(n * 0.2::DOUBLE))"""


def _listed(ranked):
    return S.top_fraction(ranked, "mean_score", 0.2, keys=["clf"]).select("clf", "entity_id")


@query("consensus_vote", f"""WITH {B.VARIANT_SCORES}, {B.RANKED}, {_LISTED}
SELECT entity_id, count(DISTINCT clf) AS n_clf FROM listed GROUP BY 1 HAVING count(DISTINCT clf) >= 2""")
def consensus_vote(spark, sf):
    means = S.mean_scores(B.variant_scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.consensus(_listed(means), len(B.VARIANTS))


@query("consensus_matrix", f"""WITH {B.VARIANT_SCORES}, {B.RANKED}, {_LISTED},
h AS (SELECT entity_id, count(DISTINCT clf) AS hits FROM listed GROUP BY 1 HAVING count(DISTINCT clf) >= 2)
SELECT entity_id, hits, """ + ", ".join(
    f"round(max(percentile) FILTER (clf = '{c}'), 6) AS {c}" for c in B.VARIANTS) + """
FROM h JOIN ranked USING (entity_id) GROUP BY ALL""")
def consensus_matrix(spark, sf):
    ranked = pin(S.rankings(S.mean_scores(B.variant_scores(spark, sf)), B.DECIMALS), "ranked")
    out = S.consensus_matrix(_listed(ranked), ranked, list(B.VARIANTS), slack=1)
    return out.select("entity_id", "hits", *[F.round(c, 6).alias(c) for c in B.VARIANTS])


@query("consensus_sweep", f"""WITH {B.VARIANT_SCORES}, {B.RANKED}, {_LISTED},
h AS (SELECT entity_id, count(DISTINCT clf) AS hits FROM listed GROUP BY 1)
SELECT entity_id, hits, CAST(relaxation AS INT) AS relaxation FROM h, (SELECT unnest(range(0, 2)) AS relaxation)
WHERE hits >= 3 - relaxation""")
def consensus_sweep(spark, sf):
    means = S.mean_scores(B.variant_scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.consensus_sweep(_listed(means), list(B.VARIANTS))


@query("merged_scores", f"""WITH {B.VARIANT_SCORES}
SELECT entity_id, round(avg(proba) / 7, 6) AS mean_score, count(*) AS n_scores FROM scores GROUP BY 1""")
def merged_scores(spark, sf):
    return S.merged_scores(B.variant_scores(spark, sf)).withColumn("mean_score", F.round(F.col("mean_score") / 7, 6))


@query("score_correlations", f"""WITH {B.VARIANT_SCORES}, {B.RANKED}
SELECT a.clf AS i, b.clf AS j, round(corr(a.mean_score, b.mean_score), 6) AS r FROM ranked a JOIN ranked b USING (entity_id)
WHERE (a.clf, b.clf) IN (('NB_all', 'NB_trade'), ('NB_all', 'NB_part'), ('NB_trade', 'NB_part')) GROUP BY 1, 2""")
def score_correlations(spark, sf):
    means = S.mean_scores(B.variant_scores(spark, sf)).withColumn("mean_score", F.round("mean_score", B.DECIMALS))
    return S.score_correlations(means, list(B.VARIANTS)).withColumn("r", F.round("r", 6))


@query("iteration_stability", f"""WITH {B.SCORES}, c AS (SELECT unnest([1, 2, 3]) AS iterations),
p AS (SELECT iterations, entity_id, max(label) AS label, avg(CASE WHEN proba >= 1 - proba THEN 1.0::DOUBLE ELSE 0 END) AS ratio
  FROM scores JOIN c ON iter <= iterations GROUP BY 1, 2)
SELECT iterations, count(*) FILTER (ratio >= 0.5 AND label = 1) AS known, count(*) FILTER (ratio >= 0.5 AND label = 0) AS novel
FROM p GROUP BY 1""")
def iteration_stability(spark, sf):
    return S.iteration_stability(B.scores(spark, sf), [1, 2, 3])


@query("iteration_correlations", f"""WITH {B.SCORES}, c AS (SELECT unnest([1, 2, 3]) AS iterations),
p AS (SELECT iterations, entity_id, avg(proba) AS m FROM scores JOIN c ON iter <= iterations GROUP BY 1, 2)
SELECT CAST(a.iterations AS VARCHAR) AS i, CAST(b.iterations AS VARCHAR) AS j, round(corr(a.m, b.m), 6) AS r FROM p a JOIN p b USING (entity_id)
WHERE a.iterations < b.iterations GROUP BY 1, 2""")
def iteration_correlations(spark, sf):
    means = S.means_by_iterations(B.scores(spark, sf), [1, 2, 3])
    return S.score_correlations(means, [1, 2, 3], by="iterations").withColumn("r", F.round("r", 6))


def _auc_sql(feature: str, value: str, t: str) -> str:
    return f"""SELECT '{feature}' AS feature, round((sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE)
  / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM (SELECT y, rank() OVER (ORDER BY x)
  + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rk FROM (SELECT {value} AS x, y FROM {t}))"""


_ROUNDED = [f"round({c}, 4)" for c in B.FEATURES]  # sums of doubles differ in their last digits


_CLASSES, _STEPS = ["bolt", "gear", "widget"], 8


def _class_models_sql() -> str:
    """CTEs up to `judged`: Newton steps of one-feature models; needs `feats`."""
    names = ", ".join(f"'{c}'" for c in _CLASSES)
    long = " UNION ALL ".join(f"SELECT class, p.label, test, '{c}' AS feature, {c} AS x FROM parted p JOIN feats USING (entity_id)" for c in B.FEATURES)
    steps = "".join(f""", s{i} AS (SELECT *, label - p AS g, p * (1 - p) AS w FROM (SELECT *, 1 / (1 + exp(-greatest(least(a + b * z, 700), -700))) AS p
    FROM (SELECT l.*, a, b, n, mean, sd, (x - mean) / sd AS z FROM long l JOIN m{i} USING (class, feature) WHERE NOT test))),
h{i} AS (SELECT class, feature, n, mean, sd, a, b, sum(g) AS g0, sum(g * z) AS g1, sum(w) + 1e-9 AS h0, sum(w * z) AS h1,
    sum(w * z * z) + 1e-9 AS h2 FROM s{i} GROUP BY ALL),
m{i + 1} AS (SELECT class, feature, n, mean, sd, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a,
    b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS b FROM h{i})""" for i in range(_STEPS))
    return f"""named AS (SELECT c AS class, CAST(p_partkey AS VARCHAR) AS entity_id FROM part, (SELECT unnest([{names}]) AS c) WHERE contains(p_name, c)),
negatives AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id FROM part
  WHERE p_type = 'PROMO' AND NOT regexp_matches(p_name, '{"|".join(_CLASSES)}')),
members AS (SELECT class, entity_id, 1 AS label FROM named UNION ALL SELECT c, entity_id, 0 FROM negatives, (SELECT DISTINCT class AS c FROM named)),
parted AS (SELECT class, entity_id, label, rn <= floor(n * 0.2::DOUBLE) AS test FROM (SELECT *, row_number() OVER (PARTITION BY class, label
  ORDER BY md5(concat('split:', entity_id)), entity_id) AS rn, count(*) OVER (PARTITION BY class, label) AS n FROM members)),
long AS ({long}),
m0 AS (SELECT class, feature, count(*) AS n, avg(x) AS mean, CASE WHEN stddev_pop(x) > 0 THEN stddev_pop(x) ELSE 1 END AS sd,
  0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM long WHERE NOT test GROUP BY ALL){steps},
ranked_test AS (SELECT class, feature, label, rank() OVER (PARTITION BY class, feature ORDER BY odds)
  + (count(*) OVER (PARTITION BY class, feature, odds) - 1) / 2.0::DOUBLE AS rk
  FROM (SELECT l.*, a + b * ((x - mean) / sd) AS odds FROM long l JOIN m{_STEPS} USING (class, feature) WHERE test)),
judged AS (SELECT class, feature, count(*) AS n_test, (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1)
  * (count(*) FILTER (label = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) AS auc
  FROM ranked_test GROUP BY ALL)"""


@query("class_feature_models", f"""WITH {B.FEATS}, {_class_models_sql()}
SELECT class, feature, n AS n_train, round(a - b * mean / sd, 6) AS intercept, round(b / sd, 6) AS slope, n_test, round(auc, 6) AS auc
FROM m{_STEPS} JOIN judged USING (class, feature)""")
def class_feature_models(spark, sf):
    """Each class of parts, by a word of their names, against promoted parts of no class, by each single feature."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), "p_name", "p_type")
    classes = part.select("entity_id", "p_name", F.explode(F.array(*[F.lit(c) for c in _CLASSES])).alias("class")).filter(
        F.col("p_name").contains(F.col("class")))
    negatives = part.filter((F.col("p_type") == "PROMO") & ~F.col("p_name").rlike("|".join(_CLASSES)))
    out = one_feature_models(class_members(classes, negatives), B.features(spark, sf), B.FEATURES, _STEPS)
    return out.select("class", "feature", "n_train", "n_test", *[F.round(c, 6).alias(c) for c in ("intercept", "slope", "auc")])


@query("single_feature_auc", f"""WITH {B.FEATS}, f AS (SELECT *, label AS y FROM feats),
d AS (SELECT n_chars, quality AS y FROM documents JOIN labels USING (doc_id)) """ + " UNION ALL ".join(
    [_auc_sql(c, r, "f") for c, r in zip(B.FEATURES, _ROUNDED)] + [_auc_sql("n_chars", "n_chars", "d")]))
def single_feature_auc(spark, sf):
    feats = B.features(spark, sf)
    long = feats.select("label", F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.round(c, 4).alias("value")) for c in B.FEATURES])).alias("f")).select("label", "f.*")
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("value")).join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    both = long.unionByName(docs.select("label", F.lit("n_chars").alias("feature"), "value"))
    return S.auc(both, ["feature"], "value").select("feature", F.round("auc", 6).alias("auc"))
