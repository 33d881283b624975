"""Queries that fit models: no SQL equivalent, except for the decisions on their results."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedlift.operators import embed, shadow
from seedlift.operators import learners as L
from seedlift.operators.bagging import pu_membership
from seedlift.operators.bayes import with_features
from seedlift.operators.stats import importance_summary
from seedlift.operators.trees import Forest
from seedlift.plans import base as B
from seedlift.plans.registry import query, table
from seedlift.runtime import pin

# Learners, ratio and folds are the reference's; one of its ten iterations.
FOLDS = 10


def _rows(spark, sf, folds: int = FOLDS, iterations: int = 1):
    table_ = B.scaled(spark, sf)
    members = pin(pu_membership(table_.select("entity_id", "label"), iterations, B.RATIO, folds), "membership")
    return pin(with_features(members, table_, B.FEATURES), "rows")


def _scores(spark, sf, name, iterations: int = 1):
    out, _ = L.fit_folds(_rows(spark, sf, iterations=iterations), B.FEATURES, {name: L.LEARNERS[name]})
    return out.withColumn("proba", F.round("proba", 6))


@query("rf_scores")
def rf_scores(spark, sf):
    return _scores(spark, sf, "RandomForestClassifier")


@query("et_scores")
def et_scores(spark, sf):
    return _scores(spark, sf, "ExtraTreesClassifier")


@query("svc_scores")
def svc_scores(spark, sf):
    return _scores(spark, sf, "SVC")


@query("gbt_scores")
def gbt_scores(spark, sf):
    return _scores(spark, sf, "GradientBoostingClassifier")


@query("slow_boosting_scores")
def slow_boosting_scores(spark, sf):
    return _scores(spark, sf, "XGBoost")


@query("mlp_scores")
def mlp_scores(spark, sf):
    return _scores(spark, sf, "DNN")


LEARNER_NAMES = sorted(L.LEARNERS)


@query("learner_coverage", f"""WITH {B.ENT}, {B.members_sql(1, FOLDS)}
SELECT clf, CAST(iter AS INT) AS iter, CAST(block AS INT) AS block, CAST(fold AS INT) AS fold, count(*) AS held, count(*) FILTER (label = 1) AS seeds, 1 AS fits, true AS in_range
FROM members, (SELECT unnest({LEARNER_NAMES}) AS clf) GROUP BY ALL""")
def learner_coverage(spark, sf):
    """Every member is scored once by every learner, out of its own fold."""
    out, _ = L.fit_folds(_rows(spark, sf), B.FEATURES, L.LEARNERS)
    return out.groupBy("clf", "iter", "block", "fold").agg(
        F.count_distinct("entity_id").alias("held"), F.sum("label").alias("seeds"),
        (F.count("*") / F.count_distinct("entity_id")).cast("int").alias("fits"),
        F.bool_and((F.col("proba") >= 0) & (F.col("proba") <= 1)).alias("in_range"))


@query("stacking")
def stacking(spark, sf):
    """The reference's four bases and final net. Every pair of folds is fitted, so folds are five."""
    bases = {n: L.LEARNERS[n] for n in L.STACKING}
    out = L.stacking_scores(_rows(spark, sf, 5), B.FEATURES, bases, L.LEARNERS[L.STACKING_FINAL], add_original=True)
    return out.withColumn("proba", F.round("proba", 6))


@query("feature_importance")
def feature_importance(spark, sf):
    few = {n: L.LEARNERS[n] for n in ("RandomForestClassifier", "ExtraTreesClassifier", "XGBoost")}
    _, importance = L.fit_folds(_rows(spark, sf), B.FEATURES, few)
    return importance_summary(importance)


@query("grid_search")
def grid_search(spark, sf):
    """The reference's small grid for forests, ten folds."""
    return L.grid_search(B.scaled(spark, sf), B.FEATURES, Forest(leaf=2, split=2), {"trees": [100, 200], "depth": [5]})


@query("pairwise_search")
def pairwise_search(spark, sf):
    pairs = [{"trees": [100, 200], "depth": [5, 10]}, {"leaf": [2, 5], "split": [2, 5]}]
    return L.pairwise_search(B.scaled(spark, sf), B.FEATURES, Forest(leaf=2, split=2), pairs)


@query("centred_embedding", """
WITH e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT vec_id, i, v::DOUBLE - avg(v::DOUBLE) OVER (PARTITION BY i) AS x FROM e)
SELECT vec_id, round(sqrt(sum(x * x)), 6) AS length FROM c GROUP BY 1""")
def centred_embedding(spark, sf):
    """Distance of each embedding from the mean: what the components are taken of."""
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import vector_to_array

    rows = embed.as_vectors(table(spark, sf, "embeddings"), array="embedding")
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="c").fit(rows).transform(rows)
    squares = F.aggregate(vector_to_array("c"), F.lit(0.0), lambda a, x: a + x * x)
    return centred.select("vec_id", F.round(F.sqrt(squares), 6).alias("length"))


@query("pca_embedding")
def pca_embedding(spark, sf):
    rows = embed.as_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), array="embedding")
    points, _ = embed.principal_components(rows, 20)
    return points.select("vec_id", F.transform("pcs", lambda x: F.round(x, 6)).alias("pcs"))


@query("explained_variance")
def explained_variance(spark, sf):
    rows = embed.as_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), array="embedding")
    return embed.principal_components(rows, 20)[1]


@query("cluster_embedding")
def cluster_embedding(spark, sf):
    rows = embed.as_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"), array="embedding")
    points, _ = embed.principal_components(rows, 2)
    return embed.cluster(points).select("vec_id", "cluster")


@query("shadow_features")
def shadow_features(spark, sf):
    """Decisions on every feature over one run for each block of an iteration."""
    rounds = shadow.shadow_rounds(_rows(spark, sf), B.FEATURES)
    return shadow.final_decisions(shadow.run_decisions(rounds))


@query("shadow_decision", """
WITH m AS (SELECT n.n_regionkey AS run, c_mktsegment AS feature, avg(c_acctbal) AS a FROM customer JOIN nation n
  ON c_nationkey = n_nationkey GROUP BY ALL),
d AS (SELECT run, feature, CASE WHEN a > 4600 THEN 'Confirmed' WHEN a > 4300 THEN 'Tentative' ELSE 'Rejected' END AS decision FROM m),
s AS (SELECT feature, 100.0::DOUBLE * count(*) FILTER (decision = 'Confirmed') / r.n AS confirmed,
  100.0::DOUBLE * count(*) FILTER (decision = 'Tentative') / r.n AS tentative,
  100.0::DOUBLE * (r.n - count(*) FILTER (decision IN ('Confirmed', 'Tentative'))) / r.n AS rejected
  FROM d, (SELECT count(DISTINCT run) AS n FROM d) r GROUP BY feature, r.n)
SELECT feature, round(confirmed, 6) AS confirmed, round(tentative, 6) AS tentative, round(rejected, 6) AS rejected,
  CASE WHEN rejected >= 90 THEN 'Rejected' WHEN confirmed >= 50 THEN 'Confirmed' ELSE 'Tentative' END AS final FROM s""")
def shadow_decision(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("run"))
    means = table(spark, sf, "customer").join(nations, "c_nationkey").groupBy(
        "run", F.col("c_mktsegment").alias("feature")).agg(F.avg("c_acctbal").alias("a"))
    decision = F.when(F.col("a") > 4600, "Confirmed").when(F.col("a") > 4300, "Tentative").otherwise("Rejected")
    out = shadow.final_decisions(means.withColumn("decision", decision))
    return out.select("feature", "final", *[F.round(c, 6).alias(c) for c in ("confirmed", "tentative", "rejected")])
