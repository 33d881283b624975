"""What the queries share: parts as entities, their seeds, features and scores."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedlift.functions.numbers import flag
from seedlift.operators.bagging import pu_membership
from seedlift.operators.bayes import naive_bayes_scores, score_rows, with_features
from seedlift.operators.features import assemble
from seedlift.operators.joins import label_known
from seedlift.operators.prep import standardise
from seedlift.operators.terms import seeds_from_terms
from seedlift.plans.registry import table
from seedlift.runtime import pin

INCLUDE, EXCLUDE = ["widget"], ["small"]
FEATURES = ["n_lines", "qty", "price", "disc", "tax", "returned", "size", "retail"]
# Three naive Bayes variants on different features stand in for different classifiers.
VARIANTS = {"NB_all": FEATURES, "NB_trade": FEATURES[:6], "NB_part": ["qty", "size", "retail"]}
ITERATIONS, FOLDS, RATIO, DECIMALS = 3, 5, 1.5, 6
TOP = 0.05


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every part with label 1 for seeds."""
    part = table(spark, sf, "part")
    universe = part.select(F.col("p_partkey").cast("string").alias("entity_id"))
    return label_known(universe, seeds(spark, sf))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return seeds_from_terms(table(spark, sf, "part"), "p_partkey", "p_name", INCLUDE, EXCLUDE)[0]


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("entity_id")).agg(
        F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("qty"),
        F.avg("l_extendedprice").alias("price"), F.avg("l_discount").alias("disc"), F.avg("l_tax").alias("tax"),
        F.avg(flag(F.col("l_returnflag") == "R")).alias("returned"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """The wide part table: label, sales aggregates, own columns."""
    part = table(spark, sf, "part")
    key = F.col("p_partkey").cast("string").alias("entity_id")
    own = part.select(key, F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"))
    return assemble(part.select(key), seeds(spark, sf), [sales(spark, sf), own], FEATURES)


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Standardised features; the raw table is written once and read from there on."""
    return standardise(features(spark, sf), FEATURES)


def membership(table_: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Blocks and folds of a feature table's entities, written once for all learners."""
    return pin(pu_membership(table_.select("entity_id", "label"), iterations, RATIO, FOLDS), "membership")


def rounded(scores: DataFrame) -> DataFrame:
    """Scores to six places, so that sums taken in another order rank alike."""
    return scores.withColumn("proba", F.round("proba", DECIMALS))


def scores(spark: SparkSession, sf: str, iterations: int = ITERATIONS) -> DataFrame:
    table_ = scaled(spark, sf)
    return rounded(naive_bayes_scores(membership(table_, iterations), table_, FEATURES))


def variant_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all variants over one table of membership rows with features."""
    table_ = scaled(spark, sf)
    rows = pin(with_features(membership(table_), table_, FEATURES), "rows")
    return pin(rounded(reduce(DataFrame.unionByName, [
        score_rows(rows, columns, name) for name, columns in VARIANTS.items()])), "scores")


def external(spark: SparkSession, sf: str) -> DataFrame:
    """External list: parts by discounted revenue, highest first; p is the rank's share."""
    from seedlift.operators.enrich import external_ranking

    revenue = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("entity_id")).agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return external_ranking(revenue, -F.col("revenue"), p_from_rank=True)


# ---- the same in SQL --------------------------------------------------------------

ENT = """ent AS (
  SELECT CAST(p_partkey AS VARCHAR) AS entity_id,
         CASE WHEN regexp_matches(p_name, '(?i)(widget)') AND NOT regexp_matches(p_name, '(?i)(small)')
              THEN 1 ELSE 0 END AS label
  FROM part)"""

SALES = """sales AS (
  SELECT CAST(l_partkey AS VARCHAR) AS entity_id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS qty,
         avg(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS returned
  FROM lineitem GROUP BY 1)"""

FEATS = ENT + ", " + SALES + """, feats AS (
  SELECT e.entity_id, e.label, coalesce(n_lines, 0) AS n_lines, coalesce(qty, 0) AS qty, coalesce(price, 0) AS price,
         coalesce(disc, 0) AS disc, coalesce(tax, 0) AS tax, coalesce(returned, 0) AS returned,
         coalesce(CAST(p_size AS DOUBLE), 0) AS size, coalesce(p_retailprice, 0) AS retail
  FROM ent e LEFT JOIN sales s USING (entity_id) JOIN part p ON CAST(p.p_partkey AS VARCHAR) = e.entity_id)"""

SCALED = FEATS + ", scaled AS (SELECT entity_id, label, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in FEATURES
) + " FROM feats)"


_RUN_NAMES = ("ent sizes sizes2 iters others placed copies members rows per_fold rest wide models scores means ranked").split()


def another_run(sql: str, suffix: str) -> str:
    """The same CTEs under other names, for a second run in one statement."""
    return re.sub(rf"\b({'|'.join(_RUN_NAMES)})\b", rf"\1{suffix}", sql)


def members_sql(iterations: int = ITERATIONS, k: int = FOLDS, ratio: float = RATIO) -> str:
    """CTEs up to `members`; needs `ent`."""
    return f"""sizes AS (
  SELECT U, n, U // n AS K, U - (U // n) * n AS R FROM (
    SELECT count(*) FILTER (label = 0) AS U,
           CAST(round_even(count(*) FILTER (label = 1) * {ratio}, 0) AS BIGINT) AS n FROM ent)),
sizes2 AS (SELECT *, greatest(CAST(ceil(R / rem) AS BIGINT) - 1, 0) AS m FROM (
  SELECT *, CAST(round_even(R / K, 0) AS BIGINT) + 1 AS rem FROM sizes)),
iters AS (SELECT unnest(range(1, {iterations + 1})) AS iter),
others AS (
  SELECT iter, entity_id, label, row_number() OVER (PARTITION BY iter ORDER BY
         md5(concat('pu:', iter, ':', entity_id)), entity_id) AS rn
  FROM ent, iters WHERE label = 0),
placed AS (
  SELECT iter, entity_id, label, rn, CASE WHEN rn <= K * n THEN (rn - 1) // n
         WHEN m = 0 THEN K - 1 ELSE least((rn - K * n - 1) // rem, m - 1) END AS block
  FROM others, sizes2),
copies AS (
  SELECT iter, entity_id, label, block, row_number() OVER (PARTITION BY iter, block ORDER BY
         md5(concat('pu:', iter, ':', block, ':', entity_id)), entity_id) AS rn
  FROM ent, iters, (SELECT unnest(range(0, K)) AS block FROM sizes2) WHERE label = 1),
members AS (
  SELECT iter, block, entity_id, label,
         ntile({k}) OVER (PARTITION BY iter, block, label ORDER BY rn) - 1 AS fold
  FROM (SELECT iter, block, entity_id, label, rn FROM placed
        UNION ALL SELECT iter, block, entity_id, label, rn FROM copies))"""


def bayes_sql(clf: str, columns: list[str], suffix: str = "") -> str:
    """CTEs up to `scores<suffix>`; needs `members` and `scaled`."""
    names = ["n"] + [f"{k}_{c}" for c in columns for k in "sq"]
    sums = ", ".join(["CAST(count(*) AS DOUBLE) AS n"] + [
        f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in columns])
    rest = ", ".join(f"sum({x}) OVER (PARTITION BY iter, block, label) - {x} AS {x}" for x in names)
    wide = ", ".join(f"max({x}) FILTER (label = {y}) AS {x}_{y}" for x in names for y in (0, 1))
    moments = ", ".join(
        f"s_{c}_{y} / nullif(n_{y}, 0) AS m_{c}_{y}, greatest(q_{c}_{y} / nullif(n_{y}, 0) - "
        f"(s_{c}_{y} / nullif(n_{y}, 0)) * (s_{c}_{y} / nullif(n_{y}, 0)), 0) + 1e-6 AS v_{c}_{y}"
        for c in columns for y in (0, 1))
    odds = "ln(nullif(n_1, 0) / nullif(n_0, 0))" + "".join(
        f" + ({c} - m_{c}_0) * ({c} - m_{c}_0) / (2 * v_{c}_0) - ({c} - m_{c}_1) * ({c} - m_{c}_1) / (2 * v_{c}_1)"
        f" + 0.5 * ln(v_{c}_0 / v_{c}_1)" for c in columns)
    return f"""rows{suffix} AS (
  SELECT m.iter, m.block, m.fold, m.entity_id, m.label, {", ".join("f." + c for c in columns)}
  FROM members m JOIN scaled f ON m.entity_id = f.entity_id),
per_fold{suffix} AS (SELECT iter, block, fold, label, {sums} FROM rows{suffix} GROUP BY ALL),
rest{suffix} AS (SELECT iter, block, fold, label, {rest} FROM per_fold{suffix}),
wide{suffix} AS (SELECT iter, block, fold, {wide} FROM rest{suffix} GROUP BY ALL),
models{suffix} AS (SELECT iter, block, fold, n_0, n_1, {moments} FROM wide{suffix}),
scores{suffix} AS (
  SELECT '{clf}' AS clf, iter, block, fold, entity_id, label,
         round(1 / (1 + exp(-greatest(least(odds, 700), -700))), {DECIMALS}) AS proba
  FROM (SELECT iter, block, fold, entity_id, label, {odds} AS odds
        FROM rows{suffix} JOIN models{suffix} USING (iter, block, fold)))"""


MEMBERS = ENT + ", " + members_sql()
SCORES = SCALED + ", " + members_sql() + ", " + bayes_sql("NaiveBayes", FEATURES)
VARIANT_SCORES = SCALED + ", " + members_sql() + ", " + ", ".join(
    bayes_sql(name, columns, f"_{i}") for i, (name, columns) in enumerate(VARIANTS.items())
) + ", scores AS (" + " UNION ALL ".join(f"SELECT * FROM scores_{i}" for i in range(len(VARIANTS))) + ")"

# Mean score (rounded), votes and percentile per classifier; needs `scores`.
RANKED = f"""means AS (
  SELECT clf, entity_id, round(avg(proba), {DECIMALS}) AS mean_score,
         count(*) FILTER (proba >= 1 - proba) AS positive_votes,
         count(*) FILTER (proba < 1 - proba) AS negative_votes, max(label) AS label
  FROM scores GROUP BY 1, 2),
ranked AS (
  SELECT *, 100.0::DOUBLE * (rank() OVER (PARTITION BY clf ORDER BY mean_score)
         + (count(*) OVER (PARTITION BY clf, mean_score) - 1) / 2.0::DOUBLE)
         / count(*) OVER (PARTITION BY clf) AS percentile FROM means)"""

EXTERNAL = """revenue AS (
  SELECT CAST(l_partkey AS VARCHAR) AS entity_id, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
  FROM lineitem GROUP BY 1),
ext AS (
  SELECT entity_id, external_rank, external_rank / CAST(count(*) OVER () AS DOUBLE) AS p
  FROM (SELECT entity_id, row_number() OVER (ORDER BY -revenue, entity_id) AS external_rank FROM revenue))"""
