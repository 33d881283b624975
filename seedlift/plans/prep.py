"""Queries on profiling and preparing the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedlift.operators import features as X
from seedlift.operators import prep as P
from seedlift.operators import stats as ST
from seedlift.operators.joins import left_chain
from seedlift.plans import base as B
from seedlift.plans.registry import query, table
from seedlift.runtime import pin

# Features that miss values: rare kinds of sales.
_RARE = f"""{B.ENT}, a AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, sum(l_quantity) AS GWAS_deep FROM lineitem
  WHERE l_discount > 0.095 AND l_returnflag = 'R' GROUP BY 1),
b AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, max(l_extendedprice) AS GnomAD_top, CAST(0 AS DOUBLE) AS nothing FROM lineitem
  WHERE l_tax > 0.075 AND l_linestatus = 'O' GROUP BY 1),
c AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, max(l_quantity) AS scarce FROM lineitem
  WHERE l_quantity = 50 AND l_discount = 0 AND l_tax = 0 GROUP BY 1),
rare AS (SELECT entity_id, label, GWAS_deep, GnomAD_top, nothing, scarce FROM ent LEFT JOIN a USING (entity_id)
  LEFT JOIN b USING (entity_id) LEFT JOIN c USING (entity_id))"""
_RARE_COLUMNS = ["GWAS_deep", "GnomAD_top", "nothing", "scarce"]


def _rare(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("entity_id", F.col("l_partkey").cast("string"))
    deep = line.filter("l_discount > 0.095 AND l_returnflag = 'R'").groupBy("entity_id").agg(
        F.sum("l_quantity").alias("GWAS_deep"))
    top = line.filter("l_tax > 0.075 AND l_linestatus = 'O'").groupBy("entity_id").agg(
        F.max("l_extendedprice").alias("GnomAD_top"), F.lit(0.0).alias("nothing"))
    scarce = line.filter("l_quantity = 50 AND l_discount = 0 AND l_tax = 0").groupBy("entity_id").agg(
        F.max("l_quantity").alias("scarce"))
    return left_chain(B.entities(spark, sf), [deep, top, scarce])


def _profile_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_null, round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 2) "
        f"AS pct_null FROM {t}" for c in columns)


@query("null_profile", f"WITH {_RARE} " + _profile_sql("rare", ["entity_id", "label", *_RARE_COLUMNS]))
def null_profile(spark, sf):
    return P.null_profile(_rare(spark, sf))


@query("impute_zero", f"""WITH {_RARE}
SELECT entity_id, label, coalesce(GWAS_deep, 0) AS GWAS_deep, GnomAD_top, nothing FROM rare""")
def impute_zero(spark, sf):
    kept = P.drop_sparse(_rare(spark, sf).withColumn("scarce", F.when(F.col("scarce") < 0, 1)), 0.99)
    return P.fill_zero(kept)


@query("impute_median", f"""WITH {_RARE}
SELECT entity_id, label, coalesce(GWAS_deep, 0) AS GWAS_deep, coalesce(GnomAD_top, (SELECT median(GnomAD_top) FROM rare))
       AS GnomAD_top, coalesce(nothing, (SELECT median(nothing) FROM rare)) AS nothing FROM rare""")
def impute_median(spark, sf):
    filled = P.fill_zero(pin(_rare(spark, sf).drop("scarce"), "features"))
    return P.require_complete(P.fill_unknown(filled, ["GnomAD_top", "nothing"]))


@query("phred_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_tax <= 1e-8 THEN 80 ELSE abs(-10 * log10(l_tax)) END, 6) AS l_tax
FROM lineitem""")
def phred_columns(spark, sf):
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax")
    return P.phred_columns(line, ["l_tax"]).withColumn("l_tax", F.round("l_tax", 6))


_CORR = B.FEATURES + ["twice", "noisy"]
_CORR_FEATS = B.FEATS + f", wide AS (SELECT *, 2 * qty + 1 AS twice, retail + 5 * size AS noisy, 0 AS empty FROM feats)"


def _pair_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS i, '{b}' AS j, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS r FROM {t}"
        for n, a in enumerate(columns) for b in columns[n + 1:])


def _wide(spark, sf):
    return B.features(spark, sf).withColumn("twice", 2 * F.col("qty") + 1).withColumn(
        "noisy", F.col("retail") + 5 * F.col("size")).withColumn("empty", F.lit(0))


@query("corr_matrix", f"WITH {_CORR_FEATS} " + _pair_sql("wide", _CORR))
def corr_matrix(spark, sf):
    return P.correlations(_wide(spark, sf), _CORR).withColumn("r", F.round("r", 6))


@query("corr_with_nulls", f"WITH {_RARE}, wide AS (SELECT *, 2 * GWAS_deep + GnomAD_top AS mixed FROM rare) " + " UNION ALL ".join(
    f"SELECT '{a}' AS i, '{b}' AS j, round(corr({a}, {b}), 6) AS r FROM wide"
    for a, b in [("GWAS_deep", "GnomAD_top"), ("GWAS_deep", "mixed"), ("GnomAD_top", "mixed")]))
def corr_with_nulls(spark, sf):
    """Each pair over the rows that have both values."""
    wide = _rare(spark, sf).withColumn("mixed", 2 * F.col("GWAS_deep") + F.col("GnomAD_top"))
    return P.correlations(wide, ["GWAS_deep", "GnomAD_top", "mixed"]).withColumn("r", F.round("r", 6))


@query("drop_correlated", f"""WITH {_CORR_FEATS}, pairs AS ({_pair_sql("wide", _CORR)}),
dup AS (SELECT DISTINCT j FROM pairs WHERE abs(r) >= 1 - 1e-6),
high AS (SELECT DISTINCT j FROM pairs WHERE abs(r) > 0.85 AND i NOT IN (SELECT j FROM dup) AND j NOT IN (SELECT j FROM dup)),
ord AS (SELECT unnest({_CORR + ["empty"]}) AS feature)
SELECT feature, CASE WHEN feature IN (SELECT j FROM dup) THEN 'duplicate' WHEN feature = 'empty' THEN 'uninformative'
  WHEN feature IN (SELECT j FROM high) THEN 'correlated' ELSE 'kept' END AS verdict FROM ord""")
def drop_correlated(spark, sf):
    wide = pin(_wide(spark, sf), "features")
    unique = P.drop_duplicate_columns(wide)
    useful = P.drop_uninformative(unique)
    kept = P.drop_correlated(useful)
    verdict = F.when(F.col("feature").isin(*kept.columns), "kept").when(F.col("feature").isin(*useful.columns), "correlated")
    verdict = verdict.when(F.col("feature").isin(*unique.columns), "uninformative").otherwise("duplicate")
    return spark.createDataFrame([(c,) for c in _CORR + ["empty"]], "feature string").withColumn("verdict", verdict)


@query("standardise", f"""WITH {B.SCALED}
SELECT entity_id, label, {", ".join(f"round({c}, 6) AS {c}" for c in B.FEATURES)} FROM scaled""")
def standardise(spark, sf):
    return B.scaled(spark, sf).select("entity_id", "label", *[F.round(c, 6).alias(c) for c in B.FEATURES])


_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("one_hot", "SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_size, " + ", ".join(
    f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS p_type_{t}" for t in _TYPES) + " FROM part")
def one_hot(spark, sf):
    return P.one_hot(table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("entity_id"), "p_size", "p_type"))


@query("stratified_split", f"""WITH {B.ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
  md5(concat('split:', entity_id)), entity_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM ent)
SELECT entity_id, label, CASE WHEN rn <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, sf):
    return P.stratified_split(B.entities(spark, sf), 0.2)


@query("split_with_null_labels", f"""WITH {B.ENT}, e AS (SELECT entity_id, CASE WHEN entity_id LIKE '%7' THEN NULL ELSE label END AS label FROM ent),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('split:', entity_id)), entity_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM e)
SELECT entity_id, coalesce(CAST(label AS VARCHAR), 'none') AS label,
  CASE WHEN rn <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS part FROM r""")
def split_with_null_labels(spark, sf):
    """Rows without a label are a class of their own."""
    ent = B.entities(spark, sf).withColumn("label", F.when(~F.col("entity_id").endswith("7"), F.col("label")))
    return P.stratified_split(ent, 0.2).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("none")))


@query("downsample", f"""WITH {B.ENT}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY
  md5(concat('down:', entity_id)), entity_id) AS rn FROM ent)
SELECT entity_id, label FROM r WHERE label = 1 OR rn <= (SELECT round_even(count(*) * 1.5, 0) FROM ent WHERE label = 1)""")
def downsample(spark, sf):
    return P.downsample(B.entities(spark, sf), 1.5)


_PREP_CORR = ["n_lines", "price", "disc", "size", "thrice", "noisy"]


@query("prepared_features", f"""WITH {B.FEATS}, t AS (SELECT f.*, p_type FROM feats f JOIN part ON CAST(p_partkey AS VARCHAR) = entity_id)
SELECT entity_id, label, """ + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1), 6) AS {c}"
    for c in ["n_lines", "price", "disc", "size"]) + ", " + ", ".join(
    f"CASE WHEN p_type = '{t}' THEN 1 ELSE 0 END AS kind_{t}" for t in _TYPES) + " FROM t")
def prepared_features(spark, sf):
    kinds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), F.col("p_type").alias("kind"))
    extra = B.features(spark, sf).withColumn("thrice", 3 * F.col("n_lines")).withColumn(
        "noisy", F.col("n_lines") + F.col("size") / 20).withColumn("empty", F.lit(0))
    wide = extra.select("entity_id", "label", *_PREP_CORR, "empty").join(kinds, "entity_id")
    out = P.prepare(pin(wide, "features"))[1]
    return out.select(*[F.round(c, 6).alias(c) if c in _PREP_CORR else c for c in out.columns])


@query("class_counts", f"""WITH {B.ENT} SELECT p_type, label, count(*) AS n FROM ent JOIN part
  ON CAST(p_partkey AS VARCHAR) = entity_id GROUP BY ALL""")
def class_counts(spark, sf):
    from seedlift.operators.scores import class_counts as counts

    kinds = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("entity_id"), "p_type")
    return counts(B.entities(spark, sf).join(kinds, "entity_id"), "p_type")


@query("feature_histogram", f"""WITH {B.FEATS}, x AS (SELECT label, ln(1 + qty) AS v FROM feats)
SELECT label, CAST(least(floor((v - 0) / (10.0::DOUBLE / 20)) + 1, 20) AS INT) AS bin, count(*) AS n FROM x
WHERE v BETWEEN 0 AND 10 GROUP BY ALL""")
def feature_histogram(spark, sf):
    from seedlift.operators.scores import histogram

    return histogram(B.features(spark, sf), "qty", 0.0, 10.0, 20, log=True)


def _p_sql(i: str, t: str) -> str:
    return (f"SELECT '{i}' AS feature, round(covar_pop({i}, p) / nullif(stddev_pop({i}) * stddev_pop(p), 0), 6) AS r FROM {t}")


@query("feature_corr_external", f"WITH {B.FEATS}, {B.EXTERNAL}, j AS (SELECT f.*, coalesce(p, 0) AS p FROM feats f LEFT JOIN ext USING (entity_id)) "
       + " UNION ALL ".join(_p_sql(c, "j") for c in B.FEATURES))
def feature_corr_external(spark, sf):
    joined = B.features(spark, sf).join(B.external(spark, sf), "entity_id", "left")
    return ST.feature_correlations(joined, B.FEATURES, "p").select("feature", F.round("r", 6).alias("r"))


# Two-sided tail of r under no correlation: with t = sqrt(df) * tan(u) the tail is an integral of cos(u)^(df - 1), here by Simpson's rule.
_CORR_TAIL = """tails AS (SELECT feature, r, n, list_sum(list_transform(range(0, 20001), lambda k:
  CASE WHEN k = 0 OR k = 20000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END
  * pow(cos(asin(abs(r)) + k * (pi() / 2 - asin(abs(r))) / 20000), n - 3))) * (pi() / 2 - asin(abs(r))) / 60000
  * 2 * exp(lgamma((n - 1) / 2.0::DOUBLE) - lgamma((n - 2) / 2.0::DOUBLE)) / sqrt(pi()) AS p FROM rs)"""


@query("feature_corr_p", f"WITH {B.FEATS}, {B.EXTERNAL}, j AS (SELECT f.*, coalesce(p, 0) AS p FROM feats f LEFT JOIN ext USING (entity_id)), rs AS ("
       + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, p) AS r, count(*) AS n FROM j" for c in B.FEATURES)
       + f"), {_CORR_TAIL} SELECT feature, round(r, 6) AS r, round(p, 6) AS p FROM tails")
def feature_corr_p(spark, sf):
    """The same with the two-sided p."""
    joined = B.features(spark, sf).join(B.external(spark, sf), "entity_id", "left")
    return ST.feature_correlations(joined, B.FEATURES, "p").select("feature", F.round("r", 6).alias("r"), F.round("p", 6).alias("p"))


@query("list_correlation", """
WITH a AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, avg(l_discount) AS x FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, avg(l_discount) AS y FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM a JOIN b USING (entity_id)""")
def list_correlation(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("entity_id", F.col("l_partkey").cast("string"))
    mine = line.filter("l_returnflag = 'R'").groupBy("entity_id").agg(F.avg("l_discount").alias("p"))
    other = line.filter("l_linestatus = 'O'").groupBy("entity_id").agg(F.avg("l_discount").alias("p"))
    return ST.list_correlation(mine, other).withColumn("r", F.round("r", 6))


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_IMPORTANCE = """s AS (
  SELECT c_mktsegment AS segment, o_orderpriority, o_orderstatus, avg(o_totalprice) AS value FROM orders
  JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
names AS (SELECT segment, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low'
  ELSE o_orderpriority END || '_' || o_orderstatus AS feature, value FROM s),
h AS (SELECT feature, segment, max(value) AS value FROM names GROUP BY ALL)"""
_RULES = ((r"^(1-URGENT|2-HIGH)", "high"), (r"^5-LOW", "low"))


def _importance(spark, sf):
    """Mean order value per (priority, status) and segment: stands in for feature importance per study."""
    # Orders are summed per customer before the join, so that no customer's orders meet in one task.
    orders = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority", "o_orderstatus").agg(
        F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    joined = orders.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    means = joined.groupBy(F.concat_ws("_", "o_orderpriority", "o_orderstatus").alias("feature")).agg(*[
        F.try_divide(F.sum(F.when(F.col("c_mktsegment") == m, F.col("s"))),
                     F.sum(F.when(F.col("c_mktsegment") == m, F.col("n")))).alias(m) for m in _SEGMENTS])
    return X.homogenise(means, "feature", _SEGMENTS, _RULES)


@query("homogenise", f"WITH {_IMPORTANCE} SELECT feature, " + ", ".join(
    f"round(max(value) FILTER (segment = '{s}') / 7, 4) AS {s}" for s in _SEGMENTS) + " FROM h GROUP BY 1")
def homogenise(spark, sf):
    return _importance(spark, sf).select("feature", *[F.round(F.col(c) / 7, 4).alias(c) for c in _SEGMENTS])


@query("min_max_sum_top", f"WITH {_IMPORTANCE}, w AS (SELECT feature, " + ", ".join(
    f"max(value) FILTER (segment = '{s}') AS {s}" for s in _SEGMENTS) + " FROM h GROUP BY 1), n AS (SELECT feature, " + ", ".join(
    f"({s} - min({s}) OVER ()) / (max({s}) OVER () - min({s}) OVER ()) AS {s}" for s in _SEGMENTS) + """ FROM w)
SELECT feature, round(""" + " + ".join(_SEGMENTS) + """, 6) AS total FROM n ORDER BY total DESC, feature LIMIT 5""")
def min_max_sum_top(spark, sf):
    scaled = ST.min_max(_importance(spark, sf), _SEGMENTS)
    total = sum((F.col(c) for c in _SEGMENTS[1:]), F.col(_SEGMENTS[0]))
    return scaled.select("feature", F.round(total, 6).alias("total")).orderBy(F.desc("total"), "feature").limit(5)


