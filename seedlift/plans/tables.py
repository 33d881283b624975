"""Queries on choosing, joining, exploding and aggregating annotation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from seedlift.functions.numbers import flag
from seedlift.functions.text import attribute, tag_text
from seedlift.jobs import Source, compile_features, profile_sources
from seedlift.operators import features as X
from seedlift.operators import joins as J
from seedlift.operators import terms as T
from seedlift.operators.order import number_rows
from seedlift.operators.prep import null_profile, zero_columns
from seedlift.plans import base as B
from seedlift.plans.registry import query, table
from seedlift.runtime import pin

def _id(column: str):
    return F.col(column).cast("string").alias("entity_id")


@query("project_recode", """
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, replace(trim(p_name), ' ', '_') AS part_name,
       regexp_replace(p_brand, 'Brand#', '') AS part_brand,
       CASE p_type WHEN 'PROMO' THEN 1.0::DOUBLE WHEN 'ECONOMY' THEN 0 END AS part_promo,
       CAST(round_even(p_size / 2.0, 0) AS INT) AS part_half, CASE WHEN p_brand LIKE '%#1%' THEN 1 ELSE 0 END AS part_marked,
       round(ln(1 + p_retailprice), 6) AS part_log_price, 1 AS part_source,
       CASE WHEN p_size <> 0 THEN 1 ELSE p_size END AS part_any_size,
       lower(concat(p_type, '-', p_brand)) AS part_code, p_size AS part_size
FROM part WHERE p_partkey IS NOT NULL AND p_type IS DISTINCT FROM 'SMALL'""")
def project_recode(spark, sf):
    part = table(spark, sf, "part").dropna(subset=["p_partkey"]).filter(~F.col("p_type").eqNullSafe("SMALL"))
    named = X.by_position(part, [0, 1, 2, 3, 4, 5], ["entity_id", "name", "brand", "type", "size", "price"])
    out = named.select(
        F.col("entity_id").cast("string").alias("entity_id"), "size",
        F.replace(F.trim("name"), F.lit(" "), F.lit("_")).alias("name"),
        F.regexp_replace("brand", "Brand#", "").alias("brand"),
        X.recode("type", {"PROMO": 1.0, "ECONOMY": 0.0}).alias("promo"),
        F.bround(F.col("size") / F.lit(2.0)).cast("int").alias("half"),
        flag(F.col("brand").rlike(r"\#1")).alias("marked"), F.round(F.log1p("price"), 6).alias("log_price"),
        F.lit(1).alias("source"), F.when(F.col("size") != 0, 1).otherwise(F.col("size")).alias("any_size"),
        F.lower(F.concat_ws("-", "type", "brand")).alias("code"))
    return X.column_last(X.prefix_columns(out, "part_"), "part_size")


@query("semi_anti", """
WITH sold AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount < 0.005 AND l_returnflag = 'R'),
listed AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM (
  SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1)),
hit AS (SELECT DISTINCT p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part)
        WHERE word IN (SELECT word FROM listed))
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CASE WHEN s.l_partkey IS NULL THEN 'unsold' ELSE 'sold' END AS kind,
       CASE WHEN h.p_partkey IS NULL THEN 0 ELSE 1 END AS shares_word
FROM part LEFT JOIN sold s ON p_partkey = s.l_partkey LEFT JOIN hit h USING (p_partkey)""")
def semi_anti(spark, sf):
    part = table(spark, sf, "part")
    universe = part.select(_id("p_partkey"))
    sold = T.seeds_from_list(table(spark, sf, "lineitem").filter(
        (F.col("l_discount") < 0.005) & (F.col("l_returnflag") == "R")).select(_id("l_partkey")))
    both = J.keep_listed(universe, sold).withColumn("kind", F.lit("sold")).unionByName(
        J.drop_listed(universe, sold).withColumn("kind", F.lit("unsold")))
    dearest = part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(1)
    words = dearest.select(F.explode(F.split("p_name", " ")).alias("word"))
    hit = X.any_listed(part.withColumn("id", F.col("p_partkey").cast("string")), "p_name", words, "word", "id",
                       name="shares_word")
    return both.join(hit, "entity_id", "left").fillna(0, subset=["shares_word"])


@query("join_variants", f"""WITH {B.ENT},
a AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, count(*) AS returned FROM lineitem
      WHERE l_returnflag = 'R' AND l_discount < 0.01 GROUP BY 1),
b AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, count(*) AS open FROM lineitem
      WHERE l_linestatus = 'O' AND l_tax < 0.01 GROUP BY 1),
c AS (SELECT entity_id, coalesce(returned, 0) AS returned, coalesce(open, 0) AS open FROM a FULL JOIN b USING (entity_id))
SELECT e.entity_id, CAST(returned AS DOUBLE) AS returned, CAST(open AS DOUBLE) AS open, label, coalesce(returned, 0) + coalesce(open, 0) AS total,
       CASE WHEN a2.entity_id IS NULL THEN 0 ELSE 1 END AS in_both
FROM ent e LEFT JOIN c USING (entity_id)
LEFT JOIN (SELECT entity_id FROM a JOIN b USING (entity_id)) a2 ON a2.entity_id = e.entity_id""")
def join_variants(spark, sf):
    line = table(spark, sf, "lineitem").select(_id("l_partkey"), "l_returnflag", "l_linestatus", "l_discount", "l_tax")
    returned = line.filter("l_returnflag = 'R' AND l_discount < 0.01").groupBy("entity_id").agg(
        F.count("*").alias("returned"))
    opened = line.filter("l_linestatus = 'O' AND l_tax < 0.01").groupBy("entity_id").agg(F.count("*").alias("open"))
    counters = J.merge_tables([returned, opened], fill=0)
    labelled = counters.join(B.entities(spark, sf), "entity_id", "full")
    both = returned.join(opened, "entity_id", "inner")
    return J.label_known(labelled, both, name="in_both").withColumn(
        "total", F.coalesce("returned", F.lit(0)) + F.coalesce("open", F.lit(0))).withColumn(
        "returned", F.col("returned").cast("double")).withColumn("open", F.col("open").cast("double"))


@query("report_merge", """
WITH c AS (SELECT c_nationkey, count(*) AS customers, round(sum(c_acctbal), 2) AS owed FROM customer
           WHERE c_acctbal < 0 GROUP BY 1),
s AS (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT CAST(c_nationkey AS DOUBLE) AS c_nationkey, CAST(customers AS DOUBLE) AS customers, owed,
       CAST(s_nationkey AS DOUBLE) AS s_nationkey, CAST(suppliers AS DOUBLE) AS suppliers FROM c FULL JOIN s ON c_nationkey = s_nationkey""")
def report_merge(spark, sf):
    left = table(spark, sf, "customer").filter("c_acctbal < 0").groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("owed"))
    right = table(spark, sf, "supplier").filter("s_acctbal > 5000").groupBy("s_nationkey").agg(
        F.count("*").alias("suppliers"))
    return J.merge_reports(left, right, "c_nationkey", "s_nationkey").select(
        "owed", *[F.col(c).cast("double").alias(c) for c in ("c_nationkey", "customers", "s_nationkey", "suppliers")])


@query("id_mapping", """
WITH mapping AS (
  SELECT p_name, min(p_brand) AS code FROM part WHERE p_size > 48 GROUP BY 1
  UNION SELECT DISTINCT p_name, 'manual' AS code FROM part WHERE p_name LIKE 'old %' AND p_name NOT IN (
    SELECT p_name FROM part WHERE p_size > 48))
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, p_name, coalesce(code, 'unmapped') AS code
FROM part LEFT JOIN mapping USING (p_name)""")
def id_mapping(spark, sf):
    part = table(spark, sf, "part")
    mapping = part.filter("p_size > 48").groupBy("p_name").agg(F.min("p_brand").alias("code"))
    extra = J.drop_listed(part.filter(F.col("p_name").startswith("old ")), mapping, "p_name")
    supplement = extra.select("p_name").distinct().withColumn("code", F.lit("manual"))
    rows = part.select(_id("p_partkey"), "p_name")
    mapped, unmapped = J.map_ids(rows, mapping, supplement, "p_name")
    rest = J.keep_listed(rows, unmapped, "p_name").withColumn("code", F.lit("unmapped"))
    return mapped.select("entity_id", "p_name", "code").unionByName(rest)


@query("column_selection", """
WITH wide AS (
  SELECT user_id, CAST(sum(value) FILTER (event_type = 'click' AND value > 150) AS DOUBLE) AS act_click,
         sum(value) FILTER (event_type = 'error' AND value > 150) AS act_error,
         sum(value) FILTER (event_type = 'purchase' AND value > 150) AS act_purchase,
         sum(value) FILTER (event_type = 'signup' AND value > 150) AS act_signup,
         sum(value) FILTER (event_type = 'view' AND value > 150) AS act_view,
         coalesce(max(value) FILTER (value < 0), 0) AS refund FROM events GROUP BY 1),
long AS (SELECT 'act-collapsed_features' AS feature, unnest([count(*) - count(act_click), count(*) - count(act_error),
  count(*) - count(act_purchase), count(*) - count(act_signup), count(*) - count(act_view)]) AS n_null, 0 AS is_zero,
  0 AS chosen FROM wide
  UNION ALL SELECT 'act_' || event_type, 0, 0, 1 FROM (SELECT DISTINCT event_type FROM events)
  WHERE regexp_matches('act_' || event_type, '(?i)(click|r)') AND NOT regexp_matches('act_' || event_type, '(?i)(user|purchase|error)')
  UNION ALL SELECT 'refund', count(*) - count(refund), CASE WHEN max(CASE WHEN refund <> 0 THEN 1 ELSE 0 END) = 0
  THEN 1 ELSE 0 END, 0 FROM wide)
SELECT feature, max(n_null) AS n_null, max(is_zero) AS is_zero, max(chosen) AS chosen FROM long GROUP BY 1""")
def column_selection(spark, sf):
    events = table(spark, sf, "events")
    kinds = X.category_values(events, "event_type")
    wide = events.groupBy("user_id").agg(
        *[F.sum(F.when((F.col("event_type") == k) & (F.col("value") > 150), F.col("value"))).alias(f"act_{k}")
          for k in kinds],
        F.coalesce(F.max(F.when(F.col("value") < 0, F.col("value"))), F.lit(0.0)).alias("refund"))
    chosen = T.term_columns(T.common_columns(wide, wide.drop("refund")), ["CLICK", "r"], ["user", "purchase", "error"])
    zero = set(zero_columns(wide, ["refund"]))
    profile = null_profile(wide, [c for c in wide.columns if c != "user_id"])
    profile = profile.withColumn("is_zero", flag(F.col("feature").isin(*zero, ""))).withColumn("chosen", F.lit(0))
    collapsed = X.collapse_prefixes(profile, "feature", ["n_null", "is_zero", "chosen"], ["act_"])
    picked = spark.createDataFrame([(c, 0, 0, 1) for c in chosen], collapsed.select("feature", "n_null", "is_zero", "chosen").schema)
    return collapsed.unionByName(picked)


@query("addon_tables", """
WITH size AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, CAST(p_size AS DOUBLE) AS size FROM part WHERE p_size > 10),
dear AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id, 1 AS priority FROM part WHERE p_retailprice > 1000),
hits AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, CAST(count(*) AS DOUBLE) AS full_price FROM lineitem
         WHERE l_discount = 0 GROUP BY 1),
lethal AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS entity_id, 1 AS returned FROM lineitem
           WHERE l_returnflag = 'R' AND l_quantity > 48)
SELECT entity_id, coalesce(size, 0) AS size, coalesce(priority, 0) AS priority, coalesce(full_price, 0) AS full_price,
       coalesce(returned, 0) AS returned
FROM (SELECT CAST(p_partkey AS VARCHAR) AS entity_id FROM part) FULL JOIN size USING (entity_id)
FULL JOIN dear USING (entity_id) FULL JOIN hits USING (entity_id) FULL JOIN lethal USING (entity_id)""")
def addon_tables(spark, sf):
    part, line = table(spark, sf, "part"), table(spark, sf, "lineitem")
    universe = part.select(_id("p_partkey"))
    size = part.filter("p_size > 10").select(_id("p_partkey"), F.col("p_size").cast("double").alias("size"))
    answers = part.select(_id("p_partkey"), F.when(F.col("p_retailprice") > 1000, "Yes").otherwise("No").alias("a"))
    dear = answers.filter("a = 'Yes'").select("entity_id", X.recode("a", {"Yes": 1, "No": 0}).alias("priority"))
    hits = line.filter("l_discount = 0").groupBy(_id("l_partkey")).agg(F.count("*").cast("double").alias("full_price"))
    returned = line.filter("l_returnflag = 'R' AND l_quantity > 48").select(_id("l_partkey")).distinct().withColumn(
        "returned", F.lit(1))
    add_on = X.add_on_for("Retail parts", {"hospital": [], "retail|shop": [size, dear, hits, returned]})
    return J.merge_onto_universe(add_on, universe)


@query("named_annotations", """
SELECT c_custkey, c_nationkey AS n_nationkey, lower(n_name) AS n_name FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey""")
def named_annotations(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return X.named_annotations(customers, table(spark, sf, "nation"), "n_nationkey", "n_name")


@query("phrase_expand", """
SELECT DISTINCT phrase FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS phrase FROM part)
WHERE regexp_matches(phrase, '(?i)(widget|g|bolt)')""")
def phrase_expand(spark, sf):
    return T.matched_phrases(table(spark, sf, "part"), "p_name", ["widget", "G", "bolt"], " ")


@query("term_seeds", """
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, 1 AS label, 'seed' AS kind FROM part
WHERE regexp_matches(p_name, '(?i)(widget)') AND NOT regexp_matches(p_name, '(?i)(small)')
UNION ALL SELECT DISTINCT p_name, 1, 'phrase' FROM part
WHERE regexp_matches(p_name, '(?i)(widget)') AND NOT regexp_matches(p_name, '(?i)(small)')""")
def term_seeds(spark, sf):
    found, phrases = T.seeds_from_terms(table(spark, sf, "part"), "p_partkey", "p_name", ["Widget"], ["SMALL"])
    return found.withColumn("kind", F.lit("seed")).unionByName(
        phrases.select(F.col("p_name").alias("entity_id"), F.lit(1).alias("label"), F.lit("phrase").alias("kind")))


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


@query("term_documents", f"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS token FROM documents)
WHERE token <> '' AND token NOT IN ({_STOP}) AND NOT regexp_matches(token, '^[0-9]+$')
GROUP BY 1 HAVING count(*) > 1""")
def term_documents(spark, sf):
    return T.term_counts(table(spark, sf, "documents"), "text")


@query("source_profiles", """
SELECT 'part type' AS source, p_type AS value, count(*) AS n_rows,
       CASE WHEN regexp_matches(p_type, '(?i)(o)') AND NOT regexp_matches(p_type, '(?i)(promo)') THEN 1 ELSE 0 END AS selected
FROM part GROUP BY 2
UNION ALL SELECT 'event', event_type, count(*),
       CASE WHEN regexp_matches(event_type, '(?i)(o)') AND NOT regexp_matches(event_type, '(?i)(promo)') THEN 1 ELSE 0 END
FROM events GROUP BY 2
UNION ALL SELECT 'document source', source, count(*),
       CASE WHEN regexp_matches(source, '(?i)(o)') AND NOT regexp_matches(source, '(?i)(promo)') THEN 1 ELSE 0 END
FROM documents GROUP BY 2""")
def source_profiles(spark, sf):
    return profile_sources({
        source: Source(table(spark, sf, name), column, ["o"], ["promo"])
        for source, name, column in (("part type", "part", "p_type"), ("event", "events", "event_type"),
                                     ("document source", "documents", "source"))})


@query("explode_delimited", """
WITH pieces AS (SELECT unnest(string_split(p_name, ' ')) AS piece, 'split' AS mode FROM part
  UNION ALL SELECT unnest(list_append(string_split(p_name, ' '), p_name)), 'keep' FROM part WHERE p_name LIKE '% %'
  UNION ALL SELECT p_name, 'keep' FROM part WHERE p_name NOT LIKE '% %')
SELECT mode, piece, count(*) AS n FROM pieces GROUP BY ALL""")
def explode_delimited(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("piece"))
    split = X.value_counts(X.explode_delimited(names, "piece", " "), "piece").withColumn("mode", F.lit("split"))
    kept = X.value_counts(X.explode_delimited(names, "piece", " ", keep=True), "piece").withColumn("mode", F.lit("keep"))
    return split.unionByName(kept)


@query("key_value_extract", """
SELECT event_id, event_type AS kind, CAST(nullif(regexp_extract(props, '"k": *(-?[0-9.]+)', 1), '') AS BIGINT) AS k FROM events""")
def key_value_extract(spark, sf):
    """Attributes out of a column of `key "value"` pairs, as annotation files have them; a key that is absent is null."""
    props = F.regexp_replace(F.translate("props", "{}", ""), r'"(\w+)": *([^,]+)', '$1 "$2";')
    pairs = F.concat(F.lit('type "'), F.col("event_type"), F.lit('"; '), props)
    return table(spark, sf, "events").select("event_id", attribute(pairs, "type").alias("kind"), attribute(pairs, "k").cast("bigint").alias("k"))


_HITS = """uni AS (SELECT CAST(p_partkey AS VARCHAR) AS entity_id FROM part),
hits AS (SELECT CAST(l_partkey AS VARCHAR) AS entity_id, count(l_discount) AS hits, max(l_discount) AS max_P,
  min(l_discount) AS min_P, max(l_quantity) AS max_E, min(l_quantity) AS min_E
  FROM lineitem WHERE l_discount < {cut} GROUP BY 1)"""


def _hits(spark, sf, cut):
    line = table(spark, sf, "lineitem").withColumn("names", F.col("l_partkey").cast("string"))
    universe = table(spark, sf, "part").select(_id("p_partkey"))
    return X.association_hits(line, "names", "l_discount", "l_quantity", universe, threshold=cut, prefix="line")


@query("hits_per_entity", f"""WITH {_HITS.format(cut=0.03)}
SELECT entity_id, coalesce(hits, 0) AS line_hits, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS line_flag
FROM uni LEFT JOIN hits USING (entity_id)""")
def hits_per_entity(spark, sf):
    return _hits(spark, sf, 0.03).select("entity_id", "line_hits", "line_flag")


@query("minmax_impute", f"""WITH {_HITS.format(cut=0.005)}
SELECT entity_id, coalesce(max_P, (SELECT median(max_P) FROM hits)) AS line_max_P,
       coalesce(min_P, (SELECT median(min_P) FROM hits)) AS line_min_P,
       coalesce(max_E, (SELECT median(max_E) FROM hits)) AS line_max_E,
       coalesce(min_E, (SELECT median(min_E) FROM hits)) AS line_min_E
FROM uni LEFT JOIN hits USING (entity_id)""")
def minmax_impute(spark, sf):
    return _hits(spark, sf, 0.005).drop("line_hits", "line_flag")


@query("mean_flag", """
SELECT CAST(l_partkey AS VARCHAR) AS entity_id, round(avg(l_quantity), 6) AS line_l_quantity,
       round(avg(l_linenumber), 6) AS line_l_linenumber,
       CASE WHEN avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) >= 0.5 THEN 1 ELSE 0 END AS line_back
FROM lineitem GROUP BY 1""")
def mean_flag(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("back", flag(F.col("l_returnflag") == "R"))
    out = X.means_with_flag(line, "l_partkey", ["l_quantity", "l_linenumber"], "back", prefix="line_")
    return out.select(F.col("entity_id").cast("string").alias("entity_id"), F.round("line_l_quantity", 6).alias("line_l_quantity"),
                      F.round("line_l_linenumber", 6).alias("line_l_linenumber"), "line_back")


@query("best_row_dedup", """
SELECT CAST(l_partkey AS VARCHAR) AS entity_id, l_orderkey AS best_l_orderkey, l_linenumber AS best_l_linenumber,
       l_quantity AS best_l_quantity, l_extendedprice AS best_l_extendedprice
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity + l_extendedprice DESC, l_orderkey,
      l_linenumber) AS rn FROM lineitem WHERE l_linestatus = 'F') WHERE rn = 1""")
def best_row_dedup(spark, sf):
    line = table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("part"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_linestatus")
    return X.constraint_features(line, "part", F.col("l_linestatus") == "F", F.col("l_quantity") + F.col("l_extendedprice"),
                                 ["l_orderkey", "l_linenumber"], drop=["l_linestatus"], prefix="best_")


_CODES = {"1-URGENT": 8, "2-HIGH": 3, "3-MEDIUM": 1, "5-LOW": 0}


@query("ordinal_max", """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 3
       WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 0 END) WHEN 8 THEN 'High' WHEN 3 THEN 'Medium' WHEN 1 THEN 'Low'
       WHEN 0 THEN 'Not_detected' END AS level
FROM orders GROUP BY 1""")
def ordinal_max(spark, sf):
    orders = table(spark, sf, "orders").withColumn("c", F.col("o_custkey").cast("string"))
    return X.ordinal_max(orders, "c", "o_orderpriority", _CODES)


@query("level_flags", """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, """ + ", ".join(
    f"coalesce(max(CASE WHEN o_orderstatus = '{s}' THEN CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 "
    f"WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN 0 END END), 0) AS status_{s}_flag" for s in "FOP") + """
FROM orders GROUP BY 1""")
def level_flags(spark, sf):
    orders = table(spark, sf, "orders").withColumn("c", F.col("o_custkey").cast("string"))
    codes = {"1-URGENT": 1, "2-HIGH": 1, "3-MEDIUM": 0, "5-LOW": 0}
    return X.collapse_tissue_levels(orders, "c", "o_orderstatus", "o_orderpriority",
                                    X.category_values(orders, "o_orderstatus"), codes, "status_", "_flag")


@query("tissue_features", """
WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CASE max(CASE o_orderpriority WHEN '1-URGENT' THEN 8
  WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 1 WHEN '5-LOW' THEN 0 END) WHEN 8 THEN 'High' WHEN 3 THEN 'Medium'
  WHEN 1 THEN 'Low' WHEN 0 THEN 'Not_detected' END AS level
  FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1),
r AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, round(sum(value), 2) AS rna_expression FROM events
  WHERE event_type IN ('click', 'view') GROUP BY 1)
SELECT entity_id, level, rna_expression FROM l FULL JOIN r USING (entity_id)""")
def tissue_features(spark, sf):
    names = {"1-URGENT": "High", "2-HIGH": "Medium", "3-MEDIUM": "Low", "5-LOW": "Not detected"}
    levels = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.concat_ws(" ", F.lit("status"), "o_orderstatus").alias("Tissue"),
        X.recode("o_orderpriority", names).alias("Level"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Uncertain").alias("Reliability"))
    rna = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("id"), F.concat_ws(" ", F.lit("status"), "event_type").alias("Sample"),
        F.col("value").alias("Value"))
    out = X.tissue_features(levels, rna, "id", ["status o", "status p", "click", "view"], ["purchase"])
    return out.withColumn("rna_expression", F.round("rna_expression", 2))


@query("pivot_levels", """
SELECT CAST(l_partkey AS VARCHAR) AS entity_id, """ + ", ".join(
    f"coalesce(max(l_quantity) FILTER (l_returnflag = '{v}'), 0) AS flag_{v}" for v in "ANR") + """
FROM lineitem WHERE l_tax > 0.07 GROUP BY 1""")
def pivot_levels(spark, sf):
    line = table(spark, sf, "lineitem").filter("l_tax > 0.07").withColumn("id", F.col("l_partkey").cast("string"))
    return X.pivot_levels(line, "id", "l_returnflag", F.col("l_quantity"), ["A", "N", "R"], prefix="flag_")


@query("set_membership_pivot", """
WITH sets AS (SELECT p_brand AS set_name, p_partkey FROM part),
big AS (SELECT set_name FROM sets GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 80),
f AS (SELECT p_partkey, max(CASE WHEN regexp_matches(set_name, '(?i)(brand#1)') THEN 1 ELSE 0 END) AS a,
  max(CASE WHEN regexp_matches(set_name, '(?i)(#2)') THEN 1 ELSE 0 END) AS b
  FROM sets WHERE set_name IN (SELECT set_name FROM big) GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS entity_id, coalesce(a, 0) AS "GO_brand#1", coalesce(b, 0) AS "GO_#2"
FROM part LEFT JOIN f USING (p_partkey)""")
def set_membership_pivot(spark, sf):
    part = table(spark, sf, "part")
    sets = part.select(F.col("p_brand").alias("set_name"), _id("p_partkey"))
    flags = X.set_flags(X.large_sets(sets, 80), ["brand#1", "#2"])
    return J.reindex(flags, part.select(_id("p_partkey")))


@query("all_set_flags", """
SELECT DISTINCT CAST(doc_id AS VARCHAR) AS entity_id, 'lang_' || lang AS feature, 1 AS value
FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5)""")
def all_set_flags(spark, sf):
    sets = table(spark, sf, "documents").select(F.col("lang").alias("set_name"), _id("doc_id"))
    return X.all_set_flags(sets, 5, prefix="lang_")


@query("phenotype_flag", """
SELECT DISTINCT CAST(user_id AS VARCHAR) AS entity_id, 1 AS bought FROM events WHERE event_type = 'purchase'""")
def phenotype_flag(spark, sf):
    return X.phenotype_flag(table(spark, sf, "events"), "user_id", "event_type", ["PURCH", "sign"], ["signup"], "bought")


@query("expression_rank", """
WITH t AS (SELECT CAST(user_id AS VARCHAR) AS entity_id, coalesce(sum(value) FILTER (event_type = 'click'), 0) AS c,
  coalesce(sum(value) FILTER (event_type IN ('error', 'view')), 0) AS e FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY c DESC, entity_id) AS rc, row_number() OVER (ORDER BY e DESC, entity_id) AS re,
  count(*) OVER () AS n, floor((SELECT median(c) FROM t)) AS mc, floor((SELECT median(e) FROM t)) AS me FROM t)
SELECT entity_id, round(c, 4) AS GTEx_click_TPM_expression, CASE WHEN c < mc THEN n ELSE rc END AS GTEx_click_Expression_Rank,
       round(e, 4) AS GTEx_rest_TPM_expression, CASE WHEN e < me THEN n ELSE re END AS GTEx_rest_Expression_Rank,
       CASE WHEN c < mc THEN 0 ELSE rc END AS click_rank_or_0 FROM r""")
def expression_rank(spark, sf):
    events = table(spark, sf, "events")
    matrix = events.select(F.col("user_id").cast("string").alias("user"), *[
        F.when(F.col("event_type") == kind, F.col("value")).alias(name)
        for kind, name in (("click", "click"), ("error", "rest error"), ("view", "rest view"))])
    users = events.select(F.col("user_id").cast("string").alias("entity_id")).distinct()
    out = X.expression_features(matrix, "user", users, ["click", "rest"], ["nothing"])
    zero = X.floor_ranks(out.select("entity_id", F.col("GTEx_click_TPM_expression").alias("t")), "t", "click_rank_or_0",
                         floor="zero").drop("t")
    out = out.join(zero, "entity_id")
    for c in ("GTEx_click_TPM_expression", "GTEx_rest_TPM_expression"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("expression_by_column", """
SELECT CAST(user_id AS VARCHAR) AS entity_id, round(sum(value) FILTER (event_type = 'click'), 4) AS GTEx_click_all_TPM_expression,
       round(sum(value) FILTER (event_type = 'view'), 4) AS GTEx_view_x_TPM_expression
FROM events GROUP BY 1""")
def expression_by_column(spark, sf):
    matrix = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user"), F.when(F.col("event_type") == "click", F.col("value")).alias("click (all)"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("view - x"))
    out = X.expression_by_column(matrix, "user")
    return out.select("entity_id", *[F.round(c, 4).alias(c) for c in out.columns if c != "entity_id"])


_EDGES = """e AS (SELECT concat('P', l_partkey) AS l, concat('S', l_suppkey) AS r, l_linestatus AS source FROM lineitem),
both_ways AS (SELECT l AS entity_id, r AS neighbour, source FROM e UNION ALL SELECT r, l, source FROM e),
marks AS (SELECT concat('P', p_partkey) AS neighbour FROM part WHERE regexp_matches(p_name, '(?i)(widget)')
  AND NOT regexp_matches(p_name, '(?i)(small)')
  UNION SELECT concat('S', s_suppkey) FROM supplier WHERE s_acctbal < 0)"""


def _edges(spark, sf):
    edges = table(spark, sf, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("left"), F.concat(F.lit("S"), F.col("l_suppkey")).alias("right"),
        F.col("l_linestatus").alias("source"))
    return X.both_ways(edges, keep=["source"])


@query("neighbour_overlap", f"""WITH {_EDGES}
SELECT entity_id, round(count(DISTINCT CASE WHEN source = 'F' AND m.neighbour IS NOT NULL THEN b.neighbour END)
         / nullif(count(*) FILTER (source = 'F'), 0), 6) AS F_seed_share,
       round(count(DISTINCT CASE WHEN source = 'O' AND m.neighbour IS NOT NULL THEN b.neighbour END)
         / nullif(count(*) FILTER (source = 'O'), 0), 6) AS O_seed_share
FROM both_ways b LEFT JOIN marks m ON b.neighbour = m.neighbour GROUP BY 1""")
def neighbour_overlap(spark, sf):
    parts = B.seeds(spark, sf).select(F.concat(F.lit("P"), F.col("entity_id")).alias("entity_id"))
    suppliers = table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("entity_id"))
    out = X.neighbour_features(_edges(spark, sf), parts.unionByName(suppliers), ["F", "O"])
    return out.select("entity_id", *[F.round(c, 6).alias(c) for c in ("F_seed_share", "O_seed_share")])


@query("neighbour_lists", f"""WITH {_EDGES}
SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY neighbour) AS pos, neighbour, count(*) AS n
FROM both_ways GROUP BY entity_id, neighbour""")
def neighbour_lists(spark, sf):
    return X.neighbour_lists(_edges(spark, sf))


@query("id_list_lookup", """
WITH w AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) AS token FROM documents),
common AS (SELECT token, concat(token, ':', count(*)) AS name FROM w WHERE token <> '' GROUP BY 1
           HAVING count(*) > 500),
l AS (SELECT doc_id, string_agg(name, '|' ORDER BY token) AS names FROM (SELECT DISTINCT doc_id, token FROM w)
      JOIN common USING (token) GROUP BY 1)
SELECT doc_id, names FROM documents LEFT JOIN l USING (doc_id)""")
def id_list_lookup(spark, sf):
    docs = table(spark, sf, "documents")
    common = pin(T.term_counts(docs, "text", (), 500, digits=True).select(
        "token", F.concat_ws(":", "token", "n").alias("name")), "lookup")
    rows = docs.select("doc_id", F.lower(F.regexp_replace("text", r"\s+", " ")).alias("ids"))
    return J.lookup_list(rows, "doc_id", "ids", common, "token", "name").drop("ids")


_TAGS = {"the ": "T", "and ": "A", "http": "url", "@": "mail", "1": "one"}


@query("annotation_tags", """
WITH t AS (SELECT doc_id, concat_ws(';', """ + ", ".join(
    f"CASE WHEN contains(text, '{k}') THEN '{v}' END" for k, v in _TAGS.items()) + """) AS tags FROM documents)
SELECT doc_id, CASE WHEN tags = '' THEN 'other' ELSE tags END AS tags,
       CASE WHEN contains(tags, 'T') AND NOT contains(tags, 'A') THEN 1 ELSE 0 END AS only_t,
       CASE WHEN contains(tags, 'A') AND NOT contains(tags, 'T') THEN 1 ELSE 0 END AS only_a FROM t""")
def annotation_tags(spark, sf):
    tagged = table(spark, sf, "documents").select("doc_id", tag_text("text", _TAGS).alias("tags"))
    has_t, has_a = F.col("tags").contains("T"), F.col("tags").contains("A")
    return tagged.withColumn("only_t", flag(has_t & ~has_a)).withColumn("only_a", flag(has_a & ~has_t))


@query("collapse_by_id", """
WITH r AS (SELECT p_brand, p_type, p_size, CASE WHEN p_size < 5 THEN '{' WHEN p_size > 45 THEN '?' ELSE '' END || p_name AS phrase
  FROM part),
a AS (SELECT *, CASE WHEN tags = '' THEN 'other' ELSE tags END AS tag, CASE WHEN phrase[1] IN ('{', '?') THEN 1 ELSE 0 END AS bottom
  FROM (SELECT *, concat_ws(';', CASE WHEN contains(phrase, 'old') THEN 'OLD' END, CASE WHEN contains(phrase, '{') THEN 'misc' END)
  AS tags FROM r))
SELECT p_brand, 'phrase' AS field, row_number() OVER (PARTITION BY p_brand ORDER BY bottom, phrase, tag) AS pos,
       phrase AS value, tag, count(*) AS n FROM a GROUP BY p_brand, bottom, phrase, tag
UNION ALL SELECT p_brand, 'p_type', row_number() OVER (PARTITION BY p_brand ORDER BY p_type), p_type, NULL, count(*)
FROM part GROUP BY p_brand, p_type""")
def collapse_by_id(spark, sf):
    start = F.when(F.col("p_size") < 5, "{").when(F.col("p_size") > 45, "?").otherwise("")
    rows = table(spark, sf, "part").withColumn("phrase", F.concat(start, F.col("p_name")))
    rows = rows.withColumn("tag", tag_text("phrase", {"old": "OLD", "{": "misc"}))
    return X.collapse_by_id(rows, "p_brand", "phrase", "tag", ["p_type"])


@query("annotated_map", """
WITH t AS (SELECT o_custkey, o_orderstatus, trim(unnest(string_split(concat(o_orderpriority, '; {', o_orderstatus, ' (3)'), ';')))
  AS phrases FROM orders),
k AS (SELECT *, CASE WHEN contains(phrases, '{O') THEN 'open;misc' ELSE 'misc' END AS annotation FROM t
  WHERE contains(phrases, '(3)'))
SELECT o_custkey, string_agg(phrases, '|' ORDER BY phrases, annotation) AS phrases,
       string_agg(annotation, '|' ORDER BY phrases, annotation) AS annotation,
       string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS o_orderstatus FROM k GROUP BY 1""")
def annotated_map(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", F.concat(
        F.col("o_orderpriority"), F.lit("; {"), F.col("o_orderstatus"), F.lit(" (3)")).alias("phrases"))
    rows = X.annotated_map(orders, "o_custkey", "phrases", ["o_orderstatus"], {"{O": "open", "{": "misc"})
    return X.joined_texts(rows, "o_custkey", "phrases", "annotation", ["o_orderstatus"])


@query("bottom_sorted", """
SELECT p_partkey, row_number() OVER (ORDER BY CASE s WHEN '?' THEN 1 WHEN '[' THEN 2 WHEN '{' THEN 3 ELSE 0 END, p_name, p_partkey)
  AS position FROM (SELECT *, CASE WHEN p_size < 5 THEN '{' WHEN p_size > 45 THEN '?' WHEN p_size = 20 THEN '[' ELSE '' END AS s
  FROM part)""")
def bottom_sorted(spark, sf):
    start = F.when(F.col("p_size") < 5, "{").when(F.col("p_size") > 45, "?").when(F.col("p_size") == 20, "[").otherwise("")
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.concat(start, F.col("p_name")).alias("phrase"))
    return number_rows(rows, [X.bottom_group("phrase"), F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "position")


_MEANS = ["price", "disc", "tax", "returned"]


@query("assemble_features", f"""WITH {B.FEATS}
SELECT entity_id, label, n_lines, qty, size, retail,
       {", ".join(f"round({c} * n_lines, 2) AS {c}" for c in _MEANS)} FROM feats""")
def assemble_features(spark, sf):
    # Means are shown times their count: a rounded mean could fall on either side of a tie.
    return B.features(spark, sf).select("entity_id", "label", "n_lines", "qty", "size", "retail", *[
        F.round(F.col(c) * F.col("n_lines"), 2).alias(c) for c in _MEANS])


@query("hidden_seeds", f"""WITH {B.ENT}, r AS (SELECT entity_id, row_number() OVER (ORDER BY md5(concat('hide:', entity_id)),
  entity_id) AS rn, count(*) OVER () AS n FROM ent WHERE label = 1)
SELECT entity_id, CASE WHEN rn <= floor(n * 0.2) THEN 'hidden' ELSE 'kept' END AS kind FROM r""")
def hidden_seeds(spark, sf):
    kept, hidden = T.hide_seeds(B.seeds(spark, sf), 0.2)
    return kept.select("entity_id", F.lit("kept").alias("kind")).unionByName(
        hidden.select("entity_id", F.lit("hidden").alias("kind")))


@query("random_seeds", f"""WITH {B.ENT}, r AS (SELECT entity_id, row_number() OVER (ORDER BY md5(concat('random:', entity_id)),
  entity_id) AS rn FROM ent)
SELECT entity_id, CASE WHEN rn <= (SELECT count(*) FROM ent WHERE label = 1) THEN 1 ELSE 0 END AS label FROM r""")
def random_seeds(spark, sf):
    return T.random_seeds(B.entities(spark, sf))


def _median_sql(name: str) -> str:
    return f"coalesce({name}, (SELECT median({name}) FROM joined))"


@query("feature_job", f"""WITH {B.ENT}, {_HITS.format(cut=0.005)},
totals AS (SELECT e.entity_id, coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS back,
  coalesce(sum(l_quantity) FILTER (l_returnflag <> 'R'), 0) AS kept FROM ent e LEFT JOIN lineitem ON CAST(l_partkey AS VARCHAR) = e.entity_id GROUP BY 1),
expr AS (SELECT entity_id, back, kept, CASE WHEN back < floor((SELECT median(back) FROM totals)) THEN count(*) OVER () ELSE
  row_number() OVER (ORDER BY back DESC, entity_id) END AS back_rank, CASE WHEN kept < floor((SELECT median(kept) FROM totals)) THEN count(*) OVER ()
  ELSE row_number() OVER (ORDER BY kept DESC, entity_id) END AS kept_rank FROM totals),
knocked AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS entity_id, 1 AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45),
joined AS (SELECT e.entity_id, e.label, p_type, back, kept, back_rank, kept_rank, hits, max_P, min_P, max_E, min_E, k,
  CASE WHEN p_size % 3 > 0 THEN p_retailprice END AS price FROM ent e JOIN part ON CAST(p_partkey AS VARCHAR) = e.entity_id
  JOIN expr USING (entity_id) LEFT JOIN hits USING (entity_id) LEFT JOIN knocked USING (entity_id))
SELECT entity_id, label, round(back, 4) AS GTEx_back_TPM_expression, back_rank AS GTEx_back_Expression_Rank,
  round(kept, 4) AS GTEx_kept_TPM_expression, kept_rank AS GTEx_kept_Expression_Rank, coalesce(hits, 0) AS GWAS_hits,
  {", ".join(f"{_median_sql(c)} AS GWAS_{c}" for c in ("max_P", "min_P", "max_E", "min_E"))},
  CASE WHEN hits > 0 THEN 1 ELSE 0 END AS GWAS_flag, CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS GO_promo,
  CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END AS GO_small, coalesce(k, 0) AS MGI_mouse_knockout_feature,
  round({_median_sql("price")}, 4) AS GnomAD_price FROM joined""")
def feature_job(spark, sf):
    """The whole way from raw tables to a complete feature table: seeds by terms, five sources, gaps filled."""
    part = table(spark, sf, "part").withColumn("entity_id", F.col("p_partkey").cast("string"))
    line = table(spark, sf, "lineitem").withColumn("entity", F.col("l_partkey").cast("string"))
    matrix = line.select("entity", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("came back"),
                         F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("was kept"))
    parts = {
        "expression": lambda c: X.expression_features(matrix, "entity", c.universe, ["back", "kept"]),
        "hits": lambda c: X.association_hits(line, "entity", "l_discount", "l_quantity", c.universe, threshold=0.005),
        "sets": lambda c: X.set_flags(part.select(F.col("p_type").alias("set_name"), "entity_id"), ["promo", "small"]),
        "knockouts": lambda c: X.phenotype_flag(line.filter("l_quantity > 45"), "l_partkey", "l_returnflag", ["r"], name="MGI_mouse_knockout_feature"),
        "scores": lambda c: part.select("entity_id", F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("GnomAD_price")),
        "sparse": lambda c: part.select("entity_id", F.when(F.col("p_size") == 51, 1.0).alias("never")),
        "nothing": lambda c: part.filter("p_size < 0").select("entity_id", F.col("p_size").alias("GO_none")),
    }
    out = compile_features(part.select("entity_id"), Source(part, "p_name", B.INCLUDE, B.EXCLUDE), "entity_id", parts).complete
    return out.select(*[F.round(c, 4).alias(c) if c in ("GTEx_back_TPM_expression", "GTEx_kept_TPM_expression", "GnomAD_price") else c
                        for c in out.columns])
