"""Turning raw annotation rows into one feature row per entity."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedlift.functions.numbers import flag
from seedlift.functions.text import clean_column_name, matches_any, tag_text
from seedlift.operators.joins import attach, merge_tables, reindex, require_unique, left_chain
from seedlift.operators.order import number_rows
from seedlift.operators.terms import term_columns, term_filter
from seedlift.runtime import pin

# Codes of expression levels, one feature per entity.
LEVEL_CODES = {"Not detected": 0, "Low": 1, "Medium": 3, "High": 8}
LEVEL_NAMES = {0: "Not_detected", 1: "Low", 3: "Medium", 8: "High"}
# Codes of expression levels, one flag per entity and cell type.
LEVEL_FLAGS = {"Not detected": 0, "Low": 0, "Medium": 1, "High": 1}

# Name groups that fold study-specific features together.
HOMOGENISE_RULES = (
    (r"^.*GTEx.*expression.*$", "GTEx_tissue_specific_TPM_expression"),
    (r"^.*GTEx.*Rank.*$", "GTEx_tissue_specific_Expression_Rank"),
    (r"^.*GO_.*$", "GO_tissue_specific"),
    (r"^[^_]+_GWAS_", "Tissue_specific_GWAS_"),
    (r"^.*ProteinAtlas_.*Expr_Flag.*$", "ProteinAtlas_gene_expr_levels_Not_detected"),
    (r"^.*ProteinAtlas_.*_RNA_Expr_TPM.*$", "ProteinAtlas_RNA_expression_TPM"),
    (r"ProteinAtlas_RNA_expression_TMP", "ProteinAtlas_RNA_expression_TPM"),
)


# ---- names -----------------------------------------------------------------

def prefix_columns(df: DataFrame, prefix: str, key: str = "entity_id") -> DataFrame:
    return df.select(*[F.col(f"`{c}`").alias(c if c == key else prefix + c) for c in df.columns])


def clean_columns(df: DataFrame, key: str = "entity_id", prefix: str = "", suffix: str = "") -> DataFrame:
    return df.toDF(*[c if c == key else prefix + clean_column_name(c) + suffix for c in df.columns])


def rename_part(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.toDF(*[c.replace(old, new) for c in df.columns])


def by_position(df: DataFrame, positions: Sequence[int], names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{df.columns[p]}`").alias(n) for p, n in zip(positions, names)])


def column_last(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], column)


def recode(column: str | Column, table: Mapping) -> Column:
    """Values by table; a value outside it becomes null."""
    col = F.col(column) if isinstance(column, str) else column
    out = F.lit(None)
    for old, new in table.items():
        out = F.when(col == old, F.lit(new)).otherwise(out)
    return out


# ---- delimited lists ---------------------------------------------------------

def explode_delimited(df: DataFrame, column: str, sep: str, keep: bool = False, trim: bool = True) -> DataFrame:
    """One row per piece; null lists give no row. `keep` also retains an unsplit row of several pieces."""
    pieces = F.split(F.col(column), re.escape(sep), -1)
    if keep:
        pieces = F.when(F.size(pieces) > 1, F.concat(pieces, F.array(column))).otherwise(pieces)
    rows = df.filter(F.col(column).isNotNull()).withColumn(column, F.explode(pieces))
    return rows.withColumn(column, F.trim(column)) if trim else rows


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(name))


def any_listed(df: DataFrame, column: str, listed: DataFrame, key: str, entity: str, sep: str = " ",
               name: str = "flag") -> DataFrame:
    """Entities with a listed id in their delimited id list, once each, flagged 1."""
    ids = df.select(F.col(entity).alias("entity_id"), F.explode(F.split(column, sep, -1)).alias(key)).distinct()
    return ids.join(listed.select(key).distinct(), key, "left_semi").select("entity_id").distinct().withColumn(
        name, F.lit(1))


# ---- per-entity aggregates ---------------------------------------------------

def means_with_flag(df: DataFrame, key: str, columns: Sequence[str], flag_column: str, threshold: float = 0.5,
                    prefix: str = "") -> DataFrame:
    """Means per entity; the mean flag is cut back to 0/1 at `threshold`."""
    means = df.groupBy(F.col(key).alias("entity_id")).agg(
        *[F.avg(c).alias(c) for c in columns], F.avg(flag_column).alias(flag_column))
    cut = F.when(F.col(flag_column).isNotNull(), flag(F.col(flag_column) >= threshold))
    return prefix_columns(means.withColumn(flag_column, cut), prefix)


def best_rows(df: DataFrame, key: str, by: Column, tiebreak: Sequence[str]) -> DataFrame:
    """The row with the largest `by` per key, ties by smallest `tiebreak`; merged before the shuffle."""
    rest = [c for c in df.columns if c != key]
    ranked = F.struct(F.coalesce(by.cast("double"), F.lit(float("-inf"))).alias("b"),
                      *[(-F.col(t)).alias(f"t{i}") for i, t in enumerate(tiebreak)])
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), ranked).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def constraint_features(df: DataFrame, key: str, canonical: Column, by: Column, tiebreak: Sequence[str],
                        drop: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Canonical rows, the best one per entity, housekeeping columns dropped, the rest prefixed."""
    best = best_rows(df.filter(canonical), key, by, tiebreak)
    return prefix_columns(best.drop(*drop).withColumnRenamed(key, "entity_id"), prefix)


def association_hits(df: DataFrame, entities: str, p: str, effect: str, universe: DataFrame, *,
                     phrase: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (),
                     threshold: float = 5e-8, sep: str = ",", prefix: str = "GWAS") -> DataFrame:
    """Hits, smallest/largest p and effect, and a hit flag for every entity of the universe.

    Only rows with p strictly below `threshold` count. Entities without a value get
    the exact median of the per-entity minima (maxima).
    """
    if phrase and include:
        df = term_filter(df, phrase, include, exclude)
    hits = df.select(entities, F.col(p).cast("double").alias("P"), F.col(effect).cast("double").alias("E")).filter(
        F.col("P") < threshold)
    per_entity = (
        explode_delimited(hits, entities, sep)
        .groupBy(F.col(entities).alias("entity_id"))
        .agg(F.count("P").alias("hits"), F.max("P").alias("max_P"), F.min("P").alias("min_P"),
             F.max("E").alias("max_E"), F.min("E").alias("min_E"))
    )
    table = pin(reindex(per_entity, universe, fill=None).fillna(0, subset=["hits"]), "hits")
    filled = fill_with_median(table, ["max_P", "min_P", "max_E", "min_E"])
    out = filled.withColumn("flag", flag(F.col("hits") > 0))
    return out.toDF(*[c if c == "entity_id" else f"{prefix}_{c}" for c in out.columns])


def medians(df: DataFrame, columns: Sequence[str], key: str = "entity_id") -> dict[str, float | None]:
    """Exact medians without sorting the table: `{column: median}`.

    Approximate quantiles, whose rank error is bounded, bracket each median; one pass
    counts the rows below the bracket, and only the fraction inside is put in order.
    """
    names = list(columns)
    c = {n: F.col(f"`{n}`").cast("double") for n in names}
    margin, accuracy = 0.002, 10_000  # the bracket is 20 times wider than the error on each side
    near = df.agg(*[F.percentile_approx(c[n], [0.5 - margin, 0.5 + margin], accuracy).alias(f"q{i}")
                    for i, n in enumerate(names)]).first()
    ends = {n: near[f"q{i}"] for i, n in enumerate(names) if near[f"q{i}"] is not None}
    found: dict[str, float | None] = dict.fromkeys(names)
    if not ends:
        return found
    row = df.agg(*[e for i, (n, (low, high)) in enumerate(ends.items()) for e in (
        F.count(c[n]).alias(f"n{i}"), F.count_if(c[n] < low).alias(f"b{i}"),
        F.count_if(c[n].between(low, high)).alias(f"i{i}"))]).first()
    places, wanted = {}, []
    for i, (n, (low, high)) in enumerate(ends.items()):
        count, below = row[f"n{i}"], row[f"b{i}"]
        if low == high:
            found[n] = low
            continue
        # 1-based positions of the middle rows among those at or above `low`.
        places[n] = ((count - 1) // 2 + 1 - below, count // 2 + 1 - below)
        if places[n][0] < 1 or places[n][1] > row[f"i{i}"]:
            raise ArithmeticError(f"the sketch's bracket {low} to {high} misses the median of {n}")
        wanted.append(F.when(c[n].between(low, high), F.struct(F.lit(n).alias("feature"), c[n].alias("value"))))
    if not places:
        return found
    inside = df.select(F.col(key).cast("string").alias("_id"), F.explode(F.array_compact(F.array(*wanted))).alias("s"))
    placed = number_rows(inside.select("_id", "s.*"), ["value", "_id"], "_pos", ["feature"])
    middle = F.lit(False)
    for n, (one, two) in places.items():
        middle = middle | ((F.col("feature") == n) & F.col("_pos").isin(one, two))
    for r in placed.filter(middle).groupBy("feature").agg(F.avg("value").alias("m")).collect():
        found[r["feature"]] = r["m"]
    return found


def fill_with_median(df: DataFrame, columns: Sequence[str], key: str = "entity_id") -> DataFrame:
    known = {c: v for c, v in medians(df, columns, key).items() if v is not None}
    return df.fillna(known) if known else df


def ordinal_max(df: DataFrame, key: str, level: str, codes: Mapping[str, int] = LEVEL_CODES,
                names: Mapping[int, str] = LEVEL_NAMES, name: str = "level") -> DataFrame:
    """Highest level per entity; levels outside the table count as missing."""
    top = df.groupBy(F.col(key).alias("entity_id")).agg(F.max(recode(level, codes)).alias("_code"))
    return top.select("entity_id", recode("_code", names).alias(name))


def pivot_levels(df: DataFrame, key: str, category: str, value: Column, values: Sequence[str], agg: str = "max",
                 prefix: str = "", suffix: str = "") -> DataFrame:
    """One column per category value, 0 where absent; `values` fixes the columns."""
    out = df.groupBy(F.col(key).alias("entity_id"))
    aggs = []
    for v in values:
        mine = F.when(F.col(category) == v, value)
        aggs.append(F.coalesce({"max": F.max, "sum": F.sum}[agg](mine), F.lit(0)).alias(
            prefix + str(v).replace(" ", "_") + suffix))
    return out.agg(*aggs)


def collapse_tissue_levels(df: DataFrame, key: str, category: str, level: str, values: Sequence[str],
                           codes: Mapping[str, int] = LEVEL_FLAGS, prefix: str = "ProteinAtlas_",
                           suffix: str = "_Expr_Flag") -> DataFrame:
    """A 0/1 expression flag per category: 1 if any row there is medium or high."""
    return pivot_levels(df, key, category, recode(level, codes), values, prefix=prefix, suffix=suffix)


def category_values(df: DataFrame, column: str) -> list:
    """Sorted distinct values of a column, to fix a pivot's columns: one column each, so as many as a table can have."""
    return sorted(r[0] for r in df.select(column).distinct().collect() if r[0] is not None)


def category_flags(df: DataFrame, key: str, category: str, prefix: str = "") -> DataFrame:
    """The long form of a pivot, for any number of values: `(entity_id, feature, value)`, value 1 for every pair that occurs."""
    return df.filter(F.col(category).isNotNull()).select(
        F.col(key).cast("string").alias("entity_id"), F.concat(F.lit(prefix), F.col(category).cast("string")).alias("feature")
    ).distinct().withColumn("value", F.lit(1))


def tissue_features(levels: DataFrame, rna: DataFrame, key: str, include: Sequence[str],
                    exclude: Sequence[str] = (), tissue: str = "Tissue", level: str = "Level",
                    reliability: str = "Reliability", sample: str = "Sample", value: str = "Value") -> DataFrame:
    """Highest reliable level and summed RNA value over the chosen tissues, merged."""
    sure = term_filter(levels, tissue, include, exclude).filter(~F.col(reliability).eqNullSafe("Uncertain"))
    chosen = term_filter(rna, sample, include, exclude)
    sums = chosen.groupBy(F.col(key).alias("entity_id")).agg(F.sum(value).alias("rna_expression"))
    return merge_tables([ordinal_max(sure, key, level), sums])


def floor_ranks(df: DataFrame, total: str, rank: str = "rank", key: str = "entity_id",
                floor: str = "last") -> DataFrame:
    """Rank by `total`, largest first; rows below the truncated median get the last rank (or 0)."""
    numbered = number_rows(df, [F.col(total).desc(), F.col(key)], "_pos", total="_n")
    cut = int(medians(numbered, [total], key)[total] or 0)  # read from the numbered table, already written
    worst = F.col("_n") if floor == "last" else F.lit(0)
    return numbered.withColumn(rank, F.when(F.col(total) < cut, worst).otherwise(F.col("_pos"))).drop("_pos", "_n")


def expression_features(matrix: DataFrame, key: str, universe: DataFrame, terms: Sequence[str],
                        exclude: Sequence[str] = (), prefix: str = "GTEx_") -> DataFrame:
    """Per term: summed expression over the matching columns and its floored rank, on the universe."""
    tables = []
    for term in terms:
        cols = term_columns([c for c in matrix.columns if c != key], [term], exclude)
        if not cols:
            continue
        name = prefix + term.replace(" ", "")
        row = sum((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in cols[1:]),
                  F.coalesce(F.col(f"`{cols[0]}`"), F.lit(0.0)))
        totals = matrix.groupBy(F.col(key).alias("entity_id")).agg(F.sum(row).alias(name + "_TPM_expression"))
        tables.append(floor_ranks(reindex(totals, universe), name + "_TPM_expression", name + "_Expression_Rank"))
    if not tables:
        return universe.select("entity_id")
    return merge_tables(tables)


def expression_by_column(matrix: DataFrame, key: str, prefix: str = "GTEx_",
                         suffix: str = "_TPM_expression") -> DataFrame:
    """Summed expression per entity for every column, with clean names."""
    cols = [c for c in matrix.columns if c != key]
    sums = matrix.groupBy(F.col(key).alias("entity_id")).agg(*[F.sum(f"`{c}`").alias(c) for c in cols])
    return clean_columns(sums, "entity_id", prefix, suffix)


# ---- sets and neighbours -----------------------------------------------------

def large_sets(sets: DataFrame, at_least: int = 150) -> DataFrame:
    """Sets with at least that many distinct members."""
    members = sets.distinct().groupBy("set_name").agg(F.count("*").alias("n"))
    large = pin(members.filter(F.col("n") >= at_least), "sets")
    return attach(sets, large, "set_name").filter(F.col("n").isNotNull()).drop("n")


def set_flags(sets: DataFrame, terms: Sequence[str], prefix: str = "GO_", regex: bool = False) -> DataFrame:
    """One 0/1 column per term: the entity is in some set whose name matches the term."""
    return sets.groupBy("entity_id").agg(*[
        F.max(flag(matches_any("set_name", [t], regex))).alias(prefix + t.replace(" ", "_")) for t in terms])


def all_set_flags(sets: DataFrame, at_least: int = 150, prefix: str = "GO_", names: Sequence[str] | None = None) -> DataFrame:
    """Membership in every set of at least that many members, as rows `(entity_id, feature, value)`.

    With `names`, one 0/1 column for each of these sets instead.
    """
    large = large_sets(sets, at_least)
    if names is None:
        return category_flags(large, "entity_id", "set_name", prefix)
    return pivot_levels(large, "entity_id", "set_name", F.lit(1), names, prefix=prefix)


def phenotype_flag(df: DataFrame, entity: str, phrase: str, include: Sequence[str], exclude: Sequence[str] = (),
                   name: str = "phenotype") -> DataFrame:
    """Entities with a phrase the terms choose, once each, flagged 1."""
    chosen = term_filter(df, phrase, include, exclude)
    return chosen.select(F.col(entity).cast("string").alias("entity_id")).distinct().withColumn(name, F.lit(1))


def both_ways(edges: DataFrame, left: str = "left", right: str = "right", keep: Sequence[str] = ()) -> DataFrame:
    """Every edge from either end as `(entity_id, neighbour, ...)`."""
    one = edges.select(F.col(left).alias("entity_id"), F.col(right).alias("neighbour"), *keep)
    two = edges.select(F.col(right).alias("entity_id"), F.col(left).alias("neighbour"), *keep)
    return one.unionByName(two)


def neighbour_lists(edges: DataFrame) -> DataFrame:
    """Every entity's neighbours in order, as rows `(entity_id, pos, neighbour, n)`; a repeated edge is one row of count n.

    Long form at any size: no hub is gathered into one row or task.
    """
    merged = edges.groupBy("entity_id", "neighbour").agg(F.count("*").alias("n"))
    return number_rows(merged, ["neighbour"], "pos", ["entity_id"]).select("entity_id", "pos", "neighbour", "n")


def seed_share(edges: DataFrame, seeds: DataFrame, name: str = "seed_share",
               extra: Sequence[str] = ()) -> DataFrame:
    """Distinct seed neighbours over all neighbour rows, per entity (and `extra` columns).

    Repeated edges are merged first, so neither a hub nor a repeated pair is gathered whole.
    """
    merged = edges.groupBy("entity_id", "neighbour", *extra).agg(F.count("*").alias("_n"))
    marks = seeds.select(F.col("entity_id").alias("neighbour")).distinct().withColumn("_seed", F.lit(1))
    marked = attach(merged, marks, "neighbour")
    return marked.groupBy("entity_id", *extra).agg(
        (F.count("_seed").cast("double") / F.sum("_n")).alias(name))


def neighbour_features(edges: DataFrame, seeds: DataFrame, sources: Sequence[str], source: str = "source",
                       suffix: str = "_seed_share") -> DataFrame:
    """One seed-share column per evidence source from one pass over symmetric edges."""
    merged = edges.groupBy("entity_id", "neighbour", source).agg(F.count("*").alias("_n"))
    marks = seeds.select(F.col("entity_id").alias("neighbour")).distinct().withColumn("_seed", F.lit(1))
    marked = attach(merged, marks, "neighbour")
    aggs = []
    for s in sources:
        here = F.col(source) == s
        aggs.append(F.try_divide(F.count(F.when(here, F.col("_seed"))).cast("double"),
                                 F.sum(F.when(here, F.col("_n")))).alias(s + suffix))
    return marked.groupBy("entity_id").agg(*aggs)


# ---- collapsing annotation rows ---------------------------------------------

def distinct_values(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values per key and column, as rows `(key, field, pos, value, n)`."""
    long = df.select(key, F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("s")).select(key, "s.*").filter(F.col("value").isNotNull())
    merged = long.groupBy(key, "field", "value").agg(F.count("*").alias("n"))
    return number_rows(merged, ["value"], "pos", [key, "field"]).select(key, "field", "pos", "value", "n")


def collapse_by_id(df: DataFrame, key: str, phrase: str, tag: str, distinct: Sequence[str]) -> DataFrame:
    """Rows per key in long form, `(key, field, pos, value, tag, n)`.

    Field `phrase` lists the phrases with their tags in order, those starting with `{`,
    `[` or `?` last; the other fields list sorted distinct values. Equal rows are one
    row of count n, so a key of any size stays spread over the table.
    """
    bottom = F.col(phrase).substr(1, 1).isin("{", "[", "?").cast("int")
    merged = df.select(key, bottom.alias("_bottom"), phrase, tag).groupBy(key, "_bottom", phrase, tag).agg(F.count("*").alias("n"))
    phrases = number_rows(merged, [F.col("_bottom"), F.col(phrase), F.col(tag)], "pos", [key]).select(
        key, F.lit(phrase).alias("field"), "pos", F.col(phrase).alias("value"), F.col(tag).alias("tag"), "n")
    if not distinct:
        return phrases
    return phrases.unionByName(distinct_values(df, key, distinct).withColumn("tag", F.lit(None).cast("string")))


def joined_texts(collapsed: DataFrame, key: str, phrase: str, tag: str, distinct: Sequence[str], sep: str = "|") -> DataFrame:
    """One row per key from its long form, texts joined; for keys whose texts fit in a row each."""
    def joined(field: str, part: str, again: bool) -> Column:
        own = F.sort_array(F.collect_list(F.when(F.col("field") == field, F.struct("pos", "value", "tag", "n"))))
        texts = F.transform(own, lambda s: F.array_repeat(s[part], s["n"].cast("int") if again else F.lit(1)))
        return F.array_join(F.flatten(texts), sep)

    found = collapsed.groupBy(key).agg(
        joined(phrase, "value", True).alias(phrase), joined(phrase, "tag", True).alias(tag),
        *[joined(c, "value", False).alias(c) for c in distinct],
        *[F.count_if(F.col("field") == c).alias(f"_n_{c}") for c in distinct])
    return found.select(key, phrase, tag, *[F.when(F.col(f"_n_{c}") > 0, F.col(c)).alias(c) for c in distinct])


def annotated_map(df: DataFrame, key: str, phrases: str, distinct: Sequence[str], tags: Mapping[str, str],
                  sep: str = ";", marker: str = "(3)", required: Sequence[str] = ()) -> DataFrame:
    """Explode phrase lists, keep marked phrases, tag them, and collapse the rows by key (long form)."""
    rows = explode_delimited(df, phrases, sep).filter(F.col(phrases).contains(marker))
    rows = rows.dropna(subset=list(required)) if required else rows
    return collapse_by_id(rows.withColumn("annotation", tag_text(phrases, tags)), key, phrases, "annotation", distinct)


def named_annotations(annotations: DataFrame, terms: DataFrame, on: str, name: str) -> DataFrame:
    """Annotation rows with the lower-cased name of their term."""
    return attach(annotations, terms.select(on, F.lower(name).alias(name)), on)


def bottom_group(column: str | Column) -> Column:
    """Sort key that puts texts starting with `?`, `[`, `{` last, in that order."""
    first = F.substring(F.col(column) if isinstance(column, str) else column, 1, 1)
    return F.when(first == "?", 1).when(first == "[", 2).when(first == "{", 3).otherwise(0)


def homogenise(df: DataFrame, feature: str, columns: Sequence[str],
               rules: Sequence[tuple[str, str]] = HOMOGENISE_RULES) -> DataFrame:
    """Fold feature names together by pattern, keeping the largest value of each column."""
    name = F.col(feature)
    for pattern, replacement in rules:
        name = F.regexp_replace(name, pattern, replacement)
    return df.withColumn(feature, name).groupBy(feature).agg(*[F.max(c).alias(c) for c in columns])


# ---- assembly ------------------------------------------------------------------

def assemble(universe: DataFrame, seeds: DataFrame, tables: Sequence[DataFrame],
             zero_fill: Sequence[str] = ()) -> DataFrame:
    """The wide feature table: every entity of the universe, label, all features; keys proved unique.

    The table is written once; the uniqueness check then only reads its key column.
    """
    marks = seeds.select("entity_id").distinct().withColumn("label", F.lit(1))
    table = left_chain(universe.select("entity_id"), [marks, *tables]).fillna(0, subset=["label", *zero_fill])
    return require_unique(pin(table, "features"))


def add_on_for(run_name: str, add_ons: Mapping[str, object]):
    """The first add-on whose pattern is found in the run's name, else None."""
    for pattern, add_on in add_ons.items():
        if re.search(pattern, run_name, re.IGNORECASE):
            return add_on
    return None


def collapse_prefixes(profile: DataFrame, feature: str, values: Sequence[str],
                      prefixes: Sequence[str] = ("GO_", "ProteinAtlas_", "GTEx_")) -> DataFrame:
    """Profile rows whose feature shares a prefix become one row named after it."""
    name = F.col(feature)
    for p in prefixes:
        name = F.when(F.col(feature).startswith(p), F.lit(p.rstrip("_") + "-collapsed_features")).otherwise(name)
    return profile.withColumn(feature, name).groupBy(feature).agg(*[F.max(v).alias(v) for v in values])


def run_numbers(df: DataFrame, order: Sequence[Column | str], per_run: int, name: str = "run") -> DataFrame:
    """Run number from the row's place when each run wrote `per_run` rows."""
    return number_rows(df, order, "_pos").withColumn(
        name, F.floor((F.col("_pos") - 1) / per_run).cast("bigint")).drop("_pos")
