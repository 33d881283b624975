"""Profiling a feature table and making it ready for learners."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedlift.functions.numbers import half_even, phred_capped, without_nan
from seedlift.operators.features import fill_with_median
from seedlift.operators.order import shuffled_positions

# Ship these functions with the plan, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ("entity_id", "label")
# Columns of a tile when pairs of columns are taken.
TILE = 512

# Name parts and names of features where missing means none.
ZERO_PARTS = ("GO_", "ProteinAtlas_", "GTEx_", "GWAS_")
ZERO_NAMES = (
    "known_gene", "glom_FDR", "glom_Pr_of_no_eQTL", "glom_Exp_num_of_eQTLs", "tub_FDR", "tub_Pr_of_no_eQTL",
    "tub_Exp_num_of_eQTLs", "MGI_mouse_knockout_feature", "GOA_Kidney_Research_Priority", "DAPPLE_perc_core_overlap",
    "Inferred_perc_core_overlap", "Experimental_perc_core_overlap", "MGI_essential_gene",
    "ProteinAtlas_gene_expr_levels", "tubular_expr_flag", "glomerular_expr_flag", "CKDdb_num_of_studies",
    "CKDdb_Disease", "ProteinAtlas_RNA_expression_TMP", "essential_mouse_knockout", "non_essential_mouse_knockout",
    "platelets_eQTL", "HT_eQTL_hits", "CAD_eQTL_hits", "adipose_cis_eQTL", "adipose_GWAS_locus",
    "Inferred_seed_genes_overlap", "Experimental_seed_genes_overlap",
)
# Name part and names of features where missing means unknown.
MEDIAN_PARTS = ("GnomAD_",)
MEDIAN_NAMES = (
    "ExAC_dup.score", "ExAC_del.score", "ExAC_dup.sing.score", "ExAC_del.sing.score", "ExAC_dup.sing",
    "ExAC_del.sing", "ExAC_num_targ", "ExAC_dup", "ExAC_del", "ExAC_mean_rd", "ExAC_gc_content", "ExAC_complexity",
    "ExAC_cds_len", "ExAC_gene_length", "ExAC_flag", "ExAC_segdups", "ExAC_dip", "ExAC_cnv.score",
    "mut_prob_splice_site", "RVIS", "RVIS_ExAC", "RVIS_ExACv2", "MTR_ExACv2", "geneCov_ExACv2", "LoF_FDR_ExAC",
    "GeneSize",
)
# Features that measure length.
LENGTH_NAMES = ("GeneSize", "ExAC_cds_len", "ExAC_gene_length")


def numeric_columns(df: DataFrame, skip: Sequence[str] = KEYS) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Sequence[str] = KEYS) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _unpivot(row: DataFrame, pairs: Sequence[tuple[str, dict[str, Column]]]) -> DataFrame:
    items = [F.struct(F.lit(n).alias("feature"), *[e.alias(k) for k, e in cols.items()]) for n, cols in pairs]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*")


# ---- missing values ----------------------------------------------------------

def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count and percent (two places) for every column, from one pass."""
    columns = list(columns or df.columns)
    aggs = [F.count(F.when(_c(c).isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count("*").alias("n"), *aggs)
    return _unpivot(row, [
        (c, {"n_null": F.col(f"n{i}"),
             "pct_null": F.round(F.lit(100.0) * F.col(f"n{i}") / F.nullif(F.col("n"), F.lit(0)), 2)})
        for i, c in enumerate(columns)])


def drop_sparse(df: DataFrame, threshold: float = 0.99, keep: Sequence[str] = KEYS) -> DataFrame:
    """Without columns whose share of missing values is above `threshold`."""
    columns = [c for c in df.columns if c not in keep]
    row = df.agg(F.count("*").alias("_n"), *[F.count(_c(c)).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    sparse = [c for i, c in enumerate(columns) if row["_n"] and (row["_n"] - row[f"k{i}"]) / row["_n"] > threshold]
    return df.drop(*sparse)


def zero_fill_columns(df: DataFrame, names: Sequence[str] = ZERO_NAMES, parts: Sequence[str] = ZERO_PARTS) -> list[str]:
    return [c for c in df.columns if c in names or any(p in c for p in parts)]


def fill_zero(df: DataFrame, columns: Sequence[str] | None = None,
              level: str = "ProteinAtlas_gene_expr_levels", level_text: str = "Not_detected") -> DataFrame:
    """0 for missing values of the named columns; a missing level becomes `level_text`."""
    columns = zero_fill_columns(df) if columns is None else list(columns)
    if level in df.columns and level in columns:
        as_text = _c(level).cast("string")
        df = df.withColumn(level, F.when(as_text.isNull() | (as_text == "0"), level_text).otherwise(as_text))
    return df.fillna(0, subset=[c for c in columns if c != level])


def fill_unknown(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "median",
                 key: str = "entity_id") -> DataFrame:
    """The column median for missing values; `mode="zero"` fills 0."""
    if columns is None:
        columns = [c for c in df.columns if c in MEDIAN_NAMES or any(p in c for p in MEDIAN_PARTS)]
    if not columns:
        return df
    return df.fillna(0, subset=list(columns)) if mode == "zero" else fill_with_median(df, columns, key)


def require_complete(df: DataFrame) -> DataFrame:
    """Return `df`, or raise naming the columns that still miss values."""
    row = df.agg(*[F.max(_c(c).isNull()).alias(f"k{i}") for i, c in enumerate(df.columns)]).first()
    missing = [c for i, c in enumerate(df.columns) if row[i]]
    if missing:
        raise ValueError(f"missing values in {missing}")
    return df


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[without_nan(_c(c)).alias(c) if c in floats else _c(c) for c in df.columns])


def phred_columns(df: DataFrame, columns: Sequence[str], floor: float = 1e-8) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, phred_capped(_c(c), floor))
    return df


# ---- redundant columns -------------------------------------------------------

def _moments(left: int, right: int):
    """Per task: for each pair of a left and a right column, count and sums over the rows that have both."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, left, right))
        for batch in batches:
            z = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = np.isfinite(z)
            z, m = np.where(there, z, 0.0), there.astype(float)
            x, y, a, b = z[:, :left], z[:, left:], m[:, :left], m[:, left:]
            total += np.stack([a.T @ b, x.T @ b, a.T @ y, (x * x).T @ b, a.T @ (y * y), x.T @ y])
        i, j = np.meshgrid(np.arange(left), np.arange(right), indexing="ij")
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), *[pa.array(t.ravel()) for t in total]],
            names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])
    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair i < j as rows `(i, j, r)`, over the rows that have both values.

    r is null where a column is constant there. Values are centred and scaled first, by
    one aggregate row; columns go in pairs of tiles, one scan each, whatever their number.
    """
    columns = list(columns)
    row = df.agg(*[F.avg(without_nan(_c(c).cast("double"))).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(without_nan(_c(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = [((_c(c).cast("double") - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"] or 1.0)).alias(f"z{i}") for i, c in enumerate(columns)]
    names = F.array(*[F.lit(c) for c in columns]) if columns else F.array().cast("array<string>")
    parts = []
    for low in range(0, len(columns), TILE):
        for other in range(low, len(columns), TILE):
            one, two = scaled[low:low + TILE], scaled[other:other + TILE]
            parts.append(df.select(*one, *[z.alias(f"w{k}") for k, z in enumerate(two)]).mapInArrow(
                _moments(len(one), len(two)), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
                .select((F.col("a") + low).alias("a"), (F.col("b") + other).alias("b"), "n", "x", "y", "xx", "yy", "xy"))
    if not parts:
        return df.sparkSession.createDataFrame([], "i string, j string, r double")
    sums = reduce(DataFrame.unionByName, parts).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    dx, dy = F.col("xx") - F.col("x") * F.try_divide("x", "n"), F.col("yy") - F.col("y") * F.try_divide("y", "n")
    r = (F.col("xy") - F.col("x") * F.try_divide("y", "n")) / F.sqrt(dx * dy)
    return sums.select(F.element_at(names, F.col("a") + 1).alias("i"), F.element_at(names, F.col("b") + 1).alias("j"),
                       F.when((dx > 1e-12) & (dy > 1e-12), r).alias("r"))


def correlated_columns(df: DataFrame, columns: Sequence[str], above: float, inclusive: bool = False) -> list[str]:
    """Columns whose |r| with any earlier column is above the bound, even if that one goes too."""
    size = F.abs(F.col("r"))
    hit = size >= above if inclusive else size > above
    gone = {r[0] for r in correlations(df, columns).filter(hit).select("j").distinct().collect()}
    return [c for c in columns if c in gone]


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    return df.drop(*correlated_columns(df, numeric_columns(df), 1 - 1e-12, inclusive=True))


def drop_correlated(df: DataFrame, threshold: float = 0.85) -> DataFrame:
    return df.drop(*correlated_columns(df, numeric_columns(df), threshold))


def zero_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns that are 0 in every row."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[F.max((F.coalesce(_c(c) != 0, F.lit(True)))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if row[i] is False]


def drop_uninformative(df: DataFrame, length_names: Sequence[str] = LENGTH_NAMES, drop_length: bool = True) -> DataFrame:
    return df.drop(*(length_names if drop_length else ()), *zero_columns(df))


# ---- scaling and coding ------------------------------------------------------

def standardise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; a constant column is only centred.

    The moments are one aggregate row, read first and put into the plan as constants.
    """
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[F.avg(_c(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                 *[F.stddev_pop(_c(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    place = {c: i for i, c in enumerate(columns)}

    def scaled(c: str) -> Column:
        mean, sd = row[f"m{place[c]}"], row[f"s{place[c]}"] or 1.0
        return ((_c(c) - F.lit(mean)) / F.lit(sd)).alias(c)

    return df.select(*[scaled(c) if c in place else _c(c) for c in df.columns])


def one_hot(df: DataFrame, columns: Sequence[str] | None = None,
            values_of: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """0/1 columns `<column>_<value>` after the rest, for the given values or all that occur.

    A column of very many values belongs in long form (`features.category_flags`).
    """
    columns = list(columns or text_columns(df))
    coded = []
    for c in columns:
        values = (values_of or {}).get(c) or [r[0] for r in df.select(_c(c)).distinct().collect()]
        coded += [F.when(_c(c) == v, 1).otherwise(0).alias(f"{c}_{v}") for v in sorted(v for v in values if v is not None)]
    return df.select(*[_c(x) for x in df.columns if x not in columns], *coded)


def coded_vectors(df: DataFrame, columns: Sequence[str], numeric: Sequence[str] = (), name: str = "features") -> DataFrame:
    """`df` with a sparse vector column of the numeric columns and a 0/1 place for each value of the text columns.

    A row has as many entries as it has columns, however many values there are; the learners of MLlib take the
    column as it is (`learners.block_table`). A null value has no entry.
    """
    index, hot = [f"{name}_{i}_index" for i in range(len(columns))], [f"{name}_{i}_hot" for i in range(len(columns))]
    given = df.withColumns({f"{name}_{i}_text": _c(c).cast("string") for i, c in enumerate(columns)})
    texts = [f"{name}_{i}_text" for i in range(len(columns))]
    stages = [StringIndexer(inputCols=texts, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
              OneHotEncoder(inputCols=index, outputCols=hot, dropLast=True),
              VectorAssembler(inputCols=[*numeric, *hot], outputCol=name)]
    return Pipeline(stages=stages).fit(given).transform(given).drop(*texts, *index, *hot)


# ---- sampling ----------------------------------------------------------------

def stratified_split(df: DataFrame, test_size: float, salt: str = "split", label: str = "label") -> DataFrame:
    """Adds `part`: floor(test_size * class size) rows of each class are 'test', the rest 'train'."""
    placed = shuffled_positions(df, "entity_id", salt, [label], [], "_rn", "_n")
    cut = F.floor(F.col("_n") * F.lit(float(test_size)))
    return placed.withColumn("part", F.when(F.col("_rn") <= cut, "test").otherwise("train")).drop("_rn", "_n")


def downsample(df: DataFrame, ratio: float, salt: str = "down", label: str = "label") -> DataFrame:
    """All seeds and round(seeds * ratio) of the rest, half to even."""
    keep = half_even(df.filter(F.col(label) == 1).count() * ratio)
    placed = shuffled_positions(df, "entity_id", salt, [label], [], "_rn")
    return placed.filter((F.col(label) == 1) | (F.col("_rn") <= keep)).drop("_rn")


# ---- the whole preparation ---------------------------------------------------

def prepare(df: DataFrame, correlation: float = 0.85, drop_length: bool = True) -> tuple[DataFrame, DataFrame]:
    """(all features, features without highly correlated ones), both scaled and one-hot coded."""
    df = drop_uninformative(drop_duplicate_columns(df), drop_length=drop_length)
    scaled = standardise(require_complete(df))
    return one_hot(scaled), one_hot(drop_correlated(scaled, correlation))
