"""Linear embedding of feature vectors and clusters in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_vectors(df: DataFrame, columns: Sequence[str] | None = None, array: str | None = None) -> DataFrame:
    """Adds the vector column `features` from numeric columns or one array column."""
    if array:
        return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)


def principal_components(df: DataFrame, components: int = 20, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with array `pcs`, explained variance per component), on explicitly centred vectors.

    MLlib's PCA does not centre what it projects, hence the scaler before it. The
    covariance is d x d; rows never leave the executors.
    """
    if width is None:
        width = len(df.select("features").first()[0])
    k = min(components, max(width - 1, 1))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="features", outputCol="_centred").fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="_pcs").fit(centred)
    rows = model.transform(centred).withColumn("pcs", vector_to_array("_pcs")).drop("_centred", "_pcs")
    shares = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return rows, df.sparkSession.createDataFrame(shares, "component int, explained double")


def cluster(df: DataFrame, clusters: int = 15, dimensions: int = 2, seed: int = 1) -> DataFrame:
    """Hierarchical (bisecting) clusters of the first principal components, as `cluster`.

    MLlib starts each split from the centre moved by a fraction of its own length, which
    for centred data is no move at all; so points are shifted away from the origin first.
    """
    axes = range(min(dimensions, len(df.select("pcs").first()[0])))
    ends = df.agg(*[e for i in axes for e in (
        F.min(F.col("pcs")[i]).alias(f"a{i}"), F.max(F.col("pcs")[i]).alias(f"b{i}"))]).first()
    shifted = [F.col("pcs")[i] - F.lit(2 * ends[f"a{i}"] - ends[f"b{i}"]) for i in axes]
    points = df.withColumn("_xy", array_to_vector(F.array(*shifted)))
    model = BisectingKMeans(k=clusters, featuresCol="_xy", predictionCol="cluster", seed=seed).fit(points)
    return model.transform(points).drop("_xy")
