"""VAL-8: bagged trees with out-of-bag scoring, on the joint forest (``forest``).

A row's multiplicity in the bootstrap sample of tree t is a Poisson(1) number
drawn from a hash of its id and t. Its out-of-bag vote averages the class
shares of the trees whose sample does not hold it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from . import forest as FO

# task functions travel by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 345


def poisson_weight(id_col: str, tree: int, seed: int = 0) -> Column:
    """Multiplicity of a row in the bootstrap sample of ``tree``."""
    draw = FO.multiplicity

    @F.pandas_udf("double")
    def times(key):
        import pandas as pd
        return pd.Series(draw(key.to_numpy(), tree, seed).astype("float64"))
    return times(F.xxhash64(id_col))


def fit_bagged_trees(train: DataFrame, num_trees: int = 50, max_depth: int = 30, min_split: int = 2,
                     max_bins: int = 64, seed: int = SEED, id_col: str = "id", label: str = "label",
                     features: str = "features", classes: int = 2) -> FO.Forest:
    """``num_trees`` trees, all grown in the same passes."""
    return FO.grow(train, [FO.Fit("bag", num_trees)], classes, max_depth, min_split, max_bins, seed, label, features,
                   id_col=id_col)


def bagged_predict(df: DataFrame, forest: FO.Forest, features: str = "features", id_col: str = "id") -> DataFrame:
    """id, label, prediction and score (probability of class 1) of the bagged trees."""
    return FO.score(forest, df, features=features, id_col=id_col).drop("probability", "used")


def oob_predict(train: DataFrame, forest: FO.Forest, id_col: str = "id", label: str = "label",
                features: str = "features") -> DataFrame:
    """id, label, oob_prediction per training row (NULL where every sample holds the row)."""
    out = FO.score(forest, train, oob=True, label=label, features=features, id_col=id_col)
    return out.select(id_col, label, F.col("prediction").alias("oob_prediction"))


def oob_score(train: DataFrame, forest: FO.Forest, id_col: str = "id", label: str = "label",
              features: str = "features") -> DataFrame:
    """Out-of-bag accuracy over rows with at least one out-of-bag tree."""
    o = oob_predict(train, forest, id_col, label, features)
    return o.filter(F.col("oob_prediction").isNotNull()).agg(
        F.avg((F.col("oob_prediction") == F.col(label)).cast("double")).alias("oob_accuracy"),
        F.count(F.lit(1)).alias("n_scored"))
