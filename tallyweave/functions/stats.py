"""Small Arrow functions for what Spark SQL lacks, applied to one row per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(v) if v == v else float("nan"))


@F.pandas_udf(T.StringType())
def scientific(x: pd.Series, digits: pd.Series) -> pd.Series:
    """Mantissa and exponent of the double itself. Java rounds its shortest text once more, which is wrong where that text ends in a five."""
    return pd.Series([f"{v:.{d - 1}e}" if math.isfinite(v) else None for v, d in zip(x, digits, strict=True)], dtype=object)


SOLUTION = T.StructType(
    [T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("inverse", T.ArrayType(T.DoubleType()))]
)


@F.pandas_udf(SOLUTION)
def solve_normal(xtx: pd.Series, xty: pd.Series) -> pd.DataFrame:
    """Pseudo-inverse solution of each group's k-by-k normal equations."""
    right = np.stack(xty.to_numpy())
    k = right.shape[1]
    inverse = np.linalg.pinv(np.stack(xtx.to_numpy()).reshape(-1, k, k))
    beta = np.einsum("gij,gj->gi", inverse, right)
    return pd.DataFrame({"beta": list(beta), "inverse": list(inverse.reshape(-1, k * k))})


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.sqrt(F.lit(2.0)))
