"""Arrow-batched UDFs that are made when first used, so that modules import without a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, returns)(*columns)

        return call

    return decorate


#: Rows of a batch that are Python objects at a time.
SLICE = 64


def sliced_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of one row's values; only a slice of a batch is held as Python objects, the rest as Arrow."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            kind = to_arrow_type(DataType.fromDDL(returns))  # here, as workers have no session to read it with

            def batch(*arrays: pa.Array) -> pa.Array:
                slices = ([a.slice(i, SLICE).to_pylist() for a in arrays] for i in range(0, len(arrays[0]), SLICE))
                made = [pa.array([f(*row) for row in zip(*x, strict=True)], kind) for x in slices]
                return pa.concat_arrays(made) if made else pa.array([], kind)

            return F.arrow_udf(batch, returns)(*columns)

        return call

    return decorate


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once and named once in the plan, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
