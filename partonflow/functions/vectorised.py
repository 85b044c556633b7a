"""Escape hatch: a caller's numeric Python over Arrow batches, with declared type and NULL contract.

For code that has no Column form.  The function sees whole batches, never single
rows: a column of numbers is a numpy array, a column of lists is a pair
(values, offsets), the list of row i being ``values[offsets[i]:offsets[i + 1]]``.
It returns the same kinds of things, as many rows as it was given.

The wrapper is defined inside its factory, so it travels to the workers by value,
and so does a function defined in a script or notebook.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

NULLS = ("propagate", "pass")


def arrow_function(function: Callable, returns: DataType | str, nulls: str = "propagate") -> Callable[..., Column]:
    """A Column function that runs ``function`` on Arrow batches.

    ``returns`` is the Spark type of the result, a number or a list of numbers; a
    result that does not fit it, or has another length than the input, is an error.

    ``nulls="propagate"``: rows with NULL in an argument, or inside a list argument,
    give NULL and are kept from the function.  ``nulls="pass"``: all rows reach the
    function; NULL numbers arrive as NaN (so integers arrive as doubles where a batch has NULLs),
    NULL lists as empty ones, and NaN that it returns stays NaN.
    """
    if nulls not in NULLS:
        raise ValueError(f"nulls is one of {NULLS}")
    if isinstance(returns, str):
        returns = StructType.fromDDL(f"x {returns}")["x"].dataType
    if isinstance(returns, StructType):
        raise TypeError("the result is a number or a list of numbers")
    listed = isinstance(returns, ArrayType)

    def run(*columns):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark.sql.pandas.types import to_arrow_type

        flat = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
        total = len(flat[0])

        def is_list(column) -> bool:
            return pa.types.is_list(column.type) or pa.types.is_large_list(column.type)

        def holed(column):
            """Rows that are NULL or, as lists, hold a NULL."""
            missing = pc.is_null(column).to_numpy(zero_copy_only=False)
            if is_list(column) and column.flatten().null_count:
                parents = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
                missing = missing.copy()
                missing[parents[pc.is_null(column.flatten()).to_numpy(zero_copy_only=False)]] = True
            return missing

        def argument(column):
            if not is_list(column):
                return column.to_numpy(zero_copy_only=False)
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

        keep = np.arange(total)
        if nulls == "propagate":
            bad = np.logical_or.reduce([holed(c) for c in flat])
            if bad.any():
                keep = np.flatnonzero(~bad)
                flat = [c.take(pa.array(keep)) for c in flat]
        result = function(*map(argument, flat))
        kind = to_arrow_type(returns)
        if listed:
            values, offsets = result
            if len(offsets) != len(keep) + 1 or offsets[-1] != len(values):
                raise ValueError(f"offsets of {len(offsets) - 1} lists over {offsets[-1]} values for {len(keep)} rows and {len(values)} values")
            made = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values).cast(kind.value_type))
        else:
            if len(result) != len(keep):
                raise ValueError(f"{len(result)} results for {len(keep)} rows")
            made = pa.array(result).cast(kind)
        if len(keep) == total:
            return made.cast(kind)
        back = np.full(total, -1, dtype=np.int64)
        back[keep] = np.arange(len(keep))
        return made.take(pa.array(back, mask=back < 0)).cast(kind)

    def apply(*columns: Column | str) -> Column:
        if not columns:
            raise ValueError("the function needs a column")
        return F.arrow_udf(run, returns)(*columns)

    return apply


