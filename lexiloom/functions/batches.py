"""Python functions of words over whole Arrow batches: each distinct word of a batch once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _mapped(values: pa.Array, f: Callable[[str], str] | Callable[[list[str]], list[str]], many: bool) -> pa.Array:
    coded = values.cast(pa.string()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = pa.array(f(words) if many else [None if x is None else f(x) for x in words], pa.string())
    return found.take(coded.indices)


def on_terms(terms: Column, f: Callable, many: bool = False) -> Column:
    """f of a string column. many: f maps a list of distinct words at once."""

    @F.arrow_udf("string")
    def mapped(values: pa.Array) -> pa.Array:
        return _mapped(values, f, many)

    return mapped(terms)


def on_tokens(tokens: Column, f: Callable, many: bool = False) -> Column:
    """f of every element of an array column, without exploding or shuffling it. many: f maps a list of distinct words at once."""

    @F.arrow_udf("array<string>")
    def mapped(values: pa.Array) -> pa.Array:
        sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
        return pa.ListArray.from_arrays(offsets, _mapped(values.flatten(), f, many))

    return mapped(tokens)
