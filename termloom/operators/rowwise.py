"""Python over the rows of a table: rows dealt to all cores, functions called once for each text of a batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

#: Partitions for each core, so that a slow one does not keep the others waiting, and the least where few cores are registered yet.
TASKS_A_CORE, LEAST = 3, 24


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly in turn, before a step that costs much more than to move them.

    A file is read by as many tasks as it has row groups, often one for a million
    rows. A stream keeps its partitions, which its source deals out.
    """
    if df.isStreaming:
        return df
    return df.repartition(max(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, LEAST))


def per_text(emit: Callable[[str], list], returns: str):
    """A column function of a text: ``emit`` of it, called once for each distinct text of an Arrow batch; null stays null."""
    kind = to_arrow_type(_parse_datatype_string(returns))

    def run(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        return pa.array([emit(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)
