"""Python over texts with the ids of their rows left alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cytoloom.scratch import bound_batches

Made = Callable[[list[str | None]], list[tuple]]


def map_texts(docs: DataFrame, make: Callable[[], Made], schema: str) -> DataFrame:
    """doc_id and the columns of ``schema`` for each row that a function makes of a batch of texts.

    ``make`` is called once a task, so what it returns may keep state.  That function's rows begin with the place in the
    batch of the text they stand for.  Ids stay Arrow columns all the way: as a pandas column, longs beside a null turn
    into doubles, which round those above 2**53.
    """
    bound_batches(docs.sparkSession)
    fields = to_arrow_schema(StructType.fromDDL(schema))
    kept = docs.select("doc_id", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            made = each(batch.column("text").to_pylist())
            if made:
                place, *columns = zip(*made, strict=True)
                ids = batch.column("doc_id").take(pa.array(place, pa.int64()))
                arrays = [ids, *(pa.array(c, f.type) for c, f in zip(columns, fields, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *fields.names])

    id_type = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(rows, f"doc_id {id_type}, {schema}")
