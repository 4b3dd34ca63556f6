"""Adding columns computed by numpy code to a DataFrame, all other columns passed through."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


SLICE_BYTES = 4 << 20


def slices(batch):
    """Consecutive rows of a batch in parts of about SLICE_BYTES, one row at least."""
    rows = max(1, int(batch.num_rows * min(1.0, SLICE_BYTES / max(1, batch.nbytes))))
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def fresh(taken, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``taken`` (names, any case) has."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def add_columns(df: DataFrame, inputs: list[str], compute, fields: str) -> DataFrame:
    """``df`` plus the columns of the DDL ``fields``; a column of the same name is replaced.

    ``compute`` gets the Arrow columns ``inputs`` of some consecutive rows, about
    ``SLICE_BYTES`` of them, and returns one array per field.  Rows keep their
    number and order.
    """
    extra = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema.fields if f.name not in extra.names]
    schema = T.StructType(kept + extra.fields)
    names = schema.names

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                made = compute(*(part.column(part.schema.get_field_index(c)) for c in inputs))
                cols = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays(cols + [x if isinstance(x, pa.Array) else pa.array(x) for x in made],
                                                 names)

    return df.mapInArrow(run, schema)
