"""Arrow plumbing shared by the operators that run Python on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.session import ship_package

#: Kernels see batches of about so many bytes.
BATCH_BYTES = 2 << 20
#: Texts are handed to native libraries in slices of about so many bytes, whatever a batch's size.
SLICE_BYTES = 1 << 19


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_map(
    df: DataFrame,
    carry: list[str],
    inputs: list[Column],
    outputs: list[T.StructField],
    kernel: Callable[..., list],
) -> DataFrame:
    """``carry`` columns as they are, then ``outputs`` that ``kernel`` makes from the ``inputs`` of each batch.

    A carried column with the name of an output gives way to it. ``kernel`` gets one Arrow array per input and
    returns one Arrow array (or list) per output, of the same length; rows are neither added nor dropped.
    """
    ship_package(df.sparkSession)
    names = {f.name for f in outputs}
    carry = [c for c in carry if c not in names]
    n = len(carry)
    kept = [df.schema[c] for c in carry]
    frame = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(carry)], *[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(kept)] + [T.StructField(f"y{i}", f.dataType) for i, f in enumerate(outputs)])
    labels = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            made = kernel(*[batch.column(i) for i in range(n, batch.num_columns)])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=labels)
        pa.default_memory_pool().release_unused()  # workers live on

    out = frame.mapInArrow(run, schema)
    return out.toDF(*carry, *[f.name for f in outputs])


def arrow_column(inputs: list[Column], kind: T.DataType, kernel: Callable[..., pa.Array]) -> Column:
    """A column that ``kernel`` makes from the ``inputs`` of each batch; all other columns stay in the JVM.

    ``kernel`` gets one Arrow array per input and returns one Arrow array of the same length.
    """

    ship_package(SparkSession.active())
    n = len(inputs)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            columns = [batch] if n == 1 else list(batch)
            whole = pa.RecordBatch.from_arrays(columns, names=[f"x{i}" for i in range(len(columns))])
            made = [kernel(*part.columns) for part in small_batches([whole])]
            yield pa.concat_arrays(made) if made else pa.array([], to_arrow_type(kind))
        pa.default_memory_pool().release_unused()  # workers live on

    if len(inputs) == 1:

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return run(batches)

        return F.arrow_udf(one, kind)(*inputs)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(several, kind)(*inputs)


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes, so that Python objects made from a batch stay few."""
    for batch in batches:
        rows = max(1, batch.num_rows * limit // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, at least one text each."""
    part: list[str] = []
    held = 0
    for text in texts:
        part.append(text)
        held += len(text)
        if held >= limit:
            yield part
            part, held = [], 0
    if part:
        yield part
