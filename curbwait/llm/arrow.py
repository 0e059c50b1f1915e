"""Arrow batches in and out of tasks."""

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def bounded(spark: SparkSession) -> None:
    """Have Spark send workers some 4 MB at a time, unless the session has a bound of its
    own. A batch is up to 10,000 rows otherwise, whatever their texts' length, and is held
    by the executor on its way out and back and by the worker."""
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)


def fresh(frame: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Kept:
    """What ``make`` returns, kept by a worker from task to task, until one of ``released``
    makes no use of it."""

    all: list["Kept"] = []

    def __init__(self, make: Callable):
        self._held, self._used = functools.cache(make), False
        Kept.all.append(self)
        functools.update_wrapper(self, make)

    def __call__(self, *args):
        self._used = True
        return self._held(*args)

    def __reduce__(self) -> str:
        return self.__qualname__  # the worker's own, by name

    def task_over(self) -> None:
        if not self._used:
            self._held.cache_clear()
        self._used = False


def _give_back() -> None:
    for kept in Kept.all:
        kept.task_over()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # in glibc
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives its worker's free memory back when its
    task is done: Spark takes its workers in turn and keeps all of them, and what they
    hold counts beside the executor's own."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def appended(
    frame: DataFrame,
    fields: list[T.StructField],
    find: Callable[[pa.RecordBatch], list[pa.Array]],
    keep: list[str] | None = None,
) -> DataFrame:
    """The frame's columns, or those in ``keep``, and what ``find`` makes of each
    batch: arrays for ``fields``, as long as the batch."""
    kept = [f for f in frame.schema.fields if keep is None or f.name in keep]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]
        for batch in batches:
            at = [batch.schema.get_field_index(n) for n in names]
            new = [c if c.type == f.type else c.cast(f.type) for c, f in zip(find(batch), made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in at), *new],
                schema=pa.schema([*(batch.schema.field(k) for k in at), *made]),
            )
            del new
            pa.default_memory_pool().release_unused()  # workers live on after the stage

    return frame.mapInArrow(released(run), schema)
