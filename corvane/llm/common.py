"""Shared ground for the training-data operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word definition; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
#: Texts handed to Python code at once; bounds what a worker holds beside its Arrow batch.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the one that the context was given.

    Where neither is set, local sessions (tests) get a temporary folder; on a cluster that would be the driver's own, so it is an error.
    """
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
        where = context.getCheckpointDir()
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """df as a Parquet table in the shared folder: a cut of the lineage that survives lost executors. options: the writer's."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs inside gets Arrow batches of n rows at most: for rows that are large by themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def texts_of(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, list]]:
    """(offset, texts) slices of a string column; null stays None."""
    for at in range(0, batch.num_rows, SLICE):
        yield at, batch.column(column).slice(at, SLICE).to_pylist()


_held: dict = {}


def held(key: str, make: Callable):
    """What make() gives, kept by the worker for its next tasks. A worker keeps one such thing: a call with another key lets it go."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


#: What else workers remember: functions that let it go.
FORGET: list[Callable] = []


def nothing_held() -> None:
    """Called by tasks that keep nothing: the worker's memory is theirs, and what earlier tasks had freed goes back to the system."""
    _held.clear()
    for forget in FORGET:
        forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library can
        pass


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cycle collector, which would walk through all that a worker remembers again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def per_text(docs: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[], Callable[[list], list]], keeps: bool = False) -> DataFrame:
    """A row per input row: the id (any type, null too) and what the function that make() returns gives for its text.

    keeps: make() uses held(), for the worker's next tasks.

    make() runs once in each task, so that models and caches are set up on the executor; the
    function gets a list of texts (None for null) and returns a list of tuples in schema's order.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    names = docs.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructField, StructType

    out = StructType([StructField("__id", slim.schema["__id"].dataType), *names.fields])
    kinds = [to_arrow_type(f.dataType) for f in names.fields]
    fields = ["__id", *names.fieldNames()]

    def run(batches):
        if not keeps:
            nothing_held()
        work = make()
        for batch in batches:
            for at, texts in texts_of(batch):
                with uncollected():
                    columns = list(zip(*work(texts), strict=True))
                arrays = [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *arrays], fields)

    return slim.mapInArrow(run, out).withColumnRenamed("__id", id_col)


def keep_rows(docs: DataFrame, text_col: str, make: Callable[[], Callable[[list], list]]) -> DataFrame:
    """The rows, with all their columns, whose text the function that make() returns finds True for; no row moves."""
    at = docs.columns.index(text_col)

    def run(batches):
        nothing_held()
        work = make()
        for batch in batches:
            for start, texts in texts_of(batch, at):
                yield batch.slice(start, len(texts)).filter(pa.array(work(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
