"""Shards of arrays as a Spark data source: files of named arrays of one length, `<key>.npz` in a folder.

    spark.dataSource.register(Shards)
    spark.read.format("shards").option("columns", "key,mz").load(folder)
    df.write.format("shards").option("key", "key").mode("append").save(folder)

Reading: a partition for each shard, and of a file only the arrays that are asked for. Writing: a task
writes the rows of each of its keys to one file under a name that readers pass over; the driver
renames all of them once every task is done, and removes them if one fails, so that a table appears
as a whole. Arrays of a column have one shape in a shard; a key belongs to one task (repartition by it).
The folder must be one that the driver and all executors see as a path.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

_TYPES = {"b1": BooleanType(), "i1": ShortType(), "u1": ShortType(), "i2": ShortType(), "u2": IntegerType(), "i4": IntegerType(), "u4": LongType(), "i8": LongType(), "f4": FloatType(), "f8": DoubleType(), "f2": FloatType()}
#: Rows that a reader hands on at once.
ROWS = 4096


def shard_path(folder: str, key) -> str:
    """A shard's file; a key's characters that no file name may hold are quoted."""
    return os.path.join(folder, f"{quote(str(key), safe='')}.npz")


def complete(folder: str) -> list[str]:
    """Keys, as texts, of the shards that were written to their end, in order."""
    if not os.path.isdir(folder):
        return []
    return sorted(unquote(n[:-4]) for n in os.listdir(folder) if n.endswith(".npz") and not n.startswith((".", "_")))


def _local(options: dict) -> str:
    path = options.get("path", "")
    if re.match(r"\w+://", path) and not path.startswith("file://"):
        raise ValueError(f"shards are read as files of a mounted folder, not of {path}")
    return re.sub(r"^file:(//)?(?=/)", "", path)


def _members(path: str) -> dict[str, tuple[str, tuple[int, ...]]]:
    """dtype and shape of each array of a file, from the headers alone."""
    import zipfile

    import numpy as np

    out = {}
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            with z.open(name) as f:
                version = np.lib.format.read_magic(f)
                shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            out[name.removesuffix(".npy")] = (kind.str, shape)
    return out


def _type_of(kind: str, dimensions: int) -> DataType:
    spark = StringType() if kind[1] in "SU" else _TYPES.get(kind[1:])
    if spark is None:
        raise ValueError(f"arrays of {kind} have no column type")
    for _ in range(dimensions - 1):
        spark = ArrayType(spark)
    return spark


class Shards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def schema(self) -> StructType:
        folder = _local(self.options)
        keys = complete(folder)
        if not keys:
            raise ValueError(f"no shards in {folder}")
        known = _members(shard_path(folder, keys[0]))
        asked = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()] or list(known)
        if missing := [c for c in asked if c not in known]:
            raise ValueError(f"the shards have no {', '.join(missing)}")
        return StructType([StructField(c, _type_of(known[c][0], len(known[c][1]))) for c in asked])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_local(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if "key" not in self.options:
            raise ValueError("say which column is the key")
        return _Writer(_local(self.options), schema, self.options["key"], overwrite)


@dataclass
class _Shard(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.schema = folder, schema

    def partitions(self) -> list[_Shard]:
        return [_Shard(shard_path(self.folder, k)) for k in complete(self.folder)]

    def read(self, partition: _Shard) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        names = self.schema.names
        with np.load(partition.path, allow_pickle=False) as held:
            arrays = [held[n] for n in names]
        arrays = [np.char.decode(a, "utf-8") if a.dtype.kind == "S" else a for a in arrays]
        if len({len(a) for a in arrays}) > 1:
            raise ValueError(f"{partition.path} has arrays of several lengths")
        kinds = [to_arrow_type(f.dataType) for f in self.schema]
        for at in range(0, len(arrays[0]) if arrays else 0, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(list(a[at : at + ROWS]) if a.ndim == 1 else a[at : at + ROWS].tolist(), k) for a, k in zip(arrays, kinds, strict=True)], names)


@dataclass
class _Written(WriterCommitMessage):
    #: (file as it is, file as it will be)
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, key: str, overwrite: bool):
        self.folder, self.schema, self.key, self.overwrite = folder, schema, key, overwrite

    def write(self, iterator) -> _Written:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        os.makedirs(self.folder, exist_ok=True)
        batches = [b for b in iterator if b.num_rows]
        files: list[tuple[str, str]] = []
        if batches:
            table = pa.Table.from_batches(batches)
            for key in pc.unique(table[self.key]).to_pylist():
                if key is None:
                    raise ValueError("a row without a key")
                own = table.filter(pc.equal(table[self.key], pa.scalar(key, table[self.key].type)))
                final = shard_path(self.folder, key)
                part = os.path.join(self.folder, f"_{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    np.savez(f, **{c: self._block(c, own[c].to_pylist()) for c in own.column_names})
                    f.flush()
                    os.fsync(f.fileno())
                files.append((part, final))
        return _Written(files)

    def _block(self, column: str, values: list):
        import numpy as np

        if any(v is None for v in values):
            raise ValueError(f"{column}: arrays of a shard can't hold nulls")
        block = np.array(values)
        if block.dtype == object:
            raise ValueError(f"{column}: arrays of one shard differ in shape")
        depth, kind = 0, self.schema[column].dataType
        while isinstance(kind, ArrayType):
            depth, kind = depth + 1, kind.elementType
        spark = {v: k for k, v in _TYPES.items() if k not in ("i1", "u1", "u2", "u4", "f2")}
        return block.astype(spark[kind]) if kind in spark else block

    def commit(self, messages) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        finals = [f for _, f in files]
        twice = len(set(finals)) < len(finals)
        there = [] if self.overwrite else [f for f in finals if os.path.exists(f)]
        if twice or there:
            self._remove(files)
            raise ValueError("a key was written by two tasks: repartition by it" if twice else f"shards are there already: {', '.join(sorted(there)[:3])}")
        old = set() if not self.overwrite else {shard_path(self.folder, k) for k in complete(self.folder)} - set(finals)
        for part, final in files:
            os.replace(part, final)
        for path in old:
            os.remove(path)

    def abort(self, messages) -> None:
        self._remove([f for m in messages if m is not None for f in m.files])

    @staticmethod
    def _remove(files) -> None:
        for part, _ in files:
            if os.path.exists(part):
                os.remove(part)


def add_missing(df: DataFrame, folder: str, key: str) -> None:
    """Writes the shards of the keys that the folder lacks: a rerun after a failure adds only these."""
    spark = df.sparkSession
    spark.dataSource.register(Shards)
    if held := complete(folder):  # names of files, as the driver lists them to plan a read anyway
        df = df.join(spark.createDataFrame([(k,) for k in held], "__key string"), F.col(key).cast("string") == F.col("__key"), "left_anti")
    df.repartition(key).write.format("shards").option("key", key).mode("append").save(folder)
