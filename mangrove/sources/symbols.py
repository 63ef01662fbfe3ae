"""Sources and sinks of symbols and stores."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from decimal import Decimal
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.symbols import PREFIX
from ..operators import nodes as N

#: Lines of symbol listings: address, type letter, name; or a name alone.
_LINE = re.compile(r"^\s*(?:([0-9A-Fa-f]+)\s+)?(?:[A-Za-z?]\s+)?(\S.*?)\s*$")


def read_listing(spark: SparkSession, path: str, image: str | None = None) -> DataFrame:
    """symbol, image, offset from text listings, by Spark's own text reader and functions."""
    line = r"^\s*(?:([0-9A-Fa-f]+)\s+)?(?:[A-Za-z?]\s+)?(\S.*?)\s*$"
    text = spark.read.text(path)
    offset = F.regexp_extract("value", line, 1)
    rows = text.select(F.regexp_extract("value", line, 2).alias("symbol"), F.lit(image).cast("string").alias("image"), F.when(offset != "", F.conv(offset, 16, 10).cast("decimal(20,0)")).alias("offset"))
    return rows.where(F.col("symbol").rlike(PREFIX) | F.col("symbol").startswith("_T"))


def write_store(demangled: DataFrame, path: str) -> None:
    """Two Parquet tables: `nodes` (numbered distinct subtrees) and `roots`."""
    N.number(N.intern(demangled)).write.mode("overwrite").parquet(f"{path}/nodes")
    N.roots(demangled).write.mode("overwrite").parquet(f"{path}/roots")


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/roots")


def merge_stores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes of two stores as one, numbered anew."""
    keep = ["node_hash", "kind", "text", "idx", "kids", "height", "payload_kind"]
    return N.number(a.select(*keep).unionByName(b.select(*keep)).dropDuplicates(["node_hash"]))


class _Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SymbolListing(DataSource):
    """spark.read.format("symbol_listing").option("paths", "a,b"): one partition a listing. Paths are URIs of a store that all executors see, or files that each of them has; bytes that are no UTF-8 are replaced."""

    @classmethod
    def name(cls) -> str:
        return "symbol_listing"

    def schema(self) -> str:
        return "symbol string, image string, offset decimal(20,0)"

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader(self.options["paths"].split(","))


class _ListingReader(DataSourceReader):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[_Files]:
        return [_Files(p) for p in self.paths]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        where = partition.path if "://" in partition.path else Path(partition.path).absolute().as_uri()
        fs, path = pafs.FileSystem.from_uri(where)
        with fs.open_input_stream(path) as stream:
            for line in io.TextIOWrapper(stream, encoding="utf-8", errors="replace"):
                m = _LINE.match(line)
                if m and (re.match(PREFIX, m[2]) or m[2].startswith("_T")):
                    rows.append((m[2], partition.path, Decimal(int(m[1], 16)) if m[1] and len(m[1].lstrip("0")) <= 16 else None))
                if len(rows) == 10_000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.decimal128(20, 0))], names=["symbol", "image", "offset"])
