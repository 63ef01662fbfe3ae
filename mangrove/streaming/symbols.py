"""Symbols as streams: the column functions are stateless and run as they are; interning keeps the set of known subtrees in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import symbols as S
from ..operators import nodes as N


def printed_stream(symbols: DataFrame, options: str = "default") -> DataFrame:
    """symbol and text of a stream of symbols; rows that are no symbols stay on the JVM side."""
    return symbols.where(S.is_symbol(F.col("symbol"))).withColumn("printed", S.print_symbol(F.col("symbol"), options))


def _modules(symbols: DataFrame, late: str) -> DataFrame:
    parsed = symbols.withWatermark("ts", late).withColumn("t", S.texts_of(F.col("symbol"), "module"))
    return parsed.select("ts", F.get("t", F.lit(0)).alias("module"))


def module_counts(symbols: DataFrame, every: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Symbols per module and window of `ts`, tumbling, or sliding by `slide`; rows later than `late` are left out."""
    return _modules(symbols, late).groupBy(F.window("ts", every, slide), "module").agg(F.count("*").alias("n"))


def module_sessions(symbols: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Symbols per module and session, which ends where a module is silent for `gap`."""
    return _modules(symbols, late).groupBy(F.session_window("ts", gap), "module").agg(F.count("*").alias("n"))


def intern_stream(symbols: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends subtrees not seen before to the Parquet table `store`, one folder a batch. A batch that runs again overwrites its own folder, so it counts once."""

    def add(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = N.intern(N.parse(batch))
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            known = spark.read.option("basePath", store).parquet(store)
            if "batch" in known.columns:
                new = new.join(known.where(F.col("batch") != number).select("node_hash"), "node_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return symbols.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
