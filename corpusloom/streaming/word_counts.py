"""Word counts kept up to date while text arrives."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import tokenise
from corpusloom.storage import is_file, new_path


def counting(docs: DataFrame) -> DataFrame:
    """word, cnt of a stream of texts; the state has a row a word."""
    return docs.select(F.explode(tokenise(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def keep_counts(docs: DataFrame, folder: str) -> StreamingQuery:
    """Read all there is of a stream and keep the latest counts as a table in ``folder``."""

    def store(counts: DataFrame, _: int) -> None:
        counts.write.mode("overwrite").parquet(f"{folder}/counts")

    out = counting(docs).writeStream.outputMode("complete").foreachBatch(store)
    return out.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def stream_counts(spark: SparkSession, path: str, schema: str = "doc_id long, text string") -> DataFrame:
    """Counts of the parquet files in a folder, or of one file, read as a stream. Streams read folders: one file is picked in its own by its name."""
    folder, source = new_path(spark, "stream"), spark.readStream.schema(schema)
    if is_file(spark, path):
        parent, _, name = path.rpartition("/")
        path, source = parent, source.option("pathGlobFilter", re.sub(r"([\[\]{}*?\\])", r"\\\1", name))
    keep_counts(source.parquet(path), folder).awaitTermination()
    return spark.read.schema("word string, cnt long").parquet(f"{folder}/counts")
