"""``python -m corpusloom``: train embeddings of a text corpus and write them as text.

Runs in the session that spark-submit gives, or in a local one.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession

from corpusloom.config import EmbeddingConfig
from corpusloom.plans.training import train
from corpusloom.sources import corpus, embeddings


def positive(kind: type):
    def parse(text: str):
        value = kind(text)
        if not value > 0:
            raise argparse.ArgumentTypeError(f"{text} is not greater than zero")
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    d = EmbeddingConfig()
    p = argparse.ArgumentParser("corpusloom", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="text file, or parquet table with --text-column")
    p.add_argument("-o", "--output", required=True, help="folder of the result; an earlier result is replaced")
    p.add_argument("--text-column", help="read parquet, and this column of it")
    p.add_argument("--id-column", default="doc_id", help="with --text-column: the integer key that orders the documents")
    p.add_argument("-d", "--dimensions", type=positive(int), default=d.dimensions)
    p.add_argument("--window-size", type=positive(int), default=d.window_size)
    p.add_argument("-e", "--epochs", type=positive(int), default=d.epochs)
    p.add_argument("-l", "--learning-rate", type=positive(float), default=d.learning_rate)
    p.add_argument("--min-learning-rate", type=positive(float), default=d.min_learning_rate)
    p.add_argument("-n", "--negative-samples", type=positive(int), default=d.negative_samples)
    p.add_argument("--min-count", type=positive(int), default=d.min_count)
    p.add_argument("--sample", type=positive(float), default=d.sample, help="share of tokens above which word types may be dropped")
    p.add_argument("--owners", type=positive(int), default=d.owners, help="parts of the vocabulary, trained side by side")
    p.add_argument("--scope", choices=("document", "corpus"), default=d.scope, help="whether windows end with their document")
    p.add_argument("--rounds-per-epoch", type=positive(int), default=d.rounds_per_epoch)
    p.add_argument("--batch", type=positive(int), default=d.batch, help="pairs trained at once; 1 is the exact step")
    p.add_argument("--seed", type=int, default=d.seed)
    p.add_argument("--single-file", action="store_true", help="write one file, through one task")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("corpusloom").getOrCreate()
    if a.text_column:
        docs = spark.read.parquet(a.input).selectExpr(f"`{a.id_column}` AS doc_id", f"`{a.text_column}` AS text")
    else:
        docs = corpus.read_text(spark, a.input)
    own = EmbeddingConfig.__dataclass_fields__
    config = EmbeddingConfig(**{k: v for k, v in vars(a).items() if k in own})

    def progress(epoch: int, round_: int, pairs: int, seconds: float) -> None:
        logging.info("epoch %d, round %d: %.0f pairs/s, %.1f s, %.0f %% done", epoch, round_, pairs / max(seconds, 1e-9), seconds, 100 * (epoch * config.rounds_per_epoch + round_ + 1) / (config.epochs * config.rounds_per_epoch))

    embeddings.write_text(train(docs, config, progress), a.output, single_file=a.single_file)


if __name__ == "__main__":
    main()
