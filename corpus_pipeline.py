"""The corpus pipeline: five stages over ``documents``, each written and read again.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame.  The
first four return the columns of ``documents``; the last one the pieces of the
texts that are left.

1. toxicity: documents that the random field judges toxic go.
2. line_dedup: lines of templates that recur in three documents or more stay in
   the first of these only; ``n_chars`` follows the text.  Two documents do not
   suffice for long templates here, as they do by default: what is left of a pair's
   second copy would be no near copy any more, and stay (on sf0.1 the next stage
   then removes 41 % of the raw near copies instead of 95 %).
3. near_dedup: one document of each class of near copies stays.
4. mixing: documents are taken whole, as often as the mix to target weights asks
   (never, once or twice).
5. pieces: token counts and digests of ids and decoded texts, a row for each row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm import linededup, mixing, neardup, pieces, toxicity
from gridsmith.llm.arrowmap import table
from gridsmith.llm.scratch import Scratch


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.drop_lines(docs, long_docs=linededup.LEAST_DOCS)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixture(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing_to_weights),
    ("pieces", encoding),
]

#: The learned, aligned and encoded stages have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each stage's result is written as Parquet and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    before = None
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = scratch.keep(docs)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
