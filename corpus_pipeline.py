"""A training-data pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's documents. All but the last return the columns of
``documents``:

1. toxicity: documents that the classifier chain takes for toxic go;
2. line dedup: later occurrences of repeated three-line windows, and of whole shorter texts, are cut
   out of the texts;
3. n-gram join: of rows linked by word shingles the one of the smallest id stays (then of the smallest
   hash of its text);
4. mixing: rows come out in the order of the Pfair schedule, file by file;
5. packing: sequences are filled from neighbours in that order.

Defined cases: those of the operators; documents of a null id or without words are in no
group and stay, each row of them; rows of equal id and text with words are one row after stage 3,
and rows of one id with different texts go or stay each by its own links; further columns stay as
they are, whatever their names; an empty table passes through.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.common import every, fresh, shared_folder, small, table
from scoreloom.llm.line_dedup import dedup_lines
from scoreloom.llm.mixing import mix_sources
from scoreloom.llm.ngram_join import first_of_each_class
from scoreloom.llm.packing import pack_documents
from scoreloom.llm.queries import tokenizer_path
from scoreloom.llm.toxicity import score_toxicity

#: Mixing and packing are not for SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh(docs, "__toxicity_")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), keep=True, prefix=own)
    return scored.where(F.col(f"{own}toxic") == 0).select(*every(docs))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = fresh(docs, "__lines_")
    found = dedup_lines(docs, short=True, prefix=own)
    if "n_chars" in docs.columns:
        counted = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(F.col(f"{own}n_removed") > 0, counted).otherwise(F.col("n_chars")))
    return found.select(*every(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return first_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, prefix=fresh(docs, "__mix_")).select(*every(docs))


def file_order(docs: DataFrame) -> tuple[DataFrame, Column | None]:
    """``docs`` with each row's place (from 0 to below 1) in its files' order, if it is read from files."""
    own = fresh(docs, "__file_")
    name, row, start = (f"{own}{x}" for x in ("name", "row", "start"))
    try:
        rows = docs.select(*every(docs), F.col("_metadata.file_name").alias(name), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        return docs, None
    sizes = sorted(tuple(r) for r in rows.groupBy(name).agg(F.count("*")).collect())  # one for each file
    starts, at = [], 0
    for file, n in sizes:
        starts.append((file, at))
        at += n
    if not at:
        return docs, None
    known = docs.sparkSession.createDataFrame(starts, f"{name} string, {start} long")
    return rows.join(small(known, len(starts), 200), name), (F.col(start) + F.col(row)) / F.lit(float(at))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ordered, place = file_order(docs)
    return pack_documents(ordered, tokenizer_path(), place=place)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's output written to the shared checkpoint folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
