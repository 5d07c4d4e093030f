"""Queries on what a run reads and makes: table contracts, file digests, score links and determinism."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.functions import columns as C
from scoreloom.functions.storage import cut, shared_folder
from scoreloom.operators import basis as B
from scoreloom.operators import contracts as K
from scoreloom.operators import metrics
from scoreloom.plans import oracle as O
from scoreloom.plans.catalog import query
from scoreloom.sources import files
from scoreloom.sources import tables as S

_REF = K.Reference
CONTRACTS = [
    K.Contract("region", ("r_regionkey",), ("r_name",)),
    K.Contract("nation", ("n_nationkey",), ("n_name",), references=(_REF(("n_regionkey",), "region", ("r_regionkey",)),)),
    K.Contract("supplier", ("s_suppkey",), ("s_nationkey",), references=(_REF(("s_nationkey",), "nation", ("n_nationkey",)),)),
    K.Contract("customer", ("c_custkey",), references=(_REF(("c_nationkey",), "nation", ("n_nationkey",)),)),
    K.Contract("part", ("p_partkey",), ("p_retailprice",)),
    K.Contract("orders", ("o_orderkey",), references=(_REF(("o_custkey",), "customer", ("c_custkey",)),)),
    K.Contract(
        "lineitem", ("l_orderkey", "l_linenumber"), ("l_extendedprice", "l_returnflag"), 100,
        (_REF(("l_orderkey",), "orders", ("o_orderkey",)), _REF(("l_suppkey",), "supplier", ("s_suppkey",)), _REF(("l_partkey",), "part", ("p_partkey",))),
    ),
    K.Contract("events", ("event_id",), ("user_id", "value")),
    K.Contract("documents", ("doc_id",), ("text", "source")),
    K.Contract("labels", ("doc_id",), ("quality", "toxic"), references=(_REF(("doc_id",), "documents", ("doc_id",)),)),
    K.Contract("embeddings", ("vec_id",), ("embedding",)),
    K.Contract("pages", ("page_id",), ("html",)),
    K.Contract("benchmark", ("item_id",), ("text",)),
    K.Contract("conversations", ("conv_id", "turn"), ("role", "text")),
]


@query(K.as_sql(CONTRACTS))
def table_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence, rows, keys, filled columns and references of all tables."""
    return K.evaluate(spark, lambda name: S.table(spark, sf_dir, name), CONTRACTS)


@query()
def input_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each table: its files, their bytes, one digest, and whether the files are those of the audit that the run began with."""
    one = lambda c: files.file_digests(spark, f"{sf_dir}/{c.table}.parquet").withColumn("table_name", F.lit(c.table))
    read = lambda: files.union_of([one(c) for c in CONTRACTS])
    audit = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    read().write.parquet(audit)
    checked = files.compared(read(), spark.read.parquet(audit), "table_name", "file")
    return checked.groupBy("table_name").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"),
        F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), ","), 256).alias("digest"), F.bool_and(F.col("status") == "SAME").alias("same"),
    )


@query(f"WITH {O.POINTS} SELECT series_id, count(*) AS n_points, TRUE AS linked FROM points GROUP BY series_id")
def score_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored score arrays against the hashes of the sweep's manifest: a changed score breaks its link."""
    points = S.points(spark, sf_dir).withColumn("train_cut", F.lit(100))
    made = cut(metrics.sweep(points, "next_point"))
    folder = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    made.select("series_id", "scores").write.parquet(f"{folder}/scores")
    made.select("series_id", "score_hash").write.parquet(f"{folder}/manifest")
    return metrics.linked(spark.read.parquet(f"{folder}/scores"), spark.read.parquet(f"{folder}/manifest")).select("series_id", "n_points", "linked")


_SCORERS = ", ".join(f"('{d}')" for d in ("local_variance", "next_point", "robust_z"))


@query(f"""WITH {O.POINTS} SELECT detector, count(DISTINCT series_id) AS screened, count(DISTINCT series_id) AS passed, 'PASS' AS status
FROM points, (VALUES {_SCORERS}) d(detector) GROUP BY detector""")
def reproducibility_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scorer run twice on every series, its points dealt to tasks in different ways; their score hashes have to agree."""
    points = S.points(spark, sf_dir).withColumn("train_cut", F.lit(100))
    out = files.union_of([metrics.rerun(points, d) for d in ("robust_z", "local_variance", "next_point")])
    counted = out.groupBy("detector").agg(F.count("*").alias("screened"), F.count_if("same").alias("passed"))
    return counted.withColumn("status", F.when(F.col("passed") == F.col("screened"), "PASS").otherwise("FAIL"))


@query(f"WITH {O.POINTS} SELECT series_id, source_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, 31 AS curves FROM points GROUP BY ALL")
def record_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basis, score and labels joined point by point; a curve or score outside [0, 1], a missing one or another set of names is an error."""
    rows = B.ranked_basis(S.points(spark, sf_dir)).select("series_id", "t", "basis")
    scores = S.points(spark, sf_dir).select("series_id", "source_id", "t", "y", C.rank01("qty", "series_id").alias("score"))
    joined = scores.join(rows, ["series_id", "t"], "left")
    inside = F.col("basis").isNotNull() & (F.size("basis") == len(B.NAMES)) & F.forall("basis", lambda v: v.between(0, 1)) & F.col("score").between(0, 1)
    fault = F.raise_error(F.concat(F.lit("not a valid record: series "), F.col("series_id").cast("string"))).cast("boolean")
    joined = joined.where(F.when(F.coalesce(inside, F.lit(False)), F.lit(True)).otherwise(fault))
    grouped = joined.groupBy("series_id", "source_id")
    return grouped.agg(F.count("*").alias("n"), F.sum("y").alias("positives"), F.max(F.size("basis")).alias("curves"))
