"""Runs that resume: folds published one by one under a signature, and digests that tell two runs apart.

A run is a folder in shared storage. Each fold's rows are a partition of ``folds``; a row of the
``manifest`` (signature, fold, rows, keys, digest) follows when they stand, so a fold without one is not
done, whatever files a stopped run left. What is to do is an anti-join of the wanted folds with the
manifest. A folder that holds rows of another signature is refused, as is a fold whose rows do
not have the published digest, the wanted keys, or finite numbers.

Digests are sums and exclusive ors of row hashes: they do not depend on order or partitions, are
pre-aggregated in every task, and never bring a row to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "signature string, fold string, n long, digest string"


def row_digest(df: DataFrame) -> Column:
    """An aggregate over ``df``: number, exclusive or and sum of its rows' hashes, columns in order of their names."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in sorted(df.columns)]
    shown = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]
    h = F.xxhash64(*shown) if shown else F.lit(0).cast("long")
    total = F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string"), total.cast("string"))


def table_digest(df: DataFrame) -> str:
    return df.agg(row_digest(df).alias("d")).first()[0]


def signature(config: dict, inputs: dict[str, DataFrame] | None = None) -> str:
    """SHA-256 of the settings and of the digests of what is read."""
    found = {name: table_digest(df) for name, df in sorted((inputs or {}).items())}
    return hashlib.sha256(json.dumps({"config": config, "inputs": found}, sort_keys=True).encode()).hexdigest()


def not_finite(df: DataFrame) -> Column:
    """Whether a row has a number that is null, NaN or infinite."""
    bad = F.lit(False)
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return bad


class Run:
    """A run in ``folder`` under ``signature``; ``fold`` is the column of the rows that says their fold."""

    def __init__(self, spark: SparkSession, folder: str, signature: str, fold: str = "fold"):
        self.spark, self.folder, self.signature, self.fold = spark, folder, signature, fold
        others = self.manifest(any_signature=True).where(F.col("signature") != signature).limit(1).collect()
        if others:
            raise ValueError(f"{folder} holds a run of another signature: {others[0]['signature']}")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
                return None
            raise

    def manifest(self, any_signature: bool = False) -> DataFrame:
        """(signature, fold, n, digest): a row for each published fold."""
        found = self._read("manifest")
        found = self.spark.createDataFrame([], MANIFEST) if found is None else found
        return found if any_signature else found.where(F.col("signature") == self.signature)

    def rows(self) -> DataFrame | None:
        """The rows of all published folds; None before the first."""
        found = self._read("folds")
        if found is None:
            return None
        done = self.manifest().select(F.col("fold").alias("__fold"))
        return found.join(done, F.col(self.fold).cast("string") == F.col("__fold"), "left_semi")

    def todo(self, wanted: DataFrame) -> DataFrame:
        """The folds of ``wanted`` (a column ``fold``) that are not published."""
        done = self.manifest().select(F.col("fold").alias("__fold"))
        return wanted.select("fold").distinct().join(done, F.col("fold").cast("string") == F.col("__fold"), "left_anti")

    def publish(self, rows: DataFrame) -> None:
        """Writes the folds of ``rows``, and then their lines of the manifest."""
        path = f"{self.folder}/folds"
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.fold).parquet(path)
        asked = rows.select(F.col(self.fold).cast("string").alias("__fold")).distinct()
        stood = self.spark.read.parquet(path).join(asked, F.col(self.fold).cast("string") == F.col("__fold"), "left_semi")
        lines = self.digests(stood).select(F.lit(self.signature).alias("signature"), "fold", "n", "digest")
        lines.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def digests(self, rows: DataFrame) -> DataFrame:
        """(fold, n, digest, finite) of the rows of each fold."""
        plain = rows.drop(self.fold)
        grouped = rows.groupBy(F.col(self.fold).cast("string").alias("fold"))
        return grouped.agg(F.count(F.lit(1)).alias("n"), row_digest(plain).alias("digest"), (F.count_if(not_finite(plain)) == 0).alias("finite"))

    def checked(self, wanted: DataFrame, key: str) -> DataFrame:
        """(fold, published, same_digest, same_keys, finite) of each wanted fold; ``wanted``: (fold, key), what a fold has to hold.

        Keys are compared as sets with a count, so a repeated one shows too."""
        rows, folds = self.rows(), wanted.select(F.col("fold").cast("string").alias("fold")).distinct()
        if rows is None:
            return folds.select("fold", *(F.lit(False).alias(c) for c in ("published", "same_digest", "same_keys", "finite")))
        now = self.digests(rows).select("fold", F.col("n").alias("n_now"), F.col("digest").alias("digest_now"), "finite")
        want = wanted.select(F.col("fold").cast("string").alias("fold"), F.col(key).cast("string").alias("k")).distinct()
        held = rows.groupBy(F.col(self.fold).cast("string").alias("fold"), F.col(key).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("times"))
        both = want.withColumn("w", F.lit(1)).join(held, ["fold", "k"], "full").groupBy("fold")
        keys = both.agg((F.count_if(F.col("w").isNull() | ~F.coalesce(F.col("times") == 1, F.lit(False))) == 0).alias("same_keys"))
        found = folds.join(self.manifest(), "fold", "left").join(now, "fold", "left").join(keys, "fold", "left")
        yes = lambda c: F.coalesce(c, F.lit(False))
        return found.select(
            "fold", F.col("digest").isNotNull().alias("published"), yes(F.col("digest") == F.col("digest_now")).alias("same_digest"),
            yes(F.col("same_keys")).alias("same_keys"), yes(F.col("finite")).alias("finite"),
        )

    def require(self, wanted: DataFrame, key: str) -> None:
        """Refuses a run with a published fold that isn't what it was, or not what it should be."""
        bad = self.checked(wanted, key).where("published and not (same_digest and same_keys and finite)").limit(1).collect()
        if bad:
            raise ValueError(f"fold {bad[0]['fold']} of {self.folder} is not valid: {bad[0].asDict()}")

    def complete(self, wanted: DataFrame, key: str) -> bool:
        """The weaker question: whether every wanted fold is published, with the number of keys it should have, and finite."""
        bad = self.checked(wanted, key).where("not (published and same_keys and finite)")
        return not bad.limit(1).count()


def resume(
    run: Run, wanted: DataFrame, key: str, compute: Callable[[list], DataFrame], most: int | None = None, at_once: int = 1
) -> DataFrame | None:
    """Computes and publishes the folds of ``wanted`` (fold, key) that ``run`` lacks, ``at_once`` together, and gives all rows.

    ``compute`` takes a list of folds and gives their rows with the fold's column; ``most`` stops after so many new
    folds. The list of folds is a dimension: one value a fold comes to the driver, which calls for each in turn.
    """
    run.require(wanted, key)
    todo = sorted(r[0] for r in run.todo(wanted).collect())
    todo = todo if most is None else todo[:most]
    for at in range(0, len(todo), at_once):
        run.publish(compute(todo[at : at + at_once]))
    run.require(wanted, key)
    return run.rows()
