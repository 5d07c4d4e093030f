"""File sources and sinks: CSV, JSON, JSON lines, NPY and NPZ, Parquet, and text tables of small results."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema is given, so nothing is read twice."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    return spark.read.json(path, schema=schema, multiLine=not lines)


def read_source_map(spark: SparkSession, path: str, n_series: int | None = None) -> DataFrame:
    """A JSON object {"series_to_source": {...}} as rows, with its own checks."""
    found = spark.read.json(path, schema="series_to_source map<string,string>, n_series long, unresolved_series array<string>", multiLine=True)
    bad = F.size(F.coalesce("unresolved_series", F.array().cast("array<string>"))) > 0
    wrong = F.size("series_to_source") != F.coalesce(F.lit(n_series), F.col("n_series").cast("int"), F.size("series_to_source"))
    found = found.where(F.when(bad | wrong, F.raise_error(F.lit("unresolved or missing series"))).otherwise(F.lit(True)))
    return found.select(F.explode("series_to_source").alias("series_id", "source_id"))


def read_series_csv(spark: SparkSession, path: str, value: str, label: str = "Label") -> DataFrame:
    """Raw series, one CSV each: (file, t, x, y); rows with a missing value go before ``t`` is assigned."""
    rows = spark.read.csv(path, header=True, inferSchema=False).select(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("m"),
        F.col(value).cast("double").alias("x"),
        F.col(label).cast("double").cast("int").alias("y"),
    )
    order = "row_number() over (partition by file order by b, m) - 1"
    return rows.na.drop(subset=["x", "y"]).select("file", F.expr(order).alias("t"), "x", "y")


def read_arrays(spark: SparkSession, path: str, glob: str = "*.np[yz]") -> DataFrame:
    """NPY and NPZ files as rows (file, name, shape, values); the files are read where the rows are made."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for where, content in zip(frame["path"], frame["content"]):
                got = np.load(io.BytesIO(content), allow_pickle=False)
                named = {"": got} if isinstance(got, np.ndarray) else {k: got[k] for k in got.files}
                for name, a in named.items():
                    if a.dtype.kind in "biuf":
                        yield pd.DataFrame({"file": [where.rsplit("/", 1)[-1]], "name": [name], "shape": [list(a.shape)], "values": [a.astype(float).ravel()]})

    return files.mapInPandas(run, "file string, name string, shape array<long>, values array<double>")


@F.pandas_udf(T.BinaryType())
def npy_bytes(values: pd.Series) -> pd.Series:
    """An array as the bytes of an NPY file of float32."""

    def dumped(v) -> bytes:
        out = io.BytesIO()
        np.save(out, np.asarray(v, np.float32), allow_pickle=False)
        return out.getvalue()

    return values.map(dumped)


def write_table(df: DataFrame, path: str, *partition: str, append: bool = False) -> None:
    """Parquet; Spark's committer shows a file only when its task has ended well."""
    df.write.mode("append" if append else "overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _cells(df: DataFrame, places: int, most: int) -> tuple[list[str], list[list[str]]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    text = lambda v: "" if v is None else f"{v:.{places}f}" if isinstance(v, float) else str(v)
    return df.columns, [[text(v) for v in r] for r in rows]


def markdown(df: DataFrame, places: int = 6, most: int = 1000) -> str:
    """A small result as a Markdown table."""
    head, rows = _cells(df, places, most)
    return "\n".join("| " + " | ".join(r) + " |" for r in [head, ["---"] * len(head), *rows])


def latex(df: DataFrame, places: int = 4, most: int = 1000) -> str:
    """A small result as the rows of a TeX table."""
    head, rows = _cells(df, places, most)
    return "\n".join(" & ".join(x.replace("_", "-") for x in r) + r" \\" for r in [head, *rows])


def _hashed(path: str, piece: int = 1 << 23) -> str:
    """SHA-256 of a file of any size and place that Arrow knows, read piece by piece."""
    scheme, _, rest = path.partition(":")
    system, where = (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    digest = hashlib.sha256()
    with system.open_input_stream(where, compression=None) as stream:
        while data := stream.read(piece):
            digest.update(data)
    return digest.hexdigest()


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file below ``path``, hashed piece by piece where it is read; not those of no bytes, which Spark leaves out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, n in zip(frame["path"], frame["length"]):
                yield pd.DataFrame({"file": [p.rsplit("/", 1)[-1]], "bytes": [n], "sha256": [_hashed(p)]})

    return found.mapInPandas(run, "file string, bytes long, sha256 string")


def compared(found: DataFrame, audit: DataFrame, *keys: str) -> DataFrame:
    """(*keys, bytes, sha256, status) of digests against an audit: SAME, CHANGED, MISSING (in the audit alone) or UNKNOWN (not in the audit)."""
    known = audit.select(*keys, F.col("sha256").alias("__want"))
    status = (
        F.when(F.col("sha256").isNull(), "MISSING").when(F.col("__want").isNull(), "UNKNOWN").when(F.col("sha256") == F.col("__want"), "SAME").otherwise("CHANGED")
    )
    return found.join(known, list(keys), "full").select(*keys, "bytes", "sha256", status.alias("status"))


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
