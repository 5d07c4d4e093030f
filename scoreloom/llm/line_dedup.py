"""Line dedup [native]: overlapping windows of three lines, found again anywhere in the corpus.

Each run of three consecutive lines of a text is hashed (two 64-bit hashes). The first
occurrence of a window is that of the smallest (id, text hash, position); the lines that
its later occurrences cover are removed, after the covered positions of a document have
been merged into disjoint intervals. A window that overlaps its own first occurrence in
the same text covers only the lines behind that occurrence, so one copy always stays.

Plan: the windows are pre-aggregated before their shuffle, so a window that a third of all
documents hold is one row for each task. Windows that occur once are dropped; the rest are
cut off in a checkpoint, and joining the occurrences with them is a plain equi-join, whose
hot keys adaptive execution splits. Merging is by document. Everything is a DataFrame or
SQL function.

Defined cases: a null text stays null and has no lines; texts of fewer than three lines are
left alone, as ``ORACLE_SQL`` has it, or with ``short`` are one window each; windows of three empty lines count for nothing; rows of equal id and text are
one document, so neither copy is touched for the other; null ids come first; every column
is kept, and ``n_lines`` and ``n_removed`` (with the caller's ``prefix``) replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.llm.common import cut, every, fresh, quoted

LINES = 3

ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), wins AS (
  SELECT doc_id, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS w
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM lines WHERE len(ls) >= 3)
  WHERE ls[i + 1] <> '' OR ls[i + 2] <> '' OR ls[i + 3] <> ''
), firsts AS (
  SELECT w, min(struct_pack(doc_id := doc_id, i := i)) AS f FROM wins GROUP BY w HAVING count(*) > 1
), later AS (
  SELECT wins.doc_id, CASE WHEN f.doc_id = wins.doc_id THEN greatest(wins.i, f.i + 3) ELSE wins.i END AS a, wins.i + 2 AS b
  FROM wins JOIN firsts USING (w) WHERE (wins.doc_id, wins.i) > (f.doc_id, f.i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS p FROM later
), kept AS (
  SELECT l.doc_id, l.p, l.line, g.p IS NOT NULL AS removed
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS p FROM lines) l
  LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.p = l.p
)
SELECT doc_id, CASE WHEN max(t.text) IS NULL THEN 0 ELSE count(*) END AS n_lines,
       count(*) FILTER (removed) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT removed), '') AS text
FROM kept JOIN documents t USING (doc_id) GROUP BY doc_id
"""


def repeated_spans(lines: DataFrame, short: bool = False) -> DataFrame:
    """Disjoint covered intervals (``spans`` of struct<a,b>, ends inclusive) for each (d, h) of ``lines``."""
    windows = lines.where(F.size("lines") >= LINES).select(
        "d",
        "h",
        F.lit(LINES).alias("k"),
        F.posexplode(
            F.expr(
                f"transform(sequence(0, size(lines) - {LINES}), i -> if(lines[i] = '' and lines[i+1] = '' and lines[i+2] = '',"
                " null, struct(xxhash64(lines[i], lines[i+1], lines[i+2]) as a,"
                " xxhash64('second', lines[i+2], lines[i+1], lines[i]) as b)))"
            )
        ).alias("p", "w"),
    )
    if short:
        whole = "struct(xxhash64('short', lines) as a, xxhash64('second', lines) as b)"
        windows = windows.union(
            lines.where(f"size(lines) < {LINES} and array_join(lines, '') <> ''").selectExpr("d", "h", "size(lines) as k", "0 as p", f"{whole} as w")
        )
    windows = windows.where("w is not null").select("d", "h", "p", "k", "w.a", "w.b")
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("d", "h", "p")).alias("f"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1").select("a", "b", "f"))
    later = windows.join(firsts, ["a", "b"]).where("struct(d, h, p) > f")
    later = later.selectExpr(
        "d", "h", "if(f.d = d and f.h = h, greatest(p, f.p + k), p) as s", "p + k - 1 as e"
    )
    by_doc = Window.partitionBy("d", "h").orderBy("s", "e")
    merged = (
        later.withColumn("reach", F.max("e").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("fresh", F.expr("if(reach is null or s > reach + 1, 1, 0)"))
        .withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("d", "h", "island")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    return merged.groupBy("d", "h").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", short: bool = False, prefix: str = "") -> DataFrame:
    """``docs`` with the later occurrences of repeated three-line windows cut out of ``text``; with ``short``, whole shorter texts too.

    ``prefix`` comes before the names n_lines and n_removed, so that a caller can choose names that replace none.
    """
    named = (f"{prefix}n_lines", f"{prefix}n_removed")
    own = fresh(docs, "__")
    d, h, held, cuts = (F.col(f"{own}{x}") for x in ("d", "h", "lines", "spans"))
    whole = F.col(quoted(text))
    keyed = docs.select(
        *every(docs, named),
        F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(-(2**63))).alias(f"{own}d"),
        F.xxhash64(whole).alias(f"{own}h"),
    )
    lines = keyed.where(whole.isNotNull()).select(d.alias("d"), h.alias("h"), F.split(whole, "\n", -1).alias("lines"))
    spans = repeated_spans(lines, short).select(F.col("d").alias(f"{own}d"), F.col("h").alias(f"{own}h"), F.col("spans").alias(f"{own}spans"))
    joined = keyed.join(spans, [f"{own}d", f"{own}h"], "left").withColumn(f"{own}lines", F.split(whole, "\n", -1))
    kept = F.array_join(
        F.flatten(
            F.zip_with(
                F.concat(F.array(F.lit(-1)), F.transform(cuts, lambda x: x["e"])),
                F.concat(F.transform(cuts, lambda x: x["s"]), F.array(F.size(held))),
                lambda e, s: F.slice(held, e + 2, s - e - 1),
            )
        ),
        "\n",
    )
    left_out = {n.lower() for n in named}
    return joined.select(
        *(
            F.when(cuts.isNull(), F.col(quoted(c))).otherwise(kept).alias(c) if c == text else F.col(quoted(c))
            for c in docs.columns
            if c.lower() not in left_out
        ),
        F.when(whole.isNull(), 0).otherwise(F.size(held)).cast("long").alias(named[0]),
        F.coalesce(F.aggregate(cuts, F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1), F.lit(0)).cast("long").alias(named[1]),
    )
