"""Queries on scans, filters, joins, set operations, reshaping, scalar functions and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloom.functions import columns as C
from scoreloom.operators.losses import series_counts
from scoreloom.plans import oracle as O
from scoreloom.plans.catalog import query
from scoreloom.plans.evaluation import tidy
from scoreloom.sources import tables as S

NAMES_SQL = """names AS (SELECT s_suppkey AS series_id, format('{:03d}_S{}_id_{}_Kind_tr_{}_1st_{}.csv', s_suppkey, s_nationkey, s_suppkey, s_suppkey * 7 + 100, s_suppkey * 9 + 200) AS file FROM supplier)"""


@query(f"WITH {NAMES_SQL} SELECT row_number() OVER (ORDER BY series_id) - 1 AS position, file FROM names")
def benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered list of series files."""
    order = Window.orderBy("series_id")  # the index itself: one row for each series
    return S.series_names(spark, sf_dir).select((F.row_number().over(order) - 1).cast("long").alias("position"), "file")


@query(f"WITH {NAMES_SQL} SELECT series_id, regexp_extract(file, '^\\d+_([^_]+)_', 1) AS source, split_part(file, '_', 2) AS family FROM names")
def source_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = S.series_names(spark, sf_dir)
    return names.select("series_id", C.source_token(F.col("file")).alias("source"), F.get(F.split("file", "_"), F.lit(1)).alias("family"))


@query(f"""WITH {NAMES_SQL}, g AS (SELECT regexp_extract(file, '^\\d+_([^_]+)_', 1) AS source, file FROM names)
SELECT source, count(*) AS n, string_agg(file, ',' ORDER BY file) AS files FROM g GROUP BY source""")
def source_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = S.series_names(spark, sf_dir).select(C.source_token(F.col("file")).alias("source"), "file")
    return names.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("file")), ",").alias("files"))


@query(f"WITH {NAMES_SQL} SELECT series_id, CAST(string_split(regexp_replace(file, '\\.[^.]*$', ''), '_')[-3] AS BIGINT) AS train_cut FROM names")
def train_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.series_names(spark, sf_dir).select("series_id", C.train_cut(F.col("file")).alias("train_cut"))


@query(f"WITH {O.POINTS} SELECT series_id, count(*) AS n, {O.r('avg(x)')} AS mean FROM points WHERE t < 100 GROUP BY series_id")
def train_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.points(spark, sf_dir).where("t < 100")
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), C.rounded(F.avg("x")).alias("mean"))


@query(f"WITH {O.POINTS} SELECT series_id, count(*) AS n, bool_and(isfinite(x)) AS finite, bool_and(y IN (0, 1)) AS binary_labels, max(t) + 1 = count(*) AS gapless FROM points GROUP BY series_id")
def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a loaded series has to fulfil."""
    return S.points(spark, sf_dir).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("x") < float("inf")).alias("finite"), F.bool_and(F.col("y").isin(0, 1)).alias("binary_labels"),
        (F.max("t") + 1 == F.count(F.lit(1))).alias("gapless"))


@query(f"WITH {O.POINTS} SELECT series_id, t, y, {O.r(O.rank01('disc'))} AS score FROM points")
def score_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.points(spark, sf_dir).select("series_id", "t", "y", C.rounded(C.rank01("disc", "series_id")).alias("score"))


@query("SELECT vec_id, len(embedding) AS basis, 1 AS detector, len(embedding) + 1 AS basis_detector, round(embedding[1]::DOUBLE + label, 5) + 0.0 AS check_sum FROM embeddings")
def condition_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the three conditions: basis, detector, both."""
    rows = S.table(spark, sf_dir, "embeddings").withColumn("score", F.array(F.col("label").cast("float")))
    both = F.concat("embedding", "score")
    return rows.select(
        "vec_id", F.size("embedding").cast("long").alias("basis"), F.size("score").alias("detector"), F.size(both).cast("long").alias("basis_detector"),
        C.rounded(F.get(both, F.lit(0)).cast("double") + F.element_at(both, -1).cast("double"), 5).alias("check_sum"))


@query("SELECT vec_id, round(e1, 5) + 0.0 AS e1, round(e2, 5) + 0.0 AS e2 FROM (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, label FROM embeddings) WHERE label IN (1, 3) AND e1 > 0")
def predicate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = S.table(spark, sf_dir, "embeddings").where("label in (1, 3)").where(e(0) > 0)
    return rows.select("vec_id", C.rounded(e(0), 5).alias("e1"), C.rounded(e(1), 5).alias("e2"))


@query(f"WITH {O.COUNTS} SELECT a.source_id AS fold, count(*) FILTER (b.source_id <> a.source_id) AS train_series, count(*) FILTER (b.source_id = a.source_id) AS test_series, CAST(sum(n) FILTER (b.source_id <> a.source_id) AS BIGINT) AS train_points FROM (SELECT DISTINCT source_id FROM counts) a, counts b GROUP BY a.source_id")
def loso_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each fold's training and test sets, by subtraction."""
    per = series_counts(S.unordered_points(spark, sf_dir)).groupBy("source_id").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    whole = per.agg(F.sum("k").alias("tk"), F.sum("n").alias("tn"))
    return per.crossJoin(F.broadcast(whole)).select(  # one row
        F.col("source_id").alias("fold"), (F.col("tk") - F.col("k")).alias("train_series"), F.col("k").alias("test_series"), (F.col("tn") - F.col("n")).alias("train_points"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND source IN ('src0', 'src1')")
def population_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = S.table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source").where(F.col("source").isin("src0", "src1"))
    return docs.join(good, "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' AND n_chars > 1000 OR lang = 'de' GROUP BY lang")
def query_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").filter("lang = 'en' and n_chars > 1000 or lang = 'de'")
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(S.table(spark, sf_dir, "labels"), "doc_id", "left").na.drop().select("doc_id", "quality", "toxic")


@query("SELECT doc_id, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the documents' index; missing ones are marked."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id")
    return docs.join(S.table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("SELECT l.doc_id, lang, toxic FROM labels l JOIN documents d USING (doc_id)")
def one_to_one_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join that fails if a key repeats on either side."""
    keyed = lambda df: df.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    left = keyed(S.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    right = keyed(S.table(spark, sf_dir, "documents").select("doc_id", "lang")).withColumnRenamed("k", "m")
    repeated = F.raise_error(F.concat(F.lit("repeated key "), F.col("doc_id").cast("string"))).cast("boolean")
    return left.join(right, "doc_id").where(F.when((F.col("k") > 1) | (F.col("m") > 1), repeated).otherwise(True)).select("doc_id", "lang", "toxic")


@query("SELECT n_name, r_name, count(*) AS suppliers, count(DISTINCT c_custkey) AS customers FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def multiway_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of suppliers times customers of each nation, aggregated before they meet."""
    nation, region = S.table(spark, sf_dir, "nation"), S.table(spark, sf_dir, "region")
    sup = S.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    cus = S.table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    rows = nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).join(sup, "n_nationkey").join(cus, "n_nationkey")
    return rows.select("n_name", "r_name", (F.col("s") * F.col("c")).alias("suppliers"), F.col("c").alias("customers"))


@query("SELECT l.doc_id, (SELECT count(*) FROM labels x WHERE x.doc_id NOT IN (SELECT doc_id FROM documents)) AS missing FROM labels l JOIN documents USING (doc_id) WHERE l.toxic = 1")
def index_aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join with the number of keys that it would lose (to be zero)."""
    labels, docs = S.table(spark, sf_dir, "labels"), S.table(spark, sf_dir, "documents").select("doc_id")
    missing = labels.join(docs, "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    return labels.where("toxic = 1").join(docs, "doc_id").select("doc_id").crossJoin(F.broadcast(missing))  # one row


@query("SELECT l_suppkey AS series_id, s_nationkey AS source_id, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL")
def source_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("series_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(S.series_dim(spark, sf_dir), "series_id").select("series_id", "source_id", "n")


@query("""SELECT (SELECT count(*) FROM documents d ANTI JOIN labels l ON l.doc_id = d.doc_id) AS missing, (SELECT count(*) FROM labels l ANTI JOIN documents d ON d.doc_id = l.doc_id) AS extra,
(SELECT count(*) FROM labels) AS observed""")
def coverage_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = S.table(spark, sf_dir, "documents").select("doc_id"), S.table(spark, sf_dir, "labels").select("doc_id")
    marked = docs.withColumn("d", F.lit(1)).join(labels.withColumn("l", F.lit(1)), "doc_id", "full")
    return marked.agg(F.count_if(F.col("l").isNull()).alias("missing"), F.count_if(F.col("d").isNull()).alias("extra"), F.count("l").alias("observed"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def done_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id").join(S.table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def todo_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "documents").select("doc_id").join(S.table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(f"""WITH {O.POINTS}, a AS (SELECT series_id, t, qty FROM points), b AS (SELECT series_id, t, y FROM points)
SELECT series_id, count(*) AS n, CAST(sum(qty) FILTER (y = 1) AS DOUBLE) AS qty_positive, count(*) = max(t) + 1 AS aligned FROM a JOIN b USING (series_id, t) GROUP BY series_id""")
def positional_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and labels joined by position, with the length check."""
    p = S.points(spark, sf_dir)
    joined = p.select("series_id", "t", "qty").join(p.select("series_id", "t", "y"), ["series_id", "t"])
    return joined.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, F.col("qty"))).alias("qty_positive"), (F.count(F.lit(1)) == F.max("t") + 1).alias("aligned"))


@query("SELECT 'parts' AS kind, count(*) AS n FROM part UNION ALL SELECT 'suppliers', count(*) FROM supplier UNION ALL SELECT 'customers', count(*) FROM customer")
def union_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, k: S.table(spark, sf_dir, t).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return one("part", "parts").unionByName(one("supplier", "suppliers")).unionByName(one("customer", "customers"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey > 20")
def except_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = S.table(spark, sf_dir, "supplier").where("s_suppkey > 20").select(F.col("s_nationkey").alias("k"))
    return S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).subtract(held)


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(S.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT NOT EXISTS (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer) AND NOT EXISTS (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation) AS same")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("b", F.lit(1))
    return a.join(b, "k", "full").agg((F.count_if(F.col("a").isNull() | F.col("b").isNull()) == 0).alias("same"))


@query("SELECT lang, count(*) FILTER (toxic = 0) AS clean, count(*) FILTER (toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def pivot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "documents").select("doc_id", "lang").join(S.table(spark, sf_dir, "labels"), "doc_id")
    wide = rows.groupBy("lang").pivot("toxic", [0, 1]).count()
    return wide.select("lang", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("SELECT event_type, round(avg(value) FILTER (user_id % 2 = 0), 6) + 0.0 AS even, round(avg(value) FILTER (user_id % 2 = 1), 6) + 0.0 AS odd FROM events GROUP BY event_type")
def unstacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "events").select("event_type", "value", (F.col("user_id") % 2).alias("side"))
    wide = rows.groupBy("event_type").pivot("side", [0, 1]).agg(F.avg("value"))
    return tidy(wide.select("event_type", F.col("0").alias("even"), F.col("1").alias("odd")))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error'")
def cross_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id")


@query("SELECT s_nationkey AS source_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) + 0.0 AS proportion FROM supplier GROUP BY s_nationkey")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = S.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("source_id")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))  # one row for each source
    return counts.select("source_id", "n", C.rounded(share, 9).alias("proportion"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_id) = count(*) AS is_unique FROM events GROUP BY event_type")
def value_and_distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), (F.countDistinct("event_id") == F.count(F.lit(1))).alias("is_unique")
    )


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def sorted_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(20)


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 4")
def top_k_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    rows = S.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return rows.withColumn("k", F.row_number().over(order)).where("k <= 4").drop("k")


@query("SELECT event_type, count(v) AS finite, count(*) - count(v) AS undefined, round(avg(v), 6) + 0.0 AS mean FROM (SELECT event_type, CASE WHEN value > 1 THEN ln(value - 1) END AS v FROM events) GROUP BY event_type")
def finite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undefined values are null: they are counted apart and skipped by means."""
    v = F.when(F.col("value") > 1, F.log(F.col("value") - 1))
    rows = S.table(spark, sf_dir, "events").select("event_type", v.alias("v"))
    return tidy(rows.groupBy("event_type").agg(F.count("v").alias("finite"), (F.count(F.lit(1)) - F.count("v")).alias("undefined"), F.avg("v").alias("mean")))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256(props) AS props_hash, replace(event_type, '_', '-') AS shown,
starts_with(event_type, 'e') AS e, CAST(replace('0p25', 'p', '.') AS DOUBLE) AS alpha, printf('%.3f', value) AS text FROM events""")
def string_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.sha2("props", 256).alias("props_hash"),
        F.regexp_replace("event_type", "_", "-").alias("shown"), F.col("event_type").startswith("e").alias("e"),
        F.regexp_replace(F.lit("0p25"), "p", ".").cast("double").alias("alpha"), F.format_string("%.3f", "value").alias("text"))


@query(f"""WITH {NAMES_SQL}, h AS (SELECT series_id, sha256('v1|' || file) AS h FROM names)
SELECT series_id, CAST(CAST('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS UBIGINT) AS VARCHAR) AS seed FROM h""")
def seed_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bit seeds of series names, as decimal text, in the JVM."""
    return S.series_names(spark, sf_dir).select("series_id", C.seed64_column(F.concat(F.lit("v1|"), F.col("file"))).cast("string").alias("seed"))


@query("""SELECT vec_id, round(list_sum(embedding), 4) + 0.0 AS total, list_position(embedding, list_max(embedding)) - 1 AS argmax, len(list_filter(embedding, lambda v: v > 0)) AS positive,
list_sort(list_transform(range(0, 4), lambda i: i / 3.0::DOUBLE))[2] AS knot FROM embeddings""")
def array_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return S.table(spark, sf_dir, "embeddings").select(
        "vec_id", C.rounded(F.aggregate(e, F.lit(0.0), lambda a, v: a + v.cast("double")), 4).alias("total"),
        (F.array_position(e, F.array_max(e)) - 1).alias("argmax"), F.size(F.filter(e, lambda v: v > 0)).cast("long").alias("positive"),
        F.get(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i / F.lit(3.0))), F.lit(1)).alias("knot"))


@query("SELECT n_name, map_extract(map_from_entries([(0, 'africa'), (1, 'america')]), n_regionkey)[1] AS region FROM nation")
def map_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.create_map(F.lit(0), F.lit("africa"), F.lit(1), F.lit("america"))
    return S.table(spark, sf_dir, "nation").select("n_name", F.try_element_at(known, F.col("n_regionkey")).alias("region"))


@query()
def array_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of vectors' float64 bytes."""
    return S.table(spark, sf_dir, "embeddings").select("vec_id", C.array_sha256("embedding").alias("hash"))


@query("SELECT p_brand, count(*) AS n, bool_and(abs(p_retailprice - round(p_retailprice, 2)) <= 1e-9) AS close, round(max(sign(p_size - 25)), 6) + 0.0 AS top, round(sum(sqrt(p_size)), 5) + 0.0 AS roots FROM part GROUP BY p_brand")
def math_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice")
    return S.table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(price - F.round(price, 2)) <= 1e-9).alias("close"),
        C.rounded(F.max(F.signum(F.col("p_size") - 25))).alias("top"), C.rounded(F.sum(F.sqrt("p_size")), 5).alias("roots"))


@query(f"""WITH {O.COUNTS}, f AS (SELECT a.source_id AS fold, list(b.source_id) AS train FROM per_source a JOIN per_source b ON a.source_id <> b.source_id GROUP BY a.source_id)
SELECT fold, len(train) AS n_train, NOT list_contains(train, fold) AS clean FROM f""")
def fold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No fold trains on the source that it tests; the list of sources is a dimension table."""
    sources = S.series_dim(spark, sf_dir).join(S.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id")), "series_id", "left_semi").select("source_id").distinct()
    other = sources.select(F.col("source_id").alias("o"))
    folds = sources.join(other, F.col("source_id") != F.col("o")).groupBy(F.col("source_id").alias("fold")).agg(F.collect_list("o").alias("train"))
    return folds.select("fold", F.size("train").cast("long").alias("n_train"), (~F.array_contains("train", F.col("fold"))).alias("clean"))


@query("""SELECT n_name AS experiment, count(s_suppkey) AS checkpoints, CASE WHEN count(s_suppkey) >= 5 THEN 'COMPLETE' WHEN count(s_suppkey) > 0 THEN 'PARTIAL' ELSE 'NOT_OBSERVED' END AS status
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"))
    k = F.coalesce("k", F.lit(0))
    status = F.when(k >= 5, "COMPLETE").when(k > 0, "PARTIAL").otherwise("NOT_OBSERVED")
    return S.table(spark, sf_dir, "nation").join(found, "n_nationkey", "left").select(F.col("n_name").alias("experiment"), k.alias("checkpoints"), status.alias("status"))


@query("SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL")
def condition_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
