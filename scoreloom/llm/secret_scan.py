"""Secret scan [native]: base patterns, and weak candidates that multipart linking confirms.

Base kinds are found leftmost and non-overlapping, each kind on its own. Spark's regular
expressions return strings without places, so the pattern is extracted together with the
text before it; the lengths of the gaps and matches, summed, are the places. Only texts
that hold a kind at all are taken apart.

Multipart credential linking: some strings are secrets only in company. A weak candidate is a run of
40 key characters, or of 20 and more whose classes change as often as in a random string, with
lower and upper case and digits (an identifier made of words is none). It is reported when parts of
its kind of credential lie within ``SCOPE`` code points of it in the same text: as ``linked`` when these
are an identifier and an endpoint, as the weaker ``pair`` when it is one of them alone. What goes
together:

* an access key's or client's identifier: any candidate;
* a user name: a candidate that a base assignment calls a password, secret, token or key;
* an address of an interface, sign-in or cloud service: a candidate of random shape, or one that has
  its identifier; an address of any other page is no part;
* an address of a database or queue: a candidate that a base assignment names.

The interval join runs over the located parts of one text in order of place: for each weak
candidate the nearest parts of each other sort before and behind it are looked up, which
decides the join without forming pairs, so many parts cost no more than their sort. Only
texts with candidates and other parts are exploded, each row of an id and text once. The confirmed
spans come back by an equi-join on the row's key.

Patterns take time in proportion to a text, however long its runs: none has an open start that
a later position could begin anew.

Everything is a DataFrame or SQL function; matching needs no shuffle, linking one of a few
located parts.

Defined cases: a null text counts as empty; an empty result is the empty string, whose
SHA-256 is reported; rows of equal id and text get the same result each; null ids are kept;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Base kinds in order: pattern, least length, and the group whose length counts.
BASE = (
    (
        "assign",
        r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        6,
        3,
    ),
    # a run too short for these two holds no later match that would do: the least length can stand in the pattern
    ("access", r"AKIA[A-Z0-9]{16,}", 20, 2),
    ("hex", r"[0-9a-f]{24,}", 24, 2),
)
#: What a text must hold for a kind to be worth taking apart.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
}
#: Parts that mean something only together.
WEAK = (
    r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
    # no part of a host or path: not behind a dot, no two slashes first
    r"|(?<![A-Za-z0-9+/_.-])(?!//)(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])"
)
IDENTIFIER = r"(?:AKIA|ASIA|AROA|AIDA)[A-Z0-9]{12,}|(?i:client_?id|access_?key_?id|user(?:name)?)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{3,}"
ENDPOINT = r"(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]+|amazonaws\.com"
#: An identifier that is only a name; addresses of services, and of databases and queues; classes of a string's signs.
LOGIN = r"^(?i:user)"
SERVICE = r"^(?i:https?)://(?:[^/\s]*[.@])?(?i:api|auth|oauth2?|login|sso|sts|gateway)[a-z0-9-]*\.|^(?i:https?)://[^/\s]+/(?i:api|oauth2?|token|auth)\b|amazonaws\.com|^s3:"
STORE = r"^(?:postgres|mysql|mongodb|redis|amqp)"
CLASSES = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
#: A random string has a class for each so many signs at least.
SIGNS_PER_CLASS = 3
SCOPE = 400
#: Prefix sums work in runs of so many elements, which bounds their cost for very many matches.
RUN = 128


def places(text: Column, pattern: str, hint: str, least: int = 1, group: int = 2, mark: Callable[[Column], Column] = F.char_length) -> Column:
    """Array of struct<s,e,n>: where ``pattern`` stands, for matches whose ``group`` has a ``mark`` n (its length) of ``least`` or more."""
    taken = "(?s)(.*?)(" + pattern + r"|\z)"  # the tail is one more, empty match: else each place in it would be tried
    gaps = F.transform(F.regexp_extract_all(text, F.lit(taken), F.lit(1)), F.char_length)
    full = F.transform(F.regexp_extract_all(text, F.lit(taken), F.lit(2)), F.char_length)
    size = full if group == 2 and mark is F.char_length else F.transform(F.regexp_extract_all(text, F.lit(taken), F.lit(group)), mark)

    # each step binds what the next one uses again and again
    packed = F.array(F.struct(gaps.alias("gaps"), full.alias("full"), size.alias("size")))
    summed = F.transform(
        packed,
        lambda x: F.struct(x["gaps"].alias("gaps"), x["size"].alias("size"), F.zip_with(x["gaps"], x["full"], lambda g, m: g + m).alias("both")),
    )
    in_runs = F.transform(
        summed,
        lambda x: F.struct(
            x["gaps"].alias("gaps"),
            x["size"].alias("size"),
            x["both"].alias("both"),
            F.aggregate(
                F.sequence(F.lit(0), F.floor((F.size(x["both"]) - 1) / RUN).cast("int")),
                F.array(F.lit(0)),
                lambda a, b: F.concat(a, F.array(F.aggregate(F.slice(x["both"], b * RUN + 1, RUN), F.element_at(a, -1), lambda c, y: c + y))),
            ).alias("ahead"),
        ),
    )

    def located(x: Column) -> Column:
        def before(i: Column) -> Column:
            b = F.floor(i / RUN).cast("int")
            return F.aggregate(F.slice(x["both"], b * RUN + 1, i - b * RUN), F.get(x["ahead"], b), lambda a, y: a + y)

        found = F.transform(
            F.sequence(F.lit(0), F.size(x["both"]) - 1),
            lambda i: F.struct(
                (before(i) + F.get(x["gaps"], i)).alias("s"),
                (before(i) + F.get(x["both"], i)).alias("e"),
                F.get(x["size"], i).alias("n"),
            ),
        )
        return F.filter(found, lambda y: y["n"] >= least)

    found = F.get(F.transform(in_runs, located), F.lit(0))
    none = F.array().cast("array<struct<s:int,e:int,n:int>>")
    return F.coalesce(F.when(text.rlike(hint), found), none)


def _of_sort(sort: str):
    return lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(sort).alias("sort"), x["n"].alias("n"))


def _shape(m: Column) -> Column:
    """2 for a candidate of random shape, 1 for another one of 40 signs, 0 else."""
    random = F.size(F.regexp_extract_all(m, F.lit(CLASSES), F.lit(0))) * SIGNS_PER_CLASS >= F.char_length(m)
    return F.when(m == "", 0).when(random, 2).when(F.char_length(m) == 40, 1).otherwise(0)


def _known(m: Column) -> Column:
    return F.when(m.rlike(LOGIN), 1).when(m == "", 0).otherwise(2)


def _address(m: Column) -> Column:
    return F.when(m.rlike(STORE), 1).when(m.rlike(SERVICE), 2).otherwise(0)


#: The parts by sort: pattern, and what kind of part a match is (0: none).
PARTS = (("weak", WEAK, _shape), ("identifier", IDENTIFIER, _known), ("endpoint", ENDPOINT, _address))


def _of_kind(i: int, kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k"))


def _linked(parts: DataFrame) -> DataFrame:
    """Per key (d, h): the weak candidates with an identifier and an endpoint in their scope, and those with one of them."""
    rows = parts.dropDuplicates(["d", "h"]).select("d", "h", F.explode("parts").alias("x")).select("d", "h", "x.*")
    key, sofar = Window.partitionBy("d", "h"), (Window.unboundedPreceding, -1)  # running values both ways: one pass each
    before = key.orderBy("s", "e", "sort").rowsBetween(*sofar)
    behind = key.orderBy(F.desc("s"), F.desc("e"), F.desc("sort")).rowsBetween(*sofar)

    def near(sort: str, kind: int) -> Column:
        of = (F.col("sort") == sort) & (F.col("n") == kind)
        end, start = F.max(F.when(of, F.col("e"))).over(before), F.min(F.when(of, F.col("s"))).over(behind)
        return F.coalesce(F.col("s") - end <= SCOPE, F.lit(False)) | F.coalesce(start - F.col("e") <= SCOPE, F.lit(False))

    named = F.coalesce(F.max(F.when(F.col("sort") == "assign", F.col("e"))).over(before) > F.col("s"), F.lit(False))
    sorts = {f"{sort}_{kind}": near(sort, kind) for sort in ("identifier", "endpoint") for kind in (1, 2)}
    found = rows.withColumns({**sorts, "named": named}).where("sort = 'weak'")
    found = found.withColumn("by_id", F.expr("identifier_2 or named and identifier_1"))
    found = found.withColumn("by_end", F.expr("endpoint_2 and (n = 2 or by_id) or named and endpoint_1")).where("by_id or by_end")
    span, both = F.struct("s", "e", F.lit(0).alias("n")), F.col("by_id") & F.col("by_end")
    return found.groupBy("d", "h").agg(
        F.array_sort(F.collect_set(F.when(both, span))).alias("linked"), F.array_sort(F.collect_set(F.when(~both, span))).alias("pair")
    )


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, the digest of their places, and all spans."""
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")
    )
    found = rows.select(
        "doc_id",
        F.xxhash64("t").alias("h"),
        F.length("t").alias("n"),
        *(places(F.col("t"), pattern, HINTS[kind], least, group).alias(kind) for kind, pattern, least, group in BASE),
    )
    apart = rows.where(F.col("t").rlike(WEAK) & (F.col("t").rlike(ENDPOINT) | F.col("t").rlike(IDENTIFIER))).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("d"),
        F.xxhash64("t").alias("h"),
        F.concat(
            *(F.transform(places(F.col("t"), pattern, pattern, mark=mark), _of_sort(sort)) for sort, pattern, mark in PARTS),
            F.transform(places(F.col("t"), BASE[0][1], HINTS["assign"], *BASE[0][2:]), _of_sort("assign")),
        ).alias("parts"),
    )
    joined = found.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)))).join(_linked(apart), ["d", "h"], "left")

    def kinds(*names: str) -> Column:
        each = [
            F.transform(F.coalesce(F.col(k), F.expr("cast(array() as array<struct<s:int,e:int,n:int>>)")), _of_kind(i, k))
            for i, k in enumerate(names)
        ]
        return F.transform(
            F.array_sort(F.concat(*each)), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))
        )

    names = [k for k, *_ in BASE]
    return joined.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in names),
        F.sha2(F.array_join(kinds(*names), ","), 256).alias("base_sha256"),
        F.array_join(kinds(*names, "linked", "pair"), ",").alias("spans"),
    )
