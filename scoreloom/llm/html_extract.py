"""HTML extraction: template deduction from equivalence classes of tokens.

Tokens of a page are its tags and the words outside an article element, each told apart by the path of open elements above
it (its role). Over the pages of one host every token has an occurrence vector: how often
it stands in each page. Tokens with equal vectors form an equivalence class; a class that
is large and frequent enough comes from a template of the host. Three passes over the pages
decide: the first gives the vectors and so the classes; the second checks each class's order
(on each page its tokens must stand as t1 .. tn again and again; a token outside the longest
such run on any page leaves its class); the third checks that valid classes nest (on each
page a class lies in one gap of another, the same on all pages, or outside it, and never
across; of two that don't, the one of fewer pages and tokens goes). What lies between the
tokens left are slots. Slots that hold the article are extracted, template words are not.

A class needs no support but its own: equal vectors of ``least_class`` tokens on
``least_pages`` pages and on a share ``support`` of the host's (which bounds a host's template
to 1 / support page lengths), so each of a host's layouts has its template; smaller classes
must stand once on each of a share ``every`` of the pages.

At scale a host may own a third of all pages, so no task sees a host's pages together. An
occurrence vector is represented by its digest, the sum over the pages of
hash(page) * count modulo 2^64, which is added up in parts; first positions are averaged.
Each task sums its pages before the shuffle, and the faults that it finds. Classes and templates join back to the pages by host: broadcast where their size is small,
otherwise a shuffled join, which adaptive execution splits for a large host.

Roles of slots: elements whose tag, role, class or id names a menu, header, footer,
sidebar, notice, advert, form or comments are never the article, in any template. Where a
page has an article (or main) element, all inside is one slot, whatever other pages hold
(a host may repeat an article), unless slots of more words lie outside it (a teaser beside
the text); elsewhere, and there, the slots are what the template does not say, and a page
that is all template is kept.

Blocks are block-level elements in page order; white space inside a block becomes one
space, empty blocks go, and the blocks are joined by line breaks. References are decoded.

Defined cases: null or empty html gives the empty text; unclosed elements close with their
parents, and p, li, dt, dd, option, tr, td, th close where the next one opens; a page whose
url has no host is in the template of the empty host; a host with fewer than ``least_pages``
pages has no template, so only roles decide; repeated pages each count; further columns are
not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import cut, fits

#: Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes".split())
BOILERPLATE = frozenset(
    "nav header footer aside form button dialog menu label fieldset svg object select template noscript annotation annotation-xml".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figure figcaption"
    " footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
BARRIERS = frozenset("article body div html main section table ul ol dl blockquote nav header footer aside form td th".split())
#: Names in class, id or role that mark what is not the article; the second kind only as a whole name.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|advertisement|adverts|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    r"|masthead|sidebar|widget|related|recommended|share|sharing|social|cookie|cookies|consent|gdpr|popup|modal"
    r"|newsletter|subscribe|signup|login|comment|comments|reply|replies|disqus|complementary|contentinfo|pagination|pager)"
    r"(?:$|[\s_-])"
    r"|(?:^|\s)(?:(?:site|page|main|global|top)[_-])?(?:header|footer|aside|search|form|notice|copyright)(?:$|\s)",
    re.I,
)
#: Inside an article only a whole name of these counts, or one with a part that says what it is (share-links, post-ads):
#: an article may be about share prices, related work or navigation.
_INSIDE = (
    r"(?:ad|ads|adv|advert|advertisement|adverts|banner|sponsor|sponsored|promo|promotion|nav|navbar|menu|breadcrumb|breadcrumbs|masthead|sidebar|widget"
    r"|related|recommended|share|sharing|social|cookie|cookies|consent|gdpr|popup|modal|newsletter|subscribe|signup|login|complementary|contentinfo|pagination|pager)"
)
INSIDE = re.compile(
    rf"(?:^|\s)(?:(?:post|entry|article|page|site|inline)[_-])?{_INSIDE}"
    r"(?:[_-](?:links?|buttons?|icons?|bar|box|slot|unit|posts?|articles?|stories|banner|container|wrapper|widget|form|block|notice|tools))?(?:$|\s)"
    r"|(?:^|\s)(?:(?:site|page|main|global|top)[_-])?(?:header|footer|aside|search|form|notice|copyright)(?:$|\s)",
    re.I,
)
#: Of these, names that an article element inside does not undo.
FIRM = re.compile(r"(?:^|[\s_-])(?:comment|comments|reply|replies|respond|disqus)(?:$|[\s_-])", re.I)
#: A tag from its name on. A quote counts only behind an equals sign; nothing is read twice.
TAG = re.compile(r"([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
#: Bound of what is remembered of a tag's attributes.
SHORT = 400
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SUPPORT = 0.02
EVERY = 0.8
LEAST_PAGES = 4
LEAST_CLASS = 3
HELD = 200_000


class Block:
    """A run of text at one place of the element tree."""

    __slots__ = ("path", "words", "role", "article")

    def __init__(self, path: int, role: bool, article: bool):
        self.path, self.words, self.role, self.article = path, [], role, article


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), "".join(values))
    return out


def boilerplate_level(tag: str, named: dict[str, str]) -> int:
    """0: may hold the article; 1: its names say no; 2: no, whatever stands inside."""
    if tag in BOILERPLATE or "hidden" in named or named.get("aria-hidden") == "true":
        return 2
    if not named or tag in ("html", "body"):
        return 0
    if re.search(r"display\s*:\s*none", named.get("style", ""), re.I):
        return 2
    names = [named.get(k, "") for k in ("class", "id", "role")]
    if any(FIRM.search(x) for x in names):
        return 2
    return 1 if any(NAMES.search(x) for x in names) else 0


def _about(tag: str, rest: str) -> tuple[int, int, str, bool]:
    """The boilerplate level outside and inside an article, the first class and whether it is a body, of a tag with the attributes ``rest``.

    A header's own level is that of its names: 2 unless it is the article's heading, which the caller knows.
    """
    named = attributes(rest) if rest and not rest.isspace() else {}
    classes = named.get("class", "").split()
    level = boilerplate_level(tag, named)
    if tag == "header" and level == 2 and not any(NAMES.search(named.get(k, "")) for k in ("class", "id", "role")):
        level = -1
    inside = int(any(INSIDE.search(named.get(k, "")) for k in ("class", "id", "role"))) if level == 1 else level
    return level, inside, classes[0] if classes else "", tag in ("article", "main") or named.get("role") == "main"


_about_short = lru_cache(8192)(_about)


@lru_cache(65536)
def _below(path: int, tag: str, name: str) -> int:
    """The path of an element inside ``path``: a digest, so that depth costs nothing."""
    return xxhash.xxh3_64_intdigest(f"{path}/{tag}.{name}")


class _Elements:
    """The open elements, with the places of each name and of barriers, so that no tag searches the whole stack."""

    def __init__(self):
        self.stack: list[tuple] = [("", 0, 0, False)]  # tag, path, level of boilerplate, article
        self.places: dict[str, list[int]] = defaultdict(list)
        self.barriers: list[int] = []

    def push(self, tag: str, path: int, role: int, article: bool) -> None:
        self.places[tag].append(len(self.stack))
        if tag in BARRIERS:
            self.barriers.append(len(self.stack))
        self.stack.append((tag, path, role, article))

    def nearest(self, tags, through: bool = False) -> int:
        """The place of the innermost of ``tags``, 0 if none is open or (but for ``through``) a barrier lies inside it."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        return at if through or not self.barriers or self.barriers[-1] <= at else 0

    def close(self, at: int) -> bool:
        """Closes the element at ``at`` and all inside; whether one of those inside is a block."""
        blocks = False
        while len(self.stack) > at:
            tag = self.stack.pop()[0]
            blocks |= tag in BLOCKS and len(self.stack) > at
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()
        return blocks


def read_page(source: str, whole: bool = True) -> tuple[list[Block], list[int | Block]]:
    """The blocks of a page in order, and these among its tag tokens (path of each opened element). Linear in the page.

    Text inside boilerplate elements becomes blocks of its own, also where the element stands inline in a block.
    Without ``whole`` the text of articles, which holds no tokens, is passed over.
    """
    blocks: list[Block] = []
    order: list[int | Block] = []
    open_ = _Elements()
    runs: list[tuple] = []  # path, whether boilerplate, article, text
    at, n, head = 0, len(source), False

    def flush() -> None:
        if not runs:
            return
        for said in (False, True):
            mine = [r for r in runs if r[1] == said]
            words = entities.unescape("".join(r[3] for r in mine)).split()
            if words:
                first = next(r for r in mine if not r[3].isspace())
                blocks.append(Block(first[0], said, first[2]))
                blocks[-1].words = words
                order.append(blocks[-1])
        runs.clear()

    def add(text: str) -> None:
        if text:
            _, path, role, article = open_.stack[-1]
            if whole or not article:
                runs.append((path, role > 0, article, text))

    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt + 1 >= n:
            add(source[at:])
            break
        add(source[at:lt])
        sign = source[lt + 1]
        if sign in "!?":
            if source.startswith("<!--", lt):
                end, size = source.find("-->", lt + 2), 3
            elif source.startswith("<![CDATA[", lt):
                end, size = source.find("]]>", lt + 9), 3
                add(source[lt + 9 : end if end >= 0 else n].replace("&", "&amp;"))
            else:
                end, size = source.find(">", lt + 1), 1
            at = end + size if end >= 0 else n
            continue
        closing = sign == "/"
        start = lt + 1 + closing
        if start >= n or not (source[start].isascii() and source[start].isalpha()):
            if closing and start < n:  # </ and no name: up to the next > it is nothing
                end = source.find(">", start)
                at = end + 1 if end >= 0 else n
            else:
                add("<")
                at = lt + 1
            continue
        m = TAG.match(source, start)
        if m is None:  # cut off by the page's end
            break
        tag, rest, at = m[1].lower(), m[2], m.end()
        if tag in BLOCKS:
            flush()
        if closing:
            place = open_.nearest([tag], tag in BARRIERS)
            if place and open_.close(place) and tag not in BLOCKS:
                flush()
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if tag == "head":
            end = None if head else re.compile(r"</head\s*>|<body[\s>]", re.I).search(source, at)
            head = True
            if end:
                at = end.start() if end[0].lower().startswith("<body") else end.end()
            continue
        if tag in CLOSES and (place := open_.nearest(CLOSES[tag])):
            open_.close(place)
        if tag in VOID or tag in ("svg", "math") and rest.endswith("/"):
            continue
        _, path, role, article = open_.stack[-1]
        level, inside, name, body = _about_short(tag, rest) if len(rest) <= SHORT else _about(tag, rest)
        level = inside if article else level
        if level < 0:
            level = 0 if article else 2  # the article's own heading, or the page's
        below = _below(path, tag, name if len(name) <= SHORT else xxhash.xxh3_64_hexdigest(name))
        order.append(below)
        role = level if body and role < 2 else max(role, level)  # an article undoes names around it
        open_.push(tag, below, role, article or body)
    flush()
    return blocks, order


def token(path: int, word: str = "") -> int:
    """A token's 64-bit name; 0 stands for the page itself."""
    return xxhash.xxh3_64_intdigest(f"{path}\t{word}") - 2**63 or 1


def word_tokens(block: Block) -> list[int]:
    """The tokens of a block's words; the second and later ones of a word are told apart."""
    seen: Counter = Counter()
    out = []
    for w in block.words:
        seen[w] += 1
        out.append(token(block.path, w if seen[w] == 1 else f"{w}\t{seen[w]}"))
    return out


def page_tokens(order: list[int | Block]) -> list[int]:
    """The tokens of a page in order. Words inside an article element are slots, not tokens."""
    out: list[int] = []
    for x in order:
        if isinstance(x, int):
            out.append(token(x))
        elif not x.article:
            out += word_tokens(x)
    return out


def page_hash(page_id: int | None, source: str) -> int:
    return zlib.crc32(f"{page_id}".encode()) << 32 | zlib.crc32(source.encode("utf-8", "surrogatepass")) | 1


def _wrap(x: int) -> int:
    return (x + 2**63) % 2**64 - 2**63


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page_id, html) to (host, token, pages, times, digest, position), summed over the task's pages."""
    sums: dict = defaultdict(lambda: [0, 0, 0, 0.0])

    def sent() -> pa.RecordBatch:
        keys = list(sums)
        cols = [
            pa.array([h for h, _ in keys], pa.string()), pa.array([t for _, t in keys], pa.int64()),
            pa.array([sums[k][0] for k in keys], pa.int64()), pa.array([sums[k][1] for k in keys], pa.int64()),
            pa.array([_wrap(sums[k][2]) for k in keys], pa.int64()), pa.array([sums[k][3] for k in keys], pa.float64()),
        ]
        sums.clear()
        return pa.RecordBatch.from_arrays(cols, ["host", "token", "pages", "times", "digest", "place"])

    for batch in batches:
        for host, page, source in zip(*(batch.column(i) for i in range(3))):
            host, source = host.as_py(), source.as_py() or ""
            names = page_tokens(read_page(source, False)[1])
            found, first = Counter(names), {}
            for at, name in enumerate(names):
                first.setdefault(name, at)
            mark = page_hash(page.as_py(), source)
            total = len(names) or 1
            for name, n in found.items():
                s = sums[host, name]
                s[0] += 1
                s[1] += n
                s[2] += mark * n
                s[3] += first[name] / total
            s = sums[host, 0]
            s[0] += 1
            if len(sums) >= HELD:
                yield sent()
    if sums:
        yield sent()


def out_of_order(names: list[int], members: dict[int, tuple[int, int]], sizes: list[int]) -> set[int]:
    """Tokens of a page outside the longest run of their class that keeps its order."""
    times, expected = Counter(), defaultdict(list)
    for t in names:
        if t in members:
            c, r = members[t]
            expected[c].append((times[t] * sizes[c] + r, t))
            times[t] += 1
    out: set[int] = set()
    for places in expected.values():
        if all(a < b for a, b in zip(places, places[1:])):
            continue
        ends: list[int] = []  # smallest end of a run of each length, and which place it is
        which: list[int] = []
        back = []
        for k, (x, _) in enumerate(places):
            n = bisect_left(ends, x)
            back.append(which[n - 1] if n else -1)
            ends[n:n + 1], which[n:n + 1] = [x], [k]
        kept, k = set(), which[-1]
        while k >= 0:
            kept.add(k)
            k = back[k]
        out.update(t for k, (_, t) in enumerate(places) if k not in kept)
    return out


def nesting(names: list[int], members: dict[int, tuple[int, int]], sizes: list[int]) -> tuple[set, dict]:
    """Of one page: pairs of classes that cross, and the gap (the token before it) of (outer, inner) pairs; 0 if it is not one."""
    crossing: set[tuple[int, int]] = set()
    gaps: dict[tuple[int, int], int] = {}
    opened: list[list[int]] = []  # class, last token
    for t in names:
        if t not in members:
            continue
        c, r = members[t]
        if r == 0:
            for outer, last in opened:
                if outer != c:
                    gaps[outer, c] = last if gaps.get((outer, c), last) == last else 0
            if sizes[c] > 1:
                opened.append([c, t])
            continue
        at = next((k for k in range(len(opened) - 1, -1, -1) if opened[k][0] == c), None)
        if at is None:
            continue
        above = [x[0] for x in opened[at + 1 :]]
        crossing.update((min(c, x), max(c, x)) for x in above if x != c)
        if any(x < c for x in above):
            del opened[at]
            continue
        del opened[at + 1 :]
        opened[at][1] = t
        if r == sizes[c] - 1:
            del opened[at]
    return crossing, gaps


def _classes(found) -> tuple[dict[int, tuple[int, int]], list[int]]:
    """(class, rank) of each token, and the classes' sizes."""
    each = found.as_py() or []
    return {t: (c, r) for c, ts in enumerate(each) for r, t in enumerate(ts)}, [len(ts) for ts in each]


def _disorder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, classes) to (host, token) of the tokens that some page has out of order."""
    for batch in batches:
        known: dict = {}
        out: set = set()
        for host, source, classes in zip(*(batch.column(i) for i in range(3))):
            host = host.as_py()
            if host not in known:
                known[host] = _classes(classes)
            out.update((host, t) for t in out_of_order(page_tokens(read_page(source.as_py() or "", False)[1]), *known[host]))
        pairs = sorted(out, key=repr)
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in pairs], pa.string()), pa.array([t for _, t in pairs], pa.int64())], ["host", "token"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, classes) to (host, outer, inner, low, high): least and greatest gap; a gap of 0 is a fault of itself."""
    for batch in batches:
        known: dict = {}
        out: dict = {}
        for host, source, classes in zip(*(batch.column(i) for i in range(3))):
            host = host.as_py()
            if host not in known:
                known[host] = _classes(classes)
            crossing, gaps = nesting(page_tokens(read_page(source.as_py() or "", False)[1]), *known[host])
            for key, gap in [*gaps.items(), *((k, 0) for k in crossing)]:
                low, high = out.get((host, *key), (gap, gap))
                out[(host, *key)] = min(low, gap), max(high, gap)
        keys = list(out)
        cols = [pa.array([k[0] for k in keys], pa.string()), *(pa.array([k[i] for k in keys], pa.int32()) for i in (1, 2)),
                *(pa.array([out[k][i] for k in keys], pa.int64()) for i in (0, 1))]
        yield pa.RecordBatch.from_arrays(cols, ["host", "outer", "inner", "low", "high"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, classes, faults) to (host, template): of each faulty pair of valid classes the first one stays."""
    for batch in batches:
        texts = []
        for classes, faults in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            against = defaultdict(list)
            for x in faults or []:
                against[x["b"]].append(x["a"])
            gone: set[int] = set()
            for c in range(len(classes)):
                if any(a not in gone for a in against[c]):
                    gone.add(c)
            texts.append([t for c, ts in enumerate(classes) if c not in gone for t in ts])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.list_(pa.int64()))], ["host", "template"])


def with_classes(pages: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """``pages`` joined with each host's arrays: broadcast where they are few."""
    n, words = known.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    side = F.broadcast(known.drop("words")) if fits(n + words, 64) else known.drop("words")
    return pages.join(side, "host", "left").select(*pages.columns, column)


def templates(
    pages: DataFrame, support: float = SUPPORT, least_pages: int = LEAST_PAGES, least_class: int = LEAST_CLASS, every: float = EVERY
) -> DataFrame:
    """(host, template, words): the tokens of each host's templates and their number, from (host, page_id, html)."""
    summed = pages.select("host", "page_id", "html").mapInArrow(
        _occurrences, "host string, token long, pages long, times long, digest long, place double"
    )
    summed = summed.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.sum("times").alias("times"),
        F.expr("cast(pmod(sum(cast(digest as decimal(38,0))), 18446744073709551616) - 9223372036854775808 as long)").alias("digest"),
        F.sum("place").alias("place"),
    )
    summed = cut(summed.where("pages > 1 or token = 0"))
    hosts = summed.where("token = 0").select("host", F.col("pages").alias("of"))
    frequent = summed.where("token <> 0").join(hosts, "host").where(f"pages >= {least_pages} and pages >= {support} * of")
    valid = f"size >= {least_class} or times = pages and pages >= {every} * of"
    classes = frequent.groupBy("host", "of", "digest", "pages", "times").agg(
        F.count("*").alias("size"), F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("members")
    ).where(valid)

    def by_host(found: DataFrame) -> DataFrame:
        ranked = F.sort_array(F.collect_list(F.struct((-F.col("pages")).alias("p"), (-F.col("size")).alias("s"), "digest", "times", F.col("members.token").alias("ts"))))
        return cut(found.groupBy("host").agg(ranked.alias("r")).select("host", F.col("r.ts").alias("classes"), F.expr("aggregate(r.ts, 0L, (n, x) -> n + size(x))").alias("words")))

    asked = with_classes(pages.select("host", "html"), by_host(classes), "classes").where("classes is not null")
    wrong = cut(asked.mapInArrow(_disorder, "host string, token long").distinct().groupBy("host").agg(F.collect_list("token").alias("wrong")))
    left = classes.join(wrong, "host", "left").withColumn(
        "members", F.when(F.col("wrong").isNull(), F.col("members")).otherwise(F.expr("filter(members, m -> not array_contains(wrong, m.token))"))
    )
    left = by_host(left.withColumn("size", F.size("members").cast("long")).where("size > 0").where(valid))
    asked = with_classes(pages.select("host", "html"), left, "classes").where("classes is not null")
    pairs = asked.mapInArrow(_pairs, "host string, outer int, inner int, low long, high long")
    pairs = pairs.groupBy("host", "outer", "inner").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high or low = 0 or high = 0")
    faults = pairs.groupBy("host").agg(F.collect_set(F.struct(F.least("outer", "inner").alias("a"), F.greatest("outer", "inner").alias("b"))).alias("faults"))
    settled = left.join(faults, "host", "left").select("host", "classes", "faults").mapInArrow(_settled, "host string, template array<long>")
    return settled.withColumn("words", F.size("template").cast("long"))


def article_text(source: str, template: frozenset) -> str:
    """The article's blocks without what the template says itself."""
    blocks, _ = read_page(source)
    blocks = [b for b in blocks if not b.role]
    said = [not b.article and all(t in template for t in word_tokens(b)) for b in blocks]  # of template words only: no slot
    within = sum(len(b.words) for b in blocks if b.article)
    beside = sum(len(b.words) for b, x in zip(blocks, said) if not b.article and not x)
    if template and within < beside:  # the article is a teaser beside the text: the template alone decides
        out = [b for b, x in zip(blocks, said) if not x]
    elif within:
        out = [b for b in blocks if b.article]
    else:
        out = [b for b, x in zip(blocks, said) if not x] or blocks
    return "\n".join(" ".join(b.words) for b in out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str | None, frozenset] = {}
        texts = []
        for host, source, template in zip(*(batch.column(i) for i in range(2, 5))):
            host = host.as_py()
            if host not in known:
                known[host] = frozenset(template.as_py() or ())
            texts.append(article_text(source.as_py() or "", known[host]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", **settings) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html")
    ).withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    known = cut(templates(rows, **settings))
    joined = with_classes(rows.select("page_id", "url", "host", "html"), known, "template")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
