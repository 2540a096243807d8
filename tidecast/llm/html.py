"""Main text of web pages: markup blocks, then differencing against the page with the nearest URL."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidecast.llm.tables import boxed, unboxed
from tidecast.session import materialize

_RAW = "script style noscript template textarea title iframe svg math object canvas".split()
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(_RAW)})(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
#: Elements that hold no article text.
_AWAY = frozenset("nav header footer aside form button select menu dialog fieldset head".split())
#: Whole class, id and role names that mark such parts, too; other names are left to differencing.
_AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu menubar "
    "breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended comment comments reply replies disqus "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup share sharing social form search login "
    "contentinfo complementary pagination pager".split()
)
#: Elements that begin and end a block; text inside a block is joined as it stands.
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element: ``p`` and ``head`` end at any block, the others at these.
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"},
}
_COMMENTS = frozenset("comment comments reply replies disqus".split())
#: What the markup says of a line.
OPEN, MAIN, AWAY = 0, 1, 2


def _is_away(tag: str, attrs: str, inside: bool) -> bool:
    if tag in ("html", "body", "main"):
        return False
    if tag in _AWAY and not (tag == "header" and inside):  # the header of an article holds its title
        return True
    names = _COMMENTS if tag == "article" else _AWAY_NAMES
    return any(not names.isdisjoint(m[2].strip("\"'").lower().split()) for m in _ATTR.finditer(attrs))


class _Element:
    """An open element. ``number``: of an article, below 0 of a main element, else 0. ``ends``: an element of no article text
    holds all lines to its end if its end tag comes, else those before the first article or main element in it."""

    __slots__ = ("away", "closed", "ends", "number", "tag")

    def __init__(self, tag: str, away: bool, number: int):
        self.tag, self.away, self.number, self.closed, self.ends = tag, away, number, False, None


def text_lines(html: str) -> list[tuple[int, str, list[int]]]:
    """The lines (blocks of text) of a page in order, each as ``MAIN`` (inside an article or main element), ``AWAY``
    (inside an element that is named as no article text) or ``OPEN``, with the numbers of the article (above 0) and main
    elements (below 0) around it. An end tag ends the elements left open inside its own, as in browsers."""
    lines: list[tuple[str, list[int], list[_Element]]] = []
    parts: list[str] = []
    stack: list[_Element] = []
    mains: list[int] = []
    aways: list[_Element] = []
    opened: Counter[str] = Counter()
    numbers, at = 0, 0

    def flush() -> None:
        if text := " ".join(unescape("".join(parts)).split()):
            lines.append((text, [*mains], [*aways]))
        parts.clear()

    def end(tag: str) -> None:
        while stack:
            e = stack.pop()
            opened[e.tag] -= 1
            if e.away:
                flush()
                aways.pop()
            if e.number:
                mains.pop()
            if e.tag == tag:
                e.closed = True
                return

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        if m["raw"]:
            flush()
        if not (tag := (m["tag"] or "").lower()):
            continue
        block = tag in _BLOCKS
        if block:
            flush()
        if m["end"]:
            # an inline element ends inside its block only
            if opened[tag] and (block or next(e.tag for e in reversed(stack) if e.tag == tag or e.tag in _BLOCKS) == tag):
                end(tag)
            continue
        if tag in _VOID:
            continue
        while block and stack:
            last = next((e.tag for e in reversed(stack) if e.tag in _BLOCKS), "")
            if last not in ("p", "head") and tag not in _ENDED_BY.get(last, ()):
                break
            end(last)
        away = _is_away(tag, m["attrs"], bool(mains))
        # inline elements count where they may hold or end a part of no article text
        if not (block or away or opened[tag]):
            continue
        if away:
            flush()
        number = 0
        if tag in ("article", "main") and not away:
            numbers += 1
            number = numbers if tag == "article" else -numbers
            mains.append(number)
            for e in aways:
                e.ends = len(lines) if e.ends is None else e.ends
        e = _Element(tag, away, number)
        stack.append(e)
        opened[tag] += 1
        if away:
            aways.append(e)
    parts.append(html[at:])
    flush()
    out = []
    for i, (text, around, parts_away) in enumerate(lines):
        away = any(e.closed or e.ends is None or i < e.ends for e in parts_away)
        out.append((AWAY if away else MAIN if around else OPEN, text, around))
    return out


def shared(a: list[int], b: list[int]) -> set[int]:
    """Places of ``a`` in a longest common subsequence of ``a`` and ``b``."""
    where: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        where.setdefault(b[j], []).append(j)
    tails: list[int] = []
    nodes: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = set(), nodes[-1] if nodes else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def main_text(lines: list[tuple[int, str, list[int]]], repeated: set[int] | None) -> str:
    """Join what differencing and markup leave; ``repeated`` holds the lines of a neighbour, None without one.

    Lines of elements named as no article go. Of the others, those stay that the neighbour lacks. An article is one text:
    it stays or goes as a whole, and goes only if the neighbour has all of it and it is shorter than the page's own lines
    (a teaser, a notice); a copy of a long article is an article, and a paragraph that two articles share is part of
    both. A main element may wrap boilerplate, so its shared lines go one by one, unless all of it is shared and it is no
    shorter than the page's own lines. A page without any own line or such an element is a copy, too, and keeps all.
    Without a neighbour the markup alone decides: an article element closes out what stands around it.
    """
    kept = [i for i, (kind, *_) in enumerate(lines) if kind != AWAY]
    inside = [i for i in kept if lines[i][0] == MAIN]
    if repeated is None:
        stay = set(inside or kept)
    else:
        stay = {i for i in kept if i not in repeated}
        own = sum(len(lines[i][1]) for i in stay)
        elements: dict[int, list[int]] = {}
        for i in inside:
            for number in lines[i][2]:
                elements.setdefault(number, []).append(i)
        for number, places in elements.items():
            copied = repeated.issuperset(places)
            if sum(len(lines[i][1]) for i in places) >= own if copied else number > 0:
                stay.update(places)
        stay = stay or set(kept)
    return " ".join(lines[i][1] for i in kept if i in stay)


_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page with ``text`` (its main text) and ``n_chars`` (code points of it) added, without its html.

    Pages of one host are ordered by the path of their URL, and each is compared with the neighbour whose path agrees
    with its own the longest: lines in a longest common subsequence of both are shared (see ``main_text``). The order is
    global, by ranges of host and path, so a host of any size is spread over many tasks. Only identifiers
    of lines are ordered and paired; lines travel once, packed, to meet those of the neighbours. Null or empty html gives an
    empty text; a null URL has no neighbour; pages that agree in URL and html are one page here, but every row gets its text. Columns
    named ``text`` or ``n_chars`` are replaced. An empty table gives an empty result.
    """
    rest = pages.drop(html_col, "text", "n_chars")
    url, page = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    split = pages.select(
        boxed(rest),
        F.lower(F.regexp_extract(url_col, _HOST, 1)).alias("_host"),
        F.regexp_replace(F.regexp_replace(url_col, _HOST, ""), r"[?#].*$", "").alias("_path"),
        F.xxhash64(url, page).alias("_k1"),
        F.xxhash64(page, F.lit(1), url).alias("_k2"),
        page.alias("_html"),
    )
    key = ["_k1", "_k2"]

    def line_ids(lines: list[tuple[int, str, list[int]]]) -> list[int]:
        return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for _, t, _ in lines]

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [line_ids(text_lines(x)) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int64()))], names=["_host", "_path", *key, "_ids"])

    slim = split.where("_path IS NOT NULL").select("_host", "_path", *key, "_html")
    slim = slim.mapInArrow(identify, "_host string, _path string, _k1 long, _k2 long, _ids array<long>")
    known = materialize(slim.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("_host", "_path", "_ids")]), "pages")
    ordered = (
        known.repartitionByRange("_host", "_path", *key)
        .sortWithinPartitions("_host", "_path", *key)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    ordered = materialize(ordered, "ordered").withColumns({"_part": F.shiftright("_at", 33), "_at": F.expr("_at & ((1L << 33) - 1)")})
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a written partition
    firsts = ordered.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = ordered.join(firsts, "_part").withColumn("_rank", F.col("_first") + F.col("_at"))
    a, b = ranked.alias("a"), ranked.alias("b")
    beside = a.join(b, (F.col("a._rank") + 1 == F.col("b._rank")) & (F.col("a._host") == F.col("b._host")))
    one = beside.select("a._k1", "a._k2", F.struct("b._path", "b._ids").alias("other"))
    two = beside.select("b._k1", "b._k2", F.struct("a._path", "a._ids").alias("other"))
    others = one.unionByName(two).groupBy(*key).agg(F.sort_array(F.collect_list("other")).alias("_others"))
    others = materialize(others, "neighbours")

    lines = T.StructType([*split.select("_row", "_path", *key).schema.fields]).add("_lines", "binary")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zstandard.compress(json.dumps(text_lines(x), ensure_ascii=False).encode(errors="surrogatepass"), 3) for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=lines.names)

    parsed = split.select("_row", "_path", *key, "_html").mapInArrow(parse, lines)
    joined = parsed.join(others, key, "left").select("_row", "_path", "_lines", "_others")
    result = T.StructType(joined.select("_row").schema.fields).add("text", "string").add("n_chars", "long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, packed, near in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                own = json.loads(zstandard.decompress(packed))
                other = max(near or [], key=lambda o: _common(path, o["_path"]), default=None)
                texts.append(main_text(own, shared(line_ids(own), other["_ids"]) if other else None))
            new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], names=result.names)

    return joined.mapInArrow(compare, result).select(*unboxed(rest), "text", "n_chars")
