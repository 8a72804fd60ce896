"""Main text of web pages by differencing each page with its nearest neighbours.

Pages of one host are put in order of their URL path. The text lines of a page are aligned with those of the
page before it, and of the page after it, by longest common subsequence; lines that both pages have are the site's
own and are deleted, as are lines in elements made for something else than text (menus, forms, adverts, comments).
A page that marks its article, or else its main part, keeps nothing else. Within that part a line goes if the page
before and the page after both have it in the same place, among the first or the last lines of theirs, and most
different pages of the host have it there, unless it is a heading or two of the three are copies: articles are copied,
quote each other and share headlines, while what a site puts into its articles stands at the head or foot of most of them.

Pages are parsed where they lie; what is shuffled is compressed lines, in ranges of host and path, so a host
of any size is spread over many tasks. A task holds three pages at a time, and ids and URLs of pages with equal lines.
"""

from __future__ import annotations

import heapq
import html
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortspan.llm.common import partitions
from cohortspan.llm.url_filter import host_of, path_of
from cohortspan.sources.staging import stage

# Element names of HTML and the roles and class words by which pages mark their parts.
UNSEEN = "script style noscript template title textarea select iframe object svg math canvas video audio".split()
ASIDE = "nav header footer aside form menu dialog button".split()
ASIDE_ROLES = "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split()
ASIDE_WORDS = """
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar
    header masthead footer sidebar aside widget widgets related recommended
    cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login
    comment comments commentlist discussion disqus reply replies respond share sharing social
""".split()
BLOCKS = """
    address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead tr ul
""".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()

_UNSEEN, _ASIDE, _ROLES, _WORDS, _BLOCKS, _VOID = map(frozenset, (UNSEEN, ASIDE, ASIDE_ROLES, ASIDE_WORDS, BLOCKS, VOID))
# A "<" that opens no tag, comment or declaration is text.
_MARKUP = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?|<[a-zA-Z][^<]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

# Class words that name the head of an article as well as that of a page.
_HEADS = frozenset(("header", "masthead", "banner"))

#: What a line is: in a marked article, in the marked main part of a page, in an element that is not text, or neither.
IN_ARTICLE, IN_MAIN, IN_ASIDE, OPEN = range(4)
#: Added to the kind of a heading in a marked part.
HEADING = 8
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _part(name: str, attributes: str, in_article: bool) -> int:
    """What an element says of its text; OPEN if nothing."""
    if name in _ASIDE and not (name == "header" and in_article):
        return IN_ASIDE
    kind = IN_ARTICLE if name == "article" else IN_MAIN if name == "main" else OPEN
    unlike_text = _WORDS - _HEADS if in_article else _WORDS
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return IN_ASIDE
        if key in ("class", "id") and name not in ("body", "html", "main") and unlike_text & set(re.split(r"[^a-z0-9]+", value)):
            return IN_ASIDE
        if (key, value) in (("role", "article"), ("itemprop", "articlebody")):
            kind = IN_ARTICLE
        elif (key, value) == ("role", "main") and kind == OPEN:
            kind = IN_MAIN
    return kind


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """Kind and text of each block with text, in page order: references decoded, white space runs one space, trimmed.

    Elements left open end with the page, or where an element around them ends. A br is white space.
    """
    if not page:
        return []
    lines: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that say something of their text
    kind, at, heading = OPEN, 0, False

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            lines.append((kind + HEADING if heading and kind in (IN_ARTICLE, IN_MAIN) else kind, text))

    while True:
        found = _MARKUP.search(page, at)
        held.append(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        if not found[2]:
            continue
        name = found[2].lower()
        if name in _UNSEEN and not found[1]:
            if not found[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in _BLOCKS:
            flush()
            heading = name in _HEADINGS and not found[1]
        if found[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name not in _VOID:
            # Every element of a name that is on the stack goes on it too, so that the right end tag closes it.
            said = _part(name, found[3], any(k in (IN_ARTICLE, IN_MAIN) for _, k in stack))
            if said != OPEN or any(n == name for n, _ in stack):
                if name not in _BLOCKS and said == IN_ASIDE:
                    flush()
                stack.append((name, said))
        else:
            continue
        kinds = {k for _, k in stack}
        new = next((k for k in (IN_ASIDE, IN_ARTICLE, IN_MAIN) if k in kinds), OPEN)
        if new != kind:
            flush()
            kind = new
    flush()
    return lines


#: Bits of the table that an alignment may take; longer pages are cut in two where a longest alignment can be cut.
TABLE_BITS = 1 << 28
#: Lines of the second page that one pass over the first takes at a time, which bounds its memory.
BLOCK = 8192


def common_lines(a: Sequence, b: Sequence) -> set[int]:
    """Indexes into ``a`` of one longest common subsequence of ``a`` and ``b``, of any length (Hirschberg's cuts)."""
    shared: set[int] = set()
    todo = [([*range(len(a))], [*b])]
    while todo:
        at, second = todo.pop()
        lead = 0
        while lead < min(len(at), len(second)) and a[at[lead]] == second[lead]:
            lead += 1
        tail = 0
        while tail < min(len(at), len(second)) - lead and a[at[-1 - tail]] == second[-1 - tail]:
            tail += 1
        shared.update(at[:lead], at[len(at) - tail :])
        at, second = at[lead : len(at) - tail], second[lead : len(second) - tail]
        # A line that only one of them has is in no alignment.
        both = {a[i] for i in at}.intersection(second)
        at, second = [i for i in at if a[i] in both], [x for x in second if x in both]
        first = [a[i] for i in at]
        if len(first) == 1:
            shared.add(at[0])
        elif len(first) * len(second) <= TABLE_BITS:
            shared.update(at[i] for i in _aligned(first, second))
        else:
            half = len(first) // 2
            gains = _lengths(first[:half], second) + _lengths(first[half:][::-1], second[::-1])[::-1]
            cut = int(np.argmax(gains))
            todo += [(at[:half], second[:cut]), (at[half:], second[cut:])]
    return shared


def _places(lines: Sequence) -> dict:
    """Where each line is, as bits."""
    places: dict = {}
    for j, x in enumerate(lines):
        places[x] = places.get(x, 0) | 1 << j
    return places


def _aligned(first: Sequence, second: Sequence) -> Iterator[int]:
    """Indexes into ``first`` of one longest common subsequence, by a table."""
    places = _places(second)
    # Bit j of a row is 0 where the subsequence grows with second[j]; one addition handles a whole row.
    rows, row, full = [], (1 << len(second)) - 1, (1 << len(second)) - 1
    for x in first:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
        rows.append(row)
    i, j = len(first) - 1, len(second) - 1
    while i >= 0 and j >= 0:
        if rows[i] >> j & 1:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            yield i
            i, j = i - 1, j - 1


def _lengths(first: Sequence, second: Sequence) -> np.ndarray:
    """Length of the longest common subsequence of ``first`` and the first j lines of ``second``, for j from 0 on.

    The last row of the table, made block by block of ``second``: what an addition carries goes on to the next block.
    """
    grows, carried = [np.zeros(1, np.int64)], bytearray(len(first))
    for begin in range(0, len(second), BLOCK):
        block = second[begin : begin + BLOCK]
        places, size = _places(block), len(block)
        row = full = (1 << size) - 1
        for i, x in enumerate(first):
            met = row & places.get(x, 0)
            total = row + met + carried[i]
            carried[i] = total >> size
            row = (total | (row - met)) & full
        bits = np.frombuffer(row.to_bytes((size + 7) // 8, "little"), np.uint8)
        grows.append(1 - np.unpackbits(bits, count=size, bitorder="little").astype(np.int64))
    return np.cumsum(np.concatenate(grows))


#: Neighbours' parts that share this much of the characters of the smaller one are copies of each other.
COPIED = 0.5


def _marked(lines: list[tuple[int, str]]) -> int | None:
    """By what kind of line a page marks its text, if it does."""
    kinds = {kind % HEADING for kind, _ in lines}
    return next((k for k in (IN_ARTICLE, IN_MAIN) if k in kinds), None)


def _part_of(lines: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The lines that a page marks as its text, or else those in no element made for something else."""
    marked = _marked(lines)
    return [(kind, t) for kind, t in lines if kind % HEADING == (OPEN if marked is None else marked)]


def _shared_unless_copied(a: list[str], b: list[str]) -> set[int] | None:
    """Indexes into ``a`` of the lines it shares with ``b``; none if one is a copy of the other or of most of it."""
    shared = common_lines(a, b)
    size = min(sum(map(len, a)), sum(map(len, b)))
    return None if sum(len(a[i]) for i in shared) >= COPIED * size else shared


#: Lines from the start and from the end of a marked part among which a site's own are looked for.
PLACES = 3
#: Different pages a host needs for most of them to say something.
LEAST_PAGES = 3


def _place_hash(text: str, place: int) -> int:
    """A line in its place, counted from the start, or from the end as -1, -2 and so on, as a signed number."""
    return int.from_bytes(xxhash.xxh3_64_digest(f"{place} {text}".encode()), "big", signed=True)


def _placed(part: list[tuple[int, str]]) -> dict[int, set[int]]:
    """For the index of each line near the start or the end of a part, and no heading, its hashes in these places."""
    out: dict[int, set[int]] = {}
    for place in (*range(min(PLACES, len(part))), *range(-min(PLACES, len(part)), 0)):
        kind, text = part[place]
        if kind < HEADING:
            out.setdefault(place % len(part), set()).add(_place_hash(text, place))
    return out


def _site_lines(part: list[tuple[int, str]], neighbours: list[list[tuple[int, str]]], usual: frozenset[int]) -> set[int]:
    """Indexes of the lines of a marked part that both neighbours have in the same place and that are ``usual`` there.

    None if any two of the three are copies of each other.
    """
    if len(neighbours) < 2:
        return set()
    theirs = [set().union(*_placed(other).values()) for other in neighbours]
    places = {i: hashes & usual for i, hashes in _placed(part).items()}
    places = {i for i, hashes in places.items() if hashes & theirs[0] & theirs[1]}
    if not places:
        return set()
    own, one, two = ([t for _, t in lines] for lines in (part, *neighbours))
    first, second = _shared_unless_copied(own, one), _shared_unless_copied(own, two)
    if first is None or second is None or _shared_unless_copied(one, two) is None:
        return set()
    return places & first & second


def main_text(lines: list[tuple[int, str]], neighbours: Sequence[list[tuple[int, str]]], usual: frozenset[int] = frozenset()) -> str:
    """The lines that are left, joined by empty lines. ``neighbours`` are the lines of pages to differ from.

    Without a mark, a line shared with any neighbour goes. In a marked part, one in the same place of two neighbours
    does if it is ``usual`` on the host.
    """
    texts = [t for _, t in lines]
    others = [other for other in neighbours if [t for _, t in other] != texts]
    if _marked(lines) is None:
        shared = set().union(*(common_lines(texts, [t for _, t in other]) for other in others))
        return "\n\n".join(text for i, (kind, text) in enumerate(lines) if kind == OPEN and i not in shared)
    part = _part_of(lines)
    site = _site_lines(part, [_part_of(other) for other in others], usual)
    return "\n\n".join(text for i, (_, text) in enumerate(part) if i not in site)


def _digest(lines: list[tuple[int, str]]) -> bytes:
    return xxhash.xxh3_128_digest(json.dumps([t for _, t in lines]).encode())


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        parsed = [lines_of(page) for page in batch["html"]]
        packed = [pack.compress(json.dumps(lines).encode()) for lines in parsed]
        yield batch.drop(columns="html").assign(digest=[_digest(lines) for lines in parsed], lines=packed)


#: Of each range the first and the last pages so many, of different lines, are known: one to be sent and one to differ from.
ENDS = 2


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the first parse is for, in two kinds of rows, of which the second have no cell.

    cell, host, digest, low and high: where the equal pages begin and end that come first or last of this task's pages in a
    cell. host, digest and places of each page that marks its text: the lines at its head and foot.
    """
    cells: dict[int, dict[tuple, list[str]]] = {}

    def prune(known: dict[tuple, list[str]]) -> dict[tuple, list[str]]:
        first = heapq.nsmallest(ENDS, known, key=lambda k: (known[k][0], k[1]))
        return {k: known[k] for k in {*first, *heapq.nlargest(ENDS, known, key=lambda k: (known[k][1], k[1]))}}

    columns = ["cell", "host", "digest", "low", "high", "places"]
    for batch in batches:
        marked = []
        for row in batch.itertuples(index=False):
            known, lines = cells.setdefault(row.cell, {}), lines_of(row.html)
            digest = _digest(lines)
            if _marked(lines) is not None:
                marked.append((None, row.host, digest, None, None, sorted(set().union(*_placed(_part_of(lines)).values()))))
            ends = known.setdefault((row.host, digest), [row.key, row.key])
            ends[:] = min(ends[0], row.key), max(ends[1], row.key)
            if len(known) > 16 * ENDS:
                cells[row.cell] = prune(known)
        if marked:
            yield pd.DataFrame(marked, columns=columns).astype({"cell": "Int32"})
    rows = [(cell, *k, *ends, None) for cell, known in cells.items() for k, ends in prune(known).items()]
    yield pd.DataFrame(rows, columns=columns).astype({"cell": "Int32"})


def _usual(marked: DataFrame) -> DataFrame:
    """(host, usual): the lines in their places that most different pages of a host have, a few for each host."""
    # Copies count once; a host's pages are counted apart before they meet.
    pages = marked.groupBy("host", "digest").agg(F.any_value("places").alias("places"))
    pages = stage(pages.select(F.coalesce("host", F.lit("")).alias("host"), "places"), "page-places")
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).where(F.col("n_pages") >= LEAST_PAGES)
    lines = pages.select("host", F.explode("places").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    most = lines.join(total, "host").where("2 * n > n_pages")
    return stage(most.groupBy("host").agg(F.collect_list("line").alias("usual")), "page-usual")


def _guests(ends: DataFrame) -> dict[str, list[int]]:
    """Keys of pages that are neighbours of pages in other ranges, and those ranges, from what ``_edges`` found.

    The neighbour of the pages at a border is the nearest of other lines, however many ranges of equal ones lie between.
    """
    # Staged, as both ends are taken from it.
    groups = stage(ends.where("cell IS NOT NULL").groupBy("cell", "host", "digest").agg(F.min("low").alias("low"), F.max("high").alias("high")), "page-ends")
    by = Window.partitionBy("cell")
    low = groups.withColumn("n", F.row_number().over(by.orderBy("low", "digest"))).where(f"n <= {ENDS}").selectExpr("cell", "true AS is_low", "n", "host", "digest", "low AS key")
    high = groups.withColumn("n", F.row_number().over(by.orderBy(F.desc("high"), F.desc("digest")))).where(f"n <= {ENDS}").selectExpr("cell", "false AS is_low", "n", "host", "digest", "high AS key")
    found: dict[bool, dict[int, list]] = {True: {}, False: {}}
    for r in sorted(low.union(high).collect(), key=lambda r: r["n"]):
        found[r["is_low"]].setdefault(r["cell"], []).append(r)
    guests: dict[str, list[int]] = {}
    cells = sorted(found[True])
    # Going right, the last pages of the ranges behind are neighbours of the first of the next one; going left, the other way round.
    for order, behind, ahead in ((cells, found[False], found[True]), (cells[::-1], found[True], found[False])):
        last: list = []  # the nearest pages behind, of different lines
        for cell in order:
            own = ahead[cell][0]
            near = next((r for r in last if (r["host"], r["digest"]) != (own["host"], own["digest"])), None)
            if near is not None and near["host"] == own["host"]:
                guests.setdefault(near["key"], []).append(cell)
            have = {(r["host"], r["digest"]) for r in behind[cell]}
            last = (behind[cell] + [r for r in last if (r["host"], r["digest"]) not in have])[:ENDS]
    return guests


#: Characters of text that are returned at once, about, and rows.
RETURNED, ROWS = 4_000_000, 10_000


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of pages sorted by cell, key and digest. Ids and URLs of a run of equal pages are held until it ends."""
    unpack = zstandard.ZstdDecompressor()
    node: tuple | None = None  # cell, host and digest of the run
    run: dict[bytes, list[tuple]] = {}  # its own pages by their lines, as what marks them may differ
    before: list[tuple[int, str]] | None = None  # lines of the last page of this host before the run
    last: bytes = b""
    usual: frozenset[int] = frozenset()  # of the host of the run

    def read(packed: bytes) -> list[tuple[int, str]]:
        return [tuple(x) for x in json.loads(unpack.decompress(packed))]

    def texts(after: list[tuple[int, str]] | None) -> Iterator[tuple]:
        for packed, pages in run.items():
            text = main_text(read(packed), [x for x in (before, after) if x is not None], usual)
            yield from ((*page, text) for page in pages)

    def held() -> Iterator[tuple]:
        nonlocal node, before, last, usual
        for batch in batches:
            for row in batch.itertuples(index=False):
                here = (row.cell, row.host, row.digest)
                if here != node:
                    near = node is not None and node[:2] == here[:2]
                    yield from texts(read(row.lines) if near else None)
                    before = read(last) if near else None
                    node, usual = here, frozenset(() if row.usual is None else map(int, row.usual))
                    run.clear()
                last = row.lines
                if not row.guest:
                    run.setdefault(row.lines, []).append((row.page_id, row.url))
        yield from texts(None)

    found, size = [], 0
    for row in held():
        found.append(row)
        size += len(row[2])
        if size > RETURNED or len(found) == ROWS:
            yield _frame(found)
            found, size = [], 0
    yield _frame(found)


def _frame(found: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(found, columns=["page_id", "url", "text"]).astype({"page_id": "Int64"})
    return frame.assign(n_chars=frame["text"].str.len().astype("int64"))


#: Keys sampled for each range of pages, about.
SAMPLED = 32


def extract(pages: DataFrame, cells: int | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text. Pages without a host are neighbours of each other. Pages with equal
    lines are no help to each other; the last page before them that differs is, and the next one after them, in whatever
    range it lies. Pages of equal path follow each other by page_id; repeated rows are extracted each.
    """
    cells = cells or 4 * partitions(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    number = F.lpad(F.coalesce(F.col("page_id") + F.lit(2**62), F.lit(0)).cast("string"), 20, "0")
    keyed = rows.select("*", host.alias("host"), F.concat_ws("\u0001", host, path, number).alias("key"))
    keys = keyed.select("key")
    # About so many keys for each range reach the driver, picked by their hash.
    spacing = max(1, keys.count() // (SAMPLED * cells))
    sample = sorted(r["key"] for r in keys.where(F.pmod(F.xxhash64("key"), F.lit(spacing)) == 0).distinct().collect())
    bounds = sorted({sample[len(sample) * i // cells] for i in range(1, cells)}) if sample else []
    cell = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col("key"))) if bounds else F.lit(0)
    # Pages are parsed twice, first for where lines change at the borders: a page's neighbour may be some ranges away.
    ends = keyed.select(cell.alias("cell"), "host", "key", "html")
    ends = ends.mapInPandas(_edges, "cell int, host string, digest binary, low string, high string, places array<long>")
    ends = stage(ends, "page-lines")
    guests = _guests(ends)
    usual = _usual(ends.where("cell IS NULL").select("host", "digest", "places")).withColumnRenamed("host", "usual_host")
    also = F.array().cast("array<int>")
    if guests:
        at = F.array_position(F.array(*map(F.lit, guests)), F.col("key")).cast("int")
        also = F.when(at > 0, F.element_at(F.array(*[F.array(*map(F.lit, v)) for v in guests.values()]), F.greatest(at, F.lit(1)))).otherwise(also)
    parsed = keyed.withColumn("cell", cell).withColumn("also", also)
    schema = "page_id long, url string, host string, key string, cell int, also array<int>, digest binary, lines binary"
    parsed = parsed.select("page_id", "url", "host", "key", "cell", "also", "html").mapInPandas(_parse, schema)
    own = F.array(F.struct(F.col("cell").alias("cell"), F.lit(False).alias("guest")))
    others = F.transform("also", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("guest")))
    # A few lines for each host: Catalyst sends them to all tasks while the table is small.
    parsed = parsed.join(usual, F.coalesce("host", F.lit("")) == F.col("usual_host"), "left")
    placed = parsed.select("page_id", "url", "host", "key", "digest", "lines", "usual", F.explode(F.concat(own, others)).alias("place"))
    dealt = (
        placed.select("page_id", "url", "host", "key", "digest", "lines", "usual", "place.cell", "place.guest")
        .repartition(partitions(pages), "cell")
        .sortWithinPartitions("cell", "key", "digest", "lines")
        .drop("key")
    )
    return dealt.mapInPandas(_difference, "page_id long, url string, text string, n_chars long")
