"""Main text of web pages by equivalence-class template deduction.

A page is a series of tokens: its tags with their class or id, and its stretches of text. Two tokens of the pages of one
host belong to one equivalence class if they occur equally often on every page. A class that is large and frequent
enough and whose tokens keep one order on the page is valid; valid classes nest into the host's template. What lies
between two template tokens is a slot. The text is that of the slots in the article; page furniture is told by the
template tokens around a slot and by the roles of elements inside it. Inside an article a repeated text goes if an
element with a class, id or role around it belongs to the same valid class, as shared passages do not repeat with an
element of their own; it stays if most of the article repeats, as it does in copies.

Occurrence vectors are never gathered: a vector is kept as the exclusive or of a hash for each page and count, next to its
support, so partial aggregation shrinks hosts of any size before the shuffle, and a class is a group of equal hashes.

Defined cases: null html is empty; a page without text gives the empty string; a null url is a host of its own; a host
with one page has no template, so elements' roles alone decide; repeated rows give one row each (and their occurrence
hashes may cancel, which only weakens the template); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import map_arrow, stored, table

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "button", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form dialog menu head".split())
HOLDERS = frozenset(("article", "main"))
_FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|header|masthead|footer|side-?bar|ads?|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|newsletter|subscri\w+|comments?|respond|disqus|related|share|sharing|social|breadcrumbs?|pop-?up|modal|login|signup|search|pagination|widget)(?:$|[\s_-])",
    re.I,
)
_TOPICS = frozenset("alert notice related search share sharing".split())  # listed words that articles are about, too
_HEADINGS = frozenset("header h1 h2 h3 h4 h5 h6".split())  # an article's own parts, whatever their names
_BODY_NAME = re.compile(r"(?:^|[\s_-])(?:main|article|content|post|entry|story)(?:$|[\s_-])", re.I)
_ends = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
MIN_PAGES = 2  # of a host, for a template
SUPPORT = 0.5  # share of a host's pages that a class must occur on
MIN_CLASS = 2  # tokens of a class
MIN_INSIDE = 3  # pages of a class that drops text inside an article


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, value): open or close with tag and class names, text with its text, in page order."""
    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                yield "text", "", entities.escape(m[0][9:].removesuffix("]]>"))
            continue
        name = m[2].lower()
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, " ".join(a or b or c for a, b, c in _NAMED.findall(m[3])) if m[3] else ""
        if name in _ends and not m[3].endswith("/"):
            end = _ends[name].search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, ""
    if at < len(page):
        yield "text", "", page[at:]


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def key_of(kind: str, name: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind} {name} {value if kind != 'text' else clean(value)}".encode("utf-8", "surrogatepass")) - (1 << 63)


def occurrences(page: str) -> Counter[int]:
    """How often each token occurs on a page; blank text is no token."""
    return Counter(key_of(*t) for t in tokens(page) if t[0] != "text" or not t[2].isspace())


def templates(pages: DataFrame) -> DataFrame:
    """host and its template tokens, each with its class; pages has id, host and html."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[int]] = {}

        def out() -> pa.RecordBatch:
            ks, vs = list(held), list(held.values())
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in ks], pa.string()), pa.array([k[1] for k in ks], pa.int64()), *[pa.array([v[j] for v in vs], pa.int64()) for j in range(3)]], names=["host", "token", "vector", "support", "total"]
            )

        for batch in batches:
            for i, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = occurrences(page.as_py() or "")
                found[0] = 1  # the page itself
                for token, n in found.items():
                    v = held.setdefault((host, token), [0, 0, 0])
                    v[0] ^= xxhash.xxh64_intdigest(f"{i} {n}") - (1 << 63)
                    v[1] += 1
                    v[2] += n
                if len(held) > 200_000:
                    yield out()
                    held.clear()
        yield out()

    counted = map_arrow(pages, count, "host string, token bigint, vector bigint, support bigint, total bigint").groupBy("host", "token").agg(
        F.bit_xor("vector").alias("vector"), F.sum("support").alias("support"), F.sum("total").alias("total")
    )
    often = stored(counted.where(F.col("support") >= MIN_PAGES), "counted")  # most stretches of text occur on one page only
    size = often.where("token = 0").select(F.col("host").alias("of"), F.col("support").alias("pages"))
    frequent = often.where("token <> 0").join(size, F.col("host").eqNullSafe(F.col("of"))).where(F.col("support") >= SUPPORT * F.col("pages"))
    # tokens on at least half of a host's pages: no more than two pages' worth
    classes = frequent.groupBy("host", "vector").agg(F.collect_list("token").alias("tokens"), F.max("support").alias("support"), F.max("total").alias("total")).where(F.size("tokens") >= MIN_CLASS)
    return classes.groupBy(F.col("host").alias("of")).agg(F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("rank"), "total", "support", "tokens"))).alias("classes"))


def template_tokens(page: list[tuple[str, str, str]], classes: list[dict]) -> dict[int, int]:
    """Positions of a page's tokens that the host's template holds there, each with the number of its class.

    Classes come by the pages that have them, most first, and then by their occurrences, fewest first: from the outside
    inward. The tokens of a class must keep one order in each of its rounds on the page, and a
    class of repeated tokens must repeat in turn. A round must nest with every round of the classes before it: beside it,
    or as a whole in one slot of it, or around it with the earlier round as a whole in one slot. A class of which a round
    does not is not valid on this page.
    """
    at: dict[int, list[int]] = {}
    for p, t in enumerate(page):
        at.setdefault(key_of(*t), []).append(p)
    taken: dict[int, int] = {}
    before: dict[int, tuple[int, ...]] = {}  # by position, the round of a valid class that holds it
    order: list[int] = []  # its positions
    for number, c in enumerate(classes):
        spots = sorted((at.get(t, []) for t in c["tokens"]), key=lambda x: x[:1])
        if not all(spots) or len({len(x) for x in spots}) != 1:
            continue
        rounds = list(zip(*spots, strict=True))
        if any(list(r) != sorted(r) for r in rounds) or any(a[-1] >= b[0] for a, b in zip(rounds, rounds[1:], strict=False)):
            continue
        # a round without a token between the ends of r has r beside it or in one slot
        if all(nests(r, other) for r in rounds for other in {before[p] for p in order[bisect(order, r[0]) : bisect(order, r[-1])]}):
            taken.update((p, number) for r in rounds for p in r)
            before.update((p, r) for r in rounds for p in r)
            order = sorted(before)
    return taken


def nests(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether one of two overlapping rounds of sorted positions lies in one slot of the other."""
    return bisect(a, b[0]) == bisect(a, b[-1]) or bisect(b, a[0]) == bisect(b, a[-1])


def furniture_inside(name: str, value: str, repeated: bool) -> bool:
    """Whether an element inside an article is furniture by its class, id or role.

    Headings, headers and stretches of a line never are. Of others a listed word that is a whole name (`comments`) is a
    role; a part of a name (`share-prices`) or a word that may be a topic says so only of an element that the template
    repeats.
    """
    if name in _HEADINGS or name in INLINE:
        return False
    listed = [v for v in value.lower().split() if _FURNITURE_NAME.search(v.replace("header", ""))]
    return any(repeated or (v not in _TOPICS and _FURNITURE_NAME.fullmatch(v)) for v in listed)


def main_text(page: str, classes: list[dict] | None = None) -> str:
    """The article of a page: blocks of text joined by blank lines."""
    series = list(tokens(page))
    classes = classes or []
    fixed = template_tokens(series, classes)
    has_holder = any(k == "open" and (n in HOLDERS) for k, n, _ in series)
    has_body = not has_holder and any(k == "open" and _BODY_NAME.search(v) and n not in FURNITURE for k, n, v in series if v)
    stack: list[tuple[str, bool, bool, int | None]] = []  # name, furniture, holder, class if named and inside a holder; -1: furniture if the article varies
    blocks: list[list[tuple[str, bool]]] = []
    part: list[tuple[str, bool]] = []  # text, whether the template holds it with an element around it
    furniture = holders = same = varied = 0

    def flush() -> None:
        if part:
            blocks.append(part.copy())
        part.clear()

    for p, (kind, name, value) in enumerate(series):
        if kind == "text":
            inside = holders or not (has_holder or has_body)
            if inside and not furniture and (holders or p not in fixed):
                part.append((value, holders > 0 and any(own == -1 or (p in fixed and own == fixed[p]) for *_, own in stack)))
                if p in fixed:
                    same += len(value.strip())
                else:
                    varied += len(value.strip())
            continue
        if name not in INLINE:
            flush()
        elif name == "br" or name == "img":
            part.append((" ", False))
        if kind == "open":
            if name in VOID:
                continue
            holder = name in HOLDERS or (has_body and bool(value) and bool(_BODY_NAME.search(value)))
            drop = name in RAW or name in FURNITURE or (name == "header" and not holders)
            own = None
            if value and not holder and name not in ("html", "body"):
                if not holders:
                    drop = drop or bool(_FURNITURE_NAME.search(value))
                else:
                    if p in fixed and classes[fixed[p]]["support"] >= MIN_INSIDE:
                        own = -1 if furniture_inside(name, value, True) else fixed[p]
                    drop = drop or furniture_inside(name, value, False)
            stack.append((name, drop, holder, own))
            furniture += drop
            holders += holder
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for _, drop, holder, _ in stack[k:]:
                        furniture -= drop
                        holders -= holder
                    del stack[k:]
                    break
    flush()
    texts = (clean("".join(text for text, repeated in b if not (repeated and same <= varied))) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url and text."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.col(html_col).alias("html"), F.col(url_col).alias("url"))
    known = stored(templates(rows.select("id", "host", "html")), "templates")
    both = rows.join(known, F.col("host") == F.col("of"), "left").select("id", "url", "html", "classes")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, classes in zip(batch.column(2), batch.column(3), strict=True):
                texts.append(main_text(page.as_py() or "", classes.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return map_arrow(both, read, f"id {kind}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
