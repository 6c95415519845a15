"""Main-text extraction by equivalence-class template deduction.

Pages of a host are read in groups of at most ``GROUP_PAGES``. Their tokens
(tags and words, told apart by the end of the path of open elements) are grouped
by their occurrence vectors, the counts in each page. Classes of tokens that
occur in most pages, keep their order and do not overlap are valid; nested by
the gaps they stand in, those with one count in most pages, and so all classes
around them, are the template.

The gaps between consecutive template tokens are the slots. A slot is known by
the token before it and which occurrence that is, so it is the same slot on every
page, and by the template's sections that are open there. The slot that holds most
words over the group's pages is the body of the article; the innermost section
around it that also has a heading, or an article or main element, is the
article. Its slots are extracted; blocks of template words alone are not.

Rules on elements are the check beside that: a block is left out if its element, or
one around it inside the article, is a menu, header, footer, sidebar, notice,
advert, form, script, style or comment section, and where a page has an article
or main element the block must stand in one.

A host of over ``1 / HEAVY_SHARE`` of all pages is salted, so at most that many
hosts are broadcast; every page still takes part in exactly one group. Groups of
under ``LEAST_PAGES`` pages have no template, only the rules on elements. Null
html is empty; null urls form one host; repeated pages give repeated rows; pages
are read whole, whatever their length or depth. Only page_id, url and html are
read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm._base import release, struct

GROUP_PAGES, LEAST_PAGES = 48, 3
#: Share of a group's pages in which a template token occurs, and least tokens of a class.
SUPPORT, LEAST_SIZE = 0.9, 3
#: Hosts with more than this share of all pages are salted.
HEAVY_SHARE = 100_000

# Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("nav header footer aside form button select option menu dialog fieldset head script style noscript template textarea title svg iframe".split())
MAIN = frozenset("article main".split())
SECTIONS = frozenset("article main section div td body".split())
HEADINGS = frozenset("h1 h2".split())
# Words that class and id names of such parts are made of, and words that may stand beside them.
_PARTS_OF_PAGES = r"ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|nav\w*|menus?|breadcrumbs?|header|masthead|footer|side|sidebar|aside|widgets?|toolbar|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|skip\w*"
_BESIDE = r"site|page|main|top|bottom|left|right|inner|outer|sticky|mobile|desktop|global|primary|secondary|box|slot|bar|unit|wrap|wrapper|container|area|section|content|block|body|panel|pane|list|links?|items?|row|col|form|field|button|icons?|text|title|label|image|img|posts?|articles?|stor(?:y|ies)|news|more|to|us|by|google|fb|twitter|[a-z]?\d*"
_HINT = re.compile(rf"(?=.*(?:^|[_-])(?:{_PARTS_OF_PAGES})(?:$|[_-]))(?:(?:{_PARTS_OF_PAGES}|{_BESIDE})(?:$|[_-]+))+$", re.I)

_SCOPE = frozenset("applet button caption html marquee object table td template th".split())
_CELLS, _PARTS = frozenset("td th".split()), frozenset("tbody thead tfoot".split())
#: Elements that end when another of the key's kind opens, and those that shield them.
IMPLIED = {"p": (frozenset(["p"]), _SCOPE), "li": (frozenset(["li"]), _SCOPE | frozenset("ul ol menu".split())), "option": (frozenset(["option"]), _SCOPE | {"select"}), "tr": (frozenset(["tr"]), frozenset(["table"]))}
IMPLIED |= dict.fromkeys(("dd", "dt"), (frozenset("dd dt".split()), _SCOPE | {"dl"})) | dict.fromkeys(_CELLS, (_CELLS, frozenset("tr table".split()))) | dict.fromkeys(_PARTS, (_PARTS, frozenset(["table"])))
ENDS_P = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary ul".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


def hinted(marks: str) -> bool:
    """Whether a class or id name is made of words for such parts: ``related-posts`` is, ``related-work`` is not."""
    return any(_HINT.match(mark) for mark in marks.split())


def events(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): open and close tags and raw text. Comments and the contents of raw elements are left out."""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield "text", source[at:], ""
            return
        if lt > at:
            yield "text", source[at:lt], ""
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif source.startswith(("<!", "<?"), lt):
            end = source.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _TAG.match(source, lt):
            name, at = m[2].lower(), m.end()
            yield "close" if m[1] else "open", name, m[3]
            if not m[1] and name in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = n if end is None else end.end()
                yield "close", name, ""
        elif lt + 1 < n and (source[lt + 1].isalpha() or source[lt + 1] == "/"):
            end = source.find(">", lt)  # a tag whose quotes do not pair
            at = n if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at = lt + 1


@dataclass
class Block:
    """Text between block borders, with its words as tokens of the group."""

    text: str
    main: bool
    aside: bool
    words: list[tuple[str, str]]
    linked: int
    start: int  # of its words among the page's tokens


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tokens: list[tuple[str, str]] = field(default_factory=list)
    has_main: bool = False


def parse(source: str | None) -> Page:
    """Blocks and tokens of a page; broken nesting is closed where an outer element ends or HTML implies it."""
    page = Page()
    stack: list[tuple[str, bool, bool, str]] = []  # name, whether inside main, whether no main text, path
    held: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            main, aside, path = stack[-1][1:] if stack else (False, False, "")
            words = [(path, w) for w in text.split()]
            page.blocks.append(Block(text, main, aside, words, linked, len(page.tokens)))
            page.tokens += words
        linked = 0

    def end(names: frozenset[str], shields: frozenset[str] = frozenset()) -> None:
        if any(held[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    held.subtract(s[0] for s in stack[i:])
                    del stack[i:]
                    return
                if stack[i][0] in shields:
                    return

    for kind, name, rest in events(source or ""):
        if kind == "text":
            text = html.unescape(name)
            parts.append(text)
            if any(s[0] == "a" for s in stack[-3:]):
                linked += len(text)
            continue
        if name not in INLINE:
            flush()
        elif name == "br":
            parts.append(" ")
        if kind == "close":
            end(frozenset([name]), IMPLIED[name][1] if name in IMPLIED else frozenset())
            page.tokens.append((stack[-1][3] if stack else "", f"</{name}>"))
            continue
        marks = " ".join(v for a in _ATTR.findall(rest) for v in a[1:] if v) if "=" in rest else ""
        if name in IMPLIED:
            end(*IMPLIED[name])
        if name in ENDS_P:
            end(*IMPLIED["p"])
        inside, outer, path = stack[-1][1:] if stack else (False, False, "")
        page.tokens.append((path, f"<{name} {marks}>"))
        if name in MAIN:
            page.has_main = True
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        aside = name in ASIDE and not (name == "header" and inside) or bool(marks and name not in ("html", "body", *MAIN) and hinted(marks)) or bool(rest and _HIDDEN.search(rest))
        held[name] += 1
        # What is around an article does not count inside it.
        stack.append((name, inside or name in MAIN, aside or outer and name not in MAIN, f"{path}/{name}"[-160:]))
    flush()
    return page


@dataclass
class EquivalenceClass:
    vector: tuple[int, ...]
    tokens: list[tuple[str, str]]
    spans: list[list[tuple[int, int]]]
    parent: int | None = None


def deduce_template(pages: list[Page]) -> list[EquivalenceClass]:
    """Valid equivalence classes of a group's non-empty pages, nested by ``parent``; none for too few pages."""
    pages = [p for p in pages if p.tokens]
    if len(pages) < LEAST_PAGES:
        return []
    seen = Counter(t for p in pages for t in set(p.tokens))
    frequent = {t for t, n in seen.items() if n >= SUPPORT * len(pages)}
    places: list[dict[tuple[str, str], list[int]]] = []
    for p in pages:
        held = defaultdict(list)
        for i, t in enumerate(p.tokens):
            if t in frequent:
                held[t].append(i)
        places.append(held)
    groups = defaultdict(list)
    for t in frequent:
        groups[tuple(len(h.get(t, ())) for h in places)].append(t)
    out = []
    for vector, tokens in groups.items():
        if len(tokens) < LEAST_SIZE:
            continue
        whole = next(i for i, n in enumerate(vector) if n)
        tokens.sort(key=lambda t, w=whole: places[w][t][0])
        kept = [tokens[0]]
        for t in tokens[1:]:  # the k-th occurrences keep their order, and instances do not overlap
            if all(b > a for h in places for a, b in zip(h.get(kept[-1], ()), h.get(t, ()), strict=True)) and all(b < a for h in places for b, a in zip(h.get(t, ()), h.get(kept[0], ())[1:], strict=False)):
                kept.append(t)
        if len(kept) >= LEAST_SIZE:
            out.append(EquivalenceClass(vector, kept, [list(zip(h.get(kept[0], ()), h.get(kept[-1], ()), strict=True)) for h in places]))
    out.sort(key=lambda c: (-max(b - a for spans in c.spans for a, b in spans), c.tokens[0]))
    for i, inner in enumerate(out):
        for j in range(i - 1, -1, -1):
            if all(any(a <= x and y <= b for a, b in out[j].spans[p]) for p, spans in enumerate(inner.spans) for x, y in spans):
                inner.parent = j
                break
    return out


def is_fixed(vector: tuple[int, ...]) -> bool:
    """Whether tokens of this vector belong to the template: one count, not zero, in ``SUPPORT`` of the pages."""
    return max(Counter(v for v in vector if v).values()) >= SUPPORT * len(vector)


def template_tokens(classes: list[EquivalenceClass]) -> set[tuple[str, str]]:
    """Tokens of the fixed classes that stand in no other than fixed ones; a class comes after the one around it."""
    held: list[bool] = []
    for c in classes:
        held.append(is_fixed(c.vector) and (c.parent is None or held[c.parent]))
    return {t for c, h in zip(classes, held, strict=True) if h for t in c.tokens}


Mark = tuple[tuple[str, str] | None, int]  # a template token and which occurrence in its page


def slots(page: Page, fixed: set[tuple[str, str]]) -> list[tuple[Mark, tuple[Mark, ...]] | None]:
    """The slot of each block: the template token before it, and the template's open sections, outermost first.

    None for blocks of template words alone, which stand in no slot.
    """
    out: list[tuple[Mark, tuple[Mark, ...]] | None] = []
    seen: Counter[tuple[str, str]] = Counter()
    before: Mark = (None, 0)
    around: list[tuple[str, str, Mark]] = []  # path, name and mark of a section
    at = 0

    def step(until: int) -> None:
        nonlocal before, at
        for token in page.tokens[at:until]:
            if token not in fixed:
                continue
            seen[token] += 1
            before = (token, seen[token])
            name = token[1].strip("</>").split(" ", 1)[0]
            if token[1].startswith("<") and name in SECTIONS:
                while around and len(around[-1][0]) >= len(token[0]):  # a section that is over, its end being no template token
                    around.pop()
                if token[1][1] != "/":
                    around.append((token[0], name, before))
        at = max(at, until)

    for block in page.blocks:
        own = next((i for i, w in enumerate(block.words) if w not in fixed), None)
        step(block.start + (len(block.words) if own is None else own))
        out.append(None if own is None else (before, tuple(s[2] for s in around)))
    return out


def _allowed(page: Page, block: Block) -> bool:
    """The rules on elements."""
    if block.aside or page.has_main and not block.main:
        return False
    return page.has_main or 2 * block.linked <= len(block.text)


def article_section(pages: list[Page], of: list[list]) -> Mark | None:
    """The section that holds the heaviest slot and a heading or an article or main element; None if there is none."""
    weight: Counter = Counter()
    for page, found in zip(pages, of, strict=True):
        for block, slot in zip(page.blocks, found, strict=True):
            if slot and _allowed(page, block):
                weight[slot] += len(block.words) * (1 + (not block.linked))
    if not weight:
        return None
    around = max(weight, key=lambda s: (weight[s], repr(s)))[1]
    named = lambda token: token[1].strip("</>").split(" ", 1)[0]
    for section in around:  # an article or main element wins, the outer one first
        if named(section[0]) in MAIN:
            return section
    heading = lambda token: named(token) in HEADINGS or token[0].rpartition("/")[2] in HEADINGS
    headed = {s for slot in weight if slot[0][0] and heading(slot[0][0]) for s in slot[1]}
    return next((s for s in reversed(around) if s in headed), around[-1] if around else None)


def main_texts(pages: list[Page]) -> list[str]:
    """The main text of each page of a group: its blocks in the article's slots, joined by two line feeds."""
    fixed = template_tokens(deduce_template(pages))
    of = [slots(p, fixed) for p in pages]
    section = article_section(pages, of) if fixed else None
    out = []
    for page, found in zip(pages, of, strict=True):
        kept = [(block.text, section in slot[1]) for block, slot in zip(page.blocks, found, strict=True) if slot and _allowed(page, block)]
        inside = any(i for _, i in kept)  # a page without the section has only the rules
        out.append("\n\n".join(text for text, i in kept if i or not inside))
    return out


EXTRACTED = struct(("page_id", T.LongType()), ("url", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()))


def grouped_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, html with host and salt, parted and sorted so that groups stand together."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), F.lit(""))
    hosted = pages.select("page_id", "url", "html", host.alias("host"))
    counts = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.filter((F.col("n") * HEAVY_SHARE > total) & (F.col("n") > GROUP_PAGES)).select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("salts"))
    # Fewer than HEAVY_SHARE hosts can each hold more than that share, whatever the input.
    salted = hosted.join(F.broadcast(heavy), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))))
    return salted.drop("salts").repartition("host", "salt").sortWithinPartitions("host", "salt", "page_id")


def grouped(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Runs of rows with one key, the first item, in groups of at most ``GROUP_PAGES``; of a key with ``LEAST_PAGES`` rows no group has fewer."""
    held: list[tuple] = []

    def rest() -> Iterator[list[tuple]]:
        half = (len(held) + 1) // 2 if len(held) > GROUP_PAGES else len(held)
        yield from (part for part in (held[:half], held[half:]) if part)

    for row in rows:
        if held and held[0][0] != row[0]:
            yield from rest()
            held = []
        elif len(held) == GROUP_PAGES + LEAST_PAGES - 1:
            yield held[:GROUP_PAGES]
            held = held[GROUP_PAGES:]
        held.append(row)
    yield from rest()


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its code points, for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(EXTRACTED)
        def done(held: list[tuple]) -> pa.RecordBatch:
            texts = main_texts([parse(h[3]) for h in held])
            columns = [[h[1] for h in held], [h[2] for h in held], texts, [len(t) for t in texts]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        rows = (((r[0], r[1]), *r[2:]) for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
        for held in grouped(rows):
            yield done(held)
        release()

    return grouped_pages(pages).select("host", "salt", "page_id", "url", "html").mapInArrow(run, EXTRACTED)
