"""Main text of web pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import functools
import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import slices, text_or_empty

#: Elements that start and end a block of text, that hold no page text, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
SILENT = frozenset("head script style noscript template textarea select button iframe svg object title math canvas audio video datalist option".split())
#: Silent elements that may lie in their own kind, and tags that a head may hold; any other start tag ends it.
NESTED = frozenset("object svg math template datalist canvas audio video".split())
HEAD = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag closes if they are open and nothing else lies between.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of a class, id or role that speak for boilerplate and for content.
AGAINST = frozenset(
    """ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus footer gdpr
    header hidden login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related replies reply respond
    reviews search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription tags toolbar toc topbar widget widgets complementary contentinfo""".split()
)
FOR = frozenset("article articlebody body content entry main maincontent post posttext story storybody text".split())
#: Elements that hold a whole page or text: their own words say nothing against it.
WHOLE = frozenset("html body main article".split())
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<(script|style|textarea|title)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S | re.I
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


@dataclass
class Element:
    tag: str
    words: frozenset[str]
    hidden: bool
    number: int


@dataclass
class Block:
    path: tuple[Element, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _element(tag: str, attributes: str, number: int) -> Element:
    words: set[str] = set()
    hidden = False
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "").lower()
            if name.lower() in ("class", "id", "role"):
                words.update(re.split(r"[^a-z]+", value))
                words.update(re.split(r"\s+", value))
            elif name.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
        hidden = hidden or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes), re.I))
    return Element(tag, frozenset(words - {""}), hidden, number)


def _matched(tokens: list[re.Match]) -> set[int]:
    """Places of the start tags in SILENT that have an end tag of their own."""
    opened: dict[str, list[int]] = {}
    out: set[int] = set()
    for i, m in enumerate(tokens):
        if m[3] and (tag := m[3].lower()) in SILENT:
            own = opened.setdefault(tag, [])
            if m[2]:
                if own:
                    out.add(own.pop())
            else:
                if tag not in NESTED:
                    own.clear()
                own.append(i)
    return out


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, with the block elements around them; unclosed elements end with their parent.

    Silent elements are kept on a stack of their own. An end tag also ends what is open inside; option ends option; an
    element without an end tag ends at the next block, and a head at the first tag or text that it can't hold.
    """
    stack: list[Element] = []
    out: list[Block] = []
    current = Block(())
    silent: list[tuple[str, bool, int]] = []  # tag, whether it has an end tag, and the block elements around it
    links, number, at = 0, 0, 0
    tokens = list(TOKEN.finditer(page))
    matched = _matched(tokens)

    def flush(current: Block) -> Block:
        current.text = " ".join(entities.unescape("".join(current.parts)).split())
        if current.text:
            out.append(current)
        return Block(tuple(stack))

    def end_unmatched(depth: int = -1) -> None:
        while silent and not silent[-1][1] and silent[-1][0] != "head" and silent[-1][2] > depth:
            silent.pop()

    def say(text: str) -> None:
        if silent and silent[-1][0] == "head" and text.strip() and "<" not in text:
            silent.pop()
        if text and not silent:
            current.parts.append(text)
            if links:
                current.linked += len(text)

    for place, m in enumerate(tokens):
        say(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue  # a comment, a declaration, or an element whose content is no text
        tag, closing = m[3].lower(), bool(m[2])
        if not closing:
            if tag in BLOCKS and tag != "html":
                end_unmatched()
            if tag == "body":
                silent.clear()
            elif silent and silent[-1][0] == "head" and tag not in HEAD:
                silent.pop()
        if tag in SILENT:
            if closing:
                at_tag = next((k for k in reversed(range(len(silent))) if silent[k][0] == tag), None)
                if at_tag is not None:
                    del silent[at_tag:]
            elif not m[4].endswith("/"):
                if tag == "option" and silent and silent[-1][0] == "option":
                    silent.pop()
                elif tag not in NESTED:  # a second one without an end tag between ends the first
                    k = len(silent)
                    while k and not silent[k - 1][1] and silent[k - 1][0] != "head":
                        k -= 1
                        if silent[k][0] == tag:
                            del silent[k:]
                            break
                silent.append((tag, place in matched, len(stack)))
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            say(" ")
        if tag in BLOCKS:
            current, links = flush(current), 0 if tag != "a" else links
            if closing:
                if any(e.tag == tag for e in stack):
                    while stack.pop().tag != tag:
                        pass
                    end_unmatched(len(stack))
            elif tag not in VOID:
                while stack and stack[-1].tag in CLOSES.get(tag, ()) or (stack and stack[-1].tag == "p" and tag != "p"):
                    stack.pop()
                number += 1
                stack.append(_element(tag, m[4], number))
            current = Block(tuple(stack))
    say(page[at:])
    flush(current)
    return out


def _suspect(e: Element) -> bool:
    """A form, or boilerplate words below html, body, main and article: weighed by what the element encloses."""
    return e.tag == "form" or (e.tag not in WHOLE and bool(e.words & AGAINST))


def suspicion(blocks: list[Block]) -> dict[int, float]:
    """How far each suspect element is boilerplate, by number: 1 up to three quarters of the page's prose, 0 if it holds all.

    Prose is text outside links: that of articles if there is any, else that of main, else all. What
    lies in suspects with less than half of it is left out before shares are taken.
    """
    suspects = {e.number for b in blocks for e in b.path if _suspect(e)}
    if not suspects:
        return {}
    prose = [max(len(b.text) - b.linked, 0) for b in blocks]
    for tag in ("article", "main"):
        within = [n if any(e.tag == tag for e in b.path) else 0 for n, b in zip(prose, blocks, strict=True)]
        if any(within):
            prose = within
            break

    def shares() -> dict[int, float]:
        held = dict.fromkeys(suspects, 0)
        for n, b in zip(prose, blocks, strict=True):
            for e in b.path if n else ():
                if e.number in held:
                    held[e.number] += n
        total = max(sum(prose), 1)
        return {k: n / total for k, n in held.items()}

    small = {k for k, share in shares().items() if share < 0.5}
    prose = [0 if any(e.number in small for e in b.path) else n for n, b in zip(prose, blocks, strict=True)]
    return {k: 1.0 if k in small else min(1.0, 4 * (1 - share)) for k, share in shares().items()}


def preference(block: Block, suspects: dict[int, float]) -> int:
    """How much dearer it is to call the block boilerplate than content (negative: the other way), in tenths."""
    score = 0
    inside, outside = False, 0.0
    for e in block.path:
        if e.tag in ("article", "main") or e.words & {"main"}:
            inside = True
        if e.tag in ("nav", "footer", "aside", "dialog", "menu") or e.hidden or (e.tag == "header" and not inside):
            outside = 1.0
        outside = max(outside, suspects.get(e.number, 0.0))
    named = any(e.words & FOR for e in block.path)
    score += 40 if inside else (15 if named else 0)
    score -= round(90 * outside)
    size = len(block.text)
    share = block.linked / max(size, 1)
    score += min(size // 10, 20) - 6
    score -= round(25 * share) if size else 0
    score += 6 if re.search(r"[.!?…:;]", block.text) else -4
    if block.path and block.path[-1].tag in HEADINGS:
        score += 8
    return score


def smoothness(a: Block, b: Block) -> int:
    """Cost of telling two neighbours apart: more the deeper their common element lies under both."""
    common = 0
    for x, y in zip(a.path, b.path, strict=False):
        if x is not y:
            break
        common += 1
    distance = len(a.path) + len(b.path) - 2 * common
    return max(1, 10 - 2 * distance)


@functools.lru_cache(maxsize=50_000)
def minimum_cut(costs: tuple[int, ...], edges: tuple[tuple[int, int, int], ...]) -> tuple[bool, ...]:
    """The content side of a minimum cut (Dinic's maximum flow).

    A block that prefers content is joined to the source, one that prefers boilerplate to the
    sink, by its cost; ``edges`` (a, b, cost) join blocks both ways. Content is what the source
    still reaches; a block without preference and without content around it is boilerplate.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, cost in enumerate(costs):
        if cost > 0:
            join(source, i, cost, 0)
        elif cost < 0:
            join(i, sink, -cost, 0)
    for a, b, cost in edges:
        join(a, b, cost, cost)

    def levels() -> list[int]:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        return level

    while (level := levels())[sink] >= 0:
        turn = [0] * (n + 2)
        while True:  # push along shortest paths, kept on a stack
            path: list[int] = []
            a = source
            while a != sink:
                while turn[a] < len(out[a]):
                    e = out[a][turn[a]]
                    if room[e] and level[to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                else:
                    if not path:
                        break
                    a = to[path.pop() ^ 1]
                    turn[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != sink:
                break
            push = min(room[e] for e in path)
            for e in path:
                room[e] -= push
                room[e ^ 1] += push
    reached = levels()
    return tuple(level >= 0 for level in reached[:n])


def main_text(page: str) -> str:
    """The content blocks of a page, joined by newlines."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    suspects = suspicion(blocks)
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        if i:
            edges[i - 1, i] = smoothness(blocks[i - 1], block)
        for up in block.path[-2:]:  # near in the tree, if not on the page: the last block under the same element
            if up.number in last and last[up.number] != i - 1:
                key = (last[up.number], i)
                edges[key] = max(edges.get(key, 0), smoothness(blocks[key[0]], block) // 2 + 1)
            last[up.number] = i
    cut = minimum_cut(tuple(preference(b, suspects) for b in blocks), tuple((a, b, c) for (a, b), c in sorted(edges.items())))
    return "\n".join(b.text for b, content in zip(blocks, cut, strict=True) if content)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (main text), ``n_chars`` for every row; pages are independent, nothing is shuffled.

    Blocks of text get a cost for either label from their elements, class names, links, length
    and punctuation. Neighbours on the page and in the document tree cost something to tell
    apart. The minimum cut of that graph is the cheapest labelling. Character references are
    decoded, white space within a block is one space, blocks are joined by a newline.

    A null or empty html, or one without content, gives an empty text. Ids and urls may be null and
    rows may repeat; each row is judged by itself, from its whole html. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), text_or_empty(html_col))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
