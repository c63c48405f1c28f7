"""Main text of web pages by two passes over their blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Very common words of English, German, French and Spanish. Fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or our she that the their they this to was we were which with you "
    "als am auch auf aus bei bin bis das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind um und von war wie wir zu zum zur über "
    "au aux avec ce cette dans de du elle en est et il je la le les leur mais ne nous ou par pas plus pour qu que qui sa se ses son sont sur un une vous à "
    "al como con del el ella ellos era este esta fue ha hay las lo los más me mi muy no nos o para pero por porque si sin sobre su sus también una uno y ya".split()
)
#: Elements whose content is never text. Fixed values.
DROPPED = frozenset("script style noscript template iframe object embed applet svg math canvas head title select option button textarea input audio video map datalist".split())
#: Elements that stand around the article. Fixed values.
AROUND = frozenset("nav header footer aside form menu dialog".split())
#: Elements that end a block. Fixed values.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a start tag of the same group closes, as their end tag may be left out. Fixed values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: Elements whose start ends an open paragraph, those between the two included. Fixed values.
ENDS_P = BLOCKS - frozenset("body caption html legend".split())
#: Elements that part what they hold from a paragraph around them. Fixed values.
PARTS_P = frozenset("button caption html marquee object table td template th".split())
#: What may stand in a head; anything else ends it. Fixed values.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Words in class, id or role that mark what stands around the article. Fixed values.
AROUND_WORD = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|sidebar|widget|breadcrumbs?|menu|nav|navbar|navigation|pagination|pager|footer|masthead|topbar|toolbar|complementary|contentinfo|skip|search|tags?|meta|byline-social)(?:$|[\s_-])", re.I)

#: Words that mark what stands around an article when they name its surroundings, but may also name its own subject. Fixed values.
SUBJECT_WORD = re.compile(r"(?:^|[\s_-])(?:search|tags?|meta)(?=$|[\s_-])", re.I)

NAME = re.compile(r"[a-zA-Z][^\s/>\x00]*")
TAG_END = re.compile(r"[>\"']")
#: Elements whose content holds no tags. Fixed values.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in ("script", "style", "title", "textarea", "noscript", "iframe")}
#: Names of layouts rather than of what stands around the article, as in "content with-sidebar". Fixed values.
LAYOUT_WORD = re.compile(r"\b(?:with|has|no|without|hide)[_-]\w+", re.I)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
SPACE = re.compile(r"\s+")

SHORT, LONG = 70, 200
#: Shares of stop words: below the first a block isn't prose of a language that the list holds, from the second on it is.
STOP_LOW, STOP_HIGH = 0.08, 0.16
LINKS_MOST = 0.2
#: In an article, prose may hold more links.
LINKS_MOST_SCOPE = 0.5
#: Characters of scripts that write a word in about one or two of them count as three. Fixed values.
WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1100-\u11ff\u1780-\u17ff\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


@dataclass
class Block:
    text: str
    linked: int
    scope: int  # of the article or main element around it; 0: none
    around: bool
    heading: bool
    doubt: bool = False  # stands in an element of an article whose name may mean its subject or its surroundings
    label: str = ""
    form: int = 0  # the form around it; 0: none


class Tokens:
    """Text and markup of a page in order, in time that is linear in its length however broken it is.

    A quoted value may hold ``>``. Where a quote has no end, the tag ends at its first ``>``; so do all further ones once
    looking for ends of quotes in vain has taken several times the page's length. A ``<`` that nothing ends is text.
    """

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last = {x: page.rfind(x) for x in "<>\"'"}
        self.vain = 4 * len(page) + 1024

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, name or text, attributes) with kinds text, start and end."""
        page, size, text = self.page, len(self.page), 0
        while (i := page.find("<", self.at) if self.at <= self.last["<"] else -1) >= 0:
            kind, name, attrs, raw = self.markup(i)
            if kind == "none":
                self.at = i + 1
                continue
            if i > text:
                yield "text", page[text:i], ""
            text = self.at
            if kind == "skip":
                if raw:
                    yield "text", raw, ""
                continue
            yield kind, name, attrs
            if kind == "start" and name in RAW:
                end = RAW[name].search(page, self.at)
                self.at = text = size if end is None else end.start()
        if text < size:
            yield "text", page[text:], ""

    def markup(self, i: int) -> tuple[str, str, str, str]:
        page, size = self.page, len(self.page)
        if page.startswith("<!--", i):
            end = i + 4 if page.startswith((">", "->"), i + 4) else page.find("-->", i + 4)
            self.at = size if end < 0 else page.index(">", end) + 1
            return "skip", "", "", ""
        if page.startswith("<![CDATA[", i):
            end = page.find("]]>", i + 9)
            self.at = size if end < 0 else end + 3
            return "skip", "", "", page[i + 9 : size if end < 0 else end]
        if i > self.last[">"]:
            return "none", "", "", ""
        ends = page.startswith("/", i + 1)
        m = NAME.match(page, i + 1 + ends)
        if not m:
            if not ends and not page.startswith(("!", "?"), i + 1):
                return "none", "", "", ""
            self.at = page.index(">", i) + 1
            return "skip", "", "", ""
        end = self.tag_end(m.end())
        self.at = end + 1
        return "end" if ends else "start", m[0].lower(), page[m.end() : end], ""

    def tag_end(self, start: int) -> int:
        page, at = self.page, start
        while self.vain > 0 and at <= self.last[">"]:
            m = TAG_END.search(page, at)
            if m[0] == ">":
                return m.start()
            if m.start() == self.last[m[0]]:
                break
            at = page.index(m[0], m.end()) + 1
        self.vain -= at - start
        return page.index(">", start)


def self_closed(attrs: str) -> bool:
    """Whether a tag with these attributes ends with a slash of its own, not with that of an unquoted value."""
    if not attrs.endswith("/"):
        return False
    last = max(attrs.rfind(x) for x in " \t\n\r\f\"'") + 1
    return "=" not in attrs[last:] and not attrs[:last].rstrip().endswith("=")


def prose(block: Block) -> bool:
    return not block.around and len(block.text) >= SHORT and block.linked <= LINKS_MOST * len(block.text)


def settle_forms(blocks: list[Block], whole: set[int]) -> None:
    """A form's blocks stand around the article, unless the form is around the page: it holds an article or main element
    (``whole``), or more than half of the page's prose and more than a medium block of it."""
    inside: dict[int, int] = {}
    for b in blocks:
        if prose(b):
            inside[b.form] = inside.get(b.form, 0) + len(b.text)
    total = sum(inside.values())
    whole = whole | {f for f, n in inside.items() if n > LONG and 2 * n > total}
    for b in blocks:
        b.around = b.around or bool(b.form) and b.form not in whole


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, with the element they stand in; markup that isn't closed ends with the page.

    End tags that may be left out are: what can't stand in a head ends it, a block ends a paragraph, and list items, cells
    and rows end each other.
    """
    out: list[Block] = []
    top = ("", False, 0, False, False, 0, False)
    stack = [top]  # name, around, scope, dropped, doubt, form, whether a paragraph is open
    opened: dict[str, int] = {}
    parts: list[str] = []
    linked = links = scopes = forms = 0
    whole: set[int] = set()
    heading = False

    def close(name: str) -> None:
        while stack[-1][0] != name:
            opened[stack.pop()[0]] -= 1
        opened[stack.pop()[0]] -= 1

    def flush() -> None:
        nonlocal linked, heading
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            _, around, scope, _, doubt, form, _ = stack[-1]
            out.append(Block(text, linked, scope, around, heading, doubt, form=form))
        parts.clear()
        linked, heading = 0, False

    for kind, name, attrs in Tokens(page):
        if opened.get("head") and kind != "end" and (stack[-1][0] == "head" and name.strip() if kind == "text" else name not in IN_HEAD and name != "head"):
            close("head")
        if kind == "text":
            if not stack[-1][3]:
                text = html.unescape(name) if "&" in name else name
                parts.append(text)
                if links:
                    linked += len(SPACE.sub(" ", text).strip())
            continue
        if kind == "end":
            if name in BLOCKS:
                flush()
            if opened.get(name):
                close(name)
            if name == "a":
                links = max(0, links - 1)
            continue
        if name in BLOCKS:
            flush()
            heading = name in HEADINGS
            links = 0
        elif name == "br":
            parts.append(" ")
        if stack[-1][6] and name in ENDS_P:
            close("p")
        if name in VOID or self_closed(attrs):
            continue
        if name == "a":
            links += 1
        closed = CLOSES.get(name, ())
        while stack[-1][0] in closed:
            opened[stack.pop()[0]] -= 1
        _, around, scope, dropped, doubt, form, paragraph = stack[-1]
        dropped = dropped or name in DROPPED
        if name in ("article", "main") and not around:
            scopes += 1
            scope = scopes
            whole.add(form)
        if name == "form":
            forms += not form
            form = form or forms
        elif name in AROUND and not (name == "header" and scope):
            around = True
        if attrs and name not in ("body", "html"):
            named = LAYOUT_WORD.sub("", " ".join("".join(x) for x in NAMED.findall(attrs)))
            if name in ("article", "main"):
                around = around or bool(name == "article" and named and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies)(?:$|[\s_-])", named, re.I))
            else:
                if scope and named and SUBJECT_WORD.search(named):
                    doubt, named = True, SUBJECT_WORD.sub(" ", named)
                around = around or bool(named and AROUND_WORD.search(named))
                dropped = dropped or bool(HIDDEN.search(attrs))
        stack.append((name, around, scope, dropped, doubt, form, name == "p" or paragraph and name not in PARTS_P))
        opened[name] = opened.get(name, 0) + 1
    flush()
    settle_forms(out, whole)
    return out


def density(text: str) -> float:
    """The share of stop words."""
    words = text.lower().split()
    return sum(x.strip(".,;:!?()\"'") in STOP_WORDS for x in words) / max(1, len(words))


def classify(block: Block, by_words: bool = True) -> str:
    """First pass, by the block alone: good, near, short or bad; ``by_words``: the density of stop words tells something.

    Long prose with few links is good, medium prose near; in an article or main element medium prose is good too, more of
    it may be linked, and what isn't prose of a known language is near instead of bad.
    """
    if block.around:
        return "bad"
    size = len(block.text)
    width = size if by_words else size + 2 * len(WIDE.findall(block.text))
    share = density(block.text) if by_words else 0.0
    if block.doubt and not (size >= SHORT and block.linked <= LINKS_MOST * size and (share >= STOP_HIGH or not by_words)):
        return "bad"
    if block.linked > (LINKS_MOST_SCOPE if block.scope else LINKS_MOST) * size:
        return "bad" if width >= SHORT or block.linked > 0.8 * size else "short"
    if width < SHORT or block.heading:
        return "short"
    if not by_words:
        return "good" if width > LONG or block.scope else "near"
    if share >= STOP_HIGH:
        return "good" if size > LONG or block.scope else "near"
    return "near" if share >= STOP_LOW or size > LONG or block.scope else "bad"


def tells(block: Block) -> bool:
    """Whether the block is text whose stop words reach the density."""
    plain = not (block.around or block.heading) and len(block.text) >= SHORT
    return plain and block.linked <= LINKS_MOST * len(block.text) and density(block.text) >= STOP_LOW


def keep(blocks: list[Block]) -> list[Block]:
    """Second pass: near blocks, then short ones, take the label of the nearest decided blocks before and after.

    Neighbours count only inside the same article element. Where both sides disagree, a short block is bad unless a near
    block stands next on the good side; a heading goes with what follows it. At the edge of an article element the other
    side alone decides; with no decided block in the element, its blocks are good.

    Long blocks with few links but rare stop words (technical prose, a quotation in another language) are near ones. Where
    no block reaches the density, the page is in a language or script that the list doesn't hold, and length and links
    alone decide. Where no block is good, the near ones are.
    """
    by_words = any(map(tells, blocks))
    for b in blocks:
        b.label = classify(b, by_words)
    if not any(b.label == "good" for b in blocks):  # the page's longest text is of medium length
        for b in blocks:
            b.label = "good" if b.label == "near" else b.label
    first = [b.label for b in blocks]

    def sides(waiting: set[str]) -> tuple[list[str], list[str]]:
        both = []
        for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
            last: dict[int, str] = {}
            seen = [""] * len(blocks)
            for i in order:
                b = blocks[i]
                seen[i] = last.get(b.scope, "")
                if b.label not in waiting and not (b.scope and (b.around or b.doubt)):
                    last[b.scope] = b.label
            both.append(seen)
        return both[0], both[1]

    before, after = sides({"short", "near"})
    for i, b in enumerate(blocks):
        if first[i] == "near":
            b.label = "good" if "good" in (before[i], after[i]) or not (before[i] or after[i]) else "bad"
    before, after = sides({"short"})
    decided = []
    for i, b in enumerate(blocks):
        if first[i] != "short":
            decided.append(b.label)
            continue
        near = {x for x in (before[i], after[i]) if x}
        if b.scope:
            decided.append("bad" if near == {"bad"} else "good")
        elif b.heading:
            decided.append(after[i] or "bad")
        else:
            decided.append("good" if near == {"good"} and before[i] and after[i] else "bad")
    for b, label in zip(blocks, decided, strict=True):
        b.label = label
    return [b for b in blocks if b.label == "good"]


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in keep(blocks_of(page))) if page else ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})


def extract_pages(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """The main text of every page's whole html, a row per page.

    The first pass labels each block by its length, the density of stop words (where any block reaches it) and the share of
    linked text, and by the elements around it; the second lets undecided short blocks inherit from their nearest decided neighbours. Null and
    empty pages give an empty text; repeated rows are extracted each; further columns are ignored. No shuffle.

    Returns: key (the id), url, text, n_chars.
    """
    ship(pages.sparkSession)
    narrow = pages.select(F.col(id_col).alias("key"), F.col("url").cast("string").alias("url"), F.col("html").alias("html"))
    key_type = narrow.schema["key"].dataType.simpleString()
    return narrow.mapInArrow(_extracted, f"key {key_type}, url string, text string, n_chars long")
