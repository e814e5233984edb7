"""Main text of web pages by two passes over blocks.

The page is read into blocks and the elements around them.  First pass: every
block is decided by where it stands, its link density, its length and its share of
stop words, or stays open when it is short or plain.  Second pass: an open block
takes the label of the nearest neighbour decided by its text, first within its own
section; two sweeps find it.

Where a block stands: names (class, id, role) count as whole words of a name, on
every element.  An article or main resets the names around it, as long as they are
of the weak kind, so a wrapper or an unclosed sidebar does not swallow the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = "page_id long, url string, text string, n_chars long"

#: Common function words of four languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be by at this from or an he she have has had not but they which you we his her its".split()
    + "der die das und in zu den ist von mit sich des auf für nicht ein eine als auch dem an es im er aus bei nach".split()
    + "le la les de des et un une du en que qui est dans pour par sur pas au avec ce il elle ne se plus sont".split()
    + "el la los las de y que en un una por con para es del se no al lo como su más o pero sus".split()
)
_BREAKING = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html label legend "
    "li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_EMPTY = frozenset("hr br img input meta link area base col embed source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open ones, back to the container.
_ENDS = {"li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "tr": ("tr", "table"), "option": ("option", "select")}
_ENDS = {tag: (frozenset(ended.split()), frozenset(within.split())) for tag, (ended, within) in _ENDS.items()}
#: Content of these is no text; a new block ends them where their own end is missing.
_MEDIA = frozenset("svg math object canvas audio video template".split())
PLAIN, WEAK, STRONG, HIDDEN = 0, 1, 2, 3
_TAGS = dict.fromkeys("button form header label legend menu nav optgroup option select".split(), WEAK) | dict.fromkeys("aside dialog footer".split(), STRONG)
_ROLES = dict.fromkeys("navigation banner search alert menu menubar toolbar".split(), WEAK) | dict.fromkeys("contentinfo complementary dialog alertdialog".split(), STRONG)
_NAMES = dict.fromkeys(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices popup modal "
    "overlay newsletter subscribe subscription signup share sharing social sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar widget widgets pagination pager skip login "
    "search alert toast colophon paywall".split(), WEAK) | dict.fromkeys("comment comments commentlist reply replies respond disqus discussion related recommended recommendations trending".split(), STRONG)
_NO_NAME_BEFORE = frozenset("has with no without is not js supports".split())
_NO_NAME_AFTER = frozenset("layout page open active enabled visible".split())
_OF_ARTICLE = frozenset("article post entry story content section main blog".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|title|textarea|iframe)\b(?:>|(?=[\s/])(?>\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*+(?:>|\Z))(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^>\"']|[\"'])*+)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=/<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.5, 0.15, 0.25
#: Share of stop words below which the page's language is taken as unknown, and the length that decides a block then where words are not parted by blanks.
UNKNOWN_STOPS, DENSE = 0.04, 25
#: Share of a page's text from which on an element is the page itself, whatever its name.
MOST, NEARLY_ALL = 0.5, 0.7
GOOD, BAD, OPEN = 1, -1, 0


def name_kind(name: str) -> int:
    """What a class or id says: ``cookie-notice`` and ``site-footer`` name boilerplate, ``has-sidebar`` and ``article-header`` do not."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[0] in _NO_NAME_BEFORE or "with" in parts or parts[-1] in _NO_NAME_AFTER:
        return PLAIN
    of_article = parts[0] in _OF_ARTICLE
    return max(PLAIN if of_article and p in ("header", "sidebar") else _NAMES.get(p, PLAIN) for p in parts)


@lru_cache(maxsize=4096)
def attribute_kind(attrs: str) -> int:
    """The strongest kind that the attributes of an element give it."""
    kind = PLAIN
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            kind = max([kind, *map(name_kind, value.split())])
        elif name == "role":
            kind = max(kind, _ROLES.get(value.strip().lower(), PLAIN))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_SHOW.search(value):
            return HIDDEN
    return kind


class Page:
    """Blocks of text and the elements around them, in page order.

    ``tags``, ``kinds``, ``parents``: one entry per block element, parents before
    children; ``blocks``: text, characters without blanks, those in links, element,
    whether the element is a heading.
    """

    def __init__(self, page: str):
        self.tags, self.kinds, self.parents = ["html"], [PLAIN], [0]
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self._stack, self._open = [0], Counter(["html"])
        self._parts: list[str] = []
        self._linked = 0
        links, media, skipped = 0, None, []
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at and not media and not skipped:
                self._add(page[at:m.start()], links)
            at = m.end()
            tag = (m["tag"] or "").lower()
            if not tag:
                continue
            if tag in _MEDIA:
                media = None if m["close"] and tag == media else tag if not m["close"] and not media and not m["attrs"].rstrip().endswith("/") else media
            elif tag in _BREAKING:
                self._end_block()
                links, media, skipped = 0, None, []
                if m["close"]:
                    self._close(tag)
                elif tag not in _EMPTY:
                    self._enter(tag, m["attrs"])
            elif tag == "br":
                self._parts.append(" ")
            elif tag not in _EMPTY:
                if tag == "a":
                    links = 0 if m["close"] else 1
                if m["close"]:
                    if skipped and skipped[-1] == tag:
                        skipped.pop()
                elif skipped:
                    skipped += [tag] if tag == skipped[-1] else []
                elif m["attrs"] and not m["attrs"].isspace() and attribute_kind(m["attrs"]):
                    skipped.append(tag)
        if not media and not skipped:
            self._add(page[at:], links)
        self._end_block()

    def _add(self, raw: str, links: int) -> None:
        text = html.unescape(raw)
        self._parts.append(text)
        if links:
            self._linked += sum(map(len, text.split()))

    def _end_block(self) -> None:
        if self._parts:
            words = "".join(self._parts).split()
            if words:
                here = self._stack[-1]
                self.blocks.append((" ".join(words), sum(map(len, words)), self._linked, here, self.tags[here] in _HEADINGS))
            self._parts, self._linked = [], 0

    def _pop(self) -> None:
        self._open[self.tags[self._stack.pop()]] -= 1

    def _close(self, tag: str) -> None:
        if self._open[tag] > 0:
            while self.tags[self._stack[-1]] != tag:
                self._pop()
            if len(self._stack) > 1:
                self._pop()

    def _enter(self, tag: str, attrs: str) -> None:
        if self.tags[self._stack[-1]] == "p" or self.tags[self._stack[-1]] in _HEADINGS:
            self._pop()
        if tag in _ENDS and any(self._open[t] > 0 for t in _ENDS[tag][0]):
            ended, within = _ENDS[tag]
            for k in range(len(self._stack) - 1, 0, -1):
                here = self.tags[self._stack[k]]
                if here in within:
                    break
                if here in ended:
                    while len(self._stack) > k:
                        self._pop()
                    break
        kind = attribute_kind(attrs) if attrs and not attrs.isspace() and tag not in ("html", "body") else PLAIN
        if tag in ("article", "main") and kind == WEAK:
            kind = PLAIN
        self.tags.append(tag)
        self.kinds.append(max(kind, _TAGS.get(tag, PLAIN)))
        self.parents.append(self._stack[-1])
        self._stack.append(len(self.tags) - 1)
        self._open[tag] += 1

    def places(self) -> tuple[list[int], list[int]]:
        """Per element the kind in force and the section: 0 outside any article or main, else the number of the outermost one."""
        n = len(self.tags)
        held, mains = [0] * n, [int(t in ("article", "main")) for t in self.tags]
        for _, chars, linked, element, _ in self.blocks:
            held[element] += max(0, chars - linked)
        for e in range(n - 1, 0, -1):
            held[self.parents[e]] += held[e]
            mains[self.parents[e]] += mains[e]
        text, articles = max(1, held[0]), mains[0]
        kinds, sections, numbers = [PLAIN] * n, [0] * n, 0
        for e in range(1, n):
            tag, kind, parent, share = self.tags[e], self.kinds[e], self.parents[e], held[e] / text
            article = tag in ("article", "main")
            sections[e] = sections[parent]
            if tag == "header" and sections[e] and kind == WEAK or tag == "form" and (mains[e] or share > MOST):
                kind = PLAIN
            elif kind == WEAK and not articles and share > NEARLY_ALL:
                kind = PLAIN
            elif kind == STRONG and articles and mains[e] == articles and share > MOST:
                kind = WEAK  # all articles of the page are in here, so they are its text
            around = PLAIN if article and kinds[parent] == WEAK else kinds[parent]
            kinds[e] = max(kind, around)
            if article and not sections[e] and kinds[e] == PLAIN:
                numbers += 1
                sections[e] = numbers
        return kinds, sections


def stop_share(words: list[str]) -> float:
    return sum(w.strip(".,;:!?()\"'«»").lower() in STOP_WORDS for w in words) / max(1, len(words))


def first_label(text: str, density: float, section: int, known: bool) -> int:
    """Label of a block outside boilerplate from its own text; ``known``: whether stop words of the page's language are listed."""
    if density > LINKS:
        return BAD
    words = text.split()
    if len(text) < SHORT and (known or len(text) < DENSE or len(text) < 15 * len(words)):
        return OPEN
    if not known:
        return GOOD
    stops = stop_share(words)
    return GOOD if stops >= MANY_STOPS or stops >= FEW_STOPS and len(text) >= LONG else OPEN


def nearest(labels: list[int], passes: list[bool], step: int) -> list[tuple[int, int]]:
    """For each block the distance and label of the closest one before it (``step`` 1) or after it (-1) that passes its label on."""
    out, far, label = [(len(labels) + 1, OPEN)] * len(labels), len(labels) + 1, OPEN
    for i in range(len(labels))[::step]:
        out[i] = (far, label)
        far, label = (1, labels[i]) if passes[i] else (far + 1, label)
    return out


def main_text(source: str) -> str:
    page = Page(source)
    kinds, sections = page.places()
    found = [(text, linked / max(1, chars), sections[element], heading) for text, chars, linked, element, heading in page.blocks if kinds[element] == PLAIN]
    known = stop_share([w for text, density, *_ in found if density <= LINKS for w in text.split()]) >= UNKNOWN_STOPS
    labels = [first_label(text, density, section, known) for text, density, section, _ in found]
    by_section: dict[int, list[int]] = {}
    for i, (_, _, section, _) in enumerate(found):
        by_section.setdefault(section, []).append(i)
    within = {section for section in by_section if section}
    # Loose blocks are the text only of pages whose articles say nothing.
    says = any(labels[i] == GOOD for s in within for i in by_section[s]) or sum(len(found[i][0]) for s in within for i in by_section[s]) >= SHORT
    kept = [False] * len(found)
    for section, here in by_section.items():
        if says and not section:
            continue
        own = [labels[i] for i in here]
        passes = [x != OPEN and (x == GOOD or len(found[i][0]) >= SHORT) for i, x in zip(here, own, strict=True)]
        before, after, next_one = nearest(own, passes, 1), nearest(own, passes, -1), nearest(own, [x != OPEN for x in own], -1)
        for k, i in enumerate(here):
            label = own[k]
            if label == OPEN:
                closest = [next_one[k]] if found[i][3] and next_one[k][1] != OPEN else [before[k], after[k]]  # a heading goes with what follows it
                label = min(closest, key=lambda x: (x[0], -x[1]))[1] or GOOD
            kept[i] = label == GOOD
    return "\n".join(text for (text, *_), keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, blocks joined by a line break.

    A null or empty html gives an empty text.  Character references are decoded,
    white space within a block becomes one blank.  Pages may be cut off anywhere.
    Rows are independent of each other, so repeated rows and null ids come out as
    they came in; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, TEXT)
