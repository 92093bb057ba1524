"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element; boilerplate elements (by tag, class, id, role or being
hidden) are left out, and outside an article leave WINDOW - 1 empty lines, as an article's edges do. A line
weighs its characters outside links; in paragraphs and headings links count as text. If the page has articles
(article or main elements, content-like classes), a line in one of them weighs ARTICLE_BONUS more and a line
outside a quarter; articles under ARTICLE_SHARE of the longest count as outside.

The weights are summed over sliding windows of WINDOW lines. A surge point is the first line that weighs
anything in a window whose sum reaches the threshold, after one that does not; a dive point is the last such
line. The threshold is PEAK_SHARE of the page's largest sum, or CEILING if that is less. All lines from every
surge point to its dive point are the text, in page order, whatever they weigh themselves.

Edge cases: null or empty html gives an empty text; a page with nothing but boilerplate gives an empty text;
unclosed elements end with their parent; a tag's quoted attributes are read before anything in them; a very
long page is read in one pass, its memory is a small multiple of the page; repeated rows are extracted each on
their own; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Lines in a window; the threshold of a sum; how much more a character weighs in an article, and less beside one.
WINDOW, PEAK_SHARE, CEILING = 3, 0.1, 80.0
ARTICLE_WEIGHT, ARTICLE_SHARE = 27, 0.3

#: Element names of the HTML standard.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
UNSEEN = frozenset("head title noscript template svg math canvas object audio video select button datalist".split())
RAW = frozenset("script style textarea iframe xmp noembed noframes".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog fieldset search".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd".split())
ARTICLE = frozenset(("article", "main"))
#: Elements that a new one of the group ends, and the elements that an end does not reach beyond.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class names and ids that mark boilerplate, and words that may stand beside them.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner sidebar sidebars comment comments commentlist disqus respond reply "
    "replies discussion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommend recommended recommendations "
    "breadcrumb breadcrumbs menu nav navbar navigation pagination pager footer masthead topbar toolbar widget widgets skip hidden teaser teasers".split())
BESIDE = frozenset("site page main top bottom left right container wrapper wrap box block list area section inner outer bar row item items primary secondary global links buttons form post article blog header link content".split())
ALONE = frozenset("header site-header page-header alert".split())
CONTENT = re.compile(r"(?:article|post|entry|story|main|page)-?(?:body|content|text)|content|main|article|post|entry|story")

_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][a-zA-Z0-9:-]*))")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(name: str) -> bool:
    """Whether a class name or id is made of words of MARKS and BESIDE, with one of MARKS at least."""
    name = name.lower()
    parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
    return name in ALONE or any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts)


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """'skip', 'article' or ''."""
    if name in UNSEEN or name in BOILERPLATE or (name == "header" and not in_article):
        return "skip"
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    if role in ROLES or ("hidden" in found and found["hidden"].lower() != "false") or found.get("aria-hidden", "").lower() == "true" or _UNSHOWN.search(found.get("style", "")):
        return "skip"
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    if name not in ("html", "body") and any(map(_marked, names)):
        return "skip"
    return "article" if name in ARTICLE or role == "main" or name not in ("html", "body") and any(CONTENT.fullmatch(x.lower()) for x in names) else ""


class _Page:
    """The lines of one page: (text, characters that weigh, number of the outermost article or 0, whether it is prose)."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, int, bool]] = []
        self.stack: list[tuple[str, str]] = []
        self.opened: Counter[str] = Counter()  # by element name, and by kind as '*skip' and '*article'
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.prose = False
        self.article = 0

    def text(self, piece: str) -> None:
        if piece and not self.opened["*skip"]:
            self.parts.append(piece)
            if self.opened["a"]:
                self.linked.append(piece)
            self.prose = self.prose or any(self.opened[x] for x in PROSE)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                inside = len(" ".join(html.unescape("".join(self.linked)).split())) if self.linked and not self.prose else 0
                self.lines.append((text, max(0, len(text) - inside), self.article if self.opened["*article"] else 0, self.prose))
        self.parts, self.linked, self.prose = [], [], False

    def gap(self) -> None:
        self.lines.extend([("", 0, 0, False)] * (WINDOW - 1))

    def push(self, name: str, kind: str) -> None:
        self.stack.append((name, kind))
        self.opened[name] += 1
        if kind:
            if not self.opened["*article"] and not self.opened["*skip"]:
                self.gap()
                self.article += kind == "article"
            self.opened[f"*{kind}"] += 1

    def pop(self) -> str:
        name, kind = self.stack.pop()
        self.opened[name] -= 1
        if kind:
            self.opened[f"*{kind}"] -= 1
            if kind == "article" and not self.opened["*article"] and not self.opened["*skip"]:
                self.gap()
        return name

    def close(self, names: set[str], within: set[str] = frozenset()) -> None:
        """End the innermost open element of ``names``, with all in it, unless one of ``within`` is further in."""
        if any(self.opened[x] for x in names):
            for name, _ in reversed(self.stack):
                if name in within:
                    return
                if name in names:
                    break
            while self.pop() not in names:
                pass

    def tag(self, closing: bool, name: str, attributes: str) -> None:
        if closing:
            if name in BLOCKS:
                self.end_line()
            self.close({name})
            return
        if name in BLOCKS:
            self.end_line()
            self.close({"p"}, {"table", "td", "th", "object", "button"})
        if name in SIBLINGS:
            self.close(*SIBLINGS[name])
        if name == "br":
            self.text(" ")
        elif name == "a":
            self.close({"a"})
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCKS):
            kind = "" if self.opened["*skip"] else _kind(name, attributes, self.opened["*article"] > 0)
            if kind:
                self.end_line() if name in BLOCKS or kind == "article" else None
            self.push(name, kind)


def lines_of(page: str) -> list[tuple[str, int, int, bool]]:
    """The lines of a page in order; empty ones stand where passages must not run together.

    The scan goes forward only: what has been looked at for the end of a tag is passed, and where a quote is never
    closed, that tag and all later ones end at their first ">".
    """
    found, at, size, last, quoted = _Page(), 0, len(page), page.rfind(">"), True
    while at < size:
        tag = _OPEN.search(page, at)
        found.text(page[at:tag.start() if tag else size])
        if not tag:
            break
        at = tag.end()
        if tag[0] in ("<!--", "<![CDATA["):
            end = page.find("-->" if tag[0] == "<!--" else "]]>", at)
            at = end + 3 if end >= 0 else size
        elif at > last:  # no tag ends any more, and a comment takes all that follows
            found.text(page[tag.start():min((x for x in (page.find("<!--", at), page.find("<![CDATA[", at)) if x >= 0), default=size)])
            break
        elif not tag[2]:
            at = page.find(">", at) + 1
        else:
            rest = _REST.match(page, at) if quoted else None
            quoted = quoted and rest is not None
            end = rest.end() if rest else page.find(">", at) + 1
            attributes, at, name = page[at:end - 1], end, tag[2].lower()
            if name in RAW:
                if not tag[1]:
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else size
                continue
            found.tag(bool(tag[1]), name, attributes)
    found.end_line()
    return found.lines


def articles_of(lines: list[tuple[str, int, int, bool]]) -> set[int]:
    """Numbers of the articles that hold a fair part of the largest one's text."""
    sizes: Counter[int] = Counter()
    for text, _, article, _ in lines:
        sizes[article] += len(text) if article else 0
    least = ARTICLE_SHARE * max(sizes.values(), default=0)
    return {a for a, n in sizes.items() if a and n >= least}


def weights_of(lines: list[tuple[str, int, int, bool]]) -> list[float]:
    """What each line weighs: its characters without links, and on a page with articles more in them and less beside them."""
    within = articles_of(lines)
    if not within:
        return [float(plain) for _, plain, _, _ in lines]
    return [float(ARTICLE_WEIGHT * len(text)) if article in within else plain / ARTICLE_WEIGHT for text, plain, article, _ in lines]


def passages(weights: list[float]) -> list[tuple[int, int]]:
    """(surge point, dive point) of each passage, both within it."""
    sums = [sum(weights[i:i + WINDOW]) for i in range(len(weights))]
    threshold = min(PEAK_SHARE * max(sums, default=0.0), CEILING)
    if not threshold:
        return []
    found: list[tuple[int, int]] = []
    over = False
    for i, total in enumerate(sums):
        if total >= threshold:
            heavy = [j for j in range(i, min(i + WINDOW, len(weights))) if weights[j]]
            if found and (over or heavy[0] <= found[-1][1]):
                found[-1] = (found[-1][0], max(found[-1][1], heavy[-1]))
            else:
                found.append((heavy[0], heavy[-1]))
        over = total >= threshold
    return found


def with_prose(found: list[tuple[int, int]], lines: list[tuple[str, int, int, bool]]) -> list[tuple[int, int]]:
    """Passages with the headings and paragraphs, however short, that stand at their ends without anything between."""
    out: list[tuple[int, int]] = []
    for first, last in found:
        while first > 0 and lines[first - 1][0] and lines[first - 1][3]:
            first -= 1
        while last + 1 < len(lines) and lines[last + 1][0] and lines[last + 1][3]:
            last += 1
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def main_text(page: str | None) -> str:
    lines = lines_of(page) if page else []
    found = passages(weights_of(lines))
    if not articles_of(lines):
        found = with_prose(found, lines)
    return "\n\n".join(lines[i][0] for a, b in found for i in range(a, b + 1) if lines[i][0])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages``; a map over rows, without a shuffle."""
    kind = dict(pages.dtypes)

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(extract, f"page_id {kind['page_id']}, url string, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
