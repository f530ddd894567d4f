"""Main text of web pages by consensus: pages of a host vote for the path of the container that holds it.

Every page scores its containers by the text that stands in them outside menus, adverts, forms and the
like. It votes for the tag-class paths that score well, digits left out so that pages of one template
agree; Spark counts the votes of each host; then each page is read again with its host's winning path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml object canvas audio video select".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("body main article section div td blockquote".split())
OUTSIDE = frozenset("head nav footer aside form menu dialog button".split())
#: An element of the first kind ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TERMS = (
    r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|comments?|commentlist|disqus|replies|respond|sidebar|nav|navbar|navigation|menu|footer|"
    r"cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|widgets?|toolbar|masthead|site-header)"
)
_PLACES = r"(?:left|right|top|bottom|upper|lower|primary|secondary|main|site|page|global|first|last|inner|outer|slot|unit|list|area|box|bar|block|section|container|wrapper|wrap|links?|buttons?|icons?|items?|posts?|articles?|stories|form|\d+)"
#: Whole names, and compounds of such names with places and parts; what holds a state (no-sidebar, comments-open) isn't one.
UNWANTED = re.compile(rf"(?:^|\s)(?:{_PLACES}[_-])*{_TERMS}(?:[_-](?:{_TERMS}|{_PLACES}|content|body|text))*(?:$|\s)", re.IGNORECASE)
#: Names that, alone, are as well those of what an article is about: inside one, what they name goes only if it is mainly links and forms.
AMBIGUOUS = re.compile(r"^(?:share|sharing|social|menu|navigation|banner|notices?|promo(?:tion)?s?|related|recommended|subscribe|signup|consent)$", re.IGNORECASE)
#: What readers wrote is read only where there is hardly anything else.
_REPLIES = re.compile(r"comment|disqus|replies|respond", re.IGNORECASE)
MOST, NEARLY_ALL = 0.5, 0.9
WANTED = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text)(?:$|[\s_-])", re.IGNORECASE)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
WEIGHTS = {"article": 1.5, "main": 1.3, "body": 0.7}
#: What an ancestor gets of the text that counts in full for the container right around it.
DECAY, LEVELS = 0.8, 5
#: A page votes for the paths that score at least this share of its best one.
VOTE_SHARE = 0.5
#: A winning path that is named as an article's, beside a best one that isn't, must hold this share of what that holds; any other nearly all. Else what holds both is read.
LEAST_SHARE = 0.25
#: Winning paths are broadcast up to this size; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*\Z|<\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


@dataclass
class Page:
    """Containers (path, parent, weight) and runs of text (container, text, whether in a link) in page order."""

    paths: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    weights: list[float] = field(default_factory=lambda: [0.5])
    runs: list[tuple[int, str, bool]] = field(default_factory=list)


def _step(tag: str, names: str) -> str:
    classes = sorted(set(re.sub(r"\d+", "#", names.lower()).split()))[:2]
    return ".".join([tag, *classes])


def parse(html: str, spared: frozenset[int] = frozenset()) -> Page:
    """The page. An element that its names leave out is read if it holds most of the text in paragraphs; ``spared`` are the places of such.

    Inside an article, one of ambiguous names is read if it holds more text in paragraphs than in links and forms.
    """
    page = Page()
    # tag, container, left out, in a link, place of the element whose names leave this out (or -1), in a paragraph, the same place in its forms too
    stack: list[tuple[str, int, bool, bool, int, bool, int]] = [("", 0, False, False, -1, False, -1)]
    shown, held, share, other, unsure = 0, {}, {}, {}, set()
    at, n = 0, len(html)
    runs = page.runs
    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        tag, box, out, link, by, para, near = stack[-1]
        if text and near >= 0 and (link or by < 0):
            other[near] = other.get(near, 0) + len(text.strip())
        if text and not out:
            runs.append((box, unescape(text) if "&" in text else text, link))
        if text and para and not link:
            if not out:
                shown += len(text.strip())
            elif by >= 0:
                held[by] = held.get(by, 0) + len(text.strip())
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name or m[0][-1] != ">":
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        name, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in BLOCK and not out:
            runs.append((box, " ", link))
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCK:  # it ends an open paragraph, and an item ends the one before it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ()):
                    del stack[k:]
                    break
                if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "table", "dl"):
                    break
        if rest.endswith("/") and name not in BLOCK:
            continue
        tag, box, out, link, by, para, near = stack[-1]
        inside = any(t[0] in ("article", "main") for t in stack)
        names, hidden, named, replies, doubt = "", False, False, False, inside
        if rest.strip(" /"):
            for a in _ATTRIBUTE.finditer(rest):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id"):
                    if name not in ("html", "body", "article", "main") and UNWANTED.search(value):
                        named = True
                        doubt &= all(AMBIGUOUS.match(x) for x in value.split() if UNWANTED.search(x))
                    replies |= bool(_REPLIES.search(value))
                    names += " " + value if key == "class" else ""
                elif key == "role":
                    hidden |= value.lower() in ROLES
                elif key == "hidden":
                    hidden |= a.start() == 0 or rest[a.start() - 1].isspace()
                elif key == "aria-hidden":
                    hidden |= value.lower() == "true"
                else:
                    hidden |= "display:none" in value.replace(" ", "").lower()
        hidden |= name in OUTSIDE or (name == "header" and not inside)
        if hidden:
            by = -1
        elif named and not out and m.start() not in spared:
            hidden, by, near = True, m.start(), m.start()
            share[by] = NEARLY_ALL if replies else MOST
            if doubt:
                unsure.add(by)
        out = out or hidden
        if name in CONTAINERS and not out:
            weight = WEIGHTS.get(name, 1.25 if WANTED.search(names) else 1.0)
            page.paths.append(f"{page.paths[box]}/{_step(name, names)}")
            page.parents.append(box)
            page.weights.append(weight)
            box = len(page.paths) - 1
        stack.append((name, box, out, link or name == "a", by, para or name == "p", near))
    total = shown + sum(held.values())
    most = {place for place, n in held.items() if n > share[place] * total or (place in unsure and n > other.get(place, 0))}
    return parse(html, spared | most) if most else page


def scores(page: Page) -> dict[str, float]:
    """The best score of a container with each path that has one."""
    own = [0.0] * len(page.paths)
    for box, text, link in page.runs:
        credit = float(len(text.strip()))
        if link or not credit:
            continue
        for _ in range(LEVELS):
            own[box] += credit
            credit *= DECAY
            box = page.parents[box]
            if box < 0:
                break
    out: dict[str, float] = {}
    for path, weight, s in zip(page.paths, page.weights, own):
        if s > 0:
            out[path] = out.get(path, 0.0) + weight * s
    return out


def text_under(page: Page, path: str) -> str:
    """The text of the containers with this path, white space made single."""
    inside: list[bool] = []
    for p, parent in zip(page.paths, page.parents):
        inside.append(p == path or (parent >= 0 and inside[parent]))
    return " ".join("".join(t for box, t, _ in page.runs if inside[box]).split())


def best_path(found: dict[str, float]) -> str | None:
    return max(found, key=lambda p: (found[p], p)) if found else None


def _measure(page: Page, path: str) -> tuple[int, int]:
    """How many characters stand in the containers with this path: outside links, in links."""
    inside: list[bool] = []
    plain = linked = 0
    for p, parent in zip(page.paths, page.parents):
        inside.append(p == path or (parent >= 0 and inside[parent]))
    for box, text, link in page.runs:
        if inside[box]:
            n = len(text.strip())
            plain, linked = (plain, linked + n) if link else (plain + n, linked)
    return plain, linked


def _upwards(page: Page, path: str) -> list[str]:
    """The path and those of what encloses it, from the inside."""
    box, out = page.paths.index(path), []
    while box >= 0:
        out.append(page.paths[box])
        box = page.parents[box]
    return out


def climbed(page: Page, path: str) -> str:
    """The path of the outermost container that adds to the text of this one no more than it holds, and not mainly links.

    An article or a main around it is taken in any case.
    """
    around = _upwards(page, path)
    named = [re.split(r"[./]", p[len(q) + 1 :], maxsplit=1)[0] in ("article", "main") for p, q in zip(around, around[1:])]
    first = named.index(True) if True in named else 0
    best, (plain, linked) = around[first], _measure(page, around[first])
    for q in around[first + 1 :]:
        more, links = _measure(page, q)
        if more == plain and links == linked:
            continue
        if more - plain <= links - linked or more - plain > plain:
            break
        best, plain, linked = q, more, links
    return best


def _wanted(path: str) -> bool:
    """Whether the innermost container of a path is named as one of an article."""
    tag, *names = path.rsplit("/", 1)[-1].split(".")
    return tag in ("article", "main") or any(WANTED.search(n) for n in names)


def main_text(html: str, winner: str | None) -> tuple[str, str]:
    """The text and the path that it was read by."""
    page = parse(html)
    own = best_path(scores(page))
    if own is None:
        return "", ""
    read = own
    if winner is not None and winner != own and winner in page.paths:
        agreed, best = len(text_under(page, winner)), len(text_under(page, own))
        nested = own in _upwards(page, winner) or winner in _upwards(page, own)
        if agreed >= NEARLY_ALL * best or (not nested and _wanted(winner) and not _wanted(own) and agreed >= LEAST_SHARE * best):
            read = winner
        else:
            over = set(_upwards(page, winner))
            read = next(p for p in _upwards(page, own) if p in over)
    read = climbed(page, read)
    return text_under(page, read), read


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes: what the pages of each host vote for, each path as its share of the page's best score."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[tuple[str, str], float] = {}
            for host, html in zip(batch["host"], batch["html"]):
                found = scores(parse(html))
                top = max(found.values(), default=0.0)
                for path, s in found.items():
                    if s >= VOTE_SHARE * top:
                        out[host, path] = out.get((host, path), 0.0) + s / top
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["host", "path", "votes"])

    read = common.bound_batches(pages).where(F.col("html").isNotNull()).select(host_of(F.col("url")).alias("host"), "html")
    return read.mapInPandas(vote, "host string, path string, votes double").groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winners(pages: DataFrame) -> DataFrame:
    """host, winner: one row for each host with a vote; of equal paths the longer name wins, then the larger."""
    counted = votes(pages).groupBy("host")
    return counted.agg(F.max_by("path", F.struct(F.round("votes", 6), F.length("path"), F.col("path"))).alias("winner"))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, path.

    Null or empty html, and pages without text, give an empty text; a page without a host is of the host
    named by an empty text; a page that lacks its host's winning path is read by its own best; rows that
    repeat give rows that repeat; an empty table gives none; other columns are not looked at.
    """
    won = common.keep(winners(pages))
    small = common.fits(won, BROADCAST_BYTES, F.octet_length("host") + F.octet_length("winner") + 64)
    rows = pages.select(common.text_id(pages, "page_id"), "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.join(F.broadcast(won) if small else won, "host", "left").drop("host")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(html, winner) for html, winner in zip(batch["html"], batch["winner"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [t for t, _ in found], "path": [p for _, p in found]})

    out = rows.mapInPandas(read, "page_id string, url string, text string, path string")
    return common.typed_id(out, pages, "page_id").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; nulls, empties, long pages, ties and repeats as ``extract`` states."""
    return extract(common.read(spark, sf_dir, "pages"))
