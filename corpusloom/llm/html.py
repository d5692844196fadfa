"""HTML extraction with site template removal: element subtrees are hashed and counted per host in Spark, and those that
recur across many pages of a host are deleted.

Two passes over the pages. The first emits each page's elements with text: a number of the subtree (its place in the
page, its tags and its text, in which numbers and the host's name are masked) and one of its slot (the place alone: the tags, classes and ids above it). Spark
counts both by host. Pages of a host with the same main content, or without any the same html, count as one, as a page may be
held under several addresses.

* A subtree is template if the share of its host's pages that hold it is surely (lower bound of a confidence interval, so a few pages
  suffice where all agree) over OUTSIDE; inside an article or main element, where recurring text is mostly content, INSIDE.
* A site also fills a slot with one of many texts: menus by section, adverts, quotes of the day. A slot that stands once on a
  page is template if most of its host's pages fill it with a subtree that other pages of the host have too. A host's share is
  smoothed by that of the same slot over all hosts together, so it holds for hosts of few pages. Content differs from page to page.

The second pass drops a page's templates, and what the markup itself names as no content (scripts, navigation, forms, adverts,
notices, comments), and joins the blocks of what is left: those of the outermost article or main elements where a page
has any, else of its body. A name counts if the whole class or id says so ("cookie-notice", "site-footer", not "has-sidebar"); it drops no article
or main element, none of a page's paragraphs within these, and no element that holds most of the page's articles, or where there are none most of its text.

A host's templates are at most 1 / share times the subtrees of its mean page. They are joined to pages by host with
a size-checked broadcast, or else over salted hosts, so a host with a third of all pages is spread.

Defined cases: null and empty html give an empty text; broken markup is read as far as it goes (an unclosed element ends with
its parent, an unclosed comment, script or tag at the end); null urls form a host ""; repeated rows get one result each, and count
as one page together; very long pages are read whole, in linear time; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, scratch, table

#: Shares of a host's pages from which a subtree or a slot is template, the interval's width, and the pages that the share over all hosts counts for.
OUTSIDE, INSIDE, SLOT_OUTSIDE, SLOT_INSIDE, Z, SMOOTHING, SALTS = 0.3, 0.6, 0.5, 0.8, 1.645, 20.0, 32
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
#: Elements without content of their own, elements whose content is no text, and elements that a block ends at.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe canvas".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open one of the same kind ends at.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Elements and names that are no main content.
ASIDE = frozenset("nav aside form footer menu dialog button select head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promos promotion promotions banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars side bar widget widgets footer masthead comment comments reply replies respond disqus share sharing social related recommended pagination pager toolbar skip".split())
#: Words that a name of such an element may have beside them.
BESIDE = frozenset("site page main global primary secondary top bottom left right box block list container wrapper wrap area inner outer section item items content header title links link buttons button slot unit holder group row post entry article blog the".split())
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements that a name drops within an article or main element; text of its own, such as a paragraph, stays there whatever its class.
CONTAINERS = frozenset("div section ul ol dl table figure fieldset details center address ins span".split())
MOST = 0.5
SPACE, DIGITS = re.compile(r"\s+"), re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
KNOWN = frozenset("class id role style hidden aria-hidden".split())


class Page:
    """A page's elements in order of their start (0 is the page itself), and events: an element's number as it starts, -number as it ends, and texts."""

    def __init__(self):
        self.tags: list[str] = ["#root"]
        self.parents: list[int] = [0]
        self.attributes: list[dict[str, str]] = [{}]
        self.events: list[int | str] = []


def parse(source: str) -> Page:
    """The page of a source, in time linear in its length."""
    page = Page()
    tags, events = page.tags, page.events
    stack, blocks, open_tags = [0], [], Counter()  # blocks: places in the stack
    at, size = 0, len(source)

    def close() -> str:
        node = stack.pop()
        events.append(-node)
        tag = tags[node]
        open_tags[tag] -= 1
        if blocks and blocks[-1] == len(stack):
            blocks.pop()
        return tag

    while at < size:
        start = source.find("<", at)
        if start != at:
            events.append(source[at : start if start >= 0 else size])
            if start < 0:
                break
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        m = NAME.match(source, start + 1)
        if not m:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                end = source.find(">", start)
                at = end + 1 if end >= 0 else size
            else:
                events.append("<")
                at = start + 1
            continue
        tag, known, at = m[2].lower(), {}, m.end()
        if not m[1]:
            while (a := ATTRIBUTE.match(source, at)) is not None:
                at = a.end()
                if (name := a[1].lower()) in KNOWN:
                    known.setdefault(name, (a[2] or "").strip("\"'"))
        end = source.find(">", at)
        at = end + 1 if end >= 0 else size
        if m[1]:
            if open_tags[tag]:
                while close() != tag:
                    pass
            continue
        while blocks and tag in CLOSED_BY.get(tags[stack[blocks[-1]]], ()):
            depth = blocks[-1]
            while len(stack) > depth:
                close()
        number = len(tags)
        tags.append(tag)
        page.parents.append(stack[-1])
        page.attributes.append(known)
        events.append(number)
        if tag in RAW:
            m = RAW_END[tag].search(source, at)
            end = source.find(">", m.end()) if m else -1
            at = end + 1 if end >= 0 else size
        if tag in RAW or tag in VOID or source[end - 1] == "/":
            events.append(-number)
            continue
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(number)
        open_tags[tag] += 1
    while len(stack) > 1:
        close()
    return page


@functools.lru_cache(100_000)
def names_aside(names: str, header: bool) -> bool:
    """Whether a class or id says as a whole that its element is no content. header: whether this word does."""
    for name in names.split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        told = [w in ASIDE_WORDS or header and w == "header" for w in words]
        if any(told) and all(t or w in BESIDE or w.isdigit() for t, w in zip(told, words)) and words != ["side"] and words != ["bar"]:
            return True
    return False


def is_aside(tag: str, a: dict[str, str], inside: bool, holds_mains: bool, holds_most: bool) -> bool:
    """Whether the markup itself names the element as no main content. holds_mains: whether most of the page's articles are in it; holds_most: or most of its text."""
    if tag in RAW:
        return True
    if holds_mains:
        return False
    if tag in ASIDE or tag == "header" and not inside:  # an article's own header holds its title
        return not (tag == "form" and holds_most)
    if not a or holds_most:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")) or a.get("role", "").lower() in ASIDE_ROLES:
        return True
    if tag in ("body", "html", "main", "article") or inside and tag not in CONTAINERS:
        return False
    return names_aside(f'{a.get("class", "")} {a.get("id", "")}', not inside)


def is_main(tag: str, a: dict[str, str]) -> bool:
    return tag in ("article", "main") or a.get("role", "").lower() in ("main", "article")


def hashed(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"\0".join(parts), digest_size=8).digest()


def number_of(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


class Marks:
    """What is known of each element: dropped (it, or one above it, is named as no content), inside (of an article or main element), slot and digest."""

    def __init__(self, page: Page, roles: bool = True):
        n = len(page.tags)
        self.page, self.dropped, self.inside, self.slots, self.mains = page, [False] * n, [False] * n, [b""] * n, []
        sizes, in_mains, whole = self._sizes() if roles else ([], [], [])
        for i in range(1, n):
            up, tag, a = page.parents[i], page.tags[i], page.attributes[i]
            names = [DIGITS.sub("0", a[k]) for k in ("class", "id", "role") if k in a]
            self.slots[i] = hashed(self.slots[up], tag.encode(), *(x.encode("utf-8", "surrogatepass") for x in names))
            self.dropped[i] = self.dropped[up] or (is_aside(tag, a, self.inside[up], in_mains[0] > 0 and in_mains[i] >= MOST * in_mains[0], sizes[i] >= MOST * whole[i]) if roles else tag in RAW or tag == "head")
            main = roles and not self.inside[up] and not self.dropped[i] and is_main(tag, a)
            self.inside[i] = self.inside[up] or main
            if main:
                self.mains.append(i)

    def _sizes(self) -> tuple[list[int], list[int], list[int]]:
        """Of each element its characters of text, those of them in outermost article or main elements that are within it, and the
        characters of what it is part of: the outermost article or main element around it, else the page."""
        page, n = self.page, len(self.page.tags)
        sizes, in_mains, outer = [0] * n, [0] * n, [0] * n
        for i in range(1, n):
            up = page.parents[i]
            outer[i] = outer[up] or (up if is_main(page.tags[up], page.attributes[up]) else 0)
        text, inner, main, since = 0, 0, 0, [(0, 0)]
        for e in page.events:
            if isinstance(e, str):
                size = len(e) - e.count(" ")
                text, inner = text + size, inner + (size if main else 0)
            elif e > 0:
                since.append((text, inner))
                main = main or (e if is_main(page.tags[e], page.attributes[e]) else 0)
            else:
                t, m = since.pop()
                sizes[-e], in_mains[-e] = text - t, inner - m if not outer[-e] else 0
                main = 0 if main == -e else main
        sizes[0], in_mains[0] = text, inner
        return sizes, in_mains, [sizes[outer[i]] for i in range(n)]

    def digests(self, host: str) -> tuple[list[bytes], list[bool]]:
        """Of each element the digest of its tags and text, numbers and the host's name masked, and whether it has any text."""
        page, n = self.page, len(self.page.tags)
        out, texts = [b""] * n, [False] * n
        parts: list[list[bytes]] = [[]]
        for e in page.events:
            if isinstance(e, str):
                if text := DIGITS.sub("0", SPACE.sub(" ", e.replace(host, "host") if host else e).strip()):
                    parts[-1].append(b"t" + text.encode("utf-8", "surrogatepass"))
            elif e > 0:
                parts.append([page.tags[e].encode()])
            else:
                own = parts.pop()
                out[-e] = hashed(*own)
                texts[-e] = len(own) > 1 and any(x[:1] == b"t" or x[:1] == b"T" for x in own[1:])
                parts[-1].append((b"T" if texts[-e] else b"n") + out[-e])
        out[0] = hashed(*parts[0])
        return out, texts


def elements(source: str, host: str = "") -> tuple[int, list[tuple[int, int, bool, bool]]]:
    """A number for what the page is about, and slot, subtree, alone (in its slot) and inside of its elements with text."""
    page = parse(source)
    marks = Marks(page)
    digests, texts = marks.digests(host)
    about = [digests[i] for i in marks.mains if texts[i]]
    content = number_of(hashed(b"m", *about) if about else hashed(b"w", digests[0]))
    times = Counter(marks.slots)
    found = [i for i in range(1, len(page.tags)) if texts[i] and page.tags[i] not in ("html", "body", "head")]
    return content, [(number_of(marks.slots[i]), number_of(hashed(marks.slots[i], digests[i])), times[marks.slots[i]] == 1, marks.inside[i]) for i in found]


def main_text(source: str | None, templates: frozenset[int] = frozenset(), host: str = "", roles: bool = True) -> str:
    """The main text: blocks in page order, one a line. Without roles only templates, scripts and the like are dropped."""
    if not source:
        return ""
    page = parse(source)
    marks = Marks(page, roles)
    dropped = marks.dropped
    if templates:
        digests, _ = marks.digests(host)
        times = Counter(marks.slots)
        for i in range(1, len(page.tags)):
            slot = marks.slots[i]
            dropped[i] = dropped[i] or dropped[page.parents[i]] or (times[slot] == 1 and number_of(slot) in templates) or number_of(hashed(slot, digests[i])) in templates
    blocks: list[str] = []
    line: list[str] = []
    inside, hidden = [not marks.mains], [False]

    def end_block() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(line))).strip()
        line.clear()
        if text:
            blocks.append(text)

    for e in page.events:
        if isinstance(e, str):
            if inside[-1] and not hidden[-1]:
                line.append(e)
            continue
        node = abs(e)
        if page.tags[node] in BLOCK:
            end_block()
        elif page.tags[node] == "br":
            line.append(" ")
        if e > 0:
            inside.append(inside[-1] or marks.inside[node])
            hidden.append(dropped[node])
        else:
            inside.pop()
            hidden.pop()
    end_block()
    return "\n".join(blocks)


def surely(k: Column, n: Column, z: float = Z) -> Column:
    """The lower bound of the share k / n (Wilson's interval)."""
    return (k + z * z / 2 - z * F.sqrt(k * (n - k) / n + z * z / 4)) / (n + z * z)


def host_templates(pages: DataFrame) -> DataFrame:
    """host and templates, the numbers of its recurring subtrees and slots."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for host, source in zip(p["host"], p["html"]):
                page, found = elements(source or "", host)
                out += [(host, page, 0, 0, False, False), *((host, page, *x) for x in found)]
            yield pd.DataFrame(out, columns=["host", "page", "slot", "subtree", "alone", "inside"])

    seen = pages.mapInPandas(read, "host string, page long, slot long, subtree long, alone boolean, inside boolean")
    once = seen.groupBy("host", "slot", "subtree", "page").agg(F.min("alone").alias("alone"), F.min("inside").alias("inside"))
    counts = once.groupBy("host", "slot", "subtree").agg(F.count("*").alias("pages"), F.count_if("alone").alias("alone"), F.min("inside").alias("inside"))
    counts = scratch(counts, "subtrees")
    totals = counts.filter("subtree = 0").select("host", F.col("pages").alias("all"))
    counts = counts.filter("subtree <> 0")
    least = F.when(F.col("inside"), INSIDE).otherwise(OUTSIDE)
    subtrees = counts.filter("pages > 1").join(totals, "host").filter(surely(F.col("pages"), F.col("all")) >= least).select("host", F.col("subtree").alias("number"))
    again = F.sum(F.when(F.col("pages") > 1, F.col("alone")).otherwise(0))
    alone = F.sum("alone").alias("n"), again.alias("again")
    slots = scratch(counts.groupBy("host", "slot").agg(F.sum("pages").alias("all"), *alone, F.min("inside").alias("inside")).filter("n > 0 AND 2 * n >= all"), "slots")
    anywhere = counts.groupBy("slot", "subtree").agg(F.sum("pages").alias("pages"), F.sum("alone").alias("alone"))
    everywhere = anywhere.groupBy("slot").agg(again.alias("again"), F.sum("alone").alias("n")).filter("n > 0").select("slot", (F.col("again") / F.col("n")).alias("prior"))
    least = F.when(F.col("inside"), SLOT_INSIDE).otherwise(SLOT_OUTSIDE)
    filled = slots.join(everywhere, "slot").filter((F.col("again") + SMOOTHING * F.col("prior")) / (F.col("n") + SMOOTHING) >= least).select("host", F.col("slot").alias("number"))
    return subtrees.unionByName(filled).groupBy("host").agg(F.collect_set("number").alias("templates"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    keyed = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    templates = scratch(host_templates(keyed.select("host", "html")), "templates")
    size = templates.agg(F.sum(8 * F.size("templates") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = keyed.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def text(sources: pd.Series, known: pd.Series, hosts: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, frozenset(k.tolist()) if k is not None else frozenset(), host) for s, k, host in zip(sources, known, hosts)], dtype=object)

    return joined.select("page_id", "url", text("html", "templates", "host").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op7_template_removal_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
