"""Main text of web pages by composite text density (operator 3).

For every node of the page's tree: characters per tag, weighted by how few of the characters stand in links compared with
the node and with the whole body. The densities of a node's children are summed; the node with the largest sum leads the
main text. The least density on the path from it to the body is the threshold. It judges what stands around that path: below
the main element, beside the outermost article, or else below the body. Text without links stays, other blocks where they
reach the threshold; all articles there stay, and what is in them but lists of links below the threshold.

Elements that by name or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader
comments take no part. A class, id or role says so by its head word alone ("site-nav", not "with-nav" or "nav-history"),
and never of an element that holds a main, an h1 or the page's articles. Words that also stand on wrappers of text ("widget") count
for nothing on a page where they mark the largest density sum, unless an article or main with text stands beside it.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.llm.words import slices

#: Markup: comments, declarations, instructions, tags (with quoted values, else up to the next >).
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
HIDDEN_VALUE = re.compile(r"\saria-hidden\s*=\s*[\"']?true|\sstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noframes".split())
#: Elements that are never main text.
DROPPED = frozenset("head script style noscript template iframe noframes object svg math canvas nav footer aside form "
                    "button select option textarea input dialog menu title audio video xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag of the key closes an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
CLOSES |= {name: {"p"} | CLOSES.get(name, set()) for name in BLOCKS - {"html", "body"}}
#: Open elements beyond which no such closing looks.
BARRIER = frozenset("html body div article section main table ul ol dl blockquote aside header footer nav form td th li dd figure".split())
#: Words of a class, id or role that mark what is no main text.
UNWANTED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget footer masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices alert disclaimer comment comments respond responses replies feedback disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login search form contentinfo "
    "complementary".split())
#: Of these, what an element named article may be.
UNWANTED_ARTICLES = frozenset("ad ads advert sponsored promo comment comments respond responses replies feedback related recommended".split())
#: A header by class is a page's, unless it is the header of one of these.
OWN_HEADERS = frozenset("article entry post content title story".split())
#: Of the unwanted words, those that also stand on wrappers of main text.
WEAK = frozenset(
    "banner sponsor sponsored promo promotion popup modal overlay sidebar aside widget topbar toolbar notice notices alert "
    "disclaimer share sharing social related recommended newsletter subscribe subscription search form complementary".split())
#: A header whose other words are all among these is the page's.
PAGE_HEADERS = frozenset("site website web page global main top app blog portal sticky fixed mobile desktop primary secondary".split())
#: Words after the head word that leave its meaning: parts, places and kinds of boxes.
PARTS = frozenset(
    "area articles bar block body bottom box button buttons card cards close col column container content count feed frame group "
    "heading holder icon icons inner item items label left link links list media message module outer panel placeholder post posts "
    "primary right row secondary section sections slot space stories strip text thread title toggle tools top unit wrap wrapper "
    "zone".split())
#: Words that turn a class into a statement about the element's surroundings or contents.
STATES = frozenset("with without no not non has have hide show".split())
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_marks(name: str) -> set[str]:
    """Unwanted words of a class, id or role whose head word is one of them; "header" for a page's header."""
    name = name.split("--")[0]  # what follows is a variant of the block
    pieces = [x for x in re.split("[-_]+", name) if x]
    found: set[str] = set()
    for words in ([x.lower() for x in pieces], [x.lower() for piece in pieces for x in CAMEL.findall(piece)]):
        end = len(words)
        while end > 1 and (words[end - 1] in PARTS or words[end - 1].isdigit()):
            end -= 1
        if not end or not STATES.isdisjoint(words[:end]):
            continue
        if words[end - 1] in UNWANTED:
            found.update(UNWANTED.intersection(words))
        elif words[end - 1] == "header" and PAGE_HEADERS.issuperset(words[:end - 1]) and OWN_HEADERS.isdisjoint(words):
            found.add("header")
    return found


class Page:
    """The tree of one page in arrays; node 0 is the root. Nodes that take no part have no entry."""

    def __init__(self, text: str):
        self.tag, self.parent, self.items, self.marks = ["html"], [-1], [[]], [frozenset()]
        self._read(text)
        self._cut_marked()

    def _open(self, at: int, name: str, marks: frozenset | set = frozenset()) -> int:
        self.tag.append(name)
        self.parent.append(at)
        self.items.append([])
        self.marks.append(marks)
        self.items[at].append(len(self.tag) - 1)
        return len(self.tag) - 1

    def _read(self, text: str) -> None:
        at, done, skipped = 0, 0, []  # skipped: open elements inside one that takes no part, itself first
        lowered = None
        while found := MARKUP.search(text, done):
            if found.start() > done and not skipped:
                self.items[at].append(text[done:found.start()])
            done = found.end()
            name = found["name"]
            if not name:
                continue
            name = name.lower()
            if found["close"]:
                if skipped:
                    if name in skipped:
                        while skipped.pop() != name:
                            pass
                        continue
                    if name not in BLOCKS:
                        continue
                up = at
                while up > 0 and self.tag[up] != name:
                    up = self.parent[up]
                if up > 0 and name not in ("html", "body"):
                    at, skipped = self.parent[up], []
                continue
            if name in RAW:
                lowered = lowered or (text.lower() if len(text.lower()) == len(text) else re.sub("[A-Z]", lambda m: m[0].lower(), text))
                end = lowered.find(f"</{name}", done)
                close = text.find(">", end) if end >= 0 else -1
                done = close + 1 if close >= 0 else len(text)
                continue
            if skipped:
                if name not in VOID:
                    skipped.append(name)
                continue
            if name in ("html", "body"):
                if name == "body" and "body" not in self.tag:
                    at = self._open(at, name)
                continue
            if name in CLOSES:
                up = at
                while up > 0 and self.tag[up] not in CLOSES[name] and self.tag[up] not in BARRIER:
                    up = self.parent[up]
                if up > 0 and self.tag[up] in CLOSES[name]:
                    at = self.parent[up]
            if name == "br":
                self.items[at].append(" ")
            elif name in VOID:
                if name == "hr":
                    self._open(at, name)
            elif self._unwanted(name, found["rest"], at):
                if not found["rest"].endswith("/"):
                    skipped = [name]
                self._open(at, "#cut" if name in BLOCKS else "#inline")
            else:
                marks = self._marks(name, found["rest"], at)
                opened = self._open(at, name, marks)
                if not (marks and found["rest"].endswith("/")):
                    at = opened
        if done < len(text) and not skipped:
            self.items[at].append(text[done:])

    def _inside(self, at: int, name: str) -> bool:
        while at >= 0 and self.tag[at] != name:
            at = self.parent[at]
        return at >= 0

    def _unwanted(self, name: str, rest: str, at: int) -> bool:
        """Whether an element takes no part by its name or because it is hidden."""
        if name in DROPPED or name == "header" and not self._inside(at, "article"):
            return True
        if not rest or name in ("body", "main"):
            return False
        return bool(HIDDEN_VALUE.search(rest) or HIDDEN.search(QUOTED.sub("", rest)))

    def _marks(self, name: str, rest: str, at: int) -> frozenset | set:
        """Unwanted words that mark an element by its class, id or role; "main" for the role of that name."""
        if not rest or name in ("body", "main", "h1"):
            return frozenset()
        names: list[str] = []
        for found in ATTRIBUTE.finditer(rest):
            key = found[1].lower()
            if key in ("class", "id", "role"):
                value = (found[2] or found[3] or found[4] or "").split()
                if key == "role" and "main" in value:
                    return {"main"}
                names += value
        marks = set().union(*map(name_marks, names)) if names else set()
        if name == "article":
            return marks & UNWANTED_ARTICLES
        if "header" in marks and (self._inside(at, "article") or any(x.lower() in OWN_HEADERS for n in names for x in CAMEL.findall(n))):
            marks.discard("header")
        return marks

    def _cut_marked(self) -> None:
        """Takes out what is marked, first by words that are sure; the others are judged by the largest density sum."""
        under = [bool(m) and m != {"main"} for m in self.marks]
        for i in range(1, len(under)):
            under[i] = under[i] or under[self.parent[i]]
        beside = any(tag in ("article", "main") and not u and c for tag, u, c in zip(self.tag, under, self._chars([False] * len(under))))
        # an article saves the elements around it from their marks where no other stands outside of marked ones
        leads = [tag in ("main", "h1") or m == {"main"} or tag == "article" and not m and not beside for tag, m in zip(self.tag, self.marks)]
        holds = [False] * len(self.tag)
        for i in range(len(self.tag) - 1, 0, -1):
            if leads[i] or holds[i]:
                holds[self.parent[i]] = True
        self.marks = [frozenset() if h or m == {"main"} else m for h, m in zip(holds, self.marks)]
        if not any(self.marks):
            return
        self._cut([not WEAK.issuperset(m) for m in self.marks])
        while any(self.marks):
            sums = self.densities()[1]
            best = max(range(self.tag.index("body") if "body" in self.tag else 0, len(sums)), key=lambda i: (sums[i], -i))
            path = self._path(best)
            if not any(self.marks[i] for i in path):
                path = self._heaviest(best)
            words = set().union(*(self.marks[i] for i in path))
            if not words:
                self._cut([bool(m) for m in self.marks])
            elif self._text_beside(path, words):
                self._cut([not m.isdisjoint(words) for m in self.marks])
            else:
                self.marks = [m if m.isdisjoint(words) else frozenset() for m in self.marks]

    def _path(self, at: int) -> set[int]:
        found = {at}
        while at > 0:
            at = self.parent[at]
            found.add(at)
        return found

    def _chars(self, out: list[bool]) -> list[int]:
        """Characters of each node outside links and outside the nodes of ``out``."""
        skip = [o or tag == "a" for o, tag in zip(out, self.tag)]
        for i in range(1, len(skip)):
            skip[i] = skip[i] or skip[self.parent[i]]
        chars = [0 if skip[i] else sum(len(" ".join(x.split())) for x in self.items[i] if isinstance(x, str)) for i in range(len(skip))]
        for i in range(len(skip) - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        return chars

    def _heaviest(self, top: int) -> set[int]:
        """Path of the marked node below ``top`` with the most characters, if such nodes hold more than half of them."""
        marked = [bool(m) for m in self.marks]
        below = [i == top for i in range(len(self.tag))]
        for i in range(1, len(below)):
            below[i] = below[i] or below[self.parent[i]]
        whole = self._chars([False] * len(self.tag))
        if 2 * self._chars(marked)[top] >= whole[top]:
            return set()
        return self._path(max((i for i in range(len(below)) if below[i] and marked[i]), key=lambda i: (whole[i], -i)))

    def _text_beside(self, path: set[int], words: set[str]) -> bool:
        """Whether an article or main off the path has text outside the elements that the words mark."""
        chars = self._chars([not m.isdisjoint(words) for m in self.marks])
        return any(chars[i] > 0 and i not in path and (self.tag[i] in ("article", "main")) for i in range(len(self.tag)))

    def _cut(self, out: list[bool]) -> None:
        """Empties nodes; what stands below them gets no entry."""
        if not any(out):
            return
        number, kept = [-1] * len(out), []
        for i in range(len(out)):
            up = self.parent[i]
            if up < 0 or number[up] >= 0 and not out[up]:
                number[i] = len(kept)
                kept.append(i)
        tag, items = self.tag, self.items
        self.parent = [number[self.parent[i]] if i else -1 for i in kept]
        self.tag = [("#cut" if tag[i] in BLOCKS else "#inline") if out[i] else tag[i] for i in kept]
        self.marks = [frozenset() if out[i] else self.marks[i] for i in kept]
        self.items = [[] if out[i] else [x if isinstance(x, str) else number[x] for x in items[i]] for i in kept]

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and the sum over its children; a run of text counts as a child. A node with
        no text outside links has a sum of 0."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags = ([0] * n for _ in range(4))
        own = [[len(" ".join(x.split())) for x in items if isinstance(x, str)] for items in self.items]
        for i in range(n - 1, -1, -1):
            chars[i] += sum(own[i])
            if self.tag[i] == "a":
                link_chars[i] = chars[i]
                link_tags[i] += 1
            if i:
                up = self.parent[i]
                chars[up] += chars[i]
                tags[up] += tags[i] + 1
                link_chars[up] += link_chars[i]
                link_tags[up] += link_tags[i]
        body = self.tag.index("body") if "body" in self.tag else 0
        body_share = link_chars[body] / max(chars[body], 1)

        def density(c: int, t: int, lc: int, lt: int) -> float:
            if not c:
                return 0.0
            base = math.log(max(c / max(c - lc, 1) * lc + body_share * c, 1) + math.e)
            share = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1 if lc else 2)
            return c / max(t, 1) * math.log(share) / math.log(base)

        of = [density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
        linked = [False] * n
        for i in range(n):
            linked[i] = self.tag[i] == "a" or i > 0 and linked[self.parent[i]]
        sums = [0.0 if linked[i] else sum(density(c, 1, 0, 0) for c in own[i]) for i in range(n)]
        for i in range(1, n):
            sums[self.parent[i]] += of[i]
        return of, [s if chars[i] > link_chars[i] else 0.0 for i, s in enumerate(sums)]

    def _links(self) -> tuple[list[int], list[int], list[int]]:
        """Of each node: characters of text, characters in links, and links."""
        n = len(self.tag)
        chars = [sum(len(" ".join(x.split())) for x in items if isinstance(x, str)) for items in self.items]
        linked, links = [0] * n, [int(tag == "a") for tag in self.tag]
        for i in range(n - 1, 0, -1):
            if self.tag[i] == "a":
                linked[i] = chars[i]
            for of in (chars, linked, links):
                of[self.parent[i]] += of[i]
        return chars, linked, links

    def main_nodes(self) -> list[bool]:
        """Which nodes are main text, below the node that holds all of it.

        The path from the node of the largest density sum to the body gives the threshold, its least density. The nodes that
        are judged stand below the main element on that path, else beside the outermost article on it, else below the body.
        What the path holds stays. What stands beside it stays where it has no links, or reaches the threshold, or is an
        article; inside a main or an article that holds for all but lists of links below the threshold.
        """
        of, sums = self.densities()
        keep = [False] * len(sums)
        body = self.tag.index("body") if "body" in self.tag else 0
        best = max(range(body, len(sums)), key=lambda i: (sums[i], -i))
        if sums[best] <= 0:
            return keep
        path = [best]
        while path[-1] != body and self.parent[path[-1]] >= 0:
            path.append(self.parent[path[-1]])
        threshold = min(of[i] for i in path)
        mains = [i for i in path if self._is_main(i)]
        articles = [i for i in path if self.tag[i] == "article"]
        region = mains[-1] if mains else self.parent[articles[-1]] if articles else body
        chars, linked, links = self._links()
        on_path, stack = set(path), [(region, bool(mains))]
        while stack:
            i, inside = stack.pop()
            keep[i] = True
            inside = inside or self.tag[i] == "article"
            for x in self.items[i]:
                if isinstance(x, str):
                    continue
                listed = links[x] > 1 and 2 * linked[x] > chars[x] and of[x] < threshold
                if x in on_path or not links[x] or self.tag[x] not in BLOCKS or not listed and (
                        inside or of[x] >= threshold or self.tag[x] == "article" or self._is_main(x)):
                    stack.append((x, inside))
        return keep

    def _is_main(self, i: int) -> bool:
        return self.tag[i] == "main" or self.marks[i] == {"main"}

    def blocks(self, keep: list[bool]) -> list[str]:
        """Text of the kept nodes, in blocks."""
        found: list[str] = []
        held: list[str] = []

        def flush() -> None:
            block = " ".join("".join(held).split())
            held.clear()
            if block:
                found.append(block)

        stack: list = [keep.index(True)] if True in keep else []
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                held.append(html.unescape(item) if "&" in item else item)
            else:
                if self.tag[item] in BLOCKS or self.tag[item] == "#cut":
                    flush()
                    stack.append(None)
                if keep[item]:
                    stack.extend(reversed(self.items[item]))
        flush()
        return found


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by an empty line."""
    if not page:
        return ""
    tree = Page(page)
    return "\n\n".join(tree.blocks(tree.main_nodes()))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``, from its whole html.

    Null or empty html, and pages without any text of their own, give an empty text. Markup may be unclosed or nested
    wrongly. Repeated rows each give a row; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                                                  pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
