"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors: all to the parent, half to the grandparent, a third
to the next and so on. A container's points are discounted by its share of link text. The best container is kept whole,
with those siblings that score well too; page furniture inside is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm import arrow

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var img wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot semantics".split()
)
# An opening tag ends the open elements listed for it, up to the nearest element that bounds them.
P_ENDS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"},
    "thead": {"tr", "td", "th", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
# Page furniture by element, role and by the words of class and id.
FURNITURE = set(
    "script style noscript template head title nav footer aside button select textarea input iframe svg canvas object menu dialog "
    "audio video datalist annotation".split()
)
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted comment comments "
    "disqus respond replies sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs footer foot masthead topbar "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay share sharing "
    "social related recommended recommendations pagination pager widget widgets toolbar skip disclaimer".split()
)
# Names that also occur in ordinary paragraphs of an article, and those of reader comments that also name a part of a paper.
WEAK = set("notice notices alert share sharing related recommended promo promotion disclaimer foot rail skip widget banner social overlay".split())
TALK = set("discussion discussions reactions responses".split())
HEADER_NAMES = {"header", "head"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre"}
GOOD = set("article content main body entry post story text page wrapper container layout".split())
PARAGRAPHS = set("p pre blockquote td li dd h2 h3 figcaption".split())
WHOLE = {"article", "main"}
# A container with this share of link text is a menu; a sibling with this share of the best score is kept.
LINKED = 0.75
# A form that has this share of the page's prose is a container; a named paragraph of so many characters belongs to its article.
ENCLOSING = 0.5
SENTENCE = 50
SIBLING = 0.2


@dataclass(eq=False)
class Node:
    tag: str
    parent: Node | None
    words: list[str] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)  # words of each class and of the id
    inside: list[Node | str] = field(default_factory=list)
    role: str = ""
    chars: int = 0
    linked: int = 0
    links: int = 0
    score: float = 0.0
    scored: bool = False
    holds: bool = False  # an article, main or first heading is inside
    prose: int = 0  # characters of paragraphs inside
    replies: bool = False  # a control to answer with is inside


_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Tree(HTMLParser):
    """Nodes in page order; unknown and unclosed tags never fail."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None)
        self.nodes = [self.root]
        self.depth: dict[str, int] = {}

    def _close(self, node: Node) -> None:
        while self.at is not node:
            self._up()
        self._up()

    def _up(self) -> None:
        self.depth[self.at.tag] -= 1
        self.at = self.at.parent or self.root

    def _end(self, tags: set[str], bounds: set[str]) -> None:
        """Close the outermost open element of ``tags`` that no bound separates from here."""
        if not any(self.depth.get(t) for t in tags):
            return
        node, found = self.at, None
        while node is not self.root and node.tag not in bounds:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self._close(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body"):
            tag = "body" if tag == "body" and not self.depth.get("body") else tag
            if tag == "html":
                return
        if tag in P_ENDS and self.depth.get("p"):
            self._end({"p"}, {"table", "button", "td", "th", "object"})
        if tag in ENDS:
            self._end(ENDS[tag], BOUNDS.get(tag, {"table"}))
        node = Node(tag, self.at)
        for key, value in attrs:
            if key in ("class", "id") and value:
                node.names += [_SPLIT.split(_CAMEL.sub(" ", name).lower()) for name in value.split()]
                node.words += [w for name in node.names for w in name]
            elif key == "role" and value:
                node.role = value.strip().lower()
            elif key in ("hidden",) or key == "aria-hidden" and value == "true":
                node.role = "dialog"
        self.at.inside.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.at = node
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID or not self.depth.get(tag):
            return
        node = self.at
        while node.tag != tag:
            # A stray inline end tag does not close blocks.
            if tag in INLINE and node.tag not in INLINE:
                return
            node = node.parent
        self._close(node)

    def handle_data(self, data: str) -> None:
        self.at.inside.append(data)


def _within_article(n: Node) -> bool:
    up = n.parent
    while up is not None and up.tag not in WHOLE:
        up = up.parent
    return up is not None


def _is_furniture(n: Node, prose: int) -> bool:
    # A form around the page's main part is a container; its controls are furniture themselves.
    if n.tag == "form" and not n.holds and (not n.prose or n.prose < ENCLOSING * prose):
        return True
    if n.tag in FURNITURE or n.role in ROLES:
        return True
    if n.tag in WHOLE or n.tag in ("body", "html") or n.holds:
        return False
    if n.tag == "header" or HEADER_NAMES & {*n.words}:
        return not _within_article(n)
    if TALK & {*n.words}:
        return n.replies or not _within_article(n)
    # A name counts where it makes up half of a class, as in page-sidebar, and not in share-of-market.
    names = {w for name in n.names if 2 * sum(w in NAMES for w in name) >= len(name) for w in name}
    if not names & NAMES or (names & GOOD and not names & {"comment", "comments", "ad", "ads", "sidebar", "cookie"}):
        return False
    return not (names & NAMES <= WEAK and n.tag in PROSE and n.prose >= SENTENCE and _within_article(n))


def main_text(html: str) -> str:
    """Text of the article: blocks in page order, white space as one blank, nothing of the page's furniture."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    nodes = tree.nodes
    for n in nodes:
        if n.tag in WHOLE or n.tag == "h1":
            up = n.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    for n in reversed(nodes):
        if n.tag in PROSE:
            n.prose += len(_flat(n).strip())
        n.replies |= n.tag in ("form", "textarea")
        if n.parent is not None and n.tag not in FURNITURE:
            n.parent.prose += n.prose
            n.parent.replies |= n.replies
    out: set[Node] = set()
    for n in nodes[1:]:
        if n.parent in out or _is_furniture(n, tree.root.prose):
            out.add(n)
    # Children come after their parents, so sums run backwards.
    for n in reversed(nodes):
        if n in out:
            continue
        n.chars += sum(len(x.strip()) for x in n.inside if isinstance(x, str))
        if n.tag == "a":
            n.linked, n.links = n.chars, 1
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
            n.parent.links += n.links
    for n in nodes[1:]:
        if n in out or n.parent in out or n.chars == 0:
            continue
        loose = n.tag not in PARAGRAPHS and n.tag not in INLINE and n.tag not in ("h1", "html") and any(isinstance(x, str) and x.strip() for x in n.inside)
        if n.tag in PARAGRAPHS or loose:
            own = _flat(n)
            points = (1 + own.count(",") + len(own) / 100) * (1 - n.linked / n.chars)
            up, level = (n if loose else n.parent), 1
            while up is not None:
                up.score += points / level
                up.scored = True
                up, level = up.parent, level + 1
    for n in nodes:
        if n.scored and n.chars:
            n.score *= 1 - n.linked / n.chars
    # Of equal scores the inner container, which comes later.
    best = None
    for n in nodes:
        if n.scored and n not in out and n.tag not in INLINE and (best is None or n.score >= best.score):
            best = n
    if best is None:
        return ""
    up, whole = best, None
    while up is not None:
        if up.tag in WHOLE:
            whole = up
            if up.tag == "article":
                break
        up = up.parent
    if whole is None:
        # Loose paragraphs around an article let its container win; the article is still the page's main part.
        inside = [n for n in nodes if n.tag in WHOLE and n not in out and n.score >= SIBLING * best.score and n.scored]
        whole = max(inside, key=lambda n: (n.tag == "article", n.score), default=None)
    if whole is not None:
        return _render([whole], out, True)
    if best.tag in PARAGRAPHS and best.parent is not None:
        best = best.parent
    around = [x for x in best.parent.inside if isinstance(x, Node)] if best.parent is not None else [best]
    return _render([x for x in around if x is best or _good_sibling(x, best, out)], out)


def _good_sibling(n: Node, best: Node, out: set[Node]) -> bool:
    if n in out or not n.chars:
        return False
    density = n.linked / n.chars
    if n.tag == "h1":
        return True
    if n.tag == "p":
        return density < 0.25 and (n.chars > 80 or density == 0)
    return n.score >= max(10.0, SIBLING * best.score)


def _flat(n: Node) -> str:
    """Text of a node without the nodes inside that are paragraphs themselves."""
    parts: list[str] = []
    todo: list[Node | str] = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is n or x.tag in INLINE:
            todo.extend(reversed(x.inside))
    return "".join(parts)


def _headed(n: Node, out: set[Node]) -> bool:
    """Whether a heading comes right before the node, or is in it."""
    if n.parent is not None:
        before = None
        for x in n.parent.inside:
            if x is n:
                break
            if isinstance(x, Node) and x not in out:
                before = x
        if before is not None and before.tag in HEADINGS - {"h1"}:
            return True
        if n.parent.tag in ("li", "dd", "ul", "ol", "dl", "td", "tr", "tbody", "table") and n.parent.parent is not None:
            return _headed(n.parent, out)
    todo = [n]
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            return True
        todo += [c for c in x.inside if isinstance(c, Node) and c not in out]
    return False


def _render(top: list[Node], out: set[Node], whole: bool = False) -> str:
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(top))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
            continue
        if x in out:
            continue
        # Lists of links are menus, but not those that have a heading in an article.
        if x.tag in ("ul", "ol", "div", "section", "table", "dl") and x.links > 1 and x.chars and x.linked / x.chars >= LINKED and x not in top:
            if not (whole and _headed(x, out)):
                continue
        if x.tag in INLINE:
            todo.extend(reversed(x.inside))
        else:
            parts.append(" ")
            todo.append(" ")
            todo.extend(reversed(x.inside))
    return " ".join("".join(parts).split())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """id, url, text and n_chars (code points) of every page.

    Null and empty pages, and pages without any paragraph, give an empty text. Of containers with equal scores the inner and
    later one wins. Pages are read whole at any length and nesting; repeated rows are extracted each; other columns are
    ignored.
    """
    pages = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in arrow.steps(batches, "html"):
            found = [main_text(h) if h else "" for h in step.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), step.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    return pages.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
