"""Main text of HTML pages by tree scoring.

A small tree is built from Python's HTML parser. Blocks with text of their own (paragraphs) give points for their
length and commas to their parent, half to its parent and less further up. A container's points are discounted by its link
density. The best container is kept whole, with all that stands beside it or its ancestors, up to the outermost article or main that it
lies in and its siblings, or else up to the page; outside that article, what is mostly links is dropped. Parts that are never article text
(menus, adverts, forms and so on) are cut off first: by element and role, and by names that say nothing else and hold no article. Inside an article
only the names of adverts, comments, menus and the like count. A form around the page's paragraphs is no form.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style head title noscript template nav footer aside form button input select textarea option iframe object embed svg canvas math audio video dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body figcaption h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article main section div body td blockquote html".split())
CLOSES_P = BLOCKS - frozenset("html body caption tbody thead tfoot tr td th legend".split())
WRITTEN = frozenset("p pre blockquote h1 h2 article main".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tr", "td", "th", "tbody", "thead", "tfoot")}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments reply replies respond disqus cookie cookies consent gdpr notice alert popup modal overlay "
    "footer foot header masthead nav navbar navigation menu menus sidebar side widget related recommended share sharing social newsletter subscribe subscription login signup search pagination pager toolbar skip copyright".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())  # what readers wrote, even if in an article of its own
FIRM_WORDS = frozenset("ad ads advert advertisement sponsor cookie".split()) | COMMENT_WORDS
INLINE = frozenset("p span b i em strong h1 h2 h3 blockquote pre table figure".split())  # these are noise by firm words only
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
# Words that say nothing of their own in a class name: "site-footer" is a footer, "has-sidebar" isn't a sidebar.
PLAIN_WORDS = frozenset("site page global top bottom left right box block section wrap wrapper container area list item items inner outer bar slot unit links link button buttons icons posts post articles form main primary secondary sub panel column col row zone group id the and for google text thread message module".split())
# Parts of a page that articles have too: inside an article these words take nothing away.
SHARED_WORDS = frozenset("header footer foot masthead notice alert banner side search copyright widget toolbar overlay skip".split())
_NOISE_INSIDE = NOISE_WORDS - SHARED_WORDS
ASIDE = 0.3  #: a container with a noise word among others in its name counts so much less
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "kids", "noise", "named", "share", "around", "points", "chars", "linked")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.named, self.share, self.around = False, 1.0, False  # noise by its name only; weight of its points; holds an article
        self.kids: list[Node | str] = []
        self.points, self.chars, self.linked = 0.0, 0, 0


def _is_noise(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """Whether the element itself says that it isn't article text."""
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body"):
        return False
    return any(
        key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in NOISE_ROLES) or (key == "style" and value and _HIDDEN.search(value) is not None)
        for key, value in attrs
    )


def _by_name(node: Node, attrs: list[tuple[str, str | None]], inside_article: bool) -> None:
    """Judges by class and id. A name made of noise words and plain ones is noise; a noise word among others only lowers the score.

    Inside an article, words that articles use for parts of their own don't count.
    """
    noise = _NOISE_INSIDE if inside_article else NOISE_WORDS
    for key, value in attrs:
        if key in ("class", "id") and value:
            for name in value.split():
                words = [w.lower() for w in _WORDS.findall(name)]
                if any(w in noise for w in words):
                    if all(w in noise or w in PLAIN_WORDS for w in words) and (node.tag not in INLINE or not FIRM_WORDS.isdisjoint(words)):
                        node.noise = node.named = True
                        if not COMMENT_WORDS.isdisjoint(words):
                            node.named = False
                    else:
                        node.share = ASIDE


class _Tree(HTMLParser):
    """Builds nodes; closes what HTML lets authors leave open, and ignores end tags that close nothing. `open` counts the open elements of each
    name, so nothing climbs in vain however deep a page is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at = self.root
        self.open: Counter[str] = Counter()

    def _close(self, names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        if not any(self.open[x] for x in names):
            return
        node, left = self.at, []
        while node.parent is not None and node.tag not in scope:
            left.append(node.tag)
            if node.tag in names:
                self.at = node.parent
                self.open.subtract(left)
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("td", "th", "button", "table"))
        if tag in ENDS:
            self._close(ENDS[tag], SCOPES.get(tag, ()))
        if tag == "br":
            self.at.kids.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.at.kids.append(Node(tag, self.at))
            return
        if tag in ("html", "body") and not attrs and self.at.tag == tag:
            return
        node = Node(tag, self.at, _is_noise(tag, attrs, bool(self.open["article"] or self.open["main"])))
        if not node.noise and tag not in ("html", "body", "main"):
            _by_name(node, attrs, bool(self.open["article"] or self.open["main"]))
        if tag in ("article", "main") and not node.noise:
            up = self.at
            while up is not None and not up.around:  # names don't take away what holds an article
                up.around = True
                if up.named:
                    up.noise = up.named = False
                up = up.parent
        self.at.kids.append(node)
        self.at = node
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe"):
            self._close((tag,))

    def handle_endtag(self, tag: str) -> None:
        self._close((tag,), ("table",) if tag not in BLOCKS or tag in ("p", "li") else ())

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def _parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    _unwrap_forms(tree.root)
    return tree.root


def _unwrap_forms(root: Node) -> None:
    """A form that holds more than half of the page's text, in paragraphs or headings, is a wrapper around the page and no form."""
    nodes, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "form" or not node.noise:
            nodes.append(node)
            todo.extend(k for k in node.kids if isinstance(k, Node))
    if not any(n.tag == "form" and n.noise for n in nodes):
        return
    chars: dict[int, int] = {}
    texts: dict[int, int] = {}  # paragraphs and headings
    for node in reversed(nodes):
        here = [k for k in node.kids if isinstance(k, Node) and id(k) in chars]
        chars[id(node)] = sum(len(k.strip()) for k in node.kids if isinstance(k, str)) + sum(chars[id(k)] for k in here)
        texts[id(node)] = (node.tag in WRITTEN) + sum(texts[id(k)] for k in here)
    for node in nodes:
        if node.tag == "form" and 2 * chars[id(node)] > chars[id(root)] and texts[id(node)] > 1:
            node.noise = False


def _in_order(root: Node) -> list[Node]:
    """Nodes that aren't noise, parents first; without recursion, as pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.noise:
            out.append(node)
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return out


def _best(nodes: list[Node]) -> Node:
    own: dict[int, str] = {}
    for node in reversed(nodes):  # children before parents
        direct = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.chars = direct + sum(k.chars for k in node.kids if isinstance(k, Node) and not k.noise)
        node.linked = node.chars if node.tag == "a" else sum(k.linked for k in node.kids if isinstance(k, Node) and not k.noise)
        if node.tag in PARAGRAPHS:
            own[id(node)] = _flow(node)
    for node in nodes:
        text = own.get(id(node), "")
        if text:
            points = (1 + text.count(",") + text.count("，") + text.count("、") + min(len(text) / 100, 3)) * (1 - node.linked / max(1, node.chars))
            up, share = node.parent, 1.0
            if node.tag in CONTAINERS and node.tag != "blockquote" and node.tag != "td":
                up = node  # text straight inside a container is the container's own
            for level in range(5):
                if up is None:
                    break
                if up.tag in CONTAINERS:
                    up.points += points * share
                    share = 0.5 if level == 0 else share * 0.5
                up = up.parent
    found = [n for n in nodes if n.tag in CONTAINERS]
    return max(found, key=lambda n: n.points * n.share * (1 - n.linked / max(1, n.chars)) * (1.25 if n.tag in ("article", "main") else 1)) if found else nodes[0]


def _flow(node: Node) -> str:
    """The node's text without that of blocks inside it."""
    out, todo = [], list(reversed(node.kids))
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.noise and k.tag not in BLOCKS:
            todo.extend(reversed(k.kids))
    return _SPACE.sub(" ", "".join(out)).strip()


def _blocks(node: Node) -> Iterator[str]:
    """Texts of the blocks below the node, in page order."""
    run: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        k = todo.pop()
        if k is None:
            if text := _SPACE.sub(" ", "".join(run)).strip():
                yield text
            run = []
        elif isinstance(k, str):
            run.append(k)
        elif not k.noise:
            if k.tag in BLOCKS:
                todo.append(None)
                todo.extend(reversed(k.kids))
                todo.append(None)
            else:
                todo.extend(reversed(k.kids))
    if text := _SPACE.sub(" ", "".join(run)).strip():
        yield text


def _around(best: Node) -> Node:
    """The node whose text is the article; takes from it what is mostly links beside the best container and its ancestors, but not inside an article."""
    path, top = [best], None
    while path[-1].parent is not None:
        if path[-1].tag in ("article", "main"):
            top = len(path)
        path.append(path[-1].parent)
    if top is not None:
        path = path[: top + 1]
    for node, own in list(zip(path[1:], path, strict=False))[max(0, (top or 1) - 1) :]:
        kids: list[Node | str] = []
        run: list[Node | str] = []
        for k in [*node.kids, None]:
            if k is not None and k is not own and (isinstance(k, str) or k.tag not in BLOCKS):
                run.append(k)  # text between blocks stands or goes as a whole
                continue
            for part in (run, [] if k is None else [k]):
                chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in part)
                if k is own and part is not run or 2 * sum(x.linked for x in part if isinstance(x, Node)) <= chars:
                    kids += part
            run = []
        node.kids = kids
    return path[-1]


def main_text(html: str | None) -> str:
    """The article of a page: blocks joined by newlines, white space in a block made one space. Null, or no text: empty."""
    if not html:
        return ""
    root = _parse(html)
    nodes = _in_order(root)
    best = _best(nodes)
    if not best.chars:  # names have taken all away: go by elements only
        todo = [root]
        while todo:
            node = todo.pop()
            node.noise = node.noise and not node.named
            node.points = 0.0
            todo.extend(k for k in node.kids if isinstance(k, Node))
        best = _best(_in_order(root))
    return "\n".join(_blocks(_around(best))) if best.chars else ""


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


@F.pandas_udf(_OUT)
def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        texts = [main_text(h) for h in s]
        yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extracted(html: Column) -> Column:
    """Struct of `text` and `n_chars` for each page; null and empty pages have "" and 0. Each row stands alone."""
    return _extracted(html)
