"""Main text of web pages by a tree-structured graphical model over the DOM.

Each element of a page is a variable: main content or not. Its own potential is a weighted sum of features (tag, parent's tag, words of
class, id and role, lengths and link share of its subtree); a potential for each edge says how parent and child go together, by the child's
kind. The graph is the DOM tree, so sum-product message passing once upward and once downward gives exact marginals. Weights of both
potentials are trained on labelled pages by gradient ascent of the exact likelihood, whose expectations are the same marginals.
Elements with a marginal of LIMIT or more give their own text.

Labelled pages are pages with `data-main` marks: "1" on an element that is main content, "0" on one that is not, for all below it up to the
next mark; what has no mark above it is not. `labelled_pages` makes a bounded set of them in several layouts; `train` takes others too.

A null or empty page, and one without main text, gives an empty text. Character references are decoded, white space inside a block (a <br>
too) becomes one space, empty blocks go, and blocks are joined by a line break. Text in head, script, style and the like is never text.
Tags may be unclosed: an element ends where its parent ends, a paragraph at the next block, a list item at the next one; end tags of nothing
are ignored, an unclosed comment or tag runs to the page's end. A very long page is parsed whole, in memory that follows its length. Equal
pages give equal texts, repeated rows repeated rows; ids, null or not, pass unchanged; other columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import html as references
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: Marginal from which an element is main content; pages that are trained on; steps and step size of the training, and its ridge.
LIMIT, PAGES, STEPS, RATE, RIDGE = 0.5, 500, 200, 1.0, 0.003
#: Characters of pages whose trees are in memory at once (one page at least).
RUN = 1 << 20

# Kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select option object head datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - frozenset("body caption html dd dt legend li tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
ENDS_BEFORE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr"), "tfoot": ("tbody", "tr"), "option": ("option",)}
#: An element of these hides open elements outside it from tags inside it that would end them.
WALLS = {"li": frozenset(("ul", "ol", "menu", "table")), "dt": frozenset(("dl", "table")), "dd": frozenset(("dl", "table"))}
TABLES, CELLS = frozenset(("table",)), frozenset(("table", "td", "th", "caption"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("html body div section main article table tbody tr td center".split())
FURNITURE = frozenset("nav footer header aside form menu dialog search".split())
INLINE_KIND, TEXT_KIND, CONTAINER_KIND, FURNITURE_KIND, ROOT_KIND = range(5)

TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)|(?:[!?/])[^>]*(?:>|\Z))", re.DOTALL)
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|data-main|hidden|style|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Elements in page order: the parent's number (-1 for the root), feature names, kind; texts of elements: (element, block, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    words: list[tuple[str, ...]] = field(default_factory=list)
    mark: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Elements and texts. A block number changes at each start and end of a block element, so that texts with one number are one block."""
    page = Page([-1], ["html"], [()], [0])
    open_, count, block, at, skipped = [0], {"html": 1}, 0, 0, 0

    def leave(to: int) -> None:
        nonlocal block, skipped
        while len(open_) > to:
            tag = page.tag[open_.pop()]
            count[tag] -= 1
            block += tag in BLOCKS
            skipped -= tag in SKIPPED

    def ended_by(tags: tuple[str, ...], walls: frozenset[str]) -> None:
        """Leaves the outermost open element of `tags` that no wall hides."""
        if not any(count.get(t) for t in tags):
            return
        found = None
        for i in range(len(open_) - 1, 0, -1):
            tag = page.tag[open_[i]]
            if tag in walls:
                break
            if tag in tags:
                found = i
                if not any(count[t] > 1 for t in tags if t in count):
                    break
        if found:
            leave(found)

    def text(piece: str) -> None:
        if piece and not skipped:
            page.texts.append((open_[-1], block, piece))

    while (start := source.find("<", at)) >= 0:
        m = TAG.match(source, start)
        if not m:  # a lone angle
            text(source[at : start + 1])
            at = start + 1
            continue
        text(source[at:start])
        at, name = m.end(), m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            same = HEADINGS if name in HEADINGS else (name,)  # any heading's end tag ends the open heading
            if any(count.get(t) for t in same):
                i = len(open_) - 1
                while page.tag[open_[i]] not in same:
                    i -= 1
                if i > 0:
                    leave(i)
            elif name == "p":
                block += 1
            continue
        if name == "br":
            text(" ")
            continue
        if name in CLOSES_P:
            ended_by(("p",), CELLS)
        if name in ENDS_BEFORE:
            ended_by(ENDS_BEFORE[name], WALLS.get(name, TABLES))
        words, mark, rest = (), -1, m["rest"]
        if "=" in rest or "hidden" in rest:
            words, mark = _attributes(rest)
        if name in ("html", "body") and count.get(name):
            page.mark[0] = mark if mark >= 0 and name == "html" else page.mark[0]
            continue
        block += name in BLOCKS
        if name in VOID:
            continue
        own = len(page.parent)
        page.parent.append(open_[-1])
        page.tag.append(name)
        page.words.append(words)
        page.mark.append(page.mark[open_[-1]] if mark < 0 else mark)
        if name in RAW:  # its end tag is all that ends it
            end = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = end.start() if end else len(source)
        elif rest.endswith("/") and name in ("svg", "math"):
            continue
        open_.append(own)
        count[name] = count.get(name, 0) + 1
        skipped += name in SKIPPED
    text(source[at:])
    return page


def _attributes(rest: str) -> tuple[tuple[str, ...], int]:
    words, mark = [], -1
    for key, a, b, c in NAMES.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "data-main":
            mark = int(value == "1")
        elif key in ("hidden", "aria-hidden"):
            words += ["hidden"] if value.lower() != "false" else []
        elif key == "style":
            words += ["hidden"] if "display:none" in value.replace(" ", "").lower() else []
        else:
            words += [w.lower() for w in WORDS.findall(value)]
    return tuple(dict.fromkeys(words)), mark


def _level(n: float, base: float = 2.0) -> int:
    return min(12, int(np.log(n + 1) / np.log(base)))


LEVELS = [_level(n) for n in range(1 << 13)]


def features_of(page: Page) -> Iterator[list[str]]:
    """Names of the features of each element. Sums over subtrees are taken from the last element to the first."""
    n = len(page.parent)
    chars, linked, ends, fields, paragraphs, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    before, seen = [0] * n, 0
    last = -1
    for node, _, piece in page.texts:
        for i in range(last + 1, node + 1):
            before[i] = seen
        last = max(last, node)
        size = len(piece)
        own[node] += size
        ends[node] += piece.count(". ") + piece.count("? ") + piece.count("! ") + piece.rstrip().endswith((".", "?", "!"))
        seen += size
    for i in range(last + 1, n):
        before[i] = seen
    for i in range(n - 1, -1, -1):
        chars[i] += own[i]
        tag, up = page.tag[i], page.parent[i]
        if tag == "a":
            linked[i] = chars[i]
        fields[i] += tag in ("button", "label", "textarea", "select", "form")
        paragraphs[i] += tag == "p"
        if up >= 0:
            chars[up] += chars[i]
            linked[up] += linked[i]
            ends[up] += ends[i]
            fields[up] += fields[i]
            paragraphs[up] += paragraphs[i]
    around, all_ = [0] * n, max(1, chars[0] - linked[0])
    for i in range(n):
        tag, up = page.tag[i], page.parent[i]
        kind = KIND.get(tag, INLINE_KIND)
        box = around[i] = i if kind >= CONTAINER_KIND or up < 0 else around[up]  # the nearest container, itself too
        size = LEVELS[min(chars[i], len(LEVELS) - 1)]
        share = 4 * linked[i] // chars[i] if chars[i] else 5
        out = ["bias", f"kind {kind}", f"tag {tag}", f"tag {tag} under {page.tag[up] if up >= 0 else ''}", f"size {kind} {size // 2}", f"links {kind} {share}", f"ends {min(ends[i], 3)} {min(share, 1)}", f"place {4 * before[i] // max(1, seen)}", f"paragraphs {kind} {min(paragraphs[i], 3)}"]
        out += [f"share {kind} {4 * (chars[box] - linked[box]) // all_}", f"inside {kind} {page.tag[box]}"]
        if fields[box]:
            out.append(f"fields {kind} {min(3, 100 * fields[box] // max(1, chars[box]))}")
        out += [f"word {w}" for w in page.words[i]]
        if box != i:
            out += [f"inside {w}" for w in page.words[box]]
        yield out


KIND = {t: CONTAINER_KIND for t in CONTAINERS} | {t: FURNITURE_KIND for t in FURNITURE} | {t: TEXT_KIND for t in BLOCKS - CONTAINERS - FURNITURE} | {"html": ROOT_KIND}
KINDS = 5


@dataclass
class Forest:
    """Trees of many pages at once: parents (-1 for roots), kinds, elements of each depth, and features as (element, number) pairs."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    node: np.ndarray
    feature: np.ndarray


def forest(pages: list[Page], number: dict[str, int], grow: bool = False) -> Forest:
    parent, kind, depth, node, feature, base = [], [], [], [], [], 0
    for page in pages:
        for i, names in enumerate(features_of(page)):
            up = page.parent[i]
            parent.append(up + base if up >= 0 else -1)
            depth.append(depth[up + base] + 1 if up >= 0 else 0)
            kind.append(KIND.get(page.tag[i], INLINE_KIND))
            for name in names:
                f = number.setdefault(name, len(number)) if grow else number.get(name)
                if f is not None:
                    node.append(i + base)
                    feature.append(f)
        base += len(page.parent)
    deep = np.array(depth, np.int64)
    order = np.argsort(deep, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(deep))[:-1]) if base else []
    return Forest(np.array(parent, np.int64), np.array(kind, np.int64), levels, np.array(node, np.int64), np.array(feature, np.int64))


def sum_product(trees: Forest, own: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all elements (n x 2), and of all edges (n x parent's state x child's state; zeros for roots), from log potentials: own
    (n x 2), edges (kinds x 2 x 2). Messages go upward from the deepest level and then downward; all elements of a level at once."""
    n = len(own)
    belief, up, down = own.copy(), np.zeros((n, 2)), np.zeros((n, 2))
    for level in reversed(trees.levels[1:]):
        up[level] = np.logaddexp.reduce(belief[level][:, None, :] + edges[trees.kind[level]], axis=2)
        for s in (0, 1):
            np.add.at(belief[:, s], trees.parent[level], up[level, s])
    pair = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        p = trees.parent[level]
        rest = belief[p] + down[p] - up[level]  # what the parent knows without this child
        joint = rest[:, :, None] + edges[trees.kind[level]]
        down[level] = np.logaddexp.reduce(joint, axis=1)
        joint = joint + belief[level][:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        pair[level] = np.exp(joint)
        pair[level] /= pair[level].sum(axis=(1, 2), keepdims=True)
    whole = belief + down
    whole = np.exp(whole - np.logaddexp.reduce(whole, axis=1)[:, None])
    return whole, pair


@dataclass
class Model:
    number: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray


def _own(trees: Forest, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(trees.parent), 2))
    out[:, 1] = np.bincount(trees.node, weights[trees.feature], len(out)) if len(trees.node) else 0
    return out


def train(pages: Iterable[str]) -> Model:
    """Ascends the likelihood of the pages' marks, with steps scaled by past gradients."""
    parsed, number = [parse(p) for p in pages], {}
    trees = forest(parsed, number, grow=True)
    y = np.array([m for p in parsed for m in p.mark])
    weights, edges = np.zeros(len(number)), np.zeros((KINDS, 2, 2))
    past_w, past_e = np.full_like(weights, 1e-6), np.full_like(edges, 1e-6)
    child = trees.parent >= 0
    told = np.zeros((KINDS, 2, 2))
    np.add.at(told, (trees.kind[child], y[trees.parent[child]], y[child]), 1)
    for _ in range(STEPS):
        one, pair = sum_product(trees, _own(trees, weights), edges)
        expected = np.zeros_like(told)
        np.add.at(expected, trees.kind[child], pair[child])
        grad_w = np.bincount(trees.feature, (y - one[:, 1])[trees.node], len(weights)) - RIDGE * weights
        grad_e = told - expected - RIDGE * edges
        past_w, past_e = past_w + grad_w**2, past_e + grad_e**2
        weights, edges = weights + RATE * grad_w / np.sqrt(past_w), edges + RATE * grad_e / np.sqrt(past_e)
    return Model(number, weights, edges)


def marginals(pages: list[Page], model: Model) -> np.ndarray:
    """Of being main content, for the elements of all pages in a row."""
    trees = forest(pages, model.number)
    return sum_product(trees, _own(trees, model.weights), model.edges)[0][:, 1]


def text_of(page: Page, main: np.ndarray) -> str:
    """Blocks of the elements in `main`, in page order."""
    blocks: list[tuple[int, list[str]]] = []
    for node, block, piece in page.texts:
        if main[node]:
            if not blocks or blocks[-1][0] != block:
                blocks.append((block, []))
            blocks[-1][1].append(piece)
    lines = (" ".join("".join(map(references.unescape, own)).split()) for _, own in blocks)
    return "\n".join(x for x in lines if x)


def extract_texts(pages: list[str | None], model: Model) -> list[str]:
    """In runs of pages of about RUN characters."""
    out, run, size = [], [], 0
    for i, source in enumerate(pages):
        run.append(parse(source or ""))
        size += len(source or "")
        if size >= RUN or i + 1 == len(pages):
            main, at = marginals(run, model) >= LIMIT, 0
            for page in run:
                out.append(text_of(page, main[at : at + len(page.parent)]))
                at += len(page.parent)
            run, size = [], 0
    return out


def extract(pages: DataFrame, model: Model, key: str = "page_id", source: str = "html", beside: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns `beside`, and text. Keys and columns pass as Arrow, unchanged."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # a weight for each feature of PAGES pages
    own = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate((key, *beside))], F.col(source).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            texts = pa.array(extract_texts(b.column(b.num_columns - 1).to_pylist(), held.value), pa.string())
            yield pa.RecordBatch.from_arrays([*columns, texts], names)

    kinds = dict(own.dtypes)
    names = [*own.columns[:-1], "text"]
    out = own.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in own.columns[:-1]) + ", text string")
    return out.toDF(key, *beside, "text")


# Words that pages use in class and id, by what they mark; fixed values of the labelled pages
MAIN_WORDS = "article articlebody body content entry main post story text page blog news single primary column".split()
MENU_WORDS = "nav menu navbar topnav breadcrumb breadcrumbs links pagination pager toc tabs navigation".split()
HEAD_WORDS = "header top banner masthead branding logo site title topbar".split()
FOOT_WORDS = "footer bottom copyright legal colophon credits foot imprint".split()
SIDE_WORDS = "sidebar aside widget related recommended popular secondary rail tags archive trending more".split()
AD_WORDS = "ad ads advert advertisement sponsor sponsored promo banner promoted adbox adsense".split()
NOTICE_WORDS = "cookie notice consent gdpr alert popup modal overlay message warning banner subscribe paywall".split()
FORM_WORDS = "form search newsletter signup login subscribe contact register".split()
COMMENT_WORDS = "comments comment replies reply discussion respond disqus reader responses thread feedback".split()
SHARE_WORDS = "share social sharing follow byline buttons tools print meta".split()
PLAIN_WORDS = "wrapper container row inner outer left right box clearfix grid col block layout wide".split()


def labelled_pages(n: int = PAGES) -> list[str]:
    """n pages with `data-main` marks, the same at every run: an article of headings, paragraphs, lists, quotes and tables in one of several
    wrappings, with menus, headers, footers, sidebars, notices, adverts, forms and comments around and inside it."""
    return [_Maker(random.Random(i)).page() for i in range(n)]


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.named = rng.random() < 0.8  # whether elements carry class words
        self.semantic = rng.random() < 0.6  # whether <nav>, <article> and the like are used
        self.brief = rng.choice((0.0, 0.2, 0.2, 0.9))  # share of paragraphs of a few words

    def words(self, a: int, b: int) -> str:
        rng = self.rng
        out = ["".join(rng.choice("aeiou") + rng.choice("bdfglmnrst") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        return " ".join(out).capitalize()

    def sentences(self, a: int, b: int) -> str:
        return " ".join(self.words(4, 18) + self.rng.choice("....?!") for _ in range(self.rng.randint(a, b)))

    def element(self, tag: str, names: list[str], inside: str, mark: str = "", chance: float = 1.0) -> str:
        rng, own = self.rng, ""
        if names and self.named and rng.random() < chance:
            value = rng.choice(("{0}", "{0}", "{0}-{1}", "{0} {1}", "main-{0}", "{0}_{1}")).format(rng.choice(names), rng.choice([*names, *PLAIN_WORDS]))
            own = f' {rng.choice(("class", "class", "id"))}="{value}"'
        return f'<{tag}{own}{f" data-main={chr(34)}{mark}{chr(34)}" if mark else ""}>{inside}</{tag}>'

    def either(self, tag: str, other: str = "div") -> str:
        return tag if self.semantic else other

    def link(self, text: str) -> str:
        return f'<a href="/{self.rng.randint(0, 999)}">{text}</a>'

    def menu(self, names: list[str] = MENU_WORDS) -> str:
        links = [self.link(self.words(1, 2)) for _ in range(self.rng.randint(2, 9))]
        as_list = "<ul>" + "".join(f"<li>{x}{self.rng.choice(('</li>', ''))}" for x in links) + "</ul>"
        return self.element(self.either("nav"), names, self.rng.choice((as_list, " | ".join(links), " ".join(links))), "0")

    def form(self) -> str:
        inside = f"<p>{self.sentences(1, 2)}</p><label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>"
        return self.element("form", FORM_WORDS, inside, "0")

    def advert(self) -> str:
        rng = self.rng
        inside = rng.choice((self.sentences(1, 2), f"<p>{self.sentences(1, 2)}</p>", self.link(self.words(2, 6)), f"<span>{self.words(1, 1)}</span> {self.link(self.sentences(1, 1))}"))
        return f"<!-- ad -->{self.element(rng.choice(('div', 'div', 'aside', 'section')), AD_WORDS, inside, '0')}"

    def notice(self) -> str:
        inside = f"<p>{self.sentences(1, 3)}</p><button>{self.words(1, 2)}</button>" if self.rng.random() < 0.6 else self.sentences(1, 2) + self.link(self.words(1, 2))
        return self.element(self.rng.choice(("div", "div", "section", "dialog")), NOTICE_WORDS, inside, "0")

    def side(self) -> str:
        rng = self.rng
        boxes = "".join(f"<h3>{self.words(1, 3)}</h3><ul>" + "".join(f"<li>{self.link(self.words(2, 7))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>" for _ in range(rng.randint(1, 3)))
        return self.element(self.either("aside"), SIDE_WORDS, boxes + (f"<p>{self.sentences(1, 3)}</p>" if rng.random() < 0.5 else ""), "0")

    def comments(self) -> str:
        rng = self.rng
        each = [self.element(rng.choice(("div", "div", "li", "li", "p", "article")), COMMENT_WORDS, f"<b>{self.words(1, 2)}</b>: <span>{self.sentences(1, 4)}</span>") for _ in range(rng.randint(1, 6))]
        inside = f"<h3>{self.words(1, 2)}</h3>" + rng.choice(("{}", "<ol>{}</ol>")).format("".join(each)) + (self.form() if rng.random() < 0.4 else "")
        return self.element(rng.choice(("section", "div", "div")), COMMENT_WORDS, inside, "0")

    def inline(self, text: str) -> str:
        rng, words = self.rng, text.split(" ")
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(len(words))
            words[a] = rng.choice(("<b>{}</b>", "<em>{}</em>", "<a href='/x'>{}</a>", "<span>{}</span>", "<code>{}</code>", "<i>{}</i>", "<strong>{}</strong>")).format(words[a])
        return " ".join(words)

    def paragraph(self) -> str:
        rng = self.rng
        kind = rng.random()
        if kind < 0.72:
            text = self.words(1, 4) + rng.choice(".,. ") if rng.random() < self.brief else self.sentences(1, 9)
            return f"<p>{self.inline(text)}{rng.choice(('</p>', '</p>', '</p>', ''))}"
        if kind < 0.78:
            return f"<p><b>{self.sentences(1, 4)}<br>"
        if kind < 0.84:
            level = rng.randint(2, 4)
            return f"<h{level}>{self.words(1, 6)}</h{level}>"
        if kind < 0.89:
            return rng.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format("".join(f"<li>{self.inline(self.words(2, 14))}</li>" for _ in range(rng.randint(2, 6))))
        if kind < 0.92:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 2)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(rng.randint(2, 5))) + "</table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{self.words(3, 9)}.</figcaption></figure>"
        return f"<pre>{self.words(3, 9)}\n  {self.words(2, 5)}</pre>"

    def article(self) -> str:
        rng = self.rng
        body = [self.paragraph() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 13, 60)))]
        if rng.random() < 0.06:  # no paragraph elements
            body = [rng.choice(("{}<br>", "<div>{}</div>")).format(self.sentences(1, 6)) for _ in body]
        for chance, make in ((0.35, self.advert), (0.12, lambda: self.menu(SHARE_WORDS)), (0.1, self.form), (0.1, self.notice), (0.08, self.side)):
            if rng.random() < chance:
                body.insert(rng.randint(0, len(body)), make())
        if rng.random() < 0.15:
            body.append(self.comments())
        title = f"<h1>{self.words(1, 12)}</h1>" if rng.random() < 0.9 else ""
        if rng.random() < 0.2:
            title = f"<header>{title}</header>" if rng.random() < 0.5 else self.element("div", MAIN_WORDS, title)
        inside = title + "".join(body)
        if rng.random() < 0.25:
            inside = title + self.element("div", MAIN_WORDS, "".join(body))
        return self.element("article" if self.semantic or rng.random() < 0.3 else rng.choice(("main", "div", "section", "td") if self.named else ("main",)), MAIN_WORDS, inside, "1", 0.6)

    def page(self) -> str:
        rng = self.rng
        before = [make() for chance, make in ((0.3, self.notice), (0.8, self.menu), (0.4, self.advert), (0.15, self.form), (0.2, self.side)) if rng.random() < chance]
        if rng.random() < 0.5:
            inside = rng.choice(("<h1>{}</h1>", "<p>{}</p>", "<span>{}</span>")).format(self.words(1, 4)) + (self.menu() if rng.random() < 0.4 else "")
            before.insert(0, self.element(self.either("header"), HEAD_WORDS, inside, "0"))
        after = [make() for chance, make in ((0.3, self.side), (0.25, self.comments), (0.2, self.advert), (0.15, self.form), (0.1, self.notice)) if rng.random() < chance]
        if rng.random() < 0.8:
            text = rng.choice(("&copy; {}", "{}", "<p>&copy; {}</p>", "<p>{}</p>")).format(self.sentences(1, 2))
            after.append(self.element(self.either("footer"), FOOT_WORDS, text + (self.menu(FOOT_WORDS) if rng.random() < 0.3 else ""), "0"))
        own = self.article()
        if own.startswith("<td"):
            own = f"<table><tr>{own}</tr></table>"
        if rng.random() < 0.04:
            own = ""
        middle = "".join([*before, own, *after])
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            middle = self.element("div", PLAIN_WORDS, middle)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body>{middle}</body></html>"


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"), train(labelled_pages()), beside=("url",))
    return found.withColumn("n_chars", F.length("text").cast("long"))
