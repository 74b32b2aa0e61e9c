"""Main text of web pages by a graphical model on the tree of elements.

Each element is a variable with the values boilerplate, content and frame (what
holds content and boilerplate side by side). Parent and child are joined by a
potential, and an element's tag, its names (class, id,
role), the length and punctuation of its own text and the share of links in its
text are its evidence. Messages that go up to the root and down again give each
element's marginal; text whose element is more likely content is kept.

The model is fitted on pages that label themselves: those with
an ``article`` or ``main`` element, in which what lies inside is content unless
an element of another kind (navigation, header, footer, aside, form, advert,
notice, comments) holds it. Other pages have no such element, so each page is
counted three times: as it is, with those elements as ``div``, and with their
children in their place. Weights of tags, names and words of names are learned
from those counts. A tenth of each distribution is a prior, so that nothing is
ruled out by what the pages lack; with no page to learn from, it alone decides.
"""

from __future__ import annotations

import copy
import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages, about, that the model is counted on.
SAMPLE = 2000
#: Features that the model keeps besides those of fixed kinds, the most frequent ones, and the elements that show a word of a name at least.
FEATURES = 5000
LEAST = 5
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Attributes whose values name an element.
_NAMING = frozenset("class id role aria-label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
_RAW = frozenset("script style noscript template textarea title iframe object svg math xmp noembed noframes select".split())
#: Their closing tags, searched in the page itself: lower case may have another length.
_RAW_END = {name: re.compile("</" + name, re.I | re.A) for name in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "button", "option", "html", "body", "head", "title"}
#: An opening tag ends an open element of these kinds, up to the given ones.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BOILER_TAGS = frozenset("nav header footer aside form menu dialog button head label fieldset".split())
_BOILER_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner notice notices alert cookie cookies consent gdpr popup modal newsletter subscribe signup login comment comments respond reply replies disqus share sharing social related recommended recommendations widget toolbar pagination pager copyright legal tags form search skip".split()
)
_CONTENT_NAMES = frozenset("article content main post entry story text body page".split())
#: Words that tell a name's place or shape only, and such as turn it round.
_NEUTRAL = frozenset("site left right top bottom upper lower inner outer primary secondary global wrapper wrap container box list item items block section area bar row col column links link buttons button group inline fixed sticky".split())
_WITHOUT = frozenset("no has with without hide hides".split())


def kind(value: str) -> tuple[str, list[str]]:
    """``boiler``, ``content`` or ``none`` for one name, by its last word that is not of place or shape; and its words."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
    telling = [x for x in parts if x not in _NEUTRAL]
    if not telling or not _WITHOUT.isdisjoint(parts):
        return "none", parts
    return "boiler" if telling[-1] in _BOILER_NAMES else "content" if telling[-1] in _CONTENT_NAMES else "none", parts


class Page:
    """Elements of a page in order, parents first, and its pieces of text.

    Markup need not be well formed: what is never closed ends with its parent,
    and closing tags without an open element are passed over.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.kinds, self.words = ["#root"], [-1], ["none"], [frozenset()]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, starts a block
        self._stack, self._open = [0], {}  # open elements, and the places in it of each tag
        at, block = 0, True
        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self.pieces.append((self._stack[-1], source[at : m.start()], block))
                block = False
            at = m.end()
            closing, name, inside = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
            if not name:
                continue
            name = name.lower()
            block |= name in _BLOCK
            if closing:
                if self._open.get(name):
                    self._cut(self._open[name][-1])
                continue
            if name in _CLOSES_P:
                self._close({"p"}, {"table", "button", "td", "th"})
            if name in _ENDS:
                self._close(*_ENDS[name])
            self._add(name, inside)
            if name in _RAW:
                end = _RAW_END[name].search(source, at)
                if not end:
                    at = len(source)
                    break
                close = source.find(">", end.end())
                at = close + 1 if close >= 0 else len(source)
            elif name not in _VOID and not inside.rstrip().endswith("/"):
                self._open.setdefault(name, []).append(len(self._stack))
                self._stack.append(len(self.tag) - 1)
        if at < len(source):
            self.pieces.append((self._stack[-1], source[at:], block))

    def _add(self, name: str, inside: str) -> None:
        found, known = set(), set()
        for a in _ATTR.finditer(inside) if inside else ():
            attribute = a[1].lower()
            if attribute == "hidden":
                found.add("boiler")
            elif attribute in _NAMING:
                for value in (a[2] or a[3] or a[4] or "").split():
                    k, parts = kind(value)
                    found.add(k)
                    known.update(parts)
        found.discard("none")
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.kinds.append("none" if len(found) != 1 else found.pop())
        self.words.append(frozenset(known))

    def _cut(self, place: int) -> None:
        """Close the open elements from a place on."""
        for e in self._stack[place:]:
            self._open[self.tag[e]].pop()
        del self._stack[place:]

    def _close(self, kinds: set[str], fence: set[str]) -> None:
        place = max((self._open[t][-1] for t in kinds if self._open.get(t)), default=-1)
        if place > max((self._open[t][-1] for t in fence if self._open.get(t)), default=-1):
            self._cut(place)

    def boiler(self, k: int) -> bool:
        """Whether an element's tag or names mark it as boilerplate."""
        return self.kinds[k] == "boiler" or (self.tag[k] in _BOILER_TAGS and self.kinds[k] != "content")

    def masked(self, dissolve: bool) -> Page:
        """The page with its ``article`` and ``main`` elements as ``div``, or with their children in their place."""
        page = copy.copy(self)
        marks = ("article", "main")
        page.tag = ["div" if t in marks else t for t in self.tag]
        if dissolve:
            page.parent = self.parent[:]
            for k in range(1, len(page.parent)):
                while self.tag[page.parent[k]] in marks:
                    page.parent[k] = page.parent[page.parent[k]]
            # text that stands in them directly is their parent's
            page.pieces = [(page.parent[e] if self.tag[e] in marks else e, text, starts) for e, text, starts in self.pieces]
        return page

    def evidence(self) -> list[list[str]]:
        """Features of each element."""
        n = len(self.tag)
        own, link, dots = [0] * n, [0] * n, [0] * n
        for e, text, _ in self.pieces:
            size = len(text)
            if size < 200:
                size = len(text.strip())
            own[e] += size
            dots[e] += text.count(". ") + text.count(",") + text.rstrip().endswith(".")
        total = own[:]
        for k in range(n - 1, 0, -1):
            if self.tag[k] == "a":
                link[k] = total[k]
            total[self.parent[k]] += total[k]
            link[self.parent[k]] += link[k]
        out = []
        for k in range(n):
            share = link[k] / total[k] if total[k] else 0.0
            features = ["tag=" + self.tag[k] if self.tag[k] in _BOILER_TAGS else "tag=", f"names={self.kinds[k]}", _shape(min(own[k].bit_length() // 2, 5), min(dots[k], 2), min(int(share * 4), 3))]
            out.append(features + [f"word={w}" for w in self.words[k] if w not in _BOILER_NAMES and w not in _CONTENT_NAMES and w not in _NEUTRAL])
        return out

    def labels(self) -> list[int] | None:
        """0 for boilerplate, 1 for content and 2 for frames, if the page labels itself."""
        if "article" not in self.tag and "main" not in self.tag:
            return None
        out = [0] * len(self.tag)
        for k in range(1, len(out)):
            if self.boiler(k):
                out[k] = -1
            elif self.tag[k] in ("article", "main"):
                out[k] = -1 if out[self.parent[k]] < 0 else 1
            else:
                out[k] = out[self.parent[k]]
        out = [max(x, 0) for x in out]
        for k in range(len(out) - 1, 0, -1):
            if out[k] and not out[self.parent[k]]:
                out[self.parent[k]] = 2
        return out

    def text(self, keep: list[bool]) -> str:
        """Text of the kept elements: one space within and between blocks."""
        blocks: list[list[str]] = []
        fresh = True
        for e, piece, starts in self.pieces:
            fresh |= starts
            if not keep[e]:
                continue
            if fresh or not blocks:
                blocks.append([])
                fresh = False
            blocks[-1].append(piece)
        parts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
        return " ".join(p for p in parts if p)


def _shape(size: int, dots: int, links: int) -> str:
    return f"text={size}.{dots}.{links}"


#: Share of the prior in each distribution; without counts it is all.
PRIOR = 0.1


def _prior() -> dict[str, tuple[float, ...]]:
    """Distributions by value: listed tags and names are boilerplate; long text with stops and few links is content, frames have none."""
    out = {"edge0": (0.98, 0.01, 0.01), "edge1": (0.05, 0.94, 0.01), "edge2": (0.4, 0.4, 0.2)}
    out |= {"names=boiler": (0.4, 0.0005, 0.0005), "names=content": (0.01, 0.2, 0.2), "names=none": (0.59, 0.7995, 0.7995), "tag=": (0.6, 0.9995, 0.9995)}
    out |= {f"tag={t}": (0.4 / len(_BOILER_TAGS), 0.0005 / len(_BOILER_TAGS), 0.0005 / len(_BOILER_TAGS)) for t in _BOILER_TAGS}
    shapes = [(size, dots, links) for size in range(6) for dots in range(3) for links in range(4)]
    good = {x: x[0] * x[1] * (3 - x[2]) for x in shapes}
    most, total = max(good.values()), sum(good.values())
    for x in shapes:
        empty, heading = x == (0, 0, 0), x[0] > 0 and x[1:] == (0, 0)
        bad = (most - good[x]) / (most * len(shapes) - total)
        out[_shape(*x)] = (0.65 * bad + 0.3 * empty + 0.05 / len(shapes), 0.6 * good[x] / total + 0.2 * heading / 5 + 0.15 * empty + 0.05 / len(shapes), 0.05 / len(shapes) + 0.95 * empty)
    return out


_ANYWHERE = [[1 / 3, 1 / 3, 1 / 3]] * 3


def _mixed(count: float, total: float, prior: float) -> float:
    return (1 - PRIOR) * count / total + PRIOR * prior if total else prior


class Model:
    """Log-likelihoods of evidence by value, and of a child's value given its parent's, by the child's tag."""

    def __init__(self, counts: dict[str, tuple[int, ...]]):
        n, prior = counts.get("n", (0, 0, 0)), _prior()
        # a listed tag that hardly a page shows has the weight of all listed tags
        listed = [f"tag={t}" for t in _BOILER_TAGS]
        pooled = [sum(counts.get(f, (0, 0, 0))[y] for f in listed) / len(listed) for y in range(3)]
        shown = counts | {f: pooled for f in listed if sum(counts.get(f, (0, 0, 0))) < LEAST}
        self.known = {f: [math.log(_mixed(x, m, p)) for x, m, p in zip(shown.get(f, (0, 0, 0)), n, prior[f], strict=True)] for f in prior if "=" in f}
        # a word is there or not, and where it is not that is no evidence
        self.known |= {f: [math.log((x + 1) / (m + 2)) for x, m in zip(c, n, strict=True)] for f, c in counts.items() if f.startswith("word=") and sum(c) >= LEAST}
        edges = {f: c for f, c in counts.items() if f.startswith("edge")}
        self.pooled = [[_mixed(x, sum(edges.get(f"edge{y}", (0, 0, 0))), p) for x, p in zip(edges.get(f"edge{y}", (0, 0, 0)), prior[f"edge{y}"], strict=True)] for y in range(3)]
        self.by_tag: dict[str, list[list[float]]] = {}
        for t in {f.split(":", 1)[1] for f in edges if ":" in f}:
            rows = [edges.get(f"edge{y}:{t}", (0, 0, 0)) for y in range(3)]
            self.by_tag[t] = [[_mixed(x, sum(row), p) for x, p in zip(row, self.pooled[y], strict=True)] if sum(row) >= LEAST else self.pooled[y] for y, row in enumerate(rows)]

    def edge(self, page: Page, k: int) -> list[list[float]]:
        """Chances of an element's values by its parent's."""
        # boilerplate by name may stand anywhere and says nothing of its parent
        return _ANYWHERE if page.boiler(k) else self.by_tag.get(page.tag[k], self.pooled)

    def evidence(self, features: list[str]) -> tuple[float, ...]:
        """Likelihood of an element's features by its value, in proportion."""
        sums = [sum(x) for x in zip((0.0, 0.0, 0.0), *(self.known[f] for f in features if f in self.known), strict=True)]
        top = max(sums)
        return tuple(math.exp(max(x - top, -40.0)) for x in sums)

    def marginals(self, page: Page) -> list[float]:
        """Probability of content of each element, by messages up and then down."""
        n = len(page.tag)
        edges = [self.edge(page, k) for k in range(n)]
        up = [self.evidence(fs) for fs in page.evidence()]  # of an element and all below it
        to = [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            x, y, z = up[k]
            s = x + y + z
            x, y, z = x / s, y / s, z / s
            up[k] = x, y, z
            (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = edges[k]
            m = a0 * x + a1 * y + a2 * z, b0 * x + b1 * y + b2 * z, c0 * x + c1 * y + c2 * z
            to[k] = m
            p = page.parent[k]
            u, v, w = up[p][0] * m[0], up[p][1] * m[1], up[p][2] * m[2]
            s = u + v + w
            up[p] = max(u / s, 1e-200), max(v / s, 1e-200), max(w / s, 1e-200)  # thousands of children must not make one impossible
        # the root is a frame
        full = [(0.0, 0.0, 1.0)] * n
        for k in range(1, n):
            f, m = full[page.parent[k]], to[k]
            # what the parent knows without this child
            x, y, z = f[0] / m[0], f[1] / m[1], f[2] / m[2]
            (a0, a1, a2), (b0, b1, b2), (c0, c1, c2) = edges[k]
            u, v, w = (x * a0 + y * b0 + z * c0) * up[k][0], (x * a1 + y * b1 + z * c1) * up[k][1], (x * a2 + y * b2 + z * c2) * up[k][2]
            s = u + v + w
            full[k] = u / s, v / s, w / s
        return [f[1] for f in full]

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        return page.text([p > 0.5 for p in self.marginals(page)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many boilerplate and content elements have each feature and each parent's label."""
    total: dict[str, list[int]] = {}
    for batch in batches:
        for source in batch.column(0).to_pylist():
            page = Page(source)
            labels = page.labels()
            if labels is None:
                continue
            for form in (page, page.masked(False), page.masked(True)):
                for k, (fs, y) in enumerate(zip(form.evidence(), labels, strict=True)):
                    if k and not (form is not page and form.parent != page.parent and page.tag[k] in ("article", "main")):
                        edge = f"edge{labels[form.parent[k]]}"
                        for f in (*fs, "n", edge, f"{edge}:{form.tag[k]}"):
                            total.setdefault(f, [0, 0, 0])[y] += 1
    columns = [pa.array([x[y] for x in total.values()], pa.int64()) for y in range(3)]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *columns], ["feature", "c0", "c1", "c2"])


def fit(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit the model to about ``sample`` pages that label themselves, chosen among all such pages by a hash of page and url."""
    rows = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s/>]"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, n // sample))) == 0)
    counts = rows.select("html").mapInArrow(_count, "feature string, c0 long, c1 long, c2 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "c2")))
    # words and names of tags are data: the most frequent ones bound what is sent
    fixed = F.col("feature").rlike("^(n$|edge[012]$|names=|text=|tag=)")
    kept = counts.where(fixed).unionByName(counts.where(~fixed).orderBy(F.desc(F.col("c0") + F.col("c1") + F.col("c2")), "feature").limit(FEATURES))
    return Model({r.feature: (r.c0, r.c1, r.c2) for r in kept.collect()})


def _apply(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [model.extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for each row of ``pages``.

    A null or empty html, or one without content, gives an empty text. Nothing
    is cut. Repeated rows give a row each; other columns are not read.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or fit(pages))
    source = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_apply(sent), f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
