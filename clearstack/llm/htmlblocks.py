"""Main-text extraction from HTML with a recurrent block labeller.

A page is cut into leaf blocks of text, each with its tag path. A bidirectional LSTM in numpy reads the page's blocks in
order, each as a vector of its tag path (hashed tags, classes and ids) and of its hashed words, and labels every block with
the whole page as context; blocks labelled as article text are joined.

There are no labels to learn from, so the labeller is trained on a bounded sample of pages labelled by their structure
(inside article or main, and outside whatever announces itself as something else). Blocks of the kinds that pages may have,
such as side bars, notices, forms and reader comments, are put into the training pages at random places, with words from
other pages, so that the labeller knows them too. Training takes one task, extraction is narrow.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearstack.llm import words
from clearstack.llm.common import arrow_map, arrow_stream, least_hashed, prepare

PATH_DIMS, WORD_DIMS, SHAPE_DIMS, HIDDEN = 64, 12, 6, 16
INPUT = PATH_DIMS + WORD_DIMS + SHAPE_DIMS
#: The labeller learns from at most so many pages, by least hash of page_id, and so many blocks at a time.
SAMPLE_PAGES, WINDOW, EPOCHS, BATCH = 300, 64, 8, 16
RATE = 0.01

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe select noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BLOCKS = CLOSES_P | frozenset("html body head li dt dd tr td th thead tbody tfoot caption colgroup optgroup option summary legend button frameset center dir listing xmp search".split())
ENDS_ALIKE = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}

# What announces itself as no article text, as tags and as parts of class names and ids.
OTHER_TAGS = frozenset("nav header footer aside form button head menu dialog fieldset".split())
OTHER_NAMES = tuple("nav menu sidebar side-bar footer header banner advert ads ad promo sponsor cookie notice consent popup modal newsletter subscribe signup login form search share social related recommended breadcrumb comments comment replies disqus widget toolbar pagination".split())
MAIN_TAGS = frozenset({"article", "main"})
MAIN_NAMES = tuple("article content post entry story main body".split())

_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_UNQUOTED = re.compile("[^>\"']*")
#: Only ASCII letters ignore case: without re.A the long s or the capital dotted I would count as s or i.
_ENDS = {t: re.compile(f"</{t}", re.I | re.A) for t in (*RAW, "xmp")}
_NAMES = re.compile(r"(?i)(?<![\w-])(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")

class Path:
    """The tags around a block, as its innermost element and the path of its parent: what is asked of a path is added up on the way."""

    __slots__ = ("element", "parent", "depth", "top", "vector", "other", "main", "tagged")

    def __init__(self, element: str, parent: Path | None) -> None:
        self.element, self.parent = element, parent
        vector, other, main, tagged = _facts(element)
        if parent is None:
            self.depth, self.top, self.vector, self.other, self.main, self.tagged = 1, (element,), vector, other, main, tagged
            return
        self.depth, self.vector = parent.depth + 1, parent.vector + vector
        self.top = parent.top if len(parent.top) == 3 else (*parent.top, element)
        self.other, self.main, self.tagged = parent.other or other, parent.main or main, parent.tagged or tagged

    def elements(self) -> tuple[str, ...]:
        out, at = [], self
        while at is not None:
            out.append(at.element)
            at = at.parent
        return tuple(reversed(out))


def path_of(elements: Iterable[str]) -> Path | None:
    at = None
    for e in elements:
        at = Path(e, at)
    return at


def names_of(element: str) -> tuple[str, list[str]]:
    tag, *names = element.split(".")
    return tag, [p for n in names for p in re.split(r"[-_]+", n) if p]


@lru_cache(50_000)
def _facts(element: str) -> tuple[np.ndarray, bool, bool, bool]:
    """An element's part of the path vector; whether it announces something else, article text, or is an article's tag."""
    tag, names = names_of(element)
    v = np.zeros(PATH_DIMS, np.float32)
    for token in [tag, *("." + n for n in names)]:
        data = token.encode("utf-8", "replace")
        h = words.mix(words.spans_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)])) + np.arange(1, PATH_DIMS + 1, dtype=np.uint64))
        v += np.where(h >> np.uint64(63), 1, -1) / 4
    other = tag in OTHER_TAGS or any(n in OTHER_NAMES for n in names)
    main = tag in MAIN_TAGS or any(n in MAIN_NAMES for n in names)
    return v, other, main, tag in MAIN_TAGS


Block = tuple[str, "Path | None", int]


class _Tags:
    """Where the tags of a page end, in time linear in the page.

    A tag ends at the first > outside quotes; where there is none, at the first >. A search that fails tells of every < that
    it passed outside quotes that a search from there fails too, so each character is searched at most once in each state.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.quotes = {q: page.rfind(q) for q in "\"'"}
        self.dead: set[int] = set()

    def end(self, at: int) -> int:
        """The place after the tag that begins at a <; -1 where no > follows."""
        if at > self.last:
            return -1
        if at not in self.dead:
            passed, k = [], at
            while True:
                stop = _UNQUOTED.match(self.page, k).end()
                passed.append((k, stop))
                if stop == len(self.page):
                    break
                if self.page[stop] == ">":
                    return stop + 1
                if stop >= self.quotes[self.page[stop]]:
                    break
                k = self.page.find(self.page[stop], stop + 1) + 1
            for a, b in passed:
                a = self.page.find("<", a, b)
                while a >= 0:
                    self.dead.add(a)
                    a = self.page.find("<", a + 1, b)
        return self.page.find(">", at) + 1


class _Open:
    """The open elements, with the places of each tag, so that finding one doesn't take a walk through all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Path]] = []
        self.places: dict[str, list[int]] = {}

    def path(self) -> Path | None:
        return self.stack[-1][1] if self.stack else None

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of some tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def push(self, tag: str, element: str) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, Path(element, self.path())))

    def cut(self, place: int) -> bool:
        """Close the elements from a place on; whether a block was among them."""
        block = False
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.places[tag].pop()
            block |= tag in BLOCKS
        return block


_LISTS = ("ul", "ol", "table", "select")


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: text, path of tags, and the number of its characters inside links.

    Time grows in proportion to the page, however tags are nested, left open or cut off. A < that begins no tag is text;
    a tag that the page's end cuts off is not.
    """
    out: list[Block] = []
    if not page:
        return out
    inside, tags = _Open(), _Tags(page)
    text: list[str] = []
    linked = 0

    def flush(path: Path | None) -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, path, linked))
            text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            linked += len(piece) if inside.places.get("a") else 0

    at = 0
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            put(page[at:])
            break
        put(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        mark = page[begin + 1 : begin + 2]
        name = _NAME.match(page, begin + 1)
        if mark not in ("!", "?") and name is None:
            put("<")
            at = begin + 1
            continue
        end = tags.end(begin) if name else page.find(">", begin) + 1 if begin < tags.last else -1
        if end < 0:
            if page.find("<", begin + 1) < 0:
                break
            put("<")
            at = begin + 1
            continue
        at = end
        if name is None:
            continue
        tag, attributes = name[2].lower(), page[name.end() : end - 1]
        if name[1]:
            before = inside.path()
            if tag in BLOCKS:
                flush(before)
            place = inside.last((tag,))
            if place >= 0 and inside.cut(place):
                flush(before)
            continue
        if tag in RAW or tag == "xmp":
            m = _ENDS[tag].search(page, at)
            if tag in BLOCKS:
                flush(inside.path())
            if tag == "xmp":  # shown as it is written
                put(page[at : m.start() if m else len(page)].replace("&", "&amp;"))
                flush(inside.path())
            at = len(page) if m is None else max(page.find(">", m.start()), m.start()) + 1
            continue
        if tag in BLOCKS:
            flush(inside.path())
            if tag in CLOSES_P and (place := inside.last(("p",))) >= 0:
                inside.cut(place)
            alike = ENDS_ALIKE.get(tag)
            if alike and (place := inside.last((*alike, *_LISTS))) >= 0 and inside.stack[place][0] in alike:
                inside.cut(place)
        if tag == "br":
            text.append(" ")
        if tag not in VOID and not attributes.endswith("/"):
            names = "".join("." + v.lower() for n in _NAMES.finditer(attributes) for v in (n[2] or n[3] or n[4] or "").split()) if attributes else ""
            inside.push(tag, tag + names)
    flush(inside.path())
    return out


def teacher(page: list[Block]) -> np.ndarray:
    """1 for blocks that the page's structure marks as article text."""
    structured = any(path.tagged for _, path, _ in page if path)
    out = np.zeros(len(page))
    for k, (text, path, linked) in enumerate(page):
        other, main = (path.other, path.main) if path else (False, False)
        out[k] = not other and (main or not structured and linked * 2 < len(text) and len(text) > 40)
    return out


_WORDS = (words.mix(np.arange(1, 4096 * WORD_DIMS + 1, dtype=np.uint64)) >> np.uint64(40)).astype(np.float32).reshape(4096, WORD_DIMS) / (1 << 23) - 1


def vectors(page: list[Block]) -> np.ndarray:
    """The labeller's input: a row for each block."""
    out = np.zeros((len(page), INPUT), np.float32)
    for k, ((text, path, linked), h) in enumerate(zip(page, words.texts_word_hashes([b[0] for b in page]), strict=True)):
        if path:
            out[k, :PATH_DIMS] = path.vector
        if len(h):
            out[k, PATH_DIMS : PATH_DIMS + WORD_DIMS] = _WORDS[(h >> np.uint64(52)).astype(np.int64)].mean(axis=0)
        n = len(text)
        out[k, -SHAPE_DIMS:] = (np.log1p(n) / 5 - 1, min(1.0, linked / n), min(len(h), 50) / 25 - 1, text[-1] in ".!?:", k / len(page), 1 / (1 + (path.depth if path else 0)))
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class BiLstm:
    """Two LSTMs of HIDDEN units, one in each direction, and a logistic output over both."""

    def __init__(self, weights: list[np.ndarray] | None = None) -> None:
        if weights is None:
            rng = np.random.RandomState(7)
            weights = []
            for _ in range(2):
                w = rng.randn(INPUT + HIDDEN, 4 * HIDDEN) / np.sqrt(INPUT + HIDDEN)
                b = np.zeros(4 * HIDDEN)
                b[HIDDEN : 2 * HIDDEN] = 1  # remember at first
                weights += [w, b]
            weights += [rng.randn(2 * HIDDEN) / np.sqrt(2 * HIDDEN), np.zeros(1)]
        self.weights = [w.astype(np.float32) for w in weights]

    def _direction(self, d: int, x: np.ndarray, mask: np.ndarray, learn: bool = False) -> tuple[np.ndarray, list]:
        """States by step, and what back-propagation needs of each step, if it is to learn."""
        w, b = self.weights[2 * d], self.weights[2 * d + 1]
        pages, steps, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        own = x @ w[:INPUT] + b
        out, tape = np.zeros((pages, steps, HIDDEN), np.float32), []
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            z = own[:, t] + h @ w[INPUT:]
            i, f, o = (sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            new = f * c + i * g
            if learn:
                tape.append((t, h, c, i, f, o, g, np.tanh(new), m))
            c = m * new + (1 - m) * c
            h = m * o * np.tanh(new) + (1 - m) * h
            out[:, t] = h
        return out, tape

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._direction(d, x, mask)[0] for d in (0, 1)], axis=2)
        return sigmoid(both @ self.weights[4] + self.weights[5])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean logistic loss over blocks, by back-propagation through time."""
        runs = [self._direction(d, x, mask, True) for d in (0, 1)]
        both = np.concatenate([r[0] for r in runs], axis=2)
        error = (sigmoid(both @ self.weights[4] + self.weights[5]) - y) * mask / max(1.0, float(mask.sum()))
        grads = [np.zeros_like(w) for w in self.weights]
        grads[4], grads[5] = np.einsum("ptk,pt->k", both, error), np.array([error.sum()])
        for d in (0, 1):
            w = self.weights[2 * d]
            out_w = self.weights[4][d * HIDDEN : (d + 1) * HIDDEN]
            dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, h, c, i, f, o, g, tanh, m in reversed(runs[d][1]):
                dh = dh + error[:, t, None] * out_w
                do = dh * m * tanh
                dnew = (dc + 0) * m + dh * m * o * (1 - tanh**2)
                dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
                grads[2 * d][:INPUT] += x[:, t].T @ dz
                grads[2 * d][INPUT:] += h.T @ dz
                grads[2 * d + 1] += dz.sum(axis=0)
                dc = dnew * f + dc * (1 - m)
                dh = dz @ w[INPUT:].T + dh * (1 - m)
        return grads

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Adam over EPOCHS in an order fixed by a seed, on pages of (vectors, labels) cut into windows."""
        parts = [(x[i : i + WINDOW], y[i : i + WINDOW]) for x, y in pages for i in range(0, len(x), WINDOW)]
        rng = np.random.RandomState(11)
        m1, m2 = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(parts))
            for k in range(0, len(order), BATCH):
                x, mask = padded([parts[j][0] for j in order[k : k + BATCH]])
                y = np.zeros(mask.shape, np.float32)
                for row, j in enumerate(order[k : k + BATCH]):
                    y[row, : len(parts[j][1])] = parts[j][1]
                step += 1
                for w, g, a, b in zip(self.weights, self.gradient(x, mask, y), m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = max(map(len, rows))
    x, mask = np.zeros((len(rows), n, INPUT), np.float32), np.zeros((len(rows), n), np.float32)
    for k, r in enumerate(rows):
        x[k, : len(r)], mask[k, : len(r)] = r, 1
    return x, mask


def _renamed(path: Path | None, old: str, new: str, known: dict[Path | None, Path | None]) -> Path | None:
    """The path with an element under another name; known holds the paths renamed so far."""
    todo = []
    while path not in known:
        todo.append(path)
        path = path.parent
    for p in reversed(todo):
        known[p] = Path(new if p.element == old else p.element, known[p.parent])
        path = p
    return known[path]


def augmented(page: list[Block], other: list[Block], rng: np.random.RandomState) -> tuple[list[Block], np.ndarray]:
    """The page with containers under other names, and with blocks of other kinds put in; labels as the teacher's."""
    labels = teacher(page)
    main = [k for k in range(len(page)) if labels[k]]
    style = rng.randint(4)
    swap = ["article", "main", f"div.{MAIN_NAMES[rng.randint(len(MAIN_NAMES))]}", f"section.{MAIN_NAMES[rng.randint(len(MAIN_NAMES))]}.{MAIN_NAMES[rng.randint(len(MAIN_NAMES))]}"][style]
    swapped: dict[Path | None, Path | None] = {None: None}
    page = [(t, _renamed(path, "article", swap, swapped), n) for t, path, n in page]
    texts = [b[0] for b in other] or ["text"]
    for _ in range(rng.randint(1, 5)):
        if rng.rand() < 0.4:
            head = sorted(OTHER_TAGS)[rng.randint(len(OTHER_TAGS))]
        else:
            head = f"{('div', 'section', 'ul', 'p', 'aside')[rng.randint(5)]}.{OTHER_NAMES[rng.randint(len(OTHER_NAMES))]}"
        at = rng.randint(len(page) + 1) if not main or rng.rand() < 0.5 else main[0] + rng.randint(len(main) + 1)
        near = page[min(main[0], len(page) - 1)][1] if main else None
        outer = ("html", "body") if rng.rand() < 0.5 or not near else near.top
        inner = [(), ("p",), ("ul", "li"), ("div", "p"), ("label",)][rng.randint(5)]
        put, path = [], path_of((*outer, head, *inner))
        for _ in range(rng.randint(1, 6)):
            text = texts[rng.randint(len(texts))]
            text = text if rng.rand() < 0.5 else " ".join(text.split()[: rng.randint(1, 8)]) or text
            put.append((text, path, len(text) if rng.rand() < 0.3 else 0))
        page = page[:at] + put + page[at:]
        labels = np.concatenate([labels[:at], np.zeros(len(put)), labels[at:]])
        main = [k for k in range(len(page)) if labels[k]]
    return page, labels


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> BiLstm:
    """A labeller from at most sample_pages rows with html, by least hash of page_id; an untrained one without any."""
    prepare(pages.sparkSession)
    rows = pages.where("html is not null and html <> ''").select(F.xxhash64("page_id").alias("turn"), "page_id", "html")
    rows = least_hashed(rows, "page_id", sample_pages, "html")

    def run(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        seen = []
        for b in batches:
            seen += zip(b["turn"], b["page_id"], b["html"], strict=True)
        cut = [c for c in (blocks(h) for _, _, h in sorted(seen, key=lambda r: (r[0], r[2]))) if c]
        rng = np.random.RandomState(3)
        sets = []
        for k, page in enumerate(cut):
            sets.append((vectors(page), teacher(page)))
            for _ in range(2):
                more, labels = augmented(page, cut[rng.randint(len(cut))], rng)
                sets.append((vectors(more), labels))
        model = BiLstm()
        if sets:
            model.fit(sets)
        yield {"weights": [[w.tobytes() for w in model.weights]]}

    got = arrow_stream(rows.repartition(1), run, "weights array<binary>").first()
    if got is None:
        return BiLstm()
    shapes = [w.shape for w in BiLstm().weights]
    return BiLstm([np.frombuffer(w, np.float32).reshape(s) for w, s in zip(got[0], shapes, strict=True)])


def label(pages: list[list[Block]], model: BiLstm) -> list[np.ndarray]:
    """Probabilities that blocks are article text; pages of like length are read together, padding included at most 2^20 numbers."""
    out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(pages[order[j]]) * INPUT <= 1 << 20:
            j += 1
        x, mask = padded([vectors(pages[k]) for k in order[i:j]])
        p = model.predict(x, mask)
        for row, k in enumerate(order[i:j]):
            out[k] = p[row, : len(pages[k])]
        i = j
    return out


def extract(pages: DataFrame, model: BiLstm | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages (page_id, url, html).

    A null or empty html, and a page without article blocks, gives an empty text. Character references are decoded, white
    space in a block becomes one space, blocks are joined by line feeds in page order. Scripts, styles and other raw elements are never
    text. Repeated rows are each answered; other columns are not read; an empty table gives no rows.
    """
    model = model or train(pages)

    def run(b: dict[str, list]) -> dict[str, list]:
        cut = [blocks(h) for h in b.pop("html")]
        b["text"] = ["\n".join(t for (t, _, _), p in zip(page, ps, strict=True) if p >= 0.5) for page, ps in zip(cut, label(cut, model), strict=True)]
        b["n_chars"] = [len(t) for t in b["text"]]
        return b

    return arrow_map(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
