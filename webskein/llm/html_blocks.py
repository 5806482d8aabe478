"""Main text of HTML pages by a recurrent block labeller.

A page is cut into its leaf sequence of blocks: runs of text between block-level tags. Each block has a vector of hashed
tag-path tokens (tags, classes, ids and roles of its ancestors), hashed words and a few shapes (length, link share,
depth, place). A bidirectional LSTM in numpy reads the whole sequence both ways and labels each block as article or
not; the article blocks, in page order, are the text. The model is trained on pages that html_training generates.

A null or empty html gives an empty text, as does a page without an article block. Scripts, styles and other unseen
elements aren't text. Markup that isn't closed is closed as browsers do; a tag that the page's end cuts off is dropped.
Pages of any length, depth and number of attributes are read whole, in time and memory in proportion to them. Every row gives one row; columns of other names aren't read. An empty table gives an
empty one.
"""

from __future__ import annotations

import functools
import html
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import byte_table, document_words

PATHS, WORDS, SHAPES = 96, 64, 10
INPUT = PATHS + WORDS + SHAPES
HIDDEN = 24
#: Characters of pages that are parsed at once, and blocks of padded sequences that the network reads at once.
PAGE_CHARS, PADDED_BLOCKS = 1 << 20, 20_000
THRESHOLD = 0.5

#: A comment, a tag (quotes count after an equals sign only, as in browsers; what the page's end cuts off has no ">"), a declaration, or text.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS_IN_NAME = re.compile(r"[A-Za-z]+")
_UNSEEN = {"script", "style", "noscript", "template", "svg", "iframe", "object", "title", "math", "canvas", "audio", "video"}
_RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
#: Open elements that a tag closes if they are innermost among block elements.
_CLOSES = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tbody": {"td", "th", "tr", "thead"}}
_TEXT_BYTES = byte_table(ranges=((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))


class Path:
    """Where a block lies: an element and, by `parent`, those around it. Equal paths of a page are one object, and each has the masks of its tokens, so that depth costs nothing."""

    __slots__ = ("parent", "tag", "element", "depth", "near", "above", "below")

    def __init__(self, parent: "Path | None" = None, tag: str = "", element: str = ""):
        self.parent, self.tag, self.element, self.below = parent, tag, element, {}
        self.depth = parent.depth + 1 if parent else 0
        self.near, around = _masks(element)
        self.above = around | parent.above if parent else 0

    def inside(self, tag: str, element: str) -> "Path":
        if (found := self.below.get(element)) is None:
            found = self.below[element] = Path(self, tag, element)
        return found

    def elements(self) -> tuple[str, ...]:
        out, at = [], self
        while at.parent:
            out.append(at.element)
            at = at.parent
        return tuple(reversed(out))


class Block:
    __slots__ = ("place", "text", "links")

    def __init__(self, place: Path, text: str, links: int):
        self.place, self.text, self.links = place, text, links

    @property
    def path(self) -> tuple[str, ...]:
        return self.place.elements()


def _element(tag: str, attributes: str) -> str:
    """A path's entry: the tag and the words of its class, id and role."""
    if not attributes or "=" not in attributes:
        return tag
    names = [w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in _WORDS_IN_NAME.findall(m[2] or m[3] or m[4] or "")]
    return " ".join([tag, *names])


def _is_heading(tag: str) -> bool:
    return len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order, with their paths and the number of characters in links."""
    out: list[Block] = []
    stack: list[Path] = [Path()]
    outer: list[int] = []  # places in the stack of the block elements
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    links = unseen = headings = 0
    at = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1], text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop() -> None:
        nonlocal unseen, headings
        tag = stack.pop().tag
        open_tags[tag] -= 1
        unseen -= tag in _UNSEEN
        headings -= _is_heading(tag)
        if outer and outer[-1] == len(stack):
            outer.pop()

    while m := _TOKEN.match(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not unseen:
                    parts.append(text)
                    if open_tags["a"]:
                        links += len(text.strip())
            continue
        if not m[4]:  # cut off
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _BLOCK:
                flush()
            if _is_heading(tag):  # ends whichever heading is open
                if headings:
                    while not _is_heading(stack[-1].tag):
                        pop()
                    pop()
            elif open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in _BLOCK:
            flush()
            closes = _CLOSES.get(tag, ())
            # a block ends the paragraph or item that it can't lie in
            while outer and ((t := stack[outer[-1]].tag) == "p" and tag != "br" or t in closes):
                k = outer[-1]
                while len(stack) > k:
                    pop()
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _BLOCK:
            outer.append(len(stack))
        stack.append(stack[-1].inside(tag, _element(tag, m[3])))
        open_tags[tag] += 1
        unseen += tag in _UNSEEN
        headings += _is_heading(tag)
        if tag in _RAW:  # its content is no markup
            end = re.compile(rf"</{tag}", re.I).search(page, m.end())
            at = end.start() if end else len(page)
            if tag == "textarea" and not unseen:
                parts.append(page[m.end() : at])
    flush()
    return out


_HALF = PATHS // 2


@functools.lru_cache(maxsize=100_000)
def _masks(element: str) -> tuple[int, int]:
    """The bits of an element's tokens in the two halves of a path's vector."""
    hashes = [_name_hash(token) for token in element.split(" ")] if element else []
    near = above = 0
    for h in hashes:
        near |= 1 << h // _HALF % _HALF
        above |= 1 << h % _HALF
    return near, above


@functools.lru_cache(maxsize=20_000)
def _bits(near: int, above: int) -> np.ndarray:
    return np.array([float(mask >> i & 1) for mask in (near, above) for i in range(_HALF)], dtype=np.float32)


def _path_vector(place: Path) -> np.ndarray:
    """Hashed tokens of a path: the two innermost elements, and all of them."""
    return _bits(place.near | (place.parent.near if place.parent else 0), place.above)


@functools.lru_cache(maxsize=100_000)
def _name_hash(token: str) -> int:
    h, _ = document_words([token.encode()], byte_table(), lower=True)
    return int(h[0] >> np.uint64(20)) if len(h) else 0


def features(pages: list[list[Block]]) -> np.ndarray:
    """A row of INPUT numbers for every block of the pages."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), INPUT), dtype=np.float32)
    if not flat:
        return x
    h, at = document_words([b.text.encode() for b in flat], _TEXT_BYTES, lower=True)
    n = np.diff(at)
    row = np.repeat(np.arange(len(flat)), n)
    np.add.at(x, (row, PATHS + (h % np.uint64(WORDS)).astype(np.int64)), 1 / np.sqrt(1 + n[row]).astype(np.float32))
    k = 0
    for page in pages:
        total = sum(len(b.text) for b in page) + 1
        same, before = Counter(id(b.place) for b in page), 0
        length_of = Counter()
        for b in page:
            length_of[id(b.place)] += len(b.text)
        for i, b in enumerate(page):
            size = len(b.text)
            x[k, :PATHS] = _path_vector(b.place)
            x[k, PATHS + WORDS :] = (
                np.log1p(size) / 5,
                b.links / size,
                sum(map(b.text.count, ".,!?;:")) / size * 10,
                b.place.depth / 10,
                i / len(page),
                before / total,
                size / total,
                np.log1p(same[id(b.place)]) / 4,
                length_of[id(b.place)] / total,
                float(b.text[-1] in ".!?:”\""),
            )
            before += size
            k += 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output over block sequences."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def new(cls, seed: int = 0) -> "Labeller":
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"x{d}"] = rng.normal(0, 1 / np.sqrt(INPUT), (INPUT, 4 * HIDDEN)).astype(np.float32)
            w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            w[f"c{d}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            w[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        w["o"] = rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32)
        w["s"] = np.zeros(INPUT, dtype=np.float32)
        w["z"] = np.zeros(1, dtype=np.float32)
        return cls(w)

    @staticmethod
    def _order(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each step (rows) and page (columns) forwards and backwards; -1 beyond a page's end."""
        first = np.cumsum(sizes) - sizes
        t = np.arange(sizes.max())[:, None]
        inside = t < sizes
        return np.where(inside, first + t, -1), np.where(inside, first + sizes - 1 - t, -1)

    def _scan(self, x: np.ndarray, order: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        h = c = np.zeros((order.shape[1], HIDDEN), dtype=np.float32)
        given = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        out, steps = np.zeros((len(x), HIDDEN), dtype=np.float32), []
        for at in order:
            z = given[at] + h @ self.w[f"h{d}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, h_before = c, h
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            on = at >= 0
            out[at[on]] = h[on]
            if keep:
                steps.append((at, i, f, o, g, before, th, h_before))
        return out, steps

    def probabilities(self, x: np.ndarray, sizes: list[int]) -> np.ndarray:
        """Of every block, given the blocks of several pages one after the other; pages of like lengths are read together."""
        sizes_ = np.array(sizes)
        first = np.cumsum(sizes_) - sizes_
        out = np.zeros(len(x), dtype=np.float32)
        rank = np.argsort(sizes_, kind="stable")
        rank = rank[sizes_[rank] > 0]
        at = 0
        while at < len(rank):
            to = at + 1
            while to < len(rank) and (to + 1 - at) * sizes_[rank[to]] <= PADDED_BLOCKS:
                to += 1
            own = rank[at:to]
            rows = np.concatenate([np.arange(first[k], first[k] + sizes_[k]) for k in own])
            f, b = self._order(sizes_[own])
            both = np.concatenate([self._scan(x[rows], f, "f", False)[0], self._scan(x[rows], b, "b", False)[0]], axis=1)
            out[rows] = _sigmoid(both @ self.w["o"] + x[rows] @ self.w["s"] + self.w["z"])
            at = to
        return out

    def gradients(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the blocks and its gradients, back through time."""
        w, orders = self.w, self._order(sizes)
        scans = [self._scan(x, o, d, True) for o, d in zip(orders, "fb", strict=True)]
        both = np.concatenate([s[0] for s in scans], axis=1)
        p = _sigmoid(both @ w["o"] + x @ w["s"] + w["z"])
        loss = -float(np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        dz = (p - y) / len(y)
        grad = {"o": both.T @ dz, "s": x.T @ dz, "z": np.array([dz.sum()], dtype=np.float32)}
        for k, d in enumerate("fb"):
            dout = np.outer(dz, w["o"][k * HIDDEN : (k + 1) * HIDDEN])
            dgiven = np.zeros((len(x), 4 * HIDDEN), dtype=np.float32)
            dwh = np.zeros_like(w[f"h{d}"])
            dh = dc = np.zeros((len(sizes), HIDDEN), dtype=np.float32)
            for at, i, f, o, g, before, th, h_before in reversed(scans[k][1]):
                on = (at >= 0)[:, None]
                dh = np.where(on, dh + dout[at], 0)
                dc = np.where(on, dc + dh * o * (1 - th**2), 0)
                z = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)], axis=1)
                dgiven[at[on[:, 0]]] = z[on[:, 0]]
                dwh += h_before.T @ z
                dh, dc = z @ w[f"h{d}"].T, dc * f
            grad |= {f"x{d}": x.T @ dgiven, f"h{d}": dwh, f"c{d}": dgiven.sum(axis=0)}
        return loss, grad

    def train(self, pages: list[list[Block]], labels: list[list[int]], *, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over shuffled batches of pages; the mean loss of each epoch."""
        rng, step, losses = np.random.default_rng(seed), 0, []
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        x = [features([p]) for p in pages]
        for epoch in range(epochs):
            order, total = rng.permutation(len(pages)), []
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                loss, grad = self.gradients(np.concatenate([x[i] for i in own]), np.array([len(pages[i]) for i in own]), np.concatenate([labels[i] for i in own]).astype(np.float32))
                total.append(loss)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
                speed = rate * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.02)
                for name, g in grad.items():
                    g = g * min(1, 5 / (norm + 1e-9)) + 1e-5 * self.w[name]
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.w[name] = (self.w[name] - speed * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses


def article(page: list[Block], chosen: np.ndarray) -> str:
    return " ".join(b.text for b, c in zip(page, chosen, strict=True) if c >= THRESHOLD)


_weights: list[dict[str, np.ndarray]] = []


def trained_weights(spark: SparkSession) -> dict[str, np.ndarray]:
    """The weights of html_training's model, fitted once a process by one Spark task: its worker uses one BLAS thread (more are slower on matrices this small) and the driver needn't."""
    if not _weights:

        def fit(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from .html_training import trained

            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trained().w)], pa.binary())], ["w"])

        _weights.append(pickle.loads(spark.range(1, numPartitions=1).mapInArrow(fit, "w binary").first()["w"]))
    return _weights[0]


def extract(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Per row: page_id, url, text and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(weights or trained_weights(pages.sparkSession))  # a few tens of thousands of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(held.value)
        for b in batches:
            given = b.column("html").to_pylist()
            at = 0
            while at < len(given):
                to, size = at, 0
                while to < len(given) and (to == at or size + len(given[to] or "") <= PAGE_CHARS):
                    size += len(given[to] or "")
                    to += 1
                parsed = [blocks(p or "") for p in given[at:to]]
                p = model.probabilities(features(parsed), [len(x) for x in parsed])
                out, k = [], 0
                for x in parsed:
                    out.append(article(x, p[k : k + len(x)]))
                    k += len(x)
                yield pa.RecordBatch.from_arrays([b.column("page_id").slice(at, to - at), b.column("url").slice(at, to - at), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])
                at = to

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def labelled_blocks(pages: DataFrame, weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """A row per block: page_id, block (from 0), element (the innermost one), depth, text, probability."""
    held = pages.sparkSession.sparkContext.broadcast(weights or trained_weights(pages.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Labeller(held.value)
        for b in batches:
            for page_id, page in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                x = blocks(page or "")
                p = model.probabilities(features([x]), [len(x)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([page_id] * len(x), pa.int64()),
                        pa.array(range(len(x)), pa.int64()),
                        pa.array([k.place.element for k in x], pa.string()),
                        pa.array([k.place.depth for k in x], pa.int32()),
                        pa.array([k.text for k in x], pa.string()),
                        pa.array(p.astype(float), pa.float64()),
                    ],
                    ["page_id", "block", "element", "depth", "text", "probability"],
                )

    return pages.selectExpr("cast(page_id as bigint) page_id", "cast(html as string) html").mapInArrow(run, "page_id bigint, block bigint, element string, depth int, text string, probability double")
