"""HTML extraction: a tree-structured graphical model over the DOM.

Every block-level element has a hidden state, content or not.  A node potential
scores the element's own evidence (tag, class and id words, text length, share
of links, sentence ends, paragraphs) by logistic regression; a parent-child potential says
how likely a child keeps its parent's state, given the parent's tag and whether
its class words speak for or against content.  Sum-product messages pass from the
leaves upward and from the root downward, and give each element's exact marginal
of being content.  Text of elements whose marginal exceeds one half is kept, in
page order, one line for each block.

Both potentials are trained from labelled pages (``train``): first apart, then the
node weights by the gradient of the whole tree's likelihood; by default from the
invented layouts of ``_labelled_pages``.  The model has a few hundred weights.

Defined results: a null or empty page gives ''; white space inside a block is
one space, which holds for ``<br>`` too; unclosed and stray tags are tolerated,
at any depth; scripts, styles, templates, frames and the fields of forms are never
text, and don't end the block that they are in; all else is, whether a browser
would show it or not (a button's words in a sentence, ``hidden`` paragraphs, what
stands in for a script or a film); a tag that never ends is dropped, up to the next
``<``; formulas are text; rows with equal ids are read one by one; the whole page
is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import bounded_batches
from ._dom import Node, Page, blocks, parse
from ._labelled_pages import labelled_pages

TRAINING_PAGES = 1000


def _evidence(node: Node) -> list[str]:
    n = node.text
    size = "0" if not n else "1" if n < 25 else "2" if n < 80 else "3" if n < 250 else "4"
    share = node.linked / n if n else 0.0
    links = "0" if not share else "1" if share < 0.3 else "2" if share < 0.7 else "3"
    stops = "0" if not node.stops else "1" if node.stops < 3 else "2"
    own = "0" if not node.own else "1" if node.own < 40 else "2"
    many = "0" if not node.paragraphs else "1" if node.paragraphs < 3 else "2"
    return [f"tag:{node.tag}", f"paragraphs:{many}", f"size:{size}", f"links:{links}", f"stops:{stops}", f"own:{own}", f"{links}{stops}", f"{own}{links}{size}", *(f"name:{x}" for x in set(node.names))]


class Model:
    """Weights of node evidence (log odds) and the parent-child tables."""

    def __init__(self, weights: dict[str, float], bias: float, tables: dict[tuple[str, int], tuple], root: list[float]):
        self.weights, self.bias, self.tables, self.root = weights, bias, tables, root

    def kind(self, node: Node) -> tuple[str, int]:
        """What a parent's table depends on: its tag, and the leaning of its class and id words."""
        lean = sum(self.weights.get(f"name:{x}", 0.0) for x in set(node.names))
        return node.tag, (lean > 0.3) - (lean < -0.3)

    def table(self, node: Node) -> tuple:
        kind = self.kind(node)
        return self.tables.get(kind) or self.tables["", kind[1]]

    def marginals(self, page: Page) -> list[float]:
        """P(content) of each node, exactly: messages up, then down."""
        nodes, get = page.nodes, self.weights.get
        n = len(nodes)
        local = [(1.0, 1.0)] * n
        for i in range(1, n):
            node = nodes[i]
            odds = self.bias + sum(get(x, 0.0) for x in _evidence(node))
            odds = max(-30.0, min(30.0, odds))
            p = 1.0 / (1.0 + 2.718281828459045**-odds)
            local[i] = (max(1.0 - p, 1e-13), max(p, 1e-13))
        up = list(local)  # evidence of a node and of all below it
        sent = [(1.0, 1.0)] * n  # what a node tells its parent
        tables = [self.table(node) for node in nodes]
        for i in range(n - 1, 0, -1):
            u0, u1 = up[i]
            (a00, a01), (a10, a11) = tables[nodes[i].parent]
            m0, m1 = a00 * u0 + a01 * u1, a10 * u0 + a11 * u1
            sent[i] = (m0, m1)
            k = nodes[i].parent
            v0, v1 = up[k]
            v0, v1 = v0 * m0, v1 * m1
            s = v0 + v1
            up[k] = (v0 / s, v1 / s)
        r0, r1 = self.root
        belief = [(0.0, 0.0)] * n
        b0, b1 = up[0][0] * r0, up[0][1] * r1
        belief[0] = (b0 / (b0 + b1), b1 / (b0 + b1))
        for i in range(1, n):
            p0, p1 = belief[nodes[i].parent]
            (a00, a01), (a10, a11) = tables[nodes[i].parent]
            m0, m1 = sent[i]
            d0, d1 = p0 / m0, p1 / m1  # the parent without this child
            u0, u1 = up[i]
            b0, b1 = (d0 * a00 + d1 * a10) * u0, (d0 * a01 + d1 * a11) * u1
            s = b0 + b1
            belief[i] = (b0 / s, b1 / s)
        return [b[1] for b in belief]


def train(pages: list[str], rounds: int = 300, rate: float = 0.3, decay: float = 1e-6, joint_rounds: int = 4, joint_rate: float = 0.1) -> Model:
    """Fits both potentials to pages whose elements carry data-y=0 or data-y=1."""
    parsed = [parse(html, labelled=True) for html in pages]
    rows, labels, couples, found = [], [], [], Counter()
    for page in parsed:
        for node in page.nodes[1:]:
            if node.label < 0:
                continue
            above = max(0, page.nodes[node.parent].label)
            couples.append((page.nodes[node.parent], above, node.label))
            rows.append(_evidence(node))
            labels.append(node.label)
            found.update(rows[-1])
    names = sorted(x for x, c in found.items() if c > 2)
    place = {x: i for i, x in enumerate(names)}
    flat = [(k, place[x]) for k, row in enumerate(rows) for x in row if x in place]
    row, col = (np.array(x) for x in zip(*flat, strict=True))
    y = np.array(labels, dtype=float)
    w, b, seen_w, seen_b = np.zeros(len(names)), 0.0, np.full(len(names), 1e-12), 1e-12
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[col], minlength=len(y))
        error = 1 / (1 + np.exp(-z)) - y
        slope_w, slope_b = np.bincount(col, weights=error[row], minlength=len(names)) / len(y) + decay * w, error.mean()
        seen_w, seen_b = seen_w + slope_w**2, seen_b + slope_b**2  # a rare word's weight moves as far as a common one's
        w, b = w - rate * slope_w / np.sqrt(seen_w), b - rate * slope_b / np.sqrt(seen_b)
    prior = log(y.mean() / (1 - y.mean()))
    model = Model(dict(zip(names, w.tolist(), strict=True)), float(b) - prior, {}, [0.9, 0.1])
    pairs: dict[tuple[str, int], Counter] = {}
    for node, above, below in couples:
        tag, lean = model.kind(node)
        for kind in ((tag, lean), ("", lean)):
            pairs.setdefault(kind, Counter())[above, below] += 1
    for kind, own in pairs.items():  # counts of a kind on top of ten of those that any tag has
        wide = pairs["", kind[1]]
        model.tables[kind] = tuple(tuple((own[i, j] + 10 * share(wide, i, j)) / (own[i, 0] + own[i, 1] + 10) for j in (0, 1)) for i in (0, 1))
    for lean in (-1, 0, 1):
        model.tables.setdefault(("", lean), ((0.9, 0.1), (0.1, 0.9)))
    _refine(model, parsed, joint_rounds, joint_rate)
    return model


def _refine(model: Model, pages: list[Page], rounds: int, rate: float) -> None:
    """Stochastic gradient steps on the likelihood of the pages' labels: a node's slope is its label less its marginal in the whole tree."""
    weights = model.weights
    for k in range(rounds):
        for page in pages:
            own = model.marginals(page)
            for node, p in zip(page.nodes, own, strict=True):
                error = node.label - p
                if node.label < 0 or abs(error) < 0.02:
                    continue
                change = rate * error / (1 + k)
                model.bias += change
                for x in _evidence(node):
                    if x in weights:
                        weights[x] += change


def share(counts: Counter, i: int, j: int) -> float:
    return (counts[i, j] + 1) / (counts[i, 0] + counts[i, 1] + 2)


@cache
def default_model() -> Model:
    return train(labelled_pages(TRAINING_PAGES))


def extract(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    return "\n".join(blocks(page, [p > 0.5 for p in model.marginals(page)]))


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                out = [extract(x, model) for x in part.column("_html").to_pylist()]
                names = [x for x in part.schema.names if x != "_html"]
                yield pa.record_batch([*(part.column(x) for x in names), pa.array(out, pa.string())], names=[*names, "text"])

    return run


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """Returns the columns ``keep`` (one that has the name of a result is left out), then text and n_chars."""
    shared = bounded_batches(pages.sparkSession).sparkContext.broadcast(model or default_model())
    keep = [c for c in keep if c not in ("text", "n_chars")]
    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    out = pages.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{html_col}`").alias("_html")).mapInArrow(_extract(shared), f"{fields}text string")
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
