"""Cases that earlier versions got wrong: text that pages show, hostile texts, extreme numbers."""

import json
import random
import time
from itertools import product

import numpy as np
import pytest
from brute import contaminates
from pyspark.sql import functions as F

import bitweave.llm.embedding_dedup as dedup
from bitweave.llm._dom import blocks, parse
from bitweave.llm.chat_format import plain_numbers
from bitweave.llm.decontamination import Benchmark, _template, decontaminate, lower_words
from bitweave.llm.html_extraction import _evidence, default_model, extract
from bitweave.llm.warc import candidates

TEXT = [f"This is sentence number {k} of a plain article that says something about rivers and towns." for k in ("one", "two", "three", "four")]
ARTICLE = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{x}</p>" for x in TEXT) + "{}</article><footer>Copyright</footer></body></html>"


@pytest.mark.parametrize("inner, text", [
    ('<p><span aria-hidden="true">O</span>nce upon a time there was a river that ran through the town.</p>', "Once upon a time there was a river that ran through the town."),
    ("<p>Press the <button>Start</button> key to begin the journey along the river.</p>", "Press the Start key to begin the journey along the river."),
    ("<p>Before <noscript>inside the text</noscript> after the bridge over the river was built.</p>", "Before inside the text after the bridge over the river was built."),
    ("<p hidden>A paragraph that is folded away until a reader asks for it.</p>", "A paragraph that is folded away until a reader asks for it."),
    ('<p style="display:none">A paragraph that a style folds away until a reader asks.</p>', "A paragraph that a style folds away until a reader asks."),
    ("<!--><p>What follows an empty comment is still a part of the article.</p>", "What follows an empty comment is still a part of the article."),
    ("<!---><p>What follows a shorter comment is still a part of the article.</p>", "What follows a shorter comment is still a part of the article."),
    ("<!-- x --!><p>What follows a comment that ends oddly is a part of the article.</p>", "What follows a comment that ends oddly is a part of the article."),
    ('<p class="message">A paragraph of the article that has a class of its own for once.</p>', "A paragraph of the article that has a class of its own for once."),
    ('<p class="warning">Mind that the river rises in spring and floods the lower town.</p>', "Mind that the river rises in spring and floods the lower town."),
    ('<p class="zebra-fold">A paragraph with a word that no list of ours has ever seen.</p>', "A paragraph with a word that no list of ours has ever seen."),
])
def test_what_a_page_says_stays(inner, text):
    assert extract(ARTICLE.replace("{}", inner), default_model()).split("\n") == [*TEXT, text]


@pytest.mark.parametrize("piece", ['<a "x" ', "<a x", "<!", "<?", "</", "<a =\">\" ", "<a '\">", "<!-", "<![CDATA", "<p", "&", "&#x41", "<b>", "<script>", "<1", "< "])
def test_hostile_pages_take_linear_time(piece):
    model, page = default_model(), ARTICLE.replace("{}", piece * (1_000_000 // len(piece)))
    for html in (page, piece * (1_000_000 // len(piece))):
        began = time.time()
        extract(html, model)
        assert time.time() - began < 12


def test_extraction_equals_all_states_of_the_tree():
    """The whole query on small pages: every assignment of content to the blocks is weighed, and each block's text is written down as the page is made."""
    model, r = default_model(), random.Random(21)
    for _ in range(40):
        html, open_at, texts = "", [], []
        for k in range(r.randint(1, 8)):
            while open_at and r.random() < 0.4:
                html += f"</{open_at.pop()}>"
            tag = r.choice(["div", "article", "nav", "p", "section"]) if "p" not in open_at else "div"
            while "p" in open_at:
                html += f"</{open_at.pop()}>"
            words = r.choice(["", f"Words of block {k}. And &lt;more&gt;  of\n them, a good few of them, to be sure.", f"link {k}"])
            html += f"<{tag} class='{r.choice(['content', 'menu', 'ad', 'x'])}'>{words}"
            open_at.append(tag)
            texts.append((k + 1, " ".join(words.replace("&lt;", "<").replace("&gt;", ">").split())))
        page = parse(html)
        assert len(page.nodes) == len(texts) + 1
        local = [1 / (1 + np.exp(-max(-30.0, min(30.0, model.bias + sum(model.weights.get(x, 0.0) for x in _evidence(n)))))) for n in page.nodes[1:]]
        total, on = 0.0, np.zeros(len(page.nodes))
        for state in product((0, 1), repeat=len(page.nodes)):
            weight = model.root[state[0]]
            for k, node in enumerate(page.nodes[1:], 1):
                weight *= (max(local[k - 1], 1e-13) if state[k] else max(1 - local[k - 1], 1e-13)) * model.table(page.nodes[node.parent])[state[node.parent]][state[k]]
            total, on = total + weight, on + weight * np.array(state)
        keep = on / total > 0.5
        assert extract(html, model) == "\n".join(t for k, t in texts if t and keep[k])
        assert blocks(page, [True] * len(page.nodes)) == [t for _, t in texts if t]


def test_magics_in_a_payload_take_linear_time():
    payload = b"WARC/1.1\r\n" * 400_000 + b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    record = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload + b"\r\n\r\n"
    began = time.time()
    found = [(x[1], x[2], x[7]) for x in candidates("a", record, False)]
    assert time.time() - began < 10
    assert (0, len(record), len(payload)) in found and len(found) == 2


@pytest.mark.parametrize("raw, plain", [
    ("1.0", "1"), ("1e2", "100"), ("100.00", "100"), ("1E+2", "100"), ("-0.0", "0"), ("-0", "0"), ("0e5", "0"), ("1.50", "1.5"), ("15e-1", "1.5"), ("1e20", "1" + "0" * 20), ("1" + "0" * 20, "1" + "0" * 20),
    ("12345678901234567890.5e1", "123456789012345678905"), ("1e400", "1e400"), ("0.1", "0.1"), ("1e-7", "0.0000001"), ("7", "7"), ("-12", "-12"), ("1e-40", "1.0E-40"), ("10e-41", "1.0E-40"), ("1" + "0" * 50, "1.0E50"), ("1e50", "1.0E50"),
    ('"1e2 and 1.0"', '"1e2 and 1.0"'), ('"a\\"1e2"', '"a\\"1e2"'), ('{"a":[1e2,{"b":2.0}],"1e1":-3.10}', '{"a":[100,{"b":2}],"1e1":-3.1}'), ("01e2", "0100"), ('"open 1e2', '"open 100'), ("", ""),
])
def test_equal_numbers_have_equal_bytes(spark, raw, plain):
    got = spark.createDataFrame([(raw,)], "x string").select(plain_numbers(F.col("x"))).first()[0]
    assert got == plain
    if raw not in ("", "01e2", '"open 1e2'):
        same = lambda x: json.loads(x, parse_int=float)
        assert same(got) == same(raw)


def test_vectors_of_extreme_size_are_compared(spark):
    rows = [(1, [1e-200, 1e-200], 1), (2, [2e-200, 2e-200], 1), (3, [1e200, 1e200], 1), (4, [2e200, 4e200], 1), (5, [1.0, -1.0], 1), (6, [5e-324, 5e-324], 1)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 6: (3, 1), 4: (0, 4), 5: (0, 5)}


# -- names at the start of a sentence ---------------------------------------------

PENS = "Alice has 5 pens. Bob has 3 pens. Carol has 2 pens. How many pens do they have?"


@pytest.mark.parametrize(("item", "text", "hit"), [
    (PENS, "Dave has 7 pens. Erin has 4 pens. Frank has 9 pens. How many pens do they have?", True),
    (PENS, "Note: Dave has 7 pens. Erin has 4 pens. Frank has 9 pens. How many pens do they have? Yes.", True),
    (PENS, "Dave has 7 pens. Dave has 4 pens. Dave has 9 pens. How many pens do they have?", True),  # three names may stand for one
    ("Alice bought 5 red pens today.", "Maria bought 5 red pens today.", True),
    ("Alice bought 5 red pens today.", "Maria bought 9 red pens today.", True),
    ("Alice bought 5 red pens today.", "Maria sold 5 red pens today.", False),
    ("Alice met Alice and Alice.", "Maria met Maria and Carla.", False),  # one value can't become two
    (PENS, "Dave has 7 hats. Erin met 4 cats. Frank saw 9 dogs. How many pens do they have?", False),
    ("The red pens are on the table near the door. There are 5.", "Some red pens are on the table near the door. Those are 5.", True),
])
def test_renamed_questions_are_found(spark, item, text, hit):
    docs = spark.createDataFrame([(1, text), (None, "nothing of the kind"), (1, "the same id, and clean")], "doc_id long, text string")
    got = {(r.doc_id, r.contaminated) for r in decontaminate(docs, spark.createDataFrame([(4, item)], "item_id long, text string")).collect()}
    assert got == {(1, hit), (1, False), (None, False)}


def test_judging_names_anywhere_equals_brute_force():
    for seed in range(5):
        r = random.Random(seed)
        names, things = ["Alice", "Bob", "Carol", "Dave", "Mia"], "apples pens books km hours".split()

        def sentence(r=r, names=names, things=things):
            return [r.choice([*names, "The", "Then", "When", "Old"]), *(r.choice([x, ""]) for x in ["man", "then", "old"]), r.choice(["has", "buys", "when"]), r.choice("2357"), r.choice(things) + r.choice(["", "", "."])]

        items = [" ".join(w for _ in range(r.randint(1, 5)) for w in sentence() if w) for _ in range(6)]
        texts = []
        for _ in range(40):
            swap = dict(zip(names, r.sample(names, 5), strict=True)) | dict(zip("2357", r.choices("2357", k=4), strict=True))
            words = [swap.get(w, w) if r.random() < 0.95 else r.choice(names) for w in r.choice(items).split()]
            texts.append(" ".join(["the", *words[r.choice([0, 0, 2]) :], *r.choice(items).split()[: r.randint(0, 9)]]))
        common = lower_words(items)
        found = Benchmark(list(enumerate(items)), common=common).judge(_template(texts, common))
        got = {(k, i) for k, x in found.items() for i in x}
        want = {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if contaminates(x, t, common=common)}
        assert got == want and 5 < len(want) < len(texts) * len(items)
