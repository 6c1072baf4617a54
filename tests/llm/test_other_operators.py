import base64
import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from brute import roots
from pyspark.sql import functions as F

import bitweave.llm.embedding_dedup as dedup
from bitweave.llm._blocks import shared_dir, stored
from bitweave.llm._dom import blocks, parse
from bitweave.llm._labelled_pages import labelled_pages
from bitweave.llm.chat_format import format_chats, tool_schemas
from bitweave.llm.html_extraction import default_model, extract, extract_text
from bitweave.llm.packing import TOKENIZER, Plan, _Encoder, pack_documents, shortest_pack_first
from bitweave.llm.sharding import assign_shards, balanced_cuts, shards_needed, smallest_capacity
from bitweave.llm.warc import read_warc, reachable, write_warc

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")


# -- packing ------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    plain, own, r = tokenizers.Tokenizer.from_file(public.path(TOKENIZER)), _Encoder(public.path(TOKENIZER)), random.Random(3)
    alphabet = list("abcXYZ  .,'!?-\"<|>12\n\té̈́ÉßİΣς°²½—…  \x85\x0b\x1c中文😀#$_/ſK") + ["'s", "'LL", "don't", "<|endoftext|>", "é", "Ⅷ", "\r\n"]
    for _ in range(60):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(20)]
        data = [x.encode() for x in texts]
        ids, counts = own.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
        at = 0
        for text, n in zip(texts, counts, strict=True):
            assert ids[at : at + n].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
            at += n


def test_texts_of_more_segments_than_the_table_holds(monkeypatch):
    import bitweave.llm.packing as packing

    monkeypatch.setattr(packing, "_SLOTS", 256)
    monkeypatch.setattr(packing, "_MOST_CACHED", 120)
    monkeypatch.setattr(packing, "_MOST_AT_ONCE", 100)
    plain, own = tokenizers.Tokenizer.from_file(public.path(TOKENIZER)), _Encoder(public.path(TOKENIZER))
    texts = [" ".join(f"w{k} x{k}" for k in range(2000)), "short", ""]
    data = [x.encode() for x in texts]
    ids, counts = own.encode(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64))
    assert ids.tolist() == [i for x in texts for i in plain.encode(x, add_special_tokens=False).ids] and counts[2] == 0


def test_patterns_cover_the_histogram():
    r = random.Random(1)
    for _ in range(50):
        capacity = r.choice([8, 64, 512])
        histogram = dict(Counter(r.randint(1, capacity) for _ in range(r.randint(0, 400))))
        patterns = shortest_pack_first(histogram, capacity)
        total = Counter()
        for count, pack in patterns:
            assert sum(k * v for k, v in pack.items()) <= capacity
            for k, v in pack.items():
                total[k] += count * v
        assert dict(total) == histogram
        plan, places = Plan(patterns), {}
        for length, n in histogram.items():
            for s, o in zip(*plan.place(np.full(n, length), np.arange(n)), strict=True):
                places.setdefault(int(s), []).append((int(o), length))
        assert sorted(places) == list(range(plan.sequences))
        for own in places.values():
            at = 0
            for o, length in sorted(own):
                assert o == at
                at += length


def test_pack_documents(spark):
    plain = tokenizers.Tokenizer.from_file(public.path(TOKENIZER))
    rows = [(1, "A few words, here."), (2, None), (3, ""), (4, "long text of words " * 900), (5, "x"), (5, "x"), (6, "\n\t ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS piece", "1 AS length")
    got = pack_documents(docs, public.path(TOKENIZER), capacity=256).collect()
    want = Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        for k in range(0, len(ids), 256):
            want[i, k, tuple(ids[k : k + 256]), len(ids)] += 1
    assert Counter((r["doc_id"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["doc_tokens"]) for r in got) == want
    assert all(r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"]) for r in got)
    assert pack_documents(docs.limit(0), public.path(TOKENIZER)).count() == 0


# -- sharding -----------------------------------------------------------------


def test_cuts_are_minimal_and_balanced():
    r = random.Random(5)
    for _ in range(200):
        sizes, shards = [r.choice([1, 5, 100, r.randint(1, 1000)]) for _ in range(r.randint(1, 60))], r.randint(1, 12)
        least = smallest_capacity(sizes, shards)
        ends = np.cumsum(sizes).tolist()
        assert shards_needed(ends, least) <= shards and (least == max(sizes) or shards_needed(ends, least - 1) > shards)
        cuts = [0, *balanced_cuts(sizes, shards), len(sizes)]
        assert len(cuts) == shards + 1 and cuts == sorted(cuts)
        assert max(sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)) <= least


def test_assign_shards(spark):
    r = random.Random(6)
    rows = [(i, None if r.random() < 0.05 else "x" * r.randint(0, 50) if r.random() < 0.5 else f"é{i}" * r.randint(1, 30)) for i in range(400)] + [(7, "twice"), (7, "twice"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS shard", "1 AS atom")
    got = assign_shards(docs, shards=10, atoms=512).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    home, slots = {}, {}
    for x in got:
        assert home.setdefault((x["size"], x["text_crc32"]), x["shard"]) == x["shard"] and x["law"] == "bytes" and x["grown_shard"] is None
        slots.setdefault(x["shard"], []).append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert assign_shards(docs.limit(0)).count() == 0


def test_write_shards(spark, tmp_path):
    from bitweave.llm.sharding import write_shards

    rows = [(i, None if i % 10 == 0 else f"text {i % 60} " * (i % 7 + 1), i % 3) for i in range(200)] + [(7, "other text", 1), (None, "no id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")  # a column of the result's name
    write_shards(docs, f"file://{tmp_path}/out", shards=5, atoms=64)
    got = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert Counter((x["doc_id"], x["text"], x["shard"]) for x in got) == Counter(rows)
    home = {x["text"] or "": x["shard"] for x in assign_shards(docs, shards=5, atoms=64).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert len({x["_shard"] for x in got}) == 5 and len({(x["text"], x["_shard"]) for x in got}) == len({x["text"] for x in got}) and home


# -- WARC ---------------------------------------------------------------------

MAGIC = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_warc_round_trip(spark):
    rows = [(1, "u v", MAGIC + "tail"), (2, None, None), (3, "x", MAGIC), (4, "y\r\nz", "same é"), (6, "y", "same é"), (5, "y", "same é"), (4, "y", "same é"), (None, "q", "zz"), (9, "q", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    at = shared_dir(spark)
    write_warc(pages.coalesce(1), at)
    got = read_warc(spark, at, keep_payload=True).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        data, to = (h or "").encode(), first.get(h or "")
        revisit = to is not None and i != to
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None] += 1
    assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in got) == want
    assert {bytes(x["payload"]).decode() for x in got if x["record_type"] == "response"} == {h or "" for _, _, h in rows}
    at = shared_dir(spark)
    write_warc(pages, at, least_bytes=10)
    assert {x["record_type"] for x in read_warc(spark, at).collect()} == {"response"}
    at = shared_dir(spark)
    write_warc(pages.limit(0), at)
    assert read_warc(spark, at).count() == 0


def test_archives_stay_small(spark, tmp_path, monkeypatch):
    import bitweave.llm.warc as warc

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    monkeypatch.setattr(warc, "MOST_BYTES", 40_000)
    monkeypatch.setattr(warc, "CLASSES", (2_000, 10_000, 1 << 31))
    rows = [(i, "u", "x" * (5 if i < 400 else 1_000 if i < 500 else 8_000 if i < 520 else 60_000) + str(i)) for i in range(523)]
    at = tmp_path / "archives"
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"file://{at}")
    sizes = [f.stat().st_size for f in at.glob("part-*")]
    assert len(sizes) > 10 and sum(x > 45_000 for x in sizes) == 3  # those of one large record each
    got = read_warc(spark, f"file://{at}", keep_payload=True).collect()
    assert sorted((x["page_id"], bytes(x["payload"]).decode()) for x in got) == [(i, h) for i, _, h in rows]


def test_pointer_jumping(spark):
    chain = [("a", k * 10, k * 10 + 10) for k in range(50)] + [("a", 13, 20), ("a", 7, 13), ("b", 0, 5), ("b", 5, 9), ("b", 12, 20), ("c", 4, 8)]
    got = {(r["archive"], r["offset"]) for r in reachable(spark.createDataFrame(chain, "archive string, offset long, next long")).collect()}
    assert got == {("a", k * 10) for k in range(50)} | {("b", 0), ("b", 5)}


# -- embeddings ---------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PART", 16)  # crowded cells are cut
    r = np.random.default_rng(8)
    base = r.normal(size=(60, 16))
    rows = []
    for i in range(500):
        v = base[i % 60] + r.normal(size=16) * r.choice([0, 0.03, 0.1, 1])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None] * 8, 1), (603, [float("nan")] * 16, 1), (604, rows[0][1], None), (605, [1.0, 2.0], 1), (606, [], 1), (607, rows[0][1], 0), (607, rows[0][1], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS cell", "2 AS copies")
    got = sorted(((x["vec_id"] is None, x["vec_id"] or 0), x["n_links"], x["component_id"], x["kept"]) for x in dedup.near_duplicates(table).collect())
    good = [(i, np.array(v, dtype=np.float32).astype(float), y) for i, v, y in rows if i is not None and y is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    links, degree = [], Counter()
    for k, (i, v, y) in enumerate(good):
        for m, (j, w, z) in enumerate(good[:k]):
            if y == z and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links.append((i, j))
                degree[k] += 1
                degree[m] += 1
    by_id = {g[0]: degree[k] for k, g in enumerate(good)}
    root = roots({i for i, _, _ in rows if i is not None}, links)
    want = sorted(((i is None, i or 0), by_id.get(i, 0), root.get(i), True if i is None else root[i] == i) for i, _, _ in rows)
    assert got == want
    assert dedup.near_duplicates(table.limit(0)).count() == 0


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(12)
    centre = r.normal(size=(40, 32))
    rows = [(i, [float(x) for x in centre[i % 40] + r.normal(size=32) * r.choice([0.05, 0.1, 0.14])], 0) for i in range(2000)]
    found = dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    links = sum(x["n_links"] for x in found.collect()) // 2
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = int((np.triu(x @ x.T, 1) >= 0.98).sum())
    assert want > 5000 and 0.999 * want <= links <= want


def test_links_at_the_threshold(spark):
    """Cosines of 0.98 in double precision link, anything less doesn't."""
    rows = [(i, [float(x), float(y)], 0) for i, (x, y) in enumerate([(1.0, 0.0), (0.98, (1 - 0.98**2) ** 0.5), (0.9799999, (1 - 0.9799999**2) ** 0.5)])]
    cosine = lambda a, b: float(np.array(a) @ np.array(b)) / float(np.linalg.norm(a) * np.linalg.norm(b))
    got = {x["vec_id"]: x["n_links"] for x in dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: sum(j != i and cosine(v, w) >= 0.98 for j, w, _ in rows) for i, v, _ in rows}


def test_multi_sequence_order():
    r = random.Random(2)
    for _ in range(100):
        a, b = (sorted(r.choice([0.0, r.random()]) for _ in range(r.randint(1, 12))) for _ in range(2))
        most = r.random()
        pairs = list(dedup.traverse(a, b, most))
        costs = [a[i] + b[j] for i, j in pairs]
        assert costs == sorted(costs) and sorted(pairs) == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x + y <= most)


def test_heavy_keys_are_dealt_out(spark, monkeypatch):
    import bitweave.llm._blocks as parts

    monkeypatch.setattr(parts, "HEAVY", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 7}") for i in range(1000)], "id long, key string")
    classes = stored(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n")))
    heavy = parts.heavy_keys(classes, "key", "n")
    assert heavy == ["hot"]
    for how in ("inner", "left"):
        plain, dealt = rows.join(classes, "key", how), parts.spread_join(rows, classes, "key", F.col("id"), heavy, how)
        assert Counter(map(tuple, plain.select("id", "key", "n").collect())) == Counter(map(tuple, dealt.select("id", "key", "n").collect()))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_negative_zeros_and_several_lengths(spark, kind):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(size=16)], 0) for i in range(40)]
    rows += [(100, [0.0, 1.0], 0), (101, [-0.0, 1.0], 0), (102, [0.001, 1.0], 0), (103, [1.0, 0.0], 0), (104, [2.0], 0), (105, [3.0], 0), (106, [-0.0, 0.0], 0), (107, [0.0, 1.0], 1)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in dedup.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}
    assert len(got) == len(rows) and all(got[i] == (0, i, True) for i in [*range(40), 103, 106, 107])
    assert got[100] == (2, 100, True) and got[101] == got[102] == (2, 100, False)
    assert got[104] == (1, 104, True) and got[105] == (1, 104, False)


# -- HTML -----------------------------------------------------------------------


def test_extract_plain_page():
    page = '<html><head><title>T</title><style>p{}</style><script>var a="</p>"</script></head><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy now.</div><article><h1>Big &amp; small</h1><p>One  two\n three.<p>Four <b>five</b>, six<br>seven. ' + "More words follow here. " * 8 + "</p><aside class=related><a href=/c>Other story</a></aside></article><footer>Copyright 2020</footer></body></html>"
    got = extract(page, default_model()).split("\n")
    assert got[0] == "Big & small" and got[1] == "One two three." and got[2].startswith("Four five, six seven. More")
    assert len(got) == 3


def test_extraction_on_held_out_pages():
    import re

    model, right, lines, found, kept = default_model(), 0, 0, 0, 0
    pages = labelled_pages(150, seed=99)
    for html in pages:
        labelled = parse(html, labelled=True)
        want = blocks(labelled, [n.label == 1 for n in labelled.nodes])
        got = extract(re.sub(r" data-y=\d", "", html), model).split("\n")
        both = sum((Counter(want) & Counter(got)).values())
        right, lines, found, kept = right + (want == got), lines + len(want), found + both, kept + len(got)
    assert found / lines > 0.95 and found / kept > 0.93 and right / len(pages) > 0.6


SIX = [f"This is sentence number {k} of a plain article that says something about rivers and towns." for k in ("one", "two", "three", "four", "five", "six")]


def test_pages_without_class_words():
    assert extract("<body><div>" + "".join(f"<p>{x}</p>" for x in SIX) + "</div></body>", default_model()).split("\n") == SIX
    assert extract('<article class="content overflow-hidden">' + " ".join(SIX) + "</article>", default_model()) == " ".join(SIX)


def test_what_stands_in_a_paragraph_does_not_end_it():
    for inner, text in (("<math><mrow><mi>x</mi><mo>=</mo></mrow></math>", "x="), ("<object data=a>yes</object>", "yes"), ("<noscript><img src=a>yes</noscript>", "yes"), ("<svg><title>t</title><path/><text>yes</text></svg>", "yes"), ("<script>if (a < b) c();</script>", ""), ("<select><option>no</select>", ""), ("<button>ok</button>", "ok")):
        page = "<article>" + "".join(f"<p>{x}</p>" for x in SIX) + f"<p>Formula {inner} and the end of it.</p></article>"
        assert extract(page, default_model()).split("\n") == [*SIX, " ".join(f"Formula {text} and the end of it.".split())], inner


def test_marginals_equal_all_states():
    """Sum-product against the sum over all states of small trees."""
    from itertools import product as every

    from bitweave.llm.html_extraction import _evidence

    model, r = default_model(), random.Random(13)
    for _ in range(40):
        depth, html = [], "<html>"
        for _ in range(r.randint(1, 8)):
            if depth and r.random() < 0.4:
                html += f"</{depth.pop()}>"
            depth.append(r.choice(["div", "section", "article", "nav", "footer", "ul"]))
            html += f"<{depth[-1]} class='{r.choice(['content', 'ad', 'menu', 'x'])}'>{r.choice(['', 'Some words. And more of them.', '<a href=a>link</a>'])}"
        page = parse(html)
        nodes = page.nodes
        local = []
        for node in nodes[1:]:
            odds = max(-30.0, min(30.0, model.bias + sum(model.weights.get(x, 0.0) for x in _evidence(node))))
            p = 1 / (1 + np.exp(-odds))
            local.append((max(1 - p, 1e-13), max(p, 1e-13)))
        total, on = 0.0, np.zeros(len(nodes))
        for state in every((0, 1), repeat=len(nodes)):
            weight = model.root[state[0]]
            for k, node in enumerate(nodes[1:], 1):
                weight *= local[k - 1][state[k]] * model.table(nodes[node.parent])[state[node.parent]][state[k]]
            total += weight
            on += weight * np.array(state)
        assert np.allclose(model.marginals(page), on / total, atol=1e-9)


def test_deep_pages_are_read_in_linear_time():
    import time

    for tag in ("div", "head", "li", "b"):
        began = time.time()
        text = extract(f"<{tag}>" * 100_000 + "<body><p>" + " ".join(SIX), default_model())
        assert text in ("", " ".join(SIX)) and time.time() - began < 20


def test_broken_html_never_fails():
    r, model = random.Random(7), default_model()
    parts = ["<p>", "</p>", "<", ">", "<div", " class='x", "'>", "text", "&amp;", "&#x41;", "&bogus;", "<!--", "-->", "<script>", "</script>", "<li>", "</ul>", "<b>", "</b>", "<br/>", "<td>", "<![CDATA[", "]]>", "é", "\x00", "<p/>", "</", "<>", "<select><option>"]
    for _ in range(500):
        extract("".join(r.choice(parts) for _ in range(r.randint(0, 40))), model)
    deep = "<div>" * 3000 + "deep words here." + "</div>" * 3000
    assert extract(deep, model) in ("deep words here.", "")


def test_extract_text(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<article><p>Some words that are text. And more of them.</p></article>"), (3, "u", "<article><p>Some words that are text. And more of them.</p></article>")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in extract_text(pages).collect())
    line = "Some words that are text. And more of them."
    assert got == [(1, "", 0), (2, "", 0), (3, line, len(line)), (3, line, len(line))]
    assert extract_text(pages.limit(0)).count() == 0


# -- chat -------------------------------------------------------------------------


def test_chats(spark):
    call = lambda i, n, a: "<tool_call>" + json.dumps({"id": i, "name": n, "arguments": a}) + "</tool_call>"
    result = lambda i, c: json.dumps({"tool_call_id": i, "content": c})
    rows = [
        (1, 0, "user", 'hi "you"\n'), (1, 1, "tool", result("a", "res a")), (1, 2, "assistant", "ok " + call("a", "search", {"query": "x", "limit": 3})), (1, 4, "assistant", call("b", "fetch", {"timeout": 1.50, "url": "${a}"})), (1, 3, "tool", result("b", "res b")), (1, 5, "user", None),
        (2, 0, "assistant", call("z", "nope", {})), (2, 1, "assistant", call("q", "search", {"limit": "three"})), (2, None, "user", "last"), (2, 2, "assistant", "<tool_call>{bad}</tool_call>"), (2, 3, "assistant", call("s", "fetch", {"url": "${s}"})), (2, 4, "tool", result("s", "loop")),
        (3, 0, "assistant", call("k", "lookup", {"key": "v", "fields": [1, {"b": 1, "a": 2}]})), (3, 5, "tool", result("k", {"y": 1, "x": [2]})), (3, 6, "tool", result("k", "again")), (None, 0, None, "n"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "'m' AS message")
    got = sorted((tuple(r) for r in format_chats(chats, tool_schemas(spark)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    first = [r for r in got if r[0] == 1]
    assert [r[1] for r in first] == [0, 2, 1, 4, 3, 5]  # results behind their calls, the second call behind the result that it needs
    assert first[1][4:7] == (1, 1, 0) and first[3][4:7] == (1, 1, 0)
    assert json.loads(first[3][7]) == {"content": "", "role": "assistant", "tool_calls": [{"arguments": {"timeout": 1.5, "url": "${a}"}, "id": "b", "name": "fetch"}]}
    second = {r[1]: r for r in got if r[0] == 2}
    assert second[0][4:7] == (1, 0, 1) and second[1][4:7] == (1, 0, 1) and second[2][4:7] == (0, 0, 0) and second[None][2] == 5
    assert second[3][6] == 1  # needs its own result
    third = [r for r in got if r[0] == 3]
    assert '"arguments":{"fields":[1,{"a":2,"b":1}],"key":"v"}' in third[0][7] and third[1][7] == '{"content":"{\\"x\\":[2],\\"y\\":1}","role":"tool","tool_call_id":"k"}'
    for r in got:
        assert r[7] == json.dumps(json.loads(r[7]), separators=(",", ":"), sort_keys=True, ensure_ascii=False)
    assert [r[2] for r in got if r[0] == 4] == [0, 1] and got[-1][0] is None and got[-1][3] == "unknown"
    assert format_chats(chats.limit(0), tool_schemas(spark)).count() == 0


def test_null_conversations_are_one(spark):
    call = '<tool_call>{"id": "a", "name": "search", "arguments": {"query": "x"}}</tool_call>'
    rows = [(None, 0, "tool", '{"tool_call_id": "a", "content": "r"}'), (None, 1, "assistant", call), (7, 0, "assistant", call)]
    got = {(r["conv_id"], r["turn"]): (r["position"], r["n_calls"], r["n_linked"]) for r in format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_schemas(spark)).collect()}
    assert got == {(None, 1): (0, 1, 1), (None, 0): (1, 0, 0), (7, 0): (0, 1, 0)}


def test_long_chains_are_no_circles(spark):
    call = lambda i, need: "<tool_call>" + json.dumps({"id": i, "name": "fetch", "arguments": {"url": need}}) + "</tool_call>"
    rows, n = [], 60
    for k in range(n):  # stored in reverse: every call behind its result and behind the calls that need it
        rows.append((1, 2 * (n - k), "tool", json.dumps({"tool_call_id": f"c{k}", "content": "x"})))
        rows.append((1, 2 * (n - k) + 1, "assistant", call(f"c{k}", f"${{c{k - 1}}}" if k else "u")))
    rows += [(2, turn, role, text) for _, turn, role, text in rows if turn > 2] + [(2, 0, "assistant", call("a", "${b}")), (2, 1, "tool", json.dumps({"tool_call_id": "a", "content": "x"})), (2, 2, "assistant", call("b", "${a}")), (2, 3, "tool", json.dumps({"tool_call_id": "b", "content": "x"}))]
    got = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_schemas(spark)).collect()
    first = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [r["turn"] for r in first] == [t for k in range(n) for t in (2 * (n - k) + 1, 2 * (n - k))]
    assert all(r["n_invalid"] == 0 for r in first)
    assert all(r["n_invalid"] == (r["role"] == "assistant") for r in got if r["conv_id"] == 2)  # a long chain next to a circle


def test_order_equals_longest_paths(spark):
    from bitweave.llm.chat_format import _order

    r, edges = random.Random(11), []
    for conv in range(12):
        turns = r.sample(range(100), 40)
        edges += [(conv, turns[i], turns[j]) for j in range(1, 40) for i in r.sample(range(max(0, j - 4), j), min(j, r.randint(1, 3)))]
        if conv % 4 == 3:
            edges.append((conv, turns[-1], turns[20]))
            edges.append((conv, turns[20], turns[-1]))
    got = {(x["conv"], x["turn"]): (tuple(x["key"]), x["circle"]) for x in _order(spark.createDataFrame(edges, "conv long, before long, after long")).collect()}
    want = {(c, t): (t, 0) for c, *both in edges for t in both}
    for _ in range(50):
        for c, a, b in edges:
            if c % 4 != 3:
                want[c, b] = max(want[c, b], (want[c, a][0], want[c, a][1] + 1))
    assert got == {(c, t): (key, c % 4 == 3) for (c, t), key in want.items()}
