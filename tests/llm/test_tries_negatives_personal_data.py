"""Conversation tries, hard negatives and personal data against plain versions, and their edge cases."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import bitweave.llm.hard_negatives as negatives
import bitweave.llm.personal_data as personal
from bitweave.llm._running import running
from bitweave.llm.prefix_trie import conversation_trie, op11_prefix_trie, prefix_trie, rebuilt, turns_in_order

# -- running sums ---------------------------------------------------------------


def test_running_sums_cross_parts_and_groups(spark):
    r = random.Random(2)
    rows = sorted((r.choice([1, 1, 1, 2, 3, 9]), k, r.randint(-5, 5)) for k in range(900))
    df = spark.createDataFrame(r.sample(rows, len(rows)), "g long, k long, v long").repartition(7)
    got = {x.k: (x.s, x.t) for x in running(df, ["g", "k"], {"s": "v", "t": "k"}, "g").collect()}
    total, last = [0, 0], None
    for g, k, v in rows:
        total = [v, k] if g != last else [total[0] + v, total[1] + k]
        last = g
        assert got[k] == tuple(total)
    assert {x.k: x.s for x in running(df, ["g", "k"], {"s": "v"}).collect()}[rows[-1][1]] == sum(x[2] for x in rows)
    assert running(df.limit(0), ["g", "k"], {"s": "v"}).collect() == []


# -- the trie -------------------------------------------------------------------


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), said, (role, text)))
    turns = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - math.trunc(math.fmod(c, 5)), [])[:h] + mine[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in ids if len(convs[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("seed", range(3))
def test_trie_equals_brute_force(spark, seed, tmp_path):
    r = random.Random(seed)
    texts = ["", "a", "b", "ä€", None, "same"]
    rows = [(c, r.choice([None, 0, 1, 2, 3, 4, 5]), r.choice(["user", "assistant", None]), r.choice(texts)) for c in [*range(-6, 12), 40, None] for _ in range(r.randint(1, 12))]
    rows += [(100 + k, t, "user", "x" * t) for k in range(12) for t in range(10)]  # copies, apart from the heads
    rows += [(200, t, "user", "long") for t in range(70)] + rows[:5]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(1), "said": F.lit("x"), "node": F.lit(2), "n_turns": F.lit(3)}).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(op11_prefix_trie(spark, str(tmp_path)))
    want = plain_trie(plain_rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


def test_trie_intervals_and_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "no"), (3, 0, "user", "hi"), (4, 0, "user", "bye")]
    nodes = conversation_trie(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted(n.preorder for n in nodes) == list(range(1, len(nodes) + 1))
    by = {(n.conv_id, n.depth): n for n in nodes}
    assert by[1, 0].subtree_end == len(nodes) and by[1, 0].n_leaves == 3 and by[1, 0].text is None
    assert (by[1, 1].text, by[1, 1].n_convs, by[1, 1].n_children, by[1, 1].saved_tokens) == ("hi", 3, 2, 4)
    assert by[1, 1].subtree_end - by[1, 1].preorder == 2 and by[4, 1].text == "bye"


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie(*rebuilt(turns_in_order(empty)))) == []
    # 2 % 9 turns of an absent head, and fewer turns of its own than it skips
    lone = [c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2][:2]
    turns = spark.createDataFrame([(c, 0, "user", "x") for c in lone], "conv_id long, turn long, role string, text string")
    assert rows_of(prefix_trie(*rebuilt(turns_in_order(turns)))) == list(plain_trie({c: [] for c in lone}))


def test_end_digest_of_many_ids(spark):
    ids = random.Random(1).sample(range(100_000), 3000)
    got = conversation_trie(spark.createDataFrame([(c, 0, "u", "t") for c in ids], "conv_id long, turn long, role string, text string").repartition(6))
    assert got.where("depth = 1").first().ends_sha256 == hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


# -- hard negatives ---------------------------------------------------------------


def plain_negatives(rows):
    good = [(i, y, [math.floor(256 * v) for v in x]) for i, y, x in rows if None not in (i, y) and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    good = [g for g in good if sum(v * v for v in g[2]) < 2**56]
    out = []
    for anchor, own, a in good:
        if anchor % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(a, x, strict=True)), i, y) for i, y, x in good if i != anchor and len(x) == len(a)]
        for score, positive, _ in sorted(s for s in scored if s[2] == own)[:5]:
            inside = sorted(s for s in scored if s[2] != own and 80 * -score <= 100 * -s[0] <= 100 * -score)[:5]
            out += [(anchor, positive, k + 1, n[1], -score, -n[0]) for k, n in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2, 3, 2), (256, 2048, 32)])
def test_negatives_equal_brute_force(spark, monkeypatch, blocks):
    for name, value in zip(("ANCHORS", "ROWS", "CHUNK"), blocks, strict=True):
        monkeypatch.setattr(negatives, name, value)
    r = np.random.default_rng(4)
    centre = r.normal(size=7)
    rows = [(int(i), int(r.integers(0, 3)), [float(x) for x in centre + r.normal(size=7) * 0.6]) for i in r.permutation(90) * 10]
    rows += [(5001, 1, rows[0][2]), (5002, 1, rows[0][2]), (5003, 0, [0.0] * 7), (6000, 2, [-x for x in rows[0][2]])]  # ties
    rows += [(7000, None, rows[1][2]), (None, 1, rows[1][2]), (7100, 1, None), (7200, 1, [None] * 7), (7300, 1, [math.nan] * 7), (7400, 1, [math.inf] * 7), (7500, 1, [1e9] * 7)]
    rows += [(8000, 1, [1.0, 2.0]), (8001, 1, [1.0, 2.0]), (8002, 0, [1.0, 1.9]), (8100, 1, []), (8101, 1, []), (8102, 2, [])]
    rows += [(9000, 5, [2.0**18] * 3), (9001, 5, [2.0**18 - 1] * 3), (9002, 6, [2.0**18 - 2] * 3)]  # beyond what doubles hold exactly
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({"id": F.lit(1), "number": F.lit(2), "length": F.lit(3)}).repartition(3)
    found = negatives.hard_negatives(negatives.quantised(df, "vec_id", F.col("label"), "embedding", 256.0), F.col("id") % 100 == 0)
    got = sorted(tuple(x) for x in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == plain_negatives(rows) and len(got) > 100 and any(x[0] == 9000 for x in got) and any(x[0] == 8100 for x in got)


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(negatives.quantised(empty, "vec_id", F.col("label"), "embedding", 256.0), F.col("id") % 100 == 0).collect() == []


@given(st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=40))
def test_tiles_survive_packing(values):
    tile = np.array([values])
    assert (negatives.unpacked(negatives.packed(tile), tile.shape) == tile).all()


# -- personal data ------------------------------------------------------------------

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            even = [int(d) * 2 - 9 * (int(d) > 4) for d in digits[-2::-2]]
            if kind == 1 and max(map(int, m[0].split("."))) > 255 or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            if kind == 2 and (not 13 <= len(digits) <= 19 or (sum(map(int, digits[-1::-2])) + sum(even)) % 10):
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=400)
@given(st.text(alphabet="ab.@-%+1204 ()é\n", max_size=60) | st.text(alphabet="1259. -", max_size=80) | st.text(alphabet="a@.1", max_size=40))
def test_base_spans_equal_the_patterns(text):
    assert personal.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e", "a@b.c._x@d.e", "@a.b x@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1.1.1.1.1", "0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111", "+1 (555) 123-4567.", "+1 2 +44 20 7946 0958", "++12345678901", "é4111111111111111é"])
def test_base_spans_by_hand(text):
    assert personal.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("piece", ["a", "1", "1.", "+1(", "a@", "@", "1 ", "1-", "a.b@c-", "+1", "1.1.1.1."])
def test_time_is_linear(piece):
    began = time.time()
    personal.base_spans(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 5


def plain_disclosing(texts):
    """{(entity, term)} by the definition, with words told apart by their spelling."""
    word = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    lower = lambda w: w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    n, near, before, after, held = Counter(), Counter(), defaultdict(set), defaultdict(set), []
    for text in texts:
        words = [(lower(m[0]), m.start(), m.end()) for m in word.finditer(text)]
        n.update(w for w, _, _ in words)
        spans, at = personal.base_spans(text), defaultdict(set)
        for kind, a, b in spans:
            at[personal.entity(kind, text[a:b])] |= set()
            left, right = [k for k, w in enumerate(words) if w[2] <= a][-12:], [k for k, w in enumerate(words) if w[1] >= b][:12]
            for k in left + right:
                if not any(words[k][1] < y and words[k][2] > x for _, x, y in spans) and text.count("\n", 0, a) == text.count("\n", 0, words[k][1]):
                    at[personal.entity(kind, text[a:b])].add(k)
        for e, ks in at.items():
            for k in ks:
                key = e, words[k][0]
                near[key] += 1
                before[key].add(words[k - 1][0] if k else None)
                after[key].add(words[k + 1][0] if k + 1 < len(words) else None)
        held.append((words, spans, set(at)))
    told = {key for key, c in near.items() if len(before[key]) > 1 and len(after[key]) > 1 and n[key[1]] <= 2 * c}
    cut = [sorted((a, b) for w, a, b in words if any((e, w) in told for e in entities) and not any(a < y and b > x for _, x, y in spans)) for words, spans, entities in held]
    return told, cut


def test_disclosing_terms_equal_the_definition(spark):
    r = random.Random(7)
    common = [f"w{k}" for k in range(40)]
    texts = []
    for k in range(120):
        words = [r.choice(common) for _ in range(r.randint(5, 60))]
        who = r.choice(["ann@x.org", "bob@y.net", "10.2.3.4", ""])
        if who:
            place = r.randrange(len(words))
            words[place:place] = r.sample([who, {"ann@x.org": "Anneliese", "bob@y.net": "Żółw", "10.2.3.4": "SN99417"}[who], r.choice(common)], 3)
        if r.random() < 0.3:
            words.insert(r.randrange(len(words)), "\n")
        texts.append(" ".join(words))
    texts += ["", "Anneliese without her address", "mail ann@x.org now é ANNELIESE!", texts[0], texts[0], "Abel Cain Eve 17 " * 200]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, None), (None, "bob@y.net"), (3, "bob@y.net w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"term": F.lit("clash"), "entity": F.lit(1), "base": F.lit(2)}).repartition(5)
    found = personal.personal_data(docs).collect()
    assert len(found) == len(rows)
    told, cut = plain_disclosing([t for _, t in rows if t is not None])
    assert {("email:ann@x.org", "anneliese"), ("ip:10.2.3.4", "sn99417")} <= told
    want = Counter((i, tuple(x)) for (i, _), x in zip([x for x in rows if x[1] is not None], cut, strict=True)) + Counter([(3, ())])
    assert Counter((x.doc_id, tuple((s.start, s.end) for s in x.terms)) for x in found) == want
    assert not any(x.terms for x in found if x.text_key is None)
    out = {x.doc_id: x.sanitised for x in personal.sanitised(docs.where("doc_id >= 120"), personal.personal_data(docs)).collect()}
    assert out[121] == "Anneliese without her address" and out[122] == "mail [EMAIL] now é [NAME]!"


def test_copies_of_one_passage_disclose_nothing(spark):
    docs = spark.createDataFrame([(k, "Write to Wilhelmina under w@example.org today.") for k in range(50)] + [(k, f"clean text {k}") for k in range(50, 90)], "doc_id long, text string")
    found = personal.personal_data(docs).collect()
    assert sum(len(x.base) for x in found) == 50 and not any(x.terms for x in found)


def test_personal_data_of_nothing(spark):
    assert personal.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_filter_never_loses_a_term(spark):
    terms = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    held = personal.Filter(spark.createDataFrame([(int(t),) for t in terms], "term long"), 5000)
    assert held.may_hold(terms).all() and held.may_hold(-terms).mean() < 0.1


def test_op13_counts_each_kind_wherever_it_stands(spark, tmp_path):
    texts = ["mail a@b.co or c@d.org, call +1 (555) 123-4567", "4111 1111 1111 1111", "10.0.0.1 and 1.2.3.4.5.6.7.8 é a@b.co", "nothing", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {x.doc_id: x for x in personal.op13_personal_data(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        spans = personal.base_spans(text or "")
        x, base = rows[k], ",".join(f"{personal.KINDS[kind]}:{a}:{b}" for kind, a, b in spans)
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == kind for s in spans) for kind in range(4)]
        assert x.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
