import random

import numpy as np
import pyarrow as pa
import pytest
from brute import contaminates, kept_words, near_groups

import bitweave.llm.ngram_join as join
from bitweave.llm._blocks import decode, encode
from bitweave.llm._components import components
from bitweave.llm._text import Words, column_bytes, words_of
from bitweave.llm.decontamination import Benchmark, _template, decontaminate
from bitweave.llm.language_id import held_out, identify_language, train
from bitweave.llm.substring_dedup import substring_dedup


def corpus(seed=1, n=120):
    """Random documents with exact copies, near copies, shared passages, nulls, empty and short ones."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    words = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = words(40), words(90)
    docs = []
    for i in range(n):
        x = r.random()
        if x < 0.15:
            own = list(base)
            for _ in range(r.randint(0, 5)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
        elif x < 0.3:
            own = words(r.randint(5, 60)) + passage + words(r.randint(0, 60))
        elif x < 0.4 and docs:
            docs.append((i, docs[r.randrange(len(docs))][1]))
            continue
        else:
            own = words(r.choice([0, 1, 3, 4, 5, 12, 13, 14, 40, 100]))
        docs.append((i, r.choice([" ", "  ", "\n", "\t"]).join(own)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "É à b ß " * 30), (n + 4, "word " * 20_000), (n + 5, "Word " * 20_000)]


def test_words_are_cut_like_the_pattern():
    texts = ["a b", None, "", " x\ty\x0bz w ", "é ü"]
    raw, offsets, nulls = column_bytes(pa.chunked_array([pa.array(texts)]))
    w = Words(raw, offsets)
    assert w.count.tolist() == [2, 0, 0, 3, 1] and nulls.tolist() == [False, True, False, False, False]
    found = {raw[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)}
    assert found == {"a", "b", "x", "y", "z w", "é ü"}
    assert len(set(w.hash.tolist())) == 6
    sliced = [x for _, _, part in words_of(pa.array(texts).slice(3), limit=1) for x in part.hash.tolist()]
    assert sliced == w.hash[2:].tolist()


@pytest.mark.parametrize("values", [[], [5], [0, 1, 2**64 - 1], [3, 9, 2**40, 2**63]])
def test_hash_lists_round_trip(values):
    assert decode(encode(np.array(values, np.uint64))).tolist() == values


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 7), (50, 51), (60, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(31), 100], 0) | {50: 50, 51: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["kept"].split(" ") if r["kept"] else [], r["n_removed"], r["removed"]) for r in substring_dedup(df).collect()}
    want = kept_words(rows)
    assert {i: (n, k) for i, (n, k, *_) in got.items()} == want
    assert all(g[2] == g[0] - len(g[1]) == sum(s["end"] - s["start"] for s in g[3]) for g in got.values())


def test_substring_dedup_edges(spark):
    text = " ".join(map(str, range(20)))
    rows = [(1, text, "x"), (1, text, "y"), (None, text, "z"), (2, text, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")  # a column that clashes with the result's
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup(df).collect())
    assert got == [("1", 0), ("1", 0), ("2", 20), ("None", 0)]
    assert substring_dedup(df.limit(0)).count() == 0
    carried = substring_dedup(spark.createDataFrame([(1, "a\nb", "s"), (2, None, None)], "doc_id long, text string, source string"), carry=("source",), tidy=False).collect()
    assert sorted((r["doc_id"], r["kept"], r["source"]) for r in carried) == [(1, "a\nb", "s"), (2, "", None)]


@pytest.mark.parametrize("group", [256, 3])
def test_ngram_join_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(join, "GROUP", group)  # 3: clusters of many groups, hubs and outsiders
    rows = corpus(seed=group)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near_groups(rows)


def test_ngram_join_edges(spark):
    rows = [(5, "one two three", 9), (3, "ONE Two three", 9), (4, None, 9), (6, None, 9), (7, "", 9), (5, "one two three", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.ngram_jaccard_join(df).collect())
    assert got == [(3, 1, 3), (4, 0, 4), (5, 1, 3), (5, 1, 3), (6, 0, 6), (7, 0, 7)]
    assert join.ngram_jaccard_join(df.limit(0)).count() == 0


def test_merge_skip_counts_like_a_counter():
    r = random.Random(4)
    from collections import Counter

    for _ in range(300):
        lists = [sorted(r.sample(range(40), r.randint(1, 20))) for _ in range(r.randint(1, 8))]
        need, after = r.randint(1, len(lists)), r.randint(-1, 10)
        count = Counter(x for own in lists for x in own if x > after)
        assert dict(join.merge_skip(lists, need, after)) == {x: c for x, c in count.items() if c >= need}


ITEM = "Alice bought 12 apples for 3 dollars each, and then gave 12 apples to Bob. How much did Alice spend in total on apples?"


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        (ITEM, True),
        ("so: " + ITEM.lower() + " yes", True),
        (ITEM.upper(), True),
        (ITEM.replace("12", "7").replace("3", "1,250.5").replace("Alice", "Carol").replace("dollars", "euros"), True),
        (ITEM.replace("12", "7", 1).replace("Alice", "Carol", 1).replace("Bob", "Carol"), False),  # slots contradict
        ("Alice bought 12 apples in the morning and sold none of them", False),
        (None, False),
        ("", False),
    ],
)
def test_templates(text, hit):
    found = Benchmark([(4, ITEM)]).judge(_template([text or ""]))
    assert bool(found) == hit


PENS = "She packed 2 pens and 2 books into the bag before walking to school with friends"
RACE = "The first race took 5 hours and the second one took 3 hours in the rain"
PASSAGE = " ".join(f"word{chr(97 + k)}" for k in range(24)) + " 12 apples and " + " ".join(f"thing{chr(97 + k)}" for k in range(16)) + " 12 apples in all"


@pytest.mark.parametrize(
    ("item", "text", "hit"),
    [
        (PENS, PENS.replace("2 pens", "3 pens").replace("2 books", "5 books"), True),  # one value, two things
        (RACE, RACE.replace("5 hours", "1 hour").replace("3 hours", "2 hours"), True),
        (PASSAGE, PASSAGE.replace("12", "7", 1), True),  # a long verbatim run next to a contradiction
        (PASSAGE.replace("and", "and 12 apples or"), PASSAGE.replace("and", "and 7 apples or").replace("12", "7", 1), True),
        ("He saw 12 apples and she 12 apples", "He saw 12 apples and she 7 apples", False),
    ],
)
def test_contradicting_slots_leave_the_rest(item, text, hit):
    assert bool(Benchmark([(4, item)]).judge(_template([text]))) == hit


@pytest.mark.parametrize("item", ["What is 12 times 7?", "Convert 5 km to miles", "Solve 3 x + 5 = 20", "12 + 7 + 3 = 22, 12 - 7 - 3 = 2, so?"])
def test_short_items_are_found_word_for_word(item):
    judge = Benchmark([(4, item)]).judge
    assert judge(_template([f"Now: {item} Yes."])) and not judge(_template([f"Now: {item.replace('5', '6').replace('7', '8')} Yes."]))


def invented_questions(r, n):
    """Items and texts that hold them whole, in part, with other values, and with values that contradict each other."""
    names, things, verbs = ["Alice", "Bob", "Carol", "Dave"], "apples pens books km hours dollars stones".split(), "buys sells holds finds counts paints".split()
    value = lambda: str(r.choice([2, 3, 5, 12, 7]))

    def item():
        words = []
        for _ in range(r.randint(1, 9)):
            words += [r.choice(["then", "and", "so", "when"]), r.choice(names), r.choice(verbs), value(), r.choice(things)]
        return words[: r.randint(3, len(words))]

    items = [item() for _ in range(n)]
    texts = []
    for _ in range(8 * n):
        own = list(r.choice(items))
        swap = dict(zip(names, r.sample(names, 4), strict=True)) | {x: value() for x in ("2", "3", "5", "12", "7")}
        own = [swap.get(w, w) for w in own] if r.random() < 0.6 else own
        for _ in range(r.choice([0, 0, 1, 2])):
            k = r.randrange(len(own))
            own[k : k + r.choice([0, 1])] = [r.choice([value(), "quite", r.choice(names)])]
        other = list(r.choice(items))
        texts.append(" ".join(["the", *own[: r.randint(3, len(own) + 3)], *(other[r.randrange(len(other)) :] if r.random() < 0.5 else []), "end."]))
    return [" ".join(x) for x in items], texts


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_judging_equals_brute_force(monkeypatch, most):
    import bitweave.llm.decontamination as d

    monkeypatch.setattr(d, "MOST_MATCHES", most)
    for seed in range(6):
        items, texts = invented_questions(random.Random(seed), 6)
        found = Benchmark(list(enumerate(items))).judge(_template(texts))
        got = {(k, i) for k, x in found.items() for i in x}
        want = {(k, i) for k, t in enumerate(texts) for i, x in enumerate(items) if contaminates(x, t)}
        assert got == want and 10 < len(want) < len(texts) * len(items)


def test_one_item_is_not_put_together_from_contradicting_passages():
    item = "When Alice takes 12 red apples from the old basket near her door then Alice gives 12 red apples to the tall man by the river and walks back home"
    words = item.split()
    a, b = " ".join(words[:12]).replace("Alice", "Carol").replace("12", "5"), " ".join(words[13:]).replace("Alice", "Dora").replace("12", "9")
    short = " ".join(words[:11])
    assert not Benchmark([(4, " ".join(words[:11] + words[13:24]))], 8).judge(_template([f"x {short.replace('12', '5')} zz yy {' '.join(words[13:22]).replace('12', '9')}"]))
    assert Benchmark([(4, item)]).judge(_template([f"x {a} zz yy xx {b}"]))  # the second passage alone is long enough


def test_lines_of_numbers_take_no_product():
    r = random.Random(3)
    numbers = lambda n: " ".join(str(r.randint(1, 99)) for _ in range(n))
    lead = "Add up all of these numbers and say what their sum is now: "
    bench = Benchmark([(1, numbers(3000)), (2, lead + numbers(3000))])
    import time

    began = time.time()
    assert not bench.judge(_template([numbers(3000), " ".join(["7"] * 3000)]))
    assert bench.judge(_template([numbers(500) + " " + lead + numbers(3000)])).keys() == {0}
    assert time.time() - began < 90


def test_decontaminate(spark, monkeypatch):
    import bitweave.llm.decontamination as d

    rows = [(i, t, "b") for i, t in corpus(seed=9)] + [(1000, "x y " + ITEM, "b"), (1000, "x y " + ITEM, "b"), (1001, "Short ONE, here", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, contaminated string")
    items = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, "short one here"), (3, None), (None, "a b c d e f g h i"), (9, "")], "item_id long, text string")
    for most in (1_000_000, 20):  # 20: one pass for every few tokens
        monkeypatch.setattr(d, "MOST_TOKENS", most)
        got = {(r["doc_id"], tuple(r["item_ids"])) for r in decontaminate(docs, items).where("contaminated").collect()}
        assert got == {(1000, (1,)), (1001, (2,))}
    assert decontaminate(docs.limit(0), items).count() == 0
    assert decontaminate(docs, items.limit(0)).where("contaminated").count() == 0


def test_language_id(spark):
    r = random.Random(2)
    stems = {"aa": ["lorem", "ipsum", "dolor"], "bb": ["straße", "über", "nacht"], "cc": ["été", "où", "ça"]}
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice(["", "s", "n"]) for _ in range(30)), lang) for i in range(90) for lang in [list(stems)[i % 3]]]
    rows += [(200, None, "aa"), (201, "12 34 !!", "bb"), (202, "", None), (203, "loremsn ipsumss", None), (203, "loremsn ipsumss", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang").selectExpr("*", "'x' AS lang_pred", "0 AS score")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_language(docs, train(docs.where(~held_out()))).collect()}
    assert all(got[i][0] == list(stems)[i % 3] and 0.9 < got[i][1] <= 1 for i in range(90))
    assert got[200] == got[201] == got[202] == ("und", 0.0)
    assert got[203][0] == "aa"
    empty = train(docs.limit(0))
    assert {r["lang_pred"] for r in identify_language(docs, empty).collect()} == {"und"}
    assert identify_language(docs.limit(0), empty).count() == 0
    sampled = train(docs, sample_docs=30)
    assert 0 < len(sampled.tables[0][0]) <= len(train(docs).tables[0][0])
    assert 0 < len(train(docs, sample_bytes=3000).tables[0][0])


def plain_language(rows, lengths=(5, 4, 3, 2, 1)):
    """{id: (language, score)} by dictionaries, of rows (id, text, language or None, learned from)."""
    import math
    import re
    from collections import Counter

    words = lambda text: re.findall(r"[^\W\d_]+", (text or "").lower())
    grams = lambda w, n: [w] if n == 0 else [x[k : k + n] for x in [w if n == 1 else f" {w} "] for k in range(len(x) - n + 1)]
    langs = sorted({lang for *_, lang, learn in rows if lang and learn})
    counts = {n: {x: Counter() for x in langs} for n in (0, *lengths)}
    for _, text, lang, learn in rows:
        for w in words(text) if lang and learn else ():
            for n in (0, *lengths):
                counts[n][lang].update(grams(w, n))

    def normal(scores):
        top = max(scores)
        z = math.log(sum(math.exp(s - top) for s in scores))
        return [max(s - top - z, -8.0) for s in scores]

    tables = {}
    for n, by in counts.items():
        known = set().union(*by.values())
        tables[n] = {g: normal([math.log((by[x][g] + 0.05) / (sum(by[x].values()) + 0.05 * len(known))) for x in langs]) for g in known}
    out = {}
    for i, text, *_ in rows:
        total = [0.0] * len(langs)
        for w in words(text):
            for n in (0, *lengths):
                own = [tables[n][g] for g in grams(w, n) if g in tables[n]]
                if own:
                    break
            score = (own[0] if n == 0 else normal([sum(x) for x in zip(*own, strict=True)])) if own else [-math.log(len(langs))] * len(langs)
            total = [a + b for a, b in zip(total, score, strict=True)]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        out[i] = (langs[best], 1 / sum(math.exp(t - total[best]) for t in total)) if words(text) else ("und", 0.0)
    return out


def test_language_id_equals_a_plain_version(spark, tmp_path):
    r = random.Random(6)
    letters = {"aa": "abcdeéèüß", "bb": "efghiöñ", "cc": "ijklmaç"}
    word = lambda lang: "".join(r.choice(letters[lang]) for _ in range(r.randint(1, 7)))
    rows = []
    for i in range(120):
        lang = r.choice(list(letters))
        rows.append((i, " ".join(r.choice([word(lang), word(lang).upper(), "12", "x_y", word(r.choice(list(letters)))]) for _ in range(r.randint(0, 40))), r.choice([lang, lang, None])))
    rows += [(300, None, "aa"), (301, "... 5", "bb"), (302, "ab" * 200, None), (303, "ef" * 5000 + " ij", "cc"), (304, "日本 Ωμέγα", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang").write.parquet(str(tmp_path / "documents.parquet"))
    from zlib import crc32

    from bitweave.llm.queries import QUERIES

    held = {i: crc32(str(i).encode()) % 4 == 2 for i, *_ in rows}
    want = plain_language([(*row, not held[row[0]]) for row in rows])
    got = {x["doc_id"]: x for x in QUERIES["op5_language_id"](spark, str(tmp_path)).collect()}
    assert {i: x["held_out"] for i, x in got.items()} == held
    assert {i: x["lang_pred"] for i, x in got.items()} == {i: x for i, (x, _) in want.items()}
    assert all(abs(got[i]["score"] - x) < 1e-4 for i, (_, x) in want.items())


def test_language_ties_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (None, "same words", "c"), (4, "same", None)], "doc_id long, text string, lang string")
    assert {x["lang_pred"] for x in identify_language(docs, train(docs)).collect()} == {"a"}


def test_every_learned_word_is_kept(spark):
    names = lambda first, n: [first + chr(97 + k // 26) + chr(97 + k % 26) for k in range(n)]
    rows = [(i, " ".join(names("x", 60)), "hot") for i in range(20)] + [(100 + i, " ".join(names("y", 20)), "small") for i in range(2)] + [(200, "once", "small")]
    model = train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.tables[0][0]) == 81


def test_a_long_text_needs_little_memory():
    """Words of a text that is longer than a stretch have the hashes that they have alone."""
    import bitweave.llm._text as text

    long = " ".join(["ab", "c" * 50, "d" * 7] * 20).encode()
    whole = Words(np.frombuffer(long, np.uint8), np.array([0, len(long)])).hash
    old, text.STRETCH = text.STRETCH, 16
    try:
        assert Words(np.frombuffer(long, np.uint8), np.array([0, len(long)])).hash.tolist() == whole.tolist()
    finally:
        text.STRETCH = old
