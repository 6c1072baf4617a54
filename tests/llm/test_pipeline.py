"""The whole pipeline against plain versions of its stages."""

import random
import zlib
from collections import Counter

import pytest
from brute import contaminates, kept_words, near_groups

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

QUESTION = "When Alice takes 12 red apples from the old basket near her door then Bob gives 7 pears to the tall man by the river and walks back home"


def documents(seed=3, n=90):
    r = random.Random(seed)
    stems = {"aa": "the of and stone river paper walks under night green".split(), "bb": "der und nicht straße über nacht grün haus läuft".split()}
    words = lambda lang, k: " ".join(r.choice(stems[lang]) + r.choice(["", "", "s", "en", "er", "ing", "ung"]) + r.choice(["", "", ".", ","]) for _ in range(k))
    passage, rows = words("aa", 30), []
    for i in range(n):
        lang, x = r.choice(["aa", "bb"]), r.random()
        text = words(lang, r.choice([3, 20, 60, 150]))
        if x < 0.15 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif x < 0.3:
            lang, text = "aa", f"{words('aa', 20)} {passage} {words('aa', 25)}"
        elif x < 0.4 and rows:
            own = (rows[r.randrange(len(rows))][1] or "").split()
            text = " ".join([*own[:-1], "end"])
        elif x < 0.5:
            lang, text = "aa", f"{words('aa', 30)} {QUESTION.replace('12', '9').replace('Alice', 'Carol')} {words('aa', 10)}"
        rows.append((i, text, lang))
    return rows + [(n, None, "aa"), (n + 1, "12 34 !", "aa"), (n + 2, "", None), (n + 3, rows[0][1], "aa"), (n + 4, passage, "aa")]


def test_run_equals_plain_stages(spark, tmp_path):
    from test_text_operators import plain_language

    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' AS source", "char_length(text) AS n_chars", "1 AS score", "'x' AS lang_pred", "true AS contaminated", "'k' AS kept", "2 AS _salt")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, QUESTION), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    language = plain_language([(i, t, lang, True) for i, t, lang in rows])
    left = [(i, t) for i, t, _ in rows if language[i][0] != "und" and language[i][1] >= pipeline.LEAST_SCORE]
    roots = near_groups(left)
    left = [(i, t) for i, t in left if roots[i][1] == i]
    cut = kept_words(left)
    left = [(i, t if cut[i][0] == len(cut[i][1]) else " ".join(cut[i][1])) for i, t in left if cut[i][0] == len(cut[i][1]) or cut[i][1]]
    left = [(i, t) for i, t in left if not contaminates(QUESTION, t)]
    plain, want = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")), Counter()
    for i, t in left:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        for k in range(0, len(ids), 4096):
            piece = ids[k : k + 4096]
            want[i, k, len(piece), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)), len(ids)] += 1

    got = pipeline.run(spark, str(tmp_path)).collect()
    assert 20 < len(left) < len(rows) - 20
    assert Counter((x["doc_id"], x["start"], x["length"], x["ids_crc32"], x["doc_tokens"]) for x in got) == want
    sequences = {}
    for x in got:
        sequences.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some plain words", "aa", "s", 16)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1.5D AS score", "array(1) AS item_ids")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        one, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert one.count() == 1 and none.count() == 0 and one.schema.names == none.schema.names, name
        if name != "packing":
            assert one.schema.names == docs.schema.names and [x.dataType.simpleString() for x in one.schema] == [x.dataType.simpleString() for x in docs.schema]
            assert one.select("score").first()[0] == 1.5
