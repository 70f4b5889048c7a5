import random
import time

import pytest
from pyspark.sql import functions as F

from lanewise.llm import toxicity

LEXICON = {"idiot": 6.0, "stupid": 6.0, "worthless": 6.0, "moron": 6.0, "trash": 6.0, "clown": 6.0, "bad": 6.0}


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.001"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_disguised_forms(tables):
    d = toxicity.Decoder(toxicity.letter_model(tables[0]), LEXICON, -4.0)
    for t in ("worthle$$", "idio+", "iddiot", "stuupid", "you STUUPID.", "'iddiot',", "1d1iot!", "what a m o r o n", "y o u a r e a m o r o n", "you a r e   s t u p i d!", "a " + "x y z " * 30 + "c l o w n", "b a d", "a b-a-d", "m_o_r_o_n", "tra$h+", "c|own"):
        assert d.score(t.encode()) >= 0.5, t
    for t in ("the good doggy", "bath b a t h", "a b c d e f g", "x a b a d e", "10 0 0 1 4", "idol", "mormon", "trashes", "1.5 + 3.7 = 5.2"):
        assert d.score(t.encode()) < 0.5, t


def test_smallest_table_trains(tables):
    docs, labels = tables
    model, lexicon, bias = toxicity.train(docs, labels)
    d = toxicity.Decoder(model, lexicon, bias)
    assert {"moron", "trash", "scum", "loser", "disgusting"} <= lexicon.keys()
    assert d.score(b"") < 0.5 and d.score(b"you moron, what trash and scum") >= 0.5
    got = toxicity.scores(docs, labels).join(labels, "doc_id")
    caught, false, toxic = got.agg(F.sum(F.expr("cast(predicted = 1 and toxic = 1 as int)")), F.sum(F.expr("cast(predicted = 1 and toxic = 0 as int)")), F.sum("toxic")).first()
    assert caught * 2 > toxic and false <= 2


def every_reading(model, token, repeat):
    """The best score and text among all readings of a token, one by one."""
    best = (-1e9, None)

    def go(k, a, b, score, text):
        nonlocal best
        if k == len(token):
            best = max(best, (score + model[a][b][0], text), key=lambda x: x[0])
            return
        c = token[k]
        letters = c if "a" <= c <= "z" else toxicity.LEET.get(c, "")
        cost = 0.0 if letters == c else toxicity.SIGN
        if c in toxicity.SEPARATORS or (not letters and b):
            go(k + 1, a, b, score + toxicity.GAP, text)
        for x in letters:
            n = ord(x) - 96
            go(k + 1, b, n, score + cost + model[a][b][n], text + x)
            if n == b:
                go(k + 1, a, b, score + repeat + cost, text)

    go(0, 0, 0, 0.0, "")
    return best[1]


def test_viterbi_finds_the_best_of_all_readings(tables):
    model = toxicity.letter_model(tables[0])
    d, g = toxicity.Decoder(model, {}, 0.0), random.Random(1)
    for _ in range(200):
        token = "".join(g.choice("a1i!ls$5.-oo0t+e3|") for _ in range(g.randint(1, 8)))
        for repeat in toxicity.REPEATS:
            if (want := every_reading(d.model, token, repeat)) is not None:
                assert d.read(token, repeat).decode() == want


def test_long_tokens_and_texts_take_linear_time(tables):
    d = toxicity.Decoder(toxicity.letter_model(tables[0]), LEXICON, -4.0)
    for text in (b"a1" * 200_000, b"a b " * 100_000, b"m o r o n " * 50_000, b"x" * 1_000_000, b"st.u" * 100_000, b"i!" * 200_000):
        began = time.monotonic()
        d.score(text)
        assert time.monotonic() - began < 20, text[:4]
    assert d.score(b"a b " * 50_000 + b"s t u p i d") >= 0.5


def test_letter_model_equals_counting(spark):
    import numpy as np

    rows = [(1, "abca"), (2, None), (3, ""), (4, "A b!"), (4, "A b!")]
    counts = np.full((27, 27, 27), 0.1)
    for _, t in rows:
        code = [ord(c.lower()) - 96 if c.isalpha() else 0 for c in t or ""]
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            counts[a, b, c] += 1
    model = toxicity.letter_model(spark.createDataFrame(rows, "doc_id long, text string"))
    assert np.allclose(model, np.log(counts / counts.sum(axis=2, keepdims=True)))


def test_held_out_recall_and_precision(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out")
    right, called, toxic, n = got.selectExpr("sum(int(predicted = 1 and toxic = 1))", "sum(predicted)", "sum(toxic)", "count(*)").first()
    assert n > 500 and right / toxic > 0.85 and right / called > 0.8


def test_labels_of_the_held_out_fold_change_nothing(tables):
    docs, labels = tables
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.scores(docs, x).collect()} for x in (labels, other))
    assert one == two


def test_odd_rows(spark, tables):
    labels = tables[1]
    schema = "doc_id long, text string, TEXT string, lang string"
    rows = [(1, None, "you moron", "en"), (2, "", "x", None), (3, "you m0r0n, what trash", "x", "en"), (3, "you m0r0n, what trash", "x", "en"), (None, "you m0r0n, what trash", "x", "en"), (5, "the cat", "x", "en")]
    train = tables[0].select("doc_id", "text")
    odd = spark.createDataFrame(rows, schema)
    everything = train.unionByName(odd.toDF("doc_id", "text", "a", "b").selectExpr("doc_id + 1000000 as doc_id", "text"))
    model = toxicity.train(everything, labels)
    d = toxicity.Decoder(*model)
    got = toxicity.scores(odd, labels).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert d.score(b"you m0r0n, what trash") >= 0.5 > d.score(None) == d.score(b"")
    # The stage learns from the documents it is given.
    both = train.selectExpr("doc_id", "text", "cast(null as string) as t2", "'x' as lang").unionByName(odd.toDF("doc_id", "text", "t2", "lang")).toDF(*odd.columns)
    kept = toxicity.drop_toxic(both, labels)
    assert kept.columns == odd.columns
    texts = [r[1] for r in kept.collect()]
    assert "the cat" in texts and None in texts and "" in texts and "you m0r0n, what trash" not in texts
    assert toxicity.scores(odd.limit(0), labels).count() == 0 and toxicity.drop_toxic(odd.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.scores(odd, labels.limit(0)).collect()} == {0}
