import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm import bpe, digest, edits, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ID string"
ODD = [(1, "", "en", "s", 0, "x"), (2, None, None, None, None, None), (3, "a", "en", "s", 1, "x"), (3, "a", "en", "s", 1, "x"), (None, "b b b", "en", "s", 5, "x"), (9, "x" * 50_000, "en", "s", 50_000, "x")]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load(bpe.default_path())


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return bpe.Encoder(vocabulary)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(encoder, library):
    g = random.Random(1)
    letters = "ab'srelvtdm.,   \n\t\r ՘Ᲊéß漢字😀123!?<|endoftext|>\x85\xa0\x1c_"
    for k in range(4000):
        s = "".join(g.choice(letters) for _ in range(g.randint(0, 30))) + ("<|endoftext|>x" if k % 5 == 0 else "") + ("aaaa" * 20 if k % 7 == 0 else "")
        ids = library.encode(s, add_special_tokens=False).ids
        packed = encoder.encode(s)
        assert np.frombuffer(packed, "<u4").tolist() == ids
        assert encoder.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in simhash.components(e).collect()} == {(k, 0) for k in range(1, 41)} | {(101, 100)}


def test_digest_across_shards(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    placed = digest.neighbours(docs, per_shard=700)
    assert placed.where("guest").count() == placed.select("shard").distinct().count() > 3
    assert digest.compare_edits(docs).count() == 5000


def test_edits_equal_counting_anew(encoder, library):
    g = random.Random(6)
    piece = lambda n: "".join(g.choice("ab c'd  \n\té1!. ") for _ in range(g.randint(0, n)))
    for _ in range(300):
        text = piece(400)
        tree = edits.CountTree(text, encoder)
        for _ in range(4):
            a = g.randint(0, len(text))
            b, new = min(len(text), a + g.randint(0, 30)), piece(20)
            text = text[:a] + new + text[b:]
            tree.edit(a, b, new)
            assert (tree.chars, tree.tokens) == (len(text), len(library.encode(text, add_special_tokens=False).ids))
