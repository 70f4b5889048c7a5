"""The frames of the token, edit and fingerprint operators, against the library and independent forms."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm import bpe, digest, edits

SCHEMA = "doc_id long, text string, TEXT string"
ODD = [(1, "", "x"), (2, None, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "null id", "x"), (9, "x" * 50_000, "x"), (3, "another é 漢字 <|endoftext|> 12", "x")]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def token_row(library, doc, text):
    ids = ids_of(library, text)
    decoded = library.decode(ids, skip_special_tokens=False)
    return (doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_tokens_of_a_table_equal_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {token_row(library, r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {tuple(r) for r in bpe.op2_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_tokens_of_odd_rows(odd, library):
    got = bpe.digests(bpe.encode_texts(odd)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted((token_row(library, d, t) for d, t, _ in ODD), key=str)
    assert bpe.encode_texts(odd.limit(0)).count() == 0


def test_memory_of_pieces_is_bounded_by_bytes():
    e = bpe.Encoder(bpe.load(bpe.default_path()))
    g = random.Random(1)
    for _ in range(30):
        e.encode("".join(g.choice("abcdefgh") for _ in range(5000)) + " " + " ".join(str(g.random()) for _ in range(50)))
    assert max(len(p) for p in e.known) <= bpe.LONGEST
    assert e.held == sum(len(p) + len(x) + bpe.ENTRY for p, x in e.known.items() if p not in e.special_id)
    e.held = bpe.CACHE + 1
    e.encode("a new piece")
    assert e.held < 1000 and e.old


def applied(text, changes):
    for c in changes or ():
        start = max(0, min(c[0] or 0, len(text)))
        end = max(start, min(c[1] or 0, len(text)))
        text = text[:start] + (c[2] or "") + text[end:]
    return text


def test_edited_counts_equal_counting_anew(spark, library):
    g = random.Random(3)
    piece = lambda n: "".join(g.choice("ab c'd  \n\té1!. ") for _ in range(g.randint(0, n)))
    rows = [(k, piece(600), [(g.randint(-5, 700), g.randint(-5, 700), piece(40)) for _ in range(g.randint(0, 6))], "x") for k in range(60)]
    rows += [(100, None, [(0, 0, "new text")], "x"), (101, "", None, "x"), (102, "a b", [(None, None, None), (1, 0, "z"), (99, 200, "end"), (0, 99, "")], "x"), (103, "w " * 20_000, [(20_000, 20_010, "v " * 3000), (5, 6, "")], "x"), (None, "null id", [(0, 4, "no")], "x")]
    rows += [rows[7], rows[7]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, Edits string")
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) for r in edits.counts_after(frame).collect()), key=str)
    want = []
    for doc, text, changes, _ in rows:
        after = applied(text or "", changes)
        want.append((doc, len(ids_of(library, text)), len(ids_of(library, after)), len(after)))
    assert got == sorted(want, key=str) and edits.counts_after(frame.limit(0)).count() == 0


def test_edits_encode_only_what_they_touch(spark):
    frame = spark.createDataFrame([(1, "a word " * 20_000, [(70_000, 70_001, "x")])], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>")
    assert edits.counts_after(frame).first()["encoded_chars"] < 400


def test_a_growing_tree_keeps_its_sums(library):
    e, g = bpe.Encoder(bpe.load(bpe.default_path())), random.Random(5)
    tree, text = edits.CountTree("", e), ""
    for _ in range(150):
        at, new = g.randint(0, len(text)), " ".join(g.choice(["one", "two", "\n", "3"]) for _ in range(g.randint(0, 60)))
        text = text[:at] + new + text[at:]
        tree.edit(at, at, new)
    assert (tree.chars, tree.tokens) == (len(text), len(ids_of(library, text)))
    for (c, t), (up, ut) in zip(tree.levels, tree.levels[1:], strict=False):
        assert [sum(c[k : k + 16]) for k in range(0, len(c), 16)] == up and [sum(t[k : k + 16]) for k in range(0, len(t), 16)] == ut


def plain_digest(text):
    """The digest by counting one triplet after the other and sorting counts."""
    raw = text.encode()
    n = Counter((raw[k] | raw[k + 1] << 8 | raw[k + 2] << 16) * 0x9E3779B1 % (1 << 32) >> 25 for k in range(len(raw) - 2))
    counts = [n[b] for b in range(128)]
    q = [sorted(counts)[k] for k in (31, 63, 95)]
    codes = [sum(c > x for x in q) for c in counts]
    size = min(255, round(8 * math.log2(len(raw) + 1)))
    return size, codes


def hexed(d):
    size, codes = d
    return bytes([size, *(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 128, 4))]).hex()


def plain_likeness(a, b):
    return 1 - (sum(abs(x - y) for x, y in zip(a[1], b[1], strict=True)) + min(48, abs(a[0] - b[0]))) / (3 * 128 + 48)


def fingerprint_rows(docs, hashes):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashes[d[1] or ""]), reverse=True)
    for k, (doc, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 2
        ed = text[: len(text) - n] + other[:n]
        a, b, c = map(plain_digest, (text, ed, other))
        yield doc, len(text), hashlib.sha256(ed.encode()).hexdigest(), hexed(a), hexed(b), plain_likeness(a, b), plain_likeness(a, c)


def rounded(rows):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, rows)), key=str)


@pytest.mark.parametrize("per_shard", [2000, 4])
def test_fingerprints_equal_brute_force(spark, monkeypatch, per_shard):
    old = digest.neighbours
    monkeypatch.setattr(digest, "neighbours", lambda docs: old(docs, per_shard))
    g = random.Random(5)
    text = lambda: "".join(g.choice("abc défß\n") for _ in range(g.randint(0, 90)))
    some = [text() for _ in range(40)]
    cases = [
        [(3 * k, t) for k, t in enumerate(some)] + [(500, None), (501, "")],
        [(k % 3 if k % 2 else None, t) for k, t in enumerate(some)],  # ids that many rows share, none for half
        [(7, some[k % 5]) for k in range(30)] + [(2**63 - 1, "x"), (-(2**63), "y" * 20_000)],
        [(7, "alone")],
    ]
    for docs in cases:
        texts = spark.createDataFrame([(t,) for t in {d[1] or "" for d in docs}], "text string")
        hashes = {r["text"]: r["h"] for r in texts.withColumn("h", F.xxhash64("text")).collect()}
        frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
        assert rounded(digest.compare_edits(frame).collect()) == rounded(fingerprint_rows(docs, hashes))
    assert digest.compare_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fingerprints_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rounded(digest.op10_digest(spark, sf).collect()) == rounded(fingerprint_rows(docs, dict.fromkeys([t or "" for _, t in docs], 0)))


def test_an_id_of_most_rows_is_dealt_by_its_texts(spark):
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    placed = digest.neighbours(docs, per_shard=100)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert sum(sizes) == 3000 + len(sizes) and max(sizes) < 300
    assert digest.compare_edits(docs).count() == 3000
