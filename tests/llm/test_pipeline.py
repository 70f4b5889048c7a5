import hashlib

import corpus_pipeline
import numpy as np
import pytest
from test_copies import brute_groups
from test_decontaminate import brute
from test_secrets import brute_base
from tokenizers import Tokenizer

from lanewise.llm import bpe, secrets, toxicity

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FUNCTIONS = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage is given and returns over the whole table, written and read again as the checker does."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = str(tmp_path_factory.mktemp(name) / "out")
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append((name, before, [tuple(r) for r in docs.collect()], docs.columns))
    return {name: rest for name, *rest in out}


def test_stages_in_order(steps):
    assert list(steps) == ["toxicity", "near_duplicates", "decontamination", "secrets", "tokens"]
    for name, (before, after, columns) in steps.items():
        assert columns == COLUMNS if name != "tokens" else {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(columns)
        assert len(before) >= len(after) > 0


def test_toxicity(spark, steps):
    before, after, _ = steps["toxicity"]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.Decoder(*toxicity.train(docs, labels))
    want = [r for r in before if scored.score(r[1].encode() if r[1] else None) < 0.5]
    assert sorted(after, key=str) == sorted(want, key=str) and len(want) < len(before)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert len(gone & toxic) > len(gone) / 2


def test_near_duplicates(steps):
    before, after, _ = steps["near_duplicates"]
    groups = brute_groups([r[1] for r in before])
    assert sorted(after, key=str) == sorted((min((before[k] for k in g), key=lambda r: r[0]) for g in groups), key=str) and len(groups) < len(before)


def test_decontamination(spark, steps):
    before, after, _ = steps["decontamination"]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(after, key=str) == sorted((r for r in before if not brute(r[1], items)[1]), key=str) and len(after) < len(before)


def test_secrets(steps):
    before, after, _ = steps["secrets"]
    old, new = ({r[0]: r for r in x} for x in (before, after))
    assert old.keys() == new.keys()
    for k, (doc, text, lang, source, n_chars) in old.items():
        got = new[k]
        assert got[1] == secrets.redact(text) and got[2:4] == (lang, source) and got[4] == (n_chars if got[1] == text else len(got[1]))
        for _, a, b in brute_base(text or ""):
            assert got[1] != text and text[a:b] not in got[1]


def test_tokens(steps):
    before, after, columns = steps["tokens"]
    library = Tokenizer.from_file(bpe.default_path())
    got = {r[0]: dict(zip(columns, r, strict=True)) for r in after}
    for doc, text, *_ in before:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (got[doc]["n_tokens"], got[doc]["ids_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest()) and bytes(got[doc]["ids"]) == raw
        assert got[doc]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_one_after_the_other(spark, steps):
    out = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: r["ids_sha256"] for r in out.collect()} == {r[0]: dict(zip(steps["tokens"][2], r, strict=True))["ids_sha256"] for r in steps["tokens"][1]}


@pytest.mark.parametrize("name", list(FUNCTIONS))
def test_odd_rows_of_each_stage(spark, name):
    rows = [(1, "", "en", "s", 0), (2, None, None, None, None), (3, "a word", "en", "s", 6), (3, "a word", "en", "s", 6), (3, "another text", "en", "s", 12), (None, "no id here", "en", "s", 10), (None, "no id there", None, "s", 11), (9, "x" * 50_000, "en", "s", 50_000)]
    odd = spark.createDataFrame(rows, SCHEMA)
    got = FUNCTIONS[name](spark, odd, SF)
    texts = sorted((t or "" for _, t, *_ in rows))
    if name == "near_duplicates":  # one of the texts without words, one of the repeated rows
        assert sorted((r["text"] or "" for r in got.collect())) == sorted(set(texts))
    elif name == "tokens":
        assert sorted(r["doc_id"] or 0 for r in got.collect()) == sorted(r[0] or 0 for r in rows)
    else:
        assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert FUNCTIONS[name](spark, odd.limit(0), SF).count() == 0
    clash = odd.toDF("doc_id", "text", "Text", "source", "n_chars")
    again = FUNCTIONS[name](spark, clash, SF)
    assert again.count() == got.count() and (name == "tokens" or again.columns == clash.columns)
