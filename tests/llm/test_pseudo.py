import math
import random
from collections import Counter

import numpy as np
import pytest

from lanewise.llm import pseudo

SCHEMA = "doc_id long, text string"
LINE = "the cat sat on the mat and the dog ran to the house".split()


def model(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    known, counts, letters, total = pseudo.counted(docs)
    words = (known, pseudo.spelling(letters))
    return docs, words, counts, total, pseudo.trained(docs, words, counts)


@pytest.fixture(scope="module")
def prose():
    """Documents of few words and many, some of them twice, with a passage that most share."""
    g = random.Random(8)
    words = [f"w{k}" for k in range(300)] + LINE * 20
    rows = [(k, " ".join(g.choice(words) for _ in range(g.randint(0, 90)))) for k in range(120)]
    rows += [(200 + k, t) for k, (_, t) in enumerate(rows[:20])] + [(300 + k, f"{rows[k][1]} one passage that all of these share") for k in range(90)]
    return [*rows, (900, None), (901, ""), (902, "x" * 30_000), (903, "a " * 5000), (906, f"w1 w2 {'漢' * 4000} w3 w4"), (907, f"w1 w2 {'字' * 4000} w3 w4"), (908, f"w1 w2 {'q' * 900} w3 w4"), (909, f"w1 w2 {'z' * 30_000} w3 w4"), (910, f"w1 w2 {'z' * 30_000} w3 w4"), (None, "null id"), (904, "Ünïcode \x00 É"), (905, "w1 w1"), (905, "w1 w1")]


def numbers_of(known, words):
    return [known.index(w) + 2 if w in known else pseudo.RARE for w in words]


def spelt(letters, word):
    a = b = 0
    out = 0.0
    for c in [*(int(pseudo._LETTER[x]) for x in word), 0]:
        out += letters[a][b][c]
        a, b = b, c
    return out


def network_score(net, known, letters, words, k):
    """The log-probability of word k by walking the tree."""
    n = [pseudo.OUTSIDE] * 2 + numbers_of(known, words) + [pseudo.OUTSIDE] * 2
    h = np.tanh(sum(net.embed[n[2 + k + s]] * net.side[j] for j, s in enumerate(pseudo.SIDES)))
    out = 0.0
    for e in range(net.start[n[2 + k]], net.start[n[2 + k]] + net.depth[n[2 + k]]):
        unit = net.path[e]
        out -= math.log1p(math.exp(-net.turn[e] * (float(h @ net.units[unit]) + float(net.odds[unit]))))
    return out + (spelt(letters, words[k]) if n[2 + k] == pseudo.RARE else 0.0)


@pytest.mark.parametrize(("shared", "gathered", "known"), [(64, 1 << 20, 1 << 15), (2, 200, 1 << 15), (3, 1 << 20, 40)])
def test_scores_equal_brute_force(spark, prose, monkeypatch, shared, gathered, known):
    monkeypatch.setattr(pseudo, "SHARED", shared)
    monkeypatch.setattr(pseudo, "GATHERED", gathered)
    monkeypatch.setattr(pseudo, "KNOWN", known)
    docs, (words, letters), counts, total, net = model(spark, prose)
    texts = [pseudo.words_of((t or "").encode()) for _, t in prose]
    every = Counter(w for x in texts for w in x)
    often = [w for w, n in sorted(every.items(), key=lambda x: (-x[1], x[0])) if n > 1]
    assert total == sum(every.values()) == counts.sum() and words == often[: len(words)] and len(words) == len(often) if len(often) <= known else 10 < len(words) <= known
    near, same = Counter(), Counter()
    for x in texts:
        p = [b""] * 2 + x + [b""] * 2
        for k, w in enumerate(x):
            c = (p[k], p[k + 1], p[k + 3], p[k + 4])
            near[c] += 1
            same[c, w] += 1
    got = sorted(map(tuple, pseudo.pseudo_scores(docs).collect()), key=str)
    want = []
    for (doc, _), x in zip(prose, texts, strict=True):
        p, score, seen = [b""] * 2 + x + [b""] * 2, 0.0, {}
        for k, w in enumerate(x):
            c = (p[k], p[k + 1], p[k + 3], p[k + 4])
            if (c, w) not in seen:  # the same window has the same probability
                seen[c, w] = network_score(net, words, letters, x, k)
            q, n = seen[c, w], same[c, w] - 1
            score += (max(q, math.log(n)) + math.log1p(math.exp(-abs(q - math.log(n)))) if n else q) - math.log(near[c])
        want.append((doc, len(x), score))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and a[3] == a[2] / max(1, a[1]) and math.isfinite(a[2])
        assert a[2] == pytest.approx(b[2], rel=0.001, abs=0.05)


def test_texts_of_any_script_have_finite_scores(spark):
    """Runs of a megabyte without blanks, one of a kind and twice, in equal surroundings."""
    runs = ["漢" * 350_000, "ж" * 500_000, "😀" * 250_000, "x" * 1_000_000, "\x00" * 1_000_000, "".join(chr(0x4E00 + k % 20_000) for k in range(350_000))]
    rows = [(k, f"a b {t} c d") for k, t in enumerate(runs)] + [(10 + k, f"a b {t} c d") for k, t in enumerate(runs[:2])] + [(20, runs[2])]
    got = {r["doc_id"]: r["score"] for r in pseudo.pseudo_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(math.isfinite(x) for x in got.values())
    # Bytes other than letters are each as unlikely as the next; a run that stands twice between the same words is remembered.
    assert got[5] < -1_000_000 and all(got[k] > -100 and got[k] == pytest.approx(got[10 + k]) for k in (0, 1))


def test_probabilities_sum_to_one(spark, prose):
    _, (words, letters), counts, _, net = model(spark, prose)
    numbers = np.array([5, 9, 0, 7, 4], np.uint16)
    total = 0.0
    for w in range(net.size):
        if w != pseudo.OUTSIDE:
            numbers[2] = w
            total += math.exp(net.log_probabilities(numbers, np.array([2]))[0])
    assert total == pytest.approx(1, abs=1e-4) and len(words) == net.size - 2
    each = np.exp(letters)
    each[:, :, 27] *= pseudo.OTHERS
    assert np.allclose(each.sum(axis=2), 1)


def test_training_learns_both_sides(spark):
    rows = [(k, " ".join(LINE * 40)) for k in range(400)]
    _, (words, letters), counts, _, net = model(spark, rows)
    lex, plain = pseudo.Lexicon(words, letters), pseudo.Network(counts)
    shuffled = LINE * 5
    random.Random(1).shuffle(shuffled)

    def mean(net, words):
        return net.log_probabilities(*lex.plain([" ".join(words).encode()])).mean()

    assert mean(net, LINE * 5) > mean(plain, LINE * 5) + 1 and mean(net, LINE * 5) > mean(net, shuffled) + 0.5


def test_texts_that_occur_twice_stand_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = pseudo.pseudo_scores(docs).join(docs, "doc_id").selectExpr("mean_score", "count(*) over (partition by text) as n", "n_tokens").where("n_tokens > 20").toPandas()
    once, twice = got[got.n == 1].mean_score, got[got.n == 2].mean_score
    assert len(twice) > 20 and (twice > -1.5).all() and once.median() < -5


def test_empty_table_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "c")], "doc_id long, text string, TEXT string")
    assert [r["n_tokens"] for r in pseudo.pseudo_scores(docs).collect()] == [2]
    assert pseudo.pseudo_scores(docs.limit(0)).count() == 0
    assert [r["score"] for r in pseudo.pseudo_scores(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).collect()] == [0.0, 0.0]
