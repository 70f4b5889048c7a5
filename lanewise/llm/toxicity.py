"""Toxicity: a noisy channel restores disguised words, a classifier scores the restored text.

Viterbi decoding walks the lattice of a token's characters: a digit or sign may stand for a letter, a letter may be
repeated, a separator may have been put between letters. A character language model over all documents weighs the
readings. Words in plain letters have one reading and skip the lattice. Weighed words are sought by the same channel
backwards too: a token or a run of spaced letters counts as a word that the channel turns into it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carry, cut, held, held_out, pick, place_of, ready, table

#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": ""}
SEPARATORS = " .-_*"
#: Log costs of the channel: for a sign that stands for a letter, a repeated letter, a separator.
SIGN, GAP = -1.0, -0.5
#: Log costs of a repeated letter: a token is read under each, since doubled letters are both a disguise and a spelling.
REPEATS = (-1.0, -9.0)
_SPACED = r"(?<![A-Za-z0-9@$!|])[A-Za-z0-9@$!|](?:[ ._*-]{1,2}[A-Za-z0-9@$!|]){3,}(?![A-Za-z0-9@$!|])"
_RUN = r"(?<![A-Za-z0-9@$!|+])[A-Za-z0-9@$!|+](?:[ \t._*-]{1,3}[A-Za-z0-9@$!|+]){2,}(?![A-Za-z0-9@$+])"
_MIXED = r"[A-Za-z0-9@$!|+*]*(?:[A-Za-z](?:[0-9@$|+]|[!*._-]+[A-Za-z0-9@$|])|[0-9@$!|][A-Za-z]|([A-Za-z])\1\1)[A-Za-z0-9@$!|+*._-]*"
#: Spaced letters, and parts of a token that have another reading than their letters. Signs that only end a word disguise nothing.
SPACED, MIXED = re.compile(_SPACED.encode()), re.compile(_MIXED.encode())
#: What every such part holds; most tokens don't.
TRIGGER = re.compile(rb"[0-9@$!|+*_-]|\.[A-Za-z0-9@$|]|([A-Za-z])\1\1")
#: Letters, digits or signs with separators between each two, three at least, and what a plain token holds if a letter may have been repeated.
RUN, DOUBLED = re.compile(_RUN.encode()), re.compile(rb"([a-z])\1", re.I)
PART, JOINT, REPEATED = re.compile(rb"[A-Za-z0-9@$!|+*._\x80-\xff-]+"), re.compile(rb"[._*-]+"), re.compile(rb"(.)\1+", re.S)
#: Each sign as a letter it may stand for, i and l as one, so that words and their disguises have equal keys; separators are deleted.
_KEYS = {**{k: v[0] for k, v in LEET.items() if v}, "l": "i", "L": "i", **{chr(b): chr(b + 32) for b in range(65, 91) if b != 76}}
KEYS, DELETED = bytes(ord(_KEYS.get(chr(b), chr(b))) if b < 128 else b for b in range(256)), b" \t._*-"
#: a-z, and everything else a blank; bytes from 0x80 on stay, as parts of words.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
CODES = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 0 for b in range(256)], np.int32)
#: Labelled rows that training reads at most, and the least weight that counts: words below it say nothing that chance does not.
SAMPLE, LEAST = 20_000, 0.1
#: How sharply weights fall below the z of chance.
SHRINK = 6


def letter_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two, over the whole texts of all documents: 27 x 27 x 27 numbers, 0 being any other byte."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        total = np.zeros(27**3, np.int64)
        for t in batch.column(0).to_pylist():
            c = CODES[np.frombuffer(t or b"", np.uint8)]
            if len(c) > 2:
                total += np.bincount((c[:-2] * 27 + c[1:-1]) * 27 + c[2:], minlength=27**3)
        k = np.nonzero(total)[0]
        return {"code": k.astype(np.int32), "n": total[k]}

    found = arrow_map(pick(docs, "text").select(F.col("text").cast("binary")), rows, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.full(27**3, 0.1)
    for code, n in found:
        counts[code] += n
    counts = counts.reshape(27, 27, 27)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def key(form: bytes) -> bytes:
    return REPEATED.sub(rb"\1", form.translate(KEYS, DELETED))


def disguises(word: bytes) -> re.Pattern[bytes]:
    """All that the channel makes of a word: signs for letters, letters repeated, separators between."""
    out = []
    for m in re.finditer(rb"(.)\1*", word, re.S):
        letters = m[1] + "".join(k for k, v in LEET.items() if m[1].decode("latin-1") in v).encode()
        out.append(b"(?:[%s][ \t._*-]*){%d,}" % (re.escape(letters), len(m[0])))
    return re.compile(b"".join(out), re.I)


class Decoder:
    def __init__(self, model: np.ndarray, lexicon: dict[str, float], bias: float):
        self.model = model.tolist()
        self.weights = {w.encode(): x for w, x in lexicon.items()}
        self.words, self.bias, self.known = self.weights.keys(), bias, {}
        self.keys: dict[bytes, list[bytes]] = {}
        for w in self.words:
            self.keys.setdefault(key(w), []).append(w)
        self.forms: dict[bytes, re.Pattern[bytes]] = {}

    def form(self, word: bytes) -> re.Pattern[bytes]:
        if (x := self.forms.get(word)) is None:
            x = self.forms[word] = disguises(word)
        return x

    def restore(self, token: bytes) -> list[bytes]:
        """The likeliest words of a disguised token, by each cost of repetition. States are the last two letters read; each character moves, repeats or is dropped."""
        plain = token.decode().rstrip(".!-_*+|$")
        return b" ".join(dict.fromkeys(self.read(plain, cost) for cost in REPEATS)).split()

    def restored(self, token: bytes) -> Sequence[bytes]:
        """The words restored from the disguised parts of a token, mostly none; remembered."""
        if (x := self.known.get(token)) is None:
            if len(self.known) > 200_000:
                self.known.clear()
            signs = TRIGGER.search(token)
            x = [w for m in MIXED.finditer(token) for w in self.restore(m[0])] if signs else ()
            if self.keys and (signs or DOUBLED.search(token)):
                x = [*x, *self.disguised(token)]
            self.known[token] = x
        return x

    def disguised(self, token: bytes) -> Sequence[bytes]:
        """The weighed words that the channel turns into a token or a part of it, its last signs read as letters or left out."""
        out = []
        for part in PART.findall(token):
            for form in {part, part.rstrip(b".!-_*+|$"), *JOINT.split(part)}:
                out += [w for w in self.keys.get(key(form), ()) if self.form(w).fullmatch(form)]
        return out

    def spaced(self, run: bytes) -> Sequence[bytes]:
        """The weighed words in a run of spaced letters: anywhere in it, but those of three letters only as all of it, beside an article or pronoun."""
        k, out = key(run), []
        for keyed, words in self.keys.items():
            if keyed in k:
                out += [w for w in words if (self.form(w).search(run) if len(w) > 3 else re.fullmatch(rb"(?:[ai][ \t._*-]+)?" + self.form(w).pattern + rb"(?:[ai])?[!|]?", run, re.I))]
        return out

    def read(self, token: str, repeat: float) -> bytes:
        """The likeliest reading under one cost of repetition, by back-pointers: a node is a letter read and the node before it."""
        model, letter, before = self.model, [""], [0]
        states = {(0, 0): (0.0, 0)}
        for c in token.lower():
            after: dict[tuple[int, int], tuple[float, int, str]] = {}
            letters = c if "a" <= c <= "z" else LEET.get(c, "")
            cost = 0.0 if letters == c else SIGN
            skip = c in SEPARATORS
            for (a, b), (score, node) in states.items():
                if (skip or (not letters and b)) and ((old := after.get((a, b))) is None or score + GAP > old[0]):
                    after[a, b] = (score + GAP, node, "")
                for x in letters:
                    k = ord(x) - 96
                    s = score + cost + model[a][b][k]
                    if (old := after.get((b, k))) is None or s > old[0]:
                        after[b, k] = (s, node, x)
                    s = score + repeat + cost
                    if k == b and ((old := after.get((a, b))) is None or s > old[0]):
                        after[a, b] = (s, node, "")
            if not after:  # nothing can be read here: a word ends
                score, node = max(states.values())
                after = {(0, 0): (score, node, " ")}
            states = {}
            for key_, (score, node, x) in after.items():
                if x:
                    letter.append(x)
                    before.append(node)
                    node = len(letter) - 1
                states[key_] = (score, node)
        _, node = max((score + model[a][b][0], node) for (a, b), (score, node) in states.items())
        out = []
        while node:
            out.append(letter[node])
            node = before[node]
        return "".join(reversed(out)).encode()

    def restored_words(self, text: bytes) -> set[bytes]:
        words = set(text.translate(PLAIN).split())
        tokens = set(text.split())
        if any(len(t) == 1 for t in tokens) or b"." in text or b"_" in text or b"*" in text or b"-" in text:
            for m in SPACED.finditer(text):
                words.update(self.restore(m[0]))
            if self.keys:
                for m in RUN.finditer(text):
                    words.update(self.spaced(m[0]))
        for t in tokens:
            if x := self.restored(t):
                words.update(x)
        return words

    def score(self, text: bytes | None) -> float:
        found = self.restored_words(text) & self.words if text else ()
        x = self.bias + sum(sorted(self.weights[w] for w in found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def decoder(shared: tuple) -> Decoder:
    """One for each worker process and model, with what it remembers."""
    return held(shared, lambda: Decoder(*shared))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], float]:
    """The letter model, the words' weights and the bias. Labels are learned from at most SAMPLE labelled rows outside the held-out
    fold, chosen by the hash of their id; rows without a label, an id or a document don't count. Without any, every score is 0."""
    spark = docs.sparkSession
    ready(spark)
    docs, labels = pick(docs, "doc_id", "text"), pick(labels, "doc_id", "toxic")
    model = letter_model(docs)
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    sample = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = [tuple(r) for r in sample.collect()]
    if not chosen:
        return model, {}, -30.0
    small = spark.createDataFrame(chosen, "id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).join(F.broadcast(small), "id").select("text", "toxic")
    shared = spark.sparkContext.broadcast((model, {}, 0.0))

    def words(batch: pa.RecordBatch) -> dict[str, list]:
        d, out, kind = decoder(shared.value), [], []
        for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = [w.decode("utf-8", "replace") for w in d.restored_words(t or b"") if len(w) > 2]
            out.append(["", *found])
            kind.append(y)
        return {"words": out, "toxic": kind}

    each = arrow_map(texts, words, "words array<string>, toxic int").select(F.explode("words").alias("word"), "toxic")
    counts = cut(each.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")))
    p, n = (counts.where("word = ''").select("p", "n").first() or (0, 0))
    # Every word likelier in toxic rows is weighed: its log ratio of smoothed rates, shrunk as far as its z is what the likeliest of
    # so many words reaches by chance (z^2 of twice the log of their number), whatever the number of labels.
    rate = F.log((F.col("p") + 0.5) / (p + 1.0)) - F.log((F.col("n") + 0.5) / (n + 1.0))
    sure = F.col("p") - F.lit(p / max(1, p + n)) * (F.col("p") + F.col("n"))
    z = sure / F.sqrt((F.col("p") + F.col("n")) * F.lit(max(1e-6, p / max(1, p + n) * (1 - p / max(1, p + n)))))
    named = counts.where("word <> ''")
    chance = 2 * math.log(max(2, named.count()))
    top = named.where("p > 0").select("word", (rate / (1 + F.pow(chance / (z * z), F.lit(SHRINK)))).alias("w"), z.alias("z")).where(F.col("z") > 0).where(F.col("w") >= LEAST).collect()
    lexicon = {r["word"]: float(r["w"]) for r in top}
    return model, lexicon, math.log((p * 0.1 + 0.01) / (n + 1.0))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row's whole text. A null text scores as an empty one: by the bias alone. Rows
    that repeat score alike; a null doc_id is never held out. No other column is an input."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(train(docs, labels))

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        d = decoder(shared.value)
        s = [d.score(t) for t in batch.column(2).to_pylist()]
        return {"doc_id": batch.column(0), "held_out": batch.column(1), "score": s, "predicted": [int(x >= 0.5) for x in s]}

    docs = pick(docs, "doc_id", "text")
    return arrow_map(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary")), rows, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that score below 0.5. Rows with null or empty texts score by the bias alone and stay, unless most of the
    labelled rows are toxic; repeated rows and rows without an id are judged each by its text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = place_of(docs, "text")

    def keep(batches):
        d = decoder(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([d.score(t.encode() if t else None) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return carry(docs, keep)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


