"""Edit-aware token counts: a segment tree over a document's pre-tokens keeps their characters and tokens; an edit encodes
only the pre-tokens that it touches with their neighbours, and changes the sums on their way to the root."""

from __future__ import annotations

import gc
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import arrow_map, pick, table

#: Parts in a leaf of the tree: a part is a pre-token, or a run of them from one blank to the next.
LEAF = 8


class CountTree:
    """Leaves hold lists of parts and their sums; inner levels hold sums of 16 below, of characters and of tokens.

    parts and packed (their ids, by part) may be given by a caller that has learned many texts at once."""

    WIDTH = 16

    def __init__(self, text: str, encoder: bpe.Encoder, parts: list[str] | None = None, packed: dict[str, bytes] | None = None):
        self.encoder = encoder
        parts = encoder.pieces(text) if parts is None else parts
        packed = encoder.learn(set(parts)) if packed is None else packed
        self.margin = max((len(s) for s, _ in encoder.special), default=0)
        self.encoded = 0
        starts = range(0, len(parts), LEAF)
        self.leaves = [parts[k : k + LEAF] for k in starts] or [[]]
        if parts:
            size = np.fromiter(map(len, map(packed.__getitem__, parts)), np.int64, len(parts)) >> 2
            chars = np.fromiter(map(len, parts), np.int64, len(parts))
            self.sums(np.add.reduceat(chars, starts).tolist(), np.add.reduceat(size, starts).tolist())
        else:
            self.sums([0], [0])

    def sums(self, chars: list[int], tokens: list[int]) -> None:
        """All levels from the sums of the leaves."""
        self.levels, w = [(chars, tokens)], self.WIDTH
        while len(chars) > 1:
            chars, tokens = ([sum(x[k : k + w]) for k in range(0, len(x), w)] for x in (chars, tokens))
            self.levels.append((chars, tokens))

    @property
    def chars(self) -> int:
        return self.levels[-1][0][0]

    @property
    def tokens(self) -> int:
        return self.levels[-1][1][0]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character, and the character's place in it; the last leaf for the end."""
        k = 0
        for chars, _ in reversed(self.levels[:-1]):
            k *= self.WIDTH
            while k + 1 < len(chars) and at >= chars[k]:
                at -= chars[k]
                k += 1
        return k, at

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters from start to end. The region grows leaf by leaf until its borders hold and a special token's length lies
        between them and the edit: then what lies beyond cannot change. The left border holds when two characters after it stay, since a
        border inside white space has but one blank after it; the right one when the last part begins where it did."""
        (a, left), (b, right) = self.find(start), self.find(end)
        chars = self.levels[0][0]
        left, right = left + sum(chars[max(0, a - 1) : a]), right + sum(chars[max(0, a - 1) : b])
        a, b = max(0, a - 1), min(len(chars) - 1, b + 1)
        while True:
            old = [w for leaf in self.leaves[a : b + 1] for w in leaf]
            joined = "".join(old)
            new = self.encoder.pieces(joined[:left] + text + joined[right:])
            up = a > 0 and left < max(2, self.margin)
            down = b + 1 < len(chars) and not (old and len(joined) - right >= max(len(old[-1]), self.margin) and steady(old[-1]) and parted(new, len(old[-1])))
            if not up and not down:
                break
            if up:
                a -= 1
                left, right = left + chars[a], right + chars[a]
            b += down
        self.encoded += sum(map(len, new))
        self.put(a, b + 1, new)

    def put(self, a: int, b: int, new: list[str]) -> None:
        """The parts of the leaves from a to b, b exclusive. They keep these leaves while none grows beyond twice its size; else the leaves
        split, and the sums right of them are added anew, without a text being read again."""
        found = self.encoder.learn(set(new))
        n = b - a if len(new) <= 2 * LEAF * (b - a) else -(-len(new) // LEAF)
        q, r = divmod(len(new), n)
        cuts = [k * q + min(k, r) for k in range(n + 1)]
        parts = [new[x:y] for x, y in itertools.pairwise(cuts)]
        chars = [sum(map(len, x)) for x in parts]
        tokens = [sum(len(found[w]) for w in x) // 4 for x in parts]
        if n == b - a:
            for k, (leaf, c, t) in enumerate(zip(parts, chars, tokens, strict=True), a):
                self.leaves[k] = leaf
                self.change(k, c, t)
        else:
            self.leaves[a:b] = parts
            self.grow(a, b, chars, tokens)

    def grow(self, a: int, b: int, chars: list[int], tokens: list[int]) -> None:
        """Other sums, more or fewer, for the leaves from a to b, b exclusive: sums left of them stay as they are."""
        (c, t), w = self.levels[0], self.WIDTH
        c[a:b], t[a:b] = chars, tokens
        self.sums_from(a // w)

    def sums_from(self, k: int) -> None:
        """Add up again from node k of the first inner level on: what lies left of it is unchanged."""
        w = self.WIDTH
        for low, (c, t) in zip(self.levels, self.levels[1:], strict=False):
            n = -(-len(low[0]) // w)
            for x, y in zip(low, (c, t), strict=True):
                y[k:] = [sum(x[j * w : j * w + w]) for j in range(k, n)]
            k //= w
        while len(self.levels[-1][0]) > 1:
            self.levels.append(tuple([sum(x[j : j + w]) for j in range(0, len(x), w)] for x in self.levels[-1]))

    def change(self, k: int, chars: int, tokens: int) -> None:
        dc, dt = chars - self.levels[0][0][k], tokens - self.levels[0][1][k]
        for c, t in self.levels:
            c[k] += dc
            t[k] += dt
            k //= self.WIDTH


def steady(part: str) -> bool:
    """Whether what follows a part at a border does not change it when the text before the border does: white space looks ahead."""
    return not part[-1].isspace()


def parted(parts: list[str], n: int) -> bool:
    """Whether a part begins n characters before the end."""
    for w in reversed(parts):
        if n <= 0:
            break
        n -= len(w)
    return n == 0


def counts_after(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, encoded_chars (characters encoded again) of each row's whole text.

    The edits column of docs (array of {start, end, text} in code points, applied in order, places cut to the text's length) says what
    changes. Null texts are empty, null edits none; a place that is null or outside the text counts as the nearest one in it, a null text
    of an edit as empty, and an end before the start as the start. Repeated rows give repeated results, other columns are not read."""
    docs = pick(docs, "doc_id", "text", "edits")
    shared = docs.sparkSession.sparkContext.broadcast(bpe.load(path or bpe.default_path()))

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        gc.disable()  # trees and tables hold no cycles, and walking them takes longer than counting
        e = bpe.encoder(shared.value)
        out: dict[str, list] = {"doc_id": batch.column(0), "n_tokens": [], "n_tokens_edited": [], "n_chars_edited": [], "encoded_chars": []}
        texts = [x or "" for x in batch.column(1).to_pylist()]
        lists = [e.pieces(x) for x in texts]
        packed = e.learn({w for x in lists for w in x})
        for text, parts, changes in zip(texts, lists, batch.column(2).to_pylist(), strict=True):
            tree = CountTree(text, e, parts, packed)
            out["n_tokens"].append(tree.tokens)
            for c in changes or ():
                start = max(0, min(c["start"] or 0, tree.chars))
                tree.edit(start, max(start, min(c["end"] or 0, tree.chars)), c["text"] or "")
            out["n_tokens_edited"].append(tree.tokens)
            out["n_chars_edited"].append(tree.chars)
            out["encoded_chars"].append(tree.encoded)
        return out

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text", "edits"), rows, "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, encoded_chars long")


def op7_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with three edits: a word replaced after a third, a line put in after half, five characters cut from the start."""
    docs = table(spark, sf_dir, "documents")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("text"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return counts_after(docs.withColumn("edits", F.array(edit(third, third + 8, " edited 42!"), edit(half, half, "\n\n  a new line\n"), edit(F.lit(0), F.lit(5), ""))))
