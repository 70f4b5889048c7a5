"""Byte-level BPE by one dynamic program over the prefixes of each pre-token.

Every prefix of a pre-token has exactly one encoding, and so one last token. An automaton that matches suffixes (its states are the
prefixes of tokens, with links to their longest suffixes among them, after Aho and Corasick) lists the tokens that end at each
position; the one whose predecessor (the last token of what remains) is compatible with it is the last token of that prefix.
Back-pointers give the ids.
"""

from __future__ import annotations

import functools
import gc
import json
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, pick, small, table

#: Fixed by the byte-level BPE format: the pre-token pattern of the vocabulary files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
#: A blank inside a run of white space: only there does a piece that begins at a blank depend on its neighbours.
_INNER = regex.compile(r"\s (?!\S)")
#: Bytes that one generation of a worker's memory of pieces holds; two are kept. What an entry takes besides its text and ids, and the
#: longest piece that is remembered.
CACHE, ENTRY, LONGEST = 100_000_000, 200, 1000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a vocabulary file, as the format defines it."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes by id; merges: (left id, right id, merged id) by rank; special: (text, id); key tells vocabularies apart."""

    key: str
    tokens: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    special: list[tuple[str, int]] = field(default_factory=list)


def load(path: str) -> Vocabulary:
    """Read a tokenizer file on the driver."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    letters, ids = byte_letters(), raw["model"]["vocab"]
    special = [(x["content"], x["id"]) for x in raw["added_tokens"]]
    tokens = {i: bytes(letters[c] for c in s) for s, i in ids.items() if i not in dict(map(reversed, special))}
    merges = []
    for m in raw["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((ids[a], ids[b], ids[a + b]))
    return Vocabulary(path, tokens, merges, special)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        self.tokens = v.tokens
        self.size = {i: len(b) for i, b in v.tokens.items()}
        self.by_bytes = {b: i for i, b in v.tokens.items()}
        self.rank = {}  # of the merge that makes a token
        self.pair = {}  # rank of the merge of two tokens
        self.parts = {}
        for r, (a, b, c) in enumerate(v.merges):
            self.pair.setdefault((a, b), r)
            if c not in self.rank:
                self.rank[c], self.parts[c] = r, (a, b)
        self.fits: dict[int, bool] = {}
        self.build([i for i, b in v.tokens.items() if len(b) == 1 or (i in self.parts and self.reachable(i))])
        self.special = sorted(v.special, key=lambda x: -len(x[0]))
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s, _ in self.special) + ")") if self.special else None
        self.special_id = dict(self.special)
        self.out = {i: b for i, b in v.tokens.items()} | {i: s.encode() for s, i in v.special}
        self.table = [self.out.get(i, b"") for i in range(max(self.out) + 1)]
        self.packed = [np.uint32(i).astype("<u4").tobytes() for i in range(len(self.table))]
        self.known, self.old, self.kinds = {s: np.uint32(i).astype("<u4").tobytes() for s, i in v.special}, {}, {}
        self.held = 0

    @functools.cached_property
    def probe(self):
        """The pre-tokenizer of the installed library: it tells the class of code points newer than Python's tables."""
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False)

    def build(self, ids: list[int]) -> None:
        """The automaton: states are prefixes of tokens, step leads from a state and a byte to the next state,
        ends lists the tokens that end in a state, longest first. Only tokens that the merges can produce enter."""
        step, at, edges, level = {}, {0: None}, [], [0]
        for i in ids:
            state = 0
            for x in self.tokens[i]:
                key = state << 8 | x
                if (to := step.get(key)) is None:
                    to = step[key] = len(at)
                    at[to] = None
                    edges.append((state, x, to))
                state = to
            at[state] = (i, len(self.tokens[i]))
        below: dict[int, list[tuple[int, int]]] = {}
        for state, x, to in edges:
            below.setdefault(state, []).append((x, to))
        fail, ends = [0] * len(at), [()] * len(at)
        while level:
            deeper = []
            for state in level:
                for x, to in below.get(state, ()):
                    if state:
                        f = fail[state]
                        while f and f << 8 | x not in step:
                            f = fail[f]
                        fail[to] = step.get(f << 8 | x, 0)
                    ends[to] = ((at[to],) if at[to] else ()) + ends[fail[to]]
                    deeper.append(to)
            level = deeper
        self.step, self.fail, self.ends = step, fail, ends

    def follow(self, state: int, x: int) -> int:
        key, f = state << 8 | x, state
        while f and f << 8 | x not in self.step:
            f = self.fail[f]
        to = self.step[key] = self.step.get(f << 8 | x, 0)
        return to

    def reachable(self, i: int) -> bool:
        """Whether the merges of the token's own bytes end in the token: no other merge may cross the border of its two
        parts before the last one."""
        a, b = self.parts[i]
        return self.survives(a, b, self.rank[i])

    def compatible(self, a: int, b: int) -> bool:
        """Whether a directly before b survives the merges: undo merges on either side of the border, latest first,
        and see that no merge across the border would have come before the one undone."""
        key = a << 32 | b
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        ok = self.fits[key] = self.survives(a, b, 1 << 60)
        return ok

    def survives(self, x: int, y: int, until: int) -> bool:
        """Whether no merge of a rank below until crosses the border between x and y while they are made."""
        rank, pair, parts = self.rank, self.pair, self.parts
        while pair.get((x, y), 1 << 60) >= until:
            rx, ry = rank.get(x, -1), rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                until, x = rx, parts[x][1]
            else:  # of two equal merges the left one comes first, so the right one is undone first
                until, y = ry + 1, parts[y][0]
        return False

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """The dynamic program over pre-tokens in order: the states and last tokens of the prefix that a pre-token
        shares with the one before it are there already."""
        most = max(map(len, words), default=0) + 1
        last, states, size = [0] * most, [0] * most, self.size
        step, follow, ends, known, compatible = self.step.get, self.follow, self.ends, self.fits.get, self.compatible
        before, out = b"", []
        for word in words:
            same = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                same += 1
            state = states[same]
            for at in range(same, len(word)):
                if (to := step(state << 8 | word[at])) is None:
                    to = follow(state, word[at])
                state = states[at + 1] = to
                for i, n in ends[to]:
                    if n > at:
                        last[at + 1] = i
                        break
                    key = last[at + 1 - n] << 32 | i
                    if (ok := known(key)) or (ok is None and compatible(key >> 32, i)):
                        last[at + 1] = i
                        break
            ids, end = [], len(word)
            while end:
                ids.append(i := last[end])
                end -= size[i]
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def kind(self, c: str) -> str:
        """A plain stand-in of the class that the library gives a code point unknown to Python's tables."""
        if (k := self.kinds.get(c)) is None:
            spans = {b for _, b in self.probe.pre_tokenize_str(f"a{c} 1{c} !{c} ")}
            k = self.kinds[c] = "ж" if (0, 2) in spans else "1" if (2, 5) in spans else "!" if (5, 8) in spans else " "
        return k

    def pre_tokens(self, text: str) -> list[str]:
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            plain = "".join(self.kind(c) if unicodedata.category(c) == "Cn" else c for c in text)
            return [text[a:b] for a, b in (m.span() for m in _PRE.finditer(plain))]
        return _PRE.findall(text)

    def pieces(self, text: str | None) -> list[str]:
        """Parts of a text that are encoded by themselves. No pre-token holds a blank but as its first character, so a
        part may begin at any single blank; inside runs of white space the pre-tokens are the parts."""
        if not text:
            return []
        if self.split_special and any(s in text for s, _ in self.special):
            plain = self.split_special.split(text)
            return [p for x in plain if x for p in ([x] if x in self.special_id else self.plain_pieces(x))]
        return self.plain_pieces(text)

    def plain_pieces(self, text: str) -> list[str]:
        if _INNER.search(text):
            return self.pre_tokens(text)
        head, *rest = text.split(" ")
        return [*self.pre_tokens(head), *[" " + x for x in rest]]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of all pieces."""
        if self.held > CACHE:
            self.old, self.known, self.held = self.known, {s: np.uint32(i).astype("<u4").tobytes() for s, i in self.special_id.items()}, 0
        known, old = self.known, self.old
        found = dict(zip(pieces, map(known.get, pieces), strict=True))
        parts, new = {}, {}
        for p, x in found.items():
            if x is None:
                if (x := old.get(p)) is not None:
                    new[p] = found[p] = x
                    continue
                word = p.rstrip(".,")
                if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) and (word.isascii() or unicodedata.category(max(word)) != "Cn"):
                    parts[p] = (word, p[len(word) :]) if word != p else (word,)
                else:
                    parts[p] = self.pre_tokens(p)
        words = sorted({w.encode() for ws in parts.values() for w in ws if w not in known and w not in new})
        packed = self.packed
        for w, ids in zip(words, self.encode_sorted(words), strict=True):
            new[w.decode()] = b"".join([packed[i] for i in ids])
        for p, ws in parts.items():
            if len(ws) != 1:
                new[p] = b"".join([new[w] if w in new else known[w] for w in ws])
            found[p] = new[p] if p in new else known[p]
        for p, x in new.items():
            if len(p) <= LONGEST:
                known[p] = x
                self.held += len(p) + len(x) + ENTRY
        return found

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as packed little-endian unsigned 32-bit integers; a null text has none."""
        lists = [self.pieces(t) for t in texts]
        get = self.learn({p for x in lists for p in x}).__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        table = self.table
        return b"".join([table[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def encoder(vocabulary: Vocabulary) -> Encoder:
    """One for each worker process and vocabulary."""
    return held(f"bpe {vocabulary.key}", lambda: Encoder(vocabulary))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_texts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",), decoded: bool = True) -> DataFrame:
    """The columns of keep, ids (packed little-endian unsigned 32-bit integers) and the decoded text of every row's whole text.

    A null text counts as empty and has no ids. Rows stay as they are: repeated rows give repeated results, other
    columns are not read. The vocabulary is read on the driver from path and broadcast: its size is fixed (under 3 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(path or default_path()))
    n = len(keep)
    rows = small(pick(docs, *keep, "text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:n])

    def run(batches):
        gc.disable()  # the encoder's tables hold no cycles, and walking them takes longer than encoding
        e = encoder(shared.value)
        for batch in batches:
            ids = e.encode_many(batch.column(n).to_pylist())
            out = [*batch.columns[:n], pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array([e.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "ids", *["decoded"] * decoded])

    return rows.mapInArrow(run, f"{kinds}, ids binary" + ", decoded string" * decoded)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id",
        *more,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_texts(table(spark, sf_dir, "documents")))
