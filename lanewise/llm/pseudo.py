"""Masked pseudo-likelihood: every word is predicted from the words on both sides, and a document's score is the sum of the conditional
log-probabilities of its words.

The network reads two words on either side. It knows the most frequent words of the corpus by themselves; any other word is the
network's rare word times its spelling under a letter model, so that every word has a probability and no two share one by being
thrown together. The softmax is a binary tree in which frequent words lie near the root. It is trained in numpy on every window of the
corpus: each task trains a copy on its documents, and the copies are averaged row by row, weighed by how often each was trained.

Beside it stands a memory of all windows of the corpus, which grows with the corpus: a word seen n times between the same four
neighbours, m times any word, has the probability (n - 1 + P) / (m - 1 + 1), P being the network's; the occurrence that is scored does
not count itself. The windows are dealt by their context as packed arrays of 14 bytes each, counted in numpy, and what they change is
dealt back to the documents. A window that very many documents of a task share is dealt once for all of them.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, held, partitions, pick, ready, small, table
from .simhash import LOWER

#: Words that the network knows by themselves, its width, and windows scored and trained at once.
KNOWN, WIDTH, CHUNK, STEP = 20_000, 8, 1 << 12, 1 << 11
RATE, SEED = 0.3, 7
#: Numbers of the rare word and of what lies outside a text; known words follow.
RARE, OUTSIDE = 0, 1
SIDES = (-2, -1, 1, 2)
#: Letters of the spelling model: the end of a word, a to z, any of the other bytes.
LETTERS, OTHERS = 28, 224
_LETTER = np.array([0 if b in b" \t\n\x0b\x0c\r" else b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 for b in range(256)], np.int32)
#: Windows that a task gathers before it deals them, documents at most among them, and copies of a window from which it is dealt once.
GATHERED, MOST_DOCS, SHARED = 1 << 19, 1 << 15, 64
#: A window: 48 bits of its context and 16 of its word, the document's place, the network's log-probability. A change of a document's sum.
ENTRY = np.dtype([("key", "<u8"), ("doc", "<u2"), ("p", "<f4")])
CHANGE = np.dtype([("row", "<i8"), ("by", "<f4")])
#: Kinds of rows between the stages.
WINDOWS, SHARED_WINDOWS, MEMBERS, TOTALS, CHANGES, REPLIES = range(6)
_ROWS = "part int, kind int, key long, doc_id long, n long, value double, blob binary"
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def spelling_counts(words: dict[bytes, int]) -> np.ndarray:
    """How often each letter follows two others in these words, which occur so many times; before a word's first letter there is nothing."""
    if not words:
        return np.zeros(LETTERS**3, np.int64)
    c = np.concatenate([[0, 0], _LETTER[np.frombuffer(b"\n".join([*words, b""]), np.uint8)]])
    a, b, c = np.where(c[1:-1] == 0, 0, c[:-2]), c[1:-1], c[2:]
    n = np.fromiter(words.values(), np.int64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    return np.bincount((a * LETTERS + b) * LETTERS + c, np.repeat(n, sizes), LETTERS**3).astype(np.int64)


def spelling(counts: np.ndarray) -> np.ndarray:
    n = counts.reshape(LETTERS, LETTERS, LETTERS) + 0.1
    p = np.log(n / n.sum(axis=2, keepdims=True))
    p[:, :, 27] -= np.log(OTHERS)
    return p


def placed(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, int, np.ndarray]:
    """The words of all texts, their places with two free ones before and after each text, how many places there are, and words by text."""
    lists = [words_of(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    every = [w for x in lists for w in x]
    return every, 2 + np.arange(len(every)) + 2 * np.repeat(np.arange(len(lists)), sizes), len(every) + 2 * len(lists) + 2, sizes


class Lexicon:
    """What a worker knows of words: the network's number, a hash, and the log-probability of the spelling for rare words."""

    MOST = 400_000

    def __init__(self, known: list[bytes], letters: np.ndarray):
        self.known, self.letters = known, letters
        self.first = dict(zip(known, range(2, 2 + len(known)), strict=True))
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {}
        self.numbers, self.hashes, self.spelt = np.zeros(0, np.uint16), np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.add(self.known, range(2, 2 + len(self.known)))

    def add(self, words, numbers=None) -> None:
        words = list(words)
        self.of.update(zip(words, range(len(self.of), len(self.of) + len(words)), strict=True))
        self.numbers = np.append(self.numbers, np.fromiter(numbers, np.uint16, len(words)) if numbers is not None else np.zeros(len(words), np.uint16))
        self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) | np.uint64(1))
        self.spelt = np.append(self.spelt, np.zeros(len(words), np.float32) if numbers is not None else self.spell(words))

    def spell(self, words: list[bytes]) -> np.ndarray:
        """The log-probability of each word's letters and its end."""
        c = np.concatenate([[0, 0], _LETTER[np.frombuffer(b"\n".join([*words, b""]), np.uint8)]])
        each = self.letters[np.where(c[1:-1] == 0, 0, c[:-2]), c[1:-1], c[2:]]
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(each, np.append(0, ends[:-1])).astype(np.float32)

    def plain(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The network's numbers of all words, with two places outside before and after each text, and where the words are."""
        every, at, size, _ = placed(texts)
        numbers = np.full(size, OUTSIDE, np.uint16)
        numbers[at] = np.fromiter(map(self.first.get, every, itertools.repeat(RARE)), np.uint16, len(every))
        return numbers, at

    def windows(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words of the texts with two places outside before and after each text, -1 there; where the words are; how many each has."""
        every, at, size, sizes = placed(texts)
        if len(self.of) > self.MOST:
            self.clear()
        found = np.fromiter(map(self.of.get, every, itertools.repeat(-1)), np.int64, len(every))
        if len(new := np.flatnonzero(found < 0)):
            self.add(dict.fromkeys(every[k] for k in new.tolist()))
            found[new] = [self.of[every[k]] for k in new.tolist()]
        flat = np.full(size, -1, np.int64)
        flat[at] = found
        return flat, at, sizes

    def looked(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The network's numbers and the hashes of words and of places outside."""
        numbers, hashes = np.append(self.numbers, np.uint16(OUTSIDE)), np.append(self.hashes, np.uint64(0))
        return numbers[flat], hashes[flat]


class Network:
    """Embeddings of the neighbours, weighed by side, a hidden layer, and a binary tree of logistic units over the known and the rare word."""

    def __init__(self, counts: np.ndarray, seed: int = SEED):
        """counts: of the rare word, of nothing, of the known words."""
        self.size = len(counts)
        g = np.random.default_rng(seed)
        self.embed = g.normal(0, 0.3, (self.size, WIDTH)).astype(np.float32)
        self.side = np.full((len(SIDES), WIDTH), 0.5, np.float32) + g.normal(0, 0.1, (len(SIDES), WIDTH)).astype(np.float32)
        self.plant(counts)
        self.units = np.zeros((len(self.odds), WIDTH), np.float32)

    def plant(self, counts: np.ndarray) -> None:
        """The tree by Huffman's rule: paths from the root, as units and turns (1 or -1), for each word. A unit's odds are those of the words
        below it, until it is trained."""
        heap = [(int(n) + 1, k, k) for k, n in enumerate(counts) if k != OUTSIDE]
        heapq.heapify(heap)
        below, mass, at = {}, {}, self.size
        while len(heap) > 1:
            (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
            below[at], mass[at] = (x, y), (a, b)
            heapq.heappush(heap, (a + b, at, at))
            at += 1
        self.odds = np.zeros(max(1, self.size - 2), np.float32)
        paths: dict[int, tuple[list[int], list[int]]] = {}
        stack = [(heap[0][2], [], [])]
        while stack:
            x, units, turns = stack.pop()
            if x < self.size:
                paths[x] = (units, turns)
                continue
            unit, (a, b) = x - self.size, mass[x]
            self.odds[unit] = np.log(a / b)
            stack += [(below[x][0], [*units, unit], [*turns, 1]), (below[x][1], [*units, unit], [*turns, -1])]
        each = [paths.get(k, ([], [])) for k in range(self.size)]
        self.depth = np.array([len(u) for u, _ in each])
        self.start = np.concatenate([[0], np.cumsum(self.depth)[:-1]])
        self.path = np.array([x for u, _ in each for x in u], np.uint16)
        self.turn = np.array([x for _, t in each for x in t], np.float32)

    def steps(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The path entries of the words one after the other, which word each is of, and where each word's begin."""
        depth = self.depth.take(words)
        ends = np.cumsum(depth)
        first = ends - depth
        word = np.repeat(np.arange(len(words)), depth)
        return (self.start.take(words) - first).take(word) + np.arange(ends[-1]), word, first

    def log_probabilities(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the words at these places given those on both sides."""
        out = np.zeros(len(at), np.float32)
        if self.size < 3:
            return out
        for k in range(0, len(at), CHUNK):
            own = at[k : k + CHUNK]
            _, h = hidden(self.embed, self.side, numbers, own)
            entry, word, first = self.steps(numbers.take(own))
            unit = self.path.take(entry)
            z = np.einsum("mw,mw->m", self.units.take(unit, 0), h.take(word, 0))
            z += self.odds.take(unit)
            z *= -self.turn.take(entry)
            out[k : k + CHUNK] = -np.add.reduceat(np.log1p(np.exp(np.minimum(z, 80, out=z))), first)
        return out

    def learner(self) -> Learner:
        return Learner(self)


def hidden(embed: np.ndarray, side: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The numbers of the neighbours by side, and the hidden layer."""
    near = [numbers.take(at + k) for k in SIDES]
    x = sum(embed.take(n, 0) * w for n, w in zip(near, side, strict=True))
    return near, np.tanh(x, out=x)


class Learner:
    """Gradient steps on a copy of a network, with a step size for each row that falls with what the row has been moved."""

    def __init__(self, net: Network):
        self.net, self.side = net, net.side
        self.embed, self.units, self.odds = net.embed.copy(), net.units.copy(), net.odds.copy()
        self.moved = [np.full(len(x), 1e-2, np.float32) for x in (self.embed, self.units)]
        self.seen = [np.zeros(len(x), np.float32) for x in (self.embed, self.units)]

    def rates(self, which: int, rows: np.ndarray, n: np.ndarray, squares: np.ndarray) -> np.ndarray:
        self.seen[which][rows] += n
        self.moved[which][rows] += squares
        return RATE / np.sqrt(self.moved[which].take(rows))

    def learn(self, numbers: np.ndarray, at: np.ndarray) -> None:
        net = self.net
        if net.size < 3:
            return
        for k in range(0, len(at), STEP):
            own = at[k : k + STEP]
            near, h = hidden(self.embed, self.side, numbers, own)
            entry, word, first = net.steps(numbers.take(own))
            unit, turn = net.path.take(entry), net.turn.take(entry)
            each, u = h.take(word, 0), self.units.take(unit, 0)
            z = np.einsum("mw,mw->m", u, each)
            z += self.odds.take(unit)
            z *= turn
            off = turn / (1 + np.exp(np.clip(z, -30, 30, out=z)))
            u *= off[:, None]
            back = np.add.reduceat(u, first, axis=0)
            back *= 1 - h * h
            each *= off[:, None]
            order, rows, first, n = grouped(unit)
            sums, odds = np.add.reduceat(each.take(order, 0), first, axis=0), np.add.reduceat(off.take(order), first)
            rate = self.rates(1, rows, n, (np.einsum("nw,nw->n", sums, sums) + odds * odds) / (WIDTH + 1))
            self.units[rows] += rate[:, None] * sums
            self.odds[rows] += rate * odds
            order, rows, first, n = grouped(np.concatenate(near))
            sums = np.add.reduceat(np.concatenate([back * w for w in self.side]).take(order, 0), first, axis=0)
            self.embed[rows] += self.rates(0, rows, n, np.einsum("nw,nw->n", sums, sums) / WIDTH)[:, None] * sums


def grouped(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the entries by row, the rows, where each begins in that order, and how many entries it has."""
    order = np.argsort(rows, kind="stable")
    rows = rows.take(order)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return order, rows.take(first), first, np.diff(np.append(first, len(rows)))


def lexicon(shared) -> Lexicon:
    """One for each worker process and corpus."""
    return held(shared.value, lambda: Lexicon(*shared.value[:2]))


def counted(docs: DataFrame) -> tuple[list[bytes], np.ndarray, np.ndarray, int]:
    """The known words, most frequent first, ties by bytes; counts of the network's words; spelling counts; words in all. Counts cover every
    document; a task's different words are dealt by hash in packed lists. Known are the words that occur more than once, from the most
    frequent on in steps of a sixteenth of a doubling, as long as they are at most KNOWN; they and 28^3 spelling counts come to the driver."""
    parts = partitions(docs)

    def count(batches):
        words: Counter[bytes] = Counter()
        letters = np.zeros(LETTERS**3 + 1, np.int64)

        def flush():
            if not words:
                return
            letters[:-1] += spelling_counts(words)
            letters[-1] += words.total()
            each, n = list(words), np.fromiter(words.values(), np.int64, len(words))
            words.clear()
            part = np.fromiter(map(zlib.crc32, each), np.int64, len(each)) % parts
            order = np.argsort(part, kind="stable")
            part, n = part[order], n[order]
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            ends = np.append(first[1:], len(part))
            lists = [zstandard.compress(b"\n".join([each[k] for k in order[a:b].tolist()]), 1) for a, b in zip(first, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[first], pa.int32()), pa.array(lists, pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["part", "words", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words.update(words_of(t))
            if len(words) > 500_000:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([letters.tobytes()], pa.binary())], names=["part", "words", "n"])

    def add(batches):
        total: dict[bytes, int] = {}
        letters = np.zeros(LETTERS**3 + 1, np.int64)
        for batch in batches:
            for words, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if words is None:
                    letters += np.frombuffer(n, np.int64)
                    continue
                for w, k in zip(zstandard.decompress(words).split(b"\n"), np.frombuffer(n, np.int64).tolist(), strict=True):
                    total[w] = total.get(w, 0) + k
        found = [(w, n) for w, n in total.items() if n > 1]
        used = np.flatnonzero(letters)
        keys = [w for w, _ in found] + [int(k).to_bytes(4, "big") for k in used]
        yield pa.RecordBatch.from_arrays([pa.array([0] * len(found) + [1] * len(used), pa.int32()), pa.array(keys, pa.binary()), pa.array([n for _, n in found] + letters[used].tolist(), pa.int64())], names=["kind", "key", "n"])

    dealt_ = small(pick(docs, "text").select(F.col("text").cast("binary"))).mapInArrow(count, "part int, words binary, n binary")
    found = cut(dealt_.repartition(parts, "part").mapInArrow(add, "kind int, key binary, n long"))
    letters = np.zeros(LETTERS**3 + 1)
    for _, key, n in found.where("kind = 1").collect():
        letters[int.from_bytes(key, "big")] = n
    total = int(letters[-1])
    step, have, least = F.floor(F.log2("n") * 16), 0, None
    for s, n in found.where("kind = 0").groupBy(step.alias("step")).agg(F.count("*")).orderBy(F.desc("step")).collect():
        if (have := have + n) > KNOWN:
            break
        least = s
    words = [] if least is None else [(bytes(r["key"]), r["n"]) for r in found.where(F.col("kind") == 0).where(step >= least).collect()]
    words.sort(key=lambda x: (-x[1], x[0]))
    forget(found)
    return [w for w, _ in words], np.array([total - sum(n for _, n in words), 0, *(n for _, n in words)]), letters[:-1], total


#: Rows of a network's matrix that are averaged together.
BLOCK = 1024


def trained(docs: DataFrame, words, counts: np.ndarray) -> Network:
    """The network after one pass over every document. Each task's copy is summed with the others' block by block, weighed by row; the sums,
    whose size the number of known words bounds, come to the driver."""
    net = Network(counts)
    shared = docs.sparkSession.sparkContext.broadcast((*words, net))

    def run(batches):
        learner, lex = shared.value[2].learner(), lexicon(shared)
        for batch in batches:
            learner.learn(*lex.plain(batch.column(0).to_pylist()))
        units = np.concatenate([learner.units, learner.odds[:, None]], axis=1)
        for which, (rows, seen) in enumerate(zip((learner.embed, units), learner.seen, strict=True)):
            for k in range(0, len(rows), BLOCK):
                n = seen[k : k + BLOCK, None]
                if n.any():
                    yield pa.RecordBatch.from_arrays([pa.array([which << 20 | k // BLOCK], pa.int32()), pa.array([np.concatenate([rows[k : k + BLOCK] * n, n], axis=1).astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, "<f4").astype(np.float64)
                sums[block] = sums[block] + x if block in sums else x
        for block, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "sums"])

    parts = small(pick(docs, "text").select(F.col("text").cast("binary"))).mapInArrow(run, "block int, sums binary")
    units = np.concatenate([net.units, net.odds[:, None]], axis=1)
    for block, sums in parts.repartition("block").mapInArrow(add, "block int, sums binary").collect():
        rows = (net.embed, units)[block >> 20]
        x = np.frombuffer(sums).reshape(-1, rows.shape[1] + 1)
        k = (block & (1 << 20) - 1) * BLOCK
        moved = x[:, -1] > 0
        rows[k : k + len(x)][moved] = (x[moved, :-1] / x[moved, -1:]).astype(np.float32)
    net.units, net.odds = units[:, :WIDTH].copy(), units[:, WIDTH].copy()
    return net


def keys_of(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """48 bits of the two words on either side, then 16 of the word between them."""
    h = np.zeros(len(at), np.uint64)
    for k, side in enumerate(SIDES):
        h ^= hashes.take(at + side) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    return h & np.uint64(0xFFFFFFFFFFFF0000) | hashes.take(at) >> np.uint64(48)


def part_of(rows: np.ndarray, parts: int) -> np.ndarray:
    return ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def packed(entries: np.ndarray) -> bytes:
    """Entries byte by byte in planes, compressed: of keys in order the first bytes take next to nothing."""
    return zstandard.compress(entries.view(np.uint8).reshape(len(entries), -1).T.tobytes(), 1)


def unpacked(blob: bytes, kind: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def batch_of(**columns) -> pa.RecordBatch:
    n = max(len(x) for x in columns.values())
    names = [x.split()[0] for x in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, t in zip(names, _TYPES, strict=True)], names=names)


def sliced(part: np.ndarray, kind: int, entries: np.ndarray, key: int | None = None) -> pa.RecordBatch:
    """One row for each part, with the part's entries; parts ascend."""
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    ends = np.append(first[1:], len(part))
    return batch_of(part=part[first], kind=[kind] * len(first), key=[key] * len(first), blob=[packed(entries[a:b]) for a, b in zip(first, ends, strict=True)])


class Gatherer:
    """The windows of a task's documents until they are dealt."""

    def __init__(self, parts: int, base: int):
        self.parts, self.next = parts, base
        self.clear()

    def clear(self) -> None:
        self.first, self.held, self.size = self.next, [], 0

    def full(self, docs: int, words: int) -> bool:
        return self.size and (self.size + words > GATHERED or self.next - self.first + docs > MOST_DOCS)

    def add(self, key: np.ndarray, doc: np.ndarray, p: np.ndarray, docs: int) -> None:
        self.held.append((key, (doc + (self.next - self.first)).astype(np.uint16), p))
        self.next += docs
        self.size += len(key)

    def deal(self) -> Iterator[pa.RecordBatch]:
        """Windows by context; those that many of these documents share once, with the list of the documents dealt apart."""
        if self.size:
            key, doc, p = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held.clear()
            order = np.argsort(key)
            e = np.empty(len(key), ENTRY)
            e["key"], e["doc"], e["p"] = key[order], doc[order], p[order]
            key = e["key"]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.diff(np.append(first, len(key)))
            part = ((key >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int32)
            alone = np.repeat(n < SHARED, n)
            if alone.any():
                yield sliced(part[alone], WINDOWS, e[alone], self.first)
            for k, size in zip(first[n >= SHARED].tolist(), n[n >= SHARED].tolist(), strict=True):
                name = self.first << 21 | k
                yield batch_of(part=[part[k]], kind=[SHARED_WINDOWS], key=[name], n=[size], blob=[packed(e[k : k + 1])])
                docs, times = np.unique(e["doc"][k : k + size], return_counts=True)
                members = np.zeros(len(docs), CHANGE)
                members["row"], members["by"] = docs.astype(np.int64) + self.first, times
                yield batch_of(part=[name % self.parts], kind=[MEMBERS], key=[name], blob=[packed(members)])
        self.clear()


def dealt(docs: DataFrame, words, net: Network, parts: int) -> DataFrame:
    """Each document's sum under the network alone, and all windows of all documents, by part."""
    shared = docs.sparkSession.sparkContext.broadcast((*words, net))

    def run(batches):
        lex, net = lexicon(shared), shared.value[2]
        gathered = Gatherer(parts, TaskContext.get().partitionId() << 33)
        for batch in batches:
            flat, at, sizes = lex.windows(batch.column(1).to_pylist())
            numbers, hashes = lex.looked(flat)
            # As the windows carry it, so that what they change fits what is summed here. A word of very many letters has a log-probability far
            # below what half a float's bits hold.
            p = net.log_probabilities(numbers, at) + lex.spelt[flat[at]]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            if gathered.full(len(sizes), len(at)):
                yield from gathered.deal()
            rows = gathered.next + np.arange(len(sizes))
            gathered.add(keys_of(hashes, at), doc, p, len(sizes))
            yield batch_of(part=part_of(rows, parts), kind=[TOTALS] * len(rows), key=rows, doc_id=batch.column(0), n=sizes, value=np.bincount(doc, p.astype(np.float64), len(sizes)))
        yield from gathered.deal()

    return small(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))).mapInArrow(run, _ROWS)


def changes(key: np.ndarray, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By how much the memory changes each window's log-probability, and which windows it does, from keys (48 bits of context, 16 of the
    word) in order, how often each entry stands, and the network's log-probabilities. All in logarithms: the probability itself may be less
    than any float."""
    total = np.concatenate([[0], np.cumsum(n)])

    def sums(x: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        ends = np.append(first[1:], len(x))
        return np.repeat(total[ends] - total[first], ends - first)

    same, near = sums(key), sums(key >> np.uint64(16))
    again = near > 1
    p, others = p[again].astype(np.float64), np.full(int(again.sum()), -np.inf)
    np.log(same[again] - 1, out=others, where=same[again] > 1)
    return np.logaddexp(others, p) - np.log(near[again]) - p, again


def remembered(windows: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Windows that recur, as changes of documents' sums, part by part; totals and members as they are."""

    def resolved(entries: list, docs: list, shared: list) -> Iterator[pa.RecordBatch]:
        alone = sum(map(len, entries))
        e = np.concatenate([*entries, *(x[0] for x in shared)])
        row = np.concatenate([*docs, np.array([x[1] for x in shared], np.int64)])
        row[:alone] += e["doc"][:alone]
        n = np.ones(len(e), np.int64)
        n[alone:] = [x[2] for x in shared]
        order = np.argsort(e["key"])
        by, again = changes(e["key"][order], n[order], e["p"][order])
        at = order[again]
        of_all = at >= alone
        if of_all.any():
            names = row[at[of_all]]
            yield batch_of(part=names % parts, kind=[REPLIES] * len(names), key=names, value=by[of_all])
        rows, place = np.unique(row[at[~of_all]], return_inverse=True)
        if len(rows):
            yield changed(rows, np.bincount(place, by[~of_all]), parts)

    def run(batches):
        held("windows", lambda: None)  # drops what the stage before held in this process
        now, entries, docs, shared = None, [], [], []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            if (rest := (kinds == TOTALS) | (kinds == MEMBERS)).any():
                yield batch.filter(pa.array(rest))
            for part, kind, key, n, blob in zip(batch.column(0).to_pylist(), kinds.tolist(), *(batch.column(k).to_pylist() for k in (2, 4, 6)), strict=True):
                if part != now:
                    if entries or shared:
                        yield from resolved(entries, docs, shared)
                    now, entries, docs, shared = part, [], [], []
                if kind == WINDOWS:
                    entries.append(unpacked(blob, ENTRY))
                    docs.append(np.full(len(entries[-1]), key, np.int64))
                elif kind == SHARED_WINDOWS:
                    shared.append((unpacked(blob, ENTRY), key, n))
        if entries or shared:
            yield from resolved(entries, docs, shared)

    return windows.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, _ROWS)


def changed(rows: np.ndarray, by: np.ndarray, parts: int) -> pa.RecordBatch:
    """Changes by row, ascending, as they are dealt to the rows' parts."""
    part = part_of(rows, parts)
    order = np.argsort(part, kind="stable")
    out = np.zeros(len(rows), CHANGE)
    out["row"], out["by"] = rows[order], by[order]
    return sliced(part[order], CHANGES, out)


def settled(found: DataFrame, parts: int, tasks: int) -> DataFrame:
    """Totals with the changes of their rows added; windows that many documents share as changes for each of these."""

    def run(batches):
        totals, each, members, replies = [], [], [], {}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            if (own := kinds == TOTALS).any():
                totals.append(batch.filter(pa.array(own)))
            for kind, key, value, blob in zip(kinds.tolist(), *(batch.column(k).to_pylist() for k in (2, 5, 6)), strict=True):
                if kind == CHANGES:
                    each.append(unpacked(blob, CHANGE))
                elif kind == MEMBERS:
                    members.append((key, blob))
                elif kind == REPLIES:
                    replies[key] = value
        shared = [(unpacked(blob, CHANGE), replies[key]) for key, blob in members if key in replies]
        if shared:
            rows, place = np.unique(np.concatenate([m["row"] for m, _ in shared]), return_inverse=True)
            yield changed(rows, np.bincount(place, np.concatenate([m["by"] * v for m, v in shared])), parts)
        if totals:
            t = pa.Table.from_batches(totals).sort_by("key").combine_chunks()
            sums = t["value"].to_numpy().copy()
            if each:
                c = np.concatenate(each)
                sums += np.bincount(np.searchsorted(t["key"].to_numpy(), c["row"]), c["by"], len(sums))
            yield from t.set_column(5, "value", pa.array(sums)).to_batches()

    return found.repartition(tasks, "part").mapInArrow(run, _ROWS)


def pseudo_scores(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words), score (sum of the conditional log-probabilities) and mean_score of each row's whole text. A text without words,
    or a null one, has 0 tokens, score 0 and mean 0. Repeated rows count each time, in training and in the memory too, and score alike but
    for rounding; an empty table has no scores. Other columns are not read."""
    spark = docs.sparkSession
    ready(spark)
    known, counts, letters, _ = counted(docs)
    words = (known, spelling(letters))
    net = trained(docs, words, counts)
    tasks = partitions(docs)
    parts = 4 * tasks  # more parts than tasks: they are dealt by hash, and a task takes one at a time
    # Windows go to their context's part, changes to their documents', those of shared windows once more. Between the last two little is left.
    sums = settled(settled(remembered(dealt(docs, words, net, parts), parts, tasks), parts, tasks), parts, tasks)
    score = F.col("value").alias("score")
    return sums.where(F.col("kind") == TOTALS).select("doc_id", F.col("n").alias("n_tokens"), score, (F.col("value") / F.greatest(F.col("n"), F.lit(1))).alias("mean_score"))


def op3_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_scores(table(spark, sf_dir, "documents"))
