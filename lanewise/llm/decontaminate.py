"""Benchmark decontamination by a broadcast set of hashed word windows, with every hit verified byte by byte."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carry, pick, place_of, table, written

#: Words are runs of 0-9, a-z and bytes from 0x80 on, after A-Z became a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WINDOW = 10
#: Test items of more bytes than this in all are dealt over several passes, a job each. An item has at most a window for each two of its bytes, and a
#: window takes 24 bytes and up to 4 of the bit table, so a pass holds at most 16 times as much in the driver and in each worker.
PASS_BYTES = 16_000_000
#: Bytes of a text that are hashed at once.
BLOCK = 1 << 20
#: An odd number has an inverse among the numbers of 64 bits, so the hash of a part follows from those of two prefixes.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def normal(text: bytes | None) -> bytes:
    """The words, a blank between each two."""
    return b" ".join((text or b"").translate(WORDS).split())


def borders(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a normal text begins and ends."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return np.concatenate([[0], blanks + 1]), np.append(blanks, len(words))


def hashes(words: bytes, starts: np.ndarray, ends: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first window's number, hashes) of the windows of n words, block by block."""
    k, most = 0, len(starts) - n + 1
    while k < most:
        until = max(k + 1, min(most, int(np.searchsorted(starts, starts[k] + BLOCK))))
        lo, hi = int(starts[k]), int(ends[until + n - 2])
        power, inverse = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((np.frombuffer(words, np.uint8, hi - lo, lo).astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
        a, b = starts[k:until] - lo, ends[k + n - 1 : until + n - 1] - lo
        h = (sums[b] - sums[a]) * inverse[a]
        h ^= h >> np.uint64(29)
        yield k, h * np.uint64(0xBF58476D1CE4E5B9)
        k = until


class Windows:
    """The windows of the test items by length: hashes in order, each with the place of its words and the items that hold it, and a bit
    table that most document windows miss. Windows of one hash but other words are kept apart by their words."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = [normal(t.encode() if t else None) for _, t in items]
        self.names = sorted({i for i, _ in items})
        at = {x: k for k, x in enumerate(self.names)}
        self.words, base = b"\n".join(texts), 0
        found: dict[int, list] = {}
        for (item, _), t in zip(items, texts, strict=True):
            starts, ends = borders(t)
            if n := min(window, len(starts)):
                for k, h in hashes(t, starts, ends, n):
                    a, b = starts[k : k + len(h)] + base, ends[k + n - 1 : k + n - 1 + len(h)] + base
                    found.setdefault(n, []).append((h, a, b, np.full(len(h), at[item], np.int32)))
            base += len(t) + 1
        self.tables = {}
        self.apart: dict[bytes, set[int]] = {}
        for n, parts in found.items():
            h, a, b, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((own, h))
            h, a, b, own = h[order], a[order], b[order], own[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            head = np.repeat(first, np.diff(np.append(first, len(h))))
            for k in np.flatnonzero(head != np.arange(len(h))).tolist():
                if (w := self.words[a[k] : b[k]]) != self.words[a[head[k]] : b[head[k]]]:
                    self.apart.setdefault(w, set()).add(int(own[k]))
                    own[k] = -1
            bits = max(16, int(len(first) * 16).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[h[first] >> np.uint64(64 - bits)] = True
            self.tables[n] = (seen, np.uint64(64 - bits), h[first], np.append(first, len(h)), a[first], b[first], own)

    def hits(self, text: bytes | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; the words inside hit windows as ascending ranges (first, end exclusive); items."""
        words = normal(text)
        starts, ends = borders(words)
        found, items = [], set()
        for n, (seen, shift, known, at, a, b, own) in self.tables.items():
            for first, h in hashes(words, starts, ends, n):
                maybe = np.flatnonzero(seen[h >> shift])
                if not len(maybe):
                    continue
                place = np.searchsorted(known, h[maybe])
                sure = (place < len(known)) & (known[np.minimum(place, len(known) - 1)] == h[maybe])
                for k, p in zip((maybe[sure] + first).tolist(), place[sure].tolist(), strict=True):
                    w = words[starts[k] : ends[k + n - 1]]
                    if w == self.words[a[p] : b[p]]:
                        items.update(own[at[p] : at[p + 1]].tolist())
                    elif w in self.apart:
                        items |= self.apart[w]
                    else:
                        continue
                    found.append((k, k + n))
        return len(starts), merged(found), {self.names[k] for k in items if k >= 0}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dealt(benchmark: DataFrame, pass_bytes: int) -> tuple[DataFrame, int]:
    """(item, text) of the items, and how many passes it takes for each to hold about pass_bytes of text. A null id counts as empty."""
    benchmark = pick(benchmark, "item_id", "text")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text"), max(1, -(-size // pass_bytes))


def windows_of(items: DataFrame, parts: int, k: int, window: int) -> Broadcast:
    """The windows of the items of pass k, broadcast."""
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else items
    return items.sparkSession.sparkContext.broadcast(Windows([tuple(r) for r in own.collect()], window))


def matched(texts: DataFrame, key: str, shared: Broadcast) -> DataFrame:
    """key, n_words, spans and items of each row of texts (key, text) by one pass."""

    def match(batch: pa.RecordBatch) -> dict[str, list]:
        windows, out = shared.value, {key: batch.column(0), "n_words": [], "spans": [], "items": []}
        for text in batch.column(1).to_pylist():
            n, ranges, own = windows.hits(text)
            out["n_words"].append(n)
            out["spans"].append([x for r in ranges for x in r])
            out["items"].append(sorted(own))
        return out

    return arrow_map(texts.select(key, "text"), match, f"{key} long, n_words long, spans array<int>, items array<string>")


def over_passes(texts: DataFrame, items: DataFrame, parts: int, window: int) -> DataFrame:
    """row, n_words, spans and items of each row of texts (row, text) by all passes, one job after the other: a worker holds one pass's windows
    at a time. Each pass goes over the texts as they are; of rows without a hit only the first pass keeps the number of words."""
    found = []
    for k in range(parts):
        shared = windows_of(items, parts, k, window)
        hit = matched(texts, "row", shared)
        found.append(written(hit if k == 0 else hit.where(F.size("spans") > 0)))
        shared.unpersist()
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)

    def joined(batch: pa.RecordBatch) -> dict[str, list]:
        out = {"row": batch.column(0), "n_words": batch.column(1), "spans": [], "items": []}
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            ranges = merged([r for s in spans for r in zip(s[::2], s[1::2], strict=True)])
            out["spans"].append([x for r in ranges for x in r])
            out["items"].append(sorted({i for x in items for i in x}))
        return out

    by_row = every.groupBy("row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    return arrow_map(by_row, joined, "row long, n_words long, spans array<int>, items array<string>")


def counted(found: DataFrame, *columns: str) -> DataFrame:
    n_hit = F.expr("aggregate(spans, 0L, (s, x) -> x - s)")  # ends less beginnings: an even number of alternating terms
    return found.select(*columns, "n_words", n_hit.alias("n_hit"), "spans", "items")


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (the words inside an occurring window, as first, end, first, end, ...) and items (ids as sorted strings)
    of each row's whole text.

    Null texts have no words; an item without words has no window; an item with a null id counts under the empty string, items that share
    an id count once. Repeated rows give repeated results; an empty table of either kind gives no hits. Other columns are not read.
    The items' windows are broadcast, if their texts come to pass_bytes at most; beyond that the documents are written once with a number
    for each row and go through as many jobs as it takes, each with a bounded part of the items, whose hits are put together by row."""
    found = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    items, parts = dealt(benchmark, pass_bytes)
    if parts == 1:
        return counted(matched(found, "doc_id", windows_of(items, 1, 0, window)), "doc_id")
    rows = written(found.withColumn("row", F.monotonically_increasing_id()))
    return counted(rows.select("row", "doc_id").join(over_passes(rows, items, parts, window), "row"), "doc_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def with_spans(docs: DataFrame, items: DataFrame, parts: int, window: int) -> tuple[DataFrame, list[str]]:
    """docs under plain column names, with spans beside them by all passes, and those names."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    rows = written(docs.toDF(*plain).withColumn("row", F.monotonically_increasing_id()))
    texts = rows.select("row", F.col(plain[place_of(docs, "text")]).cast("binary").alias("text"))
    return rows.join(over_passes(texts, items, parts, window).select("row", "spans"), "row").drop("row"), plain


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no window of an item occurs: rows with null or empty texts stay. The items' size is bounded as
    in report."""
    items, parts = dealt(benchmark, pass_bytes)
    if parts > 1:
        found, plain = with_spans(docs, items, parts, window)
        return found.where(F.size("spans") == 0).select(*plain).toDF(*docs.columns)
    at, shared = place_of(docs, "text"), windows_of(items, 1, 0, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [not shared.value.hits(t.encode() if t else None)[1] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return carry(docs, keep)


def without(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """The text without the words in these ranges, nor what stands between them."""
    if not ranges:
        return text
    raw = (text or "").encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in ranges:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs with the words inside occurring windows cut from text; every row and other column stays as it is. What is cut is found on the text
    as it came, by however many passes, and cut once: a cut neither hides a window nor makes one."""
    items, parts = dealt(benchmark, pass_bytes)
    at = place_of(docs, "text")
    shared = windows_of(items, 1, 0, window) if parts == 1 else None
    found = docs if shared else with_spans(docs, items, parts, window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if shared:
                ranges = [shared.value.hits(t.encode() if t else None)[1] for t in texts]
            else:
                ranges = [list(zip(s[::2], s[1::2], strict=True)) for s in batch.column(batch.num_columns - 1).to_pylist()]
            cols = list(batch.columns)
            cols[at] = pa.array([without(t, r) for t, r in zip(texts, ranges, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return carry(found, run) if shared else carry(found, run).drop("spans").toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
