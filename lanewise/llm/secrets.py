"""Secret scans: fixed patterns, and strings in a sensitive context that zstandard, primed with dictionaries of
identifiers and the surrounding text, cannot compress."""

from __future__ import annotations

import itertools
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, carry, pick, place_of, table

KINDS = ("assign", "access", "hex", "novel")
#: Fixed by the query's contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Candidates of the novelty test, and the words that make their surroundings sensitive.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(r"passw|secret|token|api.?key|private.?key|credential|bearer|auth", re.A | re.I)
#: Pieces of a name, and those that can be read: with a vowel and no five consonants in a row.
PIECE, DIGIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+"), re.compile(r"[0-9]")
READABLE = re.compile(r"(?=.*[aeiouy])(?!.*[^aeiouy]{5}).{3,}", re.I)
AROUND = 64
#: Marginal compressed bytes for each character from which a candidate counts as novel.
NOVELTY = 0.55
IDENTIFIERS = "self return import class def function const static public private void string int bool true false null none name value key token secret password passwd api_key apikey access_key client_secret authorization bearer credential username config settings localhost example test http https www com org index content type application json charset utf-8 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789".split()
_PRIMER = zstandard.ZstdCompressionDict("\n".join(IDENTIFIERS).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


_compressors: list[zstandard.ZstdCompressor] = []


def novelty(before: str, candidate: str, after: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, without copies of itself, for each of its characters."""
    if not _compressors:
        _compressors.append(zstandard.ZstdCompressor(level=3, dict_data=_PRIMER, write_content_size=False, write_checksum=False))
    z, around = _compressors[0], (before + after).replace(candidate, " ").encode()
    return (len(z.compress(around + candidate.encode())) - len(z.compress(around))) / len(candidate)


def readable(candidate: str) -> bool:
    """Whether a candidate without digits is mostly made of words: the compressor cannot tell a word it has not seen from a key."""
    pieces = PIECE.findall(candidate)
    return not DIGIT.search(candidate) and sum(len(x) for x in pieces if READABLE.fullmatch(x)) * 10 >= sum(map(len, pieces)) * 6


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed. A null text has none.

    A candidate inside a span of the fixed patterns is not tried; one that a fixed span overlaps in part is. Its surroundings are
    sensitive if one of the words begins or ends within AROUND characters before or after it."""
    if not text:
        return []
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if words := [m.span() for m in SENSITIVE.finditer(text)]:
        ends = [b for _, b in words]
        fixed = sorted(x[1:] for x in spans)
        starts, reach = [a for a, _ in fixed], list(itertools.accumulate((b for _, b in fixed), max))
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            k = bisect_left(ends, a - AROUND)
            if k == len(ends) or words[k][0] > b + AROUND:
                continue
            n = bisect_right(starts, a)
            if (n and reach[n - 1] >= b) or readable(m[0]):
                continue
            if novelty(text[max(0, a - AROUND) : a], m[0], text[b : b + AROUND]) >= NOVELTY:
                spans.append(("novel", a, b))
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def redact(text: str | None) -> str | None:
    """The text with every span, overlapping ones as one, replaced by a mark."""
    out, at, spans = [], 0, scan(text)
    if not spans:
        return text
    for k, (_, a, b) in enumerate(spans):
        if b > at:
            if a >= at or not k:
                out += [text[at:a], "<secret>"]
            at = b
    return "".join(out) + text[at:]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, spans (all, as kind:start:end joined by commas) and base (those of the fixed patterns) of each row's whole text.

    Null and empty texts have none; repeated rows give repeated results; other columns are not read."""

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        found = [scan(t) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "spans": [joined(x) for x in found], "base": [joined([y for y in x if y[0] != "novel"]) for x in found]} | {f"n_{k}": [sum(y[0] == k for y in x) for x in found] for k in KINDS}

    return arrow_map(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, spans string, base string, n_assign long, n_access long, n_hex long, n_novel long")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with each span replaced in text, spans that overlap or touch in part as one, and n_chars as the new text has it where the text
    changed. Null and empty texts stay as they are, and so do all other columns and every row, repeated ones and those without an id."""
    at, size = place_of(docs, "text"), place_of(docs, "n_chars")

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [redact(t) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            if size is not None:
                cols[size] = pa.array([n if a == b else len(b) for n, a, b in zip(cols[size].to_pylist(), old, new, strict=True)], cols[size].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return carry(docs, run)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
