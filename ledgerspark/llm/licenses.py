"""License scans: exact phrases, and short notices with a bounded number of edits.

Texts are reduced to their lower-cased words with one space between. A notice
that may have k edits is split into k + 1 pieces; by the pigeonhole principle
every match holds at least one piece unchanged, so exact search for the pieces
finds every candidate. The regex library then matches the notice around each
candidate with at most k errors and gives span and number of errors. A notice's
firm word, which tells it from another license's, must stand there with few
edits or none.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, byte_class, chunks, text_buffer, tidy

#: The phrases whose exact occurrences count, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices that are searched with edits, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "mit license": "mit",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under cc by nc": "cc-by-nc",
    "creative commons attribution": "cc-by",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "all rights reserved": "all-rights-reserved",
}
#: Short words that alone tell a notice from other licenses' notices, and the edits allowed in them.
#: A notice that begins with its word also ends at the end of a word.
FIRM = {
    "apache license": ("apache", 1),
    "mit license": ("mit", 0),
    "released under the mit license": ("mit", 1),
    "licensed under cc by nc": ("nc", 0),
}
#: Letters per allowed edit.
LETTERS_PER_EDIT = 10

WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
IN_WORD = rb"[0-9a-z\x80-\xff]"
APART = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def edits_allowed(notice: str) -> int:
    return len(notice) // LETTERS_PER_EDIT


@dataclass
class Notice:
    words: bytes
    label: str
    edits: int
    firm: tuple[str, int] | None = None

    def __post_init__(self) -> None:
        size, n = len(self.words), self.edits + 1
        cut = [size * k // n for k in range(n + 1)]
        self.pieces = [(a, self.words[a:b]) for a, b in zip(cut, cut[1:])]
        fuzzy = lambda part, most=self.edits: rb"(?:%s){e<=%d}" % (regex.escape(part), most) if part else b""
        if self.firm is None:
            self.pattern = regex.compile(rb"(?b)" + fuzzy(self.words))
        else:
            word, most = self.firm[0].encode(), self.firm[1]
            before, after = re.split(rb"\b" + word + rb"\b", self.words, maxsplit=1)
            firm = rb"(?<!%s)%s(?!%s)" % (IN_WORD, fuzzy(word, most) if most else word, IN_WORD)
            end = b"" if before else rb"(?!%s)" % IN_WORD
            self.pattern = regex.compile(rb"(?b)" + fuzzy(before) + firm + fuzzy(after) + end)


def _matches(notice: Notice, buffer: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The best match inside a window, with the window: errors, start, end, low, high."""
    if high - low >= len(notice.words) - notice.edits:
        m = notice.pattern.search(buffer, low, high)
        if m and m.end() > m.start() and sum(m.fuzzy_counts) <= notice.edits:
            yield sum(m.fuzzy_counts), m.start(), m.end(), low, high


def fuzzy_spans(buffer: bytes, ends: list[int], notice: Notice) -> list[tuple[int, int, int, int]]:
    """(text, start, end, errors) of matches in texts that lie in ``buffer`` one after another.

    ``ends``: the end of each text. Every candidate is searched in a window a little longer than
    the notice. Of matches that overlap the one with fewest errors stays, then the first; what the
    others' windows hold on either side of it is searched again, so the time grows with the candidates.
    """
    windows: set[tuple[int, int]] = set()
    for offset, piece in notice.pieces:
        at = buffer.find(piece)
        while at >= 0:
            k = bisect_right(ends, at)
            if at + len(piece) <= ends[k]:
                low = max(ends[k - 1] if k else 0, at - offset - notice.edits - 1)
                windows.add((low, min(ends[k], at - offset + len(notice.words) + notice.edits + 1)))
            at = buffer.find(piece, at + 1)
    heap = [m for low, high in windows for m in _matches(notice, buffer, low, high)]
    heapq.heapify(heap)
    starts: list[int] = []  # of chosen spans, in order, and their ends
    stops: list[int] = []
    out = []
    while heap:
        errors, start, end, low, high = heapq.heappop(heap)
        k = bisect_right(stops, start)
        if k == len(starts) or starts[k] >= end:
            starts.insert(k, start)
            stops.insert(k, end)
            out.append((bisect_right(ends, start), start, end, errors))
        else:  # free parts of the window, between the chosen spans
            k, at = bisect_right(stops, low), low
            while k < len(starts) and starts[k] < high:
                for m in _matches(notice, buffer, at, min(starts[k], high)):
                    heapq.heappush(heap, m)
                at, k = stops[k], k + 1
            for m in _matches(notice, buffer, at, high):
                heapq.heappush(heap, m)
    return sorted(out)


class LicenseScanner:
    """Scans blocks of texts."""

    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, firm: dict[str, tuple[str, int]] | None = None) -> None:
        self.phrases = [(re.compile(APART.join(re.escape(w).encode() for w in p.split())), label) for p, label in phrases.items()]
        self.notices = [Notice(n.encode(), label, edits_allowed(n), (firm or {}).get(n)) for n, label in notices.items()]

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple]], list[list[tuple]]]:
        """Words of each text; its exact places (first word, label); its fuzzy
        spans (label, first word, end of the last word's index, errors, similarity)."""
        n = len(offsets) - 1
        exact: list[list[tuple]] = [[] for _ in range(n)]
        fuzzy: list[list[tuple]] = [[] for _ in range(n)]
        low = LOWER[raw]
        inside = WORD[low]
        border = np.zeros(len(raw) + 1, bool)
        border[offsets] = True
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | border[1:-1]
        count = np.concatenate([[0], np.cumsum(starts)])  # words that start before each byte
        words = np.diff(count[offsets])
        buffer, bounds = low.tobytes(), offsets.tolist()
        for pattern, label in self.phrases:
            for m in pattern.finditer(buffer):
                a, b = m.span()
                k = bisect_right(bounds, a) - 1
                if b <= bounds[k + 1] and starts[a] and (b == bounds[k + 1] or not inside[b]):
                    exact[k].append((int(count[a] - count[bounds[k]]), label))
        # Reduced texts: the words, one space after each run of anything else.
        shown = inside.copy()
        shown[1:] |= inside[:-1] & ~border[1:-1]
        reduced = np.where(inside, low, 0x20)[shown]
        at_reduced = np.concatenate([[0], np.cumsum(shown)])
        ends = at_reduced[offsets[1:]].tolist()
        small, where = reduced.tobytes(), np.flatnonzero(shown)
        for notice in self.notices:
            for k, a, b, errors in fuzzy_spans(small, ends, notice):
                first = max(0, int(count[where[a] + 1] - count[bounds[k]]) - 1)
                last = int(count[where[b - 1] + 1] - count[bounds[k]])
                fuzzy[k].append((notice.label, first, last, errors, 1 - errors / len(notice.words)))
        return words, exact, fuzzy


def license_places(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, firm: dict[str, tuple[str, int]] = FIRM) -> DataFrame:
    """Columns ``keep`` of every row, ``n_words``, ``exact`` (array of word, label)
    and ``spans`` (array of label, first_word, end_word, errors, similarity).

    Null texts count as empty: no words, empty arrays. Rows are independent, so
    repeats and null ids change nothing; an empty table gives an empty one.
    """
    exact_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("errors", pa.int64()), ("similarity", pa.float64())]))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(phrases, notices, firm)
        dicts = lambda rows, kind: [[dict(zip([f.name for f in kind.value_type], x)) for x in r] for r in rows]
        for batch in batches:
            raw, offsets = text_buffer(batch.column(len(keep)))
            for a, b in chunks(offsets):
                own = offsets[a : b + 1]
                words, exact, fuzzy = scanner.scan(raw[own[0] : own[-1]], own - own[0])
                columns = [pa.array(words, pa.int64()), pa.array(dicts(exact, exact_type), exact_type), pa.array(dicts(fuzzy, span_type), span_type)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), *columns], names=[*keep, "n_words", "exact", "spans"])

    own = docs.select(*keep, F.col(f"`{text}`").cast("string"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema[: len(keep)])
    return own.mapInArrow(
        work,
        schema + "n_words bigint, exact array<struct<word: bigint, label: string>>, "
        "spans array<struct<label: string, first_word: bigint, end_word: bigint, errors: bigint, similarity: double>>",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license phrases and notices of every document."""
    found = license_places(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.word").alias("first_word"),
        F.array_max("exact.word").alias("last_word"),
        joined(F.col("exact.label")).alias("base_labels"),
        joined(F.concat(F.col("exact.label"), F.col("spans.label"))).alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
    )


BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_licenses`` that SQL can express: the exact phrases."""
    return op4_licenses(spark, sf_dir).select(*BASE)


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT string_split(phrase, ' ') AS phrase, label FROM (VALUES %s) v(phrase, label)
), x AS (
  SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) JOIN p ON w[i + 1] = phrase[1] AND w[i + 1 : i + len(phrase)] = phrase
), g AS (
  SELECT doc_id, count(*) AS n, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM x GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
""" % ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
