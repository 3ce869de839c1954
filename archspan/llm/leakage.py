"""Evaluation passages inside training text (problem 8).

Wu-Manber search: every run of 12 common words holds one whole block of 6 words
that starts at a multiple of 6 in the passage, so those blocks are the patterns.
A block-shift table skips positions at which no pattern can end, hash buckets of
the pattern ends select patterns, and each occurrence is compared directly and
grown in both directions to count the common words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspan.runtime import spread

MIN_WORDS = 12
#: Bytes of passages in one pattern table; more patterns would leave too few positions to skip.
TABLE_BYTES = 16 << 20
#: Pattern tables that are broadcast together and searched in one pass over the texts.
TABLES_PER_PASS = 4
#: Characters hashed by the shift table.
BLOCK = 8

_LETTERS = bytes(c if chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + b" " * 128


def normal(text: str) -> bytes:
    """Lower-case ASCII words with one space before, between and after them; anything else only separates."""
    words = text.encode("utf-8", "replace").translate(_LETTERS).split()
    return b" " + b" ".join(words) + b" " if words else b" "


class Patterns:
    """Shift table and buckets over the aligned word blocks of the passages."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS) -> None:
        self.min_words = min_words
        step = (min_words + 1) // 2
        self.passages: list[tuple[int, bytes]] = []
        found: dict[bytes, list[tuple[int, int]]] = {}
        for item_id, passage in items:
            words = normal(passage or "").split()
            if len(words) < min_words:
                continue
            whole = b" " + b" ".join(words) + b" "
            at = 0
            for i in range(0, len(words) - step + 1):
                if i % step == 0:
                    block = b" " + b" ".join(words[i : i + step]) + b" "
                    found.setdefault(block, []).append((len(self.passages), at))
                at += len(words[i]) + 1
            self.passages.append((item_id, whole))
        self.m = min(map(len, found), default=0)
        self.b = min(BLOCK, self.m)
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[tuple[bytes, list[tuple[int, int]]]]] = {}
        for pattern, places in found.items():
            for end in range(self.b, self.m + 1):
                block = pattern[end - self.b : end]
                self.shift[block] = min(self.shift.get(block, self.m), self.m - end)
            self.buckets.setdefault(pattern[self.m - self.b : self.m], []).append((pattern, places))

    def _words(self, text: bytes, start: int, passage: bytes, at: int, size: int) -> int:
        """Common words around an occurrence: whole words of the longest common stretch."""
        lo, hi = 0, size
        while at - lo > 0 and start - lo > 0 and passage[at - lo - 1] == text[start - lo - 1]:
            lo += 1
        while at + hi < len(passage) and start + hi < len(text) and passage[at + hi] == text[start + hi]:
            hi += 1
        return passage[at - lo : at + hi].count(b" ") - 1

    def search(self, text: bytes) -> set[int]:
        """Items that share at least ``min_words`` consecutive words with the normalised text."""
        hits: set[int] = set()
        m, b, shift, far = self.m, self.b, self.shift.get, self.m - self.b + 1
        if not m:
            return hits
        i, n = m, len(text)
        while i <= n:
            end = text[i - b : i]
            skip = shift(end, far)
            if skip:
                i += skip
                continue
            start = i - m
            for pattern, places in self.buckets[end]:
                if text.startswith(pattern, start):
                    for number, at in places:
                        item, passage = self.passages[number]
                        if item not in hits and self._words(text, start, passage, at, len(pattern)) >= self.min_words:
                            hits.add(item)
            i += 1
        return hits


#: Tables of the last pass, kept while a worker process lives: building them takes longer than many a task.
_BUILT: dict[str, list[Patterns]] = {}


def _tables(key: str, blocks: list[list[tuple[int, str]]], min_words: int) -> list[Patterns]:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = [Patterns(items, min_words) for items in blocks]
    return _BUILT[key]


def _blocks(items: DataFrame, table_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items, fetched partition by partition, in blocks of bounded size."""
    block: list[tuple[int, str]] = []
    held = 0
    for row in items.select("item_id", "passage").dropna().distinct().toLocalIterator():
        block.append((row.item_id, row.passage))
        held += len(row.passage)
        if held >= table_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def leaked(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, table_bytes: int = TABLE_BYTES, tables_per_pass: int = TABLES_PER_PASS) -> DataFrame:
    """(doc_id, item_id): documents that share ``min_words`` consecutive words with an item's passage.

    Words are runs of ASCII letters and digits without case. Null and empty texts
    and passages under ``min_words`` words match nothing. Texts are searched whole.
    The items are a stated query set; they are broadcast as up to ``tables_per_pass``
    tables of bounded size, and each such pass searches all documents.
    """
    spark = documents.sparkSession
    texts = spread(documents.where(F.length("text") > 0).select("doc_id", "text"), documents)

    def scan(blocks: list[list[tuple[int, str]]]) -> DataFrame:
        stated = spark.sparkContext.broadcast(blocks)
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = _tables(key, stated.value, min_words)
            for batch in batches:
                docs, hits = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    plain = normal(text.as_py())
                    for table in tables:
                        for item in table.search(plain):
                            docs.append(doc_id), hits.append(item)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        return texts.mapInArrow(run, "doc_id bigint, item_id bigint")

    found = None
    waiting: list[list[tuple[int, str]]] = []
    for block in _blocks(items, table_bytes):
        waiting.append(block)
        if len(waiting) == tables_per_pass:
            found, waiting = scan(waiting) if found is None else found.unionByName(scan(waiting)), []
    if waiting or found is None:
        found = scan(waiting) if found is None else found.unionByName(scan(waiting))
    return found.distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, case_id, n_docs): every item with the number of documents it leaked into, 0 included."""
    per_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "case_id").distinct().join(per_item, "item_id", "left").select("item_id", "case_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
