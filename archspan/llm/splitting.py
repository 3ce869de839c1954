"""Splitting oversized texts at natural boundaries (problem 10).

Token lengths are summed to offsets; natural boundaries are sorted arrays of
offsets. The last boundary under the limit is found by binary search, the next
piece starts the overlap before it, and without a boundary the cut is hard.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspan.llm import tokens
from archspan.llm.tokens import VOCABULARY, Tokenizer
from archspan.runtime import spread

_PARAGRAPH = re.compile(rb"(?:\r?\n){2,}")
_SENTENCE = re.compile(rb"[.!?][\"')\]]*(?=\s)")
_BLANK = np.zeros(256, dtype=bool)
_BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: Where a stretch has no blanks at all, a cut after one of these marks comes before a hard cut.
MARKS = re.compile(rb"[,;}\])>]")
#: A better kind of boundary is preferred to a lesser one only if the piece keeps this share of the limit;
#: where no kind does, the last boundary of the best kind that moves on is taken all the same.
LEAST_FILL = 0.5
#: Output rows are sent on after about so many bytes of text.
FLUSH_BYTES = 4 << 20

Piece = tuple[int, int, int, int, int, str]


class Prepared:
    """A text with its token offsets and boundaries, found once for all limits."""

    def __init__(self, text: str, tokenizer: Tokenizer) -> None:
        self.tokenizer = tokenizer
        self.raw = text.encode("utf-8")
        lengths = tokenizer.lengths(text)
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self.total = len(lengths)
        self.cuts: list[tuple[str, np.ndarray]] = []

    def find(self) -> None:
        """Boundaries by kind, best first, as token numbers; only needed where the text is over a limit."""
        if self.cuts:
            return
        raw, ends = self.raw, self.ends
        b = np.frombuffer(raw, dtype=np.uint8)
        self.whole = np.ones(self.total + 1, dtype=bool)
        self.whole[1:-1] = (b[ends[1:-1]] & 0xC0) != 0x80
        self.safe = np.flatnonzero(self.whole)
        blank = _BLANK[b]
        places = {
            "paragraph": np.array([m.end() for m in _PARAGRAPH.finditer(raw)], dtype=np.int64),
            "line": np.flatnonzero(b == 10) + 1,
            "sentence": np.array([m.end() for m in _SENTENCE.finditer(raw)], dtype=np.int64),
            "word": np.flatnonzero(~blank[:-1] & blank[1:]) + 1,
        }
        self.cuts = [(name, self._tokens(at)) for name, at in places.items()]
        # A space between two visible ASCII characters: no token spans it, and what stands on either side is
        # tokenised alike with and without the other side.
        shown = (b > 32) & (b < 127)
        self.joints = np.flatnonzero((b[1:-1] == 32) & shown[:-2] & shown[2:]) + 1
        self.at_joints = np.searchsorted(ends, self.joints)

    def _tokens(self, places: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.ends, places)
        return np.unique(at[(self.ends[at] == places) & self.whole[at]])

    def count(self, lo: int, hi: int) -> int:
        """Tokens of the bytes lo to hi on their own: counted anew up to the first and from the last joint, from the offsets between them."""
        i = int(np.searchsorted(self.joints, lo))
        j = int(np.searchsorted(self.joints, hi, "right")) - 1
        if i > j:
            return self.tokenizer.count(self.raw[lo:hi].decode("utf-8", "replace"))
        first, last = int(self.joints[i]), int(self.joints[j])
        edges = self.tokenizer.count(self.raw[lo:first].decode("utf-8", "replace")) + self.tokenizer.count(self.raw[last:hi].decode("utf-8", "replace"))
        return edges + int(self.at_joints[j] - self.at_joints[i])

    def pieces(self, limit: int, overlap: int) -> Iterator[Piece]:
        """(first byte, end byte, first token, end token, tokens, boundary) of each piece; none if the text fits.

        Cuts lie between tokens and between characters. Where a piece has more tokens on
        its own than the limit, which a hard cut may cause, it is shortened.
        """
        if self.total <= limit:
            return
        self.find()
        ends, safe, total = self.ends, self.safe, self.total
        start = 0
        overlap = min(overlap, limit - 1)
        while True:
            stop = min(start + limit, total)
            name = "end"
            if stop < total:
                stop, name = self._cut(start, stop, overlap, limit)
            n = self.count(ends[start], ends[stop])
            while n > limit:
                shorter = safe[max(0, np.searchsorted(safe, stop - max(1, n - limit), "right") - 1)]
                if shorter <= start:
                    break
                stop, name = int(shorter), "hard"
                n = self.count(ends[start], ends[stop])
            yield int(ends[start]), int(ends[stop]), start, stop, n, name
            if stop >= total:
                return
            back = int(safe[np.searchsorted(safe, max(stop - overlap, 0), "right") - 1])
            start = back if back > start else int(safe[np.searchsorted(safe, start, "right")])

    def _cut(self, start: int, stop: int, overlap: int, limit: int) -> tuple[int, str]:
        """The last boundary of the best kind that fills the piece enough, else of the best kind that moves on, else a mark, else a hard cut."""
        for least in (max(int(limit * LEAST_FILL), overlap + 1), overlap + 1):
            for name, at in self.cuts:
                k = np.searchsorted(at, stop, "right") - 1
                if k >= 0 and at[k] >= start + least:
                    return int(at[k]), name
        hard = int(self.safe[np.searchsorted(self.safe, stop, "right") - 1])
        if hard <= start:  # one character of more tokens than the limit: it stays whole
            return int(self.safe[np.searchsorted(self.safe, start, "right")]), "hard"
        for least in (max(int(limit * LEAST_FILL), overlap + 1), overlap + 1):
            if start + least < hard:
                places = np.array([m.end() for m in MARKS.finditer(self.raw, int(self.ends[start + least]), int(self.ends[hard]))], dtype=np.int64)
                at = self._tokens(places)
                if len(at):
                    return int(at[-1]), "mark"
        return hard, "hard"


def pieces(text: str, limit: int, overlap: int, tokenizer: Tokenizer) -> list[Piece]:
    """The pieces of one text; none if it fits."""
    return list(Prepared(text, tokenizer).pieces(limit, overlap))


def split_documents(documents: DataFrame, limits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, max_tokens, overlap_tokens, piece_no, first_byte, end_byte, first_token, end_token, n_tokens, boundary, piece).

    For each row of ``limits`` (a few; the driver reads them) every text above
    max_tokens gives ordered pieces of at most max_tokens; the next piece starts
    overlap_tokens before the end of the last, or up to three more where that would
    cut a character (fewer where the piece itself is no longer): its first_token is the last end_token less the overlap. n_tokens
    is counted on the piece alone. Texts that fit, null and empty texts give no rows. A text has at
    most as many tokens as bytes, so shorter ones aren't tokenised.
    """
    wanted = sorted({(int(r.max_tokens), int(r.overlap_tokens or 0)) for r in limits.dropna(subset=["max_tokens"]).collect() if r.max_tokens > 0})
    least = min((m for m, _ in wanted), default=0)
    names = ["doc_id", "max_tokens", "overlap_tokens", "piece_no", "first_byte", "end_byte", "first_token", "end_token", "n_tokens", "boundary", "piece"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokens.tokenizer(vocabulary)
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prepared = Prepared(text.as_py(), tokenizer)
                for limit, overlap in wanted:
                    for i, (lo, hi, first, end, n, kind) in enumerate(prepared.pieces(limit, overlap)):
                        rows.append((doc_id, limit, overlap, i, lo, hi, first, end, n, kind, prepared.raw[lo:hi].decode("utf-8", "replace")))
                        held += hi - lo
                        if held > FLUSH_BYTES:
                            yield flush()
                            held = 0
        yield flush()

    long = documents.where(F.octet_length("text") > F.lit(least)).select("doc_id", "text") if wanted else documents.where("false").select("doc_id", "text")
    return spread(long, documents).mapInArrow(run, "doc_id bigint, max_tokens int, overlap_tokens int, piece_no int, first_byte bigint, end_byte bigint, first_token bigint, end_token bigint, n_tokens int, boundary string, piece string")
