"""Token counts and offsets of a public byte-level BPE vocabulary, in Arrow batches."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

#: Vocabulary file used unless the caller names another; it has to stand at this path on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that splits text before the merges; fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The pattern never joins across the start of a run of non-blanks (with one space
# before it), so these chunks of an ASCII text are encoded independently.
_CHUNKS = re.compile(r" ?\S+|\s+(?!\S)|\s", re.ASCII)
_CACHE_LIMIT = 200_000


class _Lengths(dict):
    """Byte lengths of the tokens of a chunk, kept while the chunk recurs."""

    def __init__(self, encode, sizes) -> None:
        super().__init__()
        self.encode, self.sizes = encode, sizes

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[chunk] = tuple(self.sizes[i] for i in self.encode(chunk))
        return value


class Tokenizer:
    """Exact token counts and byte lengths; ASCII texts go by cached chunks, others through the library."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        sizes = [0] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        self.sizes = np.array(sizes, dtype=np.int64)
        self._lengths = _Lengths(self.encoding.encode_ordinary, sizes)
        self._counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text.isascii():
            return len(self.encoding.encode_ordinary(text))
        counts, total = self._counts, 0
        if len(counts) >= _CACHE_LIMIT:
            counts.clear()
        for chunk in _CHUNKS.findall(text):
            n = counts.get(chunk)
            if n is None:
                n = counts[chunk] = len(self.encoding.encode_ordinary(chunk))
            total += n
        return total

    def lengths(self, text: str) -> np.ndarray:
        """Byte length of each token, in order; they sum to the bytes of the text."""
        if not text.isascii():
            return self.sizes[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)]
        return np.fromiter(chain.from_iterable(map(self._lengths.__getitem__, _CHUNKS.findall(text))), dtype=np.int64)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """The tokenizer of a vocabulary file, read once per worker process."""
    return Tokenizer(vocabulary)


def counter(vocabulary: str, text: str, keep: list[str]):
    """A mapInArrow function: the columns ``keep`` and ``n_tokens`` (0 for a null text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokenizer(vocabulary).count
        for batch in batches:
            counts = [count(t) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    return run
