"""JSON inside the free text of a model's answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*\n?(.*?)\n?\s*```", re.DOTALL)


def _first(text: str, opening: str) -> str | None:
    """The stretch from the first opening bracket to the one that closes it, strings not looked at; None if none closes."""
    start = text.find(opening)
    depth = 0
    for m in re.finditer(r"[\[\]{}]", text[start:]) if start >= 0 else ():
        depth += 1 if m.group() in "[{" else -1
        if depth == 0:
            return text[start : start + m.end()]
    return None


def json_part(text: str | None) -> str | None:
    """The JSON of an answer: the inside of the first fence, else the first whole array, else the first whole object, else the text itself."""
    if text is None:
        return None
    plain = text.strip()
    fence = _FENCE.search(plain)
    if fence:
        return fence.group(1).strip()
    return _first(plain, "[") or _first(plain, "{") or plain


@F.pandas_udf("string")
def extract_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """`json_part` of a column, in Arrow batches."""
    for batch in texts:
        yield batch.map(json_part, na_action="ignore")
