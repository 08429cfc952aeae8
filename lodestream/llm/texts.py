"""What the operators on documents' texts share."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Markup: a tag or a comment, of any length; a stray < is text. No character is read twice.
TAG = re.compile(r"<(?:!--|[/!?]?[A-Za-z])[^<>]*>")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def portions(texts: Sequence[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Texts in a row that have about `size` characters together."""
    begin, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
