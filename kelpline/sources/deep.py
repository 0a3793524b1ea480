"""Recursion as deep as the text that is parsed."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

#: interpreter frames that one character of nesting may need
FRAMES = 24


@contextmanager
def deep_recursion(size: int) -> Iterator[None]:
    """Room for a recursive descent over a text of ``size`` characters; calls between Python functions take no C stack."""
    old = sys.getrecursionlimit()
    sys.setrecursionlimit(max(old, min(2**31 - 1, 10_000 + FRAMES * size)))
    try:
        yield
    finally:
        sys.setrecursionlimit(old)
