"""The 128 answer letters of multiple-choice prompts."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

SIZE = 128
REJECT = SIZE - 1
# Symbols that can be letters ('.', '*' and the apostrophe have a meaning in prompts).
SYMBOLS = "!@#$%^&+=<>?/|~`()[]{}_-"


def candidates() -> Iterator[str]:
    """Characters in the order in which they are preferred: Latin, digits, symbols, Greek, Cyrillic."""
    yield from string.ascii_uppercase + string.ascii_lowercase
    yield from string.digits + SYMBOLS
    for first, last in (("Α", "Ω"), ("α", "ω"), ("А", "Я"), ("а", "я")):
        yield from (c for c in map(chr, range(ord(first), ord(last) + 1)) if c.isalpha())


def alphabet(token_of: Callable[[str], int | None] = ord) -> list[tuple[str, int]]:
    """The first 128 candidates that are one token each and no two the same, with their token ids.

    token_of: the id of a space-prefixed character, or None where it is not a single known token.
    """
    taken: dict[int, str] = {}
    for c in candidates():
        token = token_of(c)
        if token is not None and token not in taken:
            taken[token] = c
        if len(taken) == SIZE:
            return [(c, t) for t, c in taken.items()]
    raise ValueError(f"only {len(taken)} of {SIZE} letters are single tokens")


LETTERS = "".join(c for c, _ in alphabet())
