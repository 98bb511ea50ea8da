"""Words and white space as all operators of this subpackage see them."""

from __future__ import annotations

import re

import regex

#: Unicode White_Space, spelled out because the engines' ``\s`` differ on control characters.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Words: maximal runs of letters and digits of the lower-cased text.
WORD = regex.compile(r"[\p{L}\p{N}]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]")


class Memo(dict):
    """A dict that fills itself by a function and starts afresh at a size, so that a worker's memory stays bounded."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.make(key)
        return value


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())
