"""White-space pre-tokens, and a bounded memory of what has been worked out for each."""

from __future__ import annotations

import re
from collections.abc import Callable

SPACE = "▁"
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def split_pieces(text: str) -> list[str]:
    """The text after a leading space mark, cut wherever a space follows another character.

    Each part stands without its first space mark.  No piece of the vocabulary holds a space
    mark after another character, so no token crosses these cuts and parts are independent.
    """
    if SPACE not in text:
        words = text.split(" ")
        if "" not in words:
            return words
        if words == [""]:
            return []
    return [x[1:] for x in _RUN.findall(SPACE + text.replace(" ", SPACE))]


#: Bytes that an entry takes beside the characters of its key and what is kept for it.
ENTRY_BYTES = 200
#: Keys of more characters aren't kept: they hardly come again, and one could fill a memory.
LONG_KEY = 256


class Memo(dict):
    """Results by key, worked out when first asked for, within a bound of bytes.

    An entry counts ENTRY_BYTES and 12 bytes a character of its key, as results here are a
    number or at most an id a UTF-8 byte.  Entries stand in two halves: when the younger half is
    full it takes the place of the older one, which is dropped but for what is asked for again,
    so frequent keys stay.
    """

    def __init__(self, work: Callable, most_bytes: int):
        super().__init__()
        self.work, self.half, self.old, self.held = work, most_bytes // 2, {}, 0

    def __missing__(self, key):
        size = len(key)
        if size > LONG_KEY:
            return self.work(key)
        out = self.old.get(key)
        if out is None:
            out = self.work(key)
        if self.held >= self.half:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += ENTRY_BYTES + 12 * size
        self[key] = out
        return out


class ManyMemo:
    """The same for work that takes many keys at once, as `of` asks for them."""

    def __init__(self, work: Callable[[list[str]], list], most_bytes: int):
        self.work, self.half, self.held = work, most_bytes // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: set[str]) -> dict:
        """A dictionary that has all the keys, good until the next call."""
        young = self.young
        if self.held >= self.half:
            self.old, self.held = young, 0
            self.young = young = {}
        missing = [k for k in keys if k not in young]
        if not missing:
            return young
        new = [k for k in missing if k not in self.old]
        fresh = dict(zip(new, self.work(new), strict=True)) if new else {}
        fresh.update((k, self.old[k]) for k in missing if k in self.old)
        long = {k: fresh.pop(k) for k in [k for k in fresh if len(k) > LONG_KEY]}
        young.update(fresh)
        self.held += ENTRY_BYTES * len(fresh) + 12 * sum(map(len, fresh))
        return young if not long else {**young, **long}
