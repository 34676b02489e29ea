"""Splitting of one text into chunks: the rules, without Spark."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

# Separators from the widest to single characters.
SEPARATORS = ("\n\n", "\n", "。", "；", "，", " ", "")


def merge_pieces(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join pieces up to `size`, each chunk starting with up to `overlap` characters of the one before."""
    chunks: list[str] = []
    first, held = 0, 0  # the open chunk is pieces[first : i], of `held` characters
    sizes = list(map(len, pieces))
    for i, n in enumerate(sizes):
        if held + n > size and first < i:
            chunks.append("".join(pieces[first:i]))
            while first < i and (held > overlap or held + n > size):
                held -= sizes[first]
                first += 1
        held += n
    if first < len(pieces):
        chunks.append("".join(pieces[first:]))
    return [x for x in (c.strip() for c in chunks) if x]


def pieces_of(text: str, separator: str) -> list[str]:
    """The text cut before each separator; single characters for none."""
    if not separator:
        return list(text)
    first, *others = text.split(separator)
    return [x for x in (first, *(separator + o for o in others)) if x]


def recursive_split(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks by the widest separator that occurs; pieces that are still too long go on with the narrower ones."""
    level = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    narrower = separators[level + 1 :]
    chunks: list[str] = []
    waiting: list[str] = []
    for piece in pieces_of(text, separators[level]):
        if len(piece) < size:
            waiting.append(piece)
            continue
        chunks += merge_pieces(waiting, size, overlap)
        waiting = []
        chunks += recursive_split(piece, size, overlap, narrower) if narrower else [piece]
    return chunks + merge_pieces(waiting, size, overlap)


def windows(text: str, size: int = 500, overlap: int = 50) -> list[str]:
    """Windows of `size` characters, a step of size - overlap apart (of size, if that isn't positive)."""
    step = size - overlap if size > overlap else size
    return [text[i : i + size] for i in range(0, len(text), step)]


def packed(parts: list[str], glue: str, size: int, finer: Callable[[str], list[str]]) -> list[str]:
    """Runs of parts, as long as fit into `size` with glue between them.

    The end of a run is looked up among the running lengths of the parts.  A part that is too
    long by itself becomes what `finer` makes of it, and its last piece begins the next run;
    empty parts begin none.
    """
    upto = [0, *accumulate(len(p) + len(glue) for p in parts)]
    runs: list[str] = []
    lead, at = "", 0  # what the next run begins with, and its first part
    while at < len(parts):
        if not lead and not parts[at]:
            at += 1
            continue
        room = size + len(glue) - (len(lead) + len(glue) if lead else 0)
        end = max(at, bisect_right(upto, upto[at] + room) - 1)
        if end == at and not lead:
            *whole, lead = finer(parts[at]) or [""]
            runs += whole
            at += 1
            continue
        runs.append(glue.join([lead, *parts[at:end]] if lead else parts[at:end]))
        lead, at = "", end
    return [*runs, lead] if lead else runs


def greedy_split(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The splitter without overlap between separator-bound chunks: of the separators from wide
    to narrow the first that gives two chunks or more, or the last; none at all cuts windows."""
    chunks: list[str] = []
    for level, separator in enumerate(separators if text else ()):
        if not separator:
            return windows(text, size, overlap)
        narrower = separators[level + 1 :]
        chunks = packed(text.split(separator), separator, size, lambda part, rest=narrower: greedy_split(part, size, overlap, rest) if rest else [part])
        if len(chunks) > 1:
            break
    return chunks
