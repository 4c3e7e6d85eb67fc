"""Split texts as the byte-level tokenizer does before it merges.

Long texts are first cut before single spaces that stand between a non-space and
anything else. No piece of the tokenizer's pattern crosses such a cut, so chunks
repeat and can be looked up.
"""

from __future__ import annotations

import re

import regex

# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_exact = regex.compile(PATTERN)
# the same pieces for texts of SAFE characters, where the classes of both libraries agree
_plain = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_safe = re.compile(r"[\x00-\x1b\x20-\x7eÀ-ɏ]*\Z")
# a space inside or at the end of a run of white space: chunks would cut the run
_run = re.compile(r"\s (?:\s|\Z)")


def chunks(text: str) -> list[str]:
    """Pieces that concatenate to ``text`` and can be split on their own."""
    if _run.search(text):
        return pieces(text)
    first, *rest = text.split(" ")
    out = [" " + w for w in rest]
    if first:
        out.insert(0, first)
    return out


def pieces(text: str) -> list[str]:
    """The tokenizer's own pieces of ``text``."""
    return (_plain if _safe.match(text) else _exact).findall(text)
