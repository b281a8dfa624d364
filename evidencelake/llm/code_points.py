"""Where the ``regex`` package and the tokenizers' engine know different versions of Unicode."""

from __future__ import annotations

import functools
import unicodedata

import regex
from tokenizers import Tokenizer


@functools.cache
def newer() -> frozenset[str]:
    """Letters and numbers of the ``regex`` package that are not assigned in Python's older tables: the tokenizers may take them for neither."""
    unassigned = "".join(chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Cn")
    return frozenset(regex.findall(r"[\p{L}\p{N}]", unassigned))


def unknown_to(tokenizer: Tokenizer) -> str:
    """Those of ``newer`` that a tokenizer's own word pattern takes for neither letter nor number: they end the word of the letter before them and begin one with the mark after them."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    return "".join(sorted(c for c in newer() if [at for _, at in cut(f"a{c}!")] == [(0, 1), (1, 3)]))
