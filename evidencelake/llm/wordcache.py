"""A cache, bounded in bytes, for what a tokenizer makes of one word."""

from __future__ import annotations

import sys


class TwoGenerations:
    """A dict in two generations: when the young one is full it becomes the old one.

    Each generation holds about ``size`` bytes of words and values; words in steady use are carried over on their next use. Words of more than
    LONGEST characters hardly recur: they stay until the next call of ``missing`` only.
    """

    LONGEST, EACH = 32, 104

    def __init__(self, size: int):
        self.size, self.held, self.young, self.old, self.passing = size, 0, {}, {}, []

    def missing(self, words) -> list:
        """The distinct ``words`` that are not cached; those found in the old generation are carried over."""
        for w in self.passing:
            del self.young[w]
        self.passing.clear()
        if self.held >= self.size:
            self.young, self.old, self.held = {}, self.young, 0
        absent = []
        for w in set(words).difference(self.young):
            if w in self.old:
                self.put(w, self.old[w])
            else:
                absent.append(w)
        return absent

    def put(self, word, value) -> None:
        """Keeps the value of a word, a bytes or string object or a tuple of them."""
        self.young[word] = value
        if len(word) > self.LONGEST:
            self.passing.append(word)
        else:
            self.held += self.EACH + sys.getsizeof(word) + sys.getsizeof(value) + (sum(map(sys.getsizeof, value)) if type(value) is tuple else 0)
