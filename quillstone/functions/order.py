"""Natural order of document paths: numbers as numbers, number words beside session words too."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words that mark a place in a series, and the words that number it.
SESSION_WORDS = ("day", "part", "volume", "vol", "session", "episode", "chapter", "lesson", "week", "module")
CARDINALS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty")
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth")

VALUE = {word: i for words in (CARDINALS, ORDINALS) for i, word in enumerate(words, 1)}
#: Words and the gaps between them; a word is a run of a-z and 0-9.
PIECES = re.compile(r"([a-z0-9]+)|([\s._\-]+)")
DIGITS = re.compile(r"(\d+)")
WIDTH = 24


def _is_session(word: str) -> bool:
    return word in SESSION_WORDS or (word.endswith("s") and word[:-1] in SESSION_WORDS)


def numbered(component: str) -> str:
    """A component in which number words next to a session word are digits."""
    pieces = [(m.group(), m.lastindex, m.start(), m.end()) for m in PIECES.finditer(component)]
    words = [i for i, p in enumerate(pieces) if p[1] == 1]
    new = {i: pieces[i][0] for i in words}
    next_to = lambda i, j: j - i == 2 and pieces[i][3] == pieces[i + 1][2] and pieces[i + 1][3] == pieces[j][2]
    used: set[int] = set()
    for session_first in (True, False):
        for i, j in zip(words, words[1:], strict=False):
            word, mark = (j, i) if session_first else (i, j)
            if word not in used and next_to(i, j) and pieces[word][0] in VALUE and _is_session(pieces[mark][0]):
                new[word] = str(VALUE[pieces[word][0]])
                used.add(word)
    out, at = [], 0
    for i in words:
        out += [component[at : pieces[i][2]], new[i]]
        at = pieces[i][3]
    return "".join([*out, component[at:]])


def components(path: str) -> list[str]:
    for prefix in ("\\\\?\\UNC\\", "\\\\?\\"):
        if path.startswith(prefix):
            path = path[len(prefix) :]
            break
    return [p for p in re.split(r"[\\/]+", path) if p]


def sort_key(path: str) -> str:
    """A string whose order by code point is the natural order of paths.

    Each atom is a tag and its value: numbers (tag 1) before texts (tag 2), the end of a component
    (tag 0) before either; a number is its length and its digits, so any two compare as numbers.
    The path itself decides ties.
    """
    parts = components(path)
    out = []
    for part in parts:
        for k, atom in enumerate(DIGITS.split(numbered(part.casefold()))):
            if k % 2:
                value = str(int(atom))
                out.append(f"\x01{len(value):06d}{value}")
            elif atom:
                out.append(f"\x02{atom}\x00")
        out.append("\x00")
    return "".join(out) + "\x00" + "/".join(parts)


@F.pandas_udf(T.StringType())
def _keys(path: pd.Series) -> pd.Series:
    return path.map(sort_key, na_action="ignore")


def natural_key(path: Column) -> Column:
    """`sort_key` of a column, for an ordinary sort."""
    return _keys(path)
