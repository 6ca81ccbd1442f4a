"""The Porter (1980) stemmer as a vectorised function over distinct words.

Steps are data: (condition, suffix, replacement). Conditions look at the stem that is left.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The rules of the published algorithm, longest suffix first within a step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


ENDS2, ENDS3, ENDS4 = (tuple(sorted(x, key=len, reverse=True)) for x in (STEP2, STEP3, STEP4))


class _Letters(dict):
    def __missing__(self, letter: int) -> str:
        return "c"


_LETTERS = _Letters({ord(x): "v" for x in "aeiou"} | {ord("y"): "y"})


def _shape(stem: str) -> str:
    """Consonants as c, vowels as v; y is a vowel after a consonant."""
    out = stem.translate(_LETTERS)
    while (i := out.find("y")) >= 0:
        out = f"{out[:i]}{'v' if i and out[i - 1] == 'c' else 'c'}{out[i + 1:]}"
    return out


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, suffixes: tuple[str, ...]) -> str | None:
    """suffixes: the longest first."""
    return next(s for s in suffixes if w.endswith(s)) if w.endswith(suffixes) else None


def stem(w: str) -> str:
    if len(w) < 3:
        return w
    for end, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if w.endswith(end):
            w = w[: len(w) - cut]
            break
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        s = _longest(w, ("ing", "ed"))
        if s and "v" in _shape(w[: -len(s)]):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table, ends in ((STEP2, ENDS2), (STEP3, ENDS3)):
        s = _longest(w, ends)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, ENDS4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@F.pandas_udf(StringType())
def porter(term: pd.Series) -> pd.Series:
    return term.map({t: stem(t) for t in term.dropna().unique()})
