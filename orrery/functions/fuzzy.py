"""Sound and spelling: Levenshtein, Soundex, Metaphone, trigrams."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F


def levenshtein_less_equal(a: Column, b: Column, most: int) -> Column:
    """The distance, or most + 1 where it is greater."""
    d = F.levenshtein(a, b, most)
    return F.when(d == -1, F.lit(most + 1)).otherwise(d)


def difference(a: Column, b: Column) -> Column:
    """Equal places of two Soundex codes, 0 to 4."""
    x, y = F.soundex(a), F.soundex(b)
    return sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5))


def show_trgm(s: Column) -> Column:
    """Distinct trigrams of the words, each with two blanks before and one after it."""
    words = F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_sort(F.array_distinct(F.flatten(pieces)))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams."""
    x, y = show_trgm(a), show_trgm(b)
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def word_similarity(a: Column, b: Column) -> Column:
    """The greatest similarity of a's trigrams with a run of b's, in order."""

    def grams(s: str) -> list[str]:
        return [p[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for p in (f"  {w} ",) for i in range(len(p) - 2)]

    def best(x: str, y: str) -> float:
        want, run = set(grams(x)), grams(y)
        if not want:
            return 0.0
        top = 0.0
        places = [i for i, g in enumerate(run) if g in want]
        for k, low in enumerate(places):
            seen: set[str] = set()
            for high in places[k:]:
                seen = set(run[low : high + 1])
                top = max(top, len(want & seen) / len(want | seen))
        return top

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else best(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)


def _metaphone(word: str, most: int) -> str:
    """Sounds of an English word, by the classic rules."""
    w = re.sub("[^A-Z]", "", word.upper())
    if not w:
        return ""
    if w[:2] in ("AE", "GN", "KN", "PN", "WR"):
        w = w[1:]
    elif w[0] == "X":
        w = "S" + w[1:]
    elif w[:2] == "WH":
        w = "W" + w[2:]
    out = ""
    vowels, soft = "AEIOU", "EIY"
    for i, c in enumerate(w):
        if len(out) >= most:
            break
        before, after, after2 = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else "", w[i + 2] if i + 2 < len(w) else ""
        if c == before and c != "C":
            continue
        if c in vowels:
            out += c if i == 0 else ""
        elif c == "B":
            out += "" if before == "M" and not after else "B"
        elif c == "C":
            if after == "I" and after2 == "A" or after == "H":
                out += "X"
            elif after in soft and after:
                out += "" if before == "S" else "S"
            else:
                out += "K"
        elif c == "D":
            out += "J" if after == "G" and after2 and after2 in soft else "T"
        elif c == "G":
            if after == "H" and after2 and after2 not in vowels or after == "N" and (not after2 or w[i + 1 :] == "NED"):
                continue
            if before == "D" and after and after in soft:
                continue
            out += "J" if after and after in soft else "K"
        elif c == "H":
            out += "H" if after and after in vowels and before not in ("C", "S", "P", "T", "G") else ""
        elif c == "K":
            out += "" if before == "C" else "K"
        elif c == "P":
            out += "F" if after == "H" else "P"
        elif c == "Q":
            out += "K"
        elif c == "S":
            out += "X" if after == "H" or after == "I" and after2 and after2 in "OA" else "S"
        elif c == "T":
            if after == "I" and after2 and after2 in "OA":
                out += "X"
            elif after == "H":
                out += "T" if after2 == "M" else "0"
            elif not (after == "C" and after2 == "H"):
                out += "T"
        elif c == "V":
            out += "F"
        elif c in "WY":
            out += c if after and after in vowels else ""
        elif c == "X":
            out += "KS"
        elif c == "Z":
            out += "S"
        else:
            out += c
    return out[:most]


def metaphone(s: Column, most: int = 255) -> Column:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return a.map(lambda x: None if x is None else _metaphone(x, most))

    return run(s)
