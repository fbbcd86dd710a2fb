"""Porter stemmer (M. F. Porter, "An algorithm for suffix stripping", 1980).

Applied to the *distinct vocabulary* through a pandas UDF and joined back on
the term, so each word is stemmed once however often it occurs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values — suffix rules of the published algorithm, in its order
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
         ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
         ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
         ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
         ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
         "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    if c == "y":
        return i == 0 or not _cons(w, i - 1)
    return True


def _measure(stem: str) -> int:
    n, prev = 0, None
    for i in range(len(stem)):
        cur = "c" if _cons(stem, i) else "v"
        if prev == "v" and cur == "c":
            n += 1
        prev = cur
    return n


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return (n >= 3 and _cons(w, n - 3) and not _cons(w, n - 2) and _cons(w, n - 1)
            and w[-1] not in "wxy")


def _rules(w: str, rules, min_m: int) -> str:
    for suf, rep in rules:
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            return stem + rep if _measure(stem) > min_m else w
    return w


def porter_stem(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # steps 2, 3: longest matching suffix only
    w = _rules(w, sorted(STEP2, key=lambda r: -len(r[0])), 0)
    w = _rules(w, sorted(STEP3, key=lambda r: -len(r[0])), 0)
    # step 4
    for suf in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suf):
            stem = w[: len(w) - len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(StringType())
def _stem_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else porter_stem(x))


def stem_vocabulary(terms: DataFrame) -> DataFrame:
    """(term, stem) for the distinct terms of ``terms`` (column ``term``)."""
    return terms.select("term").distinct().select("term", _stem_udf("term").alias("stem"))


def stem_counts(counts: DataFrame) -> DataFrame:
    """(doc_id, term=stem, n): counts re-keyed by stem (vocabulary stemmed once)."""
    stems = stem_vocabulary(counts)
    return (counts.join(stems, "term").groupBy("doc_id", "stem")
                  .agg(F.sum("n").alias("n")).withColumnRenamed("stem", "term"))
