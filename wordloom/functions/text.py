"""Text cleaning and tokenising as Spark Column expressions.

Everything here is a built-in expression (regexp_replace, split, filter,
transform ...), so it stays inside the JVM and whole-stage code generation;
no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH_STOP_WORDS

# fixed values: token patterns. Java's \w is ASCII-only, so the Unicode word class is spelled
# out; the same text works in RE2 (DuckDB) for cross-checks.
WORD2_PATTERN = r"[\p{L}\p{N}_]{2,}"          # sklearn default token rule: 2+ word chars
LETTERS_ONLY_PATTERN = "[^a-zA-Z]"             # ASCII letters kept, all else -> space
PUNCT_TOKEN_PATTERN = r"[\w']+|[.,!?;/-]"      # word/apostrophe runs or one punctuation mark
# Treebank-like split; clitics are marked off first, so no look-ahead is needed
CLITIC_PATTERN = r"([\p{L}\p{N}_])(n't)"
WORD_TOKEN_PATTERN = r"n't|'[\p{L}\p{N}_]+|[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_ \t\n\x0B\f\r\x01]"
SENTENCE_BREAK = "\u0001"
# fixed values: abbreviations that a full stop does not end a sentence after
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "St", "Gen", "Col", "Capt", "Lt", "Rev", "Hon", "Sen", "Rep", "Gov",
                 "Inc", "Ltd", "Co", "Corp", "vs", "etc", "No", "Fig", "al", "e.g", "i.e", "U.S", "U.K", "a.m", "p.m"]
ABBREVIATION_BREAK = r"(^|[ \t\n(\x01])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.\x01"
WS = r"[ \t\n\x0B\f\r]+"                          # str.split() whitespace, spelled out


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lower(col) -> Column:
    return F.lower(_c(col))


def strip_url_lines(col) -> Column:
    """Drop every line that starts with http:// or https:// plus the line break after it.

    ``(?d)`` makes ``\\n`` the only line terminator, as in Python's ``re``.
    """
    return F.regexp_replace(_c(col), r"(?md)^https?://.*[\r\n]*", "")


def whitespace_tokens(col) -> Column:
    """``str.split()``: split on runs of whitespace, no empty pieces."""
    return F.filter(F.split(_c(col), WS), lambda x: x != F.lit(""))


def drop_at_tokens(col) -> Column:
    """Remove whitespace tokens starting with ``@`` and re-join with single spaces."""
    return F.array_join(F.filter(whitespace_tokens(col), lambda x: ~x.startswith("@")), " ")


def tabs_newlines_to_space(col) -> Column:
    return F.translate(_c(col), "\n\t", "  ")


def letters_only(col, pattern: str = LETTERS_ONLY_PATTERN) -> Column:
    return F.regexp_replace(_c(col), pattern, " ")


def squeeze_spaces(col) -> Column:
    return F.regexp_replace(_c(col), " +", " ")


def remove_stopwords(tokens, stops: Iterable[str] = ENGLISH_STOP_WORDS,
                     case_sensitive: bool = True) -> Column:
    """Drop stop words from a token array; duplicates of other words are kept.

    ``isin`` with a literal list becomes a hash-set lookup (InSet).
    """
    stops = list(stops)
    if case_sensitive:
        return F.filter(_c(tokens), lambda x: ~x.isin(stops))
    low = sorted({s.lower() for s in stops})
    return F.filter(_c(tokens), lambda x: ~F.lower(x).isin(low))


def clean_old_new(col, stops: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Cleaning preset of the old/new corpus comparison, as a token array.

    URL lines out, ``@`` tokens out, tabs/newlines to spaces, ASCII letters
    only, spaces squeezed, whitespace split, stop words out *case-sensitively
    and before any lower-casing* (so ``The`` survives).
    """
    text = strip_url_lines(col)
    text = drop_at_tokens(text)
    text = tabs_newlines_to_space(text)
    text = squeeze_spaces(letters_only(text))
    return remove_stopwords(whitespace_tokens(text), stops, case_sensitive=True)


def word_list(col, remove_stops: bool = False, stops: Iterable[str] = ENGLISH_STOP_WORDS) -> Column:
    """Sentence -> words: ASCII letters only, lower-cased, whitespace split,
    optionally without stop words (HTML is stripped separately, see html.py)."""
    toks = whitespace_tokens(F.lower(letters_only(col)))
    return remove_stopwords(toks, stops) if remove_stops else toks


def unicode_terms(col, min_len: int = 2) -> Column:
    r"""Lower-cased maximal runs of Unicode word characters, ``min_len`` or longer
    (sklearn's default token rule, ``[\p{L}\p{N}_]{2,}``).

    Implemented as a split on the complement class plus a length filter: the
    same tokens as ``regexp_extract_all`` with that pattern, about 3x faster
    in the JVM regex engine.
    """
    pieces = F.split(F.lower(_c(col)), r"[^\p{L}\p{N}_]+")
    return F.filter(pieces, lambda x: F.length(x) >= min_len)


def alpha_tokens(tokens) -> Column:
    """Keep tokens made only of letters (``str.isalpha``)."""
    return F.filter(_c(tokens), lambda x: x.rlike(r"^\p{L}+$"))


def punct_tokens(col) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(PUNCT_TOKEN_PATTERN), 0)


def word_tokens(col) -> Column:
    """Words with punctuation and contractions split off (did|n't, they|'re)."""
    marked = F.regexp_replace(_c(col), CLITIC_PATTERN, "$1" + SENTENCE_BREAK + "$2")
    return F.regexp_extract_all(marked, F.lit(WORD_TOKEN_PATTERN), 0)


def split_sentences(col) -> Column:
    """Split after ., ! or ? followed by whitespace, but not after an abbreviation; empty pieces dropped."""
    marked = F.regexp_replace(F.trim(_c(col)), r"([.!?])" + WS, "$1" + SENTENCE_BREAK)
    marked = F.regexp_replace(marked, ABBREVIATION_BREAK, "$1$2. ")
    return F.filter(F.split(marked, SENTENCE_BREAK), lambda s: F.length(s) > 0)


def sentence_words(col, remove_stops: bool = False, splitter=None) -> Column:
    """Document -> sentences -> word lists, empty sentences skipped *before*
    stop-word removal (so an empty list can reappear afterwards).

    ``splitter`` (Column -> ARRAY<STRING> Column) replaces the default
    punctuation rule, e.g. ``lambda c: F.split(c, "\\n")``.
    """
    pieces = (splitter or split_sentences)(col if not isinstance(col, str) else F.col(col))
    sents = F.transform(pieces, lambda s: word_list(s))
    sents = F.filter(sents, lambda s: F.size(s) > 0)
    if remove_stops:
        sents = F.transform(sents, lambda s: remove_stopwords(s))
    return sents


def flatten_sentences(col) -> Column:
    return F.flatten(_c(col))


def join_tokens(col) -> Column:
    return F.array_join(_c(col), " ")


# fixed values — quotation markers of the newsgroup cleaner
QUOTE_LINE_PATTERN = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"


def strip_newsgroup_header(col) -> Column:
    """Text after the first blank line; nothing when there is no blank line."""
    t = _c(col)
    pos = F.instr(t, "\n\n")
    return F.when(pos > 0, F.substr(t, pos + F.lit(2))).otherwise(F.lit(""))


def strip_newsgroup_footer(col) -> Column:
    """Cut at the last line that is blank or made of dashes (kept when it is the first line)."""
    t = _c(col)
    lines = F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), "\n")
    idx = F.array_max(F.transform(lines, lambda ln, i: F.when(ln.rlike(r"^\s*-*\s*$"), i + 1)
                                  .otherwise(F.lit(0))))
    return F.when(idx > 1, F.array_join(F.slice(lines, 1, idx - 1), "\n")).otherwise(t)


def strip_newsgroup_quotes(col) -> Column:
    kept = F.filter(F.split(_c(col), "\n"), lambda ln: ~ln.rlike(QUOTE_LINE_PATTERN))
    return F.array_join(kept, "\n")


def strip_newsgroup_parts(col, headers: bool = True, footers: bool = True,
                          quotes: bool = True) -> Column:
    """Header, then footer, then quoted lines, as the newsgroup loader removes them."""
    t = _c(col)
    if headers:
        t = strip_newsgroup_header(t)
    if footers:
        t = strip_newsgroup_footer(t)
    if quotes:
        t = strip_newsgroup_quotes(t)
    return t


def pad_sequence(seq, length: int) -> Column:
    """Keep the last ``length`` ids; left-pad with zeros."""
    s = _c(seq)
    n = F.size(s)
    start = F.greatest(n - F.lit(length), F.lit(0)) + F.lit(1)
    kept = F.slice(s, start, F.lit(length))
    pad = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(pad, kept)
