"""HTML -> text as built-in expressions (no parser, no Python).

Comments, and scripts and styles with their contents, go; block-level tags
become line breaks, so words of adjacent blocks do not merge; all other tags
go; entities are decoded. A ``>`` inside a quoted attribute does not end a tag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_REST = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""
# fixed values: block-level elements and named entities of HTML
_BLOCK = ("address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|"
          "nav|ol|p|pre|section|table|td|th|title|tr|ul")
ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("copy", "©"),
            ("reg", "®"), ("hellip", "…"), ("mdash", "—"), ("ndash", "–"), ("lsquo", "‘"),
            ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("euro", "€")]
#: (pattern, replacement), in order; the same text works in Java and RE2.
STEPS = [(r"(?s)<!--.*?-->", ""), (r"(?is)<script\b" + _REST + r".*?</script\s*>", ""),
         (r"(?is)<style\b" + _REST + r".*?</style\s*>", ""), (r"(?i)</?(?:" + _BLOCK + r")\b" + _REST, "\n"),
         (r"<[a-zA-Z/!?]" + _REST, "")]


def sql_literal(text: str) -> str:
    return "chr(10)" if text == "\n" else "'" + text.replace("'", "''") + "'"


def strip_html(col) -> Column:
    """Visible text of a page; null for null. Numeric entities of up to six digits are decoded, ``&amp;`` last."""
    t = F.col(col) if isinstance(col, str) else col
    for pattern, to in STEPS:
        t = F.regexp_replace(t, pattern, to)
    for name, to in ENTITIES:
        t = F.replace(t, F.lit(f"&{name};"), F.lit(to))
    t = F.replace(t, F.lit("&amp;"), F.lit("&#38;"))
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#([0-9]{1,6});"), 1))
    one = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    return F.aggregate(codes, t, lambda text, n: F.replace(text, F.concat(F.lit("&#"), n, F.lit(";")), one(n)))
