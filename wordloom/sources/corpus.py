"""File-based corpus readers. Each file is one document (``wholetext``), read
in parallel by Spark; names come from the ``_metadata`` column, classes from
the parent directory. Ids number the files from 1 in the order of their paths,
so no two files share one, and come with the path."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.html import strip_html
from ..operators.ranking import dense_index


def _files(spark: SparkSession, paths: Iterable[str], recursive: bool = False) -> DataFrame:
    # wholetext must be the keyword: ``text()`` would override an option() with its default
    df = spark.read.text(list(paths), wholetext=True, recursiveFileLookup=recursive or None)
    return df.select(F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def numbered(files: DataFrame) -> DataFrame:
    """``files`` with doc_id: 1, 2, ... in path order (only the paths are sorted)."""
    ids = dense_index(files.select("path").distinct(), [F.asc("path")], name="doc_id")
    return files.join(ids, "path")


def read_corpus(spark: SparkSession, sides: dict[str, list[str]], skip_ext: str = ".pdf") -> DataFrame:
    """(doc_id, name, side, text): one row per file of each directory of each
    side; sub-directories are not entered; ``skip_ext`` files are left out."""
    parts = []
    for side, dirs in sides.items():
        if not dirs:
            continue
        df = _files(spark, dirs).where(~F.lower("name").endswith(skip_ext)) if skip_ext \
            else _files(spark, dirs)
        parts.append(df.withColumn("side", F.lit(side)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out).select("doc_id", "name", "side", "text", "path")


def read_labelled(spark: SparkSession, root: str, lower: bool = True) -> DataFrame:
    """(doc_id, label, name, text) from ``root/<label>/<file>``; text lower-cased on read."""
    df = _files(spark, [f"{root.rstrip('/')}/*/*"])
    label = F.element_at(F.split("path", "/"), -2)
    text = F.lower("text") if lower else F.col("text")
    return numbered(df).select("doc_id", label.alias("label"), "name", text.alias("text"), "path")


def read_newsgroups(spark: SparkSession, root: str, subset: str = "train",
                    categories: list[str] | None = None, remove=("headers", "footers", "quotes")) -> DataFrame:
    """(doc_id, subset, label, name, text) from ``root/<subset>/<category>/<file>``;
    category filter pushed into the path listing; headers/footers/quotes removed."""
    subsets = ["train", "test"] if subset == "all" else [subset]
    cats = "{" + ",".join(categories) + "}" if categories else "*"
    df = _files(spark, [f"{root.rstrip('/')}/{s}/{cats}/*" for s in subsets])
    parts = F.split("path", "/")
    body = T.strip_newsgroup_parts("text", "headers" in remove, "footers" in remove, "quotes" in remove)
    return numbered(df).select("doc_id", F.element_at(parts, -3).alias("subset"), F.element_at(parts, -2).alias("label"),
                               "name", body.alias("text"), "path")


# fixed values — leading-byte signatures for the file-type sniffer
SIGNATURES = [
    (b"%PDF", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x89PNG", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF8", "image/gif"),
    (b"\x1f\x8b", "application/gzip"),
    (b"{\\rtf", "text/rtf"),
]
# fixed values — beginnings of text formats, after white space and in any case
TEXT_SIGNATURES = [("<!doctype html", "text/html"), ("<html", "text/html"), ("<?xml", "application/xml")]
SNIFFED = 1024  # leading bytes that are looked at


def mime_expr(content: Column) -> Column:
    """MIME type from the leading bytes; text formats are known by their first
    characters after white space, in any case. Files with a NUL byte in the first
    1024 bytes and no known signature are binary, the rest plain text."""
    expr = None
    for sig, mime in SIGNATURES:
        cond = F.substring(content, 1, len(sig)) == F.lit(bytearray(sig))
        expr = F.when(cond, F.lit(mime)) if expr is None else expr.when(cond, F.lit(mime))
    lead = F.decode(F.substring(content, 1, SNIFFED), "ISO-8859-1")
    first = F.lower(F.regexp_replace(lead, "^(\u00ef\u00bb\u00bf)?[ \\t\\r\\n\\x0B\\f]+|^\u00ef\u00bb\u00bf", ""))
    for sig, mime in TEXT_SIGNATURES:
        expr = expr.when(first.startswith(sig), F.lit(mime))
    has_nul = F.instr(lead, "\x00") > 0
    return expr.when(has_nul, F.lit("application/octet-stream")).otherwise(F.lit("text/plain"))


def sniff_mime(spark: SparkSession, paths: Iterable[str], recursive: bool = False) -> DataFrame:
    """(path, name, length, mime) of every file, from the binary file source."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.load(list(paths))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
                     mime_expr(F.col("content")).alias("mime"))


def extract_text(spark: SparkSession, paths: Iterable[str],
                 extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, name, mime, text) for each file. Plain text and XML are decoded as UTF-8, HTML
    is also stripped, both by built-in expressions; ``extractors`` maps further MIME types to a
    bytes -> text function (e.g. a PDF parser the caller brings), run in Arrow
    batches. Files whose type has none get a null text."""
    df = spark.read.format("binaryFile").load(list(paths))
    df = df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                   mime_expr(F.col("content")).alias("mime"), "content")
    decoded = F.decode("content", "UTF-8")
    own = df.where(~F.col("mime").isin(list(extractors or {})))
    text = (F.when(F.col("mime") == "text/html", strip_html(decoded))
            .when(F.col("mime").isin("text/plain", "application/xml"), decoded))
    out = own.select("path", "name", "mime", text.alias("text"))
    if not extractors:
        return out

    def run(batches):
        for pdf in batches:
            texts = [extractors[m](c) for m, c in zip(pdf["mime"], pdf["content"])]
            yield pd.DataFrame({"path": pdf["path"], "name": pdf["name"], "mime": pdf["mime"], "text": texts})

    more = df.where(F.col("mime").isin(list(extractors)))
    return out.unionByName(more.mapInPandas(run, "path string, name string, mime string, text string"))


def read_extracted(spark: SparkSession, sides: dict[str, list[str]],
                   extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(doc_id, name, side, text, path): like ``read_corpus``, but of every file whose text can be extracted."""
    parts = [extract_text(spark, dirs, extractors).where("text is not null").withColumn("side", F.lit(side))
             for side, dirs in sides.items() if dirs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return numbered(out).select("doc_id", "name", "side", "text", "path")


def read_word_vectors(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """(term, vec ARRAY<DOUBLE>) from ``term v1 ... vd`` lines (optional ``V D``
    header line skipped) or from parquet with the same columns."""
    if fmt == "parquet":
        return spark.read.parquet(path).select("term", F.col("vec").cast("array<double>"))
    parts = F.split(F.trim(F.col("value")), " +")
    df = spark.read.text(path).select(parts.alias("p")).where(F.size("p") > 2)
    return df.select(F.col("p")[0].alias("term"),
                     F.slice("p", 2, F.size("p") - 1).cast("array<double>").alias("vec"))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vector CSV ``target_names, filenames, x0..x{d-1}`` -> (label, name, vec)."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    xs = [c for c in df.columns[2:]]
    return df.select(F.col(df.columns[0]).alias("label"), F.col(df.columns[1]).alias("name"),
                     F.array(*[F.col(f"`{c}`") for c in xs]).cast("array<double>").alias("vec"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Four blank-line-separated sections per file: URL; ``sentence<TAB><TAB><TAB>label``
    lines; highlights; ``@entityN:surface`` lines. Returns
    (doc_id, name, n_sections, url, sentences ARRAY<STRUCT<sentence, label>>,
    highlights ARRAY<STRING>, entities ARRAY<STRUCT<entity, surface>>)."""
    df = _files(spark, [path])
    sec = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n\n")

    def lines(i):
        return F.filter(F.split(F.coalesce(F.element_at(sec, i), F.lit("")), "\n"),
                        lambda x: F.length(F.trim(x)) > 0)

    pat = r"^(.*?)\t+\s*(\d+)\s*$"
    sents = F.transform(lines(2), lambda x: F.struct(
        F.trim(F.regexp_extract(x, pat, 1)).alias("sentence"),
        F.regexp_extract(x, pat, 2).cast("int").alias("label")))
    ents = F.transform(lines(4), lambda x: F.struct(
        F.substring_index(x, ":", 1).alias("entity"), F.substr(x, F.instr(x, ":") + 1).alias("surface")))
    return numbered(df).select("doc_id", "name", F.size(sec).alias("n_sections"),
                     F.trim(F.element_at(sec, 1)).alias("url"), sents.alias("sentences"),
                     lines(3).alias("highlights"), ents.alias("entities"))
