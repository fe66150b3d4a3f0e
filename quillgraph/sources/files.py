"""File sources: directory scans, loaders by suffix, addresses, source classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import url_doc_no
from ..functions.text import html_to_text, title

SUFFIXES = (".md", ".txt", ".pdf", ".html", ".htm")
#: Suffixes of source code, and stems that mark a plan or design document.
CODE_SUFFIXES = (".py", ".go", ".ts", ".tsx", ".js", ".jsx", ".java", ".rs", ".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".rb", ".php", ".kt", ".swift", ".scala", ".m", ".mm")
PLAN_KEYWORDS = ("plan", "roadmap", "prd", "design", "spec", "proposal", "milestone", "schedule", "计划", "规划", "路线图", "方案", "设计", "需求", "里程碑")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def read_text(content: Column) -> Column:
    """Text of a file's bytes as UTF-8; bytes that are none become replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def _pdf_text(data: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading .pdf files needs the optional package pypdf") from e
    import io

    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)


@F.pandas_udf(T.StringType())
def pdf_to_text(s: pd.Series) -> pd.Series:
    """Text of all pages of a PDF file, one under the other."""
    return s.map(lambda b: None if b is None else _pdf_text(bytes(b)))


def load_documents(files: DataFrame) -> DataFrame:
    """(path, text) of files (path, content) by suffix; an unsupported suffix is an error."""
    suffix = suffix_of(F.col("path"))
    text = read_text(F.col("content"))
    return files.select(
        "path",
        F.when(suffix.isin(".md", ".txt"), text).when(suffix.isin(".html", ".htm"), html_to_text(text)).when(suffix == ".pdf", pdf_to_text(F.when(suffix == ".pdf", F.col("content"))))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported file: "), "path"))).alias("text"),
    )


def scan_directory(spark: SparkSession, root: str) -> DataFrame:
    """(doc_no, path, title, text, source_type) of the supported files below a folder that are not blank."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    docs = load_documents(files.filter(suffix_of(F.col("path")).isin(*SUFFIXES))).filter(F.col("text").rlike(r"(?U)\S"))
    base = root.rstrip("/") + "/"
    doc_no = F.when(F.col("path").startswith(base), F.substring("path", len(base) + 1, 1 << 30)).otherwise(F.col("path"))
    return docs.select(doc_no.alias("doc_no"), "path", title(F.col("text"), doc_no).alias("title"), "text", F.regexp_replace(suffix_of(F.col("path")), r"^\.", "").alias("source_type"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) lines of a list; blank ones and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def download(url: str) -> str:
    """A page over the network, by the standard library."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "quillgraph"}), timeout=30) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


def fetch(urls: DataFrame, fetcher: Callable[[str], str]) -> DataFrame:
    """(doc_no, origin_url, text, error) of addresses by an injected fetcher that returns HTML; an empty page or a failure
    leaves a note instead of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions.text import html_text

        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    text = html_text(fetcher(url)) or ""
                    out.append((url, text or None, None if text.strip() else "no content"))
                except Exception as e:
                    out.append((url, None, f"{type(e).__name__}: {e}"[:8000]))
            yield pd.DataFrame(out, columns=["origin_url", "text", "error"])

    return urls.select("url").mapInPandas(run, "origin_url string, text string, error string").select(url_doc_no(F.col("origin_url")).alias("doc_no"), "origin_url", "text", "error")


def source_class(path: Column, doc_title: Column) -> Column:
    """CODE by suffix, else PLAN by a stem in path or title, else DOC."""
    said = F.lower(F.concat_ws("\n", path, doc_title))
    plan = F.lit(False)
    for stem in PLAN_KEYWORDS:
        plan = plan | said.contains(stem)
    return F.when(suffix_of(path).isin(*CODE_SUFFIXES), "CODE").when(plan, "PLAN").otherwise("DOC")
