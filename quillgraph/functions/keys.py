"""Business keys; these decide every join."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """Compatibility composition; ASCII stays on the JVM side."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)


def slug(name: Column, *, normalize: bool = True) -> Column:
    """Lower-case key of a name: white space to hyphens, other signs dropped, ``unnamed`` if nothing is left."""
    text = F.lower(F.regexp_replace(nfkc(name) if normalize else name, r"(?U)^\s+|\s+$", ""))
    kept = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", "-"), r"[^0-9a-z一-鿿\-]", "")
    return F.when(kept == "", F.lit("unnamed")).otherwise(kept)


def node_no(type_: Column, spec: Column | None, name: Column, *, normalize: bool = True) -> Column:
    """``type:spec:slug``, or ``type:slug`` without a spec."""
    s = slug(name, normalize=normalize)
    if spec is None:
        return F.concat_ws(":", type_, s)
    return F.concat_ws(":", type_, F.when(spec != "", spec), s)


def edge_no(source: Column, label: Column, target: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", source, label, target), 256), F.lit(32))


def chunk_no(doc_no: Column, index: Column) -> Column:
    return F.left(F.sha2(F.concat(doc_no, F.lit("#"), index.cast("string")), 256), F.lit(32))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def url_doc_no(url: Column) -> Column:
    """``url:`` with host and path of an address; scheme, query, fragment and closing slashes count for nothing."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"[?#].*$", "")
    return F.left(F.concat(F.lit("url:"), F.regexp_replace(bare, r"/+$", "")), F.lit(512))


def relative_doc_no(path: Column, root: str) -> Column:
    """Path below the graph's root, or the absolute path of a file elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def new_graph_no() -> str:
    return "graph_" + uuid.uuid4().hex[:8]


def new_id(prefix: str) -> str:
    """Task, run and step numbers: made at the driver only, as they are not deterministic."""
    return f"{prefix}_{uuid.uuid4().hex[:16]}"


def state_key(graph_no: str, graph_version: int, state_id: str) -> str:
    return f"{graph_no}:{graph_version}:{state_id}"
