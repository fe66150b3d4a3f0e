"""Code graphs: symbols, imports, package hierarchy, dependency order, degrees, projection onto the ontology."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import edge_no, node_no
from ..session import Scratch

REPOSITORY = "repo"
#: Languages and the suffix of their files.
SUFFIXES = {"python": ".py", "go": ".go"}
SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "build", "dist", "vendor", "testdata")
_SYMBOLS = "path string, package string, kind string, name string, line int, line_end int, signature string, doc string"
_LIMIT = 2000


def scan_repo(spark: SparkSession, root: str, *, suffix: str) -> DataFrame:
    """(path, package, content) of the source files below a folder: skipped and hidden folders are left out, and Go
    tests; the package is the folder, ``.`` at the top."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    base = "file:" + root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "file:/"), f"^{re.escape(base)}", "")
    out = files.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    for skipped in SKIPPED_DIRS:
        out = out.filter(~F.concat(F.lit("/"), "path").contains(f"/{skipped}/"))
    out = out.filter(~F.concat(F.lit("/"), "path").rlike(r"/\.[^/]+/"))
    if suffix == ".go":
        out = out.filter(~F.col("path").endswith("_test.go"))
    folder = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return out.withColumn("package", F.when(folder == "", F.lit(".")).otherwise(folder))


def _cut(text: str) -> str:
    text = text.strip()
    return text if len(text) <= _LIMIT else text[:_LIMIT] + "…"


def python_symbols(source: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """(kind, name, line, line_end, signature, doc): classes as STRUCT, functions in a class body as METHOD, all others as
    FUNCTION; methods carry their class in the name, the line is that of the name."""
    lines = source.splitlines(keepends=True)

    def walk(node: ast.AST, owner: str | None) -> Iterator:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                first = child.body[0]
                head = "".join(lines[child.lineno - 1 : first.lineno])
                head = "".join(lines[child.lineno - 1 : first.lineno - 1]) or head.split(":")[0] + ":"
                if first.lineno == child.lineno:
                    head = lines[child.lineno - 1][child.col_offset : first.col_offset]
                doc = ast.get_docstring(child, clean=False) or ""
                method = owner is not None and not is_class
                name = f"{owner}.{child.name}" if method else child.name
                yield ("STRUCT" if is_class else "METHOD" if method else "FUNCTION", name, child.lineno, child.end_lineno or child.lineno, _cut(head.rstrip().rstrip(":")), doc.strip())
                yield from walk(child, child.name if is_class else None)
            else:
                yield from walk(child, owner if isinstance(child, (ast.If, ast.Try, ast.With)) else None)

    yield from walk(ast.parse(source), None)


def python_imports(source: str) -> list[str]:
    """Imported module paths with slashes."""
    out = []
    for n in ast.walk(ast.parse(source)):
        if isinstance(n, ast.Import):
            out += [a.name.replace(".", "/") for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module and not n.level:
            base = n.module.replace(".", "/")
            out += [base, *(f"{base}/{a.name}" for a in n.names if a.name != "*")]
    return out


_GO_DECL = re.compile(r"^(?P<func>func\s*(?P<recv>\([^)]*\))?\s*(?P<fn>\w+)\s*(?:\[[^\]]*\])?\()|^type\s+(?P<ty>\w+)\s*(?:\[[^\]]*\])?\s*(?P<of>struct\b|interface\b|[^\s{(].*)?", re.M)


def go_symbols(source: str) -> Iterator[tuple[str, str, int, int, str, str]]:
    """As above for Go: STRUCT, INTERFACE and TYPE_ALIAS; methods carry the receiver's type; the comment right above, with
    its slashes, is the doc."""
    lines = source.split("\n")
    for m in _GO_DECL.finditer(source):
        line = source.count("\n", 0, m.start()) + 1
        brace = source.find("{", m.start())
        newline = source.find("\n", m.start())
        newline = len(source) if newline < 0 else newline
        stop = line
        if m.group("fn"):
            body = brace if brace >= 0 else newline
            signature = source[m.start() : body]
        else:
            body = brace if 0 <= brace < newline else -1
            signature = source[m.start() : newline]
        if body >= 0 and brace >= 0:
            depth, i = 0, brace
            while i < len(source):
                depth += {"{": 1, "}": -1}.get(source[i], 0)
                i += 1
                if not depth:
                    break
            stop = source.count("\n", 0, i) + 1
            if m.group("ty"):
                signature = source[m.start() : i]
        doc = lines[line - 2].strip() if line > 1 and lines[line - 2].lstrip().startswith("//") else ""
        if m.group("fn"):
            recv = re.findall(r"\*?(\w+)\s*(?:\[[^\]]*\])?\s*\)?$", (m.group("recv") or "").strip("()").strip())
            kind = "METHOD" if m.group("recv") else "FUNCTION"
            name = f"{recv[0]}.{m.group('fn')}" if recv and m.group("recv") else m.group("fn")
        else:
            of = (m.group("of") or "").strip()
            kind = "STRUCT" if of.startswith("struct") else "INTERFACE" if of.startswith("interface") else "TYPE_ALIAS"
            name = m.group("ty")
        yield kind, name, line, stop, _cut(signature), doc


def go_imports(source: str) -> list[str]:
    out = re.findall(r'^import\s+(?:\w+\s+)?"([^"]+)"', source, re.M)
    for block in re.findall(r"^import\s*\((.*?)\)", source, re.M | re.S):
        out += re.findall(r'"([^"]+)"', block)
    return out


def symbols(files: DataFrame, language: str) -> DataFrame:
    """Symbols of source files (path, package, content); files that do not parse have none."""
    reader = {"python": python_symbols, "go": go_symbols}[language]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, package, content in b[["path", "package", "content"]].itertuples(index=False):
                try:
                    out += [(path, package, *s) for s in reader(content or "")]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _SYMBOLS.split(", ")])

    return files.select("path", "package", "content").mapInPandas(run, _SYMBOLS)


def raw_imports(files: DataFrame, language: str) -> DataFrame:
    """(package, raw) import paths as written."""
    reader = {"python": python_imports, "go": go_imports}[language]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for package, content in b[["package", "content"]].itertuples(index=False):
                try:
                    out += [(package, r) for r in reader(content or "")]
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["package", "raw"])

    return files.select("package", "content").mapInPandas(run, "package string, raw string")


def import_edges(imports: DataFrame, packages: DataFrame, *, module_prefix: str | None = None) -> DataFrame:
    """(source, kind, target) between packages of the repository, distinct and without loops: by exact path, else by the
    path's parent; with a module prefix, by what follows it alone."""
    raw = imports.filter(F.coalesce("raw", F.lit("")) != "")
    if module_prefix:
        rest = F.regexp_replace(F.substring("raw", len(module_prefix) + 1, 1 << 30), "^/+", "")
        raw = raw.filter(F.col("raw").startswith(module_prefix)).withColumn("raw", F.when(rest == "", F.lit(".")).otherwise(rest))
    p = packages.select(F.col("package").alias("target")).distinct()
    exact = raw.join(p, F.col("raw") == F.col("target")).select("package", "raw", "target")
    parent = raw.join(exact.select("package", "raw"), ["package", "raw"], "left_anti").withColumn("parent", F.regexp_extract("raw", "^(.+)/[^/]*$", 1)).join(p, F.col("parent") == F.col("target")).select("package", "raw", "target")
    found = exact if module_prefix else exact.unionByName(parent)
    return found.filter(F.col("package") != F.col("target")).select(F.col("package").alias("source"), F.lit("IMPORT").alias("kind"), "target").distinct()


def package_hierarchy(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages, edges) with the direct parents that were missing and SUBPACKAGE edges; top-level packages hang on the
    repository. An inserted parent hangs on the repository, too, and gets no parent of its own."""
    real = packages.select("package").distinct()
    top = (F.col("package") == ".") | ~F.col("package").contains("/")
    parent = real.withColumn("parent", F.when(~top, F.regexp_extract("package", "^(.*)/[^/]*$", 1)))
    roots = parent.filter("parent is null").select(F.lit(REPOSITORY).alias("source"), F.lit("SUBPACKAGE").alias("kind"), F.col("package").alias("target"))
    inner = parent.filter("parent is not null").select(F.col("parent").alias("source"), F.lit("SUBPACKAGE").alias("kind"), F.col("package").alias("target"))
    missing = inner.select(F.col("source").alias("package")).distinct().join(real, "package", "left_anti")
    hung = missing.select(F.lit(REPOSITORY).alias("source"), F.explode(F.array(F.lit("CONTAINS"), F.lit("SUBPACKAGE"))).alias("kind"), F.col("package").alias("target"))
    return real.unionByName(missing), roots.unionByName(inner).unionByName(hung).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) over all edges, zero where there are none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    d = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))
    return nodes.select("id").distinct().join(d, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def dependency_levels(packages: DataFrame, edges: DataFrame) -> DataFrame:
    """(package, level): dependencies before dependents, peeled level by level; what is left in or behind a cycle has no
    level. One pair of joins a level, written to the shared folder."""
    scratch = Scratch(packages.sparkSession, "levels")
    nodes = packages.select("package").distinct()
    deps = edges.filter(F.col("kind").isin("IMPORT", "SUBPACKAGE")).join(nodes.select(F.col("package").alias("source")), "source", "left_semi").join(nodes.select(F.col("package").alias("target")), "target", "left_semi").select("source", "target").distinct()
    left, deps = scratch.write(nodes), scratch.write(deps)
    done = None
    level = 0
    while True:
        free = scratch.write(left.join(deps.select(F.col("source").alias("package")), "package", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        left = scratch.write(left.join(free.select("package"), "package", "left_anti"))
        deps = scratch.write(deps.join(free.select(F.col("package").alias("target")), "target", "left_anti"))
        level += 1
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def project_symbols(symbols_: DataFrame, imports: DataFrame, hierarchy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the ontology: packages and symbols as Asset/Implementation keyed by qualified id, files left out;
    contains, imports and subpackage edges, all EXTRACTED."""
    key = lambda c: node_no(F.lit("Asset"), F.lit("Implementation"), c, normalize=False)
    qualified = F.concat_ws("#", "package", "name")
    s = symbols_.select(key(qualified).alias("graph_node_no"), F.col("name"), F.col("doc").alias("description"), F.struct("kind", "signature", "package", F.col("path").alias("file"), "line").alias("properties"), key(F.col("package")).alias("owner"))
    links = imports.unionByName(hierarchy).filter(F.col("source") != REPOSITORY)
    label = F.when(F.col("kind") == "IMPORT", "imports").when(F.col("kind") == "SUBPACKAGE", "subpackage").otherwise("contains")
    e = links.select(key(F.col("source")).alias("source_node_no"), label.alias("name"), key(F.col("target")).alias("target_node_no")).unionByName(s.select(F.col("owner").alias("source_node_no"), F.lit("contains").alias("name"), F.col("graph_node_no").alias("target_node_no")))
    e = e.distinct().withColumns({"graph_edge_no": edge_no(F.col("source_node_no"), F.col("name"), F.col("target_node_no")), "confidence": F.lit("EXTRACTED")})
    return s.drop("owner"), e


def write_code_graph(path: str, symbols_: DataFrame, packages: DataFrame, edges: DataFrame) -> None:
    """A code graph as JSON tables below a path; each is complete once its folder has a success mark."""
    for name, df in (("symbols", symbols_), ("packages", packages), ("edges", edges)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def read_code_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, packages, edges) as written."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return read("symbols", _SYMBOLS), read("packages", "package string"), read("edges", "source string, kind string, target string")
