"""Repository files as tables: discovery, ignore rules, front matter and Python definitions."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 512 * 1024


def discover(spark: SparkSession, root: str, patterns: list[str] | None = None, most: int = MOST_BYTES) -> DataFrame:
    """(path, size, modified, content, sha256) of text files below root that no pattern ignores."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("length") <= most)
    at = f.select(F.regexp_extract("path", r".*?" + re.escape(root.rstrip("/")) + r"/(.*)", 1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    at = at.where(~F.contains("content", F.lit(b"\0")))
    if patterns:
        at = at.where(~ignored(patterns)(F.col("path")))
    return at.withColumn("sha256", F.sha2("content", 256))


def ignore_regex(pattern: str) -> tuple[bool, re.Pattern] | None:
    """(ignores, regular expression) of a line of an ignore file; None for blanks and comments."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    keep, p = p.startswith("!"), p.removeprefix("!")
    folder, p = p.endswith("/"), p.rstrip("/")
    anchored, p = "/" in p, p.lstrip("/")
    out = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"/\*\*", "/.*").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return not keep, re.compile(("^" if anchored else "(?:^|.*/)") + out + ("/.*" if folder else "(?:$|/.*)"))


def ignored(config: list[str], folders: dict[str, list[str]] | None = None, own: list[str] | None = None):
    """A function of a path Column: whether any list ignores it: the configured one, that of a folder above it, the tool's own.

    folders: directory (empty: the top) and the lines of its ignore file, which match paths from the top.
    """
    lists = [("", config), *sorted((folders or {}).items(), key=lambda f: -len(f[0])), ("", own or [])]
    rules = [(d and d.rstrip("/") + "/", [r for p in lines if (r := ignore_regex(p))]) for d, lines in lists]

    @F.pandas_udf("boolean")
    def run(path: pd.Series) -> pd.Series:
        out = pd.Series(False, index=path.index)
        for top, lines in rules:
            left = path[~out & path.str.startswith(top)]
            hit = pd.Series(False, index=left.index)
            for is_hit, r in lines:
                hit[left.str.match(r)] = is_hit
            out[hit.index[hit]] = True
        return out

    return run


def front_matter(text):
    """(fields, lists, body) of a text Column: `key: value` lines and lists between --- lines; null fields if there are none. An indented key is named after the one above it, as `refs.files`."""

    @F.pandas_udf("fields map<string,string>, lists map<string,array<string>>, body string")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            m = re.match(r"---\n(.*?)\n---\n?(.*)", t or "", re.S)
            if not m:
                rows.append((None, None, t))
                continue
            fields, lists, key, top = {}, {}, None, ""
            for line in m[1].split("\n"):
                if (i := re.match(r"\s*-\s+(.*)", line)) and key:
                    lists.setdefault(key, []).append(i[1].strip().strip("'\""))
                elif k := re.match(r"(\s*)(\w+):\s*(.*)", line):
                    top = top if k[1] else k[2]
                    key, v = f"{top}.{k[2]}" if k[1] else k[2], k[3].strip()
                    if v.startswith("[") and v.endswith("]"):
                        lists[key] = [x.strip().strip("'\"") for x in v[1:-1].split(",") if x.strip()]
                    else:
                        fields[key] = v.strip("'\"") if v else None
            rows.append((fields, lists, m[2]))
        return pd.DataFrame(rows, columns=["fields", "lists", "body"])

    return run(text)


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, name, qualified_name, symbol_type, line_start, line_end, visibility, parent, calls, bases) of the definitions in files (path, text); a file that does not parse has none."""
    schema = "path string, name string, qualified_name string, symbol_type string, line_start long, line_end long, visibility string, parent string, calls array<string>, bases array<string>"

    def visit(path: str, module: str, body, parent: str | None):
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                q = ".".join(x for x in (module, parent, n.name) if x)
                cls = isinstance(n, ast.ClassDef)
                bases = [ast.unparse(b) for b in n.bases] if cls else []
                kind = ("enum" if any(b.split(".")[-1] in ("Enum", "IntEnum", "StrEnum", "Flag") for b in bases) else "class") if cls else "method" if parent else "function"
                calls = [] if cls else sorted({ast.unparse(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)})
                yield path, n.name, q, kind, n.lineno, n.end_lineno, "private" if n.name.startswith("_") else "public", parent, calls, bases
                if cls:
                    yield from visit(path, module, n.body, n.name)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                rows += visit(path, path.removeprefix("src/").removesuffix(".py").replace("/", "."), tree.body, None)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "text").mapInPandas(run, schema)


def python_imports(files: DataFrame) -> DataFrame:
    """(path, module, name, local) of the imports in files (path, text), nested ones too, but not those under TYPE_CHECKING."""

    def walk(node):
        for n in ast.iter_child_nodes(node):
            if isinstance(n, ast.If) and "TYPE_CHECKING" in ast.unparse(n.test):
                for x in n.orelse:
                    yield x
                    yield from walk(x)
                continue
            yield n
            yield from walk(n)

    def run(batches):
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for n in walk(tree):
                    if isinstance(n, ast.Import):
                        rows += [(path, a.name, None, a.asname or a.name) for a in n.names]
                    elif isinstance(n, ast.ImportFrom):
                        rows += [(path, "." * n.level + (n.module or ""), a.name, a.asname or a.name) for a in n.names]
            yield pd.DataFrame(rows, columns=["path", "module", "name", "local"])

    return files.select("path", "text").mapInPandas(run, "path string, module string, name string, local string")
