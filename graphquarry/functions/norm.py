"""Scalar expressions of the engine: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Prefix of an artifact code and its kind.
CODE_KINDS = {"CN": "concept", "CV": "convention", "PB": "playbook", "DS": "design", "ST": "stack"}
#: File extension and language.
LANGUAGES = {
    ".py": "Python", ".pyi": "Python Stub", ".js": "JavaScript", ".jsx": "JavaScript JSX", ".ts": "TypeScript", ".tsx": "TypeScript JSX",
    ".java": "Java", ".kt": "Kotlin", ".kts": "Kotlin Script", ".go": "Go", ".rs": "Rust", ".c": "C", ".h": "C Header", ".cpp": "C++",
    ".hpp": "C++ Header", ".cc": "C++", ".cxx": "C++", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift", ".scala": "Scala",
    ".r": "R", ".m": "Objective-C", ".mm": "Objective-C++", ".lua": "Lua", ".pl": "Perl", ".pm": "Perl", ".sh": "Shell", ".bash": "Bash",
    ".zsh": "Zsh", ".fish": "Fish", ".ps1": "PowerShell", ".bat": "Batch", ".cmd": "Batch", ".sql": "SQL", ".html": "HTML", ".htm": "HTML",
    ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less", ".xml": "XML", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML",
    ".toml": "TOML", ".ini": "INI", ".cfg": "Config", ".conf": "Config", ".md": "Markdown", ".rst": "reStructuredText", ".tex": "LaTeX",
    ".txt": "Text", ".csv": "CSV", ".tsv": "TSV", ".proto": "Protocol Buffers", ".graphql": "GraphQL", ".gql": "GraphQL", ".vue": "Vue",
    ".svelte": "Svelte", ".dart": "Dart", ".ex": "Elixir", ".exs": "Elixir", ".erl": "Erlang", ".hrl": "Erlang", ".hs": "Haskell",
    ".ml": "OCaml", ".mli": "OCaml", ".fs": "F#", ".fsx": "F#", ".clj": "Clojure", ".cljs": "ClojureScript", ".tf": "Terraform",
    ".dockerfile": "Dockerfile", ".baml": "BAML",
}
#: File name and language.
FILE_NAMES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Rakefile": "Ruby", "Gemfile": "Ruby", "Vagrantfile": "Ruby", "Justfile": "Just", "Taskfile.yml": "Task"}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ascii_lower(x) -> Column:
    """Lower case of A-Z only, as SQLite's NOCASE compares."""
    return F.translate(_c(x), _UP, _LOW)


def strip(x) -> Column:
    """Without white space of any kind at both ends; Spark's trim takes spaces only."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"^\s+", ""), r"\s+$", "")


def norm_tag(x) -> Column:
    return F.translate(F.lower(strip(x)), "_", "-")


def norm_concept(x) -> Column:
    return F.translate(F.lower(strip(x)), "-_ ", "")


def tokens(x) -> Column:
    """Lower-case parts of an identifier: cut at _ - . / white space and camel humps."""
    cut = F.regexp_replace(_c(x), r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    return F.filter(F.transform(F.split(cut, r"[_\-./\s]+"), F.lower), lambda t: t != "")


def like(x, pattern) -> Column:
    """LIKE '%pattern%' with A-Z folded; % and _ in the pattern are wildcards."""
    return F.like(ascii_lower(x), F.concat(F.lit("%"), ascii_lower(pattern), F.lit("%")))


def token_estimate(x, empty: int = 0) -> Column:
    """A quarter of the characters; an empty text has `empty` tokens and others at least that many."""
    return F.greatest(F.lit(empty), F.floor(F.length(_c(x)) / 4).cast("int"))


def slugify(x, limit: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at a word's end within limit characters."""
    s = F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    head = F.substring(s, 1, limit)
    whole = (F.length(s) <= limit) | (F.substring(s, limit + 1, 1) == "-")
    return F.when(whole, F.regexp_replace(head, r"-$", "")).when(head.contains("-"), F.regexp_replace(head, r"-[^-]*$", "")).otherwise(head)


def ancestors(path) -> Column:
    """A path's directories from the top: '.', then each prefix, the path itself last."""
    p = F.split(F.regexp_replace(_c(path), r"/+$", ""), "/")
    return F.concat(F.array(F.lit(".")), F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.array_join(F.slice(p, 1, i), "/")))


def glob_regex(glob) -> Column:
    """A glob as an anchored regular expression: ** any path, * and ? within a segment."""
    g = F.regexp_replace(_c(glob), r"([.+^${}()|\[\]\\])", r"\\$1")
    g = F.replace(F.replace(g, F.lit("**/"), F.lit("\1")), F.lit("**"), F.lit("\2"))
    g = F.replace(F.replace(g, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    return F.concat(F.lit("^"), F.replace(F.replace(g, F.lit("\1"), F.lit("(?:.*/)?")), F.lit("\2"), F.lit(".*")), F.lit("$"))


def glob_specificity(glob) -> Column:
    return F.size(F.filter(F.split(_c(glob), "/"), lambda s: s != "**"))


def wikilinks(text) -> Column:
    """Targets of [[...]] outside HTML comments, trimmed, distinct, in order of appearance."""
    clean = F.regexp_replace(_c(text), r"(?s)<!--.*?-->", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(r"\[\[([^\[\]]+)\]\]"), 1), strip))


def code_prefix(x) -> Column:
    return F.regexp_extract(_c(x), r"^([A-Z]{2})-(\d{3,})$", 1)


def code_number(x) -> Column:
    n = F.regexp_extract(_c(x), r"^([A-Z]{2})-(\d{3,})$", 2)
    return F.when(n != "", n.cast("int"))


def make_code(prefix, number) -> Column:
    return F.format_string("%s-%03d", _c(prefix), _c(number).cast("int"))


def language_of(path) -> Column:
    """The language of a file by its name, else its extension; a hidden file without one is Config, all else Text."""
    name = F.element_at(F.split(_c(path), "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))
    by = lambda pairs, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)
    return F.coalesce(by(FILE_NAMES, name), F.when((ext == "") & name.startswith("."), "Config"), by(LANGUAGES, ext), F.lit("Text"))


def summary(body) -> Column:
    """The first paragraph that is not blank, before any second-level heading."""
    head = F.split(F.concat(F.lit("\n"), _c(body)), r"\n## ", 2)[0]
    return F.coalesce(F.get(F.filter(F.transform(F.split(head, r"\n\s*\n"), strip), lambda p: p != ""), F.lit(0)), F.lit(""))


def rule(body) -> Column:
    """The text up to the first blank line."""
    return strip(F.split(strip(body), r"\n\s*\n", 2)[0])


def file_refs(body) -> Column:
    """Back-ticked paths with a slash and an extension."""
    return F.array_distinct(F.regexp_extract_all(_c(body), F.lit(r"`([^`\s]*/[^`\s]*\.[A-Za-z0-9]+)`"), 1))
