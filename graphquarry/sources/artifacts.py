"""Artifact files as typed rows: front matter, sections, bullets, findings, decision logs and footers by built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import file_refs, strip
from ..operators.build import PARSED
from ..operators.incremental import kind_of
from .files import front_matter

#: The states that each kind may have, the first by default, and the sections that a design's parser knows.
STATES = {"concept": ("active", "draft", "deprecated"), "convention": ("draft", "active", "deprecated"), "playbook": ("draft", "active", "deprecated"), "design": ("active", "unlinked", "deprecated"), "stack": ("open", "resolved", "outdated", "duplicate", "stale")}
REQUIRED = {"concept": ("title", "id"), "convention": ("title", "id"), "playbook": ("title", "id"), "design": ("description", "id"), "stack": ("id", "title", "created", "author")}
DESIGN_SECTIONS = ("Interface Contract", "Re-exports", "Dependencies", "Dependents", "Tests", "Complexity Warning", "Enums & constants", "Call paths", "Data flows", "Wikilinks", "Tags", "Stack", "Guardrails")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _blank(x) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def sections(body) -> Column:
    """name -> text of the second-level sections of a body; of a name that comes twice the first."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n\s*## "), 2, 1 << 20)
    pair = F.transform(F.transform(parts, lambda p: F.split(p, "\n", 2)), lambda p: F.struct(_blank(p[0]).alias("name"), F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("text")))
    first = lambda pairs, names: F.filter(pairs, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    return F.map_from_entries(_with(pair, lambda pairs: _with(pairs["name"], lambda names: first(pairs, names))))


def section(body, name: str) -> Column:
    return _section(sections(body), name)


def _section(found: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(found, F.lit(name)), F.lit(""))


def _once(value: Column) -> Column:
    """value, evaluated once a row: the optimizer copies no expression that names its partition into those above it."""
    return F.when(F.spark_partition_id() >= 0, value)


def _with(value: Column, use) -> Column:
    """use(value), where value is evaluated once however often use names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text) -> Column:
    """The lines of a text that are not blank, without white space at their ends."""
    return F.filter(F.transform(F.split(text, "\n"), _blank), lambda x: x != "")


def bullets(text, marks: str = "-") -> Column:
    """What follows a bullet (one of marks and a space) on the lines of a text."""
    return F.transform(F.filter(lines_of(text), lambda x: x.rlike(f"^[{marks}] ")), lambda x: F.substring(x, 3, 1 << 20))


def decision_log(body) -> Column:
    """The bullets of the section `Decision Log`, up to the next section."""
    return bullets(F.regexp_extract(F.concat(F.lit("\n"), body), r"(?s)\n## Decision Log[^\n]*\n(.*?)(?:\n## |\z)", 1), "-*")


def contract(text) -> Column:
    """A section's code without its fences: an outer one, and one more within it."""
    open_ = lambda a: F.when(F.coalesce(F.get(a, F.lit(0)), F.lit("")).startswith("```"), F.slice(a, 2, 1 << 20)).otherwise(a)
    close = lambda a: F.when(_blank(F.coalesce(F.get(a, F.size(a) - 1), F.lit(""))) == "```", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    x = F.filter(F.split(text, "\n"), lambda s: _blank(s) != "")
    for step in (open_, close, open_, close):
        x = _with(x, step)
    return _blank(F.array_join(x, "\n"))


def entries(text, label: str) -> Column:
    """Bullets `**name** — body`, each with the list on an indented line `label: a, b.` below it: array of (name, body, values)."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n\s*-\s+(?=\*\*)"), 2, 1 << 20)
    head = r"^\*\*([^*]+)\*\*\s*[—-]\s*([^\n]*)"
    listed = lambda p: F.regexp_extract(p, rf"\n[ \t]+{label}:([^\n]*)", 1)
    values = lambda p: F.filter(F.transform(F.split(F.regexp_replace(_blank(listed(p)), r"\.+$", ""), ","), _blank), lambda v: v != "")
    return F.transform(F.filter(parts, lambda p: p.rlike(head)), lambda p: F.struct(_blank(F.regexp_extract(p, head, 1)).alias("name"), _blank(F.regexp_extract(p, head, 2)).alias("body"), values(p).alias("values")))


def data_flows(text) -> Column:
    """Bullets `**parameter** in **location** — effect`."""
    form = r"^-\s+\*\*([^*]+)\*\*\s+in\s+\*\*([^*]+)\*\*\s*[—-]\s*(.*)$"
    return F.transform(F.filter(lines_of(text), lambda x: x.rlike(form)), lambda x: F.struct(*[_blank(F.regexp_extract(x, form, i + 1)).alias(n) for i, n in enumerate(("parameter", "location", "effect"))]))


def reexports(text) -> Column:
    """Bullets "From `module`: A, B": array of (module, names)."""
    form = r"^-\s+From\s+`([^`]+)`\s*:\s*(.+)$"
    names = lambda x: F.filter(F.transform(F.split(F.regexp_replace(F.regexp_extract(x, form, 2), r"\.+$", ""), ","), _blank), lambda v: v != "")
    return F.transform(F.filter(lines_of(text), lambda x: x.rlike(form)), lambda x: F.struct(_blank(F.regexp_extract(x, form, 1)).alias("module"), names(x).alias("names")))


def footer(text, mark: str = "kb:meta") -> Column:
    """The staleness footer, a comment `mark {k: v, ...}` on a line or mark and a line for each `k: v`: (source, source_hash, interface_hash, design_hash, generated, generator, dependents_complete); null where it is absent or broken.

    The form on one line goes first; where that is broken the other counts.
    """
    inline = F.regexp_extract(text, rf"<!--\s*{mark}\s+\{{(.*?)\}}\s*-->", 1)
    block = F.regexp_extract(text, rf"(?s)<!--\s*{mark}\n(.*?)\n-->", 1)
    bare = lambda v: F.regexp_replace(_blank(v), r"^(['\"])(.*)\1$", "$2")

    def read(body: Column, cut: str) -> Column:
        # of a key that comes twice the last counts, as in a map that is filled in order
        each = F.transform(F.transform(F.filter(F.split(body, cut), lambda x: x.contains(": ")), lambda x: F.split(x, ": ", 2)), lambda x: F.struct(_blank(x[0]).alias("key"), bare(x[1]).alias("value")))
        last = lambda pairs: F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, 1 << 20), lambda y: y["key"] == x["key"]))

        def built(m: Column) -> Column:
            get = lambda k: F.try_element_at(m, F.lit(k))
            when = get("generated").try_cast("timestamp")
            good = when.isNotNull()
            for k in ("source", "source_hash", "design_hash", "generator"):
                good = good & get(k).isNotNull()
            fields = [get(k).alias(k) for k in ("source", "source_hash", "interface_hash", "design_hash")]
            return F.when(good, F.struct(*fields, when.alias("generated"), get("generator").alias("generator"), (F.lower(F.coalesce(get("dependents_complete"), F.lit("false"))) == "true").alias("dependents_complete")))

        return F.when(body != "", _with(F.map_from_entries(_with(each, last)), built))

    return F.coalesce(read(inline, r",\s*"), read(block, "\n"))


def findings(body) -> Column:
    """The blocks `### F1`: (number, date, author, votes, accepted, body, comments), with their line of date, author and votes taken out."""
    heads = F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(r"\n### F(\d+)[ \t]*(?=\n|\z)"), 1)
    parts = F.slice(F.split(F.concat(F.lit("\n"), body), r"\n### F\d+[ \t]*(?=\n|\z)"), 2, 1 << 20)
    meta = r"\*\*Date:\*\*\s*(\S+)\s*\|\s*\*\*Author:\*\*\s*(\S+)\s*\|\s*\*\*Votes:\*\*\s*(-?\d+)(?:\s*\|\s*\*\*Accepted:\*\*\s*(true))?"
    got = lambda p, i: F.regexp_extract(p, meta, i)

    def block(p: Column, number: Column) -> Column:
        plain = F.regexp_replace(F.concat(F.lit("\n"), p), rf"\n[^\n]*{meta}[^\n]*", "")
        two = F.split(plain, r"\n[ \t]*#### Comments[ \t]*(?=\n|\z)", 2)
        return F.struct(
            number.cast("int").alias("number"), got(p, 1).try_cast("date").alias("date"), F.when(got(p, 2) != "", got(p, 2)).otherwise("unknown").alias("author"), F.coalesce(got(p, 3).try_cast("int"), F.lit(0)).alias("votes"),
            (got(p, 4) == "true").alias("accepted"), _blank(two[0]).alias("body"), lines_of(F.coalesce(F.get(two, F.lit(1)), F.lit(""))).alias("comments"),
        )

    return F.zip_with(parts, heads, block)


def post_sections(body) -> Column:
    """(problem, context, evidence, attempts) of a post's body before its findings, lines that are comments alone left out."""
    head = F.split(F.concat(F.lit("\n"), body), r"\n(?:## Findings|### F\d+[ \t]*(?=\n|\z))", 2)[0]
    head = F.regexp_replace(head, r"\n[ \t]*<!--[^\n]*-->[ \t]*(?=\n|\z)", "\n")
    part = lambda mark: F.regexp_extract(head, rf"(?s)\n{mark}[^\n]*\n(.*?)(?:\n##[#]? |\z)", 1)
    return F.struct(_blank(part("## Problem")).alias("problem"), _blank(part("### Context")).alias("context"), bullets(part("### Evidence"), "-*").alias("evidence"), bullets(part("### Attempts"), "-*").alias("attempts"))


def directory_index(text, mark: str = "kb:meta") -> Column:
    """(directory, billboard, children) of a directory's index file: its heading, the text below it, and the table rows `name | type | description`; null without a heading, a text or a footer."""
    directory = F.regexp_replace(F.regexp_extract(F.concat(F.lit("\n"), text), r"\n[ \t]*# ([^\n]*)", 1), r"/+\s*$", "")
    board = F.array_join(lines_of(F.regexp_extract(F.concat(F.lit("\n"), text), r"(?s)\n[ \t]*# [^\n]*\n(.*?)(?:\n[ \t]*## |\z)", 1)), " ")
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|\s*|\s*\|$", ""), r"\s*\|\s*"), lambda c: F.regexp_replace(c, "^`|`$", ""))
    rows = F.filter(F.transform(F.filter(lines_of(section(text, "Child Map")), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:|-]+$")), cells), lambda c: (F.size(c) >= 3) & (c[0] != "Name"))
    children = F.transform(rows, lambda c: F.struct(c[0].alias("name"), c[1].alias("type"), c[2].alias("description")))
    return F.when((_blank(directory) != "") & (_blank(board) != "") & footer(text, mark).isNotNull(), F.struct(_blank(directory).alias("directory"), board.alias("billboard"), children.alias("children")))


def typed(files: DataFrame, top: str = ".kb", mark: str = "kb:meta") -> DataFrame:
    """files (path, text) that are artifacts, with kind, error (null: parsed), fields and lists of their front matter, body, and a struct for each kind: design, post, log.

    A file without front matter, of missing fields, of a state that its kind does not have, a post without tags, a design
    without heading or footer, is a row with its error and null structs.
    """
    d = files.withColumn("kind", kind_of("path", top)).where((F.col("kind") != "source") & F.col("path").endswith(".md"))
    d = d.withColumn("m", front_matter(F.coalesce("text", F.lit("")))).select("path", "kind", "text", "m.fields", "m.lists", "m.body")
    field = lambda k: F.try_element_at("fields", F.lit(k))
    listed = lambda k: F.coalesce(F.try_element_at("lists", F.lit(k)), _strings())
    body = F.col("body")
    error = F.when(F.col("fields").isNull(), "no front matter")
    for kind, need in REQUIRED.items():
        for k in need:
            error = error.when((F.col("kind") == kind) & field(k).isNull(), f"no {k}")
    for kind, states in STATES.items():
        error = error.when((F.col("kind") == kind) & ~F.coalesce(field("status"), F.lit(states[0])).isin(*states), "unknown status")
    source = F.regexp_extract(F.concat(F.lit("\n"), body), r"\n[ \t]*# ([^\n]*)", 1)
    is_design = F.col("kind") == "design"
    d = d.withColumns({"_s": _once(F.when(is_design, sections(body))), "_f": _once(F.when(is_design, footer(F.col("text"), mark)))})
    error = error.when((F.col("kind") == "stack") & (F.size(listed("tags")) == 0), "no tags").when((F.col("kind") == "stack") & field("created").try_cast("date").isNull(), "no date")
    error = error.when((F.col("kind") == "design") & (source == ""), "no heading").when((F.col("kind") == "design") & F.col("_f").isNull(), "no footer")
    d = d.withColumn("error", _once(error))
    bare = lambda x: F.transform(x, lambda s: F.regexp_replace(s, r"^\[\[(.*)\]\]$", "$1"))
    known = F.col("_s")
    old = bullets(_section(known, "Guardrails"))
    stack = bullets(_section(known, "Stack"))
    kept = F.map_filter(F.transform_values(known, lambda k, v: _blank(F.regexp_replace(v, rf"(?s)<!--\s*{mark}(?:\n.*?\n|\s+\{{.*?\}}\s*)-->", ""))), lambda k, v: ~k.isin(*DESIGN_SECTIONS) & (v != ""))
    d = d.withColumn("_r", _once(reexports(_section(known, "Re-exports"))))
    again = F.col("_r")
    design = F.struct(
        _blank(source).alias("source"), again.alias("reexports"), F.when(F.size(again) > 0, "").otherwise(contract(_section(known, "Interface Contract"))).alias("contract"),
        bullets(_section(known, "Dependencies")).alias("dependencies"), bullets(_section(known, "Dependents")).alias("dependents"), entries(_section(known, "Enums & constants"), "Values").alias("enums"), entries(_section(known, "Call paths"), "Key hops").alias("call_paths"),
        data_flows(_section(known, "Data flows")).alias("data_flows"), bare(bullets(_section(known, "Wikilinks"))).alias("wikilinks"), bullets(_section(known, "Tags")).alias("tags"), F.when(F.size(stack) > 0, stack).otherwise(old).alias("stack"), kept.alias("other"), F.col("_f").alias("footer"),
    )
    post = F.struct(post_sections(body).alias("said"), findings(body).alias("findings"))
    of = lambda kind, x: F.when(F.col("error").isNull() & (F.col("kind") == kind), x)
    return d.withColumns({"design": of("design", design), "post": of("stack", post), "log": of("concept", decision_log(body))}).drop("_s", "_f", "_r")


def parsed(rows: DataFrame) -> DataFrame:
    """The rows of typed as build.PARSED, for full_build and LinkStore: bad files with ok = false."""
    field = lambda k: F.try_element_at("fields", F.lit(k))
    listed = lambda k: F.coalesce(F.try_element_at("lists", F.lit(k)), _strings())
    kind, none = F.col("kind"), F.lit(None).cast("string")
    default = F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (k, v[0])])
    said = F.col("post.said")
    found = F.array_join(F.transform("post.findings", lambda f: f["body"]), " ")
    parts = F.when(kind == "design", F.array(field("description"), F.col("design.contract"))).when(kind == "stack", F.array(said["problem"], said["context"], F.array_join(said["attempts"], " "), found)).when(kind == "playbook", F.array(strip(F.split(strip("body"), r"\n\s*\n", 2)[0])))
    values = {
        "path": F.col("path"), "kind": kind, "title": F.when(kind == "design", field("description")).otherwise(field("title")), "status": F.when(kind != "design", F.coalesce(field("status"), default[kind])), "code": field("id"),
        "body": F.when(kind == "design", F.array_join(F.transform("design.wikilinks", lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " ")).when(kind == "stack", "").otherwise(F.col("body")),
        "tags": F.when(kind == "design", F.col("design.tags")).otherwise(listed("tags")), "aliases": listed("aliases"), "source": F.col("design.source"),
        "files": F.when(kind == "concept", file_refs("body")).when(kind == "stack", listed("refs.files")), "concepts": F.when(kind == "stack", listed("refs.concepts")), "stack": F.col("design.stack"),
        "imports": _strings(), "directory": F.when(kind == "convention", F.coalesce(field("scope"), F.lit("project"))), "priority": F.coalesce(field("priority").try_cast("int"), F.lit(0)), "ok": F.col("error").isNull(), "sections": parts,
    }
    empty = F.array().cast("array<string>")
    return rows.select(*[(F.coalesce(values[n], empty) if t == "array<string>" else F.coalesce(values[n], none) if t == "string" else values[n]).cast(t).alias(n) for n, t in (c.split() for c in PARSED.split(", "))])
