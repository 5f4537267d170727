"""The stored symbol graph and its refresh from some changed files, which reads and writes the touched buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.python_code import FACTS
from ..sources.snapshot import Snapshot
from . import symbol_build as Z
from .traverse import cut

TABLES = {
    "files": ("file", "file string"), "facts": ("path", FACTS), "sites": ("file", f"{Z.SITES}, target long, target_file string"),
    "importers": ("candidate", "candidate string, file string"), "subclasses": ("base_file", "base_file string, file string"),
}


def _importers(facts: DataFrame) -> DataFrame:
    """(candidate, file): the files that each import would be found in, whether they exist or not."""
    i = facts.where("fact = 'import'")
    tops = F.when(F.col("kind") == "absolute", F.array(F.lit("src/"), F.lit(""))).otherwise(F.array(F.lit("")))
    each = F.flatten(F.transform(tops, lambda t: F.array(F.concat(t, "owner", F.lit(".py")), F.concat(t, "owner", F.lit("/__init__.py")))))
    return i.select(F.explode(each).alias("candidate"), F.col("path").alias("file")).distinct()


def _subclasses(sites: DataFrame) -> DataFrame:
    d = sites.where("fact = 'edge' AND kind = 'inherits' AND target IS NOT NULL")
    return d.select(F.col("target_file").alias("base_file"), "file").distinct()


def _aimed(sites: DataFrame, targets: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites with the targets found and their files."""
    at = symbols.select(F.col("id").alias("target"), F.col("file").alias("target_file"))
    found = targets.where("target IS NOT NULL").join(at, "target").select("site", "target", "target_file")
    return sites.join(found, "site", "left").select(*[c.split()[0] for c in TABLES["sites"][1].split(", ")])


class SymbolStore:
    """A symbol graph in a Snapshot: facts and sites with their targets by file; importers, an inverted index from a file, existing or
    not, to those whose imports look for it; subclasses, one from a file to those with classes below its classes.

    A refresh resolves again what may have changed: calls and class edges of the changed files, of those that import them, and
    of those with a class below any of these. So a call that nothing answered finds a new symbol only as the resolver would in
    a rebuild, one whose target moved follows it, and one whose target went is unresolved again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.store = spark, Snapshot(spark, folder, TABLES, buckets)

    def build(self, facts: DataFrame, files: DataFrame) -> int:
        """All tables from scratch; the graph is that of symbol_build.symbol_graph."""
        facts, files = cut(facts), files.select("file").distinct()
        symbols = cut(Z.symbols_of(facts))
        sites, imports = cut(Z.sites_of(facts, symbols)), cut(Z.bindings(facts, files))
        edges = cut(Z.class_targets(sites, symbols, imports))
        calls = Z.call_targets(sites, symbols, imports, Z.inherits_of(sites, edges))
        aimed = cut(_aimed(sites, edges.union(calls), symbols))
        rows = {"files": files, "facts": facts, "sites": aimed, "importers": _importers(facts), "subclasses": _subclasses(aimed)}
        return self.store.commit(self.store.newest(), {t: (d, None) for t, d in rows.items()})

    def tables(self, at: int | None = None) -> dict[str, DataFrame]:
        """symbols, calls, unresolved_calls, class_edges and class_edges_unresolved of the newest version, or of version `at`."""
        at = self.store.newest() if at is None else at
        # the size of a column file says little of its rows: whole tables are joined by merging
        symbols = Z.symbols_of(self.store.read("facts", at)).hint("merge")
        tables = Z.split_by_target(self.store.read("sites", at))
        return {"symbols": Z.with_enums(symbols, Z.promoted_enums(symbols, tables["class_edges"], tables["class_edges_unresolved"])), **tables}

    def _of(self, table: str, at: int, keys: DataFrame, key: str) -> DataFrame:
        """Rows of table with one of the keys, from their buckets."""
        keys = keys.select(F.col(keys.columns[0]).alias(key)).distinct()
        return self.store.read(table, at, self.store.buckets_of(keys, key)).join(keys, key, "left_semi")

    def _closure(self, files: DataFrame, step) -> DataFrame:
        """files (file) and all that step leads to, a level at a time."""
        seen = front = cut(files.select("file").distinct())
        while not front.isEmpty():
            front = cut(step(front).select("file").distinct().join(seen, "file", "left_anti"))
            seen = cut(seen.union(front))
        return seen

    def refresh(self, facts: DataFrame, files: DataFrame, deleted: DataFrame) -> int:
        """After files (file) changed or came, of which facts are the new ones, and others went (file): a new version equal to a rebuild."""
        s, at = self.store, self.store.newest()
        facts, files, deleted = cut(facts), cut(files.select("file").distinct()), cut(deleted.select("file").distinct())
        changed = cut(files.union(deleted).distinct())
        at_changed = s.buckets_of(changed, "file")
        present = lambda f: self._of("files", at, f, "file").join(deleted, "file", "left_anti").union(files).distinct()
        old = cut(self._of("facts", at, changed, "path"))

        # files to resolve again: changed ones, their importers, and whoever has a class below theirs
        near = cut(changed.union(self._of("importers", at, changed, "candidate").select("file")).distinct())
        affected = self._closure(near, lambda f: self._of("subclasses", at, f, "base_file"))
        affected = cut(affected.join(deleted, "file", "left_anti"))
        stored = cut(self._of("facts", at, affected.join(changed, "file", "left_anti"), "path"))
        own = cut(stored.unionByName(facts))
        candidates = cut(_importers(own).select(F.col("candidate").alias("file")).distinct())
        imports = cut(Z.bindings(own, cut(present(candidates))))

        def symbols_in(f: DataFrame) -> DataFrame:
            """Symbols of files (file): of changed ones from the new facts."""
            rest = self._of("facts", at, f.join(changed, "file", "left_anti"), "path")
            return Z.symbols_of(rest.unionByName(facts.join(f.select(F.col("file").alias("path")), "path", "left_semi")))

        asked = cut(affected.union(imports.select(F.col("module_file").alias("file"))).distinct())
        symbols = cut(symbols_in(asked))
        sites = cut(Z.sites_of(own, symbols.join(affected, "file", "left_semi")))
        edges = cut(Z.class_targets(sites, symbols, imports))
        aimed = cut(_aimed(sites.where("fact = 'edge'"), edges, symbols))

        # what is above: classes of files that are not resolved again keep their stored bases
        def above(f: DataFrame) -> DataFrame:
            rest = self._of("sites", at, f.join(affected, "file", "left_anti"), "file").where("fact = 'edge' AND kind = 'inherits'")
            return rest.unionByName(aimed.where("kind = 'inherits'").join(f, "file", "left_semi")).where("target_file IS NOT NULL").select(F.col("target_file").alias("file"))

        up = self._closure(affected, above)
        higher = cut(self._of("sites", at, up.join(affected, "file", "left_anti"), "file").where("fact = 'edge' AND kind = 'inherits' AND target IS NOT NULL"))
        inherits = Z.inherits_of(sites, edges).union(higher.select(F.col("caller").alias("cls"), F.col("target").alias("base"), "line"))
        symbols = cut(symbols.union(symbols_in(up.join(asked, "file", "left_anti"))))
        calls = Z.call_targets(sites, symbols, imports, inherits)
        aimed = cut(aimed.unionByName(_aimed(sites.where("fact = 'call'"), calls, symbols)))

        gone = affected.union(changed).distinct()
        at_sites = s.buckets_of(gone, "file")
        was = cut(s.read("sites", at, at_sites))
        before, after = cut(_subclasses(was.join(gone, "file", "left_semi"))), cut(_subclasses(aimed))
        at_bases = s.buckets_of(before.union(after), "base_file")
        lost, won = cut(_importers(old)), cut(_importers(facts))
        at_imports = s.buckets_of(lost.union(won), "candidate")
        return s.commit(at, {
            "files": (s.read("files", at, at_changed).join(changed, "file", "left_anti").union(files), at_changed),
            "facts": (s.read("facts", at, at_changed).join(changed.select(F.col("file").alias("path")), "path", "left_anti").unionByName(facts), at_changed),
            "sites": (was.join(gone, "file", "left_anti").unionByName(aimed), at_sites),
            "importers": (s.read("importers", at, at_imports).join(lost, ["candidate", "file"], "left_anti").union(won), at_imports),
            "subclasses": (s.read("subclasses", at, at_bases).join(before, ["base_file", "file"], "left_anti").union(after), at_bases),
        })
