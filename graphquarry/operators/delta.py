"""The stored link graph and its update from some changed files, which reads and writes the touched buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import Snapshot
from . import build as B
from .traverse import cut

_COUNTED = f"{B.CLAIMS}, n long"
TABLES = {"parsed": ("path", B.PARSED), "names": ("key", B.NAMES), "mentions": ("key", "key string, owner string"), "links": ("owner", B.LINKS), "claims": ("path", _COUNTED)}
_CLAIM = ["path", "rank", "kind", "title", "status", "code"]


def _mentions(sites: DataFrame) -> DataFrame:
    return sites.select(F.explode("keys").alias("key"), "owner").distinct()


def _counted(claims: DataFrame, sign: int = 1) -> DataFrame:
    return claims.groupBy(*_CLAIM).agg((F.count(F.lit(1)) * sign).alias("n"))


def _less(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows without those equal to one of gone."""
    return rows.join(gone, [rows[c].eqNullSafe(gone[c]) for c in rows.columns], "left_anti")


class LinkStore:
    """A link graph in a Snapshot.

    parsed: the files' rows; names: what each file may be called by; mentions: an inverted index from a key that is looked up to
    the files that look it up; links by the file that owns them; claims: how often each path is claimed as a file, as a
    design's source and as a link's target, so that a stub goes with the last reference to it. All versions are of one commit.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.store = spark, Snapshot(spark, folder, TABLES, buckets)

    def build(self, parsed: DataFrame, present: DataFrame) -> int:
        """All tables from scratch; the graph is that of build.full_build."""
        names = B.names_of(parsed).union(B.present_names(present))
        sites = B.sites_of(parsed)
        links = cut(B.resolved(sites, names))
        claims = _counted(B.own_claims(parsed).union(B.link_claims(links)))
        rows = {"parsed": parsed, "names": names, "mentions": _mentions(sites), "links": links, "claims": claims}
        return self.store.commit(self.store.newest(), {t: (d, None) for t, d in rows.items()})

    def tables(self, at: int | None = None) -> dict[str, DataFrame]:
        """The graph of the newest version, or of version `at`."""
        at = self.store.newest() if at is None else at
        read = lambda t: self.store.read(t, at)
        return {"artifacts": B.artifacts_of(read("claims").drop("n")), "links": B.public_links(read("links")), **B.own_tables(read("parsed"))}

    def update(self, changed: DataFrame, deleted: DataFrame, appeared: DataFrame | None = None, vanished: DataFrame | None = None) -> int:
        """After files changed (PARSED rows) or were deleted (path), and source files came or went (path): a new version equal to a rebuild.

        Touched are the changed files and those that mention a name which now means something else. Their links are dropped
        and resolved again; counts of claims move by what went and came. Every read names the buckets of the touched keys.
        """
        s, at = self.store, self.store.newest()
        empty = self.spark.createDataFrame([], "path string")
        # of a file that comes twice any one row would do; the least is taken
        new = changed.groupBy("path").agg(F.min(F.struct(*[c for c in changed.columns if c != "path"])).alias("r")).select("path", "r.*").select(changed.columns)
        new = cut(new)
        paths = cut(new.select("path").union(deleted.select("path")).distinct())
        at_paths = s.buckets_of(paths, "path")
        stored = s.read("parsed", at, at_paths)
        old = cut(stored.join(paths, "path", "left_semi"))

        # names that come, go or change hands
        went = B.names_of(old).union(B.present_names(vanished if vanished is not None else empty))
        came = B.names_of(new).union(B.present_names(appeared if appeared is not None else empty))
        went, came = cut(_less(went, came)), cut(_less(came, went))
        keys = cut(went.select("key").union(came.select("key")).distinct())
        at_keys = s.buckets_of(keys, "key")

        # files whose links may change: those and whoever mentions such a name
        mention = s.read("mentions", at, at_keys).join(keys, "key", "left_semi").select(F.col("owner").alias("path")).distinct()
        others = cut(mention.join(paths, "path", "left_anti"))
        at_owners = sorted({*at_paths, *s.buckets_of(others, "path")})
        rows = new.unionByName(s.read("parsed", at, s.buckets_of(others, "path")).join(others, "path", "left_semi"))
        sites = cut(B.sites_of(rows))
        asked = _mentions(sites).select("key").distinct()
        names = _less(s.read("names", at, s.buckets_of(asked, "key")), went).union(came).distinct()
        links = cut(B.resolved(sites, names.join(asked, "key", "left_semi")))
        owners = paths.union(others).withColumnRenamed("path", "owner")
        kept = s.read("links", at, at_owners)
        dropped = cut(kept.join(owners, "owner", "left_semi"))

        moved = _counted(B.own_claims(old).union(B.link_claims(dropped)), -1).union(_counted(B.own_claims(new).union(B.link_claims(links))))
        moved = cut(moved.groupBy(*_CLAIM).agg(F.sum("n").alias("n")).where("n <> 0"))
        at_claims = s.buckets_of(moved, "path")
        claims = s.read("claims", at, at_claims).union(moved).groupBy(*_CLAIM).agg(F.sum("n").alias("n")).where("n > 0")

        before, after = (_mentions(B.sites_of(x)) for x in (old, new))
        lost, won = cut(_less(before, after)), cut(_less(after, before))
        at_mentions = s.buckets_of(lost.union(won), "key")
        return s.commit(at, {
            "parsed": (stored.join(paths, "path", "left_anti").unionByName(new), at_paths),
            "names": (_less(s.read("names", at, at_keys), went).union(came).distinct(), at_keys),
            "mentions": (_less(s.read("mentions", at, at_mentions), lost).union(won), at_mentions),
            "links": (kept.join(owners, "owner", "left_anti").union(links), at_owners),
            "claims": (claims, at_claims),
        })
