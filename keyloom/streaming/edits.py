"""Edits of documents: debouncing, the last version, dirty flags and published changes.

Every function works on a streaming DataFrame as on a batch one.
Edits: uri, version, ts, kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import cut, shared_dir

#: Quiet time after which a burst of edits is analysed.
QUIET = "250 milliseconds"
#: How late an edit may come; state of older bursts is dropped.
LATE = "10 minutes"


def bursts(edits: DataFrame, quiet: str = QUIET, late: str = LATE) -> DataFrame:
    """One row for each burst of a document: its span, its edits and its last version."""
    if edits.isStreaming:
        edits = edits.withWatermark("ts", late)
    grouped = edits.groupBy(F.session_window("ts", quiet).alias("w"), "uri").agg(F.count("*").alias("edits"), F.max("version").alias("version"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("uri", "first_ts", "last_ts", "edits", "version")


def bursts_by_kind(edits: DataFrame, quiet: str = QUIET, immediate: str = "1 millisecond", late: str = LATE) -> DataFrame:
    """Bursts of a document where edits of catalogs (column immediate) don't wait for quiet: each kind has a gap of its own."""
    if edits.isStreaming:
        edits = edits.withWatermark("ts", late)
    gap = F.when(F.col("immediate"), F.lit(immediate)).otherwise(F.lit(quiet))
    grouped = edits.groupBy(F.session_window("ts", gap).alias("w"), "uri", "immediate").agg(F.count("*").alias("edits"), F.max("version").alias("version"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select("uri", "immediate", "first_ts", "last_ts", "edits", "version")


def dirty_scopes(changes: DataFrame) -> DataFrame:
    """(uri, sources, usages, config): what the changes (uri, dirty) of a scope have made stale so far."""
    return changes.groupBy("uri").agg(*[F.bool_or(F.col("dirty") == flag).alias(flag) for flag in ("sources", "usages", "config")])


def current(runs: DataFrame) -> DataFrame:
    """(uri, generation, version, stale): of all runs (uri, version, generation) the newest counts; those of older generations are dropped."""
    each = runs.groupBy("uri", "generation").agg(F.count("*").alias("n"), F.max("version").alias("version"))
    newest = F.max_by(F.struct("generation", "version", "n"), "generation").alias("r")
    return each.groupBy("uri").agg(newest, F.sum("n").alias("all")).select("uri", "r.generation", "r.version", (F.col("all") - F.col("r.n")).alias("stale"))


def fingerprint(files: DataFrame) -> int:
    """A number that changes with any file (rel_path, size, mtime) of a session: what was analysed for it may be used again."""
    one = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("rel_path", "size", "mtime").cast("decimal(38,0)")).alias("h")).first()
    return hash((one["n"], one["h"]))


class SessionCache:
    """Results by the fingerprint of a session's files, for as long as the process lives; the oldest go first."""

    def __init__(self, most: int = 8):
        self.most, self.held = most, {}

    def get(self, files: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        key = fingerprint(files)
        if key in self.held:
            self.held[key] = self.held.pop(key)
        else:
            self.held[key] = cut(make(files))
            while len(self.held) > self.most:
                self.held.pop(next(iter(self.held)))
        return self.held[key]


def publish_twice(partial: DataFrame, whole: Callable[[], DataFrame], publish: Callable[[DataFrame, bool], None]) -> None:
    """Publish what is known at once, then all of it: the first are the findings that need no full analysis."""
    publish(partial, False)
    publish(whole(), True)


def latest(edits: DataFrame) -> DataFrame:
    """The last version of each document; closed ones are left out."""
    last = edits.groupBy("uri").agg(F.max_by(F.struct("version", "ts", "kind"), "version").alias("e"))
    return last.select("uri", "e.*").where("kind <> 'close'")


def dirty(path: Column) -> Column:
    """What a changed file makes stale: the configuration, the catalogs, the usages, or nothing."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(package\.json|tsconfig[^/]*\.json|[^/]*\.config\.[cm]?[jt]s|next\.config\.[^/]*)$"), "config")
        .when(low.rlike(r"\.(json|ya?ml)$"), "sources")
        .when(low.rlike(r"\.([cm]?[jt]sx?|vue|svelte|astro|html)$"), "usages")
        .otherwise("none")
    )


def published(before: DataFrame, after: DataFrame) -> DataFrame:
    """(uri, n): documents whose diagnostics (uri, item) changed, with their number now; zero clears them."""
    fold = lambda df, n, h: df.groupBy("uri").agg(F.count("*").alias(n), F.sum(F.xxhash64("item").cast("decimal(38,0)")).alias(h))
    both = fold(before.distinct(), "n0", "h0").join(fold(after.distinct(), "n", "h"), "uri", "full")
    return both.where(~(F.col("h0").eqNullSafe(F.col("h")) & F.col("n0").eqNullSafe(F.col("n")))).select("uri", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def refresh(catalog: DataFrame, touched: DataFrame, extracted: DataFrame) -> DataFrame:
    """The catalog with the rows of touched files (rel_path) replaced by what was extracted anew; deleted files lose theirs."""
    return catalog.join(touched.select("rel_path").distinct(), "rel_path", "left_anti").unionByName(extracted)


def run(edits: DataFrame, analyse: Callable[[DataFrame, int], None], quiet: str = QUIET) -> StreamingQuery:
    """Call ``analyse`` with the closed bursts of each micro-batch; one batch runs at a time."""
    where = shared_dir(edits.sparkSession)
    return bursts(edits, quiet).writeStream.outputMode("append").foreachBatch(analyse).option("checkpointLocation", where).start()
