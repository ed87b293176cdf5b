"""What an editor shows: ranges of diagnostics, keys at a cursor, and displayed keys."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: severities of an editor
LEVELS = {"error": 1, "warning": 2, "info": 3}


def display_key(key: Column, namespace: Column) -> Column:
    """``namespace:key``, unless the key begins with it already."""
    named = F.nullif(namespace, F.lit(""))
    return F.when(named.isNull() | F.startswith(key, F.concat(named, F.lit(":"))), key).otherwise(F.concat(named, F.lit(":"), key))


def last_segment(key: Column) -> Column:
    return F.substring_index(key, ".", -1)


def position(text: Column, offset: Column) -> tuple[Column, Column]:
    """(line, character), from zero, of an offset; a carriage return with or without a newline ends a line."""
    before = F.replace(F.substring(text, F.lit(1), F.greatest(F.lit(0), offset)), F.lit("\r\n"), F.lit("\n\0"))
    # the newline of a pair belongs to its line's end, so what follows is counted from behind it
    lines = F.split(F.replace(before, F.lit("\r"), F.lit("\n")), "\n")
    last = F.element_at(lines, -1)
    return F.size(lines) - 1, F.length(F.regexp_replace(last, "^\0", ""))


def key_on_line(line: Column, start: Column, key: Column) -> tuple[Column, Column]:
    """(start, end) of a key on its line, from a column on: in double quotes, in single ones, or bare; null if it isn't there."""
    rest = line.substr(F.greatest(start, F.lit(0)) + 1, F.length(line))
    double, single, bare = (F.instr(rest, x) for x in (F.concat(F.lit('"'), key, F.lit('"')), F.concat(F.lit("'"), key, F.lit("'")), key))
    at = F.when(double > 0, double + 1).when(single > 0, single + 1).when(bare > 0, bare)
    from_ = F.greatest(start, F.lit(0)) + at - 1
    return from_, from_ + F.length(key)


def ranges(issues: DataFrame) -> DataFrame:
    """Adds ``start_line, start_character, end_line, end_character`` (from zero): the range that an editor underlines.

    Issues: line, column, end_line, end_column (may be null), key, line_text (the line's text, or null). The given end counts, else the
    key where it stands on the line, else one character."""
    start = F.greatest(F.col("column") - 1, F.lit(0))
    given = F.col("end_line").isNotNull() & F.col("end_column").isNotNull() & ((F.col("end_line") > F.col("line")) | ((F.col("end_line") == F.col("line")) & (F.col("end_column") > F.col("column"))))
    low, high = key_on_line(F.col("line_text"), start, last_segment(F.col("key")))
    found = F.col("line_text").isNotNull() & low.isNotNull()
    line = F.greatest(F.col("line") - 1, F.lit(0))
    return issues.withColumns(
        {
            "start_line": line,
            "start_character": F.when(given, start).when(found, low).otherwise(start),
            "end_line": F.when(given, F.greatest(F.col("end_line") - 1, F.lit(0))).otherwise(line),
            "end_character": F.when(given, F.greatest(F.col("end_column") - 1, F.lit(0))).when(found, high).otherwise(start + 1),
        }
    )


def diagnostics(issues: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct diagnostics of each file with their place in it; issues: rel_path, line, column, severity, type, message."""
    level = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in LEVELS.items()], F.lit(4))
    each = issues.select("rel_path", "line", "column", level.alias("level"), "type", "message").distinct()
    place = F.row_number().over(Window.partitionBy("rel_path").orderBy("line", "column", "level", "type", "message"))
    return each.withColumn("place", place).where(F.col("place") <= most)


#: Before the first character of a line, and behind its last.
_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def usage_at(cursors: DataFrame, usages: DataFrame) -> DataFrame:
    """(cursor, ord, dynamic): the usage under each cursor (cursor, rel_path, line, character: from one), or null.

    Usages: ord, rel_path, line, column, end_line, end_column, dynamic. Both ends count; dynamic ones go first, then catalog order.
    A usage stands in each line it covers. Places and ranges are folded first (of equal ranges the first usage of each kind counts); those of a line
    go through one sweep in the order of characters, so no pairs are made."""
    rank = F.when(F.col("dynamic"), 0).when(~F.col("dynamic"), 1).otherwise(2)
    order = F.struct("rank", F.col("ord").isNull(), "ord")
    # a plain minimum is folded by hashes, one of structs would sort every usage first
    ranges = usages.where("line <= end_line").withColumn("rank", rank).groupBy("rel_path", "line", "column", "end_line", "end_column", "rank").agg(F.min("ord").alias("ord"))
    spread = ranges.withColumn("_line", F.explode(F.sequence("line", "end_line")))
    low = F.when(F.col("_line") == F.col("line"), F.col("column")).otherwise(F.lit(_FIRST)).cast("long")
    high = F.when(F.col("_line") == F.col("end_line"), F.col("end_column")).otherwise(F.lit(_LAST)).cast("long")
    held = spread.select("rel_path", F.col("_line").cast("long").alias("line"), low.alias("at"), F.lit(0).alias("role"), high.alias("until"), "ord", "rank").where("rel_path is not null and at <= until")
    kind = held.schema["ord"].dataType.simpleString()
    asked = cursors.where("rel_path is not null and line is not null").select("rel_path", F.col("line").cast("long").alias("line"), F.col("character").cast("long").alias("at")).distinct()
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    both = held.union(asked.select("rel_path", "line", "at", F.lit(1).alias("role"), none("long", "until"), none(kind, "ord"), none("int", "rank")))
    # a cursor without a character comes first, where only what covers the whole line holds it
    dealt = both.repartition("rel_path", "line").sortWithinPartitions("rel_path", "line", F.coalesce("at", F.lit(_FIRST)), "role")
    s = dealt.mapInArrow(_sweep, f"rel_path string, line bigint, at bigint, ord {kind}, rank int").alias("s")
    c = cursors.alias("c")
    same = (F.col("c.rel_path") == F.col("s.rel_path")) & (F.col("c.line") == F.col("s.line")) & F.col("c.character").eqNullSafe(F.col("s.at"))
    met = c.join(s, same, "left").select("c.cursor", F.when(F.col("c.cursor").isNotNull(), F.col("s.ord")).alias("ord"), F.when(F.col("c.cursor").isNotNull(), F.col("s.rank")).alias("rank"))
    # a cursor may stand in several places
    best = F.min_by(F.struct("ord", "rank"), F.struct(F.col("rank").isNull(), order)).over(Window.partitionBy("cursor"))
    return met.select("cursor", best.alias("b")).select("cursor", "b.ord", F.when(F.col("b.rank") < 2, F.col("b.rank") == 0).alias("dynamic"))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places with the first of the ranges that hold them; the ranges of a line that may still hold one are a heap by their order."""
    last, open_ = None, []
    for batch in batches:
        out = []
        for path, line, at, role, until, ord_, rank in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "line", "at", "role", "until", "ord", "rank"))):
            if (path, line) != last:
                last, open_ = (path, line), []
            if not role:
                heappush(open_, (rank, ord_ is None, ord_, until))
                continue
            if at is None:
                first = min((x for x in open_ if x[3] == _LAST), default=None)
            else:
                while open_ and open_[0][3] < at:
                    heappop(open_)  # characters only grow: it holds no later one either
                first = open_[0] if open_ else None
            if first is not None:
                out.append((path, line, at, first[2], first[0]))
        if out:
            types = [pa.string(), pa.int64(), pa.int64(), batch.schema.field("ord").type, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["rel_path", "line", "at", "ord", "rank"])
