r"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds are found by pattern. Beside them a scan collects *parts* of credentials:
identifiers (access ids, also short ones, and user or client names), secrets
(assigned values, also short ones, hex runs, mixed tokens) and endpoints (URLs).
A weak part alone says nothing. It is reported if complementary parts lie within
``scope`` code points of it: a weak identifier needs a secret, a weak secret an
identifier, an endpoint both. This is an interval join: parts are binned by
position, and each weak part is semi-joined with the parts of its own and the two
neighbouring bins of its document. A bin holds at most ``scope`` code points of
parts, so no group of the join is unbounded, and a semi-join emits no pairs.

Positions come from ``split`` and ``regexp_extract_all`` of one pattern: the pieces
between matches and the matches alternate, so their lengths add up to offsets.

Defined cases: a null text is the empty text (no spans); repeated rows are scanned
each, also with one id; ties of start are ordered by kind; an empty table gives
an empty result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# fixed values: the base patterns
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

NAME = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
MIXED = r"[A-Za-z0-9+/_-]{20,}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]{4,}"""
#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "weak_assign", "weak_access", "name", "mixed", "endpoint")
#: Code points between parts of one credential.
SCOPE = 300
#: Matches whose offsets are added up at once.
RUN = 128

_SPANS = "array<struct<start:int,end:int,text:string>>"


def _located(found: Column, pieces: Column) -> Column:
    """(start, end, text) of each match, from the matches and the pieces between them.

    Offsets add up inside blocks of ``RUN`` matches first, then over blocks: an array that grows match by match
    would be copied at every match, which is quadratic for texts with very many of them."""
    none, n = F.array().cast(_SPANS), F.size(found)

    def step(acc: Column, i: Column) -> Column:
        start = acc["at"] + F.char_length(F.get(pieces, i))
        end = start + F.char_length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("text")))).alias("out"))

    def run(low: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(F.sequence(low, F.least(low + RUN, n) - 1), start, step)

    def moved(acc: Column, block: Column) -> Column:
        spans = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(spans)).alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(RUN)), run)
    whole = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), moved, lambda acc: F.flatten(acc["out"]))
    return F.when(n > 0, whole).otherwise(none)


def _where(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Column ``name``: located matches of ``pattern``; ``guard`` is a cheap condition that any match implies."""
    text = F.col("text")
    df = df.withColumn("__found", F.when(guard, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__pieces", F.when(F.size("__found") > 0, F.split(text, pattern, -1)))
    return df.withColumn(name, _located(F.col("__found"), F.col("__pieces"))).drop("__found", "__pieces")


def _value_length(match: Column) -> Column:
    return F.char_length(F.regexp_extract(match, ASSIGN, 2))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, base: array of (start, rank, end), parts: array of (start, end, role, kind, weak)) of every row."""
    text = F.col("text")
    got = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    got = _where(got, "a", ASSIGN, text.contains("=") | text.contains(":"))
    got = _where(got, "k", ACCESS, text.contains("AKIA"))
    got = _where(got, "h", HEX, F.lit(True))
    got = _where(got, "u", NAME, text.contains("=") | text.contains(":"))
    got = _where(got, "m", MIXED, F.lit(True))
    got = _where(got, "e", ENDPOINT, text.contains("http"))
    base = lambda c, keep, rank: F.transform(F.filter(c, keep), lambda s: F.struct(s["start"], F.lit(rank).alias("rank"), s["end"]))
    strong_a = lambda s: _value_length(s["text"]) >= ASSIGN_LEAST
    strong_k = lambda s: F.char_length(s["text"]) >= ACCESS_LEAST
    part = lambda c, keep, role, kind, weak: F.transform(
        F.filter(c, keep), lambda s: F.struct(s["start"], s["end"], F.lit(role).alias("role"), F.lit(kind).alias("kind"), F.lit(weak).alias("weak"))
    )
    any_of = lambda s: F.lit(True)
    mixed = lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]") & ~s["text"].rlike("^[0-9a-f]+$") & ~s["text"].startswith("AKIA")
    got = got.withColumn("base", F.array_sort(F.concat(base(F.col("a"), strong_a, 0), base(F.col("k"), strong_k, 1), base(F.col("h"), any_of, 2))))
    got = got.withColumn(
        "parts",
        F.concat(
            part(F.col("a"), strong_a, "secret", 0, False),
            part(F.col("k"), strong_k, "id", 1, False),
            part(F.col("h"), any_of, "secret", 2, False),
            part(F.col("a"), lambda s: ~strong_a(s), "secret", 3, True),
            part(F.col("k"), lambda s: ~strong_k(s), "id", 4, True),
            part(F.col("u"), any_of, "id", 5, True),
            part(F.col("m"), mixed, "secret", 6, True),
            part(F.col("e"), any_of, "endpoint", 7, True),
        ),
    )
    return got.select("row", "id", "base", "parts")


def link_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, start, rank, end) of the weak parts that have complementary parts within ``scope`` and overlap no base span."""
    parts = scanned.select("row", F.explode("parts").alias("p")).select("row", "p.*")
    parts = parts.withColumn("bin", F.floor(F.col("start") / scope))
    # a part may reach over more bins than one: it stands in all it touches, and in their neighbours
    near = parts.select(
        "row", F.col("start").alias("near_start"), F.col("end").alias("near_end"), F.col("role").alias("near_role"), F.col("kind").alias("near_kind"),
        F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("end") / scope) + 1)).alias("bin"),
    )
    # the end of a long weak part may be near to what its start is not
    weak = parts.where("weak").select("row", "start", "end", "role", "kind", F.explode(F.sequence(F.col("bin"), F.floor(F.col("end") / scope))).alias("bin"))
    apart = (F.col("near_start") - F.col("end") <= scope) & (F.col("start") - F.col("near_end") <= scope)
    apart &= ~((F.col("near_start") < F.col("end")) & (F.col("start") < F.col("near_end")))

    def semi(left: DataFrame, role: str) -> DataFrame:
        right = near.where(F.col("near_role") == role)
        return left.join(right, (left.row == right.row) & (left.bin == right.bin) & apart, "left_semi")

    ids = semi(weak.where("role = 'id'"), "secret")
    secrets = semi(weak.where("role = 'secret'"), "id")
    # the two needs of an endpoint may be met from different bins that it touches
    whole = ["row", "start", "end", "kind"]
    ends = semi(weak.where("role = 'endpoint'"), "id").select(*whole).distinct().join(
        semi(weak.where("role = 'endpoint'"), "secret").select(*whole).distinct(), whole, "left_semi"
    )
    found = ids.select(*whole).union(secrets.select(*whole)).union(ends).distinct()
    # a weak part that overlaps a base span has been reported already
    base = parts.where("not weak").select("row", F.col("start").alias("base_start"), F.col("end").alias("base_end"), F.explode(F.sequence("bin", F.floor(F.col("end") / scope))).alias("bin"))
    over = (weak.row == base.row) & (weak.bin == base.bin) & (F.col("base_start") < F.col("end")) & (F.col("start") < F.col("base_end"))
    found = found.join(weak.join(base, over, "left_semi").select(*whole).distinct(), whole, "left_anti")
    return found.select("row", "start", F.col("kind").alias("rank"), "end")


def find_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of (start, rank in KINDS, end), sorted."""
    scanned = common.materialize(scan(docs, id_col, text_col))
    weak = link_parts(scanned, scope).groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("weak"))
    got = scanned.select("row", "id", "base").join(weak, "row", "left")
    spans = F.when(F.col("weak").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "weak")))
    return got.select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(common.load(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return got.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


QUERIES = {"op4_secret_scan": op4_secret_scan}


def _matches(name: str, pattern: str) -> str:
    """SQL of (doc_id, s, e, t) of the matches of a pattern."""
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""{name} AS (
  SELECT doc_id, CAST(list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS BIGINT) AS s, m[i] AS t
  FROM (SELECT doc_id, m, string_split_regex(body, {quoted}) AS p, unnest(generate_series(1, len(m))) AS i
        FROM (SELECT doc_id, body, regexp_extract_all(body, {quoted}, 0) AS m FROM d) WHERE len(m) > 0))"""


def _oracle() -> str:
    found = ", ".join(_matches(n, p) for n, p in (("a", ASSIGN), ("k", ACCESS), ("h", HEX), ("u", NAME), ("m", MIXED), ("l", ENDPOINT)))
    value = "length(regexp_extract(t, '" + ASSIGN.replace("'", "''") + "', 2))"
    near = f"x.doc_id = w.doc_id AND x.s - w.e <= {SCOPE} AND w.s - x.e <= {SCOPE} AND NOT (x.s < w.e AND w.s < x.e)"
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), {found},
parts AS (
  SELECT doc_id, s, s + length(t) AS e, 'secret' AS role, CASE WHEN {value} >= {ASSIGN_LEAST} THEN 0 ELSE 3 END AS r FROM a
  UNION ALL SELECT doc_id, s, s + length(t), 'id', CASE WHEN length(t) >= {ACCESS_LEAST} THEN 1 ELSE 4 END FROM k
  UNION ALL SELECT doc_id, s, s + length(t), 'secret', 2 FROM h
  UNION ALL SELECT doc_id, s, s + length(t), 'id', 5 FROM u
  UNION ALL SELECT doc_id, s, s + length(t), 'secret', 6 FROM m WHERE regexp_matches(t, '[0-9]') AND regexp_matches(t, '[A-Za-z]') AND NOT regexp_matches(t, '^[0-9a-f]+$') AND NOT starts_with(t, 'AKIA')
  UNION ALL SELECT doc_id, s, s + length(t), 'endpoint', 7 FROM l),
weak AS (
  SELECT DISTINCT doc_id, s, e, r FROM parts w WHERE r > 2 AND
    (role = 'secret' OR EXISTS (SELECT 1 FROM parts x WHERE {near} AND x.role = 'secret')) AND (role = 'id' OR EXISTS (SELECT 1 FROM parts x WHERE {near} AND x.role = 'id'))
    AND NOT EXISTS (SELECT 1 FROM parts b WHERE b.r <= 2 AND b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
spans AS (SELECT doc_id, s, e, r FROM parts WHERE r <= 2 UNION ALL SELECT doc_id, s, e, r FROM weak),
listed AS (
  SELECT doc_id, count(*) FILTER (r = 0) AS n_assign, count(*) FILTER (r = 1) AS n_access, count(*) FILTER (r = 2) AS n_hex,
    coalesce(string_agg(({kinds})[r + 1] || ':' || s || ':' || e, ',' ORDER BY s, r, e) FILTER (r <= 2), '') AS base, string_agg(({kinds})[r + 1] || ':' || s || ':' || e, ',' ORDER BY s, r, e) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)
"""


ORACLES = {"op4_secret_scan": _oracle()}
