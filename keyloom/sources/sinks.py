"""Reports of issues and coverage: JSON lines, SARIF, Markdown, HTML and the terminal's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.issues import report_order

#: Issues and keys that a report for a person lists.
TERMINAL, LISTED, TABLED = 50, 25, 40
_RED, _YELLOW, _CYAN, _BOLD, _OFF = "\x1b[31m", "\x1b[33m", "\x1b[36m", "\x1b[1m", "\x1b[0m"


def json_rows(issues: DataFrame, verbose: bool = False) -> DataFrame:
    """One JSON object for each issue; properties in a fixed order, missing ones and the reason left out. A verbose one has the
    number of related sites as well."""
    at = F.struct("rel_path", "line", "column").alias("location")
    more = [F.col("n_related").alias("related")] if verbose else []
    return issues.select(F.to_json(F.struct("type", "severity", "message", "key", at, *more, F.struct("namespace").alias("source"))).alias("value"))


def sarif_results(issues: DataFrame) -> DataFrame:
    """One SARIF result for each issue; info is a note."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("rel_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return issues.select(F.to_json(F.struct(F.col("type").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def sarif(issues: DataFrame, tool: str = "keyloom") -> str:
    """The whole report as one document. For reports that a person reads; larger ones are written as rows."""
    rules = ",".join(f'{{"id":"{r}"}}' for r in ("missing-key", "unused-key", "duplicate-key"))
    head = f'{{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{{"tool":{{"driver":{{"name":"{tool}","rules":[{rules}]}}}},"results":['
    return head + ",".join(r.value for r in sarif_results(issues).toLocalIterator()) + "]}]}"


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"[\r\n]+", " ")


def markdown_rows(issues: DataFrame) -> DataFrame:
    at = F.concat("rel_path", F.lit(":"), F.col("line").cast("string"))
    return issues.select(F.concat(F.lit("| "), F.concat_ws(" | ", "severity", "type", _escaped(F.col("key")), at, _escaped(F.col("message"))), F.lit(" |")).alias("value"))


def html_rows(issues: DataFrame) -> DataFrame:
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = [F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in ("severity", "type", "key", "rel_path", "line", "message")]
    return issues.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))


def published_rows(diagnostics: DataFrame) -> DataFrame:
    """(uri, n, value): for each file what an editor or linter gets: its diagnostics, in their order, as one JSON array."""
    one = F.struct("place", F.struct(F.col("line"), F.col("column"), F.col("level").alias("severity"), F.col("type").alias("code"), F.col("message")).alias("d"))
    rows = diagnostics.groupBy(F.col("rel_path").alias("uri")).agg(F.array_sort(F.collect_list(one)).alias("all"), F.count("*").alias("n"))
    return rows.select("uri", "n", F.to_json(F.transform("all", lambda x: x["d"])).alias("value"))


def head(issues: DataFrame, most: int = TERMINAL) -> DataFrame:
    """The first issues in the order of reports, with their ``place``: no more than a person reads."""
    order = Window.orderBy("type", "key", F.coalesce("namespace", F.lit("")), "rel_path", "line", "column")
    return report_order(issues).limit(most).withColumn("place", F.row_number().over(order))


def coverage_head(found: DataFrame, most: int = LISTED) -> DataFrame:
    """The first coverage issues by type, namespace, key and locale, with their ``place``."""
    order = ["type", F.coalesce("namespace", F.lit("")), "key", "locale"]
    return found.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


def coverage_rows(covered: DataFrame, base: str) -> DataFrame:
    """One JSON object for each key, and its coverage to four digits."""
    ns = F.when(F.col("ns") != "*", F.col("ns")).alias("namespace")
    names = [F.col("present").alias("locales"), F.col("missing").alias("missingLocales"), F.col("extra").alias("extraLocales")]
    return covered.select(F.to_json(F.struct("key", ns, F.lit(base).alias("baseLocale"), *names)).alias("value"), (F.floor(F.col("coverage") * 10000.0 + 0.5) / 10000.0).alias("coverage"))


def _counts(issues: DataFrame) -> dict[str, int]:
    return {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count("*").alias("n")).collect()}


def terminal(issues: DataFrame, root: str, color: bool = True, links: bool = False, most: int = TERMINAL) -> str:
    """A report to read: counts, and the first issues with their places; in colours and with links to files if asked for."""
    paint = (lambda code, text: f"{code}{text}{_OFF}") if color else (lambda code, text: text)
    counts = _counts(issues)
    total = sum(counts.values())
    lines = [paint(_BOLD, "Report"), f"Root: {root}", "", f"Errors: {counts.get('error', 0)}", f"Warnings: {counts.get('warning', 0)}", f"Notes: {counts.get('info', 0)}", f"Total: {total}", ""]
    shades = {"error": _RED, "warning": _YELLOW, "info": _CYAN}
    for r in head(issues, most).orderBy("place").collect():
        at = f"{r['rel_path']}:{r['line']}:{r['column']}"
        if links:
            at = f"\x1b]8;;file://{root.rstrip('/')}/{r['rel_path']}\x1b\\{at}\x1b]8;;\x1b\\"
        lines += [f"{paint(shades[r['severity']], r['severity'])} {r['type']} {at}", f"  {r['message']}"]
    if total > most:
        lines.append(f"... and {total - most} more")
    return "\n".join(lines) + "\n"


def coverage_block(covered: DataFrame, by_locale: DataFrame, overall: DataFrame, base: str, form: str = "terminal") -> str:
    """The coverage in a few lines: the percentage, locales, and the first keys that some locale lacks."""
    one = overall.first()
    each = [f"{r['locale']} {int(r['coverage'] * 1000 + 0.5) / 10}% ({r['present_count']}/{r['base_key_count']})" for r in by_locale.orderBy("locale").collect()]
    lacking = covered.where("in_base and size(missing) > 0").orderBy("ns", "key").limit(LISTED if form == "terminal" else TABLED).collect()
    keys = [(r["key"], "" if r["ns"] == "*" else r["ns"], ", ".join(r["missing"])) for r in lacking]
    if form == "markdown":
        head_ = ["## Locale coverage", "", f"Base locale: `{base}`", f"Coverage: **{one['coverage_percent']}%**", f"Missing: **{one['missing_count']}**", f"Extra: **{one['extra_count']}**", ""]
        return "\n".join(head_ + [f"- `{k}`{f' [{n}]' if n else ''}: missing in {m}" for k, n, m in keys]) + "\n"
    if form == "html":
        safe = lambda x: str(x).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        rows = "".join(f"<tr><td>{safe(k)}</td><td>{safe(n)}</td><td>{safe(m)}</td></tr>" for k, n, m in keys)
        return f"<section><h2>Locale coverage</h2><p>{safe(base)}: {one['coverage_percent']}%, missing {one['missing_count']}</p><table>{rows}</table></section>\n"
    lines = ["Locale coverage", f"  Base: {base}  Coverage: {one['coverage_percent']}%", f"  Missing: {one['missing_count']}  Extra: {one['extra_count']}", *[f"  {x}" for x in each]]
    return "\n".join(lines + [f"  x {f'[{n}] ' if n else ''}{k}: missing in {m}" for k, n, m in keys]) + "\n"


def with_coverage(report: str, block: str, form: str) -> str:
    """A report with its coverage: behind the counts in the terminal's, before Markdown and HTML; SARIF stays as it is."""
    if form in ("markdown", "html"):
        return f"{block}\n{report}"
    if form != "terminal":
        return report
    lines = report.split("\n")
    at = next((k for k, line in enumerate(lines) if line.startswith("Total: ")), -1)
    return "\n".join([*lines[: at + 1], "", *block.rstrip("\n").split("\n"), *lines[at + 1 :]])
