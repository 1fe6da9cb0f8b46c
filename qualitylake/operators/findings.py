"""Findings: identity, order, roll-ups, scores, grades, verdicts and export tables.

A finding is a row of repo, run_id, id, rule, engine, severity, file, start_line, symbol, message and
suggested_action; a gate one of repo, run_id, id, pass, enforced and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, scoring

RUN = ["repo", "run_id"]
#: Gates whose findings come from an engine of another name.
GATE_ENGINES = {"types": "compile"}
NOT_PROVIDED = "not provided by this pack"


def with_fingerprint(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", scoring.fingerprint())


def with_disposition(findings: DataFrame) -> DataFrame:
    return findings.withColumn("disposition", scoring.disposition())


def finding_order() -> list[Column]:
    """File, line, rule, symbol (null first), id."""
    return [F.col("file"), F.coalesce("start_line", F.lit(0)), F.col("rule"), F.col("symbol").asc_nulls_first(), F.col("id")]


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Each run's findings with their place in report order."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*RUN).orderBy(*finding_order())))


def merged_order(findings: DataFrame) -> DataFrame:
    """The order of reports merged from several roots: file, rule, id."""
    return findings.withColumn("place", F.row_number().over(Window.partitionBy(*RUN).orderBy("file", "rule", "id")))


def unique_ids(findings: DataFrame) -> DataFrame:
    """The n-th row of an id gets `#n`, from the second on."""
    w = Window.partitionBy(*RUN, "id").orderBy(*finding_order()[:4], "message")
    n = F.row_number().over(w)
    return findings.withColumn("_n", n).withColumn("id", F.when(F.col("_n") > 1, F.concat("id", F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col("id"))).drop("_n")


def list_findings(findings: DataFrame, severity: str | None = None) -> DataFrame:
    return findings if severity is None else findings.where(F.col("severity") == severity)


def explain(findings: DataFrame, finding_id: str) -> DataFrame:
    return findings.where(F.col("id") == finding_id)


def unavailable(findings: DataFrame) -> DataFrame:
    """Engines that could not run, and what would fix it."""
    return findings.where(F.col("rule") == "engine.unavailable").select(*RUN, "engine", "message", "suggested_action")


def prefix_paths(findings: DataFrame, prefix: str | Column) -> DataFrame:
    """Paths of a sub-root as paths of its repository; the root `.` leaves them alone."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return findings.withColumn("file", F.when(p == ".", F.col("file")).when(F.col("file") == ".", p).otherwise(F.concat_ws("/", p, "file")))


def append_new(findings: DataFrame, more: DataFrame) -> DataFrame:
    """All rows of both, equal rows once."""
    return findings.unionByName(more).dropDuplicates()


# ------------------------------------------------------------------ scores


def scores(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Five dimension scores per run: 1 less the penalties, at least 0. Runs without findings have ones.

    Penalties are summed as whole hundredths, so the order of rows can't change a score."""
    names = [*scoring.DIMENSIONS, scoring.OTHER_DIMENSION]
    cost = findings.select(*RUN, scoring.dimension().alias("d"), F.round(scoring.penalty() * 100).cast("long").alias("p"))
    sums = cost.groupBy(*RUN).agg(*[F.sum(F.when(F.col("d") == n, F.col("p")).otherwise(0)).alias(n) for n in names])
    joined = runs.select(*RUN).distinct().join(sums, RUN, "left")
    return joined.select(*RUN, *[F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(n, F.lit(0)) / 100.0).alias(n) for n in names])


def overall(scored: DataFrame) -> DataFrame:
    names = [*scoring.DIMENSIONS, scoring.OTHER_DIMENSION]
    out = scored.select(*RUN, scoring.overall(names).alias("score"))
    return out.withColumn("grade", scoring.grade("score"))


def badges(cards: DataFrame, name: str = "quality") -> DataFrame:
    """Badge JSON of cards with run columns, analyzer_error, engines (how many ran), score and grade.

    Cards without completed engines or without a score have none."""
    label = F.lit(name)
    good = F.struct(F.lit(1).alias("schemaVersion"), label.alias("label"), F.format_string("%s (%d/100)", "grade", "score").alias("message"), scoring.grade_color("grade").alias("color"))
    bad = F.struct(F.lit(1).alias("schemaVersion"), label.alias("label"), F.lit("error").alias("message"), F.lit("lightgrey").alias("color"))
    whole = cards.where(F.col("analyzer_error") | ((F.col("engines") > 0) & F.col("score").isNotNull()))
    return whole.select(*RUN, F.to_json(F.when(F.col("analyzer_error"), bad).otherwise(good)).alias("badge"))


# ------------------------------------------------------------------ gates


# What gates count, and what they add where a failure does not count
GATE_NOUNS = {"html": "markup findings", "a11y": "accessibility findings", "links": "missing files", "secrets": "secrets", "sca": "undeclared dependencies"}
ADVISORY = " (advisory; does not fail the process)"


def count_gates(findings: DataFrame, enforced: dict[str, bool], warnings_fail: tuple[str, ...] = ("a11y", "links", "sca"), runs: DataFrame | None = None, required: tuple[str, ...] = ()) -> DataFrame:
    """A gate per engine of `enforced` and run: it passes without errors, and for some engines without warnings too.

    Runs (repo, run_id) without findings pass; without `runs`, those with findings are all. `links` counts the rule
    links.missing. `lint` is always enforced: it fails on the rule lint.failed, and, where it is `required`, on an
    unavailable linter. The reason of a gate that fails and is not enforced says so."""
    counts = []
    for e in enforced:
        one = F.col("rule") == "links.missing" if e == "links" else F.col("rule") == "lint.failed" if e == "lint" else (F.col("engine") == e) & ((F.col("severity") == "error") | F.lit(e in warnings_fail))
        counts.append(F.count_if(one).alias(e))
    missing = F.count_if((F.col("engine") == "lint") & (F.col("rule") == "engine.unavailable")).alias("_missing")
    wide = findings.groupBy(*RUN).agg(*counts, missing)
    if runs is not None:
        wide = runs.select(*RUN).distinct().join(wide, RUN, "left").na.fill(0, [*enforced, "_missing"])
    noun = lambda e, n: F.lit(GATE_NOUNS[e]) if e in GATE_NOUNS else F.concat_ws(" ", F.lit(e), F.when(n == 1, "finding").otherwise("findings"))
    rows = []
    for e, on in enforced.items():
        n = F.col(e)
        if e == "lint":
            away = (F.col("_missing") > 0) & F.lit("lint" in required)
            rows.append(F.struct(F.lit(e).alias("id"), ((n == 0) & ~away).alias("pass"), F.lit(True).alias("enforced"), F.when(n > 0, "lint failed").when(away, "lint unavailable").alias("reason")))
        else:
            rows.append(F.struct(F.lit(e).alias("id"), (n == 0).alias("pass"), F.lit(on).alias("enforced"), F.when(n > 0, F.concat(n.cast("string"), F.lit(" "), noun(e, n), F.lit("" if on else ADVISORY))).alias("reason")))
    return wide.select(*RUN, F.inline(F.array(*rows)))


def verdicts(gates: DataFrame, fail_on: list[str] | None = None, errors: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Per run: whether any enforced gate failed, and whether that fails the exit code (only gates in fail_on).

    Runs of `errors` (repo, run_id) had an analyzer error and fail both; those of `runs` without a gate fail neither."""
    failed = F.col("enforced") & ~F.col("pass")
    exits = failed if fail_on is None else failed & F.col("id").isin(*fail_on)
    out = gates.groupBy(*RUN).agg(F.bool_or(failed).alias("verdict_fails"), F.bool_or(exits).alias("exit_fails"))
    if runs is not None:
        out = runs.select(*RUN).distinct().join(out, RUN, "left").na.fill(False, ["verdict_fails", "exit_fails"])
    if errors is not None:
        broken = errors.select(*RUN).distinct().withColumn("_broken", F.lit(True))
        out = out.join(broken, RUN, "full_outer").select(*RUN, (F.coalesce("verdict_fails", F.lit(False)) | F.col("_broken").isNotNull()).alias("verdict_fails"), (F.coalesce("exit_fails", F.lit(False)) | F.col("_broken").isNotNull()).alias("exit_fails"))
    return out


def outcomes(gates: DataFrame) -> DataFrame:
    """fail, pass, advisory (n) or report-only (n) per run; gates that a pack does not provide play no part."""
    own = gates.where(~F.coalesce(F.col("reason") == NOT_PROVIDED, F.lit(False)))
    counted = own.groupBy(*RUN).agg(
        F.count_if(F.col("enforced") & ~F.col("pass")).alias("failed"),
        F.count_if(~F.col("enforced") & ~F.col("pass")).alias("advisory"),
        F.count_if("enforced").alias("enforced"),
    )
    label = F.when(F.col("failed") > 0, "fail").when((F.col("enforced") == 0) & (F.col("advisory") > 0), F.format_string("report-only (%d)", "advisory")).when(F.col("advisory") > 0, F.format_string("advisory (%d)", "advisory")).otherwise("pass")
    return counted.select(*RUN, label.alias("outcome"))


def _engine_of_gate(gate: str | Column = "id") -> Column:
    g = paths.c(gate)
    out = g
    for a, b in GATE_ENGINES.items():
        out = F.when(g == a, b).otherwise(out)
    return out


def gate_findings(gates: DataFrame, findings: DataFrame, gate: str | None = None) -> DataFrame:
    """Findings with the gate they count for."""
    chosen = gates if gate is None else gates.where(F.col("id") == gate)
    named = chosen.select(*RUN, F.col("id").alias("gate"), _engine_of_gate().alias("engine"))
    return findings.join(named, [*RUN, "engine"])


def merge_roots(gates: DataFrame) -> DataFrame:
    """One gate per run and id from several roots: passes if all do, enforced if any is, reasons of failing
    roots joined in order of the root."""
    failing = F.when(~F.col("pass") & F.col("reason").isNotNull(), F.struct(F.col("root"), F.format_string("%s: %s", "root", "reason").alias("text")))
    return gates.groupBy(*RUN, "id").agg(
        F.bool_and("pass").alias("pass"),
        F.bool_or("enforced").alias("enforced"),
        F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(failing)), lambda x: x["text"]), "; "), F.lit("")).alias("reason"),
    )


# ------------------------------------------------------------------ roll-ups


def fix_summary(findings: DataFrame, above: int = 8, top: int = 5) -> DataFrame:
    """Most frequent fixes (rule and action) of runs with more than `above` findings; the rest in one row."""
    total = Window.partitionBy(*RUN)
    fixes = findings.withColumn("_all", F.count("*").over(total)).where(F.col("_all") > above).where((scoring.disposition() == "fix") & F.col("suggested_action").isNotNull())
    counted = fixes.groupBy(*RUN, "rule", "suggested_action").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy(*RUN).orderBy(F.desc("n"), "rule", "suggested_action"))).withColumn("kinds", F.count("*").over(total))
    return placed.where(F.col("place") <= top).select(*RUN, "place", "rule", "suggested_action", "n", F.greatest(F.lit(0), F.col("kinds") - top).alias("more"))


def first_findings(findings: DataFrame, n: int = 8) -> DataFrame:
    """Each run's first findings in report order, and how many more there are."""
    w = Window.partitionBy(*RUN)
    return ordered_findings(findings).withColumn("more", F.greatest(F.lit(0), F.count("*").over(w) - n)).where(F.col("place") <= n)


def engine_totals(runs: DataFrame) -> DataFrame:
    """Runs and milliseconds per engine, in order of first appearance."""
    totals = runs.groupBy("repo", "engine").agg(F.count("*").alias("runs"), F.sum("duration_ms").alias("total_ms"), F.min("pos").alias("_first"))
    return totals.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("_first"))).drop("_first")


def rule_groups(findings: DataFrame, cap: int = 50) -> DataFrame:
    """Rules with their errors and warnings: those with errors first, then rarer ones, then by name."""
    g = findings.groupBy(*RUN, "rule").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("n"))
    w = Window.partitionBy(*RUN).orderBy((F.col("errors") == 0), "n", "rule")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def a11y_groups(findings: DataFrame) -> DataFrame:
    """Accessibility findings by rule, with their distinct files in order."""
    return findings.where(F.col("engine") == "a11y").groupBy(*RUN, "rule").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))


def engine_order(engines: Column, rank: list[str], run: Column | None = None) -> Column:
    """Distinct engine names in a fixed rank, unknown ones last by name, without those in `run`."""
    known = F.array(*[F.lit(x) for x in rank])
    names = F.array_distinct(engines) if run is None else F.array_except(F.array_distinct(engines), run)
    keyed = F.transform(names, lambda x: F.struct(F.when(F.array_position(known, x) > 0, F.array_position(known, x)).otherwise(F.lit(len(rank) + 1)).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda s: s["x"])


def locate(worst: DataFrame, findings: DataFrame) -> DataFrame:
    """Functions with the id and line of their first finding (same file and symbol), if any."""
    w = Window.partitionBy(*RUN, "file", "symbol").orderBy(*finding_order())
    first = findings.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*RUN, "file", "symbol", F.col("id").alias("finding_id"), F.col("start_line").alias("finding_line"))
    return worst.join(first, [*RUN, "file", "symbol"], "left")


def fold_untested(findings: DataFrame) -> DataFrame:
    """`complexity.untested` rows folded into the `crap.over_threshold` row of the same function, as a flag."""
    untested = findings.where(F.col("rule") == "complexity.untested").where(F.col("symbol").isNotNull()).select(*RUN, "file", "symbol").distinct()
    over = findings.where(F.col("rule") == "crap.over_threshold").where(F.col("symbol").isNotNull()).select(*RUN, "file", "symbol").distinct()
    both = untested.join(over, [*RUN, "file", "symbol"]).withColumn("_both", F.lit(True))
    marked = findings.join(both, [*RUN, "file", "symbol"], "left")
    flag = F.coalesce("_both", F.lit(False))
    return marked.where(~(flag & (F.col("rule") == "complexity.untested"))).withColumn("untested", flag & (F.col("rule") == "crap.over_threshold")).drop("_both")


# ------------------------------------------------------------------ exports


def sarif_results(findings: DataFrame) -> DataFrame:
    """One row per exported result: rule, level, encoded path, region and fingerprint. Ignored findings stay out."""
    shown = findings.where(scoring.disposition() != "ignore")
    return shown.select(*RUN, "id", F.col("rule").alias("rule_id"), scoring.sarif_level().alias("level"), scoring.percent_encode("file").alias("uri"), F.greatest("start_line", F.lit(1)).alias("start_line"), "message", scoring.fingerprint().alias("fingerprint"))


def to_sarif(findings: DataFrame, gates: DataFrame, tool: str = "qualitylake") -> DataFrame:
    """A SARIF 2.1.0 document per run, results in report order, rules in order of first use.

    A run's document is one row, as the format asks: runs of more than some hundred thousand findings don't fit;
    for those use the rows of sarif_results."""
    placed = ordered_findings(findings).where(scoring.disposition() != "ignore")
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.greatest("start_line", F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn")))
    place = F.struct(F.struct(F.struct(scoring.percent_encode("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct("place", F.struct(F.col("rule").alias("ruleId"), scoring.sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(scoring.fingerprint().alias("primaryLocationLineHash")).alias("partialFingerprints"), F.array(place).alias("locations")).alias("r"))
    listed = placed.groupBy(*RUN).agg(F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    gate = F.struct("id", "pass", "enforced", "reason")
    joined = gates.groupBy(*RUN).agg(F.array_sort(F.collect_list(gate)).alias("gates")).join(listed, RUN, "full_outer")
    results = F.coalesce("results", F.array().cast(listed.schema["results"].dataType))
    rules = F.transform(F.array_distinct(F.transform(results, lambda r: r["ruleId"])), lambda x: F.struct(x.alias("id")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), results.alias("results"), F.struct(F.col("gates")).alias("properties"))
    return joined.select(*RUN, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def ticket_groups(findings: DataFrame, title: str = "Findings: ") -> DataFrame:
    """One ticket per file and symbol: key, title of at most 180 bytes and the sorted fingerprints.

    Findings with absolute or upward paths are refused: they have no group."""
    file = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    fine = findings.withColumn("file", file).where(~((F.col("file") == "") | F.col("file").startswith("/") | F.col("file").rlike("^.:") | F.col("file").rlike(r"(^|/)\.\.(/|$)")))
    name = F.when(F.col("symbol").isNull(), scoring.safe_line("file")).otherwise(F.format_string("%s (%s)", scoring.safe_line("symbol"), scoring.safe_line("file")))
    groups = fine.withColumn("fingerprint", scoring.fingerprint()).groupBy("repo", "file", "symbol").agg(F.array_sort(F.collect_list("fingerprint")).alias("fingerprints"))
    return groups.select("repo", "file", "symbol", scoring.group_key().alias("key"), scoring.truncate_bytes(F.concat(F.lit(title), name), 180).alias("title"), F.size("fingerprints").alias("n"), "fingerprints")


def ticket_comments(findings: DataFrame, limit: int = 1900) -> DataFrame:
    """The comment of each finding for its ticket, at most `limit` bytes."""
    where = F.when(F.col("start_line").isNull(), F.col("file")).otherwise(F.concat_ws(":", "file", F.col("start_line").cast("string")))
    symbol = F.when(F.col("symbol").isNull(), "").otherwise(F.concat(F.lit("\nSymbol: "), "symbol"))
    action = F.coalesce("suggested_action", F.lit("No suggested action was included in the report."))
    body = F.concat(F.lit("Finding fingerprint: "), scoring.fingerprint(), F.lit("\nRule: "), scoring.safe_line("rule"), F.lit("\nEngine: "), scoring.safe_line("engine"), F.lit("\nSeverity: "), scoring.safe_line("severity"), F.lit("\nLocation: "), where, symbol, F.lit("\nFinding: "), scoring.safe_line("message"), F.lit("\nSuggested action: "), scoring.safe_line(action))
    return findings.select("repo", "file", "symbol", scoring.fingerprint().alias("fingerprint"), scoring.truncate_bytes(body, limit).alias("body"))


def reconcile(groups: DataFrame, tickets: DataFrame, prefix: str = "group-") -> DataFrame:
    """What to do per group: create, post (with the fingerprints not yet commented), unchanged, archived or error
    (more than one ticket carries the group's label).

    tickets: id, archived, labels and comments (array of structs with `body`). Of several tickets the smallest id
    is named."""
    labelled = tickets.select("id", "archived", "comments", F.explode("labels").alias("label")).where(F.col("label").startswith(prefix))
    seen = labelled.groupBy("label").agg(F.count("*").alias("tickets"), F.min("id").alias("ticket_id"), F.min_by("archived", "id").alias("archived"), F.min_by(F.transform("comments", lambda x: x["body"]), "id").alias("bodies"))
    joined = groups.withColumn("label", F.concat(F.lit(prefix), "key")).join(seen, "label", "left")
    missing = F.filter("fingerprints", lambda f: ~F.exists(F.coalesce("bodies", F.array().cast("array<string>")), lambda b: F.contains(b, f)))
    action = F.when(F.col("tickets").isNull(), "create").when(F.col("tickets") > 1, "error").when(F.col("archived"), "archived").when(F.size(missing) > 0, "post").otherwise("unchanged")
    return joined.select("repo", "file", "symbol", "key", "ticket_id", action.alias("action"), F.when(action.isin("create", "post"), missing).alias("to_post"))
