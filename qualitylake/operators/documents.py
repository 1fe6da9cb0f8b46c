"""Documents of runs of any size, written in parts.

A part is a row of repo, run_id, section, range, piece and text; the texts of a run, in the order of range, section and
piece, are its document. Elements of all arrays are sorted by one range shuffle, and each task joins what it holds to
texts of about `limit` bytes; only an element that is larger makes a larger row. So a run may have any number of
findings, and no row, task or driver holds its document. Rules take their order from the first finding of each, which
partial aggregation finds.

Null keys make a run of their own; rows that are equal in all columns stand as often as they come; columns besides the
named ones play no part; empty tables give no rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .findings import RUN

PARTS = "repo string, run_id string, section int, range int, piece int, text string"
#: Bytes of a part.
LIMIT = 4 << 20
_KEYS = [*RUN, "section"]


def _key(file: str | Column, line: Column | None = None, rule: str | None = None, symbol: str | None = None, name: str | None = None, more: str | Column | None = None) -> Column:
    """The place of an element in its array; nulls come first."""
    none = F.lit(None).cast("string")
    c = [F.lit(None).cast("long") if line is None else line.cast("long"), *[none if x is None else F.col(x) if isinstance(x, str) else x for x in (rule, symbol, name, more)]]
    return F.struct((F.col(file) if isinstance(file, str) else file).alias("a"), *[x.alias(n) for x, n in zip(c, "bcdef", strict=True)])


def finding_key() -> Column:
    """Report order, as `finding_order` has it, and the message where ids repeat."""
    return _key("file", F.coalesce("start_line", F.lit(0)), "rule", "symbol", "id", "message")


def _pieces(limit: int):
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        at, piece, texts, size, done = None, 0, [], 0, []

        def row() -> tuple:
            return (*at, part, piece, "".join(texts))

        for batch in batches:
            for repo, run, section, first, text in zip(batch["repo"], batch["run_id"], batch["section"], batch["first"], batch["text"], strict=True):
                key = (repo, run, section)
                opens = key != at
                if opens or size >= limit:
                    if texts:
                        done.append(row())
                    at, piece, texts, size = key, 0 if opens else piece + 1, [], 0
                # the first element of an array; of rows equal to it the first
                alone = section % 2 == 0 or (opens and first)
                texts.append(text if alone else "," + text)
                size += len(text.encode("utf-8", "replace")) + 1
            if done:
                yield pd.DataFrame(done, columns=["repo", "run_id", "section", "range", "piece", "text"])
                done = []
        if texts:
            yield pd.DataFrame([row()], columns=["repo", "run_id", "section", "range", "piece", "text"])

    return join


def document_parts(frames: DataFrame, arrays: list[DataFrame], limit: int = LIMIT) -> DataFrame:
    """Parts of documents. `frames` has a row a run with `between`, the texts before, between and behind the arrays;
    each of `arrays` has a row an element with `key`, its place, and `text`, its JSON."""
    elements = reduce(DataFrame.unionByName, [a.select(*RUN, F.lit(2 * i + 1).alias("section"), "key", "text") for i, a in enumerate(arrays)])
    firsts = elements.groupBy(*_KEYS).agg(F.min("key").alias("_least")).select(*[F.col(k).alias(f"_of_{k}") for k in _KEYS], "_least")
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in _KEYS])
    marked = elements.join(firsts, met, "left").select(*_KEYS, "key", F.col("key").eqNullSafe(F.col("_least")).alias("first"), "text")
    around = frames.select(*RUN, F.posexplode("between").alias("_pos", "text")).select(*RUN, (F.col("_pos") * 2).alias("section"), F.lit(None).cast(marked.schema["key"].dataType).alias("key"), F.lit(True).alias("first"), "text")
    placed = marked.unionByName(around).repartitionByRange(*_KEYS, "key").sortWithinPartitions(*_KEYS, "key")
    return placed.select(*_KEYS, "first", "text").mapInPandas(_pieces(limit), PARTS)


def sarif_parts(findings: DataFrame, gates: DataFrame, tool: str = "qualitylake", limit: int = LIMIT) -> DataFrame:
    """SARIF 2.1.0 documents in parts: those of `to_sarif` for runs of any size. A run has a document where it has a
    gate, or a finding whose disposition is not `ignore`."""
    shown = findings.where(scoring.disposition() != "ignore").withColumn("key", finding_key())
    region = F.when(F.col("start_line").isNotNull(), F.struct(F.greatest("start_line", F.lit(1)).alias("startLine"), F.lit(1).alias("startColumn")))
    place = F.struct(F.struct(F.struct(scoring.percent_encode("file").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule").alias("ruleId"), scoring.sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.struct(scoring.fingerprint().alias("primaryLocationLineHash")).alias("partialFingerprints"), F.array(place).alias("locations"))
    results = shown.select(*RUN, "key", F.to_json(result).alias("text"))
    rules = shown.groupBy(*RUN, "rule").agg(F.min("key").alias("key")).select(*RUN, "key", F.to_json(F.struct(F.col("rule").alias("id"))).alias("text"))
    gate = gates.select(*RUN, _key("id", rule="reason", more=F.concat_ws(" ", F.col("pass").cast("string"), F.col("enforced").cast("string"))).alias("key"), F.to_json(F.struct("id", "pass", "enforced", "reason")).alias("text"))
    runs = gates.select(*RUN).union(shown.select(*RUN)).distinct()
    name = F.to_json(F.struct(F.lit(tool).alias("name")))
    head = F.concat(F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":'), F.left(name, F.length(name) - 1), F.lit(',"rules":['))
    between = F.array(head, F.lit(']}},"results":['), F.lit('],"properties":{"gates":['), F.lit("]}}]}"))
    return document_parts(runs.select(*RUN, between.alias("between")), [rules, results, gate], limit)


def report_parts(runs: DataFrame, gates: DataFrame, findings: DataFrame, engine_runs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Saved reports in parts, as `sources.reports` reads them once they are joined, with the verdict of the gates.

    `runs` has a row a report: repo, run_id and, where known, analyzer_error and scores. Gates, findings and runs of
    engines of other runs have no report."""
    failing = gates.groupBy(*RUN).agg(F.bool_or(F.coalesce("enforced", F.lit(True)) & ~F.coalesce("pass", F.lit(False))).alias("_fails"))
    failing = failing.select(*[F.col(k).alias(f"_of_{k}") for k in RUN], "_fails")
    met = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in RUN])
    error = F.coalesce("analyzer_error", F.lit(False)) if "analyzer_error" in runs.columns else F.lit(False)
    verdict = F.when(F.coalesce("_fails", F.lit(False)) | error, "fail").otherwise("pass")
    facts = F.to_json(F.struct(*RUN, verdict.alias("verdict"), error.alias("analyzer_error"), *[c for c in ("scores",) if c in runs.columns]))
    head = F.concat(F.left(facts, F.length(facts) - 1), F.lit(',"gates":['))
    frames = runs.dropDuplicates(RUN).join(failing, met, "left").select(*RUN, F.array(head, F.lit('],"findings":['), F.lit('],"runs":['), F.lit("]}")).alias("between"))
    known = frames.select(*[F.col(k).alias(f"_of_{k}") for k in RUN])

    def of_runs(df: DataFrame) -> DataFrame:
        return df.join(known, met, "left_semi")

    span = F.col("span") if "span" in findings.columns else F.struct("start_line")
    names = [c for c in ("id", "rule", "engine", "severity", "file", "message", "symbol", "suggested_action", "evidence", "disposition") if c in findings.columns]
    each = of_runs(findings).select(*RUN, finding_key().alias("key"), F.to_json(F.struct(*names, span.alias("span"))).alias("text"))
    gate = of_runs(gates).select(*RUN, _key("id", rule="reason").alias("key"), F.to_json(F.struct("id", "pass", "enforced", "reason")).alias("text"))
    shown = [c for c in ("engine", "command", "exit_code", "duration_ms", "budget_ms") if c in engine_runs.columns]
    ran = of_runs(engine_runs).select(*RUN, _key(F.lit(""), F.col("pos"), "engine").alias("key"), F.to_json(F.struct(*shown)).alias("text"))
    return document_parts(frames, [gate, each, ran], limit)


def joined(parts: DataFrame, name: str = "text") -> DataFrame:
    """A document a row, for runs whose document fits in one."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "section", "piece", "text"))), lambda p: p["text"]), "")
    return parts.groupBy(*RUN).agg(text.alias(name))


def write_parts(parts: DataFrame, path: str) -> None:
    """A folder a run, whose files, in the order of their names, are its document: line ends stand between elements."""
    parts.sortWithinPartitions(*RUN, "section", "piece").select(*RUN, "text").write.mode("overwrite").partitionBy(*RUN).text(path)
