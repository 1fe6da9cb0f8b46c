"""File corpora and saved reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import matches_any

SPAN = "struct<start_line:int,start_col:int,end_line:int,end_col:int>"
FINDING = f"struct<id:string,rule:string,engine:string,severity:string,file:string,message:string,span:{SPAN},symbol:string,suggested_action:string,evidence:string,disposition:string>"
REPORT = (
    "repo string, run_id string, verdict string, analyzer_error boolean, "
    "scores struct<correctness:double,efficiency:double,maintainability:double,security:double,a11y:double>, "
    "gates array<struct<id:string,pass:boolean,enforced:boolean,reason:string>>, "
    f"findings array<{FINDING}>, runs array<struct<engine:string,command:string,exit_code:int,duration_ms:bigint,budget_ms:bigint>>"
)


def read_corpus(spark: SparkSession, path: str, root: str, exclude: list[str] | None = None) -> DataFrame:
    """repo, path, size and content of all files below a folder whose first level names repositories."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + root.rstrip("/") + "/", "")
    out = f.select(F.split(rel, "/")[0].alias("repo"), F.regexp_replace(rel, "^[^/]*/", "").alias("path"), F.col("length").alias("size"), "content")
    return out.where(~matches_any("path", exclude)) if exclude else out


def with_text(files: DataFrame) -> DataFrame:
    """Content as text; bytes that are no UTF-8 become replacement characters."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Saved reports, one row each; what old ones lack has its default: enforced gates, a11y 1, no disposition."""
    return with_defaults(spark.read.schema(REPORT).json(path, multiLine=True))


def parse_reports(texts: DataFrame) -> DataFrame:
    """Reports held as JSON text in a column `report`."""
    return with_defaults(texts.select(F.from_json("report", REPORT).alias("r")).select("r.*"))


def with_defaults(reports: DataFrame) -> DataFrame:
    s = F.col("scores")
    return (
        reports.withColumn("scores", F.when(s.isNotNull(), s.withField("a11y", F.coalesce(s["a11y"], F.lit(1.0)))))
        .withColumn("gates", F.transform("gates", lambda g: g.withField("enforced", F.coalesce(g["enforced"], F.lit(True)))))
        .withColumn("findings", F.transform("findings", lambda f: f.withField("disposition", F.coalesce(f["disposition"], F.lit("")))))
        .withColumn("analyzer_error", F.coalesce("analyzer_error", F.lit(False)))
    )


def explode_reports(reports: DataFrame) -> dict[str, DataFrame]:
    """Findings, gates and engine runs of reports as tables."""
    key = ["repo", "run_id"]
    findings = reports.select(*key, F.inline("findings"))
    return {
        "findings": findings.withColumn("start_line", F.col("span.start_line")),
        "gates": reports.select(*key, F.inline("gates")),
        "engine_runs": reports.select(*key, F.posexplode("runs").alias("pos", "r")).select(*key, "pos", "r.*"),
    }


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON by repo, their verdict computed anew from the gates."""
    fails = F.exists("gates", lambda g: g["enforced"] & ~g["pass"]) | F.coalesce("analyzer_error", F.lit(False))
    reports.withColumn("verdict", F.when(fails, "fail").otherwise("pass")).write.mode("overwrite").partitionBy("repo").json(path)
