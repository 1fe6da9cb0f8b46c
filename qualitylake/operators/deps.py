"""Imports against declared, local, installed and published packages.

imports: repo, file, module, line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, scoring


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each file's owning manifest directory: the nearest one above it, `.` being the root."""
    up = files.select("repo", "file", F.posexplode(paths.ancestors("file")).alias("away", "dir"))
    met = up.join(manifests.select("repo", "dir").distinct(), ["repo", "dir"])
    return met.groupBy("repo", "file").agg(F.min_by("dir", "away").alias("manifest"))


def undeclared_imports(imports: DataFrame, declared: DataFrame, local: DataFrame) -> DataFrame:
    """Imports that the owning manifest does not declare and that are no module of the repository.

    declared: repo, dir, module; local: repo, module. Dashes and underscores are the same in names."""
    owner = nearest_manifest(imports.select("repo", "file").distinct(), declared)
    i = imports.withColumn("module", scoring.module_name("module")).join(owner, ["repo", "file"], "left")
    known = declared.select("repo", F.col("dir").alias("manifest"), scoring.module_name("module").alias("module"))
    own = local.select("repo", scoring.module_name("module").alias("module"))
    return i.join(known, ["repo", "manifest", "module"], "left_anti").join(own, ["repo", "module"], "left_anti").select("repo", "file", "module", "line")


def classify_imports(imports: DataFrame, stdlib: DataFrame, declared: DataFrame, local: DataFrame, installed: DataFrame, index: DataFrame) -> DataFrame:
    """Imports that are neither standard, declared nor local, with class and distribution.

    declared, local: repo, module; installed: repo, module, distribution (of several, the first in order). Installed ones are undeclared; of the rest, those on the index are undeclared, those absent from it
    hallucinated, and those it could not tell unresolved. The index is a table: module, distribution, state."""
    rest = imports.join(stdlib.select("module"), "module", "left_anti").join(declared.select("repo", "module"), ["repo", "module"], "left_anti").join(local.select("repo", "module"), ["repo", "module"], "left_anti")
    here = installed.groupBy("repo", "module").agg(F.min("distribution").alias("_inst"))
    known = index.groupBy("module").agg(F.min_by("distribution", F.struct("state", "distribution")).alias("_dist"), F.min("state").alias("state"))
    met = rest.join(here, ["repo", "module"], "left").join(known, "module", "left")
    kind = F.when(F.col("_inst").isNotNull() | (F.col("state") == "present"), "undeclared").when(F.col("state") == "absent", "hallucinated").otherwise("unresolved")
    return met.select("repo", "file", "module", "line", kind.alias("kind"), F.coalesce("_inst", F.when(F.col("state") == "present", F.col("_dist"))).alias("distribution"))


def sca_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("repo").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("undeclared", "hallucinated", "unresolved")])


def sca_findings(classified: DataFrame) -> DataFrame:
    """Warnings for undeclared and unresolved imports, errors for hallucinated ones."""
    rule = F.when(F.col("kind") == "undeclared", "sca.undeclared_dependency").when(F.col("kind") == "hallucinated", "sca.hallucinated_import").otherwise("sca.unresolved_import")
    message = F.when(F.col("kind") == "hallucinated", F.format_string("no package named `%s` exists", "module")).otherwise(F.format_string("`%s` is imported but not declared", "module"))
    return classified.select("repo", rule.alias("rule"), F.lit("sca").alias("engine"), F.when(F.col("kind") == "hallucinated", "error").otherwise("warning").alias("severity"), "file", F.col("line").alias("start_line"), F.col("module").alias("symbol"), message.alias("message"))


def local_modules(files: DataFrame, roots: list[str] | None = None) -> DataFrame:
    """Names importable from a repository's own files: `name.py` or a package directory, directly below one of
    the roots (the repository, src, tests, test, and what is given)."""
    tops = [".", "src", "tests", "test", *(roots or [])]
    f = files.where(F.col("path").rlike(r"\.pyi?$"))
    cut = F.explode(F.array(*[F.when(F.lit(t == "."), F.col("path")).when(F.col("path").startswith(t + "/"), F.substring(F.col("path"), len(t) + 2, 1 << 20)) for t in dict.fromkeys(tops)]))
    rel = f.select("repo", cut.alias("rel")).where("rel is not null")
    return rel.select("repo", F.regexp_replace(F.split("rel", "/")[0], r"\.pyi?$", "").alias("module")).where(F.col("module") != "__init__").distinct()
