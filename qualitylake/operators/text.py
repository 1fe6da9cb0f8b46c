"""Secrets, specs and test targeting over texts, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.code import test_functions
from ..sources.lines import lines_of

#: Rule, pattern and the group that holds the secret's body. Reconstructed from documented token formats.
SECRET_RULES = [
    ("secrets.aws_access_key", r"\b((?:AKIA|ASIA)[A-Z0-9]{16})\b"),
    ("secrets.aws_secret_key", r"""(?i:aws_secret_access_key|aws_secret_key|secret_key)["']?\s*[:=]\s*["']?([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])"""),
    ("secrets.github_token", r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    ("secrets.slack_token", r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    ("secrets.slack_webhook", r"(https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]{16,})"),
    ("secrets.stripe_key", r"\b((?:sk|rk)_live_[A-Za-z0-9]{16,})\b"),
    ("secrets.generic_token", r"""(?i:token)["']?\s*[:=]\s*["']([A-Za-z0-9_.-]{32,})["']"""),
]
#: Bits a character below which a body is no secret.
LEAST_ENTROPY = 3.0
PEM = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----([A-Za-z0-9+/=]{64,})"


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda ch: (n - F.length(F.replace(text, ch, F.lit("")))) / n
    return F.aggregate(F.filter(chars, lambda ch: ch != ""), F.lit(0.0), lambda a, ch: a - share(ch) * F.log2(share(ch)))


def is_sequential(text: Column) -> Column:
    """Whether most characters follow their neighbour in code-point order."""
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.ascii(F.substring(text, i + 1, F.lit(1))) - F.ascii(F.substring(text, i, F.lit(1))))
    return F.size(F.filter(steps, lambda d: (d == 1) | (d == 0))) * 2 > F.size(steps)


def secret_findings(files: DataFrame, rules: list[tuple[str, str]] | None = None, least: float = LEAST_ENTROPY) -> DataFrame:
    """repo, rule, severity, file, line and body of every place of a secret in files (repo, path, content).

    One pass: only texts and then lines that any rule's pattern meets go on, and each such line is read by all rules.
    A value stands on the line of its name. Bodies that say EXAMPLE, repeat filler, run in sequence or hold little
    entropy are dropped. Private keys are found behind string quotes, line joins and escaped line ends, and only with
    key material; each stands at the line of its own begin mark."""
    rules = rules or SECRET_RULES
    any_rule = "|".join(f"(?:{p})" for _, p in rules)
    texts = files.where(F.col("content").rlike(any_rule)).select("repo", F.col("path").alias("file"), "content")
    lines = lines_of(texts, "content", ["repo", "file"], sep="\n").where(F.col("line").rlike(any_rule))

    def bodies(rule: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line", F.lit(pattern), F.lit(1)), lambda body: F.struct(F.lit(rule).alias("rule"), body.alias("body")))

    found = lines.select("repo", "file", "pos", F.inline(F.concat(*[bodies(*r) for r in rules])))
    filler = F.col("body").rlike(r"(?i)example|x{6,}|\*{4,}|0{12,}|placeholder|changeme")
    real = found.where(~filler & ~is_sequential(F.col("body")) & (entropy(F.col("body")) >= least))
    head = [F.lit("secrets").alias("engine"), F.lit("error").alias("severity"), "file"]
    out = real.select("repo", "rule", *head, (F.col("pos") + 1).cast("int").alias("line"), "body")
    # what follows each begin mark, up to the next, with the line ends before it
    pem = files.where(F.contains("content", F.lit("PRIVATE KEY-----"))).select("repo", F.col("path").alias("file"), F.split("content", "(?=-----BEGIN )").alias("parts"))
    ends = F.transform("parts", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    each = pem.select("repo", "file", F.posexplode(F.arrays_zip("parts", ends.alias("ends"))).alias("n", "x"), ends.alias("all"))
    at = F.aggregate(F.slice("all", F.lit(1), F.col("n")), F.lit(1), lambda a, b: a + b)
    flat = F.regexp_replace("x.parts", r"""\\n|["'+\s]*[\r\n]+\s*["'+|]*|(?<=-----)["'+\s]+""", "")
    keys = each.select("repo", "file", at.alias("line"), F.explode(F.regexp_extract_all(flat, F.lit(PEM), F.lit(1))).alias("body"))
    return out.unionByName(keys.select("repo", F.lit("secrets.private_key").alias("rule"), *head, "line", F.left("body", F.lit(16)).alias("body")))


def spec_mentions(specs: DataFrame) -> DataFrame:
    """repo, and the distinct paths and (kind, name) items that a spec's text names."""
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_.\-/:]+)"), F.lit(1)), lambda t: t.contains("/") & ~t.contains("://") & F.element_at(F.split(t, "/"), -1).rlike(r"[^.]\.[A-Za-z0-9]"))
    items = F.regexp_extract_all("text", F.lit(r"\b((?:fn|struct|enum|trait|type|const) [A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return specs.select("repo", F.array_distinct(F.transform(tokens, lambda t: F.regexp_replace(t, r"[.:]+$", ""))).alias("paths"), F.array_distinct(items).alias("items"))


def spec_gaps(specs: DataFrame, files: DataFrame, pub_items: DataFrame) -> DataFrame:
    """Paths that specs name and no file has, and items they name that are not public."""
    m = spec_mentions(specs)
    p = m.select("repo", F.explode("paths").alias("path")).distinct().join(files.select("repo", "path"), ["repo", "path"], "left_anti")
    i = m.select("repo", F.explode("items").alias("item")).distinct().select("repo", F.split("item", " ")[0].alias("kind"), F.split("item", " ")[1].alias("name")).join(pub_items.select("repo", "kind", "name"), ["repo", "kind", "name"], "left_anti")
    gap = lambda df, rule, what: df.select("repo", F.lit(rule).alias("rule"), F.lit("warning").alias("severity"), what.alias("missing"))
    return gap(p, "spec.missing_file", F.col("path")).unionByName(gap(i, "spec.missing_item", F.concat_ws(" ", "kind", "name")))


def targeted_tests(test_files: DataFrame, symbols: DataFrame, most: int = 8, least: int = 3) -> DataFrame:
    """Per repo the tests of files (repo, path, content) that mention a changed symbol's last segment; more than `most`
    mean the full suite, an empty list. The tests are those that the files hold, or those of a column `tests`, an array."""
    if "tests" not in test_files.columns:
        held = test_functions(test_files).groupBy("repo", F.col("file").alias("path")).agg(F.collect_set("symbol").alias("tests"))
        test_files = test_files.join(held, ["repo", "path"])
    last = symbols.select("repo", F.element_at(F.split("symbol", "::"), -1).alias("word")).where(F.length("word") >= least).distinct()
    words = test_files.select("repo", "path", "tests", F.explode(F.array_distinct(F.split("content", r"\W+"))).alias("word"))
    hit = words.join(last, ["repo", "word"], "left_semi").select("repo", F.explode("tests").alias("test")).distinct()
    g = hit.groupBy("repo").agg(F.array_sort(F.collect_list("test")).alias("tests"))
    return g.select("repo", F.when(F.size("tests") > most, F.array().cast("array<string>")).otherwise(F.col("tests")).alias("tests"))
