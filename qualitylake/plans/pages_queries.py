"""Queries over pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import pages as ops
from ..sources import pages as source
from .adapters import kept, view

P = "v_pages_mut"


def _parsed(spark: SparkSession, sf_dir: str, name: str = P) -> DataFrame:
    return source.parse_pages(view(spark, sf_dir, name), text_of=source.RULE_TEXT)


def _elements(spark: SparkSession, sf_dir: str, name: str = P) -> DataFrame:
    return source.page_elements(_parsed(spark, sf_dir, name))


@query("SELECT page_id, CAST(sum(n) AS BIGINT) AS elements FROM (SELECT page_id, len(regexp_extract_all(regexp_replace(regexp_replace(html, '<script>.*?</script>', '<script>', 'g'), '<!--.*?-->', '', 'g'), '<[a-zA-Z]')) AS n FROM v_pages_mut) GROUP BY page_id", P)
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _elements(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("elements"))


@query("SELECT page_id, 'html.viewport' AS rule, 1 AS line FROM v_pages_mut WHERE NOT contains(html, 'viewport') UNION ALL SELECT page_id, 'html.doctype', 1 FROM v_pages_mut WHERE NOT starts_with(lower(html), '<!doctype')", P)
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.html_findings(_parsed(spark, sf_dir)).where(F.col("rule").isin("html.viewport", "html.doctype")).select("page_id", "rule", "line")


BOLD = "len(regexp_extract_all(html, '<b>'))"


@query(f"SELECT page_id, 'html.unclosed' AS rule, 'unclosed <b>' AS message, {BOLD} AS n FROM pages WHERE {BOLD} > 0 UNION ALL SELECT page_id, 'html.misnested', 'misnested </article>', 1 FROM pages WHERE {BOLD} > 0")
def html_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages open bold text that they never close, so their article's end tag is misnested."""
    found = ops.html_findings(_parsed(spark, sf_dir, "pages")).where(F.col("rule").isin("html.unclosed", "html.misnested"))
    return found.groupBy("page_id", "rule", "message").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'a11y.html-lang' AS rule, 1 AS line FROM v_pages_mut WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'a11y.landmark', 1 FROM v_pages_mut WHERE page_id % 7 = 0", P)
def a11y_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.document_rules(_parsed(spark, sf_dir)).select("page_id", "rule", "line")


LINE = "len(regexp_replace(split_part(html, '<img src=\"a.png\">', 1), '[^\\n]', '', 'g')) + 1"


AFTER_H1 = "CAST(len(string_split(split_part(html, '<input id=', 1), chr(10))) AS INT)"


@query(
    f"SELECT page_id, 'a11y.img-alt' AS rule, CAST({LINE} AS INT) AS line FROM v_pages_mut WHERE page_id % 4 = 0 UNION ALL SELECT page_id, unnest(['a11y.name', 'a11y.tabindex', 'a11y.autoplay', 'a11y.contrast']), {AFTER_H1} FROM v_pages_mut WHERE page_id % 6 = 0",
    P,
)
def a11y_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.element_rules(_elements(spark, sf_dir)).select("page_id", "rule", "line")


@query(f"SELECT page_id, 'a11y.label' AS rule, {AFTER_H1} AS line FROM v_pages_mut WHERE page_id % 6 = 0", P)
def unlabelled_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unlabelled(_elements(spark, sf_dir)).select("page_id", "rule", "line")


@query(f"SELECT page_id, 'a11y.contrast' AS rule, {AFTER_H1} AS line FROM v_pages_mut WHERE page_id % 6 = 0", P)
def style_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.style_contrast(_elements(spark, sf_dir)).select("page_id", "rule", "line")


@query(f"SELECT page_id, 'a11y.heading-order' AS rule, CAST({LINE} AS INT) AS line, 'heading jumps from h1 to h3' AS message FROM v_pages_mut WHERE page_id % 4 = 0", P)
def heading_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.heading_skips(_elements(spark, sf_dir)).select("page_id", "rule", "line", "message")


@query("SELECT page_id, 'a11y.duplicate-id' AS rule, 'duplicate id `one`' AS message FROM v_pages_mut WHERE page_id % 5 = 0", P)
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_ids(_elements(spark, sf_dir)).select("page_id", "rule", "message")


SITES = "(SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS repo, regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS path FROM pages)"
HREFS = """(SELECT page_id, replace(replace(split_part(split_part(h, '?', 1), '#', 1), '&quot;', '"'), '&amp;', '&') AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM pages))"""


@query(
    f"""SELECT h.page_id, h.target FROM {HREFS} h JOIN {SITES} s ON s.page_id = h.page_id
    WHERE starts_with(h.target, '/') AND trim(h.target, '/') <> '' AND NOT EXISTS (SELECT 1 FROM {SITES} f WHERE f.repo = s.repo AND (trim(f.path, '/') = trim(h.target, '/') OR starts_with(f.path, trim(h.target, '/') || '/')))"""
)
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = view(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("repo"), F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1).alias("path"))
    return ops.missing_links(_elements(spark, sf_dir, "pages"), sites, sites).select("page_id", "target")


@query("SELECT page_id, CAST(len(regexp_replace(split_part(html, '<script', 1), '[^\\n]', '', 'g')) + 1 AS INT) AS line, regexp_extract(html, '<script>(.*?)</script>', 1) AS body FROM pages WHERE contains(html, '<script>')")
def inline_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.inline_scripts(view(spark, sf_dir, "pages")).select("page_id", "line", "body")


REPORTED = [
    ("html.viewport", "error", "1", "true"), ("html.unclosed", "error", BOLD, f"{BOLD} > 0"), ("html.misnested", "error", "1", f"{BOLD} > 0"), ("a11y.html-lang", "warning", "1", "page_id % 3 = 0"),
    ("a11y.landmark", "warning", "1", "page_id % 7 = 0"), ("a11y.img-alt", "warning", "1", "page_id % 4 = 0"), ("a11y.heading-order", "warning", "1", "page_id % 4 = 0"), ("a11y.duplicate-id", "warning", "1", "page_id % 5 = 0"),
    ("a11y.name", "warning", "1", "page_id % 6 = 0"), ("a11y.tabindex", "warning", "1", "page_id % 6 = 0"), ("a11y.autoplay", "warning", "1", "page_id % 6 = 0"), ("a11y.label", "warning", "1", "page_id % 6 = 0"), ("a11y.contrast", "warning", "2", "page_id % 6 = 0"),
]


@query("SELECT rule, severity, CAST(sum(n) AS BIGINT) AS n, count(*) AS pages FROM (" + " UNION ALL ".join(f"SELECT '{r}' AS rule, '{v}' AS severity, {n} AS n FROM v_pages_mut WHERE {w}" for r, v, n, w in REPORTED) + ") GROUP BY rule, severity", P)
def page_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page rules, counted by rule."""
    parsed = kept(_parsed(spark, sf_dir))
    return ops.all_page_rules(parsed, source.page_elements(parsed)).groupBy("rule", "severity").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))
