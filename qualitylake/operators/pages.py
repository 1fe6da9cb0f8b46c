"""Markup, link and accessibility findings over page elements (page_id, url, pos, name, line, col, attrs, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths, scoring

# Elements, roles and input types that rules name.
LANDMARKS = ("main", "nav", "header", "footer", "aside")
LANDMARK_ROLES = ("main", "navigation", "banner", "contentinfo", "complementary")
UNLABELLED_INPUTS = ("hidden", "submit", "button", "reset", "image")
# End of fixed values.


def attr(name: str) -> Column:
    """The first attribute of a name, whatever its letter case; null where there is none."""
    hits = F.filter("attrs", lambda a: F.lower(a["k"]) == name)
    return F.get(hits, F.lit(0))["v"]


def _rule(df: DataFrame, rule: str, message: str | Column, disabled: list[str], engine: str = "a11y", severity: str = "warning", line: str | Column = "line") -> DataFrame:
    hits = df.where(F.lit(rule not in disabled))
    text = F.lit(message) if isinstance(message, str) else message
    return hits.select("page_id", F.lit(f"{engine}.{rule}").alias("rule"), F.lit(engine).alias("engine"), F.lit(severity).alias("severity"), F.greatest(paths.c(line), F.lit(1)).cast("int").alias("line"), text.alias("message"))


def _filled(name: str) -> Column:
    return F.coalesce(F.trim(attr(name)) != "", F.lit(False))


def _attr_of(x: Column, name: str) -> Column:
    return F.get(F.filter(x["attrs"], lambda a: F.lower(a["k"]) == name), F.lit(0))["v"]


def _met(df: DataFrame, rules: list[tuple[Column, str, str | Column]], disabled: list[str], engine: str, severity: str, line: str | Column = "line") -> DataFrame:
    """Findings of several (condition, rule, message) in one pass over the rows."""
    at = F.greatest(paths.c(line), F.lit(1)).cast("int")
    hits = F.array(*[F.when(cond, F.struct(F.lit(f"{engine}.{rule}").alias("rule"), F.lit(message).alias("message"), (at if rule != "document-title" and rule != "landmark" else F.lit(1)).alias("line"))) for cond, rule, message in rules if rule not in disabled])
    return df.select("page_id", F.inline(F.array_compact(hits))).select("page_id", "rule", F.lit(engine).alias("engine"), F.lit(severity).alias("severity"), "line", "message")


def html_findings(parsed: DataFrame) -> DataFrame:
    """Doctype, viewport, unclosed and misnested findings, all errors."""
    viewport = F.exists("elements", lambda e: (e["name"] == "meta") & F.exists(e["attrs"], lambda a: (F.lower(a["k"]) == "name") & (F.lower(a["v"]) == "viewport")) & F.exists(e["attrs"], lambda a: (F.lower(a["k"]) == "content") & (F.trim(a["v"]) != "")))
    page = _met(parsed, [(~F.col("has_doctype"), "doctype", "missing <!doctype html>"), (~viewport, "viewport", 'missing <meta name="viewport">')], [], "html", "error", F.lit(1))
    balance = parsed.select("page_id", F.inline("balance")).select("page_id", "rule", F.lit("html").alias("engine"), F.lit("error").alias("severity"), "line", "message")
    return page.unionByName(balance)


def document_rules(parsed: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """html-lang, document-title and landmark, from one look at a page's elements."""
    e = F.col("elements")
    lang = F.exists(e, lambda x: (x["name"] == "html") & F.coalesce(F.trim(_attr_of(x, "lang")) != "", F.lit(False)))
    title = F.exists(e, lambda x: (x["name"] == "title") & (F.trim(x["text"]) != ""))
    landmark = F.exists(e, lambda x: x["name"].isin(*LANDMARKS) | F.coalesce(_attr_of(x, "role").isin(*LANDMARK_ROLES), F.lit(False)))
    html_line = F.coalesce(F.get(F.filter(e, lambda x: x["name"] == "html"), F.lit(0))["line"], F.lit(1))
    rules = [(~lang, "html-lang", "html element has no lang"), (~title, "document-title", "page has no title"), (~landmark, "landmark", "page has no landmark")]
    return _met(parsed, rules, disabled or [], "a11y", "warning", html_line)


def element_rules(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """img-alt, name, tabindex, autoplay and inline contrast, in one pass over elements."""
    name = F.col("name")
    tab = F.trim(attr("tabindex")).try_cast("int")
    colors = inline_colors(attr("style"))
    rules = [
        ((name == "img") & attr("alt").isNull(), "img-alt", "img has no alt"),
        (name.isin("a", "button") & (F.trim("text") == "") & ~_filled("aria-label") & ~_filled("aria-labelledby"), "name", "link or button has no accessible name"),
        (tab > 0, "tabindex", "positive tabindex"),
        (name.isin("video", "audio") & attr("autoplay").isNotNull() & attr("controls").isNull(), "autoplay", "autoplay media has no controls"),
        (scoring.contrast(colors["fg"], colors["bg"]) < scoring.LEAST_CONTRAST, "contrast", "inline colors are below 4.5:1"),
    ]
    return _met(elements, rules, disabled or [], "a11y", "warning")


def inline_colors(style: Column) -> Column:
    """Foreground and background of a style, the last valid declaration of each; null if one is missing."""
    parts = F.transform(F.split(style, ";"), lambda p: F.struct(F.lower(F.trim(F.split(p, ":")[0])).alias("k"), scoring.color(F.regexp_replace(p, "^[^:]*:", "")).alias("c")))

    def last(*names: str) -> Column:
        return F.try_element_at(F.filter(parts, lambda x: x["k"].isin(*names) & x["c"].isNotNull()), F.lit(-1))["c"]

    return F.struct(last("color").alias("fg"), last("background", "background-color").alias("bg"))


def style_contrast(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Low-contrast rules of style elements met with the page's elements of that tag."""
    rules = elements.where("name = 'style'").select("page_id", F.explode(F.split("text", "}")).alias("rule")).where(F.contains("rule", F.lit("{")))
    cut = rules.select("page_id", F.lower(F.trim(F.split("rule", r"\{")[0])).alias("name"), inline_colors(F.trim(F.regexp_replace("rule", r"(?s)^[^{]*\{", ""))).alias("c"))
    low = cut.where(F.col("name").rlike("^[a-z0-9]+$") & (scoring.contrast(F.col("c.fg"), F.col("c.bg")) < scoring.LEAST_CONTRAST)).select("page_id", "name")
    return _rule(elements.join(low, ["page_id", "name"]), "contrast", "styled colors are below 4.5:1", disabled or [])


def unlabelled(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Form controls without aria names that no label's `for` points at."""
    kind = F.coalesce(attr("type"), F.lit("text"))
    controls = elements.where(F.col("name").isin("select", "textarea") | ((F.col("name") == "input") & ~kind.isin(*UNLABELLED_INPUTS))).where(~_filled("aria-label") & ~_filled("aria-labelledby")).withColumn("_id", attr("id"))
    labels = elements.where("name = 'label'").select("page_id", attr("for").alias("_id")).where("_id is not null")
    return _rule(controls.join(labels, ["page_id", "_id"], "left_anti"), "label", "form control has no label", disabled or [])


def heading_skips(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Headings more than one level below the heading before them."""
    h = elements.where(F.col("name").rlike("^h[1-6]$")).withColumn("level", F.substring("name", 2, 1).cast("int"))
    before = F.lag("level").over(Window.partitionBy("page_id").orderBy("pos"))
    skips = h.withColumn("before", before).where(F.col("level") > F.col("before") + 1)
    return _rule(skips, "heading-order", F.format_string("heading jumps from h%d to h%d", "before", "level"), disabled or [])


def duplicate_ids(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Every occurrence of an id on a page after its first."""
    ids = elements.withColumn("_id", attr("id")).where("_id <> ''")
    again = ids.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "_id").orderBy("pos"))).where("_n > 1")
    return _rule(again, "duplicate-id", F.format_string("duplicate id `%s`", "_id"), disabled or [])


def missing_links(elements: DataFrame, pages: DataFrame, files: DataFrame) -> DataFrame:
    """Local targets of any href or src that are neither a file nor a directory of the page's site.

    pages: page_id, repo, path. files: repo, path. The root is always there."""
    refs = elements.select("page_id", "pos", "line", F.explode(F.filter("attrs", lambda a: F.lower(a["k"]).isin("href", "src"))).alias("a"))
    targets = refs.select("page_id", "pos", "line", paths.local_target("a.v").alias("target")).where("target is not null").join(pages.select("page_id", "repo", F.col("path").alias("page")), "page_id")
    resolved = targets.withColumn("path", paths.resolve("page", "target")).where("path <> ''")
    dirs = files.select("repo", F.explode(paths.ancestors("path")).alias("path"))
    known = files.select("repo", paths.normalize("path").alias("path")).union(dirs).distinct()
    return resolved.join(known, ["repo", "path"], "left_anti").select("page_id", F.lit("links.missing").alias("rule"), F.lit("links").alias("engine"), F.lit("warning").alias("severity"), "line", F.format_string("missing file `%s`", "target").alias("message"), "target")


def all_page_rules(parsed: DataFrame, elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """Markup and accessibility findings of pages, one table."""
    out = html_findings(parsed).unionByName(document_rules(parsed, disabled))
    for rules in (element_rules, style_contrast, unlabelled, heading_skips, duplicate_ids):
        out = out.unionByName(rules(elements, disabled))
    return out


def jsx_rules(elements: DataFrame, disabled: list[str] | None = None) -> DataFrame:
    """The element rules only: a component is no document."""
    out = element_rules(elements, disabled)
    for rules in (unlabelled, duplicate_ids):
        out = out.unionByName(rules(elements, disabled))
    return out
