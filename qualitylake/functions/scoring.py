"""Scores, fingerprints, labels and colours as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import c, normalize

# Salts of the hashes, rules and engines with a meaning, penalties and bounds.
FINGERPRINT_SALT = b"qualitylake-finding-v1\0"
GROUP_SALT = b"qualitylake-group-v1\0"
ASK_RULES = ("engine.unavailable", "coverage.missing", "coverage.unmatched", "spec.llm_gap", "sca.hallucinated_import")
UNSCORED_RULES = ("coverage.missing", "coverage.unmatched")
PENALTIES = {"sca warning": 0.01, "error": 0.25, "warning": 0.05}
DIMENSIONS = {
    "correctness": ("compile", "tests", "config", "lint", "html"),
    "efficiency": ("perf",),
    "security": ("secrets", "sca"),
    "a11y": ("a11y",),
}
OTHER_DIMENSION = "maintainability"
GRADES = ((90, "A", "brightgreen"), (80, "B", "green"), (70, "C", "yellow"), (60, "D", "orange"), (0, "F", "red"))
# End of fixed values.


def crap_score(cc: str | Column, coverage: str | Column) -> Column:
    """cc^2 * (1 - coverage)^3 + cc, with coverage kept within 0 and 1; null without a coverage record."""
    cov = F.when(c(coverage).isNotNull(), F.least(F.greatest(c(coverage), F.lit(0.0)), F.lit(1.0)))
    n = c(cc).cast("double")
    return n * n * F.pow(F.lit(1.0) - cov, F.lit(3.0)) + n


def squeeze(text: str | Column) -> Column:
    """One space for each run of Unicode white space, none at the ends."""
    return F.trim(F.regexp_replace(c(text), r"(?U)\s+", " "))


def safe_line(text: str | Column) -> Column:
    """As squeeze, with control characters as white space."""
    return F.trim(F.regexp_replace(c(text), r"(?U)[\s\p{Cntrl}]+", " "))


def _hash(salt: bytes, parts: list[Column]) -> Column:
    sized = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary"))]
    return F.sha2(F.concat(F.lit(salt), *sized), 256)


def fingerprint(rule="rule", file="file", symbol="symbol", message="message") -> Column:
    """A finding's identity: rule, path, symbol and words of the message, whatever its line."""
    return _hash(FINGERPRINT_SALT, [c(rule), normalize(file), F.coalesce(c(symbol), F.lit("")), squeeze(message)])


def group_key(file="file", symbol="symbol") -> Column:
    return _hash(GROUP_SALT, [c(file), F.coalesce(c(symbol), F.lit(""))])


def disposition(rule="rule", severity="severity") -> Column:
    """ask, ignore or fix."""
    return F.when(c(rule).isin(*ASK_RULES), "ask").when(c(rule).startswith("perf."), "ignore").when(c(severity) == "warning", "ask").otherwise("fix")


def penalty(rule="rule", engine="engine", severity="severity") -> Column:
    by = PENALTIES
    sca = (c(engine) == "sca") & (c(severity) == "warning")
    return F.when(c(rule).isin(*UNSCORED_RULES), 0.0).when(sca, by["sca warning"]).when(c(severity) == "error", by["error"]).when(c(severity) == "warning", by["warning"]).otherwise(0.0)


def dimension(engine="engine") -> Column:
    out = F.lit(OTHER_DIMENSION)
    for name, engines in DIMENSIONS.items():
        out = F.when(c(engine).isin(*engines), name).otherwise(out)
    return out


def overall(scores: list[str | Column]) -> Column:
    """The mean as a whole number of 100, halves up; null if a score is missing or outside 0 to 1."""
    fine, total = F.lit(True), F.lit(0.0)
    for s in scores:
        fine = fine & F.coalesce(c(s).between(0.0, 1.0), F.lit(False))
        total = total + c(s)
    return F.when(fine, F.floor(total * (100.0 / len(scores)) + 100 * 2.220446049250313e-16 + 0.5).cast("int"))


def grade(score: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for low, name, _ in reversed(GRADES):
        out = F.when(c(score) >= low, name).otherwise(out)
    return out


def grade_color(name: str | Column) -> Column:
    out = F.lit(None).cast("string")
    for _, g, color in GRADES:
        out = F.when(c(name) == g, color).otherwise(out)
    return out


def sarif_level(engine="engine", severity="severity") -> Column:
    """Only findings of the secrets engine keep their severity; others are warnings at most."""
    known = c(severity).isin("error", "warning")
    return F.when((c(engine) == "secrets") & known, c(severity)).when(known, "warning").otherwise("note")


def percent_encode(path: str | Column) -> Column:
    """Everything but unreserved characters and slashes as %XX of its UTF-8 bytes."""
    out = F.url_encode(c(path))
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def truncate_bytes(text: str | Column, limit: int, mark: str = "…") -> Column:
    """At most `limit` bytes of UTF-8, cut between characters, with a mark where something is missing."""
    room = max(0, limit - len(mark.encode()))
    text = c(text)
    # characters whose end lies within the room: a running byte count over at most `room` characters
    chars = F.split(F.left(text, F.lit(room)), "")
    kept = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("s"), F.lit(False).alias("full")), lambda a, ch: F.struct((a["n"] + F.octet_length(ch)).alias("n"), F.when(a["full"] | (a["n"] + F.octet_length(ch) > room), a["s"]).otherwise(F.concat(a["s"], ch)).alias("s"), (a["full"] | (a["n"] + F.octet_length(ch) > room)).alias("full")))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(kept["s"], F.lit(mark)))


def percent(x: str | Column) -> Column:
    return F.format_string("%d%%", F.round(c(x) * 100).cast("long"))


def brief(text: str | Column, lines: int = 4, limit: int = 400) -> Column:
    """The first non-empty lines, trimmed and joined, of limited length."""
    parts = F.filter(F.transform(F.split(c(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return truncate_bytes(F.array_join(F.slice(parts, 1, lines), " "), limit)


# ------------------------------------------------------------------ names


def pep503(name: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c(name)), "[-_.]+", "-"))


def module_name(name: str | Column) -> Column:
    return F.replace(F.trim(c(name)), F.lit("-"), F.lit("_"))


def symbol_name(raw: str | Column) -> Column:
    """A demangled symbol without hashes in brackets, trait casts and type arguments."""
    s = F.regexp_replace(c(raw), r"\[[^\]]*\]", "")
    cast = r"^<([^<>]*?)(?:<.*>)? as .*?>::(.*)$"
    own = r"^<([^<>]*?)(?:<.*?>)?>::(.*)$"
    plain = F.regexp_replace(F.regexp_replace(s, "<.*$", ""), "(::)+$", "")
    return F.when(s.rlike(cast), F.concat(F.regexp_replace(F.regexp_extract(s, cast, 1), "(::)+$", ""), F.lit("::"), F.regexp_extract(s, cast, 2))).when(s.rlike(own), F.concat(F.regexp_replace(F.regexp_extract(s, own, 1), "(::)+$", ""), F.lit("::"), F.regexp_extract(s, own, 2))).otherwise(plain)


def without_crate(symbol: str | Column) -> Column:
    """A symbol without its first segment, if it has more than one."""
    return F.regexp_replace(c(symbol), "^[^:]*?::", "")


def module_prefix(path: str | Column) -> Column:
    """The module path of a Rust source file: what follows `src/`, without `mod`, `lib` and `main`."""
    inner = F.regexp_replace(F.regexp_replace(c(path), r"^(.*/)?src/", ""), r"\.rs$", "")
    parts = F.filter(F.split(inner, "/"), lambda p: ~p.isin("", "mod", "lib", "main"))
    return F.array_join(parts, "::")


def xml_attr(tag: str | Column, name: str) -> Column:
    """An attribute's value with its four entities decoded, null where it is missing."""
    found = F.regexp_extract(c(tag), rf"""(?s)(?:^|\s){name}\s*=\s*("([^"]*)"|'([^']*)')""", 1)
    value = F.substring(found, 2, 1 << 30)
    value = F.left(value, F.greatest(F.length(value) - 1, F.lit(0)))
    for a, b in (("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return F.when(found != "", value)


# ------------------------------------------------------------------ colours

# Named colours that rules know, and the least contrast.
NAMED_COLORS = {"black": (0, 0, 0), "gray": (128, 128, 128), "grey": (128, 128, 128), "white": (255, 255, 255), "red": (255, 0, 0)}
LEAST_CONTRAST = 4.5
# End of fixed values.


def color(text: str | Column) -> Column:
    """A CSS colour as an array of red, green and blue, or null."""
    t = F.lower(F.trim(c(text)))

    def channel(x: Column) -> Column:
        return F.conv(x, 16, 10).cast("int")

    short = F.array(*[channel(F.repeat(F.substring(t, i, 1), 2)) for i in (2, 3, 4)])
    long = F.array(*[channel(F.substring(t, i, 2)) for i in (2, 4, 6)])
    rgb = F.transform(F.regexp_extract_all(t, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))
    out = F.when(t.rlike("^#[0-9a-f]{3}$"), short).when(t.rlike("^#[0-9a-f]{6}$"), long).when(t.rlike(r"^rgb\(\s*\d{1,3}\s*,\s*\d{1,3}\s*,\s*\d{1,3}\s*\)$") & ~F.exists(rgb, lambda x: x > 255), rgb)
    for name, value in NAMED_COLORS.items():
        out = out.when(t == name, F.array(*[F.lit(v) for v in value]))
    return out


def luminance(rgb: Column) -> Column:
    def linear(v: Column) -> Column:
        s = v / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    return linear(rgb[0]) * 0.2126 + linear(rgb[1]) * 0.7152 + linear(rgb[2]) * 0.0722


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)
