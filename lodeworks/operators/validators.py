"""Validators of sources, contents and preferences as column expressions: validity, error, score and parts of it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeworks.functions.text import let, strip, words

# Reliabilities of hosts, the first that fits; patterns; weights and limits of the levels.
HOSTS = [
    (r"\.edu$", 0.9), (r"\.gov$", 0.9), (r"\.org$", 0.8), (r"\.mil$", 0.9), (r"wikipedia\.org$", 0.8), (r"arxiv\.org$", 0.9),
    (r"github\.com$", 0.8), (r"science\.(org|com)$", 0.85), (r"nature\.com$", 0.9), (r"scholar\.google\.com$", 0.9),
]
FACTS = [r"\d+(?:\.\d+)?", r"\d{4}-\d{2}-\d{2}", r"\d+(?:\.\d+)?%", r"\d+(?:\.\d+)?\s*(?:kg|km|m|ft|mi|lb)"]
SOURCE_MARKDOWN = [r"^#{1,6}\s+.+$", r"^\s*[-*+]\s+.+$", r"```[\s\S]*?```", r"\|.*\|.*\n\|[-\s|]+\|", r"^\s*>\s+.+"]
INDICATORS = [
    r"\[\d+\]|\[(?:[A-Za-z]+\s*(?:et al\.)?,\s*\d{4})\]", r"\((?:[A-Za-z]+\s*(?:et al\.)?,\s*\d{4})\)",
    r"\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:million|billion|trillion)", r"study|research|analysis|methodology|hypothesis|conclusion",
    r"algorithm|implementation|framework|architecture|protocol",
]
HEADER = r"^(#{1,6})\s+(.+)$"
#: Weights of host, content, markdown and indicators; the least score.
LEVELS = {"strict": (0.3, 0.3, 0.2, 0.2, 0.8), "normal": (0.25, 0.35, 0.15, 0.25, 0.6), "lenient": (0.2, 0.4, 0.1, 0.3, 0.4)}
#: Fields of the markdown report, of which the patterns above can set all but two.
MARKDOWN_FIELDS = 7
CONTENT_MARKDOWN = [[r"^#{1,6}\s.+$"], [r"^\s*[-*+]\s.+$", r"\|.+\|"], [r"```[\s\S]*?```", r"[*_]{1,2}[^*_]+[*_]{1,2}"]]
CONTENT_COUNTS = [(r"\[\d+\]|\[[A-Za-z]+\s+\d{4}\]", 5, 0.2), (r"\d+(?:\.\d+)?%|\d+(?:\.\d+)?\s*(?:million|billion|trillion)", 3, 0.2), (r"https?://\S+", 2, 0.1)]
SHORTEST, LONGEST = 50, 100_000
CATEGORIES = ["appearance", "behavior", "communication", "interface", "content", "privacy", "notifications", "accessibility", "language", "timezone", "formatting"]
KEY_LENGTH, STRING_LENGTHS, LIST_ITEMS = 50, (1, 1000), (0, 100)

#: The table pattern, fourth of the above, found from line starts alone: a line with two bars before a line of bars and
#: dashes. It fits the same texts, in time linear in a line rather than with the cube of its bars.
TABLE = r"^[^|\n]*\|[^|\n]*\|.*\n\|[-\s|]+\|"
#: Added before scores are rounded to two places, so that a half goes up whatever its binary form.
NUDGE = 1e-9


def _lines(pattern: str) -> str:
    """Anchors at lines, of which only a line feed ends one."""
    return f"(?dm){pattern}"


def _round(score: Column) -> Column:
    return F.round(score + NUDGE, 2)


def host_reliability(url: Column) -> Column:
    """By the host of a URL; .5 for an unknown or missing one."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    out = F.when(host.rlike(HOSTS[0][0]), HOSTS[0][1])
    for pattern, value in HOSTS[1:]:
        out = out.when(host.rlike(pattern), value)
    return out.otherwise(0.5)


def header_hierarchy(text: Column) -> Column:
    """Share of headers that go at most one level deeper than the one before; 0 without headers."""
    marks = F.regexp_extract_all(text, F.lit(_lines(HEADER)), F.lit(1))
    good = F.filter(marks, lambda m, i: (i == 0) | (F.length(m) <= F.length(F.get(marks, i - 1)) + 1))
    return F.when(F.size(marks) == 0, 0.0).otherwise(F.size(good) / F.size(marks))


def validate_source(text: Column, url: Column, level: str = "normal") -> Column:
    """Struct of ``valid, score, hierarchy`` of a source's content by host, length, structure, facts, markdown and indicators.

    Nulls count as empty; a content without words has no density of facts and no readability.
    """
    by_host, by_content, by_markdown, by_indicator, least = LEVELS[level]
    body = F.coalesce(text, F.lit(""))
    n = F.size(words(body))
    letters = F.length(F.regexp_replace(body, r"\s+", ""))
    facts = sum((F.regexp_count(body, F.lit(p)) for p in FACTS[1:]), F.regexp_count(body, F.lit(FACTS[0])))
    readable = F.when(n > 0, 1 - F.least(F.greatest(letters / n - 4, F.lit(0.0)) / 8, F.lit(1.0))).otherwise(0.0)
    dense = F.when(n > 0, F.least(facts / (n / 100), F.lit(1.0))).otherwise(0.0)
    parts = F.least(F.length(body) / 1000, F.lit(1.0)) + F.least(F.size(F.split(body, "\n\n")) / 10, F.lit(1.0)) + readable + dense
    marked = sum((body.rlike(_lines(p)).cast("int") for p in [*SOURCE_MARKDOWN[:3], TABLE, SOURCE_MARKDOWN[4]]), F.lit(0)) / MARKDOWN_FIELDS
    shown = body.rlike("(?i)" + "|".join(INDICATORS)).cast("int")
    score = _round(host_reliability(url) * by_host + parts / 4 * by_content + marked * by_markdown + shown * by_indicator)
    return F.struct((score >= least).alias("valid"), score.alias("score"), header_hierarchy(body).alias("hierarchy"))


def validate_content(text: Column, level: str = "normal") -> Column:
    """Struct of ``valid, error, score``: length limits first, then a score of length, markdown and counted evidence."""
    body = F.coalesce(text, F.lit(""))
    score = F.least(F.length(body) / 1000, F.lit(1.0)) * 0.2
    for any_of in CONTENT_MARKDOWN:
        score = score + F.when(body.rlike(_lines("|".join(any_of))), 0.1).otherwise(0.0)
    for pattern, enough, weight in CONTENT_COUNTS:
        score = score + F.least(F.regexp_count(body, F.lit(pattern)) / enough, F.lit(1.0)) * weight
    score = _round(F.least(score, F.lit(1.0)))
    early = F.when(F.length(body) < SHORTEST, "Content too short").when(F.length(body) > LONGEST, "Content too long").when(strip(body) == "", "Empty content")
    error = F.coalesce(early, F.when(score < LEVELS[level][-1], "Content quality below threshold"))
    return F.struct(error.isNull().alias("valid"), error.alias("error"), F.when(early.isNull(), score).otherwise(0.0).alias("score"))


def validate_preference(key: Column, category: Column, kind: Column, value: Column, source: Column, confidence: Column, at: Column, limits: Mapping[str, Column] | None = None) -> Column:
    """Error of a preference, null if it is valid; the first rule that fails counts: key, category, value by type, metadata.

    ``value`` is text, lists and dictionaries are JSON; ``limits`` may hold columns ``min, max, min_length, max_length,
    options, min_items, max_items, required_keys``, where a null is no limit of its own. Nulls fail their rule.
    """
    given = limits or {}
    limit = lambda name, default, kind: F.coalesce(given[name], F.lit(default)) if name in given else F.lit(default).cast(kind)
    text = F.coalesce(value, F.lit(""))
    whole = text.rlike(r"^[+-]?\d+$")
    items, entries = F.from_json(text, "array<string>"), F.from_json(text, "map<string,string>")
    options, required = limit("options", None, "array<string>"), limit("required_keys", None, "array<string>")
    shortest, longest = limit("min_length", STRING_LENGTHS[0], "int"), limit("max_length", STRING_LENGTHS[1], "int")
    fewest, most = limit("min_items", LIST_ITEMS[0], "int"), limit("max_items", LIST_ITEMS[1], "int")
    low, high = limit("min", None, "double"), limit("max", None, "double")
    number = text.try_cast("double")
    absent = F.filter(required, lambda k: ~F.coalesce(F.array_contains(F.map_keys(entries), k), F.lit(False)))
    ranged = F.when(number < low, "Value below the minimum").when(number > high, "Value above the maximum")
    by_kind = (
        F.when(kind == "string", F.when(value.isNull(), "Value must be a string").when(F.length(text) > longest, "String too long").when(F.length(text) < shortest, "String too short"))
        .when(kind == "boolean", F.when(~F.lower(text).isin("true", "false"), "Value must be a boolean"))
        .when(kind == "integer", F.when(~whole, "Value must be an integer").otherwise(ranged))
        .when(kind == "float", F.when(number.isNull(), "Value must be a number").otherwise(ranged))
        .when(kind == "enum", F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, "Enum options must be provided").when(~F.coalesce(F.array_contains(options, value), F.lit(False)), "Value must be one of the options"))
        .when(kind == "list", F.when(items.isNull(), "Value must be a list").when(F.size(items) > most, "List too long").when(F.size(items) < fewest, "List too short"))
        .when(kind == "dict", F.when(entries.isNull(), "Value must be a dictionary").when(F.coalesce(F.size(absent), F.lit(0)) > 0, "Missing required key"))
        .otherwise("Invalid value type")
    )
    return (
        F.when(strip(F.coalesce(key, F.lit(""))) == "", "Preference key cannot be empty").when(F.length(key) > KEY_LENGTH, "Preference key too long")
        .when(~F.coalesce(category.isin(CATEGORIES), F.lit(False)), "Invalid category").when(by_kind.isNotNull(), by_kind)
        .when(F.coalesce(source, F.lit("")) == "", "Metadata source cannot be empty")
        .when(~F.coalesce(confidence.between(0, 1), F.lit(False)), "Confidence score must be between 0 and 1")
        .when(F.coalesce(at, F.lit("")).try_cast("timestamp").isNull(), "Invalid timestamp format")
    )


# Citation formats, what raises the confidence in each and in all (in tenths over six), and a DOI.
CITATIONS = {
    "apa": (r"\((?:[A-Za-z]+(?:\s*et al\.?)?,\s*\d{4}(?:,\s*(?:p\.|pp\.)?\s*\d+(?:-\d+)?)?\))", [(r"[A-Za-z]+(?:\s*et al\.?)?,\s*\d{4}", 2), (r"p\.|pp\.\s*\d+", 1)]),
    "mla": (r"\([A-Za-z]+\s+\d+(?:-\d+)?\)", [(r"[A-Za-z]+\s+\d+", 2)]),
    "chicago": (r"\d+\.\s*[A-Za-z]+", [(r"^\d+\.\s*", 2)]),
    "ieee": (r"\[\d+\]", [(r"^\[\d+\]$", 3)]),
    "harvard": (r"\([A-Za-z]+,\s*\d{4}\)", [(r"\([A-Za-z]+,\s*\d{4}\)", 2), (r"\d+(?:-\d+)?", 1)]),
}
CITATION_EXTRAS = [r";|\sand\s", r"(?i)vol\.|volume|issue|\(\d+\)"]
DOI = r"10\.\d{4,}/[-._;()/:\w]+"
# Elements of a markdown text that count for its structure, and those that count for its formatting.
MARKDOWN_STRUCTURE = {"headers": r"^#{1,6}\s+.+$|^.+\n[=-]+$", "lists": r"^\s*[-*+]\s+.+$|^\s*\d+\.\s+.+$"}
MARKDOWN_CODE = r"```[a-z]*\n[\s\S]*?```"
MARKDOWN_FORMATTING = [r"[*_][^*_\s][^*_]*[*_]", r"[*_]{2}[^*_\s][^*_]*[*_]{2}", r"`[^`]+`", r"^\s*> .+$", r"^\s*[-*_]{3,}\s*$"]
MARKDOWN_LINKS = {"inline": r"\[[^\]]+\]\([^)]+\)", "reference": r"\[[^\]]+\]\[([^\]]+)\]", "definition": r"^\[([^\]]+)\]:\s+\S+(?:\s+\"[^\"]+\")?\s*$"}


def validate_reference(text: Column, expected: Column | None = None) -> Column:
    """Struct of ``valid, error, format, confidence, has_doi, has_year, has_authors`` of a citation; the first of equally likely formats counts."""
    body = F.coalesce(text, F.lit(""))
    hits = lambda pattern, n: F.when(body.rlike(pattern), n).otherwise(0)
    extra = sum((hits(p, 1) for p in CITATION_EXTRAS), F.lit(6))
    tenths = {name: F.when(body.rlike(pattern), F.least(extra + sum((hits(p, n) for p, n in more), F.lit(0)), F.lit(10))).otherwise(0) for name, (pattern, more) in CITATIONS.items()}
    best = F.greatest(*tenths.values())
    found = F.when(best == 0, None)
    for name, value in tenths.items():
        found = found.when(value == best, name)
    wrong = F.lit(False) if expected is None else expected.isNotNull() & ~found.eqNullSafe(expected)
    error = F.when(strip(body) == "", "Empty reference").when(wrong, "Reference format mismatch").when(best < 7, "Invalid reference format")
    return F.struct(error.isNull().alias("valid"), error.alias("error"), found.alias("format"), (best / 10).alias("confidence"), body.rlike(DOI).alias("has_doi"), body.rlike(r"\d{4}").alias("has_year"), body.rlike("[A-Za-z]").alias("has_authors"))


def validate_data(data: Column, required: list[str], properties: Mapping[str, Mapping], level: str = "medium") -> Column:
    """Struct of ``valid, missing, invalid`` of a JSON object against a schema; null and invalid JSON lacks every field.

    A property may have a ``type`` (numeric, string, boolean, list, dict; booleans are numeric too), a ``minimum`` and
    ``maximum`` for numbers, and ``constraints``: ``regex`` (from the start, strings only), ``enum``, ``length``,
    ``min_length``, ``max_length``. Level high asks for all, medium for fields, types and ranges, low for fields.
    """
    return let(F.try_parse_json(data), lambda value: _validate_object(value, required, properties, level))


def _validate_object(value: Column, required: list[str], properties: Mapping[str, Mapping], level: str) -> Column:
    kind = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    kinds = {"numeric": r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|BOOLEAN)", "string": "^STRING", "boolean": "^BOOLEAN", "list": "^ARRAY", "dict": "^OBJECT"}
    absent, bad = {}, []
    for name, rules in properties.items():
        here, typed = kind(name), []
        text, number = F.try_variant_get(value, f"$.{name}", "string"), F.coalesce(F.try_variant_get(value, f"$.{name}", "double"), F.try_variant_get(value, f"$.{name}", "boolean").cast("double"))
        known = F.coalesce(here.rlike(kinds[rules["type"]]) if rules.get("type") in kinds else F.lit("type" not in rules), F.lit(False))
        typed.append(known)
        if rules.get("type") == "numeric":
            typed += [F.coalesce(test, F.lit(True)) for test in ((number >= rules["minimum"]) if "minimum" in rules else F.lit(True), (number <= rules["maximum"]) if "maximum" in rules else F.lit(True))]
        size = F.when(here.rlike("^STRING"), F.length(text)).when(here.rlike("^ARRAY"), F.size(F.try_variant_get(value, f"$.{name}", "array<variant>"))).when(here.rlike("^OBJECT"), F.size(F.try_variant_get(value, f"$.{name}", "map<string,variant>")))
        rest, limits = F.lit(True), rules.get("constraints", {})
        if "regex" in limits:
            rest = rest & (~here.rlike("^STRING") | text.rlike(f"^(?:{limits['regex']})"))
        if "enum" in limits:
            rest = rest & text.isin([str(x) for x in limits["enum"]])
        for limit, test in (("length", lambda n: size == n), ("min_length", lambda n: size >= n), ("max_length", lambda n: size <= n)):
            if limit in limits:
                rest = rest & test(limits[limit])
        good = typed[0]
        for t in typed[1:]:
            good = good & t
        absent[name] = here.isNull()
        bad.append(F.when(here.isNotNull() & ~(good & F.coalesce(rest, F.lit(False))), F.struct(F.lit(name).alias("name"), (~good).alias("grave"))))
    missing = F.filter(F.array(*[F.when(absent.get(n, kind(n).isNull()), n) for n in required]).cast("array<string>"), lambda x: x.isNotNull())
    faults = F.filter(F.array(*bad), lambda x: x.isNotNull())
    grave = {"high": F.size(faults) > 0, "medium": F.exists(faults, lambda x: x["grave"]), "low": F.lit(False)}[level]
    return F.struct(((F.size(missing) == 0) & ~grave).alias("valid"), missing.alias("missing"), F.transform(faults, lambda x: x["name"]).alias("invalid"))


def validate_markdown(text: Column, level: str = "normal") -> Column:
    """Struct of ``valid, score, has_headers, hierarchy, links_valid``: a tenth for headers, lists, tables and code each, a fifth for formatting, links and hierarchy each."""
    body = F.coalesce(text, F.lit(""))
    has = lambda pattern: body.rlike(_lines(pattern)).cast("int")
    # Three lines between bars make a table where another line follows them.
    table = body.rlike(_lines(r"(?:^\|.+\|\n){3,}+(?!\|.+\|\z)")).cast("int")
    code = (body.rlike(MARKDOWN_CODE) | body.rlike(r"^(?: {4}|\t)[\s\S]")).cast("int")
    headers = has(MARKDOWN_STRUCTURE["headers"])
    formats = sum((has(p) for p in MARKDOWN_FORMATTING), F.lit(0))
    refs, names = (F.regexp_extract_all(body, F.lit(_lines(MARKDOWN_LINKS[k])), F.lit(1)) for k in ("reference", "definition"))
    linked = F.size(F.array_except(refs, names)) == 0
    links = F.least(F.regexp_count(body, F.lit(MARKDOWN_LINKS["inline"])) + F.size(refs), F.lit(5))
    marks = F.regexp_extract_all(body, F.lit("(?dm)^(#+)"), F.lit(1))
    steps = F.forall(F.transform(marks, lambda m, i: (i == 0) & (F.length(m) == 1) | (i > 0) & (F.length(m) <= F.length(F.get(marks, i - 1)) + 1)), lambda x: F.coalesce(x, F.lit(False)))
    hundredths = (headers + has(MARKDOWN_STRUCTURE["lists"]) + table + code) * 10 + formats * 4 + F.when(linked, links * 4).otherwise(0) + F.when(steps, 20).otherwise(0)
    score = hundredths / 100
    valid = {"strict": (score >= 0.8) & (headers == 1) & steps, "normal": (score >= 0.6) & (headers == 1), "lenient": score >= 0.4}[level]
    return F.struct(valid.alias("valid"), score.alias("score"), (headers == 1).alias("has_headers"), steps.alias("hierarchy"), linked.alias("links_valid"))
