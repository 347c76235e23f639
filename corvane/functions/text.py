"""Text: identifier words, ids, signatures, digests, links and small grammars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_identifier(text: Column) -> Column:
    """ASCII words in lower case, cut at camel humps, acronyms and anything that is no letter or digit.

    Words are read off in one pass: capitals up to one that begins a capitalized word, with what follows, or else a word
    with at most one capital. So a long run of capitals takes time in proportion.
    """
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Z]+(?![a-z])[a-z0-9]*|[A-Z]?[a-z0-9]+"), F.lit(0)), F.lower)


def normalize_signature(params: Column, returns: Column | None = None) -> Column:
    """(a,b) or (a,b):type, white space collapsed; null parameters are none."""
    tidy = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    inside = F.array_join(F.transform(F.coalesce(params, F.array().cast("array<string>")), tidy), ",")
    tail = F.lit("") if returns is None else F.when(F.trim(F.coalesce(returns, F.lit(""))) != "", F.concat(F.lit(":"), tidy(returns))).otherwise("")
    return F.concat(F.lit("("), inside, F.lit(")"), tail)


def node_id(kind: Column, path: Column, owner: Column, name: Column, signature: Column, ordinal: Column) -> Column:
    """kind:path:owner#name(signature); a file is kind:path; nameless ones take @ordinal, and fail without it."""
    label = F.when(F.coalesce(name, F.lit("")) != "", name).when(ordinal.isNotNull(), F.concat(F.lit("@"), ordinal.cast("string")))
    own = F.when(F.coalesce(owner, F.lit("")) != "", F.concat(owner, F.lit("#"))).otherwise("")
    tail = F.when(kind.isin("function", "method"), F.coalesce(signature, F.lit(""))).otherwise("")
    known = F.when(label.isNull() & (kind != "file"), F.raise_error(F.lit("a nameless node needs an ordinal"))).otherwise(label)
    return F.when(kind == "file", F.concat(F.lit("file:"), path)).otherwise(F.concat(kind, F.lit(":"), path, F.lit(":"), own, known, tail))


def complexity_of_lines(lines: Column) -> Column:
    """Under 50 lines simple, up to 200 moderate, else complex."""
    return F.when(lines < 50, "simple").when(lines <= 200, "moderate").otherwise("complex")


# Other words for the three degrees of complexity; the second, shorter table is the merge's, which knows no numbers.
COMPLEXITY_WORDS = {"simple": "simple", "low": "simple", "easy": "simple", "trivial": "simple", "basic": "simple", "moderate": "moderate", "medium": "moderate", "intermediate": "moderate", "mid": "moderate", "average": "moderate", "complex": "complex", "high": "complex", "hard": "complex", "difficult": "complex", "advanced": "complex"}


MERGE_COMPLEXITY_WORDS = {"low": "simple", "easy": "simple", "medium": "moderate", "intermediate": "moderate", "high": "complex", "hard": "complex", "difficult": "complex"}


def merge_complexity(value: Column) -> Column:
    """A degree, or one of the merge's seven words for one, in any case; null for anything else, numbers too."""
    word = F.lower(F.trim(value))
    table = F.create_map(*[F.lit(x) for kv in MERGE_COMPLEXITY_WORDS.items() for x in kv])
    return F.when(word.isin("simple", "moderate", "complex"), word).otherwise(F.try_element_at(table, word))


def normalize_complexity(value: Column, below_one: str = "simple") -> Column:
    """A word, or a number up to 3, 6 or more, as one of three degrees; moderate if unknown. The two twins differ in numbers below 1."""
    word = F.lower(F.trim(value))
    number = word.try_cast("double")
    table = F.create_map(*[F.lit(x) for kv in COMPLEXITY_WORDS.items() for x in kv])
    return F.when(number < 1, below_one).when(number <= 3, "simple").when(number <= 6, "moderate").when(number.isNotNull(), "complex").otherwise(F.coalesce(F.element_at(table, word), F.lit("moderate")))


def simple_type_name(name: Column) -> Column:
    """Without generics (five levels), arrays and package."""
    for _ in range(5):
        name = F.regexp_replace(name, "<[^<>]*>", "")
    return F.element_at(F.split(F.trim(F.regexp_replace(name, r"(\[\s*\])+|\.\.\.$", "")), r"\."), -1)


def format_route(verb: Column, *parts: Column) -> Column:
    """VERB /a/b from path parts, each without outer slashes, empty ones left out."""
    trimmed = F.transform(F.array(*parts), lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), "^/+|/+$", ""))
    return F.concat(F.upper(verb), F.lit(" /"), F.array_join(F.filter(trimmed, lambda p: p != ""), "/"))


def wikilinks(text: Column) -> Column:
    """Array of (target, display) of [[target|display]]; display is null without one."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\]]+)\]\]"), 1)
    return F.transform(found, lambda x: F.struct(F.trim(F.element_at(F.split(x, r"\|", 2), 1)).alias("target"), F.trim(F.try_element_at(F.split(x, r"\|", 2), F.lit(2))).alias("display")))


def headings(text: Column) -> Column:
    """Array of (level, title) of Markdown headings, in order."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^#{1,6}\s+\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(x, "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(x, r"^#+\s+", "")).alias("title")))


def frontmatter(text: Column) -> Column:
    """Map of the key: value lines between leading --- lines; empty without them."""
    inside = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---", 1)
    lines = F.filter(F.split(inside, "\n"), lambda x: x.rlike(r"^[\w-]+\s*:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+)\s*:", 1)), F.trim(F.regexp_replace(x, r"^[\w-]+\s*:", "")))))


def normalize_name(name: Column) -> Column:
    """Lower case without underscores."""
    return F.lower(F.replace(name, F.lit("_"), F.lit("")))


def check_display_name(name: Column) -> Column:
    """Null if fine; else what is wrong: empty, several lines, over 60 characters, or not 2 to 8 words."""
    words = F.size(F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != ""))
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", "empty").when(name.contains("\n"), "multi-line").when(F.char_length(name) > 60, "too-long").when(~words.between(2, 8), "word-count")


def looks_binary(content: Column, first: int = 8192) -> Column:
    """Whether the first bytes have a NUL."""
    return F.instr(F.decode(F.substring(content, 1, first), "ISO-8859-1"), "\u0000") > 0


def count_lines(text: Column) -> Column:
    """Line feeds, and one more for a last line without one."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return feeds + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def since_millis(day: Column) -> Column:
    """UTC milliseconds of a strict calendar date YYYY-MM-DD; null for any other text."""
    parsed = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.date_format(parsed, "yyyy-MM-dd") == day), F.unix_millis(parsed))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double; 0 if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


# XML's five named references.
XML_NAMES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def _xml_character(code: Column) -> Column:
    """The character of a code point; U+FFFD if it is none."""
    bad = code.isNull() | (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return F.when(bad, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_xml(text: Column) -> Column:
    """With named, decimal and hexadecimal references decoded, each once; unknown names stay as written."""
    parts = F.regexp_extract_all(text, F.lit(r"&(?:#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&"), 0)
    names = F.create_map(*[F.lit(x) for k, v in XML_NAMES.items() for x in (f"&{k};", v)])

    def one(p: Column) -> Column:
        decimal = F.regexp_extract(p, r"^&#(\d+);$", 1).try_cast("long")
        hexadecimal = F.conv(F.regexp_extract(p, r"^&#[xX]0*([0-9A-Fa-f]{1,8});$", 1), 16, 10).try_cast("long")
        return F.when(p.rlike(r"^&#\d+;$"), _xml_character(decimal)).when(p.rlike(r"^&#[xX]"), _xml_character(hexadecimal)).otherwise(F.coalesce(F.try_element_at(names, p), p))

    return F.when(text.isNotNull(), F.array_join(F.transform(parts, one), ""))


def has_token(text: Column, token: Column) -> Column:
    """Whether the token occurs with no letter or digit right before or after it."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(token, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    return F.regexp_like(text, quoted)


def java_package(text: Column) -> Column:
    """The package that a Java source declares after comments and annotations, white space inside the name removed; null without one."""
    found = F.regexp_extract(text, r"^(?:\s++|//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/|@[\w.]++(?:\([^)]*+\))?)*+package\s++([\w$]++(?:\s*+\.\s*+[\w$]++)*+)\s*+;", 1)
    return F.when(found != "", F.regexp_replace(found, r"\s+", ""))


def first_paragraph(text: Column) -> Column:
    """The first paragraph after front matter, without headings, quotes and rules before or inside it, its lines joined by spaces; '' without one."""
    body = F.regexp_replace(F.regexp_replace(text, r"^---\n[\s\S]*?\n---\n?", ""), r"^\s+", "")
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(x))
    shown = lambda x: (x != "") & ~x.startswith(">") & ~x.rlike(r"^[-*_]{3,}\s*$") & ~x.startswith("#")
    ends = lambda x: (x == "") | x.startswith("#")
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("lines"))
    step = lambda s, x: F.struct(F.when((s["done"] == 1) | (ends(x) & (F.size(s["lines"]) > 0)), 1).otherwise(0).alias("done"), F.when((s["done"] == 0) & shown(x), F.concat(s["lines"], F.array(x))).otherwise(s["lines"]).alias("lines"))
    return F.array_join(F.aggregate(lines, start, step)["lines"], " ")


def import_line(imports: Column, target: Column) -> Column:
    """The line of the import (source, line) that names a target's file, else its directory, else of the only import; null if none does. Of several the first line."""
    last = lambda s: F.element_at(F.split(F.regexp_replace(s, r"[\\/]+$", ""), r"[\\/]"), -1)
    stem = F.regexp_replace(F.element_at(F.split(target, "/"), -1), r"(?<=.)\.[^.]*$", "")
    parent = F.when(F.size(F.split(target, "/")) > 1, F.element_at(F.split(target, "/"), -2)).otherwise(".")
    line = lambda name: F.array_min(F.transform(F.filter(imports, lambda i: last(i["source"]) == name), lambda i: i["line"]))
    return F.coalesce(line(stem), line(parent), F.when(F.size(imports) == 1, F.get(imports, 0)["line"]))


def usable_range(start: Column, end: Column) -> Column:
    """Whether a line range can be met: from 1 on, and not backwards."""
    return F.coalesce((start >= 1) & (end >= start), F.lit(False))


def architecture_action(version_ok: Column, language: Column, audited: Column, digest: Column, current: Column) -> Column:
    """Struct (action, status) for stored layers: reuse only if they are of the current schema and language, audited and of the current digest; null versions are missing layers."""
    status = F.when(version_ok.isNull(), "missing").when(~version_ok | (F.coalesce(language, F.lit("")) != "en") | ~F.coalesce(audited, F.lit(False)), "noncanonical-language").when(F.coalesce(digest, F.lit("")) == "", "missing").when(digest == current, "fresh").otherwise("stale")
    return F.struct(F.when(status == "fresh", "reuse").otherwise("rebuild").alias("action"), status.alias("status"))
