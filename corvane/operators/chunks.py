"""Chunks of source files for the index: one for the file and one for each declaration, with their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.paths import base_name
from corvane.functions.text import split_identifier

# Node types of other declarations by their kind.
NODE_TYPES = {"table": "table", "view": "table", "index": "table", "message": "schema", "type": "schema", "enum": "schema", "resource": "resource", "module": "resource", "service": "service", "deployment": "service", "job": "pipeline", "stage": "pipeline", "target": "pipeline", "route": "endpoint", "query": "endpoint", "mutation": "endpoint", "variable": "config", "output": "config"}
# What is read as a comment or a string, whatever the language.
DOC_STRING = "\"\"\"[\\s\\S]*?\"\"\"|'''[\\s\\S]*?'''"
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
# Possessive, so that a long string takes no stack.
STRING = r'"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"' + r"|'[^'\\]*+(?:\\[^\n][^'\\]*+)*+'|`[^`\\]*+(?:\\[^\n][^`\\]*+)*+`"


def declaration_type(kind: Column) -> Column:
    """The node type of a declaration kind, concept if unknown."""
    table = F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), F.lit("concept"))


def _full(items: Column) -> Column:
    return F.filter(items, lambda x: F.regexp_replace(x, r"\s+", "") != "")


def comments_and_strings(text: Column) -> Column:
    """Struct (comments, strings): bodies of triple-quoted texts, block comments and line comments after the first // or #, trimmed, and of quoted strings, in this order; blank ones are left out.

    Each kind is taken out before the next is looked for. This is a scan for a search index, not a parser.
    """
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    docs = F.transform(F.regexp_extract_all(text, F.lit(DOC_STRING), 0), lambda x: trim(F.substring(x, F.lit(4), F.length(x) - 6)))
    rest = F.regexp_replace(text, DOC_STRING, " ")
    blocks = F.transform(F.regexp_extract_all(rest, F.lit(BLOCK_COMMENT), 0), lambda x: trim(F.substring(x, F.lit(3), F.length(x) - 4)))
    rest = F.regexp_replace(rest, BLOCK_COMMENT, " ")
    strings = F.transform(F.regexp_extract_all(rest, F.lit(STRING), 0), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))
    rest = F.regexp_replace(rest, STRING, " ")
    lines = F.transform(F.filter(F.split(rest, "\n"), lambda x: x.rlike("//|#")), lambda x: trim(F.regexp_replace(x, r"^[\s\S]*?(?://|#)", "")))
    empty = F.array().cast("array<string>")
    found = F.struct(F.concat(_full(docs), _full(blocks), _full(lines)).alias("comments"), _full(strings).alias("strings"))
    return F.when(text.isNull(), F.struct(empty.alias("comments"), empty.alias("strings"))).otherwise(found)


def token_bag(identifiers: Column, comments: Column, strings: Column) -> Column:
    """All words of a chunk: its identifiers', already split, and those of its comments and strings."""
    words = lambda xs: F.flatten(F.transform(xs, split_identifier))
    return F.concat(identifiers, words(comments), words(strings))


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines from start to end, both counted from 1 and clamped into the text."""
    lines = F.split(text, "\n")
    first = F.greatest(F.lit(1), F.coalesce(start, F.lit(1)))
    last = F.least(F.size(lines), F.coalesce(end, F.size(lines)))
    return F.when(last >= first, F.array_join(F.slice(lines, first, last - first + 1), "\n")).otherwise("")


def build_chunks(decls: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, path, symbol, type, identifiers, comments, strings, content_available): a chunk for each declaration (id, path, name, owner, kind, start, end, seeds) and one for each file (path, text).

    An id that several declarations have gets #2, #3 ... from the second on, by start and end. A text meets its
    declarations by path; null text is a file whose content can't be read.
    """
    from pyspark.sql import Window

    whole = texts.select(F.concat(F.lit("file:"), "path").alias("id"), "path", F.lit(None).cast("string").alias("name"), F.lit("file").alias("kind"), F.lit(1).alias("start"), F.lit(None).cast("int").alias("end"), F.array().cast("array<string>").alias("seeds"))
    own = decls.select("id", "path", "name", "kind", "start", "end", "seeds").unionByName(whole)
    again = F.row_number().over(Window.partitionBy("id").orderBy("start", "end"))
    named = own.withColumn("n", again).withColumn("id", F.when(F.col("n") > 1, F.concat("id", F.lit("#"), "n")).otherwise(F.col("id")))
    joined = named.join(texts, "path")
    found = comments_and_strings(slice_lines(F.col("text"), F.col("start"), F.col("end")))
    seeds = F.filter(F.concat("seeds", F.array(base_name(F.col("path")))), lambda s: F.coalesce(s, F.lit("")) != "")
    cut = joined.withColumn("f", found)
    return cut.select("id", "path", F.col("name").alias("symbol"), F.col("kind").alias("type"), F.flatten(F.transform(seeds, split_identifier)).alias("identifiers"), F.col("f.comments").alias("comments"), F.col("f.strings").alias("strings"), F.col("text").isNotNull().alias("content_available"))
