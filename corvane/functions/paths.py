"""Paths: normal form, ancestors, suffixes, and predicates on names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column, member: Column | None = None) -> Column:
    """Forward slashes, none doubled, no leading ./ or /; below a member id if there is one."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/{2,}", "/")
    p = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "^/+", "")
    if member is None:
        return p
    m = F.regexp_replace(F.regexp_replace(F.replace(member, F.lit("\\"), F.lit("/")), "^/+", ""), "/+$", "")
    return F.when(F.coalesce(member, F.lit("")) == "", p).otherwise(F.concat_ws("/", m, p))


def ancestor_dirs(path: Column) -> Column:
    """'.' and each enclosing directory, outermost first: a/b/c.txt has ., a, a/b."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    inner = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.concat(F.array(F.lit(".")), inner)


def path_suffixes(path: Column) -> Column:
    """All suffixes at directory borders, the whole path first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "/"))


def in_scope(path: Column, directory: Column) -> Column:
    """The directory itself or anything below it; '' or '.' is everything."""
    return directory.isin("", ".") | (path == directory) | path.startswith(F.concat(directory, F.lit("/")))


# Stems, extensions and whole names that make an entry file.
ENTRY_STEMS = ["main", "server", "app", "index"]
ENTRY_EXTENSIONS = ["go", "py", "ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "rs", "java", "kt", "rb", "php", "cs"]
ENTRY_NAMES = ["__main__.py", "manage.py", "Program.cs", "Main.java", "Application.java"]


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_entry_name(path: Column) -> Column:
    """One of the whole names, or an entry's stem in any case with the extension of code."""
    name = base_name(path)
    return name.isin(*ENTRY_NAMES) | (F.lower(F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).isin(*ENTRY_STEMS) & F.regexp_extract(name, r"\.([^.]*)$", 1).isin(*ENTRY_EXTENSIONS))


def is_test_path(path: Column) -> Column:
    """A test directory among the segments, or a test file name."""
    return path.rlike(r"(^|/)(tests?|__tests__|spec|specs)/") | base_name(path).rlike(r"(^test_.*\.py$)|(_test\.(go|py|dart|rb|cc|cpp)$)|(\.(test|spec)\.[cm]?[jt]sx?$)|((Test|Tests|IT|Spec)\.(java|kt|cs|scala|swift|php)$)|(_spec\.rb$)")
