"""Readers of source files: language and category of a path, selection, and structure through Python workers.

A reader takes a text and returns declarations, imports and calls. Python's own syntax tree reads
Python; other languages have line grammars, which give names and lines and leave the rest to gaps.
"""

from __future__ import annotations

import ast
import fnmatch
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by file extension, and by whole file name.
LANGUAGES = {"py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "swift": "swift", "dart": "dart", "scala": "scala", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "sql": "sql", "md": "markdown", "yml": "yaml", "yaml": "yaml", "json": "json", "toml": "toml", "xml": "xml", "html": "html", "css": "css", "sh": "shell", "tf": "terraform", "proto": "protobuf", "graphql": "graphql", "feature": "gherkin", "env": "env"}
NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", ".env": "env"}
CATEGORIES = {"markdown": "docs", "yaml": "config", "json": "config", "toml": "config", "env": "config", "xml": "config", "sql": "data", "dockerfile": "infra", "makefile": "infra", "terraform": "infra", "shell": "script"}
# Suffixes of files that hold keys, and of archives.
SENSITIVE = [".pem", ".key", ".ks", ".jks", ".pfx", ".p12", ".set", ".keystore"]
ARCHIVES = [".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".jar", ".war"]

STRUCTURE = (
    "path string, status string, total_lines int, non_empty_lines int, "
    "functions array<struct<name string, owner string, start int, end int, params array<string>>>, classes array<struct<name string, start int, end int, methods array<string>>>, "
    "imports array<struct<source string, names array<string>, line int>>, calls array<struct<caller string, callee string, line int>>"
)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def language(path: Column) -> Column:
    """By the whole name, then the extension; unknown otherwise."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.coalesce(F.element_at(_map(NAMES), name), F.element_at(_map(LANGUAGES), ext), F.lit("unknown"))


def category(lang: Column) -> Column:
    return F.coalesce(F.element_at(_map(CATEGORIES), lang), F.when(lang == "unknown", "other").otherwise("code"))


def selection(path: Column, head: Column, ignored: Column) -> Column:
    """The first that applies: sensitive, private-key, archive, ignored, else selected."""
    low = F.lower(path)
    ends = lambda xs: F.exists(F.array(*[F.lit(x) for x in xs]), lambda x: F.endswith(low, x))
    return F.when(ends(SENSITIVE), "sensitive").when(F.coalesce(head, F.lit("")).rlike("-----BEGIN [A-Z ]*PRIVATE KEY-----"), "private-key").when(ends(ARCHIVES), "archive").when(ignored, "ignored").otherwise("selected")


def ignore_filter(patterns: Sequence[str]) -> Callable[[Column], Column]:
    """A predicate of gitignore patterns: the last that matches decides, ! takes back, a final / is a directory."""

    def compiled() -> list[tuple[bool, re.Pattern]]:
        out = []
        for p in patterns:
            keep, body = p.startswith("!"), p.lstrip("!").strip()
            if not body or body.startswith("#"):
                continue
            anchored = "/" in body.rstrip("/")
            parts = [".*" if x == "**" else fnmatch.translate(x).removeprefix("(?s:").removesuffix(r")\Z").replace(".*", "[^/]*") for x in body.strip("/").split("/")]
            out.append((keep, re.compile(("" if anchored else "(?:.*/)?") + "/".join(parts).replace(".*/", "(?:.*/)?") + ("/.*" if body.endswith("/") else "(?:/.*)?") + r"\Z", re.DOTALL)))
        return out

    @F.pandas_udf("boolean")
    def ignored(paths: pd.Series) -> pd.Series:
        rules = compiled()

        def one(path: str) -> bool:
            hit = False
            for keep, rule in rules:
                if rule.match(path):
                    hit = not keep
            return hit

        return paths.map(one)

    return ignored


def read_python(text: str) -> dict:
    """Functions, classes, imports and calls by Python's syntax tree."""
    tree = ast.parse(text)
    out: dict[str, list] = {"functions": [], "classes": [], "imports": [], "calls": []}

    def walk(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            own, who = owner, caller
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out["functions"].append({"name": child.name, "owner": owner, "start": child.lineno, "end": child.end_lineno, "params": [a.arg for a in child.args.args]})
                own, who = None, child.name
            elif isinstance(child, ast.ClassDef):
                out["classes"].append({"name": child.name, "start": child.lineno, "end": child.end_lineno, "methods": [x.name for x in child.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]})
                own = child.name
            elif isinstance(child, ast.Import):
                out["imports"] += [{"source": a.name, "names": [a.asname or a.name], "line": child.lineno} for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out["imports"].append({"source": "." * child.level + (child.module or ""), "names": [a.name for a in child.names], "line": child.lineno})
            elif isinstance(child, ast.Call):
                f = child.func
                out["calls"].append({"caller": caller, "callee": f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None, "line": child.lineno})
            walk(child, own, who)

    walk(tree, None, None)
    out["calls"] = [c for c in out["calls"] if c["callee"]]
    return out


def line_reader(function: str, kind: str, include: str) -> Callable[[str], dict]:
    """A reader of names on lines by patterns with one group each."""
    compiled = [re.compile(p) for p in (function, kind, include)]

    def read(text: str) -> dict:
        out: dict[str, list] = {"functions": [], "classes": [], "imports": [], "calls": []}
        for n, line in enumerate(text.split("\n"), 1):
            for what, pattern in zip(("functions", "classes", "imports"), compiled, strict=True):
                if m := pattern.search(line):
                    name = next(g for g in m.groups() if g is not None)
                    out[what].append({"functions": {"name": name, "owner": None, "start": n, "end": n, "params": []}, "classes": {"name": name, "start": n, "end": n, "methods": []}, "imports": {"source": name, "names": [], "line": n}}[what])
                    break
        return out

    return read


READERS: dict[str, Callable[[str], dict]] = {
    "python": read_python,
    "javascript": line_reader(r"\bfunction\s*\*?\s*(\w+)|\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"\bclass\s+(\w+)", r"""\bfrom\s+['"]([^'"]+)|\brequire\(['"]([^'"]+)"""),
    "typescript": line_reader(r"\bfunction\s*\*?\s*(\w+)|\b(?:const|let)\s+(\w+)\s*=\s*(?:async\s*)?\(", r"\b(?:class|interface|enum)\s+(\w+)", r"""\bfrom\s+['"]([^'"]+)"""),
    "java": line_reader(r"^\s+(?:public|protected|private|static|final|\s)+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*\{", r"\b(?:class|interface|enum|record)\s+(\w+)", r"^import\s+(?:static\s+)?([\w.*]+)"),
    "go": line_reader(r"^func\s+(?:\([^)]*\)\s*)?(\w+)", r"^type\s+(\w+)", r"""^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"$"""),
    "rust": line_reader(r"\bfn\s+(\w+)", r"\b(?:struct|enum|trait)\s+(\w+)", r"^\s*use\s+([\w:]+)"),
    "ruby": line_reader(r"^\s*def\s+([\w.?!]+)", r"^\s*(?:class|module)\s+([\w:]+)", r"""^\s*require(?:_relative)?\s+['"]([^'"]+)"""),
    "php": line_reader(r"\bfunction\s+(\w+)", r"\b(?:class|interface|trait)\s+(\w+)", r"^\s*use\s+([\w\\]+)"),
    "csharp": line_reader(r"^\s+(?:public|protected|private|internal|static|\s)+[\w<>\[\], ]+\s+(\w+)\s*\(", r"\b(?:class|interface|struct|enum|record)\s+(\w+)", r"^\s*using\s+([\w.]+)\s*;"),
    "kotlin": line_reader(r"\bfun\s+(?:<[^>]*>\s*)?(\w+)", r"\b(?:class|interface|object)\s+(\w+)", r"^import\s+([\w.*]+)"),
    "scala": line_reader(r"\bdef\s+(\w+)", r"\b(?:class|trait|object)\s+(\w+)", r"^\s*import\s+([\w.{},_ ]+)"),
    "swift": line_reader(r"\bfunc\s+(\w+)", r"\b(?:class|struct|enum|protocol)\s+(\w+)", r"^\s*import\s+(\w+)"),
    "dart": line_reader(r"^\s*[\w<>?]+\s+(\w+)\s*\([^;]*\{", r"\b(?:class|mixin|enum)\s+(\w+)", r"""^import\s+['"]([^'"]+)"""),
    "c": line_reader(r"^[\w*][\w\s*]*\b(\w+)\s*\([^;]*$", r"\b(?:struct|enum|union)\s+(\w+)", r"""^\s*#\s*include\s+[<"]([^>"]+)"""),
    "cpp": line_reader(r"^[\w*:&<>][\w\s*:&<>,]*\b(\w+)\s*\([^;]*$", r"\b(?:class|struct|enum)\s+(\w+)", r"""^\s*#\s*include\s+[<"]([^>"]+)"""),
    "sql": line_reader(r"(?i)create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.]+)", r"(?i)create\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.]+)", r"(?i)references\s+([\w.]+)"),
    "markdown": line_reader(r"\A(?!)()", r"^#{1,6}\s+(.+?)\s*$", r"\]\(([^)\s]+)\)"),
    "yaml": line_reader(r"\A(?!)()", r"^([\w.-]+):", r"\A(?!)()"),
    "toml": line_reader(r"\A(?!)()", r"^\[+([^\]]+)\]+", r"\A(?!)()"),
    "env": line_reader(r"\A(?!)()", r"^(?:export\s+)?([A-Za-z_]\w*)\s*=", r"\A(?!)()"),
    "dockerfile": line_reader(r"(?i)^(?:cmd|entrypoint)\s+(.+)", r"(?i)\bas\s+(\w+)\s*$", r"(?i)^from\s+(\S+)"),
    "makefile": line_reader(r"^([\w.-]+)\s*:(?!=)", r"\A(?!)()", r"^include\s+(\S+)"),
    "shell": line_reader(r"^\s*(?:function\s+)?(\w+)\s*\(\)", r"\A(?!)()", r"^\s*(?:source|\.)\s+(\S+)"),
    "terraform": line_reader(r"^output\s+\"(\w+)\"", r"^resource\s+\"[\w-]+\"\s+\"([\w-]+)\"|^variable\s+\"([\w-]+)\"", r"^module\s+\"([\w-]+)\""),
    "protobuf": line_reader(r"^\s*rpc\s+(\w+)", r"^\s*(?:message|enum|service)\s+(\w+)", r"^import\s+\"([^\"]+)\""),
    "graphql": line_reader(r"^\s*(?:query|mutation|subscription)\s+(\w+)", r"^\s*(?:type|input|enum|interface|union|scalar)\s+(\w+)", r"\A(?!)()"),
    "gherkin": line_reader(r"^\s*(?:Given|When|Then|And)\s+(.+)", r"^\s*(?:Feature|Scenario(?: Outline)?):\s*(.+)", r"\A(?!)()"),
}


def extract_structure(files: DataFrame, readers: dict[str, Callable[[str], dict]] | None = None) -> DataFrame:
    """Files (path, language, text) to STRUCTURE rows: status parsed, zero-symbol, no-extractor or parse-failed."""
    table = readers or READERS

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, lang, text in zip(part["path"], part["language"], part["text"], strict=True):
                text = text or ""
                lines = text.split("\n")
                row = {"path": path, "status": "no-extractor", "total_lines": len(lines), "non_empty_lines": sum(1 for x in lines if x.strip()), "functions": [], "classes": [], "imports": [], "calls": []}
                if lang in table:
                    try:
                        row |= table[lang](text)
                        row["status"] = "parsed" if row["functions"] or row["classes"] or row["imports"] else "zero-symbol"
                    except (SyntaxError, ValueError, RecursionError):
                        row["status"] = "parse-failed"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["path", "status", "total_lines", "non_empty_lines", "functions", "classes", "imports", "calls"])

    return files.select("path", "language", "text").mapInPandas(run, STRUCTURE)
