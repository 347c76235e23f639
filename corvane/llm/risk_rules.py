"""Quality rules with risk-controlled thresholds (operator 3).

Each rule rejects a text whose measure is above a cutoff. A cutoff is certified for a stratum
if the labelled good documents of the stratum show, by an exact binomial test, that it rejects
at most ``risk`` / (number of rules) of good documents: with k of n good ones rejected, the
probability of k or fewer at that rate must be at most ``error`` / (strata x rules x cutoffs),
the Bonferroni correction over everything that is tested. So, with probability 1 - ``error``,
all rules together reject at most ``risk`` of the good documents of every stratum. Of the
certified cutoffs a rule takes the one with the largest share of bad ones rejected less
``CARE`` times the share of good ones; a rule without a certified cutoff that rejects anything
bad doesn't apply in that stratum, and a stratum with too few labels has no rules at all.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import codes_of, lengths_to_rows, map_texts, mix64, space_words, sums, utf8_buffer
from corvane.llm.recovery import stored

RISK, ERROR, CARE = 0.02, 0.05, 10.0
SYMBOLS = b"#*$%&|<>"

#: By rule: the measure from the signals, and its cutoffs.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / nullif(n_words, 0)", [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0]),
    "long_words": ("word_chars / nullif(n_words, 0)", [5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0]),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5]),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.45]),
}

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text."""
    n = len(texts)
    data, at = utf8_buffer(texts)
    offsets, words = space_words(texts)
    code, _ = codes_of(words)
    row = lengths_to_rows(offsets)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    is_space = np.zeros(256, bool)
    is_space[[32, *range(9, 14)]] = True
    starts = (data & 0xC0) != 0x80  # one byte of each code point
    out = {"n_words": np.diff(offsets), "word_chars": sums(starts & ~is_space[data], at), "n_symbols": sums(is_symbol[data], at)}

    lists = pc.split_pattern(texts, "\n")
    line_at = np.asarray(lists.offsets).astype(np.int64)
    lines = lists.values.slice(line_at[0], line_at[-1] - line_at[0])
    line_row = lengths_to_rows(line_at - line_at[0])
    has_word = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_code, _ = codes_of(lines)
    line_row, line_code = line_row[has_word], line_code[has_word]
    _, first = np.unique(line_row * (len(lines) + 1) + line_code, return_index=True)
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[first], minlength=n)

    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(code) >= 3:
        same = row[2:] == row[:-2]
        at3 = np.flatnonzero(same)
        a, b, c = code[at3].astype(np.uint64), code[at3 + 1].astype(np.uint64), code[at3 + 2].astype(np.uint64)
        key = mix64(mix64(mix64(a + np.uint64(1)) + b) + c) ^ mix64(row[at3].astype(np.uint64) << np.uint64(32))
        order = np.argsort(key, kind="stable")
        place = at3[order]
        equal = (key[order][1:] == key[order][:-1]) & (row[place[1:]] == row[place[:-1]])
        for k in range(3):  # hashes only sort; the words decide
            equal &= code[place[1:] + k] == code[place[:-1] + k]
        twice = np.zeros(len(place), bool)
        twice[1:] |= equal
        twice[:-1] |= equal
        covered = np.zeros(len(code), bool)
        for k in range(3):
            covered[place[twice] + k] = True
        out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def signals(docs: DataFrame, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each document; null texts have no words."""
    return map_texts(docs, text_signals, SIGNALS, id_col, text_col, keep)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in repeated windows."""
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws of probability p, exactly summed."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def choose_cutoffs(counts: Sequence[tuple[str, str, int, int, int]], strata: int, risk: float = RISK, error: float = ERROR, care: float = CARE) -> dict[tuple[str, str], float]:
    """(stratum, rule) -> cutoff, from rows (stratum, rule, how many cutoffs the measure exceeds, good 0/1, documents)."""
    level = error / max(1, strata * sum(len(c) for _, c in RULES.values()))
    table: dict = defaultdict(lambda: [[0, 0] for _ in range(99)])
    for stratum, rule, passed, good, n in counts:
        table[stratum, rule][passed][good] += n
    chosen = {}
    for (stratum, rule), by_passed in table.items():
        n_bad, n_good = (sum(x[g] for x in by_passed) for g in (0, 1))
        best = 0.0
        for i, cutoff in enumerate(RULES[rule][1]):
            bad, good = (sum(x[g] for x in by_passed[i + 1 :]) for g in (0, 1))
            if not n_good or not bad or binomial_tail(good, n_good, risk / len(RULES)) > level:
                continue
            gain = bad / n_bad - care * good / n_good
            if gain > best:
                best, chosen[stratum, rule] = gain, cutoff
    return chosen


def stratum_key(column: str) -> Column:
    """The name of a row's stratum: null has one of its own, apart from the empty string's."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def learn_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """Cutoffs from all labelled documents that pass the base rules; what reaches the driver is one count for each stratum, rule and cutoff."""
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("__label_id")).agg(F.min("quality").alias("__good"))
    rows = measured.where(~base_failed()).select(F.col(id_col).alias("__row_id"), stratum_key(stratum).alias("s"), *[c.split()[0] for c in SIGNALS.split(", ")]).join(good, F.col("__row_id") == F.col("__label_id"))
    passed = [F.expr(f"struct('{r}' as rule, " + " + ".join(f"int({m} > {c!r}D)" for c in cuts) + " as passed)") for r, (m, cuts) in RULES.items()]
    counts = rows.select("s", F.least(F.greatest("__good", F.lit(0)), F.lit(1)).alias("g"), F.explode(F.array(*passed)).alias("p")).groupBy("s", "p.rule", "p.passed", "g").count()
    found = [tuple(r) for r in counts.collect()]
    return choose_cutoffs(found, len({r[0] for r in found}), risk, error)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per document: id, ``keep``, the counts, base_failed, failed_rules (array) and kept.

    Null and empty texts have no words and so fail the base rules. A null stratum is one of its
    own. Without labels only the base rules apply. Labels of one id that differ count as the
    lower quality; repeated documents each get a row; an empty table gives an empty result.
    A kept column that is called like a result gives way to it. The texts are read once; the
    counts go to the shared folder, as both the cutoffs and the verdicts need them. The plan holds one number
    for each stratum and rule with a certified cutoff; a stratum needs hundreds of labels for that, so they are few.
    """
    renamed = docs.withColumn("__stratum", F.col(stratum).cast("string"))
    measured = stored(signals(renamed, [*keep, "__stratum"], id_col, text_col))
    cutoffs = learn_cutoffs(measured, labels, "__stratum", id_col, risk, error)
    failed = []
    for rule, (measure, _) in RULES.items():
        own = {s: c for (s, r), c in cutoffs.items() if r == rule}
        if own:
            table = F.create_map(*[F.lit(x) for pair in sorted(own.items()) for x in pair])
            over = F.expr(measure) > F.try_element_at(table, stratum_key("__stratum"))
            failed.append(F.when(over, F.lit(rule)))
    verdict = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    out = measured.withColumn("base_failed", base_failed()).withColumn("failed_rules", verdict)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("__stratum")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, with cutoffs from all labels, by language."""
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    rules = "\n  UNION ALL ".join(f"SELECT s, g, '{r}' AS rule, CAST({i} AS INT) AS i, CAST({c} AS DOUBLE) AS cutoff, CAST({m} AS DOUBLE) > {c} AS over FROM labelled" for r, (m, cuts) in RULES.items() for i, c in enumerate(cuts))
    verdict = "\n  UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, CAST({m} AS DOUBLE) AS measure, s FROM base WHERE NOT base_failed" for r, (m, _) in RULES.items())
    tests = sum(len(c) for _, c in RULES.values())
    rate = RISK / len(RULES)
    return rf"""
WITH t AS (SELECT doc_id, coalesce('=' || lang, '') AS s, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, s, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
grams AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM grams) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, w.s, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    len(w) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(w) AS base_failed
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id
),
labelled AS (SELECT base.*, g FROM base JOIN (SELECT doc_id, least(greatest(min(quality), 0), 1) AS g FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id) USING (doc_id) WHERE NOT base_failed),
tests AS (SELECT s, rule, i, cutoff, count(*) FILTER (g = 1) AS n_good, count(*) FILTER (g = 0) AS n_bad, count(*) FILTER (g = 1 AND over) AS good, count(*) FILTER (g = 0 AND over) AS bad FROM ({rules}) GROUP BY ALL),
certified AS (
  SELECT *, bad / n_bad - {CARE} * good / n_good AS gain FROM tests
  WHERE n_good > 0 AND bad > 0 AND good < n_good AND list_sum(list_transform(range(0, good + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({rate}) + (n_good - j) * ln(1 - {rate})))) <= {ERROR} / ((SELECT count(DISTINCT s) FROM labelled) * {tests})
),
cuts AS (SELECT s, rule, cutoff FROM certified WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY s, rule ORDER BY gain DESC, i) = 1),
bad AS (SELECT DISTINCT doc_id FROM ({verdict}) AS m JOIN cuts USING (s, rule) WHERE measure > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM base
"""


OP3_SQL = _oracle()
