"""Quality rules as a short-circuit cascade, ordered by rejection per cost as estimated on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import text_slices

SPACE, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
WINDOW, SAMPLE_ROWS = 5, 2000


class Text:
    """A text whose measures are taken when first asked for, and kept."""

    def __init__(self, text: str):
        self.text, self._kept = text, {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._kept:
            self._kept[name] = MEASURES[name](self)
        return self._kept[name]


def _repeat_words(t: Text) -> int:
    """Words in 5-word windows that the text has twice or more."""
    words = t.words
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(WINDOW)), strict=True))
    first: dict = {}
    if len(set(windows)) == n:
        return 0
    twice = np.zeros(n, bool)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            twice[i] = twice[j] = True
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : n + i] |= twice
    return int(covered.sum())


MEASURES: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.text.encode("utf-8", "surrogatepass").split(),
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, SPACE)),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "lines": lambda t: [x for x in t.text.split("\n") if x.strip(SPACE)],
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": _repeat_words,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A text is rejected where `fails` holds."""

    name: str
    fails: Callable[[Text], bool]


# Whole-number comparisons, so that no verdict hangs on rounding.
BASE = (
    Rule("short", lambda t: t.n_words < 10),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
MORE = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("dup_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 25 * t.n_words),
)
RULES = BASE + MORE


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on a random sample of about `rows` texts, each rule measured afresh.

    Tasks send sums per rule. The sample sets only the order in which rules run, never a verdict."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, failed, n = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for _, texts in text_slices(batches):
            for text in texts.to_pylist():
                n += 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    failed[i] += rule.fails(Text(text))
                    spent[i] += time.perf_counter() - began
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(spent), pa.array(failed), pa.array([n] * len(rules))], names=["rule", "spent", "failed", "n"])

    total = docs.count()
    sample = docs.select("text").sample(fraction=min(1.0, rows / max(total, 1)), seed=17)
    sums = sample.mapInArrow(measure, "rule string, spent double, failed long, n long").groupBy("rule").agg(F.sum("spent"), F.sum("failed"), F.sum("n")).collect()
    return [(name, spent / n, failed / n) for name, spent, failed, n in sums]


def order_rules(estimates: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second, most first; ties and rules without an estimate keep their order."""
    gain = {name: share / max(cost, 1e-9) for name, cost, share in estimates}
    return tuple(sorted(rules, key=lambda r: -gain.get(r.name, 0.0)))


def verdict(text: Text, ordered: tuple[Rule, ...]) -> str | None:
    """The first rule that rejects the text; those after it do not run."""
    return next((r.name for r in ordered if r.fails(text)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """docs with rejected_by: null for a text that every rule accepts, else one rule that rejects it.

    Whether it is null does not depend on the order. A null or empty text has no words, so `short` rejects it. Rows
    that repeat are judged each; a column named rejected_by is replaced; an empty table gives no rows."""
    docs = docs.drop("rejected_by")
    ordered = ordered or order_rules(estimate(docs, rules), rules)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = [verdict(Text(t), ordered) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string())], names=[*columns, "rejected_by"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("rejected_by", T.StringType())]))


def measure_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts of every whole text, base_failed, and kept: what no rule rejects.

    The measures that the counts asked for are not taken again by the rules."""
    ordered = order_rules(estimate(docs, rules), rules)
    base = {r.name for r in BASE}
    extra = tuple(r for r in ordered if r.name not in base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = []
            for text in texts.to_pylist():
                t = Text(text)
                failed = any(r.fails(t) for r in BASE)
                rows.append((*(getattr(t, c) for c in COUNTS), failed, not failed and verdict(t, extra) is None))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in cols)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT row, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
g AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM (
    SELECT row, unnest(range(1, len(ws) - 3)) AS i,
      unnest(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4])) AS win
    FROM w WHERE len(ws) >= 5)),
cover AS (SELECT row, count(DISTINCT i + k) AS n FROM g, range(5) r(k) WHERE g.n > 1 GROUP BY row),
m AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(cover.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN cover USING (row)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""
