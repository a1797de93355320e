"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule rejects a document by a condition over measures of its text. ``plan_cascade`` times every rule on a sample,
counts how many documents it rejects there, and orders the rules by rejections per second; ``verdict`` is then one
CASE whose branches stand in that order, so that Spark stops at the first rule that rejects. The order changes the
time, never the verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pastward.llm.shared import SPACE_CLASS, SPACES

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: About so many documents, picked by a hash of id and text, are timed and counted to order the rules.
SAMPLE = 500


@dataclass(frozen=True)
class Rule:
    """Rejects where ``rejects(measures)`` is true; ``needs`` names the measures that it reads."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[dict[str, Column]], Column]


#: The base rules are part of the contract of the query; the others are the method's own.
BASE_RULES = [
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
]
OWN_RULES = [
    Rule("symbols", ("n_symbols", "word_chars"), lambda m: 100 * m["n_symbols"] > 5 * m["word_chars"]),
    Rule("capitals", ("n_capital_words", "n_words"), lambda m: 100 * m["n_capital_words"] > 50 * m["n_words"]),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda m: 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
]
RULES = BASE_RULES + OWN_RULES


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda line: _without(line, SPACES) != "")


def measured(docs: DataFrame, names: set[str], text_col: str = "text") -> DataFrame:
    """Add the named measures of the whole text (null: empty), all of them ``long``.

    word_chars: code points in words. n_symbols: characters of ``SYMBOLS``. n_lines: lines with a word;
    n_dup_lines: those equal to an earlier one. n_words. n_repeat_words: words in windows of eight words that stand
    twice or more in the text, the first included. n_capital_words: words of two or more code points whose lower
    case differs but whose upper case doesn't. Everything is computed inside the row; nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs
    if "word_chars" in names:
        out = out.withColumn("word_chars", F.length(_without(text, SPACES)).cast("long"))
    if "n_symbols" in names:
        out = out.withColumn("n_symbols", (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long"))
    if names & {"n_lines", "n_dup_lines"}:
        out = out.withColumn("_lines", _lines(text)).withColumns({
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }).drop("_lines")
    if names & {"n_words", "n_repeat_words", "n_capital_words"}:
        out = out.withColumn("_words", F.array_remove(F.split(text, f"{SPACE_CLASS}+"), ""))
        out = out.withColumn("n_words", F.size("_words").cast("long"))
        if "n_capital_words" in names:
            capital = F.filter("_words", lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) > 1))
            out = out.withColumn("n_capital_words", F.size(capital).cast("long"))
        if "n_repeat_words" in names:
            out = _repeated(out)
        out = out.drop("_words")
    return out


def _repeated(rows: DataFrame) -> DataFrame:
    """Words covered by repeated windows. Only texts that have a repeated window are sorted."""
    last = F.size("_words") - WINDOW
    hashes = F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW)))))
    rows = rows.withColumn("_windows", hashes)
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_ordered", F.when(repeats, ordered))

    def twin(k, other):
        return F.get("_ordered", k)["h"] == F.get("_ordered", other)["h"]

    places = F.filter(F.sequence(F.lit(0), F.size("_ordered") - 1), lambda k: F.coalesce(twin(k, k - 1), F.lit(False)) | F.coalesce(twin(k, k + 1), F.lit(False)))
    starts = F.array_sort(F.transform(places, lambda k: F.get("_ordered", k)["i"]))
    rows = rows.withColumn("_starts", F.when(F.col("_ordered").isNotNull(), starts))
    steps = F.transform("_starts", lambda start, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - start, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_windows", "_ordered", "_starts")


def plan_cascade(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[tuple[Rule, float, float]]:
    """Rules in the order to try them, with the share rejected and the seconds taken on the sample.

    The sample comes from all of the table: about ``sample`` rows by a hash of id and text, and never more than four
    times as many, however often an id or a text repeats. It decides about the order only. Without rows the given order stays.
    """
    total = docs.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in rules]
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = chosen.filter(F.pmod(F.xxhash64("id", "text"), F.lit(max(1, total // sample))) == 0).limit(4 * sample).persist()
    try:
        seen = max(1, chosen.count())
        found = []
        for rule in rules:
            rows = measured(chosen, set(rule.needs))
            rejected = rows.agg(F.count_if(rule.rejects({n: F.col(n) for n in rule.needs})))
            rejected.head()  # compiled before it is timed
            began = time.perf_counter()
            count = rejected.head()[0]
            found.append((rule, count / seen, time.perf_counter() - began))
    finally:
        chosen.unpersist()
    return sorted(found, key=lambda x: (-x[1] / max(x[2], 1e-6), x[0].name))


def verdict(rules: list[Rule], measures: dict[str, Column]) -> Column:
    """True where no rule rejects; stops at the first that does."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(rule.rejects(measures), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and: the measures, ``base_failed``, ``kept``.

    Null text counts as empty and fails; columns of ``docs`` named like a measure are replaced; rows are never lost or
    merged. An empty table gives an empty result.
    """
    names = {"word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_words", "n_repeat_words", "n_capital_words"}
    order = [rule for rule, _, _ in plan_cascade(docs, rules, id_col, text_col)]
    rows = measured(docs, names, text_col)
    columns = {n: F.col(n) for n in names}
    failed = BASE_RULES[0].rejects(columns) | BASE_RULES[1].rejects(columns)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & verdict(order, columns)})


def kept_documents(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns.

    Works rule by rule in the planned order: each rule's measures are computed only for rows that the rules before
    it let through.
    """
    columns, out = docs.columns, docs
    for rule, _, _ in plan_cascade(docs, rules, id_col, text_col):
        own = measured(out.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text_col).alias("text")), set(rule.needs))
        out = own.filter(~rule.rejects({n: F.col(n) for n in rule.needs})).select("row.*")
    return out


#: The same result for DuckDB, over the view ``documents`` (ids distinct). The order of the rules plays no part.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (
 SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(text, chr(10)), lambda l: translate(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13), '') <> '') AS lines,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols FROM docs),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM words WHERE len(w) >= 8)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
m AS (
 SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x) AND length(x) > 1)) AS BIGINT) AS n_capital_words
 FROM words LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  100 * n_symbols > 5 * word_chars OR 100 * n_capital_words > 50 * n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS rejected FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM judged
"""
