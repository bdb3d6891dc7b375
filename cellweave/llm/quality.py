"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition on measures of the text. Cost and rejection rate of each rule are measured on a sample, the
rules are put in the order of rejections per unit of cost, and a document is tested until the first rule rejects it.
The order changes the work, never the verdict: a document is kept when no rule rejects it.

Defined results: a null text is an empty text (no words, rejected); repeated rows are judged one by one; an empty
table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import free_name, let, text_of, words_of
from cellweave.operators.scale import pinned
from cellweave.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
WINDOW_WORDS = 8
SAMPLE_ROWS = 2_000


def n_words(words: Column) -> Column:
    return F.size(words).cast("bigint")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.char_length(F.array_join(words, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def n_repeat_words(words: Column, width: int = WINDOW_WORDS) -> Column:
    """Words that lie in a window of ``width`` (8) words which the text holds at least twice.

    Windows are compared by a 64-bit hash that is built by doubling: pairs, then fours, then eights. Only a text with
    a repeated hash sorts its (hash, position) pairs; the words covered follow from the gaps between the positions.
    """
    if width != 8:
        raise ValueError("windows have eight words")

    def paired(hashes: Column, step: int) -> Column:
        n = F.size(hashes) - step
        return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))

    def covered(windows: Column) -> Column:
        def positions(pairs: Column) -> Column:
            def place(p: Column, k: Column) -> Column:
                same_next = F.get(pairs, k + 1)["h"] == p["h"]
                same_last = F.when(k > 0, F.get(pairs, k - 1)["h"] == p["h"])
                return F.when(F.coalesce(same_next, F.lit(False)) | F.coalesce(same_last, F.lit(False)), p["i"])

            return F.array_sort(F.array_compact(F.transform(pairs, place)))

        def total(at: Column) -> Column:
            n = F.size(at) - 1
            gaps = F.zip_with(F.slice(at, F.lit(1), n), F.slice(at, F.lit(2), n), lambda a, b: F.least(b - a, F.lit(width)))
            return F.aggregate(gaps, F.lit(width), lambda s, g: s + g)

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda p: let(positions(p), total))

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(let(hashed, lambda h: paired(h, 1)), lambda h2: let(paired(h2, 2), lambda h4: paired(h4, 4)))
    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(windows, count)).cast("bigint")


def measures(text: Column, words: Column) -> dict[str, Column]:
    """All measures as expressions over a text and its words; each is evaluated only where a rule asks for it."""
    return {
        "n_words": n_words(words),
        "word_chars": word_chars(words),
        "n_symbols": n_symbols(text),
        "n_dup_lines": n_dup_lines(text),
        "n_lines": F.size(_lines_with_words(text)).cast("bigint"),
        "n_repeat_words": n_repeat_words(words),
    }


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the measures to the condition under which a document goes; it is never null."""

    name: str
    rejects: Callable[[Mapping[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 20),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
MORE_RULES = (
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("short_words", lambda m: m["word_chars"] < 2 * m["n_words"]),
    Rule("long_words", lambda m: m["word_chars"] > 14 * m["n_words"]),
)
RULES = BASE_RULES + MORE_RULES


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.cost, 1e-9)


def estimate_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Estimate]:
    """Seconds and rejection rate of every rule on a hash sample of about ``sample_rows`` documents, best rule first.

    The sample is stored once; each rule then runs alone over it, and the cost of reading the sample is taken off.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    drawn = F.pmod(F.xxhash64(text_of(text), F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = cut_lineage(docs.select(text_of(text).alias("text")).where(drawn))
    words = words_of(F.col("text"))
    m = measures(F.col("text"), words)

    def timed(condition: Column) -> tuple[float, int, int]:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            n, hit = sample.agg(F.count(F.lit(1)), F.count_if(condition)).first()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        return best, n, hit

    idle, n, _ = timed(F.char_length("text") < 0)
    found = []
    for rule in rules:
        seconds, n, hit = timed(rule.rejects(m))
        found.append(Estimate(rule, max(seconds - idle, 1e-4), hit / max(n, 1)))
    return sorted(found, key=lambda e: (-e.worth, e.cost, e.rule.name))


def cascade(rules: list[Rule], m: Mapping[str, Column]) -> Column:
    """Name of the first rule that rejects; later rules are not evaluated. Null if none does."""
    chain = None
    for rule in rules:
        chain = F.when(rule.rejects(m), F.lit(rule.name)) if chain is None else chain.when(rule.rejects(m), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Keep the documents that no rule rejects, with their columns unchanged."""
    ordered = [e.rule for e in estimate_rules(docs, rules, text)]
    words, verdict = free_name(docs, "_words"), free_name(docs, "_rejected_by")
    split = docs.withColumn(words, pinned(words_of(text_of(text))))
    judged = split.withColumn(verdict, pinned(cascade(ordered, measures(text_of(text), F.col(words)))))
    return judged.where(F.col(verdict).isNull()).drop(words, verdict)


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document with its measures, the verdict of the base rules and the verdict of the whole cascade."""
    ordered = [e.rule for e in estimate_rules(docs, rules, text)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("_text"))
    split = rows.withColumn("_words", pinned(words_of(F.col("_text"))))
    m = measures(F.col("_text"), F.col("_words"))
    known = split.select("doc_id", *[m[n].alias(n) for n in names])
    have = {n: F.col(n) for n in names}
    base = F.coalesce(cascade(list(BASE_RULES), have).isNotNull(), F.lit(False))
    return known.withColumn("base_failed", base).withColumn("kept", ~base & cascade(ordered, have).isNull())


def query(spark, sf_dir: str) -> DataFrame:
    from cellweave.llm.common import load

    return quality_report(load(spark, sf_dir, "documents"))


#: The same measures and rules; windows are joined to themselves by their words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM w, unnest(range(1, len(words) - 6)) AS u(i)
        WHERE len(words) >= 8),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, unnest(range(0, 8)) AS u(k) GROUP BY r),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM m
"""
