"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\\x20\\x09-\\x0D]+"

#: Frequent function words of English, German, French and Spanish, as written inside and at the start of a sentence.
STOP_WORDS = (
    "the of and to in is that it on for was with be at this by are from an or "
    "der die und den von zu das mit sich des auf ist im dem ein eine nicht als "
    "la le les et du un une que est pour qui dans au sur par pas avec "
    "el los las se del por con una para es su al lo no"
).split()


class Rule(NamedTuple):
    """``low * per <= 100 * (share + plus) <= high * per``; an open side is None."""

    name: str
    share: str
    per: str
    low: int | None = None
    high: int | None = None
    plus: int = 0


#: The base rules, which hold for every user of the table.
BASE = (
    Rule("few_words", "n_words", "1", low=1000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=20),
)
#: The thresholds of this method: mean word length, symbols a word, stop words (one is granted), repeated lines.
RULES = (
    Rule("short_words", "word_chars", "n_words", low=200),
    Rule("long_words", "word_chars", "n_words", high=2000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "2 * n_stop_words", "n_words", low=1, plus=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
)


def compiled(rules: tuple[Rule, ...]) -> str:
    """SQL condition that holds if all rules do."""
    parts = []
    for r in rules:
        value = f"100 * ({r.share} + {r.plus})"
        if r.low is not None:
            parts.append(f"{value} >= {r.low} * ({r.per})")
        if r.high is not None:
            parts.append(f"{value} <= {r.high} * ({r.per})")
    return " AND ".join(parts)


def stop_forms() -> list[str]:
    return sorted({*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)})


def measures(text: str = "text") -> str:
    """SQL expression: an array with one struct of the counts of ``text``.

    ``transform(array(x), y -> ...)`` names a value that is used several times, so that it is computed once.
    """
    stop = ", ".join(f"'{w}'" for w in stop_forms())
    # s: windows in order of their words; p: the places of those that occur again, in order
    repeated = """CASE WHEN size(w) < 6 THEN 0L ELSE
      transform(array(transform(sequence(0, size(w) - 5), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), h ->
        CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE
          transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
            transform(array(sort_array(transform(
              filter(sequence(0, size(s) - 1), j -> get(s, j - 1).x <=> s[j].x OR get(s, j + 1).x <=> s[j].x),
              j -> s[j].i))), p ->
              aggregate(sequence(1, size(p) - 1), 5L, (sum, j) -> sum + least(5, p[j] - p[j - 1])))[0])[0] END)[0] END"""
    lines = rf"filter(split(_t, '\\n'), l -> l RLIKE '[^\\x20\\x09-\\x0D]')"
    return f"""transform(array(coalesce(`{text}`, '')), _t -> transform(array(filter(split(_t, '{_SPACE}'), x -> x != '')), w ->
      transform(array({lines}), l -> named_struct(
        'n_words', CAST(size(w) AS BIGINT),
        'word_chars', CAST(length(array_join(w, '')) AS BIGINT),
        'n_symbols', CAST(length(regexp_replace(_t, '[^#*$%&|<>]+', '')) AS BIGINT),
        'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT),
        'n_lines', CAST(size(l) AS BIGINT),
        'n_stop_words', CAST(size(filter(w, x -> x IN ({stop}))) AS BIGINT),
        'n_repeat_words', {repeated}))[0])[0])"""


ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept"]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Every row with its counts and the verdicts ``base_failed`` and ``kept``; no Python, no shuffle.

    The counts come out of a generator of one row, so a filter on them is not pushed below and computed again.
    Null or empty text has no words and fails the base rules. Columns of ``docs`` named like the added ones are
    replaced. Repeated rows are judged alike; an empty table gives an empty result.
    """
    bare = docs.drop(*ADDED)
    counted = bare.select(*[F.col(f"`{c}`") for c in bare.columns], F.expr(f"inline({measures(text_col)})"))
    failed = F.expr(f"NOT ({compiled(BASE)})")
    return counted.withColumns({"base_failed": failed, "kept": ~failed & F.expr(compiled(rules) if rules else "true")})


def _in_list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: DuckDB SQL for the query over ``documents``.
ORACLE = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
grams AS (SELECT r, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, g, count(*) OVER (PARTITION BY r, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(n - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS n FROM twice) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w, 'string_agg', '')) AS BIGINT) AS chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
  CAST(len(list_filter(w, lambda x: x IN ({_in_list(stop_forms())}))) AS BIGINT) AS n_stop_words,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.r = w.r),
n AS (SELECT * EXCLUDE (chars), coalesce(chars, 0) AS word_chars FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, NOT ({compiled(BASE)}) AS base_failed,
  {compiled(BASE)} AND {compiled(RULES)} AS kept FROM n"""
