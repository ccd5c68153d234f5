"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs of characters other than space and U+0009..U+000D. A null or empty text has no words: every count is 0, it
fails the base rule and is not kept. Very long texts are judged whole, in a row of their own; an empty table gives no rows. Ties don't arise: each row is judged alone, so repeated rows get the same verdict.
Columns of the input never clash with the working columns: those live in a struct with a free name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, let

SPACES = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this at an or are not from "
    "de la le et les des en un du une que pour est qui dans sur par au il elle ne pas "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "el y los se del las con por no su para al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """Holds if ``least`` % of ``whole`` <= ``part`` <= ``most`` % of ``whole``, in whole numbers."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None

    def column(self, facts: Column) -> Column:
        part, whole = 100 * facts[self.part], facts[self.whole]
        bounds = [part >= self.least * whole] if self.least is not None else []
        bounds += [part <= self.most * whole] if self.most is not None else []
        out = bounds[0]
        for x in bounds[1:]:
            out = out & x
        return out

    def sql(self) -> str:
        bounds = [f"100 * {self.part} >= {self.least} * {self.whole}"] if self.least is not None else []
        bounds += [f"100 * {self.part} <= {self.most} * {self.whole}"] if self.most is not None else []
        return " AND ".join(bounds)


#: The base rule stands apart (few words, or much repetition); these are the method's own.
RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1400),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("upper_case", "n_upper", "word_chars", most=40),
    Rule("stop_words", "n_stop_words", "n_words", least=1),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
)


def _repeated(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur at least twice in the text."""

    def covered(hits: Column) -> Column:
        # hits: positions in order; each covers up to the next one, at most WINDOW words
        steps = F.transform(hits, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(hits, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeats(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: F.coalesce((F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]) & (k > 0), (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]) & (k > 0))))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def windows(hashes: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    found = let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeats(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def _facts(words: Column, body: Column) -> Column:
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_SPACE))
    stop = F.filter(words, lambda x: F.lower(x).isin(*STOP_WORDS))
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        F.size(stop).cast("long").alias("n_stop_words"),
        _repeated(words).alias("n_repeat_words"),
    )


def _flat(f: Column) -> Column:
    return F.struct(*[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_repeat_words")], f["lines"]["all"].alias("n_lines"), f["lines"]["dup"].alias("n_dup_lines"))


def _verdict(f: Column) -> tuple[Column, Column]:
    """(base rule failed, names of the method's rules that are broken)."""
    failed = (f["n_words"] < 20) | (100 * f["n_repeat_words"] > 30 * f["n_words"])
    return failed, F.array_compact(F.array(*[F.when(~r.column(f), F.lit(r.name)) for r in RULES]))


def annotate(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and failed_rules.

    A column of ``df`` with one of these names is replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    w, q = free_name(df, "words"), free_name(df, "facts")
    staged = df.withColumn(w, F.array_remove(F.split(body, SPACES), ""))
    staged = staged.withColumn(q, _facts(F.col(w), body))
    staged = staged.withColumn(q, _flat(F.col(q)))
    f = F.col(q)
    failed, broken = _verdict(f)
    out = {c: f[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    out |= {"base_failed": failed, "kept": ~failed & (F.size(broken) == 0), "failed_rules": broken}
    return staged.withColumns(out).drop(w, q)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``df`` that ``annotate`` would mark as kept, with all their columns.

    The counts come out of a generator, through which a filter can't be pushed, so they are made once a row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    w, q = free_name(df, "words"), free_name(df, "facts")
    own = [F.col(f"`{c}`") for c in df.columns]
    staged = df.withColumn(w, F.array_remove(F.split(body, SPACES), ""))
    made = staged.select(*own, F.explode(F.array(_facts(F.col(w), body))).alias(q))
    failed, broken = _verdict(_flat(F.col(q)))
    return made.filter(~failed & (F.size(broken) == 0)).select(*own)


def oracle(table: str = "documents") -> str:
    """The same in DuckDB's SQL; doc_id must be unique there."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
u AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1))) AS i FROM w WHERE len(words) >= 8),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS body FROM u),
hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, body) > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM hit) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_upper,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
             coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {' AND '.join(r.sql() for r in RULES)}) AS kept
FROM b"""
