"""Finding altered quotes again: a ladder of short word windows, looked up in the pages of the quote's document; core words as proof.

A quote is told by its words' bare forms (letters and digits in lower case), so dashes, case, punctuation and line breaks don't
matter. A ladder of short word windows, from inside outward, is looked up in the bare forms of the pages of the quote's document;
only pages that hold one are asked how many of the quote's long words they hold. A hit is proven by seven tenths
of them (four at least); the first step with a proven hit wins, else the first step with any. Pages whose words run together are found
by windows without word limits, of 14 letters at least; they count for quotes without another hit.

Pages meet their document's quotes in one equality join, and a page's bare forms are made once. A few windows are looked up as they stand; of more,
by hash, the page's windows and letter grams, of which only asked ones are kept. A quote's hits are bounded by the pages of its
document. Quotes without words, or not found, keep a row of nulls; pages without text match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The windows in the order they are tried, as slices of the quote's words (ends count back if negative), and the
#: least number of words a quote needs for each.
LADDER = ((2, 6, 6), (5, 9, 6), (6, 10, 6), (-6, -2, 6), (3, 7, 6), (-4, None, 5), (4, 8, 5), (0, 3, 3), (1, 4, 3))
WIDEST = 4
LEAST_WINDOW, LEAST_GRAM = 12, 14
#: Up to so many windows of a document are looked up as they stand, which costs a page its length for each; more by hash.
FEW_WINDOWS = 2000
CORE_WORDS, CORE_LETTERS, LEAST_CORE, CORE_SHARE = 14, 3, 4, 0.7
SPACES = "[\\x20\\x09-\\x0D]+"


def _spelled(c: Column) -> Column:
    """The ligatures of fi and fl and the sharp s are spelled out."""
    return F.replace(F.replace(F.replace(c, F.lit("ß"), F.lit("ss")), F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))


def bare(c: Column) -> Column:
    """Letters and digits in lower case."""
    return F.lower(F.regexp_replace(_spelled(c), "[^\\p{L}\\p{N}]+", ""))


def told(text: Column) -> Column:
    """Bare forms of the words of a text, a space before and after each; there may be a second one at either end."""
    kept = F.regexp_replace(_spelled(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+", "")
    # a single space stays without a match
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(kept, "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")), F.lit(" "))


def forms(text: Column) -> Column:
    """Bare forms of the words of a text, without empty ones."""
    return _split(told(text))


def _split(said: Column) -> Column:
    return F.filter(F.split(said, " "), lambda x: x != "")


def _ladder(words: Column) -> Column:
    """Array of (step, window, run, word_hash, gram_hash): the windows of a quote that are long enough to be looked up, and their letters without spaces."""
    n = F.size(words)
    made = []
    for step, (low, high, least) in enumerate(LADDER):
        begin = F.lit(low) if low >= 0 else n + low
        end = n if high is None else F.least(F.lit(high), n) if high >= 0 else n + high
        window = F.array_join(F.slice(words, F.greatest(begin, F.lit(0)) + 1, F.greatest(end - begin, F.lit(0))), " ")
        made.append(F.when(n >= least, F.struct(F.lit(step).alias("step"), window.alias("window"))))
    told_windows = F.filter(F.array(*made), lambda x: x.isNotNull() & (F.length(x["window"]) >= LEAST_WINDOW))
    run = lambda x: F.replace(x["window"], F.lit(" "), F.lit(""))
    gram_hash = lambda x: F.when(F.length(run(x)) >= LEAST_GRAM, F.xxhash64(F.substring(run(x), 1, LEAST_GRAM)))
    return F.transform(told_windows, lambda x: F.struct(x["step"].alias("step"), x["window"].alias("window"), run(x).alias("run"), F.xxhash64(x["window"]).alias("word_hash"), gram_hash(x).alias("gram_hash")))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, not once for each item that a lambda of ``body`` looks at."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column) -> Column:
    """Hashes of all windows of 1 to WIDEST words."""

    def made(w: Column) -> Column:
        def of(k: int) -> Column:
            starts = F.sequence(F.lit(1), F.size(w) - k + 1)
            return F.when(F.size(w) >= k, F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))

        long = F.filter(F.flatten(F.array(*[of(k) for k in range(1, WIDEST + 1)])), lambda x: F.length(x) >= LEAST_WINDOW)
        return F.array_distinct(F.transform(long, lambda x: F.xxhash64(x)))

    return _once(words, made)


def _grams(body: Column) -> Column:
    """Hashes of all runs of LEAST_GRAM letters. Letters as an array: to count up to a place in a string costs as much as the string is long."""
    starts = lambda b: F.sequence(F.lit(1), F.size(b) - LEAST_GRAM + 1)
    made = _once(F.split(body, ""), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.array_join(F.slice(b, i, LEAST_GRAM), ""))))
    return F.when(F.length(body) >= LEAST_GRAM, made).otherwise(F.array().cast("array<bigint>"))


def _meets(x: Column, said: Column, body: Column) -> Column:
    """Whether a page holds a window as words, or its letters if they are enough."""
    return F.contains(body, x["run"]) & ((F.length(x["run"]) >= LEAST_GRAM) | _as_words(x, said))


def _as_words(x: Column, said: Column) -> Column:
    return F.contains(said, F.concat(F.lit(" "), x["window"], F.lit(" ")))


def _met(asks: Column, said: Column, body: Column) -> Column:
    """Of an array of a document's quotes, those that a page holds a window of."""
    windows = F.flatten(asks["ladder"])
    held = F.struct(F.array_intersect(_windows(_split(said)), windows["word_hash"]).alias("words"), F.array_intersect(_grams(body), windows["gram_hash"]).alias("grams"))
    hashed = lambda x, h: F.array_contains(h["words"], x["word_hash"]) | F.array_contains(h["grams"], x["gram_hash"])
    by_hash = _once(held, lambda h: F.filter(asks, lambda q: F.exists(q["ladder"], lambda x: hashed(x, h) & _meets(x, said, body))))
    as_they_stand = F.filter(asks, lambda q: F.exists(q["ladder"], lambda x: _meets(x, said, body)))
    return F.when(F.size(windows) <= FEW_WINDOWS, as_they_stand).otherwise(by_hash)


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, page, step, proven, core, core_all, hits, place). ``quotes``: quote_id, doc, quote, hint (a page or null); ``pages``: doc, page, text.

    ``step`` counts the ladder from 0, and on for the search without word limits; ``hits`` are the pages of the winning step, of which
    the hinted one is taken, else the longest, else the first; ``place`` is the offset in the page's text where the window begins.
    """
    asked = quotes.select("quote_id", "doc", "hint", forms(F.col("quote")).alias("words"))
    core = F.slice(F.filter("words", lambda w: F.length(w) > CORE_LETTERS), 1, CORE_WORDS)
    asked = asked.select("doc", F.struct("quote_id", "hint", core.alias("core"), _ladder(F.col("words")).alias("ladder")).alias("q"))
    asks = asked.groupBy("doc").agg(F.collect_list("q").alias("asks"))

    said = pages.join(asks, "doc").select("doc", "page", "text", "asks", told(F.col("text")).alias("said"))
    said = said.select("*", F.replace("said", F.lit(" "), F.lit("")).alias("body"))
    # explode_outer: before a plain explode the optimizer puts a filter that looks for all windows of a page again
    met = said.select("doc", "page", "text", "said", "body", F.explode_outer(_met(F.col("asks"), F.col("said"), F.col("body"))).alias("q")).filter("q IS NOT NULL")
    first = lambda holds: F.get(F.filter("q.ladder", holds), F.lit(0))
    met = met.select("*", first(lambda x: _as_words(x, F.col("said"))).alias("by_words"))
    run_on = first(lambda x: _meets(x, F.col("said"), F.col("body")))
    met = met.select("*", F.coalesce("by_words", run_on).alias("by"), F.col("by_words").isNotNull().alias("words"))
    # a page's first window stands for its others: none of them is the first of all pages if it isn't
    step = F.col("by.step") + F.when(F.col("words"), 0).otherwise(len(LADDER))
    held = F.size(F.filter("q.core", lambda w: F.contains(F.col("body"), w)))
    near = F.coalesce(F.col("page") == F.col("q.hint"), F.lit(False))
    judged = met.select(
        "doc", "q.quote_id", "page", "text", (F.instr(F.col("body"), F.col("by.run")) - 1).alias("before"), step.alias("step"), (~near).alias("far"), (-F.length("text")).alias("size"),
        F.when(F.col("words"), held).otherwise(0).alias("core"), F.when(F.col("words"), F.size("q.core")).otherwise(0).alias("core_all"),
    )
    proven = (F.col("core_all") >= LEAST_CORE) & (F.col("core") >= F.greatest(F.lit(LEAST_CORE), F.floor(F.col("core_all") * CORE_SHARE)))
    # by document too: its rows are in one place since the join
    pools = judged.groupBy("doc", "quote_id", (~proven).alias("loose"), "step").agg(F.count("*").alias("hits"), F.min(F.struct("far", "size", "page", "core", "core_all", "before", "text")).alias("best"))
    best = pools.groupBy("doc", "quote_id").agg(F.min(F.struct("loose", "step", "hits", "best")).alias("hit"))
    hits = best.select("quote_id", "hit.best.page", "hit.step", (~F.col("hit.loose")).alias("proven"), "hit.best.core", "hit.best.core_all", "hit.hits", _offset(F.col("hit.best.text"), F.col("hit.best.before")).alias("place"))
    return quotes.select("quote_id").join(hits, "quote_id", "left")


def _offset(text: Column, before: Column) -> Column:
    """The longest beginning of ``text`` whose bare form is no longer than ``before``, looked for from the start, as far as it goes twice over."""
    doubled = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int"))
    reach = lambda n: (n <= F.length(text)) & (F.length(bare(F.substring(text, F.lit(1), n))) <= before)

    def searched(beyond: Column) -> Column:
        return F.aggregate(F.reverse(doubled), F.lit(0), lambda at, s: F.when((at + s < beyond) & reach(at + s), at + s).otherwise(at))

    return _once(F.aggregate(doubled, F.lit(0), lambda beyond, s: F.when(beyond > 0, beyond).when(~reach(s), s).otherwise(0)), searched)
