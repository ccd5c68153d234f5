"""Scalar text functions as Spark columns: normalisers, parsers, renderers. All of them map null to null unless said."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = "A-Za-z0-9_\\x{80}-\\x{10FFFF}"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def strip_suffix(s: Column, suffixes: list[str], least_bytes: int, of_stem: bool) -> Column:
    """``s`` less the first suffix that fits: the whole (or, ``of_stem``, what remains) must have ``least_bytes`` bytes."""
    out = s
    for suffix in reversed(suffixes):
        stem = s.substr(F.lit(1), F.length(s) - len(suffix))
        measured = stem if of_stem else s
        out = F.when(s.endswith(suffix) & (F.octet_length(measured) >= least_bytes), stem).otherwise(out)
    return out


def norm_term(c: Column, families: bool = True) -> Column:
    """Graph search term: lower case, ß as ss, letters and digits only, bilingual families, one plural suffix from 6 bytes on."""
    s = F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "[^a-z0-9äöü]", "")
    if families:
        s = F.replace(F.replace(s, F.lit("theory"), F.lit("theorie")), F.lit("sustainability"), F.lit("nachhaltigkeit"))
    return let(s, lambda x: strip_suffix(x, ["en", "er", "e", "s"], 6, of_stem=False))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, "[\\x09-\\x0D\\x20]+", " "))


def alias_stem(c: Column) -> Column:
    """Key of inflected forms: lower case, single blanks, the first of es/en/s/n/e off if 5 bytes stay."""
    return let(F.lower(squeeze(c)), lambda x: strip_suffix(x, ["es", "en", "s", "n", "e"], 5, of_stem=True))


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9ä-üß]", "")


def canonical_form(c: Column) -> Column:
    """Lower case, trimmed, only word characters and blanks."""
    return F.regexp_replace(F.trim(F.lower(c)), f"[^{WORD_CHARS}\\x09-\\x0D\\x20]", "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, "[\\x09-\\x0D\\x20]+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    """Whole part of 1.3 tokens a word."""
    return F.floor(F.size(words(c)) * 13 / 10).cast("int")


def token_set(c: Column) -> Column:
    """Distinct lower-case runs of ASCII letters and digits or of characters from U+0080 on."""
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9\\x{80}-\\x{10FFFF}]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty. Whether the texts are equal is for the caller to ask first."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def year_of(c: Column) -> Column:
    """First part between - / . that is a year from 1000 to 2999."""
    return F.get(F.filter(F.split(c, "[-/.]"), lambda x: x.rlike("^[12][0-9]{3}$")), F.lit(0)).cast("int")


def is_uuid(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")


def clamp_param(c: Column, default: int, low: int, high: int) -> Column:
    """A request parameter as a whole number in [low, high]; what isn't one is the default."""
    n = F.when(c.rlike("^[+-]?[0-9]{1,18}$"), c.cast("long"))
    return F.when(n.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), n))).cast("int")


def decode_file_url(c: Column) -> Column:
    """Path of a file:// address, percent-decoded; a plus sign stays."""
    return F.url_decode(F.replace(F.regexp_replace(c, "^file://", ""), F.lit("+"), F.lit("%2B")))


def heading_text(c: Column) -> Column:
    """A heading line without Markdown marks and anchors."""
    s = F.regexp_replace(squeeze_ends(c), "^[#> ]+", "")
    return squeeze_ends(F.regexp_replace(F.regexp_replace(s, "^.*?</span>", ""), "[*_]", ""))


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, "^[\\x09-\\x0D\\x20]+|[\\x09-\\x0D\\x20]+$", "")


def last_cell_is_page(row: Column) -> Column:
    """Whether a table row's last cell (the one before, if that is empty) is a page number 0..3000, years 1900..2099 not."""

    def judge(cells: Column) -> Column:
        last = squeeze_ends(F.element_at(cells, -2))
        cell = F.when((last == "") & (F.size(cells) >= 3), squeeze_ends(F.element_at(cells, -3))).otherwise(last)
        text = F.regexp_replace(cell, "\\.$", "")
        n = F.when(text.rlike("^[+-]?[0-9]{1,9}$"), text.cast("int"))
        return (F.size(cells) >= 2) & F.coalesce((n >= 0) & (n <= 3000) & ~n.between(1900, 2099), F.lit(False))

    return let(F.split(row, "\\|", -1), judge)


def author_names(creators: Column) -> Column:
    """Names of an array of (name, firstName, lastName): ``name``, else first and last; blank ones are left out."""
    full = lambda x: F.coalesce(F.when(x["name"] != "", x["name"]), F.trim(F.concat_ws(" ", F.coalesce(x["firstName"], F.lit("")), F.coalesce(x["lastName"], F.lit("")))))
    return F.filter(F.transform(creators, full), lambda x: x != "")


def image_refs(c: Column) -> Column:
    """Paths of Markdown images, unescaped, without web addresses."""
    found = F.regexp_extract_all(c, F.lit("!\\[[^\\]]*\\]\\(([^)]+)\\)"), F.lit(1))
    unescaped = F.transform(found, lambda x: F.regexp_replace(x, r"\\(.)", "$1"))
    return F.filter(unescaped, lambda x: ~x.rlike("^https?://"))


def short_cfi(c: Column) -> Column:
    """An EPUB pointer without its wrapper and range."""
    return F.regexp_replace(F.split(F.regexp_replace(c, "^epubcfi\\(", ""), ",")[0], "\\)$", "")


def plain_markup(c: Column) -> Column:
    """Text for matching: no tags, no Markdown marks, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "[*_`#>]+", ""))


def strip_styling(c: Column) -> Column:
    """EPUB Markdown without span and div wrappers; three and more newlines become two."""
    return F.regexp_replace(F.regexp_replace(c, "</?(span|div)[^>]*>", ""), "\n{3,}", "\n\n")


def image_basenames(c: Column) -> Column:
    """Image links by file name only."""
    return F.regexp_replace(c, "(!\\[[^\\]]*\\]\\()(?:[^()]*/)?([^()/]+\\))", "$1$2")


def truncate_bytes(c: Column, n: int) -> Column:
    """The longest prefix of whole characters with at most n bytes: a character has at most 4."""
    lengths = F.transform(F.split(F.substring(c, 1, n), ""), lambda x: F.octet_length(x))
    upto = F.aggregate(lengths, F.struct(F.lit(0).alias("b"), F.lit(0).alias("k")), lambda a, x: F.when((a["b"] + x <= n) & (a["b"] >= 0), F.struct((a["b"] + x).alias("b"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.lit(-1).alias("b"), a["k"].alias("k"))))
    return F.when(F.octet_length(c) <= n, c).otherwise(c.substr(F.lit(1), let(upto, lambda u: u["k"])))


ROMAN = [("M", 1000), ("CM", 900), ("D", 500), ("CD", 400), ("C", 100), ("XC", 90), ("L", 50), ("XL", 40), ("X", 10), ("IX", 9), ("V", 5), ("IV", 4), ("I", 1)]


def roman(c: Column) -> Column:
    """Lower-case Roman numeral of 1..3999, else null."""

    def build(n: Column) -> Column:
        signs = F.array(*[F.struct(F.lit(s.lower()).alias("s"), F.lit(v).alias("v")) for s, v in ROMAN])
        start = F.struct(F.lit("").alias("text"), n.cast("int").alias("left"))
        return F.aggregate(signs, start, lambda a, x: F.struct(F.concat(a["text"], F.repeat(x["s"], F.floor(a["left"] / x["v"]).cast("int"))).alias("text"), F.pmod(a["left"], x["v"]).alias("left")), lambda a: a["text"])

    return F.when(c.between(1, 3999), build(c))


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral in canonical form, else null."""
    signs = {s: v for s, v in ROMAN if len(s) == 1}
    table = F.create_map(*[F.lit(x) for s, v in signs.items() for x in (s, v)])
    upper = F.upper(squeeze_ends(c))
    values = F.transform(F.filter(F.split(upper, ""), lambda x: x != ""), lambda x: F.element_at(table, x))
    signed = let(values, lambda v: F.transform(v, lambda x, i: F.when(F.coalesce(F.get(v, i + 1), F.lit(0)) > x, -x).otherwise(x)))
    total = F.aggregate(signed, F.lit(0), lambda a, x: a + x)
    return F.when(upper.rlike("^(?=.)M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def sparse_map(c: Column) -> Column:
    """token -> weight from JSON; weights that aren't positive finite numbers raise an error."""
    raw = F.from_json(c, "map<string,string>")
    good = F.transform_values(raw, lambda k, v: v.try_cast("double"))
    fine = F.forall(F.map_values(good), lambda v: F.coalesce((v > 0) & (v < float("inf")), F.lit(False)))
    return F.when(raw.isNull(), raw.cast("map<string,double>")).when(fine, good).otherwise(F.raise_error(F.lit("sparse weight is not a positive finite number")).cast("map<string,double>"))


def vector_of(c: Column) -> Column:
    """[a,b] as an array of floats."""
    return F.from_json(c, "array<float>")


def vector_text(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit("]"))


def hashed_vector(c: Column, dim: int = 3) -> Column:
    """Stand-in for a model's dense vector: bytes of the text's SHA-256 scaled to [-1, 1], six places."""
    digest = F.sha2(c, 256)
    return F.array(*[F.round(F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("double") / 127.5 - 1, 6) for i in range(dim)])


def hashed_sparse(c: Column, buckets: int = 1000) -> Column:
    """Stand-in for a learned-sparse vector: half a token's count under its hash bucket, tokens in alphabetical order, later ones win."""
    tokens = F.array_sort(F.array_distinct(words(F.lower(c))))
    slot = lambda t: F.pmod(F.conv(F.substring(F.sha2(t, 256), 50, 15), 16, 10).cast("decimal(20,0)"), F.lit(buckets)).cast("int").cast("string")
    pairs = let(words(F.lower(c)), lambda all_: F.transform(tokens, lambda t: F.struct(slot(t).alias("key"), (F.size(F.filter(all_, lambda x: x == t)) * 0.5).alias("value"))))
    last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1))), lambda y: y["key"] == x["key"])))
    return F.map_from_entries(last)


def shorten(c: Column, n: int) -> Column:
    """At most n characters, cut at the last blank, dash, colon or comma of the second half, with an ellipsis."""
    whole = squeeze_ends(c)
    head = F.substring(whole, 1, n)
    at = F.length(F.regexp_extract(head, "^(.*)[ –:,-]", 1))
    cut = F.when(head.rlike("[ –:,-]") & (at > n // 2), head.substr(F.lit(1), at)).otherwise(head)
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(F.regexp_replace(cut, "[ –:,-]+$", ""), F.lit("…")))


def schema_filename(creators: Column, year: Column, title: Column, publisher: Column) -> Column:
    """"Author - year - title.pdf": the first author's name or last name, else the publisher; nothing that breaks a path."""
    authors = F.filter(creators, lambda x: x["creatorType"] == "author")
    names = F.filter(F.transform(authors, lambda x: F.when(x["name"] != "", x["name"]).otherwise(x["lastName"])), lambda x: x != "")
    head = F.coalesce(F.get(names, F.lit(0)), F.nullif(publisher, F.lit("")), F.lit("Unbekannt"))
    whole = F.concat(head, F.lit(" - "), F.coalesce(F.when(year > 0, year.cast("string")), F.lit("")), F.lit(" - "), shorten(title, 80))
    return F.concat(squeeze(F.regexp_replace(whole, "[/\\\\\\x00-\\x1f]", " ")), F.lit(".pdf"))


def profile_hash(*cols: Column) -> Column:
    """SHA-256 of the JSON of the columns in their order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def idempotency_key(attachment: Column, content_hash: Column, profile: Column, forced_job: Column | None = None) -> Column:
    parts = [attachment, content_hash, profile] + ([F.concat(F.lit("force-"), forced_job)] if forced_job is not None else [])
    return F.concat_ws(":", *parts)


def backoff_seconds(attempt: Column, base: float = 5, most: float = 3600) -> Column:
    """base * 2**(attempt - 1) seconds, at most ``most``."""
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1))


#: Stop words that tell German from English.
GERMAN = "der die das und ist ein eine zu in den von für mit auf des dem nicht sich auch werden als dass oder wie wird bei nach".split()
ENGLISH = "the and is a an to in of for with on not are was that this from by be have has it or which but as can they".split()


def detect_language(c: Column, first: int = 500) -> Column:
    """``de`` if more distinct German than English stop words are among the first words, else ``en``."""
    head = F.array_distinct(F.slice(words(F.lower(c)), 1, first))
    hits = lambda known: F.size(F.array_intersect(head, F.array(*map(F.lit, known))))
    return F.when(hits(GERMAN) > hits(ENGLISH), "de").otherwise("en")


def locator_label(loc: Column, titles: Column) -> Column:
    """What a reader is shown; physical pages count from 0 in the locator and from 1 here.

    Pages: "S. " and the label or label range; for physical_only "PDF-S. " and the physical page alone. A chapter number
    goes in front ("Kap. 3, "), else the deepest section title ("Title · "). Everything else shows the title, if there is one.
    """
    title = F.coalesce(F.when(F.size(titles) > 0, F.element_at(titles, -1)), F.lit(""))
    physical = F.coalesce((loc["physical_page_start"] + 1).cast("string"), F.lit(""))
    only = loc["page_source"].eqNullSafe(F.lit("physical_only"))
    first, last = F.coalesce(loc["page_label_start"], F.lit("")), F.coalesce(loc["page_label_end"], F.lit(""))
    page = F.when(only | (first == ""), physical).otherwise(first)
    span = F.when(~only & (last != "") & (last != first), F.concat(page, F.lit("-"), last)).otherwise(page)
    prefix = F.when(only, "PDF-S. ").otherwise("S. ")
    number = F.concat(F.lit("Kap. "), loc["chapter"])
    paged = (
        F.when(loc["chapter"].isNotNull(), F.when(span == "", number).otherwise(F.concat(number, F.lit(", "), prefix, span)))
        .when(span == "", title).when(title == "", F.concat(prefix, span)).otherwise(F.concat(title, F.lit(" · "), prefix, span))
    )
    return F.when(loc["type"] == "page_span", paged).otherwise(title)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
