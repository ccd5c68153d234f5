"""Classes of front and back matter, told from the text alone by Spark functions.

Order of precedence: a standalone heading; an editor line; contents shapes; chapter title lines; reference lists; index runs.
Line shapes need a majority, so that a stray line in prose decides nothing. Lengths are in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import heading_text, last_cell_is_page, let, squeeze_ends

#: Headings by class.
HEADINGS = {
    "toc": ["inhaltsverzeichnis", "table of contents", "contents"],
    "preface": ["vorwort", "preface", "geleitwort", "foreword"],
    "bibliography": ["literaturverzeichnis", "bibliografie", "bibliographie", "bibliography", "references", "quellenverzeichnis", "literatur"],
    "authors": ["autorenverzeichnis", "autoren", "autorinnen und autoren", "über die autoren", "über die autorinnen", "die autorinnen und autoren", "über die herausgeber", "mitarbeiterverzeichnis", "beitragsverzeichnis", "herausgeber und autoren", "authors", "about the authors", "the authors"],
    "index": ["register", "sachregister", "stichwortverzeichnis", "namensverzeichnis", "personenregister", "ortsregister", "ortregister", "index"],
}
#: Line patterns, with character classes that Java and RE2 read alike.
TABLE_ROW = "^[\\x09-\\x0D ]*\\|.*\\|[\\x09-\\x0D ]*$"
DOT_LEADER = "\\.{4,}(…|[\\x09-\\x0D ])*[0-9]{1,4}[\\x09-\\x0D ]*$"
CONTENTS_LINE = "^[\\x09-\\x0D ]*([0-9]+(\\.[0-9]+)*|[A-Z]\\.([0-9]+\\.?)+)[.)]?[\\x09-\\x0D ]+[^\\x09-\\x0D ].*?[.…]?[\\x09-\\x0D ]*\\.{0,3}[\\x09-\\x0D ]*[0-9]{1,4}[\\x09-\\x0D ]*$"
INDEX_PAIR = "[a-zA-ZäöüÄÖÜß][a-zA-ZäöüÄÖÜß\\-'’]{2,}[,;]? ?[0-9]{1,4}([^A-Za-z0-9_]|$)"
BOLD_NUMBER = "^\\*\\*[0-9]{1,3}\\.?\\*\\*$"
EDITOR_LINE = "^.{0,90}\\*Hrsg\\.\\*$"
YEAR = "(^|[^A-Za-z0-9_])(19|20)[0-9]{2}([^A-Za-z0-9_]|$)"
CITATION = "(?i)((^|[^a-z0-9_])in:|, vol\\.[\\x09-\\x0D ]|, no\\.[\\x09-\\x0D ]|(^|[^a-z0-9_])pp?\\.[\\x09-\\x0D ]*[0-9]|(^|[^a-z0-9_])s\\.[\\x09-\\x0D ]?[0-9]|(^|[^a-z0-9_])nr\\.[\\x09-\\x0D ]?[0-9]|(^|[^a-z0-9_])verlag($|[^a-z0-9_])|(^|[^a-z0-9_])aufl\\.|(^|[^a-z0-9_])isbn|https?://|\\[[0-9]+\\]|©)"
RETRIEVAL = ("toc", "preface", "bibliography")


def _count(lines: Column, test) -> Column:
    return F.size(F.filter(lines, test))


def _ranges_off(line: Column) -> Column:
    return F.replace(F.replace(line, F.lit(" f."), F.lit(" ")), F.lit(" ff."), F.lit(" "))


def _pairs(line: Column) -> Column:
    return F.regexp_count(_ranges_off(line), F.lit(INDEX_PAIR))


def is_index_line(line: Column) -> Column:
    return ~_ranges_off(line).rlike("[.!?]") & (_pairs(line) >= 3)


def front_matter_class(text: Column) -> Column:
    """toc, authors, preface, bibliography, index, title_lines, or the empty string for body text; null text is empty."""
    text = F.coalesce(text, F.lit(""))

    def judge(lines: Column) -> Column:
        n = F.size(lines)
        key = F.regexp_replace(F.lower(F.regexp_replace(heading_text(F.get(lines, F.lit(0))), "[: \\-]+$", "")), "^$", "\u0000")
        heading = F.lit(None).cast("string")
        for kind, names in HEADINGS.items():
            heading = F.when(key.isin(*names), kind).otherwise(heading)
        only = F.get(lines, F.lit(0))
        editor = (n == 1) & (F.octet_length(only) <= 100) & squeeze_ends(only).rlike(EDITOR_LINE)
        page_rows = _count(lines, lambda x: x.rlike(TABLE_ROW) & last_cell_is_page(x))
        contents = _count(lines, lambda x: x.rlike(CONTENTS_LINE) | x.rlike(DOT_LEADER))
        toc = ((page_rows >= 3) & (page_rows * 2 >= n)) | ((contents >= 4) & (contents * 2 >= n))
        bold = lambda x: squeeze_ends(x).rlike(BOLD_NUMBER)
        aside = lambda x: squeeze_ends(x).startswith(">") | squeeze_ends(x).rlike("^\\*.+\\*$")
        prose = F.exists(F.slice(lines, 2, F.greatest(n, F.lit(1))), lambda x: ~bold(x) & (F.octet_length(squeeze_ends(x)) > 80) & ~aside(x))
        title = squeeze_ends(text).startswith("#") & (_count(lines, bold) == 1) & (n <= 6) & ~prose
        dashed = F.filter(lines, lambda x: squeeze_ends(x).rlike("^[-–—] "))
        dashes = F.size(dashed)
        cited = (dashes >= 5) & (_count(dashed, lambda x: x.rlike(YEAR)) * 10 >= dashes * 7) & (_count(dashed, lambda x: x.rlike(CITATION)) * 2 >= dashes)
        indexed = F.filter(lines, is_index_line)
        total = F.aggregate(indexed, F.lit(0), lambda a, x: a + _pairs(x))
        index = (F.size(indexed) * 2 >= n) & (total >= 6)
        shape = F.when(editor, "authors").when(toc, "toc").when(title, "title_lines").when(cited, "bibliography").when(index, "index").otherwise("")
        return F.when(n == 0, "").otherwise(F.coalesce(heading, shape))

    return let(F.filter(F.split(text, "\n"), lambda x: squeeze_ends(x) != ""), judge)


def is_front_matter(text: Column) -> Column:
    """What retrieval leaves out: contents, prefaces and bibliographies."""
    return front_matter_class(text).isin(*RETRIEVAL)
