"""Column functions on text: clean-up, predicates, names, years, identifiers.

All are expressions that stay in the JVM; only Unicode normalisation is an
Arrow function, as Spark has none built in. Null gives null unless stated.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, signs and patterns that decide what the functions return.
COORDINATION = ("und", "oder", "bzw", "sowie", "u", "bis", "and", "or")
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
UNSURE = "⚠[Formel unsicher]"
MARKER = r"(?: (?=<!--))?<!-- (?:Seite \S+ \(PDF \d+\)|PDF-Seite \d+|Seite \d+) -->\n?"
ABBREVIATION_END = r"(?U)(?:^|[\s(])(?:[^\W\d_]{1,3}|vgl|Abb|Tab|bzw|usw|etc|Nr|Bd|Kap|Gl|Fig|Eq|Prof|Dr)\.$"
STRUCTURE_WORD = r"(?iU)^(?:aufgabe|beispiel|übung|abb|abbildung|tab|tabelle|lösung|figure|example|exercise|problem|gleichung)\b"
LIST_START = r"(?U)^(?:[•●▪◦\-–—*]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s"
YEAR = r"(?<!\d)(1[5-9]\d{2}|20\d{2})(?!\d)"
DOI = r"10\.\d{4,9}/[^\s\"<>()]+"
ISBN = r"(?<![\d-])97[89](?:[\- ]?\d){10}(?!\d)"
IDENTIFIER = r"(?i)^(?:isbn[\s:]*)?[\d\-\sxX]{10,}$|^10\.\d{4,9}/\S+$"
USELESS_TITLE = (
    r"(?iU)^\s*(?:microsoft (?:word|powerpoint|excel)\b.*|(?:untitled|unbenannt)(?:[\s_-]*\d+)?"
    r"|(?:dokument|document|präsentation|presentation|mappe|book|arbeitsmappe|layout|folie|slide)[\s_-]*\d*)\s*$"
    r"|\.(?:indd|docx?|pptx?|xlsx?|qxd|pdf|tex|pages|rtf|txt)\s*$"
)
USELESS_AUTHORS = (
    "admin", "administrator", "user", "owner", "unknown", "unbekannt", "windows user", "windows-benutzer", "benutzer", "author", "autor",
    "microsoft office user", "microsoft office-benutzer", "microsoft office benutzer", "python-docx", "python-pptx", "openpyxl", "apache poi",
    "default", "",
)
LICENCE = (
    r"(?i)(?:Datum / Uhrzeit des Ausdrucks:(?:.*?Printed copies are uncontrolled|.*$)"
    r"|Firmenname:.*?Benutzername:\s*\S+(?:\s*Printed copies are uncontrolled)?"
    r"|Benutzername:\s*\S+\s*Printed copies are uncontrolled|^\s*Printed copies are uncontrolled\s*$"
    r"|Normen-Download-(?:Beuth|DIN ?Media)-\S*(?:.*$)?|^\s*[0-9A-F]{40,}\s*$"
    r"|^.*\b(?:Kd\.?-Nr\.|Abo-Nr\.)\s*\d.*$|^.*\bNormen-?(?:Ticker|abonnement)\b.*$)"
)
EMPTY_PAGE = r"(?i)^(?:[–—-]?\s*Leerseite\s*[–—-]?|This page is intentionally (?:left )?blank\.?)$"
SUSPICIOUS = (
    r"(?U)[\x{300}-\x{36f}] |[\x{1b5}\x{1c4}-\x{1cc}]|[\x{f020}-\x{f0ff}\x{f8e5}-\x{f8ff}]|[^\W\d_][‰¸ˆ]|[‰¸ˆ][^\W\d_]"
)
MISSING_UMLAUT = (
    r"(?U)\b(?:f[�]?r|k[�]?nnen|m[�]?ssen|m[�]?glich|zun[�]?chst|w[�]?hrend|L[�]?sung|L[�]?sungen|"
    r"[�]?hnlich|w[�]?rde|n[�]?tig)\b"
)
HEAD = 15_000


def _norm(form: str):
    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t), na_action="ignore")

    return normalised


def normalized(text: Column, form: str = "NFC") -> Column:
    """``text`` in a Unicode normalisation form."""
    return _norm(form)(text)


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def or_null(text: Column) -> Column:
    """Blank text as null, other text without white space around it."""
    return F.nullif(strip(text.cast("string")), F.lit(""))


def without_markers(text: Column) -> Column:
    """``text`` without page markers of any format."""
    return F.regexp_replace(text, MARKER, "")


def page_marker(page: Column, printed: Column) -> Column:
    """The marker of a page, with its printed number where there is one."""
    with_number = F.concat(F.lit("<!-- Seite "), printed, F.lit(" (PDF "), page.cast("string"), F.lit(") -->"))
    return F.when(F.coalesce(printed, F.lit("")) != "", with_number).otherwise(F.concat(F.lit("<!-- PDF-Seite "), page.cast("string"), F.lit(" -->")))


def file_name_safe(text: Column) -> Column:
    """``text`` without what file names must not have; ``: `` becomes a dash."""
    t = F.regexp_replace(text, r"(?U)\s*:\s+", " – ")
    t = F.regexp_replace(t, r"[<>:\"/\\|?*\x00-\x1f]", " ")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), r"^[ .]+|[ .]+$", "")


def short_author(author: Column) -> Column:
    """Three persons or more as the first and ``et al.``"""
    people = F.filter(F.transform(F.split(author, r";|,| und | and | & "), strip), lambda p: p != "")
    return F.when(F.size(people) >= 3, F.concat(F.get(people, F.lit(0)), F.lit(" et al."))).otherwise(author)


def person_in_order(name: Column) -> Column:
    """``Last, First, years`` as ``First Last``."""
    pattern = r"^\s*([^,]+?),\s*([^,\d]+?)(?:,\s*[\d?\-–. ]+)?\s*$"
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, "$2 $1")).otherwise(strip(name))


def is_identifier(text: Column) -> Column:
    """Whether the whole text is an ISBN or a DOI."""
    return strip(text).rlike(IDENTIFIER)


def usable_title(title: Column) -> Column:
    """Whether a letter or digit is left once the title is safe for a file name."""
    return F.coalesce(file_name_safe(title).rlike(r"(?U)[^\W_]"), F.lit(False))


def accepted_title(title: Column) -> Column:
    """The title where it may stand as one, else null: no identifier, no default."""
    t = strip(title)
    return F.when(~is_identifier(t) & (F.length(t) >= 3) & ~t.rlike(USELESS_TITLE) & usable_title(t), t)


def accepted_author(author: Column) -> Column:
    """The author unless it is a default of some program."""
    a = strip(author)
    return F.when(~F.lower(a).isin(*USELESS_AUTHORS), a)


def plausible_seconds(seconds: Column, most: int = 21_600) -> Column:
    """Seconds from 0 to six hours as a whole number, else null."""
    return F.when(seconds.between(0, most), seconds.cast("int"))


def log_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, anything else null."""
    strict = text.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")
    return F.when(strict, F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def first_number(text: Column, pattern: str = r"^\s*(\d+)") -> Column:
    """The first group of ``pattern`` as a number, 0 where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("int"), F.lit(0))


def broken_encoding(text: Column) -> Column:
    """Whether too many words lack their umlaut."""
    hits = F.regexp_count(text, F.lit(MISSING_UMLAUT))
    return (hits >= 30) & (hits / F.greatest(F.length(text) / 6, F.lit(1.0)) > 0.002)


def repeated_lines(text: Column) -> Column:
    """Whether three long lines and a tenth of them stand there again."""
    lines = F.filter(F.transform(F.split(text, r"\r|\n"), strip), lambda x: F.length(x) >= 8)
    again = F.size(lines) - F.size(F.array_distinct(lines))
    return (F.size(lines) >= 6) & (again >= 3) & (again >= 0.1 * F.size(lines))


def suspicious_characters(text: Column) -> Column:
    """Whether a page needs a look at its characters."""
    twice = text.rlike(r"([\x{1D400}-\x{1D7FF}])\1")
    return text.rlike(SUSPICIOUS) | repeated_lines(text) | twice


def ends_sentence(line: Column) -> Column:
    """Whether a line ends a sentence; one that is empty does."""
    last = F.substring(line, -1, 1)
    return ((last == "") | last.isin(".", "!", "?", ":", ";")) & ~line.rlike(ABBREVIATION_END)


def join_divided(text: Column) -> Column:
    """Words divided at line ends joined; a hyphen before a capital or a
    coordinating word stays."""
    t = F.regexp_replace(text, "\u00ad[ \t]+", "\u00ad\n")
    mark, gap = "(?:-|[\u0002\ufffe\u00ad])", r"\n[ \t]*"
    words = "|".join(COORDINATION)
    t = F.regexp_replace(t, rf"(?U)([^\W\d_]){mark}{gap}(?=(?i:{words})[.,;:]*(?:\s|$))", "$1- ")
    t = F.regexp_replace(t, rf"(?U)([^\W\d_]){mark}{gap}(?=\p{{Ll}})", "$1")
    return F.regexp_replace(t, rf"(?U)([^\W\d_]){mark}{gap}(?=\S)", "$1-")


def mark_unsure_formulas(text: Column) -> Column:
    """A warning before each line with an unreadable character in a formula."""

    def line(x: Column) -> Column:
        unsure = F.exists(F.regexp_extract_all(x, F.lit(r"(\$[^$\n]+\$)"), 1), lambda f: F.contains(f, F.lit("�")))
        return F.when(unsure & ~F.startswith(x, F.lit(UNSURE)), F.concat(F.lit(UNSURE), x)).otherwise(x)

    return F.when(F.contains(text, F.lit("$")) & F.contains(text, F.lit("�")), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(text)


def without_controls(text: Column) -> Column:
    """Invisible characters gone, unreadable ones as U+FFFD."""
    t = F.regexp_replace(text, r"[\x00\x0b\x0c\x{fffe}\x{feff}\x{ad}\x{200b}]", "")
    return F.regexp_replace(t, r"[\x01-\x08\x0e-\x1f]", "\ufffd")


def clean_lines(text: Column) -> Column:
    """The steps of page cleaning on the lines of a page, paragraphs left as they are."""
    t = F.replace(normalized(text), F.lit("\t"), F.lit(" "))
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = join_divided(t)
    t = F.regexp_replace(t, r"(?U)([^\W\d_])[\x02\x{fffe}\x{ad}]\s*$", "$1-")
    t = mark_unsure_formulas(without_controls(t))
    t = F.regexp_replace(t, r"(?:[ \t]*\.){4,}[ \t]*", " … ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]{3,}", "  "), r"(?m)[ \t]+$", "")


def without_licence_marks(line: Column) -> Column:
    """A line without marks that name the licensee."""
    return F.regexp_replace(line, LICENCE, "")


def cell_text(text: Column) -> Column:
    """Text of a table cell on one line, with the column sign escaped."""
    return F.replace(squeeze(join_divided(text)), F.lit("|"), F.lit(r"\|"))


def letters_only(text: Column) -> Column:
    """Letters and digits in lower case, without accents: a key for comparisons."""
    return F.regexp_replace(F.lower(normalized(text, "NFKD")), r"(?U)[^\w]|_|\p{M}", "")


def digits_folded(text: Column) -> Column:
    """Lower case with each run of digits as ``#``."""
    return F.regexp_replace(F.lower(text), r"\d+", "#")


def balanced(text: Column) -> Column:
    """Whether parentheses close in order."""
    signs = F.regexp_extract_all(text, F.lit(r"([()])"), 1)
    depth = F.aggregate(
        signs,
        F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")),
        lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).otherwise(-1)).alias("d"), (a["ok"] & (a["d"] + F.when(c == "(", 1).otherwise(-1) >= 0)).alias("ok")),
    )
    return (depth["d"] == 0) & depth["ok"]


def _years_after(head: Column, pattern: str, window: int, latest: int) -> Column:
    starts = F.split(head, pattern)
    windows = F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0)))
    # a window goes on over later matches: the rest of the text from each match on
    tails = F.transform(F.sequence(F.lit(1), F.size(windows)), lambda i: F.substring(F.array_join(F.slice(windows, i, F.size(windows)), ""), 1, window))
    found = F.flatten(F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(YEAR), 1)))
    years = F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y <= latest)
    return F.when(F.size(windows) > 0, F.array_max(years))


def publication_year(text: Column, this_year: int, head: int = HEAD) -> Column:
    """The latest year after a copyright sign, else after words of publication."""
    h = without_markers(F.substring(text, 1, head))
    a = _years_after(h, r"(?i)©|\(c\)|copyright", 250, this_year + 1)
    b = _years_after(h, r"(?i)erschienen|erstausgabe|first published|published|auflage|edition", 80, this_year + 1)
    return F.coalesce(a, b).cast("string")


def identifiers(known: Column, text: Column, head: int = HEAD) -> Column:
    """Up to four identifiers: DOIs before ISBNs, those of chapters left out.

    ``known`` is an array of identifiers from the metadata, null as none.
    """
    both = F.concat(F.array_join(F.coalesce(known, F.array().cast("array<string>")), " "), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, head))
    dois = F.transform(F.regexp_extract_all(both, F.lit(f"({DOI})"), 1), lambda d: F.regexp_replace(d, r"[.,;]+$", ""))
    isbns = F.regexp_extract_all(both, F.lit(f"({ISBN})"), 1)
    each = F.array_distinct(F.filter(F.transform(F.concat(dois, isbns), strip), lambda k: ~k.rlike(r"_\d+$")))
    return F.slice(each, 1, 4)


def first_problem(values: dict[str, Column], scanned: Column, original_missing: Column) -> Column:
    """The first reason why a document isn't complete, null where it is."""
    blank = {k: F.coalesce(strip(v), F.lit("")) == "" for k, v in values.items()}
    missing = F.array_join(F.filter(F.array(*[F.when(b, F.lit(f"{k} fehlt")) for k, b in blank.items()]), lambda x: x.isNotNull()), "; ")
    year = values["jahr"]
    return F.coalesce(
        F.nullif(missing, F.lit("")),
        F.when(scanned, F.lit("kaum Text")),
        F.when(~year.rlike(r"^(?:1[5-9]|20)\d{2}$"), F.lit("Jahr unplausibel")),
        F.when(is_identifier(values["titel"]), F.lit("Titel ist eine Kennung")),
        F.when(original_missing, F.lit("Original fehlt")),
    )
