"""One form for text that looks the same: widths, marks, blanks, look-alikes.

The mapping from code point to code points is a table: compatibility
decompositions without a visible difference, canonical decompositions,
invisible characters and look-alike letters. Texts with a mapped character are
exploded to positioned code points, joined with the table, their combining
marks ordered by class, recomposed and rebuilt; all others pass unchanged.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOKALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ё": "ë", "ї": "ï", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T",
    "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "Ӏ": "I", "Ё": "Ë", "Ї": "Ï",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "γ": "y",
    "τ": "t", "χ": "x", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "օ": "o", "ս": "u", "ո": "n", "հ": "h", "ց": "g", "զ": "q", "Տ": "S", "Օ": "O", "Լ": "L",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l",
}
#: Characters that take no room.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x115F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x206A), 0xFEFF]
#: Blanks and hyphens that only lay out text otherwise.
LAYOUT = {chr(c): " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]} | {"\u2010": "-", "\u2011": "-"}
#: Marks of a divided line; at the end of a text they are ordinary.
END_MARKS = "\xad\xac\u2010-"
#: Compatibility kinds that a reader sees: they stay.
VISIBLE_KINDS = {"<super>", "<sub>", "<fraction>", "<circle>", "<square>", "<font>"}
#: Compatibility characters that a reader tells from what they decompose to.
KEPT = frozenset(map(chr, [0xA8, 0xAA, 0xAF, 0xB4, 0xB5, 0xB8, 0xBA, *range(0x2D8, 0x2DE), 0x2026, 0x201A, 0x2033, 0x2034, 0x2057, 0x2100, 0x2101, 0x2105, 0x2106, 0x2116, 0x2120, 0x2121, 0x2122, 0x213B, *range(0x222C, 0x2231)]))


def decomposed() -> Iterator[str]:
    """The characters beside ASCII of which some decompose, in order: runs of others are skipped."""
    chars = array("I", range(sys.maxunicode + 1)).tobytes().decode(f"utf-32-{sys.byteorder[0]}e", "surrogatepass")
    for at in range(0x80, len(chars), 64):
        if not unicodedata.is_normalized("NFKD", chars[at : at + 64]):
            yield from chars[at : at + 64]


@lru_cache
def mapping() -> dict[str, str]:
    """Code point to the ordinary code points it stands for, in NFD.

    Its size is bounded by Unicode: characters with a canonical decomposition,
    with one of kind wide, narrow, noBreak or an invisible compat, and the
    lists above.
    """
    out: dict[str, str] = {}
    for ch in decomposed():
        cp = ord(ch)
        d = unicodedata.decomposition(ch)
        if not d or ch in KEPT:
            continue
        kind = d.split()[0] if d[0] == "<" else ""
        if kind in VISIBLE_KINDS or kind in ("<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"):
            continue
        if kind == "<compat>" and not (0xFB00 <= cp <= 0xFB06 or 0x0132 <= cp <= 0x0133 or 0x01C4 <= cp <= 0x01CC or 0x01F1 <= cp <= 0x01F3 or 0x2100 <= cp <= 0x214F or 0x2160 <= cp <= 0x217F):
            continue
        full = unicodedata.normalize("NFKD", ch)
        out[ch] = full
    for cp in INVISIBLE:
        out[chr(cp)] = ""
    return out | LAYOUT


@lru_cache
def odd_characters() -> frozenset[str]:
    """Mapped characters that aren't themselves the composed ordinary form.

    ``ä`` decomposes and recomposes to itself: it is ordinary. A combining
    mark counts when something composes with it.
    """
    return frozenset(c for c, m in mapping().items() if unicodedata.normalize("NFC", m) != c)


def _ranges(chars: set[str]) -> str:
    out, cps = [], sorted(map(ord, chars))
    start = prev = cps[0]
    for c in [*cps[1:], None]:
        if c is None or c != prev + 1:
            out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{prev:x}}}" if prev > start else ""))
            start = c
        prev = c
    return "[" + "".join(out) + "]"


@lru_cache
def candidate_pattern() -> str:
    """Java pattern of the characters that may have to be replaced."""
    return _ranges(set(odd_characters()) | set(LOOKALIKE) | {chr(c) for c in range(0x300, 0x370)})


@lru_cache
def unusual_pattern() -> str:
    """Java pattern of all characters but the most usual ones: a class of few
    ranges, which sorts out nearly all texts before the long class is tried."""
    usual = {chr(c) for c in range(0x180)} | set("–—‘’“”„…•€")
    return "[^" + _ranges(usual - odd_characters() - set(LOOKALIKE))[1:]


_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
_LATIN = re.compile(r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\uff21-\uff3a\uff41-\uff5a]")


@lru_cache
def _translation() -> dict[int, str]:
    return {ord(c): mapping()[c] for c in odd_characters()}


@lru_cache
def _odd_search():
    # characters beyond the BMP as one range: listed one by one they'd be compared one by one
    chars = "".join(sorted(c for c in odd_characters() | set(LOOKALIKE) if c < "\U00010000"))
    return re.compile("[" + re.escape(chars) + "\u0300-\u036f\U00010000-\U0010ffff]").search


def fold(text: str) -> str:
    """The form of one short text, without a corpus: for other operators.

    Look-alike letters are folded in words that also hold a Latin letter.
    """
    if text.isascii() or not _odd_search()(text):
        return text
    end = text[-1:] if text[-1:] in END_MARKS else ""
    body = text[: len(text) - len(end)].translate(_translation())
    if not body.isascii():
        body = _WORD.sub(lambda m: "".join(LOOKALIKE.get(c, c) for c in m[0]) if _LATIN.search(m[0]) and any(c in LOOKALIKE for c in m[0]) else m[0], body)
    return unicodedata.normalize("NFC", body) + end


# Greek letters whose shape isn't exactly the Latin one's. Formulas
# use them beside Latin letters, so they count in words of three letters or more.
LOOSE = frozenset("αικρυγτχ")
_CYRILLIC = re.compile("[Ѐ-ԯ]")


def rebuild(chars: list[str], mapped: list[str], look: list[str | None]) -> str:
    """The text of mapped code points: look-alikes by word, marks in order.

    ``chars`` are the text's code points, ``mapped`` what each stands for, and
    ``look`` the Latin letter it looks like. A look-alike is replaced where its
    word holds a Latin letter too, or where the word consists of look-alikes
    only and no word next to it is of that script; single Greek letters stay.
    """
    if any(look):
        spans, start = [], None
        for i, ch in enumerate([*chars, " "]):
            inside = ch.isalpha() or unicodedata.combining(ch) or mapped[i : i + 1] == [""]
            if inside and start is None:
                start = i
            elif not inside and start is not None:
                spans.append((start, i))
                start = None
        foreign = [any(chars[i].isalpha() and look[i] is None and not _LATIN.match(chars[i]) for i in range(a, b)) for a, b in spans]
        for n, (a, b) in enumerate(spans):
            at = [i for i in range(a, b) if look[i] is not None]
            if not at:
                continue
            letters = [i for i in range(a, b) if chars[i].isalpha()]
            latin = any(_LATIN.match(chars[i]) for i in letters)
            if latin:
                use = [i for i in at if len(letters) > 2 or chars[i] not in LOOSE]
            elif foreign[n] or any(foreign[max(0, n - 1) : n + 2]) or not any(_LATIN.match(c) for c in chars):
                use = []
            else:
                use = at if _CYRILLIC.search(chars[at[0]]) or len(letters) > 1 and not any(chars[i] in LOOSE for i in at) else []
            for i in use:
                mapped[i] = look[i]
    out: list[str] = []
    marks: list[str] = []
    for m in mapped:
        for c in m:
            if unicodedata.combining(c):
                marks.append(c)
                continue
            if marks:
                marks.sort(key=unicodedata.combining)
                out += marks
                marks = []
            out.append(c)
    out += sorted(marks, key=unicodedata.combining)
    return unicodedata.normalize("NFC", "".join(out))


def code_point_table(spark: SparkSession) -> DataFrame:
    """``ch``, ``stands_for``, ``looks_like``: some thousand rows, bounded by Unicode."""
    rows = [(c, m, None) for c, m in mapping().items()] + [(c, None, m) for c, m in LOOKALIKE.items() if c not in mapping()]
    rows = [(c, m, LOOKALIKE.get(c)) if m is not None else (c, m, x) for c, m, x in rows]
    return spark.createDataFrame(rows, "ch string, stands_for string, looks_like string")


def changed(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, original and ``unified`` text of the rows that the operator changes.

    ``keys`` must identify a row. Null and empty texts don't change; very long
    ones are one group of code points each, never more than the text itself.
    Other columns are ignored, so they may have any names.
    """
    src = rows.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{text}`").alias("__t")).where(F.col("__t").rlike(unusual_pattern()) & F.col("__t").rlike(candidate_pattern()))
    table = code_point_table(rows.sparkSession)
    ends = F.lit(END_MARKS)
    points = src.select(*keys, F.posexplode(F.regexp_extract_all("__t", F.lit("(?s)(.)"), 1)).alias("__pos", "ch"), F.length("__t").alias("__n"))
    joined = points.join(F.broadcast(table), "ch", "left")
    keep = (F.col("__pos") == F.col("__n") - 1) & (F.instr(ends, F.col("ch")) > 0)
    point = F.struct(
        F.col("__pos").alias("p"),
        F.col("ch").alias("c"),
        F.when(keep, F.col("ch")).otherwise(F.coalesce("stands_for", "ch")).alias("m"),
        F.when(~keep, F.col("looks_like")).alias("l"),
    )
    grouped = joined.groupBy(*keys).agg(F.sort_array(F.collect_list(point)).alias("__a"))
    arrays = grouped.select(*keys, F.col("__a.c").alias("__c"), F.col("__a.m").alias("__m"), F.col("__a.l").alias("__l"))
    schema = ", ".join(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys) + ", original string, unified string"
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for i, (c, m, x) in enumerate(zip(*[batch.column(n + k).to_pylist() for k in range(3)])):
                old = "".join(c)
                if (new := rebuild(c, m, x)) != old:
                    hits.append((i, old, new))
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(n)], pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string())], [*keys, "original", "unified"])

    return arrays.mapInArrow(run, schema)


def unify(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """All ``rows`` with ``unified``: their text in the one form. Null stays null."""
    new = changed(rows, keys, text).select(*keys, F.col("unified").alias("__u"))
    return rows.join(new, keys, "left").withColumn("unified", F.coalesce("__u", F.col(f"`{text}`"))).drop("__u")
