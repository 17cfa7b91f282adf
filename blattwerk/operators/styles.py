"""Styled lines: headings by size, emphasised phrases and where they stand.

``lines`` has ``doc``, ``page``, ``pos``, ``text``, ``size``, ``bold``, ``italic`` and, for
emphasis, ``runs`` (array of struct ``text``, ``style``).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.functions import text as T
from blattwerk.session import cut, salted_left_join

# What numbers, captions and font names look like.
NUMBER = r"(?U)^(\d{1,2}|[A-Z](?=\.\d))((?:\.\d{1,2})*)\.?\s+(?=\S)"
CAPTION = r"(?i)^(?:Abb\.|Abbildung|Bild|Fig\.|Figure|Tab\.|Tabelle|Table|Gl\.|Gleichung|Quelle|Seite)\s"
COUNTED = r"(?i)(?:Teil|Kapitel|Band|Anhang|Abschnitt|Lektion|Part|Chapter)\s+\d{1,4}$"
MATH_FONT = r"(?i)CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|MTMI|MTSY|MTEX|MT2|MathTime|Math|Symbol|STIX|esint|Euclid|rsfs|eufm|Wingding|Dingbat|ZapfD"
BOLD_FONT = r"(?i)bold|black|heavy|demi|cmbx|cmb\d|(?:^|[-_,])(?:bd|blk|hv|sb|xb)(?=$|[-_,]|it)"
ITALIC_FONT = r"(?i)italic|oblique|kursiv|^cm(?:ti|sl|bxti|bxsl|itt)\d|(?:^|[-_,])(?:it|ital|obl|i|bi|\w*it)$"
LARGER, NUMBERED, MAX_WORDS, MAX_TITLE = 1.15, 1.05, 20, 200


def font_style(name: Column, flags: Column, weight: Column, angle: Column) -> Column:
    """``f``, ``k``, both or nothing for bold and italic; math fonts have no style."""
    bold = name.rlike(BOLD_FONT) | (flags.bitwiseAND(262144) != 0) | (weight >= 600)
    italic = name.rlike(ITALIC_FONT) | (flags.bitwiseAND(64) != 0) | (angle != 0)
    return F.when(name.rlike(MATH_FONT), "").otherwise(F.concat(F.when(bold, "f").otherwise(""), F.when(italic, "k").otherwise("")))


def title_like(title: Column) -> Column:
    """Whether text may be a heading: letters prevail, no caption, sentence or contents entry."""
    words = F.filter(F.split(title, r"(?U)\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(title, r"\P{L}", ""))
    seen = F.length(F.regexp_replace(title, r"(?U)\s", ""))
    longest = F.array_max(F.transform(words, lambda w: F.length(F.regexp_replace(w, r"\P{L}", ""))))
    refuse = (
        title.rlike(CAPTION) | F.contains(title, F.lit("=")) | title.rlike("[,;]$") | title.rlike(r"^\d{1,4}\s+\d") | F.startswith(title, F.lit("("))
        | ~T.balanced(title) | (longest < 3) | ((F.size(words) >= 4) & (F.upper(title) == title)) | (title.rlike(r"\.$") & (F.size(words) > 6))
        | (title.rlike(r"\s\d{1,4}$") & ~title.rlike(COUNTED))
    )
    return F.length(title).between(2, MAX_TITLE) & (F.size(words) <= MAX_WORDS) & (letters >= 3) & (letters >= 0.5 * seen) & ~refuse


def body_size(lines: DataFrame) -> DataFrame:
    """``doc``, ``body``: the size in half points that most characters have."""
    bucket = F.round(F.col("size") * 2) / 2
    return lines.where("size is not null").groupBy("doc", bucket.alias("b")).agg(F.sum(F.length("text")).alias("n")).groupBy("doc").agg(F.max_by("b", F.struct("n", "b")).alias("body"))


def headings(lines: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``pos``, ``level``, ``title``: headings told by size, number and weight.

    Up to three following lines of one size and weight are one heading. Titles
    that recur on three pages are running titles. The level is the depth of the
    number, else the rank of the size. A document with more than four headings a
    page gives none.
    """
    w = Window.partitionBy("doc", "page").orderBy("pos")
    num = F.col("text").rlike(NUMBER)
    placed = lines.select("doc", "page", "pos", "text", "size", "bold", F.row_number().over(w).alias("n"))
    # only lines above the body size, or numbered ones, take part from here on
    j = salted_left_join(placed, body_size(lines), ["doc"], 16, F.col("page"))
    cand = (F.col("size") >= F.col("body") * LARGER) | (num & (F.col("size") >= F.col("body") * NUMBERED)) | (num & (F.col("bold") >= 0.9) & (F.col("size") >= F.col("body") * 0.95))
    j = cut(j.where(cand).withColumn("k", T.digits_folded(F.col("text"))))
    repeat = j.groupBy("doc", "k", "size").agg(F.countDistinct("page").alias("p")).where("p >= 3").select("doc", "k", "size", F.lit(True).alias("running"))
    j = salted_left_join(j, repeat, ["doc", "k", "size"], 16, F.col("page")).where("running is null")
    same = (F.lag("n").over(w) == F.col("n") - 1) & (F.abs(F.lag("size").over(w) - F.col("size")) <= 0.3) & ((F.lag("bold").over(w) >= 0.5) == (F.col("bold") >= 0.5)) & ~num
    j = j.withColumn("start", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("grp", F.sum("start").over(w))
    row = F.row_number().over(Window.partitionBy("doc", "page", "grp").orderBy("pos")) - 1
    j = j.withColumn("part", F.floor(row / 3))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: T.strip(x["text"]))
    g = j.groupBy("doc", "page", "grp", "part").agg(F.min("pos").alias("pos"), F.max("size").alias("size"), F.array_join(parts, " ").alias("title")).where(title_like(F.col("title")))
    sizes = g.groupBy("doc", "size").agg(F.count("*").alias("c")).withColumn("rank", F.dense_rank().over(Window.partitionBy("doc").orderBy(F.desc("size"))))
    depth = F.size(F.split(F.regexp_extract("title", NUMBER, 0), r"\.(?=\d)"))
    g = g.join(sizes.select("doc", "size", "rank"), ["doc", "size"]).withColumn("level", F.least(F.lit(6), F.when(F.col("title").rlike(NUMBER), depth).otherwise(F.col("rank"))))
    per = g.groupBy("doc").agg(F.count("*").alias("h")).join(lines.groupBy("doc").agg(F.countDistinct("page").alias("p")), "doc").where("h <= 4 * p").select("doc")
    return g.join(per, "doc", "left_semi").select("doc", "page", "pos", "level", "title")


def worth_keeping(phrase: Column) -> Column:
    """Whether an emphasised phrase says something: letters prevail, two words or four letters."""
    letters = F.length(F.regexp_replace(phrase, r"\P{L}", ""))
    seen = F.length(F.regexp_replace(phrase, r"(?U)\s", ""))
    words = F.size(F.filter(F.split(phrase, r"(?U)\s+"), lambda x: x.rlike(r"\p{L}")))
    return (letters * 2 > seen) & ((words >= 2) | (letters >= 4))


def emphases(lines: DataFrame, least: int = 2000, share: float = 0.3) -> DataFrame:
    """``doc``, ``page``, ``pos``, ``n``, ``text``, ``style``: emphasised phrases of the lines.

    A style that more than ``share`` of a document's text of ``least`` characters has
    is its ordinary style and emphasises nothing.
    """
    runs = lines.select("doc", "page", "pos", F.posexplode("runs").alias("n", "r")).select("doc", "page", "pos", "n", "r.text", "r.style")
    size = runs.groupBy("doc", "style").agg(F.sum(F.length("text")).alias("c"))
    total = size.groupBy("doc").agg(F.sum("c").alias("t"))
    base = size.join(total, "doc").where(f"style <> '' and t >= {least} and c > {share} * t").select("doc", "style")
    kept = runs.where("style <> ''").join(base, ["doc", "style"], "left_anti")
    return kept.withColumn("text", T.squeeze(F.col("text"))).where(worth_keeping(F.col("text"))).select("doc", "page", "pos", "n", "text", "style")


def phrase_positions(phrases: DataFrame, lines: DataFrame) -> DataFrame:
    """``phrases`` (``id``, ``doc``, ``page``, ``text``) with ``pos``: the only line of the page that
    has the phrase, null where none or several have it.

    One row per phrase; candidates are the lines of the phrase's page only.
    """
    key = lambda c: F.regexp_replace(c, r"(?U)\s+", " ")
    p = phrases.select("id", "doc", "page", key(F.col("text")).alias("k"))
    hit = p.join(lines.select("doc", "page", "pos", key(F.col("text")).alias("t")), ["doc", "page"]).where(F.contains("t", F.col("k")))
    one = hit.groupBy("id").agg(F.count("*").alias("c"), F.min("pos").alias("pos")).where("c = 1").select("id", "pos")
    return phrases.join(one, "id", "left")


def set_emphases(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """``doc``, ``text``, ``gesetzt``: a document's text with its phrases marked in Markdown.

    ``phrases`` has ``doc``, ``page``, ``text``, ``style``, ``before``, ``after``. Each is looked for on
    its page, blanks of any kind alike; of several places the one with its
    context counts, and only if that is the only one. What a phrase took is
    closed to the next, so one document is one group.
    """
    marks = {"f": "**", "k": "*", "fk": "***", "kf": "***"}
    joined = texts.select("doc", "text").join(phrases.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("page", "text", "style", "before", "after"))).alias("p")), "doc", "left")

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for doc, text, own in pdf.itertuples(index=False):
            text = text or ""
            zones = {int(m[1] or m[2]): m.end() for m in re.finditer(r"<!-- (?:Seite \S+ \(PDF (\d+)\)|PDF-Seite (\d+)) -->", text)}
            ends = sorted([*zones.values(), len(text) + 1])
            taken: list[tuple[int, int, str]] = []
            for p in own if own is not None else []:
                a = zones.get(p["page"] + 1, 0)
                b = min((e for e in ends if e > a), default=len(text))
                pattern = r"\s+".join(map(re.escape, p["text"].split()))
                hits = [m for m in re.finditer(pattern, text[a:b]) if not any(x < a + m.end() and a + m.start() < y for x, y, _ in taken)] if pattern else []
                if len(hits) > 1:
                    pre, post = (p["before"] or "")[-12:], (p["after"] or "")[:12]
                    hits = [m for m in hits if text[a + m.start() - len(pre) : a + m.start()] == pre and text[a + m.end() : a + m.end() + len(post)] == post]
                if len(hits) == 1:
                    taken.append((a + hits[0].start(), a + hits[0].end(), marks.get(p["style"], "*")))
            for x, y, m in sorted(taken, reverse=True):
                text = text[:x] + m + text[x:y] + m + text[y:]
            out.append((doc, text, len(taken)))
        return pd.DataFrame(out, columns=["doc", "text", "gesetzt"])

    return joined.mapInPandas(lambda it: (place(p) for p in it), f"doc {dict(texts.dtypes)['doc']}, text string, gesetzt int")
