"""Repair of characters, tables set into pages, formulas with roots and limits.

Tables as in ``layout``. Each function stays within a page or a font.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.functions.text import normalized
from blattwerk.operators.layout import NEAR, PAGE, cell_of, markdown_tables
from blattwerk.operators.styles import MATH_FONT

# Free-standing accents and what they combine as.
ACCENTS = {
    "\u00b4": "\u0301", "`": "\u0300", "\u00a8": "\u0308", "^": "\u0302", "\u02c6": "\u0302", "~": "\u0303", "\u02dc": "\u0303", "\u00b8": "\u0327",
    "\u02da": "\u030a", "\u02c7": "\u030c",
}
#: Signs around a placeholder.
OPEN, CLOSE = "\ue000", "\ue001"
# Letters of the Symbol font by the Latin key they lie on.
SYMBOL = dict(zip("ABGDEZHQIKLMNXOPRSTUFCYWabgdezhqiklmnxoprstufcywJVj", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩαβγδεζηθικλμνξοπρστυφχψωϑςϕ"))
OPERATORS = {"∑": "\\sum", "∏": "\\prod", "∫": "\\int", "⋃": "\\bigcup", "⋂": "\\bigcap"}


def with_accents(chars: DataFrame) -> DataFrame:
    """``chars`` with combining and free-standing accents on their letters.

    A combining mark goes to the character before; a free-standing accent to the
    neighbour that it lies over by more than half its width.
    """
    w = Window.partitionBy(*PAGE).orderBy("idx")
    marks = F.create_map(*[F.lit(x) for p in ACCENTS.items() for x in p])
    over = lambda left, right: F.least(F.col("right"), right) - F.greatest(F.col("left"), left) > 0.5 * (F.col("right") - F.col("left"))
    free = F.try_element_at(marks, F.col("text"))
    letter = lambda c: c.rlike(r"^\p{L}$")
    ahead = free.isNotNull() & letter(F.lead("text").over(w)) & over(F.lead("left").over(w), F.lead("right").over(w))
    back = F.col("text").rlike(r"^\p{Mn}$") | (free.isNotNull() & letter(F.lag("text").over(w)) & over(F.lag("left").over(w), F.lag("right").over(w)))
    mark = F.when(F.col("text").rlike(r"^\p{Mn}$"), F.col("text")).otherwise(free)
    c = chars.withColumn("__m", mark).withColumn("__to", F.when(F.coalesce(ahead, F.lit(False)), 1).when(F.coalesce(back, F.lit(False)), -1))
    before = F.when(F.lead("__to").over(w) == -1, F.lead("__m").over(w))
    after = F.when(F.lag("__to").over(w) == 1, F.lag("__m").over(w))
    joined = normalized(F.concat("text", F.coalesce(after, F.lit("")), F.coalesce(before, F.lit(""))))
    return c.withColumn("__j", joined).where("__to is null").withColumn("text", F.col("__j")).select(*chars.columns)


def math_pages(page_fonts: DataFrame) -> DataFrame:
    """``doc``, ``page`` with a font for formulas; fonts are judged once each."""
    fonts = page_fonts.select("font").distinct().where(F.col("font").rlike(MATH_FONT))
    return page_fonts.join(fonts, "font", "left_semi").select(*PAGE).distinct()


def recoded(chars: DataFrame, fonts: DataFrame) -> DataFrame:
    """``chars`` of the fonts in ``fonts`` (``doc``, ``font``) read as Mac Roman instead of
    Windows-1252, those of a Symbol font as Greek, private-use codes as their sign."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode("cp1252")] = bytes([b]).decode("mac_roman")
        except UnicodeDecodeError:
            continue
    mac = F.create_map(*[F.lit(x) for p in table.items() for x in p])
    greek = F.create_map(*[F.lit(x) for p in SYMBOL.items() for x in p])
    private = F.when(F.col("text").rlike(r"^[\x{f020}-\x{f07e}]$"), F.char(F.ascii("text") - 0xF000)).otherwise(F.col("text"))
    c = chars.join(fonts.select("doc", "font", F.lit(True).alias("__f")), ["doc", "font"], "left").withColumn("text", private)
    symbol = F.col("font").rlike("(?i)symbol") & F.try_element_at(greek, F.col("text")).isNotNull()
    new = F.when(symbol, F.try_element_at(greek, F.col("text"))).when(F.col("__f"), F.coalesce(F.try_element_at(mac, F.col("text")), F.col("text"))).otherwise(F.col("text"))
    return c.withColumn("text", new).select(*chars.columns)


def resolved(text: Column, mapping: Column) -> Column:
    """Placeholders (a key between OPEN and CLOSE) replaced by a map's entries; unknown
    ones become U+FFFD."""
    known = F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, F.concat(F.lit(OPEN), e["key"], F.lit(CLOSE)), e["value"]))
    return F.regexp_replace(known, f"{OPEN}[^{CLOSE}]*{CLOSE}", "\ufffd")


# ---- tables

def open_sides(stroke_table: DataFrame, least: float = 6.0) -> DataFrame:
    """``doc``, ``page``, ``table``, ``at``: borders that a grid lacks, where two horizontals
    stand out beyond the outermost vertical."""
    keys = [*PAGE, "table"]
    x = stroke_table.where("orient = 'v'").groupBy(*keys).agg(F.min("at").alias("xl"), F.max("at").alias("xr"))
    h = stroke_table.where("orient = 'h'").join(x, keys)
    left = h.where(F.col("xl") - F.col("lo") > least).groupBy(*keys).agg(F.count("*").alias("n"), F.min("lo").alias("at"))
    right = h.where(F.col("hi") - F.col("xr") > least).groupBy(*keys).agg(F.count("*").alias("n"), F.max("hi").alias("at"))
    return left.unionByName(right).where("n >= 2").select(*keys, "at")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    cells = pdf.sort_values(["row", "col"]).reset_index(drop=True)
    index = {(r, c): i for i, (r, c) in enumerate(zip(cells.row, cells.col))}
    parent = list(range(len(cells)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (r, c, right, below) in enumerate(zip(cells.row, cells.col, cells.wall_right, cells.wall_below)):
        for open_, key in ((not right, (r, c + 1)), (not below, (r + 1, c))):
            if open_ and key in index:
                a, b = root(i), root(index[key])
                parent[max(a, b)] = min(a, b)
    cells["cell"] = [root(i) for i in range(len(cells))]
    return cells


def merged_cells(cells: DataFrame, stroke_table: DataFrame) -> DataFrame:
    """``cells`` of ``layout.grid_cells`` with ``cell``: elementary cells without a wall
    between them are one."""
    s = stroke_table.where("orient in ('h', 'v')").alias("s")
    c = cells.alias("c")
    same = (F.col("c.doc") == F.col("s.doc")) & (F.col("c.page") == F.col("s.page"))

    def wall(at: str, lo: str, hi: str, orient: str) -> DataFrame:
        along = F.least(F.col("s.hi"), F.col(f"c.{hi}")) - F.greatest(F.col("s.lo"), F.col(f"c.{lo}"))
        hit = same & (F.col("s.orient") == orient) & (F.abs(F.col("s.at") - F.col(f"c.{at}")) <= NEAR) & (along >= 0.5 * (F.col(f"c.{hi}") - F.col(f"c.{lo}")))
        return c.join(s, hit, "left_semi").select(*PAGE, "table", "row", "col", F.lit(True).alias("w"))

    keys = [*PAGE, "table", "row", "col"]
    right, below = wall("right", "bottom", "top", "v").withColumnRenamed("w", "wr"), wall("bottom", "left", "right", "h").withColumnRenamed("w", "wb")
    j = cells.join(right, keys, "left").join(below, keys, "left")
    j = j.select(*cells.columns, F.coalesce("wr", F.lit(False)).alias("wall_right"), F.coalesce("wb", F.lit(False)).alias("wall_below"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in j.dtypes)
    return j.groupBy(*PAGE, "table").applyInPandas(lambda p: _merge(p), kinds + ", cell int").drop("wall_right", "wall_below")


def tables_into_text(chars: DataFrame, cells: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``idx``, ``repl``, ``prio``: corrections that put Markdown tables in the
    place of their characters. A character printed twice in a cell counts once."""
    inside = cell_of(chars, cells).where("table is not null")
    once = inside.dropDuplicates([*PAGE, "table", "row", "col", "text", "left", "bottom"])
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    text = once.groupBy(*PAGE, "table", "row", "col").agg(F.trim(F.regexp_replace(F.array_join(parts, ""), r"\s+", " ")).alias("text"))
    full = cells.select(*PAGE, "table", "row", "col").join(text, [*PAGE, "table", "row", "col"], "left")
    md = markdown_tables(full.withColumn("text", F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|"))))
    first = F.row_number().over(Window.partitionBy(*PAGE, "table").orderBy("idx")) == 1
    return inside.withColumn("__1", first).join(md, [*PAGE, "table"]).select(*PAGE, "idx", F.when(F.col("__1"), F.col("markdown")).otherwise("").alias("repl"), F.lit(2).alias("prio"))


def rule_tables(stroke_table: DataFrame, grid: DataFrame, width: float, share: float = 0.25, equal: float = 3.0) -> DataFrame:
    """``doc``, ``page``, ``lo``, ``hi``, ``lines``: groups of three or more wide horizontals of equal
    extent that no vertical crosses and no grid holds."""
    h = stroke_table.where((F.col("orient") == "h") & (F.col("hi") - F.col("lo") >= share * width))
    h = h.join(grid.where("orient = 'h'").select(*PAGE, "at").distinct(), [*PAGE, "at"], "left_anti")
    step = lambda c: F.round(F.col(c) / equal)
    g = h.groupBy(*PAGE, step("lo").alias("a"), step("hi").alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_set("at")).alias("lines")).where("size(lines) >= 3")
    v, c = stroke_table.where("orient = 'v'").alias("v"), g.alias("g")
    cross = F.expr("g.doc = v.doc and g.page = v.page and v.at > g.lo and v.at < g.hi and v.lo <= g.lines[1] and v.hi >= g.lines[0]")
    return c.join(v, cross, "left_anti").select(*PAGE, "lo", "hi", "lines")


# ---- formulas

def roots(bar_table: DataFrame, chars: DataFrame, reach: float = 1.5) -> DataFrame:
    """``doc``, ``page``, ``bar``, ``latex``: what stands under a bar that a root sign begins."""
    b, c = bar_table.alias("b"), chars.alias("c")
    same = (F.col("b.doc") == F.col("c.doc")) & (F.col("b.page") == F.col("c.page"))
    sign = b.join(c, same & (F.col("c.text") == "√") & (F.abs(F.col("c.right") - F.col("b.lo")) <= 0.5 * F.col("c.size")), "left_semi")
    mid = (F.col("c.left") + F.col("c.right")) / 2
    under = (F.col("c.top") <= F.col("b.at") + 1) & (F.col("b.at") - F.col("c.top") <= reach * F.col("c.size"))
    j = sign.alias("b").join(c, same & mid.between(F.col("b.lo"), F.col("b.hi")) & under & (F.col("c.text") != "√"))
    inner = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c.left", "c.text"))), lambda x: x["text"]), "")
    return j.groupBy("b.doc", "b.page", "b.bar").agg(inner.alias("i")).select("doc", "page", "bar", F.concat(F.lit("\\sqrt{"), "i", F.lit("}")).alias("latex"))


def limits(chars: DataFrame, reach: float = 1.2) -> DataFrame:
    """``doc``, ``page``, ``idx``, ``latex``: large operators with what stands small over and under them."""
    names = F.create_map(*[F.lit(x) for p in OPERATORS.items() for x in p])
    o, c = chars.where(F.col("text").isin(*OPERATORS)).alias("o"), chars.alias("c")
    same = (F.col("o.doc") == F.col("c.doc")) & (F.col("o.page") == F.col("c.page")) & (F.col("c.size") <= 0.85 * F.col("o.size"))
    near = (F.col("c.right") >= F.col("o.left") - F.col("c.size")) & (F.col("c.left") <= F.col("o.right") + F.col("c.size"))
    over = (F.col("c.bottom") >= F.col("o.top")) & (F.col("c.bottom") - F.col("o.top") <= reach * F.col("c.size"))
    under = (F.col("c.top") <= F.col("o.bottom")) & (F.col("o.bottom") - F.col("c.top") <= reach * F.col("c.size"))
    j = o.join(c, same & near & (over | under), "left").select("o.doc", "o.page", "o.idx", F.col("o.text").alias("op"), "c.left", "c.text", over.alias("up"))
    side = lambda s: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("up") == s, F.struct("left", "text")))), lambda x: x["text"]), "")
    g = j.groupBy("doc", "page", "idx", "op").agg(side(True).alias("a"), side(False).alias("z"))
    part = lambda sign, c: F.when(F.col(c) != "", F.concat(F.lit(sign + "{"), F.col(c), F.lit("}"))).otherwise("")
    return g.select("doc", "page", "idx", F.concat(F.try_element_at(names, F.col("op")), part("_", "z"), part("^", "a")).alias("latex"))


# ---- differences

def aligned_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``doc``, ``art`` (weg, neu), ``zeile``: the lines that a sequence alignment of two
    versions leaves over. One document's two texts are one group."""
    import difflib

    both = old.select("doc", F.col("text").alias("a")).join(new.select("doc", F.col("text").alias("b")), "doc", "full_outer")

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, a, b in pdf.itertuples(index=False):
                x, y = ([" ".join(z.split()) for z in re.split(r"\r?\n", t or "") if z.strip()] for t in (a, b))
                for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
                    if tag != "equal":
                        rows += [(doc, "weg", z) for z in x[i1:i2]] + [(doc, "neu", z) for z in y[j1:j2]]
            yield pd.DataFrame(rows, columns=["doc", "art", "zeile"])

    return both.mapInPandas(run, f"doc {dict(old.dtypes)['doc']}, art string, zeile string")
