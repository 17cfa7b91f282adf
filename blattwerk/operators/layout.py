"""Geometry of pages: runs, columns, strokes, grids, tables, characters, formulas.

Tables of ``doc``, ``page`` and coordinates with y upwards. What Catalyst can
express is windows and joins within a page; what folds over a page is one
group per page with only the columns it needs.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["doc", "page"]

# Thresholds of the layout rules, in points or shares.
THIN, SHORTEST, NEAR = 2.5, 4.0, 2.0
GAP, MIN_RUNS, MIN_WIDTH, MIN_COLUMN_LINES, LONG, WIDE, GUTTER, TOLERANCE, THROUGH = 3.0, 12, 100.0, 5, 0.3, 0.6, 5.0, 6.0, 0.25
FILLED, MIN_FILLED, MAX_CUTS, SPARSE, REGULAR, SMALL_TABLE, MIN_TEXT, MAX_CELL_TEXT = 0.25, 3, 1, 0.5, 0.6, 16, 15, 40
SMALLER, RAISED, LOWERED, REACH = 0.85, 0.15, 0.08, 12


def font_size(size: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """The size that a text matrix leaves of a font size, at least 1."""
    return F.greatest(F.lit(1.0), size * F.sqrt(F.abs(a * d - b * c)))


def runs(chars: DataFrame) -> DataFrame:
    """Line pieces of the character stream: ``doc``, ``page``, ``run``, ``start``, ``end``, box,
    ``text``.

    ``chars`` has ``idx``, ``text``, ``left``, ``right``, ``bottom``, ``top``. A piece ends at a
    newline, at a gap of three heights on the line, and at a jump back. Blank
    pieces go with the piece before.
    """
    w = Window.partitionBy(*PAGE).orderBy("idx")
    height = F.greatest(F.col("top") - F.col("bottom"), F.lit(1.0))
    pr, pb = F.lag("right").over(w), F.lag("bottom").over(w)
    level = F.abs(pb - F.col("bottom")) < height / 2
    brk = F.lag("text").over(w).isNull() | (F.lag("text").over(w) == "\n") | (level & (F.col("left") - pr > GAP * height)) | (level & (F.col("left") < pr - height))
    c = chars.withColumn("brk", brk.cast("int")).withColumn("run", F.sum("brk").over(w))
    c = c.withColumn("seen", F.col("text").rlike(r"(?U)\S"))
    full = F.max(F.col("seen").cast("int")).over(Window.partitionBy(*PAGE, "run"))
    c = c.withColumn("solid", F.when((full == 1) & (F.col("brk") == 1), 1).otherwise(0)).withColumn("run", F.greatest(F.sum("solid").over(w), F.lit(1)))
    v = lambda x: F.when(F.col("seen"), F.col(x))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    return c.groupBy(*PAGE, "run").agg(
        F.min("idx").alias("start"), F.max("idx").alias("end"), F.min(v("left")).alias("left"), F.min(v("bottom")).alias("bottom"),
        F.max(v("right")).alias("right"), F.max(v("top")).alias("top"), F.array_join(parts, "").alias("text"),
    )


def line_styles(chars: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``pos``, ``text``, ``size`` (upper median), ``bold``, ``italic`` by line."""
    w = Window.partitionBy(*PAGE).orderBy("idx")
    c = chars.withColumn("pos", F.sum(F.coalesce((F.lag("text").over(w) == "\n").cast("int"), F.lit(0))).over(w)).where("text <> '\n'")
    seen = F.col("text").rlike(r"(?U)\S")
    sizes = F.sort_array(F.collect_list(F.when(seen, F.col("size"))))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])
    g = c.groupBy(*PAGE, "pos").agg(
        F.array_join(parts, "").alias("text"), sizes.alias("s"), F.avg(F.when(seen, F.contains("style", F.lit("f")).cast("double"))).alias("bold"), F.avg(F.when(seen, F.contains("style", F.lit("k")).cast("double"))).alias("italic")
    )
    return g.where("size(s) > 0").select(*PAGE, "pos", "text", F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int")).alias("size"), "bold", "italic")


# ---- reading order

def _gutter(lines: np.ndarray, xmin: float, xmax: float) -> float | None:
    """The middle of the only inner gap that the long lines leave, or None."""
    grid = np.zeros(int(xmax - xmin) + 2)
    for left, right in lines:
        grid[max(0, int(left - xmin)) : max(0, int(np.ceil(right - xmin)))] += 1
    free = grid <= max(1, THROUGH * len(lines))
    lo, hi = int(0.15 * len(grid)), int(0.85 * len(grid))
    gaps, start = [], None
    for x in range(lo, hi + 1):
        if x < hi and free[x]:
            start = x if start is None else start
        elif start is not None:
            if x - start >= GUTTER:
                gaps.append((start, x))
            start = None
    return xmin + sum(gaps[0]) / 2 if len(gaps) == 1 else None


def reading_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """``rank`` of each run of a page in reading order; the stream's order unless two
    columns are sure and the stream mixes them up."""
    n = len(pdf)
    out = pdf.sort_values("run").reset_index(drop=True)
    out["rank"] = np.arange(n)
    out["moved"] = False
    box = out.dropna(subset=["left"])
    if len(box) < MIN_RUNS:
        return out
    xmin, xmax = np.percentile(box.left, 3), np.percentile(box.right, 97)
    width = xmax - xmin
    long = box[(box.right - box.left >= LONG * width)]
    narrow = long[long.right - long.left < WIDE * width]
    if width < MIN_WIDTH or len(narrow) < 10:
        return out
    mid = _gutter(narrow[["left", "right"]].to_numpy(), xmin, xmax)
    if mid is None:
        return out
    side = []
    last = "F"
    for r in out.itertuples():
        if pd.isna(r.left) or r.right - r.left < LONG * width:
            side.append(last)  # a short piece goes with the long one before
            continue
        last = "F" if r.right - r.left >= WIDE * width or r.left < mid - TOLERANCE and r.right > mid + TOLERANCE else "L" if (r.left + r.right) / 2 < mid else "R"
        side.append(last)
    out["side"] = side
    for s, lo, hi in (("L", xmin, mid), ("R", mid, xmax)):
        col = out[(out.side == s) & out.left.notna()]
        if ((col.right - col.left) >= 0.8 * (hi - lo - GUTTER)).sum() < MIN_COLUMN_LINES:
            return out.drop(columns="side")
    full = np.sort(-out[(out.side == "F") & out.top.notna()].top.to_numpy())
    y = out.top.ffill().fillna(0)
    out["band"] = [bisect_right(full, -t) for t in y]
    mixed = any(
        (g.side == "R").any() and (g.side == "L").any() and g[g.side == "R"].run.min() < g[g.side == "L"].run.max()
        for _, g in out[out.side != "F"].groupby("band")
    )
    if mixed:
        order = sorted(range(n), key=lambda i: (out.band[i] - (out.side[i] == "F"), {"L": 0, "R": 1, "F": 2}[out.side[i]], -y[i], out.run[i]))
        out.loc[order, "rank"] = np.arange(n)
        out["moved"] = True
    return out.drop(columns=["side", "band"])


def column_order(run_table: DataFrame) -> DataFrame:
    """``run_table`` with ``rank`` and ``moved``: reading order of each page."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in run_table.dtypes)
    return run_table.groupBy(*PAGE).applyInPandas(lambda p: reading_order(p), f"{kinds}, rank int, moved boolean")


# ---- strokes and grids

def strokes(paths: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``orient`` (h, v), ``at``, ``lo``, ``hi``: thin paths and the edges of
    outlined rectangles. ``paths`` has a box and ``outlined``."""
    b = {c: F.col(c) for c in ("left", "bottom", "right", "top")}
    h = lambda y: F.struct(F.lit("h").alias("orient"), y.alias("at"), b["left"].alias("lo"), b["right"].alias("hi"))
    v = lambda x: F.struct(F.lit("v").alias("orient"), x.alias("at"), b["bottom"].alias("lo"), b["top"].alias("hi"))
    wide, high = b["right"] - b["left"], b["top"] - b["bottom"]
    made = F.when((high < THIN) & (wide >= SHORTEST), F.array(h((b["top"] + b["bottom"]) / 2))).when((wide < THIN) & (high >= SHORTEST), F.array(v((b["left"] + b["right"]) / 2)))
    made = made.when(F.col("outlined"), F.array(h(b["bottom"]), h(b["top"]), v(b["left"]), v(b["right"])))
    return paths.select(*PAGE, F.explode(made).alias("s")).select(*PAGE, "s.*")


def merged_intervals(items: DataFrame, keys: list[str], lo: str = "lo", hi: str = "hi", near: float = NEAR) -> DataFrame:
    """Overlapping or nearly touching intervals of equal ``keys`` as one."""
    w = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = items.withColumn("__new", F.coalesce((F.col(lo) > reach + near).cast("int"), F.lit(1))).withColumn("__g", F.sum("__new").over(w))
    return i.groupBy(*keys, "__g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("teile")).drop("__g")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strokes with at least two crossings, by connected component."""
    s = pdf.sort_values(["orient", "at", "lo"]).reset_index(drop=True)
    alive = np.ones(len(s), bool)
    h, v = np.flatnonzero(s.orient == "h"), np.flatnonzero(s.orient == "v")
    at, lo, hi = s["at"].to_numpy(), s["lo"].to_numpy(), s["hi"].to_numpy()
    cross = (lo[h][:, None] - NEAR <= at[v][None]) & (at[v][None] <= hi[h][:, None] + NEAR) & (lo[v][None] - NEAR <= at[h][:, None]) & (at[h][:, None] <= hi[v][None] + NEAR)
    while True:
        c = cross & alive[h][:, None] & alive[v][None]
        few = np.r_[h[(c.sum(1) < 2) & alive[h]], v[(c.sum(0) < 2) & alive[v]]]
        if not len(few):
            break
        alive[few] = False
    parent = list(range(len(s)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(c)):
        parent[root(h[i])] = root(v[j])
    s["table"] = [root(i) if alive[i] else -1 for i in range(len(s))]
    out = s[s.table >= 0].copy()
    out["table"] = out.table.map({t: n for n, t in enumerate(sorted(out.table.unique()))})
    return out


def grids(stroke_table: DataFrame) -> DataFrame:
    """``stroke_table`` restricted to strokes of grids, with ``table`` by page."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in stroke_table.dtypes)
    return stroke_table.groupBy(*PAGE).applyInPandas(lambda p: _components(p), f"{kinds}, table int")


def grid_cells(grid: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``table``, ``row``, ``col``, box: elementary cells between the
    distinct boundaries of a grid of at least two by two."""
    w = Window.partitionBy(*PAGE, "table", "orient").orderBy("at")
    b = grid.select(*PAGE, "table", "orient", "at").withColumn("__n", (F.col("at") - F.coalesce(F.lag("at").over(w), F.lit(-1e9)) > NEAR)).where("__n")
    b = b.withColumn("next", F.lead("at").over(w)).withColumn("k", F.row_number().over(w) - 1).where("next is not null")
    cols = b.where("orient = 'v'").select(*PAGE, "table", F.col("k").alias("col"), F.col("at").alias("left"), F.col("next").alias("right"))
    count = F.count("*").over(Window.partitionBy(*PAGE, "table"))
    rows = b.where("orient = 'h'").withColumn("row", count - 1 - F.col("k")).select(*PAGE, "table", F.col("row").cast("int").alias("row"), F.col("at").alias("bottom"), F.col("next").alias("top"))
    # rows meet columns of their own table only
    cells = rows.join(cols, [*PAGE, "table"])
    n = cells.groupBy(*PAGE, "table").agg(F.countDistinct("row").alias("r"), F.countDistinct("col").alias("c")).where("r >= 2 and c >= 2 and r * c <= 5000")
    return cells.join(n.select(*PAGE, "table"), [*PAGE, "table"], "left_semi")


def cell_of(chars: DataFrame, cells: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``chars`` with ``table``, ``row``, ``col`` of the first cell that holds their middle."""
    x, y = (F.col("c.left") + F.col("c.right")) / 2, (F.col("c.bottom") + F.col("c.top")) / 2
    a, b = chars.alias("c"), cells.alias("z")
    inside = (x >= F.col("z.left") - tolerance) & (x <= F.col("z.right") + tolerance) & (y >= F.col("z.bottom") - tolerance) & (y <= F.col("z.top") + tolerance)
    hit = a.join(b, (F.col("c.doc") == F.col("z.doc")) & (F.col("c.page") == F.col("z.page")) & inside).groupBy("c.doc", "c.page", "c.idx").agg(F.min(F.struct("z.table", "z.row", "z.col")).alias("z"))
    return chars.join(hit, [*PAGE, "idx"], "left").select(*chars.columns, "z.table", "z.row", "z.col")


def covered(edges: DataFrame, stroke_table: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """``edges`` (``id``, ``orient``, ``at``, ``lo``, ``hi``) with ``covered``: a stroke lies along at
    least ``share`` of each."""
    e, s = edges.alias("e"), stroke_table.alias("s")
    on = F.abs(F.col("e.at") - F.col("s.at")) <= NEAR
    for k in [*keys, "orient"]:
        on = on & (F.col(f"e.{k}") == F.col(f"s.{k}"))
    part = F.greatest(F.lit(0.0), F.least("e.hi", "s.hi") - F.greatest("e.lo", "s.lo"))
    got = e.join(s, on).groupBy("e.id").agg(F.max(part).alias("part"))
    return edges.join(got, "id", "left").withColumn("covered", F.coalesce(F.col("part"), F.lit(0.0)) >= share * (F.col("hi") - F.col("lo"))).drop("part")


def real_tables(cells: DataFrame, cuts: DataFrame | None = None) -> DataFrame:
    """``doc``, ``page``, ``table`` that are tables and not drawings.

    ``cells`` has ``row``, ``col``, ``text`` and optionally merged cells as ``cell``. At
    least a quarter filled, three filled cells over two rows and columns, no more
    than one cut word; a sparse one must be regular and not a small frame.
    """
    full = F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0
    cell = F.col("cell") if "cell" in cells.columns else F.concat_ws("/", "row", "col")
    t = cells.groupBy(*PAGE, "table").agg(
        F.count("*").alias("elements"), F.countDistinct(cell).alias("cells"), F.count_if(full).alias("filled"),
        F.countDistinct(F.when(full, F.col("row"))).alias("rows"), F.countDistinct(F.when(full, F.col("col"))).alias("cols"),
        F.countDistinct("col").alias("allcols"), F.avg(F.when(full, F.length("text"))).alias("mean"),
    )
    if cuts is not None:
        t = t.join(cuts.groupBy(*PAGE, "table").agg(F.count("*").alias("cut")), [*PAGE, "table"], "left").where(F.coalesce("cut", F.lit(0)) <= MAX_CUTS)
    fill = F.col("filled") / F.col("cells")
    sparse = (F.col("cells") / F.col("elements") >= REGULAR) & ~(((F.col("cells") <= SMALL_TABLE) | (F.col("allcols") <= 2)) & (F.col("mean") < MIN_TEXT))
    return t.where((fill >= FILLED) & (F.col("filled") >= MIN_FILLED) & (F.col("rows") >= 2) & (F.col("cols") >= 2) & ((fill >= SPARSE) | sparse)).select(*PAGE, "table")


def markdown_tables(cells: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``table``, ``markdown``: cells as a pipe table, empty rows after the
    first dropped."""
    row = F.transform(F.sort_array(F.collect_list(F.struct("col", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    rows = cells.groupBy(*PAGE, "table", "row").agg(row.alias("c"))
    first = F.row_number().over(Window.partitionBy(*PAGE, "table").orderBy("row")) == 1
    rows = rows.withColumn("head", first).where(F.col("head") | F.exists("c", lambda t: F.trim(t) != ""))
    line = F.concat(F.lit("| "), F.array_join("c", " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("c")))
    rows = rows.withColumn("line", F.when(F.col("head"), F.concat(line, F.lit("\n"), rule)).otherwise(line))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return rows.groupBy(*PAGE, "table").agg(F.array_join(parts, "\n").alias("markdown"))


def table_columns(words: DataFrame, size: str = "size", gap: float = 0.55) -> DataFrame:
    """``doc``, ``page``, ``table``, ``col``, ``left``, ``right``: columns that white space leaves in
    all lines of a table without vertical rules. ``words`` has ``left`` and ``right``."""
    keys = [*PAGE, "table"]
    widest = words.groupBy(*keys).agg((F.max(size) * gap).alias("gap"))
    j = words.join(widest, keys)
    w = Window.partitionBy(*keys).orderBy("left", "right")
    reach = F.max("right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumn("new", F.coalesce((F.col("left") - reach >= F.col("gap")).cast("int"), F.lit(1))).withColumn("col", F.sum("new").over(w) - 1)
    return j.groupBy(*keys, "col").agg(F.min("left").alias("left"), F.max("right").alias("right"))


def bars(stroke_table: DataFrame, thickness: str = "thick") -> DataFrame:
    """Short horizontal strokes that may be fraction bars: thin, 2 to 360 points long,
    not touching a vertical, not one of three of equal length within 40 points."""
    s = stroke_table.where((F.col("orient") == "h") & (F.col(thickness) <= 1.6) & (F.col("hi") - F.col("lo")).between(2, 360)).withColumn("id", F.monotonically_increasing_id())
    a, v, b = s.alias("a"), stroke_table.where("orient = 'v'").alias("v"), s.alias("b")
    same = (F.col("a.doc") == F.col("v.doc")) & (F.col("a.page") == F.col("v.page"))
    touch = F.expr(f"v.at between a.lo - {NEAR} and a.hi + {NEAR} and a.at between v.lo - {NEAR} and v.hi + {NEAR}")
    free = a.join(v, same & touch, "left_anti")
    twin = F.expr(f"a.doc = b.doc and a.page = b.page and a.id <> b.id and abs(a.at - b.at) <= 40 and abs(a.hi - a.lo - b.hi + b.lo) <= {NEAR} and abs(a.lo - b.lo) <= {NEAR}")
    series = free.alias("a").join(b, twin).groupBy("a.id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    return free.join(series, "id", "left_anti").drop("id")


# ---- characters

def replaced(chars: DataFrame, corrections: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``text``: the page with characters replaced by index.

    ``corrections`` has ``idx``, ``repl`` and ``prio``; the greatest priority wins, an
    empty replacement deletes.
    """
    best = corrections.groupBy(*PAGE, "idx").agg(F.max_by("repl", "prio").alias("repl"))
    j = chars.join(best, [*PAGE, "idx"], "left")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.coalesce("repl", "text").alias("t")))), lambda x: x["t"])
    return j.groupBy(*PAGE).agg(F.array_join(parts, "").alias("text"))


def recoded_fonts(evidence: DataFrame, least: int = 5, words: int = 3) -> DataFrame:
    """``doc``, ``font`` whose characters stand for another encoding.

    ``evidence`` has ``word`` and ``for`` (whether it speaks for the recoding); enough
    for it in different words and nothing against it decides.
    """
    e = evidence.groupBy("doc", "font").agg(F.count_if("for").alias("n"), F.countDistinct(F.when(F.col("for"), F.col("word"))).alias("w"), F.count_if(~F.col("for")).alias("against"))
    return e.where((F.col("n") >= least) & (F.col("w") >= words) & (F.col("against") == 0)).select("doc", "font")


def repaired_characters(chars: DataFrame, mapping: DataFrame) -> DataFrame:
    """``chars`` with ``repaired``: what the mapping of (doc, font, code) says, else the text.

    Only pages with a mapped font are touched; the mapping has a row per glyph.
    """
    return chars.join(mapping.select("doc", "font", "code", F.col("text").alias("__m")), ["doc", "font", "code"], "left").withColumn("repaired", F.coalesce("__m", "text")).drop("__m")


#: Known glyphs at most: they go to every task.
MAX_REFERENCES = 65_536


def glyph_votes(samples: DataFrame, references: DataFrame, least: float = 0.6, margin: float = 0.06) -> DataFrame:
    """``doc``, ``font``, ``code``, ``char``, ``score``: the reference glyph most like the samples.

    ``samples`` and ``references`` have ``vec``, unit vectors of one length. The mean
    likeness over a glyph's samples must reach ``least`` and beat the next by
    ``margin``; it is the likeness of the mean, so samples are averaged first.
    ``references`` is a table of known glyphs; one beyond MAX_REFERENCES is refused.
    """
    known = references.select("char", "vec").orderBy("char").limit(MAX_REFERENCES + 1).collect()
    if len(known) > MAX_REFERENCES:
        raise ValueError(f"more than {MAX_REFERENCES} reference glyphs")
    chars = [r["char"] for r in known]
    matrix = np.array([r["vec"] for r in known], dtype=float).reshape(len(known), -1)
    keys = ["doc", "font", "code"]
    parts = samples.select(*keys, F.posexplode("vec").alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))

    def vote(batches):
        for pdf in batches:
            if not len(pdf) or not chars:
                yield pd.DataFrame({**{k: pdf[k][:0] for k in keys}, "char": [], "score": []})
                continue
            s = np.stack(pdf["vec"].to_numpy()) @ matrix.T
            best = s.argmax(axis=1)  # of equal ones the first character
            score = s[np.arange(len(s)), best]
            s[np.arange(len(s)), best] = -np.inf
            nxt = np.where(np.isinf(s.max(axis=1)), 0.0, s.max(axis=1))
            ok = (score >= least) & (score - nxt >= margin)
            out = pdf[keys].copy()
            out["char"], out["score"] = [chars[b] for b in best], score
            yield out[ok]

    kinds = dict(samples.dtypes)
    return means.mapInPandas(vote, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", char string, score double")


def _doubled(pdf: pd.DataFrame) -> pd.DataFrame:
    seen: set = set()
    keep = []
    for _, line in pdf.sort_values("idx").groupby("pos", sort=True):
        keys = [(t, round(x, 1), round(y, 1)) for t, x, y in zip(line.text, line.left, line.bottom) if t.strip()]
        if len(keys) >= 3 and sum(k in seen for k in keys) >= 0.9 * len(keys):
            continue
        seen.update(keys)
        keep.append(line)
    return pd.concat(keep) if keep else pdf.iloc[:0]


def without_doubles(chars: DataFrame) -> DataFrame:
    """``chars`` (with line ``pos``) without lines printed again at the same place."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in chars.dtypes)
    return chars.groupBy(*PAGE).applyInPandas(lambda p: _doubled(p), kinds)


# ---- formulas

def script_positions(chars: DataFrame) -> DataFrame:
    """``chars`` with ``stellung``: ``hoch``, ``tief`` or null against the line's base.

    ``chars`` has ``line``, ``baseline`` and ``size``. The base is the upper median
    baseline of the line's large characters.
    """
    line = Window.partitionBy(*PAGE, "line")
    c = chars.withColumn("big", F.max("size").over(line))
    base = c.where("size >= 0.85 * big").groupBy(*PAGE, "line").agg(F.sort_array(F.collect_list("baseline")).alias("b"))
    c = c.join(base.select(*PAGE, "line", F.element_at("b", (F.floor(F.size("b") / 2) + 1).cast("int")).alias("base")), [*PAGE, "line"], "left")
    d = F.col("baseline") - F.col("base")
    small = F.col("size") <= SMALLER * F.col("big")
    return c.withColumn("stellung", F.when(small & (d >= RAISED * F.col("big")), "hoch").when(small & (d <= -LOWERED * F.col("big")), "tief")).drop("big", "base")


def _typeset(pdf: pd.DataFrame) -> str:
    """A line's characters as LaTeX: scripts in braces, fractions at their bar."""
    out, mode, held = [], None, ""

    def close() -> None:
        nonlocal held
        if mode:
            out.append(("^" if mode == "hoch" else "_") + (held if len(held) == 1 else "{" + held + "}"))
        held = ""

    for t, s in zip(pdf.text, pdf.stellung):
        s = s if isinstance(s, str) else None
        if s != mode:
            close()
            mode = s
        if mode:
            held += t
        else:
            out.append(t)
    close()
    return "".join(out)


def _page_formulas(chars: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for (doc, page, line), g in chars.groupby(["doc", "page", "line"], sort=True):
        rows.append((doc, page, line, _typeset(g.sort_values("idx")), bool(g.stellung.notna().any())))
    return pd.DataFrame(rows, columns=["doc", "page", "line", "latex", "formula"])


def typeset_lines(chars: DataFrame) -> DataFrame:
    """``doc``, ``page``, ``line``, ``latex``, ``formula`` (whether scripts were set)."""
    src = script_positions(chars).select(*PAGE, "line", "idx", "text", "stellung")
    kind = dict(chars.dtypes)
    return src.groupBy(*PAGE).applyInPandas(lambda p: _page_formulas(p), f"doc {kind['doc']}, page {kind['page']}, line {kind['line']}, latex string, formula boolean")


def fractions(bar_table: DataFrame, chars: DataFrame, reach: float = 1.5) -> DataFrame:
    """``doc``, ``page``, ``bar``, ``latex``: what stands over and under each bar.

    A character belongs to the shortest bar that spans it within ``reach`` of its
    size, so inner fractions come first.
    """
    b, c = bar_table.alias("b"), chars.alias("c")
    mid = (F.col("c.left") + F.col("c.right")) / 2
    over = (F.col("c.bottom") >= F.col("b.at")) & (F.col("c.bottom") - F.col("b.at") <= reach * F.col("c.size"))
    under = (F.col("c.top") <= F.col("b.at")) & (F.col("b.at") - F.col("c.top") <= reach * F.col("c.size"))
    j = b.join(c, (F.col("b.doc") == F.col("c.doc")) & (F.col("b.page") == F.col("c.page")) & mid.between(F.col("b.lo"), F.col("b.hi")) & (over | under))
    j = j.select("b.doc", "b.page", "b.bar", (F.col("b.hi") - F.col("b.lo")).alias("len"), "c.idx", "c.left", "c.text", over.alias("over"))
    mine = j.groupBy("doc", "page", "idx").agg(F.min_by(F.struct("bar", "left", "text", "over"), F.struct("len", "bar")).alias("x")).select("doc", "page", "x.*")
    side = lambda up: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("over") == up, F.struct("left", "text")))), lambda x: x["text"]), "")
    f = mine.groupBy("doc", "page", "bar").agg(side(True).alias("a"), side(False).alias("z")).where("a <> '' and z <> ''")
    return f.select("doc", "page", "bar", F.concat(F.lit("\\frac{"), "a", F.lit("}{"), "z", F.lit("}")).alias("latex"))


def words_of_line(chars: DataFrame, gap: float = 0.25) -> DataFrame:
    """``chars`` with ``word``: a new one where the gap exceeds a quarter of the size."""
    w = Window.partitionBy(*PAGE, "line").orderBy("left")
    brk = F.coalesce(F.col("left") - F.lag("right").over(w) > gap * F.col("size"), F.lit(True))
    return chars.withColumn("word", F.sum(brk.cast("int")).over(w))


def word_operators(chars: DataFrame) -> DataFrame:
    """``chars`` with ``operator``: three letters in a row that name one."""
    w = Window.partitionBy(*PAGE, "line").orderBy("idx")
    three = F.concat("text", F.coalesce(F.lead("text").over(w), F.lit("")), F.coalesce(F.lead("text", 2).over(w), F.lit("")))
    return chars.withColumn("operator", F.when(three.isin("lim", "max", "min", "sup", "inf"), F.concat(F.lit("\\"), three)))
