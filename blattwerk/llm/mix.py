"""A mixture of sources by target shares, as a low-discrepancy schedule.

Each source's documents stand in a shuffled order, repeated as often as its
share needs and its cap allows, and this stream is cut into blocks of equal
tokens. A source with n blocks has n points in the unit interval, evenly spaced
and moved by a van der Corput point of its own; these points are the quantiles
of its part of the cumulative weights. The mixture takes all points in order,
so every stretch of it has about its shares, and each block has a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blattwerk.session import cut, running_sum

BLOCK_TOKENS = 4096
SEED = 20250101
#: Blocks to a chunk of a source's order and of the schedule.
CHUNK = 50_000


def source_plan(sizes: DataFrame, targets: DataFrame, percent: float) -> DataFrame:
    """A row per target source: what it has, should give, and how often it repeats.

    ``source``, ``anteil``, ``hoechstens``, ``vorrat`` (its tokens), ``ziel``,
    ``ganz`` (whole passes over its documents), ``rest`` (tokens of the last
    pass). Null shares count as 0, null caps as 1.
    """
    stock = sizes.groupBy("source").agg(F.sum("tokens").alias("vorrat"))
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("alles")).first()["alles"]
    t = targets.select("source", F.coalesce("anteil", F.lit(0.0)).alias("anteil"), F.greatest(F.coalesce("max_wiederholungen", F.lit(1)), F.lit(0)).alias("hoechstens"))
    p = t.join(stock, "source", "left").withColumn("vorrat", F.coalesce("vorrat", F.lit(0)))
    p = p.withColumn("ziel", F.col("anteil") * F.lit(total) * percent / 100)
    ganz = F.when(F.col("vorrat") == 0, 0).otherwise(F.least(F.floor(F.col("ziel") / F.col("vorrat")), F.col("hoechstens"))).cast("int")
    p = p.withColumn("ganz", ganz)
    return p.withColumn("rest", F.when(F.col("ganz") < F.col("hoechstens"), F.col("ziel") - F.col("ganz") * F.col("vorrat")).otherwise(0.0))


def select_documents(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``, ``wiederholung`` (from 0), ``ab``.

    ``ab`` is where the use starts in its source's stream of tokens. In the last
    pass a document is used if at least half of it is within the rest, so a
    source misses its target by no more than half a document.
    """
    # the plan has one row per target source, the targets table's bound
    docs = sizes.where("source is not null and tokens > 0").join(F.broadcast(plan.select("source", "vorrat", "ganz", "rest")), "source")
    h = F.xxhash64("doc_id", F.lit(SEED))
    docs = docs.withColumn("h", h).withColumn("chunk", F.shiftright("h", 54))
    docs = running_sum(docs, ["source"], ["h", "doc_id"], F.col("tokens"), "chunk", "davor").withColumn("davor", F.col("davor") - F.col("tokens"))
    uses = F.col("ganz") + F.when(F.col("davor") + F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0)
    return (
        docs.withColumn("uses", uses)
        .where("uses > 0")
        .select("doc_id", "source", "tokens", "vorrat", "davor", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("wiederholung"))
        .select("doc_id", "source", "tokens", "wiederholung", (F.col("wiederholung").cast("bigint") * F.col("vorrat") + F.col("davor")).alias("ab"))
    )


def van_der_corput(n: Column) -> Column:
    """The point of ``n`` from 1 on: its binary digits behind the point, backwards."""
    digits = F.bin(n)
    return F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))


def schedule(blocks: DataFrame) -> DataFrame:
    """``blocks`` (``source``, ``block``, each once) with ``platz``: dense from 0, unique.

    The k-th of a source's n blocks stands at (k + v) / n, where v is the van der
    Corput point of the source in order of name; of equal points the first source
    counts. Ranks are sums by chunk, then over the chunks.
    """
    b = cut(running_sum(blocks.withColumn("chunk", F.floor(F.col("block") / CHUNK)), ["source"], ["block"], F.lit(1), "chunk", "k").drop("chunk"))
    n = b.groupBy("source").agg(F.count("*").alias("n"))
    # a row per target source: one window holds them
    n = n.withColumn("v", van_der_corput(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("source"))))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("x")).first()["x"]
    at = (F.col("k") - 1 + F.col("v")) / F.col("n")
    p = b.join(F.broadcast(n), "source").withColumn("at", at).withColumn("chunk", F.floor(F.col("at") * F.lit(total // CHUNK + 1)))
    p = running_sum(p, [], ["at", "source"], F.lit(1), "chunk", "platz")
    return p.select("source", "block", (F.col("platz") - 1).alias("platz"))


def mixture(sizes: DataFrame, targets: DataFrame, percent: float, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``platz``, ``source``, ``block``, ``ab``, ``doc_id``, ``wiederholung``, ``tokens``.

    A place holds the uses that start in one block, in the order of ``ab``; places
    are dense from 0, no two blocks share one. ``sizes`` has a unique ``doc_id``,
    ``source`` and ``tokens``, and should be stored, as it is read several times.
    Documents of no target source, of source null and without tokens aren't used.
    Sources too small for their share even at the cap give what they have, and
    each source is at most half a document off; the shares report tells.
    """
    chosen = cut(select_documents(sizes, source_plan(sizes, targets, percent)).withColumn("block", F.floor(F.col("ab") / block_tokens)))
    slots = schedule(chosen.select("source", "block").distinct())
    return chosen.join(slots, ["source", "block"]).select("platz", "source", "block", "ab", "doc_id", "wiederholung", "tokens")


def shares(sizes: DataFrame, targets: DataFrame, percent: float) -> DataFrame:
    """A row per target source: its share wanted and really got.

    ``source``, ``anteil``, ``ziel_token``, ``token``, ``ist_anteil``, ``abweichung`` (got less wanted),
    ``verwendungen``, ``dokumente``, ``haeufigste``.
    """
    plan = source_plan(sizes, targets, percent)
    got = select_documents(sizes, plan).groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("u"))
    got = got.groupBy("source").agg(F.sum("t").alias("token"), F.sum("u").alias("verwendungen"), F.count("*").alias("dokumente"), F.max("u").alias("haeufigste"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("token", "verwendungen", "dokumente", "haeufigste")]
    out = plan.join(got, "source", "left").select("source", "anteil", F.round("ziel", 1).alias("ziel_token"), *zero)
    # one row per target source: a single window holds them
    total = F.sum("token").over(Window.partitionBy(F.lit(1)))
    return out.select("source", "anteil", "ziel_token", "token", F.round(F.try_divide(F.col("token"), total), 6).alias("ist_anteil"), F.round(F.try_divide(F.col("token"), total) - F.col("anteil"), 6).alias("abweichung"), "verwendungen", "dokumente", "haeufigste")
