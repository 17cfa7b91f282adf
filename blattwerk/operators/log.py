"""The action log: runs, durations, lookups, what may be undone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.functions.text import log_time, plausible_seconds
from blattwerk.session import carried

# What the statuses of the log mean.
KIND = {
    "OK": "Umwandlung", "PRÜFEN": "Umwandlung", "FEHLER": "Umwandlung", "NACHGEBESSERT": "Umwandlung",
    "TEXT_ERNEUERT": "Text erneuert", "UMBENANNT": "Umbenannt", "RÜCKGÄNGIG": "Rückgängig",
}
CONVERSIONS = ("OK", "PRÜFEN", "FEHLER", "TEXT_ERNEUERT")
UNDOABLE = ("OK", "PRÜFEN", "NACHGEBESSERT", "UMBENANNT")
COLUMNS = (
    "lauf", "zeit", "status", "original_name", "neuer_name", "ordner", "von_pfad", "nach_pfad", "md_pfad", "titel", "autor", "jahr",
    "titel_quelle", "autor_quelle", "jahr_quelle", "kennung", "hinweis",
)


def kind(status: Column) -> Column:
    """The kind of action, null for an unknown status."""
    table = F.create_map(*[F.lit(x) for pair in KIND.items() for x in pair])
    return F.try_element_at(table, status)


def named() -> Column:
    """The name that a row of the log speaks of: new name, stem of the text file, original name."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce("md_pfad", F.lit("")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif("neuer_name", F.lit("")), F.nullif(stem, F.lit("")), "original_name")


def with_pages(log: DataFrame, pages: DataFrame) -> DataFrame:
    """``log`` with ``seiten``, looked up by the row's name, else by the original one.

    ``pages`` has ``name`` and ``seiten``, one row a name.
    """
    new = pages.select(F.col("name").alias("__name"), F.col("seiten").alias("__neu"))
    old = pages.select(F.col("name").alias("original_name"), F.col("seiten").alias("__alt"))
    return log.withColumn("__name", named()).join(new, "__name", "left").join(old, "original_name", "left").withColumn("seiten", F.coalesce("__neu", "__alt")).drop("__name", "__neu", "__alt")


def run_summary(log: DataFrame) -> DataFrame:
    """A row per run and kind: files, outcomes, duration, pages, pages a minute.

    ``log`` has ``lauf``, ``zeit``, ``status``, ``seiten``. Rows of unknown
    status are left out; a duration beyond six hours or before the start is
    null, pages that sum to 0 are null.
    """
    k = log.withColumn("art", kind(F.col("status"))).where("art is not null")
    conv = F.col("status").isin(*CONVERSIONS)
    counted = F.when(F.col("art").isin("Umwandlung", "Text erneuert"), conv).otherwise(F.lit(True))
    g = k.groupBy("lauf", "art").agg(
        F.count_if(counted).alias("dateien"),
        F.count_if(F.col("status").isin("OK", "TEXT_ERNEUERT")).alias("ok"),
        F.count_if(F.col("status") == "PRÜFEN").alias("pruefen"),
        F.count_if(F.col("status") == "FEHLER").alias("fehler"),
        F.count_if(F.col("status") == "NACHGEBESSERT").alias("nachgebessert"),
        F.max(F.when(conv, log_time(F.col("zeit")))).alias("ende"),
        F.sum(F.when(conv, F.coalesce("seiten", F.lit(0)))).alias("s"),
    )
    sekunden = plausible_seconds(F.col("ende").cast("long") - log_time(F.col("lauf")).cast("long"))
    g = g.withColumn("sekunden", sekunden).withColumn("seiten", F.nullif(F.col("s"), F.lit(0)))
    pace = F.when(F.col("sekunden") > 0, F.bround(F.col("seiten") * 60 / F.col("sekunden"), 1))
    return g.select("lauf", "art", "dateien", "ok", "pruefen", "fehler", "nachgebessert", "sekunden", "seiten", pace.alias("seiten_je_minute"))


def step_durations(log: DataFrame, order: str) -> DataFrame:
    """Each conversion with the seconds since the step before it in its run.

    ``order``, ``name``, ``lauf``, ``art``, ``status``, ``sekunden``, ``seiten``. Rows stand in the
    order of ``zeit`` as text, then of ``order``, which is unique. The first step
    counts from the run's start. A row whose time can't be read has null seconds
    and doesn't advance the clock. ``log`` has ``seiten`` as ``with_pages`` gives it.
    """
    t = log.select(
        F.col(order), named().alias("name"), "lauf", kind(F.col("status")).alias("art"), "status", F.coalesce("zeit", F.lit("")).alias("zeit"),
        log_time(F.col("zeit")).cast("long").alias("t"), "seiten",
    ).where("art is not null")
    t = carried(t, ["lauf", "art"], ["zeit", order], "t", "before")
    since = F.col("t") - F.coalesce("before", log_time(F.col("lauf")).cast("long"))
    return t.where(F.col("status").isin(*CONVERSIONS)).select(order, "name", "lauf", "art", "status", plausible_seconds(since).alias("sekunden"), "seiten")


def undo_plan(log: DataFrame, order: str) -> DataFrame:
    """The steps of the last run that may be undone and wasn't yet, last first.

    Only rows with run, status and both paths count. A run is undone once a row
    of status RÜCKGÄNGIG belongs to it; the last run is that of the last row, by
    ``order``, that may be undone.
    """
    whole = log.where(" and ".join(f"coalesce({c}, '') <> ''" for c in ("lauf", "status", "von_pfad", "nach_pfad")))
    undone = whole.where("status = 'RÜCKGÄNGIG'").select("lauf").distinct()
    open_rows = whole.where(F.col("status").isin(*UNDOABLE)).join(undone, "lauf", "left_anti")
    last = open_rows.agg(F.max_by("lauf", order).alias("lauf"))
    steps = open_rows.join(F.broadcast(last), "lauf")
    return steps.select(order, "lauf", "status", F.col("nach_pfad").alias("von"), F.col("von_pfad").alias("nach")).orderBy(F.desc(order))


def latest_runs(log: DataFrame, n: int = 24) -> DataFrame:
    """The ``n`` latest runs with their kind and number of rows."""
    k = log.withColumn("art", kind(F.col("status"))).where("art is not null")
    return k.groupBy("lauf", "art").agg(F.count("*").alias("zeilen")).orderBy(F.desc("lauf"), "art").limit(n)


def events_after(events: DataFrame, number: str, after: int) -> DataFrame:
    """The events beyond an offset, in order."""
    return events.where(F.col(number) > after).orderBy(number)


def ring(events: DataFrame, number: str, size: int = 3000) -> DataFrame:
    """The latest events that a buffer of ``size`` still holds."""
    return events.orderBy(F.desc(number)).limit(size)


def throttled(events: DataFrame, key: str, time: str, order: str, seconds: float = 0.2, phase: str | None = None, last: str | None = None) -> DataFrame:
    """Events of a key that are ``seconds`` or more after the last one *sent*.

    A change of ``phase`` and a row where ``last`` is true are always sent.
    Equal times stand by ``order``, which is unique. Events between which the
    state can't matter (a wide gap, a new phase, a last one) begin runs; each
    run is a stream of its own with one number of state, so a key with a third
    of all events is many runs. Rows with null time are left out.
    """
    e = events.where(F.col(time).isNotNull()).withColumn("__t", F.col(time).cast("double"))
    now = F.struct("__t", (F.col(phase) if phase else F.lit(None).cast("string")).alias("p"))
    e = carried(e.withColumn("__now", now), [key], ["__t", order], "__now", "__was")
    fresh = F.col("__was").isNull() | (F.col("__t") - F.col("__was.__t") >= seconds) | ~F.col("__now.p").eqNullSafe(F.col("__was.p"))
    if last:
        fresh = fresh | F.coalesce(F.col(last), F.lit(False))
    e = e.withColumn("__run", F.when(fresh, F.struct("__t", F.col(order).alias("o")))).drop("__was", "__now")
    e = carried(e, [key], ["__t", order], "__run", "__open").withColumn("__start", F.coalesce("__run", "__open"))
    laid = e.withColumn("__first", F.col("__run").isNotNull()).drop("__run", "__open").repartition(key, "__start").sortWithinPartitions(key, "__start", "__t", order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0.0
        for batch in batches:
            keep = []
            for t, first in zip(batch.column("__t").to_pylist(), batch.column("__first").to_pylist()):
                send = first or t - sent >= seconds
                sent = t if send else sent
                keep.append(send)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return laid.mapInArrow(run, laid.schema).select(*events.columns)
