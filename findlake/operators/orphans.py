"""References to records that do not exist: a keyed orphan state maintained over one event log.

Parents arrive (+1) and are deleted (-1); references probe. Per key, events are folded in time order (at one
instant: arrivals, deletions, then probes), and the state is (parents alive, earliest arrival so far, any arrival
at all). A probe that finds no parent alive is an orphan: `deleted` if one had arrived, `late` if all arrive after
it, `missing` if none ever does. Pending orphans are resolved by an arriving parent and reopened when the last one
is deleted; `snapshots` counts those that are open at the end of each month.

The fold is incremental: it runs in chunks of one key and period, and a chunk starts from the state carried over
from the key's earlier chunks. For most keys the one chunk is all of its time. Every key with more than `hot` events
(there are at most events/hot of them) is folded in periods that are the shorter the more events it has, down to a
second, so no task holds all events of a hot key; the carried state is aggregated before the shuffle. Which keys are hot is
joined, never collected.

Defined cases: a reference with a null or blank key or a null time is none; a parent with a null key or arrival
never arrives; one that is deleted at or before its arrival arrives but is never alive. Repeated rows are counted as
they come. Empty tables give an empty result, an empty parent table makes every reference `missing`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findlake.session import bounded, written

#: A key with more events than this is folded period by period.
HOT = 200_000
#: Batches that a log is followed in.
BATCHES = 2
#: Fixed value: the digits that a shortened hash has at least.
WIDTH = 12


def hash_key(col: Column) -> Column:
    """A commit hash without URL, case, blanks and separators; null for a blank one."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(col), r"^.*[/#:@=](?=[^/#:@=]*\w)", ""), r"[^0-9a-z]+", "")
    return F.when(bare != "", bare)


def cve_key(col: Column) -> Column:
    """A CVE id without case, blanks and separators; null for a blank one."""
    bare = F.regexp_replace(F.upper(col), r"[^0-9A-Z]+", "")
    return F.when(bare != "", bare)


def parent_events(parents: DataFrame, key: Column, arrived: Column, gone: Column) -> DataFrame:
    """key, at, kind, n: an arrival (kind 0) and, if it is deleted later, a deletion (kind 1) per parent."""
    alive = F.coalesce(gone > arrived, F.lit(True))
    rows = parents.select(key.alias("key"), arrived.alias("arrived"), gone.alias("gone"), alive.alias("alive")).where(F.col("key").isNotNull() & F.col("arrived").isNotNull())
    log = F.array(
        F.struct(F.col("arrived").alias("at"), F.lit(0).alias("kind"), F.col("alive").cast("int").alias("n")),
        F.struct(F.col("gone").alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("n")),
    )
    return rows.select("key", F.inline(log), "alive").where((F.col("kind") == 0) | (F.col("alive") & F.col("at").isNotNull())).drop("alive")


def probes(refs: DataFrame, row: Column, key: Column, at: Column) -> DataFrame:
    return refs.select(row.alias("row"), key.alias("key"), at.alias("at")).where(F.col("key").isNotNull() & F.col("at").isNotNull())


def short_parent_events(events: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """The events of the parents that each shortened key begins, under the shortened key.

    keys(key): distinct keys of `width` characters or more that may be beginnings; joined on the first `width`."""
    begin = keys.select(F.col("key").alias("short"), F.substring("key", 1, width).alias("_b"))
    long = events.withColumn("_b", F.substring("key", 1, width))
    return long.join(begin, "_b").where(F.col("key").startswith(F.col("short")) & (F.col("key") != F.col("short"))).select(F.col("short").alias("key"), "at", "kind", "n")


def resolved(keys: DataFrame, known: DataFrame, width: int = WIDTH) -> DataFrame:
    """key, whole: each key with the known keys that it is or, having at least `width` characters, begins; others give no row."""
    begin = keys.select("key", F.substring("key", 1, width).alias("_b")).where(F.length("key") >= width).distinct()
    long = known.select(F.col("key").alias("whole"), F.substring("key", 1, width).alias("_b")).distinct()
    return begin.join(long, "_b").where(F.col("whole").startswith(F.col("key"))).select("key", "whole")


def _log(events: DataFrame, refs: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """The event log with the chunk of each event (0, or the day for hot keys); whether any key is hot."""
    log = events.select("key", "at", "kind", "n", F.lit(None).cast("long").alias("row")).unionByName(
        refs.select("key", "at", F.lit(2).alias("kind"), F.lit(0).alias("n"), "row")
    )
    return _chunked(log, hot)


def _chunked(log: DataFrame, hot: int) -> tuple[DataFrame, bool]:
    """The log with the chunk of each event; whether any key is hot. A hot key's time is cut into twice as many equal
    periods as it has times `hot` events, of a second at least."""
    second = F.unix_micros(F.col("at").cast("timestamp")) / 1_000_000
    counts = log.groupBy("key").agg(F.count("*").alias("c"), F.min(second).alias("from"), F.max(second).alias("to")).where(F.col("c") > hot)
    counts = written(counts.select("key", "from", F.greatest((F.col("to") - F.col("from")) * hot / (2 * F.col("c")), F.lit(1.0)).alias("period")), "hot")
    if not counts.limit(1).count():
        return log.withColumn("chunk", F.lit(0).cast("long")), False
    chunk = F.coalesce(F.floor((second - F.col("from")) / F.col("period")), F.lit(0))
    return log.join(bounded(counts), "key", "left").withColumn("chunk", chunk).drop("from", "period"), True


def _folded(log: DataFrame, chunked: bool, ever: bool = True) -> DataFrame:
    """The log with the state each event finds: alive, arrived (earliest so far), ever (earliest at all, if it is asked for)."""
    order = Window.partitionBy("key", "chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    arrival = F.when(F.col("kind") == 0, F.col("at"))
    own = log.withColumns({"alive": F.sum("n").over(order), "arrived": F.min(arrival).over(order)})
    if not chunked and not ever:
        return own
    if not chunked:
        whole = Window.partitionBy("key", "chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return own.withColumn("ever", F.min(arrival).over(whole))
    chunks = log.groupBy("key", "chunk").agg(F.sum("n").alias("net"), F.min(arrival).alias("first"))
    before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = chunks.select("key", "chunk", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("alive0"), F.min("first").over(before).alias("arrived0"), F.min("first").over(everything).alias("ever"))
    return own.join(carried, ["key", "chunk"]).withColumns({"alive": F.col("alive") + F.col("alive0"), "arrived": F.least("arrived", "arrived0")})


def orphans(events: DataFrame, refs: DataFrame, hot: int = HOT) -> DataFrame:
    """row, at, orphan_kind of each reference that finds no parent at its time. See the module's docstring."""
    folded = _folded(*_log(events, refs, hot))
    kind = F.when(F.col("ever").isNull(), "missing").when(F.col("arrived").isNotNull(), "deleted").otherwise("late")
    return folded.where((F.col("kind") == 2) & (F.col("alive") <= 0)).select("row", "at", kind.alias("orphan_kind"))


def snapshots(events: DataFrame, refs: DataFrame, hot: int = HOT) -> DataFrame:
    """month, open_orphans, opened, resolved: the state at the end of each month in which something changed.

    A reference is open from its probe, and whenever its key has no parent alive; arriving parents resolve the key's
    waiting references, deletions of the last parent reopen them. Only the changes are aggregated. The state before a
    chunk of a hot key (see the module's docstring) is summed over the chunks before it."""
    log = events.select("key", "at", "kind", "n").unionByName(refs.select("key", "at", F.lit(2).alias("kind"), F.lit(0).alias("n")))
    per_time = log.groupBy("key", "at").agg(F.sum("n").alias("n"), F.count_if(F.col("kind") == 2).alias("refs"))
    parts, chunked = _chunked(per_time, hot)
    order = Window.partitionBy("key", "chunk").orderBy("at")
    state = parts.withColumns({"alive": F.sum("n").over(order), "all": F.sum("refs").over(order)})
    if chunked:
        before = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        sums = parts.groupBy("key", "chunk").agg(F.sum("n").alias("n"), F.sum("refs").alias("refs"))
        zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
        state = state.join(sums.select("key", "chunk", zero("n").alias("n0"), zero("refs").alias("refs0")), ["key", "chunk"])
        state = state.withColumns({"alive": F.col("alive") + F.col("n0"), "all": F.col("all") + F.col("refs0")})
    open_now = F.when(F.col("alive") <= 0, F.col("all")).otherwise(F.lit(0))
    open_before = F.when(F.col("alive") - F.col("n") <= 0, F.col("all") - F.col("refs")).otherwise(F.lit(0))
    change = state.withColumn("delta", open_now - open_before).where("delta <> 0")
    months = change.groupBy(F.date_format("at", "yyyy-MM").alias("month")).agg(
        F.sum("delta").alias("net"), F.sum(F.greatest("delta", F.lit(0))).alias("opened"), F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("resolved")
    )
    return months.select("month", F.sum("net").over(Window.orderBy("month")).alias("open_orphans"), "opened", "resolved")


STATE = "key string, alive long, arrived timestamp_ntz, n_refs long"


def advance(state: DataFrame, events: DataFrame, refs: DataFrame, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(new state, found) after one batch of the log, in which nothing is older than in the batches before.

    state(STATE): parents alive, earliest arrival and references so far, per key. found(row, key, at, had): references
    that find no parent alive, and whether one had arrived. A key that the batch doesn't touch keeps its state. Hot keys of
    the batch are folded in periods (see the module's docstring)."""
    return _advance(state, *_log(events, refs, hot))


def _advance(state: DataFrame, log: DataFrame, chunked: bool) -> tuple[DataFrame, DataFrame]:
    own = _folded(log, chunked, ever=False).withColumnsRenamed({"alive": "_alive", "arrived": "_arrived"})
    met = own.where("kind = 2").join(state.select("key", "alive", "arrived"), "key", "left")
    alive = F.col("_alive") + F.coalesce("alive", F.lit(0))
    found = met.where(alive <= 0).select("row", "key", "at", (F.col("_arrived").isNotNull() | F.col("arrived").isNotNull()).alias("had"))
    batch = log.groupBy("key").agg(F.sum("n").alias("_n"), F.min(F.when(F.col("kind") == 0, F.col("at"))).alias("_first"), F.count_if(F.col("kind") == 2).alias("_refs"))
    zero = F.lit(0).cast("long")
    new = state.join(batch, "key", "full").select(
        "key", (F.coalesce("alive", zero) + F.coalesce("_n", zero)).alias("alive"), F.least("arrived", "_first").alias("arrived"),
        (F.coalesce("n_refs", zero) + F.coalesce("_refs", zero)).alias("n_refs"),
    )
    return new, found


def followed(events: DataFrame, refs: DataFrame, hot: int = HOT, batches: int = BATCHES) -> DataFrame:
    """row, at, orphan_kind: the same as `orphans`, in batches of about as many events each, one after the other in time. A
    batch reads the state that the one before has left; what is found is settled by the last state. The log is written
    once; the times between batches (approximate quantiles) are all that is collected."""
    spark = events.sparkSession
    log = events.select("key", "at", "kind", "n", F.lit(None).cast("long").alias("row")).unionByName(refs.select("key", "at", F.lit(2).alias("kind"), F.lit(0).alias("n"), "row"))
    log, chunked = _chunked(written(log, "log"), hot)
    cuts = log.agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), [k / batches for k in range(1, batches)])).first()[0] if batches > 1 else []
    times = [None, *sorted(set(cuts or [])), None]
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    state = spark.createDataFrame([], STATE)
    found = spark.createDataFrame([], "row long, key string, at timestamp_ntz, had boolean")
    for since, until in zip(times, times[1:]):
        batch = log if since is None else log.where(micros > since)
        batch = batch if until is None else batch.where(micros <= until)
        new, here = _advance(state, batch, chunked)
        found = found.unionByName(written(here, "found"))
        state = written(new, "state")
    return settle(found, state)


def settle(found: DataFrame, state: DataFrame) -> DataFrame:
    """row, at, orphan_kind of found orphans by what has become known since: late, if a parent has arrived meanwhile."""
    kind = F.when(F.col("had"), "deleted").when(F.col("arrived").isNotNull(), "late").otherwise("missing")
    return found.join(state.select("key", "arrived"), "key", "left").select("row", "at", kind.alias("orphan_kind"))


def open_count(state: DataFrame) -> DataFrame:
    """open_orphans: references whose key has no parent alive now; arrivals have resolved, deletions reopened them."""
    return state.agg(F.coalesce(F.sum(F.when(F.col("alive") <= 0, F.col("n_refs"))), F.lit(0)).alias("open_orphans"))
