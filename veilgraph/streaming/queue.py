"""Work queue: places, waiting times, retries of the same request, sessions of peers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans import ranks


def places(waiting: DataFrame, queue: str, order: list[str]) -> DataFrame:
    """Adds `ahead`: how many stand before a row of its queue. No task holds a whole queue."""
    return ranks.places(waiting, [queue], order, "ahead")


def waiting_times(placed: DataFrame, averages: DataFrame, queue: str) -> DataFrame:
    """Adds eta_s = (ahead + 1) * the queue's average, null where it has none yet."""
    return placed.join(averages.select(queue, F.col("average")), queue, "left").withColumn("eta_s", F.round((F.col("ahead") + 1) * F.col("average"), 6)).drop("average")


def gateway_eta(busy, ahead, alive, average):
    """Rounds of work before a new request, times the average: null with no live engine."""
    return F.when(alive > 0, (F.floor((busy + ahead) / alive) + 1) * average)


def retries(requests: DataFrame, keep_s: int = 30) -> DataFrame:
    """(ticket, ts, fingerprint) -> `first`, `joined` (same ticket and content within keep_s) or `conflict`."""
    order = Window.partitionBy("ticket").orderBy("ts", "fingerprint")
    last = F.lag("ts").over(order)
    opens = F.when(last.isNull() | (F.unix_micros(F.col("ts")) - F.unix_micros(last) > keep_s * 1_000_000), 1).otherwise(0)
    grouped = requests.withColumn("opens", opens).withColumn("episode", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first("fingerprint").over(Window.partitionBy("ticket", "episode").orderBy("ts", "fingerprint").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return grouped.withColumn("outcome", F.when(F.col("opens") == 1, "first").when(F.col("fingerprint") == first, "joined").otherwise("conflict")).drop("opens", "episode")


def sessions(events: DataFrame, peer: str, ts: str, gap: str) -> DataFrame:
    """Sessions end after a silence of `gap`: works on tables and, with a watermark, on streams."""
    window = F.session_window(ts, gap)
    return events.groupBy(peer, window.alias("w")).agg(F.count(F.lit(1)).alias("events")).select(peer, F.col("w.start").alias("started"), "events")


def deduplicated_stream(requests: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """First request of each (ticket, fingerprint) on a stream; state is dropped behind the watermark."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ticket", "fingerprint"])


def health(polls: DataFrame) -> DataFrame:
    """(engine, at, outcome) -> adds `up`: an answer brings an engine up; a refusal takes it down at once, slowness after
    two in a row. Outcomes: ok, slow, refused; an engine is up before its first poll."""
    order = Window.partitionBy("engine").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = polls.withColumn("_run", F.sum((F.col("outcome") == "ok").cast("int")).over(order))
    since = Window.partitionBy("engine", "_run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    bad = lambda kind: F.sum((F.col("outcome") == kind).cast("int")).over(since)
    return runs.withColumn("up", (bad("refused") == 0) & (bad("slow") < 2)).drop("_run")


def candidates(jobs: DataFrame, engines: DataFrame) -> DataFrame:
    """(job, engine): the first engine in order (ready ones first) that is up, free and can do the job; null if none.

    jobs: job, needs (null: any); engines: engine, place, up, busy, ready, judges.
    """
    free = engines.where("up and not busy").select("engine", "place", "ready", "judges")
    can = F.col("needs").isNull() | F.array_contains("judges", F.col("needs"))
    best = jobs.join(F.broadcast(free), can).groupBy("job").agg(F.min_by("engine", F.struct((~F.col("ready")).cast("int"), "place")).alias("engine"))
    return jobs.select("job").join(best, "job", "left")


def needs(body):
    """The provider that a job needs: that of its judge settings where no key came along; null: any engine will do."""
    provider, key = F.get_json_object(body, "$.provider"), F.get_json_object(body, "$.key")
    return F.when((F.coalesce(F.trim(key), F.lit("")) == "") & (F.coalesce(provider, F.lit("")) != ""), provider)


def waiting_totals(jobs: DataFrame) -> DataFrame:
    """(queue, place, total) -> adds `wait`: the totals of all jobs ahead and its own; unknown behind an unknown one."""
    upto = Window.partitionBy("queue").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    unknown = F.sum(F.col("total").isNull().cast("int")).over(upto)
    return jobs.withColumn("wait", F.when(unknown == 0, F.sum("total").over(upto)))


def expired(tickets: DataFrame, now, keep_s: float = 60.0, most: int = 200) -> DataFrame:
    """Tickets (ticket, ended, added) that go: ended over keep_s ago, or all but the newest `most`."""
    newest = tickets.orderBy(F.desc("added"), F.desc("ticket")).limit(most).select("ticket", F.lit(True).alias("_kept"))
    old = F.coalesce(F.col("ended") < now - F.lit(keep_s), F.lit(False))
    return tickets.join(newest, "ticket", "left").where(old | F.col("_kept").isNull()).select("ticket")


def changes(states: DataFrame, every_s: float = 1.0) -> DataFrame:
    """(ticket, at, state) -> rows that a feed sends: a ticket's first, every change, and one a second of quiet time."""
    order = Window.partitionBy("ticket").orderBy("at")
    before, at = F.lag("state").over(order), F.lag("at").over(order)
    return states.withColumn("_send", before.isNull() | (before != F.col("state")) | (F.col("at") - at >= every_s)).where("_send").drop("_send")
