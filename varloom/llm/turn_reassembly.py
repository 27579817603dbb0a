"""Conversation turns put back into order by a stateful operator (operator 13).

Turns arrive in batches, late and repeated. deal() reduces a batch's copies of a turn by (batch, conversation,
turn), so copies never meet by conversation. The sequencer, keyed by conversation, keeps each turn's earliest
payload, releases the gapless run of kept turns, closes what PATIENCE batches in a row brought nothing to, and
rejects what comes after. What was kept is what lies before the run's end or waits, so repeats are known
without a state of their own. Event time is the number of the batch: a row of the feed itself moves the watermark on in every batch,
empty ones too, and timers close conversations that nothing arrives for. A timer fires in the batch after the
one that it closes in; its event bears the number of the closing batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

from varloom.llm.common import delete, shared_dir, table

BATCHES, PATIENCE, HOUR = 10, 2, 3_600_000

FEED = "batch int, at timestamp, tick boolean, conv_id long, turn long, first long, role string, payload string"
EVENT = "event string, conv_id long, turn long, batch int, payload string, n_missing long, n_breaks long"
Event = Row(*[c.split()[0] for c in EVENT.split(", ")])
OWN = ("first", "next", "last", "kept", "most", "breaks", "role", "waiting", "closed")
#: State lives in RocksDB and is written as changes; a start runs one micro-batch, so stores are closed with their
#: tasks: else those of all earlier starts (one a start and shuffle partition) stay in executors' memory.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class Sequencer(StatefulProcessor):
    """Keyed by conv_id. A call's rows are of one batch, as feed() gives them."""

    def __init__(self, patience: int = PATIENCE, batches: int = BATCHES):
        self.patience, self.batches = patience, batches

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.own = handle.getValueState("own", "first long, next long, last int, kept long, most long, breaks long, role string, waiting long, closed boolean")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, payload string")

    def _due(self, last: int) -> int:
        """The batch in which a conversation closes that has nothing after last; the end is a batch of its own."""
        return min(last + self.patience, self.batches)

    def _timer(self, last: int) -> int:
        return (self._due(last) + 1) * HOUR - 1

    def _closing(self, conv: int | None, s: dict) -> Row:
        turns, breaks = [], s["breaks"]
        if s["waiting"]:
            roles = {k[0]: v[0] for k, v in self.waiting.iterator()}
            turns = sorted(roles)
            breaks += sum(roles.get(t - 1) == roles[t] for t in turns if t - 1 in roles)
            self.waiting.clear()
        s |= {"closed": True, "waiting": 0}
        return Event("close", conv, -1, self._due(s["last"]), ",".join(map(str, turns)), s["most"] - s["first"] + 1 - s["kept"], breaks)

    def _save(self, s: dict) -> None:
        self.own.update(tuple(s[k] for k in OWN))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        s, batch, conv = None, None, None
        for r in rows:
            if batch is None:
                batch, conv = r.batch, r.conv_id
                found = self.own.get()
                s = dict(zip(OWN, found or (r.first, r.first, None, 0, r.first, 0, None, 0, False), strict=True))
                if not s["closed"] and s["last"] is not None:
                    self.handle.deleteTimer(self._timer(s["last"]))
                    if batch > self._due(s["last"]):
                        yield self._closing(conv, s)
                if not s["closed"]:
                    s["last"] = batch
            if r.batch != batch:
                raise ValueError("a micro-batch holds rows of one batch")
            if s["closed"]:
                yield Event("reject", conv, r.turn, batch, r.payload, None, None)
            elif r.turn >= s["next"] and not (s["waiting"] and self.waiting.containsKey((r.turn,))):
                s["kept"], s["most"] = s["kept"] + 1, max(s["most"], r.turn)
                if r.turn == s["next"]:
                    yield self._released(conv, s, batch, r.role, r.payload)
                else:
                    self.waiting.updateValue((r.turn,), (r.role, r.payload))
                    s["waiting"] += 1
        if s is None:
            return
        while not s["closed"] and s["waiting"] and (v := self.waiting.getValue((s["next"],))):
            self.waiting.removeKey((s["next"],))
            s["waiting"] -= 1
            yield self._released(conv, s, batch, v[0], v[1])
        if not s["closed"]:
            self.handle.registerTimer(self._timer(batch))
        self._save(s)

    @staticmethod
    def _released(conv: int | None, s: dict, batch: int, role: str, payload: str) -> Row:
        turn = s["next"]
        s["breaks"] += turn > s["first"] and role == s["role"]
        s |= {"next": turn + 1, "role": role}
        return Event("release", conv, turn, batch, payload, None, None)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        s = dict(zip(OWN, self.own.get(), strict=True))
        if not s["closed"] and expiredTimerInfo.getExpiryTimeInMs() == self._timer(s["last"]):
            yield self._closing(key[0], s)
            self._save(s)

    def close(self) -> None:
        pass


def deal(turns: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Rows (conv_id, turn, role, text) to arrivals batch, conv_id, turn, first, role, payload: of each turn
    the smallest payload of a batch. Where a turn comes back, its copy's role is ``user``. Null turns are
    dropped, null roles and texts are empty; a null conversation is one of its own, written as nothing."""
    t = turns.where("turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = t.groupBy("conv_id").agg(F.min("turn").alias("first")).withColumnRenamed("conv_id", "_conv")
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("turn").cast("string"))
    t = t.withColumn("h", F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long"))
    once = F.struct((F.col("h") % batches).cast("int").alias("batch"), F.col("role").alias("role"))
    again = F.struct(((F.col("h") + 5) % batches).cast("int").alias("batch"), F.lit("user").alias("role"))
    rows = t.select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once))).alias("x"))
    rows = rows.select("conv_id", "turn", "x.batch", F.struct(F.concat_ws("|", "x.role", "text").alias("payload"), F.col("x.role").alias("role")).alias("p"))
    least = rows.groupBy("batch", "conv_id", "turn").agg(F.min("p").alias("p"))
    return least.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("batch", "conv_id", "turn", "first", "p.role", "p.payload")


def events(feed: DataFrame, patience: int = PATIENCE, batches: int = BATCHES) -> DataFrame:
    """The stateful operator over a stream of FEED rows. One: an executor's memory keeps 0.6 MB of every store opened."""
    real = feed.withWatermark("at", "0 seconds").where("not (tick and at is not null)")  # above the watermark: ticks move it
    return real.groupBy("conv_id").transformWithState(Sequencer(patience, batches), EVENT, "Append", "EventTime")


def reassemble(arrivals: DataFrame, patience: int = PATIENCE, batches: int = BATCHES) -> DataFrame:
    """event, conv_id, turn, batch, payload, n_missing, n_breaks of arrivals as deal() gives them.

    ``release`` and ``reject`` have the payload of the turn, ``close`` (turn -1) the numbers of kept turns
    that were not released, comma-joined, the number of turns between the first and the last kept one that
    never came, and of kept turns with the role of the turn before. Batches are fed in order; the query is
    started anew for each on one checkpoint, in a folder of its own under the shared one. The batch after
    the last, ``batches``, closes what is open. No rows: no events.
    """
    spark = arrivals.sparkSession
    folder = f"{shared_dir(spark)}/turns-{uuid.uuid4().hex}"
    ticks = spark.range(batches + 1).select(F.col("id").cast("int").alias("batch"), F.lit(True).alias("tick"))
    # a watermark starts at 0; the last batch's tick goes on to the end, so that the next start closes what is open
    end = F.col("tick") & (F.col("batch") >= batches - 1)
    at = F.timestamp_millis(F.when(end, batches + 1).otherwise(F.col("batch") + 1).cast("long") * HOUR).alias("at")
    rows = arrivals.withColumn("tick", F.lit(False)).unionByName(ticks, allowMissingColumns=True)
    rows = rows.select("batch", at, "tick", "conv_id", "turn", "first", "role", "payload", F.col("batch").alias("b"))
    rows.hint("rebalance", "b").write.partitionBy("b").parquet(f"{folder}/dealt")
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{folder}/feed"))
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        for b in range(batches + 1):
            files.rename(path(f"{folder}/dealt/b={b}"), path(f"{folder}/feed/{b}"))
            feed = spark.readStream.schema(FEED).option("recursiveFileLookup", True).parquet(f"{folder}/feed")
            run = events(feed, patience, batches).writeStream.format("parquet").option("path", f"{folder}/events").option("checkpointLocation", f"{folder}/state")
            run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    for done in ("dealt", "feed", "state"):
        delete(spark, f"{folder}/{done}")
    return spark.read.schema(EVENT).parquet(f"{folder}/events")


def op13_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reassemble() of all conversations in ten batches, payloads as SHA-256; nulls, ties and repeats as in deal()."""
    made = reassemble(deal(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return made.select("event", "conv_id", "turn", F.col("batch").cast("long").alias("batch"), F.sha2("payload", 256).alias("sha256"), "n_missing", "n_breaks")


SQL = {
    "op13_turn_reassembly": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, ('0x' || sha256(coalesce(conv_id::VARCHAR, '') || ':' || turn)[1:8])::BIGINT AS h, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations WHERE turn IS NOT NULL),
c AS (SELECT conv_id, turn, first, h % {BATCHES} AS batch, role, role || '|' || text AS payload FROM t UNION ALL SELECT conv_id, turn, first, (h + 5) % {BATCHES}, 'user', 'user|' || text FROM t WHERE h % 7 < 2),
a AS (SELECT conv_id, turn, first, batch, payload, role FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, turn, batch ORDER BY encode(payload), role) = 1),
b AS (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS later FROM (SELECT DISTINCT conv_id, batch FROM a)),
e AS (SELECT conv_id, least(min(batch) + {PATIENCE}, {BATCHES}) AS due FROM b WHERE later IS NULL OR later > batch + {PATIENCE} GROUP BY conv_id),
j AS (SELECT a.*, due, batch > due AS late FROM a JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id),
k AS (SELECT * FROM j WHERE NOT late QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY batch) = 1),
r AS (SELECT *, turn - first + 1 = row_number() OVER w AS run, max(batch) OVER w AS seen, lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role AS broke FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT 'release' AS event, conv_id, turn, seen AS batch, sha256(payload) AS sha256, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM r WHERE run
UNION ALL SELECT 'reject', conv_id, turn, batch, sha256(payload), NULL, NULL FROM j WHERE late
UNION ALL SELECT 'close', conv_id, -1, any_value(due), sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT run), '')), max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (WHERE coalesce(broke, false)) FROM r GROUP BY conv_id""",
}
QUERIES = {"op13_turn_reassembly": op13_turn_reassembly}
