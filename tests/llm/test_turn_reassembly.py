from __future__ import annotations

import hashlib
import random

from varloom.llm.turn_reassembly import BATCHES, FEED, PATIENCE, deal, events, reassemble

SCHEMA = "conv_id long, turn long, role string, text string, batch string, first int, payload string"


def arrivals(rows):
    """{(batch, conv, turn): (payload, role)} of the smallest payloads, and {conv: first turn}."""
    out, first = {}, {}
    for conv, turn, role, text, *_ in rows:
        if turn is None:
            continue
        first[conv] = min(first.get(conv, turn), turn)
        h = int(hashlib.sha256(f"{'' if conv is None else conv}:{turn}".encode()).hexdigest()[:8], 16)
        for batch, r in [(h % 10, role or "")] + [((h + 5) % 10, "user")] * (h % 7 < 2):
            p = (f"{r}|{text or ''}", r)
            key = batch, conv, turn
            if key not in out or (p[0].encode(), p[1]) < (out[key][0].encode(), out[key][1]):
                out[key] = p
    return out, first


def brute(rows):
    """The feed played batch by batch."""
    came, first = arrivals(rows)
    made, state = [], {}
    for batch in range(BATCHES + 1):
        here = {}
        for (b, conv, turn), p in sorted(came.items(), key=str):
            if b == batch:
                here.setdefault(conv, []).append((turn, p))
        for conv, rs in here.items():
            s = state.setdefault(conv, {"kept": {}, "next": first[conv], "last": batch, "closed": False})
            if s["closed"]:
                made += [("reject", conv, t, batch, p[0], None, None) for t, p in rs]
                continue
            s["last"] = batch
            for t, p in rs:
                s["kept"].setdefault(t, p)
            while s["next"] in s["kept"]:
                made.append(("release", conv, s["next"], batch, s["kept"][s["next"]][0], None, None))
                s["next"] += 1
        for conv, s in state.items():
            if not s["closed"] and (batch - s["last"] >= PATIENCE or batch == BATCHES):
                s["closed"], kept = True, s["kept"]
                missing = max(kept) - first[conv] + 1 - len(kept)
                breaks = sum(t - 1 in kept and kept[t - 1][1] == kept[t][1] for t in kept)
                made.append(("close", conv, -1, batch, ",".join(str(t) for t in sorted(kept) if t >= s["next"]), missing, breaks))
    return made


def fixture():
    rng = random.Random(11)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randrange(1, 9)):
            if rng.random() < 0.85:
                row = (conv, turn + (conv or 0) % 3, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "Grüße|x", "ok" * 50]), "b", 9, "p")
                rows += [row] * rng.choice([1, 1, 1, 3])
                if rng.random() < 0.2:
                    rows.append((conv, row[1], "assistant", "other", "b", 9, "p"))
    return [*rows, (3, None, "user", "lost", "b", 9, "p"), (99, None, "user", "lost", "b", 9, "p"), (-5, -7, "user", "x" * 300_000, "b", 9, "p")]


def test_arrivals_equal_brute_force(spark):
    rows = fixture()
    came, first = arrivals(rows)
    got = {(r.batch, r.conv_id, r.turn): (r.payload, r.role, r.first) for r in deal(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {k: (*p, first[k[1]]) for k, p in came.items()}


def test_events_equal_the_feed_played_by_hand(spark):
    rows = fixture()
    got = [tuple(r) for r in reassemble(deal(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert {r[0] for r in got} == {"release", "reject", "close"}


def test_no_rows_give_no_events_and_settings_stay(spark):
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    assert reassemble(deal(spark.createDataFrame([], SCHEMA)), batches=1).collect() == []
    assert spark.conf.get(key) == before


def test_state_stores_are_closed_with_their_start(spark):
    """Else those of all starts stay in memory: two a start and shuffle partition."""
    kind = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    field = kind.getDeclaredField("loadedProviders")
    field.setAccessible(True)
    loaded = lambda: field.get(kind.getField("MODULE$").get(None)).size()
    before = loaded()
    got = reassemble(deal(spark.createDataFrame([(1, 0, "user", "hi", "b", 9, "p"), (1, 1, "user", "ho", "b", 9, "p")], SCHEMA), 1), batches=1).collect()
    assert {r.event for r in got} == {"release", "close"}
    assert loaded() <= before


def test_a_start_opens_one_store_a_partition(spark):
    """RocksDB's statistics of a store stay in an executor's memory after it is closed, so stores opened count."""
    names = [c.split() for c in FEED.split(", ")]
    feed = spark.readStream.format("rate").load().selectExpr(*[f"cast({'timestamp' if t == 'timestamp' else 'null'} as {t}) {c}" for c, t in names])
    plan = events(feed)._jdf.queryExecution().analyzed().toString()
    assert plan.count("TransformWithState") == 1


def test_repeats_of_waiting_and_released_turns(spark):
    """A turn that waits or is released is kept: what comes again only keeps its conversation open."""
    came = [(0, 1, 2, 0, "user", "user|c"), (0, 1, 0, 0, "user", "user|a"), (2, 1, 2, 0, "a", "a|late"), (2, 1, 0, 0, "a", "a|late"), (4, 1, 1, 0, "b", "b|b"), (9, 1, 2, 0, "user", "user|c")]
    got = [tuple(r) for r in reassemble(spark.createDataFrame(came, "batch int, conv_id long, turn long, first long, role string, payload string")).collect()]
    assert sorted(got, key=str) == sorted(
        [("release", 1, 0, 0, "user|a", None, None), ("release", 1, 1, 4, "b|b", None, None), ("release", 1, 2, 4, "user|c", None, None), ("close", 1, -1, 6, "", 0, 0), ("reject", 1, 2, 9, "user|c", None, None)], key=str
    )
