"""Streams with keyed state: progress reports with cancels, and tokens one at a time."""

import numpy as np
import pytest

from tessera.operators import generate, logits
from tessera.streaming import progress, tokens

SCHEMA = "key long, ts double, completed long, total long, complete boolean"
EVENTS = SCHEMA + ", cancel boolean"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def until(query, done, seconds=90):
    """Waits for rows, as timers keep a query busy after its input ends."""
    for _ in range(seconds * 2):
        if done() or query.exception():
            break
        query.awaitTermination(0.5)
    assert query.exception() is None, query.exception()
    assert done()


# Transfers


def simulated(events):
    """Reports of one transfer's events in order of time, as the survey words the rule; written beside the machine, not from it."""
    out, reported, bytes_at, bytes_then, stall_at, over, latest, started = [], 0.0, None, 0, None, False, None, False
    for ts, completed, total, complete, cancel in events:
        if over:
            continue
        if cancel:
            over = True
            if latest is None or latest[1] <= 0 or latest[0] < latest[1]:
                continue
            completed, total, complete = *latest, True
        if not started:
            started, bytes_at = True, ts
        latest = (completed, total)
        share = min(max(completed / total, 0), 1) if total > 0 else (1.0 if complete else 0.0)
        over = over or complete
        if share == 1 and not complete:
            continue
        more = completed - bytes_then
        stalls = bytes_then > 0 and more == 0 and ts - (bytes_at if stall_at is None else stall_at) >= 1
        if more == 0 and abs(share - reported) < 0.001 and not complete and not stalls:
            continue
        out.append((ts, share, (more / (ts - bytes_at) if ts > bytes_at else 0.0) if more > 0 else None))
        if more > 0:
            bytes_then, bytes_at, stall_at = completed, ts, None
        elif stalls and abs(share - reported) < 0.001 and not complete:
            stall_at = ts
        reported = share
    return out


def random_events(seed, keys):
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(keys):
        ts, done, total = 0.0, 0, int(rng.integers(1, 400)) * int(rng.choice([1, 100]))
        for _ in range(int(rng.integers(1, 25))):
            ts = round(ts + float(rng.choice([0.1, 0.4, 0.7, 2.5])), 1)
            done = int(max(0, done + rng.choice([0, 0, 0, 0, 1, 40, -5])))
            total += int(rng.choice([0, 0, 7]))
            kind = rng.random()
            rows.append((key, ts, done, total, kind < 0.05, kind > 0.96))
    return rows


def expected(rows):
    of = {}
    for key, *event in rows:
        of.setdefault(key, []).append(event)
    return sorted((k, *r) for k, events in of.items() for r in simulated(sorted(events, key=lambda e: (e[0], e[4], e[1], e[3]))))


def same(found, wanted):
    found = sorted(map(tuple, found))
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert [r[2:] for r in found] == [pytest.approx(r[2:]) for r in wanted]


def test_reports_by_simulation(spark):
    rows = random_events(9, 150)
    wanted = expected(rows)
    assert len(wanted) > 300
    same(progress.reports(spark.createDataFrame(rows, EVENTS)).collect(), wanted)
    plain = spark.createDataFrame([r[:5] for r in rows if not r[5]], SCHEMA)
    cancels = spark.createDataFrame([r[:2] for r in rows if r[5]], "key long, ts double")
    same(progress.reports(plain, cancels=cancels).collect(), wanted)
    assert progress.reports(spark.createDataFrame([], SCHEMA)).count() == 0


def followed(samples):
    machine, out = progress.Transfer(), []
    for s in samples:
        machine, report = machine.sample(*s)
        out.append(report)
    return out


def test_slow_drift_and_heartbeats():
    # the fraction moves by less than 0.001 each time: what counts is the one last reported
    drift = [(float(i) / 10, 1000, 10_000 + 60 * i) for i in range(6)]
    assert [r and round(r[1], 5) for r in followed(drift)] == [0.1, None, 0.09881, None, 0.09766, None]
    # a stall's report comes a second after bytes grew, the next a second after that report
    quiet = [(0.1, 5, 10), (1.0, 5, 10), (1.95, 5, 10), (2.15, 5, 10), (2.94, 5, 10), (2.96, 5, 10), (3.5, 5, 10)]
    assert [r and r[0] for r in followed(quiet)] == [0.1, None, 1.95, None, None, 2.96, None]
    samples = [(0.0, 0, 100), (1.0, 10, 100), (1.5, 10, 100), (2.0, 10, 100), (3.0, 10, 100), (4.0, 60, 100), (5.0, 100, 100), (5.0, 100, 100, True), (9.0, 100, 100, True)]
    assert [r and r[1:] for r in followed(samples)] == [None, (0.1, 10.0), None, (0.1, None), (0.1, None), (0.6, 50 / 3), None, (1.0, 40.0), None]
    assert followed([(0.0, 0, 0), (9.0, 0, 0), (10.0, 0, 0)]) == [None] * 3  # no bytes yet, no stall
    assert followed([(0.0, 0, 0, True)]) == [(0.0, 1.0, None)]


def test_changes_and_cancels(spark):
    samples = [(1, 0.0, 0, 100, False), (1, 1.0, 10, 100, False), (1, 1.5, 10, 100, False), (2, 0.0, 5, 10, False), (2, 1.0, 10, 10, True)]
    df = spark.createDataFrame(samples, SCHEMA)
    assert sorted((r.key, r.delta, r.speed) for r in progress.changes(df).collect()) == [(1, 10, 10.0), (2, 5, 0.0), (2, 5, 5.0)]
    samples = [(1, 0.0, 5, 10, False), (1, 1.0, 10, 10, False), (2, 0.0, 5, 10, False), (2, 3.0, 10, 10, True), (3, 0.0, 10, 10, True), (4, 0.0, 10, 10, False)]
    cancels = spark.createDataFrame([(1, 2.0), (1, 9.0), (2, 2.0), (3, 2.0), (9, 1.0)], "key long, ts double")
    found = progress.reports(spark.createDataFrame(samples, SCHEMA), cancels=cancels).collect()
    assert sorted((r.key, r.ts, r.fraction) for r in found) == [(1, 0.0, 0.5), (1, 2.0, 1.0), (2, 0.0, 0.5), (3, 0.0, 1.0)]


def test_stream_gives_the_batch(spark, tmp_path):
    """Samples and cancels in three micro-batches by time; ended transfers keep neither timers nor state but a mark."""
    rows = random_events(4, 40)
    limits = [(0, 4), (4, 9), (9, 1e9)]
    for i, (a, b) in enumerate(limits):
        spark.createDataFrame([r for r in rows if a <= r[1] < b], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = progress.stream_reports(stream, clock=False).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        wanted = expected(rows)
        until(query, lambda: spark.table("batches").count() >= len(wanted))
        same(spark.table("batches").collect(), wanted)
    finally:
        query.stop()


def test_stalls_by_the_clock(spark, tmp_path):
    """Without samples an open transfer reports a stall each second from its one timer; one that is cancelled is silent."""
    spark.createDataFrame([(1, 0.0, 5, 10, False, False), (2, 0.0, 5, 10, False, False), (2, 1.0, 0, 0, False, True)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = progress.stream_reports(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("stalls").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        until(query, lambda: spark.sql("SELECT * FROM stalls WHERE key = 1 AND ts > 1000").count() >= 3)
        beats = sorted(r.ts for r in spark.sql("SELECT ts FROM stalls WHERE key = 1 AND ts > 1000").collect())
        assert min(b - a for a, b in zip(beats, beats[1:], strict=False)) >= 1
        assert spark.sql("SELECT * FROM stalls WHERE key = 2 AND ts > 1").count() == 0
    finally:
        query.stop()
    timers = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("readRegisteredTimers", True).load()
    assert [r.key.key for r in timers.collect()] == [1]


# Tokens


class Sums:
    """Scores depend on the order of all tokens, through entries of every place."""

    def step(self, token, past):
        weights = past[:, 0] if len(past) else np.zeros(0)
        total = float(np.sum(weights * (np.arange(len(weights)) + 1)) + token * 3 + len(weights))
        return np.cos(np.arange(11) * (total + 1)), np.array([float(token), total])


PROMPTS = [(1, [3, 1, 4]), (2, [2]), (3, [5, 9]), (4, [6, 2, 6, 4])]
PROMPT = "seq_id long, ids array<long>"


def in_batch(spark, config, seed=0, prompts=PROMPTS):
    rows = generate.generate(spark.createDataFrame(prompts, PROMPT), tokens.cached_scores(Sums()), config, seed=seed, every_step=True).collect()
    return sorted((r.seq_id, r.step, list(r.ids)) for r in rows)


@pytest.mark.parametrize("sample", [False, True])
def test_sequences_advance_side_by_side(spark, tmp_path, sample):
    config = logits.GenerationConfig(max_new_tokens=4, max_length=50, do_sample=sample, top_k=6)
    spark.createDataFrame(PROMPTS, PROMPT).coalesce(1).write.parquet(f"{tmp_path}/in")
    wanted = in_batch(spark, config, seed=7)
    batches = []
    model = Sums() if sample else tokens.cached_scores(Sums())
    query = tokens.stream_tokens(spark.readStream.schema(PROMPT).parquet(f"{tmp_path}/in"), model, config, lambda df, n: batches.append(df.collect()), checkpoint=f"{tmp_path}/c", seed=7)
    try:
        until(query, lambda: sum(map(len, batches)) >= len(wanted))
    finally:
        query.stop()
    assert sorted((r.seq_id, r.step, list(r.ids)) for b in batches for r in b) == wanted
    assert all(r.token_id == r.ids[-1] for b in batches for r in b)
    steps = [{r.step for r in b} for b in batches if b]
    assert steps == [{1}, {2}, {3}, {4}]  # the first of all before the second of any


def test_a_lost_query_goes_on(spark, tmp_path):
    config = logits.GenerationConfig(max_new_tokens=5, max_length=50)
    spark.createDataFrame(PROMPTS, PROMPT).coalesce(1).write.parquet(f"{tmp_path}/in")
    wanted = in_batch(spark, config)
    found = []

    def start(sink):
        return tokens.stream_tokens(spark.readStream.schema(PROMPT).parquet(f"{tmp_path}/in"), Sums(), config, sink, checkpoint=f"{tmp_path}/c")

    def failing(df, n):
        rows = df.collect()
        if any(r.step == 3 for r in rows):
            raise RuntimeError("lost")
        found.extend(rows)

    query = start(failing)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination(120)
    assert {r.step for r in found} == {1, 2}
    query = start(lambda df, n: found.extend(df.collect()))
    try:
        until(query, lambda: len(found) >= len(wanted))
    finally:
        query.stop()
    assert sorted((r.seq_id, r.step, list(r.ids)) for r in found) == wanted
    state = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "about")
    assert {r.key.seq_id for r in state.load().collect()} <= {1, 2, 3, 4}


def test_prompts_in_parts(spark, tmp_path):
    """A sequence over three micro-batches, one that is resumed from a table, and one whose end never comes, which is forgotten."""
    config = logits.GenerationConfig(max_new_tokens=3, max_length=50)
    parts = "seq_id long, part int, ids array<long>, last boolean"
    rows = [[(1, 0, [3], False), (9, 0, [1], False)], [(1, 1, [1], False)], [(1, 2, [4], True)]]
    for i, r in enumerate(rows):
        spark.createDataFrame(r, parts).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    found = []
    stream = spark.readStream.schema(parts).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    resumed = spark.createDataFrame([(4, [6, 2, 6, 4])], PROMPT)
    query = tokens.stream_tokens(stream, Sums(), config, lambda df, n: found.extend(df.collect()), checkpoint=f"{tmp_path}/c", resumed=resumed, forget_ms=15_000)
    wanted = [r for r in in_batch(spark, config) if r[0] in (1, 4)]
    try:
        until(query, lambda: len(found) >= len(wanted))
        assert sorted((r.seq_id, r.step, list(r.ids)) for r in found) == wanted
        kept = lambda: sum(p.numRowsTotal for p in query.lastProgress.stateOperators) if query.lastProgress else -1
        until(query, lambda: kept() == 0)  # ended sequences, and after its time the one without an end
    finally:
        query.stop()


def test_modes(spark, tmp_path):
    stream = spark.readStream.schema(PROMPT).parquet(str(tmp_path))
    with pytest.raises(ValueError):
        tokens.tokens(stream, Sums(), logits.GenerationConfig(num_beams=2))
