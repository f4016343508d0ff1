"""Alerts on a stream with late and repeated rows, two sinks that commit together, documents with many applications."""

import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loanscope.operators import scoring as Z
from loanscope.plans import service as A
from loanscope.schemas import APPLICATION_SCHEMA
from loanscope.streaming import alerts as T
from loanscope.streaming import scoring as ST
from tests.test_validation_io_stream import BROKEN, GOOD, KEPT, applications

EVENTS = "event_id long, event_time timestamp, segment string, incident boolean"
START = dt.datetime(2024, 3, 1)
RULE = T.AlertRule(window="4 hours", slide="2 hours", lateness="1 hour", least_events=5, factor=1.2, warning_errors=0.5, critical_errors=2.0)


def event(i, minutes, segment, incident):
    return (i, None if minutes is None else START + dt.timedelta(minutes=minutes), segment, incident)


@pytest.fixture(scope="module")
def base(spark):
    rows = [("a", 1)] * 1 + [("a", 0)] * 4 + [("b", 1)] * 5 + [("b", 0)] * 5 + [(None, 1)] * 2 + [("c", None)]
    found = T.baseline(spark.createDataFrame(rows, "secteur string, defaut int"), "secteur")
    rates = {r.segment: r.base_rate for r in found.collect()}
    assert rates == {"a": 0.2, "b": 0.5, None: 8 / 17}
    return found


def test_alert_levels(spark, base):
    def window(segment, n, bad):
        return (segment, START, START + dt.timedelta(hours=4), n, bad)

    windows = spark.createDataFrame([
        window("a", 100, 20), window("a", 100, 23), window("a", 100, 25), window("a", 100, 40), window("a", 4, 4), window("b", 100, 50),
        window("new", 100, 90)], "segment string, window_start timestamp, window_end timestamp, events long, incidents long")
    got = sorted((r.segment, r.incidents, r.level) for r in T.segment_alerts(windows, base, RULE).collect())
    assert got == [("a", 25, "warning"), ("a", 40, "critical"), ("new", 90, "critical")]
    assert T.segment_alerts(windows, base.limit(0), RULE).count() == 0
    sure = spark.createDataFrame([("a", 0.0), (None, 0.0)], "segment string, base_rate double")
    assert {r.errors for r in T.segment_alerts(windows.filter("segment = 'a'"), sure, RULE).collect()} == {float("inf")}


def test_stream_with_late_and_repeated_rows_equals_batch(spark, base, tmp_path):
    """Three micro-batches, a restart before each; rows behind the watermark are dropped, repeated ids count once."""
    rng = random.Random(2)
    incoming = tmp_path / "in"
    rows = [event(i, 3 * i, rng.choice("ab") if i % 40 else "new", rng.random() < (0.7 if 300 < i < 420 else 0.3)) for i in range(600)]
    first, second, third = rows[:200], rows[200:400], rows[400:]
    kept = first + second + third
    in_time = event(9001, 3 * 400 - 50, "a", True)  # behind its batch, within the watermark of the batch before
    too_late = [event(9100 + i, 5 + i, "a", True) for i in range(30)]
    odd = [event(None, 10, "a", True), event(9200, None, "a", True), event(9201, 12, None, True)]
    batches = [first + [first[7], first[7]] + odd, second + [second[3], first[195]], third + [in_time] + too_late + [second[199]]]

    def run(batch):
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(incoming))
        stream = spark.readStream.schema(EVENTS).parquet(str(incoming))
        query = T.start_alerts(stream, base, str(tmp_path / "alerts"), str(tmp_path / "checkpoint"), RULE, available_now=True)
        query.awaitTermination()

    for batch in batches:
        run(batch)
    seen = spark.createDataFrame(kept + [in_time], EVENTS)
    latest = seen.agg(F.max("event_time")).first()[0]
    windows = T.closed_before(T.segment_windows(seen.union(seen.limit(50)), RULE), F.lit(latest), RULE)
    want = {tuple(r) for r in T.segment_alerts(windows, base, RULE).collect()}
    stored = spark.read.parquet(str(tmp_path / "alerts"))
    got = [tuple(r) for r in stored.select(*T.segment_alerts(windows, base, RULE).columns).collect()]
    assert set(got) == want and len(got) == len(want) > 5
    assert {"warning", "critical"} & {r[-1] for r in want}


# one source, two sinks

@pytest.fixture(scope="module")
def model(spark, credits):
    return Z.fit_model(credits, Z.FOREST, Z.fit_encoders(credits), Z.ModelSizes(forest_trees=3, forest_depth=3))


@pytest.mark.parametrize("broken_sink", ["scored", "rejected", "ledger"])
def test_a_crash_between_the_sinks_loses_and_repeats_nothing(spark, model, tmp_path, monkeypatch, broken_sink):
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "out")
    sent = [KEPT[:4] + [BROKEN[0][0]], KEPT[4:] + [BROKEN[3][0], BROKEN[4][0]], [{"age": 50}, {"age": 3}]]
    crashed = []
    write = ST.write_sink

    def failing(df, path):
        write(df, path)
        if broken_sink in path and path.endswith("batch_id=1") and not crashed:
            crashed.append(path)
            raise RuntimeError("lost")

    def run():
        stream = ST.read_applications(spark, incoming, max_files=1)
        ST.start_scoring_once(stream, model, folder, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()

    monkeypatch.setattr(ST, "write_sink", failing)
    if broken_sink == "ledger":
        monkeypatch.setattr(ST, "write_sink", write)
        create = spark.createDataFrame

        def no_entry(rows, schema=None, *a, **b):
            if schema == ST.LEDGER_SCHEMA and rows[0][0] == 1 and not crashed:
                crashed.append("ledger")
                raise RuntimeError("lost")
            return create(rows, schema, *a, **b)

        monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: no_entry(*a, **b))
    for n, rows in enumerate(sent):
        applications(spark, rows).coalesce(1).write.mode("append").json(incoming)
        with open(os.path.join(incoming, f"broken{n}.json"), "w") as out:
            out.write('{"age": \n')
    with pytest.raises(Exception, match="lost"):
        run()
    # readers see the finished batches alone, both sinks of them
    done = {r.batch_id for r in ST.read_ledger(spark, folder).collect()}
    assert done == {0} and crashed
    assert {r.batch_id for r in ST.read_sink(spark, folder, "scored").select("batch_id").union(
        ST.read_sink(spark, folder, "rejected").select("batch_id")).collect()} <= done
    run()
    everything = applications(spark, [r for rows in sent for r in rows])
    expected = A.score_applications(everything, model)
    got = ST.read_sink(spark, folder, "scored")
    assert got.count() == expected.count() and got.select(expected.columns).exceptAll(expected).count() == 0
    assert ST.read_sink(spark, folder, "rejected").count() == 4 + len(sent)
    ledger = ST.read_ledger(spark, folder).agg(F.sum("received"), F.sum("scored"), F.sum("rejected"), F.count("*")).first()
    assert tuple(ledger) == (everything.count() + len(sent), expected.count(), 4 + len(sent), 2 * len(sent))


# documents

def test_documents_of_applications(spark, model):
    ok = [{**GOOD, "age": 30 + i} for i in range(3)]
    documents = {
        1: json.dumps({"clients": ok}), 2: json.dumps({"clients": []}), 3: "{}", 4: None, 5: "not json", 6: json.dumps({"clients": ok * 34}),
        7: json.dumps({"clients": [ok[0], {**GOOD, "age": 5}, {**GOOD, "age": 4, "ville": None}]}), 8: json.dumps({"clients": ok[:1] * 100}),
        9: json.dumps({"clients": [{**GOOD, "age": "many"}]}), 10: json.dumps({"clients": [{k: v for k, v in GOOD.items() if k not in (
            "nb_incidents_24m", "nb_credits_en_cours")}]}), 11: json.dumps({"clients": None}),
    }
    frame = spark.createDataFrame(list(documents.items()), "lot long, payload string")
    got = {r.lot: r for r in A.score_payloads(frame, model, "lot").collect()}
    assert {k: r.erreur for k, r in got.items()} == {
        1: None, 2: "clients:min_length_1", 3: "clients:required", 4: "illisible", 5: "illisible", 6: "clients:max_length_100",
        7: "clients[1]:age:ge_18", 8: None, 9: "illisible", 10: None, 11: "clients:required"}
    assert {k: r.total for k, r in got.items() if r.erreur is None} == {1: 3, 8: 100, 10: 1}
    assert all(r.resultats is None and r.total is None for r in got.values() if r.erreur)
    one = {r.age: r for r in A.score_applications(spark.createDataFrame(
        [tuple(c[f.name] for f in APPLICATION_SCHEMA.fields) for c in ok], APPLICATION_SCHEMA), model).collect()}
    assert [r.asDict() for r in got[1].resultats] == [{f: one[30 + i][f] for f in A.RESULT_FIELDS} for i in range(3)]
    assert A.score_payloads(frame.limit(0), model, "lot").count() == 0
