"""Limits kept over a stream against the batch operators after each micro-batch; the result log; discussions and model runs against a fold by hand."""

import collections
import json
import random

import pytest

from sievework.operators.discussion import discuss, prefilter_run
from sievework.operators.results import failures_in_a_row
from sievework.operators.screening import cost_stop, requests_in_window
from sievework.streaming.limits import STATE, live_limits, next_state, state_after
from sievework.streaming.result_log import DONE, append_batches, read_batches

ROW = "run_id string, line_no long, status string, cost double, ts long, tokens long"


def some_results(seed, n):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([0, 0, 1, 5, 40])
        rows.append((rng.choice("abc"), i, rng.choice(["ok", "api_error", "parse_error", "truncated", "ok"]), rng.choice([None, 0.25, 0.5]), t, rng.choice([None, 3, 9])))
    return rows


def test_state_equals_the_batch_operators_after_each_batch(spark, tmp_path):
    rows = some_results(1, 150)
    cuts = [0, 3, 70, 71, 150]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame(rows[a:b], ROW).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(ROW).json(str(tmp_path / "in"))
        live_limits(stream, str(tmp_path / "state"), str(tmp_path / "cp"), threshold=4, cost_limit=9.0, concurrency=3, seconds=60).awaitTermination()
        number = cuts.index(a)
        got = {r["run_id"]: r for r in state_after(spark, str(tmp_path / "state"), number).collect()}
        seen = spark.createDataFrame(rows[:b], ROW).cache()
        longest = {r["run_id"]: r for r in failures_in_a_row(seen, 4).collect()}
        stops = {r["run_id"]: r["stop_line"] for r in cost_stop(seen, 9.0, 3).collect()}
        busy = {r["run_id"]: r for r in requests_in_window(seen.na.fill(0, ["tokens"]), 60).collect()}
        assert set(got) == {r[0] for r in rows[:b]}
        for run, s in got.items():
            own = [r for r in rows[:b] if r[0] == run]
            assert s["calls"] == len(own) and s["cost"] == sum(r[3] or 0 for r in own)
            assert s["longest"] == (longest[run]["longest"] if run in longest else 0) and (s["tripped_line"] is not None) == (run in longest and longest[run]["tripped"])
            assert s["stop_line"] == stops.get(run) and (s["max_requests"], s["max_tokens"]) == (busy[run]["max_requests"], busy[run]["max_tokens"])
            k = line = 0
            for r in own:
                k = k + 1 if r[2] != "ok" else 0
                line = line or (r[1] + 1 if k >= 4 else 0)
            assert s["trailing"] == k and s["tripped_line"] == (line - 1 if line else None)
        seen.unpersist()


def test_state_of_odd_rows(spark):
    none = spark.createDataFrame([], STATE)
    assert next_state(none, spark.createDataFrame([], ROW), 2, 1.0).count() == 0
    rows = [(None, 1, "ok", 1.0, 1, 1), ("a", None, "ok", 1.0, 1, 1), ("a", 5, None, None, None, None)]
    got = next_state(none, spark.createDataFrame(rows, ROW), 2, 1.0).collect()
    assert [(r["run_id"], r["calls"], r["trailing"], r["max_requests"], r["recent"]) for r in got] == [("a", 1, 0, 0, [])]


def test_a_batch_is_taken_once_and_whole(spark, tmp_path):
    at, schema = str(tmp_path / "log"), "run_id string, batch int, study_uid string, note string"
    rows = spark.createDataFrame([("r", b, f"u{b}-{i}", None) for b in (1, 2) for i in range(20)], schema)
    append_batches(rows.repartition(3), at)
    whole = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, read_batches(spark, at, schema).collect())) == whole
    append_batches(rows.union(rows), at)  # run again, and with other rows: nothing changes
    assert sorted(map(tuple, read_batches(spark, at, schema).collect())) == whole and not list((tmp_path / "log/_parts").iterdir())
    half = tmp_path / "log/run_id=r/batch=3"
    half.mkdir()
    (half / "part-torn.jsonl").write_text('{"run_id": "r", "ba')  # a commit that did not end
    assert read_batches(spark, at, schema).count() == 40
    third = spark.createDataFrame([("r", 3, "u3", "x")], schema)
    append_batches(third, at)
    assert read_batches(spark, at, schema).where("batch = 3").count() == 1 and json.loads((half / DONE).read_text())["files"]
    with pytest.raises(Exception, match="without a run"):
        append_batches(spark.createDataFrame([("r", 4, "u", None), (None, 4, "u", None)], schema).coalesce(1), at)
    assert read_batches(spark, at, schema).count() == 41 and not (tmp_path / "log/run_id=r/batch=4").exists()
    assert read_batches(spark, str(tmp_path / "none"), schema).count() == 0


SAID = "study_uid string, round int, run_id string, seat int, label string, decision string, reasoning string, error string, tokens_in long, tokens_out long, cost double"


@pytest.mark.parametrize("tie_break", ["majority", "no_consensus"])
def test_discussions_by_hand(spark, tie_break):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        for seat in range(rng.randint(2, 4)):
            for r in range(0, 4 if rng.random() < 0.8 else 2):
                error = "E302" if r and rng.random() < 0.2 else None
                rows.append((f"u{i}", r, f"run{seat}", seat, f"L{seat}", rng.choice(["INCLUDE", "EXCLUDE"]), f"why {seat} {r}", error, 5, 2, rng.choice([None, 0.5])))
    got = {r["study_uid"]: r for r in discuss(spark.createDataFrame(rows, SAID), 3, tie_break).collect()}
    for uid in {r[0] for r in rows}:
        own = {(r[1], r[3]): r for r in rows if r[0] == uid}
        seats = sorted(s for k, s in own if k == 0)
        held = {s: own[0, s] for s in seats}
        history = [(0, f"run{s}", own[0, s][5], None) for s in seats]
        tokens, used, agreed = 0, 3, False
        for r in range(1, 4):
            for s in seats:
                x = own.get((r, s))
                if x:
                    history.append((r, f"run{s}", None if x[7] else x[5], x[7]))
                    if not x[7]:
                        held[s], tokens = x, tokens + 5
            if len({x[5] for x in held.values()}) == 1:
                used, agreed = r, True
                break
        votes = collections.Counter(x[5] for x in held.values()).most_common()
        strict = tie_break == "majority" and (len(votes) == 1 or votes[0][1] > votes[1][1])
        g = got[uid]
        assert (g["consensus"], g["rounds_used"], g["tokens_in"]) == (agreed, used, tokens)
        assert g["decision"] == (votes[0][0] if agreed or strict else "NO_CONSENSUS") and g["tie_break"] == (None if agreed else "majority" if strict else "no_consensus")
        assert [(h["round"], h["run_id"], h["decision"], h["error"]) for h in g["history"]] == history
        told = "; ".join(dict.fromkeys(f"L{s}: {held[s][6]}" for s in seats)) if agreed else f"No consensus after {used} round(s). " + "; ".join(f"L{s}: {held[s][5]}" for s in seats)
        assert g["reasoning"] == told[:600] and g["source_decisions"] == {f"run{s}": own[0, s][5] for s in seats}
    assert discuss(spark.createDataFrame([], SAID)).count() == 0


@pytest.mark.parametrize(("max_cost", "threshold", "concurrency"), [(None, 3, 1), (8.0, 3, 4), (8.0, 0, 2), (None, 0, 1)])
def test_model_runs_stop_and_mark_as_by_hand(spark, max_cost, threshold, concurrency):
    rng = random.Random(7)
    records = [(f"u{i}", "" if i % 11 == 0 else "t", "", "DUPLICATE" if i % 13 == 0 else "", "", '{"a":[1],"jev":2}' if i % 2 else "") for i in range(80)]
    answers = [(f"u{i}", i * 3, "E3" if rng.random() < 0.4 else None, "m", rng.random(), 0.4, rng.choice([0.8, 0.95]), 0.5, 1, 1) for i in range(80)]
    r = spark.createDataFrame(records, "study_uid string, title string, abstract string, exclusion_reason string, exclusion_details string, extra_json string")
    a = spark.createDataFrame(answers, "study_uid string, line_no long, error string, model string, probability_true double, probability_false double, confidence double, cost double, tokens_in long, tokens_out long")
    row, cost, stop, left, counted = 0, 0.0, None, None, []
    for x in answers:
        if left == 0:
            break
        left = None if left is None else left - 1
        row = row + 1 if x[2] else 0
        if not x[2]:
            cost += x[7]
            counted.append(x)
        if stop is None and (threshold and row >= threshold or not x[2] and max_cost is not None and cost >= max_cost):
            stop, left = x[1], concurrency - 1
    free = {u for u, t, b, e, _, _ in records if not e and (t or b)}
    marked, summary = prefilter_run(r, a, "m", 0.9, max_cost, threshold, concurrency)
    hits = {x[0] for x in counted if x[0] in free and x[4] > x[5] and x[6] >= 0.9}
    s = summary.first()
    assert (s["eligible"], s["checked"], s["marked"], s["cost"], s["stop_line"]) == (len(free), len(counted), len(hits), cost, stop)
    for m in marked.collect():
        own = next(x for x in records if x[0] == m["study_uid"])
        if m["study_uid"] in hits:
            extra = json.loads(m["extra_json"])
            assert m["exclusion_reason"] == "AI_PREFILTER_JEV" and extra["jev"]["confidence"] == 0.95 and extra.get("a") == ([1] if own[5] else None)
        else:
            assert tuple(m) == own
