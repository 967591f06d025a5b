import json

import pytest

from ebbtide.operators import scoring
from ebbtide.streaming import batches
from tests.conftest import VALID_REQUEST


class Run:
    """Files put in one after the other, each run taking what is new."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.files = spark, tmp_path, 0
        (tmp_path / "in").mkdir()

    def put(self, *records):
        self.files += 1
        rows = [{**VALID_REQUEST, "batch": b, "position": p, "records": n, "at": f"2024-01-01T{at}:00Z", "customer_id": f"{b}-{p}", **change} for b, p, n, at, change in records]
        (self.path / "in" / f"{self.files}.json").write_text("\n".join(map(json.dumps, rows)))

    def run(self, size=3):
        stream = batches.read_batch_stream(self.spark, str(self.path / "in"), 1)
        batches.start_batches(stream, scoring.score_with_rules, str(self.path / "out"), str(self.path / "checkpoint"), 3, size, "1 hour").awaitTermination()
        read = {n: batches.read_outcome(self.spark, str(self.path / "out"), n).collect() for n in batches.OUTCOMES}
        verdicts = sorted((r.batch, r.records, r.invalid, r.accepted, r.reason) for r in read["verdicts"])
        return verdicts, sorted(r.customer_id for r in read["valid"]), sorted((r.customer_id, r.field) for r in read["rejects"])


@pytest.fixture
def stream(spark, tmp_path):
    return Run(spark, tmp_path)


def test_batches_of_two_files_are_judged_whole(stream):
    bad = {"gender": "Unknown"}
    stream.put(("good", 0, 2, "10:00", {}), ("bad", 0, 2, "10:00", bad), ("open", 0, 2, "10:00", {}))
    stream.put(("good", 0, 2, "10:01", {}), ("good", 1, 2, "10:02", {}), ("bad", 1, 2, "10:02", {}))
    stream.put(("good", 1, 2, "10:03", {}), ("huge", 2, 9, "10:03", {}), ("huge", 3, 9, "10:03", {}), ("odd", 5, 2, "10:03", {}))
    verdicts, valid, errors = stream.run()
    assert verdicts == [("bad", 2, 1, False, "invalid"), ("good", 2, 0, True, None), ("huge", 9, None, False, "too large"), ("odd", 2, None, False, "misnumbered")]
    assert valid == ["good-0", "good-1"] and errors == [("bad-0", "gender")]


def test_what_stays_incomplete_is_refused_after_the_wait(stream):
    stream.put(("open", 0, 2, "10:00", {"age": None}))
    assert stream.run() == ([], [], [])
    stream.put(("late", 0, 1, "13:30", {}))
    stream.put(("later", 0, 1, "13:31", {}))
    verdicts, valid, errors = stream.run()
    assert ("open", 2, 1, False, "incomplete") in verdicts and valid == ["late-0", "later-0"] and errors == [("open-0", "age")]


def test_restart_keeps_what_has_come(stream):
    stream.put(("a", 1, 2, "10:00", {}))
    stream.run()
    stream.put(("a", 0, 2, "10:10", {}))
    stream.run()
    stream.put(("a", 0, 2, "10:11", {}))
    assert stream.run() == ([("a", 2, 0, True, None)], ["a-0", "a-1"], [])


def test_records_travel_as_one_text(stream):
    """Texts with tabs, quotes and breaks come out of the state as they went in; the state function converts one column a record."""
    odd = {"customer_id": "a\tb\"c\n d", "gender": "Unknown"}
    stream.put(("odd", 0, 1, "10:00", odd), ("none", None, 1, "10:00", {}))
    verdicts, _, errors = stream.run()
    assert verdicts == [("none", 1, None, False, "misnumbered"), ("odd", 1, 1, False, "invalid")] and errors == [("a\tb\"c\n d", "gender")]
