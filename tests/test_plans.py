"""Decisions: order of reasons, overlap, publication, report, sources."""

import random

from pyspark.sql import functions as F

from ledgerspark.cases import CASCADE, table
from ledgerspark.operators import ledger as L
from ledgerspark.plans import decide, publish, report
from ledgerspark.sources.files import POLICY, read_policy, read_texts, write_report


def test_earlier_reason_wins(spark):
    found = {r.id: r for r in decide.eligibility(table(spark, "eligibility")).collect()}
    for name, _ in CASCADE:
        assert found[name].reason == name
    for key, row in found.items():
        if "+" in key:
            assert row.reason == key.split("+")[0], key
    assert found["eligible"].changed == ["a.md"]
    assert found["read_only"].reason == "eligible" and found["read_only"].changed == []
    assert found["secret_first"].reason == "possible_secret" and found["deleted_first"].reason == "deletion_requires_manual_commit"
    assert found["absent_twice"].reason == "eligible" and found["never_verified"].reason == "changed_after_verification"
    assert (found["unreadable"].error, found["unreadable"].reason) == ("binary_file", None)
    assert (found["unreadable_dirty"].error, found["unreadable_dirty"].reason) == (None, "baseline_dirty")
    assert found["wrong_branch"].error == "codex_branch_required" and found["wrong_branch_paused"].reason == "paused"
    assert found["handoff_staged"].reason == "user_staged_owned_path" and found["not_required"].reason == "eligible"


def test_overlap_is_the_sequential_rule(spark):
    rng = random.Random(3)
    for _ in range(4):
        events, open_, spans, marked = [], [], {}, set()
        for seq in range(30):
            if open_ and rng.random() < 0.5:
                t = open_.pop(rng.randrange(len(open_)))
                spans[t][1] = seq
            else:
                t = f"t{seq}"
                if open_:
                    marked |= {t, *open_}
                open_.append(t)
                spans[t] = [seq, None]
            events.append(t)
        tasks = spark.createDataFrame([(k, *v) for k, v in spans.items()], "id string, begin_seq bigint, finish_seq bigint")
        for bits in (1, 3, 20):
            out = decide.overlaps(tasks, bits).collect()
            assert len(out) == len(spans) and {r.id for r in out if r.overlap} == marked


def test_latest_and_first(spark):
    log = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", None), (4, "b", "z")], "seq bigint, id string, v string")
    assert {(r.id, r.seq, r.v) for r in L.latest(log, "id").collect()} == {("a", 3, None), ("b", 4, "z")}
    assert {(r.id, r.seq, r.v) for r in L.first(log, ["id"]).collect()} == {("a", 1, "x"), ("b", 2, "y")}
    empty = log.where("false")
    assert L.latest(empty, "id").count() == 0 and L.any_active(empty, F.lit(True)).first()[0] is False


def test_publication(spark):
    found = {r.id: (r.raised, r.result) for r in publish.publication_audit(table(spark, "publications"), limit=64).collect()}
    assert found["send"] == (None, "send") and found["there"] == (None, "already_there")
    assert found["active"][0] == "task_has_no_completed_commit" and found["disabled"][0] == "task_created_without_push_authorization"
    assert found["merge"][1] == "push_unauthorized_ancestry" and found["shape"][1] == "automation_control_path"
    assert found["moved"][1] == "push_previously_verified_remote_changed" and found["order"][1] == "send"
    states = {r.id: r for r in publish.publication_state(table(spark, "publication_states")).collect()}
    assert (states["t1"].push_status, states["t1"].push_attempts) == ("verified", 1)
    assert (states["t3"].result, states["t3"].push_status) == ("retry_refused", "verified")
    assert (states["t4"].push_status, states["t4"].push_attempts) == ("failed", 2)


def test_report(spark, tmp_path):
    lines = report.report_lines(table(spark, "report_tasks"))
    got = [r.line for r in lines.orderBy("pos").collect()]
    assert sum(line.startswith("| 2026") for line in got) == 12
    assert got[0] == "| 2026-01-01T00:00:09+00:00 | manual | `t07` | completed / eligible | passed | — |"
    path = tmp_path / "report.md"
    assert write_report(lines, str(path)) and not write_report(lines, str(path))
    assert path.read_text().splitlines() == got


def test_sources(spark, tmp_path):
    policy = tmp_path / "policy.json"
    policy.write_text('{\n"expected_root": "/here", "handoff": "h.md",\n"tracked_paths": ["a.md"]}')
    row = read_policy(spark, str(policy), "/here").first()
    assert (row.error, row.approved_new_paths, row.max_file_bytes, row.push_enabled) == (None, [], 1_048_576, False)
    assert read_policy(spark, str(policy), "/there").first().error == "expected_root_mismatch"
    assert "expected_root" in POLICY
    folder = tmp_path / "files"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_bytes(b"\xef\xbb\xbfalpha\r\n")
    (folder / "sub" / "b.md").write_bytes(b"a\0b")
    (folder / "c.md").write_bytes(b"\xff\xfe")
    (folder / "d.md").write_bytes(b"x" * 50)
    found = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in read_texts(spark, str(folder), 40).collect()}
    assert found == {"a.md": ("alpha\r\n", None), "b.md": (None, "binary_file"), "c.md": (None, "ValueError"), "d.md": (None, "file_too_large_or_not_regular")}


def test_top_k_and_folds_stay_cheap(spark):
    log = spark.range(100).selectExpr("id AS seq", "id % 7 AS k", "id AS v")
    plan = L.most_recent(L.latest(log, "k"), F.desc("seq"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and plan.count("Exchange hashpartitioning") == 1


def test_begin_and_notes(spark):
    apps = ("agent", "manual")
    found = {r.id: r.result for r in decide.begin_audit(table(spark, "begins"), table(spark, "states"), apps).collect()}
    assert found["t1"] == "existing" and found["t9"] == "pending_task_retry_push:t3" and found["t2"] == "unknown_app" and found["bad id"] == "invalid_identifier"
    quiet = {r.id: r.result for r in decide.begin_audit(table(spark, "begins"), table(spark, "quiet_states"), apps).collect()}
    assert quiet["t9"] == "begins" and quiet["x" * 155] == "invalid_identifier" and quiet["t9d"] == "unknown_app"
    notes = {r.id: r for r in decide.record_notes(table(spark, "note_requests")).collect()}
    assert (notes["t1"].summary, notes["t1"].evidence, notes["t1"].remaining) == ("did this", "saw / that", "&lt;none&gt;")
    assert notes["t4"].result == "note_contains_personal_contact" and notes["t6"].result == "note_missing_too_long_or_possible_secret" and notes["t6"].summary is None
