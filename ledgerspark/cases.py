"""Recorded observations as small inline tables, the same rows for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SECRET_LINE = 'token = "abcdefghijklmnopqrst"'
A, B, C, D = "a" * 40, "b" * 40, "c" * 40, "d" * 40

#: name: (columns with types, rows)
CASES: dict[str, tuple[str, list[tuple]]] = {
    "meta": ("key string, value string", [("enabled", "true"), ("commit_journal", "null")]),
    "asked_meta": ("key string", [("enabled",), ("commit_journal",), ("unknown",)]),
    "asked_tasks": ("user_id bigint", [(1,), (2,), (3,), (-5,), (10_000_000,)]),
    "begin_requests": ("user_id bigint, event_type string", [(1, "fresh"), (2, "fresh"), (-7, "fresh"), (99_999_999, "fresh")]),
    "paths": ("path string, linked boolean, outside boolean", [
        ("../escape.md", False, False), ("data/a.md", False, False), ("raw/a.py", False, False), ("a.csv", False, False),
        ("a.md:stream", False, False), ("C:/a.md", False, False), ("/a.md", False, False), (".git/a.md", False, False),
        ("tools/backdoor.py", False, False), ("AGENTS.md", False, False), ("bad|name.md", False, False), ("notes/a.md", False, False),
        ("notes//a.md", False, False), ("./a.md", False, False), ("notes/", False, False), ("", False, False), (None, False, False),
        ("Data/a.md", False, False), ("x/OUTPUT/a.txt", False, False), ("a.MD", False, False), (".md", False, False), ("a.b.py", False, False),
        ("Tools/a.py", False, False), ("agents.md", False, False), ("x/AGENTS.md", False, False), ("dir /a.md", False, False), ("dir./a.md", False, False),
        ("a\tb.md", False, False), ("a\nb.md", False, False), ("a\\b.md", False, False), ("link/a.md", True, False), ("far/a.md", False, True), ("both/a.md", True, True),
        ("한글/메모.md", False, False), ("noext", False, False), ("x/..", False, False), (".ledger/a.md", False, False), (".codex/a.py", False, False),
    ]),
    "idents": ("value string", [("task-1",), ("a.b:c@d_e",), ("",), (None,), ("bad id",), ("x" * 160,), ("x" * 161,), ("x" * 154,), ("x" * 153,), ("x" * 155,), ("ok\n",), ("é",)]),
    "notes": ("id int, text string", [
        (1, "done"), (2, "   "), (3, "x" * 600), (4, "x" * 601), (5, SECRET_LINE), (6, "write to someone@example.org"), (7, "call 010-1234-5678"),
        (8, " a  b\n\tc "), (9, "a|b <c> & d"), (10, ""), (11, "가" * 600), (12, "<" * 600), (13, "SECRET: 'ABCDEFGHIJKLMNOP'"), (14, "010-12-5678"),
    ]),
    "newlines": ("id int, text string", [(1, "a\r\nb\r\n"), (2, "a\rb"), (3, "a\nb"), (4, "\r\r\n\n"), (5, ""), (6, None)]),
    "regions": ("id int, text string", [
        (1, "x\n<!-- managed:begin -->old<!-- managed:end -->\ny"), (2, "no markers"), (3, "<!-- managed:begin --><!-- managed:begin --><!-- managed:end -->"),
        (4, "<!-- managed:end --> <!-- managed:begin -->"), (5, "<!-- managed:begin -->\r\n<!-- managed:end -->\r\nz"), (6, "<!-- managed:begin -->"),
    ]),
    "nul_lists": ("id int, text string", [(1, "b.md^a.md^"), (2, ""), (3, "^"), (4, "a.md"), (5, "a.md^a.md^^c.md^")]),
    "nul_attrs": ("id int, text string", [(1, "a.md^text^set^a.md^eol^lf^"), (2, "a.md^text^set^"), (3, "a.md^text^unset^a.md^eol^crlf^a.md^filter^x^")]),
    "scopes": ("id string, allow array<string>, new array<string>, tracked array<string>, handoff string, claimed array<string>, dirty array<string>, staged array<string>", [
        ("t1", ["a.md", "b.md", "handoff.md"], ["new.md"], ["a.md", "handoff.md", "z.md"], "handoff.md", ["a.md"], ["a.md", "b.md"], ["z.md"]),
        ("t2", ["a.md"], [], ["a.md"], "handoff.md", ["a.md"], ["a.md"], ["a.md"]),
        ("t3", [], [], [], "handoff.md", [], [], ["handoff.md"]),
        ("t4", ["b.md", "a.md"], ["b.md"], ["b.md"], "handoff.md", ["b.md", "a.md"], ["q.md", "b.md"], []),
    ]),
    "fingerprints": ("task_id string, kind string, path string, fp string", [
        *[("t1", "claimed", p, None) for p in ("a.md", "b.md", "n.md", "gone.md")],
        ("t1", "baseline", "a.md", "1"), ("t1", "baseline", "b.md", "2"), ("t1", "baseline", "n.md", None), ("t1", "baseline", "gone.md", "3"),
        ("t1", "verified", "a.md", "1"), ("t1", "verified", "b.md", "9"), ("t1", "verified", "gone.md", "3"),
        ("t1", "current", "a.md", "1"), ("t1", "current", "b.md", "9"), ("t1", "current", "n.md", None),
        ("t2", "claimed", "n.md", None), ("t2", "baseline", "n.md", None), ("t2", "current", "n.md", "7"),
    ]),
    "task_spans": ("id string, begin_seq bigint, finish_seq bigint", [
        ("t1", 1, 2), ("t2", 3, 6), ("t3", 4, 5), ("t4", 7, None), ("t5", 8, 9), ("t6", 10, None), ("t0", 0, 1),
    ]),
    "remotes": ("id int, line string, ref string", [
        (1, f"{A}\trefs/heads/w", "refs/heads/w"), (2, f"{A} refs/heads/x", "refs/heads/w"), (3, f"{A[:39]}\trefs/heads/w", "refs/heads/w"),
        (4, f"{A.upper()}\trefs/heads/w", "refs/heads/w"), (5, A + "e" * 24 + "\trefs/heads/w", "refs/heads/w"), (6, A + "e" * 25 + "\trefs/heads/w", "refs/heads/w"), (7, "", "refs/heads/w"),
    ]),
    "claims": ("id string, status string, allow array<string>, new array<string>, tracked array<string>, handoff string, baseline map<string,string>, current map<string,string>, claimed array<string>, asked array<string>", [
        (k, s, ["a.md", "b.md", "h.md", "tools/x.py"], ["n.md", "m.md"], ["a.md", "b.md", "h.md"], "h.md", {"a.md": "1", "b.md": "2", "h.md": "3", "n.md": n, "tools/x.py": "5"}, cur, ["b.md"], asked)
        for k, s, n, cur, asked in [
            ("ok", "active", None, {"a.md": "1", "b.md": "2"}, ["a.md"]), ("again", "active", None, {"b.md": "2"}, ["b.md", "b.md"]),
            ("closed", "completed", None, {"a.md": "1"}, ["a.md"]), ("shape", "active", None, {"a.md": "1"}, ["a.md", "../x.md"]),
            ("control", "active", None, {"tools/x.py": "5"}, ["tools/x.py"]), ("other", "active", None, {}, ["z.md"]), ("handoff", "active", None, {"h.md": "3"}, ["h.md"]),
            ("late", "active", None, {}, ["m.md"]), ("there", "active", "4", {"n.md": "4"}, ["n.md"]), ("edited", "active", None, {"a.md": "9"}, ["a.md", "z.md"]),
            ("new", "active", None, {}, ["n.md", "a.md"]), ("fresh", "active", None, {"a.md": "1"}, ["n.md", "a.md"]), ("none", "active", None, {}, []),
        ]
    ]),
    "verifications": ("id string, status string, value string, claimed array<string>, current map<string,string>", [
        ("t1", "active", "passed", ["a.md", "n.md"], {"a.md": "1"}), ("t2", "completed", "passed", ["a.md"], {"a.md": "1"}), ("t3", "active", "maybe", [], {}), ("t4", "active", "failed", [], {}),
    ]),
    "journals": ("command string, journal string", [(c, j) for c in ("enable", "pause", "disable", "status", "begin", "claim", "note", "verify", "finish", "retry-push") for j in ("null", None, '{"stage":"prepared"}')]),
    "finishes": ("id string, status string, result string, outcome string, dry_run boolean, reason string, paths array<string>, error string", [
        ("t1", "active", "started", "completed", False, "eligible", ["a.md"], None), ("t2", "completed", "committed", "completed", False, "eligible", [], None),
        ("t3", "active", "started", "interrupted", False, "interrupted_or_unknown", [], None), ("t4", "active", "started", "completed", True, "eligible", ["a.md"], None),
        ("t5", "active", "started", "completed", False, "paused", [], None), ("t6", "active", "started", "completed", False, None, [], "binary_file"), ("t7", "active", "started", "unknown", True, "interrupted_or_unknown", [], None),
    ]),
    "begins": ("id string, app string, session string", [
        ("t1", "manual", None), ("t9", "manual", None), ("t9b", "robot", None), ("bad id", "manual", None), ("t9c", "manual", "bad session"), ("t9d", None, ""), ("x" * 155, "manual", "s"), ("t2", "robot", None),
    ]),
    "states": ("id string, seq bigint, push_status string", [("t1", 5, "verified"), ("t2", 9, "failed"), ("t3", 7, "pending"), ("t4", 1, None)]),
    "quiet_states": ("id string, seq bigint, push_status string", [("t1", 5, "verified"), ("t4", 1, "disabled")]),
    "note_requests": ("id string, status string, summary string, evidence string, remaining string, next_step string", [
        ("t1", "active", " did  this ", "saw | that", "<none>", "stop"), ("t2", "completed", "a", "b", "c", "d"), ("t3", "active", "a", "", "c", "d"), ("t4", "active", "a", "me@example.org", "", "d"),
        ("t5", "active", "a", "b", "c", None), ("t6", "active", "a", "b", SECRET_LINE, "me@example.org"), ("t7", "active", "a", "b", "c", "010-1234-5678"),
    ]),
    "dirty_lists": ("id int, dirty array<string>, handoff string, at_head string, at_hand string", [
        (1, ["h.md", "b.md", "a.md"], "h.md", "x<!-- managed:begin -->1<!-- managed:end -->y", "x<!-- managed:begin -->22<!-- managed:end -->y"),
        (2, ["h.md", "a.md"], "h.md", "x<!-- managed:begin -->1<!-- managed:end -->y", "z<!-- managed:begin -->1<!-- managed:end -->y"), (3, ["h.md"], "h.md", "x", "x"), (4, [], "h.md", None, None),
    ]),
    "bodies": ("seq bigint, body string", [
        (1, '{"id": "t1", "status": "active", "baseline": {"a.md": "1", "n.md": null}, "claimed": []}'), (2, '{"id": "t1", "status": "completed", "claimed": ["a.md"], "push_attempts": 2, "push_status": "failed"}'),
        (3, '{"id": "t2", "status": "active", "notes": {"summary": "s", "evidence": "e", "remaining": "r", "next_step": "n"}}'),
    ]),
    "policies": ("expected_root string, handoff string, tracked_paths array<string>, approved_new_paths array<string>, max_file_bytes bigint, push_enabled boolean", [
        ("/work/here", "h.md", ["a.md"], ["n.md"], 10, True), ("/work/there", "h.md", ["a.md"], None, None, None), (None, "h.md", [], None, None, False),
    ]),
}


def _variants(base: dict, changes: list[tuple]) -> list[tuple]:
    """Rows that differ from one base each by some fields; the id says which."""
    return [tuple({**base, **dict(c), "id": k}.values()) for k, c in changes]


_TASK = dict(
    id="", outcome="completed", enabled=True, branch="codex/w", head=A, now_branch="codex/w", now_head=A, baseline_dirty=[], overlap=False, has_notes=True,
    verification="passed", claimed=["a.md", "b.md"], baseline={"a.md": "1", "b.md": "2", "h.md": "3"}, verified={"a.md": "9", "b.md": "2"},
    current={"a.md": "9", "b.md": "2", "h.md": "3"}, unreadable=None, dirty=["a.md"], staged=[], handoff="h.md", contents={"a.md": "text", "b.md": "more"},
)
#: Conditions of the eligibility cascade in order, each as a change that makes it true.
CASCADE = [
    ("interrupted_or_unknown", {"outcome": "interrupted"}), ("paused", {"enabled": False}), ("head_or_branch_changed", {"now_head": B}), ("baseline_dirty", {"baseline_dirty": ["b.md"]}),
    ("overlapping_tasks", {"overlap": True}), ("handoff_notes_missing", {"has_notes": False}), ("verification_missing_or_failed", {"verification": "failed"}),
    ("unclaimed_changes", {"dirty": ["a.md", "z.md"]}), ("handoff_manual_edit", {"current": {"a.md": "9", "b.md": "2", "h.md": "8"}}),
    ("changed_after_verification", {"verified": {"a.md": "8", "b.md": "2"}}), ("user_staged_owned_path", {"staged": ["a.md"]}),
]
CASES["eligibility"] = (
    "id string, outcome string, enabled boolean, branch string, head string, now_branch string, now_head string, baseline_dirty array<string>, overlap boolean, has_notes boolean, "
    "verification string, claimed array<string>, baseline map<string,string>, verified map<string,string>, current map<string,string>, unreadable string, dirty array<string>, "
    "staged array<string>, handoff string, contents map<string,string>",
    _variants(_TASK, [
        ("eligible", {}), *CASCADE, *[(f"{a[0]}+{b[0]}", {**b[1], **a[1]}) for k, a in enumerate(CASCADE) for b in CASCADE[k + 1 :] if not set(a[1]) & set(b[1])],
        ("handoff_staged", {"staged": ["h.md"]}), ("read_only", {"current": {"a.md": "1", "b.md": "2", "h.md": "3"}, "verified": {"a.md": "1", "b.md": "2"}, "dirty": []}),
        ("deleted", {"current": {"b.md": "2", "h.md": "3"}, "verified": {"b.md": "2"}, "contents": {"b.md": "more"}}), ("secret", {"contents": {"a.md": SECRET_LINE, "b.md": "more"}}),
        ("secret_first", {"current": {"a.md": "9", "h.md": "3"}, "verified": {"a.md": "9"}, "contents": {"a.md": SECRET_LINE}}),
        ("deleted_first", {"current": {"b.md": "7", "h.md": "3"}, "verified": {"b.md": "7"}, "contents": {"b.md": SECRET_LINE}}),
        ("absent_twice", {"claimed": ["a.md", "n.md"], "baseline": {"a.md": "1", "n.md": None, "h.md": "3"}}), ("never_verified", {"verified": None}),
        ("unreadable", {"unreadable": "binary_file"}), ("unreadable_paused", {"unreadable": "binary_file", "enabled": False}), ("unreadable_dirty", {"unreadable": "binary_file", "baseline_dirty": ["b.md"]}),
        ("wrong_branch", {"now_branch": "main"}), ("wrong_branch_paused", {"now_branch": "main", "enabled": None}), ("not_required", {"verification": "not_required"}), ("branch", {"now_branch": "codex/x"}),
    ]),
)
_DESTINATION = dict(id="", enabled=True, push_enabled=True, root="/r", url="u", branch="w", own_root="/r", own_url="u", own_branch="w", remotes=["origin"], urls=["u"], settings=["core.bare"])
CASES["destinations"] = (
    "id string, enabled boolean, push_enabled boolean, root string, url string, branch string, own_root string, own_url string, own_branch string, remotes array<string>, urls array<string>, settings array<string>",
    _variants(_DESTINATION, [
        ("fine", {}), ("paused", {"enabled": False}), ("off", {"push_enabled": None}), ("root", {"root": "/q"}), ("url", {"url": None}), ("branch", {"branch": "x"}), ("remotes", {"remotes": ["origin", "other"]}),
        ("urls", {"urls": ["u", "u"]}), ("order", {"remotes": ["x"], "urls": []}), ("pushurl", {"settings": ["remote.origin.pushurl"]}), ("mirror", {"settings": ["core.bare", "remote.origin.mirror"]}),
        ("rewrite", {"settings": ["url.x.insteadof"]}), ("push_rewrite", {"settings": ["url.a.b.pushinsteadof"]}), ("both", {"settings": ["url.x.insteadof", "remote.pushdefault"]}),
    ]),
)
_PUBLICATION = dict(
    id="", status="completed", commit=B, push_status="pending", destination="authorized", own_branch="w", now_branch="w", now_head=B, branch="w", head=A, any_active=False,
    ancestry=[B, A], changed=["a.md"], handoff="h.md", actual=["a.md", "h.md"], allowed=["a.md"], contents={"a.md": "text", "h.md": "more"}, remote=A, after=B,
)
CASES["publications"] = (
    "id string, status string, commit string, push_status string, destination string, own_branch string, now_branch string, now_head string, branch string, head string, any_active boolean, "
    "ancestry array<string>, changed array<string>, handoff string, actual array<string>, allowed array<string>, contents map<string,string>, remote string, after string",
    _variants(_PUBLICATION, [
        ("send", {}), ("there", {"remote": B}), ("active", {"status": "active"}), ("no_commit", {"commit": None}), ("disabled", {"push_status": "disabled"}), ("never", {"push_status": None}),
        ("destination", {"destination": "push_paused"}), ("head", {"now_head": C}), ("branch", {"now_branch": "x"}), ("other_active", {"any_active": True}), ("merge", {"ancestry": [B, A, C]}), ("parent", {"ancestry": [B, C]}),
        ("paths", {"actual": ["a.md"]}), ("order", {"actual": ["h.md", "a.md"]}), ("allowed", {"allowed": []}), ("shape", {"changed": ["tools/a.py"], "actual": ["tools/a.py", "h.md"]}),
        ("secret", {"contents": {"a.md": SECRET_LINE, "h.md": "x"}}), ("large", {"contents": {"a.md": "x" * 70, "h.md": "x"}}), ("remote", {"remote": C}), ("moved", {"push_status": "verified", "remote": A}),
        ("verified", {"push_status": "verified", "remote": B}), ("mismatch", {"after": A}), ("failed", {"push_status": "failed"}), ("unknown", {"push_status": "unknown", "remote": B}),
    ]),
)
CASES["publication_states"] = (
    "id string, push_status string, push_attempts int, commit string, remote string, audit string",
    [("t1", "pending", None, B, A, "send"), ("t2", "pending", 1, B, B, "already_there"), ("t3", "verified", 1, B, A, "push_previously_verified_remote_changed"), ("t4", "failed", 2, B, A, "push_paused"),
     ("t5", "pending", None, B, A, "push_remote_verification_mismatch"), ("t6", "failed", 2, B, A, "send"), ("t7", "verified", 1, B, B, "already_there")],
)
_ATTR = {"text": "set", "eol": "lf", "filter": "unspecified", "working-tree-encoding": "unspecified"}
_COMMIT = dict(id="", contents={"a.md": "text"}, index_locked=False, now_branch="w", now_head=A, branch="w", head=A, staged=[], paths=["a.md", "h.md"], attributes=[_ATTR], modes=["100644"], files_after_same=True, index_after_same=True)
CASES["commits"] = (
    "id string, contents map<string,string>, index_locked boolean, now_branch string, now_head string, branch string, head string, staged array<string>, paths array<string>, "
    "attributes array<map<string,string>>, modes array<string>, files_after_same boolean, index_after_same boolean",
    _variants(_COMMIT, [
        ("fine", {}), ("gone", {"contents": {"a.md": None}}), ("secret", {"contents": {"a.md": SECRET_LINE}}), ("locked", {"index_locked": True}), ("head", {"now_head": B}), ("staged", {"staged": ["h.md"]}),
        ("attributes", {"attributes": [_ATTR, {**_ATTR, "eol": "crlf"}]}), ("modes", {"modes": ["100755", "120000"]}), ("files", {"files_after_same": False}), ("index", {"index_after_same": False, "modes": ["100755"]}),
        ("order", {"index_locked": True, "now_head": B}),
    ]),
)
CASES["remote_answers"] = (
    "id int, answer string, ref string",
    [(1, f"{A}\trefs/heads/w\n", "refs/heads/w"), (2, f"{A} refs/heads/w", "refs/heads/w"), (3, "", "refs/heads/w"), (4, f"{A}\trefs/heads/w\n{B}\trefs/heads/v\n", "refs/heads/w"),
     (5, f"{A}\trefs/heads/v\n", "refs/heads/w"), (6, f"{A[1:]}\trefs/heads/w\n", "refs/heads/w"), (7, f"{A.upper()}\trefs/heads/w\r\n", "refs/heads/w"), (8, f"{A}\trefs/heads/w\r\n", "refs/heads/w"),
     (9, "\n", "refs/heads/w"), (10, f"{A}\n\n", "refs/heads/w"), (11, f"{A} refs/heads/w more", "refs/heads/w")],
)
CASES["messages"] = ("app string, id string", [("manual", "t1"), ("agent", "x" * 60), ("manual", "é" * 50), ("agent", "")])
CASES["push_policies"] = ("enabled boolean, url string, branch string", [(True, "u", "w")])
CASES["report_tasks"] = (
    "seq bigint, id string, app string, started string, status string, result string, verification string, changed array<string>, claimed array<string>, push_error string, "
    "notes struct<summary: string, evidence: string, remaining: string, next_step: string>",
    [
        (k, f"t{k:02d}", "manual", f"2026-01-01 00:00:{(k * 7) % 10:02d}", "completed" if k % 2 else "active", "eligible" if k % 2 else "started", "passed" if k % 3 else "not_run",
         [None, [], ["a.md", "b.md"]][k % 3], [["c.md"], []][k % 2], "push_paused" if k % 5 == 0 else None, (f"s{k}", f"e{k}", f"r{k}", f"n{k}") if k % 4 == 1 else None)
        for k in range(1, 16)
    ],
)


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = CASES[name]
    return spark.createDataFrame(rows, schema)


def _duck(kind: str) -> str:
    kind = kind.strip()
    if kind.startswith("array<"):
        return _duck(kind[6:-1]) + "[]"
    if kind.startswith("map<"):
        return "MAP(VARCHAR, VARCHAR)"
    if kind.startswith("struct<"):
        return "STRUCT(" + ", ".join(f"{f.split(':')[0].strip()} VARCHAR" for f in kind[7:-1].split(",")) + ")"
    return {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN"}[kind]


def values(name: str) -> str:
    """The same rows as a subquery of SQL, from one JSON literal."""
    import json
    import re

    schema, rows = CASES[name]
    fields = re.findall(r"(\w+) (struct<[^>]*>|array<map<[^>]*>>|array<\w+>|map<[^>]*>|\w+)", schema)
    held = dict(re.findall(r"(\w+) struct<([^>]*)>", schema))
    inner = {n: [f.split(":")[0].strip() for f in parts.split(",")] for n, parts in held.items()}
    named = lambda n, v: dict(zip(inner[n], v)) if isinstance(v, tuple) else v
    body = json.dumps([{n: named(n, v) for v, (n, _) in zip(row, fields)} for row in rows], ensure_ascii=False, separators=(",", ":"))
    types = json.dumps([{n: {f: "VARCHAR" for f in inner[n]} if n in inner else _duck(t) for n, t in fields}])
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"(SELECT unnest(r) FROM (SELECT unnest(from_json({quoted(body)}, {quoted(types)})) AS r))"
