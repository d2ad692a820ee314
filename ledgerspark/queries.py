"""The registered queries of the ledger operators, and independent SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cases import table, values
from .functions import paths as P
from .functions import text as X
from .operators import ledger as L
from .operators import path_sets as S
from .plans import decide, publish, report
from .sources.files import TASK, policy_fields
from .sources.log import append_log, read_log, work_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Size limit of the document queries, so that it applies to some.
LIMIT = 16_384

_SECRET = r"""(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----|\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{24,})|(?:api[_-]?key|password|secret|token)\s*[:=]\s*["''][A-Za-z0-9_+/=-]{16,}["'']"""
_CONTACT = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b"


def query(sql: str) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


def _documents(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", "text")
    return docs.select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a ledger: a user is a task, an event a save."""
    return spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("seq"), "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_LATEST = """SELECT user_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value,
  arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k FROM events GROUP BY user_id"""


@query(f"""
SELECT doc_id, source || '/' || doc_id || '.md' AS path, sha256(text) AS sha256, CAST(strlen(text) AS INTEGER) AS n_bytes,
  regexp_matches(text, '{_SECRET}') AS secret, regexp_matches(text, '{_CONTACT}') AS contact,
  CASE WHEN strlen(text) > {LIMIT} THEN 'file_too_large_or_not_regular' WHEN regexp_matches(text, '{_SECRET}') THEN 'possible_secret'
    WHEN regexp_matches(text, '{_CONTACT}') THEN 'personal_contact' ELSE 'clean' END AS class
FROM documents
""")
def content_scan(spark, d):
    docs = _documents(spark, d)
    flagged = docs.withColumns({"secret": X.has_secret(F.col("text")), "contact": X.has_contact(F.col("text"))})
    kind = F.coalesce(X.content_problem(F.col("text"), LIMIT), F.when(F.col("secret"), "possible_secret"), F.when(F.col("contact"), "personal_contact"), F.lit("clean"))
    return flagged.select("doc_id", "path", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"), "secret", "contact", kind.alias("class"))


@query(f"""
SELECT path, sha256(text) AS fp FROM (SELECT source || '/' || doc_id || '.md' AS path, text FROM documents)
UNION ALL
SELECT 'h' || id || '.md', CASE WHEN len(text) - len(replace(text, '<!-- managed:begin -->', '')) = 22 AND len(text) - len(replace(text, '<!-- managed:end -->', '')) = 20
    AND position('<!-- managed:begin -->' IN text) < position('<!-- managed:end -->' IN text)
  THEN sha256(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?s)<!-- managed:begin -->.*<!-- managed:end -->', '<!-- managed:begin --><!-- managed:end -->')) END
FROM {values("regions")}
""")
def content_fingerprint(spark, d):
    files = _documents(spark, d).select("path", "text", F.lit("").alias("handoff"))
    own = table(spark, "regions").select(F.concat(F.lit("h"), "id", F.lit(".md")).alias("path"), "text").withColumn("handoff", F.col("path"))
    return files.unionByName(own).select("path", X.fingerprint(F.col("path"), F.col("text"), F.col("handoff")).alias("fp"))


@query(_LATEST)
def ledger_latest(spark, d):
    return L.latest(_log(spark, d), "user_id")


@query("""SELECT user_id, event_type, min(event_id) AS seq, arg_min(value, event_id) AS value, arg_min(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS k
FROM events GROUP BY user_id, event_type""")
def ledger_first(spark, d):
    return L.first(_log(spark, d), ["user_id", "event_type"])


@query(f"SELECT 'pending_task_retry_push:' || user_id AS error FROM ({_LATEST}) WHERE event_type IN ('error', 'purchase') ORDER BY seq LIMIT 1")
def pending_tasks(spark, d):
    return L.first_pending(L.latest(_log(spark, d), "user_id"), "user_id", "event_type", pending=("error", "purchase"))


@query(f"SELECT user_id, seq FROM ({_LATEST}) WHERE event_type = 'view'")
def active_tasks(spark, d):
    return L.latest(_log(spark, d), "user_id").where("event_type = 'view'").select("user_id", "seq")


@query(f"SELECT count(*) > 0 AS active FROM ({_LATEST}) WHERE event_type = 'view'")
def active_exists(spark, d):
    return L.any_active(L.latest(_log(spark, d), "user_id"), F.col("event_type") == "view")


@query(f"SELECT user_id, value, seq FROM ({_LATEST}) ORDER BY value DESC, seq DESC LIMIT 12")
def report_top12(spark, d):
    return L.most_recent(L.latest(_log(spark, d), "user_id"), F.desc("value"), F.desc("seq")).select("user_id", "value", "seq")


@query(f"SELECT user_id, event_type, seq FROM ({_LATEST}) ORDER BY seq DESC LIMIT 12")
def status_top12(spark, d):
    return L.most_recent(L.latest(_log(spark, d), "user_id"), F.desc("seq")).select("user_id", "event_type", "seq")


@query(f"SELECT user_id, 'missing_begin' AS error FROM {values('asked_tasks')} WHERE user_id NOT IN (SELECT user_id FROM events)")
def lookup_missing(spark, d):
    return L.missing(table(spark, "asked_tasks"), L.latest(_log(spark, d), "user_id"), "user_id")


@query(f"""SELECT r.user_id, l.user_id IS NOT NULL AS existing, coalesce(l.event_type, r.event_type) AS event_type
FROM {values('begin_requests')} r LEFT JOIN ({_LATEST}) l USING (user_id)""")
def begin_idempotent(spark, d):
    return L.begin(table(spark, "begin_requests"), L.latest(_log(spark, d), "user_id"), "user_id", ["event_type"])


@query(f"SELECT a.key, coalesce(m.value, 'false') AS value FROM {values('asked_meta')} a LEFT JOIN {values('meta')} m USING (key)")
def meta_lookup(spark, d):
    return L.lookup(table(spark, "meta"), table(spark, "asked_meta"), "false")


_DENIED = ", ".join(f"'{x}'" for x in P.DENIED_PARTS)
_PATH_CASE = f"""CASE WHEN path IS NULL OR regexp_matches(path, '[\\\\:\\r\\n\\t|]') THEN 'invalid_path'
  WHEN len(list_filter(string_split(path, '/'), lambda x: x IN ('', '.', '..') OR x LIKE '% ' OR x LIKE '%.')) > 0 THEN 'path_traversal'
  WHEN len(list_filter(string_split(path, '/'), lambda x: lower(x) IN ({_DENIED}))) > 0 OR NOT regexp_matches(lower(path), '[^/]\\.(md|py|txt)$') THEN 'forbidden_file_type_or_directory'
  WHEN starts_with(path, 'tools/') OR starts_with(path, '.ledger/') OR starts_with(path, '.codex/') OR path IN ('AGENTS.md', 'GEMINI.md') THEN 'automation_control_path'
  WHEN linked THEN 'symlink_or_reparse_point' WHEN outside THEN 'path_outside_root' ELSE 'ok' END"""


@query(f"""SELECT path, {_PATH_CASE} AS class FROM (SELECT * FROM {values('paths')}
UNION ALL SELECT source || '/' || doc_id || '.md', false, false FROM documents
UNION ALL SELECT regexp_replace(url, '^https?://', ''), false, false FROM pages)""")
def path_classify(spark, d):
    none = [F.lit(False).alias("linked"), F.lit(False).alias("outside")]
    more = _documents(spark, d).select("path", *none)
    urls = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_replace("url", "^https?://", "").alias("path"), *none)
    every = table(spark, "paths").unionByName(more).unionByName(urls)
    return every.select("path", P.path_class(F.col("path"), F.col("linked"), F.col("outside")).alias("class"))


@query(f"""SELECT value, coalesce(regexp_full_match(value, '[A-Za-z0-9_.:@-]{{1,160}}'), false) AS ok,
  coalesce(regexp_full_match(value, '[A-Za-z0-9_.:@-]{{1,160}}') AND length(value) <= 154, false) AS begins,
  coalesce(regexp_full_match(value, '[A-Za-z0-9_.:@-]{{1,160}}') AND length(value) <= 153, false) AS finishes FROM {values('idents')}""")
def ident_check(spark, d):
    v = F.col("value")
    fits = lambda e: F.coalesce(P.event_ident_fits(v, e), F.lit(False))
    return table(spark, "idents").select("value", P.is_ident(v).alias("ok"), fits("begin").alias("begins"), fits("finish").alias("finishes"))


_NOTE = """replace(replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '|', '/'), '<', '&lt;'), '>', '&gt;')"""


@query(f"SELECT id, {_NOTE} AS shown FROM {values('notes')} UNION ALL SELECT CAST(-conv_id * 1000 - turn AS INTEGER), {_NOTE} FROM conversations")
def note_normalise(spark, d):
    said = spark.read.parquet(f"{d}/conversations.parquet").select((-F.col("conv_id") * 1000 - F.col("turn")).cast("int").alias("id"), "text")
    return table(spark, "notes").unionByName(said).select("id", X.note_shown(F.col("text")).alias("shown"))


@query(f"""SELECT id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' OR length(text) > 600 OR regexp_matches(text, '{_SECRET}') THEN 'note_missing_too_long_or_possible_secret'
  WHEN regexp_matches(text, '{_CONTACT}') THEN 'note_contains_personal_contact' ELSE 'ok' END AS result
FROM (SELECT * FROM {values('notes')} UNION ALL SELECT CAST(-conv_id * 1000 - turn AS INTEGER), text FROM conversations)""")
def note_validate(spark, d):
    said = spark.read.parquet(f"{d}/conversations.parquet").select((-F.col("conv_id") * 1000 - F.col("turn")).cast("int").alias("id"), "text")
    return table(spark, "notes").unionByName(said).select("id", F.coalesce(X.note_problem(F.col("text")), F.lit("ok")).alias("result"))


@query(f"SELECT id, regexp_replace(text, chr(13) || chr(10), chr(10), 'g') AS text FROM {values('newlines')}")
def newline_normalise(spark, d):
    return table(spark, "newlines").select("id", X.unix_lines(F.col("text")).alias("text"))


@query(f"""SELECT id, CASE WHEN len(string_split(text, '<!-- managed:begin -->')) <> 2 OR len(string_split(text, '<!-- managed:end -->')) <> 2 THEN 'handoff_markers_invalid'
  WHEN regexp_matches(text, '(?s)end -->.*begin -->') THEN 'ValueError' ELSE 'ok' END AS state,
  CASE WHEN len(string_split(text, '<!-- managed:begin -->')) = 2 AND len(string_split(text, '<!-- managed:end -->')) = 2 AND NOT regexp_matches(text, '(?s)end -->.*begin -->')
  THEN replace(string_split(text, '<!-- managed:begin -->')[1] || '<!-- managed:begin --><!-- managed:end -->' || string_split(text, '<!-- managed:end -->')[2], chr(13) || chr(10), chr(10)) END AS outside
FROM {values('regions')}""")
def managed_region(spark, d):
    return table(spark, "regions").select("id", X.region_state(X.unix_lines(F.col("text"))).alias("state"), X.outside_region(F.col("text")).alias("outside"))


@query(f"SELECT id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, '^'), lambda x: x <> ''))), ',') AS entries FROM {values('nul_lists')}")
def nul_list_parse(spark, d):
    return table(spark, "nul_lists").select("id", F.array_join(X.nul_list(F.replace("text", F.lit("^"), F.lit("\0"))), ",").alias("entries"))


@query(f"""SELECT id, coalesce(string_agg(k || '=' || v, ',' ORDER BY k), '') AS attributes FROM (
  SELECT id, p[3 * i + 2] AS k, p[3 * i + 3] AS v FROM (SELECT id, string_split(text, '^') AS p, unnest(range(0, len(string_split(text, '^')) // 3)) AS i FROM {values('nul_attrs')})) GROUP BY id""")
def attr_triples(spark, d):
    pairs = F.array_sort(F.map_entries(X.nul_triples(F.replace("text", F.lit("^"), F.lit("\0")))))
    return table(spark, "nul_attrs").select("id", F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("attributes"))


@query(f"SELECT id, regexp_extract(line, '^([0-9a-f]{{40,64}})\\s+' || ref || '$', 1) AS head FROM {values('remotes')}")
def remote_head_shape(spark, d):
    return table(spark, "remotes").select("id", F.coalesce(P.remote_head(F.col("line"), F.col("ref")), F.lit("")).alias("head"))


@query(f"SELECT s.id, u.p AS path FROM {values('scopes')} s, LATERAL (SELECT unnest(list_filter(allow, lambda x: list_contains(tracked, x))) AS p UNION SELECT unnest(new) UNION SELECT handoff) u")
def snapshot_scope(spark, d):
    scope = S.snapshot_scope(S.paths("allow"), S.paths("new"), S.paths("tracked"), F.col("handoff"))
    return table(spark, "scopes").select("id", F.explode(scope).alias("path"))


@query(f"SELECT id, unnest(list_filter(dirty, lambda x: NOT list_contains(claimed, x))) AS path FROM {values('scopes')}")
def unclaimed_paths(spark, d):
    return table(spark, "scopes").select("id", F.explode(F.array_except(S.paths("dirty"), S.paths("claimed"))).alias("path"))


@query(f"SELECT id, list_has_any(staged, list_append(claimed, handoff)) AS staged_owned FROM {values('scopes')}")
def staged_owned(spark, d):
    owned = F.array_union(S.paths("claimed"), F.array("handoff"))
    return table(spark, "scopes").select("id", F.coalesce(F.arrays_overlap(S.paths("staged"), owned), F.lit(False)).alias("staged_owned"))


@query(f"SELECT id, list_sort(list_distinct(dirty)) = list_sort(list_distinct(claimed)) AS same FROM {values('scopes')}")
def path_set_equal(spark, d):
    return table(spark, "scopes").select("id", S.same_set(S.paths("dirty"), S.paths("claimed")).alias("same"))


def _fps(a: str, b: str) -> str:
    f = values("fingerprints")
    return f"""SELECT c.task_id, c.path FROM {f} c LEFT JOIN (SELECT * FROM {f} WHERE kind = '{a}') x USING (task_id, path) LEFT JOIN (SELECT * FROM {f} WHERE kind = '{b}') y USING (task_id, path)
WHERE c.kind = 'claimed' AND x.fp IS DISTINCT FROM y.fp"""


def _differing(spark: SparkSession, a: str, b: str) -> DataFrame:
    """Claimed paths whose fingerprints differ, as joins on (task, path)."""
    f = table(spark, "fingerprints")
    kind = lambda k: f.where(F.col("kind") == k).select("task_id", "path", F.col("fp").alias(k))
    joined = f.where("kind = 'claimed'").select("task_id", "path").join(kind(a), ["task_id", "path"], "left").join(kind(b), ["task_id", "path"], "left")
    return joined.where(~F.col(a).eqNullSafe(F.col(b))).select("task_id", "path")


@query(_fps("current", "baseline"))
def changed_paths(spark, d):
    return _differing(spark, "current", "baseline")


@query(_fps("current", "verified"))
def changed_after_verify(spark, d):
    return _differing(spark, "current", "verified")


@query(f"""SELECT a.id, EXISTS (SELECT 1 FROM {values('task_spans')} b WHERE a.id <> b.id AND a.begin_seq < coalesce(b.finish_seq, 4611686018427387904) AND b.begin_seq < coalesce(a.finish_seq, 4611686018427387904)) AS overlap FROM {values('task_spans')} a
UNION ALL SELECT 'u' || a.user_id, bool_or(b.user_id IS NOT NULL) FROM (SELECT user_id, min(event_id) AS s, max(event_id) AS e FROM events GROUP BY user_id) a
LEFT JOIN (SELECT user_id, min(event_id) AS s, max(event_id) AS e FROM events GROUP BY user_id) b ON a.user_id <> b.user_id AND a.s < b.e AND b.s < a.e GROUP BY ALL""")
def overlap_tasks(spark, d):
    spans = _log(spark, d).groupBy("user_id").agg(F.min("seq").alias("begin_seq"), F.max("seq").alias("finish_seq"))
    own = decide.overlaps(spans.select(F.concat(F.lit("u"), "user_id").alias("id"), "begin_seq", "finish_seq"))
    return decide.overlaps(table(spark, "task_spans")).unionByName(own)


@query(f"""
WITH p AS (SELECT *, unnest(asked) AS path, unnest(range(0, len(asked))) AS pos, false AS linked, false AS outside FROM {values('claims')}),
r AS (SELECT id, pos, CASE WHEN {_PATH_CASE} <> 'ok' THEN {_PATH_CASE} WHEN NOT (list_contains(allow, path) OR list_contains(new, path)) OR path = handoff THEN 'path_not_explicitly_allowlisted'
  WHEN NOT list_contains(map_keys(baseline), path) THEN 'new_path_not_approved_before_begin' WHEN list_contains(new, path) AND NOT list_contains(tracked, path) AND baseline[path] IS NOT NULL THEN 'preexisting_untracked_file'
  WHEN current[path] IS DISTINCT FROM baseline[path] THEN 'claim_must_precede_edit' END AS why FROM p),
f AS (SELECT id, arg_min(why, pos) FILTER (why IS NOT NULL) AS why FROM r GROUP BY id)
SELECT c.id, CASE WHEN status <> 'active' THEN 'task_not_active' ELSE coalesce(f.why, 'claimed') END AS result,
  array_to_string(CASE WHEN status = 'active' AND f.why IS NULL THEN list_sort(list_distinct(list_concat(claimed, asked))) ELSE list_sort(claimed) END, ',') AS claimed
FROM {values('claims')} c LEFT JOIN f USING (id)
""")
def claim_audit(spark, d):
    return decide.claim_audit(table(spark, "claims")).withColumn("claimed", F.array_join("claimed", ","))


@query(f"""SELECT id, CASE WHEN status = 'active' AND value IN ('passed', 'not_required', 'failed', 'not_run') THEN value ELSE 'invalid_verification' END AS verification,
  CASE WHEN status = 'active' AND value IN ('passed', 'not_required', 'failed', 'not_run') THEN coalesce(array_to_string(list_transform(claimed, lambda p: p || '=' || coalesce(current[p], '-')), ','), '') END AS snapshot FROM {values('verifications')}""")
def verify_record(spark, d):
    out = decide.verify(table(spark, "verifications"))
    pairs = F.transform(F.map_entries("verified_snapshot"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("-"))))
    return out.select("id", "verification", F.when(F.col("verified_snapshot").isNotNull(), F.array_join(pairs, ",")).alias("snapshot"))


@query(f"""
WITH t AS MATERIALIZED (SELECT *, list_filter(claimed, lambda p: current[p] IS DISTINCT FROM baseline[p]) AS ch FROM {values('eligibility')}),
q AS (SELECT id, unnest(ch) AS p, unnest(range(0, len(ch))) AS pos, current, contents FROM t),
w AS (SELECT id, arg_min(CASE WHEN current[p] IS NULL THEN 'deletion_requires_manual_commit' ELSE 'possible_secret' END, pos) AS why FROM q WHERE current[p] IS NULL OR regexp_matches(contents[p], '{_SECRET}') GROUP BY id),
e AS MATERIALIZED (SELECT t.*, w.why, CASE WHEN outcome <> 'completed' OR coalesce(enabled, false) = false THEN NULL WHEN NOT starts_with(now_branch, 'codex/') THEN 'codex_branch_required'
  WHEN now_branch = branch AND now_head = head AND len(baseline_dirty) = 0 AND NOT overlap AND has_notes AND verification IN ('passed', 'not_required') THEN unreadable END AS error FROM t LEFT JOIN w USING (id)),
r AS (SELECT *, CASE WHEN error IS NOT NULL THEN NULL WHEN outcome <> 'completed' THEN 'interrupted_or_unknown' WHEN coalesce(enabled, false) = false THEN 'paused'
  WHEN now_branch <> branch OR now_head <> head THEN 'head_or_branch_changed' WHEN len(baseline_dirty) > 0 THEN 'baseline_dirty' WHEN overlap THEN 'overlapping_tasks' WHEN NOT has_notes THEN 'handoff_notes_missing'
  WHEN verification NOT IN ('passed', 'not_required') THEN 'verification_missing_or_failed' WHEN len(list_filter(dirty, lambda p: NOT list_contains(claimed, p))) > 0 THEN 'unclaimed_changes'
  WHEN current[handoff] IS DISTINCT FROM baseline[handoff] THEN 'handoff_manual_edit' WHEN len(list_filter(claimed, lambda p: current[p] IS DISTINCT FROM verified[p])) > 0 THEN 'changed_after_verification'
  WHEN list_has_any(staged, list_append(ch, handoff)) THEN 'user_staged_owned_path' WHEN why IS NOT NULL THEN why ELSE 'eligible' END AS reason FROM e)
SELECT id, error, reason, CASE WHEN reason = 'eligible' THEN coalesce(array_to_string(ch, ','), '') ELSE '' END AS changed FROM r
""")
def eligibility_cascade(spark, d):
    return decide.eligibility(table(spark, "eligibility")).withColumn("changed", F.array_join("changed", ","))


@query(f"""SELECT id, CASE WHEN status <> 'active' THEN 'duplicate' WHEN error IS NOT NULL THEN 'error' WHEN dry_run THEN 'dry_run' ELSE 'finished' END AS kind,
  CASE WHEN status <> 'active' OR error IS NOT NULL OR dry_run THEN status WHEN outcome = 'completed' THEN 'completed' ELSE 'interrupted' END AS status,
  CASE WHEN status <> 'active' THEN result ELSE coalesce(error, reason) END AS result,
  CASE WHEN status = 'active' AND error IS NULL AND NOT dry_run THEN coalesce(array_to_string(paths, ','), '') END AS changed,
  CASE WHEN status = 'active' AND error IS NULL AND NOT dry_run THEN id || ':finish' END AS event FROM {values('finishes')}""")
def finish_transition(spark, d):
    return decide.finish(table(spark, "finishes")).withColumn("changed", F.array_join("changed", ","))


@query(f"""SELECT id, CASE WHEN NOT coalesce(enabled, false) OR NOT coalesce(push_enabled, false) THEN 'push_paused'
  WHEN (root, url, branch) IS DISTINCT FROM (own_root, own_url, own_branch) THEN 'push_destination_not_authorized' WHEN remotes IS DISTINCT FROM ['origin'] THEN 'unexpected_remote_set' WHEN urls IS DISTINCT FROM [own_url] THEN 'unexpected_origin_url'
  WHEN list_has_any(settings, ['remote.origin.pushurl', 'remote.origin.push', 'remote.origin.mirror', 'remote.origin.receivepack', 'remote.pushdefault']) THEN 'unexpected_push_config'
  WHEN len(list_filter(settings, lambda s: s LIKE 'url.%.insteadof' OR s LIKE 'url.%.pushinsteadof')) > 0 THEN 'url_rewrite_or_config_error' ELSE 'authorized' END AS result FROM {values('destinations')}""")
def destination_audit(spark, d):
    return publish.destination_audit(table(spark, "destinations"))


@query(f"""
WITH t AS (SELECT *, list_sort(list_distinct(list_append(changed, handoff))) AS want, list_sort(list_distinct(actual)) AS got FROM {values('publications')}),
q AS (SELECT id, got AS g, unnest(got) AS path, unnest(range(0, len(got))) AS pos, allowed, handoff, contents, false AS linked, false AS outside FROM t),
w AS (SELECT id, arg_min(why, pos) FILTER (why IS NOT NULL) AS why FROM (SELECT id, pos, CASE WHEN {_PATH_CASE} <> 'ok' THEN {_PATH_CASE} WHEN NOT list_contains(list_append(allowed, handoff), path) THEN 'push_path_no_longer_authorized'
  WHEN strlen(contents[path]) > 64 OR regexp_matches(contents[path], '{_SECRET}') THEN 'push_unsafe_content' END AS why FROM q) GROUP BY id),
r AS (SELECT t.*, w.why, CASE WHEN status <> 'completed' OR coalesce("commit", '') = '' THEN 'task_has_no_completed_commit' WHEN coalesce(push_status, '') NOT IN ('pending', 'failed', 'unknown', 'verified') THEN 'task_created_without_push_authorization' END AS raised FROM t LEFT JOIN w USING (id))
SELECT id, raised, CASE WHEN raised IS NOT NULL THEN NULL WHEN destination <> 'authorized' THEN destination WHEN now_branch <> own_branch OR now_head <> "commit" OR branch <> now_branch THEN 'push_head_or_branch_changed'
  WHEN any_active THEN 'push_has_active_task' WHEN ancestry <> [now_head, head] THEN 'push_unauthorized_ancestry' WHEN want <> got THEN 'push_unauthorized_paths' WHEN why IS NOT NULL THEN why
  WHEN remote NOT IN (head, now_head) THEN 'push_remote_not_task_baseline' WHEN push_status = 'verified' AND remote <> now_head THEN 'push_previously_verified_remote_changed'
  WHEN "after" IS DISTINCT FROM now_head THEN 'push_remote_verification_mismatch' WHEN remote = now_head THEN 'already_there' ELSE 'send' END AS result FROM r
""")
def publication_audit(spark, d):
    return publish.publication_audit(table(spark, "publications"), limit=64)


@query(f"""
WITH t AS (SELECT *, audit IN ('send', 'already_there') AS fine, audit = 'send' OR (audit = 'push_remote_verification_mismatch' AND remote <> "commit") AS sent FROM {values('publication_states')})
SELECT id, CASE WHEN fine THEN 'pushed' WHEN push_status = 'verified' AND NOT sent THEN 'retry_refused' ELSE 'push_failed' END AS result, CASE WHEN fine OR (push_status = 'verified' AND NOT sent) THEN 'verified' ELSE 'failed' END AS push_status,
  CAST(coalesce(push_attempts, 0) + CASE WHEN sent THEN 1 ELSE 0 END AS INTEGER) AS push_attempts, CASE WHEN NOT fine THEN audit END AS push_error, CASE WHEN fine THEN "commit" END AS remote_commit FROM t
""")
def publication_state(spark, d):
    return publish.publication_state(table(spark, "publication_states"))


@query(f"SELECT command, journal, CASE WHEN journal LIKE '{{%' AND command NOT IN ('status', 'pause', 'disable') THEN 'unresolved_commit_journal_requires_review' ELSE 'ok' END AS result FROM {values('journals')}")
def journal_gate(spark, d):
    return publish.journal_gate(table(spark, "journals"))


@query(f"""SELECT id, CASE WHEN len(list_filter(map_values(contents), lambda t: t IS NULL OR regexp_matches(t, '{_SECRET}'))) > 0 THEN 'unsafe_commit_content' WHEN index_locked THEN 'git_index_busy'
  WHEN (now_branch, now_head) <> (branch, head) THEN 'head_or_branch_changed' WHEN list_has_any(staged, paths) THEN 'user_staged_owned_path'
  WHEN len(list_filter(attributes, lambda a: a['text'] <> 'set' OR a['eol'] <> 'lf' OR a['filter'] <> 'unspecified' OR a['working-tree-encoding'] <> 'unspecified')) > 0 THEN 'unsupported_git_attributes'
  WHEN len(list_filter(modes, lambda m: m NOT IN ('100644', '100755'))) > 0 THEN 'non_regular_git_entry' WHEN NOT files_after_same THEN 'files_changed_during_commit' WHEN NOT index_after_same THEN 'index_changed_during_commit' ELSE 'ok' END AS result FROM {values('commits')}""")
def commit_preconditions(spark, d):
    return publish.commit_preconditions(table(spark, "commits"))


@query(f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY started DESC, seq DESC) - 1 AS r FROM {values('report_tasks')} QUALIFY r < 12)
SELECT CAST(r * 10 AS INTEGER) AS pos, '| ' || replace(started, ' ', 'T') || '+00:00 | ' || app || ' | `' || id || '` | ' || status || ' / ' || result || CASE WHEN push_error IS NULL THEN '' ELSE ' / ' || push_error END || ' | ' || verification || ' | '
  || CASE WHEN len(changed) > 0 THEN array_to_string(changed, ', ') WHEN len(claimed) > 0 THEN array_to_string(claimed, ', ') ELSE '—' END || ' |' AS line FROM t
UNION ALL
SELECT CAST(1000 + r * 10 + k AS INTEGER), CASE k WHEN 0 THEN '' WHEN 1 THEN '**' || app || ' / ' || id || '**' WHEN 2 THEN '- summary: ' || notes.summary WHEN 3 THEN '- evidence: ' || notes.evidence WHEN 4 THEN '- remaining: ' || notes.remaining ELSE '- next_step: ' || notes.next_step END
FROM t, range(0, 6) x(k) WHERE notes IS NOT NULL
""")
def report_lines(spark, d):
    return report.report_lines(table(spark, "report_tasks"))


@query(f"SELECT seq, id, app, status, result, CAST(NULL AS VARCHAR) AS commit_sha, array_to_string(claimed, ',') AS claimed, verification, push_error FROM {values('report_tasks')} ORDER BY seq DESC LIMIT 12")
def status_json(spark, d):
    tasks = table(spark, "report_tasks")
    empty = [F.lit(None).cast("string").alias(c) for c in ("commit", "push_status", "remote_commit", "push_verified_at")]
    out = report.status(tasks.select("seq", "id", "app", "status", "result", "claimed", "verification", "push_error", *empty))
    back = F.from_json("json", "id string, app string, status string, result string, commit string, claimed array<string>, verification string, push_error string")
    row = out.select("seq", back.alias("t"))
    return row.select("seq", "t.id", "t.app", "t.status", "t.result", F.col("t.commit").alias("commit_sha"), F.array_join("t.claimed", ",").alias("claimed"), "t.verification", "t.push_error")


@query(f"""SELECT CASE WHEN expected_root IS DISTINCT FROM '/work/here' THEN 'expected_root_mismatch' END AS error, handoff, array_to_string(tracked_paths, ',') AS tracked_paths, coalesce(array_to_string(approved_new_paths, ','), '') AS approved_new_paths,
  coalesce(max_file_bytes, 1048576) AS max_file_bytes, coalesce(push_enabled, false) AS push_enabled FROM {values('policies')}""")
def policy_read(spark, d):
    raw = table(spark, "policies").withColumn("push", F.struct(F.col("push_enabled").alias("enabled"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("branch"))).drop("push_enabled")
    out = policy_fields(raw, "/work/here")
    return out.withColumns({c: F.array_join(c, ",") for c in ("tracked_paths", "approved_new_paths")})


_BEGIN = """SELECT r.id, CASE WHEN NOT regexp_full_match(r.id, '[A-Za-z0-9_.:@-]{{1,160}}') OR NOT regexp_full_match(coalesce(nullif(session, ''), r.id), '[A-Za-z0-9_.:@-]{{1,160}}') THEN 'invalid_identifier'
  WHEN coalesce(app, '') NOT IN ('agent', 'manual') THEN 'unknown_app' WHEN s.id IS NOT NULL THEN 'existing' WHEN p.id IS NOT NULL THEN 'pending_task_retry_push:' || p.id
  WHEN length(r.id) > 154 THEN 'invalid_identifier' ELSE 'begins' END AS result
FROM {0} r LEFT JOIN {1} s USING (id) LEFT JOIN (SELECT id FROM {1} WHERE push_status IN ('pending', 'failed', 'unknown') ORDER BY seq LIMIT 1) p ON true"""


@query(" UNION ALL ".join(f"SELECT {k} AS k, * FROM ({_BEGIN.format(values('begins'), values(s))})" for k, s in enumerate(("states", "quiet_states"))))
def begin_audit(spark, d):
    found = [decide.begin_audit(table(spark, "begins"), table(spark, s), ("agent", "manual")).select(F.lit(k).alias("k"), "*") for k, s in enumerate(("states", "quiet_states"))]
    return found[0].unionByName(found[1])


_FIELDS = decide.NOTE_FIELDS
_FAULT = ", ".join(
    f"""CASE WHEN trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g')) = '' OR length({c}) > 600 OR regexp_matches({c}, '{_SECRET}') THEN 'note_missing_too_long_or_possible_secret' WHEN regexp_matches({c}, '{_CONTACT}') THEN 'note_contains_personal_contact' END"""
    for c in _FIELDS
)


@query(f"""WITH r AS (SELECT *, CASE WHEN status <> 'active' THEN 'task_not_active' ELSE coalesce({_FAULT}, 'notes_recorded') END AS result FROM {values('note_requests')})
SELECT id, result, {', '.join(f"CASE WHEN result = 'notes_recorded' THEN {_NOTE.replace('text', c)} END AS {c}" for c in _FIELDS)} FROM r""")
def note_record(spark, d):
    return decide.record_notes(table(spark, "note_requests"))


@query(f"""SELECT id, array_to_string(list_sort(CASE WHEN regexp_replace(at_head, 'begin -->.*<!-- managed:end', '') = regexp_replace(at_hand, 'begin -->.*<!-- managed:end', '') AND contains(at_head, 'managed:begin')
  THEN list_filter(dirty, lambda x: x <> handoff) ELSE dirty END), ',') AS dirty FROM {values('dirty_lists')}""")
def dirty_exemption(spark, d):
    t = table(spark, "dirty_lists")
    return t.select("id", F.array_join(X.dirty_paths(S.paths("dirty"), F.col("handoff"), F.col("at_head"), F.col("at_hand")), ",").alias("dirty"))


@query(f"""SELECT json_extract_string(body, '$.id') AS id, max(seq) AS seq, arg_max(json_extract_string(body, '$.status'), seq) AS status, arg_max(coalesce(CAST(json_extract(body, '$.push_attempts') AS INTEGER), 0), seq) AS push_attempts,
  arg_max(coalesce(json_extract_string(body, '$.notes.summary'), ''), seq) AS summary FROM {values('bodies')} GROUP BY ALL""")
def task_bodies(spark, d):
    log = L.decoded(table(spark, "bodies"), TASK).select("seq", F.col("task.id").alias("id"), "task")
    state = L.latest(log, "id")
    return state.select("id", "seq", "task.status", F.coalesce("task.push_attempts", F.lit(0)).alias("push_attempts"), F.coalesce("task.notes.summary", F.lit("")).alias("summary"))


@query(f"""SELECT id, CASE WHEN len(string_split(text, '<!-- managed:begin -->')) = 2 AND len(string_split(text, '<!-- managed:end -->')) = 2 AND NOT regexp_matches(text, '(?s)end -->.*begin -->')
  THEN string_split(text, '<!-- managed:begin -->')[1] || '<!-- managed:begin -->' || chr(10) || chr(10) || 'lines' || chr(10) || chr(10) || '<!-- managed:end -->' || string_split(text, '<!-- managed:end -->')[2] END AS text FROM {values('regions')}""")
def report_in_place(spark, d):
    return table(spark, "regions").select("id", X.filled_region(F.col("text"), F.lit("lines")).alias("text"))


@query(f"""WITH a AS (SELECT id, ref, answer, len(answer) - len(replace(answer, chr(10), '')) + CASE WHEN answer <> '' AND NOT ends_with(answer, chr(10)) THEN 1 ELSE 0 END AS n,
  regexp_extract(answer, '^([0-9a-f]{{40,64}})\\s+' || ref || '\\s*$', 1) AS head FROM {values('remote_answers')})
SELECT id, CASE WHEN n = 1 AND head <> '' THEN head END AS head, CASE WHEN n <> 1 THEN 'remote_branch_missing_or_ambiguous' WHEN head = '' THEN 'remote_branch_response_invalid' END AS error FROM a""")
def remote_answer(spark, d):
    return table(spark, "remote_answers").select("id", P.remote_answer(F.col("answer"), F.col("ref")).alias("a")).select("id", "a.head", "a.error")


@query(f"SELECT id, 'research: ' || app || ' task ' || left(id, 48) || chr(10) AS message FROM {values('messages')}")
def commit_message(spark, d):
    return table(spark, "messages").select("id", P.commit_message(F.col("app"), F.col("id")).alias("message"))


@query(f"""WITH t AS (SELECT * FROM {values('report_tasks')} ORDER BY seq DESC LIMIT 12)
SELECT (SELECT any_value(value) = 'true' FROM {values('meta')} WHERE key = 'enabled') AS enabled, '/work/here' AS expected_root, p.enabled AS push_enabled, p.url AS push_url, p.branch AS push_branch,
  (SELECT nullif(any_value(value), 'null') FROM {values('meta')} WHERE key = 'commit_journal') AS commit_journal,
  (SELECT string_agg(id || ' ' || status || ' ' || result || ' ' || coalesce(push_error, '-'), ',' ORDER BY seq DESC) FROM t) AS tasks FROM {values('push_policies')} p""")
def status_document(spark, d):
    empty = [F.lit(None).cast("string").alias(c) for c in ("commit", "push_status", "remote_commit", "push_verified_at")]
    policy = table(spark, "push_policies").select(F.struct("*").alias("push"))
    out = report.status_document(table(spark, "report_tasks").select("*", *empty), table(spark, "meta"), policy, "/work/here")
    shown = F.transform("tasks", lambda t: F.concat_ws(" ", t["id"], t["status"], t["result"], F.coalesce(t["push_error"], F.lit("-"))))
    push = [F.col(f"push_policy.{c}").alias(f"push_{c}") for c in ("enabled", "url", "branch")]
    return out.select("enabled", "expected_root", *push, "commit_journal", F.array_join(shown, ",").alias("tasks"))


@query("SELECT user_id, count(*) AS saves, bool_or(dayofyear(ts) % 2 = 0) AS last_even FROM events GROUP BY user_id")
def log_appended(spark, d):
    """The events of even days saved after those of odd ones, and read back from the log: the last save of each user."""
    columns, folder = "event_id bigint, user_id bigint, even boolean", work_folder(spark, "log")
    events = spark.read.parquet(f"{d}/events.parquet").withColumn("even", F.dayofyear("ts") % 2 == 0)
    for even in (False, True):
        append_log(events.where(F.col("even") == even), folder, columns)
    log = read_log(spark, folder, columns)
    saves = log.groupBy("user_id").agg(F.count(F.lit(1)).alias("saves"))
    return L.latest(log, "user_id").select("user_id", F.col("even").alias("last_even")).join(saves, "user_id").select("user_id", "saves", "last_even")
