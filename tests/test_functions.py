"""Column functions against expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import paths as P
from ledgerspark.functions import text as X


def column(spark, values, f, kind="string"):
    table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in table.orderBy("k").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "text, secret",
    [
        ("token\u00a0= \"abcdefghijklmnop\"", True),
        ("to\u212aen = 'abcdefghijklmnop'", True),
        ("\u00e9ghp_" + "a" * 20, False),
        ("x ghp_" + "a" * 20, True),
        ("GHP_" + "a" * 20, True),
        ("sk-" + "a" * 23, False),
        ("sk-" + "a" * 24, True),
        ("-----BEGIN RSA PRIVATE KEY-----", True),
        ("password = \"short\"", False),
        ("API-KEY: 'abcdefghijklmnop'", True),
        ("plain words", False),
    ],
)
def test_secret(spark, text, secret):
    assert column(spark, [text], X.has_secret) == [secret]


@pytest.mark.parametrize(
    "text, contact",
    [
        ("\u00e9\u00e9@x.io", True),
        ("010-\u0661\u0662\u0663\u0664-\u0665\u0666\u0667\u0668", True),
        ("\uac00010-1234-5678", False),
        ("call 0161234567", True),
        ("a@b", False),
        ("012-1234-5678", False),
    ],
)
def test_contact(spark, text, contact):
    assert column(spark, [text], X.has_contact) == [contact]


def test_notes(spark):
    assert column(spark, ["a\u00a0\x1cb  c", "|<>&", " x "], X.note_shown) == ["a b c", "/&lt;&gt;&", "x"]
    refused = "note_missing_too_long_or_possible_secret"
    assert column(spark, ["\u00a0\x1f", "x" * 600, "x" * 601, "\U0001f600" * 600, "me@example.org"], X.note_problem) == [refused, None, refused, None, "note_contains_personal_contact"]


def test_regions(spark):
    s, e = X.REGION_START, X.REGION_END
    texts = [f"a{s}x{e}b", f"a{s}{e}{e}", f"{e}{s}", f"{s}\r\n{e}\r\n\r"]
    assert column(spark, texts, X.region_state) == ["ok", "handoff_markers_invalid", "ValueError", "ok"]
    assert column(spark, texts, X.outside_region) == [f"a{s}{e}b", None, None, f"{s}{e}\n\r"]


def test_fingerprint_ignores_the_managed_region_of_the_handoff_only(spark):
    s, e = X.REGION_START, X.REGION_END
    two = [f"\ufeffa{s}x{e}\r\n", f"a{s}yy{e}\n"]
    hand = column(spark, two, lambda v: X.fingerprint(F.lit("h.md"), v, F.lit("h.md")))
    file = column(spark, two, lambda v: X.fingerprint(F.lit("a.md"), v, F.lit("h.md")))
    assert hand[0] == hand[1] and file[0] != file[1]
    assert column(spark, [None], lambda v: X.fingerprint(F.lit("a.md"), v, F.lit("h.md"))) == [None]


def test_content_guards(spark):
    assert column(spark, ["ok", "a\0b", "x" * 11, "\u00e9" * 6], lambda v: X.content_problem(v, 10)) == [None, "binary_file", "file_too_large_or_not_regular", "file_too_large_or_not_regular"]


PATHS = {
    "a.md:stream": "invalid_path", "C:/a.md": "invalid_path", "bad|name.md": "invalid_path", None: "invalid_path", "a\rb.md": "invalid_path",
    "../escape.md": "path_traversal", "/a.md": "path_traversal", "a//b.md": "path_traversal", "./a.md": "path_traversal", "": "path_traversal", "a /b.md": "path_traversal", "a.md.": "path_traversal",
    "data/a.md": "forbidden_file_type_or_directory", "raw/a.py": "forbidden_file_type_or_directory", "a.csv": "forbidden_file_type_or_directory", ".git/a.md": "forbidden_file_type_or_directory",
    "LOGS/a.md": "forbidden_file_type_or_directory", ".md": "forbidden_file_type_or_directory", "a": "forbidden_file_type_or_directory",
    "tools/backdoor.py": "automation_control_path", "AGENTS.md": "automation_control_path", "GEMINI.md": "automation_control_path", ".codex/x.md": "automation_control_path",
    "a.md": "ok", "agents.md": "ok", "x/tools/a.py": "ok", "A.TXT": "ok", "a.tar.md": "ok",
}


def test_paths(spark):
    assert dict(zip(PATHS, column(spark, list(PATHS), P.path_class))) == PATHS


def test_idents(spark):
    values = ["ok", "a b", "", None, "x" * 160, "x" * 161, "ok\n"]
    assert column(spark, values, P.is_ident) == [True, False, False, False, True, False, False]
    lengths = [153, 154, 155]
    assert column(spark, ["x" * n for n in lengths], lambda v: P.event_ident_fits(v, "begin")) == [True, True, False]
    assert column(spark, ["x" * n for n in lengths], lambda v: P.event_ident_fits(v, "finish")) == [True, False, False]
    assert column(spark, ["t" * 60], lambda v: P.commit_message(F.lit("app"), v)) == ["research: app task " + "t" * 48 + "\n"]


def test_now(spark):
    import re

    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", spark.range(1).select(X.now()).first()[0])


def test_filled_region_changes_nothing_else(spark):
    s, e = X.REGION_START, X.REGION_END
    assert column(spark, [f"a{s}old{e}b", "none"], lambda v: X.filled_region(v, F.lit("new"))) == [f"a{s}\n\nnew\n\n{e}b", None]


def test_gates_let_every_match_through(spark):
    """Secrets and contacts in any case of letters, with the signs that count as k and s there."""
    import re

    texts = ["-----BEGIN PRIVATE KEY-----", "-----begIn rsa prıvate Key-----", "GHP_" + "a" * 20, "ghſ_" + "a" * 20, "gİthub_pat_" + "a" * 20, "GITHUB_PAT_" + "a" * 20, "ſK-" + "a" * 24,
             "API-KEY: '" + "a" * 16 + "'", 'paſſword="' + "a" * 16 + '"', "Secret = '" + "B" * 16 + "'", "tOken:'" + "c" * 16 + "'", "key", "a@b.cd", "010-1234-5678", "01 0", "@", "", "plain"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    from pyspark.sql import functions as F

    from ledgerspark.functions import text as X

    plain = rows.select("k", F.rlike("t", F.lit(f"(?iuU){X.SECRET}")).alias("s"), F.rlike("t", F.lit(f"(?U){X.CONTACT}")).alias("c")).collect()
    gated = rows.select("k", X.has_secret(F.col("t")).alias("s"), X.has_contact(F.col("t")).alias("c")).collect()
    assert sorted(plain) == sorted(gated) and sum(r.s for r in plain) >= 9
    assert all(r.s for r in plain if re.search(X.SECRET, texts[r.k], re.I))


def test_log(spark, tmp_path):
    from ledgerspark.sources.log import LOGS, append_log, read_log

    path = str(tmp_path / "meta")
    assert read_log(spark, path, LOGS["meta"]).count() == 0
    for value in ("true", "false", "null"):
        append_log(spark.createDataFrame([("enabled", value), ("x", value)], LOGS["meta"]), path, LOGS["meta"])
    rows = sorted(read_log(spark, path, LOGS["meta"]).collect())
    assert len({r.seq for r in rows}) == 6 and [r.value for r in rows if r.key == "enabled"] == ["true", "false", "null"]
