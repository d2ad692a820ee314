"""Line deduplication by winnowing over line hashes.

In every window of ``RUN`` consecutive lines the line with the least hash is
selected, so any run of that many lines that two places share has a selected
line, the same one, in both: the fingerprints are guaranteed. Lines of ``LONG``
characters or more are windows of their own and always selected, so a passage on
one line is found between any neighbours. Only the selected lines' places are
kept, with the hashes of the lines around them. Fingerprints that occur more than
once are joined by position; from each, the match is extended both ways by those
hashes, window by window, to the first place where the window stands. Windows
that match at successive offsets make a longer run, and the lines of all later
runs are deleted. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_groups, keyed, sieved, with_keys

RUN = 2
#: Characters of a line that counts as a run by itself.
LONG = 80


def _fingerprints(run: int, long: int) -> str:
    """SQL for the fingerprints of the array ``lines``: fp and ``own``, the windows (first line i, n lines, key)
    that selected it. A window's key is the hashes of its lines; a long line's a second hash too.
    Each ``transform(array(x), v -> ...)[0]`` evaluates x once."""
    part = f"slice(hs, i + 1, {run})"
    window = (
        f"named_struct('i', i, 'at', i + cast(array_position({part}, array_min({part})) as int) - 1, "
        f"'key', if(exists(slice(full, i + 1, {run}), x -> x), {part}, null))"
    )
    windows = f"if(size(ls) < {run}, array(), transform(sequence(0, greatest(size(ls) - {run}, 0)), i -> {window}))"
    own = f"transform(filter(slice(ws, greatest(p - {run - 1}, 0) + 1, {run}), w -> w.at = p and w.key is not null), w -> named_struct('i', w.i, 'n', {run}, 'key', w.key))"
    alone = f"if(full[p] and length(ls[p]) >= {long}, array(named_struct('i', p, 'n', 1, 'key', array(hs[p], xxhash64(reverse(ls[p]))))), array())"
    found = f"filter(transform(sequence(0, size(hs) - 1), p -> named_struct('fp', hs[p], 'own', concat({own}, {alone}))), f -> size(f.own) > 0)"
    hashes, full = "transform(ls, x -> xxhash64(x))", "transform(ls, x -> btrim(x, ' \\t\\r') <> '')"
    inner = f"transform(array({hashes}), hs -> transform(array({full}), full -> transform(array({windows}), ws -> {found})[0])[0])[0]"
    return f"transform(array(lines), ls -> {inner})[0]"


def later_windows(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", run: int = RUN, long: int = LONG) -> DataFrame:
    """``_f``, ``_r`` and ``starts``: the windows (i, n) of each row that stand somewhere before."""
    lines = F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n")
    held = keyed(docs, scratch, {"doc_id": F.col(f"`{ident}`").cast("long"), "lines": lines})
    marks = held.select("_f", "_r", "doc_id", F.explode(F.expr(_fingerprints(run, long))).alias("mark")).select("_f", "_r", "doc_id", "mark.fp", "mark.own")
    marks = scratch.write(marks, "marks")
    repeated = marks.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = join_groups(marks, scratch.write(repeated, "repeated"), "fp").select("doc_id", "_f", "_r", F.explode("own").alias("w"))
    places = scratch.write(places.select("w.key", F.struct("doc_id", "_f", "_r", "w.i").alias("place"), "w.n"), "places")
    firsts = places.groupBy("key").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    later = join_groups(places, scratch.write(firsts, "first"), "key", "times").where("place <> first")
    return later.groupBy("place._f", "place._r").agg(F.collect_list(F.struct("place.i", "n")).alias("starts"))


def cut_lines(docs: DataFrame, scratch: Scratch, text: str = "text", ident: str = "doc_id", run: int = RUN, long: int = LONG) -> DataFrame:
    """Each row as a struct ``row``, with ``kept`` (its text without later repeated runs),
    ``n_lines``, ``n_removed`` and ``n_runs`` (deleted runs that don't touch).

    Lines stand between line feeds; a null text is one empty line. A run counts
    if it has ``run`` lines or more, not all blank, or is one line of ``long``
    characters or more, and stands before in the order of id (null first), row
    and line; overlaps count too. Rows of the same id are separate texts. An empty table gives an empty result.
    """
    later = scratch.write(later_windows(docs, scratch, text, ident, run, long), "later")
    marked = sieved(with_keys(docs, scratch), later)
    lines = F.split(F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")), "\n")
    same = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit("")).alias("kept")
    zero = F.lit(0).cast("long")
    clean = marked.where("not suspect").select("row", same, F.size(lines).cast("long").alias("n_lines"), zero.alias("n_removed"), zero.alias("n_runs"))
    rest = marked.where("suspect").select("_f", "_r", "row").join(later, ["_f", "_r"], "left").withColumn("lines", lines)
    gone = f"array_distinct(flatten(transform(coalesce(starts, cast(array() as array<struct<i: int, n: int>>)), w -> sequence(w.i, w.i + w.n - 1))))"
    rest = rest.withColumn("gone", F.expr(gone))
    kept = "transform(array(lines), ls -> array_join(transform(array_except(sequence(0, size(ls) - 1), gone), j -> ls[j]), '\\n'))[0]"
    rest = rest.select(
        "row",
        F.expr(kept).alias("kept"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.expr("cast(size(gone) - size(array_intersect(gone, transform(gone, j -> j + 1))) as bigint)").alias("n_runs"),
    )
    return clean.unionByName(rest)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the runs of lines that stand before it."""
    cut = cut_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "lines"))
    return cut.select("row.doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i, array_to_string(lines[i + 1 : i + 2], chr(10)) AS w FROM (SELECT doc_id, lines, unnest(range(0, len(lines) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1 AS later FROM w WHERE trim(translate(w, chr(10) || chr(9) || chr(13), '   ')) <> ''
), l AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(0, len(lines))) AS j FROM d
), o AS (
  SELECT doc_id, j, row_number() OVER (PARTITION BY line ORDER BY doc_id, j) > 1 AS later FROM l WHERE length(line) >= 80 AND trim(translate(line, chr(9) || chr(13), '  ')) <> ''
), g AS (
  SELECT doc_id, unnest([i, i + 1]) AS j FROM r WHERE later UNION SELECT doc_id, j FROM o WHERE later
), k AS (
  SELECT l.doc_id, l.j, l.line, g.j IS NOT NULL AS gone, lag(g.j IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.j) AS before
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.j = g.j
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT before) AS n_runs,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
