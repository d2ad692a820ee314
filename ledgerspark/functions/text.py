"""Column functions over file contents and notes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a secret (in any case of letters) and as a personal
#: contact. Flags: i any case, u Unicode case, U Unicode classes and boundaries.
SECRET = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    r"|\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|sk-[A-Za-z0-9_-]{24,})"
    r"|(?:api[_-]?key|password|secret|token)\s*[:=]\s*[\"'][A-Za-z0-9_+/=-]{16,}[\"']"
)
CONTACT = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|\b01[016789][- ]?\d{3,4}[- ]?\d{4}\b"
#: Fixed value: white space as str.split() sees it.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: Bytes of a file, and characters of a note, at most.
MAX_FILE_BYTES = 1_048_576
MAX_NOTE = 600
REGION_START, REGION_END = "<!-- managed:begin -->", "<!-- managed:end -->"


#: Parts of which every secret holds one, in lower case; the second ones stand beside a quote.
#: None holds an i, which any case of letters takes for four characters.
SECRET_PARTS = ("-----beg", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "thub_pat_", "sk-")
QUOTED_PARTS = ("key", "password", "secret", "token")


def has_secret(text: Column) -> Column:
    """Few texts hold a part of a secret; only those are matched as a whole."""
    low = F.translate(F.lower(text), "\u017f", "s")  # the long s, which any case of letters takes for one
    some = lambda parts: reduce(or_, [F.contains(low, F.lit(p)) for p in parts])
    quoted = (F.contains(text, F.lit('"')) | F.contains(text, F.lit("'"))) & some(QUOTED_PARTS)
    return (some(SECRET_PARTS) | quoted) & F.rlike(text, F.lit(f"(?iuU){SECRET}"))


def has_contact(text: Column) -> Column:
    """Every contact holds one of two literals; only texts with one are matched as a whole."""
    return (F.contains(text, F.lit("@")) | F.contains(text, F.lit("01"))) & F.rlike(text, F.lit(f"(?U){CONTACT}"))


def unix_lines(text: Column) -> Column:
    """CRLF becomes LF; a lone CR stays."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def collapsed(text: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def count_of(text: Column, part: str) -> Column:
    """How often ``part`` occurs, matches not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def region_state(text: Column, start: str = REGION_START, end: str = REGION_END) -> Column:
    """``ok``; ``handoff_markers_invalid`` unless each marker stands once; ``ValueError`` if in the wrong order."""
    return (
        F.when((count_of(text, start) != 1) | (count_of(text, end) != 1), F.lit("handoff_markers_invalid"))
        .when(F.instr(text, end) < F.instr(text, start), F.lit("ValueError"))
        .otherwise(F.lit("ok"))
    )


def outside_region(text: Column, start: str = REGION_START, end: str = REGION_END) -> Column:
    """The text with LF line ends and nothing between its markers; null if they are not in order."""
    lines = unix_lines(text)
    emptied = F.concat(F.substring_index(lines, start, 1), F.lit(start + end), F.substring_index(lines, end, -1))
    return F.when(region_state(lines, start, end) == "ok", emptied)


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\ufeff", "")


def fingerprint(path: Column, text: Column, handoff: Column) -> Column:
    """SHA-256 of the bytes; of the hand-off document, of what people wrote in it. Null if absent."""
    return F.when(path == handoff, F.sha2(outside_region(without_bom(text)).cast("binary"), 256)).otherwise(F.sha2(text.cast("binary"), 256))


def content_problem(text: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """Why a file may not be read, if it may not: too long, or not text."""
    return F.when(F.octet_length(text) > limit, F.lit("file_too_large_or_not_regular")).when(F.contains(text, F.lit("\0")), F.lit("binary_file"))


def note_problem(text: Column) -> Column:
    """Why a note is refused, if it is: blank, too long or with a secret; or with a contact."""
    return (
        F.when((collapsed(text) == "") | (F.length(text) > MAX_NOTE) | has_secret(text), F.lit("note_missing_too_long_or_possible_secret"))
        .when(has_contact(text), F.lit("note_contains_personal_contact"))
    )


def note_shown(text: Column) -> Column:
    """A note as the report shows it."""
    return F.replace(F.replace(F.replace(collapsed(text), F.lit("|"), F.lit("/")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def nul_list(text: Column) -> Column:
    """The distinct non-empty entries of a NUL-separated list, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, "\0"), lambda x: x != "")))


def nul_triples(text: Column) -> Column:
    """Attribute to value, of NUL-separated triples of path, attribute and value."""
    parts = F.split(text, "\0")
    n = F.floor(F.size(parts) / 3).cast("int")
    pick = lambda k: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i * 3 + k))
    return F.when(n > 0, F.map_from_arrays(pick(1), pick(2))).otherwise(F.create_map().cast("map<string,string>"))


def now() -> Column:
    """UTC in whole seconds, as the log writes times; needs a session in UTC."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssxxx")


def dirty_paths(dirty: Column, handoff: Column, at_head: Column, at_hand: Column) -> Column:
    """The changed paths, sorted; the hand-off document does not count if only its managed region changed."""
    same = outside_region(without_bom(at_head)).eqNullSafe(outside_region(without_bom(at_hand))) & outside_region(without_bom(at_head)).isNotNull()
    rest = F.when(same, F.array_remove(dirty, handoff)).otherwise(dirty)
    return F.array_sort(F.array_distinct(rest))


def filled_region(text: Column, body: Column, start: str = REGION_START, end: str = REGION_END) -> Column:
    """The text with ``body`` between its markers; null if they are not in order."""
    fine = region_state(text, start, end) == "ok"
    return F.when(fine, F.concat(F.substring_index(text, start, 1), F.lit(start + "\n\n"), body, F.lit("\n\n" + end), F.substring_index(text, end, -1)))
