"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, exact_dedup, html_text, licenses, line_dedup, minhash, mixing, quality, repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": html_text.op1_html_text,
    "op2_ann": ann.op2_ann,
    "op3_quality": quality.op3_quality,
    "op4_licenses": licenses.op4_licenses,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_bpe": bpe.op8_bpe,
    "op9_minhash": minhash.op9_minhash,
    "op10_repeats": repeats.op10_repeats,
    "license_base": licenses.license_base,
}

#: The others have no SQL form (fuzzy matching, trained models, sampled indexes,
#: the tokeniser); tests hold them against brute force or the library.
ORACLES: dict[str, str] = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_minhash": minhash.OP9_SQL,
    "op10_repeats": repeats.OP10_SQL,
    "license_base": licenses.BASE_SQL,
}
