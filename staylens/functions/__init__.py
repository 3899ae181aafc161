"""Column-expression helpers (all JVM-side built-ins; no Python UDFs)."""

from staylens.functions.dates import parse_mixed_date
from staylens.functions.text import null_tokens_to_null, normalise_segment, segment_name
from staylens.functions.numeric import to_decimal, to_whole_number, ratio

__all__ = [
    "parse_mixed_date",
    "null_tokens_to_null",
    "normalise_segment",
    "segment_name",
    "to_decimal",
    "to_whole_number",
    "ratio",
]
