"""String normalisation expressions: null tokens and segment labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from staylens.config import CANONICAL_SEGMENTS, NULL_TOKENS, SEGMENT_VARIANTS, UNKNOWN


#: What counts as padding: the characters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column | str) -> Column:
    """The value without white space at its ends (any Unicode white space, not just blanks)."""
    return F.trim(_col(col), F.lit(WHITE_SPACE))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens_to_null(col: Column | str, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    """Map exact missing-value tokens (``NA``, ``null`` ...) to SQL null."""
    c = _col(col)
    return F.when(~c.isin(list(tokens)), c)


def normalise_segment(col: Column | str, variants: Mapping[str, str] = SEGMENT_VARIANTS) -> Column:
    """Canonical booking channel for a raw label.

    Lookup is on the trimmed, lower-cased label; a missing label becomes
    ``Unknown``; a label with no mapping is kept exactly as written (untrimmed)
    so it can be reported and added to the variant list.
    """
    c = _col(col)
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(variants.items()))])
    return F.coalesce(F.try_element_at(lookup, F.lower(strip(c))), c, F.lit(UNKNOWN))


def segment_name(col: Column | str, canonical: Sequence[str] = CANONICAL_SEGMENTS) -> Column:
    """Dimension name of a normalised segment: canonical labels pass, all else is Unknown."""
    c = _col(col)
    return F.when(c.isin(list(canonical)), c).otherwise(F.lit(UNKNOWN))
