"""Private-address test as a column expression (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One anchored pattern, so the address column is referenced once: when a
# filter is pushed below the projection that computes the address, Catalyst
# inlines that computation once per reference.
#   part := optional blanks, integer text, optional blanks
#   private := (10 | 127).<int> | 172.<16..31> | 192.168, then two more parts
_ANY_INT = r"\s*[+-]?\d+\s*"
_ZEROS = r"\s*\+?0*"
_TWO_MORE_PARTS = r"\.[^.]*\.[^.]*"
PRIVATE_PATTERN = (
    rf"^(?:{_ZEROS}(?:10|127)\s*\.{_ANY_INT}"
    rf"|{_ZEROS}172\s*\.{_ZEROS}(?:1[6-9]|2\d|3[01])\s*"
    rf"|{_ZEROS}192\s*\.{_ZEROS}168\s*)"
    rf"{_TWO_MORE_PARTS}$"
)


def is_private_ip(ip) -> Column:
    """True for a dotted quad (exactly four parts) whose first two parts are
    integers with the first in 10 or 127, or 172 with the second in 16..31,
    or 192 with the second 168. Parts 3 and 4 are not validated. IPv6, NULL
    and malformed text are False."""
    c = F.col(ip) if isinstance(ip, str) else ip
    return F.coalesce(c.rlike(PRIVATE_PATTERN), F.lit(False))
