"""Ids of new rows.

An id is the 128-bit hash of (kind of row, key parts), as 32 hex digits: the
same request gives the same id wherever and however often it is run, rows of
different kinds or keys never share one, and no range has to be reserved.
Stored numeric ids are shorter, so they cannot equal one either.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: between the parts; keys hold no control characters
SEPARATOR = "\x1f"


def new_id(kind: str, *parts) -> Column:
    """Id of a new row of ``kind``; the parts (columns or their names, not
    NULL) are its natural key, or its request's id and place in it."""
    return F.md5(F.concat_ws(SEPARATOR, F.lit(kind), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def new_id_sql(kind: str, *parts: str) -> str:
    """The same in DuckDB SQL."""
    return f"md5(concat_ws(chr(31), '{kind}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"
