"""Spelling rules for path keys and content hashes, as Catalyst expressions and as DuckDB SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def path_key(col: str | Column) -> Column:
    """Canonical spelling of a path key: outer white space, ``\\`` for ``/`` and one leading ``./`` do not count.

    Null stays null; a key of white space only becomes the empty string.
    """
    c = F.col(col) if isinstance(col, str) else col
    slashed = F.translate(F.regexp_replace(c, _EDGE_SPACE, ""), "\\", "/")
    return F.when(slashed.startswith("./"), F.substr(slashed, F.lit(3))).otherwise(slashed)


def content_hash(col: str | Column) -> Column:
    """Canonical spelling of a content hash: lower case, without a leading ``sha256:``; a blank one counts as null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, _EDGE_SPACE, "")), "^sha256:", "")
    return F.when(bare != "", bare)


def path_key_sql(col: str) -> str:
    """``path_key`` as DuckDB SQL."""
    return rf"regexp_replace(replace(regexp_replace({col}, '^\s+|\s+$', '', 'g'), '\', '/'), '^\./', '')"


def content_hash_sql(col: str) -> str:
    """``content_hash`` as DuckDB SQL."""
    return rf"nullif(regexp_replace(lower(regexp_replace({col}, '^\s+|\s+$', '', 'g')), '^sha256:', ''), '')"
