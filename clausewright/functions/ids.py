"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import RULE_CODES


def chunk_id(path: Column, position: Column, content: Column) -> Column:
    key = F.concat_ws(":", path, position.cast("string"), F.substring(content, 1, 200))
    return F.concat(F.lit("chunk-"), F.substring(F.sha2(key, 256), 1, 12))


def rule_code(rule_type: Column) -> Column:
    out = F.lit("UNK")
    for name, code in RULE_CODES.items():
        out = F.when(rule_type == name, F.lit(code)).otherwise(out)
    return out


def requirement_id(rule_type: Column, description: Column, grounded_in: Column) -> Column:
    """24 bits of a hash: an identifier to show, not a join key."""
    return F.concat(F.lit("R-"), rule_code(rule_type), F.lit("-"), F.substring(F.sha2(F.concat(description, F.lit("|"), grounded_in), 256), 1, 6))


def schema_hash(content: Column) -> Column:
    return F.concat(F.lit("schema-"), F.substring(F.sha2(content, 256), 1, 12))
