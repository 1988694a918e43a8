"""Schemas, limits and validators of the stored tables."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
_HV = T.ArrayType(T.LongType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


CONCEPTS = _struct(namespace=_S, id=_S, vector=_HV, metadata=_S, created_at=_L, modified_at=_L, expires_at=_L, canonical_concept_ids=T.ArrayType(_S))
ASSOCIATIONS = _struct(namespace=_S, from_id=_S, to_id=_S, strength=_D, created_at=_L)
VERSIONS = _struct(namespace=_S, concept_id=_S, version=_L, vector=_HV, metadata=_S, modified_at=_L)
CANONICAL = _struct(namespace=_S, id=_S, version=_I, labels=T.ArrayType(_S), related=T.ArrayType(_S))
ABSENCES = _struct(id=_S, query=_S, normalized_query=_S, attempt_count=_I, last_threshold=_D, best_score_ever=_D, first_seen=T.TimestampType(), last_seen=T.TimestampType(), namespace=_S, namespace_revision=_L)
EVENTS = _struct(kind=_S, namespace=_S, id=_S, other_id=_S, score=_D, at=_L)

#: The analytics tables.
ANALYTICS = {
    "concepts": _struct(id=_S, text=_S, namespace=_S, created_at_us=_L, updated_at_us=_L, expires_at_us=_L, metadata_json=_S),
    "associations": _struct(src_id=_S, dst_id=_S, strength=_D),
    "concept_versions": _struct(id=_S, version=_I, text=_S, created_us=_L),
    "benchmarks": _struct(suite=_S, name=_S, commit=_S, run_at_us=_L, p50_us=_D, p95_us=_D, p99_us=_D, extras=_S),
}

EXPORT = T.StructType([
    T.StructField("version", _S), T.StructField("exported_at", _L),
    T.StructField("concepts", T.ArrayType(_struct(id=_S, namespace=_S, text=_S, vector=_S, metadata=_S, created_at=_L, modified_at=_L, expires_at=_L, canonical_concept_ids=T.ArrayType(_S)))),
    # triples of mixed types are read as strings, and cast
    T.StructField("associations", T.ArrayType(T.ArrayType(_S))),
])
SESSIONS = T.StructType([T.StructField("session_id", _S), T.StructField("turns", T.ArrayType(_struct(ts=_S, speaker=_S, text=_S, memory_id=_S, ttl_seconds=_L)))])
QUERIES = T.StructType([T.StructField("query_id", _S), T.StructField("session_id", _S), T.StructField("task_type", _S), T.StructField("query", _S), T.StructField("gold_evidence_ids", T.ArrayType(_S)), T.StructField("expected_answer", _S), T.StructField("should_abstain", _B)])

#: Limits and defaults.
LIMITS = {
    "top_k": 10_000, "top_k_hard": 100_000, "batch": 1_000, "batch_hard": 10_000, "sequence": 1_024, "sequence_hard": 100_000,
    "versions": 10, "versions_hard": 10_000, "import_bytes": 100_000_000, "filter_depth": 32, "traversal_depth": 32, "traversal_results": 10_000,
    "anchors": 10_000, "hops": 32, "final": 100_000, "new_nodes": 1_000, "id_bytes": 256, "namespace_bytes": 128, "path_bytes": 4_096, "ttl_seconds": 3_153_600_000,
}


def check_k(k: int, most: int = LIMITS["top_k_hard"]) -> int:
    if not 1 <= k <= most:
        raise ValueError(f"k is 1 to {most}, not {k}")
    return k


def valid_id(column: Column, most: int = LIMITS["id_bytes"]) -> Column:
    """Not empty, of at most ``most`` bytes, and without control characters."""
    return F.coalesce((F.octet_length(column) > 0) & (F.octet_length(column) <= most) & ~column.rlike(r"\p{Cc}"), F.lit(False))


def valid_namespace(column: Column) -> Column:
    return valid_id(column, LIMITS["namespace_bytes"])


def valid_metadata(column: Column, most: int | None) -> Column:
    return F.lit(True) if most is None else F.octet_length(column) <= most


def validate_path(path: str) -> str:
    """Relative, or under the working folder or /tmp; no ``..``; at most 4096 bytes."""
    parts = path.replace("\\", "/").split("/")
    inside = not path.startswith("/") or any(os.path.commonpath([path, base]) == base for base in (os.getcwd(), "/tmp"))
    if ".." in parts or len(path.encode()) > LIMITS["path_bytes"] or not inside:
        raise ValueError(f"path not allowed: {path}")
    return path


def validate_analytics_path(path: str) -> str:
    if ".." in path.split("/") or any(c in "'\";" or ord(c) < 32 for c in path):
        raise ValueError(f"path not allowed: {path!r}")
    return path
