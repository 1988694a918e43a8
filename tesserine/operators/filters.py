"""Predicate trees over JSON metadata, and row filters.

Equality is strict about types: 1 is not "1", and a JSON null is a value. Values are
compared in canonical JSON text, which keeps quotes and nulls and sorts keys.

Keys that filters often ask for can be promoted: :func:`promote` adds a column with the canonical text of a key's value
(null: the key is missing), and :meth:`Filter.on` asks that column instead of parsing each row's JSON. Such predicates
reach the Parquet scan, where a table clustered by the column skips row groups, and rows that fail never have their
metadata or vector read. The rules of equality stay the same.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import LIMITS


def _canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _has(metadata: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(metadata), key), F.lit(False))


def _value(metadata: Column, key: str) -> Column:
    """Canonical JSON of a key's value; null if the key is missing."""
    path = "$[" + json.dumps(key) + "]"
    return F.when(_has(metadata, key), F.coalesce(F.to_json(F.variant_get(F.try_parse_json(metadata), path, "variant")), F.lit("null")))


PROMOTED = "metadata$"


def promote(rows: DataFrame, *keys: str) -> DataFrame:
    """A column ``metadata$<key>`` for each key: the canonical JSON of its value, null where the key is missing.

    Cluster the table by the column and an id (``kept(.., by=["metadata$key", "id"])``), so that a value that a third of
    all rows share is dealt over many files.
    """
    return rows.withColumns({PROMOTED + key: _value(F.col("metadata"), key) for key in keys})


def promoted(rows: DataFrame) -> dict[str, Column]:
    """The promoted columns of a table by their keys."""
    return {c[len(PROMOTED) :]: F.col(f"`{c.replace('`', '``')}`") for c in rows.columns if c.startswith(PROMOTED)}


@dataclass(frozen=True)
class Filter:
    """A node: ``eq``, ``in``, ``exists`` with a key, or ``and``, ``or``, ``not`` with nodes below."""

    kind: str
    key: str | None = None
    values: tuple[Any, ...] = ()
    below: tuple[Filter, ...] = ()

    @property
    def depth(self) -> int:
        return 1 + max((f.depth for f in self.below), default=0)

    def validate(self) -> Filter:
        if self.depth > LIMITS["filter_depth"]:
            raise ValueError(f"a filter is at most {LIMITS['filter_depth']} deep")
        return self

    def on(self, rows: DataFrame) -> Column:
        """The predicate over a table, through its promoted columns where it has them."""
        return self.validate().column(F.col("metadata"), promoted(rows))

    def column(self, metadata: Column, known: dict[str, Column] | None = None) -> Column:
        """The predicate as a column that is never null; ``known`` has the canonical values of some keys."""
        own = (known or {}).get(self.key)
        match self.kind:
            case "exists":
                return _has(metadata, self.key) if own is None else own.isNotNull()
            case "eq" | "in":
                if not self.values:
                    return F.lit(False)
                if own is not None:
                    # in this form, not within coalesce, it can be handed to a scan
                    return own.isNotNull() & own.isin([_canonical(v) for v in self.values])
                return F.coalesce(_value(metadata, self.key).isin([_canonical(v) for v in self.values]), F.lit(False))
            case "not":
                return ~self.below[0].column(metadata, known)
            case "and" | "or":
                made = F.lit(self.kind == "and")
                for f in self.below:
                    made = made & f.column(metadata, known) if self.kind == "and" else made | f.column(metadata, known)
                return made
        raise ValueError(f"unknown filter {self.kind}")


def eq(key: str, value: Any) -> Filter:
    return Filter("eq", key, (value,))


def in_(key: str, values: list[Any]) -> Filter:
    return Filter("in", key, tuple(values))


def exists(key: str) -> Filter:
    return Filter("exists", key)


def and_(*below: Filter) -> Filter:
    return Filter("and", below=below)


def or_(*below: Filter) -> Filter:
    return Filter("or", below=below)


def not_(below: Filter) -> Filter:
    return Filter("not", below=(below,))


def from_json(text: str | dict) -> Filter:
    """``{"Eq": [key, value]}``, ``{"In": [key, [..]]}``, ``{"Exists": key}``, ``{"And": [..]}``, ``{"Or": [..]}``, ``{"Not": ..}``."""
    node = json.loads(text) if isinstance(text, str) else text
    (kind, body), *_ = node.items()
    match kind:
        case "Eq":
            return eq(*body)
        case "In":
            return in_(*body)
        case "Exists":
            return exists(body)
        case "And" | "Or":
            return Filter(kind.lower(), below=tuple(from_json(b) for b in body))
        case "Not":
            return not_(from_json(body))
    raise ValueError(f"unknown filter {kind}")


def live(now: int, expires: str = "expires_at") -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now)


def expired(now: int, expires: str = "expires_at") -> Column:
    return F.coalesce(F.col(expires) <= now, F.lit(False))


def searchable_text(metadata: Column) -> Column:
    """Of ``searchable_text``, ``text_preview`` and ``content_preview`` the first that is there, if it is a string."""
    found = F.lit(None).cast("string")
    for key in ("content_preview", "text_preview", "searchable_text"):
        is_text = F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(metadata), f"$.{key}", "variant")) == "STRING", F.lit(False))
        found = F.when(_has(metadata, key), F.when(is_text, F.get_json_object(metadata, f"$.{key}"))).otherwise(found)
    return found


def neighbors(edges: DataFrame, node: str, least: float = 0.0) -> DataFrame:
    return edges.where((F.col("from_id") == node) & (F.col("strength") >= least)).select("to_id", "strength")


def concept(concepts: DataFrame, id_: str) -> DataFrame:
    """The row of an id; expired rows too."""
    return concepts.where(F.col("id") == id_)
