"""The session object: a namespace of concepts and associations over a change-log store, its tools and command line."""

from __future__ import annotations

import argparse
import base64
import datetime
import hashlib
import json
import struct
import time
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hypervector as hv
from .functions import text as tx
from .operators import analytics, bridge, filters, fusion, graph, hnsw, kept, keyword, lifecycle, retrieval, search
from .sources import readers, schemas, tables, writers
from .streaming import changes

_SIGNED = 1 << 63


def _words(vector: Any) -> list[int]:
    return [int(w) - (1 << 64) if int(w) >= _SIGNED else int(w) for w in vector]


class Memory:
    """Reads see the latest rows of the store; every write is one change log. ``now`` is the clock in seconds."""

    KEYS = {"concepts": ["namespace", "id"], "associations": ["namespace", "from_id", "to_id"], "versions": ["namespace", "concept_id", "version"], "absences": ["id"], "canonical": ["namespace", "id"]}
    SCHEMAS = {"concepts": schemas.CONCEPTS, "associations": schemas.ASSOCIATIONS, "versions": schemas.VERSIONS, "absences": schemas.ABSENCES, "canonical": schemas.CANONICAL}

    def __init__(self, spark: SparkSession, root: str, namespace: str = "_default", retention: int = schemas.LIMITS["versions"], now: int | None = None) -> None:
        self.spark, self.store, self.namespace, self.retention, self._now = spark, tables.Store(spark, root), namespace, retention, now
        self.metrics, self.cache, self.stats_of_last = retrieval.Metrics(), retrieval.Cache(), retrieval.Stats()
        self.config, self.backend = retrieval.Config(), None

    @property
    def now(self) -> int:
        return int(time.time()) if self._now is None else self._now

    # -- tables

    def table(self, name: str, every: bool = False) -> DataFrame:
        rows = self.store.read(name, self.SCHEMAS[name], self.KEYS[name])
        return rows if every or name == "absences" else rows.where(F.col("namespace") == self.namespace)

    @property
    def concepts(self) -> DataFrame:
        return self.table("concepts")

    @property
    def edges(self) -> DataFrame:
        return self.table("associations")

    def set_namespace(self, namespace: str) -> None:
        if not namespace or len(namespace.encode()) > schemas.LIMITS["namespace_bytes"]:
            raise ValueError("a namespace has 1 to 128 bytes")
        self.namespace = namespace

    def namespaces(self) -> list[str]:
        return [r.namespace for r in analytics.namespaces(self.table("concepts", True), self.table("associations", True)).collect()]

    def revision(self) -> int:
        return self.store.revision("concepts")

    def namespace_revision(self, namespace: str | None = None) -> int:
        """How often the concepts of a namespace were changed; 0 for one that never was."""
        return self.store.counter(namespace or self.namespace)

    def bump_revision(self, namespace: str | None = None) -> int:
        with self.store.commit() as c:
            c.count(namespace or self.namespace)
        return self.namespace_revision(namespace)

    def _commit(self, changes: list[tuple[str, DataFrame, bool]], events: DataFrame | None = None, namespace: str | None = None, read_at: int | None = None) -> int:
        """Rows, or tombstones, of several tables, their events and, where concepts change, the namespace's new revision: in
        one commit, so that a reader sees all or nothing of them."""
        began = time.perf_counter()
        with self.store.commit(read_at) as c:
            for name, rows, deleted in changes:
                rows = rows.select(*self.SCHEMAS[name].fieldNames())
                c.delete(name, rows.select(*self.KEYS[name])) if deleted else c.upsert(name, rows, self.KEYS[name])
            if any(name == "concepts" for name, _, _ in changes):
                c.count(namespace or self.namespace)
            if events is not None:
                c.events(events)
        for name in dict.fromkeys(name for name, _, _ in changes):
            self.store.tidy(name, self.SCHEMAS[name], self.KEYS[name])
        self.metrics.add("persist_ops", seconds=time.perf_counter() - began)
        return c.number

    def _written(self, name: str, rows: DataFrame, deleted: bool = False, events: DataFrame | None = None) -> int:
        return self._commit([(name, rows, deleted)], events)

    def _events(self, rows: DataFrame, kind: Column | str, id_: str, other: str | None = None, score: str | None = None) -> DataFrame:
        """Rows of the change feed, as :data:`schemas.EVENTS` has them."""
        null = lambda c, t: F.lit(None).cast(t) if c is None else F.col(c).cast(t)
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select(kind.alias("kind"), F.lit(self.namespace).alias("namespace"), F.col(id_).alias("id"), null(other, "string").alias("other_id"), null(score, "double").alias("score"), F.lit(self.now).cast("long").alias("at"))

    def _upserted(self, rows: DataFrame) -> DataFrame:
        """Events of concepts that are written: those with an id that is there are updates."""
        known = self.concepts.select("id", F.lit(True).alias("_known"))
        return self._events(rows.select("id").distinct().join(known, "id", "left"), F.when(F.col("_known"), "ConceptUpdated").otherwise("ConceptInjected"), "id")

    def changes(self, files_per_trigger: int | None = None) -> DataFrame:
        """The change feed of all namespaces as a stream, from the first commit on."""
        return changes.feed(self.spark, self.store, files_per_trigger)

    # -- concepts

    def upsert(self, rows: DataFrame) -> int:
        """Upsert concepts (``id``, ``vector``, ``metadata``, optional ``expires_at``) and append their versions."""
        if not rows.where(~schemas.valid_id(F.col("id"))).isEmpty():
            raise ValueError("an id has 1 to 256 bytes and no control characters")
        fill = {"namespace": F.lit(self.namespace), "created_at": F.lit(self.now).cast("long"), "modified_at": F.lit(self.now).cast("long"), "canonical_concept_ids": F.array().cast("array<string>")}
        if "expires_at" not in rows.columns:
            fill["expires_at"] = F.lit(None).cast("long")
        whole = rows.withColumns({k: v for k, v in fill.items() if k not in rows.columns}).select(*self.SCHEMAS["concepts"].fieldNames())
        with tables.passing(whole) as full:
            old = self.table("versions")
            new = full.select("namespace", F.col("id").alias("concept_id"), "vector", "metadata", "modified_at")
            self.metrics.add("concepts_injected", full.count())
            return self._commit([("versions", lifecycle.next_version(old, new), False), ("concepts", full, False)], self._upserted(full))

    def inject(self, id_: str, vector: list[int], metadata: dict | None = None, ttl: int | None = None) -> int:
        row = self.spark.createDataFrame([(id_, _words(vector), json.dumps(metadata or {}, sort_keys=True))], "id string, vector array<long>, metadata string")
        return self.upsert(lifecycle.with_ttl(row, self.now, F.lit(ttl).cast("long")) if ttl is not None else row)

    def inject_text(self, id_: str, text: str, metadata: dict | None = None, ttl: int | None = None) -> int:
        return self.inject(id_, [int(w) for w in tx.encode_text(text)], {**(metadata or {}), "searchable_text": text}, ttl)

    def get(self, id_: str) -> dict | None:
        row = filters.concept(self.concepts, id_).first()
        return row and row.asDict()

    def update(self, id_: str, vector: list[int] | None = None, metadata: dict | None = None, merge: bool = False) -> int:
        """Replace a concept's vector or metadata, or merge into its metadata; an unknown id is an error."""
        given = self.spark.createDataFrame([(id_, None if vector is None else _words(vector), None if metadata is None else json.dumps(metadata, sort_keys=True))], "id string, vector array<long>, metadata string")
        rows, unknown = lifecycle.updated(self.concepts, given, ["id"], self.now)
        if not unknown.isEmpty():
            raise KeyError(id_)
        if merge and metadata is not None:
            old = self.concepts.select("id", F.col("metadata").alias("_old"))
            rows = rows.join(old, "id").withColumn("metadata", lifecycle.metadata_merged(F.col("_old"), F.col("metadata"))).drop("_old")
        return self.upsert(rows.select(*self.SCHEMAS["concepts"].fieldNames()))

    def update_vector(self, id_: str, vector: list[int]) -> int:
        return self.update(id_, vector=vector)

    def update_metadata(self, id_: str, metadata: dict) -> int:
        return self.update(id_, metadata=metadata)

    def delete(self, *ids: str) -> None:
        """Delete concepts, their edges in both directions and their versions."""
        self.delete_rows(self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def delete_rows(self, ids: DataFrame) -> None:
        """As :meth:`delete`, for any number of ids (column ``id``)."""
        gone = tables.cut(ids.select("id").distinct())
        by = lambda c: gone.withColumnRenamed("id", c)
        dead = self.concepts.join(gone, "id", "left_semi")
        ends = self.edges.join(by("from_id"), "from_id", "left_semi").unionByName(self.edges.join(by("to_id"), "to_id", "left_semi").join(by("from_id"), "from_id", "left_anti"))
        past = self.table("versions").join(by("concept_id"), "concept_id", "left_semi")
        self.metrics.add("delete_concepts")
        self._commit([("associations", ends, True), ("versions", past, True), ("concepts", dead, True)], self._events(dead, "ConceptDeleted", "id"))

    def purge_expired(self, cascade: bool = False) -> int:
        ids = tables.cut(lifecycle.expired_ids(self.concepts, self.edges, self.now, cascade).join(self.concepts.select("id"), "id", "left_semi"))
        n = ids.count()
        if n:
            self.delete_rows(ids)
        return n

    def bundle(self, ids: list[str]) -> list[int]:
        """Majority of stored concepts' vectors; an empty list or an unknown id is an error."""
        wanted = self.spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
        rows = self.concepts.join(wanted, "id")
        if not ids or rows.count() < len(set(ids)):
            raise KeyError(f"no concepts, or unknown ones, in {ids}")
        return list(hv.bundle(rows.withColumn("g", F.lit(1)), ["g"], "vector").first().vector)

    # -- edges

    def associate(self, pairs: list[tuple[str, str, float]]) -> int:
        """Upsert edges; an invalid one is an error and nothing is written."""
        new = self.spark.createDataFrame(pairs, "from_id string, to_id string, strength double")
        good, bad = lifecycle.associated(self.edges.limit(0), new, self.concepts, self.now)
        if not bad.isEmpty():
            raise ValueError(f"not an association: {bad.first().asDict()}")
        self.metrics.add("associations_created", len(pairs))
        return self._associated(good)

    def _associated(self, good: DataFrame) -> int:
        return self._written("associations", good.withColumn("namespace", F.lit(self.namespace)), events=self._events(good, "Associated", "from_id", "to_id", "strength"))

    def associate_batch(self, pairs: list[tuple[str, str, float]], continue_on_error: bool = True) -> dict[str, int]:
        """Upsert the valid edges and count both kinds; without ``continue_on_error`` an invalid one is an error."""
        if not continue_on_error:
            self.associate(pairs)
            return {"created": len(pairs), "failed": 0}
        new = self.spark.createDataFrame(pairs, "from_id string, to_id string, strength double")
        good, bad = lifecycle.associated(self.edges.limit(0), new, self.concepts, self.now)
        failed = bad.count()
        self._associated(good)
        self.metrics.add("associations_created", len(pairs) - failed)
        return {"created": len(pairs) - failed, "failed": failed}

    def associations(self, id_: str, incoming: bool = False, **curve: Any) -> DataFrame:
        return (graph.incoming if incoming else graph.outgoing)(self.edges, id_, self.now, **curve)

    def disassociate(self, start: str, end: str) -> None:
        rows = self.edges.where((F.col("from_id") == start) & (F.col("to_id") == end))
        self._written("associations", rows, True, self._events(rows, "Disassociated", "from_id", "to_id"))
        self.metrics.add("disassociations")

    def clear_associations(self, id_: str) -> None:
        """Delete the out-edges of a concept."""
        rows = self.edges.where(F.col("from_id") == id_)
        self._written("associations", rows, True, self._events(rows, "Disassociated", "from_id", "to_id"))

    def reinforce(self, start: str, end: str) -> None:
        """An edge's clock starts again."""
        rows = self.edges.where((F.col("from_id") == start) & (F.col("to_id") == end))
        self._written("associations", lifecycle.reinforced(rows, start, end, self.now))

    # -- namespaces

    def clear_namespace(self, namespace: str | None = None) -> int:
        """Delete a namespace's rows in every table and count its revision on; returns its concepts."""
        own = namespace or self.namespace
        n = self.table("concepts", True).where(F.col("namespace") == own).count()
        of = lambda name: self.table(name, True).where(F.col("namespace") == own)
        gone = of("concepts").select(F.lit("ConceptDeleted").alias("kind"), "namespace", "id", F.lit(None).cast("string").alias("other_id"), F.lit(None).cast("double").alias("score"), F.lit(self.now).cast("long").alias("at"))
        self._commit([(name, of(name), True) for name in ("concepts", "associations", "versions", "canonical", "absences")], gone, own)
        self.cache.clear()
        return n

    delete_namespace = clear_namespace

    def clear_all(self) -> None:
        """Delete everything, and count every namespace's revision on."""
        for own in self.namespaces():
            self.clear_namespace(own)

    def replace_namespace(self, concepts: DataFrame, edges: DataFrame) -> int:
        """All rows of the namespace in place of those it has; nothing is written if they are not valid."""
        return self._import(concepts, edges, merge=False)

    def merge_namespace(self, concepts: DataFrame, edges: DataFrame) -> int:
        """Rows beside those that the namespace has; concepts that are there keep their time of creation."""
        return self._import(concepts, edges, merge=True)

    def _import(self, concepts: DataFrame, edges: DataFrame, merge: bool, tries: int = 5) -> int:
        concepts, edges = tables.cut(concepts), tables.cut(edges)
        for left in range(tries - 1, -1, -1):
            try:
                return self._imported(concepts, edges, merge)
            except tables.ConcurrentWrite:
                if not left:
                    raise
        raise AssertionError

    def _imported(self, concepts: DataFrame, edges: DataFrame, merge: bool) -> int:
        """One commit: what goes, what comes, the events of both and the new revision. Made from one state of the store; if
        another writer changes these tables meanwhile, nothing counts."""
        state = self.store.state()
        seen = lambda name: self.store.read(name, self.SCHEMAS[name], self.KEYS[name], state).where(F.col("namespace") == self.namespace)
        wrong = readers.violations(concepts, edges, seen("concepts") if merge else None)
        if not wrong.isEmpty():
            raise ValueError(f"not a valid import: {wrong.first().asDict()}")
        now = F.lit(self.now).cast("long")
        fill = {"namespace": F.lit(self.namespace), "created_at": now, "modified_at": now, "expires_at": F.lit(None).cast("long"), "canonical_concept_ids": F.array().cast("array<string>")}
        full = concepts.withColumns({k: v for k, v in fill.items() if k not in concepts.columns}).withColumn("namespace", F.lit(self.namespace)).select(*self.SCHEMAS["concepts"].fieldNames())
        full = full.withColumn("created_at", F.coalesce("created_at", now)).withColumn("modified_at", F.coalesce("modified_at", now))
        ways = edges.withColumns({k: v for k, v in (("created_at", now),) if k not in edges.columns}).withColumn("namespace", F.lit(self.namespace)).select(*self.SCHEMAS["associations"].fieldNames())
        known = seen("concepts").select("id", F.col("created_at").alias("_old"))
        events = self._events(full.select("id").distinct().join(known, "id", "left"), F.when(F.col("_old").isNotNull(), "ConceptUpdated").otherwise("ConceptInjected"), "id")
        events = events.unionByName(self._events(ways, "Associated", "from_id", "to_id", "strength"))
        parts: list[tuple[str, DataFrame, bool]] = []
        if merge:
            full = full.join(known, "id", "left").withColumn("created_at", F.coalesce("_old", "created_at"))
        else:
            cut = seen("associations").join(ways.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
            gone = seen("concepts").join(full.select("id"), "id", "left_anti")
            parts = [("associations", cut, True), ("concepts", gone, True)]
            events = events.unionByName(self._events(gone, "ConceptDeleted", "id")).unionByName(self._events(cut, "Disassociated", "from_id", "to_id"))
        n = self._commit([*parts, ("associations", ways, False), ("concepts", full, False)], events, read_at=state["n"])
        self.cache.clear()
        return n

    def import_json(self, path: str, merge: bool = False) -> int:
        """Import a payload of :meth:`export` (100 MB at most); returns its concepts."""
        return self._import_payload(json.loads(writers.get(self.spark, schemas.validate_path(path), schemas.LIMITS["import_bytes"])), merge)

    def import_binary(self, path: str, merge: bool = False) -> int:
        """Import a payload of :meth:`export_binary` (100 MB at most); returns its concepts."""
        return self._import_payload(writers.unpack_binary(writers.get(self.spark, schemas.validate_path(path), schemas.LIMITS["import_bytes"]))[0], merge)

    def import_file(self, path: str, merge: bool = False) -> int:
        """Either kind, told by how the file begins."""
        data = writers.get(self.spark, schemas.validate_path(path), schemas.LIMITS["import_bytes"])
        return self._import_payload(writers.unpack_binary(data)[0] if data.startswith(writers.MAGIC) else json.loads(data), merge)

    def _import_payload(self, payload: dict, merge: bool) -> int:
        vector = lambda c: list(struct.unpack("<160q", base64.b64decode(c["vector"])))
        rows = [(c["id"], vector(c), c.get("metadata") or "{}", c.get("created_at"), c.get("modified_at"), c.get("expires_at"), c.get("canonical_concept_ids") or []) for c in payload["concepts"]]
        edges = [json.loads(e) if isinstance(e, str) else e for e in payload["associations"]]
        edges = [(e["from_id"], e["to_id"], float(e["strength"])) if isinstance(e, dict) else (e[0], e[1], float(e[2])) for e in edges]
        concepts = self.spark.createDataFrame(rows, "id string, vector array<long>, metadata string, created_at long, modified_at long, expires_at long, canonical_concept_ids array<string>")
        self._import(concepts, self.spark.createDataFrame(edges, "from_id string, to_id string, strength double"), merge)
        return len(rows)

    def export_bytes(self) -> bytes:
        """The namespace's payload in the binary form."""
        return writers.pack_binary([json.loads(self.export())])

    def export_binary(self, path: str) -> None:
        writers.put(self.spark, schemas.validate_path(path), self.export_bytes())

    def export_json(self, path: str) -> None:
        writers.put(self.spark, schemas.validate_path(path), self.export().encode())

    def load_replace(self) -> bool:
        """Forget what is held of the store and read it anew; True if the kept index still fits it."""
        self.cache.clear()
        return self.backend is not None and self._index_usable()

    def load_merge(self, other: Memory) -> int:
        """Add another store's concepts of this namespace that are not here; its edges go over those here."""
        new = other.concepts.join(self.concepts.select("id"), "id", "left_anti")
        events = self._events(new, "ConceptInjected", "id").unionByName(self._events(other.edges, "Associated", "from_id", "to_id", "strength"))
        return self._commit([("associations", other.edges, False), ("concepts", new, False)], events)

    # -- ontology

    @property
    def ontology(self) -> DataFrame:
        return self.table("canonical")

    def save_canonical(self, id_: str, labels: list[str], related: list[str] = (), version: int = 1) -> int:
        row = self.spark.createDataFrame([(self.namespace, id_, version, list(labels), list(related))], self.SCHEMAS["canonical"])
        return self._written("canonical", row)

    def delete_canonical(self, id_: str) -> None:
        self._written("canonical", self.ontology.where(F.col("id") == id_), deleted=True)

    def save_ontology(self, rows: DataFrame) -> int:
        """All of a namespace's ontology (``id``, ``version``, ``labels``, ``related``) in place of what it has."""
        full = tables.cut(rows.withColumn("namespace", F.lit(self.namespace)).select(*self.SCHEMAS["canonical"].fieldNames()))
        return self._commit([("canonical", self.ontology.join(full.select("id"), "id", "left_anti"), True), ("canonical", full, False)])

    def write_ontology(self, path: str) -> None:
        """The ontology as JSON lines that :func:`readers.ontology` reads."""
        self.ontology.select("namespace", "id", "version", "labels", "related").orderBy("id").coalesce(1).write.mode("overwrite").json(path)

    # -- retrieval

    def probe(self, vector: list[int], k: int = 10, filter_: filters.Filter | None = None) -> DataFrame:
        self.metrics.add("probes")
        return search.probe(self.concepts, _words(vector), k, self.now, filter_)

    def probe_cached(self, vector: list[int], k: int = 10) -> list[tuple[str, float]]:
        """The best ``k`` through cache, index, candidates or scan, as rows; :attr:`stats_of_last` tells which way it went.

        A result is held until the namespace changes.
        """
        words = _words(vector)
        key = (self.namespace, self.namespace_revision(), self.config, k, hashlib.sha256(np.array(words, np.int64).tobytes()).digest())
        found = self.cache.get(key) if k <= retrieval.CACHED_K else None
        if found is not None:
            self.stats_of_last = retrieval.Stats("cache", best_score=found[0][1] if found else None)
            return found
        live = self.concepts.where(filters.live(self.now))
        ann = (lambda q, n: self.index_search(q, n)) if self.backend is not None else None
        hits, stats = retrieval.find_similar(live, words, k, self.config, self.edges, ann)
        rows, spent = retrieval.timed(lambda: [(r.id, r.score) for r in hits.collect()])
        self.metrics.add("probes", seconds=spent)
        self.stats_of_last = retrieval.replace(stats, seconds=spent, best_score=rows[0][1] if rows else None)
        if k <= retrieval.CACHED_K:
            self.cache.put(key, rows)
        return rows

    def probe_batch_cached(self, vectors: list[list[int]], k: int = 10) -> list[list[tuple[str, float]]]:
        return [self.probe_cached(v, k) for v in vectors]

    def clear_similarity_cache(self) -> None:
        self.cache.clear()

    # -- index

    def set_backend(self, kind: str, **options: int) -> None:
        """``brute_force``, ``lsh`` or ``hnsw``; its index is made when it is first searched."""
        self.backend = search.backend(kind, **options) if kind != "hnsw" else hnsw.HnswIndex(**options)

    def _index_folder(self) -> str:
        return f"{self.store.root}/indexes/{hashlib.sha256(self.namespace.encode()).hexdigest()[:16]}"

    def _index_path(self) -> str:
        return f"{self._index_folder()}/ann-{hashlib.sha256(self.backend.fingerprint.encode()).hexdigest()[:16]}"

    def _index_usable(self) -> bool:
        """Is the stored index there, whole, and made from this revision in this way?"""
        if not self.store._exists(f"{self._index_path()}/_SUCCESS"):
            return False
        rows = self.spark.read.parquet(self._index_path())
        if "graph" in rows.columns:
            return hnsw.usable(rows, self.namespace_revision(), self.backend.fingerprint)
        row = rows.select("revision", "fingerprint").first()
        return row is not None and search.reusable(row.asDict(), self.namespace_revision(), self.backend.fingerprint)

    def rebuild_index(self) -> None:
        """Make the index anew from the rows, and store it with the revision that it was made from."""
        revision, name = self.namespace_revision(), self.backend.fingerprint
        if isinstance(self.backend, hnsw.HnswIndex):
            made = hnsw.encode_snapshots(self.backend.build(self.concepts), revision, name)
        else:
            made = self.backend.keys(self.concepts).withColumns({"revision": F.lit(revision).cast("long"), "fingerprint": F.lit(name)})
            made = made.repartitionByRange("table", "key").sortWithinPartitions("table", "key")
        made.write.mode("overwrite").parquet(self._index_path())

    def index(self) -> DataFrame:
        """The stored index; a stale or damaged one is built again."""
        if not self._index_usable():
            self.rebuild_index()
        return self.spark.read.parquet(self._index_path())

    def index_search(self, vector: list[int], k: int = 10, filter_: filters.Filter | None = None) -> DataFrame:
        """Search by the index, live rows only."""
        words, index, live = _words(vector), self.index(), self.concepts.where(filters.live(self.now))
        if filter_ is not None:
            return self.backend.search_filtered(live, index, words, k, filter_)
        if isinstance(self.backend, hnsw.HnswIndex):
            return self.backend.search(index, words, k, self.concepts.where(filters.expired(self.now)).select("id"))
        return self.backend.search(live, index, words, k)

    def index_stats(self) -> dict:
        """Backend, indexed rows, and bytes that the index takes."""
        if self.backend is None:
            return {"backend": "brute_force", "count": self.concepts.count(), "memory_bytes": 0}
        index = self.index()
        count = index.agg(F.sum(F.size("ids")) if "ids" in index.columns else F.count_distinct("id")).first()[0] or 0
        fs, p = self.store._fs(self._index_path())
        return {"backend": self.backend.fingerprint, "count": int(count), "memory_bytes": int(fs.getContentSummary(p).getLength())}

    def keyword_index(self, name: str, text: Column, tokens: Column | tx.Words) -> keyword.Bm25:
        """A keyword index of the namespace's concepts, kept in the store. Writes since it was last asked for make one small
        segment; statistics span all rows that have the text."""
        state = self.store.state()
        schema, keys = self.SCHEMAS["concepts"], self.KEYS["concepts"]
        index = keyword.Segments(self.spark, f"{self._index_folder()}/{name}")
        have, own = index.state(), F.col("namespace") == self.namespace
        changed = self.store.changed("concepts", schema, keys, have["revision"], state) if have else None
        docs = self.store.read("concepts", schema, keys, state).where(own).withColumn("text", text).where(F.col("text").isNotNull())
        return index.refresh(state["touched"].get("concepts", 0), docs.select("id", "text"), tokens, None if changed is None else changed.where(own).select("id"))

    def text_index(self, code_aware: bool = False) -> keyword.Bm25:
        """The keyword index of the namespace's searchable texts."""
        return self.keyword_index(f"text-{int(code_aware)}", filters.searchable_text(F.col("metadata")), tx.Words.plain(F.col("text"), code_aware))

    def probe_text(self, text: str, k: int = 10, filter_: filters.Filter | None = None, mode: str = "auto", code_aware: bool = False) -> DataFrame:
        """Keyword and vector search fused; ``mode`` is auto, semantic or keyword. Statistics span all rows, also hidden ones."""
        tokens = tx._tokens(text, code_aware, True)
        live = self.concepts.where(filters.live(self.now))
        if filter_ is not None:
            live = live.where(filter_.on(live))
        wide = max(k, 50)
        hits = self.text_index(code_aware).search(tokens, wide, live)
        near = self.probe([int(w) for w in tx.encode_text(text, code_aware=code_aware)], wide, filter_)
        weight = {"auto": fusion.weights(len(tokens)), "semantic": (0.0, 1.0), "keyword": (1.0, 0.0)}[mode]
        return fusion.merge(hits, near.select("id", "score"), weight, k)

    def probe_in_session(self, text: str, session: str, k: int = 10) -> DataFrame:
        return self.probe_text(text, k, filters.eq("session_id", session))

    def probe_with_rerankers(self, vector: list[int], k: int = 10, rerankers: str = "", wide: int = 100) -> DataFrame:
        """The best ``wide`` rows through rerankers named like ``mmr:0.7,recency:30d``, then the best ``k``."""
        hits = self.probe(vector, max(k, wide)).join(self.concepts.select("id", "vector", "modified_at"), "id")
        return search.rerank_chain(hits, fusion.parse_rerankers(rerankers, self.now), k).select("id", "score")

    def probe_graph(self, text: str, k: int = 10, anchors: int = 10, hops: int = 2, least: float = 0.1) -> DataFrame:
        return self.probe_vector_graph([int(w) for w in tx.encode_text(text)], k, anchors, hops, least)

    def probe_vector_graph(self, vector: list[int], k: int = 10, anchors: int = 10, hops: int = 2, least: float = 0.1, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
        live = self.concepts.where(filters.live(self.now))
        similar = search.scored(live, _words(vector))
        return graph.graph_rag(similar.select("id", "score"), self.edges, anchors, hops, least, weights, k=k)

    # -- abstention

    @property
    def absences(self) -> AbsenceStore:
        return AbsenceStore(self)

    def _answered(self, text: str, mode: str, run: Callable[[], DataFrame], threshold: float) -> list[tuple[str, float]] | None:
        """Rows of ``run``, or None for an abstention. A text that found nothing often and lately isn't searched again
        until the namespace changes; one that finds something is taken off the record."""
        revision, id_ = self.namespace_revision(), self.absences.id_of(text, mode)
        if self.absences.silent(id_, revision):
            self.stats_of_last = retrieval.Stats("absence")
            return None
        rows = [(r[0], r[1]) for r in run().collect()]
        if not rows:
            self.absences.record(id_, text, threshold, None, revision)
            return None
        if self.absences.get(id_) is not None:
            self.absences.delete(id_)
        return rows

    def probe_text_semantic(self, text: str, k: int = 10, least: float | None = None) -> list[tuple[str, float]] | None:
        """Vector search by a text; None where it abstains. ``least`` drops rows of a lower score."""
        vector = [int(w) for w in tx.encode_text(text)]
        hits = lambda: self.probe(vector, k).where(F.lit(True) if least is None else F.col("score") >= least).select("id", "score").orderBy(F.desc("score"), "id")
        return self._answered(text, "semantic", hits, least or 0.0)

    # -- bridge

    def bridge_hits(self, text: str, k: int = 10, reranker: Callable[[DataFrame], DataFrame] | None = None, depth: int = 2) -> DataFrame:
        return bridge.query(self.concepts, self.ontology, text, k, self.now, depth, reranker=reranker)

    def probe_bridge_text(self, text: str, k: int = 10, reranker: Callable[[DataFrame], DataFrame] | None = None) -> list[tuple[str, float]] | None:
        """Bridge retrieval; None where it abstains."""
        hits = lambda: self.bridge_hits(text, k, reranker).select("id", "final_score").orderBy(F.desc("final_score"), "id")
        return self._answered(text, "bridge", hits, bridge.WEIGHTS[0])

    def probe_bridge_text_filtered(self, text: str, k: int, filter_: filters.Filter) -> DataFrame:
        """Bridge hits that are among the best ``k`` of the filtered rows."""
        allowed = self.probe([int(w) for w in tx.encode_text(text)], k, filter_)
        return self.bridge_hits(text, k).join(allowed.select("id"), "id", "left_semi").orderBy(F.desc("final_score"), "id")

    def bridge_with_best_score(self, text: str, k: int = 10, reranker: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, float]:
        hits = tables.cut(self.bridge_hits(text, k, reranker))
        return hits, bridge.best_final(hits)

    def memory_packet(self, text: str, k: int = 10, reranker: Callable[[DataFrame], DataFrame] | None = None, budget: int = bridge.TOKEN_BUDGET) -> dict:
        """Facts of the bridge hits within a token budget."""
        hits = tables.cut(self.bridge_hits(text, k, reranker))
        return bridge.packet(hits, bridge.facts(self.concepts), budget).first().asDict()

    def traverse(self, start: str, **config: Any) -> DataFrame:
        self.metrics.add("traversals")
        return graph.bfs(self.edges, start, graph.Traversal(**config))

    def shortest_path(self, start: str, end: str, weighted: bool = True) -> list[str] | None:
        self.metrics.add("shortest_path")
        row = (graph.shortest_path if weighted else graph.shortest_path_hops)(self.edges, start, end).first()
        return row and row.path

    # -- history

    def history(self, id_: str, limit: int = 10) -> DataFrame:
        return lifecycle.history(lifecycle.retained(self.table("versions"), self.retention), id_, limit)

    def version(self, id_: str, version: int) -> dict | None:
        row = lifecycle.version_at(self.table("versions"), self.concepts, id_, version).first()
        return row and row.asDict()

    def diff(self, id_: str, old: int, new: int) -> dict:
        row = lifecycle.diff(self.table("versions"), id_, old, new).first()
        if row is None:
            raise KeyError((id_, old, new))
        return row.asDict()

    def rollback(self, id_: str, version: int) -> int:
        row = lifecycle.version_at(self.table("versions"), self.concepts, id_, version).select(F.col("concept_id").alias("id"), "vector", "metadata", "created_at", "expires_at")
        if row.isEmpty():
            raise KeyError((id_, version))
        return self.upsert(row)

    # -- whole store

    def stats(self) -> dict:
        row = analytics.concept_summary(self.concepts, self.edges).first()
        return {"concepts": row.concepts, "associations": row.associations, "revision": self.revision()}

    def storage(self) -> dict:
        """Concepts of the namespace, and bytes of the whole store."""
        return {"concepts": self.concepts.count(), "bytes": self.store.size()}

    def metrics_snapshot(self) -> dict:
        """Counters and mean times of this session, with those of its cache."""
        return self.metrics.snapshot() | self.cache.snapshot()

    def index_dir(self, paths: str | list[str], sync: bool = False, level: int = 2) -> dict[str, int]:
        """Index the sections of Markdown files (paths or globs) as concepts; returns counts.

        Sections that are there with the same content are skipped. With ``sync`` sections that a file of these paths no
        longer has are deleted. All files are read before anything is written.
        """
        files = self.spark.read.text(paths, wholetext=True).select(readers.normalized_path(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")).alias("path"), "value")
        staged = tables.cut(readers.chunks_by_heading(files, level).select("id", "path", "level", "heading", "content", "fingerprint"))
        field = lambda c: F.get_json_object("metadata", f"$.{c}")
        have = tables.cut(self.concepts.where(F.col("id").startswith("md:")).select("id", field("source_path").alias("path"), field("fingerprint").alias("fingerprint")))
        gone, same = readers.synced(have, staged)
        new = staged.join(same.select("id"), "id", "left_anti")
        counts = {"skipped": same.count(), "replaced": new.join(have.select("id"), "id", "left_semi").count(), "deleted": 0}
        counts["indexed"] = new.count() - counts["replaced"]
        meta = F.to_json(F.struct(F.col("content").alias("searchable_text"), tx.preview(F.col("content")).alias("text_preview"), "heading", "level", "fingerprint", F.col("path").alias("source_path")))
        if counts["indexed"] + counts["replaced"]:
            self.upsert(new.select("id", tx.encoder()(F.col("content")).alias("vector"), meta.alias("metadata")))
        if sync:
            gone = tables.cut(gone.select("id"))
            counts["deleted"] = gone.count()
            if counts["deleted"]:
                self.delete_rows(gone)
        return counts

    def export(self) -> str:
        return writers.payload(self.concepts, self.edges, self.namespace, self.now).first().payload

    def gaps(self, attempts: int = 3) -> DataFrame:
        return lifecycle.gaps(self.table("absences"), attempts)

    def sql(self, statement: str) -> DataFrame:
        """One SELECT over the views ``concepts``, ``associations`` and ``versions`` of this namespace."""
        for name in ("concepts", "associations", "versions"):
            self.table(name).createOrReplaceTempView(name)
        return analytics.read_only(self.spark, statement)

    def import_violations(self, concepts: DataFrame, edges: DataFrame, merge: bool) -> DataFrame:
        return readers.violations(concepts, edges, self.concepts if merge else None)


class AbsenceStore:
    """Abstentions on record: texts that found nothing, by namespace and kind of search."""

    #: Attempts at one revision, and seconds since the last of them, within which a text isn't searched again.
    ATTEMPTS, SECONDS = 3, 300

    def __init__(self, memory: Memory) -> None:
        self.memory = memory

    def id_of(self, text: str, mode: str) -> str:
        scope = f"namespace={self.memory.namespace}|mode={mode}|provider=hdc-text|bits={hv.BITS}".encode()
        query = text.strip().lower().encode()
        return f"absence:{tx.fnv1a(len(scope).to_bytes(8, 'little') + scope + query):016x}"

    def list(self) -> DataFrame:
        return self.memory.table("absences").where(F.col("namespace") == self.memory.namespace)

    def get(self, id_: str) -> dict | None:
        row = self.list().where(F.col("id") == id_).first()
        return row and row.asDict()

    def record(self, id_: str, text: str, threshold: float, best: float | None, revision: int) -> dict:
        """Count one more abstention of a text; the count starts again when the namespace has changed."""
        at = datetime.datetime.fromtimestamp(self.memory.now)
        new = self.memory.spark.createDataFrame([(id_, text, text.strip().lower(), 1, threshold, best, at, at, self.memory.namespace, revision)], schemas.ABSENCES)
        merged = lifecycle.absences_merged(self.list(), new).where(F.col("id") == id_)
        self.memory._written("absences", merged)
        return self.get(id_)

    def silent(self, id_: str, revision: int) -> bool:
        """Is the text known to find nothing at this revision?"""
        now = F.timestamp_seconds(F.lit(self.memory.now))
        rows = lifecycle.short_circuits(self.list().where(F.col("id") == id_), self.memory.namespace, revision, now, self.ATTEMPTS, self.SECONDS)
        return not rows.isEmpty()

    def delete(self, id_: str) -> None:
        self.memory._written("absences", self.list().where(F.col("id") == id_), deleted=True)


def parse_vector(value: Any) -> list[int]:
    """A vector as the service takes it: base64 of 1 280 little-endian bytes, or 160 unsigned halves, the high before the
    low of each 128-bit word."""
    if isinstance(value, str):
        data = base64.b64decode(value, validate=True)
        if len(data) != hv.BYTES:
            raise ValueError(f"a vector has {hv.BYTES} bytes, not {len(data)}")
        return list(struct.unpack(f"<{hv.WORDS}q", data))
    if isinstance(value, list) and len(value) == hv.WORDS and all(isinstance(w, int) and 0 <= w < 1 << 64 for w in value):
        return _words(w for i in range(0, hv.WORDS, 2) for w in (value[i + 1], value[i]))
    raise ValueError("a vector is base64 text or a list of 160 unsigned halves")


def read_resource(memory: Memory, uri: str) -> dict:
    """``concept://<id>``, ``stats://current`` or ``health://current``."""
    if uri.startswith("concept://"):
        row = memory.get(uri.removeprefix("concept://"))
        if row is None:
            raise KeyError(uri)
        return row
    if uri == "stats://current":
        return memory.stats()
    if uri == "health://current":
        memory.concepts.limit(1).collect()
        return {"status": "healthy"}
    raise KeyError(f"unknown resource {uri}")


def execute_tool(memory: Memory, name: str, args: dict) -> Any:
    """The tools of the service surface by name, with JSON-like arguments and results."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    tools = {
        "memory_inject": lambda a: memory.inject(a["id"], a["vector"], a.get("metadata"), a.get("ttl")),
        "memory_inject_text": lambda a: memory.inject_text(a["id"], a["text"], a.get("metadata"), a.get("ttl")),
        "memory_probe": lambda a: rows(memory.probe(parse_vector(a["vector"]) if isinstance(a["vector"], str) else a["vector"], a.get("k", 10))),
        "memory_probe_text": lambda a: rows(memory.probe_text(a["text"], a.get("k", 10))),
        "memory_probe_filtered": lambda a: rows(memory.probe(a["vector"], a.get("k", 10), filters.from_json(a["filter"]))),
        "memory_get": lambda a: memory.get(a["id"]),
        "memory_delete": lambda a: memory.delete(a["id"]),
        "memory_associate": lambda a: memory.associate([(a["from"], a["to"], float(a["strength"]))]),
        "memory_traverse": lambda a: rows(memory.traverse(a["start"], max_depth=a.get("max_depth", 3))),
        "memory_shortest_path": lambda a: memory.shortest_path(a["from"], a["to"]),
        "memory_stats": lambda a: memory.stats(),
        "memory_export": lambda a: memory.export(),
        "memory_list_gaps": lambda a: rows(memory.gaps(a.get("min_attempts", 3))),
        "memory_update": lambda a: memory.update(a["id"], [int(w) for w in tx.encode_text(a["vector_from_text"])] if "vector_from_text" in a else None, a.get("metadata"), a.get("merge", False)),
        "memory_import": lambda a: memory.import_file(a["path"], a.get("merge", False)),
        "memory_export_file": lambda a: (memory.export_binary if a.get("binary") else memory.export_json)(a["path"]),
        "memory_history": lambda a: rows(memory.history(a["id"], a.get("limit", 10)).drop("vector")),
        "memory_diff": lambda a: memory.diff(a["id"], a["from_version"], a["to_version"]),
        "memory_rollback": lambda a: memory.rollback(a["id"], a["version"]) if a.get("confirm") else _refuse("a rollback has to be confirmed"),
        "memory_probe_graph": lambda a: rows(memory.probe_graph(a["text"], a.get("k", 10), a.get("anchors", 10), a.get("hops", 2), a.get("min_strength", 0.1))),
        "memory_associations": lambda a: rows(memory.associations(a["id"], a.get("incoming", False))),
        "memory_associate_batch": lambda a: memory.associate_batch([(e[0], e[1], float(e[2])) for e in a["edges"]], a.get("continue_on_error", True)),
        "memory_index_dir": lambda a: memory.index_dir(a["paths"], a.get("sync", False), a.get("level", 2)),
        "memory_bridge": lambda a: memory.probe_bridge_text(a["text"], a.get("k", 10)),
        "memory_packet": lambda a: memory.memory_packet(a["text"], a.get("k", 10)),
        "memory_read": lambda a: read_resource(memory, a["uri"]),
        "memory_metrics": lambda a: memory.metrics.reset() if a.get("reset") else memory.metrics_snapshot(),
        "memory_storage": lambda a: memory.storage(),
        "memory_index_stats": lambda a: memory.index_stats(),
        "memory_delete_namespace": lambda a: memory.delete_namespace(a["namespace"]),
    }
    if name not in tools:
        raise KeyError(f"unknown tool {name}")
    return tools[name](args)


def _refuse(why: str) -> None:
    raise ValueError(why)


def run_analytics(memory: Memory, command: str, argument: dict) -> Any:
    """The analytics commands: ``inspect`` (tables and their rows), ``query`` (one SELECT), ``stats`` and ``export``
    (the analytics tables as Parquet with a manifest)."""
    match command:
        case "inspect":
            return {name: memory.table(name).count() for name in ("concepts", "associations", "versions")}
        case "query":
            return [json.loads(r.row) for r in analytics.as_json(memory.sql(argument["sql"])).toLocalIterator()]
        case "stats":
            return analytics.concept_summary(memory.concepts, memory.edges).first().asDict()
        case "export":
            concepts = memory.concepts.select("id", filters.searchable_text(F.col("metadata")).alias("text"), "namespace", (F.col("created_at") * 1_000_000).alias("created_at_us"), (F.col("modified_at") * 1_000_000).alias("updated_at_us"), (F.col("expires_at") * 1_000_000).alias("expires_at_us"), F.col("metadata").alias("metadata_json"))
            edges = memory.edges.select(F.col("from_id").alias("src_id"), F.col("to_id").alias("dst_id"), "strength")
            versions = memory.table("versions").select(F.col("concept_id").alias("id"), F.col("version").cast("int"), filters.searchable_text(F.col("metadata")).alias("text"), (F.col("modified_at") * 1_000_000).alias("created_us"))
            return json.loads(writers.export_all({"concepts": concepts, "associations": edges, "concept_versions": versions}, schemas.validate_analytics_path(argument["folder"])))
    raise KeyError(f"unknown command {command}")


def main(argv: list[str] | None = None) -> None:
    """``python -m tesserine.memory ROOT TOOL '{"arg": ..}'``, ``... ROOT analytics-COMMAND '{..}'`` or ``... ROOT sql 'SELECT ..'``."""
    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("root")
    parser.add_argument("tool")
    parser.add_argument("argument", nargs="?", default="{}")
    parser.add_argument("--namespace", default="_default")
    args = parser.parse_args(argv)
    memory = Memory(SparkSession.builder.getOrCreate(), args.root, args.namespace)
    if args.tool.startswith("analytics-"):
        print(json.dumps(run_analytics(memory, args.tool.removeprefix("analytics-"), json.loads(args.argument)), default=str))
        return
    if args.tool == "sql":
        analytics.cut_cells(memory.sql(args.argument)).show(truncate=False)
        return
    name = args.tool if args.tool.startswith("memory_") else f"memory_{args.tool.replace('-', '_')}"
    print(json.dumps(execute_tool(memory, name, json.loads(args.argument)), default=str))


if __name__ == "__main__":
    main()
