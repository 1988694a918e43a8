"""Upserts, deletions, time to live, retention, version history and the cache of absences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hypervector as hv
from ..sources.schemas import LIMITS
from ..sources.tables import cut
from .graph import with_decay


def upserted(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``current`` by key; a key repeated in ``new`` is its last row by ``modified_at``."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("modified_at"))
    new = new.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def merged(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As :func:`upserted`, but rows that exist keep their ``created_at``."""
    old = current.select(*keys, F.col("created_at").alias("_old"))
    kept = new.join(old, keys, "left").withColumn("created_at", F.coalesce("_old", "created_at")).drop("_old")
    return upserted(current, kept.select(new.columns), keys)


def with_ttl(rows: DataFrame, now: int, seconds: Column) -> DataFrame:
    """``expires_at`` after ``seconds``, capped; a null ``seconds`` never expires."""
    return rows.withColumn("expires_at", F.lit(now) + F.least(seconds, F.lit(LIMITS["ttl_seconds"])))


def ttl_policy(rows: DataFrame, fixed: int | None = None, rules: list[tuple[Column, int]] | None = None, inherit: DataFrame | None = None, now: int = 0) -> DataFrame:
    """``ttl`` by a fixed number, by the first rule that holds, or inherited: the remaining time of the out-neighbour of
    smallest id that expires (``inherit`` has ``id``, ``to_id``, ``expires_at``)."""
    if fixed is not None:
        return rows.withColumn("ttl", F.lit(fixed).cast("long"))
    if rules:
        ttl = F.lit(None).cast("long")
        for when, seconds in reversed(rules):
            ttl = F.when(F.coalesce(when, F.lit(False)), F.lit(seconds).cast("long")).otherwise(ttl)
        return rows.withColumn("ttl", ttl)
    if inherit is not None:
        first = inherit.where(F.col("expires_at") > now).groupBy("id").agg(F.min_by("expires_at", "to_id").alias("_e"))
        return rows.join(first, "id", "left").withColumn("ttl", F.col("_e") - now).drop("_e")
    return rows.withColumn("ttl", F.lit(None).cast("long"))


def evicted(concepts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows created last; ties stay by larger id. A global top-k, not a window over everything."""
    return concepts.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def associated(edges: DataFrame, new: DataFrame, concepts: DataFrame, now: int, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Edges after an upsert of the valid ones of ``new`` (``from_id``, ``to_id``, ``strength``), and the invalid ones.

    A strength lies in [0, 1] and both ends exist. With ``most`` a node keeps its strongest edges, ties by ``to_id``.
    """
    ids = concepts.select("id").distinct()
    ends = new.join(ids.select(F.col("id").alias("from_id"), F.lit(True).alias("_f")), "from_id", "left").join(ids.select(F.col("id").alias("to_id"), F.lit(True).alias("_t")), "to_id", "left")
    good = F.coalesce(F.col("_f") & F.col("_t") & F.col("strength").between(0.0, 1.0), F.lit(False))
    checked = ends.withColumn("_ok", good).select(*new.columns, "_ok")
    valid = checked.where("_ok").groupBy("from_id", "to_id").agg(F.max("strength").alias("strength")).withColumn("created_at", F.lit(now).cast("long"))
    out = edges.select("from_id", "to_id", "strength", "created_at").join(valid.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").unionByName(valid)
    if most is not None:
        strongest = Window.partitionBy("from_id").orderBy(F.desc("strength"), "to_id")
        out = out.withColumn("_r", F.row_number().over(strongest)).where(F.col("_r") <= most).drop("_r")
    return out, checked.where(~F.col("_ok")).drop("_ok")


def updated(current: DataFrame, changes: DataFrame, keys: list[str], now: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``current`` with the columns of ``changes`` (a null one keeps the old value) and a new ``modified_at``, and
    the keys of ``changes`` that are not there."""
    own = [c for c in changes.columns if c not in keys]
    named = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_hit"))
    both = current.join(named, keys)
    made = both.select(*[F.coalesce(f"_{c}", c).alias(c) if c in own else F.lit(now).cast("long").alias(c) if c == "modified_at" else F.col(c) for c in current.columns])
    return made, changes.select(*keys).join(current.select(*keys), keys, "left_anti")


def metadata_merged(old: Column, new: Column) -> Column:
    """JSON objects merged key by key, the new value of a key that both have."""
    entries = lambda c: F.map_entries(F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>"))
    kept = F.filter(entries(old), lambda e: ~F.array_contains(F.coalesce(F.json_object_keys(new), F.array().cast("array<string>")), e["key"]))
    return F.to_json(F.map_from_entries(F.concat(kept, entries(new))))


def disassociated(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")


def cleared(edges: DataFrame, node: str) -> DataFrame:
    """Without the out-edges of a node."""
    return edges.where(F.col("from_id") != node)


def reinforced(edges: DataFrame, start: str, end: str, now: int) -> DataFrame:
    """The edge's clock starts again; its strength stays."""
    return edges.withColumn("created_at", F.when((F.col("from_id") == start) & (F.col("to_id") == end), F.lit(now)).otherwise(F.col("created_at")))


def pruned(edges: DataFrame, now: int, least: float, **curve: object) -> DataFrame:
    """Edges whose decayed strength is at least ``least``, with their own strength."""
    worn = with_decay(edges.withColumn("_raw", F.col("strength")), now, **curve)
    return worn.where(F.col("strength") >= least).withColumn("strength", F.col("_raw")).drop("_raw")


def deleted(concepts: DataFrame, edges: DataFrame, versions: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three tables without the ids, edges in both directions."""
    gone = ids.select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(gone.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    return concepts.join(gone, "id", "left_anti"), left, versions.join(gone.withColumnRenamed("id", "concept_id"), "concept_id", "left_anti")


def expired_ids(concepts: DataFrame, edges: DataFrame, now: int, cascade: bool = False) -> DataFrame:
    """Ids whose time is over; with ``cascade`` all that their out-edges reach too."""
    gone = front = cut(concepts.where(F.col("expires_at") <= now).select("id").distinct())
    while cascade and not front.isEmpty():
        front = cut(front.join(edges.select(F.col("from_id").alias("id"), "to_id"), "id").select(F.col("to_id").alias("id")).distinct().join(gone, "id", "left_anti"))
        gone = gone.unionByName(front)
    return gone


def retained(versions: DataFrame, keep: int = LIMITS["versions"]) -> DataFrame:
    """The last ``keep`` versions of each concept by number."""
    last = versions.groupBy("concept_id").agg(F.max("version").alias("_last"))
    return versions.join(last, "concept_id").where(F.col("version") > F.col("_last") - keep).drop("_last")


def next_version(versions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows as new versions, one above the last of their concept."""
    last = versions.groupBy("concept_id").agg(F.max("version").alias("_last"))
    return rows.join(last, "concept_id", "left").withColumn("version", F.coalesce("_last", F.lit(0)) + 1).drop("_last")


def history(versions: DataFrame, id_: str, limit: int = 1000) -> DataFrame:
    """Versions of a concept, the newest first."""
    return versions.where(F.col("concept_id") == id_).orderBy(F.desc("version")).limit(min(limit, 1000))


def changes(versions: DataFrame, compared: dict[str, str]) -> DataFrame:
    """For each version and each ``compared`` column whether it differs from the version before; the first does."""
    order = Window.partitionBy("concept_id").orderBy("version")
    first = F.row_number().over(order) == 1
    return versions.select("concept_id", "version", *[(first | ~F.col(c).eqNullSafe(F.lag(c).over(order))).alias(name) for c, name in compared.items()])


def version_at(versions: DataFrame, concepts: DataFrame, id_: str, version: int) -> DataFrame:
    """One version, with creation and expiry of the current row where there is one."""
    now = concepts.select(F.col("id").alias("concept_id"), "created_at", "expires_at")
    own = versions.where((F.col("concept_id") == id_) & (F.col("version") == version))
    return own.join(now, "concept_id", "left").withColumn("created_at", F.coalesce("created_at", "modified_at"))


def diff(versions: DataFrame, id_: str, old: int, new: int, words: int = hv.WORDS) -> DataFrame:
    """Distance of two versions' vectors, and the metadata added, removed and changed."""
    side = lambda v: versions.where((F.col("concept_id") == id_) & (F.col("version") == v)).select("concept_id", "vector", F.from_json("metadata", "map<string,string>").alias("m"))
    a, b = side(old).alias("a"), side(new).alias("b")
    both = a.join(b, F.col("a.concept_id") == F.col("b.concept_id"))
    has = F.map_contains_key
    return both.select(
        (1 - hv.cosine(F.col("a.vector"), F.col("b.vector"), words)).alias("vector_cosine_distance"),
        F.map_filter("b.m", lambda k, _: ~has(F.col("a.m"), k)).alias("added"),
        F.map_filter("a.m", lambda k, _: ~has(F.col("b.m"), k)).alias("removed"),
        F.map_filter(F.map_zip_with("a.m", "b.m", lambda k, x, y: F.struct(x.alias("from"), y.alias("to"))), lambda k, v: has(F.col("a.m"), k) & has(F.col("b.m"), k) & ~v["from"].eqNullSafe(v["to"])).alias("changed"),
    )


def rolled_back(versions: DataFrame, id_: str, version: int, now: int) -> DataFrame:
    """The old version once more, as a new one."""
    own = versions.where((F.col("concept_id") == id_) & (F.col("version") == version)).drop("version").withColumn("modified_at", F.lit(now).cast("long"))
    return versions.unionByName(next_version(versions, own).select(versions.columns))


def absences_merged(absences: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of abstentions: attempts count up within one namespace and revision and start again in another; the best
    score ever is kept."""
    old = absences.select("id", F.col("attempt_count").alias("_n"), F.col("best_score_ever").alias("_b"), F.col("first_seen").alias("_f"), F.col("namespace").alias("_ns"), F.col("namespace_revision").alias("_rev"))
    both = new.join(old, "id", "left")
    same = F.coalesce((F.col("_ns") == F.col("namespace")) & (F.col("_rev") == F.col("namespace_revision")), F.lit(False))
    both = both.withColumn("attempt_count", F.when(same, F.col("_n") + 1).otherwise(F.lit(1)).cast("int"))
    both = both.withColumn("best_score_ever", F.greatest("best_score_ever", "_b")).withColumn("first_seen", F.coalesce("_f", "first_seen"))
    return absences.join(new.select("id"), "id", "left_anti").unionByName(both.select(absences.columns))


def short_circuits(absences: DataFrame, namespace: str, revision: int, now: Column, attempts: int = 3, seconds: int = 300) -> DataFrame:
    """Queries known to have no answer: enough attempts at this revision, the last less than ``seconds`` ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_seen")
    return absences.where((F.col("attempt_count") >= attempts) & (F.col("namespace") == namespace) & (F.col("namespace_revision") == revision) & (age >= 0) & (age < seconds))


def gaps(absences: DataFrame, attempts: int) -> DataFrame:
    return absences.where(F.col("attempt_count") >= attempts).orderBy(F.desc("attempt_count"), "id")
