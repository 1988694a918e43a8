"""The conversation benchmark: sessions and cases from a seed, ingestion, answers and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..memory import Memory
from ..operators import analytics, filters, fusion, keyword, lifecycle
from ..sources.tables import cut

#: What sessions speak of.
FACTS = {"favorite_color": ("red", "blue", "green", "amber"), "home_city": ("Lisbon", "Oslo", "Quito", "Kyoto"), "pet_name": ("Milo", "Luna", "Rex", "Ivy")}
ABSTAIN_BELOW = 0.1
# The least weight of a hit without a shared word, the least scores that hits keep, and the graph's part.
OVERLAP_FLOOR, ADJUSTED_LEAST, VECTOR_LEAST, GRAPH_WEIGHTS = 0.05, 0.05, 0.15, (0.7, 0.3)


def _pick(options: tuple[str, ...], *seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(*seed), F.lit(len(options))) + 1).cast("int"))


def sessions(spark: SparkSession, seed: int, n: int, versions: int = 2) -> DataFrame:
    """Turns of ``n`` sessions: each fact told ``versions`` times, the later one an update."""
    turns = []
    base = spark.range(n).select(F.format_string("session-%04d", "id").alias("session_id"))
    for v in range(1, versions + 1):
        for fact, options in FACTS.items():
            value = _pick(options, F.lit(seed), "session_id", F.lit(fact), F.lit(v))
            name = fact.replace("_", " ")
            turns.append(base.select("session_id", F.lit(len(turns)).alias("turn"), F.concat("session_id", F.lit(f":{fact}:v{v}")).alias("memory_id"), F.concat(F.lit(f"My {name} is "), value).alias("text"), value.alias("value"), F.lit(name).alias("fact"), F.lit(v).alias("version")))
    out = turns[0]
    for t in turns[1:]:
        out = out.unionByName(t)
    return out


def base_id(memory_id: Column) -> Column:
    return F.regexp_replace(memory_id, r":v\d+$", "")


def version_of(memory_id: Column) -> Column:
    return F.coalesce(F.regexp_extract(memory_id, r":v(\d+)$", 1).try_cast("int"), F.lit(0))


def previous_version(memory_id: Column) -> Column:
    n = version_of(memory_id)
    return F.when(n >= 2, F.concat(base_id(memory_id), F.lit(":v"), (n - 1).cast("string")))


def latest(turns: DataFrame) -> DataFrame:
    """Turns without those that a later version of the same memory replaces."""
    last = turns.groupBy(base_id(F.col("memory_id")).alias("_b")).agg(F.max(version_of(F.col("memory_id"))).alias("_v"))
    return turns.withColumn("_b", base_id(F.col("memory_id"))).join(last, "_b").where(version_of(F.col("memory_id")) == F.col("_v")).drop("_b", "_v")


def neighbour_links(turns: DataFrame) -> DataFrame:
    """Each memory to the one before it in its session at 0.8, and back at 0.4."""
    order = Window.partitionBy("session_id").orderBy("turn", "memory_id")
    near = turns.withColumn("_p", F.lag("memory_id").over(order)).where("_p is not null")
    return near.select(F.col("_p").alias("from_id"), F.col("memory_id").alias("to_id"), F.lit(0.8).alias("strength")).unionByName(near.select(F.col("memory_id").alias("from_id"), F.col("_p").alias("to_id"), F.lit(0.4).alias("strength")))


def overlap_links(turns: DataFrame, least: float = 0.3) -> DataFrame:
    """Memories of other sessions that hold over ``least`` of a memory's tokens, at half of that share.

    More than ``least`` of ``n`` tokens can't all miss any ``n - floor(least n)`` of them, so only the rarest so many of
    a memory are joined, and common words meet no one.
    """
    stop = F.array(*[F.lit(w) for w in tx.STOPWORDS])
    own = turns.select("memory_id", "session_id", F.array_distinct(F.filter(tx.tokenize_keywords(F.col("text")), lambda t: ~F.array_contains(stop, t))).alias("tokens"))
    each = own.select("memory_id", F.explode("tokens").alias("token"))
    rank = Window.partitionBy("memory_id").orderBy("df", "token")
    rare = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token").withColumn("r", F.row_number().over(rank))
    rare = rare.join(own.select("memory_id", F.size("tokens").alias("n")), "memory_id").where(F.col("r") <= F.col("n") - F.floor(F.lit(least) * F.col("n")))
    pairs = rare.alias("a").join(each.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.memory_id") != F.col("b.memory_id"))).select(F.col("a.memory_id").alias("from_id"), F.col("b.memory_id").alias("to_id")).distinct()
    x, y = own.select(F.col("memory_id").alias("from_id"), F.col("tokens").alias("x"), F.col("session_id").alias("sx")), own.select(F.col("memory_id").alias("to_id"), F.col("tokens").alias("y"), F.col("session_id").alias("sy"))
    share = F.size(F.array_intersect("x", "y")) / F.size("x")
    return pairs.join(x, "from_id").join(y, "to_id").where(F.col("sx") != F.col("sy")).withColumn("share", share).where(F.col("share") > least).select("from_id", "to_id", (0.5 * F.col("share")).alias("strength"))


def cases(turns: DataFrame) -> DataFrame:
    """One recall case for each fact of a session, and one that should be abstained from."""
    told = latest(turns).select(F.concat("session_id", F.lit(":"), "fact").alias("query_id"), "session_id", F.lit("recall").alias("task_type"), F.concat(F.lit("What is my "), "fact").alias("query"), F.array("memory_id").alias("gold"), F.col("value").alias("expected"), F.lit(False).alias("should_abstain"))
    none = turns.select("session_id").distinct().select(F.concat("session_id", F.lit(":none")).alias("query_id"), "session_id", F.lit("abstain").alias("task_type"), F.lit("zyzzyva quokka").alias("query"), F.array().cast("array<string>").alias("gold"), F.lit(None).cast("string").alias("expected"), F.lit(True).alias("should_abstain"))
    return told.unionByName(none)


def answers(turns: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """Ranked memories of each case by BM25 within its session: a join on session and term, never of all pairs."""
    index = keyword.Bm25.build(latest(turns).select(F.col("memory_id").alias("id"), "text"), tx.tokenize_keywords(F.col("text")))
    n, average = index.size().first()
    terms = asked.select("query_id", "session_id", F.explode(F.array_distinct(tx.tokenize_keywords(F.col("query")))).alias("term"))
    frequency = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = index.postings.join(index.lengths, "id").join(frequency, "term").withColumn("session_id", F.split_part("id", F.lit(":"), F.lit(1)))
    idf = F.log(F.lit(n + 1.0)) - F.log(F.col("df") + 0.5)
    part = idf * (keyword.K1 + 1) * F.col("tf") / (F.col("tf") + keyword.K1 * (1 - keyword.B + keyword.B * F.col("dl") / F.lit(average or 1.0)))
    hits = terms.join(own, ["session_id", "term"]).groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("l"), F.max("score").alias("top"))
    made = asked.join(ranked, "query_id", "left")
    got = F.coalesce(F.transform("l", lambda x: x["id"]), F.array().cast("array<string>"))
    return made.withColumn("retrieved", got).withColumn("abstained", F.coalesce(F.col("top") < ABSTAIN_BELOW, F.lit(True))).drop("l", "top")


def predicted(asked: DataFrame, turns: DataFrame) -> DataFrame:
    """The expected answer where the retrieved texts hold it, and whether that matches."""
    texts = asked.select("query_id", F.explode_outer("retrieved").alias("memory_id")).join(turns.select("memory_id", "text"), "memory_id", "left")
    context = texts.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("text")), " ").alias("context"))
    both = asked.join(context, "query_id")
    answer = F.when(F.coalesce(F.contains(F.lower("context"), F.lower("expected")), F.lit(False)), F.col("expected")).otherwise(F.lit(""))
    return both.withColumn("predicted", answer).withColumn("exact_match", exact_match(F.col("predicted"), F.col("expected")))


def exact_match(answer: Column, expected: Column) -> Column:
    return F.lower(F.trim(answer)) == F.lower(F.trim(expected))


def scored(answered: DataFrame) -> DataFrame:
    gold, got = F.col("gold"), F.col("retrieved")
    return answered.withColumns({"recall_at_5": analytics.recall_at(gold, got, 5), "reciprocal_rank": analytics.reciprocal_rank(gold, got), "ndcg_at_10": analytics.ndcg_at(gold, got, 10)})


class Conversations:
    """Told turns in a memory, and the ways to ask it. Ids are ``<session>:<fact>:v<n>``; hits are ``id`` and ``score``."""

    def __init__(self, memory: Memory) -> None:
        self.memory = memory

    def ingest(self, turns: DataFrame) -> None:
        """Store the latest version of each turn as a concept, and link it to its neighbours and to others that share words."""
        told = cut(latest(turns))
        vector = tx.encoder()(F.col("text"))
        self.memory.upsert(told.select(F.col("memory_id").alias("id"), vector.alias("vector"), F.to_json(F.struct(F.col("text").alias("searchable_text"), "session_id")).alias("metadata")))
        links = neighbour_links(told).unionByName(overlap_links(told)).groupBy("from_id", "to_id").agg(F.max("strength").alias("strength"))
        good, _ = lifecycle.associated(self.memory.edges.limit(0), links, self.memory.concepts, self.memory.now)
        self.memory._written("associations", good.withColumn("namespace", F.lit(self.memory.namespace)))

    def texts(self) -> DataFrame:
        return self.memory.concepts.select("id", F.get_json_object("metadata", "$.searchable_text").alias("text"))

    def words(self, text: str) -> list[str]:
        return list(self.memory.spark.range(1).select(tx.tokenize_keywords(F.lit(text)).alias("t")).first().t)

    def index(self) -> keyword.Bm25:
        return self.memory.keyword_index("turns", F.get_json_object("metadata", "$.searchable_text"), tx.tokenize_keywords(F.col("text")))

    def _of(self, session: str | None) -> DataFrame | None:
        """Ids of a session's turns; all without one."""
        return None if session is None else self.memory.concepts.where(F.get_json_object("metadata", "$.session_id") == session).select("id")

    def _reweighted(self, hits: DataFrame, text: str, k: int) -> DataFrame:
        """Scores by the share of the question's words that a text has; little is left without any."""
        asked = F.array(*[F.lit(w) for w in self.words(text)]) if self.words(text) else F.array().cast("array<string>")
        share = tx.overlap_ratio(asked, tx.tokenize_keywords(F.col("text")))
        both = hits.join(self.texts(), "id").withColumn("score", F.col("score") * (OVERLAP_FLOOR + (1 - OVERLAP_FLOOR) * share))
        return both.where(F.col("score") >= ADJUSTED_LEAST).select("id", "score").orderBy(F.desc("score"), "id").limit(k)

    def _within(self, hits: DataFrame, session: str | None, k: int) -> DataFrame:
        own = hits if session is None else hits.where(F.col("id").startswith(f"{session}:"))
        return own.orderBy(F.desc("score"), "id").limit(k)

    def query(self, text: str, k: int) -> DataFrame:
        """Vectors expanded over links, and keywords, fused."""
        vector = [int(w) for w in tx.encode_text(text)]
        near = self.memory.probe_vector_graph(vector, 3 * k, k, 2, 0.1, GRAPH_WEIGHTS).select("id", "score").where(F.col("score") >= VECTOR_LEAST)
        asked = self.words(text)
        hits = self.index().search(asked, 3 * k)
        return self._reweighted(cut(fusion.merge(hits, near, fusion.weights(len(asked)), k)), text, k)

    def query_association(self, text: str, k: int) -> DataFrame:
        return self.query(text, k)

    def query_in_session(self, text: str, session: str, k: int) -> DataFrame:
        """Vectors and keywords of one session, fused."""
        wide, asked = 3 * k, self.words(text)
        vector = [int(w) for w in tx.encode_text(text)]
        # other sessions are left out before the best are taken, so none of this one is crowded out
        near = self.memory.probe(vector, wide, filters.eq("session_id", session)).select("id", "score")
        hits = self.index().search(asked, wide, self._of(session))
        return self._reweighted(cut(fusion.merge(hits, near, fusion.weights(len(asked)), k)), text, k)

    def query_in_session_association(self, text: str, session: str, k: int) -> DataFrame:
        return self._within(self.query(text, 10 * k), session, k)

    def query_bm25(self, text: str, session: str | None, k: int) -> DataFrame:
        return self.index().search(self.words(text), k, self._of(session))

    def query_bridge(self, text: str, session: str | None, k: int) -> DataFrame:
        hits = self.memory.bridge_hits(text, 10 * k).select("id", F.col("final_score").alias("score"))
        return self._within(hits, session, k)

    def query_hybrid(self, text: str, session: str | None, k: int) -> DataFrame:
        return self.query(text, k) if session is None else self.query_in_session(text, session, k)

    def query_history(self, id_: str, limit: int) -> DataFrame:
        return self.memory.history(id_, limit)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line for each case."""
    results.write.mode("overwrite").json(path)


def run(spark: SparkSession, seed: int = 42, n: int = 20) -> DataFrame:
    """Generate, ingest, answer and sum up by task."""
    turns = sessions(spark, seed, n)
    return analytics.quality(scored(answers(turns, cases(turns))).withColumn("latency", F.lit(0)), ["task_type"])
