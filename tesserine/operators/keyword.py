"""BM25 over postings held as DataFrames."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Words, counted
from ..sources.schemas import check_k
from ..sources.tables import load_json, names, put_json, remove
from .kept import kept

K1, B = 1.2, 0.75


#: Postings that one task sorts.
SORTED_ROWS = 500_000


def _parts(postings: int) -> int:
    """Tasks that sort so many postings: what one holds does not grow with them."""
    return max(1, -(-postings // SORTED_ROWS))


@dataclass(frozen=True)
class Bm25:
    """Postings (``id``, ``term``, ``tf``) and document lengths (``id``, ``dl``).

    A kept index has ``dl`` in its postings, which are clustered by term, and ``totals`` (documents, mean length), so
    that a search reads the row groups of its terms and nothing else. ``words`` has a row for each document, with all its
    words (:func:`tesserine.functions.text.counted`); in an index that has ``single`` no id repeats there.
    """

    postings: DataFrame
    lengths: DataFrame
    totals: tuple[int, float] | None = None
    words: DataFrame | None = None
    single: bool = False

    #: Ids up to which those to be removed are sent to every executor.
    BROADCAST_ROWS = 2_000_000

    def keep(self, spark: SparkSession, name: str, state: str, folder: str | None = None) -> Bm25:
        """This index as kept tables for a state of its source; built where they aren't there yet.

        Texts are read once, and documents with their words kept first. Their postings are a further table.
        """
        if self.words is None:
            raise ValueError("an index that was added to has no words to keep")
        words = kept(spark, f"{name}-words", state, lambda: self.words, folder=folder)
        lengths, per_id = words.select("id", "dl"), words.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("words")).alias("postings"))
        counts = lambda: Bm25(self.postings, lengths).size().crossJoin(per_id.agg(F.sum("postings").alias("postings"), (F.coalesce(F.max("n"), F.lit(0)) <= 1).alias("single")))
        sums = kept(spark, f"{name}-sums", state, counts, folder=folder).first()
        index = Bm25._of(words, sums.single)
        # in an index whose ids repeat a posting meets each length of its id
        posted = lambda: words.select("id", "dl", F.inline("words")) if sums.single else index.postings.join(lengths, "id")
        postings = kept(spark, f"{name}-postings", state, lambda: posted().select("term", "id", "tf", "dl"), ["term", "id"], folder, _parts(sums.postings or 0))
        return Bm25(postings, lengths, (sums.n_docs, sums.avg_doc_length), words, sums.single)

    @staticmethod
    def build(docs: DataFrame, tokens: Column | Words, id_: str = "id") -> Bm25:
        """An index of token lists. Statistics span every row given, whatever a later search shows."""
        return Bm25._of(counted(docs, tokens, id_))

    @staticmethod
    def _of(words: DataFrame, single: bool = False) -> Bm25:
        postings = words.select("id", F.inline("words"))
        return Bm25(postings if single else postings.groupBy("id", "term").agg(F.sum("tf").alias("tf")), words.select("id", "dl"), None, words, single)

    def add(self, docs: DataFrame, tokens: Column | Words, id_: str = "id") -> Bm25:
        """Upsert documents."""
        new = Bm25.build(docs, tokens, id_)
        old = self.remove(new.lengths.select("id"))
        return Bm25(old.postings.select("id", "term", "tf").unionByName(new.postings), old.lengths.unionByName(new.lengths))

    def remove(self, ids: DataFrame) -> Bm25:
        """Without the documents of some ids. Where it has a row for each document, only those rows meet the ids."""
        if self.words is None:
            return Bm25(self.postings.join(ids, "id", "left_anti"), self.lengths.join(ids, "id", "left_anti"))
        few = ids.limit(self.BROADCAST_ROWS + 1).count() <= self.BROADCAST_ROWS
        return Bm25._of(self.words.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), "id", "left_anti"), self.single)

    def clear(self) -> Bm25:
        return Bm25(self.postings.limit(0), self.lengths.limit(0))

    def size(self) -> DataFrame:
        return self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_doc_length"))

    def overlaps(self, query: list[str]) -> bool:
        """Is any query term indexed?"""
        return not self.postings.where(F.col("term").isin(query)).isEmpty() if query else False

    def scores(self, query: list[str]) -> DataFrame:
        """``id`` and ``score`` of every document with a positive score, over the distinct query terms.

        The terms are a literal list. Those of a kept index prune its scan, and its postings bring the lengths; otherwise
        only documents that have one meet theirs. The few document frequencies, one a term, travel to every task.
        """
        terms = sorted(set(query))
        mine = self.postings.where(F.col("term").isin(terms) if terms else F.lit(False))
        frequency = F.broadcast(mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")).limit(max(1, len(terms))))
        n, average = (self.totals or self.size().first()) if terms else (0, 0.0)
        idf = F.log(F.lit(n + 1.0)) - F.log(F.col("df") + 0.5)
        length = F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(average or 1.0)
        part = idf * F.lit(K1 + 1) * F.col("tf") / (F.col("tf") + F.lit(K1) * length)
        met = mine.join(frequency, "term")
        if "dl" not in self.postings.columns:
            met = met.join(self.lengths, "id")
        return met.groupBy("id").agg(F.sum(part).alias("score")).where("score > 0")

    def search(self, query: list[str], k: int, allowed: DataFrame | None = None) -> DataFrame:
        """The best ``k``, of the ids in ``allowed`` if given. Filters come after the scores."""
        hits = self.scores(query)
        if allowed is not None:
            hits = hits.join(allowed.select("id"), "id", "left_semi")
        return hits.orderBy(F.desc("score"), "id").limit(check_k(k))


class Segments:
    """A keyword index that follows its documents: immutable segments, and of each what later ones put in its place.

    A segment has the postings of its documents, clustered by term with the lengths beside them, the lengths, and ``gone``:
    the ids that it speaks of, whether they are there still or not. A document counts where the newest segment with its id
    has it. An update builds one segment from the documents that changed; sums for the statistics are carried on. Many
    segments are merged: the later ones into one while they are small beside the first, else all.

    Which segments there are is one small file, ``state-<n>.json``, of which the last counts. Segments that are no longer
    named are left to running readers until :meth:`vacuum`.
    """

    #: Segments before some are merged; share of the first segment's documents that the others may have.
    MOST, SHARE = 8, 0.25
    #: Ids of later segments up to which they are sent to every executor.
    BROADCAST_ROWS = 1_000_000

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        return sorted(int(n[6:-5]) for n in names(self.spark, self.folder) if n.startswith("state-"))

    def state(self) -> dict | None:
        """``revision``, ``n`` and ``words`` of the documents that count, and ``segments`` as name and ids spoken of."""
        last = self._numbers()
        return load_json(self.spark, f"{self.folder}/state-{last[-1]}.json") | {"number": last[-1]} if last else None

    def _table(self, segment: str, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{segment}/{kind}")

    def _live(self, segments: list[list], kind: str) -> DataFrame:
        """Rows of all segments whose documents count."""
        parts = []
        for i, (name, _) in enumerate(segments):
            rows, later = self._table(name, kind), segments[i + 1 :]
            if kind == "lengths":  # segments of earlier versions have the words beside them
                rows = rows.select("id", "dl")
            if later:
                gone = reduce(DataFrame.unionByName, [self._table(n, "gone") for n, _ in later])
                gone = F.broadcast(gone) if sum(n for _, n in later) <= self.BROADCAST_ROWS else gone
                rows = rows.join(gone, "id", "left_anti")
            parts.append(rows)
        return reduce(DataFrame.unionByName, parts)

    def _write(self, name: str, postings: DataFrame, lengths: DataFrame, gone: DataFrame, rows: int) -> list:
        """A segment; its postings are sorted by as many tasks as their number, ``rows``, needs."""
        lengths.write.parquet(f"{self.folder}/{name}/lengths")
        postings.repartitionByRange(_parts(rows), "term", "id").sortWithinPartitions("term", "id").write.parquet(f"{self.folder}/{name}/postings")
        gone.distinct().write.parquet(f"{self.folder}/{name}/gone")
        return [name, self._table(name, "gone").count()]

    def _built(self, docs: DataFrame, tokens: Column | Words, gone: DataFrame | None) -> tuple[list, int, int]:
        """A segment of some documents, how many they are, and their words. Its texts are read once: the words counted
        are written, and removed when the segment is there."""
        name = uuid.uuid4().hex
        counted(docs, tokens).write.parquet(f"{self.folder}/{name}/words")
        words = self._table(name, "words")
        sums = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        # the length travels with each word, so that postings need no join
        postings = words.select("id", "dl", F.inline("words")).select("term", "id", "tf", "dl")
        segment = self._write(name, postings, words.select("id", "dl"), gone if gone is not None else words.select("id"), sums[2])
        remove(self.spark, f"{self.folder}/{name}/words")
        return segment, sums[0], sums[1]

    def refresh(self, revision: int, docs: DataFrame, tokens: Column | Words, changed: DataFrame | None = None) -> Bm25:
        """The index of ``docs`` (``id`` and what ``tokens`` reads) as of ``revision``. ``changed`` has the ids that may
        differ from what the index has, those that are gone included; without it all is built anew."""
        old = self.state()
        while old is None or old["revision"] < revision:
            if old is None or changed is None:
                segment, n, words = self._built(docs, tokens, None)
                new = {"revision": revision, "n": n, "words": words, "segments": [segment]}
            elif changed.isEmpty():
                new = {**old, "revision": revision}
            else:
                before = self._live(old["segments"], "lengths").join(F.broadcast(changed), "id", "left_semi").agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0))).first()
                segment, n, words = self._built(docs.join(F.broadcast(changed), "id", "left_semi"), tokens, changed)
                new = {"revision": revision, "n": old["n"] - before[0] + n, "words": old["words"] - before[1] + words, "segments": self._merged([*old["segments"], segment])}
            number = (old["number"] if old else 0) + 1
            new.pop("number", None)
            if not put_json(self.spark, f"{self.folder}/state-{number}.json", new):
                changed = None  # another session was first; if it was at an older revision, build anew
            old = self.state()
        return self.view(old)

    def _merged(self, segments: list[list]) -> list[list]:
        if len(segments) <= self.MOST:
            return segments
        small = sum(n for _, n in segments[1:]) <= self.SHARE * segments[0][1]
        some = segments[1:] if small else segments
        gone = reduce(DataFrame.unionByName, [self._table(n, "gone") for n, _ in some])
        postings = self._live(some, "postings")
        made = self._write(uuid.uuid4().hex, postings, self._live(some, "lengths"), gone, sum(self._table(n, "postings").count() for n, _ in some))
        return [segments[0], made] if small else [made]

    def view(self, state: dict | None = None) -> Bm25:
        own = state or self.state()
        return Bm25(self._live(own["segments"], "postings"), self._live(own["segments"], "lengths"), (own["n"], own["words"] / own["n"] if own["n"] else 0.0))

    def vacuum(self) -> None:
        """Remove what the last state does not name. Other readers must have ended."""
        own = self.state()
        used = {n for n, _ in own["segments"]} | {f"state-{own['number']}.json"} if own else set()
        for name in names(self.spark, self.folder):
            if name not in used:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
