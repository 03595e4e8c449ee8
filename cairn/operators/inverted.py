"""A stored keyword index: postings by term in blocks of ids, kept up from changed revisions, searched by block maxima.

A folder holds five tables, each in segments that only an update adds: `postings` (a row for each term and block of `block`
consecutive ids, partitioned by a bucket of terms: which of the ids, with weighted frequency, size and places, the largest
frequency and the smallest size; a few rows where documents of a block were read apart), `forward` (revision and size of each
document), `dead` (documents of earlier segments that a later one replaced or took out), `df` (signed changes of document
frequencies) and `stats` (signed changes of the number of documents and words). The stats of a segment are written last: what
has none isn't seen, and is written anew by the next update.

Words are turned into postings where a document is read, so neither texts nor words are shuffled, unless documents of a block
lie far apart; then texts are, once. Sets of ids travel as bits by block.

A search reads the buckets of its terms. The largest frequency and the smallest size bound what a document of a block can
score; the blocks of the highest bounds are scored first, and then only those whose bound reaches the k-th best score so
far. The result equals search.bm25() over the documents that the index holds, cut to the best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_words
from .graph import cut
from .search import MEMORY_WEIGHTS, _few, bm25_part, split_terms, top

#: Places of the columns of a document stand so far apart.
APART = 1 << 24


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


#: Words that a task puts in order at once; documents of a staged file, as large ones would make tasks spill their postings;
#: blocks whose scores are summed up in one task.
AT_ONCE, STAGED, BLOCKS_A_TASK = 1 << 22, 512, 16


def _inverted(weights: list[float], block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of postings of documents(id, size, words by column), for mapInArrow."""

    def starts(*keys: np.ndarray) -> np.ndarray:
        changes = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
        return np.flatnonzero(np.r_[True, changes])

    def lists(first: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[first, len(values)], pa.int32()), values)

    def one(docs: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes, texts = docs["id"].to_numpy().astype("int64"), docs["size"].to_numpy(), docs["words"].flatten()
        n = pc.list_value_length(texts).to_numpy().astype("int64")
        words = texts.flatten().dictionary_encode()
        text = np.repeat(np.arange(len(n)), n)
        order = np.argsort(words.indices.to_numpy(), kind="stable")  # documents and places stay in order
        at = (text % len(weights) * APART + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))[order]
        term, doc = words.indices.to_numpy()[order], (text // len(weights))[order]
        first = starts(term, ids[doc])
        tf = sum(np.add.reduceat((at // APART == i).astype("float64"), first) * w for i, w in enumerate(weights))
        term, own, size = term[first], ids[doc[first]], sizes[doc[first]]
        row = starts(term, own // block)
        parts = {
            "term": words.dictionary.take(pa.array(term[row])).cast(pa.string()), "block": pa.array(own[row] // block),
            "docs": lists(row, pa.array((own % block).astype("int32"))), "tfs": lists(row, pa.array(tf)), "sizes": lists(row, pa.array(size)),
            "ats": lists(row, lists(first, pa.array(at.astype("int32")))), "most": pa.array(np.maximum.reduceat(tf, row)), "least": pa.array(np.minimum.reduceat(size, row)),
        }
        return pa.RecordBatch.from_pydict(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pc.array_sort_indices(b["id"])) if len(b) else b
            b = b.filter(pc.greater(b["size"], 0))
            total = np.cumsum(b["size"].to_numpy())
            cuts = [*starts(total // AT_ONCE), len(b)] if len(b) else []
            for i, j in zip(cuts, cuts[1:]):
                yield one(b.slice(i, j - i))

    return run


def _in_column(at: Column, column: int) -> Column:
    return F.filter(at, lambda x: F.floor(x / APART) == column)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


#: What a row of postings has for each document; docs are their places in the block.
LISTS = ("docs", "tfs", "sizes", "ats")
#: Tables that are partitioned by bucket: a segment without rows has no file that a schema could be read from.
SCHEMAS = {
    "postings": "term string, block long, docs array<int>, tfs array<double>, sizes array<int>, ats array<array<int>>, most double, least int, seg int, bucket int",
    "df": "term string, n long, seg int, bucket int",
}


@dataclass(frozen=True)
class InvertedIndex:
    spark: SparkSession
    folder: str
    weights: dict[str, float] = field(default_factory=lambda: dict(MEMORY_WEIGHTS))
    buckets: int = 64
    block: int = 1024
    #: Blocks of each query that are scored before any is left out.
    probe: int = 4

    # ---- what is stored

    def segments(self) -> list[int]:
        """Segments whose update has ended, a row each."""
        if not exists(self.spark, f"{self.folder}/stats"):
            return []
        return sorted(r.seg for r in self.spark.read.parquet(f"{self.folder}/stats").select("seg").distinct().collect())

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else self.spark.read
        return reader.parquet(f"{self.folder}/{name}").filter(F.col("seg").isin(self.segments()))

    def live(self) -> DataFrame:
        """id, revision and size of the documents that the index holds, with their segments."""
        dead = self.table("dead").select(F.col("of").alias("seg"), "id")
        return self.table("forward").select("seg", "id", "revision", "size").join(dead, ["seg", "id"], "left_anti")

    def _write(self, df: DataFrame, name: str, seg: int, by: list[str] | None = None) -> None:
        writer = df.write.mode("overwrite").options(compression="zstd", **({"maxRecordsPerFile": STAGED} if name == "staged" else {}))
        (writer.partitionBy(*by) if by else writer).parquet(f"{self.folder}/{name}/seg={seg}")

    def _bucket(self, term: str = "term") -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _block(self) -> Column:
        return F.expr(f"(id - pmod(id, {self.block})) div {self.block}")

    def _slot(self, place: Column, seg: Column | None = None) -> Column:
        slot = F.floor(place / 64)
        return (slot if seg is None else slot + seg * -(-self.block // 64)).cast("long")

    def _bits(self, ids: DataFrame, name: str) -> DataFrame:
        """block and `name`, which of its ids are among ids(id, and seg if they differ by segment): longs of 64 bits by slot."""
        place = F.pmod("id", F.lit(self.block))
        slot = self._slot(place, F.col("seg") if "seg" in ids.columns else None)
        rows = ids.filter("id is not null").select(self._block().alias("block"), slot.alias("slot"), (place % 64).cast("int").alias("bit"))
        rows = rows.groupBy("block", "slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
        return _few(cut(rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("slot", "bits"))).alias(name))))

    def _among(self, name: str, place: Column, seg: Column | None = None) -> Column:
        return F.getbit(F.coalesce(F.try_element_at(F.col(name), self._slot(place, seg)), F.lit(0).cast("long")), (place % 64).cast("int")) == 1

    def _lie_by_id(self, docs: DataFrame) -> bool:
        """Whether most blocks are read by one task."""
        places = docs.select(self._block().alias("block"), F.spark_partition_id().alias("task")).distinct()
        n = places.agg(F.count("*").alias("places"), F.count_distinct("block").alias("blocks")).first()
        return n.places <= 2 * n.blocks

    # ---- changing

    def update(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Indexes those of docs(id, revision and the weighted columns; a row for each id) that the index doesn't hold in that
        revision, takes the ids of gone out, and returns the number of the segment. Only changed documents are tokenised, and
        of old postings only ids are read back."""
        held = self.segments()
        seg = (held[-1] if held else -1) + 1
        words = {c: index_words(F.col(c)) for c in self.weights}
        size = reduce(lambda a, b: a + b, [F.size(w) for w in words.values()])
        new = docs.select("id", "revision", *self.weights)
        if held or gone is not None:
            changed = docs.select("id", "revision")
            if held:
                changed = changed.join(self.live().select("id", "revision"), ["id", "revision"], "left_anti")
            if gone is not None:
                changed = changed.join(gone.select("id"), "id", "left_anti")
            new = new.withColumn("block", self._block()).join(self._bits(changed, "changed"), "block", "left")
            new = new.filter(F.col("id").isNull() | self._among("changed", F.pmod("id", F.lit(self.block)))).drop("changed")
        if not self._lie_by_id(docs):
            new = new.withColumn("block", self._block()).repartition("block").sortWithinPartitions("block", "id")
        # Words are staged in files, which are a fraction of a checkpoint of words with their places.
        self._write(new.select("id", "revision", size.alias("size"), F.array(*words.values()).alias("words")), "staged", seg)
        new = self.spark.read.parquet(f"{self.folder}/staged/seg={seg}")
        out = None
        if held:
            ids = new.select("id") if gone is None else new.select("id").union(gone.select("id"))
            out = cut(self.live().join(ids.distinct(), "id", "left_semi").select("seg", "id", "size"))
        schema = SCHEMAS["postings"].split(", seg int")[0]
        rows = new.filter("id is not null").select("id", "size", "words").mapInArrow(_inverted(list(self.weights.values()), self.block), schema)
        self._write(rows.withColumn("bucket", self._bucket()).sortWithinPartitions("bucket", "term", "block"), "postings", seg, ["bucket"])
        self._write(new.select("id", "revision", "size"), "forward", seg)
        nothing = self.spark.createDataFrame([], "of int, id long")
        self._write(nothing if out is None else out.select(F.col("seg").cast("int").alias("of"), "id"), "dead", seg)
        df = new.select(F.explode(F.array_distinct(F.flatten("words"))).alias("term"), F.lit(1).alias("n"))
        size = new.select(F.lit(1).alias("docs"), "size")
        if out is not None:
            old = self._postings().select("seg", "term", "block", "docs").join(self._bits(out, "out"), "block")
            lost = F.size(F.filter("docs", lambda x: self._among("out", x, F.col("seg"))))
            df = df.union(old.select("term", (-lost).alias("n")).filter("n <> 0"))
            size = size.union(out.select(F.lit(-1).alias("docs"), (-F.col("size")).alias("size")))
        df = df.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").withColumn("bucket", self._bucket())
        self._write(df.repartition("bucket"), "df", seg, ["bucket"])
        self._write(size.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).coalesce(1), "stats", seg)
        delete(self.spark, f"{self.folder}/staged")
        return seg

    def _weighed(self, at: Column) -> Column:
        by = [F.size(_in_column(at, i)) * w for i, w in enumerate(self.weights.values())]
        return reduce(lambda a, b: a + b, by).cast("double")

    def compacted(self, folder: str) -> InvertedIndex:
        """The same index in one segment in another folder, without what is dead; no text is read."""
        new = InvertedIndex(self.spark, folder, self.weights, self.buckets, self.block, self.probe)
        rows = self._alive(self._postings(), *LISTS).filter("size(docs) > 0")
        # Dealt by range before they are put together, so that rows are shuffled once.
        rows = rows.repartitionByRange("bucket", "term", "block").groupBy("bucket", "term", "block").agg(
            F.sort_array(F.flatten(F.collect_list("docs"))).alias("docs"), F.max("most").alias("most"), F.min("least").alias("least")
        )
        lists = [F.col(f"docs.{c}").alias(c) for c in LISTS]
        new._write(rows.select("bucket", "term", "block", *lists, "most", "least").sortWithinPartitions("bucket", "term", "block"), "postings", 0, ["bucket"])
        new._write(self.live().drop("seg"), "forward", 0)
        new._write(self.spark.createDataFrame([], "of int, id long"), "dead", 0)
        new._write(self.table("df").groupBy("bucket", "term").agg(F.sum("n").alias("n")).filter("n <> 0").repartition("bucket"), "df", 0, ["bucket"])
        new._write(self.table("stats").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")), "stats", 0)
        return new

    # ---- searching

    def _alive(self, rows: DataFrame, *lists: str) -> DataFrame:
        """rows of postings with docs as structs of lists, of the living documents alone."""
        dead = self._bits(self.table("dead").select(F.col("of").alias("seg"), "id"), "dead")
        living = F.filter(F.arrays_zip(*lists), lambda x: ~self._among("dead", x["docs"], F.col("seg")))
        return rows.join(dead, "block", "left").withColumn("docs", living).drop("dead", *[c for c in lists if c != "docs"])

    def _id(self, place: str) -> Column:
        return F.col("block") * self.block + F.col(place)

    def _postings(self, words: list[str] | None = None, name: str = "postings") -> DataFrame:
        """Rows of the words' buckets."""
        rows = self.table(name)
        if words is None:
            return rows
        mine = self.spark.createDataFrame([(w,) for w in words], "term string").withColumn("bucket", self._bucket())
        wanted = sorted(r.bucket for r in mine.select("bucket").distinct().collect())
        # The words of a query set are few; both the folders and the row groups are chosen by them.
        return rows.filter(F.col("bucket").isin(wanted) & F.col("term").isin(words))

    def _phrases(self, phrases: list[str]) -> DataFrame:
        """term (a phrase), block, id, tf and size of the documents in which a phrase's words follow each other."""
        parts = self.spark.createDataFrame([(p, i, w) for p in phrases for i, w in enumerate(p.split(" "))], "phrase string, i int, term string")
        found = self._postings(sorted({w for p in phrases for w in p.split(" ")})).join(F.broadcast(parts), "term")
        rows = self._alive(found.select("phrase", "i", "seg", "block", "docs", "sizes", "ats"), "docs", "sizes", "ats")
        rows = rows.select("phrase", "i", "seg", "block", F.explode("docs").alias("d")).select("phrase", "i", "seg", "block", self._id("d.docs").alias("id"), F.col("d.sizes").alias("size"), F.col("d.ats").alias("at"))
        runs = rows.groupBy("phrase", "seg", "block", "id").agg(F.first("size").alias("size"), F.collect_list(F.struct("i", F.transform("at", lambda x: x - F.col("i")).alias("at"))).alias("all"))
        starts = F.aggregate(F.slice("all", 2, 1 << 20), F.get("all", 0)["at"], lambda acc, x: F.array_intersect(acc, x["at"]))
        runs = runs.filter(F.size("all") == F.size(F.split("phrase", " "))).withColumn("tf", self._weighed(starts))
        return runs.filter("tf > 0").select(F.col("phrase").alias("term"), "block", "id", "tf", "size")

    def search(self, terms: DataFrame, k: int, visible: DataFrame | None = None) -> DataFrame:
        """query_id, id, score and rank of the k best of each query of terms(query_id, term), of visible(id) if given."""
        return top(self._scored(terms, k, visible)[0], k)

    def _scored(self, terms: DataFrame, k: int, visible: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Scores of documents, the k best of each query among them, and the blocks that were scored for each query."""
        wanted = cut(split_terms(terms))
        distinct = wanted.select("term", "_n").distinct().collect()  # of a query set
        words, phrases = sorted(r.term for r in distinct if r._n == 1), sorted(r.term for r in distinct if r._n > 1)
        about = self.table("stats").agg(F.sum("docs").alias("n_docs"), F.try_divide(F.sum("words"), F.sum("docs")).alias("mean_size")).first()
        blocks = self._postings(words)
        frequency = self._postings(words, "df").groupBy("term").agg(F.sum("n").alias("df"))
        bounds = blocks.groupBy("term", "block").agg(F.max("most").alias("tf"), F.min("least").alias("size"))
        runs = None
        if phrases:
            runs = cut(self._phrases(phrases))
            frequency = frequency.union(runs.groupBy("term").agg(F.count("*").alias("df")))
            bounds = bounds.union(runs.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("size").alias("size")))
        asked = wanted.groupBy("term").agg(F.collect_set("query_id").alias("queries"))
        frequency = F.broadcast(frequency.join(asked, "term"))  # a row for each term of the query set
        part = bm25_part(F.lit(about.n_docs), F.col("df"), F.col("tf"), F.col("size"), F.lit(about.mean_size))
        ranked = bounds.groupBy("term", "block").agg(F.max("tf").alias("tf"), F.min("size").alias("size")).join(frequency, "term")
        ranked = ranked.select("block", F.explode("queries").alias("query_id"), part.alias("part")).groupBy("query_id", "block").agg(F.sum("part").alias("score"))
        ranked = cut(ranked.withColumnRenamed("block", "id"))
        first = cut(top(ranked, self.probe).select("query_id", F.col("id").alias("block")))
        parts = -(-ranked.select("id").distinct().count() // BLOCKS_A_TASK) or 1
        rows = blocks.select("term", "block", "seg", "docs", "tfs", "sizes")
        if runs is not None:
            # Phrases are alive: their segment is none.
            own = runs.groupBy("term", "block").agg(F.collect_list(F.struct((F.col("id") - F.col("block") * self.block).cast("int").alias("docs"), F.col("tf").alias("tfs"), F.col("size").alias("sizes"))).alias("d"))
            rows = rows.unionByName(own.select("term", "block", F.lit(-1).alias("seg"), "d.docs", "d.tfs", "d.sizes"))
        rows = rows.join(frequency, "term")
        shown = None if visible is None else self._bits(visible.select("id"), "shown")

        def scored(chosen: DataFrame, few: bool) -> DataFrame:
            """Postings are dealt by block, which holds all that a score is made of; no row for a query and document is."""
            mine = chosen.groupBy("block").agg(F.collect_set("query_id").alias("chosen"))
            mine = mine if shown is None else mine.join(shown, "block")
            dealt = rows.join(F.broadcast(mine.select("block")), "block", "left_semi") if few else rows
            of = dealt.repartition(parts, "block").join(F.broadcast(mine) if few else mine, "block")
            of = of.withColumn("queries", F.array_intersect("queries", "chosen")).filter("size(queries) > 0")
            if shown is not None:
                of = of.withColumn("_all", F.arrays_zip("docs", "tfs", "sizes")).withColumn("_all", F.filter("_all", lambda x: self._among("shown", x["docs"])))
                of = of.select("term", "block", "seg", "df", "queries", *[F.col(f"_all.{c}").alias(c) for c in ("docs", "tfs", "sizes")])
            of = self._alive(of, "docs", "tfs", "sizes").select("block", "df", "queries", F.explode("docs").alias("d"))
            of = of.select("block", F.explode("queries").alias("query_id"), self._id("d.docs").alias("id"), part_of("d").alias("part"))
            return of.groupBy("block", "query_id", "id").agg(F.round(F.sum("part"), 6).alias("score")).drop("block")

        def part_of(d: str) -> Column:
            return bm25_part(F.lit(about.n_docs), F.col("df"), F.col(f"{d}.tfs"), F.col(f"{d}.sizes"), F.lit(about.mean_size))

        best = cut(scored(first, True))
        least = top(best, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        rest = ranked.withColumnRenamed("id", "block").join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
        # Scores are rounded to six places, so a bound may fall short of one by that.
        rest = rest.filter(F.col("least").isNull() | (F.col("score") + 1e-6 >= F.col("least"))).select("query_id", "block")
        return best.unionByName(scored(rest, False)), first.union(rest)

    def share_scored(self, terms: DataFrame, k: int) -> float:
        """Share of the blocks of the queries' terms that a search scores."""
        every = self._postings(sorted(r.term for r in split_terms(terms).filter("_n = 1").select("term").distinct().collect())).select("term", "block").distinct()
        pairs = every.join(split_terms(terms), "term").select("query_id", "block").distinct()
        return self._scored(terms, k, None)[1].join(pairs, ["query_id", "block"]).count() / max(pairs.count(), 1)
