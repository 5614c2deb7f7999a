"""Exact deduplication with a log-structured merge index of text digests.

Memtables. Every task of a flush is one: it holds the (digest, id) rows of its
split, which spark.sql.files.maxPartitionBytes bounds, and writes them as one
run sorted by digest.

Compaction. Runs of a level go, `fan_in` at a time, into one run of the next
level each, all of a level in one job; there a digest has one row, with the
identifier that stays and the number of rows. What doesn't fill a merge stays
where it is, so a digest can be in several runs.

Filters. Each live run has a filter of its digests, a set of bitmaps. An entry
that no other run's filter lets pass is final as it stands; only the others
are merged by a shuffle. A lookup of other digests reads only runs whose
filter lets one of them pass.

Verification. Hits, digests with more than one row, are compared byte for
byte: within a digest the smallest and the largest text must be the same,
which Spark combines within each task first, so that a group of any size sends
one text a task. Digests with more than one text are resolved by the text
itself.

Everything is DataFrame operations; no text is shuffled unless its digest
passes a filter of the digests that occur more than once.

Defined results. Null text counts as empty. Rows with a null id take part; a
null id stays only if its whole group has null ids. Rows that are equal in id
and text are kept or dropped together, as they can't be told apart; rows of
one id with different texts are decided on one by one. An empty table gives an
empty result. Input columns other than the two named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP_BITS, MAX_BITMAPS, bit_of, bitmap_count, documents, has_bit, maybe_in, remove, scratch, without_rows

FAN_IN = 16
#: Numbers of a level's runs are below this.
LEVEL = 1 << 40


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class MergeIndex:
    """Levels of sorted digest runs below `path`.

    Level 0 has a row for each input row, the others one for each digest of a
    run. Runs of a level are numbered; a folder has the rows of some of them:
    run, digest, id, keep_id, n.
    """

    def __init__(self, spark: SparkSession, path: str, keep: str = "smallest", fan_in: int = FAN_IN):
        if keep not in ("smallest", "largest"):
            raise ValueError(f"keep must be smallest or largest, not {keep!r}")
        if fan_in < 2:
            raise ValueError("fan_in must be 2 or more")
        self.spark, self.path, self.fan_in = spark, path, fan_in
        self.pick = F.min if keep == "smallest" else F.max
        self.flushed: list[str] = []
        #: For each level: folder, first live run, end of its runs.
        self.levels: list[list[tuple[str, int, int]]] = []
        self.next: list[int] = []
        #: What happened so far: runs merged into others; entries that the last totals() merged, and that filters kept out of that.
        self.merged_runs = self.merged_entries = self.unmerged_entries = 0

    def _write(self, rows: DataFrame, level: int, runs: int | None) -> str:
        """Add a folder of runs to a level, whose numbers in rows begin at 0. runs: how many, if that is known."""
        while len(self.levels) <= level:
            self.levels.append([])
            self.next.append(0)
        first = self.next[level]
        folder = f"{self.path}/level={level}/first={first}-{len(self.flushed)}"
        rows.withColumn("run", F.col("run") + first).sortWithinPartitions("digest").write.parquet(folder)
        if runs is None:
            last = self.spark.read.parquet(folder).agg(F.max("run")).first()[0]
            runs = 0 if last is None else last + 1 - first
        if runs:
            self.levels[level].append((folder, first, first + runs))
            self.next[level] += runs
        return folder

    def flush(self, rows: DataFrame) -> None:
        """rows: digest, id. Every task's rows are a memtable and become a run."""
        memtable = rows.select(F.spark_partition_id().cast("long").alias("run"), "digest", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        self.flushed.append(self._write(memtable, 0, None))
        level = 0
        while level < len(self.levels):
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        """Merge the runs of one level, fan_in at a time, into runs of the next. Level 0 keeps its files: they hold the ids."""
        own = self.levels[level]
        if not own:
            return
        first = own[0][1]
        merges = (own[-1][2] - first) // self.fan_in
        if not merges:
            return
        end = first + merges * self.fan_in
        rows = self.spark.read.parquet(*[f for f, _, _ in own]).filter(F.col("run").between(first, end - 1))
        merge = F.floor((F.col("run") - first) / self.fan_in).cast("long").alias("run")
        merged = rows.groupBy(merge, "digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        self._write(merged.select("run", "digest", F.lit(None).cast("long").alias("id"), "keep_id", "n"), level + 1, merges)
        self.merged_runs += end - first
        self.levels[level] = [(f, max(lo, end), hi) for f, lo, hi in own if hi > end]
        for f, _, hi in own if level else ():
            if hi <= end:
                remove(self.spark, f)

    def live(self) -> list[int]:
        """Numbers of the live runs, unlike on each level."""
        return [level * LEVEL + r for level, own in enumerate(self.levels) for _, lo, hi in own for r in range(lo, hi)]

    def entries(self, runs: list[int] | None = None) -> DataFrame:
        """Rows of the live runs, or of some of them: run (as live() has it), digest, keep_id, n. Folders without such runs aren't read."""
        out = self.spark.range(0).selectExpr("id AS run", "cast(id AS string) AS digest", "id AS keep_id", "id AS n")
        for level, own in enumerate(self.levels):
            for folder, lo, hi in own:
                some = None if runs is None else [r - level * LEVEL for r in runs if lo <= r - level * LEVEL < hi]
                if some is None or some:
                    rows = self.spark.read.parquet(folder).filter(F.col("run") >= lo if some is None else F.col("run").isin(some))
                    out = out.unionByName(rows.select((F.col("run") + level * LEVEL).alias("run"), "digest", "keep_id", "n"))
        return out

    def filters(self) -> tuple[DataFrame, int]:
        """Bitmaps of the live runs' digests (bucket, sets: run and bits), and how many a run has; all together are bounded."""
        runs = max(1, len(self.live()))
        n = self.entries().count()
        buckets = bitmap_count(-(-n // runs), max(1, MAX_BITMAPS // runs))
        bucket, bit = bit_of(F.col("digest"), buckets)
        maps = self.entries().select("run", bucket.alias("__bucket"), bit.cast("long").alias("__bit")).groupBy("run", "__bucket").agg(F.expr("bitmap_construct_agg(__bit)").alias("bits"))
        return maps.groupBy("__bucket").agg(F.collect_list(F.struct("run", "bits")).alias("__sets")).checkpoint(), buckets

    def _others(self, rows: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
        """rows with `__runs`: live runs whose filter lets the digest pass."""
        bucket, bit = bit_of(F.col("digest"), buckets)
        joined = rows.withColumn("__bucket", bucket).withColumn("__bit", bit).join(F.broadcast(filters), "__bucket", "left")
        passing = F.transform(F.filter("__sets", lambda s: has_bit(s["bits"], F.col("__bit"))), lambda s: s["run"])
        return joined.withColumn("__runs", F.coalesce(passing, F.array().cast("array<bigint>"))).drop("__bucket", "__bit", "__sets")

    def totals(self) -> DataFrame:
        """All digests: digest, keep_id, n. Entries that no other run's filter lets pass aren't merged."""
        live = self.live()
        if len(live) == 1 and live[0] >= LEVEL:
            return self.entries().select("digest", "keep_id", "n")
        filters, buckets = self.filters()
        # a memtable's run can have a digest more than once
        merge = (F.size("__runs") > 1) | (F.col("run") < LEVEL)
        probed = self._others(self.entries(), filters, buckets).select("digest", "keep_id", "n", merge.alias("__merge")).checkpoint()
        self.merged_entries, self.unmerged_entries = probed.agg(F.count_if("__merge"), F.count_if(~F.col("__merge"))).first()
        merged = probed.filter("__merge").groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return probed.filter("NOT __merge").select("digest", "keep_id", "n").unionByName(merged)

    def lookup(self, digests: DataFrame) -> tuple[DataFrame, list[int]]:
        """What the index has of some digests (digest, keep_id, n), and the runs that were read for it; the others' filters let nothing pass."""
        asked = digests.select("digest").distinct().checkpoint()
        filters, buckets = self.filters()
        runs = sorted(r["run"] for r in self._others(asked, filters, buckets).select(F.explode("__runs").alias("run")).distinct().collect())
        found = self.entries(runs).join(asked, "digest", "left_semi").groupBy("digest").agg(self.pick("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        return found, runs

    def rows(self) -> DataFrame:
        """All rows flushed so far: digest, id."""
        return self.spark.read.parquet(*self.flushed).select("digest", "id")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=sha256, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: id_col, keep_id, group_size, kept, digest.

    digest: a function from the text column to its digest; a weak one costs time, not correctness.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", digest(F.col("text")))
    index = MergeIndex(spark, scratch(spark, "lsm"), keep, fan_in)
    index.flush(texts.select("digest", "id"))
    resolved = index.totals().filter("n > 1").checkpoint()
    n = resolved.count()
    if not n:
        return _result(index.rows().withColumns({"keep_id": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}), id_col)
    seen = maybe_in(texts, "digest", resolved, n).filter("__maybe").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")
    mixed = seen.join(resolved, "digest", "left_semi").checkpoint()
    rows = index.rows()
    if mixed.isEmpty():
        return _result(_with_totals(rows, resolved, n), id_col)
    own = texts.join(mixed, "digest", "left_semi")
    groups = own.groupBy("digest", "text").agg(index.pick("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    plain = _with_totals(rows.join(mixed, "digest", "left_anti"), resolved, n)
    return _result(plain, id_col).unionByName(_result(own.join(groups, ["digest", "text"]), id_col))


def _with_totals(rows: DataFrame, resolved: DataFrame, n: int) -> DataFrame:
    """rows (digest, id) with keep_id and n of their digest; only rows that a filter lets pass are joined."""
    probed = maybe_in(rows, "digest", resolved, n)
    alone = probed.filter("NOT __maybe").select("digest", "id", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
    return alone.unionByName(probed.filter("__maybe").drop("__maybe").join(resolved, "digest", "left").select("digest", "id", "keep_id", "n"))


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return rows.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("id")).alias("kept"), "digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), keep="largest").withColumnRenamed("digest", "text_sha256")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest doc_id stays.

    Rows are decided on one by one: a row of a repeated id goes or stays by its
    own text. A row without an id goes if another row with its text has one.
    """
    gone = exact_dedup(docs, keep="largest").filter("NOT kept").select("doc_id", F.unhex("digest").alias("digest"))
    return without_rows(docs, gone, {"doc_id": F.col("doc_id").cast("long"), "digest": F.unhex(sha256(F.col("text").cast("string")))})
