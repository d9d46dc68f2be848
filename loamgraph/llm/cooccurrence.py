"""Problem 4: items that appear together, kept in a pair table that takes changes."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgraph.plans.shared import children, materialize, new_folder, remove

BASKETS = "path string, chunk_index int, item string, bucket int"
PAIRS = "item_a string, item_b string, n bigint, bucket int"
MARGINALS = "item string, n bigint, bucket int"
SCORES = "item_a string, item_b string, n bigint, n_a bigint, n_b bigint"
KEYS = {"baskets": ["path", "chunk_index"], "pairs": ["item_a", "item_b"], "marginals": ["item"]}
SCHEMAS = {"baskets": BASKETS, "pairs": PAIRS, "marginals": MARGINALS}
#: Rows a bucket is made for; a table that outgrows its buckets fourfold is given new ones.
BUCKET_ROWS = 500_000
#: Pairs together in at least so many baskets keep a score; the many rarer ones are scored when they are asked for.
SCORED_FROM = 5
#: So many batches of scores may lie beside each other before they are put together.
SCORE_BATCHES = 8
#: Baskets with more items than this are split over several tasks.
SPLIT_AT = 64


def signed_pairs(rows: DataFrame, split_at: int = SPLIT_AT) -> DataFrame:
    """(item_a, item_b, n): the sum of ``sign`` over the baskets holding both, item_a < item_b, zeros left out.

    ``rows`` is (path, chunk_index, item, sign) without repeats. Sums are taken before the shuffle by pair. Baskets of
    up to ``split_at`` items are brought together by one shuffle and paired where they lie. Larger ones are cut into
    slices by item on the left and repeated once a slice on the right, so the pairs of one large basket are made by as
    many tasks as it has slices.
    """
    keys = ["path", "chunk_index", "sign"]
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > split_at)
    sized = rows.join(sizes, keys, "left")
    small = sized.where("size IS NULL").groupBy(*keys).agg(F.array_sort(F.collect_list("item")).alias("items"))
    after = lambda x, i: F.transform(F.slice("items", i + 2, F.lit(split_at)), lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))
    pairs = small.where("size(items) > 1").select("sign", F.explode(F.flatten(F.transform("items", after))).alias("x")).select("x.*", "sign")
    slices = F.ceil(F.col("size") / split_at).cast("int")
    large = sized.where("size IS NOT NULL")
    left = large.select(*keys, F.col("item").alias("item_a"), F.pmod(F.hash("item"), slices).alias("slice"))
    right = large.select(*keys, F.col("item").alias("item_b"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    every = pairs.unionByName(left.join(right, [*keys, "slice"]).where("item_a < item_b").select("item_a", "item_b", "sign"))
    return every.groupBy("item_a", "item_b").agg(F.sum("sign").cast("bigint").alias("n")).where("n <> 0")


class PairTable:
    """Counts of pairs, of items and of baskets, in hash buckets under ``root``, brought up to date by changes.

    ``apply`` takes the new content of the changed baskets only. Their old content is read back, the difference is
    emitted as signed pair and item counts, and just the buckets that receive a count are rewritten, each into the
    folder of the new version; the others stay where an older version wrote them. The number of buckets, and with it
    of the tasks that write, follows from the rows of a table (``BUCKET_ROWS``) and grows with it. Of the pairs in
    ``scored_from`` baskets and more, those whose count, or the count of an item of which, has changed are scored anew
    (``scores``); the others keep their score. A table must be opened with the ``scored_from`` it was made with. The version is
    valid once its list of folders (one row a bucket) is written, so a job that dies leaves the old version standing;
    what neither the new nor the last version needs is then deleted.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, bucket_rows: int = BUCKET_ROWS, score_batches: int = SCORE_BATCHES, scored_from: int = SCORED_FROM):
        self.spark, self.root, self.bucket_rows, self.score_batches = spark, root or new_folder(spark, "pairs"), bucket_rows, score_batches
        done = [v for v in children(spark, self.root) if v.startswith("list-") and "_SUCCESS" in children(spark, f"{self.root}/{v}")]
        self.scored_from = scored_from
        self.version = int(done[-1][5:]) if done else 0
        self.folders: dict[str, dict[int, int]] = {"baskets": {}, "pairs": {}, "marginals": {}}
        self.buckets, self.rows = dict.fromkeys(KEYS, 0), dict.fromkeys(KEYS, 0)
        self.scores: list[int] = []
        self.total = 0
        if done:
            for table, bucket, version, total in spark.read.parquet(f"{self.root}/{done[-1]}").collect():  # one row a bucket
                if table == "total":
                    self.total = total
                elif table == "scores":
                    self.scores.append(version)
                elif bucket is None:
                    self.buckets[table], self.rows[table] = version, total
                else:
                    self.folders[table][bucket] = version
            self.scores.sort()

    def _read(self, table: str, only: set[int] | None = None) -> DataFrame:
        by_version: dict[int, list[int]] = {}
        for bucket, version in self.folders[table].items():
            if only is None or bucket in only:
                by_version.setdefault(version, []).append(bucket)
        read = lambda version: self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.root}/{table}/v={version:06d}")
        parts = [read(version).where(F.col("bucket").isin(which)) for version, which in sorted(by_version.items())]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], SCHEMAS[table])

    def pairs(self) -> DataFrame:
        return self._read("pairs").drop("bucket")

    def marginals(self) -> DataFrame:
        return self._read("marginals").drop("bucket")

    def _bucket(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS[table]), F.lit(self.buckets[table])).cast("int"))

    def _make_room(self, table: str, more: int) -> bool:
        """Choose the buckets of a table that gets up to ``more`` rows; true if those it has must be left."""
        self.rows[table] += more
        wanted = max(self.spark.sparkContext.defaultParallelism, -(-self.rows[table] // self.bucket_rows))
        if self.buckets[table] and self.rows[table] <= 4 * self.bucket_rows * self.buckets[table]:
            return False
        had, self.buckets[table] = self.buckets[table], wanted
        return bool(had) and had != wanted

    def _write(self, rows: DataFrame, where: str, buckets: int) -> set[int]:
        rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(where)
        return {int(name[7:]) for name in children(self.spark, where) if name.startswith("bucket=")}

    def _store(self, table: str, rows: DataFrame, touched: set[int], version: int) -> None:
        there = self._write(rows, f"{self.root}/{table}/v={version:06d}", self.buckets[table])
        self.folders[table] = {b: v for b, v in self.folders[table].items() if b not in touched} | dict.fromkeys(there, version)

    def _fill(self, table: str, counts: DataFrame, like: int, version: int) -> None:
        """Write the counts of a first batch, into buckets for ``like`` rows; a later batch makes others if these are too few."""
        self._make_room(table, like)
        self._store(table, self._bucket(table, counts.select(*KEYS[table], "n")), set(), version)
        self.rows[table] = self._read(table).count()

    def _merge(self, table: str, delta: DataFrame, version: int) -> None:
        """Add signed counts (key, n) to the buckets they fall into."""
        old, left = self._read(table), self._make_room(table, delta.count())
        tagged = self._bucket(table, delta.select(*KEYS[table], "n"))
        if left:
            touched = set(self.folders[table])
            old = self._bucket(table, old.drop("bucket"))
        else:
            touched = {b for (b,) in tagged.select("bucket").distinct().collect()} & set(self.folders[table])  # one row a bucket
            old = self._read(table, touched)
        merged = tagged if not touched else tagged.unionByName(old).groupBy("bucket", *KEYS[table]).agg(F.sum("n").alias("n")).where("n <> 0")
        self._store(table, merged, touched, version)

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """Pairs (item_a, item_b, n) with the counts of their items; these are joined by hash, as their number grows with the data."""
        of = lambda side: self.marginals().select(F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"))
        return pairs.join(of("a"), "item_a", "left").join(of("b"), "item_b", "left").select("item_a", "item_b", "n", "n_a", "n_b")

    def _score(self, pairs: DataFrame, items: DataFrame, version: int) -> None:
        """Write the scores of the changed ``pairs`` and of all pairs of the changed ``items``."""
        stored = self.pairs().where(F.col("n") >= self.scored_from)
        if self.scores:
            one = lambda c: stored.join(items.select(F.col("item").alias(c)), c, "left_semi")
            # a pair that is gone, or too rare by now, has a 0
            changed = pairs.select("item_a", "item_b").join(stored, ["item_a", "item_b"], "left").select("item_a", "item_b", F.coalesce("n", F.lit(0)).alias("n"))
            known = self._scores().select("item_a", "item_b")
            changed = changed.where("n > 0").unionByName(changed.where("n = 0").join(known, ["item_a", "item_b"], "left_semi"))
            stored = one("item_a").unionByName(one("item_b")).unionByName(changed).distinct()
        self._scored(stored).write.mode("overwrite").parquet(f"{self.root}/scores/v={version:06d}")
        self.scores = [*self.scores, version]
        if len(self.scores) > self.score_batches:
            self._scores().write.mode("overwrite").parquet(f"{self.root}/scores/{self._batch(-version)}")
            self.scores = [-version]

    def _scores(self) -> DataFrame:
        """The newest score of each pair."""
        # batches put together have a negative number and come before all others
        parts = [self.spark.read.schema(SCORES).parquet(f"{self.root}/scores/{self._batch(v)}").withColumn("at", F.lit(i)) for i, v in enumerate(sorted(self.scores))]
        if not parts:
            return self.spark.createDataFrame([], SCORES)
        if len(parts) == 1:
            return parts[0].drop("at").where("n > 0")
        every = functools.reduce(DataFrame.unionByName, parts)
        newest = every.groupBy("item_a", "item_b").agg(F.max_by(F.struct("n", "n_a", "n_b"), "at").alias("x"))
        return newest.select("item_a", "item_b", "x.*").where("n > 0")

    def apply(self, baskets: DataFrame) -> PairTable:
        """Take ``baskets`` (path, chunk_index, item) as the new content of the baskets named in it.

        A basket whose only item is null is emptied. Null items and repeated rows do not count; a null in path or
        chunk_index leaves the row out.
        """
        version, in_use = self.version + 1, self._in_use()
        given = baskets.select("path", "chunk_index", "item").where("path IS NOT NULL AND chunk_index IS NOT NULL").distinct()
        given = materialize(given, "given", f"{self.root}/given/v={version:06d}")
        size = given.count()
        if not size:
            return self
        old, left = self._read("baskets"), self._make_room("baskets", size)
        given = self._bucket("baskets", given)
        new = given.where("item IS NOT NULL")
        rows, kept, touched = new.select("path", "chunk_index", "item", F.lit(1).alias("sign")), None, set()
        if self.folders["baskets"]:
            if left:
                touched = set(self.folders["baskets"])
                old = self._bucket("baskets", old.drop("bucket"))
            else:
                touched = {b for (b,) in given.select("bucket").distinct().collect()}  # one row a bucket
                old = self._read("baskets", touched)
            named, keys = given.select("path", "chunk_index").distinct(), ["path", "chunk_index"]
            was = old.join(named, keys, "left_semi").select("path", "chunk_index", "item", F.lit(-1).alias("sign"))
            kept = old.join(named, keys, "left_anti")
            rows = rows.unionByName(was)
        pairs, items = signed_pairs(rows), rows.groupBy("item").agg(F.sum("sign").cast("bigint").alias("n")).where("n <> 0")
        self.total += rows.select("path", "chunk_index", "sign").distinct().agg(F.coalesce(F.sum("sign"), F.lit(0))).first()[0]
        if kept is None:
            self._store("baskets", new, touched, version)
            self._fill("pairs", pairs, size, version)
            self._fill("marginals", items, size, version)
        else:
            delta = f"{self.root}/delta/v={version:06d}"
            pairs, items = materialize(pairs, "pairs", f"{delta}/pairs"), materialize(items, "items", f"{delta}/items")
            self._store("baskets", kept.select(new.columns).unionByName(new), touched, version)
            self._merge("pairs", pairs, version)
            self._merge("marginals", items, version)
        self._score(pairs, items, version)
        listed = [(t, b, v, None) for t, which in self.folders.items() for b, v in which.items()]
        listed += [("total", None, None, int(self.total)), *(("scores", None, v, None) for v in self.scores), *((t, None, self.buckets[t], self.rows[t]) for t in KEYS)]
        self.spark.createDataFrame(listed, T.StructType.fromDDL("name string, bucket int, version int, total bigint")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/list-{version:06d}")
        self._sweep(in_use | self._in_use(), version)
        self.version = version
        return self

    def _in_use(self) -> set[str]:
        return {f"{t}/v={v:06d}" for t, which in self.folders.items() for v in which.values()} | {f"scores/{self._batch(v)}" for v in self.scores}

    @staticmethod
    def _batch(version: int) -> str:
        """The folder of a batch of scores; a negative number is that of batches put together."""
        return f"v={abs(version):06d}{'-whole' if version < 0 else ''}"

    def _sweep(self, needed: set[str], version: int) -> None:
        """Delete what no version in use needs."""
        for table in (*KEYS, "scores"):
            for name in children(self.spark, f"{self.root}/{table}"):
                if f"{table}/{name}" not in needed:
                    remove(self.spark, f"{self.root}/{table}/{name}")
        for folder in ("given", "delta"):
            remove(self.spark, f"{self.root}/{folder}/v={version:06d}")
        for name in children(self.spark, self.root):
            if name.startswith("list-") and int(name[5:]) < version - 1:
                remove(self.spark, f"{self.root}/{name}")

    def associations(self, *, min_together: int = 1, min_lift: float = 0.0) -> DataFrame:
        """(item_a, item_b, n, n_a, n_b, total, lift) of the pairs with n >= min_together and lift >= min_lift.

        lift = n * total / (n_a * n_b): how many times as often as by chance. The stored score is n / (n_a * n_b) by its
        parts, which a batch changes for the pairs it touches only; the total, which each batch changes, is one number
        and comes in here. With ``min_together`` under ``scored_from`` the counts are joined now.
        """
        scored = self._scores() if min_together >= self.scored_from else self._scored(self.pairs())
        scored = scored.where(F.col("n") >= min_together)
        scored = scored.withColumn("total", F.lit(self.total).cast("bigint")).withColumn("lift", F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b")))
        return scored.where(F.col("n").cast("double") * F.col("total") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b")).select("item_a", "item_b", "n", "n_a", "n_b", "total", "lift")


def sighting_baskets(current: DataFrame) -> DataFrame:
    """The entities of each record, as baskets."""
    return current.select("path", "chunk_index", F.col("entity_id").alias("item")).distinct()
