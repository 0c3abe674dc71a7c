"""Items that appear together: an incremental table of pair counts in hash buckets.

State: Parquet tables below one folder, each partitioned by a hash ``bucket`` of its key.
``baskets(basket, item)``, ``marginals(item, n, tracked)``, ``pairs(item_a, item_b, n)`` without the big baskets,
``scores(item_a, item_b, n_ab, n_a, n_b)`` of all pairs that meet often enough, and ``big(basket)``. An update writes the
buckets that it touches into a new version; every other bucket stays the files of the version that wrote it last.

Update
    Changed baskets are compared with their stored content. What was added or removed gives signed
    marginal deltas; their old and new content gives signed pairs. Deltas are summed by hash before
    the shuffle and merged into the stored counts of the buckets they fall into. Scores are recomputed for the pairs
    with an item that was added or removed anywhere, and for no others; the rule is applied when they are
    read, as it depends on the number of baskets.
Pruning, exact for the rule n(a,b) >= floor
    n(a,b) <= n(a), so pairs are counted of *tracked* items only: those that have been in at least ``low`` baskets and
    in no more than ``high``, two bounds set when all baskets are loaded (the floor, and twice the most baskets
    an item of an associated pair can be in). An item that becomes tracked later has its baskets
    looked up in all buckets, and its pairs counted there. When the number of baskets has moved so far that the
    bounds no longer hold, the pairs are counted anew from the stored baskets.
    Baskets are split by size: at most ``low - 1`` baskets are *big*; a pair that occurs ``low`` times is in at least
    one other basket, so big baskets enumerate no pairs. They only add to the pairs that the others have
    produced: an item's big baskets are a list of at most ``low - 1``, and two lists are intersected. The size limit is
    thus a quantile of the sizes: it follows their distribution, not their number.

Edge cases: null baskets and empty items take no part; a repeated contribution counts once; an empty
table gives empty counts; ties need no rule, as every pair above the thresholds is returned.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.session import scratch_path

BUCKETS = 16
LEAST_LIMIT = 32
SCHEMAS = {
    "baskets": "basket long, item string",
    "marginals": "item string, n long, tracked boolean",
    "pairs": "item_a string, item_b string, n long",
    "scores": "item_a string, item_b string, n_ab long, n_a long, n_b long",
    "big": "basket long",
}
KEYS = {"baskets": ("basket",), "marginals": ("item",), "pairs": ("item_a", "item_b"), "scores": ("item_a", "item_b"), "big": ("basket",)}


@dataclass(frozen=True)
class Rule:
    """A pair counts if n(a,b) >= least, n(a,b)*share >= N and n(a,b)*N >= lift*n(a)*n(b)."""

    least: int = 5
    share: int = 2000
    lift: int = 4

    def floor(self, baskets: int) -> int:
        return max(self.least, -(-baskets // self.share), 1)


@dataclass(frozen=True)
class Facts:
    """Baskets with an item, the bounds of tracking, the size limit, and how many baskets are over it."""

    total: int = 0
    low: int = 0
    high: int = 0
    limit: int = LEAST_LIMIT
    big: int = 0


def _pairs_of(rows: DataFrame) -> DataFrame:
    """Pairs (item_a < item_b) within each basket of ``rows(basket, item, sign)``.

    The items of a basket are sorted once; baskets here are at most the size limit long.
    """
    sets = rows.groupBy("basket", "sign").agg(F.array_sort(F.collect_list("item")).alias("items")).filter(F.size("items") > 1)
    first = sets.select("sign", "items", F.posexplode("items").alias("at", "item_a"))
    rest = first.filter(F.col("at") + 1 < F.size("items"))
    return rest.select("sign", "item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))


def _size_limit(sizes: dict[int, int], floor: int) -> tuple[int, int]:
    """The smallest power of two, from ``LEAST_LIMIT``, that fewer than ``floor`` baskets exceed, and how many exceed it.

    ``sizes`` counts the baskets by the power of two that their size doesn't exceed.
    """
    above, limit = 0, LEAST_LIMIT
    for power in sorted(sizes, reverse=True):
        if 2**power <= LEAST_LIMIT:
            break
        if above + sizes[power] >= floor:
            limit = 2**power
            break
        above += sizes[power]
    return limit, above


def _bucket(name: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS[name]), F.lit(buckets)).cast("int").alias("bucket")


class PairTable:
    """Persistent pair counts; ``update`` writes what changes and returns the new state."""

    def __init__(self, spark: SparkSession, path: str | None = None, rule: Rule = Rule(), buckets: int = BUCKETS):
        self.spark, self.rule, self.buckets = spark, rule, buckets
        self.root = path or scratch_path(spark, "pair-table")
        self.version, self.facts = -1, Facts()
        self.files: dict[str, dict[int, int]] = {name: {} for name in SCHEMAS}  # the version that wrote a bucket

    def table(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """A table, or some of its buckets."""
        own = {k: v for k, v in self.files[name].items() if buckets is None or k in buckets}
        if not own:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.root}/v{v}/{name}/bucket={k}" for k, v in sorted(own.items())])

    def _write(self, name: str, rows: DataFrame, touched: set[int] | None) -> None:
        """Replace the touched buckets (all, if None) by ``rows``, which holds all rows of these buckets."""
        path, key = f"{self.root}/v{self.version}/{name}", KEYS[name][-1]
        salts = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.buckets)
        spread = rows.withColumn("bucket", _bucket(name, self.buckets)).repartition("bucket", F.pmod(F.xxhash64(F.lit(1), key), F.lit(salts)))
        spread.write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found = there.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(there)
        fresh = {int(n.split("=")[1]): self.version for s in found if (n := s.getPath().getName()).startswith("bucket=")}
        kept = {} if touched is None else {k: v for k, v in self.files[name].items() if k not in touched}
        self.files[name] = kept | fresh

    def _note(self, name: str, rows: DataFrame) -> DataFrame:
        """What an update uses more than once is written beside the tables."""
        path = f"{self.root}/v{self.version}/{name}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _touched(self, name: str, rows: DataFrame) -> set[int]:
        """The buckets that rows fall into: at most ``buckets`` numbers."""
        return {r["bucket"] for r in rows.select(_bucket(name, self.buckets)).distinct().collect()}

    def update(self, changed: DataFrame) -> PairTable:
        """Merge ``changed(basket, item)``: the whole new content of every basket it names.

        A row with a null or empty item stands for a basket that has lost all its items.
        """
        new = PairTable(self.spark, self.root, self.rule, self.buckets)
        new.version, new.files, new.facts = self.version + 1, {k: dict(v) for k, v in self.files.items()}, self.facts
        content = changed.filter(F.col("basket").isNotNull()).select(F.col("basket").cast("long").alias("basket"), F.coalesce("item", F.lit("")).alias("item")).distinct()
        if self.version < 0:
            new._write("baskets", content.filter("item <> ''"), None)
            return new._recount()
        content = new._note("changed", content)
        touched = new._touched("baskets", content)
        stored, named = self.table("baskets", touched), content.select("basket").distinct()
        old, fresh = stored.join(named, "basket", "left_semi"), content.filter("item <> ''")
        new._write("baskets", stored.join(named, "basket", "left_anti").unionByName(fresh), touched)
        sign = lambda rows, d: rows.select("basket", "item", F.lit(d).alias("d"))
        moved = sign(fresh, 1).unionByName(sign(old, -1)).groupBy("basket", "item").agg(F.sum("d").alias("d")).filter("d <> 0")
        moved = new._note("moved", moved.groupBy("item").agg(F.sum("d").alias("d")))
        sized = fresh.select("basket", F.lit(1).alias("side")).unionByName(old.select("basket", F.lit(0).alias("side"))).groupBy("basket", "side").agg(F.count("*").alias("n"))
        over = (F.col("side") == 1) & (F.col("n") > self.facts.limit)
        growth, large = sized.agg(F.sum(2 * F.col("side") - 1), F.count(F.when(over, 1))).first()
        new.facts = replace(self.facts, total=self.facts.total + (growth or 0))

        of_items = new._touched("marginals", moved)
        before = self.table("marginals", of_items)
        merged = before.unionByName(moved.select("item", F.col("d").alias("n"), F.lit(False).alias("tracked"))).groupBy("item").agg(F.sum("n").alias("n"), F.max("tracked").alias("was"))
        inside = (F.col("n") >= self.facts.low) & (F.col("n") <= self.facts.high)
        new._write("marginals", merged.filter("n > 0 or was").select("item", "n", (F.col("was") | inside).alias("tracked")), of_items)
        if large or self.facts.big:
            new._write("big", self.table("big").join(named, "basket", "left_anti").unionByName(sized.filter(over).select("basket")), None)
            new.facts = replace(new.facts, big=new.table("big").count())
        if not new._holds():
            return new._recount()

        was_tracked = self.table("marginals").filter("tracked").select("item")
        newly = new._note("newly", new.table("marginals", of_items).filter("tracked").select("item").join(before.filter("tracked").select("item"), "item", "left_anti"))
        small = lambda rows, state: rows if not state.facts.big else rows.join(state.table("big"), "basket", "left_anti")
        tracked = lambda rows: rows.join(was_tracked, "item", "left_semi")
        one = lambda rows, d: rows.select("basket", "item", F.lit(d).alias("sign"))
        signed = _pairs_of(one(tracked(small(old, self)), -1).unionByName(one(tracked(small(fresh, new)), 1)))
        if not newly.isEmpty():
            holders = new.table("baskets").join(newly, "item", "left_semi").select("basket").distinct()
            own = small(new.table("baskets").join(holders, "basket", "left_semi"), new).join(new.table("marginals").filter("tracked").select("item"), "item", "left_semi")
            mark = lambda c: newly.select(F.col("item").alias(c), F.lit(True).alias(f"new_{c}"))
            afresh = _pairs_of(one(own, 1)).join(mark("item_a"), "item_a", "left").join(mark("item_b"), "item_b", "left")
            signed = signed.unionByName(afresh.filter("new_item_a or new_item_b").select("sign", "item_a", "item_b"))
        delta = new._note("delta", signed.groupBy("item_a", "item_b").agg(F.sum("sign").alias("n")).filter("n <> 0"))
        of_pairs = new._touched("pairs", delta)
        summed = self.table("pairs", of_pairs).unionByName(delta.select("item_a", "item_b", "n")).groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))
        new._write("pairs", summed.filter("n > 0"), of_pairs)

        # a score can only have changed where an item was added or removed
        items = moved.select("item").unionByName(newly).distinct()
        every = new.table("pairs").select("item_a", "item_b").unionByName(self.table("scores").select("item_a", "item_b"))
        hit = lambda c: every.join(items.withColumnRenamed("item", c), c, "left_semi").select("item_a", "item_b")
        affected = new._note("affected", hit("item_a").unionByName(hit("item_b")).distinct())
        of_scores = new._touched("scores", affected)
        kept = self.table("scores", of_scores).join(affected, ["item_a", "item_b"], "left_anti")
        new._write("scores", kept.unionByName(new._scores(affected)), of_scores)
        return new

    def _holds(self) -> bool:
        """Whether the bounds of tracking are still exact for the number of baskets there are."""
        f = self.facts
        return f.low <= self.rule.floor(f.total) and f.total <= f.high * self.rule.lift and f.big < f.low

    def _recount(self) -> PairTable:
        """Set the bounds, and count everything from the stored baskets."""
        baskets, rule = self.table("baskets"), self.rule
        sizes = self._note("sizes", baskets.groupBy("basket").agg(F.count("*").alias("n")))
        # one row per power of two: at most some forty rows come to the driver
        by_power = {r["power"]: r["baskets"] for r in sizes.groupBy(F.ceil(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("baskets")).collect()}
        total = sum(by_power.values())
        low = rule.floor(total)
        limit, big = _size_limit(by_power, low)
        self.facts = Facts(total, low, max(1, -(-2 * total // rule.lift)), limit, big)
        self.files["big"] = {}
        if big:
            self._write("big", sizes.filter(F.col("n") > limit).select("basket"), None)
        inside = (F.col("n") >= low) & (F.col("n") <= self.facts.high)
        self._write("marginals", baskets.groupBy("item").agg(F.count("*").alias("n")).withColumn("tracked", inside), None)
        own = baskets.join(self.table("marginals").filter("tracked").select("item"), "item", "left_semi")
        own = own.join(self.table("big"), "basket", "left_anti") if self.facts.big else own
        pairs = _pairs_of(own.withColumn("sign", F.lit(1)))
        self._write("pairs", pairs.groupBy("item_a", "item_b").agg(F.sum("sign").alias("n")), None)
        self._write("scores", self._scores(None), None)
        return self

    def _scores(self, affected: DataFrame | None) -> DataFrame:
        """Scores of the affected pairs (all, if None), with what the big baskets add to them."""
        counts = self.table("pairs")
        counts = counts if affected is None else counts.join(affected, ["item_a", "item_b"], "left_semi")
        n_ab = F.col("n")
        if self.facts.big:
            big = self.table("big")
            inside = self.table("baskets", self._touched("baskets", big)).join(big, "basket", "left_semi")
            lists = inside.groupBy("item").agg(F.collect_set("basket").alias("in_big"))  # fewer than low each
            for side in ("item_a", "item_b"):
                counts = counts.join(lists.select(F.col("item").alias(side), F.col("in_big").alias(f"big_{side}")), side, "left")
            n_ab = n_ab + F.coalesce(F.size(F.array_intersect("big_item_a", "big_item_b")), F.lit(0))
        counts = counts.select("item_a", "item_b", n_ab.cast("long").alias("n_ab")).filter(F.col("n_ab") >= self.rule.least)
        m = self.table("marginals")
        for side, name in (("item_a", "n_a"), ("item_b", "n_b")):
            counts = counts.join(m.select(F.col("item").alias(side), F.col("n").alias(name)), side)
        return counts.select("item_a", "item_b", "n_ab", "n_a", "n_b")

    def scores(self) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, lift) of all pairs that meet at least ``least`` times."""
        lift = F.col("n_ab") * F.lit(self.facts.total).cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
        return self.table("scores").withColumn("lift", lift)

    def associated(self) -> DataFrame:
        """The scored pairs that satisfy the rule."""
        r, total = self.rule, F.lit(self.facts.total)
        wide = lambda c: c.cast("decimal(38,0)")  # noqa: E731 - products of counts outgrow a long
        return self.scores().filter(
            (F.col("n_ab") >= r.least) & (F.col("n_ab") * r.share >= total) & (wide(F.col("n_ab")) * wide(total) >= r.lift * wide(F.col("n_a")) * wide(F.col("n_b")))
        )
