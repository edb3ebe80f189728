"""Operator 9 [native]: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every document has a size in words. Sources, by code point and null last, weigh 5, 2, 1 in turn and share
``budget`` times all words; a source stops at ``most`` times its own size, and what is over is shared anew by
weight (water filling in closed form, by windows over the table of sources).

The documents of a source are dealt by hash into blocks (``block_count``). A source whose target holds f whole passes
has every block f times in its quota, and then blocks in a permuted order until the target is met.

The splitting tree recursively halves the quotas, counts of blocks by source, among ``shards`` output shards. The left
child of a node takes half of its blocks; how many of each source is a multivariate hypergeometric draw, made one
source after another as univariate draws by inverse distribution from a hash (``_draw``). So that no row holds all
sources, a tree over about sqrt(sources) groups of sources is split first, and within each group the same tree splits
its sources to the group's counts, which together is the same law. Leaves then draw disjoint runs of each source's
permuted blocks: a block's passes are where its places in the permutation fall among the leaves' runs. What a document
is taken is what the leaves drew of its block. Rows are shuffled inside a shard by a hash.

The last drawn block of a source ends inside a block. With ``whole`` a document there is taken if its middle is within
the target, so a source misses its target by half a document at most; otherwise the one document at the target is
taken in part, so that the source takes exactly its target, rounded. Only that block's documents are put in order.

Only sums by (source, block) cross sources, so a hot source is as many groups as any other. The table of sources is
ranked in one task (three numbers a source); tables of blocks have at most ``sources * blocks`` rows.

Defined results: null text has size 0 and is taken 0 times; null source is a source of its own; a source of
size 0 has target 0; an empty table gives no rows; equal rows each count; extra columns are kept by ``mix``, clashing
names get marks in front; a null doc_id is like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.common import fresh, table
from tidewave.llm.tables import Work

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def source_targets(totals: DataFrame, budget: float = 1.5, most: int = 2) -> DataFrame:
    """(skey, source, source_size) to the same rows with ``target``, by water filling."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(filling), F.lit(0.0)))
    # a source is capped while the level that the ones before it leave would lift it over its cap
    levelled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return levelled.withColumn("final", final).select("skey", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w"))).alias("target"))


def _unit(*parts) -> F.Column:
    return F.md5(F.concat_ws("|", *parts))


def _unit_interval(*parts) -> F.Column:
    """A number from 0 to 1 from a hash."""
    return F.conv(F.substring(_unit(*parts), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _draw(total: F.Column, kind: F.Column, taken: F.Column, u: F.Column) -> F.Column:
    """How many of ``taken`` blocks out of ``total`` are of a source with ``kind`` blocks: hypergeometric, by inversion.

    Weights follow from each other by their ratio within 12 standard deviations of the mean; beyond lie 1e-31.
    """
    lo, hi = F.greatest(F.lit(0), taken + kind - total), F.least(taken, kind)
    mean = taken * kind / F.greatest(F.lit(1), total)
    wide = 12 * F.sqrt(mean * (1 - kind / F.greatest(F.lit(1), total)) * (total - taken) / F.greatest(F.lit(1), total - 1)) + 3
    a, b = F.greatest(lo, F.floor(mean - wide)).cast("long"), F.least(hi, F.ceil(mean + wide)).cast("long")
    ratio = lambda k: (kind - k) * (taken - k) / ((k + 1.0) * (total - kind - taken + k + 1.0))
    # state: the weight at hand and the sum so far; then the same again until the sum passes u of it
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    whole = F.aggregate(F.sequence(a, b), start, lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    return F.aggregate(
        F.sequence(a, b),
        F.struct(F.lit(1.0).alias("w"), (u * whole).alias("left"), b.alias("got"), F.lit(False).alias("done")),
        lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["left"] - s["w"]).alias("left"), F.when(~s["done"] & (s["left"] <= s["w"]), k).otherwise(s["got"]).alias("got"), (s["done"] | (s["left"] <= s["w"])).alias("done")),
        lambda s: s["got"],
    )


def _split(quotas: F.Column, taken: F.Column, seed: F.Column) -> F.Column:
    """Of an array of counts, the array of how many go left when ``taken`` go left in all: multivariate hypergeometric."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda x, q: x + q)
    start = F.struct(total.alias("total"), taken.cast("long").alias("taken"), F.array().cast("array<bigint>").alias("left"))

    def step(s: F.Column, at: F.Column) -> F.Column:
        q = F.element_at(quotas, at)
        drawn = F.array(_draw(s["total"], q, s["taken"], _unit_interval(seed, at.cast("string"))))
        # bound once
        return F.element_at(F.transform(drawn, lambda k: F.struct((s["total"] - q).alias("total"), (s["taken"] - k).alias("taken"), F.array_append(s["left"], k).alias("left"))), 1)

    return F.when(F.size(quotas) > 0, F.aggregate(F.sequence(F.lit(1), F.size(quotas)), start, step, lambda s: s["left"])).otherwise(F.array().cast("array<bigint>"))


def _tree(rows: DataFrame, quotas: str, totals: list[str] | None, levels: int, seed: str) -> DataFrame:
    """``rows`` with level0 ... level<levels>: for each node of the tree the array of counts by source, from ``quotas``.

    ``totals``: columns with the number that each node must hold, level by level; None halves.
    """
    sum_of = lambda q: F.aggregate(q, F.lit(0).cast("long"), lambda x, y: x + y)
    rows = rows.withColumn("level0", F.array(quotas))

    def children(level: int):
        def of(q: F.Column, node: F.Column) -> F.Column:
            half = F.floor(sum_of(q) / 2) if totals is None else F.element_at(totals[level + 1], (2 * node + 1).cast("int"))
            left = F.array(_split(q, half, F.concat_ws("|", F.lit(f"{seed}|{level}"), F.col("group").cast("string"), node.cast("string"))))
            return F.element_at(F.transform(left, lambda x: F.array(x, F.zip_with(q, x, lambda a, b: a - b))), 1)

        return of

    for level in range(levels):
        rows = rows.withColumn(f"level{level + 1}", F.flatten(F.transform(f"level{level}", children(level))))
    return rows


def leaves(quotas: DataFrame, shards: int, seed: int = 9, groups: int | None = None) -> DataFrame:
    """(skey, counts) from (skey, quota): how many of each source's blocks each of ``shards`` shards draws.

    Both trees are written: their expressions are long, and whatever reads them would analyse them again.
    """
    levels, s, work = shards.bit_length() - 1, str(seed), Work(quotas.sparkSession)
    n = groups or max(1, math.isqrt(quotas.count()))
    grouped = quotas.where("quota > 0").groupBy(F.pmod(F.xxhash64("skey"), F.lit(n)).cast("int").alias("group")).agg(F.array_sort(F.collect_list(F.struct("skey", F.col("quota").cast("long").alias("quota")))).alias("of"))
    grouped = grouped.select("group", "of", F.transform("of", lambda x: x["quota"]).alias("quotas"))
    sums = grouped.select("group", F.aggregate("quotas", F.lit(0).cast("long"), lambda x, y: x + y).alias("n"))
    # one row of at most n groups
    top = sums.agg(F.array_sort(F.collect_list(F.struct("group", "n"))).alias("of")).select(F.lit(-1).alias("group"), "of", F.transform("of", lambda x: x["n"]).alias("quotas"))
    top = _tree(top, "quotas", None, levels, s)
    given = top.select(F.posexplode("of").alias("at", "x"), *[f"level{k}" for k in range(levels + 1)])
    given = given.select(F.col("x.group").alias("group"), *[F.transform(f"level{k}", lambda q: F.element_at(q, (F.col("at") + 1).cast("int"))).alias(f"total{k}") for k in range(levels + 1)])
    given = work.saved(given)
    split = _tree(grouped.join(given, "group"), "quotas", [f"total{k}" for k in range(levels + 1)], levels, s)
    each = split.select(F.posexplode("of").alias("at", "x"), F.col(f"level{levels}").alias("nodes"))
    return work.saved(each.select(F.col("x.skey").alias("skey"), F.transform("nodes", lambda q: F.element_at(q, (F.col("at") + 1).cast("int"))).alias("counts")))


def block_count(docs: int) -> int:
    """Blocks of a source: 4,096, doubled as long as a block would hold over 65,536 documents of a table of ``docs``."""
    blocks = 4096
    while docs > blocks * 65536:
        blocks *= 2
    return blocks


def assign(docs: DataFrame, keep: list[str], budget: float = 1.5, most: int = 2, blocks: int | None = None, shards: int = 16, seed: int = 9, whole: bool = False, broadcast_rows: int = 100_000) -> DataFrame:
    """Rows of ``docs`` (columns ``keep``) with size, source_size, target, taken, passes, extra and shards.

    ``passes`` whole copies and then the first ``extra`` words are taken; ``shards`` lists the output shard of
    each pass in turn. ``shards`` (the parameter) is a power of two. Tables of blocks of up to ``broadcast_rows`` rows
    are broadcast, so that texts stay where they are; larger ones are joined by sorting, without texts that are not kept.
    """
    s, blocks = F.lit(str(seed)), blocks or block_count(docs.count())
    base = docs.select(*[F.col(c).alias(f"_{c}") for c in keep], F.col("doc_id"), F.col("source"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("skey", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))).withColumn("key", _unit(s, F.col("doc_id").cast("string"), "skey", F.md5("text")))
    base = base.withColumn("block", (F.conv(F.substring("key", 1, 7), 16, 10).cast("long") % blocks).cast("int"))
    size = F.regexp_count("text", F.lit(WORD)).cast("long")
    work = Work(docs.sparkSession)
    by_block = work.saved(base.groupBy("skey", "source", "block").agg(F.sum(size).alias("words")))
    targets = source_targets(by_block.groupBy("skey", "source").agg(F.sum("words").alias("source_size")), budget, most)
    targets = targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")).withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    permuted = Window.partitionBy("skey").orderBy(F.col("words") == 0, _unit(s, "skey", F.col("block").cast("string")), "block")
    drawn = by_block.select("skey", "block", "words").join(targets, "skey").withColumn("before", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("place", F.row_number().over(permuted))
    drawn = drawn.withColumn("extra_words", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before"))))
    # a source's quota: its blocks that hold words, passes times, and those of its last, partial pass
    drawn = work.saved(drawn)
    quotas = drawn.groupBy("skey").agg(F.sum(F.when(F.col("words") > 0, F.col("passes") + (F.col("extra_words") > 0).cast("int")).otherwise(0)).alias("quota"), F.sum((F.col("words") > 0).cast("int")).alias("full"))
    runs = leaves(quotas.select("skey", "quota"), shards, seed)
    plan = drawn.join(quotas.select("skey", "full"), "skey").join(runs, "skey", "left")
    # the leaf of a place is the first whose run reaches it
    ends = F.transform(F.sequence(F.lit(1), F.size("counts")), lambda n: F.aggregate(F.slice("counts", 1, n), F.lit(0).cast("long"), lambda x, y: x + y))
    leaf = lambda place: F.size(F.filter(F.col("ends"), lambda e: e < place))
    passes = F.when((F.col("words") > 0) & F.col("counts").isNotNull(), F.col("passes") + (F.col("extra_words") > 0).cast("int")).otherwise(0)
    plan = plan.withColumn("ends", F.coalesce(ends, F.array().cast("array<bigint>"))).withColumn("n", passes)
    plan = plan.withColumn("shards", F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1))), lambda j: leaf((j - 1) * F.col("full") + F.col("place")))).otherwise(F.array().cast("array<int>")))
    plan = work.saved(plan.select("skey", "block", "source_size", "target", "passes", "words", "extra_words", "shards"))
    cut = (F.col("extra_words") > 0) & (F.col("extra_words") < F.col("words"))
    # at most a row for each source and block, and one of each source whose last block is cut

    def met(some: DataFrame) -> DataFrame:
        """Documents of some blocks. Beside a small table texts stay where they are and words are counted behind the join,
        only where they are wanted; a large one is never broadcast, and words are counted before rows are shuffled."""
        if some.count() <= broadcast_rows:
            return base.join(F.broadcast(some), ["skey", "block"]).withColumn("size", size).drop("text")
        return base.withColumn("size", size).drop("text").join(some.hint("merge"), ["skey", "block"])

    inside = Window.partitionBy("skey", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.when(ahead + F.col("size") / 2 <= F.col("extra_words"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least("size", F.col("extra_words") - ahead))
    out = met(plan.where(~cut)).withColumn("extra", F.when(F.col("extra_words") > 0, F.col("size")).otherwise(0).cast("long")).unionByName(met(plan.where(cut)).withColumn("extra", part.cast("long")))
    # each pass that the leaves drew takes the whole document, the partial one its extra words
    out = out.withColumn("taken", F.least(F.col("passes"), F.size("shards")) * F.col("size") + F.when(F.size("shards") > F.col("passes"), F.col("extra")).otherwise(0))
    n = F.when(F.col("taken") > 0, F.when(F.col("extra") > 0, F.col("passes") + 1).otherwise(F.col("passes"))).otherwise(F.lit(0))
    return out.withColumn("shards", F.slice("shards", 1, n))


def mix(docs: DataFrame, seed: int = 9, whole: bool = True, **options) -> DataFrame:
    """The mixed corpus: one row for each time a document is taken, with ``shard`` and ``shard_order``.

    Where ``docs`` has columns of these names, the new ones get marks in front.

    All columns of ``docs`` are kept, and whole texts; ``whole=False`` cuts the one document of each source that its
    target falls into. Sort by ``shard`` and ``shard_order`` to read each shard locally shuffled.
    """
    rows = assign(docs, docs.columns, seed=seed, whole=whole, **options)
    taken = rows.select(*[c for c in rows.columns if c.startswith("_")], "key", "size", "passes", "extra", F.posexplode("shards").alias("pass", "shard"))
    if not whole:
        head = F.array_join(F.slice(F.regexp_extract_all("_text", F.lit(rf"([\x20\x09-\x0D]*{WORD})"), 1), 1, F.greatest(F.lit(1), F.col("extra")).cast("int")), "")
        taken = taken.withColumn("_text", F.when((F.col("pass") == F.col("passes")) & (F.col("extra") < F.col("size")), head).otherwise(F.col("_text")))
    return taken.select(*[F.col(f"_{c}").alias(c) for c in docs.columns], F.col("shard").alias(fresh(docs, "shard")), _unit(F.lit(str(seed)), "key", F.col("pass").cast("string")).alias(fresh(docs, "shard_order")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assign(table(spark, sf_dir, "documents"), [])
    return rows.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"), F.size("shards").cast("long").alias("draws"))


OP9_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey FROM documents),
e AS (SELECT *, md5(concat_ws('|', '9', doc_id::VARCHAR, skey, md5(text))) AS key FROM d),
f AS (SELECT *, (('0x' || substr(key, 1, 7))::BIGINT % 4096) AS block FROM e),
b AS (SELECT skey, source, block, sum(size)::BIGINT AS words FROM f GROUP BY ALL),
s AS (SELECT skey, source, sum(words)::BIGINT AS source_size FROM b GROUP BY ALL),
r AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
    FROM r WINDOW o AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, level LIMIT 1) AS final),
g AS (SELECT skey, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target FROM l, m),
h AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS passes FROM g),
i AS (SELECT *, round(target - passes * source_size)::BIGINT AS rest FROM h),
j AS (SELECT b.skey, b.block, b.words, i.source_size, i.target, i.passes, i.rest,
    coalesce(sum(words) OVER (PARTITION BY b.skey ORDER BY md5('9|' || b.skey || '|' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN i USING (skey)),
k AS (SELECT *, greatest(0, least(words, rest - before)) AS extra_words FROM j),
x AS (SELECT f.doc_id, f.size, k.source_size, k.target, k.passes,
    greatest(0, least(f.size, k.extra_words - coalesce(sum(f.size) OVER (PARTITION BY f.skey, f.block ORDER BY f.key, f.doc_id, f.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS extra
    FROM f JOIN k USING (skey, block))
SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + extra)::BIGINT AS taken,
    (CASE WHEN size = 0 THEN 0 WHEN extra > 0 THEN passes + 1 ELSE passes END)::BIGINT AS draws FROM x
"""
