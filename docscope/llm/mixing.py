"""Mixing sources to target weights (DataFrame and SQL functions only).

Targets: source ``i`` (in code point order, null last) weighs 1, 2, 3, 1, 2, ...;
the sources share the total size by weight, but no target exceeds
``max_repeat`` times its source's size, and the excess is reshared by weight.
The fixed point has one water level ``L``: target = min(max_repeat * S, L * w).

Order: each source's documents stand in a pseudo-random order (hash of seed and
doc_id). Their start positions are prefix sums taken in hash ranges of about
``range_rows`` documents: totals of the ranges give each range's offset, then each
range is summed by itself, so no task holds a source.

Copies: the mix reads that order from its start, again and again, until the
target is reached; a document is in the last pass if its middle is inside.

Blocks and shards: the taken sequence of source ``i`` is cut into ``K_i`` blocks of
about ``block_size`` words. A binary tree over output shards splits the quotas:
at each node the left half's share of every source is drawn from the
multivariate hypergeometric distribution (conditional hypergeometric draws, source
after source, by inversion around the mode), so quotas stay exact: they
sum to ``K_i`` over shards, and a shard's to its share of all blocks. A
source's blocks are permuted by an affine map and dealt out by quota, hence
disjoint; rows are shuffled inside a shard by hash.

The tables of sources and quotas have one row per source (and shard): a mix has
far fewer sources than documents, and a row of the quota tree holds one number
per source. ``block_size`` follows the total size (``blocks_per_shard`` blocks a
shard), so the quotas stay the same size for any input.

Edge cases: a null text has size 0; documents of size 0 are taken
``floor(target / S)`` times like the others of their source; a source whose
texts are all empty has target 0 and is not taken. Repeated rows are rows of
their own. An empty table gives an empty result. Extra columns are ignored
(``plan_mix``) or kept (``mixed_documents``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscope.llm.common import blocks_for, fresh, prepare, stash

#: A word is a maximal run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
N_SHARDS = 16
BLOCKS_PER_SHARD = 64
RANGE_ROWS = 20_000
#: Larger than any block number and prime, so the affine map is a permutation.
STEP = 2_147_483_647


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sizes``: (source, source_size), one row per source, null a source too.
    Adds ``rank`` (from 0), ``weight`` and ``target``."""
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = (sizes.withColumn("rank", F.row_number().over(by_code) - 1)
              .withColumn("weight", F.element_at(
                  F.array(*[F.lit(float(w)) for w in weights]),
                  (F.col("rank") % len(weights) + 1).cast("int"))))
    cap = F.lit(float(max_repeat)) * F.col("source_size")
    by_ratio = Window.orderBy("ratio", "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = ((F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(upto), zero))
             / (F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(upto), zero)))
    # a source is capped if its cap is below the level left by those before it;
    # the first that isn't has the level of all the rest
    leveled = (ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
               .withColumn("level", level).withColumn("nth", F.row_number().over(by_ratio))
               .withColumn("capped", F.col("ratio") <= F.col("level")))
    final = F.min(F.when(~F.col("capped"), F.struct("nth", "level"))).over(everywhere)["level"]
    return (leveled.withColumn("final", final)
            .select("source", "source_size", "rank", "weight",
                    F.when(F.col("capped"), F.col("cap"))
                    .otherwise(F.col("final") * F.col("weight")).alias("target")))


def _lgamma(x: str) -> str:
    """ln(gamma(x)) for x >= 1 in SQL: Stirling's series seven steps up."""
    down = " * ".join([f"({x})", *[f"({x} + {i})" for i in range(1, 7)]])
    z = f"({x} + 7)"
    return (f"(({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z})"
            f" - 1 / (360 * {z} * {z} * {z}) - ln({down}))")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``value`` computed once under ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric(total: str, marked: str, draws: str, u: str) -> str:
    """SQL for the number of marked among ``draws`` of ``total`` (bigint) drawn without
    replacement, by inversion at ``u`` in [0, 1) over 10 standard deviations around
    the mode (what lies beyond has less probability than a double resolves)."""
    def log_pmf(k: str) -> str:
        return "(-({}))".format(" + ".join(_lgamma(x) for x in (
            f"({k} + 1D)", f"({marked} - {k} + 1D)", f"({draws} - {k} + 1D)",
            f"({total} - {marked} - {draws} + {k} + 1D)")))

    share = f"({marked} / greatest({total}, 1L))"
    below = ("aggregate(w, named_struct('sum', 0D, 'n', 0L), (a, x) -> named_struct("
             "'sum', a.sum + x, 'n', a.n + if(a.sum + x <= aim, 1L, 0L)), a -> a.n)")
    pick = _let("aim", f"{u} * aggregate(w, 0D, (s, x) -> s + x)", f"least(r.last, r.first + {below})")
    weigh = _let("w", f"transform(sequence(r.first, r.last), k -> exp({log_pmf('k')} - r.peak))", pick)
    between = _let("r", "named_struct('first', greatest(b.low, b.mode - b.reach), "
                        f"'last', least(b.high, b.mode + b.reach), 'peak', {log_pmf('b.mode')})", weigh)
    mode = f"cast(floor(({draws} + 1D) * ({marked} + 1D) / ({total} + 2D)) as bigint)"
    centred = _let("b", "named_struct('low', e.low, 'high', e.high, 'mode', greatest(e.low, least("
                        f"e.mode, e.high)), 'reach', cast(ceil(sqrt({draws} * {share} * (1 - {share})) * 10)"
                        " as bigint) + 10)", between)
    return _let("e", f"named_struct('low', greatest(0L, {draws} - ({total} - {marked})), "
                     f"'high', least({marked}, {draws}), 'mode', {mode})", centred)


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``quotas``: (rank, blocks), one row per source. Returns (rank, ends): ``ends[s]``
    is the number of the source's blocks that go to shards 0 to ``s``."""
    item = F.struct(F.col("rank"), F.col("blocks").cast("long").alias("blocks"))
    nodes = quotas.agg(F.array_sort(F.collect_list(item)).alias("q")).select(
        F.lit(0).alias("lo"), F.lit(n_shards).alias("hi"), "q")
    depth = 0
    while (1 << depth) < n_shards:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["blocks"])
        nodes = nodes.withColumn("mid", mid).withColumn("total", total).withColumn(
            "left_size", F.floor(F.col("total") * (F.col("mid") - F.col("lo"))
                                 / (F.col("hi") - F.col("lo"))).cast("long"))

        u = f"(shiftrightunsigned(xxhash64({seed}, lo, hi, x.rank), 11) * {2.0 ** -53!r}D)"
        got = hypergeometric("acc.total", "x.blocks", "acc.draws", u)
        step = _let("g", got, "named_struct('total', acc.total - x.blocks, 'draws', acc.draws - g, "
                              "'left', concat(acc.left, array(named_struct('rank', x.rank, 'blocks', g))))")
        # written level by level: the drawn quotas are read twice below
        nodes = stash(nodes.withColumn("left", F.expr(
            "aggregate(q, named_struct('total', total, 'draws', left_size, 'left', "
            f"cast(array() as array<struct<rank:int,blocks:bigint>>)), (acc, x) -> {step}, a -> a.left)")),
            "mix-tree")
        right = F.zip_with("q", "left", lambda a, b: F.struct(
            a["rank"].alias("rank"), (a["blocks"] - b["blocks"]).alias("blocks")))
        single = F.col("hi") - F.col("lo") <= 1
        nodes = nodes.select(F.explode(F.when(single, F.array(F.struct("lo", "hi", "q"))).otherwise(F.array(
            F.struct("lo", F.col("mid").alias("hi"), F.col("left").alias("q")),
            F.struct(F.col("mid").alias("lo"), "hi", right.alias("q"))))).alias("n")).select("n.*")
        depth += 1
    each = nodes.select(F.col("lo").alias("shard"), F.explode("q").alias("x")).select(
        "shard", "x.rank", "x.blocks")
    running = F.sum("blocks").over(Window.partitionBy("rank").orderBy("shard"))
    return (each.withColumn("end", running).groupBy("rank")
            .agg(F.array_sort(F.collect_list(F.struct("shard", "end"))).alias("e"))
            .select("rank", F.transform("e", lambda x: x["end"]).alias("ends")))


def plan_mix(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 7, weights=WEIGHTS,
             max_repeat: float = MAX_REPEAT, blocks_per_shard: int = BLOCKS_PER_SHARD,
             range_rows: int = RANGE_ROWS, content: list[str] | None = None) -> DataFrame:
    """Plan of the mix over ``docs`` (doc_id, text, source), one row per document:
    (doc_id, size, source_size, target, copies, shards): ``shards[c]`` is the output
    shard of copy ``c``. A row's place is drawn from its ``content`` (columns; doc_id and text if not
    given), so the same rows give the same mix however they lie in files."""
    prepare(docs.sparkSession)
    facts = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                              F.xxhash64(F.lit(seed), *(content or ["doc_id", "text"])).alias("key")), "mix-facts")
    sizes = facts.groupBy("source").agg(F.sum("size").alias("source_size"))
    aim = targets(sizes, weights, max_repeat)
    everywhere = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everywhere)
    plan = stash(
        aim.withColumn("block_size", F.greatest(
            F.ceil(total / F.lit(n_shards * blocks_per_shard)), F.lit(1)).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.least(
            F.col("target") / F.col("source_size"), F.lit(float(max_repeat))))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
        .withColumn("blocks", F.ceil(F.col("target") / F.col("block_size")).cast("long")), "mix-plan")
    ends = split_quotas(plan.select("rank", "blocks"), n_shards, seed)
    by_source = stash(plan.join(ends, "rank"), "mix-quota")

    bits = max(0, (blocks_for(facts.count(), range_rows) - 1).bit_length())
    rng = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    keyed = facts.withColumn("range", rng)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("source", "range").agg(F.sum("size").alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    offsets = offsets.join(by_source.drop("weight"), offsets["source"].eqNullSafe(by_source["source"])).drop(
        by_source["source"])
    inside = (Window.partitionBy("source", "range").orderBy("key", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, 0))
    placed = keyed.withColumn("upto", F.sum("size").over(inside))
    o = offsets.select(F.col("source").alias("_s"), F.col("range").alias("_r"), "offset", "source_size",
                       "target", "passes", "rest", "block_size", "blocks", "ends", "rank")
    joined = placed.join(o, placed["source"].eqNullSafe(o["_s"]) & (placed["range"] == o["_r"]))
    start = F.col("offset") + F.col("upto") - F.col("size")
    copies = F.col("passes") + F.when(
        (F.col("size") > 0) & (F.col("rest") > 0) & (start + F.col("size") / 2 <= F.col("rest")), 1).otherwise(0)

    def shard_of(c):
        block = F.least(F.floor((c * F.col("source_size") + F.col("start")) / F.col("block_size")),
                        F.col("blocks") - 1)
        slot = F.pmod(block * F.lit(STEP) + F.col("rank") * F.lit(7919), F.greatest(F.col("blocks"), F.lit(1)))
        return F.size(F.filter("ends", lambda e: e <= slot))

    return (joined.withColumn("start", start).withColumn("copies", copies.cast("int"))
            .withColumn("shards", F.when(F.col("copies") > 0, F.transform(
                F.sequence(F.lit(0), F.col("copies") - 1), shard_of))
                .otherwise(F.array().cast("array<int>")))
            .select("doc_id", "source", "size", "source_size", "target", "copies", "shards"))


def mixed_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 7, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` (all their columns), each as often as
    the plan takes it, with ``mix_shard`` and ``mix_order`` (a hash to sort a shard
    by; both names are lengthened if ``docs`` has them). Rows are matched to the plan by a
    written row key, so repeated doc_ids stay rows of their own."""
    return _mixed(docs, n_shards, seed, **options)[0]


def shuffled_documents(docs: DataFrame, n_shards: int = N_SHARDS, seed: int = 7, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``, in shards and shuffled inside each: the
    written files, read in order, are shard after shard."""
    mixed, shard, order = _mixed(docs, n_shards, seed, **options)
    return (mixed.repartitionByRange(shard, order).sortWithinPartitions(shard, order)
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def _mixed(docs: DataFrame, n_shards: int, seed: int, **options) -> tuple[DataFrame, str, str]:
    shard, order, row, copy, key = (
        fresh(x, docs.columns) for x in ("mix_shard", "mix_order", "mix_row", "mix_copy", "mix_key"))
    content = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]  # maps have no hash
    keyed = stash(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.xxhash64(*content)),
                  "mix-docs")
    plan = plan_mix(keyed.select(F.col(row).alias("doc_id"), "text", "source", F.col(key).alias("content")),
                    n_shards, seed, content=["content"], **options)
    taken = plan.filter("copies > 0").select(F.col("doc_id").alias(row), F.posexplode("shards").alias(copy, shard))
    mixed = keyed.join(taken, row).withColumn(order, F.xxhash64(F.lit(seed), shard, key, copy)).drop(row, copy, key)
    return mixed, shard, order
