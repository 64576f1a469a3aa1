"""Mixing sources to target weights, in DataFrame functions only.

The words of each source, in document order, are packed into blocks of fixed
length. Every output shard draws multinomial source counts; each source's slots
run through pseudorandom permutations of its block numbers, one for each pass
over the source, and slots and blocks meet in a join by (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapewright.llm.common import count_words, cut, let, partitions, split_words, tasks_for

WEIGHTS = (5, 2, 1)
#: A source is repeated this often at most.
PASSES = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
ROUNDS = 16
#: Cells of the grid by which a draw finds the source whose interval holds it.
CELLS = 4096
MADE = ("size", "source_size", "target", "taken")


def source_targets(sizes: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """(key, source, source_size) rows -> weight, cap and target of each source.

    Sources by code point, null last, take the weights in turn. Targets are
    weight * level, or passes * size where that is less; the level is such that
    the targets add up to all sizes. Sorted by cap/weight, the sources at their
    caps come first, so running sums find the level. One row a source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % len(weights)
    w = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in weights]), turn))
    w = w.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("total", F.sum("source_size").over(every).cast("double"))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    w = w.withColumn("place", F.row_number().over(by))
    free = F.col("ratio") > F.col("level")
    w = w.withColumn("first", F.min(F.when(free, F.struct("place", "level"))).over(every))
    at_cap = F.col("first").isNull() | (F.col("place") < F.col("first.place"))
    return w.withColumn("target", F.when(at_cap, F.col("cap")).otherwise(F.col("weight") * F.col("first.level"))).withColumn("at_cap", at_cap).drop("first", "place", "level", "total", "ratio")


def permuted(index: Column, size: Column, *salt: Column, rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 .. size-1 (swap-or-not shuffle): each
    round pairs x with key - x and swaps the two or not by a hash of the pair."""

    def step(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit("key"), *salt, r), size)
        return let(F.pmod(key - x, size), lambda y: F.when(F.pmod(F.xxhash64(F.lit("bit"), *salt, r, F.greatest(x, y)), F.lit(2)) == 0, x).otherwise(y))

    # never null, and said so, as a join would check it by doing the rounds once more
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), step), F.lit(-1).cast("long"))


def draw_counts(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """Multinomial counts by (shard, key), scaled to each source's slots.

    Every slot draws an integer below n_slots; a source owns as many integers as
    it has slots. Its counts are then scaled shard by shard with cumulative
    rounding, so that they add up to its slots exactly; the lengths of shards
    vary by a few blocks for it.
    """
    spark = sources.sparkSession
    n_shards = max(1, -(-n_slots // shard_slots))
    width = max(1, -(-n_slots // CELLS))
    ends = sources.where("slots > 0").withColumn("hi", F.sum("slots").over(Window.orderBy("key"))).withColumn("lo", F.col("hi") - F.col("slots"))
    grid = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).select("cell", "key", "lo", "hi")
    draws = spark.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(n_slots, 1))).alias("draw")
    ).withColumn("cell", F.floor(F.col("draw") / width))
    drawn = draws.join(grid, "cell").where("draw >= lo and draw < hi").groupBy("shard", "key").agg(F.count(F.lit(1)).alias("drawn"))
    # a source that no shard drew gets its slots spread evenly
    shards = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    got = sources.where("slots > 0").select("key", "slots", "blocks").join(drawn, "key", "left")
    got = got.withColumn("all", F.coalesce(F.sum("drawn").over(whole), F.lit(0)))
    lost = got.where("all = 0").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long")))).withColumn("drawn", F.lit(1).cast("long")).withColumn("all", F.lit(n_shards).cast("long"))
    got = got.where("all > 0").unionByName(lost)
    scaled = lambda c: F.floor(c.cast("decimal(38,0)") * F.col("slots") / F.col("all")).cast("long")
    got = got.withColumn("upto", scaled(F.sum("drawn").over(shards))).withColumn("from", F.coalesce(F.lag("upto").over(Window.partitionBy("key").orderBy("shard")), F.lit(0)))
    return got.where("upto > from").select("shard", "key", "blocks", "from", "upto")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, passes: int = PASSES, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The rows with their places and sources, and the segments that the mix takes.

    First: one row for each row of ``docs`` (id, mark = hash of the text, key and
    source, copy = number among equal rows, size, source_size, target, start =
    its first word's place in its source). Second: one row for each taken piece
    (id, mark, key, copy, pass, lo, hi: words lo .. hi-1 of the document, shard).
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), key.alias("key"), F.col(f"`{source}`").cast("string").alias("source"), count_words(F.col(f"`{text}`")).alias("size"))
    base = cut(base.groupBy("id", "mark", "key", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    sources = source_targets(base.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, passes)
    blocks = F.ceil(F.col("source_size") / block_words)
    slots = F.when(F.col("at_cap"), passes * blocks).otherwise(F.least(F.round(F.col("target") / block_words).cast("long"), passes * blocks))
    sources = cut(sources.withColumn("blocks", blocks).withColumn("slots", slots), "mix-sources")
    totals = base.agg(F.count(F.lit(1))).first()[0], sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    # running sums in two steps: within a salted part of a source, then over its parts
    parts = max(64, -(-totals[0] // 200_000))
    rows = base.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies").withColumn("part", F.pmod(F.xxhash64("id", "mark", "copy"), F.lit(parts)))
    inner = Window.partitionBy("key", "part").orderBy("id", "mark", "copy").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("size").over(inner) - F.col("size"))
    offsets = base.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).groupBy("key", F.pmod(F.xxhash64("id", "mark", "copy"), F.lit(parts)).alias("part")).agg(F.sum("size").alias("sum"))
    offsets = offsets.withColumn("offset", F.sum("sum").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).drop("sum")
    rows = rows.join(offsets, ["key", "part"]).withColumn("start", F.col("offset") + F.col("within")).drop("offset", "within", "part")
    rows = cut(rows.join(sources.select("key", "source_size", "target"), "key"), "mix-rows")

    counts = draw_counts(sources, totals[1], shard_slots, seed)
    # the ranges of slots are few rows; they are dealt out before they become one row a slot
    counts = counts.repartition(max(partitions(spark), tasks_for(totals[1])), "shard", "key")
    slot = counts.withColumn("j", F.explode(F.sequence("from", F.col("upto") - 1)))
    slot = slot.withColumn("pass", F.floor(F.col("j") / F.col("blocks"))).withColumn("block", permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("key"), F.col("pass")))
    held = rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    held = held.select("id", "mark", "key", "copy", "block", F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0)).alias("lo"), F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size")).alias("hi"))
    return rows, held.join(slot.select("key", "block", "pass", "shard"), ["key", "block"])


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """How much the mix takes of each row: id, mark, source, size, source_size, target, taken.

    Cases: a null text has size 0 and nothing of it is taken; a null source is a
    source of its own, the last; rows with equal id, text and source are separate
    documents; null ids are ids; an empty table gives an empty result.
    """
    rows, pieces = mix_plan(docs, **options)
    by = ["id", "mark", "key", "copy"]
    taken = pieces.groupBy(*by).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    same = (F.col("r.id").eqNullSafe(F.col("t.id"))) & (F.col("r.mark") == F.col("t.mark")) & (F.col("r.key") == F.col("t.key")) & (F.col("r.copy") == F.col("t.copy"))
    return rows.alias("r").join(taken.alias("t"), same, "left").select("r.*", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")).drop("key", "copy", "start")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: a row for each pass over a
    document of which the mix takes something, holding the words it takes.

    A pass that takes a whole document keeps its text as it is; of others, the
    taken words are joined by one space. ``length``, if it is a column, is set to
    the new text's code points. Of rows with equal id, text and source, the other
    columns come from any one. Documents without words are not taken.
    """
    rows, pieces = mix_plan(docs, id_col=id_col, text=text, source=source, **options)
    by = ["id", "mark", "key", "copy"]
    passes = pieces.groupBy(*by, "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("segments"), F.sum(F.col("hi") - F.col("lo")).alias("got"))
    key = F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("n"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), key.alias("key")).dropDuplicates(["id", "mark", "key"])
    same = (F.col("d.id").eqNullSafe(F.col("p.id"))) & (F.col("d.mark") == F.col("p.mark")) & (F.col("d.key") == F.col("p.key"))
    body = F.col(f"row.`{text}`")
    words = split_words(body)
    some = let(words, lambda w: F.array_join(F.flatten(F.transform(F.col("segments"), lambda s: F.slice(w, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), " "))
    out = whole.alias("d").join(passes.alias("p"), same).withColumn("__new", F.when(F.col("got") == F.size(words), body).otherwise(some))
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns} | {text: F.col("__new")}
    if length in docs.columns:
        cols[length] = F.length("__new").cast(docs.schema[length].dataType)
    return out.select(*[v.alias(k) for k, v in cols.items()])
