"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree over blocks.

A row's size is the number of ``[^\\x20\\x09-\\x0D]+`` in its text (null: 0). Sources in code point order, null last, weigh
``weights`` in turn and share all sizes; a target stops at ``cap`` times its source's size and the excess is shared again by
weight until none is above.

Each source's rows fall into blocks by a hash of id and text. A source is drawn as whole passes over its blocks, each in
a permuted order, then as many whole blocks of one more permutation as its target still holds. What is missing then is
taken by rows from the next ``POOL`` blocks: in hashed order as long as they fit, then ``FILLS`` times the largest that still
fit. So no row is taken more than ``cap`` times, and a source stays below its target by less than its smallest rows there.
Only hashes and sizes of these blocks' rows are sorted, one task for a source: ``POOL`` of at most ``_FINE`` blocks. Rows with
equal id and text are taken there together or not at all.

The tree then deals the drawn blocks out: the shards are halved again and again, and the left half's share of every
source's quota is drawn from the multivariate hypergeometric distribution, so that shards are even and quotas exact. Each
shard takes the next run of each source's permuted blocks, and its rows in the order of a second hash.

The driver holds one row for each source and each block: about ``4 * shards + sources`` in number, where the shards follow
the input up to ``most_shards``; beyond that, shards grow (at 10^13 words, about 10^8 words each, which their sort spills). A
source with a third of all rows has a third of the blocks. All draws come from ``seed``, so reruns agree. A table without
words gives no taken words; null ids and texts are rows like others; other columns, whatever their names, are kept
and never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
POOL, FILLS = 16, 4
WORD = r"[^\x20\x09-\x0D]+"
_FINE = 1 << 16
#: Rows that cut blocks give, up to which they are broadcast: 16 bytes each.
BROADCAST_ROWS = 1 << 18
def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[float], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of the sizes' sum by weight, none above ``cap`` times its size."""
    total = float(sum(sizes))
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_:
        per = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if per * weights[i] > cap * sizes[i]]
        if not above:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in above:
            out[i] = cap * float(sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas by source, dealt over shards: rows are shards, sums by column the quotas, sums by row as even as can be."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    drawn = int(quotas.sum())
    edge = [drawn * i // shards for i in range(shards + 1)]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        left = rng.multivariate_hypergeometric(q, edge[mid] - edge[lo], method="marginals") if q.sum() else q
        stack += [(mid, hi, q - left), (lo, mid, left)]
    return out


@dataclass
class Source:
    """What the driver knows of a source."""

    name: str | None
    size: int
    target: float = 0.0
    blocks: int = 1
    words: dict[int, int] = field(default_factory=dict)
    draws: list[int] = field(default_factory=list)
    pool: list[int] = field(default_factory=list)
    rest_words: float = 0.0


def draw(source: Source, rng: np.random.Generator) -> None:
    """Fills ``draws`` with blocks in the order in which they are taken; ``rest`` is the one of which a part is."""
    if source.size <= 0:
        return
    passes = int(source.target / source.size + 1e-12)
    left = source.target - passes * source.size
    names = np.array(sorted(source.words), np.int64)
    for _ in range(passes):
        source.draws += rng.permutation(names).tolist()
    if left > 1e-6:
        order = rng.permutation(names).tolist()
        at = 0
        while at < len(order) - 1 and source.words[order[at]] <= left:
            left -= source.words[order[at]]
            at += 1
        start = max(0, min(at, len(order) - POOL))
        source.pool, source.rest_words = order[start : start + POOL], left + sum(source.words[b] for b in order[start:at])
        source.draws += order[: start + 1]


def key_of(source: Column) -> Column:
    """A string for each source, null among them."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, name: str) -> DataFrame:
    """``df`` with a struct called ``name``: a row's size, hash, source and fine block."""
    hashed = F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    return df.withColumn(
        name,
        F.struct(
            word_count(F.col(f"`{text_col}`")).alias("size"),
            hashed.alias("hash"),
            key_of(F.col(f"`{source_col}`")).alias("key"),
            F.pmod(hashed, F.lit(_FINE)).cast("int").alias("fine"),
        ),
    )


@dataclass
class Plan:
    sources: list[Source]
    shards: int
    table: DataFrame  #: a row for each source and block: the shards that take it, and what holds for its cut part
    named: DataFrame  #: a row for each source: its number of blocks, size and target; both are bounded and broadcast


def plan(rows: DataFrame, weights=WEIGHTS, cap: float = 3.0, seed: int = 7, shard_words: int = 1 << 21, most_shards: int = 1 << 16) -> Plan:
    """How much of which block goes where, from (size, key, fine) of all rows."""
    spark = rows.sparkSession
    fine = common.cut(rows.groupBy("key", "fine").agg(F.sum("size").alias("words")))
    found = fine.groupBy("key").agg(F.sum("words").alias("words")).collect()  # a row for each source
    sources = sorted((Source(None if r[0] == "null" else r[0][1:], int(r[1] or 0)) for r in found), key=lambda s: (s.name is None, s.name or ""))
    by_weight = [float(weights[i % len(weights)]) for i in range(len(sources))]
    for s, t in zip(sources, targets([s.size for s in sources], by_weight, cap)):
        s.target = t
    total = sum(s.size for s in sources)
    shards = int(min(most_shards, max(8, -(-total // shard_words))))
    for s in sources:
        s.blocks = min(_FINE, max(1, round(4 * max(shards, 256) * s.size / max(total, 1))))
    keys = ["null" if s.name is None else "=" + s.name for s in sources]
    named = common.own_rows(spark, [(k, s.blocks, s.size, float(s.target)) for k, s in zip(keys, sources)], "key string, blocks int, source_size long, target double")
    blocks = (
        fine.join(F.broadcast(named), "key")
        .groupBy("key", (F.col("fine") % F.col("blocks")).alias("block"))
        .agg(F.sum("words").alias("words"))
        .collect()  # a row for each block, whose number is bounded
    )
    of = dict(zip(keys, sources))
    for key, block, words in blocks:
        of[key].words[block] = int(words)
    rng = np.random.default_rng(seed)
    for s in sources:
        draw(s, rng)
    table = []
    if sources:
        quotas = split(np.array([len(s.draws) for s in sources], np.int64), shards, rng)
        for i, s in enumerate(sources):
            to = np.repeat(np.arange(shards), quotas[:, i]).tolist()
            places: dict[int, list[int]] = {b: [] for b in s.words}
            for block, shard in zip(s.draws, to):
                places[block].append(shard)
            last = places[s.pool[0]].pop() if s.pool else None
            for block in s.words:
                cut_here = block in s.pool
                table.append((keys[i], block, places[block], s.rest_words if cut_here else None, last if cut_here else None))
    common.release(fine)
    return Plan(sources, shards, common.own_rows(spark, table, "key string, block int, shards array<int>, rest double, rest_shard int"), named)


def chosen(rows: DataFrame, made: Plan) -> DataFrame:
    """(key, block, hash) of the rows that cut blocks give, from (size, hash, key, fine) of all rows."""
    cut = rows.join(F.broadcast(made.named.select("key", "blocks")), "key").withColumn("block", F.col("fine") % F.col("blocks"))
    cut = cut.join(F.broadcast(made.table.where("rest IS NOT NULL").select("key", "block", "rest")), ["key", "block"])
    part = cut.groupBy("key", "block", "hash", "rest").agg(F.sum("size").alias("size")).withColumn("taken", F.lit(False))
    everything = Window.partitionBy("key")
    by_hash = [F.xxhash64(F.lit(1), "hash"), F.col("hash")]
    for order in (by_hash, *[[F.col("size").desc(), *by_hash]] * FILLS):
        running = everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        part = part.withColumn("gap", F.col("rest") - F.coalesce(F.sum(F.when(F.col("taken"), F.col("size"))).over(everything), F.lit(0)))
        part = part.withColumn("fits", ~F.col("taken") & (F.col("size") <= F.col("gap")))
        part = part.withColumn("taken", F.col("taken") | (F.col("fits") & (F.sum(F.when(F.col("fits"), F.col("size"))).over(running) <= F.col("gap"))))
    return part.where("taken").select("key", "block", "hash")


def placed(rows: DataFrame, name: str, own: DataFrame, **how) -> tuple[DataFrame, Plan]:
    """``rows`` of ``sized``, in the struct ``name`` also source_size, target and places: the shards that take the row, one entry
    for each time. ``own`` is a table of the structs alone.

    What cut blocks give is broadcast if it is ``BROADCAST_ROWS`` at most; else only the rows of cut blocks are joined with it.
    """
    made = plan(own.select("size", "key", "fine"), **how)
    taken = common.cut(chosen(own, made))
    known, given, few = common.fresh(rows, "known", "given", "few")
    of_source = made.named.select(F.col("key").alias(f"{known}_key"), F.struct("blocks", "source_size", "target").alias(known))
    here = rows.join(F.broadcast(of_source), F.col(f"`{name}`.key") == F.col(f"{known}_key"), "left")
    block = (F.col(f"`{name}`.fine") % F.col(f"{known}.blocks")) == F.col(f"{given}.block")
    here = here.join(F.broadcast(made.table.select(F.struct("key", "block", "shards", "rest", "rest_shard").alias(given))), (F.col(f"`{name}`.key") == F.col(f"{given}.key")) & block, "left")
    side = taken.select(F.col("hash").alias(f"{few}_hash"), F.col("key").alias(few))
    cut, same = F.col(f"{given}.rest").isNotNull(), (F.col(f"`{name}`.hash") == F.col(f"{few}_hash")) & (F.col(f"`{name}`.key") == F.col(few))
    if taken.count() <= BROADCAST_ROWS:
        here = here.join(F.broadcast(side), cut & same, "left")
    else:
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in side.schema.fields]
        here = here.where(cut).join(side, same, "left").unionByName(here.where(~cut).select("*", *none))
    places = F.coalesce(F.col(f"{given}.shards"), F.array().cast("array<int>"))
    places = F.when(F.col(few).isNotNull(), F.concat(places, F.array(f"{given}.rest_shard"))).otherwise(places)
    out = here.withColumn(name, F.struct(F.col(f"`{name}`.*"), F.col(f"{known}.source_size"), F.col(f"{known}.target"), places.alias("places")))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns]), made


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, one partition for each shard, in its shuffled order."""
    name, copy, shard = common.fresh(df, "own", "copy", "shard")
    rows = sized(df, id_col, source_col, text_col, name)
    own = common.cut(rows.select(f"`{name}`.*"))
    rows, made = placed(rows, name, own, **how)
    common.release(own)
    out = rows.select(*[F.col(f"`{c}`") for c in df.columns], F.col(f"{name}.hash").alias(name), F.posexplode(f"{name}.places").alias(copy, shard))
    return (
        out.repartitionById(made.shards, F.col(shard))
        .sortWithinPartitions(F.xxhash64(F.lit(2), name, F.col(copy)))
        .select(*[F.col(f"`{c}`") for c in df.columns])
    )


def shares(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """For each row: its size, its source's size and target, how many words the mix takes, and into which shards."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    rows = common.cut(sized(rows, "id", "source", "text", "own").select("id", "own"))
    out, _ = placed(rows, "own", rows.select("own.*"), **how)
    return out.select(
        F.col("id").alias(id_col),
        "own.size",
        "own.source_size",
        "own.target",
        (F.col("own.size") * F.size("own.places")).alias("taken"),
        F.col("own.places").alias("shards"),
    )


def op1_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return shares(common.table(spark, sf_dir, "documents"))
