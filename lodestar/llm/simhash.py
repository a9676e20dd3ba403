"""SimHash near-duplicates: fingerprints of word shingles, linked through vantage-point trees.

Fingerprint: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of ``width`` words joined by spaces (fewer words: the
whole sequence; no word or a null text: fingerprint 0). A bit is 1 if it is set in over half of the shingles' XXH64.

Links: two fingerprints link at ``radius`` or fewer differing bits. Over all bits, distances between unrelated
fingerprints gather so closely round half of them that a tree over them hardly prunes. So each 64-bit word is cut into
``windows`` parts, and each part has a vantage-point tree of its own over the Hamming distance within that part, which
obeys the triangle inequality. Of two linked fingerprints, at least one part differs in ``radius // parts`` bits or fewer:

* a node holds a vantage point and a radius m; a fingerprint at distance s lives inside if s <= m, else outside;
* with search radius t, the inside can hold a partner only if s - t <= m, and the outside only if s + t > m; the other
  branch is pruned. A fingerprint near a boundary also visits the shard on the other side;
* the top of each tree, grown on a bounded sample (at most ``sample`` distinct fingerprints, used for nothing else), cuts
  all fingerprints into shards. Every fingerprint lives in one shard of each tree and visits those that its ball overlaps.
  Inside a shard, the same kind of tree is grown over all that live there, down to leaves that are compared in full.

With one word, four bits and three windows (the default), t is 1 and no link is lost. Two windows would do with t = 2, but a
tree prunes much worse then: among 6,000 shards, a fingerprint visits 2 x 75 of them instead of 3 x 17.

Near copies with a shingle similarity of 0.8 differ in about 15% of the bits, which no tree over 64 bits can search. For
these, ``similar`` takes ``WORDS`` words and up to ``NEAR`` bits, and keeps t at 1 in parts of 16 bits. These links are
candidates only: the sets of shingles are compared, and those under 80 percent go before components are made. A candidate
between two texts that compared links join already needs no comparison. What this search leaves out is found by prefixes
(``missed``): two sets with 80 percent in common share one of the first shingles, in any one order of all shingles.
There a point is a fingerprint with a digest of its set, so texts that share a fingerprint alone are compared too.
Pairs that share a shingle by chance grow with the square of the texts, and a set is long. So bitmaps of the sets bound what
two can have in common (``bitmap``), a short one where pairs are made and one of the set's size after that, and whole sets
are fetched only for pairs that the bounds leave. A bound is never less than the truth, so no link is lost by it.

Pairs are compared over all bits, so links are exact: the sample only decides where cuts lie. A shard with more than
four times ``shard`` fingerprints (a large group of near copies that agree in a part) is dealt over a grid: those that live
there by rows, those that look for partners by columns, so that no task holds more than a few times ``shard`` of them, and
every pair meets in one cell. No pairs leave a shard: it returns a spanning forest of its links, at most one row for each
fingerprint in it (where links are compared further, in each leaf, so that a candidate that fails hides no other leaf's).
Each row is a link, from a fingerprint's tree to the nearest in a tree of lower ones. Components come from these by
repeated star contraction in DataFrames.

Only distinct fingerprints are searched, so a group of any number of exact copies is one of them. A repeated row gets
the same result each time; a null id counts as a document whose id is unknown and is never a component's id unless all
ids of the component are null; an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import connected, salted

#: Words and bits of the fingerprints by which candidates for a shingle similarity of 0.8 are found.
WORDS, NEAR = 6, 80
#: Bits of the filter of texts whose shingles are wanted, at most: 64 MB.
FILTER_BITS = 1 << 29
#: Rows of one key that are dealt to one place of a join, at least; and such keys, at most, which are broadcast.
HEAVY_ROWS, HEAVY_KEYS = 1 << 13, 1 << 14
#: Texts, about, by which frequent shingles are known, and how many of those are kept. They only decide the order of shingles.
ORDER_TEXTS, ORDER_SHINGLES = 1 << 14, 1 << 17

#: 64-bit words of the bitmap that a shingle takes to the join of prefixes.
ROW_WORDS = 8

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, width: int = 4, words: int = 1, seed: int = 42) -> bytes:
    """The fingerprint of one UTF-8 text: ``words`` times eight bytes, each word's highest bit first.

    The first word is made of the shingles' XXH64, each further one of the same hashes mixed by another constant.
    """
    return _majority(shingles(text, width, seed), words)


def shingles(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The XXH64 of each shingle of a UTF-8 text, in order."""
    import xxhash

    own = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return np.empty(0, np.uint64)
    if len(own) <= width:
        grams = [b" ".join(own)]
    else:
        grams = map(b" ".join, zip(*(own[i:] for i in range(width))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), np.uint64)


def _majority(hashes: np.ndarray, words: int) -> bytes:
    n, out = len(hashes), b""
    if not n:
        return bytes(8 * words)
    for k in range(words):
        mixed = _mixed(hashes, k) if k else hashes
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            counts += np.unpackbits(mixed[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out += np.packbits(2 * counts > n).tobytes()
    return out


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    x = hashes + np.uint64(k * int(_GOLDEN) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * _GOLDEN
    x = (x ^ (x >> np.uint64(29))) * _GOLDEN
    return x ^ (x >> np.uint64(32))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, words: int = 1) -> DataFrame:
    """(id, fp binary) for each row; one pass over the texts."""

    def start():
        return lambda texts: [[fingerprint(t, width, words) for t in texts]]

    return common.map_texts(df, id_col, text_col, T.StructType([T.StructField("fp", T.BinaryType())]), start)


def _marked(text: bytes, width: int, words: int) -> tuple[bytes, np.ndarray]:
    """The fingerprint with eight bytes more, a digest of the set of shingles, and that set in order."""
    import xxhash

    hashes = shingles(text, width)
    own = np.unique(hashes)
    return _majority(hashes, words) + xxhash.xxh3_64_digest(own.tobytes()), own


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each place of ``bits`` (a power of two, 64 at least): whether an odd number of a set's shingles fall there.

    Bitmaps of two sets differ in no more places than there are shingles in one of the sets only.
    """
    return np.packbits(np.bincount((own.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1)


def sketch(own: np.ndarray) -> bytes:
    """The size of a set in eight bytes, and its bitmap of about as many bits."""
    return np.int64(len(own)).tobytes() + bitmap(own, max(64, 1 << (max(1, len(own)) - 1).bit_length())).tobytes()


def could_hold(x: bytes, y: bytes, percent: int) -> bool:
    """Whether the sets of two sketches can have ``percent`` of their union in common. The longer bitmap is folded to the other's bits."""
    both = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
    x, y = (np.frombuffer(v, np.uint8, offset=8) for v in (x, y))
    least = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, least), axis=0) for v in (x, y))
    return (100 + percent) * (both - int(np.bitwise_count(x ^ y).sum())) >= 2 * percent * both


def _tag(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def marked(df: DataFrame, id_col: str, text_col: str, width: int, words: int) -> DataFrame:
    """(id, fp binary, tag) for each row: the fingerprint with the digest of its shingles, and a hash of the text."""

    def start():
        return lambda texts: [[_marked(t, width, words)[0] for t in texts], [_tag(t) for t in texts]]

    return common.map_texts(df, id_col, text_col, T.StructType([T.StructField("fp", T.BinaryType()), T.StructField("tag", T.LongType())]), start)


def _points(column: pa.Array | pa.ChunkedArray, words: int) -> np.ndarray:
    """Fingerprints as a matrix of unsigned words; all have one length, so they lie side by side in the column's buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.empty((0, words), np.uint64)
    start = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], ">u8", len(column) * words, start).astype(np.uint64).reshape(-1, words)


def _binary(points: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in points.astype(">u8")], pa.binary())


@dataclass(frozen=True)
class Node:
    """A node of a vantage-point tree: up to ``cut`` from ``vantage`` is inside. A leaf has a shard number only."""

    vantage: int = 0
    cut: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1


@dataclass(frozen=True)
class Part:
    """Some bits of one word of the fingerprints, and how far a search in them goes."""

    word: int
    mask: int
    reach: int

    def distances(self, points: np.ndarray, vantage: int) -> np.ndarray:
        return np.bitwise_count((points[:, self.word] ^ np.uint64(vantage)) & np.uint64(self.mask)).astype(np.int16)


def parts_of(words: int, windows: int, reach: int) -> list[Part]:
    """The parts of all words, as equal in size as can be."""
    at = [64 * i // windows for i in range(windows + 1)]
    return [Part(k, ((1 << b) - (1 << a)) & (2**64 - 1), reach) for k in range(words) for a, b in zip(at, at[1:])]


def choose(points: np.ndarray, part: Part) -> tuple[int, int] | None:
    """The vantage point and the cut of a node: of a few candidates, the one whose branches share the fewest points.

    None if no cut leaves points on both sides.
    """
    best = None
    n = len(points)
    for at in sorted({0, n // 3, 2 * n // 3, n - 1}):
        vantage = int(points[at, part.word])
        below = np.cumsum(np.bincount(part.distances(points, vantage), minlength=66))
        for cut in range(65):
            inside = int(below[cut])
            if not 0 < inside < n:
                continue
            visits_in = int(below[min(65, cut + part.reach)])
            visits_out = n - (int(below[cut - part.reach]) if cut >= part.reach else 0)
            cost = (visits_in * inside + visits_out * (n - inside)) / (n * n)
            if best is None or cost < best[0]:
                best = (cost, vantage, cut)
    return best and best[1:]


def grow(sample: np.ndarray, part: Part, leaf: int, next_shard: list[int]) -> Node:
    """The top of a tree, down to ``leaf`` sample points a shard."""
    found = choose(sample, part) if len(sample) > leaf else None
    if not found:
        next_shard[0] += 1
        return Node(shard=next_shard[0] - 1)
    vantage, cut = found
    inside = part.distances(sample, vantage) <= cut
    return Node(vantage, cut, grow(sample[inside], part, leaf, next_shard), grow(sample[~inside], part, leaf, next_shard))


def route(node: Node, points: np.ndarray, at: np.ndarray, home: np.ndarray, part: Part, out: list) -> None:
    """Adds (shard, positions, lives there) to ``out`` for every shard that the points' balls overlap.

    A pair whose homes part at a node is found once: there only the outer point visits, the inner stays in its branch.
    Those that visit go both ways from there on.
    """
    if not len(at):
        return
    if node.shard >= 0:
        out.append((node.shard, at, home))
        return
    d = part.distances(points[at], node.vantage)
    lives_in = d <= node.cut
    goes_in = d - part.reach <= node.cut
    goes_out = ~lives_in | (~home & (d + part.reach > node.cut))
    route(node.inside, points, at[goes_in], home[goes_in] & lives_in[goes_in], part, out)
    route(node.outside, points, at[goes_out], home[goes_out], part, out)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray, bits: np.ndarray, out: list) -> np.ndarray:
    """Joins the trees of a[i] and b[i] for all i; parent points at roots before and after.

    A tree goes to the nearest one with a lower root; the links that join trees are added to ``out``.
    """
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, bits, x, y = a[apart], b[apart], bits[apart], x[apart], y[apart]
        high, low = np.maximum(x, y), np.minimum(x, y)
        order = np.lexsort((low, bits, high))
        first = order[np.unique(high[order], return_index=True)[1]]
        parent = parent.copy()
        parent[high[first]] = low[first]
        out.append((a[first], b[first]))
        parent = _roots(parent)


def _compare(points, homes, seekers, part: Part, radius: int, words: int, parent, out: list, most: int = 1 << 18):
    """Joins all links between two sets of positions. Homes of one tree are not compared with seekers of the same."""
    step = max(1, most // max(1, len(seekers)))
    while len(homes):
        roots, of, counts = np.unique(parent[homes], return_inverse=True, return_counts=True)
        top = int(counts.argmax())
        chosen = np.flatnonzero(of == top)[:step] if counts[top] >= 32 else np.arange(min(step, len(homes)))
        block, homes = homes[chosen], np.delete(homes, chosen)
        others = seekers[parent[seekers] != roots[top]] if counts[top] >= 32 else seekers
        near = np.bitwise_count((points[block, part.word][:, None] ^ points[others, part.word][None, :]) & np.uint64(part.mask)) <= part.reach
        i, j = np.nonzero(near)
        i, j = block[i], others[j]
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        bits = np.bitwise_count(points[i, :words] ^ points[j, :words]).sum(1, dtype=np.int32)
        linked = bits <= radius
        parent = _join(parent, i[linked], j[linked], bits[linked], out)
    return parent


def forest(points: np.ndarray, home: np.ndarray, part: Part, radius: int, words: int | None = None, leaf: int = 192, seek: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between those that live in a shard and those that seek in it (all), as positions.

    If points have more than ``words`` words, a digest follows their fingerprints, and each leaf has a forest of its own.
    """
    everyone = np.arange(len(points))
    parent, words = everyone.copy(), words or points.shape[1]
    out = [(everyone[:0], everyone[:0])]
    stack = [(everyone[home], everyone if seek is None else everyone[seek])]
    while stack:
        homes, seekers = stack.pop()
        if not len(homes) or not len(seekers):
            continue
        found = choose(points[homes[:: max(1, len(homes) // 512)]], part) if len(homes) > leaf else None
        if found:
            vantage, cut = found
            inside = part.distances(points[homes], vantage) <= cut
            d = part.distances(points[seekers], vantage)
            goes_in, goes_out = d - part.reach <= cut, d + part.reach > cut
            work = int(inside.sum()) * int(goes_in.sum()) + int((~inside).sum()) * int(goes_out.sum())
            if inside.any() and not inside.all() and work < 0.9 * len(homes) * len(seekers):
                stack += [(homes[inside], seekers[goes_in]), (homes[~inside], seekers[goes_out])]
                continue
        if words < points.shape[1]:
            parent = everyone
        parent = _compare(points, homes, seekers, part, radius, words, parent, out)
    a, b = zip(*out)
    return np.concatenate(a), np.concatenate(b)


_VISIT = T.StructType([T.StructField("tree", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("home", T.BooleanType()), T.StructField("point", T.BinaryType())])
_EDGE = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("bits", T.IntegerType())])


def links(points: DataFrame, radius: int = 4, words: int = 1, windows: int = 3, reach: int | None = None, sample: int = 65536, shard: int | None = None, marks: int = 0) -> DataFrame:
    """(a, b, bits): a spanning forest, in parts, of the links between the distinct fingerprints in column ``point``, and how many
    bits the two differ in.

    ``marks`` words follow a fingerprint's own and have no part in distances.

    ``reach`` is how many bits a search in a part goes; by default the least with which no link is lost. The tops of the
    trees grow on the fingerprints whose hash falls into one of so many classes that about an eighth of them are taken, and
    about ``sample`` at most. About ``shard`` fingerprints live in a shard: by default 65536, from four million on a 64th of
    all, a million at most, so that a tree of few levels sends each fingerprint to few shards. A shard in which over
    four times as many live is dealt out by a salt.
    """
    spark = points.sparkSession
    parts = parts_of(words, windows, radius // (words * windows) if reach is None else reach)
    n = points.count()
    one_in = max(8, -(-n // sample))
    taken = sorted(bytes(r[0]) for r in points.where(F.pmod(F.xxhash64("point"), F.lit(one_in)) == 0).select("point").collect())
    picked = _points(pa.array(taken, pa.binary()), words + marks)
    shard = shard or min(1 << 20, max(1 << 16, n >> 6))
    leaf = max(2, int(shard * len(picked) / max(n, 1)))
    trees = [grow(picked, part, leaf, [0]) for part in parts]

    def visits(batches):
        for batch in batches:
            own = _points(batch.column(0), words + marks)
            for k, (tree, part) in enumerate(zip(trees, parts)):
                out: list = []
                route(tree, own, np.arange(len(own)), np.ones(len(own), bool), part, out)
                for where, at, home in out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), where, np.int32)), pa.array(home), batch.column(0).take(pa.array(at))], names=_VISIT.names)

    seen = points.select("point").mapInArrow(common.resting(visits), _VISIT)
    size = seen.groupBy("tree", "shard").agg(F.sum(F.col("home").cast("long")).alias("lives"))
    salts = size.select("tree", "shard", F.ceil(F.col("lives") / F.lit(4 * shard)).cast("int").alias("salts")).where("salts > 1").collect()
    # One row for each crowded shard of trees whose size the sample bounds.
    crowded = common.own_rows(spark, [tuple(r) for r in salts], "tree int, shard int, salts int")
    # Cell (row, column) of a crowded shard's grid holds the homes of one hash class and the seekers of another.
    n_salts = F.coalesce("salts", F.lit(1))
    own, every = F.pmod(F.xxhash64("point"), n_salts).cast("int"), F.sequence(F.lit(0), n_salts - 1)
    as_home = F.when(F.col("home"), F.transform(every, lambda j: F.struct(own.alias("row"), j.alias("column"), F.lit(True).alias("lives"), (j == own).alias("seeks"))))
    as_seeker = F.transform(F.filter(every, lambda i: ~F.col("home") | (i != own)), lambda i: F.struct(i.alias("row"), own.alias("column"), F.lit(False).alias("lives"), F.lit(True).alias("seeks")))
    cells = F.when(F.col("home"), F.concat(as_home, as_seeker)).otherwise(as_seeker)
    dealt = seen.join(F.broadcast(crowded), ["tree", "shard"], "left").select("tree", "shard", "point", F.explode(cells).alias("cell")).select("tree", "shard", "cell.*", "point")

    def search(key, group):
        common.forget()
        column = group.column("point").combine_chunks()
        home, seek = (group.column(c).to_numpy().astype(bool) for c in ("lives", "seeks"))
        points = _points(column, words + marks)
        if marks:  # in one order everywhere, so that the trees choose the same links
            order = np.lexsort(points.T[::-1])
            points, home, seek, column = points[order], home[order], seek[order], column.take(pa.array(order))
        a, b = forest(points, home, parts[key[0].as_py()], radius, words, seek=seek)
        bits = np.bitwise_count(points[a, :words] ^ points[b, :words]).sum(1, dtype=np.int32)
        return pa.table([column.take(pa.array(a)), column.take(pa.array(b)), pa.array(bits, pa.int32())], names=_EDGE.names)

    return dealt.groupBy("tree", "shard", "row", "column").applyInArrow(search, _EDGE)


def _filter_of(tags: DataFrame) -> np.ndarray:
    """A bitmap of hashes (column ``tag``), 16 bits for each or ``FILTER_BITS`` in all: made by Spark, bounded on the driver."""
    bits = 1 << 15
    wanted = 16 * tags.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2
    place = F.pmod(F.col("tag"), F.lit(bits)) + 1
    chunks = tags.groupBy(F.bitmap_bucket_number(place).alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held")).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for chunk, held in zip(chunks.column("chunk").to_pylist(), chunks.column("held").to_pylist()):
        out[(chunk - 1) * 4096 : chunk * 4096] = np.frombuffer(held, np.uint8)
    return out


def _sets(df: DataFrame, text_col: str, points: DataFrame, width: int, words: int) -> DataFrame:
    """(point, own, sketch): the set of shingles of each of ``points`` (point, tag) and of some others, one 64-bit hash after the
    other, and its ``sketch``.

    A pass over the texts. A filter of the tags is sent to the workers; it is of bounded size and lets some others pass.
    """
    sent = df.sparkSession.sparkContext.broadcast(_filter_of(points.select("tag")))

    def run(batches):
        held, seen = sent.value, set()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in common.slices(texts, 1 << 20):
                found = []
                for text in texts.slice(*at).to_pylist():
                    tag = _tag(text)
                    place = tag % (8 * len(held))
                    if held[place >> 3] >> (place & 7) & 1 and tag not in seen:
                        seen.add(tag)
                        point, own = _marked(text, width, words)
                        found.append((point, own.tobytes(), sketch(own)))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(3)], names=["point", "own", "sketch"])

    rows = df.select(F.lit(0).alias(common.ID), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(common.TEXT))
    return common.bounded(rows).mapInArrow(common.resting(run), "point binary, own binary, sketch binary").groupBy("point").agg(F.first("own").alias("own"), F.first("sketch").alias("sketch"))


def _by_tag(df: DataFrame, text_col: str, points: DataFrame, width: int, take) -> DataFrame:
    """(tag, own) of each of ``points`` (point, tag) and of some others, at least once: what ``take`` makes of its set of shingles.

    A pass over the texts as in ``_sets``, without fingerprints.
    """
    sent = df.sparkSession.sparkContext.broadcast(_filter_of(points.select("tag")))

    def run(batches):
        held, seen = sent.value, set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for at in common.slices(texts, 1 << 20):
                tags, found = [], []
                for text in texts.slice(*at).to_pylist():
                    tag = _tag(text)
                    place = tag % (8 * len(held))
                    if held[place >> 3] >> (place & 7) & 1 and tag not in seen:
                        seen.add(tag)
                        tags.append(tag)
                        found.append(take(np.unique(shingles(text, width)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(tags, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["tag", "own"])

    return common.bounded(df.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(common.TEXT))).mapInArrow(common.resting(run), "tag bigint, own array<bigint>")


def _frequent(df: DataFrame, text_col: str, points: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): those that a sample of the points holds most often, in order."""
    one_in = max(1, -(-points.count() // ORDER_TEXTS))
    some = points.where(F.pmod(F.xxhash64("point"), F.lit(one_in)) == 0)
    held = _by_tag(df, text_col, some, width, lambda own: own)
    often = common.cut(held.select(F.explode("own").alias("shingle")).groupBy("shingle").count().where("count > 1").orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES))
    got = often.toArrow()
    common.release(often)
    shingles, counts = (got.column(c).to_numpy().astype(np.int64) for c in ("shingle", "count"))
    order = np.argsort(shingles)
    return shingles[order], counts[order]


def prefix(own: np.ndarray, shingles: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The size of a set and its first shingles, rare ones first: as many as leave fewer than ``percent`` of the set behind."""
    own = own.view(np.int64)
    often = np.zeros(len(own), np.int64)
    if len(shingles):
        at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
        often = np.where(shingles[at] == own, counts[at], 0)
    n = len(own)
    return np.concatenate([[n], own[np.lexsort((own, often))[: n - -(-percent * n // 100) + 1]]])


def repeated(df: DataFrame, text_col: str, points: DataFrame, width: int, first) -> np.ndarray:
    """A bitmap of the shingles (48 bits of each) that more than one text has in its prefix, and of some others.

    Most prefixes are of shingles that no other text has. What is shuffled to know them is a number for each, without its text.
    """
    held = _by_tag(df, text_col, points, width, lambda own: first(own)[1:] >> 16)
    tags = common.cut(held.select(F.explode("own").alias("tag")).groupBy("tag").count().where("count > 1").select("tag"))
    out = _filter_of(tags)
    common.release(tags)
    return out


def shared(own: np.ndarray, firsts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of a set with its size and its prefix: the size, ``ROW_WORDS`` words of its bitmap, the places of those shingles that
    ``held`` has, and those shingles; of none, the size only."""
    first = firsts[1:]
    place = (first >> 16) % (8 * len(held))
    at = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
    return np.concatenate([firsts[:1], bitmap(own, 64 * ROW_WORDS).view(np.int64), at, first[at]]) if len(at) else firsts[:1]


def meeting(df: DataFrame, text_col: str, points: DataFrame, width: int, percent: int) -> DataFrame:
    """(tag, size, place, shingle, bits_0...): the prefix of each of ``points`` and of some others, without most shingles of one text
    only, with the words of the set's bitmap."""
    spark = df.sparkSession
    order = spark.sparkContext.broadcast(_frequent(df, text_col, points, width))
    first = lambda own: prefix(own, *order.value, percent)
    held = spark.sparkContext.broadcast(repeated(df, text_col, points, width, first))
    own = _by_tag(df, text_col, points, width, lambda own: shared(own, first(own), held.value)).where("size(own) > 1")
    head = 1 + ROW_WORDS
    many = f"int((size(own) - {head}) / 2)"
    pairs = F.arrays_zip(F.expr(f"slice(own, {head + 1}, {many})").alias("place"), F.expr(f"slice(own, {head + 1} + {many}, {many})").alias("shingle"))
    bits = [f"bits_{k}" for k in range(ROW_WORDS)]
    rows = own.groupBy("tag").agg(F.first("own").alias("own"))
    rows = rows.select("tag", F.element_at("own", 1).cast("int").alias("size"), *[F.element_at("own", k + 2).alias(name) for k, name in enumerate(bits)], F.explode(pairs).alias("at"))
    return rows.select("tag", "size", F.col("at.place").cast("int").alias("place"), "at.shingle", *bits)


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): the keys of those in ``rows`` that share a shingle, aren't of one root, and could have ``percent`` in common.

    At the first shingle that two share, what follows in both must be long enough. And their bitmaps bound what they share.
    """
    x, y = rows.alias("x"), rows.alias("y")
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    apart = sum((F.bit_count(F.col(f"x.bits_{k}").bitwiseXOR(F.col(f"y.bits_{k}"))) for k in range(ROW_WORDS)), F.lit(0))
    both = F.col("x.size") + F.col("y.size")
    could = (left * F.lit(100 + percent) >= F.lit(percent) * both) & (F.lit(100 + percent) * (both - apart) >= F.lit(2 * percent) * both)
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.key") < F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & could
    return x.join(y, on).select(F.col("x.key").alias("x"), F.col("y.key").alias("y")).distinct()


def missed(df: DataFrame, text_col: str, points: DataFrame, edges: DataFrame, found: DataFrame, width: int, words: int, percent: int) -> DataFrame:
    """(a, b): the links between what ``found`` (a, b) doesn't join, all of them; ``edges`` (a, b) are known.

    Every pair with ``percent`` in common shares a shingle of both prefixes. Of these pairs, those that could have it by their
    bitmaps are compared by larger ones, and those that still could by their sets.
    """
    of = points.select("point", "tag").join(connected(found, "a", "b").withColumnRenamed("node", "point"), "point", "left")
    of = common.cut(of.select("tag", F.xxhash64("point").alias("key"), F.xxhash64(F.coalesce("root", "point")).alias("root")))
    rows = common.cut(meeting(df, text_col, points, width, percent).join(of, "tag").drop("tag"))
    known = edges.select(F.xxhash64("a").alias("k"), F.xxhash64("b").alias("l")).select(F.least("k", "l").alias("x"), F.greatest("k", "l").alias("y"))
    pairs = common.cut(_pairs(rows, percent).join(known, ["x", "y"], "left_anti"))
    common.release(of, rows)
    named = lambda k, end: points.select(F.xxhash64("point").alias(k), F.col("point").alias(end))
    both = common.cut(pairs.join(named("x", "a"), "x").join(named("y", "b"), "y").drop("x", "y"))
    common.release(pairs)

    def own(left: DataFrame, column: str) -> DataFrame:
        ends = left.select(F.col("a").alias("point")).unionByName(left.select(F.col("b").alias("point"))).distinct()
        return common.cut(_sets(df, text_col, points.select("point", "tag").join(ends, "point", "left_semi"), width, words).select("point", column))

    sketches = own(both, "sketch")
    left = common.cut(possible(both, sketches, percent))
    common.release(both, sketches)
    sets = own(left, "own")
    out = common.cut(alike(left, sets, percent))
    common.release(left, sets)
    return out


def _heavy(edges: DataFrame, end: str, count: int) -> DataFrame:
    """(point, __salts): how many places a point of many of the ``count`` edges is dealt over. So few points have so many that they
    can be broadcast: ``HEAVY_KEYS`` at most."""
    most = max(64, count // HEAVY_KEYS)
    return F.broadcast(common.cut(edges.groupBy(F.col(end).alias("point")).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("__salts")).where("__salts > 1")))


def _with_set(edges: DataFrame, sets: DataFrame, heavy: DataFrame, end: str, other: str) -> DataFrame:
    """``edges`` with the set of one end."""
    salts = F.coalesce("__salts", F.lit(1))
    left = edges.withColumn("point", F.col(end)).join(heavy, "point", "left").withColumn("__salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("__salts")
    right = sets.join(heavy, "point", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return left.join(right.withColumnRenamed("own", f"own_{end}"), ["point", "__salt"]).drop("point", "__salt")


def _compared(edges: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The (a, b) that pass ``test`` of what ``sets`` (point, own) has of their ends, as bytes."""

    def run(batches):
        for batch in batches:
            keep = [i for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))) if test(x.as_buffer(), y.as_buffer())]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    own, count = edges.select("a", "b"), edges.count()
    heavy = {end: _heavy(own, end, count) for end in ("a", "b")}
    full = _with_set(_with_set(own, sets, heavy["a"], "a", "b"), sets, heavy["b"], "b", "a").select("a", "b", "own_a", "own_b")
    return common.bounded(full).mapInArrow(common.resting(run), "a binary, b binary")


def possible(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets can have ``percent`` of their union in common by their sketches (point, sketch)."""
    return _compared(edges, sets.select("point", F.col("sketch").alias("own")), lambda x, y: could_hold(bytes(x), bytes(y), percent))


def alike(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets (point, own) have ``percent`` of their union in common, or more."""

    def test(x, y):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return _compared(edges, sets.select("point", "own"), test)


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): of candidate links (a, b, bits), as many that hold ``percent`` as it takes to join all that they join.

    First each point's nearest candidate of a lower point and of a higher one are compared. What links then join needs no
    further comparison; all candidates between two components are compared, by their sketches and, if need be, their sets.
    """
    near = lambda u, v: edges.groupBy(F.col(u).alias("u")).agg(F.min(F.struct("bits", F.col(v).alias("v"))).alias("near"))
    first = near("a", "b").unionByName(near("b", "a"))
    first = common.cut(first.select(F.greatest("u", "near.v").alias("a"), F.least("u", "near.v").alias("b")).distinct())
    held = common.cut(alike(first, sets, percent))
    roots = connected(held, "a", "b")
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    rest = edges.select("a", "b").join(first, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    rest = common.cut(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    left = common.cut(possible(rest, sets, percent))
    out = common.cut(held.unionByName(alike(left, sets, percent)))
    common.release(first, held, rest, left)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, words: int = 1, percent: int | None = None, **how) -> DataFrame:
    """(id, fp, component): for each row, its fingerprint and the smallest id that links reach from it.

    With ``percent``, links also need a similarity of their shingles of so many percent.
    """
    least, copies = F.min(id_col).alias("least"), F.count(F.lit(1)).alias("copies")
    if percent is None:
        fps = common.cut(fingerprints(df, id_col, text_col, width, words))
        points = common.cut(fps.groupBy(F.col("fp").alias("point")).agg(least, copies))
        found = links(points.select("point"), radius, words, **how)
    else:
        fps = common.cut(marked(df, id_col, text_col, width, words))
        points = common.cut(fps.groupBy(F.col("fp").alias("point")).agg(least, copies, F.min("tag").alias("tag")))
        edges = common.cut(links(points.select("point"), radius, words, marks=1, **how).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "bits").distinct())
        ends = edges.select(F.col("a").alias("point")).unionByName(edges.select(F.col("b").alias("point"))).distinct()
        sets = common.cut(_sets(df, text_col, points.select("point", "tag").join(ends, "point", "left_semi"), width, words))
        found = verified(edges, sets, percent)
        found = found.unionByName(missed(df, text_col, points, edges, found, width, words, percent))
        common.release(edges, sets)
    roots = connected(found, "a", "b")
    joined = points.join(roots.withColumnRenamed("node", "point"), "point", "left").withColumn("root", F.coalesce("root", "point"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component"))
    of = common.cut(salted(joined.select("point", "root", "copies"), smallest, "root", "point").select(F.col("point").alias("fp"), "component", "copies"))
    # A fingerprint of very many rows is dealt over several places of the join; there are few of those.
    most = max(HEAVY_ROWS, (of.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]) // HEAVY_KEYS)
    heavy = F.broadcast(of.where(F.col("copies") > most).select(F.col("fp").alias("heavy"), F.ceil(F.col("copies") / most).cast("int").alias("places")))
    place = F.pmod(F.xxhash64(id_col), F.coalesce("places", F.lit(1))).cast("int")
    left = fps.join(heavy, F.col("fp") == F.col("heavy"), "left").withColumn("place", place).select(F.struct(id_col).alias("row"), "fp", "place")
    right = of.join(heavy, F.col("fp") == F.col("heavy"), "left").select("fp", "component", F.explode(F.sequence(F.lit(0), F.coalesce("places", F.lit(1)) - 1)).alias("place"))
    return left.join(right, ["fp", "place"]).select(f"row.`{id_col}`", F.substring("fp", 1, 8 * words).alias("fp"), "component")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``near_duplicates`` by links of five-word shingles with a similarity of 0.8 or more, each of which is compared."""
    return near_duplicates(df, id_col, text_col, radius=NEAR, width=5, words=WORDS, windows=4, reach=1, percent=80)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` for each component of ``similar``: that with the smallest id. All columns stay, whatever their names.

    A row goes by its id and its text: null ids come last, of equal ids the one with the lowest hash of its text stays, and
    of equal rows the first. So every component keeps one row, whatever its ids.
    """
    key, keep = common.fresh(df, "key", "keep")
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    named = F.struct(id_.isNull().alias("none"), id_.alias("id"), F.xxhash64(text).alias("text"))
    chosen = similar(df.select(named.alias("key"), text.alias("own")), "key", "own").select(F.col("component").alias(keep)).distinct()
    kept = df.withColumn(key, named).join(chosen, F.col(key) == F.col(keep), "left_semi")
    return kept.dropDuplicates([key]).drop(key)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
