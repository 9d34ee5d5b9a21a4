"""N-gram Jaccard join: links between texts whose sets of word shingles overlap enough, and the classes they make.

A text is the set of its distinct k-word shingles (64-bit hashes). Two texts link when the Jaccard similarity of their
sets is at least num / den.

* Equal sets are one node from the start, so exact copies cost nothing further.
* Size bands: sizes fall in bands of a fixed ratio; a set that may link into the band above is a guest there.
* Tiles: within a band two linking sets differ in at most d shingles. Shingles are dealt by hash to d + 1 + e parts, so
  at least e + 1 parts hold the same in both sets. A part is a tile, named by band, part and content.
* All tiles have one order: those of empty parts first, then from the most frequent to the rarest. Each set leaves out
  the first e of its tiles. Two linking sets share at least e + 1, and the last of those stands behind e others in both,
  so it stays in both: no linking pair is without a common tile, while passages that many texts share make few.
  Frequencies come from one count over all texts; the most frequent (a fixed number) are told one by one, the others
  only as "more than once" or not, which is an order too.
* Within tiles, hashed bitmap signatures: the set bits of the XOR of two bitmaps are no more than the shingles that
  differ, which bounds the overlap from above; only pairs that may still link go on to the exact intersection of their
  sorted arrays.
* A tile's members are first compared with its smallest and largest node, then, where classes are left apart, in TURNS
  turns with a member drawn at random. Those already in one class need no comparison with each other; what is left of a
  tile is compared block by block, so a tile of any size is many tasks.
* The links found are thus a spanning set, all that classes need; where every link is asked for (links(every=True),
  link_counts), all members of a tile are compared.

Defined results: a text without words has no shingles and is linked with nothing; a text of fewer than k words, but
not none, is one shingle; nodes are told apart by a 64-bit hash of the whole set.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan
from .components import components
from .shared import drop, filter_bits, fresh_name, has_bit, hottest, join_hot, member_bits, named_apart, stored, tidy

U64 = np.uint64
#: Members of a block of a tile: SMALL_BLOCK up to 16 blocks, then more, up to BLOCK, so that a tile of n has no more than n * n / BLOCK rows.
SMALL_BLOCK, BLOCK = 256, 4096
LEAST_BITS, MOST_BITS = 64, 65536
#: Turns in which members of tiles that are not one class yet are compared with one of them: the first leaves few that another would join.
TURNS = 1
#: Tiles whose frequency every task knows.
HOT_TILES = 1 << 17


class Tiled:
    """The tiles of some sets: of entry i (a set in one band) those from first[i] to first[i + 1]."""

    def __init__(self, owner: np.ndarray, first: np.ndarray, tile: np.ndarray, filled: np.ndarray, spare: np.ndarray):
        self.owner, self.first, self.tile, self.filled, self.spare = owner, first, tile, filled, spare

    def kept(self, frequency: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(set, tile) of the tiles behind the first `spare` of each entry, of those that another set may have."""
        entry = np.repeat(np.arange(len(self.owner)), np.diff(self.first))
        order = np.lexsort((self.tile, -frequency, self.filled, entry))
        place = np.arange(len(order)) - self.first[entry]
        keep = (place >= self.spare[entry]) & ~(self.filled[order] & (frequency[order] == 0))
        return self.owner[entry[keep]], self.tile[order[keep]]


class Bands:
    """Size bands for a threshold num / den, and the number of parts of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = max(1.5 if 10 * num > 8.5 * den else 1.3, 1.05 * den / num)
        lows, x = [1], 1.0
        while lows[-1] < 1 << 40:
            x *= ratio
            if math.ceil(x) * num > lows[-1] * den or lows[-1] < 4:  # a guest comes from the band below, never from further
                lows.append(max(math.ceil(x), lows[-1] + 1))
        self.lows = np.array(lows, np.int64)
        self.differ = (2 * (self.lows[1:] - 1) * (den - num)) // (den + num)
        self.spare = np.where(self.differ > 0, -(-(self.differ + 1) * 3 // 10) + 2, 0)
        self.parts = self.differ + 1 + self.spare

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def tiles(self, sets: list[np.ndarray]) -> Tiled:
        """The tiles of all sets, in own bands and as guests."""
        sizes = np.array([len(s) for s in sets], np.int64)
        band = self.of(sizes)
        own = np.flatnonzero(sizes > 0)
        reach = band[own] + 1
        guests = own[self.den * sizes[own] >= self.num * self.lows[reach]]
        # bands may be narrower than the threshold at the smallest sizes: guests of two bands then
        further = own[(self.den * sizes[own] >= self.num * self.lows[np.minimum(reach + 1, len(self.lows) - 1)])]
        which = np.concatenate([own, guests, further])
        at = np.concatenate([band[own], band[guests] + 1, band[further] + 2])
        parts = self.parts[at]
        base = np.concatenate([[0], np.cumsum(parts)])
        total = int(base[-1])
        content, filled = np.zeros(total, U64), np.zeros(total, bool)
        step = 4096
        with np.errstate(over="ignore"):
            for i in range(0, len(which), step):
                w = which[i : i + step]
                flat = np.concatenate([sets[j] for j in w.tolist()]) if len(w) else np.zeros(0, U64)
                row = np.repeat(np.arange(i, i + len(w)), sizes[w])
                slot = base[row] + ((flat >> U64(20)) % parts[row].astype(U64)).astype(np.int64)
                np.add.at(content, slot, bytescan.mix(flat ^ U64(0x5851F42D4C957F2D)))
                filled[slot] = True
            entry = np.repeat(np.arange(len(which)), parts)
            part = np.arange(total) - base[entry]
            tile = bytescan.mix(content + at[entry].astype(U64) * U64(0x9E3779B97F4A7C15) + bytescan.mix(part.astype(U64) + U64(0xA5A5)))
        return Tiled(which, base, tile.view(np.int64), filled, self.spare[at])


class Frequencies:
    """How often tiles stand in the corpus: the most frequent ones exactly, others 1 where they may be repeated, else 0."""

    def __init__(self, tiles: np.ndarray, counts: np.ndarray, repeated: np.ndarray):
        order = np.argsort(tiles)
        self.tiles, self.counts, self.repeated = tiles[order], counts[order], repeated

    def __call__(self, tile: np.ndarray) -> np.ndarray:
        out = has_bit(self.repeated, tile).astype(np.int64)
        if len(self.tiles):
            at = np.minimum(np.searchsorted(self.tiles, tile), len(self.tiles) - 1)
            hot = self.tiles[at] == tile
            out[hot] = self.counts[at[hot]]
        return out


def fingerprint(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = bytescan.mix(shingles ^ U64(0xDA942042E4DD58B5)).sum(dtype=U64) + U64(len(shingles)) * U64(0x9E3779B97F4A7C15)
    return int(bytescan.mix(np.array([total]))[0].view(np.int64))


def bitmap(shingles: np.ndarray, each: int = 16) -> bytes:
    """A hashed bitmap of at least `each` bits for each shingle, up to MOST_BITS; halves can be OR-ed to a smaller one.

    With 16 bits so few shingles share one that the bound is close to the overlap itself, and pairs just below the
    threshold, of which a large group of near copies has very many, fall here. With 2 it tells unrelated sets apart.
    """
    width = LEAST_BITS
    while width < each * len(shingles) and width < MOST_BITS:
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(shingles & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all of the smallest width among them."""
    width = min(map(len, maps)) // 8
    out = np.empty((len(maps), width), U64)
    for i, m in enumerate(maps):
        out[i] = np.bitwise_or.reduce(np.frombuffer(m, U64).reshape(-1, width), axis=0)
    return out


def may_link(num: int, den: int, sizes_a, sizes_b, maps_a: np.ndarray, maps_b: np.ndarray) -> np.ndarray:
    """Which pairs the bitmaps leave: the overlap is at most half of what the sizes hold beyond the bits that differ."""
    apart = np.bitwise_count(maps_a ^ maps_b).sum(axis=-1, dtype=np.int64)
    both = sizes_a + sizes_b
    return (den + num) * ((both - apart) // 2) >= num * both


class ShingleJoin:
    """The join over one table; every intermediate table is in the shared folder."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text", bits: int = 16):
        self.docs, self.k, self.num, self.den, self.key, self.text, self.bits = docs, k, num, den, key, text, bits
        self.bands = Bands(num, den)
        self.context = docs.sparkSession.sparkContext

    def _sets(self):
        k = self.k

        def sets(column):
            for row, offsets, data in bytescan.blocks(column, 2 << 20):
                yield row, bytescan.shingles(bytescan.words(offsets, data, bytescan.SPACED), k)

        return sets

    def described(self) -> DataFrame:
        """(key, n_shingles, node) of every row; node is null without shingles."""
        sets, key = self._sets(), self.key

        def describe(batches):
            for batch in batches:
                for row, found in sets(batch.column(1)):
                    yield pa.record_batch([batch.column(0).slice(row, len(found)), pa.array([len(s) for s in found], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in found], pa.int64())], [key, "n_shingles", "node"])

        return self.docs.select(self.key, self.text).mapInArrow(tidy(describe), f"{self.key} {self.docs.schema[self.key].dataType.simpleString()}, n_shingles long, node long")

    def _tiled(self, schema: str, emit) -> DataFrame:
        """What `emit` makes of (nodes, their tiles) for the texts of each block; copies within a task count once."""
        sets, bands = self._sets(), self.bands

        def each(batches):
            seen = set()
            for batch in batches:
                for _, found in sets(batch.column(0)):
                    fresh, nodes = [], []
                    for s in found:
                        if len(s) and (node := fingerprint(s)) not in seen:
                            seen.add(node)
                            fresh.append(s)
                            nodes.append(node)
                    columns = emit(np.array(nodes, np.int64), bands.tiles(fresh))
                    for i in range(0, len(columns[0]), 50_000):
                        yield pa.record_batch([pa.array(c[i : i + 50_000]) for c in columns], [f.split()[0] for f in schema.split(", ")])

        return self.docs.select(self.text).mapInArrow(tidy(each), schema)

    def frequencies(self) -> Frequencies:
        """From one pass over all texts; what the driver holds of it is bounded."""
        counted = stored(self._tiled("tile long", lambda _, t: [t.tile[t.filled]]).groupBy("tile").agg(F.count("*").alias("n")).where("n > 1"), "tiles")
        hot = counted.where(F.col("n") >= hottest(counted, HOT_TILES)).toArrow()
        repeated = member_bits(counted, "tile", filter_bits(counted.count()))
        drop(counted)
        return Frequencies(hot["tile"].to_numpy().astype(np.int64), hot["n"].to_numpy().astype(np.int64), repeated)

    def members(self) -> DataFrame:
        """(tile, node) of the tiles that sets keep and that more than one node may have."""
        shared = self.context.broadcast(self.frequencies())

        def emit(nodes: np.ndarray, tiled: Tiled):
            which, tile = tiled.kept(shared.value(tiled.tile))
            return [tile, nodes[which] if len(which) else np.zeros(0, np.int64)]

        return stored(self._tiled("tile long, node long", emit).distinct(), "members")

    def nodes(self, wanted: DataFrame) -> DataFrame:
        """(node, n_shingles, narrow, bitmap, shingles) of the wanted nodes (a table), one row each, from one pass over the texts."""
        sets, bits, shared = self._sets(), self.bits, self.context.broadcast(member_bits(wanted, "node", filter_bits(wanted.count())))

        def emit(batches):
            seen, wanted_bits = set(), shared.value
            for batch in batches:
                for _, found in sets(batch.column(0)):
                    keys = np.array([fingerprint(s) for s in found], np.int64)
                    out = []
                    for i in np.flatnonzero(has_bit(wanted_bits, keys)).tolist():
                        if len(found[i]) and keys[i] not in seen:
                            seen.add(keys[i])
                            out.append(i)
                    for i in range(0, len(out), 500):
                        some = [found[j] for j in out[i : i + 500]]
                        yield pa.record_batch({
                            "node": pa.array(keys[out[i : i + 500]]), "n_shingles": pa.array([len(s) for s in some], pa.int64()), "narrow": pa.array([bitmap(s, 2) for s in some], pa.binary()),
                            "bitmap": pa.array([bitmap(s, bits) for s in some], pa.binary()), "shingles": pa.array([s.view(np.int64) for s in some], pa.list_(pa.int64())),
                        })

        every = self.docs.select(self.text).mapInArrow(tidy(emit), "node long, n_shingles long, narrow binary, bitmap binary, shingles array<long>")
        return stored(every.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "nodes")

    def screened(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs (a, b) that sizes and narrow bitmaps leave."""
        num, den = self.num, self.den

        def screen(batches):
            for batch in batches:
                n = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3)]
                keep = np.minimum(*n) * den >= np.maximum(*n) * num
                maps = [batch.column(i).to_pylist() for i in (4, 5)]
                for i in np.flatnonzero(keep).tolist():
                    m = _folded([maps[0][i], maps[1][i]])
                    keep[i] = may_link(num, den, n[0][i], n[1][i], m[0], m[1])
                yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("narrow").alias(f"m_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "m_a", "m_b").mapInArrow(tidy(screen), "a long, b long")

    def verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that link, as a table: the exact intersection of their sorted arrays."""
        num, den = self.num, self.den

        def intersect(batches):
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                left, right = batch.column(2), batch.column(3)
                for i in range(batch.num_rows):
                    a, b = (x[i].values.to_numpy(zero_copy_only=False).view(U64) for x in (left, right))
                    if len(a) > len(b):
                        a, b = b, a
                    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    keep[i] = den * common >= num * (len(a) + len(b) - common)
                yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

        side = lambda x: nodes.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}"))
        return stored(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b").mapInArrow(tidy(intersect), "a long, b long"), "linked")

    def rest(self, members: DataFrame, nodes: DataFrame) -> DataFrame:
        """Pairs of different classes that bitmaps leave, of tiles compared block by block. members: (tile, node, root)."""
        num, den = self.num, self.den
        # tiles of the same members are one: told by their number and two sums of hashes
        sums = members.groupBy("tile").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(node))").alias("x"), F.expr("bit_xor(xxhash64(node, 1))").alias("y"))
        one = sums.groupBy("n", "x", "y").agg(F.min("tile").alias("tile")).select("tile", F.greatest(F.least(F.ceil(F.col("n") / SMALL_BLOCK), F.lit(16)), F.ceil(F.col("n") / BLOCK)).cast("int").alias("blocks"))
        placed = join_hot(members, one, "tile").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
        cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("tile", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")
        full = cells.join(nodes.select("node", "n_shingles", "bitmap"), "node").select("tile", "i", "j", "block", "node", "root", "n_shingles", "bitmap").repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j")

        def compare(group: pa.Table) -> pa.RecordBatch:
            across = group["i"][0].as_py() != group["j"][0].as_py()
            block, node, root, size = (group[c].to_numpy() for c in ("block", "node", "root", "n_shingles"))
            maps, a, b = _folded(group["bitmap"].to_pylist()), [], []
            for i in range(len(node) - 1):
                live = np.flatnonzero((root[i + 1 :] != root[i]) & ((block[i + 1 :] != block[i]) if across else True) & (np.minimum(size[i + 1 :], size[i]) * den >= np.maximum(size[i + 1 :], size[i]) * num)) + i + 1
                if len(live):
                    live = live[may_link(num, den, size[i], size[live], maps[i], maps[live])]
                    a.append(np.minimum(node[i], node[live]))
                    b.append(np.maximum(node[i], node[live]))
            return pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a, b)], ["a", "b"])

        def walk(batches):
            held = None  # the rows of the cell that the batches so far end in
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                if held is not None:
                    rows = pa.concat_tables([held, rows])
                cell = [rows[c].to_numpy() for c in ("tile", "i", "j")]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cell], axis=0)) + 1
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
                    if b - a > 1:
                        yield compare(rows.slice(a, b - a))
                held = rows.slice(int(ends[-1]) if len(ends) else 0)
            if held is not None and len(held) > 1:
                yield compare(held)

        return full.mapInArrow(tidy(walk), "a long, b long").distinct()

    def open_tiles(self, members: DataFrame, linked: DataFrame) -> DataFrame:
        """(tile, node, root) of the tiles, a table, whose members are not all of one class by the links found so far.

        Tiles of two members have been compared and are done.
        """
        of = components(linked)
        rooted = stored(members.join(of.withColumnRenamed("component", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        left = rooted.groupBy("tile").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max((F.col("node") != F.col("low")) & (F.col("node") != F.col("high"))).alias("more")).where("r < s AND more").select("tile", F.lit(True).alias("open"))
        out = stored(join_hot(rooted, left, "tile").select("tile", "node", "root"), "left")
        drop(rooted)
        return out

    def links(self, every: bool = False) -> DataFrame:
        """Links (a, b) between nodes, enough of them that their components are those of all links; or every link."""
        kept = self.members()
        shared = kept.groupBy("tile").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
        members = stored(join_hot(kept, shared, "tile"), "members")
        drop(kept)
        wanted = stored(members.select("node").distinct(), "wanted")
        nodes = self.nodes(wanted)
        drop(wanted)
        if every:
            # each node a class of its own: nothing is skipped
            pairs = stored(self.rest(members.select("tile", "node", F.col("node").alias("root")), nodes), "pairs")
            drop(members)
            found = self.verified(pairs, nodes)
            drop(pairs, nodes)
            return found
        stars = members.where("node <> low").select(F.col("low").alias("a"), F.col("node").alias("b")).unionAll(members.where("node <> high").select(F.col("node").alias("a"), F.col("high").alias("b"))).distinct()
        close = stored(self.screened(stars, nodes), "screened")
        first = self.verified(close, nodes)
        drop(close)
        open_tiles = self.open_tiles(members, first)
        for turn in range(TURNS):
            if open_tiles.isEmpty():
                break
            # a member drawn at random, another one for each tile: in a group of near copies it links with many that others don't
            hub = open_tiles.groupBy("tile").agg(F.min_by(F.struct("node", "root"), F.xxhash64("tile", "node", F.lit(turn))).alias("hub"))
            stars = join_hot(open_tiles, hub, "tile").where("root <> hub.root").select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
            close = stored(self.screened(stars, nodes), "screened")
            more = self.verified(close, nodes)
            drop(close, open_tiles)
            if more.isEmpty():
                open_tiles = self.open_tiles(members, first)
                break
            first = stored(first.unionAll(more), "linked")
            open_tiles = self.open_tiles(members, first)
        drop(members)
        pairs = stored(self.rest(open_tiles, nodes), "pairs")
        drop(open_tiles)
        every = first if pairs.isEmpty() else first.unionAll(self.verified(pairs, nodes))
        drop(pairs, nodes)
        return every


def classes(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text", bits: int = 16) -> DataFrame:
    """One row per row of `docs`: key, n_shingles, component_id (the smallest key that links reach, itself included).

    bits: of the wide bitmaps, for each shingle; more let fewer pairs through to the arrays, fewer are less to shuffle.
    """
    named_apart(key, ["n_shingles", "component_id"])
    given, key = key, "own_key"
    join = ShingleJoin(docs.select(F.col(given).alias(key), F.col(text).alias("own_text")), k, num, den, key, "own_text", bits)
    described = stored(join.described(), "described")
    of = components(join.links())
    members = described.where("node IS NOT NULL").groupBy("node").agg(F.min(key).alias("least"))
    rooted = stored(members.join(of, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component")), "rooted")
    # the smallest key of each component, then of each node
    smallest = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    least = stored(join_hot(rooted, smallest, "component").select("node", "component_id"), "classes")
    drop(rooted)
    return join_hot(described, least, "node", "left").select(F.col(key).alias(given), "n_shingles", F.when(F.col("node").isNull(), F.col(key)).otherwise(F.col("component_id")).alias("component_id"))


def link_counts(docs: DataFrame, k: int, num: int, den: int, key: str = "doc_id", text: str = "text", bits: int = 16) -> DataFrame:
    """One row per row of `docs`: key, and n_links, the number of other rows that it links with, its exact copies among them."""
    named_apart(key, ["n_links"])
    given, key = key, "own_key"
    join = ShingleJoin(docs.select(F.col(given).alias(key), F.col(text).alias("own_text")), k, num, den, key, "own_text", bits)
    described = stored(join.described(), "described")
    links = join.links(every=True)
    copies = described.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("a").alias("of"), F.col("b").alias("node")).unionAll(links.select(F.col("b").alias("of"), F.col("a").alias("node")))
    near = ends.join(copies, "node").groupBy("of").agg(F.sum("copies").alias("near")).withColumnRenamed("of", "node")
    counts = stored(copies.join(near, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0).cast("long"))).alias("n_links")), "counts")
    return join_hot(described, counts, "node", "left").select(F.col(key).alias(given), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text", bits: int = 8) -> DataFrame:
    """The rows of `docs` of which each class keeps the one of the smallest key (of equal keys, the first row).

    A null key comes last; columns of any names go through as they are.
    """
    row = fresh_name(docs.columns, "_row")
    numbered = stored(docs.withColumn(row, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"))), "numbered")
    found = classes(numbered.select(F.col(row).alias("row"), F.col(text).alias("text")), k, num, den, key="row", text="text", bits=bits)
    first = found.where(F.col("row") == F.col("component_id")).select(F.col("row.row").alias("_keep"))
    return numbered.join(first, F.col(f"{row}.row") == F.col("_keep"), "left_semi").drop(row)
