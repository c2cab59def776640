"""Near-duplicate detection: SimHash fingerprints searched with sharded BK-trees.

A BK-tree hangs each fingerprint under its parent by their Hamming distance; a search of radius r
at distance d from a node follows only the edges d-r to d+r. Fingerprints within r bits agree on at
least `blocks - r` of `blocks` bit blocks (pigeonhole), so each combination of agreeing blocks and
their value is a shard with a tree of its own, and no pair is lost. Shards above `shard_rows` are
cut into tiles, one part's tree against another part's fingerprints, so that a task never holds
more than two parts however large a group of near copies is. A task returns, for each fingerprint,
one link to its local component instead of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest, xxh64_digest

from .blocks import mix
from .components import components
from .scratch import Scratch
from .text import pick, pieces, text_bytes

PIECE_BYTES = 1_000_000
#: Bytes of a text that are split into words together.
PART_BYTES = 500_000
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SHARD_ROWS = 8192
#: Bytes of tiles that a task takes together, and shingles in a part of a shard.
TILE_BYTES, PART_SHINGLES = 8_000_000, 4_000_000
#: Pairs of a query and a tree node that are looked at together.
FRONTIER = 2_000_000


def shingle_digests(text: bytes | None, size: int, seed: int) -> Iterator[bytes]:
    """XXH64 digests of the shingles of lowered words, those of a part of the text joined at a time.

    A text of fewer words is one shingle, an empty one none. Parts end at white space and the last
    words of one go on to the next, so a long text costs no more memory at once than a part.
    """
    words, at, fewer = [], 0, True
    while text and at < len(text):
        cut = SPACE.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()
        at = end
        if len(words) >= size:
            yield b"".join(xxh64_digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))
            words, fewer = words[len(words) - size + 1 :], False
    if words and fewer:
        yield xxh64_digest(b" ".join(words), seed)


def fingerprints(texts: list[bytes | None], size: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint for each text: a bit is set if it is in over half of the shingles' hashes."""
    return _majority(shingle_digests(t, size, seed) for t in texts)


def set_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """As fingerprints, from sets of distinct shingle hashes: what a text repeats counts once."""
    return _majority((s[k : k + PART_BYTES // 2].astype(">u8").tobytes() for k in range(0, len(s), PART_BYTES // 2)) for s in sets)


def _majority(texts: Iterable[Iterable[bytes]]) -> np.ndarray:
    """For each text, its 8-byte hashes in parts, the bits that are set in over half of them."""
    n, ones = [], []
    held, owner, size = [], [], 0

    def count() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
        starts = np.cumsum([0, *(len(p) // 8 for p in held[:-1])])
        for k, sums in zip(owner, np.add.reduceat(bits, starts, axis=0, dtype=np.uint32), strict=True):
            ones[k] += sums

    for k, parts in enumerate(texts):
        n.append(0)
        ones.append(np.zeros(64, np.int64))
        for part in parts:
            held.append(part)
            owner.append(k)
            n[k] += len(part) // 8
            size += len(part)
            if size >= 4 * PART_BYTES:
                count()
                held, owner, size = [], [], 0
    if held:
        count()
    if not n:
        return np.zeros(0, np.uint64)
    return np.packbits(2 * np.stack(ones) > np.array(n)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for docs with columns doc_id and text; fp holds the 64 bits as a signed long.

    Null and empty texts have no words and the fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                fp = fingerprints(part.column(1).cast(pa.binary()).to_pylist(), size, seed)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class BKForest:
    """BK-trees of many shards, built and searched level by level in flat arrays."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray) -> None:
        """fp: distinct within a shard; shard: ascending."""
        n = len(fp)
        self.fp = fp
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, n]))
        items = np.flatnonzero(self.root != np.arange(n))
        at, keys, nodes = self.root[items], [], []
        while items.size:
            edge = at * 65 + np.bitwise_count(fp[items] ^ fp[at])
            key, where, which = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(key)
            nodes.append(items[where])
            at = items[where][which]
            rest = at != items
            items, at = items[rest], at[rest]
        self.edge = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.child = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
        order = np.argsort(self.edge)
        self.edge, self.child = self.edge[order], self.child[order]

    def search(self, query: np.ndarray, root: np.ndarray, radius: np.ndarray | int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index of the query, node) within the radius, level by level; a query may have its own radius."""
        q, node = np.arange(len(query)), root
        within = np.broadcast_to(np.asarray(radius, np.int64), len(query))
        while q.size:
            d = np.bitwise_count(query[q] ^ self.fp[node]).astype(np.int64)
            r = within[q]
            near = d <= r
            yield q[near], node[near]
            low = np.searchsorted(self.edge, node * 65 + np.maximum(d - r, 0), "left")
            n = np.searchsorted(self.edge, node * 65 + np.minimum(d + r, 64), "right") - low
            pos = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            q, node = np.repeat(q, n), self.child[pos]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels of linked places equal to their least one."""
    while a.size:
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]


def _search_tiles(fp: np.ndarray, tile: np.ndarray, probe: np.ndarray, radius: np.ndarray | int, link: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Give `link` the places of all pairs of rows of a tile within the radius, some at a time."""
    if len(fp) < 2:
        return
    build = np.flatnonzero(~probe)
    forest = BKForest(fp[build], tile[build])
    new = np.r_[True, tile[1:] != tile[:-1]]
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    probed = np.add.reduceat(probe.astype(np.int64), starts)
    size = np.add.reduceat((~probe).astype(np.int64), starts)
    root_of = np.full(len(starts), -1)
    root_of[group[build]] = forest.root
    ask = np.flatnonzero((probe | (probed[group] == 0)) & (root_of[group] >= 0))
    work = np.cumsum(size[group[ask]])
    cuts = np.searchsorted(work, np.arange(FRONTIER, work[-1] + FRONTIER, FRONTIER), "left") + 1 if ask.size else []
    at = 0
    radius = np.broadcast_to(np.asarray(radius, np.int64), len(fp))
    for cut in cuts:
        some, at = ask[at:cut], max(at, int(cut))
        if some.size:
            for q, node in forest.search(fp[some], root_of[group[some]], radius[some]):
                a, b = some[q], build[node]
                other = a != b
                link(a[other], b[other])


def tile_links(fp: np.ndarray, tile: np.ndarray, probe: np.ndarray, radius: int) -> np.ndarray:
    """For each row the place of the least row of its component in its tile.

    tile is ascending; probe marks rows that only search; in a tile without such rows each row
    both stands in the tree and searches.
    """
    label = np.arange(len(fp))
    _search_tiles(fp, tile, probe, radius, lambda a, b: _merge(label, a, b))
    return label


TILE = ("key", "i", "j")


def _tile_starts(t: pa.Table, tile: tuple[str, ...] = TILE) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in tile:
        x = t.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return new


def _whole_tiles(batches: Iterator[pa.RecordBatch], most: int, link: Callable[[pa.Table], pa.RecordBatch], tile: tuple[str, ...] = TILE) -> Iterator[pa.RecordBatch]:
    """Apply link to tables of whole tiles; rows come ordered by the tile's columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= most or sum(b.nbytes for b in held) >= TILE_BYTES:
            t = pa.Table.from_batches(held)
            cut = int(np.flatnonzero(_tile_starts(t, tile))[-1])
            if cut:
                yield link(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held:
        yield link(pa.Table.from_batches(held))


def _tiled(keyed: DataFrame, shard_rows: int, carry: tuple[str, ...] = (), weight: Column | None = None, most: int = 1) -> DataFrame:
    """Rows (key, fp, rep, carry) of shards with two rows at least, dealt to tiles (key, i, j) of at most two parts.

    A part has about shard_rows rows, and about `most` of their summed weight if they have one.
    """
    full = keyed.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.lit(0) if weight is None else weight).alias("weight"))
    keyed = keyed.join(full.where("rows > 1"), "key")
    parts = F.greatest(F.ceil(F.col("rows") / F.lit(shard_rows)), F.ceil(F.col("weight") / F.lit(most))).cast("int")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    tiles = keyed.select("key", "fp", "rep", *carry, part.alias("p"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
    return tiles.select("key", F.least("p", "o").alias("i"), F.greatest("p", "o").alias("j"), (F.col("p") > F.col("o")).alias("probe"), "fp", "rep", *carry)


def near_links(nodes: DataFrame, radius: int = 3, blocks: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) that connect the reps of all fingerprints within `radius` bits of each other.

    nodes: (fp, rep), fp distinct. blocks: bit blocks of the pigeonhole, more than radius.
    """
    ends = [round(64 * k / blocks) for k in range(blocks + 1)]
    masks = []
    for pickd in combinations(range(blocks), blocks - radius):
        m = sum(((1 << (ends[k + 1] - ends[k])) - 1) << ends[k] for k in pickd)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = nodes.select("fp", "rep", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("t", "mask"))
    keyed = keyed.select("fp", "rep", F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    tiles = _tiled(keyed, shard_rows).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def link(t: pa.Table) -> pa.RecordBatch:
        label = tile_links(t.column("fp").to_numpy().view(np.uint64), np.cumsum(_tile_starts(t)), t.column("probe").to_numpy().astype(bool), radius)
        linked = label != np.arange(len(label))
        rep = t.column("rep").combine_chunks()
        return pa.RecordBatch.from_arrays([rep.filter(pa.array(linked)), rep.take(pa.array(label[linked]))], ["a", "b"])

    kind = nodes.schema["rep"].dataType.simpleString()
    return tiles.mapInArrow(lambda b: _whole_tiles(b, 4 * SHARD_ROWS, link), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3, blocks: int = 4, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id).

    Fingerprints of `size`-word shingles link at `radius` or fewer differing bits; component_id is
    the least doc_id that links reach, itself included. Rows with equal texts have equal
    fingerprints and so one component; null and empty texts have the fingerprint zero, linked like
    any other. Repeated doc_ids give a row each. A null doc_id can't name a component: its row
    takes part, and gets null where no row with an id has a linked fingerprint. Other columns of
    docs are left out, whatever their names. Very long texts count whole, read a part at a time. Exact copies
    are collapsed by a partial aggregate before anything else is shuffled.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.write(simhash(pick(docs, doc_id=id_col, text=text_col), size, seed), "fingerprints")
    nodes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = scratch.write(nodes, "nodes")
    found = components(near_links(nodes, radius, blocks, shard_rows), scratch)
    named = nodes.join(found, nodes.rep == found.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Differing bits within which pairs of the wanted similarity lie, by the size of the larger set: at a
#: similarity of 0.8 large sets differ in 9.7 bits with a deviation of 2.9, sets of a few dozen scatter more.
RADII = ((24, 64), (100, 26), (None, 22))
SEEDS = 6
#: Rows that may be sent to every executor in place of a shuffle of texts.
BROADCAST_ROWS = 100_000


def radius_of(n: np.ndarray) -> np.ndarray:
    """The search radius of sets of n shingles."""
    out = np.full(len(n), RADII[-1][1], np.int64)
    for most, r in reversed(RADII[:-1]):
        out[n <= most] = r
    return out


def _shingles(text: bytes | None, size: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, ascending."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(text, size, 0)), ">u8").astype(np.uint64))


def _least(s: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The least hash of a set under each salt, for a part of the set at a time."""
    cuts = range(0, len(s), PART_BYTES // 2)
    return np.min([mix(s[None, k : k + PART_BYTES // 2] * salts[:, None]).min(axis=1) for k in cuts], axis=0)


def odd_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """2048 parities of each set; two sketches differ in no more bits than the sets in elements."""
    rows = [np.packbits((np.bincount((x & x.dtype.type(2047)).astype(np.int64), minlength=2048) & 1).astype(np.uint8)) for x in sets]
    return np.stack(rows).view(np.uint64) if rows else np.zeros((0, 32), np.uint64)


def similar_pairs_links(fp: np.ndarray, tile: np.ndarray, probe: np.ndarray, up: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """As tile_links from given labels, where a link also needs sets of at least that Jaccard similarity.

    Pairs that are connected already are not verified again, nor are pairs of which both are `up`.
    """
    label = label.copy()
    size = np.array([len(x) for x in sets], np.int64)
    odd = odd_sketches(sets)

    def verified(a: np.ndarray, b: np.ndarray) -> None:
        for at in range(0, len(a), 20_000):
            x, y = a[at : at + 20_000], b[at : at + 20_000]
            far = (label[x] != label[y]) & ~(up[x] & up[y])
            x, y = x[far], y[far]
            # J >= s means a symmetric difference of at most (1-s)/(1+s) of both sizes
            apart = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)
            may = apart * (1 + similarity) <= (1 - similarity) * (size[x] + size[y]) + 1e-9
            x, y = x[may], y[may]
            for k in range(0, len(x), 200):
                u, v = x[k : k + 200], y[k : k + 200]
                far = label[u] != label[v]
                good = []
                for i, j in zip(u[far].tolist(), v[far].tolist(), strict=True):
                    both = len(sets[i]) + len(sets[j])
                    common = both - len(np.union1d(sets[i], sets[j]))
                    if common >= similarity * (both - common):
                        good.append((i, j))
                if good:
                    pairs = np.array(good)
                    _merge(label, pairs[:, 0], pairs[:, 1])

    _search_tiles(fp, tile, probe, radius_of(size), verified)
    return label


def _candidates(t: pa.Table) -> pa.RecordBatch:
    """Rows of tiles that have another row within the radius, with the least such row that they reach."""
    fp, probe, up = t.column("fp").to_numpy().view(np.uint64), t.column("probe").to_numpy().astype(bool), t.column("up").to_numpy().astype(bool)
    label, found = np.arange(len(fp)), np.zeros(len(fp), bool)

    def near(a: np.ndarray, b: np.ndarray) -> None:
        one = ~(up[a] & up[b])
        a, b = a[one], b[one]
        found[a] = found[b] = True
        _merge(label, a, b)

    _search_tiles(fp, np.cumsum(_tile_starts(t)), probe, radius_of(t.column("n").to_numpy()), near)
    names = ["key", "i", "j", "k", "probe", "up", "fp", "rep"]
    kept = t.filter(pa.array(found)).combine_chunks()
    group = t.column("rep").combine_chunks().take(pa.array(label[found]))
    return pa.RecordBatch.from_arrays([*(kept.column(c).combine_chunks() for c in names), group], [*names, "near"])


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS, shard_rows: int = SHARD_ROWS // 8, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of docs: (doc_id, fingerprint, component_id), linked by similarity of shingles.

    Documents link if the Jaccard similarity of their sets of `size`-word shingles is at least
    `similarity`; it is verified on the whole sets of 64-bit hashes. A shard holds documents that
    have the same least shingle under one of `seeds` hash functions and sizes that can reach the
    similarity. BK-trees of SimHash fingerprints find the candidates of a shard, on rows without
    sets; only documents with a candidate have their sets made. Sets go to groups of candidates in
    waves: first each part of a shard by itself under the first function, then the parts of a shard
    with its first part, then what is left; a wave skips the groups that the waves before it have
    already connected, so that a group of near copies is sent about once and not once for each
    function and tile.

    A pair of just the wanted similarity s shares no shard with probability (1-s)^seeds, and lies
    outside the radius (`RADII`) in about one of 100,000 cases; the more similar, the less. Equal
    sets are one node and always linked; null and empty texts have the empty set. Very long texts
    are taken whole. The fingerprint is that of the set, so repeated passages move it no further
    than they move the similarity. Ids may repeat, with equal or other texts; a null id takes part
    but can't name a component. Other columns are left out.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    docs = pick(docs, doc_id=id_col, text=text_col).withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text")})
    kind = docs.schema["doc_id"].dataType.simpleString()
    salts = np.array([int.from_bytes(xxh64_digest(str(k).encode())) | 1 for k in range(seeds)], np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                texts = part.column(1).cast(pa.binary()).to_pylist()
                sets = [_shingles(t, size) for t in texts]
                least = [_least(s, salts).view(np.int64).tolist() if len(s) else [] for s in sets]
                names = ["doc_id", "t1", "t2", "fp", "sig", "n", "least"]
                cols = [part.column(0), part.column(2), part.column(3), pa.array(set_fingerprints(sets).view(np.int64)), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    signed = scratch.write(docs.mapInArrow(sign, f"doc_id {kind}, t1 long, t2 int, fp long, sig binary, n long, least array<long>"), "signed")
    nodes = signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "t1", "t2")).alias("text"), F.min(F.struct("fp", "n", "least")).alias("s")).select("sig", "rep", "text", "s.*")
    nodes = scratch.write(nodes, "nodes")
    keyed = nodes.select("sig", "fp", "n", F.posexplode("least").alias("k", "h"))
    level = F.floor(F.log("n") / F.lit(-np.log(similarity))) if similarity < 1 else F.col("n")
    keyed = keyed.select("sig", "fp", "n", "k", "h", level.alias("base"), F.explode(F.array(level, level + 1)).alias("level"))
    keyed = keyed.select(F.col("sig").alias("rep"), "fp", "n", F.col("k").cast("byte").alias("k"), (F.col("level") > F.col("base")).alias("up"), F.xxhash64("k", "h", "level").alias("key"))
    tiles = _tiled(keyed, shard_rows, ("n", "k", "up"), F.col("n"), PART_SHINGLES).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = tiles.mapInArrow(lambda b: _whole_tiles(b, 4 * SHARD_ROWS, _candidates), "key long, i int, j int, k byte, probe boolean, up boolean, fp long, rep binary, near binary")
    found = scratch.write(found.withColumn("group", F.xxhash64("key", "i", "j", "near")).drop("key", "near"), "candidates")
    wanted = scratch.write(nodes.join(found.select(F.col("rep").alias("sig")).distinct(), "sig").select("sig", "text"), "wanted")

    def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text_bytes(batch.column(1)), PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_shingles(t, size).astype("<u8").tobytes() for t in part.column(1).cast(pa.binary()).to_pylist()], pa.binary())], ["sig", "body"])

    small = wanted.count() <= broadcast_rows
    same = docs.doc_id.eqNullSafe(F.col("w.text.doc_id")) & (docs.t1 == F.col("w.text.t1")) & (docs.t2 == F.col("w.text.t2"))
    sets = docs.join((F.broadcast(wanted) if small else wanted).alias("w"), same).select("w.sig", docs.text).mapInArrow(shingle_sets, "sig binary, body binary")
    sets = scratch.write(sets, "sets")
    labels = None

    def link(t: pa.Table) -> pa.RecordBatch:
        body = [np.frombuffer(x, "<u8") for x in t.column("body").to_pylist()]
        code = t.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        start = np.unique(code, return_index=True)[1][code]
        column = lambda c: t.column(c).to_numpy()
        label = similar_pairs_links(column("fp").view(np.uint64), np.cumsum(_tile_starts(t, ("group",))), column("probe").astype(bool), column("up").astype(bool), start, body, similarity)
        linked = label != start
        rep = t.column("rep").combine_chunks()
        return pa.RecordBatch.from_arrays([rep.filter(pa.array(linked)), rep.take(pa.array(label[linked]))], ["a", "b"])

    for wave, of in enumerate(("k = 0 and i = j", "k = 0 and i = 0 and j > 0", "k > 0 or i > 0 and j > i")):
        rows = found.where(of)
        rows = rows.withColumn("label", F.col("rep")) if labels is None else rows.join(labels, rows.rep == labels.node, "left").withColumn("label", F.coalesce("root", "rep")).drop("node", "root")
        rows = scratch.write(rows, f"rows{wave}")
        open_ = rows.groupBy("group").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("group")
        filled = rows.join(open_, "group", "left_semi").join(sets, rows.rep == sets.sig).select("group", "probe", "up", "fp", "rep", "label", "body")
        filled = filled.repartition("group").sortWithinPartitions("group")
        links = scratch.write(filled.mapInArrow(lambda b: _whole_tiles(b, SHARD_ROWS // 2, link, ("group",)), "a binary, b binary"), f"links{wave}")
        if labels is not None:
            links = links.union(labels.select(F.col("node").alias("a"), F.col("root").alias("b")))
        labels = components(links, scratch, f"wave{wave}")
    rooted = scratch.write(nodes.join(labels, nodes.sig == labels.node, "left").select("sig", "rep", F.coalesce("root", "sig").alias("root")), "rooted")
    for name in ("candidates", "sets", "wanted", "rows0", "rows1", "rows2"):
        scratch.drop(name)
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("sig", "component_id")
    return signed.join(named, "sig", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
