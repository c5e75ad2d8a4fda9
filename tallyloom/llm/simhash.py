"""SimHash near-duplicates through forests of vantage-point trees over Hamming space.

A fingerprint is a majority vote, bit by bit, over the hashes of a text's word
shingles: 64 bits, or more 64-bit words of them. Two texts are linked when their
fingerprints differ in at most `radius` bits, and linked texts form groups.

A tree divides the fingerprints by their Hamming distance, on the bits of the
tree, to a vantage point (inside: d <= r, outside: d > r). The triangle bound
|d(x, v) - d(y, v)| <= d(x, y) tells which branches can hold a partner: two
fingerprints that agree on the tree's bits are on the same side at every node, so
one leaf (a shard) holds both and every other branch is pruned. Vantage points and
bits are pseudo-random functions of the node, so a tree needs no fitted state, no
sample and no broadcast, and a rerun of a lost task routes alike.

Within a shard the pairs are found exactly by another vantage-point tree, over
the full distance, whose two sides are compared only along the boundary: inside
points with d > r - radius against outside points with d <= r + radius.

Two forests:

* `near_links`, exact. 64 bits are cut into blocks; by the pigeonhole principle two
  fingerprints within the radius agree on at least one choice of
  `blocks - radius` blocks, and there is a tree for each choice. Blocks grow with
  the count of distinct fingerprints (5: 13 bits and 5 trees; 8: 32 bits and 70).
* `wide_links`, for a radius that no choice of blocks survives, as a similarity of
  0.8 needs (about 40 of 256 bits differ). There the triangle bound prunes nothing
  either: distances to any vantage point lie within 8 bits of 128, so every branch
  overlaps a boundary 57 bits wide. A tree has `depth` random bits instead, a
  level for each; so many trees are grown that a pair at the very radius shares a
  shard of one of them with a chance of `recall` (nearer pairs are all but certain
  to). A few trees go first; what they join is told to the others, which report
  new joins only.

Where a similarity is asked for (`similar_groups`), links of the wide forest make
candidate groups only. The sets of shingles of a group's members are brought
together, and every pair of the group, found by the wide forest or not, is linked
if its exact resemblance is high enough: an inverted index over the sets counts
what each shares with all others.

Scale. Each distinct fingerprint goes to one shard of each tree: narrow rows, no
texts. Depth grows with the count, so that shards stay small. A shard with more
than `tile` members (a near-copy group) is cut into tiles, and each pair of tiles
is a task's unit, so no task holds more than two tiles; candidate groups are cut
likewise, by members and by shingles. A unit reports a spanning forest of its
links rather than all pairs, which keeps the groups whole and the output linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, fresh, in_batches, pick, rows, stored
from .components import connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 32_768
SHARD = 128
#: Members of a leaf that are compared with one another: of a tree that prunes, and of one at a wide radius, which doesn't.
LEAF, WIDE_LEAF = 64, 512
SMALL = 48
#: Shingles of five words and a similarity of 0.8: such a pair differs in 39 of 256 bits on average, give or take 6, and most
#: differ in 48 at most; unlike texts differ in about 128.
WIDE_SHINGLE, WIDE_WORDS, WIDE_RADIUS, RECALL, FIRST_TREES = 5, 4, 48, 0.95, 8
#: Two texts are near duplicates from this share of common distinct shingles on. Candidates differ in CANDIDATE_RADIUS bits at most
#: (sets of few shingles need more than others), and trees are counted for pairs that differ in CANDIDATE_REACH (39 plus three times 6).
SIMILARITY, CANDIDATE_RADIUS, CANDIDATE_REACH = 0.8, 64, 57
#: Members and shingles of a tile of a candidate group, and rows of ids that may be broadcast.
GROUP_TILE, GROUP_SHINGLES, BROADCAST_KEYS = 1024, 1 << 19, 500_000


def words_of(text: str | None, shingle: int = SHINGLE_WORDS, width: int = 1) -> np.ndarray:
    """The fingerprint of one text as `width` 64-bit words; null and wordless texts give 0.

    One word counts repeated shingles as often as they are there; more words count each once, as a resemblance of sets does.
    """
    hashes = shingles_of(text, shingle)
    return _votes(np.unique(hashes) if width > 1 else hashes, width)


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each shingle in turn; a text of fewer words is one shingle, a wordless one has none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def _votes(hashes: np.ndarray, width: int) -> np.ndarray:
    if not len(hashes):
        return np.zeros(width, np.uint64)
    n, ones = len(hashes), np.zeros(64 * width, np.int64)
    salt = np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, n, 16_384):
        h = hashes[at : at + 16_384]
        # The first word votes on the hashes themselves, each further one on another mixture of them.
        each = np.column_stack([h, *[_mix(h ^ s) for s in salt[1:]]])
        ones += np.unpackbits(each.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    return int(words_of(text, shingle)[0])


def _columns(width: int) -> list[str]:
    return [f"w{i}" for i in range(width)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, width: int = 1) -> DataFrame:
    """(doc_id, w0, ...) with the fingerprint's words as signed longs; one row per input row."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in _columns(width)]])
        yield from in_batches(schema, ((d, *words_of(t, shingle, width).view(np.int64).tolist()) for d, t in rows(batches, "doc_id", "text")), 20_000)

    slim = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return slim.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _columns(width)))


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into so that a shard of n distinct fingerprints stays small."""
    for extra in (1, 2, 3):
        bits = 64 * extra // (radius + extra)
        if n <= SHARD * 2 ** (bits + 4):
            return radius + extra
    return radius + 4


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One bit mask for each choice of blocks that a pair within the radius may share."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: pseudo-random vantage points from node numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def route(fps: np.ndarray, mask: int, depth: int) -> np.ndarray:
    """The leaf of the mask's vantage-point tree that holds each fingerprint."""
    m, node = np.uint64(mask), np.ones(len(fps), np.uint64)
    width = int(mask).bit_count()
    for _ in range(depth):
        vantage = _mix(node ^ m)
        # An even width has a middle distance; the node's number decides its side so that halves stay even.
        edge = (width - 1) // 2 + (0 if width % 2 else (vantage >> np.uint64(63)).astype(np.int64))
        node = node * np.uint64(2) + (np.bitwise_count((fps ^ vantage) & m) > edge)
    return node


class _Forest:
    """Union-find over positions; add() tells if a link joined two trees."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints, by broadcasting; the last axis holds a fingerprint's words."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for k in range(1, a.shape[-1]):
        out += np.bitwise_count(a[..., k] ^ b[..., k])
    return out


def _cross(fps: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int, forest: _Forest) -> Iterator[tuple[int, int]]:
    """Links between two index sets, reduced to those that join trees of the forest."""
    for i in range(0, len(left), 1024):
        for j in range(0, len(right), 1024):
            a, b = left[i : i + 1024], right[j : j + 1024]
            near = _apart(fps[a][:, None], fps[b][None, :]) <= radius
            for x in np.flatnonzero(near.any(axis=1)).tolist():
                cols = np.flatnonzero(near[x])
                for t in b[cols].tolist():
                    if t != a[x] and forest.add(int(a[x]), t):
                        yield int(a[x]), t
                if len(cols) > 64:
                    # These hang together through x now, so one link from each later row into them is enough.
                    rest = near[x + 1 :, cols]
                    for r in np.flatnonzero(rest.any(axis=1)).tolist():
                        u, t = int(a[x + 1 + r]), int(b[cols[int(rest[r].argmax())]])
                        if t != u and forest.add(u, t):
                            yield u, t
                    near[x + 1 :, cols] = False


def local_links(fps: np.ndarray, radius: int = RADIUS, leaf: int = LEAF, labels: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among fps (uint64; n, or n by words), as pairs of positions; those of equal label count as linked already."""
    fps = fps.reshape(len(fps), -1)
    forest, todo = _Forest(len(fps)), [np.arange(len(fps))]
    if labels is not None:
        _, first, own = np.unique(labels, return_index=True, return_inverse=True)
        for x, y in enumerate(first[own].tolist()):
            forest.add(x, y)
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield from _cross(fps, at, at, radius, forest)
            continue
        d = _apart(fps[at], fps[at[0]])
        r = int(np.median(d))
        if not (d > r).any():
            r -= 1
        inside, outside = at[d <= r], at[d > r]
        if not len(inside) or not len(outside):
            yield from _cross(fps, at, at, radius, forest)
            continue
        # Partners on the two sides are both near the boundary, by the triangle bound.
        yield from _cross(fps, at[(d <= r) & (d > r - radius)], at[(d > r) & (d <= r + radius)], radius, forest)
        todo += [inside, outside]


def _in_small_groups(fps: np.ndarray, group: np.ndarray, labels: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """All links between different labels inside groups of SMALL members at most; groups lie together."""
    for lag in range(1, SMALL):
        x = np.flatnonzero((group[:-lag] == group[lag:]) & (labels[:-lag] != labels[lag:]))
        if not len(x):
            if not (group[:-lag] == group[lag:]).any():
                return
            continue
        x = x[_apart(fps[x], fps[x + lag]) <= radius]
        yield from zip(x.tolist(), (x + lag).tolist(), strict=True)


def _streamed(batches, keys: list[str], columns: list[str]) -> Iterator[list]:
    """Arrays (or Arrow columns, of lists) of whole groups of rows that are sorted by the keys, a batch or more at a time; the keys first, as one matrix."""
    import pyarrow as pa

    held: list[list] = []

    def joined(parts: list[list]) -> list:
        return [np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(*parts, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        of = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        plain = lambda c: of(c) if pa.types.is_list(of(c).type) else of(c).to_numpy(zero_copy_only=False).astype(np.int64)
        key = np.column_stack([plain(k) for k in keys])
        row = [key, *map(plain, columns)]
        # The last group may go on in the next batch.
        cut = int(np.flatnonzero((key != key[-1]).any(axis=1)).max(initial=-1)) + 1
        if not cut and held and (held[-1][0][-1] == key[0]).all():
            held.append(row)
            continue
        if whole := held + ([[x[:cut] for x in row]] if cut else []):
            yield joined(whole)
        held = [[x[cut:] for x in row]]
    if held:
        yield joined(held)


def _starts(key: np.ndarray) -> np.ndarray:
    """Where the groups of a sorted matrix of keys start, and its end."""
    return np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))), len(key))


def _cells(rows: DataFrame, tiles: Column, own: Column, keep: list[str]) -> DataFrame:
    """rows for each pair (i, j) of tiles that has their own tile, with columns i, j and own."""
    cell = lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"))
    each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), cell)
    return rows.withColumn("tiles", F.coalesce(tiles, F.lit(1))).withColumn("own", F.pmod(own, F.col("tiles")).cast("int")).withColumn("cell", F.explode(each)).select("cell.i", "cell.j", "own", *keep)


def _search(routed: DataFrame, radius: int, width: int, tile: int) -> DataFrame:
    """Links (a, b) between labels, from routed(tree, leaf, label, w0, ...): in each shard, a spanning forest of what is within the radius."""
    words = _columns(width)
    sizes = stored(routed.groupBy("tree", "leaf").count().where(F.col("count") > tile), "shard-sizes")
    if sizes.take(1):
        large = routed.join(sizes.select("tree", "leaf", F.ceil(F.col("count") / F.lit(tile // 2)).cast("int").alias("tiles")), ["tree", "leaf"], "left")
        routed = _cells(large, F.col("tiles"), F.xxhash64(*words, F.lit(7)), ["tree", "leaf", "label", *words])
    else:
        routed = routed.select("tree", "leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "label", *words)
    keys = ["tree", "leaf", "i", "j"]

    def search(batches):
        import pyarrow as pa

        def links(key: np.ndarray, labels: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
            """Labels of links of whole groups: small ones together, large ones each by its own tree."""
            cuts = _starts(key)
            size = np.diff(cuts)
            group = np.repeat(np.arange(len(size)), size)
            small = np.flatnonzero(np.repeat(size <= SMALL, size))
            for x, y in _in_small_groups(fps[small], group[small], labels[small], radius):
                yield int(labels[small[x]]), int(labels[small[y]])
            for g in np.flatnonzero(size > SMALL).tolist():
                own = labels[cuts[g] : cuts[g + 1]]
                if (own != own[0]).any():
                    for x, y in local_links(fps[cuts[g] : cuts[g + 1]], radius, LEAF if width == 1 else WIDE_LEAF, own):
                        yield int(own[x]), int(own[y])

        def joins(pairs: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
            """Without links between labels that this task has joined before; it remembers linked labels only."""
            up: dict[int, int] = {}

            def find(x: int) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = up[y]
                    x = y
                return x

            for a, b in pairs:
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
                    yield a, b

        found = (pair for key, labels, *fps in _streamed(batches, keys, ["label", *words]) for pair in links(key, labels, np.column_stack(fps).view(np.uint64)))
        yield from in_batches(pa.schema([("a", pa.int64()), ("b", pa.int64())]), joins(found), 20_000)

    return routed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "a long, b long")


def _route(uniq: DataFrame, width: int, leaves) -> DataFrame:
    """routed(tree, leaf, label, w0, ...) of uniq(label, w0, ...); leaves(fps) yields (tree, leaf of each fingerprint)."""
    words = _columns(width)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            label, *fps = [batch.column(i) for i in range(batch.num_columns)]
            bits = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in fps]).view(np.uint64)
            for tree, leaf in leaves(bits):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), tree, np.int32)), pa.array(leaf), label, *fps], ["tree", "leaf", "label", *words])

    return uniq.select("label", *words).mapInArrow(run, "tree int, leaf long, label long, " + ", ".join(f"{c} long" for c in words))


def near_links(uniq: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the labels of distinct 64-bit fingerprints uniq(label, w0); their components are those of all links."""
    choices = masks(blocks_for(n, radius), radius)
    depth = max(0, math.ceil(math.log2(max(1, n) / SHARD)))

    def leaves(fps):
        for k, mask in enumerate(choices):
            yield k, route(fps[:, 0], mask, depth).view(np.int64)

    return _search(_route(uniq, 1, leaves), radius, 1, tile)


def wide_depth(n: int) -> int:
    """Bits of a tree of the wide forest, so that a shard of n distinct fingerprints stays small.

    Deeper trees make smaller shards but ask for more trees (wide_trees): 101 up to 67 million fingerprints at a reach of 57 bits, 971 for 30 billion.
    """
    return max(14, math.ceil(math.log2(max(1, n) / 4096)))


def wide_trees(n: int, radius: int = WIDE_RADIUS, width: int = WIDE_WORDS, recall: float = RECALL) -> int:
    """Trees with which a pair at the radius shares a shard with a chance of `recall`."""
    together = (1 - radius / (64 * width)) ** wide_depth(n)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def wide_links(uniq: DataFrame, n: int, trees: range, radius: int = WIDE_RADIUS, width: int = WIDE_WORDS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the labels of distinct fingerprints uniq(label, w0, ...), as far as the given trees find them."""
    depth = wide_depth(n)

    def leaves(fps):
        bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
        for tree in trees:
            chosen = np.random.default_rng([SEED, tree]).permutation(64 * width)[:depth]
            yield tree, bits[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(depth, dtype=np.int64))

    return _search(_route(uniq, width, leaves), radius, width, tile)


def _labelled(uniq: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """uniq with the label of each row's component under the links."""
    roots = stored(connected_components(links), "simhash-roots")
    named = uniq.join(roots, F.col("label") == F.col("node"), "left")
    return named.select(F.coalesce("root", "label").alias("label"), "rep", *_columns(width))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, radius: int = RADIUS, width: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs; fp is the fingerprint's first word.

    component_id is the smallest doc_id reachable over links, the row's own
    included. With one word all links within the radius count, exactly; with more,
    those that the wide forest finds. Null, empty and wordless texts have
    fingerprint 0 and are linked to one another. Rows with a null doc_id take
    part and may get a null component_id if nothing in their group has an id.
    Repeated rows are kept. An empty table gives no rows.
    """
    words = _columns(width)
    base = stored(fingerprints(docs, id_col, text_col, shingle, width), "simhash")
    label = F.col("w0") if width == 1 else F.xxhash64(*words)
    uniq = stored(base.groupBy(*words).agg(F.min("doc_id").alias("rep")).select(label.alias("label"), "rep", *words), "simhash-distinct")
    n = uniq.count()
    if width == 1:
        named = _labelled(uniq, near_links(uniq, n, radius), 1)
    else:
        trees = wide_trees(n, radius, width)
        first = min(FIRST_TREES, trees)
        named = stored(_labelled(uniq, wide_links(uniq, n, range(first), radius, width), width), "simhash-first")
        named = _labelled(named, wide_links(named, n, range(first, trees), radius, width), width)
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = stored(named.join(smallest, "label").select(*words, "component_id"), "simhash-groups")
    return base.join(groups, words).select("doc_id", F.col("w0").alias("fp"), "component_id")


def set_links(sets: list[np.ndarray], similarity: float, first: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of sets (of distinct numbers) whose resemblance is at least `similarity`.

    With `first`, only pairs of one of the first so many sets with one of the others.
    """
    size = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else owner
    order = np.argsort(token, kind="stable")
    held = owner[order]  # by token, and among those of a token in the order of the sets
    cuts = np.searchsorted(token[order], np.arange(int(token.max(initial=-1)) + 2))
    begin, end = cuts[token], cuts[token + 1]
    if first is not None:
        begin = begin + np.bincount(token[owner < first], minlength=len(cuts))[token]
    of = np.append(0, np.cumsum(size))
    forest = _Forest(len(sets))
    for x in range(len(sets) if first is None else first):
        own = slice(of[x], of[x + 1])
        met = [held[a:b] for a, b in zip(begin[own].tolist(), end[own].tolist(), strict=True) if b - a > (first is None)]
        if not met:
            continue
        both = np.bincount(np.concatenate(met), minlength=len(sets))
        near = np.flatnonzero(both >= np.maximum(1, similarity * (size[x] + size - both) * (1 - 1e-9)))
        for y in near.tolist():
            if y != x and both[y] / (size[x] + size[y] - both[y]) >= similarity and forest.add(x, y):
                yield x, y


def _verified(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of members(root, node, rid, size) of one root whose sets(rid, shingles) have a resemblance of at least `similarity`."""
    totals = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / F.lit(GROUP_TILE), F.sum("size") / F.lit(GROUP_SHINGLES))).cast("int").alias("tiles"))
    keys = ["root", "i", "j"]
    units = _cells(members.join(totals, "root"), F.col("tiles"), F.xxhash64("node", F.lit(7)), ["root", "node", "rid"])
    whole = units.join(sets.hint("merge"), "rid").select(*keys, "own", "node", "shingles")

    def verify(batches):
        import pyarrow as pa

        def links():
            for key, own, nodes, shingles in _streamed(batches, keys, ["own", "node", "shingles"]):
                values, ends = shingles.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(shingles.value_lengths().to_numpy(zero_copy_only=False)))
                cuts = _starts(key)
                for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                    # Of two tiles, the pairs across them: those inside a tile are another unit's.
                    first = None if key[a, 1] == key[a, 2] else int((own[a:b] == key[a, 1]).sum())
                    for x, y in set_links([values[ends[r] : ends[r + 1]] for r in range(a, b)], similarity, first):
                        yield int(nodes[a + x]), int(nodes[a + y])

        yield from in_batches(pa.schema([("a", pa.int64()), ("b", pa.int64())]), links(), 20_000)

    return whole.repartition(*keys).sortWithinPartitions(*keys, "own", "node").mapInArrow(verify, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY, radius: int = CANDIDATE_RADIUS, reach: int = CANDIDATE_REACH, width: int = WIDE_WORDS) -> DataFrame:
    """(doc_id, component_id) for every row of docs.

    Two texts are linked when their sets of shingles have a resemblance of at
    least `similarity`, which is computed exactly for every pair that links of
    the wide forest within the radius bring into one candidate group;
    component_id is the smallest doc_id reachable over links. Wordless texts are
    alike. Null ids are as in near_duplicates. Ids are integers.
    """
    words = _columns(width)
    slim = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("rid", F.xxhash64("doc_id", "text"))

    def narrow(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "rid", "label", "size", *words)])

        def items():
            for d, r, t in rows(batches, "doc_id", "rid", "text"):
                own = np.unique(shingles_of(t, shingle))
                # Equal sets have one label, whatever the texts.
                yield d, r, xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), len(own), *_votes(own, width).view(np.int64).tolist()

        yield from in_batches(schema, items(), 20_000)

    base = stored(slim.mapInArrow(narrow, "doc_id long, rid long, label long, size long, " + ", ".join(f"{w} long" for w in words)), "near-base")
    uniq = stored(base.groupBy("label", "size", *words).agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid")), "near-distinct")
    n = uniq.count()
    trees = wide_trees(n, reach, width)
    first = min(FIRST_TREES, trees)

    # Candidate groups: the first trees' links, and those of the others between what these have joined.
    early = stored(wide_links(uniq, n, range(first), radius, width), "near-early")
    roots = stored(connected_components(early), "near-roots")
    joined = uniq.join(roots, F.col("label") == F.col("node"), "left").select(F.coalesce("root", "label").alias("label"), *words)
    late = stored(wide_links(joined, n, range(first, trees), radius, width), "near-late")
    groups = connected_components(early.unionByName(late))
    members = stored(groups.join(uniq, F.col("node") == F.col("label")).select("root", "node", "rid", "size"), "near-members")
    forget(early, roots, late)

    def listed(batches):
        import pyarrow as pa

        schema = pa.schema([("rid", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for r, t in rows(batches, "rid", "text"):
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int64()), pa.array([np.unique(shingles_of(t, shingle)).view(np.int64)], schema.field(1).type)], schema=schema)

    wanted = members.select("rid")
    wanted = F.broadcast(wanted) if members.count() <= BROADCAST_KEYS else wanted.hint("merge")
    # Rows that repeat give their set once; copies with ids of their own are no members, but for one.
    sets = slim.select("rid", "text").join(wanted, "rid", "left_semi").groupBy("rid").agg(F.min("text").alias("text")).mapInArrow(listed, "rid long, shingles array<long>")
    sets = stored(sets, "near-sets")
    true = stored(connected_components(_verified(members, sets, similarity)), "near-true")
    forget(sets, members)
    named = uniq.join(true, F.col("label") == F.col("node"), "left").select(F.coalesce("root", "label").alias("root"), "label", "rep")
    named = stored(named, "near-named")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = stored(named.join(smallest, "root").select("label", "component_id"), "near-groups")
    forget(uniq, true, named)
    return base.join(found, "label").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WIDE_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows that have a near duplicate with a smaller id; columns are unchanged.

    Near duplicates are those of a similarity of 0.8 or more unless told otherwise.
    Rows whose group has no id at all (null ids only) stay. Of rows that repeat
    the smallest id itself, all stay: the id names one document.
    """
    found = similar_groups(docs, id_col, text_col, shingle, similarity)
    (name,) = fresh(docs, "__gone")
    gone = found.where("doc_id IS NOT NULL AND component_id < doc_id").select(F.col("doc_id").alias(name)).distinct()
    # Always a merge join, whose cost follows the input; a broadcast could only hold at small sizes.
    return docs.join(gone.hint("merge"), F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")
