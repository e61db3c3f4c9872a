"""Near-duplicates by an LSH forest over MinHash signatures, with links confirmed on full sets.

1. Every text becomes its set of distinct word shingles, a fingerprint of that set and a MinHash
   signature. Texts of one set are one node from here on, under their smallest id.
2. A tree of the forest is the nodes sorted by one stretch of the signature. Candidates of a node are
   its neighbours in that order that share the tree's minimal prefix: the ones with the longest common
   prefix stand next to it. In a sparse region that is everybody with the prefix, in a dense region
   the order reaches only deeper prefixes, so the depth adapts to the region.
3. The first round confirms each node's most similar candidate. What that joins needs no further
   comparison with one another: the next forest holds the nodes of small components and a bounded
   number of central nodes for each large one, which thins dense regions out, and looks only for
   candidates across components. The second round confirms the most similar ones again. These
   rounds only join what is cheap to find.
4. The last round has no window: in every tree, all nodes that share the minimal prefix are compared
   across components, large regions in blocks. A block is bounded by the bytes of its sets. First every node with
   a likely partner in its cell is named, then these nodes' sets are brought to the cell and all likely
   pairs that are still apart are confirmed there. A cell gives the links that join its components: fewer
   than it has nodes, however many pairs it compares.
5. The components of the confirmed links are the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import Scratch
from .bitfilter import bits_for, filter_from
from .common import give_back_memory, gram_hashes, mix, utf8, word_hashes
from .components import components

TREES, DEPTH, MINIMUM = 16, 8, 3  # minimum: values that candidates of one tree share at least
VALUES = TREES * DEPTH
WINDOW = 64  # neighbours looked at on each side
# What is compared at a time: rows of a region of 2,048 shingles at most; larger sets count as several rows.
BLOCK, HEAVY = 1024, 2048
CELL_PAIRS = 500  # pairs of such sets confirmed together
CENTRAL = 32  # nodes that stand for a large component in the second forest
LIKELY = 0.6  # estimate from which a pair is confirmed: 4 standard errors below 0.75
_SEEDS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def shingle_set(body: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles of the text with A-Z in lower case.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    found = word_hashes(body.lower().split())
    if 0 < len(found) < k:
        return gram_hashes(np.concatenate([found, np.array([len(found)], np.uint64)]), len(found) + 1)
    return np.unique(gram_hashes(found, k))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The lowest 16 bits of each MinHash value."""
    out = np.empty(VALUES, np.uint16)
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1 << 12):  # pieces that stay in the cache
        piece = hashes[at : at + (1 << 12)]
        for j in range(VALUES):
            low[j] = min(low[j], (piece * _SEEDS[j]).min())
    out[:] = (mix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _sketches(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    schema = "doc_id bigint, n bigint, fp1 bigint, fp2 bigint, sig binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back_memory()
        for batch in batches:
            n, one, two, sigs = [], [], [], []
            for body in batch.column(1).to_pylist():
                found = shingle_set(body, k)
                n.append(len(found))
                one.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(mix(found ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(3)).view(np.int64)) if len(found) else 0)
                sigs.append(signature(found).byteswap().tobytes() if len(found) else None)  # big endian sorts as numbers
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "n", "fp1", "fp2", "sig"],
            )
        give_back_memory()

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("body")).mapInArrow(run, schema)


def _tree_rows(nodes: DataFrame, work: Scratch, name: str) -> DataFrame:
    """One row per node and tree where it shares the minimal prefix with another node."""
    width = 2 * DEPTH
    keyed = nodes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("sig"), t * width + 1, F.lit(2 * MINIMUM))).alias("region")),
            )
        ).alias("at"),
    ).select("node", "at.*")
    shared = work.cut(keyed.groupBy("region").agg(F.count(F.lit(1)).alias("held")).filter("held > 1").select("region"), f"{name}-regions")
    live = keyed.join(shared, "region", "left_semi").select("node", "tree")
    rows = live.join(nodes, "node").select(
        "tree", F.substring(F.col("sig"), F.col("tree") * width + 1, F.lit(width)).alias("label"), "node", "n", "sig", "component"
    )
    return work.cut(rows, f"{name}-rows")


def _pairs_of(tree, label, node, n, sig, component, start, across: bool, least: float, best: int):
    """Candidate pairs of sorted rows; each row from ``start`` on looks back over WINDOW rows."""
    rows = len(node)
    values = np.frombuffer(b"".join(sig), ">u2").reshape(rows, VALUES) if rows else np.zeros((0, VALUES))
    prefix = np.frombuffer(b"".join(label), ">u2").reshape(rows, DEPTH)[:, :MINIMUM].astype(np.uint64) if rows else np.zeros((0, MINIMUM), np.uint64)
    region = prefix[:, 0] << np.uint64(48) | prefix[:, 1] << np.uint64(32) | prefix[:, 2] << np.uint64(16) | tree.astype(np.uint64)
    found_i, found_j, found_e = [], [], []
    for back in range(1, min(WINDOW, rows - 1) + 1):
        same = region[back:] == region[:-back]
        if not same.any():
            break
        i = np.flatnonzero(same) + back
        i = i[i >= max(start, back)]
        j = i - back
        near = 4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])
        if across:
            near &= component[i] != component[j]
        i, j = i[near], j[near]
        for at in range(0, len(i), 1 << 14):
            a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            e = (values[a] == values[b]).mean(axis=1)
            keep = e >= least
            found_i.append(a[keep])
            found_j.append(b[keep])
            found_e.append(e[keep])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    i, j, e = map(np.concatenate, (found_i, found_j, found_e))
    # The ``best`` of each row, whichever side they are on.
    keep = np.zeros(len(e), bool)
    pair = np.r_[np.arange(len(i)), np.arange(len(i))]
    mine = np.r_[i, j]
    order = np.lexsort((-e[pair], mine))
    place = np.arange(len(order)) - np.searchsorted(mine[order], mine[order])
    keep[pair[order[place < best]]] = True
    return node[i[keep]], node[j[keep]], e[keep]


def _candidates(rows: DataFrame, work: Scratch, name: str, across: bool, least: float, best: int) -> DataFrame:
    """(a, b, likeness) from a sliding window over the range-sorted trees.

    Rows at the two ends of a range partition are kept aside, and neighbours across a border are
    compared afterwards, one small group per border.
    """
    ordered = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    schema = "a bigint, b bigint, likeness double, border int, late int, place int, tree int, label binary, node bigint, n bigint, sig binary, component bigint"
    columns = ["tree", "label", "node", "n", "sig", "component"]
    empty = {c: None for c in ["a", "b", "likeness", "border", "late", "place", *columns]}

    def arrays(frame):
        return [frame[c].to_numpy() if c not in ("label", "sig") else frame[c].tolist() for c in columns]

    def as_rows(a, b, e):
        return pd.DataFrame({**empty, "a": a, "b": b, "likeness": e}, columns=list(empty))

    def edge(frame, border, late):
        return frame.assign(border=border, late=late, place=range(len(frame)), a=None, b=None, likeness=None)[list(empty)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail, first = None, True
        for batch in batches:
            if not len(batch):
                continue
            if first:
                yield edge(batch.head(WINDOW), part, 1)
                first = False
            frame = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            yield as_rows(*_pairs_of(*arrays(frame), 0 if tail is None else len(tail), across, least, best))
            tail = frame.tail(WINDOW)
        if tail is not None:
            yield edge(tail, part + 1, 0)
        tail = frame = batch = None
        give_back_memory()

    def at_border(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["late", "place"]).reset_index(drop=True)
        start = int((frame["late"] == 0).sum())
        a, b, e = _pairs_of(*arrays(frame), start, across, least, best)
        return pd.DataFrame({"a": a, "b": b, "likeness": e})

    seen = work.cut(ordered.mapInPandas(run, schema), f"{name}-window")
    borders = seen.filter("border is not null").groupBy("border").applyInPandas(at_border, "a bigint, b bigint, likeness double")
    return seen.filter("a is not null").select("a", "b", "likeness").union(borders)


def _likely_pairs(tree, region, side, node, n, sig, component) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that share a region and have a likely estimate.

    Side 0 is compared with side 1, and rows of side 2 with one another. A pair is found in the first of
    its trees only. ``component`` may change between two of the blocks of pairs.
    """
    rows = len(node)
    values = np.frombuffer(b"".join(sig), ">u2").astype(np.uint16).reshape(rows, VALUES)
    by_value = np.ascontiguousarray(values.T)
    heads = values.reshape(rows, TREES, DEPTH)[:, :, :MINIMUM]
    bounds = np.r_[0, np.flatnonzero(region[1:] != region[:-1]) + 1, rows]
    for start, end in zip(bounds[:-1], bounds[1:]):
        at = np.arange(start, end)
        one, two = at[side[at] != 1], at[side[at] != 0]
        for low in range(0, len(one), 64):
            a = one[low : low + 64]
            small, great = np.minimum(n[a][:, None], n[two]), np.maximum(n[a][:, None], n[two])
            open_ = (component[a][:, None] != component[two]) & (4 * small >= 3 * great)
            open_ &= (side[a][:, None] != 2) | (a[:, None] < two)
            i, j = np.nonzero(open_)
            if not len(i):
                continue
            if 8 * len(i) > open_.size:
                same = np.zeros(open_.shape, np.uint8)
                for v in by_value:
                    same += v[a][:, None] == v[two]
                e = same[i, j] / VALUES
            else:
                e = (values[a[i]] == values[two[j]]).mean(axis=1)
            near = e >= LIKELY
            i, j = a[i[near]], two[j[near]]
            shared = (heads[i] == heads[j]).all(axis=2).argmax(axis=1) == tree[i]
            if shared.any():
                yield i[shared], j[shared]


_IN_CELL = ["tree", "region", "side", "node", "n", "component"]


def _arrays(frame: pd.DataFrame) -> list:
    return [frame[c].to_numpy() if c != "sig" else frame[c].tolist() for c in ("tree", "region", "side", "node", "n", "sig")]


def _with_partner(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of a cell that have a likely partner in it, without their signatures."""
    frame = frame.sort_values(["region", "side", "node"], ignore_index=True)
    seen = np.zeros(len(frame), bool)
    for i, j in _likely_pairs(*_arrays(frame), frame["component"].to_numpy()):
        seen[i] = seen[j] = True
    return frame.loc[seen, [*_IN_CELL, "cell"]]


def _joining_links(frame: pd.DataFrame, share: int) -> pd.DataFrame:
    """Confirmed links of a cell that join its components, none between what earlier ones joined."""
    frame = frame.sort_values(["region", "side", "node"], ignore_index=True)
    nodes, of_node = np.unique(frame["node"].to_numpy(), return_inverse=True)
    first = np.zeros(len(nodes), np.int64)
    first[of_node[::-1]] = np.arange(len(frame))[::-1]
    sets = [np.frombuffer(m, np.uint64) for m in frame["members"].iloc[first]]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    known = np.zeros(flat.max(initial=-1) + 1, bool)
    flat = np.split(flat, np.cumsum([len(x) for x in sets])[:-1])
    group = frame["component"].to_numpy().copy()
    good_a, good_b = [], []
    for i, j in _likely_pairs(*_arrays(frame), group):
        for a in np.unique(i):
            # One set against all its partners that are still apart.
            b = j[i == a]
            b = b[group[b] != group[a]]
            if not len(b):
                continue
            own, others = flat[of_node[a]], [flat[k] for k in of_node[b]]
            known[own] = True
            held = np.array([len(x) for x in others])
            both = np.add.reduceat(known[np.concatenate(others)], np.cumsum(held) - held, dtype=np.int64)
            known[own] = False
            for k in b[100 * both >= share * (len(own) + held - both)]:
                if group[k] != group[a]:
                    group[group == group[k]] = group[a]
                    good_a.append(nodes[of_node[a]])
                    good_b.append(nodes[of_node[k]])
    return pd.DataFrame({"a": np.array(good_a, np.int64), "b": np.array(good_b, np.int64)})


def _dealt(nodes: DataFrame, work: Scratch) -> DataFrame:
    """All rows that share a region with another component, in cells that compare them: _IN_CELL and cell.

    Small regions are compared as they are, several to a cell; large ones are cut into blocks, each pair of blocks
    being a cell. A component with many rows in a region has blocks of its own, which are not compared
    with one another.
    """
    width = 2 * DEPTH
    weight = F.ceil(F.col("n") / HEAVY).alias("weight")
    keyed = nodes.select(
        "node",
        "n",
        "component",
        weight,
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(TREES - 1)),
                lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring(F.col("sig"), t * width + 1, F.lit(2 * MINIMUM))).alias("region")),
            )
        ).alias("at"),
    ).select("node", "n", "component", "weight", "at.*")
    regions = keyed.groupBy("region").agg(F.sum("weight").alias("held"), F.min("component").alias("low"), F.max("component").alias("high"))
    regions = work.cut(regions.filter("low <> high").select("region", "held"), "whole-regions")
    live = work.cut(keyed.join(regions, "region"), "whole-live")
    every = live.agg(F.sum("weight")).first()[0] or 0
    plain = ["tree", "region", "node", "n", "component"]
    small = live.filter(F.col("held") <= BLOCK).select(
        *plain, F.pmod(F.xxhash64("region"), F.lit(max(64, every // (2 * BLOCK)))).alias("cell"), F.lit(2).alias("side")
    )

    large = live.filter(F.col("held") > BLOCK)
    own = large.groupBy("region", "component").agg(F.sum("weight").alias("mine")).filter(F.col("mine") > BLOCK // 2)
    own = work.cut(own, "whole-own")
    share = lambda key, held: F.pmod(F.xxhash64(key), F.ceil(F.col(held) / BLOCK))
    large = large.join(own, ["region", "component"], "left").select(
        *plain,
        F.when(F.col("mine").isNotNull(), F.col("component")).alias("only"),
        F.when(F.col("mine").isNotNull(), F.xxhash64("region", "component", share("node", "mine")))
        .otherwise(F.xxhash64("region", share("component", "held")))
        .alias("block"),
    )
    large = work.cut(large, "whole-large")
    blocks = work.cut(large.groupBy("region", "block", "only").agg(F.min("n").alias("low"), F.max("n").alias("high")), "whole-blocks")
    other = blocks.select("region", *[F.col(c).alias(f"{c}2") for c in ("block", "only", "low", "high")])
    pairs = blocks.join(other, "region").filter(
        "block <= block2 and not (only <=> only2 and only is not null) and 4 * high >= 3 * low2 and 4 * high2 >= 3 * low"
    )
    cell = F.xxhash64("block", "block2").alias("cell")
    sides = pairs.select("region", "block", cell, F.when(F.col("block") == F.col("block2"), 2).otherwise(0).alias("side"))
    sides = sides.union(pairs.filter("block <> block2").select("region", "block2", cell, F.lit(1)))
    dealt = large.join(work.cut(sides, "whole-sides"), ["region", "block"]).select(*plain, "cell", "side")
    dealt = work.cut(small.union(dealt), "whole-dealt")
    work.drop("whole-live", "whole-large")
    return dealt


def _whole_regions(nodes: DataFrame, docs: DataFrame, work: Scratch, held: Held, share: int = 75) -> DataFrame | None:
    """Links that join all components with a pair of enough overlap in any region of any tree; None without any
    likely pair."""
    sigs = nodes.select("node", "sig")
    dealt = _dealt(nodes, work).join(sigs, "node")
    kinds = "tree int, region bigint, side int, node bigint, n bigint, component bigint, cell bigint"
    chosen = dealt.groupBy("cell").applyInPandas(_with_partner, kinds)
    if not work.write(chosen, "whole-chosen"):
        return None
    chosen = work.read("whole-chosen", kinds)
    work.drop("whole-dealt")
    held.fetch(docs, chosen.select("node"), "whole")
    brought = chosen.join(sigs, "node").join(held.sets, "node")
    found = brought.groupBy("cell").applyInPandas(lambda frame: _joining_links(frame, share), "a bigint, b bigint")
    return work.cut(found, "whole-links")


def _confirmed(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, work: Scratch, name: str, share: int = 75) -> DataFrame:
    """The pairs whose full sets overlap by ``share`` percent of their union.

    Pairs, one per first end, are dealt into cells of about 500, or of fewer where sets are large; a set
    travels once to each cell that needs it, however many of its pairs are there.
    """
    weight = pairs.join(sizes.select(F.col("node").alias("a"), "n"), "a").agg(F.sum(F.ceil(F.col("n") / HEAVY))).first()[0]
    cells = max(64, weight // CELL_PAIRS)
    dealt = work.cut(pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(cells)).alias("cell")), f"{name}-pairs")
    ends = dealt.select("cell", F.col("a").alias("node")).union(dealt.select("cell", "b")).distinct()
    brought = ends.join(sets, "node").select(F.col("cell").alias("at"), "node", "members")

    def check(pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        known = {n: np.frombuffer(m, np.uint64) for n, m in zip(members["node"], members["members"])}
        good = []
        for a, b in zip(pairs["a"], pairs["b"]):
            x, y = known[a], known[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= share * (len(x) + len(y) - both))
        return pairs.loc[np.array(good, bool), ["a", "b"]]

    linked = dealt.groupBy("cell").cogroup(brought.groupBy("at")).applyInPandas(check, "a bigint, b bigint")
    return work.cut(linked, f"{name}-links")


def _sets(docs: DataFrame, wanted: DataFrame, rows: int, doc_id: str, text: str, k: int) -> DataFrame:
    """(node, members) of the wanted nodes. A filter of the ids goes to where the texts are read, so that what
    is not wanted is neither cut into shingles nor shuffled."""
    bits = bits_for(rows)
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - bits).alias("place")
    known = filter_from(wanted.select(place), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(known.at(batch.column(2).to_numpy())))
            found = [shingle_set(b, k).tobytes() for b in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(found, pa.binary())], names=["node", "members"])
        some = found = None
        give_back_memory()

    bodies = docs.select(F.col(doc_id).cast("bigint").alias("node"), utf8(text).alias("body")).filter("node is not null")
    found = bodies.select("node", "body", place).mapInArrow(run, "node bigint, members binary")
    return found.join(wanted, "node", "left_semi")


class Held:
    """The sets fetched so far; each is made from its text once."""

    def __init__(self, work: Scratch, doc_id: str, text: str, k: int):
        self.work, self.columns = work, (doc_id, text, k)
        self.sets: DataFrame | None = None

    def fetch(self, docs: DataFrame, nodes: DataFrame, name: str) -> None:
        wanted = nodes.distinct()
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        rows = self.work.write(wanted, f"{name}-wanted")
        if rows:
            wanted = self.work.read(f"{name}-wanted", "node bigint")
            more = self.work.cut(_sets(docs, wanted, rows, *self.columns), f"{name}-sets")
            self.sets = more if self.sets is None else self.sets.union(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two texts are linked when their sets of k-word shingles overlap by 75 % of the union or more;
    ``component_id`` is the smallest doc_id reachable over links, itself included, and ``kept`` says whether it is
    the row's own. Null and empty texts have an empty set and are linked with nothing. Rows with
    a null doc_id take no part: they form their own group and are kept. doc_ids are taken to be
    unique; rows that repeat one are one node if their sets are equal. Other columns are ignored. The result is
    a table; what led to it is deleted.
    """
    work = Scratch(docs.sparkSession, "near-dup")
    sketch = work.cut(_sketches(docs, doc_id, text, k), "sketch")
    real = sketch.filter("n > 0 and doc_id is not null")
    nodes = work.cut(real.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig")), "nodes")

    plain = nodes.select("node", "n", "sig", F.col("node").alias("component"))
    held = Held(work, doc_id, text, k)
    links = comps = had = None
    forest = plain
    for name in ("first", "second"):
        rows = _tree_rows(forest, work, name)
        near = work.cut(_candidates(rows, work, name, links is not None, LIKELY, 1).distinct(), f"{name}-candidates")
        # the most similar one of every node
        seen = near.union(near.select("b", "a", "likeness"))
        chosen = seen.groupBy("a").agg(F.max_by("b", F.struct("likeness", -F.col("b"))).alias("b"))
        count = work.write(chosen, f"{name}-chosen")
        work.drop(f"{name}-rows", f"{name}-window", f"{name}-candidates")
        if not count:
            break
        chosen = work.read(f"{name}-chosen", chosen.schema)
        held.fetch(docs, chosen.select(F.col("a").alias("node")).union(chosen.select("b")), name)
        found = _confirmed(chosen, nodes, held.sets, work, name)
        links = found if links is None else links.union(found)
        comps = components(links, work, name)
        if name == "first":
            had = chosen.select(F.col("a").alias("node"))  # all that have a candidate
            forest = _thinned(plain, had, links, comps, work, name, CENTRAL)
    forest = plain  # all nodes, also those that had no candidate so far
    if comps is not None:
        forest = plain.drop("component").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = _whole_regions(work.cut(forest, "whole-forest"), docs, work, held)
    if found is not None:
        links = found if links is None else links.union(found)
        comps = components(links, work, "whole")
    labels = nodes.select("fp1", "fp2", "n", "node")
    if comps is not None:
        labels = labels.join(comps, "node", "left").select("fp1", "fp2", "n", F.coalesce("component", "node").alias("component"))
    else:
        labels = labels.withColumnRenamed("node", "component")
    labels = work.cut(labels, "labels")
    found = sketch.select("doc_id", "fp1", "fp2", "n").join(labels, ["fp1", "fp2", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    result = work.cut(
        found.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            own.alias("component_id"),
            F.col("doc_id").eqNullSafe(own).alias("kept"),
        ),
        "result",
    )
    work.keep_only("result")
    return result


def _thinned(
    plain: DataFrame, had: DataFrame, links: DataFrame, comps: DataFrame, work: Scratch, name: str, central: int
) -> DataFrame:
    """The nodes of the next forest.

    Of the nodes that had candidates, all in small components and central ones in large: those with
    most confirmed links, one for each of ``central`` shares of the ids.
    """
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    known = had.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = work.cut(known.join(degree, "node", "left").fillna(0, ["degree"]), f"{name}-known")
    size = known.groupBy("component").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > max(WINDOW, central))
    size = work.cut(size, f"{name}-size")
    marked = work.cut(known.join(size, "component", "left"), f"{name}-marked")
    middle = (
        marked.filter("held is not null")
        .groupBy("component", F.pmod(F.xxhash64("node"), F.lit(central)).alias("share"))
        .agg(F.max_by("node", F.struct("degree", -F.col("node"))).alias("node"))
    )
    chosen = marked.filter("held is null").select("node", "component").union(middle.select("node", "component"))
    return work.cut(plain.drop("component").join(work.cut(chosen, f"{name}-kept"), "node"), f"{name}-forest")
