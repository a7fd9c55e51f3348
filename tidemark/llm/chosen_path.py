"""N-gram Jaccard join by chosen paths.

Each distinct text is a set of hashed five-word shingles, embedded as a vector of minima (a minhash
coordinate equals for two sets with the probability of their Jaccard similarity).

1. ``buckets``: in each run all sets start in one node. A node samples one coordinate, a second one
   with probability 1/4 (1 / 0.8 on average), and deals its sets by their value there. Nodes of one
   set die. Nodes with no more pairs to compare than ``BUCKET`` sets have are done: sets of one known cluster
   need no comparison. The others are dealt again, up to ``DEPTH`` times; what is left then is compared in blocks.
2. ``compared``: pairs of a done node are compared by their vectors inside the task; only a
   spanning tree of the similar ones leaves it, and of sets known to be of one cluster no edge. Connected trees make a cluster.
3. ``candidates``: runs are repeated until the target recall. The clusters of the first ``FIRST`` runs are known to the
   others, so a large cluster is told once and not once a run, nor dealt on for a few other sets beside it. All sets take
   the further runs that nodes done after two deals need. A set that never stood in a larger node then has found all its
   partners with the target recall, as a partner left in such a node would have been there with it. The others take as
   many runs more as nodes done after three deals need, those of them that are left then the runs of four deals, and so on.
4. ``links``: texts of a cluster are compared exactly by their shingle sets, large clusters in pairs of
   blocks. Out come links per text and again a spanning tree, never the pairs. Connected trees of exact
   links are the classes.

Copies of a text are one set. Nothing about all documents comes to the driver: clusters are found by
label propagation over tables, the second reading of the texts is thinned out by a Bloom bitmap.

Defined cases: null texts are empty; texts of one to four words are one shingle of all their words;
texts without words form a class with their copies only; word case and punctuation do not count;
rows with the same id and text are one document, of which ``keep_one`` keeps one; null ids
order last; an empty table gives an empty result; further columns are kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .registry import query
from .support import bitmap_of, row_key, stage, table, text_of, unused
from .words import Hasher, shingles, slices, utf8, words

WORDS, SIMILAR = 5, 0.8
COORDINATES = 64
#: Sets that are compared pair by pair in one place; more, up to ``CROWD`` times as many, if clusters leave no more pairs.
BUCKET, CROWD = 1024, 4
#: Sets in a block of a group that is larger than that and is not dealt further, and shingles in a block.
BLOCK, BLOCK_GRAMS = 512, 1 << 19
DEPTH = 6
#: Runs that are made before any cluster is known.
FIRST = 2
#: A pair at the threshold becomes a candidate with this probability.
RECALL = 0.9999
#: Shared coordinates that send a pair to the exact comparison: five deviations below the threshold.
SKETCHED = SIMILAR - 5 * math.sqrt(SIMILAR * (1 - SIMILAR) / COORDINATES)
#: Bits of the bitmap of texts in clusters: 8 MB, whatever their number.
BITS = 26
SEED = 20260101


def missed(runs: int, levels: int, least: float = SKETCHED, made: tuple = ()) -> float:
    """How likely a pair at the threshold is no candidate when its nodes are done after ``levels`` deals.

    ``made`` has further runs as pairs of their number and deals.

    Runs sample the same coordinates, so they are independent only given how many of them the pair shares:
    the sum goes over that number, and pairs below the sketch's cut are missed in any case.
    """
    out = 0.0
    for k in range(COORDINATES + 1):
        share = k / COORDINATES
        likely = math.comb(COORDINATES, k) * SIMILAR**k * (1 - SIMILAR) ** (COORDINATES - k)
        both = 1 - (1 - share) * (1 - share / 4 * (1 - 1 / COORDINATES))  # dealt alike by the first or the second coordinate
        out += likely * (math.prod((1 - both**deals) ** n for n, deals in ((runs, levels), *made)) if share >= least else 1)
    return out


def runs_for(recall: float, levels: int = 2, made: tuple = ()) -> int:
    """The fewest runs, besides those ``made``, that find a pair at the threshold with this probability when nodes are done after ``levels`` deals."""
    if 1 - recall <= missed(1, 0):
        raise ValueError(f"{COORDINATES} coordinates find at most {1 - missed(1, 0)} of the pairs at the threshold")
    runs = 0
    while missed(runs, levels, made=made) > 1 - recall:
        runs += 1
    return runs


def _lowered():
    return F.unhex(F.md5(text_of())).alias("key"), F.lower(text_of()).alias("text")


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (key, sketch) of the distinct texts that have words."""

    def batches(source):
        hasher, rng = Hasher(), np.random.default_rng(SEED)
        xor = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
        odd = rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
        for whole in source:
            for part in slices(whole, "text"):
                _, _, hashes, first = words(*utf8(part.column("text")), hasher)
                grams, bounds = shingles(hashes, first, WORDS)
                full = np.flatnonzero(np.diff(bounds) > 0)
                out = np.zeros((len(full), COORDINATES), np.int32)
                for k in range(COORDINATES if len(full) else 0):
                    h = ((grams ^ xor[k]) * odd[k]) >> np.uint64(32)
                    out[:, k] = np.minimum.reduceat(h, bounds[full]).astype(np.uint32).view(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * COORDINATES), pa.array(out.ravel(), pa.int32()))
                yield pa.record_batch([part.column("key").take(pa.array(full)), flat], names=["key", "sketch"])

    found = docs.select(*_lowered()).mapInArrow(batches, "key binary, sketch array<int>")
    return found.groupBy("key").agg(F.first("sketch").alias("sketch"))


def _deal(rows: DataFrame) -> DataFrame:
    """Deal the sets of each node by one or two coordinates that the node's number samples."""
    pick = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(COORDINATES)).cast("int")
    deal = lambda c: F.xxhash64("node", c, F.get("sketch", c))
    second = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(4)) == 0
    nodes = F.array_compact(F.array(deal(pick("a")), F.when(second & (pick("a") != pick("b")), deal(pick("b")))))
    return rows.select("key", "cluster", "sketch", F.explode(nodes).alias("node"))


def buckets(sets: DataFrame, runs: range) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows (node, key, cluster, sketch): the sets of every done node. Larger ones are replicated into pairs of blocks.

    Also the sets that stood in a larger node after two deals or more, if any, each with the most such deals, and the
    deals of the deepest node. A node whose sets are all of one ``cluster`` has nothing left to find and dies; one with few sets beside a
    large cluster is done.
    """
    roots = F.explode(F.array(*[F.xxhash64(F.lit(f"run {r}")) for r in runs]))
    # the first deal needs no sketches in the shuffle: they join the sets that are left
    rows = _deal(sets.select("key", "cluster", "sketch", roots.alias("node"))).select("key", "cluster", "node")
    done = deep = None
    for depth in range(1, DEPTH + 1):
        found = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("cluster").alias("low"), F.max("cluster").alias("high"))
        alive = rows.join(found.filter(F.col("low") != F.col("high")).select("node", "size"), "node")
        if depth == 1:
            alive = alive.join(sets.select("key", "sketch"), "key")
        alive = stage(alive.select("key", "cluster", "node", "size", "sketch"), "path-nodes")
        small = alive.filter(F.col("size") <= BUCKET).select("node", "key", "cluster", "sketch")
        done = small if done is None else done.unionByName(small)
        rows = alive.filter(F.col("size") > BUCKET)
        if not rows.take(1):
            break
        few = stage(_few_pairs(rows), "path-few")
        done = done.unionByName(rows.join(few, "node", "left_semi").select("node", "key", "cluster", "sketch"))
        rows = rows.join(few, "node", "left_anti")
        if not rows.take(1):
            break
        if depth >= 2:
            left = rows.select("key", F.lit(depth).alias("deals"))
            deep = left if deep is None else deep.union(left)
        if depth < DEPTH:
            rows = _deal(rows)
    else:
        done = done.unionByName(in_blocks(rows, "node", BLOCK).select("node", "key", "cluster", "sketch"))
    return done, None if deep is None else deep.groupBy("key").agg(F.max("deals").alias("deals")), depth


def _few_pairs(rows: DataFrame) -> DataFrame:
    """The nodes with no more pairs of sets of different clusters than ``BUCKET`` sets have."""
    parts = rows.groupBy("node", "cluster").agg(F.count(F.lit(1)).alias("n"))
    nodes = parts.groupBy("node").agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("alike"))
    pairs = (F.col("size") * F.col("size") - F.col("alike")) / 2
    return nodes.filter((pairs <= BUCKET * (BUCKET - 1) / 2) & (F.col("size") <= CROWD * BUCKET)).select("node")


def in_blocks(rows: DataFrame, group: str, most: int, most_weight: int | None = None) -> DataFrame:
    """Split groups of ``size`` rows into blocks of about ``most`` and give each pair of blocks a group of its own.

    Where rows have a ``weight``, as the group's total, blocks hold about ``most_weight`` of it. Adds first
    and second block and the row's own; the pair of a block with itself stands for its inside.
    """
    count = F.ceil(F.col("size") / F.lit(most)).cast("int")
    if most_weight:
        count = F.greatest(count, F.ceil(F.col("weight") / F.lit(most_weight)).cast("int"))
    own = F.pmod(F.xxhash64("key", F.lit("block")), count).cast("int")
    pair = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("low"), F.greatest(b, F.col("own")).alias("high")))
    spread = rows.withColumn("own", own).select("*", F.explode(pair).alias("p"))
    return spread.withColumn(group, F.xxhash64(group, "p.low", "p.high")).withColumns({"low": F.col("p.low"), "high": F.col("p.high")}).drop("p")


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each component of the pairs (a, b) among n rows."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _groups(source, group: str):
    """Record batches made of whole groups; the source has the rows of a group on end."""
    held = None
    for batch in source:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        node = batch.column(group).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(node, node[-1]))
        if last:
            yield batch.slice(0, last)
        held = batch.slice(last)
    if held is not None and held.num_rows:
        yield held


def compared(nodes: DataFrame, least: float = SKETCHED) -> DataFrame:
    """Spanning edges (a, b) of the similar sets of each node, by their sketches; none between sets of one cluster."""

    def batches(source):
        for batch in _groups(source, "node"):
            node = batch.column("node").to_numpy(zero_copy_only=False)
            sketch = batch.column("sketch").flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
            place = np.concatenate([[0], np.cumsum(node[1:] != node[:-1])])
            cluster = batch.column("cluster").dictionary_encode().indices.to_numpy()
            _, head, member = np.unique(place * len(node) + cluster, return_index=True, return_inverse=True)
            head = head[member]  # the first set of the same cluster in the node
            left, right = [], []
            for d in range(1, len(node)):
                same = node[:-d] == node[d:]
                if not same.any():
                    break
                i = np.flatnonzero(same & (head[:-d] != head[d:]))
                for at in range(0, len(i), 65536):
                    part = i[at : at + 65536]
                    near = part[(sketch[part] == sketch[part + d]).mean(axis=1) >= least]
                    left.append(near), right.append(near + d)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            label = _labels(len(node), head[a], head[b])
            rows = np.flatnonzero(label != np.arange(len(node)))
            key = batch.column("key")
            yield pa.record_batch([key.take(pa.array(rows)), key.take(pa.array(label[rows]))], names=["a", "b"])

    dealt = nodes.select("node", "key", "cluster", "sketch").repartition("node").sortWithinPartitions("node", "key")
    return dealt.mapInArrow(batches, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (key, label): the smallest key of each connected part. Labels spread along edges, then jump to their label's label."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        told = both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        near = labels.join(told, "key").select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = near.select(F.col("key").alias("label"), F.col("label").alias("far"))
        new = stage(near.join(jump, "label").select("key", "old", F.least("label", "far").alias("label")), "labels")
        labels = new.select("key", "label")
        if not new.filter(F.col("old") != F.col("label")).take(1):
            return labels


def clustered(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets with the cluster that the edges connect theirs to, or their own: only clusters are connected, not sets anew."""
    of = lambda c: sets.select(F.col("key").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    between = edges.join(of("a"), "a").join(of("b"), "b").filter(F.col("a_cluster") != F.col("b_cluster"))
    known = components(between.select(F.col("a_cluster").alias("a"), F.col("b_cluster").alias("b")))
    known = known.withColumnRenamed("key", "cluster")
    joined = sets.join(known, "cluster", "left").withColumn("cluster", F.coalesce("label", "cluster")).drop("label")
    return stage(joined.select(*sets.columns), "path-clusters")


def repeated(sets: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Edges between candidate sets, as many as connect each cluster, from runs repeated to the target recall; the sets with their ``cluster``."""
    sets = sets.withColumn("cluster", F.col("key"))
    nodes, _, depth = buckets(sets, range(FIRST))
    edges, made = stage(compared(nodes), "path-edges"), ((FIRST, depth),)
    sets = clustered(sets, edges)
    runs, rest, deep = 0, sets, None
    for deals in range(2, DEPTH + 1):
        more = runs_for(recall, deals, made) - runs
        if not more:
            continue
        nodes, left, _ = buckets(rest, range(FIRST + runs, FIRST + runs + more))
        new = stage(compared(nodes), "path-edges")
        runs += more
        if new.take(1):
            edges, sets = edges.union(new), clustered(sets, new)
        if left is not None:
            deep = stage((left if deep is None else deep.union(left)).groupBy("key").agg(F.max("deals").alias("deals")), "path-deep")
        rest = None if deep is None else stage(sets.join(deep.filter(F.col("deals") >= deals).select("key"), "key"), "path-rest")
        if rest is None or not rest.take(1):
            break
    return edges, sets


def candidates(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """Rows (a, b): the edges of ``repeated``."""
    return repeated(sets, recall)[0]


def shingle_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (key, grams) of the texts whose key is among ``keys``: sorted distinct shingle hashes.

    A second reading of the texts; the bitmap keeps most other texts out of the shuffle, the join does the rest.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(keys.select(F.xxhash64("key").alias("hash")), BITS))

    def batches(source):
        hasher, bits, one = Hasher(), shared.value, np.uint64(1)
        for whole in source:
            h = whole.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            a, b = h & np.uint64((1 << BITS) - 1), (h >> np.uint64(32)) & np.uint64((1 << BITS) - 1)
            hit = [(bits[(x >> np.uint64(6)).astype(np.int64)] >> (x & np.uint64(63))) & one for x in (a, b)]
            whole = whole.filter(pa.array((hit[0] & hit[1]).astype(bool)))
            for part in slices(whole, "text"):
                _, _, hashes, first = words(*utf8(part.column("text")), hasher)
                grams, bounds = shingles(hashes, first, WORDS)
                grams = grams.view(np.int64)
                sets = [np.unique(grams[a:b]) for a, b in zip(bounds, bounds[1:])]
                yield pa.record_batch([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], names=["key", "grams"])

    key, text = _lowered()
    hashed = docs.select(key, text).withColumn("hash", F.xxhash64("key"))
    return hashed.mapInArrow(batches, "key binary, grams array<long>").dropDuplicates(["key"]).join(keys, "key")


def _exact(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Which pairs of sets reach the Jaccard similarity, as a square of booleans without its diagonal."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    number = np.cumsum(held > 1) - 1  # shingles of a single set are common to no pair
    use = held[column] > 1
    row, column = row[use], number[column[use]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        block = np.zeros((n, 8192), np.float32)
        block[row[a:b], column[a:b] - at] = 1
        common += block @ block.T
    common = common.astype(np.int64)
    near = common >= similar * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(near, False)
    return near


def links(sets: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Rows (a, b, n): text a has n links in this place, and is linked to b or is b itself.

    ``sets`` has label, key and grams.
    """
    size = sets.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum(F.size("grams")).alias("weight"))
    sized = sets.join(size, "label").withColumn("node", F.xxhash64("label"))
    blocks = in_blocks(sized, "node", BLOCK, BLOCK_GRAMS).select("node", "key", "grams", "own", "low", "high")

    def batches(source):
        for batch in _groups(source, "node"):
            node = batch.column("node").to_numpy(zero_copy_only=False)
            own, low, high = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "low", "high"))
            cuts = [0, *(np.flatnonzero(np.diff(node)) + 1).tolist(), len(node)]
            grams = batch.column("grams")
            start, values = grams.offsets.to_numpy(), grams.values.to_numpy()
            label, count = np.arange(len(node)), np.zeros(len(node), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                near = _exact([values[start[i] : start[i + 1]] for i in range(a, b)], similar)
                if low[a] != high[a]:  # the inside of a block has a place of its own
                    near &= own[a:b, None] != own[None, a:b]
                count[a:b] = near.sum(axis=1)
                i, j = np.nonzero(np.triu(near))
                label[a:b] = a + _labels(b - a, i, j)
            key, rows = batch.column("key"), np.flatnonzero(count)
            yield pa.record_batch([key.take(pa.array(rows)), key.take(pa.array(label[rows])), pa.array(count[rows])], names=["a", "b", "n"])

    return blocks.repartition("node").sortWithinPartitions("node").mapInArrow(batches, "a binary, b binary, n long")


def near_classes(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """Rows (key, label, n_links) of the texts that have a link; key is the md5 of the text."""
    sets = stage(sketches(docs), "sketches")
    edges, known = repeated(sets, recall)
    joined = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct()
    clusters = stage(known.select("key", F.col("cluster").alias("label")).join(joined, "key"), "clusters")
    found = stage(links(shingle_sets(docs, clusters), similar), "links")
    counts = found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n_links"))
    return stage(components(found.filter(F.col("a") != F.col("b"))).join(counts, "key"), "near-classes")


def classes(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, row key, its class and the number of other texts it is linked to.

    The class is named by its smallest doc_id; ``first`` is the row key of that document.
    """
    near = near_classes(docs, similar, recall)
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.unhex(F.md5(text_of())).alias("key"))
    named = stage(rows.join(near, "key", "left").select(
        "doc_id", "row", F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    ), "classed")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    heads = named.groupBy("label").agg(F.min(rank).alias("head"), F.count(F.lit(1)).alias("n_docs"))
    return named.join(heads, "label").select("doc_id", "row", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("first"), "n_links", "n_docs")


def keep_one(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """The first document of each class, all columns kept."""
    key = unused(docs, "row")
    heads = stage(classes(docs, similar, recall).select(F.col("first").alias(key)).distinct(), "class-heads")
    return docs.withColumn(key, row_key()).join(heads, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


@query("op9_chosen_path")
def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_docs")
