"""Near duplicates: dart-throwing weighted MinHash, banded joining and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, mix64, save, slices, small_batches
from .substring import Words, _words_of

SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates of each: a pair at 0.8 shares a band with probability 1 - 3e-6.
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Parts into which a bucket's nodes are dealt where they are counted, and pairs with one leader that a task compares.
SALTS, WITH_LEADER = 64, 512
#: Rounds in which each bucket's nodes are compared with one of them.
ROUNDS = 2
#: Nodes and shingles of a bucket, or of a block of it, that a task compares among themselves.
BLOCK, BLOCK_SHINGLES = 2048, 2_000_000

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def darts(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int = K) -> np.ndarray:
    """Signatures, shape (n_sets, k), of weighted sets given as parallel arrays.

    Each unit of an element's weight is a region into which darts fall in hashed order (a Poisson process in
    their rank); a dart in the last, partial unit counts if its hashed height lies below the weight. A dart has a
    coordinate, and a set keeps the earliest in each: two sets agree in a coordinate with the probability of
    their weighted Jaccard similarity. About k ln k + 2k darts a set are thrown, however large it is; where a
    coordinate stays empty, twice as many are.
    """
    sig = np.zeros(n_sets * k, dtype=np.uint64)
    if not len(elements):
        return sig.reshape(n_sets, k)
    units = np.ceil(weights).astype(np.int64)
    at = np.repeat(np.arange(len(elements)), units)
    unit = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    region, owner, height = mix64(elements[at] + _A * (unit + 1).astype(np.uint64)), sets[at], weights[at] - unit
    mass = np.bincount(sets, weights=weights, minlength=n_sets)
    reach = np.where(mass > 0, (k * np.log(max(k, 2)) + 2 * k) / np.maximum(mass, 1e-300), 0.0)
    open_ = mass > 0
    while open_.any():
        use = np.flatnonzero(open_[owner])
        reg, own, high, rank = region[use], owner[use], height[use], np.zeros(len(use))
        step, found = 0, []
        while len(reg):
            step += 1
            h = mix64(reg ^ np.uint64(step * int(_B) & (1 << 64) - 1))
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            near = rank <= reach[own]
            reg, own, high, rank, h = reg[near], own[near], high[near], rank[near], h[near]
            dart = mix64(h + _C)
            hit = high >= 1
            if not hit.all():
                hit |= (mix64(dart + _A) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < high
            found.append((own[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64), rank[hit], dart[hit]))
        place, rank, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        last = np.argsort(-rank, kind="stable")  # the earliest is written last
        sig[place[last]] = dart[last]
        full = np.zeros(n_sets * k, dtype=bool)
        full[place] = True
        open_ &= ~full.reshape(n_sets, k).all(axis=1)
        reach = np.where(open_, 2 * reach, reach)
    return sig.reshape(n_sets, k)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text with their counts: hashes, counts, text numbers. A text of fewer words is one shingle."""
    n = words.counts
    base = np.cumsum(n) - n
    count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    start = np.repeat(base, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    end = np.minimum(start + size, (base + n)[text])
    h = words.sequences(start, end, int(_B))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))), text[at]


def _elements(part: pa.RecordBatch, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, their weights and the numbers of their texts."""
    h, count, text = shingle_sets(_words_of(part))
    return h, count if weighted else np.ones(len(h), dtype=np.int64), text


def _units(h: np.ndarray, weight: np.ndarray, text: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Elements in the order of their texts, an integer weight being as many; how many each text has and where they end; and
    the node of each text, a 128-bit hash of all of them."""
    unit = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    h, text = np.repeat(h, weight), np.repeat(text, weight)
    h = np.where(unit > 0, mix64(h + _C * unit.astype(np.uint64)), h)
    size = np.bincount(text, minlength=rows)
    ends = np.cumsum(size)
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h ^ c), dtype=np.uint64)]) for c in (_A, _B))
    one, two = (mix64(x[ends] - x[ends - size] + size.astype(np.uint64)) for x in (one, two))
    return h, size, ends, [one[i].tobytes() + two[i].tobytes() if size[i] else None for i in range(rows)]


_SKETCHED = "doc_id long, row long, node binary, keys array<long>"


def _sketch(weighted: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            rows = part.num_rows
            h, weight, text = _elements(part, weighted)
            sig = darts(h, weight.astype(np.float64), text, rows)
            keys = np.zeros((rows, BANDS), dtype=np.uint64)
            for r in range(ROWS):
                keys = mix64(keys * _A + sig.reshape(rows, BANDS, ROWS)[:, :, r] + np.arange(1, BANDS + 1, dtype=np.uint64))
            _, _, _, nodes = _units(h, weight, text, rows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(nodes, pa.binary()), lists], names=["doc_id", "row", "node", "keys"])

    return run


def _payload(weighted: bool):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=1 << 20):
            h, size, ends, nodes = _units(*_elements(part, weighted), part.num_rows)
            sets = [np.sort(h[e - n : e]).tobytes() for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(size.astype(np.int32)), pa.array(sets, pa.binary())], names=["node", "n", "shingles"])

    return run


class _Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def linked(sets: list[np.ndarray], similarity: float, labels: list | None = None) -> list[int]:
    """For each set of distinct numbers the first set of its component, where sets with a Jaccard similarity of
    `similarity` or more are linked, and those with one label are from the start.

    Two such sets share one of the rarest numbers of either, so only lists of these are read; what they give is compared
    whole unless it is joined already. The set with most shared numbers goes first; of the largest component
    that it leaves, no other set needs its own turn.
    """
    g = len(sets)
    size = np.fromiter(map(len, sets), dtype=np.int64, count=g)
    owner, ends = np.repeat(np.arange(g), size), np.cumsum(size)
    kinds, number = np.unique(np.concatenate(sets), return_inverse=True)
    uses = np.bincount(number)
    number = number[np.lexsort((number, uses[number], owner))]  # each set's rarest first
    place = np.arange(len(number)) - np.repeat(ends - size, size)
    head = place < np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, size)
    order = np.flatnonzero(head)
    order = order[np.argsort(number[order], kind="stable")]
    lists, begin = owner[order], np.searchsorted(number[order], np.arange(len(kinds) + 1))
    forest, done, mark = _Forest(g), np.zeros(g, dtype=bool), np.zeros(len(kinds), dtype=bool)
    first: dict = {}
    for i, k in enumerate(labels or ()):
        forest.join(i, first.setdefault(k, i))
    roots = np.array([forest.find(i) for i in range(g)])

    def turn(i: int) -> None:
        done[i] = True
        own = number[ends[i] - size[i] : ends[i]]
        heads = own[: np.count_nonzero(head[ends[i] - size[i] : ends[i]])]
        n = begin[heads + 1] - begin[heads]
        at = np.repeat(begin[heads] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        near = np.unique(lists[at])
        near = near[(roots[near] != roots[i]) & (np.minimum(size[near], size[i]) >= similarity * np.maximum(size[near], size[i]) - 1e-9)]
        if not len(near):
            return
        mark[own] = True
        n = size[near]
        at = np.repeat(ends[near] - n - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.add.reduceat(mark[number[at]].astype(np.int64), np.cumsum(n) - n)
        mark[own] = False
        for j in near[both >= similarity * (n + size[i] - both) - 1e-9].tolist():
            forest.join(i, j)

    shared = np.add.reduceat(uses[number], ends - size)
    turn(int(shared.argmax()))
    while True:
        roots = np.array([forest.find(i) for i in range(g)])
        rest = np.flatnonzero(~done & (roots != np.bincount(roots).argmax()))
        if not len(rest):
            return roots.tolist()
        for i in rest[:64].tolist():
            turn(i)


def _link_groups(similarity: float):
    """Rows come sorted by group; a row for each node whose component in the group has another, with the first of it."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, labels, sets = None, [], [], []

        def send() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                first = linked(sets, similarity, labels)
                at = [i for i, r in enumerate(first) if labels[r] != labels[i]]
                if at:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in at], pa.binary()), pa.array([nodes[first[i]] for i in at], pa.binary())], names=["a", "b"])

        for batch in batches:
            for group, node, label, blob in zip(*(batch.column(c).to_pylist() for c in ("group", "node", "label", "shingles")), strict=True):
                if group != now:
                    yield from send()
                    now, nodes, labels, sets = group, [], [], []
                if not nodes or node != nodes[-1]:
                    nodes.append(node)
                    labels.append(label)
                    sets.append(np.frombuffer(blob, dtype="<u8"))
        yield from send()

    return run


def _link_leaders(similarity: float):
    """Rows come sorted by leader, the leader itself first; the pairs of it and a node that are linked."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for leader, salt, node, blob in zip(*(batch.column(c).to_pylist() for c in ("leader", "salt", "node", "shingles")), strict=True):
                other = np.frombuffer(blob, dtype="<u8")
                if node == leader:
                    now, own = (leader, salt), other
                elif now == (leader, salt) and min(len(own), len(other)) >= similarity * max(len(own), len(other)) - 1e-9:
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int(np.count_nonzero(own[at] == other))
                    if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                        a.append(leader)
                        b.append(node)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges (a, b), by least neighbours and jumps."""
    both = save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        next_ = labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("top"))
        next_ = save(next_.join(up, "new", "left").select("node", F.least("new", F.coalesce("top", "new")).alias("label"), "old"), "labels")
        changed = next_.where("label <> old").limit(1).count()
        labels = next_.select("node", "label")
        if not changed:
            return labels


def _over_buckets(members: DataFrame, **each: tuple) -> DataFrame:
    """key, salt and values over whole buckets, given as name=(column, F.min, F.max or F.sum). A bucket's nodes are dealt
    by salt, so that a large one is in no single task: at most SALTS rows of a bucket meet."""
    heads = members.groupBy("key", "salt").agg(*(how(c).alias(k) for k, (c, how) in each.items()))
    whole = Window.partitionBy("key")
    return heads.select("key", "salt", *(how(k).over(whole).alias(k) for k, (_, how) in each.items()))


def _compare_with_leaders(pairs: DataFrame, payload: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among pairs (leader, node). A leader of many is sent to as many tasks as they need."""
    sizes = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / WITH_LEADER).cast("int").alias("salts"))
    mine = pairs.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    # the leader's number of parts reaches its nodes by way of the parts, as the leader may be that of many
    parts = mine.groupBy("leader", "part").agg(F.lit(1).alias("one")).drop("one").join(sizes, "leader")
    mine = mine.join(parts, ["leader", "part"]).select("leader", "node", F.pmod(F.xxhash64("node", "leader"), F.col("salts")).cast("int").alias("salt"))
    own = sizes.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = mine.unionByName(own).join(payload, "node").select("leader", "salt", "node", "shingles")
    sorted_ = rows.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("node") != F.col("leader"))
    return sorted_.mapInArrow(_link_leaders(similarity), "a binary, b binary")


def _compare_buckets(members: DataFrame, payload: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join components (label) within buckets: members (key, salt, node, label). Of buckets with the same
    nodes one is taken; one of more than BLOCK nodes is cut into blocks, and each two of these are compared in a task."""
    sized = members.join(payload.select("node", "n"), "node")
    h = F.xxhash64("node", "label")
    whole = _over_buckets(sized, nodes=(F.lit(1), F.sum), size=(F.col("n").cast("long"), F.sum), one=(F.pmod(h, F.lit(1 << 40)), F.sum), lo=(h, F.min), hi=(h, F.max))
    same = whole.groupBy("nodes", "one", "lo", "hi").agg(F.min("key").alias("chosen"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK, F.col("size") / BLOCK_SHINGLES)).cast("int")
    kept = whole.join(same, ["nodes", "one", "lo", "hi"]).where("key = chosen").select("key", "salt", blocks.alias("blocks"))
    mine = members.join(kept, ["key", "salt"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR other <> block")
    group = F.concat_ws("/", "key", F.least("block", "other"), F.greatest("block", "other"))
    rows = placed.select("node", "label", group.alias("group")).join(payload, "node").select("group", "node", "label", "shingles")
    return rows.repartition("group").sortWithinPartitions("group", "node").mapInArrow(_link_groups(similarity), "a binary, b binary")


def link(texts: DataFrame, sketched: DataFrame, similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame | None:
    """node, label for nodes (distinct shingle sets) with a link, None if there is none.

    Candidates share a band. In ROUNDS rounds the nodes of each bucket are compared with a leader, its smallest or one
    by a hash, unless they are joined already: a bucket of near copies costs a comparison each. What is still
    in several components is then compared within its bucket, each two nodes of different components. Shingles
    of the candidates alone are made again from their texts, since all documents' would take more room than the texts.
    """
    some = sketched.where("node IS NOT NULL")
    members = some.select("node", F.explode("keys").alias("key")).distinct().withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    whole = _over_buckets(members, size=(F.lit(1), F.sum), leader=(F.col("node"), F.min)).where("size > 1")
    shared = save(members.join(whole, ["key", "salt"]).select("key", "salt", "node", "leader"), "buckets")
    if not shared.limit(1).count():
        return None
    reps = some.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("one"))
    reps = reps.select(F.col("one.doc_id").alias("doc_"), F.col("one.row").alias("row_"))
    payload = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("doc_")) & (F.col("row") == F.col("row_")), "left_semi")
    payload = save(payload.mapInArrow(_payload(weighted), "node binary, n int, shingles binary").dropDuplicates(["node"]), "payload")
    edges, labels = None, None
    for k in range(ROUNDS + 1):
        if labels is None:
            found = _compare_with_leaders(shared.where("node <> leader").select("leader", "node").distinct(), payload, similarity)
        else:
            now = shared.select("key", "salt", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            leader = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "label")
            open_ = _over_buckets(now, lo=(F.col("label"), F.min), hi=(F.col("label"), F.max), leader=(leader, F.min)).where("lo <> hi")
            shared = save(now.join(open_, ["key", "salt"]).select("key", "salt", "node", "label", "leader"), "open")
            if not shared.limit(1).count():
                break
            if k < ROUNDS:
                found = _compare_with_leaders(shared.where("label <> leader.label").select("leader.node", "node").toDF("leader", "node").distinct(), payload, similarity)
            else:
                found = _compare_buckets(shared.select("key", "salt", "node", "label"), payload, similarity)
        found = save(found, "links")
        if found.limit(1).count():
            edges = found if edges is None else edges.unionByName(found)
            labels = components(edges)
        elif labels is None:
            labels = found.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels if edges is not None else None


def _classes(docs: DataFrame, similarity: float, weights: str) -> DataFrame:
    """doc_id, row (xxhash64 of the text), class_id, class_row and class_size of each document."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.xxhash64(text).alias("row"), text.alias("text"))
    sketched = save(texts.mapInArrow(_sketch(weights == "count"), _SKETCHED), "sketched")
    labels = link(texts, sketched, similarity, weights == "count")
    rows = sketched.where("node IS NOT NULL").select("doc_id", "row", "node")
    best = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    by_node = rows.groupBy("node").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    classes = by_node
    if labels is not None:
        labelled = save(by_node.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        whole = labelled.groupBy("label").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        classes = labelled.select("node", "label").join(whole, "label").select("node", "best", "size")
    alone = sketched.where("node IS NULL").select("doc_id", "row", F.col("doc_id").alias("class_id"), F.col("row").alias("class_row"), F.lit(1).cast("long").alias("class_size"))
    found = rows.join(classes, "node").select("doc_id", "row", F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("class_row"), F.col("size").alias("class_size"))
    return found.unionByName(alone)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """A row per document: doc_id, class_id (the smallest doc_id of its class), class_size.

    Classes are the components of the links between texts whose five-word shingles have a weighted Jaccard
    similarity of `similarity` or more: a shingle's weight is the number of times that the text has it, or 1 with
    weights="set". Words are separated by ASCII white space; a text of one to four words is one shingle; a null
    text or one without words is linked to none. Texts with the same shingles are one node. Links are verified on
    the whole sets of 64-bit shingle hashes. Long texts are read whole; a tie at exactly `similarity` is a link;
    repeated rows are of one class. A null doc_id is never a class_id, unless its class has no other.
    """
    return _classes(docs, similarity, weights).drop("row", "class_row")


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, weights: str = "count") -> DataFrame:
    """The rows of docs that stand for their class: of its smallest doc_id, one text. Every column of docs. Rows that repeat
    the doc_id and the text of what stays, stay as well."""
    found = _classes(docs, similarity, weights)
    same = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))
    kept = found.where(same).select(F.col("doc_id").alias("_nd_id"), F.col("row").alias("_nd_row")).distinct()
    row = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_nd_id"]) & (row == kept["_nd_row"]), "left_semi")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents. A null or empty text is alone; long texts are read whole; ties at the
    limit are links; repeated rows are of one class."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
