"""Near-duplicate documents by a chosen-path similarity join.

Every document becomes its set of word shingles and a vector of minwise tokens (the minimum of the set under
each of ``TOKENS`` hash functions). A tree branches a document by a few selected tokens per level: documents
that agree in a selected token share a child. Nodes of at most ``LEAF`` documents are compared
exhaustively on full sets, larger ones branch again. The number of trees follows from the target recall: pairs lose
common nodes at every level, so documents of nodes that branch again get further trees.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage, whole_groups
from textreg.llm.components import components

TOKENS = 128
LEAF = 512
PIVOTS = 4
START_DEPTH = 2
MAX_DEPTH = 8
#: A large node is compared exactly where that takes at most this many copies of each row; else it branches.
COPIES = 8
#: Candidates may estimate as many standard deviations below the threshold.
SLACK = 5

_MASK = (1 << 64) - 1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _factors(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(str(i), seed=11) | 1 for i in range(n)], dtype=np.uint64)


def shingle_set(text: str | None, width: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter text is one shingle, one without words none."""
    # bytes.lower() maps A-Z only and bytes.split() splits at [\x20\x09-\x0D]+.
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    size = min(width, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k, factor in enumerate(_factors(size)):
        out += h[k : len(h) - size + 1 + k] * factor
    return np.unique(_mix(out))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, factors = _WordHashes(), _factors(TOKENS)[:, None]
        for batch in batches:
            ids, sizes, keys, sigs, briefs = batch.column(0), [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width, words)
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    least = np.full(TOKENS, _MASK, np.uint64)
                    for at in range(0, len(s), 4096):
                        np.minimum(least, (factors * s[None, at : at + 4096]).min(axis=1), out=least)
                    tokens = (least >> np.uint64(32)).astype("<u4")
                    sigs.append(tokens.tobytes())
                    briefs.append((tokens & 0xFF).astype(np.uint8).tobytes())
                else:
                    sigs.append(None)
                    briefs.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (keys, sigs, briefs)]],
                names=["id", "n", "key", "sig", "brief"],
            )

    return run


def _chosen(node: np.ndarray, level: int, similarity: float) -> np.ndarray:
    """Token positions by which each node branches: one, and a second for a share of the nodes.

    The mean is ``1 / similarity``, so a pair at the threshold keeps one common child per level on average. -1: none.
    """
    h = _mix(node + np.uint64(level * 0x9E3779B97F4A7C15 & _MASK))
    first = (h % np.uint64(TOKENS)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(16)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    again = (h >> np.uint64(40)) % np.uint64(1 << 20) < np.uint64(int((1 / similarity - 1) * (1 << 20)))
    return np.stack([first, np.where(again, second, -1)], axis=1)


def _branch(nodes: np.ndarray, rows: np.ndarray, sig: np.ndarray, level: int, similarity: float):
    """Children of each (node, row): the node and the chosen token's value hashed."""
    at = _chosen(nodes, level, similarity)
    parts = []
    for k in range(2):
        ok = at[:, k] >= 0
        token = sig[rows[ok], at[ok, k]].astype(np.uint64)
        parts.append((_mix(_mix(nodes[ok] + np.uint64(at[ok, k] + 1) * np.uint64(0xD6E8FEB86659FD93)) + token), rows[ok]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, TOKENS)


def _first_nodes(trees: range, early: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig, ids = _sig_matrix(part.column(1)), part.column(0).to_numpy()
                for tree in trees:
                    rows = np.arange(len(ids))
                    nodes = _mix(np.full(len(ids), tree + 1, np.uint64))
                    for level in range(START_DEPTH):
                        nodes, rows = _branch(nodes, rows, sig, level, similarity)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes.view(np.int64)), pa.array(ids[rows]), pa.array(np.full(len(rows), tree < early))],
                        names=["node", "id", "early"],
                    )

    return run


def _next_nodes(level: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes, rows = _branch(
                    batch.column(0).to_numpy().view(np.uint64), np.arange(batch.num_rows),
                    _sig_matrix(batch.column(2)), level, similarity,
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes.view(np.int64)), pa.array(batch.column(1).to_numpy()[rows]),
                        pa.array(np.zeros(len(rows), bool)),
                    ],
                    names=["node", "id", "early"],
                )

    return run


class _Groups:
    """Union-find over small integers."""

    def __init__(self, labels: np.ndarray):
        first: dict[int, int] = {}
        self.of = [first.setdefault(x, i) for i, x in enumerate(labels.tolist())]

    def find(self, i: int) -> int:
        while self.of[i] != i:
            self.of[i] = self.of[self.of[i]]
            i = self.of[i]
        return i

    def outside_largest(self) -> np.ndarray:
        of = np.array([self.find(i) for i in range(len(self.of))])
        return np.flatnonzero(of != np.bincount(of).argmax())

    def join(self, i: int, j: int) -> bool:
        a, b = self.find(i), self.find(j)
        self.of[max(a, b)] = min(a, b)
        return a != b


def _likely(floor: float):
    """Rows of each cell that look similar to a row of another component, by their minwise tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "cell"):
            sig = np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, TOKENS)
            label = table.column("root").to_numpy()
            keep = np.zeros(table.num_rows, bool)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a == 2:
                    keep[a:b] = label[a] != label[a + 1] and np.count_nonzero(sig[a] == sig[a + 1]) >= floor
                elif b - a > 2:
                    for i in range(a, b - 1):
                        hit = ((sig[i] == sig[i + 1 : b]).sum(axis=1) >= floor) & (label[i + 1 : b] != label[i])
                        if hit.any():
                            keep[i] = True
                            keep[i + 1 : b] |= hit
            kept = table.select(["cell", "id", "early"]).filter(pa.array(keep))
            yield from kept.to_batches()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shingle_set(t.as_py(), width, words).tobytes() for t in part.column(1)], pa.binary())],
                    names=["id", "shingles"],
                )

    return run


def overlaps(sets: list[np.ndarray], rows: np.ndarray | None = None) -> np.ndarray:
    """Intersection sizes of the given rows (all by default) with all sets, by columns of the shingles that two sets have."""
    n = len(sets)
    rows = np.arange(n) if rows is None else rows
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(every) else np.empty(0, bool)
    dense = np.cumsum(shared) - 1
    ok = shared[column] if len(every) else np.empty(0, bool)
    column, owner = dense[column[ok]] if len(every) else column, owner[ok]
    out = np.zeros((len(rows), n), np.int64)
    width = 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((n, width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        out += np.rint(block[rows] @ block.T).astype(np.int64)
    return out


def _verified(percent: int):
    """A spanning set of the links of each cell, confirmed on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, "cell", 512):
            ids, labels, raw = table.column("id").to_numpy(), table.column("root").to_numpy(), table.column("shingles")
            us, vs = [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(raw[i].as_py(), np.uint64) for i in range(a, b)]
                groups = _Groups(labels[a:b])
                # A few rows tie a crowd of copies together; then every row outside the largest group meets all rows.
                for rows in (lambda: np.arange(min(8, b - a)), groups.outside_largest):
                    for i, j in _linked(sets, rows(), percent):
                        if groups.join(i, j):
                            us.append(int(ids[a + i]))
                            vs.append(int(ids[a + j]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _linked(sets: list[np.ndarray], rows: np.ndarray, percent: int) -> list[tuple[int, int]]:
    if not len(rows):
        return []
    sizes = np.array([len(s) for s in sets])
    common = overlaps(sets, rows)
    union = sizes[rows][:, None] + sizes[None, :] - common
    return [(int(rows[i]), j) for i, j in np.argwhere(100 * common >= percent * union).tolist() if rows[i] != j]


def _meets(similarity: float, depth: int) -> float:
    """Probability that a pair at the threshold has a common node of one tree at ``depth``."""
    meets = 1.0
    for _ in range(depth):
        once = similarity * meets
        two = 1 / similarity - 1
        meets = (1 - two) * once + two * (1 - (1 - once) ** 2)
    return meets


def trees_for(recall: float, similarity: float, depth: int = START_DEPTH) -> int:
    """Trees after which a pair at the threshold has met in a common node with probability ``recall``."""
    meets = _meets(similarity, depth)
    return 1 if meets >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def deep_trees_for(recall: float, similarity: float, trees: int) -> int:
    """Trees for documents of nodes that branch down to ``MAX_DEPTH``.

    A pair is missed if it does not meet in the first ``trees`` trees at ``START_DEPTH``, or, where these branch on, in any
    tree at ``MAX_DEPTH``. Both together stay within ``1 - recall``.
    """
    missed = (1 - _meets(similarity, START_DEPTH)) ** trees
    if missed > 0.9 * (1 - recall):
        return deep_trees_for(recall, similarity, trees + 1)
    return max(trees, trees_for(recall + missed, similarity, MAX_DEPTH))


def _sorted_cells(df: DataFrame) -> DataFrame:
    return df.repartition("cell").sortWithinPartitions("cell")


_NODE = "node bigint, id bigint, early boolean"


class _Join:
    """One similarity join: the staged signatures, and the steps that turn tree nodes into confirmed links."""

    def __init__(self, sigs: DataFrame, percent: int):
        self.sigs, self.percent = sigs, percent
        similarity = percent / 100
        self.floor = max(1.0, TOKENS * similarity - SLACK * math.sqrt(TOKENS * similarity * (1 - similarity)))

    def crowded(self, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Nodes that hold documents of at least two components, with their rows' labels and sizes."""
        sizes = (
            with_roots(nodes, roots).groupBy("node")
            .agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
            .filter("n > 1 AND low != high").select("node", "n")
        )
        return stage(with_roots(nodes, roots).join(sizes, "node"), "crowded")

    def cells(self, crowded: DataFrame, pivots: DataFrame) -> DataFrame:
        """Bounded sets of rows to compare: small nodes as they are, large ones in chunks beside their pivots.

        ``pivots`` has the pivot rows of large nodes with the block they belong to; each block meets each chunk.
        """
        small = crowded.filter(F.col("n") <= LEAF).select(F.col("node").alias("cell"), "id", "root", "early")
        chunks = F.ceil(F.col("n") / LEAF).cast("bigint")
        members = crowded.filter(F.col("n") > LEAF).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks)).join(
            pivots.select("node", "block").distinct(), "node"
        )
        beside = pivots.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)))
        return small.unionByName(
            members.select(*beside.columns).unionByName(beside)
            .select(F.xxhash64("node", "chunk", "block").alias("cell"), "id", "root", "early").distinct()
        )

    def likely(self, cells: DataFrame) -> DataFrame:
        """Rows of the cells that look similar to a row of another component, staged."""
        # One byte of each token is enough to estimate; two different tokens agree in it once in 256.
        with_sig = _sorted_cells(cells.join(self.sigs.select("id", "brief"), "id").select("cell", "id", "root", "early", "brief"))
        return stage(with_sig.mapInArrow(_likely(self.floor), "cell bigint, id bigint, early boolean"), "likely")

    def links(self, likely: DataFrame, sets: DataFrame, roots: DataFrame | None) -> DataFrame:
        """Confirmed links of the cells that still hold several components, staged."""
        open_ = self.crowded(likely.select(F.col("cell").alias("node"), "id", "early"), roots)
        full = _sorted_cells(
            open_.select(F.col("node").alias("cell"), "id", "root").join(sets, "id").select("cell", "id", "root", "shingles")
        )
        return stage(full.mapInArrow(_verified(self.percent), "u bigint, v bigint"), "links")

    def settled(self, crowded: DataFrame, pivots: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
        """Roots after the comparisons inside the nodes' cells."""
        return joined(roots, self.links(self.likely(self.cells(crowded, pivots)), sets, roots))

    def few_pivots(self, crowded: DataFrame) -> DataFrame:
        """A few rows of each large node, by the least of several hashes: they tie a crowd of copies together."""
        picks = [F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(k))) for k in range(PIVOTS)]
        large = crowded.filter(F.col("n") > LEAF)
        return (
            large.groupBy("node", "n", "early").agg(F.array_distinct(F.array(*picks)).alias("p"))
            .select("node", "n", "early", F.explode("p").alias("p"), F.lit(0).cast("bigint").alias("block"))
            .select("node", "n", "p.id", "p.root", "early", "block")
        )

    def all_pivots(self, crowded: DataFrame) -> DataFrame:
        """Every row outside the largest component of its node, in blocks: no link across components is left out."""
        large = crowded.filter(F.col("n") > LEAF)
        main = large.groupBy("node", "root").count().groupBy("node").agg(
            F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most")
        )
        others = F.col("all") - F.col("most")
        blocks = F.ceil(others / LEAF).cast("bigint")
        copies = blocks + others * F.ceil(F.col("n") / LEAF) / F.col("n")
        return (
            large.join(main, "node").filter("root != main")
            .select("node", "n", "id", "root", "early", F.pmod(F.xxhash64("id", F.lit(7)), blocks).alias("block"), copies.alias("copies"))
        )


def with_roots(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after more links: the stars found so far stand for the earlier ones."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("id").alias("u"), F.col("root").alias("v")).unionByName(links))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    recall: float = 0.99999,
    first_trees: int = 3,
) -> DataFrame:
    """Components of documents whose shingle sets have ``100 * |A & B| >= percent * |A | B|``.

    Returns one row per document: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id it reaches,
    itself included) and ``kept`` (it is that document).

    Copies with equal sets are folded into one representative by an aggregation first. The first trees link most
    duplicates; nodes of one component have nothing more to tell and leave the later trees. Large nodes are never
    collected: the first trees compare them in chunks that share a few pivots; in later trees they branch on (their
    documents in more trees, so that the recall holds at every depth), and those still large at ``MAX_DEPTH`` are compared exactly, every row outside the node's largest component
    against all rows, block by block. Only full sets confirm a link. A cell holds at most a few times ``LEAF`` sets.

    Null and empty texts and texts of white space have no shingles and are linked with nothing. A row without an
    id stands alone with a null component and is kept. Rows that share an id are one vertex. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100: a node has one or two children per document")
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage(docs.mapInArrow(_signatures(width), "id bigint, n bigint, key binary, sig binary, brief binary"), "signatures")
    linked = signed.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    least = linked.groupBy("key").agg(F.min("id").alias("rep"))
    sigs = stage(
        linked.join(least, "key").filter("id = rep").select("id", "sig", "brief").dropDuplicates(["id", "sig"]), "representatives"
    )
    join, similarity = _Join(sigs, percent), percent / 100
    trees = max(first_trees + 1, trees_for(recall, similarity))

    nodes = sigs.select("id", "sig").mapInArrow(_first_nodes(range(trees), first_trees, similarity), _NODE)
    crowded = join.crowded(nodes, None)
    likely = join.likely(join.cells(crowded, join.few_pivots(crowded)))
    large = crowded.filter(F.col("n") > LEAF).select("node", "id")
    wanted = likely.select("id").unionByName(large.select("id")).distinct()
    # The one pass that moves texts; sorting both sides is the plan that holds when many documents are wanted.
    sets = stage(
        docs.join(wanted.hint("merge"), "id", "left_semi").select("id", "text").mapInArrow(_sets(width), "id bigint, shingles binary"),
        "sets",
    )
    edges = join.links(likely.filter("early"), sets, None)
    roots = components(edges)
    roots = joined(roots, join.links(likely.filter("NOT early"), sets, roots))

    def exactly(large: DataFrame, level: int, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Compare large nodes exactly where that is cheap: the roots after that, and the rows of the other nodes."""
        large = join.crowded(large.withColumn("early", F.lit(False)), roots).filter(F.col("n") > LEAF)
        pivots = stage(join.all_pivots(large), "pivots")
        exact = pivots if level == MAX_DEPTH else pivots.filter(F.col("copies") <= COPIES)
        nodes = exact.select("node").distinct()
        if not exact.isEmpty():
            roots = join.settled(large.join(nodes, "node", "left_semi"), exact.drop("copies"), sets, roots)
        rest = large.join(nodes, "node", "left_anti").select("node", "id").join(sigs, "id").select("node", "id", "sig")
        return roots, stage(rest, "branching")

    # Large nodes have met their pivots only. Compare them exactly where that is cheap, else branch on.
    for level in range(START_DEPTH, MAX_DEPTH + 1):
        roots, rest = exactly(large, level, roots)
        if rest.isEmpty():
            break
        if level == START_DEPTH:
            # Pairs lose common nodes on the way down: the documents that go there get the trees that make up for it.
            more = range(trees, deep_trees_for(recall, similarity, trees))
            crowd = sigs.select("id", "sig").join(rest.select("id").distinct(), "id", "left_semi")
            crowded = join.crowded(crowd.mapInArrow(_first_nodes(more, 0, similarity), _NODE), roots)
            roots = join.settled(crowded, join.few_pivots(crowded), sets, roots)
            roots, others = exactly(crowded.filter(F.col("n") > LEAF).select("node", "id"), level, roots)
            rest = rest.unionByName(others)
        crowded = join.crowded(rest.mapInArrow(_next_nodes(level, similarity), _NODE), roots)
        roots = join.settled(crowded, join.few_pivots(crowded), sets, roots)
        large = crowded.filter(F.col("n") > LEAF).select("node", "id")

    named = linked.select("id", "key").distinct().join(least, "key").join(
        roots.withColumnRenamed("id", "rep"), "rep", "left"
    ).groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("component"))
    return (
        signed.select("id", "n").join(named, "id", "left")
        .select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.coalesce("component", "id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))
    )
