"""SimHash near-dedup: 64-bit fingerprints, a Hamming self-join over a binary trie, and components of its links.

The trie is cut at a depth where its nodes are small. Nodes whose paths differ in at most `budget` bits are node pairs
that may hold links; each is dealt to the lower node's task, which walks the two subtries together bit by bit, adding up
differing bits and dropping a pair of subtries once they exceed the budget. What reaches the leaves is a link. A node that
is too large for a task, with the fingerprints of the nodes near it, is cut again some bits deeper, by itself, and again
until it fits. Each task returns a spanning forest of its links, as only components are asked for, and the forests are
joined by large-star and small-star rounds. All of this runs on distinct fingerprints; copies only meet at the end.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, arrow_batch, heat_join, nullable, written

BITS, SHINGLE, SEED, BUDGET = 64, 3, 42, 2
#: Words of a long text are hashed in blocks of so many shingles, so memory is bounded by the text itself.
BLOCK = 1 << 16
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's 3-word shingles, repeats included; no words: 0."""
    import xxhash

    # On bytes, split() parts at exactly the contract's white space, and bytes of other letters stay as they are.
    words = (text or "").encode().translate(LOWER_BYTES).split()
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        block = words[at : min(at + BLOCK, n) + size - 1]
        joined = b" ".join(block)
        ends = list(accumulate(len(w) + 1 for w in block))
        starts = [0, *ends]
        hashes = np.fromiter((digest(joined[i : j - 1], SEED) for i, j in zip(starts, ends[size - 1 :], strict=False)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: tuple | list = ()) -> DataFrame:
    """(doc_id, the columns in keep, fp) with fp as a signed long."""
    names = ["doc_id", *keep]

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield arrow_batch(batch.select(names), len(fps), [pa.int64()], fp=fps.view(np.int64))

    return docs.select(*names, "text").mapInArrow(work, nullable(docs, names, "fp long"))


def trie_pairs(left: np.ndarray, right: np.ndarray, budget: int = BUDGET, leaf: int = 48) -> np.ndarray:
    """Pairs (left value, right value) within the Hamming budget; both sorted uint64 without repeats.

    A row of the frontier is a pair of subtries (a range of each array) and the bits its paths differ in. At each bit
    every pair splits into its four pairs of children. Pairs with few members are compared directly.
    """
    found = []
    one = np.int64
    a0, a1 = np.zeros(1, one), np.full(1, len(left), one)
    b0, b1, err = np.zeros(1, one), np.full(1, len(right), one), np.zeros(1, one)
    for bit in range(BITS - 1, -2, -1):
        small = ((a1 - a0) * (b1 - b0) <= leaf) if bit >= 0 else np.ones(len(a0), bool)
        if small.any():
            na, nb = (a1 - a0)[small], (b1 - b0)[small]
            total = na * nb
            at = np.repeat(np.arange(len(total)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            x, y = left[a0[small][at] + k // nb[at]], right[b0[small][at] + k % nb[at]]
            near = np.bitwise_count(x ^ y) <= budget
            found.append(np.stack([x[near], y[near]], axis=1))
        keep = ~small
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
        if not len(a0):
            break
        am, bm = _split(left, a0, a1, bit), _split(right, b0, b1, bit)
        a0, a1 = np.concatenate([a0, am, a0, am]), np.concatenate([am, a1, am, a1])
        b0, b1 = np.concatenate([b0, bm, bm, b0]), np.concatenate([bm, b1, b1, bm])
        err = np.concatenate([err, err, err + 1, err + 1])
        keep = (a1 > a0) & (b1 > b0) & (err <= budget)
        a0, a1, b0, b1, err = a0[keep], a1[keep], b0[keep], b1[keep], err[keep]
        if not len(a0):
            break
    return np.concatenate(found) if found else np.empty((0, 2), np.uint64)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where, within each range, the values with a one at the bit begin."""
    pivot = (values[np.minimum(lo, len(values) - 1)] >> np.uint64(bit) | np.uint64(1)) << np.uint64(bit)
    return np.clip(np.searchsorted(values, pivot), lo, hi)


def forest(pairs: np.ndarray) -> np.ndarray:
    """For each node of the links, (node, smallest node of its component): a spanning forest of stars."""
    if not len(pairs):
        return pairs
    nodes, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
    return np.stack([nodes, nodes[root]], axis=1)[root != np.arange(len(nodes))]


#: Guests that a task walks at once, so that what it holds is bounded.
GUESTS = 1 << 16


def walk(pdf: pd.DataFrame, budget: int = BUDGET) -> pd.DataFrame:
    """The links of one node: among its own fingerprints, and between them and its guests."""
    fps = pdf["fp"].to_numpy().view(np.uint64)
    is_home = pdf["home"].to_numpy()
    home, guests = np.sort(fps[is_home]), np.sort(fps[~is_home])
    pairs = trie_pairs(home, home, budget)
    links = forest(pairs[pairs[:, 0] < pairs[:, 1]])
    for at in range(0, len(guests), GUESTS):
        links = forest(np.concatenate([links, trie_pairs(home, guests[at : at + GUESTS], budget)]))
    return pd.DataFrame({"fp": links[:, 0].view(np.int64), "low": links[:, 1].view(np.int64)})


def deeper(rows: DataFrame, depth: int, step: int, budget: int) -> DataFrame:
    """(node, fp, home, err) at `depth` bits to the same `step` bits deeper.

    A node is the bits of a path. A fingerprint is at home in its own node and a guest in nodes near it, err being the bits
    in which its own path differs. A home row visits the nodes below its own in order, so each pair of nodes meets once.
    """
    masks = [m for m in range(1 << step) if m.bit_count() <= budget] if step <= 16 else sorted({0} | {1 << i | 1 << j for i in range(step) for j in range(i + 1)})
    if step > 16 and budget > 2:
        raise ValueError("more than 16 bits at once only within a budget of 2")
    own = F.shiftrightunsigned("fp", BITS - depth - step).bitwiseAND((1 << step) - 1)
    spread = rows.select("node", "fp", "home", "err", own.alias("own"), F.explode(F.array(*[F.struct(F.lit(m).cast("long").alias("bits"), F.lit(m.bit_count()).alias("n")) for m in masks])).alias("mask"))
    visited = F.col("own").bitwiseXOR(F.col("mask.bits"))
    spread = spread.where((F.col("err") + F.col("mask.n") <= budget) & (~F.col("home") | (visited <= F.col("own"))))
    node = F.shiftleft("node", step).bitwiseOR(visited)
    spread = spread.select(node.alias("node"), "fp", (F.col("home") & (F.col("mask.n") == 0)).alias("home"), (F.col("err") + F.col("mask.n")).alias("err"))
    lived_in = rows.where("home").select(F.shiftleft("node", step).bitwiseOR(own).alias("node")).distinct()
    return spread.join(lived_in, "node", "left_semi")


def hamming_links(distinct: DataFrame, budget: int = BUDGET, node_size: int = 4096, most: int = 1 << 19, step: int = 6) -> DataFrame:
    """(fp, low): links that join the distinct fingerprints within the budget to components, low < fp as unsigned values.

    Complete for any setting: node_size (about how many fingerprints are at home in a node of the first cut), most (how many
    rows a task gets at most) and step (bits by which a larger node is cut deeper) only balance the tasks.
    """
    depth = min(24, max(1, int(np.ceil(np.log2(max(1, distinct.count() / node_size))))))
    rows = deeper(distinct.select(F.lit(0).cast("long").alias("node"), "fp", F.lit(True).alias("home"), F.lit(0).alias("err")), 0, depth, budget)
    found = []
    schema = "fp long, low long"
    while True:
        # Only nodes too large for a task are listed.
        large = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("node") if depth < BITS else None
        large = written(large, "large_nodes") if large is not None else None
        if large is None or large.isEmpty():
            found.append(rows.groupBy("node").applyInPandas(lambda pdf: walk(pdf, budget), schema))
            break
        found.append(rows.join(large, "node", "left_anti").groupBy("node").applyInPandas(lambda pdf: walk(pdf, budget), schema))
        width = min(step, BITS - depth)
        rows = written(deeper(written(rows.join(large, "node", "left_semi"), "large_rows"), depth, width, budget), "deeper_rows")
        depth += width
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the links but the roots, the smallest node (as signed longs) of its component.

    Large-star and small-star until nothing changes; each round is written, so a lost executor costs one round at most.
    A node of very many links is broadcast with its lowest neighbour instead of being one task's.
    """
    edges = written(links.select(F.col("fp").alias("u"), F.col("low").alias("v")).where("u <> v").distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        large = heat_join(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = written(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "down")
        low = written(down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        small = heat_join(down, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def simhash_groups(docs: DataFrame, budget: int = BUDGET, keep: tuple | list = ()) -> DataFrame:
    """(doc_id, the columns in keep, fp, root, component_id), one row for each row of docs.

    fp is the fingerprint as a signed long and root the component's smallest fingerprint. component_id is the smallest
    doc_id whose fingerprint is reachable by links of at most `budget` bits, itself included. Texts without words, null
    or empty, have fingerprint 0 and are linked as any other; very long texts are read as a whole. Rows that repeat a doc_id
    or a text are linked by their fingerprints, ties need no order, and an empty table gives an empty one. Other columns are
    not read. A row without doc_id takes part; its component_id is null only if no row of the component has an id.
    """
    prints = written(fingerprints(docs, keep), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fps")
    roots = components(hamming_links(distinct.select("fp"), budget))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    table = written(rooted.select("fp", "root").join(lowest, "root"), "components")
    return prints.join(table, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    groups = simhash_groups(docs)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SQL = None
