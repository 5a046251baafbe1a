"""Near-duplicate detection with BagMinHash signatures.

A document is the multiset of its five-word shingles; two are near-duplicates if the weighted
Jaccard similarity of their multisets is 0.8 or more. BagMinHash: each shingle owns a tower of
Poisson processes over the weights (0,1], (1,2], (2,4], ...; a point's position in its interval is
read bit by bit, each bit choosing a half, and counts only below the document's weight. The
earliest point in each of SIZE components is the signature, so two signatures agree in a component
with a probability equal to the weighted Jaccard similarity, without bias. Points are drawn in
order of time and stop once they are later than every component's best.

1. Documents with equal words are one node, by 128 bits of digest; exact copies cost nothing further.
2. BANDS bands of ROWS components put nodes into buckets; only buckets of several nodes go on, and one
   text of each of their nodes is fetched, once.
3. First pass: each node is verified against one hub, the node that is the least in most of its buckets.
   In a group of near copies this settles nearly all, in as many comparisons as there are nodes.
4. Second pass: buckets that still hold several classes are compared whole, but that nodes of the bucket's
   largest class are not compared with each other. Larger buckets are dealt into blocks of bounded size,
   and every block meets every other in a task of its own. A task first compares signatures (a pair counts
   in the first band that it shares only), a second one the multisets of the pairs that may reach
   SIMILARITY. Pairs are rows of no table: tasks take nodes and return the links that connect them.
5. Links are merged to connected components; a class is named by its smallest doc_id.

A pair at similarity 0.8 shares no bucket with probability (1 - 0.8^5)^32 = 3e-6, and falls below ESTIMATE with
less than 1e-6; all other pairs at 0.8 are verified, or their ends are connected by verified links. Where
a bucket holds many different texts that are not linked, the comparisons grow with the square of their number.

Edge cases: fewer than five words are one shingle; texts without words match only the same text, and
null and empty texts match nothing; rows with a null id belong to their text's class and never name
it; repeated rows are copies of each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import delete_shared, fresh, slices, utf8, words, write_shared
from lexiloom.llm.components import components
from lexiloom.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
#: Signatures (whose agreement has a standard deviation of 0.032 at 0.8) that agree less are not verified.
ESTIMATE = 0.64
#: Nodes, and bytes of their texts, in a block of a bucket.
BLOCK, BLOCK_BYTES = 1024, 4 << 20
#: Bytes of text in a file of the texts fetched.
FILE_BYTES = 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0xC2B2AE3D27D4EB4F)


def multiset(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text's word hashes, sorted, and their counts."""
    return np.unique(shingle_hashes(hashes, SHINGLE), return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """16-bit BagMinHash signatures of multisets, one row each."""
    items = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    weights = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    best = np.full(len(bags) * size, np.inf)
    level, low, high = 0, 0, 1  # the interval (low, high] of weights
    while len(items):
        state = mix(items + np.uint64(int(_MARK) * (level + 1) % (1 << 64)))
        time = np.zeros(len(items))
        own, weight = owner, weights
        table = best.reshape(-1, size)
        latest = table.max(1)
        while len(own):
            state = state + _STEP
            draw = mix(state)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * (high - low))
            point = mix(draw ^ _MARK)
            component = ((point >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            place = low + 1 + ((point & np.uint64(0xFFFFFFFF)) * np.uint64(high - low) >> np.uint64(32)).astype(np.int64)
            early = time < latest[own]
            counts = early & (place <= weight)
            np.minimum.at(best, own[counts] * size + component[counts], time[counts])
            touched = own[np.diff(own, prepend=-1) > 0]
            latest[touched] = table[touched].max(1)
            keep = time < latest[own]
            own, weight, state, time = own[keep], weight[keep], state[keep], time[keep]
        more = weights > high
        items, weights, owner = items[more], weights[more], owner[more]
        level, low, high = level + 1, high, 2 * high
    bits = best.astype(np.float32).view(np.uint32).astype(np.uint64)
    return (mix(bits + _STEP) >> np.uint64(48)).astype(np.uint16).reshape(-1, size)


def node_key(raw: bytes | None) -> bytes | None:
    """What equal documents share: a digest of the words, or of the text if it has none; null for empty texts."""
    if not raw:
        return None
    tokens = words(raw)
    return hashlib.md5(b" ".join(tokens) if tokens else b"\0" + raw).digest()


_SIGNED = "id long, tag long, low long, high long, size long, sign binary"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tag, raw) to ids with the node's key in two halves, the text's size and, once a batch for each node that has words, the signature."""
    for batch in batches:
        raws = [x.as_py() or b"" for x in batch.column(2)]
        keys, signs = [node_key(x) for x in raws], [None] * len(raws)
        first: dict = {}
        for i, key in enumerate(keys):
            if key is not None:
                first.setdefault(key, i)
        chosen = sorted(first.values())
        for a, b in slices([raws[i] for i in chosen]):
            part = chosen[a:b]
            hashes, offsets = word_hashes([raws[i] for i in part])
            bags = [multiset(hashes[s:e]) for s, e in zip(offsets, offsets[1:])]
            for i, bag, sign in zip(part, bags, signatures(bags)):
                signs[i] = sign.tobytes() if len(bag[0]) else None
        half = lambda k: pa.array([None if x is None else int.from_bytes(x[k : k + 8], "little", signed=True) for x in keys], pa.int64())
        columns = [batch.column(0), batch.column(1), half(0), half(8), pa.array([len(x) for x in raws], pa.int64()), pa.array(signs, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "low", "high", "size", "sign"])


def elements(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A multiset as a set: each shingle with the number of its occurrence. Overlap and Jaccard similarity stay the same."""
    starts = np.cumsum(bag[1]) - bag[1]
    place = np.arange(int(bag[1].sum())) - np.repeat(starts, bag[1])
    return mix(np.repeat(bag[0], bag[1]) + place.astype(np.uint64) * _STEP).astype(np.int64)


class _Forest:
    """Classes of the numbers below n, and the links that made them."""

    def __init__(self, labels: np.ndarray) -> None:
        _, self.of = np.unique(labels, return_inverse=True)
        self.links: list[tuple[int, int]] = []

    def link(self, u: int, v: int) -> None:
        a, b = self.of[u], self.of[v]
        if a != b:
            self.of[self.of == b] = a
            self.links.append((u, v))


_PAIRED = "bucket long, a int, b int, node long, root long, partners array<long>"


def _candidates(table: pa.Table) -> pa.Table:
    """Of the nodes of a block, or of two: those with partners of other classes whose signatures agree enough."""
    node, root, own = (table.column(c).to_numpy() for c in ("node", "root", "own"))
    signs = np.frombuffer(b"".join(x.as_py() for x in table.column("sign")), np.uint16).reshape(-1, SIZE)
    bucket, band, a, b = (table.column(c)[0].as_py() for c in ("bucket", "band", "a", "b"))
    order = np.argsort(node)
    node, root, own, signs = node[order], root[order], own[order], signs[order]
    partners: dict[int, np.ndarray] = {}
    every = np.arange(len(node))
    least = np.uint8(np.ceil(ESTIMATE * SIZE - 1e-9))
    for u in every[own == a]:
        other = every[(root != root[u]) & ((own == b) if a != b else (every > u))]
        same = signs[other] == signs[u]
        likely = same.sum(1, dtype=np.uint8) >= least
        other, same = other[likely], same[likely].reshape(-1, BANDS, ROWS).all(2)
        other = other[same.argmax(1) == band]
        if len(other):
            partners[int(u)] = node[other]
    wanted = np.zeros(len(node), bool)
    wanted[list(partners)] = True
    wanted |= np.isin(node, np.concatenate([*partners.values(), node[:0]]))
    kept = every[wanted]
    n = len(kept)
    return pa.table(
        {
            "bucket": np.full(n, bucket, np.int64), "a": np.full(n, a, np.int32), "b": np.full(n, b, np.int32), "node": node[kept], "root": root[kept],
            "partners": pa.array([partners.get(int(u), node[:0]) for u in kept], pa.list_(pa.int64())),
        }
    )


def _verified(table: pa.Table) -> pa.Table:
    """Of nodes with texts and partners: the links between similar partners that connect classes."""
    node = table.column("node").to_numpy()
    forest = _Forest(table.column("root").to_numpy())
    place = {int(x): i for i, x in enumerate(node)}
    partners = [np.array([place[x] for x in p], np.int64) for p in table.column("partners").to_pylist()]
    hashes, offsets = word_hashes([x.as_py() for x in table.column("raw")])
    sets = [elements(multiset(hashes[s:e])) for s, e in zip(offsets, offsets[1:])]
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    items, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(items), np.int32)
    for u in sorted(range(len(node)), key=lambda i: -len(partners[i])):
        other = partners[u][forest.of[partners[u]] != forest.of[u]]
        other = other[np.minimum(sizes[other], sizes[u]) >= SIMILARITY * np.maximum(sizes[other], sizes[u]) - 1e-6]
        if not len(other):
            continue
        mine = flat[ends[u] - sizes[u] : ends[u]]
        mark[mine] = 1
        cuts = np.cumsum(sizes[other]) - sizes[other]
        places = np.arange(int(sizes[other].sum())) + np.repeat(ends[other] - sizes[other] - cuts, sizes[other])
        both = np.add.reduceat(mark[flat[places]], cuts)
        mark[mine] = 0
        for v in other[both >= SIMILARITY * (sizes[other] + sizes[u] - both) - 1e-9]:
            forest.link(u, int(v))
    links = np.array(forest.links, np.int64).reshape(-1, 2)
    return pa.table({"u": node[links[:, 0]], "v": node[links[:, 1]]})


def _blocks(n: Column, size: Column) -> Column:
    """The number of blocks for n nodes with texts of so many bytes."""
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _block(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node), blocks).cast("int")


def _first_pass(shared: DataFrame) -> DataFrame:
    """Every node with its hub, and the hub itself, in blocks."""
    met = shared.where("node <> least").groupBy("node", "size", "least").agg(F.count("*").alias("c"))
    paired = met.groupBy("node", "size").agg(F.max_by("least", F.struct("c", "least")).alias("hub"))
    hubs = paired.groupBy("hub").agg(_blocks(F.count("*"), F.sum("size")).alias("blocks"))
    spokes = paired.join(hubs, "hub").select(F.col("hub").alias("bucket"), _block(F.col("node"), F.col("blocks")).alias("a"), "node", F.array("hub").alias("partners"))
    centres = hubs.select(F.col("hub").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), F.col("hub").alias("node"), F.array().cast("array<long>"))
    return spokes.union(centres).select("bucket", "a", F.lit(0).alias("b"), "node", F.col("node").alias("root"), "partners")


def _second_pass(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes of buckets of several classes, in all pairs of blocks that hold pairs to compare."""
    placed = shared.drop("least").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    mixed = classes.groupBy("bucket").agg(F.max(F.struct("n", "root", "bytes")).alias("home"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("classes"))
    mixed = mixed.where("classes > 1").select(
        "bucket", F.col("home.root").alias("home"), _blocks(F.col("n") - F.col("home.n"), F.col("bytes") - F.col("home.bytes")).alias("outer"),
        _blocks(F.col("home.n"), F.col("home.bytes")).alias("inner"),
    )
    dealt = placed.join(mixed, "bucket")
    at_home = F.col("root") == F.col("home")
    own = F.when(at_home, F.col("outer") + _block(F.col("node"), F.col("inner"))).otherwise(_block(F.col("node"), F.col("outer")))
    others = F.when(at_home, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1))
    met = dealt.select("bucket", "band", "node", "root", own.alias("own"), F.explode(others).alias("other"))
    return met.select("bucket", "band", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "root")


def _classes(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """All rows (id, tag, low, high); nodes by (low, high) with class (root), the class's smallest id, number of rows and first row; and the tables behind them."""
    spark = docs.sparkSession
    spent: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        df, path = write_shared(df, name)
        spent.append(path)
        return df

    raw = docs.select(F.col(doc_id).cast("long").alias("id"), utf8(docs[text]).alias("raw")).withColumn("tag", F.xxhash64("raw"))
    rows = kept(raw.select("id", "tag", "raw").mapInArrow(_sign, _SIGNED), "signatures")
    # The least row that has an id stands for the node.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tag")).alias("first")
    grouped = rows.where("low is not null").groupBy("low", "high").agg(F.any_value("sign", F.lit(True)).alias("sign"), F.max("size").alias("size"), first, F.count("*").alias("n"))
    nodes = kept(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    width = 2 * ROWS
    keys = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sign, i * {width} + 1, {width})))")
    bands = nodes.where("sign is not null").select("node", "size", F.posexplode(keys).alias("band", "bucket"))
    least = bands.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least <> last").drop("last")
    # Few rows are left of many; rebalanced, they make few files.
    shared = kept(bands.join(least, "bucket").hint("rebalance"), "buckets")
    several = shared.select("node", "size").distinct()
    files = 1 + (several.agg(F.sum("size")).first()[0] or 0) // FILE_BYTES
    wanted = several.select("node").join(nodes, "node").select("node", F.coalesce("first.id", F.lit(0)).alias("id0"), F.col("first.none").alias("none"), F.col("first.tag").alias("tag"))
    sources = raw.select(F.coalesce("id", F.lit(0)).alias("id0"), F.col("id").isNull().alias("none"), "tag", "raw")
    texts = kept(sources.join(wanted, ["id0", "none", "tag"]).dropDuplicates(["id0", "none", "tag"]).select("node", "raw").repartition(files, "node"), "texts")

    def settle(batches: DataFrame, before: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
        """The links among the batches' pairs, and the roots with them and the links before."""
        found = batches.join(texts, "node").groupBy("bucket", "a", "b").applyInArrow(_verified, "u long, v long")
        found = kept(found, "links")
        roots, path = components(functools.reduce(DataFrame.union, before, found), "roots")
        spent.append(path)
        return found, roots

    links, roots = settle(_first_pass(shared), [])
    dealt = _second_pass(shared, roots).join(nodes.select("node", "sign"), "node")
    likely = kept(dealt.groupBy("bucket", "a", "b").applyInArrow(_candidates, _PAIRED), "candidates")
    if not likely.isEmpty():
        _, roots = settle(likely, [links])
    rooted = nodes.drop("sign").join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("first").alias("named"), F.sum("n").alias("class_size"))
    return rows.select("id", "tag", "low", "high"), rooted.select("low", "high", "node", "root").join(named, "root"), spent


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: its id, node (of equal texts), class (root), the class's smallest id and number of documents."""
    rows, nodes, spent = _classes(docs, doc_id, text)
    out = rows.join(nodes, ["low", "high"], "left").select(
        F.col("id").alias("doc_id"), "node", "root", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("named.id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )
    result, _ = write_shared(out, "near-duplicates")
    delete_shared(docs.sparkSession, *spent)
    return result


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each class one with the smallest id stays; empty texts stay.

    The result reads a table of the rows that stay, of a few bytes each, kept until the driver ends.
    """
    tag, number, none = names = fresh(docs, "near_tag", "near_id", "near_null")
    _, nodes, spent = _classes(docs, doc_id, text)
    stay = nodes.select("named").distinct().select(F.col("named.tag").alias(tag), F.coalesce("named.id", F.lit(0)).alias(number), F.col("named.none").alias(none))
    stay, _ = write_shared(stay, "stay")
    delete_shared(docs.sparkSession, *spent)
    own = F.col(f"`{doc_id}`").cast("long")
    marked = docs.withColumns({tag: F.xxhash64(utf8(docs[text])), number: F.coalesce(own, F.lit(0)), none: own.isNull()})
    empty = F.coalesce(F.length(utf8(docs[text])), F.lit(0)) == 0
    full = marked.where(~empty).join(stay, names, "left_semi").dropDuplicates(names)
    return full.drop(*names).unionByName(docs.where(empty))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: its class, the class's number of documents, and whether it is the one that stays."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays"))
