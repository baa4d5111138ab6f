"""Near-duplicate detection with SetSketch registers.

Documents are sets of word shingles.  Equal sets form a class.  Each class has a
sketch of truncated, exponentially spaced minima, which merge by maximum and are
locality-sensitive: bands of registers make candidates, the joint likelihood of
two sketches estimates the similarity of a pair, and what may reach the
threshold is verified on the full sets.

Classes of a band bucket are first estimated against the bucket's smallest and
largest class, and each class is verified with its best such partner, which
connects most of a group of copies without its pairs.  Where a bucket still
holds different components, sketches are compared in blocks of bounded size,
and each class that may reach another component is verified with that
component's members; one link found is enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entailis.llm.common import LOWER_ASCII, checkpoint, prepare, release

SHINGLE = 5
#: Similarity in hundredths from which two documents are linked.
THRESHOLD = 75
#: A pair at the threshold shares no band with a chance of 3 in 10 million.
BANDS, BAND_ROWS = 40, 4
REGISTERS = 192
#: Fixed values of the sketch: base of the spacing, rate, largest register.
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 1
#: Estimates below this are far (nearly five standard errors) from the threshold.
LEAST_ESTIMATE = 0.60
#: Pairs with a smaller share of equal registers are not estimated: equality is at least as likely as similarity says.
LEAST_EQUAL = 0.55
#: Edges of a graph that one task handles in a round.
EDGES_A_TASK = 200_000
#: Classes on either side of one comparison in a task, of their sets and of their sketches.
BLOCK, SKETCH_BLOCK = 256, 1024
#: Classes up to which their keys go to every executor to pick the texts that are read again; beyond, texts are shuffled.
BROADCAST_CLASSES = 1_000_000

_SPACES = bytes(0x20 if 0x09 <= b <= 0x0D else b for b in LOWER_ASCII)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _series(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers."""
    return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _GOLDEN)


_PLACES = _series(SHINGLE + 1, 11)
_FACTORS = (_series(REGISTERS, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TERMS = (_series(REGISTERS, 900) >> np.uint64(32)).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles of a whole text; the whole sequence where it is shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return np.zeros(0, np.uint64)
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n, size = max(1, len(h) - SHINGLE + 1), min(SHINGLE, len(h))
    out = np.full(n, _PLACES[SHINGLE] * np.uint64(size))
    for j in range(size):
        out = out * _GOLDEN + _mix(h[j : j + n] ^ _PLACES[j])
    return np.unique(_mix(out))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set: floor(1 - log_BASE of the least exponential value), held within 0 and LIMIT.

    The least of the elements' uniform values is found first; the exponential
    value and its logarithm are monotone, so they are taken once a register.
    """
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for k in range(0, len(h), 512):
        np.minimum(least, (h[k : k + 512, None] * _FACTORS + _TERMS).min(0), out=least)
    value = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def joint_similarity(greater: np.ndarray, less: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of the highest likelihood, from the counts of registers of a above, below and equal to b's."""
    u = size_a / (size_a + size_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def differ(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)

    def fit(j: np.ndarray) -> np.ndarray:
        p, q = differ(u - v * j), differ(v - u * j)
        return greater * np.log(p) + less * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(30):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        up = fit(a) < fit(b)
        low, high = np.where(up, a, low), np.where(up, high, b)
    return (low + high) / 2


def estimates(regs_a: np.ndarray, regs_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The estimated similarity of each pair of rows, 0 where sizes or equal registers rule it out."""
    out = np.zeros(len(size_a))
    at = np.flatnonzero(100 * np.minimum(size_a, size_b) >= THRESHOLD * np.maximum(size_a, size_b))
    for k in range(0, len(at), 16384):
        part = at[k : k + 16384]
        a, b = regs_a[part], regs_b[part]
        equal = (a == b).sum(1)
        near = equal >= LEAST_EQUAL * REGISTERS
        part, a, b, equal = part[near], a[near], b[near], equal[near]
        greater = (a > b).sum(1)
        out[part] = joint_similarity(greater, REGISTERS - equal - greater, equal, size_a[part].astype(float), size_b[part].astype(float))
    return out


def _regs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for t in batch["text"]:
            s = shingles(t)
            rows.append((*_digest(s), len(s), registers(s).tobytes() if len(s) else None))
        out = pd.DataFrame(rows, columns=["h1", "h2", "n", "regs"])
        out.insert(0, "key", batch["key"].array)
        yield out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) can reach.

    Each round every node joins the neighbour, or stays at itself, of the least
    hash of the round, and edges are redrawn between the nodes joined.  Chains
    and stars alike shrink by a constant share in expectation.  Minima combine
    before the shuffle, so a node with very many edges is no hot spot.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    parts = max(1, -(-edges.count() // EDGES_A_TASK))
    small = lambda df: checkpoint(df.coalesce(parts))
    edges = small(edges)
    labels = small(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while edges.take(1):
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        near = near.union(near.select("v", "u"))
        ranked = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), c.alias("to"))  # noqa: B023, E731
        least = near.groupBy("u").agg(F.min(ranked(F.col("v"))).alias("m"))
        jump = small(least.select("u", F.least(F.col("m"), ranked(F.col("u")))["to"].alias("to")))
        at = lambda n: jump.select(F.col("u").alias(n), F.col("to").alias(f"to_{n}"))  # noqa: B023, E731
        redrawn = edges.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        edges = small(redrawn.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        labels = small(labels.join(at("label"), "label", "left").select("node", F.coalesce("to_label", "label").alias("label")))
        turn += 1
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    out = small(labels.join(small(least), "label").select("node", "component"))
    release(out.sparkSession)
    return out


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of whole groups from batches sorted by keys: a group that goes on in the next batch waits for it."""
    kept = None
    for batch in batches:
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        if not len(rows):
            continue
        key = rows[keys].to_numpy()
        last = int(np.flatnonzero((key != key[-1]).any(1))[-1]) + 1 if (key[0] != key[-1]).any() else 0
        kept = rows.iloc[last:].reset_index(drop=True)
        if last:
            yield rows.iloc[:last]
    if kept is not None and len(kept):
        yield kept


def _bounds(rows: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    key = rows[keys].to_numpy()
    starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]
    return starts, np.r_[starts[1:], len(rows)]


def _best_pivots(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(g, node): for each class the pivot of its buckets that is likely the most similar, if any may be similar enough."""
    pairs = members.select(F.col("low").alias("a"), F.col("node").alias("b")).union(members.select("high", "node")).where("a <> b").distinct()
    of = lambda n: sketches.select(F.col("node").alias(n), F.col("regs").alias(f"regs_{n}"), F.col("n").alias(f"n_{n}"))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                est = estimates(_regs(batch["regs_a"]), _regs(batch["regs_b"]), batch["n_a"].to_numpy(), batch["n_b"].to_numpy())
                yield batch[["a", "b"]].assign(est=est)[est >= LEAST_ESTIMATE]

    found = pairs.join(of("a"), "a").join(of("b"), "b").mapInPandas(pick, "a long, b long, est double")
    return checkpoint(found.groupBy("b").agg(F.max(F.struct("est", "a")).alias("m")).select(F.col("m.a").alias("g"), F.col("b").alias("node")))


def _open_components(members: DataFrame, components: DataFrame, sketches: DataFrame) -> DataFrame:
    """(g, node): classes with a likely similar class of another component g in one of their buckets.

    Of two components the smaller one's classes are named, with the larger one as g.
    """
    # Written first, so that the rows of a large component can be split among tasks in the join.
    sizes = checkpoint(components.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    placed = components.join(sizes, "component")
    at = members.select("band", "node").join(placed, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    held = at.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = held.groupBy("band").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    count = lambda m: F.ceil(m / SKETCH_BLOCK).cast("int")
    # Only what is not of a bucket's largest component meets the bucket: a stray class costs a pass, not all pairs.
    mixed = checkpoint(mixed.select("band", F.col("most.comp").alias("largest"), count(F.col("m") - F.col("most.m")).alias("ps"), count(F.col("m")).alias("qs")))
    rest = at.join(mixed, "band").withColumn("main", F.col("comp") == F.col("largest"))
    keys = ["band", "p", "q"]
    own, every = (lambda of: F.array(F.pmod(F.xxhash64("node"), F.col(of)).cast("int"))), (lambda of: F.sequence(F.lit(0), F.col(of) - 1))
    # A bucket of one block is sent once (side 2); of others the few are side 0, and all of them side 1.
    sides = F.when(F.col("qs") == 1, F.array(F.lit(2))).when(F.col("main"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    dealt = rest.withColumn("side", F.explode(sides))
    few = F.col("side") == 0
    dealt = dealt.withColumn("p", F.explode(F.when(few, own("ps")).otherwise(every("ps")))).withColumn("q", F.explode(F.when(few, every("qs")).otherwise(own("qs"))))
    dealt = dealt.select(*keys, "side", "main", "node", "comp", "size").join(sketches.select("node", "n", "regs"), "node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, keys):
            regs = _regs(rows["regs"])
            n, comp, node, size, side, main = (rows[c].to_numpy() for c in ("n", "comp", "node", "size", "side", "main"))
            for i, j in _across(*_bounds(rows, keys), side, main):
                apart = (comp[i] != comp[j]) & (main[j] | (node[i] < node[j]))
                i, j = i[apart], j[apart]
                near = estimates(regs[i], regs[j], n[i], n[j]) >= LEAST_ESTIMATE
                i, j = i[near], j[near]
                swap = (size[i] > size[j]) | ((size[i] == size[j]) & (comp[i] < comp[j]))
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pd.DataFrame({"g": comp[j], "node": node[i]}).drop_duplicates()

    return checkpoint(dealt.repartition(*keys).sortWithinPartitions(*keys, "side").mapInPandas(compare, "g long, node long").distinct())


def _across(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, main: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the few and all rows of each block, about ``most`` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        at = np.arange(s, e)
        few, all_ = (at[~main[s:e]], at) if side[s] == 2 else (at[side[s:e] == 0], at[side[s:e] == 1])
        for k in range(0, len(few), max(1, most // max(1, len(all_)))):
            part = few[k : k + max(1, most // max(1, len(all_)))]
            held.append((np.repeat(part, len(all_)), np.tile(all_, len(part))))
            n += len(part) * len(all_)
            if n >= most:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _links(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes of right and of left in the same group g, at least one for each that has any.

    left, right: (g, node).  Both sides are dealt into blocks, so that a task
    holds the sets of a bounded number of classes.  Within a block pair each
    class of right is verified with the classes of left that may be similar
    enough, the likeliest first, until one is.
    """
    rows = left.select("g", "node", F.lit(0).alias("side")).union(right.select("g", "node", F.lit(1).alias("side")))
    count = lambda k: F.ceil(F.sum((F.col("side") == k).cast("int")) / BLOCK).cast("int")
    blocks = checkpoint(rows.groupBy("g").agg(count(0).alias("ps"), count(1).alias("qs")).where("ps > 0 and qs > 0"))
    own = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), F.col(of) - 1)
    first = F.col("side") == 0
    dealt = rows.join(blocks, "g").withColumn("p", F.explode(F.when(first, F.array(own("ps"))).otherwise(every("ps")))).withColumn("q", F.explode(F.when(first, every("qs")).otherwise(F.array(own("qs")))))
    keys = ["g", "p", "q"]
    dealt = dealt.select(*keys, "side", "node").join(sets, "node").repartition(*keys).sortWithinPartitions(*keys, "side")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _groups(batches, keys):
            regs, n, node, side = _regs(rows["regs"]), *(rows[c].to_numpy() for c in ("n", "node", "side"))
            items = rows["items"].tolist()
            made = []
            for s, e in zip(*(x.tolist() for x in _bounds(rows, keys)), strict=True):
                m = s + int((side[s:e] == 0).sum())
                x = {k: np.frombuffer(items[k], np.uint64) for k in range(s, e)}
                for j in range(m, e):
                    est = estimates(regs[s:m], np.broadcast_to(regs[j], (m - s, REGISTERS)), n[s:m], np.full(m - s, n[j]))
                    for i in (s + np.argsort(-est, kind="stable")).tolist():
                        if est[i - s] < LEAST_ESTIMATE:
                            break
                        both = len(np.intersect1d(x[i], x[j], assume_unique=True))
                        if 100 * both >= THRESHOLD * (len(x[i]) + len(x[j]) - both):
                            made.append((node[i], node[j]))
                            break
            yield pd.DataFrame(made, columns=["a", "b"])

    return checkpoint(dealt.select(*keys, "side", "node", "n", "regs", "items").mapInPandas(compare, "a long, b long").distinct())


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sets of classes from the texts of their smallest keys; a key's other texts are passed over."""
    for batch in batches:
        rows = []
        for node, h1, h2, t in zip(batch["node"], batch["h1"], batch["h2"], batch["text"], strict=True):
            items = shingles(t)
            if _digest(items) == (h1, h2):
                rows.append((node, len(items), registers(items).tobytes(), items.tobytes()))
        yield pd.DataFrame(rows, columns=["node", "n", "regs", "items"])


def _digest(items: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(items.tobytes())
    return tuple(np.array([d & (2**64 - 1), d >> 64], np.uint64).astype(np.int64).tolist())


def _one_text_a_key(feats: DataFrame) -> DataFrame:
    """feats with a column own: of a key's different texts the one of the smallest digest stands for all, whose rows get its class."""
    digest = F.struct("h1", "h2")
    texts = feats.where("key is not null").groupBy("key").agg(F.min(digest).alias("m"), F.max(digest).alias("x"))
    several = checkpoint(texts.where("m <> x").select("key", "m"))
    if several.isEmpty():
        return feats.withColumn("own", F.lit(True))
    known = feats.join(several, "key", "left")
    own = F.col("m").isNull() | (F.col("m") == digest)
    return checkpoint(known.select("key", F.coalesce("m.h1", "h1").alias("h1"), F.coalesce("m.h2", "h2").alias("h2"), "n", "regs", own.alias("own")))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept), one row for each row of docs.

    component_id: the smallest key reachable over links, the own one included;
    kept: whether it is the own key.  Texts without words (null, empty, blank)
    have an empty set and are linked with nothing.  A row without a key cannot
    be linked: its component is null and it is kept.  Rows that share a key
    count as one document, whose text is, if they differ, the one whose set has
    the smallest digest; all rows come back, each with its own n_shingles and
    with the document's component.  Keys are integers.  Only
    key and text are read.  No limit holds on members of a group or a bucket.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    feats = checkpoint(source.mapInPandas(_features, "key long, h1 long, h2 long, n long, regs binary"))
    feats = _one_text_a_key(feats)
    classes = feats.where("own and n > 0 and key is not null").groupBy("h1", "h2").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    classes = checkpoint(classes)
    width = 2 * BAND_ROWS
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * width + 1, F.lit(width))))
    banded = classes.select("node", F.explode(band).alias("band"))
    shared = checkpoint(banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high"))
    members = checkpoint(banded.join(shared, "band"))
    release(spark)
    sketches = checkpoint(classes.select("node", "h1", "h2", "n", "regs").join(members.select("node").distinct(), "node", "left_semi"))
    # Texts are read a second time for the classes that share a bucket with another.
    wanted = sketches.select("node", "h1", "h2")
    wanted = F.broadcast(wanted) if sketches.count() <= BROADCAST_CLASSES else wanted
    texts = source.select(F.col("key").alias("node"), "text").where("node is not null").join(wanted, "node").select("node", "h1", "h2", "text")
    sets = checkpoint(texts.mapInPandas(_sets, "node long, n long, regs binary, items binary"))
    if sets.count() > sketches.count():  # rows that occur more than once
        sets = checkpoint(sets.dropDuplicates(["node"]))
    release(spark)
    pivots = _best_pivots(members, sketches)
    edges = _links(pivots.select("g", F.col("g").alias("node")).distinct(), pivots, sets)
    components = connected_components(edges)
    open_ = _open_components(members, components, sketches)
    if open_.take(1):
        wanted = open_.select("g").distinct()
        alone = wanted.join(components.select(F.col("component").alias("g")), "g", "left_anti").select("g", F.col("g").alias("node"))
        grown = components.select(F.col("component").alias("g"), "node").join(wanted, "g", "left_semi")
        found = _links(grown.unionByName(alone), open_, sets)
        at = lambda n: components.select(F.col("node").alias(n), F.col("component").alias(f"at_{n}"))
        across = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("at_a", "a").alias("a"), F.coalesce("at_b", "b").alias("b"))
        upper = connected_components(across).select(F.col("node").alias("component"), F.col("component").alias("top"))
        old = components.join(upper, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        new = upper.select(F.col("component").alias("node"), F.col("top").alias("component")).join(components, "node", "left_anti")
        components = checkpoint(old.unionByName(new))
    grouped = classes.join(components, "node", "left").where("copies > 1 or component is not null")
    grouped = checkpoint(grouped.select("h1", "h2", F.coalesce("component", "node").alias("component")))
    out = feats.select("key", "h1", "h2", "n").join(grouped, ["h1", "h2"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))
