"""MinHash near-duplicates by an LSH forest, confirmed on full shingle sets.

Every document becomes the set of its distinct word shingles.  Documents with equal sets are one class from the start, so
exact copies never meet as pairs.  Each class has ``TREES`` signatures of ``DEPTH`` minimum hashes; every tree is one global
sorted order of its signatures (a range-partitioned sort, which splits any dense region).  Neighbours in an order whose
longest common prefix is at least ``LEAST_PREFIX`` are candidates.  The depth adapts to the region: in a sparse run all
pairs within ``WINDOW`` are candidates; in a dense run the nearest neighbours, whose common prefixes are longest, and every
member with the region's centre, so that a text and its many copies meet however large the region is.

Candidates are confirmed on full sets (64-bit shingle hashes) in three rounds: first each class's best candidate, then
every candidate between classes that are not yet connected and whose signatures do not rule the pair out, and last, in dense
regions, the classes that share the first hashes of a signature with a component but are not in it, with all its members in
question.  How many hashes follows from the threshold (``stray_depth``).  Connected
components alternate star contractions, with partial aggregates only.  No list of links reaches the driver.

Defined cases: NULL text is the empty text; a text without words has the empty set and is linked with nothing; repeated
rows are rows of their own with one component; NULL ids take part, and a component of NULL ids alone has a NULL id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MODEL_SLICE_BYTES, hash_words, mix, slices, split_words, table, written

TREES = 16
DEPTH = 6
LEAST_PREFIX = 3
WINDOW = 8
DENSE_WINDOW = 2
#: A pair whose signatures agree in fewer of the hashes than the threshold less this share is ruled out (over 5 deviations).
SLACK = 0.2
STRAY_SLACK = 0.15
BLOCK = 512
STRAY_BLOCK = 1024
#: Share of the pairs at the threshold that may have no stray key in common (nearness in an order still finds most of them).
STRAY_MISSED = 2.5e-4
#: A class of more rows than this, and than one in ``HOT_SHARE``, meets its rows by broadcast: fewer than ``HOT_SHARE`` are.
HOT_ROWS, HOT_SHARE = 1000, 100_000
PRINTS = "doc_id long, row_key long, n_shingles long, node long, signature binary"


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle of all its words."""
    codes, vocab, ptr = split_words(texts)
    hashed = hash_words(vocab)[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.full(max(len(hashed) - words + 1, 0), words, np.uint64)
        for j in range(words):
            rolled = mix(rolled * np.uint64(31) + hashed[j:j + len(rolled)])
        out = []
        for lo, hi in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
            if hi - lo >= words:
                out.append(np.unique(rolled[lo:hi - words + 1]))
            elif hi > lo:
                h = np.full(1, hi - lo, np.uint64)
                for x in hashed[lo:hi]:
                    h = mix(h * np.uint64(31) + x)
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def minhash(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """(sets x hashes) minimum hashes; no set may be empty."""
    rng = np.random.default_rng(8)
    scale = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n_hashes), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n_hashes):
            out[:, k] = np.minimum.reduceat(flat * scale[k] + shift[k], starts) >> np.uint64(32)
    return out


def fingerprints(words: int):
    """mapInArrow body: (doc_id, row_key, text) to ``PRINTS``; signature is NULL for the empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", MODEL_SLICE_BYTES):
                sets = shingle_sets(part.column("text"), words)
                full = [i for i, s in enumerate(sets) if len(s)]
                signature: list[bytes | None] = [None] * len(sets)
                if full:
                    for i, row in zip(full, minhash([sets[i] for i in full], TREES * DEPTH).astype(">u4")):
                        signature[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row_key"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_id(s) for s in sets], pa.int64()), pa.array(signature, pa.binary())],
                    ["doc_id", "row_key", "n_shingles", "node", "signature"])
    return run


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over one sorted partition of (tree, key, node): candidate pairs (a < b).

    A run is a stretch of equal tree and prefix.  Only the last ``WINDOW`` rows and the length of the run so far are
    carried from batch to batch.
    """
    width = DEPTH * 4
    held_key, held_node, held_place = np.zeros((0, width + 1), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("key")
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]].reshape(-1, width)
        tree = batch.column("tree").to_numpy().astype(np.uint8)[:, None]
        key = np.concatenate([held_key, np.concatenate([tree, raw], axis=1)])
        node = np.concatenate([held_node, batch.column("node").to_numpy()])
        n, old = len(node), len(held_node)
        same = np.zeros(n, bool)
        same[1:] = (key[1:, :1 + 4 * LEAST_PREFIX] == key[:-1, :1 + 4 * LEAST_PREFIX]).all(axis=1)
        run_of = np.cumsum(~same)
        begins = np.flatnonzero(~same)
        place = np.arange(n) - begins[run_of - 1]
        if old:  # the first run may have begun before the rows that were held
            place[run_of == 1] += held_place[0]
        found = []
        for step in range(1, WINDOW + 1):
            here = np.arange(max(old, step), n)
            here = here[(run_of[here] == run_of[here - step]) & ((step <= DENSE_WINDOW) | (place[here] <= WINDOW))]
            found.append(np.stack([node[here], node[here - step]], axis=1))
        pairs = np.concatenate(found)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])
        held_key, held_node, held_place = key[-WINDOW:], node[-WINDOW:], place[-WINDOW:]


def forest(classes: DataFrame) -> DataFrame:
    """(tree, key, more, node): each class in every order; ``more`` is its signature in the next tree."""
    step = DEPTH * 4
    return classes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(signature, tree * {step} + 1, {step})").alias("key"),
        F.expr(f"substring(signature, (tree + 1) % {TREES} * {step} + 1, {step})").alias("more"), "node")


def stray_depth(percent: int, missed: float = STRAY_MISSED) -> int:
    """Hashes of a signature that classes of a dense region must share to be compared.

    The deepest key at which at most the share ``missed`` of the pairs at the threshold have it in common in no tree; a lower
    threshold needs a shallower one.
    """
    depths = range(DEPTH, LEAST_PREFIX, -1)
    return next((d for d in depths if (1 - (percent / 100) ** d) ** TREES <= missed), LEAST_PREFIX)


def dense_members(entries: DataFrame, depth: int) -> DataFrame:
    """(region, tree, node, whole) of the classes in regions of more than ``WINDOW`` + 1; ``whole`` names the first ``depth``
    hashes."""
    named = entries.select("tree", "node", F.xxhash64("tree", F.substring("key", 1, 4 * LEAST_PREFIX)).alias("region"),
                           F.xxhash64("tree", F.substring("key", 1, 4 * depth)).alias("whole"))
    dense = named.groupBy("region").count().where(F.col("count") > WINDOW + 1).select("region")
    return written(named.join(dense, "region"), "dense")


def candidates(entries: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, trees): candidate pairs of classes and how often they were found.

    Rows of one order are sorted by their signature, then by that of the next tree, so equal signatures too lie by
    likeness.
    """
    ordered = (entries.repartitionByRange("tree", "key", "more", "node")
               .sortWithinPartitions("tree", "key", "more", "node").select("tree", "key", "node"))
    pairs = ordered.mapInArrow(neighbours, "a long, b long").union(centre_pairs(members))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("trees"))


def centre_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a dense region with the region's centre, the class whose signatures most others share.

    Copies of one text that differ from it in different places are less like each other than like the text, which their
    common signatures point to.
    """
    shared = members.groupBy("whole").agg(F.count(F.lit(1)).alias("n"))
    weight = members.join(shared, "whole").groupBy("node").agg(F.sum("n").alias("weight"))
    centre = (members.join(weight, "node").groupBy("region")
              .agg(F.max(F.struct("weight", "node")).alias("top")).select("region", F.col("top.node").alias("centre")))
    return (members.join(centre, "region").where(F.col("node") != F.col("centre"))
            .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")))


def mixed_signatures(members: DataFrame, root: DataFrame) -> DataFrame:
    """(whole, tree, node, part, main) of the members of dense regions whose signature is shared by several components."""
    own = written(members.select("whole", "tree", "node").join(root, "node", "left").select(
        "whole", "tree", "node", F.coalesce("root", "node").alias("part")), "parts")
    size = own.groupBy("whole", "part").agg(F.count(F.lit(1)).alias("n"))
    main = size.groupBy("whole").agg(F.max(F.struct("n", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
    return written(own.join(main.where("parts > 1").select("whole", F.col("top.part").alias("main")), "whole"), "mixed")


def stray_links(mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a confirmed link of each class outside the main component of a signature it has, to that component, if any.

    A component's members are dealt to blocks of about ``BLOCK`` with their sets; the strays of the component go to every
    block.  In a block a stray is held against all members, the likeliest first, until one confirms; no pairs leave it.
    """
    whole = classes.select("node", "signature").join(sets, "node")
    few = mixed.where(F.col("part") != F.col("main")).select("main", "node").distinct()
    many = (mixed.select(F.col("part").alias("main"), "node").distinct()
            .join(few.select("main").distinct(), "main", "left_semi"))
    blocks = many.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    many = many.join(blocks, "main").select("main", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node")
    few = few.join(blocks, "main").select(
        "main", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block"), "node")
    least = percent / 100 - SLACK

    def look(strays: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if strays.num_rows and block.num_rows:
            x, y = (np.frombuffer(b"".join(t.column("signature").to_pylist()), ">u4").reshape(t.num_rows, -1)
                    for t in (strays, block))
            node, held = block.column("node").to_pylist(), block.column("members").to_pylist()
            for n, s, own in zip(strays.column("node").to_pylist(), x, strays.column("members").to_pylist()):
                like = (y == s).mean(axis=1)
                for j in np.argsort(-like, kind="stable")[:np.count_nonzero(like >= least)].tolist():
                    if linked(own, held[j], percent):
                        found.append((min(n, node[j]), max(n, node[j])))
                        break
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    cell = ["main", "block"]
    sides = []
    for side in (few, many):  # each with columns of its own
        sides.append(side.join(whole, "node").select(*[F.col(c).alias(c) for c in (*cell, "node", "signature", "members")])
                     .groupBy(*cell))
    return sides[0].cogroup(sides[1]).applyInArrow(look, "a long, b long")


def linked(x: bytes, y: bytes, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union holds for two sets of distinct hashes."""
    both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def sharing(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, sets no larger than set i that may be linked with it), in order of size; no linked pair is left out.

    Shingles are ordered from the rarest on.  Two sets that are linked share one among the first
    size - 2 * percent * size / (100 + percent) + 1 of the smaller and the first size - percent * size / 100 + 1 of the
    larger, so a passage that many sets have in common brings no pairs.
    """
    size = np.asarray([len(s) for s in sets])
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    rank = rank[code][np.lexsort((rank[code], owner))]
    by_size = np.argsort(size, kind="stable")
    place = np.empty(len(sets), np.int64)
    place[by_size] = np.arange(len(sets))
    asks = size + percent * size // -100 + 1
    shows = size + 2 * percent * size // -(100 + percent) + 1
    shown = np.arange(len(owner)) - start[owner] < shows[owner]
    shingle, at = rank[shown], place[owner[shown]]
    order = np.lexsort((at, shingle))
    shingle, at = shingle[order], at[order]
    for i in by_size.tolist():
        asked = rank[start[i]:start[i] + asks[i]]
        lo, hi = np.searchsorted(shingle, asked), np.searchsorted(shingle, asked, side="right")
        met = np.unique(np.concatenate([at[x:y] for x, y in zip(lo.tolist(), hi.tolist())]))
        yield i, by_size[met[met < place[i]]]


def between_strays(mixed: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links between classes outside the main component of a signature they share.

    The strays of a signature are dealt to blocks of about ``STRAY_BLOCK`` with their sets, and every two blocks meet in a
    cell.  A cell confirms its pairs on full sets and sends only links that join two components; a pair is looked at in the
    first tree it shares.
    """
    few = mixed.where(F.col("part") != F.col("main")).select("tree", "whole", "node", "part")
    blocks = few.groupBy("whole").agg(F.ceil(F.count(F.lit(1)) / STRAY_BLOCK).alias("blocks"), F.count(F.lit(1)).alias("n"))
    few = few.join(blocks.where("n > 1"), "whole").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    few = few.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))))
    cells = (few.select("tree", "whole", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                        "own", "part", "node")
             .join(classes.select("node", "signature"), "node").join(sets, "node"))
    least = percent / 100 - STRAY_SLACK

    depth = stray_depth(percent)

    def compare(cell: pa.Table) -> pa.Table:
        node, part, own = (cell.column(c).to_numpy().copy() for c in ("node", "part", "own"))
        x = np.frombuffer(b"".join(cell.column("signature").to_pylist()), ">u4").reshape(cell.num_rows, TREES, DEPTH)
        held = cell.column("members").to_pylist()
        tree, inside = cell.column("tree")[0].as_py(), cell.column("low")[0] == cell.column("high")[0]
        found = []
        for i, met in sharing([np.frombuffer(m, np.uint64) for m in held], percent):
            met = met[(part[met] != part[i]) & (inside | (own[met] != own[i]))]
            same = x[met] == x[i]
            met = met[(same.mean(axis=(1, 2)) >= least) & ~same[:, :tree, :depth].all(axis=2).any(axis=1)]
            for j in met.tolist():
                if part[j] != part[i] and linked(held[i], held[j], percent):
                    found.append((min(node[i], node[j]), max(node[i], node[j])))
                    part[part == part[j]] = part[i]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return cells.groupBy("whole", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs with 100 * intersection >= percent * union on full sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("node").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("members").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): every linked node with the smallest node of its component, by alternating star contractions."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "stars")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` plus _row_key, a hash of id and text: rows alike in both are interchangeable."""
    return docs.withColumn("_row_key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))))


def joined_by(root: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: the stars found so far take the place of the links they came from."""
    links = written(links, "more-links")
    if links.isEmpty():
        return root
    return components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def near_duplicates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row per document: doc_id, row_key, n_shingles, component_id, kept, root (of its component; NULL without words)."""
    texts = keyed(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_row_key").alias("row_key"), "text")
    prints = written(texts.mapInArrow(fingerprints(words), PRINTS), "prints")
    slim = prints.drop("signature")
    classes = written(prints.where(F.col("signature").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("signature").alias("signature"),
        F.count(F.lit(1)).alias("n")), "classes")
    entries = forest(classes)
    dense = dense_members(entries, stray_depth(percent))
    pairs = written(candidates(entries, dense), "candidates")

    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(dense.select("node")).distinct()
    wanted = classes.join(met, "node", "left_semi").select("row_key")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", MODEL_SLICE_BYTES):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()),
                                                  pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "members"])

    # one row of each class, by its row key; equal rows are dropped in the same partitioning
    sets = written(texts.select("row_key", "text").join(wanted, "row_key", "left_semi").dropDuplicates(["row_key"])
                   .select("text").mapInArrow(members, "node long, members binary"), "sets")

    ways = pairs.union(pairs.select("b", "a", "trees"))
    best = ways.groupBy("a").agg(F.max(F.struct("trees", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    first = written(confirmed(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                              sets, percent), "first-links")
    root = components(first)
    found = root.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    found_b = root.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    sign = classes.select("node", "signature")
    rest = (pairs.select("a", "b").join(found, "a", "left").join(found_b, "b", "left")
            .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
    rest = (rest.join(sign.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
            .join(sign.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
            .select("a", "b", "x", "y").mapInArrow(plausible(percent / 100 - SLACK), "a long, b long"))
    root = joined_by(root, confirmed(written(rest, "open-pairs"), sets, percent))
    mixed = mixed_signatures(dense, root)
    root = joined_by(root, stray_links(mixed, classes, sets, percent).union(
        between_strays(mixed, classes, sets, percent)))

    named = classes.select("node", "doc_id", "n").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = written(named.join(least, "root").select("node", "n", "root", "component_id"), "of-node")
    alone = slim.where("n_shingles = 0").select("*", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("component_id"))
    full = slim.where("n_shingles > 0")
    often = max(HOT_ROWS, full.count() // HOT_SHARE)  # a text copied that often is no shuffle key
    hot, cold = of_node.where(F.col("n") > often).drop("n"), of_node.where(F.col("n") <= often).drop("n")
    out = (full.join(F.broadcast(hot), "node")
           .unionByName(full.join(F.broadcast(hot.select("node")), "node", "left_anti").join(cold, "node")).unionByName(alone))
    return out.select("doc_id", "row_key", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")


def plausible(least: float):
    """mapInArrow body: the pairs whose signatures agree in at least the share ``least`` of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(batch.num_rows, -1)
                        for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))
    return run


def op8_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85).drop("row_key", "root")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group stays: the one of the smallest id, NULL ids last, then the smallest row key.

    Rows equal in id and text are one document.  Documents without words are in no group: each stays.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    found = near_duplicates(docs, words, percent)
    first = (found.where(F.col("root").isNotNull()).groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row_key")).alias("first")))
    kept = (first.select(F.col("first.row_key").alias("_row_key"))
            .union(found.where(F.col("root").isNull()).select("row_key").distinct()))
    return keyed(docs).join(kept, "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(*names)
