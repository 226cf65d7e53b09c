"""Document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: stretches up to a line or sentence end, of at most ``PARAGRAPH`` characters.  A paragraph's
64-bit digest (with its running number among equal ones) enters three cells of a sketch; a cell holds a count, the xor of
its digests and the xor of their check values.  Two sketches subtract cell by cell, and peeling cells that hold one digest
recovers the paragraphs in which two texts differ.  If peeling does not empty the cells, both texts are sketched again at
``GROWTH`` times the size.  From the number d of differing paragraphs among n in all, the likeness is (n - d) / (n + d).

The fingerprint of a text is its smallest sketch (``BASE`` cells), written in base 64.

``with_next`` pairs each document with the next by descending id in one range-dealt shuffle: split points come from quantiles
of the ids, every range is sorted and streamed, and the first row of a range is also dealt to the range before it.

Defined cases: NULL text is the empty text, whose sketch is empty; two empty texts have likeness 1; rows of equal id follow
in the order of a hash of their texts; NULL ids come last; a single row is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table

PARAGRAPH = 24
BASE = 12
GROWTH = 4
HASHES = 3
RANGE_BYTES = 16 << 20
MOST_RANGES = 4096
BATCH_CELLS = 1 << 20
LOWEST = -(1 << 63)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, removed long, added long")

pieces = re.compile(r"[^\n.!?]{1,%d}[\n.!?]*\s*|[\n.!?]+\s*" % PARAGRAPH).findall


def digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph digests of all texts, offsets by text); the i-th of equal paragraphs of a text has its own digest."""
    parts = [pieces(t) for t in texts]
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    digest = xxhash.xxh64_intdigest
    keys = np.fromiter((digest(x) for p in parts for x in p), np.uint64, int(off[-1]))
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(off))
    with np.errstate(over="ignore"):
        tagged = mix(keys ^ (owner * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(tagged, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = tagged[order][1:] != tagged[order][:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0)) if len(keys) else np.zeros(0, np.int64)
        again = np.empty(len(keys), np.uint64)
        again[order] = (np.arange(len(keys)) - start).astype(np.uint64)
        return mix(keys + again * np.uint64(0xD1B54A32D192ED03)), off


def check_value(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys * np.uint64(0x2545F4914F6CDD1D) + np.uint64(0x5851F42D4C957F2D))


def cells_of(keys: np.ndarray, owner: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each hash function, the cell of each digest in a row of sketches of ``size`` cells."""
    third = size // HASHES
    for j in range(HASHES):
        h = mix(keys + np.uint64(j + 1))
        yield owner * size + j * third + (h % np.uint64(third)).astype(np.int64)


class Sketches:
    """``n`` sketches of ``size`` cells in three arrays."""

    def __init__(self, n: int, size: int):
        self.n, self.size = n, size
        self.count = np.zeros(n * size, np.int32)
        self.key = np.zeros(n * size, np.uint64)
        self.check = np.zeros(n * size, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> "Sketches":
        check = check_value(keys)
        for cell in cells_of(keys, owner, self.size):
            np.add.at(self.count, cell, sign)
            np.bitwise_xor.at(self.key, cell, keys)
            np.bitwise_xor.at(self.check, cell, check)
        return self

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(self.n, self.size)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def rows(self, at: np.ndarray) -> "Sketches":
        out = Sketches(0, self.size)
        out.n = len(at)
        for name in ("count", "key", "check"):
            setattr(out, name, getattr(self, name).reshape(self.n, self.size)[at].ravel())
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sketch, digest, sign) of every recovered digest, and whether each sketch came out empty.  Consumes the cells."""
        found: list[tuple[np.ndarray, ...]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            look = look[np.abs(self.count[look]) == 1]
            look = look[check_value(self.key[look]) == self.check[look]]
            if not len(look):
                break
            owner, keys, sign = look // self.size, self.key[look], self.count[look]
            once = np.lexsort((keys, owner))
            owner, keys, sign = owner[once], keys[once], sign[once]
            first = np.ones(len(keys), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, sign = owner[first], keys[first], sign[first]
            found.append((owner, keys, sign))
            self.add(keys, owner, -sign)
            look = np.unique(np.concatenate(list(cells_of(keys, owner, self.size))))
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        empty = ~left.reshape(self.n, self.size).any(axis=1)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), empty
        return *(np.concatenate([f[i] for f in found]) for i in range(3)), empty

    def written(self) -> list[str]:
        row = np.zeros((self.n, self.size), [("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
        row["count"], row["key"] = self.count.reshape(self.n, -1), self.key.reshape(self.n, -1)
        row["check"] = (self.check >> np.uint64(32)).reshape(self.n, -1)
        return [base64.b64encode(r.tobytes()).decode() for r in row]


def chosen(keys: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(digests of the texts ``rows``, position of the text in ``rows``)."""
    size = np.diff(off)[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    start = np.cumsum(size) - size
    return keys[np.arange(int(size.sum())) - np.repeat(start - off[rows], size)], owner


def differences(keys: np.ndarray, off: np.ndarray, base: Sketches, a: np.ndarray, b: np.ndarray):
    """For each pair of texts (a[i], b[i]): numbers of paragraphs that only a has and only b has, by subtraction and peeling."""
    only_a, only_b = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    total = np.diff(off)

    def settle(pairs: np.ndarray, diff: Sketches) -> np.ndarray:
        owner, _, sign, empty = diff.peel()
        for out, s in ((only_a, 1), (only_b, -1)):
            out[pairs] = np.bincount(owner[sign == s], minlength=len(pairs))
        return pairs[~empty]

    todo = np.concatenate([settle(p, base.rows(a[p]).minus(base.rows(b[p])))
                           for p in np.array_split(np.arange(len(a)), max(1, len(a) * BASE // BATCH_CELLS))])
    size = BASE
    while len(todo):
        size *= GROWTH
        ready = 2 * size >= 3 * np.abs(total[a[todo]] - total[b[todo]])  # else it cannot be emptied
        later, now = todo[~ready], todo[ready]
        failed = [later]
        for lo in range(0, len(now), max(1, BATCH_CELLS // size)):
            p = now[lo:lo + max(1, BATCH_CELLS // size)]
            failed.append(settle(p, Sketches(len(p), size).add(*chosen(keys, off, a[p])).minus(
                Sketches(len(p), size).add(*chosen(keys, off, b[p])))))
        todo = np.concatenate(failed)
    return only_a, only_b


def likeness(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    return np.where(n + d > 0, (n - d) / np.maximum(n + d, 1), 1.0)


def compare_versions(ids: list, texts: list[str], following: np.ndarray) -> pa.RecordBatch:
    """One ``RESULT`` row for each text i with following[i] >= 0, whose next text is texts[following[i]]."""
    at = np.flatnonzero(following >= 0)
    nxt = following[at]
    edited = []
    for i, j in zip(at.tolist(), nxt.tolist()):
        t = texts[i]
        tail = len(t) // 3
        edited.append(t[:len(t) - tail] + texts[j][:tail])
    n = len(texts)
    keys, off = digests(texts + edited)
    total = np.diff(off)
    base = Sketches(n + len(edited), BASE).add(*chosen(keys, off, np.arange(n + len(edited))))
    version = n + np.arange(len(at))
    removed, added = differences(keys, off, base, at, version)
    far_a, far_b = differences(keys, off, base, at, nxt)
    prints = base.written()
    return pa.RecordBatch.from_arrays([
        pa.array([ids[i] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array([prints[i] for i in at], pa.string()), pa.array(prints[n:], pa.string()),
        pa.array(likeness(total[at] + total[version], removed + added)),
        pa.array(likeness(total[at] + total[nxt], far_a + far_b)), pa.array(removed), pa.array(added)],
        [c.split()[0] for c in RESULT.split(", ")])


def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over rows sorted by (part, copy, id descending): each row that is no copy meets the row after it."""
    held: tuple | None = None
    for batch in batches:
        for part in slices(batch, "text"):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text"))))
            if held:
                rows.insert(0, held)
            held = rows[-1]
            following = np.asarray([i + 1 if not r[1] and i + 1 < len(rows) else -1 for i, r in enumerate(rows)])
            if (following >= 0).any():
                yield compare_versions([r[2] for r in rows], [r[3] or "" for r in rows], following)


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """One ``RESULT`` row per document (see the module's text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST).cast("long")).alias("order"))
    size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not size[0]:
        return spark.createDataFrame([], RESULT)
    ranges = int(min(MOST_RANGES, max(1, (size[1] or 0) // RANGE_BYTES)))
    cuts = rows.agg(F.percentile_approx("order", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0]
    cuts = np.unique(np.asarray(cuts if ranges > 1 else [], np.int64))
    # the range of a row, in descending order of ids, and the first id of each range that has rows: one number a range
    spans = rows.select("order").mapInArrow(first_ids(cuts), "part int, first long")
    first = dict(sorted((r["part"], r["first"]) for r in spans.groupBy("part").agg(F.max("first").alias("first")).collect()))
    names = list(first)
    copies = {first[names[i]]: names[i - 1] for i in range(len(names))}  # the first range's copy goes to the last

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = np.asarray(sorted(copies), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = batch.column("order").to_numpy()
            part = (len(cuts) - np.searchsorted(cuts, order)).astype(np.int32)
            names_ = [*batch.schema.names, "part", "copy"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.zeros(len(part), bool))], names_)
            also = np.isin(order, heads)
            if also.any():
                extra = batch.filter(pa.array(also))
                goal = pa.array([copies[x] for x in order[also].tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([*extra.columns, goal, pa.array(np.ones(len(goal), bool))], names_)

    dealt = rows.mapInArrow(deal, "doc_id long, text string, order long, part int, copy boolean")
    return (dealt.repartition("part").sortWithinPartitions("part", "copy", F.desc("order"), F.xxhash64("text"))
            .select("part", "copy", "doc_id", "text").mapInArrow(streamed, RESULT))


def first_ids(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            order = batch.column(0).to_numpy()
            part = len(cuts) - np.searchsorted(cuts, order)
            for p in np.unique(part).tolist():
                top[p] = max(top.get(p, LOWEST), int(order[part == p].max()))
        if top:
            yield pa.RecordBatch.from_arrays([pa.array(list(top), pa.int32()), pa.array(list(top.values()), pa.int64())],
                                             ["part", "first"])
    return run


def op5_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(table(spark, sf_dir, "documents"))
