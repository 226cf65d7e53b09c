"""Language-model scores from an Elias-Fano n-gram trie.

The text is tokenised once into chunks (word hashes and token codes) in the shared folder.  A chunk sends its distinct words
with their training counts to shards and gets the corpus counts back.  Then it sends its distinct longer n-grams, of all
orders at once, as a small trie in pre-order: words below their context, so a context is named once however many n-grams
follow it.  A shard sums the counts of all chunks, builds its part of the model and answers with one byte per n-gram and per
context; the chunk turns them into scores of its documents.  So the corpus counts grow with the input.

An n-gram is kept where its context is kept, from the first word's shard on.  The successors of a frequent context of any
order (at least an eighth of ``SHARD_TOKENS`` tokens) are spread over all shards by their own hash; its count goes to the
tasks.  There are at most 8 such contexts a shard.

A level of the trie holds, in one memory-mapped block: per context of the level below the pointer to its first successor,
as an Elias-Fano sequence; the successors relative to their context (number of the context, then a 32-bit word hash) as one
monotone Elias-Fano sequence; and one quantised byte each for a successor's discounted probability and a context's back-off.
A lookup starts at the first word and goes down: at each level it decodes the blocks that its context's pointers bound and
searches its word between them; the place found is the context of the next level.

Probabilities: P1(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), and for longer contexts
P(w | h) = c(h, w) / (c(h) + MU) + MU / (c(h) + MU) * P(w | shorter h), a distribution over words.

Defined cases: NULL or empty text is one end token; documents without a training document have P1 = 1; repeated rows count as
often as they occur; NULL ids are training documents or not by the rule for the empty text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, hash_words, mix, slices, split_words, table, written

ORDER = 3
MU = 2.0
CHUNK_BYTES = 6 << 20
SHARD_TOKENS = 1_000_000
SUCCESSOR_BITS = 32
BLOCK = 1 << 16
DECADES = 10.0
#: Words are told apart by the first 56 bits of their hash.
NAME = ~np.uint64(0xFF)
END = np.uint64(xxhash.xxh64_intdigest(b"")) & NAME
CHUNKS = "chunk long, doc_ids array<long>, held array<boolean>, ends binary, codes binary, words binary, tokens long"
WORDS = "shard int, chunk long, names binary, counts binary"
COUNTS = "shard int, chunk long, counts binary, total long, distinct long, hot binary, hot_count binary"
TRIES = "shard int, chunk long, sizes binary, names binary, children binary, words binary, counts binary"
ANSWERS = "shard int, chunk long, sizes binary, alpha binary, gamma binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


# ---- Elias-Fano sequences -------------------------------------------------------------------------------------------------

def encode(values: np.ndarray) -> list[np.ndarray]:
    """[header, low bytes, high bits, block starts] of a sorted sequence; a low part has a whole number of bytes."""
    n = len(values)
    top = int(values[-1]).bit_length() if n else 0
    low = min(56, max(0, -(-(top - max(n, 1).bit_length() + 1) // 8) * 8))
    at = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, bool)
    bits[at] = True
    lows = values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low // 8]
    return [np.asarray([n, low, len(bits)], np.int64), np.ascontiguousarray(lows).ravel(), np.packbits(bits),
            at[::BLOCK].astype(np.int64)]


class Monotone:
    """A sequence made by ``encode``, read block by block from mapped memory."""

    def __init__(self, parts: list[np.ndarray]):
        (self.n, self.low, self.bits), lows, self.high, starts = (int(x) for x in parts[0]), *parts[1:]
        self.lows = lows.reshape(self.n, self.low // 8)
        self.starts = starts.view(np.int64)

    def block(self, b: int) -> np.ndarray:
        lo, hi = b * BLOCK, min(self.n, (b + 1) * BLOCK)
        first = int(self.starts[b])
        last = int(self.starts[b + 1]) if b + 1 < len(self.starts) else self.bits
        ones = np.flatnonzero(np.unpackbits(self.high[first // 8:-(-last // 8)])[first % 8:][:last - first])[:hi - lo]
        high = (ones + first - np.arange(lo, hi)).astype(np.uint64)
        wide = np.zeros((hi - lo, 8), np.uint8)
        wide[:, :self.low // 8] = self.lows[lo:hi]
        return (high << np.uint64(self.low)) | wide.view("<u8").ravel()

    def all(self) -> np.ndarray:
        return np.concatenate([self.block(b) for b in range(len(self.starts))] or [np.zeros(0, np.uint64)])

    def find(self, asked: list[np.ndarray]) -> list[np.ndarray]:
        """For sorted arrays of values, the position of each value in the sequence or -1."""
        out = [np.full(len(q), -1, np.int64) for q in asked]
        for b in range(len(self.starts)):
            values = self.block(b)
            for q, found in zip(asked, out):
                lo, hi = np.searchsorted(q, values[0]), np.searchsorted(q, values[-1], side="right")
                if lo < hi:
                    at = np.searchsorted(values, q[lo:hi])
                    hit = values[at] == q[lo:hi]
                    found[lo:hi][hit] = at[hit] + b * BLOCK
        return out


def mapped(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The arrays as views of one anonymous memory map (no local file), each aligned to 8 bytes."""
    sizes = [-(-p.nbytes // 8) * 8 for p in parts]
    region = mmap.mmap(-1, max(8, sum(sizes)))
    out, at = [], 0
    for p, size in zip(parts, sizes):
        view = np.frombuffer(region, p.dtype, len(p), at)
        view[:] = p
        out.append(view)
        at += size
    return out


# ---- one level of the trie ------------------------------------------------------------------------------------------------

def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as bytes 1..255 on a logarithmic scale over ``DECADES``; 0 is kept for probability 0."""
    code = np.rint(254 * (1 + np.log10(np.maximum(p, 1e-300)) / DECADES))
    return np.where(p > 0, np.clip(code, 0, 254) + 1, 0).astype(np.uint8)


#: The probability of each byte.
RESTORED = np.concatenate([[0.0], 10 ** (DECADES * (np.arange(255) / 254 - 1))])


def within(values: np.ndarray, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position of each word among ``values[lo:hi]``, which are sorted there, or -1: one binary search for all."""
    end, lo, hi = hi, lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        low, high = lo[open_], hi[open_]
        mid = (low + high) >> 1
        below = values[mid] < word[open_]
        lo[open_], hi[open_] = np.where(below, mid + 1, low), np.where(below, high, mid)
        open_ = open_[lo[open_] < hi[open_]]
    hit = (lo < end) & (values[np.minimum(lo, len(values) - 1)] == word) if len(values) else np.zeros(len(word), bool)
    return np.where(hit, lo, -1)


class Level:
    """Successors of the contexts of the level below: pointers, words and quantised probabilities of one shard."""

    def __init__(self, keys: np.ndarray, contexts: int, counts: np.ndarray, totals: np.ndarray, mu: float):
        """``keys``: sorted (number of the context << 32 | word); ``totals``: tokens that follow each context."""
        parent = (keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        pointers = np.searchsorted(parent, np.arange(contexts + 1)).astype(np.uint64)
        flat = mapped([*encode(pointers), *encode(keys), quantise(counts / (totals[parent] + mu)), quantise(mu / (totals + mu))])
        self.pointers, self.successors = Monotone(flat[:4]), Monotone(flat[4:8])
        self.alpha, self.gamma = flat[8:]

    def find(self, contexts: list[np.ndarray], words: list[np.ndarray]) -> list[np.ndarray]:
        """For each message (numbers of contexts, rising, -1 for none; words): the places of the successors or -1."""
        pointer = self.pointers.all().astype(np.int64)
        context, word = np.concatenate(contexts), np.concatenate(words)
        out = np.full(len(word), -1, np.int64)
        at = np.flatnonzero(context >= 0)
        lo, hi = pointer[context[at]], pointer[context[at] + 1]
        some = lo < hi
        at, lo, hi = at[some], lo[some], hi[some]
        # by the block in which the successors of the context begin
        blocks = len(self.successors.starts)
        block = (lo // BLOCK).astype(np.uint16 if blocks < 1 << 16 else np.int64)
        order = np.argsort(block, kind="stable")
        at, lo, hi, block = at[order], lo[order], hi[order], block[order]
        cuts = np.searchsorted(block, np.arange(blocks + 1))
        low = np.uint64((1 << SUCCESSOR_BITS) - 1)
        for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if x < y:  # the last of these contexts may go on beyond the block
                last = int(hi[x:y].max())
                values = np.concatenate([self.successors.block(i) for i in range(b, (last - 1) // BLOCK + 1)]) & low
                place = within(values, word[at[x:y]], lo[x:y] - b * BLOCK, hi[x:y] - b * BLOCK)
                out[at[x:y]] = np.where(place >= 0, place + b * BLOCK, -1)
        return np.split(out, np.cumsum([len(w) for w in words])[:-1])


# ---- chunks ---------------------------------------------------------------------------------------------------------------

def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held, text) to ``CHUNKS``: token codes (planes of 4 bytes, packed) and the hashes of the distinct words."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in slices(batch, "text", CHUNK_BYTES):
            codes, vocab, ptr = split_words(part.column("text"))
            codes = np.insert(codes.astype(np.uint32), ptr[1:], len(vocab))
            ends = (ptr[1:] + np.arange(1, len(ptr))).astype(np.int64)
            plain = np.ascontiguousarray(codes.view(np.uint8).reshape(-1, 4).T)
            words = np.append(hash_words(vocab), END) & NAME
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                 pa.array([part.column("held").to_pylist()], pa.list_(pa.bool_())), pa.array([ends.tobytes()], pa.binary()),
                 pa.array([packed(plain.tobytes())], pa.binary()), pa.array([planes(words >> np.uint64(8), 7)], pa.binary()),
                 pa.array([len(codes)], pa.int64())], [c.split()[0] for c in CHUNKS.split(", ")])
            number += 1


def gram_hash(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, which are the contexts of the next order."""
    with np.errstate(over="ignore"):
        return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


class Grams:
    """The distinct n-grams of one order in a chunk, sorted by context and word."""

    def __init__(self, parent, word, hashes, count, gram):
        self.parent, self.word, self.hash, self.count = parent, word, hashes, count
        self.gram = gram  # the n-gram that ends at each token, -1 near the start of a document


class Chunk:
    """The tokens of one chunk."""

    def __init__(self, ends: bytes, codes: bytes, words: bytes, held: list):
        self.ends = np.frombuffer(ends, np.int64)
        n = int(self.ends[-1]) if len(self.ends) else 0
        plain = np.frombuffer(unpacked(codes), np.uint8)
        self.codes = np.ascontiguousarray(plain.reshape(4, n).T).view(np.int32).ravel()
        self.words = from_planes(words, 7) << np.uint64(8)
        size = np.diff(np.concatenate([[0], self.ends]))
        self.place = (np.arange(n) - np.repeat(self.ends - size, size)).astype(np.int32)
        self.learn = np.repeat(~np.asarray(held, bool), size)
        self.short = self.words >> np.uint64(64 - SUCCESSOR_BITS)

    def grams(self, order: int) -> list[Grams]:
        """The distinct n-grams of orders 1 to ``order``."""
        by = np.argsort(self.words)
        rank = np.empty(len(by), np.int32)
        rank[by] = np.arange(len(by))
        gram = rank[self.codes]
        out = [Grams(None, self.short[by], self.words[by], np.bincount(gram[self.learn], minlength=len(by)), gram)]
        for n in range(2, order + 1):
            below = out[-1]
            use = np.flatnonzero(self.place >= n - 1)
            key = (below.gram[use - 1].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | self.short[self.codes[use]]
            distinct, inverse = np.unique(key, return_inverse=True)
            parent = (distinct >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
            word = distinct & np.uint64((1 << SUCCESSOR_BITS) - 1)
            gram = np.full(len(self.codes), -1, np.int32)
            gram[use] = inverse
            out.append(Grams(parent, word, gram_hash(below.hash[parent], word),
                             np.bincount(inverse[self.learn[use]], minlength=len(distinct)), gram))
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def among(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in the sorted ``hot``."""
    if not len(hot) or not len(hashes):
        return np.zeros(len(hashes), bool)
    return hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes


def sent(order: int, hot: np.ndarray, shards: int):
    """Where n-grams of an order are kept: with their context, or by their own hash if there is none or it is in ``hot``."""
    def where(context_shard: np.ndarray | None, context: np.ndarray | None, own: np.ndarray) -> np.ndarray:
        alone = shard_of(own, shards)
        return alone if order == 1 else np.where(among(hot, context), alone, context_shard)
    return where


class Parcels:
    """The n-grams of a chunk by shard: per order, rows of (shard, n-gram) with every ancestor a shard needs to place them."""

    def __init__(self, grams: list[Grams], dealers: list):
        own = [dealers[0](None, None, grams[0].hash)]
        for below, g, dealer in zip(grams, grams[1:], dealers[1:]):
            own.append(dealer(own[-1][g.parent], below.hash[g.parent], g.hash))
        self.shard, self.entry, self.mine, self.children = ([None] * len(grams) for _ in range(4))
        away = np.zeros(0, np.int64)  # (shard << 40 | n-gram) of contexts that another shard's n-grams stand below
        for n in range(len(grams) - 1, -1, -1):
            every = len(own[n])
            if len(away):
                home = (own[n] << 40) | np.arange(every)
                key = np.sort(np.concatenate([home, away]))
                self.shard[n], self.entry[n] = key >> 40, key & ((1 << 40) - 1)
                place = np.searchsorted(key, home)
            else:
                few = every and own[n].max() < 1 << 16
                self.entry[n] = np.argsort(own[n].astype(np.uint16) if few else own[n], kind="stable")
                self.shard[n] = own[n][self.entry[n]]
                place = np.empty(every, np.int64)
                place[self.entry[n]] = np.arange(every)
            self.mine[n] = own[n][self.entry[n]] == self.shard[n]
            self.children[n] = np.zeros(len(self.entry[n]), np.int64)
            if n + 1 < len(grams):
                parent, shard = grams[n + 1].parent[self.entry[n + 1]], self.shard[n + 1]
                at = place[parent]
                if len(away):
                    other = np.flatnonzero(own[n][parent] != shard)
                    at[other] = np.searchsorted(key, (shard[other] << 40) | parent[other])
                self.children[n] = np.bincount(at, minlength=len(self.entry[n]))
            if n:
                parent = grams[n].parent[self.entry[n]]
                other = np.flatnonzero(own[n - 1][parent] != self.shard[n])
                away = np.unique((self.shard[n][other] << 40) | parent[other])


def planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian numbers of ``width`` bytes, byte by byte of all numbers, which compresses well."""
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(wide.T).tobytes()


def from_planes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return wide.view("<u8").ravel()


def arrays(batch) -> Iterator[Chunk]:
    for e, c, w, h in zip(*(batch.column(x).to_pylist() for x in ("ends", "codes", "words", "held"))):
        yield Chunk(e, c, w, h)


def columns(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)],
                                      [name for name, _ in fields])


def word_messages(shards: int):
    """mapInArrow body: ``CHUNKS`` to ``WORDS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk in zip(batch.column("chunk").to_pylist(), arrays(batch)):
                grams = chunk.grams(1)[0]
                shard = shard_of(grams.hash, shards)  # rises with the hash
                cuts = np.flatnonzero(np.diff(shard, prepend=-1))
                rows = [(int(shard[lo]), number, planes(grams.hash[lo:hi] >> np.uint64(8), 7), planes(grams.count[lo:hi], 4))
                        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)])]
                yield columns(rows, WORDS)
    return run


def word_counts(frequent: float):
    """applyInArrow body for one shard: the corpus counts of each chunk's words, and the frequent words."""
    def run(messages: pa.Table) -> pa.Table:
        names = [from_planes(b, 7) << np.uint64(8) for b in messages.column("names").to_pylist()]
        count = np.concatenate([from_planes(b, 4) for b in messages.column("counts").to_pylist()]).astype(np.int64)
        seen = count > 0
        keys, inverse = np.unique(np.concatenate(names)[seen], return_inverse=True)
        sums = np.bincount(inverse, weights=count[seen], minlength=len(keys)).astype(np.int64)
        known = Monotone(mapped(encode(keys)))
        often = np.flatnonzero(sums >= frequent)
        shard, chunk = (messages.column(c).to_pylist() for c in ("shard", "chunk"))
        rows = [(s, c, packed(planes(np.where(f >= 0, sums[np.maximum(f, 0)] if len(sums) else 0, 0), 8)), 0, 0, b"", b"")
                for s, c, f in zip(shard, chunk, known.find(names))]
        rows[0] = (*rows[0][:3], int(sums.sum()), len(keys), keys[often].tobytes(), sums[often].astype("<i8").tobytes())
        return pa.Table.from_batches([columns(rows, COUNTS)])
    return run


def frequent_pairs(order: int, hots: list[np.ndarray]):
    """mapInArrow body: ``CHUNKS`` to (gram, n) of the n-grams of an order that frequent contexts and words make up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in arrays(batch):
                often = among(hots[0], chunk.words) & (chunk.words != END)
                at = np.flatnonzero(often[chunk.codes] & chunk.learn)
                at = at[chunk.place[at] >= order - 1]
                name = chunk.words[chunk.codes[at - order + 1]]
                for n in range(1, order):  # each shorter n-gram must be frequent too
                    keep = among(hots[n - 1], name)
                    at, name = at[keep], name[keep]
                    name = gram_hash(name, chunk.short[chunk.codes[at - order + 1 + n]])
                grams, n = np.unique(name, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])
    return run


def trie_messages(order: int, dealers: list):
    """mapInArrow body: ``CHUNKS`` to ``TRIES``, one row per chunk and shard with all its n-grams of orders 2 to ``order``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk in zip(batch.column("chunk").to_pylist(), arrays(batch)):
                grams = chunk.grams(order)
                p = Parcels(grams, dealers)
                counts = [np.where(m, g.count[e], 0) for g, m, e in zip(grams, p.mine, p.entry)]
                present = np.unique(p.shard[1])
                cuts = [np.stack([np.searchsorted(shard, present), np.searchsorted(shard, present, side="right")], axis=1).tolist()
                        for shard in p.shard]
                rows = []
                for i, s in enumerate(present.tolist()):
                    cut = [slice(*c[i]) for c in cuts]
                    each = [p.entry[n][cut[n]] for n in range(order)]
                    rows.append((s, number, np.array([len(e) for e in each], np.int64).tobytes(),
                                 planes(grams[0].hash[each[0]] >> np.uint64(8), 7),
                                 packed(b"".join(planes(p.children[n][cut[n]], 4) for n in range(order - 1))),
                                 b"".join(planes(grams[n].word[each[n]], SUCCESSOR_BITS // 8) for n in range(1, order)),
                                 packed(b"".join(planes(counts[n][cut[n]], 4) for n in range(1, order)))))
                if rows:
                    yield columns(rows, TRIES)
    return run


def packed(data: bytes) -> bytes:
    """Compressed bytes after their plain length."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def by_order(data: bytes, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(sizes)]) * width
    return [from_planes(data[lo:hi], width) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())]


def answered(order: int, hots: list[tuple[np.ndarray, np.ndarray]], mu: float):
    """applyInArrow body for one shard: builds its trie from all chunks and answers each chunk, level by level."""
    def totals(n: int, hashes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        hot, count = hots[n - 1]
        known = among(hot, hashes)
        out = sums.copy()
        out[known] = count[np.searchsorted(hot, hashes[known])]
        return out

    def run(messages: pa.Table) -> pa.Table:
        view = {c: messages.column(c).to_pylist() for c in messages.column_names}
        sizes = [np.frombuffer(b, np.int64) for b in view["sizes"]]
        children = [by_order(unpacked(b), s[:-1], 4) for b, s in zip(view["children"], sizes)]
        words = [by_order(b, s[1:], SUCCESSOR_BITS // 8) for b, s in zip(view["words"], sizes)]
        counts = [by_order(unpacked(b), s[1:], 4) for b, s in zip(view["counts"], sizes)]
        hashes = [from_planes(b, 7) << np.uint64(8) for b in view["names"]]
        names = np.unique(np.concatenate(hashes))
        at = Monotone(mapped(encode(names))).find(hashes)
        total, of_context = None, names
        alphas, gammas = [[] for _ in sizes], [[] for _ in sizes]
        for n in range(2, order + 1):
            parent, word, count = [], [c[n - 2] for c in words], [c[n - 2].astype(np.int64) for c in counts]
            for m in range(len(sizes)):
                repeats = children[m][n - 2].astype(np.int64)
                parent.append(np.repeat(at[m], repeats))
                hashes[m] = gram_hash(np.repeat(hashes[m], repeats), word[m])
            every, c = np.concatenate(parent), np.concatenate(count)
            name = np.concatenate(hashes)
            keep = (every >= 0) & ((c > 0) | (among(hots[n - 1][0], name) if n < order else False))
            key = (every[keep].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | np.concatenate(word)[keep]
            keys, inverse = np.unique(key, return_inverse=True)
            sums = np.bincount(inverse, weights=c[keep], minlength=len(keys)).astype(np.int64)
            if total is None:  # what follows a word is kept in one shard, or the word is frequent and its count known
                follow = np.bincount((keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), weights=sums, minlength=len(names))
                total = totals(1, names, follow.astype(np.int64))
            level = Level(keys, len(of_context), sums, total, mu)
            found = level.find(parent, word)
            for m in range(len(sizes)):
                alphas[m].append(np.where(found[m] >= 0, level.alpha[np.maximum(found[m], 0)] if len(keys) else 0, 0).astype(np.uint8))
                gammas[m].append(np.where(at[m] >= 0, level.gamma[np.maximum(at[m], 0)] if len(level.gamma) else 255, 255).astype(np.uint8))
            at, of_context = found, np.empty(len(keys), np.uint64)
            of_context[inverse] = name[keep]
            total = totals(n, of_context, sums) if n < order else sums
        rows = [(s, c, z, packed(b"".join(a.tobytes() for a in x)), packed(b"".join(g.tobytes() for g in y)))
                for s, c, z, x, y in zip(view["shard"], view["chunk"], view["sizes"], alphas, gammas)]
        return pa.Table.from_batches([columns(rows, ANSWERS)])
    return run


def scored(order: int, hots: list[tuple[np.ndarray, np.ndarray]], dealers: list, total: int, distinct: int, mu: float):
    """cogroup body for one chunk: its tokens and the answers of all shards to ``SCORES``."""
    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        word_parts, parts = [], []
        for kind, s, *rest in sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "shard", "sizes", "alpha", "gamma")))):
            (word_parts if kind == 1 else parts).append(rest)
        for ids, held, chunk in zip(chunks.column("doc_ids").to_pylist(), chunks.column("held").to_pylist(), arrays(chunks)):
            grams = chunk.grams(order)
            count = np.concatenate([from_planes(unpacked(a), 8) for _, a, _ in word_parts]).astype(np.int64)[grams[0].gram]
            p = (count + 0.1) / (total + 0.1 * (distinct + 1))
            base, known = np.log10(p), count > 0
            if order > 1 and parts:
                deal = Parcels(grams, dealers)
                sizes = [np.frombuffer(z, np.int64) for z, _, _ in parts]
                alpha = [np.concatenate(a) for a in zip(*(split(x, s[1:]) for (_, x, _), s in zip(parts, sizes)))]
                gamma = [np.concatenate(g) for g in zip(*(split(x, s[:-1]) for (_, _, x), s in zip(parts, sizes)))]
                for n in range(2, order + 1):
                    a, g = np.zeros(len(grams[n - 1].hash)), np.ones(len(grams[n - 2].hash))
                    mine, ours = deal.mine[n - 1], deal.mine[n - 2]
                    a[deal.entry[n - 1][mine]] = RESTORED[alpha[n - 2][mine]]
                    g[deal.entry[n - 2][ours]] = RESTORED[gamma[n - 2][ours]]
                    hot, often = hots[n - 2]
                    spread = among(hot, grams[n - 2].hash)
                    if spread.any():
                        g[spread] = RESTORED[quantise(mu / (often[np.searchsorted(hot, grams[n - 2].hash[spread])] + mu))]
                    use = np.flatnonzero(grams[n - 1].gram >= 0)
                    p = p.copy()
                    p[use] = a[grams[n - 1].gram[use]] + g[grams[n - 2].gram[use - 1]] * p[use]
            first = np.concatenate([[0], chunk.ends[:-1]])
            score = np.log10(np.maximum(p, 1e-300))
            out.append(pa.table([
                pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(chunk.ends - first),
                pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.full(len(ids), total, np.int64)),
                pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(score, first))],
                names=[c.split()[0] for c in SCORES.split(", ")]))
        return pa.concat_tables(out)

    def split(data: bytes, sizes: np.ndarray) -> list[np.ndarray]:
        return np.split(np.frombuffer(unpacked(data), np.uint8), np.cumsum(sizes)[:-1])
    return run


def score_documents(docs: DataFrame, held_out, order: int = ORDER, mu: float = MU,
                    shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``SCORES`` of every document under the model of the documents for which ``held_out`` does not hold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), "text")
    chunks = written(rows.mapInArrow(chunked, CHUNKS), "chunks", compression="zstd")
    tokens = chunks.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return spark.createDataFrame([], SCORES)
    shards = max(1, -(-tokens // shard_tokens))
    frequent = shard_tokens / 8
    none = np.zeros(0, np.uint64)
    counted = written(chunks.mapInArrow(word_messages(shards), WORDS).groupBy("shard")
                      .applyInArrow(word_counts(frequent), COUNTS), "word-counts", compression="zstd")
    total, distinct = counted.agg(F.sum("total"), F.sum("distinct")).first()
    # at most 8 n-grams a shard and order are this frequent
    rare = counted.where(F.length("hot") > 0).select("hot", "hot_count").collect()
    hots = [by_hash(np.frombuffer(b"".join(r["hot"] for r in rare), np.uint64),
                    np.frombuffer(b"".join(r["hot_count"] for r in rare), "<i8"))]
    for n in range(2, order):
        pairs = chunks.mapInArrow(frequent_pairs(n, [h for h, _ in hots]), "gram long, n long") if len(hots[-1][0]) else None
        often = [] if pairs is None else pairs.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= frequent).collect()
        hots.append(by_hash(np.array([r["gram"] for r in often], np.int64).view(np.uint64), np.array([r["n"] for r in often], np.int64)))
    dealers = [sent(n, none if n == 1 else hots[n - 2][0], shards) for n in range(1, order + 1)]
    answers = counted.select(F.lit(1).alias("kind"), "chunk", "shard", F.lit(None).cast("binary").alias("sizes"),
                             F.col("counts").alias("alpha"), F.lit(None).cast("binary").alias("gamma"))
    if order > 1:
        got = written(chunks.mapInArrow(trie_messages(order, dealers), TRIES).groupBy("shard")
                      .applyInArrow(answered(order, hots, mu), ANSWERS), "answers", compression="zstd")
        answers = answers.union(got.select(F.lit(2).alias("kind"), "chunk", "shard", "sizes", "alpha", "gamma"))
    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(scored(order, hots, dealers, total, distinct, mu), SCORES)
            .withColumnRenamed("held", "held_out"))


def by_hash(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def op9_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)
