"""SentencePiece encoding and decoding (byte-pair models with byte fallback) by suffix-array matching.

The distinct units of a batch (a run of spaces and what follows up to the next one; no piece spans two) are joined into one
text.  Its suffixes are sorted by their first characters, every piece's range of occurrences is found by binary search, and
the occurrences become edges (start, end, piece), sorted by end.  Relaxing the edges by end position gives, for every prefix of a unit, the
last piece of its encoding: the one edge whose piece is compatible with the last piece of the prefix before it.  Two adjacent
pieces are compatible if undoing their merges from the latest to the earliest never meets a better merge across
the border; a sequence is the model's encoding if and only if all its adjacent pieces are.  Characters that no piece covers
become byte pieces.

The vocabulary file is a parameter (``PIECES``, a public tokenizer's model); its tables are the only broadcast.

Defined cases: NULL and empty texts have no pieces; repeated rows and NULL ids are rows like any other; a text of any length is
encoded whole; ids outside the vocabulary decode to nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, utf8_bytes

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SLICE_BYTES = 10 << 20
INDEX_CHARS = 1 << 20
NEVER = np.int64(1) << 40
#: Units that are left to be relaxed alone, and borders looked at together there.
FEW, WINDOW = 16, 50_000


class Vocabulary:
    """Arrays of a model's pieces.  Symbols are ids, and beyond them characters that occur in pieces only."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        text = {sp.id_to_piece(i).replace(SPACE, " "): i for i in plain}
        rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
        byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = np.asarray([byte_ids.get(b, sp.unk_id()) for b in range(256)], np.int32)
        symbols = dict(text)
        for piece in text:
            for c in piece:
                symbols.setdefault(c, len(symbols) + n)
        total = max(symbols.values(), default=0) + 1
        self.left, self.right = np.arange(total), np.arange(total)
        self.rank = np.full(total, -1, np.int64)  # single characters come before every merge
        merges, reached = [], []
        for piece, i in text.items():
            if len(piece) > 1:
                last = final_merge(piece, text, rank)
                if last is None:
                    continue
                a, b = symbols[last[0]], symbols[last[1]]
                self.left[i], self.right[i], self.rank[i] = a, b, rank[i]
                merges.append((a, b, i))
            reached.append((piece, i))
        self.total = total
        self.pieces = sorted(reached)
        self.table, self.merged, self.factor = pair_table(merges, total)
        out = [b""] * total
        for piece, i in symbols.items():
            out[i] = piece.encode()
        for b, i in byte_ids.items():
            out[i] = bytes([b])
        if sp.unk_id() >= 0:
            out[sp.unk_id()] = " ⁇ ".encode()
        self.spelled = np.frombuffer(b"".join(out), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(x) for x in out])])


def final_merge(piece: str, text: dict[str, int], rank: dict[int, int]) -> tuple[str, str] | None:
    """The last two symbols merged when the piece itself is encoded; None if it is not reached."""
    parts = list(piece)
    last = None
    while len(parts) > 1:
        best = None
        for j in range(len(parts) - 1):
            i = text.get(parts[j] + parts[j + 1])
            if i is not None and (best is None or rank[i] < best[0]):
                best = (rank[i], j)
        if best is None:
            return None
        j = best[1]
        last = (parts[j], parts[j + 1])
        parts[j:j + 2] = [parts[j] + parts[j + 1]]
    return last


def pair_table(merges: list[tuple[int, int, int]], total: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """A table of buckets of four pairs, such that each pair is in its hashed bucket, and the merged piece of each place."""
    keys = np.asarray([a * total + b for a, b, _ in merges], np.uint64)
    bits = max(4, len(keys).bit_length())
    rng = np.random.default_rng(4)
    while True:
        factor = np.uint64(rng.integers(1, 1 << 62)) * np.uint64(2) + np.uint64(1)
        with np.errstate(over="ignore"):
            bucket = ((keys * factor) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.arange(len(keys)) - np.searchsorted(bucket[order], bucket[order])
        if not len(keys) or place.max() < 4:
            break
        bits += 1
    found, merged = np.full((1 << bits, 4), np.iinfo(np.uint64).max, np.uint64), np.full((1 << bits, 4), -1, np.int64)
    found[bucket[order], place] = keys[order]
    merged[bucket[order], place] = np.asarray([i for _, _, i in merges], np.int64)[order] if merges else []
    return found, merged, factor


def merge_rank(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the merge of each pair of symbols, ``NEVER`` if they do not merge."""
    key = (a * v.total + b).astype(np.uint64)
    with np.errstate(over="ignore"):
        at = ((key * v.factor) >> np.uint64(65 - len(v.table).bit_length())).astype(np.int64)
    hit = v.table[at] == key[:, None]
    some = np.flatnonzero(hit.any(axis=1))
    out = np.full(len(a), NEVER)
    out[some] = v.rank[v.merged[at[some]][hit[some]]]
    return out


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pieces a and b can stand side by side.

    Merges are undone from the latest: of the two symbols at the border the later made is split.  ``since`` is the rank of the
    last merge undone; a merge across the border of a better rank would have come before it.  Of equal ranks the left one
    comes first.
    """
    ok = np.ones(len(a), bool)
    at = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    since = np.full(len(a), NEVER)
    while len(at):
        across = merge_rank(v, a, b)
        bad = across < since
        ok[at[bad]] = False
        ra, rb = v.rank[a], v.rank[b]
        go = ~bad & ((ra >= 0) | (rb >= 0))
        at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
        split_a = ra > rb
        since = np.where(split_a, ra, rb + 1)
        a, b = np.where(split_a, v.right[a], a), np.where(split_a, b, v.left[b])
    return ok


class Index:
    """The suffixes of a text of character ranks (0 between units), sorted by two keys of ``span`` characters each."""

    def __init__(self, chars: np.ndarray, n_ranks: int):
        self.bits = max(1, int(n_ranks).bit_length())
        self.span = 64 // self.bits
        padded = np.concatenate([chars.astype(np.uint64), np.zeros(2 * self.span, np.uint64)])
        n = len(chars)
        key = np.zeros(n + self.span, np.uint64)
        for j in range(self.span):
            key = (key << np.uint64(self.bits)) | padded[j:j + n + self.span]
        self.order = np.lexsort((key[self.span:], key[:n]))
        self.first, self.second = key[:n][self.order], key[self.span:][self.order]

    def bounds(self, ranks: list[int]) -> tuple[int, int]:
        """Least and greatest key that begin with the ranks."""
        low = 0
        for r in ranks:
            low = (low << self.bits) | r
        rest = self.bits * (self.span - len(ranks))
        return low << rest, (low << rest) | ((1 << rest) - 1)

    def ranges(self, pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Range of sorted suffixes that begin with each piece (checked up to two keys)."""
        heads = [self.bounds(p[:self.span]) for p in pieces]
        lo = np.searchsorted(self.first, np.asarray([h[0] for h in heads], np.uint64))
        hi = np.searchsorted(self.first, np.asarray([h[1] for h in heads], np.uint64), side="right")
        for i in np.flatnonzero(hi > lo).tolist():
            if len(pieces[i]) > self.span:
                a, b = self.bounds(pieces[i][self.span:2 * self.span])
                inside = self.second[lo[i]:hi[i]]
                lo[i], hi[i] = (lo[i] + np.searchsorted(inside, np.uint64(a)),
                                lo[i] + np.searchsorted(inside, np.uint64(b), side="right"))
        return lo, hi


def relax_alone(v: Vocabulary, lead: int, size: int, step: int, first: np.ndarray, start: np.ndarray, piece: np.ndarray,
                last: np.ndarray, back: np.ndarray) -> None:
    """Relaxes the edges of one long unit from its ``step``-th border on, in windows.

    Which pieces may follow which at the borders of a window is settled for all pairs at once; then one pass of plain
    look-ups goes from border to border.
    """
    ends, before = last[lead:lead + size + 1].tolist(), back[lead:lead + size + 1].tolist()
    for w in range(step, size + 1, WINDOW):
        lo, hi = lead + w, min(lead + w + WINDOW, lead + size + 1)
        edges = slice(first[lo], first[hi])
        at, own = start[edges], piece[edges]
        many = np.where(at > lead, first[at + 1] - first[at], 0)
        edge = np.repeat(np.arange(len(at)), many)
        left = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)
        pairs = np.unique((piece[left].astype(np.int64) << 32) | own[edge])
        fits = set(pairs[compatible(v, pairs >> 32, pairs & 0xFFFFFFFF)].tolist())
        at, own, cuts = (at - lead).tolist(), own.tolist(), (first[lo:hi + 1] - first[lo]).tolist()
        for i in range(hi - lo):
            for e in range(cuts[i], cuts[i + 1]):
                s = at[e]
                if s == 0 or ends[s] < 0 or (ends[s] << 32 | own[e]) in fits:
                    ends[w + i], before[w + i] = own[e], s + lead
                    break
    last[lead:lead + size + 1], back[lead:lead + size + 1] = ends, before


def encode_units(units: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all units, offsets by unit)."""
    text = [u.decode("utf-8", "replace") for u in units]
    size = np.asarray([len(t) for t in text], np.int64)
    points = np.frombuffer("\0".join([*text, ""]).encode("utf-32-le"), np.uint32)  # a 0 after every unit
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    inside = np.ones(len(points), bool)
    inside[begin + size] = False
    present = np.zeros(0x110000, bool)
    present[points[inside]] = True
    rank = np.cumsum(present) * present
    chars = np.where(inside, rank[points], 0)
    index = Index(chars, int(rank.max()))

    found, ids = [], []
    for piece, i in v.pieces:
        ranks = [int(rank[ord(c)]) for c in piece]
        if all(ranks):
            found.append(ranks)
            ids.append(i)
    lo, hi = index.ranges(found)
    length = np.asarray([len(r) for r in found], np.int64)
    ids = np.asarray(ids, np.int64)
    many = hi - lo
    which = np.repeat(np.arange(len(ids)), many)
    spot = index.order[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    for i in np.flatnonzero((length > 2 * index.span) & (many > 0)).tolist():  # longer than both keys: compare the rest
        own = np.flatnonzero(which == i)
        whole = (chars[np.minimum(spot[own][:, None] + np.arange(length[i]), len(chars) - 1)] == found[i]).all(axis=1)
        which, spot = np.delete(which, own[~whole]), np.delete(spot, own[~whole])
    # edges in order of their end, the longer first
    edges = np.sort(((spot + length[which]).astype(np.uint64) << np.uint64(32))
                    | ((np.uint64(255) - np.minimum(length, 255)[which].astype(np.uint64)) << np.uint64(24))
                    | which.astype(np.uint64))
    end = (edges >> np.uint64(32)).astype(np.int64)
    which = (edges & np.uint64((1 << 24) - 1)).astype(np.int64)
    piece, start = ids[which], end - length[which]
    first = np.searchsorted(end, np.arange(len(points) + 2))

    last = np.full(len(points) + 1, -1, np.int64)  # the last piece of the encoding of the unit up to here
    back = np.arange(len(points) + 1) - 1  # where that piece starts; a character without a piece stands alone
    by_size = np.argsort(-size, kind="stable")
    sorted_size = -size[by_size]
    for step in range(1, int(size.max(initial=0)) + 1):
        live = by_size[:np.searchsorted(sorted_size, -step, side="right")]
        if len(live) <= FEW:  # the longest units go on alone
            for u in live.tolist():
                relax_alone(v, int(begin[u]), int(size[u]), step, first, start, piece, last, back)
            break
        at = begin[live] + step
        edge, stop = first[at], first[at + 1]
        base = at - step
        while True:
            more = edge < stop
            if not more.all():
                at, edge, stop, base = at[more], edge[more], stop[more], base[more]
            if not len(at):
                break
            s = start[edge]
            before = last[s]
            good = (s == base) | (before < 0)
            check = np.flatnonzero(~good)
            if len(check):
                good[check] = compatible(v, before[check], piece[edge[check]])
            done = at[good]
            last[done], back[done] = piece[edge[good]], s[good]
            left = ~good
            at, edge, stop, base = at[left], edge[left] + 1, stop[left], base[left]

    # back along the chosen edges, all units at once
    pos, unit = begin + size, np.arange(len(units))
    steps = []
    while True:
        live = pos > begin[unit]
        pos, unit = pos[live], unit[live]
        if len(pos) <= FEW:
            for p, u in zip(pos.tolist(), unit.tolist()):
                chain, lead = [], int(begin[u])
                behind = back[lead:p + 1].tolist()
                while p > lead:
                    chain.append(p)
                    p = behind[p - lead]
                steps.append((np.full(len(chain), u), np.array(chain, np.int64), last[chain]))
            break
        steps.append((unit, pos, last[pos]))
        pos = back[pos]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(units) + 1, np.int64)
    unit, pos, token = (np.concatenate([s[i] for s in steps]) for i in range(3))
    order = np.lexsort((pos, unit))
    unit, pos, token = unit[order], pos[order], token[order]
    bare = np.flatnonzero((token < 0) | (token >= v.size))  # characters without a piece: their bytes
    if len(bare):
        spelled = [chr(c).encode("utf-8", "replace") for c in points[pos[bare] - 1].tolist()]
        extra = np.ones(len(token), np.int64)
        extra[bare] = [len(s) for s in spelled]
        at = np.cumsum(extra) - extra
        unit, token = np.repeat(unit, extra), np.repeat(token, extra)
        for a, s in zip(at[bare].tolist(), spelled):
            token[a:a + len(s)] = v.bytes[list(s)]
    return token.astype(np.int32), np.searchsorted(unit, np.arange(len(units) + 1))


def encode_texts(texts: pa.Array, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, offsets by text)."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, ""))  # the model's dummy prefix
    raw, off = utf8_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    space = raw == 32
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[off[:-1][off[:-1] < len(raw)]] = True
    at = np.flatnonzero(start)
    units = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(raw)).astype(np.int32)),
                                                         pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    codes, vocab = units.indices.to_numpy(), units.dictionary.to_pylist()
    ids, counts = [], []
    group, held = [], 0
    for u in [*vocab, None]:
        if group and (u is None or held + len(u) > INDEX_CHARS):
            got, ptr = encode_units(group, v)
            ids.append(got)
            counts.append(np.diff(ptr))
            group, held = [], 0
        if u is not None:
            group.append(u)
            held += len(u)
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    begin = np.cumsum(counts) - counts
    each = counts[codes]
    upto = np.cumsum(each)
    out = ids[np.arange(int(upto[-1])) - np.repeat(upto - each - begin[codes], each)]
    return out, np.concatenate([[0], upto])[np.searchsorted(at, off)]


def decode_ids(ids: np.ndarray, off: np.ndarray, v: Vocabulary) -> pa.Array:
    """The text of each sequence of ids."""
    ids = np.where((ids >= 0) & (ids < v.size), ids, v.total)
    at, size = np.append(v.spelled_at[:-1], 0), np.append(np.diff(v.spelled_at), 0)
    each = size[ids]
    upto = np.concatenate([[0], np.cumsum(each)])
    raw = v.spelled[np.arange(int(upto[-1])) - np.repeat(upto[:-1] - at[ids], each)]
    edge = upto[off]
    prefixed = (np.diff(edge) > 0) & (raw[np.minimum(edge[:-1], max(len(raw) - 1, 0))] == 32) if len(raw) else np.zeros(
        len(off) - 1, bool)
    keep = np.ones(len(raw), bool)
    keep[edge[:-1][prefixed]] = False  # the dummy prefix
    raw, edge = raw[keep], edge - np.concatenate([[0], np.cumsum(prefixed)])
    whole = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)),
                                                              pa.py_buffer(np.ascontiguousarray(raw))])
    try:
        return whole.cast(pa.string())
    except pa.ArrowInvalid:  # byte pieces that are no characters
        return pa.array([b.decode("utf-8", "replace") for b in whole.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str = PIECES, verify: bool = False) -> DataFrame:
    """doc_id, n_pieces and ids of each text; with ``verify`` also whether decoding the ids gives the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # fixed by the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                texts = part.column("text")
                ids, off = encode_texts(texts, v)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                columns = [part.column("doc_id"), pa.array(np.diff(off)), lists]
                if verify:
                    columns.append(pc.equal(decode_ids(ids, off, v),
                                            pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_pieces", "ids", *(["round_trip"] if verify else [])]
    schema = "doc_id long, n_pieces long, ids array<int>" + (", round_trip boolean" if verify else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = PIECES) -> DataFrame:
    """doc_id and the text of each row's ids (NULL ids: empty)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(batch.column("ids").flatten(), -1).to_numpy(zero_copy_only=False)
                texts = decode_ids(ids, np.concatenate([[0], np.cumsum(size)]).astype(np.int64), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), verify=True)
