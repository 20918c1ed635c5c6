"""N-gram Jaccard join over count vectors in R-trees.

A document is the set of its distinct word shingles. Shingles are hashed into groups; the counts by group
are a point, and the sum over groups of the smaller count bounds the overlap of two sets from above. Points
are packed into R-trees, whose boxes' upper corners give the same bound for all points of a box; pairs that
survive are verified on the full sets.

A single R-tree over all documents would not prune: unrelated points of a space of so many dimensions share
their boxes. So the trees are built over documents with something rare in common, which any linked pair
has: a shingle among the first n - ceil(t n) + 1 of both under one order of all shingles (rare ones first).

1. Documents with such a shingle, in the order of their sizes, are parted where no link can reach across.
   Where few are left together, their pairs are held against the bound one by one; where many, they are tied.
2. Tied documents are clustered, and the points of each cluster and band of sizes go into an R-tree, which
   leaves the pairs that the bound allows.
3. The components of the pairs of both kinds are the clusters whose sets are read again and verified.

Equal sets are one node throughout, so copies cost nothing. A tree or cluster too large for one task is
first held against one of its members; only documents that don't link with that one meet all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattspark.llm.common import chosen_rows, forget, give_back, parallelism, released_by_worker, settle, tidy, written
from wattspark.llm.components import components
from wattspark.llm.shingles import mixed, sets_of, signature

#: A link: share of the common shingles in all shingles of the two, as a fraction.
LINK = (75, 100)
#: Slots of the shingle order: a table of fixed size, whatever the corpus (1 byte a slot in the broadcast), in chunks of _CHUNK.
#: Only shingles of several documents enter it, the most frequent first, up to a share of its slots.
ORDER_SLOTS = 1 << 23
MOST_TAKEN = ORDER_SLOTS // 4
#: Rows of four numbers that are broadcast at most.
MOST_BROADCAST = 1 << 18
_CHUNK = 1 << 13
#: Shingles a group of the count vectors holds on average.
GROUP_LOAD = 8
LEAF = 32
#: Documents of a cluster that one task compares with each other.
MOST_IN_TASK = 512
#: Bits of the map of wanted ids that spares reading sets nobody needs: eight for each id, at most 8 MB of them.
MOST_WANTED_BITS = 1 << 26


def need(n_a, n_b, link: tuple[int, int] = LINK):
    """The least overlap of a linked pair of sets of these sizes."""
    p, q = link
    return -(-p * (n_a + n_b) // (p + q))


def groups_for(size: int) -> int:
    """Groups for a set of `size` shingles, a power of two."""
    return 1 << max(3, int(size // GROUP_LOAD).bit_length())


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The most that two sets can have in common, by their points; the longer point is folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.minimum(a.reshape(-1, len(b)).sum(axis=0), b).sum())


def count_vector(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups)


class RTree:
    """Points packed in boxes by size and coordinates; a box keeps the least size and the largest counts in it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = LEAF):
        self.points, self.sizes = points, sizes
        # sort-tile packing: slabs by size, in them by the heaviest groups' counts
        heavy = np.argsort(-points.sum(axis=0), kind="stable")[:2]
        slabs = np.argsort(sizes, kind="stable")
        width = max(leaf, int(np.ceil(len(sizes) / max(1, np.sqrt(len(sizes) / leaf)))))
        order = [s[np.lexsort(points[s][:, heavy].T)] for s in np.split(slabs, range(width, len(slabs), width))]
        self.order = np.concatenate(order) if order else slabs
        starts = np.arange(0, len(self.order), leaf)
        self.leaves = np.split(self.order, starts[1:])
        self.upper = np.maximum.reduceat(points[self.order], starts, axis=0)
        self.least = np.minimum.reduceat(sizes[self.order], starts)
        self.most = np.maximum.reduceat(sizes[self.order], starts)
        # one level of boxes of boxes
        tops = np.arange(0, len(starts), leaf)
        self.top_upper = np.maximum.reduceat(self.upper, tops, axis=0)
        self.top_least = np.minimum.reduceat(self.least, tops)
        self.fan = leaf

    def partners(self, point: np.ndarray, size: int, link: tuple[int, int] = LINK) -> np.ndarray:
        """The points whose bound allows a link with this one."""
        tops = np.nonzero(np.minimum(self.top_upper, point).sum(axis=1) >= need(size, self.top_least, link))[0]
        boxes = (tops[:, None] * self.fan + np.arange(self.fan)).ravel()
        boxes = boxes[boxes < len(self.leaves)]
        fit = (np.minimum(self.upper[boxes], point).sum(axis=1) >= need(size, self.least[boxes], link)) & (self.most[boxes] * link[1] >= size * link[0]) & (self.least[boxes] * link[0] <= size * link[1])
        if not fit.any():
            return np.zeros(0, np.int64)
        some = np.concatenate([self.leaves[i] for i in boxes[fit]])
        return some[np.minimum(self.points[some], point).sum(axis=1) >= need(size, self.sizes[some], link)]


def folded(points: list[np.ndarray]) -> np.ndarray:
    """Points of several lengths, all folded to the shortest."""
    least = min(map(len, points))
    return np.stack([p.reshape(-1, least).sum(axis=0, dtype=np.int64) for p in points])


def spanning_links(points: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None = None, rest: np.ndarray | None = None, home: np.ndarray | None = None, link: tuple[int, int] = LINK) -> list[tuple[int, int]]:
    """Links that join what all links join (a forest): verified on `sets`, without them all that the bound allows.

    With `rest`, only links of a document of it with one outside it count; with `home`, only those of a home.
    """
    root = np.arange(len(sizes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    tree, out = RTree(points, sizes), []
    for a in np.argsort(-sizes, kind="stable") if rest is None else np.nonzero(rest)[0]:
        for b in tree.partners(points[a], sizes[a], link):
            if a == b or (rest is not None and rest[b]) or (home is not None and not (home[a] or home[b])):
                continue
            x, y = find(a), find(b)
            if x == y:
                continue
            if sets is None or len(np.intersect1d(sets[a], sets[b], assume_unique=True)) >= need(sizes[a], sizes[b], link):
                root[x] = y
                out.append((int(a), int(b)))
    return out


#: Shingles that a task gathers before it combines their counts.
_COUNTED = 1 << 21
#: Bits of a shingle, besides those of its chunk, by which its documents are counted.
_CELL_BITS = 24


def _counted(held: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Chunks of the shingle order, and for each the documents of its shingles: steps between cells, and counts, a byte plane each."""
    own = np.concatenate(held)
    slot = own & np.uint64(ORDER_SLOTS - 1)
    inner = (own >> np.uint64(40)) % np.uint64((1 << _CELL_BITS) // _CHUNK) * np.uint64(_CHUNK) + slot % np.uint64(_CHUNK)
    cells, times = np.unique(((slot // np.uint64(_CHUNK)) << np.uint64(_CELL_BITS)) | inner, return_counts=True)
    chunks, cells = (cells >> np.uint64(_CELL_BITS)).astype(np.int32), (cells & np.uint64((1 << _CELL_BITS) - 1)).astype(np.uint32)
    begins = np.nonzero(np.concatenate(([True], chunks[1:] != chunks[:-1])))[0]
    steps = np.diff(cells, prepend=np.uint32(0))
    steps[begins] = cells[begins]
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 4)[:, :3], np.minimum(times, 0xFF).astype(np.uint8)[:, None]], axis=1)
    return chunks[begins], [planes[i:j].T.tobytes() for i, j in zip(begins, [*begins[1:], len(chunks)])]


def _cells(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(packed, np.uint8).reshape(4, -1)
    steps = np.zeros((planes.shape[1], 4), np.uint8)
    steps[:, :3] = planes[:3].T
    return np.cumsum(steps.view(np.uint32).ravel(), dtype=np.uint32), planes[3]


def _outlines(rows: DataFrame) -> DataFrame:
    """(id, mark, n, sig, point) for each document, a byte a group, and the counts of all shingles as rows (chunk, counts)."""
    names = ["id", "mark", "n", "sig", "point", "chunk", "counts"]

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released_by_worker()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def counts() -> pa.RecordBatch:
            chunks, packed = _counted(held)
            m = len(chunks)
            return pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.binary()), pa.array(chunks), pa.array(packed, pa.binary())], names)

        for batch in batches:
            n, sig, point = [], [], []
            for s in sets_of(batch.column(1)):
                n.append(len(s))
                at = count_vector(s, groups_for(len(s)))
                point.append((at if at.max() < 256 else np.full(len(at), 255)).astype(np.uint8).tobytes())  # all full: pruned by size alone
                sig.append(signature(s) if len(s) else None)
                if not len(s) or sig[-1] in seen:  # copies in one task count once
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sig[-1])
                held.append(s)
                size += len(s)
                if size > _COUNTED:
                    yield counts()
                    held, size = [], 0
            m = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.int64()), pa.array(point, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if held:
            yield counts()

    return rows.select("id", "text", "mark").mapInArrow(tidy(outline), "id long, mark long, n long, sig long, point binary, chunk int, counts binary")


def _order_table(counted: DataFrame) -> np.ndarray:
    """The order's classes by slot: the logarithm of a shingle's documents in quarters of a power of two, of shingles in one slot
    the greatest; 0 for shingles of one document and for the rarest of the others, so that the classed take MOST_TAKEN slots at most.

    The documents of a shingle are counted by itself and not by its slot, where at some GB all the rare shingles of a
    slot together would hide what is frequent.
    """

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def done() -> pa.RecordBatch:
            cells, times = (np.concatenate(x) for x in zip(*map(_cells, held)))
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            begins = np.nonzero(np.concatenate(([True], cells[1:] != cells[:-1])))[0]
            total = np.add.reduceat(times[order].astype(np.int64), begins)
            shared = total > 1
            classes = np.zeros(_CHUNK, np.uint8)
            np.maximum.at(classes, (cells[begins][shared] % _CHUNK).astype(np.int64), np.round(4 * np.log2(1 + total[shared])).clip(0, 255).astype(np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["chunk", "classes"])

        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if chunk != now and held:
                    yield done()
                    held = []
                now = chunk
                held.append(counts)
        if held:
            yield done()

    dealt = counted.filter("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    table = np.zeros(ORDER_SLOTS, np.uint8)
    for r in dealt.mapInArrow(tidy(classed), "chunk int, classes binary").collect():
        table[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(bytes(r["classes"]), np.uint8)
    upwards = np.cumsum(np.bincount(table, minlength=256)[::-1])[::-1]  # slots of a class and above
    least = 1 + int(np.argmax(np.append(upwards[1:], 0) <= MOST_TAKEN))
    table[table < least] = 0
    return table


def prefix(shingles: np.ndarray, classes: np.ndarray, link: tuple[int, int] = LINK) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles in the order of (class of the slot, hash)."""
    p, q = link
    keep = len(shingles) - -(-p * len(shingles) // q) + 1
    rank = classes[(shingles & np.uint64(ORDER_SLOTS - 1)).astype(np.int64)]
    return shingles[np.argsort(rank, kind="stable")[:keep]]


#: Prefix rows that a task gathers before it combines and passes them on.
_GATHER = 1 << 20


#: Documents with one shingle in their prefixes, and sizes that can link, up to which each pair is looked at on its own.
FEW = 8


#: In rows of shingles: sizes as logarithms in steps of a thousandth, places in the prefix as shares of the size, and 40
#: bits of shingles (besides those of their bucket) and signatures. More than one document may answer to a node; that only adds candidates.
_STEPS, _PLACES, _NODE = 1024, 1020, (1 << 40) - 1


def size_codes(n: np.ndarray) -> np.ndarray:
    """A code of sizes, rounded down; the next one is above the size."""
    return np.floor(np.log2(n) * _STEPS + 1e-9).astype(np.uint16)


def _size_of(codes: np.ndarray) -> np.ndarray:
    return np.exp2(codes / _STEPS)


def _meeting(tokens: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray, stands: np.ndarray, link: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What to pass on of rows (token, node, codes of sizes from low to below high, place, stands for many): an index of rows, their
    sizes from and to, which of these stand for many, pairs (a < b) of nodes that share a token with
    few others, and pairs that tie those of a token with many to one of them.

    The rows of a token are parted by size where none on one side can link with any on the other. A pair whose first common
    token this is must find its overlap in what follows; sizes and places that leave too little make no pair. The
    rows of a part with many are passed on as one. It stands for
    others that may link where it doesn't, so a part with such a row has many, however few rows arrive.
    """
    order = np.lexsort((nodes, stands, low, tokens))
    tokens, nodes, stands = tokens[order], nodes[order], stands[order]
    once = np.ones(len(tokens), bool)  # a set that several tasks have met
    once[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1]) | stands[1:] | stands[:-1]
    order, tokens, nodes, stands = order[once], tokens[once], nodes[once], stands[once]
    low, high, places = low[order].astype(np.int64), high[order].astype(np.int64), places[order]
    least, most = _size_of(low), _size_of(high)
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    reach = np.maximum.accumulate(high + ((np.cumsum(first) - 1) << 20)) & 0xFFFFF  # the largest size so far of the token
    first[1:] |= _size_of(reach[:-1]) * link[1] < least[1:] * link[0]
    group = np.cumsum(first) - 1
    few = ((np.bincount(group) <= FEW) & (np.bincount(group, stands) == 0))[group]
    rest = most - np.floor(places / _PLACES * least)  # what is left of a set from the token on
    pairs = [np.zeros((0, 2), np.int64)]
    for step in range(1, FEW):
        i = np.nonzero(few[:-step] & (group[:-step] == group[step:]))[0]
        needed = (least[i] + least[i + step]) * link[0] / sum(link)
        i = i[(most[i] * link[1] >= least[i + step] * link[0]) & (np.minimum(rest[i], rest[i + step]) + 1e-6 >= needed) & (nodes[i] != nodes[i + step])]
        pairs.append(np.sort(np.stack([nodes[i], nodes[i + step]], axis=1), axis=1))
    near = np.unique(np.concatenate(pairs), axis=0)
    many = np.nonzero(~few & ~first)[0]
    ties = np.stack([nodes[first][group[many]], nodes[many]], axis=1)
    ties = np.unique(np.sort(ties, axis=1), axis=0)
    kept = few | first
    upto = np.maximum.reduceat(high, np.nonzero(first)[0])[group] if len(high) else high
    return order[kept], low[kept], np.where(few, high, upto)[kept], ~few[kept], near, ties[ties[:, 0] != ties[:, 1]]


def _packed(tokens: np.ndarray, nodes: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray, stands: np.ndarray) -> bytes:
    """Rows of shingles as bytes: thirteen for each, and six more for those that stand for many."""
    five = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    some = np.nonzero(stands)[0]
    head = np.array([len(tokens), len(some)], np.int32).tobytes()
    return b"".join([head, five(tokens), five(nodes), low.astype(np.uint16).tobytes(), places.tobytes(), some.astype(np.int32).tobytes(), high[some].astype(np.uint16).tobytes()])


def _unpacked(raw: bytes) -> tuple[np.ndarray, ...]:
    m, k = np.frombuffer(raw, np.int32, 2)
    ends = np.cumsum([8, 5 * m, 5 * m, 2 * m, m, 4 * k, 2 * k])
    part = [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def wide(x: bytes) -> np.ndarray:
        out = np.zeros((m, 8), np.uint8)
        out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
        return out.view(np.int64).ravel()

    low = np.frombuffer(part[2], np.uint16).astype(np.int32)
    stands, high = np.zeros(m, bool), low + 1
    some = np.frombuffer(part[4], np.int32)
    stands[some], high[some] = True, np.frombuffer(part[5], np.uint16)
    return wide(part[0]), wide(part[1]), low, high, np.frombuffer(part[3], np.uint8), stands


def _shared_prefixes(rows: DataFrame, order, link: tuple[int, int]) -> DataFrame:
    """(a, b, tied): pairs of nodes (40 bits of signatures) with a shingle in both prefixes; where many share one, `tied` pairs that connect them.

    A task combines its own rows first, so a shingle sends few rows from each task, however many
    documents hold it. Rows go by buckets of shingles, packed; a task that meets them holds a bucket at a time.
    """
    buckets = 8 * parallelism(rows.sparkSession)
    names = ["bucket", "packed", "a", "b"]

    def combined(tokens: list, nodes: list, sizes: list, places: list) -> Iterator[pa.RecordBatch]:
        t, s, low, at = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes), np.concatenate(places)
        kept, low, high, stands, _, ties = _meeting(t, s, low, low.astype(np.int32) + 1, at, np.zeros(len(t), bool), link)
        to = ((t[kept].view(np.uint64) >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
        place = np.argsort(to, kind="stable")
        kept, low, high, stands, to = kept[place], low[place], high[place], stands[place], to[place]
        begins = np.nonzero(np.concatenate(([True], to[1:] != to[:-1])))[0]
        packed = [_packed(t[kept[i:j]], s[kept[i:j]], low[i:j], high[i:j], at[kept[i:j]], stands[i:j]) for i, j in zip(begins, [*begins[1:], len(to)])]
        none = pa.nulls(len(packed), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(to[begins]), pa.array(packed, pa.binary()), none, none], names)
        if len(ties):
            yield pa.RecordBatch.from_arrays([pa.array((ties[:, 1] % buckets).astype(np.int32)), pa.nulls(len(ties), pa.binary()), pa.array(ties[:, 0]), pa.array(ties[:, 1])], names)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released_by_worker()
        classes, seen = order.value, set()
        held: list[list[np.ndarray]] = [[], [], [], []]
        size = 0
        for batch in batches:
            for s in sets_of(batch.column(0)):
                if not len(s) or (sig := signature(s)) in seen:  # copies in one task once
                    continue
                if len(seen) < 1 << 20:
                    seen.add(sig)
                own = prefix(s, classes, link).view(np.int64)
                held[0].append(own)
                held[1].append(np.full(len(own), sig & _NODE, np.int64))
                held[2].append(np.full(len(own), size_codes(np.array([len(s)]))[0], np.uint16))
                held[3].append((np.arange(len(own)) * _PLACES // len(s)).clip(0, 255).astype(np.uint8))
                size += len(own)
                if size > _GATHER:
                    yield from combined(*held)
                    held, size = [[], [], [], []], 0
        if size:
            yield from combined(*held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def met() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*map(_unpacked, held))]
            *_, near, ties = _meeting(*columns, link)
            both = np.concatenate([near, ties])
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.arange(len(both)) >= len(near))], ["a", "b", "tied"])

        for batch in batches:
            known = batch.filter(batch.column(2).is_valid())
            if known.num_rows:
                yield pa.RecordBatch.from_arrays([known.column(2), known.column(3), pa.array(np.ones(known.num_rows, bool))], ["a", "b", "tied"])
            for bucket, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if packed is None:
                    continue
                if bucket != now and held:
                    yield met()
                    held = []
                now = bucket
                held.append(packed)
        if held:
            yield met()

    sent = rows.select("text").mapInArrow(tidy(emit), "bucket int, packed binary, a long, b long")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(meet), "a long, b long, tied boolean").distinct()


def _possible(pairs: DataFrame, reps: DataFrame, link: tuple[int, int]) -> DataFrame:
    """Of the pairs that are not tied, those that the bound of their points allows."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, p_a, p_b = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [bound(np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)) >= need(n, m, link) for x, y, n, m in zip(p_a, p_b, n_a, n_b)]
            some = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], ["a", "b"])

    point = lambda x: reps.select(F.col("node").alias(f"node_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"), F.col("point").alias(f"p_{x}"))
    both = pairs.filter(~F.col("tied")).join(point("a"), F.col("a") == F.col("node_a")).join(point("b"), F.col("b") == F.col("node_b"))
    loose = both.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"), "n_a", "n_b", "p_a", "p_b")
    return loose.mapInArrow(tidy(prune), "a long, b long")


def _payload(raw: list[bytes], exact: bool) -> list[np.ndarray]:
    """Sorted sets of 64-bit hashes, or points of a byte a group."""
    return [np.frombuffer(x, np.uint64) if exact else np.frombuffer(x, np.uint8).astype(np.int64) for x in raw]


#: Bytes of a group's sets or points from which on a task gives its memory back after the group.
_LARGE = 1 << 23


def _within(exact: bool, chunked: bool, link: tuple[int, int]):
    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sig", "home"], ascending=[True, False], kind="stable").drop_duplicates("sig")
        sig, sizes, home = pdf["sig"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["home"].to_numpy(bool)
        data = _payload(list(pdf["payload"]), exact)
        rest = pdf["rest"].to_numpy(bool) if chunked else None
        if len(sig) < 2 or (chunked and (rest.all() or not rest.any())):
            found = []
        else:
            points = np.stack([count_vector(s, groups_for(int(sizes.max()))) for s in data]) if exact else folded(data)
            found = spanning_links(points, sizes, data if exact else None, rest, None if home.all() else home, link)
        taken = sum(map(len, pdf["payload"]))
        out = pd.DataFrame({"a": [sig[x] for x, _ in found], "b": [sig[y] for _, y in found]}, dtype="int64")
        if taken > _LARGE:
            del pdf, data
            give_back()
        return out

    return join


def _linked(members: DataFrame, places: DataFrame, exact: bool, link: tuple[int, int], tag: str) -> list[DataFrame]:
    """Tables (a, b) whose links join what all links within the groups of `members` (cluster, band, sig, n, home,
    payload) join: verified on sets where `exact`, else all that the bound of the points allows. `places` has the
    same rows without payloads.

    A group too large for one task is held against the least of its homes; what doesn't link with it is
    the rest. What does is joined already, so there only the rest meets all others, in chunks.
    """
    keys = ["cluster", "band"]
    sizes = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), F.min(F.when(F.col("home"), F.col("sig"))).alias("pivot"))
    large = written(sizes.filter((F.col("members") > MOST_IN_TASK) & F.col("pivot").isNotNull()), f"{tag}-large")
    schema = "a long, b long"
    if large.isEmpty():
        return [written(members.groupBy(*keys).applyInPandas(_within(exact, False, link), schema), tag)]
    members = written(members, f"{tag}-members")
    some = members.join(large.select(*keys), keys, "left_anti")
    out = [written(some.groupBy(*keys).applyInPandas(_within(exact, False, link), schema), tag)]
    big = members.join(large.select(*keys, "pivot"), keys, "left_semi")
    pivots = members.filter("home").join(large.select(*keys, F.col("pivot").alias("sig")), [*keys, "sig"]).select(*keys, F.col("sig").alias("pivot"), F.col("n").alias("pivot_n"), F.col("payload").alias("pivot_payload"))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = _payload(batch.column(5).to_pylist(), exact), _payload(batch.column(8).to_pylist(), exact)
            n, m = batch.column(3).to_numpy(), batch.column(7).to_numpy()
            size = [len(np.intersect1d(x, y, assume_unique=True)) if exact else bound(x, y) for x, y in zip(mine, other)]
            linked = np.array(size) >= need(n, m, link)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], batch.column(6), pa.array(linked)], [*keys, "sig", "n", "home", "payload", "pivot", "linked"])

    joined = big.join(pivots, keys).select(*keys, "sig", "n", "home", "payload", "pivot", "pivot_n", "pivot_payload")
    held = written(joined.mapInArrow(tidy(hold), "cluster long, band int, sig long, n long, home boolean, payload binary, pivot long, linked boolean"), f"{tag}-held")
    out.append(written(held.filter("linked AND sig <> pivot").select(F.col("sig").alias("a"), F.col("pivot").alias("b")), tag))
    rest = held.filter("NOT linked").groupBy(*keys).agg(F.count(F.lit(1)).alias("others"))
    counts = written(large.select(*keys, "members").join(rest, keys).select(*keys, *[F.ceil(F.col(c) / MOST_IN_TASK).cast("int").alias(c) for c in ("members", "others")]), f"{tag}-rest")
    if not counts.isEmpty():
        # chunks of the rest with all chunks of the rest and of the others; within a chunk of the rest, its own pairs
        dealt = held.join(counts, keys).withColumn("rest", ~F.col("linked")).withColumn("at", F.pmod(F.xxhash64("sig"), F.when(F.col("rest"), F.col("others")).otherwise(F.col("members"))).cast("int"))
        chunk = lambda kind, i, j: F.concat_ws(kind, i, j)
        own, every = F.col("at"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        with_rest = F.transform(every("others"), lambda i: F.when(i < own, F.struct(chunk("r", i, own).alias("chunk"), F.lit(False).alias("side"))).otherwise(F.struct(chunk("r", own, i).alias("chunk"), F.lit(True).alias("side"))))
        with_all = F.transform(every("members"), lambda j: F.struct(chunk("m", own, j).alias("chunk"), F.lit(True).alias("side")))
        to_rest = F.transform(every("others"), lambda i: F.struct(chunk("m", i, own).alias("chunk"), F.lit(False).alias("side")))
        dealt = dealt.withColumn("to", F.explode(F.when(F.col("rest"), F.concat(with_rest, with_all)).otherwise(to_rest)))
        dealt = dealt.select(*keys, "sig", "n", "home", "payload", "to.chunk", F.col("to.side").alias("rest"))
        parted = dealt.withColumn("own", F.element_at(F.split("chunk", "r"), 1) == F.element_at(F.split("chunk", "r"), -1))
        inside = parted.filter(F.col("chunk").contains("r") & F.col("own"))
        out.append(written(inside.groupBy(*keys, "chunk").applyInPandas(_within(exact, False, link), schema), tag))
        across = parted.filter(~(F.col("chunk").contains("r") & F.col("own")))
        out.append(written(across.groupBy(*keys, "chunk").applyInPandas(_within(exact, True, link), schema), tag))
    forget(held, counts, large, members)
    return out


def _united(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def _banded(members: DataFrame, link: tuple[int, int]) -> DataFrame:  # (cluster, sig, n, point)
    """Each point at home in the band of its size and, as a visitor, in the next: linked sizes are one band apart at most."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05 * link[1] / link[0]))).cast("int")
    places = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
    return members.withColumn("place", F.explode(places)).select("cluster", "place.band", "sig", "n", "place.home", F.col("point").alias("payload"))


def _wanted_map(ids: DataFrame) -> np.ndarray:
    """A bit map over hashes of `ids` (column id), of at least eight bits an id as far as its size allows."""
    bits = min(MOST_WANTED_BITS, 1 << max(16, (8 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select((at / 64).cast("int").alias("word"), (at % 64).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return out


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, payload) for the rows in `ids`; the map drops most other rows in the task that reads them."""
    found = _wanted_map(ids)
    wanted, size = rows.sparkSession.sparkContext.broadcast(found), 64 * len(found)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            take = np.nonzero(bits[at >> 6] >> (at & 63) & 1)[0]
            for i in range(0, len(take), 256):
                some = batch.take(pa.array(take[i : i + 256]))
                sets = list(sets_of(some.column(1)))
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sigs, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "sig", "payload"])

    keyed = rows.filter("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("at"))
    few = ids.count() <= MOST_BROADCAST  # else a join by shuffle
    return keyed.mapInArrow(tidy(fill), "id long, sig long, payload binary").join(F.broadcast(ids) if few else ids, ["id", "sig"])


def linked_signatures(rows: DataFrame, outlines: DataFrame, order: np.ndarray, link: tuple[int, int] = LINK) -> tuple[DataFrame, DataFrame]:
    """(sets by signature: sig, least id, n, point) and links between signatures that join all that are linked."""
    spark = rows.sparkSession
    reps = written(outlines.filter("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("point").alias("point")).withColumn("node", F.col("sig").bitwiseAND(F.lit(_NODE))), "jaccard-reps")
    pairs = written(_shared_prefixes(rows, spark.sparkContext.broadcast(order), link), "jaccard-pairs")
    settle(spark)
    tied = components(pairs.filter("tied").select("a", "b"), "jaccard-ties").select("node", F.col("component").alias("cluster"))
    tied = written(tied.join(reps, "node").select("sig", "cluster", "n", "point"), "jaccard-tied")
    banded = _banded(tied, link)
    allowed = _linked(banded, banded.drop("payload"), False, link, "jaccard-allowed")
    near = written(_possible(pairs, reps, link), "jaccard-near")
    clusters = components(near.union(_united(allowed)), "jaccard-clusters").withColumnRenamed("node", "sig").join(reps, "sig")
    members = written(clusters.select("id", "sig", F.col("component").alias("cluster"), "n"), "jaccard-members")
    forget(pairs, tied, near, *allowed)
    whole = (F.lit(0).alias("band"), "sig", "n", F.lit(True).alias("home"))
    found = _united(_linked(_sets(rows, members).select("cluster", *whole, "payload"), members.select("cluster", *whole), True, link, "jaccard-links"))
    forget(members)
    return reps, found


def _classes(rows: DataFrame, link: tuple[int, int]) -> DataFrame:
    """(id, mark, n, component_id, sig) of rows (id, mark, text); rows without an id or a shingle have no sig."""
    outlines = written(_outlines(rows), "jaccard-outlines")
    each = outlines.filter("chunk IS NULL").select("id", "mark", "n", "sig", "point")
    reps, found = linked_signatures(rows.filter("id IS NOT NULL"), each.filter("id IS NOT NULL"), _order_table(outlines), link)
    groups = components(found, "jaccard-groups")
    joint = reps.select("sig", "id").join(groups, reps["sig"] == groups["node"], "left").select("sig", "id", F.coalesce("component", "sig").alias("component"))
    least = joint.groupBy("component").agg(F.min("id").alias("component_id"))
    named = written(joint.join(least, "component").select("sig", "component", "component_id"), "jaccard-named")
    out = each.filter("sig IS NOT NULL AND id IS NOT NULL").join(named, "sig").select("id", "mark", "n", "component_id", "component")
    alone = each.filter("sig IS NULL OR id IS NULL").select("id", "mark", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return out.union(alone)


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id.

    Null and blank texts have no shingles and link with nothing; texts of fewer than five words are one
    shingle, the whole sequence. Components are over all links of at least 75 in 100 (both ends included),
    and equal sets are linked whatever their size. Rows with a null id get a null component and link nothing;
    of repeated rows each is returned. Other columns are ignored.
    Sets are told apart by 63 bits of hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("mark"), F.col(text_col).alias("text"))
    return _classes(rows, link).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", link: tuple[int, int] = LINK) -> DataFrame:
    """One row of `docs` for each component, that of the least id, with all its columns.

    Rows without an id, and rows without words, stay, each of them. Where rows with the least id have different texts, one
    text is chosen by a hash; of repeated rows one stays. Columns may have any names; an empty table gives an empty one.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    least = _classes(rows, link).filter("id = component_id OR id IS NULL")
    joined = least.filter("component IS NOT NULL").groupBy("component", "id").agg(F.min("mark").alias("mark"), F.count(F.lit(1)).alias("rows"))
    joined = joined.select("id", "mark", (F.col("rows") > 1).alias("single"))
    alone = least.filter("component IS NULL").select("id", "mark", F.lit(False).alias("single")).distinct()
    return chosen_rows(docs, written(joined.union(alone), "jaccard-kept"), id_col, text_col, F.xxhash64(text))
