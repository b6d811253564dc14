"""N-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._base import lookup, ship, small_batches, stored, table, text_or_empty, without

WIDER = 0.75  # a size band's lower bound by its upper
SIGNATURES_A_GROUP = 700_000  # signatures that are matched in one task
PART_BYTES = 1 << 20  # text that is hashed at once
HELD = 700_000  # signatures that a task gathers before it sends them on
LIST_BYTES, LIST_MOST = 32 << 20, 4096  # bytes of sets, and sets, of one list of candidates
LEAST_CUT = 16  # sets of a list, however large they are
TASK_BYTES, TASK_MOST = 32 << 20, 4096  # of one component that a task settles whole
LOW = (3, 2, 1)  # signatures of fewer shingles say little and are left out where others must match
BROADCAST_IDS = 500_000
SMALL_BYTES = 64 << 10  # sets of components up to that size are settled many at a time
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (the finaliser of splitmix64)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


# ---------------------------------------------------------------- sets


_RANDOM = np.random.default_rng(20240229)
LETTER = _RANDOM.integers(1, 2**64, 256, dtype=U)  # a number for each byte
LETTER[65:91] = LETTER[97:123]  # A-Z count as a-z
PLACE = _RANDOM.integers(0, 2**64, 1 << 12, dtype=U) | U(1)  # a factor for each place in a word
BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words begin (one more at the end)."""
    b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[b]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(blank & np.concatenate(([False], ~blank[:-1])))
    letters = np.flatnonzero(~blank)
    first = np.cumsum(ends - starts) - (ends - starts)
    place = np.arange(len(letters)) - np.repeat(first, ends - starts)
    if len(place) and place.max() >= len(PLACE):  # a very long word
        factor = np.where(place < len(PLACE), PLACE[place % len(PLACE)], mix(place.astype(U)) | U(1))
    else:
        factor = PLACE[place]
    v = mix(np.add.reduceat(LETTER[b[letters]] * factor, first)) if len(first) else np.empty(0, U)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return v, np.searchsorted(starts, begins)


def long_word_hashes(text: bytes) -> np.ndarray:
    """The hashes of a very long text's words, PART_BYTES of it at a time, cut at white space."""
    out, at = [], 0
    while at < len(text):
        cut = re.compile(rb"[ \t-\r]").search(text, at + PART_BYTES)
        to = cut.start() if cut else len(text)
        out.append(word_hashes([text[at:to]])[0])
        at = to
    return np.concatenate(out)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's set: sorted distinct 64-bit hashes of `width` words in a row; of all its words if there are fewer."""
    if len(texts) == 1 and len(texts[0]) > PART_BYTES:
        v = long_word_hashes(texts[0])
        at = np.array([0, len(v)])
    else:
        v, at = word_hashes(texts)
    times = mix(np.arange(1, width + 1, dtype=U)) | U(1)
    n = max(0, len(v) - width + 1)
    h = v[:n] * times[0]
    for i in range(1, width):
        h = h + v[i : i + n] * times[i]
    h = mix(h)
    out = []
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= width:
            s = np.sort(h[i : j - width + 1])
            fresh = s[1:] != s[:-1]
            out.append(s if fresh.all() else s[np.concatenate(([True], fresh))])
        else:
            out.append(mix((v[i:j] * times[: j - i]).sum(keepdims=True, dtype=U) + U(j - i)) if j > i else np.empty(0, U))
    return out


def digest(s: np.ndarray) -> bytes:
    return blake2b(s.tobytes(), digest_size=16).digest()


def ref(d: bytes) -> int:
    return int.from_bytes(d[:8], "big", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's numbers of shingles in classes by their first bits, about as many classes as shingles, or twice as many.

    Two sets differ in at least as many shingles as their sketches in bits. Half as many classes: every two parities added up.
    """
    log = min(16, max(10, len(s).bit_length()))
    return np.packbits(np.bincount((s >> U(64 - log)).astype(np.int64), minlength=1 << log).astype(np.uint8) & 1).tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """Rows of parities at half as many classes."""
    return bits[:, ::2] ^ bits[:, 1::2]


# ---------------------------------------------------------------- signatures


class PartEnum:
    """Signatures such that two different sets with 100 * intersection >= percent * union share at least one.

    Sizes fall into bands; two such sets are in one band or in neighbouring ones, so a set takes part in its own
    group and in that of the next band. In a group at most k shingles tell two such sets apart. The shingles' domain is
    cut into n1 parts and each into n2 smaller ones; as some part holds at most k2 of the k differences, n2 - k2 of its
    smaller parts hold none, and the hash of what a set has there is the signature, for each choice of n2 - k2.
    With `spare` parts more, spare + 1 parts hold at most k2 differences. So if no more than `spare` parts of a set
    have a signature of fewer than t shingles, the set leaves those signatures out, for the first such t of LOW: in one
    of its other parts a signature of at least t shingles matches. The other set has the same shingles there; if it
    leaves out signatures of fewer than its own t, one of the two t is the larger, and what that set keeps the other
    keeps too. Signatures of no shingles, which all texts could share, so hardly ever remain.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.plans: dict[int, tuple[int, int, int, int, np.ndarray]] = {}
        self.lows = [1]
        while self.lows[-1] < 1 << 40 or len(self.lows) < 66:
            low = self.lows[-1]
            self.lows.append(max(low, math.floor(low / min(WIDER, 0.9 * percent / 100))) + 1)

    def high(self, group: int) -> int:
        return self.lows[group + 1] - 1

    def apart(self, a, b):
        """Most shingles that tell apart two similar sets of these sizes."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def groups(self, size: int) -> list[int]:
        own = int(np.searchsorted(self.lows, size, side="right")) - 1
        return [own, own + 1] if 100 * size >= self.percent * self.lows[own + 1] else [own]

    def plan(self, group: int) -> tuple[int, int, int, int, np.ndarray]:
        """k, n1, n2, spare, and the choices of smaller parts as columns of 0 and 1."""
        if group in self.plans:
            return self.plans[group]
        k = int(self.apart(self.high(group), self.high(group)))
        if k <= 3:
            n1, n2, k2, spare = 1, k + 3, k, 0
        else:
            n2, k2 = 3, 1
            spare = -(-(k // 2 + 1) // 6)
            n1 = k // 2 + 1 + spare
        subsets = list(combinations(range(n2), n2 - k2))
        choice = np.zeros((n2, len(subsets)))
        for j, s in enumerate(subsets):
            choice[list(s), j] = 1
        self.plans[group] = k, n1, n2, spare, choice
        return self.plans[group]

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """The signatures of a set; the lowest 6 bits tell the group."""
        out = []
        m = mix(s ^ U(0x5851F42D4C957F2D))
        low, high = (m & U(0xFFFFFFFF)).astype(np.float64), (m >> U(32)).astype(np.float64)
        for group in self.groups(len(s)):
            k, n1, n2, spare, choice = self.plan(group)
            if k == 0:
                continue  # only equal sets are similar
            slot = (((s >> U(20)) % U(n1)) * U(n2) + s % U(n2)).astype(np.int64)
            a, b, n = (np.bincount(slot, w, n1 * n2).reshape(n1, n2) @ choice for w in (low, high, None))  # sums below 2^53 are exact
            place = U(group * 0x632BE59BD9B4E019 % 2**64) + np.arange(a.size, dtype=U).reshape(a.shape) * U(0xD6E8FEB86659FD93)
            sig = mix(mix(a.astype(U) + place) ^ b.astype(U))
            least = n.min(axis=1)
            keep = next((t for t in LOW if (least < t).sum() <= spare), 0) if n1 > 1 else 0
            sig = sig[n >= keep]
            out.append(sig.ravel() & ~U(63) | U(min(group, 63)))
        return np.concatenate(out) if out else np.empty(0, U)


def candidate_lists(sigs: np.ndarray, refs: np.ndarray, most: list[int]) -> list[list[np.ndarray]]:
    """Distinct lists of the refs that share a signature. A list of more than most[group] comes in pieces of half as many, of which every two are to meet."""
    order = np.lexsort((refs, sigs))
    sigs, refs = sigs[order], refs[order]
    fresh = np.concatenate(([True], (sigs[1:] != sigs[:-1]) | (refs[1:] != refs[:-1]))) if len(sigs) else np.empty(0, bool)
    sigs, refs = sigs[fresh], refs[fresh]
    begins = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1]))) if len(sigs) else np.empty(0, np.int64)
    sizes = np.diff(np.append(begins, len(sigs)))
    begins, sizes = begins[sizes > 1], sizes[sizes > 1]
    if not len(begins):
        return []
    sums = np.concatenate(([U(0)], np.cumsum(mix(refs.astype(np.int64).view(U)), dtype=U)))
    marks = sums[begins + sizes] - sums[begins]
    out: dict[bytes, list[np.ndarray]] = {}
    for at in np.unique(np.stack([marks, sizes.astype(U), sigs[begins] & U(63)]), axis=1, return_index=True)[1].tolist():
        own = refs[begins[at] : begins[at] + sizes[at]]
        cap = most[int(sigs[begins[at]] & U(63))]
        out.setdefault(own.tobytes() + cap.to_bytes(4), [own] if len(own) <= cap else np.array_split(own, -(-len(own) // (cap // 2))))
    return list(out.values())


# ---------------------------------------------------------------- links


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(a) + len(b) - n)


class Near:
    """Which sets may be similar by size and sketch. Sketches are compared at the smaller number of classes of the two."""

    def __init__(self, enum: PartEnum, sizes: list[int], blobs: list[bytes]):
        self.enum, self.n = enum, np.array(sizes, np.int64)
        self.classes = np.array([8 * len(x) for x in blobs], np.int64)
        kinds = sorted(set(self.classes.tolist()))
        self.rows = {k: np.zeros((len(blobs), k // 64), U) for k in kinds}
        for k in kinds:
            at = np.flatnonzero(self.classes == k)
            bits = np.unpackbits(np.frombuffer(b"".join(blobs[i] for i in at), np.uint8).reshape(len(at), -1), axis=1)
            while True:
                if bits.shape[1] in self.rows:
                    self.rows[bits.shape[1]][at] = np.packbits(bits, axis=1).view(U)
                if bits.shape[1] <= kinds[0]:
                    break
                bits = fold(bits)

    def before(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the sets before i, those that may be similar to it, and how far each sketch is from its."""
        n, classes = self.n[:i], np.minimum(self.classes[:i], self.classes[i])
        may = 100 * np.minimum(n, self.n[i]) >= self.enum.percent * np.maximum(n, self.n[i])
        far = np.zeros(i, np.int64)
        for k, rows in self.rows.items():
            here = np.flatnonzero(may & (classes == k))
            if len(here):
                far[here] = np.bitwise_count(rows[here] ^ rows[i]).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(may & (far <= self.enum.apart(n, self.n[i]))), far


def joined(up: list[int], x: int) -> int:
    """The root of x, with the way to it halved."""
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def may_link(enum: PartEnum, sizes: list[int], blobs: list[bytes]) -> list[int]:
    """Components by sizes and sketches alone: each holds whole components of the links."""
    up = list(range(len(sizes)))
    near = Near(enum, sizes, blobs)
    for i in range(1, len(sizes)):
        for j in near.before(i)[0].tolist():
            a, b = joined(up, i), joined(up, j)
            up[max(a, b)] = min(a, b)
    return [joined(up, i) for i in range(len(sizes))]


def link(enum: PartEnum, sets: list[np.ndarray], blobs: list[bytes], comps: list[int]) -> list[int]:
    """Components of the sets by all links among them, from components known before (numbers up to len(sets)).

    Two sets are compared unless they are already in one component or cannot be similar by size and sketch, so no
    link between components is missed and the links within one are not all made.
    """
    up = list(range(len(sets)))
    first: dict[int, int] = {}
    for i, c in enumerate(comps):
        up[joined(up, i)] = joined(up, first.setdefault(c, i))
    near = Near(enum, [len(s) for s in sets], blobs)
    for i in range(1, len(sets)):
        may, far = near.before(i)
        for j in may[np.argsort(far[may], kind="stable")].tolist():
            a, b = joined(up, i), joined(up, j)
            if a != b and similar(sets[i], sets[j], enum.percent):
                up[max(a, b)] = min(a, b)
    return [joined(up, i) for i in range(len(sets))]


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, comp): the smallest node of each component, by large and small stars in turn; nothing comes to the driver but counts."""
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "join-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        last = now


# ---------------------------------------------------------------- operator


def ngram_components(docs: DataFrame, *, width: int = 4, percent: int = 85) -> DataFrame:
    """Components of documents whose sets of word n-grams are similar: doc_id, text_hash, n_shingles, set_digest, component, component_id.

    docs: doc_id, text; other columns are ignored. Two documents link when 100 * |intersection| >= percent * |union|.
    Documents of one set are one node from the start. Sets that share a PartEnum signature make a list of candidates,
    of bounded length; a longer one is cut into pieces, and every two pieces are a row of two numbers that is dealt out
    before it meets their sets. All pairs of a list are held against each
    other by sizes and sketches, which rule out nearly all that are not similar; what is left falls into provisional
    components, each of which holds whole components of the links. Only their sets are read again. A provisional
    component of bounded bytes is settled by one task; in a larger one each set is first compared in the longest of its
    lists, and then, in lists that still hold several components, with those it may be similar to. Every similar pair
    shares a list and no two sets of different components stay uncompared, so components are exact (up to equal 64-bit
    hashes of different shingles). No pairs are written.

    Null and empty texts have an empty set, no links and themselves as component. The smallest doc_id names a
    component; null counts as larger than all. Rows that repeat a text are one node. An empty table gives an empty
    result.
    """
    enum = PartEnum(percent)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def parts(b: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        """Runs of rows of up to PART_BYTES of text, or of one row."""
        column = b.column("text").cast(pa.binary())
        ends = np.cumsum(np.array(pa.compute.binary_length(column), np.int64))
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, min(at + 256, int(np.searchsorted(ends, before + PART_BYTES, side="right"))))
            yield at, column.slice(at, to - at).to_pylist()
            at = to

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in parts(b):
                sets = shingle_sets(texts, width)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(texts)), b.column("text_hash").slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], names=["doc_id", "text_hash", "n", "digest", "sketch"])

    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    sized = stored(hashed.mapInArrow(measure, "doc_id long, text_hash long, n long, digest binary, sketch binary"), "join-sizes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")
    nodes = sized.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), first, F.count(F.lit(1)).alias("rows"))
    to_ref = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")  # as ref(): the first 8 bytes, signed
    nodes = stored(nodes.select("digest", to_ref.alias("ref"), "n", "sketch", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("text_hash"), "rows"), "join-nodes")
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_groups = max(4, -(-total // (2 * SIGNATURES_A_GROUP)))  # a set has about a signature for two shingles

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs: list[np.ndarray] = []
        refs: list[np.ndarray] = []
        seen: set[bytes] = set()
        held = 0

        def flush() -> pa.RecordBatch:
            s, r = (np.concatenate(x) if x else np.empty(0, U) for x in (sigs, refs))
            group = ((s >> U(6)) % U(n_groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            group, s, r = group[order], s[order], r[order]
            begins = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
            ends = np.append(begins[1:], len(group)) if len(begins) else begins
            cut = [(s[i:j].tobytes(), r[i:j].tobytes()) for i, j in zip(begins, ends, strict=True)]
            sigs.clear()
            refs.clear()
            return pa.RecordBatch.from_arrays([pa.array(group[begins], pa.int64()), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], names=["part", "sigs", "refs"])

        for b in batches:
            for _, texts in parts(b):
                for s in shingle_sets(texts, width):
                    d = digest(s)
                    if d in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(d)
                    found = enum.signatures(s) if len(s) else s
                    sigs.append(found)
                    refs.append(np.full(len(found), ref(d), np.int64).view(U))
                    held += len(found)
                if held > HELD:
                    yield flush()
                    held = 0
        yield flush()

    most = [int(min(LIST_MOST, max(LEAST_CUT, LIST_BYTES // (8 * enum.high(g))))) for g in range(64)]

    def match(group: pa.Table) -> pa.Table:
        sigs, refs = (np.concatenate([np.frombuffer(x.as_buffer(), U) for x in group.column(c)]) for c in ("sigs", "refs"))
        lists = candidate_lists(sigs, refs.view(np.int64), most)
        flat = [x for pieces in lists for x in pieces]
        ends = np.cumsum([0, *map(len, flat)]).astype(np.int32)
        cuts = [(len(pieces), i, ref(blake2b(b"".join(x.tobytes() for x in pieces), digest_size=8).digest()) if len(pieces) > 1 else 0) for pieces in lists for i in range(len(pieces))]
        values = pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64), pa.int64())
        return pa.table({"refs": pa.ListArray.from_arrays(pa.array(ends), values), **{c: pa.array([x[i] for x in cuts], pa.int64()) for i, c in enumerate(("pieces", "piece", "whole"))}})

    lists = rows.select("text").mapInArrow(sign, "part long, sigs binary, refs binary").groupBy("part").applyInArrow(match, "refs array<long>, pieces long, piece long, whole long").distinct()
    lists = stored(lists.withColumn("list", F.monotonically_increasing_id()), "join-lists")
    members = lists.where("pieces = 1").select("list", F.size("refs").alias("size"), F.explode("refs").alias("ref"))
    cut = lists.where("pieces > 1")
    if not cut.isEmpty():
        # every two pieces of a long list: rows of numbers, dealt out before they meet their members
        pairs = cut.where(F.col("piece") < F.col("pieces") - 1).select("whole", "piece", F.explode(F.sequence(F.col("piece") + 1, F.col("pieces") - 1)).alias("other"))
        pairs = pairs.withColumn("list", F.xxhash64("whole", "piece", "other"))
        sides = pairs.select("list", "whole", "piece").unionByName(pairs.select("list", "whole", F.col("other").alias("piece"))).repartition("list")
        met = sides.join(cut.select("whole", "piece", "refs").hint("shuffle_hash"), ["whole", "piece"])
        members = members.unionByName(met.select("list", (2 * F.size("refs")).alias("size"), F.explode("refs").alias("ref")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for at, some in parts(b):
                out = []
                want, comp = (b.column(c).slice(at, len(some)).to_pylist() for c in ("a_digest", "a_comp"))
                for s, d, c in zip(shingle_sets(some, width), want, comp, strict=True):
                    if d not in seen and digest(s) == d:
                        seen.add(d)
                        out.append((d, c, len(s), sketch(s), s.tobytes()))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["digest", "comp", "n", "sketch", "items"])

    def settle(rows: list[dict], comps: list[bytes] | None = None) -> list[tuple[bytes, bytes]]:
        """(digest, its component's root) of rows with digest, sketch and items."""
        got = {r["digest"]: r for r in rows}
        names = sorted(got)
        number = {c: i for i, c in enumerate(sorted({got[d]["comp"] for d in names}))} if comps is not None else {}
        was = [number[got[d]["comp"]] for d in names] if comps is not None else list(range(len(names)))
        now = link(enum, [np.frombuffer(got[d]["items"], U) for d in names], [got[d]["sketch"] for d in names], was)
        return [(d, names[c]) for d, c in zip(names, now, strict=True)]

    def table_of(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
        return pa.table({"digest": pa.array([x for x, _ in pairs], pa.binary()), "comp": pa.array([x for _, x in pairs], pa.binary())})

    def settle_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                yield table_of(settle(b.column(0)[at].as_py())).to_batches()[0]

    def settle_one(group: pa.Table) -> pa.Table:
        return table_of(settle(group.to_pylist()))

    def across(group: pa.Table) -> pa.Table:
        """The sets of a list that size and sketch allow to be similar to one of another component."""
        got = sorted({(r["digest"], r["sketch"], r["n"], r["comp"]) for r in group.to_pylist()})
        own = np.unique([x[3].hex() for x in got], return_inverse=True)[1]
        near, hit = Near(enum, [x[2] for x in got], [x[1] for x in got]), np.zeros(len(got), bool)
        for i in range(1, len(got)):
            may = near.before(i)[0]
            may = may[own[may] != own[i]]
            hit[may] = True
            hit[i] |= len(may) > 0
        keep = np.flatnonzero(hit).tolist()
        return pa.table({"list": pa.array([group.column("list")[0].as_py()] * len(keep), pa.int64()), "digest": pa.array([got[i][0] for i in keep], pa.binary()), "comp": pa.array([got[i][3] for i in keep], pa.binary())})

    def join_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        comp = {r["digest"]: r["comp"] for r in rows}
        pairs = {(comp[d], comp[c]) for d, c in settle(rows, list(comp.values())) if comp[d] != comp[c]}
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})

    def exact(star: DataFrame, placed: DataFrame) -> DataFrame:
        """(digest, comp) of provisional components -> (digest, comp) of the links."""
        asked = nodes.join(star, "digest").select(F.col("least").alias("a_least"), F.col("text_hash").alias("a_hash"), F.col("digest").alias("a_digest"), F.col("comp").alias("a_comp"))
        asked = stored(asked, "join-asked")
        few = asked.count() <= BROADCAST_IDS
        texts = hashed.join(F.broadcast(asked) if few else asked, F.col("doc_id").eqNullSafe(F.col("a_least")) & (F.col("text_hash") == F.col("a_hash"))).select("text", "a_digest", "a_comp")
        sets = stored(texts.mapInArrow(fetch, "digest binary, comp binary, n long, sketch binary, items binary"), "join-sets")
        sizes = sets.groupBy("comp").agg(F.sum(F.col("n") * 9 + 300).alias("bytes"), F.count(F.lit(1)).alias("sets"))
        sizes = stored(sizes.withColumn("kind", F.when(F.col("bytes") <= SMALL_BYTES, 0).when((F.col("bytes") <= LIST_BYTES) & (F.col("sets") <= LIST_MOST), 1).otherwise(2)), "join-kinds")
        kinds = {r[0] for r in sizes.select("kind").distinct().collect()}
        pair = "digest binary, comp binary"
        cols = ("digest", "sketch", "items")
        out = []
        few = sizes.count() <= BROADCAST_IDS
        kind = lambda i: sets.join(F.broadcast(sizes.where(F.col("kind") == i)) if few else sizes.where(F.col("kind") == i), "comp", "left_semi")
        if 0 in kinds:
            out.append(kind(0).groupBy("comp").agg(F.collect_list(F.struct(*cols)).alias("rows")).select("rows").mapInArrow(settle_many, pair))
        if 1 in kinds:
            out.append(kind(1).groupBy("comp").applyInArrow(settle_one, pair))
        if 2 in kinds:
            out.append(large(stored(kind(2), "join-large"), placed))
        comps = out[0]
        for x in out[1:]:
            comps = comps.unionByName(x)
        return stored(comps, "join-comps")

    def large(sets: DataFrame, placed: DataFrame) -> DataFrame:
        """The same for components too large for one task, list by list."""
        placed = placed.join(sets.select("digest"), "digest", "left_semi")
        home = placed.groupBy("digest").agg(F.max(F.struct("size", "list")).alias("at")).select("digest", F.col("at.list").alias("list"))
        comps = stored(sets.join(home, "digest").select("list", "digest", "sketch", "items").groupBy("list").applyInArrow(settle_one, "digest binary, comp binary"), "join-homes")
        here = placed.select("list", "digest").join(comps, "digest")
        several = here.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("list")
        left = here.join(several, "list", "left_semi").join(sets.select("digest", "sketch", "n"), "digest")
        left = stored(left.select("list", "digest", "sketch", "n", "comp").groupBy("list").applyInArrow(across, "list long, digest binary, comp binary"), "join-left")
        edges = left.join(sets.select("digest", "sketch", "items"), "digest").groupBy("list").applyInArrow(join_up, "a binary, b binary").distinct()
        edges = stored(edges, "join-edges")
        if edges.isEmpty():
            return comps
        final = components(edges).select(F.col("node").alias("comp"), F.col("comp").alias("final"))
        return comps.join(final, "comp", "left").select("digest", F.coalesce("final", "comp").alias("comp"))

    placed = members.join(nodes.select("ref", "digest", "n", "sketch"), "ref")

    def provisional(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = set()
            for got in b.column(0).to_pylist():
                names = [x["digest"] for x in got]
                roots = may_link(enum, [x["n"] for x in got], [x["sketch"] for x in got])
                pairs.update((names[i], names[r]) for i, r in enumerate(roots) if i != r)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

    whole = placed.groupBy("list").agg(F.collect_list(F.struct("digest", "n", "sketch")).alias("members")).select("members")
    maybe = stored(whole.mapInArrow(provisional, "a binary, b binary").distinct(), "join-maybe")
    if maybe.isEmpty():
        comps = nodes.select("digest", F.col("digest").alias("comp")).limit(0)
    else:
        star = components(maybe)
        star = star.unionByName(star.select(F.col("comp").alias("node"), "comp").distinct())
        comps = exact(star.select(F.col("node").alias("digest"), "comp"), placed.select("list", "size", "digest"))
    inside = stored(nodes.select("digest", "least").join(comps, "digest"), "join-inside")
    named = inside.groupBy("comp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    named = lookup(inside.select("digest", "comp"), stored(named, "join-named"), "comp", "sets").select("digest", F.col("comp").alias("component"), "component_id")
    keyed = nodes.select("digest", "least", "rows").join(named, "digest", "left")
    keyed = stored(keyed.select("digest", F.coalesce("component", "digest").alias("component"), F.coalesce("component_id", "least").alias("component_id"), "rows"), "join-keyed")
    out = lookup(sized.drop("sketch").where("n > 0"), keyed, "digest", "rows").withColumnRenamed("digest", "set_digest")
    empty = sized.drop("sketch").where("n = 0").withColumns({"set_digest": F.lit(None).cast("binary"), "component": F.lit(None).cast("binary"), "component_id": F.col("doc_id")})
    cols = ("doc_id", "text_hash", F.col("n").alias("n_shingles"), "set_digest", "component", "component_id")
    return out.select(*cols).unionByName(empty.select(*cols))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with all their columns, but of each component only the row with the smallest doc_id (null last, ties by a hash of the text). Empty sets stay."""
    found = stored(ngram_components(docs.select("doc_id", "text"), width=width, percent=percent).where(F.col("component").isNotNull()).select("doc_id", "text_hash", "component"), "join-found")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("first")
    groups = stored(found.groupBy("component").agg(first, F.count(F.lit(1)).alias("docs")).where("docs > 1"), "join-groups")
    gone = lookup(found, groups, "component", "docs").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    return without(docs, gone.select("doc_id", "text_hash"), {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64(text_or_empty())})


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c ON c.doc_id = s.doc_id
"""


ship(__name__)
