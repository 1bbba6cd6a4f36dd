"""Jaccard join over word shingles with a count-vector R-tree.

A document is the set of its shingles (three words, or as many as asked); equal sets are one class throughout. The counts of
a class's shingles in 128 hashed groups are a point. An R-tree over points finds the pairs that may link: the sum of
coordinate minima with a node's upper corner bounds the overlap with all below it, and pairs that the bound lets through
are verified exactly by their texts. Large sets, of which chance fills 128 groups alike, are held against each other by 1024 counts too.

Points are dealt out to trees so that each pair that may link meets in one. Two sets may link only if they differ in
few shingles, so when shingles are hashed into more groups than that number, some group is equal in both: classes
meet where they have an equal group, for every size band they may share with a partner (pigeonhole; nothing is
missed). An empty group, which many share, counts only for a set whose other groups are too few to make an equal one certain.
Groups that hold the same classes make one tree. A group of more than ``BLOCK`` classes is dealt out again by its classes'
rarest shingles: of sets that link, the prefixes in order of frequency share one.

Trees are searched twice. First each gives a forest of surviving pairs, enough to hold its candidates together; verified
pairs make components. Then each tree some pair of whose forest is still apart gives all surviving pairs between different
components, but for those that a tree of a smaller key gives: a class knows its ``FIRST`` smallest keys. So the number of pairs grows with a crowd's size where its classes link, and no link is lost where they don't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stars import star_components
from ..staging import stage
from .keyfilter import with_may
from .textbatch import chunks, give_back, grouped_sum, lower_ascii, mix, owner, span_hash, words

#: Groups of the count vector, classes of a tree's leaf, of a tree, of trees searched many at once, and members verified against one copy of a leader.
GROUPS, LEAF, BLOCK, FEW, SALT = 128, 64, 2048, 12, 128
#: Keys that a class knows of the trees it stands in, and what fills their places where it stands in fewer.
FIRST, NONE = 32, np.iinfo(np.int64).max
#: The largest count a vector tells; it stands for any larger one.
FULL = 65535
#: Sets from so many shingles on have finer vectors too, of 8 bits a count and so many groups for every set of a vector's kind.
FINE, FINE_GROUPS, FINE_FULL = 1024, 1024, 255
#: Bits of a shingle's hash; the ten above them number the texts of a chunk.
BITS, MOST = 54, 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk of ``MOST`` texts at most, end to end, and their bounds.

    A text of fewer than k words has one shingle, the whole sequence; one without words has none.
    """
    s, e, bounds = words(data, offsets)
    h = span_hash(lower_ascii(data), s, e)
    n_words, who = np.diff(bounds), owner(bounds)
    m = max(0, len(h) - k + 1)
    key = np.zeros(m, np.uint64)
    for i in range(k):
        key = mix(key + h[i : i + m] + np.uint64(i))
    full = who[:m] == who[k - 1 :] if m else np.zeros(0, bool)
    texts, values = [who[:m][full]], [key[full]]
    for few in range(1, k):
        short = np.flatnonzero(n_words == few)
        value = np.full(len(short), few + 1000, np.uint64)
        for i in range(few):
            value = mix(value + h[bounds[short] + i] + np.uint64(i))
        texts.append(short)
        values.append(value)
    text, value = np.concatenate(texts), np.concatenate(values)
    both = np.sort((text.astype(np.uint64) << np.uint64(BITS)) | (value >> np.uint64(64 - BITS)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    which = (both >> np.uint64(BITS)).astype(np.int64)
    return both & np.uint64((1 << BITS) - 1), np.searchsorted(which, np.arange(len(offsets)))


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit value for each set (of its members and their number), as signed integers."""
    return mix(grouped_sum(mix(values + np.uint64(17)), bounds) + np.diff(bounds).astype(np.uint64) * np.uint64(0x9E3779B1)).view(np.int64)


def count_vectors(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of a set's members fall into each of the groups."""
    n = len(bounds) - 1
    held = np.bincount(owner(bounds) * GROUPS + (values % np.uint64(GROUPS)).astype(np.int64), minlength=n * GROUPS)
    return np.minimum(held, FULL).reshape(n, GROUPS).astype(np.uint16)


def fine_vectors(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """The same in many more groups for large sets: chance fills 128 groups with like numbers, whatever a large set holds. Null for others."""
    out: list[bytes | None] = [None] * (len(bounds) - 1)
    for i in np.flatnonzero(np.diff(bounds) >= FINE).tolist():
        held = np.bincount((values[bounds[i] : bounds[i + 1]] % np.uint64(FINE_GROUPS)).astype(np.int64), minlength=FINE_GROUPS)
        out[i] = np.minimum(held, FINE_FULL).astype(np.uint8).tobytes()
    return out


class Fine:
    """The fine vectors of some rows (of sets of some sizes), where they have one: what a pair of rows may overlap at most."""

    def __init__(self, vectors: pa.ChunkedArray, size: np.ndarray) -> None:
        self.size = size
        own = vectors.is_valid().to_numpy() if len(vectors) else np.zeros(0, bool)
        self.place = np.where(own, np.cumsum(own) - 1, -1)
        self.held = np.frombuffer(b"".join(vectors.drop_null().to_pylist()), np.uint8).reshape(-1, FINE_GROUPS)

    def lets(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs (rows a and b) may overlap enough; pairs without two fine vectors may."""
        out = np.ones(len(a), bool)
        both = np.flatnonzero((self.place[a] >= 0) & (self.place[b] >= 0))
        for s in range(0, len(both), 2048):
            at = both[s : s + 2048]
            x, y = self.held[self.place[a[at]]], self.held[self.place[b[at]]]
            least = np.minimum(x, y)
            most = least.sum(axis=1, dtype=np.int64)
            out[at] = (most >= enough(self.size[a[at]], self.size[b[at]], percent)) | (least == FINE_FULL).any(axis=1)
        return out


def unpacked(vectors: pa.ChunkedArray) -> np.ndarray:
    """Count vectors; where one has a full count, which bounds nothing, that becomes very large."""
    held = np.frombuffer(b"".join(vectors.to_pylist()), np.uint16).reshape(-1, GROUPS)
    return np.where(held == FULL, 1 << 40, held.astype(np.int64)) if (held == FULL).any() else held


class Bands:
    """Size bands, and how many groups make an equal one certain for linked sets whose smaller one lies in a band."""

    def __init__(self, percent: int) -> None:
        low, self.percent = [1], percent
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, low[-1] * 3 // 2))
        self.low = np.array(low)
        most = self.low[1:] - 1  # largest size in the band, and of its partner
        both = most + most * 100 // percent
        # linked sets of sizes that sum to s differ in at most s (100 - percent) / (100 + percent) shingles
        self.needed = both * (100 - percent) // (100 + percent) + 1
        # below 90 groups hold few shingles and some stay empty: a quarter more leaves enough that are not
        self.groups = self.needed if percent >= 90 else self.needed * 5 // 4

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def signatures(values: np.ndarray, bounds: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of a chunk's sets, and the set each belongs to: one for each group, in each band it may meet a partner."""
    size = np.diff(bounds)
    own = np.flatnonzero(size > 0)
    band = bands.of(size[own])
    down = (band > 0) & (-(-size[own] * bands.percent // 100) < bands.low[band])
    sets, band = np.concatenate([own, own[down]]), np.concatenate([band, band[down] - 1])
    groups, length = bands.groups[band], size[sets]
    base = np.cumsum(groups) - groups
    entry = np.repeat(np.arange(len(sets)), length)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(bounds[:-1][sets], length)
    member = mix(values[at] + np.uint64(29))
    cell = base[entry] + (member % groups[entry].astype(np.uint64)).astype(np.int64)
    total = np.zeros(int(groups.sum()), np.uint64)
    np.add.at(total, cell, mix(member + np.uint64(31)))
    filled = np.bincount(cell, minlength=len(total)) > 0
    row = np.repeat(np.arange(len(sets)), groups)
    group = np.arange(len(row)) - base[row]
    key = mix(total + mix(band[row].astype(np.uint64) * np.uint64(1 << 32) + group.astype(np.uint64) + np.uint64(3)))
    # fewer than ``needed`` groups differ, so a set with that many filled ones shares a filled one
    use = filled | (np.bincount(row[filled], minlength=len(sets)) < bands.needed[band])[row]
    return key.view(np.int64)[use], sets[row[use]]


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, mark, vector, fine = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), [], []
            for first, last, data, offsets in chunks(b.column("text"), most=MOST):
                values, bounds = shingle_sets(data, offsets, k)
                size[first:last], mark[first:last] = np.diff(bounds), fingerprints(values, bounds)
                vector += [x.tobytes() for x in count_vectors(values, bounds)]
                fine += fine_vectors(values, bounds)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row_key"), pa.array(size), pa.array(mark), pa.array(vector, pa.binary()), pa.array(fine, pa.binary())],
                names=["doc_id", "row_key", "n_shingles", "mark", "vector", "fine"],
            )
            give_back()

    return run


def _keys(percent: int, k: int):
    """Bucket keys and marks of texts, once for each mark that a task has met lately."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for b in batches:
            for _first, _last, data, offsets in chunks(b.column(0), most=MOST):
                values, bounds = shingle_sets(data, offsets, k)
                mark = fingerprints(values, bounds)
                new = np.array([not (m in seen or seen.add(m)) for m in mark.tolist()], dtype=bool)
                key, which = signatures(values, bounds, bands)
                use = new[which]
                yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(mark[which[use]])], names=["key", "mark"])
            give_back()
            if len(seen) > 100_000:
                seen.clear()

    return run


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The overlap that sets of sizes a and b need: the least i with 100 i >= percent (a + b - i)."""
    return -(-(a + b) * percent // (100 + percent))


def _linked(percent: int, k: int):
    """Members against their leader, rows sorted so that a leader comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leader = None, None
        for b in batches:
            keys = list(zip(b.column("a").to_pylist(), b.column("salt").to_pylist(), strict=True))
            lead, mark = b.column("lead").to_pylist(), b.column("mark").to_numpy()
            out: list[tuple[int, int]] = []
            for first, _last, data, offsets in chunks(b.column("text"), most=MOST):
                values, bounds = shingle_sets(data, offsets, k)
                found = fingerprints(values, bounds)
                for i in range(len(bounds) - 1):
                    r = first + i
                    if found[i] != mark[r]:
                        continue
                    own = values[bounds[i] : bounds[i + 1]]
                    if lead[r]:
                        block, leader = keys[r], own.copy()
                    elif keys[r] == block:
                        at = np.minimum(np.searchsorted(leader, own), len(leader) - 1)
                        if int((leader[at] == own).sum()) >= enough(len(own), len(leader), percent):
                            out.append((keys[r][0], int(mark[r])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
            give_back()

    return run


def verify(texts: DataFrame, pairs: DataFrame, percent: int, k: int = 3) -> DataFrame:
    """Those of the pairs (a, b) of class marks whose sets link, by their texts (mark, text).

    A class's text travels once for each leader it is held against; a leader is copied for every ``SALT`` members.
    """
    pairs = stage(pairs.select("a", "b").distinct(), "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(
        "a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("mark"), F.lit(False).alias("lead"),
    )
    leaders = salts.select(
        "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("mark"), F.lit(True).alias("lead"),
    )
    asked = members.unionByName(leaders)
    may = with_may(texts, asked.select(F.col("mark").alias("key")), "mark").where("may").drop("may")  # most texts stand in no pair
    held = may.join(asked.hint("shuffle_hash"), "mark")
    dealt = held.select("a", "salt", "lead", "mark", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", F.desc("lead"), "mark")
    return dealt.mapInArrow(_linked(percent, k), "a long, b long")


class Tree:
    """An R-tree of count vectors: leaves of neighbouring points, and their upper corners; searched against itself."""

    def __init__(self, points: np.ndarray, size: np.ndarray, fine: Fine | None = None, first: int = 0) -> None:
        """``fine`` has the points' fine vectors from row ``first`` on."""
        self.fine, self.first = fine, first
        axes = np.argsort(-(points.var(axis=0) / (points.mean(axis=0) + 1)))[:2]
        order = np.lexsort((points[:, axes[1]], points[:, axes[0]] // 4, size // 8))
        starts = np.arange(0, len(points), LEAF)
        self.order, self.points, self.size = order, points[order], size[order]
        self.starts, self.ends = starts, np.append(starts[1:], len(points))
        self.high = np.maximum.reduceat(self.points, starts, axis=0)
        self.small, self.large = np.minimum.reduceat(self.size, starts), np.maximum.reduceat(self.size, starts)

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Points of two leaves (or of one, twice), and which pairs of them the bound lets through; pairs of leaves that it stops are left out."""
        for i in range(len(self.starts)):
            js = np.arange(i, len(self.starts))
            fits = (self.large[js] * 100 >= self.small[i] * percent) & (self.small[js] * percent <= self.large[i] * 100)
            fits &= _overlaps(self.high[i : i + 1], self.high[js])[0] >= enough(self.small[i], self.small[js], percent)
            x = slice(self.starts[i], self.ends[i])
            for j in js[fits].tolist():
                y = slice(self.starts[j], self.ends[j])
                may = bounded(self.points[x], self.size[x], self.points[y], self.size[y], percent)
                if i == j:
                    may = np.triu(may, 1)
                if self.fine is not None and may.any():
                    r, c = np.nonzero(may)
                    may[r, c] = self.fine.lets(self.order[x][r] + self.first, self.order[y][c] + self.first, percent)
                if may.any():
                    yield self.order[x], self.order[y], may


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of coordinate minima of all rows of a and of b."""
    return np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)


def bounded(a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of points (with sizes) may overlap enough, as far as their count vectors tell."""
    m, n = m[:, None], n[None, :]
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (_overlaps(a, b) >= enough(m, n, percent))


def _apart(tree: Tree, root: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """All pairs of different roots that the tree lets through."""
    for x, y, may in tree.pairs(percent):
        i, j = np.nonzero(may & (root[x][:, None] != root[y][None, :]))
        yield from zip(x[i].tolist(), y[j].tolist(), strict=True)


def _forest(tree: Tree, root: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that the tree lets through, as many as hold together what all such pairs would."""
    label = np.unique(root, return_inverse=True)[1]
    for x, y, may in tree.pairs(percent):
        while True:
            open_ = may & (label[x][:, None] != label[y][None, :])
            i = int(open_.any(axis=1).argmax())
            at = np.flatnonzero(open_[i])
            if not len(at):
                break
            parts, first = np.unique(label[y[at]], return_index=True)
            yield from ((int(x[i]), j) for j in y[at[first]].tolist())
            label[np.isin(label, parts)] = label[x[i]]


def _small(first: np.ndarray, n: np.ndarray, root: np.ndarray, size: np.ndarray, vector: np.ndarray, percent: int, forest: bool, fine: Fine | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The same for many blocks of ``FEW`` points at most, one leaf each: rows [first, first + n); all their pairs at once."""
    a, b = [], []
    for k in np.unique(n).tolist():
        i, j = np.triu_indices(k, 1)
        a.append((first[n == k][:, None] + i).ravel())
        b.append((first[n == k][:, None] + j).ravel())
    a, b = np.concatenate(a), np.concatenate(b)
    use = (root[a] != root[b]) & (size[a] * 100 >= size[b] * percent) & (size[b] * 100 >= size[a] * percent)
    a, b = a[use], b[use]
    held = np.zeros(len(a), bool)
    for s in range(0, len(a), 8192):
        x, y = a[s : s + 8192], b[s : s + 8192]
        held[s : s + 8192] = np.minimum(vector[x], vector[y]).sum(axis=1, dtype=np.int64) >= enough(size[x], size[y], percent)
    a, b = a[held], b[held]
    if fine is not None:
        use = fine.lets(a, b, percent)
        a, b = a[use], b[use]
    if not forest:
        return a, b
    label, use = list(range(len(root))), []
    for e, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        while label[x] != x:
            x = label[x]
        while label[y] != y:
            y = label[y]
        if x != y:
            label[max(x, y)] = min(x, y)
            use.append(e)
    return a[use], b[use]


def first_keys(lists: pa.ChunkedArray) -> np.ndarray:
    """A row of the ``FIRST`` smallest keys of each class."""
    held = pa.concat_arrays(lists.chunks)
    n = held.value_lengths().to_numpy()
    out = np.full((len(n), FIRST), NONE)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = held.flatten().to_numpy()
    return out


def given_before(key: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows share a key smaller than theirs, as far as their first keys tell: the smallest key they share gives them."""
    out = np.zeros(len(a), bool)
    for s in range(0, len(a), 4096):
        x, y = first[a[s : s + 4096]], first[b[s : s + 4096]]
        before = x < key[a[s : s + 4096], None]
        out[s : s + 4096] = ((x[:, :, None] == y[:, None, :]).any(axis=2) & before).any(axis=1)
    return out


def _searched(percent: int, forest: bool):
    """Candidate pairs (a, b) of classes of the trees' blocks, with the block's key; rows come sorted by block."""
    search = _forest if forest else _apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            names = ("key", "low", "high", "root", "mark", "n_shingles")
            key, low, high, root, mark, size = (rows.column(k).to_numpy() for k in names)
            vector = unpacked(rows.column("vector"))
            fine = Fine(rows.column("fine"), size) if "fine" in rows.column_names else None
            first = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)) + 1])
            n = np.diff(np.append(first, len(key)))
            few = n <= FEW
            pairs = [_small(first[few], n[few], root, size, vector, percent, forest, fine)] if few.any() else []
            for x, k in zip(first[~few].tolist(), n[~few].tolist(), strict=True):
                y = x + k
                if (root[x:y] != root[x]).any():
                    found = np.array(list(search(Tree(vector[x:y], size[x:y], fine, x), root[x:y], percent)), np.int64).reshape(-1, 2) + x
                    pairs.append((found[:, 0], found[:, 1]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in pairs)]) for i in (0, 1))
            if not forest:
                new = ~given_before(key, first_keys(rows.column("first")), a, b)
                a, b = a[new], b[new]
            return pa.RecordBatch.from_arrays([pa.array(key[a]), pa.array(mark[a]), pa.array(mark[b])], names=["key", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            last = [rows.column(k)[len(rows) - 1].as_py() for k in ("key", "low", "high")]
            same = np.ones(len(rows), bool)
            for k, x in zip(("key", "low", "high"), last, strict=True):
                same &= rows.column(k).to_numpy() == x
            whole = len(rows) - int(same.sum())
            if whole:
                yield flush(rows.slice(0, whole))
            held = rows.slice(whole).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))
        held.clear()
        give_back()

    return run


def _members(k: int):
    """The shingles of each class: rows (mark, text) -> mark, shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mark = b.column("mark").to_numpy()
            for first, last, data, offsets in chunks(b.column("text"), most=MOST):
                values, bounds = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark[first:last][owner(bounds)]), pa.array(values.view(np.int64))], names=["mark", "shingle"],
                )

    return run


def _once(met: DataFrame) -> DataFrame:
    """Rows (key, mark, n) of one key for each set of classes that keys hold; n is the set's size."""
    sets = met.groupBy("key").agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64("mark", F.lit(i))).alias(f"x{i}") for i in (1, 2)))
    one = sets.where("n > 1").groupBy("n", "x1", "x2").agg(F.min("key").alias("key"))
    return met.join(one.select("key", "n"), "key")


def _dealt_again(crowded: DataFrame, texts: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """Keys (key, mark) of crowded classes by their rarest shingles among all of these.

    Sets that link share at least ``percent`` of either one's members, so of its n members the n - ceil(n percent / 100) + 1
    rarest have one in common with the other's rarest.
    """
    marks = crowded.select("mark").distinct()
    held = stage(texts.join(marks, "mark").mapInArrow(_members(k), "mark long, shingle long"), "members")
    often = held.groupBy("shingle").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("mark").orderBy("often", "shingle"))
    ranked = held.join(often, "shingle").withColumn("rank", rank).where("often > 1").join(classes.select("mark", "n_shingles"), "mark")
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    return ranked.where(F.col("rank") <= prefix).select(F.xxhash64("shingle", F.lit("rare")).alias("key"), "mark")


def _blocks(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Trees' rows (key, mark, n, root) with vectors, dealt and sorted; more than ``BLOCK`` classes make a tree for each pair of parts."""
    return (
        met.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("mark"), "parts").cast("int"))
        .withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "mark", "root", F.least("part", "to").alias("low"), F.greatest("part", "to").alias("high"))
        .join(classes, "mark")
        .repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "mark")
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> F.Column:
    """A 64-bit key of a row's id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def jaccard_rows(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """``jaccard_components`` with two columns more: row_key (see there) and root, one value for each component.

    Root is null for texts without words, which belong to no component.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_key(id_col, text_col).alias("row_key"),
    )
    marked = stage(rows.mapInArrow(_classes(k), "doc_id long, row_key long, n_shingles long, mark long, vector binary, fine binary"), "marked")
    classes = stage(
        marked.where("n_shingles > 0").groupBy("mark", "n_shingles", "vector", "fine").agg(F.min("doc_id").alias("first"), F.min("row_key").alias("row_key")),
        "classes",
    )
    # one shuffle holds all keys; it is read twice, and what comes of it are keys of two classes and more alone
    keys = rows.select("text").mapInArrow(_keys(percent, k), "key long, mark long").repartition("key")
    shared = keys.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low <> high").select("key")
    met = stage(keys.join(shared.hint("shuffle_hash"), "key").distinct(), "met")
    met = stage(_once(met), "trees")

    wanted = classes.join(met.select("mark").distinct(), "mark", "left_semi").select("mark", "row_key")
    may = with_may(rows.select("row_key", "text"), wanted.select(F.col("row_key").alias("key")), "row_key").where("may")
    texts = stage(
        may.select("row_key", "text").join(wanted.hint("shuffle_hash"), "row_key").groupBy("mark").agg(F.first("text").alias("text")), "texts",
    )
    crowded = met.where(F.col("n") > BLOCK)
    if crowded.take(1):
        met = stage(met.where(F.col("n") <= BLOCK).unionByName(_once(_dealt_again(crowded, texts, classes, percent, k))), "trees")

    points = classes.select("mark", "n_shingles", "vector", "fine")
    found = stage(_blocks(met.withColumn("root", F.col("mark")), points).mapInArrow(_searched(percent, True), "key long, a long, b long"), "forest")
    links = stage(verify(texts, found, percent, k), "links")
    roots = star_components(links)
    ends = found
    for x in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(
            f"root_{x}", F.coalesce(f"root_{x}", x),
        )
    # a tree all of whose forest's pairs are held together has no other candidates to look at
    apart = ends.where("root_a <> root_b").select("key").distinct()
    placed = met.join(apart, "key").join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    first = placed.groupBy("mark").agg(F.slice(F.array_sort(F.collect_list("key")), 1, FIRST).alias("first"))
    found = _blocks(placed, points.join(first, "mark")).mapInArrow(_searched(percent, False), "key long, a long, b long")
    more = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stage(verify(texts, more, percent, k), "links")
    if more.take(1):
        roots = star_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    its = classes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "first", F.coalesce("root", "mark").alias("root"))
    least = its.groupBy("root").agg(F.min("first").alias("component"))
    named = its.join(least, "root").select("mark", "root", "component")
    return marked.select("doc_id", "row_key", "n_shingles", "mark").join(named, "mark", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "row_key", "root"
    )


def jaccard_components(docs: DataFrame, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id that links reach) for every row.

    Texts link when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles (words in lower case
    for A-Z). Nulls: a null or wordless text has an empty set, n_shingles 0, and links with nothing; a row with a null
    id takes its class's component and links others, but names none. Repeated rows and equal texts share a component. Extra columns are
    not read; an empty table gives no rows. Sets are told apart by 64-bit fingerprints.
    """
    return jaccard_rows(docs, percent, id_col, text_col, k).select("doc_id", "n_shingles", "component_id")
