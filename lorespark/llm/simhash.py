"""SimHash near-dedup by a binary trie self-join.

A text's words (ASCII lower-cased, split at ASCII white space) give shingles of
``WIDTH`` words; a bit of the 64-bit fingerprint is 1 if it is 1 in over half
of the shingles' XXH64 values (seed 42). Equal fingerprints are collapsed
first, so copies never meet in the join.

The join finds all pairs of distinct fingerprints that differ in at most a
budget of bits. With ``budget + m`` bit ranges two such fingerprints agree on
at least ``m`` of them, so each is dealt out once per choice of ``m`` ranges
under their values; ``m`` is the smallest that makes groups of ``GROUP`` rows or
fewer on average, which changes the work but not the pairs. Inside a group the
sorted fingerprints form a binary trie; pairs of its nodes are walked down
together from (root, root), the bits in which the two paths differ are added
up, and a pair of nodes is dropped as soon as the sum exceeds the budget or all
that both hold is already connected. Budgets rise in steps, so closer pairs
link first, and only a spanning forest of the links leaves a task, fewer rows
than the group has, so many near copies do not give all their pairs. Components
of the forest are found in DataFrames (``graph.components``).

``keep_one`` is for corpora, where near-duplicates are texts whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more. Its candidates are
near in one of four fingerprints made of the set (not the sequence) of words and
two-word shingles: a changed word moves fewer of those than of longer ones, and
a repeated line counts once. With a budget of 5 bits on four fingerprints 0.97
of the alike pairs of the test corpus (sf0.1, mean over hash functions) are
candidates; 0.77 were with 6 bits on two of three-word shingles. Links are candidates
whose five-word sets, held against each other exactly, reach the similarity;
groups are their components. A forest of the near pairs is held first and gives
classes of documents that are known to belong together. A second walk
gives each document's nearest by its sketch (``SKETCH`` parities of the set's
values) in another class, and joins classes by them. A third gives every near
pair of documents that are still in different classes, those with one
fingerprint too, unless their sketches prove them unlike; it leaves out what
lies in one class only, so no link is lost. Joins merge, so the driver
builds no tables to broadcast. Documents with the same set and fingerprints are one in all walks.

Defined results: null or blank text has fingerprint 0, which links like any
other; fewer words than ``WIDTH`` form one shingle, the whole sequence; rows
that repeat a doc_id are each returned; a null doc_id never names a component
unless all of its members are null; other columns are ignored. ``keep_one``
tells rows apart by doc_id and text (``common.ROW``): of a group the row with
the smallest doc_id stays (nulls last, then by the text's hash), and of rows
equal in both, one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import ROW, drop_rows, join_rows, lean, materialize, row_key, tidy
from lorespark.llm.graph import components

WIDTH, SEED, BUDGET, BITS = 3, 42, 2, 64
#: keep_one: words per shingle and similarity of near-duplicates; words per shingle, budget and names of the search for candidates.
SHINGLE, SIMILARITY = 5, 0.8
CANDIDATE, WIDE_BUDGET, PRINTS = (1, 2), 5, ("fp", "fp1", "fp2", "fp3")
#: Average rows per group that the choice of ranges aims at, and the steps in which budgets rise.
GROUP, STEP = 64, 2
#: Parities that a set's sketch holds, and document pairs held against each other's sketches at once.
SKETCH, PAIRS = 512, 200_000
#: Rows of groups joined at once, and node pairs walked at once.
BATCH_ROWS, FRONTIER = 100_000, 50_000


def shingles(data: bytes, width: int) -> list[bytes]:
    """Every run of ``width`` words, repeats included."""
    words = data.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def shingle_hashes(data: bytes, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of every shingle of ``width`` words, repeats included, as unsigned numbers."""
    return [xxhash.xxh64_intdigest(x, seed) for x in shingles(data, width)]


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of the rows of bytes."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(data: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    hashes = np.array(shingle_hashes(data, width, seed), "<u8")
    return int(_majority(hashes.view(np.uint8).reshape(-1, 8))[0])


def candidate_prints(data: bytes, widths: tuple[int, ...] = CANDIDATE) -> np.ndarray:
    """Fingerprints of the set of all shingles of these widths, from the halves of their XXH3 128-bit values."""
    members = set().union(*[shingles(data, w) for w in widths])
    halves = [b"".join([xxhash.xxh3_128_digest(x, seed) for x in members]) for seed in range(len(PRINTS) // 2)]
    return np.concatenate([_majority(np.frombuffer(h, np.uint8).reshape(-1, 16)).view(np.int64) for h in halves])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of every row."""

    def printed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                prints = np.array([fingerprint(x or b"", width) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return _texts(docs).mapInArrow(lean(printed), "doc_id long, fp long")


def _split(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """For node ranges [lo, hi) of sorted values that agree above ``bit``: where that bit becomes 1."""
    lo, hi, one = lo.copy(), hi.copy(), np.uint64(1) << np.uint64(bit)
    while (open_ := np.flatnonzero(lo < hi)).size:
        mid = (lo[open_] + hi[open_]) >> 1
        right = (fp[mid] & one) == 0
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]
    return lo


class _Forest:
    """Union-find over positions; the smallest position of a set is its root."""

    def __init__(self, n: int):
        self.parent, self.stale, self.changes = list(range(n)), True, None
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for x, y in zip(left.tolist(), right.tolist()):
            a, b = self.find(x), self.find(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((x, y))
                self.stale = True

    def roots(self) -> np.ndarray:
        root = np.array(self.parent)
        while not np.array_equal(up := root[root], root):
            root = up
        return root

    def connected(self, a0, a1, b0, b1) -> np.ndarray:
        """Pairs of ranges that lie in one set as a whole."""
        if self.stale:
            self.root, self.stale = self.roots(), False
            self.changes = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])
        return (self.root[a0] == self.root[b0]) & (self.changes[a0] == self.changes[a1 - 1]) & (self.changes[b0] == self.changes[b1 - 1])


def trie_forest(fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> _Forest:
    """A spanning forest, over positions, of the links within the groups.

    ``fp``: unsigned, sorted and distinct within each group [start, end).
    """
    forest = _Forest(len(fp))
    for step in range(budget % STEP or STEP, budget + 1, STEP) if budget else (0,):
        _walk(forest, fp, starts, ends, step)
    return forest


def _walk(forest: _Forest, fp: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int) -> None:
    zero = np.zeros(len(starts), np.int8)
    stack = [(BITS - 1, starts, ends, starts, ends, zero)]
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        pairs = single & (a0 != b0)
        if pairs.any():
            x, y = a0[pairs], b0[pairs]
            near = np.bitwise_count(fp[x] ^ fp[y]) <= budget
            forest.link(x[near], y[near])
        go = np.flatnonzero(~single)
        if go.size:
            go = go[~forest.connected(a0[go], a1[go], b0[go], b1[go])]
        if not go.size:
            continue
        a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
        am, bm, same = _split(fp, a0, a1, bit), _split(fp, b0, b1, bit), a0 == b0
        children = [
            (a0, am, b0, bm, diff, True), (am, a1, bm, b1, diff, True),
            (a0, am, bm, b1, diff + 1, True), (am, a1, b0, bm, diff + 1, ~same),
        ]
        parts = []
        for p0, p1, q0, q1, d, ok in children:
            keep = (p0 < p1) & (q0 < q1) & (d <= budget) & ok
            parts.append((p0[keep], p1[keep], q0[keep], q1[keep], d[keep]))
        a0, a1, b0, b1, diff = (np.concatenate(x) for x in zip(*parts))
        for i in range(0, len(a0), FRONTIER):
            cut = slice(i, i + FRONTIER)
            stack.append((bit - 1, a0[cut], a1[cut], b0[cut], b1[cut], diff[cut]))


class _Pairs:
    """In a walk's place of a forest: keeps the pairs of different classes whose sketches allow the similarity.

    Documents come sorted by group, fingerprint and class; leaf i of the trie
    holds those from ``first[i]`` on. ``choice``: the one each leaf is dealt
    by; a pair is kept under the first choice that holds it only.
    """

    def __init__(self, fp, first, choice, masks, classes, sizes, sketches, similarity):
        self.fp, self.first, self.choice, self.masks = fp, first, choice, masks
        self.count = np.diff(np.append(first, len(classes)))
        self.classes, self.sizes, self.sketches = classes, sizes, sketches
        self.share = (1 - similarity) / (1 + similarity)
        mixed = np.add.reduceat(np.concatenate([[0], classes[1:] != classes[:-1]]), first) if len(first) else first
        mixed = mixed - np.concatenate([[0], classes[first[1:]] != classes[first[1:] - 1]]) > 0
        self.label = np.where(mixed, -1 - np.arange(len(first)), np.unique(classes, return_inverse=True)[1][first])
        self.changes = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alone = np.flatnonzero(mixed & (choice == 0))
        self._expand(alone, alone)

    def connected(self, a0, a1, b0, b1) -> np.ndarray:
        return (self.label[a0] == self.label[b0]) & (self.changes[a0] == self.changes[a1 - 1]) & (self.changes[b0] == self.changes[b1 - 1])

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        ok = self.label[left] != self.label[right]
        left, right = left[ok], right[ok]
        diff, choice = self.fp[left] ^ self.fp[right], self.choice[left]
        ok = np.ones(len(left), bool)
        for i, mask in enumerate(self.masks[: int(choice.max(initial=0))]):
            ok &= (choice <= i) | ((diff & np.uint64(mask)) != 0)
        self._expand(left[ok], right[ok])

    def _expand(self, left: np.ndarray, right: np.ndarray) -> None:
        """All documents of the left leaves with all of the right ones."""
        x, of = _ranges(self.first[left], self.count[left])
        right = right[of]
        ends = np.cumsum(self.count[right])
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            y, of = _ranges(self.first[right[at:to]], self.count[right[at:to]])
            self._hold(x[at:to][of], y)
            at = to

    def _hold(self, x: np.ndarray, y: np.ndarray) -> None:
        ok = (x != y) & (self.classes[x] != self.classes[y])
        x, y = x[ok], y[ok]
        most = (self.sizes[x] + self.sizes[y]) * self.share + 1e-6
        ok = np.abs(self.sizes[x] - self.sizes[y]) <= most
        x, y, most = x[ok], y[ok], most[ok]
        apart = np.bitwise_count(self.sketches[x] ^ self.sketches[y]).sum(axis=1, dtype=np.int64)
        ok = apart <= most
        if ok.any():
            self.found.append((x[ok], y[ok], apart[ok]))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and which range each is of."""
    of = np.repeat(np.arange(len(starts)), counts)
    return np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of], of


def _forest_links(budget: int, choices: int):
    def links(keys: np.ndarray, rows: np.ndarray):
        """Rows come grouped by key; gives the forest's links of all groups, and which fingerprints they are of."""
        fp = rows[:, 0].copy().view(np.uint64)
        group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
        many = np.bincount(group)[group] > 1
        group, which, fp = group[many], keys[many, 0] // choices, fp[many]
        order = np.lexsort((fp, group))
        group, which, fp = group[order], which[order], fp[order]
        if not len(fp):
            return None
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        found = np.array(trie_forest(fp, starts, np.append(starts[1:], len(fp)), budget).links, np.int64).reshape(-1, 2)
        pairs = fp.view(np.int64)[found]
        return pa.RecordBatch.from_arrays([pa.array(which[found[:, 0]]), pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], ["which", "u", "v"]) if len(pairs) else None

    return links


def _nearest(ids: np.ndarray) -> np.ndarray:
    """Of the rows (a, b, apart), those that are the first of their a or of their b by apart."""
    ids = ids[np.argsort(ids[:, 2], kind="stable")]
    first = np.zeros(len(ids), bool)
    for end in (0, 1):
        first[np.unique(ids[:, end], return_index=True)[1]] = True
    return ids[first]


def _pair_links(budget: int, similarity: float, masks: list[int], nearest: bool):
    def links(keys: np.ndarray, rows: np.ndarray):
        """Rows (fp, id, class, size, sketch) come grouped by key; gives the ids of all pairs that may be alike, or of each
        document's nearest only, and how many parities of their sketches differ."""
        group = np.cumsum(np.concatenate([[0], (keys[1:] != keys[:-1]).any(axis=1)]))
        many = np.bincount(group)[group] > 1
        group, choice, rows = group[many], keys[many, 0] % len(masks), rows[many]
        order = np.lexsort((rows[:, 2], rows[:, 0].copy().view(np.uint64), group))
        group, choice, rows = group[order], choice[order], rows[order]
        if not len(rows):
            return None
        fp = rows[:, 0].copy().view(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (fp[1:] != fp[:-1])]))
        pairs = _Pairs(fp[first], first, choice[first], masks, rows[:, 2], rows[:, 3], np.ascontiguousarray(rows[:, 4:]).view(np.uint64), similarity)
        starts = np.flatnonzero(np.concatenate([[True], group[first][1:] != group[first][:-1]]))
        _walk(pairs, pairs.fp, starts, np.append(starts[1:], len(first)), budget)
        if not pairs.found:
            return None
        x, y, apart = (np.concatenate(side) for side in zip(*pairs.found))
        ids = np.concatenate([np.sort(np.stack([rows[x, 1], rows[y, 1]], axis=1), axis=1), apart[:, None]], axis=1)
        ids = np.unique(ids[ids[:, 0] != ids[:, 1]], axis=0)
        ids = _nearest(ids) if nearest else ids
        return pa.RecordBatch.from_arrays([pa.array(ids[:, 1]), pa.array(ids[:, 0]), pa.array(ids[:, 2])], ["u", "v", "apart"])

    return links


def _by_group(links):
    def join(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0
        for batch in batches:
            columns = [batch.column(i).to_numpy().astype(np.int64) for i in range(batch.num_columns)]
            held.append((np.stack(columns[:2], axis=1), np.stack(columns[2:], axis=1)))
            count += batch.num_rows
            if count >= BATCH_ROWS:
                keys, rows = (np.concatenate(x) for x in zip(*held))
                change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
                cut = int(change[-1]) + 1 if change.size else 0  # the last group may go on
                if cut and (found := links(keys[:cut], rows[:cut])) is not None:
                    yield found
                held, count = [(keys[cut:], rows[cut:])], len(rows) - cut
        if count and (found := links(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield found

    return join


def _choices(budget: int, rows: int, m: int = 1) -> list[int]:
    """Masks of the bits that are held equal: all choices of m or more out of budget + m ranges."""
    while rows / 2 ** (BITS * m / (budget + m)) > GROUP and m < 4:
        m += 1
    edges = [round(BITS * i / (budget + m)) for i in range(budget + m + 1)]
    ranges = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(ranges, m)]


def _deal(rows: DataFrame, masks: list[int], links, schema: str) -> DataFrame:
    """What ``links`` gives over the rows (which, fp and others), dealt out once per mask; fingerprints meet those of their kind."""
    signed = [mask - (1 << 64) if mask >> 63 else mask for mask in masks]
    first = F.col("which") * len(masks)
    keys = F.array(*[F.struct((first + i).alias("choice"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("value")) for i, mask in enumerate(signed)])
    others = [c for c in rows.columns if c != "which"]
    dealt = rows.select(F.explode(keys).alias("k"), *others).select("k.choice", "k.value", *others)
    return dealt.repartition("choice", "value").sortWithinPartitions("choice", "value").mapInArrow(lean(_by_group(links)), schema).distinct()


def trie_self_join(distinct: DataFrame, budget: int = BUDGET, kinds: int = 1) -> DataFrame:
    """A spanning forest (which, u, v) of the links between the distinct values of ``fp`` of each kind.

    ``distinct``: which (0 to ``kinds`` - 1) and fp, materialised beforehand.
    """
    # wide budgets begin with two held ranges, so that small and large tables are dealt out alike; the rows are narrow
    masks = _choices(budget, distinct.count() // kinds, 1 if budget <= BUDGET else 2)
    return _deal(distinct, masks, _forest_links(budget, len(masks)), "which long, u long, v long")


def trie_pairs(nodes: DataFrame, budget: int, similarity: float, kinds: int = 1, nearest: bool = False) -> DataFrame:
    """The pairs (u, v, apart) of ids in different classes that are near and may be alike; each group's nearest of each
    id only, if ``nearest``.

    ``nodes``: which, fp, id, class, size and the sketch's longs, materialised beforehand.
    """
    masks = _choices(budget, nodes.count() // kinds)
    return _deal(nodes, masks, _pair_links(budget, similarity, masks, nearest), "u long, v long, apart long")


def simhash_components(docs: DataFrame, width: int = WIDTH, budget: int = BUDGET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row; see the module's text."""
    prints = materialize(fingerprints(docs, width))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(materialize(trie_self_join(distinct.select(F.lit(0).alias("which"), "fp"), budget)))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.expr("root | 0L").alias("r"), "component_id")
    named = materialize(rooted.join(smallest, rooted.root == smallest.r).select("fp", "component_id"))
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text or b"", width), np.uint64))


def shingle_sets(texts: DataFrame, width: int = SHINGLE) -> DataFrame:
    """id and the set of its shingles' hashes, of rows (id, text as bytes)."""

    def hashed(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [shingle_set(x, width).view(np.int64) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.mapInArrow(lean(hashed), "id long, shingles array<long>")


_SKETCH = [f"s{i}" for i in range(SKETCH // 64)]


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """The row key, the candidate fingerprints, and of the set of shingles its digest (hi, lo), size and sketch, of every row."""
    longs = [*PRINTS, "hi", "lo", "size", *_SKETCH]

    def sketch(text: bytes) -> np.ndarray:
        members = shingle_set(text, width)
        digest = np.frombuffer(xxhash.xxh3_128_digest(members.tobytes()), "<i8")
        parity = np.packbits(np.bincount((members % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1, bitorder="little").view("<i8")
        return np.concatenate([candidate_prints(text), digest, [len(members)], parity])

    def drawn(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                drawing = np.array([sketch(x or b"") for x in part.column(3).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c) for c in drawing.T.copy())], [*ROW, *longs])

    return docs.select(*row_key(), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(lean(drawn), ", ".join(f"{n} long" for n in [*ROW, *longs]))


def _cut(df: DataFrame) -> DataFrame:
    """``df`` written once; what the driver held of the plans before it goes."""
    out = materialize(df)
    tidy(df.sparkSession)
    return out


def _alike(docs: DataFrame, nodes: DataFrame, links: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(u, v) of the links (a, b) of nodes whose shingle sets reach the similarity: |both| / |either|, 1 for two empty sets."""
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    held = _cut(nodes.join(ids.hint("merge"), "id", "left_semi").select("id", "first.*"))
    texts = join_rows(docs, held, "left_semi").select(*row_key(), F.col("text").cast("string").cast("binary").alias("text")).dropDuplicates(ROW)
    of = held.select("id", *[F.col(c).alias(f"{c}_of") for c in ROW])
    sets = _cut(shingle_sets(texts.join(of.hint("merge"), [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in ROW]).select("id", "text"), shingle))
    left, right = (sets.select(F.col("id").alias(f"{k}_id"), F.col("shingles").alias(f"in_{k}")).hint("merge") for k in ("a", "b"))
    paired = links.join(left, links.a == F.col("a_id")).join(right, links.b == F.col("b_id"))
    both = F.size(F.array_intersect("in_a", "in_b"))
    either = F.size("in_a") + F.size("in_b") - both
    return paired.filter(both >= F.lit(similarity) * either).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, budget: int = WIDE_BUDGET) -> DataFrame:
    """The row key, ``stays`` and keep_id (the doc_id that stays) of every row; one key of each group stays.

    Groups are the components of the links: all pairs within the budget in one
    of the fingerprints whose shingle sets reach the similarity.
    """
    prints = _cut(sketches(docs, shingle))
    same, drawing = [*PRINTS, "hi", "lo"], ["size", *_SKETCH]
    first = F.min(F.struct(F.col(ROW[0]).isNull().alias("none"), *ROW)).alias("first")
    nodes = prints.groupBy(*same).agg(first, *[F.first(c).alias(c) for c in drawing])
    nodes = _cut(nodes.withColumn("id", F.monotonically_increasing_id()))
    each = F.posexplode(F.array(*PRINTS)).alias("which", "fp")
    leaves = _cut(nodes.select("id", each).groupBy("which", "fp").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    forest = _cut(trie_self_join(leaves.select("which", "fp"), budget, len(PRINTS)))
    # one kind's forest is enough to find most classes; the pairs of all kinds follow
    firsts = leaves.filter("which = 0")
    one, two = (firsts.select(F.col("fp").alias(k), F.col("first_id").alias(f"of_{k}")).hint("merge") for k in ("u", "v"))
    across = forest.filter("which = 0").join(one, "u").join(two, "v").select(F.col("of_u").alias("a"), F.col("of_v").alias("b"))
    links = across.unionByName(nodes.join(firsts.hint("merge"), nodes[PRINTS[0]] == firsts.fp).filter("id > first_id").select(F.col("id").alias("a"), F.col("first_id").alias("b")))
    links = _cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    alike = _cut(_alike(docs, nodes, links, shingle, similarity))
    classes = components(alike)
    near = forest.select(F.col("which").alias("kind"), F.explode(F.array("u", "v")).alias("near")).unionByName(leaves.filter("n > 1").select(F.col("which").alias("kind"), F.col("fp").alias("near"))).distinct()
    near = nodes.select("id", *drawing, each).join(near.hint("merge"), (F.col("which") == F.col("kind")) & (F.col("fp") == F.col("near")), "left_semi")
    near = _cut(near.select("which", "fp", "id", *drawing))

    def untested(nearest: bool) -> DataFrame:
        known = classes.select("node", F.col("root").alias("of")).hint("merge")
        held = _cut(near.join(known, near.id == known.node, "left").select("which", "fp", "id", F.coalesce("of", "id").alias("class"), *drawing))
        pairs = trie_pairs(held, budget, similarity, len(PRINTS), nearest).select(F.col("u").alias("a"), F.col("v").alias("b"), "apart")
        return pairs.join(links.hint("merge"), ["a", "b"], "left_anti")

    def joined(tested: DataFrame) -> DataFrame:
        stars = classes.select(F.col("node").alias("u"), F.col("root").alias("v"))
        return components(_cut(stars.unionByName(_alike(docs, nodes, tested, shingle, similarity))))

    # each document's nearest first: the pairs inside what they connect are never made
    best = untested(nearest=True).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
    best = _cut(best.select("a", F.col("best.b").alias("b")))
    classes = joined(best)
    classes = joined(_cut(untested(nearest=False).select("a", "b").join(best.hint("merge"), ["a", "b"], "left_anti")))
    grouped = _cut(nodes.join(classes.hint("merge"), nodes.id == classes.node, "left").select(*same, "first", F.coalesce("root", "id").alias("root")))
    best = grouped.groupBy("root").agg(F.min("first").alias("best")).select(F.expr("root | 0L").alias("r"), "best")
    named = grouped.join(best.hint("merge"), grouped.root == best.r).select(*same, "best")
    judged = prints.select(*ROW, *same).join(named.hint("merge"), same)
    stays = F.lit(True)
    for c in ROW:
        stays = stays & F.col(c).eqNullSafe(F.col(f"best.{c}"))
    return judged.select(*ROW, stays.alias("stays"), F.col(f"best.{ROW[0]}").alias("keep_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    judged = materialize(near_duplicates(docs, **how))
    repeated = materialize(judged.filter("stays").groupBy(*ROW).count().filter("count > 1").select(*ROW))
    return drop_rows(docs, judged.filter("not stays"), repeated)
