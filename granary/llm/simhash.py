"""SimHash near-dedup with a binary trie self-join.

1. Every text gets a fingerprint: per bit the majority over the hashes of its word shingles.
2. Distinct fingerprints are joined with themselves.  Each view of them puts other bits in front and sees them as a binary
   trie.  The first levels of the trie are laid out over the cluster: fingerprints that agree in all leading bits of a
   view are a subtree, and a task.  Inside a task the subtree is traversed together with itself in node pairs, differing bits are
   accumulated, and a pair of nodes is pruned as soon as the error budget is exceeded.
3. Views are of two kinds.  Blocks (:func:`block_views`): the 64 bits are cut into one block more than the budget, so a pair
   within the budget agrees in one block at least and none is missed.  Samples (:func:`sample_views`), for wide budgets, where
   blocks would be a few bits short: random bits in front, so many views that a pair misses all of them with a stated probability.
4. A task returns a spanning forest of the links it finds, never all pairs of a group; connected components of
   the forests are those of the links.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components, stars

#: Fixed value: the seed of the shingle hash.
SEED = 42
#: Fingerprints in one side of a task of the trie join, and about as many as share the leading bits of a sampled view.
CHUNK, SUBTREE = 4096, 1024
#: Subtree pairs of this many leaf pairs or fewer are compared directly.
LEAVES = 1 << 16
#: Shingles in one side of a task that compares whole shingle sets.
SHINGLES = 1 << 19


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle, repeats included; fewer words: of the whole sequence; none: empty."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    columns = [words[i : len(words) - width + 1 + i] for i in range(width)]
    return np.fromiter((h(b" ".join(s), SEED) for s in zip(*columns)), np.uint64, len(words) - width + 1)


def _remixed(h: np.ndarray, n: int) -> np.ndarray:
    """The n-th further 64 bits derived from each hash."""
    if n == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * n) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(h: np.ndarray, n_words: int = 1) -> list[int]:
    """Fingerprint words (signed 64-bit): a bit is 1 if set in over half of the hashes; no hashes: zero."""
    total = np.zeros(64 * n_words, np.int64)
    for at in range(0, len(h), 255):
        x = np.stack([_remixed(h[at : at + 255], n) for n in range(n_words)], axis=1).astype(">u8")
        # A byte can count 255 hashes.
        total += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(h)).view(">u8").astype(np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, n_words: int = 1) -> DataFrame:
    """``doc_id, fp: array<bigint>`` of every row; null text counts as empty, whose fingerprint is zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                fps = [majority(shingle_hashes(t, width), n_words) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fp"])

    two = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    return two.mapInArrow(run, "doc_id bigint, fp array<bigint>")


@dataclass(frozen=True)
class View:
    """One look at the fingerprints: the bits in front, by their numbers over all words."""

    bits: tuple[int, ...]

    def lead(self, words: np.ndarray) -> np.ndarray:
        """The bits in front, of each row of ``words`` (uint64), as a number."""
        out = np.zeros(len(words), np.uint64)
        for b in self.bits:
            out = (out << np.uint64(1)) | ((words[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
        return out.view(np.int64)


def block_views(budget: int) -> list[View]:
    """The first word in ``budget + 1`` blocks: of ``budget`` errors at least one block is free."""
    edges = [round(64 * i / (budget + 1)) for i in range(budget + 2)]
    return [View(tuple(range(a, b))) for a, b in zip(edges, edges[1:])]


def sample_views(rows: int, n_words: int, differing: float, miss: float, seed: int = 7) -> list[View]:
    """Random bits in front, so that a pair that differs in the share ``differing`` of its bits misses all views with probability ``miss``.

    The more rows, the more bits, so that about SUBTREE unrelated fingerprints agree by chance; the number of views
    grows with the rows to a power under a half (0.23 where a seventh of the bits differ).
    """
    if rows <= SUBTREE:
        return [View(())]  # one subtree, so no pair is missed
    lead = min(max(4, ceil(log(rows / SUBTREE, 2))), 60, 64 * n_words)
    views = max(1, ceil(log(miss) / log(1 - (1 - differing) ** lead)))
    rng = np.random.default_rng(seed)
    return [View(tuple(sorted(rng.choice(64 * n_words, lead, replace=False).tolist()))) for _ in range(views)]


class _Labels:
    """Component numbers of rows, always up to date, so whole ranges can be compared at once."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: int, b: int) -> bool:
        a, b = self.of[a], self.of[b]
        if a == b:
            return False
        self.of[self.of == max(a, b)] = min(a, b)
        return True


def trie_links(left: np.ndarray, right: np.ndarray | None, budget: int, full: int | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of ``left`` and ``right`` (None: with itself).

    Rows are fingerprints of one or more words of 64 bits.  The first must differ in at most ``budget`` bits, and all words together
    in at most ``full`` (None: no such bound).  The trie is implicit: a node is a range of the sorted first words, its children are split by the next bit.
    Pairs that earlier links have joined are skipped, so a group of near copies costs its links, not its pairs.
    """
    lo = np.argsort(left[:, 0], kind="stable")
    a = left[lo]
    one = right is None
    ro, b = (lo, a) if one else (order := np.argsort(right[:, 0], kind="stable"), right[order])
    ka, kb, shift = np.ascontiguousarray(a[:, 0]), np.ascontiguousarray(b[:, 0]), 0 if one else len(left)
    labels, out = _Labels(len(left) + (0 if one else len(right))), []
    todo = [(0, len(ka), 0, len(kb), 0, 0)]
    while todo:
        i0, i1, j0, j1, depth, errors = todo.pop()
        if i0 == i1 or j0 == j1 or one and i0 > j0:
            continue
        if (i1 - i0) * (j1 - j0) <= LEAVES:
            li, lj = labels.of[lo[i0:i1]], labels.of[ro[j0:j1] + shift]
            if li[0] == lj[0] and (li == li[0]).all() and (lj == lj[0]).all():
                continue
            n = np.bitwise_count(ka[i0:i1, None] ^ kb[None, j0:j1])
            i, j = np.nonzero(n <= budget)
            if full is not None:
                total = n[i, j].astype(np.int64)
                for w in range(1, a.shape[1]):
                    total += np.bitwise_count(a[i0 + i, w] ^ b[j0 + j, w])
                i, j = i[total <= full], j[total <= full]
            if one:
                i, j = i[i + i0 < j + j0], j[i + i0 < j + j0]
            p, q = lo[i + i0], ro[j + j0] + shift
            while len(p):
                open_ = labels.of[p] != labels.of[q]
                p, q = p[open_], q[open_]
                if len(p) and labels.link(p[0], q[0]):
                    out.append((int(p[0]), int(q[0]) - shift))
            continue
        if depth >= 64:
            # Equal first words: the nodes can't be told apart further, so the ranges are halved.
            if i1 - i0 >= j1 - j0:
                im = (i0 + i1) // 2
                if one and (i0, i1) == (j0, j1):
                    todo += [(i0, im, i0, im, depth, errors), (i0, im, im, i1, depth, errors), (im, i1, im, i1, depth, errors)]
                else:
                    todo += [(i0, im, j0, j1, depth, errors), (im, i1, j0, j1, depth, errors)]
            else:
                jm = (j0 + j1) // 2
                todo += [(i0, i1, j0, jm, depth, errors), (i0, i1, jm, j1, depth, errors)]
            continue
        bit = np.uint64(1 << (63 - depth))

        def cut(k: np.ndarray, u: int, v: int) -> int:
            at = int(k[u]) >> (63 - depth) << (63 - depth) | int(bit)
            return u + int(np.searchsorted(k[u:v], np.uint64(at))) if not k[u] & bit else u

        im, jm = cut(ka, i0, i1), cut(kb, j0, j1)
        todo += [(i0, im, j0, jm, depth + 1, errors), (im, i1, jm, j1, depth + 1, errors)]
        if errors + 1 <= budget:
            todo.append((i0, im, jm, j1, depth + 1, errors + 1))
            if not (one and (i0, i1) == (j0, j1)):
                todo.append((im, i1, j0, jm, depth + 1, errors + 1))
    return out


def linked_nodes(fps: DataFrame, views: Sequence[View], budget: int, full: int | None = None) -> DataFrame:
    """Links ``a, b`` between the nodes of ``fps`` (node: bigint, fp: array<bigint>, both distinct), as spanning forests of the tasks.

    The first words must differ in at most ``budget`` bits, all together in at most ``full``.  Subtrees of a view with more than CHUNK rows are cut into
    chunks.  Each chunk is joined with itself first; where that leaves rows outside the largest component of their subtree, these rows, and only
    they, are joined with the subtree's other chunks.  So a group of near copies that fills a subtree costs its rows, not its pairs of chunks.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n:
                words = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, -1).view(np.uint64)
                packed = pa.array([x.tobytes() for x in words], pa.binary())
                for k, view in enumerate(views):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(view.lead(words)), b.column(0), packed], ["v", "lead", "node", "fp"])

    kind = "v int, lead bigint, node bigint, fp binary"
    spread = fps.select("node", "fp").mapInArrow(placed, kind)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows in b.column(0):
                part = rows.values
                node, one = part.field("node").to_numpy(), part.field("one").to_numpy(zero_copy_only=False)
                fp = np.frombuffer(b"".join(part.field("fp").to_pylist()), np.uint64).reshape(len(node), -1)
                p, q = np.flatnonzero(one), np.flatnonzero(~one)
                found = trie_links(fp[p], fp[q] if len(q) else None, budget, full)
                if found:
                    i, j = np.array(found).T
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(node[p][i], (node[q] if len(q) else node)[j])], ["a", "b"])

    def links(rows: DataFrame, *keys: str) -> DataFrame:
        packed = rows.groupBy(*keys).agg(F.collect_list(F.struct("node", "fp", "one")).alias("rows")).filter("size(rows) > 1")
        return packed.select("rows").mapInArrow(joined, "a bigint, b bigint")

    # Most subtrees are one chunk; only larger ones are numbered, by a count that is summed in the map tasks first.
    sizes = spread.groupBy("v", "lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CHUNK)
    large = materialize(sizes.select("v", "lead", F.ceil(F.col("n") / F.lit(CHUNK)).cast("long").alias("chunks")), "large-subtrees")
    n_large = large.count()
    chunk = F.pmod(F.xxhash64("node", "v"), F.col("chunks"))
    if not n_large:
        return materialize(links(spread.withColumn("one", F.lit(True)), "v", "lead"), "links")
    # At most (rows x views / CHUNK) subtrees are large; as each has a row here, the bound of the broadcast is checked.
    side = F.broadcast(large) if n_large <= 1 << 16 else large
    dealt = spread.join(side, ["v", "lead"], "left").withColumn("c", F.coalesce(chunk, F.lit(0))).withColumn("one", F.lit(True))
    first = materialize(links(dealt, "v", "lead", "c"), "links")
    roots = connected_components(first)
    hot = spread.join(side, ["v", "lead"]).join(roots, "node", "left").select("v", "lead", "chunks", "node", "fp", F.coalesce("root", "node").alias("root"))
    hot = materialize(hot, "hot")
    by_root = hot.groupBy("v", "lead", "chunks", "root").agg(F.count(F.lit(1)).alias("n"))
    most = by_root.groupBy("v", "lead", "chunks").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    most = materialize(most.select("v", "lead", F.col("most.root").alias("largest"), (F.col("all") - F.col("most.n")).alias("rest")).filter("rest > 0"), "rest")
    if most.isEmpty():
        return first
    of_rest = F.ceil(F.col("rest") / F.lit(CHUNK)).cast("long")
    both = hot.join(most, ["v", "lead"])
    rest = both.filter("root <> largest").select("v", "lead", F.pmod(F.xxhash64("node"), of_rest).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), "node", "fp", F.lit(True).alias("one"))
    every = both.select("v", "lead", F.explode(F.sequence(F.lit(0).cast("long"), of_rest - 1)).alias("r"), chunk.alias("c"), "node", "fp", F.lit(False).alias("one"))
    second = links(rest.unionByName(every), "v", "lead", "r", "c")
    return materialize(first.union(second), "links")


def linked_roots(distinct: DataFrame, views: Sequence[View], budget: int, full: int | None = None) -> DataFrame:
    """``node, root`` of the nodes of ``distinct`` (node, fp) that are linked to another, root being the smallest node reachable."""
    return connected_components(linked_nodes(distinct, views, budget, full))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, budget: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; fingerprints link at ``budget`` or fewer differing bits.

    ``component_id`` is the smallest id reachable over links.  Equal fingerprints always link; null or empty texts
    have fingerprint zero and link like any other.  Repeated rows are repeated.  A row with a null id gets the
    component of its fingerprint; where all rows of a component have null ids, it is null.  An empty table gives an empty result.
    Extra columns don't matter.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fps")
    # The vertices are fingerprints, not ids: rows that share an id need not share a text.
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")).select("fp", "low", F.col("fp")[0].alias("node")), "distinct")
    roots = linked_roots(distinct, block_views(budget), budget)
    named = distinct.join(roots, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    best = materialize(named.join(lows, "root").select("fp", "component_id"), "best")
    return fps.join(best, "fp").select("doc_id", "fp", "component_id")


def jaccard_links(ids: np.ndarray, sets: Sequence[np.ndarray], probe: np.ndarray, index: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of a ``probe`` set and an ``index`` set (masks) whose Jaccard similarity is at least ``least`` (over 0).

    Sets are sorted and distinct.  No pair is missed: similar sets are of similar size and share one of the smallest
    elements, so many that the others can't make up the overlap (prefix filter).  Of candidates that earlier links have joined one is enough.
    """
    size = np.array([len(x) for x in sets], np.int64)
    prefix = [x[: n - ceil(least * n - 1e-9) + 1] for x, n in zip(sets, size.tolist())]
    at = np.flatnonzero(index)
    if not len(at) or not probe.any():
        return []
    element = np.concatenate([prefix[i] for i in at.tolist()])
    owner = np.repeat(at, [len(prefix[i]) for i in at.tolist()])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    labels, out = _Labels(len(sets)), []
    same = {}
    for i, x in enumerate(ids.tolist()):  # an id that stands on both sides is one vertex
        labels.link(same.setdefault(x, i), i)
    for i in np.flatnonzero(probe).tolist():
        a, b = np.searchsorted(element, prefix[i], "left"), np.searchsorted(element, prefix[i], "right")
        near = np.unique(np.concatenate([owner[u:v] for u, v in zip(a.tolist(), b.tolist())]))
        n = size[i]
        near = near[(size[near] >= least * n - 1e-9) & (n >= least * size[near] - 1e-9)]
        while len(near := near[labels.of[near] != labels.of[i]]):
            j, near = int(near[0]), near[1:]
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if common / (n + size[j] - common) >= least:
                labels.link(i, j)
                out.append((int(ids[i]), int(ids[j])))
    return out


def similar_links(sets: DataFrame, least: float) -> DataFrame:
    """Links ``a, b`` between ids of ``sets`` (g: group, id, n, h: sorted distinct hashes as bytes) of one group with a Jaccard similarity of at least ``least``.

    Every member is compared with the smallest id of its group first.  Where that leaves some unlinked, these, and only they, are compared with all
    members, in chunks of about SHINGLES elements; so a large group of copies of one text costs its rows, and nothing is missed.
    """
    groups = sets.groupBy("g").agg(F.min("id").alias("id"), F.ceil(F.sum("n") / F.lit(SHINGLES)).cast("long").alias("chunks"))
    groups = materialize(groups.select("g", F.col("id").alias("low"), "chunks"), "groups")
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    placed = sets.join(groups, "g").withColumn("c", chunk)
    low = placed.filter("id = low").select("g", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"))
    pairs = placed.filter("id <> low").join(low.select("g", "c", F.col("h").alias("h0")), ["g", "c"]).select("g", "id", "low", "n", "h", "h0")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(4), b.column(5)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if least * max(len(x), len(y)) <= min(len(x), len(y)) else 0
                linked.append(common / (len(x) + len(y) - common) >= least)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(linked)], ["g", "id", "low", "n", "linked"])

    seen = materialize(pairs.mapInArrow(star, "g bigint, id bigint, low bigint, n bigint, linked boolean"), "star")
    first = seen.filter("linked").select(F.col("id").alias("a"), F.col("low").alias("b"))
    rest = materialize(seen.filter("NOT linked").groupBy("g").agg(F.ceil(F.sum("n") / F.lit(SHINGLES)).cast("long").alias("of_rest")), "rest")
    if rest.isEmpty():
        return first
    open_ = seen.filter("NOT linked").select("g", "id")
    both = placed.join(rest, "g")
    every = both.select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of_rest") - 1)).alias("r"), "c", F.struct("id", "h", F.lit(False).alias("probe")).alias("x"))
    probes = both.join(open_, ["g", "id"]).select("g", F.pmod(F.xxhash64("id", F.lit(1)), F.col("of_rest")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), F.struct("id", "h", F.lit(True).alias("probe")).alias("x"))
    packed = every.unionByName(probes).groupBy("g", "r", "c").agg(F.collect_list("x").alias("xs")).select("xs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for xs in b.column(0):
                ids, hs, probe = (xs.values.field(k) for k in range(3))
                probe = probe.to_numpy(zero_copy_only=False)
                found = jaccard_links(ids.to_numpy(), [np.frombuffer(h.as_buffer(), np.uint64) for h in hs], probe, ~probe, least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    return first.union(materialize(packed.mapInArrow(compare, "a bigint, b bigint"), "similar"))


#: Words of the fingerprints of :func:`near_duplicates`, and the chance that a pair at exactly the similarity asked for shares no view.
NEAR_WORDS, NEAR_MISS = 4, 0.001


def near_duplicates(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, keep_key, doc_id`` of every row that has a similar one (of other text or id): groups are the components of the pairs of rows whose sets of
    ``width``-word shingles have a Jaccard similarity of at least ``similarity``; ``keep_key`` is the row of the group with the smallest id.

    A row's key is :func:`row_key` of id and text, so rows that share an id are rows of their own; rows equal in both are one.  Candidates are linked
    fingerprints of 256 bits: a pair at the similarity s differs in arccos(2s / (1 + s)) / pi of them on average, and budgets stand 3.5 standard deviations
    higher.  Every link is confirmed on the whole sets (64-bit hashes); all pairs of a component of candidates are looked at.  Texts without words are similar to
    each other; null counts as empty.  Rows with a null id take no part.  An empty table gives an empty result; extra columns don't matter.
    """
    two = docs.filter(F.col(f"`{id_col}`").isNotNull()).select(row_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t"))
    fps = materialize(fingerprints(two, "key", "t", width, NEAR_WORDS).withColumnRenamed("doc_id", "key"), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("key").alias("node")), "distinct")
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    reach = [int(share * n + 3.5 * (n * share * (1 - share)) ** 0.5) for n in (64, 64 * NEAR_WORDS)]
    # Views are counted for pairs one standard deviation beyond the average.
    views = sample_views(distinct.count(), NEAR_WORDS, share + (share * (1 - share) / (64 * NEAR_WORDS)) ** 0.5, NEAR_MISS)
    roots = linked_roots(distinct, views, *reach)
    named = distinct.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("g"))
    members = fps.join(named, "fp").select("g", "key").distinct()
    many = members.groupBy("g").count().filter("count > 1").select("g")
    members = materialize(members.join(many, "g"), "members")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                sets = [np.unique(shingle_hashes(t, width)) for t in b.column(2).to_pylist()]
                sets = [x if len(x) else np.zeros(1, np.uint64) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["g", "id", "n", "h"])

    texts = two.select("key", "t").join(members, "key").select("g", "key", "t")
    sets = materialize(texts.mapInArrow(hashed, "g bigint, id bigint, n bigint, h binary"), "shingles")
    similar = connected_components(materialize(similar_links(sets, similarity), "similar"))
    ids = two.select("key", "doc_id").join(similar.select(F.col("node").alias("key"), "root"), "key").distinct()
    ids = materialize(ids, "similar-ids")
    keep = ids.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("keep"))
    out = materialize(ids.join(keep, "root").select("key", F.col("keep.key").alias("keep_key"), "doc_id"), "near")
    discard(fps, distinct, members, sets, ids)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text"):
    """A number for the row by its id and whole text."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
