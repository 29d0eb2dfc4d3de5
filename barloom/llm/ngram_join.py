"""Exact Jaccard join on sets of word n-grams, by prefix filtering and prefix trees.

1. Every text becomes the set of its n-gram hashes; texts with the same set
   are one class from here on.
2. Sets are ordered globally: n-grams by hash, but those that are frequent
   over the whole corpus last.  Two similar sets share one of the first
   ``n - ceil(t n) + 1`` n-grams of each (the prefix).
3. All sets with a common prefix n-gram belong to the group of the smallest
   document among them; groups of the same document are one.
4. A small sketch of each set bounds its overlap with the others of its group
   from above; only members that may be similar to another go on.
5. Inside a group the sets are stored in a prefix tree, most shared n-grams
   first, and each probe walks it once, sharing the overlaps counted on common
   paths and leaving subtrees whose remaining length cannot reach the
   threshold.
6. Large groups are cut into blocks.  Blocks hand on one document per linked
   set until nothing shrinks; what is then still apart from its group's main
   component is compared with the whole group, tile by tile of fitting lengths.
   So no pair that could connect two components is left out, and no group meets
   in one task.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, key_groups, with_ids, written
from .wordhash import mix, shingles, slices, words_of

#: n-grams ordered last: at most so many, the most frequent ones of the corpus. It bounds what is sent to the tasks; results do not depend on it.
HEAVY = 32_768
#: Sets of one block of a group.
BLOCK = 128
#: Members of a group, or of a tile of it, that are compared by their sketches at a time; buckets of a sketch, and of a large set's.
SKETCHED, NARROW, WIDE, WIDE_FROM = 1024, 128, 1024, 1500
#: n-grams of a tile whose sets are compared with those of another tile; cells of the table of probes that walk a tree together.
TILED, STEP = 400_000, 4_000_000
#: n-grams that a task counts at a time, and the least count it passes on.
COUNTED, COUNT_FROM = 1_000_000, 4


def gram_sets(texts: list[bytes], k: int, positions: dict | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each lower-cased text; a shorter text is one shingle, no word none."""
    w = words_of(texts, lower=True, positions=positions)
    grams = shingles(w.hash, k)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(grams[a : b - k + 1])
        elif b > a:
            yield shingles(w.hash[a:b], b - a) ^ np.uint64(b - a)
        else:
            yield grams[:0]


def least_overlap(a: int, b: int, percent: int) -> int:
    """Smallest intersection of sets of sizes a and b whose Jaccard similarity is at least ``percent`` / 100."""
    return -(-percent * (a + b) // (100 + percent))


class SetTrie:
    """Prefix tree over sets that are sorted by how many sets hold an element, most shared first.

    The sorted sequences and the lengths that neighbours share are the tree: a
    node is a run of sequences with a common beginning.
    """

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sizes = percent, [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, local, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.empty(len(counts), np.int64)
        order[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        shared = int((counts > 1).sum())  # what only one set holds adds to no overlap
        ranks = order[local]
        cuts = np.cumsum([0, *self.sizes])
        self.paths = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            path = np.sort(ranks[a:b])
            self.paths.append(path[: np.searchsorted(path, shared)])
        self.width = shared
        self.order = sorted(range(len(sets)), key=lambda i: self.paths[i].astype(">u4").tobytes())
        self.shared = [0]
        for i, j in zip(self.order, self.order[1:]):
            a, b = self.paths[i], self.paths[j]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(differ[0]) if len(differ) else n)

    def similar(self, x: int) -> list[int]:
        """Sets other than ``x`` that reach the threshold with it."""
        size, path = self.sizes[x], self.paths[x]
        inside = np.zeros(self.width, np.int64)
        inside[path] = 1
        after = len(path) - np.cumsum(inside)  # elements of x beyond each element
        shortest, longest = -(-self.percent * size // 100), size * 100 // self.percent
        need = least_overlap(size, shortest, self.percent)
        depth = max((len(p) for p in self.paths), default=0)
        overlap = np.zeros(depth + 1, np.int64)
        found, pruned = [], None
        for y, shared in zip(self.order, self.shared):
            if pruned is not None:
                if shared >= pruned:
                    continue
                pruned = None
            tail = self.paths[y][shared:]
            if len(tail):
                hits = np.cumsum(inside[tail]) + overlap[shared]
                poor = np.flatnonzero(hits + after[tail] < need)
                if len(poor):
                    n = int(poor[0]) + 1
                    overlap[shared + 1 : shared + n + 1] = hits[:n]
                    pruned = shared + n
                    continue
                overlap[shared + 1 : shared + len(tail) + 1] = hits
            if y != x and shortest <= self.sizes[y] <= longest:
                if overlap[shared + len(tail)] >= least_overlap(size, self.sizes[y], self.percent):
                    found.append(y)
        return found

    def similar_to_each(self, probes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """(x, sets other than x that reach the threshold with it) of all probes: one walk of the tree for as many as ``STEP`` allows."""
        sizes = np.array(self.sizes, np.int64)
        depth = max((len(p) for p in self.paths), default=0)
        many = max(1, min(128, STEP // max(self.width, 1)))
        for begin in range(0, len(probes), many):
            some = probes[begin : begin + many]
            kind = np.int16 if depth < 1 << 14 else np.int32
            inside = np.zeros((self.width, len(some)), kind)
            for i, x in enumerate(some):
                inside[self.paths[x], i] = 1
            held = np.array([len(self.paths[x]) for x in some], kind)
            after = held - np.cumsum(inside, axis=0, dtype=kind)  # elements of each probe beyond each element
            own = sizes[some]
            shortest, longest = -(-self.percent * own // 100), own * 100 // self.percent
            need = -(-self.percent * (own + shortest) // (100 + self.percent))
            overlap = np.zeros((depth + 1, len(some)), kind)
            reached, pruned = [], None
            for y, shared in zip(self.order, self.shared):
                if pruned is not None:
                    if shared >= pruned:
                        continue
                    pruned = None
                tail = self.paths[y][shared:]
                if len(tail):
                    hits = np.cumsum(inside[tail], axis=0, dtype=kind)
                    hits += overlap[shared]
                    overlap[shared + 1 : shared + len(tail) + 1] = hits
                    poor = np.flatnonzero((hits + after[tail] < need).all(axis=1))
                    if len(poor):
                        pruned = shared + int(poor[0]) + 1
                        continue
                n = self.sizes[y]
                hit = (overlap[shared + len(tail)] >= -(-self.percent * (own + n) // (100 + self.percent))) & (shortest <= n) & (n <= longest)
                if hit.any():
                    reached.append((y, np.flatnonzero(hit)))
            ys = np.repeat([y for y, _ in reached], [len(i) for _, i in reached]).astype(np.int64)
            at = np.concatenate([i for _, i in reached]) if reached else np.zeros(0, np.int64)
            for i, x in enumerate(some):
                found = ys[at == i]
                yield x, found[found != x]


def linked(sets: list[np.ndarray], percent: int, probes: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Spanning links of the similarity graph, and the smallest index linked to each set.

    The first set is probed; of the others only those that it did not reach:
    links among the reached ones would connect nothing new.  ``probes`` limits
    what is probed.
    """
    trie = SetTrie(sets, percent)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    first = trie.similar(0) if probes is None and len(sets) else []
    todo = sorted({*range(1, len(sets))}.difference(first)) if probes is None else probes
    for i, reached in itertools.chain([(0, first)], ((i, found.tolist()) for i, found in trie.similar_to_each(todo))):
        for j in reached:
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                edges.append((i, j))
    return edges, [find(i) for i in range(len(sets))]


def sketch(s: np.ndarray) -> bytes:
    """How many elements fall into each of ``NARROW`` hash buckets, ``WIDE`` for large sets (255: that many or more)."""
    count = np.bincount((s & np.uint64(WIDE - 1)).astype(np.int64), minlength=WIDE)
    if len(s) < WIDE_FROM:
        count = count.reshape(-1, NARROW).sum(axis=0)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


def plausible(sizes: list[int], sketches: list[bytes], percent: int, first: int | None = None) -> np.ndarray:
    """Which sets may be similar to another one, by an upper bound of their overlap.

    Two sets share at most the smaller count of every bucket.  Buckets that are
    full, and so of unknown count, bound nothing.  ``first``: only so many sets
    are compared with the others.
    """
    n = np.array(sizes, np.int64)
    wide = [np.frombuffer(x, np.uint8).astype(np.int64) for x in sketches]
    full = np.array([bool((x == 255).any()) for x in wide])
    narrow = np.stack([x.reshape(-1, NARROW).sum(axis=0) for x in wide]).astype(np.int32)
    out = full.copy()
    for i in range(min(len(n) - 1, len(n) if first is None else first)):
        rest = slice(i + 1, len(n))
        need = -(-percent * (n[i] + n[rest]) // (100 + percent))
        fits = 100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])
        if out[i]:
            fits &= ~out[rest]
        j = np.flatnonzero(fits) + i + 1
        if len(j):
            j = j[np.minimum(narrow[i], narrow[j]).sum(axis=1) >= need[j - i - 1]]
        for k in j.tolist():
            if len(wide[i]) == len(wide[k]) == WIDE and not (full[i] or full[k]) and np.minimum(wide[i], wide[k]).sum() < need[k - i - 1]:
                continue
            out[i] = out[k] = True
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """kind 0: document, set size and two sums that identify its set, and its sketch; kind 1: n-gram and a partial document count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        waiting: list[np.ndarray] = []
        held = 0

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(waiting), return_counts=True)
            often = n >= COUNT_FROM
            grams, n = grams[often], n[often].astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(n), np.int32)), _signed(grams), pa.array(n), pa.array(n), pa.array(n), pa.nulls(len(n), pa.binary())],
                names=["kind", "a", "n", "s1", "s2", "sketch"],
            )

        for part, texts in slices(batches, "text"):
            sets = list(gram_sets(texts, k, positions))
            s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
            s2 = np.array([mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64)
            sizes = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(sets), np.int32)), part.column(0), pa.array(sizes), _signed(s1), _signed(s2),
                 pa.array([sketch(s) for s in sets], pa.binary())],
                names=["kind", "a", "n", "s1", "s2", "sketch"],
            )
            waiting += sets
            held += int(sizes.sum())
            if held >= COUNTED:
                yield counted()
                waiting.clear()
                held = 0
        if waiting:
            yield counted()

    return docs.mapInArrow(run, "kind int, a long, n long, s1 long, s2 long, sketch binary")


def _prefixes(docs: DataFrame, k: int, percent: int, heavy: np.ndarray) -> DataFrame:
    """(gram, doc, n, s1): the prefix of each set in the global order; ``heavy`` by growing frequency."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        place = np.argsort(sent.value, kind="stable")
        known = np.append(sent.value[place], np.uint64(0))
        for part, texts in slices(batches, "text"):
            ids, out, rows, sizes, sums = part.column(0).to_pylist(), [], [], [], []
            for i, s in zip(ids, gram_sets(texts, k, positions)):
                n = len(s)
                if not n or i is None:
                    continue
                want = n - -(-percent * n // 100) + 1
                at = np.searchsorted(known[:-1], s)
                frequent = known[at] == s
                frequent &= at < len(place)
                light = s[~frequent]
                if len(light) >= want:
                    first = light[:want]
                else:
                    last = np.sort(place[at[frequent]])[: want - len(light)]
                    first = np.concatenate((light, sent.value[last]))
                out.append(first)
                rows.append(i)
                sizes.append(n)
                sums.append(s.sum(dtype=np.uint64))
            if out:
                times = [len(x) for x in out]
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(out)), pa.array(np.repeat(np.array(rows, np.int64), times)),
                     pa.array(np.repeat(np.array(sizes, np.int64), times)), _signed(np.repeat(np.array(sums, np.uint64), times))],
                    names=["gram", "doc", "n", "s1"],
                )

    return docs.mapInArrow(run, "gram long, doc long, n long, s1 long")


def _length_class(n: Column, percent: int) -> Column:
    """Sets of similar sizes are in the same or in neighbouring classes."""
    return F.floor(F.log(n.cast("double")) / math.log(100 / (percent - 0.1))).cast("int")


def _compare(rows: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Trie joins of all blocks: kind 0 (a, b): a link; kind 1 (a, b): a document handed on, and its group."""
    texts = rows.join(docs, rows["doc"] == docs["doc_id"]).select("block", "leader", "doc", "probe", "text")
    sorted_rows = texts.repartition("block").sortWithinPartitions("block", "doc", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        positions: dict = {}
        a: list[int] = []
        b: list[int] = []
        kinds: list[int] = []
        for _, group in key_groups(batches, "block"):
            # the same document may come as a member and as a probe
            seen: dict[int, int] = {}
            for i, d in enumerate(group["doc"]):
                if d not in seen or group["probe"][i]:
                    seen[d] = i
            keep = sorted(seen.values(), key=lambda i: not group["probe"][i])
            ids = [group["doc"][i] for i in keep]
            sets = list(gram_sets([(group["text"][i] or "").encode() for i in keep], k, positions))
            probing = list(range(sum(group["probe"][i] for i in keep)))
            if probing:
                near = np.flatnonzero(plausible([len(s) for s in sets], [sketch(s) for s in sets], percent, len(probing))).tolist()
                probing = list(range(sum(j < len(probing) for j in near)))
                ids, sets = [ids[j] for j in near], [sets[j] for j in near]
                if not probing:
                    continue
            edges, root = linked(sets, percent, probing if probing else None)
            for i, j in edges:
                kinds.append(0), a.append(ids[i]), b.append(ids[j])
            if not probing:
                for leader in set(group["leader"]):
                    for i in sorted(set(root)):
                        kinds.append(1), a.append(ids[i]), b.append(leader)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])
                a, b, kinds = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

    return sorted_rows.mapInArrow(run, "kind int, a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """``members`` (leader, doc, class) with their block; ``split`` where the group has several.

    A group of at most ``BLOCK`` documents is one block, a larger one is cut by
    length class and then by hash.
    """
    by_class = members.groupBy("leader", "class").agg(F.count(F.lit(1)).alias("_in_class"))
    whole = by_class.groupBy("leader").agg(F.sum("_in_class").alias("_whole"))
    sizes = by_class.join(whole, "leader")
    split = F.col("_whole") > BLOCK
    part = F.when(split, F.pmod(F.xxhash64("doc", "leader"), F.ceil(F.col("_in_class") / BLOCK)))
    key = F.xxhash64("leader", F.coalesce(F.when(split, F.col("class")), F.lit(-1)), F.coalesce(part, F.lit(0)))
    return members.join(sizes, ["leader", "class"]).select("leader", "doc", "class", key.alias("block"), split.alias("split"))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row.

    Texts are linked when their sets of k-word shingles (lower-cased A-Z) have
    a Jaccard similarity of at least ``percent`` / 100; component_id is the
    smallest id reachable.  Null, empty and wordless texts have no shingles and
    are linked with nothing.  Ids are integers; rows with the same id and text
    count as one document, and each is returned; a null id is returned with a
    null component.  Other columns are ignored; an empty table gives no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiles = written(_profiles(docs, k), "gram-profiles")
    # bounded by HEAVY
    often = profiles.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HEAVY).collect()
    heavy = np.array([r["a"] for r in reversed(often)], np.int64).view(np.uint64)
    sets = profiles.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "s1", "s2")
    classes = sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))

    prefixes = written(_prefixes(docs, k, percent, heavy), "gram-prefixes")
    sketches = profiles.where("kind = 0").select(F.col("a").alias("doc"), "n", "sketch")
    edges = grouped_links(prefixes, docs, k, percent, classes.select(F.col("rep").alias("doc")), sketches)
    found = components(edges)
    reps = classes.join(found, F.col("rep") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    own = sets.join(reps, ["n", "s1", "s2"], "left")
    return own.select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id")).alias("component_id")
    )


def grouped_links(prefixes: DataFrame, docs: DataFrame, k: int, percent: int, reps: DataFrame | None = None, sketches: DataFrame | None = None,
                  once: bool = False) -> DataFrame:
    """(a, b): links that connect all similar sets which share a ``gram`` of ``prefixes`` (gram, doc, n, s1).

    ``s1`` is equal for documents with the same set; ``reps`` (doc) are the
    documents that stand for their set, the smallest id of each.  ``docs`` has
    their texts; ``once``: it repeats a document where its text repeats.
    ``sketches`` (doc, n, sketch) let members go that cannot be similar to any
    other of their group, before their texts are sent.  A written table of
    ``prefixes`` is deleted as soon as it has been read.
    """
    # an n-gram that one document holds, or (without ``reps``) only copies, makes no group; the narrower rows are, the less is shuffled
    lone = "leader != hi" if reps is not None else "leader != hi AND lo != hi_set"
    sums = [] if reps is not None else [F.min("s1").alias("lo"), F.max("s1").alias("hi_set")]
    active = prefixes.groupBy("gram").agg(F.min("doc").alias("leader"), F.max("doc").alias("hi"), *sums).where(lone)
    # written by itself: the shuffle of all n-grams is over before the n-grams of the next one come
    active = written(active.select("gram", "leader"), "gram-shared")
    members = prefixes.join(active, "gram").select("leader", "doc", _length_class(F.col("n"), percent).alias("class")).distinct()
    if reps is not None:
        members = members.join(reps, "doc", "left_semi")
    # a group whose members are all in the group of one smaller leader adds no pair
    own = members = written(members, "gram-members")
    drop_written(active)
    drop_written(prefixes)
    lowest = members.groupBy("doc").agg(F.min("leader").alias("lowest"))
    inner = members.join(lowest, "doc").groupBy("leader").agg(F.min("lowest").alias("lo"), F.max("lowest").alias("hi"))
    members = members.join(inner.where("lo != hi OR lo = leader").select("leader"), "leader")
    # a member needs another one of fitting length
    near = members.groupBy("leader", "class").agg(F.count(F.lit(1)).alias("m"))
    near = near.select("leader", "m", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])).alias("class"))
    near = near.groupBy("leader", "class").agg(F.sum("m").alias("m")).where("m > 1")
    members = written(members.join(near.select("leader", "class"), ["leader", "class"]), "gram-members")
    drop_written(own)

    if sketches is not None:
        own = members
        members = written(_plausible_members(members, sketches, percent), "gram-members")
        drop_written(own)
    docs = with_ids(docs, "doc_id", members.select("doc"))
    docs = written(docs.dropDuplicates(["doc_id"]) if once else docs, "gram-texts")

    todo, links, cut = members, [], False
    tables = [members, docs]
    while True:
        blocks = written(_blocks(todo), "gram-blocks")
        tables.append(blocks)
        found = written(_compare(blocks.withColumn("probe", F.lit(False)), docs, k, percent), "gram-links")
        tables.append(found)
        links.append(found.where("kind = 0").select("a", "b"))
        split = blocks.where("split").select("leader", "doc", "class").distinct()
        many = split.count()
        if not many:
            break
        cut = True
        handed = found.where("kind = 1").select(F.col("a").alias("doc"), F.col("b").alias("leader")).distinct()
        todo = written(split.join(handed, ["leader", "doc"], "left_semi"), "gram-handed")
        tables.append(todo)
        if 2 * todo.count() > many:
            break
    if cut:
        links.append(_cross_blocks(members, links, docs, k, percent))
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    edges = written(edges, "gram-edges")
    for table in tables:
        drop_written(table)
    return edges


def _tiles(members: DataFrame, most: Column) -> DataFrame:
    """``members`` (leader, doc, class) with ``tile``: each class of a group cut by hash into tiles of about ``most`` documents."""
    counts = members.groupBy("leader", "class").agg(F.ceil(F.count(F.lit(1)) / most).alias("_tiles"))
    tile = F.pmod(F.xxhash64("doc", "leader"), F.col("_tiles")).cast("int")
    return members.join(counts, ["leader", "class"]).select("leader", "doc", "class", tile.alias("tile"))


def _met(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
    """(leader, class, tile, side, block): the blocks in which tiles of ``left`` (side 0) and ``right`` (side 1) of fitting lengths meet.

    ``once``: both are the same tiles, and each pair meets once (a tile meets itself on side 0 alone).
    """
    a = left.select("leader", F.col("class").alias("class0"), F.col("tile").alias("tile0")).distinct()
    b = right.select(F.col("leader").alias("leader1"), F.col("class").alias("class1"), F.col("tile").alias("tile1")).distinct()
    near = F.col("class1") - F.col("class0")
    fits = (near == 1) | ((near == 0) & (F.col("tile0") <= F.col("tile1"))) if once else F.abs(near) <= 1
    pairs = a.join(b, F.col("leader") == F.col("leader1")).where(fits).withColumn("block", F.xxhash64("leader", "class0", "tile0", "class1", "tile1"))
    ends = [F.struct(F.lit(side).alias("side"), F.col(f"class{side}").alias("class"), F.col(f"tile{side}").alias("tile")) for side in (0, 1)]
    met = pairs.select("leader", "block", F.explode(F.array(*ends)).alias("e")).select("leader", "block", "e.*")
    return met.groupBy("leader", "class", "tile", "block").agg(F.min("side").alias("side")) if once else met


def _plausible_members(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``members`` without those that no other member of their group can be similar to; groups over ``SKETCHED`` are compared in pairs of tiles."""
    sizes = members.groupBy("leader").agg(F.count(F.lit(1)).alias("_m"))
    sized = members.join(sizes, "leader")
    one = sized.where(F.col("_m") <= SKETCHED).select("leader", "doc", "class", F.xxhash64("leader").alias("block"), F.lit(0).alias("side"))
    tiled = written(_tiles(sized.where(F.col("_m") > SKETCHED).select("leader", "doc", "class"), F.lit(SKETCHED)), "gram-tiles")
    more = tiled.join(_met(tiled, tiled, True), ["leader", "class", "tile"]).select("leader", "doc", "class", "block", "side")
    rows = one.union(more).join(sketches.dropDuplicates(["doc"]), "doc").select("block", "side", "leader", "doc", "class", "n", "sketch")
    rows = rows.repartition("block").sortWithinPartitions("block", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in key_groups(batches, "block"):
            first = group["side"].index(1) if group["side"][-1] else None
            keep = np.flatnonzero(plausible(group["n"], group["sketch"], percent, first)).tolist()
            if keep:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[c][i] for i in keep], t) for c, t in (("leader", pa.int64()), ("doc", pa.int64()), ("class", pa.int32()))],
                    names=["leader", "doc", "class"],
                )

    return rows.mapInArrow(run, "leader long, doc long, class int").distinct()


def _cross_blocks(members: DataFrame, links: list[DataFrame], docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between blocks of large groups: the documents outside their group's main component against all, tile by tile."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.union(more)
    whole = written(_blocks(members).where("split").select("leader", "doc", "class"), "gram-blocks")
    own = components(edges)
    at = whole.join(own, whole["doc"] == own["id"], "left").select("leader", "doc", "class", F.coalesce("component", "doc").alias("c"))
    sizes = at.groupBy("leader", "c").agg(F.count(F.lit(1)).alias("m"))
    main = sizes.groupBy("leader").agg(F.max(F.struct("m", "c")).alias("top")).select("leader", F.col("top.c").alias("main"))
    # a tile holds few long sets or many short ones
    most = F.greatest(F.lit(min(16.0, SKETCHED)), F.least(F.lit(float(SKETCHED)), TILED / F.exp(F.first("class") * math.log(100 / (percent - 0.1)))))
    apart = written(_tiles(at.join(main, "leader").where("c != main").select("leader", "doc", "class"), most), "gram-apart")
    whole = written(_tiles(whole.join(apart.select("leader").distinct(), "leader", "left_semi"), most), "gram-whole")
    met = written(_met(apart, whole, False), "gram-met")
    key = ["leader", "class", "tile"]
    rows = [tiled.join(met.where(met["side"] == side), key).select("leader", "doc", "block", F.lit(side == 0).alias("probe")) for side, tiled in ((0, apart), (1, whole))]
    return written(_compare(rows[0].union(rows[1]), docs, k, percent), "gram-cross").where("kind = 0").select("a", "b")


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), spots AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM docs WHERE len(ws) > 0),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(ws, i, i + 3), ' ')) AS g FROM spots),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id
FROM documents JOIN reach ON a = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""
