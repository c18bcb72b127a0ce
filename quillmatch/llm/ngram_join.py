"""Exact n-gram Jaccard join by prefix trees, and the classes of near-duplicate documents it links.

A document's set are the hashes of its distinct runs of ``SHINGLE`` words, or of all of its words if it has fewer, after
A-Z are lower-cased. Documents link when the sets' Jaccard similarity is at least ``PERCENT`` hundredths.

Sets are put in one global order: rare shingles first, by classes of frequency (``frequency``) and then by hash. Two sets
that link share a shingle among the first ``size - ceil(t * size) + 1`` of each, their prefixes. So the trie of all ordered
sets falls into sub-tries, one for each shingle that prefixes share: it holds the rests, from this shingle on, of the sets
that have it. A shingle of class 0 is in one set only and is left out.

The join is the traversal of these tries (``trie``): a probe shares partial overlaps along common paths and leaves a
subtree by its remaining lengths. It has two steps, so that a class of very many near copies is not walked once for each
pair. First every set is tried with one other, that which is the least of the most prefix shingles it has; what links is
joined into components. Then sub-tries are walked which hold sets of different components, pairs within a component being
of no more interest; only verified links come out, candidate pairs are no rows, and of a group's links only as many as join
its components (``_forest``). Before a set goes into a sub-trie, its other prefix shingles tell whether all of its partners
there meet it in an earlier one already. A sub-trie of very many or very long sets is split into blocks, and each two blocks
are a task's group. Where pairs are few beside the items of a sub-trie's sets, the sets are named in pairs instead: two long
texts may meet in thousands of sub-tries, and so travel once. The partners of one set are a trie again.

Defined results: documents without words have no set, size 0, and are a class each; each row has the class of its own
text, the least id that links reach, also where ids repeat or are null (a null id is never the least; a class of null ids
only has the class null); an empty table gives an empty result; further columns are ignored. Very long texts are one set
like others: memory in a worker is some 60 bytes for each word of the longest. Hashes are of 64 bits within a set, names of
128.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.plans.batches import small_batches
from quillmatch.plans.components import connected_components
from quillmatch.plans.storage import Scratch, written

from .bitmap import bitmap_of
from .frequency import Levels, bucket_bits, runs, segments, unpacked
from .kernel import Slice, U, mix, run_hashes, signed, slices
from .trie import Trie

SHINGLE, PERCENT = 5, 75
#: Sets and shingles of a block of a sub-trie, about.
BLOCK_SETS, BLOCK_ITEMS = 600, 250_000
#: Hashes of a sorted run.
RUN = 1 << 20
#: The sets of a sub-trie are tried in pairs, each once however many sub-tries it shares, if they have so many items a pair.
PAIR_ITEMS = 64
#: Earlier shingles that go along with a set; more would only spare some repeated work.
EARLIER = 256
_MIX_A, _MIX_B = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)


def _sets(s: Slice, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle hashes of all texts of a slice, one text after the other, and where each text's begin and end."""
    counts = np.diff(s.first)
    windows = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    ends = np.cumsum(windows)
    own = np.repeat(np.arange(len(counts)), windows)
    starts = np.arange(len(own)) - (ends - windows)[own] + s.first[:-1][own]
    hashed = run_hashes(s.word_hashes(1, lower=True), starts, starts + np.minimum(counts, shingle)[own], 2)
    for a, b in zip((ends - windows).tolist(), ends.tolist()):
        if b - a > 1:
            hashed[a:b].sort()
    new = np.ones(len(hashed), bool)
    new[1:] = (hashed[1:] != hashed[:-1]) | (own[1:] != own[:-1])
    return hashed[new], np.concatenate([[0], np.cumsum(np.bincount(own[new], minlength=len(counts)))])


def _names(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128-bit names of sets, in two halves."""
    n = np.diff(bounds).astype(U)
    a, b = (np.concatenate([[U(0)], np.cumsum(mix(values ^ k), dtype=U)]) for k in (_MIX_A, _MIX_B))
    return mix((a[bounds[1:]] - a[bounds[:-1]]) ^ n), mix((b[bounds[1:]] - b[bounds[:-1]]) + n)


class _Once:
    """Remembers which sets a task has already met; forgetting some costs only repetition."""

    def __init__(self, limit: int = 60_000):
        self.seen, self.limit = set(), limit

    def new(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which sets with something in them are new."""
        out = np.zeros(len(a), bool)
        for k, name in enumerate(zip(a.tolist(), b.tolist(), n.tolist())):
            if name[2] and name[:2] not in self.seen:
                if len(self.seen) >= self.limit:
                    self.seen.clear()
                self.seen.add(name[:2])
                out[k] = True
        return out


def _of_owners(wanted: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A mask of the items of the wanted sets."""
    return np.repeat(wanted, np.diff(bounds))


def _row_key(text: str):
    """Tells apart the rows of one id, and rows of one text with different ids."""
    return F.xxhash64(F.col(text), F.col("doc_id").cast("long"))


def _census(docs: DataFrame, text: str, shingle: int) -> tuple[DataFrame, Levels]:
    """``doc_id``, ``row_key``, ``n_shingles``, ``a`` and ``b`` (the set's name) of each row; and the shingles' classes.

    One pass over the texts and one exchange: names go along with the sorted runs that are merged behind it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = bucket_bits(parts)
    columns = "doc_id long, row_key long, n_shingles long, a long, b long, bucket long"
    names = [c.split()[0] for c in columns.split(", ")]

    def counted(batches):
        once, held, size = _Once(), [], 0

        def run_rows(hashes):
            buckets, packed = runs(hashes, bits)
            none = pa.nulls(len(buckets), pa.int64())
            return pa.RecordBatch.from_arrays([none] * 5 + [pa.array(buckets, pa.int64()), pa.array(packed, pa.binary())], names=[*names, "run"])

        for batch in batches:
            for s in slices(batch.column(2)):
                values, bounds = _sets(s, shingle)
                a, b = _names(values, bounds)
                n = np.diff(bounds)
                own = slice(s.rows.start, s.rows.stop)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[own], batch.column(1)[own], pa.array(n), pa.array(signed(a)), pa.array(signed(b)), pa.array(signed(a >> U(64 - bits))), pa.nulls(len(n), pa.binary())],
                    names=[*names, "run"],
                )
                held.append(values[_of_owners(once.new(a, b, n), bounds)])
                size += len(held[-1])
                if size >= RUN:
                    yield run_rows(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield run_rows(np.concatenate(held))

    levels = "bucket long, " + ", ".join(f"s{k} binary" for k in range(5))

    def merged(batches):
        """Rows with names pass; of the runs, which come by bucket, one row for each bucket is left."""
        empty, bucket, met = pa.nulls, None, []

        def row():
            made = segments(np.concatenate(met), bits)
            return pa.RecordBatch.from_arrays([empty(1, pa.int64())] * 5 + [pa.array([bucket], pa.int64()), *[pa.array([x], pa.binary()) for x in made]], names=[*names, *[f"s{k}" for k in range(5)]])

        for batch in batches:
            named = batch.filter(batch.column(6).is_null())
            if named.num_rows:
                yield pa.RecordBatch.from_arrays([*named.columns[:5], *[empty(named.num_rows, pa.int64())], *[empty(named.num_rows, pa.binary())] * 5], names=[*names, *[f"s{k}" for k in range(5)]])
            packed = batch.filter(batch.column(6).is_valid())
            for k, run in zip(packed.column(5).to_pylist(), packed.column(6)):
                if k != bucket and met:
                    yield row()
                    met.clear()
                bucket = k
                met.append(unpacked(k, run.as_py(), bits))
        if met:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key(text).alias("row_key"), text).mapInArrow(counted, f"{columns}, run binary")
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket")
    made = written(dealt.mapInArrow(merged, f"{columns}, {levels.partition(', ')[2]}"), "census")
    # Bitmaps of bounded size: one row for each bucket.
    found = made.where("bucket is not null").select(*[c.split()[0] for c in levels.split(", ")]).collect()
    return made.where("bucket is null").drop("bucket", *[f"s{k}" for k in range(5)]), Levels({r[0]: [bytes(x) for x in r[1:]] for r in found}, bits)


def _node(a: np.ndarray, b: np.ndarray, collided: np.ndarray) -> np.ndarray:
    """The number by which a set is known; the second half of its name if the first is another set's too."""
    return np.where(np.isin(a, collided), b, a) if len(collided) else a


def _prefixes(docs: DataFrame, text: str, shingle: int, percent: int, classes, collided: np.ndarray) -> DataFrame:
    """``(h, node, n, place)``: the shingles of each set's prefix that further sets may have; ``place`` is that in the whole set."""

    def run(batches):
        once = _Once()
        for batch in batches:
            for s in slices(batch.column(0)):
                values, bounds = _sets(s, shingle)
                a, b = _names(values, bounds)
                n = np.diff(bounds)
                new = once.new(a, b, n)
                level = np.zeros(len(values), np.int8)
                mine = np.flatnonzero(_of_owners(new, bounds))
                level[mine] = classes.value.of(values[mine])
                known = np.flatnonzero(level > 0)
                own = np.repeat(np.arange(len(n)), n)[known]
                known = known[np.argsort(own * 8 + level[known], kind="stable")]  # values ascend within a set
                count = np.bincount(own, minlength=len(n))
                place = np.arange(len(known)) - (np.cumsum(count) - count)[own] + (n - count)[own]
                length = n - (-(-percent * n // 100)) + 1
                first = place < length[own]
                own, known = own[first], known[first]
                if len(own):
                    node = signed(_node(a, b, collided))
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values[known])), pa.array(node[own]), pa.array(n[own].astype(np.int32)), pa.array(place[first].astype(np.int32))], names=["h", "node", "n", "place"])

    return docs.select(text).mapInArrow(run, "h long, node long, n int, place int")


def _ordered_sets(docs: DataFrame, text: str, shingle: int, classes, collided: np.ndarray, wanted) -> DataFrame:
    """``(node, n, items)`` of the rows whose keys the bitmap ``wanted`` has: the ordered set without class 0, as bytes."""

    def run(batches):
        once = _Once(5_000)
        for batch in batches:
            chosen = wanted.value.has(batch.column(1).to_numpy(zero_copy_only=False).view(U))
            if not chosen.any():
                continue
            for s in slices(batch.column(0).filter(pa.array(chosen))):
                values, bounds = _sets(s, shingle)
                a, b = _names(values, bounds)
                n = np.diff(bounds)
                new = once.new(a, b, n)
                level, raw, out = classes.value.of(values), values.astype(">u8"), []
                for k in np.flatnonzero(new).tolist():
                    mine = level[bounds[k] : bounds[k + 1]]
                    order = np.argsort(mine, kind="stable")
                    out.append(raw[bounds[k] : bounds[k + 1]][order[np.searchsorted(mine[order], 1) :]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(signed(_node(a, b, collided))[new]), pa.array(n[new].astype(np.int32)), pa.array(out, pa.binary())], names=["node", "n", "items"])

    return docs.select(text, _row_key(text).alias("_key")).mapInArrow(run, "node long, n int, items binary")


def _groups(batches, keys: int):
    """Batches that are cut where one of the first ``keys`` columns changes, each group whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        at = [0, *change.tolist()]
        for a, b in zip(at, at[1:]):
            yield batch.slice(a, b - a)
        held = [batch.slice(at[-1])]
    if held:
        yield held[0]


def _item_arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), ">u8").astype(U) if len(x.as_buffer()) else np.zeros(0, U) for x in column]


def _tried(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(p, q)`` that link. The partners of one probe are a trie, dealt to several tasks if they are very many."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.groupBy("p").agg(F.expr(f"cast(count(*) div {BLOCK_SETS} + 1 as int)").alias("_deals"))
    dealt = pairs.join(counts, "p").select("p", "q", F.pmod(F.xxhash64("q"), "_deals").cast("int").alias("deal"))
    probes = dealt.select("p", "deal").distinct().join(sets, F.col("p") == F.col("node")).select("p", "deal", F.lit(None).cast("long").alias("q"), "n", "items")
    others = dealt.join(sets, F.col("q") == F.col("node")).select("p", "deal", "q", "n", "items")
    together = probes.union(others).repartition(parts, "p", "deal").sortWithinPartitions("p", "deal", F.col("q").isNotNull(), "items")

    def run(batches):
        for group in _groups(batches, 2):
            sizes, items, q = group.column(3).to_numpy(), _item_arrays(group.column(4)), group.column(2)
            first = q.null_count  # the probe; more than once if its row comes twice
            if not first or first == len(items):
                continue
            trie = Trie(items[first:], sizes[first:])
            found = q.slice(first).to_numpy()[trie.linked(trie.places(items[0]), int(sizes[0]), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), group.column(0)[0].as_py())), pa.array(found)], names=["p", "q"])

    return together.mapInArrow(run, "p long, q long")


def _fits(n, m, place, at, percent: int):
    """Whether sets of two sizes may link that meet at these places."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * (np.minimum(place, at) + np.minimum(n - place, m - at)) >= percent * (n + m))


def _apart(n, place, c, block, earlier: pa.Array, percent: int) -> np.ndarray:
    """Which two sets of a group are of different components and may link, unless they meet in an earlier shingle already."""
    apart = (c[:, None] != c[None, :]) & _fits(n[:, None], n[None, :], place[:, None], place[None, :], percent)
    if block.min() != block.max():
        apart &= block[:, None] != block[None, :]
    rows = np.flatnonzero(apart.any(axis=1))
    if not len(rows):
        return apart
    lists = earlier.take(pa.array(rows))
    keys = lists.flatten().to_numpy(zero_copy_only=False)
    own = np.repeat(rows, lists.value_lengths().to_numpy())
    order = np.argsort(keys, kind="stable")
    keys, own = keys[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(keys))
    for a, b in zip(first[ends - first > 1].tolist(), ends[ends - first > 1].tolist()):
        mine = own[a:b]
        apart[np.ix_(mine, mine)] = False
    return apart


def _open(prefixes: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``(h, deal, block, node, rest, c, partner)``: which sets go into the sub-tries that are to be walked, with the length of
    their rests; of a sub-trie of few sets, each set with the ``partner`` to be tried with, which it may share with others."""
    parts = int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    labelled = prefixes.join(labels, "node", "left").select("h", "node", "n", "place", F.coalesce("component", "node").alias("c"))
    blocks = f"cast(greatest(count(*) div {BLOCK_SETS}, sum(cast(n as long)) div {BLOCK_ITEMS}) + 1 as int)"
    mixed = labelled.groupBy("h").agg(F.min("c").alias("_low"), F.max("c").alias("_high"), F.expr(blocks).alias("blocks")).where("_low < _high").select("h", "blocks")
    # A set's own open shingles in the global order: no more than its prefix has.
    lists = labelled.join(mixed, "h").groupBy("node").agg(F.min("n").alias("n"), F.min("c").alias("c"), F.array_sort(F.collect_set(F.struct("place", "h", "blocks"))).alias("_open"))
    each = lists.select("node", "n", "c", F.posexplode("_open").alias("_k", "_at"), F.expr(f"transform(slice(_open, 1, {EARLIER}), x -> x.h)").alias("_all"))
    each = each.select("node", "n", "c", "_at.*", F.expr(f"slice(_all, 1, least(_k, {EARLIER}))").alias("earlier"))
    each = each.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Each two blocks meet once: in the group that both numbers name.
    dealt = each.withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("h", F.expr("least(block, _other) * blocks + greatest(block, _other)").alias("deal"), "block", "node", "n", "place", "c", "earlier")

    def run(batches):
        for group in _groups(batches, 2):
            if group.num_rows < 2:
                continue
            n, place, c, block = (group.column(k).to_numpy() for k in (4, 5, 6, 2))
            apart = _apart(n.astype(np.int64), place.astype(np.int64), c, block, group.column(7), percent)
            if np.count_nonzero(apart) * PAIR_ITEMS <= 2 * int((n - place).sum(dtype=np.int64)):
                mine, other = np.nonzero(np.triu(apart))
                partner = pa.array(group.column(3).to_numpy()[other])
            else:
                mine = np.flatnonzero(apart.any(axis=1))
                partner = pa.nulls(len(mine), pa.int64())
            if len(mine):
                kept = group.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([*kept.columns[:4], pa.array((n - place)[mine], pa.int32()), kept.column(6), partner], names=["h", "deal", "block", "node", "rest", "c", "partner"])

    ordered = dealt.repartition(parts, "h", "deal").sortWithinPartitions("h", "deal")
    return ordered.mapInArrow(run, "h long, deal int, block int, node long, rest int, c long, partner long")


def _forest(trie: Trie, n: np.ndarray, c: np.ndarray, block: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a trie's sets that join their components ``c`` as all its links do, one for each two that are joined.

    Of two sets in different components one at least is not in the largest, and is a probe; so a class of very many near
    copies needs only the probes that make it one. With ``block``, links are between blocks only.
    """
    c = np.unique(c, return_inverse=True)[1]
    left, p, q = np.ones(len(c), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        probes = np.flatnonzero(left & (c != np.bincount(c).argmax()))
        if not len(probes):
            return np.concatenate(p), np.concatenate(q)
        k = probes[0]
        left[k] = False
        found = trie.linked(trie.sequence(k), int(n[k]), percent)
        found = found[c[found] != c[k]]
        if block is not None:
            found = found[block[found] != block[k]]
        if len(found):
            joined, first = np.unique(c[found], return_index=True)
            p.append(np.full(len(first), k)), q.append(found[first])
            c[np.isin(c, joined)] = c[k]


def _walked(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(p, q)`` between sets of different components: of each group fewer than it has components, which join the same."""
    parts = int(open_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rests = open_.join(sets, "node").select("h", "deal", "block", "node", "c", "n", F.expr("substring(items, -8 * rest)").alias("items"))
    ordered = rests.repartition(parts, "h", "deal").sortWithinPartitions("h", "deal", "items", "node")

    def run(batches):
        for group in _groups(batches, 2):
            if group.num_rows < 2:
                continue
            block, node, c, n = (group.column(k).to_numpy() for k in (2, 3, 4, 5))
            across = block.min() != block.max()
            p, q = _forest(Trie(_item_arrays(group.column(6)), n), n, c, block if across else None, percent)
            yield pa.RecordBatch.from_arrays([pa.array(node[p]), pa.array(node[q])], names=["p", "q"])

    return ordered.mapInArrow(run, "p long, q long")


def link_sets(docs: DataFrame, text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """``(rows, components)``: every row with its ``node``, and ``(node, component)`` of the sets that link with others.

    A row's node is null if it has no shingles. Links are complete: two sets are in one component exactly if a chain of
    links joins them.
    """
    with small_batches(docs.sparkSession):
        return _link_sets(docs.select("doc_id", text), text, percent, shingle)


def _link_sets(docs: DataFrame, text: str, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    rows, levels = _census(docs, text, shingle)
    classes = spark.sparkContext.broadcast(levels)
    twice = rows.where("n_shingles > 0").groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low < high")
    found = [r[0] for r in twice.select("a").limit(100_001).collect()]
    if len(found) > 100_000:
        raise RuntimeError("more sets with colliding names than 128 bits can explain")
    collided = np.array(found, np.int64).view(U)
    node = F.when(F.col("a").isin(found), F.col("b")).otherwise(F.col("a")) if found else F.col("a")
    rows = rows.withColumn("node", F.when(F.col("n_shingles") > 0, node))
    # One row stands for all that have its set.
    stands = rows.where("node is not null").groupBy("node").agg(F.min("row_key").alias("row_key"))

    with Scratch(spark) as tmp:

        def sets_of(nodes: DataFrame) -> DataFrame:
            keys = tmp.written(stands.join(nodes.distinct(), "node").select("row_key"), "wanted")
            wanted = spark.sparkContext.broadcast(bitmap_of(keys, "row_key", keys.count()))
            made = tmp.written(_ordered_sets(docs, text, shingle, classes, collided, wanted), "sets")
            wanted.destroy()
            return made

        prefixes = tmp.written(_prefixes(docs, text, shingle, percent, classes, collided), "prefixes")
        heads = prefixes.groupBy("h").agg(F.min(F.struct("node", "n", "place")).alias("_head"), F.max("node").alias("_high")).where("_head.node < _high")
        heads = heads.select("h", F.col("_head.node").alias("p"), F.col("_head.n").alias("m"), F.col("_head.place").alias("at"))
        fits = F.expr(f"100 * least(n, m) >= {percent} * greatest(n, m) and {100 + percent} * (least(place, at) + least(n - place, m - at)) >= {percent} * (n + m)")
        shared = prefixes.join(heads, "h").where(fits & (F.col("node") > F.col("p"))).groupBy("node", "p").count()
        tries = shared.groupBy("node").agg(F.max(F.struct("count", "p")).alias("_best")).select(F.col("_best.p").alias("p"), F.col("node").alias("q"))
        tries = tmp.written(tries, "tries")
        links = tmp.written(_tried(tries, sets_of(tries.select(F.explode(F.array("p", "q")).alias("node"))), percent), "links")
        labels = connected_components(links, "p", "q")

        open_ = tmp.written(_open(prefixes, labels, percent), "open")
        if not open_.isEmpty():
            sets = sets_of(open_.select("node").union(open_.where("partner is not null").select("partner")))
            few = open_.where("partner is not null").select(F.least("node", "partner").alias("p"), F.greatest("node", "partner").alias("q")).distinct()
            few = tmp.written(few.join(tries.select("p", "q"), ["p", "q"], "left_anti"), "tries")
            more = tmp.written(_tried(few, sets, percent).unionByName(_walked(open_.where("partner is null"), sets, percent)), "links")
            if not more.isEmpty():
                labels = connected_components(links.unionByName(more), "p", "q")
    classes.destroy()
    return rows, labels


def classed(docs: DataFrame, text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``row_key``, ``n_shingles`` and ``component_id``, the least ``doc_id`` that links reach, for every row."""
    rows, components = link_sets(docs, text, percent, shingle)
    least = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    joined = least.join(components, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "first")
    whole = joined.groupBy("c").agg(F.min("first").alias("component_id"))
    by_node = joined.join(whole, "c").select("node", "component_id")
    # A hot node (very many equal documents) makes its partition large on one side only, which can be split.
    out = rows.join(by_node, "node", "left")
    return out.select("doc_id", "row_key", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def classes(docs: DataFrame, text: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for every row."""
    return classed(docs, text, percent, shingle).drop("row_key")


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their class.

    Each row is judged by its own text: of two texts with one id, the one that copies another document goes and the other
    stays. Equal rows stay or go together. Rows without an id or without words stay.
    """
    made = classed(docs.select("doc_id", "text"), percent=percent)
    gone = written(made.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key")).distinct(), "copies")
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["_id"]) & (F.xxhash64(docs["text"], docs["doc_id"].cast("long")) == gone["_key"]), "left_anti")
