"""N-gram Jaccard join by PartEnum signatures, exact for its threshold of 4/5.

Two sets of sizes a <= b with Jaccard similarity 4/5 or more differ in at most k(a) = floor((a + floor(5a/4)) / 9) elements. Sizes
fall into bands; a set whose partners can lie in the next band gives signatures there as well. Within a band the feature
domain (shingle hashes) is cut into first-level partitions of three second-level ones, and of these every subset of two is
enumerated (n2 = 3, k2 = 1): a signature is a set's content in such a subset. A first-level partition in which two sets
differ in one element at most gives them an equal signature, unless the subset is empty. So a partition is strong for a set if no subset is, and
of floor(k / 2) + 1 strong ones at least one gives a signature that a similar set has, too. There are a quarter more
partitions than the band's largest sets need, and a set gives signatures in order of the partitions until enough of them were strong. Of two similar
sets the one that stops first has a partition with a common signature among its own, and the other one goes at least as far.
In bands of short sets each element is a first-level partition of its own (k2 = 0), and the first k + 1 are given.

Signatures that a bounded probe of documents finds common come last in the order of short sets' elements. Longer sets give none of them, and a partition with one doesn't count as strong. A set that has too few strong partitions
is poor: it gives what it has in all partitions, so it meets others in their strong ones, and meets other poor sets by single elements, given as short sets do. The guarantee holds whichever signatures are taken for common, so the probe decides about speed only.

Sets are named by a 64-bit hash (a node), and equal sets are one node from the start. One pass over the texts gives each row's node and
its signatures; one shuffle keeps the signatures that two nodes have, and of those that the same nodes have, one. Signature groups then give candidate pairs in
rounds: each node meets a few representatives of its groups, verified pairs become components, and only groups that still span
two components go on, with other representatives. What is left meets in full, so no link is lost, each node first in one block of the largest of its groups, then in all groups that still span two components: groups are cut
into blocks, pairs of blocks are compared within a task, and what leaves it are nodes that may have a partner, then, after comparison of whole sets in a task, links
that join two components: never more than nodes. A pair is first held against sizes and parity bit maps: each element flips one bit, so the bits
in which two maps differ are a lower bound of the elements in which the sets do.

Null texts and texts without words have an empty set and are components of their own; texts under five words have one shingle.
Rows that repeat a doc_id, null ones too, link like any others; a null doc_id is never a component's id unless all are null. Very long texts are
one step of their own, and blocks are bounded by elements as well as by nodes. Ties can't arise. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import BROADCAST_IDS, checkpointed, forget_shuffles, text_slices, utf8, without_ids
from tidemark.llm.components import components
from tidemark.llm.decontamination import shingle_sql
from tidemark.llm.shingles import WordHashes, mixed, ranges, shingle_sets

#: Growth and upper ends of the size bands; sets under 4 elements have no partner but equal sets. Sets of bands up to SHORT are short.
GROWTH, SHORT = 1.95, 128
_BANDS = [8]
while _BANDS[-1] < 1 << 40:
    _BANDS.append(int(_BANDS[-1] * GROWTH) + 1)
_BAND_ENDS = np.array(_BANDS, np.int64)
#: Documents that the probe for common signatures reads, the number of sets that makes one common, and how many are kept.
PROBE, COMMON, KEPT = 6000, 4, 200_000
#: Representatives of a group, how many of those that it shares most signatures with a node meets, and how often, before what is left meets in full.
REPRESENTATIVES, MEETS, ROUNDS = 4, 3, 1
#: How often a node meets one block of its largest group at most, before what is left meets in full; not once the links of a step are fewer than one for so many nodes.
WAVES, FEW = 5, 20
#: Nodes of a group that are held against each other, or against as many others, in one step, and the elements of theirs that may be held.
BLOCK, BLOCK_ITEMS = 256, 1 << 21
_GOLD, _LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xA0761D6478BD642F)


def most_differences(size):
    return (size + 5 * size // 4) // 9


#: First-level partitions by band, of three second-level ones each.
_FIRST_LEVEL = np.array([(5 * (most_differences(e) // 2 + 1) + 3) // 4 + 2 for e in _BANDS], np.int64)


def nodes_of(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; empty ones have the name of nothing."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(items), dtype=np.uint64)])
    return mixed(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _GOLD)).view(np.int64)


class Common:
    """Signatures taken for common: sorted, with a bit map that turns most others away."""

    def __init__(self, signs: np.ndarray):
        self.signs, self.seen = np.sort(signs), np.zeros(1 << 20, bool)
        self.seen[signs & (len(self.seen) - 1)] = True

    def has(self, signs: np.ndarray) -> np.ndarray:
        out = self.seen[signs & (len(self.seen) - 1)]
        at = np.flatnonzero(out)
        if len(at):
            out[at] = self.signs[np.minimum(np.searchsorted(self.signs, signs[at]), len(self.signs) - 1)] == signs[at]
        return out


def _given(strong: np.ndarray, counts: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a set gives signatures in each of its partitions in order (counts many), and whether it is poor, for each set."""
    so_far = np.concatenate([[0], np.cumsum(strong)])
    ends = np.cumsum(counts)
    before = so_far[ends - counts]
    poor = so_far[ends] - before < need
    return (so_far[:-1] - np.repeat(before, counts) < np.repeat(need, counts)) | np.repeat(poor, counts), poor


def _elements(values: np.ndarray, n: np.ndarray, give: np.ndarray, salts: np.ndarray, common: Common, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of single elements of sets (n elements each), the first give of them with common ones last, and the set's place for each; or all."""
    signs, place = mixed(mixed(values) + np.repeat(salts, n)).view(np.int64), np.repeat(np.arange(len(n)), n)
    if every:
        return signs, place
    return signs[np.lexsort((common.has(signs), place))][ranges(np.cumsum(n) - n, give)], np.repeat(np.arange(len(n)), give)


def signatures(items: np.ndarray, bounds: np.ndarray, common: Common, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Signatures that sets (end to end) give in their bands, and the number of the set for each; or all that sets with enough elements could give."""
    sizes = np.diff(bounds)
    band = np.searchsorted(_BAND_ENDS, sizes)
    found, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def by_element(sets: np.ndarray, bands: np.ndarray, kind: int) -> None:
        signs, place = _elements(items[ranges(bounds[sets], sizes[sets])], sizes[sets], most_differences(sizes[sets]) + 1, (2 * bands + kind).astype(np.uint64) * _GOLD, common, every)
        found.append(signs)
        owners.append(sets[place])

    for level in (0, 1):
        own = np.flatnonzero((sizes >= 4) & ((level == 0) | (5 * sizes // 4 > _BAND_ENDS[band])))
        short = _BAND_ENDS[band[own] + level] <= SHORT
        if short.any():
            by_element(own[short], band[own[short]] + level, 1)
        if short.all():
            continue
        sets = own[~short]
        n, bands, k = sizes[sets], band[sets] + level, most_differences(sizes[sets])
        values, first = items[ranges(bounds[sets], n)], _FIRST_LEVEL[bands]
        offsets = 3 * (np.cumsum(first) - first)
        # A second-level partition is a range of the domain, so the sorted elements of one lie together.
        place = ((values >> np.uint64(32)) * np.repeat(3 * first, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(offsets, n)
        begins = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        content = np.zeros(3 * int(first.sum()), np.uint64)
        content[place[begins]] = mixed(np.add.reduceat(mixed(values), begins)) | np.uint64(1)
        content = content.reshape(-1, 3)
        number = np.arange(len(content)) - np.repeat(offsets // 3, first)
        base = np.repeat((2 * bands + 2).astype(np.uint64) * _GOLD, first) + (3 * number + 1).astype(np.uint64) * _RIGHT
        subsets = [(content[:, x], content[:, y], np.uint64(2 * j + 1)) for j, (x, y) in enumerate(((0, 1), (0, 2), (1, 2)))]
        signs = np.stack([mixed(x * _LEFT + y * _RIGHT + base * j) for x, y, j in subsets], axis=1).view(np.int64)
        full = np.stack([(x | y) != 0 for x, y, _ in subsets], axis=1)
        cold = full & ~common.has(signs.ravel()).reshape(-1, 3)
        gives, poor = _given(cold.all(1), first, k // 2 + 1)
        keep = full if every else cold & gives[:, None]
        found.append(signs[keep])
        owners.append(np.repeat(np.repeat(sets, first), keep.sum(1)))
        if every or poor.any():
            poor |= every
            by_element(sets[poor], bands[poor], 3)
    return np.concatenate(found), np.concatenate(owners)


def sketch(items: np.ndarray) -> np.ndarray:
    """Two bits for each element at least, flipped by the elements that hash there; the halves of a longer sketch, xored, are the shorter one."""
    bits = 2 << max(6, (len(items) - 1).bit_length())
    odd = np.bincount((mixed(items) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


class Sketches:
    """An Arrow column of sketches."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = column.offsets.to_numpy().astype(np.int64)
        self.words, self.begins, self.lengths = column.values.to_numpy().view(np.uint64), offsets[:-1], np.diff(offsets)

    def folded(self, rows: np.ndarray, length: int, to: int) -> np.ndarray:
        x = self.words[self.begins[rows][:, None] + np.arange(length)]
        while x.shape[1] > to:
            half = x.shape[1] // 2
            x = x[:, :half] ^ x[:, half:]
        return x


def may_be_similar(a: Sketches, i: np.ndarray, size_a: np.ndarray, b: Sketches, j: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether row i of a and row j of b may be similar, for each pair of rows."""
    maybe = 5 * np.minimum(size_a, size_b) >= 4 * np.maximum(size_a, size_b)
    kinds = a.lengths[i] << 32 | b.lengths[j]
    for kind in np.unique(kinds[maybe]).tolist():
        x, y = kind >> 32, kind & (1 << 32) - 1
        rows = np.flatnonzero(maybe & (kinds == kind))
        step = max(1, (1 << 21) // max(x, y))
        for at in range(0, len(rows), step):
            r = rows[at : at + step]
            bits = np.bitwise_count(a.folded(i[r], x, min(x, y)) ^ b.folded(j[r], y, min(x, y))).sum(1)
            maybe[r] = bits <= (size_a[r] + size_b[r]) // 9
    return maybe


_FOUND = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("more", pa.list_(pa.int64()))])


def _row_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))


def _signed(texts: DataFrame, common: Common, every: bool = False) -> DataFrame:
    """key, node, more: for each signature of a set, the signature and the set's node; for each row of texts, its row key, node, and more = size, row key, doc_id (or nothing), and the sketch.

    A set that a slice of the input repeats gives its signatures once for the slice.
    """
    hashes = WordHashes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            items, bounds = shingle_sets(utf8(part), hashes)
            nodes, sizes = nodes_of(items, bounds), np.diff(bounds)
            if not every:
                more = [np.concatenate([[n, r, d is not None, d or 0], sketch(items[a : a + n])]) for n, r, d, a in zip(sizes.tolist(), part.column("row").to_pylist(), part.column("doc_id").to_pylist(), bounds[:-1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(nodes), pa.array(more, _FOUND.field("more").type)], schema=_FOUND)
            _, once = np.unique(nodes, return_index=True)
            signs, owner = signatures(items[ranges(bounds[once], sizes[once])], np.concatenate([[0], np.cumsum(sizes[once])]), common, every)
            for at in range(0, len(signs), 1 << 17):
                s = signs[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(nodes[once][owner[at : at + len(s)]]), pa.nulls(len(s), _FOUND.field("more").type)], schema=_FOUND)

    return _row_key(texts).mapInArrow(run, "key bigint, node bigint, more array<bigint>")


def _common_signs(docs: DataFrame, seed: int = 71) -> Common:
    """Signatures that at least COMMON different sets of a probe of documents have."""
    n = docs.count()
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30))
    probe = docs.where(spread < int(min(1.0, PROBE / max(1, n)) * (1 << 30)) + 1)
    rows = _signed(probe, Common(np.zeros(0, np.int64)), every=True).select(F.col("key").alias("sign"), "node").groupBy("sign").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("n"))
    kept = rows.where((F.col("n") >= COMMON) & (F.col("x") != F.col("y"))).orderBy(F.desc("n"), "sign").limit(KEPT).select("sign")
    return Common(np.array(kept.toArrow().column(0).to_numpy(), np.int64))


def _shared(signed: DataFrame) -> DataFrame:
    """Of signed: the rows for documents, and those of signatures that two nodes at least have, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, node, shared = None, None, False  # of the last signature row; a first node waits until there is a second one
        for batch in batches:
            document = batch.column("more").is_valid()
            if document.true_count:
                yield batch.filter(document)
                batch = batch.filter(pc.invert(document))
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy() for c in (0, 1)])
            if sign is not None:
                rows = np.concatenate([[[sign], [node]], rows], axis=1)
            new = np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(0)])
            rows = rows[:, new]
            starts = np.concatenate([[True], rows[0, 1:] != rows[0, :-1]])
            number = np.cumsum(starts) - 1
            many = np.bincount(number) > 1
            goes_on = shared and sign is not None
            many[0] |= goes_on
            keep = many[number]
            if goes_on:
                keep[0] = False  # has left with an earlier batch
            sign, node, shared = int(rows[0, -1]), int(rows[1, -1]), bool(many[-1])
            rows = rows[:, keep]
            if rows.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1]), pa.nulls(rows.shape[1], _FOUND.field("more").type)], schema=_FOUND)

    return signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key bigint, node bigint, more array<bigint>")


def _distinct_groups(shared: DataFrame) -> DataFrame:
    """shared (sign, node) with one signature of those that the same nodes have: a passage in the same documents gives many. Groups are named by their size and two 64-bit hashes."""
    named = shared.groupBy("sign").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    return shared.join(named.groupBy("n", "x", "y").agg(F.min("sign").alias("sign")).select("sign"), "sign", "left_semi")


def _items(docs: DataFrame, nodes: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, items of the nodes in chosen (node), made anew from one row's text for each. The rows' keys are broadcast if they are few, and shuffled with docs otherwise."""
    wanted = checkpointed(nodes.join(chosen.distinct(), "node", "left_semi").select("row"))
    few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = _row_key(docs).join(F.broadcast(wanted) if few else wanted, "row", "left_semi").select("text")
    hashes = WordHashes()
    fields = pa.schema([("node", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            items, bounds = shingle_sets(utf8(part), hashes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes_of(items, bounds)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(items.view(np.int64)))], schema=fields)

    # Rows that repeat both doc_id and text bring a set twice.
    return checkpointed(texts.mapInArrow(run, "node bigint, items array<bigint>").dropDuplicates(["node"]))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs (a, b) but for those that sizes or sketches rule out."""
    left, right = (nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = np.arange(x.num_rows)
            maybe = may_be_similar(Sketches(x.column("sa")), rows, x.column("na").to_numpy(), Sketches(x.column("sb")), rows, x.column("nb").to_numpy())
            yield x.select(["a", "b"]).filter(pa.array(maybe))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are similar enough."""
    pairs = checkpointed(pairs)
    whole = _items(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one, other = x.column("x"), x.column("y")
            yield x.select(["a", "b"]).filter(pa.array([similar(one[i].values.to_numpy(), other[i].values.to_numpy()) for i in range(x.num_rows)], pa.bool_()))

    met = pairs.join(whole.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(whole.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    return met.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links; components so far are single nodes of the new graph."""
    if labels is None:
        return components(links)
    up = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    top = components(links.join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    moved = labels.join(top.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return moved.union(top.join(labels, "node", "left_anti").select("node", "comp"))


def _met(rows: DataFrame, round_: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components: each node with those of its groups' representatives that it shares most signatures with. rows: sign, node, comp."""
    first = [F.min(F.struct(F.xxhash64(F.lit(round_ * REPRESENTATIVES + k), "node"), "node", "comp")) for k in range(REPRESENTATIVES)]
    groups = rows.groupBy("sign").agg(F.array_distinct(F.array(*first)).alias("reps")).select("sign", F.explode("reps").alias("r")).select("sign", F.col("r.node").alias("rep"), F.col("r.comp").alias("rep_comp"))
    met = rows.join(groups, "sign").where("comp <> rep_comp").groupBy("node", "rep").agg(F.count("*").alias("n"))
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "rep")), asc=False), 1, MEETS).alias("best")).select("node", F.explode("best.rep").alias("rep"))
    return best.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).distinct()


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells, from rows sorted by their first column, cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        if held and held[0].column(0)[0].as_py() == keys[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if whole := [*held, *([batch.slice(0, cut)] if cut else [])]:
            yield pa.Table.from_batches(whole)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _within_cells(cells: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one cell and different components that may be similar; of two blocks (sides 0 and 1) pairs across, within one block (side -1) all."""
    cell, comp, side, size = (cells.column(c).to_numpy() for c in ("cell", "comp", "side", "size"))
    sketches = Sketches(cells.column("sketch"))
    for step in range(1, len(cell)):
        i = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(i):
            return
        i = i[(comp[i] != comp[i + step]) & ((side[i] < 0) | (side[i] != side[i + step]))]
        i = i[may_be_similar(sketches, i, size[i], sketches, i + step, size[i + step])]
        if len(i):
            yield i, i + step


def _in_full(rows: DataFrame, nodes: DataFrame, docs: DataFrame, wave: int | None = None) -> DataFrame:
    """Links (a, b) between nodes that share a signature, not a component: enough of them to join all that are similar. rows: sign, node, comp.

    A wave compares within blocks only, which it deals in its own way.
    """
    sized = rows.join(nodes.select("node", "size"), "node")
    blocks = sized.groupBy("sign").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_ITEMS)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "sign").withColumn("own", F.pmod(F.xxhash64(F.lit(wave or 0), "node"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.col("own") if wave is not None else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("sign", F.least("own", "other"), F.greatest("own", "other"))
    side = F.when(F.col("own") == F.col("other"), -1).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cells = spread.select(cell.alias("cell"), "node", "comp", side.alias("side"))
    drawn = nodes.select("node", "size", "sketch")
    kept_fields = pa.schema([("cell", pa.int64()), ("node", pa.int64()), ("comp", pa.int64()), ("side", pa.int32())])
    link_fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            kept = np.zeros(table.num_rows, bool)
            for i, j in _within_cells(table):
                kept[i] = kept[j] = True
            yield from table.select(kept_fields.names).filter(pa.array(kept)).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, node, comp = (table.column(c).to_numpy() for c in ("cell", "node", "comp"))
            items = table.column("items").combine_chunks()
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def top(x: tuple[int, int], up: dict = up) -> tuple[int, int]:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            links = []
            for rows_i, rows_j in _within_cells(table):
                for i, j in zip(rows_i.tolist(), rows_j.tolist(), strict=True):
                    a, b = top((cell[i], comp[i])), top((cell[j], comp[j]))
                    if a != b and similar(items[i].values.to_numpy(), items[j].values.to_numpy()):
                        up[a] = b
                        links.append((node[i], node[j]))
            pairs = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=link_fields)

    kept = checkpointed(cells.join(drawn, "node").select("cell", "node", "comp", "side", "size", "sketch").repartition("cell").sortWithinPartitions("cell").mapInArrow(keep, "cell bigint, node bigint, comp bigint, side int"))
    whole = _items(docs, nodes, kept.select("node"))
    met = kept.join(drawn, "node").join(whole, "node").select("cell", "node", "comp", "side", "size", "sketch", "items")
    return met.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a bigint, b bigint")


def _largest(rows: DataFrame) -> DataFrame:
    """rows, each node in the largest of its groups only."""
    counted = rows.join(rows.groupBy("sign").agg(F.count("*").alias("n")), "sign")
    best = counted.groupBy("node").agg(F.max(F.struct("n", "sign")).alias("best"), F.first("comp").alias("comp"))
    return best.select("best.sign", "node", "comp")


def _spanning(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """sign, node, comp of the groups that span two components at least."""
    every = shared.join(labels, "node", "left").select("sign", "node", F.coalesce("comp", "node").alias("comp"))
    spans = every.groupBy("sign").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("sign")
    return checkpointed(every.join(spans, "sign"))


def node_components(shared: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, comp for the nodes in shared (sign, node) that have links."""
    rows, labels = shared.withColumn("comp", F.col("node")), None
    rounds = [lambda rows, k=k: _verified(_plausible(_met(rows, k), nodes), docs, nodes) for k in range(ROUNDS)]
    # Groups and blocks of one cluster overlap; a few blocks of each node join most of it, so that its links don't come from all of them.
    waves = [lambda rows, k=k: _in_full(_largest(rows), nodes, docs, k) for k in range(WAVES)]
    few = False
    for step in (*rounds, *waves, lambda rows: _in_full(rows, nodes, docs)):
        if few and step in waves:
            continue
        links = checkpointed(step(rows))
        n_links = links.count()
        few = FEW * n_links < rows.select("node").distinct().count()
        if labels is None or n_links:
            labels = checkpointed(_joined(labels, links))
            rows = _spanning(shared, labels)
        forget_shuffles(shared.sparkSession)
        if not rows.limit(1).count():
            break
    return labels


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), and component, the class as a hash; one row for each row of docs."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    both = checkpointed(_shared(_signed(texts, _common_signs(texts))))
    forget_shuffles(docs.sparkSession)
    more = F.col("more")
    sets = both.where("more is not null").select(F.when(more[2] == 1, more[3]).alias("doc_id"), F.when(more[0] > 0, F.col("node")).alias("node"), more[0].alias("n_shingles"), more[1].alias("row"), "more")
    shared = checkpointed(_distinct_groups(both.where("more is null").select(F.col("key").alias("sign"), "node")))
    drawn = sets.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("row", "n_shingles", "more")).alias("one"))
    nodes = checkpointed(drawn.select("node", "one.row", F.col("one.n_shingles").alias("size"), F.slice("one.more", F.lit(5), F.size("one.more") - 4).alias("sketch")))
    labels = node_components(shared, texts, nodes)
    rows = sets.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component"))
    # From a checkpoint, and without components of one row: the join is a plain one of two tables, in which Spark can split a component that holds much of all rows.
    least = checkpointed(rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return rows.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return jaccard_classes(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each class, the one with the smallest doc_id. Rows that repeat both doc_id and text count as one; rows with a null doc_id stay."""
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    return without_ids(docs, jaccard_digest(docs).where("doc_id <> component_id"))


ORACLE = f"""
WITH RECURSIVE d AS ({shingle_sql("documents", "doc_id")}), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM d a JOIN d b USING (s) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON other = x)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
