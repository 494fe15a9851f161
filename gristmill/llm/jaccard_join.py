"""N-gram Jaccard join by PartEnum signatures.

Two sets whose Jaccard similarity reaches a threshold differ in few elements: a set of size a
differs from any partner in at most k(a) = a(1-t)/t. So if the 64-bit domain of shingle hashes is
partitioned, all but k(a) partitions hold the same subset in both. A set's parts are the non-empty
subsets of its partitions; in any order of parts that all sets share, the first k(a)+1 parts of both
sets have one in common. These parts are the signatures. Partitions are as many as fit the sets of
a band of sizes; a set near the upper end of its band also signs for the next one.

Parts without a rare shingle come last in the order, so texts that only share a frequent passage
rarely meet. Which shingles are frequent decides about speed only, never about the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.expressions import named

from .common import bounded, keyed_texts, small_arrow_batches, small_batches, written
from .word_hashes import mixed, word_hashes

PERCENT = 75
SHINGLE_WORDS = 5
# Below this size every shingle is a partition of its own.
SINGLE_BELOW = 64
# At most this many frequent shingles are known to the tasks, those that occur most often.
FREQUENT = 1 << 20
# Groups of signatures up to this size give all their pairs at once; larger ones go through components.
SMALL_GROUP = 16
PIVOTS = 4
# Members of a crowded group that meet in one task.
BLOCK = 8192
SKETCH_BITS = 2048

_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_SETS = "node long, size long, elements binary"


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int = SHINGLE_WORDS):
        self._width = width

    def __call__(self, text: str) -> np.ndarray:
        # bytes.lower and bytes.split know A-Z and ASCII white space only, which is what is asked for.
        words = text.encode().lower().split()
        n, width = len(words), self._width
        if not n:
            return np.zeros(0, dtype=np.uint64)
        values = word_hashes(words)
        span = min(n, width)
        rows = n - span + 1
        total = np.full(rows, span, dtype=np.uint64)
        for i in range(span):
            total = total * _MULTIPLIERS[i % 5] + values[i : i + rows]
        total = mixed(total)
        total.sort()
        new = total[1:] != total[:-1]
        return total if new.all() else total[np.concatenate([[True], new])]


def set_key(elements: np.ndarray, seed: int = 0) -> int:
    """A signed 64-bit key of a set."""
    return xxhash.xxh64_intdigest(elements.tobytes(), seed) - (1 << 63)


def allowed_difference(size: int, percent: int) -> int:
    """The most elements by which a set of this size differs from a set that is similar enough."""
    return size * (100 - percent) // percent


def bands(size: int, percent: int) -> list[int]:
    """Upper size limits (powers of two) of the bands that a set signs for."""
    top = 1 << size.bit_length()
    return [top, 2 * top] if 100 * size >= percent * top else [top]


def partitions(top: int) -> int | None:
    """How many partitions the domain has for a band; None: one for each element."""
    if top <= SINGLE_BELOW:
        return None
    return top if top <= 256 else top // 2


def signatures(elements: np.ndarray, levels: np.ndarray, percent: int, rule=partitions) -> np.ndarray | None:
    """Signed 64-bit signatures of a set; None if its partitions are too few for the guarantee.

    levels: how frequent each element is, 0 to 63; rarer parts come first.
    """
    take, out = allowed_difference(len(elements), percent) + 1, []
    for top in bands(len(elements), percent):
        count = rule(top)
        sums = mixed(elements + np.uint64(top))
        least = levels
        if count is not None:
            # Elements are in order, so those of a partition (a range of the domain) stand together.
            places = elements >> np.uint64(64 - count.bit_length() + 1)
            starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
            sums, least = mixed(np.add.reduceat(sums, starts)), np.minimum.reduceat(levels, starts)
        if len(sums) < take:
            return None
        keys = (least.astype(np.uint64) << np.uint64(58)) | (sums >> np.uint64(6))
        out.append(np.partition(keys, take - 1)[:take])
    return np.concatenate(out).view(np.int64)


def sketch(elements: np.ndarray) -> bytes:
    """The parity of the number of elements in each of SKETCH_BITS cells.

    Two sets differ in at least as many elements as their sketches in bits.
    """
    cells = (elements & np.uint64(SKETCH_BITS - 1)).astype(np.intp)
    return np.packbits((np.bincount(cells, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def may_be_similar(apart: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """False where sets that differ in at least `apart` elements, of these sizes together, cannot be similar."""
    return apart * (100 + percent) <= sizes * (100 - percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def node_of(elements: np.ndarray, collided: frozenset[int], key=set_key) -> int:
    """The number of a set: its key, or its second key if two different sets have the first one."""
    first = key(elements)
    return key(elements, 1) if first in collided else first


def near_duplicates(
    docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE_WORDS, link_counts: bool = False, key=set_key
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and set_key, with `link_counts` also n_links.

    Documents link when the Jaccard similarity of their sets of `width`-word shingles is at least
    percent/100. component_id is the smallest doc_id reachable by links, n_links the number of other
    sets that a document's set links to. Texts with equal sets form one class, whose copies are
    never paired. Missing texts and texts without words have no shingles, link with nothing and are
    their own components; a row without doc_id takes part, but names no component. Repeated rows come back each;
    other columns are left out. set_key is equal for equal sets and missing for those without shingles.

    Components need few of the links within a large group; with `link_counts` all its pairs are compared.
    Keys have 64 bits. Where two different sets have the same one (n * n / 2**65 such keys are expected among n
    sets, a few at 10**10), both go by their second key instead.
    """
    texts = keyed_texts(docs)
    first = written(texts.mapInArrow(_first_pass(width, key), "doc_id long, size long, node long, other long, sketch binary, element long, seen long"), "sets")
    sizes = first.where(F.col("seen").isNull()).select("doc_id", "size", "node", "other", "sketch")
    sizes = sizes.withColumn("set_key", F.col("node"))

    def known_nodes() -> DataFrame:
        grouped = sizes.where("node IS NOT NULL").groupBy("node")
        return written(grouped.agg(F.min("doc_id").alias("rep"), F.min("other").alias("low"), F.max("other").alias("high"), F.max("size").alias("size"), F.max("sketch").alias("sketch")), "nodes")

    nodes = known_nodes()
    collided = frozenset(r["node"] for r in nodes.where("low <> high").select("node").collect())
    if collided:
        sizes = sizes.withColumn("node", F.when(F.col("node").isin(*collided), F.col("other")).otherwise(F.col("node")))
        nodes = known_nodes()

    def number(elements: np.ndarray) -> int:
        return node_of(elements, collided, key)

    frequent = texts.sparkSession.sparkContext.broadcast(_frequent(first.where("seen IS NOT NULL")))

    signed = written_groups(texts.mapInArrow(_signer(width, percent, frequent, partitions, number), "signature long, node long"))
    rest = _rest_pairs(texts, signed, width, number)
    pairs = signed.where("kind = 0").select("a", "b").distinct()
    pairs = written(pairs if rest is None else pairs.union(rest).distinct(), "pairs")

    def verified(candidates: DataFrame) -> DataFrame:
        return written(_verified(candidates, texts, nodes, percent, width, number), "links")

    links = verified(pairs)
    crowded = signed.where("kind = 1").select(F.col("b").alias("signature"), F.col("a").alias("node"))
    if link_counts:
        links = written(links.union(verified(_all_crowded_pairs(crowded, pairs, nodes, percent))), "all-links")
        labels = components(links)
    else:
        labels = _merged_groups(crowded, links, pairs, nodes, percent, verified)

    # The smallest document of a component, over all nodes that carry its label.
    node_labels = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = node_labels.groupBy("label").agg(F.min("rep").alias("component_id"))
    # Only nodes of more than one document or with links need a look-up; there are at most as many as documents.
    known = node_labels.join(least, "label").select("node", "component_id")
    if link_counts:
        both = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node")))
        known = known.join(both.groupBy("node").agg(F.count(F.lit(1)).alias("n_links")), "node", "left")
    return sizes.join(known, "node", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        "set_key",
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if link_counts else []),
    )


def with_set_keys(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """The rows as structs `row`, with the set_key that near_duplicates gives their texts."""
    small_arrow_batches(docs.sparkSession)
    rows = docs.select(F.struct(*named(docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in small_batches(batches):
            sets = [shingler(text) for text in batch.column(1).to_pylist()]
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([batch.column(0), keys], names=["row", "set_key"])

    return rows.mapInArrow(keyed, rows.select("row", F.lit(None).cast("long").alias("set_key")).schema)


def written_groups(signed: DataFrame) -> DataFrame:
    """Candidates from signature groups: kind 0 a pair (a, b), 1 a member a of crowded group b, 2 a set a to treat singly."""
    shuffles = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = signed.repartition(shuffles, "signature").sortWithinPartitions("signature", "node")
    return written(grouped.mapInArrow(_grouper, "kind int, a long, b long"), "groups")


def components(links: DataFrame) -> DataFrame:
    """Node and label (the least node) of every connected component with a link.

    Large-star and small-star steps alternate until nothing changes; each halves the distances.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, state = written(edges, "edges"), None
    while True:
        mirrored = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = _star(mirrored, larger_only=True)
        edges = written(_star(edges, larger_only=False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    labels = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return written(labels.union(edges.select("v", "v").distinct()), "labels")


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connect the neighbours of each node (the larger or the smaller ones) with the least of them."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = edges.join(least, "u")
    if larger_only:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _first_pass(width: int, key):
    """Rows of documents (size and keys of their sets) and of shingles that a task saw in more than one set."""
    names = ["doc_id", "size", "node", "other", "sketch", "element", "seen"]

    def nulls(n, kind=pa.int64()):
        return pa.nulls(n, kind)

    def shingle_rows(held):
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        values, counts = values[counts > 1].view(np.int64), counts[counts > 1]
        n = len(values)
        return pa.record_batch([nulls(n)] * 4 + [nulls(n, pa.binary()), pa.array(values), pa.array(counts, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size, seen = Shingler(width), [], 0, set()
        for batch in small_batches(batches):
            sizes, keys, others, sketches = [], [], [], []
            for text in batch.column(1).to_pylist():
                elements = shingler(text)
                sizes.append(len(elements))
                keys.append(key(elements) if len(elements) else None)
                others.append(key(elements, 1) if len(elements) else None)
                sketches.append(None)
                if keys[-1] is not None and (keys[-1], others[-1]) not in seen:
                    sketches[-1] = sketch(elements)
                    seen.add((keys[-1], others[-1]))
                    held.append(elements)
                    size += len(elements)
                if size > 2_000_000:
                    yield shingle_rows(held)
                    held, size = [], 0
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, keys, others))]
            columns.append(pa.array(sketches, pa.binary()))
            yield pa.record_batch([*columns, nulls(len(sizes)), nulls(len(sizes))], names=names)
        if held:
            yield shingle_rows(held)

    return run


def _frequent(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most FREQUENT, in order, with their levels (binary logarithms)."""
    totals = written(seen.groupBy("element").agg(F.sum("seen").alias("n")).where("n >= 8"), "frequent")
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    reached, lowest = 0, 64
    for row in totals.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reached += row["count"]
        if reached > FREQUENT:
            break
        lowest = row["level"]
    kept = totals.where(level >= lowest).select("element", level.alias("level")).toArrow()
    elements = kept.column("element").to_numpy().view(np.uint64)
    order = np.argsort(elements)
    return elements[order], kept.column("level").to_numpy().astype(np.uint8)[order]


def _signer(width: int, percent: int, frequent, rule, number):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, (known, known_levels) = Shingler(width), set(), frequent.value
        for batch in small_batches(batches):
            rows, keys = [], []
            for text in batch.column(1).to_pylist():
                elements = shingler(text)
                key = number(elements)
                if not len(elements) or key in seen:
                    continue
                seen.add(key)
                levels = np.zeros(len(elements), dtype=np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
                    levels = np.where(known[at] == elements, known_levels[at], np.uint8(0))
                signed = signatures(elements, levels, percent, rule)
                # Too few partitions for the guarantee: the set goes on without signature.
                rows.append(signed)
                keys.append(key)
            sizes = [1 if r is None else len(r) for r in rows]
            values = [np.zeros(1, np.int64) if r is None else r for r in rows]
            single = np.repeat(np.array([r is None for r in rows], dtype=bool), sizes)
            if rows:
                yield pa.record_batch(
                    [pa.array(np.concatenate(values), mask=single), pa.array(np.repeat(np.array(keys, np.int64), sizes))],
                    names=["signature", "node"],
                )

    return sign


def _grouper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal signatures, in order, to pairs and crowded members; a run may go over many batches."""
    signature, members, crowded = None, [], False

    def flush(pairs):
        if not crowded:
            pairs += [(a, b) for i, a in enumerate(members) for b in members[i + 1 :]]

    for batch in batches:
        singles = batch.filter(pc.is_null(batch.column(0)))
        rows = batch.filter(pc.is_valid(batch.column(0)))
        pairs, crowd = [], []
        signatures_, nodes = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], signatures_[1:] != signatures_[:-1]])) if len(nodes) else []
        ends = np.append(starts[1:], len(nodes)) if len(nodes) else []
        # Nearly all signatures occur once. Only runs of several rows, the first, which may go on with the last
        # run of the batch before, and the last, which may go on in the next, are looked at.
        several = np.flatnonzero(np.asarray(ends) - np.asarray(starts) > 1) if len(nodes) else []
        for run in dict.fromkeys([*([0] if len(nodes) else []), *(int(x) for x in several), *([len(starts) - 1] if len(nodes) else [])]):
            start, end = int(starts[run]), int(ends[run])
            current = int(signatures_[start])
            if current != signature:
                flush(pairs)
                signature, members, crowded = current, [], False
            for node in np.unique(nodes[start:end]).tolist() if end - start > 1 else (int(nodes[start]),):
                if members and node == members[-1]:
                    continue
                if not crowded and len(members) == SMALL_GROUP:
                    crowded = True
                    crowd += [(m, signature) for m in members]
                    if signature % 8 == 0:
                        pairs += [(p, m) for i, p in enumerate(members[:PIVOTS]) for m in members[i + 1 :]]
                if crowded:
                    crowd.append((node, signature))
                    if signature % 8 == 0:
                        pairs += [(p, node) for p in members[:PIVOTS]]
                    members[PIVOTS:] = [node]
                else:
                    members.append(node)
        yield _groups(pairs, crowd, singles.column(1).to_pylist())
    pairs = []
    flush(pairs)
    yield _groups(pairs, [], [])


def _groups(pairs, crowd, singles) -> pa.RecordBatch:
    kinds = np.repeat(np.array([0, 1, 2], dtype=np.int32), [len(pairs), len(crowd), len(singles)])
    rows = np.array(pairs + crowd + [(s, 0) for s in singles], dtype=np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(kinds), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["kind", "a", "b"])


def _elements(width: int, number):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in small_batches(batches):
            wanted = batch.column(1).to_pylist()
            rows = []
            for text, node in zip(batch.column(0).to_pylist(), wanted):
                elements = shingler(text)
                key = number(elements)
                if len(elements) and (node is None or node == key):
                    rows.append((key, len(elements), elements.tobytes()))
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["node", "size", "elements"])

    return make


def _sets(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, width: int, number) -> DataFrame:
    """node, size and elements of the wanted nodes, made again from one document each."""
    reps = nodes.join(wanted, "node", "left_semi").select("node", F.col("rep").alias("doc_id"))
    holders = bounded(reps.where("doc_id IS NOT NULL"), "representatives")
    own = texts.where("doc_id IS NOT NULL").join(holders, "doc_id").select("text", "node")
    sets = own.mapInArrow(_elements(width, number), _SETS)
    nameless = reps.where("doc_id IS NULL").select("node")
    if not nameless.isEmpty():
        found = texts.where("doc_id IS NULL").select("text", F.lit(None).cast("long").alias("node"))
        sets = sets.union(found.mapInArrow(_elements(width, number), _SETS).join(nameless, "node", "left_semi"))
    return sets.dropDuplicates(["node"])


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, percent: int, width: int, number) -> DataFrame:
    """The pairs whose sets are similar enough."""
    own = nodes.select("node", "size", "sketch")
    for side in "ab":
        renamed = [F.col(c).alias(f"{c}_{side}") for c in ("size", "sketch")]
        pairs = pairs.join(own.select(F.col("node").alias(side), *renamed), side)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sizes = [batch.column(i).to_numpy() for i in (2, 3)]
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (4, 5)]
            kept = may_be_similar(np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64), sizes[0] + sizes[1], percent)
            kept &= 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
            yield batch.select([0, 1]).filter(pa.array(kept))

    columns = ["a", "b", "size_a", "size_b", "sketch_a", "sketch_b"]
    pairs = written(pairs.select(*columns).mapInArrow(likely, "a long, b long"), "likely-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets(wanted, texts, nodes, width, number).select("node", "elements")
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("right"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts_ = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            kept = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in texts_]
            yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")
    return joined.mapInArrow(check, "a long, b long").distinct()


def _rest_pairs(texts: DataFrame, signed: DataFrame, width: int, number) -> DataFrame | None:
    """Pairs of the sets without signatures with all sets that share a shingle; almost never needed."""
    rest = signed.where("kind = 2").select(F.col("a").alias("node")).distinct()
    if rest.isEmpty():
        return None

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                elements = shingler(text)
                if len(elements):
                    keys = pa.array(np.full(len(elements), number(elements), dtype=np.int64))
                    yield pa.record_batch([keys, pa.array(elements.view(np.int64))], names=["node", "element"])

    postings = texts.select("text").mapInArrow(explode, "node long, element long")
    own = postings.join(rest, "node", "left_semi").distinct().select(F.col("node").alias("one"), "element")
    met = own.join(postings, "element").where("one <> node")
    return met.select(F.least("one", "node").alias("a"), F.greatest("one", "node").alias("b")).distinct()


def _merged_groups(crowded, links, tested, nodes, percent: int, verified) -> DataFrame:
    """Labels of all components, after the crowded groups have been searched for links between components.

    The first rounds take, per block of a group, a spanning forest of the members' components along pairs that
    their sketches leave possible: fewer pairs than members. These are compared exactly, and what they link is
    one component in the next round. Groups of more than BLOCK members are dealt to random blocks first; then all
    members but those of the largest component visit every block, in a round of forests and in the last round,
    which compares all pairs between different components that are still possible, so nothing is left out.
    Without such groups the first round has met all members, and the last one follows at once.
    """
    labels = components(links)
    for stage in ("dealt", "forests", "all"):
        placed, blocks = _open_groups(crowded, labels, at_random=stage == "dealt")
        if not blocks:
            break
        if stage == "forests" and blocks == 1:
            continue
        placed = placed.join(nodes.select("node", "size", "sketch"), "node")
        found = placed.groupBy("signature", "block").applyInArrow(_possible_pairs(percent, stage != "all"), "a long, b long")
        fresh = written(found.distinct().join(tested, ["a", "b"], "left_anti"), "fresh-pairs")
        new = verified(fresh)
        tested = written(tested.union(fresh), "tested-pairs")
        if not new.isEmpty():
            links = written(links.union(new), "all-links")
            labels = components(links)
    return labels


def _open_groups(crowded: DataFrame, labels: DataFrame, at_random: bool) -> tuple[DataFrame, int]:
    """Members of the crowded groups that hold several components, with label, block and whether they visit it;
    and the most blocks that a group has, 0 without groups."""
    labelled = crowded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = labelled.groupBy("signature", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("signature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("n", "label")).alias("main")
    )
    groups = bounded(groups.where("labels > 1").select("signature", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "main"), "open-groups")
    members = labelled.join(groups, "signature")
    home = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.withColumns({"home": home, "largest": F.col("label") == F.col("main")})
    everywhere = F.array("home") if at_random else F.sequence(F.lit(0), F.col("blocks") - 1)
    members = members.withColumn("block", F.explode(F.when(F.col("largest"), F.array("home")).otherwise(everywhere)))
    members = members.select("signature", "node", "label", "block", (F.col("block") != F.col("home")).alias("visits"), "largest")
    return members, groups.agg(F.max("blocks")).first()[0] or 0


def _possible_pairs(percent: int, forest: bool):
    """Pairs of different components in a block that sketches leave possible: all, or as many as join what they can."""

    def search(group: pa.Table) -> pa.Table:
        group = group.sort_by([("size", "ascending"), ("node", "ascending")])
        nodes, labels, sizes = (group.column(c).to_numpy() for c in ("node", "label", "size"))
        visits, largest = (np.asarray(group.column(c), dtype=bool) for c in ("visits", "largest"))
        bits = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(nodes), -1)
        tree = np.unique(labels, return_inverse=True)[1]
        low, high = np.searchsorted(sizes, -(-sizes * percent // 100)), np.searchsorted(sizes, sizes * 100 // percent, side="right")
        out = [np.zeros((0, 2), dtype=np.int64)]
        # A pair of two components has a member outside of the largest one, and a pair of two guests is met at home.
        for i in np.flatnonzero(~largest).tolist():
            j = np.arange(low[i], high[i])
            j = j[(tree[j] != tree[i]) & (largest[j] | (j > i))]
            if visits[i]:
                j = j[~visits[j]]
            j = j[may_be_similar(np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64), sizes[j] + sizes[i], percent)]
            if forest and len(j):
                # One pair for each tree, after which these trees are one.
                trees, first = np.unique(tree[j], return_index=True)
                j = j[first]
                tree[np.isin(tree, trees)] = tree[i]
            if len(j):
                out.append(np.stack([np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])], axis=1))
        pairs = np.concatenate(out)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return search


def _all_crowded_pairs(crowded, pairs, nodes, percent: int) -> DataFrame:
    """All pairs in crowded groups that a sketch cannot rule out; groups are cut into blocks, and each pair of
    blocks is compared by itself. Only numbers of links need this."""
    groups = crowded.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    members = crowded.join(bounded(groups, "groups"), "signature").join(nodes.select("node", "size", "sketch"), "node")
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), dtype=np.int64)]
        group = group.sort_values("size", kind="stable")
        sizes, nodes_ = (group[c].to_numpy() for c in ("size", "node"))
        block, one_block = group["block"].to_numpy(), group["low"].iloc[0] == group["high"].iloc[0]
        bits = np.frombuffer(b"".join(group["sketch"]), dtype=np.uint64).reshape(len(group), -1)
        high = np.searchsorted(sizes, sizes * 100 // percent, side="right")
        for i in range(len(group)):
            j = np.arange(i + 1, max(high[i], i + 1))
            j = j[one_block | (block[j] != block[i])]
            apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
            j = j[may_be_similar(apart, sizes[j] + sizes[i], percent)]
            found.append(np.stack([np.minimum(nodes_[i], nodes_[j]), np.maximum(nodes_[i], nodes_[j])], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])

    met = members.groupBy("signature", "low", "high").applyInPandas(compare, "a long, b long").distinct()
    return written(met.join(pairs, ["a", "b"], "left_anti"), "crowded-pairs")
