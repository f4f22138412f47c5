"""Similarity join of word n-gram sets by chosen paths."""

from __future__ import annotations

import hashlib
import math
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, text_slices
from .components import components, local_roots

#: Words known to a worker, and characters of texts that are parted into words at once.
KEPT_WORDS, SLICE_WORDS = 150_000, 1_500_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def shingler(n: int) -> Shingler:
    """The shingler of this worker process, which knows the words of earlier tasks."""
    return Shingler(n)


class Shingler:
    """Sets of hashed word n-grams; words are what white space parts. A text with fewer words than n has one n-gram of
    all its words, a text without words none."""

    def __init__(self, n: int):
        self.n = n
        self.known: dict[str, int] = {}
        self.factors = mixed(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN) | np.uint64(1)

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        words = [text.split() for text in texts]
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        known = self.known
        for word in set(chain.from_iterable(words)):
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        out = []
        for row in words:
            codes = np.fromiter(map(known.__getitem__, row), np.uint64, len(row))
            m = min(self.n, len(codes))
            if not m:
                out.append(codes)
                continue
            total = np.zeros(len(codes) - m + 1, np.uint64)
            for k in range(m):
                total += codes[k : k + len(total)] * self.factors[k]
            out.append(np.unique(mixed(total)))
        return out


def sketch_of(grams: np.ndarray, coordinates: int) -> np.ndarray:
    """Min-wise hashes: two sets agree at a coordinate with the probability of their Jaccard similarity."""
    out = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    seeds = mixed(np.arange(coordinates, dtype=np.uint64) + GOLDEN)
    low, odd = (seeds & np.uint64(0xFFFFFFFF)).astype(np.uint32), (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(short), 2048):
        np.minimum(out, (((short[a : a + 2048, None] ^ low) * odd) ^ low).min(axis=0), out)
    return out


def row_key(id_column: str, text_column: str) -> Column:
    """16 bytes that identify a row's id and text."""
    name = F.coalesce(F.col(id_column).cast("string"), F.lit("\x00"))
    return F.unhex(F.md5(F.concat(name, F.lit("\x01"), F.coalesce(F.col(text_column), F.lit(""))).cast("binary")))


def chosen_children(paths: np.ndarray, sketches: np.ndarray, sampling: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows go on to which child paths: a coordinate of a row is followed if a hash of its path, place and value
    is below 1 / (sampling * coordinates). Rows that share the value at a place are sampled alike."""
    places = mixed(np.arange(sketches.shape[1], dtype=np.uint64) + np.uint64(101))
    codes = mixed(mixed(paths[:, None] ^ places[None]) + sketches.astype(np.uint64) * GOLDEN)
    row, place = np.nonzero(codes < np.uint64(2**64 / (sampling * sketches.shape[1])))
    return row, mixed(codes[row, place] ^ np.uint64(77)).view(np.int64)


def survival(similarity: float, sampling: float, depth: int) -> float:
    """Chance that two sets of this similarity still share a path at this depth of one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-similarity / sampling * q)
    return q


def near_duplicate_classes(
    docs: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    recall: float = 0.99,
    depth: int = 4,
    sampling: float = 0.7,
    coordinates: int = 64,
    bucket: int = 16_384,
    leaders: int = 16,
    block: int = 1024,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, ``row_key``, ``class_id`` (smallest id of those reachable by links, by
    copies of the text too), ``n_links`` (other rows with a similarity of ``threshold`` or more, copies included) and
    ``kept`` (the id and text are those of the class's representative; equal rows share this).

    Equal sets are one node with a number of copies. In each of several runs every node follows sampled coordinates of
    its sketch; nodes that reach the same path share a bucket. Buckets of up to ``bucket`` nodes are compared by
    sketch, each member with those that no group has yet, so that alike ones cost a comparison or two and a bucket makes no
    more rows than it has members. In larger ones every member is first compared with ``leaders`` members of the
    bucket, then with as many of those that were related to none. A bucket whose other members are all related to leaders
    that hang together is done, as they are one group. What is left is split again by its next coordinates, up to ``depth`` times, and
    a bucket that is still larger (many sets alike) is taken as related as a whole. The number of runs follows from ``recall`` at the
    threshold and the full depth. What is related so is then compared exactly, each group of related sets in blocks of
    ``block`` against one another, so links are counted once and no list of pairs is made.

    Null or empty texts, and texts without words, link with nothing and are classes of their own, by their row's id;
    null ids form classes like others, with a null class id if no id is there. An empty table gives no rows; further
    columns are not read."""
    id_type = docs.schema[id_column].dataType
    source = docs.select(F.col(id_column).alias("id"), row_key(id_column, text_column).alias("row_key"), F.col(text_column).alias("text"))

    def sketched(batches):
        words = shingler(n)
        for batch in batches:
            keys, sizes, sketches = [], [], []
            for _, _, texts in text_slices(batch.column("text"), SLICE_WORDS):
                for grams in words.sets(texts):
                    sizes.append(len(grams))
                    keys.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                    sketches.append(sketch_of(grams, coordinates).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["id", "row_key", "set_key", "size", "sketch"],
            )

    fields = [("id", id_type), ("row_key", T.BinaryType()), ("set_key", T.BinaryType()), ("size", T.LongType()), ("sketch", T.BinaryType())]
    rows = staged(source.mapInArrow(sketched, T.StructType([T.StructField(*f) for f in fields])), "rows")
    # nulls last, so that a missing id represents its set only where there is no other
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("first")
    sets = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(first, F.count("*").alias("copies"), F.min("sketch").alias("sketch"))
    sets = staged(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    runs = math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, sampling, depth)))
    related = _related(sets.select("node", "sketch"), runs, threshold, depth, sampling, bucket, leaders)
    groups = staged(components(related), "groups")
    links = _verified(source, sets, groups, n, threshold, block)
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("linked").alias("linked"))

    # only sets with copies or links need a class; all other rows are their own
    found = sets.join(roots, "node", "left").join(counts, "node", "left").filter("copies > 1 OR root IS NOT NULL")
    found = staged(found.select("set_key", "first", "copies", "linked", F.coalesce("root", "node").alias("root")), "found")
    heads = found.groupBy("root").agg(F.min("first").alias("head"))
    found = found.join(heads, "root").select(
        "set_key", "head", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    return rows.select("id", "row_key", "set_key").join(found, "set_key", "left").select(
        F.col("id").alias(id_column),
        "row_key",
        F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("head").isNull() | (F.col("row_key") == F.col("head.row_key"))).alias("kept"),
    )


def _related(sets: DataFrame, runs: int, threshold: float, depth: int, sampling: float, bucket: int, leaders: int) -> DataFrame:
    """Links (a, b) between nodes that met in a bucket and may be similar; linear in the members of buckets."""

    def expand(first: bool):
        def run(batches):
            starts = mixed(np.arange(1, runs + 1, dtype=np.uint64) * GOLDEN)
            for batch in batches:
                nodes = batch.column("node").to_numpy()
                if not len(nodes):
                    continue
                sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(nodes), -1)
                given = [np.full(len(nodes), s) for s in starts] if first else [batch.column("path").to_numpy().view(np.uint64)]
                for paths in given:
                    for a in range(0, len(nodes), 4096):
                        row, child = chosen_children(paths[a : a + 4096], sketches[a : a + 4096], sampling)
                        yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(nodes[a + row])], names=["path", "node"])

        return run

    compared, members = None, sets.mapInArrow(expand(True), "path long, node long")
    for level in range(1, depth + 1):
        if level > 1:
            # few rows: the members of large buckets, a row for each path they are on
            members = large.join(sets, "node").select("path", "node", "sketch").mapInArrow(expand(False), "path long, node long")
        sizes = members.groupBy("path").agg(F.count("*").alias("members"), F.min("node").alias("root")).filter("members > 1")
        members = staged(members.join(sizes, "path"), "members")
        small = members.filter(F.col("members") <= bucket)
        large = members.filter(F.col("members") > bucket)
        last = level == depth or large.isEmpty()
        # a bucket of two or more is compared by sketch: at most ``bucket`` rows of a path meet in a task
        met = small.select("path", "node").join(sets, "node").repartition("path").sortWithinPartitions("path", "node")
        edges = met.mapInArrow(_bucket_links(threshold), "a long, b long")
        if last:
            edges = edges.union(large.select(F.col("node").alias("a"), F.col("root").alias("b")))
        else:
            judged = _judged(large.select("path", "node"), sets, leaders, threshold)
            done = staged(_one_group(judged), "done")
            edges = edges.union(judged.join(done, "path", "left_semi").select(F.col("node").alias("a"), F.explode("roots").alias("b")))
            large = judged.join(done, "path", "left_anti").select("path", "node")
        edges = staged(edges.distinct(), "related")
        compared = edges if compared is None else compared.union(edges)
        if last:
            return compared


#: Members are related to a leader from this much less than the least agreement of two sets to be compared.
LOWER = 0.1


def _judged(members: DataFrame, sets: DataFrame, leaders: int, threshold: float) -> DataFrame:
    """Members of large buckets with the ``roots`` they are related to, and whether they are ``leading`` themselves: a first
    round of leaders from all members, a second from those related to none."""
    first = staged(_led(members, members, sets, leaders, threshold), "led")
    alone = first.filter("size(roots) = 0 AND NOT leading").select("path", "node")
    again = _led(members.join(alone.select("path").distinct(), "path", "left_semi"), alone, sets, leaders, threshold)
    return staged(
        first.union(again).groupBy("path", "node").agg(
            F.flatten(F.collect_list("roots")).alias("roots"), F.max("leading").alias("leading")
        ),
        "led",
    )


def _one_group(judged: DataFrame) -> DataFrame:
    """The paths of buckets where all members that do not lead are related to leaders, and these hang together through
    members they share. They are one group, and the leaders were compared with every member, so no pair of the bucket is
    left to find."""
    # per path at most the square of its leaders, whatever its members
    led = judged.filter("NOT leading").select("path", F.size("roots").alias("size"), F.get("roots", F.lit(0)).alias("a"), F.explode_outer("roots").alias("b"))
    led = led.groupBy("path").agg(F.min("size").alias("least"), F.collect_set(F.struct("a", "b")).alias("held")).filter("least > 0")

    def run(batches):
        for batch in batches:
            one = []
            for held in batch.column("held").to_pylist():
                ids, places = np.unique([[pair["a"], pair["b"]] for pair in held], return_inverse=True)
                left, right = places.reshape(-1, 2).T
                one.append(not local_roots(len(ids), left, right).any())
            yield pa.RecordBatch.from_arrays([batch.column("path").filter(pa.array(one, pa.bool_()))], names=["path"])

    return led.select("path", "held").mapInArrow(run, "path long")


def _led(members: DataFrame, choices: DataFrame, sets: DataFrame, leaders: int, threshold: float) -> DataFrame:
    """Members with the leaders that they are related to (of leaders related to one another the first), and whether they
    lead. The leaders of a path are those of ``choices`` with the smallest hashes."""
    order = Window.partitionBy("path").orderBy(F.xxhash64("path", "node"), "node")
    chosen = choices.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= leaders)
    chosen = chosen.join(sets.select("node", "sketch"), "node").groupBy("path").agg(
        F.collect_list(F.struct("node", "sketch")).alias("led")
    )
    rows = members.join(sets.select("node", "sketch"), "node").join(chosen, "path")

    def run(batches):
        for batch in batches:
            paths, nodes = (batch.column(c).to_numpy() for c in ("path", "node"))
            own = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(len(nodes), -1)
            links, leading = [[] for _ in nodes], np.zeros(len(nodes), bool)
            for path in np.unique(paths):
                here = np.flatnonzero(paths == path)
                led = batch.column("led")[int(here[0])].as_py()
                ids = np.array([x["node"] for x in led])
                theirs = np.frombuffer(b"".join(x["sketch"] for x in led), np.uint32).reshape(len(ids), -1)
                coordinates = theirs.shape[1]
                least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / coordinates) - LOWER
                bar = max(least * coordinates, 1)
                # leaders that are related are one: a link to the first of them is enough
                left, right = np.nonzero(np.triu(np.array([(theirs == t).sum(axis=1) for t in theirs]) >= bar, 1))
                roots = local_roots(len(ids), left, right)
                agree = np.array([(own[here] == t).sum(axis=1) for t in theirs])
                leading[here] = np.isin(nodes[here], ids)
                for r in np.unique(roots):
                    for i in here[(agree[roots == r] >= bar).any(axis=0) & (nodes[here] != ids[r])]:
                        links[i].append(int(ids[r]))
            columns = [batch.column("path"), batch.column("node"), pa.array(links, pa.list_(pa.int64())), pa.array(leading)]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "node", "roots", "leading"])

    kinds = "path long, node long, roots array<long>, leading boolean"
    return rows.select("path", "node", "sketch", "led").mapInArrow(run, kinds)


def grouped(batches, keys: list[str]):
    """Runs of equal keys of a partition that is sorted by them, as tables."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                yield current, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            current = key
    if held:
        yield current, pa.Table.from_batches(held)


def sketch_roots(sketches: np.ndarray, bar: float) -> np.ndarray:
    """Per sketch the first one that it hangs together with through pairs which agree at ``bar`` coordinates or more. Each
    is compared with those that no group holds yet, so memory follows the number of sketches and not of their pairs."""
    roots = np.arange(len(sketches))
    rest, left = np.arange(len(sketches)), sketches
    while len(rest) > 1:
        root, todo = rest[0], [left[0]]
        rest, left = rest[1:], left[1:]
        while todo and len(rest):
            alike = (left == todo.pop()).sum(axis=1, dtype=np.uint16) >= bar
            if alike.any():
                roots[rest[alike]] = root
                todo.extend(left[alike])
                rest, left = rest[~alike], left[~alike]
    return roots


def _bucket_links(threshold: float):
    def run(batches):
        out_a, out_b = [], []
        for _, table in grouped(batches, ["path"]):
            nodes = table.column("node").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(len(nodes), -1)
            coordinates = sketches.shape[1]
            # four standard errors below the threshold
            least = threshold - 4 * math.sqrt(threshold * (1 - threshold) / coordinates)
            roots = sketch_roots(sketches, least * coordinates)
            moved = np.flatnonzero(roots != np.arange(len(nodes)))
            if len(moved):
                out_a.append(nodes[moved])
                out_b.append(nodes[roots[moved]])
            if len(out_a) >= 1000:
                yield _edges(out_a, out_b)
                out_a, out_b = [], []
        if out_a:
            yield _edges(out_a, out_b)

    return run


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _verified(source: DataFrame, sets: DataFrame, groups: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Per node and compared block: ``root`` (smallest node linked with it there) and ``linked`` (rows linked with it).

    The text of one row per set is fetched by its key. A group of up to ``block`` sets is one comparison; a larger one is
    dealt into blocks, and each pair of blocks is a comparison of its own, with a key of its own."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / block).cast("int")
    wanted = groups.join(sizes, "root").join(sets.select("node", "copies", "first.row_key"), "node")
    wanted = wanted.select("node", "copies", "row_key", F.col("root").alias("group"), parts.alias("parts"))
    texts = source.select("row_key", "text").join(wanted, "row_key").drop("row_key").dropDuplicates(["node"])

    def shingled(batches):
        words = shingler(n)
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text"), SLICE_WORDS):
                grams = [g.tobytes() for g in words.sets(texts)]
                kept = batch.slice(a, b - a).select(["node", "copies", "group", "parts"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(grams, pa.binary())], names=[*kept.schema.names, "grams"])

    sized = texts.mapInArrow(shingled, "node long, copies long, group long, parts int, grams binary")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sized.withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    keys = ["group", "low", "high"]
    dealt = dealt.select(*keys, "own", "node", "copies", "grams").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches):
        for (_, low, high), table in grouped(batches, keys):
            nodes, copies, side = (table.column(c).to_numpy() for c in ("node", "copies", "own"))
            grams = [np.frombuffer(g, np.uint64) for g in table.column("grams").to_pylist()]
            left, right, linked = exact_links(grams, copies, np.flatnonzero(side == low), np.flatnonzero(side == high), low == high, threshold)
            if len(left):
                roots = local_roots(len(nodes), left, right)
                touched = np.flatnonzero(linked > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[touched]), pa.array(nodes[roots[touched]]), pa.array(linked[touched])], names=["node", "root", "linked"]
                )

    return staged(dealt.mapInArrow(compare, "node long, root long, linked long"), "exact")


def exact_links(grams, copies, one, two, same: bool, threshold: float, columns: int = 4096):
    """Exact Jaccard of rows ``one`` against rows ``two`` by products of 0/1 blocks of their common n-grams: linked pairs
    (a spanning choice of them suffices for roots, so all are given) and the rows linked with each row."""
    sizes = np.array([len(g) for g in grams])
    owner = np.repeat(np.arange(len(grams)), sizes)
    values, place, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    common = counts > 1
    number = np.cumsum(common) - 1
    use = common[place]
    owner, place = owner[use], number[place[use]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(one), len(two)), np.float32)
    total = int(common.sum())
    edges = np.searchsorted(place, np.arange(0, total + columns, columns))
    for k in range(len(edges) - 1):
        a, b = edges[k], edges[k + 1]
        block = np.zeros((len(grams), min(columns, total - k * columns)), np.float32)
        block[owner[a:b], place[a:b] - k * columns] = 1
        shared += block[one] @ block[two].T
    both = sizes[one][:, None] + sizes[two][None] - shared
    similar = shared >= threshold * both - 1e-6
    if same:
        similar &= one[:, None] != two[None]
    i, j = np.nonzero(similar)
    linked = np.zeros(len(grams), np.int64)
    np.add.at(linked, one[i], copies[two[j]])
    if not same:
        np.add.at(linked, two[j], copies[one[i]])
    return one[i], two[j], linked
