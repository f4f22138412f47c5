"""Prefix trie of rebuilt conversations, from composable fingerprints of turn sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Fingerprints are polynomials of turn hashes modulo a prime; a fixed value, as is their base.
PRIME = 2**127 - 1
BASE = int.from_bytes(hashlib.sha256(b"turns").digest()) % PRIME
#: Turns in a row of the stored table, depths in a block of prefix sums, ids in a chunk of a digest's input.
SEGMENT, BLOCK, CHUNK = 256, 1024, 4096
KEY = ["depth", "hi", "lo"]


def combined(left: int, right: int, length: int) -> int:
    """The fingerprint of a sequence followed by another of this length: the monoid's product."""
    return (left * pow(BASE, length, PRIME) + right) % PRIME


def turn_code(digest: bytes) -> int:
    return int.from_bytes(digest[:16], "little") % PRIME


def as_bytes(value: int) -> bytes:
    return value.to_bytes(16, "little")


def as_int(value: bytes) -> int:
    return int.from_bytes(value, "little")


def hundred_base(conv: Column) -> Column:
    """The first conversation of a hundred."""
    return conv - conv % 100


def hashed_head(conv: Column) -> Column:
    """Up to five turns."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def prefix_trie(
    turns: DataFrame,
    base: Callable[[Column], Column] = hundred_base,
    head: Callable[[Column], Column] = hashed_head,
    longest_head: int = 5,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    A conversation c is ordered by turn (null first, ties by the SHA-256 of role and text) and rebuilt: the first
    ``head(c)`` turns (at most ``longest_head``) of conversation ``base(c)``, all if it has fewer, none if it is absent,
    then c's own turns after its first ``head(c)``. Every distinct sequence of first turns is a node; its members are the
    conversations that start with it. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (that of the
    node above, null for the root), ``n_convs`` (members), ``n_children``, ``n_leaves`` (childless nodes in its subtree,
    itself included), ``saved_tokens`` (over its subtree, members beyond the first times the code points of the last
    text) and ``ends_sha256`` (of the comma-joined ascending ids of members that end there).

    Nothing is rebuilt as text. A turn is a 256-bit digest: half of it is the hash in fingerprints, half is kept beside
    every node to verify that all members of a group end in the same turn; as their parents agree too, the sequences are
    equal. A group that fails this fails the job. Prefixes of conversations are products: base head times own suffix.

    Subtree sums need no walk of the tree. A node belongs to its smallest member, so what a node sums over its subtree is
    what each of its members owns below it: members' totals are added per node, less what its own smallest member owns
    above it. Conversations of any length are cut into segments over the tasks of a range partitioning; fingerprints
    before a segment are composed from those of the tasks before. Depth costs no rounds.

    Null roles and texts are empty; rows without a conversation id are in no conversation; equal rows are turns of their
    own. An empty table gives no rows. Other columns are not read."""
    conv = F.col(conv_column).cast("long")
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_column, text_column))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digests = turns.filter(F.col(conv_column).isNotNull()).select(
        conv.alias("conv_id"),
        F.col(turn_column).alias("turn"),
        F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = digests.repartitionByRange(*order).sortWithinPartitions(*order)
    segments = staged(ranged.mapInArrow(_segments(longest_head), SEGMENTS), "segments")

    runs = F.sort_array(F.collect_list(F.struct("part", "run", "value", "first_digests", "first_chars")))
    whole = segments.filter("last").groupBy("conv_id").agg(runs.alias("runs"))  # an entry for each task it lies in
    asked = whole.select("conv_id", "runs", base(F.col("conv_id")).alias("base"), head(F.col("conv_id")).cast("int").alias("head"))
    bases = whole.select(F.col("conv_id").alias("base"), F.col("runs").alias("base_runs"))
    convs = staged(asked.join(bases, "base", "left").drop("base").mapInArrow(_rebuilt(longest_head), CONVS), "rebuilt")

    places = convs.select("conv_id", "length", "head", "kept", "shift", F.inline("places"))
    own = segments.drop("last", "run", "value", "first_digests", "first_chars").join(places, ["conv_id", "part"])
    spans = convs.select("conv_id", F.lit(0).cast("long").alias("first"), "length", "nodes").unionByName(own.mapInArrow(_suffixes, SPANS))
    spans = staged(spans, "spans")
    return _summed(convs, spans)


SEGMENTS = (
    "conv_id long, part int, at long, before binary, n long, digests binary, chars binary, last boolean, "
    "run long, value binary, first_digests binary, first_chars binary"
)
NODES = "array<struct<hi: long, lo: long, up_hi: long, up_lo: long, check_a: long, check_b: long, chars: long>>"
SPANS = f"conv_id long, first long, length long, nodes {NODES}"
CONVS = (
    "conv_id long, length long, end_hi long, end_lo long, head int, kept int, shift binary, "
    f"places array<struct<part: int, start: long, run_before: binary>>, nodes {NODES}"
)


def _segments(longest_head: int):
    """Cuts the sorted turns of a task into rows of up to ``SEGMENT`` turns of one conversation. Its last row in the task
    has the task's turns of it (``run``), their fingerprint and the first few of them."""

    def run(batches):
        part = TaskContext.get().partitionId()
        rows: list[dict] = []
        current, at, value, before = None, 0, 0, 0
        digests, chars, first = [], [], ([], [])

        def close(last: bool) -> None:
            nonlocal digests, chars, before
            tail = (at, as_bytes(value), b"".join(first[0]), np.array(first[1], np.int64).tobytes()) if last else (None,) * 4
            given = (current, part, at - len(digests), as_bytes(before), len(digests), b"".join(digests), np.array(chars, np.int64).tobytes(), last)
            rows.append(dict(zip(names, given + tail)))
            digests, chars, before = [], [], value

        for batch in batches:
            for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars"))):
                if conv != current:
                    if digests:
                        close(True)
                    current, at, value, before, first = conv, 0, 0, 0, ([], [])
                elif len(digests) == SEGMENT:
                    close(False)
                at, value = at + 1, (value * BASE + turn_code(digest)) % PRIME
                digests.append(digest)
                chars.append(size)
                if at <= longest_head:
                    first[0].append(digest)
                    first[1].append(size)
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if digests:
            close(True)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in SEGMENTS.split(", "))])
    names = schema.names
    return run


class Composed:
    """A conversation from its runs in the tasks: length, fingerprint, where each run starts and its first turns."""

    def __init__(self, runs: list[dict], longest_head: int):
        self.length, self.value, self.places, digests, chars = 0, 0, [], [], []
        for run in runs:
            self.places.append({"part": run["part"], "start": self.length, "run_before": as_bytes(self.value)})
            self.value = combined(self.value, as_int(run["value"]), run["run"])
            self.length += run["run"]
            own = run["first_digests"]
            digests += [own[i : i + 32] for i in range(0, len(own), 32)]
            chars += np.frombuffer(run["first_chars"], np.int64).tolist()
        # first turns of a later run are among the conversation's first only if the runs before are short, and so whole
        self.first = list(zip(digests, chars))[: min(longest_head, self.length)]

    def head(self, n: int) -> list[tuple[int, bytes, int]]:
        """Fingerprint after each of the first n turns, with the turn."""
        out, value = [], 0
        for digest, size in self.first[:n]:
            value = (value * BASE + turn_code(digest)) % PRIME
            out.append((value, digest, size))
        return out


def _rows_of_nodes(batches: list[list[tuple[int, int, bytes, int]]]) -> pa.Array:
    """Lists of nodes from (fingerprint, that of the node above, digest, characters)."""
    flat = [node for nodes in batches for node in nodes]
    ints = [np.frombuffer(b"".join(as_bytes(node[k]) for node in flat), np.int64).reshape(-1, 2) for k in (0, 1)]
    checks = np.frombuffer(b"".join(node[2][16:] for node in flat), np.int64).reshape(-1, 2)
    chars = np.array([node[3] for node in flat], np.int64)
    columns = [ints[0][:, 1], ints[0][:, 0], ints[1][:, 1], ints[1][:, 0], checks[:, 0], checks[:, 1], chars]
    names = ["hi", "lo", "up_hi", "up_lo", "check_a", "check_b", "chars"]
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)
    offsets = np.cumsum([0, *map(len, batches)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _rebuilt(longest_head: int):
    """Per conversation its rebuilt length and fingerprint, the nodes of its head (from the root) and ``shift``: what
    swapping its own first turns for the base's head adds to fingerprints, before it is moved on by later turns."""

    def run(batches):
        for batch in batches:
            out, nodes = [], []
            for row in batch.to_pylist():
                own, h = Composed(row["runs"], longest_head), max(0, min(row["head"] or 0, longest_head))
                given = Composed(row["base_runs"] or [], longest_head).head(h)
                gone = own.head(h)
                start, cut = given[-1][0] if given else 0, gone[-1][0] if gone else 0
                shift, suffix = (start - cut) % PRIME, max(0, own.length - h)
                end = (own.value + shift * pow(BASE, suffix, PRIME)) % PRIME if suffix else start
                above = [0, *(value for value, _, _ in given)]
                nodes.append([(0, 0, bytes(32), 0), *((v, up, d, n) for up, (v, d, n) in zip(above, given))])
                low, high = np.frombuffer(as_bytes(end), np.int64).tolist()
                out.append((row["conv_id"], len(given) + suffix, high, low, h, len(given), as_bytes(shift), own.places))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                kinds.append(pa.list_(pa.struct([("part", pa.int32()), ("start", pa.int64()), ("run_before", pa.binary())])))
                columns = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds)]
                names = ["conv_id", "length", "end_hi", "end_lo", "head", "kept", "shift", "places", "nodes"]
                yield pa.RecordBatch.from_arrays([*columns, _rows_of_nodes(nodes)], names=names)

    return run


def _suffixes(batches):
    """The nodes of a segment's turns after the head, each a product of the rebuilt prefix and the turn."""
    for batch in batches:
        out, nodes = [], []
        for row in batch.to_pylist():
            at = row["start"] + row["at"]  # own turns before the segment
            skipped = max(0, row["head"] - at)
            if skipped >= row["n"]:
                continue
            value = combined(as_int(row["run_before"]), as_int(row["before"]), row["at"])
            for i in range(skipped):
                value = (value * BASE + turn_code(row["digests"][32 * i : 32 * i + 32])) % PRIME
            value = (value + as_int(row["shift"]) * pow(BASE, at + skipped - row["head"], PRIME)) % PRIME
            chars, own = np.frombuffer(row["chars"], np.int64).tolist(), []
            for i in range(skipped, row["n"]):
                digest = row["digests"][32 * i : 32 * i + 32]
                above, value = value, (value * BASE + turn_code(digest)) % PRIME
                own.append((value, above, digest, chars[i]))
            out.append((row["conv_id"], row["kept"] + at + skipped - row["head"] + 1, row["length"]))
            nodes.append(own)
        if out:
            columns = [pa.array(column, pa.int64()) for column in zip(*out)]
            yield pa.RecordBatch.from_arrays([*columns, _rows_of_nodes(nodes)], names=["conv_id", "first", "length", "nodes"])


def _exploded(spans: DataFrame, *more: str) -> DataFrame:
    rows = spans.select("conv_id", "length", "first", *more, F.posexplode("nodes").alias("place", "node"))
    return rows.select("conv_id", "length", *more, (F.col("first") + F.col("place")).alias("depth"), "node.*")


def _summed(convs: DataFrame, spans: DataFrame) -> DataFrame:
    differs = F.lit(False)
    for column in ("check_a", "check_b", "up_hi", "up_lo"):
        differs |= F.min(column) != F.max(column)
    ends = F.sum((F.col("depth") == F.col("length")).cast("long"))
    nodes = _exploded(spans).groupBy(*KEY).agg(
        F.count("*").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        ends.alias("n_ends"),
        F.max("up_hi").alias("up_hi"),
        F.max("up_lo").alias("up_lo"),
        F.when(differs, F.raise_error(F.lit("turn sequences of one fingerprint differ"))).otherwise(F.max("chars")).cast("long").alias("chars"),
    )
    nodes = staged(nodes.withColumn("saves", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    # per conversation, over the nodes it is the smallest member of: all below its first such node
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.coalesce(F.min(F.when(F.col("n_convs") == 1, F.col("depth"))), F.lit(2**62)).alias("alone"),
        F.sum("saves").alias("owned"),
        F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf"),
    )
    owners = staged(owners, "owners")
    labelled = staged(nodes.join(owners.select("conv_id", "top", "alone"), "conv_id"), "labelled")
    shared = labelled.filter("n_convs > 1")

    # what every node's members own at it or below, were they all its smallest
    giving = owners.filter("owned > 0 OR leaf > 0").select("conv_id", "alone", "owned", "leaf")
    within = _exploded(spans.join(giving, "conv_id").filter("first < alone"), "alone", "owned", "leaf").filter("depth < alone")
    sums = within.groupBy(*KEY).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"))

    # less what its smallest member owns above it: prefix sums along the member, block by block
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    blocks = shared.groupBy("conv_id", block).agg(F.sum("saves").alias("sum"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.sum("sum").over(before).alias("earlier"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = shared.select("conv_id", *KEY, block, "saves").withColumn("nearer", F.sum("saves").over(inside))
    above = above.join(blocks, ["conv_id", "block"], "left")
    above = above.select(*KEY, (F.coalesce("nearer", F.lit(0)) + F.coalesce("earlier", F.lit(0))).alias("above"))

    # children of shared nodes, with a salt that parts those of a node with very many
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")]
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(64)).alias("salt")
    below = labelled.filter("depth > 0 AND depth <= alone").select(*up, salt)
    pairs = below.groupBy(*KEY, "salt").agg(F.count("*").alias("children"))
    children = pairs.groupBy(*KEY).agg(F.sum("children").alias("n_children"))
    tops = labelled.filter("depth > 0 AND depth = top")
    asked = tops.select(*up, salt).distinct().join(shared.select(*KEY, F.col("conv_id").alias("parent")), KEY)
    own = [F.col(c).alias(f"own_{c}") for c in KEY]
    parents = tops.select(*up, salt, *own).join(asked, [*KEY, "salt"]).select(*(F.col(f"own_{c}").alias(c) for c in KEY), "parent")

    out = labelled
    for part in (sums, above, children, parents, _end_digests(convs)):
        out = out.join(part, KEY, "left")
    alone = F.col("n_convs") == 1
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.coalesce("n_children", F.lit(0))).cast("long").alias("n_children"),
        F.when(alone, F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("owned", F.lit(0)) - F.coalesce("above", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _end_digests(convs: DataFrame) -> DataFrame:
    """Per node the digest of its ended members' ids. Ids are sorted over all tasks and joined to chunks there; the chunks
    of a node are then hashed one after another, so a node where very many end takes the memory of one chunk."""
    ended = convs.select(F.col("length").alias("depth"), F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id")
    ranged = ended.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def chunks(batches):
        part, k = TaskContext.get().partitionId(), 0
        current, ids = None, []

        def row():
            columns = [*([pa.array([x], pa.int64()) for x in current]), pa.array([part], pa.int32()), pa.array([k], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([",".join(map(str, ids))])], names=[*KEY, "part", "k", "ids"])

        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
                if ids and (key != current or len(ids) == CHUNK):
                    yield row()
                    k, ids = k + 1, []
                current = key
                ids.append(conv)
        if ids:
            yield row()

    joined = ranged.mapInArrow(chunks, "depth long, hi long, lo long, part int, k long, ids string")
    dealt = joined.repartition(*KEY).sortWithinPartitions(*KEY, "part", "k")

    def digests(batches):
        current, state, out = None, None, []
        for batch in batches:
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == current:
                    state.update(b",")
                else:
                    if current is not None:
                        out.append((*current, state.hexdigest()))
                    current, state = key, hashlib.sha256()
                state.update(ids.encode())
            if len(out) >= 4096:
                yield table(out)
                out = []
        if current is not None:
            yield table([*out, (*current, state.hexdigest())])

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=[*KEY, "ends"])

    return dealt.mapInArrow(digests, "depth long, hi long, lo long, ends string")
