"""N-gram Jaccard join: a grouped prefix join over word shingles, and the groups that its links make.

Texts with equal shingle sets are one class.  Shingles have one order for the
whole corpus: those of several documents come last, by how many, the rest by hash.
Two sets of Jaccard similarity t or more share a shingle among the first
n - ceil(t n) + 1 of either set, its prefix.  Classes of one size and one prefix
are collapsed into a group; groups that share a prefix shingle, and whose sizes
and places allow the overlap, are candidate pairs; these are expanded into their
members and verified on the whole sets.

Components need no more links than connect them, so the join has rounds.  The
first ones verify each group against one hub, the group of a bucket that shares
most of its prefix with others, and the members of a group against the first;
they join large groups of near copies in linear work.  The last one takes all
candidate pairs that these left in different components, so no link between two components is lost; bitmaps of the
sets, a thirtieth of their size, rule out most of these before the sets travel.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statweave.llm.common import highest, sized, small_batches, text_hashes, text_key, text_of, written
from statweave.llm.components import components
from statweave.llm.shingles import shingle_hashes

SIMILARITY = Fraction(3, 4)
# A shingle in more documents than this goes to the end of the order.  Any order gives the same links.
COMMON = 8
# The list of common shingles that tasks hold; the rarer ones beyond it stay in the order of their hashes.
COMMON_SLOTS = 1 << 22
# Rounds in which groups meet one hub each, before all pairs that are left between components; the rounds after the first
# only while these would be more than so many for each row of the buckets.  The links connect the same texts either way.
HUB_ROUNDS = 2
FEW_PAIRS = 10
# Pairs of one class that are verified in one group; a class with more has several groups.
GROUP_PAIRS = 500
FLUSH = 4_000_000


def _class_id(shingles: np.ndarray) -> int:
    """64 bits that stand for a set; two different sets share them with a chance of 2^-64."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, [shingle_hashes(t.as_py()) for t in batch.column("text")]


def classes(documents: DataFrame) -> DataFrame:
    """Each row's doc_id, text keys, set size and class; the class is null for an empty set."""
    small_batches(documents.sparkSession)
    rows = documents.select("doc_id", *text_key(text_of()), F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch, sets in _sets(batches):
            out = batch.select(["doc_id", "_k1", "_k2"])
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*out.columns, n, pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "_k1", "_k2", "n", "cls"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, n long, cls long")


def common_slots(texts: DataFrame, total: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Slots of shingles that stand in over COMMON documents, counted over all documents, and how often in powers of two.

    A slot is the top bytes of the hash, as many as keep other shingles out of
    it.  Tasks send sorted slots in blocks by range; a block is counted at once.
    """
    width = max(3, math.ceil((math.log2(max(total, 2)) + 1) / 8))
    blocks = max(1, total // FLUSH + 1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = np.uint32 if width <= 4 else np.uint64
    shift = np.uint64(64 - 8 * width)

    def send(batches):
        held, seen, rows = [], set(), 0

        def flush():
            slots = np.sort(np.concatenate(held))
            edges = np.searchsorted(slots, (np.arange(1, blocks) * (1 << 8 * width) // blocks).astype(kind))
            for block, part in enumerate(np.split(slots, edges)):
                if len(part):
                    packed = np.ascontiguousarray(part.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
                    yield block, packed

        def batch_of(found):
            blocks_, data = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int32()), pa.array(data, pa.binary())], ["block", "slots"])

        for _, sets in _sets(batches):
            for s in sets:
                if len(s) and (c := _class_id(s)) not in seen:
                    seen.add(c)
                    held.append((s >> shift).astype(kind))
                    rows += len(s)
            if rows > FLUSH:
                yield batch_of(flush())
                held, rows = [], 0
        if held:
            yield batch_of(flush())

    def count(group: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(group["slots"]), dtype=np.uint8).reshape(-1, width)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :width] = raw
        slots, n = np.unique(wide.view("<u8").ravel(), return_counts=True)
        keep = n > COMMON
        return pd.DataFrame({"slot": slots[keep].astype(np.int64), "n": n[keep].astype(np.int64)})

    found = texts.mapInArrow(send, "block int, slots binary").groupBy("block").applyInPandas(count, "slot long, n long")
    graded = written(found.select("slot", F.floor(F.log2("n")).cast("int").alias("level")))
    sizes = {r["level"]: r["count"] for r in graded.groupBy("level").count().collect()}
    top = graded.where(F.col("level") >= highest(sizes, COMMON_SLOTS)).toArrow()
    slots, levels = top.column("slot").to_numpy().astype(np.uint64), top.column("level").to_numpy().astype(np.int8)
    order = np.argsort(slots)
    return width, slots[order], levels[order]


def prefix_length(n: int) -> int:
    return n - math.ceil(SIMILARITY * n) + 1


def prefixes(texts: DataFrame, width: int, common) -> DataFrame:
    """(key, id, n, place): the prefix shingles of each group with its id, and, in place -1, each group's classes; rows may repeat."""
    shift = np.uint64(64 - 8 * width)
    kinds = [("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("place", pa.int32())]

    def run(batches):
        (last, often), seen, groups = common.value, set(), set()
        for _, sets in _sets(batches):
            keys, ids, sizes, places = [], [], [], []
            for s in sets:
                if not len(s) or (c := _class_id(s)) in seen:
                    continue
                seen.add(c)
                n = len(s)
                if len(last):
                    slots = s >> shift
                    at = np.minimum(np.searchsorted(last, slots), len(last) - 1)
                    late = last[at] == slots
                    s = s[np.argsort(np.where(late, often[at], -1), kind="stable")]
                head = s[: prefix_length(n)]
                group = int.from_bytes(hashlib.blake2b(head.tobytes(), digest_size=8, salt=n.to_bytes(8, "little")).digest(), "little", signed=True)
                keys.append(np.array([group], dtype=np.int64)), ids.append((c, 1)), sizes.append(n), places.append(np.array([-1]))
                if group not in groups:
                    groups.add(group)
                    keys.append(head.view(np.int64)), ids.append((group, len(head))), sizes.append(n), places.append(np.arange(len(head)))
            if keys:
                id_, times = (np.array(x, dtype=np.int64) for x in zip(*ids, strict=True))
                columns = [np.concatenate(keys), np.repeat(id_, times), np.repeat(np.array(sizes), times), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds, strict=True)], [k for k, _ in kinds])

    return texts.mapInArrow(run, "key long, id long, n int, place int")


def _bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of the hashes, between two and four for each shingle."""
    size = 1 << max(6, (2 * len(shingles) - 1).bit_length())
    bits = np.zeros(size, dtype=bool)
    bits[(shingles & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def _could_link(p: bytes, q: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m with these bitmaps can be similar enough: a bit that only one of them has is a shingle that it alone has."""
    x, y = np.frombuffer(p, dtype=np.uint8), np.frombuffer(q, dtype=np.uint8)
    while len(x) != len(y):
        # A lower power of two keeps the low bits: the halves fall together.
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    only = int(np.unpackbits(x ^ y).sum())
    # Each bit of one alone costs a shingle: shared <= (n + m - only) / 2.
    shared = (n + m - only) // 2
    return 100 * shared >= 75 * (n + m - shared)


def _are_linked(p: bytes, q: bytes, n: int, m: int) -> bool:
    x, y = np.frombuffer(p, dtype=np.uint64), np.frombuffer(q, dtype=np.uint64)
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return 100 * shared >= 75 * (n + m - shared)


def verified(pairs: DataFrame, rows: DataFrame, documents: DataFrame) -> DataFrame:
    """The written pairs of classes (a, b) whose whole sets are similar enough: those whose bitmaps allow it are compared whole."""
    return _checked(_checked(pairs, rows, documents, True), rows, documents, False)


def _checked(pairs: DataFrame, rows: DataFrame, documents: DataFrame, bitmaps: bool) -> DataFrame:
    """The pairs that pass the test on whole sets, or on their bitmaps.

    Of each class one text is read again.  Its set goes to the groups of its
    pairs: those of one class a, GROUP_PAIRS at a time.
    """
    if pairs.isEmpty():
        return pairs
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP_PAIRS).alias("_parts"))
    dealt = written(pairs.join(degree, "a").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), "_parts")).alias("grp")))
    wanted = dealt.select(F.col("b").alias("cls"), "grp", "a").union(dealt.select(F.col("a").alias("cls"), "grp", "a").distinct())
    per_class = wanted.groupBy("cls").agg(F.collect_list(F.struct("grp", "a")).alias("_to"))
    text = rows.join(per_class, "cls").groupBy("cls").agg(F.min(F.struct("_k1", "_k2")).alias("_k"), F.first("_to").alias("_to"))
    asked = sized(written(text.select("_k._k1", "_k._k2", "_to")))
    found = documents.select(*text_key(text_of()), F.col("text").cast("string").alias("text")).join(asked, ["_k1", "_k2"]).select("text", "_to")

    def send(batches):
        seen = set()
        for batch, sets in _sets(batches):
            out = []
            for s, to in zip(sets, batch.column("_to").to_pylist(), strict=True):
                if (c := _class_id(s)) not in seen:
                    seen.add(c)
                    data = (_bitmap(s) if bitmaps else s).tobytes()
                    out += [(x["grp"], x["a"], c, len(s), data) for x in to]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.binary()], strict=True)], ["grp", "a", "cls", "n", "data"])

    def check(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        sets = dict(zip(group.column("cls").to_pylist(), zip(group.column("data").to_pylist(), group.column("n").to_pylist(), strict=True), strict=True))
        (p, n), test = sets.pop(a), _could_link if bitmaps else _are_linked
        near = [b for b, (q, m) in sets.items() if test(p, q, n, m)]
        return pa.table({"a": pa.array([a] * len(near), pa.int64()), "b": pa.array(near, pa.int64())})

    sent = found.mapInArrow(send, "grp long, a long, cls long, n long, data binary")
    return written(sent.groupBy("grp").applyInArrow(check, "a long, b long"))


def _marked(buckets: DataFrame, placed: DataFrame) -> DataFrame:
    """The buckets with the smallest and largest component of each group's classes."""
    return buckets.join(placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")), "grp")


def _placed(links_: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The components so far, and the members of the groups with theirs."""
    roots = written(components(links_))
    joined = members.join(sized(roots), F.col("cls") == F.col("node"), "left")
    return roots, written(joined.select("grp", "cls", F.coalesce("root", "cls").alias("root")))


def _pairs_per_row(marked: DataFrame) -> float:
    """How many pairs the buckets that hold several components would give, for each row of theirs."""
    sizes = marked.groupBy("key").agg(F.count("*").alias("c"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    pairs, rows = sizes.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2), F.sum("c")).first()
    return pairs / rows if rows else 0.0


def _hub_pairs(marked: DataFrame, lead: DataFrame, number: int) -> DataFrame:
    """One pair (hub, group) for each group that shares a bucket with a hub of another component.

    The hub of a bucket is its group of the largest share; of a group's hubs the
    best one is taken, another one in each round.
    """
    hub = marked.groupBy("key").agg(F.max(F.struct("share", F.xxhash64("grp", F.lit(number // 2)).alias("mix"), "grp", "n", "low")).alias("hub"))
    apart = (F.col("grp") != F.col("hub.grp")) & ((F.col("low") != F.col("high")) | (F.col("low") != F.col("hub.low")))
    fits = (4 * F.col("hub.n") >= 3 * F.col("n")) & (4 * F.col("n") >= 3 * F.col("hub.n"))
    best = F.max_by("hub.grp", F.struct("hub.share", F.xxhash64("key", F.lit(number))))
    chosen = marked.join(hub, "key").where(apart & fits).groupBy("grp").agg(best.alias("other"))
    pairs = chosen.join(lead, "grp").join(lead.select(F.col("grp").alias("other"), F.col("lead").alias("a")), "other")
    return pairs.select("a", F.col("lead").alias("b")).where("a <> b").distinct()


def links(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between classes that connect all that is similar, and the components (node, root) they make; ``rows`` are the written classes."""
    spark = documents.sparkSession
    small_batches(spark)
    texts = documents.select(F.col("text").cast("string").alias("text"))
    width, *common = common_slots(texts, rows.agg(F.sum("n")).first()[0] or 0)
    # One exchange by key serves for repeats and counts.  A bucket of one pairs nothing; classes lie in a bucket of their group.
    sent = prefixes(texts, width, spark.sparkContext.broadcast(tuple(common))).repartition("key").distinct()
    counted = sent.withColumn("_size", F.count("*").over(Window.partitionBy("key")))
    shared = written(counted.where("_size > 1 or place < 0").drop("_size"))
    members = shared.where("place < 0").select(F.col("key").alias("grp"), F.col("id").alias("cls"))
    lead = members.groupBy("grp").agg(F.min("cls").alias("lead"))
    buckets = shared.where("place >= 0").select("key", F.col("id").alias("grp"), "n", "place")

    # A group all of whose prefix others share is more likely an original than a copy with changes of its own.
    share = buckets.groupBy("grp").agg((F.count("*") / (F.first("n") - F.ceil(F.first("n") * 3 / 4) + 1)).alias("share"))
    buckets = written(buckets.join(share, "grp"))
    within = members.join(lead, "grp").where("cls <> lead").select(F.col("lead").alias("a"), F.col("cls").alias("b"))
    marked = _marked(buckets, members.withColumn("root", F.col("cls")))
    first = verified(written(within.union(_hub_pairs(marked, lead, 1)).distinct()), rows, documents)
    for number in range(2, HUB_ROUNDS + 1):
        roots, placed = _placed(first, members)
        marked = _marked(buckets, placed)
        if _pairs_per_row(marked) <= FEW_PAIRS:
            break
        near = verified(written(_hub_pairs(marked, lead, number)), rows, documents)
        if near.isEmpty():
            break
        first = first.union(near)
    else:
        roots, placed = _placed(first, members)
        marked = _marked(buckets, placed)

    # The last round: all candidate pairs that lie in different components.
    mixed = marked.groupBy("key").agg(F.min("low").alias("lowest"), F.max("high").alias("highest")).where("lowest <> highest").select("key")
    open_ = written(marked.join(mixed, "key"))
    x, y = (open_.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("grp", "n", "place", "low", "high")]) for s in "xy")
    # The overlap that is still possible after the first shared place, against the one that is needed.
    possible = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    fits = (F.col("n_x") <= F.col("n_y")) & (4 * F.col("n_x") >= 3 * F.col("n_y")) & (7 * possible >= 3 * (F.col("n_x") + F.col("n_y")))
    apart = (F.col("low_x") != F.col("high_x")) | (F.col("low_y") != F.col("high_y")) | (F.col("low_x") != F.col("low_y"))
    group_pairs = x.join(y, "key").where((F.col("grp_x") != F.col("grp_y")) & fits & apart).select("grp_x", "grp_y").distinct()
    own = placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("grp").alias("grp_x"), F.col("grp").alias("grp_y"))
    m, o = (placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("grp", "cls", "root")]) for s in "xy")
    expanded = group_pairs.union(own).join(m, "grp_x").join(o, "grp_y").where("root_x <> root_y")
    rest = written(expanded.select(F.least("cls_x", "cls_y").alias("a"), F.greatest("cls_x", "cls_y").alias("b")).distinct())
    second = verified(rest, rows, documents)
    found = first.union(second)
    return found, roots if second.isEmpty() else written(components(found))


def join(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, text keys, n_shingles, component_id.

    ``component_id`` is the smallest doc_id that the row reaches by links; a text
    without words is linked with nothing, not with another one.  Equal texts and
    repeated rows link when they have words.  Null ids are passed over as the
    smallest unless a component has no other.
    """
    rows = written(classes(documents))
    _, roots = links(documents, rows)
    rooted = rows.join(sized(roots), F.col("cls") == F.col("node"), "left").select("doc_id", "_k1", "_k2", "n", F.coalesce("root", "cls").alias("_root"))
    smallest = rooted.where("_root is not null").groupBy(F.col("_root").alias("_of")).agg(F.min("doc_id").alias("_least"))
    out = rooted.join(smallest, F.col("_root") == F.col("_of"), "left")
    return out.select("doc_id", "_k1", "_k2", F.col("n").alias("n_shingles"), F.when(F.col("_root").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("component_id"), "_root")


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, all columns as they are, with one row of each component: the one of the smallest id.

    Texts without words all stay.  Of rows that repeat an id and a text one stays.
    """
    found = written(join(documents).where("_root is not null"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k1", "_k2")
    kept = found.groupBy("_root").agg(F.min(order).alias("_first"))
    marked = found.join(kept, "_root").select(F.col("doc_id").alias("_id"), "_k1", "_k2", (order == F.col("_first")).alias("_kept"))
    gone = sized(written(marked.where(~F.col("_kept")).drop("_kept").distinct()))
    k1, k2 = text_hashes(text_of())
    same = documents["doc_id"].eqNullSafe(gone["_id"]) & (k1 == gone["_k1"]) & (k2 == gone["_k2"])
    out = documents.join(gone, same, "left_anti")
    repeated = written(marked.where("_kept").groupBy("_id", "_k1", "_k2").agg(F.count("*").alias("_rows")).where("_rows > 1").drop("_rows"))
    names = [f"`{c}`" for c in documents.columns]
    if repeated.isEmpty():
        return out.select(*names)
    again = documents["doc_id"].eqNullSafe(repeated["_id"]) & (k1 == repeated["_k1"]) & (k2 == repeated["_k2"])
    more = sized(repeated)
    several = out.join(more, again, "left_semi").select(*names)
    first = several.select(F.struct(*names).alias("_whole"), "doc_id", k1.alias("_k1"), k2.alias("_k2")).dropDuplicates(["doc_id", "_k1", "_k2"])
    return out.join(more, again, "left_anti").select(*names).unionByName(first.select("_whole.*"))
