"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

1. A scan turns each text into its set of distinct 5-word shingles (64-bit hashes), a 128-bit
   identity of the set, and a signature of ``SYMBOLS`` MinHash values. Documents with one set are one class; its name begins with
   its smallest doc_id, so that the smallest class of a component names the component.
2. Signatures are cut into ``CHUNKS`` chunks of ``CHUNK`` symbols. By the pigeonhole principle, two
   signatures that differ in at most 2 * CHUNKS - 1 symbols have a chunk with one error at most;
   its keys, each leaving one symbol out, enumerate the allowed error. All pairs within that
   distance therefore meet in a bucket: classes that share a key.
3. Within a bucket no pairs are listed. Each class is held against the smallest class that it
   meets in any bucket, then in some rounds against one class of each bucket whose component is still
   another. Linked groups have become one component by then, so a group of n near copies costs some n comparisons.
4. Classes whose buckets still hold several components are joined once more, on a prefix of their shingles, rarest
   first: sets of given sizes that are similar enough share one of so many of their rarest shingles. Templated pages whose similarity lies below the
   threshold differ in those, so they part before pairs are made. The shingles of one large component in a key are not paired with one another.
5. Pairs that set sizes and sketches (the least hash of each of ``RANGES`` ranges, in four bits) prove to be too different go no
   further: each range that differs holds a shingle of one side alone. This bound drops no link. Every other pair is confirmed on the
   full shingle sets, and components are found by contraction.

At the similarity of 0.75 a linked pair shares a bucket with probability 1 - 6e-6 or more (computed).

Defined results: a null text or one without words has an empty set and is linked with nothing; a
text of one to four words is one shingle; very long texts are read whole; ties and repeated rows fall in one class; a component's
id is its smallest non-null doc_id, and null where there is none; a row with null doc_id is kept
only if its whole component has none; an empty table gives an empty result; other columns are carried under numbers of our own, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .common import boxed, release, remove, row_key, saved, scan, table, unboxed
from .components import components

SHINGLE = 5
SIMILARITY = (75, 100)
CHUNKS, CHUNK = 12, 5
#: Rounds in which buckets are held against one of their classes before prefixes are joined.
ROUNDS = 2
SYMBOLS = CHUNKS * CHUNK
#: Ranges of hashes with four bits of the least hash in each; 0 is an empty range.
RANGES = 512
LANES = RANGES // 16
#: Bits of a signature's symbol; a chunk's symbols make one number.
BITS = 12
#: Sizes of sets in one band differ by this factor at most.
BAND = 1.03

_random = np.random.Generator(np.random.PCG64(7))
_XOR = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_MUL = _random.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) | np.uint64(1)

_FIELDS = [
    T.StructField("n_shingles", T.LongType()),
    T.StructField("node", T.BinaryType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("sig", T.ArrayType(T.LongType())),
]


def shingle_sets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles in order, and where each document's begin."""
    data = tk.LOWER[data]
    start, end, doc = tk.word_spans(data, at, tk.NOT_SPACE)
    word = tk.span_hash(data, start, end)
    windows = tk.window_hash(word, SHINGLE)
    inside = tk.windows_inside(doc, SHINGLE)
    docs = len(at) - 1
    n = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(n)])
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.array([tk.window_hash(word[first[k] : first[k + 1]], int(n[k]))[0] for k in short], np.uint64)
    hashes = np.concatenate([windows[inside], whole])
    of = np.concatenate([doc[: len(windows)][inside], short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=docs))]).astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each non-empty set, its 128-bit identity as two numbers and its MinHash values."""
    begin = first[:-1][np.diff(first) > 0]
    if not len(begin):
        return np.zeros((0, 2), np.uint64), np.zeros((0, SYMBOLS), np.uint64)
    ids = np.stack([np.add.reduceat(tk.mix(hashes + np.uint64(s)), begin) for s in (1, 0x5851F42D4C957F2D)], axis=1)
    sig = np.stack([tk.mix(np.minimum.reduceat((hashes ^ x) * m, begin)) for x, m in zip(_XOR, _MUL, strict=True)], axis=1)
    return ids, sig


def sketches(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each non-empty set, four bits for each range of hashes, from the least hash in it; hashes are in order."""
    n = np.diff(first)
    of = np.repeat(np.arange((n > 0).sum()), n[n > 0])
    place = of * RANGES + (hashes >> np.uint64(55)).astype(np.int64)
    least = np.ones(len(place), bool)
    least[1:] = place[1:] != place[:-1]
    bits = np.zeros((n > 0).sum() * RANGES, np.uint8)
    bits[place[least]] = 1 + tk.mix(hashes[least]) % np.uint64(15)
    return (bits[0::2] | bits[1::2] << 4).view(np.int64).reshape(-1, LANES)


def chunks_of(sig: np.ndarray) -> np.ndarray:
    """Each signature's chunks, as numbers of ``CHUNK`` symbols."""
    symbols = (sig >> np.uint64(64 - BITS)).reshape(len(sig), CHUNKS, CHUNK)
    return (symbols << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def chunk_keys(chunks: np.ndarray) -> np.ndarray:
    """Keys of each signature, in order of chunks: the chunk with each one of its symbols left out."""
    out = []
    for c in range(CHUNKS):
        for skip in range(CHUNK):
            rest = chunks[:, c] & ~np.uint64(((1 << BITS) - 1) << (BITS * skip))
            slot = (c * CHUNK + skip + 1) * 0xD6E8FEB86659FD93 % (1 << 64)
            out.append(tk.mix(rest + np.uint64(slot)))
    return np.stack(out, axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = tk.utf8(b.column("text"))
        sizes, nodes, keys, lanes = [], [], [], []
        for i, j in tk.slices(at):
            hashes, first = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
            n = np.diff(first)
            ids, sig = signatures(hashes, first)
            some = iter(range(len(ids)))
            key = chunk_keys(chunks_of(sig)).view(np.int64)
            lane = sketches(hashes, first)
            sizes.append(n)
            for x in n:
                k = next(some) if x else -1
                nodes.append(ids[k].tobytes() if x else None)
                keys.append(key[k] if x else None)
                lanes.append(lane[k] if x else None)
        names = [*b.schema.names, *[f.name for f in _FIELDS]]
        added = [pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(lanes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*b.columns, *added], names=names).drop_columns(["text"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id, _th and the set's size, identity, bucket keys and signature for each row of ``docs``."""
    docs = row_key(docs.select("doc_id", "text"))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    return scan(docs, _describe, T.StructType([*kept, *_FIELDS]))


def _filled(x: Column) -> Column:
    """How many groups of four bits are not 0."""
    for shift in (2, 1):
        x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
    return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))


def near() -> Column:
    """Whether sizes and sketches leave it open that a pair (sides a and b) is similar enough.

    In a range whose least hashes differ the smaller one is a shingle of one side alone. With s shingles on both sides and d of one side alone
    the similarity is (s - d) / (s + d), so more than s * (1 - low) / (1 + low) of them rule a link out.
    """
    low, high = SIMILARITY
    sizes = high * F.least("size_a", "size_b") >= low * F.greatest("size_a", "size_b")
    differ = F.lit(0)
    for k in range(LANES):
        differ += _filled(F.col("sig_a")[k].bitwiseXOR(F.col("sig_b")[k]))
    return sizes & ((high + low) * differ <= (high - low) * (F.col("size_a") + F.col("size_b")))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low, high = SIMILARITY
    for b in batches:
        left, right = tk.utf8(b.column("text_a")), tk.utf8(b.column("text_b"))
        ok = np.zeros(b.num_rows, bool)
        for i, j in tk.slices(left[1] + right[1]):
            sides = []
            for data, at in (left, right):
                hashes, first = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                n = np.diff(first)
                sides.append((tk.keyed(np.repeat(np.arange(j - i), n), hashes), np.repeat(np.arange(j - i), n), n))
            both = np.isin(sides[0][0], sides[1][0], assume_unique=True)
            shared = np.bincount(sides[0][1][both], minlength=j - i)
            ok[i:j] = high * shared >= low * (sides[0][2] + sides[1][2] - shared)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough. ``texts`` has node and text."""
    side = lambda s: texts.select(F.col("node").alias(f"_{s}"), F.col("text").alias(f"text_{s}"))
    pairs = pairs.select("a", "b").distinct()
    joined = pairs.join(side("b"), F.col("b") == F.col("_b")).join(side("a"), F.col("a") == F.col("_a"))
    return scan(joined.select("a", "b", "text_a", "text_b"), _confirm, "a binary, b binary")


def _near(pairs: DataFrame) -> DataFrame:
    return pairs.where(near()).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with root, which is the node itself unless ``roots`` has it."""
    to = roots.select(F.col("node").alias("_n"), F.col("root").alias("_root"))
    return rows.join(to, F.col("node") == F.col("_n"), "left").withColumn("root", F.coalesce("_root", "node")).drop("_n", "_root")


def _mixed(member: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root) of the buckets that hold several components."""
    placed = saved(_rooted(member.select("key", "node"), roots), "placed")
    mixed = saved(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key"), "mixed")
    out = saved(placed.join(mixed, "key", "left_semi"), "open")
    remove(member.sparkSession, placed, mixed)
    return out


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, at = tk.utf8(b.column("text"))
        for i, j in tk.slices(at):
            hashes, first = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i])
            of = pa.array(np.repeat(np.arange(i, j), np.diff(first)))
            yield pa.RecordBatch.from_arrays([b.column("node").take(of), pa.array(hashes.view(np.int64))], names=["node", "shingle"])


def _band(size: Column) -> Column:
    return F.floor(F.ln(size) / F.lit(float(np.log(BAND)))).cast("int")


def prefix_pairs(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): pairs of ``classes`` (node, root, size, sig) with different roots that could be linked. None that is linked is missed.

    In the order of a set's shingles, rarest first, a pair with an overlap of at least o has a common one among the first size - o + 1 of both.
    The overlap that a link needs follows from both sizes; the partner's is known within a band.
    """
    low, high = SIMILARITY
    own = scan(texts.join(classes.select("node"), "node", "left_semi").select("node", "text"), _shingles, "node binary, shingle bigint")
    own = saved(own, "shingles")
    often = saved(own.groupBy(F.col("shingle").alias("_s")).agg(F.count("*").alias("often")).where("often > 1"), "often")
    ranked = own.join(often, F.col("shingle") == F.col("_s")).select("node", "shingle", "often")
    # shingles of one class alone come first and pair with nothing; the last of a set has its size as place
    w = Window.partitionBy("node").orderBy(F.desc("often"), "shingle")
    ranked = ranked.withColumn("behind", F.row_number().over(w) - 1).join(classes.select("node", "root", "size"), "node")
    partner = F.explode(F.sequence(_band(F.col("size") * low / high) - 1, _band(F.col("size") * high / low) + 1)).alias("other")
    least = F.floor(F.pow(F.lit(BAND), F.col("other"))) - 1  # sizes of the other band are not below
    needed = F.ceil(low * (F.col("size") + least) / F.lit(float(high + low)) - 1e-6)
    first = ranked.where(high * F.col("behind") >= (low * F.col("size") - high)).select("*", _band(F.col("size")).alias("band"), partner)
    first = saved(first.where(F.col("behind") + 1 >= needed).select("shingle", "band", "other", "node", "root", "size", "behind"), "prefixes")
    keys = ["shingle", "lower", "upper"]
    keyed = first.select("shingle", F.least("band", "other").alias("lower"), F.greatest("band", "other").alias("upper"), "band", "node", "root", "size", "behind")
    counts = keyed.groupBy(*keys, "root").agg(F.count("*").alias("n"))
    main = counts.groupBy(*keys).agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    open_ = saved(keyed.join(main.select(*keys, "main"), keys), "keys")
    side = lambda rows, s: rows.select(F.col("node").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in (*keys, "band", "root", "size", "behind")])
    on = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys] + [F.col("root_a") != F.col("root_b"), F.col("band_a") + F.col("band_b") == F.col("lower_a") + F.col("upper_a")]
    # what both have from here on must still reach the overlap of a link
    on.append((high + low) * (F.least("behind_a", "behind_b") + 1) >= low * (F.col("size_a") + F.col("size_b")))
    pairs = side(open_.where("root <> main"), "a").join(side(open_, "b"), on)
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    remove(own.sparkSession, own, often, first, open_)
    node = lambda s: classes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sig").alias(f"sig_{s}"))
    return pairs.join(node("a"), "a").join(node("b"), "b").where(near()).select("a", "b")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` once components that ``links`` connect are one."""
    ends = _rooted(_rooted(links.withColumnRenamed("a", "node"), roots).select(F.col("root").alias("a"), F.col("b").alias("node")), roots)
    more = components(ends.select("a", F.col("root").alias("b")))
    moved = _rooted(roots.select(F.col("root").alias("node"), F.col("node").alias("_own")), more).select(F.col("_own").alias("node"), "root")
    return saved(moved.unionByName(more), "roots")


def _named(doc_id: Column, node: Column) -> Column:
    """A class's name: whether it has no doc_id, its smallest one so that names are in that order, and its identity."""
    number = F.lpad(F.hex(doc_id.cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(doc_id.isNull(), F.unhex(F.lit("01" + "0" * 16))).otherwise(F.unhex(F.concat(F.lit("00"), number))), node)


def _doc_id(name: Column) -> Column:
    """The doc_id that a class's name begins with."""
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number.cast("bigint"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, _th, n_shingles, root) for each row: root is the smallest class of the row's component, null for an empty set."""
    spark = docs.sparkSession
    rows = saved(described(docs), "described")
    at = F.min(F.struct("doc_id", "_th"))
    parts = (F.first("n_shingles").alias("size"), F.first("keys").alias("keys"), F.first("sig").alias("sig"))
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), at.alias("at"), *parts)
    classes = saved(classes.select(_named(F.col("least"), F.col("node")).alias("node"), F.col("node").alias("set"), "at", "size", "keys", "sig"), "classes")
    entries = classes.select("node", F.explode("keys").alias("key"))
    buckets = saved(entries.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).where("pivot <> other").select("key", "pivot"), "buckets")
    release(spark)
    member = saved(entries.join(buckets, "key"), "members")
    release(spark)
    node = lambda s: classes.select(F.col("node").alias(s), F.col("size").alias(f"size_{s}"), F.col("sig").alias(f"sig_{s}"))
    # the texts of all classes that share a bucket
    wanted = member.select("node").distinct().join(classes, "node").select("node", F.col("at.doc_id").alias("_d"), F.col("at._th").alias("_h"))
    texts = row_key(docs.select("doc_id", "text")).join(wanted, (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    texts = saved(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    release(spark)
    # each class against the smallest class of its buckets
    nearest = member.groupBy(F.col("node").alias("b")).agg(F.min("pivot").alias("a")).where("a <> b")
    links = saved(confirmed(_near(nearest.join(node("a"), "a").join(node("b"), "b")), texts), "links")
    roots = components(links)
    remove(spark, links, buckets)
    # then against one class of each bucket, another in each round, while buckets hold several components
    for k in range(ROUNDS):
        release(spark)
        placed = _mixed(member, roots)
        order = F.col("node") if k == 0 else F.xxhash64("node", "key", F.lit(k))  # each bucket its own, so that a class meets many
        pivots = placed.groupBy("key").agg(F.min_by(F.struct("node", "root"), order).alias("p"))
        stars = placed.join(pivots, "key").where(F.col("p.root") != F.col("root"))
        stars = stars.select(F.least("p.node", "node").alias("a"), F.greatest("p.node", "node").alias("b")).distinct()
        links = saved(confirmed(_near(stars.join(node("a"), "a").join(node("b"), "b")), texts), "links")
        remove(spark, placed)
        if links.isEmpty():
            break
        roots = _merged(roots, links)
        remove(spark, links)
    # and at last whatever shares a bucket with another component
    placed = _mixed(member, roots)
    open_ = saved(placed.select("node", "root").distinct().join(classes.select("node", "size", "sig"), "node"), "open")
    remove(spark, placed, member)
    release(spark)
    links = saved(confirmed(prefix_pairs(open_, texts), texts), "links")
    if not links.isEmpty():
        roots = _merged(roots, links)
    remove(spark, texts, open_, links)
    named = classes.select(F.col("set").alias("_set"), "node").join(roots, "node", "left").select("_set", F.coalesce("root", "node").alias("root"))
    return rows.join(named, F.col("node") == F.col("_set"), "left").select("doc_id", "_th", "n_shingles", "root")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, _th, n_shingles, component_id, kept and _root (null for empty sets) for each row of ``docs``."""
    component = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(_doc_id(F.col("root")).cast(docs.schema["doc_id"].dataType))
    out = groups(docs).select("doc_id", "_th", "n_shingles", component.alias("component_id"), F.col("root").alias("_root"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component: its smallest doc_id, and of rows with that id the one whose text has the
    smallest hash. Rows with empty sets are linked with nothing and all stay."""
    flags = saved(labelled(docs), "labels")
    first = flags.where("_root is not null").groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_th")).alias("x"))
    stay = first.select(F.col("x.doc_id").alias("_d"), F.col("x._th").alias("_h"))
    stay = stay.unionByName(flags.where("_root is null").select(F.col("doc_id").alias("_d"), F.col("_th").alias("_h")).distinct())
    held = row_key(boxed(docs, "doc_id")).join(stay, (F.col("_th") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    if not flags.where("_root is not null").groupBy("doc_id", "_th").count().where("count > 1").isEmpty():
        held = held.where("text is null").unionByName(held.where("text is not null").dropDuplicates(["doc_id", "_th"]))
    return unboxed(held, docs)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return labelled(docs).select("doc_id", "n_shingles", "component_id", "kept")
