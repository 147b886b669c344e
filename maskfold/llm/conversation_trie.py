"""A prefix trie of conversations, built level by level.

Turns become hashes of role and text (SHA-256) with a count of words; texts are shuffled nowhere. Conversations with one and the same
sequence are a class, named by its smallest conv_id, with the number of its members: a conversation of which there are many copies is handled once.

Construction goes down by depth. The live classes at a depth are grouped by (parent node, next turn); each group is a node, named by its smallest
conv_id. A class that is alone in its node leaves: what follows is a chain, whose nodes are written down at once from its turns. So there are as many levels as the longest
prefix that different conversations share, and each handles only the classes that still share one. Grouping sums before it shuffles, and the join that gives
classes their node is dealt by node and a salt, as a first turn may be that of a third of all conversations.

Then the levels are rolled up from the deepest: a node's leaves and saved tokens are those of its children, joined by parent, and its own.

The hash of the members that end at a node needs their ids in order: ids become strings by ranges of ``CHUNK`` ids, in parallel, and one pass over
the strings of a class, in order, hashes them without holding them.

Defined results: rows with a null conv_id belong to no conversation and are left out; a null role or text is empty; turns are ordered by number, null first, and
those with one number by the hash of role and text, so that repeated rows are repeated turns; very long texts count whole; an empty table has no conversation, so no
root, and gives an empty result. Other columns are not read, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remove, saved, scan, table

#: Conversations of which one shares its first turns with the others, and turns that it may share.
BLOCK, HEADS = 20, 4
WORD = "[^\\x20\\x09-\\x0D]+"
#: Ids that one string of a class covers.
CHUNK = 4096
#: Parts that the classes of a node are dealt to.
SALTS = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words) from (conv_id, turn, role, text): turns in order, counted from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    slim = rows.where("conv_id is not null").select("conv_id", "turn", key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return slim.select("conv_id", F.row_number().over(order).alias("pos"), "key", "words")


def shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns, and (conv_id) of all conversations: each takes its first turns, some or none, from the first one of its block."""
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).select("conv_id", "n", heads.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    convs = saved(convs, "convs")
    first = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(first, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("take"))
    lent = turns.where(F.col("pos") < HEADS).select(F.col("conv_id").alias("base"), "pos", "key", "words")
    head = convs.join(lent, "base").where("pos <= take").select("conv_id", "pos", "key", "words")
    own = turns.join(convs.select("conv_id", "h", "take"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("take")).alias("pos"), "key", "words")
    return head.unionByName(own), convs.select("conv_id")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (len, a, b, first, members, ids) in order of classes and ids to a row for each class; the ids of a class are hashed as they come."""
    names = ["cls", "len", "cnt", "ends"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    now, row, state = None, None, None
    for batch in batches:
        out: list[list] = []
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for length, a, b, first, members, ids in zip(*columns, strict=True):
            if (length, a, b) == now:
                state.update(b",")
                row[2] += members
            else:
                if now is not None:
                    out.append([*row, state.hexdigest()])
                now, row, state = (length, a, b), [first, length, members], hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
    last = [[*row, state.hexdigest()]] if now is not None else []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in last], t) for i, t in enumerate(types)], names)


def classes_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(cls, len, cnt, ends): conversations with equal sequences as one class, named by its smallest conv_id; ends is the hash of its members' ids."""
    lane = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "pos", "key"))
    prints = turns.groupBy("conv_id").agg(F.count("*").alias("len"), lane(1).alias("a"), lane(2).alias("b"))
    none = F.lit(0).cast("bigint")
    prints = convs.join(prints, "conv_id", "left").select("conv_id", *[F.coalesce(c, none).alias(c) for c in ("len", "a", "b")])
    ids = F.sort_array(F.collect_list("conv_id"))
    parts = prints.groupBy("len", "a", "b", F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
    parts = parts.select("len", "a", "b", "chunk", F.element_at("ids", 1).alias("first"), F.size("ids").cast("bigint").alias("members"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("text"))
    dealt = parts.repartition("len", "a", "b").sortWithinPartitions("len", "a", "b", "chunk").select("len", "a", "b", "first", "members", "text")
    return scan(dealt, _ends, "cls long, len long, cnt long, ends string")


def _placed(now: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, len, node, conv) of the classes at a level: the node they come from and the shared one that they are in, null if they are alone."""
    shared = nodes.where("n_classes > 1").select(F.col("node").alias("_node"), F.col("key").alias("_key"), "conv", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    on = (F.col("node") == F.col("_node")) & (F.col("key") == F.col("_key")) & (F.pmod(F.xxhash64("cls"), F.lit(SALTS)) == F.col("_salt"))
    return now.join(shared, on, "left").select("cls", "len", "node", "conv")


def _levels(turns: DataFrame, root: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The shared nodes of each depth from 1 on (conv, parent, n_convs, words, end_cls), and the classes that left: (cls, depth, parent)."""
    spark = turns.sparkSession
    live, levels, left, depth = turns.withColumn("node", F.lit(root)), [], None, 0
    while not live.isEmpty():
        depth += 1
        now = live.where(F.col("depth") == depth)
        nodes = saved(now.groupBy("node", "key").agg(F.min("cls").alias("conv"), F.sum("cnt").alias("n_convs"), F.count("*").alias("n_classes"), F.max("words").alias("words")), "nodes")
        placed = saved(_placed(now, nodes), "placed")
        ended = placed.where((F.col("len") == depth) & F.col("conv").isNotNull()).select("conv", F.col("cls").alias("end_cls"))
        level = nodes.where("n_classes > 1").select("conv", F.col("node").alias("parent"), "n_convs", "words").join(ended, "conv", "left")
        gone = placed.where("conv is null").select("cls", F.lit(depth).alias("depth"), F.col("node").alias("parent"))
        staying = placed.where(F.col("conv").isNotNull() & (F.col("len") > depth)).select("cls", "conv")
        after = live.where(F.col("depth") > depth).drop("node").join(staying, "cls").withColumnRenamed("conv", "node")
        after, level, gone = saved(after, "live"), saved(level, "level"), saved(gone, "left")
        remove(spark, nodes, placed, live)
        levels.append(level)
        left = gone if left is None else left.unionByName(gone)
        live = after
    return levels, left


def _rolled_up(levels: list[DataFrame], chains: DataFrame, root: DataFrame) -> DataFrame:
    """All shared nodes and the root with n_children, n_leaves and saved_tokens, from the deepest level to the root."""
    spark = root.sparkSession
    out, below = [], None
    for depth in range(len(levels), -1, -1):
        here = levels[depth - 1] if depth else root
        parts = chains.where(F.col("depth") == depth + 1).select("parent", F.lit(1).cast("bigint").alias("n_leaves"), "saved_tokens")
        if below is not None:
            parts = parts.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
        children = parts.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        children = children.withColumnRenamed("parent", "conv")
        zero = F.lit(0).cast("bigint")
        own = (F.col("n_convs") - 1) * F.col("words")
        here = here.join(children, "conv", "left").select(
            "conv", F.lit(depth).cast("bigint").alias("depth"), "parent", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("bigint")).alias("n_leaves"),
            (F.coalesce("saved", zero) + own).alias("saved_tokens"), "end_cls",
        )
        below = saved(here, "rolled")
        if depth:
            remove(spark, levels[depth - 1])
        out.append(below)
    done = out[0]
    for x in out[1:]:
        done = done.unionByName(x)
    return done


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has (conv_id, pos, key, words) with pos from 1 on without a gap, ``convs`` all conv_id, those without turns as well."""
    spark = turns.sparkSession
    classes = saved(classes_of(turns, convs), "classes")
    whole = classes.agg(F.min("cls").alias("conv"), F.sum("cnt").alias("n_convs")).first()
    if whole.conv is None:
        long = F.lit(None).cast("bigint")
        names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
        return classes.where("false").select(*[long.alias(n) for n in names], F.col("ends").alias("ends_sha256"))
    slim = turns.join(classes.select(F.col("cls").alias("conv_id"), F.col("cls"), "cnt", "len"), "conv_id").select("cls", "cnt", "len", F.col("pos").cast("bigint").alias("depth"), "key", "words")
    slim = saved(slim, "class-turns")
    levels, left = _levels(slim, whole.conv)
    end = classes.where("len = 0").select(F.col("cls").alias("end_cls"))
    long = lambda x: F.lit(x).cast("bigint")
    root = spark.range(1).select(long(whole.conv).alias("conv"), long(None).alias("parent"), long(whole.n_convs).alias("n_convs"), long(0).alias("words"))
    root = root.join(end, F.lit(True), "left") if not end.isEmpty() else root.withColumn("end_cls", long(None))
    own = (F.col("cnt") - 1) * F.col("words")
    rows = chains = slim.where("false").select("cls", "cnt", "len", "depth", "words", long(0).alias("since"), long(0).alias("parent"))
    if left is not None:
        rows = slim.join(left.select("cls", F.col("depth").alias("since"), "parent"), "cls").where("depth >= since").select("cls", "cnt", "len", "depth", "words", "since", "parent")
    chains = saved(rows.groupBy("cls", F.col("since").alias("depth"), "parent").agg(F.sum(own).alias("saved_tokens")), "chains")
    shared = _rolled_up(levels, chains, root)
    after = Window.partitionBy("cls").orderBy(F.col("depth").desc())
    alone = rows.select(
        F.col("cls").alias("conv"), "depth", F.when(F.col("depth") == F.col("since"), F.col("parent")).otherwise(F.col("cls")).alias("parent"), F.col("cnt").alias("n_convs"),
        (F.col("depth") < F.col("len")).cast("bigint").alias("n_children"), long(1).alias("n_leaves"), F.sum(own).over(after).alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), F.col("cls")).alias("end_cls"),
    )
    nodes = shared.unionByName(alone).join(classes.select(F.col("cls").alias("end_cls"), "ends"), "end_cls", "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")
    )


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = saved(turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "turns")
    rebuilt, convs = shared_heads(turns)
    rebuilt = saved(rebuilt, "rebuilt")
    remove(spark, turns)
    return trie(rebuilt, convs)


def _crc(text: Column | str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, i: xor(c >> 1, (c & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)), lambda a, b: {step}), 4294967295)"


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, sha256(length(role)::VARCHAR || ':' || role || text) AS key, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos, key, words FROM k),
c AS (SELECT conv_id, max(pos) AS n, {_crc('conv_id::VARCHAR')} % {HEADS} AS h, conv_id - conv_id % {BLOCK} AS base FROM o GROUP BY conv_id),
e AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS take FROM c LEFT JOIN c b ON c.base = b.conv_id),
s AS (SELECT e.conv_id, pos, key, words FROM e JOIN o ON o.conv_id = e.base AND pos <= take
  UNION ALL SELECT e.conv_id, pos - h + take, key, words FROM e JOIN o ON o.conv_id = e.conv_id AND pos > h),
q AS (SELECT e.conv_id, coalesce(list(key ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS keys, coalesce(list(words ORDER BY pos) FILTER (WHERE key IS NOT NULL), []) AS words
  FROM e LEFT JOIN s ON s.conv_id = e.conv_id GROUP BY e.conv_id),
m AS (SELECT conv_id, keys, words, unnest(range(len(keys) + 1)) AS depth FROM q),
n AS (SELECT depth, array_to_string(keys[1:depth], '/') AS path, any_value(keys[1:depth]) AS keys, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, any_value(words[depth]) AS last,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(keys) = depth), '')) AS ends_sha256 FROM m GROUP BY ALL),
g AS (SELECT depth, path, sum(n_convs)::BIGINT AS n_convs FROM n GROUP BY ALL),
p AS (SELECT depth - 1 AS depth, array_to_string(keys[1:depth - 1], '/') AS path, count(*)::BIGINT AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN p ON p.depth = n.depth AND p.path = n.path),
a AS (SELECT unnest(range(depth + 1)) AS up, keys, (n_children = 0)::INT AS leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * last END AS saved FROM x),
u AS (SELECT up AS depth, array_to_string(keys[1:up], '/') AS path, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM a GROUP BY ALL)
SELECT x.conv_id, x.depth::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN u ON u.depth = x.depth AND u.path = x.path LEFT JOIN n y ON y.depth = x.depth - 1 AND y.path = array_to_string(x.keys[1:x.depth - 1], '/')
"""
