"""Prefix trie of conversations by fixed-length block hashing.

A turn is two 64-bit hashes of its SHA-256 digest and its position; the key of a prefix is the XOR of its turns' hashes, so
keys come from running aggregates and never from a fold over one conversation. Conversations are cut into blocks of ``block``
turns. They are grouped by the keys at the ends of successive blocks first: one row per distinct block, with its members, the
least of them, and the key of the block before. Turn boundaries are refined only inside blocks with siblings: there, the turns
of one representative per distinct block are grouped by the keys at every turn. A block without siblings is a plain chain,
whose nodes take over the block's members. So turns are compared per distinct block, not per conversation.

A node is named by its least member and its depth. The nodes of one least member form a path down to its last turn, which hangs
from a node of a lesser member; the whole trie is a tree of paths. Sums over subtrees are sums over paths, found by doubling
(logarithmic in the number of paths on the way to the root), and then running sums along each path. Running sums are taken
within slices of ``SLICE`` positions plus the sums of the slices before, and turns are numbered by a range partitioning, so a
conversation may hold any share of all turns. Members that end at a node are gathered in runs of ids of at most ``ID_RUN``, and
their digest is fed run by run in order, with one run in memory.

Defined results: turns are ordered by ``turn`` (null first), equal ones by content; a null role or text is empty; repeated rows
are turns of their own; rows without a conversation id are left out. Texts are hashed whole, however long; ids are 64-bit
numbers. Equal conversations share all nodes. An empty table gives an empty result. Other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship_code, table, words, written

BLOCK, SLICE, ID_RUN = 4, 1024, 4096


def running(rows: DataFrame, key: str, at: str, columns: dict[str, Column], fold, plus, zero, back: bool = False) -> DataFrame:
    """Adds running folds of ``columns`` along ``at`` (whole numbers, unique in a ``key``), this row included."""
    place = -F.col(at) if back else F.col(at)
    rows = rows.withColumn("__slice", F.floor(place / SLICE).cast("long"))
    rows = rows.withColumns({f"__{name}": column for name, column in columns.items()})
    inner = Window.partitionBy(key, "__slice").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(key, "__slice").agg(*[fold(f"__{name}").alias(f"__{name}") for name in columns])
    earlier = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__slice", *[fold(f"__{name}").over(earlier).alias(f"__before_{name}") for name in columns])
    before = before.where(" OR ".join(f"__before_{name} IS NOT NULL" for name in columns))
    out = rows.withColumns({name: fold(f"__{name}").over(inner) for name in columns}).join(before, [key, "__slice"], "left")
    out = out.withColumns({name: plus(F.col(name), F.coalesce(F.col(f"__before_{name}"), F.lit(zero))) for name in columns})
    return out.drop("__slice", *[f"__{name}" for name in columns], *[f"__before_{name}" for name in columns])


def _running_keys(rows: DataFrame, key: str, at: str, x: Column, y: Column) -> DataFrame:
    return running(rows, key, at, {"x": x, "y": y}, F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0)


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, digest, words): the turns of each conversation numbered from 0, in order of ``turn``, null first."""
    full = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    content = F.concat(F.octet_length(full(role)).cast("string"), F.lit(":"), full(role), full(text))
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.unhex(F.sha2(content, 256)).alias("digest"),
        F.size(words(full(text))).cast("long").alias("words"),
    )
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    order = [F.asc_nulls_first("turn"), F.col("digest"), F.col("row")]
    # contiguous ranges of the order over all conversations: a large conversation is spread, equal rows as well
    ranged = rows.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "turn-ranges")
    sizes = ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("conv_id", "range", F.sum("n").over(earlier).alias("before")).where("before IS NOT NULL")
    local = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    out = ranged.withColumn("local", local).join(before, ["conv_id", "range"], "left")
    return out.select("conv_id", (F.col("local") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("at"), "digest", "words")


def prefix_trie(turns: DataFrame, members: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of numbered ``turns`` (conv_id, at, digest, words) of ``members`` (conv_id; those without turns count).

    Gives conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    spark = turns.sparkSession
    ship_code(spark)
    own = [F.xxhash64(F.lit(s), "at", "digest") for s in (1, 2)]
    turns = turns.select("conv_id", "at", F.floor(F.col("at") / block).alias("block"), "words", own[0].alias("h"), own[1].alias("g"))
    turns = written(turns, "trie-turns")
    members = written(members.select("conv_id").distinct(), "trie-members")
    first, n_members = members.agg(F.min("conv_id"), F.count("*")).first()
    shape = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_members:
        return spark.createDataFrame([], shape)

    # blocks of conversations, then distinct blocks with their members
    blocks = turns.groupBy("conv_id", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"), F.count("*").alias("turns"))
    blocks = _running_keys(blocks, "conv_id", "block", F.col("h"), F.col("g"))
    blocks = blocks.select(
        "conv_id", "block", "x", "y", F.col("x").bitwiseXOR(F.col("h")).alias("px"), F.col("y").bitwiseXOR(F.col("g")).alias("py"),
        (F.col("block") * block + F.col("turns")).alias("depth"),
    )
    blocks = written(blocks, "trie-blocks")
    distinct = blocks.groupBy("block", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("members"), F.min("px").alias("px"), F.min("py").alias("py")
    )
    distinct = written(distinct, "trie-distinct")
    # first blocks are all children of the root; further down only blocks with siblings are looked at turn by turn
    forked = distinct.where("block > 0").groupBy("block", "px", "py").agg(F.count("*").alias("siblings")).where("siblings > 1")
    forked = written(forked, "trie-forks")
    split = distinct.where("block > 0").join(forked, ["block", "px", "py"], "left").withColumn("forked", F.col("siblings").isNotNull())
    chosen = split.select("conv_id", "block", "members", "px", "py", "forked").unionByName(
        distinct.where("block = 0").select("conv_id", "block", "members", "px", "py", F.lit(True).alias("forked"))
    )
    inside = turns.join(chosen, ["conv_id", "block"])
    along = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumns({"x": F.bit_xor("h").over(along).bitwiseXOR(F.col("px")), "y": F.bit_xor("g").over(along).bitwiseXOR(F.col("py"))})
    inside = inside.select(
        "conv_id", (F.col("at") + 1).alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("h")).alias("px"),
        F.col("y").bitwiseXOR(F.col("g")).alias("py"), "members", "words", "forked",
    )
    inside = written(inside, "trie-inside")
    refined = inside.where("forked").groupBy("depth", "x", "y").agg(
        F.min("conv_id").alias("conv_id"), F.sum("members").alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.min("words").alias("words")
    )
    chains = inside.where("NOT forked").select("depth", "x", "y", "conv_id", F.col("members").alias("n_convs"), "px", "py", "words")
    root = spark.range(1).select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(first).cast("long").alias("conv_id"),
        F.lit(n_members).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("px"), F.lit(0).cast("long").alias("py"), F.lit(0).cast("long").alias("words"),
    )
    nodes = written(refined.unionByName(chains).unionByName(root), "trie-nodes")

    # paths: the nodes of one least member; where each hangs
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    tops = nodes.join(tops, ["conv_id", "depth"], "left_semi").where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), "px", "py")
    tops = written(tops, "trie-tops")
    inner = nodes.select("depth", F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent"))
    hung = tops.where("depth > 0").join(inner.where("depth > 0"), ["depth", "px", "py"]).select("conv_id", "depth", "parent")
    hung = written(hung.unionByName(tops.where("depth = 0").select("conv_id", "depth", F.lit(first).cast("long").alias("parent"))), "trie-hung")
    whole = _path_sums(nodes, hung, first)

    # what hangs from a node, and sums from the end of each path up to it
    at = hung.join(whole, "conv_id").groupBy(F.col("parent").alias("conv_id"), "depth").agg(
        F.count("*").alias("hanging"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    last = nodes.groupBy("conv_id").agg(F.max("depth").alias("last"))
    every = nodes.join(at, ["conv_id", "depth"], "left").join(last, "conv_id").join(hung.select("conv_id", (F.col("depth") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    goes_on = F.col("depth") < F.col("last")
    hanging = F.coalesce("hanging", F.lit(0))
    every = every.select(
        "conv_id", "depth", "x", "y", "n_convs", (hanging + goes_on.cast("long")).alias("n_children"),
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        (F.coalesce("leaves", F.lit(0)) + (~goes_on & (hanging == 0)).cast("long")).alias("leaves"),
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    every = written(every, "trie-every")
    sums = running(every, "conv_id", "depth", {"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")}, F.sum, lambda a, b: a + b, 0, back=True)
    sums = written(sums, "trie-sums")

    # who ends at each node
    lengths = blocks.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x", "y"), "block").alias("end")).select("conv_id", "end.*")
    none = members.join(lengths, "conv_id", "left_anti").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("depth", "x", "y")])
    runs = lengths.unionByName(none).groupBy("depth", "x", "y", F.floor(F.col("conv_id") / ID_RUN).alias("run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ends = written(digests(runs, ["depth", "x", "y"], "run", "ids"), "trie-ends")
    out = sums.join(ends, ["depth", "x", "y"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _path_sums(nodes: DataFrame, hung: DataFrame, first: int) -> DataFrame:
    """(conv_id, leaves, saved) of every path with all paths below it, by doubling the distance that sums have come from."""
    ends = hung.select(F.col("parent").alias("conv_id"), "depth").distinct().withColumn("goes_on", F.lit(True))
    last = nodes.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = last.join(ends, ["conv_id", "depth"], "left").select("conv_id", "saved", F.col("goes_on").isNull().cast("long").alias("leaves"))
    state = written(own.join(hung.select("conv_id", "parent"), "conv_id", "left"), "trie-paths")
    while not state.where("parent IS NOT NULL").isEmpty():
        given = state.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        # the first path has no parent: who points to it points nowhere next, so that this hot key joins nothing
        further = state.where(F.col("parent").isNotNull()).select(F.col("conv_id").alias("parent"), F.col("parent").alias("next"))
        moving = state.where(F.col("parent") != first).join(written(further, "trie-pointers"), "parent", "left").select("conv_id", "saved", "leaves", F.col("next").alias("parent"))
        still = state.where(F.col("parent").isNull() | (F.col("parent") == first)).withColumn("parent", F.lit(None).cast("long"))
        moved = moving.unionByName(still.select("conv_id", "saved", "leaves", "parent"))
        state = moved.join(given, "conv_id", "left").select(
            "conv_id", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), "parent"
        )
        state = written(state, "trie-paths")
    return state.select("conv_id", "leaves", "saved")


def _feed(n_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _rows(done, batch.schema, n_keys)
        if now is not None:
            yield _rows([(*now, digest.hexdigest())], batch.schema, n_keys)

    return run


def _rows(done: list[tuple], schema: pa.Schema, n_keys: int) -> pa.RecordBatch:
    names = [*schema.names[:n_keys], "digest"]
    kinds = [*[schema.field(i).type for i in range(n_keys)], pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)


def digests(runs: DataFrame, keys: list[str], order: str, ids: str) -> DataFrame:
    """(keys, digest): SHA-256 of each key's ``ids``, comma-joined in ``order``; one run of a key in memory at a time."""
    kinds = dict(runs.dtypes)
    dealt = runs.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, ids)
    return dealt.mapInArrow(_feed(len(keys)), ", ".join([*[f"{k} {kinds[k]}" for k in keys], "digest string"]))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, members) of the conversations of ``op11``: the first h turns of conversation c - c % 20, then c's own after h."""
    turns = written(turns, "numbered-turns")
    members = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    heads = turns.where("at < 3").select(F.col("conv_id").alias("base"), "at", "digest", "words")
    sizes = heads.groupBy("base").agg(F.count("*").alias("there"))
    wanted = members.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), h.alias("h"))
    wanted = written(wanted.join(sizes, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))), "rebuilt")
    shared = wanted.join(heads, "base").where("at < h").select("conv_id", "at", "digest", "words")
    own = turns.where("at > 2").withColumn("tail", F.lit(True)).unionByName(turns.where("at <= 2").withColumn("tail", F.lit(False)))
    own = own.join(wanted.select("conv_id", "h", "taken"), "conv_id").where("tail OR at >= h")
    return shared.unionByName(own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "words")), members


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """The trie of a table of conversations as they are."""
    turns = written(numbered_turns(conversations, conv_id, turn, role, text), "numbered-turns")
    return prefix_trie(turns, turns.select("conv_id"), block)


def node_texts(nodes: DataFrame, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of ``conversation_trie`` below the root with ``role`` and ``text`` of their last turn, each stored once."""
    rows = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.select("conv_id", F.unhex(F.sha2(content, 256)).alias("digest"), "role", "text").dropDuplicates(["conv_id", "digest"])
    turns = numbered_turns(conversations, conv_id, turn, role, text).select("conv_id", (F.col("at") + 1).alias("depth"), "digest")
    return nodes.join(turns, ["conv_id", "depth"]).join(rows, ["conv_id", "digest"]).drop("digest")


def op11_prefix_trie(spark, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie(*rebuilt_turns(numbered_turns(conversations)))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS ts FROM t GROUP BY conv_id),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, ts,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
               lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda s, k: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % 4 AS h FROM own),
r AS (SELECT a.conv_id, list_concat(coalesce(b.ts[1:a.h], []), a.ts[a.h + 1:]) AS ts FROM h a LEFT JOIN own b ON b.conv_id = a.base),
p AS (SELECT conv_id, CAST(len(ts) AS BIGINT) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM r),
k AS (SELECT conv_id, n, depth, sha256(CAST(CASE WHEN depth = 0 THEN [] ELSE ts[1:depth] END AS VARCHAR)) AS key,
             CASE WHEN depth > 0 THEN sha256(CAST(CASE WHEN depth = 1 THEN [] ELSE ts[1:depth - 1] END AS VARCHAR)) END AS parent,
             CASE WHEN depth > 0 THEN len(regexp_extract_all(ts[depth]['text'], '[^\x20\x09-\x0D]+')) ELSE 0 END AS words FROM p),
nodes AS (SELECT key, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
          FROM k GROUP BY key, depth),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
above AS (SELECT DISTINCT a.key AS top, b.key, b.depth FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (SELECT top, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
         FROM above JOIN nodes USING (key) LEFT JOIN children c USING (key) GROUP BY top)
SELECT nodes.conv_id, CAST(nodes.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(nodes.n_convs AS BIGINT) AS n_convs,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN sums ON sums.top = nodes.key LEFT JOIN children c ON c.key = nodes.key LEFT JOIN nodes up ON up.key = nodes.parent
"""
