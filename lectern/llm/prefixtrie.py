"""Prefix trie of conversations, its subtree totals by peeling finished branches.

A node is a distinct sequence of first d turns.  Its key is the exclusive or of 128-bit hashes of
(place, role, text), which prefix sums give for every turn, whatever the length of a conversation.
Nodes are partial aggregates of the turns that have a key; the root is that of no turns.

Totals go from the leaves to the root.  A node's members have a longest conversation (ties: the
least id), and the nodes that share it are a branch: one way down from its top to a leaf.  Every
branch holds a counter of the branches that hang from its nodes; a branch whose counter is 0 is
complete and sends its totals to the node that its top hangs from, and leaves; the counters below go down,
until only the root's branch is left.  So a conversation of thousands of turns is one branch and not
thousands of rounds: there are as many rounds as branches hang from one another.  A round reads
and writes one row a branch that is still open.  What a node received, and what lies below it on its branch,
are then one more prefix sum, from the leaf upwards.

The ids of a node's last members are sorted over all tasks and joined to pieces of PIECE ids
where they lie; a node's hash reads its pieces in order, so that no list is held in memory.

Cases: null roles and texts are empty; null turns come first; equal turns of a conversation are ordered by
a hash of role and text, and all kept; a null conversation is one of its own, comes last and has no
decimal (empty in ``ends_sha256``); no rows give no nodes; other columns are not read.  Within, a
conversation is (none, conv), so that null ones meet in plain joins; keys that may be hot (a
conversation of very many turns, a node of very many children) meet in ``hot_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import hot_join, remove, session, shared_dir, staged, table, words
from lectern.operators.prefix import running

#: Ids joined to one piece of a node's list.
PIECE = 4096
_KEY, _CONV = ["k1", "k2", "depth"], ["none", "conv"]


def read_turns(conversations: DataFrame) -> DataFrame:
    """(none, conv, pos, h1, h2, n): place from 0, hashes of role and text, and words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(
        conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), role, text).alias("h2"), F.size(words(text)).cast("long").alias("n"),
    )  # fmt: skip
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    return running(rows, _CONV, order, {"pos": F.lit(1).cast("long")}).select(*_CONV, (F.col("pos") - 1).alias("pos"), "h1", "h2", "n")


def _marks() -> list[Column]:
    """Two hashes of a turn at its place."""
    return [F.xxhash64("pos", "h1", "h2", F.lit(i)).alias(f"x{i}") for i in (1, 2)]


def _keyed(turns: DataFrame) -> DataFrame:
    """(none, conv, depth, k1, k2, p1, p2, n): the node of every turn and its parent's key."""
    summed = running(turns.select(*_CONV, "pos", "n", *_marks()), _CONV, [F.col("pos")], xors={"k1": F.col("x1"), "k2": F.col("x2")})
    return summed.select(*_CONV, (F.col("pos") + 1).alias("depth"), "k1", "k2", *[F.col(f"k{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"p{i}") for i in (1, 2)], "n")


def nodes(turns: DataFrame, convs: DataFrame, total: int) -> DataFrame:
    """One row a node: key, parent's key (p1, p2), first member, n_convs, own (words that its copies save) and branch.

    A branch is named by the first of a node's members, longest first.
    """
    placed = hot_join(_keyed(turns), convs.select(*_CONV, "size", F.col("size").alias("n")), _CONV, total)
    zero = lambda c: F.lit(0).cast("long").alias(c)  # noqa: E731
    roots = convs.select(*_CONV, zero("depth"), zero("k1"), zero("k2"), *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], zero("n"), "size")
    grouped = placed.unionByName(roots).groupBy(*_KEY).agg(
        F.min(F.struct(*_CONV)).alias("member"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n").alias("n"),
        F.min(F.struct((-F.col("size")).alias("s"), *_CONV)).alias("branch"),
    )  # fmt: skip
    first = F.when(~F.col("member.none"), F.col("member.conv")).alias("conv_id")
    return grouped.select(*_KEY, first, "n_convs", "p1", "p2", ((F.col("n_convs") - 1) * F.col("n")).alias("own"), "branch")


def peeled(tree: DataFrame, path: str) -> DataFrame:
    """(k1, k2, depth, leaves, saved, children): what each node that branches hang from receives from them, and their number.

    ``tree`` are the nodes.  Every round the complete branches send their totals and leave.
    """
    spark = tree.sparkSession
    top = F.min_by(F.struct("k1", "k2", "p1", "p2", "depth"), "depth")
    tops = tree.groupBy("branch").agg(F.sum("own").alias("saved"), top.alias("t"))
    tops = staged(tops.select("branch", "saved", "t.p1", "t.p2", (F.col("t.depth") - 1).alias("at")), f"{path}/tops")
    place = ["p1", "p2", "at"]
    above = tree.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("at"), F.col("branch").alias("parent"))
    above = above.join(tops.where("at >= 0").groupBy(*place).agg(F.count("*").alias("n")), place)
    hung = hot_join(tops, above, place, tops.count()).select("branch", "parent", *place, "saved")
    root = tops.where("at < 0").select("branch", F.lit(None).cast(tree.schema["branch"].dataType).alias("parent"), *place, "saved")
    rows = staged(hung.union(root).withColumn("leaves", F.lit(1).cast("long")), f"{path}/hung")
    waits = rows.where("parent is not null").groupBy(F.col("parent").alias("branch")).agg(F.count("*").alias("left"))
    current = staged(rows.join(waits, "branch", "left").withColumn("left", F.coalesce("left", F.lit(0))), f"{path}/open0")
    sent, turn = None, 0
    while True:
        done = current.where("left = 0 and parent is not null")
        message = done.select("parent", "p1", "p2", "at", "leaves", "saved")
        told = message.groupBy(F.col("parent").alias("branch")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more"), F.sum("saved").alias("add"))
        mail = staged(message.groupBy("p1", "p2", "at").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.count("*").alias("children")), f"{path}/sent{turn}")
        if mail.isEmpty():
            break
        sent = mail if sent is None else sent.union(mail)
        still = current.where("left > 0").join(told, "branch", "left")
        add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)  # noqa: E731
        after = staged(still.select("branch", "parent", "p1", "p2", "at", add("saved", "add"), add("leaves", "more"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), f"{path}/open{turn + 1}")
        remove(spark, f"{path}/open{turn}")
        current, turn = after, turn + 1
    if sent is None:
        sent = mail
    return sent.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum("children").alias("children"))


def ends_hashes(members: DataFrame) -> DataFrame:
    """(k1, k2, depth, ends_sha256) from (k1, k2, depth, conv): the hash of a node's ids in order, joined by commas."""
    key = "k1 long, k2 long, depth long"

    def pieces(batches):
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64(), pa.binary()]

        def batch_of(rows):
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [*_KEY, *_CONV, "ids"])

        at, first, held = None, (False, 0), []
        for batch in batches:
            out = []
            for *node, none, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, *_CONV)), strict=True):
                if node != at or len(held) == PIECE:
                    if held:
                        out.append((*at, *first, b",".join(held)))
                    at, first, held = node, (none, conv), []
                held.append(b"" if none else b"%d" % conv)
            yield batch_of(out)
        if held:
            yield batch_of([(*at, *first, b",".join(held))])

    def hashes(batches):
        import hashlib

        import pyarrow as pa

        at, digest = None, None
        names = [*_KEY, "ends_sha256"]
        of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "ends_sha256" else pa.int64()) for c, n in zip(list(zip(*rows, strict=True)) or [[]] * 4, names, strict=True)], names)  # noqa: E731
        for batch in batches:
            out = []
            for k1, k2, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
                if (k1, k2, depth) != at:
                    if digest is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (k1, k2, depth), hashlib.sha256(ids)
                else:
                    digest.update(b"," + ids)
            yield of(out)
        if digest is not None:
            yield of([(*at, digest.hexdigest())])

    order = [F.col(c) for c in (*_KEY, *_CONV)]
    dealt = members.select(*_KEY, *_CONV).repartitionByRange(*order).sortWithinPartitions(*order)
    joined = dealt.mapInArrow(pieces, f"{key}, none boolean, conv long, ids binary")
    whole = joined.repartition(*_KEY).sortWithinPartitions(*order)
    return whole.mapInArrow(hashes, f"{key}, ends_sha256 string")


def ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(k1, k2, depth, none, conv): the node at which each conversation ends."""
    keys = turns.select(*_CONV, *_marks()).groupBy(*_CONV).agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))
    met = convs.join(keys, _CONV, "left")
    return met.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("k1", "k2")], F.col("size").alias("depth"), *_CONV)


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the conversations ``convs`` (none, conv, size: turns) with ``turns`` (none, conv, pos from 0, h1, h2, n).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)
    """
    spark = session(turns)
    path = shared_dir(spark)
    convs, turns = staged(convs, f"{path}/convs"), staged(turns, f"{path}/turns")
    tree = staged(nodes(turns, convs, turns.count()), f"{path}/nodes")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731
    tip = (F.col("branch.s") + F.col("depth") == 0).cast("long")
    fed = tree.join(peeled(tree, f"{path}/peel"), _KEY, "left").select(
        *[c for c in tree.columns if c != "own"], (F.col("own") + zero("saved")).alias("own"), (zero("leaves") + tip).alias("tips"), (zero("children") + 1 - tip).alias("n_children")
    )
    totals = staged(running(fed, ["branch"], [F.col("depth").desc()], {"n_leaves": F.col("tips"), "saved_tokens": F.col("own")}, path=f"{path}/sums"), f"{path}/totals")
    above = totals.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = hot_join(totals.where("depth > 0"), above, ["p1", "p2", "depth"], totals.count())
    root = totals.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    named = below.unionByName(root).join(ends_hashes(ends(turns, convs)), _KEY, "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


#: Conversations whose ids begin alike share the opening of the first of them.
FAMILY, OPENING = 20, 4


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: the first h turns are those of the family's first conversation.

    Takes the turns of ``read_turns``; gives (none, conv, pos, h1, h2, n) and (none, conv, size).
    """
    h = F.when(F.col("none"), 0).otherwise(F.crc32(F.col("conv").cast("string").cast("binary")) % OPENING)
    donor = F.when(~F.col("none"), F.col("conv") - F.col("conv") % FAMILY)
    convs = staged(turns.groupBy(*_CONV).agg(F.count("*").alias("had")).withColumns({"h": h, "donor": donor}))
    there = convs.where("not none").select(F.col("conv").alias("donor"), F.col("had").alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    sized = convs.join(there, "donor", "left").select(*_CONV, "donor", "h", "had", taken.alias("taken"))
    opening = turns.where((F.col("pos") < OPENING - 1) & ~F.col("none")).select(F.col("conv").alias("donor"), "pos", "h1", "h2", "n")
    lent = sized.join(opening, "donor").where("pos < h").select(*_CONV, "pos", "h1", "h2", "n")
    words_, facts = turns.withColumnRenamed("n", "words"), sized.select(*_CONV, "h", "taken", F.col("had").alias("n"))
    own = hot_join(words_, facts, _CONV, turns.count()).where("pos >= h").select(*_CONV, (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "h1", "h2", F.col("words").alias("n"))
    return lent.union(own), sized.select(*_CONV, (F.col("taken") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("size"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(staged(read_turns(table(spark, sf_dir, "conversations")))))


_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"""
ORACLE = rf"""
WITH t AS (
  SELECT conv_id AS c, sha256(coalesce(role, '')) || sha256(coalesce(text, '')) AS turn,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS words, row_number() OVER (PARTITION BY conv_id ORDER BY conversations.turn NULLS FIRST) - 1 AS pos
  FROM conversations),
k AS (SELECT c, count(*) AS had, {_CRC.format("c::VARCHAR")} % {OPENING} AS h, c - c % {FAMILY} AS donor FROM t GROUP BY c),
s AS (SELECT k.*, least(h, coalesce(o.had, 0)) AS taken FROM k LEFT JOIN (SELECT c AS donor, had FROM k) AS o USING (donor)),
r AS (
  SELECT s.c, pos, turn, words FROM s JOIN t ON t.c = s.donor AND pos < h
  UNION ALL SELECT s.c, pos - h + taken, turn, words FROM s JOIN t ON t.c = s.c AND pos >= h),
whole AS (SELECT s.c, coalesce(list(turn ORDER BY pos) FILTER (turn IS NOT NULL), []) AS turns, coalesce(list(words ORDER BY pos) FILTER (turn IS NOT NULL), []) AS words FROM s LEFT JOIN r USING (c) GROUP BY s.c),
placed AS (
  SELECT c, d, len(turns) AS size, turns, array_to_string(turns[1:d], ',') AS path, CASE WHEN d > 0 THEN array_to_string(turns[1:d-1], ',') END AS above, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS n
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, d, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n) AS own, max(size) = d AS leaf, arg_min(turns, c) AS turns,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256 FROM placed GROUP BY path, d),
below AS (SELECT array_to_string(turns[1:j], ',') AS path, j AS d, sum(own) AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM nodes) GROUP BY 1, 2),
kids AS (SELECT above AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2)
SELECT nodes.conv_id, nodes.d::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       below.leaves::BIGINT AS n_leaves, below.saved::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes JOIN below USING (path, d) LEFT JOIN kids USING (path, d) LEFT JOIN nodes AS up ON up.path = nodes.above AND up.d = nodes.d - 1"""
