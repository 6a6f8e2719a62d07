"""Operator 4, WARC: Merkle fixity audit of replicas.

A replica is a table of records (file, offset, length, digest).  Records hash into ordered offset ranges of ``LEAF_BYTES``; ``FANOUT``
ranges in order hash into one range of the next level, and so on up to one root per file.  Two replicas are compared root by root;
only the children of unequal nodes are compared further, down to the records of unequal leaves.

Everything is grouping by (file, range) and equi-joins, so a file with a third of all records spreads over its ranges, and no group
holds more than the records of one leaf or ``FANOUT`` nodes.

Defined results: records with a NULL file or offset are not addressable and are ignored.  A NULL length or digest is hashed as a
marked NULL.  Records that share file and offset are all part of the leaf, in the order of length and digest, and compared as a
set.  A file in one replica only has all its records ``missing`` or ``extra``.  Empty tables give an empty audit.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelens.llm.shared import stored

#: Parameters: bytes of a leaf range, nodes of one parent, levels above the leaves (64 KiB * 16^4 = 4 GiB below one top node).
LEAF_BYTES = 1 << 16
FANOUT = 16
LEVELS = 4


def with_offsets(records: DataFrame, file: str, order: list[str], length: str) -> DataFrame:
    """``records`` of WARC files written one after another in ``order``, with ``offset`` (a file bounds its window)."""
    before = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("long"))


def record_bytes(url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record (binary): header lines, a blank line, the payload, two line ends."""
    body = F.coalesce(payload.cast("binary"), F.lit("").cast("binary"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def leaves(records: DataFrame) -> DataFrame:
    """(file, node, hash) of the leaf ranges."""
    line = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.coalesce(F.col("length").cast("string"), F.lit("null")),
                       F.coalesce("digest", F.lit("null")))
    return (records.groupBy("file", F.floor(F.col("offset") / LEAF_BYTES).alias("node"))
            .agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("hash")))


def parents(nodes: DataFrame) -> DataFrame:
    """(file, node, hash) one level up: the ordered hashes of up to ``FANOUT`` children."""
    kids = F.sort_array(F.collect_list(F.struct("node", "hash")))
    return (nodes.groupBy("file", F.floor(F.col("node") / FANOUT).alias("up"))
            .agg(F.sha2(F.array_join(F.transform(kids, lambda c: F.concat_ws(":", c["node"].cast("string"), c["hash"])), "\n"), 256).alias("hash"))
            .withColumnRenamed("up", "node"))


def tree(records: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Node tables from the leaves up; the last one is the roots (a file's remaining top nodes in order)."""
    out = [stored(leaves(records), "merkle-leaves")]
    for level in range(1, levels + 1):
        out.append(stored(parents(out[-1]), f"merkle-level-{level}"))       # read once for its parents and once in the descent
    top = out[-1].select("file", F.lit(0).cast("long").alias("node"), "hash", F.col("node").alias("at"))
    kids = F.sort_array(F.collect_list(F.struct("at", "hash")))
    root = top.groupBy("file", "node").agg(F.sha2(F.array_join(F.transform(kids, lambda c: c["hash"]), "\n"), 256).alias("hash"))
    return [*out, root]


def audit(mine: DataFrame, theirs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(file, offset, length, digest, other_length, other_digest, status) of every record on which two replicas differ.

    Status: ``changed`` (another record at the offset), ``missing`` (only in ``mine``), ``extra`` (only in ``theirs``).
    """
    cols = ["file", "offset", "length", "digest"]
    a, b = (r.select(*cols).where(F.col("file").isNotNull() & F.col("offset").isNotNull()) for r in (mine, theirs))
    a_tree, b_tree = tree(a, levels), tree(b, levels)
    unequal = None
    for level in range(levels + 1, -1, -1):
        x, y = a_tree[level], b_tree[level]
        if unequal is not None:
            # children of unequal nodes alone; every top node is a child of its file's root
            up = F.lit(0).cast("long") if level == levels else F.floor(F.col("node") / FANOUT)
            parent = unequal.withColumnRenamed("node", "up")
            x, y = (t.withColumn("up", up).join(parent, ["file", "up"], "left_semi").select("file", "node", "hash") for t in (x, y))
        both = x.withColumnRenamed("hash", "h1").join(y.withColumnRenamed("hash", "h2"), ["file", "node"], "full")
        unequal = stored(both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select("file", "node"), f"merkle-unequal-{level}")
    near = F.floor(F.col("offset") / LEAF_BYTES)
    x, y = (t.withColumn("node", near).join(unequal, ["file", "node"], "left_semi").select(*cols).distinct() for t in (a, b))
    only_x = x.join(y, [x[c].eqNullSafe(y[c]) for c in cols], "left_anti").withColumn("place", F.lit(1))
    only_y = y.join(x, [y[c].eqNullSafe(x[c]) for c in cols], "left_anti").select(
        "file", "offset", F.col("length").alias("other_length"), F.col("digest").alias("other_digest")).withColumn("other_place", F.lit(1))
    status = F.when(F.col("other_place").isNull(), "missing").when(F.col("place").isNull(), "extra").otherwise("changed")
    return only_x.join(only_y, ["file", "offset"], "full").select(*cols, "other_length", "other_digest", status.alias("status"))
