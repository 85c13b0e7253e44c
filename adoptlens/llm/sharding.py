"""Resharding by minimum-cost flow: from old shard sizes to new capacities with the fewest
bytes moved.

The flow runs between shards, so its network has as many nodes as shards, whatever the
data: old shards supply their bytes, new shards take up to their capacity, bytes that stay
cost nothing. Each amount becomes a block, a stretch of the old shard in a fixed order:
largest documents first and equal texts side by side, so that what moves is cut between
small documents and the new sizes come close to their capacities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from adoptlens.session import cut_lineage

SHARDS = 16
LAW = "bytes"


def transfers(old: list[int], capacities: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """{(old shard, new shard): bytes}, of all flows the cheapest, by successive shortest paths.

    The capacities have to hold all bytes. ``cost`` is that of a byte from an old to a new
    shard; by default shards with the same number are the same place.
    """
    if sum(capacities) < sum(old):
        raise ValueError("the new shards are too small")
    m, n = len(old), len(capacities)
    source, sink = m + n, m + n + 1
    # edges in pairs, an edge and its reverse: [to, room, cost]
    edges: list[list[int]] = []
    out: list[list[int]] = [[] for _ in range(m + n + 2)]

    def connect(a: int, b: int, room: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, size in enumerate(old):
        connect(source, i, size, 0)
        for j in range(n):
            connect(i, m + j, size, cost(i, j))
    for j, room in enumerate(capacities):
        connect(m + j, sink, room, 0)
    while True:
        dist: list[float] = [float("inf")] * (m + n + 2)
        via, queue, queued = [-1] * (m + n + 2), [source], {source}
        dist[source] = 0
        while queue:
            a = queue.pop(0)
            queued.discard(a)
            for e in out[a]:
                b, room, price = edges[e]
                if room and dist[a] + price < dist[b]:
                    dist[b], via[b] = dist[a] + price, e
                    if b not in queued:
                        queue.append(b)
                        queued.add(b)
        if via[sink] < 0:
            break
        path, at = [], sink
        while at != source:
            path.append(via[at])
            at = edges[via[at] ^ 1][0]
        amount = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= amount
            edges[e ^ 1][1] += amount
    moved = {}
    for i in range(m):
        for e in out[i]:
            if not e & 1 and edges[e ^ 1][1]:
                moved[i, edges[e][0] - m] = edges[e ^ 1][1]
    return moved


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _running(rows: DataFrame, group: str, value: Column, name: str, order: list) -> DataFrame:
    """Adds the sum of ``value`` over all earlier rows of the group, in the order of
    ``__part`` and then ``order``: within the part, plus what earlier parts hold."""
    rows = rows.withColumn("__value", value)
    sums = rows.groupBy(group, "__part").agg(F.sum("__value").alias("__sum"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__within", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    rows = rows.join(sums, [group, "__part"])
    return rows.withColumn(name, F.col("__before") + F.col("__within")).drop("__value", "__before", "__within")


def by_content(text: Column, shards: int = SHARDS) -> Column:
    """A shard for each text, the same for equal texts."""
    return F.pmod(F.xxhash64(text), F.lit(shards)).cast("int")


def reshard(
    documents: DataFrame,
    old_shard: Column,
    capacities: list[int] | int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot.

    ``old_shard`` is the number of the shard that a row is in now, from 0; ``capacities``
    the bytes that the new shards may hold, or their number for equal sizes. A size is the
    text's UTF-8 bytes plus 1 (1 for null), text_crc32 that of an empty text for null.
    Slots number the rows of a new shard from 0 without gaps. Repeated rows are rows of
    their own and keep together with equal texts where sizes allow. The driver sees one
    number per old shard. Other columns are ignored. An empty table gives an empty result.

    Order and sums come from a range partitioning by shard, size, text hash and id, so no
    shard, text or id has to fit one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("__hash"),
        old_shard.cast("int").alias("old_shard"),
    )
    order = [F.desc("size"), F.asc("__hash"), F.asc("doc_id")]
    rows = cut_lineage(rows.repartitionByRange("old_shard", *order).withColumn("__part", F.spark_partition_id()))
    sizes = {r[0]: r[1] for r in rows.groupBy("old_shard").agg(F.sum("size")).collect()}
    old = [sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]
    if isinstance(capacities, int):
        capacities = even(sum(old), capacities)
    flow = transfers(old, capacities)
    # where each block of an old shard ends; what stays comes first, as it holds the largest
    ends: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(old)):
        blocks = sorted(((j, b) for (a, j), b in flow.items() if a == i), key=lambda x: (x[0] != i, x[0]))
        at = 0
        for j, b in blocks:
            at += b
            ends.setdefault(i, []).append((at, j))
    rows = _running(rows, "old_shard", F.col("size"), "__from", order)
    middle = F.col("__from") + F.col("size") / 2
    shard = F.lit(0)
    for i, cuts in ends.items():
        place = F.lit(cuts[-1][1])
        for end, j in reversed(cuts[:-1]):
            place = F.when(middle <= end, F.lit(j)).otherwise(place)
        shard = F.when(F.col("old_shard") == i, place).otherwise(shard)
    rows = cut_lineage(rows.withColumn("shard", shard.cast("int")).drop("__from"))
    rows = _running(rows, "shard", F.lit(1), "slot", ["old_shard", *order])
    return rows.select("doc_id", "size", "text_crc32", "old_shard", "shard", F.col("slot").cast("long").alias("slot"))


def write_shards(documents: DataFrame, shard: Column, path: str) -> None:
    """Writes the documents as ``path/shard=N``, without moving a text between tasks."""
    written = documents.withColumn("shard", shard.cast("int")).write
    written.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType, shards: list[int] | None = None) -> DataFrame:
    """The rows of the shards under ``path`` (all, or those named) with their ``shard``;
    ``schema`` is that of a row without it."""
    rows = spark.read.schema(StructType([*schema.fields]).add("shard", "integer")).parquet(path)
    return rows if shards is None else rows.filter(F.col("shard").isin(shards))


def with_file_row(stored: DataFrame) -> DataFrame:
    """Rows of Parquet files with ``__row``: the file and the place in it, which no other row has."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    return stored.select("*", place.alias("__row"))


def _numbered(rows: DataFrame, same: list[str], by: list[Column]) -> DataFrame:
    """The rows with ``__copy``, which numbers those that agree in ``same`` from 0, in the
    order of ``by``. Ranges cut through a group of any size, so no group has to fit one task."""
    rows = rows.withColumn("__group", F.struct(*same))
    rows = cut_lineage(rows.repartitionByRange("__group", *by).withColumn("__part", F.spark_partition_id()))
    return _running(rows, "__group", F.lit(1), "__copy", by).drop("__group", "__part", "__within")


def rewrite_affected(documents: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Writes anew the shards that give or get documents, as ``path/shard=N``, and returns
    their numbers. Shards that don't appear keep their files.

    ``documents`` has doc_id, text and any other columns but old_shard, shard and slot;
    ``placed`` is what ``reshard`` returned for it. Rows that repeat a doc_id and a text
    take the places of these, one each. Where ``documents`` has ``__row`` (see
    ``with_file_row``) it tells the rows apart; otherwise they are stored first. Only ids,
    sizes and places are ordered: a text moves once, to its place. Files also have ``slot`` and
    ``old_shard``.
    """
    moved = placed.filter("old_shard <> shard")
    ends = moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()
    affected = sorted(r[0] for r in ends.collect())
    if not affected:
        return []
    if "__row" not in documents.columns:
        documents = with_file_row(cut_lineage(documents))
    key = ["__id", "__null", "__crc", "__size"]

    def keyed(df: DataFrame, size: Column, crc: Column, *more: str) -> DataFrame:
        number = F.col("doc_id").cast("long")
        columns = [F.coalesce(number, F.lit(0)), number.isNull(), crc, size.cast("long")]
        return df.select(*(c.alias(n) for c, n in zip(columns, key)), *more)

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed(documents, F.octet_length(text) + 1, F.crc32(text.cast("binary")), "__row")
    rows = _numbered(rows, key, [F.col("__row")])
    places = keyed(placed, F.col("size"), F.col("text_crc32"), "shard", "slot", "old_shard")
    places = _numbered(places, key, [F.col("shard"), F.col("slot")]).filter(F.col("shard").isin(affected))
    targets = rows.join(places, [*key, "__copy"]).select("__row", "shard", "slot", "old_shard")
    out = documents.join(targets, "__row").drop("__row")
    out.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return affected


def layout(spark: SparkSession, schema: StructType, old: str, new: str, affected: list[int]) -> DataFrame:
    """What the files hold after ``rewrite_affected``: doc_id, size, text_crc32, old_shard, shard, slot.

    Affected shards are read from ``new``, all others from ``old``, where they stay as they
    are; the slots of these follow from size, text hash and id, as in ``reshard``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    rows = read_shards(spark, old, schema).filter(~F.col("shard").isin(affected))
    rows = rows.select("doc_id", size, crc, F.col("shard").alias("old_shard"), "shard", F.xxhash64(text).alias("__hash"))
    kept = _numbered(rows, ["shard"], [F.desc("size"), F.asc("__hash"), F.asc("doc_id")]).drop("__hash")
    kept = kept.withColumn("__copy", F.col("__copy").cast("long")).withColumnRenamed("__copy", "slot")
    if not affected:
        return kept
    fields = StructType([*schema.fields]).add("slot", "long").add("old_shard", "integer")
    moved = read_shards(spark, new, fields, affected).select("doc_id", size, crc, "old_shard", "shard", "slot")
    return moved.unionByName(kept)
