"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Every child of a node draws ``-ln(u) / weight`` for a key, with ``u`` from a hash of the key and the
child's name; the smallest draw wins. A child's draw depends on no sibling, so a change of one weight
moves keys only into or out of the subtree that holds it. A new shard opens a region of its own, so it
takes keys and no two old shards exchange any (law ``key``).
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Within a shard, rows are numbered bucket by bucket, ranges of a hash, so that no task sees a whole shard: so many rows a bucket, on average.
BUCKET_ROWS = 8_192
_CHILDREN = "map<string,array<struct<node:string,weight:double>>>"


@dataclass(frozen=True)
class Topology:
    """Regions of racks of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def uniform(shards: int, shards_per_rack: int = 2, racks_per_region: int = 2) -> Topology:
        racks = [tuple((s, 1.0) for s in range(i, min(i + shards_per_rack, shards))) for i in range(0, shards, shards_per_rack)]
        return Topology(tuple(tuple(racks[i : i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))

    def grown(self, weight: float = 1.0) -> Topology:
        """With one more shard, alone in a rack and region of its own."""
        new = 1 + max(s for region in self.regions for rack in region for s, _ in rack)
        return Topology((*self.regions, (((new, weight),),)))

    def reweighted(self, shard: int, weight: float) -> Topology:
        return Topology(tuple(tuple(tuple((s, weight if s == shard else w) for s, w in rack) for rack in region) for region in self.regions))

    def children(self) -> dict[str, list[dict]]:
        """Node name to its children with the weight of all that lies below; weightless ones are left out."""
        out: dict[str, list[dict]] = {"": []}
        for i, region in enumerate(self.regions):
            weigh = lambda rack: sum(w for _, w in rack)
            out[""].append({"node": f"r{i}", "weight": sum(map(weigh, region))})
            out[f"r{i}"] = [{"node": f"r{i}/k{k}", "weight": weigh(rack)} for k, rack in enumerate(region)]
            for k, rack in enumerate(region):
                out[f"r{i}/k{k}"] = [{"node": f"r{i}/k{k}/s{s}", "weight": w} for s, w in rack]
        return {node: [x for x in below if x["weight"] > 0] for node, below in out.items()}


def uniform_draw(key: Column, node: Column) -> Column:
    """A number over 0 and up to 1 from 52 bits of the md5 of key and node."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), node).cast("binary")), 1, 13), 16, 10)
    return (bits.cast("double") + 1.0) / F.lit(float(2**52))


def place(df: DataFrame, key: str, topology: Topology, out: str) -> DataFrame:
    """``df`` with the shard of each key in ``out``. A null key is a key of its own."""
    children = F.from_json(F.lit(json.dumps(topology.children())), _CHILDREN)
    node: Column = F.lit("")
    for _level in ("region", "rack", "shard"):
        drawn = F.transform(
            F.element_at(children, node),
            lambda c: F.struct((-F.ln(uniform_draw(F.col(key), c["node"])) / c["weight"]).alias("draw"), c["node"].alias("node")),
        )
        node = F.array_min(drawn)["node"]
    return df.withColumn(out, F.element_at(F.split(node, "/s"), -1).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per document with its shard, its place there and its shard after one more is added.

    Keys are ``doc_id``; rows that share one share a shard. Null texts count as empty, with one byte
    of size; identical rows get slots of their own; an empty table gives no rows; other columns of
    ``docs`` are not looked at.
    """
    topology = Topology.uniform(shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = common.keep(facts.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")))
    # a bucket is a range of hashes, so slots follow the hash however many buckets there are
    buckets = rows.count() // (shards * BUCKET_ROWS) + 1
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32").cast("binary")), 1, 8), 16, 10).cast("long")
    placed = place(place(rows, "doc_id", topology, "shard"), "doc_id", topology.grown(), "grown_shard").withColumn("h", h).withColumn("bucket", F.shiftright(F.col("h") * F.lit(buckets), 32))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    slots = placed.withColumn("first", F.coalesce(F.sum("copies").over(within), F.lit(0))).join(starts, ["shard", "bucket"])
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("first") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7; edge cases as ``shard_documents`` states."""
    return shard_documents(common.read(spark, sf_dir, "documents"))


def _descent_sql(topology: Topology, out: str) -> str:
    """Three steps down a tree: the child with the least draw, by md5 of key and node."""
    rows = ", ".join(f"('{parent}', '{c['node']}', {c['weight']!r}::double)" for parent, below in topology.children().items() for c in below)
    draw = "-ln((('0x' || substr(md5(k || '|' || node), 1, 13))::bigint::double + 1.0) / 4503599627370496.0) / weight"
    steps, at = [f"{out}_t(parent, node, weight) as (values {rows})"], "(select distinct k, '' as here from d)"
    for level in range(3):
        steps.append(f"{out}_{level} as (select k, arg_min(node, {draw}) as here from {at} join {out}_t on parent = here group by k)")
        at = f"{out}_{level}"
    return ",\n".join(steps)


OP1_SQL = f"""
with poly as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256))::bigint as i)
  )
), d as (
  select doc_id, coalesce(doc_id::varchar, 'null') as k, hex(encode(coalesce(text, ''))) as b from documents
), f as (
  select doc_id, k, length(b) // 2 + 1 as size,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(b) // 2), lambda i: ('0x' || b[2 * i + 1:2 * i + 2])::bigint)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) as text_crc32
  from d, poly
), {_descent_sql(Topology.uniform(8), "old")}, {_descent_sql(Topology.uniform(8).grown(), "new")}, p as (
  select doc_id, size, text_crc32, split_part(o.here, '/s', 2)::int as shard, split_part(n.here, '/s', 2)::int as grown_shard,
         ('0x' || substr(md5(k || '|' || size || '|' || text_crc32), 1, 8))::bigint as h
  from f join old_2 o using (k) join new_2 n using (k)
)
select doc_id, size, text_crc32, 'key' as law, shard, row_number() over (partition by shard order by h, doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard from p
"""
