"""A Merkle manifest of a table: a digest of each row, of each group of rows and of the whole, and proofs of membership.

A row's place among the leaves of its group is the rank of its doc_id there. Ranks come from bitmaps, not from a sort: each group
has a word of 64 bits for every 64 consecutive ids of which it holds one, merged bit by bit where rows are read; a directory of
the words' population counts, in steps of 1,024, tells how many leaves precede a word, and the bits below an id tell the rest.
Leaves are then gathered by place, 512 to an array, and an array is reduced by three levels of the tree at once. Only digests
move between machines, never texts, and no task holds more than a few arrays, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Nodes that become one, and levels that one array reduces.
ARITY, LEVELS = 8, 3
SLOTS = ARITY**LEVELS
#: Bits of an entry's number in one step of the directory.
STEP_BITS = 10
#: The bitmaps of all groups are broadcast up to this size; beyond it the leaves are shuffled to them.
BROADCAST_BYTES = 8 << 20
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Copies that one row stands for until they get their places.
COPIES_AT_ONCE = 4_096


def digest(*parts: Column) -> Column:
    """The lower-case SHA-256 of joined texts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row's fields in order: ``-`` for a null, else the length of the value in UTF-8, a colon, the value."""
    told = [c.cast("string") for c in fields.values()]
    return digest(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in told])


def _group(lang: Column) -> Column:
    """A group's name as a text that is never null; null sorts before all others."""
    return F.coalesce(F.concat(F.lit("="), lang.cast("string")), F.lit(""))


def _before(counts: DataFrame, by: list[str], span: int) -> DataFrame:
    """``by``, k, before: how many the entries of ``counts`` (``by``, k from 0 to ``span``, n) with smaller k add up to.

    A directory with steps of 1,024: no window holds more entries than that, however many there are.
    """
    ordered = lambda *keys: Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda *keys: F.coalesce(F.sum("n").over(ordered(*keys)), F.lit(0).cast("long"))
    if span < 1 << STEP_BITS:
        return counts.select(*by, "k", earlier(*by).alias("before"))
    counts = counts.select(*by, "k", "n", F.shiftright("k", STEP_BITS).alias("step"))
    steps = _before(counts.groupBy(*by, F.col("step").alias("k")).agg(F.sum("n").alias("n")), by, span >> STEP_BITS)
    inside = counts.select(*by, "k", "step", earlier(*by, "step").alias("inside"))
    steps = steps.select(*by, F.col("k").alias("step"), "before")
    return inside.join(steps, [*by, "step"]).select(*by, "k", (F.col("before") + F.col("inside")).alias("before"))


def _small(df: DataFrame) -> DataFrame:
    """``df``, marked for a broadcast if a count of its rows shows that it is small."""
    return F.broadcast(df) if common.fits(df, BROADCAST_BYTES, 256) else df


def _words(leaves: DataFrame) -> DataFrame:
    """The bitmaps: grp, k, bits, n (rows, repeated ids with all of theirs)."""
    bit = F.expr("shiftleft(1L, place)")
    return common.keep(leaves.groupBy("grp", "k").agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n")))


def _ties(leaves: DataFrame, repeated: DataFrame) -> DataFrame:
    """Of rows that share group and id: grp, k, place, leaf, claim, doc_id, copies, and ``among``, the rows of the id with a lesser leaf.

    Rows with one leaf are one row here, so that a row that repeats without end is counted where it is read.
    """
    tied = leaves.join(_small(repeated.select("grp", "k", "place")), ["grp", "k", "place"], "left_semi")
    tied = common.keep(tied.groupBy("grp", "k", "place", "leaf").agg(F.first("doc_id").alias("doc_id"), F.first("claim").alias("claim"), F.count(F.lit(1)).alias("n")))
    tied = tied.withColumn("w", F.col("k")).withColumn("k", F.conv(F.substring("leaf", 1, 7), 16, 10).cast("long"))
    by = ["grp", "w", "place"]
    before = _before(tied.groupBy(*by, "k").agg(F.sum("n").alias("n")), by, (1 << 28) - 1)
    near = Window.partitionBy(*by, "k").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    tied = tied.withColumn("inside", F.coalesce(F.sum("n").over(near), F.lit(0))).join(before, [*by, "k"])
    return tied.select("grp", F.col("w").alias("k"), "place", "leaf", "claim", "doc_id", F.col("n").alias("copies"), (F.col("before") + F.col("inside")).alias("among"))


def ranked(leaves: DataFrame) -> DataFrame:
    """grp, slot, total, doc_id, leaf, claim: each row's place in its group by doc_id, then leaf, and the group's rows.

    ``leaves`` has grp, doc_id, leaf, claim. A row without a doc_id comes before all others.
    """
    told = leaves.agg(F.min(F.shiftright(F.col("doc_id").cast("long"), 6)).alias("low"), F.max(F.shiftright(F.col("doc_id").cast("long"), 6)).alias("high")).first()
    low, high = (told["low"] or 0) - 1, told["high"] or 0
    number = F.col("doc_id").cast("long")
    # rows without an id share a word of their own, before the first; others are counted from it on
    leaves = leaves.withColumn("k", F.coalesce(F.shiftright(number, 6) - F.lit(low), F.lit(0).cast("long"))).withColumn("place", F.coalesce(number.bitwiseAND(F.lit(63)), F.lit(0)).cast("int"))
    words = _words(leaves)
    totals = words.groupBy("grp").agg(F.sum("n").alias("total"))
    index = words.join(_before(words.select("grp", "k", "n"), ["grp"], high - low), ["grp", "k"]).join(_small(totals), "grp")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, place))")
    twice = words.where(F.col("n") > F.bit_count("bits"))
    if twice.take(1):
        repeated = leaves.join(_small(twice.select("grp", "k")), ["grp", "k"], "left_semi").groupBy("grp", "k", "place").agg((F.count(F.lit(1)) - 1).alias("more")).where("more > 0")
        repeated = common.keep(repeated)
        surplus = repeated.groupBy("grp", "k").agg(F.collect_list(F.struct("place", "more")).alias("surplus"))
        index = index.join(surplus, ["grp", "k"], "left")
        below = below + F.coalesce(F.aggregate(F.filter("surplus", lambda s: s["place"] < F.col("place")), F.lit(0).cast("long"), lambda a, s: a + s["more"]), F.lit(0))
        tied = _ties(leaves, repeated)
        once = leaves.join(_small(repeated.select("grp", "k", "place")), ["grp", "k", "place"], "left_anti")
        one = F.lit(1).cast("long")
        leaves = once.select("grp", "k", "place", "leaf", "claim", "doc_id", one.alias("copies"), (one - 1).alias("among")).unionByName(tied)
    index = common.keep(index.drop("n"))
    rows = leaves.join(F.broadcast(index) if common.fits(index, BROADCAST_BYTES, F.octet_length("grp") + 96) else index, ["grp", "k"])
    slot = F.col("before") + below
    if "copies" not in leaves.columns:
        return rows.select("grp", slot.alias("slot"), "total", "doc_id", "leaf", "claim")
    rows = rows.select("grp", (slot + F.col("among")).alias("slot"), "total", "doc_id", "leaf", "claim", "copies")
    # so many copies at a time, spread over the cluster, before each gets its place
    parts = rows.where("copies = 1").unionByName(
        rows.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_AT_ONCE}")))).repartition("grp", "slot", "part")
        .select("grp", (F.col("slot") + F.col("part") * COPIES_AT_ONCE).alias("slot"), "total", "doc_id", "leaf", "claim", F.least(F.lit(COPIES_AT_ONCE).cast("long"), F.col("copies") - F.col("part") * COPIES_AT_ONCE).alias("copies"))
    )
    each = parts.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return each.select("grp", (F.col("slot") + F.col("copy")).alias("slot"), "total", "doc_id", "leaf", "claim")


def _merged(row: Column) -> Column:
    """The digests of the runs of a row of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(row, k * ARITY + 1, ARITY), ""), 256))


def _arrays(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes (grp, slot, total, leaf, and what is carried) in arrays of 512 by place, with the three levels above them.

    grp, part, total, items (in order of place), a0 to a3: the digests of each level; null where the level below is one node.
    """
    gathered = nodes.groupBy("grp", F.shiftright("slot", SLOTS.bit_length() - 1).alias("part")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(F.struct("slot", "leaf", *carried))).alias("items"))
    out = gathered.withColumn("a0", F.transform("items", lambda x: x["leaf"]))
    left = F.col("total")
    for level in range(LEVELS):
        out = out.withColumn(f"a{level + 1}", F.when(left > 1, _merged(F.col(f"a{level}"))))
        left = F.ceil(left / ARITY)
    return common.keep(out)


def _tree(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of each round, the leaves' first, and (grp, top)."""
    rounds, tops = [], None
    while True:
        arrays = _arrays(nodes, carried)
        rounds.append(arrays)
        top = F.get(F.coalesce("a3", "a2", "a1", "a0"), F.lit(0))
        done = arrays.where(F.col("total") <= SLOTS).select("grp", top.alias("top"))
        tops = done if tops is None else tops.unionByName(done)
        open_ = arrays.where(F.col("total") > SLOTS)
        if not open_.take(1):
            return rounds, tops
        nodes, carried = open_.select("grp", F.col("part").alias("slot"), F.ceil(F.col("total") / SLOTS).alias("total"), top.alias("leaf")), []


_STEP = "struct<l: string, r: string>"


def _steps(i: Column) -> Column:
    """What stands left and right of the i-th item's node in its run, at each of the array's levels."""
    steps = []
    for level in range(LEVELS):
        at = F.floor(i / ARITY**level).cast("int")
        begin, row = at - at % ARITY, F.col(f"a{level}")
        steps.append(F.struct(F.array_join(F.slice(row, begin + 1, at - begin), "").alias("l"), F.array_join(F.slice(row, at + 2, ARITY - 1 - at + begin), "").alias("r")))
    levels = sum((F.col(f"a{level}").isNotNull().cast("int") for level in range(1, LEVELS + 1)), F.lit(0))
    return F.slice(F.array(*steps), F.lit(1), levels)


def _with_above(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The leaves' arrays with ``above``, the steps from their own node to the root, given (grp, top, above) of the groups."""
    # a group's last round is the one in which its nodes fit one array
    known = None
    for arrays in reversed(rounds):
        last = arrays.where(F.col("total") <= SLOTS).join(_small(tops), "grp")
        if known is not None:
            more = arrays.where(F.col("total") > SLOTS).join(known, (arrays["grp"] == known["k_grp"]) & (arrays["part"] == known["k_slot"])).drop("k_grp", "k_slot")
            last = last.unionByName(more)
        if arrays is rounds[0]:
            return last
        path = F.transform("items", lambda x, i: F.struct(x["slot"].alias("k_slot"), F.concat(_steps(i), F.col("above")).alias("above")))
        known = last.select(F.col("grp").alias("k_grp"), "top", F.inline(path))
    raise AssertionError("no rounds")


def _folded(start: Column, steps: Column) -> Column:
    return F.aggregate(steps, start, lambda node, s: digest(s["l"], node, s["r"]))


def manifest(docs: DataFrame, leaf_of: Column, claim: Column, group: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, steps, folded_root, verified.

    ``leaf_of`` is a row's digest and ``claim`` the digest that it is said to have; ``steps`` has the digests left and right of
    the row's node at each level from the leaf to the root, and ``folded_root`` is what they make of the claim. Leaves stand in
    order of doc_id within a group, groups in order of their names in UTF-8. A null group comes before all others and a null
    doc_id before all of its group; rows that share a doc_id stand in order of their leaves, and each row that
    repeats is a leaf of its own. An empty table gives no rows. Other columns are not looked at.
    """
    leaves = docs.select(_group(F.col(group)).alias("grp"), docs["doc_id"].alias("doc_id"), leaf_of.alias("leaf"), claim.alias("claim"))
    rounds, tops = _tree(ranked(leaves), ["doc_id", "claim"])
    # one row a group: as many as there are languages
    place = (F.row_number().over(Window.orderBy("grp")) - 1).cast("long")
    of_groups = tops.select("grp", F.col("top").alias("leaf"), place.alias("slot"), F.count(F.lit(1)).over(Window.partitionBy()).alias("total"))
    upper, root = _tree(of_groups.select(F.lit("").alias("grp"), "slot", "total", "leaf", F.col("grp").alias("own")), ["own"])
    over = _with_above(upper, root.select("grp", "top", F.array().cast(f"array<{_STEP}>").alias("above")))
    own = F.transform("items", lambda x, i: F.struct(x["own"].alias("grp"), x["leaf"].alias("subroot"), F.concat(_steps(i), F.col("above")).alias("above")))
    tops = common.keep(over.select(F.col("top").alias("root"), F.inline(own)).select("grp", F.struct("root", "subroot").alias("top"), "above"))
    arrays = _with_above(rounds, tops)
    # in one step, so that no row carries its array along
    told = F.transform("items", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), x["claim"].alias("claim"), F.concat(_steps(i), F.col("above")).alias("steps")))
    rows = arrays.select(F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), F.inline(told))
    rows = rows.select("doc_id", "leaf", "subroot", "root", "steps", _folded(F.col("claim"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and whether it still verifies where its text may have been tampered with; edge cases as ``manifest`` states."""
    docs = common.read(spark, sf_dir, "documents")
    fields = {c: F.col(c) for c in FIELDS}
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    tampered = leaf(fields | {"text": F.translate("text", upper, upper.lower())})
    own = leaf(fields)
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered).otherwise(own)
    found = manifest(docs, own, claim)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


def _sql() -> str:
    """The same by a sort: levels one by one, of the groups and then of the subroots."""
    depth, over = 10, 4
    field = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    own = "sha256(" + " || ".join(map(field, FIELDS)) + ")"
    tampered = "sha256(" + " || ".join(field(c if c != "text" else f"translate(text, '{upper}', '{upper.lower()}')") for c in FIELDS) + ")"
    out = [
        """with poly as (
  select list(c order by i) as t from (
    select i, list_reduce(list_prepend(i, range(8)), lambda c, _: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256))::bigint as i)
  )
)""",
        f"""d as (
  select doc_id, lang, {own} as leaf, {tampered} as other,
         xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen(doc_id::varchar)), lambda i: ascii((doc_id::varchar)[i + 1])::bigint)), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]))) as crc
  from documents, poly
)""",
        """s as (
  select doc_id, lang, leaf, case when crc % 3 = 0 then other else leaf end as claim,
         row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as slot, count(*) over (partition by lang) as n
  from d
)""",
        "n0 as (select lang, slot, leaf as h, n from s)",
    ]
    for k in range(depth):
        out.append(f"r{k} as (select lang, slot // 8 as slot, n, list(h order by slot) as hs from n{k} where n > 1 group by lang, slot // 8, n)")
        out.append(f"n{k + 1} as (select lang, slot, sha256(array_to_string(hs, '')) as h, (n + 7) // 8 as n from r{k})")
    out.append("m0 as (select lang, h, h as subroot, row_number() over (order by lang nulls first) - 1 as slot, count(*) over () as n from (" + " union all ".join(f"select lang, h from n{k} where n = 1" for k in range(depth + 1)) + "))")
    for k in range(over):
        out.append(f"q{k} as (select slot // 8 as slot, n, list(h order by slot) as hs from m{k} where n > 1 group by slot // 8, n)")
        out.append(f"m{k + 1} as (select slot, sha256(array_to_string(hs, '')) as h, (n + 7) // 8 as n from q{k})")
    out.append("top as (" + " union all ".join(f"select h as root from m{k} where n = 1" for k in range(over + 1)) + ")")
    steps = [(f"r{k}", f"(s.slot // {8**k})") for k in range(depth)] + [(f"q{k}", f"(m0.slot // {8**k})") for k in range(over)]
    joins = [f"left join r{k} on s.lang is not distinct from r{k}.lang and r{k}.slot = s.slot // {8 ** (k + 1)}" for k in range(depth)]
    joins += [f"left join q{k} on q{k}.slot = m0.slot // {8 ** (k + 1)}" for k in range(over)]
    sides = ", ".join(f"array_to_string({t}.hs[1:{at} % 8], '') as l_{t}, array_to_string({t}.hs[{at} % 8 + 2:8], '') as r_{t}" for t, at in steps)
    out.append(f"p as (select s.doc_id, s.leaf, s.claim as f_, m0.subroot, {sides} from s join m0 on s.lang is not distinct from m0.lang\n  " + "\n  ".join(joins) + ")")
    at = "p"
    for t, _ in steps:
        out.append(f"f_{t} as (select * replace (case when l_{t} is null then f_ else sha256(l_{t} || f_ || r_{t}) end as f_) from {at})")
        at = f"f_{t}"
    proof = " || ".join(f"coalesce(l_{t} || r_{t}, '')" for t, _ in steps)
    return ",\n".join(out) + f"\nselect doc_id, leaf, subroot, root, sha256({proof}) as proof_sha256, f_ as folded_root, f_ = root as verified from {at}, top"


OP12_SQL = _sql()
