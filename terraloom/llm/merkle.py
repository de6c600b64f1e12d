"""A Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups' roots, and a proof per row.

A leaf's place in its group's tree is its rank by id, and ranks come from bitmaps instead of a sort. Ids of a group are cut into chunks of 32,768; a chunk
holds, for every bit of the ids' repeat counts (just one where ids are unique), the set of ids with that bit, as a bitmap with a popcount directory or, if
sparse, as the positions themselves. What lies before a chunk is summed level by level over the digits of the chunk's number, in windows of at most 65,536
rows. A rank is then that base, plus the directory's entry, plus the ones before the id's own bit. Rows that share an id are ranked by their leaves
in the same way (a leaf's digits are the levels), so that neither a hot id nor a hot group gathers its rows anywhere.

Ranks are dealt to slot arrays of 4,096 leaves keyed by (group, block): a task fills a block's slots by rank, reduces its twelve levels and keeps the root; block
roots are leaves of the next round, until a group has one node. Back down, a block gets the siblings above it, and with them proofs and folded roots are
made where its slots are. Texts are read once and only hashes leave that pass.

Defined cases: a null value is ``-`` in the leaf; null groups come first; a null id comes before all others; rows of one group and id are ordered by their leaves;
rows that are the same in all columns of the leaf have equal leaves in neighbouring places, and each has the proof of its own place. A null id is never among
the tampered. A lone leaf is its group's root, a lone group's root is the root; a proof without siblings is the hash of nothing. An empty table gives an
empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraloom.llm.common import forget, written

LEVELS = 12
BLOCK = 1 << LEVELS
CHUNK = 1 << 15
WORD_BITS = 512
SPARSE = 64


def leaf_hash(columns: list[Column]) -> Column:
    """Hex SHA-256 of the columns, each ``-`` if null, else its length in bytes, ``:`` and its value."""
    value = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in value]), 256)


def numbered(values: DataFrame, col: str) -> DataFrame:
    """(col, g): the distinct values numbered from 0 in order, null first. Ranges are sorted apart and counted; no task sees all values."""
    sorted_ = values.select(col).distinct().repartitionByRange(F.col(col).asc_nulls_first()).withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy(F.col(col).asc_nulls_first())
    placed = written(sorted_.withColumn("at", F.row_number().over(w) - 1), "numbered")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return placed.join(before, "part").select(col, (F.coalesce("before", F.lit(0)) + F.col("at")).cast("long").alias("g"))


def _before(counts: DataFrame, levels: list[tuple[list[str], str]]) -> DataFrame:
    """Adds ``before``: the rows of counts (n) that come before, over nested digits. levels: (keys of the parent, digit), the coarsest first; a window has
    the digits of one parent only."""
    out = counts.withColumn("before", F.lit(0).cast("long"))
    for keys, digit in levels:
        w = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.groupBy(*keys, digit).agg(F.sum("n").alias("m")).withColumn("own", F.coalesce(F.sum("m").over(w), F.lit(0))).drop("m")
        out = out.join(sums, [*keys, digit]).withColumn("before", F.col("before") + F.col("own")).drop("own")
    return out


def _chunks(ids: DataFrame) -> DataFrame:
    """Distinct (g, id, m), m the id's repeats -> a row per chunk: (g, chunk, base, slices of (weight, bits, directory, sparse))."""
    slots = ids.select("g", F.shiftright("id", 15).alias("chunk"), (F.col("id").bitwiseAND(F.lit(CHUNK - 1))).alias("at"), "m")
    sliced = slots.select("g", "chunk", "at", F.explode(F.filter(F.array(*[F.lit(1 << j).cast("long") for j in range(63)]), lambda w: F.col("m").bitwiseAND(w) != 0)).alias("weight"))
    # At most 32,768 positions by construction.
    sets = sliced.groupBy("g", "chunk", "weight").agg(F.collect_list("at").alias("ats"))
    dense = sets.where(F.size("ats") > SPARSE).select("g", "chunk", "weight", F.explode("ats").alias("at")).groupBy("g", "chunk", "weight").agg(F.bitmap_construct_agg("at").alias("bits"))
    blocks = F.sequence(F.lit(0), F.lit(CHUNK // WORD_BITS - 1))
    ones = F.transform(blocks, lambda k: F.bitmap_count(F.substring("bits", k * (WORD_BITS // 8) + 1, F.lit(WORD_BITS // 8))))
    dense = dense.withColumn("ones", ones).withColumn("directory", F.transform(blocks, lambda k: F.aggregate(F.slice("ones", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)))
    empty = F.array().cast("array<long>")
    dense = dense.select("g", "chunk", F.struct("weight", "bits", "directory", empty.alias("sparse")).alias("s"))
    sparse = sets.where(F.size("ats") <= SPARSE).select("g", "chunk", F.struct("weight", F.lit(None).cast("binary").alias("bits"), empty.alias("directory"), F.col("ats").cast("array<long>").alias("sparse")).alias("s"))
    whole = dense.unionByName(sparse).groupBy("g", "chunk").agg(F.collect_list("s").alias("slices"))
    counts = slots.groupBy("g", "chunk").agg(F.sum("m").alias("n"))
    digits = counts.withColumns({"c3": F.shiftright("chunk", 32), "c2": F.shiftright("chunk", 16).bitwiseAND(F.lit(0xFFFF)), "c1": F.col("chunk").bitwiseAND(F.lit(0xFFFF))})
    base = _before(digits, [(["g"], "c3"), (["g", "c3"], "c2"), (["g", "c3", "c2"], "c1")])
    return whole.join(base.select("g", "chunk", F.col("before").alias("base")), ["g", "chunk"])


def _rank(at: Column) -> Column:
    """How many ids of the chunk, repeats counted, lie before position ``at``."""
    block, byte, bit = F.floor(at / WORD_BITS).cast("int"), F.floor(at / 8).cast("int"), (at % 8).cast("int")

    def below(s: Column) -> Column:
        start = block * (WORD_BITS // 8)
        whole = F.bitmap_count(F.substring(s["bits"], start + 1, byte - start))
        last = F.conv(F.hex(F.substring(s["bits"], byte + 1, F.lit(1))), 16, 10).cast("int")
        part = F.bit_count(last.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit) - 1))
        dense = F.get(s["directory"], block) + whole + part
        return s["weight"] * F.when(s["bits"].isNull(), F.size(F.filter(s["sparse"], lambda p: p < at)).cast("long")).otherwise(dense)

    return F.aggregate("slices", F.lit(0).cast("long"), lambda a, s: a + below(s))


def _tied(rows: DataFrame) -> DataFrame:
    """Rows (g, no_id, id, leaf, n) of ids with different leaves, n rows of each -> ``tie``: rows of the same id whose leaf comes before."""
    # Hex digits of the leaf, four at a time; twelve of them leave few leaves to a window.
    cut = rows.withColumns({f"d{k}": F.substring("leaf", 1 + 4 * k, 4 if k < 3 else 64) for k in range(4)})
    own = ["g", "no_id", "id"]
    return _before(cut, [([*own, *[f"d{j}" for j in range(k)]], f"d{k}") for k in range(4)]).select(*own, "leaf", F.col("before").alias("tie"))


def _h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _tree(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and what they reduce to, level by level."""
    out = [nodes]
    for _ in range(levels):
        now = out[-1]
        out.append([_h("".join(now[k : k + 2])) for k in range(0, len(now), 2)])
    return out


def _block_root(table: pa.Table) -> pa.Table:
    """One block: slots filled by place, reduced to its root; a group's last block stops where one node is left, as there is none beside it."""
    slot, node, n = table.column("slot").to_pylist(), table.column("node").to_pylist(), table.column("n")[0].as_py()
    block = slot[0] // BLOCK
    slots: list[str] = [""] * len(slot)
    for s, v in zip(slot, node):
        slots[s % BLOCK] = v
    levels = LEVELS if n > BLOCK else (n - 1).bit_length()
    root = _tree(slots, levels)[-1][0]
    return pa.table({"g": [table.column("g")[0].as_py()], "slot": [block], "node": [root], "n": [-(-n // BLOCK)]}, schema=pa.schema([("g", pa.int64()), ("slot", pa.int64()), ("node", pa.string()), ("n", pa.int64())]))


def _steps(slots: list[str], levels: int) -> Iterator[list[str]]:
    """For each slot its way up: per level ``L`` and the left sibling, ``R`` and the right one, or ``-`` without any."""
    tree = _tree(slots, levels)
    for k in range(len(slots)):
        way = []
        for level in range(levels):
            i, row = k >> level, tree[level]
            way.append("L" + row[i - 1] if i & 1 else "R" + row[i + 1] if i + 1 < len(row) else "-")
        yield way


def _spread(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The way up of every slot of one block: within the block, then what the block has above it."""
    slot, node, n = nodes.column("slot").to_pylist(), nodes.column("node").to_pylist(), nodes.column("n")[0].as_py()
    upper = above.column("way")[0].as_py() if above.num_rows else []
    slots: list[str] = [""] * len(slot)
    for s, v in zip(slot, node):
        slots[s % BLOCK] = v
    ways = list(_steps(slots, LEVELS if n > BLOCK else (n - 1).bit_length()))
    return pa.table({"g": nodes.column("g"), "slot": nodes.column("slot"), "way": pa.array([ways[s % BLOCK] + upper for s in slot], pa.list_(pa.string()))})


_NODE = "g long, slot long, node string, n long"
_WAY = "g long, slot long, way array<string>"


def _up(nodes: DataFrame) -> list[DataFrame]:
    """The rounds of (g, slot, node, n), the first as given, until every group has one node; n is the group's number of nodes of that round."""
    rounds = [nodes]
    while rounds[-1].where("n > 1").limit(1).count():
        now = rounds[-1].withColumn("block", F.shiftright("slot", LEVELS))
        rounds.append(written(now.groupBy("g", "block").applyInArrow(_block_root, _NODE), "roots"))
    return rounds


def _down(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """From the way of each group's root (g, slot 0, way) to those of all blocks of the first round: (g, slot of the block, way)."""
    ways = top
    for now in reversed(rounds[1:-1]):
        blocks = now.withColumn("block", F.shiftright("slot", LEVELS))
        upper = ways.withColumnRenamed("slot", "block")
        ways = written(blocks.groupBy("g", "block").cogroup(upper.groupBy("g", "block")).applyInArrow(_spread, _WAY), "ways")
    return ways


def _fold(node: str, way: list[str]) -> str:
    for step in way:
        node = _h(step[1:] + node) if step[0] == "L" else _h(node + step[1:])
    return node


def _proved(key: tuple, leaves: pa.Table, above: pa.Table) -> pa.Table:
    """The rows of one block with proof and folded root."""
    ways = _spread(key, leaves.rename_columns(["node" if c == "leaf" else c for c in leaves.column_names]), above).column("way").to_pylist()
    given = leaves.column("given").to_pylist()
    proof = [_h("".join(s[1:] for s in way)) for way in ways]
    folded = [_fold(v, way) for v, way in zip(given, ways)]
    return pa.table({"g": leaves.column("g"), "id": leaves.column("id"), "leaf": leaves.column("leaf"), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(folded, pa.string())})


def _placed(leaves: DataFrame) -> DataFrame:
    """leaves (g, id, leaf, given) with ``slot``, the place of each among those of its group."""
    own = ["g", "no_id", "id"]
    # Equal rows are one row with their number until places are known.
    kinds = leaves.groupBy("g", F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0).cast("long")).alias("id"), "leaf", "given").agg(F.count("*").alias("copies"))
    ids = written(kinds.groupBy(*own).agg(F.sum("copies").alias("m"), F.count("*").alias("kinds")), "ids")
    nulls = ids.where("no_id").select("g", F.col("m").alias("nulls"))
    chunks = _chunks(ids.where("NOT no_id").select("g", "id", "m"))
    split = kinds.withColumns({"chunk": F.when(~F.col("no_id"), F.shiftright("id", 15)), "at": F.col("id").bitwiseAND(F.lit(CHUNK - 1))})
    zero = F.lit(0).cast("long")
    ranked = split.join(chunks, ["g", "chunk"], "left").join(nulls, "g", "left")
    first = F.when(F.col("no_id"), zero).otherwise(F.coalesce("nulls", zero) + F.col("base") + _rank(F.col("at")))
    ranked = ranked.select(*own, "leaf", "given", "copies", first.alias("first"))
    shared = ids.where("kinds > 1").select(*own)
    if not shared.isEmpty():
        ties = _tied(kinds.join(shared, own, "left_semi").select(*own, "leaf", F.col("copies").alias("n")))
        ranked = ranked.join(ties, [*own, "leaf"], "left").withColumn("first", F.col("first") + F.coalesce("tie", zero))
    places = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    return ranked.select("g", F.when(~F.col("no_id"), F.col("id")).alias("id"), "leaf", "given", places.alias("slot"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), number_col: str = "n_chars", every: int = 7) -> DataFrame:
    """Per row: (id, leaf, subroot, root, proof_sha256, folded_root, verified).

    ``every``: rows whose crc32 of the decimal id it divides are checked in a tampered form, whose ``number_col`` is one higher.
    """
    tampered = F.crc32(F.col(id_col).cast("string")) % every == 0
    one_more = (F.col(number_col).cast("decimal(38,0)") + 1).cast("decimal(38,0)")
    hashed = docs.select(
        F.col(group_col).alias("group"),
        F.col(id_col).cast("long").alias("id"),
        leaf_hash([F.col(c) for c in columns]).alias("leaf"),
        F.when(tampered, leaf_hash([one_more if c == number_col else F.col(c) for c in columns])).alias("bad"),
    )
    hashed = written(hashed, "leaves")
    groups = numbered(hashed, "group")
    sizes = written(hashed.groupBy("group").agg(F.count("*").alias("n")).join(groups.withColumnRenamed("group", "named"), F.col("group").eqNullSafe(F.col("named"))).select("group", "g", "n"), "groups")
    keyed = hashed.join(sizes.withColumnRenamed("group", "named"), F.col("group").eqNullSafe(F.col("named"))).select("g", "id", "leaf", F.coalesce("bad", "leaf").alias("given"))
    placed = written(_placed(keyed).join(sizes.select("g", "n"), "g"), "placed")
    forget(hashed)
    rounds = _up(placed.select("g", "slot", F.col("leaf").alias("node"), "n"))
    subroots = rounds[-1].select(F.col("g").alias("slot"), "node")
    # The tree over the groups: their numbers are the places.
    crown = _up(subroots.select(F.lit(0).cast("long").alias("g"), "slot", "node", F.lit(sizes.count()).cast("long").alias("n")))
    last = crown[-1].first()
    above = docs.sparkSession.createDataFrame([], _WAY)
    for now in reversed(crown[:-1]):
        blocks = now.withColumn("block", F.shiftright("slot", LEVELS))
        above = blocks.groupBy("g", "block").cogroup(above.withColumnRenamed("slot", "block").groupBy("g", "block")).applyInArrow(_spread, _WAY)
    way = F.coalesce(F.col("way"), F.array().cast("array<string>"))
    tops = written(subroots.join(above.select("slot", "way"), "slot", "left").select(F.col("slot").alias("g"), F.lit(0).cast("long").alias("slot"), way.alias("way"), F.col("node").alias("subroot")), "tops")
    ways = _down(rounds, tops.select("g", "slot", "way"))
    for table in [*crown[1:], *rounds[1:], sizes]:
        forget(table)
    blocks = placed.withColumn("block", F.shiftright("slot", LEVELS))
    proved = blocks.groupBy("g", "block").cogroup(ways.withColumnRenamed("slot", "block").groupBy("g", "block")).applyInArrow(_proved, "g long, id long, leaf string, proof_sha256 string, folded_root string")
    out = proved.join(tops.select("g", "subroot"), "g").withColumn("root", F.lit(last.node if last else None).cast("string"))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
