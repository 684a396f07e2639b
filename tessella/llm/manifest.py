"""A Merkle manifest of a table, and for every row the proof that it belongs to it.

Rows are leaves in the order of their ids, one tree for each source; FAN consecutive nodes become one node above, and
the trees' roots, in the order of the sources, are the leaves of a tree of their own. A node has three coordinates: tree
(0 is the tree of roots), level, place. All nodes are one written table. A proof is looked up, not built along the way:
from its place and its tree's size a leaf works out the coordinates of the siblings it needs, one row each, which are
joined with the node table, put in order, and concatenated or folded.

The siblings below level OWN differ from leaf to leaf, and a node there is asked for by FAN ** OWN leaves at most. Those
above are the same for all leaves of a block of FAN ** OWN; a block asks once, for all of them, over SALTS copies of those
nodes, so that the nodes next to the root, which every block needs, don't meet in one task. Ranges of rows are sorted and
counted in place of a window over a source, so a source may hold any share of the rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import apart, stored

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: Levels whose siblings a leaf asks for itself; its block asks for those above.
OWN = 2
BLOCK_BITS = FAN_BITS * OWN
SALTS = 16
#: Steps of a fold: levels of the own tree, then the root of that tree, then levels of the tree of roots.
SUBROOT, TOP = 62, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(*values: Column) -> Column:
    """SHA-256, binary, of the values: ``-`` for null, else the byte count, a colon, the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def ranked(rows: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Written rows in order with ``part`` and ``row``, and one row for each group and part with ``first``, ``n``, ``before``.

    A row's place in its group is ``row - first + before``. Rows are dealt by ranges of the group and the order together,
    so a group of any size lies in as many parts as it needs.
    """
    keys = [*group, *order]
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    laid = stored(laid.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "manifest-order")
    runs = laid.groupBy(*group, "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return laid, runs.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def levels_above(nodes: DataFrame) -> list[DataFrame]:
    """Written levels of all trees, the given one (``tree``, ``pos``, ``size``: nodes of the tree at this level, ``digest``) first."""
    out, level, size = [nodes], nodes, nodes.agg(F.max("size")).first()[0] or 0
    while size > 1:
        kids = level.where("size > 1").groupBy("tree", F.shiftright("pos", FAN_BITS).alias("pos"), F.expr(f"shiftright(size - 1, {FAN_BITS}) + 1").alias("size"))
        joined = F.concat_ws("", F.transform(F.sort_array("kids"), lambda k: hexed(k["digest"])))
        level = stored(kids.agg(F.collect_list(F.struct("pos", "digest")).alias("kids")).select("tree", "pos", "size", F.unhex(F.sha2(joined, 256)).alias("digest")), "manifest-level")
        out.append(level)
        size = (size - 1 >> FAN_BITS) + 1
    return out


def siblings(pos: str, last: str, low: int, high: int, tree: str, step: int = 0) -> str:
    """SQL: the coordinates of the siblings of a leaf at ``pos`` on levels low to high of a tree whose last leaf is ``last``."""
    run = f"shiftright({pos}, {FAN_BITS} * l + {FAN_BITS}) * {FAN}"
    near = f"filter(sequence({run}, least({run} + {FAN - 1}, shiftright({last}, {FAN_BITS} * l))), p -> p <> shiftright({pos}, {FAN_BITS} * l))"
    return f"flatten(transform(sequence({low}, {high}), l -> transform({near}, p -> named_struct('tree', {tree}, 'level', l, 'pos', p, 'step', l + {step}))))"


def height(last: str) -> str:
    """SQL: levels above the leaves of a tree."""
    return f"size(filter(sequence(0, 15), l -> shiftright({last}, {FAN_BITS} * l) > 0))"


def prove(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row.

    Nulls are values of their own, in every column; the null source is a source. Rows that repeat an id are leaves one
    after another in the order of their digests; a null id comes first and is never tampered with. Columns beyond the five are ignored. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    whole = [docs[c] for c in FIELDS]
    bad = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, leaf_digest(*whole[:-1], lowered(docs["text"].cast("string"))))
    key = F.coalesce(F.unhex(F.sha2(docs["source"].cast("string"), 256)), F.unhex(F.lit("")))
    rows = docs.select(key.alias("key"), docs["doc_id"].cast("long").alias("doc_id"), leaf_digest(*whole).alias("leaf"), bad.alias("bad"), F.monotonically_increasing_id().alias("nth"))
    laid, runs = ranked(stored(rows, "manifest-rows"), ["key"], ["doc_id", "leaf", "nth"])

    names = docs.select(docs["source"].cast("string").alias("name"), key.alias("key")).distinct()
    order, ends = ranked(names, [], ["name"])
    trees = order.join(apart(ends), "part").select("key", (F.col("row") - F.col("first") + F.col("before") + 1).alias("tree"))
    sizes = runs.groupBy("key").agg((F.sum("n") - 1).alias("last"))
    runs = runs.join(apart(trees.join(sizes, "key")), "key").select("key", "part", (F.col("before") - F.col("first")).alias("shift"), "tree", "last")
    leaves = laid.join(apart(runs), ["key", "part"]).select("tree", (F.col("row") + F.col("shift")).alias("pos"), "last", "doc_id", "leaf", "bad")
    leaves = stored(leaves, "manifest-leaves")

    own = levels_above(leaves.select("tree", "pos", (F.col("last") + 1).alias("size"), F.col("leaf").alias("digest")))
    subroots = _all(own).where("size = 1")
    count = trees.count()
    if not count:
        return spark.createDataFrame([], SCHEMA)
    top = levels_above(stored(subroots.select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("pos"), F.lit(count).cast("long").alias("size"), "digest"), "manifest-top"))
    root = top[-1].first()["digest"].hex()
    nodes = _all(own).unionAll(_all(top)).drop("size")

    low = leaves.select("tree", "pos", F.expr(siblings("pos", "last", 0, OWN - 1, "tree")).alias("coords"))
    low = _found(low, nodes.where((F.col("level") < OWN) & (F.col("tree") > 0)), [])
    blocks = leaves.where(F.col("pos") % (1 << BLOCK_BITS) == 0).select("tree", "pos", "last", F.pmod(F.shiftright("pos", BLOCK_BITS), F.lit(SALTS)).cast("int").alias("salt"))
    above = siblings("pos", "last", OWN, max(OWN, len(own) - 1), "tree")
    over = siblings("tree - 1", f"{count - 1}L", 0, max(0, len(top) - 2), "0L", TOP)
    self = f"array(named_struct('tree', tree, 'level', {height('last')}, 'pos', 0L, 'step', {SUBROOT}))"
    upper = blocks.select("tree", "pos", "salt", F.expr(f"concat({above}, {self}, {over})").alias("coords"))
    salted = nodes.where((F.col("level") >= OWN) | (F.col("tree") == 0) | F.col("single")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    upper = _found(upper, salted, ["salt"]).groupBy("tree", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("step", "at", "digest"))).alias("upper"))

    none = lambda kind: F.lit(None).cast(kind)
    mine = leaves.select("tree", "pos", F.lit(-1).alias("step"), F.col("pos").alias("at"), F.col("leaf").alias("digest"), "last", "doc_id", "bad")
    low = low.select("tree", "pos", "step", "at", "digest", none("long").alias("last"), none("long").alias("doc_id"), none("binary").alias("bad"))
    both = mine.unionAll(low).withColumn("block", F.shiftright("pos", BLOCK_BITS)).repartition("tree", "block")
    proofs = both.groupBy("tree", "block", "pos").agg(
        F.sort_array(F.collect_list(F.when(F.col("step") >= 0, F.struct("step", "at", "digest")))).alias("lower"),
        *(F.max(F.when(F.col("step") < 0, F.col(c))).alias(name) for c, name in (("last", "last"), ("doc_id", "doc_id"), ("digest", "leaf"), ("bad", "bad"))),
    )
    proofs = proofs.join(upper, ["tree", "block"])
    every = F.transform(F.concat("lower", "upper"), lambda x: F.struct(x["step"].alias("step"), x["at"].alias("at"), hexed(x["digest"]).alias("digest")))
    proofs = proofs.select("tree", "pos", "last", "doc_id", hexed(F.col("leaf")).alias("leaf"), hexed(F.coalesce("bad", "leaf")).alias("start"), every.alias("every"))
    path = F.filter("every", lambda x: x["step"] != SUBROOT)
    steps = F.expr(f"concat(filter(sequence(0, 15), l -> shiftright(last, {FAN_BITS} * l) > 0), filter(sequence({TOP}, {TOP + 15}), l -> shiftright({count - 1}L, {FAN_BITS} * (l - {TOP})) > 0))")
    place = f"if(s < {TOP}, shiftright(pos, {FAN_BITS} * s), shiftright(tree - 1, {FAN_BITS} * (s - {TOP})))"
    side = lambda sign: f"concat_ws('', transform(filter(path, x -> x.step = s and x.at {sign} {place}), x -> x.digest))"
    fold = F.expr(f"aggregate(steps, start, (digest, s) -> sha2(concat({side('<')}, digest, {side('>')}), 256))")
    proofs = proofs.select("*", path.alias("path"), steps.alias("steps"), F.filter("every", lambda x: x["step"] == SUBROOT)[0]["digest"].alias("subroot"))
    proofs = proofs.select("doc_id", "leaf", "subroot", F.sha2(F.concat_ws("", F.transform("path", lambda x: x["digest"])), 256).alias("proof_sha256"), fold.alias("folded_root"))
    return proofs.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _all(levels: list[DataFrame]) -> DataFrame:
    """The node table of one kind of tree: ``tree``, ``level``, ``pos``, ``size``, ``digest``, ``single`` (a root)."""
    out = None
    for k, level in enumerate(levels):
        part = level.select("tree", F.lit(k).alias("level"), "pos", "size", "digest", (F.col("size") == 1).alias("single"))
        out = part if out is None else out.unionAll(part)
    return out


def _found(asked: DataFrame, nodes: DataFrame, salt: list[str]) -> DataFrame:
    """``tree``, ``pos`` of each asking row with ``step``, ``at``, ``digest`` of each node in its array ``coords``."""
    wanted = asked.select("tree", "pos", *salt, F.explode("coords").alias("c"))
    wanted = wanted.select("tree", "pos", *salt, F.col("c.tree").alias("of"), F.col("c.level").alias("level"), F.col("c.pos").alias("at"), F.col("c.step").alias("step"))
    nodes = nodes.select(F.col("tree").alias("of"), "level", F.col("pos").alias("at"), "digest", *salt)
    return wanted.join(nodes.hint("shuffle_hash"), ["of", "level", "at", *salt]).select("tree", "pos", "step", "at", "digest")


def _oracle(levels: int = 6, tops: int = 3) -> str:
    """SQL for trees of at most FAN ** levels leaves and FAN ** tops sources; every level is a list of runs."""
    field = lambda v: f"coalesce(strlen({v})::varchar || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(f"{c}::varchar" if c != "text" else text) for c in FIELDS) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [
        "crc as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t)",
        "tampered as (select d.*, 4294967295 - list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) as sum from documents d, crc)",
        f"raw as (select doc_id, source, {leaf('text')} as leaf, case when doc_id is not null and sum % 5 = 0 then {leaf(low)} end as bad from tampered)",
        "leaves as (select *, dense_rank() over (order by source nulls first) - 1 as s, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from raw)",
    ]
    for name, height, base in (("a", levels, "select s, pos, leaf as h from leaves"), ("b", tops, "select 0 as s, s as pos, h from subroots")):
        parts.append(f"{name}0 as ({base})")
        for k in range(height):
            # a tree that is one node stays one; else runs of FAN become nodes
            parts.append(f"{name}r{k} as (select s, pos // {FAN} as run, list(h order by pos) as hs, max(n) as n from (select *, count(*) over (partition by s) as n from {name}{k}) group by all)")
            parts.append(f"{name}{k + 1} as (select s, run as pos, case when n = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {name}r{k})")
        if name == "a":
            parts.append(f"subroots as (select s, h from a{levels})")
    rows, joins = [], []
    for name, height, place, tree in (("a", levels, "l.pos", "l.s"), ("b", tops, "l.s", "0")):
        for k in range(height):
            at = f"({place} // {FAN**k})"
            joins.append(f"join {name}r{k} {name}_{k} on {name}_{k}.s = {tree} and {name}_{k}.run = {at} // {FAN}")
            sides = [f"array_to_string({name}_{k}.hs[:{at} % {FAN}], '')", f"array_to_string({name}_{k}.hs[{at} % {FAN} + 2:], '')"]
            rows.append((f"{name}{k}", f"case when {name}_{k}.n = 1 then null else {sides[0]} end as {name}{k}_l, case when {name}_{k}.n = 1 then null else {sides[1]} end as {name}{k}_r"))
    parts.append("looked as (select l.*, u.h as subroot, t.h as root, " + ", ".join(r for _, r in rows) + f" from leaves l join subroots u on u.s = l.s cross join b{tops} t " + " ".join(joins) + ")")
    previous = "looked"
    for k, (name, _) in enumerate(rows):
        value = "coalesce(bad, leaf)" if not k else f"f{k - 1}"
        parts.append(f"fold{k} as (select *, case when {name}_l is null then {value} else sha256({name}_l || {value} || {name}_r) end as f{k} from {previous})")
        previous = f"fold{k}"
    final = f"f{len(rows) - 1}"
    joined = " || ".join(f"coalesce({name}_l, '') || coalesce({name}_r, '')" for name, _ in rows)
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root, sha256({joined}) as proof_sha256, {final} as folded_root, {final} = root as verified from {previous}"


ORACLE = _oracle()
