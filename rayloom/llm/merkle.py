"""Merkle manifests of a dataset, with a proof of inclusion for every row.

Rows become leaves.  Leaves are numbered within their group and gathered into
blocks of a fixed size and order; a block's levels are collapsed by
higher-order functions over its array (``sequence``, ``transform``, ``slice``,
``aggregate``), and the block roots are the leaves of the next round.  A group
of 10^12 leaves takes four rounds.  The groups' roots are numbered and
collapsed the same way to the root of all.  The way back gives each block the
path of its root, and so each leaf its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rayloom.llm.common import maybe_broadcast, stored
from rayloom.llm.spans import let

#: Levels that a block collapses; a block has two to this power of leaves.
LEVELS = 10
#: Stretches of the numbering that are broadcast.
BROADCAST_STRETCHES = 100_000

PATH = "array<struct<sibling:string,left:boolean>>"


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of UTF-8, ``:`` and the value."""
    said = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf(*values: Column) -> Column:
    """A row's digest, of its fields one after another."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _parents(nodes: Column) -> Column:
    """The level above: digests of every two nodes, of the last one alone where it has no other."""
    pairs = F.sequence(F.lit(0), F.shiftright(F.size(nodes) - 1, 1))
    return F.transform(pairs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * 2 + 1, F.lit(2)), ""), 256))


def _levels(nodes: Column, n: Column) -> Column:
    """``nodes`` and the ``n`` levels above it."""
    steps = F.slice(F.sequence(F.lit(1), F.lit(LEVELS)), F.lit(1), n)
    return F.aggregate(steps, F.array(nodes), lambda told, _: F.concat(told, F.array(_parents(F.element_at(told, -1)))))


def _steps(levels: Column, at: Column) -> Column:
    """The siblings of the node ``at`` of a block on its way up, null where a node is alone; ``left`` where the sibling comes first."""
    told = F.slice(levels, F.lit(1), F.size(levels) - 1)
    return F.transform(told, lambda level, i: let(F.call_function("shiftright", at, i), lambda p: F.struct(F.get(level, p.bitwiseXOR(F.lit(1))).alias("sibling"), (p.bitwiseAND(F.lit(1)) == 1).alias("left"))))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    up = lambda h, s: F.sha2(F.when(s["sibling"].isNull(), h).when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256)
    return F.aggregate(path, leaf, up)


def siblings(path: Column) -> Column:
    """The digests of a path, from the leaf to the root."""
    return F.filter(F.transform(path, lambda s: s["sibling"]), lambda s: s.isNotNull())


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` (``gkey, order, digest`` and more) with ``pos`` within ``gkey`` and ``n`` rows of it; and the largest ``n``.

    Rows are dealt out by ranges of all three columns, so a group of any size
    is spread; each range counts its stretch of a group, and sums over the
    stretches, of which there are no more than ranges and groups, give places.
    """
    dealt = rows.repartitionByRange("gkey", "order", "digest").sortWithinPartitions("gkey", "order", "digest")
    held = stored(dealt.withColumn("rid", F.monotonically_increasing_id()), name)
    part = F.shiftright("rid", 33)
    stretches = held.groupBy("gkey", part.alias("part")).agg(F.min("rid").alias("first"), F.count("*").alias("rows"))
    # a window per group over its stretches: as many rows as ranges
    spread = stored(stretches.selectExpr("*", "sum(rows) OVER (PARTITION BY gkey ORDER BY part) - rows AS before", "sum(rows) OVER (PARTITION BY gkey) AS n"), f"{name}-stretches")
    most = spread.agg(F.max("n").alias("n")).first().n or 0
    held = held.withColumn("part", part).join(maybe_broadcast(spread, BROADCAST_STRETCHES), ["gkey", "part"])
    return held.withColumn("pos", F.col("rid") - F.col("first") + F.col("before")).drop("rid", "part", "first", "before", "rows", "order"), most


@dataclass
class Tree:
    """Rounds of blocks of one tree per ``gkey``: ``gkey, block, n, levels, held``, ``n`` counting the nodes of that round in the group.

    ``levels`` are the digests of the block, from its leaves to its root;
    ``held`` is what the leaves carry, in their order.
    """

    rounds: list[DataFrame]

    def roots(self) -> DataFrame:
        """``gkey, subroot``."""
        tops = [r.filter(F.col("n") <= 1 << LEVELS).select("gkey", F.get(F.element_at("levels", -1), F.lit(0)).alias("subroot")) for r in self.rounds]
        for other in tops[1:]:
            tops[0] = tops[0].unionByName(other)
        return tops[0]

    def paths(self, above: DataFrame) -> DataFrame:
        """``gkey, digest, held, path`` of each leaf, and the columns of ``above``, of which each ``gkey`` has one row with a ``path`` of its own."""
        given = [c for c in above.columns if c not in ("gkey", "path")]
        upper = None
        for told in reversed(self.rounds):
            met = told.filter(F.col("n") <= 1 << LEVELS).join(above, "gkey")
            if upper is not None:
                more = told.filter(F.col("n") > 1 << LEVELS).join(upper.drop("digest", "held"), ["gkey", "block"])
                met = met.unionByName(more)
            place = lambda x, i: F.struct(x.alias("held"), F.get(F.get("levels", F.lit(0)), i).alias("digest"), F.concat(_steps(F.col("levels"), i), F.col("path")).alias("path"), (F.col("block") * (1 << LEVELS) + i).alias("block"))
            each = F.transform("held", place)
            upper = met.select("gkey", *given, F.explode(each).alias("e")).select("gkey", *given, "e.*")
        return upper.drop("block")


def tree(leaves: DataFrame, name: str, carry: list[str]) -> Tree:
    """The trees over ``gkey, order, digest``; ``carry`` names columns that stay with the leaves."""
    told, most = numbered(leaves, name)
    told, rounds = told.select("gkey", "pos", "n", "digest", F.struct(*carry).alias("held")), []
    while True:
        nodes = F.array_sort(F.collect_list(F.struct("pos", "digest", "held")))
        grouped = told.groupBy("gkey", F.shiftright("pos", LEVELS).alias("block"), "n").agg(nodes.alias("nodes"))
        # as many levels remain in the group as n - 1 has binary digits, of which a block takes LEVELS at most
        remain = F.least(F.lit(LEVELS), F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(F.lit(0)))
        levels, held = _levels(F.transform("nodes", lambda x: x["digest"]), remain), F.transform("nodes", lambda x: x["held"])
        rounds.append(stored(grouped.select("gkey", "block", "n", levels.alias("levels"), held.alias("held")), f"{name}-blocks"))
        if most <= 1 << LEVELS:
            return Tree(rounds)
        most = -(-most >> LEVELS)
        root = F.get(F.element_at("levels", -1), F.lit(0))
        told = rounds[-1].filter(F.col("n") > 1 << LEVELS).select("gkey", F.col("block").alias("pos"), F.shiftright(F.col("n") + ((1 << LEVELS) - 1), LEVELS).alias("n"), root.alias("digest"), F.lit(None).cast("int").alias("held"))


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id, leaf, path, subroot, root`` of every row of ``docs``, and the columns of ``carry``.

    Leaves ascend by id within a group, null ids first; rows of one id by
    their leaves, so repeated rows have places of their own beside each other.
    A null group is one of its own, and comes first; groups are ordered
    bytewise.  Null fields are part of a leaf.  Texts of any length are
    digested whole and are not shuffled: from the first pass on only ids,
    digests and what ``carry`` names are.  A group of any size is spread over
    tasks.  An empty table gives no rows.  Other columns are ignored,
    whatever their names.
    """
    carried = carry or {}
    key = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))
    told = docs.select(F.col(id_col).alias("order"), key(F.col(group_col)).alias("gkey"), leaf(*[F.col(f) for f in fields]).alias("digest"), *[c.alias(f"carried_{n}") for n, c in carried.items()])
    names = [f"carried_{n}" for n in carried]
    below = tree(stored(told, "merkle-leaves").withColumn("doc_id", F.col("order")), "merkle", ["doc_id", *names])
    subroots = stored(below.roots(), "merkle-subroots")
    top = tree(subroots.select(F.lit("").alias("gkey"), F.col("gkey").alias("order"), F.col("subroot").alias("digest"), F.col("gkey").alias("group")), "merkle-top", ["group"])
    whole = top.roots().select("gkey", F.col("subroot").alias("root"), F.array().cast(PATH).alias("path"))
    above = stored(top.paths(whole).select(F.col("held.group").alias("gkey"), F.col("digest").alias("subroot"), "root", "path"), "merkle-paths")
    return below.paths(above).select("held.doc_id", F.col("digest").alias("leaf"), "path", "subroot", "root", *[F.col(f"held.carried_{n}").alias(n) for n in carried])


#: DuckDB SQL: nodes by tree, level and place, grown level by level; then each row's leaf and tampered leaf on their way up.
ORACLE_SQL = """WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos,
    CASE WHEN doc_id IS NULL THEN '-' ELSE length(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS grp, pos, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE length(n_chars::VARCHAR) || ':' || n_chars END || tail) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-' WHEN crc % 7 = 0 THEN length((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) ELSE length(n_chars::VARCHAR) || ':' || n_chars END || tail) AS shown
  FROM d
), nodes AS (
  SELECT grp, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY grp) AS n FROM leaves
  UNION ALL
  SELECT grp, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 2
), subroots AS (
  SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos FROM nodes WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2
), steps AS (
  SELECT grp, 0 AS part, level, pos, h FROM nodes UNION ALL SELECT '', 1, level, pos, h FROM top
), way AS (
  SELECT l.doc_id, l.grp, l.pos AS leaf_pos, l.leaf, 0 AS level, l.pos, 0 AS part, l.shown AS h, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.grp, w.leaf_pos, w.leaf,
    CASE WHEN w.part = 0 AND w.level = r.height THEN 0 ELSE w.level + 1 END, CASE WHEN w.part = 0 AND w.level = r.height THEN r.pos ELSE w.pos // 2 END, CASE WHEN w.level = r.height THEN 1 ELSE w.part END,
    CASE WHEN w.part = 0 AND w.level = r.height THEN w.h WHEN s.h IS NULL THEN sha256(w.h) WHEN w.pos % 2 = 1 THEN sha256(s.h || w.h) ELSE sha256(w.h || s.h) END,
    CASE WHEN w.part = 0 AND w.level = r.height THEN w.proof ELSE w.proof || coalesce(s.h, '') END
  FROM way w JOIN subroots r USING (grp) LEFT JOIN steps s ON s.part = w.part AND s.level = w.level AND s.pos = xor(w.pos, 1) AND s.grp = CASE WHEN w.part = 0 THEN w.grp ELSE '' END
  WHERE w.part = 0 OR w.level < (SELECT max(level) FROM top)
)
SELECT w.doc_id, w.leaf, r.subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM way w JOIN subroots r USING (grp) WHERE w.part = 1 AND w.level = (SELECT max(level) FROM top)"""
