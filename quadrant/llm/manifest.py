"""A Merkle manifest of a table of documents, with every document's proof.

Each source's leaves are numbered in order of their ids, by range partitions and counts, so that no source has to fit into
a task. Levels are DataFrames: a node's parent is its number divided by the fanout, so a level is one grouping with at most
FANOUT nodes a group, whose sorted children are hashed into their parent. Subroots are then the leaves of one more tree.
Proofs go the other way: from the root down, each level's groups are joined to the path of the node that they became, and
each child's path is its siblings in front of it. So level k joins 3^-k of the rows, and all levels together half of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrant.functions.ranks import ranked
from quadrant.llm.common import table, written

FANOUT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf(*fields: Column) -> Column:
    """Digest, as 32 bytes, of fields: each `-` if null, else its length in bytes, a colon and itself."""
    text = [f.cast("string") for f in fields]
    return _digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def _up(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of groups (tree, at, of, hash, children), bottom up, and the trees' roots (tree, level, hash).

    nodes: tree, at (from 0), of (nodes of that tree), hash, and what leaves carry. most: the largest of. A group's at, of
    and hash are those of the node that it becomes.
    """
    carried = [c for c in nodes.columns if c not in ("tree", "at", "of")]
    levels, ends = [], [nodes.where("of = 1").select("tree", F.lit(0).alias("level"), "hash")]
    while most > 1:
        parent = F.floor(F.col("at") / FANOUT).alias("parent")
        groups = nodes.where("of > 1").groupBy("tree", parent).agg(F.max("of").alias("of"), F.sort_array(F.collect_list(F.struct("at", *carried))).alias("children"))
        hashed = _digest(F.array_join(F.transform("children", lambda c: _hex(c["hash"])), ""))
        groups = groups.select("tree", F.col("parent").alias("at"), F.ceil(F.col("of") / FANOUT).alias("of"), hashed.alias("hash"), "children")
        levels.append(written(groups, "merkle-level"))
        ends.append(levels[-1].where("of = 1").select("tree", F.lit(len(levels)).alias("level"), "hash"))
        nodes, carried = levels[-1].select("tree", "at", "of", "hash"), ["hash"]
        most = -(-most // FANOUT)
    roots = ends[0]
    for e in ends[1:]:
        roots = roots.unionByName(e)
    return levels, roots


def _down(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """top, path and what they carry of the leaves of trees of more than one. tops: (tree, level, path, top) of the roots.

    A path is an array of (left, right), the siblings' digests on either side, from the node's own level to the root's.
    """
    above = None
    for k in range(len(levels), 0, -1):
        paths = tops.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("at"), "path", "top")
        paths = paths if above is None else paths.unionByName(above.select("tree", "at", "path", "top"))
        paths = paths.select(F.col("tree").alias("t"), F.col("at").alias("a"), "path", "top")
        met = levels[k - 1].select("tree", "at", "children").join(paths, F.col("tree").eqNullSafe(F.col("t")) & (F.col("at") == F.col("a")))
        met = met.select("tree", "path", "top", "children", F.posexplode("children").alias("place", "child"))
        side = lambda c: F.aggregate(c, F.lit(b""), lambda a, x: F.concat(a, x["hash"]))
        left, right = F.slice("children", F.lit(1), F.col("place")), F.slice("children", F.col("place") + 2, F.lit(FANOUT))
        step = F.struct(side(left).alias("left"), side(right).alias("right"))
        above = met.select("tree", "top", F.concat(F.array(step), F.col("path")).alias("path"), "child.*")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of docs, which has the columns FIELDS.

    Where the unsigned CRC-32 of a doc_id is even, the text is tampered with before its leaf is folded: its newlines go. A
    null in any column is a value of its own; a null doc_id comes first in its source and is never tampered with, null
    sources are one source and come first. Rows that repeat a doc_id are leaves of their own, in order of their digests.
    Empty and very long texts are hashed as they are. Columns but FIELDS are ignored, whatever their names. An empty table
    gives an empty one.
    """
    fields = [F.col(c) for c in FIELDS]
    bare = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    changed = F.when(F.contains(F.col("text"), F.lit("\n")) & bare.isNotNull(), leaf(*fields[:-1], bare))
    leaves = written(docs.select("doc_id", F.col("source").alias("tree"), leaf(*fields).alias("hash"), changed.alias("changed")), "merkle-leaves")
    leaves = ranked(leaves, ["doc_id", "hash"], ["tree"], rank="at", total="of")
    leaves = written(leaves, "merkle-ranked")
    most = leaves.agg(F.max("of")).first()[0]
    levels, subroots = _up(leaves.select("tree", "at", "of", "hash", "doc_id", "changed"), most or 0)
    subroots = written(subroots, "merkle-subroots")
    sources = ranked(subroots.select(F.col("tree").alias("source"), "level", "hash"), ["source"], rank="at", total="of").withColumn("tree", F.lit(0))
    sources = written(sources, "merkle-sources")
    above, roots = _up(sources.select("tree", "at", "of", "hash", "source", F.col("level").alias("carried_level")), sources.count())
    top = roots.select("hash").first()
    root = F.lit(None if top is None else bytes(top.hash)).cast("binary")
    path = F.array().cast("array<struct<left:binary,right:binary>>").alias("path")
    tops = sources.where("of = 1").select("source", "level", F.col("hash").alias("top"), path)
    if above:
        found = _down(above, roots.select("tree", "level", path, F.lit(b"").alias("top")))
        tops = tops.unionByName(found.select("source", F.col("carried_level").alias("level"), F.col("hash").alias("top"), "path"))
    tops = written(tops.withColumnRenamed("source", "tree"), "merkle-tops")
    lone = leaves.where("of = 1").select(F.col("tree").alias("t"), "doc_id", "hash", "changed")
    out = lone.join(tops, F.col("t").eqNullSafe(F.col("tree"))).select("doc_id", "hash", "changed", "top", "path")
    if levels:
        out = out.unionByName(_down(levels, tops).select("doc_id", "hash", "changed", "top", "path"))
    proof = F.array_join(F.transform("path", lambda p: _hex(F.concat(p["left"], p["right"]))), "")
    folded = F.aggregate("path", F.coalesce("changed", "hash"), lambda a, p: _digest(_hex(F.concat(p["left"], a, p["right"]))))
    out = out.select("doc_id", "hash", "top", F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded"))
    return out.select("doc_id", _hex(F.col("hash")).alias("leaf"), _hex(F.col("top")).alias("subroot"), _hex(root).alias("root"), "proof_sha256", _hex(F.col("folded")).alias("folded_root"), (F.col("folded") == root).alias("verified"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """manifest() of all documents."""
    return manifest(table(spark, sf_dir, "documents"))


def _tree_sql(name: str, nodes: str) -> str:
    """CTEs <name> (tree, level, i, n, h), all nodes of all trees, and <name>_g (tree, level, i, hs), the groups below each parent."""
    return f"""{name}(tree, level, i, n, h) AS (SELECT tree, 0, i, n, h FROM {nodes}
    UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3, n),
  {name}_g AS (SELECT tree, level, i // 3 AS i, list(h ORDER BY i) AS hs FROM {name} WHERE n > 1 GROUP BY tree, level, i // 3)"""


def _climb_sql(name: str, tree: str, start: str) -> str:
    """CTE <name> (id, tree, level, i, sib, fold): a climb from start to the roots, which collects siblings and folds."""
    left, right = "array_to_string(hs[1:CAST(p.i % 3 AS INTEGER)], '')", "array_to_string(hs[CAST(p.i % 3 AS INTEGER) + 2:], '')"
    return f"""{name}(id, tree, level, i, sib, fold) AS (SELECT id, tree, 0, i, sib, fold FROM {start}
    UNION ALL SELECT p.id, p.tree, p.level + 1, p.i // 3, p.sib || {left} || {right}, sha256({left} || p.fold || {right}) FROM {name} p JOIN {tree}_g g ON p.tree IS NOT DISTINCT FROM g.tree AND p.level = g.level AND p.i // 3 = g.i)"""


def _leaf_sql(text: str) -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal digits, a byte's bits after one another: each byte, then seven zeros, is folded in and shifted once.
_CRC_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, 3988292384::BIGINT * (xor(a, b) & 1))), 4294967295::BIGINT)"

SQL = f"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS id FROM documents),
  f AS (SELECT id, doc_id, source AS tree, {_leaf_sql('text')} AS h, CASE WHEN {_CRC_SQL} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} END AS changed FROM d),
  l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM f),
  {_tree_sql('t', 'l')},
  s AS (SELECT tree AS source, 0 AS tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
  {_tree_sql('u', 's')},
  p0 AS (SELECT id, tree, i, '' AS sib, coalesce(changed, h) AS fold FROM l),
  {_climb_sql('p', 't', 'p0')},
  ended AS (SELECT p.* FROM p JOIN t ON p.tree IS NOT DISTINCT FROM t.tree AND p.level = t.level AND p.i = t.i WHERE t.n = 1),
  q0 AS (SELECT e.id, 0 AS tree, s.i, e.sib, e.fold FROM ended e JOIN s ON e.tree IS NOT DISTINCT FROM s.source),
  {_climb_sql('q', 'u', 'q0')},
  top AS (SELECT level, h FROM u WHERE n = 1)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, top.h AS root, sha256(q.sib) AS proof_sha256, q.fold AS folded_root, q.fold = top.h AS verified
FROM q JOIN top ON q.level = top.level JOIN l USING (id) JOIN s ON l.tree IS NOT DISTINCT FROM s.source
"""
