"""Merkle manifest of a dataset: every row a leaf, a tree per group, a tree over the groups' roots.

The rows are numbered within their group by a distributed sort, so a node's place in its tree is arithmetic:
slot ``pos % fan`` of run ``pos div fan``, of which only a group's last may be short. Per level a window
gives a row the digests at fixed lags and leads; those inside its slot and run length are its siblings, and a run's
first child hashes itself and its leads to the parent, which is the next level's row. The window's
partitions are the runs, so that the join with the parents' proofs reuses them and no group, however large, meets in
one task. A node's proof is its siblings and its parent's proof, joined downwards from the root; a level has
``1 / fan`` of the rows below it, and of the leaves nothing but ids and digests ever moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.llm.common import positions, staged

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = ["g", "pos", "total", "digest"]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame, columns: list[str], by: str) -> DataFrame:
    """(doc_id, g, leaf, tampered): ``g`` names the group, null first in its order; ``tampered`` is the leaf after
    A-Z of the text are lower-cased where 3 divides the id's crc32."""
    head = [field(F.col(c)) for c in columns if c != "text"]
    changed = digest(*head, field(F.translate("text", CAPITALS, SMALL)))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit("-"))
    found = docs.select("doc_id", group.alias("g"), digest(*head, field(F.col("text"))).alias("leaf"), F.when(hit, changed).alias("changed"))
    return found.select("doc_id", "g", "leaf", F.coalesce("changed", "leaf").alias("tampered"))


def with_siblings(nodes: DataFrame, fan: int) -> DataFrame:
    """``nodes`` (g, pos, total, digest, ..) with ``parent`` (its pos) and the siblings' digests to the ``left`` and
    ``right``, concatenated."""
    slot, run = F.col("pos") % fan, F.least(F.lit(fan), F.col("total") - F.col("pos") + F.col("pos") % fan)
    placed = nodes.withColumn("parent", F.floor(F.col("pos") / fan))
    window = W.partitionBy("g", "parent").orderBy("pos")
    before = [F.when(slot >= k, F.lag("digest", k).over(window)) for k in range(fan - 1, 0, -1)]
    after = [F.when(slot + k < run, F.lead("digest", k).over(window)) for k in range(1, fan)]
    return placed.select("*", F.concat_ws("", *before).alias("left"), F.concat_ws("", *after).alias("right"))


def parents(nodes: DataFrame, fan: int) -> DataFrame:
    """The next level: a row per run, hashed by its first child. The one node of a group rises as it is."""
    first = with_siblings(nodes, fan).filter(F.col("pos") % fan == 0)
    hashed = F.when(F.col("total") > 1, digest(F.col("digest"), F.col("right"))).otherwise(F.col("digest"))
    return first.select("g", F.col("parent").alias("pos"), F.ceil(F.col("total") / fan).alias("total"), hashed.alias("digest"))


def climb(nodes: DataFrame, fan: int, label: str) -> list[DataFrame]:
    """All levels of the trees above ``nodes`` (g, pos, total, digest), from it upwards to one node per group."""
    size = nodes.agg(F.max("total").alias("most")).first().most or 0
    levels = [nodes]
    while size > 1:
        size = -(-size // fan)
        levels.append(staged(parents(levels[-1], fan), label))
    return levels


def descend(levels: list[DataFrame], above: DataFrame, fan: int) -> DataFrame:
    """The rows of the lowest level with the columns of ``above`` (g, path, ..) for their group and ``path``, the
    siblings (left, right) of them and of all nodes over them, ``above``'s path last."""
    more = [c for c in above.columns if c not in ("g", "path")]
    paths = levels[-1].join(above, "g")
    for k in range(len(levels) - 2, -1, -1):
        over = paths.select("g", F.col("pos").alias("parent"), F.col("path").alias("over"), *more)
        own = F.when(F.col("total") > 1, F.concat(F.array(F.struct("left", "right")), "over")).otherwise(F.col("over"))
        paths = with_siblings(levels[k], fan).join(over, ["g", "parent"]).select(*levels[k].columns, *more, own.alias("path"))
        paths = staged(paths, "paths") if k else paths
    return paths


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, at: digest(at["left"], node, at["right"]))


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), by: str = "lang", fan: int = 8) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Leaves are in the order of doc_id (null first, ties by leaf, so equal rows are interchangeable) within
    their value of ``by``, the values in UTF-8 order, null first. A null or empty field is told apart by its
    code. A group of one leaf has that leaf as its subroot, a table of one group its subroot as root; without siblings
    the proof hashes nothing. A row without an id is never tampered with. An empty table gives an empty
    result; other columns are ignored.
    """
    found = leaves(docs, list(columns), by)
    placed = positions(found, ["g"], [F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")], "leaves").withColumnRenamed("leaf", "digest")
    placed = staged(placed.select(*_NODE, "doc_id", "tampered"), "numbered")
    levels = climb(placed, fan, "level")

    subroots = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "digest")
    groups = positions(subroots, ["g"], [F.col("name")], "groups")
    over = climb(groups.select(*_NODE, "name"), fan, "top")
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = over[-1].select("g", none.alias("path"), F.col("digest").alias("root"))
    known = descend(over, top, fan).select(F.col("name").alias("g"), F.col("digest").alias("subroot"), "root", "path")
    known = staged(known, "known")

    proofs = descend(levels, known, fan)
    told = F.array_join(F.transform("path", lambda at: F.concat(at["left"], at["right"])), "")
    checked = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(told, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
