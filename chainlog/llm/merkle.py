"""Merkle manifest of a dataset: a digest for each row, for each subset (such as a source) and for the whole, with proofs.

Rows are leaves. Within a subset they are put in order and numbered; while a subset has several nodes, each run of `fanout`
consecutive ones becomes its digest. What remains is the subset's root; the subsets' roots, in order, make the dataset's root
in the same way. A digest is the lower-case hex SHA-256 of its inputs in a row: of a leaf, its fields as `length:value` (`-`
if null); of other nodes, their children's digests.

The tree is built from below: every level is a table of (subset, place, digest, children), dealt by subset and place, so a
task gets runs of at most `fanout` rows whatever share of all rows a subset has. Places come from a range sort, counts of its
partitions and each row's number in its partition, not from a window over a subset. Proofs are pushed from above: a level's
nodes join their parents by place, and each puts the siblings of its own run before what its parent inherited. A level is
1 / fanout of the one below; nothing but the height comes to the driver. Each level is a table in the shared folder, so a
lost executor costs no more than the level in work.

Null subsets are one subset, the first; null keys come first in theirs; rows of one key are ordered by their digest, so equal
rows stand side by side and which of them has which place makes no difference. Null and empty fields differ. Texts are
digested whole. A subset of one row has the row's digest as its root, and a dataset of one subset has the subset's. An empty
table has no root and no proofs. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

FANOUT = 16
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A field as text that no other sequence of fields can give: its UTF-8 byte count, a colon and its value; - if null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def subset_key(subset: Column) -> Column:
    """Never null, so that plain equality joins it; in the order of the subsets, null first."""
    return F.coalesce(F.concat(F.lit("+"), subset.cast("string")), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """Levels from the leaves up, for the subsets and for the dataset over them; rows: (tree, at, n, digest, ...), where n is
    the number of nodes that the tree has on the level."""

    levels: list[DataFrame]
    forest: list[DataFrame]

    def subsets(self) -> DataFrame:
        """(subset, root, n_rows)."""
        sizes = self.levels[0].where("at = 0").select("tree", F.col("n").alias("n_rows"))
        name = F.when(F.col("name") != "", F.substring("name", 2, 1 << 30)).alias("subset")
        return self.forest[0].join(sizes, self.forest[0]["name"] == sizes["tree"]).select(name, F.col("digest").alias("root"), "n_rows")

    def root(self) -> DataFrame:
        """(root): one row, or none for an empty table."""
        return self.forest[-1].where("n = 1").select(F.col("digest").alias("root"))


def _above(at: Column, fanout: int) -> Column:
    return F.floor(at / fanout).cast("long")


def grown(leaves: DataFrame, fanout: int) -> list[DataFrame]:
    """The levels over numbered leaves (tree, at, n, digest, ...), themselves first."""
    levels = [written(leaves, "merkle-level")]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = levels[-1].where("n > 1")
        children = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"])
        runs = below.groupBy("tree", _above(F.col("at"), fanout).alias("at")).agg(F.ceil(F.max("n") / fanout).alias("n"), children.alias("children"))
        levels.append(written(runs.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "merkle-level"))
        most = -(-most // fanout)
    return levels


def build(
    docs: DataFrame, fields: Sequence[str], subset: str, order: str, keep: Mapping[str, Column] | None = None, fanout: int = FANOUT
) -> Manifest:
    """The manifest of docs over their fields. Leaves carry the order's column as key, and the columns of keep."""
    own = {"key": F.col(order), **(keep or {})}
    leaf = digest(*[F.col(f) for f in fields])
    leaves = docs.select(subset_key(F.col(subset)).alias("tree"), leaf.alias("digest"), F.monotonically_increasing_id().alias("__tie"), *[c.alias(k) for k, c in own.items()])
    leaves = numbered(written(leaves, "merkle-leaves"), "tree", "key", "digest", "__tie").drop("__tie")
    levels = grown(leaves, fanout)
    tops = [x.where("n = 1").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest") for x in levels]
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    return Manifest(levels, grown(numbered(written(subroots, "merkle-subroots"), "tree", "name"), fanout))


def _pushed(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The lowest level with what its tree's top inherits (tops: tree, proof, ...) and the steps from each leaf to it."""
    inherited = [c for c in tops.columns if c not in ("tree", "proof")]
    above: DataFrame | None = None
    for number, level in reversed(list(enumerate(levels))):
        own = [c for c in level.columns if c != "children"]
        rows = level.where("n = 1").select(*own).join(tops, "tree").select(*own, *inherited, "proof")
        if above is not None:
            parents = above.select(F.col("tree").alias("__tree"), F.col("at").alias("__at"), *inherited, F.col("proof").alias("__proof"), "__children")
            at = (F.col("at") % fanout).cast("int")
            left = F.array_join(F.slice("__children", F.lit(1), at), "")
            right = F.array_join(F.slice("__children", at + 2, F.lit(fanout)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            found = level.where("n > 1").select(*own).join(parents, (F.col("tree") == F.col("__tree")) & (_above(F.col("at"), fanout) == F.col("__at")))
            rows = rows.unionByName(found.select(*own, *inherited, F.concat(step, "__proof").alias("proof")))
        if number == 0:
            return rows
        kids = level.select(F.col("tree").alias("__t"), F.col("at").alias("__a"), F.col("children").alias("__children"))
        above = written(rows.join(kids, (F.col("tree") == F.col("__t")) & (F.col("at") == F.col("__a"))).drop("__t", "__a"), "merkle-proofs")
    raise ValueError("no levels")


def proofs(manifest: Manifest, fanout: int = FANOUT) -> DataFrame:
    """Every leaf with digest, subroot, root and proof, and what it was built to carry. proof: the steps from the leaf to the
    root, each with the digests to the left and to the right of the node in its run, in a row."""
    root = manifest.forest[-1].where("n = 1").select("tree", F.col("digest").alias("root"), F.array().cast(STEPS).alias("proof"))
    subsets = _pushed(manifest.forest, root, fanout).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "proof")
    return _pushed(manifest.levels, written(subsets, "merkle-subsets"), fanout).drop("tree", "at", "n")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof give."""
    return F.aggregate(proof, leaf, lambda have, step: F.sha2(F.concat(step["left"], have, step["right"]), 256))


def siblings_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof in a row."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
