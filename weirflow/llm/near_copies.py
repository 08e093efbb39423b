"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash comes first: sets have fingerprints of their shingles, and the ball hashing of ``simhash`` finds those within two bits,
whose sets are then compared. Two bits link few near copies at this similarity, so the exact similarity join of
``jaccard_join`` goes on from these groups; it compares no pairs but those that meet
under a rare shingle and that signature trees can't exclude.

Edge cases: a null or wordless text has the empty set, equal to other empty ones; with
fewer than five words the whole sequence is the one shingle; repeated rows keep one
row each; null ids take part but are never the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import jaccard_join, simhash
from weirflow.llm.storage import written

#: Words of a shingle, similarity in hundredths, and the share of shingles that is counted over the corpus.
SHINGLE, ALIKE, LOW = 5, 80, 0.4


def by_fingerprints(rows: DataFrame) -> DataFrame:
    """Pairs ``hi``, ``lo`` of sets (rid, fp) that connect those of equal fingerprints and of such within two bits."""
    nodes = written(rows.groupBy("fp").agg(F.min("rid").alias("node")), "near-prints")
    side = lambda end: nodes.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
    near = simhash.links(nodes).join(side("hi"), "hi").join(side("lo"), "lo").select(*jaccard_join.ends("hi_node", "lo_node"))
    return rows.select("rid", "fp").join(nodes, "fp").where("rid <> node").select(*jaccard_join.ends("rid", "node")).unionByName(near)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, root (a component's smallest node), __file, __row."""
    return jaccard_join.joined(docs, SHINGLE, ALIKE, LOW, empties=True, first=by_fingerprints).select("doc_id", "root", "__file", "__row")
