"""Recall at 20 of the nearest-neighbour index, for ids divisible by 100, against all rows: ``python tests/llm/measure_recall.py DIR...``"""

import sys
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from weirflow.llm import ann  # noqa: E402
from weirflow.package import ship  # noqa: E402


def main(folders: list[str]) -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").getOrCreate()
    ship(spark)
    for folder in folders:
        table = spark.read.parquet(f"{folder}/embeddings.parquet")
        kept = {r.vec_id: r.embedding for r in ann.usable(table).collect()}
        ids, vectors = np.array(list(kept)), np.array(list(kept.values()), np.float64)
        got: dict[int, set[int]] = {}
        for r in ann.neighbours(table, "vec_id % 100 = 0").collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        found = []
        for q in (i for i in kept if i % 100 == 0):
            scores = vectors @ np.array(kept[q], np.float64)
            scores[ids == q] = -np.inf
            best = ids[np.lexsort((ids, -scores))[:20]]
            found.append(len(got.get(q, set()) & set(best.tolist())) / len(best))
        visited = min(float(len(kept) * ann.TREES), max(ann.BUDGET * len(kept) ** ann.POWER, ann.FLOOR * ann.TOP * ann.TREES))
        print(f"{folder}: {len(kept)} vectors, {len(found)} queries, recall {np.mean(found):.4f}, leaves hold {visited:.0f} entries a query ({visited / len(kept):.2f} N, repeats over trees included)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
