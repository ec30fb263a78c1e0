"""Held-out figures of the two classifiers, by language: python tests/llm/held_out.py TABLES [TABLES ...]. The README quotes what it prints."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F

from weftgraph.llm import quality, toxicity
from weftgraph.session import local_session, table


def by_language(scored, docs, label):
    """(language, rows of label 1, of these predicted 1, rows of label 0, of these predicted 1) of held-out rows."""
    rows = scored.where("held_out").join(docs, "doc_id").where(f"{label} is not null")
    one, hit = F.col(label) == 1, F.col("predicted") == 1
    return rows.groupBy("lang").agg(F.count_if(one), F.count_if(one & hit), F.count_if(~one), F.count_if(~one & hit)).orderBy("lang").collect()


def main() -> None:
    spark = local_session("held out", cores=8)
    for sf_dir in sys.argv[1:]:
        docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        known = docs.select("doc_id", "lang").join(labels, "doc_id")
        for name, label, scored in (("toxicity", "toxic", toxicity.toxicity(docs, labels)), ("quality", "quality", quality.quality(docs, labels))):
            rows = by_language(scored, known, label)
            total = [sum(r[i] for r in rows) for i in range(1, 5)]
            print(sf_dir, name, f"found {total[1]}/{total[0]}", f"false {total[3]}/{total[2]}", "; ".join(f"{r[0]} {r[2]}/{r[1]}, {r[4]}/{r[3]}" for r in rows), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
