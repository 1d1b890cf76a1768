"""python -m gristmill detect|compare ...: thin commands over the plans."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions.tokens import granularity
from .operators import relations as R
from .plans.detect import detect
from .sources.known_index import KnownIndex
from .sources.session import session
from .sources.tables import corpus, decoded, files


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gristmill")
    commands = parser.add_subparsers(dest="command", required=True)
    d = commands.add_parser("detect", help="known texts in the files below a folder")
    d.add_argument("folder")
    d.add_argument("--corpus", required=True, help="folder of <id>.txt files")
    d.add_argument("--threshold", type=float, default=0.95)
    d.add_argument("--index", help="folder of a lasting index, to which texts of the corpus are added that it does not have")
    c = commands.add_parser("compare", help="changes between two JSON tables of package and points")
    c.add_argument("before")
    c.add_argument("after")
    got = parser.parse_args(args)
    spark = session()
    if got.command == "detect":
        docs = files(spark, got.folder).select("path", decoded(F.col("content"))[0].alias("text"))
        known = corpus(files(spark, got.corpus).select("path", decoded(F.col("content"))[0].alias("content")))
        if got.index:
            index = KnownIndex(spark, got.index, granularity(got.threshold))
            index.add(known)
            known = index
        detect(docs, known, "path", "text", got.threshold).drop("ops").orderBy("path", "id").show(1000, truncate=False)
    else:
        both = R.deltas(spark.read.json(got.before), spark.read.json(got.after), "package", "points")
        R.buckets(both, "package").show()
        both.where("delta <> 0").orderBy("delta", "package").show(1000, truncate=False)


if __name__ == "__main__":
    main()
