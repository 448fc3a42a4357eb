"""Search from the command line: ``python -m lodestone.plans.cli FOLDER "query"`` or ``-i`` to ask on."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.plans.pipeline import Pipeline
from lodestone.session import session


def show(p: Pipeline, system: str, query: str, k: int) -> str:
    q = p.spark.createDataFrame([(0, query)], "query_id long, text string")
    c = p.read("chunks").select("chunk_id", "metadata.component", "metadata.headings", T.preview(F.col("text")).alias("preview"))
    lines = []
    for r in p.search(system, q, k).join(c, "chunk_id").orderBy("rank").collect():
        lines += [f"{r.rank}. {r.chunk_id}  {r.score:.4f}", f"   {r.component or '-'} | {' > '.join(r.headings or [])}", f"   {r.preview}"]
    return "\n".join(lines) or "no results"


def main(args: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("folder")
    a.add_argument("query", nargs="*")
    a.add_argument("--system", choices=("bm25", "dense"), default="bm25")
    a.add_argument("--k", type=int, default=10)
    a.add_argument("-i", "--interactive", action="store_true")
    o = a.parse_args(args)
    if o.k <= 0 or not (o.query or o.interactive):
        a.error("a query, or -i, and a positive --k")
    p = Pipeline(session(), o.folder)
    if o.query:
        print(show(p, o.system, " ".join(o.query), o.k))
    while o.interactive and (line := sys.stdin.readline()):
        if line.strip():
            print(show(p, o.system, line.strip(), o.k))
    return 0


if __name__ == "__main__":
    sys.exit(main())
