"""Command line: index a library's markdown files, update it, search it, or print its statistics."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    p.add_argument("--store", required=True, help="folder of the stored collections, shared by all nodes")
    p.add_argument("--name", default="library", help="collection")
    sub = p.add_subparsers(dest="command", required=True)
    for command in ("index", "update"):
        c = sub.add_parser(command)
        c.add_argument("root", help="library folder with one folder for each document")
        c.add_argument("--limit", type=int, help="index the first files only")
        if command == "index":
            c.add_argument("--force", action="store_true", help="index unchanged files again")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10)
    sub.add_parser("stats")
    return p


def main(given: list[str] | None = None) -> dict | list:
    from pyspark.sql import functions as F

    from . import get_spark
    from .operators import search, workflow
    from .operators.embedding import HashEmbedder
    from .sources import collections, files

    a = arguments().parse_args(given)
    spark = get_spark()
    store = collections.Store(spark, a.store)
    if a.command in ("index", "update"):
        state = workflow.State(store, a.name)
        if a.command == "update" and not state.stats()["indexed"]:
            raise SystemExit("nothing is indexed yet; run index first")
        found = files.library(spark, a.root, ("md",), a.limit, content=True)
        rows = found.select("path", "mtime", files.file_text(F.col("content")).alias("text"))
        out = asdict(workflow.index_library(store, a.name, rows, HashEmbedder(), force=getattr(a, "force", False)))
    elif a.command == "search":
        chunks = workflow.chunk_collection(store, a.name).searchable()
        hits = search.top(search.bm25(chunks, a.query, "chunk_id"), max(1, a.top_k))
        out = [r.asDict() for r in hits.join(chunks.select(F.col("chunk_id").alias("doc_id"), "title", "path"), "doc_id").orderBy(F.desc("score"), "doc_id").collect()]
    else:
        out = workflow.State(store, a.name).stats() | {"chunks": workflow.chunk_collection(store, a.name).stats()["count"]}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
