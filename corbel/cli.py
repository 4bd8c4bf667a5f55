"""python -m corbel.cli COMMAND ...: the engine on one index."""

import argparse
import json
import os
import time
from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import __version__, service, tools
from . import config as C
from .operators import graph, search
from .plans.index import add_documents, ask, embedder, find, indexer
from .schema import ConfigError
from .sources import loaders
from .sources.store import Store, diff, export_documents, fingerprints
from .streaming.watch import sync_folder, watch


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corbel")
    p.add_argument("--config")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **flags):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for a, kind in flags.items():
            c.add_argument(f"--{a}", **({"action": "store_true"} if kind is bool else {"action": "append"} if kind is list else {"type": kind}))

    add("index", "path")
    add("query", "text", hybrid=bool, k=int, filter=list, rerank=bool, explain=bool)
    add("ask", "text", hybrid=bool, k=int)
    add("prompt", "text", hybrid=bool, k=int, filter=list, template=str)
    for name in ("info", "clear", "migrate", "show-config", "status", "doctor", "collections", "compact"):
        add(name)
    add("diff", "path")
    add("export", "path")
    add("import", "path")
    add("backup", "path")
    add("watch", "path", seconds=int)
    add("graph", "start", hops=int)
    add("graph-build", "path")
    add("graph-query", "path", "text", hops=int, k=int)
    add("serve", host=str, port=int)
    add("mcp", tools=str)
    add("init", "path", force=bool)
    add("completions", "shell")
    add("benchmark", "text", times=int)
    return p


def run(spark: SparkSession, args: argparse.Namespace, conf: C.Config, say=print) -> None:
    store, kinds = Store(spark, conf.db), conf.extensions.split(",")
    filters = dict(x.split("=", 1) for x in getattr(args, "filter", None) or [])
    match args.command:
        case "index":
            say(json.dumps(sync_folder(store, args.path, indexer(conf), kinds, 0, embedder(conf).model)))
        case "query":
            hits = find(spark, store, args.text, conf, args.hybrid, filters, args.k, search.rerank_keyword if args.rerank else None)
            for r in hits.orderBy("rank").toLocalIterator():
                more = {"distance": 1 - r.score, "bytes": len(r.text.encode()), "metadata": r.metadata} | {c: r[c] for c in ("v_rank", "v_score", "b_rank", "b_score") if c in hits.columns} if args.explain else {}
                say(json.dumps({"rank": r["rank"], "score": round(r.score, 6), "doc_id": r.doc_id, "source": r.source, "text": r.text} | more, ensure_ascii=False))
        case "ask":
            say(ask(spark, store, args.text, conf, args.hybrid, args.k).first().answer)
        case "prompt":
            say(search.prompt(find(spark, store, args.text, conf, args.hybrid, filters, args.k), args.template).first().prompt)
        case "info":
            say(json.dumps(store.metadata() | {"chunks": store.count(), "files": store.table("fingerprints").count()}))
        case "status":
            say(json.dumps({"database": {"path": conf.db, "chunks": store.count()} | store.metadata(), "model": embedder(conf).model, "config": str(C.discover() or "")}))
        case "doctor":
            for name, work in (("index", lambda: f"{store.count()} chunks, version {store.metadata()['schema_version']}"), ("embedder", lambda: f"dimension {len(embedder(conf).embed(['x'])[0])}"), ("version", lambda: __version__)):
                try:
                    say(f"{name}: ok, {work()}")
                except Exception as e:  # what is wrong is the answer
                    say(f"{name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        case "collections":
            for r in store.counts().orderBy("collection").toLocalIterator():
                say(f"{r.collection or 'default'} {r.chunks}")
        case "compact":
            store.compact()
        case "clear":
            store.clear()
        case "migrate":
            say(f"from version {store.migrate()}")
        case "show-config":
            say(json.dumps(vars(conf) | {"api_key": "***" if conf.api_key else ""}))
        case "diff":
            for r in diff(fingerprints(loaders.scan(spark, args.path, kinds)), store.table("fingerprints")).orderBy("path").toLocalIterator():
                say(f"{r.status} {r.path}")
        case "export":
            loaders.write_jsonl(export_documents(store), args.path)
        case "import":
            add_documents(store, loaders.read_jsonl(spark, args.path), conf)
        case "backup":
            store.backup(args.path)
        case "watch":
            q = watch(spark, store, args.path, indexer(conf), kinds, model=embedder(conf).model)
            q.awaitTermination(args.seconds) if args.seconds else q.awaitTermination()
            q.stop()
        case "graph":
            edges = graph.cooccurrence(graph.entities(store.all()))
            for r in graph.traverse(edges, spark.createDataFrame([(args.start,)], "start string"), args.hops or 2).orderBy("depth", "name").toLocalIterator():
                say(f"{r.depth} {r.name}")
        case "graph-build":
            graph.save(graph.entities(store.all()), args.path)
            say(json.dumps(graph.counts(spark, args.path)))
        case "graph-query":
            _, edges, found = graph.load(spark, args.path)
            for r in graph.search(edges, found, spark.createDataFrame([(0, args.text)], "query_id int, text string"), args.k or conf.top_k, args.hops or 2).orderBy("rank").toLocalIterator():
                say(f"{r.score:.6f} {r.chunk_id}")
        case "serve":
            made = service.server(spark, conf, args.host, args.port)
            say(f"http://{made.server_address[0]}:{made.server_port}")
            made.serve_forever()
        case "mcp":
            tools.serve(tools.Tools(service.Engine(spark, conf), args.tools.split(",") if args.tools else None))
        case "init":
            if os.path.exists(args.path) and not args.force:
                raise ConfigError(f"{args.path} is there already")
            with open(args.path, "w") as f:
                f.writelines(f"{x.name} = {json.dumps(x.default)}\n" for x in fields(C.Config))
            say(args.path)
        case "completions":
            words = " ".join(next(a for a in parser()._actions if a.dest == "command").choices)
            ways = {"bash": f"complete -W '{words}' corbel", "zsh": f"compctl -k '({words})' corbel", "fish": f"complete -c corbel -f -a '{words}'"}
            if args.shell not in ways:
                raise ConfigError(f"shell {args.shell}; {', '.join(ways)} are known")
            say(ways[args.shell])
        case "benchmark":
            took = []
            for _ in range(args.times or 5):
                begin = time.perf_counter()
                find(spark, store, args.text, conf).agg(F.count("*")).first()
                took.append(time.perf_counter() - begin)
            say(json.dumps({"avg": sum(took) / len(took), "min": min(took), "max": max(took)}))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("corbel").getOrCreate(), args, C.load(args.config))


if __name__ == "__main__":
    main()
