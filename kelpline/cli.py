"""Command line: index, status, clean, collections, excludes, configuration and models."""

from __future__ import annotations

import argparse
import os
import sys

from . import config as cfg
from .functions import embed
from .operators.store import Store
from .session import local_session
from .sources.discover import DEFAULT_EXCLUDE_PATTERNS, DEFAULT_INDEX_PATTERNS


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kelpline")
    sub = p.add_subparsers(dest="command", required=True)

    def common(q, collection=True):
        q.add_argument("-u", "--store", "--url")
        q.add_argument("-q", "--quiet", action="store_true")
        if collection:
            q.add_argument("-c", "--collection", required=True)

    def files(q):
        q.add_argument("path")
        q.add_argument("--state-file")
        q.add_argument("-p", "--pattern", action="append")
        q.add_argument("-e", "--exclude", action="append", default=[])
        q.add_argument("--no-default-excludes", action="store_true")

    q = sub.add_parser("index")
    files(q)
    common(q)
    q.add_argument("-m", "--model", "--embedding-model", default=embed.DEFAULT_MODEL)
    q.add_argument("--chunk-size", type=int, default=1536)
    q.add_argument("--chunk-overlap", type=int, default=200)
    q.add_argument("--chunker", default="auto")
    q.add_argument("--batch-size", type=int, default=100)
    q.add_argument("--embedding-batch-size", type=int, default=64)
    q.add_argument("-w", "--workers", type=int)
    q.add_argument("--full", action="store_true")
    q.add_argument("--incremental", dest="full", action="store_false")
    q.add_argument("-v", "--verbose", action="count", default=0)
    q.add_argument("--gpu", "--cuda", action="store_true")
    q.add_argument("--images", action=argparse.BooleanOptionalAction, default=False)
    q.add_argument("--image-model", "--clip-model", default=embed.DEFAULT_IMAGE_MODEL)
    q.add_argument("--min-image-size", type=int, default=100)
    q = sub.add_parser("status")
    files(q)
    common(q, collection=False)
    q = sub.add_parser("clean")
    files(q)
    common(q)
    q.add_argument("--all", action="store_true")
    q.add_argument("-y", "--yes", action="store_true")
    common(sub.add_parser("list-collections"), collection=False)
    q = sub.add_parser("delete-collection")
    q.add_argument("name")
    common(q, collection=False)
    q.add_argument("-y", "--yes", action="store_true")
    sub.add_parser("show-excludes")
    q = sub.add_parser("init")
    q.add_argument("-t", "--target")
    q.add_argument("--local", action="store_true")
    q.add_argument("-f", "--force", action="store_true")
    for name in ("list-models", "list-image-models", "list-clip-models"):
        sub.add_parser(name).add_argument("search", nargs="?")
    return p


def _ask(question: str, yes: bool) -> bool:
    return yes or input(f"{question} [y/N] ").strip().lower() in ("y", "yes")


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    say = (lambda *x: None) if getattr(a, "quiet", False) else print
    if a.command == "show-excludes":
        say("\n".join(DEFAULT_EXCLUDE_PATTERNS))
        return 0
    if a.command == "init":
        try:
            say(cfg.init(a.target, a.local, a.force))
        except FileExistsError as exc:
            print(exc, file=sys.stderr)
            return 1
        return 0
    spark = spark or local_session("*")
    if a.command in ("list-models", "list-image-models", "list-clip-models"):
        registry = embed.MODELS if a.command == "list-models" else embed.IMAGE_MODELS
        for row in embed.models_table(spark, a.search, registry).toLocalIterator():
            say(f"{row['model']}\t{row['size']}\t{row['description']}")
        return 0
    settings = cfg.with_overrides(cfg.load_config(), store=a.store)
    root = os.path.abspath(settings.store.path) if "://" not in settings.store.path else settings.store.path
    if a.command == "list-collections":
        for row in Store(spark, root).list().toLocalIterator():
            say(f"{row['name']}\t{row['points_count']}\t{row['vector_size']}")
        return 0
    if a.command == "delete-collection":
        store = Store(spark, root)
        if not store.exists(a.name):
            print(f"no collection {a.name!r}", file=sys.stderr)
            return 1
        if _ask(f"Delete {a.name}?", a.yes):
            store.delete(a.name)
        return 0
    from .engine import ANY, Engine

    patterns = a.pattern or list(DEFAULT_INDEX_PATTERNS)
    exclude = [*a.exclude, *(() if a.no_default_excludes else DEFAULT_EXCLUDE_PATTERNS)]
    directory, state = os.path.abspath(a.path), a.state_file
    if not os.path.exists(directory) or a.command != "index" and not os.path.isdir(directory):
        print(f"no directory {directory}", file=sys.stderr)
        return 1
    if a.command in ("status", "clean") and not Engine(spark, root, ANY).has_state(directory, state):
        say("No saved state; run index first.")
        return 0 if a.command == "status" else 1
    try:
        if a.command == "index":
            if a.gpu and "CUDAExecutionProvider" not in embed.providers(True):
                print("no GPU here, models run on the CPU", file=sys.stderr)
            report = (lambda e, i, n, m: say(e, m)) if a.verbose else None
            engine = Engine(spark, root, a.collection, a.model, a.chunker, a.chunk_size, a.chunk_overlap, report, a.images, a.image_model, a.min_image_size)
            result = engine.index_file(directory) if os.path.isfile(directory) else engine.index(directory, patterns, exclude) if a.full else engine.sync(directory, state, patterns, exclude)
        else:
            engine = Engine(spark, root, getattr(a, "collection", None) or ANY)
            if a.command == "status":
                result = engine.status(directory, state, patterns, exclude)
            elif _ask("Remove these points?", a.yes):
                result = engine.clean(directory, state, a.all)
            else:
                return 0
    except ValueError as exc:
        print(exc, file=sys.stderr)
        return 1
    for key, value in result.items():
        say(f"{key}: {value}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
