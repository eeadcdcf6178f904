"""``python -m lumenfold STORE COMMAND ...``: ingest, watch, list, remove, index, find, search, ask, conversations, enrich, digest, stats, themes, derive, vacuum."""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.operators import corpus, insights, signals, stats
from lumenfold.plans import flows
from lumenfold.plans.follow import Cells, Grams, Index, follow_rollup, follow_signals
from lumenfold.plans.providers import ChatProvider, EchoChat, HashEmbedder
from lumenfold.plans.talks import Talks
from lumenfold.session import session
from lumenfold.settings import Settings
from lumenfold.sources.conversations import DIGESTS
from lumenfold.sources.snapshots import Snapshots
from lumenfold.sources.texts import from_folder
from lumenfold.streaming.drops import Watch


def _parser(settings: Settings) -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    parser.add_argument("store")
    parser.add_argument("--settings", help="a file of NAME=value lines; the environment wins")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "watch"):
        commands.add_parser(name).add_argument("folder")
    commands.choices["watch"].add_argument("--once", action="store_true")
    commands.choices["watch"].add_argument("--forget", action="store_true", help="entries of files that went go too")
    for name in ("list", "stats", "themes", "index", "vacuum"):
        commands.add_parser(name)
    commands.choices["index"].add_argument("--vectors", action="store_true", help="make the cells of vectors for approximate searches too")
    find = commands.add_parser("find")
    find.add_argument("pattern")
    find.add_argument("--index", action="store_true", help="make the index that finds patterns, or keep it up")
    for name, what in (("search", "query"), ("ask", "question")):
        sub = commands.add_parser(name)
        sub.add_argument(what)
        sub.add_argument("-k", type=int)
    commands.choices["search"].add_argument("--approximate", action="store_true", help="near vectors from the cells around the query, if index --vectors was run")
    commands.choices["ask"].add_argument("--conversation", help="goes on with this one, or begins it")
    talks = commands.add_parser("conversations")
    talks.add_argument("id", nargs="?")
    talks.add_argument("--rename")
    talks.add_argument("--delete", action="store_true")
    commands.add_parser("enrich").add_argument("--limit", type=int)
    commands.add_parser("digest").add_argument("--force", action="store_true")
    gone = commands.add_parser("remove")
    gone.add_argument("ids", nargs="*")
    gone.add_argument("--all", action="store_true", dest="everything")
    gone.add_argument("--yes", action="store_true")
    derive = commands.add_parser("derive")
    derive.add_argument("--since")
    derive.add_argument("--pass", dest="pass_name", choices=[*signals.PASSES], default="lexical")
    derive.add_argument("--rebuild", action="store_true")
    derive.add_argument("--aggregate", action="store_true")
    for name in ("search", "ask", "digest", "remove"):
        commands.choices[name].add_argument("--from", dest="date_from")
        commands.choices[name].add_argument("--to", dest="date_to")
        commands.choices[name].add_argument("--period", help="all, year, a year such as 2021, or the last days, as in 30days")
    return parser


def main(argv: list[str] | None = None, settings: Settings | None = None, chat: ChatProvider | None = None) -> None:
    """``chat`` stands for a chat model; the default only repeats what it is told."""
    args, chat = _parser(Settings()).parse_args(argv), chat or EchoChat()
    if settings is None:
        lines = ""
        if args.settings:
            with open(args.settings) as file:
                lines = file.read()
        settings = Settings.read(os.environ, lines)
    spark, now = session(), dt.datetime.now()
    store, embedder = Snapshots(spark, f"{args.store}/entries", corpus.CHUNKS), HashEmbedder()
    index, cells, talks = Index(spark, f"{args.store}/index"), Cells(spark, f"{args.store}/vectors"), Talks(spark, args.store)
    stamp, today = now.isoformat(timespec="seconds"), now.date()
    ingesting = {"day_first": settings.day_first, "target": settings.chunk_words, "overlap": settings.chunk_overlap}
    if getattr(args, "period", None):
        low, high = D.preset_range(args.period, today)
        args.date_from, args.date_to = args.date_from or low, args.date_to or high
    k = getattr(args, "k", None) or settings.k

    def indexed() -> Index | None:
        """The index, if there is one, brought up to the store."""
        if not index.mark():
            return None
        index.follow(store)
        return index

    if args.command == "ingest":
        status = flows.ingest(store, from_folder(spark, args.folder), embedder, today, stamp, **ingesting)
        corpus.dates_to_check(corpus.ingest_summary(status), settings.mtime_warning).show()
        corpus.date_sources(status).show()
        indexed()
    elif args.command == "watch":
        watch = Watch(spark, store, args.folder, f"{args.store}/watch", embedder, quiet=settings.quiet, forget=args.forget, index=index, **ingesting)
        try:
            watch.run(once=args.once)
        except KeyboardInterrupt:
            print("stopped")
    elif args.command == "list":
        corpus.list_entries(store.read()).show(1000, truncate=False)
    elif args.command == "index":
        index.rebuild(store)
        print(index.mark())
        if args.vectors:
            cells.rebuild(store)
            print(cells.mark())
    elif args.command == "vacuum":
        print(sum(s.vacuum() for s in (store, index.postings, index.gone, talks.heads, talks.messages)), "folders went")
    elif args.command == "remove":
        if not args.everything:
            flows.to_remove(store, args.ids, args.date_from, args.date_to).orderBy("entry_id").show(20, truncate=False)
        if args.yes or input("Remove? [y/N] ").strip().lower() == "y":
            print(flows.remove(store, args.ids, args.date_from, args.date_to, args.everything), "entries were asked to go")
            indexed()
    elif args.command == "search":
        near = args.approximate and cells.mark() is not None
        if near:
            cells.follow(store)
        found = flows.hybrid_search(store.read(), args.query, embedder, k, args.date_from, args.date_to, settings.pool, indexed(), cells if near else None)
        found.orderBy(F.desc("score")).select("date", "entry_id", "text").show(k, truncate=100)
    elif args.command == "find":
        grams = Grams(spark, f"{args.store}/grams")
        if args.index or grams.mark():
            grams.follow(store)
            grams.find(store, args.pattern).show(1000, truncate=False)
        else:
            corpus.search_entries(store.read(), args.pattern).show(1000, truncate=False)
    elif args.command == "ask":
        history = talks.history(args.conversation) if args.conversation else []
        said = flows.ask(store.read(), args.question, embedder, chat, today, k, args.date_from, args.date_to, history, True, settings.pool, indexed())
        print(said.text, *said.dates, sep="\n")
        if args.conversation:
            turns = [*history, {"role": "user", "content": args.question}, {"role": "assistant", "content": said.text}]
            talks.save(args.conversation, turns, stamp, None, args.date_from, args.date_to, k)
    elif args.command == "conversations":
        if args.id and args.rename:
            talks.rename(args.id, args.rename, stamp)
        elif args.id and args.delete:
            talks.delete(args.id)
        elif args.id:
            print(*(f"{m['role']}: {m['content']}" for m in talks.history(args.id)), sep="\n")
        else:
            talks.listed().select("id", "title", "updated_at").show(1000, truncate=False)
    elif args.command == "enrich":
        flows.enrich(store, chat, args.limit)
        corpus.pending(store.read()).show()
    elif args.command == "digest":
        cache = Snapshots(spark, f"{args.store}/digests", DIGESTS, "cache_key")
        entries = corpus.collapse(store.read(), args.date_from, args.date_to)
        text, cached, digests = flows.compose_digest(entries, cache.read(), chat, args.date_from or "", args.date_to or "", type(chat).__name__, stamp, args.force)
        if not cached:
            cache.replace(digests.where(F.col("created_at") == stamp))
        print(text)
    elif args.command == "stats":
        entries = corpus.collapse(store.read())
        for frame in (corpus.corpus_totals(store.read()), stats.entries_per_year(entries), stats.mean_mood_per_year(entries), stats.top_tokens(entries, "topics"), insights.cadence(entries, today)):
            frame.show(truncate=False)
    elif args.command == "themes":
        flows.discover_themes(store.read())[0].show(truncate=False)
    elif args.command == "derive":
        a_pass = signals.PASSES[args.pass_name]()
        store_of_pass = Snapshots(spark, f"{args.store}/signals_{a_pass.name}", corpus.SIGNALS)
        if args.since or args.rebuild:
            done = flows.derive(store, store_of_pass, a_pass, stamp, args.since, args.rebuild)
        else:
            done = follow_signals(store, store_of_pass, a_pass, stamp)
        done.groupBy("key").count().show(truncate=False)
        if args.aggregate:
            lexical = a_pass if isinstance(a_pass, signals.LexicalPass) else signals.LexicalPass()
            rolled = follow_rollup(store, store_of_pass, Snapshots(spark, f"{args.store}/rollup_{a_pass.name}", signals.ROLLUP), lexical)
            wide = signals.lexical_wide(rolled, lexical.keys) if lexical is a_pass else signals.emotion_wide(rolled)
            wide.show(truncate=False)
            signals.signal_entries(rolled, settings.trend_gate).show()


if __name__ == "__main__":
    main()
