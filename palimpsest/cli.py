"""Command line over a store: ``python -m palimpsest.cli --store DIR COMMAND``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from palimpsest import render
from palimpsest.functions import jobs
from palimpsest.functions.canon import json_fields, strict
from palimpsest.operators import catalog, diff, extract, facets, report, search, timeline, versions
from palimpsest.session import session
from palimpsest.sources import ingest, nodes
from palimpsest.sources.store import Store
from palimpsest.sources.tables import release_order, releases


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("--store", default=os.environ.get("PALIMPSEST_STORE", "palimpsest-store"))
    p.add_argument("--master", default=None)
    c = p.add_subparsers(dest="command", required=True)

    def add(name: str, help_: str, *args: tuple) -> None:
        q = c.add_parser(name, help=help_)
        for a in args:
            names, options = (a[:-1], a[-1]) if isinstance(a[-1], dict) else (a, {})
            q.add_argument(*names, **options)

    flag, many = {"action": "store_true"}, {"action": "append", "default": []}
    add("import", "a client folder as a new version", ("client",), ("--label", {"required": True}), ("--patchdata",), ("--channel", {"default": "live"}), ("--note",), ("--baseline", flag))
    add("versions", "list versions")
    add("remove", "delete a version; without --yes only say so", ("version",), ("--yes", flag))
    add("gc", "drop payloads that nothing refers to")
    add("baseline", "show or set the baseline", ("version", {"nargs": "?"}))
    add("info", "what a version holds", ("version", {"nargs": "?", "default": "latest"}))
    add("extractors", "list extractors")
    add("extract", "run extractors over a table of nodes", ("version",), ("--nodes", {"required": True}), ("--only", many))
    add(
        "diff", "what changed between two versions", ("--from", {"dest": "old"}), ("--to", {"dest": "new", "default": "latest"}), ("--kind",), ("--category", many), ("--job", many),
        ("--advancement", many), ("--data-only", flag), ("--hide-text", flag), ("--format", {"choices": ["text", "markdown", "json"], "default": "text"}), ("--out", "-o"), ("--limit", {"type": int, "default": 50}),
    )
    add("history", "how records of a key changed", ("key",), ("--kind",), ("--json", flag))
    add("search", "records by key or payload", ("text",), ("--version", {"default": "latest"}), ("--kind",), ("--limit", {"type": int, "default": 50}))
    add("ls", "children of a node", ("--nodes", {"required": True}), ("version",), ("path", {"nargs": "?", "default": ""}))
    add("show", "a node as JSON", ("--nodes", {"required": True}), ("version",), ("path",), ("--depth", {"type": int, "default": 3}))
    add("jobs", "list jobs")
    add("skills", "list skills", ("--version", {"default": "latest"}), ("--job", many), ("--advancement", many), ("--all", flag))
    add("skill", "one skill", ("id",), ("--version", {"default": "latest"}), ("--json", flag))
    return p


def main(argv: list[str] | None = None, spark=None) -> int:  # noqa: ANN001
    a = parser().parse_args(argv)
    spark = spark or session(master=a.master)
    try:
        render.emit(run(a, spark), getattr(a, "out", None))
    except (KeyError, ValueError) as e:
        print(f"error: {e.args[0]}", file=sys.stderr)
        return 1
    return 0


def run(a, spark):  # noqa: ANN001, ANN201, C901
    """Lines that a command prints."""
    if a.command == "extractors":
        return list(extract.EXTRACTORS)
    if a.command == "jobs":
        return [f"{i:>4}  {name:<28} {branch:<9} {next(x[3] for x in jobs.ADVANCEMENTS if x[0] == n)}" for i, name, branch, n in jobs.JOBS]
    store = Store(spark, a.store)
    have = store.table("versions")
    base = store.meta("baseline")
    pick = lambda s: versions.resolve(have, s, base)
    label = dict(release_order(have))
    if a.command == "import":
        return [json.dumps(ingest.import_client(store, a.client, a.label, a.channel, a.patchdata, a.note, a.baseline))]
    if a.command == "versions":
        rows = versions.ordered(have).orderBy("place").select("version_id", "label", "channel", "imported_at", "build_time", F.when(F.col("label") == F.lit(base), "baseline").alias("mark"))
        return render.table(rows.collect(), rows.columns)
    if a.command == "remove":
        v = pick(a.version)
        if not a.yes:
            return [f"would delete {label[v]} (#{v}); say --yes to do it"]
        store.remove_version(v)
        return [f"deleted {label[v]} (#{v})"]
    if a.command == "gc":
        gone = store.gc()
        return [f"{gone['objects']} objects ({gone['bytes']} bytes) and {gone['blobs']} payloads dropped"]
    if a.command == "baseline":
        if a.version:
            store.set_meta("baseline", label[pick(a.version)])
        return [store.meta("baseline") or "no baseline"]
    records, blobs = store.table("records"), store.table("blobs")
    if a.command == "info":
        v = pick(a.version)
        done = store.table("extractions").where(F.col("version_id") == v).orderBy("extractor").collect()
        kinds = records.where(F.col("version_id") == v).groupBy("kind").count().orderBy("kind").collect()
        return [f"{label[v]} (#{v})", *render.table(done, ["extractor", "record_count", "finished_at"]), *render.table(kinds, ["kind", "count"])]
    if a.command == "extract":
        return [f"extracted {n} {k} records in {s:.1f} s" for k, (n, s) in ingest.run_extractors(store, pick(a.version), spark.read.parquet(a.nodes), a.only).items()]
    if a.command == "diff":
        return _diff(a, store, have, base, pick, label)
    if a.command == "history":
        rows = search.with_key(records, a.key)
        rows = rows.where(F.col("kind") == a.kind) if a.kind else rows
        # Coverage is told from all records of the kinds, so only the events are narrowed to the key.
        found = timeline.events(records.join(rows.select("kind").distinct(), "kind", "left_semi"), releases(spark, have))
        found = diff.attach(search.with_key(found, a.key), blobs, "blob_hash", "data").orderBy("kind", "key", "ord")
        w = F.lag("data").over(_by_record())
        found = found.withColumn("fields", F.when(F.col("status") == "modified", json_fields(w, F.col("data"))).otherwise(F.array())).orderBy("kind", "key", "ord")
        return [json.dumps(r.asDict(recursive=True), ensure_ascii=False) for r in found.toLocalIterator()] if a.json else report.stream(report.history(found, have))
    if a.command == "search":
        return report.stream(report.hits(search.search(records, blobs, pick(a.version), a.text, a.kind, a.limit), a.limit))
    if a.command in ("ls", "show"):
        tree = spark.read.parquet(a.nodes).where(F.col("version_id") == pick(a.version))
        if a.command == "ls":
            nodes.get(tree, a.path)
            return [f"{r.name:<32} {r.type:<8} {r.shown or ''}" for r in nodes.ls(tree, a.path).toLocalIterator()]
        return [extract.node_json(nodes.subtree(nodes.get(tree, a.path).unionByName(tree), a.path, a.depth + 1 if a.depth else 0), a.path, a.depth)]
    if a.command == "skills":
        chosen = facets.FacetFilter()
        for j in a.job:
            chosen = chosen.add_job(j)
        for x in a.advancement:
            chosen = chosen.add_advancement(x)
        rows = jobs.named(catalog.labelled(catalog.skills(records, blobs, pick(a.version))), "job").withColumn("category", F.lit("skills")).withColumn("detail", F.lit("data"))
        rows = rows.where(chosen.condition() & (F.lit(a.all) | catalog.is_listed())).orderBy("job", "id")
        return [f"{r.id:<10} {r.label:<32} {r.job_name:<28} max {r.max_level}" for r in rows.toLocalIterator()]
    found = catalog.labelled(catalog.skills(records, blobs, pick(a.version)).where(F.col("id") == a.id))
    rows = found.collect()
    if not rows:
        raise KeyError(f"no skill {a.id}")
    if not a.json:
        return report.stream(report.skill(found))
    return [json.dumps(rows[0].asDict(recursive=True), indent=2, ensure_ascii=False)]


def _by_record():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("kind", "key").orderBy("ord")


def _diff(a, store, have, base, pick, label):  # noqa: ANN001, ANN202
    new = pick(a.new)
    old = pick(a.old) if a.old else versions.diff_base(have, new, base)
    if old is None:
        raise ValueError(f"{label[new]} is the oldest version; name one with --from")
    if old == new:
        raise ValueError("both sides are the same version")
    chosen = facets.FacetFilter(data_only=a.data_only)
    for method, values in (("add_category", a.category), ("add_job", a.job), ("add_advancement", a.advancement)):
        for v in values:
            chosen = getattr(chosen, method)(v)
    found = diff.changes(store.table("records"), store.table("blobs"), old, new, a.kind)
    if not chosen.is_empty():
        found = facets.with_facets(found, strict(F.coalesce("new_data", "old_data"), "job", "int")).where(chosen.condition())
    if a.hide_text:
        found = found.where(~diff.is_text_only())
    if a.format == "json":
        rows = found.orderBy("kind", "key").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))
        return (r.line for r in rows.toLocalIterator())
    form = report.MARKDOWN if a.format == "markdown" else report.TEXT
    return report.stream(report.changes(found, label[old], label[new], a.limit, form))


if __name__ == "__main__":
    sys.exit(main())
