"""The command line: scan, find duplicates, classify, plan, show, and on request copy.

    python -m cairn.cli SOURCE --base-dir DEST [options]
    python -m cairn.cli reclassify --catalog PATH [options]
"""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from cairn.functions.paths import parse_size, path_metadata
from cairn.operators import dedup, reclassify
from cairn.operators.classify import classify
from cairn.plans import organize
from cairn.session import session
from cairn.sinks import execute
from cairn.sinks.store import Store, by_file, mark_duplicates, operation_rows, put_classifications, upsert_files
from cairn.sources.scan import load_patterns, scan

log = logging.getLogger("cairn")


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="cairn", description=__doc__)
    p.add_argument("source")
    p.add_argument("--base-dir", help="where the plan puts files")
    p.add_argument("--filter", nargs="*", default=[], help="names of folders below the source to scan")
    p.add_argument("--max-files", type=int, default=0)
    p.add_argument("--ignore-file", default=".dedupignore")
    p.add_argument("--metadata-only-size", help="larger files are not hashed, as in 75MB")
    p.add_argument("--skip-duplicates", action="store_true")
    p.add_argument("--duplicate-report")
    p.add_argument("--flat", action="store_true", help="leave the root folder out of destinations")
    p.add_argument("--preview-log", help="folder for source and destination of every planned file")
    p.add_argument("--dry-run-log", nargs="?", const="", help="folder for every record of the run; dry_run_preview_<time>.<format> here, if none is named")
    p.add_argument("--log-format", choices=("txt", "json"), default="txt")
    p.add_argument("--write-metadata", action="store_true")
    p.add_argument("--execute", action="store_true")
    p.add_argument("--catalog", help="folder of catalog tables to keep up to date")
    p.add_argument("--categories", nargs="*", default=["other"])
    p.add_argument("--all", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--skip-cloud", action="store_true")
    return p.parse_args(argv)


def validate(a: argparse.Namespace) -> None:
    if not os.path.isdir(a.source) or not os.access(a.source, os.R_OK):
        raise SystemExit(f"not a folder that can be read: {a.source}")
    if not a.base_dir:
        raise SystemExit("--base-dir is missing")
    above = os.path.dirname(os.path.abspath(a.base_dir))
    if not os.path.isdir(above) or not os.access(above, os.W_OK):
        raise SystemExit(f"cannot write in {above}")
    os.makedirs(a.base_dir, exist_ok=True)


def run(a: argparse.Namespace) -> int:
    validate(a)
    spark = session()
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    tree = scan(spark, a.source, a.filter, a.max_files or None, load_patterns(a.ignore_file), parse_size(a.metadata_only_size)).cache()
    failed = tree.where("error is not null").count()
    if failed:
        print(f"error: {failed} entries could not be read and are left out")
    files = tree.where("error is null").withColumn("seq", F.split("path", "/"))
    marked = dedup.mark_duplicates(files, "seq").cache()
    for line in dedup.report(files, "seq"):
        log.info(line)
    if a.duplicate_report:
        execute.write_file(dedup.report_lines(files, "seq"), a.duplicate_report)
    kept = classify(dedup.filter_duplicates(marked, not a.skip_duplicates), to="type").withColumn("path_metadata", path_metadata("path"))
    planned = organize.plan(kept, a.base_dir, not a.flat).cache()
    for line in organize.tree_text(planned):
        print(line)
    for r in organize.category_counts(planned).orderBy("type").collect():
        print(f"{r.type}: {r.n}")
    if a.preview_log:
        execute.write_lines(organize.preview(planned, a.log_format), a.preview_log)
    if a.dry_run_log is not None:
        here = f"file://{os.getcwd()}/dry_run_preview_{now:%Y%m%d_%H%M%S}.{a.log_format}"
        execute.write_lines(organize.dry_run(planned.drop("seq"), a.log_format), a.dry_run_log or here)
    copied = None
    if a.execute:
        done = execute.copy_files(planned, True, a.write_metadata).cache()
        for r in done.groupBy("status").count().orderBy("status").collect():
            print(f"{r.status}: {r['count']}")
        copied = done.where("status = 'copied'")
    if a.catalog:
        keep(spark, a.catalog, marked, planned, copied, now)
    return 0


def keep(spark, path: str, marked, planned, copied, now) -> None:
    """Bring the catalog up to date; operations are those that a run with --execute carried out."""
    store = Store(spark, path)
    store.init()
    rows = marked.select("path", "size", F.col("mtime").cast("timestamp_ntz").alias("mtime"), "hash", "metadata_only")
    store.merge("files", rows, lambda old, new, top: upsert_files(old, new, now, top=top))
    dups = marked.where("is_duplicate").select("path", F.col("original_path").alias("duplicate_of"))
    store.merge("files", dups, lambda old, new, _: mark_duplicates(old, new))
    classes = planned.select("path", F.col("type").alias("category"), F.lit(0.8).alias("confidence"))
    store.merge("classifications", by_file(store.read("files"), classes), lambda old, new, top: put_classifications(old, new, now, top))
    if copied is not None:
        last = store.read("operations").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        moves = copied.select("path", F.lit("MOVE").alias("action"), F.col("destination").alias("target_path"))
        store.append("operations", operation_rows(store.read("files"), moves, last))


def run_reclassify(a: argparse.Namespace) -> int:
    spark = session()
    store = Store(spark, a.catalog)
    files, classes = store.read("files"), store.read("classifications")
    done = reclassify.reclassify(files, classes, None if a.all else a.categories, execute.existing(files), a.skip_cloud).cache()
    print(reclassify.counters(done).first().asDict())
    for r in reclassify.changes(done).orderBy("old_category", F.desc("n")).collect():
        print(f"{r.old_category} -> {r.new_category}: {r.n}")
    if not a.dry_run:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        store.merge("classifications", by_file(files, reclassify.updates(done)), lambda old, new, top: put_classifications(old, new, now, top))
    return 0


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    a = arguments(sys.argv[1:] if argv is None else argv)
    return run_reclassify(a) if a.source == "reclassify" else run(a)


if __name__ == "__main__":
    raise SystemExit(main())
