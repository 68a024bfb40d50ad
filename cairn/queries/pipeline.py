"""Queries of the pipeline's operators over the catalog tables, with their SQL."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import functions as F

from cairn.catalog import table
from cairn.functions import paths, rules
from cairn.operators import classify, dedup, reclassify
from cairn.plans import organize
from cairn.session import cut, remove, shared_path
from cairn.sinks import execute, store
from cairn.sources import scan

BASE = "/organized"
#: What the queries for hidden, packaged and cloud files put before paths, by id; the tables have no such files.
PREFIXES = ("", "/.cache", "/srv/Dropbox", "/Apps/Tool.app/Contents", "/Apps/Ignored.app", "/home/Google Drive/x", "/data")
#: Endings and the category each must have, one or more for every rule, typed out from the rules' description.
ENDINGS = (
    ("/x.jpg", "image"), ("/x.mp4", "video"), ("/x.mp3", "audio"), ("/x.ttf", "font"), ("/x.csv", "spreadsheet"), ("/x.py", "document"), ("/x.pdf", "document"), ("/x.doc", "document"),
    ("/x.xls", "spreadsheet"), ("/x.ppt", "presentation"), ("/x.zip", "archive"), ("/x.json", "data"), ("/x.xml", "document"), ("/x.sh", "code"), ("/x.psd", "image"), ("/x.ts", "video"),
    ("/x.flac", "audio"), ("/x.tex", "document"), ("/x.ods", "spreadsheet"), ("/x.key", "presentation"), ("/x.java", "code"), ("/x.7z", "archive"), ("/x.yaml", "data"), ("/x.dfont", "font"),
    ("/x.exe", "installer"), ("/x.pem", "certificate"), ("/x.lnk", "shortcut"), ("/x.mat", "scientific"), ("/x.qdf", "financial"), ("/x.h264", "financial"), ("/x.tax2023", "financial"), ("/x.q2a", "financial"),
    ("/x.bak", "backup"), ("/x.tmp", "temporary"), ("/x.plist", "system"), ("/x.pbxproj", "code"), ("/Makefile", "code"), ("/Gemfile", "code"), ("/LICENSE", "system"), ("/.gitignore", "system"),
    ("/A/Contents/MacOS/run", "installer"), ("/A/Contents/PlugIns/q", "system"), ("/A/Contents/Resources/q", "system"), ("/my alias", "shortcut"), ("/x.log2", "system"), ("/q.log.1zz", "system"), ("/workspace/q", "data"), ("/.idea/q", "data"),
    ("/cs101", "education"), ("/Bio lab", "education"), ("/W2 form", "financial"), ("/Quicken/q", "financial"), ("/www/page", "web"), ("/public_html/q", "web"), ("/www/index.html", "document"), ("/Packet Tracer/q", "application"),
    ("/zzz", "other"), ("/CS101.pdf", "document"), ("/x.csv.gz", "spreadsheet"), ("/x.tar.gz", "archive"), ("/x.tgz", "archive"), ("/x.gz", "archive"), ("/x.svgz", "image"), ("/.bashrc", "other"), ("/foo.", "other"), ("/X.JPG", "image"), ("/x.Z", "other"),
)
IGNORE = ["*.tmp", "*.log", "desktop.ini", "IMG?0[0-4]*", "[!a-zA-Z]*", "/Users/shared/Backups*", "/Users/shared/Projects/README.md"]


def _files(spark, d):
    return table(spark, d, "files")


def _once(spark, d, *columns: str):
    """Every file once, whatever the number of its deliveries, which are alike in all columns."""
    return _files(spark, d).select(*columns or ["*"]).distinct()


def _varied(spark, d, *columns: str):
    """Every file once, behind one of PREFIXES."""
    before = F.element_at(F.array(*map(F.lit, PREFIXES)), (F.col("id") % len(PREFIXES) + 1).cast("int"))
    return _once(spark, d, *columns).withColumn("path", F.concat(before, "path"))


MAIN = ("id", "path", "size", "hash")


def dup_groups(spark, d):
    return dedup.duplicate_groups(_once(spark, d, *MAIN))


def dup_marked(spark, d):
    return dedup.mark_duplicates(_once(spark, d, *MAIN), loads=_files(spark, d)).select("id", "path", "hash", "is_duplicate", "original_path")


def dup_totals(spark, d):
    return dedup.duplicate_totals(_once(spark, d, *MAIN))


def dup_filtered(spark, d):
    return dedup.filter_duplicates(dedup.mark_duplicates(_once(spark, d, *MAIN), loads=_files(spark, d))).select("id", "path")


def dup_names(spark, d):
    """Every path of every name that several files bear."""
    return dedup.same_names(_once(spark, d, "id", "path"), loads=_files(spark, d))


def dup_numbered(spark, d):
    return dedup.numbered_groups(_once(spark, d, *MAIN)).select("group_no", "hash", "n", "wasted")


def dup_report(spark, d):
    return dedup.report_lines(_once(spark, d, *MAIN))


def dup_originals(spark, d):
    return dedup.with_originals(_once(spark, d, *MAIN, "duplicate_of"), _files(spark, d))


def run_summary(spark, d):
    return organize.run_summary(dedup.mark_duplicates(_once(spark, d, *MAIN), loads=_files(spark, d)))


def plan_folders(spark, d):
    return organize.parent_folders(_plan(spark, d))


def scan_filter(spark, d):
    """The first entries, in path order, below the named folders: a scan with root names and an early stop."""
    files = _once(spark, d, "id", "path").where(paths.top_folder("path", "/Users").isin("shared", "ivoss") & ~paths.is_hidden("path"))
    return files.orderBy("path", "id").limit(500).select("id", "path")


def meta_only(spark, d):
    size, t = F.col("size"), 1 << 20
    return _once(spark, d, *MAIN).select("id", F.coalesce(size > t, F.lit(False)).alias("is_large"), F.when(size > t, "METADATA_ONLY").otherwise(F.col("hash")).alias("hash"))


def hidden_filter(spark, d):
    return _varied(spark, d, "id", "path").where(paths.is_hidden("path")).select("id", "path")


def ignore_filter(spark, d):
    return _once(spark, d, "id", "path").where(paths.is_ignored("path", IGNORE)).select("id", "path")


def package_items(spark, d):
    """Files that are no part of a package, and the packages. What lies in an ignored package comes file by file."""
    files = _varied(spark, d, "id", "path").where("path is not null")
    above = files.select("id", F.explode(paths.ancestors("path")).alias("above"))
    inner = above.where(paths.is_package("above") & ~paths.is_ignored("above", ["Ignored.app"])).select("id").distinct()
    return files.join(inner, "id", "left_anti").withColumn("is_package", paths.is_package("path"))


def package_sizes(spark, d):
    """Files, bytes and latest change below every folder."""
    files = _once(spark, d, "id", "path", "size", "mtime").where("path is not null")
    up = files.select(F.explode(paths.ancestors("path")).alias("dir"), "size", "mtime")
    return up.groupBy("dir").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("mtime").alias("last_mtime"))


def _classified(spark, d):
    return classify.classify(_once(spark, d, "id", "path", "size"), to="type")


def classified(spark, d):
    return _classified(spark, d).select("id", "path", "type")


def classified_endings(spark, d):
    """Every file with one of ENDINGS behind its id, counted by ending and category."""
    ending = F.element_at(F.array(*(F.lit(e) for e, _ in ENDINGS)), (F.col("id") % len(ENDINGS) + 1).cast("int"))
    files = _once(spark, d, "id").where("id is not null").select(ending.alias("ending"), F.concat(F.lit("/v/"), F.col("id") % 7, ending).alias("path"))
    return classify.classify(files, to="type").groupBy("ending", "type").agg(F.count(F.lit(1)).alias("n"))


def category_counts(spark, d):
    return organize.category_counts(_classified(spark, d))


def path_metadata(spark, d):
    md = F.col("md")
    join = lambda f: F.array_join(md[f], "|").alias(f)
    one = _once(spark, d, "id", "path").where("path is not null").withColumn("md", paths.path_metadata("path"))
    return one.select("id", md["root_folder"].alias("root_folder"), md["relative_path"].alias("relative_path"), *map(join, ("parent_folders", "tags", "date_tags", "category_tags")), paths.metadata_label(md).alias("label"))


def date_like(spark, d):
    parts = _once(spark, d, "id", "path").select(F.explode(paths.path_parts("path")).alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.where(paths.is_date_like("part"))


def owner_from_path(spark, d):
    return _once(spark, d, "id", "path").select("id", paths.owner_from_path("path").alias("owner"), paths.top_folder("path", "/Users").alias("top"))


def _plan(spark, d):
    return organize.plan(_classified(spark, d), BASE)


def plan(spark, d):
    return _plan(spark, d).select("id", "path", "type", "destination")


def plan_owned(spark, d):
    """The plan of files with the owner, year and category of their classification, spaces and all."""
    kept = _once(spark, d, "id", "path").where("path is not null").join(_latest(spark, d).select(F.col("file_id").alias("id"), F.concat("category", F.lit(" files")).alias("type"), F.concat("owner", F.lit(" & co")).alias("owner"), "year"), "id", "left")
    return organize.plan(kept, BASE).select("id", "destination")


def plan_collisions(spark, d):
    return organize.mark_collisions(_plan(spark, d)).select("id", "destination", "status")


def legacy_plan(spark, d):
    return organize.folder_groups(_classified(spark, d), BASE)


def tree_counts(spark, d):
    return organize.tree_counts(_plan(spark, d))


def plan_prefix(spark, d):
    """The folders that all destinations share, and all source paths of some folders."""
    out = organize.common_prefix(_plan(spark, d)).withColumn("of", F.lit("destinations"))
    for top in ("/Users/shared/", "/Volumes/"):
        out = out.unionByName(organize.common_prefix(_once(spark, d, "path").where(F.col("path").startswith(top)), "path").withColumn("of", F.lit(top)))
    return out


def plan_preview(spark, d):
    return organize.preview(_plan(spark, d))


def plan_preview_json(spark, d):
    return organize.preview(_plan(spark, d), "json")


def dry_run_log(spark, d):
    return organize.dry_run(_plan(spark, d).select("path", "size", "type", "destination"))


def plan_table(spark, d):
    return organize.enumerate_plan(_plan(spark, d))


def _latest(spark, d):
    """One classification a file: the one with the highest id."""
    c = table(spark, d, "classifications").where("file_id is not null")
    return c.groupBy("file_id").agg(F.max_by(F.struct("category", "owner", "year", "confidence", "classified_at"), "id").alias("c"), F.max("id").alias("id")).select("id", "file_id", "c.*")


def reclass_status(spark, d):
    files = _varied(spark, d, "id", "path", "size").withColumn("path", F.when(F.col("id") % 11 > 0, F.col("path")))  # some have lost their path
    done = reclassify.reclassify(files, _latest(spark, d), existing=files.where("size is not null"), skip_cloud=True)
    return reclassify.counters(done)


def reclass_changes(spark, d):
    return reclassify.changes(reclassify.reclassify(_once(spark, d, "id", "path"), _latest(spark, d)))


def reclass_other(spark, d):
    return reclassify.changes(reclassify.reclassify(_once(spark, d, "id", "path"), _latest(spark, d), categories=["other"]))


NOW = "2025-06-01 00:00:00"


def _before_last_date(spark, d, *columns: str):
    last = _files(spark, d).agg(F.max(F.to_date("scanned_at"))).scalar()
    early = _files(spark, d).where(F.to_date("scanned_at") < last)
    return early.select(*columns or early.columns).distinct()


def upsert_files(spark, d):
    """A scan of every file put into the catalog as it was before the last scan date."""
    new = _files(spark, d).select("path", (F.col("size") + 1).alias("size"), "mtime", "hash", "metadata_only")  # repeated deliveries count once there
    top = _files(spark, d).agg(F.max("id")).first()[0] or 0  # one row
    return store.upsert_files(_before_last_date(spark, d), new, F.lit(NOW).cast("timestamp_ntz"), top=top).select("path", "size", "hash", "metadata_only", "is_duplicate", "scanned_at")


def mark_dups(spark, d):
    files = _once(spark, d)
    marks = dedup.mark_duplicates(files, loads=_files(spark, d)).where("is_duplicate").select("path", F.col("original_path").alias("duplicate_of"))
    return store.mark_duplicates(files, marks).select("id", "is_duplicate", "duplicate_of")


def append_ops(spark, d):
    files, ops = _once(spark, d, "id", "path"), table(spark, d, "operations")
    wanted = ops.where("action is not null and target_path is not null").select(F.col("target_path").alias("path"), "action", F.lit(None).cast("string").alias("target_path"))
    wanted = wanted.unionByName(_plan(spark, d).select("path", F.lit("MOVE").alias("action"), F.col("destination").alias("target_path")))
    return store.operation_rows(files, wanted).select("file_id", "action", "target_path", "executed")


def save_classes(spark, d):
    new = _classified(spark, d).where("type != 'document'").select("path", F.col("type").alias("category"), F.lit(0.8).alias("confidence"))
    return store.save_classifications(_latest(spark, d), _once(spark, d, "id", "path"), new, F.lit(NOW).cast("timestamp_ntz")).select("file_id", "category", "owner", "year", "confidence", "classified_at")


def hash_cache(spark, d):
    """Every file with the hash that the catalog knew before the last scan date; null where it is to be hashed."""
    found = _once(spark, d, "id", "path", "mtime")
    return store.with_cached_hashes(found, _before_last_date(spark, d, "path", "mtime", "hash")).select("path", "hash")


def hash_cache_by_path(spark, d):
    """Every file with the hash that a cache by path alone knew before the last scan date, kept as JSON and read again."""
    at = shared_path(spark, "hash-cache")
    try:
        store.save_json_cache(_before_last_date(spark, d, "path", "hash").where("path is not null and hash is not null"), at)
        return cut(store.cached_by_path(_once(spark, d, "id", "path"), store.load_json_cache(spark, at)).select("id", "path", "hash"))
    finally:
        remove(spark, at)


def migrated(spark, d):
    """The catalog before it had metadata_only, brought to the present schema."""
    return store.add_metadata_only(_files(spark, d).drop("metadata_only")).groupBy("metadata_only").agg(F.count(F.lit(1)).alias("n"))


def sidecars(spark, d):
    kept = classify.classify(dedup.mark_duplicates(_once(spark, d, *MAIN), loads=_files(spark, d)), to="type").where("path is not null").withColumn("path_metadata", paths.path_metadata("path"))
    return execute.sidecars(organize.plan(kept, BASE))


def document_fields(spark, d):
    files = _once(spark, d, "id", "path").join(_latest(spark, d).select(F.col("file_id").alias("id"), F.col("category").alias("type"), "owner", "year"), "id")
    return execute.document_fields(files)


#: A small tree that the scan queries read: name and text of every file.
TREE = (
    ("one.txt", "1"), ("same.txt", "1"), ("d/two.txt", "22"), ("d/_under.txt", "u"), ("d/.hidden", "h"), (".git/config", "g"), ("d/e/three.tmp", "333"), ("disk.iso", "iso"),
    ("T.app/Contents/Info.plist", "<plist/>"), ("T.app/Contents/MacOS/T", "#!/bin/bash"), ("T.app/Contents/a/b", "y"), ("T.app/Contents/a-b", "x"), ("I.app/inner/f.txt", "ff"), ("empty", ""),
)
CHANGED = 1_700_000_000  #: when all of them were changed, in seconds


def _tree(spark) -> str:
    at = shared_path(spark, "tree").removeprefix("file://")
    for name, text in TREE:
        os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
        with open(f"{at}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
        os.utime(f"{at}/{name}", (CHANGED, CHANGED))
    return at


def _below(df, at: str):
    """What a scan found, kept, with names below the tree."""
    return cut(df.withColumn("path", F.substring("path", F.lit(len(os.path.realpath(at)) + 2), F.lit(1 << 30))))


def scan_tree(spark, d):
    """A scan of TREE: names, sizes, times and content hashes of files and packages."""
    at = _tree(spark)
    files = _below(scan.scan(spark, at), at)
    shutil.rmtree(at)
    return files.select("path", "is_dir", "size", F.when(~F.col("is_dir"), F.unix_seconds("mtime")).alias("changed"), "hash")


def scan_options(spark, d):
    """TREE with an ignore file's patterns, a size from which nothing is hashed, and the named folders only."""
    at = _tree(spark)
    with open(f"{at}/.dedupignore", "w", encoding="utf-8") as f:
        f.write("# patterns\n\n *.tmp \nI.app\n")
    patterns = scan.load_patterns(f"{at}/.dedupignore")
    whole = _below(scan.scan(spark, at, patterns=patterns, metadata_only_size=2), at).withColumn("kind", F.lit("whole"))
    named = _below(scan.scan(spark, at, ["d", "I.app", "d", "none"], patterns=patterns, metadata_only_size=2), at).withColumn("kind", F.lit("named"))
    first = _below(scan.scan(spark, at, max_files=3, metadata_only_size=2), at).withColumn("kind", F.lit("first"))
    shutil.rmtree(at)
    return whole.unionByName(named).unionByName(first).select("kind", "path", "metadata_only", (F.col("hash") == "METADATA_ONLY").alias("unhashed"))


def scan_plain(spark, d):
    """Every regular file of TREE, without rules."""
    at = _tree(spark)
    files = _below(scan.walk(spark, at), at)
    shutil.rmtree(at)
    return files


def parse_size(spark, d):
    sizes = _once(spark, d, "id", "size").where("size is not null").select("id", F.concat((F.col("size") % 1000).cast("string"), F.element_at(F.array(*map(F.lit, ("", "B", "K", "kb", "MB", "g", "TB", " x"))), (F.col("size") % 8 + 1).cast("int"))).alias("text"))
    return sizes.select("id", "text", paths.size_bytes("text").alias("bytes"))


SPARK = {
    f.__name__: f
    for f in (
        dup_groups, dup_marked, dup_totals, dup_filtered, dup_names, dup_numbered, dup_report, dup_originals, run_summary, plan_folders, scan_filter, meta_only, hidden_filter, ignore_filter, package_items, package_sizes, classified, classified_endings, category_counts, path_metadata, date_like, owner_from_path,
        plan, plan_owned, plan_collisions, legacy_plan, tree_counts, plan_prefix, plan_preview, plan_preview_json, dry_run_log, plan_table, reclass_status, reclass_changes, reclass_other, upsert_files, mark_dups, append_ops, save_classes, hash_cache, hash_cache_by_path, migrated, sidecars, document_fields, parse_size,
        scan_tree, scan_options, scan_plain,
    )
}

# ---- the same in DuckDB's SQL ----

_ONCE = "once AS (SELECT DISTINCT * FROM files)"
# arg_min skips null values; a null size of the first row must stay null
_VARIED = f"varied AS (SELECT * REPLACE (([{', '.join(f"'{x}'" for x in PREFIXES)}])[id % {len(PREFIXES)} + 1] || path AS path) FROM once)"
_HASHED = f"{_ONCE}, r AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY id, path) AS rn, count(*) OVER (PARTITION BY hash) AS n FROM once WHERE hash IS NOT NULL AND hash <> 'METADATA_ONLY'), o AS (SELECT hash, n, path AS original_path, size AS original_size FROM r WHERE rn = 1)"
_MARKED = f"{_HASHED}, m AS (SELECT once.id, once.path, once.hash, coalesce(o.n > 1 AND once.path <> o.original_path, false) AS is_duplicate, CASE WHEN o.n > 1 AND once.path <> o.original_path THEN o.original_path END AS original_path FROM once LEFT JOIN o ON once.hash = o.hash)"

_NAME = "regexp_extract(path, '[^/]*$')"
_SUFFIX = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]+)$', 1, 's'))"
_RAW = "regexp_extract({0}, '^\\.*[^.].*(\\.[^.]*)$', 1, 's')"
_values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
_list = lambda xs: ", ".join(f"'{x}'" for x in xs)
_any_of = lambda c, xs: " OR ".join(f"contains({c}, '{x}')" for x in xs)
_full = "n"
for _a, _b in sorted(rules.SUFFIX_MAP.items()):
    _full = f"CASE WHEN lower({_RAW.format('n')}) = '{_a}' THEN left(n, length(n) - {len(_a)}) || '{_b}' ELSE {_full} END"
_CLASSES = f"""
{_ONCE}, mime(e, c) AS (VALUES {_values(rules.mime_table())}), ext(e, c) AS (VALUES {_values(rules.extension_table())}),
a AS (SELECT *, {_NAME} AS n, {_SUFFIX} AS s FROM once),
b AS (SELECT *, {_full} AS f FROM a),
g AS (SELECT *, {_RAW.format("f")} AS l FROM b),
h AS (SELECT *, lower(CASE WHEN l IN ({_list(rules.ENCODINGS)}) THEN {_RAW.format("left(f, length(f) - length(l))")} ELSE l END) AS me FROM g),
k AS (SELECT h.id, h.path, h.size, CASE
  WHEN mime.c IS NOT NULL THEN mime.c
  WHEN ext.c IN ('image','video','audio','document','spreadsheet','presentation','code','archive','data','font','installer','certificate','shortcut','scientific','financial') THEN ext.c
  WHEN s LIKE '.tax%' OR s LIKE '.q2%' OR s LIKE '.t2%' OR s LIKE '.h2%' THEN 'financial'
  WHEN ext.c IS NOT NULL THEN ext.c
  WHEN n IN ('Makefile', 'makefile', 'Rakefile', 'Gemfile') THEN 'code'
  WHEN n IN ('CodeResources', 'Info.plist', 'PkgInfo', 'version.plist', 'Dockerfile', 'Vagrantfile', '.gitignore', '.dockerignore', 'bootstrap', 'jquery', 'LICENSE', 'README', 'CHANGELOG') THEN 'system'
  WHEN path LIKE '%/Contents/MacOS/%' AND s = '' THEN 'installer'
  WHEN path LIKE '%/Contents/PlugIns/%' OR path LIKE '%/Contents/Resources/%' THEN 'system'
  WHEN lower(n) LIKE '%alias%' THEN 'shortcut'
  WHEN lower(n) LIKE '%.log%' THEN 'system'
  WHEN {_any_of("path", rules.IDE_PARTS)} THEN 'data'
  WHEN regexp_matches(lower(n), '^(cs|ceg|stat|mat|econ|phys|chem|bio|eng|math)') THEN 'education'
  WHEN {_any_of("lower(path)", rules.FINANCIAL_WORDS)} THEN 'financial'
  WHEN {_any_of("path", rules.WEB_ROOTS)} THEN 'web'
  WHEN lower(path) LIKE '%/packettracer/%' OR lower(path) LIKE '%/packet tracer/%' THEN 'application'
  ELSE 'other' END AS type
  FROM h LEFT JOIN mime ON me = mime.e LEFT JOIN ext ON s = ext.e)"""

_STD = _list(paths.STANDARD_FOLDERS)
_META = f"""
{_ONCE}, m1 AS (SELECT id, path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM once WHERE path IS NOT NULL),
m2 AS (SELECT *, coalesce(list_position(list_transform(p, lambda x: x IN ({_STD}) OR (contains(x, ' - ') AND ({_any_of("x", paths.STANDARD_FOLDERS)}))), true), 0) AS i FROM m1),
m3 AS (SELECT *, CASE WHEN i > 0 THEN p[i] END AS root_folder, CASE WHEN i > 0 AND i < len(p) - 1 THEN p[i + 1:len(p) - 1] ELSE [] END AS parents FROM m2),
m4 AS (SELECT *, list_filter(parents, lambda x: lower(x) NOT IN ({_list(paths.GENERIC_FOLDERS)})) AS t FROM m3),
md AS (SELECT id, path, root_folder, CASE WHEN i > 0 AND i < len(p) THEN array_to_string(parents, '/') END AS relative_path, parents, t,
  list_filter(t, lambda x: regexp_matches(x, '{paths.DATE_PATTERN}')) AS dt, list_filter(t, lambda x: NOT regexp_matches(x, '{paths.DATE_PATTERN}')) AS ct FROM m4)"""


def _root_cut(column: str, roots) -> str:
    return "coalesce(" + ", ".join(f"CASE WHEN contains({column}, '{r}') THEN substr(path, strpos({column}, '{r}') + 1) END" for r in roots) + f", {_NAME})"


_PLAN = f"""
{_CLASSES}, {_META.strip().removeprefix(_ONCE + ",")},
pl AS (SELECT k.id, k.path, k.size, k.type, '{BASE}' || coalesce('/' || root_folder, '') || '/' ||
  CASE type WHEN 'web' THEN 'web/' || {_root_cut("path", rules.WEB_ROOTS).replace("path", "k.path")}
            WHEN 'application' THEN 'application/' || {_root_cut("lower(path)", rules.APPLICATION_ROOTS).replace("path", "k.path")}
            ELSE type || '/' || {_NAME.replace("path", "k.path")} END AS destination
  FROM k JOIN md ON k.id = md.id)"""
_LATEST = "latest AS (SELECT * FROM (SELECT DISTINCT * FROM classifications WHERE file_id IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY id DESC) = 1)"
_RECLASS = f"""
{_CLASSES}, {_LATEST}, there AS (SELECT DISTINCT path FROM once WHERE size IS NOT NULL),
rc AS (SELECT k.id, k.path, coalesce(l.category, 'unknown') AS old_category, l.category AS old, k.type AS new_category, there.path IS NULL AS gone FROM k LEFT JOIN latest l ON l.file_id = k.id LEFT JOIN there ON there.path = k.path)"""
_LOST = f"all_once AS (SELECT DISTINCT * FROM files), {_VARIED.replace('FROM once', 'FROM all_once')}, once AS (SELECT * REPLACE (CASE WHEN id % 11 > 0 THEN path END AS path) FROM varied)"
_UP = """up AS (SELECT string_split(path, '/') AS s, * FROM once WHERE path IS NOT NULL),
dirs AS (SELECT *, unnest(list_transform(range(2, greatest(len(s) - 1, 2) + 1), lambda n: array_to_string(s[1:n], '/'))) AS dir FROM up)"""
_NOW = f"TIMESTAMP '{NOW}'"
_EARLIER = f"{_ONCE}, o AS (SELECT * FROM once WHERE scanned_at::DATE < (SELECT max(scanned_at::DATE) FROM once))"

SQL = {
    "dup_groups": f"WITH {_HASHED} SELECT hash, n, original_path, original_size, original_size * (n - 1) AS wasted FROM o WHERE n > 1",
    "dup_marked": f"WITH {_MARKED} SELECT * FROM m",
    "dup_totals": f"WITH {_HASHED} SELECT count(*) FILTER (n > 1) AS n_groups, sum(n - 1)::BIGINT AS n_duplicates, sum(original_size * (n - 1))::BIGINT AS wasted, count(*) AS n_contents, (SELECT count(*) FROM once) AS n_files, (SELECT count(*) FROM once) - sum(n - 1)::BIGINT AS n_unique_rows FROM o",
    "dup_filtered": f"WITH {_MARKED} SELECT id, path FROM m WHERE NOT is_duplicate",
    "dup_names": f"WITH {_ONCE} SELECT name, count(*) OVER (PARTITION BY name) AS n, path FROM (SELECT {_NAME} AS name, path FROM once WHERE path IS NOT NULL) QUALIFY n > 1",
    "dup_numbered": f"WITH {_HASHED} SELECT row_number() OVER (ORDER BY hash) AS group_no, hash, n, original_size * (n - 1) AS wasted FROM o WHERE n > 1",
    "dup_report": f"""WITH {_HASHED}, g AS (SELECT *, row_number() OVER (ORDER BY hash) AS group_no FROM o WHERE n > 1), t AS (SELECT count(*) AS groups, sum(n - 1)::BIGINT AS dups, sum(original_size * (n - 1))::BIGINT AS wasted FROM g)
SELECT unnest(['DUPLICATE REPORT', format('groups: {{:,}}', groups), format('duplicates: {{:,}}', dups), format('wasted: {{:,}} bytes ({{:,.2f}} MB, {{:,.2f}} GB)', wasted, wasted / 1048576, wasted / 1073741824)]) AS value FROM t WHERE groups > 0
UNION ALL SELECT '#' || group_no || ' ' || hash || ': ' || n || ' files of ' || coalesce(format('{{:,}}', original_size), 'unknown') || ' bytes, original ' || coalesce(original_path, 'unknown') || ', wasted ' || coalesce(format('{{:,}}', original_size * (n - 1)), 'unknown') || ' bytes' FROM g
UNION ALL SELECT '  duplicate ' || coalesce(r.path, 'unknown') FROM r JOIN g ON r.hash = g.hash WHERE r.rn > 1""",
    "dup_originals": f"WITH {_ONCE} SELECT a.id, a.path, a.hash, a.duplicate_of AS original_path, b.id AS original_id, b.hash AS original_hash, b.size AS original_size FROM once a LEFT JOIN once b ON a.duplicate_of = b.path WHERE a.duplicate_of IS NOT NULL",
    "run_summary": f"WITH {_MARKED} SELECT count(*) AS n_files, (SELECT sum(size) FROM once)::BIGINT AS bytes, count(*) FILTER (NOT is_duplicate) AS n_unique, count(*) FILTER (is_duplicate) AS n_duplicates FROM m",
    "plan_folders": f"WITH {_PLAN} SELECT DISTINCT regexp_replace(destination, '/[^/]*$', '') AS dir FROM pl",
    "scan_filter": f"WITH {_ONCE} SELECT id, path FROM once WHERE (starts_with(path, '/Users/shared/') OR starts_with(path, '/Users/ivoss/')) AND NOT contains(path, '/.') ORDER BY path, id LIMIT 500",
    "meta_only": f"WITH {_ONCE} SELECT id, coalesce(size > 1048576, false) AS is_large, CASE WHEN size > 1048576 THEN 'METADATA_ONLY' ELSE hash END AS hash FROM once",
    "hidden_filter": f"WITH {_ONCE}, {_VARIED} SELECT id, path FROM varied WHERE contains(path, '/.')",
    "ignore_filter": f"WITH {_ONCE} SELECT id, path FROM once WHERE {_NAME} GLOB '*.tmp' OR {_NAME} GLOB '*.log' OR {_NAME} = 'desktop.ini' OR {_NAME} GLOB 'IMG?0[0-4]*' OR {_NAME} GLOB '[!a-zA-Z]*' OR starts_with(path, '/Users/shared/Backups') OR path = '/Users/shared/Projects/README.md'",
    "package_items": f"WITH {_ONCE}, {_VARIED}, {_UP.replace('FROM once', 'FROM varied')} SELECT id, path, coalesce({_SUFFIX} IN ({_list(paths.PACKAGE_EXTENSIONS)}), false) AS is_package FROM varied WHERE path IS NOT NULL AND id NOT IN (SELECT id FROM dirs WHERE {_SUFFIX.replace('path', 'dir')} IN ({_list(paths.PACKAGE_EXTENSIONS)}) AND NOT ends_with(dir, '/Ignored.app'))",
    "package_sizes": f"WITH {_ONCE}, {_UP} SELECT dir, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes, max(mtime) AS last_mtime FROM dirs GROUP BY dir",
    "classified": f"WITH {_CLASSES} SELECT id, path, type FROM k",
    "classified_endings": f"WITH e(k, ending, type) AS (VALUES {', '.join(str((k, *x)) for k, x in enumerate(ENDINGS))}) SELECT ending, type, count(*) AS n FROM (SELECT DISTINCT id FROM files) JOIN e ON id % {len(ENDINGS)} = k GROUP BY ALL",
    "category_counts": f"WITH {_CLASSES} SELECT type, count(*) AS n FROM k GROUP BY type",
    "path_metadata": f"WITH {_META} SELECT id, root_folder, relative_path, array_to_string(parents, '|') AS parent_folders, array_to_string(t, '|') AS tags, array_to_string(dt, '|') AS date_tags, array_to_string(ct, '|') AS category_tags, "
    "concat_ws(' | ', 'Root: ' || root_folder, CASE WHEN len(ct) > 0 THEN 'Categories: ' || array_to_string(ct, ', ') END, CASE WHEN len(dt) > 0 THEN 'Dates: ' || array_to_string(dt, ', ') END) AS label FROM md",
    "date_like": f"WITH {_ONCE}, p AS (SELECT unnest(list_filter(string_split(path, '/'), lambda x: x <> '')) AS part FROM once) SELECT part, count(*) AS n FROM p WHERE regexp_matches(part, '{paths.DATE_PATTERN}') GROUP BY part",
    "owner_from_path": f"WITH {_ONCE}, p AS (SELECT id, path, list_filter(string_split(path, '/'), lambda x: contains(x, ' - '))[1] AS x FROM once) SELECT id, substr(x, strpos(x, ' - ') + 3) AS owner, CASE WHEN starts_with(path, '/Users/') THEN string_split(substr(path, 8), '/')[1] END AS top FROM p",
    "plan": f"WITH {_PLAN} SELECT id, path, type, destination FROM pl",
    "plan_collisions": f"WITH {_PLAN} SELECT id, destination, CASE WHEN row_number() OVER (PARTITION BY destination ORDER BY id, path) = 1 THEN 'planned' ELSE 'collision' END AS status FROM pl",
    "legacy_plan": f"WITH {_CLASSES} SELECT '{BASE}/' || type || '/Unknown_Owner/Unknown_Year' AS target_dir, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS bytes FROM k GROUP BY type",
    "tree_counts": f"WITH {_PLAN}, {_UP.replace('path', 'destination').replace('once', 'pl')} SELECT dir, len(string_split(dir, '/')) - 1 AS depth, count(*) FILTER (dir = regexp_replace(destination, '/[^/]*$', '')) AS direct, count(*) AS below FROM dirs GROUP BY dir",
    "plan_owned": f"""WITH {_META}, {_LATEST}, j AS (SELECT md.id, md.path, root_folder, replace(category || ' files', ' ', '_') AS kind, year, replace(owner || ' & co', ' ', '_') AS owner FROM md LEFT JOIN latest l ON l.file_id = md.id)
SELECT id, concat_ws('/', '{BASE}', root_folder, year, kind, owner, CASE WHEN root_folder IS NULL AND year IS NULL AND kind IS NULL AND owner IS NULL THEN 'Unclassified' END, {_NAME}) AS destination FROM j""",
    "plan_prefix": f"""WITH {_PLAN}, s AS (SELECT 'destinations' AS of, destination AS p FROM pl UNION ALL SELECT '/Users/shared/', path FROM once WHERE starts_with(path, '/Users/shared/') UNION ALL SELECT '/Volumes/', path FROM once WHERE starts_with(path, '/Volumes/')),
e AS (SELECT of, min(string_split(p, '/')) AS a, max(string_split(p, '/')) AS b FROM s GROUP BY of)
SELECT of, array_to_string(a[1:list_max(list_filter(range(0, len(a) + 1), lambda n: a[1:n] = b[1:n]))], '/') AS prefix FROM e""",
    "plan_preview_json": f"""WITH {_PLAN} SELECT '{{"from":' || to_json(path)::VARCHAR || ',"to":' || to_json(destination)::VARCHAR || '}}' AS value FROM pl""",
    "dry_run_log": f"WITH {_PLAN} SELECT 'path=' || path || ', size=' || coalesce(size::VARCHAR, 'None') || ', type=' || type || ', destination=' || destination AS value FROM pl",
    "plan_preview": f"WITH {_PLAN} SELECT path || ' -> ' || destination AS value FROM pl",
    "plan_table": f"WITH {_PLAN} SELECT row_number() OVER (ORDER BY id, path) AS n, {_NAME} AS name, type, size / 1000000 AS size_mb, path AS source, destination FROM pl",
    "reclass_status": f"WITH {_RECLASS.replace(_ONCE, _LOST)}, st AS (SELECT CASE WHEN {_any_of('path', paths.CLOUD_PARTS)} THEN 'skipped' WHEN path IS NULL THEN 'error' WHEN gone THEN 'missing' WHEN old_category <> new_category THEN 'updated' ELSE 'unchanged' END AS s FROM rc) "
    "SELECT count(*) AS total, count(*) FILTER (s IN ('updated', 'unchanged')) AS checked, count(*) FILTER (s = 'updated') AS updated, count(*) FILTER (s = 'unchanged') AS unchanged, count(*) FILTER (s = 'missing') AS missing, count(*) FILTER (s = 'skipped') AS skipped, count(*) FILTER (s = 'error') AS error FROM st",
    "reclass_changes": f"WITH {_RECLASS} SELECT old_category, new_category, count(*) AS n FROM rc WHERE old_category <> new_category GROUP BY ALL",
    "reclass_other": f"WITH {_RECLASS} SELECT old_category, new_category, count(*) AS n FROM rc WHERE old = 'other' AND new_category <> 'other' GROUP BY ALL",
    "upsert_files": f"""WITH {_EARLIER}, n AS (SELECT path, size + 1 AS size, mtime, hash, metadata_only FROM once WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST, metadata_only DESC NULLS LAST) = 1)
SELECT coalesce(n.path, o.path) AS path, CASE WHEN n.path IS NOT NULL THEN n.size ELSE o.size END AS size, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash,
  coalesce(CASE WHEN n.path IS NOT NULL THEN n.metadata_only ELSE o.metadata_only END, false) AS metadata_only, coalesce(o.is_duplicate, false) AS is_duplicate, CASE WHEN n.path IS NOT NULL THEN {_NOW} ELSE o.scanned_at END AS scanned_at
FROM o FULL JOIN n ON o.path = n.path""",
    "mark_dups": f"WITH {_MARKED} SELECT once.id, CASE WHEN m.is_duplicate THEN true ELSE once.is_duplicate END AS is_duplicate, CASE WHEN m.is_duplicate THEN m.original_path ELSE once.duplicate_of END AS duplicate_of FROM once JOIN m ON once.id = m.id",
    "append_ops": f"""WITH {_PLAN}, w AS (SELECT target_path AS path, action, NULL::VARCHAR AS target_path FROM operations WHERE action IS NOT NULL AND target_path IS NOT NULL UNION ALL SELECT path, 'MOVE', destination FROM pl)
SELECT once.id AS file_id, w.action, w.target_path, false AS executed FROM w JOIN once ON once.path = w.path""",
    "save_classes": f"""WITH {_CLASSES}, {_LATEST}, n AS (SELECT id AS file_id, type AS category FROM k WHERE type <> 'document')
SELECT coalesce(n.file_id, l.file_id) AS file_id, coalesce(n.category, l.category) AS category, l.owner, l.year, CASE WHEN n.file_id IS NOT NULL THEN 0.8::DOUBLE ELSE l.confidence END AS confidence, CASE WHEN n.file_id IS NOT NULL THEN {_NOW} ELSE l.classified_at END AS classified_at
FROM latest l FULL JOIN n ON l.file_id = n.file_id""",
    "hash_cache": f"""WITH {_EARLIER}, k AS (SELECT path, mtime, min(hash) AS hash FROM o WHERE hash IS NOT NULL GROUP BY path, mtime)
SELECT once.path, k.hash FROM once LEFT JOIN k ON once.path = k.path AND once.mtime = k.mtime""",
    "hash_cache_by_path": f"WITH {_EARLIER}, k AS (SELECT path, max(hash) AS hash FROM o WHERE hash IS NOT NULL AND path IS NOT NULL GROUP BY path) SELECT once.id, once.path, k.hash FROM once LEFT JOIN k ON once.path = k.path",
    "migrated": "SELECT false AS metadata_only, count(*) AS n FROM files",
    "sidecars": f"""WITH {_PLAN}, {_MARKED.removeprefix(_ONCE + ", ")} SELECT pl.destination || '.meta.json' AS path,
  '{{"original_path":' || to_json(pl.path)::VARCHAR || coalesce(',"hash":' || to_json(m.hash)::VARCHAR, '') || coalesce(',"size":' || pl.size, '') || ',"type":"' || pl.type || '","is_duplicate":' || m.is_duplicate ||
  ',"path_metadata":{{' || coalesce('"root_folder":' || to_json(md.root_folder)::VARCHAR || ',', '') || coalesce('"relative_path":' || to_json(md.relative_path)::VARCHAR || ',', '') ||
  '"parent_folders":' || to_json(md.parents)::VARCHAR || ',"tags":' || to_json(md.t)::VARCHAR || ',"date_tags":' || to_json(md.dt)::VARCHAR || ',"category_tags":' || to_json(md.ct)::VARCHAR || '}}}}' AS value
FROM pl JOIN m ON pl.id = m.id JOIN md ON pl.id = md.id""",
    "document_fields": f"""WITH {_ONCE}, {_LATEST}, j AS (SELECT path, category, owner, year, {_NAME} AS name, lower(string_split(path, '.')[-1]) AS e FROM once JOIN latest l ON l.file_id = once.id)
SELECT path, 'title' AS key, name AS value FROM j WHERE e IN ('pdf', 'docx', 'mp3') UNION ALL SELECT path, CASE e WHEN 'mp3' THEN 'artist' ELSE 'author' END, owner FROM j WHERE e IN ('pdf', 'docx', 'mp3') AND owner IS NOT NULL
UNION ALL SELECT path, 'keywords', category FROM j WHERE e = 'pdf' AND category IS NOT NULL UNION ALL SELECT path, 'date', year::VARCHAR FROM j WHERE e = 'mp3' AND year IS NOT NULL""",
    "scan_tree": f"""SELECT path, path = 'T.app' AS is_dir, size, CASE WHEN path <> 'T.app' THEN {CHANGED} END AS changed, sha256(text) AS hash FROM (VALUES
('one.txt', 1, '1'), ('same.txt', 1, '1'), ('d/two.txt', 2, '22'), ('d/_under.txt', 1, 'u'), ('d/e/three.tmp', 3, '333'), ('disk.iso', 3, 'iso'), ('I.app', 2, 'inner/f.txtff'), ('empty', 0, ''),
('T.app', 21, 'Contents/Info.plist<plist/>Contents/MacOS/T#!/bin/bashContents/a/byContents/a-bx')) AS t(path, size, text)""".replace("path = 'T.app' AS is_dir", "path IN ('T.app', 'I.app') AS is_dir").replace("path <> 'T.app'", "path NOT IN ('T.app', 'I.app')"),
    "scan_options": """SELECT kind, path, large AS metadata_only, large AS unhashed FROM (VALUES
('whole', 'one.txt', false), ('whole', 'same.txt', false), ('whole', 'd/two.txt', false), ('whole', 'd/_under.txt', false), ('whole', 'disk.iso', true), ('whole', 'T.app', true), ('whole', 'I.app/inner/f.txt', false), ('whole', 'empty', false),
('named', 'd/two.txt', false), ('named', 'd/_under.txt', false), ('named', 'I.app/inner/f.txt', false), ('first', 'I.app', false), ('first', 'T.app', true), ('first', 'd/_under.txt', false)) AS t(kind, path, large)""",
    "scan_plain": f"SELECT path, length(text) AS size FROM (VALUES {', '.join(str(x) for x in TREE)}) AS t(path, text)",
    "parse_size": f"""WITH {_ONCE}, t AS (SELECT id, (size % 1000)::VARCHAR || (['', 'B', 'K', 'kb', 'MB', 'g', 'TB', ' x'])[size % 8 + 1] AS text, size % 1000 AS n, size % 8 AS u FROM once WHERE size IS NOT NULL)
SELECT id, text, CASE u WHEN 7 THEN NULL ELSE n * ([1, 1, 1024, 1024, 1048576, 1073741824, 1099511627776, 0])[u + 1] END AS bytes FROM t""",
}
