"""The library of analytic queries over files and classifications.

All sort orders end in path and id, so that ties have one result. Sizes in MB and GB are rounded with
exact integers. Limits are those of the top-k reports. Concatenated lists are whole and in order, in
parts of PART values, a row each, so that no value is cut and no row grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.catalog import table
from cairn.functions.paths import file_ext, file_name, hundredths, path_metadata
from cairn.operators.ranking import numbered

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30
PART = 1000  #: values of a concatenated list in one row
EDUCATION = ("%/cs%", "%/ceg%", "%/stat%", "%/mat%", "%/econ%", "%homework%", "%assignment%", "%lab%", "%project%")  # fixed values
INSTALLERS = ("exe", "msi", "pkg", "mpkg", "app", "deb", "rpm", "dmg", "iso", "img", "apk", "ipa", "flatpak", "snap")  # fixed values


#: Endings that the queries for kinds of files which the tables lack put behind paths, by id.
ENDINGS = ("", ".exe", ".dat", ".bin", ".TMP", ".h264", ".so.1", ".dylib", ".sqlite-wal")


def joined(spark, d, how: str = "left") -> DataFrame:
    f = table(spark, d, "files")
    c = table(spark, d, "classifications").select("file_id", "category", "confidence", "classified_at", F.col("id").alias("class_id"))
    return f.join(c, f["id"] == c["file_id"], how)


def of(spark, d, *categories: str) -> DataFrame:
    return joined(spark, d).where(F.col("category").isin(*categories))


def mb(c="size"):
    return hundredths(F.col(c), MB)


def mean(unit: int):
    """Rounded mean of size: halves away from zero, by exact integers."""
    n = F.count("size") * F.lit(2 * unit)
    return F.call_function("div", F.sum("size") * 200 + F.count("size") * unit, n) / F.lit(100.0)


def total(unit: int):
    return hundredths(F.sum("size"), unit)


def _top(df: DataFrame, n: int | None, *order) -> DataFrame:
    df = df.orderBy(*order)
    return df.limit(n) if n else df


def _by_ext(df: DataFrame, name: str = "extension"):
    return df.groupBy(file_ext("path").alias(name))


def _lists(rows: DataFrame, top: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """top, the rows of a report, with the values of each key: the whole list in order, in parts of PART."""
    held = rows.where(F.col(value).isNotNull()).join(F.broadcast(top.select(key)), key)  # the report's few rows
    placed = numbered(held, key, value, name="at")
    first = placed.groupBy(key).agg(F.min("at").alias("first"))
    parts = placed.join(F.broadcast(first), key).groupBy(key, F.expr(f"cast((at - first) div {PART} + 1 as int)").alias("part"))
    return top.join(parts.agg(F.expr(f"listagg({value}, ', ') WITHIN GROUP (ORDER BY {value})").alias(name)), key, "left")


def _with_endings(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.concat("path", F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("id") % len(ENDINGS) + 1).cast("int"))))


def q01(spark, d):
    return _top(of(spark, d, "other").select("path", "size", "hash", "category", "scanned_at", "id"), None, F.desc_nulls_last("size"), "path", "id")


def q02(spark, d):
    g = _by_ext(of(spark, d, "other"), "file_extension").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_size"), total(MB).alias("total_size_mb"), F.min("path").alias("example_file"))
    return _top(g, None, F.desc("count"), "file_extension")


def _names(spark, d):
    return of(spark, d, "other").withColumns({"extension": file_ext("path"), "name": file_name("path")})


def _folders(spark, d):
    return of(spark, d, "other").withColumns({"parent_directory": F.substring_index("path", "/", -2), "extension": file_ext("path")})


def q03(spark, d):
    rows = _names(spark, d)
    g = rows.groupBy("extension").agg(F.count(F.lit(1)).alias("file_count"), mean(MB).alias("avg_size_mb"), hundredths(F.min("size"), KB).alias("min_size_kb"), hundredths(F.max("size"), MB).alias("max_size_mb"))
    top = _top(g, 50, F.desc("file_count"), "extension")
    return _lists(rows.select("extension", "name"), top, "extension", "name", "example_files")


def q04(spark, d):
    rows = _folders(spark, d)
    g = rows.groupBy("parent_directory").agg(F.count(F.lit(1)).alias("file_count"), total(MB).alias("total_size_mb"))
    top = _top(g, 25, F.desc("file_count"), "parent_directory")
    return _lists(rows.select("parent_directory", "extension").distinct(), top, "parent_directory", "extension", "extensions_found")


def q05(spark, d):
    rows = of(spark, d, "other").where(~F.col("path").like("%.%")).select("path", "size", mb().alias("size_mb"), "scanned_at", "id")
    return _top(rows, 50, F.desc_nulls_last("size"), "path", "id")


def q06(spark, d):
    """Four figures from one aggregate, a row each."""
    one = of(spark, d, "other").agg(F.count(F.lit(1)).alias("n"), total(GB).alias("gb"), mean(MB).alias("mb"), F.count_distinct(file_ext("path")).alias("e"))
    each = (('Total "other" files', "n"), ("Total size (GB)", "gb"), ("Average file size (MB)", "mb"), ("Unique extensions", "e"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value")) for name, c in each))))


def q07(spark, d):
    rows = of(spark, d, "other").select("path", mb().alias("size_mb"), file_ext("path").alias("extension"), file_name("path").alias("filename"), "scanned_at", "size", "id")
    return _top(rows, 50, F.desc_nulls_last("size"), "path", "id").drop("size")


def q08(spark, d):
    like = F.lit(False)
    for p in EDUCATION:
        like = like | F.lower("path").like(p)
    return _top(of(spark, d, "other").where(like).select("path", file_name("path").alias("filename"), mb().alias("size_mb"), "id"), 100, "path", "id")


def q09(spark, d, pattern: str = "report"):
    rows = of(spark, d, "other").where(F.lower("path").like(f"%{pattern}%"))
    return _top(rows.select("path", file_ext("path").alias("extension"), hundredths(F.col("size"), KB).alias("size_kb"), "scanned_at", "id"), 100, "path", "id")


def q10(spark, d):
    """The whole and each category, from one count by category; the files are counted in a scalar subquery."""
    by = joined(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    n = table(spark, d, "files").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("long")).scalar()
    whole = by.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(F.lit("Total files").alias("category"), "count", F.lit(100.0).alias("percentage"))
    part = by.where("category is not null").withColumn("percentage", F.call_function("div", F.col("count") * 20000 + n, n * 2) / F.lit(100.0))
    return whole.union(part).orderBy(F.desc("count"), "category")


def q11(spark, d):
    rows = of(spark, d, "other").select(F.col("path").alias("file_path"), file_ext("path").alias("extension"), F.col("size").alias("size_bytes"), mb().alias("size_mb"), F.date_format("scanned_at", "yyyy-MM-dd HH:mm:ss").alias("scanned_date"), "id")
    return rows.orderBy("file_path", "id")


def d01(spark, d):
    return table(spark, d, "files").where("is_duplicate").select("path", "size", "hash", "duplicate_of")


def d02(spark, d):
    return table(spark, d, "files").where("is_duplicate").select("id", F.col("path").alias("duplicate"), F.col("duplicate_of").alias("original"), "size", "hash").orderBy("hash", "duplicate", "id")


def d03(spark, d):
    """The duplicates of one path: all rows with the hash of the smallest path that has a content hash."""
    f = table(spark, d, "files")
    one = f.where(F.col("hash") != "METADATA_ONLY").agg(F.min("path")).scalar()
    same = f.where(F.col("path") == one).agg(F.max("hash")).scalar()
    return f.where(F.col("hash") == same).select("id", "path", "size", "hash")


def d04(spark, d):
    """Space wasted by (hash, size); as in the catalog's own report the sentinel is a hash like any other."""
    f = table(spark, d, "files")
    several = f.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and hash is not null").select("hash")
    g = f.groupBy("hash", "size").agg((F.count(F.lit(1)) - 1).alias("duplicate_count"))
    out = g.join(several, "hash", "left_semi").select("hash", "duplicate_count", F.col("size").alias("file_size"), (F.col("duplicate_count") * F.col("size")).alias("wasted_space"))
    return out.orderBy(F.desc_nulls_last("wasted_space"), "hash", "file_size")


def d05(spark, d):
    return table(spark, d, "files").where("hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def d06(spark, d):
    return table(spark, d, "files").groupBy("is_duplicate").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total_size"))


def d07(spark, d):
    c = table(spark, d, "classifications")
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n")).withColumn("asked", F.coalesce(F.col("category").isin("other", "temporary", "system"), F.lit(False)))


def d08(spark, d):
    return _with_endings(joined(spark, d, "inner")).where((F.col("category") == "other") & F.col("path").like("%.exe")).select("id", "path", "class_id")


def d09(spark, d):
    return joined(spark, d, "inner").where((F.col("category") == "other") & (F.col("scanned_at") > F.lit("2025-01-01").cast("timestamp_ntz"))).agg(F.count(F.lit(1)).alias("n"))


def d10(spark, d):
    return table(spark, d, "classifications").select("category").distinct()


def d11(spark, d):
    return table(spark, d, "files").join(table(spark, d, "classifications").select("file_id"), F.col("id") == F.col("file_id"), "left_anti").select("id", "path")


def d12(spark, d):
    return table(spark, d, "classifications").where("category = 'other'").agg(F.count(F.lit(1)).alias("n"))


def d13(spark, d):
    rows = of(spark, d, "other")
    g = rows.agg(F.count(F.lit(1)).alias("n"), total(GB).alias("gb"), mean(MB).alias("avg_mb"), F.count_distinct(file_ext("path")).alias("extensions"))
    return g


def d14(spark, d):
    p = F.lower("path")
    return _with_endings(of(spark, d, "other")).where(p.like("%.dat") | p.like("%.bin") | p.like("%.tmp") | p.like("%.h264")).select("id", "class_id", "path", mb().alias("size_mb"))


def d15(spark, d):
    return joined(spark, d).groupBy("category").agg(F.count(F.lit(1)).alias("n"), total(GB).alias("gb")).orderBy(F.desc("n"), "category")


def d16(spark, d):
    return joined(spark, d).where("class_id is null").select("id", "path").orderBy("path", "id").limit(100)


def d17(spark, d):
    return _by_ext(of(spark, d, "financial")).agg(F.count(F.lit(1)).alias("n"), total(MB).alias("mb")).orderBy(F.desc("n"), "extension")


def d18(spark, d):
    p = F.col("path")
    return of(spark, d, "financial").where(p.like("%2023%") | p.like("%.tax2023%") | p.like("%.t23%") | p.like("%.h23%") | p.like("%2022%")).select("id", "class_id", "path", "size")


def d19(spark, d):
    return of(spark, d, "financial").select("id", "class_id", "path", "scanned_at").orderBy(F.desc_nulls_last("scanned_at"), "path", "id").limit(100)


def d20(spark, d):
    return of(spark, d, "financial").agg(F.count(F.lit(1)).alias("n"), total(MB).alias("mb"), total(GB).alias("gb"))


def d21(spark, d):
    rows = of(spark, d, "installer", "archive", "other").where(file_ext("path").isin(*INSTALLERS, "zip", "gz"))
    return _by_ext(rows).agg(F.count(F.lit(1)).alias("n"), total(GB).alias("total_gb")).orderBy(F.desc("total_gb"), "extension")


def d22(spark, d):
    return _top(_by_ext(of(spark, d, "other")).agg(F.count(F.lit(1)).alias("n")), 20, F.desc("n"), "extension")


def d23(spark, d):
    return of(spark, d, "web", "application", "archive").select("id", "class_id", "category", "path", mb().alias("size_mb")).orderBy("path", "id")


def d24(spark, d):
    p = F.col("path")
    root = F.when(p.like("%/http/%"), "http").when(p.like("%/https/%"), "https").when(p.like("%/www/%"), "www").when(p.like("%/website/%"), "website").when(p.like("%/websites/%"), "websites").otherwise("other_web")
    return joined(spark, d).where(F.col("category").isin("web", "document", "image")).groupBy(root.alias("web_root")).agg(F.count(F.lit(1)).alias("file_count"), total(MB).alias("total_mb")).orderBy(F.desc("file_count"), "web_root")


def d25(spark, d):
    return _top(_by_ext(of(spark, d, "data")).agg(F.count(F.lit(1)).alias("n"), total(MB).alias("mb")), 10, F.desc("n"), "extension")


def d26(spark, d):
    p = F.col("path")
    return _with_endings(of(spark, d, "application", "other", "data")).where(p.like("%.so%") | p.like("%.dylib%") | p.like("%.sqlite%")).select("id", "class_id", "path", "size", mb().alias("size_mb")).orderBy(F.desc_nulls_last("size"), "path", "id")


def d27(spark, d):
    return joined(spark, d, "inner").where(F.col("category").isin("font", "installer", "temporary")).select("id", "class_id", "path", "category")


def d28(spark, d):
    md = path_metadata("path")
    rows = table(spark, d, "files").withColumn("md", md)
    return rows.where((F.col("md.root_folder") == "Documents") & F.array_contains("md.tags", "STAT2210")).select("id", "path")


def d29(spark, d):
    return joined(spark, d, "inner").where(F.col("path").like("/Users/shared/%/budget%")).select("id", "class_id", "path", "category")


SPARK = {k: v for k, v in list(globals().items()) if callable(v) and len(k) == 3 and k[0] in "qd" and k[1:].isdigit()}

# ---- the same in DuckDB's SQL ----

_J = "SELECT f.*, c.category, c.confidence, c.classified_at, c.id AS class_id FROM files f {0} JOIN classifications c ON f.id = c.file_id"
_L, _I = f"({_J.format('LEFT')})", f"({_J.format('INNER')})"
_EXT, _NAME = "string_split(path, '.')[-1]", "string_split(path, '/')[-1]"
_r = lambda x, u: f"(({x}) * 100 + {u // 2})::BIGINT // {u} / 100.0::DOUBLE"
_sum = lambda u: _r("sum(size)::BIGINT", u)
_avg = lambda u: f"(sum(size)::BIGINT * 200 + count(size) * {u}) // (count(size) * {2 * u}) / 100.0::DOUBLE"
_O = f"{_L} WHERE category = 'other'"
_SIZE = "size DESC NULLS LAST, path, id"
_likes = lambda c, ps: " OR ".join(f"{c} LIKE '{p}'" for p in ps)
_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_parts = lambda key, value, distinct="": (
    f"v AS (SELECT {distinct} {key}, {value} FROM o SEMI JOIN t USING ({key}) WHERE {value} IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS place FROM v),"
    f" p AS (SELECT {key}, (place // {PART} + 1)::INT AS part, string_agg({value}, ', ' ORDER BY {value}) AS list FROM n GROUP BY ALL)"
)
_ended = lambda rows: f"(SELECT * REPLACE (path || ([{_quoted(ENDINGS)}])[id % {len(ENDINGS)} + 1] AS path) FROM {rows})"

SQL = {
    "q01": f"SELECT path, size, hash, category, scanned_at, id FROM {_O} ORDER BY {_SIZE}",
    "q02": f"SELECT {_EXT} AS file_extension, count(*) AS count, sum(size)::BIGINT AS total_size, {_sum(MB)} AS total_size_mb, min(path) AS example_file FROM {_O} GROUP BY ALL",
    "q03": f"WITH o AS (SELECT *, {_EXT} AS extension, {_NAME} AS name FROM {_O}), t AS (SELECT extension, count(*) AS file_count, {_avg(MB)} AS avg_size_mb, {_r('min(size)', KB)} AS min_size_kb, {_r('max(size)', MB)} AS max_size_mb FROM o GROUP BY extension ORDER BY file_count DESC, extension LIMIT 50), {_parts('extension', 'name')} SELECT t.*, part, list AS example_files FROM t LEFT JOIN p USING (extension)",
    "q04": f"WITH o AS (SELECT *, array_to_string(string_split(path, '/')[-2:], '/') AS parent_directory, {_EXT} AS extension FROM {_O}), t AS (SELECT parent_directory, count(*) AS file_count, {_sum(MB)} AS total_size_mb FROM o GROUP BY parent_directory ORDER BY file_count DESC, parent_directory LIMIT 25), {_parts('parent_directory', 'extension', 'DISTINCT')} SELECT t.*, part, list AS extensions_found FROM t LEFT JOIN p USING (parent_directory)",
    "q05": f"SELECT path, size, {_r('size', MB)} AS size_mb, scanned_at, id FROM {_O} AND path NOT LIKE '%.%' ORDER BY {_SIZE} LIMIT 50",
    "q06": f"""SELECT 'Total "other" files' AS metric, count(*)::DOUBLE AS value FROM {_O} UNION ALL SELECT 'Total size (GB)', {_sum(GB)} FROM {_O} UNION ALL SELECT 'Average file size (MB)', {_avg(MB)} FROM {_O} UNION ALL SELECT 'Unique extensions', count(DISTINCT {_EXT}) FROM {_O}""",
    "q07": f"SELECT path, {_r('size', MB)} AS size_mb, {_EXT} AS extension, {_NAME} AS filename, scanned_at, id FROM {_O} ORDER BY {_SIZE} LIMIT 50",
    "q08": f"SELECT path, {_NAME} AS filename, {_r('size', MB)} AS size_mb, id FROM {_O} AND ({_likes('lower(path)', EDUCATION)}) ORDER BY path, id LIMIT 100",
    "q09": f"SELECT path, {_EXT} AS extension, {_r('size', KB)} AS size_kb, scanned_at, id FROM {_O} AND lower(path) LIKE '%report%' ORDER BY path, id LIMIT 100",
    "q10": f"SELECT 'Total files' AS category, count(*) AS count, 100.0::DOUBLE AS percentage FROM {_L} UNION ALL SELECT category, count(*), (count(*) * 20000 + (SELECT count(*) FROM files)) // (2 * (SELECT count(*) FROM files)) / 100.0::DOUBLE FROM {_L} WHERE category IS NOT NULL GROUP BY category",
    "q11": f"SELECT path AS file_path, {_EXT} AS extension, size AS size_bytes, {_r('size', MB)} AS size_mb, strftime(scanned_at, '%Y-%m-%d %H:%M:%S') AS scanned_date, id FROM {_O}",
    "d01": "SELECT path, size, hash, duplicate_of FROM files WHERE is_duplicate",
    "d02": "SELECT id, path AS duplicate, duplicate_of AS original, size, hash FROM files WHERE is_duplicate",
    "d03": "SELECT id, path, size, hash FROM files WHERE hash = (SELECT max(hash) FROM files WHERE path = (SELECT min(path) FROM files WHERE hash <> 'METADATA_ONLY'))",
    "d04": "SELECT hash, count(*) - 1 AS duplicate_count, size AS file_size, (count(*) - 1) * size AS wasted_space FROM files WHERE hash IN (SELECT hash FROM files GROUP BY hash HAVING count(*) > 1) GROUP BY hash, size",
    "d05": "SELECT hash, count(*) AS n FROM files WHERE hash IS NOT NULL GROUP BY hash HAVING count(*) > 1",
    "d06": "SELECT is_duplicate, count(*) AS n, sum(size)::BIGINT AS total_size FROM files GROUP BY is_duplicate",
    "d07": "SELECT category, count(*) AS n, coalesce(category IN ('other', 'temporary', 'system'), false) AS asked FROM classifications GROUP BY category",
    "d08": f"SELECT id, path, class_id FROM {_ended(_I)} WHERE category = 'other' AND path LIKE '%.exe'",
    "d09": f"SELECT count(*) AS n FROM {_I} WHERE category = 'other' AND scanned_at > TIMESTAMP '2025-01-01'",
    "d10": "SELECT DISTINCT category FROM classifications",
    "d11": "SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM classifications c WHERE c.file_id = f.id)",
    "d12": "SELECT count(*) AS n FROM classifications WHERE category = 'other'",
    "d13": f"SELECT count(*) AS n, {_sum(GB)} AS gb, {_avg(MB)} AS avg_mb, count(DISTINCT {_EXT}) AS extensions FROM {_O}",
    "d14": f"SELECT id, class_id, path, {_r('size', MB)} AS size_mb FROM {_ended(_L)} WHERE category = 'other' AND ({_likes('lower(path)', ('%.dat', '%.bin', '%.tmp', '%.h264'))})",
    "d15": f"SELECT category, count(*) AS n, {_sum(GB)} AS gb FROM {_L} GROUP BY category",
    "d16": f"SELECT id, path FROM {_L} WHERE class_id IS NULL ORDER BY path, id LIMIT 100",
    "d17": f"SELECT {_EXT} AS extension, count(*) AS n, {_sum(MB)} AS mb FROM {_L} WHERE category = 'financial' GROUP BY ALL",
    "d18": f"SELECT id, class_id, path, size FROM {_L} WHERE category = 'financial' AND ({_likes('path', ('%2023%', '%.tax2023%', '%.t23%', '%.h23%', '%2022%'))})",
    "d19": f"SELECT id, class_id, path, scanned_at FROM {_L} WHERE category = 'financial' ORDER BY scanned_at DESC NULLS LAST, path, id LIMIT 100",
    "d20": f"SELECT count(*) AS n, {_sum(MB)} AS mb, {_sum(GB)} AS gb FROM {_L} WHERE category = 'financial'",
    "d21": f"SELECT {_EXT} AS extension, count(*) AS n, {_sum(GB)} AS total_gb FROM {_L} WHERE category IN ('installer', 'archive', 'other') AND {_EXT} IN ({_quoted((*INSTALLERS, 'zip', 'gz'))}) GROUP BY ALL",
    "d22": f"SELECT {_EXT} AS extension, count(*) AS n FROM {_O} GROUP BY ALL ORDER BY n DESC, extension LIMIT 20",
    "d23": f"SELECT id, class_id, category, path, {_r('size', MB)} AS size_mb FROM {_L} WHERE category IN ('web', 'application', 'archive')",
    "d24": f"SELECT CASE WHEN path LIKE '%/http/%' THEN 'http' WHEN path LIKE '%/https/%' THEN 'https' WHEN path LIKE '%/www/%' THEN 'www' WHEN path LIKE '%/website/%' THEN 'website' WHEN path LIKE '%/websites/%' THEN 'websites' ELSE 'other_web' END AS web_root, count(*) AS file_count, {_sum(MB)} AS total_mb FROM {_L} WHERE category IN ('web', 'document', 'image') GROUP BY ALL",
    "d25": f"SELECT {_EXT} AS extension, count(*) AS n, {_sum(MB)} AS mb FROM {_L} WHERE category = 'data' GROUP BY ALL ORDER BY n DESC, extension LIMIT 10",
    "d26": f"SELECT id, class_id, path, size, {_r('size', MB)} AS size_mb FROM {_ended(_L)} WHERE category IN ('application', 'other', 'data') AND ({_likes('path', ('%.so%', '%.dylib%', '%.sqlite%'))})",
    "d27": f"SELECT id, class_id, path, category FROM {_I} WHERE category IN ('font', 'installer', 'temporary')",
    "d28": "SELECT id, path FROM (SELECT *, string_split(path, '/') AS p FROM files) WHERE list_filter(p, lambda x: x IN ('Desktop', 'Documents', 'Downloads', 'Pictures', 'Movies', 'Music') OR (contains(x, ' - ') AND regexp_matches(x, 'Desktop|Documents|Downloads|Pictures|Movies|Music')))[1] = 'Documents' AND list_contains(p[list_position(p, 'Documents') + 1:len(p) - 1], 'STAT2210')",
    "d29": f"SELECT id, class_id, path, category FROM {_I} WHERE path LIKE '/Users/shared/%/budget%'",
}
