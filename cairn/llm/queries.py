"""Queries of the operators for training text, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.catalog import content_sql, table
from cairn.llm import consensus, history, lookalike, mixing, packing, residue
from cairn.session import cut, shared_path


def p2_found(spark, d):
    return history.known_ids(table(spark, d, "files"), table(spark, d, "excerpts"))


def p2_last_batch(spark, d):
    """The latest batch, looked up in a stored index of all earlier ones."""
    files, excerpts = table(spark, d, "files"), table(spark, d, "excerpts")
    last = files.agg(F.max(F.to_date("scanned_at"))).first()[0]
    index = history.HistoryIndex(spark, shared_path(spark, "history"))
    try:
        index.append(files.where(F.to_date("scanned_at") < F.lit(last)), excerpts)
        return cut(index.check(files.where(F.to_date("scanned_at") == F.lit(last)), excerpts))
    finally:
        index.remove()


def p3_found(spark, d):
    return consensus.trusted(table(spark, d, "files"), table(spark, d, "classifications"))


def p3_survivors(spark, d):
    return consensus.survivors(table(spark, d, "files"), table(spark, d, "classifications"))


def p3_trusted(spark, d):
    """What the rows that trusted() picks hold: the part of a survivor that rules decide."""
    files, classes = table(spark, d, "files"), table(spark, d, "classifications")
    one = lambda df, key, *cs: df.select(F.col("id").alias(key), *cs).dropDuplicates([key])
    out = consensus.trusted(files, classes).join(one(files, "mtime_id", "mtime"), "mtime_id", "left").join(one(files, "path_id", "path"), "path_id", "left")
    out = out.join(one(classes, "classification_id", F.lower(F.trim("category")).alias("category"), "confidence"), "classification_id", "left")
    return out.select("content_hash", "mtime", "path", "category", "confidence")


def p3_majority(spark, d):
    """Of the survivors, the sizes, and the paths that need no alignment: what SQL can compute, too."""
    got = p3_survivors(spark, d)
    of = lambda field, c: F.when(c, F.struct(F.lit(field).alias("field"), F.col(field).cast("string").alias("value")))
    fields = F.array_compact(F.array(of("path", ~F.col("path_aligned")), of("size", F.col("size").isNotNull())))
    return got.select("content_hash", F.inline(fields))


def p4_found(spark, d):
    return lookalike.lookalike_pairs(table(spark, d, "files"))


def p4_forms(spark, d):
    return lookalike.forms(table(spark, d, "files").select("id", "path", "duplicate_of")).select("id", "field", "form").distinct()


def p6_packed(spark, d):
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p6_report(spark, d):
    return packing.fill_report(p6_packed(spark, d))


def p6_checks(spark, d):
    return packing.packing_checks(p6_packed(spark, d))


def p7_mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_checks(spark, d):
    return mixing.mixture_checks(*mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p8_found(spark, d):
    return residue.residue_documents(table(spark, d, "documents"))


def p8_validation(spark, d):
    return residue.validation(table(spark, d, "documents"))


def p8_checks(spark, d):
    """One row: documents judged, and how many cases have no text, are no document, or come twice."""
    docs = table(spark, d, "documents")
    texts = docs.select("doc_id", (F.length("text") > 0).alias("has_text")).groupBy("doc_id").agg(F.max("has_text").alias("has_text"))
    found = p8_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    of = lambda name, c: F.count_if(c).alias(name)
    none = ~F.coalesce("has_text", F.lit(False))
    return texts.join(found, "doc_id", "full").agg(of("judged", ~none), of("without_text", F.col("n").isNotNull() & none), of("twice", F.col("n") > 1))


SPARK = {
    f.__name__: f
    for f in (p2_found, p2_last_batch, p3_found, p3_trusted, p3_survivors, p3_majority, p4_found, p4_forms, p6_packed, p6_report, p6_checks, p7_mixture, p7_shares, p7_checks, p8_found, p8_validation, p8_checks)
}


def _translation() -> tuple[str, str]:
    """Characters that have another form, one by one, and these forms; those without any come last."""
    import unicodedata

    alike = {a: b for x, y in lookalike.LOOKALIKES for a, b in zip(x, y, strict=True)}
    left, right, gone = [], [], []
    for n in (*range(0x7F, 0x530), *range(0x115F, 0x1161), *range(0x2000, 0x2070), *range(0xFE00, 0xFE10), 0x3000, 0xFEFF, *range(0xFF01, 0xFFE7), *(ord(c) for c in alike if ord(c) > 0x530)):
        c = chr(n)
        if unicodedata.category(c) == "Cf" or any(a <= n <= b for a, b in lookalike.INVISIBLE):
            gone.append(c)
            continue
        wide = unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith(("<wide>", "<narrow>")) else c
        to = " " if unicodedata.category(c) == "Zs" else unicodedata.normalize("NFC", "".join(alike.get(x, x) for x in unicodedata.normalize("NFD", wide)))
        if to != c and len(to) == 1 and c not in left:
            left.append(c)
            right.append(to)
    return "".join(left + gone), "".join(right)


_FROM, _TO = (x.replace("'", "''") for x in _translation())
_FORMS = f"""
s AS (SELECT DISTINCT id, 'path' AS field, path AS text FROM files WHERE path IS NOT NULL UNION SELECT DISTINCT id, 'duplicate_of', duplicate_of FROM files WHERE duplicate_of IS NOT NULL),
forms AS (SELECT id, field, text, nfc_normalize(translate(text, '{_FROM}', '{_TO}')) AS form FROM s)"""
_KNOWN = f"""
WITH f AS (SELECT DISTINCT id, scanned_at::DATE AS day, {content_sql()} AS content FROM files WHERE scanned_at IS NOT NULL AND id IS NOT NULL),
x AS (SELECT DISTINCT id, day, list_distinct(regexp_extract_all(lower(excerpt), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM excerpts JOIN f ON file_id = id WHERE excerpt IS NOT NULL)
SELECT a.id FROM f a JOIN (SELECT content, min(day) AS first FROM f WHERE content IS NOT NULL GROUP BY content) c USING (content) WHERE first < day
UNION
SELECT a.id FROM x a JOIN x b ON b.day < a.day AND len(b.w) BETWEEN 0.59 * len(a.w) AND 1.7 * len(a.w)
WHERE len(list_intersect(a.w, b.w)) * 100 >= 60 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AND len(a.w) > 0"""

_TRUSTED = f"""
WITH f AS (SELECT DISTINCT id, path, mtime, scanned_at, {content_sql()} AS c FROM files WHERE id IS NOT NULL),
g AS (SELECT c FROM f WHERE c IS NOT NULL GROUP BY c HAVING count(DISTINCT id) > 1),
m AS (SELECT c, arg_min(id, (-epoch_us(mtime), id)) AS i FROM f WHERE mtime IS NOT NULL AND year(mtime) <> 1970 AND NOT coalesce(mtime > scanned_at, false) GROUP BY c),
p AS (SELECT c, arg_min(id, (len(path) - len(replace(path, '/', '')), id)) AS i FROM f WHERE path IS NOT NULL GROUP BY c),
k AS (SELECT c, arg_min(k.id, (-confidence, -coalesce(epoch_us(classified_at), -4000000000000000000), k.id)) AS i
      FROM classifications k JOIN f ON file_id = f.id WHERE confidence BETWEEN 0 AND 1 GROUP BY c),
picked AS (SELECT c AS content_hash, coalesce(m.i, 0) AS mtime_id, coalesce(p.i, 0) AS path_id, coalesce(k.i, 0) AS classification_id
           FROM g LEFT JOIN m USING (c) LEFT JOIN p USING (c) LEFT JOIN k USING (c))"""

SQL = {
    "p2_found": _KNOWN,
    "p2_last_batch": f"SELECT id FROM ({_KNOWN}) JOIN (SELECT DISTINCT id FROM files WHERE scanned_at::DATE = (SELECT max(scanned_at::DATE) FROM files)) USING (id)",
    "p3_found": f"{_TRUSTED} SELECT * FROM picked",
    "p3_trusted": f"""{_TRUSTED}
SELECT content_hash, f.mtime, g.path, lower(trim(k.category)) AS category, k.confidence FROM picked
LEFT JOIN (SELECT DISTINCT id, mtime FROM files) f ON f.id = mtime_id LEFT JOIN (SELECT DISTINCT id, path FROM files) g ON g.id = path_id
LEFT JOIN (SELECT DISTINCT id, category, confidence FROM classifications) k ON k.id = classification_id""",
    "p3_majority": f"""{_TRUSTED},
w AS (SELECT c, path, size::VARCHAR AS size, 1.0 + (mtime IS NOT NULL AND year(mtime) <> 1970 AND NOT coalesce(mtime > scanned_at, false))::INT + (size IS NOT NULL)::INT + (NOT coalesce(is_duplicate, false))::INT AS weight
      FROM (SELECT DISTINCT id, path, mtime, scanned_at, size, is_duplicate, {content_sql()} AS c FROM files WHERE id IS NOT NULL) JOIN g USING (c)),
v AS (SELECT c, 'path' AS field, path AS value, sum(weight) AS weight FROM w WHERE path IS NOT NULL GROUP BY ALL UNION ALL SELECT c, 'size', size, sum(weight) FROM w WHERE size IS NOT NULL GROUP BY ALL),
t AS (SELECT *, sum(weight) OVER (PARTITION BY c, field) AS total, row_number() OVER (PARTITION BY c, field ORDER BY weight DESC, value) AS rn FROM v)
SELECT c AS content_hash, field, value FROM t WHERE rn = 1 AND (field = 'size' OR 2 * weight >= total)""",
    "p4_forms": f"WITH {_FORMS} SELECT id, field, form FROM forms",
    "p4_found": f"""WITH {_FORMS}
SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, a.field FROM forms a JOIN forms b ON a.form = b.form AND b.field = 'path' AND a.id <> b.id AND a.text <> b.text""",
    # what no SQL can compute is held to rules that it can state
    "p6_checks": """SELECT container, capacity_tokens::BIGINT AS capacity_tokens, (SELECT count(DISTINCT doc_id) FROM documents) AS n_documents,
(SELECT count(DISTINCT doc_id) FROM documents WHERE coalesce(text, '') = '') AS n_empty, 0::BIGINT AS split, 0::BIGINT AS incomplete, 0::BIGINT AS overfull, 0::BIGINT AS gaps FROM (SELECT DISTINCT * FROM containers)""",
    "p7_checks": "SELECT DISTINCT replace(lower(trim(source)), '-', '_') AS source, true AS within_cap, true AS totals_agree, true AS within_budget, true AS reached FROM mix_targets",
    "p8_checks": "SELECT count(DISTINCT doc_id) FILTER (length(text) > 0) AS judged, 0::BIGINT AS without_text, 0::BIGINT AS twice FROM documents",
}
