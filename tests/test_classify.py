import mimetypes
import pathlib
import sys

from cairn.functions import rules
from cairn.operators.classify import classify

CASES = {
    "/a/x.jpg": "image", "/a/x.mp4": "video", "/a/x.mp3": "audio", "/a/x.ttf": "font", "/a/x.csv": "spreadsheet", "/a/x.py": "document", "/a/x.pdf": "document", "/a/x.doc": "document", "/a/x.xls": "spreadsheet",
    "/a/x.ppt": "presentation", "/a/x.zip": "archive", "/a/x.json": "data", "/a/x.xml": "document", "/a/x.sh": "code", "/a/x.psd": "image", "/a/x.ts": "video", "/a/x.flac": "audio", "/a/x.tex": "document", "/a/x.ods": "spreadsheet",
    "/a/x.key": "presentation", "/a/x.java": "code", "/a/x.7z": "archive", "/a/x.yaml": "data", "/a/x.dfont": "font", "/a/x.exe": "installer", "/a/x.pem": "certificate", "/a/x.lnk": "shortcut", "/a/x.mat": "scientific",
    "/a/x.qdf": "financial", "/a/x.h264": "financial", "/a/x.tax2023": "financial", "/a/x.bak": "backup", "/a/x.tmp": "temporary", "/a/x.plist": "system", "/a/x.pbxproj": "code", "/a/Makefile": "code", "/a/LICENSE": "system",
    "/A/Contents/MacOS/run": "installer", "/A/Contents/Resources/q": "system", "/a/my alias": "shortcut", "/a/x.log2": "system", "/a/workspace/q": "data", "/a/cs101": "education", "/a/W2 form": "financial", "/x/www/page": "web",
    "/x/www/index.html": "document", "/x/Packet Tracer/q": "application", "/a/zzz": "other", "/a/CS101.pdf": "document", "/a/x.csv.gz": "spreadsheet", "/a/x.tar.gz": "archive", "/a/x.tgz": "archive", "/a/x.gz": "archive",
    "/a/x.svgz": "image", "/a/.bashrc": "other", "/a/foo.": "other", "/a/X.JPG": "image", "/a/x.Z": "other",
}


def test_every_rule(spark):
    df = spark.createDataFrame([(p, 1) for p in CASES] + [(None, 1)], "path string, category int")
    got = {r.path: r.kind for r in classify(df, to="kind").collect()}
    assert got.pop(None) == "other"
    assert got == CASES
    assert set(CASES.values()) == set(rules.CATEGORIES)


def mime_category(mime):
    """The MIME stage, written out once more."""
    if mime is None:
        return None
    first = mime.split("/")[0]
    if first in ("image", "video", "audio", "font"):
        return first
    if first == "text":
        return "spreadsheet" if mime == "text/csv" else "document"
    kinds = {
        "document": ["application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/rtf"],
        "spreadsheet": ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
        "presentation": ["application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation"],
        "archive": ["application/zip", "application/x-tar", "application/x-gzip", "application/x-bzip2", "application/x-7z-compressed", "application/x-rar-compressed", "application/x-iso9660-image"],
        "data": ["application/json", "application/xml"],
        "installer": ["application/x-executable", "application/x-mach-binary", "application/x-msdownload"],
        "code": ["application/x-sh"],
    }
    return next((c for c, types in kinds.items() if mime in types), None)


def test_mime_stage_is_that_of_python_3_13(spark):
    types = mimetypes.MimeTypes(filenames=())
    if sys.version_info[:2] == (3, 13):
        assert rules.mime_table() == sorted((e, c) for e, m in types.types_map[True].items() if (c := mime_category(m)))
        assert rules.SUFFIX_MAP == types.suffix_map and set(rules.ENCODINGS) == set(types.encodings_map)
    names = [f"/a/x{e}" for e in (*types.types_map[True], ".tar.gz", ".svgz", ".txt.bz2", ".TXT", ".tar.GZ", ".tgz")]
    df = spark.createDataFrame([(p,) for p in names], "path string")
    for r in classify(df).collect():
        want = mime_category(types.guess_type(r.path)[0])
        if want:
            assert r.category == want, r.path


def test_tables_have_no_clash():
    ext = [e for _, names in rules.EXTENSIONS for e in names]
    assert len(ext) == len(set(ext))
    assert not set(ext) & {e for e, _ in rules.mime_table()} and all(pathlib.PurePosixPath("x" + e).suffix == e for e in ext)
