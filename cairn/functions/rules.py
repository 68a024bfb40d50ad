"""The classification rules: MIME stage, extension stage, then names and paths; the first that fits wins."""

from __future__ import annotations

# Extensions whose MIME type decides, by the category it stands for. They are those of
# Python 3.13's own table, kept here so that neither the interpreter nor the machine has a say.
MIME_EXTENSIONS = (
    ("image", (
        ".avif", ".bmp", ".gif", ".heic", ".heif", ".ico", ".ief", ".jpe", ".jpeg", ".jpg", ".pbm", ".pgm", ".png", ".pnm", ".ppm", ".ras", ".rgb", ".svg",
        ".tif", ".tiff", ".webp", ".xbm", ".xpm", ".xwd",
    )),
    ("video", (".avi", ".m1v", ".mov", ".movie", ".mp4", ".mpa", ".mpe", ".mpeg", ".mpg", ".qt", ".webm")),
    ("audio", (".3g2", ".3gp", ".3gpp", ".3gpp2", ".aac", ".adts", ".aif", ".aifc", ".aiff", ".ass", ".au", ".loas", ".mp2", ".mp3", ".opus", ".ra", ".snd", ".wav")),
    ("document", (
        ".bat", ".c", ".css", ".doc", ".dot", ".etx", ".h", ".htm", ".html", ".js", ".ksh", ".markdown", ".md", ".mjs", ".n3", ".pdf", ".pl", ".py", ".rst",
        ".rtf", ".rtx", ".sgm", ".sgml", ".srt", ".tsv", ".txt", ".vcf", ".vtt", ".wiz", ".xml",
    )),
    ("spreadsheet", (".csv", ".xlb", ".xls")),
    ("presentation", (".pot", ".ppa", ".pps", ".ppt", ".pwz")),
    ("archive", (".tar", ".zip")),
    ("data", (".json", ".rdf", ".wsdl", ".xpdl", ".xsl")),
    ("code", (".sh",)),
)
#: Fixed values of that table: short suffixes and what they stand for, and encodings that are taken off.
SUFFIX_MAP = {".svgz": ".svg.gz", ".tgz": ".tar.gz", ".taz": ".tar.gz", ".tz": ".tar.gz", ".tbz2": ".tar.bz2", ".txz": ".tar.xz"}
ENCODINGS = (".gz", ".Z", ".bz2", ".xz", ".br")

# Extensions by category, in order of evaluation. Extensions whose MIME type already
# decides, and those that an earlier category holds, are left out.
EXTENSIONS = (
    ("image", (".raw", ".cr2", ".nef", ".dng", ".psd", ".ai", ".eps", ".indd")),
    ("video", (".wmv", ".flv", ".mkv", ".m4v", ".ogv", ".vob", ".ts", ".mts", ".m2ts")),
    ("audio", (".flac", ".ogg", ".m4a", ".wma", ".ape", ".alac", ".mid", ".midi")),
    ("document", (".docx", ".odt", ".tex", ".pages", ".epub", ".mobi", ".azw", ".djvu")),
    ("spreadsheet", (".xlsx", ".ods", ".numbers")),
    ("presentation", (".pptx", ".odp", ".key")),
    ("code", (
        ".java", ".cpp", ".hpp", ".cs", ".rb", ".go", ".rs", ".bash", ".zsh", ".php", ".swift", ".kt", ".scala", ".r", ".m", ".vb", ".lua", ".groovy",
        ".jsx", ".tsx", ".sql", ".scss", ".sass", ".less", ".vue", ".dart", ".f90", ".f", ".asm", ".s", ".lisp", ".cl", ".scm", ".el", ".clj", ".coffee",
        ".hs", ".ml", ".erl", ".ex", ".jl", ".nim", ".scpt", ".applescript", ".cmd", ".ps1", ".psm1", ".class", ".pyc", ".pyo", ".pyd", ".o", ".obj", ".a",
        ".lib", ".jar", ".war", ".ear",
    )),
    ("archive", (
        ".gz", ".bz2", ".7z", ".rar", ".xz", ".lz", ".lzma", ".iso", ".dmg", ".img", ".vhd", ".vmdk", ".vdi", ".ova", ".ovf", ".qcow2", ".toast", ".cdr",
        ".nrg", ".mds", ".mdf", ".mdzip", ".sitx", ".cab", ".ace", ".arj", ".cpio",
    )),
    ("data", (
        ".yaml", ".yml", ".toml", ".ini", ".conf", ".cfg", ".sqlite", ".db", ".mdb", ".accdb", ".sqlite3", ".sqlite-wal", ".sqlite-shm", ".dat", ".data",
        ".prefs", ".properties", ".config", ".settings",
    )),
    ("font", (".ttf", ".otf", ".woff", ".woff2", ".eot", ".fon", ".dfont")),
    ("installer", (
        ".exe", ".msi", ".app", ".pkg", ".mpkg", ".deb", ".rpm", ".apk", ".ipa", ".run", ".bin", ".out", ".elf", ".dll", ".so", ".dylib", ".msu", ".appx",
        ".msix", ".flatpak", ".snap", ".appimage",
    )),
    ("certificate", (".p7b", ".p12", ".pfx", ".cer", ".crt", ".pem", ".der", ".csr", ".p7c", ".spc", ".pub", ".wzd")),
    ("shortcut", (".lnk", ".url", ".webloc", ".desktop", ".rdp", ".vncloc")),
    ("scientific", (".mat", ".fig", ".hdf5", ".h5", ".nc", ".fits", ".npy", ".npz", ".rdata", ".rds", ".sav", ".dta", ".pkl", ".pickle")),
    ("financial", (".qdf", ".qel", ".qfx", ".qif", ".qpb", ".qsd", ".qph", ".qxf", ".qmtf", ".qnx", ".txf")),
    ("backup", (".bak", ".backup", ".old", ".orig", ".save", ".swp", ".tmp~")),
    ("temporary", (".tmp", ".temp", ".cache", ".crdownload", ".part", ".download", ".partial", ".filepart")),
    ("system", (
        ".strings", ".plist", ".nib", ".xib", ".storyboard", ".mobileprovision", ".entitlements", ".car", ".tbd", ".framework", ".bundle", ".xcuserstate",
        ".xcworkspacedata", ".xcscheme", ".xcbkptlist",
    )),
    ("code", (".xcodeproj", ".xcworkspace", ".pbxproj")),
)
#: Prefixes of financial extensions, tested after the financial ones above.
FINANCIAL_PREFIXES = (".tax", ".q2", ".t2", ".h2")
# Fixed values of the name and path stage.
CODE_NAMES = ("Makefile", "makefile", "Rakefile", "Gemfile")
SYSTEM_NAMES = ("CodeResources", "Info.plist", "PkgInfo", "version.plist", "Dockerfile", "Vagrantfile", ".gitignore", ".dockerignore", "bootstrap", "jquery", "LICENSE", "README", "CHANGELOG")
IDE_PARTS = ("/.metadata/", "/.vscode/", "/.idea/", "/.eclipse/", "/.settings/", "/workspace/", "/.project", "/.classpath", "/nbproject/")
EDUCATION_PREFIXES = ("cs", "ceg", "stat", "mat", "econ", "phys", "chem", "bio", "eng", "math")
FINANCIAL_WORDS = ("tax", "taxes", "1040", "w2", "w-2", "1099", "quicken", "finance", "financial", "invoice", "receipt", "banking", "investment", "retirement", "401k", "ira")
WEB_ROOTS = ("/http/", "/https/", "/www/", "/website/", "/websites/", "/web/", "/html/", "/public_html/", "/htdocs/", "/web-projects/", "/sites/")
APPLICATION_ROOTS = ("/packettracer/", "/packet tracer/")
CATEGORIES = ("image", "video", "audio", "font", "document", "spreadsheet", "presentation", "archive", "data", "installer", "code", "certificate", "shortcut", "scientific", "financial", "backup", "temporary", "system", "education", "web", "application", "other")


def _first(groups: tuple) -> list[tuple[str, str]]:
    """(extension, category), each extension with the first category that names it."""
    out: dict[str, str] = {}
    for category, names in groups:
        for e in names:
            out.setdefault(e, category)
    return sorted(out.items())


def mime_table() -> list[tuple[str, str]]:
    """(extension, category) of the extensions whose MIME type decides."""
    return _first(MIME_EXTENSIONS)


def extension_table() -> list[tuple[str, str]]:
    return _first(EXTENSIONS)
