"""Template residue, filler, error pages and script notices where content should be.

A linear classifier with an L2 penalty decides about every text cell and every whole plain text, from
hashed words, word pairs and letter triples, length and title features. It learns from weak labels: a
response status as the title of a short text, phrases of such pages, slots that make up most of a
text, and filler by its lack of ordinary words; a text that only mentions such things in running prose
is a negative. Labels are made for a bounded sample of documents, for training alone: no rule has a say
in the judgement. Some repositories ("hosts") stay out of training at first; on them it is validated and
its threshold tuned, before it learns from all. Every document is judged.

Null and empty texts are no cases. Repeated documents are judged alike. A score that equals the
threshold makes a case.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.notebooks import text_cells

TRAIN_DOCS = 10_000  #: documents whose cells are labelled for training, at most about so many
NEGATIVES = 5_000  #: of the plain negatives among their cells, about so many are kept; of hosts left out four times the part
BITS = 16
LENIENT = 1 / 6  #: where in a gap between content and residue the threshold lies
FEW = 2  #: texts of either kind on unseen hosts without which no threshold is tuned
LEAST_WORDS = 5  #: shorter blocks of a plain text are judged with the whole only

# Slot forms, status titles, phrases and ordinary words of the weak labels.
SLOT = re.compile(
    r"\{\{[^{}\n]{1,40}\}\}|\{%[^%\n]{1,40}%\}|\$\{[^}\n]{1,40}\}|\{[A-Za-z_ ]{3,40}\}|<<[^<>\n]{1,40}>>"
    r"|<(?!/?(?:html|body|div|span|img|table|pre|code|noscript|script|center|font|sub|sup|strong|head|title|style|iframe|video|thead|tbody|form|input|button|label|link|meta|main|nav|section|article)\b)[A-Za-z_ ]{3,40}>"
    r"|\[[A-Za-z_ ]{3,40}\](?!\()|\$[A-Z_]{3,40}\$|%%[A-Za-z_]{3,40}%%|@@[A-Za-z_]{3,40}@@|\bX{3,}\b|__[A-Z_]{3,40}__|_{4,}|\([A-Za-z_ ]{2,40} goes here\)"
)
STATUS = re.compile(
    r"^\W*(?:(?:http|error|fehler|erreur|erro)\W{0,3})?(?:[45]\d\d\b(?:\W{0,3}(?:client error|server error|error|not found|forbidden|unauthori[sz]ed|gone|bad request|bad gateway|gateway time-?out|request time-?out|service unavailable|service temporarily unavailable|too many requests|internal server error|access denied))?"
    r"|not found|forbidden|unauthori[sz]ed|gone|bad request|bad gateway|gateway time-?out|request time-?out|service unavailable|too many requests|internal server error|access denied|page not found|file not found"
    r"|seite nicht gefunden|page introuvable|página no encontrada|página não encontrada|oops|something went wrong|down for maintenance|your session has expired|sorry, we could not \w+ th\w+ \w+)\W*$",
    re.I,
)
# Phrases, each with words that a text must hold (in lower case) before the pattern is tried.
PHRASES = tuple(
    (key, re.compile(pattern, re.I | re.M))
    for key, pattern in (
        ("too long to", r"took too long to (?:answer|respond)"),
        ("occurred", r"unexpected (?:problem|error) occurred"),
        ("could not be loaded", r"requested (?:\w+ )?could not be loaded"),
        ("has been moved", r"does not exist on .{1,40} or has been moved"),
        ("permission to view", r"do not have permission to view"),
        ("sign in to", r"sign in to .{1,40} first"),
        ("too many requests", r"you have made too many requests"),
        ("contact support", r"problem persists, contact support"),
        ("come back", r"reload the page or come back"),
        ("go back", r"go back \| help"),
        ("n'existe plus", r"n'existe plus"),
        ("ya no existe", r"ya no existe"),
        ("nicht mehr verf", r"nicht mehr verfügbar"),
        ("existe mais", r"não existe mais"),
        ("working on it", r"we are working on it"),
        ("check back soon", r"please check back soon"),
        ("try again in", r"try again in \d+ minutes"),
        ("checking your", r"checking your browser"),
        ("could not render", r"could not render this"),
        ("has expired", r"session has expired"),
        ("down for", r"down for maintenance"),
        (
            "script",
            r"(?:enable|activate|activer|activez|aktivieren sie|active|ative|habilite) (?:o |el |le )?(?:java)?scripts?\b|(?:java)?scripts? (?:is|are) (?:disabled|turned off|off|required)"
            r"|without (?:java)?scripts?\b|needs (?:java)?scripts?\b|does not run scripts|scripts turned on|scripts and cookies must|active los scripts|javascript aktivieren",
        ),
        ("scripting", r"scripting switched on"),
        ("lorem", r"\blorem ipsum"),
        ("placeholder", r"placeholder (?:copy|text)"),
        ("text", r"(?:sample|dummy|your|body|filler) text|text goes here|text to come|replace this text|delete this text|hier text zu"),
        ("paragraph", r"(?:sample|dummy|your|body|filler) paragraph|replace this paragraph"),
        ("your code", r"your code here"),
        ("write your", r"write your answer"),
        ("click to", r"click to add"),
        ("in this cell", r"type your .{1,40} in this cell"),
        ("instructions", r"remove these instructions"),
        ("sentences", r"add (?:two or three|a few|some) sentences"),
        ("describe your", r"describe your .{1,40} here"),
        ("ici", r"écrivez ici"),
        ("aqu", r"(?:escriba|escreva|inserte) aqu[ií]"),
        ("section", r"untitled section|section heading"),
        ("caption of", r"caption of figure [nx]\b"),
        ("point", r"^\W*(?:first|second|third) point"),
        ("title", r"^\W*title\s*$"),
        ("last edited", r"last edited:\W"),
        ("heading", r"^\W*heading \d|subheading"),
    )
)


def phrases(text: str) -> int:
    """How many phrases of templates, filler and error pages a text holds."""
    low = text.lower()
    return sum(len(p.findall(text)) for key, p in PHRASES if key in low)


ORDINARY = frozenset(
    "the a an of to in and is are was were for on with that this by from at it be as or not we our but so after before than which has have had keep only no one two all its their there these those will can if into over under then "
    "der die das den dem des ein eine und ist sind war für auf mit von zu im wir bei aus nicht auch nach über dem es sich als wie aber "
    "le la les un une des du de et est sont en dans pour sur avec par au aux ce cette que qui nous à il ne pas plus se son "
    "el los las una del y es son con por para se al lo su como pero más entre "
    "o os as um uma do da dos das e é são em no na nos nas com por para ao que se".split()
)
WORD = re.compile(r"§|[^\W\d_]+|0|\.{3}")
GAPS = re.compile(r"\S {2,}\S.*\S {2,}\S|^\S+ {3,}\S+$|^ {4,}\S+ {2,}\S+")
DIGITS = re.compile(r"\d+")
MAY_SLOT = re.compile(r"[{<\[$@]|%%|__|XXX|goes here")
MATH = re.compile(r"\$\$[^$]*\$\$|\$[^$\n\\_^=]*[\\_^=][^$\n]*\$")
TAG = re.compile(r"</?(?:html|body|div|span|p|h[1-6]|noscript|center|b|i|br|hr|title|head)\b[^>]*>", re.I)
ITEM = re.compile(r"^[^\S\n]*(?:[-*+]\s+|#+\s).*$", re.M)
CODE_LINE = re.compile(r"^\s*(?:%%?\w+|[!@]|[\w.\[\]']+\s*(?:<-|[+*]?=)\s|(?:import|from|def|for|if|return|print|assert|library|using|function|end|class|with|try|except|while)\b|#\s*your code here)")
CALL = re.compile(r"\s*\S[^\s(]*\(")


class Text:
    """A cell's counts, from which its label and features come."""

    __slots__ = ("plain", "marked", "slots", "words", "n", "title", "ordinary", "distinct", "most", "_items", "_phrases")

    def __init__(self, raw: str):
        if "$" in raw:
            raw = MATH.sub(" ", raw)
        if "<" in raw:
            raw = TAG.sub("\n", raw)
        self.plain = raw.strip()
        self.marked, self.slots = SLOT.subn(" § ", self.plain) if MAY_SLOT.search(self.plain) else (self.plain, 0)
        self.marked = self.marked.strip()
        self.words = WORD.findall(DIGITS.sub("0", self.marked.lower()))
        self.n = len(self.words)
        self.title = self.marked.split("\n", 1)[0].strip()
        kinds = Counter(self.words)
        letters = self.n - kinds["§"] - kinds["0"]
        self.ordinary = sum(kinds[w] for w in kinds.keys() & ORDINARY) / max(1, letters)
        self.distinct = len([1 for w in kinds if kinds[w]]) / max(1, self.n)
        self.most = max(kinds.values(), default=0) / max(1, self.n)
        self._items: bool | None = None
        self._phrases: int | None = None

    @property
    def only_items(self) -> bool:
        """Whether there is nothing but headings and list items."""
        if self._items is None:
            self._items = self.n < 60 and not ITEM.sub("", self.marked).strip()
        return self._items

    @property
    def phrases(self) -> int:
        if self._phrases is None:
            self._phrases = phrases(self.plain)
        return self._phrases

    def label(self) -> int | None:
        """1 for residue, 0 for content, None where the weak rules are silent."""
        if not self.plain:
            return None
        phrase = self.phrases
        status = self.n <= 45 and STATUS.match(self.title)
        if self.slots and self.n - self.slots <= 7 * self.slots:
            return 1
        if self.n <= 45 and status:
            return 1
        if self.n <= 24 * phrase:
            return 1
        if self.n >= 8 and self.distinct <= 0.4 and self.most >= 0.2 and self.ordinary < 0.3:
            return 1
        if self.n >= 5 and not self.only_items and self.ordinary == 0 and not self.slots and len(self.marked.split("\n", 1)[0]) > 12:
            return 1 if all(w != "0" for w in self.words) else None
        if self.slots or phrase or status:
            return 0 if self.ordinary >= 0.15 and self.n >= 12 else None
        return 0 if self.only_items or (self.ordinary >= 0.12 and self.n >= 5) else None


_known: dict[str, np.ndarray] = {}
MASK = (1 << BITS) - 1


def _hash(s: str) -> int:
    return zlib.crc32(s.encode()) & MASK


def _word(w: str) -> np.ndarray:
    """The features of one word: itself first, then its letter triples."""
    got = _known.get(w)
    if got is None:
        if len(_known) > 400_000:
            _known.clear()
        edged = f"^{w}$"
        got = _known[w] = np.array([_hash("w" + w)] + [_hash("c" + edged[i : i + 3]) for i in range(len(edged) - 2)], np.int64)
    return got


def _shape(t: Text) -> list[int]:
    """Length, make-up and title, each as one feature."""
    title = WORD.findall(t.title.lower())
    level = lambda name, x: _hash(f"{name}:{x}")
    return [
        level("n", min(12, int(np.log2(t.n + 1) * 2))),
        level("slots", min(8, int(16 * t.slots / max(1, t.n)))),
        level("ordinary", min(8, int(t.ordinary * 20))),
        level("distinct", int(t.distinct * 10)),
        level("most", min(5, int(t.most * 10))),
        level("items", t.only_items),
        level("lines", min(4, t.plain.count("\n"))),
        level("title", min(10, len(title))),
        *(_hash("t" + w) for w in title if len(title) <= 8),
    ]


def features(t: Text) -> np.ndarray:
    """Indices of a text's features, each once: text that repeats itself counts like one that does not."""
    if not t.words:
        return np.zeros(0, np.int64)
    first = np.array([_word(w)[0] for w in t.words], np.int64)
    pairs = (first[:-1] * 40503 + first[1:] * 7919) & MASK
    return np.unique(np.concatenate([*map(_word, dict.fromkeys(t.words)), pairs, np.array(_shape(t), np.int64)]))


def logit(weights: np.ndarray, x: np.ndarray) -> float:
    """The score of a text's features; a text without words is no case."""
    return float(weights[x].sum() / np.sqrt(len(x)) + weights[-1]) if len(x) else -30.0


def fit(rows: list[np.ndarray], labels: np.ndarray, penalty: float = 1e-4, steps: int = 300) -> np.ndarray:
    """Logistic regression with an L2 penalty, both classes weighted alike, by accelerated gradient steps."""
    size = 1 << BITS
    if not len(rows) or labels.min() == labels.max():
        out = np.zeros(size + 1)
        out[-1] = -1.0 if not len(rows) or labels.max() == 0 else 1.0
        return out
    flat = np.concatenate(rows)
    n = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), n)
    value = 1 / np.sqrt(n)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    w = look = np.zeros(size + 1)
    rate = 4.0 / max(1.0, float(np.median(n)) / 40)
    for k in range(steps):
        z = np.bincount(owner, look[flat], len(rows)) * value + look[-1]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
        g = np.concatenate((np.bincount(flat, (miss * value)[owner], size), [miss.sum()])) + penalty * np.append(look[:-1], 0)
        step = look - rate * g
        look, w = step + k / (k + 3) * (step - w), step
    return w


def _no_prose(block: str) -> bool:
    """Whether a block of a plain text is code, a table or a printout."""
    lines = block.split("\n")
    if all(CODE_LINE.match(x) or CALL.match(x) and x.rstrip().endswith(")") for x in lines) or sum(bool(GAPS.search(x)) for x in lines) * 2 >= len(lines):
        return True
    words = block.split()
    numbers = sum(w.strip("()[],:%").replace(".", "").isdigit() for w in words)
    return numbers > max(2, 0.3 * len(words)) or len(block) > 300 and " " not in block


def units(text: str) -> tuple[str, list[Text]]:
    """The form and what is judged: every text cell; of a plain text its prose as a whole, then block by block.

    A plain text has no marks between prose, code and output, so that code and printouts are left out
    by their looks.
    """
    form, cells = text_cells(text)
    if form != "plain":
        return form, [t for t in map(Text, cells) if t.n or t.plain]
    blocks = [c for c in cells if not _no_prose(c)]
    parts = [Text(c) for c in blocks] if len(blocks) > 1 else []
    return form, [Text("\n\n".join(blocks)), *(t for t in parts if t.n >= LEAST_WORDS)] if blocks else []


def judge(text: str, weights: np.ndarray, threshold: float) -> tuple[float, bool]:
    """The score that decides about a text, and whether the text is a case.

    A notebook is as bad as its worst cell. A plain text is a case as a whole or not at all: its score
    is the least among the whole and its blocks.
    """
    form, judged = units(text)
    scores = [logit(weights, features(t)) for t in judged]
    score = (min if form == "plain" else max)(scores, default=-30.0)
    return score, score >= threshold


def _hosted(documents: DataFrame) -> DataFrame:
    host = F.pmod(F.xxhash64(F.coalesce("repo", "source", F.lit(""))), F.lit(5)) == 0
    return documents.where("text is not null and text != ''").select("doc_id", "text", host.alias("unseen"))


def labelled(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """unseen, label and features of weakly labelled cells of about train_docs documents."""
    total = documents.count()
    part = min(1.0, train_docs / max(1, total))
    docs = _hosted(documents).where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    thin = max(1, round(4 * part * total / NEGATIVES))  # a document has about four cells that are content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unseen, label, xs = [], [], []
            for text, host in zip(b.column("text"), b.column("unseen").to_pylist(), strict=True):
                form, judged = units(text.as_py())
                for t in judged[:1] if form == "plain" else judged:  # blocks of plain texts are no units of their own
                    y = t.label()
                    if y is None or y == 0 and not (t.slots or t.phrases) and zlib.crc32(t.plain.encode()) % (max(1, thin // 4) if host else thin):
                        continue
                    unseen.append(host)
                    label.append(y)
                    xs.append(features(t).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(unseen, pa.bool_()), pa.array(label, pa.int32()), pa.array(xs, pa.list_(pa.int32()))], names=["unseen", "label", "x"])

    return docs.mapInArrow(run, "unseen boolean, label int, x array<int>")


def tune(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold with the fewest errors on texts of unseen hosts.

    Of the intervals of thresholds that are as good it takes the widest, and there a point near the lower
    end: residue of a wording that no label knows scores lower than what was learned, content of unseen
    hosts as low as any. With fewer than FEW texts of a kind it is 0, where both are as likely.
    """
    if min((labels == 1).sum(), (labels == 0).sum()) < FEW:
        return 0.0
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    # cutting before place k: residue below it is missed, content from it on is taken wrongly
    errors = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    edges = np.concatenate(([s[0] - 1.0], s, [s[-1] + 1.0]))
    best = np.flatnonzero(errors == errors.min())
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float(edges[k] + (edges[k + 1] - edges[k]) * LENIENT)


def train(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, dict[str, float]]:
    """Weights, and how those learned without the unseen hosts do there, with the threshold tuned there.

    The weights returned are learned once more, from the cells of all hosts.
    """
    got = labelled(documents, train_docs).toArrow()  # bounded by train_docs
    y = got.column("label").to_numpy().astype(np.int64)
    unseen = np.array(got.column("unseen").to_pylist(), bool)
    flat = got.column("x").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    at, ends = flat.values.to_numpy(), flat.offsets.to_numpy()
    xs = [at[a:b].astype(np.int64) for a, b in zip(ends[:-1], ends[1:])]
    keep = [i for i in np.flatnonzero(~unseen) if len(xs[i])]
    weights = fit([xs[i] for i in keep], y[keep])
    z = np.array([logit(weights, xs[i]) for i in np.flatnonzero(unseen)])
    threshold = tune(z, y[unseen])
    p, t = z >= threshold, y[unseen] == 1
    hit = int((p & t).sum())
    every = [i for i in range(len(xs)) if len(xs[i])]
    weights = fit([xs[i] for i in every], y[every])
    return weights, {"train": len(keep), "held_out": len(z), "positives": int(t.sum()), "threshold": threshold, "precision": hit / max(1, int(p.sum())), "recall": hit / max(1, int(t.sum()))}


def judged(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, the score that decides about a document, and whether it is a case."""
    weights, m = train(documents, train_docs)
    kept = documents.sparkSession.sparkContext.broadcast(weights)  # 2**BITS numbers
    threshold = m["threshold"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [judge(text.as_py(), kept.value, threshold) for text in b.column("text")]
            score, case = [s for s, _ in got], [c for _, c in got]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score, pa.float64()), pa.array(case, pa.bool_())], names=["doc_id", "score", "residue"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return _hosted(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, residue boolean")


def residue_documents(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    return judged(documents, train_docs).where("residue").select("doc_id").distinct()


def validation(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row: sizes, threshold, and precision and recall against the weak labels of unseen hosts."""
    _, m = train(documents, train_docs)
    return documents.sparkSession.createDataFrame([tuple(m.values())], "train long, held_out long, positives long, threshold double, precision double, recall double")
