"""Taking notebooks apart: the text cells of the four written forms.

percent: `# %% [markdown]` and `# %%` open cells, text lines carry a leading `#`; prompt: `Text:`,
`In [n]:` and `Out[n]:` open cells; json: nbformat 4, also when it is cut off; anything else is plain
and has no cells that could be told apart, so that its blocks between blank lines stand for them.
"""

from __future__ import annotations

import json
import re

PERCENT = re.compile(r"^# %%[^\n]*$", re.M)
PROMPT = re.compile(r"^(?:Text:|In ?\[[^\]\n]*\]:|Out ?\[[^\]\n]*\]:)[ \t]*$", re.M)
LEAD = re.compile(r"^#[ \t]?", re.M)
BLOCK = re.compile(r"\n[ \t]*\n")
DECODER = json.JSONDecoder(strict=False)


def _json_cells(text: str) -> list[tuple[str, str]] | None:
    """(kind, source) of the cells; those before the break if the text is cut off."""
    try:
        cells = DECODER.decode(text.strip())["cells"]
    except (ValueError, KeyError, TypeError, RecursionError):
        m = re.search(r'"cells"\s*:\s*\[', text)
        if not m:
            return None
        cells, at = [], m.end()
        while True:
            at = re.compile(r"[\s,]*").match(text, at).end()
            try:
                cell, at = DECODER.raw_decode(text, at)
            except (ValueError, RecursionError):
                break
            cells.append(cell)
    if not isinstance(cells, list):
        return None
    out = []
    for c in cells:
        if isinstance(c, dict):
            s = c.get("source") or ""
            out.append((str(c.get("cell_type")), s if isinstance(s, str) else "".join(x for x in s if isinstance(x, str))))
    return out


def layout(text: str) -> str:
    a, b = PERCENT.search(text), PROMPT.search(text)
    if text.lstrip()[:1] == "{":
        key = text.find('"cells"')
        if key >= 0 and not any(m and m.start() < key for m in (a, b)):  # JSON has no line that begins with a mark
            return "json"
    if a and not (b and b.start() < a.start()):
        return "percent"
    return "prompt" if b else "plain"


def text_cells(text: str) -> tuple[str, list[str]]:
    """The form of a notebook and its text cells without marks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    form = layout(text)
    if form == "json":
        cells = _json_cells(text)
        if cells is not None:
            return form, [s.strip() for k, s in cells if k == "markdown"]
        form = "plain"
    if form == "percent":
        marks = list(PERCENT.finditer(text))
        ends = [m.start() for m in marks[1:]] + [len(text)]
        out = [LEAD.sub("", text[m.end() : e].strip("\n")).strip() for m, e in zip(marks, ends) if "[markdown]" in m[0]]
        return form, [text[: marks[0].start()].strip()] * bool(text[: marks[0].start()].strip()) + out
    if form == "prompt":
        marks = list(PROMPT.finditer(text))
        ends = [m.start() for m in marks[1:]] + [len(text)]
        out = [text[m.end() : e].strip() for m, e in zip(marks, ends) if m[0].startswith("Text")]
        return form, [text[: marks[0].start()].strip()] * bool(text[: marks[0].start()].strip()) + out
    return "plain", [b.strip() for b in BLOCK.split(text) if b.strip()]
