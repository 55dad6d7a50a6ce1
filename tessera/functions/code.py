"""Code cut along its structure: Python by its syntax tree, brace languages by a scan for definitions outside of all brackets."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

#: Characters of a chunk (white space not counted) above which a definition is cut at its statements; what a chunk repeats of the one before.
MOST, OVERLAP, LEAST_OVERLAP = 500, 0.2, 50
# Languages by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust"}

_SCRIPT = r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:(?:function\s*\*?|class)\s+(\w+)|(?:const|let|var)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>)"
_DEFINITION = {
    "javascript": re.compile(_SCRIPT),
    "typescript": re.compile(_SCRIPT),
    "go": re.compile(r"(?:func\s+(?:\([^)]*\)\s*)?(\w+)|type\s+(\w+))"),
    "rust": re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern(?:\s+\"[^\"]*\")?)\s+)*(?:(?:fn|struct|enum|trait)\s+(\w+)|impl\b(?:<[^>]*>)?\s*([\w:]+))"),
}
_IMPORT = {"javascript": re.compile(r"import\b"), "typescript": re.compile(r"import\b"), "go": re.compile(r"import\b"), "rust": re.compile(r"(?:pub\s+)?use\b")}
_LEADING = re.compile(r"\s*(?:@|#\[|//|/\*|\*)")
_QUIET = {
    "go": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`", re.S),
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\])*\"|'(?:\\[^']+|[^'\\])'", re.S),
}
_QUIET_SCRIPT = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


@dataclass(frozen=True)
class Definition:
    """A function, class or type at the top of a file: its place in the text and the parts it can be cut at."""

    name: str
    start: int
    end: int
    parts: tuple[tuple[int, int], ...]


def language(path: str) -> str | None:
    m = re.search(r"\.[^./]+$", path.lower())
    return LANGUAGES.get(m.group(0)) if m else None


def size(text: str) -> int:
    """Characters that are no white space."""
    return sum(not c.isspace() for c in text)


def _quiet(text: str, lang: str) -> str:
    """Strings and comments blanked, so that the brackets left are those of the code."""
    return _QUIET.get(lang, _QUIET_SCRIPT).sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), text)


def _statements(quiet: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Runs of whole lines that close every bracket they open."""
    out, depth, start, at = [], 0, None, begin
    while at < end:
        stop = quiet.find("\n", at, end)
        stop = end if stop < 0 else stop
        line = quiet[at:stop]
        if start is None and line.strip():
            start = at
        for c in line:
            depth += (c in "([{") - (c in ")]}")
        if start is not None and depth <= 0:
            out.append((start, stop))
            start, depth = None, 0
        at = stop + 1
    return [*out, (start, end)] if start is not None else out


def _inner(quiet: str, start: int, end: int) -> tuple[tuple[int, int], ...]:
    """A definition's head, the statements of its body, and its end."""
    opened = quiet.find("{", start, end)
    closed = quiet.rfind("}", start, end)
    if opened < 0 or closed <= opened:
        return ((start, end),)
    first = quiet.find("\n", opened, closed)
    if first < 0:
        return ((start, end),)
    last = quiet.rfind("\n", first, closed)
    return ((start, first), *_statements(quiet, first + 1, last), (last + 1, end))


def _braced(text: str, lang: str) -> tuple[list[Definition], list[str]]:
    quiet, found, imports, lead = _quiet(text, lang), [], [], None
    for start, end in _statements(quiet, 0, len(quiet)):
        line = quiet[start:end].lstrip()
        if _IMPORT[lang].match(line):
            imports.append(text[start:end].strip())
            lead = None
        elif m := _DEFINITION[lang].match(line):
            begin = start if lead is None else lead
            found.append(Definition(next((g for g in m.groups() if g), ""), begin, end, ((begin, start), *_inner(quiet, start, end)) if begin < start else _inner(quiet, start, end)))
            lead = None
        else:  # a decorator or attribute belongs to what follows
            lead = (start if lead is None else lead) if _LEADING.match(text[start:end]) else None
    return found, imports


def _python(text: str) -> tuple[list[Definition], list[str]]:
    tree = ast.parse(text)
    at = [0]
    for line in text.split("\n"):
        at.append(at[-1] + len(line) + 1)
    place = lambda a, b: (at[a - 1], min(at[b] - 1, len(text)))
    found, imports = [], []
    for n in tree.body:
        if isinstance(n, ast.Import | ast.ImportFrom):
            imports.append(text[slice(*place(n.lineno, n.end_lineno))].strip())
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            begin = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            starts = [min([c.lineno, *(d.lineno for d in getattr(c, "decorator_list", []))]) for c in n.body]
            cuts = [begin, *(s for s in dict.fromkeys(starts) if s > begin), n.end_lineno + 1]
            found.append(Definition(n.name, *place(begin, n.end_lineno), tuple(place(a, b - 1) for a, b in zip(cuts, cuts[1:], strict=False))))
    return found, imports


def definitions(text: str, lang: str) -> tuple[list[Definition], list[str]]:
    """Definitions at the top of a file and its imports; none where it cannot be read."""
    try:
        return _python(text) if lang == "python" else _braced(text, lang)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return [], []


def cut_large(text: str, d: Definition, most: int = MOST) -> list[str]:
    """A definition in pieces of a size at most, cut only between its parts; a larger part stays whole."""
    whole = text[d.start : d.end]
    if size(whole) <= most:
        return [whole]
    out: list[str] = []
    now = ""
    for a, b in d.parts:
        part = text[a:b].strip("\n")
        longer = f"{now}\n{part}" if now else part
        if now and size(longer) > most:
            out.append(now)
            now = part
        else:
            now = longer
    return [*out, now] if now else out or [whole]


def chunks(text: str, path: str, most: int = MOST) -> list[str]:
    """A chunk for each definition at the top of a file, or for each piece of a large one: what heads the file and its imports, the end
    of the chunk before, then the definition. What stands between definitions and after the last one makes one more chunk. A file
    without definitions, or in another language, is one chunk."""
    lang = language(path)
    found, imports = definitions(text, lang) if lang else ([], [])
    if not found:
        return [text] if text.strip() else []
    known = {x for i in imports for x in i.split("\n")}
    head = "\n".join(x for x in text[: found[0].start].strip().split("\n") if x.strip() not in known).strip()
    context, out, tail = "\n\n".join(x for x in (head, "\n".join(imports)) if x), [], ""
    for d in found:
        pieces = cut_large(text, d, most)
        for k, piece in enumerate(pieces):
            mark = f"# ... split {k + 1}/{len(pieces)} of {d.name} ...\n\n" if len(pieces) > 1 else ""
            body = f"{tail}\n{piece}" if tail else piece
            out.append(f"{context}\n\n{mark}{body}" if context else f"{mark}{body}")
            keep = max(int(size(piece) * OVERLAP), LEAST_OVERLAP)
            tail = piece[-keep:]
    gaps = [text[a.end : b] for a, b in zip(found, [*(d.start for d in found[1:]), len(text)], strict=True)]
    loose = "\n".join(x for g in gaps for x in g.split("\n") if x.strip() and x.strip() not in known)
    if loose.strip():
        out.append(f"{context}\n\n{loose}" if context else loose)
    return out
