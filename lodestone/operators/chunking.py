"""Chunkers: windows of lines, Markdown sections, Python definitions, declarations of brace languages.

Each takes a text and gives raw chunks as dicts. They run inside one mapInPandas over files; everything
after them is column expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterable, Iterator

MAX_CHARS, OVERLAP, CAP = 7000, 3, 100
#: Characters of chunks after which a frame of them is given out.
FRAME_CHARS = 8_000_000

FIELDS = ("kind", "line_start", "line_end", "text", "symbol_name", "symbol_kind", "parent_symbol", "signature", "imports", "calls", "references", "decorators", "docstring")
RAW_SCHEMA = "kind string, line_start int, line_end int, text string, symbol_name string, symbol_kind string, parent_symbol string, signature string, imports array<string>, calls array<string>, references array<string>, decorators array<string>, docstring string"


def raw(kind: str, start: int, end: int, text: str, **more) -> dict:
    return {f: None for f in FIELDS} | {"kind": kind, "line_start": start, "line_end": end, "text": text} | more


def _capped(names: Iterable[str]) -> list[str]:
    return sorted(set(names))[:CAP]


def windows(text: str, kind: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """Runs of lines that end with the line that reaches `most` characters; each run begins `overlap` lines before the end of the last, but at least a line further on, so the end of a text is covered by several."""
    lines = text.splitlines()
    upto = [0]
    for line in lines:
        upto.append(upto[-1] + len(line) + 1)
    out, at, to = [], 0, 0
    while at < len(lines):
        to = max(to, at + 1)
        while to < len(lines) and upto[to] - upto[at] < most:
            to += 1
        out.append(raw(kind, at + 1, to, "\n".join(lines[at:to])))
        at = max(at + 1, to - max(0, overlap))
    return out


def split_large(chunks: list[dict], most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """Chunks above `most` characters as windows, with lines counted from the chunk and without its symbol."""
    return [x for c in chunks for x in ([c] if len(c["text"]) <= most else windows(c["text"], c["kind"], most, overlap))]


def markdown(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """A section a heading line; what stands before the first is left out. Without headings: windows."""
    lines = text.splitlines()
    heads = [i for i, line in enumerate(lines) if line[:1] == "#"]
    if not heads:
        return windows(text, "documentation_section", most, overlap)
    out = []
    for a, b in zip(heads, [*heads[1:], len(lines)], strict=True):
        title = lines[a].lstrip("#").strip() or None
        out.append(raw("documentation_section", a + 1, b, "\n".join(lines[a:b]), symbol_name=title, symbol_kind=title and "section"))
    return split_large(out, most, overlap)


def _dotted(node: ast.AST) -> str | None:
    """The dotted name of an expression, through calls; None if it has none."""
    tail: list[str] = []
    while True:
        if isinstance(node, ast.Attribute):
            tail.append(node.attr)
            node = node.value
        elif isinstance(node, ast.Call):
            node = node.func
        else:
            break
    if isinstance(node, ast.Name):
        tail.append(node.id)
    return ".".join(reversed(tail)) or None


def python(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """Classes, functions and methods; bodies of functions are not looked into. A text that does not parse becomes windows."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the last: nested deeper than the parser's stack
        return windows(text, "file", most, overlap)
    lines = text.splitlines()
    imported = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imported += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imported += [f"{node.module or ''}.{a.name}".strip(".") for a in node.names]
    imported = _capped(imported)
    found: list[dict] = []
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(tree, ())]
    while todo:
        node, inside = todo.pop()
        is_class = isinstance(node, ast.ClassDef)
        if is_class or isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            own = list(ast.walk(node))
            word = "class" if is_class else "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
            what = "class" if is_class else "method" if inside else "function"
            names = [n.id for n in own if isinstance(n, ast.Name)] + [d for n in own if isinstance(n, ast.Attribute) and (d := _dotted(n))]
            calls = None if is_class else _capped(d for n in own if isinstance(n, ast.Call) and (d := _dotted(n.func)))
            found.append(
                raw(
                    f"{what}_definition", node.lineno, node.end_lineno or node.lineno, "\n".join(lines[node.lineno - 1 : node.end_lineno]), symbol_name=node.name, symbol_kind=what, parent_symbol=".".join(inside) or None,
                    signature=f"{word} {node.name}", imports=imported, calls=calls, references=_capped(names), decorators=[d for x in node.decorator_list if (d := _dotted(x))], docstring=ast.get_docstring(node),
                )
            )
            if is_class:
                todo += [(n, (*inside, node.name)) for n in reversed(node.body)]
        else:
            todo += [(n, inside) for n in reversed(list(ast.iter_child_nodes(node)))]
    return split_large(found, most, overlap)


#: Words that declare, and those that are neither calls nor references.
DECLARING = "public|private|protected|static|final|async|function|class|interface|type|func|def"
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "function"}
NOT_REFERENCES = {"class", "interface", "function", "return", "if", "else", "for", "while"}
#: Import statements.
IMPORTS = [
    re.compile(r"^\s*import\s+(?:[\w{},*\s]+\s+from\s+)?['\"]?([@\w./-]+)['\"]?", re.M),
    re.compile(r"^\s*from\s+([\w.]+)\s+import\s+", re.M),
    re.compile(r"^\s*using\s+([\w.]+)", re.M),
    re.compile(r"^\s*package\s+([\w.]+)", re.M),
]
_WORD = re.compile(rf"\s*(?:export\s+)?(?:{DECLARING})\s*([A-Za-z_]\w*)\s*(?:[({{=]|extends\b|implements\b)")
_RUN = re.compile(r"\s*(?:export\s+)?(\w[\w<>\[\],\s]*)")
_LAST = re.compile(r"([A-Za-z_]\w*)\s*\Z")
_HEIR = re.compile(r"(\w[\w<>\[\],\s]+\s)([A-Za-z_]\w*)\s+(?:extends|implements)\b")
_CALL = re.compile(r"\b([A-Za-z_][\w.]*)\s*\(")
_NAME = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*\b")
_ANNOTATION = ("@", "#[", "[", "Route(", "Http")


def _declares(line: str) -> tuple[str, str] | None:
    """(declaration, name) of a line that declares something: a declaring word and a name, or a type and a name, before a bracket, brace, equals sign or heritage clause. Linear in the line."""
    m = _WORD.match(line)
    if m:
        return m[0], m[1]
    m = _RUN.match(line)
    if not m:
        return None
    run, after = m[1], line[m.end() : m.end() + 1]
    last = _LAST.search(run) if after and after in "({=" else None
    if last and len(run[: last.start()].rstrip()) >= 2 and run[last.start() - 1 : last.start()].isspace():
        return line[: m.end() + 1], last[1]
    heir = _HEIR.match(run)
    return (line[: m.start(1) + heir.end()], heir[2]) if heir else None


def _block_end(lines: list[str], start: int, last: int) -> int:
    """The line where the braces that open from line `start` on are closed again, else `last`."""
    depth, opened = 0, False
    for n in range(start, min(last, len(lines)) + 1):
        for c in re.findall("[{}]", lines[n - 1]):
            depth += 1 if c == "{" else -1
            opened = opened or c == "{"
            if opened and depth <= 0 and c == "}":
                return n
    return last


def _annotations(lines: list[str], start: int) -> list[str]:
    """Annotation lines right above a declaration, blank lines between them allowed."""
    out: list[str] = []
    for line in reversed(lines[: start - 1]):
        own = line.strip()
        if own.startswith(_ANNOTATION):
            out.insert(0, own)
        elif own:
            break
    return out


def looks_like_test(name: str, text: str) -> bool:
    low = name.lower()
    return low.startswith("test") or low.endswith("test") or "@test" in text.lower() or "describe(" in text or "it(" in text


def declarations(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """A chunk a declaration, up to its closing brace or the next declaration; none if nothing is declared."""
    lines = text.splitlines()
    found = [(n, *d) for n, line in enumerate(lines, 1) if (d := _declares(line))]
    imported = _capped(x for p in IMPORTS for x in p.findall(text)) if found else []
    out = []
    for i, (start, declared, name) in enumerate(found):
        end = _block_end(lines, start, found[i + 1][0] - 1 if i + 1 < len(found) else len(lines))
        body = "\n".join(lines[start - 1 : end])
        is_class = re.search("class|interface|type", declared) is not None
        kind = "test_case" if looks_like_test(name, body) else "class_definition" if is_class else "function_definition"
        calls = _capped(c for c in _CALL.findall(body) if c.split(".")[-1] not in NOT_CALLS)
        out.append(raw(kind, start, end, body, symbol_name=name, symbol_kind="class" if is_class else "function", signature=declared.strip(), imports=imported, calls=calls, references=_capped(set(_NAME.findall(body)) - NOT_REFERENCES), decorators=_annotations(lines, start)))
    return split_large(out, most, overlap)


#: Chunkers by language that take precedence over `declarations`, such as one with a real grammar. Each gives None where it knows nothing.
GRAMMARS: dict[str, Callable[[str], list[dict] | None]] = {}


def chunk_file(language: str, file_class: str, text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[dict]:
    """The chunks of a file by its language and class; windows where its chunker finds none."""
    if language == "python":
        out = python(text, most, overlap)
    elif file_class == "documentation":
        out = markdown(text, most, overlap)
    elif file_class in ("config", "ci_cd", "deployment"):
        out = windows(text, "config_block", most, overlap)
    else:
        own = GRAMMARS[language](text) if language in GRAMMARS else None
        out = declarations(text, most, overlap) if own is None else split_large(own, most, overlap)
    return out or windows(text, "file", most, overlap)


def chunk_partitions(frames: Iterator, keys: list[str], most: int = MAX_CHARS, overlap: int = OVERLAP) -> Iterator:
    """For mapInPandas: frames with keys, language, file_class and content to raw chunks with keys and their place."""
    import pandas as pd

    columns = [*keys, "ordinal", *FIELDS]
    for frame in frames:
        rows: list[dict] = []
        size = 0
        for f in frame.to_dict("records"):
            for i, c in enumerate(chunk_file(f["language"], f["file_class"], f["content"] or "", most, overlap)):
                rows.append({k: f[k] for k in keys} | {"ordinal": i} | c)
                size += len(c["text"])
                if size > FRAME_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)
