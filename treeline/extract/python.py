"""Python sources, by the standard library's parser."""

from __future__ import annotations

import ast
import re

#: Depth below the module at which imports are still looked for.
IMPORT_DEPTH = 4


def extract(text: str) -> dict:
    """Symbols, imports and parse errors (0 or 1) of a module; a text that doesn't parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return {"symbols": [], "imports": [], "errors": 1}
    symbols: list[tuple] = []

    def add(name: str, kind: str, node: ast.AST, exported: bool, doc: str | None) -> None:
        symbols.append((name, kind, node.lineno, node.end_lineno, exported, first_paragraph(doc)))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(node.name, "function", node, not node.name.startswith("_"), ast.get_docstring(node))
        elif isinstance(node, ast.ClassDef):
            public = not node.name.startswith("_")
            add(node.name, "class", node, public, ast.get_docstring(node))
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(inner.name, "method", inner, not inner.name.startswith("_"), ast.get_docstring(inner))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", target.id):
                    add(target.id, "variable", node, True, None)
    imports: list[tuple[str, int]] = []
    level = [(n, 0) for n in tree.body]
    while level:
        node, depth = level.pop(0)
        if isinstance(node, ast.Import):
            imports += [(a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(("." * node.level + (node.module or ""), node.lineno))
        elif depth < IMPORT_DEPTH:
            level += [(n, depth + 1) for n in ast.iter_child_nodes(node)]
    imports.sort(key=lambda x: x[1])
    return {"symbols": symbols, "imports": imports, "errors": 0}


def first_paragraph(doc: str | None) -> str | None:
    """A comment's first paragraph on one line: up to a section heading or tag, 3 to 400 characters."""
    if not doc:
        return None
    lines: list[str] = []
    for raw in doc.strip().splitlines():
        line = re.sub(r"^\s*(?:/\*\*?|\*/|\*|//+|#+)\s?|\s*\*/\s*$", "", raw).strip()
        if (not line and lines) or re.match(r"(?:Args|Arguments|Parameters|Params|Returns?|Raises|Yields|Examples?|Notes?|Attributes)\s*:?\s*$|@\w+|:\w+", line):
            break
        if line:
            lines.append(line)
    text = " ".join(" ".join(lines).split())
    if len(text) < 3:
        return None
    return text if len(text) <= 400 else text[:397] + "..."


def scaffold(text: str, ranges: list[tuple[int, int, int]]) -> str:
    """``text`` with the body of the function or class at each range (start, end, step) replaced by a placeholder that
    names the step: an indented one for a block, one on the same line for a body there.  A docstring stays.

    A range may begin at the decorators.  Of ranges inside each other the outer one counts, of equal ones the first.  What
    isn't understood stays; so does every byte outside the bodies.
    """
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return text
    raw = text.encode()
    begin = [0, 0, *[m.end() for m in re.finditer(rb"\r\n?|\n", raw)]]  # of each line, as the parser counts them
    begin[1] = 3 if raw.startswith(b"\xef\xbb\xbf") else 0  # columns don't count a byte order mark
    at: dict[tuple[int, int], ast.AST] = {}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for top in {node.lineno, *(d.lineno for d in node.decorator_list)}:
                at.setdefault((top, node.end_lineno), node)
    edits: list[tuple[int, int, bytes]] = []
    for start, end, step in ranges:
        node = at.get((start, end))
        rest = node.body[1:] if node is not None and ast.get_docstring(node, clean=False) is not None else node.body if node is not None else []
        if not rest:
            continue
        first = rest[0]
        top = min([(first.lineno, first.col_offset), *((d.lineno, d.col_offset - 1) for d in getattr(first, "decorator_list", []))])
        lo, hi = begin[top[0]] + top[1], begin[rest[-1].end_lineno] + rest[-1].end_col_offset
        if raw[lo : lo + 1] != b"@" and getattr(first, "decorator_list", []):
            lo = raw.rindex(b"@", 0, lo + 1)  # blanks may follow the sign
        edits.append((lo, hi, f'raise NotImplementedError("step {step}")'.encode()))
    out, done = [], 0
    for lo, hi, new in sorted(edits, key=lambda e: (e[0], -e[1])):
        if lo >= done:
            out += [raw[done:lo], new]
            done = hi
    return b"".join([*out, raw[done:]]).decode()
