"""Python source into its module, classes and functions."""

from __future__ import annotations

import ast
import textwrap

from treegrain.operators.outline import Row, Rows

_QUOTES = ('"""', "'''")


def _header(lines: list[str]) -> str:
    """The module's leading documentation or comment lines; else the lines up to its first own statement."""
    top = []
    for line in lines[:5]:
        if line.strip().startswith((*_QUOTES, "#")):
            top.append(line)
        elif line.strip():
            break
    if text := "\n".join(top).strip():
        return text
    for n, line in enumerate(lines[:30], 1):
        if line.strip() and not line.strip().startswith(("#", "import ", "from ", *_QUOTES, '"', "'")):
            return "\n".join(lines[:n]).strip()
    return "\n".join(lines[:30]).strip()


def _signature(node: ast.stmt, lines: list[str]) -> str:
    """The definition up to the line that ends with a colon, at most nine lines."""
    taken = []
    for line in lines[node.lineno - 1 : min(node.lineno + 8, node.end_lineno)]:
        taken.append(line.rstrip())
        if taken[-1].endswith(":"):
            break
    return textwrap.dedent("\n".join(taken)).strip()


def _describe(node: ast.stmt, path: str, lines: list[str], include_source: bool) -> str:
    doc = ast.get_docstring(node) or ""
    parts = [path, _signature(node, lines)]
    if doc:
        parts.append(doc[:400].strip())
    elif include_source:
        body = textwrap.dedent("\n".join(lines[node.lineno : min(node.lineno + 8, node.end_lineno)])).strip()
        if body[:1] not in ('"', "'"):
            parts.append(body[:300])
    return "\n\n".join(p for p in parts if p.strip())


def python_rows(source: str, module: str, file: str, *, include_source: bool = True, max_depth: int = 2) -> list[Row]:
    """Module row, then classes and functions down to max_depth; classes are entered at any depth, functions never. A syntax error gives one row that says so."""
    rows = Rows()
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError) as e:
        kind = "SyntaxError" if isinstance(e, SyntaxError) else type(e).__name__
        rows.put(module, 0, [f"[{kind}: {e}]"], file)
        return rows
    lines = (source or "").splitlines()
    header = _header(lines)
    rows.put(module, 0, [module, "", header] if header else [module], file, 1, len(lines))
    work = [(c, module, 0) for c in reversed(list(ast.iter_child_nodes(tree)))]
    while work:
        node, above, depth = work.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            path, depth = f"{above}.{node.name}", depth + 1
            if depth <= max_depth:
                rows.put(path, depth, [_describe(node, path, lines, include_source)], file, node.lineno, node.end_lineno)
            if not isinstance(node, ast.ClassDef):
                continue
            above = path
        work += [(c, above, depth) for c in reversed(list(ast.iter_child_nodes(node)))]
    return rows
