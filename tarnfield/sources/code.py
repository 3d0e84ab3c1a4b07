"""Units of source files in nine languages, by scanning declarations; no syntax tree is built.

Comments and strings are blanked first, so what is left can be cut into items at
semicolons, closing braces and, where a language ends statements so, line ends. The head of
an item tells what it is. A type is a unit as a whole and its methods are units besides;
comments right above an item belong to it. Lines of no unit form groups: ``<module>`` where
they are imports alone or nothing else is in the file, else ``<top-level>``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

_STRINGS = {
    "rust": r'r(#*)".*?"\1|"(?:\\.|[^"\\])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', "go": r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.[^\']*|[^\'\\\n])\'', "java": r'"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.[^\']*|[^\'\\\n])\'',
    "kotlin": r'""".*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.[^\']*|[^\'\\\n])\'', "javascript": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', "c": r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
}
_STRINGS |= {"typescript": _STRINGS["javascript"], "cpp": _STRINGS["c"]}
#: Languages whose statements may end with the line.
_BY_LINE = ("go", "kotlin", "javascript", "typescript")
_OPEN, _CLOSE = "([{", ")]}"
_CONTINUES = re.compile(r"(?:[-+*/%=&|^<>,.?:(\[{]|\b(?:extends|implements|where|by|in|is|as))$")
_GOES_ON = re.compile(r"[.?:)\]}{=&|+*/,]|(?:where|extends|implements|else|catch|finally)\b")


def blanked(text: str, lang: str) -> str:
    """The text with comments and strings (and directives of C) as spaces; line ends stay."""
    directive = r"^[ \t]*\#(?:\\\n|[^\n])*|" if lang in ("c", "cpp") else ""
    pattern = re.compile(rf"{directive}//[^\n]*|/\*.*?(?:\*/|\Z)|" + _STRINGS[lang], re.S | re.M)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


@dataclass
class Item:
    """A piece of a body: offsets, its head (up to a brace that opens its body) and the body's range."""

    start: int
    end: int
    head: str
    body: tuple[int, int] | None


def items(text: str, at: int, end: int, lang: str) -> Iterator[Item]:
    """Items between two offsets of a blanked text."""
    by_line = lang in _BY_LINE
    while at < end:
        while at < end and (text[at].isspace() or text[at] in ";,)]}"):
            at += 1
        if at >= end:
            return
        start, depth, body, k = at, 0, None, at
        while k < end:
            c = text[k]
            if c in _OPEN:
                if c == "{" and depth == 0 and body is None:
                    body = (k + 1, end)
                depth += 1
            elif c in _CLOSE:
                depth -= 1
                if depth == 0 and c == "}" and body is not None and body[1] == end:
                    body = (body[0], k)
                    rest = re.match(r"[ \t]*([^\n]?)", text[k + 1 : end])
                    # an initialiser goes on; what follows a C type's brace up to the semicolon belongs to it
                    if "=" in text[start : body[0] - 1].replace("=>", "").replace("==", "") and rest[1] not in ("", "}") or lang in ("c", "cpp") and re.match(r"\s*(?:typedef\s+)?(?:struct|union|enum|class)\b", text[start : body[0]]) or rest[1] in (";", ",", ".", "("):
                        k += 1
                        continue
                    k += 1
                    break
            elif c == ";" and depth == 0:
                k += 1
                break
            elif c == "\n" and by_line and depth == 0:
                line, following = text[start:k].rstrip(), text[k:end].lstrip()
                if line and not _CONTINUES.search(line) and not _GOES_ON.match(following) and not re.fullmatch(r"(?:@[\w.]+(?:\([^)]*\))?\s*)+", line):
                    break
            k += 1
        if body is not None and body[1] == end and depth:
            body = (body[0], k)
        yield Item(start, k, text[start : body[0] - 1] if body else text[start:k].rstrip("; \n"), body)
        at = max(k, at + 1)


@dataclass
class Found:
    """What an item is: the last part of its symbol, whether it is only an import, and how its body is read (None: not at all)."""

    name: str | None
    imports: bool = False
    inside: str | None = None
    #: The whole symbol where it doesn't follow from the path.
    symbol: str | None = None


_WORD = r"[A-Za-z_$\u0080-\uffff][\w$]*"
_NO_CALL = ("if", "for", "while", "switch", "catch", "return", "new", "else", "do", "try", "synchronized", "throw", "when", "match", "sizeof", "defined", "function", "await", "super", "this")


def _rust(head: str, item: Item, where: str) -> Found | None:
    bare = re.sub(r"#!?\[[^\]]*\]\s*", "", head)
    m = re.match(rf"(?:pub(?:\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s+)?)\s+)*(fn|struct|enum|union|trait|type|mod|impl)\b\s*(<[^{{]*?>\s*(?=[A-Z])|)({_WORD})?", bare)
    if mac := re.match(rf"macro_rules!\s*({_WORD})", bare):
        return Found(f"{mac[1]}!")
    if not m:
        return Found(None, bool(re.match(r"(?:pub(?:\([^)]*\))?\s+)?(?:use|extern\s+crate)\b", bare)))
    if m[1] == "impl":
        rest = re.sub(r"\bwhere\b.*", "", bare[m.end(1) :], flags=re.S).strip()
        if rest.startswith("<"):
            depth = 0
            for k, c in enumerate(rest):
                depth += (c == "<") - (c == ">" and rest[k - 1] != "-")
                if not depth:
                    rest = rest[k + 1 :].strip()
                    break
        return Found(None, inside="impl", symbol=re.split(r"\s+for\s+", rest)[0].strip())
    if where == "impl":
        return Found(m[3]) if m[1] == "fn" else Found(None)
    if m[1] == "mod":
        return Found(None, inside="mod", symbol=m[3]) if item.body else Found(None, True)
    return Found(m[3]) if m[3] else None


def _go(head: str, item: Item, where: str) -> Found | None:
    if m := re.match(rf"func\s*\(\s*(?:{_WORD}\s+)?([^)]+?)\s*\)\s*({_WORD})", head):
        return Found(None, symbol=f"({m[1]}).{m[2]}")
    if m := re.match(rf"(?:func|type)\s+({_WORD})", head):
        return Found(m[1])
    return Found(None, bool(re.match(r"(?:import|package)\b", head)))


def _annotated(head: str) -> str:
    return re.sub(r"^(?:@(?!interface\b)[\w.]+(?:\((?:[^()]|\([^()]*\))*\))?\s*)+", "", head)


def _java(head: str, item: Item, where: str) -> Found | None:
    bare = _annotated(head)
    if m := re.search(rf"(?:^|\s)(class|interface|record|enum|@interface)\s+({_WORD})", bare):
        return Found(m[2], inside="type" if m[1] in ("class", "interface", "record") else None)
    if where == "type":
        m = re.search(rf"({_WORD})\s*\((?:[^()]|\([^()]*\))*\)\s*(?:throws\s+[\w.,\s]+)?(?:default\s+.*)?$", bare)
        if m and m[1] not in _NO_CALL and "=" not in bare[: m.start()]:
            return Found(m[1])
        if item.body and (m := re.fullmatch(rf"(?:public|protected|private)?\s*({_WORD})\s*", bare)) and m[1] != "static":
            return Found(m[1])
        return None
    return Found(None, bool(re.match(r"(?:import|package)\b", bare)))


def _kotlin(head: str, item: Item, where: str) -> Found | None:
    bare = _annotated(head)
    if m := re.search(rf"\bcompanion\s+object\b\s*({_WORD})?", bare):
        return Found(m[1] or "Companion", inside="type")
    if m := re.match(rf"(?:[a-z]+\s+)*?(enum\s+class|class|interface|object)\s+({_WORD})", bare):
        return Found(m[2], inside=None if m[1].startswith("enum") else "type")
    if m := re.match(rf"(?:[a-z]+\s+)*?fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?({_WORD})\s*\(", bare):
        return Found(m[1])
    if where == "type" and re.match(r"(?:[a-z]+\s+)?constructor\s*\(", bare):
        return Found("", symbol="constructor")
    return Found(None, bool(re.match(r"(?:import|package)\b", bare)))


def _script(head: str, item: Item, where: str) -> Found | None:
    bare = _annotated(head)
    if where == "type":
        m = re.match(rf"(?:(?:public|private|protected|static|async|get|set|override|readonly|abstract|declare)\s+)*\*?\s*(#?{_WORD}|\[[^\]]*\])\s*(?:<[^(]*>)?\s*\(", bare)
        return Found(m[1]) if m and item.body and m[1] not in _NO_CALL else None
    m = re.match(rf"(export\s+)?(default\s+)?(?:(?:declare|abstract|async|const)\s+)*(function|class|interface|type|enum)\b\s*\*?\s*(?!extends\b)({_WORD})?", bare)
    if m and (m[4] or m[2]) and (m[3] != "type" or "=" in text_of(bare, item)):
        return Found(m[4] or "default", inside="type" if m[3] == "class" else None)
    return Found(None, bool(re.match(r"import\b|export\s*(?:\*|$)", bare)))


def text_of(head: str, item: Item) -> str:
    return head + ("=" if item.body else "")


def _c(head: str, item: Item, where: str) -> Found | None:
    if m := re.match(rf"\s*typedef\s+(?:struct|enum|union)\b\s*({_WORD})?", head):
        return Found(None, symbol="typedef") if item.body else Found(None)
    if (m := re.match(rf"\s*(?:static\s+|const\s+)*(?:struct|enum|union)\s+({_WORD})\s*$", head)) and item.body:
        return Found(m[1])
    m = re.search(rf"({_WORD})\s*\((?:[^()]|\([^()]*\))*\)\s*$", head)
    return Found(m[1]) if m and item.body and m[1] not in _NO_CALL else Found(None)


def _cpp(head: str, item: Item, where: str) -> Found | None:
    bare = re.sub(r"^(?:(?:public|private|protected)\s*:\s*)+", "", head)
    while re.match(r"\s*template\s*<", bare):
        depth, k = 0, bare.index("<")
        for k in range(k, len(bare)):
            depth += (bare[k] == "<") - (bare[k] == ">")
            if not depth:
                break
        bare = bare[k + 1 :].lstrip()
    if m := re.match(rf"(?:inline\s+)?namespace\b\s*((?:{_WORD})(?:::{_WORD})*)?\s*$", bare):
        return Found(None, inside="namespace", symbol=m[1] or "<anonymous>")
    if re.match(r"extern\s*$", bare) and item.body:
        return Found(None, inside="same")
    if (m := re.match(rf"(class|struct|enum(?:\s+class|\s+struct)?|union)\s+(?:\[\[[^\]]*\]\]\s*)?({_WORD}(?:<[^{{:]*>)?)", bare)) and item.body:
        return Found(m[2], inside="type" if m[1] in ("class", "struct") else None)
    if m := re.match(rf"concept\s+({_WORD})", bare):
        return Found(m[1])
    m = re.search(rf"((?:{_WORD}(?:<[^<>()]*>)?::)*(?:~?{_WORD}|operator\s*[^\s(]+))\s*\((?:[^()]|\([^()]*\))*\)\s*(?:const|noexcept|override|final|&|&&|->\s*[\w:<>*&\s]+|\s)*(?::\s*[^{{}}]*)?$", bare)
    return Found(m[1].replace(" ", "")) if m and item.body and m[1].split("::")[-1] not in _NO_CALL else Found(None)


_HEADS = {"rust": _rust, "go": _go, "java": _java, "kotlin": _kotlin, "javascript": _script, "typescript": _script, "c": _c, "cpp": _cpp}


def module_path(path: str, lang: str) -> str:
    """What a symbol begins with: a dotted module for Python, the path without extension for scripts."""
    if lang == "python":
        rest = re.sub(r"^crates/[^/]*/src/|^(?!crates/)(?:src|lib)/", "", path)
        rest = re.sub(r"\.pyi?$", "", rest)
        return re.sub(r"(?:^|/)__init__$", "", rest).replace("/", ".")
    if lang in ("javascript", "typescript"):
        return re.sub(r"\.(?:[mc]?ts|tsx|[mc]?js|jsx)$", "", path)
    return ""


def _prefix(text: str, lang: str, path: str) -> str:
    if lang in ("go", "java", "kotlin"):
        m = re.search(r"^\s*package\s+([\w.]+)", text, re.M)
        return m[1] if m else "<unknown>" if lang == "go" else ""
    return module_path(path, lang)


def code_units(text: str, lang: str, path: str = "") -> list[dict]:
    """symbol, text, start, end (1-based lines) of a file's units and of what is left, in order; none for other languages."""
    if lang == "python":
        return python_units(text, path)
    if lang not in _HEADS:
        return []
    plain, lines, head_of = blanked(text, lang), text.split("\n"), _HEADS[lang]
    blank, prefix, glue = plain.split("\n"), _prefix(plain, lang, path), "::" if lang in ("rust", "cpp") else "."
    found: list[tuple[str, int, int]] = []
    imports: set[int] = set()
    row = lambda at: text.count("\n", 0, at) + 1

    def add(path_: list[str], name: str, item: Item) -> None:
        first = row(item.start)
        while first > 1 and not blank[first - 2].strip() and lines[first - 2].strip() and not lines[first - 2].lstrip().startswith("#"):
            first -= 1
        found.append((glue.join([*([prefix] if prefix else []), *path_, name]), first, row(item.end - 1)))

    def walk(at: int, end: int, path_: list[str], where: str) -> None:
        for item in items(plain, at, end, lang):
            got = head_of(item.head.strip(), item, where)
            if got is None:
                continue
            if got.imports:
                imports.update(range(row(item.start), row(item.end - 1) + 1))
            if lang == "go" and item.head.strip() in ("type", "type (") or lang == "go" and re.match(r"type\s*\($", item.head.strip()):
                continue
            if got.inside in ("impl", "mod", "namespace"):
                walk(*item.body, [*path_, *got.symbol.split("::")] if got.inside == "namespace" else [*path_, got.symbol], got.inside if got.inside == "impl" else "")
            elif got.inside == "same":
                walk(*item.body, path_, where)
            elif got.symbol == "typedef":
                if m := re.search(rf"({_WORD})\s*;?\s*$", plain[item.body[1] + 1 : item.end]):
                    add(path_, m[1], item)
            elif got.symbol == "constructor":
                add(path_, path_[-1] if path_ else "constructor", item)
            elif got.symbol:
                add(path_, got.symbol, item)
            elif got.name:
                add(path_, got.name, item)
                if got.inside and item.body:
                    walk(*item.body, [*path_, got.name], got.inside)

    walk(0, len(plain), [], "")
    if lang == "go":  # type ( A …; B … ): a unit for each
        for m in re.finditer(r"^type\s*\(", plain, re.M):
            depth, k = 0, m.end() - 1
            for k in range(m.end() - 1, len(plain)):
                depth += (plain[k] in _OPEN) - (plain[k] in _CLOSE)
                if not depth:
                    break
            for item in items(plain, m.end(), k, lang):
                if name := re.match(_WORD, item.head):
                    add([], name[0], item)
    return _with_rest(found, lines, imports)


def _with_rest(found: list[tuple[str, int, int]], lines: list[str], imports: set[int]) -> list[dict]:
    taken = {k for _, a, b in found for k in range(a, b + 1)}
    out = [{"symbol": s, "text": "\n".join(lines[a - 1 : b]), "start": a, "end": b} for s, a, b in found]
    run: list[int] = []
    for k in range(1, len(lines) + 2):
        if k <= len(lines) and k not in taken:
            run.append(k)
            continue
        own = [i for i in run if lines[i - 1].strip()]
        if own:
            name = "<module>" if not found or all(i in imports or not lines[i - 1].strip() for i in own) else "<top-level>"
            out.append({"symbol": name, "text": "\n".join(lines[own[0] - 1 : own[-1]]), "start": own[0], "end": own[-1]})
        run = []
    return sorted(out, key=lambda u: (u["start"], -u["end"]))


def python_units(text: str, path: str = "") -> list[dict]:
    """Functions, classes and methods of a Python file, decorators and comments above included, and what is left as ``<module>``; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines, found, prefix = text.split("\n"), [], module_path(path, "python")

    def visit(body: list, above: str) -> None:
        for node in body:
            if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            while first > 1 and lines[first - 2].strip().startswith("#"):
                first -= 1
            name = f"{above}.{node.name}" if above else node.name
            found.append((name, first, node.end_lineno))
            if isinstance(node, ast.ClassDef):
                visit(node.body, name)

    visit(tree.body, prefix)
    return [u | {"symbol": "<module>" if u["symbol"] == "<top-level>" else u["symbol"]} for u in _with_rest(found, lines, set())]
