"""A hand-written scanner for Kotlin, Java and Swift sources: declarations, imports, supertypes, calls.

It blanks out comments and literals, keeps their positions, parses the tokens to a tree of declarations and
calls, and reads the relations off the tree. Columns are UTF-16 units from 0, as editors count them; lines count from 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .syntax import Node, Parser

_LITERAL = re.compile(
    r'(?P<block>/\*.*?(?:\*/|\Z))|(?P<line>//[^\n]*)|(?P<raw>""".*?(?:"""|\Z))|(?P<text>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))|(?P<char>\'(?:\\.[^\'\n]*|[^\'\\\n])\')',
    re.S,
)
_TOKEN = re.compile(r"`[^`\n]+`|[^\W\d]\w*|\d[\w.]*|->|::|\?\.|[^\s\w]")
_WORD = re.compile(r"[^\W\d]\w*")

#: Reserved words of the three languages; none of them is ever called or resolved.
KEYWORDS = frozenset(
    "abstract as assert associatedtype async await boolean break byte case catch char class companion const constructor continue "
    "default defer deinit do double dynamic else enum extends extension external false final finally float for fun func guard if implements import in "
    "init inline instanceof int interface internal is lateinit let long native new nil null object out override package private "
    "protected protocol public return sealed self short static strictfp struct subscript super suspend switch synchronized tailrec this "
    "throw throws transient true try typealias val var vararg void volatile weak when where while yield".split()
)
_DECLARES = re.compile(r"\s*(?:[a-z]+ +)*(?:fun|func|class|interface|object|typealias) ")
_VISIBILITY = re.compile(r"\b(private|protected|internal|public|fileprivate|open)\b")
_DEFAULT = {"kotlin": "public", "java": "internal", "swift": "internal"}


def language_of(path: str) -> str:
    return "java" if path.endswith(".java") else "swift" if path.endswith(".swift") else "kotlin"


def utf16(text: str) -> int:
    return len(text) + sum(c > "\uffff" for c in text)


def blanked(source: str) -> tuple[str, str | None]:
    """The source with comments and literals as spaces, and what is left open at its end, if anything."""
    left_open = None

    def blank(found):
        nonlocal left_open
        part = found[0]
        if found["block"] and not (part.endswith("*/") and len(part) > 3):
            left_open = "comment"
        elif found["raw"] and not (part.endswith('"""') and len(part) > 5):
            left_open = "string"
        elif found["text"] and not (part.endswith('"') and len(part) > 1):
            left_open = left_open or "string"
        mark = '"' if found["raw"] or found["text"] else ""
        return mark + re.sub(r"[^\n]", " ", part[len(mark) :])

    return _LITERAL.sub(blank, source), left_open


def split_top(text: str, separator: str = ",") -> list[str]:
    """Parts between separators outside all brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        if c in "(<[{":
            depth += 1
        elif c in ")]}" or c == ">" and text[i - 1 : i] != "-":
            depth -= 1
        elif c == separator and depth == 0:
            out.append(text[start:i])
            start = i + 1
    out.append(text[start:])
    return [p.strip() for p in out if p.strip()]


def parameters(detail: str, language: str) -> list[dict]:
    """(name, type) of a signature's parameters; default values are dropped."""
    at = detail.find("(")
    if at < 0:
        return []
    depth = 0
    for end in range(at, len(detail)):
        depth += (detail[end] == "(") - (detail[end] == ")")
        if not depth:
            break
    out = []
    for part in split_top(detail[at + 1 : end]):
        part = split_top(part, "=")[0] if "=" in part else part
        part = re.sub(r"@\w+(\([^)]*\))?\s*", "", part)
        if language == "java":
            words = re.sub(r"\b(final)\b", "", part).split()
            if len(words) > 1:
                out.append({"name": words[-1], "type": " ".join(words[:-1])})
        elif ":" in part:
            name, kind = part.split(":", 1)
            out.append({"name": name.split()[-1] if name.split() else "", "type": kind.strip()})
    return out


def return_type(detail: str, language: str) -> str | None:
    """The type after the parameters; Java's stands before the name."""
    if language == "java":
        found = re.match(r"^(?:@\w+(?:\([^)]*\))?\s+|(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+)*(?:<[^>]*>\s*)?([\w.<>,\[\]? ]+?)\s+\w+\s*\(", detail)
        return found[1].strip() if found else None
    detail = re.split(r"\bwhere\b", detail, maxsplit=1)[0]
    depth, last = 0, None
    mark = "->" if language == "swift" else ":"
    for i, c in enumerate(detail):
        if c in "(<[":
            depth += 1
        elif c in ")]" or c == ">" and detail[i - 1] != "-":
            depth -= 1
        elif depth == 0 and detail.startswith(mark, i):
            last = i
        elif depth == 0 and c in "{=":
            break
    if last is None:
        return None
    kind = re.split(r"[{=]", detail[last + len(mark) :], maxsplit=1)[0].strip()
    return kind or None


@dataclass
class _Scope:
    kind: str
    name: str
    symbol: int | None = None
    locals: dict = field(default_factory=dict)


class Scan:
    """One file's relations."""

    def __init__(self, path: str, source: str):
        self.path, self.language = path, language_of(path)
        self.lines = source.split("\n")
        self.clean, left_open = blanked(source)
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.symbols: list[dict] = []
        self.imports: list[dict] = []
        self.supers: list[dict] = []
        self.calls: list[dict] = []
        self.annotations: list[dict] = []
        self.types: list[dict] = []
        self.errors: list[dict] = []
        self.bodies: list[tuple[str, int, int]] = []
        self.called: set[int] = set()
        self.package: str | None = None
        self._header()
        self._walk()
        if left_open:
            self.errors.append({"line": len(self.lines) - 1, "col": 0, "message": f"unterminated {left_open}"})

    def place(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.starts, offset) - 1
        return line, utf16(self.lines[line][: offset - self.starts[line]])

    def _header(self) -> None:
        for i, line in enumerate(self.clean.split("\n")):
            if self.package is None and (found := re.match(r"\s*package\s+([\w.]+)", line)):
                self.package = found[1]
            elif found := re.match(r"\s*(?:@testable\s+)?import\s+(?:static\s+)?(?:class\s+|struct\s+|func\s+)?([\w.]+?)(\.\*)?(?:\s+as\s+(\w+))?\s*;?\s*$", line):
                path, star, alias = found.groups()
                local = "*" if star else alias or path.rsplit(".", 1)[-1]
                self.imports.append({"seq": len(self.imports), "line": i, "full_path": path, "local_name": local, "is_star": bool(star)})

    def _detail(self, start: int) -> str:
        """The declaration's text up to its body, on one line."""
        depth, end = 0, len(self.clean)
        begin = max(self.clean.rfind(c, 0, start) for c in "\n{;}") + 1
        for i in range(start, len(self.clean)):
            c = self.clean[i]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif depth > 0 and (c == "\n" and _DECLARES.match(self.clean, i + 1) or c == "{" and re.search(r"[(,]\s*$", self.clean[max(start, i - 40) : i])):
                end = i  # a bracket that is never closed
                break
            elif depth <= 0 and (c in "{;}" or c == "\n" and not re.match(r"\s*[:{.]|\s*(?:where|throws|extends|implements)\b", self.clean[i + 1 : i + 80])):
                end = i
                break
        return " ".join("".join(self.lines_text(begin, end)).split()).rstrip(" =")

    def lines_text(self, begin: int, end: int) -> str:
        return "\n".join(self.lines)[begin:end]

    def _documentation(self, line: int) -> str | None:
        """The doc comment that ends right above a declaration; annotations may stand between."""
        i = line - 1
        while i >= 0 and self.lines[i].strip().startswith("@"):
            i -= 1
        if i >= 0 and self.language == "swift" and self.lines[i].strip().startswith("///"):
            out = []
            while i >= 0 and self.lines[i].strip().startswith("///"):
                out.append(self.lines[i].strip()[3:].strip())
                i -= 1
            return "\n".join(reversed(out))
        if i < 0 or not self.lines[i].strip().endswith("*/"):
            return None
        end = i
        while i >= 0 and "/**" not in self.lines[i]:
            if "/*" in self.lines[i]:
                return None
            i -= 1
        if i < 0:
            return None
        body = [re.sub(r"^\s*/?\*+/?\s?|\s*\*+/\s*$", "", x).strip() for x in self.lines[i : end + 1]]
        return "\n".join(x for x in body if x) or None

    def _deprecated(self, line: int) -> bool:
        for i in range(line, max(-1, line - 6), -1):
            text = self.lines[i].strip()
            if i < line and text and not text.startswith(("@", "*", "/")):
                return False
            if re.search(r"@Deprecated\b|@available\([^)]*deprecated", text):
                return True
        return False

    def _symbol(self, name: str, kind: str, at: int, owner: list[_Scope]) -> dict:
        line, col = self.place(at)
        detail = self._detail(at)
        head = detail.split(name, 1)[0]
        seen = _VISIBILITY.search(head)
        visibility = seen[1] if seen else _DEFAULT[self.language]
        outer = next((s for s in owner if s.kind == "type"), None)
        inner = next((s for s in reversed(owner) if s.kind == "type"), None)
        generic = re.search(rf"\b{re.escape(name)}\s*<([^()]*?)>|\bfun\s*<([^()]*?)>", detail)
        receiver = re.search(r"\bfun\s+(?:<[^>]*>\s*)?([\w.]+)(?:<[^()]*>)?\??\.\s*" + re.escape(name) + r"\s*\(", detail) if self.language == "kotlin" else None
        callable_ = kind in ("function", "method", "constructor")
        typed = re.search(rf"\b{re.escape(name)}\s*:\s*([\w.<>, ?\[\]]+)", detail) if kind == "property" else None
        symbol = {
            "ordinal": len(self.symbols), "name": name, "kind": kind, "visibility": {"open": "public", "fileprivate": "private"}.get(visibility, visibility),
            "start_line": line, "start_col": 0, "end_line": line, "end_col": col + utf16(name), "sel_line": line, "sel_col": col, "sel_end_col": col + utf16(name),
            "detail": detail, "type_params": [x.split(":")[0].strip() for x in split_top((generic[1] or generic[2]) if generic else "")],
            "extension_receiver": receiver[1] if receiver else None, "deprecated": self._deprecated(line),
            "parent_fq_name": ".".join(x for x in (self.package, outer.name) if x) if outer else None, "owner": inner.name if inner else None,
            "return_type": return_type(detail, self.language) if callable_ and kind != "constructor" else re.split(r"\s+(?:get|set|by)\b", typed[1].strip())[0] if typed else None,
            "parameters": parameters(detail, self.language) if callable_ or kind in ("class", "struct") else [],
            "documentation": self._documentation(line), "is_sealed": bool(re.search(r"\bsealed\b", head)), "is_typealias": kind == "typealias",
        }
        self.symbols.append(symbol)
        for i in range(line, max(-1, line - 6), -1):
            text = self.lines[i].strip()
            if i < line and not text.startswith("@"):
                break
            for annotation in re.findall(r"@(\w+)", text.split("(")[0] if i < line else head):
                if annotation != "interface":
                    self.annotations.append({"symbol_name": name, "annotation": annotation})
        return symbol

    def _supers(self, name: str, at: int, line: int) -> None:
        detail = self._detail(at)
        rest = detail.split(name, 1)[1] if name in detail else ""
        if self.language == "java":
            for word, kind in (("extends", "extends"), ("implements", "implements")):
                found = re.search(rf"\b{word}\b(.*?)(?:\b(?:extends|implements|permits)\b|$)", rest)
                parts = split_top(found[1]) if found else []
                self.supers += [self._super(name, p, kind, line) for p in parts]
            return
        depth = 0
        for i, c in enumerate(rest):
            if c in "(<[":
                depth += 1
            elif c in ")]" or c == ">" and rest[i - 1] != "-":
                depth -= 1
            elif c == ":" and depth == 0:
                listed = re.split(r"\bwhere\b", rest[i + 1 :])[0]
                self.supers += [self._super(name, p, "extends", line) for p in split_top(listed) if _WORD.match(p)]
                return

    @staticmethod
    def _super(name: str, text: str, kind: str, line: int) -> dict:
        bare = re.split(r"[<({\s]", text.strip(), maxsplit=1)[0]
        generic = re.search(r"<(.*)>", text)
        return {"line": line, "sub_name": name, "super_name": bare.rsplit(".", 1)[-1], "type_args": split_top(generic[1]) if generic else [], "super_kind": kind}

    def _walk(self) -> None:
        tokens = [(m[0], m.start()) for m in _TOKEN.finditer(self.clean)]
        parser = Parser(tokens, self.language, KEYWORDS, self.place)
        self._visit(parser.parse(), tokens, [])
        self._braces(tokens)
        for i, message in parser.errors:
            line, col = self.place(tokens[i][1])
            self.errors.append({"line": line, "col": col, "message": message})

    def _braces(self, tokens) -> None:
        """Braces that close nothing, or are never closed."""
        open_: list[int] = []
        for word, at in tokens:
            if word == "{":
                open_.append(at)
            elif word == "}" and open_:
                open_.pop()
            elif word == "}":
                self._error(at, "unexpected }")
        for at in open_:
            self._error(at, "unclosed {")

    def _error(self, at: int, message: str) -> None:
        line, col = self.place(at)
        self.errors.append({"line": line, "col": col, "message": message})

    def _visit(self, nodes: list[Node], tokens, scopes: list[_Scope]) -> None:
        """Symbols, supertypes, facts and calls of a tree's nodes, in the order of the source."""
        for node in nodes:
            if node.kind == "call":
                self.called.add(tokens[node.at][1])
                self._call(tokens, node.at, scopes)
            elif node.kind == "block":
                self._visit(node.kids, tokens, scopes)
            elif node.kind == "type":
                self._type(node, tokens, scopes)
            elif node.kind in ("function", "constructor"):
                self._function(node, tokens, scopes)
            elif node.kind == "property":
                self._property(node, tokens, scopes)
                self._visit(node.kids, tokens, scopes)
            elif node.kind == "typealias":
                self._symbol(tokens[node.at][0], "typealias", tokens[node.at][1], scopes)
            elif node.kind == "entry":
                entry = self._symbol(tokens[node.at][0].strip("`"), "enum_member", tokens[node.at][1], scopes)
                last, end = tokens[node.names[1] - 1]
                entry["detail"] = " ".join(self.lines_text(tokens[node.at][1], end + len(last)).split())
                self._visit(node.kids, tokens, scopes)
                self._end(node, tokens, entry)

    def _end(self, node: Node, tokens, symbol: dict | None) -> None:
        if symbol is not None and node.body is not None and node.body[1] > node.body[0]:
            word, at = tokens[node.body[1]]
            line, col = self.place(at)
            symbol["end_line"], symbol["end_col"] = line, col + utf16(word)

    def _type(self, node: Node, tokens, scopes: list[_Scope]) -> None:
        name, offset = tokens[node.names[0]]
        name = name.strip("`")
        symbol = None if node.word == "extension" else self._symbol(name, node.label, offset, scopes)
        self._supers(name, offset, self.place(offset)[0])
        scope = _Scope("type", name, symbol["ordinal"] if symbol else None)
        if symbol and self.language == "kotlin" and "data" in symbol["detail"].split(name)[0].split():
            copy = dict(symbol, ordinal=len(self.symbols), name="copy", kind="method", detail=f"fun copy({', '.join(f'{p["name"]}: {p["type"]}' for p in symbol['parameters'])}): {name}", return_type=name, owner=name, documentation=None)
            self.symbols.append(copy)
        for at, begin in node.properties:
            self._parameter_property(tokens[at][0].strip("`"), tokens[at][1], tokens[begin][1], symbol, [*scopes, scope])
        self._visit(node.kids, tokens, [*scopes, scope])
        self._end(node, tokens, symbol)

    def _parameter_property(self, name: str, offset: int, begin: int, owner: dict, scopes: list[_Scope]) -> None:
        """A property that a primary constructor declares: its signature is the parameter alone."""
        kind = next((p["type"] for p in parameters(owner["detail"], self.language) if p["name"] == name), None)
        head = " ".join(re.sub(r"@\w+(\([^)]*\))?", "", self.clean[begin:offset]).split())
        before = len(self.annotations)
        symbol = self._symbol(name, "property", offset, scopes)
        symbol.update(detail=f"{head} {name}" + (f": {kind}" if kind else ""), return_type=kind, documentation=None, deprecated=False, type_params=[], is_sealed=False)
        seen = _VISIBILITY.search(head)
        symbol["visibility"] = {"open": "public"}.get(seen[1], seen[1]) if seen else "public"
        # the class's annotations are not the parameter's
        self.annotations[before:] = [{"symbol_name": name, "annotation": a} for a in re.findall(r"@(\w+)", self.clean[begin:offset])]

    def _function(self, node: Node, tokens, scopes: list[_Scope]) -> None:
        owner = next((s for s in reversed(scopes) if s.kind == "type"), None)
        word, offset = tokens[node.names[0]]
        if node.kind == "constructor":
            symbol = self._symbol("init" if word == "init" else owner.name, "constructor", offset, scopes)
        else:
            symbol = self._symbol(word.strip("`"), "method" if owner else "function", offset, scopes)
        scope = _Scope("function", symbol["name"], symbol["ordinal"], {p["name"]: p["type"] for p in symbol["parameters"]})
        self._visit(node.kids, tokens, [*scopes, scope])
        self._end(node, tokens, symbol)
        if node.body is not None and not node.expression:
            self.bodies.append((f"{owner.name}.{scope.name}" if owner else scope.name, tokens[node.body[0]][1] + 1, tokens[node.body[1]][1]))

    def _property(self, node: Node, tokens, scopes: list[_Scope]) -> None:
        around = next((s for s in reversed(scopes) if s.kind in ("function", "type")), None)
        for at in node.names:
            name, offset = tokens[at]
            name = name.strip("`")
            if self.language == "java":
                symbol = self._symbol(name, "field", offset, scopes)
                if {"static", "final"} <= set(symbol["detail"].split()):
                    symbol["kind"] = "constant"
                continue
            fact = re.match(r"[^\n]*?\b" + re.escape(name) + r"\s*(?::\s*([\w.<>?, ]+?))?\s*(?:(?:=|by lazy\s*\{)\s*(?:([A-Z]\w*)\s*[({<]|(?:inject|get)\s*<\s*([\w.]+))|$|\s*=|\n)", self.clean[self.clean.rfind("\n", 0, offset) + 1 :])
            known = next((g for g in (fact.groups() if fact else ()) if g), None)
            if known:
                self.types.append({"line": self.place(offset)[0], "var": name, "type": known.strip()})
            if (around is None or around.kind == "type") and not node.inner:
                symbol = self._symbol(name, "property", offset, scopes)
                if self.language == "kotlin" and re.search(r"\bconst\s+val\b", symbol["detail"]):
                    symbol["kind"] = "constant"
            elif around is not None and around.kind == "function" and known:
                around.locals[name] = known.strip()

    def _call(self, tokens, i: int, scopes) -> None:
        """A call edge: bare, Type.m for capitalised or typed receivers, A.b.c for chains of names."""
        function = next((s for s in reversed(scopes) if s.kind == "function"), None)
        if function is None:
            return
        place = scopes.index(function)
        owner = next((s for s in reversed(scopes[:place]) if s.kind == "type"), None)
        chain, j = [tokens[i][0]], i
        while j >= 2 and tokens[j - 1][0] in (".", "?.") and _WORD.match(tokens[j - 2][0]):
            chain.insert(0, tokens[j - 2][0])
            j -= 2
        callee = chain[-1]
        if len(chain) > 1 and chain[0] not in ("this", "self", "super"):
            known = {k: v for s in scopes for k, v in s.locals.items()}.get(chain[0])
            head = re.split(r"[<?]", known, maxsplit=1)[0].rsplit(".", 1)[-1] if known else chain[0]
            if head[:1].isupper() and not any(x in KEYWORDS for x in chain[1:]):
                callee = ".".join([head, *chain[1:]])
        line = self.place(tokens[i][1])[0]
        key = f"{owner.name}.{function.name}" if owner else function.name
        edge = {"caller_key": key, "callee_key": callee, "line": line}
        if edge not in self.calls[-3:]:
            self.calls.append(edge)

    def steps(self) -> list[dict]:
        """(caller_key, seq, depth, kind, label, line): calls and branches of every body, in order.

        Lambdas and nested declarations are not entered; a call of a capitalised name is `new X`.
        """
        out = []
        for key, start, end in self.bodies:
            tokens = [(m[0], m.start() + start) for m in _TOKEN.finditer(self.clean[start:end])]
            open_, seq, paren, i = [], 0, 0, 0
            branch = None  # the branch whose block may open
            while i < len(tokens):
                word, at = tokens[i]
                after = tokens[i + 1][0] if i + 1 < len(tokens) else ""
                if word in ("(", ")"):
                    paren += 1 if word == "(" else -1
                elif word == "{":
                    if branch is not None and not paren:
                        open_.append(branch)
                        branch = None
                    elif i and tokens[i - 1][0] == "->" and open_:
                        open_.append(open_[-1])
                    else:  # a lambda, or a body of its own
                        depth = 1
                        while depth and i + 1 < len(tokens):
                            i += 1
                            depth += (tokens[i][0] == "{") - (tokens[i][0] == "}")
                elif word == "}":
                    if open_:
                        open_.pop()
                elif word in ("if", "else", "when", "for", "while", "do", "try", "catch", "finally", "switch", "guard"):
                    if not (word == "else" and after in ("if", "->")):
                        out.append({"caller_key": key, "seq": seq, "depth": len(open_), "kind": "branch", "label": word, "line": self.place(at)[0]})
                        seq += 1
                        branch = word
                elif _WORD.match(word) and word not in KEYWORDS and (after == "(" or at in self.called) and (not i or tokens[i - 1][0] not in ("fun", "func", "@")):
                    label = f"new {word}" if word[0].isupper() else word
                    out.append({"caller_key": key, "seq": seq, "depth": len(open_), "kind": "call", "label": label, "line": self.place(at)[0]})
                    seq += 1
                i += 1
        return out

    def lambdas(self) -> list[dict]:
        """(id, ancestors, line, col, end_line, end_col, receiver, method, names): the lambdas of calls, with those around them from the outermost, and the parameters they name."""
        tokens = [(m[0], m.start()) for m in _TOKEN.finditer(self.clean)]
        out, open_, brackets, closes = [], [], [], {}
        for i, (word, at) in enumerate(tokens):
            if word == "(":
                brackets.append(i)
            elif word == ")" and brackets:
                closes[i] = brackets.pop()
            elif word == "}" and open_:
                if (found := open_.pop()) is not None:
                    out[found]["end_line"], out[found]["end_col"] = self.place(at)
            elif word == "{":
                called = self._lambda_of(tokens, i, closes)
                open_.append(None if called is None else len(out))
                if called is not None:
                    line, col = self.place(at)
                    around = [x for x in open_[:-1] if x is not None]
                    out.append({"id": len(out), "ancestors": around, "line": line, "col": col, "end_line": line, "end_col": col, "receiver": called[0], "method": called[1], "names": self._lambda_names(tokens, i)})
        return out

    @staticmethod
    def _lambda_of(tokens, i: int, closes: dict[int, int]) -> tuple[str | None, str] | None:
        """(receiver, method) of the call that the lambda at a brace belongs to; None for other braces."""
        k, first = i - 1, None
        if k >= 0 and tokens[k][0] == ")" and k in closes:
            inside = tokens[closes[k] + 1 : k]
            first = inside[0][0] if len(inside) == 1 and _WORD.match(inside[0][0]) else None
            k = closes[k] - 1
        # let is a function of one language and a keyword of another
        if k < 0 or not _WORD.match(tokens[k][0]) or tokens[k][0] in KEYWORDS and not (tokens[k][0] == "let" and k and tokens[k - 1][0] in (".", "?.")):
            return None
        j = k
        joins = (".", "?.", "<", ">", "?")
        while j > 0 and (tokens[j - 1][0] in joins or tokens[j][0] in joins and _WORD.match(tokens[j - 1][0]) and tokens[j - 1][0] not in KEYWORDS):
            j -= 1
        if j and tokens[j - 1][0] in ("fun", "func", "class", "interface", "object", ":", "val", "var", "init", "constructor"):
            return None
        if tokens[k][0] == "with":
            return first, "with"
        dotted = k >= 2 and tokens[k - 1][0] in (".", "?.")
        simple = dotted and _WORD.match(tokens[k - 2][0]) and (k < 3 or tokens[k - 3][0] not in (".", "?."))
        return tokens[k - 2][0] if simple else None, tokens[k][0]

    @staticmethod
    def _lambda_names(tokens, i: int) -> list[str]:
        names, fresh, depth = [], True, 0
        for word, _ in tokens[i + 1 :]:
            if word == "->" and not depth:
                return names
            if word in ("{", "}", ";", "=", "."):
                break
            depth += (word in ("(", "<")) - (word in (")", ">"))
            if fresh and not depth and _WORD.match(word):
                names.append(word)
            fresh = word == "," and not depth
        return []

    def tokens(self) -> list[dict]:
        """Identifiers with their places and context flags."""
        declared = {(s["sel_line"], s["sel_col"]) for s in self.symbols}
        header = {i["line"] for i in self.imports}
        out = []
        for found in _WORD.finditer(self.clean):
            if found[0] in KEYWORDS:
                continue
            line, col = self.place(found.start())
            rest, front = self.clean[found.end() : found.end() + 40], self.clean[max(0, found.start() - 40) : found.start()]
            flags = []
            if line in header:
                flags.append("import")
            if (line, col) in declared:
                flags.append("declaration")
                if re.search(r"\boverride\b", self.lines[line]):
                    flags.append("override")
            if re.match(r"\s*\(", rest):
                flags.append("call")
            if re.match(r"\s*([+\-*/%]?=(?!=)|\+\+|--)", rest) or re.search(r"(\+\+|--)\s*$", front):
                flags.append("write")
            if found[0][0].isupper() and (re.search(r"[:<,]\s*$", front) or re.match(r"\s*[<>?]", rest) or re.search(r"\b(?:is|as|new|extends|implements)\s+$", front)):
                flags.append("type-use")
            out.append({"line": line, "col": col, "text": found[0], "ctx": flags})
        return out
