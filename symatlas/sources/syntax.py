"""An error-tolerant recursive-descent parser: tokens of a Kotlin, Java or Swift source to a tree of declarations and calls.

Headers are parsed by their grammar, bodies as sequences of declarations, calls and blocks. Where a header
doesn't go on as it should, an error is noted and parsing resumes at the next place that begins something:
a brace, or a declaring word at the start of a line. Where the braces of a source don't match, a declaration
that begins no further to the right than the one whose body is open ends that body.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_WORD = re.compile(r"[^\W\d]\w*|`[^`\n]+`")

#: Words that begin a type's declaration, with its kind.
TYPES = {
    "kotlin": {"class": "class", "interface": "interface", "object": "object"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "struct", "@interface": "interface"},
    "swift": {"class": "class", "struct": "struct", "protocol": "interface", "enum": "enum", "extension": "class", "actor": "class"},
}
#: Words that begin a declaration when they stand first on a line; none of them stands there inside a header.
_FIRST = frozenset("fun func class interface object typealias struct enum protocol extension actor import package init".split())
_MODIFIERS = frozenset(
    "public private protected internal fileprivate open abstract final sealed data inline suspend override static const lateinit operator infix tailrec external expect actual "
    "inner value companion annotation synchronized native default strictfp transient volatile mutating nonmutating convenience required lazy weak indirect".split()
)
#: What an expression goes on after, at the end of a line, and what goes on with it at the start of the next.
_ENDS_OPEN = frozenset("= ( [ , . ?. -> :: + - * / % & | < > ? : ! return else if in is as throw by".split())
_GOES_ON = frozenset(". ?. ? : :: && || + * / % & | else as ) ] ,".split())
#: Before a word with a trailing lambda and nothing else: where an expression may begin.
_BEGINS = frozenset("= return ( , { } -> ; else by && || & | ! + in".split())
_CONTROL = frozenset("if for while switch guard catch when".split())
#: Nested bodies that are entered; below, braces are passed over.
DEEPEST = 150


@dataclass
class Node:
    """A declaration (type, function, constructor, property, typealias, entry), a call or a block; places are numbers of tokens."""

    kind: str
    at: int
    word: str = ""
    label: str = ""
    names: list[int] = field(default_factory=list)
    properties: list[tuple[int, int]] = field(default_factory=list)
    kids: list["Node"] = field(default_factory=list)
    body: tuple[int, int] | None = None
    expression: bool = False
    inner: bool = False


class Parser:
    """Parses the tokens (text, offset) of one source; `places` gives (line, column) of an offset."""

    def __init__(self, tokens: list[tuple[str, int]], language: str, keywords: frozenset, places):
        self.tokens, self.language, self.keywords, self.places = tokens, language, keywords, places
        self.words = [t[0] for t in tokens] + [""]
        lines = [places(t[1]) for t in tokens]
        self.lines = [p[0] for p in lines] + [1 << 60]
        self.columns = [p[1] for p in lines] + [-1]
        self.first = [i == 0 or self.lines[i] != self.lines[i - 1] for i in range(len(tokens))] + [True]
        self.unbalanced = self.words.count("{") != self.words.count("}")
        self.errors: list[tuple[int, str]] = []
        self.i, self.depth = 0, 0

    def parse(self) -> list[Node]:
        out: list[Node] = []
        while self.i < len(self.tokens):
            out += self.members("file", -1)
            self.i += 1  # a brace that closes nothing
        return out

    # ── helpers ──

    def name_at(self, i: int) -> bool:
        return bool(_WORD.fullmatch(self.words[i])) and self.words[i] not in self.keywords

    def starts(self, i: int) -> bool:
        """Whether a declaration may begin with this token, the first of its line."""
        return self.first[i] and (self.words[i] in _FIRST or self.words[i] in _MODIFIERS or self.words[i] in ("val", "var", "let", "@"))

    def line_start(self, i: int) -> int:
        while not self.first[i]:
            i -= 1
        return i

    def braces(self, i: int) -> int:
        """The token behind the brace that closes the one at i."""
        depth = 0
        while i < len(self.tokens):
            depth += (self.words[i] == "{") - (self.words[i] == "}")
            i += 1
            if not depth:
                break
        return i

    def angles(self, i: int) -> int:
        """The token behind the type arguments at i, or i if that is no list of types."""
        depth, j = 0, i
        while j < len(self.tokens):
            word = self.words[j]
            if word == "<":
                depth += 1
            elif word == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif not (_WORD.fullmatch(word) or word in (",", ".", "?", "*", ":", "&", "(", ")", "->", "@", "[", "]")):
                return i
            j += 1
        return i

    def brackets(self, i: int, header: bool = False) -> int:
        """The token behind the bracket that closes the one at i. In a header, what can't stand in a list of parameters ends it, as an error."""
        depth, j = 0, i
        while j < len(self.tokens):
            word = self.words[j]
            if word in ("(", "["):
                depth += 1
            elif word in (")", "]"):
                depth -= 1
                if not depth:
                    return j + 1
            elif word == "{":
                if header and self.words[j - 1] in ("(", ","):
                    break
                j = self.braces(j)
                continue
            elif word == "}" or header and self.first[j] and word in _FIRST and self.words[j - 1] not in ("@", ":"):
                break
            j += 1
        if header:
            self.errors.append((i, "unclosed ("))
        return j

    # ── bodies ──

    def members(self, level: str, owner: int, owner_name: str = "", inner: bool = False) -> list[Node]:
        """What stands up to the brace that closes this body: level is file, type, or code; owner is the token that began the declaration."""
        out: list[Node] = []
        while self.i < len(self.tokens):
            word = self.words[self.i]
            if word == "}":
                return out
            if self.unbalanced and owner >= 0 and self.starts(self.i) and self.columns[self.i] <= self.columns[self.line_start(owner)] and self.lines[self.i] > self.lines[owner]:
                return out
            out += self.member(level, owner_name, inner)
        return out

    def body(self, node: Node, level: str, owner_name: str = "", inner: bool = False) -> None:
        """Parse the braces at the current token into the node."""
        opened = self.i
        if self.depth >= DEEPEST:
            self.i = self.braces(self.i)
            node.body = (opened, self.i - 1)
            return
        self.i += 1
        self.depth += 1
        if node.kind == "type" and node.label == "enum" and self.language != "swift":
            node.kids += self.entries(owner_name)
        node.kids += self.members(level, node.at, owner_name, inner)
        self.depth -= 1
        node.body = (opened, min(self.i, len(self.tokens) - 1))
        if self.i < len(self.tokens) and self.words[self.i] == "}":
            self.i += 1

    def entries(self, owner_name: str) -> list[Node]:
        """The entries at the head of an enum's body."""
        out = []
        while self.i < len(self.tokens):
            while self.words[self.i] == "@" and self.i + 1 < len(self.tokens):
                self.i += 2
                if self.words[self.i] == "(":
                    self.i = self.brackets(self.i)
            if not self.name_at(self.i) or self.words[self.i + 1] not in (",", ";", "}", "(", "{", "@") and not self.first[self.i + 1]:
                if self.words[self.i] in (",", ";"):
                    self.i += 1
                return out
            node = Node("entry", self.i, names=[self.i])
            self.i += 1
            if self.words[self.i] == "(":
                self.i = self.brackets(self.i)
            node.names.append(self.i)
            if self.words[self.i] == "{":
                self.body(node, "type", owner_name)
            out.append(node)
            if self.words[self.i] != ",":
                if self.words[self.i] == ";":
                    self.i += 1
                return out
            self.i += 1
        return out

    def member(self, level: str, owner_name: str, inner: bool) -> list[Node]:
        i, word = self.i, self.words[self.i]
        before, after = (self.words[i - 1] if i else ""), self.words[i + 1]
        if word == "{":
            node = Node("block", i)
            self.body(node, "code", owner_name, True)
            return [node]
        if word in ("(", "["):  # what is in brackets is no member of what is around
            self.i += 1
            out = []
            while self.i < len(self.tokens) and self.words[self.i] not in (")", "]", "}"):
                if self.starts(self.i) and self.words[self.i] in _FIRST and before not in (",", "(") and self.unbalanced:
                    return out
                out += self.member("code", owner_name, True)
            if self.words[self.i] in (")", "]"):
                self.i += 1
            return out
        if word in TYPES[self.language] and before not in (".", "::", "?.") and _WORD.fullmatch(after) and not (word == "class" and self.language == "swift" and after in ("func", "var", "let")):
            return [self.type(inner)]
        if word == "object" and after == ":" and self.language == "kotlin":
            return self.anonymous(owner_name)
        if word == "object" and after == "{" and self.language == "kotlin":  # without a name, its members are those of the type around
            node = Node("block", i)
            self.i += 1
            self.body(node, level, owner_name, inner)
            return [node]
        if word in ("fun", "func") and (_WORD.fullmatch(after) or after == "<") and after != "interface":
            found = self.function(inner)
            if found is not None:
                return [found]
        if word == {"kotlin": "constructor", "swift": "init"}.get(self.language) and after == "(" and owner_name and before not in (".", ":"):
            return [self.constructor(Node("constructor", i, names=[i], label=word))]
        if word in ("val", "var", "let", "const") and self.language != "java" and after not in self.keywords | {"val", "var"} and (_WORD.fullmatch(after) or after in ("(", "<")):
            return [self.property(level, inner)]
        if word == "typealias" and _WORD.fullmatch(after):
            self.i += 2
            return [Node("typealias", i + 1, names=[i + 1], inner=inner)]
        if self.language == "swift" and word == "case" and level == "type":
            return self.cases()
        if self.language == "java" and level == "type" and not inner and self.name_at(i):
            found = self.java_member(owner_name)
            if found is not None:
                return [found]
        if self.name_at(i) and before != "@" and self.called(i):
            self.i += 1
            return [Node("call", i)]
        self.i += 1
        return []

    def called(self, i: int) -> bool:
        """Whether a word is called: by arguments, or by a trailing lambda alone."""
        after, before = self.words[i + 1], self.words[i - 1] if i else ""
        if after == "(":
            return True
        if after == "<" and self.language == "kotlin":
            end = self.angles(i + 1)
            return end > i + 1 and (self.words[end] == "(" and before != "fun" or self.words[end] == "{" and before in (".", "?."))
        if after != "{" or self.language == "java" or self.lines[i + 1] != self.lines[i]:
            return False
        if before in (".", "?."):
            return True
        head = self.line_start(i)
        return (self.first[i] or before in _BEGINS) and not (self.language == "swift" and any(w in _CONTROL for w in self.words[head:i]))

    # ── declarations ──

    def type(self, inner: bool) -> Node:
        i = self.i
        word, before, at = self.words[i], self.words[i - 1] if i else "", i + 1
        while self.words[at] in self.keywords and _WORD.fullmatch(self.words[at + 1]):
            at += 1
        label = TYPES[self.language][word]
        if self.language == "kotlin" and "enum" in self.before(i):
            label = "enum"
        if before == "@" and word == "interface":
            label = "interface"
        node = Node("type", i, word=word, label=label, names=[at], inner=inner)
        name = self.words[at].strip("`")
        self.i = at + 1
        if self.words[self.i] == "<":
            self.i = self.angles(self.i) if self.angles(self.i) > self.i else self.i + 1
        j = self.i
        while self.words[j] in _MODIFIERS or self.words[j] == "@" or self.words[j] == "constructor" or self.words[j - 1] == "@":
            j += 1
        if self.words[j] == "(" and (j == self.i or self.words[j - 1] == "constructor") and self.language != "swift":
            self.i = self.parameters(node, j)
        while self.i < len(self.tokens):  # supertypes and bounds
            word = self.words[self.i]
            if word == "{":
                self.body(node, "type", name)
                return node
            if word in ("}", ";") or self.first[self.i] and not self.supers_go_on(self.i):
                return node
            self.i = self.brackets(self.i) if word in ("(", "[") else self.i + 1
        return node

    def supers_go_on(self, i: int) -> bool:
        return self.words[i] in (":", ",", ".", "where", "by", "extends", "implements", "permits", "throws", "<", "(") or self.words[i - 1] in (",", ":", "by", "where", "extends", "implements", "permits", "&", ".") and self.words[i] not in _FIRST

    def before(self, i: int) -> list[str]:
        """The modifiers before a declaring word."""
        j = i
        while j and self.words[j - 1] in _MODIFIERS | {"enum", "fun"}:
            j -= 1
        return self.words[j:i]

    def parameters(self, node: Node, i: int) -> int:
        """The parameters of a primary constructor at i; of those with val or var, which are properties, the name and the first token."""
        end = self.brackets(i, True)
        j, depth, begin = i + 1, 0, i + 1
        fresh = True
        while j < end:
            word = self.words[j]
            if fresh and word in ("val", "var") and self.name_at(j + 1):
                node.properties.append((j + 1, begin))
            depth += (word in ("(", "[", "{")) - (word in (")", "]", "}"))
            depth += (word == "<" and self.angles(j) > j) - (word == ">" and depth > 0)
            if word == "," and not depth:
                begin = j + 1
            fresh = word == "," and not depth or fresh and (word in _MODIFIERS or word == "@" or self.words[j - 1] == "@" or self.annotated(j))
            j += 1
        return end

    def annotated(self, j: int) -> bool:
        """Whether a token belongs to the arguments of an annotation."""
        while j >= 0 and self.words[j] not in (",", "@") and self.words[j] not in ("val", "var"):
            j -= 1
        return j >= 0 and self.words[j] == "@"

    def anonymous(self, owner_name: str) -> list[Node]:
        """`object : Type(..) { .. }`: its arguments and body belong to what is around."""
        self.i += 2
        out = []
        while self.i < len(self.tokens) and self.words[self.i] not in ("{", "}", ";", ")"):
            if self.words[self.i] == "(":
                out += self.member("code", owner_name, True)
            else:
                self.i += 1
        if self.words[self.i] == "{":
            node = Node("block", self.i)
            self.body(node, "code", owner_name, True)
            out.append(node)
        return out

    def function(self, inner: bool) -> Node | None:
        i, j, depth = self.i, self.i + 1, 0
        while j < len(self.tokens) and (depth or self.words[j] not in ("(", "{", "=", "}", ";")):
            if self.words[j] == "<" and j > i + 1 and self.language == "swift":
                break
            if j > i + 1 and self.first[j] and self.words[j] in _FIRST:
                break
            depth += (self.words[j] == "<") - (self.words[j] == ">")
            j += 1
        if not _WORD.fullmatch(self.words[j - 1]) or j - 1 == i:
            return None
        return self.rest_of_function(Node("function", i, names=[j - 1], inner=inner), j)

    def constructor(self, node: Node) -> Node:
        return self.rest_of_function(node, self.i + 1)

    def rest_of_function(self, node: Node, j: int) -> Node:
        """Type parameters, parameters, the type or a call of another constructor, and the body, from token j on."""
        if self.words[j] == "<":
            j = max(self.angles(j), j + 1)
        if self.words[j] == "(":
            j = self.brackets(j, True)
        self.i = j
        while self.i < len(self.tokens):
            word = self.words[self.i]
            if word == "{":
                self.body(node, "code", "", True)
                return node
            if word == "=" and self.language != "java":
                node.expression = True
                opened = self.i
                self.i += 1
                node.kids += self.expression(node)
                node.body = (opened, max(opened, self.i - 1))
                return node
            if word in ("}", ";") or self.first[self.i] and word not in (":", "where", "->", "throws", "rethrows", "async", ".", "<") and self.words[self.i - 1] not in (":", "->", ",", ".", "where", "throws", "<", "&"):
                return node
            self.i = self.brackets(self.i) if word in ("(", "[") else self.i + 1
        return node

    def expression(self, owner: Node) -> list[Node]:
        """An expression body: it ends with its line, unless that leaves it open or the next goes on with it."""
        out = []
        while self.i < len(self.tokens):
            word = self.words[self.i]
            if word in ("}", ";", ")", ","):
                return out
            if self.first[self.i] and (self.starts(self.i) or self.words[self.i - 1] not in _ENDS_OPEN and word not in _GOES_ON):
                return out
            out += self.member("code", "", True)
        return out

    def property(self, level: str, inner: bool) -> Node:
        i, j = self.i, self.i + 1
        node = Node("property", i, word=self.words[i], inner=inner or level == "code" and inner)
        if self.words[j] == "const":
            j += 1
        if self.words[j] == "<":
            j = max(self.angles(j), j + 1)
        if self.words[j] == "(":  # destructured
            end = self.brackets(j)
            node.names = [k for k in range(j + 1, end - 1) if self.name_at(k) and self.words[k - 1] in ("(", ",")]
            self.i = end
            return node
        while self.language == "kotlin" and _WORD.fullmatch(self.words[j]):  # an extension's receiver
            k = j + 1
            if self.words[k] == "<" and self.angles(k) > k:
                k = self.angles(k)
            if self.words[k] == "?":
                k += 1
            if self.words[k] in (".", "?.") and _WORD.fullmatch(self.words[k + 1]) and self.lines[k + 1] == self.lines[j]:
                j = k + 1
            else:
                break
        node.names = [j]
        self.i = j + 1
        return node

    def cases(self) -> list[Node]:
        """`case a, b(Int), c = 1` in the body of an enum."""
        line, out = self.lines[self.i], []
        self.i += 1
        while self.i < len(self.tokens) and self.name_at(self.i) and self.words[self.i - 1] in ("case", ","):
            out.append(Node("entry", self.i, names=[self.i]))
            self.i += 1
            if self.words[self.i] == "(":
                self.i = self.brackets(self.i)
            out[-1].names.append(self.i)
            if self.words[self.i] == "=" and self.lines[self.i] == line:
                while self.words[self.i] not in (",", "}", ";") and self.lines[self.i] == line:
                    self.i += 1
            if self.words[self.i] == ",":
                self.i += 1
        return out

    def java_member(self, owner_name: str) -> Node | None:
        """A method, constructor or field of a Java type, at its name."""
        i, word = self.i, self.words[self.i]
        before, after = self.words[i - 1] if i else "", self.words[i + 1]
        typed = (_WORD.fullmatch(before) is not None or before in (">", "]")) and before not in ("new", "return", "throw", "else")
        if after == "(" and word == owner_name and before != "new":
            return self.constructor(Node("constructor", i, names=[i], label="constructor"))
        if after == "(" and typed:
            return self.rest_of_function(Node("function", i, names=[i]), i + 1)
        if after in ("=", ";", ",") and typed and before not in ("extends", "implements", "import", "package"):
            self.i += 1
            node = Node("property", i, word="field", names=[i])
            while self.i < len(self.tokens) and self.words[self.i] not in (";", "}"):
                if self.words[self.i] == "," and self.name_at(self.i + 1) and self.words[self.i + 2] in ("=", ";", ","):
                    node.names.append(self.i + 1)
                    self.i += 2
                else:
                    node.kids += self.member("code", owner_name, True)
            return node
        return None
