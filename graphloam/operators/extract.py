"""Facts of source files: imports, exports, classes with methods, functions.

TypeScript, JavaScript and Java go through one token scanner, which for scripts follows the parser's state, Python through the
standard library's `ast`. A bad file never stops a scan: its row has an error, and the facts that can be made out (of a script or
Java file that is not balanced; a Python file that can't be parsed has none).
"""

from __future__ import annotations

import ast
import re
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from graphloam.functions import text
from graphloam.schemas import PARSED_FILE

PARSER_VERSION = "1.0.0"


class Token(NamedTuple):
    kind: str  # word, string, mark
    text: str
    line: int
    at: int
    end: int


_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?(?:\*/|\Z)|\s+)|(?P<string>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<word>[\w$@#]+)|(?P<mark>=>|\?\.|\.\.\.|.)", re.S
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TAG = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=[\s/><]))")
#: A list of type parameters where an element may begin as well: it has a comma, a default, or a bound that is no attribute.
_TYPE_LIST = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|=\s*[^\s\"'{>]|extends\s+[^=>/\s])")
#: Words behind which an operand follows.
_BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield", "default", "extends", "keyof", "as", "satisfies"}
#: Words whose brackets hold a condition, so a statement follows; words and marks before a brace that opens a block.
_CONDITION, _BLOCK = {"if", "while", "for", "with", "switch", "catch"}, {"else", "do", "try", "finally", ";", "=>", ">"}


class Unbalanced(ValueError):
    """A bracket, template or element that is not closed, or closes nothing."""


class State:
    """Where a script's parser stands: whether an operand is due (so a slash begins a regular expression and an angle bracket an
    element), and for each open bracket what follows when it closes."""

    def __init__(self, in_expression: bool) -> None:
        self.due, self.last, self.stack = True, None, []
        #: the first brace is that of an expression within a template or element
        self.in_expression = in_expression

    def _opens_block(self) -> bool:
        """Whether a brace that comes next opens a block (or a class, or an interface), and no object."""
        if self.last is None:
            return not self.in_expression
        if not self.due or self.last.text in _BLOCK or self.last.text in "{}" or self.last.text == ")":
            return True
        return self.last.text == ":" and (not self.stack or self.stack[-1][0] == "block")

    def take(self, t: Token, source: str) -> None:
        after_dot = self.last is not None and self.last.kind == "mark" and self.last.text in (".", "?.")
        if t.kind == "string":
            self.due = False
        elif t.kind == "word":
            # a key of an object, a property or a method may have any name
            self.due = t.text in _BEFORE_OPERAND and not after_dot and not (t.text in ("of", "as", "in") and self.due)
        elif t.text == "(":
            word = self.last.text if self.last is not None and self.last.kind == "word" and not self.before_last_dot else ""
            self.stack.append(("condition" if word in _CONDITION or (word == "await" and self.second_last == "for") else "group", self.due))
            self.due = True
        elif t.text == "[":
            self.stack.append(("list", self.due))
            self.due = True
        elif t.text == "{":
            self.stack.append(("block" if self._opens_block() else "object", self.due))
            self.due = True
        elif t.text in (")", "]", "}"):
            kind = self.stack.pop()[0] if self.stack else "group"
            self.due = kind in ("condition", "block")
        elif t.text in "+-" and self.last is not None and self.last.kind == "mark" and self.last.text == t.text and self.last.end == t.at:
            self.due = self.due_before  # after an operand the pair is a suffix
        elif t.text == "!" and not self.due and not source.startswith("=", t.end):
            pass  # says that an operand is not null
        else:
            self.due = t.text not in (".", "?.")
        if t.text not in "+-" or t.kind != "mark":
            self.due_before = self.due
        self.before_last_dot = after_dot
        self.second_last = self.last.text if self.last is not None else ""
        self.last = t

    due_before, before_last_dot, second_last = True, False, ""


class Lexer:
    """Tokens of a source. expressions: a slash may begin a regular expression and a backquote a template (which may hold
    expressions, and these templates); jsx: an angle bracket where an operand is due begins an element, which is one token, or
    else, if it can't be one, a list of type parameters."""

    def __init__(self, source: str, expressions: bool, jsx: bool) -> None:
        self.source, self.expressions, self.jsx = source, expressions, jsx
        #: the first thing that is not balanced
        self.problem: str | None = None

    def tokens(self) -> list[Token]:
        """All tokens. What stays open to the end is noted as the problem; an open template is one token, an element's bracket
        a mark like any other."""
        return self._run(0, False)[0]

    def _whole(self, at: int, inside: bool) -> tuple[str, int]:
        """The kind and end of the template or element at a place."""
        try:
            return "string", self._template(at) if self.source[at] == "`" else self._element(at)
        except (Unbalanced, RecursionError) as e:
            if self.source[at] == "<" and self._type_list_end(at):
                return "mark", at + 1
            if inside:
                raise
            self.problem = self.problem or f"{type(e).__name__}: {e}"
            return ("string", len(self.source)) if self.source[at] == "`" else ("mark", at + 1)

    def _type_list_end(self, at: int) -> int | None:
        """Behind a list of type parameters at a place, if the parameters of a function follow it."""
        depth = 0
        for m in re.compile(r"=>|[<>(){}\[\];]").finditer(self.source, at):
            depth += {"<": 1, ">": -1}.get(m[0], 0)
            if not depth:
                return m.end() if re.compile(r"\s*\(").match(self.source, m.end()) else None
            if m[0] == ";":
                return None
        return None

    def _line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    def _run(self, at: int, one_block: bool) -> tuple[list[Token], int]:
        """Tokens from a place to the end; or, if a brace opens there, to behind the one that closes it."""
        source, out, line, depth, begun = self.source, [], 1, 0, at
        state = State(one_block)
        while at < len(source):
            c, kind = source[at], "string"
            if c == "`" and self.expressions:
                kind, end = self._whole(at, one_block)
            elif c == "/" and self.expressions and state.due and (m := _REGEX.match(source, at)):
                end = m.end()
            elif c == "<" and self.jsx and state.due and _TAG.match(source, at) and not _TYPE_LIST.match(source, at):
                kind, end = self._whole(at, one_block)
            else:
                m = _TOKEN.match(source, at)
                kind, end = m.lastgroup, m.end()
            if kind != "skip":
                out.append(Token(kind, source[at:end], line, at, end))
                if self.expressions:
                    state.take(out[-1], source)
            line += source.count("\n", at, end)
            at = end
            if one_block and kind == "mark":
                depth += {"{": 1, "}": -1}.get(c, 0)
                if not depth:
                    return out, at
        if one_block:
            raise Unbalanced(f"line {self._line(begun)}: a brace stays open")
        return out, at

    def _template(self, at: int) -> int:
        begun, at = at, at + 1
        while at < len(self.source):
            if self.source[at] == "`":
                return at + 1
            if self.source.startswith("${", at):
                at = self._run(at + 1, True)[1]
            else:
                at += 2 if self.source[at] == "\\" else 1
        raise Unbalanced(f"line {self._line(begun)}: a template stays open")

    def _element(self, at: int) -> int:
        source, begun, at = self.source, at, _TAG.match(self.source, at).end()
        if source[at - 1] != ">":
            if source.startswith("<", at):  # type arguments of the component
                depth = 0
                while at < len(source):
                    depth += {"<": 1, ">": -1}.get(source[at], 0) if source[at - 1 : at + 1] != "=>" else 0
                    at += 1
                    if not depth:
                        break
            while not source.startswith((">", "/>"), at):  # attributes
                if at >= len(source):
                    raise Unbalanced(f"line {self._line(begun)}: a tag stays open")
                if source[at] in "\"'":
                    at = source.find(source[at], at + 1) + 1 or len(source)
                elif source.startswith(("//", "/*"), at):
                    at = _TOKEN.match(source, at).end()
                elif source[at] == "<" and _TAG.match(source, at):
                    at = self._element(at)
                else:
                    at = self._run(at, True)[1] if source[at] == "{" else at + 1
            if source.startswith("/>", at):
                return at + 2
            at += 1
        while at < len(source):  # children
            if source.startswith("</", at):
                return source.find(">", at) + 1 or len(source)
            if source[at] == "{":
                at = self._run(at, True)[1]
            else:
                at = self._element(at) if _TAG.match(source, at) else at + 1
        raise Unbalanced(f"line {self._line(begun)}: an element stays open")


_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def partners(tokens: list[Token]) -> tuple[dict[int, int], str | None]:
    """The closing bracket of each opening one, the last token for one that stays open; and the first bracket without a
    partner of its kind."""
    out, stack, problem = {}, [], None
    for i, t in enumerate(tokens):
        if t.kind == "mark" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "mark" and t.text in _CLOSE:
            if not stack or _OPEN[tokens[stack[-1]].text] != t.text:
                problem = problem or f"Unbalanced: line {t.line}: {t.text} closes nothing"
            if stack:
                out[stack.pop()] = i
    if stack:
        problem = problem or f"Unbalanced: line {tokens[stack[-1]].line}: {tokens[stack[-1]].text} stays open"
    return out | {i: len(tokens) - 1 for i in stack}, problem


def after_angles(tokens: list[Token], i: int) -> int:
    """Behind a list of type arguments that begins at i, else i."""
    if i < len(tokens) and tokens[i].text == "<":
        depth = 0
        while i < len(tokens):
            depth += {"<": 1, ">": -1}.get(tokens[i].text, 0)
            i += 1
            if not depth:
                break
    return i


class Braced:
    """What TypeScript and Java have in common."""

    def __init__(self, source: str, path: str) -> None:
        self.source, self.path = source, path
        script = isinstance(self, TypeScript)
        lexer = Lexer(source, script, script and path.endswith((".tsx", ".jsx", ".js")))
        self.t = lexer.tokens()
        self.close, brackets = partners(self.t)
        #: what is not balanced, if anything
        self.problem = lexer.problem or brackets

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].text in texts and self.t[i].kind != "string"

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def place(self, first: int, last: int) -> dict:
        return {"filePath": self.path, "startLine": self.t[first].line, "endLine": self.t[min(last, len(self.t) - 1)].line}

    def between(self, first: int, end: int) -> str:
        """The source from token first to before token end."""
        return self.source[self.t[first].at : self.t[end - 1].end] if end > first else ""

    def split(self, first: int, end: int) -> list[str]:
        """The comma-separated parts of a token range, brackets kept together."""
        out, begin, i = [], first, first
        depth = 0
        while i < end:
            if self.t[i].text in _OPEN and self.t[i].kind == "mark":
                i = self.close[i]
            elif self.t[i].text in "<>" and self.t[i].kind == "mark":
                depth += 1 if self.t[i].text == "<" else -1
            elif self.is_(i, ",") and depth <= 0:
                out.append(self.between(begin, i))
                begin = i + 1
            i += 1
        return [x for x in [*out, self.between(begin, end)] if x.strip()]

    def heritage(self, i: int) -> tuple[str | None, list[str], int]:
        """extends, implements and the body's opening bracket, from behind a class's name."""
        base, kinds = None, []
        i = after_angles(self.t, i)
        while i < len(self.t) and not self.is_(i, "{", ";", "class"):
            if self.is_(i, "extends", "implements"):
                begin = i + 1
                i = begin
                while i < len(self.t) and not self.is_(i, "{", "implements", ";", "class"):
                    i = self.close.get(i, i) + 1
                names = [re.sub(r"<.*", "", n, flags=re.S).strip() for n in self.split(begin, i)]
                if self.is_(begin - 1, "extends"):
                    base = names[0] if names else None
                else:
                    kinds = names
            else:
                i += 1
        return base, kinds, i


class TypeScript(Braced):
    _FIELDS = {"public", "private", "protected", "static", "readonly", "override", "abstract", "async", "get", "set", "declare", "*"}

    def facts(self) -> dict:
        imports, exports, classes, functions = [], [], [], []
        depth_end: list[int] = []
        for i, t in enumerate(self.t):
            while depth_end and i >= depth_end[-1]:
                depth_end.pop()
            top = not depth_end
            if t.kind == "mark" and t.text in _OPEN:
                depth_end.append(self.close[i])
            if t.kind != "word":
                continue
            if top and t.text == "import" and not self.is_(i + 1, "(", "."):
                imports += self.import_(i)
            elif top and t.text == "export":
                exports += self.export(i)
            elif t.text == "class" and self.word(i + 1) and not self.is_(i - 1, ".") and not self.is_(i + 1, "extends", "implements"):
                classes.append(self.class_(i))
            elif top and t.text == "function" and (found := self.function(i)):
                functions.append(found)
        return {"imports": imports, "exports": exports, "classes": classes, "functions": functions}

    def import_(self, i: int) -> list[dict]:
        names, j = [], i + 1
        while j < len(self.t) and self.t[j].kind != "string" and not self.is_(j, ";"):
            if self.is_(j, "{"):
                names += [re.split(r"\s+as\s+", re.sub(r"^type\s+", "", n.strip()))[-1] for n in self.split(j + 1, self.close[j])]
                j = self.close[j]
            elif self.is_(j, "*") and self.is_(j + 1, "as"):
                names.append(self.t[j + 2].text)
                j += 2
            elif self.word(j) and not self.is_(j, "from", "type"):
                names.append(self.t[j].text)
            j += 1
        return [{"source": self.t[j].text.strip("'\"`"), "specifiers": names, "isDefault": False}] if j < len(self.t) and self.t[j].kind == "string" else []

    def export(self, i: int) -> list[dict]:
        j, default = i + 1, False
        if self.is_(j, "default"):
            j, default = j + 1, True
        if self.is_(j, "{"):
            return [{"name": re.split(r"\s+as\s+", n.strip())[-1], "isDefault": False} for n in self.split(j + 1, self.close[j])]
        while self.is_(j, "abstract", "async", "declare", "class", "function", "const", "let", "var", "interface", "type", "enum", "namespace", "*"):
            j += 1
        return [{"name": self.t[j].text if self.word(j) else "default", "isDefault": default}] if default or self.word(j) else []

    def class_(self, i: int) -> dict:
        base, kinds, body = self.heritage(i + 2)
        end = self.close.get(body, body)
        first = i - 1 if self.is_(i - 1, "abstract") else i
        return {"name": self.t[i + 1].text, "extends": base, "implements": kinds, "methods": self.methods(body + 1, end) if self.is_(body, "{") else [], "isAbstract": first < i, "location": self.place(first, end)}

    def methods(self, i: int, end: int) -> list[dict]:
        out = []
        while i < end:
            begin, flags = i, set()
            while self.is_(i, *self._FIELDS) and not self.is_(i + 1, "(", "=", ":", ";"):
                flags.add(self.t[i].text)
                i += 1
            args = after_angles(self.t, i + 1) if self.word(i) or self.is_(i, "[") else i
            if self.word(i) and not self.t[i].text.startswith("@") and self.is_(args, "("):
                close = self.close[args]
                body = close + 1
                while body < end and not self.is_(body, "{", ";") and self.t[body].line == self.t[body - 1].line:
                    body = self.close.get(body, body) + 1 if not self.is_(body, "{") else body
                kind = self.between(close + 2, body).strip() if self.is_(close + 1, ":") else None
                if self.is_(body, "{"):
                    out.append({"name": self.t[i].text, "params": self.split(args + 1, close), "returnType": kind, "isAsync": "async" in flags, "isExported": False, "location": self.place(begin, self.close[body])})
                    i = self.close[body] + 1
                    continue
                i = body
                continue
            # another member: to its end
            while i < end and not self.is_(i, ";"):
                if i in self.close:
                    i = self.close[i]
                    if self.is_(i, "}") or self.t[begin].text.startswith("@"):
                        break
                elif i > begin and self.t[i].line > self.t[i - 1].line and self.word(i) and not self.is_(i - 1, "=", ",", "=>", ":", ".", "?", "|", "&", "+", "@"):
                    i -= 1
                    break
                i += 1
            i += 1
        return out

    def function(self, i: int) -> dict | None:
        j = i + 2 if self.is_(i + 1, "*") else i + 1
        args = after_angles(self.t, j + 1)
        if not self.word(j) or not self.is_(args, "("):
            return None
        close = self.close[args]
        body = close + 1
        while body < len(self.t) and not self.is_(body, "{", ";"):
            body = self.close.get(body, body) + 1
        first = i
        while self.is_(first - 1, "async", "export", "default"):
            first -= 1
        kind = self.between(close + 2, body).strip() if self.is_(close + 1, ":") else None
        names = [self.t[x].text for x in range(first, i)]
        # direct children of the file or of an export only
        if self.is_(first - 1, "=", "(", ",", "return", "=>", ":", "!", "new", "await"):
            return None
        return {"name": self.t[j].text, "params": self.split(args + 1, close), "returnType": kind or None, "isAsync": "async" in names, "isExported": "export" in names, "location": self.place(i - ("async" in names), self.close.get(body, body))}


class Java(Braced):
    _MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile"}

    def facts(self) -> dict:
        imports, classes = [], []
        for i, t in enumerate(self.t):
            if t.kind == "word" and t.text == "import" and (i == 0 or self.is_(i - 1, ";", "}")):
                end = i + 1
                while end < len(self.t) and not self.is_(end, ";"):
                    end += 1
                name = re.sub(r"\s+", "", re.sub(r"^static\s+", "", self.between(i + 1, end)))
                imports.append({"source": name, "specifiers": [name.rpartition(".")[2]], "isDefault": False})
            elif t.kind == "word" and t.text == "class" and self.word(i + 1) and not self.is_(i - 1, "."):
                classes.append(self.class_(i))
        return {"imports": imports, "exports": [], "classes": classes, "functions": []}

    def class_(self, i: int) -> dict:
        base, kinds, body = self.heritage(i + 2)
        end, first = self.close.get(body, body), i
        while first and self.is_(first - 1, *self._MODIFIERS):
            first -= 1
        return {
            "name": self.t[i + 1].text, "extends": base, "implements": kinds, "methods": self.methods(body + 1, end) if self.is_(body, "{") else [],
            "isAbstract": any(self.t[x].text == "abstract" for x in range(first, i)), "location": self.place(first, end),
        }

    def methods(self, i: int, end: int) -> list[dict]:
        """Members `[modifiers] type name(...)`; constructors have no type and are none."""
        out = []
        while i < end:
            begin = i
            while i < end and not self.is_(i, ";", "{", "(", "="):
                i += 1
            if self.is_(i, "(") and self.t[begin].text.startswith("@") and i == begin + 1:
                i = self.close[i] + 1
                continue
            if self.is_(i, "("):
                close, head = self.close[i], [x for x in range(begin, i - 1) if not self.is_(x, *self._MODIFIERS) and not self.t[x].text.startswith("@")]
                stop = close + 1
                while stop < end and not self.is_(stop, "{", ";"):
                    stop += 1
                last = self.close[stop] if self.is_(stop, "{") else stop
                if head and self.word(i - 1):
                    out.append({"name": self.t[i - 1].text, "params": self.split(i + 1, close), "returnType": self.between(head[0], i - 1).strip(), "isAsync": False, "isExported": True, "location": self.place(begin, last)})
                i = last + 1
            elif self.is_(i, "="):
                while i < end and not self.is_(i, ";"):
                    i = self.close.get(i, i) + 1
                i += 1
            else:
                i = self.close.get(i, i) + 1
        return out


def python_facts(source: str, path: str) -> dict:
    """Top-level functions, all classes with their direct methods; decorated ones too."""
    tree = ast.parse(source)
    place = lambda n: {"filePath": path, "startLine": n.lineno, "endLine": n.end_lineno}
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef)

    def function(n: ast.FunctionDef | ast.AsyncFunctionDef) -> dict:
        a = n.args
        names = [*(x.arg for x in [*a.posonlyargs, *a.args]), *([f"*{a.vararg.arg}"] if a.vararg else []), *(x.arg for x in a.kwonlyargs), *([f"**{a.kwarg.arg}"] if a.kwarg else [])]
        return {"name": n.name, "params": names, "returnType": ast.unparse(n.returns) if n.returns else None, "isAsync": isinstance(n, ast.AsyncFunctionDef), "isExported": True, "location": place(n)}

    imports, classes = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [(n.lineno, {"source": x.name, "specifiers": [x.asname or x.name], "isDefault": False}) for x in n.names]
        elif isinstance(n, ast.ImportFrom):
            imports.append((n.lineno, {"source": "." * n.level + (n.module or ""), "specifiers": [x.name for x in n.names], "isDefault": False}))
        elif isinstance(n, ast.ClassDef):
            bases = [ast.unparse(b) for b in n.bases]
            classes.append((n.lineno, {"name": n.name, "extends": bases[0] if bases else None, "implements": bases[1:], "methods": [function(m) for m in n.body if isinstance(m, kinds)], "isAbstract": any(b.rpartition(".")[2] == "ABC" for b in bases), "location": place(n)}))
    by_line = lambda rows: [x for _, x in sorted(rows, key=lambda r: r[0])]
    return {"imports": by_line(imports), "exports": [], "classes": by_line(classes), "functions": [function(n) for n in tree.body if isinstance(n, kinds)]}


def facts(language: str, source: str, path: str) -> dict:
    """The facts of a source; of one that is not balanced those that can be made out."""
    return facts_and_problem(language, source, path)[0]


def facts_and_problem(language: str, source: str, path: str) -> tuple[dict, str | None]:
    """Facts, and what is not balanced."""
    if language not in ("typescript", "javascript", "java"):
        return python_facts(source, path), None
    file = Java(source, path) if language == "java" else TypeScript(source, path)
    return file.facts(), file.problem


def has_facts() -> Column:
    """Whether a parsed row belongs in a graph: it has no error, or facts in spite of one."""
    return F.col("error").isNull() | (F.size("imports") + F.size("exports") + F.size("classes") + F.size("functions") > 0)


def parse(files: DataFrame) -> DataFrame:
    """(repositoryId, path, content, contentHash, ...) -> PARSED_FILE, for supported extensions only.

    content: decoded text. Files that are not balanced give a row with an error and the facts that can be made out; null content
    and Python files that can't be parsed one without facts. Select them by `error is not null`.
    """
    schema = T._parse_datatype_string(PARSED_FILE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                begun, empty, error = time.perf_counter(), {"imports": [], "exports": [], "classes": [], "functions": []}, None
                try:
                    found, error = facts_and_problem(row["language"], row["content"], row["path"])
                except Exception as e:  # noqa: BLE001  any file may be malformed; the row says how
                    found, error = empty, f"{type(e).__name__}: {e}"[:300]
                meta = {"parserVersion": PARSER_VERSION, "parsedAt": datetime.now(UTC), "parseDurationMs": int((time.perf_counter() - begun) * 1000)}
                out.append({"id": f"{row['repositoryId']}:{row['path']}", "repositoryId": row["repositoryId"], "path": row["path"], "contentHash": row["contentHash"], "language": row["language"], **found, "frameworkHints": row["hints"], "metadata": meta, "error": error})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    lang = text.language(F.col("path"))
    rows = files.select("repositoryId", "path", "content", "contentHash", lang.alias("language"), text.framework_hints(lang, F.coalesce("content", F.lit(""))).alias("hints"))
    return rows.where("language is not null").mapInArrow(run, schema)
