"""Java source to syntax nodes, one file at a time; Spark distributes the files.

A short recursive-descent parser that keeps what rules can ask about. Labelled, assert, yield and
local-class statements and explicit constructor calls become UnknownStmt without children, what has
no node of its own UnknownExpr; try resources, anonymous class bodies and enum constant bodies are
dropped; a call's receiver is text. A file that does not parse has an error and no nodes.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)"
    r'|(?P<str>"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\')'
    r"|(?P<num>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"
    r"|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/%&|^!~?:;,.(){}\[\]<>=@])",
    re.S,
)
MODIFIERS = set("public private protected static final abstract native synchronized transient volatile strictfp default sealed".split())
PRIMITIVES = set("int long short byte char boolean float double void".split())
BINARY = [["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!="], ["<", ">", "<=", ">="], ["<<", ">>", ">>>"], ["+", "-"], ["*", "/", "%"]]
LEVEL = {op: i for i, ops in enumerate(BINARY) for op in ops}
ASSIGN = set("= += -= *= /= &= |= ^= %= <<= >>= >>>=".split())


class ParseError(ValueError):
    pass


def node(kind: str, line: int, **fields) -> dict:
    return {"kind": kind, "line": line, "children": [], **fields}


def add(parent: dict, slot: str, child: dict | None) -> None:
    if child is not None:
        parent["children"].append((slot, child))


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i = text, [], 0
        at, line = 0, 1
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ParseError(f"line {line}: unexpected {text[at]!r}")
            if m.lastgroup != "skip":
                self.toks.append((m.lastgroup, m[0], line, at, m.end()))
            line += m[0].count("\n")
            at = m.end()
        self.toks.append(("end", "", line, at, at))

    # tokens
    @property
    def tok(self) -> str:
        return self.toks[self.i][1] if self.toks[self.i][0] != "str" else '"'

    @property
    def line(self) -> int:
        return self.toks[self.i][2]

    def peek(self, k: int = 1) -> str:
        t = self.toks[min(self.i + k, len(self.toks) - 1)]
        return t[1] if t[0] != "str" else '"'

    def is_name(self, k: int = 0) -> bool:
        return self.toks[min(self.i + k, len(self.toks) - 1)][0] == "id"

    def take(self) -> str:
        t = self.toks[self.i][1]
        if self.toks[self.i][0] == "end":
            raise ParseError(f"line {self.line}: unexpected end")
        self.i += 1
        return t

    def accept(self, *ts: str) -> bool:
        if self.tok in ts:
            self.i += 1
            return True
        return False

    def expect(self, t: str) -> None:
        if self.tok != t:
            raise ParseError(f"line {self.line}: expected {t!r}, found {self.tok!r}")
        self.i += 1

    def ident(self) -> str:
        if not self.is_name():
            raise ParseError(f"line {self.line}: expected a name, found {self.tok!r}")
        return self.take()

    def since(self, i: int) -> str:
        return self.text[self.toks[i][3] : self.toks[self.i - 1][4]]

    def end_line(self) -> int:
        return self.toks[self.i - 1][2]

    def skip_to_close(self, opener: str, closer: str) -> None:
        """After the opener: past its closer."""
        depth = 1
        while depth:
            t = self.tok
            self.take()
            depth += (t == opener) - (t == closer)

    # names, types, modifiers
    def dotted(self) -> str:
        out = self.ident()
        while self.tok == "." and self.is_name(1):
            self.i += 1
            out += "." + self.take()
        return out

    def type_args(self) -> str:
        start = self.i
        self.expect("<")
        depth = 1
        while depth:
            t = self.take()
            if t in "(){;" or t in ("->", "&&", "||"):
                raise ParseError("not a type")
            depth += (t == "<") - (t == ">")
        return re.sub(r"\s*,\s*", ", ", re.sub(r"\s+(?=[<>,])|(?<=<)\s+", "", self.since(start)))

    def type_(self) -> str:
        while self.tok == "@" and self.peek() != "interface":
            self.annotation()
        out = self.ident()
        while True:
            if self.tok == "<":
                out += self.type_args()
            elif self.tok == "." and self.is_name(1):
                self.i += 1
                out += "." + self.take()
            else:
                break
        while self.tok == "[" and self.peek() == "]":
            self.i += 2
            out += "[]"
        return out

    def try_type(self) -> str | None:
        at = self.i
        try:
            return self.type_()
        except ParseError:
            self.i = at
            return None

    def annotation(self) -> dict:
        line = self.line
        self.expect("@")
        name = self.dotted()
        if self.accept("("):
            self.skip_to_close("(", ")")
        return {"name": name, "line": line}

    def modifiers(self) -> tuple[list[str], list[dict]]:
        mods, anns = [], []
        while True:
            if self.tok == "@" and self.peek() != "interface":
                anns.append(self.annotation())
            elif self.tok == "non" and self.peek() == "-":
                self.i += 3
                mods.append("non-sealed")
            elif self.tok in MODIFIERS and not (self.tok == "default" and self.peek() in (":", "->")) and not (self.tok == "sealed" and not self.is_name(1)) and not (self.tok == "synchronized" and self.peek() == "("):
                mods.append(self.take())
            else:
                return mods, anns

    # declarations
    def unit(self) -> dict:
        at = self.i
        _, anns = self.modifiers()
        package, imports, types = None, [], []
        if self.tok == "package":
            self.i += 1
            package = self.dotted()
            self.expect(";")
        else:
            self.i = at
        while self.tok in ("import", ";"):
            line = self.line
            if self.take() == ";":
                continue
            static = self.accept("static")
            name = self.dotted()
            wild = self.tok == "."
            if wild:
                self.i += 1
                self.expect("*")
            self.expect(";")
            imports.append({"package": name, "is_wildcard": wild, "is_static": static, "line": line})
        root = node("CompilationUnit", 1)
        while self.toks[self.i][0] != "end":
            if self.accept(";"):
                continue
            t = self.type_declaration(*self.start())
            if t is None:
                raise ParseError(f"line {self.line}: expected a type")
            add(root, "types", t)
        return {"package": package, "imports": imports, "root": root, "types": types}

    def start(self) -> tuple[int, list[str], list[dict]]:
        line = self.line
        return (line, *self.modifiers())

    def type_declaration(self, line: int, mods: list[str], anns: list[dict]) -> dict | None:
        kind = {"class": "ClassDeclaration", "interface": "InterfaceDeclaration", "enum": "EnumDeclaration"}.get(self.tok)
        if self.tok == "@" and self.peek() == "interface":
            self.i += 1
            kind = "AnnotationDeclaration"
        if self.tok == "record" and self.is_name(1) and self.peek(2) in ("(", "<"):
            raise ParseError(f"line {line}: records have no tree")
        if kind is None:
            return None
        self.i += 1
        out = node(kind, line, name=self.ident(), modifiers=mods, annotations=[] if kind == "AnnotationDeclaration" else anns)
        while self.tok != "{":
            self.take()
        self.i += 1
        if kind == "EnumDeclaration":
            while self.tok not in (";", "}"):
                while self.tok == "@":
                    self.annotation()
                add(out, "constants", node("EnumConstant", self.line, name=self.ident()))
                if self.accept("("):
                    self.skip_to_close("(", ")")
                if self.accept("{"):
                    self.skip_to_close("{", "}")
                self.accept(",")
            self.accept(";")
        while not self.accept("}"):
            for m in self.member(out["name"], kind):
                add(out, {"ClassDeclaration": "nested_class", "InterfaceDeclaration": "nested_interface", "EnumDeclaration": "nested_enum", "AnnotationDeclaration": "nested_annotation"}.get(m["kind"], "members"), m)
        out["end_line"] = self.end_line()
        return out

    def member(self, owner: str, owner_kind: str) -> list[dict]:
        if self.accept(";"):
            return []
        line, mods, anns = self.start()
        if self.tok == "{":
            out = node("InitializerDeclaration", line, modifiers=mods)
            add(out, "body", self.block())
            return [out]
        if self.tok == "record" and self.is_name(1) and self.peek(2) in ("(", "<"):
            while self.tok != "{":
                self.take()
            self.i += 1
            self.skip_to_close("{", "}")
            return []
        nested = self.type_declaration(line, mods, anns)
        if nested:
            return [nested]
        if self.tok == "<":
            self.type_args()
        if self.tok == owner and self.peek() in ("(", "{"):
            out = node("ConstructorDeclaration", line, name=self.take(), modifiers=mods, annotations=anns)
            out["parameters"] = self.parameters() if self.tok == "(" else []
        else:
            type_name = self.type_()
            if self.peek() != "(":
                return self.fields(line, mods, anns, type_name)
            out = node("MethodDeclaration", line, name=self.ident(), type_name=type_name, modifiers=mods, annotations=anns)
            out["parameters"] = self.parameters()
        while self.tok not in ("{", ";", "default"):
            self.take()
        if self.tok == "default":
            while self.tok != ";":
                self.take()
        if not self.accept(";"):
            add(out, "body", self.block())
        out["end_line"] = self.end_line()
        return [] if owner_kind == "AnnotationDeclaration" and out["kind"] == "MethodDeclaration" else [out]

    def fields(self, line: int, mods: list[str], anns: list[dict], type_name: str) -> list[dict]:
        out = []
        while True:
            f = node("FieldDeclaration", self.line, name=self.ident(), type_name=type_name, modifiers=mods, annotations=anns)
            while self.accept("["):
                self.expect("]")
                f["type_name"] += "[]"
            if self.accept("="):
                add(f, "initializer", self.initializer())
            out.append(f)
            if not self.accept(","):
                self.expect(";")
                return out

    def initializer(self) -> dict:
        if self.tok == "{":
            return self.array_values()
        return self.expression()

    def array_values(self) -> dict:
        start, line = self.i, self.line
        self.expect("{")
        self.skip_to_close("{", "}")
        return node("UnknownExpr", line, value=self.since(start))

    def parameters(self) -> list[dict]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            self.modifiers()
            t = self.type_()
            if self.accept("..."):
                t += "..."
            name = self.take() if self.tok == "this" else self.dotted()
            while self.accept("["):
                self.expect("]")
                t += "[]"
            out.append({"param_type": t, "name": name})
            self.accept(",")
        return out

    # statements
    def block(self) -> dict:
        out = node("BlockStmt", self.line)
        self.expect("{")
        while not self.accept("}"):
            add(out, "statements", self.statement())
        out["end_line"] = self.end_line()
        return out

    def paren(self) -> dict:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def unknown_until(self, closer: str = ";") -> dict:
        line = self.line
        depth = 0
        while depth or self.tok != closer:
            t = self.take()
            depth += (t in ("(", "{", "[")) - (t in (")", "}", "]"))
        self.i += 1
        return node("UnknownStmt", line)

    def statement(self) -> dict:
        line, t = self.line, self.tok
        if t == "{":
            return self.block()
        if t == ";":
            self.i += 1
            return node("EmptyStmt", line)
        if t in ("this", "super") and self.peek() == "(":
            return self.unknown_until()
        if self.is_name() and self.peek() == ":" and t not in ("default", "case"):
            self.i += 2
            self.statement()
            return node("UnknownStmt", line)
        if t == "assert" or t == "yield" and (self.is_name(1) or self.toks[self.i + 1][0] in ("num", "str")):
            return self.unknown_until()
        method = getattr(self, f"s_{t}", None) if self.toks[self.i][0] == "id" else None
        if method and not (t == "synchronized" and self.peek() != "("):
            self.i += 1
            return method(line)
        at = self.i
        mods, _ = self.modifiers()
        if self.tok in ("class", "interface", "enum") or self.tok == "record" and self.is_name(1) and self.peek(2) in ("(", "<"):
            while self.tok != "{":
                self.take()
            self.i += 1
            self.skip_to_close("{", "}")
            return node("UnknownStmt", line)
        d = self.declaration(line)
        if d:
            self.expect(";")
            return d
        self.i = at
        out = node("ExpressionStmt", line)
        add(out, "expression", self.expression())
        self.expect(";")
        return out

    def declaration(self, line: int, kind: str = "VariableDeclarationStmt") -> dict | None:
        """A local variable declaration, or None (and no token taken)."""
        at = self.i
        if not self.is_name() or self.tok in ("this", "super", "new", "switch"):
            return None
        type_name = self.try_type()
        if type_name is None or not self.is_name() or self.tok == "instanceof" or self.peek() not in ("=", ";", ",", ":", "["):
            self.i = at
            return None
        out = node(kind, line, type_name=type_name)
        while True:
            v = node("Variable", self.line, name=self.ident(), type_name=type_name)
            while self.accept("["):
                self.expect("]")
            if self.accept("="):
                add(v, "initializer", self.initializer())
            add(out, "variables", v)
            if not self.accept(","):
                return out

    def s_if(self, line: int) -> dict:
        out = node("IfStmt", line)
        add(out, "condition", self.paren())
        add(out, "then", self.statement())
        if self.accept("else"):
            add(out, "else", self.statement())
        return out

    def s_while(self, line: int) -> dict:
        out = node("WhileStmt", line)
        add(out, "condition", self.paren())
        add(out, "body", self.statement())
        return out

    def s_do(self, line: int) -> dict:
        out = node("DoStmt", line)
        add(out, "body", self.statement())
        self.expect("while")
        add(out, "condition", self.paren())
        self.expect(";")
        return out

    def s_for(self, line: int) -> dict:
        self.expect("(")
        at = self.i
        self.modifiers()
        d = self.declaration(line, "VariableDeclarationExpr")
        if d and self.accept(":"):
            out = node("ForEachStmt", line)
            add(out, "variable", d)
            add(out, "iterable", self.expression())
            self.expect(")")
            add(out, "body", self.statement())
            return out
        out = node("ForStmt", line)
        if d:
            add(out, "init", d)
        else:
            self.i = at
            for k, e in enumerate(self.list_until(";")):
                if not k:
                    add(out, "init", e)
        self.expect(";")
        if self.tok != ";":
            add(out, "condition", self.expression())
        self.expect(";")
        for e in self.list_until(")"):
            add(out, "update", e)
        self.expect(")")
        add(out, "body", self.statement())
        return out

    def list_until(self, closer: str) -> list[dict]:
        out = []
        while self.tok != closer:
            out.append(self.expression())
            if not self.accept(","):
                break
        return out

    def s_try(self, line: int) -> dict:
        out = node("TryStmt", line)
        if self.accept("("):
            self.skip_to_close("(", ")")
        add(out, "body", self.block())
        while self.tok == "catch":
            c = node("CatchClause", self.line)
            self.i += 1
            self.expect("(")
            self.modifiers()
            start = self.i
            self.type_()
            while self.accept("|"):
                self.type_()
            c["type_name"] = self.since(start)
            c["name"] = self.ident()
            self.expect(")")
            add(c, "body", self.block())
            add(out, "catch_clauses", c)
        if self.accept("finally"):
            add(out, "finally", self.block())
        return out

    def s_switch(self, line: int) -> dict:
        out = node("SwitchStmt", line)
        add(out, "selector", self.paren())
        self.expect("{")
        while not self.accept("}"):
            case = node("SwitchCase", self.line)
            if not self.accept("default"):
                self.expect("case")
                start = self.i
                depth = 0
                while depth or self.tok not in (":", "->"):
                    t = self.take()
                    depth += (t == "(") - (t == ")")
                case["label"] = self.since(start)
            arrow = self.tok == "->"
            self.i += 1
            if arrow:
                add(case, "statements", self.statement())
            else:
                while self.tok not in ("case", "default", "}"):
                    add(case, "statements", self.statement())
            add(out, "cases", case)
        return out

    def s_synchronized(self, line: int) -> dict:
        out = node("SynchronizedStmt", line)
        add(out, "expression", self.paren())
        add(out, "body", self.block())
        return out

    def s_return(self, line: int) -> dict:
        out = node("ReturnStmt", line)
        if self.tok != ";":
            add(out, "expression", self.expression())
        self.expect(";")
        return out

    def s_throw(self, line: int) -> dict:
        out = node("ThrowStmt", line)
        add(out, "expression", self.expression())
        self.expect(";")
        return out

    def jump(self, kind: str, line: int) -> dict:
        out = node(kind, line, label=self.take() if self.tok != ";" else None)
        self.expect(";")
        return out

    def s_break(self, line: int) -> dict:
        return self.jump("BreakStmt", line)

    def s_continue(self, line: int) -> dict:
        return self.jump("ContinueStmt", line)

    # expressions
    def expression(self) -> dict:
        line = self.line
        if self.is_name() and self.peek() == "->":
            return self.lambda_(line)
        if self.tok == "(":
            depth, k = 1, self.i + 1
            while depth and k < len(self.toks):
                depth += (self.toks[k][1] == "(") - (self.toks[k][1] == ")")
                k += 1
            if k < len(self.toks) and self.toks[k][1] == "->":
                return self.lambda_(line)
        left = self.binary(0)
        if self.accept("?"):
            out = node("ConditionalExpr", line)
            add(out, "condition", left)
            add(out, "then", self.expression())
            self.expect(":")
            add(out, "else", self.expression())
            left = out
        op = self.operator()
        if op in ASSIGN:
            self.i += 1 if op[0] != ">" else len(op)
            out = node("AssignExpr", line, op=op)
            add(out, "target", left)
            add(out, "value", self.expression())
            return out
        return left

    def operator(self) -> str:
        """The operator here; > is one token each, so shifts are put together."""
        t, k = self.tok, 1
        if t == ">" and self.toks[self.i][0] == "op":
            while self.peek(k) in (">", "=", ">=") and self.toks[self.i + k][3] == self.toks[self.i + k - 1][4] and t[-1] != "=":
                t += self.peek(k)
                k += 1
            if t.endswith("==") and len(t) == 2:
                t = ">="
        if t == "<<" and self.peek() == "=":
            return "<<="
        return t if self.toks[self.i][0] == "op" else ""

    def lambda_(self, line: int) -> dict:
        out = node("LambdaExpr", line)
        start = self.i
        if self.accept("("):
            self.skip_to_close("(", ")")
        else:
            self.i += 1
        names = re.findall(r"([\w$]+)\s*(?=[,)]|$)", self.since(start))
        out["parameters"] = [{"param_type": None, "name": n} for n in names]
        self.expect("->")
        if self.tok == "{":
            add(out, "body", self.block())
        else:
            body = node("ExpressionStmt", self.line)
            add(body, "expression", self.expression())
            add(out, "body", body)
        return out

    def binary(self, level: int) -> dict:
        line = self.line
        left = self.unary()
        while True:
            if self.tok == "instanceof":
                self.i += 1
                self.accept("final")
                out = node("InstanceOfExpr", line, type_name=self.type_())
                if self.is_name() and self.tok not in ("instanceof",):
                    self.take()
                elif self.tok == "(":
                    self.i += 1
                    self.skip_to_close("(", ")")
                add(out, "expression", left)
                left = out
                continue
            op = self.operator()
            if op not in LEVEL or LEVEL[op] < level:
                return left
            self.i += len(op) if op[0] == ">" else 1
            out = node("BinaryExpr", line, op=op)
            add(out, "left", left)
            add(out, "right", self.binary(LEVEL[op] + 1))
            left = out

    def unary(self) -> dict:
        line, t = self.line, self.tok
        if t in ("+", "-", "!", "~", "++", "--") and self.toks[self.i][0] == "op":
            self.i += 1
            out = node("UnaryExpr", line, op=t)
            add(out, "expression", self.unary())
            return out
        if t == "(":
            at = self.i
            self.i += 1
            type_name = self.try_type()
            while type_name and self.accept("&"):
                self.try_type()
            if type_name and self.accept(")"):
                nxt = self.toks[self.i]
                operand = nxt[0] in ("str", "num") or nxt[0] == "id" and nxt[1] != "instanceof" or nxt[1] in ("(", "!", "~")
                if operand or type_name in PRIMITIVES and nxt[1] in ("+", "-"):
                    out = node("CastExpr", line, type_name=type_name)
                    add(out, "expression", self.expression() if nxt[1] == "(" and self.is_lambda() or self.peek() == "->" else self.unary())
                    return out
            self.i = at
        return self.postfix(self.primary())

    def is_lambda(self) -> bool:
        depth, k = 1, self.i + 1
        while depth and k < len(self.toks):
            depth += (self.toks[k][1] == "(") - (self.toks[k][1] == ")")
            k += 1
        return self.peek(k - self.i) == "->"

    def arguments(self) -> list[dict]:
        self.expect("(")
        out = self.list_until(")")
        self.expect(")")
        return out

    def call(self, line: int, name: str, callee: str | None) -> dict:
        out = node("MethodCallExpr", line, name=name, callee=callee)
        for a in self.arguments():
            add(out, "arguments", a)
        return out

    def primary(self) -> dict:
        kind, t, line = *self.toks[self.i][:2], self.line
        start = self.i
        if kind in ("num", "str") or t in ("true", "false", "null"):
            self.i += 1
            return node("LiteralExpr", line, value=t)
        if t == "(":
            e = self.paren()
            out = node("EnclosedExpr", line)
            add(out, "expression", e)
            return self.with_text(out, start)
        if t == "new":
            return self.with_text(self.creation(line), start)
        if t == "switch":
            self.i += 1
            self.paren()
            self.expect("{")
            self.skip_to_close("{", "}")
            return node("UnknownExpr", line, value=self.since(start))
        if kind == "id":
            if t in PRIMITIVES or self.generic_reference():
                self.type_()
                if self.accept("::"):
                    self.take()
                    return node("MethodReferenceExpr", line, type_name=self.since(start).split("::")[0].strip(), value=self.since(start))
                self.expect(".")
                self.expect("class")
                return node("UnknownExpr", line, value=self.since(start))
            self.i += 1
            if self.tok == "(":
                return self.with_text(self.call(line, t, None), start)
            kind = {"this": "ThisExpr", "super": "SuperExpr"}.get(t, "NameExpr")
            return self.with_text(node(kind, line, name=t), start)
        if t == "@":
            self.annotation()
            return self.primary()
        raise ParseError(f"line {line}: unexpected {t!r}")

    def generic_reference(self) -> bool:
        """Whether a type with type arguments or array brackets comes here, before :: or .class."""
        if self.peek() not in ("<", "[", "."):
            return False
        at = self.i
        t = self.try_type()
        good = bool(t) and ("<" in t or "[" in t) and (self.tok == "::" or self.tok == "." and self.peek() == "class")
        self.i = at
        return good

    def with_text(self, n: dict, start: int) -> dict:
        n["text"] = self.since(start)
        return n

    def creation(self, line: int) -> dict:
        self.expect("new")
        while self.tok == "@":
            self.annotation()
        name = self.ident()
        while True:
            if self.tok == "<":
                name += self.type_args()
            elif self.tok == "." and self.is_name(1):
                self.i += 1
                name += "." + self.take()
            else:
                break
        if self.tok == "[":
            out = node("ArrayCreationExpr", line, type_name=name)
            while self.accept("["):
                if self.tok != "]":
                    add(out, "dimensions", self.expression())
                self.expect("]")
            if self.accept("{"):
                while not self.accept("}"):
                    add(out, "initializer", self.initializer())
                    if self.tok != "}":
                        self.expect(",")
            return out
        out = node("ObjectCreationExpr", line, class_name=name)
        for a in self.arguments():
            add(out, "arguments", a)
        if self.accept("{"):
            self.skip_to_close("{", "}")
        return out

    def receiver(self, n: dict) -> str:
        """The text that stands for the receiver of a call."""
        if n["kind"] in ("NameExpr", "ThisExpr", "SuperExpr"):
            return n["name"]
        if n["kind"] == "FieldAccessExpr":
            return self.receiver(n["children"][0][1]) + "." + n["name"]
        return n.get("text") or n.get("value") or ""

    def postfix(self, e: dict) -> dict:
        start = next(k for k in range(self.i - 1, -1, -1) if k == 0 or self.toks[k][3] <= self.start_of(e))
        while True:
            line = e["line"]
            if self.tok == ".":
                self.i += 1
                if self.tok == "<":
                    self.type_args()
                if self.tok == "new":
                    e = self.with_text(self.creation(self.line), start)
                    continue
                if self.tok == "class":
                    self.i += 1
                    e = node("UnknownExpr", line, value=self.since(start))
                    continue
                name = self.take()
                if self.tok == "(":
                    e = self.with_text(self.call(line, name, self.receiver(e)), start)
                else:
                    out = node("FieldAccessExpr", line, name=name)
                    add(out, "target", e)
                    e = self.with_text(out, start)
            elif self.tok == "[":
                self.i += 1
                out = node("ArrayAccessExpr", line)
                add(out, "array", e)
                add(out, "index", self.expression())
                self.expect("]")
                e = self.with_text(out, start)
            elif self.tok in ("++", "--"):
                out = node("UnaryExpr", line, op=self.take())
                add(out, "expression", e)
                e = self.with_text(out, start)
            elif self.tok == "::":
                self.i += 1
                self.take()
                e = node("MethodReferenceExpr", line, type_name=self.receiver(e), value=self.since(start))
            else:
                return e

    def start_of(self, e: dict) -> int:
        text = e.get("text") or e.get("value") or ""
        return self.toks[self.i - 1][4] - len(text)


def flat(root: dict) -> list[tuple]:
    """The nodes below `root` in nested-set order, as rows of the nodes schema."""
    rows: list = []
    stack = [(root, None, -1, 0, "", 0, [], [])]
    while stack:
        n, parent, parent_nid, depth, slot, ord_, path, nids = stack.pop()
        if n is None:  # all below the node `parent` are out
            rows[parent][1] = len(rows) - 1
            continue
        nid = len(rows)
        nids = [*nids, nid] if parent_nid >= 0 else []
        rows.append(
            [nid, nid, parent_nid, depth, slot, ord_, n["kind"], n["line"], n.get("end_line"), n.get("name"), n.get("callee"), n.get("class_name"), n.get("type_name"), n.get("op"), n.get("value"), n.get("label"),
             n.get("modifiers") or [], n.get("annotations") or [], n.get("parameters") or [], path, nids]
        )
        stack.append((None, nid, 0, 0, "", 0, [], []))
        seen: dict[str, int] = {}
        kids = []
        for s, c in n["children"]:
            kids.append((c, nid, nid, depth + 1, s, seen.setdefault(s, 0), [*path, f"{n['kind']}.{s}"], nids))
            seen[s] += 1
        stack.extend(reversed(kids))
    return rows


def parse_source(text: str) -> dict:
    """package, imports and nodes of a source, or the parse error."""
    try:
        unit = Parser(text).unit()
        return {"package": unit["package"], "parse_error": None, "imports": unit["imports"], "nodes": flat(unit["root"])}
    except (ParseError, RecursionError) as e:
        return {"package": None, "parse_error": str(e) or type(e).__name__, "imports": [], "nodes": []}
