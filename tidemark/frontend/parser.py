"""A tolerant parser for the syntax that moves data: types are read and dropped, what it doesn't know becomes an unknown node."""

from __future__ import annotations

from typing import Any

from tidemark.frontend.lexer import Token, tokens


class Node:
    """kind, where it is in the source, and fields by kind."""

    __slots__ = ("kind", "start", "end", "fields", "parent", "inner")

    def __init__(self, kind: str, start: int, end: int, **fields: Any):
        self.kind, self.start, self.end, self.fields, self.parent = kind, start, end, fields, None
        self.inner = inner = []
        for v in fields.values():
            if v.__class__ is Node:
                inner.append(v)
            elif v.__class__ is list:
                inner += [x for x in v if x.__class__ is Node]
        for child in inner:
            child.parent = self

    def __getattr__(self, name: str) -> Any:
        try:
            return self.fields[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self) -> list[Node]:
        """Nodes among the fields; fields are whole when a node is made."""
        return self.inner


#: Binary operators by how tightly they bind.
_BINDING = {op: n for n, ops in enumerate(["??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**"], 1) for op in ops.split()}
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "export", "default"}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


class Parser:
    def __init__(self, source: str, begin: int = 0, stop: int | None = None):
        self.source, self.tokens, self.at = source, tokens(source, begin, stop), 0
        self.problems: list[tuple[int, str]] = []
        self.parted: list[tuple[int, Token]] = []  # tokens that were taken apart, as they were

    # ---- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def last_end(self) -> int:
        return self.tokens[self.at - 1].end if self.at else 0

    def next(self) -> Token:
        token = self.now
        if token.type != "end":
            self.at += 1
        return token

    def isnt_string(self) -> bool:
        return self.now.type in ("id", "p")

    def sees(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        return t.text in texts and (t.type == "p" or t.type == "id")

    def takes(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        if t.text in texts and (t.type == "p" or t.type == "id"):
            self.at += 1
            return True
        return False

    def wants(self, text: str) -> None:
        if not self.takes(text):
            self.problems.append((self.now.start, f"expected {text}"))

    def skip_balanced(self) -> None:
        """Past the bracket that closes the one here."""
        depth = 0
        while self.now.type != "end":
            t = self.next()
            if t.type == "p":
                depth += (t.text in _CLOSERS) - (t.text in _CLOSERS.values())
            if depth <= 0:
                return

    # ---- types

    def type_(self) -> None:
        self.takes("|", "&")
        while True:
            self._type_operand()
            if self.takes("|", "&", "is") or (self.tokens[self.at - 1].text == ")" and self.takes("=>")):
                continue
            if self.sees("extends") and not self.now.newline:
                self.next()
                self._type_operand()
                if self.takes("?"):
                    self.type_()
                    self.wants(":")
                    self.type_()
            return

    def _type_operand(self) -> None:
        while self.takes("keyof", "typeof", "readonly", "unique", "infer", "asserts", "new", "abstract", "-"):
            pass
        if self.sees("<"):
            self.type_arguments()
        if self.sees("{", "[", "("):
            self.skip_balanced()
        elif self.now.type in ("id", "str", "num", "template"):
            self.next()
            while self.takes("."):
                self.next()
            if self.sees("<"):
                self.type_arguments()
        while self.sees("[") and not self.now.newline:
            self.skip_balanced()

    def type_arguments(self) -> bool:
        """Past `<...>`; a sign like >> is taken apart."""
        self.next()
        while self.now.type != "end" and not self.now.text.startswith(">"):
            here = self.at
            self.takes("const", "in", "out")
            self.type_()
            if self.takes("="):
                self.type_()
            if not self.takes(",") and not self.now.text.startswith(">"):
                return False
            if self.at == here:
                return False
        t = self.now
        if t.type != "p" or not t.text.startswith(">"):
            return False
        if len(t.text) == 1:
            self.next()
        else:
            self.parted.append((self.at, t))
            self.tokens[self.at] = Token("p", t.text[1:], t.start + 1, t.end)
        return True

    def attempt(self, f):
        """f's result, or nothing moved if that is false."""
        at, parted, said = self.at, len(self.parted), len(self.problems)
        found = f()
        if not found:
            self.at = at
            while len(self.parted) > parted:
                place, token = self.parted.pop()
                self.tokens[place] = token
            del self.problems[said:]
        return found

    def annotation(self) -> None:
        if self.takes(":"):
            self.type_()

    # ---- statements

    def program(self) -> list[Node]:
        out = []
        while self.now.type != "end":
            here = self.at
            if (s := self.statement()) is not None:
                out.append(s)
            if self.at == here:
                self.problems.append((self.now.start, f"unexpected {self.now.text}"))
                self.next()
        return out

    def block(self) -> Node:
        start, body = self.now.start, []
        self.wants("{")
        while self.now.type != "end" and not self.sees("}"):
            here = self.at
            if (s := self.statement()) is not None:
                body.append(s)
            if self.at == here:
                self.problems.append((self.now.start, f"unexpected {self.now.text}"))
                self.next()
        self.wants("}")
        return Node("block", start, self.last_end(), body=body)

    def statement(self) -> Node | None:
        t, start = self.now, self.now.start
        done = lambda kind, **f: Node(kind, start, self.last_end(), **f)
        if t.type == "p":
            if t.text == "{":
                return self.block()
            if self.takes(";"):
                return None
            if t.text == "@":
                self.decorators()
                return self.statement()
        word = t.text if t.type == "id" else ""
        after = self.peek()
        if word in ("const", "let", "var") and (after.type == "id" or after.text in "{["):
            if word == "const" and after.text == "enum":
                self.next()
                return self.statement()
            out = self.variables()
            self.takes(";")
            return out
        if word == "function" or (word == "async" and after.text == "function" and not after.newline):
            return self.function(declared=True)
        if word == "class" or (word == "abstract" and after.text == "class"):
            self.takes("abstract")
            return self.class_()
        if word in ("interface", "namespace", "module", "enum", "declare", "type") and after.type in ("id", "str") and not after.newline:
            return self.declaration_only(word)
        if word == "import" and after.text not in ("(", "."):
            while self.now.type != "end" and not self.sees(";") and not (self.now.type == "str"):
                self.next()
            self.next()
            self.takes(";")
            return None
        if word == "export":
            self.next()
            self.takes("default")
            if self.sees("type") and self.peek().text in ("{", "*"):
                self.next()
            if self.sees("*", "{"):
                while self.now.type != "end" and not self.sees(";") and not self.now.newline:
                    self.skip_balanced() if self.sees("{") else self.next()
                self.takes(";")
                return None
            self.takes("=")
            return self.statement()
        if word in ("return", "throw"):
            self.next()
            value = None if self.sees(";", "}") or self.now.newline or self.now.type == "end" else self.expression()
            self.takes(";")
            return done(word, value=value)
        if word == "if":
            self.next()
            test = self.parenthesised()
            then = self.statement()
            return done("if", test=test, then=then, other=self.statement() if self.takes("else") else None)
        if word == "for":
            return self.for_()
        if word in ("while", "with"):
            self.next()
            test = self.parenthesised()
            return done("while", test=test, body=self.statement())
        if word == "do":
            self.next()
            body = self.statement()
            self.wants("while")
            test = self.parenthesised()
            self.takes(";")
            return done("while", test=test, body=body)
        if word == "try":
            self.next()
            body, handler, last = self.block(), None, None
            if self.takes("catch"):
                if self.sees("("):
                    self.skip_balanced()
                handler = self.block()
            if self.takes("finally"):
                last = self.block()
            return done("try", body=body, handler=handler, last=last)
        if word == "switch":
            self.next()
            test, body = self.parenthesised(), []
            self.wants("{")
            while self.now.type != "end" and not self.sees("}"):
                here = self.at
                if self.takes("case"):
                    self.expression()
                    self.wants(":")
                elif self.takes("default"):
                    self.wants(":")
                elif (s := self.statement()) is not None:
                    body.append(s)
                if self.at == here:
                    self.next()
            self.wants("}")
            return done("switch", test=test, body=body)
        if word in ("break", "continue", "debugger"):
            self.next()
            if self.now.type == "id" and not self.now.newline and not self.sees("case", "default"):
                self.next()
            self.takes(";")
            return None
        if t.type == "id" and after.text == ":" and after.type == "p":
            self.next()
            self.next()
            return self.statement()
        value = self.expression()
        self.takes(";")
        return done("expression", value=value)

    def declaration_only(self, word: str) -> Node | None:
        self.next()
        if word == "declare":
            return self.statement() and None
        while self.now.type != "end" and not self.sees("{", "=", ";"):
            self.next()
        if self.takes("="):
            self.type_()
        elif self.sees("{"):
            if word in ("namespace", "module"):
                return self.block()
            self.skip_balanced()
        self.takes(";")
        return None

    def decorators(self) -> None:
        while self.takes("@"):
            self.next()
            while self.takes("."):
                self.next()
            if self.sees("("):
                self.skip_balanced()

    def parenthesised(self) -> Node:
        self.wants("(")
        value = self.expression()
        self.wants(")")
        return value

    def variables(self, in_for: bool = False) -> Node:
        start, out = self.now.start, []
        self.next()
        while True:
            begin = self.now.start
            target = self.binding()
            self.takes("!")
            self.annotation()
            value = self.assignment(no_in=in_for) if self.takes("=") else None
            out.append(Node("declarator", begin, self.last_end(), target=target, value=value))
            if not self.takes(","):
                return Node("variables", start, self.last_end(), declarators=out)

    def binding(self) -> Node:
        """A name, or a pattern of parts (key, target, default, rest)."""
        start = self.now.start
        if not self.sees("{", "["):
            name = self.next()
            return Node("name", start, name.end, text=name.text)
        close, is_object, parts, index = _CLOSERS[self.now.text], self.now.text == "{", [], 0
        self.next()
        while self.now.type != "end" and not self.sees(close):
            if self.takes(","):
                index += 1
                continue
            begin, rest, key = self.now.start, self.takes("..."), str(index)
            if is_object and not rest:
                if self.sees("["):
                    self.skip_balanced()
                    key = "*"
                    self.wants(":")
                    target = self.binding()
                else:
                    key = self.now.text.strip("'\"")
                    if self.peek().text == ":":
                        self.next()
                        self.next()
                        target = self.binding()
                    else:
                        target = self.binding()
            else:
                target = self.binding()
                key = target.text if rest and target.kind == "name" else key
            default = self.assignment() if self.takes("=") else None
            parts.append(Node("part", begin, self.last_end(), key=key, target=target, default=default))
            if not self.sees(close) and not self.sees(","):
                self.next()
        self.wants(close)
        return Node("pattern", start, self.last_end(), parts=parts)

    def for_(self) -> Node:
        start = self.next().start
        self.takes("await")
        self.wants("(")
        first = None
        if self.sees("const", "let", "var"):
            first = self.variables(in_for=True)
        elif not self.sees(";"):
            first = self.expression(no_in=True)
        if self.takes("of", "in"):
            over = self.expression()
            self.wants(")")
            return Node("forof", start, self.last_end(), target=first, over=over, body=self.statement())
        self.wants(";")
        test = None if self.sees(";") else self.expression()
        self.wants(";")
        step = None if self.sees(")") else self.expression()
        self.wants(")")
        return Node("for", start, self.last_end(), first=first, test=test, step=step, body=self.statement())

    # ---- functions and classes

    def parameters(self) -> list[Node]:
        out = []
        self.wants("(")
        while self.now.type != "end" and not self.sees(")"):
            here = self.at
            self.decorators()
            while self.now.type == "id" and self.now.text in _MODIFIERS and (self.peek().type == "id" or self.peek().text in ("{", "[")):
                self.next()
            start, rest = self.now.start, self.takes("...")
            target = self.binding()
            optional = self.takes("?")
            self.annotation()
            default = self.assignment() if self.takes("=") else None
            if not (target.kind == "name" and target.text == "this"):
                out.append(Node("parameter", start, self.last_end(), target=target, default=default, optional=optional or default is not None, rest=rest))
            if not self.takes(",") and self.at == here:
                self.next()
        self.wants(")")
        return out

    def function(self, declared: bool = False) -> Node:
        start = self.now.start
        self.takes("async")
        self.wants("function")
        self.takes("*")
        name = self.next().text if self.now.type == "id" else None
        return self.function_rest(start, name, "declaration" if declared else "function")

    def function_rest(self, start: int, name: str | None, form: str) -> Node:
        if self.sees("<"):
            self.type_arguments()
        parameters = self.parameters()
        self.annotation()
        body = self.block() if self.sees("{") else None
        if body is None:
            self.takes(";")
        return Node("fn", start, self.last_end(), form=form, name=name, parameters=parameters, body=body)

    def arrow(self) -> Node | None:
        """An arrow function, if one is here."""
        start = self.now.start
        if self.sees("async") and not self.peek().newline and (self.peek().text == "(" or self.peek(2).text == "=>"):
            self.next()
        if self.now.type == "id" and self.peek().text == "=>":
            name = self.next()
            parameters = [Node("parameter", name.start, name.end, target=Node("name", name.start, name.end, text=name.text), default=None, optional=False, rest=False)]
        else:
            if self.sees("<") and not self.type_arguments():
                return None
            if not self.sees("("):
                return None
            at = self.at
            self.skip_balanced()
            if self.sees(":"):
                self.annotation()
            if not self.sees("=>"):
                return None
            self.at = at
            parameters = self.parameters()
            self.annotation()
        if not self.takes("=>"):
            return None
        body = self.block() if self.sees("{") else self.assignment()
        return Node("fn", start, self.last_end(), form="arrow", name=None, parameters=parameters, body=body)

    def class_(self) -> Node:
        start = self.next().start
        name = self.next().text if self.now.type == "id" and not self.sees("extends", "implements") else None
        if self.sees("<"):
            self.type_arguments()
        if self.takes("extends"):
            self.unary()
        if self.takes("implements"):
            while not self.sees("{") and self.now.type != "end":
                self.type_()
                self.takes(",")
        members = []
        self.wants("{")
        while self.now.type != "end" and not self.sees("}"):
            here = self.at
            if (m := self.member()) is not None:
                members.append(m)
            if self.at == here:
                self.next()
        self.wants("}")
        return Node("class", start, self.last_end(), name=name, members=members)

    def member(self) -> Node | None:
        """A method, or a field's value."""
        if self.takes(";"):
            return None
        self.decorators()
        start, form = self.now.start, "method"
        while self.now.type == "id" and self.now.text in _MODIFIERS and self.peek().text not in ("(", "=", ";", ":", "?", "!"):
            if self.next().text == "static" and self.sees("{"):
                return self.block()
        self.takes("*")
        if self.sees("get", "set") and self.peek().text not in ("(", "=", ";", ":", "?", "!"):
            form = self.next().text
        if self.sees("["):
            name = "[computed]"
            self.skip_balanced()
        else:
            name = self.next().text.strip("'\"")
        self.takes("?", "!")
        if self.sees("(", "<"):
            return self.function_rest(start, name, "constructor" if name == "constructor" else form)
        self.annotation()
        value = self.assignment() if self.takes("=") else None
        self.takes(";")
        return value and Node("field", start, self.last_end(), name=name, value=value)

    # ---- expressions

    def expression(self, no_in: bool = False) -> Node:
        left = self.assignment(no_in)
        while self.takes(","):
            right = self.assignment(no_in)
            left = Node("binary", left.start, right.end, op=",", left=left, right=right)
        return left

    def assignment(self, no_in: bool = False) -> Node:
        if (self.sees("(", "<", "async") or (self.now.type == "id" and self.peek().text == "=>")) and (found := self.attempt(self.arrow)):
            return found
        start = self.now.start
        if self.sees("yield"):
            self.next()
            self.takes("*")
            if not self.sees(")", "]", "}", ",", ";") and not self.now.newline:
                self.assignment(no_in)
            return Node("unknown", start, self.last_end(), what="yield")
        left = self.conditional(no_in)
        if self.now.type == "p" and self.now.text in _ASSIGN:
            op = self.next().text
            right = self.assignment(no_in)
            return Node("assign", start, right.end, op=op, left=left, right=right)
        return left

    def conditional(self, no_in: bool) -> Node:
        test = self.binary(0, no_in)
        if not self.takes("?"):
            return test
        then = self.assignment()
        self.wants(":")
        other = self.assignment(no_in)
        return Node("conditional", test.start, other.end, test=test, then=then, other=other)

    def binary(self, least: int, no_in: bool) -> Node:
        left = self.unary()
        while True:
            if self.sees("as", "satisfies") and not self.now.newline:
                self.next()
                self.type_()
                left = Node("wrapped", left.start, self.last_end(), value=left)
                continue
            op = self.now.text if self.isnt_string() else ""
            binding = _BINDING.get(op, 0)
            if binding <= least or (op == "in" and no_in):
                return left
            self.next()
            right = self.binary(binding - (op == "**"), no_in)
            left = Node("binary", left.start, right.end, op=op, left=left, right=right)

    def unary(self) -> Node:
        start = self.now.start
        if self.isnt_string():
            word = self.now.text
            if word in ("!", "~", "+", "-", "++", "--"):
                self.next()
                value = self.unary()
                return Node("unary", start, value.end, op=word, value=value)
            if word in ("typeof", "delete", "void", "await") and self.peek().text not in (")", ",", ";", "=", "."):
                self.next()
                value = self.unary()
                return Node({"typeof": "literal", "delete": "literal"}.get(word, word), start, value.end, **({} if word in ("typeof", "delete") else {"value": value}))
            if word == "<":
                if found := self.attempt(lambda: self.type_arguments() and not self.sees(">") and self.now.type != "end"):
                    value = self.unary()
                    return Node("wrapped", start, value.end, value=value)
                del found
                return self.markup()
        value = self.postfix(self.primary())
        if self.sees("++", "--") and not self.now.newline:
            self.next()
            return Node("unary", start, self.last_end(), op="post", value=value)
        return value

    def markup(self) -> Node:
        """JSX is not followed: past the element, as far as brackets and tags tell."""
        start, depth = self.now.start, 0
        while self.now.type != "end":
            if self.sees("{"):
                self.skip_balanced()
                continue
            t = self.next()
            if t.text == "<":
                depth += -1 if self.sees("/") else 1
            if t.text == "/" and self.sees(">"):
                depth -= 0 if self.tokens[self.at - 2].text == "<" else 1
            if depth <= 0 and t.text == ">":
                break
        return Node("unknown", start, self.last_end(), what="markup")

    def arguments(self) -> list[Node]:
        out = []
        self.wants("(")
        while self.now.type != "end" and not self.sees(")"):
            here, start = self.at, self.now.start
            if self.takes("..."):
                value = self.assignment()
                out.append(Node("spread", start, value.end, value=value))
            else:
                out.append(self.assignment())
            if not self.takes(",") and self.at == here:
                self.next()
        self.wants(")")
        return out

    def _call_types(self) -> bool:
        return self.type_arguments() and (self.sees("(") or self.now.type == "template")

    def postfix(self, value: Node, calls: bool = True) -> Node:
        start = value.start
        while True:
            if self.takes("."):
                value = Node("member", start, self.now.end, base=value, name=self.next().text)
            elif self.sees("?.") and self.peek().text not in ("(", "["):
                self.next()
                value = Node("member", start, self.now.end, base=value, name=self.next().text)
            elif self.sees("[") or (self.sees("?.") and self.peek().text == "["):
                self.takes("?.")
                self.next()
                key = self.expression()
                self.wants("]")
                value = Node("index", start, self.last_end(), base=value, key=key)
            elif calls and (self.sees("(") or (self.sees("?.") and self.peek().text == "(")):
                self.takes("?.")
                args = self.arguments()
                value = Node("call", start, self.last_end(), callee=value, args=args)
            elif self.sees("!") and not self.now.newline and self.peek().text not in ("=",):
                self.next()
                value = Node("wrapped", start, self.last_end(), value=value)
            elif calls and self.sees("<") and self.attempt(self._call_types):
                continue
            elif self.now.type == "template":
                self.next()
                value = Node("unknown", start, self.last_end(), what="tagged template")
            else:
                return value

    def primary(self) -> Node:
        t, start = self.now, self.now.start
        done = lambda kind, **f: Node(kind, start, self.last_end(), **f)
        if t.type in ("num", "str", "regex"):
            self.next()
            return done("literal")
        if t.type == "template":
            self.next()
            parts = []
            for begin, end in t.spans:
                inner = Parser(self.source, begin, end)
                if inner.now.type != "end":
                    parts.append(inner.expression())
            return done("template", parts=parts) if t.spans else done("literal")
        if t.type == "id":
            if t.text == "function" or (t.text == "async" and self.peek().text == "function"):
                return self.function()
            if t.text == "class":
                return self.class_()
            if t.text == "new":
                self.next()
                if self.takes("."):
                    self.next()
                    return done("self")
                callee = self.postfix(self.primary(), calls=False)
                if self.sees("<"):
                    self.attempt(self._call_types)
                args = self.arguments() if self.sees("(") else []
                return done("call", callee=callee, args=args)
            self.next()
            if t.text == "this" or (t.text == "import" and self.sees(".")):
                while t.text == "import" and self.takes("."):
                    self.next()
                return done("self")
            if t.text in ("true", "false", "null"):
                return done("literal")
            if t.text == "super":
                return done("unknown", what="super")
            return done("name", text=t.text)
        if self.sees("("):
            self.next()
            value = self.expression() if not self.sees(")") else Node("unknown", start, start, what="empty parentheses")
            self.wants(")")
            return done("wrapped", value=value)
        if self.sees("["):
            self.next()
            items = []
            while self.now.type != "end" and not self.sees("]"):
                if self.takes(","):
                    continue
                here, begin = self.at, self.now.start
                if self.takes("..."):
                    value = self.assignment()
                    items.append(Node("spread", begin, value.end, value=value))
                else:
                    items.append(self.assignment())
                if self.at == here:
                    self.next()
            self.wants("]")
            return done("array", items=items)
        if self.sees("{"):
            return self.object_()
        self.problems.append((start, f"unexpected {t.text or 'end'}"))
        if t.text not in (")", "]", "}", ",", ";", ":"):
            self.next()
        return Node("unknown", start, max(start, self.last_end()), what=t.text)

    def object_(self) -> Node:
        start, parts = self.next().start, []
        while self.now.type != "end" and not self.sees("}"):
            if self.takes(","):
                continue
            here, begin = self.at, self.now.start
            if self.takes("..."):
                value = self.assignment()
                parts.append(Node("property", begin, value.end, key=None, value=value))
                continue
            while self.sees("async", "get", "set", "*") and self.peek().text not in (",", ":", "(", "}", "="):
                self.next()
            if self.sees("["):
                key = "[computed]"
                self.skip_balanced()
            else:
                key = self.next().text
            if self.takes(":"):
                value = self.assignment()
                parts.append(Node("property", begin, value.end, key=key, value=value))
            elif self.sees("(", "<"):
                method = self.function_rest(begin, key.strip("'\""), "method")
                parts.append(Node("property", begin, method.end, key=key, value=method))
            else:
                name = Node("name", begin, self.last_end(), text=key)
                if self.takes("="):
                    self.assignment()
                parts.append(Node("property", begin, self.last_end(), key=key, value=name))
            if self.at == here:
                self.next()
        self.wants("}")
        return Node("object", start, self.last_end(), properties=parts)


def parse(source: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Statements, and (offset, message) of what didn't parse."""
    parser = Parser(source)
    return parser.program(), parser.problems
