"""Facts of a C# file by syntax alone: a token stream read once, with a stack of declarations."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"(?P<gone>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|^\s*\#[^\n]*)"
    r"|(?P<str>\$?@\$?\"(?:[^\"]|\"\")*\"|\$?\"\"\".*?\"\"\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')"
    r"|(?P<id>@?[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|::|&&|\|\||[^\w\s])",
    re.S | re.M,
)
#: Words of the language, and names the reference treats as built in.
MODIFIERS = frozenset("public private protected internal static readonly sealed abstract virtual override async partial new const extern unsafe volatile required file".split())
TYPES = {"class": "Class", "interface": "Interface", "record": "Record", "struct": "Struct", "enum": "Enum"}
NOT_CALLED = frozenset("if for foreach while switch catch using lock return when typeof nameof sizeof default fixed checked unchecked await throw new base this get set init add remove where in is as and or not".split())
WRAPPERS = frozenset(
    "IEnumerable IReadOnlyList IReadOnlyCollection IList List ICollection Collection ISet HashSet IDictionary IReadOnlyDictionary Dictionary Queue Stack Nullable IObservable IQueryable IAsyncEnumerable".split()
)
FRAMEWORK = frozenset("Guid DateTime DateTimeOffset TimeSpan DateOnly TimeOnly CancellationToken Task ValueTask Action Func Predicate EventHandler Exception Uri StringBuilder Stream MemoryStream TextReader TextWriter".split())
PRIMITIVES = frozenset(
    "bool byte sbyte char decimal double float int uint nint nuint long ulong short ushort object string void dynamic var "
    "Boolean Byte SByte Char Decimal Double Single Int32 UInt32 IntPtr UIntPtr Int64 UInt64 Int16 UInt16 Object String Void".split()
)
PLAIN_ENDINGS = ("Status", "Type", "Stage", "Kind", "Mode")
VERBS = "Get Post Put Delete Patch Head Options".split()
MAPPED = {f"Map{v}": v.upper() for v in ("Get", "Post", "Put", "Delete", "Patch")}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, frozenset(")]}")


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Fact:
    fact: str
    line: int
    end_line: int
    kind: str | None = None
    name: str | None = None
    container: str | None = None
    namespace: str | None = None
    target: str | None = None
    detail: str | None = None


def tokens_of(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        if m.lastgroup != "gone":
            out.append(Token(m.lastgroup, m.group().lstrip("@") if m.lastgroup == "id" else m.group(), line))
    return out


def string_value(token: Token) -> str:
    return re.sub(r'^[$@]*"+|"+$', "", token.text)


def interface_name(name: str) -> bool:
    return bool(re.match(r"I[A-Z]", name.rsplit(".", 1)[-1]))


def unwrap(kind: str) -> str:
    """The element type of collections, arrays and nullables; the last part of a qualified name."""
    kind = re.sub(r"(\[[,\s]*\]|\?)+$", "", kind.strip())
    m = re.match(r"([\w.]+)\s*<(.*)>$", kind, re.S)
    if not m:
        return kind.rsplit(".", 1)[-1]
    outer = m[1].rsplit(".", 1)[-1]
    if outer not in WRAPPERS:
        return outer
    depth, begin, parts = 0, 0, []
    for i, c in enumerate(m[2] + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(m[2][begin:i])
            begin = i + 1
    return unwrap(parts[-1])


def depended_on(kind: str) -> str | None:
    name = unwrap(kind)
    if len(name) < 2 or not name[0].isupper() or name in PRIMITIVES or name in FRAMEWORK or name.endswith(PLAIN_ENDINGS):
        return None
    return name


def combine_routes(base: str | None, action: str | None, controller: str) -> str:
    name = re.sub("Controller$", "", controller)
    parts = [re.sub(r"(?i)\[controller\]", name, p).strip("/") for p in (base, action) if p]
    return "/" + "/".join(p for p in parts if p)


class Parser:
    def __init__(self, text: str):
        self.t = tokens_of(text)
        self.facts: list[Fact] = []
        self.contexts: set[str] = set()

    def close(self, i: int) -> int:
        """The place of the bracket that closes the one at i (or the end)."""
        depth = 0
        while i < len(self.t):
            x = self.t[i].text
            if self.t[i].kind == "op":
                depth += x in OPEN
                depth -= x in CLOSE
                if not depth:
                    return i
            i += 1
        return len(self.t) - 1

    def angle(self, i: int) -> int:
        """After a list of type arguments that begins at i, if one does; else i."""
        if i >= len(self.t) or self.t[i].text != "<":
            return i
        depth = 0
        for k in range(i, min(len(self.t), i + 80)):
            x = self.t[k].text
            depth += (x == "<") - (x == ">")
            if not depth:
                return k + 1
            if self.t[k].kind in ("str", "num") or x in "{};=&|":
                return i
        return i

    def joined(self, a: int, b: int) -> str:
        return "".join(x.text + (" " if x.kind == "id" and k + 1 < b and self.t[k + 1].kind == "id" else "") for k, x in enumerate(self.t[a:b], a))

    def run(self) -> list[Fact]:
        self.members(0, len(self.t), "", "", [], None)
        self.fluent()
        self.minimal()
        return self.facts

    def attributes(self, i: int) -> tuple[list[tuple[str, str | None]], int]:
        """Attributes at i as (name, first string argument)."""
        out = []
        while i < len(self.t) and self.t[i].text == "[":
            end = self.close(i)
            k = i + 1
            if k + 1 < end and self.t[k + 1].text == ":":
                k += 2
            while k < end:
                if self.t[k].kind == "id":
                    name = self.t[k].text
                    while k + 2 < end and self.t[k + 1].text == ".":
                        k += 2
                        name = self.t[k].text
                    value = None
                    if k + 1 < end and self.t[k + 1].text == "(":
                        stop = self.close(k + 1)
                        value = next((string_value(x) for x in self.t[k + 1 : stop] if x.kind == "str"), None)
                        k = stop
                    out.append((name.removesuffix("Attribute"), value))
                k += 1
            i = end + 1
        return out, i

    def members(self, i: int, end: int, namespace: str, container: str, attributes: list, owner: dict | None) -> None:
        while i < end:
            start = i
            attributes, i = self.attributes(i)
            modifiers = []
            while i < end and self.t[i].kind == "id" and self.t[i].text in MODIFIERS:
                modifiers.append(self.t[i].text)
                i += 1
            if i >= end:
                return
            word = self.t[i].text
            if word == "namespace":
                k = i + 1
                while k < end and self.t[k].text not in "{;":
                    k += 1
                name = ".".join(filter(None, (namespace, self.joined(i + 1, k))))
                if k < end and self.t[k].text == "{":
                    stop = self.close(k)
                    self.members(k + 1, stop, name, container, [], None)
                    i = stop + 1
                else:  # to the end of the file
                    namespace, i = name, k + 1
            elif word in TYPES and i + 1 < end and self.t[i + 1].kind == "id":
                i = self.declaration(i, end, start, namespace, container, attributes, modifiers)
            elif word in ("using", "delegate", "extern", "event") or word == "global":
                i = self.to(i, end, ";") + 1
            elif word in "};,":
                i += 1
            else:
                i = self.member(i, end, start, namespace, container, attributes, modifiers, owner)

    def to(self, i: int, end: int, stops: str) -> int:
        """The next of the stops outside brackets."""
        while i < end:
            x = self.t[i]
            if x.kind == "op":
                if x.text in stops:
                    return i
                if x.text in OPEN:
                    i = self.close(i)
                elif x.text == "=>" and "=>" in stops.split():
                    return i
            i += 1
        return end

    def declaration(self, i: int, end: int, start: int, namespace: str, container: str, attributes: list, modifiers: list) -> int:
        kind = TYPES[self.t[i].text]
        if kind == "Record" and self.t[i + 1].text in ("class", "struct"):
            i += 1
        name, line = self.t[i + 1].text, self.t[i].line
        k = self.angle(i + 2)
        parameters = None
        if k < end and self.t[k].text == "(":
            parameters = (k, self.close(k))
            k = parameters[1] + 1
        bases = []
        if k < end and self.t[k].text == ":":
            k += 1
            begin, first = k, self.t[min(k, end - 1)].line
            while k < end and self.t[k].text not in "{;" and self.t[k].text != "where":
                after = self.angle(k)
                if after > k:
                    k = after
                    continue
                if self.t[k].text == "(":
                    k = self.close(k)
                elif self.t[k].text == ",":
                    bases.append((self.joined(begin, k), first))
                    begin, first = k + 1, self.t[min(k + 1, end - 1)].line
                k += 1
            bases.append((self.joined(begin, k), first))
        while k < end and self.t[k].text not in "{;":
            k += 1
        stop = self.close(k) if k < end and self.t[k].text == "{" else min(k, end - 1)
        last = self.t[stop].line
        self.facts.append(Fact("symbol", line, last, kind, name, container or None, namespace or None, None, " ".join(modifiers) or None))
        names = [re.sub(r"<.*|\(.*", "", b).strip() for b, _ in bases]
        for n, ((_, at), base) in enumerate(zip(bases, names, strict=True)):
            known = kind in ("Interface", "Struct") or interface_name(base) or n > 0 and kind in ("Class", "Record")
            if base and kind != "Enum":
                self.facts.append(Fact("base", at, at, "Implements" if known and kind != "Interface" else "Inherits", name, None, namespace or None, base.rsplit(".", 1)[-1]))
        if any(b.rsplit(".", 1)[-1].endswith("DbContext") for b in names):
            self.contexts.add(name)
            self.facts.append(Fact("context", line, last, "DbContext", name, None, namespace or None))
        owner = {"name": name, "kind": kind, "route": next((v for a, v in attributes if a == "Route"), None), "keys": [], "controller": name.endswith("Controller") or any(a == "ApiController" for a, _ in attributes)}
        if parameters:
            self.parameters(*parameters, name, "constructor")
        if k < end and self.t[k].text == "{" and kind != "Enum":
            self.members(k + 1, stop, namespace, name, [], owner)
        table = next((v or name for a, v in attributes if a == "Table"), None)
        if (table or owner["keys"]) and name not in self.contexts and kind in ("Class", "Record"):
            self.facts.append(Fact("entity", line, last, "Table", name, None, namespace or None, table or name, ",".join(owner["keys"]) or None))
        return stop + 1

    def parameters(self, begin: int, end: int, owner: str, kind: str) -> None:
        k = begin + 1
        while k < end:
            _, k = self.attributes(k)
            stop = k
            while stop < end and self.t[stop].text != ",":
                after = self.angle(stop)
                stop = after if after > stop else (self.close(stop) + 1 if self.t[stop].text in OPEN else stop + 1)
            words = self.joined(k, stop).split("=")[0].rsplit(" ", 1)
            if len(words) == 2 and (target := depended_on(re.sub(r"^(this|ref|out|in|params) ", "", words[0]))):
                self.facts.append(Fact("dependency", self.t[k].line, self.t[k].line, kind, owner, None, None, target))
            k = stop + 1

    def member(self, i: int, end: int, start: int, namespace: str, container: str, attributes: list, modifiers: list, owner: dict | None) -> int:
        begin, k, call = i, i, None
        while k < end:
            x = self.t[k]
            if x.text == "(" and call is None and k > begin:
                call = k
                k = self.close(k)
            elif x.text in ("{", ";", "=>", "="):
                break
            elif x.text in OPEN:
                k = self.close(k)
            k += 1
        if k >= end:
            return end
        line = self.t[begin].line
        head = call if call is not None else k
        n = head - 1
        if n >= begin and self.t[n].text == ">":  # a generic method: back to its name
            depth = 0
            while n > begin:
                depth += (self.t[n].text == ">") - (self.t[n].text == "<")
                n -= 1
                if not depth:
                    break
        if n < begin or self.t[n].kind != "id" or owner is None:
            if self.t[k].text == "{":
                stop = self.close(k)
                self.calls(begin, stop, container or "global")
                return stop + 1
            stop = self.to(k, end, ";")
            self.calls(begin, stop, container or "global")
            return stop + 1
        name, kind = self.t[n].text, self.joined(begin, n)
        symbol = lambda what, last, shown=None: self.facts.append(Fact("symbol", line, last, what, shown or name, container or None, namespace or None, kind or None, " ".join(modifiers) or None))
        if call is not None:
            constructor = name == container and not kind
            if self.t[k].text == "{":
                stop = self.close(k)
            else:
                stop = self.to(k, end, ";")
            full = f"{container}..ctor" if constructor else f"{container}.{name}"
            symbol("Method", self.t[min(stop, len(self.t) - 1)].line, full if constructor else None)
            if constructor:
                self.parameters(call, self.close(call), container, "constructor")
            else:
                self.endpoint(attributes, name, owner, line)
            self.calls(self.close(call) + 1, stop, full)
            return stop + 1
        if self.t[k].text in ("{", "=>"):
            stop = self.close(k) if self.t[k].text == "{" else self.to(k, end, ";")
            symbol("Property", self.t[min(stop, len(self.t) - 1)].line)
            if container in self.contexts and (m := re.match(r"DbSet\s*<\s*([\w.]+)\s*>", kind)):
                self.facts.append(Fact("dbset", line, line, "DbSet", container, None, namespace or None, m[1].rsplit(".", 1)[-1], name))
            if any(a == "Key" for a, _ in attributes) or name in ("Id", f"{container}Id"):
                owner["keys"].append(name)
            if k + 1 < end and stop + 1 < end and self.t[stop + 1].text == "=":
                stop = self.to(stop + 1, end, ";")
            self.calls(k, stop, container)
            return stop + 1
        stop = self.to(k, end, ";")
        symbol("Field", self.t[min(stop, len(self.t) - 1)].line)
        if target := depended_on(kind):
            self.facts.append(Fact("dependency", line, line, "field", container, None, namespace or None, target))
        self.calls(k, stop, container)
        return stop + 1

    def endpoint(self, attributes: list, name: str, owner: dict, line: int) -> None:
        if not owner["controller"]:
            return
        route = next((v for a, v in attributes if a == "Route"), None)
        for attribute, value in attributes:
            verb = next((v for v in VERBS if attribute == f"Http{v}"), None)
            if verb:
                self.facts.append(Fact("endpoint", line, line, verb.upper(), combine_routes(owner["route"], value if value is not None else route, owner["name"]), None, None, f"{owner['name']}.{name}"))

    def calls(self, begin: int, end: int, caller: str) -> None:
        for k in range(begin, min(end, len(self.t))):
            x = self.t[k]
            if x.kind != "id" or x.text in NOT_CALLED:
                continue
            after = self.angle(k + 1)
            if after < len(self.t) and self.t[after].text == "(" and not (k and self.t[k - 1].text == "new"):
                b = k
                while b >= 2 and self.t[b - 1].text in (".", "?.") and self.t[b - 2].kind == "id":
                    b -= 2
                if b and self.t[b - 1].text == "new":
                    continue
                self.facts.append(Fact("call", x.line, x.line, "Calls", caller, None, None, x.text, self.joined(b, k + 1)))

    def fluent(self) -> None:
        """Relations set up in chains that have a Has and a With part."""
        principal = None
        for k, x in enumerate(self.t):
            if x.text == "Entity" and k + 3 < len(self.t) and self.t[k + 1].text == "<":
                principal = self.t[k + 2].text
            if x.text in ("HasOne", "HasMany") and principal:
                stop = self.to(k, len(self.t), ";")
                chain = self.t[k:stop]
                inverse = next((y.text for y in chain if y.text in ("WithOne", "WithMany")), None)
                if not inverse:
                    continue
                dependent = chain[2].text if len(chain) > 2 and chain[1].text == "<" else next((chain[n + 1].text for n, y in enumerate(chain[:-1]) if y.text == "." and chain[n + 1].kind == "id"), None)
                key = next((n for n, y in enumerate(chain) if y.text == "HasForeignKey"), None)
                foreign = next((y.text.strip('"') for y in reversed(chain[key + 1 : key + 8]) if y.kind in ("id", "str")), None) if key is not None else None
                many = {("HasMany", "WithOne"): "OneToMany", ("HasOne", "WithMany"): "ManyToOne", ("HasOne", "WithOne"): "OneToOne", ("HasMany", "WithMany"): "ManyToMany"}[x.text, inverse]
                if dependent:
                    self.facts.append(Fact("relation", x.line, chain[-1].line, many, principal, None, None, dependent, foreign))

    def minimal(self) -> None:
        for k, x in enumerate(self.t[:-1]):
            if x.text in MAPPED and k and self.t[k - 1].text == "." and self.t[self.angle(k + 1)].text == "(":
                stop = self.close(self.angle(k + 1))
                route = next((string_value(y) for y in self.t[k:stop] if y.kind == "str"), None)
                self.facts.append(Fact("endpoint", x.line, x.line, MAPPED[x.text], "/" + (route or "").strip("/"), None, None, f"MinimalApi:{x.text}"))


def parse(text: str) -> list[Fact]:
    return Parser(text or "").run()
