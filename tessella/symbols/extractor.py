"""Symbols of C# source text, by a tokenizer and a declaration reader.

No compiler is at hand, so declarations are recognised by their token shapes:
types (class, interface, struct, enum) with their bases, and of their members
methods, properties and fields that the rules admit. Bodies are only searched
for names and calls. Text that is no valid C# gives what can be recognised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.symbols.model import FILE_SYMBOLS

#: Methods that the Unity engine calls by name.
UNITY_MESSAGES = frozenset(
    """Awake Start Update FixedUpdate LateUpdate OnEnable OnDisable OnDestroy
    OnTriggerEnter OnTriggerExit OnTriggerStay OnTriggerEnter2D OnTriggerExit2D OnTriggerStay2D
    OnCollisionEnter OnCollisionExit OnCollisionStay OnCollisionEnter2D OnCollisionExit2D OnCollisionStay2D
    OnMouseDown OnMouseUp OnMouseEnter OnMouseExit OnGUI OnDrawGizmos OnDrawGizmosSelected
    OnValidate Reset OnApplicationQuit OnApplicationPause""".split()
)
#: Receivers whose calls are kept, and the call that always is.
CALL_RECEIVERS, CALL_NAME = ("Debug", "Physics", "Input"), "GetComponent"
_KINDS = ("class", "interface", "struct", "enum")
_MODIFIERS = frozenset("public private protected internal static abstract sealed virtual override readonly const async partial extern new unsafe volatile required file ref".split())
_KEYWORDS = frozenset(
    """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum
    event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null
    object operator out override params private protected public readonly ref return sbyte sealed short sizeof stackalloc static string
    struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void volatile while""".split()
)
_TOKEN = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*\#[^\n]*|(?P<text>\$?@\"(?:[^\"]|\"\")*\"|@?\$\"(?:\\.|[^\"\\\n])*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+')|(?P<name>@?[A-Za-z_]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|::|\?\.|\?\?|[-+*/%&|^!<>=]=|&&|\|\||\+\+|--|[^\s\w])",
    re.S | re.M,
)
_HOLE = re.compile(r"\{([^{}]*)\}")


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    start: int
    end: int


def tokens(source: str) -> list[Token]:
    """Tokens without comments, white space and preprocessor lines."""
    out, line, last = [], 1, 0
    for m in _TOKEN.finditer(source):
        line += source.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], line, m.start(), m.end()))
    return out


class _Reader:
    def __init__(self, source: str):
        self.source, self.t = source, tokens(source)
        self.symbols: list[dict] = []
        self.usings: list[str] = []
        self.types: dict[str, None] = {}
        self.calls: dict[str, None] = {}
        self.declared: set[int] = set()  # tokens that name what is declared, which is no reference
        self.bases_at: dict[int, list[str]] = {}  # bases count as used where their type begins
        self.close = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Index of the closing token of each opening bracket."""
        out, open_ = {}, []
        for i, t in enumerate(self.t):
            if t.kind == "mark" and t.text in "([{":
                open_.append(i)
            elif t.kind == "mark" and t.text in ")]}":
                while open_ and "([{".index(self.t[open_[-1]].text) != ")]}".index(t.text):
                    open_.pop()
                if open_:
                    out[open_.pop()] = i
        return out

    def is_mark(self, i: int, *texts: str) -> bool:
        return i < len(self.t) and self.t[i].kind == "mark" and self.t[i].text in texts

    def end_of(self, i: int) -> int:
        return self.close.get(i, len(self.t) - 1)

    def raw(self, i: int, j: int) -> str:
        """Source of tokens i..j-1."""
        return re.sub(r"\s+", " ", self.source[self.t[i].start : self.t[j - 1].end]) if i < j else ""

    def angled(self, i: int) -> int:
        """Index after a type argument list that opens at i, or i if it is none."""
        if not self.is_mark(i, "<"):
            return i
        depth = 0
        for j in range(i, min(i + 200, len(self.t))):
            text = self.t[j].text
            if text == "<":
                depth += 1
            elif text == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif not (self.t[j].kind == "name" or text in (",", ".", "?", "[", "]", "::", "(", ")")):
                return i
        return i

    def type_end(self, i: int) -> int:
        """Index after the type that begins at i, or i if there is none."""
        j = i
        if self.is_mark(j, "("):  # a tuple
            j = self.end_of(j) + 1
        elif j < len(self.t) and self.t[j].kind == "name":
            j = self.angled(j + 1)
            while self.is_mark(j, ".", "::") and j + 1 < len(self.t) and self.t[j + 1].kind == "name":
                j = self.angled(j + 2)
        else:
            return i
        while self.is_mark(j, "?", "*") or (self.is_mark(j, "[") and all(self.t[k].text == "," for k in range(j + 1, self.end_of(j)))):
            j = self.end_of(j) + 1 if self.t[j].text == "[" else j + 1
        return j

    def attributes(self, i: int) -> tuple[int, list[str]]:
        """Attribute lists at i: index after them, and each attribute's source."""
        out = []
        while self.is_mark(i, "["):
            end, at, depth = self.end_of(i), i + 1, 0
            for j in range(i + 1, end + 1):
                text = self.t[j].text
                if j == end or (text == "," and not depth):
                    if at < j:
                        out.append(self.raw(at, j))
                    at = j + 1
                elif self.t[j].kind == "mark":
                    depth += (text in "([{") - (text in ")]}")
            i = end + 1
        return i, out

    def space(self, i: int, end: int, namespace: str | None) -> None:
        """Declarations of a namespace or file between two tokens."""
        while i < end:
            t = self.t[i]
            if t.text == "using" and t.kind == "name":
                j = i
                while j < end and not self.is_mark(j, ";"):
                    j += 1
                names = [k for k in range(i + 1, j) if self.t[k].text != "static"]
                equals = next((k for k in names if self.t[k].text == "="), None)
                names = [k for k in names if equals is None or k > equals]
                if names:
                    self.usings.append(self.raw(names[0], names[-1] + 1))
                i = j + 1
            elif t.text == "namespace" and t.kind == "name":
                j = i + 1
                while j < end and not self.is_mark(j, "{", ";"):
                    j += 1
                name = self.raw(i + 1, j)
                if self.is_mark(j, ";"):
                    namespace, i = name, j + 1
                else:
                    self.space(j + 1, self.end_of(j), name)
                    i = self.end_of(j) + 1
            else:
                after = self.declaration(i, end, namespace)
                i = after if after > i else i + 1

    def declaration(self, i: int, end: int, namespace: str | None) -> int:
        """Read a type declaration at i; index after it, or i if there is none."""
        first = i
        i, attributes = self.attributes(i)
        modifiers = []
        while i < end and self.t[i].kind == "name" and self.t[i].text in _MODIFIERS:
            modifiers.append(self.t[i].text)
            i += 1
        if i + 1 >= end or self.t[i].text not in _KINDS or self.t[i + 1].kind != "name":
            return first
        kind, name = self.t[i].text, self.t[i + 1].text
        self.declared.add(i + 1)
        j, bases = self.angled(i + 2), []
        if self.is_mark(j, "("):
            j = self.end_of(j) + 1
        if self.is_mark(j, ":"):
            at = j + 1
            while True:
                stop = self.type_end(at)
                if stop == at:
                    break
                bases.append(self.raw(at, stop))
                j = at = stop
                if not self.is_mark(at, ","):
                    break
                at += 1
        while j < end and not self.is_mark(j, "{", ";"):
            j += 1
        close = self.end_of(j) if self.is_mark(j, "{") else j
        symbol = {
            "name": name, "kind": kind, "namespace": namespace, "line": self.t[first].line, "endLine": self.t[min(close, len(self.t) - 1)].line,
            "modifiers": modifiers, "bases": (bases or None) if kind != "enum" else None, "attributes": attributes, "members": None,
        }
        self.symbols.append(symbol)
        if kind != "enum":
            self.bases_at[first] = bases
        if self.is_mark(j, "{"):
            found = self.enum_members(j + 1, close) if kind == "enum" else self.members(j + 1, close, namespace)
            symbol["members"] = found or None
        return close + 1

    def enum_members(self, i: int, end: int) -> list[dict]:
        out = []
        while i < end:
            line = self.t[i].line
            i, attributes = self.attributes(i)
            if i < end and self.t[i].kind == "name":
                self.declared.add(i)
                out.append({"name": self.t[i].text, "kind": "enumMember", "line": line, "signature": None, "modifiers": [], "attributes": attributes, "isUnityMessage": None})
            while i < end and not self.is_mark(i, ","):
                i = self.end_of(i) + 1 if self.is_mark(i, "(", "[", "{") else i + 1
            i += 1
        return out

    def members(self, i: int, end: int, namespace: str | None) -> list[dict]:
        out = []
        while i < end:
            after = self.declaration(i, end, namespace)
            if after > i:
                i = after
                continue
            first = i
            i, attributes = self.attributes(i)
            modifiers = []
            while i < end and self.t[i].kind == "name" and self.t[i].text in _MODIFIERS:
                modifiers.append(self.t[i].text)
                i += 1
            member, i = self.member(i, end, modifiers, attributes, self.t[first].line if first < len(self.t) else 0)
            if member:
                out.append(member)
            i = max(i, first + 1)
        return out

    def member(self, i: int, end: int, modifiers: list[str], attributes: list[str], line: int) -> tuple[dict | None, int]:
        event = i < end and self.t[i].text in ("event", "delegate")
        stop = self.type_end(i + event)
        named = stop > i + event and stop < end and self.t[stop].kind == "name"
        name_at = stop
        if named:
            self.declared.add(name_at)
        elif i < end and self.t[i].kind == "name" and self.is_mark(i + 1, "("):
            self.declared.add(i)  # a constructor
        j = self.angled(stop + 1) if named else i
        finish = self.member_end(i, end)
        if not named or event:
            return None, finish
        kind_type, name = self.raw(i, stop), self.t[name_at].text
        base = {"name": name, "line": line, "modifiers": modifiers, "attributes": attributes, "isUnityMessage": None}
        open_ = "public" in modifiers or "protected" in modifiers
        lead = " ".join(modifiers)
        if self.is_mark(j, "("):
            message = name in UNITY_MESSAGES
            shown = f"{lead} {kind_type} {name}({self.parameters(j)})".strip()
            return (base | {"kind": "method", "signature": shown, "isUnityMessage": True if message else None}) if open_ or message else None, finish
        if self.is_mark(j, "{", "=>"):
            shown = f"{lead} {kind_type} {name}{self.accessors(j)}".strip()
            return (base | {"kind": "property", "signature": shown}) if open_ else None, finish
        if self.is_mark(j, ";", "=", ","):
            shown = f"{lead} {kind_type} {name}".strip()
            serialized = any("SerializeField" in a or "SerializeReference" in a for a in attributes)
            k = j
            while k < finish:  # further declarators
                if self.is_mark(k, ",") and k + 1 < finish and self.t[k + 1].kind == "name" and self.is_mark(k + 2, "=", ",", ";"):
                    self.declared.add(k + 1)
                k = self.end_of(k) + 1 if self.is_mark(k, "(", "[", "{") else k + 1
            return (base | {"kind": "field", "signature": shown}) if "public" in modifiers or serialized else None, finish
        return None, finish

    def member_end(self, i: int, end: int) -> int:
        """Index after a member: its body, or its semicolon."""
        arrow = False
        while i < end:
            if self.is_mark(i, ";"):
                return i + 1
            arrow = arrow or self.is_mark(i, "=>", "=")
            if self.is_mark(i, "{") and not arrow:
                i = self.end_of(i) + 1
                if self.is_mark(i, "="):  # a property with an initial value
                    arrow = True
                    continue
                return i
            i = self.end_of(i) + 1 if self.is_mark(i, "(", "[", "{") else i + 1
        return end

    def parameters(self, i: int) -> str:
        end, out = self.end_of(i), []
        i += 1
        while i < end:
            i, _ = self.attributes(i)
            while i < end and self.t[i].text in ("ref", "out", "in", "params", "this", "scoped"):
                i += 1
            stop = self.type_end(i)
            if stop == i or stop >= end:
                break
            out.append(f"{self.raw(i, stop)} {self.t[stop].text}")
            self.declared.add(stop)
            i = stop + 1
            while i < end and not self.is_mark(i, ","):
                i = self.end_of(i) + 1 if self.is_mark(i, "(", "[", "{") else i + 1
            i += 1
        return ", ".join(out)

    def accessors(self, i: int) -> str:
        if not self.is_mark(i, "{"):
            return ""
        names, j = [], i + 1
        while j < self.end_of(i):
            if self.t[j].text in ("get", "set", "init"):
                names.append(self.t[j].text)
            j = self.end_of(j) + 1 if self.is_mark(j, "{", "[") else j + 1
        shown = [n for n in ("get", "set") if n in names]
        return " { " + " ".join(n + ";" for n in shown) + " }" if shown else ""

    def references(self) -> None:
        """Names that are used, and calls that are kept, in source order."""
        for i, t in enumerate(self.t):
            self.types.update(dict.fromkeys(self.bases_at.get(i, ())))
            if t.kind == "text" and "$" in t.text[:2]:
                for hole in _HOLE.findall(t.text):
                    for x in tokens(hole):
                        if x.kind == "name" and x.text not in _KEYWORDS:
                            self.types.setdefault(x.text)
            if t.kind != "name" or t.text in _KEYWORDS or i in self.declared or t.text in ("get", "set", "init", "where", "record"):
                continue
            if not self._declares_local(i):
                self.types.setdefault(t.text.lstrip("@"))
            after = self.angled(i + 1)
            if self.is_mark(after, "("):
                self._call(i, after)

    def _declares_local(self, i: int) -> bool:
        """Whether the token names a local variable in its declaration."""
        if i == 0 or not self.is_mark(i + 1, "=", ";", ",") and not (i + 1 < len(self.t) and self.t[i + 1].text == "in"):
            return False
        before = self.t[i - 1]
        return before.kind == "name" and (before.text not in _KEYWORDS or before.text in ("var", "int", "float", "string", "bool", "double", "long", "object", "char", "byte")) and before.text not in ("return", "new", "in", "await")

    def _call(self, i: int, after: int) -> None:
        start = i
        while start >= 2 and self.is_mark(start - 1, "."):
            previous = start - 2
            if self.is_mark(previous, ")", "]"):
                opening = next((a for a, b in self.close.items() if b == previous), None)
                if opening is None:
                    break
                previous = opening - 1 if opening and self.t[opening - 1].kind == "name" else opening
            elif self.t[previous].kind != "name":
                break
            start = previous
        text = self.raw(start, after)
        receiver = self.raw(start, i - 1) if start < i else ""
        if CALL_NAME in text or any(r in receiver for r in CALL_RECEIVERS):
            self.calls.setdefault(text)

    def read(self) -> dict:
        self.space(0, len(self.t), None)
        self.references()
        return {"symbols": self.symbols, "usings": self.usings, "dependencies": {"types": list(self.types), "calls": list(self.calls)}}


def extract_symbols(source: str) -> dict:
    """{symbols, usings, dependencies} of one source text."""
    return _Reader(source.lstrip("﻿")).read()


#: Extractors by file extension; register others here.
EXTRACTORS = {".cs": extract_symbols}


def extract(files: DataFrame) -> DataFrame:
    """FILE_SYMBOLS of rows (path, relativePath, content), read on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(FILE_SYMBOLS)
        for batch in batches:
            rows = []
            for path, relative, content in zip(*(batch.column(c).to_pylist() for c in ("path", "relativePath", "content")), strict=True):
                reader = next((f for x, f in EXTRACTORS.items() if path.endswith(x)), extract_symbols)
                rows.append({"file": path, "relativePath": relative} | reader(content.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "relativePath", "content").mapInArrow(run, FILE_SYMBOLS)
