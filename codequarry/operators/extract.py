"""Facts from JavaScript and TypeScript source text.

Two tiers. The pattern tier is Catalyst expressions: it finds declarations, imports, exports and markers by pattern and knows no scopes. The scanner
tier reads tokens with a stack of scopes, one file at a time and files in parallel, and yields the facts that the resolver takes. A file that
can't be scanned yields an error row; it never fails the job.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import code as C

# The pattern tier.

#: What each kind of fact looks like; group 1 is the name.
PATTERNS = {
    "function": r"(?:export\s+)?(?:async\s+)?function\s+(\w+)",
    "class": r"(?:export\s+)?class\s+(\w+)",
    "interface": r"(?:export\s+)?interface\s+(\w+)",
    "import": r"import\s+.*from\s+['\"]([^'\"]+)['\"]",
    "export": r"export\s+(?:const|let|var|function|class|interface)\s+(\w+)",
}
MARKER = r"//\s*(TODO|FIXME|HACK|XXX|NOTE):?[ \t]*(\S[^\n]*)"


def pattern_facts(files: DataFrame) -> DataFrame:
    """path, kind, place (from 0 within the kind), name. files: path, text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), 1).alias("names")) for k, p in PATTERNS.items()])
    rows = files.select("path", F.explode(kinds).alias("k"))
    return rows.select("path", "k.kind", F.posexplode("k.names").alias("place", "name"))


def markers(files: DataFrame) -> DataFrame:
    """path, line (from 1), marker_type, text, marker_id, one for each line comment with a marker."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("i", "content")).where(F.col("content").contains("//"))
    kind, text = F.regexp_extract("content", MARKER, 1), F.regexp_extract("content", MARKER, 2)
    found = lines.select("path", (F.col("i") + 1).alias("line"), kind.alias("marker_type"), F.trim(text).alias("text")).where("marker_type <> ''")
    return found.withColumn("marker_id", F.concat_ws(":", "path", "marker_type", F.col("line").cast("string")))


# The scanner tier.

_TOKEN = re.compile(
    r"(?P<space>[ \t\r\f\v ﻿]+)|(?P<line>\n)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|$))"
    r"|(?P<string>'(?:[^'\\\n]|\\[\s\S])*'?|\"(?:[^\"\\\n]|\\[\s\S])*\"?|`(?:[^`\\]|\\[\s\S])*`?)"
    r"|(?P<name>[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*)|(?P<number>\d[\w.]*)|(?P<sign>=>|\?\.|\.\.\.|[^\s\w])"
)
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_MARKER = re.compile(r"//\s*(TODO|FIXME|HACK|XXX|NOTE):?[ \t]*(.*)")
#: Words before `(` that are no calls; words after which a slash begins a pattern; words before a member; calls that name tests.
_NO_CALL = {"async", "if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "constructor", "super", "import", "with", "of", "in", "new", "delete", "void", "yield", "throw", "else", "do", "case"}
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do"}
_MODIFIERS = {"static", "async", "public", "private", "protected", "get", "set", "readonly", "override", "abstract", "declare", "accessor"}
_TESTS = {"it", "test", "describe"}
#: Files whose facts leave a task together.
TOGETHER = 50


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Found:
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    exports: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    tests: list = field(default_factory=list)
    markers: list = field(default_factory=list)


def tokenise(text: str, found: Found) -> list[Token]:
    tokens: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        last = tokens[-1] if tokens else None
        if text[at] == "/" and text[at + 1 : at + 2] not in ("/", "*") and (last is None or (last.kind == "sign" and last.text not in ")]}") or last.text in _BEFORE_PATTERN):
            m = _REGEX.match(text, at)
            if m:
                tokens.append(Token("string", m[0], line))
                at = m.end()
                continue
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        kind, s = m.lastgroup, m[0]
        if kind == "comment" and (mark := _MARKER.match(s)):
            found.markers.append((mark[1], mark[2].strip(), line))
        elif kind in ("string", "name", "number", "sign"):
            tokens.append(Token(kind, s, line))
        line += s.count("\n")
        at = m.end()
    return tokens


def _closing(tokens: list[Token]) -> dict[int, int]:
    """For each opening bracket, the index of the bracket that closes it; for an unclosed one, the last token."""
    pairs, stack = {}, []
    close = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(tokens):
        if t.kind != "sign":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in close:
            while stack:
                k = stack.pop()
                pairs[k] = i
                if tokens[k].text == close[t.text]:
                    break
    return {**{k: len(tokens) - 1 for k in stack}, **pairs}


class Scanner:
    """One file's facts, in the order of the source."""

    def __init__(self, text: str) -> None:
        self.found = Found()
        self.t = tokenise(text, self.found)
        self.ends = _closing(self.t)
        self.starts = {end: k for k, end in self.ends.items()}

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def scan(self) -> Found:
        self._block(0, len(self.t), at_module=True)
        self._calls()
        return self.found

    def _skip(self, i: int) -> int:
        return self.ends[i] + 1 if i in self.ends else i + 1

    def _body(self, i: int, end: int) -> int:
        """The index of the `{` of a declaration's body, past its parameters and types; -1 if a statement ends before one."""
        while i < end:
            s = self.text(i)
            if s == "{" and self.text(i - 1) not in (":", "|", "&", "<", ","):
                return i
            if s == ";":
                return -1
            i = self._skip(i) if s in ("(", "[", "{") else i + 1
        return -1

    def _line(self, i: int) -> int:
        return self.t[max(0, min(i, len(self.t) - 1))].line

    def _symbol(self, name: str, kind: str, start: int, end: int) -> None:
        self.found.symbols.append((name, kind, self._line(start), self._line(end)))

    def _block(self, i: int, end: int, at_module: bool) -> None:
        while i < end:
            i = self._statement(i, end, at_module)

    def _statement(self, i: int, end: int, at_module: bool) -> int:
        start, exported, default = i, False, False
        if self.text(i) == "import" and self.text(i + 1) not in ("(", "."):
            return self._import(i, end)
        if self.text(i) == "export":
            if self.text(i + 1) in ("{", "*") or (self.text(i + 1) == "type" and self.text(i + 2) == "{"):
                return self._export_list(i, end)
            exported, i = True, i + 1
            if self.text(i) == "default":
                default, i = True, i + 1
        while self.text(i) in ("async", "abstract", "declare") and self.text(i + 1) in ("function", "class", "abstract", "const", "let", "var", "enum", "interface"):
            i += 1
        word = self.text(i)
        if word == "function":
            k = i + 1 + (self.text(i + 1) == "*")
            name = self.text(k) if self.t[k].kind == "name" else ""
            body = self._body(k, end)
            stop = self.ends.get(body, body) if body >= 0 else k
            if name:
                self._symbol(name, "function", start, stop)
            self._exported(exported, default, name, start)
            if body >= 0:
                self._block(body + 1, stop, False)
            return max(stop, k) + 1
        if word == "class":
            name = self.text(i + 1) if self.text(i + 1) not in ("{", "extends") else ""
            body = self._body(i + 1, end)
            stop = self.ends.get(body, i + 1)
            if name:
                self._symbol(name, "class", start, stop)
            self._exported(exported, default, name, start)
            if body >= 0:
                self._members(body + 1, stop)
            return stop + 1
        if word in ("interface", "enum") and self.t[i + 1 if i + 1 < len(self.t) else i].kind == "name" and i + 1 < end:
            body = self._body(i + 2, end)
            stop = self.ends.get(body, i + 1)
            self._symbol(self.text(i + 1), word, start, stop)
            self._exported(exported and word == "interface", default, self.text(i + 1), start)
            return stop + 1
        if word in ("const", "let", "var"):
            if self.text(i + 1) == "enum":
                return self._statement(i + 1, end, at_module)
            return self._variables(i + 1, end, start, at_module, exported)
        if default:
            name = self.text(i) if i < end and self.t[i].kind == "name" else "default"
            self.found.exports.append((name, "default", self._line(start), None, None))
            return i
        if i < end and self.text(i) in ("{",):
            self._block(i + 1, self.ends[i], False)
            return self.ends[i] + 1
        return i + 1

    def _exported(self, exported: bool, default: bool, name: str, at: int) -> None:
        if exported:
            self.found.exports.append((name or "default", "default" if default else "named", self._line(at), None, None))

    def _variables(self, i: int, end: int, start: int, at_module: bool, exported: bool) -> int:
        """Declarators up to the statement's end; only those of the module are symbols."""
        while i < end:
            name = self.text(i) if self.t[i].kind == "name" else ""
            k, value, is_function = i + 1, -1, False
            while k < end and self.text(k) not in (",", ";"):
                s = self.text(k)
                if s == "=" and value < 0:
                    value = k + 1
                    while self.text(value) == "async":
                        value += 1
                    arrow = self.text(value) == "(" and self._arrow_after(self._skip(value), end) or (self.t[value].kind == "name" and self.text(value + 1) == "=>") if value < end else False
                    is_function = bool(arrow) or self.text(value) == "function"
                if s in ("(", "[", "{"):
                    if s == "{" and value >= 0:
                        self._block(k + 1, self.ends[k], False)
                    k = self._skip(k)
                elif k > i + 1 and self._breaks(k):
                    break
                else:
                    k += 1
            if at_module and name:
                self._symbol(name, "function" if is_function else "const", start, k - 1)
                self._exported(exported, False, name, start)
            if self.text(k) != ",":
                return k + (self.text(k) == ";")
            i = k + 1
        return i

    def _arrow_after(self, i: int, end: int) -> bool:
        """Whether `=>` follows, past a return type."""
        while i < end and self.text(i) not in (";", ",", "{", ")"):
            if self.text(i) == "=>":
                return True
            i = self._skip(i)
        return False

    def _breaks(self, k: int) -> bool:
        """Whether a statement ends before token k by a line's end."""
        a, b = self.t[k - 1], self.t[k]
        return b.line > a.line and (a.kind != "sign" or a.text in ")]}") and (b.kind != "sign" or b.text in "}{")

    def _members(self, i: int, end: int) -> None:
        while i < end:
            start = i
            while self.text(i) in _MODIFIERS and self.text(i + 1) not in ("(", "=", ";", ":", "?"):
                i += 1
            i += self.text(i) == "*"
            if self.t[i].kind == "name" and self.text(i + 1) in ("(", "<"):
                k = i + 1
                while k < end and self.text(k) != "(":
                    k += 1
                body = self._body(self._skip(k), end) if k < end else -1
                if body >= 0:
                    stop = self.ends[body]
                    self._symbol(self.text(i), "method", start, stop)
                    self._block(body + 1, stop, False)
                    i = stop + 1
                    continue
            k = i
            while k < end and self.text(k) != ";" and not (k > i and self._breaks(k)):
                k = self._skip(k)
            i = max(k + (self.text(k) == ";"), start + 1)

    def _import(self, i: int, end: int) -> int:
        line, k, names = self._line(i), i + 1 + (self.text(i + 1) == "type" and self.text(i + 2) != "from"), []
        while k < end and self.t[k].kind != "string" and self.text(k) != ";":
            s = self.text(k)
            if s == "{":
                names += self._listed(k)
                k = self._skip(k)
            elif s == "*":
                names.append((self.text(k + 2), "*", False, True))
                k += 3
            else:
                if self.t[k].kind == "name" and s != "from":
                    names.append((s, "default", True, False))
                k += 1
        if k < end and self.t[k].kind == "string":
            self.found.imports.append((self.t[k].text[1:-1], line, names))
        return k + 1

    def _listed(self, k: int) -> list[tuple[str, str, bool, bool]]:
        """(local, imported, is default, is namespace) of the names in braces."""
        out, i, end = [], k + 1, self.ends[k]
        while i < end:
            i += self.text(i) == "type" and self.text(i + 1) not in (",", "}", "as")
            name, other = self.text(i), self.text(i)
            if self.text(i + 1) == "as":
                other, i = self.text(i + 2), i + 2
            out.append((other, name, name == "default", False))
            while i < end and self.text(i) != ",":
                i += 1
            i += 1
        return out

    def _export_list(self, i: int, end: int) -> int:
        line, k = self._line(i), i + 1 + (self.text(i + 1) == "type")
        if self.text(k) == "*":
            listed, k = [("*", None)], k + 1
            if self.text(k) == "as":
                listed, k = [(self.text(k + 1), "*")], k + 2
        else:
            listed, k = [(out, name) for out, name, _, _ in self._listed(k)], self._skip(k)
        source = None
        if self.text(k) == "from" and k + 1 < end:
            source, k = self.t[k + 1].text[1:-1], k + 2
        for out, name in listed:
            self.found.exports.append((out, "default" if out == "default" else "named", line, source, None if name == out else name))
        return k

    def _calls(self) -> None:
        for k, t in enumerate(self.t):
            if t.text != "(" or t.kind != "sign" or k == 0:
                continue
            i = k - 1
            if self.text(i) == "]":
                base = self.starts.get(i, -1)
                if base > 0 and self.t[base - 1].kind == "name":
                    self.found.calls.append(("".join(x.text for x in self.t[base - 1 : k]), "dynamic", t.line, self._arguments(k)))
                continue
            if self.t[i].kind != "name" or self.text(i) in _NO_CALL and self.text(i - 1) != ".":
                continue
            first = i
            while self.text(first - 1) in (".", "?.") and self.t[first - 2].kind == "name":
                first -= 2
            if self.text(first - 1) in ("function", "new", "*") or self._declares(k, first) or self.text(first - 1) == "." and first - 1 > 0 and self.text(first - 2) not in (")", "]"):
                continue
            callee = "".join("." if x.text == "?." else x.text for x in self.t[first:k])
            chained = self.text(first - 1) in (".", "?.")
            kind = "dynamic" if chained and "." not in callee else "method" if "." in callee or chained else "direct"
            if not chained:
                self.found.calls.append((callee, kind, t.line, self._arguments(k)))
            if callee in _TESTS and k + 1 < len(self.t) and self.t[k + 1].kind == "string":
                self.found.tests.append((self.t[k + 1].text[1:-1], t.line, self._line(self.ends.get(k, k))))

    def _declares(self, k: int, first: int) -> bool:
        """Whether the name before ( is a method's: its body follows the parameters, and no statement could hold a call there."""
        after = self.ends.get(k, k) + 1
        if self.text(after) == ":" and self.text(first - 1) in ("}", "{", ";", "async", "static", *_MODIFIERS):
            return self._body(after, len(self.t)) >= 0
        return self.text(after) == "{" and self.text(first - 1) not in ("=", "(", ",", "return", "=>", "await", "&&", "||", "!", ".")

    def _arguments(self, k: int) -> list[str]:
        out, i, end = [], k + 1, self.ends.get(k, k)
        while i < end:
            if self.t[i].kind == "name" and self.text(i - 1) in ("(", ",") and self.text(i + 1) in (",", ")"):
                out.append(self.text(i))
            i = self._skip(i)
        return out


_FACTS = (
    "path string, language string, is_test boolean, test_framework string, symbols array<struct<name:string,kind:string,start_line:int,end_line:int,ord:int>>,"
    " imports array<struct<specifier:string,line:int,stmt:int,local:string,imported:string,is_default:boolean,is_namespace:boolean,ord:int>>,"
    " exports array<struct<symbol_name:string,export_type:string,line:int,source_specifier:string,source_name:string,ord:int>>,"
    " calls array<struct<called_name:string,call_type:string,line:int,arguments:array<string>,ord:int>>, tests array<struct<test_name:string,start_line:int,end_line:int,ord:int>>,"
    " markers array<struct<marker_type:string,text:string,line:int,ord:int>>, error string"
)
_KEYS = {
    "symbols": ("name", "kind", "start_line", "end_line"), "exports": ("symbol_name", "export_type", "line", "source_specifier", "source_name"), "calls": ("called_name", "call_type", "line", "arguments"),
    "tests": ("test_name", "start_line", "end_line"), "markers": ("marker_type", "text", "line"),
}


def _row(text: str | None) -> dict:
    try:
        found, error = Scanner(text or "").scan(), None
    except (IndexError, KeyError, RecursionError) as x:
        found, error = Found(), f"{type(x).__name__}: {x}"
    row = {name: [dict(zip(keys, values, strict=True)) | {"ord": i} for i, values in enumerate(getattr(found, name))] for name, keys in _KEYS.items()}
    flat = [(spec, line, n, *m) for n, (spec, line, names) in enumerate(found.imports) for m in (names or [(None, None, False, False)])]
    row["imports"] = [dict(zip(("specifier", "line", "stmt", "local", "imported", "is_default", "is_namespace"), v, strict=True)) | {"ord": i} for i, v in enumerate(flat)]
    return row | {"error": error}


def scan(files: DataFrame) -> DataFrame:
    """One row a file with arrays of its facts. files: path, text. A null text has no facts."""
    rows = files.select("path", "text", C.language(F.col("path")).alias("language"), C.is_test(F.col("path")).alias("is_test"), C.test_framework(F.coalesce("text", F.lit(""))).alias("test_framework"))

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:  # Spark bounds the bytes of a batch of texts; their facts leave for a few files at a time
            for k in range(0, len(whole), TOGETHER):
                part = whole.iloc[k : k + TOGETHER]
                facts = pd.DataFrame([_row(t) for t in part["text"]], columns=["symbols", "imports", "exports", "calls", "tests", "markers", "error"])
                yield pd.concat([part.drop(columns="text").reset_index(drop=True), facts], axis=1)

    return rows.mapInPandas(batches, _FACTS)


def facts(scanned: DataFrame):
    """The resolver's fact tables of scanned files."""
    from codequarry.operators.resolve import Facts

    def table(name: str) -> DataFrame:
        return scanned.select(F.col("path").alias("file_path"), F.inline(name))

    def identified(df: DataFrame, name: str, *parts: Column) -> DataFrame:
        return df.withColumn(name, F.concat_ws(":", *parts))

    symbols = identified(table("symbols"), "symbol_id", F.col("file_path"), F.col("name"), F.col("start_line").cast("string"))
    tests = identified(table("tests"), "test_id", F.col("file_path"), F.col("test_name"), F.col("start_line").cast("string"))
    return Facts(files=scanned.select("path", "is_test"), symbols=symbols, tests=tests, imports=table("imports"), exports=table("exports"), calls=table("calls"))
