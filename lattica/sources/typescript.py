"""Facts of TypeScript sources, from tokens: exports, imports, call sites, size and complexity.

Each file is parsed on its own by the executors; names are then bound across
files by joins. A call is kept where its callee is declared in the tree: by a
name that is local or imported, a method of ``this``, of a field or variable
whose class is written down or constructed, of a class, or of a namespace.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import TEST_MARKS, dirname
from ..functions.lineage import cut
from ..plans.graph import CodeGraph, build_graph
from .commits import churn

#: So many of the files that can't be parsed are named in the warning, which counts all.
NAMED = 10

_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<id>[A-Za-z_$#@][\w$]*)|(?P<num>\d[\w.]*)"
    r"|(?P<op>=>|\?\?=?|&&=?|\|\|=?|\?\.(?!\d)|\.\.\.|[=!]==?|[<>]=|[-+*/%&|^]=|\+\+|--|.)",
    re.DOTALL,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_PLAIN = {"if", "for", "while", "switch", "catch", "return", "typeof", "function", "await", "super", "import", "require", "void", "delete", "in", "of", "new", "case", "do", "else", "throw", "yield", "async", "instanceof"}
_MODIFIERS = {"export", "default", "declare", "abstract", "async", "public", "private", "protected", "static", "readonly", "override", "get", "set", "accessor"}
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_GOES_ON = {".", "?.", "?", ":", "&&", "||", "??", "+", "-", "*", "/", "%", "=>", "=", ",", "|", "&", "<", ">", "(", "[", "==", "===", "!=", "!==", "instanceof", "as", "in", "satisfies"}


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, first line, last line); templates give the tokens of their expressions."""
    out: list[tuple[str, str, int, int]] = []
    line = at = 0

    def template(i: int) -> int:
        nonlocal line
        first = line
        i += 1
        while i < len(text) and text[i] != "`":
            if text[i] == "\\":
                line += text[i + 1 : i + 2] == "\n"
                i += 2
            elif text.startswith("${", i):
                i = scan(i + 2, True)
            else:
                line += text[i] == "\n"
                i += 1
        out.append(("str", "``", first, line))
        return i + 1

    def scan(i: int, inner: bool) -> int:
        nonlocal line
        depth = 0
        while i < len(text):
            c = text[i]
            if c == "`":
                i = template(i)
                continue
            if inner and c == "}" and depth == 0:
                return i + 1
            last = out[-1] if out else ("op", ";", 0, 0)
            if c == "/" and text[i + 1 : i + 2] not in ("/", "*") and (last[1] in _PLAIN or last[0] == "op" and last[1] not in (")", "]", "}")):
                m = _REGEX.match(text, i)
                if m:
                    out.append(("str", "//", line, line))
                    i = m.end()
                    continue
            m = _TOKEN.match(text, i)
            kind, word = m.lastgroup, m.group()
            end = line + word.count("\n")
            if kind != "skip":
                out.append((kind, word, line, end))
                depth += (word == "{") - (word == "}")
            line, i = end, m.end()
        return i

    scan(at, False)
    return out


class _File:
    """One pass over a file's tokens."""

    def __init__(self, text: str) -> None:
        self.t = tokens(text)
        self.words = [x[1] for x in self.t]
        self.pair: dict[int, int] = {}
        stack: list[int] = []
        for i, w in enumerate(self.words):
            if self.t[i][0] == "op" and w in _OPEN:
                stack.append(i)
            elif self.t[i][0] == "op" and w in _CLOSE and stack:
                self.pair[stack.pop()] = i
        self.loc = 0 if not text else text[:-1].count("\n") + 1
        self.decls: dict[str, tuple[str, int, int]] = {}
        self.exports: list[tuple] = []
        self.imports: list[tuple[str, list[str], bool]] = []
        self.bindings: list[tuple[str, str, str]] = []
        self.calls: list[tuple[str, str, str, str]] = []
        self.methods: set[tuple[str, str]] = set()
        self.types: dict[str, str] = {}
        self.fields: dict[tuple[str, str], str] = {}
        self._types()
        self._top()
        self._walk(0, len(self.words), "<module>", "")

    # -- small helpers

    def w(self, i: int) -> str:
        return self.words[i] if 0 <= i < len(self.words) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i][0] == "id"

    def lines(self, a: int, b: int) -> int:
        return self.t[min(b, len(self.t) - 1)][3] - self.t[a][2] + 1

    def complexity(self, a: int, b: int) -> int:
        n = 1
        for i in range(a, min(b + 1, len(self.t))):
            word = self.words[i]
            if self.t[i][0] == "id":
                n += word in ("if", "case", "catch", "for", "while") and self.w(i - 1) != "." and self.w(i + 1) != ":"
            elif self.t[i][0] == "op":
                n += word in ("&&", "||", "??") or word == "?" and self.w(i + 1) not in (":", ",", ")", "=", ";", "(")
        return n

    def skip_angles(self, i: int) -> int:
        """Past a <...> at i, or i."""
        depth, k = 0, i
        while k < len(self.words):
            w = self.w(k)
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if depth == 0:
                    return k + 1
            elif w in (";", "&&", "||") or depth == 0:
                return i
            k += 1
        return i

    def body(self, i: int, hi: int) -> int | None:
        """The brace that opens a body after a parameter list ends at i; None for a signature."""
        k = i + 1
        while k < hi:
            w = self.w(k)
            if w == "{":
                if self.w(k - 1) in (":", "|", "&", "<", ",", "=>", "[", "keyof", "is"):
                    k = self.pair.get(k, hi) + 1
                    continue
                return k
            if w in (";", "}") or w == "=":
                return None
            k = self.pair.get(k, k) + 1 if w in ("(", "[") else k + 1
        return None

    def end_of(self, i: int, hi: int, comma: bool = True) -> int:
        """Last token of the expression that starts at i."""
        k = last = i
        while k < hi:
            w = self.w(k)
            if w == ";" or w in _CLOSE or (comma and w == ","):
                return max(i, k - 1)
            if k > i and self.t[k][2] > self.t[last][3] and w not in _GOES_ON and self.w(last) not in _GOES_ON:
                return last
            last = self.pair.get(k, k) if w in _OPEN else k
            k = last + 1
        return max(i, hi - 1)

    def arrow(self, i: int, hi: int) -> bool:
        """Whether a function expression starts at i."""
        if self.w(i) == "async":
            i += 1
        if self.w(i) == "function":
            return True
        if self.w(i) == "<":
            i = self.skip_angles(i)
        if self.is_id(i) and self.w(i + 1) == "=>":
            return True
        if self.w(i) != "(":
            return False
        k = self.pair.get(i, hi) + 1
        if self.w(k) == ":":
            while k < hi and self.w(k) not in ("=>", ";", "="):
                k = self.pair.get(k, k) + 1
        return self.w(k) == "=>"

    # -- declarations

    def _types(self) -> None:
        for i, w in enumerate(self.words):
            if not self.is_id(i):
                continue
            k = i + 1 + (self.w(i + 1) in ("?", "!"))
            if self.w(k) == ":" and self.is_id(k + 1) and self.w(k + 1)[:1].isupper() and self.w(i - 1) != "?":
                self.types.setdefault(w, self.w(k + 1))
            if self.w(k) == "=" and self.w(k + 1) == "new" and self.is_id(k + 2):
                self.types[w] = self.w(k + 2)

    def _declare(self, i: int, exported: bool, default: bool, first: int) -> None:
        """The declaration whose keyword is at i; ``first`` is its first modifier."""
        word, hi = self.w(i), len(self.words)
        if word == "const" and self.w(i + 1) == "enum":
            i, word = i + 1, "enum"
        if word in ("const", "let", "var"):
            k = i + 1
            while k < hi:
                name, start = self.w(k), k
                if name in ("{", "["):
                    close = self.pair.get(k, hi)
                    names = [self.w(j) for j in range(k + 1, close) if self.is_id(j) and self.w(j + 1) in (",", "}", "]", "=")]
                    k = close + 1
                else:
                    names, k = [name], k + 1
                while k < hi and self.w(k) not in ("=", ",", ";") and self.t[k][2] == self.t[k - 1][3] or self.w(k) == "=>":
                    k = self.pair.get(k, k) + 1
                kind, end = "variable", k - 1
                if self.w(k) == "=":
                    kind = "function" if self.arrow(k + 1, hi) else "variable"
                    end = self.end_of(k + 1, hi)
                for n in names:
                    self.decls[n] = (kind, self.lines(start, end), self.complexity(start, end))
                    if exported:
                        self.exports.append((n, n, None, False))
                if self.w(end + 1) != ",":
                    return
                k = end + 2
            return
        kind = {"type": "type"}.get(word, word)
        k = i + 1 + (self.w(i + 1) == "*")
        name = self.w(k) if self.is_id(k) and self.w(k) not in ("extends", "implements") else "default"
        if word == "type":
            end = self.end_of(i + 1, hi, comma=False)
        elif word == "function":
            while k < hi and self.w(k) != "(":
                k += 1
            open_ = self.body(self.pair.get(k, hi), hi)
            if open_ is None:
                if name not in self.decls:
                    self.decls[name] = (kind, self.lines(first, min(self.pair.get(k, k), hi - 1)), 1)
                    if exported:
                        self.exports.append(("default" if default else name, name, None, False))
                return
            end = self.pair.get(open_, hi - 1)
        else:
            while k < hi and self.w(k) != "{":
                k += 1
            end = self.pair.get(k, hi - 1)
        self.decls[name] = (kind, self.lines(first, end), self.complexity(first, end))
        if exported and ("default" if default else name) not in [e[0] for e in self.exports]:
            self.exports.append(("default" if default else name, name, None, False))

    def _names(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, name as) in the braces from a to b."""
        out, k = [], a + 1
        while k < b:
            if self.w(k) == "type" and self.is_id(k + 1) and self.w(k + 1) != "as":
                k += 1
            name = self.w(k)
            if self.w(k + 1) == "as":
                out.append((name, self.w(k + 2)))
                k += 3
            else:
                out.append((name, name))
                k += 1
            k += self.w(k) == ","
        return out

    def _top(self) -> None:
        i, hi = 0, len(self.words)
        while i < hi:
            word, first = self.w(i), i
            if not self.is_id(i):
                i = self.pair.get(i, i) + 1
                continue
            if word == "import" and self.w(i + 1) not in ("(", "."):
                i = self._import(i)
                continue
            exported = default = False
            while self.w(i) in ("export", "default", "declare", "abstract", "async") and i < hi:
                exported |= self.w(i) == "export"
                default |= self.w(i) == "default"
                i += 1
            word = self.w(i)
            if exported and not default and (word in ("{", "*") or word == "type" and self.w(i + 1) in ("{", "*")):
                i = self._export_list(i)
            elif word in ("function", "class", "interface", "enum", "const", "let", "var") or word == "type" and self.is_id(i + 1):
                self._declare(i, exported, default, first)
                k = i + 1
                while k < hi and self.w(k) not in ("{", ";", "("):
                    k += 1
                i = self.end_of(i, hi, comma=False) + 1 if word in ("const", "let", "var", "type") else max(i + 1, (self.pair.get(k, k) if word != "function" else self.pair.get(self.body(self.pair.get(k, hi), hi) or k, k)) + 1)
            elif default:
                end = self.end_of(i, hi, comma=False)
                if self.is_id(i) and end == i:
                    self.exports.append(("default", word, None, False))
                else:
                    self.decls["default"] = ("variable", self.lines(first, end), self.complexity(first, end))
                    self.exports.append(("default", "default", None, False))
                i = end + 1
            else:
                i = max(i, first) + 1

    def _import(self, i: int) -> int:
        k, only = i + 1, False
        if self.w(k) == "type" and self.w(k + 1) not in ("from", ","):
            only, k = True, k + 1
        symbols: list[str] = []
        found: list[tuple[str, str]] = []
        while k < len(self.words) and self.t[k][0] != "str":
            w = self.w(k)
            if w == "{":
                end = self.pair.get(k, k)
                for name, alias in self._names(k, end):
                    symbols.append(alias)
                    found.append((alias, name))
                k = end + 1
            elif w == "*":
                symbols.append(f"* as {self.w(k + 2)}")
                found.append((self.w(k + 2), "*"))
                k += 3
            elif w == "=" or w == ";":
                return k + 1
            else:
                if self.is_id(k) and w != "from":
                    symbols.append("default")
                    found.append((w, "default"))
                k += 1
        if k < len(self.words):
            source = self.w(k)[1:-1]
            self.imports.append((source, symbols, only))
            self.bindings += [(local, source, name) for local, name in found]
        return k + 1

    def _export_list(self, i: int) -> int:
        only = self.w(i) == "type"
        i += only
        if self.w(i) == "*":
            spaced = self.w(i + 1) == "as"
            k = i + (4 if spaced else 2)
            source = self.w(k)[1:-1]
            self.imports.append((source, [] if spaced else ["*"], only))
            self.exports.append((self.w(i + 2), "*", source, False) if spaced else ("*", "*", source, True))
            return k + 1
        end = self.pair.get(i, i)
        names = self._names(i, end)
        if self.w(end + 1) == "from":
            source = self.w(end + 2)[1:-1]
            self.imports.append((source, [alias for _, alias in names], only))
            self.exports += [(alias, name, source, False) for name, alias in names]
            return end + 3
        self.exports += [(alias, name, None, False) for name, alias in names]
        return end + 1

    # -- calls

    def _walk(self, lo: int, hi: int, caller: str, cls: str) -> None:
        i = lo
        while i < hi:
            word = self.w(i)
            if not self.is_id(i):
                i += 1
            elif word == "import" and self.w(i + 1) not in ("(", ".") and caller == "<module>" and self.w(i - 1) != ".":
                while i < hi and self.t[i][0] != "str" and self.w(i) != ";":
                    i += 1
                i += 1
            elif word == "class" and self.w(i - 1) != ".":
                name = self.w(i + 1) if self.is_id(i + 1) and self.w(i + 1) not in ("extends", "implements") else ""
                k = i + 1
                while k < hi and self.w(k) != "{":
                    k += 1
                end = self.pair.get(k, hi)
                self._members(k + 1, end, caller, name)
                i = end + 1
            elif word in ("interface", "enum") and self.is_id(i + 1) and self.w(i - 1) != ".":
                while i < hi and self.w(i) != "{":
                    i += 1
                i = self.pair.get(i, hi) + 1
            elif word == "function" and self.is_id(i + 1 + (self.w(i + 1) == "*")):
                k = name_at = i + 1 + (self.w(i + 1) == "*")
                while k < hi and self.w(k) != "(":
                    k += 1
                open_ = self.body(self.pair.get(k, hi), hi)
                if open_ is None:
                    i = self.pair.get(k, k) + 1
                else:
                    self._walk(k, self.pair.get(open_, hi), self.w(name_at), cls)
                    i = self.pair.get(open_, hi) + 1
            elif word in ("const", "let", "var") and self.is_id(i + 1):
                k = i + 2
                while k < hi and self.w(k) not in ("=", ";", ",") and self.t[k][2] == self.t[k - 1][3]:
                    k = self.pair.get(k, k) + 1
                if self.w(k) == "=" and self.arrow(k + 1, hi):
                    end = self.end_of(k + 1, hi)
                    self._walk(k + 1, end + 1, self.w(i + 1), cls)
                    i = end + 1
                else:
                    i += 2
            else:
                self._call(i, caller, cls)
                i += 1

    def _members(self, lo: int, hi: int, caller: str, cls: str) -> None:
        i = lo
        while i < hi:
            while self.w(i) in _MODIFIERS and self.w(i + 1) not in ("(", "=", ":", ";", "?") and i < hi:
                i += 1
            if self.w(i) == "*":
                i += 1
            name, k = self.w(i), i + 1
            if not self.is_id(i):
                i = self.pair.get(i, i) + 1
                continue
            if name.startswith("@"):
                i = self.pair.get(k, k) + 1 if self.w(k) == "(" else k
                continue
            k += self.w(k) in ("?", "!")
            if self.w(k) == "<":
                k = self.skip_angles(k)
            if self.w(k) == "(":
                close = self.pair.get(k, hi)
                if name == "constructor":
                    for j in range(k, close):
                        if self.w(j) in ("private", "public", "protected", "readonly"):
                            f = j + 1 + (self.w(j + 1) == "readonly")
                            if self.w(f) in self.types:
                                self.fields[cls, self.w(f)] = self.types[self.w(f)]
                elif cls:
                    self.methods.add((cls, name))
                open_ = self.body(close, hi)
                if open_ is None:
                    i = close + 1
                    continue
                end = self.pair.get(open_, hi)
                if name == "constructor":
                    for j in range(open_, end - 4):
                        if self.w(j) == "this" and self.w(j + 1) == "." and self.w(j + 3) == "=" and (self.w(j + 4) == "new" or self.w(j + 4) in self.types):
                            self.fields[cls, self.w(j + 2)] = self.w(j + 5) if self.w(j + 4) == "new" else self.types[self.w(j + 4)]
                self._walk(k, end, f"{cls}.{name}" if cls else name, cls)
                i = end + 1
                continue
            if self.w(k) == ":" and self.is_id(k + 1):
                self.fields[cls, name] = self.w(k + 1)
            while k < hi and self.w(k) not in ("=", ";") and (self.t[k][2] == self.t[k - 1][3]):
                k = self.pair.get(k, k) + 1
            if self.w(k) == "=":
                if self.w(k + 1) == "new":
                    self.fields[cls, name] = self.w(k + 2)
                end = self.end_of(k + 1, hi)
                self._walk(k + 1, end + 1, caller, cls)
                k = end + 1
            i = max(k, i + 1)

    def _call(self, i: int, caller: str, cls: str) -> None:
        name, k = self.w(i), i + 1
        if name in _PLAIN:
            return
        if self.w(k) == "<":
            k = self.skip_angles(k)
        if self.w(k) == "?." and self.w(k + 1) == "(":
            k += 1
        if self.w(k) != "(":
            return
        chain, j = [name], i
        while self.w(j - 1) in (".", "?."):
            if not self.is_id(j - 2):
                return
            chain.insert(0, self.w(j - 2))
            j -= 2
        if self.w(j - 1) == "new":
            return
        if len(chain) == 1:
            self.calls.append((caller, "name", name, ""))
        elif chain[0] == "this" and len(chain) == 2:
            if cls:
                self.calls.append((caller, "class", cls, name))
        elif chain[0] == "this" and len(chain) == 3:
            if (cls, chain[1]) in self.fields:
                self.calls.append((caller, "class", self.fields[cls, chain[1]], name))
        elif len(chain) == 2:
            if chain[0] in self.types and chain[0] not in [b[0] for b in self.bindings]:
                self.calls.append((caller, "class", self.types[chain[0]], name))
            else:
                self.calls.append((caller, "member", chain[0], name))


_ROWS = "path string, loc long, decls array<struct<name:string,kind:string,loc:long,complexity:long>>, exports array<struct<name:string,local:string,source:string,star:boolean>>, imports array<struct<source:string,symbols:array<string>,type_only:boolean>>, bindings array<struct<local:string,source:string,name:string>>, calls array<struct<caller:string,how:string,root:string,name:string>>, methods array<struct<cls:string,name:string>>, ord long, failed boolean"


def parse(sources: DataFrame) -> DataFrame:
    """A row of facts for each of ``sources`` (path, text, ord); what can't be parsed keeps its size alone, and is ``failed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, order in zip(batch["path"], batch["text"], batch["ord"]):
                try:
                    f = _File(text or "")
                    rows.append((path, f.loc, [(n, *d) for n, d in f.decls.items()], f.exports, f.imports, f.bindings, f.calls, sorted(f.methods), order, False))
                except (IndexError, RecursionError):
                    rows.append((path, (text or "x")[:-1].count("\n") + 1, [], [], [], [], [], [], order, True))
            names = [c.split()[0] for c in ("path", "loc", "decls", "exports", "imports", "bindings", "calls", "methods", "ord", "failed")]
            keys = {"decls": ("name", "kind", "loc", "complexity"), "exports": ("name", "local", "source", "star"), "imports": ("source", "symbols", "type_only"), "bindings": ("local", "source", "name"), "calls": ("caller", "how", "root", "name"), "methods": ("cls", "name")}
            data = {n: [[dict(zip(keys[n], x)) for x in r[k]] if n in keys else r[k] for r in rows] for k, n in enumerate(names)}
            yield pd.DataFrame(data)

    return sources.mapInPandas(run, _ROWS)


def _path(base: str, rest: str) -> str:
    """SQL for rest joined to base with ``.`` and ``..`` resolved."""
    steps = f"filter(split(concat({base}, '/', {rest}), '/'), x -> x <> '' AND x <> '.')"
    return f"array_join(aggregate({steps}, cast(array() as array<string>), (a, x) -> CASE WHEN x = '..' AND size(a) > 0 THEN slice(a, 1, size(a) - 1) ELSE array_append(a, x) END), '/')"


def resolve_modules(specs: DataFrame, paths: DataFrame, aliases: list[tuple[str, str]]) -> DataFrame:
    """file, source, resolved: the first known file of nine candidates, for relative and aliased sources."""
    target = F.when(F.startswith("source", F.lit(".")) | F.startswith("source", F.lit("/")), F.expr(_path("CASE WHEN instr(file, '/') = 0 THEN '' ELSE regexp_replace(file, '/[^/]*$', '') END", "source")))
    aliased = F.lit(None).cast("string")
    for prefix, replacement in reversed(aliases):
        rest = F.substring("source", len(prefix) + 1, 1 << 20) if prefix else F.col("source")
        aliased = F.when(F.startswith("source", F.lit(prefix)), F.concat(F.lit(replacement), rest)).otherwise(aliased)
    based = specs.distinct().withColumn("base", F.coalesce(aliased, target)).where("base IS NOT NULL")
    bare = F.regexp_replace("base", r"\.js$", "")
    tails = [".ts", ".tsx", "/index.ts", "/index.tsx"]
    candidates = F.array(F.col("base"), *[F.concat("base", F.lit(x)) for x in tails], *[F.concat(bare, F.lit(x)) for x in tails])
    met = based.select("file", "source", F.posexplode(candidates).alias("n", "resolved")).join(paths.select(F.col("path").alias("resolved")), "resolved")
    found = met.groupBy("file", "source").agg(F.min_by("resolved", "n").alias("resolved"))
    return based.select("file", "source").join(found, ["file", "source"], "left")


def _bind(names: DataFrame, decls: DataFrame, exports: DataFrame) -> DataFrame:
    """file, name -> to_file, to_name of the declarations behind exported names, through any chain of re-exports."""
    stars = exports.where("star").select("file", F.col("resolved").alias("via"))
    plain = exports.where("NOT star").select("file", "name", F.coalesce("resolved", "file").alias("to_file"), F.col("local").alias("to_name"), F.col("resolved").isNotNull().alias("away"))
    # names that pass through `export *`, until no file gains one
    have = cut(plain.select("file", "name", "to_file", "to_name", "away"))
    while True:
        more = stars.join(have.select(F.col("file").alias("via"), "name"), "via").where("name <> 'default'").select("file", "name", F.col("via").alias("to_file"), F.col("name").alias("to_name"), F.lit(True).alias("away"))
        fresh = more.join(have, ["file", "name"], "left_anti").dropDuplicates(["file", "name"])
        fresh = cut(fresh)
        if fresh.isEmpty():
            break
        have = cut(have.unionByName(fresh))
    # names that a file exports but imports from elsewhere
    own = decls.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.lit(True).alias("here"))
    passed = names.select(F.col("file").alias("to_file"), F.col("local").alias("to_name"), F.col("resolved").alias("next_file"), F.col("name").alias("next_name"))
    have = have.join(own, ["to_file", "to_name"], "left").join(passed, ["to_file", "to_name"], "left")
    through = ~F.col("away") & F.col("here").isNull() & F.col("next_file").isNotNull()
    have = cut(have.select("file", "name", F.when(through, F.col("next_file")).otherwise(F.col("to_file")).alias("to_file"), F.when(through, F.col("next_name")).otherwise(F.col("to_name")).alias("to_name"), (F.col("away") | through).alias("away")))
    now = have
    # each round doubles how far a name points, so chains of any length end; what is left then goes round in a circle
    for _ in range(have.count().bit_length() + 1):
        if now.where("away").isEmpty():
            break
        step = now.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("f"), F.col("to_name").alias("n"), F.col("away").alias("w"))
        moved = now.where("away").join(step, ["to_file", "to_name"], "left")
        now = cut(now.where("NOT away").unionByName(moved.where("f IS NOT NULL").select("file", "name", F.col("f").alias("to_file"), F.col("n").alias("to_name"), F.col("w").alias("away")).distinct()))
    return now.where("NOT away").drop("away")


def match_tests(files: DataFrame) -> DataFrame:
    """path, test_file: the test of a file, by ten names in order, else the first of its folder's test folder."""
    paths = files.select("path", "ord")
    test = F.lit(False)
    for mark in TEST_MARKS:
        test = test | F.contains("path", F.lit(mark))
    ext, stem = F.regexp_extract("path", r"(\.[^./]+)$", 1), F.regexp_replace("path", r"\.[^./]+$", "")
    folder = F.when(F.instr("path", "/") == 0, "").otherwise(F.concat(dirname(F.col("path")), F.lit("/")))
    name = F.element_at(F.split(stem, "/"), -1)
    near = lambda d, tail, e: F.concat(folder, F.lit(d), name, F.lit(tail), e)
    ts = F.lit(".ts")
    candidates = F.array(
        F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext), F.concat(stem, F.lit(".test.ts")), F.concat(stem, F.lit(".spec.ts")),
        near("__tests__/", "", ext), near("__tests__/", ".test", ext), near("tests/", ".test", ext), near("tests/", ".spec", ext), near("tests/", ".test", ts), near("tests/", ".spec", ts),
    )
    plain = paths.where(~test)
    direct = plain.select("path", F.posexplode(candidates).alias("n", "c")).join(paths.select(F.col("path").alias("c")), "c").groupBy("path").agg(F.min_by("c", "n").alias("direct"))
    held = paths.where(F.contains("path", F.lit(".test.")) | F.contains("path", F.lit(".spec."))).withColumn("d", dirname(F.col("path")))
    held = held.where(F.element_at(F.split("d", "/"), -1).isin("tests", "__tests__")).groupBy(dirname(F.col("d")).alias("folder")).agg(F.min_by("path", "ord").alias("nearby"))
    return plain.withColumn("folder", dirname(F.col("path"))).join(direct, "path", "left").join(held, "folder", "left").select("path", F.coalesce("direct", "nearby").alias("test_file"))


def _order() -> Column:
    """Files in their order (of 2**31 at most), then places in a file, which an array's size bounds."""
    return F.shiftleft("file_ord", 31) + F.col("n")


def source_facts(sources: DataFrame, touches: DataFrame | None = None, aliases: list[tuple[str, str]] | None = None) -> dict[str, DataFrame]:
    """files, exports, imports and call_sites of ``sources`` (path, text, ord); ``touches`` has a row per commit and file.

    Files that can't be parsed are named in a warning, and have no facts but their size.
    """
    parsed = cut(parse(sources))
    failed = parsed.where("failed")
    count = failed.count()
    if count:
        warnings.warn(f"{count} files can't be parsed: {', '.join(r['path'] for r in failed.select('path').orderBy('path').limit(NAMED).collect())}", stacklevel=2)
    paths = parsed.select("path", "ord")
    file = F.col("path").alias("file")
    decls = parsed.select(file, F.explode("decls").alias("d")).select("file", "d.*")
    imports = parsed.select(file, F.col("ord").alias("file_ord"), F.posexplode("imports").alias("n", "i")).select("file", "file_ord", "n", "i.*")
    raw_exports = parsed.select(file, F.posexplode("exports").alias("n", "e")).select("file", "n", "e.*")
    bindings = parsed.select(file, F.explode("bindings").alias("b")).select("file", "b.*")
    where = cut(resolve_modules(imports.select("file", "source").distinct(), paths, aliases or []))
    exports = raw_exports.join(where, ["file", "source"], "left").where("source IS NULL OR resolved IS NOT NULL")
    names = bindings.join(where, ["file", "source"]).where("resolved IS NOT NULL")
    bound = cut(_bind(names, decls, exports))
    own = decls.select(F.col("file").alias("to_file"), F.col("name").alias("to_name"), "kind", "loc", "complexity")
    order = raw_exports.groupBy("file", "name").agg(F.min("n").alias("n"))
    out_exports = (
        bound.join(own, ["to_file", "to_name"], "left").join(order, ["file", "name"], "left")
        .select("file", "name", F.coalesce("kind", F.lit("variable")).alias("kind"), F.when(F.col("file") == F.col("to_file"), F.coalesce("loc", F.lit(1))).otherwise(1).cast("long").alias("loc"), (F.col("name") == "default").alias("is_default"), F.when(F.col("file") == F.col("to_file"), F.coalesce("complexity", F.lit(0))).otherwise(0).cast("long").alias("complexity"), F.coalesce("n", F.lit(1 << 20)).cast("long").alias("ord"))
    )
    kept = imports.join(where, ["file", "source"])  # neither relative nor aliased: not in ``where``
    out_imports = kept.select("file", F.coalesce("resolved", "source").alias("resolved"), "symbols", F.col("type_only").alias("is_type_only"), _order().alias("ord"))
    # what a name means in a file: its own declaration, or what it imports
    local = decls.select("file", F.col("name").alias("root"), F.col("file").alias("to_file"), F.col("name").alias("to_name"))
    brought = names.where("name <> '*'").select("file", F.col("local").alias("root"), F.col("resolved").alias("f"), F.col("name").alias("n"))
    target = bound.select(F.col("file").alias("f"), F.col("name").alias("n"), "to_file", "to_name")
    meaning = local.unionByName(brought.join(target, ["f", "n"]).select("file", "root", "to_file", "to_name").join(local, ["file", "root"], "left_anti"))
    calls = parsed.select(file, F.col("ord").alias("file_ord"), F.posexplode("calls").alias("n", "c")).select("file", "file_ord", "n", "c.*")
    methods = parsed.select(F.col("path").alias("to_file"), F.explode("methods").alias("m")).select("to_file", F.col("m.cls").alias("to_name"), F.col("m.name").alias("name"))
    met = calls.join(meaning, ["file", "root"])
    by_name = met.where("how = 'name'").select("file", "file_ord", "n", "caller", "to_file", "to_name")
    by_class = met.where("how <> 'name'").join(methods, ["to_file", "to_name", "name"]).select("file", "file_ord", "n", "caller", "to_file", F.concat("to_name", F.lit("."), "name").alias("to_name"))
    spaces = names.where("name = '*'").select("file", F.col("local").alias("root"), F.col("resolved").alias("f"))
    by_space = calls.where("how = 'member'").join(spaces, ["file", "root"]).withColumnRenamed("name", "n2").join(target.withColumnRenamed("n", "n2"), ["f", "n2"]).select("file", "file_ord", "n", "caller", "to_file", "to_name")
    sites = by_name.unionByName(by_class).unionByName(by_space).groupBy("file", "caller", "to_file", "to_name").agg(F.min(_order()).alias("ord"))
    out_sites = sites.select(F.col("file").alias("caller_file"), F.col("caller").alias("caller_symbol"), F.col("to_file").alias("callee_file"), F.col("to_name").alias("callee_symbol"), F.lit("type-resolved").alias("confidence"), "ord")
    test = F.lit(False)
    for mark in TEST_MARKS:
        test = test | F.contains("path", F.lit(mark))
    files = parsed.select("path", "loc", "ord", test.alias("is_test")).join(match_tests(paths), "path", "left")
    if touches is not None:
        files = files.join(churn(touches).withColumnRenamed("file", "path"), "path", "left")
    else:
        files = files.withColumn("churn", F.lit(0))
    out_files = files.select("path", "loc", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), "is_test", "test_file", "ord")
    return {"files": out_files, "exports": out_exports, "imports": out_imports, "call_sites": out_sites}


def source_graph(sources: DataFrame, touches: DataFrame | None = None, aliases: list[tuple[str, str]] | None = None) -> CodeGraph:
    return build_graph(**source_facts(sources, touches, aliases))
