"""Nested parsers that lines can't express, as Arrow maps over whole files: symbols, table definitions, Angular modules.

Each works on one file at a time, so partitions are independent; regular
expressions and brace matching stand in for grammars.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SYMBOLS = (
    "file string, package string, imports array<struct<name:string,spec:string>>, exports array<struct<name:string,spec:string>>,"
    " types array<struct<name:string,kind:string,line:int,supers:array<struct<name:string,kind:string>>,methods:array<string>>>,"
    " fields array<struct<name:string,type:string>>, calls array<struct<receiver:string,method:string,within:string>>"
)
TABLE = "name string, columns array<struct<name:string,type:string,nullable:boolean,unique:boolean>>, primary_key array<string>, foreign_keys array<struct<column:string,table:string,ref_column:string>>, source string, file string"
NG = "file string, kind string, name string, parts map<string,array<string>>, lazy array<string>"
MAX_COLUMNS = 30

_TYPE = re.compile(r"\b(class|interface|enum)\s+(\w+)(?:<[^>{]*>)?\s*(?:extends\s+([\w.,\s<>]+?))?\s*(?:implements\s+([\w.,\s<>]+?))?\s*\{")
_COMMENT = re.compile(r"/\*.*?\*/|//[^\n]*|(\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)", re.S)
_CONTROL = frozenset("if for while switch catch return new function super this constructor throw typeof await else do".split())


def _map(files: DataFrame, parse: Callable[[str, str, str], list[dict]], ddl: str) -> DataFrame:
    """Rows of parse(rel_path, ext, content) for every file."""
    schema = StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [row for path, ext, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for row in parse(path, ext, text or "")]
            yield from pa.Table.from_pylist(rows, schema=arrow).to_batches() or [pa.RecordBatch.from_pylist([], schema=arrow)]

    return files.select("rel_path", "ext", "content").mapInArrow(run, schema)


def without_comments(text: str) -> str:
    return _COMMENT.sub(lambda m: m[1] or " ", text)


def block_end(text: str, start: int) -> int:
    """Place after the brace that closes the one at start; the text's end if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _names(text: str | None) -> list[str]:
    """Type names of a comma list; type arguments are dropped."""
    flat = text or ""
    while (less := re.sub(r"<[^<>]*>", "", flat)) != flat:
        flat = less
    return [n.strip().split(".")[-1] for n in flat.split(",") if n.strip()]


def parse_symbols(path: str, ext: str, content: str) -> list[dict]:
    """Package, imports, re-exports, types, typed fields and calls of a Java, TypeScript or JavaScript file."""
    if ext not in (".java", ".ts", ".tsx", ".js", ".jsx"):
        return []
    text = without_comments(content)
    java = ext == ".java"
    imports, exports = [], []
    if java:
        for spec in re.findall(r"^\s*import\s+(?:static\s+)?([\w.]+)\s*;", text, re.M):
            imports.append({"name": spec.split(".")[-1], "spec": spec})
    else:
        for names, spec in re.findall(r"import\s+(?:type\s+)?([^;'\"]+?)\s+from\s+['\"]([^'\"]+)['\"]", text):
            for name in re.split(r"[{},]", names):
                if name.strip():
                    imports.append({"name": re.split(r"\s+as\s+", name.strip())[-1].removeprefix("* as ").strip(), "spec": spec})
        imports += [{"name": "", "spec": s} for s in re.findall(r"(?:require|import)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)|import\s+['\"]([^'\"]+)['\"]", text) for s in s if s]
        for names, spec in re.findall(r"export\s+(\*|\{[^}]*\})\s+from\s+['\"]([^'\"]+)['\"]", text):
            exports += [{"name": n.strip().split(" as ")[-1].strip(), "spec": spec} for n in names.strip("{}").split(",") if n.strip()]
    types, fields, calls = [], [], []
    for m in _TYPE.finditer(text):
        body = text[m.end() - 1 : block_end(text, m.end() - 1)]
        supers = [{"name": n, "kind": "extends"} for n in _names(m[3])] + [{"name": n, "kind": "implements"} for n in _names(m[4])]
        signature = r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|private|protected|static|final|async|abstract|override)\s+)*(?:[\w<>\[\],.?]+\s+)?(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w,.\s]+)?(?::\s*[\w<>\[\]|.\s]+)?\s*([{;])"
        methods = []
        for s in re.finditer(signature, body, re.M):
            if s[1] in _CONTROL and s[1] != "constructor":
                continue
            if s[3] == ";" and m[1] != "interface":
                continue
            methods.append(s[1])
            if s[1] in ("constructor", m[2]):  # injected parameters are fields
                fields += [{"name": n, "type": t} for n, t in re.findall(r"(?:private|public|protected|readonly)\s+(?:readonly\s+)?(\w+)\s*\??:\s*(\w+)", s[2])]
                if java:
                    fields += [{"name": n, "type": t} for t, n in re.findall(r"(?:final\s+)?(\w+)(?:<[^>]*>)?\s+(\w+)\s*(?:,|$)", s[2])]
            if s[3] == "{":
                inner = body[s.end() - 1 : block_end(body, s.end() - 1)]
                calls += [{"receiver": r, "method": c, "within": f"{m[2]}.{s[1]}"} for r, c in re.findall(r"(?:this\.)?(\w+)\.(\w+)\s*\(", inner) if r not in _CONTROL]
        if java:
            fields += [{"name": n, "type": t} for t, n in re.findall(r"^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:private|public|protected|static|final)\s+)+(\w+)(?:<[^>]*>)?\s+(\w+)\s*[;=]", body, re.M)]
        else:
            fields += [{"name": n, "type": t} for n, t in re.findall(r"^\s*(?:(?:private|public|protected|readonly|static)\s+)+(\w+)\s*[!?]?:\s*(\w+)", body, re.M)]
        types.append({"name": m[2], "kind": m[1], "line": text.count("\n", 0, m.start()) + 1, "supers": supers, "methods": list(dict.fromkeys(methods))})
    package = re.search(r"^\s*package\s+([\w.]+)", text, re.M) if java else None
    seen = lambda rows: [dict(x) for x in dict.fromkeys(tuple(r.items()) for r in rows)]
    return [{"file": path, "package": package[1] if package else path.rpartition("/")[0], "imports": imports, "exports": exports, "types": types, "fields": seen(fields), "calls": seen(calls)}]


def symbols(files: DataFrame) -> DataFrame:
    return _map(files.where(F.col("ext").isin(".java", ".ts", ".tsx", ".js", ".jsx")), parse_symbols, SYMBOLS)


def symbol_relations(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts of symbols() as the relations that build.symbol_edges joins: types, fields, calls, imports, exports."""
    each = lambda c: facts.select("file", "package", F.explode(c).alias("x"))
    return {
        "types": each("types").select("file", "package", "x.name", "x.kind", "x.line", "x.supers", "x.methods"),
        "fields": each("fields").select("file", "x.name", "x.type").distinct(),
        "calls": each("calls").select("file", "x.receiver", "x.method").distinct(),
        "imports": each("imports").select("file", "x.name", "x.spec"),
        "exports": each("exports").select("file", "x.name", "x.spec"),
    }


#: What SQL definitions are made of: quoted and plain names, numbers, strings, and single signs.
_TOKEN = re.compile(r"""(?P<quoted>"[^"]*"|`[^`]*`|\[[^\]]*\])|(?P<text>'(?:[^']|'')*')|(?P<word>[A-Za-z_][\w$#]*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign>\S)""")


class _Tokens:
    """A cursor over the tokens of SQL text: (upper-cased for comparison, as written without quotes)."""

    def __init__(self, text: str):
        self.items = [("" if m.lastgroup in ("quoted", "text") else m[0].upper(), m[0][1:-1] if m.lastgroup in ("quoted", "text") else m[0]) for m in _TOKEN.finditer(text)]
        self.at = 0

    def take(self, *words: str) -> bool:
        """Steps over the given words if they come next."""
        there = [x for x, _ in self.items[self.at : self.at + len(words)]] == list(words)
        self.at += len(words) * there
        return there

    def name(self) -> str:
        """The last part of a dotted name."""
        found = self.items[self.at][1] if self.at < len(self.items) else ""
        self.at += 1
        while self.take(".") and self.at < len(self.items):
            found = self.items[self.at][1]
            self.at += 1
        return found

    def group(self) -> list[_Tokens]:
        """What stands in the parentheses that open here, cut at its own commas. Nothing without parentheses."""
        if not self.take("("):
            return []
        parts, depth = [_Tokens("")], 1
        while self.at < len(self.items):
            item = self.items[self.at]
            self.at += 1
            depth += {"(": 1, ")": -1}.get(item[0], 0)
            if not depth:
                break
            if item[0] == "," and depth == 1:
                parts.append(_Tokens(""))
            else:
                parts[-1].items.append(item)
        return [p for p in parts if p.items]


_NO_COLUMN = ("CHECK", "INDEX", "KEY", "LIKE", "EXCLUDE", "PARTITION", "SUPPLEMENTAL")


class _Table:
    """One CREATE TABLE while its parts are read. Part by part, each either says something of the table or is a column."""

    def __init__(self, name: str):
        self.name, self.columns, self.keys, self.foreign = name, {}, [], []

    def part(self, t: _Tokens) -> None:
        if t.take("CONSTRAINT"):
            t.name()
        if t.take("PRIMARY", "KEY"):
            self.keys += [x.name() for x in t.group()]
        elif t.take("UNIQUE"):
            t.take("KEY")
            inside = t.group()
            if len(inside) == 1 and (c := self.columns.get(inside[0].name())):
                c["unique"] = True
        elif t.take("FOREIGN", "KEY"):
            own = [x.name() for x in t.group()]
            self.refer(t, own)
        elif t.items[t.at : t.at + 1] and t.items[t.at][0] not in _NO_COLUMN:
            self.column(t)

    def refer(self, t: _Tokens, own: list[str]) -> None:
        if t.take("REFERENCES"):
            table, there = t.name(), [x.name() for x in t.group()]
            self.foreign += [{"column": c, "table": table, "ref_column": there[i] if i < len(there) else None} for i, c in enumerate(own)]

    def column(self, t: _Tokens) -> None:
        name = t.name()
        if t.at >= len(t.items):
            return
        kind = t.name()
        if size := t.group():
            kind += "(" + ",".join(" ".join(x for _, x in p.items) for p in size) + ")"
        made = self.columns[name] = {"name": name, "type": kind, "nullable": True, "unique": False}
        while t.at < len(t.items):
            if t.take("NOT", "NULL"):
                made["nullable"] = False
            elif t.take("PRIMARY", "KEY"):
                made["nullable"] = False
                self.keys.append(name)
            elif t.take("UNIQUE"):
                made["unique"] = True
            elif t.items[t.at][0] == "REFERENCES":
                self.refer(t, [name])
            elif not t.group():
                t.at += 1


def _sql_tables(path: str, text: str) -> list[dict]:
    """Tables of CREATE TABLE statements, read token by token."""
    t, out = _Tokens(text), []
    while t.at < len(t.items):
        if not t.take("CREATE"):
            t.at += 1
            continue
        while t.at < len(t.items) and t.items[t.at][0] in ("GLOBAL", "LOCAL", "PRIVATE", "TEMPORARY", "TEMP", "UNLOGGED"):
            t.at += 1
        if not t.take("TABLE"):
            continue
        t.take("IF", "NOT", "EXISTS")
        table = _Table(t.name())
        parts = t.group()
        for part in parts:
            table.part(part)
        if parts:
            out.append({"name": table.name, "columns": list(table.columns.values())[:MAX_COLUMNS], "primary_key": table.keys, "foreign_keys": table.foreign, "source": "sql", "file": path})
    return out


def _prisma(path: str, text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"^model\s+(\w+)\s*\{", text, re.M):
        rows = [r.split() for r in text[m.end() : block_end(text, m.end() - 1) - 1].split("\n") if r.strip() and not r.strip().startswith(("//", "@@"))]
        foreign = [{"column": r[0], "table": r[1].rstrip("?[]"), "ref_column": (re.search(r"references:\s*\[\s*(\w+)", " ".join(r)) or [None, None])[1]} for r in rows if len(r) > 2 and any(x.startswith("@relation") for x in r)]
        out.append({"name": m[1], "columns": [{"name": r[0], "type": r[1], "nullable": r[1].endswith("?"), "unique": "@unique" in r} for r in rows if len(r) > 1][:MAX_COLUMNS], "primary_key": [r[0] for r in rows if "@id" in r], "foreign_keys": foreign, "source": "prisma", "file": path})
    return out


def _entities(path: str, text: str, source: str) -> list[dict]:
    """Classes marked @Entity: TypeORM (name: Type) or JPA (Type name)."""
    out = []
    for m in re.finditer(r"@Entity\s*(\([^)]*\))?", text):
        c = re.compile(r"\bclass\s+(\w+)[^{]*\{").search(text, m.end())
        if not c:
            continue
        body, mark = text[c.end() : block_end(text, c.end() - 1)], text[m.start() : c.start()]
        if source == "typeorm":
            given = re.search(r"@Entity\s*\(\s*(?:\{[^}]*name\s*:\s*)?['\"](\w+)", mark)
            found = [(ann, n, t) for ann, n, t in re.findall(r"((?:@\w+\s*\((?:[^()]|\([^()]*\))*\)\s*)+)(?:\w+\s+)*?(\w+)\s*[!?]?\s*:\s*([\w\[\]]+)", body)]
        else:
            given = re.search(r"@Table\s*\([^)]*name\s*=\s*\"(\w+)", mark)
            found = [(ann, n, t) for ann, t, n in re.findall(r"((?:@\w+(?:\s*\([^)]*\))?\s*)+)(?:private|protected|public)\s+([\w<>]+)\s+(\w+)\s*[;=]", body)]
        columns, keys, foreign = [], [], []
        for ann, name, kind in found:
            named = re.search(r"@(?:Column|JoinColumn)\s*\([^)]*name\s*[=:]\s*['\"](\w+)", ann)
            column = named[1] if named else name
            columns.append(_told({"name": column, "type": kind}, ann))
            if re.search(r"@(Id|PrimaryColumn|PrimaryGeneratedColumn)\b", ann):
                keys.append(column)
            if re.search(r"@(ManyToOne|OneToOne|JoinColumn)\b", ann):
                there = re.search(r"referencedColumnName\s*[:=]\s*['\"](\w+)", ann)
                foreign.append({"column": column, "table": kind, "ref_column": there[1] if there else None})
        out.append({"name": given[1] if given else c[1], "columns": columns[:MAX_COLUMNS], "primary_key": keys, "foreign_keys": foreign, "source": source, "file": path})
    return out


def _django(path: str, text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"^class\s+(\w+)\s*\(\s*(?:models\.)?Model\s*\)\s*:\s*\n((?:[ \t]+.*\n?|\s*\n)*)", text, re.M):
        found = re.findall(r"^\s+(\w+)\s*=\s*models\.(\w+)\s*\(([^\n]*)", m[2], re.M)
        foreign = [{"column": n, "table": re.match(r"\s*['\"]?([\w.]+)", a)[1].split(".")[-1], "ref_column": (re.search(r"to_field\s*=\s*['\"](\w+)", a) or [None, None])[1]} for n, t, a in found if t in ("ForeignKey", "OneToOneField") and re.match(r"\s*['\"]?[\w.]+", a)]
        keys = [n for n, _, a in found if "primary_key=True" in a.replace(" ", "")] or ["id"]
        out.append({"name": m[1], "columns": [_told({"name": n, "type": t}, a) | ({} if "null=True" in a.replace(" ", "") else {"nullable": False}) for n, t, a in found][:MAX_COLUMNS], "primary_key": keys, "foreign_keys": foreign, "source": "django", "file": path})
    return out


def _sequelize(path: str, text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"(?:sequelize\.define\s*\(\s*['\"](\w+)['\"]\s*,|(\w+)\.init\s*\()\s*\{", text):
        body = text[m.end() : block_end(text, m.end() - 1)]
        found = re.findall(r"(\w+)\s*:\s*(?:DataTypes\.(\w+)|\{([^{}]*)\})", body)
        kind = lambda t, o: t or (re.search(r"DataTypes\.(\w+)", o) or ["", ""])[1]
        found = [(n, kind(t, o), o) for n, t, o in found if kind(t, o)]
        foreign = [{"column": n, "table": t, "ref_column": c or None} for n, t, c in re.findall(r"(\w+)\s*:\s*\{[^{}]*references\s*:\s*\{[^}]*model\s*:\s*['\"]?(\w+)(?:[^}]*key\s*:\s*['\"](\w+))?", body)]
        out.append({"name": m[1] or m[2], "columns": [_told({"name": n, "type": t}, o) for n, t, o in found][:MAX_COLUMNS], "primary_key": [n for n, _, o in found if re.search(r"primaryKey\s*:\s*true", o)], "foreign_keys": foreign, "source": "sequelize", "file": path})
    return out


def _told(column: dict, said: str) -> dict:
    """The column with what its marks say: nullable unless they forbid it, unique if they say so."""
    optional = re.search(r"nullable\s*[:=]\s*true|null\s*=\s*True|allowNull\s*:\s*true", said)
    forbidden = re.search(r"nullable\s*[:=]\s*false|allowNull\s*:\s*false|@(?:Id|PrimaryColumn|PrimaryGeneratedColumn|NotNull)\b|primaryKey\s*:\s*true|primary_key\s*=\s*True", said)
    return column | {"nullable": bool(optional) or not forbidden, "unique": bool(re.search(r"unique\s*[:=]\s*[tT]rue|@unique\b", said))}


def parse_tables(path: str, ext: str, content: str) -> list[dict]:
    if ext in (".sql", ".pks", ".pkb", ".pls", ".plsql", ".pck"):
        return _sql_tables(path, re.sub(r"--[^\n]*|/\*.*?\*/", " ", content, flags=re.S))
    if ext == ".prisma":
        return _prisma(path, content)
    if ext in (".java", ".kt") and "@Entity" in content:
        return _entities(path, without_comments(content), "jpa")
    if ext == ".py" and "models." in content:
        return _django(path, content)
    if ext in (".ts", ".tsx", ".js"):
        text = without_comments(content)
        return (_entities(path, text, "typeorm") if "@Entity" in text else []) + _sequelize(path, text)
    return []


def db_schema(files: DataFrame) -> DataFrame:
    """Tables of SQL, Prisma, TypeORM, JPA, Django and Sequelize definitions; of one lower-cased name the first by path."""
    found = _map(files, parse_tables, TABLE)
    best = found.groupBy(F.lower("name").alias("key")).agg(F.min_by(F.struct(*(f.name for f in StructType.fromDDL(TABLE))), F.struct("file", "source", "name")).alias("t"))
    return best.select("t.*")


def parse_angular(path: str, ext: str, content: str) -> list[dict]:
    if ext not in (".ts", ".js"):
        return []
    text, out = without_comments(content), []
    lazy = [a or b for a, b in re.findall(r"loadChildren\s*:\s*(?:\(\)\s*=>\s*import\s*\(\s*['\"]([^'\"]+)['\"]|['\"]([^'\"#]+)#)", text)]
    for m in re.finditer(r"@NgModule\s*\(\s*\{", text):
        end = block_end(text, m.end() - 1)
        name = re.compile(r"\bclass\s+(\w+)").search(text, end)
        parts = {k: [x.split("(")[0].strip() for x in re.split(r",(?![^([]*[)\]])", v) if x.strip()] for k, v in re.findall(r"\b(declarations|imports|exports|providers|bootstrap)\s*:\s*\[((?:[^\[\]]|\[[^\]]*\])*)\]", text[m.end() - 1 : end])}
        out.append({"file": path, "kind": "module", "name": name[1] if name else "", "parts": parts, "lazy": lazy})
    for kind, pattern in (("action", r"\b(\w+)\s*=\s*createAction\s*\("), ("reducer", r"\b(\w+)\s*=\s*createReducer\s*\("), ("effect", r"\b(\w+)\s*=\s*createEffect\s*\("), ("selector", r"\b(\w+)\s*=\s*create(?:Feature)?Selector\s*[<(]")):
        out += [{"file": path, "kind": kind, "name": n, "parts": {}, "lazy": []} for n in re.findall(pattern, text)]
    if lazy and not any(r["kind"] == "module" for r in out):
        out.append({"file": path, "kind": "routes", "name": path.rpartition("/")[2], "parts": {}, "lazy": lazy})
    return out


def angular(files: DataFrame) -> DataFrame:
    """Angular modules with their parts and lazy routes, and NgRx items."""
    return _map(files.where(F.col("ext").isin(".ts", ".js")), parse_angular, NG)
