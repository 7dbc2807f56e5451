"""Line and file detectors: rules are data, applied to one relation of lines.

files: (rel_path, ext, content). ``lines`` explodes it once; every detector is a
filter, a regular expression or a window over a file's lines on top of that.
Windows are per file and files are of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..sources.durable import stored

CODE = [".ts", ".tsx", ".js", ".jsx", ".java", ".kt", ".cs", ".py", ".rb", ".php", ".go"]
JVM = [".java", ".kt", ".scala", ".groovy"]
PLSQL = [".sql", ".pks", ".pkb", ".pls", ".plsql", ".prc", ".fnc", ".trg", ".vw", ".pck"]

#: Languages by extension.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".java": "Java", ".kt": "Kotlin", ".scala": "Scala", ".cs": "C#", ".py": "Python",
    ".rb": "Ruby", ".php": "PHP", ".go": "Go", ".rs": "Rust", ".sql": "SQL", ".pks": "PL/SQL", ".pkb": "PL/SQL", ".html": "HTML", ".css": "CSS", ".scss": "SCSS", ".vue": "Vue",
}
#: Frameworks by dependency, package managers by lock file.
FRAMEWORKS = {"react": "React", "@angular/core": "Angular", "vue": "Vue", "express": "Express", "@nestjs/core": "NestJS", "next": "Next.js", "electron": "Electron", "svelte": "Svelte", "fastify": "Fastify"}
LOCKS = {"package-lock.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "pom.xml": "maven", "build.gradle": "gradle", "requirements.txt": "pip", "go.mod": "go", "cargo.toml": "cargo", "composer.json": "composer"}

#: Extensions and folders that tell a file's layer.
DATABASE_EXT = ".sql .plsql .pls .pck .pks .pkb .prc .fnc .trg .pkg".split()
FRONTEND_EXT = ".tsx .jsx .vue .html .css .scss .less .osw".split()
FRONTEND_DIRS = "frontend front ui web webapp client pages components views".split()


def lines(files: DataFrame) -> DataFrame:
    """(rel_path, ext, line, text), numbered from 1."""
    return files.select("rel_path", "ext", F.posexplode(F.split("content", "\n", -1)).alias("i", "text")).select("rel_path", "ext", (F.col("i") + 1).alias("line"), "text")


def file_layer(path: Column, ext: Column) -> Column:
    segment = F.exists(F.split(F.lower(path), "/"), lambda p: p.isin(*FRONTEND_DIRS) | p.rlike(r"(^|[-_.])(frontend|front|ui|web|client)$"))
    return F.when(ext.isin(*DATABASE_EXT), "database").when(ext.isin(*FRONTEND_EXT) | (ext.isin(".ts", ".js", ".json", ".md") & segment), "frontend").otherwise("backend")


def stack(files: DataFrame) -> DataFrame:
    """(kind, name, n): languages by files, frameworks by package.json dependencies, package managers by lock files."""
    lang = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    languages = files.select(lang[F.col("ext")].alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("language").alias("kind"), "name", "n")
    deps = files.where(base_name(F.col("rel_path")) == "package.json").select(F.map_keys(F.from_json(F.get_json_object("content", "$.dependencies"), "map<string,string>")).alias("d"))
    known = F.create_map(*(F.lit(x) for kv in FRAMEWORKS.items() for x in kv))
    frameworks = deps.select(F.explode("d").alias("d")).select(known[F.col("d")].alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("framework").alias("kind"), "name", "n")
    lock = F.create_map(*(F.lit(x) for kv in LOCKS.items() for x in kv))
    managers = files.select(lock[F.lower(base_name(F.col("rel_path")))].alias("name")).where("name is not null").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("package-manager").alias("kind"), "name", "n")
    return languages.unionByName(frameworks).unionByName(managers)


#: Folder names that are no domain, top folders that hold sources, last parts of a sub-project's name.
INFRASTRUCTURE = (
    "src main test java kotlin resources webapp dist build target generated out output app lib internal pkg cmd assets static public styles environments i18n locale fonts images icons themes scss less"
    " com br org net io co gov edu uk de fr ru"
).split()
SOURCE_DIRS = "src app lib packages modules apps internal pkg cmd source sources".split()
SUBPROJECT_SUFFIXES = "frontend backend api web app core service worker server client ui gateway proxy admin mobile cli bff".split()
SUBPROJECT = r"(?i)(^|[-_.])(frontend|front|backend|back|api|web|ui|client|server|mobile|bff|gateway|admin)$"
ROOT = "__root__"


def _short(top: Column) -> Column:
    """A sub-project's name from its last part that says what it is (pending-approval-backend: backend), else its last part."""
    parts = F.split(top, "[-_]", -1)
    place = F.array_max(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(F.lower(F.element_at(parts, i)).isin(*SUBPROJECT_SUFFIXES), i).otherwise(0)))
    return F.when(place > 0, F.array_join(F.slice(parts, place, F.size(parts)), "-")).otherwise(F.element_at(parts, -1))


def _depths(f: DataFrame, least: int, deepest: int) -> DataFrame:
    """(top, depth): where a sub-project has several domains: the first depth with two or more folder names that are no infrastructure and hold ``least`` files. The search goes on below a depth with one folder or infrastructure only; without success the depth is 1."""
    inner = f.select("top", F.slice("parts", 2, deepest + 1).alias("p"), (F.size("parts") - 2).alias("folders"))
    every = inner.where("folders > 0").select("top", "p", F.explode(F.sequence(F.lit(1), F.least("folders", F.lit(deepest)))).alias("depth"))
    groups = every.groupBy("top", "depth", F.slice("p", F.lit(1), F.col("depth")).alias("prefix")).agg(F.count("*").alias("n")).withColumn("last", F.element_at("prefix", -1))
    plain = ~F.col("last").isin(*INFRASTRUCTURE)
    levels = groups.groupBy("top", "depth").agg(F.count_distinct(F.when(plain & (F.col("n") >= least), F.col("last"))).alias("domains"), F.count("*").alias("groups"), F.max(plain).alias("plain"))
    hit, stop = F.min(F.when(F.col("domains") >= 2, F.col("depth"))), F.min(F.when((F.col("domains") < 2) & (F.col("groups") > 1) & F.col("plain"), F.col("depth")))
    found = levels.groupBy("top").agg(hit.alias("hit"), stop.alias("stop"))
    return found.select("top", F.when(F.col("hit").isNotNull() & (F.col("stop").isNull() | (F.col("hit") < F.col("stop"))), F.col("hit")).otherwise(1).alias("depth"))


def modules(files: DataFrame, most: int = 25, least: int = 5, big: int = 80, deepest: int = 10) -> DataFrame:
    """(rel_path, module): the module of each file; null beyond the ``most`` largest modules, and for fewer than ``least`` files outside folders.

    A top folder of ``big`` files, or named like a sub-project, is cut at the
    depth where its domains lie; one of sources at its second folder; others stay
    whole. Equal names of one top folder are one module, those of another get
    its name before them. Modules of fewer than ``least`` files fold into the
    module named like their top folder, else into the root's, else into the
    largest of their top folder.
    """
    p = F.split("rel_path", "/")
    f = files.select("rel_path", p.alias("parts")).withColumn("top", F.when(F.size("parts") > 1, F.element_at("parts", 1)).otherwise(ROOT))
    tops = f.groupBy("top").agg(F.count("*").alias("n_top"))
    like = F.col("top").rlike(SUBPROJECT)
    subs = tops.where((F.col("top") != ROOT) & ~F.col("top").isin(*SOURCE_DIRS) & ((F.col("n_top") >= big) | like)).select("top")
    depth = subs.join(_depths(f.join(subs, "top"), least, deepest), "top", "left").select("top", F.coalesce("depth", F.lit(1)).alias("depth"))
    at = F.least("depth", F.size("parts") - 2)
    inner = F.when(at > 0, F.array_join(F.slice("parts", F.lit(2), at), "/")).otherwise(ROOT)
    cut = f.join(depth, "top", "left").withColumn("inner", F.when(F.col("depth").isNotNull(), inner))
    several = cut.where("depth is not null").groupBy("top").agg((F.count_distinct("inner") > 1).alias("several"))
    plain = F.when(F.col("top").isin(*SOURCE_DIRS) & (F.size("parts") > 2), F.concat_ws("/", "top", F.element_at("parts", 2))).otherwise(F.col("top"))
    whole = F.when(like, F.concat("top", F.lit(f"/{ROOT}"))).otherwise(F.col("top"))
    keyed = cut.join(several, "top", "left").select("rel_path", "top", F.when(F.col("several"), F.concat_ws("/", "top", "inner")).when(F.col("depth").isNotNull(), whole).otherwise(plain).alias("key"), F.coalesce(F.col("several") | (F.col("depth").isNotNull() & like), F.lit(False)).alias("sub"))
    keyed = stored(keyed, "keys")

    last = F.substring_index("key", "/", -1)
    inside = F.col("sub") & F.col("key").contains("/")
    name = F.when(inside & (last == ROOT), _short(F.col("top"))).when(inside, F.concat_ws("/", _short(F.col("top")), last)).otherwise(last)
    listed = keyed.groupBy("key", "top", "sub").agg(F.count("*").alias("n")).where((F.col("key") != ROOT) | (F.col("n") >= least)).withColumn("name", name)
    owner = listed.groupBy("name").agg(F.max_by("top", F.struct("n", "key")).alias("owner"))
    shown = listed.join(owner, "name").withColumn("display", F.when(F.col("top") == F.col("owner"), F.col("name")).otherwise(F.concat_ws("/", "top", "name")))
    shown = stored(shown.select("key", "top", "display", "n"), "named")
    sizes = stored(shown.groupBy("display").agg(F.sum("n").alias("n"), F.max_by("top", F.struct("n", "key")).alias("top")), "sizes")

    small = sizes.where(F.col("n") < least).select("display", "top", _short(F.col("top")).alias("short"))
    named = lambda alias: sizes.select(F.col("display").alias(alias), F.col("n").alias(f"{alias}_n"))
    largest = sizes.groupBy("top").agg(F.max_by("display", F.struct("n", "display")).alias("h4"), F.max("n").alias("h4_n"))
    hosts = small.join(named("h1"), F.col("short") == F.col("h1"), "left").join(named("h2"), F.col("top") == F.col("h2"), "left").join(largest, "top", "left")
    root = sizes.where(F.col("display") == ROOT).select(F.col("display").alias("h3"), F.col("n").alias("h3_n"))
    hosts = hosts.join(root, F.lit(True), "left")  # one row at most
    host, held = F.coalesce("h1", "h2", "h3", "h4"), F.when(F.col("h1").isNotNull(), F.col("h1_n")).when(F.col("h2").isNotNull(), F.col("h2_n")).when(F.col("h3").isNotNull(), F.col("h3_n")).otherwise(F.col("h4_n"))
    folds = hosts.where((host != F.col("display")) & (held >= least)).select("display", host.alias("host"))
    final = stored(shown.join(folds, "display", "left").select("key", F.coalesce("host", "display").alias("module"), "n"), "modules")
    top = final.groupBy("module").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "module").limit(most).select("module")
    kept = final.join(F.broadcast(top), "module", "left_semi").select("key", "module")  # at most `most` names
    return keyed.join(kept, "key", "left").select("rel_path", "module")


#: Extensions that line rules read, and the line counts that make a file large and very large.
RISK_EXT = ".ts .tsx .js .jsx .java .py .cs .go .rs .php .rb".split()
LARGE, VERY_LARGE = 500, 1500

#: Risk rules on a line: level, title, patterns that must all be found, one that must not.
RISK_RULES = [
    ("low", "open task", [r"(?i)\b(todo|fixme|hack|xxx)\b"], None),
    ("critical", "SQL by concatenation", [r"""(?i)['"`]\s*(select|insert|update|delete|drop|alter)\b""", r"\+"], None),
    ("critical", "process with concatenated arguments", [r"Runtime\.getRuntime\(\)\.exec\s*\(|new\s+ProcessBuilder\s*\(", r"\+|\$\{"], None),
    ("critical", "eval of a variable", [r"""\beval\s*\([^'")\s]"""], r"^\s*//"),
    ("medium", "empty catch", [r"catch\s*\([^)]*\)\s*(\{\s*\}|$)"], None),
    ("high", "weak cryptography", [r"\b(MD5|SHA1|SHA-1|DES|RC4|RC2)\b"], r"^(?:(?!\b(?:MD5|SHA1)).)*//."),
    ("high", "insecure random", [r"Math\.random\s*\(\)", r"(?i)token|password|secret|key|nonce|salt|seed|rand"], None),
    ("high", "CORS for all", [r"""cors\s*\(\s*\{[^}]*origin\s*:\s*['"`]\*['"`]|allowedOrigins.*\*|setHeader.*Access-Control-Allow-Origin.*\*"""], None),
    ("critical", "TLS check disabled", [r"(?i:ssl\s*:\s*false)|verify\s*=\s*False|rejectUnauthorized\s*:\s*false|(?i:DISABLE_SSL)"], None),
    ("high", "sensitive data logged", [r"(?:console\.log|System\.out\.print|logger\.\w+)\s*\(", r"(?i)password|senha|token|secret|apikey|api_key|cpf|cnpj|credit.card|card.number"], None),
    ("critical", "hard-coded credential", [r"""(?i)(password|secret)\s*=\s*['"][^'"]{3,}"""], None),
]


def line_rules(rows: DataFrame, rules) -> DataFrame:
    """(level, title, rel_path, line): the first line of each file that a rule (level, title, must, unless) fits. One scan for all rules."""
    fits = []
    for level, title, must, unless in rules:
        hit = reduce(lambda a, b: a & b, [F.col("text").rlike(p) for p in ([must] if isinstance(must, str) else must)])
        hit = hit & ~F.col("text").rlike(unless) if unless else hit
        fits.append(F.when(hit, F.struct(F.lit(level).alias("level"), F.lit(title).alias("title"))))
    found = rows.select("rel_path", "line", F.explode(F.array_compact(F.array(*fits))).alias("r"))
    return found.groupBy("r.level", "r.title", "rel_path").agg(F.min("line").alias("line"))


def risks(files: DataFrame, rules=RISK_RULES) -> DataFrame:
    """(level, title, rel_path, line): oversized files, and line rules over code."""
    n = F.size(F.split("content", "\n", -1))
    size = files.where(n > LARGE).select(F.when(n > VERY_LARGE, "critical").otherwise("medium").alias("level"), F.when(n > VERY_LARGE, "very large file").otherwise("large file").alias("title"), "rel_path", F.lit(1).alias("line"))
    return size.unionByName(line_rules(lines(files.where(F.col("ext").isin(*RISK_EXT))), rules))


def _groups(text: Column, pattern: str, *places: int) -> Column:
    hit = text.rlike(pattern)
    return F.when(hit, F.struct(*(F.regexp_extract(text, pattern, p).alias(f"g{i}") for i, p in enumerate(places))))


def endpoints(files: DataFrame) -> DataFrame:
    """(endpoint_id, ord, method, path, file, line): routes of controller-like files; on a line the first of Spring, ``.verb('/x')``, Nest, ``@x.verb``."""
    rows = lines(files.where(F.lower("rel_path").rlike("controller|route|router|handler|resource")))
    t = F.col("text")
    q = r"""["'`]([^"'`]*)["'`]"""
    spring = _groups(t, r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*" + q + ")?", 1, 2)
    verb = _groups(t, r"\.(get|post|put|delete|patch)\s*\(\s*" + q, 1, 2)
    nest = _groups(t, r"@(Get|Post|Put|Delete|Patch)\s*\(\s*(?:" + q + r")?\s*\)", 1, 2)
    python = _groups(t, r"@\w+\.(route)\s*\(\s*" + q, 1, 2)
    found = rows.withColumn("m", F.coalesce(spring, verb, nest, python)).where("m is not null and not (m.g1 = '' and m.g0 = 'Request' and text rlike 'class')")
    method = F.when(F.lower("m.g0").isin("request", "route"), "ANY").otherwise(F.upper("m.g0"))
    key = F.concat_ws(":", "rel_path", F.col("line").cast("string"))
    return found.select(key.alias("endpoint_id"), F.struct("rel_path", "line").alias("ord"), method.alias("method"), F.when(F.col("m.g1") == "", "/").otherwise(F.col("m.g1")).alias("path"), F.col("rel_path").alias("file"), "line")


def _around(before: int, after: int) -> Column:
    return F.array_join(F.collect_list("text").over(Window.partitionBy("rel_path").orderBy("line").rowsBetween(before, after)), "\n")


def http_calls(files: DataFrame) -> DataFrame:
    """(call_id, file, line, url, method, confidence): calls over HTTP of frontend code, without tests. A literal url is high, a built one low."""
    rows = lines(files.where(F.col("ext").isin(".ts", ".tsx", ".js", ".jsx", ".vue") & ~F.col("rel_path").rlike(r"\.(spec|test)\."))).withColumn("near", _around(-2, 4))
    t = F.col("text")
    url = r"""\s*(["'`])([^"'`]+)["'`]\s*(\+)?"""
    options = [
        _groups(t, r"\b(fetch)\s*\(" + url, 1, 3, 2, 4),
        _groups(t, r"\baxios\.(get|post|put|delete|patch)\s*(?:<[^>]*>)?\(" + url, 1, 3, 2, 4),
        _groups(t, r"\b(axios)\s*\(" + url, 1, 3, 2, 4),
        _groups(t, r"\bhttp\w*\.(get|post|put|delete|patch)\s*(?:<[^(]*>)?\s*\(" + url, 1, 3, 2, 4),
        _groups(t, r"""\.open\s*\(\s*["'](GET|POST|PUT|DELETE|PATCH)["']\s*,""" + url, 1, 3, 2, 4),
        _groups(t, r"\b(url)\s*:" + url, 1, 3, 2, 4),
    ]
    found = rows.withColumn("m", F.coalesce(*options)).where("m is not null and m.g1 rlike '/'")
    named = F.upper(F.regexp_extract("near", r"(?i)method\s*:\s*[\"'](get|post|put|delete|patch)", 1))
    method = F.when(F.lower("m.g0").isin("get", "post", "put", "delete", "patch"), F.upper("m.g0")).when(named != "", named).otherwise("GET")
    sure = F.when((F.col("m.g3") == "+") | F.col("m.g1").contains("${"), "low").otherwise("high")
    return found.select(F.concat_ws(":", "rel_path", F.col("line").cast("string")).alias("call_id"), F.col("rel_path").alias("file"), "line", F.regexp_replace("m.g1", r"\$\{[^}]*\}", "{x}").alias("url"), method.alias("method"), sure.alias("confidence"))


_NAME = r'"?(?:[A-Za-z_][\w$#]*"?\s*\.\s*"?)?([A-Za-z_][\w$#]*)"?'


def plsql_objects(files: DataFrame) -> DataFrame:
    """(kind, name, pkg, file, line, table): packages, procedures, functions, triggers (with their table within 6 lines), views, sequences, indexes, synonyms (table: what it stands for). Upper case, schema dropped."""
    rows = lines(files.where(F.col("ext").isin(*PLSQL))).withColumn("ahead", _around(0, 6))
    t = F.col("text")
    create = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:(?:NON)?EDITIONABLE\s+|PUBLIC\s+|UNIQUE\s+|FORCE\s+)*"
    pkg_pattern = create + r"PACKAGE\s+(?:BODY\s+)?" + _NAME
    kind = F.when(t.rlike(pkg_pattern), "package")
    name = F.when(t.rlike(pkg_pattern), F.regexp_extract(t, pkg_pattern, 1))
    for k in ("procedure", "function", "trigger", "view", "sequence", "index", "synonym"):
        p = create + f"{k.upper()}\\s+" + _NAME
        kind, name = F.coalesce(kind, F.when(t.rlike(p), k)), F.coalesce(name, F.when(t.rlike(p), F.regexp_extract(t, p, 1)))
    inner = r"(?i)^\s*(PROCEDURE|FUNCTION)\s+([A-Za-z_][\w$#]*)"
    kind, name = F.coalesce(kind, F.when(t.rlike(inner), F.lower(F.regexp_extract(t, inner, 1)))), F.coalesce(name, F.when(t.rlike(inner), F.regexp_extract(t, inner, 2)))
    w = Window.partitionBy("rel_path").orderBy("line")
    own = F.when(t.rlike(pkg_pattern), F.upper(F.regexp_extract(t, pkg_pattern, 1)))
    marked = rows.withColumn("pkg", F.last(own, True).over(w)).withColumn("kind", kind).withColumn("name", F.upper(name)).where("kind is not null and name != ''")
    on = F.when(F.col("kind").isin("trigger", "index"), F.upper(F.regexp_extract("ahead", r"(?is)\bON\s+" + _NAME, 1))).when(F.col("kind") == "synonym", F.upper(F.regexp_extract("ahead", r"(?is)\bFOR\s+" + _NAME, 1)))
    member = F.when(F.col("kind").isin("procedure", "function"), F.col("pkg"))
    out = marked.select("kind", "name", member.alias("pkg"), F.col("rel_path").alias("file"), "line", F.nullif(on, F.lit("")).alias("table"))
    return out.groupBy("kind", "name", "pkg", "file").agg(F.min("line").alias("line"), F.first("table", True).alias("table"))


#: SQL words that stand where a table could.
NOT_TABLES = "SELECT WHERE SET VALUES DUAL TABLE INTO FROM JOIN ON AND OR NOT NULL THE CURRENT EACH OF LOOP IF".split()


def _scoped(files: DataFrame) -> DataFrame:
    """Lines of PL/SQL with the object that they are in (``PKG.NAME`` or ``NAME``); lines before any are left out."""
    rows = lines(files.where(F.col("ext").isin(*PLSQL))).where(~F.col("text").rlike(r"^\s*--"))
    t = F.col("text")
    pkg = r"(?i)\bPACKAGE\s+(?:BODY\s+)?" + _NAME
    proc = r"(?i)^\s*(?:CREATE\s+(?:OR\s+REPLACE\s+)?)?(?:PROCEDURE|FUNCTION|TRIGGER)\s+" + _NAME
    w = Window.partitionBy("rel_path").orderBy("line")
    rows = rows.withColumn("pkg", F.last(F.when(t.rlike(pkg), F.upper(F.regexp_extract(t, pkg, 1))), True).over(w)).withColumn("proc", F.last(F.when(t.rlike(proc), F.upper(F.regexp_extract(t, proc, 1))), True).over(w))
    return rows.where("proc is not null").withColumn("object", F.concat_ws(".", "pkg", "proc"))


def plsql_table_access(files: DataFrame) -> DataFrame:
    """(object, table, mode, file): tables that each PL/SQL object reads (FROM, JOIN) and writes (INSERT, UPDATE, DELETE, MERGE); DELETE FROM counts as both."""
    rows = _scoped(files)
    write = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|DELETE|MERGE\s+INTO)\s+" + _NAME), 1)
    read = F.regexp_extract_all("text", F.lit(r"(?i)\b(?:FROM|JOIN)\s+" + _NAME), 1)
    both = rows.select("object", F.col("rel_path").alias("file"), F.explode(F.concat(F.transform(write, lambda x: F.struct(F.upper(x).alias("table"), F.lit("write").alias("mode"))), F.transform(read, lambda x: F.struct(F.upper(x).alias("table"), F.lit("read").alias("mode"))))).alias("a"))
    return both.select("object", "a.table", "a.mode", "file").where(~F.col("table").isin(*NOT_TABLES) & (F.length("table") >= 2)).distinct()


def plsql_calls(files: DataFrame) -> DataFrame:
    """(caller, callee, pkg, dynamic, file, line): ``pkg.proc(`` or ``pkg.proc;`` at a statement's start, and EXECUTE IMMEDIATE as dynamic."""
    p = r"(?i)^\s*([A-Za-z_][\w$#]*)\.([A-Za-z_][\w$#]*)\s*[(;]"
    rows = _scoped(files).withColumn("dynamic", F.col("text").rlike(r"(?i)\bEXECUTE\s+IMMEDIATE\b"))
    hit = rows.where((F.col("text").rlike(p) & ~F.upper(F.regexp_extract("text", p, 1)).isin("IF", "FOR", "WHILE", "RETURN", "NEW", "OLD", "DBMS_OUTPUT")) | F.col("dynamic"))
    name = lambda i: F.when(~F.col("dynamic"), F.upper(F.regexp_extract("text", p, i)))
    return hit.select(F.col("object").alias("caller"), name(2).alias("callee"), name(1).alias("pkg"), "dynamic", F.col("rel_path").alias("file"), "line")


def db_calls(files: DataFrame) -> DataFrame:
    """(file, line, name, pkg, confidence): stored procedures that backend code calls. Of a dotted name the last two parts count."""
    mark = r"(?i)procedure|simplejdbccall|callproc|\bcall\b|oracledb|commandtext|begin\s"
    rows = lines(files.where(F.col("ext").isin(*CODE) & F.col("content").rlike(mark))).withColumn("ahead", _around(0, 4))
    q = r"""["'`]([\w$#.]+)["'`]"""
    options = [
        ("text", r"@Procedure\s*\(\s*(?:(?:name|procedureName|value)\s*=\s*)?" + q, "high"),
        ("text", r"(?:createStoredProcedureQuery|createNamedStoredProcedureQuery)\s*\(\s*" + q, "high"),
        ("text", r"procedureName\s*=\s*" + q, "high"),
        ("text", r"""(?i)["'`]\s*\{?\s*(?:\?\s*=\s*)?call\s+([\w$#.]+)""", "high"),
        ("text", r"""(?i)["'`]\s*begin\s+([\w$#.]+)\s*\(""", "high"),
        ("text", r"\.callproc\s*\(\s*" + q, "high"),
        ("text", r"(?:CommandText\s*=|new\s+OracleCommand\s*\()\s*" + q, "high"),
        ("text", r"""["'`]([A-Z][A-Z0-9_$#]+\.[A-Z][A-Z0-9_$#]+)["'`]""", "low"),
    ]
    hit = F.coalesce(*(F.when(F.col(c).rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("raw"), F.lit(sure).alias("confidence"))) for c, p, sure in options))
    catalog = F.when(F.col("text").contains("SimpleJdbcCall"), F.struct(F.concat_ws(".", F.nullif(F.regexp_extract("ahead", r"withCatalogName\s*\(\s*" + q, 1), F.lit("")), F.nullif(F.regexp_extract("ahead", r"with(?:Procedure|Function)Name\s*\(\s*" + q, 1), F.lit(""))).alias("raw"), F.lit("high").alias("confidence")))
    found = rows.withColumn("m", F.coalesce(F.when(catalog.getField("raw") != "", catalog), hit)).where("m is not null")
    parts = F.split(F.upper("m.raw"), r"\.")
    return found.select(F.col("rel_path").alias("file"), "line", F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("pkg"), "m.confidence").distinct()


def orm_mappings(files: DataFrame) -> DataFrame:
    """(file, table, mode): tables of JVM entities and repositories. An entity is its @Table's, else its class's name; a repository has access to its entity's table, and to those of SQL in its queries."""
    jvm = files.where(F.col("ext").isin(*JVM))
    c = F.col("content")
    entity = jvm.where(c.contains("@Entity")).select(F.col("rel_path").alias("file"), F.regexp_extract("content", r"\bclass\s+(\w+)", 1).alias("entity"), F.upper(F.coalesce(F.nullif(F.regexp_extract("content", r'@Table\s*\([^)]*name\s*=\s*"(?:\w+\.)?(\w+)"', 1), F.lit("")), F.regexp_extract("content", r"\bclass\s+(\w+)", 1))).alias("table"))
    repo = jvm.select(F.col("rel_path").alias("file"), F.regexp_extract("content", r"extends\s+\w*Repository\s*<\s*(\w+)", 1).alias("entity"), "content").where("entity != ''")
    named = entity.select("entity", "table")
    own = repo.select("file", "entity").join(named, "entity", "left").select("file", F.upper(F.coalesce("table", "entity")).alias("table"), F.lit("access").alias("mode"))
    sql = jvm.select(F.col("rel_path").alias("file"), F.explode(F.regexp_extract_all("content", F.lit(r'(?s)@(?:Query|NamedNativeQuery|Select|Insert|Update|Delete)\s*\(\s*(?:\w+\s*=\s*)?((?:"(?:[^"\\]|\\.)*"\s*\+?\s*)+)'), 1)).alias("sql"))
    parsed = sql_tables(sql.withColumn("sql", F.regexp_replace("sql", r'"\s*\+?\s*"?', " ")), "sql").join(named.withColumn("key", F.upper("entity")).select("key", F.col("table").alias("real")), F.col("table") == F.col("key"), "left")
    return own.unionByName(parsed.select("file", F.coalesce("real", "table").alias("table"), "mode")).unionByName(entity.select("file", "table", F.lit("access").alias("mode"))).distinct()


def sql_tables(rows: DataFrame, sql: str) -> DataFrame:
    """rows with table and mode for each table that the SQL text names."""
    write = F.regexp_extract_all(sql, F.lit(r"(?i)\b(?:INSERT\s+INTO|UPDATE|DELETE\s+FROM|MERGE\s+INTO)\s+" + _NAME), 1)
    read = F.regexp_extract_all(F.regexp_replace(sql, r"(?i)DELETE\s+FROM", "DELETE"), F.lit(r"(?i)\b(?:FROM|JOIN)\s+" + _NAME), 1)
    row = lambda mode: lambda x: F.struct(F.upper(x).alias("table"), F.lit(mode).alias("mode"))
    return rows.select("*", F.explode(F.concat(F.transform(write, row("write")), F.transform(read, row("read")))).alias("__a")).select("*", "__a.table", "__a.mode").drop("__a").where(~F.col("table").isin(*NOT_TABLES))


def sql_columns(rows: DataFrame, sql: str) -> DataFrame:
    """rows with table, column and mode: INSERT lists and UPDATE SET as writes, SELECT lists as reads; unqualified names belong to the only table."""
    s = F.regexp_replace(F.col(sql), r"(:\w+|\?\d*)", "0")
    one = F.upper(F.regexp_extract(s, r"(?i)\b(?:FROM|INTO|UPDATE)\s+" + _NAME, 1))
    listed = F.split(F.coalesce(F.nullif(F.regexp_extract(s, r"(?is)INSERT\s+INTO\s+[\w.\"]+\s*\(([^)]*)\)", 1), F.lit("")), F.lit("")), ",")
    sets = F.regexp_extract_all(F.regexp_extract(s, r"(?is)\bSET\s+(.*?)(?:\bWHERE\b|$)", 1), F.lit(r"(?:^|,)\s*(?:\w+\.)?(\w+)\s*="), 1)
    reads = F.split(F.regexp_extract(s, r"(?is)\bSELECT\s+(.*?)\bFROM\b", 1), ",")
    row = lambda mode: lambda x: F.struct(F.upper(F.regexp_extract(x, r"(?:\w+\.)?(\w+)\s*$", 1)).alias("column"), F.lit(mode).alias("mode"))
    every = F.concat(F.transform(listed, row("write")), F.transform(sets, row("write")), F.transform(reads, row("read")))
    return rows.withColumn("table", one).select("*", F.explode(every).alias("__c")).select("*", "__c.column", "__c.mode").drop("__c").where("column != '' and table != ''").distinct()


#: Extensions of a screen's code, and what its name may have added.
SCREEN_CODE = ".tsx .ts .jsx .js".split()
SCREEN_SUFFIXES = "Controller Component View Screen Page".split()


def osw_links(files: DataFrame) -> DataFrame:
    """(from_file, to_file, kind, confidence): code that a screen definition names. First by its own name with a role suffix, then by its bare name, then by any PascalCase string in it; a name that one file has is resolved, a bare or shared name inferred."""
    stem = F.regexp_replace(base_name(F.col("rel_path")), r"\.(tsx|ts|jsx|js|osw)$", "")
    screens = files.where("ext = '.osw'").select(F.col("rel_path").alias("from_file"), "content", F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 1 << 20)).alias("pascal"))
    suffixed = [F.struct(F.concat("pascal", F.lit(x)).alias("name"), F.lit(1).alias("rank")) for x in SCREEN_SUFFIXES]
    named = F.transform(F.regexp_extract_all("content", F.lit(r'"([A-Z][A-Za-z0-9_]{2,60})"(?!\s*:)'), 1), lambda x: F.struct(x.alias("name"), F.lit(3).alias("rank")))
    names = screens.select("from_file", F.explode(F.concat(F.array(*suffixed, F.struct(F.col("pascal").alias("name"), F.lit(2).alias("rank"))), named)).alias("n")).select("from_file", "n.name", "n.rank").distinct()
    code = files.where(F.col("ext").isin(*SCREEN_CODE)).select(F.col("rel_path").alias("to_file"), stem.alias("name"))
    holders = code.groupBy("name").agg(F.count("*").alias("n"))
    hit = names.join(holders, "name").join(code, "name").where("from_file != to_file")
    first = F.min(F.struct("rank", F.when((F.col("rank") != 2) & (F.col("n") == 1), "resolved").otherwise("inferred").alias("confidence"))).alias("first")
    return hit.groupBy("from_file", "to_file").agg(first).select("from_file", "to_file", F.lit("osw-ref").alias("kind"), "first.confidence")


#: Business rule markers on a line: type and pattern.
BUSINESS_RULES = [
    ("constraint", r"@(NotNull|NotBlank|NotEmpty|Size|Min|Max|Pattern|Email|Positive|Past|Future|AssertTrue|DecimalMin|DecimalMax)\b"),
    ("schema", r"\b(z|yup|Joi)\.(object|string|number|array)\("),
    ("dto", r"@Is(NotEmpty|Email|String|Number|Int|Optional|Date|Enum|Boolean)\w*\("),
    ("enum", r"\benum\s+\w+"),
    ("guard", r"\bthrow\s+new\s+\w*(Exception|Error)\b"),
    ("constant", r"\b(MAX|MIN|LIMIT|DEFAULT|TIMEOUT|RATE)_[A-Z0-9_]+\s*="),
]


def business_rules(files: DataFrame, rules=BUSINESS_RULES) -> DataFrame:
    """(type, text, file, line, values): rule-like lines; an enum has the first six values of its next 19 lines. One per type, first 60 characters and file."""
    rows = lines(files.where(F.col("ext").isin(*CODE))).withColumn("ahead", _around(1, 19))
    fits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(kind)) for kind, p in rules)))
    found = rows.select("rel_path", "line", F.trim("text").alias("text"), "ahead", F.explode(fits).alias("type"))
    body = F.regexp_extract("ahead", r"(?s)^([^}]*)", 1)
    values = F.when(F.col("type") == "enum", F.slice(F.regexp_extract_all(body, F.lit(r"(?m)^\s*([A-Za-z_]\w*)\s*(?:[=,({]|$)"), 1), 1, 6))
    first = Window.partitionBy("type", F.substring("text", 1, 60), "rel_path").orderBy("line")
    return found.withColumn("r", F.row_number().over(first)).where("r = 1").select("type", "text", F.col("rel_path").alias("file"), "line", values.alias("values"))


def permissions(files: DataFrame, found_endpoints: DataFrame) -> DataFrame:
    """(file, line, kind, roles, endpoint): security marks with the first endpoint on their own or the next four lines."""
    rows = lines(files.where(F.col("ext").isin(*CODE)))
    t = F.col("text")
    kinds = [("pre-authorize", r"@(?:PreAuthorize|PostAuthorize)\s*\((.*)\)"), ("roles-allowed", r"@(?:RolesAllowed|Secured|Roles)\s*\((.*)\)"), ("guard", r"@UseGuards\s*\((.*)\)"), ("authorize", r"\[Authorize(.*)\]")]
    hit = F.coalesce(*(F.when(t.rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract(t, p, 1).alias("body"))) for k, p in kinds))
    marks = rows.withColumn("m", hit).where("m is not null").select(F.col("rel_path").alias("file"), "line", "m.kind", "m.body")
    names = F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"""["'](?:ROLE_)?([A-Za-z_]\w*)["']"""), 1), lambda x: F.regexp_replace(x, "^ROLE_", "")))
    marks = marks.withColumn("roles", F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("authenticated")))).drop("body")
    e = found_endpoints.select("file", F.col("line").alias("e_line"), F.concat_ws(" ", "method", "path").alias("endpoint"))
    return nearest_after(marks, e, "file", "line", "e_line", 4, "endpoint")


def nearest_after(left: DataFrame, right: DataFrame, key: str, at: str, other: str, reach: int, value: str) -> DataFrame:
    """Range join: left with the value of the first right row of its key within ``reach`` after ``at``, null without one. Both sides are cut to blocks of reach + 1, so the join is an equi-join on key and block."""
    size = reach + 1
    spread = left.select("*", F.explode(F.array(F.floor(F.col(at) / size), F.floor(F.col(at) / size) + 1)).alias("__b"))
    r = right.select(F.col(key).alias("__k"), F.col(other), F.col(value), F.floor(F.col(other) / size).alias("__b2"))
    hit = spread.join(r, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2")) & (F.col(other) >= F.col(at)) & (F.col(other) <= F.col(at) + reach))
    best = hit.groupBy(key, at).agg(F.min_by(value, F.struct(other, value)).alias(value))
    return left.join(best, [key, at], "left")


def transactions(files: DataFrame) -> DataFrame:
    """(file, line, scope, propagation, read_only, rollback_for): @Transactional marks, read with the next six lines."""
    rows = lines(files.where(F.col("ext").isin(*JVM, ".ts"))).withColumn("ahead", _around(0, 6)).withColumn("rest", _around(1, 6))
    hit = rows.where(F.col("text").rlike(r"@Transactional\b"))
    body = F.regexp_extract("ahead", r"(?s)^[^@]*@Transactional\s*(\([^)]*\))?", 1)
    propagation = F.coalesce(F.nullif(F.regexp_extract(body, r"(?:Propagation\.|propagation\s*=\s*)(REQUIRES_NEW|REQUIRED|MANDATORY|SUPPORTS|NOT_SUPPORTED|NEVER|NESTED)", 1), F.lit("")), F.lit("REQUIRED"))
    following = F.regexp_extract("rest", r"(?m)^\s*([^@\s/*].*)$", 1)
    scope = F.when(following.rlike(r"\b(class|interface)\b"), "class").otherwise("method")
    return hit.select(F.col("rel_path").alias("file"), "line", scope.alias("scope"), propagation.alias("propagation"), body.rlike(r"readOnly\s*=\s*true").alias("read_only"), F.nullif(F.regexp_extract(body, r"rollbackFor\s*=\s*\{?\s*([\w.]+)", 1), F.lit("")).alias("rollback_for"))


def transaction_report(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("all"), F.count(F.when(F.col("propagation") == "REQUIRES_NEW", 1)).alias("requires_new"), F.count(F.when(F.col("read_only"), 1)).alias("read_only"))


def batch_jobs(files: DataFrame) -> DataFrame:
    """(file, line, kind, schedule, method): scheduled, asynchronous, Quartz and batch jobs with the next method's name within seven lines."""
    mark = r"@Scheduled|@Async|implements\s+Job\b|@Cron|JobBuilder|StepBuilder|cron\.schedule"
    rows = lines(files.where(F.col("ext").isin(*JVM, ".ts", ".js") & F.col("content").rlike(mark))).withColumn("ahead", _around(0, 7))
    t = F.col("text")
    kind = F.when(t.rlike("@Scheduled|@Cron|cron\\.schedule"), "scheduled").when(t.rlike("@Async"), "async").when(t.rlike(r"implements\s+Job\b"), "quartz").when(t.rlike("JobBuilder|StepBuilder"), "batch")
    schedule = F.coalesce(F.nullif(F.regexp_extract(t, r"""(?:cron\s*=\s*|@Cron\s*\(\s*|schedule\s*\(\s*)["']([^"']+)["']""", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(fixedRate(?:String)?\s*=\s*\"?[\w.${}]+|fixedDelay(?:String)?\s*=\s*\"?[\w.${}]+)", 1), F.lit("")))
    method = F.nullif(F.regexp_extract("ahead", r"(?m)^\s*(?:public|private|protected|async|static|\s)*(?:[\w<>\[\]]+\s+)?(\w+)\s*\([^)]*\)\s*(?:throws\s+[\w,\s]+)?(?::\s*[\w<>]+)?\s*\{", 1), F.lit(""))
    return rows.withColumn("kind", kind).where("kind is not null").select(F.col("rel_path").alias("file"), "line", "kind", schedule.alias("schedule"), method.alias("method"))


#: Design patterns by file name (with the confidence that it gives), and by content.
PATTERN_EXT = ".ts .tsx .js .jsx .java .py .cs .kt".split()
PATTERNS_BY_NAME = [
    ("Repository", r"[Rr]epository\.(ts|js|java|cs|py)$", "resolved"),
    ("Repository", r"[Dd]ao\.(ts|js|java|cs|py)$", "resolved"),
    ("Service", r"[Ss]ervice\.(ts|js|java|cs|py)$", "resolved"),
    ("Controller", r"[Cc]ontroller\.(ts|js|java|cs|py)$", "resolved"),
    ("Controller", r"[Rr]outer?\.(ts|js)$", "resolved"),
    ("Controller", r"[Hh]andler\.(ts|js|java|cs|py)$", "inferred"),
    ("Factory", r"[Ff]actory\.(ts|js|java|cs|py)$", "resolved"),
    ("Facade", r"[Ff]acade\.(ts|js|java|cs|py)$", "resolved"),
    ("DTO", r"[Dd][Tt][Oo]\.(ts|js|java|cs|py)$", "resolved"),
    ("DTO", r"[Rr]equest\.(ts|js|java|cs)$", "inferred"),
    ("DTO", r"[Rr]esponse\.(ts|js|java|cs)$", "inferred"),
    ("Entity", r"[Ee]ntity\.(ts|js|java|cs|py)$", "resolved"),
    ("Entity", r"[Mm]odel\.(ts|js|java|cs|py)$", "inferred"),
    ("Mapper", r"[Mm]apper\.(ts|js|java|cs|py)$", "resolved"),
    ("Middleware", r"[Mm]iddleware\.(ts|js|py)$", "resolved"),
    ("Interceptor", r"[Ii]nterceptor\.(ts|java|cs)$", "resolved"),
    ("Guard", r"[Gg]uard\.(ts|java|cs)$", "resolved"),
    ("Provider", r"[Pp]rovider\.(ts|js)$", "resolved"),
    ("UseCase", r"[Uu]se[Cc]ase\.(ts|js|java|cs|py)$", "resolved"),
]
PATTERNS_BY_TEXT = [
    ("Repository", r"(?i)@Repository|@JpaRepository|extends.*Repository"),
    ("Service", r"(?i)@Service|@Injectable.*service"),
    ("Controller", r"(?i)@Controller|@RestController|@RequestMapping"),
    ("Service", r"(?i)@Component\b|@Injectable\b"),
    ("Mapper", r"(?i)@Mapper\b|implements.*Mapper"),
    ("Middleware", r"(?i)@Middleware|implements.*Middleware"),
    ("Interceptor", r"(?i)@UseInterceptors|@Interceptor"),
    ("Guard", r"(?i)@UseGuards|@Guard\b|implements.*Guard"),
    ("Observer", r"(?i)@EventListener|@Subscribe|implements.*Observer"),
    ("Strategy", r"(?i)implements.*Strategy\b|Strategy\s*\{"),
    ("UseCase", r"(?i)implements.*UseCase|class.*UseCase\b"),
    ("Entity", r"(?i)@Entity\b|@Table\b|@ORM\b"),
]


def patterns(files: DataFrame, by_name=PATTERNS_BY_NAME, by_text=PATTERNS_BY_TEXT) -> DataFrame:
    """(file, pattern, source, class_name, confidence): labels of each code file, once each: the first rule that gives one, names before content. The class is told of labels by content."""
    name, text = base_name(F.col("rel_path")), F.col("content")
    rules = [(name.rlike(p), k, "name", sure) for k, p, sure in by_name] + [(text.rlike(p), k, "text", "resolved") for k, p in by_text]
    fits = [F.when(hit, F.struct(F.lit(k).alias("pattern"), F.lit(i).alias("i"), F.lit(source).alias("source"), F.lit(sure).alias("confidence"))) for i, (hit, k, source, sure) in enumerate(rules)]
    cls = F.nullif(F.regexp_extract("content", r"(?:class|interface)\s+(\w+)", 1), F.lit(""))
    rows = files.where(F.col("ext").isin(*PATTERN_EXT)).select(F.col("rel_path").alias("file"), cls.alias("class_name"), F.explode(F.array_compact(F.array(*fits))).alias("m"))
    first = rows.groupBy("file", "class_name", "m.pattern").agg(F.min(F.struct("m.i", "m.source", "m.confidence")).alias("f"))
    return first.select("file", "pattern", "f.source", F.when(F.col("f.source") == "text", F.col("class_name")).alias("class_name"), "f.confidence")


def classes(files: DataFrame) -> DataFrame:
    """(name, kind, parent, interfaces, file): class and interface declarations of Java, TypeScript, C# and Python."""
    rows = lines(files.where(F.col("ext").isin(*CODE)))
    p = r"^\s*(?:export\s+)?(?:default\s+)?(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+|sealed\s+)*(class|interface)\s+(\w+)(?:<[^>{]*>)?(?:\s*\(\s*([\w.]+)[^)]*\)\s*:)?(?:\s+extends\s+([\w.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+([\w.,\s<>]+))?"
    g = lambda i: F.nullif(F.regexp_extract("text", p, i), F.lit(""))
    return rows.where(F.col("text").rlike(p)).select(g(2).alias("name"), g(1).alias("kind"), F.coalesce(g(4), g(3)).alias("parent"), F.filter(F.transform(F.split(F.coalesce(F.regexp_replace(g(5), "<[^>]*>", ""), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "").alias("interfaces"), F.col("rel_path").alias("file"))


def inheritance(found: DataFrame) -> DataFrame:
    """(name, parent, depth, is_root, is_leaf): depth 1 for roots (no parent, or one that is not declared); classes on or below a cycle have no depth.

    Pointers to ancestors double their reach each round, so a chain of d classes takes log2(d) rounds, however long.
    A round that reaches no further root ends it: what is left leads into cycles.
    """
    one = stored(found.groupBy("name").agg(F.min("parent").alias("parent")), "classes")
    names = one.select(F.col("name").alias("parent"))
    extended = found.select(F.col("parent").alias("name")).union(found.select(F.explode("interfaces"))).where("name is not null").distinct()
    root = one.join(names, "parent", "left_anti").select("name")
    known = stored(root.select("name", F.lit(None).cast("string").alias("up"), F.lit(1).cast("long").alias("dist")), "roots")  # without up, dist is the depth
    left = stored(one.join(names, "parent").select("name", F.col("parent").alias("up"), F.lit(1).cast("long").alias("dist")), "children")
    while True:
        far = known.unionByName(left).select(F.col("name").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more"))
        rows = stored(left.join(far, "up").select("name", F.col("next").alias("up"), (F.col("dist") + F.col("more")).alias("dist")), "pointers")
        done = rows.where("up is null")
        if done.isEmpty():
            break
        known, left = known.unionByName(done), rows.where("up is not null")
    depth = known.select("name", F.col("dist").cast("int").alias("depth"))
    marked = one.join(depth, "name", "left").join(root.withColumn("is_root", F.lit(True)), "name", "left")
    used = extended.withColumn("used", F.lit(True))
    return marked.join(used, "name", "left").select("name", "parent", "depth", F.coalesce("is_root", F.lit(False)).alias("is_root"), F.col("used").isNull().alias("is_leaf"))


def children_report(found: DataFrame, top: int = 20) -> DataFrame:
    return found.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).orderBy(F.desc("children"), "parent").limit(top)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
