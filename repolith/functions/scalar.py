"""Scalar functions of the engine, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix_lines(text: Column | str, prefix: str) -> Column:
    """``prefix`` before every line and a line end after each; empty text stays empty."""
    t = _c(text)
    return F.when(t == "", F.lit("")).otherwise(F.concat(F.array_join(F.transform(F.split(t, "\n", -1), lambda x: F.concat(F.lit(prefix), x)), "\n"), F.lit("\n")))


def trim_c_type(t: Column | str) -> Column:
    """A C-like type without pointers, references, array bounds and qualifiers."""
    return F.trim(F.regexp_replace(_c(t), r"[*&]|\[\d*\]|const|volatile|restrict", ""))


def trim_rust_type(t: Column | str) -> Column:
    """A Rust type without references, mut and type arguments."""
    return F.trim(F.element_at(F.split(F.regexp_replace(F.regexp_replace(_c(t), "&", ""), "mut ", ""), "<"), 1))


#: Names of TypeScript's own types, in lower case.
TS_BASIC = ("any", "bigint", "boolean", "null", "number", "object", "string", "symbol", "undefined", "unknown", "void")


def trim_ts_type(t: Column | str) -> Column:
    """First capitalised name of a TypeScript type, without arrays and type arguments of any depth; null for a basic one."""
    bare = F.regexp_replace(_c(t), r"\[\s*\]", "")
    levels = F.sequence(F.lit(0), F.length(F.regexp_replace(bare, "[^<]", "")))
    out = F.aggregate(levels, bare, lambda text, _: F.regexp_replace(text, r"<[^<>]*>", ""))
    name = F.regexp_extract(out, r"([A-Z][A-Za-z0-9_]*)", 1)
    return F.when((name != "") & ~F.lower(name).isin(*TS_BASIC), name)


def strip_resource(filename: Column | str, repo: Column | str) -> Column:
    """A file name without a leading resource/<repo>/, else without a leading resource/."""
    f, own = _c(filename), F.concat(F.lit("resource/"), _c(repo), F.lit("/"))
    return F.when(F.startswith(f, own), F.substr(f, F.length(own) + 1)).when(F.startswith(f, F.lit("resource/")), F.substr(f, F.lit(10))).otherwise(f)


def ts_function_names(text: Column | str) -> Column:
    """Distinct names that a TypeScript source defines: functions, and the first method of each class."""
    names = lambda p: F.regexp_extract_all(_c(text), F.lit(p), 1)
    return F.array_distinct(F.concat(names(r"function\s+(\w+)\s*\("), names(r"(?s)class\s+\w+\s*\{\s*.*?(\w+)\s*\(")))


#: Kinds of errors, and statuses, after which a call is made again.
RETRY_KINDS = ("APIConnectionError", "APITimeoutError", "InternalServerError", "RateLimitError", "ReadTimeout")
RETRY_STATUSES = (408, 409, 429, 500, 502, 503, 504)


def retryable(kind: Column | str, status: Column | str) -> Column:
    """Whether a failed call may be made again; never after its deadline."""
    known = F.coalesce(_c(kind).isin(*RETRY_KINDS), F.lit(False)) | F.coalesce(_c(status).isin(*RETRY_STATUSES), F.lit(False))
    return known & ~F.coalesce(_c(kind) == "LLMDeadlineExceeded", F.lit(False))


def clean_type_name(t: Column | str) -> Column:
    """Last path segment of a type without lifetimes, references, mut and type arguments."""
    bare = F.regexp_replace(F.regexp_replace(_c(t), r"'[a-z_]+\s+", ""), r"&|\bmut\s+", "")
    return F.trim(F.substring_index(F.element_at(F.split(bare, "<"), 1), "::", -1))


def module_path(path: Column | str) -> Column:
    """Module of a Rust source file: crate for main and lib, a folder for mod.rs."""
    p = F.regexp_replace(F.regexp_replace(_c(path), r"^(.*/)?src/", ""), r"\.rs$", "")
    p = F.regexp_replace(p, r"(^|/)(main|lib|mod)$", "")
    return F.when(p == "", F.lit("crate")).otherwise(F.concat(F.lit("crate::"), F.regexp_replace(p, "/", "::")))


def is_test_path(path: Column | str) -> Column:
    """In a test, bench or example folder, or of such a name."""
    p = F.lower(_c(path))
    return p.rlike(r"(^|/)(tests?|benches|examples)/") | F.element_at(F.split(p, "/"), -1).rlike("test|bench|example")


def is_likely_function(name: Column | str) -> Column:
    """A name that a function could have: lower case or underscore first, or new or default; not all capitals."""
    n = _c(name)
    return (n.isin("new", "default") | n.rlike("^[a-z_]")) & ~n.rlike("^[A-Z0-9_]+$")


def access(modifier: Column | str, otherwise: str = "public") -> Column:
    m = _c(modifier)
    return F.when(F.contains(m, F.lit("PRIVATE")), "private").when(F.contains(m, F.lit("PROTECTED")), "protected").when(F.contains(m, F.lit("PUBLIC")), "public").otherwise(otherwise)


def visible(lang: Column | str, modifier: Column | str, in_header: Column) -> Column:
    """Whether a function belongs to the interface: by header and static in C, by modifier in Rust and TypeScript, always elsewhere."""
    l, m = _c(lang), F.coalesce(_c(modifier), F.lit(""))
    return (
        F.when(l.isin("c", "cpp"), in_header & ~F.contains(m, F.lit("STATIC")))
        .when(l == "rust", F.contains(m, F.lit("PUBLIC"))).when(l == "ts", m == "public").otherwise(F.lit(True))
    )


def signature(returns: Column, name: Column, params: Column) -> Column:
    """Return type, name and parameter types."""
    return F.concat(returns, F.lit(" "), name, F.lit("("), F.array_join(F.transform(params, lambda p: p["type"]), ", "), F.lit(")"))


def truncated(text: Column | str, n: int, mark: str = "\n...") -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(mark))).otherwise(t)


def line_range(text: Column, begin: Column, end: Column, clamp: bool = True) -> Column:
    """Lines begin to end, from 1. Past the text's end they are cut, or with ``clamp`` False the result is empty."""
    lines = F.split(text, "\n", -1)
    first = F.greatest(begin, F.lit(1))
    cut = F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")
    return cut if clamp else F.when(end > F.size(lines), F.lit("")).otherwise(cut)


def section(block: Column | str, title: str) -> Column:
    """Text of a level-4 Markdown section; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(_c(block), rf"(?s)#### {title}\s*\n(.*?)(?=####|\z)", 1), F.lit(" \n\r\t")), F.lit(""))


def bullets(text: Column | str) -> Column:
    """Items of a list of lines that begin with a dash."""
    return F.transform(F.filter(F.split(_c(text), "\n"), lambda x: x.startswith("-")), lambda x: F.trim(F.substring(x, 2, 1 << 20)))


def bullet_text(items: Column | str) -> Column:
    return F.array_join(F.transform(_c(items), lambda x: F.concat(F.lit("- "), x)), "\n")


def ordinals(line: Column | str) -> Column:
    """Numbers that open a list line: '2. name', '- 3', '1, 4, x'; what is no number goes."""
    bare = F.regexp_replace(_c(line), r"^\s*-\s*", "")
    head = F.element_at(F.split(bare, r"\."), 1)
    return F.filter(F.transform(F.split(head, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def safe_name(name: Column | str, default: str = "unnamed") -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(_c(name)), r"[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit(default))


def url_stem(url: Column | str) -> Column:
    """Last path segment of a URL without its extension."""
    path = F.regexp_replace(F.regexp_replace(_c(url), r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_replace(F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1), r"\.[^.]*$", "")


def next_patch(version: Column | str) -> Column:
    """The version with its third number one higher; 1.0.1 where it isn't three numbers."""
    v = _c(version)
    parts = F.split(v, r"\.")
    up = F.concat_ws(".", parts[0], parts[1], (parts[2].cast("int") + 1).cast("string"))
    return F.when(v.rlike(r"^\d{1,8}\.\d{1,8}\.\d{1,8}$"), up).otherwise(F.lit("1.0.1"))


def scrubbed(text: Column | str) -> Column:
    """Control characters other than tab and line ends become blanks."""
    return F.regexp_replace(_c(text), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", " ")


def fences_off(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(_c(text)), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")


def constant_value(text: Column | str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_c(text), r" = (.*)$", 1), ";$", "")), F.lit(""))


def quoted(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(text), '"([^"]*)"', 1), F.lit(""))


def call_type(callee: Column | str) -> Column:
    c = _c(callee)
    return F.when(c.endswith("!"), "macro").when(F.contains(c, F.lit("::")) & F.contains(c, F.lit("<")), "generic").when(F.contains(c, F.lit("::")), "associated").otherwise("function")


def type_kind(modifiers: Column) -> Column:
    """Kind of a type by the modifiers of its attributes."""
    has = lambda m: F.exists(modifiers, lambda x: x == m)
    return F.when(has("VARIANT"), "enum").when(has("TRAIT_METHOD"), "trait").otherwise("struct")


def calls_in(text: Column | str) -> Column:
    """Names called in a text: name( and name!."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*[(!]"), 1))


def dedented(text: Column | str) -> Column:
    """Code without // comments, blank lines and common indent."""
    lines = F.filter(F.transform(F.split(_c(text), "\n"), lambda x: F.rtrim(F.regexp_replace(x, r"//.*$", ""))), lambda x: F.trim(x) != "")
    indent = lambda rows: F.array_min(F.transform(rows, lambda x: F.length(x) - F.length(F.ltrim(x))))
    # arrays of one, as a lambda's argument is computed once, where a column is computed anew for every line
    cut = lambda rows: F.transform(F.array(indent(rows)), lambda n: F.array_join(F.transform(rows, lambda x: F.substring(x, n + 1, F.length(x))), "\n"))[0]
    return F.transform(F.array(lines), cut)[0]


def digest8(x: Column | str) -> Column:
    return F.substring(F.sha1(_c(x).cast("string")), 1, 8)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 1e-8 added to the product of norms."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-8))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def class_code(name: Column | str, fields: Column, methods: Column, all_levels: bool = False) -> Column:
    """A class from its members by access: public, protected, private. fields(name, type, access), methods(signature, access).

    With ``all_levels`` the result is empty unless every level has a member.
    """

    def level(which: str) -> Column:
        own = F.concat(
            F.transform(F.filter(fields, lambda f: f["access"] == which), lambda f: F.concat(F.lit("  "), f["type"], F.lit(" "), f["name"], F.lit(";"))),
            F.transform(F.filter(methods, lambda m: m["access"] == which), lambda m: F.concat(F.lit("  "), m["signature"], F.lit(";"))),
        )
        return F.when(F.size(own) > 0, F.concat(F.lit(f"{which}:\n"), F.array_join(own, "\n"), F.lit("\n")))

    parts = [level(x) for x in ("public", "protected", "private")]
    code = F.concat(F.lit("class "), _c(name), F.lit(" {\n"), F.concat_ws("", *parts), F.lit("};"))
    if not all_levels:
        return code
    every = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull()
    return F.when(every, code).otherwise("")


def rust_code(name: Column | str, fields: Column, methods: Column) -> Column:
    """A struct and its impl. fields(name, type), methods(signature)."""
    body = F.array_join(F.transform(fields, lambda f: F.concat(F.lit("    "), f["name"], F.lit(": "), f["type"], F.lit(","))), "\n")
    calls = F.array_join(F.transform(methods, lambda m: F.concat(F.lit("    "), m["signature"], F.lit(";"))), "\n")
    impl = F.when(F.size(methods) > 0, F.concat(F.lit("\n\nimpl "), _c(name), F.lit(" {\n"), calls, F.lit("\n}"))).otherwise("")
    return F.concat(F.lit("struct "), _c(name), F.lit(" {\n"), body, F.lit("\n}"), impl)


def item_id(module: Column | str, name: Column | str) -> Column:
    return F.concat_ws("::", _c(module), _c(name))


def crate_of(symbol: Column | str) -> Column:
    """The first segment of a path; the symbol itself where it has none."""
    return F.substring_index(_c(symbol), "::", 1)


def is_placeholder_file(filename: Column | str) -> Column:
    """A name in angle brackets, as front ends give to what has no file."""
    return _c(filename).rlike("[<>]")


def doc_examples(text: Column | str) -> Column:
    """Fenced code of a doc comment."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(?s)```[a-zA-Z]*\n(.*?)```"), 1), lambda x: F.rtrim(x, F.lit("\n ")))


def doc_section(text: Column | str, title: str) -> Column:
    """Text of a # section of a doc comment; null where there is none."""
    return F.nullif(F.trim(F.regexp_extract(_c(text), rf"(?s)(?:^|\n)#+ {title}\s*\n(.*?)(?=\n#|\z)", 1), F.lit(" \n\r\t")), F.lit(""))


def doc_fields(text: Column | str, title: str) -> Column:
    """Items `name`: text of a list in a section, as a map."""
    lines = F.filter(F.split(F.coalesce(doc_section(text, title), F.lit("")), "\n"), lambda x: x.rlike(r"^\s*[*-] `"))
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "`([^`]*)`", 1).alias("key"), F.trim(F.regexp_extract(x, "`[^`]*`[: -]*(.*)$", 1)).alias("value")))
    return F.map_from_entries(F.array_distinct(entries))


def source_location(href: Column | str) -> Column:
    """file and line of a link to a source page."""
    h = _c(href)
    return F.struct(F.nullif(F.regexp_extract(h, r"/src/(.*)\.html", 1), F.lit("")).alias("file"), F.regexp_extract(h, r"#(\d+)", 1).try_cast("int").alias("line"))


def derives(code: Column | str) -> Column:
    """Names in derive attributes."""
    lists = F.regexp_extract_all(_c(code), F.lit(r"#\[derive\(([^)]*)\)\]"), 1)
    return F.array_distinct(F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.trim(x)))


def labelled(**parts: Column) -> Column:
    """Lines 'Title: value' of the parts that are there, for prompts."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k.replace('_', ' ').capitalize()}: "), v.cast("string")) for k, v in parts.items()])


def error_style(code: Column | str) -> Column:
    """How a body deals with errors."""
    c = _c(code)
    has = lambda x: F.contains(c, F.lit(x))
    return F.when(has("?;") | has("?)"), "propagate").when(has(".unwrap()") | has(".expect("), "panic").when(has("match ") & has("Err("), "match").otherwise("none")
