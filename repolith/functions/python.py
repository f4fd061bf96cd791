"""Functions that need Python: tolerant JSON, header matching, encodings, HTML text."""

from __future__ import annotations

import json
import math
import re
import tomllib
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def balanced_region(text: str) -> str | None:
    """The first stretch from an opening brace or bracket to where all are closed; strings are not looked into."""
    begin = next((i for i, c in enumerate(text) if c in "{["), None)
    if begin is None:
        return None
    depth = 0
    for i in range(begin, len(text)):
        depth += (text[i] in "{[") - (text[i] in "}]")
        if depth == 0:
            return text[begin : i + 1]
    return text[begin:]


def tolerant(text: str | None) -> str | None:
    """Canonical JSON of the first reading that parses: as it is, without fences, its balanced region, scrubbed, closed; else null."""
    if text is None:
        return None
    bare = re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", text.strip()))
    region = balanced_region(bare) or bare
    clean = _CONTROL.sub(" ", region)
    closed = clean + "}" * max(0, clean.count("{") - clean.count("}")) + "]" * max(0, clean.count("[") - clean.count("]"))
    for reading in (text, bare, region, clean, closed):
        try:
            return json.dumps(json.loads(reading), sort_keys=True, ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def tolerant_json(text: pd.Series) -> pd.Series:
    return text.map(tolerant)


#: Encodings in the order they are tried; the last decodes anything.
ENCODINGS = ("utf-8", "gbk", "utf-16", "latin-1")


def probe(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, encoding) by the first encoding that decodes."""
    if data is None:
        return None, None
    for name in ENCODINGS:
        try:
            return bytes(data).decode(name), name
        except UnicodeError:
            continue
    return None, None


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())]))
def _probed(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probe(x) for x in content], columns=["text", "encoding"])


def decoded(content: Column | str) -> Column:
    """(text, encoding) of bytes. Python sees only what isn't UTF-8."""
    data = F.col(content) if isinstance(content, str) else content
    text = F.try_validate_utf8(data.cast("string"))
    return F.when(text.isNotNull(), F.struct(text.alias("text"), F.lit("utf-8").alias("encoding"))).otherwise(_probed(F.when(text.isNull(), data)))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def html_to_text(html: str | None) -> str | None:
    """Text of a page, white space collapsed; scripts and styles are left out."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)


def match_headers(found: list[str], wanted: list[str], similarity) -> dict[int, str]:
    """Places of found headers -> wanted ones: each wanted header in turn takes the most similar that is left, the first on a tie."""
    out: dict[int, str] = {}
    for w in wanted:
        left = [i for i in range(len(found)) if i not in out]
        if left:
            out[max(left, key=lambda i: (similarity(found[i], w), -i))] = w
    return out


def _cosine(a: str, b: str) -> float:
    """Cosine of the counts of letter pairs: the stand-in for an embedding's."""
    x, y = (Counter(s.lower()[i : i + 2] for i in range(max(1, len(s) - 1))) for s in (a, b))
    size = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(n * y[k] for k, n in x.items()) / math.sqrt(size) if size else 0.0


def rename_headers(text: str | None, wanted: list[str], level: int = 4) -> str | None:
    """Level-``level`` headers renamed to ``wanted``: by position if their number agrees, else by likeness; untouched if all are there."""
    if text is None:
        return None
    mark = "#" * level + " "
    found = [x[len(mark) :].strip() for x in text.split("\n") if x.startswith(mark)]
    if set(wanted) <= set(found):
        return text
    names = dict(enumerate(wanted)) if len(found) == len(wanted) else match_headers(found, wanted, _cosine)
    lines, at = [], 0
    for x in text.split("\n"):
        if x.startswith(mark):
            x, at = mark + names.get(at, found[at]), at + 1
        lines.append(x)
    return "\n".join(lines)


def renamed(wanted: list[str], level: int = 4):
    """A column function that applies rename_headers."""

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: rename_headers(t, wanted, level))

    return run


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("member", T.StringType()), T.StructField("kind", T.StringType())])))
def workspace_members(toml: pd.Series) -> pd.Series:
    """Members and excluded paths of a workspace file."""

    def read(text: str | None) -> list[dict] | None:
        try:
            workspace = tomllib.loads(text or "").get("workspace", {})
        except tomllib.TOMLDecodeError:
            return None
        return [{"member": m, "kind": kind} for kind in ("members", "exclude", "default-members") for m in workspace.get(kind, [])]

    return toml.map(read)


class _Items(HTMLParser):
    """Items of a rustdoc page: h4 with code is a function, h3 with code a type; the next docblock is theirs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.at: list[str] = []
        self.text: list[str] = []
        self.doc_depth = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("h3", "h4"):
            self.at, self.text = [tag], []
        elif tag == "code" and self.at:
            self.at.append(tag)
        if self.doc_depth:
            self.doc_depth += tag == "div"
        elif tag == "div" and "docblock" in (dict(attrs).get("class") or "").split():
            self.doc_depth, self.text = 1, []

    def handle_endtag(self, tag: str) -> None:
        if self.doc_depth and tag == "div":
            self.doc_depth -= 1
            if not self.doc_depth and self.items and self.items[-1]["doc"] is None:
                self.items[-1]["doc"] = " ".join("".join(self.text).split())
        elif self.at and tag == self.at[0]:
            text = " ".join("".join(self.text).split())
            if len(self.at) > 1 and text:
                is_fn = self.at[0] == "h4" and "fn " in text
                name = re.search(r"fn (\w+)", text) if is_fn else re.search(r"(\w+)\W*$", text)
                if is_fn or self.at[0] == "h3":
                    self.items.append({"kind": "function" if is_fn else "type", "name": name[1] if name else None, "signature": text, "doc": None})
            self.at = []

    def handle_data(self, data: str) -> None:
        if self.at or self.doc_depth:
            self.text.append(data)


def rustdoc(html: str | None) -> list[dict]:
    parser = _Items()
    parser.feed(html or "")
    parser.close()
    return parser.items


_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "name", "signature", "doc")])


@F.pandas_udf(T.ArrayType(_ITEM))
def rustdoc_items(html: pd.Series) -> pd.Series:
    return html.map(rustdoc)


def is_doc_page(name: str) -> bool:
    """Pages that hold items: not the index, search or help page."""
    return name.endswith(".html") and not re.search(r"(^|/)(index|search|help)\.", name)
