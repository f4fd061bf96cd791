"""Scans: records, tags, Markdown, JSON, lock files, archives, source files."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repolith import schemas
from repolith.functions import python as py


def methods(spark: SparkSession, path: str) -> DataFrame:
    """methods.jsonl of any front end; broken lines keep their text in _corrupt_record."""
    return spark.read.schema(schemas.METHODS).json(path, mode="PERMISSIVE")


def structs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STRUCTS).json(path, mode="PERMISSIVE")


def documentation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.DOCUMENTATION).json(path)


def profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(schemas.PROFILE).json(path)


def batch_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository of a batch file: domain, pos, repo (path before repo), lang (language before lang)."""
    rows = spark.read.option("multiLine", True).schema(schemas.BATCH).json(path).select("domain", F.posexplode("repos").alias("pos", "r"))
    return rows.select("domain", "pos", F.coalesce("r.path", "r.repo").alias("repo"), F.coalesce("r.language", "r.lang").alias("lang")).where("repo IS NOT NULL")


def tags(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Distinct names of a ctags table: those in headers, or for TypeScript those of kind f."""
    rows = spark.read.schema(schemas.TAGS).csv(path, sep="\t", comment="!", quote="")
    return rows.where(F.col("filename").rlike(r"\.(h|hpp)$") if header else F.col("kind") == "f").select("name").distinct()


def lock_packages(spark: SparkSession, path: str) -> DataFrame:
    """Package names of a lock file."""
    rows = spark.read.text(path)
    return rows.select(F.regexp_extract("value", r'^name = "([^"]*)"', 1).alias("package")).where("package <> ''").distinct()


def blocks(text: Column, mark: str = "### ") -> Column:
    """Markdown blocks that begin with ``mark`` at a line's start, each with its header."""
    return F.transform(F.filter(F.split(F.concat(F.lit("\n"), text), "\n" + mark, -1), lambda x, i: i > 0), lambda x: F.concat(F.lit(mark), x))


def markdown_docs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per ### block: pos, name, block."""
    rows = docs.select(*keep, F.posexplode(blocks(F.col(text))).alias("pos", "block"))
    return rows.select(*keep, "pos", F.trim(F.regexp_extract("block", r"^### ([^\n]*)", 1)).alias("name"), "block")


def repository_modules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Modules of a repository document: blocks with a Description section, which is what follows its header."""
    rows = docs.select(*keep, F.posexplode(F.split(F.concat(F.lit("\n"), F.col(text)), "\n### ", -1)).alias("pos", "x")).where("pos > 0")
    parts = F.split("x", "\n#### Description", 2)
    return rows.where(F.size(parts) == 2).select(*keep, "pos", F.trim(parts[0], F.lit(" \n\r\t")).alias("name"), F.trim(parts[1], F.lit(" \n\r\t")).alias("description"))


def qa_pairs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Question and answer lines, joined by position."""
    q, a = (F.regexp_extract_all(text, F.lit(rf"(?m)^{m}: *(.*)$"), 1) for m in "QA")
    return docs.select(*keep, F.posexplode(F.arrays_zip(q.alias("question"), a.alias("answer"))).alias("pos", "p")).select(*keep, "pos", "p.question", "p.answer")


def source_files(spark: SparkSession, root: str, suffixes: tuple[str, ...], skip: tuple[str, ...] = ("target", "node_modules", ".git", "tests", "examples")) -> DataFrame:
    """Files below ``root`` with one of ``suffixes``, in no folder of ``skip`` and with no dot before the name; decoded."""
    glob = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    # only folders below the root count: the path that is left after the root's own
    base = urlparse(root).path.rstrip("/") + "/"
    below = F.split(F.substr("path", F.instr("path", base) + len(base)), "/")
    folders = F.slice(below, 1, F.size(below) - 1)
    kept = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, skip)))).where(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return kept.select("path", py.decoded("content").alias("d")).select("path", "d.text", "d.encoding")


def members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a zip or tar archive by name; nothing for other data."""
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name.removeprefix("./"), t.extractfile(info).read()
    except tarfile.TarError:
        return


def archives(files: DataFrame, flatten: bool = True) -> DataFrame:
    """Members of archives, from rows (path, content) as binaryFile gives them: archive, path, content.

    With ``flatten`` a single root folder that holds everything is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for name, content in members(row["content"] or b""):
                    yield pa.RecordBatch.from_pylist([{"archive": row["path"], "path": name, "content": content}], schema=pa.schema([("archive", pa.string()), ("path", pa.string()), ("content", pa.binary())]))

    out = files.select("path", "content").mapInArrow(run, "archive string, path string, content binary")
    if not flatten:
        return out
    root = F.when(F.contains("path", F.lit("/")), F.element_at(F.split("path", "/"), 1))
    roots = out.groupBy("archive").agg(F.count_distinct(F.coalesce(root, F.lit(""))).alias("roots"), F.count(F.when(root.isNull(), 1)).alias("loose"))
    single = F.expr("roots = 1 AND loose = 0")
    return out.join(roots, "archive").select("archive", F.when(single, F.regexp_replace("path", "^[^/]*/", "")).otherwise(F.col("path")).alias("path"), "content")


def first_readme(files: DataFrame, names: tuple[str, ...] = ("README.md", "readme.md", "README.txt", "README")) -> DataFrame:
    """For each folder the README of the first name in ``names``: folder, path, text."""
    order = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("path", "/"), -1))
    rows = files.withColumn("rank", order).where("rank > 0").withColumn("folder", F.regexp_replace("path", "/?[^/]*$", ""))
    return rows.groupBy("folder").agg(F.min_by("path", "rank").alias("path"), F.min_by("text", "rank").alias("text"))


def with_code(functions: DataFrame, files: DataFrame, clamp: bool = True) -> DataFrame:
    """Functions (filename, beginLine, endLine) with their lines; a file that isn't found by path is taken by its last name, the first path first."""
    from repolith.functions.scalar import line_range

    name = lambda c: F.element_at(F.split(c, "/"), -1)
    by_name = files.groupBy(name("path").alias("base")).agg(F.min_by("text", "path").alias("by_name"))
    exact = files.select(F.col("path").alias("filename"), F.col("text").alias("by_path"))
    rows = functions.join(exact, "filename", "left").withColumn("base", name("filename")).join(by_name, "base", "left")
    return rows.withColumn("code", line_range(F.coalesce("by_path", "by_name"), F.col("beginLine"), F.col("endLine"), clamp)).drop("base", "by_name", "by_path")


def present(rows: DataFrame, files: DataFrame, filename: str = "filename") -> DataFrame:
    """Rows whose file is one of ``files`` (path)."""
    return rows.join(files.select(F.col("path").alias(filename)), filename, "left_semi")


def complete(rows: DataFrame, required: tuple[str, ...] = ("signature", "name", "code", "filename", "modifier", "params", "callees")) -> DataFrame:
    """Rows that have all ``required`` fields."""
    return rows.dropna(subset=list(required))


def named_rows(rows: DataFrame) -> DataFrame:
    """Rows with a signature; of those in a placeholder file only the ones with code."""
    from repolith.functions.scalar import is_placeholder_file

    return rows.where("coalesce(signature, '') <> ''").where(~is_placeholder_file("filename") | (F.coalesce("code", F.lit("")) != ""))


def markdown_folder(spark: SparkSession, root: str) -> DataFrame:
    """(repo, text): a repository for each .md file of a folder, named by its stem."""
    rows = spark.read.text(root, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select(F.regexp_replace("file", r"\.md$", "").alias("repo"), F.col("value").alias("text"))


def ts_names(files: DataFrame) -> DataFrame:
    """Distinct names that TypeScript files (path, text) define, for a repository without tags."""
    from repolith.functions.scalar import ts_function_names

    return files.where(F.endswith("path", F.lit(".ts"))).select(F.explode(ts_function_names("text")).alias("name")).distinct()


def or_default(rows: DataFrame, default: DataFrame) -> DataFrame:
    """``default`` where ``rows`` has none."""
    return rows.unionByName(default.join(rows.limit(1).select(F.lit(1).alias("some")), F.lit(True), "left_anti"))


def wrong_lines(rows: DataFrame) -> DataFrame:
    """Rows whose line could not be read, for a dead-letter table."""
    return rows.where("_corrupt_record IS NOT NULL").select("_corrupt_record")


def unwritable(rows: DataFrame) -> DataFrame:
    """Function rows that a writer must refuse: empty names or files, lines that don't grow."""
    return rows.where("coalesce(name, '') = '' OR coalesce(filename, '') = '' OR beginLine <= 0 OR endLine < beginLine OR exists(params, p -> coalesce(p.name, '') = '' AND coalesce(p.type, '') = '')")


def last_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The last row of each name; re-runs append and the newest counts."""
    w = Window.partitionBy(name).orderBy(F.desc(order))
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def fetch(url: str, path: str, chunk: int = 8192) -> bool:
    """Copies a URL (http, https, file) to a local path on the driver; an existing file stays, a broken copy goes. False if there is no file."""
    import os
    import shutil
    import urllib.request

    if os.path.exists(path):
        return True
    part = f"{path}.part"
    try:
        with urllib.request.urlopen(url, timeout=60) as source, open(part, "wb") as target:
            shutil.copyfileobj(source, target, chunk)
        os.replace(part, path)
    except (OSError, ValueError):
        if os.path.exists(part):
            os.remove(part)
        return False
    return True


def repo_source(source: str) -> str:
    """A URL as it is; a local file or folder as a file:// URL."""
    from pathlib import Path

    return source if "://" in source else Path(source).absolute().as_uri()


def rustdoc_pages(spark: SparkSession, root: str) -> DataFrame:
    """Items of the pages of a rustdoc tree: path, kind, name, signature, doc."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").load(root)
    pages = rows.where(~F.col("path").rlike(r"(^|/)(index|search|help)\.[^/]*$")).select("path", F.explode(py.rustdoc_items(F.col("content").cast("string"))).alias("i"))
    return pages.select("path", "i.*")


def dependency_paths(names: DataFrame, *places: DataFrame) -> DataFrame:
    """(name, path): the path of each name in the first of ``places`` (name, path) that has it."""
    out = names.select("name").distinct()
    for i, place in enumerate(places):
        out = out.join(place.groupBy("name").agg(F.min("path").alias(f"_p{i}")), "name", "left")
    return out.select("name", F.coalesce(*[f"_p{i}" for i in range(len(places))]).alias("path"))
