"""Files to tags: the one operator that needs Python, in Arrow batches on the executors."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..extract import cfamily, go, java, js, kotlin, python, rust, simple, typescript
from ..extract.base import Options, Source, Tag
from ..extract.sandbox import Limits, PluginFailed, close_all, process_of
from ..plans.languages import KINDS
from ..schema import EXTRACTED
from ..plans.patterns import parse_patterns
from ..session import written
from ..sources.plugins import plugin_modules, user_queries
from ..sources.storage import opened
from .match import definitions, node_table

NATIVE = {"python": python.extract, "rust": rust.extract, "go": go.extract, "javascript": js.extract, "typescript": typescript.extract}
PLUGIN = {"java": java.extract, "kotlin": kotlin.extract, "echo": simple.echo}
ADDRESS_BYTES = 96
#: Tags that one batch to Spark holds, about.
BATCH_TAGS = 10_000
ESCAPED = re.compile(r"[\\/^$]")


def escape(line: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", line)


def address(lines: list[str], row: int, style: str) -> str:
    """native: the whole line; plugin and query: cut at 96 bytes, a query's without trailing space and with a tab."""
    if row >= len(lines):
        return f"/^{row + 1}$/;" if style == "native" else '/^$/;"'
    text = escape(lines[row].rstrip() if style == "query" else lines[row])
    close = '$/;"'
    if style != "native" and 4 * len(text) > ADDRESS_BYTES and len(data := text.encode()) > ADDRESS_BYTES:
        text, close = data[:ADDRESS_BYTES].decode("utf-8", "ignore"), '/;"'
    return "/^" + text + close + ("\t" if style == "query" else "")


@dataclass(frozen=True)
class Job:
    """What the executors need to know: kinds by language, fields, extras, and languages that plugins provide."""

    kinds: dict[str, frozenset[str]]
    fields: frozenset[str]
    qualified: bool
    file_scope: bool
    plugins: frozenset[str]
    #: language -> the text of a user grammar's query file
    queries: dict[str, str] = field(default_factory=dict)
    #: language -> the Python text of its plugin's module
    modules: dict[str, str] = field(default_factory=dict)
    limits: Limits = Limits()


def job_of(config: Config, plugins: frozenset[str] = frozenset()) -> Job:
    kinds = {lang: config.kinds_for(lang) for lang in KINDS}
    return Job(kinds, config.fields, config.extras.qualified, config.extras.file_scope, plugins, user_queries(config.user_grammars), plugin_modules(config.plugin_dirs))


def described(job: Job) -> str:
    """All that a job's tags depend on besides the files, the same in every run: options, texts of queries and modules, and this package."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = hashlib.sha256()
    for folder in ("extract", "operators"):
        for name in sorted(n for n in os.listdir(os.path.join(here, folder)) if n.endswith(".py")):
            with open(os.path.join(here, folder, name), "rb") as f:
                code.update(f.read())
    plain = {k: sorted(v) if isinstance(v, frozenset) else sorted((a, sorted(b) if isinstance(b, frozenset) else b) for a, b in v.items()) if isinstance(v, dict) else v for k, v in vars(job).items()}
    return repr((sorted(plain.items()), code.hexdigest()))


def tags_of(content: bytes, name: str, lang: str, job: Job) -> Iterator[tuple[Tag, str]]:
    """(tag, address) of a file. Raises UnicodeDecodeError for what is not UTF-8, PluginFailed for what a plugin's module cannot do."""
    src = Source(content.decode("utf-8"))
    opt = Options(job.kinds.get(lang, frozenset()), job.fields, job.qualified, job.file_scope, name)
    if lang in PLUGIN and lang in job.plugins:
        opt = Options(opt.kinds or frozenset("f"), *(getattr(opt, a) for a in ("fields", "qualified", "file_scope", "file_name")))
        found, style = PLUGIN[lang](src, opt), "plugin"
    elif lang in job.modules:
        found, style = process_of(job.modules[lang], job.limits).extract(src, opt), "plugin"
    elif lang in NATIVE:
        found, style = NATIVE[lang](src, opt), "native"
    elif lang in ("c", "c++"):
        found, style = cfamily.extract(src, opt, lang), "native"
    else:
        found, style = simple.extract(src, opt, lang), "query"
    for tag in found:
        yield tag, address(src.lines, tag.row, style)


def queried(job: Job) -> list[str]:
    """Languages whose definitions a user's query file names: those that neither a plugin nor an extractor of our own takes first."""
    return [lang for lang in job.queries if not (lang in job.modules or lang in NATIVE or lang in ("c", "c++") or lang in PLUGIN and lang in job.plugins)]


def query_tags(files: DataFrame, job: Job, langs: list[str], name: str) -> DataFrame:
    """Tags of files whose languages have user queries: patterns joined with the table of nodes, all files at once."""
    files = files.filter(F.col("lang").isin(*langs))
    if "content" not in files.columns:
        files = written(files, "queried")  # paths; resolution is not run once more
    nodes = written(node_table(files), "nodes")
    names = files.select(F.col("file_ord").cast("long").alias("file"), F.col(name).alias("file_name"), "lang")
    out = names.join(nodes.filter("id < 0"), "file").select(F.col("file").alias("file_ord"), F.lit(-1).cast("long").alias("tag_ord"), F.lit(None).cast("string").alias("name"), "file_name", F.lit(None).cast("string").alias("address"), F.col("text").alias("error"))
    for lang in langs:
        found = names.filter(F.col("lang") == lang).join(definitions(nodes.filter(F.col("lang") == lang), parse_patterns(job.queries[lang])), "file")
        out = out.unionByName(found.select(F.col("file").alias("file_ord"), F.col("id").cast("long").alias("tag_ord"), "name", "file_name", "address", F.lit(None).cast("string").alias("error")))
    return out.withColumns({"kind": F.lit(None).cast("string"), "fields": F.lit(None).cast(EXTRACTED["fields"].dataType)}).select(*(f.name for f in EXTRACTED.fields))


_PAIRS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
EXTRACTED_ARROW = pa.schema([(f.name, _PAIRS if f.name == "fields" else pa.int64() if f.name.endswith("_ord") else pa.string()) for f in EXTRACTED.fields])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), EXTRACTED_ARROW)], schema=EXTRACTED_ARROW)


def extract_tags(files: DataFrame, job: Job, name: str = "rel_path", content: str | None = "content") -> DataFrame:
    """Tags (with file_ord, tag_ord, error) of resolved files: columns ``name``, lang, file_ord and content, or path to read.

    Files without a language give nothing. What cannot be read, is not UTF-8 or lets its
    plugin's module fail, hang or die gives one row with ``error`` and no tag; the run goes on. Content travels no further than this task.
    """
    if langs := queried(job):
        others = extract_tags(files.filter(~F.coalesce(F.col("lang").isin(*langs), F.lit(False))), replace(job, queries={}), name, content)
        return others.unionByName(query_tags(files.withColumnRenamed(content, "content") if content else files, job, langs, name))
    body = F.col(content).cast("binary") if content else F.lit(None).cast("binary")
    path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
    rows = files.filter("lang is not null").select(F.col("file_ord").cast("long"), F.col(name).alias("name"), path.alias("path"), "lang", body.alias("content"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # contents become Python's one at a time
            for ord_, name_, path_, lang, held in zip(*(batch.column(c).to_pylist() for c in ("file_ord", "name", "path", "lang")), batch.column("content")):
                try:
                    data = held.as_py()
                    if data is None:
                        with opened(path_) as f:
                            data = f.read()
                    for k, (t, where) in enumerate(tags_of(data, name_, lang, job)):
                        out.append((ord_, k, t.name, name_, where, t.kind, t.fields or None, None))
                except (OSError, UnicodeDecodeError, PluginFailed) as e:
                    out.append((ord_, -1, None, name_, None, None, None, f"{type(e).__name__}: {e}"))
                if len(out) >= BATCH_TAGS:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from extracted(batches)
        finally:
            close_all()

    return rows.mapInArrow(run, EXTRACTED)


def tags_only(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is null").drop("error")


def errors_only(extracted: DataFrame) -> DataFrame:
    return extracted.filter("error is not null").select("file_name", "error")


def register_udtf(spark, job: Job, name: str = "code_tags") -> None:
    """A table function for SQL: ``select t.* from files, lateral code_tags(rel_path, lang, content) t``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="name string, address string, kind string, fields string")
    class CodeTags:
        def eval(self, file_name: str, lang: str, content: bytes):
            if file_name is None or lang is None or content is None:
                return
            try:
                for t, where in tags_of(bytes(content), file_name, lang, job):
                    yield t.name, where, t.kind, json.dumps(dict(t.fields), ensure_ascii=False)
            except (UnicodeDecodeError, PluginFailed):
                return

        def terminate(self):
            close_all()

    spark.udtf.register(name, CodeTags)


def register_table_function(spark, job: Job, name: str = "tags_of_files") -> str:
    """A table function for SQL over a table of rel_path, lang and content, whose columns follow the fields asked for.

    ``select * from tags_of_files(table(files) partition by (rel_path), 'line,class')`` gives
    file_name, name, address, kind and a text column for each field, null where a tag lacks
    it. Files without a language or content, not in UTF-8 or that a plugin fails for give nothing.
    Rows travel as Arrow batches; functions that take whole batches cannot choose their columns.
    """
    from pyspark.sql import Row
    from pyspark.sql import types as T
    from pyspark.sql.functions import udtf
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    own = ("file_name", "name", "address", "kind")

    @dataclass
    class Asked(AnalyzeResult):
        keys: tuple[str, ...] = ()

    @udtf(useArrow=True)
    class TagsOfFiles:
        def __init__(self, asked: Asked):
            self.keys = asked.keys
            self.job = replace(job, fields=job.fields | frozenset(asked.keys))

        @staticmethod
        def analyze(files: AnalyzeArgument, fields: AnalyzeArgument) -> Asked:
            missing = {"rel_path", "lang", "content"} - set(files.dataType.names if files.isTable else ())
            if missing:
                raise ValueError(f"a table with columns rel_path, lang and content is needed; missing: {', '.join(sorted(missing))}")
            if not fields.isConstantExpression or not isinstance(fields.value, str):
                raise ValueError("the fields asked for are a constant text, with commas between them")
            keys = tuple(dict.fromkeys(k.strip() for k in fields.value.split(",") if k.strip() and k.strip() not in own))
            return Asked(T.StructType([T.StructField(c, T.StringType()) for c in (*own, *keys)]), keys=keys)

        def eval(self, files: Row, fields: str) -> Iterator[tuple]:
            if files["rel_path"] is None or files["lang"] is None or files["content"] is None:
                return
            try:
                for t, where in tags_of(bytes(files["content"]), files["rel_path"], files["lang"], self.job):
                    held = dict(t.fields)
                    yield files["rel_path"], t.name, where, t.kind, *(held.get(k) for k in self.keys)
            except (UnicodeDecodeError, PluginFailed):
                return

        def terminate(self):
            close_all()

    spark.udtf.register(name, TagsOfFiles)
    return name
