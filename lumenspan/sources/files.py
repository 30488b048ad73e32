"""Source trees as tables: files, lines, and what the scanner finds in each file (functions, types, calls, symbols)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.code import Source, functions, types
from lumenspan.functions.flow import parameters
from lumenspan.functions.languages import CALL_KEYWORDS, EXCLUDED_DIRS, EXTENSIONS, OTHER_SOURCES, TEST_PATH, language_of

FILES = "repo string, path string, ext string, lang string, is_test boolean, content_hash string, text string"


def excluded(path: str, dirs: Sequence[str] = EXCLUDED_DIRS) -> bool:
    parts = path.split("/")
    return parts[-1].startswith("._") or "__MACOSX" in parts or any(d in parts[:-1] if "/" not in d else f"/{d}/" in f"/{path}" for d in dirs)


def read_tree(spark: SparkSession, root: str, repo: str = "", extensions: Sequence[str] | None = (*EXTENSIONS, *OTHER_SOURCES, ".sql"), exclude: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """The files under a folder, read by the executors; which of them are wanted is decided before any is opened.

    Files that are no valid UTF-8 have replacement characters in their text; their hash is of their bytes."""
    uri = root if "://" in root else "file://" + os.path.abspath(root)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if extensions is not None:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    base = uri.rstrip("/") + "/"
    plain = re.sub(r"^([a-z]+):/+", r"\1:/", base)
    found = reader.load(uri).withColumn("path", F.regexp_replace(F.regexp_replace("path", r"^([a-z]+):/+", "$1:/"), "^" + re.escape(plain), ""))
    parts = F.split("path", "/")
    names = [d for d in exclude if "/" not in d]
    out = found.where(~F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, [*names, "__MACOSX"]))) & ~F.startswith(F.element_at(parts, -1), F.lit("._")))
    for d in exclude:
        if "/" in d:
            out = out.where(~F.contains(F.concat(F.lit("/"), "path"), F.lit(f"/{d}/")))
    ext = F.lower(F.concat(F.lit("."), F.substring_index(F.element_at(parts, -1), ".", -1)))
    lang = F.coalesce(*(F.when(ext.isin([e for e, i in EXTENSIONS.items() if i == k]), k) for k in dict.fromkeys(EXTENSIONS.values())))
    return out.select(F.lit(repo).alias("repo"), "path", ext.alias("ext"), lang.alias("lang"), F.lower("path").rlike(TEST_PATH).alias("is_test"), F.substring(F.sha1("content"), 1, 12).alias("content_hash"), F.decode("content", "UTF-8").alias("text"))


def from_texts(spark: SparkSession, texts: dict[str, str], repo: str = "") -> DataFrame:
    """A file table of texts at hand, by path."""
    rows = [(repo, p, "." + p.rpartition(".")[2].lower(), language_of(p), bool(re.search(TEST_PATH, p.lower())), None, t) for p, t in sorted(texts.items())]
    return spark.createDataFrame(rows, FILES).withColumn("content_hash", F.substring(F.sha1("text"), 1, 12))


#: Bytes of a line from which on it is no line of a source file.
LONGEST_LINE = 1 << 20


def lines(files: DataFrame) -> DataFrame:
    """(repo, path, lang, is_test, line, text): 1-based lines; a carriage return before a line end goes, a final line end makes no line.

    A line of LONGEST_LINE bytes or more is an error that names its file and number."""
    text = F.regexp_replace("text", r"\r?\n\z", "")
    cut = F.split(text, r"\r?\n", -1)
    out = files.where("text is not null and text <> ''").select("repo", "path", "lang", "is_test", F.posexplode(cut).alias("pos", "line_text"))
    n = (F.col("pos") + 1).cast("long")
    long = F.raise_error(F.concat(F.lit("line too long: "), "path", F.lit(":"), n.cast("string")))
    kept = F.when(F.octet_length("line_text") >= LONGEST_LINE, long.cast("string")).otherwise(F.col("line_text"))
    return out.select("repo", "path", "lang", "is_test", n.alias("line"), kept.alias("text"))


_FUNCTION = "struct<name:string,owner:string,start:long,end:long,sig:string,annotations:array<string>,params:array<string>>"
_TYPE = "struct<name:string,kind:string,abstract:boolean,extends:string,extends_args:array<string>,implements:array<string>,annotations:array<string>,line:long,end:long,package:string,fields:array<struct<name:string,type:string,line:long>>,members:array<string>>"
_CALL = "struct<line:long,qualifier:string,callee:string,code:string,args:array<string>>"
_LOCAL = "struct<line:long,name:string,type:string>"
_SYMBOL = "struct<name:string,kind:string,line:long>"
PARSED = f"repo string, path string, lang string, functions array<{_FUNCTION}>, types array<{_TYPE}>, calls array<{_CALL}>, locals array<{_LOCAL}>, symbols array<{_SYMBOL}>"

_CALLED = re.compile(r"(?:([A-Za-z_$][\w$]*)\s*\.\s*)?(?<![\w$])([A-Za-z_$][\w$]*)\s*\(")
_LOCAL_VAR = re.compile(r"\b([A-Z]\w*)(?:<[^=;()]*>)?\s+([a-z_$][\w$]*)\s*=")
_MADE_HERE = re.compile(r"\bnew\s+([A-Z]\w*)\s*(?:<[^<>]*>)?\s*\([^()]*\)\s*\.$")
_GO_TYPE = re.compile(r"^\s*type\s+([A-Za-z_]\w*)\s+(\S+)")
_GO_LOCAL = re.compile(r"^\s*([a-z]\w*)\s*:=")


def _arguments(code: str, at: int) -> list[str]:
    """The arguments of a call whose bracket opens before at, as far as its line goes."""
    out, depth, start = [], 0, at
    for i in range(at, len(code)):
        if code[i] in "([{":
            depth += 1
        elif code[i] in ")]}":
            depth -= 1
        if depth < 0 or (code[i] == "," and not depth):
            out.append(code[start:i].strip())
            start = i + 1
        if depth < 0:
            break
    return [] if out == [""] else out


def scan(path: str, lang: str, text: str) -> dict:
    """What a file declares and calls."""
    src = Source(text, lang)
    owners = types(src) if lang in ("java", "js") else {}
    fns, kinds = functions(src, owners), list(owners.values())
    calls, names = [], []
    for n in range(1, len(src.lines) + 1):
        code = src.code_line(n)
        for m in _CALLED.finditer(code):
            before = code[: m.start()].rstrip()
            if m[2] not in CALL_KEYWORDS and not (before.endswith("new") and not m[1]):
                made = _MADE_HERE.search(before)
                qualifier = m[1] or (made[1] if made else "." if before.endswith(".") else "")
                calls.append({"line": n, "qualifier": qualifier, "callee": m[2], "code": src.line_text(n).strip(), "args": _arguments(code, m.end())})
        names += [{"line": n, "name": m[2], "type": m[1]} for m in _LOCAL_VAR.finditer(code)] if lang == "java" else []
    symbols = [{"name": path.rpartition("/")[2], "kind": "file", "line": 1}]
    symbols += [{"name": f.name, "kind": "method" if f.owner else "func", "line": f.start} for f in fns] + [{"name": t.name, "kind": t.kind, "line": t.line} for t in kinds]
    if lang == "go":
        for n in range(1, len(src.lines) + 1):
            if m := _GO_TYPE.match(src.code_line(n)):
                symbols.append({"name": m[1], "kind": "type", "line": n})
    return {
        "functions": [{**{k: v for k, v in vars(f).items() if k not in ("open", "close")}, "params": parameters(f.sig)} for f in fns],
        "types": [{**vars(t), "fields": [{"name": a, "type": b, "line": c} for a, b, c in t.fields]} for t in kinds],
        "calls": calls, "locals": names, "symbols": sorted(symbols, key=lambda s: (s["line"], s["kind"] != "file")),
    }


def parsed(files: DataFrame, scanners: Mapping[str, Callable[[str, str, str], dict]] | None = None) -> DataFrame:
    """One row a file, with arrays of what the scanner finds: the file is the unit of work. Files are spread over all cores first: small
    ones by the hundred thousand come in a few row groups of a table, which as many tasks would scan.

    scanners has scanners of languages that take scan()'s place: (path, lang, text) to some or all of its arrays."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(PARSED)
    arrow = to_arrow_schema(schema)
    none = dict.fromkeys(("functions", "types", "calls", "locals", "symbols"), [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"repo": r["repo"], "path": r["path"], "lang": r["lang"], **none, **(scanners or {}).get(r["lang"], scan)(r["path"], r["lang"], r["text"] or "")} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    spark = files.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.where("lang is not null").select("repo", "path", "lang", "text").repartition(tasks, "path").mapInArrow(run, schema)


def explode(parsed_files: DataFrame, what: str) -> DataFrame:
    """(repo, path, lang, and the fields of one of the arrays)."""
    return parsed_files.select("repo", "path", "lang", F.explode(what).alias("__x")).select("repo", "path", "lang", "__x.*")


RECORD = "kind string, id string, file string, mode string, tool string, text string, lines array<string>, facts array<string>"


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines file with their line numbers; blank lines are skipped, a line that can't be read has kind null."""
    return records(spark.read.text(path).withColumn("n", F.monotonically_increasing_id()))


def records(lines: DataFrame) -> DataFrame:
    """(n, value, and the fields of a record) of lines (n, value) of JSON."""
    return lines.where(F.trim("value") != "").select("n", "value", F.from_json("value", RECORD).alias("r")).select("n", "value", "r.*")


GRADLE_FILES = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts")
# How build files name their group, dependencies and sibling projects.
GROUP = r"""(?m)^\s*group\s*[=(]?\s*["']([A-Za-z0-9_.\-]+)["']"""
DEPENDENCY = r"""(?m)^\s*(?:implementation|api|compileOnly|runtimeOnly|testImplementation|testRuntimeOnly|annotationProcessor)\s*[(\s]\s*["']([^"':]+:[^"':]+(?::[^"']+)?)["']"""
PROJECT = r"""(?m)project\s*\(\s*["'](:[^"']+)["']"""


def gradle(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (repo, group) and dependencies (repo, group, artifact, version, project) of build files."""
    build = files.where(F.element_at(F.split("path", "/"), -1).isin(*GRADLE_FILES) & ~F.contains("path", F.lit("/")))
    groups = build.select("repo", F.regexp_extract("text", GROUP, 1).alias("group")).where("group <> ''").groupBy("repo").agg(F.min("group").alias("group"))
    deps = build.select("repo", F.explode(F.regexp_extract_all("text", F.lit(DEPENDENCY), F.lit(1))).alias("d")).distinct()
    deps = deps.select("repo", F.split_part("d", F.lit(":"), F.lit(1)).alias("group"), F.split_part("d", F.lit(":"), F.lit(2)).alias("artifact"), F.split_part("d", F.lit(":"), F.lit(3)).alias("version"), F.lit("").alias("project"))
    projects = build.select("repo", F.explode(F.regexp_extract_all("text", F.lit(PROJECT), F.lit(1))).alias("project")).distinct()
    return groups, deps.unionByName(projects.select("repo", F.lit("").alias("group"), F.lit("").alias("artifact"), F.lit("").alias("version"), "project"))


def internal_dependencies(groups: DataFrame, deps: DataFrame) -> DataFrame:
    """(repo, needs): repos whose group equals a dependency's or shares its first two segments, and sibling projects by name."""
    two = lambda c: F.array_join(F.slice(F.split(c, r"\."), 1, 2), ".")
    key = lambda c: F.when(F.size(F.split(c, r"\.")) >= 2, two(c)).otherwise(c)
    by_group = deps.where("group <> ''").select("repo", key(F.col("group")).alias("k")).join(groups.select(F.col("repo").alias("needs"), key(F.col("group")).alias("k")), "k").where("repo <> needs").select("repo", "needs")
    by_name = deps.where("project <> ''").select("repo", F.substring("project", 2, 1000).alias("needs")).join(groups.select(F.col("repo").alias("needs")), "needs", "left_semi").select("repo", "needs")
    return by_group.unionByName(by_name).distinct()


def dump(record: dict) -> str:
    return json.dumps(record, ensure_ascii=False, separators=(",", ":"))
