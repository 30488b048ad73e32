"""Projects of repositories: adding, cloning, dependencies among them, tables and symbols across them."""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.operators import relate
from lumenspan.sources import files as source

from .lens import Config, Lens, Repo


def is_git_url(s: str) -> bool:
    return "://" in s or s.startswith("git@") or s.endswith(".git")


def normal_url(s: str) -> str:
    """owner/name and host/owner/name as https URLs; others stay."""
    s = s.strip()
    if is_git_url(s):
        return s
    if re.fullmatch(r"[\w.-]+/[\w.-]+", s):
        return f"https://github.com/{s}.git"
    return f"https://{s}.git" if re.fullmatch(r"[\w-]+\.[\w.-]+/[\w./-]+", s) else s


def add(config: Config, project: str, path: str, name: str = "", role: str = "app") -> Repo:
    repo = Repo(name or Path(path.rstrip("/")).name.removesuffix(".git"), path, role)
    repos = config.projects.setdefault(project, [])
    repos[:] = [r for r in repos if r.name != repo.name] + [repo]
    config.active_project = config.active_project or project
    return repo


def remove(config: Config, project: str, name: str = "") -> None:
    if name:
        config.projects[project] = [r for r in config.projects.get(project, []) if r.name != name]
    else:
        config.projects.pop(project, None)


def clone(url: str, into: str) -> Path:
    """A shallow clone; a folder that is there already is left as it is."""
    to = Path(into) / normal_url(url).rstrip("/").rpartition("/")[2].removesuffix(".git")
    if not to.exists():
        subprocess.run(["git", "clone", "--depth", "1", normal_url(url), str(to)], check=True, capture_output=True)
    return to


def dependencies(spark: SparkSession, config: Config, project: str = "") -> DataFrame:
    """(repo, needs) among a project's repositories, by their build files."""
    from .lenses import Context

    c, files = Context(spark, config, Lens("workspace")), None
    for r in config.repos(project):
        part = source.read_tree(spark, f"{config.root}/{r.path}" if not r.path.startswith("/") else r.path, r.name, (".gradle", ".kts"))
        files = part if files is None else files.unionByName(part)
    del c
    return source.internal_dependencies(*source.gradle(files))


def tables_view(spark: SparkSession, config: Config, project: str = "") -> list[dict]:
    """Each table with its entity, migrations and the places that write and read it."""
    from .lenses import Context, Project

    p = Project(Context(spark, config, Lens("trace-to-line", params={"project": project} if project else {})))
    sites = p.access.groupBy("table").agg(F.array_sort(F.collect_list(F.struct("path", "line", "code", "write"))).alias("s"))
    rows = p.database[0].join(sites, F.col("name") == F.col("table"), "left").orderBy("name").collect()
    place = lambda x: f"{x.path}:{x.line} {x.code}"
    return [{"table": r["name"], "entity": r.entity, "note": r.map_note, "migrations": r.migrations, "writers": [place(x) for x in r.s or [] if x.write], "readers": [place(x) for x in r.s or [] if not x.write]} for r in rows]


def symbols(spark: SparkSession, config: Config, query: str, project: str = "", limit: int = 50) -> list[str]:
    """Types, methods and tables of a project whose names hold the query, for completion."""
    from .lenses import Context, Project

    p = Project(Context(spark, config, Lens("trace-to-line", params={"project": project} if project else {})))
    names = p.types.select("name").unionByName(p.methods.select(F.concat_ws(".", "type", "name").alias("name"))).unionByName(p.database[0].select("name")).distinct()
    return [r["name"] for r in relate.search_symbols(names, "name", query, ["name"], limit).collect()]


def search_symbols(spark: SparkSession, config: Config, query: str, root: str = "", limit: int = 200) -> list[dict]:
    """Declared symbols of a tree, and files, whose names hold the query; by file and line."""
    from .lenses import Context

    c = Context(spark, config, Lens("symbols", source_root=root))
    found = source.explode(c.parsed, "symbols")
    return [{"name": r["name"], "kind": r.kind, "file": r.path, "line": r.line} for r in relate.search_symbols(found, "name", query, ["path", "line", "name"], limit).collect()]
