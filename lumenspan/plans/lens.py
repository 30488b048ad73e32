"""Lenses and projections: what is asked, what is answered, and the text form of an answer."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

# The columns of the two layouts.
LOCATOR_COLUMN, NOTE_COLUMN = 140, 56


@dataclass
class Lens:
    """A question: an analyzer, where to look, and parameters as text."""

    analyzer: str
    name: str = ""
    source_root: str = ""
    include: list[str] = field(default_factory=list)
    input: str = ""
    out: str = ""
    params: dict[str, str] = field(default_factory=dict)

    def get(self, *keys: str, default: str = "") -> str:
        return next((v.strip() for k in keys if (v := self.params.get(k, "")).strip()), default)

    def need(self, *keys: str) -> str:
        if not (v := self.get(*keys)):
            raise ValueError(f"{self.analyzer}: params.{keys[0]} is required")
        return v


@dataclass
class Origin:
    file: str
    line: int
    hash: str


@dataclass
class Piece:
    """A block of lines under an anchor."""

    id: str
    file: str
    mode: str
    tool: str
    lines: list[str]
    facts: list[str] = field(default_factory=list)
    origins: list[Origin] = field(default_factory=list)
    guards: list[list[str]] = field(default_factory=list)
    sync: str = ""
    src: tuple[str, int, int, str] | None = None  # file, first, last, hash
    hash: str = ""


@dataclass
class Fact:
    id: str
    text: str
    tool: str = ""


@dataclass
class Projection:
    lens: Lens = field(default_factory=lambda: Lens(""))
    pieces: list[Piece] = field(default_factory=list)
    facts: list[Fact] = field(default_factory=list)
    extra: dict[str, Projection] = field(default_factory=dict)
    sync: str = "view-only"

    def fact(self, id_: str) -> str | None:
        return next((f.text for f in self.facts if f.id == id_), None)

    def finish(self, lens: Lens) -> Projection:
        """In order, and with the hashes of the blocks."""
        self.lens = lens
        self.pieces.sort(key=lambda p: (p.file, p.id))
        self.facts.sort(key=lambda f: f.id)
        for p in self.pieces:
            p.hash = digest("\n".join(p.lines) + "\n")
        for x in self.extra.values():
            x.finish(lens)
        return self

    def body(self) -> str:
        """The part that says the same every time it is made."""
        out = []
        for p in self.pieces:
            out += [anchor(p), *(x.rstrip("\n") for x in p.lines), "@@", *(f"=> {p.id}: {f}" for f in p.facts)]
            out += [f"=> {p.id}: origin {n} src={o.file}:{o.line} srchash={o.hash}" for n, o in enumerate(p.origins, 1) if o.file and o.line > 0]
            out.append("")
        out += [f"=> {f.tool}.{f.id}: {f.text}" if f.tool else f"=> {f.id}: {f.text}" for f in self.facts]
        return "".join(x + "\n" for x in [*out, *([""] if self.facts else [])])

    def render(self, now: datetime | None = None) -> str:
        body, now = self.body(), (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
        head = [f"# lens: {self.lens.name}", f"# analyzer: {self.lens.analyzer}", f"# sync: {self.sync}", f"# source-hash: {digest(body)}", f"# generated-at: {now}"]
        return "# generated by lumenspan\n" + "\n".join(head) + "\n\n" + body

    def write(self, path: str | Path) -> list[Path]:
        """The projection and its further files; returns their paths."""
        made = []
        for to, p in [(Path(path), self), *((Path(path).parent / k, v) for k, v in self.extra.items())]:
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.render())
            made.append(to)
        return made


def digest(s: str) -> str:
    return hashlib.sha1(s.encode("utf-8", "surrogateescape")).hexdigest()[:12]


def anchor(p: Piece) -> str:
    src = f" sync=two-way src={p.src[0]}:{p.src[1]}-{p.src[2]} srchash={p.src[3]}" if p.sync == "two-way" and p.src else ""
    return f"@@ {p.file}#{p.id} [{p.tool}.{p.mode} hash={p.hash}{src}]"


def located(code: str, file: str, line: int) -> str:
    """Code first, then file:line in a column of its own, counted in bytes."""
    code, place = code.rstrip(" \t"), f"{file.rpartition('/')[2]}:{line}"
    gap = LOCATOR_COLUMN - len(code.encode())
    return code + (" " * gap if gap > 0 else "  ") + place


def row(template: str, file: str, line: int, label: str, code: str) -> str:
    if not template:
        return located(code, file, line)
    return re.sub(r"\{(file|line|label|code)\}", lambda m: str({"file": file, "line": line, "label": label, "code": code}[m[1]]), template)


def noted(code: str, note: str) -> str:
    width = sum(4 if c == "\t" else 1 for c in code)
    return code + " " * max(1, NOTE_COLUMN - width) + "// " + note


def confidence(level: str, note: str) -> Fact:
    return Fact("confidence", f"{level}: {note}", "query")


@dataclass
class Repo:
    name: str
    path: str
    role: str = "app"


@dataclass
class Config:
    """Where things are; projects are named lists of repositories."""

    root: str = "."
    projections_dir: str = ".projections"
    exclude_dirs: list[str] = field(default_factory=list)
    lenses: list[Lens] = field(default_factory=list)
    projects: dict[str, list[Repo]] = field(default_factory=dict)
    active_project: str = ""

    @classmethod
    def load(cls, path: str | Path) -> Config:
        raw = json.loads(Path(path).read_text())
        text = lambda v: v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))
        lenses = [Lens(**{**{k: v for k, v in x.items() if k in Lens.__dataclass_fields__}, "params": {k: text(v) for k, v in (x.get("params") or {}).items()}}) for x in raw.get("lenses", [])]
        shown = raw.get("projects") or (raw.get("workspace") or {}).get("projects") or []
        projects = {p["name"]: [Repo(r["name"], r["path"], r.get("role") or "app") for r in p.get("repos", [])] for p in shown}
        return cls(raw.get("root") or str(Path(path).parent), raw.get("projections_dir") or ".projections", raw.get("exclude_dirs") or [], lenses, projects, raw.get("active_project") or next(iter(projects), ""))

    def save(self, path: str | Path) -> None:
        lens = lambda x: {k: v for k, v in x.__dict__.items() if v}
        projects = [{"name": n, "repos": [r.__dict__ for r in repos]} for n, repos in self.projects.items()]
        Path(path).write_text(json.dumps({"root": self.root, "projections_dir": self.projections_dir, "exclude_dirs": self.exclude_dirs, "lenses": [lens(x) for x in self.lenses], "projects": projects, "active_project": self.active_project}, indent=2) + "\n")

    def repos(self, project: str = "", include_libraries: bool = True) -> list[Repo]:
        """A project's repositories; without libraries only the apps, where it has any."""
        found = self.projects.get(project or self.active_project, [])
        if not include_libraries and any(r.role == "app" for r in found):
            found = [r for r in found if r.role == "app"]
        return found

    def out(self, lens: Lens) -> str:
        return lens.out or f"{self.projections_dir}/{lens.name or lens.analyzer}.projection"
