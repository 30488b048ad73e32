"""Following a source tree: what changed since the round before decides what is done again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import Path

from lumenspan.functions.languages import EXCLUDED_DIRS
from lumenspan.plans import lenses, sync
from lumenspan.plans.lens import Config
from lumenspan.sources.files import excluded


def stamps(config: Config) -> tuple[dict[str, int], dict[str, int]]:
    """Times of change of the sources, and of the projections."""
    top = Path(config.root)
    own = top / config.projections_dir
    of = lambda paths: {str(p.relative_to(top)): p.stat().st_mtime_ns for p in paths if p.is_file()}
    sources = of(p for p in top.rglob("*.*") if own not in p.parents and not excluded(str(p.relative_to(top)), config.exclude_dirs or EXCLUDED_DIRS))
    return sources, of(own.glob("*.projection")) if own.exists() else {}


def follow_tree(spark, config: Config, rounds: int | None = None, tick: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Each round: new files that name a place become bookmarks, edited two-way projections are synced, and all lenses run again
    if a source has changed. Yields what was done, if anything was."""
    sources, projections = stamps(config)
    n = 0
    while rounds is None or n < rounds:
        sleep(tick)
        n += 1
        done: dict = {"drop_ins": [str(p) for p in sync.expand_drop_ins(config)]}
        now_sources, now_projections = stamps(config)
        for p in sorted(k for k, v in now_projections.items() if projections.get(k) != v and k not in done["drop_ins"]):
            r = sync.sync(config, Path(config.root) / p)
            if r.to_source or r.to_projection or r.conflicts:
                done.setdefault("synced", {})[p] = r.__dict__
        now_sources, _ = stamps(config)
        changed = sorted(k for k in {*sources, *now_sources} if sources.get(k) != now_sources.get(k))
        if changed:
            done["changed"] = changed
            done["written"] = lenses.run_all(spark, config)
        sources, projections = now_sources, stamps(config)[1]
        if any(done.values()):
            yield done
