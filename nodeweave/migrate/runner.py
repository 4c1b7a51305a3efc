"""Applying revisions. Which are applied is kept in the graph's own store, so copies carry it."""

from __future__ import annotations

import getpass
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path
from typing import Any

from nodeweave.exceptions import ChecksumMismatchError, IrreversibleMigrationError, MigrationError, RevisionNotFoundError
from nodeweave.migrate.manifest import SchemaManifest, diff, of_catalog
from nodeweave.migrate.operations import GraphOperations
from nodeweave.migrate.scripts import Revision, ScriptDirectory
from nodeweave.sources.store import GraphStore

KEY = "migrations"


@dataclass(frozen=True)
class RevisionInfo:
    id: str
    message: str
    down: tuple[str, ...]
    applied: bool
    is_head: bool


def init(location: str | Path) -> Path:
    """Lay out a folder for revisions."""
    root = Path(location)
    (root / "versions").mkdir(parents=True, exist_ok=True)
    env = root / "env.py"
    if not env.exists():
        env.write_text('"""Gives the command line a store: set `store`, and `target_manifest` for --autogenerate."""\n\nstore = None\ntarget_manifest = None\n')
    return root


class Migrator:
    def __init__(self, store: GraphStore, location: str | Path, preview: bool = False, target_manifest: SchemaManifest | None = None):
        self.store, self.location, self.target_manifest = store, Path(location), target_manifest
        self.ops = GraphOperations(store, preview)

    @property
    def scripts(self) -> ScriptDirectory:
        return ScriptDirectory.load(self.location)

    @property
    def preview_log(self) -> list[str]:
        return self.ops.preview_log

    def enable_preview(self) -> None:
        self.ops.preview = True

    def retarget(self, store: GraphStore) -> None:
        self.store, self.ops = store, GraphOperations(store, self.ops.preview)

    # --- state

    def _state(self) -> dict[str, Any]:
        return {"revisions": [], "checksums": {}, "installed_by": {}, "applied_at": {}} | self.store.meta.get(KEY, {})

    def _save(self, state: dict[str, Any]) -> None:
        self.store.set_meta(self.store.meta | {KEY: state})

    def current_revisions(self) -> list[str]:
        return list(self._state()["revisions"])

    def current(self) -> str | None:
        found = self.current_revisions()
        return found[0] if found else None

    def _record(self, scripts: ScriptDirectory, rev: Revision, installed_by: str | None) -> None:
        s = self._state()
        above = scripts.ancestors(rev.id)
        s["revisions"] = sorted({r for r in s["revisions"] if r not in above} | {rev.id})
        s["checksums"][rev.id] = rev.checksum
        s["installed_by"][rev.id] = installed_by or getpass.getuser()
        s["applied_at"][rev.id] = datetime.now(UTC).isoformat()
        self._save(s)

    def validate(self) -> list[str]:
        """Applied revisions whose script is gone or has changed, as messages."""
        scripts, out = self.scripts, []
        for rev, checksum in sorted(self._state()["checksums"].items()):
            if rev not in scripts.revisions:
                out.append(f"{rev}: its script is missing")
            elif scripts.revisions[rev].checksum != checksum:
                out.append(f"{rev}: its script has changed since it was applied")
        return out

    # --- upgrade and downgrade

    def pending_revisions(self, from_revs: list[str] | None = None, target: str = "heads") -> list[Revision]:
        scripts = self.scripts
        return [scripts.revisions[r] for r in scripts.upgrade_path(set(self.current_revisions() if from_revs is None else from_revs), target)]

    def upgrade(self, target: str = "head", *, validate: bool = False, installed_by: str | None = None) -> list[str]:
        """To a revision, `head`, `heads`, or +N further ones. A revision with `snapshot` is undone as a whole if it fails."""
        if validate and (wrong := self.validate()):
            raise ChecksumMismatchError("; ".join(wrong))
        scripts = self.scripts
        if m := re.fullmatch(r"\+(\d+)", target):
            path = scripts.upgrade_path(set(self.current_revisions()), "heads")[: int(m[1])]
            if len(path) < int(m[1]):
                raise RevisionNotFoundError(f"fewer than {m[1]} revisions are pending")
        else:
            path = scripts.upgrade_path(set(self.current_revisions()), target)
        for name in path:
            rev = scripts.revisions[name]
            if self.ops.preview:
                self.ops.preview_log.append(f"-- upgrade {name}: {rev.message}")
                rev.module.upgrade(self.ops)
                continue
            held = f"before-{name}"
            if rev.snapshot:
                self.store.snapshot(held)
            try:
                rev.module.upgrade(self.ops)
            except Exception:
                if rev.snapshot:
                    self.store.restore_snapshot(held)
                raise
            self._record(scripts, rev, installed_by)
        return path

    def downgrade(self, target: str = "-1", *, force: bool = False) -> list[str]:
        """To a revision, `base`, or -N back. The snapshot from before a revision, if there is one, stands for its downgrade."""
        scripts = self.scripts
        applied = set(self.current_revisions())
        done = set().union(*(scripts.ancestors(a) | {a} for a in applied), set())
        order = [r for r in reversed(scripts.order()) if r in done]
        if m := re.fullmatch(r"-(\d+)", target):
            path = order[: int(m[1])]
            if len(path) < int(m[1]):
                raise RevisionNotFoundError(f"fewer than {m[1]} revisions are applied")
        elif target == "base":
            path = order
        else:
            last = scripts.get(target).id
            if last not in done:
                raise MigrationError(f"{last} isn't applied")
            path = [r for r in order if r in scripts.descendants(last)]
        for name in path:
            rev = scripts.revisions[name]
            if rev.irreversible and not force:
                raise IrreversibleMigrationError(f"{name} can't be undone; force it to try")
            if self.ops.preview:
                self.ops.preview_log.append(f"-- downgrade {name}: {rev.message}")
                rev.module.downgrade(self.ops)
                continue
            if rev.snapshot and self.store.snapshot_exists(f"before-{name}"):
                self.store.restore_snapshot(f"before-{name}")
                self.store.drop_snapshot(f"before-{name}")
            else:
                rev.module.downgrade(self.ops)
            s = self._state()
            left = (set(s["revisions"]) - {name}) | {p for p in rev.down if not any(p in scripts.ancestors(o) | {o} for o in set(s["revisions"]) - {name})}
            s["revisions"] = sorted(left)
            for k in ("checksums", "installed_by", "applied_at"):
                s[k].pop(name, None)
            self._save(s)
        return path

    def stamp(self, target: str, *, purge: bool = False) -> None:
        """Mark a revision and all before it as applied, without running them; `base` with purge: none."""
        scripts = self.scripts
        if purge:
            self._save({"revisions": [], "checksums": {}, "installed_by": {}, "applied_at": {}})
        if target == "base":
            return
        for r in scripts.heads() if target == "heads" else [scripts.get(target).id]:
            for name in scripts.order(scripts.ancestors(r) | {r}):
                self._record(scripts, scripts.revisions[name], None)

    # --- information

    def get_history(self, range_: str | None = None) -> list[RevisionInfo]:
        """Newest first. `a:b`: from after a to b."""
        scripts = self.scripts
        applied = set(self.current_revisions())
        done = set().union(*(scripts.ancestors(a) | {a} for a in applied if a in scripts.revisions), set())
        names = scripts.order()
        if range_:
            low, _, high = range_.partition(":")
            if high:
                last = scripts.get(high).id
                names = [n for n in names if n == last or n in scripts.ancestors(last)]
            if low:
                first = scripts.get(low).id
                names = [n for n in names if n != first and n not in scripts.ancestors(first)]
        heads = set(scripts.heads())
        return [RevisionInfo(n, scripts.revisions[n].message, scripts.revisions[n].down, n in done, n in heads) for n in reversed(names)]

    def get_heads(self) -> list[Revision]:
        s = self.scripts
        return [s.revisions[h] for h in s.heads()]

    def get_branch_points(self) -> list[tuple[Revision, list[str]]]:
        s = self.scripts
        return [(s.revisions[r], s.children(r)) for r in s.branch_points()]

    def show_revision(self, name: str) -> Revision:
        return self.scripts.get(name)

    # --- new revisions

    def create_revision(self, message: str, head: str | None = None, rev_id: str | None = None, branch_labels: list[str] = (), depends_on: list[str] = (), autogenerate: bool = False) -> Revision:
        up, down = diff(of_catalog(self.store.catalog()), self.target_manifest) if autogenerate and self.target_manifest else ([], [])
        s = self.scripts
        return s.create(message, None if head is None else (s.get(head).id,), rev_id, branch_labels, depends_on, [o.render() for o in up], [o.render() for o in down])

    def merge(self, message: str = "merge", revisions: list[str] | None = None) -> Revision:
        s = self.scripts
        heads = tuple(s.get(r).id for r in revisions) if revisions else tuple(s.heads())
        if len(heads) < 2:
            raise MigrationError("there is nothing to merge")
        return s.create(message, heads)

    def baseline(self, message: str = "baseline", *, stamp_only: bool = False) -> Revision:
        """A first revision that makes the present schema, marked as applied."""
        s = self.scripts
        if s.revisions and not stamp_only:
            raise MigrationError("there are revisions already")
        if stamp_only:
            rev = s.get("head")
        else:
            up, down = diff(SchemaManifest(), of_catalog(self.store.catalog()))
            rev = s.create(message, (), upgrade=[o.render() for o in up], downgrade=[o.render() for o in down])
        self.stamp(rev.id)
        return rev

    def check(self) -> list[str]:
        """Differences between the graph's schema and the wanted one, as operations."""
        return [o.render() for o in diff(of_catalog(self.store.catalog()), self.target_manifest or SchemaManifest())[0]]

    def test(self, name: str, scratch: str = "migration-test") -> None:
        """Upgrade, downgrade and upgrade again on a copy of the graph."""
        s = self.scripts
        rev = s.get(name)
        copy = self.store.fork(scratch)
        try:
            other = Migrator(copy, self.location)
            for p in rev.down:
                other.upgrade(p)
            other.upgrade(rev.id)
            if not rev.irreversible:
                other.downgrade("-1")
                other.upgrade(rev.id)
        finally:
            copy.delete_graph()
