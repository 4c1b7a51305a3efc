"""Revision scripts and the graph that they form."""

from __future__ import annotations

import hashlib
import importlib.util
import re
import secrets
from dataclasses import dataclass, field
from datetime import UTC, datetime
from graphlib import CycleError, TopologicalSorter
from pathlib import Path
from types import ModuleType

from nodeweave.exceptions import MigrationError, MultipleHeadsError, RevisionNotFoundError

TEMPLATE = '''"""{message}

Revision ID: {revision}
Revises: {shown}
Create Date: {date}
"""

message = {message!r}
create_date = {date!r}

revision = {revision!r}
down_revision = {down!r}
branch_labels = {labels!r}
depends_on = {depends!r}
irreversible = False  # True: a downgrade needs force
snapshot = False  # True: the graph is copied before the upgrade, and restored if that fails


def upgrade(op):
{upgrade}


def downgrade(op):
{downgrade}
'''


@dataclass
class Revision:
    id: str
    down: tuple[str, ...]
    message: str
    path: Path
    module: ModuleType
    branch_labels: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    irreversible: bool = False
    snapshot: bool = False
    create_date: str = ""

    @property
    def checksum(self) -> str:
        return hashlib.sha256(self.path.read_bytes()).hexdigest()


@dataclass
class ScriptDirectory:
    """All scripts `versions/*.py`, but those whose name starts with an underscore."""

    root: Path
    revisions: dict[str, Revision] = field(default_factory=dict)

    @classmethod
    def load(cls, root: str | Path) -> ScriptDirectory:
        out = cls(Path(root))
        for path in sorted((out.root / "versions").glob("*.py")):
            if path.name.startswith("_"):
                continue
            spec = importlib.util.spec_from_file_location(f"nodeweave_revision_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            down = getattr(module, "down_revision", None)
            down = () if down is None else (down,) if isinstance(down, str) else tuple(down)
            rev = Revision(module.revision, down, getattr(module, "message", (module.__doc__ or "").strip().split("\n")[0]), path, module, tuple(getattr(module, "branch_labels", ())), tuple(getattr(module, "depends_on", ())), getattr(module, "irreversible", False), getattr(module, "snapshot", False), str(getattr(module, "create_date", "")))
            if rev.id in out.revisions:
                raise MigrationError(f"two scripts have the revision {rev.id}")
            out.revisions[rev.id] = rev
        for rev in out.revisions.values():
            for parent in rev.down:
                if parent not in out.revisions:
                    raise RevisionNotFoundError(f"{rev.id} revises {parent}, which isn't there")
        return out

    def children(self, rev: str) -> list[str]:
        return sorted(r.id for r in self.revisions.values() if rev in r.down)

    def heads(self) -> list[str]:
        parents = {p for r in self.revisions.values() for p in r.down}
        return sorted(set(self.revisions) - parents)

    def bases(self) -> list[str]:
        return sorted(r.id for r in self.revisions.values() if not r.down)

    def branch_points(self) -> list[str]:
        return [r for r in self.order() if len(self.children(r)) > 1]

    def ancestors(self, rev: str) -> set[str]:
        out, todo = set(), [rev]
        while todo:
            for p in self.revisions[todo.pop()].down:
                if p not in out:
                    out.add(p)
                    todo.append(p)
        return out

    def descendants(self, rev: str) -> set[str]:
        return {r for r in self.revisions if rev in self.ancestors(r)}

    def order(self, among: set[str] | None = None) -> list[str]:
        """Parents first; those of equal standing by date, then id."""
        among = set(self.revisions) if among is None else among
        sorter = TopologicalSorter({r: [p for p in self.revisions[r].down if p in among] for r in among})
        try:
            sorter.prepare()
        except CycleError as e:
            raise MigrationError(f"revisions form a cycle: {e.args[1]}") from None
        out = []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=lambda r: (self.revisions[r].create_date, r))
            out += ready
            sorter.done(*ready)
        return out

    def get(self, name: str) -> Revision:
        """By id, unique prefix, branch label, `head` or `base`."""
        if name == "head":
            heads = self.heads()
            if len(heads) != 1:
                raise MultipleHeadsError(f"there are {len(heads)} heads: {', '.join(heads)}") if heads else RevisionNotFoundError("there are no revisions")
            return self.revisions[heads[0]]
        if name == "base":
            bases = self.bases()
            if len(bases) != 1:
                raise RevisionNotFoundError(f"there are {len(bases)} bases")
            return self.revisions[bases[0]]
        if name in self.revisions:
            return self.revisions[name]
        found = [r for r in self.revisions if r.startswith(name)] if name else []
        found = found or [r.id for r in self.revisions.values() if name in r.branch_labels]
        if len(found) != 1:
            raise RevisionNotFoundError(f"{len(found)} revisions match {name!r}")
        return self.revisions[found[0]]

    def upgrade_path(self, applied: set[str], target: str = "head") -> list[str]:
        """What must run, in order, to have `target` (`heads`: all) on top of what is applied."""
        done = set().union(*(self.ancestors(a) | {a} for a in applied if a in self.revisions), set())
        if target == "heads":
            wanted = set(self.revisions)
        else:
            if target == "head" and len(self.heads()) > 1:
                raise MultipleHeadsError(f"there are several heads: {', '.join(self.heads())}")
            last = self.get(target).id
            wanted = self.ancestors(last) | {last}
        return self.order(wanted - done)

    def iterate(self, start: str, stop: str | None = None) -> list[str]:
        """From `start` down to before `stop`, by the first parent of a merge."""
        out, now = [], start
        while now is not None and now != stop:
            out.append(now)
            now = next(iter(self.revisions[now].down), None)
        return out

    @staticmethod
    def new_id() -> str:
        return secrets.token_hex(6)

    def create(self, message: str, down: tuple[str, ...] | None = None, rev_id: str | None = None, branch_labels: list[str] = (), depends_on: list[str] = (), upgrade: list[str] = (), downgrade: list[str] = ()) -> Revision:
        rev_id = rev_id or self.new_id()
        if down is None:
            down = tuple(self.heads())
            if len(down) > 1:
                raise MultipleHeadsError(f"name one of the heads to revise: {', '.join(down)}")
        slug = re.sub(r"[^a-z0-9]+", "_", message.lower()).strip("_")[:40]
        body = lambda lines: "\n".join(f"    {x}" for x in lines) or "    pass"
        value = None if not down else down[0] if len(down) == 1 else tuple(down)
        text = TEMPLATE.format(message=message.replace('"""', "'''"), revision=rev_id, shown=", ".join(down) or "-", date=datetime.now(UTC).isoformat(), down=value, labels=list(branch_labels), depends=list(depends_on), upgrade=body(upgrade), downgrade=body(downgrade))
        (self.root / "versions").mkdir(parents=True, exist_ok=True)
        path = self.root / "versions" / f"{rev_id}_{slug}.py"
        path.write_text(text)
        self.revisions = ScriptDirectory.load(self.root).revisions
        return self.revisions[rev_id]
