"""Command line: python -m nodeweave.migrate.cli [-C FOLDER] COMMAND …

The folder's env.py gives the store.
"""

from __future__ import annotations

import argparse
import importlib.util
import sys
from pathlib import Path

from nodeweave.exceptions import GraphError
from nodeweave.migrate.manifest import of_catalog, render_manifest
from nodeweave.migrate.runner import Migrator, init


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="nodeweave", description="Migrations of graphs")
    p.add_argument("-C", "--location", default="migrations", help="folder of the revisions")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init", help="lay out the folder")
    c = sub.add_parser("revision", help="write a new revision")
    c.add_argument("-m", "--message", required=True)
    c.add_argument("--head")
    c.add_argument("--rev-id")
    c.add_argument("--branch-label", action="append", default=[])
    c.add_argument("--depends-on", action="append", default=[])
    c.add_argument("--autogenerate", action="store_true")
    c = sub.add_parser("upgrade", help="apply revisions")
    c.add_argument("target", nargs="?", default="head")
    c.add_argument("--preview", action="store_true")
    c.add_argument("--validate", action="store_true")
    c.add_argument("--installed-by")
    c = sub.add_parser("downgrade", help="undo revisions")
    c.add_argument("target", nargs="?", default="-1")
    c.add_argument("--preview", action="store_true")
    c.add_argument("--force", action="store_true")
    sub.add_parser("current", help="applied revisions that no other revises")
    c = sub.add_parser("history", help="all revisions, newest first")
    c.add_argument("range", nargs="?")
    sub.add_parser("heads", help="revisions that no other revises")
    sub.add_parser("branches", help="revisions that several revise")
    c = sub.add_parser("stamp", help="mark as applied")
    c.add_argument("target")
    c.add_argument("--purge", action="store_true")
    c = sub.add_parser("show", help="one revision")
    c.add_argument("revision")
    c = sub.add_parser("test", help="up, down and up again on a copy")
    c.add_argument("revision", nargs="?", default="head")
    c = sub.add_parser("merge", help="join heads")
    c.add_argument("revisions", nargs="*")
    c.add_argument("-m", "--message", default="merge")
    sub.add_parser("validate", help="compare scripts with what was applied")
    c = sub.add_parser("run", help="run a query")
    c.add_argument("query")
    sub.add_parser("info", help="schema and state")
    c = sub.add_parser("baseline", help="a first revision from the present schema")
    c.add_argument("-m", "--message", default="baseline")
    c.add_argument("--stamp-only", action="store_true")
    sub.add_parser("check", help="compare the schema with env.py's target_manifest")
    return p


def load(location: Path) -> Migrator:
    spec = importlib.util.spec_from_file_location("nodeweave_env", location / "env.py")
    if spec is None or not (location / "env.py").exists():
        raise GraphError(f"{location}/env.py isn't there; run init")
    env = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(env)
    if getattr(env, "store", None) is None:
        raise GraphError(f"{location}/env.py sets no store")
    return Migrator(env.store, location, target_manifest=getattr(env, "target_manifest", None))


def run(a: argparse.Namespace, out=print) -> int:
    location = Path(a.location)
    if a.command == "init":
        out(f"made {init(location)}")
        return 0
    m = load(location)
    match a.command:
        case "revision":
            out(m.create_revision(a.message, a.head, a.rev_id, a.branch_label, a.depends_on, a.autogenerate).path)
        case "upgrade" | "downgrade":
            if a.preview:
                m.enable_preview()
            done = m.upgrade(a.target, validate=a.validate, installed_by=a.installed_by) if a.command == "upgrade" else m.downgrade(a.target, force=a.force)
            for line in m.preview_log if a.preview else (f"{a.command}d {r}" for r in done):
                out(line)
        case "current":
            out(", ".join(m.current_revisions()) or "none")
        case "history":
            for r in m.get_history(a.range):
                out(f"{'*' if r.applied else ' '} {r.id} <- {', '.join(r.down) or 'base'}: {r.message}{' (head)' * r.is_head}")
        case "heads":
            for r in m.get_heads():
                out(f"{r.id}: {r.message}")
        case "branches":
            for r, children in m.get_branch_points():
                out(f"{r.id} -> {', '.join(children)}")
        case "stamp":
            m.stamp(a.target, purge=a.purge)
        case "show":
            out(m.show_revision(a.revision).path.read_text())
        case "test":
            m.test(a.revision)
            out("up, down and up again: fine")
        case "merge":
            out(m.merge(a.message, a.revisions or None).path)
        case "validate":
            wrong = m.validate()
            for line in wrong or ["all scripts are as applied"]:
                out(line)
            return int(bool(wrong))
        case "run":
            for row in m.ops.run_cypher(a.query):
                out(row)
        case "info":
            out(f"graph {m.store.name}, version {m.store.version}, revisions {', '.join(m.current_revisions()) or 'none'}")
            out(render_manifest(of_catalog(m.store.catalog())))
        case "baseline":
            out(m.baseline(a.message, stamp_only=a.stamp_only).path)
        case "check":
            found = m.check()
            for line in found or ["the schema is as wanted"]:
                out(line)
            return int(bool(found))
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except GraphError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
