"""Indexes and constraints as models declare them, against those of a graph."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from nodeweave.migrate.operations import GraphOperations
from nodeweave.model import Node
from nodeweave.sources.store import GraphStore


@dataclass(frozen=True, order=True)
class IndexSpec:
    label: str
    property: str
    index_type: str


@dataclass
class SchemaDiff:
    missing: list[IndexSpec] = field(default_factory=list)
    extra: list[IndexSpec] = field(default_factory=list)
    matching: list[IndexSpec] = field(default_factory=list)

    @property
    def in_sync(self) -> bool:
        return not self.missing and not self.extra


def declared(cls: type[Node]) -> list[IndexSpec]:
    return [IndexSpec(cls.primary_label, n, f.index_kind) for n, f in cls.fields.items() if f.index_kind]


class IndexManager:
    def __init__(self, store: GraphStore):
        self.store, self.ops = store, GraphOperations(store)

    def existing(self) -> set[IndexSpec]:
        c = self.store.catalog()
        out = {IndexSpec(i.label, p, i.kind) for i in c.indexes if not i.rel for p in i.properties}
        return out | {IndexSpec(x.label, x.properties[0], "UNIQUE") for x in c.constraints if x.kind == "UNIQUE" and x.entity == "NODE" and len(x.properties) == 1}

    def create_spec(self, spec: IndexSpec) -> None:
        match spec.index_type:
            case "UNIQUE":
                self.ops.create_constraint("UNIQUE", "NODE", spec.label, [spec.property])
            case "RANGE":
                self.ops.create_range_index(spec.label, spec.property)
            case "FULLTEXT":
                self.ops.create_fulltext_index(spec.label, spec.property)
            case "VECTOR":
                self.ops.create_vector_index(spec.label, spec.property, 0)

    def drop_spec(self, spec: IndexSpec) -> None:
        c = self.store.catalog()
        match spec.index_type:
            case "UNIQUE":
                self.ops.drop_constraint("UNIQUE", "NODE", spec.label, [spec.property])
            case "RANGE":
                self.ops.drop_range_index(spec.label, spec.property)
            case "FULLTEXT":
                for i in c.indexes:
                    if i.kind == "FULLTEXT" and i.label == spec.label and spec.property in i.properties:
                        self.ops.drop_fulltext_index(i.label, *i.properties)
                        if rest := [p for p in i.properties if p != spec.property]:
                            self.ops.create_fulltext_index(i.label, *rest)
            case "VECTOR":
                self.ops.drop_vector_index(spec.label, spec.property)

    def create_indexes(self, cls: type[Node]) -> list[IndexSpec]:
        """All that the model declares; full-text fields of a label make one index."""
        specs = declared(cls)
        text = [s.property for s in specs if s.index_type == "FULLTEXT"]
        if text:
            self.ops.create_fulltext_index(cls.primary_label, *text)
        for s in specs:
            if s.index_type != "FULLTEXT":
                self.create_spec(s)
        return specs

    def ensure_indexes(self, models: Iterable[type[Node]]) -> list[IndexSpec]:
        """What is missing, made."""
        have, made = self.existing(), []
        for cls in models:
            missing = [s for s in declared(cls) if s not in have]
            text = [s for s in missing if s.index_type == "FULLTEXT"]
            if text:
                self.ops.create_fulltext_index(cls.primary_label, *(s.property for s in text))
            for s in missing:
                if s.index_type != "FULLTEXT":
                    self.create_spec(s)
            made += missing
            have |= set(missing)
        return made


class SchemaManager:
    def __init__(self, store: GraphStore):
        self.store, self.indexes = store, IndexManager(store)

    def ensure_entity_types(self, models: Iterable[type[Node]]) -> None:
        for cls in models:
            self.indexes.ops.create_vertex_type(cls.primary_label)
            for r in cls.relations.values():
                self.indexes.ops.create_edge_type(r.relationship)

    def get_schema_diff(self, models: Iterable[type[Node]]) -> SchemaDiff:
        want, have = {s for m in models for s in declared(m)}, self.indexes.existing()
        return SchemaDiff(sorted(want - have), sorted(have - want), sorted(want & have))

    def validate_schema(self, models: Iterable[type[Node]]) -> bool:
        return not self.get_schema_diff(models).missing

    def sync_schema(self, models: Iterable[type[Node]], drop_extra: bool = False) -> SchemaDiff:
        models = list(models)
        found = self.get_schema_diff(models)
        if drop_extra:
            for s in found.extra:
                self.indexes.drop_spec(s)
        self.indexes.ensure_indexes(models)
        return found

    def get_schema_info(self) -> dict[str, list[dict[str, str]]]:
        out: dict[str, list[dict[str, str]]] = {}
        for s in sorted(self.indexes.existing()):
            out.setdefault(s.label, []).append({"property": s.property, "type": s.index_type})
        return out
