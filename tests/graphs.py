"""Models and small graphs that several tests use."""

from __future__ import annotations

import enum
from datetime import UTC, datetime

from nodeweave import Edge, Field, GeoLocation, MemoryStore, Node, Relation, Session, Vector


class Status(enum.StrEnum):
    DRAFT = "draft"
    PUBLISHED = "published"


class Wrote(Edge, type="WROTE"):
    year: int | None = None
    note: str | None = None


class Writer(Node):
    id: str = Field(primary_key=True)
    name: str
    age: int | None = None
    active: bool = True
    friends: list[Writer] = Relation("FRIEND_OF", target="Writer")
    peers: list[Writer] = Relation("PEERS", "BOTH", "Writer")
    boss: Writer | None = Relation("REPORTS_TO", target="Writer")
    staff: list[Writer] = Relation("REPORTS_TO", "INCOMING", "Writer")
    texts: list[Text] = Relation("WROTE", target="Text", edge_model=Wrote)


class Text(Node):
    id: str = Field(primary_key=True)
    title: str = Field(index_type="FULLTEXT")
    status: Status = Status.DRAFT
    created: datetime | None = None
    embedding: Vector | None = Field(None, index_type="VECTOR")
    place: GeoLocation | None = None
    tags: list[str] = Field(default_factory=list)
    writers: list[Writer] = Relation("WROTE", "INCOMING", "Writer", edge_model=Wrote)


class Place(Node):
    id: str = Field(primary_key=True)
    title: str


class City(Place, labels=["Place", "City"]):
    population: int | None = None


class Country(Place, labels=["Place", "Country"]):
    code: str | None = Field(None, unique=True)


class Counter(Node):
    id: int = Field(primary_key=True, generated=True)
    label: str


def store(spark) -> MemoryStore:
    """alice 30 and bob 25, carol 35 inactive, dan 28; alice -> bob, carol; bob -> dan; dan reports to bob, bob to alice."""
    s = MemoryStore(spark)
    with Session(s) as session:
        alice, bob, carol, dan = people = [Writer(id=i, name=i.title(), age=a, active=i != "carol") for i, a in (("alice", 30), ("bob", 25), ("carol", 35), ("dan", 28))]
        t1 = Text(id="t1", title="Intro to Graphs", tags=["graph", "database"], status=Status.PUBLISHED, created=datetime(2024, 1, 2, tzinfo=UTC), embedding=Vector([1, 0, 0]), place=GeoLocation(1.5, 2.5))
        t2 = Text(id="t2", title="Advanced Cypher graphs", tags=["cypher", "graph"], embedding=Vector([0, 1, 0]))
        t3 = Text(id="t3", title="Tips", embedding=Vector([0.9, 0.1, 0]))
        session.add_all([*people, t1, t2, t3])
        session.flush()
        for a, b in ((alice, bob), (alice, carol), (bob, dan)):
            session.relate(a, Writer.friends, b)
        session.relate(dan, Writer.boss, bob)
        session.relate(bob, Writer.boss, alice)
        for w, t, year in ((alice, t1, 2020), (bob, t2, 2021), (bob, t3, None)):
            session.relate(w, Writer.texts, t, Wrote(year=year))
    return s
