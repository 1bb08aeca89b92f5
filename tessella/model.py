"""The model of a store: entities, attributes, relations, enumerations and units.

Every name may be an application name or a base name; the application name comes
first, and names are matched in their case. Where several entities share a base name,
the first in the model's order is taken.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from . import types
from .errors import IncompatibleUnits, QueryError, UnknownAttribute, UnknownEntity, UnknownRelation, UnknownUnit


@dataclass(frozen=True)
class Attribute:
    name: str
    column: str
    datatype: str
    base: str = ""
    length: int = 0
    obligatory: bool = False
    unique: bool = False
    unit: int = 0
    enumeration: str = ""


@dataclass(frozen=True)
class Relation:
    """A directed edge. column: the foreign key in this entity's table, if it is a to-one
    relation; a to-many relation has none and is followed through its inverse, or
    through bridge: (table, column of this side, column of the other side)."""

    name: str
    target: str
    column: str = ""
    base: str = ""
    inverse: str = ""
    inverse_base: str = ""
    max: int = 1
    inverse_max: int = -1
    min: int = 0
    kind: str = "INFO"
    bridge: tuple[str, str, str] | None = None
    #: Every key in column is an id of target: a filter or projection of the id needs no join.
    trusted: bool = True


@dataclass
class Entity:
    aid: int
    name: str
    base: str
    table: str
    attributes: dict[str, Attribute] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)

    def attribute(self, name: str) -> Attribute | None:
        return self.attributes.get(name) or next((a for a in self.attributes.values() if name and a.base == name), None)

    def relation(self, name: str) -> Relation | None:
        return self.relations.get(name) or next((r for r in self.relations.values() if name and r.base == name), None)

    @property
    def id(self) -> Attribute | None:
        return self.attribute("id")


@dataclass(frozen=True)
class Unit:
    """A unit of a dimension: a value v stands for v * factor + offset of the dimension's own unit."""

    id: int
    name: str
    factor: float = 1.0
    offset: float = 0.0
    dimension: str = ""


class Model:
    def __init__(self, entities=(), enumerations: dict[str, dict[str, int]] | None = None, units=()):
        self.entities: dict[str, Entity] = {e.name: e for e in entities}
        self.enumerations = {n: dict(items) for n, items in (enumerations or {}).items()}
        self.units: dict[int, Unit] = {u.id: u for u in units}

    def entity(self, name: str | int) -> Entity:
        """By application name, then base name, then number."""
        name = str(name)
        if found := self.entities.get(name):
            return found
        for e in self.entities.values():
            if e.base == name:
                return e
        if name.isdigit():
            for e in self.entities.values():
                if e.aid == int(name):
                    return e
        raise UnknownEntity(f"the model has no entity {name}")

    def entities_of_base(self, base: str) -> list[Entity]:
        return [e for e in self.entities.values() if e.base == base]

    def top_level(self) -> list[Entity]:
        """Entities that are no one's child."""
        return [e for e in self.entities.values() if not any(r.kind == "FATHER_CHILD" and r.column for r in e.relations.values())]

    def attribute(self, entity: Entity, name: str) -> Attribute:
        if found := entity.attribute(name):
            return found
        raise UnknownAttribute(f"{entity.name} has no attribute {name}")

    def relation(self, entity: Entity, name: str) -> Relation:
        if found := entity.relation(name):
            return found
        raise UnknownRelation(f"{entity.name} has no relation {name}")

    def inverse(self, entity: Entity, relation: Relation) -> Relation:
        return self.relation(self.entity(relation.target), relation.inverse)

    def name_of(self, entity: Entity, name: str) -> str:
        """The application name of an attribute or relation."""
        found = entity.attribute(name) or entity.relation(name)
        if found is None:
            raise UnknownAttribute(f"{entity.name} has neither an attribute nor a relation {name}")
        return found.name

    def many_relations(self, entity: Entity) -> list[str]:
        return [r.name for r in entity.relations.values() if r.max != 1]

    def enum_index(self, attribute: Attribute, value) -> int:
        """An enumeration item's number, by its name (in its case) or its number."""
        items = self.enumerations.get(attribute.enumeration, {})
        if isinstance(value, str) and value in items:
            return items[value]
        try:
            return int(value)
        except (TypeError, ValueError):
            raise QueryError(f"{attribute.enumeration or attribute.name} has no item {value}") from None

    def unit(self, number: int) -> Unit:
        if number in self.units:
            return self.units[number]
        raise UnknownUnit(f"the model has no unit {number}")

    def conversion(self, source: int, target: int) -> tuple[float, float]:
        """(factor, offset) that turn a value in unit source into one in unit target; 0 is no unit."""
        if source == target or not source or not target:
            return 1.0, 0.0
        a, b = self.unit(source), self.unit(target)
        if a.dimension != b.dimension:
            raise IncompatibleUnits(f"{a.name} and {b.name} measure different things")
        return a.factor / b.factor, (a.offset - b.offset) / b.factor

    # Changes of the model. Tables stay as they are: a new attribute is null where a table lacks its column.

    def add_entity(self, entity: Entity) -> None:
        self.entities[entity.name] = entity

    def delete_entity(self, name: str) -> None:
        gone = self.entity(name)
        del self.entities[gone.name]
        for e in self.entities.values():
            e.relations = {n: r for n, r in e.relations.items() if r.target != gone.name}

    def add_attribute(self, entity: str, attribute: Attribute) -> None:
        self.entity(entity).attributes[attribute.name] = attribute

    def delete_attribute(self, entity: str, name: str) -> None:
        e = self.entity(entity)
        del e.attributes[self.attribute(e, name).name]

    def add_relation(self, entity: str, relation: Relation) -> None:
        """Adds a relation and, if it names one that is missing, its inverse."""
        e = self.entity(entity)
        e.relations[relation.name] = relation
        other = self.entity(relation.target)
        if relation.inverse and not other.relation(relation.inverse):
            bridge = relation.bridge and (relation.bridge[0], relation.bridge[2], relation.bridge[1])
            other.relations[relation.inverse] = Relation(
                relation.inverse, e.name, base=relation.inverse_base, inverse=relation.name, inverse_base=relation.base,
                max=relation.inverse_max, inverse_max=relation.max, kind=relation.kind, bridge=bridge,
            )

    def delete_relation(self, entity: str, name: str) -> None:
        e = self.entity(entity)
        relation = self.relation(e, name)
        del e.relations[relation.name]
        self.entity(relation.target).relations.pop(relation.inverse, None)

    def create_enumeration(self, name: str, items: dict[str, int] | None = None) -> None:
        if name in self.enumerations:
            raise QueryError(f"there is an enumeration {name}")
        self.enumerations[name] = dict(items or {})

    def remove_enumeration(self, name: str) -> None:
        if any(a.enumeration == name for e in self.entities.values() for a in e.attributes.values()):
            raise QueryError(f"attributes use the enumeration {name}")
        del self.enumerations[name]

    def add_item(self, enumeration: str, item: str, index: int | None = None) -> None:
        items = self.enumerations[enumeration]
        if item in items:
            raise QueryError(f"{enumeration} has an item {item}")
        items[item] = max(items.values(), default=-1) + 1 if index is None else index

    def rename_item(self, enumeration: str, old: str, new: str) -> None:
        items = self.enumerations[enumeration]
        self.enumerations[enumeration] = {new if n == old else n: k for n, k in items.items()}

    # As plain data.

    def to_dict(self) -> dict:
        """The model in the form of the public model resource."""
        entities = []
        for e in self.entities.values():
            attributes = []
            for a in e.attributes.values():
                row = {"name": a.name, "baseName": a.base, "dataType": a.datatype, "length": a.length, "obligatory": a.obligatory, "unique": a.unique, "unitId": a.unit}
                attributes.append(row | ({"enumeration": a.enumeration} if types.scalar_of(a.datatype) == "DT_ENUM" else {}))
            relations = [
                {
                    "name": r.name, "baseName": r.base, "inverseName": r.inverse, "inverseBaseName": r.inverse_base, "obligatory": r.min != 0 and r.max != -1,
                    "type": {(1, -1): "1-n", (-1, 1): "n-1"}.get((r.max, r.inverse_max), "n-m"), "kind": r.kind,
                    "relEntityName": r.target, "relEntityBaseName": self.entity(r.target).base,
                }
                for r in e.relations.values()
            ]
            entities.append({"name": e.name, "baseName": e.base, "objecttype": e.aid, "attributes": attributes, "relations": relations})
        enumerations = [{"name": n, "entries": [{"name": i, "index": k} for i, k in items.items()]} for n, items in self.enumerations.items()]
        return {"enumerations": enumerations, "entities": entities}

    def to_json(self) -> str:
        """Everything, to be read back by from_json."""
        return json.dumps({
            "entities": [
                {"aid": e.aid, "name": e.name, "base": e.base, "table": e.table, "attributes": [vars(a) for a in e.attributes.values()], "relations": [vars(r) for r in e.relations.values()]}
                for e in self.entities.values()
            ],
            "enumerations": self.enumerations,
            "units": [vars(u) for u in self.units.values()],
        })

    @classmethod
    def from_json(cls, text: str) -> Model:
        data = json.loads(text)
        entities = []
        for e in data["entities"]:
            attributes = {a["name"]: Attribute(**a) for a in e["attributes"]}
            relations = {r["name"]: Relation(**r | {"bridge": tuple(r["bridge"]) if r.get("bridge") else None}) for r in e["relations"]}
            entities.append(Entity(e["aid"], e["name"], e["base"], e["table"], attributes, relations))
        return cls(entities, data["enumerations"], [Unit(**u) for u in data["units"]])

    def copy(self) -> Model:
        entities = [replace(e, attributes=dict(e.attributes), relations=dict(e.relations)) for e in self.entities.values()]
        return Model(entities, self.enumerations, self.units.values())

    def check(self) -> list[str]:
        """What is not consistent."""
        out = []
        for e in self.entities.values():
            for r in e.relations.values():
                if r.target not in self.entities:
                    out.append(f"{e.name}.{r.name}: no entity {r.target}")
                elif r.inverse and not self.entities[r.target].relation(r.inverse):
                    out.append(f"{e.name}.{r.name}: {r.target} has no inverse {r.inverse}")
            out += [f"{e.name}.{a.name}: no enumeration {a.enumeration}" for a in e.attributes.values() if a.enumeration and a.enumeration not in self.enumerations]
        return out
