"""Which mentions are one entity.

Names are resolved within a document, in order of appearance: a mention joins the one person known so far that
it fits, and starts a new person if it fits none or several, so that no one is given another's surrogate. That
fold depends on order and stays in one Arrow UDF over the document's array. All other types, and the numbering of
entities, are native.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import let, partial_mask, token_prefix

PERSON = "struct<start:int,key:string,gender:string,surname:string,first:string,patronymic:string,alias_types:array<string>,roles:array<string>>"
MAPPING = (
    "struct<entity_id:string,type:string,original:string,token:string,synthetic:string,partial:string,original_nominal:string,synthetic_nominal:string,grammatical_case:string,"
    "gender:string,aliases:array<string>,alias_types:array<string>,original_identity:struct<surname:string,first:string,patronymic:string,gender:string>,"
    "synthetic_identity:struct<surname:string,first:string,patronymic:string,gender:string>,synthetic_fallback:string>"
)
_ORDER = ("surname", "first", "patronymic")


@dataclass
class Person:
    number: int
    gender: str | None
    known: dict[str, str] = field(default_factory=dict)
    aliases: set[str] = field(default_factory=set)
    starts: list[int] = field(default_factory=list)

    @property
    def key(self) -> str:
        return "person:" + "|".join(self.known.get(r, "") for r in _ORDER) + f"#{self.number}"

    def evidence(self, parts: list, gender: str | None) -> dict[int, str] | None:
        """Roles of the mention's parts if it speaks of this person, else None. The surname must agree, and so must
        the given name, the patronymic or all initials; a word in a role that is still open proves nothing."""
        if self.gender and gender and self.gender != gender:
            return None
        roles: dict[int, str] = {}
        agreed: set[str] = set()
        fresh: dict[int, str] = {}
        for i, p in enumerate(parts):
            if p["kind"] != "word" or not p["normalized"]:
                continue
            role, word = p["role"], p["normalized"]
            if not role:
                role = next((r for r, w in self.known.items() if w == word and r not in agreed), None)
            if role is None or role in agreed:
                return None
            if role not in self.known:
                fresh[i] = role
            elif self.known[role] != word:
                return None
            else:
                roles[i] = role
                agreed.add(role)
        if "surname" not in agreed:
            return None
        initials = [i for i, p in enumerate(parts) if p["kind"] == "initial"]
        if initials:
            for i, role in zip(initials, ("first", "patronymic", None), strict=False):
                if role is None or self.known.get(role, " ")[0].upper() != parts[i]["letter"].upper():
                    return None
                roles[i] = role
            return roles
        return roles | fresh if agreed - {"surname"} else None

    def absorb(self, start: int, parts: list, gender: str | None, alias: str | None) -> None:
        self.starts.append(start)
        self.aliases.add(alias or "FULL")
        self.gender = self.gender or gender
        for p in parts:
            if p["kind"] == "word" and p["role"] and p["normalized"]:
                self.known.setdefault(p["role"], p["normalized"])


def resolve(mentions: list) -> list[tuple]:
    """Rows of :data:`PERSON` for name decisions, in order of start."""
    people: list[Person] = []
    placed: list[tuple[int, Person, list]] = []
    for d in sorted(mentions or (), key=lambda d: d["start"]):
        meta = d["meta"]
        parts = [p if isinstance(p, dict) else p.asDict() for p in (meta["name_parts"] or ())]
        fitting = [(p, roles) for p in people if (roles := p.evidence(parts, meta["gender"])) is not None]
        if len(fitting) == 1:
            person, roles = fitting[0]
            for i, role in roles.items():
                parts[i]["role"] = role
        else:
            person = Person(len(people) + 1, meta["gender"])
            people.append(person)
        person.absorb(d["start"], parts, meta["gender"], meta["alias_type"])
        placed.append((d["start"], person, [p["role"] for p in parts]))
    cap = lambda w: w.capitalize() if w else None
    return [(start, p.key, p.gender, *[cap(p.known.get(r)) for r in _ORDER], sorted(p.aliases), roles) for start, p, roles in placed]


def personal(decisions: Column) -> Column:
    return F.filter(decisions, lambda d: d["decision"] == "MASK")


def _alone(d: Column) -> Column:
    """The row of :data:`PERSON` of a name that is the only one of its text: what :func:`resolve` makes of it."""
    parts = d["meta"]["name_parts"]

    def told(known: Column) -> Column:
        key = F.concat(F.lit("person:"), F.concat_ws("|", *[F.coalesce(known[r], F.lit("")) for r in _ORDER]), F.lit("#1"))
        cap = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2), F.length(w)))
        alias = F.when(F.length(d["meta"]["alias_type"]) > 0, d["meta"]["alias_type"]).otherwise("FULL")
        return F.struct(d["start"], key, d["meta"]["gender"], *[cap(known[r]) for r in _ORDER], F.array(alias), F.transform(parts, lambda p: p["role"])).cast(PERSON)

    said = lambda role: F.get(F.filter(parts, lambda p: (p["kind"] == "word") & (p["role"] == role) & (F.length(p["normalized"]) > 0)), F.lit(0))["normalized"]
    return let(F.struct(*[said(r).alias(r) for r in _ORDER]), told)


def people(decisions: Column) -> Column:
    """Resolved persons of the name decisions that are masked. A name that is alone needs no resolution; only texts of several send them to Python."""
    names = F.filter(personal(decisions), lambda d: (d["type"] == "FULL_NAME") & (F.size(d["meta"]["name_parts"]) > 0))
    several = let(names, lambda n: F.slice(n, F.lit(1), F.when(F.size(n) > 1, F.size(n)).otherwise(0)))
    alone = let(names, lambda n: F.when(F.size(n) == 1, F.transform(n, _alone)))
    # marked so that the optimizer computes it once, in a projection of its own
    return F.coalesce(alone, F.udf(resolve, f"array<{PERSON}>", useArrow=True).asNondeterministic()(several))


def no_people() -> Column:
    return F.array().cast(f"array<{PERSON}>")


def identity_key(d: Column, persons: Column) -> Column:
    own = F.get(F.filter(persons, lambda p: p["start"] == d["start"]), F.lit(0))["key"]
    return F.coalesce(F.when(d["type"] == "FULL_NAME", own), d["meta"]["identity_key"], F.concat(d["type"], F.lit(":"), F.lower(F.trim(d["value"]))))


def numbered(keyed: Column) -> Column:
    """Structs with type and key, and entity_id after them: keys are numbered within their type's prefix, in order of first appearance. Each key is looked up
    in a map of the distinct ones, so that a text of thousands of entities is not gone through for each of them in an expression."""
    name = lambda prefix, key: F.concat_ws(" ", prefix, key)
    distinct = F.array_distinct(F.transform(keyed, lambda d: F.struct(token_prefix(d["type"]).alias("prefix"), d["key"].alias("key"))))

    def ids(u: Column) -> Column:
        of = lambda p: F.transform(F.filter(u, lambda x: x["prefix"] == p), lambda x, i: F.struct(name(p, x["key"]).alias("k"), F.concat(p, F.lit("_"), (i + 1).cast("string")).alias("v")))
        return F.map_from_entries(F.flatten(F.transform(F.array_distinct(F.transform(u, lambda x: x["prefix"])), of)))

    return let(let(distinct, ids), lambda known: F.transform(keyed, lambda d: d.withField("entity_id", F.try_element_at(known, name(token_prefix(d["type"]), d["key"])))))


def firsts(entities: Column) -> Column:
    """The first of each entity's occurrences, in order."""
    ids = F.transform(entities, lambda e: e["entity_id"])
    return let(ids, lambda x: F.filter(entities, lambda e, i: F.array_position(x, e["entity_id"]) == i + 1))


def grouped(entities: Column) -> Column:
    """Each entity's occurrences as an array of their own, in order of first appearance: sorted by entity, and cut where the next one begins."""
    ordered = F.array_sort(F.transform(entities, lambda e: F.struct(e["entity_id"].alias("id"), e["start"].alias("start"), e.alias("e"))))

    def cut(o: Column) -> Column:
        def groups(ids: Column) -> Column:
            def at(begin: Column) -> Column:
                end = lambda i: F.coalesce(F.get(begin, i + 1), F.size(o) + 1)
                return F.transform(begin, lambda b, i: F.slice(o, b, (end(i) - b).cast("int")))

            return let(F.transform(F.array_distinct(ids), lambda x: F.array_position(ids, x).cast("int")), at)

        return let(F.transform(o, lambda x: x["id"]), groups)

    by_start = F.array_sort(F.transform(let(ordered, cut), lambda g: F.struct(F.get(g, F.lit(0))["start"].alias("start"), g.alias("g"))))
    return F.transform(by_start, lambda x: F.transform(x["g"], lambda y: y["e"]))


def entity_ids(decisions: Column, persons: Column) -> Column:
    """array of struct(start, end, type, value, key, meta, entity_id) for the masked decisions."""
    keyed = F.transform(personal(decisions), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["type"].alias("type"), d["value"].alias("value"), identity_key(d, persons).alias("key"), d["meta"].alias("meta")))
    return F.when(F.size(keyed) > 0, let(keyed, numbered))


def mappings(entities: Column, persons: Column) -> Column:
    """One mapping for each entity, in order of appearance; without surrogates, which :mod:`synthesis` adds."""
    null = F.lit(None).cast("string")

    def told_by(e: Column, same: Column) -> Column:
        person = F.get(F.filter(persons, lambda p: p["start"] == e["start"]), F.lit(0))
        # what the first mention does not tell comes from the first that does
        told = lambda field: F.get(F.filter(F.transform(same, lambda o: o["meta"][field]), lambda x: x.isNotNull()), F.lit(0))
        gender = F.coalesce(person["gender"], told("gender"))
        nominal = F.concat_ws(" ", person["surname"], person["first"], person["patronymic"])
        nominal = F.coalesce(F.when(nominal != "", nominal), told("nominal_form"), e["value"])
        identity = F.when(person.isNotNull(), F.struct(person["surname"], person["first"], person["patronymic"], gender.alias("gender")))
        return F.struct(
            e["entity_id"].alias("entity_id"), e["type"].alias("type"), e["value"].alias("original"), F.concat(F.lit("<"), e["entity_id"], F.lit(">")).alias("token"), null.alias("synthetic"),
            partial_mask(e["type"], nominal).alias("partial"), nominal.alias("original_nominal"), null.alias("synthetic_nominal"), F.coalesce(told("gram_case"), F.lit("nomn")).alias("grammatical_case"),
            gender.alias("gender"), F.array_sort(F.array_distinct(F.transform(same, lambda o: o["value"]))).alias("aliases"), person["alias_types"].alias("alias_types"), identity.alias("original_identity"),
            F.lit(None).cast("struct<surname:string,first:string,patronymic:string,gender:string>").alias("synthetic_identity"), null.alias("synthetic_fallback"),
        ).cast(MAPPING)

    return F.coalesce(F.transform(grouped(entities), lambda same: told_by(F.get(same, F.lit(0)), same)), F.array().cast(f"array<{MAPPING}>"))
