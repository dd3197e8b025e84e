"""What a reconciliation is told: one declarative definition, checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass, field

DIRECTIONS = ("push", "pull", "both")
ALIASES = {"->": "push", "<-": "pull", "<->": "both"}


class DefinitionError(ValueError):
    pass


@dataclass(frozen=True)
class FieldMap:
    local: str
    remote: str
    direction: str = "both"

    def __post_init__(self):
        object.__setattr__(self, "direction", ALIASES.get(self.direction, self.direction))
        if self.direction not in DIRECTIONS:
            raise DefinitionError(f"no direction: {self.direction}")

    def allows(self, direction: str) -> bool:
        return self.direction in ("both", direction) or direction == "both"


@dataclass(frozen=True)
class Identity:
    """The local id, where the local row keeps the remote id, the remote id, and where the remote row keeps the local id."""

    local_pk: str
    local_remote_id: str
    remote_id: str
    remote_link: str


@dataclass(frozen=True)
class Fallback:
    """What an unmapped value becomes: it is kept, or becomes a constant or null."""

    action: str = "keep"
    value: str | None = None

    def __post_init__(self):
        if self.action not in ("keep", "constant", "null"):
            raise DefinitionError(f"no fallback: {self.action}")
        if self.action == "constant" and self.value is None:
            raise DefinitionError("a constant fallback needs a value")


@dataclass(frozen=True)
class Definition:
    name: str
    direction: str
    mapping: tuple[FieldMap, ...]
    match_fields: tuple[str, ...] = ()
    identity: Identity | None = None
    match_mode: str = "first_match"
    value_map: dict[str, tuple[tuple[str | None, str | None], ...]] = field(default_factory=dict)
    fallbacks: dict[str, Fallback] = field(default_factory=dict)
    local_modified: str | None = None
    local_creation: str | None = None
    remote_modified: str | None = None
    remote_creation: str | None = None
    local_zone: str | None = None
    remote_zone: str | None = None
    datetime_fields: tuple[str, ...] = ()
    create_new: bool = True
    update_existing: bool = True
    delete_missing: bool = False
    delta: bool = True
    buffer_ms: int = 100
    policy: str = "newest_wins"
    tie_breaker: str = "manual"
    read_query: str | None = None
    id_strategy: str = "payload"
    sequence_start: int | None = None
    local_order: tuple[str, ...] = ()
    remote_order: tuple[str, ...] = ()
    #: By which a row of a side is written, where it has one; the identity's own ids by default.
    local_id: str | None = None
    remote_id: str | None = None

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("direction", ALIASES.get(self.direction, self.direction))
        if self.direction not in DIRECTIONS:
            raise DefinitionError(f"no direction: {self.direction}")
        if self.direction != "both":
            put("mapping", tuple(FieldMap(m.local, m.remote, self.direction) for m in self.mapping))
            put("tie_breaker", "manual")
        seen: set[str] = set()
        for m in self.mapping:
            if m.local in seen:
                raise DefinitionError(f"{m.local} is mapped twice")
            seen.add(m.local)
        for way in ("push", "pull"):
            names = [m.remote for m in self.mapping if m.direction in (way, "both")]
            if len(names) != len(set(names)):
                raise DefinitionError(f"a remote field is mapped twice for {way}")
        by_local = {m.local: m for m in self.mapping}
        if self.identity is None:
            if not self.match_fields:
                raise DefinitionError("match fields are required")
            ways = ("push", "pull") if self.direction == "both" else (self.direction,)
            for f in self.match_fields:
                if f not in by_local or not all(by_local[f].direction in (w, "both") for w in ways):
                    raise DefinitionError(f"match field {f} is not mapped for all directions")
        elif not all((self.identity.local_pk, self.identity.local_remote_id, self.identity.remote_id, self.identity.remote_link)):
            raise DefinitionError("all identity fields are required")
        if self.identity:
            put("local_id", self.local_id or self.identity.local_pk)
            put("remote_id", self.remote_id or self.identity.remote_id)
        if self.match_mode not in ("first_match", "all_matches"):
            raise DefinitionError(f"no match mode: {self.match_mode}")
        if self.delete_missing and self.read_query:
            raise DefinitionError("rows that are missing cannot be deleted with a read query")
        if self.direction == "both" and self.identity is None:
            put("delete_missing", False)
        if (self.direction == "both") and not (self.remote_modified and self.remote_creation):
            raise DefinitionError("remote modified and creation are required")
        stamps = [s for s in (self.remote_modified, self.remote_creation) if s]
        if len(stamps) == 2 and stamps[0] == stamps[1]:
            raise DefinitionError("modified and creation must differ")
        if set(stamps) & {m.remote for m in self.mapping}:
            raise DefinitionError("time stamps cannot be mapped")
        if self.id_strategy not in ("payload", "connector_default", "sequence", "max_plus_one"):
            raise DefinitionError(f"no id strategy: {self.id_strategy}")
        if (self.id_strategy == "sequence") != (self.sequence_start is not None):
            raise DefinitionError("a sequence, and it alone, has a start")
        for f, pairs in self.value_map.items():
            if f not in by_local:
                raise DefinitionError(f"{f} has a value map and no mapping")
            if len({p[0] for p in pairs}) != len(pairs):
                raise DefinitionError(f"{f} maps a value twice")

    def mapped(self, way: str) -> list[FieldMap]:
        return [m for m in self.mapping if m.direction in (way, "both")]

    @property
    def remote_keys(self) -> list[str]:
        by = {m.local: m.remote for m in self.mapping}
        return [by[f] for f in self.match_fields]

    def own_id(self, way: str) -> str | None:
        """The column by which rows of the target of a push or a pull are written."""
        return self.remote_id if way == "push" else self.local_id

    def target_keys(self, way: str) -> list[str]:
        return self.remote_keys if way == "push" else list(self.match_fields)

    def link(self, way: str) -> str | None:
        """The target's column that names the source row, if there are identities."""
        return (self.identity.remote_link if way == "push" else self.identity.local_remote_id) if self.identity else None

    def written(self, way: str) -> dict[str, str]:
        """Columns of the target that a push or a pull writes, and what changes call them."""
        out = {(m.remote if way == "push" else m.local): m.local for m in self.mapped(way)}
        return out | ({self.link(way): self.link(way)} if self.identity else {})

    def required(self, side: str) -> list[str]:
        """Columns that a plan reads of one side."""
        out = [m.local if side == "local" else m.remote for m in self.mapping]
        out += [self.local_modified, self.local_creation] if side == "local" else [self.remote_modified, self.remote_creation]
        if self.identity:
            out += [self.identity.local_pk, self.identity.local_remote_id] if side == "local" else [self.identity.remote_id, self.identity.remote_link]
        out += [self.local_id] if side == "local" else [self.remote_id]
        out += self.local_order if side == "local" else self.remote_order
        return list(dict.fromkeys(c.split(".")[0] for c in out if c))

    def fetch_keys(self) -> list[str]:
        return [self.identity.remote_id] if self.identity else self.remote_keys

    def diff_fields(self, child_tables: tuple[str, ...] = ()) -> list[str]:
        """For pulls: nested paths first, then plain fields; whole child tables are not compared."""
        names = [m.local for m in self.mapped("pull")]
        return [n for n in names if "." in n] + [n for n in names if "." not in n and n not in child_tables]
