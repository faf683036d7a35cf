"""Row filters, column masks, restrictions and grants, applied as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.tokens import literal


#: Around the name of a session value in a policy's text; put in when the policy is applied.
MARK = "\ue010"


def _bound(text: str, user: str, roles: set[str]) -> str:
    """A policy's text for a user: a marked name stands alone in a literal, so its value is one too."""
    for name, value in (("CURRENT_USER", user), ("CURRENT_AVAILABLE_ROLES", ",".join(sorted(roles)))):
        text = text.replace(f"'{MARK}{name}{MARK}'", literal(value.replace(MARK, "")))
    return text


def partial_mask(c: Column, first: int = 0, last: int = 0, upper: str = "X", lower: str = "x", digit: str = "n") -> Column:
    """Keeps the first and last characters; capitals, other letters and numerals become signs; Unicode-aware."""
    plain = {"upper": upper, "lower": lower, "digit": digit}
    safe = {k: v.replace("\\", "\\\\").replace("$", "\\$") for k, v in plain.items()}
    head, tail = F.substring(c, F.lit(1), F.lit(first)), F.substring(c, F.greatest(F.length(c) - last + 1, F.lit(first + 1)), F.lit(last)) if last else F.lit("")
    middle = F.substring(c, F.lit(first + 1), F.greatest(F.length(c) - first - last, F.lit(0)))
    # numerals first, then letters through marks that no text holds, so signs are not masked again
    for kind, mark in ((r"\p{Lu}", "\ue000"), (r"\p{L}", "\ue001"), (r"\p{N}", "\ue002")):
        middle = F.regexp_replace(middle, kind, mark)
    for mark, sign in (("\ue000", "upper"), ("\ue001", "lower"), ("\ue002", "digit")):
        middle = F.regexp_replace(middle, mark, safe[sign])
    return F.concat(head, middle, tail)


def masked(c: Column, kind: T.DataType, mask: dict) -> Column:
    """The masked column, always of the column's own type."""
    how = mask["mask"].lower()
    if how == "nullify":
        return F.lit(None).cast(kind)
    if how == "redact":
        return F.lit(mask.get("value", "***")).try_cast(kind) if not isinstance(kind, T.StringType) else F.lit(mask.get("value", "***"))
    if how == "hash":
        digest = F.call_function("lakeloom_hmac_sha256", c.cast("string"), F.lit(mask["key"])) if mask.get("key") else F.sha2(c.cast("string").cast("binary"), 256)
        return digest if isinstance(kind, T.StringType) else digest.try_cast(kind)
    if how == "custom":
        return F.expr(mask["expr"]).cast(kind)
    if how == "partial":
        if not isinstance(kind, T.StringType):
            return F.lit(None).cast(kind)
        return partial_mask(c, **{k: v for k, v in mask.items() if k in ("first", "last", "upper", "lower", "digit")})
    if how == "date_show_year":
        return F.date_trunc("year", c).cast(kind) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(None).cast(kind)
    raise ValueError(f"unknown mask {how}")


@dataclass
class Policies:
    """Policies by table.

    A policy holds for all but the users and roles in its ``except``, or, if it
    has ``only``, for just the users and roles named there.
    """

    filters: list[dict] = field(default_factory=list)
    masks: list[dict] = field(default_factory=list)
    restricted: list[dict] = field(default_factory=list)
    tags: dict[tuple[str, str], list[str]] = field(default_factory=dict)
    tag_masks: list[dict] = field(default_factory=list)
    grants: list[dict] = field(default_factory=list)
    members: dict[str, set[str]] = field(default_factory=dict)
    #: Of the warehouse's policies, the version that these are.
    version: int = field(default=-1, repr=False, compare=False)

    def dump(self) -> dict:
        """As JSON values."""
        return {"filters": self.filters, "masks": self.masks, "restricted": self.restricted, "tag_masks": self.tag_masks, "grants": self.grants, "tags": [[*k, v] for k, v in self.tags.items()], "members": {k: sorted(v) for k, v in self.members.items()}}

    @classmethod
    def load(cls, kept: dict | None) -> Policies:
        if not kept:
            return cls()
        return cls(**kept | {"tags": {(t, c): v for t, c, v in kept["tags"]}, "members": {k: set(v) for k, v in kept["members"].items()}})

    @staticmethod
    def _holds(policy: dict, user: str, roles: set[str]) -> bool:
        who = {user, *roles}
        if policy.get("only") is not None:
            return bool(who & set(policy["only"]))
        return not who & set(policy.get("except", ()))

    def row_filter(self, table: str, user: str, roles: set[str]) -> str | None:
        found = [f"({_bound(p['where'], user, roles)})" for p in self.filters if p["table"] == table and self._holds(p, user, roles)]
        return " AND ".join(found) or None

    def mask_of(self, table: str, column: str, user: str, roles: set[str]) -> dict | None:
        """The column's own mask, else that of its first tag with one."""
        for p in self.masks:
            if p["table"] == table and p["column"].lower() == column.lower() and self._holds(p, user, roles):
                return p | ({"expr": _bound(p["expr"], user, roles)} if "expr" in p else {})
        for tag in self.tags.get((table, column.lower()), []):
            for p in self.tag_masks:
                if p["tag"] == tag and self._holds(p, user, roles):
                    return p | ({"expr": _bound(p["expr"], user, roles)} if "expr" in p else {})
        return None

    def covers(self, table: str, column: str, user: str, roles: set[str]) -> bool:
        """Whether a user sees something else than the column as it is stored."""
        return self.mask_of(table, column, user, roles) is not None or any(p["table"] == table and p["column"].lower() == column.lower() and self._holds(p, user, roles) for p in self.restricted)

    def named(self, name: str) -> list[dict]:
        return [p for kind in ("filters", "masks", "tag_masks") for p in getattr(self, kind) if p.get("name") == name]

    def governed(self, df: DataFrame, table: str, user: str, roles: set[str]) -> DataFrame:
        """Filter directly above the scan (it may use hidden columns), then masks; restricted columns are NULLs of their type.  A policy that fails denies all rows."""
        try:
            where = self.row_filter(table, user, roles)
            out = df.filter(where) if where else df
            hidden = {p["column"].lower() for p in self.restricted if p["table"] == table and self._holds(p, user, roles)}
            cols = []
            for f in df.schema.fields:
                c, mask = F.col(f"`{f.name}`"), self.mask_of(table, f.name, user, roles)
                cols.append((F.lit(None).cast(f.dataType) if f.name.lower() in hidden else masked(c, f.dataType, mask) if mask else c).alias(f.name))
            out = out.select(*cols)
            out.schema  # noqa: B018  analysed here, so a broken policy shows
            return out
        except Exception:
            return df.filter(F.lit(False))

    def grant(self, privilege: str, table: str, to: str, effect: str = "allow") -> None:
        self.revoke(privilege, table, to)
        self.grants.append({"privilege": privilege.upper(), "table": table, "to": to, "effect": effect})

    def revoke(self, privilege: str, table: str, to: str) -> None:
        self.grants = [g for g in self.grants if (g["privilege"], g["table"], g["to"]) != (privilege.upper(), table, to)]

    def drop(self, name: str) -> bool:
        """Removes the policies of a name; whether there were any."""
        found = bool(self.named(name))
        for kind in ("filters", "masks", "tag_masks"):
            setattr(self, kind, [p for p in getattr(self, kind) if p.get("name") != name])
        return found

    def effective(self, user: str, roles: set[str]) -> list[tuple[str, str, str, str | None, str | None]]:
        """Table, privilege, grantee, row filter and masks that a user's queries get."""
        out = []
        for g in self.grants:
            if g["to"] in {user, *roles, "PUBLIC"} and g["effect"] == "allow":
                masks = [f"{p['column']} -> {p.get('expr', p['mask'])}" for p in self.masks if p["table"] == g["table"] and self._holds(p, user, roles)]
                out.append((g["table"], g["privilege"], g["to"], self.row_filter(g["table"], user, roles), ", ".join(masks) or None))
        return out

    def allowed(self, privilege: str, table: str, user: str, roles: set[str]) -> bool:
        """Denials win; a table without grants is open.  ALL is every privilege but MANAGE."""
        mine = [g for g in self.grants if g["table"] in (table, "*") and g["privilege"] in (privilege.upper(), "ALL") and g["to"] in {user, *roles, "PUBLIC"}]
        if any(g["effect"] == "deny" for g in mine):
            return False
        return bool(mine) or not any(g["table"] == table and g["effect"] == "allow" for g in self.grants)
