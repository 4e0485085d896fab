"""Search configuration (SURVEY §1 "Configuration").

One ``SearchConfig`` describes one searchable relation and how hits are shaped.
``profile`` presets reproduce a back end of the reference:

=============  =============  ==========  ===========  ============
profile        suggestion     backslash   case         limit mode
=============  =============  ==========  ===========  ============
``None``       skip_falsy     escape      insensitive  top_k
``postgres``   coalesce_sep   escape      insensitive  top_k
``mssql``      concat_all     literal     insensitive  top_k
``oracle``     coalesce_sep   literal     insensitive  any_n
``gpkg``       skip_falsy     escape      insensitive  unordered
=============  =============  ==========  ===========  ============
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping
from dataclasses import dataclass, field

from .functions.suggest import POLICIES, parse_display_columns

DATA_TYPES = ("parquet", "table", "dataframe", "jdbc", "postgres", "mssql", "oracle", "gpkg")
LIMIT_MODES = ("top_k", "any_n", "unordered")

# Keys of a stored settings row that differ from the field names.
SETTINGS_KEYS = {"limit_results": "limit", "file": "path"}
# How a stored settings row spells booleans.
_TRUE, _FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off", "")

_PROFILES: dict[str, dict] = {
    "postgres": dict(policy="coalesce_sep", backslash="escape", limit_mode="top_k"),
    "mssql": dict(policy="concat_all", backslash="literal", limit_mode="top_k"),
    "oracle": dict(policy="coalesce_sep", backslash="literal", limit_mode="any_n", empty_is_null=True),
    "gpkg": dict(policy="skip_falsy", backslash="escape", limit_mode="unordered", drop_zero=True),
}


def _typed(name: str, kind: object, value: object) -> object:
    """A stored text as the field's type; other values as they are."""
    if not isinstance(value, str):
        return value
    text = value.strip()
    if kind in (bool, "bool"):
        if text.lower() not in (*_TRUE, *_FALSE):
            raise ValueError(f"setting {name}: {value!r} is not a boolean")
        return text.lower() in _TRUE
    if kind in (int, "int"):
        return int(text)
    if name == "srid" and text.lstrip("-").isdigit():
        return int(text)
    return value


def _tuple(value) -> tuple[str, ...]:
    if value is None:
        return ()
    if isinstance(value, str):
        return tuple(parse_display_columns(value))
    return tuple(value)


@dataclass(frozen=True)
class SearchConfig:
    """What to search and how to shape hits.

    ``tie_break`` is required (DEC-4): the search column alone leaves ties in
    undefined order, so every top-k needs a unique key after it.
    """

    search_column: str
    tie_break: tuple[str, ...]
    display_columns: tuple[str, ...] = ()
    geom_column: str | None = None
    srid: int | str | None = None
    authid_column: str | None = None
    echo_search_column: bool = True
    escape_spec_chars: bool = False
    backslash: str = "escape"
    case_sensitive: bool = False
    accent_sensitive: bool = True
    collation: str | None = None
    policy: str = "skip_falsy"
    drop_zero: bool = False
    empty_is_null: bool = False
    truncate30: bool = False
    limit: int | str | None = 1000
    limit_mode: str = "top_k"
    min_length: int = 3
    extra_columns: tuple[str, ...] = ()
    on_missing_extra: str = "error"
    scale_expr: str | None = None
    bbox_expr: str | None = None
    name: str = ""
    data_type: str = "dataframe"
    path: str | None = None
    schema: str | None = None
    table: str | None = None
    layer: str | None = None
    connection: Mapping[str, object] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "tie_break", _tuple(self.tie_break))
        object.__setattr__(self, "display_columns", _tuple(self.display_columns))
        object.__setattr__(self, "extra_columns", _tuple(self.extra_columns))
        if not self.search_column:
            raise ValueError("search_column is required")
        if not self.tie_break:
            raise ValueError("tie_break is required: name a unique key (DEC-4)")
        if self.policy not in POLICIES:
            raise ValueError(f"policy must be one of {POLICIES}")
        if self.limit_mode not in LIMIT_MODES:
            raise ValueError(f"limit_mode must be one of {LIMIT_MODES}")
        if self.data_type not in DATA_TYPES:
            raise ValueError(f"unknown data_type {self.data_type!r} (DEC-5)")
        if self.on_missing_extra not in ("error", "empty"):
            raise ValueError("on_missing_extra must be 'error' or 'empty'")

    @classmethod
    def for_profile(cls, profile: str | None, **kwargs) -> SearchConfig:
        """Config preset for one of the reference's back ends (see module doc)."""
        if profile is None:
            return cls(**kwargs)
        if profile not in _PROFILES:
            raise ValueError(f"unknown profile {profile!r}")
        merged = dict(_PROFILES[profile])
        merged.update(kwargs)
        return cls(**merged)

    @classmethod
    def from_mapping(cls, row: Mapping[str, object]) -> SearchConfig:
        """Build from a settings-like mapping or a DataFrame ``Row.asDict()``.

        Accepts the reference's key names (``echo_search_column``,
        ``display_columns`` as a comma list, ``limit_results``...).  Stored
        text is read by the field's type: booleans, whole numbers.
        """
        known = {f.name: f.type for f in dataclasses.fields(cls)}
        kwargs = {}
        for key, value in dict(row).items():
            if value is None:
                continue
            key = SETTINGS_KEYS.get(key, key)
            if key in known:
                kwargs[key] = _typed(key, known[key], value)
        for key in ("search_column", "tie_break"):
            if not kwargs.get(key):
                raise ValueError(f"settings row needs {key}" + (": name a unique key (DEC-4)" if key == "tie_break" else ""))
        profile = kwargs.get("data_type") if kwargs.get("data_type") in _PROFILES else None
        return cls.for_profile(profile, **kwargs)

    def replace(self, **changes) -> SearchConfig:
        return dataclasses.replace(self, **changes)

    @property
    def required_columns(self) -> list[str]:
        cols = [self.search_column, *self.tie_break, *self.display_columns]
        if self.geom_column:
            cols.append(self.geom_column)
        if isinstance(self.srid, str):
            cols.append(self.srid)
        if self.authid_column:
            cols.append(self.authid_column)
        return cols
