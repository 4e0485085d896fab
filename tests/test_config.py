"""Back-end profiles and configuration validation."""

import pytest

from lookout import SearchConfig

BASE = dict(search_column="name", tie_break="id")


@pytest.mark.parametrize(
    "profile, policy, backslash, mode, extra",
    [
        (None, "skip_falsy", "escape", "top_k", {}),
        ("postgres", "coalesce_sep", "escape", "top_k", {}),
        ("mssql", "concat_all", "literal", "top_k", {}),
        ("oracle", "coalesce_sep", "literal", "any_n", {"empty_is_null": True}),
        ("gpkg", "skip_falsy", "escape", "unordered", {"drop_zero": True}),
    ],
)
def test_profiles(profile, policy, backslash, mode, extra):
    cfg = SearchConfig.for_profile(profile, **BASE)
    assert (cfg.policy, cfg.backslash, cfg.limit_mode) == (policy, backslash, mode)
    for key, value in extra.items():
        assert getattr(cfg, key) == value
    assert cfg.limit == 1000 and cfg.echo_search_column and not cfg.escape_spec_chars and cfg.min_length == 3


def test_profile_values_can_be_overridden():
    cfg = SearchConfig.for_profile("oracle", **BASE, limit_mode="top_k", empty_is_null=False)
    assert cfg.limit_mode == "top_k" and not cfg.empty_is_null


@pytest.mark.parametrize(
    "bad",
    [
        dict(policy="fancy"),
        dict(limit_mode="random"),
        dict(data_type="shapefile"),
        dict(on_missing_extra="ignore"),
        dict(search_column=""),
        dict(tie_break=()),
    ],
)
def test_invalid_configs(bad):
    with pytest.raises(ValueError):
        SearchConfig(**{**BASE, **bad})


def test_unknown_profile():
    with pytest.raises(ValueError):
        SearchConfig.for_profile("sqlite", **BASE)


def test_stored_text_is_typed():
    row = {"search_column": "name", "tie_break": "id", "echo_search_column": "false", "escape_spec_chars": "True", "srid": "4326", "limit_results": "12"}
    cfg = SearchConfig.from_mapping(row)
    assert cfg.echo_search_column is False and cfg.escape_spec_chars is True and cfg.srid == 4326 and cfg.limit == "12"
    with pytest.raises(ValueError, match="tie_break"):
        SearchConfig.from_mapping({"search_column": "name"})
    with pytest.raises(ValueError, match="boolean"):
        SearchConfig.from_mapping({**row, "echo_search_column": "perhaps"})
