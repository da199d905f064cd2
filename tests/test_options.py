import json

import pytest

from sieveline import Options
from sieveline.errors import OptionsError


def test_defaults():
    options = Options()
    assert options.missing_values.drop_column_threshold == 0.8
    assert options.type_inference.min_numeric_ratio == 0.95
    assert len(options.suspicious_values.sentinel_values) == 10
    assert options.outliers.action == "flag"


def test_merge_keeps_other_keys_and_last_wins():
    options = Options().merge({"outliers": {"method": "both", "action": "cap"}}, {"outliers": {"action": "drop"}})
    assert (options.outliers.method, options.outliers.action, options.outliers.iqr_multiplier) == ("both", "drop", 1.5)


def test_file_then_overrides(tmp_path):
    path = tmp_path / "options.json"
    path.write_text(json.dumps({"duplicates": {"keep": "last"}, "cardinality": {"near_constant_threshold": 0.9}}))
    options = Options.load(str(path), {"duplicates": {"keep": "none"}})
    assert options.duplicates.keep == "none" and options.cardinality.near_constant_threshold == 0.9


def test_round_trip():
    options = Options().merge({"suspicious_values": {"sentinel_values": [-7, 7]}})
    assert Options.from_dict(json.loads(json.dumps(options.to_dict()))) == options


@pytest.mark.parametrize("values", [
    {"outliers": {"action": "explode"}}, {"outliers": {"iqr_multiplier": 0}}, {"outliers": {"unknown": 1}}, {"nothing": {}},
    {"missing_values": {"drop_row_threshold": 1.5}}, {"missing_values": {"numeric_imputation": "guess"}},
    {"duplicates": {"keep": "some"}}, {"dataset": {"max_rows_for_analysis": 5}}, {"outliers": 3},
])
def test_bad_options(values):
    with pytest.raises(OptionsError):
        Options.from_dict(values)


def test_unreadable_files(tmp_path):
    with pytest.raises(OptionsError):
        Options.load(str(tmp_path / "none.json"))
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(OptionsError):
        Options.load(str(tmp_path / "bad.json"))
