import pytest

from larkspur.__main__ import main
from larkspur.sources import runs


def test_smoke(spark, tmp_path, capsys):
    out = f"file://{tmp_path}/smoke"
    assert main(["smoke", "--out", out], spark) == 0
    assert runs.list_runs(spark, f"{out}/evaluations") == ["1", "2"]
    cells = runs.read_json(spark, f"{out}/report/capability_cells.json")["rows"]
    assert {c["locale"] for c in cells} == {"en_US", "de_DE"} and any(c["state"] != "missing" for c in cells)
    fresh = runs.read_dataset(spark, f"{out}/evaluations", run="2").collect()
    assert len(fresh) == 6 and all("response_shape" in r.assistant_eval and "helpfulness" in r.assistant_eval for r in fresh)
    manifest = runs.read_json(spark, f"{out}/curated/run=1/profile=generous_v1.0/_selection_manifest.json")
    assert sum(manifest["total"].values()) == 6 and manifest["drop_reason"]["status"] == 1
    main(["runs", "--root", f"{out}/trajectories"], spark)
    assert capsys.readouterr().out.strip().endswith("1")


def test_bad_arguments(spark):
    with pytest.raises(SystemExit):
        main(["select"], spark)
