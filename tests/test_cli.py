import json

from loomseek import cli
from loomseek.sources import bundle


def test_build_and_search(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(0, "alpha", [1.0, 0.0]), (1, "beta", [0.0, 1.0])], "token_id int, token string, v array<float>")
    bundle.write_model(str(tmp_path / "m"), rows, "m")
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"id": i, "title": t, "href": f"/{i}", "text": x}) for i, t, x in (("a", "One alpha", "Some alpha words."), ("b", "Two beta", "Other beta words."))))
    cli.main(["build", str(tmp_path / "c.jsonl"), str(tmp_path / "m"), str(tmp_path / "ix"), "--bundle", str(tmp_path / "b")])
    assert bundle.read_bundle(str(tmp_path / "b")).docs.tolist() == [[127, 0], [0, 127]]
    cli.main(["search", str(tmp_path / "ix"), "beta", "--mode", "hybrid", "--limit", "1"])
    assert "## Result 1: Two beta" in capsys.readouterr().out
    cli.main(["export-model", str(tmp_path / "m"), str(tmp_path / "e"), "--dims", "1"])
    assert bundle.read_model(spark, str(tmp_path / "e")).orderBy("token_id").head().v == [127]
