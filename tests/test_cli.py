from millrace import cli
from millrace.plans.pipeline import Pipeline


def test_commands(spark, data, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    src = str(tmp_path / "src")
    assert cli.main(["generate", "--source", src, "--count", "200", "--fault-rate", "0.05"]) == 0
    assert spark.read.parquet(f"{src}/pos.transactions").count() >= 200
    assert cli.main(["generate", "--count", "50", "--dry-run"]) == 0
    assert cli.main(["warehouse", "--tables", data, "--warehouse", str(tmp_path / "wh"), "--batch", "0", "--now", "2026-04-21 00:00:00"]) == 0
    assert Pipeline(spark, str(tmp_path / "wh")).upto == 0
    assert "loaded" in capsys.readouterr().out


def test_ingest_then_inspect_and_redrive(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    monkeypatch.setattr(cli, "until_stopped", lambda s: [q.awaitTermination() for q in s.streams.active])
    src, zone, check = (str(tmp_path / x) for x in ("src", "zone", "check"))
    cli.main(["generate", "--source", src, "--count", "100", "--fault-rate", "0.1"])
    cli.main(["ingest", "--source", src, "--landing", zone, "--checkpoints", check, "--once", "--datasets", "pos_transactions"])
    landed = spark.read.option("recursiveFileLookup", "true").parquet(f"{zone}/pos_transactions").count()
    assert 0 < landed < spark.read.parquet(f"{src}/pos.transactions").count()
    assert cli.main(["dlq", "--source", src, "inspect"]) == 0
    assert cli.main(["dlq", "--source", src, "redrive", "--error-code", "POS-003"]) == 0
    assert not spark.read.parquet(f"{src}/pos.transactions.retry").isEmpty()
    cli.main(["load", "--landing", zone, "--raw", str(tmp_path / "raw"), "--archive", str(tmp_path / "kept"), "--now", "2026-04-21 00:00:00"])
    assert spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "raw" / "pos_transactions")).count() == landed
