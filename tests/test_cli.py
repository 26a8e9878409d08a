import json

from chanlake import cli


def lines(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_commands(spark, sf, tmp_path, capsys):
    run = lambda *a: (capsys.readouterr(), cli.main([*map(str, a)], spark))
    messages, log = f"{sf}/messages.parquet", f"{sf}/observations.parquet"
    run("stats", messages)
    stats = lines(capsys)
    assert stats and stats[0]["messages"] > 0
    run("filter", messages, "--keyword", "archive", "--min-views", "5", "--mode", "all", "--output", tmp_path / "f.json")
    got = lines(capsys)
    assert got[0]["matched"] == len(json.loads((tmp_path / "f.json").read_text()))
    (tmp_path / "k.txt").write_text("# c\narchive\n/bri.ge/\n")
    run("filter", messages, "--keywords-file", tmp_path / "k.txt")
    assert lines(capsys)[0]["checked"] > 0
    run("gaps", messages)
    run("bias", log)
    m = lines(capsys)
    run("statement", log, m[0]["channel_id"], "--name", "x")
    assert "channel 'x'" in capsys.readouterr().out
    run("report", log, tmp_path / "r.json", m[0]["channel_id"])
    assert json.loads((tmp_path / "r.json").read_text())["channel"]["id"] == m[0]["channel_id"]
    seed = stats[0]["channel_id"]
    for kind in ("graphml", "gexf", "json"):
        run("discover", messages, seed, "--depth", 2, "--min-forwards", 1, "--channels", f"{sf}/channels.parquet", "--output", tmp_path / f"g.{kind}")
        assert str(seed) in (tmp_path / f"g.{kind}").read_text()
    run("discover", messages, seed)
    assert seed in {r["channel_id"] for r in lines(capsys)}
    run("export", messages, tmp_path / "e", "--format", "parquet")
    assert spark.read.parquet(str(tmp_path / "e")).count() == sum(r["messages"] for r in stats)
    (tmp_path / "p.txt").write_text("1.2.3.4:80\n")
    run("proxies", tmp_path / "p.txt")
    assert lines(capsys)[0]["host"] == "1.2.3.4"
