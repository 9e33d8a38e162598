"""The commands, over folders of a test and a local service."""

import json

import pytest

from tarifa import cli
from tarifa.plans import local_api
from tarifa.sources import config as G

ROWS = "sku_id,title,price\nS1,农夫山泉 水 550ml,2\n"


@pytest.fixture
def settings(tmp_path):
    """Writes a configuration and gives the function that runs a command with it."""
    (tmp_path / "in").mkdir()

    def run(command, *args, **ingest):
        whole = {"competitors": [{"key": "r", "name": "R"}], "ingest": {"inbox_dir": str(tmp_path / "in"), "archive_dir": str(tmp_path / "old"), **ingest}, "report": {"output_dir": str(tmp_path / "out"), "html_name": "p.html"}}
        (tmp_path / "c.json").write_text(json.dumps(whole), encoding="utf-8")
        return cli.main(["-c", str(tmp_path / "c.json"), command, *args])

    return run


def test_fetch_chooses_sources(settings, tmp_path, capsys):
    base = local_api.serve([{"id": k, "name": f"n{k}", "pricing": {"now": [k]}} for k in range(3)])
    one = {"platform": "r", "url": f"{base}/page", "method": "post", "pagination": {"type": "page", "in": "body", "limit_param": "size", "page_size": 9}, "field_map": {"sku_id": "id", "title": "name"}}
    sources = [{**one, "name": "on", "enabled": True}, {**one, "name": "off", "platform": "unknown"}, {**one, "name": "bad", "url": f"{base}/nothing", "retries": 0}]
    landed = lambda: sorted(p.name.split("_cloud-")[0] + ":" + p.name.split("_cloud-")[1].split("_")[0] for p in (tmp_path / "in").iterdir())
    assert settings("fetch", cloud=sources) == 0 and landed() == ["r:on"] and "on: 3" in capsys.readouterr().out
    assert settings("fetch", "--source", "off", cloud=sources) == 0 and landed() == ["r:on", "unknown:off"]
    assert settings("fetch", "--source", "bad", cloud=sources) == 1 and len(landed()) == 2
    assert settings("fetch", "--source", "none", cloud=sources) == 1 and "'on', 'off', 'bad'" in capsys.readouterr().err
    assert settings("fetch", cloud=sources[1:]) == 0 and "no source is enabled" in capsys.readouterr().err


def test_compare_goes_on_when_a_source_fails(spark, settings, tmp_path, capsys):
    (tmp_path / "in/self_1.csv").write_text(ROWS, encoding="utf-8")
    bad = [{"name": "bad", "platform": "r", "url": "http://127.0.0.1:9/", "retries": 0, "enabled": True}]
    assert settings("compare", "--fetch", cloud=bad) == 1 and "no rival products" in capsys.readouterr().err
    assert settings("compare") == 1 and "no own products" in capsys.readouterr().err
    assert not (tmp_path / "out").exists()


def test_demo_takes_the_samples(spark, settings, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert settings("demo") == 1 and "no samples" in capsys.readouterr().err
    samples = tmp_path / "data/samples"
    samples.mkdir(parents=True)
    (samples / "self_1.csv").write_text(ROWS, encoding="utf-8")
    (samples / "r_1.csv").write_text("sku_id,title,price\nR1,农夫山泉 水 550ml,1\n", encoding="utf-8")
    assert settings("demo") == 0 and "1 个产出有效价差" in capsys.readouterr().out
    assert (tmp_path / "out/p.html").exists() and (tmp_path / "out/p_rows/000000.js").exists() and len(list(samples.iterdir())) == 2


def test_trigger_and_serve(settings, monkeypatch, capsys):
    from tarifa.sources import receiver, robots

    monkeypatch.delenv("YINGDAO_ACCESS_KEY_ID", raising=False)
    monkeypatch.delenv("YINGDAO_ACCESS_KEY_SECRET", raising=False)
    assert settings("trigger") == 1 and "no robot" in capsys.readouterr().err
    assert settings("trigger", "--robot", "x") == 1  # without an account
    monkeypatch.setattr(robots, "run", lambda service, job, **wait: {"robot": job.robot, **wait})
    account = {"access_key_id": "a", "access_key_secret": "b", "poll_interval_sec": 3}
    assert settings("trigger", "--robot", "x", yingdao=account) == 0 and "{'robot': 'x', 'interval': 3, 'timeout': 1800}" in capsys.readouterr().out
    served = []
    monkeypatch.setattr(receiver, "serve", lambda *where: served.append(where[1:]))
    assert settings("serve", "--port", "99", http={"token": "t", "port": 7}) == 0 and served == [("127.0.0.1", 99, "t")]


def test_configuration(tmp_path, capsys):
    assert cli.main(["-c", str(tmp_path / "none.yaml"), "collect"]) == 1 and "none.yaml" in capsys.readouterr().err
    (tmp_path / "c.yaml").write_text("ingest:\n  inbox_dir: x\n", encoding="utf-8")
    assert G.load_config(str(tmp_path / "c.yaml")) == {"ingest": {"inbox_dir": "x"}}
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
