import pytest

from timbrel import config
from timbrel.__main__ import main


def test_usage(tmp_path, monkeypatch):
    log = tmp_path / "x.log"
    log.write_text("a\n")
    assert main([str(tmp_path / "none.log")]) == 2
    assert main([str(log), "--format", "nope"]) == 1
    assert main([str(log), "--last", "soon"]) == 1
    monkeypatch.setattr("sys.stdin.isatty", lambda: True, raising=False)
    assert main([]) == 1


def test_settings_are_strict(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("[analysis]\nwindow_size_minutes = 7\n")
    assert config.load(str(path)).analysis.window_size_minutes == 7
    for bad in ("[analysis]\nwindow = 7\n", "[other]\nx = 1\n", "[analysis]\nspike_factor = 0\n"):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load(str(path))


@pytest.fixture
def settings(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text(f'[state]\npath = "{tmp_path}/state"\n[analysis]\nburst_multiplier = 2.0\n')
    return str(path)


def access(minute, status, n):
    return "".join(f'10.0.0.{i % 9} - - [01/May/2024:10:{minute:02d}:{i % 60:02d} +0200] "GET /{i} HTTP/1.1" {status} 12 "-" "curl"\n' for i in range(n))


def test_whole_runs_keep_baselines_and_history(spark, tmp_path, settings, capsys, monkeypatch):
    import io
    import json
    import sys

    from timbrel.plans import state

    log = tmp_path / "access.log"
    log.write_text(access(0, 200, 50) + access(30, 500, 2) + "\x0codd line\n")
    assert main([str(log), "--config", settings, "--json"]) == 0
    row = json.loads(capsys.readouterr().out)
    assert (row["level"], row["parser_format"], row["parsed_count"], row["skipped_count"]) == ("CLEAN", "nginx-access", 52, 1)
    # Far more errors an hour than the baseline: a spike.
    log.write_text(access(0, 200, 50) + access(30, 500, 12))
    assert main([str(log), "--config", settings, "-v"]) == 3
    shown = capsys.readouterr()
    assert "Error rate spike vs baseline" in shown.out and "62 events" in shown.out and "nginx-access" in shown.err
    assert main([str(log), "--config", settings, "--no-baseline"]) == 3
    assert "Error burst" in capsys.readouterr().out
    store = state.Store(spark, str(tmp_path / "state"))
    assert store.baselines().first()["sample_count"] == 3
    runs = state.recent(store.runs()).orderBy("ran_at").collect()
    assert [(r["incident_level"], r["parsed_count"], r["signal_count"]) for r in runs] == [("CLEAN", 52, 0), ("WARNING", 62, 1), ("WARNING", 62, 1)]
    text = "May  1 10:00:00 web kernel: Out of memory: Killed process 7\n" * 3
    monkeypatch.setattr(sys, "stdin", io.TextIOWrapper(io.BytesIO(text.encode())))
    assert main(["--config", settings]) == 4
    assert "<stdin>" in capsys.readouterr().out


def test_cut_archives(tmp_path, settings, capsys):
    import gzip

    whole = gzip.compress(access(0, 500, 400).encode())
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    assert main([str(tmp_path / "cut.gz"), "--config", settings, "--no-baseline"]) in (0, 3)
    assert "recovered" in capsys.readouterr().err
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8b\x08\x00garbage")
    assert main([str(tmp_path / "broken.gz"), "--config", settings]) == 2


def test_version_and_bad_values(tmp_path, capsys):
    assert main(["--version"]) == 0 and "timbrel v" in capsys.readouterr().out
    (tmp_path / "a.log").write_text("x\n")
    assert main([str(tmp_path / "a.log"), "--threshold", "2"]) == 1
    (tmp_path / "c.toml").write_text("[output]\ncolor = 3\n")
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "c.toml"))


def test_states_of_other_versions_are_refused(spark, tmp_path):
    from timbrel.plans import state

    (tmp_path / "state" / "schema-9").mkdir(parents=True)
    with pytest.raises(state.StateError):
        state.Store(spark, str(tmp_path / "state"))
