from corpusmill import cli


def test_from_files_to_search(spark, tmp_path, capsys):
    src, data = tmp_path / "in", f"{tmp_path}/data"
    src.mkdir()
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    for i in range(3):
        (src / f"{i}.txt").write_text(" ".join(words[(i + j) % 10] for j in range(80)) + f" special{i}\n\n" + " ".join(words * 6) + f" tail{i}\n")
    (src / "m.py").write_text("def load(path):\n    return open(path).read()\n\n\ndef save(path):\n    return path + 'saved'\n")
    run = lambda *a: cli.main(["--data", data, *a])
    assert run("ingest", str(src)) == 0 and "4 new files" in capsys.readouterr().out
    run("ingest", str(src))
    assert "0 new files" in capsys.readouterr().out
    run("process")
    assert "'done': 2" in capsys.readouterr().out
    run("search", "special1", "--preset", "code")
    run("status")
    assert "'vectorized': 4" in capsys.readouterr().out
    run("export", f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() >= 5
    run("list", "--status", "vectorized")
    run("workflows")
    run("retry")
    run("gc", "--days", "-1")
    assert "2 runs deleted" in capsys.readouterr().out
