from codeloom import __version__, cli


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "t/.git").mkdir(parents=True)
    (tmp_path / "t/a.py").write_text("def alpha():\n    beta()\n\ndef beta():\n    pass\n")

    def run(*args):
        code = cli.main(["--root", str(tmp_path / "t"), "--store", str(tmp_path / "g"), "--registry", str(tmp_path / "r.json"), *args], spark)
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("version") == (0, [__version__])
    assert "files=1" in run("build")[1][0]
    assert run("status")[1][0].split("\t")[0] == "3"
    assert run("search", "alpha")[1][0].endswith("a.py::alpha")
    assert run("visualize", "--out", str(tmp_path / "g.html"))[0] == 0 and (tmp_path / "g.html").exists()
    assert run("postprocess") == (0, ["0"])
    assert run("register", str(tmp_path / "t"), "--alias", "one") == run("repos") == (0, [f"{tmp_path / 't'}\tone"])
    assert run("unregister", "one") == (0, []) and run("unregister", "one")[0] == 1
