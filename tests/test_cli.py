"""The command line over a small file."""

from coterie import __main__ as cli
from coterie.operators import report


def test_mines_a_file(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("1 2 5\n2 4\n2 3\n1 2 4\n1 3\n2 3\n1 3\n1 2 3 5\n1 2 3\n")
    assert cli.main([str(tmp_path / "in.txt"), "2", str(tmp_path / "out")]) == 0
    assert capsys.readouterr().out.split() == ["13", "5", "6", "2"]
    assert report.read_lines(spark, str(tmp_path / "out")).count() == 14
    assert cli.main([str(tmp_path / "in.txt"), "0"]) == 1 and cli.main([]) == 1
    for mode, counts in (("closed", ["9", "3", "4", "2"]), ("maximal", ["3", "0", "1", "2"])):
        assert cli.main(["--mode", mode, str(tmp_path / "in.txt"), "2", str(tmp_path / mode)]) == 0
        assert capsys.readouterr().out.split() == counts
        assert report.read_lines(spark, str(tmp_path / mode)).where("len > 0").count() == int(counts[0])
    assert cli.main([str(tmp_path / "in.txt"), "2", "--mode", "other"]) == 1 and cli.main([str(tmp_path / "in.txt"), "2", "--mode"]) == 1
