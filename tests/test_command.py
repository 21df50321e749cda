"""The command line, from a text file to a text result."""

import pytest

from corpusloom.__main__ import main, parser
from corpusloom.sources import embeddings


def test_options(capsys):
    a = parser().parse_args(["-i", "x", "-o", "y"])
    assert (a.dimensions, a.window_size, a.epochs, a.learning_rate, a.min_learning_rate, a.negative_samples, a.min_count) == (100, 3, 10, 0.1, 0.0001, 5, 5)
    for option in ("--window-size", "--epochs", "--learning-rate", "--min-count", "--negative-samples", "--min-learning-rate"):
        with pytest.raises(SystemExit):
            parser().parse_args(["-i", "x", "-o", "y", option, "0"])
    assert "greater than zero" in capsys.readouterr().err


@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_train_and_write(spark, tmp_path, scope):
    (tmp_path / "c.txt").write_text("Ein Satz mit Wörtern\n" * 20 + "Noch ein Satz\n" * 20)
    main(["-i", str(tmp_path / "c.txt"), "-o", str(tmp_path / "out"), "-d", "4", "-e", "1", "--owners", "2", "--sample", "10", "-n", "2", "--scope", scope, "--single-file"])
    rows = embeddings.read_text(spark, str(tmp_path / "out")).collect()
    assert {r["word"] for r in rows} == {"ein", "satz", "mit", "wörtern", "noch"} and all(len(r["in_w"]) == 4 for r in rows)


def test_missing_input(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        main(["-i", str(tmp_path / "no.txt"), "-o", str(tmp_path / "out")])
