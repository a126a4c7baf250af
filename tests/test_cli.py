"""The command line, on the test session."""

import io

import pytest

from rupaka.__main__ import main

LEXICON = "word\tparadigm_class\nघर\tM2\nलड़की\tF1\n"


@pytest.fixture
def lexicon(tmp_path):
    (tmp_path / "lexicon.tsv").write_text(LEXICON)
    return str(tmp_path / "lexicon.tsv")


def test_words_and_sentences(spark, lexicon, capsys, monkeypatch):
    main(["nouns", "--lexicon", lexicon, "लड़कियों"])
    assert "लड़की" in capsys.readouterr().out
    main(["verbs", "गया"])
    assert "जा" in capsys.readouterr().out
    main(["sentences", "--lexicon", lexicon, "घर में"])
    out = capsys.readouterr().out
    assert "घर/M/SG/OBL/M2" in out and "postposition→OBL" in out
    monkeypatch.setattr("sys.stdin", io.StringIO("घर\n"))
    main(["nouns", "--lexicon", lexicon])
    assert "घर" in capsys.readouterr().out


def test_a_lexicon_is_needed(lexicon):
    with pytest.raises(SystemExit):
        main(["nouns", "घर"])
