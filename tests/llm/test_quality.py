"""Texts of other domains than the training's, and what rules may use."""

from __future__ import annotations

import pytest

from larkspur.llm import quality, quality_training

PROSE = (
    "Thanks!", "LGTM", "Shipped.", "nice", "ok, thx", "Looks good to me 👍", "Merci beaucoup !", "THIS IS NOT WHAT WE AGREED ON, AND NOBODY TOLD ME ABOUT IT.", "Dr. Smith's 2019 study (N=1,204) reported p<0.05; see Fig. 3A for the full curve.",
    "The old lighthouse keeper climbed the stairs every evening, lit the lamp and wrote a line in his book.", "wieso geht das denn jetzt wieder nicht, gestern lief es doch noch", "No hay que olvidar que la lluvia de ayer dejó los caminos llenos de barro.",
    "Add two eggs,\nstir until the batter is smooth,\nand let it rest\nfor an hour.",
)
OTHER = (
    "function words in a row the of and to in is was it that for", "the of and the to in is was it that for as with at by", "Home About Us Contact Careers Privacy Help Log in", "HOME | ABOUT | CONTACT | LOGIN | 2024", "wolf lamp carpet seven orange glass tunnel paper cloud",
    "eggs; 2\nmilk; 300\nflour; 1250\nsugar; 80", "SELECT a.id, b.name FROM a JOIN b ON a.id = b.id WHERE b.name LIKE 'x%';", "2024-05-01 12:00:01 ERROR worker[12] timeout=30 retry=2", "<div class=\"a\"><span>x</span></div>", "AAECAwQFBgcICQoLDA0ODxAREhMUFRYXGBkaGxwdHh8gISIjJCUmJygpKis=",
)


def test_texts_of_other_domains(spark):
    rows = [(i, t) for i, t in enumerate([*PROSE, *OTHER])]
    got = {r["doc_id"]: r["is_prose"] for r in quality.statistics(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [t for i, t in rows if got[i] is not (i < len(PROSE))] == []


@pytest.mark.parametrize("feature", ["common_share", "plain_share", "end_share", "broken_share", "symbol_share", "capital_share", "remark"])
def test_rules_weigh_several_statistics(feature):
    assert any(t.feature == feature for r in quality.RULES for t in r)
    assert feature in quality_training.SPEAKS_FOR
