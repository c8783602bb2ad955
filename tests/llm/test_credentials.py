"""The field on forms it was not trained on, and what the skipping of lines rests on."""

from __future__ import annotations

import random

import pytest

from larkspur.llm import credentials, credentials_training


def test_forms_kept_out_of_training():
    shares = credentials_training.recall(credentials.model())
    assert min(shares.values()) >= 0.9, shares


def test_lines_without_a_trigger_cannot_have_a_label():
    """Over all combinations of features of such tokens; and no made line loses a label to the skipping."""
    assert credentials.model().least_margin() < 0
    r = random.Random(9)
    for _ in range(3000):
        line = r.choice([credentials_training.line, lambda r: credentials_training.unseen(r)[1]])(r).replace("\x02", "").replace("\x03", "")
        if not credentials.TRIGGER.search(line.lower()):
            found = credentials.tokens(line)
            assert not any(credentials.model().viterbi(found)), line
            assert not any(t.name == "secret" or t.shape == "format" for t in found), line


def test_steps_decide_where_emissions_do_not():
    """Labels that the tokens' own weights would give differently: the chain is no table of tokens."""
    field = credentials.model()
    free = credentials.Field_(field.weights, {k: [[0.0, 0.0], [0.0, 0.0]] for k in field.steps})
    r = random.Random(4)
    lines = [credentials_training.labelled(r.choice([credentials_training.line(r), credentials_training.unseen(r)[1]])) for _ in range(1500)]
    wrong = [sum(f.viterbi(t) != y for t, y, _ in lines) for f in (field, free)]
    assert wrong[0] * 2 < wrong[1], wrong


@pytest.mark.parametrize(
    ("line", "masked"),
    [
        ("password: Xk29sLq81zP  # prod", "password: ***********  # prod"), ("export DB_PASSWORD=Xk29sLq81zP # prod", "export DB_PASSWORD=*********** # prod"), ('dsn = "host=db user=app password=Xk29sLq81zP"', 'dsn = "host=db user=app password=***********"'),
        ('"Server=db;Uid=sa;Pwd=Xk29sLq81zP;"', '"Server=db;Uid=sa;Pwd=***********;"'), ('password = "correct horse battery staple"', 'password = "****************************"'), ("curl -u admin:Xk29sLq81zP https://x.example", "curl -u admin:*********** https://x.example"),
        ('client.login("bob", "Xk29sLq81zP")', 'client.login("bob", "***********")'), ("deploy --password Xk29sLq81zP now", "deploy --password *********** now"), ("<password>Xk29sLq81zP</password>", "<password>***********</password>"),
        ("machine x.example login bob password Xk29sLq81zP", "machine x.example login bob password ***********"), ('password="Xk29" + "sLq81zP"', 'password="****" + "*******"'), ("password: pa(ss)w0rd!x", "password: ************"),
        ('x = "sk-proj-abcDEF123456ghiJKL789"', 'x = "' + "*" * 29 + '"'), ('password = "Enter your password"', None), ("password: ${DB_PASSWORD}  # prod", None), ('dsn = "host=db user=app"', None), ("<password></password>", None), ('key = "correct horse battery staple"', None), ("", None),
    ],
)
def test_whole_credentials_are_masked(line, masked):
    assert credentials.redact(line) == (masked if masked is not None else line)
