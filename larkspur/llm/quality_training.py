"""Labelled paragraphs, made from a seed, and the induction of the prose rules on them.

``python -m larkspur.llm.quality_training`` prints the rules that `quality.RULES` holds.
"""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.quality import FEATURES, paragraph_statistics
from larkspur.llm.rules import Rule, induce, predict

ROWS = 12000
#: The features that rules may use, and whether they speak for prose by being large (True) or small (False). Numbers and lengths of words and lines
#: (n_words, mean_word, words_per_line) are reported but not used: rules with them follow the lengths used here (on texts of other lengths they lost 1 in 70).
SPEAKS_FOR = {"remark": True, "common_share": True, "plain_share": True, "digit_share": False, "symbol_share": False, "end_share": True, "broken_share": False, "capital_share": False}
NOUNS = "garden engine letter bridge river window kettle market signal harbour ladder mirror needle orchard pocket quarry ribbon saddle timber valley".split()
SENTENCES = {
    "en": (
        "I could not find out why the {a} was late, so we asked the {b} about it.",
        "Please check the {a} before you send {n} of them to the {b}, because nobody else will.",
        "This is what happens when the {a} and the {b} are not kept in the same place.",
        "does anyone know where the {a} went, i had it on my desk this morning",
        "The {a} is fine, but its {b} looks rather old to me.",
        "Would it help if we moved each {a} to the {b} first?",
        "After {n} days the {a} had still not arrived, and the {b} was closed again.",
        "thanks, that works for me",
        "ok let us talk about the {a} tomorrow, it is too late for that now",
        "You said that `{a}_{b}` returns {n}, which is not what we see here.",
        "Renaming {a}_{b} would make the rest easier to read, in my view.",
        "None of them wanted the {a}.",
        "looks good here, thanks",
        "Calling `x.{a}({n})` gives `None`, although `/{b}` alone gives `\"{a}\"`.",
        "Use `self.{a}[{n}]` instead of `{b}(x)[\"{a}\"]`, since only one is `None`-safe.",
        "Big {a} files slow down every {b} run that follows.",
        "As small as it sounds, fixing {a} took {n} days.",
        "In `lib/{a}.py` (line {n}) the `{a}` is `[]`, but `{b}` expects `({n}, 3)`.",
        "`open_{a}()` gives `None` if `{b} == 0`, so the call fails with a `KeyError` (see #{n}).",
        "With `--{a}={n}` the `{b}` step is left out, and that is why `x` was `-1` in run #{n}.",
    ),
    "de": (
        "Zwei Leute fanden {a} Abschnitt nur schwer lesbar.",
        "Kurze Namen lassen sich meist leichter merken als lange {a} Wörter.",
        "Heute früh kam keine Antwort vom Server {n}.",
        "Ich weiß nicht, warum der {a} schon wieder fehlt, aber wir sollten ihn ersetzen.",
        "Wenn der {a} leer ist, wird auch der {b} nicht mehr gelesen.",
        "Bitte den {a} erst prüfen und dann an {b} weitergeben.",
        "Die Ursache lag am Ende in einem falschen Eintrag im Verzeichnis.",
        "Das ist noch nicht fertig, und bis morgen bleiben nur {n} Stunden.",
    ),
    "fr": (
        "Bonne remarque, nous avons changé {a} dans ce sens.",
        "Pourquoi relire {a} ici puisque l'autre l'avait déjà vérifié ?",
        "Quand tout devient lent, on abandonne après {n} secondes.",
        "Je ne sais pas pourquoi le {a} est en retard, mais il faut le dire aux autres.",
        "Quand on ouvre le {a}, la page reste vide pendant {n} secondes.",
        "Il vaut mieux garder une copie du {b} avant de changer quoi que ce soit.",
        "C'est une bonne idée, et nous l'avons déjà essayée avec le {a}.",
    ),
    "es": (
        "Después de {n} intentos, el resultado sigue igual.",
        "La función {a}_{b} recorre todas las filas otra vez, y sobra.",
        "No sé por qué el {a} llega tarde, pero hay que avisar a los demás.",
        "Cuando se abre el {a}, la página queda vacía durante {n} segundos.",
        "Es mejor guardar una copia del {b} antes de cambiar nada.",
        "Por favor, mira si está en la lista y dime qué falta.",
    ),
}


#: Short remarks, sentences with citations and figures, and sentences of other domains.
REMARKS = (
    "Thanks!", "Done.", "Agreed", "Nice catch!", "Works now", "Merci !", "Danke!", "Listo.", "ACK", "Fixed", "Good point...", "same here", "Why?", "Sounds good!!", "will do", "Perfecto", "Yes, please.", "no idea", "Great work", "Sorry :(", "Bien vu", "Stimmt.", "hm, ok", "WIP", "Merged.",
    "not sure", "Go ahead.", "never mind", "Claro", "Passt", "on it", "Ship it!", "Great 🎉", "thanks 👍", "Nice work there 🚀", "Merci 😀", "done :)",
)
OTHER_DOMAINS = (
    "Miller et al. (2017) found that the effect holds for n = {n} samples (p < 0.01), but see Table {n} for the exceptions.", "Dr. Brown's 1998 survey (N={n}) put the share at 4.2 %; later work, e.g. Lee & Park 2004, puts it at 6-7 %.",
    "As shown in Fig. 3B, the rate rose from 12.5 to 17.3 per cent between 1990 and 2005 (see also Sec. 4.1).", "The recipe serves four: fry the onions in 30 g of butter, add 250 ml of stock and let it simmer for {n} minutes.",
    "We left Lyon at 7:45 and reached Milan by noon, although the pass was closed and the road was covered with snow.", "In 1842 the council sold the mill to a family from Ghent, who ran it until the great flood of 1871.",
    "The bill (H.R. {n}) passed the House by 219 votes to 212 on March 3, 2010, and went to the Senate a week later.", "Her second novel sold over {n},000 copies; critics were less kind, calling it “a long walk to nowhere”.",
    "Der Zug nach Basel hatte {n} Minuten Verspätung, weil bei Offenburg ein Baum auf den Gleisen lag.", "El museo abre de 9:30 a 18:00 y cierra los lunes, salvo que sea fiesta.", "Le prix a baissé de 3,5 % en mars, mais il reste plus haut que l'an dernier (voir le tableau {n}).",
    "Der Bäcker an der Ecke öffnet jeden Morgen um sechs, obwohl die Straße dann noch leer ist.", "Meine Schwester fand im Keller eine Kiste mit Briefen, die niemand je gelesen hatte.", "Wegen der Baustelle fährt die Linie {n} heute nur bis zum Rathaus, danach hält ein Bus.",
    "Ein Kilo Mehl, etwas Hefe und viel Geduld, mehr braucht man für ein gutes Brot nicht.", "Nach dem Regen stand das Wasser in den Feldern, und die Bauern konnten nicht ernten.", "Die Kinder sammelten Kastanien, während der Lehrer den Namen jedes Baums erklärte.",
    "She asked whether the river, which had been low all summer, would ever carry boats again.", "If you mix the two powders with warm water, the paste will set within an hour.",
)


def _prose(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.06:
        return r.choice(REMARKS)
    if kind < 0.22:
        text = " ".join(s.format(n=r.randint(2, 400)) for s in r.choices(OTHER_DOMAINS, k=r.choice([1, 1, 2, 4])))
        return text.upper() if r.random() < 0.15 else text
    lang = r.choice(["en", "en", "en", "de", "de", "fr", "es"])
    text = " ".join(s.format(a=r.choice(NOUNS), b=r.choice(NOUNS), n=r.randint(2, 400)) for s in r.choices(SENTENCES[lang], k=r.choice([1, 1, 2, 3, 5, 9])))
    if r.random() < 0.3:
        width, line, out = r.choice([40, 60, 76]), "", []
        for w in text.split():
            if len(line) + len(w) > width:
                out.append(line)
                line = ""
            line = f"{line} {w}".strip()
        text = "\n".join([*out, line])
    return r.choice(["- ", "> ", ""]) + text if r.random() < 0.1 else text


def _other(r: random.Random) -> str:
    w = lambda k=1: [r.choice(NOUNS) for _ in range(k)]
    n = lambda: r.randint(0, 9999)
    rows = r.choice([1, 3, 6, 12, 25])
    common = r.sample("the of and to in is was it that for with as at by from on are this be or an a we they he not but have".split(), 20)
    line = {
        "words": lambda: " ".join(r.choices(common, k=r.randint(7, 16))) + r.choice(["", "."]),
        "mixed": lambda: " ".join(r.choice([r.choice(common), r.choice(NOUNS), r.choice(common)]) for _ in range(r.randint(9, 16))) + r.choice(["", "."]),
        "menu": lambda: r.choice([" ", " | ", "  ", " · "]).join(r.choice("Home About Contact Careers Privacy Help Login Products Support Blog Docs News Pricing Search Terms Settings Account Logout Us Our Team".split()) for _ in range(r.randint(5, 12))),
        "query": lambda: r.choice([f"SELECT {w()[0]}, b.{w()[0]} FROM {w()[0]} a JOIN {w()[0]} b ON a.id = b.id WHERE a.{w()[0]} = {n()};", f"update {w()[0]} set {w()[0]} = {n()} where {w()[0]} is not null", f"INSERT INTO {w()[0]} ({w()[0]}, {w()[0]}) VALUES ({n()}, '{w()[0]}');"]),
        "salad": lambda: " ".join(w(r.randint(5, 11))).capitalize() + r.choice([".", ".", "!"]),
        "list": lambda: r.choice(["- ", "* ", "• ", "[ ] ", "1. ", "" if rows > 2 else "- "]) + " ".join(w(2)) + r.choice(["", f" ({n()})"]),
        "comma": lambda: ", ".join(w(r.randint(6, 14))),
        "crumbs": lambda: " > ".join(x.capitalize() for x in w(r.randint(3, 6))),
        "table": lambda: "| " + " | ".join([*w(2), str(n()), f"{n() / 100}"]) + " |",
        "csv": lambda: r.choice([";", ",", "\t", "   "]).join([*w(2), str(n()), f"{n() / 100}", w()[0]]),
        "log": lambda: f"2024-03-{r.randint(1, 28):02}T{r.randint(0, 23):02}:10:{r.randint(0, 59):02}Z {r.choice(['INFO', 'WARN', 'ERROR'])} {w()[0]}.{w()[0]}[{n()}] {w()[0]}={n()} {w()[0]}={w()[0]}",
        "numbers": lambda: " ".join(str(n()) for _ in range(10)),
        "trace": lambda: f'  File "{w()[0]}/{w()[0]}_{w()[0]}.py", line {n()}, in {w()[0]}_{w()[0]}\n    {w()[0]}_{w()[0]}({w()[0]})',
        "json": lambda: f'  "{w()[0]}_{n()}": {r.choice([str(n()), "null", chr(34) + w()[0] + chr(34)])},',
        "python": lambda: r.choice([f"    {w()[0]}_{n()} = {w()[0]}({w()[0]}, {n()})", f"def {w()[0]}_{w()[0]}(self, {w()[0]}):", f"    for entry in {w()[0]}_rows:", f"    if not {w()[0]}:\n        return None", f"from {w()[0]}.{w()[0]} import {w()[0].capitalize()}", f"    logger.info(\"the {w()[0]} has no {w()[0]} %d\", {n()})"]),
        "script": lambda: r.choice([f"    const {w()[0]}{n()} = {w()[0]}.filter((x) => x.{w()[0]} > {n()});", "    } catch (error) {", f"function {w()[0]}({w()[0]}, depth) {{", "    return null;", f"    for (const x of {w()[0]}) {{", f"if err := {w()[0]}({w()[0]}); err != nil {{", f"    throw new Error(\"the {w()[0]} was late\");", "// no need to do this twice", "# this is fine as it is", "    return None", "```"]),
        "noise": lambda: "".join(r.choice("#@$%^&*<>/\\|~=+!19abxyz ") for _ in range(60)),
        "base64": lambda: "".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(76)),
        "diff": lambda: r.choice("+- ") + f"import {{ {w()[0]} }} from \"./{w()[0]}\";",
        "heading": lambda: "## " + " ".join(w(3)).capitalize(),
    }
    kind = r.choice(list(line))
    rows = 1 if kind == "heading" else max(rows, 3) if kind in ("python", "script") else rows
    return "\n".join(line[kind]() for _ in range(rows))


def paragraphs(seed: int, rows: int = ROWS) -> list[tuple[str, bool]]:
    """`rows` labelled paragraphs (text, is prose), half of them prose."""
    r = random.Random(seed)
    return [(_prose(r), True) if i % 2 else (_other(r), False) for i in range(rows)]


def featured(spark: SparkSession, labelled: list[tuple[str, bool]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics of labelled paragraphs by the same expressions that are applied later."""
    df: DataFrame = spark.createDataFrame(labelled, "text string, y boolean")
    rows = paragraph_statistics(df, "text").toPandas()
    return {f: rows[f].to_numpy(float) for f in FEATURES if f in SPEAKS_FOR}, rows["y"].to_numpy(bool)


def train(spark: SparkSession, seed: int = 1) -> list[Rule]:
    """The rules, induced on `ROWS` paragraphs."""
    return induce(*featured(spark, paragraphs(seed)), speaks_for=SPEAKS_FOR)


def accuracy(spark: SparkSession, rules: list[Rule], seed: int = 2) -> float:
    """The share of held-out paragraphs that `rules` judge rightly."""
    x, y = featured(spark, paragraphs(seed))
    return float((predict(rules, x) == y).mean())


if __name__ == "__main__":
    session = SparkSession.builder.master("local[4]").getOrCreate()
    found = train(session)
    print(found)
    print(accuracy(session, found))
