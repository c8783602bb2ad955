"""Text statistics per document and whether it is natural prose.

A text is taken by paragraphs (parts between blank lines). The statistics of a paragraph go
through a rule list that was induced on labelled paragraphs (`quality_training`) and is
applied as a native SQL CASE expression; a document is prose if at least half
of the characters of its paragraphs are prose. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.rules import Rule, Test, case

#: Function words of English, German, French and Spanish (fixed values, in alphabetical order). Words that are
#: also keywords of programming languages are left out.
COMMON = (
    "a all am an and any are at be been both but by can could de do does el en es few had has have he her his how i"
    " it its la le les me might more most my no nobody none not of on only or our out should so some such than that the their them then"
    " there these it they this those though to too un until up us was we were what when where which who why will would you your"
    " als auch auf aus bei bis das dass damit dem den der die ein eine einem einen er es für habe haben hat hier ich ihn im ist kann man mir"
    " nicht noch nur ob oder schon sie sind und vom von war warum wenn wie wird würde zu zum zur"
    " au aux avec ce cette chaque dans deux du elle il je ne nous où pas plus pour pourquoi qu que qui se si son sont sur une"
    " al antes cada con cuando del esta está este eso hace lo muy ni para pero por porque qué sin su también una y ya"
).split()
#: Sentence ends.
ENDS = r"(?m)[.!?…:][\"'”’)»\]]*[^\S\n]*$"
#: Runs of characters that are no symbols.
NO_SYMBOLS = r"[\p{L}\p{N}\s.,;:!?'\"’“”«»()…¿¡-]+"

#: Induced by `quality_training.train()` (see there): prose if a rule covers the paragraph.
RULES: list[Rule] = [
    (Test("end_share", True, 0.9583), Test("common_share", True, 0.0455), Test("broken_share", False, 0.0079), Test("plain_share", True, 0.6), Test("remark", True, 0.5),),
    (Test("end_share", True, 0.8333), Test("common_share", True, 0.0455), Test("broken_share", False, 0.0076),),
    (Test("plain_share", True, 0.9289), Test("common_share", True, 0.0674), Test("broken_share", False, 0.0062), Test("end_share", True, 0.0455),),
    (Test("plain_share", True, 0.8545), Test("remark", True, 0.5),),
    (Test("common_share", True, 0.286), Test("plain_share", True, 0.9129), Test("broken_share", False, 0.0048), Test("end_share", True, 0.0538),),
    (Test("common_share", True, 0.2985), Test("broken_share", False, 0.0048), Test("plain_share", True, 0.9042), Test("symbol_share", False, 0.0379), Test("end_share", True, 0.1667),),
    (Test("common_share", True, 0.3002), Test("broken_share", False, 0.0033), Test("plain_share", True, 0.923),),
    (Test("remark", True, 0.5),),
    (Test("plain_share", True, 0.8065), Test("common_share", True, 0.0357), Test("end_share", True, 0.8758), Test("broken_share", False, 0.0593),),
    (Test("plain_share", True, 0.862), Test("broken_share", False, 0.0062), Test("common_share", True, 0.0485), Test("symbol_share", False, 0.0108), Test("capital_share", False, 0.193), Test("end_share", True, 0.4389),),
    (Test("plain_share", True, 0.9311), Test("broken_share", False, 0.0022), Test("common_share", True, 0.0404), Test("symbol_share", False, 0.0073), Test("capital_share", False, 0.0297),),
    (Test("plain_share", True, 0.8868), Test("end_share", True, 0.4051), Test("broken_share", False, 0.0062), Test("common_share", True, 0.1623), Test("digit_share", False, 0.0041),),
]


PLAIN = r"(?<!\S)[\"'“«(¿¡]*(?:I|A|\d{1,4}|\p{Lu}?[\p{Ll}’']+(?:-\p{L}+)?|(?=[.,;:!?…)])|\d\p{L}|\p{L}{1,2}[=<>]\d[\d.,]*)[.,;:!?…)\"'”»]*(?!\S)"


#: One line of one to four words with the marks that end or part sentences and nothing else (but a smiley).
REMARK = r"^\s*(?:\p{L}[\p{L}'’]{0,19}[.,!?…;:]*\s+){0,3}\p{L}[\p{L}'’]{0,19}\s*[.!?…]*(?:\s*(?:[:;]-?[)(D]|\p{So}+))?\s*$"
#: Three or more capitalised words in a row, as in menus and titles.
CAPITAL_RUN = r"\p{Lu}\p{Ll}++(?:[ |·>/]++\p{Lu}\p{Ll}++){2,}+"
#: Determiners, and words that none of them stands before in a sentence (fixed values): words in a row without grammar have such pairs.
DETERMINERS = "the|a|an|my|your|our|their|its|der|den|dem|ein|eine|einen|le|un|une|el|los|una"
NEVER_AFTER = "the|a|an|of|to|in|is|was|and|or|at|by|for|with|that|it|he|we|they|be|are|were|from|than|if|der|den|und|ist|war|von|zu|mit|le|du|et|est|pour|el|y|es|por"
BROKEN = r"\b(?=[" + "".join(sorted({w[0] for w in DETERMINERS.split("|")})) + rf"])(?:{DETERMINERS}) (?=[" + "".join(sorted({w[0] for w in NEVER_AFTER.split("|")})) + rf"])(?:{NEVER_AFTER})\b"


def _left(text: str, pattern: str) -> Column:
    """How many characters are left without the runs of a pattern: far fewer matches than one per character."""
    return F.length(F.regexp_replace(text, pattern, ""))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.col(part).cast("double") / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def paragraph_statistics(df: DataFrame, text: str) -> DataFrame:
    """Adds the `FEATURES` of the paragraphs in column `text`; shares are of words, characters or lines and never null.

    Code between single backticks is left out of everything but the number of lines. Every text is passed a fixed
    number of times by regular expressions.
    """
    counted = lambda pattern: F.regexp_count(F.col("_t"), F.lit(pattern))
    df = df.withColumn("_t", F.regexp_replace(F.col(text), r"(?<!`)`[^`\n]+(?:\n[^`\n]+)?`(?!`)", ""))
    # what is written in capitals throughout is read like the rest
    df = df.withColumn("_l", F.lower("_t"))
    df = df.withColumn("_t", F.when((F.length("_t") >= 12) & (F.col("_t") == F.upper("_t")), F.col("_l")).otherwise(F.col("_t")))
    df = df.withColumns({
        "_words": F.regexp_extract_all("_l", F.lit(r"\p{L}+"), F.lit(0)), "_tokens": counted(r"\S+"), "_plain": counted(PLAIN),
        "_chars": _left("_t", r"\s+"), "_digits": _left("_t", r"\P{N}+"), "_symbols": _left("_t", NO_SYMBOLS),
        "_broken": F.regexp_count("_l", F.lit(BROKEN)), "_capitals": F.length(F.array_join(F.regexp_extract_all("_t", F.lit(CAPITAL_RUN), F.lit(0)), "")),
        "_lines": F.regexp_count(F.col(text), F.lit(r"(?m)^.*\S")), "_ends": F.regexp_count(F.col(text), F.lit(ENDS)),
    })
    df = df.withColumns({
        "_n": F.size("_words"), "_letters": F.length(F.array_join("_words", "")), "_common": F.size(F.filter("_words", lambda w: w.isin(*COMMON))),
    })
    return df.withColumns({
        "n_words": F.col("_n").cast("double"), "mean_word": _share("_letters", "_n"), "common_share": _share("_common", "_n"),
        "plain_share": _share("_plain", "_tokens"), "digit_share": _share("_digits", "_chars"), "symbol_share": _share("_symbols", "_chars"),
        "end_share": _share("_ends", "_lines"), "words_per_line": _share("_n", "_lines"),
        "broken_share": _share("_broken", "_n"), "capital_share": _share("_capitals", "_chars"),
        "remark": F.when(F.length(text) < 120, F.col(text).rlike(REMARK).cast("double")).otherwise(F.lit(0.0)),
    }).drop("_broken", "_capitals", "_t", "_l", "_words", "_tokens", "_plain", "_chars", "_digits", "_symbols", "_lines", "_ends", "_n", "_letters", "_common")


FEATURES = ("n_words", "mean_word", "common_share", "plain_share", "digit_share", "symbol_share", "end_share", "words_per_line", "broken_share", "capital_share", "remark")


def statistics(documents: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, mean_word, common_share, plain_share, digit_share, symbol_share, end_share, words_per_line, broken_share, capital_share, remark, prose_share, is_prose).

    One row per row of `documents`. Null and blank texts have zeros, a null prose_share and is_prose null. Means over
    paragraphs are weighted by their characters, so that a document's figure is that of its text.
    """
    rows = documents.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"\r?\n(?:[^\S\n]*\r?\n)+"), lambda p: ~p.rlike(r"^(?U)\s*$"))
    long = rows.select("doc_id", "_row", F.explode_outer(parts).alias("p"))
    wide = paragraph_statistics(long, "p").withColumn("c", _left("p", r"\s+"))
    judged = wide.withColumn("prose", F.expr(case(RULES if rules is None else rules)))
    weight = F.nullif(F.sum("c"), F.lit(0))
    means = [F.coalesce(F.sum(F.col(f) * F.col("c")) / weight, F.lit(0.0)).alias(f) for f in FEATURES if f != "n_words"]
    prose = F.sum(F.when(F.col("prose"), F.col("c")).otherwise(F.lit(0))) / weight
    out = judged.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.coalesce(F.sum("n_words"), F.lit(0.0)).cast("long").alias("n_words"), *means, prose.alias("prose_share")
    )
    return out.withColumn("is_prose", F.col("prose_share") >= 0.5).drop("_row")


def not_prose(documents: DataFrame) -> DataFrame:
    """(doc_id): documents with non-blank text that is mostly something else than sentences; one row per id."""
    return statistics(documents).filter("not is_prose").select("doc_id").distinct()
