"""Small tables with nulls, empty and long texts, ties, copies and clashing columns."""

import random

SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa re si to un".split()


def words(dice: random.Random, n: int) -> list[str]:
    return ["".join(dice.choice(SYLLABLES) for _ in range(dice.randint(2, 4))) for _ in range(n)]


def awkward_documents(seed: int = 1) -> list[tuple]:
    """``doc_id, text, lang, source, n_chars, score, node``."""
    dice = random.Random(seed)
    passage = words(dice, 60)
    base = words(dice, 120)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "One two", ".", "a  b \n\n c d e  ", "x\x1cy\x0bz\u0085w"]
    texts += [" ".join(words(dice, dice.randint(3, 200))) for _ in range(20)]
    texts += [" ".join(base)] * 8
    for k in range(12):
        near = list(base)
        near[dice.randrange(120)] = "changed"
        texts.append(" ".join(near))
    for k in range(6):
        texts.append(" ".join(words(dice, 20) + passage + words(dice, 15)))
    texts.append(" ".join(words(dice, 30_000)))
    texts.append("中文 مرحبا \U0001f600 <|endoftext|> İstanbul it's I'M 2024 café café <|startoftext|>x")
    texts.append("z" * 5_000)
    dice.shuffle(texts)
    rows = [(10 + 3 * k, t, "en", "s", len(t or ""), 0.5, "n") for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id here but words", None, None, None, None, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string"


def documents(spark, rows=None):
    return spark.createDataFrame(awkward_documents() if rows is None else rows, SCHEMA).repartition(5)


def given(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
