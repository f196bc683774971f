"""Items in scripts without spaces, and all windows of small tables by full edit distance."""

import random

import pytest

from kredenz.llm.decontaminate import characters, edits_allowed, leaks, symbols
from tests.llm.fixtures import documents, words
from tests.llm.test_search import edited, full_distance

ALPHABETS = {
    "chinese": [chr(c) for c in range(0x4E00, 0x4E00 + 600)],
    "japanese": [chr(c) for c in range(0x3042, 0x3094)],
    "thai": [chr(c) for c in range(0x0E01, 0x0E2F)],
}


def table(spark, texts):
    return documents(spark, [(k, t, None, None, 0, 0.0, "") for k, t in enumerate(texts)])


def items_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def changed(dice, alphabet, item, edits):
    item = list(item)
    for _ in range(edits):
        k, how = dice.randrange(len(item)), dice.randrange(3)
        item[k : k + (how != 1)] = [dice.choice(alphabet)] if how != 2 else []
    return "".join(item)


@pytest.mark.parametrize("script", sorted(ALPHABETS))
def test_edited_items_without_spaces_are_found(spark, script):
    dice, alphabet = random.Random(script), ALPHABETS[script]
    some = lambda n: "".join(dice.choices(alphabet, k=n))
    items = [some(dice.randint(20, 120)) for _ in range(30)]
    texts, planted = [], {}
    for k in range(300):
        own = items[k % 30]
        body = changed(dice, alphabet, own, dice.randint(0, edits_allowed(len(own), 0.8)))
        if k % 4:
            planted[k] = k % 30
            body = f"{some(dice.randint(0, 60))}。{body[:9]} \n{body[9:]}、{some(dice.randint(0, 60))}"
        else:
            body = f"{some(80)} latin words too {some(40)}"
        texts.append(body)
    got = {(r.doc_id, r.item_id) for r in leaks(table(spark, texts), items_of(spark, items)).collect()}
    assert {d for d, _ in got} <= set(planted)
    assert len(got & set(planted.items())) >= 0.99 * len(planted)


def test_one_changed_word_of_two_characters(spark):
    item = "在一九四九年以后这座城市的人口增长了三倍而且建造了许多新的桥梁和道路"
    text = "前文。" + item.replace("人口", "居民") + "。后文也在这里"
    (row,) = leaks(table(spark, [text, "在一九四九年以后"]), items_of(spark, [item])).collect()
    assert (row.doc_id, row.item_id, row.distance) == (0, 0, 2) and row.similarity == 1 - 2 / len(item)


def nearest(item, text, most):
    return min((min(full_distance(item, text[a : a + len(item) + most])) for a in range(max(1, len(text)))), default=most + 1)


def test_all_windows_of_small_tables(spark):
    dice = random.Random(11)
    items = [" ".join(words(dice, n)) for n in (5, 6, 9, 14, 22, 30)] + ["".join(dice.choices(ALPHABETS["chinese"], k=n)) for n in (3, 6, 15, 40)]
    items += ["one two", items[2]]
    texts = []
    for k in range(240):
        own = items[k % len(items)]
        if " " in own:
            body = edited(dice, own.split(), dice.randint(0, 1 + edits_allowed(len(own.split()), 0.8)))
            texts.append(" ".join(words(dice, dice.randint(0, 12)) + body + words(dice, dice.randint(0, 12))))
        else:
            some = lambda: "".join(dice.choices(ALPHABETS["chinese"], k=dice.randint(0, 20)))
            body = changed(dice, ALPHABETS["chinese"], own, dice.randint(0, 1 + edits_allowed(len(own), 0.8)))
            texts.append(f"{some()}{body}{some()}")
    want = set()
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            by_sign = " " not in item
            a, b = ((characters(x.split())[0] if by_sign else symbols(x.split())).tolist() for x in (item, text))
            most = edits_allowed(len(a), 0.8) if len(a) >= 5 else 0
            if by_sign and not any(x in text for x in ALPHABETS["chinese"]):
                continue
            if b and nearest(a, b, most) <= most:
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in leaks(table(spark, texts), items_of(spark, items)).collect()}
    assert len(want) > 150 and got <= want and len(got) >= 0.98 * len(want)
