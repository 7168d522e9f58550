"""Leaks whose values, names or single words were changed."""

from hosttrace.llm import template_leaks

from .data import documents, prose
from .test_near import QUESTION, leaks

BOXES = ("a shop keeper puts 3 boxes of red pens on the upper shelf and 5 boxes of blue pens on the lower shelf before the "
         "doors open, how many boxes of pens stand on the shelves by then")
FRUIT = "every child in the class gets 2 apples and 2 pears from the basket near the door, how many pieces of fruit are handed out to a class of 24 children"


def test_numbers_may_coincide_or_part(spark):
    docs = [(1, BOXES.replace("3 boxes", "4 boxes").replace("5 boxes", "4 boxes")), (2, FRUIT.replace("2 apples", "3 apples").replace("2 pears", "5 pears")),
            (3, FRUIT.replace("2 pears", "6 pears")), (4, QUESTION.replace("Boston", "Denver").replace("Albany", "Denver")), (5, prose(3, 200))]
    got = leaks(spark, docs, [(10, BOXES), (11, FRUIT), (12, QUESTION)])
    assert got == {(1, 10): "reparameterised", (2, 11): "reparameterised", (3, 11): "reparameterised"}


TOM = "Tom has 3 apples in his basket. Tom gives 2 apples to a friend. Tom then buys 6 more apples. Tom eats 1 apple on the way. How many apples are left?"


def test_names_at_the_start_of_a_sentence(spark):
    anna = TOM.replace("Tom", "Anna")
    docs = [(1, TOM), (2, anna), (3, prose(1, 40) + "\n" + anna.replace("3", "8")), (4, "tom " + TOM[4:]), (5, "Question: " + anna), (6, prose(3, 200))]
    assert leaks(spark, docs, [(10, TOM)]) == {(1, 10): "copied", (2, 10): "reparameterised", (3, 10): "reparameterised", (4, 10): "copied", (5, 10): "reparameterised"}


LONG = ("the baker sells small round loaves at the corner of the old square every morning and keeps what is left for the evening "
        "when a few late guests come in and ask whether there is any bread to take home")


def test_words_put_in_left_out_and_replaced(spark):
    w = LONG.split()
    n = len(w)
    thirds = [x if k not in (n // 3, 2 * n // 3) else "foreign" for k, x in enumerate(w)]
    inserted = [" ".join([*w[:k], "foreign", *w[k:]]) for k in range(n + 1)]
    dropped = [" ".join([*w[:k], *w[k + 1:]]) for k in range(n)]
    docs = list(enumerate([*inserted, *dropped, " ".join(thirds), FRUIT.replace("24", "twenty five")]))
    # A far part of an item, twice, is not more of it.
    apart = [(1000, " ".join([*w[:14], *prose(5, 60).split(), *w[-4:]]))]
    got = leaks(spark, docs + apart, [(10, LONG), (11, FRUIT)])
    assert {d for d, i in got if i == 10} == set(range(len(docs) - 1)) and {d for d, i in got if i == 11} == {len(docs) - 1}


def test_repetitive_item(spark):
    item = "there " + " and ".join(f"{name} has {k} apples" for k, name in enumerate("Tom Ann Bob Eve Kim Joe Max Zoe Ben".split(), 2))
    assert leaks(spark, [(1, item), (2, "and " + item)], [(10, item)]) == {(1, 10): "copied", (2, 10): "copied"}


def test_tables_of_numbers_do_not_meet(spark):
    """Windows of placeholders alone are hashed with their values."""
    numbers = " ".join(str(k * 7919 % 1000) for k in range(40))
    long = " ".join(str(k * 104729 % 1000) for k in range(100_000))
    items = [(1, numbers), (2, "compute 3 plus 4 times 5 minus 6 and tell us how many are left over when 7 people share")]
    docs = [(1, long), (2, prose(1, 50) + " " + numbers + " " + prose(2, 50)), (3, items[1][1].replace("7 people", "9 people"))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert template_leaks.matches(documents(spark, docs[:1]), bench).count() == 0
    assert leaks(spark, docs, items) == {(2, 1): "copied", (3, 2): "reparameterised"}


def test_rows_are_judged_by_their_text(spark):
    docs = [(None, QUESTION), (None, prose(1, 60)), (7, "x " + QUESTION), (7, prose(2, 60)), (8, None)]
    bench = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    kept = template_leaks.clean_documents(documents(spark, docs), bench).collect()
    assert sorted(str((r["doc_id"], r["text"])) for r in kept) == sorted(str(docs[k]) for k in (1, 3, 4))
