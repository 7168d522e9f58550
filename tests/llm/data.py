"""Small frames with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

WORDS = "the of and to river stone cloud morning Garden letters window harbour Silver quiet engine market yellow button".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", "."]) for _ in range(n))


def hard_texts():
    return [(1, prose(1, 60)), (2, None), (3, ""), (4, " \n\t "), (5, prose(1, 60)), (5, prose(1, 60)), (None, prose(2, 30)), (None, None),
            (6, prose(3, 9000)), (7, "x" * 50_000), (8, "Ünïcode — “quoted” 字 " * 40), (9, "don't <|endoftext|> STOP <|ENDOFTEXT|> 12,5% ok"), (0, prose(5, 12))]


def documents(spark, rows):
    """``documents`` with extra columns whose names an operator might use itself."""
    full = [(i, t, "en", "s", None if t is None else len(t), 0, "x", 1, "y") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, copies int, ids string").repartition(3)


def empty(df):
    return df.limit(0)
